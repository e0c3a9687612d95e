"""Quality and toxicity: held-out accuracy, the automaton against edit distance, edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_MID
from textlake.llm import quality, toxicity
from textlake.llm.queries import QUERIES
from textlake.llm.words import FOLDED, slices


def held_out(spark, name, label):
    rows = QUERIES[name](spark, SF_MID)
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    got = rows.join(labels, on="doc_id").where("held_out").select("predicted", "score", label).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    hit = [r.predicted for r in got if r[label] == 1]
    clean = [r.predicted for r in got if r[label] == 0]
    assert rows.count() == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    return sum(hit) / len(hit), 1 - sum(clean) / len(clean)


def test_quality_held_out(spark):
    keep, reject = held_out(spark, "op6_quality_classifier", "quality")
    assert keep >= 0.97 and reject >= 0.9


def test_toxicity_held_out(spark):
    # 37 toxic texts to learn from here; more labels find more terms (see the README)
    catch, leave = held_out(spark, "op4_toxicity", "toxic")
    assert catch >= 0.6 and leave >= 0.97


def test_class_prior_and_risk():
    r = np.random.default_rng(1)
    good = r.normal(2, 1, (3000, 2))
    mixed = np.concatenate([r.normal(2, 1, (2100, 2)), r.normal(-2, 1, (900, 2))])
    assert abs(quality.class_prior(good, mixed) - 0.7) < 0.06
    model = quality.fit(good, mixed)
    assert (model.score(r.normal(2, 1, (500, 2))) >= 0.3).mean() > 0.97
    assert (model.score(r.normal(-2, 1, (500, 2))) < 0.3).mean() > 0.95


EDGE = [(1, "good words here and there"), (2, None), (3, ""), (4, "|" * 50_000), (5, "a " * 100_000), (None, "good words"), (1, "good words here and there")]


def edge_frames(spark):
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in EDGE], "doc_id long, text string, score int, positive string")
    return docs, spark.createDataFrame([(1, 1, 1), (3, 0, 0), (4, 0, None), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality_edge_cases(spark):
    docs, labels = edge_frames(spark)
    model = quality.learn(docs, labels.where("quality = 1"))
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "text", "positive", "score"] and out.count() == len(EDGE)
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert quality.score(docs.where("false"), model).count() == 0
    nothing = quality.learn(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}


def test_toxicity_edge_cases(spark):
    docs, labels = edge_frames(spark)
    for known in (labels, labels.where("false"), labels.where("toxic = 1")):
        out = toxicity.score(docs, toxicity.learn(docs, known))
        assert out.columns == ["doc_id", "text", "positive", "score"] and out.count() == len(EDGE)
        assert all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.score(docs.where("false"), toxicity.learn(docs, labels)).count() == 0


def edits(x, y):
    d = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        p, d[0] = d[0], i
        for j, e in enumerate(y, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (c != e))
    return d[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abcéनст日本😀", min_size=1, max_size=7), min_size=1, max_size=8, unique=True),
       st.lists(st.text("abcéñxनмст日本語😀😁", min_size=1, max_size=9), min_size=1, max_size=30))
def test_automaton_is_edit_distance(terms, words):
    automaton = toxicity.Automaton(terms)
    for _, t in slices(pa.array([" ".join(words)]), FOLDED, fold=True):
        got = {int(w): (int(e), int(x)) for w, x, e in zip(*automaton.hits(t), strict=True)}
    for i, word in enumerate(words):
        near = [(edits(word, x), k) for k, x in enumerate(terms) if edits(word, x) <= (len(x) >= 5)]
        assert got.get(i, (None,))[0] == min(near, default=(None,))[0]
        assert i not in got or got[i] in near


def test_quotation_is_told_from_abuse():
    terms, weight = ["stupid"], np.array([3.0])
    automaton = toxicity.Automaton(terms)
    texts = ["you are stupid and slow", 'they said "you are stupid" to me', "“stupid” is a word", "he called it 'stupid'", "STUPID", "stupld", ""]
    for _, t in toxicity.folded(pa.array(texts)):
        x = toxicity.features(t, automaton, weight)
    exact, near, cite = x[:, 0] > 0, x[:, 1] > 0, x[:, 2] > 0
    assert exact.tolist() == [True, False, False, True, True, False, False]
    assert cite.tolist() == [False, True, True, False, False, False, False]
    assert near.tolist() == [False] * 5 + [True, False]


def hits_of(terms, text):
    automaton = toxicity.Automaton(terms)
    for _, t in toxicity.folded(pa.array([text])):
        return [t.word(int(w)).decode() for w in automaton.hits(t)[0]]


def test_scripts_are_told_apart():
    hindi, japanese = "बेवकूफ", "馬鹿野郎"
    assert hits_of([hindi], f"नमस्ते दुनिया {hindi} धन्यवाद") == [hindi]
    assert hits_of([japanese], f"東京大学 新聞記事 {japanese}") == [japanese]
    assert hits_of(["дурак"], "ДУРАК дурак Дурака мир слово") == ["дурак", "дурак", "дурака"]
    assert hits_of(["idiot"], "IDIOT idi0t идиот") == ["idiot", "idi0t"]


def test_marks_are_paired_along_a_line():
    automaton, weight = toxicity.Automaton(["idiot"]), np.array([3.0])
    texts = ['he wrote "hello" you idiot and "bye"', 'he wrote "you idiot" and "bye"', 'a 12" pipe\nhe said "you idiot" there',
             '"hello" you idiot, "bye"', 'she called him "an idiot who never ever learns a single thing"', 'idiot "']
    for _, t in toxicity.folded(pa.array(texts)):
        x = toxicity.features(t, automaton, weight)
    assert (x[:, 2] > 0).tolist() == [False, True, True, False, True, False]


def test_score_is_the_model_over_plain_counts(spark):
    """The whole score again, word by word, for a small lexicon."""
    r = random.Random(4)
    terms = ["awful", "идиот", "बेवकूफ"]
    vocabulary = ["fine", "day", "Awful", "awfull", "ИДИОТ", "бидон", "बेवकूफ", "नमस्ते", "said", '"awful"', "東京"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randrange(0, 30)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weight, rng = np.array([2.0, 3.0, 4.0]), np.random.default_rng(1)
    base = toxicity.standard(rng.random((50, toxicity.N_FEATURES)))
    model = toxicity.Model(base.mean, base.scale, rng.normal(size=len(base.weights)))
    learned = toxicity.Toxicity(terms, weight, toxicity.Automaton(terms), model)
    got = {x.doc_id: x.score for x in toxicity.score(docs, learned).collect()}
    for i, text in rows:
        tokens = re.findall(r'[0-9a-z\u0080-\U0010ffff]+|"', text.lower())
        words, marks, parity = [], [], 0
        for t in tokens:
            if t == '"':
                parity ^= 1
                marks.append(len(words))
            else:
                words.append((t, parity, len(marks)))
        hits = []
        for k, (w, inside, _) in enumerate(words):
            near = [(edits(w, x), j) for j, x in enumerate(terms) if edits(w, x) <= (len(x) >= 5)]
            if near:
                before = any(k - toxicity.CONTEXT < m <= k or (m == 0 and k < toxicity.CONTEXT + 1) for m in marks if m <= k)
                behind = any(k < m <= k + toxicity.CONTEXT or (m == len(words) and k + toxicity.CONTEXT >= len(words) - 1) for m in marks if m > k)
                report = any(v in toxicity.REPORTING for v, _, _ in words[max(0, k - toxicity.CONTEXT):k])
                hits.append((k, *min(near), bool(inside and ((before and behind) or (report and (before or behind))))))
        exact, close = [h for h in hits if h[1] == 0 and not h[3]], 0
        for a, b in zip(hits, hits[1:], strict=False):
            close += b[0] - a[0] <= toxicity.CLOSE and not b[3]
        x = [np.log1p(len(exact)), np.log1p(sum(h[1] > 0 and not h[3] for h in hits)), np.log1p(sum(h[3] for h in hits)),
             np.log1p(len({h[2] for h in exact})), max([weight[h[2]] for h in exact], default=0), np.log1p(sum(weight[h[2]] for h in exact)),
             np.log1p(close), np.sqrt(len(exact) / max(len(words), 1))]
        assert abs(got[i] - model.score(np.array([x]))[0]) < 1e-9, text


def test_lexicon_counts_near_copies_once(spark):
    r = random.Random(1)
    rows = [(1, f"awful w{r.randrange(50)} w{r.randrange(50)} w{r.randrange(50)} end") for _ in range(30)]
    rows += [(0, f"w{r.randrange(50)} w{r.randrange(50)} fine w{r.randrange(50)} end") for _ in range(60)]
    rows += [(1, "once only rare word here")] * 20
    terms, weight = toxicity.lexicon(spark.createDataFrame(rows, "toxic int, text string"))
    assert "awful" in terms and "rare" not in terms and "end" not in terms and len(weight) == len(terms)
