"""Line dedup against brute force: only similar lines are linked, and of the similar
pairs of the given documents each class of lengths has nine in ten found."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.test_near_and_lines import edits, frame, norm, roots

from textlake.llm import line_dedup
from textlake.llm.line_dedup import dedup_lines


def similar(a, b):
    return edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9


def similar_pairs(texts):
    """(different lines as words, pairs of their numbers): the exact join that stands referee.
    Lines of edit similarity 0.8 share pairs of neighbouring words unless very short, so all
    lines that share one are looked at, and all short ones with each other."""
    lines = sorted({norm(x) for t in texts if t for x in t.split("\n")} - {""})
    words = [x.split(" ") for x in lines]
    by_pair = defaultdict(list)
    for i, w in enumerate(words):
        for pair in {(a, b) for a, b in zip(w, w[1:], strict=False)} if len(w) >= 4 else ():
            by_pair[pair].append(i)
    shared = defaultdict(int)
    for rows in by_pair.values():
        for a in range(len(rows)):
            for b in range(a):
                shared[rows[b], rows[a]] += 1
    enough = lambda a, b, n: n >= 0.6 * max(len(words[a]), len(words[b])) - 1  # an edit parts two pairs at most
    return words, [(a, b) for (a, b), n in shared.items() if enough(a, b, n) and similar(words[a], words[b])]


def test_share_of_similar_pairs_that_is_found(spark, sf_dir=SF_MID):
    words, pairs = similar_pairs([r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()])
    some = sorted({i for p in pairs for i in p})
    docs = frame(spark, [(i, " ".join(words[i])) for i in some])
    got = {r.id: r.class_id for r in dedup_lines(docs, min_words=0).collect()}
    for low, high in ((0, 20), (20, 50), (50, 1 << 30)):
        own = [(a, b) for a, b in pairs if low <= max(len(words[a]), len(words[b])) < high]
        found = sum(got[a] == got[b] for a, b in own)
        print(f"{sf_dir}: lines of {low} to {high} words: {found} of {len(own)} similar pairs")
        assert len(own) > 30 and found >= 0.9 * len(own)
    # nothing else is linked: classes are within the connected groups of similar lines
    whole = roots(some, pairs)
    assert all(whole[i] == whole[c] for i, c in got.items())


def test_lines_of_few_edits_are_linked(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 6)))
    lines = []
    for n in [12, 16, 20, 25, 30, 40, 60, 100, 150] * 12:
        base = [word() for _ in range(n)]
        for k in (0, max(1, n // 20)):
            w = list(base)
            for at in r.sample(range(1, n - 1), k):
                w[at] = word()
            lines.append(" ".join(w))
    got = {x.id: x.class_id for x in dedup_lines(frame(spark, list(enumerate(lines)))).collect()}
    links = [(a, b) for a in range(len(lines)) for b in range(a) if similar(lines[a].split(), lines[b].split())]
    whole = roots(range(len(lines)), links)
    assert all(whole[i] == whole[c] for i, c in got.items())
    assert sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links) and len(links) >= 108


def test_links_grow_with_the_lines(spark, monkeypatch, n=300):
    """Lines that are each some edits from one line, so that most pairs aren't similar: the
    verified links that go on are a few a line, and the groups are those of all pairs that meet."""
    r = random.Random(1)
    base = ["".join(r.choices("abcdefgh", k=4)) for _ in range(40)]
    lines = []
    for _ in range(n):
        w = list(base)
        for at in r.sample(range(1, 39), 4):
            w[at] = "".join(r.choices("stuvwxyz", k=4))
        lines.append(" ".join(w))
    seen = []
    plain = line_dedup.connected_components
    monkeypatch.setattr(line_dedup, "connected_components", lambda edges, **k: (seen.append(edges.count()), plain(edges, **k))[1])
    got = {x.id: x.class_id for x in dedup_lines(frame(spark, list(enumerate(lines)))).collect()}
    assert max(seen) <= 40 * n
    assert len(set(got.values())) <= 0.1 * n  # one group, but for lines that share no key


def test_a_bucket_of_many_groups(spark):
    """Lines that share a pair of rare words, but are only similar within groups."""
    r = random.Random(9)
    lines = []
    for g in range(12):
        base = [f"{chr(97 + g)}{chr(97 + i)}x" for i in range(18)]
        for _ in range(5):
            w = list(base)
            w[r.randrange(18)] = "".join(r.choice("klmnop") for _ in range(6))
            lines.append(" ".join([*w[:9], "zzq", "qqz", *w[9:]]))
    got = defaultdict(set)
    for x in dedup_lines(frame(spark, list(enumerate(lines)))).collect():
        got[x.class_id].add(x.id)
    # nothing is linked across groups; SimHash may leave a line of a group alone
    assert all(len({i // 5 for i in ns}) == 1 for ns in got.values())
    largest = [max(len(ns) for ns in got.values() if min(ns) // 5 == g) for g in range(12)]
    assert sum(largest) >= 0.9 * 60


def test_pipeline_drops_equal_lines_of_any_length(spark):
    """One word, digits, marks and a script without blanks; blank lines stay."""
    texts = ["Ietzte.\n\n12 34\n***\n\u4eca\u65e5\u306f", "ietzte\n \n12 35\n***\n\u4eca\u65e5\u306f", "12 34\n\n \nab cd\nAB, cd!\n\t"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {0: texts[0], 1: " \n12 35", 2: "\n \nab cd\n\t"}


def test_query_leaves_no_equal_lines(spark):
    from textlake.llm.queries import op7_line_dedup
    text = {r.doc_id: r.text.split("\n") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    kept = [text[r.doc_id][r.line] for r in op7_line_dedup(spark, SF_SMALL).where("kept").collect()]
    kept = [x for x in kept if re.search("[^\\x00-\\x20\\x7f]", x)]
    assert len(kept) == len(set(kept))
