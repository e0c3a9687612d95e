"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver tables (whole tables, whole texts) and builds a
lazy plan from the library operators; nothing is collected.  Doubles are
rounded to ``ROUND`` places and integers are bigint so that the SQL oracle
returns the same values and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import html as H
from textlake.functions.constants import TOP_RANK_PER_GROUP, TOP_TF_IN_GROUP, TOP_WORDS
from textlake.functions.text import (clean_string, glue_phrases, normalize_array, normalize_text,
                                     remove_stopwords, strip_plural)
from textlake.functions.urls import url_group_key, url_group_key_default
from textlake.operators import counts, documents, normalize, pages, stats, tfidf, trends
from textlake.plans import params as P
from textlake.plans import sql_api
from textlake.plans.materialize import materialize, materialize_by_range
from textlake.session import shared_dir
from textlake.sources import files, tables

Query = Callable[[SparkSession, str], DataFrame]


def _joined(array):
    """All values of an array column, so that the oracle compares each."""
    return F.array_join(array, "|").alias(array)


def _r(c):
    return F.round(c, P.ROUND)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.raw_documents(spark, sf_dir, (P.GROUP, P.SECOND_GROUP))
    return documents.clean_documents(raw, ["doc_id", P.GROUP, P.SECOND_GROUP],
                                     stopwords=P.STOPWORDS, phrases=P.FIXTURE_PHRASES)


def _text(spark, sf_dir):
    return tables.read_table(spark, sf_dir, "documents", ["doc_id", "text"])


def _pages(spark, sf_dir):
    return tables.read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])


def _sessions(spark, sf_dir):
    return documents.filter_sessions(_docs(spark, sf_dir), P.SESSION_LINK, P.SESSION_INCLUDE,
                                     "title", P.SESSION_EXCLUDE)


# --- scalar text functions --------------------------------------------------

def q_clean_string(spark, sf_dir):
    return _text(spark, sf_dir).select("doc_id", clean_string(F.lower("text")).alias("cleaned"))


def q_remove_stopwords(spark, sf_dir):
    cleaned = clean_string(F.lower("text"))
    return _text(spark, sf_dir).select("doc_id", remove_stopwords(cleaned, P.STOPWORDS)
                                       .alias("cleaned"))


def q_strip_plural(spark, sf_dir):
    cleaned = remove_stopwords(clean_string(F.lower("text")), P.STOPWORDS)
    return _text(spark, sf_dir).select("doc_id", strip_plural(cleaned).alias("cleaned"))


def q_glue_phrases(spark, sf_dir):
    cleaned = clean_string(F.lower("text"))
    return _text(spark, sf_dir).select("doc_id", glue_phrases(cleaned, P.FIXTURE_PHRASES)
                                       .alias("cleaned"))


def q_normalize_text(spark, sf_dir):
    return _text(spark, sf_dir).select(
        "doc_id", normalize_text("text", P.STOPWORDS, P.FIXTURE_PHRASES).alias("body"))


def q_normalize_array(spark, sf_dir):
    conv = tables.read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    parts = normalize_array(F.split("text", r"\."))
    return conv.select("conv_id", "turn", F.posexplode(parts).alias("pos", "sentence")) \
        .select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "sentence")


def q_url_group_key(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "url", url_group_key("url").alias("year"))


def q_url_group_key_default(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "url",
                                        url_group_key_default("url", pattern=P.URL_DIGITS_PATTERN)
                                        .alias("year"))


# --- sources and sinks ------------------------------------------------------

def q_page_extract(spark, sf_dir):
    ext = _speakers(spark, sf_dir)
    return ext.select("page_id", "link", "title", "content", _joined("speakers"))


def q_scan_jsonl(spark, sf_dir):
    """Pages -> raw documents -> JSON lines (sink) -> explicit-schema scan."""
    raw = _fields(_pages(spark, sf_dir), keep=())
    path = files.write_jsonl(raw, shared_dir(spark, "jsonl"))
    back = files.read_jsonl(spark, path)
    return back.select("link", "title", "content", _joined("speakers"))


def q_sink_jsonl(spark, sf_dir):
    """Clean documents written as JSON lines and read back."""
    docs = _docs(spark, sf_dir).select("doc_id", P.GROUP, "body")
    path = files.write_jsonl(docs, shared_dir(spark, "jsonl"))
    schema = "doc_id BIGINT, lang STRING, body STRING"
    return spark.read.schema(schema).json(path)


def _broken_lines(spark, sf_dir):
    """Documents as JSON lines of which some were cut or garbled on the way."""
    docs = tables.read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "text"])
    line = F.to_json(F.struct(F.col("source").alias("title"), F.col("text").alias("content"), F.array("lang").alias("speakers"),
                              F.col("doc_id").cast("string").alias("link")))
    kind = F.pmod("doc_id", F.lit(P.BROKEN_EVERY))
    return docs.select("doc_id", F.when(kind == 0, F.substr(line, F.lit(1), F.length(line) - 2)).when(kind == 1, F.concat(F.lit("#"), line))
                       .otherwise(line).alias("line"))


def q_scan_jsonl_broken(spark, sf_dir):
    """Lines that parse as documents, and the broken ones as they were read."""
    path = files.write_wordlist(_broken_lines(spark, sf_dir), "line", shared_dir(spark, "jsonl"))
    good, bad = files.read_jsonl_checked(spark, path)
    good = good.select(F.lit(False).alias("broken"), "title", "content", _joined("speakers"), "link")
    none = [F.lit(None).cast("string").alias(c) for c in ("title", "speakers", "link")]
    return good.unionByName(bad.select(F.lit(True).alias("broken"), F.col("line").alias("content"), *none))


def q_normalize_text_table(spark, sf_dir):
    """The normalizer with its stopwords from a word file."""
    words = spark.createDataFrame([(w,) for w in P.STOPWORDS], "word string")
    path = files.write_wordlist(words, "word", shared_dir(spark, "wordlist"))
    return normalize.normalize_with_words(_text(spark, sf_dir), ["doc_id"], "text", files.read_wordlist(spark, path),
                                          P.FIXTURE_PHRASES)


def q_timeline_materialized(spark, sf_dir):
    """The timeline of a written count table: only row groups that may hold its words are read."""
    counted = counts.word_count_per_group(_docs(spark, sf_dir), [P.GROUP])
    written = materialize_by_range(counted, "word-counts", "word")
    return trends.timeline(written, [P.GROUP], P.TIMELINE_TERMS)


def q_scan_wordlist(spark, sf_dir):
    """Distinct words of part names written one per line, then scanned."""
    part = tables.read_table(spark, sf_dir, "part", ["p_name"])
    words = part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    path = files.write_wordlist(words, "word", shared_dir(spark, "wordlist"))
    return files.read_wordlist(spark, path)


def q_preview_nonempty(spark, sf_dir):
    raw = tables.raw_documents(spark, sf_dir, (P.GROUP,))
    first = documents.preview_nonempty(raw, "content", ["doc_id"], P.PREVIEW_ROWS)
    docs = documents.clean_documents(first, ["doc_id", P.GROUP], stopwords=P.STOPWORDS,
                                     phrases=P.FIXTURE_PHRASES)
    return docs.select("doc_id", P.GROUP, "title", "body")


# --- document views ---------------------------------------------------------

def q_clean_documents(spark, sf_dir):
    return _docs(spark, sf_dir)


def q_filter_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir).select("doc_id", P.SESSION_LINK, "title")


def q_filter_by_group(spark, sf_dir):
    docs = documents.filter_by_group(_docs(spark, sf_dir), P.GROUP, P.GROUP_VALUE)
    return docs.select(P.GROUP, "doc_id", "title").orderBy("title", "doc_id")


# --- counts -----------------------------------------------------------------

def q_count_per_group(spark, sf_dir):
    return counts.count_per_group(_sessions(spark, sf_dir), [P.GROUP]).orderBy(P.GROUP)


def q_word_count(spark, sf_dir):
    return counts.word_count(_docs(spark, sf_dir))


def q_word_count_per_group(spark, sf_dir):
    return counts.word_count_per_group(_docs(spark, sf_dir), [P.GROUP])


def _fields(pg, keep=("page_id",)):
    return pages.page_extract(pg, keep=keep, title=P.TITLE, content=P.CONTENT, speakers=P.SPEAKERS)


def _speakers(spark, sf_dir):
    return _fields(_pages(spark, sf_dir))


def q_array_element_count(spark, sf_dir):
    return counts.array_element_count(_speakers(spark, sf_dir), "speakers")


def q_word_count_topk(spark, sf_dir):
    wc = counts.word_count(_docs(spark, sf_dir))
    return counts.top_k(wc, [F.col("count").desc(), F.col("word")], TOP_WORDS)


def q_word_count_per_group_topk(spark, sf_dir):
    wc = counts.word_count_per_group(_docs(spark, sf_dir), [P.GROUP])
    return counts.top_k(wc, [F.col("count").desc(), F.col(P.GROUP), F.col("word")], TOP_WORDS)


def q_array_element_topk(spark, sf_dir):
    wc = counts.array_element_count(_speakers(spark, sf_dir), "speakers")
    return counts.top_k(wc, [F.col("count").desc(), F.col("word")], TOP_WORDS)


def q_words_per_group(spark, sf_dir):
    return counts.words_per_group(_docs(spark, sf_dir), [P.GROUP]) \
        .select(P.GROUP, F.col("number_of_words").cast("bigint").alias("number_of_words")) \
        .orderBy(P.GROUP)


def q_stopwords_anti_join(spark, sf_dir):
    """Word counts per group with a word table removed by an anti join."""
    raw = tables.raw_documents(spark, sf_dir, (P.GROUP,))
    cleaned = raw.select(P.GROUP, clean_string(F.lower(F.concat("title", F.lit(" "), "content")))
                         .alias("body"))
    stop = spark.createDataFrame([(w,) for w in P.STOPWORDS], "word string")
    return counts.tokens_without(cleaned, [P.GROUP], stop)


# --- trends -----------------------------------------------------------------

def q_timeline(spark, sf_dir):
    tc = trends.term_counts(_docs(spark, sf_dir), [P.GROUP], P.TIMELINE_TERMS)
    return trends.timeline(tc, [P.GROUP], P.TIMELINE_TERMS)


def q_timeline_relative(spark, sf_dir):
    out = trends.term_share(_docs(spark, sf_dir), [P.GROUP], P.TIMELINE_TERMS)
    return out.withColumn("relative_count", _r("relative_count"))


def q_term_groups_relative(spark, sf_dir):
    share = trends.term_share(_docs(spark, sf_dir), [P.GROUP], P.CAMP_FIRST + P.CAMP_SECOND)
    out = trends.label_camps(share, P.CAMP_FIRST, P.CAMP_FIRST_LABEL, P.CAMP_SECOND_LABEL)
    return out.select(P.GROUP, "technology", "count", _r("relative_count").alias("relative_count"))


# --- corpus statistics ------------------------------------------------------

def _stats(df):
    return df.select(P.GROUP, "urls", F.col("text_length").cast("bigint").alias("text_length"),
                     _r("avg_document_size").alias("avg_document_size"))


def q_corpus_stats(spark, sf_dir):
    return _stats(stats.corpus_stats(_docs(spark, sf_dir), [P.GROUP], "doc_id"))


def q_corpus_stats_filtered(spark, sf_dir):
    docs = documents.filter_sessions(_docs(spark, sf_dir), P.SESSION_LINK,
                                     P.STATS_LINK_INCLUDE, exclude=())
    return _stats(stats.corpus_stats(docs, [P.GROUP], "doc_id"))


def q_corpus_stats_by_label(spark, sf_dir):
    """Group key reached by a join: documents left join labels on doc_id,
    grouped by quality (NULL for unlabeled documents).  The labels side
    grows with the corpus, so no broadcast hint: AQE picks the strategy
    from runtime sizes."""
    labels = tables.read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    docs = _docs(spark, sf_dir).select("doc_id", "body").join(labels, "doc_id", "left")
    out = stats.corpus_stats(docs, ["quality"], "doc_id")
    return out.select("quality", "urls", F.col("text_length").cast("bigint").alias("text_length"),
                      _r("avg_document_size").alias("avg_document_size"))


def q_word_count_per_role(spark, sf_dir):
    """The normalizer and per-group word count over a second corpus."""
    conv = tables.read_table(spark, sf_dir, "conversations", ["role", "text"])
    body = conv.select("role", normalize_text("text", P.STOPWORDS, P.FIXTURE_PHRASES)
                       .alias("body"))
    return counts.word_count_per_group(body, ["role"])


# --- TF-IDF -----------------------------------------------------------------

def _round_scores(df, key):
    return df.select(*key, "term", _r("score").alias("score"), "tf")


def q_document_frequency(spark, sf_dir):
    return tfidf.document_frequency_of_rows(_docs(spark, sf_dir))


def q_tfidf_exact(spark, sf_dir):
    return _round_scores(tfidf.tfidf_exact(_docs(spark, sf_dir), ["doc_id"]), ["doc_id"])


def q_tfidf_per_group(spark, sf_dir):
    return _round_scores(tfidf.tfidf_exact(_docs(spark, sf_dir), [P.GROUP], salts=1), [P.GROUP])


def q_tfidf_per_source(spark, sf_dir):
    return _round_scores(tfidf.tfidf_exact(_docs(spark, sf_dir), [P.SECOND_GROUP], salts=1),
                         [P.SECOND_GROUP])


def _top_terms(spark, sf_dir, group):
    scores = tfidf.tfidf_exact(_docs(spark, sf_dir), [group], salts=1)
    top = tfidf.top_terms_per_group(scores, [group], TOP_RANK_PER_GROUP)
    return top.select(group, "term", _r("score").alias("score"),
                      F.col("rank").cast("bigint").alias("rank"))


def q_top_terms_per_group(spark, sf_dir):
    return _top_terms(spark, sf_dir, P.GROUP)


def q_top_terms_per_source(spark, sf_dir):
    return _top_terms(spark, sf_dir, P.SECOND_GROUP)


def q_top_terms_for_document(spark, sf_dir):
    scores = tfidf.tfidf_of_document(_docs(spark, sf_dir), "doc_id", P.DOCUMENT_KEY_VALUE)
    out = tfidf.terms_of_document(scores, "doc_id", P.DOCUMENT_KEY_VALUE)
    return out.select("term", _r("score").alias("score"), "tf", "doc_id")


# The tf of a term in a group document is the number of its (non-empty)
# tokens in the group, so the tf trend queries read only the token counts
# they need instead of the whole per-group score table.

def _tf_share(spark, sf_dir, terms):
    out = trends.term_share(_docs(spark, sf_dir), [P.GROUP], terms, scale=1.0,
                            relative="relative_tf", drop_empty=True, keep_total=True)
    return out.select(P.GROUP, F.col("word").alias("term"), F.col("count").cast("double")
                      .alias("tf"), F.col("total").cast("double").alias("total"), "relative_tf")


def q_tf_timeline(spark, sf_dir):
    return _tf_share(spark, sf_dir, P.TIMELINE_TERMS).select(P.GROUP, "term", "tf")


def q_tf_timeline_relative(spark, sf_dir):
    return _tf_share(spark, sf_dir, P.TIMELINE_TERMS) \
        .withColumn("relative_tf", _r("relative_tf"))


def q_term_groups_tf(spark, sf_dir):
    share = _tf_share(spark, sf_dir, P.CAMP_FIRST + P.CAMP_SECOND)
    return trends.label_camps(share, P.CAMP_FIRST, P.CAMP_FIRST_LABEL, P.CAMP_SECOND_LABEL,
                              word="term").select(P.GROUP, "technology", "tf")


def q_tf_total_per_group(spark, sf_dir):
    """Sum of tf over a group document = its number of non-empty tokens:
    one map-side-combined count per group, shuffling only (#groups) rows
    per task."""
    toks = counts.explode_tokens(_docs(spark, sf_dir), [P.GROUP]).where(F.col("word") != "")
    return toks.groupBy(P.GROUP).agg(F.count(F.lit(1)).cast("double").alias("total_tf")) \
        .orderBy(P.GROUP)


def q_top_tf_in_group(spark, sf_dir):
    """The group filter reaches the Parquet scan: only that group's texts
    are read and normalized."""
    docs = documents.filter_by_group(_docs(spark, sf_dir), P.GROUP, P.TOP_TF_GROUP_VALUE)
    tf = tfidf.term_frequencies(docs, [P.GROUP]).select("term", F.col("tf").cast("double"))
    return counts.top_k(tf, [F.col("tf").desc(), F.col("term")], TOP_TF_IN_GROUP)


def q_ml_tokenize(spark, sf_dir):
    words = tfidf.ml_tokenize(_docs(spark, sf_dir).select("doc_id", "body"))
    return words.select("doc_id", F.posexplode("words").alias("pos", "word")) \
        .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "word")


def q_tfidf_hashed(spark, sf_dir):
    scores = tfidf.tfidf_hashed_scores(_docs(spark, sf_dir), ["doc_id"])
    return _round_scores(scores, ["doc_id"])


def q_tfidf_hashed_vectors(spark, sf_dir):
    """The ML pipeline itself (Tokenizer -> HashingTF -> IDF), read off the
    vectors into the long (doc, term, score, tf) table.  The normalized texts
    are written once: the fit and both sides of the scores' join read them."""
    docs = materialize(_docs(spark, sf_dir).select("doc_id", "body"), "hashed-bodies")
    vec = tfidf.hashed_tfidf_vectors(docs)
    return _round_scores(tfidf.vector_scores(vec, ["doc_id"]), ["doc_id"])


def q_tfidf_cached_features(spark, sf_dir):
    """The vectors of documents whose features are kept between the fit and the
    transform: the long score table is written inside the block and read back."""
    docs = _docs(spark, sf_dir).select("doc_id", "body")
    with tfidf.cached_features(docs) as features:
        scores = tfidf.vector_scores(tfidf.idf_vectors(features), ["doc_id"])
        written = materialize(_round_scores(scores, ["doc_id"]), "cached-scores")
    return written


def q_term_presence(spark, sf_dir):
    """Which of some terms' buckets each document's vector holds, and with what weight."""
    vectors = tfidf.hashed_tfidf_vectors(_docs(spark, sf_dir).select("doc_id", "body"))
    out = tfidf.term_presence(vectors, ["doc_id"], P.PRESENCE_TERMS)
    return out.select("doc_id", "term", F.col("bucket").cast("bigint").alias("bucket"), "tf", _r("weight").alias("weight"), "present")


def q_tfidf_hashed_per_group(spark, sf_dir):
    scores = tfidf.tfidf_hashed_scores(_docs(spark, sf_dir), [P.GROUP])
    return _round_scores(scores, [P.GROUP])


def q_hash_bucket_audit(spark, sf_dir):
    """Distinct corpus terms straight from the tokens (partial-aggregated per
    term), not via the (doc, term) table."""
    toks = counts.explode_tokens(_docs(spark, sf_dir), [], word="term").where(F.col("term") != "")
    return tfidf.hash_bucket_audit(toks, P.AUDIT_BUCKETS)


def q_hash_bucket_terms(spark, sf_dir):
    """Term, HashingTF bucket, the bucket's IDF weight and its number of terms."""
    out = tfidf.hash_bucket_terms(_docs(spark, sf_dir))
    return out.select("term", F.col("bucket").cast("bigint").alias("bucket"),
                      _r("weight").alias("weight"), "n_terms")


# --- trends over the session view ---------------------------------------------

def q_session_word_count_per_group(spark, sf_dir):
    return counts.word_count_per_group(_sessions(spark, sf_dir), [P.GROUP])


def q_session_timeline_relative(spark, sf_dir):
    out = trends.term_share(_sessions(spark, sf_dir), [P.GROUP], P.TIMELINE_TERMS)
    return out.withColumn("relative_count", _r("relative_count"))


def q_session_top_terms_per_group(spark, sf_dir):
    scores = tfidf.tfidf_exact(_sessions(spark, sf_dir), [P.GROUP], salts=1)
    top = tfidf.top_terms_per_group(scores, [P.GROUP], TOP_RANK_PER_GROUP)
    return top.select(P.GROUP, "term", _r("score").alias("score"),
                      F.col("rank").cast("bigint").alias("rank"))


# --- SQL text over the registered functions and views ---------------------------

def _sql(spark, sf_dir, text):
    sql_api.register_sql_functions(spark, P.STOPWORDS, P.FIXTURE_PHRASES)
    sql_api.register_views(spark, sf_dir, P.GROUP, P.STOPWORDS, P.FIXTURE_PHRASES)
    return spark.sql(text)


def q_sql_normalizer_steps(spark, sf_dir):
    """Each normalizer function by its SQL name."""
    return _sql(spark, sf_dir, """
        SELECT doc_id, removeStopwords(c) AS stopped, lemmatize(c) AS singular, tokenize(c) AS glued,
               array_join(stripArray(split(content, '[.]')), '|') AS sentences
        FROM (SELECT doc_id, content, cleanString(lower(content)) AS c FROM raw_documents)""")


def q_sql_clean_documents(spark, sf_dir):
    return _sql(spark, sf_dir, f"""
        SELECT doc_id, {P.GROUP}, cleanString(lower(title)) AS title,
               cleanString(lower(content)) AS content,
               clearAll(lower(concat(title, ' ', content))) AS body
        FROM raw_documents""")


def q_sql_timeline_relative(spark, sf_dir):
    terms = ", ".join(sql_api.lit(t) for t in P.TIMELINE_TERMS)
    return _sql(spark, sf_dir, f"""
        SELECT w.{P.GROUP}, w.word, w.count,
               round(w.count / t.total * 100, {P.ROUND}) AS relative_count
        FROM wordcounts_per_group w LEFT JOIN (
          SELECT {P.GROUP}, sum(count) AS total FROM wordcounts_per_group GROUP BY {P.GROUP}) t
          ON w.{P.GROUP} = t.{P.GROUP}
        WHERE w.word IN ({terms}) ORDER BY w.{P.GROUP}, w.count, w.word""")


def q_sql_top_terms(spark, sf_dir):
    return _sql(spark, sf_dir, f"""
        SELECT {P.GROUP}, term, round(score, {P.ROUND}) AS score, CAST(rank AS BIGINT) AS rank
        FROM (SELECT {P.GROUP}, term, score,
                     dense_rank() OVER (PARTITION BY {P.GROUP} ORDER BY score DESC) AS rank
              FROM scores_per_group WHERE score <> 0)
        WHERE rank <= {TOP_RANK_PER_GROUP}""")


def q_sql_words_per_group(spark, sf_dir):
    return _sql(spark, sf_dir, f"""
        SELECT {P.GROUP}, sum(array_size(split(body, ' '))) AS number_of_words
        FROM clean_documents GROUP BY {P.GROUP} ORDER BY {P.GROUP}""")


# --- pages ------------------------------------------------------------------

def q_page_anchor_list(spark, sf_dir):
    return pages.page_anchor_list(_pages(spark, sf_dir), speakers=P.SPEAKERS) \
        .select("page_id", F.col("pos").cast("bigint").alias("pos"), "speaker")


def _slots():
    return F.regexp_extract_all("html", F.lit(P.GATE_SLOT_PATTERN), 1)


def q_page_gate(spark, sf_dir):
    return pages.page_gate(_pages(spark, sf_dir), P.GATE_SPECIAL, _slots(), key=P.GATE_KEY)


def q_page_links(spark, sf_dir):
    return pages.page_links(_pages(spark, sf_dir), P.LINK_ALLOWED_DOMAINS, P.LINK_DENY)


def q_page_extract_by_layout(spark, sf_dir):
    from textlake.functions.urls import url_lang
    layouts = pages.layout_rules(spark, P.PAGE_LAYOUTS)
    out = pages.page_extract_by_layout(_pages(spark, sf_dir), layouts, url_lang(F.col("url")))
    return out.select("page_id", "link", "site_key", "title", "content", _joined("speakers"))


def q_page_direct_text(spark, sf_dir):
    """Direct text nodes of article paragraphs."""
    return pages.direct_paragraph_text(_pages(spark, sf_dir))


def q_page_corpus_timeline(spark, sf_dir):
    """Pages to trends in one plan: gate -> page fields -> clean documents
    (URL language as the group key) -> session filter on the link -> term
    share per group.  One scan of the page table, one small shuffle."""
    from textlake.functions.urls import url_lang
    pg = _pages(spark, sf_dir)
    gated = pg.where(pages.page_gate_condition(P.GATE_SPECIAL, _slots(), key=H.page_lang("html")))
    raw = _fields(gated.withColumn("year", url_lang(F.col("url"))), keep=("year",))
    docs = documents.clean_documents(raw, ["year", "link"], stopwords=P.STOPWORDS,
                                     phrases=P.FIXTURE_PHRASES)
    sessions = documents.filter_sessions(docs, "link", P.PAGE_SESSION_INCLUDE)
    out = trends.term_share(sessions, ["year"], P.TIMELINE_TERMS)
    return out.withColumn("relative_count", _r("relative_count"))


def q_page_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", H.page_title("html", P.TITLE).alias("title"))


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
