"""Registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import language, quality, secrets, toxicity
from textlake.llm.centroids import centroid_clusters
from textlake.llm.common import read
from textlake.llm.decontaminate import decontaminate
from textlake.llm.exact_dedup import exact_dedup
from textlake.llm.fill_middle import fill_in_middle, restore
from textlake.llm.line_dedup import dedup_lines
from textlake.llm.mix_sources import mix_sources
from textlake.llm.near_dedup import near_duplicates
from textlake.llm.substring_dedup import substring_dedup
from textlake.llm.warc import read_packages, write_packages

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return add


@query(oracle="""
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of all documents; the row with the largest doc_id stays."""
    return exact_dedup(read(spark, sf_dir, "documents", "doc_id", "text"), keep="largest")


@query()
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source to the contract's target weights."""
    plan = mix_sources(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source",
                       F.size("pieces").alias("n_pieces"))


@query(oracle="""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
runs AS (
  SELECT doc_id, i, w[i] AS word,
         CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END AS run FROM places),
counted AS (
  SELECT doc_id, i, word, run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS twice FROM runs),
covered AS (
  SELECT doc_id, i, word, bool_or(twice) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM counted),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in a run of 35 words found twice."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return substring_dedup(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(oracle="""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
size AS (SELECT item_id, w, least(len(w), 13) AS n FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS run
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM size)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS run
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM place JOIN win USING (n, run)),
word AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM (SELECT DISTINCT doc_id, i, n FROM hit)),
words AS (SELECT doc_id, count(*) AS n_hit FROM word GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in all documents."""
    found = decontaminate(read(spark, sf_dir, "documents", "doc_id", "text"),
                          read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query(oracle="""
WITH page AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
digest AS (
  SELECT page_id, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS lead,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((
           (instr('0123456789abcdef', substr(hex, 1 + (5 * i) // 4, 1)) - 1) * 16
           + (CASE WHEN (5 * i) // 4 < 39 THEN instr('0123456789abcdef', substr(hex, 2 + (5 * i) // 4, 1)) - 1 ELSE 0 END)
           ) >> (3 - (5 * i) % 4)) & 31))::INTEGER, 1) FOR i IN range(0, 32)], '') AS payload_digest FROM page)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM digest
""")
def op2_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as packages, and read back by ranges."""
    packages = write_packages(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    records = read_packages(packages, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies among all documents; the smallest doc_id stays."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", "kept")


def fold(folds: int):
    """crc32 of the id's digits modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


@query()
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from positives and unlabelled texts of four folds in five."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    good = read(spark, sf_dir, "labels", "doc_id", "quality").where((F.col("quality") == 1) & (fold(5) != 0))
    model = quality.learn(docs, good, unlabelled=fold(5) != 0)
    return quality.score(docs, model, drop_text=True).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of three folds in four."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").where(fold(4) != 2)
    learned = toxicity.learn(docs, labels)
    return toxicity.score(docs, learned, drop_text=True).select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def span_list(parts) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


@query()
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential parts of all documents: base spans, and weak ones with their complements."""
    found = secrets.scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("parts", lambda p: p["strong"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_list(base), 256).alias("base_sha256"),
                        span_list(F.col("parts")).alias("spans"))


@query()
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents with its class; one occurrence of each class stays."""
    marked = dedup_lines(read(spark, sf_dir, "documents", "doc_id", "text"), min_words=0)
    return marked.select(F.col("id").alias("doc_id"), "line", "class_id", "class_line", "class_size", "kept")


ROUNDS = 5


def _clusters_sql() -> str:
    """The rounds one after another; a vector's whole components travel as a list."""
    nearest = ("SELECT r, c, d FROM (SELECT r, c, list_sum([(v.q[i] - m.q[i]) ** 2 FOR i IN range(1, 65)])::BIGINT AS d, "
               "row_number() OVER (PARTITION BY r ORDER BY d, c) AS n FROM kept v, m{t} m) WHERE n = 1")
    steps = ["""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, sha256('2:' || vec_id::VARCHAR) AS h,
         [floor(least(greatest(256 * x::DOUBLE, -134217728), 134217728))::BIGINT FOR x IN embedding] AS q
  FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)""",
             "m0 AS MATERIALIZED (SELECT c - 1 AS c, q FROM (SELECT row_number() OVER (ORDER BY h NULLS LAST, q) AS c, q FROM kept) WHERE c <= 40)"]
    for t in range(ROUNDS):
        steps += [f"a{t} AS MATERIALIZED ({nearest.format(t=t)})",
                  f"""s{t} AS (SELECT c, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{t} JOIN kept USING (r), range(1, 65) u(i) GROUP BY c, i)""",
                  f"""n{t} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{t} GROUP BY c)""",
                  f"m{t + 1} AS MATERIALIZED (SELECT c, coalesce(n.q, m.q) AS q FROM m{t} m LEFT JOIN n{t} n USING (c))"]
    steps.append(f"a AS MATERIALIZED ({nearest.format(t=ROUNDS)})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, count(*) OVER (PARTITION BY c) AS cluster_size,
       (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM a JOIN kept USING (r) JOIN m{ROUNDS} m USING (c)"""


@query(oracle=_clusters_sql())
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 40 clusters after five rounds of whole-number centroids."""
    return centroid_clusters(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), rounds=ROUNDS)[0]


@query()
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from four folds in five."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    learned = language.learn(docs.where(fold(5) != 0))
    return language.identify(docs, learned).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "sure")


@query(oracle="""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
number AS (
  SELECT doc_id, text, w, len(w) AS n, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
         ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM doc),
cut AS (
  SELECT doc_id, text, n, array_to_string(w[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS pre,
         array_to_string(w[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS mid,
         array_to_string(w[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS suf,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM number)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM cut
""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and put in another order, and rebuilt from that."""
    formed = restore(fill_in_middle(read(spark, sf_dir, "documents", "doc_id", "text")))
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                         F.sha2("restored", 256).alias("restored_sha256"))
