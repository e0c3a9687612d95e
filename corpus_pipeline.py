"""The corpus pipeline: documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  Between stages the table is written
as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import quality
from textlake.llm.common import read, save
from textlake.llm.decontaminate import decontaminate, drop_contaminated
from textlake.llm.line_dedup import dedup_lines, keep_lines
from textlake.llm.mix_sources import mix, shards_for
from textlake.llm.near_dedup import keep_one, near_duplicates
from textlake.llm.queries import fold

#: The columns that every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A shard of the mix holds about so many characters of the documents.
SHARD_CHARS = 1 << 26
#: Documents with a lower quality score go.
LEAST_QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from four folds in five.
    Null texts are scored as empty; repeated rows are scored alike; rows with a null id teach nothing."""
    docs = docs.select(*COLUMNS)
    good = read(spark, sf_dir, "labels", "doc_id", "quality").where((F.col("quality") == 1) & (fold(5) != 0))
    model = quality.learn(docs, good, unlabelled=fold(5) != 0)
    return quality.score(docs, model, out="__score").where(F.col("__score") >= LEAST_QUALITY).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere; every document stays a
    row, with an empty text when all its lines do.  ``n_chars`` follows the text.
    Null texts stay null; of equal lines the first by id and line stays, so rows that
    repeat id and text keep or lose the same lines."""
    docs = docs.select(*COLUMNS)
    out = keep_lines(docs.withColumn("__before", F.length("text")), dedup_lines(docs, min_words=0))
    changed = F.length("text") != F.col("__before")
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id.  Texts without
    words, null ones too, are one class; null ids come last; of repeated rows one stays."""
    docs = docs.select(*COLUMNS)
    return keep_one(docs, near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty is a benchmark's.  Null texts have no
    words and stay; repeated rows stay or go alike."""
    docs = docs.select(*COLUMNS)
    return drop_contaminated(docs, decontaminate(docs, read(spark, sf_dir, "benchmark", "item_id", "text")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: pieces of documents by shard, (shard, order_key, doc_id, source, pass, n_words, text).
    Rows that repeat id and text are mixed each; a null source is one source, null texts have no words."""
    docs = docs.select(*COLUMNS)
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    return mix(docs, n_shards=shards_for(chars, SHARD_CHARS))


STAGES = [("quality classifier", quality_filter), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each on what its predecessor wrote."""
    docs = read(spark, sf_dir, "documents", *COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, "stage")
    return docs


#: Learned weights, hashed signatures and iterated groups have no SQL form.
ORACLE_SQL = None
