"""Exact dedup (native): 128-bit content hash, one row stays, bytes compared.

1. One pass over the texts makes (id, 128-bit hash, sha256): 60 bytes a row.
2. Groups are counted on the hash in two steps, (hash, salt) and then hash,
   so a group with a third of all rows is never gathered: each partition
   sees 1/``salts`` of it.
3. Bytes are compared inside the groups of two rows and more: their smallest
   and largest text (a map-side combined aggregate, two texts a group and
   task) are the same exactly when all texts are.  A hash that different
   texts share is split by the text itself, so a collision drops nothing.

Defined results.  A null text counts as empty.  A null id never stays when
its group has an id; a group of null ids only keeps them all.  Rows that
repeat the staying id and text are the same row to a stable id: all carry
``kept``.  An empty table gives an empty result.  Other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import salt, salted_totals, save, text_or_empty


def content_hash(text: Column) -> Column:
    """128-bit hash of a text's bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                salts: int = 256, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each input row.

    ``keep``: "smallest" or "largest" id of equal texts stays.  ``salts``:
    partitions that a group's rows are spread over.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", hash_of(F.col("text")))
    rows = save(texts.select("id", "h", F.unhex(F.sha2("text", 256)).alias("sha"),
                             salt("id", salts=salts).alias("salt")), "exact-rows")
    totals = salted_totals(rows, ["h"], salts, [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")])
    # where the smallest and the largest text differ, the hash stands for several texts
    ends = [F.min("text").alias("lo"), F.max("text").alias("hi")]
    collided = save(texts.withColumn("salt", salt("id", salts=salts))
                    .join(totals.where("n > 1").select("h", "salt"), on=["h", "salt"], how="left_semi")
                    .groupBy("h", "salt").agg(*ends).groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                    .where(F.col("lo") != F.col("hi")).select("h", F.lit(True).alias("split")), "exact-collisions")
    # such a hash is told apart by the text's sha256 as well; else the hash alone is the key
    keyed = (rows.join(collided, on="h", how="left")
             .select("id", "sha", "salt", F.when(F.col("split"), F.concat("h", "sha")).otherwise(F.col("h")).alias("key")))
    totals = salted_totals(keyed, ["key"], salts, [F.count(F.lit(1)).alias("n"), pick("id").alias("k")],
                           [F.sum("n").alias("group_size"), pick("k").alias("keep_id")])
    return keyed.join(totals, on=["key", "salt"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
