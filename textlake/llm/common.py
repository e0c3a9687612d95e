"""Helpers shared by the operators: reads, intermediate tables, skewed joins,
connected components.

Intermediate tables are written under the shared folder that the session's
``spark.checkpoint.dir`` names, which also cuts the lineage: after a lost
executor Spark reads them again instead of repeating the work above them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.session import shared_dir
from textlake.sources.tables import table_path

#: White space of the contracts' words: ``[\\x20\\x09-\\x0D]``.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table, pruned to ``columns``; no rows are dealt anew."""
    return spark.read.parquet(table_path(sf_dir, name)).select(*columns)


#: Spark's own setting to delete a query's shuffle files when it ends; what is written
#: needs them no more, and without it they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared checkpoint folder and read it back.
    The shuffle files of the write go when it ends; the session's setting is put back."""
    spark = df.sparkSession
    path, before = shared_dir(spark, "llm", name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    if _scratch:
        _scratch[-1].append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes what ``save`` wrote in the block at its end, but for the tables that are put
    into the given list: those that a result still reads."""
    kept: list[DataFrame] = []
    _scratch.append([])
    try:
        yield kept
    finally:
        drop(*[df for df in _scratch.pop() if all(df is not k for k in kept)])
        if _scratch:
            _scratch[-1].extend(kept)


def drop(*saved: DataFrame) -> None:
    """Delete the folders of tables of ``save`` that nothing reads any more."""
    for df in saved:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hashed_bits(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitset of ``bits`` bits (a power of two) with the last bits of a hashed
    bigint column set.  At most bits / 64 numbers reach the driver, whatever
    the rows.  Tasks use it to drop what surely has no partner; where data
    outgrow it, it drops less and results stay the same."""
    bit = F.col(column).bitwiseAND(F.lit(bits - 1))
    cells = df.groupBy(F.shiftright(bit, 6).alias("cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")).alias("set")).collect()
    known = np.zeros(bits // 64, np.int64)
    for cell in cells:
        known[cell["cell"]] = cell["set"]
    return known.view(np.uint64)


def has_bit(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    bit = key & np.uint64(len(known) * 64 - 1)
    return (known[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


SIEVE_BITS = 1 << 22


def maybe_among(df: DataFrame, column: str, keys: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` with the boolean ``out``: false where ``column`` surely is none of
    ``keys``.  Both are bigints; a bitset of fixed size stands for the keys (at
    most 65,536 rows of 16 bytes are broadcast, however many keys there are)."""
    bit = lambda c: F.col(c).bitwiseAND(F.lit(SIEVE_BITS - 1))
    cells = keys.groupBy(F.shiftright(bit(key), 6).alias("__cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))")).alias("__set"))
    hit = F.expr(f"coalesce((shiftright(__set, cast(`{column}` & 63 as int)) & 1) = 1, false)")
    return (df.withColumn("__cell", F.shiftright(bit(column), 6)).join(F.broadcast(cells), on="__cell", how="left")
            .withColumn(out, hit).drop("__cell", "__set"))


def sieve(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``keys``."""
    return maybe_among(df, column, keys, key, "__maybe").where("__maybe").drop("__maybe")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def salt(*columns: str | Column, salts: int) -> Column:
    """A salt in 0..salts-1 that depends on the row's values only, so a task
    that runs again deals its rows alike."""
    return F.pmod(F.xxhash64(*columns, F.lit("salt")), F.lit(salts)).cast("int")


def salted_totals(df: DataFrame, key: Sequence[str], salts: int, aggs: Sequence[Column],
                  merges: Sequence[Column], salt_col: str = "salt") -> DataFrame:
    """Per (key, salt) the totals of the whole key, for joining back to ``df``.

    ``df`` carries ``salt_col``.  First (key, salt) is aggregated, then key;
    the key's totals are joined to its (key, salt) rows, of which a key has
    at most ``salts``.  A group with a third of all rows thus meets its
    totals in ``salts`` separate partitions, and no task holds the group.
    """
    part = df.groupBy(*key, salt_col).agg(*aggs)
    whole = part.groupBy(*key).agg(*merges)
    return part.select(*key, salt_col).join(whole, on=list(key))


def first_rows(rows: DataFrame, order: Sequence[Column], place: Column, n: int) -> DataFrame:
    """The first ``n`` rows by ``order``.  ``place`` runs from 0 to 1, evenly over the
    rows, and never falls along the order (a hash that the order begins with).

    Rows beyond the share that should hold the first ``n`` are dropped before
    they are sorted, so what meets in one task doesn't grow with the number
    of partitions; where the share held too few, a larger one is taken.
    """
    share = (n + 8 * n**0.5 + 32) / max(rows.count(), 1)
    while share < 1:
        some = rows.where(place < share)
        if some.count() >= n:
            return some.orderBy(*order).limit(n)
        share *= 8
    return rows.orderBy(*order).limit(n)


def connected_components(edges: DataFrame, max_rounds: int = 60, salts: int = 8) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v) reaches.

    Each round takes the smallest label among a node's neighbours and then
    jumps to that label's own label, so paths shorten exponentially.  Labels
    stay on the cluster; a round's table is written to the shared folder,
    and the driver only sees the number of changed rows.  A hub with very
    many neighbours is aggregated map-side and joined with salts.
    """
    spark = edges.sparkSession
    both = save(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
                .where(F.col("u") != F.col("v")).distinct()
                .withColumn("salt", salt("u", salts=salts)), "edges")
    labels = saved = save(both.groupBy(F.col("u").alias("node"))
                          .agg(F.min("v").alias("low"))
                          .select("node", F.least("node", "low").alias("component")), "labels")
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    for _ in range(max_rounds):
        wide = labels.select(F.col("node").alias("v"), "component", spread.alias("salt"))
        low = (both.join(wide, on=["v", "salt"]).groupBy(F.col("u").alias("node"))
               .agg(F.min("component").alias("low")))
        near = labels.join(low, on="node", how="left").select(
            "node", F.col("component").alias("old"), F.least("component", "low").alias("mid"),
            salt("node", salts=salts).alias("salt"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"),
                             spread.alias("salt"))
        step = near.join(jump, on=["mid", "salt"], how="left").select(
            "node", "old", F.least("mid", "far").alias("component"))
        step = save(step, "labels")
        changed = step.where(F.col("old") != F.col("component")).limit(1).count()
        drop(saved)
        labels, saved = step.select("node", "component"), step
        if not changed:
            drop(both)
            return labels
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def label_links(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v) of the labels ``a`` and ``b`` that ``links`` (u, v), some of ``pairs`` (u, v, a, b), connect."""
    return links.join(pairs, on=["u", "v"]).select(F.col("a").alias("u"), F.col("b").alias("v"))


def relabelled(groups: DataFrame, merged: DataFrame, salts: int = 8) -> DataFrame:
    """``groups`` (node, component) after ``merged`` (node, component), the components of links
    between labels of ``groups`` and nodes that stood alone.  Links of earlier rounds are
    thus not gone through again; a label of very many nodes is joined with salts."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    whole = merged.select(F.col("node").alias("component"), F.col("component").alias("whole"), spread.alias("salt"))
    old = (groups.select("node", "component", salt("node", salts=salts).alias("salt")).join(whole, on=["component", "salt"], how="left")
           .select("node", F.coalesce("whole", "component").alias("component")))
    alone = merged.join(groups, on="node", how="left_anti").select("node", "component")
    return save(old.unionByName(alone), "groups")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
