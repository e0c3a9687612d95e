"""Mixing sources to target weights (native): a splitting tree over shards.

1. *Targets.*  Sources are ranked by code point, weigh 3, 1, 2 in turn and
   share ``share`` times all words; a target stops at ``cap`` times its
   source's words and the excess is shared anew by weight until none is
   above.  Each round is one aggregate over the small table of sources.
2. *Quotas.*  A target is a number of blocks of ``block_words`` words; the
   last block is cut so that the words taken equal the target, rounded.
3. *Splitting tree.*  The root holds the quotas of all sources.  A node
   deals its blocks to two children that take half of the shards each: the
   left child's blocks of each source are a multivariate hypergeometric
   draw, so every split is exact and as random as dealing single blocks.
   A draw inverts the distribution function by the ratio of neighbouring
   probabilities within 12 standard deviations of the mode; beyond lies
   less than a double can tell apart.
4. *Draw.*  A source's documents stand in the order of a hash: first 1,024
   hash ranges, then the hash inside a range, so that running word counts
   need no window over a whole source.  Twice in a row they form the
   source's stream of words; shard k takes the k-th run of blocks of it.
   Runs are disjoint, and no document is taken more than twice.
5. *Local shuffle.*  Pieces carry ``order_key``; a shard is sorted by it.

Defined results.  A null or empty text has size 0 and is taken 0 times.  A
null source is a source of its own, last in rank.  Rows that repeat count
each for themselves; their order among each other makes no difference.  An
empty table, or one without words, gives targets of 0.  Extra columns are
carried only when named in ``keep``.  Results depend on values only: runs
agree, also after lost executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import WORD_PATTERN, save, text_or_empty

BUCKETS = 1024
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns' values only."""
    bits = F.xxhash64(*columns).bitwiseAND(F.lit((1 << 52) - 1))
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def hypergeometric(pool: Column, marked: Column, draws: Column, u: Column) -> Column:
    """Of ``draws`` blocks out of ``pool``, how many are among the ``marked``:
    the quantile ``u`` of the hypergeometric distribution."""

    def bounds(x):
        n, k, d = x["pool"].cast("double"), x["marked"].cast("double"), x["draws"].cast("double")
        spread = F.sqrt(F.greatest(F.lit(0.0), d * (k / n) * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0))))
        mode = F.floor((d + 1) * (k + 1) / (n + 2))
        width = F.ceil(spread * 12) + 12
        return F.struct(
            x["pool"].alias("pool"), x["marked"].alias("marked"), x["draws"].alias("draws"), x["u"].alias("u"),
            F.greatest(F.lit(0), x["draws"] - (x["pool"] - x["marked"]), mode - width).cast("long").alias("lo"),
            F.least(x["draws"], x["marked"], mode + width).cast("long").alias("hi"))

    def quantile(x):
        def ratio(k):  # probability of k + 1 over that of k
            up = (x["marked"] - k).cast("double") * (x["draws"] - k).cast("double")
            return up / ((k + 1).cast("double") * (x["pool"] - x["marked"] - x["draws"] + k + 1).cast("double"))

        steps = F.when(x["hi"] > x["lo"], F.sequence(x["lo"], x["hi"] - 1)).otherwise(
            F.array().cast("array<bigint>"))
        total = F.aggregate(
            steps, F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum")),
            lambda s, k: _let(s["p"] * ratio(k), lambda p: F.struct(p.alias("p"), (s["sum"] + p).alias("sum"))))["sum"]
        return _let(total * x["u"], lambda aim: F.aggregate(
            steps, F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), x["lo"].alias("at")),
            lambda s, k: F.when(s["sum"] >= aim, s).otherwise(_let(s["p"] * ratio(k), lambda p: F.struct(
                p.alias("p"), (s["sum"] + p).alias("sum"), (k + 1).alias("at")))))["at"])

    start = F.struct(pool.alias("pool"), marked.alias("marked"), draws.alias("draws"), u.alias("u"))
    return F.when((marked <= 0) | (draws <= 0), F.lit(0).cast("long")).when(draws >= pool, marked).otherwise(
        _let(_let(start, bounds), quantile))


def _left_share(counts: Column, node: Column, draws: Column, seed: int) -> Column:
    """Multivariate hypergeometric draw of ``draws`` blocks out of ``counts``:
    source by source, from what the sources before it have left."""
    pool = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    places = F.transform(counts, lambda x, i: F.struct(x.alias("n"), i.alias("i")))

    def step(s, x):
        got = hypergeometric(s["pool"], x["n"], s["need"], _uniform(F.lit(seed), node, x["i"]))
        return _let(got, lambda g: F.struct((s["need"] - g).alias("need"), (s["pool"] - x["n"]).alias("pool"),
                                            F.concat(s["out"], F.array(g)).alias("out")))

    start = F.struct(draws.alias("need"), pool.alias("pool"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(places, start, step)["out"]


def splitting_tree(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(shard, rank, blocks): ``quotas`` (rank, blocks), dealt to ``n_shards``
    shards (a power of two) whose totals differ by one block at most."""
    node = quotas.groupBy().agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "blocks"))), lambda x: x["blocks"]).alias("counts"))
    node = node.select(F.lit(1).cast("long").alias("node"), "counts")
    for _ in range(n_shards.bit_length() - 1):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        draws = F.floor((total + F.col("node") % 2) / 2).cast("long")
        node = node.withColumn("left", _left_share(F.col("counts"), F.col("node"), draws, seed))
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        node = node.select(F.inline(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts")))))
    return node.select((F.col("node") - n_shards).alias("shard"), F.posexplode("counts").alias("rank", "blocks"))


def _ranked(sources: DataFrame, parts: int = 16) -> DataFrame:
    """Sources with ``rank`` by code point, null last: ranks inside ranges of
    the sorted sources plus the ranges' offsets, so no task sorts them all."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = save(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn("inside", inside).join(offsets, on="part").withColumn(
        "rank", (F.col("inside") + F.col("offset")).cast("int")).drop("part", "inside", "offset")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(skey, source, rank, weight, source_size, target) from (skey, source, size)."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = save(_ranked(sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size")))
                .withColumn("weight", weight.cast("long"))
                .withColumn("most", F.col("source_size") * F.lit(float(cap))), "source-weights")
    total = rows.agg((F.sum("source_size") * F.lit(float(share))).alias("all"), F.sum("weight").alias("w")).first()
    left, over, fixed = float(total["all"] or 0), float(total["w"] or 1), -1
    above = None
    while True:  # each round stops at least one more source at its cap
        above = F.col("most") * F.lit(over) < F.col("weight") * F.lit(left)
        got = rows.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, F.col("most"))).alias("most"),
                       F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if got["n"] == fixed or not got["w"]:
            break
        fixed, left, over = got["n"], float(total["all"] or 0) - float(got["most"] or 0), float(got["w"])
    target = F.when(above, F.col("most")).otherwise(F.col("weight") * F.lit(left) / F.lit(over))
    return rows.withColumn("target", target).drop("most")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                share: float = 1.5, cap: float = 2.0, n_shards: int = 64, block_words: int = 256, seed: int = 7,
                keep: Sequence[str] = ()) -> DataFrame:
    """(id, source, size, source_size, target, taken, pieces) + ``keep``, one row
    for each input row.  ``pieces``: which shard takes which of its words,
    as (shard, pass, from, to), words from 0, end exclusive."""
    if n_shards & (n_shards - 1):
        raise ValueError("n_shards must be a power of two")
    if cap > 2:
        raise ValueError("a source's words are offered twice, so cap is 2 at most")
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    perm = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = save(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s:"), source_col), F.lit("none")).alias("skey"),
        word_count(text_or_empty(text_col)).alias("size"), perm.alias("perm"),
        (F.shiftright(perm, 64 - 10) + BUCKETS // 2).cast("int").alias("bucket"), *kept), "mix-rows")
    sources = save(targets(rows, share, cap).withColumn("limit", F.round("target").cast("long"))
                   .withColumn("blocks", F.ceil(F.col("limit") / block_words).cast("long")), "mix-targets")
    dealt = splitting_tree(sources.select("rank", "blocks"), n_shards, seed)
    upto = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (dealt.withColumn("end", F.sum("blocks").over(upto)).groupBy("rank")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends")))
    runs = save(sources.join(ends, on="rank").select(
        "skey", "source_size", "target", "limit", F.concat(F.array(F.lit(0).cast("long")), F.transform(
            "ends", lambda e: F.least(e * block_words, F.col("limit")))).alias("cuts")), "mix-runs")

    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("n")).select(
        "skey", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    inside = (Window.partitionBy("skey", "bucket").orderBy("perm", "id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(buckets, on=["skey", "bucket"]).join(runs, on="skey"))

    def shard_at(place):  # the last shard whose run starts at ``place`` or before
        halves = F.array(*[F.lit(n_shards >> i) for i in range(1, n_shards.bit_length())] or [F.lit(0)])
        return F.aggregate(halves, F.lit(0), lambda at, h: F.when(
            F.element_at("cuts", at + h + 1) <= place, at + h).otherwise(at))

    def pieces(turn: int) -> Column:
        start = F.col("before") + F.col("ahead") + F.lit(turn) * F.col("source_size")
        end = F.least(start + F.col("size"), F.col("limit"))
        cut = F.transform(F.sequence(shard_at(start), shard_at(end - 1)), lambda k: F.struct(
            k.alias("shard"), F.lit(turn).alias("pass"),
            (F.greatest(F.element_at("cuts", k + 1), start) - start).alias("from"),
            (F.least(F.element_at("cuts", k + 2), end) - start).alias("to")))
        none = F.array().cast("array<struct<shard:int,pass:int,from:bigint,to:bigint>>")
        return F.when(end > start, F.filter(cut, lambda x: x["to"] > x["from"])).otherwise(none)

    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return placed.withColumn("pieces", F.concat(pieces(0), pieces(1))).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), "pieces",
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def draw(plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 64,
         seed: int = 7) -> DataFrame:
    """The mix itself, from a plan that kept ``text_col``: one row for each piece,
    its words joined by one space, each shard in one partition, locally shuffled."""
    piece = plan.select(F.col(id_col), "source", F.col(text_col), F.explode("pieces").alias("p"))
    whole = F.regexp_extract_all(F.col(text_col), F.lit(WORD_PATTERN), F.lit(0))
    words = F.array_join(F.slice(whole, (F.col("p.from") + 1).cast("int"), (F.col("p.to") - F.col("p.from")).cast("int")), " ")
    order_key = F.xxhash64(F.lit(seed), F.col("p.shard"), F.col(id_col), F.col("p.pass"), F.col("p.from"))
    return (piece.select(F.col("p.shard").alias("shard"), order_key.alias("order_key"), id_col, "source",
                         F.col("p.pass").alias("pass"), (F.col("p.to") - F.col("p.from")).alias("n_words"),
                         words.alias(text_col))
            .repartition(n_shards, "shard").sortWithinPartitions("shard", "order_key"))



def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_shards: int = 64,
        **settings) -> DataFrame:
    """``mix_sources`` and ``draw`` in one: the plan is made of ids and sizes alone, and
    each text is joined to its pieces once.  Rows that repeat id and text have one
    text and are planned each."""
    row = F.xxhash64(id_col, text_col)
    plan = mix_sources(docs.withColumn("__row", row), id_col, text_col, source_col, n_shards=n_shards, keep=("__row",), **settings)
    texts = docs.select(row.alias("__row"), text_col).dropDuplicates(["__row"])
    return draw(plan.where(F.size("pieces") > 0).join(texts, on="__row"), id_col, text_col, n_shards)


def shards_for(total: int, each: int, least: int = 64) -> int:
    """A power of two of shards that hold about ``each`` of ``total`` (at least ``least`` shards)."""
    return max(least, 1 << max(0, -(-total // each) - 1).bit_length())
