"""MinHash near-dedup with DartMinHash signatures.

A document is the weighted set of its five-word shingles, weighed by how
often they occur.  Copy c of a shingle is a unit region at which darts are
thrown: the region's hash gives them as a Poisson process, each with a rank
(its arrival) and a coordinate.  A document of total weight W looks at
ranks up to t / W only, with t = k ln k + 2 k, so it sees about t darts
whatever its length; the earliest dart of each coordinate is the
signature.  Coordinates that stay empty are thrown again up to twice the
rank.  Two documents agree in a coordinate with the probability of their
weighted Jaccard similarity, the sum of the smaller weights over that of the
larger ones.

1. One pass makes a row for each text: bands of ``rows`` coordinates as
   64-bit keys, the coordinates themselves in 7 bits each, the number of
   shingles, a 128-bit hash of the words.  Texts with the same words are one
   node from here on.
2. Band buckets, some bands at a time: every node is paired with its bucket's
   smallest node, the hub, unless earlier bands have connected the two.  Pairs
   go whose sizes exclude the similarity, or whose coordinates agree so seldom
   that it is more than five standard deviations away.  The others are read
   and compared exactly, all their shingles.
3. Verified pairs form components.  A link that is found later counts as one of two
   components, so those of a wave are gone through once, and copies, which only
   take their node's component, not at all.  Where nodes of one bucket are still in
   different components, those are compared inside the join, by these
   coordinates and by sixteen times as many that are made for such nodes
   alone, and exactly where both agree: a link between different texts of a
   bucket is only left out when they are connected anyway.  A group of n
   copies of one text thus costs about n pairs, not n * n.
4. One document of each component stays, the one with the smallest id.

Defined results.  Texts without words (null, empty, white space) are equal
to each other and form one class.  A text of fewer than five words is one
shingle.  A row is known by its id and text: rows that share an id but not
the text are different documents, rows that repeat both are one (``kept`` is
true for each, and ``keep_one`` leaves one).  Null ids come last: a class of
null ids alone keeps the text with the least hash and has a null class_id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import connected_components, label_links, maybe_among, relabelled, salt, salted_totals, save, scratch, sieve
from textlake.llm.words import Texts, bounded_batches, lists, mix, range_hash, signed, slices, windows

U = np.uint64


def shingles(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every shingle; a shorter text is one shingle."""
    hashes = texts.word_hashes()
    at = windows(texts, size)
    n = np.full(len(at), size)
    less = np.flatnonzero((texts.counts > 0) & (texts.counts < size))
    at, n = np.concatenate([at, texts.first[less]]), np.concatenate([n, texts.counts[less]])
    row = np.searchsorted(texts.first, at, "right") - 1
    return row, range_hash(hashes, at, at + n)


def regions(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit regions: equal shingles of a text are told apart by copy number."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero(new)
    copy = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    return row, mix(key + copy.astype(U) * U(0x9E3779B97F4A7C15), 3)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(row: np.ndarray, region: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """(n_texts, k) darts, 0 for texts without regions."""
    weight = np.bincount(row, minlength=n_texts)
    limit = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    out = np.zeros((n_texts, k), U)
    todo = weight > 0
    while todo.any():
        best, dart_of = np.full(n_texts * k, np.inf), []
        mine = np.flatnonzero(todo[row])
        at, key, rank, n = row[mine], region[mine], np.zeros(len(mine)), 0
        while len(at):  # the n-th dart of every region that has one up to the limit
            dart = mix(key, 2 * n + 5)
            rank = rank - np.log(_unit(mix(key, 2 * n + 6)))
            near = rank <= limit[at]
            at, key, rank, dart, n = at[near], key[near], rank[near], dart[near], n + 1
            slot = at * k + (dart % U(k)).astype(np.int64)
            np.minimum.at(best, slot, rank)
            dart_of.append((slot, rank, dart))
        flat = out.reshape(-1)
        for slot, rank, dart in dart_of:
            won = rank == best[slot]
            flat[slot[won]] = dart[won]
        full = np.isfinite(best).reshape(n_texts, k).all(axis=1)
        todo &= ~full
        limit = limit * 2
    return out


def _emit(size: int, bands: int, rows: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column("text"), most_texts=2000):
                n = len(texts)
                row, key = shingles(texts, size)
                row, region = regions(row, key)
                darts = signatures(row, region, n, bands * rows).reshape(n * bands, rows)
                band = np.tile(np.arange(bands, dtype=U), n)
                keys = mix(band + range_hash(darts.reshape(-1), np.arange(0, n * bands * rows, rows),
                                             np.arange(rows, n * bands * rows + rows, rows)), 7)
                hashes = texts.word_hashes()
                whole = [signed(range_hash(hashes, texts.first[:-1], texts.first[1:], i)) for i in (0, 1)]
                weight = np.bincount(row, minlength=n)
                some = weight > 0
                keys = keys.reshape(n, bands)[some].reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(start, n), *map(pa.array, whole), pa.array(weight.astype(np.int64)),
                     lists(pa.array(signed(keys)), some * bands), packed(darts.reshape(n, bands * rows))],
                    names=["node", "w1", "w2", "weight", "bands", "sketch"])
    return emit


PER_LONG = 9  # coordinates of 7 bits in a long


def packed(darts: np.ndarray) -> pa.ListArray:
    """Each row's coordinates in 7 bits, nine to a long; the last long is filled with zeros."""
    n, k = darts.shape
    longs = -(-k // PER_LONG)
    few = np.zeros((n, longs * PER_LONG), U)
    few[:, :k] = mix(darts, 11) & U(0x7F)
    shift = np.arange(PER_LONG, dtype=U) * U(7)
    values = (few.reshape(n * longs, PER_LONG) << shift).sum(axis=1, dtype=U)
    return lists(pa.array(signed(values)), np.full(n, longs))


def agreeing(a: str, b: str, k: int) -> Column:
    """How many of ``k`` packed coordinates of two sketches are equal."""
    low, high = (sum(m << 7 * i for i in range(PER_LONG)) for m in (0x3F, 0x40))
    longs = -(-k // PER_LONG)
    total = F.lit(PER_LONG * longs - (longs * PER_LONG - k))
    for i in range(longs):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        filled = (x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(high))  # a bit for each that differs
        total = total - F.bit_count(filled)
    return total


def agreeing_folded(a: str, b: str, k: int) -> Column:
    """``agreeing`` as a fold, for long sketches."""
    low, high = (sum(m << 7 * i for i in range(PER_LONG)) for m in (0x3F, 0x40))
    differ = F.zip_with(a, b, lambda p, q: F.bit_count((p.bitwiseXOR(q).bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(
        p.bitwiseXOR(q)).bitwiseAND(F.lit(high))))
    return F.lit(k) - F.aggregate(differ, F.lit(0), lambda n, x: n + x)


def needed(k: int, least: float) -> int:
    """Agreeing coordinates that texts of similarity ``least`` reach but for one case in ten million."""
    return max(0, int(k * least - 5.3 * (k * least * (1 - least)) ** 0.5))


def _emit_fine(size: int, k: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column("text"), most_texts=64):
                darts = signatures(*regions(*shingles(texts, size)), len(texts), k)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(start, len(texts)), packed(darts)], names=["node", "fine"])
    return emit


def some_texts(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given nodes, one row each.  What surely is none of
    them goes where it is read, so the shuffle carries few other texts."""
    return sieve(texts, "node", nodes, "node").join(nodes, on="node", how="left_semi").groupBy("node").agg(F.first("text").alias("text"))


def _compare(size: int, least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column("u"), batch.column("v")
            both = pa.chunked_array([batch.column("text_u"), batch.column("text_v")]).combine_chunks()
            n = batch.num_rows
            rows, keys = [], []
            for start, texts in slices(both):
                row, key = regions(*shingles(texts, size))
                rows.append(start + row)
                keys.append(key)
            row, key = np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, U), *keys])
            weight = np.bincount(row, minlength=2 * n)
            order = np.lexsort((key, row % max(n, 1)))  # a pair's regions side by side; shared ones are twins
            row, key = row[order] % max(n, 1), key[order]
            twin = np.flatnonzero((row[1:] == row[:-1]) & (key[1:] == key[:-1]))
            shared = np.bincount(row[twin], minlength=n)
            keep = pa.array(shared >= least * (weight[:n] + weight[n:] - shared))
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], names=["u", "v"])
    return compare


def verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (u, v) whose texts are similar.  Texts of the nodes in pairs are
    written once; from both written tables Spark splits a node that is in very many pairs."""
    pairs = save(pairs, "pairs")
    nodes = save(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "pair-nodes")
    texts = save(some_texts(texts, nodes), "pair-texts")
    of_u, of_v = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "uv")
    return save(pairs.join(of_u, on="u").join(of_v, on="v").select("u", "v", "text_u", "text_v")
                .mapInArrow(_compare(size, least), "u bigint, v bigint"), "links")


def waves(bands: int) -> list[tuple[int, int]]:
    """Bands from and to of each wave: few at first, when most pairs are still apart."""
    cuts = sorted({0, min(4, bands), bands})
    return list(zip(cuts, cuts[1:], strict=False))


#: Hubs of a bucket at a time, and how often new ones are taken, once all bands had their first.
HUBS, DEALS = 2, 2


def led_pairs(members: DataFrame, orders: list[Column]) -> DataFrame:
    """(u, v, a, b): the members (band, node, component) with those of other components that come first
    in their bucket by one of ``orders``, structs that end in node and component."""
    leads = members.groupBy("band").agg(F.array(*[F.struct(F.min(o)["node"].alias("node"), F.min(o)["component"].alias("component"))
                                                       for o in orders]).alias("leads"), F.max("component").alias("hi"),
                                        F.min("component").alias("lo")).where("lo != hi").select("band", "leads")
    met = members.join(leads, on="band").select("node", "component", F.explode("leads").alias("lead")).where("component != lead.component")
    return met.select(F.greatest("node", "lead.node").alias("u"), F.least("node", "lead.node").alias("v"),
                      F.greatest("component", "lead.component").alias("a"), F.least("component", "lead.component").alias("b")).distinct()


def open_buckets(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(band, node, component): the members (band, node) of buckets that hold several components."""
    parts = save(members.join(linked, on="node", how="left").select("band", "node", F.coalesce("component", "node").alias("component")), "parts")
    torn = save(parts.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("band"), "torn")
    return save(parts.join(torn, on="band", how="left_semi").select("band", "node", "component"), "open-buckets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8,
                    bands: int = 24, rows: int = 6, salts: int = 64) -> DataFrame:
    """(id, class_id, class_size, kept), one row for each input row.  ``class_id``
    is the smallest id of the class.  ``size``: words of a shingle; ``least``:
    similarity; two texts of that similarity share a bucket with a
    probability of 1 - (1 - least ** rows) ** bands (0.9993 by default)."""
    bounded_batches(docs.sparkSession)
    with scratch() as kept:
        classed = _classed(docs, id_col, text_col, size, least, bands, rows, salts)
        kept.append(classed)
    lead = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    totals = salted_totals(classed, ["component"], salts, [F.min(lead).alias("lead"), F.count(F.lit(1)).alias("n")],
                           [F.min("lead").alias("lead"), F.sum("n").alias("class_size")])
    return classed.join(totals, on=["component", "salt"]).select(
        F.col("id").alias(id_col), F.col("lead.id").alias("class_id"), "class_size", (F.col("node") == F.col("lead.node")).alias("kept"), "node")


def _classed(docs: DataFrame, id_col: str, text_col: str, size: int, least: float, bands: int, rows: int, salts: int) -> DataFrame:
    """(id, node, component, salt) of each input row."""
    node = F.xxhash64(id_col, text_col)
    texts = docs.select(node.alias("node"), F.col(text_col).alias("text"))
    k = bands * rows
    marked = save(texts.mapInArrow(_emit(size, bands, rows), "node bigint, w1 bigint, w2 bigint, weight bigint, "
                                   "bands array<bigint>, sketch array<bigint>"), "signatures")
    keyed = marked.select("node", "w1", "w2", salt("node", salts=salts).alias("salt"))
    same = salted_totals(keyed, ["w1", "w2"], salts, [F.min("node").alias("rep")], [F.min("rep").alias("rep")])
    copies = save(keyed.join(same, on=["w1", "w2", "salt"]).select(F.col("node").alias("u"), F.col("rep").alias("v"))
                  .where("u != v").distinct(), "copies")
    # one node for each sequence of words goes to the buckets
    flagged = maybe_among(marked, "node", copies, "u", "maybe")
    reps = flagged.where(~F.col("maybe")).unionByName(
        flagged.where("maybe").join(copies.select(F.col("u").alias("node")).distinct(), on="node", how="left_anti"))
    members = save(reps.select(F.posexplode("bands").alias("at", "band"), "node"), "buckets")
    shared = save(members.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n"))
                  .where("lo != last").select("band", "n"), "shared")
    members = save(sieve(members, "band", shared, "band").join(shared, on="band").select("at", "band", "node", "n"), "shared-buckets")
    nodes = save(members.select("node").distinct(), "bucket-nodes")
    sketches = save(sieve(marked, "node", nodes, "node").join(nodes, on="node", how="left_semi")
                    .select("node", "weight", "sketch", "bands").dropDuplicates(["node"]), "bucket-sketches")
    u, v = (sketches.select(F.col("node").alias(c), F.col("weight").alias(f"weight_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "uv")
    alike = (F.least("weight_u", "weight_v") >= F.greatest("weight_u", "weight_v") * least) & (
        agreeing("sketch_u", "sketch_v", k) >= needed(k, least))
    # some bands at a time: what one wave joined makes no more pairs in the next
    linked, tried = copies.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0), None
    for start, end in waves(bands):
        some = members.where((F.col("at") >= start) & (F.col("at") < end)).join(linked, on="node", how="left").withColumn(
            "component", F.coalesce("component", "node"))
        some = save(some.select("band", "node", "component"), "wave")
        pairs = led_pairs(some, [F.struct("node", "component")])
        pairs = save(pairs if tried is None else pairs.join(tried, on=["u", "v"], how="left_anti"), "wave-pairs")
        tried = pairs.select("u", "v") if tried is None else tried.unionByName(pairs.select("u", "v"))
        found = verified(pairs.join(u, on="u").join(v, on="v").where(alike).select("u", "v"), texts, size, least)
        linked = relabelled(linked, connected_components(label_links(found, pairs)))
    # buckets that still hold several components get other hubs while these link any
    rest = open_buckets(members.where("n > 2"), linked)
    for deal in range(DEALS):
        pairs = led_pairs(rest, [F.struct(F.xxhash64("node", F.lit(deal * HUBS + i)).alias("h"), "node", "component") for i in range(HUBS)])
        pairs = save(pairs.join(tried, on=["u", "v"], how="left_anti").join(u, on="u").join(v, on="v").where(alike).select("u", "v", "a", "b"),
                     "hub-pairs")
        tried = tried.unionByName(pairs.select("u", "v"))
        found = verified(pairs.select("u", "v"), texts, size, least)
        if not found.limit(1).count():
            break
        linked = relabelled(linked, connected_components(label_links(found, pairs)))
        rest = open_buckets(rest.select("band", "node"), linked)
    # then their nodes are compared across components
    nodes = save(rest.select("node").distinct(), "open-nodes")
    fine = save(some_texts(texts, nodes).mapInArrow(_emit_fine(size, 16 * k), "node bigint, fine array<bigint>").join(sketches, on="node"),
                "open-sketches")
    rest = rest.join(fine, on="node")
    columns = ("node", "component", "weight", "sketch", "bands", "fine")
    a, b = (rest.select("band", *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "uv")
    once = F.array_min(F.array_intersect("bands_u", "bands_v")) == a["band"]  # in the first of the buckets that both are in
    across = a.join(b, (a["band"] == b["band"]) & (F.col("node_u") < F.col("node_v")) & (F.col("component_u") != F.col("component_v"))
                    & alike & once & (agreeing_folded("fine_u", "fine_v", 16 * k) >= needed(16 * k, least)))
    across = save(across.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"), F.col("component_u").alias("a"),
                                F.col("component_v").alias("b")).distinct()
                  .withColumns({"u": F.greatest("u", "v"), "v": F.least("u", "v")}).join(tried, on=["u", "v"], how="left_anti"), "across")
    more = verified(across.select("u", "v"), texts, size, least)
    linked = relabelled(linked, connected_components(label_links(more, across)))
    groups = relabelled(copies.select(F.col("u").alias("node"), F.col("v").alias("component")), linked)
    out = docs.select(F.col(id_col).cast("long").alias("id"), node.alias("node"))
    classed = out.join(groups, on="node", how="left").withColumn("component", F.coalesce("component", "node"))
    return save(classed.withColumn("salt", salt("node", salts=salts)), "classes")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each class, with all their columns.

    Rows of one class share the staying id; of rows that repeat it, one stays:
    the smallest by its values."""
    node = F.xxhash64(id_col, text_col)
    stays = classes.where("kept").select(F.col("node").alias("__node")).distinct()
    kept = docs.withColumn("__node", node).join(stays, on="__node", how="left_semi")
    first = Window.partitionBy("__node").orderBy(*[c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    return kept.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*docs.columns)
