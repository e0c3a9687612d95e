"""Line dedup (native): fuzzy lines by SimHash, pigeonhole blocks and edit similarity.

1. *Lines.*  Texts are cut at line feeds; a line is normalised to lower case
   with blanks for everything but letters (a to z and signs beyond ASCII), so
   digits and marks make no difference.  Equal lines are grouped by a
   128-bit hash; a line without words, of digits or marks, by the hash of the raw
   line.  Lines of fewer than ``min_words`` words stay as they are.  With 0, as the
   query and the pipeline have it, all lines but blank ones are grouped.
2. *SimHash.*  Each line gets 126 bits: the signs of sums over its words' hashes, 63
   to a long.  The bits lie in blocks of five; a key is four blocks and one word of
   the line, the first, the last or that with the least hash, so lines that differ
   in few bits share some of the keys (``KEY_COUNTS``: more for short lines, in
   which an edit turns more bits).
3. *Buckets.*  A few keys go first, then, of lines that these left in different
   components, the others.  Of a key with two or three lines all pairs are looked at.
   Fuller buckets are dealt by hash into parts of some lines, and each line is
   paired with its part's first; so a bucket of n lines costs n pairs.  After the
   first keys, whose links tie most groups together, that is for buckets of more than
   ``CROWD`` lines: in others, most of whose lines just happen to share a key, all lines of
   different components meet at once.  While a
   large bucket's lines lie in different components and links are still found,
   the lines are dealt anew; at last what is left of different components, in
   all such buckets, is compared and one link of two components goes on.
4. *Edit similarity.*  256 bits, each the parity of some words, differ in at
   most two for an edit; pairs that differ in more, or in length, are dropped.
   The rest are read again and compared:
   1 - edits / length of the longer line, in words, at least ``least``.
5. *Components.*  Of a connected group the first occurrence stays, by id and
   line number; the others are marked.

SimHash finds similar lines with a probability that falls with their edits; README
has the shares found of all pairs by length.  Equal lines are always found.

Defined results.  A null text counts as empty, one blank line; blank lines always stay.
Words are parted by blanks, so a line in a script without them is one word and
only found when equal.  Rows
with equal id and text are the same document: their lines stay or go alike.
A null id comes before all others.  Lines without enough words stay and are
classes of their own.  Lines of a million words and more are only found when equal.  An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import connected_components, drop, label_links, maybe_among, relabelled, save, scratch, sieve, text_or_empty

#: Longs of parity bits a line, and what tells whether two lines may be near.
PARITY = 4
MARKS = ("n", *[f"p{j}" for j in range(PARITY)])
#: SimHash: three counters of 21 bits to a long, each counts the words that have a bit.
WIDTH, LANES = 21, 1 | 1 << 21 | 1 << 42
BITS = 2 * 3 * WIDTH
#: Bits of a block, and blocks of a key.
BLOCK, BLOCKS = 5, 4
#: Lines of a part of a full bucket, how often larger ones are dealt at a time, and how often anew.
PART, DEALS, WAVES = 16, 2, 2
#: Lines of a full bucket up to which, after the first keys, all of different components meet.
CROWD = 256


def normalised(line: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[\\x00-`{-\\x7f]+", " "))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(id_col, text_col).alias("th"),
        F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("line", "raw"))


def line_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, line, h1, h2, first, last, n, low, p0.., sim0, sim1): every line with its hash,
    hashes of its first, last and least word, words (-1 for a blank line), parity bits and SimHash."""
    lines = lines_of(docs, id_col, text_col).select("id", "th", "line", normalised("raw").alias("norm"), "raw")
    # letters and other signs never meet: a normalised line has the ones, a raw line without words the others
    known = F.when(F.col("norm") != "", F.col("norm")).otherwise(F.col("raw"))
    none = F.when(F.col("raw").rlike("[^\\x00-\\x20\\x7f]"), 0).otherwise(-1).cast("long")
    lines = lines.select("id", "th", "line", F.xxhash64(known).alias("h1"), F.xxhash64(F.lit(1), known).alias("h2"), "norm", none.alias("none"),
                         F.xxhash64(F.substring_index("norm", " ", 1)).alias("first"), F.xxhash64(F.substring_index("norm", " ", -1)).alias("last"))
    key = ["id", "th", "line", "h1", "h2", "first", "last"]
    words = lines.select(*key, F.explode(F.split("norm", " ")).alias("word"), "none")
    words = words.select(*key, F.xxhash64("word").alias("w"), F.xxhash64(F.lit(2), "word").alias("w0"), F.xxhash64(F.lit(3), "word").alias("w1"),
                         F.when(F.col("word") != "", F.lit(1).cast("long")).otherwise(F.col("none")).alias("one"))
    bit = F.expr("shiftleft(1L, cast(w & 63 as int))")
    lane = F.shiftright("w", 6).bitwiseAND(F.lit(PARITY - 1))
    parity = [F.bit_xor(F.when(lane == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{j}") for j in range(PARITY)]
    counters = [F.try_sum(F.shiftrightunsigned(f"w{k}", j).bitwiseAND(F.lit(LANES))).alias(f"s{k}_{j}") for k in (0, 1) for j in range(WIDTH)]
    counted = words.groupBy(*key).agg(F.sum("one").alias("n"), F.min("w").alias("low"), *parity, *counters)
    return counted.select(*key, "n", "low", *[f"p{j}" for j in range(PARITY)], *[simhash(k).alias(f"sim{k}") for k in (0, 1)])


def simhash(k: int) -> Column:
    """63 bits from 21 longs of three counters: set where more than half of the line's
    words have the bit.  The counters of a long are compared at once: twice a
    counter, less the words, moves its highest bit."""
    half = 1 << (WIDTH - 1)
    more = F.lit(LANES) * (F.lit(half - 1) - F.col("n"))
    bits = [F.shiftleft(F.shiftright(F.col(f"s{k}_{j}") * 2 + more, WIDTH - 1).bitwiseAND(F.lit(LANES)), j) for j in range(WIDTH)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return F.when((F.col("n") > 0) & (F.col("n") < half), out).otherwise(F.lit(0).cast("long"))


def key_masks(count: int) -> list[tuple[int, int]]:
    """Masks over the two longs of a SimHash, one pair for each key: ``BLOCKS`` blocks of its bits."""
    r, out = random.Random(7), []
    for _ in range(count):
        bits = sum(((1 << BLOCK) - 1) << BLOCK * b for b in r.sample(range(BITS // BLOCK), BLOCKS))
        out.append((bits & (1 << BITS // 2) - 1, bits >> BITS // 2))
    return out


#: (words, keys): lines of fewer words have so many keys.
KEY_COUNTS = ((20, 84), (50, 48), (None, 24))
#: Keys from and to of each wave: few at first, when most similar lines are still apart.
KEY_WAVES = ((0, 4), (4, 84))
#: Keys of a line that are joined at a time, so that few of them lie on disk.
AT_A_TIME = 12


def line_keys(start: int = 0, end: int | None = None) -> Column:
    """The keys of a line, as many as its length asks for, of those from ``start`` to ``end``."""
    most = max(count for _, count in KEY_COUNTS)
    masks, end = key_masks(most), most if end is None else end
    keys = [F.xxhash64(F.lit(t), F.col("sim0").bitwiseAND(F.lit(a)), F.col("sim1").bitwiseAND(F.lit(b)), F.col(("first", "last", "low")[t % 3]))
            for t, (a, b) in enumerate(masks)][start:end]
    count = F.lit(KEY_COUNTS[-1][1])
    for words, more in reversed(KEY_COUNTS[:-1]):
        count = F.when(F.col("n") < words, more).otherwise(count)
    return F.slice(F.array(*keys), F.lit(1), F.greatest(F.lit(0), F.least(F.lit(len(keys)), count - start)))


def bit_gap(a: str, b: str) -> Column:
    """Parity bits in which two lines differ; ``a`` and ``b`` end the columns' names."""
    return sum((F.bit_count(F.col(f"p{j}{a}").bitwiseXOR(F.col(f"p{j}{b}"))) for j in range(PARITY)), F.lit(0))


def may_be_near(least: float, a: str = "_u", b: str = "_v") -> Column:
    """False where lengths or parity bits rule the similarity out."""
    most = F.floor(F.greatest(f"n{a}", f"n{b}") * F.lit(1 - least) + F.lit(1e-9))
    return (F.abs(F.col(f"n{a}") - F.col(f"n{b}")) <= most) & (bit_gap(a, b) <= 2 * most)


def bucket_pairs(info: DataFrame, start: int = 0, end: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((u, v) of buckets of two and three, members (key, node, component, size) of fuller ones) of the keys from ``start``
    to ``end``, some at a time.  Buckets whose lines are all of one ``component`` of ``info``, if it says, are left out."""
    pairs, inside = [], []
    end = max(count for _, count in KEY_COUNTS) if end is None else end
    grouped = "component" in info.columns
    whole = Window.partitionBy("key")
    for at in range(start, end, AT_A_TIME):
        members = info.select("node", F.col("component" if grouped else "node").alias("component"),
                              F.explode(line_keys(at, min(at + AT_A_TIME, end))).alias("key"))
        sized = members.select("key", "node", "component", F.count(F.lit(1)).over(whole).alias("size"),
                               F.min("component").over(whole).alias("low"), F.max("component").over(whole).alias("high"))
        buckets = save(sized.where("size > 1 AND low != high").drop("low", "high"), "line-buckets")
        few = buckets.where("size <= 3").groupBy("key").agg(F.first("size").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi"),
                                                            F.bit_xor("node").alias("all"))
        third = F.col("all").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
        pair = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
        pairs.append(save(few.select(F.explode(F.when(F.col("size") == 2, F.array(pair(F.col("lo"), F.col("hi")))).otherwise(
            F.array(pair(F.col("lo"), F.col("hi")), pair(F.col("lo"), third), pair(third, F.col("hi"))))).alias("p")).select("p.u", "p.v"), "few-pairs"))
        inside.append(save(buckets.where("size > 3"), "full-buckets"))
        drop(buckets)
    return reduce(DataFrame.unionByName, pairs), reduce(DataFrame.unionByName, inside)


def dealt_pairs(inside: DataFrame, info: DataFrame, deals: range, least: float) -> DataFrame:
    """(u, v, a, b): each member of a full bucket (key, node, size, component) with the first of its
    part, where that is of another component and length and parity bits don't rule the two
    out; a and b are the components.  Buckets are dealt by the hashes of ``deals``, one
    after another: only the rows of one deal are shuffled at a time, and few pairs stay."""
    marked = save(inside.join(info.select("node", *MARKS), on="node"), "marked-buckets")
    columns = ("node", "component", *MARKS)
    parts = F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / PART))
    first = Window.partitionBy("key", "part").orderBy("h", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = []
    for deal in deals:
        dealt = marked.select("key", *columns, F.pmod(F.xxhash64("node", F.lit(deal)), parts).alias("part")).repartition("key", "part")
        both = dealt.withColumn("h", F.xxhash64(F.lit(deal), "node")).select(
            *[F.col(c).alias(f"{c}_u") for c in columns], *[F.first(c).over(first).alias(f"{c}_v") for c in columns])
        both = both.where((F.col("component_u") != F.col("component_v")) & may_be_near(least))
        pairs.append(save(both.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v"),
                                      F.least("component_u", "component_v").alias("a"), F.greatest("component_u", "component_v").alias("b"))
                          .distinct(), "dealt-pairs"))
    drop(marked)
    return reduce(DataFrame.unionByName, pairs).distinct()


def likely(pairs: DataFrame, info: DataFrame, least: float) -> DataFrame:
    """(u, v, a, b): the pairs (u, v) of different components a and b that length and parity bits don't rule out."""
    columns = ("node", "component", *MARKS)
    side = lambda s: info.select(*[F.col(c).alias(f"{c}_{s}") for c in columns])
    both = pairs.select(F.col("u").alias("node_u"), F.col("v").alias("node_v")).distinct()
    both = both.join(side("u"), on="node_u").join(side("v"), on="node_v").where((F.col("component_u") != F.col("component_v")) & may_be_near(least))
    return both.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"), F.least("component_u", "component_v").alias("a"),
                       F.greatest("component_u", "component_v").alias("b"))


def crossed_pairs(inside: DataFrame, info: DataFrame, least: float) -> DataFrame:
    """(u, v, a, b): the pairs (u, v) of lines of one bucket (key, node, component) of different components a
    and b that length and parity bits don't rule out.  A row is read as often as its bucket has rows."""
    columns = ("node", "component", *MARKS)
    marked = save(inside.select("key", "node", "component").join(info.select("node", *MARKS), on="node"), "marked-buckets")
    u, v = (marked.select("key", *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "uv")
    both = u.join(v, (u["key"] == v["key"]) & (F.col("component_u") < F.col("component_v")) & may_be_near(least))
    pairs = save(both.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v"),
                             F.col("component_u").alias("a"), F.col("component_v").alias("b")).distinct(), "crossed-pairs")
    drop(marked)
    return pairs


def with_components(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, on="node", how="left").withColumn("component", F.coalesce("component", "node"))


def torn_buckets(inside: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    torn = inside.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("key")
    return inside.join(torn, on="key", how="left_semi")


def similar_lines(docs: DataFrame, occurrences: DataFrame, info: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of the lines ``info`` (node, n, parity bits, SimHash, three words) that are linked."""
    groups, inside, known = info.select("node", F.col("node").alias("component")).limit(0), None, ["key", "node", "size"]
    for wave, (start, end) in enumerate(KEY_WAVES):
        with scratch() as kept:
            lines = save(with_components(info, groups), "line-components") if wave else info.withColumn("component", F.col("node"))
            few, full = bucket_pairs(lines if wave else info, start, end)
            pairs = likely(few, lines, least)
            if wave:
                # what the waves before left of different components, and the buckets of this one
                full = full.select(*known, "component").unionByName(inside.select(*known, "component"))
                pairs = pairs.unionByName(crossed_pairs(full.where(F.col("size") <= CROWD), info, least))
                full = full.where(F.col("size") > CROWD)
            pairs = save(pairs.unionByName(dealt_pairs(full, info, range(wave, wave + 1), least)).distinct(), "line-pairs")
            found = verified(docs, occurrences, pairs.select("u", "v"), least, id_col, text_col)
            groups = relabelled(groups, connected_components(label_links(found, pairs)))
            inside = save(torn_buckets(with_components(full.select(*known), groups)), "torn-buckets")
            kept += [groups, inside]
    if not inside.limit(1).count():
        return groups
    for wave in range(WAVES):
        first = len(KEY_WAVES) + wave * DEALS
        more = save(dealt_pairs(inside, info, range(first, first + DEALS), least), "line-pairs")
        if not more.limit(1).count():
            break
        found = verified(docs, occurrences, more.select("u", "v"), least, id_col, text_col)
        if not found.limit(1).count():
            break
        groups = relabelled(groups, connected_components(label_links(found, more)))
        inside = save(torn_buckets(with_components(inside.select(*known), groups)), "torn-buckets")
    # lines of one bucket in different components are compared, those of its largest component only
    # with others, so that a bucket of one large group and some more lines costs few comparisons
    columns = ("node", "component", *MARKS)
    sizes = inside.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top")).select("key", F.col("top.component").alias("largest"))
    rest = save(inside.select("key", "node", "component").join(largest, on="key").join(info.select("node", *MARKS), on="node"), "marked-buckets")
    u, v = (rest.select("key", "largest", *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "uv")
    u = u.where("component_u != largest").drop("largest")
    apart = (F.col("component_u") != F.col("component_v")) & ((F.col("component_v") == F.col("largest")) | (F.col("component_u") < F.col("component_v")))
    across = u.join(v, (u["key"] == v["key"]) & apart & may_be_near(least))
    across = save(across.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"), F.least("component_u", "component_v").alias("a"),
                                F.greatest("component_u", "component_v").alias("b")).distinct(), "line-across")
    last = verified(docs, occurrences, across.select("u", "v").distinct(), least, id_col, text_col)
    drop(rest)
    return relabelled(groups, connected_components(label_links(last, across)))


def line_codes(docs: DataFrame, occurrences: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, code) for some lines: each word as one sign, so that edits count words.
    Only texts that hold a first occurrence of such a line are read beyond their hash."""
    first = save(sieve(occurrences, "h1", nodes, "node").join(nodes.select(F.col("node").alias("h1")), on="h1", how="left_semi").groupBy("h1")
                 .agg(F.min_by(F.struct("id", "th", "line"), F.struct("id", "line", "th")).alias("at"))
                 .select("h1", "at.id", "at.th", "at.line"), "line-places")
    some = sieve(docs.withColumn("__th", F.xxhash64(id_col, text_col)), "__th", first, "th").drop("__th")
    lines = lines_of(some, id_col, text_col).join(first, on=["id", "th", "line"])
    sign = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(54_000)) + 256), 4, "0")
    code = F.decode(F.unhex(F.array_join(F.transform(F.split(normalised("raw"), " "), sign), "")), "UTF-16BE")
    return save(lines.select(F.col("h1").alias("node"), code.alias("code")).dropDuplicates(["node"]), "line-codes")


def verified(docs: DataFrame, occurrences: DataFrame, pairs: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (u, v) of lines whose edit similarity is at least ``least``."""
    pairs = save(pairs, "line-pairs")
    nodes = save(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "line-nodes")
    codes = line_codes(docs, occurrences, nodes, id_col, text_col)
    both = pairs.join(codes.select(F.col("node").alias("u"), F.col("code").alias("a")), on="u").join(
        codes.select(F.col("node").alias("v"), F.col("code").alias("b")), on="v")
    most = F.floor(F.greatest(F.length("a"), F.length("b")) * F.lit(1 - least) + F.lit(1e-9)).cast("int")
    both = both.withColumn("most", most).where(F.abs(F.length("a") - F.length("b")) <= F.col("most"))
    return save(both.where(F.expr("levenshtein(a, b, most) >= 0")).select("u", "v"), "line-links")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 3, least: float = 0.8) -> DataFrame:
    """(id, th, line, class_id, class_line, class_size, kept): one row for each line
    of each different row; (class_id, class_line) is the occurrence that stays.

    ``id`` is the document's id (the least bigint for null) and ``th`` the hash
    of id and text by which rows are known.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0, and 1 at most")
    if min_words < 0:
        raise ValueError("min_words must not be negative")
    with scratch() as kept:
        marked = save(line_hashes(docs, id_col, text_col), "marked-lines")
        lines = save(marked.select("id", "th", "line", "h1", "h2", "n"), "lines")
        fit = marked.where(F.col("n") >= min_words)
        marks = ["first", "last", "low", "sim0", "sim1", *MARKS]
        # the marks of a line are the same wherever it stands
        different = save(fit.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k"), *[F.first(c).alias(c) for c in marks]), "different-lines")
        drop(marked)
        # lines that a single edit can leave similar to another
        longest = lambda n: F.floor(n / F.lit(least) + F.lit(1e-9))
        fuzzy = (F.col("n") >= max(2, min_words)) & (longest(F.col("n")) * F.lit(1 - least) + F.lit(1e-9) >= 1)
        info = save(different.where(fuzzy).select(F.col("h1").alias("node"), *marks).dropDuplicates(["node"]), "line-marks")
        groups = save(similar_lines(docs, lines, info, least, id_col, text_col)
                      .select(F.col("node").alias("h1"), "component"), "line-groups")

        # classes of several occurrences: components of linked lines, and lines that occur twice
        linked = sieve(different, "h1", groups, "h1").join(groups, on="h1").select("h1", "h2", F.col("component").alias("c1"), F.lit(0).cast("long").alias("c2"))
        twice = different.where("k > 1").join(groups, on="h1", how="left_anti").select("h1", "h2", F.col("h1").alias("c1"), F.col("h2").alias("c2"))
        classes = save(linked.unionByName(twice), "line-classes")
        occurrence = F.struct("id", "line", "th")
        maybe = maybe_among(lines, "h1", classes, "h1", "maybe")
        found = save(maybe.where(F.col("maybe") & (F.col("n") >= min_words)).select("id", "th", "line", "h1", "h2").join(classes, on=["h1", "h2"], how="left"),
                     "line-occurrences")
        of_class = save(found.where("c1 is not null").groupBy("c1", "c2").agg(F.min(occurrence).alias("first"), F.count(F.lit(1)).alias("size")), "line-firsts")
        kept += [lines, classes, found, of_class]
    repeated = found.join(of_class, on=["c1", "c2"], how="left")
    own = [F.col("id").alias("class_id"), F.col("line").alias("class_line"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")]
    return maybe.where(~F.col("maybe") | (F.col("n") < min_words)).select("id", "th", "line", *own).unionByName(repeated.select(
        "id", "th", "line", F.coalesce("first.id", "id").alias("class_id"), F.coalesce("first.line", "line").alias("class_line"),
        F.coalesce("size", F.lit(1).cast("long")).alias("class_size"),
        (F.col("first").isNull() | (F.col("first") == occurrence)).alias("kept")))


def keep_lines(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that ``marked`` drops; all columns stay, and so do
    texts that lose no line, unchanged (null included)."""
    gone = marked.where(~F.col("kept")).groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(
        F.collect_set("line").alias("__gone"))
    rows = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "__th": F.xxhash64(id_col, text_col)})
    rows = rows.join(gone, on=["__id", "__th"], how="left")
    # positions that stay, by one sorted pass over both lists
    cut = F.split(F.col(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("__gone"))
    text = F.array_join(F.transform(stay, lambda i: F.element_at(cut, i + 1)), "\n")
    return rows.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(text)).select(*docs.columns)
