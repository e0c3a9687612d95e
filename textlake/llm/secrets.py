"""Secret scans (native): parts of credentials, linked within scopes.

*Base* parts are reported wherever they stand: ``assign`` (a name like
password or token, a sign, a value of eight characters and more), ``access``
(AKIA identifiers of 16 and more) and ``hex`` (runs of 32 and more).
*Weak* parts mean little alone: ``user`` (account names and mail addresses),
``key40`` (runs of 40 base64 letters of mixed kinds) and ``endpoint``
(addresses of services).  A weak part is reported only where a part that
complements it stands within ``scope`` code points without overlapping it:
identifiers (access, user) complement secrets (assign, hex, key40) and these
complement endpoints.

1. Matches are marked in one regular expression pass each, in texts that have
   one; what leaves the text is the lengths of its pieces and the matches.
   Running sums of the lengths give the places.
2. The interval join: a part meets the least start and the greatest end of
   each role in its own and the neighbouring cells of ``scope`` code points.
   A cell is one row for a role however many parts it holds, so a text of
   very many parts costs no pairs.

Defined results.  A null text counts as empty.  Places are code points, ends
exclusive.  Equal rows (id and text) have equal results, each in its row; a
null id is one more id.  An empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import save, text_or_empty

#: Patterns of the base kinds, in the order of the kinds (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Patterns of the weak kinds.  Names before an @ have 64 letters at most, so that a long run of
#: letters without one is not tried from each of its letters to its end.
USER = (r"""(?i:user_?name|user|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
        r"|[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z0-9.-]*[A-Za-z0-9]")
KEY40 = r"[A-Za-z0-9/+]{40,}"
ENDPOINT = (r"""(?i:https?|s3|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9./:@_?&=%-]+"""
            r"""|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}""")

KINDS = {"assign": ("secret", ASSIGN, True), "access": ("identifier", ACCESS, True), "hex": ("secret", HEX, True),
         "user": ("identifier", USER, False), "key40": ("secret", KEY40, False), "endpoint": ("endpoint", ENDPOINT, False)}
PARTNERS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}

_MARK = "\u0001"


def _holds(kind: str, match: Column) -> Column:
    """What a match must fulfil beyond its pattern."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 8
    if kind == "key40":
        return (F.length(match) == 40) & match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
    return F.lit(True)


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, kind, role, strong, start, end): all matches that hold, base and weak."""
    clean = F.col("clean")

    def pieces(order: int, kind: str, pattern: str) -> Column:
        marked = F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK)
        cut = F.transform(marked, lambda p, i: F.struct(
            F.lit(order).alias("kind"), i.alias("i"), F.length(p).cast("long").alias("n"),
            F.when(i % 2 == 1, p).alias("match")))
        return F.when(clean.rlike(pattern), cut).otherwise(F.array().cast("array<struct<kind:int,i:int,n:bigint,match:string>>"))

    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(id_col, text_col).alias("th"),
        F.translate(text_or_empty(text_col), _MARK, "\u0002").alias("clean"))  # no pattern knows either sign
    rows = texts.select("id", "th", F.explode(F.concat(*[pieces(o, k, v[1]) for o, (k, v) in enumerate(KINDS.items())])).alias("p"))
    # equal rows emit the same pieces; they count once
    rows = (rows.select("id", "th", "p.kind", "p.i", "p.n", "p.match").groupBy("id", "th", "kind", "i")
            .agg(F.first("n").alias("n"), F.first("match").alias("match")))
    upto = Window.partitionBy("id", "th", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum("n").over(upto)).where("i % 2 = 1")
    holds = reduce(lambda a, x: a | x, [(F.col("kind") == o) & _holds(k, F.col("match")) for o, k in enumerate(KINDS)])
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("role"), F.lit(s).alias("strong"))
                      for k, (r, _, s) in KINDS.items()])
    return (placed.where(holds).withColumn("of", named[F.col("kind")])
            .select("id", "th", F.col("kind").alias("order"), "of.kind", "of.role", "of.strong",
                    (F.col("end") - F.col("n")).alias("start"), "end"))


def link_parts(parts: DataFrame, scope: int = 200) -> DataFrame:
    """The parts to report: the strong ones, and the weak ones with a complement within ``scope``."""
    cell = lambda at: F.floor(at / scope).cast("long")
    weak = parts.where(~F.col("strong"))
    keys = ["id", "th"]
    wanted = F.explode(reduce(lambda a, role: F.when(F.col("role") == role, F.array(*map(F.lit, PARTNERS[role]))).otherwise(a),
                              PARTNERS, F.array().cast("array<string>")))
    asks = weak.select(*keys, "kind", "start", "end", wanted.alias("partner"))
    # complements that start behind this part, by the cells of starts, or end before it, by those of ends
    begins = parts.select(*keys, F.col("role").alias("partner"), cell(F.col("start")).alias("cell"), "start").groupBy(
        *keys, "partner", "cell").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    ends = parts.select(*keys, F.col("role").alias("partner"), cell(F.col("end")).alias("cell"), "end").groupBy(
        *keys, "partner", "cell").agg(F.min("end").alias("low"), F.max("end").alias("high"))

    def near(side: DataFrame, first: Column, last: Column) -> DataFrame:
        # a value between first and last exists: in a cell inside, or past a border in the cell of that border
        at = asks.withColumns({"a": first, "b": last}).withColumn("cell", F.explode(F.sequence(cell(F.col("a")), cell(F.col("b")))))
        met = at.join(side, on=[*keys, "partner", "cell"])
        inside = (F.col("low") <= F.col("b")) & (F.col("high") >= F.col("a"))
        return met.where(inside).select(*keys, "kind", "start", "end")

    after = near(begins, F.col("end"), F.col("end") + scope)
    before = near(ends, F.greatest(F.col("start") - scope, F.lit(0).cast("long")), F.col("start"))
    linked = after.unionByName(before).distinct()
    return parts.where("strong").unionByName(parts.where(~F.col("strong")).join(linked, on=[*keys, "kind", "start", "end"], how="left_semi")
                                             .select(*parts.columns))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """(id, parts, n_<base kind>), one row for each input row; ``parts``: array of
    (start, order, kind, end, strong) by start, then kind."""
    found = link_parts(save(find_parts(docs, id_col, text_col), "secret-parts"), scope)  # the texts are searched once
    entry = F.struct("start", "order", "kind", "end", "strong")
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k, v in KINDS.items() if v[2]]
    by_row = found.groupBy("id", "th").agg(F.array_sort(F.collect_list(entry)).alias("parts"), *counts)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(id_col, text_col).alias("th"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"))
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint,strong:boolean>>")
    out = rows.join(by_row, on=["id", "th"], how="left")
    return out.select(F.col("__id").alias(id_col), F.coalesce("parts", none).alias("parts"),
                      *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k, v in KINDS.items() if v[2]])
