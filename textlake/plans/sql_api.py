"""SQL surface: the normalizer as SQL functions, and the tables as views.

``register_sql_functions`` defines temporary SQL functions whose bodies are
SQL expressions; the analyzer inlines them, so ``clearAll(lower(content))``
in a query runs as built-in JVM expressions, with no Python worker.
``register_views`` registers the lazy DataFrames as temp views, so analyses
written as SQL text over views keep working.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from textlake.functions.constants import DEFAULT_STOPWORDS, PHRASES
from textlake.functions.text import NOT_WORD_CHARS, STRIP_PATTERN


def lit(s: str) -> str:
    """Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def raw(s: str) -> str:
    """Spark SQL raw string literal (backslashes kept, for regexes)."""
    assert "'" not in s
    return "r'" + s + "'"


def register_sql_functions(spark: SparkSession, stopwords: Sequence[str] = DEFAULT_STOPWORDS,
                           phrases: Sequence[str] = PHRASES) -> list[str]:
    words = "(" + ", ".join(lit(w) for w in dict.fromkeys(stopwords)) + ")"
    glued = "s"
    for p in phrases:
        glued = f"replace({glued}, {lit(p)}, {lit(p.replace(' ', ''))})"
    bodies = {
        "cleanString": ("s STRING", "STRING",
                        f"trim(regexp_replace(regexp_replace(s, {raw(NOT_WORD_CHARS)}, ''), "
                        "' {2,}', ' '))"),
        "removeStopwords": ("s STRING", "STRING",
                            f"array_join(filter(split(s, ' '), w -> w NOT IN {words}),"
                            " ' ')"),
        "lemmatize": ("s STRING", "STRING", f"regexp_replace(s, {raw('s(?= |\\z)')}, '')"),
        "tokenize": ("s STRING", "STRING", glued),
        "clearAll": ("s STRING", "STRING", "tokenize(lemmatize(removeStopwords(cleanString(s))))"),
        "stripArray": ("a ARRAY<STRING>", "ARRAY<STRING>",
                       "transform(a, x -> regexp_replace(lower(x), "
                       f"{raw(STRIP_PATTERN)}, ''))"),
    }
    # array_size needs no definition: it is a Spark SQL built-in with the
    # same meaning (element count; an int, where the original summed strings).
    for name, (params, returns, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} "
                  f"RETURN {body}")
    return list(bodies)


def register_views(spark: SparkSession, sf_dir: str, group: str = "lang",
                   stopwords: Sequence[str] = DEFAULT_STOPWORDS,
                   phrases: Sequence[str] = PHRASES, materialized: bool = False) -> list[str]:
    """Temp views over the driver tables: raw_documents, clean_documents,
    wordcounts, wordcounts_per_group, scores (per document) and
    scores_per_group.  Lazy by default; with ``materialized`` the four
    derived tables are written once to the shared folder (see
    ``textlake.plans.materialize``) so that many queries reuse one pass."""
    from textlake.operators import counts, documents, tfidf
    from textlake.sources import tables

    raw_docs = tables.raw_documents(spark, sf_dir, (group,))
    docs = documents.clean_documents(raw_docs, ["doc_id", group], stopwords=stopwords,
                                     phrases=phrases)
    views = {
        "raw_documents": raw_docs,
        "clean_documents": docs,
        "wordcounts": counts.word_count(docs),
        "wordcounts_per_group": counts.word_count_per_group(docs, [group]),
        "scores": tfidf.tfidf_exact(docs, ["doc_id"]),
        "scores_per_group": tfidf.tfidf_exact(docs, [group]),
    }
    if materialized:
        from textlake.plans.materialize import materialize
        for name in ("wordcounts", "wordcounts_per_group", "scores", "scores_per_group"):
            views[name] = materialize(views[name], name)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
