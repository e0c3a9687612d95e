"""textlake: a Spark-native text-corpus trend engine.

Turns tables of raw web pages or documents into normalized token bags and
answers trend questions over them (word counts per group, relative term
timelines, corpus statistics, TF-IDF per document and per group, ranked top
terms, page and link extraction).  Every operator is a function from
DataFrame (or Column) to DataFrame (or Column) built on Spark's own
expressions, aggregations, windows and ML transformers.
"""

from textlake.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
