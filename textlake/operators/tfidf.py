"""TF-IDF: exact (long tables, no vectors) and hashed (ML pipeline).

Exact form, for documents keyed by ``key`` (a document id, or a group key
when each group is treated as one document):

    tf(d, t)  = occurrences of t in d            (empty tokens excluded)
    df(t)     = documents with tf(d, t) > 0
    m         = number of documents (distinct keys)
    score     = tf * ln((m + 1) / (df + 1))       (same IDF as Spark ML)

Plan: one aggregation of the token stream to (key, term, tf) -- the map-side
partial aggregate already finishes it, since a document's tokens come from
one row -- a scalar subquery for m, and a join that brings each row what
belongs to its term (df).  A term of every document is a hot join
key; AQE's skew join does not split it (the other side arrives from an
aggregate, not from a shuffle), so rows carry a salt, a hash of their key, and
the terms' values are joined back to the (term, salt) pairs that occur: at most
as many rows as the (key, term) table has, one for a word that stands once.
Where the key is a group, a term has at most as many rows as there are groups,
and ``salts=1`` joins on the term alone.  Treating a group as one document never
concatenates the group's texts: the bag of words of the concatenation is the sum
of the members' bags, which is what the aggregation computes, so no single row
or task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, Tokenizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions.constants import NUM_FEATURES, TOP_RANK_PER_GROUP
from textlake.functions.hashing import hashing_tf_bucket
from textlake.functions.text import tokens


def term_frequencies(docs: DataFrame, key: Sequence[str], body: str = "body") -> DataFrame:
    """(key, term, tf) over non-empty ' '-separated tokens."""
    toks = docs.select(*key, F.explode(tokens(body)).alias("term")).where(F.col("term") != "")
    return toks.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df): rows of a (key, term, tf) table per term.

    Written as "documents with tf > 0" so that the tf column stays alive in
    this branch (a plain row count lets the optimizer prune it): the
    (key, term) aggregate is then the same plan as the other join side and
    AQE reuses its shuffle instead of scanning and normalizing the texts a
    second time.
    """
    return tf.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))


def n_documents(docs: DataFrame, key: Sequence[str]) -> Column:
    """Number of distinct keys as a scalar-subquery Column (computed once on
    the cluster, never collected by user code)."""
    return docs.select(*key).distinct().select(F.count(F.lit(1))).scalar()


def idf(df_col: Column, m: Column) -> Column:
    return F.log((m + F.lit(1)).cast("double") / (df_col + F.lit(1)).cast("double"))


def with_term_values(tf: DataFrame, key: Sequence[str], salts: int) -> DataFrame:
    """``tf`` with ``df``, the number of its rows with the same term.

    With salts the rows of one term meet its total in so many separate
    partitions.  First (term, salt) is counted, then term; the totals go back
    to the pairs that occur, and those to the rows.  The rows are dealt by
    (term, salt) once, for the counts and for the join, and the pairs by term
    once.  The totals, a few numbers for each pair, are hashed where they lie;
    the rows, many times as many, are not sorted.

    The conditions on the counts are always true: they keep the counts, and so
    ``tf``, alive on every path, whatever the caller reads.  All paths are then
    one plan up to each shuffle, which Spark makes once.
    """
    # a count, as it is never NULL: a test for that would stand on one path only
    holds = F.count(F.when(F.col("tf") > 0, 1))
    if salts == 1:
        whole = tf.groupBy("term").agg(holds.alias("df")).where("df > 0")
        return tf.join(whole, on="term")
    # never NULL either
    salt = F.coalesce(F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"), F.lit(0))
    dealt = tf.repartition("term", salt)
    part = dealt.groupBy("term", salt.alias("_salt")).agg(holds.alias("n")).repartition("term")
    whole = part.groupBy("term").agg(F.sum("n").alias("df"), F.max("_salt").alias("_last"))
    totals = part.join(whole, on="term").where("df >= n AND _last >= _salt").select("term", "_salt", "df")
    return dealt.withColumn("_salt", salt).join(totals.hint("shuffle_hash"), on=["term", "_salt"]).drop("_salt")


def tfidf_exact(docs: DataFrame, key: Sequence[str], body: str = "body", salts: int = 16
                ) -> DataFrame:
    """(key, term, score, tf) for every distinct term of every document.

    The texts are normalized once; both join sides start from the same
    (key, term) shuffle.  ``salts``: over how many partitions the rows of one
    term are spread; 1 where the keys are groups.
    """
    tf = with_term_values(term_frequencies(docs, key, body), key, salts)
    score = (F.col("tf") * idf(F.col("df"), n_documents(docs, key))).alias("score")
    return tf.select(*key, "term", score, F.col("tf").cast("double").alias("tf"))


def document_frequency_of_rows(docs: DataFrame, body: str = "body") -> DataFrame:
    """(term, df) where each row is one document: one map-side-combined shuffle
    of (term, count) instead of first building the (document, term) table."""
    terms = docs.select(F.explode(F.array_distinct(tokens(body))).alias("term"))
    return terms.where(F.col("term") != "").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf_of_document(docs: DataFrame, key: str, value, body: str = "body") -> DataFrame:
    """(key, term, score, tf) of the document ``value``, each row one document.

    The corpus' tokens are cut down to that document's terms before they are
    counted.  Those terms are broadcast: they come from one row's text, so
    they fit wherever that row does, whatever the corpus' size.
    """
    mine = docs.where(F.col(key) == F.lit(value))
    tf = term_frequencies(mine, [key], body)
    own = tf.select("term").distinct()
    terms = docs.select(F.explode(F.array_distinct(tokens(body))).alias("term"))
    dfreq = (terms.where(F.col("term") != "").join(F.broadcast(own), on="term", how="left_semi")
             .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    score = (F.col("tf") * idf(F.col("df"), n_documents(docs, [key]))).alias("score")
    return tf.join(dfreq, on="term").select(key, "term", score, F.col("tf").cast("double").alias("tf"))


def top_terms_per_group(scores: DataFrame, group: Sequence[str], k: int = TOP_RANK_PER_GROUP,
                        score: str = "score") -> DataFrame:
    """Terms with dense rank <= k by score within each group, score != 0.

    Ties share a rank, so a group may return more than k rows.  Catalyst
    adds a partial WindowGroupLimit before the shuffle, so each map task
    sends at most the top ranks of each group, not the whole group.
    """
    w = Window.partitionBy(*group).orderBy(F.col(score).desc())
    ranked = scores.where(F.col(score) != 0).withColumn("rank", F.dense_rank().over(w))
    return ranked.where(F.col("rank") <= k).select(*group, "term", score, "rank") \
        .orderBy(*group, "rank", "term")


def terms_of_document(scores: DataFrame, key: str, value) -> DataFrame:
    """All terms of one document by descending score."""
    return (scores.where(F.col(key) == F.lit(value))
            .select("term", "score", "tf", key)
            .orderBy(F.col("score").desc(), F.col("term")))


# --- hashed TF-IDF (Spark ML) ----------------------------------------------

def hash_vectors(rows: DataFrame, words: Column, num_features: int = NUM_FEATURES) -> DataFrame:
    """``rows`` + ``_vector``, the HashingTF vector of the array ``words`` (never NULL)."""
    hashing = HashingTF(inputCol="_words", outputCol="_vector", numFeatures=num_features)
    return hashing.transform(rows.withColumn("_words", words)).drop("_words")


def with_buckets(rows: DataFrame, num_features: int = NUM_FEATURES) -> DataFrame:
    """``rows`` + ``bucket``, the HashingTF bucket of their ``term``: the index of the
    vector of that term alone.  HashingTF hashes a term about twenty times faster
    than ``hashing_tf_bucket``, which is for expressions.  Never NULL, so a join
    on it adds no test that would hash the term again."""
    bucket = F.coalesce(vector_entries(F.col("_vector"))["indices"][0], F.lit(0))
    return hash_vectors(rows, F.array("term"), num_features).withColumn("bucket", bucket).drop("_vector")


def ml_tokenize(docs: DataFrame, body: str = "body", out: str = "words") -> DataFrame:
    """Spark ML Tokenizer: lower-case, split on single whitespace (empty
    tokens inside are kept, trailing ones are dropped)."""
    return Tokenizer(inputCol=body, outputCol=out).transform(docs)


def hashed_tfidf_pipeline(body: str = "body", num_features: int = NUM_FEATURES) -> Pipeline:
    """Tokenize -> HashingTF -> IDF, as one ML pipeline.

    Empty tokens are dropped (minTokenLength=1) so the hashed and the exact
    forms count the same tokens.  IDF.fit is one aggregation whose state is
    a ``num_features`` vector per task, independent of the data size.
    """
    return Pipeline(stages=[
        RegexTokenizer(inputCol=body, outputCol="words", pattern=" ", gaps=True,
                       minTokenLength=1, toLowercase=True),
        HashingTF(inputCol="words", outputCol="rawFeatures", numFeatures=num_features),
        IDF(inputCol="rawFeatures", outputCol="features"),
    ])


def hashed_features(docs: DataFrame, body: str = "body", num_features: int = NUM_FEATURES
                    ) -> DataFrame:
    """Input rows + ``words`` and ``rawFeatures`` (hashed tf).  A caller that
    wants them read once for the fit and the transform persists this frame,
    hands it to ``idf_vectors`` and unpersists it when done."""
    tokenizer, hashing, _ = hashed_tfidf_pipeline(body, num_features).getStages()
    return hashing.transform(tokenizer.transform(docs))


def idf_vectors(featurized: DataFrame) -> DataFrame:
    """``hashed_features`` rows + ``features`` (tf-idf)."""
    return IDF(inputCol="rawFeatures", outputCol="features").fit(featurized).transform(featurized)


@contextmanager
def cached_features(docs: DataFrame, body: str = "body", num_features: int = NUM_FEATURES):
    """``hashed_features`` persisted on the executors' disks while the block runs, so that
    the fit and the transform read it once made; afterwards just this frame is
    released.  What is made of it inside the block must be written there.

    Texts, words and vectors are several times the input.  Kept in memory as well, a
    partition is one block of the heap, and one that went to disk is read back
    whole into it; on disk only, it is written and read as a stream of batches."""
    frame = hashed_features(docs, body, num_features).persist(StorageLevel.DISK_ONLY)
    try:
        yield frame
    finally:
        frame.unpersist()


def term_presence(vectors: DataFrame, key: Sequence[str], terms: Sequence[str], raw: str = "rawFeatures",
                  features: str = "features") -> DataFrame:
    """(key, term, bucket, tf, weight, present): for each row of ``vectors`` and each of
    ``terms`` its bucket, whether that is among the vector's indices, and the
    entries there (0 where it is not): the occurrences and the tf-idf weight."""
    rv, fv = vector_entries(F.col(raw)), vector_entries(F.col(features))
    asked = F.array(*[F.struct(F.lit(t).alias("term"), hashing_tf_bucket(F.lit(t), rv["size"]).alias("bucket")) for t in terms])
    rows = vectors.select(*key, rv["indices"].alias("_i"), rv["values"].alias("_tf"), fv["indices"].alias("_fi"),
                          fv["values"].alias("_w"), F.explode(asked).alias("_a"))
    at = lambda indices: F.array_position(indices, F.col("_a.bucket")).cast("int")
    entry = lambda indices, values: F.coalesce(F.try_element_at(values, F.nullif(at(indices), F.lit(0))), F.lit(0.0))
    return rows.select(*key, "_a.term", "_a.bucket", entry("_i", F.col("_tf")).alias("tf"), entry("_fi", F.col("_w")).alias("weight"),
                       (at("_i") > 0).alias("present"))


def hashed_tfidf_vectors(docs: DataFrame, body: str = "body",
                         num_features: int = NUM_FEATURES) -> DataFrame:
    """Input rows + ``words``, ``rawFeatures`` (tf) and ``features`` (tf-idf)
    sparse vectors, side by side in the same row (no positional zip)."""
    return idf_vectors(hashed_features(docs, body, num_features))


def vector_entries(v: Column) -> Column:
    """A ML vector column as its storage struct (type, size, indices, values)."""
    return F.unwrap_udt(v)


def vector_scores(vectors: DataFrame, key: Sequence[str], words: str = "words",
                  raw: str = "rawFeatures", features: str = "features") -> DataFrame:
    """Long (key, term, score, tf) table read off the ML pipeline's vectors.

    The sparse vectors are exploded to (key, bucket, tf, score) through
    their storage struct (JVM-side), each document's distinct words get
    their HashingTF bucket, and the two are joined on (key, bucket): the
    vectors are never collected, and no positional zip is needed since the
    vectors sit in the same row as their key.
    """
    rv, fv = vector_entries(F.col(raw)), vector_entries(F.col(features))
    entries = vectors.select(*key, F.explode(F.arrays_zip(
        rv["indices"].alias("bucket"), rv["values"].alias("tf"), fv["values"].alias("score")))
        .alias("e")).select(*key, "e.bucket", "e.tf", "e.score")
    terms = vectors.select(*key, F.explode(F.array_distinct(words)).alias("term"))
    # the buckets' number is the vectors' size, whatever it is: HashingTF notes it on its column
    size = vectors.schema[raw].metadata["ml_attr"]["num_attrs"]
    return with_buckets(terms, size).join(entries, on=[*key, "bucket"]).select(*key, "term", "score", "tf")


def tfidf_hashed_scores(docs: DataFrame, key: Sequence[str], body: str = "body",
                        num_features: int = NUM_FEATURES) -> DataFrame:
    """(key, term, score, tf) as read from the hashed vectors.

    A term's tf and score are those of its bucket (terms of one document
    that share a bucket add up), computed with a window and aggregations
    instead of vectors and positional zips (each row's term is hashed where it
    lies; no join with the vocabulary, which would shuffle all rows again):
      (key, term, tf) -> + bucket -> window over (key, bucket): btf, first
      (bucket, bdf = documents holding the bucket)
    A (key, bucket) window partition holds only the terms of one document
    that collide in one bucket, so it never grows with the data.  The
    (bucket, bdf) table has at most ``num_features`` rows -- a bound that
    does not grow with the data -- so it is broadcast.
    """
    tf = with_buckets(term_frequencies(docs, key, body), num_features)
    cell = Window.partitionBy(*key, "bucket").orderBy("term")
    whole = cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = tf.select(*key, "term", "bucket", F.sum("tf").over(whole).alias("btf"),
                      (F.row_number().over(cell) == 1).alias("first"))
    # bdf counts each (document, bucket) once, where it has a positive tf;
    # naming btf here keeps both window columns (and the tf aggregate below
    # them) alive in this branch, so the whole subtree is reused.
    holds = (F.col("first") & (F.col("btf") > 0)).cast("long")
    bdf = cells.groupBy("bucket").agg(F.sum(holds).alias("bdf"))
    m = n_documents(docs, key)
    return (cells.join(F.broadcast(bdf), on="bucket")
            .select(*key, "term", (F.col("btf") * idf(F.col("bdf"), m)).alias("score"),
                    F.col("btf").cast("double").alias("tf")))


def hash_bucket_terms(docs: DataFrame, body: str = "body", num_features: int = NUM_FEATURES
                      ) -> DataFrame:
    """Bucket diagnostic over the buckets the hashed scores use, each row of
    ``docs`` one document: (term, bucket, weight, n_terms) -- the IDF weight
    of the term's bucket and how many terms of the corpus share it.

    A document's buckets are the indices of its HashingTF vector; the corpus'
    terms get theirs after they were counted, each term once."""
    words = F.coalesce(F.filter(tokens(body), lambda t: t != ""), F.array().cast("array<string>"))
    vectors = hash_vectors(docs, words, num_features)
    df = (vectors.select(F.explode(vector_entries(F.col("_vector"))["indices"]).alias("bucket"))
          .groupBy("bucket").agg(F.count(F.lit(1)).alias("bdf")))
    held = with_buckets(document_frequency_of_rows(docs, body).where("df > 0").select("term"), num_features)
    shared = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_terms"))
    m = docs.select(F.count(F.lit(1))).scalar()
    return held.join(df.join(shared, on="bucket"), on="bucket").select(
        "term", "bucket", idf(F.col("bdf"), m).alias("weight"), "n_terms")


def hash_bucket_audit(tf: DataFrame, num_features: int = NUM_FEATURES) -> DataFrame:
    """HashingTF buckets shared by more than one distinct term of the corpus:
    where a hashed score mixes terms.  (bucket, n_terms, first_term,
    last_term).  ``tf`` is any table with a ``term`` column."""
    terms = tf.select("term").distinct()
    return (with_buckets(terms, num_features)
            .groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n_terms"), F.min("term").alias("first_term"),
                 F.max("term").alias("last_term"))
            .where(F.col("n_terms") > 1))
