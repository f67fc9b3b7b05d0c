"""Text vectors and encoders (#76-#81), written as relational jobs.

TF-IDF is computed exactly with the definition the training scripts use
(tokens of two or more letters, 1-2-grams, document-frequency bounds, top-k
vocabulary by corpus count, ``1 + ln tf``, smooth idf ``ln((1+n)/(1+df)) + 1``,
L2 norm); Spark ML's ``IDF`` uses a different idf and no sublinear tf, so it
is not used here. A document's terms are counted and weighed in its row
(``terms``); the one shuffle is that of term statistics. The vocabulary is capped
at ``max_features`` rows, which is the proven bound that lets it be shared with
every task; a larger one is joined with (doc, term) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.formatting import py_round
from ..functions.stopwords import english_stop_words
from . import terms as TM
from .tickets import assign_ids


def ngram_terms(tokens: Column, ngram_max: int = 2) -> Column:
    """Unigrams followed by bigrams of adjacent tokens (in-row, no explode)."""
    if ngram_max == 1:
        return tokens
    n = F.size(tokens)
    bigrams = F.when(n > 1, F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1),
                                       lambda a, b: F.concat(a, F.lit(" "), b))) \
        .otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, bigrams)


def clean_tokens(text: str) -> Column:
    """Tokens of the cleaned text with at least two letters."""
    return F.filter(F.split(X.clean_text(text), " "), lambda w: F.length(w) >= 2)


def word_tokens(text: str, stop_words: bool = False) -> Column:
    """Lower-cased runs of two or more word characters (Unicode letters, digits, underscore)."""
    toks = F.regexp_extract_all(X.lower_text(text), F.lit(r"(?U)\b\w\w+\b"), 0)
    if stop_words:
        stop = english_stop_words()
        toks = F.filter(toks, lambda w: ~w.isin(*stop))
    return toks


def term_counts(docs: DataFrame, key: str, terms, tokens: Column | None = None) -> DataFrame:
    """(key, term, tf): occurrences of each term per document.

    When ``tokens`` is given it is computed once into a column and ``terms`` (a
    function of that column) builds the n-grams from it; otherwise ``terms`` is
    a column. The explicit NULL filter makes every use of this frame plan
    identically, so Spark reuses its shuffle instead of recomputing it.
    """
    if tokens is not None:
        docs = docs.select(key, tokens.alias("_tokens"))
        terms = terms(F.col("_tokens"))
    exploded = docs.select(key, F.explode(terms).alias("term")).where(F.col("term").isNotNull())
    return exploded.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(tf: DataFrame, n_docs: Column, max_features: int, min_df: int = 1,
               max_df: float = 1.0) -> DataFrame:
    """(term, df, idx): the ``max_features`` terms with the largest corpus count
    among those with min_df <= df <= max_df * n (ties by term), indexed in
    alphabetical order."""
    st = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return most_counted(st, n_docs, max_features, min_df, max_df)


def most_counted(st: DataFrame, n_docs: Column, max_features: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """``vocabulary`` from the terms' statistics (term, df, cf)."""
    keep = st.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs))
    top = keep.orderBy(F.desc("cf"), "term").limit(max_features)
    # At most max_features rows: the one-partition window below is bounded.
    return top.select("term", "df", (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"))


def tfidf(docs: DataFrame, key: str, tokens: Column | str, max_features: int, min_df: int = 1,
          max_df: float = 1.0, sublinear_tf: bool = False, ngram_max: int = 1) -> DataFrame:
    """(key, term, idx, weight): smooth-idf TF-IDF rows, L2-normalised per document. ``tokens`` is a column of lists, or the
    name of a text whose ``clean_tokens`` are meant."""
    n_docs = docs.select(F.count(F.lit(1)).cast("double")).scalar()
    docs = TM.spread(docs)
    if isinstance(tokens, str) and ngram_max == 2:
        stats = TM.frequent(docs, tokens, max_features, min_df, F.lit(max_df) * n_docs, BROADCAST_TERMS)
    else:
        stats = TM.statistics(docs, tokens, ngram_max)
    vocab = most_counted(stats, n_docs, max_features, min_df, max_df)
    if max_features <= BROADCAST_TERMS:
        return TM.weight_rows(docs, key, tokens, with_idf(vocab, n_docs), ngram_max, sublinear_tf)
    tf = term_counts(docs, key, lambda t: ngram_terms(t, ngram_max), clean_tokens(tokens) if isinstance(tokens, str) else tokens)
    return weigh(tf, key, with_idf(vocab, n_docs), max_features, sublinear_tf)


def with_idf(vocab: DataFrame, n_docs: Column) -> DataFrame:
    return vocab.select("term", "idx", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


BROADCAST_TERMS = 100_000  # a vocabulary of up to so many rows is shipped to every task; a larger one is joined


def weigh(tf: DataFrame, key: str, vocab: DataFrame, max_features: int, sublinear_tf: bool) -> DataFrame:
    """(key, term, idx, weight) of term counts under a fitted vocabulary (term, idx, idf) of ``max_features`` rows at most."""
    tfv = (1 + F.log(F.col("tf"))) if sublinear_tf else F.col("tf").cast("double")
    known = F.broadcast(vocab) if max_features <= BROADCAST_TERMS else vocab
    w = tf.join(known, "term").select(key, "term", "idx", (tfv * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return w.select(key, "term", "idx", (F.col("_w") / norm).alias("weight"))


def tfidf_weights(docs: DataFrame, key: str, text: str, max_features: int = 5000) -> DataFrame:
    """#76: the training-script TF-IDF on cleaned text (1-2-grams, df in [2, 95 %],
    sublinear tf)."""
    return tfidf(docs.select(key, text), key, text, max_features, min_df=2, max_df=0.95,
                 sublinear_tf=True, ngram_max=2)


def top_terms(weights: DataFrame, k: int = 20) -> DataFrame:
    """#77: the k terms with the largest summed weight."""
    g = weights.groupBy("term").agg(F.sum("weight").alias("_s"))
    return g.orderBy(F.desc("_s"), "term").limit(k).select("term", py_round(F.col("_s"), 6).alias("score"))


def tfidf_stopwords(docs: DataFrame, key: str, text: str, max_features: int = 300) -> DataFrame:
    """#78: unigram TF-IDF of the raw text without English stop words, 300 terms."""
    return tfidf(docs.select(key, text), key, word_tokens(text, stop_words=True), max_features)


def fit_label_codes(df: DataFrame, cols: list[str], default: str = "Unknown") -> Column:
    """One struct of sorted distinct values per column, as a scalar subquery.

    One aggregate over all columns (combined before its shuffle); its size is
    the columns' cardinality, so it is for categorical columns.
    """
    return df.agg(F.struct(*[F.sort_array(F.collect_set(_value(c, default))).alias(c) for c in cols])).scalar()


def _value(col: str, default: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(default))


def encode(col: str, codes: Column, default: str = "Unknown") -> Column:
    """Alphabetical code 0..k-1 of ``col``, looked up in the row; values not seen when fitting get 0."""
    return F.greatest(F.array_position(codes[col], _value(col, default)) - 1, F.lit(0)).cast("int")


def structured_features(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """#79: label-encode several categorical columns (fit on ``fit_on``): one pass to fit, no join."""
    codes = fit_label_codes(fit_on if fit_on is not None else df, cols)
    return df.select("*", *[encode(c, codes).alias(f"{c}_code") for c in cols])


def label_encode(df: DataFrame, col: str) -> DataFrame:
    """#81: alphabetical integer codes and their inverse, for a column of any number of values.

    The distinct values are numbered in place (range partitions and their
    offsets, as dense ids are) and joined; a hot value is split by adaptive
    execution, and a small table of values goes to every task.
    """
    value = _value(col, "Unknown")
    codes = assign_ids(df.select(value.alias("_value")).distinct(), ["_value"], start_after=-1, id_col="_code").checkpoint(eager=True)
    j = df.withColumn("_v", value).join(codes, F.col("_v") == F.col("_value"), "left")
    return j.withColumn("code", F.col("_code").cast("int")).withColumn("decoded", F.col("_value")).drop("_v", "_value", "_code")


def sparse_entries(df: DataFrame, text: str, vocab: DataFrame, numeric: list[str], width: int) -> DataFrame:
    """#80: ``df`` with ``indices`` (ascending) and ``values``: its row's weights of 1-2-grams under a fitted vocabulary of
    ``width`` terms, followed by the numeric columns; zeros are left out."""
    numbers = F.filter(F.array(*[F.struct(F.lit(width + i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(numeric)]),
                       lambda e: e["v"] != 0)
    rows = TM.weight_arrays(df.withColumn("_numbers", numbers), text, vocab, 2, sublinear_tf=True)
    return (rows.withColumn("indices", F.concat("indices", F.col("_numbers.i")))
            .withColumn("values", F.concat("values", F.col("_numbers.v"))).drop("_numbers"))


def write_vectors(df: DataFrame, path: str, size: int) -> DataFrame:
    """Write ``df(indices, values, ...)`` to ``path`` and read it with ``features``, a sparse vector of ``size``.

    Spark has no function that makes a sparse vector of places and values, but
    a vector column is stored as a struct of exactly these, so the stored table
    is read back as one: no row passes through Python.
    """
    from pyspark.ml.linalg import VectorUDT
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), "indices", "values")
    out = df.withColumn("features", vector)
    out.write.parquet(path)
    fields = [T.StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in out.schema]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)
