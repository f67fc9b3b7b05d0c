"""Corpus profiling (#10-#27): overview, nulls, uniqueness, distributions,
descriptive statistics, histograms, box plots, correlations, word counts.

Every statistic is an aggregate over the whole table, combined before its
shuffle. Exact quartiles are selected by rank over range partitions, so no task
holds all values of a column or class. Distinct texts are told apart by wide
digests, so no text is shuffled or sorted. Histogram edges come from a min/max
scalar subquery, so nothing is collected to the driver and no pass is made per
bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.formatting import percent_1dp, py_round
from ..functions.stopwords import english_stop_words
from ..session import checkpoint_dir

TEXT_CANDIDATES = ["instruction", "text", "query", "question", "complaint", "description"]
INTENT_CANDIDATES = ["intent", "label", "class", "target"]
CATEGORY_CANDIDATES = ["category", "department", "group", "topic"]
DESCRIBE_FEATURES = ["text_length", "word_count", "urgency_score", "sentiment_score"]


def profile_overview(df: DataFrame) -> DataFrame:
    """#10: one row per column: position, name, type, plus row and column counts.

    Column names and types are schema metadata; the row count is a scalar
    subquery executed on the cluster.
    """
    spark = df.sparkSession
    meta = spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
                                 "position int, column_name string, data_type string")
    n = df.select(F.count(F.lit(1))).scalar()
    return meta.select("position", "column_name", "data_type", n.alias("rows"),
                       F.lit(len(df.columns)).alias("columns"))


def null_counts(df: DataFrame) -> DataFrame:
    """#11: NULLs per column from one aggregate, unpivoted to (column, nulls)."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in df.columns])
    return agg.select(F.inline(rows))


def head_rows(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """#12: the first ``n`` rows by key (top-k)."""
    return df.orderBy(key).limit(n)


def detect_columns(df: DataFrame) -> DataFrame:
    """#13: text / intent / category column names from ordered candidate lists, and
    the number of texts the chosen column holds.

    The text column falls back to the string column with the longest mean
    length, measured by one aggregate over all string columns.
    """
    def first(cands):
        return next((c for c in cands if c in df.columns), None)
    text_col = first(TEXT_CANDIDATES)
    if text_col is None:
        strs = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        lens = df.agg(F.array(*[F.struct(F.avg(F.length(F.coalesce(F.col(c), F.lit("None")))).alias("m"),
                                         F.lit(-i).alias("neg_pos"), F.lit(c).alias("name"),
                                         F.count(c).alias("texts"))
                                for i, c in enumerate(strs)]).alias("a"))
        # One row with one entry per string column; the longest mean wins, ties
        # to the first column.
        text = lens.select(F.array_max("a")["name"].alias("text_column"), F.array_max("a")["texts"].alias("texts"))
    else:
        text = df.agg(F.count(text_col).alias("texts")).select(F.lit(text_col).alias("text_column"), "texts")
    return text.select("text_column", F.lit(first(INTENT_CANDIDATES)).cast("string").alias("intent_column"),
                       F.lit(first(CATEGORY_CANDIDATES)).cast("string").alias("category_column"), "texts")


def text_digest(text: str) -> Column:
    """What tells texts apart here: SHA-256, xxHash64 and length (null for a null text).

    Texts that met in one digest but differ in another part are still two, so
    only texts that agree in all three count as equal.
    """
    t = F.col(text)
    return F.when(t.isNotNull(), F.struct(F.unhex(F.sha2(t.cast("binary"), 256)).alias("sha"), F.xxhash64(t).alias("xx"),
                                          F.octet_length(t).alias("bytes")))


def uniqueness_ratio(df: DataFrame, text: str) -> DataFrame:
    """#14: total, distinct, ratio in percent and a verdict (>80 / >50 / else).

    Only digests are shuffled, one per distinct text and task. The ratio of an
    empty table is null.
    """
    groups = df.groupBy(text_digest(text).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    g = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_texts"), F.count("_d").alias("unique_texts"))
    ratio = F.when(F.col("total_texts") > 0, F.col("unique_texts") / F.col("total_texts") * 100)
    return g.select("total_texts", "unique_texts", ratio.alias("uniqueness_ratio")).select(
        "*", F.when(F.col("uniqueness_ratio") > 80, "EXCELLENT").when(F.col("uniqueness_ratio") > 50, "MODERATE")
        .otherwise("WARNING").alias("verdict"))


def distinct_sample(df: DataFrame, text: str, key: str, n: int = 5, width: int = 100) -> DataFrame:
    """#15: the first ``n`` distinct texts by first appearance, cut to ``width``."""
    first = df.groupBy(text).agg(F.min(key).alias("first_seen"))
    return first.orderBy("first_seen").limit(n).select(
        "first_seen", F.substring(F.col(text), 1, width).alias("sample"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """#16: class frequencies, largest first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


def with_engineered(df: DataFrame, text: str) -> DataFrame:
    """Corpus plus the nine engineered features and the urgency priority."""
    out = X.with_features(df, text)
    return out.withColumn("predicted_priority", X.priority_from_urgency(F.col("urgency_score")))


QUARTILES = (0.25, 0.5, 0.75)


def exact_quantiles(values: DataFrame, group: str, col: str, shares: tuple[float, ...] = QUARTILES) -> DataFrame:
    """(group, q): exact quantiles of ``col`` per group, linear between neighbours, as an array in the order of ``shares``.

    Rank selection: equal values are counted first; the counts are
    range-partitioned on (group, value), so a group with a third of all rows is
    spread over as many tasks as its values need; a table of (partition, group)
    totals tells which partitions hold the ranks asked for, and only the rows of
    those are ranked, each partition by itself. Null groups and null values are
    left out.
    """
    checkpoint_dir(values.sparkSession)
    v = F.col(col)
    counts = values.where(F.col(group).isNotNull() & v.isNotNull()).groupBy(group, v.cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    dealt = counts.repartitionByRange(group, "_v").withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    totals = dealt.groupBy("_pid", group).agg(F.sum("_c").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_pid", group, "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                           F.sum("_n").over(Window.partitionBy(group)).alias("_total"))
    at = [F.lit(s) * (F.col("_total") - 1) for s in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in at for f in (F.floor, F.ceil)]))
    here = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    asked = totals.withColumn("_ranks", here).where(F.size("_ranks") > 0).drop("_n")
    run = Window.partitionBy("_pid", group).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(asked, ["_pid", group]).withColumn("_low", F.col("_before") + F.coalesce(F.sum("_c").over(run), F.lit(0)))
    hit = F.filter("_ranks", lambda r: (r >= F.col("_low")) & (r < F.col("_low") + F.col("_c")))
    found = rows.select(group, "_total", "_v", F.explode(hit).alias("_rank"))
    # two ranks a share at most
    g = found.groupBy(group, "_total").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))
    picked = []
    for p in at:
        low, high = (F.element_at("_m", f(p).cast("long")) for f in (F.floor, F.ceil))
        picked.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high))
    return g.select(group, F.array(*picked).alias("q"))


def describe_features(df: DataFrame, features: list[str] = DESCRIBE_FEATURES) -> DataFrame:
    """#17: count, mean, std (n-1), min, quartiles (linear), max per feature."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    long = df.select(F.inline(entries))
    stats = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    s = stats.join(exact_quantiles(long, "feature", "value"), "feature", "left")
    return s.select("feature", "count", py_round(F.col("mean"), 6).alias("mean"),
                    py_round(F.col("std"), 6).alias("std"), "min",
                    F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """#18: equal-width histogram of an integer column, all bins present.

    Edges run from min to max in ``bins`` equal steps; a value on an inner edge
    belongs to the upper bin and the maximum to the last bin (closed). Bin of
    v = floor(bins * (v - min) / (max - min)), computed in exact integer
    arithmetic. min, max and mean enter as scalar subqueries.
    """
    stats = df.agg(F.min(col).cast("long").alias("mn"), F.max(col).cast("long").alias("mx"),
                   F.avg(col).alias("mean"))
    st = stats.select(F.struct("mn", "mx", "mean")).scalar()
    mn, mx = st["mn"], st["mx"]
    v = F.col(col).cast("long")
    b = F.when(mx == mn, F.lit(bins // 2)).otherwise(
        F.least(F.lit(bins - 1), ((v - mn) * bins / (mx - mn)).cast("double").cast("long").cast("int")))
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), mn.alias("mn"), mx.alias("mx"),
                                               st["mean"].alias("mean"))
    lo_e = F.when(F.col("mx") == F.col("mn"), F.col("mn") - 0.5).otherwise(F.col("mn").cast("double"))
    hi_e = F.when(F.col("mx") == F.col("mn"), F.col("mx") + 0.5).otherwise(F.col("mx").cast("double"))
    width = (hi_e - lo_e) / bins
    return edges.join(counts, "bin", "left").select(
        "bin", (lo_e + F.col("bin") * width).alias("lo"), (lo_e + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"), py_round(F.col("mean"), 6).alias("mean"))


def histogram_unit(df: DataFrame, col: str) -> DataFrame:
    """#19: one bin per integer from min to max (zero-filled)."""
    counts = df.groupBy(F.col(col).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    rng = df.agg(F.min(col).cast("long").alias("mn"), F.max(col).cast("long").alias("mx"))
    values = rng.select(F.explode(F.sequence("mn", "mx")).alias("value"))
    return values.join(counts, "value", "left").select("value", F.coalesce(F.col("count"), F.lit(0)).alias("count"))


def share(df: DataFrame, col: str) -> DataFrame:
    """#20: count and percent text (one decimal) per value.

    The total is a window sum over the grouped counts (one row per distinct
    value), not a second pass over the table.
    """
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    g = g.select(col, "count", (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("_frac"))
    return g.select(col, "count", percent_1dp(F.col("_frac")).alias("pct"))


def boxplot(df: DataFrame, group: str, col: str) -> DataFrame:
    """#21: five-number summary per group with 1.5 IQR whiskers, ranked by
    median (largest first). Quartiles are exact (linear interpolation); the
    whiskers are the extreme values inside the fences. The fences (one entry per
    group) are looked up in a map in the row, so only the aggregates shuffle."""
    v = F.col(col).cast("double")
    q = exact_quantiles(df, group, col)
    q = q.select(group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    q = q.select("*", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo_fence"),
                 (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi_fence"))
    names = ("q1", "median", "q3", "lo_fence", "hi_fence")
    known = q.where(F.col(group).isNotNull())
    fences = known.agg(F.map_from_entries(F.collect_list(F.struct(group, F.struct(*names))))).scalar()
    j = df.where(F.col(group).isNotNull()).select(group, v.alias("_v"), F.element_at(fences, F.col(group)).alias("_q"))
    j = j.select(group, "_v", "_q.*")
    inside = (F.col("_v") >= F.col("lo_fence")) & (F.col("_v") <= F.col("hi_fence"))
    w = j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"), F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("count"))
    return w.orderBy(F.desc("median"), group)


def mean_by(df: DataFrame, group: str, col: str) -> DataFrame:
    """#22: mean of ``col`` per group, largest first."""
    g = df.groupBy(group).agg(F.avg(col).alias("_m"))
    return g.select(group, py_round(F.col("_m"), 6).alias(f"mean_{col}")).orderBy(F.desc(f"mean_{col}"), group)


def correlation_matrix(df: DataFrame, features: list[str] = X.ENGINEERED_FEATURES) -> DataFrame:
    """#23: Pearson correlation of every feature pair below the diagonal, unpivoted to (feature_a, feature_b, r).

    One aggregate: the sums of the features and of their products, all shifted
    by some row's values so that large common offsets do not cancel. The
    features have no nulls; r is null where a feature does not vary.
    """
    shift = df.select(F.struct(*[F.col(c).cast("double").alias(c) for c in features])).limit(1).scalar()
    x = df.select(*[(F.col(c).cast("double") - shift[c]).alias(c) for c in features])
    pairs = [(a, b) for i, a in enumerate(features) for j, b in enumerate(features) if i >= j]
    g = x.agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(c) for c in features],
              *[F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs])

    def spread(a: str, b: str) -> Column:
        return F.col("n") * F.col(f"{a}__{b}") - F.col(a) * F.col(b)

    def correlation(a: str, b: str) -> Column:
        scale = F.sqrt(spread(a, a)) * F.sqrt(spread(b, b))
        return F.when((spread(a, a) > 0) & (spread(b, b) > 0), spread(a, b) / scale)

    rows = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), correlation(a, b).alias("r"))
                     for a, b in pairs if a != b])
    return g.select(F.inline(rows)).select("feature_a", "feature_b", py_round(F.col("r"), 6).alias("r"))


def word_frequency(df: DataFrame, text: str, k: int = 150) -> DataFrame:
    """#24: the ``k`` most frequent words of the whole corpus.

    Words are the a-z tokens of the cleaned text, two letters or more, minus
    Spark ML's English stop words (removed in-row against a literal list).
    Counting is a partial aggregate per word before the shuffle; the top-k is
    taken per partition and merged.
    """
    words = df.select(F.explode(F.split(X.clean_text(text), " ")).alias("word"))
    # isin over a long literal list becomes a hash-set lookup (InSet).
    words = words.where((F.length("word") >= 2) & ~F.col("word").isin(*english_stop_words()))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(F.desc("count"), "word").limit(k)


PRIORITIES = ["Critical", "High", "Medium", "Low"]


def crosstab(df: DataFrame, row: str, col: str, values: list[str] = PRIORITIES) -> DataFrame:
    """#25: row x column counts with a fixed column order, zeros filled."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).fillna(0, subset=values)


def corpus_summary(df: DataFrame, text: str, intent: str, category: str) -> DataFrame:
    """#26: one row: detected columns, rows, unique texts, class counts.

    Texts are counted by digest, classes from the table of their pairs: no text is expanded or shuffled.
    """
    pairs = df.groupBy(F.col(category).alias("_c"), F.col(intent).alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    texts = df.where(F.col(text).isNotNull()).select(text_digest(text).alias("_d")).distinct().agg(F.count(F.lit(1))).scalar()
    return pairs.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.count_distinct("_c").alias("num_categories"),
                     F.count_distinct("_i").alias("num_intents")).select(
        F.lit(text).alias("text_column"), F.lit(intent).alias("intent_column"), F.lit(category).alias("category_column"),
        "total_rows", texts.alias("unique_texts"), "num_categories", "num_intents")


def clean_corpus(df: DataFrame, text: str, key: str) -> DataFrame:
    """#27: drop NULL texts and duplicate texts, keeping the lowest key (which no two rows share).

    Digests and keys find the rows to drop: the first key of each repeated
    digest (combined before its shuffle, so a text in a third of all rows costs
    a row per task), then the other keys of these digests. Texts themselves
    move only if the rows to drop are too many for adaptive execution to send
    to every task.
    """
    checkpoint_dir(df.sparkSession)
    kept = df.where(F.col(text).isNotNull())
    rows = kept.select(F.col(key).alias("_key"), text_digest(text).alias("_d"))
    first = rows.groupBy("_d").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = first.checkpoint(eager=True)  # both sides of the join are then shuffles that can be split where a text is hot
    later = rows.join(first, "_d").where(F.col("_key") > F.col("_first")).select("_key")
    return kept.join(later, kept[key] == later["_key"], "left_anti").select(key, text, *[c for c in df.columns if c not in (text, key)])
