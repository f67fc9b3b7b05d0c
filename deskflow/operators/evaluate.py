"""Splits and evaluation of class predictions (#82, #88-#95).

Per-class ranks for the stratified split and folds are computed without a
per-class window: rows are range-partitioned on (class, order key), so a
dominant class is spread over many tasks; one small job counts rows per
(partition, class), and every row gets offset + position. Metrics are a
confusion-count aggregate followed by arithmetic on at most classes^2 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import routing as R
from ..functions.formatting import py_round
from ..session import checkpoint_dir

SEED = 42


def order_key(id_col: str, seed: int = SEED) -> Column:
    """Deterministic shuffle key: md5('<seed>-<id>')."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def rank_within_class(df: DataFrame, cls: str, id_col: str, seed: int = SEED,
                      partitions: int | None = None) -> DataFrame:
    """Adds ``class_rank`` (1-based, by md5 order then id) and ``class_size``.

    Range partitioning on (class, key, id) splits a large class across
    partitions; per-(partition, class) counts -- a table of at most
    partitions x classes rows -- give each partition's offset within its class.
    The partitioned frame is checkpointed so both passes see the same rows.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    k = df.withColumn("_key", order_key(id_col, seed))
    by = (cls, "_key", id_col)  # without a count, adaptive execution sizes the partitions
    ordered = (k.repartitionByRange(partitions, *by) if partitions else k.repartitionByRange(*by)).sortWithinPartitions(cls, "_key", id_col)
    ordered = ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    ordered = ordered.checkpoint(eager=True)
    parts = ordered.groupBy("_pid", cls).agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    w = Window.partitionBy(cls).orderBy("_pid")
    parts = parts.select(
        "_pid", cls, "_first",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(cls)).alias("class_size"))
    j = ordered.join(parts, ["_pid", cls])
    return j.withColumn("class_rank", F.col("_off") + (F.col("_mono") - F.col("_first")) + 1) \
        .drop("_pid", "_mono", "_first", "_off", "_key")


def stratified_split(df: DataFrame, cls: str, id_col: str, test_fraction_pct: int = 20,
                     seed: int = SEED) -> DataFrame:
    """#82: ``is_test`` for the first ceil(pct % of the class) rows of each class."""
    r = rank_within_class(df, cls, id_col, seed)
    n_test = F.floor((F.col("class_size") * test_fraction_pct + 99) / 100)
    return r.withColumn("is_test", F.col("class_rank") <= n_test)


def kfold_assign(df: DataFrame, cls: str, id_col: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """#95: fold = (rank within class - 1) mod k -- stratified, shuffled, seeded."""
    r = rank_within_class(df, cls, id_col, seed)
    return r.withColumn("fold", ((F.col("class_rank") - 1) % k).cast("int"))


def predict_argmax(probs: DataFrame, key: str = "ticket_id") -> DataFrame:
    """#88: top label (ties to the first label in class order), its probability
    rounded to 4 places, the top-2 gap and all probabilities as a map."""
    top = F.min(F.struct((-F.col("p")).alias("neg_p"), F.col("label").alias("label")))
    g = probs.groupBy(key).agg(
        top.alias("_top"),
        F.sort_array(F.collect_list("p"), False).alias("_ps"),
        F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("probabilities"))
    g = g.select(key, F.col("_top.label").alias("predicted"), (-F.col("_top.neg_p")).alias("max_p"),
                 R.top2_gap(F.col("_ps")).alias("gap"), "probabilities")
    return g.select("*", py_round(F.col("max_p"), 4).alias("confidence"))


def confusion_counts(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n) for the pairs that occur.

    At most classes^2 rows, used several times by every metric; it is
    checkpointed once (shared folder) so the prediction pipeline underneath is
    not recomputed for each use and the lineage survives executor loss.
    """
    checkpoint_dir(pred.sparkSession)
    return pred.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)


def per_class(conf: DataFrame) -> DataFrame:
    """Support, true positives and predicted count per label (zero-division -> 0)."""
    a = conf.groupBy(F.col("actual").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("tp"))
    p = conf.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("npred"))
    j = a.join(p, "label", "full").select(
        "label", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("npred", F.lit(0)).alias("npred"))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    j = j.select("*", prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return j.select("*", f1.alias("f1"))


def accuracy_f1(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """#89: accuracy and support-weighted F1 (one row)."""
    pc = per_class(confusion_counts(pred, actual, predicted))
    g = pc.agg(F.sum("tp").alias("_tp"), F.sum("support").alias("_n"),
               F.sum(F.col("f1") * F.col("support")).alias("_wf1"))
    return g.select(py_round(F.col("_tp") / F.col("_n"), 6).alias("accuracy"),
                    py_round(F.col("_wf1") / F.col("_n"), 6).alias("f1_weighted"))


def classification_report(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """#90: precision, recall, F1, support per label, plus macro and weighted rows."""
    pc = per_class(confusion_counts(pred, actual, predicted))
    rows = pc.select("label", "precision", "recall", "f1", "support")
    macro = pc.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    tot = F.sum("support")
    weighted = pc.agg(F.lit("weighted avg").alias("label"),
                      (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.alias("support"))
    out = rows.unionByName(macro).unionByName(weighted)
    return out.select("label", *[py_round(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def confusion_matrix(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """#91: actual x predicted counts for every pair of labels, zeros filled.

    The label grid is built by exploding the (bounded) label list on each
    label row -- an explode, not a cross join -- then joined to the counts.
    """
    c = confusion_counts(pred, actual, predicted)
    labels = c.select(F.col("actual").alias("l")).union(c.select(F.col("predicted").alias("l"))).distinct()
    all_labels = labels.select(F.sort_array(F.collect_list("l"))).scalar()
    grid = labels.select(F.col("l").alias("actual"), F.explode(all_labels).alias("predicted"))
    return grid.join(c, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce(F.col("n"), F.lit(0)).alias("count"))


def confidence_histogram(pred: DataFrame, col: str = "max_p", bins: int = 50,
                         threshold: float = L.CATEGORY_CONFIDENCE_THRESHOLD) -> DataFrame:
    """#92: equal-width histogram of the top probability between its min and
    max (last bin closed), with the triage threshold and each bin's side."""
    st = pred.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).select(F.struct("mn", "mx")).scalar()
    mn, mx = st["mn"], st["mx"]
    v = F.col(col)
    b = F.when(mx == mn, F.lit(bins // 2)).otherwise(
        F.least(F.lit(bins - 1), F.floor((v - mn) / (mx - mn) * bins).cast("int")))
    counts = pred.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = pred.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), mn.alias("mn"), mx.alias("mx"))
    width = (F.col("mx") - F.col("mn")) / bins
    return edges.join(counts, "bin", "left").select(
        "bin", (F.col("mn") + F.col("bin") * width).alias("lo"), (F.col("mn") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"), F.lit(threshold).alias("threshold"))


def low_confidence_rates(pred: DataFrame, threshold: float = L.CATEGORY_CONFIDENCE_THRESHOLD,
                         gap_threshold: float = L.AMBIGUITY_MIN_GAP) -> DataFrame:
    """#93: percent of predictions below the confidence threshold and percent
    whose top-2 gap is below 0.15."""
    return pred.agg(
        (F.avg(F.when(F.col("max_p") < threshold, 1.0).otherwise(0.0)) * 100).alias("_lc"),
        (F.avg(F.when(F.col("gap") < gap_threshold, 1.0).otherwise(0.0)) * 100).alias("_amb"),
    ).select(py_round(F.col("_lc"), 6).alias("low_confidence_pct"), py_round(F.col("_amb"), 6).alias("ambiguous_pct"))


def risk_distribution(pred: DataFrame) -> DataFrame:
    """#94: count and percent per formula risk level (#46)."""
    risk, level = R.risk_formula(F.col("max_p"), F.col("gap"))
    g = pred.select(level.alias("risk_level")).groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))
    g = g.select("risk_level", "count", (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("_f"))
    return g.select("risk_level", "count", py_round(F.col("_f") * 100, 6).alias("pct"))
