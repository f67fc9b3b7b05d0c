"""Model training, comparison, cross-validation, report and persistence
(#9, #80, #83-#87, #96, #97).

Features are #76's exact TF-IDF weights (5000 terms) and the nine engineered
numbers, computed once over the corpus, as the reference's precomputed matrix;
labels are indexed alphabetically. The boosted models are ``boost``'s multiclass
histogram trees, which give class probabilities; the other families are Spark
ML's. ``TrainConfig`` has the reference's settings, which the registered queries
use.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..session import checkpoint_dir, scratch_path
from . import boost as B
from . import evaluate as EV
from . import terms as TM
from . import vectors as V

NUMERIC = X.ENGINEERED_FEATURES
LABELS = {"gbt_category": "category", "gbt_intent": "intent", "lr_baseline": "category", "gbt_priority": "predicted_priority"}
# FIXED VALUES: rounds, depth, step, hessian of a child, gain and L1 of each boosted model; 0.8 of rows and features, L2 of 1
BOOSTED = {
    "gbt_category": B.Boosting(rounds=300, depth=8, step=0.1, min_child=3.0, gamma=0.1, alpha=0.1),
    "gbt_intent": B.Boosting(rounds=400, depth=10, step=0.08, min_child=2.0, gamma=0.05, alpha=0.1),
    "gbt_priority": B.Boosting(rounds=200, depth=6, step=0.1, min_child=1.0, gamma=0.0, alpha=0.0),
}


@dataclass
class TrainConfig:
    max_terms: int = 5000
    forest_trees: int = 100
    forest_depth: int = 8
    lr_c: float = 1.0
    max_iter: int = 1000         # logistic regression, linear SVM and neural net
    hidden: int = 32
    ovr_parallelism: int = 8     # concurrent one-vs-rest fits
    seed: int = 42

    def boosting(self, name: str) -> B.Boosting:
        return BOOSTED[name]


def corpus_frame(corpus: DataFrame, text: str = "instruction") -> DataFrame:
    """Corpus + engineered features + urgency priority."""
    eng = X.with_features(TM.spread(corpus), text)
    return eng.withColumn("predicted_priority", X.priority_from_urgency(F.col("urgency_score")))


def fit_vocabulary(corpus: DataFrame, text: str = "instruction", max_terms: int = 5000) -> DataFrame:
    """(term, idx, idf) of #76 over the corpus: at most ``max_terms`` rows, checkpointed."""
    checkpoint_dir(corpus.sparkSession)
    n_docs = corpus.select(F.count(F.lit(1)).cast("double")).scalar()
    stats = TM.statistics(TM.spread(corpus.select(text)), text, 2)
    return V.with_idf(V.most_counted(stats, n_docs, max_terms, min_df=2, max_df=0.95), n_docs).checkpoint(eager=True)


def with_entries(rows: DataFrame, vocab: DataFrame, width: int, text: str = "instruction") -> DataFrame:
    """#80: ``rows`` (with the engineered numbers) and their sparse ``indices`` and ``values`` under a fitted vocabulary."""
    return V.sparse_entries(rows, text, vocab, NUMERIC, width)


def training_frame(corpus: DataFrame, cfg: TrainConfig, text: str = "instruction", vocab: DataFrame | None = None) -> DataFrame:
    """Id, class labels, sparse row (``indices``, ``values`` and the vector ``features``) and the 80/20 split flag of every corpus row, written once."""
    vocab = fit_vocabulary(corpus, text, cfg.max_terms) if vocab is None else vocab
    width = vocab.count()
    feats = with_entries(corpus_frame(corpus, text), vocab, width, text).select(
        "id", "indices", "values", "category", "intent", "predicted_priority")
    split = EV.stratified_split(corpus.select("id", "category"), "category", "id").select("id", "is_test")
    return V.write_vectors(feats.join(split, "id"), scratch_path(corpus.sparkSession, "features"), width + len(NUMERIC))


def width_of(tf: DataFrame) -> int:
    """Length of the feature vectors."""
    return tf.select("features").first()["features"].size


def logistic(cfg: TrainConfig, n_train: int):
    """sklearn-style C: minimise C * sum(loss) + ||w||^2 / 2  <=>  Spark's
    mean(loss) + regParam * ||w||^2 / 2 with regParam = 1 / (C * n)."""
    return LogisticRegression(family="multinomial", regParam=1.0 / (cfg.lr_c * max(n_train, 1)),
                              elasticNetParam=0.0, maxIter=cfg.max_iter, tol=1e-6)


def label_indexer(df: DataFrame, label: str):
    """Alphabetical label index; every label occurs in ``df``, so no unknown class is added."""
    return StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error").fit(df)


def coded(index, tf: DataFrame) -> DataFrame:
    return index.transform(tf).withColumn("label", F.col("label").cast("int"))


def boosted_fit(tf: DataFrame, label: str, p: B.Boosting):
    """(model, test predictions) of boosted trees learned from the training rows of ``tf``."""
    index = label_indexer(tf, label)
    rows = coded(index, tf).withColumn("fold", F.when(F.col("is_test"), 0).otherwise(-1))
    model, fitted = B.fit(rows, width_of(tf), len(index.labels), p, labels=list(index.labels))
    return model, _named(fitted.where("fold = 0"), "probabilities", index.labels)


def _named(pred: DataFrame, probabilities: str, labels) -> DataFrame:
    """(id, actual, predicted, probability) from coded labels and a probability array."""
    names = F.array(*[F.lit(x) for x in labels])
    p = F.col(probabilities)
    return pred.select("id", F.element_at(names, F.col("label").cast("int") + 1).alias("actual"),
                       F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")).alias("predicted"), p.alias("probability"))


def ml_fit(tf: DataFrame, label: str, make):
    """(model, test predictions) of a Spark ML classifier ``make(n_train)``."""
    index = label_indexer(tf, label)
    data = index.transform(tf).select("id", "features", "label", F.col(label).alias("actual"), "is_test").cache()
    try:
        train = data.where(~F.col("is_test"))
        model = make(train.count()).fit(train)
        names = F.array(*[F.lit(x) for x in index.labels])
        pred = model.transform(data.where("is_test"))
        pred = pred.withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1))
        keep = [vector_to_array("probability").alias("probability")] if "probability" in pred.columns else []
        pred = pred.select("id", "actual", "predicted", *keep).checkpoint(eager=True)
    finally:
        data.unpersist()
    return PipelineModel([index, model]), pred


def score(model, pred: DataFrame) -> dict:
    """A fitted model, its test predictions, and their accuracy, weighted F1, macro precision and recall."""
    counts = EV.per_class(EV.confusion_counts(pred)).collect()
    n = sum(r.support for r in counts)
    return {"model": model, "predictions": pred, "accuracy": sum(r.tp for r in counts) / n, "f1": sum(r.f1 * r.support for r in counts) / n,
            "precision": sum(r.precision for r in counts) / len(counts), "recall": sum(r.recall for r in counts) / len(counts)}


def fit_and_score(tf: DataFrame, name: str, cfg: TrainConfig) -> dict:
    """Fit one of ``LABELS`` on the training rows of ``tf`` and score its test rows."""
    if name in BOOSTED:
        return score(*boosted_fit(tf, LABELS[name], cfg.boosting(name)))
    return score(*ml_fit(tf, LABELS[name], lambda n: logistic(cfg, n)))


def metrics_frame(results: dict[str, dict], spark) -> DataFrame:
    return spark.createDataFrame([(k, float(v["accuracy"]), float(v["f1"])) for k, v in results.items()],
                                 "model string, accuracy double, f1 double")


def together(jobs: dict) -> dict:
    """Results of several fits of one frame: their Spark jobs are small and many, so they run at the same time."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = {name: pool.submit(inheritable_thread_target(job)) for name, job in jobs.items()}
        return {name: done.result() for name, done in running.items()}


def train_models(tf: DataFrame, cfg: TrainConfig, which: tuple[str, ...] = tuple(LABELS)) -> dict[str, dict]:
    """#83-#86: boosted category, intent and priority models, multinomial logistic baseline."""
    checkpoint_dir(tf.sparkSession)
    return together({name: partial(fit_and_score, tf, name, cfg) for name in which})


def algorithm_comparison(tf: DataFrame, cfg: TrainConfig) -> DataFrame:
    """#87: model families on one split, ranked by accuracy, with macro precision/recall and weighted F1."""
    spark = tf.sparkSession
    checkpoint_dir(spark)
    width = width_of(tf)
    n_labels = tf.select("category").distinct().count()
    families = {
        "random_forest": lambda n: RandomForestClassifier(numTrees=cfg.forest_trees, maxDepth=cfg.forest_depth, seed=cfg.seed),
        "linear_svm": lambda n: OneVsRest(classifier=LinearSVC(maxIter=cfg.max_iter, regParam=1.0 / max(n, 1), tol=1e-4),
                                          parallelism=cfg.ovr_parallelism),
        "neural_net": lambda n: MultilayerPerceptronClassifier(layers=[width, cfg.hidden, n_labels], maxIter=cfg.max_iter,
                                                               tol=1e-4, seed=cfg.seed),
        "logistic": lambda n: logistic(cfg, n),
    }
    jobs = {"boosted_trees": partial(fit_and_score, tf, "gbt_category", cfg)}
    jobs |= {name: (lambda make=make: score(*ml_fit(tf, "category", make))) for name, make in families.items()}
    results = together(jobs)
    rows = [(name, *(float(r[k]) for k in ("accuracy", "precision", "recall", "f1"))) for name, r in results.items()]
    df = spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double")
    # one row a family
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("accuracy"), "model")))


def cross_validate(tf: DataFrame, cfg: TrainConfig, k: int = 5, model: str = "gbt_category") -> DataFrame:
    """#96: stratified k-fold accuracy of a model per fold, mean and population std.

    As in the reference (cross-validation over the precomputed feature matrix),
    features are fitted once on the whole corpus. The boosted folds grow in the
    same passes over one binned matrix, each on the rows of the other folds.
    """
    spark = tf.sparkSession
    checkpoint_dir(spark)
    label = LABELS[model]
    folds = EV.kfold_assign(tf.select("id", label), label, "id", k=k).select("id", "fold")
    index = label_indexer(tf, label)
    data = coded(index, tf).join(folds, "id")
    if model in BOOSTED:
        _, fitted = B.fit(data, width_of(tf), len(index.labels), cfg.boosting(model), models=k)
        p = F.col("probabilities")
        hit = F.array_position(p, F.array_max(p)) - 1 == F.col("label")
        scores = fitted.where("fold = model").groupBy("fold").agg(F.avg(hit.cast("double")).alias("accuracy"))
    else:
        data = data.select("id", "features", "label", "fold").cache()
        rows = []
        try:
            for f in range(k):
                train = data.where(F.col("fold") != f)
                pred = logistic(cfg, train.count()).fit(train).transform(data.where(F.col("fold") == f))
                rows.append((f, float(pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])))
        finally:
            data.unpersist()
        scores = spark.createDataFrame(rows, "fold int, accuracy double")
    everything = Window.partitionBy()  # k rows
    return scores.select(F.col("fold").cast("int").alias("fold"), "accuracy", F.avg("accuracy").over(everything).alias("mean_accuracy"),
                         F.stddev_pop("accuracy").over(everything).alias("std"))


def probability_view(pred: DataFrame) -> DataFrame:
    """Top probability and top-2 gap from a model's ``probability`` array."""
    ps = F.sort_array("probability", False)
    return pred.select(F.element_at(ps, 1).alias("max_p"), (F.element_at(ps, 1) - F.element_at(ps, 2)).alias("gap"))


def model_report(results: dict[str, dict], cv: DataFrame, tf: DataFrame, intent_probabilities: DataFrame,
                 category_probabilities: DataFrame) -> DataFrame:
    """#97: one nested record: all models' metrics, cross-validation, misrouting risk,
    feature info, class lists, thresholds.

    The two probability frames have (max_p, gap) of the test rows under the
    intent and the category model.
    """
    models = F.struct(*[F.struct(F.lit(float(v["accuracy"])).alias("accuracy"), F.lit(float(v["f1"])).alias("f1"))
                        .alias(k) for k, v in results.items()])
    cvr = cv.agg(F.first("mean_accuracy").alias("mean_accuracy"), F.first("std").alias("std"),
                 F.sort_array(F.collect_list(F.struct("fold", "accuracy"))).alias("folds"))
    cat = EV.low_confidence_rates(category_probabilities)
    intent = EV.low_confidence_rates(intent_probabilities, L.INTENT_CONFIDENCE_THRESHOLD)
    levels = EV.risk_distribution(category_probabilities).select(
        F.map_from_entries(F.collect_list(F.struct("risk_level", "count"))))
    risk = F.struct(cat.select("low_confidence_pct").scalar().alias("low_confidence_category_pct"),
                    intent.select("low_confidence_pct").scalar().alias("low_confidence_intent_pct"),
                    cat.select("ambiguous_pct").scalar().alias("ambiguous_tickets_pct"),
                    levels.scalar().alias("risk_distribution"))
    n_text = width_of(tf) - len(NUMERIC)
    return cvr.select(
        models.alias("models"),
        F.struct("mean_accuracy", "std", "folds").alias("cross_validation"),
        risk.alias("misrouting_risk"),
        F.struct(F.lit(n_text).alias("tfidf_features"),
                 F.array(*[F.lit(x) for x in NUMERIC]).alias("engineered_features"),
                 F.lit(n_text + len(NUMERIC)).alias("total_features")).alias("feature_info"),
        tf.select(F.sort_array(F.collect_set("category"))).scalar().alias("categories"),
        tf.select(F.sort_array(F.collect_set("intent"))).scalar().alias("intents"),
        tf.select(F.sort_array(F.collect_set("predicted_priority"))).scalar().alias("priorities"),
        F.struct(F.lit(L.CATEGORY_CONFIDENCE_THRESHOLD).alias("category_confidence"),
                 F.lit(L.INTENT_CONFIDENCE_THRESHOLD).alias("intent_confidence"),
                 F.lit(L.AMBIGUITY_MIN_GAP).alias("ambiguity_gap"),
                 F.lit(L.FORMULA_RISK_HIGH).alias("risk_high"),
                 F.lit(L.FORMULA_RISK_MEDIUM).alias("risk_medium")).alias("thresholds"),
    )


def save_model(model, vocab: DataFrame, path: str) -> None:
    """#9: persist a fitted model (label index and classifier, or boosted trees) with the vocabulary its features need."""
    if isinstance(model, B.Boosted):
        model.save(vocab.sparkSession, f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")


def load_model(spark, path: str, boosted: bool = False) -> tuple:
    """#9: (model, vocabulary) saved by ``save_model``."""
    model = B.Boosted.load(spark, f"{path}/model") if boosted else PipelineModel.load(f"{path}/model")
    return model, spark.read.parquet(f"{path}/vocabulary")


def labels_of(model) -> list[str]:
    return list(model.labels if isinstance(model, B.Boosted) else model.stages[0].labels)


def predict(rows: DataFrame, model, vocab: DataFrame, key: str, text: str) -> DataFrame:
    """``rows`` with the loaded classifier's probability array ``_probabilities`` (labels in index order)."""
    width = vocab.count()
    wide = with_entries(X.with_features(TM.spread(rows), text), vocab, width, text).select(*rows.columns, "indices", "values")
    if isinstance(model, B.Boosted):
        return model.probabilities(wide).drop("indices", "values")
    wide = V.write_vectors(wide, scratch_path(rows.sparkSession, "features"), width + len(NUMERIC))
    return model.stages[-1].transform(wide).select(*rows.columns, vector_to_array("probability").alias("_probabilities"))
