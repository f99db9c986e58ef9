"""Labels, the day classifier, its evaluation and the ensemble of rules and model."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copresence.config import Config
from copresence.functions.geo import fast_distance
from copresence.functions.rules import MICROS_DAY, MICROS_HOUR, label_to_binary, month_of
from copresence.operators.features import feature_names
from copresence.operators.metrics import days
from copresence.operators.presence import home_cells


#: Groups of days that are fitted at the same time.
FOLDS_AT_ONCE = 4


def merge_labels(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels, and those of `more` on dates that have none."""
    return labels.select("date", "label").unionByName(more.join(labels, "date", "left_anti").select("date", "label"))


def night_labels(pings: DataFrame, overlaps: DataFrame, labels: DataFrame, config: Config, start: str, end: str, radius_m: float = 500.0) -> DataFrame:
    """(date, label): 'apart' for unlabelled days of a period without a confirmed overlap, on whose night both were at their own
    homes, if those are 5 km apart or more."""
    c = F.col
    day = lambda x: F.lit(x).cast("date")
    night_hours = Config(night_from=22, night_to=6)
    period = pings.filter(F.to_date("ts").between(day(start), day(end)))
    homes = home_cells(period, night_hours, digits=3, least=5)
    one, two = (homes.filter(c("person") == p).select(c("home_lat").alias(f"la{p}"), c("home_lon").alias(f"lo{p}")) for p in (1, 2))
    apart = one.join(two, fast_distance(c("la1"), c("lo1"), c("la2"), c("lo2")) >= 5000)
    # a ping from 22:00 on counts for its own date, one up to 06:00 for the date before
    since = F.pmod(c("us"), F.lit(MICROS_DAY))
    date = F.when(since >= 22 * MICROS_HOUR, F.to_date("ts")).when(since <= 6 * MICROS_HOUR, F.date_sub(F.to_date("ts"), 1))
    near = pings.withColumn("date", date).filter("date IS NOT NULL").join(F.broadcast(apart))
    home = F.when(c("person") == 1, fast_distance(c("lat"), c("lon"), c("la1"), c("lo1"))).otherwise(fast_distance(c("lat"), c("lon"), c("la2"), c("lo2")))
    slept = near.filter(home <= radius_m).groupBy("date").agg(F.count_distinct("person").alias("n")).filter("n = 2")
    met = days(overlaps.filter("tier = 'confirmed'"))
    free = slept.filter(c("date").between(day(start), day(end))).join(met, "date", "left_anti").join(labels, "date", "left_anti")
    return free.select("date", F.lit("apart").alias("label"))


def _assembled(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=feature_names(rows.drop("label", "y")), outputCol="features").transform(rows)


def _classifier(seed: int):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(labelCol="y", maxIter=100, maxDepth=3, stepSize=0.1, minInstancesPerNode=5, subsamplingRate=0.8, seed=seed)


def _scored(model, rows: DataFrame, name: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select("date", F.round(vector_to_array("probability")[1], 6).alias(name))


def labelled_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    return _assembled(features).join(labels.select("date", "label"), "date").withColumn("y", label_to_binary(F.col("label")).cast("double"))


def leave_one_group_out(features: DataFrame, labels: DataFrame, group: Callable[[Column], Column] = month_of, seed: int = 42) -> DataFrame:
    """(date, y, cv_probability): each labelled day predicted without its group of days, months as a rule. Groups whose rest holds one
    class only are left out. Groups are fitted side by side, each as Spark jobs of its own thread, on one cached table of labelled days,
    which is given up once all are fitted."""
    rows = _in_one_task(labelled_rows(features, labels).select("date", "y", "features", group(F.col("date")).alias("part"))).cache()
    try:
        counts = rows.groupBy("part", "y").count().collect()
        parts = sorted({r.part for r in counts})
        fits = [p for p in parts if len({r.y for r in counts if r.part != p}) == 2]

        def fitted(part):
            return part, _classifier(seed).fit(rows.filter(F.col("part") != part))

        with ThreadPool(max(1, min(FOLDS_AT_ONCE, len(fits)))) as pool:
            models = pool.map(inheritable_thread_target(rows.sparkSession)(fitted), fits)
    finally:
        rows.unpersist()
    out = None
    for part, model in models:
        test = rows.filter(F.col("part") == part)
        scored = test.select("date", "y").join(_scored(model, test, "cv_probability"), "date")
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else rows.select("date", "y", F.lit(None).cast("double").alias("cv_probability")).limit(0)


def _in_one_task(rows: DataFrame) -> DataFrame:
    """A row a day, in order: the many small jobs of a fit stay small. What the rows are made of still runs in parallel."""
    return rows.repartition(1).sortWithinPartitions("date")


def metrics_of(scored: DataFrame, truth: str = "y", probability: str = "cv_probability", threshold: float = 0.5) -> DataFrame:
    """Confusion counts, precision, recall and F1 of the positive class, in one row."""
    said, is_ = F.col(probability) >= threshold, F.col(truth) == 1
    n = lambda when, name: F.count_if(when).alias(name)
    counts = scored.agg(n(said & is_, "tp"), n(said & ~is_, "fp"), n(~said & is_, "fn"), n(~said & ~is_, "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": F.round(ratio(tp, tp + fp), 6), "recall": F.round(ratio(tp, tp + fn), 6), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 6),
    })


def fit(features: DataFrame, labels: DataFrame, seed: int = 42):
    """The classifier on all labelled days, or None if they hold one class only. There is a row a day, so one task holds them, and the
    many small jobs of the fit stay small."""
    rows = _in_one_task(labelled_rows(features, labels).select("date", "y", "features")).cache()
    try:
        return _classifier(seed).fit(rows) if rows.select("y").distinct().count() == 2 else None
    finally:
        rows.unpersist()


def rule_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    """The rule for every day, next to the label."""
    rows = features.select("date", "n_overlaps", F.round("min_distance_m", 6).alias("min_distance_m"))
    return rows.join(labels.select("date", F.col("label").alias("true_label")), "date", "left").select(
        "date", (F.col("n_overlaps") > 0).cast("int").alias("rule_based"), F.coalesce("true_label", F.lit("unknown")).alias("true_label"), "n_overlaps", "min_distance_m"
    )


def predict_all(model, features: DataFrame, labels: DataFrame) -> DataFrame:
    """Model and rule for every day, next to the label."""
    scored = _scored(model, _assembled(features), "ml_probability")
    return rule_rows(features, labels).join(scored, "date").withColumn("ml_prediction", (F.col("ml_probability") >= 0.5).cast("int"))


def attach_cv(predictions: DataFrame, cv: DataFrame) -> DataFrame:
    """predictions with the out-of-fold probability and prediction of labelled days."""
    return predictions.join(cv.select("date", "cv_probability"), "date", "left").withColumn("cv_prediction", (F.col("cv_probability") >= 0.5).cast("int"))


def comparison(predictions: DataFrame) -> DataFrame:
    """Rule against model against label: (date, kind) of disagreements, errors and uncertain days."""
    c = F.col
    known, truth = c("true_label") != "unknown", label_to_binary(c("true_label"))
    kinds = {
        "disagreement": c("ml_prediction") != c("rule_based"), "false_positive": known & (c("ml_prediction") == 1) & (truth == 0),
        "false_negative": known & (c("ml_prediction") == 0) & (truth == 1), "uncertain": c("ml_probability").between(0.3, 0.7),
    }
    found = F.array_compact(F.array(*(F.when(when, F.lit(k)) for k, when in kinds.items())))
    return predictions.select("date", F.explode(found).alias("kind"))


def importances(model, features: DataFrame, most: int = 15) -> DataFrame:
    """The features that matter most."""
    pairs = [(n, float(v)) for n, v in zip(feature_names(features), model.featureImportances.toArray(), strict=True)]
    return features.sparkSession.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(most)


def ensemble(pings: DataFrame, trusted_overlaps: DataFrame, predictions: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(date, state) of every date with a ping: together by rule, else by the model, else apart, else no data."""
    c = F.col
    p = c("person")
    tracked = pings.groupBy(F.to_date("ts").alias("date")).agg(F.max(p == 1).alias("d1"), F.max(p == 2).alias("d2"))
    met = days(trusted_overlaps).withColumn("met", F.lit(True))
    rows = tracked.join(met, "date", "left").join(predictions.select("date", "ml_probability"), "date", "left")
    both = c("d1") & c("d2")
    state = F.when(both & c("met"), "together").when(both & (c("ml_probability") >= threshold), "ml_together").when(both, "apart").otherwise("no_data")
    return rows.select("date", state.alias("state"))
