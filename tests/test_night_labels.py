"""The night_labels query hands its operator the overlaps."""

from copresence.operators import ml
from copresence.plans import registry

SF = "/root/testdata/sf0.001"


def test_days_with_a_confirmed_overlap_get_no_label(spark, monkeypatch):
    given = {}
    operator = ml.night_labels

    def kept(pings, overlaps, *rest):
        given["met"] = {r.date for r in overlaps.filter("tier = 'confirmed'").selectExpr("CAST(ts AS DATE) AS date").distinct().collect()}
        return operator(pings, overlaps, *rest)

    monkeypatch.setattr(ml, "night_labels", kept)
    labelled = {r.date for r in registry.QUERIES["night_labels"](spark, SF).collect()}
    assert given["met"] and not labelled & given["met"]


def test_confirmed_overlaps_rule_days_out_by_themselves(spark, monkeypatch):
    """Without overlaps the query has days that it has not with them."""
    folder = "/root/testdata/sf0.01"
    with_them = {r.date for r in registry.QUERIES["night_labels"](spark, folder).collect()}
    operator = ml.night_labels
    monkeypatch.setattr(ml, "night_labels", lambda pings, overlaps, *rest: operator(pings, overlaps.limit(0), *rest))
    without = {r.date for r in registry.QUERIES["night_labels"](spark, folder).collect()}
    assert with_them < without


def test_folds_are_fitted_at_the_same_time(spark, monkeypatch):
    import threading
    from datetime import date, timedelta

    from pyspark.sql import functions as F

    rows = [(date(2024, 1, 1) + timedelta(days=i), float(i % 7), float(i % 2)) for i in range(60)]
    features = spark.createDataFrame(rows, "date date, a double, b double")
    labels = features.select("date", F.when(F.col("b") == 1, "together").otherwise("apart").alias("label"))
    barrier, build = threading.Barrier(2), ml._classifier

    class Waits:
        def __init__(self, seed):
            self.inner = build(seed).setMaxIter(2)

        def fit(self, train):
            barrier.wait(60)  # both folds are here at once, or this breaks
            return self.inner.fit(train)

    monkeypatch.setattr(ml, "_classifier", Waits)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    found = ml.leave_one_group_out(features, labels, lambda d: F.dayofmonth(d) % 2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert found.count() == 60 and {r.date for r in found.collect()} == {r[0] for r in rows}
