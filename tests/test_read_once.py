"""What an analysis or a stream is made of is run once, however many results start there."""

from pyspark.sql import functions as F

from copresence.config import Config
from copresence.functions.rules import MICROS_HOUR, micros
from copresence.operators import clean, ml
from copresence.plans.analysis import Analysis
from copresence.sources.pings import event_pings
from copresence.streaming import run


def _counted(spark, rows):
    """rows, and an accumulator of how many of them have been made."""
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    return rows.withColumn("lat", F.udf(count, "double").asNondeterministic()("lat")), made


def _pings(spark, n=400):
    ts = F.expr("timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT) * 10)")
    return spark.range(n).select(
        F.col("id").alias("ping_id"), (F.col("id") % 2 + 1).cast("int").alias("person"), ts.alias("ts"), micros(ts).alias("us"), F.lit(10).alias("accuracy"),
        F.lit(50.85).alias("lat"), F.lit(5.7).alias("lon"),
    )


def test_raw_pings_are_read_once(spark):
    raw, made = _counted(spark, _pings(spark))
    analysis = Analysis(raw, Config(start_date="2024-01-01"))
    labels = analysis.trusted.select(F.to_date("ts").alias("date"), F.lit("together").alias("label")).distinct()
    assert ml.labelled_rows(analysis.features, labels).count() > 0 and analysis.homes.count() == 2 and analysis.raw_overlaps.count() > 0
    assert made.value == 400
    analysis.close()


def test_replayed_rows_are_made_once(spark):
    rows, made = _counted(spark, _pings(spark).drop("ts"))
    stream = run.replayed(rows, heartbeat=({"person": 0, "ping_id": -1, "lat": 0.0, "lon": 0.0}, MICROS_HOUR))
    assert run.drained(stream).filter("person > 0").count() == 400 and made.value == 400


def test_a_stored_side_of_a_stream_is_made_once(spark):
    side, made = _counted(spark, spark.createDataFrame([(1, 50.0), (2, 51.0)], "person int, lat double"))
    stream = run.replayed(_pings(spark).select("person", "ping_id", "us"))
    assert run.drained(stream.join(run.stored(side), "person")).count() == 400 and made.value == 2


def test_an_analysis_with_tables_reads_raw_pings_once_and_keeps_plans_short(spark):
    raw, made = _counted(spark, _pings(spark))
    config = Config(start_date="2024-01-01")
    whole, analysis = Analysis(_pings(spark), config), Analysis(raw, config, tables=True)
    day = F.to_date("ts").alias("date")
    analysis.given_labels = run.stored(analysis.trusted.select(day, F.lit("together").alias("label")).distinct())
    rows = ml.labelled_rows(analysis.features, analysis.given_labels)
    assert _relations(rows) == 2 and _relations(analysis.filled) == 1 < _relations(whole.filled)
    assert sorted(analysis.features.collect()) == sorted(whole.features.collect()) and rows.count() > 0 and analysis.raw_overlaps.count() > 0
    assert made.value == 400
    analysis.close(), whole.close()


def test_an_analysis_with_tables_drops_jitter_once(spark, monkeypatch):
    made = []

    def counted(pings, drop=clean.drop_jitter):
        rows, n = _counted(spark, drop(pings))
        made.append(n)
        return rows

    monkeypatch.setattr(clean, "drop_jitter", counted)
    analysis = Analysis(_pings(spark), Config(start_date="2024-01-01"), tables=True)
    analysis.given_labels = run.stored(analysis.trusted.select(F.to_date("ts").alias("date"), F.lit("together").alias("label")).distinct())
    assert analysis.features.count() > 0 and analysis.raw_overlaps.count() > 0 and analysis.labels.count() > 0
    assert [n.value for n in made] == [400]


def _relations(rows):
    """How many tables a plan reads, one that is read again counted again."""
    return sum(x.startswith(("Relation", "Range")) for line in rows._jdf.queryExecution().analyzed().toString().split("\n") for x in [line.lstrip(" :+-")])


def test_the_derivation_of_pings_is_not_copied_into_filters(spark, tmp_path):
    ts = F.expr("timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT) * 10)")
    events = spark.range(300).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 2).alias("user_id"), F.lit("view").alias("event_type"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    usable = clean.usable(event_pings(spark, str(tmp_path)), "2024-01-01")
    assert usable._jdf.queryExecution().optimizedPlan().toString().count("% 97") == 1
    assert usable.columns == ["ping_id", "person", "ts", "accuracy", "lat", "lon", "us"] and usable.count() == 300
