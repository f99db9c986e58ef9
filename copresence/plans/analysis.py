"""The whole analysis as one lazy plan: every attribute is a DataFrame that is only run where it is used. With tables between its steps it is
a chain of short plans instead."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copresence.config import Config
from copresence.operators import clean, datasets, features, joins, matrix, metrics, ml, presence
from copresence.session import stored
from copresence.sources.photos import photo_labels


class Analysis:
    """From raw pings(ping_id, person, ts, us, accuracy, lat, lon) of persons 1 and 2 to days together; with labels(date, label), and photos
    if there are any, also to a classifier of days and the ensemble of rules and model. close() gives up what is cached.

    tables: what is kept is written to the folder that driver and executors share when it is first asked for, and read from there. A plan of
    cached rows holds all that they are made of once for each time they are used, so that of day features reads the pings many times
    over: no task does so, but whatever is planned behind it does, and a report or a fit plans a lot."""

    def __init__(self, pings: DataFrame, config: Config = Config(), labels: DataFrame | None = None, photos: DataFrame | None = None, threshold: float = 0.7, tables: bool = False):
        self.raw, self.config, self.given_labels, self.photos, self.threshold, self.tables = pings, config, labels, photos, threshold, tables
        self._cached: list[DataFrame] = []

    def _kept(self, rows: DataFrame) -> DataFrame:
        """rows in the cache: bounded by the days of the observation, and what an executor takes with it is computed anew; or as a table."""
        if self.tables:
            return stored(rows)
        self._cached.append(rows.cache())
        return rows

    def close(self) -> None:
        for rows in self._cached:
            rows.unpersist()
        self._cached.clear()

    @cached_property
    def deduplicated(self) -> DataFrame:
        """Everything else starts here, many times over: raw pings are read and deduplicated once, and at most 720 a person and day are kept."""
        return self._kept(clean.dedup_2min(clean.usable(self.raw, self.config.start_date)))

    @cached_property
    def pings(self) -> DataFrame:
        """Without noise, with radii. Homes, stays, speeds, labels and the period start here, so with tables they are made once."""
        tagged = clean.tag_radius(clean.drop_jitter(self.deduplicated))
        return stored(tagged) if self.tables else tagged

    @cached_property
    def homes(self) -> DataFrame:
        return presence.home_cells(self.pings, self.config)

    @cached_property
    def overnight(self) -> DataFrame:
        """Pings and overnight stays; a person has a bounded number a day. Legs and made-up pings start here."""
        return self._kept(presence.with_overnight(self.pings, self.homes, self.config))

    @cached_property
    def filled(self) -> DataFrame:
        """Pings, overnight stays and presence in gaps, which most results use several times over."""
        return self._kept(self.overnight.unionByName(presence.made_up_between(self.legs), allowMissingColumns=True))

    @cached_property
    def raw_overlaps(self) -> DataFrame:
        return self._kept(joins.raw_overlaps(self._kept(clean.with_speed(self.pings)), self.config))

    @cached_property
    def legs(self) -> DataFrame:
        return self._kept(clean.segments(self.overnight, self.config.travel_max_gap_hours))

    @cached_property
    def overlaps(self) -> DataFrame:
        """At most one in 15 minutes, so they are cached like the pings."""
        return self._kept(joins.fine_overlaps(self.legs, self.config))

    @cached_property
    def trusted(self) -> DataFrame:
        return joins.trusted(self.overlaps, self.config)

    @cached_property
    def matrix(self) -> DataFrame:
        """Every hour from the start date to the day of the last overlap."""
        last = metrics.bounds_of(self.config, self.overlaps).withColumn("end", F.coalesce("end", "start"))
        return matrix.presence_matrix(self.filled, self.overlaps, last, self.config)

    @cached_property
    def features(self) -> DataFrame:
        return self._kept(features.day_features(self.filled, self.overlaps, self.photos))

    @cached_property
    def labels(self) -> DataFrame:
        """Given labels, then days with photos, then nights apart."""
        if self.given_labels is None:
            raise ValueError("an analysis without labels has no classifier")
        known = self.given_labels.select("date", "label")
        if self.photos is not None:
            known = ml.merge_labels(known, photo_labels(self.photos))
        period = metrics.days(self.pings).agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        apart = ml.night_labels(self.pings, self.overlaps, known, self.config, str(period.a), str(period.b)) if period.a else known.limit(0)
        return self._kept(ml.merge_labels(known, apart))

    @cached_property
    def classifier(self):
        """The fitted model, or None where labels hold one class only."""
        return ml.fit(self.features, self.labels)

    @cached_property
    def cross_validation(self) -> DataFrame:
        """Each labelled day predicted without its month."""
        return ml.leave_one_group_out(self.features, self.labels)

    @cached_property
    def predictions(self) -> DataFrame:
        return ml.attach_cv(ml.predict_all(self.classifier, self.features, self.labels), self.cross_validation)

    @cached_property
    def ensemble(self) -> DataFrame | None:
        """(date, state) of rules and model; None without labels, or without a model."""
        if self.given_labels is None or self.classifier is None:
            return None
        scored = ml.predict_all(self.classifier, self.features, self.labels)
        return self._kept(ml.ensemble(self.filled, self.trusted, scored, self.threshold))

    def charts(self) -> dict[str, DataFrame]:
        """The dataset of each chart, with the ensemble where there is one."""
        hours = self.matrix if self.ensemble is None else matrix.overlay(self.matrix, self.ensemble)
        return {
            "calendar_raw": datasets.calendar(self.filled, self.raw_overlaps, self.config),
            "calendar_interpolated": datasets.calendar(self.filled, self.overlaps, self.config),
            "hourly_matrix": matrix.with_codes(matrix.fill_dense_days(hours)),
            "monthly_summary": metrics.month_coverage(self.filled, self.overlaps, self.config),
            "interactive_map": datasets.map_cells(self.overlaps),
            "map_pyramid": datasets.map_pyramid(self.overlaps),
            "confidence_timeline": datasets.density(self.filled, self.overlaps, self.config),
            "day_calendar": datasets.day_states(self.filled, self.trusted, self.ensemble, self.config),
        }

    def days_together(self) -> DataFrame:
        """(date, n): dates with trusted overlaps, and how many."""
        return self.trusted.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
