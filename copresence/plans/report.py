"""The text report, from a few one-row results."""

from __future__ import annotations

from copresence.operators import metrics
from copresence.plans.analysis import Analysis

RULE = "-" * 80


def _section(title: str, *lines: str) -> list[str]:
    return [title, RULE, *lines, ""]


def _one(rows) -> dict:
    found = rows.first()
    return found.asDict() if found else {}


def report(analysis: Analysis, file_metadata=None) -> str:
    """All sections, joined by newlines. Only aggregates come to the driver."""
    config = analysis.config
    raw, fine = _one(metrics.overlap_stats(analysis.raw_overlaps)), _one(metrics.overlap_stats(analysis.overlaps))
    tracked = _one(metrics.tracked_metrics(analysis.filled, analysis.trusted, config))
    home = _one(metrics.residence(analysis.trusted))
    months = metrics.monthly_summary(analysis.trusted).orderBy("month").collect()
    files = file_metadata.orderBy("file").collect() if file_metadata is not None else []
    out = ["=" * 80, "LOCATION HISTORY: CO-LOCATION REPORT", "=" * 80, f"Analysis period: from {config.start_date} onwards", ""]
    out += _section(
        "SUMMARY",
        f"Tracked days: {tracked['total_tracked_days']}, together on {tracked['days_together']} ({tracked['pct_days_together']}%)",
        f"Tracked nights: {tracked['total_tracked_nights']}, together on {tracked['nights_at_shared_address']} ({tracked['pct_nights_together']}%)",
        f"Covered: {tracked['date_range_start']} to {tracked['date_range_end']}; days with one person only: {tracked['total_gap_days']}",
    )
    out += _section("DATA SOURCES", *(f"{r.file}: {r.records} records, {r.first} to {r.last}, SHA-256 {r.file_hash}" for r in files))
    out += _section(
        "METHOD",
        f"Distance threshold {config.distance_m:g} m, time threshold {config.time_minutes} minutes, legs of at most {config.travel_max_gap_hours:g} hours.",
        "Overlaps at home count when confirmed; elsewhere all count.",
    )
    for title, s in (("RAW OVERLAPS", raw), ("OVERLAPS WITH PRESENCE BETWEEN REPORTS", fine)):
        out += _section(title, f"{s['total_colocations']} overlaps on {s['unique_days']} days, {s['nights_together']} nights; mean distance {s['avg_distance_m']} m")
    if home:
        out += _section("SHARED RESIDENCE", f"Near {home['lat']:.2f}, {home['lon']:.2f}: {home['nights']} nights from {home['first_date']} to {home['last_date']}")
    out += _section("KEY DATES", *(f"{k.replace('_', ' ').title()}: {v}" for k, v in config.key_dates.items()))
    out += _section("BY MONTH", *(f"{r.month}: {r.total_colocations} overlaps, {r.unique_days} days, {r.nights} nights" for r in months))
    if analysis.ensemble is not None:
        days = _one(metrics.ensemble_counts(analysis.ensemble, config))
        total = days["together"] + days["ml_together"]
        share = f" ({100 * total / days['tracked']:.1f}%)" if days["tracked"] else ""
        out += _section("RULES AND MODEL", f"Together on {total} of {days['tracked']} days with both tracked{share}: {days['together']} by rule, {days['ml_together']} by the model alone.")
    out += _section("CONCLUSION", f"Together on {tracked['days_together']} of {tracked['total_tracked_days']} days on which both were tracked.")
    return "\n".join(out)
