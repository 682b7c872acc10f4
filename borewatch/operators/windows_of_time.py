"""Time-window summaries of telemetry, for one well or for every alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borewatch.functions.severity import round_settled, round_tie_even
from borewatch.operators.ordering import DEFAULT_BLOCK_ROWS, HALO, KeyedSeries, join_null_safe
from borewatch.schema import FEATURES
from borewatch.session import cut_lineage


def in_window(telemetry: DataFrame, well: str, end: Column, hours_back: int = 72) -> DataFrame:
    """Readings of a well in [end - hours, end] (F2)."""
    start = end - F.make_interval(hours=F.lit(hours_back))
    return telemetry.filter((F.col("well_id") == well) & F.col("timestamp").between(start, end))


def summarise_before(
    alerts: DataFrame,
    telemetry: DataFrame,
    order: list[str],
    features: list[str] = FEATURES,
    hours_back: int = 72,
    key: str = "well_id",
    ts: str = "timestamp",
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Per alert and feature: mean, population deviation, minimum, maximum, trend of the hours before.

    Alerts are laid into the timeline of their well as two marks, where their window begins and ends; the readings up to a
    mark are a running count, so a window is a range of ordinals.  A sparse table gives every reading the summaries of the
    last 1, 2, 4, ... readings, each merged from two of the level below, and a window is put together from the few of
    them whose lengths add up to its own.  Only readings that some window asks for leave the table.  Wells are cut into
    blocks of rows, so neither many readings nor many alerts of a well or an hour meet in one task.

    As published the late mean of the trend is the mean of the whole window (`trend_pct`);
    `trend_tail_pct` uses the last tenth.
    """
    ranges, readings = _ranges(alerts, telemetry, order, features, hours_back * 3600, key, ts, block_rows)
    longest = ranges.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 1
    top = longest.bit_length() - 1
    pieces = ranges.select("alert_id", key, "_n", F.explode(_pieces(top)).alias("_p")).select("alert_id", key, "_n", "_p.*")
    asked = cut_lineage(pieces)
    table = _sparse_table(readings, asked.select(key, "_idx").distinct(), features, key, top, block_rows)
    found = join_null_safe(asked, table, [key, "_idx"]).withColumn("_summary", F.element_at("_levels", F.col("_level") + 1))
    # At most three times as many pieces of a window as there are levels.
    parts = found.groupBy("alert_id", key, "_n").agg(F.collect_list(F.struct("_part", "_level", "_summary")).alias("_parts"))

    def whole(part: int) -> Column:
        own = F.filter(F.array_sort("_parts"), lambda p: p["_part"] == part)
        none = F.transform(F.sequence(F.lit(1), F.lit(len(features))), lambda _: _summary(F.lit(None).cast("double")))
        return F.aggregate(own, none, lambda held, p: F.zip_with(held, p["_summary"], _merged))

    tenth = _tenth()
    joined = parts.withColumns({"_all": whole(ALL), "_early": whole(EARLY), "_late": whole(LATE)})

    def row(i: int, f: str) -> Column:
        every, early, late = (F.element_at(c, i + 1) for c in ("_all", "_early", "_late"))
        mean = F.when(every["n"] > 0, every["mean"])
        first, last = early["n"] * early["mean"] / tenth, late["n"] * late["mean"] / tenth
        return F.struct(
            F.lit(i).alias("feature_no"),
            F.lit(f).alias("feature"),
            round_settled(mean, 2).alias("mean"),
            round_settled(F.when(every["n"] > 0, F.sqrt(every["m2"] / every["n"])), 2).alias("std"),
            round_settled(every["low"], 2).alias("min"),
            round_settled(every["high"], 2).alias("max"),
            _trend(mean, first).alias("trend_pct"),
            _trend(last, first).alias("trend_tail_pct"),
        )

    return (
        joined.select(
            "alert_id", key, F.col("_n").alias("record_count"), completeness(F.col("_n"), hours_back).alias("completeness"),
            F.explode(F.array(*[row(i, f) for i, f in enumerate(features)])).alias("_s"),
        )
        .select("alert_id", key, "record_count", "completeness", "_s.*")
    )


# Parts of a window: all of it, its first tenth, its last tenth.
ALL, EARLY, LATE = 0, 1, 2


def _ranges(
    alerts: DataFrame, telemetry: DataFrame, order: list[str], features: list[str], width: int, key: str, ts: str, block_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Per alert with readings in its window the ordinals (_lo, _hi] and their number `_n`; and the readings with `_idx`."""
    # A window holds the readings at its begin and at its end: it is opened before and closed behind them.
    opens, reads, closes = F.lit(0), F.lit(1), F.lit(2)
    tie = [c for c in order if c != ts]
    timeline = telemetry.select(
        key, F.col(ts).alias("_at"), reads.alias("_kind"),
        (F.struct(*tie) if tie else F.lit(None).cast("struct<x:int>")).alias("_tie"), *features,
    )
    marks = alerts.select(
        key, F.col("alert_id").cast("string").alias("alert_id"),
        F.explode(
            F.array(
                F.struct((F.col(ts) - F.make_dt_interval(secs=F.lit(width))).alias("_at"), opens.alias("_kind")),
                F.struct(F.col(ts).alias("_at"), closes.alias("_kind")),
            )
        ).alias("_mark"),
    ).select(key, "alert_id", "_mark.*")
    series = KeyedSeries.build(
        timeline.unionByName(marks, allowMissingColumns=True), [key], ["_at", "_kind", "_tie"], block_rows=block_rows
    )
    counted = series.running((F.col("_kind") == 1).cast("long"), "_idx").rows(keep_position=False)
    counted = cut_lineage(counted)
    at = {name: F.max(F.when(F.col("_kind") == kind, F.col("_idx"))) for name, kind in (("_lo", 0), ("_hi", 2))}
    ranges = counted.filter("_kind <> 1").groupBy("alert_id", key).agg(*[v.alias(k) for k, v in at.items()])
    ranges = cut_lineage(ranges.withColumn("_n", F.col("_hi") - F.col("_lo")).filter("_n > 0"))
    return ranges, counted.filter("_kind = 1").select(key, "_idx", *features)


def _tenth() -> Column:
    return F.greatest(F.lit(1), F.floor(F.col("_n") / 10)).cast("long")


def _pieces(top: int) -> Column:
    """The pieces of a window: part, level k and the ordinal at which 2^k readings end, one per bit of a part's length."""

    def cut(part: int, end: Column, length: Column) -> Column:
        bits = F.filter(F.sequence(F.lit(0), F.lit(top)), lambda k: F.getbit(length, k) == 1)

        def piece(k: Column) -> Column:
            shorter = length % F.pow(F.lit(2.0), k).cast("long")
            return F.struct(F.lit(part).alias("_part"), k.alias("_level"), (end - shorter).alias("_idx"))

        return F.transform(bits, piece)

    tenth = _tenth()
    return F.concat(
        cut(ALL, F.col("_hi"), F.col("_n")), cut(EARLY, F.col("_lo") + tenth, tenth), cut(LATE, F.col("_hi"), tenth)
    )


def _summary(value: Column) -> Column:
    """Number, mean, sum of squared deviations, minimum and maximum of one value, or of none for null."""
    return F.struct(
        F.when(value.isNull(), 0.0).otherwise(1.0).alias("n"), F.coalesce(value, F.lit(0.0)).alias("mean"),
        F.lit(0.0).alias("m2"), value.alias("low"), value.alias("high"),
    )


def _merged(a: Column, b: Column) -> Column:
    """Summary of two sets of values from theirs; means are moved, so nothing large cancels."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    share = F.when(n > 0, b["n"] / n).otherwise(0.0)
    mean = F.when(a["n"] == 0, b["mean"]).otherwise(a["mean"] + apart * share)
    return F.struct(
        n.alias("n"), mean.alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"),
        F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"),
    )


def _sparse_table(
    readings: DataFrame, asked: DataFrame, features: list[str], key: str, top: int, block_rows: int
) -> DataFrame:
    """For the asked ordinals: `_levels`, the summaries of the last 2^k readings for k from 0 to `top`.

    Level k + 1 of a reading is level k merged with level k of the reading 2^k before: one lag per level.
    """
    halo = (1 << top) - 1
    rows = join_null_safe(readings, asked.withColumn("_asked", F.lit(True)), [key, "_idx"], "left")
    series = KeyedSeries.from_ordinals(rows, [key], "_idx", True, halo, max(block_rows, halo, 1))
    window = series.window()
    levels = ["_t0"]
    df = series.df.withColumn("_t0", F.array(*[_summary(F.col(f).cast("double")) for f in features])).drop(*features)
    for k in range(top):
        df = df.withColumn("_far", F.lag(f"_t{k}", 1 << k).over(window))
        both = F.zip_with(F.col("_far"), F.col(f"_t{k}"), _merged)
        df = df.withColumn(f"_t{k + 1}", F.coalesce(both, F.col(f"_t{k}"))).drop("_far")
        levels.append(f"_t{k + 1}")
    own = df.filter(F.col("_asked") & ~F.col(HALO))
    return own.select(key, "_idx", F.array(*levels).alias("_levels"))


def _trend(late: Column, early: Column) -> Column:
    change = F.try_divide(late - early, F.abs(early)) * 100
    return round_settled(F.coalesce(change, F.lit(0.0)), 1)


def completeness(n: Column, expected: int) -> Column:
    """Share of the expected hourly readings, at most 1."""
    return round_tie_even(F.least(F.lit(1.0), n / F.lit(float(max(1, expected)))), 3)


# Trend alarms (feature, sign, limit in percent, text).
TREND_ALARMS = [
    ("oil_rate_bopd", -1, 15, "  ⚠ ALERT: Oil rate declining trend >15% — investigate."),
    ("water_cut_pct", 1, 10, "  ⚠ ALERT: Water cut increasing trend >10% — possible water breakthrough."),
    ("bhp_psi", -1, 10, "  ⚠ ALERT: BHP declining >10% — check reservoir pressure or pump health."),
    ("gas_oil_ratio", 1, 30, "  ⚠ ALERT: GOR increasing >30% — possible gas coning or separator issue."),
]


def decimal_text(column: Column) -> Column:
    """A rounded number the way it prints: 12.5, 3.0."""
    return F.regexp_replace(F.format_string("%.2f", column), r"(\.\d)0$", "$1")


def summary_text(summary: DataFrame, keys: list[str], hours: int = 72, well: str = "well_id") -> DataFrame:
    """One text per window: header, a line per feature, then the trend alarms (A10)."""
    trend = F.col("trend_pct")
    arrow = F.when(trend > 2, "▲").when(trend < -2, "▼").otherwise("→")
    line = F.concat(
        F.lit("  "), F.col("feature"), F.lit(": mean="), decimal_text(F.col("mean")), F.lit(", std="),
        decimal_text(F.col("std")), F.lit(", range=["), decimal_text(F.col("min")), F.lit(", "),
        decimal_text(F.col("max")), F.lit("], trend="), arrow, F.format_string("%.1f%%", F.abs(trend)),
    )
    alarm = None
    for feature, sign, limit, text in TREND_ALARMS:
        test = (F.col("feature") == feature) & (trend * sign > limit)
        alarm = F.when(test, text) if alarm is None else alarm.when(test, text)
    alarm_no = F.array_position(F.array(*[F.lit(a[0]) for a in TREND_ALARMS]), F.col("feature"))

    def texts(column: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(f"{column}_no", column))), lambda s: s[column])

    header = F.concat(
        F.lit("Telemetry summary for "), F.col(well), F.lit(f" over the last {hours} hours ("),
        F.col("record_count").cast("string"), F.lit(" readings, "),
        F.format_string("%.0f%%", F.rint(F.col("completeness") * 100)), F.lit(" complete):"),
    )
    staged = summary.withColumns({"line": line, "line_no": F.col("feature_no"), "alarm_no": alarm_no}).withColumn(
        "alarm", F.coalesce(alarm, F.lit(""))
    )
    # At most one row per feature is collected per window.
    group = list(dict.fromkeys([*keys, well, "record_count", "completeness"]))
    return (
        staged.groupBy(*group)
        .agg(texts("line").alias("_lines"), texts("alarm").alias("_alarms"))
        .select(
            *keys,
            F.array_join(
                F.concat(F.array(header), F.col("_lines"), F.filter("_alarms", lambda a: a != "")), "\n"
            ).alias("summary_text"),
        )
    )


def latest_reading(telemetry: DataFrame, order: list[str], columns: list[str] = FEATURES) -> DataFrame:
    """Newest reading per well."""
    row = F.struct("timestamp", *columns)
    return telemetry.groupBy("well_id").agg(F.max_by(row, F.struct(*order)).alias("latest")).select("well_id", "latest.*")


def reading_as_of(
    alerts: DataFrame, telemetry: DataFrame, order: list[str], columns: list[str] = FEATURES, key: str = "well_id"
) -> DataFrame:
    """Newest reading of the well at or before each alert.

    Alerts become marker rows behind the readings of the same instant; the running maximum of
    (order, reading) at a marker is the reading looked for.
    """
    row = F.struct(*order, *[c for c in columns if c not in order])
    readings = telemetry.select(key, F.col(order[0]).alias("_at"), F.lit(0).alias("_mark"), row.alias("_row"))
    markers = alerts.select(key, F.col("timestamp").alias("_at"), F.lit(1).alias("_mark"), "alert_id")
    series = KeyedSeries.build(
        readings.unionByName(markers, allowMissingColumns=True), [key], ["_at", "_mark", "_row", "alert_id"]
    )
    return series.running(F.col("_row"), "as_of", "max").rows().filter("_mark = 1").select("alert_id", "as_of")


def recent_alert_counts(alerts: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Per well a map severity -> number of alerts in the last days."""
    counts = (
        alerts.filter(F.col("timestamp") > now - F.make_interval(days=F.lit(days)))
        .groupBy("well_id", "severity")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most one entry per severity.
    return counts.groupBy("well_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("recent_alerts_7d")
    )


def well_status(latest: DataFrame, counts: DataFrame) -> DataFrame:
    """Latest reading, alert counts and the status sentence per well."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("N/A"))

    parts = F.transform(F.map_entries("recent_alerts_7d"), lambda e: F.format_string("%d %s", e["value"], e["key"]))
    alert_text = F.when(
        F.size("recent_alerts_7d") > 0, F.concat(F.lit(" Recent alerts (7d): "), F.array_join(parts, ", "), F.lit("."))
    ).otherwise(F.lit(""))
    sentence = F.concat(
        F.lit("Well "), F.col("well_id"), F.lit(" last reading at "),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(": oil="), text("oil_rate_bopd"), F.lit(" BOPD, WC="),
        text("water_cut_pct"), F.lit("%, GOR="), text("gas_oil_ratio"), F.lit(" scf/bbl, BHP="), text("bhp_psi"),
        F.lit(" psi."), F.coalesce(alert_text, F.lit("")),
    )
    return latest.join(counts, "well_id", "left").withColumn("status", F.lit("ACTIVE")).withColumn(
        "summary_text", sentence
    )
