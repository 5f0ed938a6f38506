"""Detection, alert and performance analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroband.functions.numeric import ratio_or_zero
from aeroband.functions.timing import bucket, epoch_us, instant, last, seconds_between
from aeroband.operators import ordered

C = F.col


def _count(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def threat_counts() -> list[Column]:
    return [_count(C("threat_level") == level.upper(), level) for level in ("high", "medium", "low")]


def threat_summary(detections: DataFrame) -> DataFrame:
    return detections.agg(F.count("*").alias("total"), *threat_counts(), F.avg("confidence").alias("avg_confidence"))


def emitter_identity() -> Column:
    """Broadcast identity, else signature; empty text counts as absent."""
    return F.coalesce(F.nullif(C("remote_id"), F.lit("")), F.nullif(C("signature_hash"), F.lit("")))


def period_statistics(detections: DataFrame) -> DataFrame:
    return detections.agg(
        F.count("*").alias("total"), F.countDistinct(emitter_identity()).alias("unique_emitters"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), *threat_counts())


def unique_emitters(detections: DataFrame) -> DataFrame:
    return detections.agg(F.countDistinct(emitter_identity()).alias("unique_emitters"))


def top_values(df: DataFrame, column: str, k: int = 10, missing: str = "unknown") -> DataFrame:
    """Most frequent values, ties by name."""
    return (df.groupBy(F.coalesce(C(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))
              .orderBy(C("n").desc(), column).limit(k))


def hourly_histogram(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Counts for hours 0-23, absent hours as zero; one row per hour, no join with the data.

    The 24 counters are one conditional aggregate, so the shuffle carries one row per task.
    """
    counted = df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(24).select(C("id").cast("int").alias("hour"))
    return spine.join(F.broadcast(counted), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def daily_counts(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


# Bucket units and their steps.
UNIT_STEPS = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH",
              "year": "INTERVAL 1 YEAR"}


def bucket_spine(spark, start, end, unit: str) -> DataFrame:
    """Every calendar bucket from the one holding ``start`` to the one holding ``end``."""
    first, final = bucket(unit, instant(start)), bucket(unit, instant(end))
    return spark.range(1).select(F.explode(F.sequence(first, final, F.expr(UNIT_STEPS[unit]))).alias("bucket"))


def threat_trend(detections: DataFrame, start, end, unit: str) -> DataFrame:
    """Dense counts per bucket; anything that is not high or medium counts as low."""
    inside = detections.filter(C("ts").between(instant(start), instant(end)))
    counts = inside.groupBy(bucket(unit, "ts").alias("bucket")).agg(
        F.count("*").alias("total"), _count(C("threat_level") == "HIGH", "high"),
        _count(C("threat_level") == "MEDIUM", "medium"))
    spine = bucket_spine(detections.sparkSession, start, end, unit)
    zero = F.lit(0).cast("long")
    out = spine.join(counts, "bucket", "left").select(
        "bucket", *[F.coalesce(C(c), zero).alias(c) for c in ("total", "high", "medium")])
    return out.withColumn("low", C("total") - C("high") - C("medium"))


def type_distribution(detections: DataFrame) -> DataFrame:
    """Share, confidence and per-threat counts of each type."""
    total = detections.select(F.count("*")).scalar()
    by = detections.groupBy("drone_type").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), *threat_counts())
    return by.select("drone_type", "n", (C("n") * 100.0 / total).alias("percentage"), "avg_confidence",
                     F.map_filter(
                         F.create_map(*[x for t in ("high", "medium", "low") for x in (F.lit(t.upper()), C(t))]),
                         lambda k, v: v > 0).alias("threat_distribution"))


def batch_summary(detections: DataFrame) -> DataFrame:
    """Long form: one row per metric, type and threat counters included."""
    cube = detections.groupingSets([[C("drone_type")], [C("threat_level")], []], C("drone_type"), C("threat_level")).agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))
    scope = F.when(C("g") == 1, "type").when(C("g") == 2, "threat").otherwise("all")
    return cube.select(scope.alias("scope"), F.coalesce("drone_type", "threat_level", F.lit("all")).alias("name"),
                       "n", "avg_confidence")


# Named bands (name, centre Hz, width Hz).
NAMED_BANDS = [
    ("DJI_OcuSync_2.4G", 2412000000.0, 20000000.0),
    ("DJI_OcuSync_5.8G", 5825000000.0, 20000000.0),
    ("FPV_5.8G", 5800000000.0, 200000000.0),
    ("WiFi_2.4G", 2440000000.0, 80000000.0),
]


def bands_of(frequency: Column, bands=None) -> Column:
    """Names of the fixed bands a frequency lies in, computed in the row."""
    return F.array_compact(F.array(*[
        F.when((frequency >= centre - width / 2) & (frequency <= centre + width / 2), F.lit(name))
        for name, centre, width in (bands or NAMED_BANDS)]))


def band_distribution(detections: DataFrame) -> DataFrame:
    """Detections per named band; overlapping bands each count."""
    return (detections.select(F.explode(bands_of(C("frequency"))).alias("band"))
                      .groupBy("band").agg(F.count("*").alias("n")))


def peak_times(detections: DataFrame) -> DataFrame:
    """Peak hour of day, busiest weekday (Monday = 1) and mean per active day."""
    cells = detections.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    hours = cells.groupBy("hour").agg(F.sum("n").alias("n")).agg(F.max_by("hour", F.struct("n", -C("hour"))))
    weekday = F.weekday("day") + 1
    days = cells.groupBy(weekday.alias("d")).agg(F.sum("n").alias("n")).agg(F.max_by("d", F.struct("n", -C("d"))))
    return cells.agg((F.sum("n") / F.countDistinct("day")).alias("daily_mean")).select(
        hours.scalar().alias("peak_hour"), days.scalar().alias("busiest_weekday"), "daily_mean")


def dashboard_summary(detections: DataFrame, alerts: DataFrame, as_of) -> DataFrame:
    """Last 24 hours in one row."""
    day = detections.filter(last("ts", as_of, 24, "HOUR"))
    active = alerts.filter(~C("acknowledged") & ~C("resolved")).select(F.count("*"))
    return day.agg(F.count("*").alias("total"), F.countDistinct("drone_type").alias("unique_types"), *threat_counts()).select(
        "total", active.scalar().alias("active_alerts"),
        "unique_types",
        "high", "medium", "low", ratio_or_zero(C("high") * 100.0, C("total").cast("double")).alias("high_percent"),
        (C("total") / 24 / 60).alias("per_minute"))


def dashboard_top_types(detections: DataFrame, as_of, k: int = 5) -> DataFrame:
    day = detections.filter(last("ts", as_of, 24, "HOUR"))
    return top_values(day, "drone_type", k)


def report_rows(detections: DataFrame, unit: str) -> DataFrame:
    """Daily, weekly or monthly report as one tidy table from a single pre-aggregate."""
    cells = detections.groupBy(bucket(unit, "ts").alias("period"), "threat_level", "drone_type",
                               F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    def part(section, name):
        return F.struct(F.lit(section).alias("section"), name.alias("name"))

    items = cells.select("period", "n", F.explode(F.array(
        part("total", F.lit("all")), part("threat", C("threat_level")), part("type", C("drone_type")),
        part("hour", F.lpad(C("hour").cast("string"), 2, "0")))).alias("x"))
    rows = items.groupBy("period", C("x.section").alias("section"), C("x.name").alias("name")).agg(F.sum("n").alias("n"))
    peak = rows.filter(C("section") == "hour").groupBy("period").agg(
        F.max_by(F.struct("name", "n"), F.struct("n", -C("name").cast("int"))).alias("p"))
    return rows.unionByName(peak.select("period", F.lit("peak_hour").alias("section"), C("p.name").alias("name"), C("p.n").alias("n")))


def live_metrics(detections: DataFrame) -> DataFrame:
    return detections.agg(F.count("*").alias("total"), _count(C("threat_level") == "HIGH", "high_threats"),
                          F.round(F.avg("confidence"), 3).alias("avg_confidence"))


def counters(detections: DataFrame, *columns: str) -> DataFrame:
    return detections.groupBy(*columns).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------- alerts
def alert_statistics(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count("*").alias("total"), _count(~C("acknowledged") & ~C("resolved"), "active"),
        _count(C("resolved"), "resolved"), _count(C("acknowledged"), "acknowledged"),
        F.coalesce(F.avg(seconds_between("ts", "resolved_at") / 60), F.lit(0.0)).alias("avg_response_minutes"),
        F.coalesce(F.avg(F.when(C("escalation_level") > 0, 100.0).otherwise(0.0)), F.lit(0.0)).alias("escalation_rate"))


def alert_breakdown(alerts: DataFrame) -> DataFrame:
    """Counts by severity and by category in one pass; missing is UNKNOWN."""
    unknown = F.lit("UNKNOWN")
    items = alerts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.coalesce(C(c), unknown).alias("name")) for c in ("severity", "category")
    ])).alias("x"))
    return items.groupBy(C("x.dimension").alias("dimension"), C("x.name").alias("name")).agg(F.count("*").alias("n"))


def index_percentiles(df: DataFrame, value: str, points: dict[str, float], keys=()) -> DataFrame:
    """Percentiles as the element at ``floor(n·p)`` of the sorted values, at any group size."""
    return ordered.order_statistics(df, list(keys), value, {
        name: F.least(F.floor(C("n") * p), C("n") - 1) for name, p in points.items()})


def rates(detections: DataFrame, alerts: DataFrame, start, end, uptime_seconds: float) -> DataFrame:
    """Rates over a period.  Resolved alerts stand for requests served, unresolved for errors,
    and unlabelled-severity alerts for false positives."""
    inside = C("ts").between(instant(start), instant(end))
    minutes = seconds_between(instant(start), instant(end)) / 60
    n = detections.filter(inside).select(F.count("*")).scalar()
    return alerts.filter(inside).agg(
        F.count("*").alias("requests"), F.count_if(~C("resolved")).alias("errors"),
        F.count_if(C("severity").isNull()).alias("false_positives")).select(
        (n / minutes).alias("detections_per_minute"), (C("requests") / minutes).alias("requests_per_minute"),
        ratio_or_zero(C("errors") * 100.0, C("requests").cast("double")).alias("error_percent"),
        (F.lit(uptime_seconds) / (minutes * 60) * 100).alias("uptime_percent"),
        ratio_or_zero(C("false_positives") * 1.0, C("requests").cast("double")).alias("false_positive_rate"))


def periodic_metrics(detections: DataFrame, unit: str, processing: str = "value") -> DataFrame:
    return detections.groupBy(bucket(unit, "ts").alias("bucket")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), *threat_counts(),
        F.avg(processing).alias("avg_processing_ms"))


def labelled_counters(df: DataFrame, labels: list[str], gauge: str, ts: str = "ts", tie: str = "id") -> DataFrame:
    """Count and last gauge value per label set."""
    return df.groupBy(*labels).agg(F.count("*").alias("n"), F.max_by(gauge, F.struct(ts, tie)).alias("last_value"))


# Cumulative bucket bounds of the published histograms.
CONFIDENCE_BOUNDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
LATENCY_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0]


def cumulative_histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative ``le`` counts, the open bucket last; one row per bound after one aggregate."""
    labels = [str(b) for b in bounds] + ["+Inf"]
    counts = df.agg(*[F.count_if(C(value) <= b).alias(f"c{i}") for i, b in enumerate(bounds)],
                    F.count(value).alias(f"c{len(bounds)}"))
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(label).alias("le"), C(f"c{i}").alias("n")) for i, label in enumerate(labels)])).alias("x")).select("x.*")


def latency_summary(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Extremes, mean and interpolated p50/90/95/99 of groups of any size."""
    keys = list(keys)
    basic = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
                                  F.avg(value).alias("mean"))
    cuts = ordered.interpolated_percentiles(df, keys, value, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return ordered.beside(basic, cuts, keys)


def throughput_bits(samples, bytes_per_sample: int, seconds) -> Column:
    return samples * bytes_per_sample * 8 / seconds


def identification_coverage(detections: DataFrame, as_of) -> DataFrame:
    recent = last("ts", as_of, 1, "HOUR")
    return detections.agg(
        F.count("*").alias("seen"), F.count("remote_id").alias("with_id"),
        F.count_if(C("remote_id").isNull()).alias("without_id"), _count(recent, "last_hour")).withColumn(
        "coverage_percent", ratio_or_zero(C("with_id") * 100.0, C("seen").cast("double")))


def active_emitters(messages: DataFrame, as_of, minutes: int) -> DataFrame:
    return messages.filter(last("ts", as_of, minutes, "MINUTE")).agg(F.countDistinct("uas_id").alias("active"))


def capture_batch_summary(captures: DataFrame) -> DataFrame:
    """Per batch of captures: files, readable files, duration, samples and signal quality."""
    return captures.agg(
        F.count("*").alias("files"), F.count_if(C("ok")).alias("ok_files"), F.sum("duration_s").alias("duration_s"),
        F.sum("samples").alias("samples"), F.avg("snr_db").alias("mean_snr"), F.min("snr_db").alias("min_snr"),
        F.max("snr_db").alias("max_snr"), F.avg("peak_db").alias("mean_peak"))


def best_captures(captures: DataFrame, measures: list[str], key: str) -> DataFrame:
    """Which capture leads each measure; the first one wins a tie."""
    return captures.agg(*[F.max_by(key, F.struct(m, -C(key))).alias(f"best_{m}") for m in measures])


def history_stats(spectra: DataFrame, low_hz: float, high_hz: float, by: str = "frame_id") -> DataFrame:
    """Band power series with its extremes."""
    band = spectra.filter(C("freq_hz").between(low_hz, high_hz))
    return band.groupBy(by).agg(F.avg("psd_db").alias("mean"), F.min("psd_db").alias("min"), F.max("psd_db").alias("max"),
                                F.stddev_pop("psd_db").alias("std"))


def audit_summary(log: DataFrame, start, end) -> DataFrame:
    """Actions per user, action and resource inside a period."""
    return (log.filter(C("ts").between(instant(start), instant(end)))
               .groupBy("user", "action", "resource").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")))
