"""Threat levels, alert rules, escalation and suppression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from aeroband.functions.numeric import tiered
from aeroband.functions.timing import epoch_us, instant
from aeroband.operators import ordered, scans, tracking

C = F.col

# Confidence tiers, scoring tables and class tables.
SEVERITY_TIERS = [(0.95, "CRITICAL"), (0.85, "HIGH"), (0.70, "MEDIUM"), (0.50, "LOW")]
CONFIDENCE_TIERS = [(0.95, "critical"), (0.85, "high"), (0.70, "medium"), (0.50, "low"), (0.30, "noise")]
LISTED_TYPES = ("DJI Mavic", "DJI Phantom")
HIGH_THREAT_TYPES = ("Custom OFDM", "LoRa Telemetry")
MEDIUM_THREAT_TYPES = ("DJI OcuSync", "DJI O4")
SCORE_TIERS = [(80, "CRITICAL"), (60, "HIGH"), (40, "MEDIUM"), (20, "LOW")]
CLASS_TABLE = {
    0: ("noise", "noise", "none"), 1: ("dji_mavic", "dji", "medium"), 2: ("dji_mini", "dji", "low"),
    3: ("dji_phantom", "dji", "medium"), 4: ("fpv_analog", "fpv", "low"), 5: ("fpv_digital", "fpv", "medium"),
    6: ("autel_evo", "autel", "medium"), 7: ("skydio", "skydio", "medium"), 8: ("parrot_anafi", "parrot", "low"),
    9: ("hubsan", "hubsan", "low"), 10: ("yuneec", "yuneec", "medium"), 11: ("interference_wifi", "interference", "none"),
    12: ("interference_ble", "interference", "none"), 13: ("interference_radar", "interference", "none"),
}
LEVEL_SCORES = {"critical": 100, "high": 75, "medium": 50, "low": 25, "none": 0}
CATEGORY_MULTIPLIERS = {"dji": 1.0, "autel": 1.0, "skydio": 1.1, "fpv": 0.8, "parrot": 0.7, "hubsan": 0.6, "yuneec": 0.9,
                        "interference": 0.0, "noise": 0.0}
SEED_RULES = [
    {"id": "rule_high_confidence", "severity": "CRITICAL", "condition": {"confidence": {"$gt": 0.85}}, "cooldown": 30, "escalation": [60, 300]},
    {"id": "rule_medium_confidence", "severity": "ALERT", "condition": {"confidence": {"$between": [0.7, 0.85]}}, "cooldown": 60, "escalation": [120]},
    {"id": "rule_geofence", "severity": "CRITICAL", "condition": {"in_restricted_zone": True}, "cooldown": 10, "escalation": [30, 120]},
    {"id": "rule_jamming", "severity": "EMERGENCY", "condition": {"jamming_detected": True}, "cooldown": 300, "escalation": [10, 30, 60]},
    {"id": "rule_multiple_drones", "severity": "CRITICAL", "condition": {"drone_count": {"$gte": 3}}, "cooldown": 60, "escalation": [60]},
]
CONDITION_SEVERITY = {"no_remote_id": "HIGH", "invalid_data": "MEDIUM", "stale_data": "MEDIUM", "geofence_violation": "CRITICAL",
                      "multiple_drones": "HIGH", "spoofing_suspected": "CRITICAL", "operator_unauthorized": "HIGH"}
SPOOFING_WEIGHTS = {"gps_inconsistency": 0.35, "velocity_mismatch": 0.25, "altitude_anomaly": 0.15, "multiple_ids": 0.15, "signal_analysis": 0.10}
SPOOFING_LIMITS = {"max_speed": 50.0, "max_vertical_speed": 10.0, "max_altitude": 5000.0, "max_acceleration": 20.0}
SPOOFED, SUSPICIOUS = 0.7, 0.4


def threat_by_confidence(c="confidence") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 0.8, "high").when(c > 0.6, "medium").otherwise("low")


def threat_by_type(confidence="confidence", kind="drone_type", listed=LISTED_TYPES) -> Column:
    c = C(confidence)
    return F.when((c > 0.8) & C(kind).isin(*listed), "high").when(c > 0.6, "medium").otherwise("low")


def threat_score(confidence, kind, power_db, high=HIGH_THREAT_TYPES, medium=MEDIUM_THREAT_TYPES) -> Column:
    """Type, confidence and power points."""
    by_type = F.when(C(kind).isin(*high), 40).when(C(kind).isin(*medium), 20).otherwise(0)
    by_power = F.when(C(power_db) > -30, 20).when(C(power_db) > -50, 10).otherwise(0)
    return by_type + (C(confidence) * 30).cast("int") + by_power


def scored_threat(score) -> Column:
    return tiered(score, SCORE_TIERS, "NONE")


def severity(confidence="confidence") -> Column:
    return tiered(confidence, SEVERITY_TIERS, F.lit(None).cast("string"))


def confidence_tier(confidence="confidence") -> Column:
    return tiered(confidence, CONFIDENCE_TIERS, "none")


def condition_column(condition: dict) -> Column:
    """One predicate from a stored condition: comparisons, ranges or plain equality, all ANDed."""
    compare = {"$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
               "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$between": lambda c, v: c.between(v[0], v[1]),
               "$in": lambda c, v: c.isin(list(v))}
    out = F.lit(True)
    for name, test in condition.items():
        parts = test.items() if isinstance(test, dict) else [("$eq", test)]
        for op, value in parts:
            out = out & compare[op](C(name), value)
    return out


def evaluate_rules(detections: DataFrame, rules: list[dict] = SEED_RULES) -> DataFrame:
    """One row per detection and matching rule; all rules are tested in a single pass."""
    hits = F.array_compact(F.array(*[
        F.when(condition_column(r["condition"]), F.struct(
            F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("rule_severity"), F.lit(r["cooldown"]).alias("cooldown_seconds")))
        for r in rules]))
    return detections.select("*", F.explode(hits).alias("_r")).select("*", "_r.*").drop("_r")


_TOKEN = re.compile(r"\s*(?:'[^']*'|\d+(?:\.\d+)?|==|!=|<=|>=|<|>|\(|\)|[A-Za-z_][A-Za-z0-9_]*)")


def text_condition(text: str, columns) -> Column:
    """A rule such as ``threat_level == 'high' and in_restricted_zone`` over the named columns only."""
    allowed = {*columns, "and", "or", "not", "true", "false", "in", "between", "is", "null"}
    at = 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected text in condition: {text[at:]!r}")
        word = m.group().strip()
        if re.match(r"[A-Za-z_]", word) and word not in columns and word.lower() not in allowed:
            raise ValueError(f"unknown name in condition: {word}")
        at = m.end()
    return F.expr(text)


def multiple_emitters(detections: DataFrame, window: str = "1 minute", minimum: int = 3, slide: str | None = None, key: str = "emitter") -> DataFrame:
    """Windows holding at least ``minimum`` distinct emitters."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (detections.groupBy(w.alias("w")).agg(F.countDistinct(key).alias("emitters"))
            .filter(C("emitters") >= minimum).select(C("w.start").alias("start"), C("w.end").alias("end"), "emitters"))


def suppress(alerts: DataFrame, keys: list[str], seconds: Column, tie: str = "id", slice_seconds: int = 3600) -> DataFrame:
    """Alerts that fire when each firing silences its key for the given seconds."""
    work = alerts.withColumn("_cool", seconds.cast("double"))
    return scans.cooldown(work, keys, "ts", tie, "_cool", slice_seconds).drop("_cool")


def escalations(alerts: DataFrame, schedule: Column, as_of, answered: str = "resolved_at") -> DataFrame:
    """Level k fires when the alert is still unanswered at its cumulative delay."""
    cumulative = F.transform(schedule, lambda x, k: F.aggregate(F.slice(schedule, 1, k + 1), F.lit(0), lambda s, y: s + y))
    rows = alerts.select("id", "ts", F.coalesce(C(answered), instant(as_of)).alias("_until"), F.posexplode(cumulative).alias("_k", "delay_s"))
    due = C("ts") + F.make_dt_interval(secs=C("delay_s").cast("decimal(18,6)"))
    return rows.withColumn("due_ts", due).filter(C("due_ts") < C("_until")).select(
        "id", (C("_k") + 1).alias("level"), "due_ts")


def life_cycle(events: DataFrame) -> DataFrame:
    """State of each alert from its event rows (acknowledge, resolve, escalate)."""
    last = F.struct("ts", "seq")
    return events.groupBy("alert_id").agg(
        F.max_by("action", last).alias("last_action"), F.bool_or(C("action") == "acknowledge").alias("acknowledged"),
        F.bool_or(C("action") == "resolve").alias("resolved"), F.max(F.when(C("action") == "resolve", C("ts"))).alias("resolved_at"),
        F.count_if(C("action") == "escalate").alias("escalation_level"))


def condition_alerts(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of condition queries (each with ``id``) labelled with the fixed severity."""
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("condition"), "id", F.lit(CONDITION_SEVERITY[name]).alias("severity"))
        out = rows if out is None else out.unionByName(rows)
    return out


def spoofing_scores(messages: DataFrame, source: list[str] = ("transport", "rssi"), slot_seconds: int = 3600, slice_seconds: int = 3600) -> DataFrame:
    """Weighted evidence per message from step kinematics and identifiers sharing a source."""
    lim = SPOOFING_LIMITS
    steps = tracking.kinematics(messages, slice_seconds=slice_seconds).withColumn("_slot", ordered.time_slice("ts", slot_seconds))
    shared = steps.groupBy(*source, "_slot").agg(F.countDistinct("uas_id").alias("ids_at_source"))
    joined = steps.join(shared, [*source, "_slot"])

    def flag(cond):
        return F.coalesce(cond, F.lit(False))

    tests = {
        "gps_inconsistency": flag(C("implied_speed") > lim["max_speed"]),
        "velocity_mismatch": flag((F.abs(C("implied_speed") - C("speed")) > lim["max_speed"]) | (F.abs("acceleration") > lim["max_acceleration"])),
        "altitude_anomaly": flag((F.abs("vertical_speed") > lim["max_vertical_speed"]) | (C("altitude") > lim["max_altitude"])),
        "multiple_ids": C("ids_at_source") > 1,
        "signal_analysis": flag(~C("rssi").between(-100, -20)),
    }
    score = sum(F.when(test, SPOOFING_WEIGHTS[name]).otherwise(0.0) for name, test in tests.items())
    label = F.when(C("spoofing_score") >= SPOOFED - 1e-9, "spoofed").when(C("spoofing_score") >= SUSPICIOUS - 1e-9, "suspicious").otherwise("clean")
    return joined.drop("_slot").withColumns({"spoofing_score": score}).withColumn("verdict", label)


def class_threat(label="label") -> Column:
    """Level score times category multiplier of a class number."""
    values = {k: LEVEL_SCORES[level] * CATEGORY_MULTIPLIERS[cat] for k, (_, cat, level) in CLASS_TABLE.items()}
    return F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))]), C(label).cast("int"))


def consistent(detections: DataFrame, feature: str, seconds: float = 5, minimum: int = 3, key: str = "emitter") -> DataFrame:
    """Rows whose emitter showed at least ``minimum`` distinct features in the trailing window.

    The set holds feature names, so its size is the size of the vocabulary.
    """
    out = ordered.trailing(detections, [key], "ts", seconds, {"_f": F.collect_set(feature)})
    return out.withColumn("features", F.size("_f")).drop("_f").filter(C("features") >= minimum)
