"""Rules, zones, quality and privacy on the published small cases."""

import pytest
from pyspark.sql import functions as F

from aeroband.functions import geo
from aeroband.operators import filters, geofence, logs, positioning, privacy, quality, rules, telemetry


@pytest.mark.parametrize("confidence,level", [(0.95, "CRITICAL"), (0.85, "HIGH"), (0.70, "MEDIUM"), (0.50, "LOW"), (0.2, None)])
def test_severity_cases(spark, confidence, level):
    assert spark.createDataFrame([(confidence,)], "confidence double").select(rules.severity().alias("s")).first().s == level


def zone(spark):
    ring = [(37.7740, -122.4210), (37.7760, -122.4210), (37.7760, -122.4190), (37.7740, -122.4190)]
    return spark.createDataFrame([(1, False, None, None, None, [{"lat": a, "lon": b} for a, b in ring], None, None, True)],
                                 "zone_id long, is_circle boolean, clat double, clon double, radius_m double, ring array<struct<lat:double,lon:double>>, altitude_min double, altitude_max double, active boolean")


def test_one_position_inside(spark):
    pos = spark.createDataFrame([(1, 37.7750, -122.4200, 50.0), (2, 37.7900, -122.4300, 50.0)], "id long, latitude double, longitude double, altitude double")
    assert [r.id for r in geofence.containment(pos, zone(spark)).collect()] == [1]


def test_violation_only_on_entry(spark):
    track = [(1, 0, 37.7800), (2, 1, 37.7750), (3, 2, 37.7751), (4, 3, 37.7800), (5, 4, 37.7750)]
    m = spark.createDataFrame([(i, "U", t, lat, -122.42, 10.0, 1.0) for i, t, lat in track], "id long, uas_id string, t long, latitude double, longitude double, altitude double, speed double")
    m = m.withColumn("ts", F.timestamp_seconds(F.col("t") * 4000).cast("timestamp_ntz"))
    assert sorted(r.id for r in geofence.violations(m, zone(spark)).collect()) == [2, 5]


def test_short_distance(spark):
    d = spark.range(1).select(geo.haversine_m(F.lit(37.7749), F.lit(-122.4194), F.lit(37.7750), F.lit(-122.4180)).alias("d")).first().d
    assert 0 < d < 200


def test_radius_box_near_pole(spark):
    df = spark.createDataFrame([(89.99, 0.0), (89.99, 179.0), (80.0, 0.0)], "latitude double, longitude double")
    assert df.filter(filters.within_radius(90.0, 0.0, 10.0)).count() == 2


def test_text_conditions_reject_other_names():
    with pytest.raises(ValueError):
        rules.text_condition("reflect('x') == 1", ["threat_level"])
    with pytest.raises(ValueError):
        rules.text_condition("threat_level == 'a'; drop", ["threat_level"])


def test_rule_operators(spark):
    df = spark.createDataFrame([(1, 0.9, True), (2, 0.7, False)], "id long, confidence double, flag boolean")
    cond = {"confidence": {"$gte": 0.7, "$lt": 0.8}, "flag": False}
    assert [r.id for r in df.filter(rules.condition_column(cond)).collect()] == [2]


def test_signature_limits(spark):
    s = spark.createDataFrame([("", "m", [{"min_freq": 5e6, "max_freq": 4e6}], 10.0, 0.4)],
                              "manufacturer string, model string, bands array<struct<min_freq:double,max_freq:double>>, bandwidth double, confidence_threshold double")
    assert s.select(quality.signature_faults().alias("f")).first().f == ["missing_manufacturer", "frequency_low", "band_order", "bandwidth_low", "confidence_low"]


def test_log_formats(spark):
    lines = ["2024-01-15 14:30:22,123 [INFO ] [detection.service] Detection processed", "2024-01-15 14:30:23,789 [ERROR ] [api.routes] Failed", "broken"]
    df = logs.parse_text(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert [(r.level, r.logger) for r in df.collect()] == [("INFO", "detection.service"), ("ERROR", "api.routes"), (None, None)]
    access = '192.168.1.100 - admin [15/Jan/2024:14:30:22 +0000] "GET /api/detections HTTP/1.1" 200 1234 "http://localhost:8000/dashboard" "Mozilla/5.0"'
    row = logs.parse_access(spark.createDataFrame([(access,)], "line string")).first()
    assert (row.client, row.user, row.method, row.status, row.bytes) == ("192.168.1.100", "admin", "GET", 200, 1234)


def test_redaction_and_anonymisation(spark):
    df = spark.createDataFrame([({"API_KEY": "x", "kind": "y"}, "U1")], "m map<string,string>, uas_id string")
    row = privacy.anonymise(df.withColumn("m", logs.redact("m"))).first()
    assert row.m == {"API_KEY": "[REDACTED]", "kind": "y"} and len(row.uas_id) == 64


def test_short_packets_are_null(spark):
    df = spark.createDataFrame([(bytearray(29),), (bytearray(40),)], "payload binary")
    assert [r.latitude for r in telemetry.decode_simple(df).collect()] == [None, 0.0]


def test_noise_free_fix_is_exact(spark):
    rec = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1000.0, 0.0, 0.0), (2, 0.0, 1000.0, 0.0), (3, 1000.0, 1100.0, 0.0)], "receiver_id long, x double, y double, z double")
    import math
    at = lambda r: math.hypot(321 - r[0], 654 - r[1])
    pts = [(0, 0), (1000, 0), (0, 1000), (1000, 1100)]
    m = spark.createDataFrame([(1, 7, 0, k, (at(pts[k]) - at(pts[0])) / positioning.LIGHT_M_S, 1.0) for k in (1, 2, 3)],
                              "event_id long, array_id long, ref_id long, other_id long, tdoa_s double, quality double")
    fix = positioning.linear_fix(positioning.gathered(m, rec), 2).first().fix
    assert (fix.x, fix.y) == (pytest.approx(321, abs=1e-4), pytest.approx(654, abs=1e-4))
    near = F.struct((F.col("fix.x") + 30.0).alias("x"), (F.col("fix.y") - 20.0).alias("y"))
    linear = positioning.linear_fix(positioning.gathered(m, rec), 2).withColumn("start", near)
    refined = positioning.refine(linear, F.col("start")).first().fix
    assert (refined.x, refined.y) == (pytest.approx(321, abs=1e-5), pytest.approx(654, abs=1e-5))


def test_terms_are_whole_tokens(spark):
    df = spark.createDataFrame([(1, "The drone, that flies"), (2, "other thatch"), (3, "that THE-end"), (4, None)], "id long, text string")
    assert [r.id for r in df.filter(filters.matches_all_terms("the THAT", "text")).orderBy("id").collect()] == [1, 3]
    assert df.filter(filters.matches_all_terms("", "text")).count() == 4
