"""Zone joins against a plain loop, for rings of few and of many edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroband.operators import geofence as G

ZONE = "zone_id long, is_circle boolean, clat double, clon double, radius_m double, ring array<struct<lat:double,lon:double>>, altitude_min double, altitude_max double, active boolean"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    zones = []
    for k, corners in enumerate([3, 5, 5, 6, 9, 40, 80, 4, 4]):
        lat, lon = 37.7 + rng.uniform(0, 0.03), -122.4 + rng.uniform(0, 0.03)
        turns = np.sort(rng.uniform(0, 2 * np.pi, corners))
        ring = [{"lat": float(lat + r * np.sin(t)), "lon": float(lon + r * np.cos(t))} for t, r in zip(turns, rng.uniform(0.002, 0.012, corners))]
        zones.append((k, False, None, None, None, ring, 10.0 if k % 2 else None, 90.0, True))
    zones.append((90, True, 37.71, -122.39, 900.0, None, None, None, True))
    zones.append((91, False, None, None, None, [{"lat": 37.71, "lon": -122.39}] * 4, None, None, True))  # a point
    at = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(rng.uniform(37.69, 37.74, 1500), rng.uniform(-122.41, -122.36, 1500), rng.uniform(0, 120, 1500)))]
    positions = spark.createDataFrame(at + [(5000, 37.71, -122.3901, 5.0), (5001, None, None, 5.0)], "id long, latitude double, longitude double, altitude double")
    return positions, spark.createDataFrame(zones, ZONE)


def _all_pairs(tables):
    return tables[0].crossJoin(tables[1])


def test_inside_and_altitude(tables):
    inside = _all_pairs(tables).filter(G.inside_zone("latitude", "longitude"))
    want = {(r.id, r.zone_id) for r in inside.collect()}
    assert {(r.id, r.zone_id) for r in G.inside(*tables).collect()} == want and len(want) > 300
    banded = [(r.id, r.zone_id) for r in inside.filter(G.in_altitude_band("altitude")).collect()]
    assert sorted((r.id, r.zone_id) for r in G.containment(*tables).collect()) == sorted(banded)
    assert sorted(r.id for r in G.positions_in_zones(*tables).collect()) == sorted({i for i, _ in banded})


@pytest.mark.parametrize("buffer_m", [50.0, 400.0])
def test_distances_within_the_buffer(tables, buffer_m):
    ring = F.when(G.inside_ring("latitude", "longitude", "ring"), 0.0).otherwise(G.ring_distance_m("latitude", "longitude", "ring"))
    circle = F.greatest(F.lit(0.0), G.geo.haversine_m("latitude", "longitude", "clat", "clon") - F.col("radius_m"))
    plain = _all_pairs(tables).withColumn("m", F.when(F.col("is_circle"), circle).otherwise(ring)).filter(F.col("m") <= buffer_m)
    want = {(r.id, r.zone_id): r.m for r in plain.collect()}
    got = {(r.id, r.zone_id): r for r in G.proximity(*tables, buffer_m, buffer_m / 2).collect()}
    assert set(got) == set(want) and (5000, 91) in want
    for key, m in want.items():
        assert math.isclose(got[key].distance_m, m, abs_tol=1e-9)
        assert got[key].severity == ("critical" if m == 0 else "alert" if m <= buffer_m / 2 else "warning")


def test_pairs_are_tested_by_compiled_terms(spark, tables):
    """A loop over the ring for every pair took most of the time; positions in few partitions, the rest."""
    few = tables[1].filter(F.size("ring") <= 5)
    for out in (G.inside(tables[0], few), G.containment(tables[0], few), G.positions_in_zones(tables[0], few)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "lambda" in line and "latitude" in line]
        assert f"Repartition {4 * spark.sparkContext.defaultParallelism}" in plan


def test_blocks_settle_crowds(spark, tables):
    """Neighbours meet a zone as one block; crowds, duplicates and places on a border come out as a loop has them."""
    rng = np.random.default_rng(4)
    at = [(37.71 + a, -122.385 + b) for a, b in rng.uniform(-0.004, 0.004, (1200, 2))] + [(37.712, -122.384)] * 700
    at += [(37.71 + k * 1e-7, -122.39 + 900.0 / G.METRES_PER_DEG / math.cos(math.radians(37.71))) for k in range(40)]
    crowd = spark.createDataFrame([(k, float(a), float(b), 50.0) for k, (a, b) in enumerate(at)], "id long, latitude double, longitude double, altitude double")
    want = sorted((r.id, r.zone_id) for r in crowd.crossJoin(tables[1]).filter(G.inside_zone("latitude", "longitude")).select("id", "zone_id").collect())
    assert sorted((r.id, r.zone_id) for r in G.inside(crowd, tables[1]).select("id", "zone_id").collect()) == want and len(want) > 2000
    blocks = G._blocks(crowd).select(F.size("_at").alias("n")).collect()
    assert sum(b.n for b in blocks) == len(at) and max(b.n for b in blocks) <= G.BLOCK_ROWS and len(blocks) < 120


def test_zone_cells_are_counted_before_they_are_broadcast(spark, tables, monkeypatch):
    """Estimates do not see the cells of a zone: many cells are joined by sorting, with the same rows."""
    want = sorted((r.id, r.zone_id, r.severity) for r in G.proximity(*tables, 400.0, 200.0).collect())
    monkeypatch.setattr(G, "BROADCAST_BYTES", 1000)
    out = G.proximity(*tables, 400.0, 200.0)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.zone_id, r.severity) for r in out.collect()) == want
