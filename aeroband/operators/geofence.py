"""Zones, heat maps and coverage.

Spatial joins go through square cells: a zone is listed under every cell its bounding box
touches, a position has one cell.  Positions of a cell meet the zones in blocks of neighbours:
a block that is wholly in or out of a zone is settled at once, and the exact test runs on
the pairs of the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from aeroband.functions import arrays as X, geo
from aeroband.operators import tracking
from aeroband.session import small_side

C = F.col
CELL_DEG = 0.01
#: Edges of a ring that a cell lists as plain columns.
FLAT_EDGES = 6
#: Positions of a block at most.
BLOCK_ROWS = 256
#: Bytes of zone cells that are sent to every executor at most.
BROADCAST_BYTES = 32 << 20
METRES_PER_DEG = math.pi / 180 * geo.EARTH_KM * 1000


def _circular() -> Column:
    return F.coalesce(C("is_circle"), F.lit(False))


def closed(ring) -> Column:
    """Ring with its first point repeated at the end."""
    ring = X._c(ring)
    return F.when(X.at(ring, 0) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(X.at(ring, 0))))


def inside_ring(lat, lon, ring) -> Column:
    """Odd number of edge crossings of a ray; works for open and closed rings."""
    lat, lon = X._c(lat), X._c(lon)

    def crossings(v):
        def crosses(k):
            a, b = X.at(v, k), X.at(v, F.pmod(k + 1, F.size(v)))
            spans = (a["lat"] > lat) != (b["lat"] > lat)
            x = a["lon"] + (lat - a["lat"]) / (b["lat"] - a["lat"]) * (b["lon"] - a["lon"])
            return spans & (lon < x)

        return F.size(F.filter(X.indices(v), crosses)) % 2 == 1

    return X.let(ring, crossings)


def ring_distance_m(lat, lon, ring) -> Column:
    """Distance to the nearest edge, in the local plane of the point; every term is bound once."""
    lat, lon = X._c(lat), X._c(lon)

    def edge(a, b):
        facts = F.struct(a["x"].alias("ax"), a["y"].alias("ay"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))

        def along(f):
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(f["ax"] * f["dx"] + f["ay"] * f["dy"]) / F.nullif(f["dx"] * f["dx"] + f["dy"] * f["dy"], F.lit(0.0))))
            return X.let(F.coalesce(t, F.lit(0.0)), lambda s: F.sqrt(F.pow(f["ax"] + s * f["dx"], 2) + F.pow(f["ay"] + s * f["dy"], 2)))

        return X.let(facts, along)

    def nearest(p):
        n = F.size(p)
        return F.array_min(F.transform(X.indices(p), lambda k: edge(X.at(p, k), X.at(p, F.pmod(k + 1, n)))))

    east = F.cos(F.radians(lat)) * METRES_PER_DEG
    planar = X.let(east, lambda e: F.transform(ring, lambda p: geo.local_metres(p["lat"], p["lon"], lat, e, F.lit(METRES_PER_DEG), lon)))
    return X.let(planar, nearest)


def _edge_columns(k: int) -> list[str]:
    return [f"_{end}{axis}{k}" for end in "ab" for axis in ("lat", "lon")]


def _crosses(lat: str, lon: str, alat: str, alon: str, blat: str, blon: str) -> str:
    return f"CASE WHEN ({alat} > {lat}) != ({blat} > {lat}) THEN {lon} < {alon} + ({lat} - {alat}) / ({blat} - {alat}) * ({blon} - {alon}) ELSE false END"


def inside_cell_ring(lat: str, lon: str, listed: bool = False) -> Column:
    """``inside_ring`` by the edges that a zone has in the position's cell: as plain columns, which compile, or as a list.

    The terms of edges are SQL, as hundreds of Columns take seconds to build.
    """
    if listed:
        return F.expr(f"size(filter(_edges, e -> {_crosses(lat, lon, 'e.alat', 'e.alon', 'e.blat', 'e.blon')})) % 2 = 1")
    return F.expr("(" + " + ".join(f"int({_crosses(lat, lon, *_edge_columns(k))})" for k in range(FLAT_EDGES)) + ") % 2 = 1")


def _plane(lat: Column, lon: Column, east: Column, alat: Column, alon: Column, blat: Column, blon: Column) -> tuple[Column, ...]:
    """An edge in metres around the point: its start and its extent, ``ax, ay, dx, dy``."""
    ax, ay = (alon - lon) * east, (alat - lat) * METRES_PER_DEG
    return ax, ay, (blon - lon) * east - ax, (blat - lat) * METRES_PER_DEG - ay


def cell_ring_distance_m(lat, lon, east="_east") -> Column:
    """``ring_distance_m`` where it is within the buffer of the cells; edges farther off may be missing."""
    def edge(e):
        ax, ay, dx, dy = _plane(X._c(lat), X._c(lon), X._c(east), e["alat"], e["alon"], e["blat"], e["blon"])

        def along(f):
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(f["ax"] * f["dx"] + f["ay"] * f["dy"]) / F.nullif(f["dx"] * f["dx"] + f["dy"] * f["dy"], F.lit(0.0))))
            return X.let(F.coalesce(t, F.lit(0.0)), lambda s: F.sqrt(F.pow(f["ax"] + s * f["dx"], 2) + F.pow(f["ay"] + s * f["dy"], 2)))

        return X.let(F.struct(ax.alias("ax"), ay.alias("ay"), dx.alias("dx"), dy.alias("dy")), along)

    return F.array_min(F.transform("_edges", edge))


def _with_planes(pairs: DataFrame, lat: str, lon: str, where: str = "true") -> DataFrame:
    """The flat edges in metres around the point as columns, ``_ax0, _ay0, _dx0, _dy0, ...``: each is used many times; 0 elsewhere."""
    def plane(k, end, less=("", "")):
        return {f"x{k}": F.expr(f"if({where}, (_{end}lon{k} - {lon}) * _east{less[0]}, 0D)"), f"y{k}": F.expr(f"if({where}, (_{end}lat{k} - {lat}) * {METRES_PER_DEG}D{less[1]}, 0D)")}

    starts = pairs.withColumns({f"_a{c}": v for k in range(FLAT_EDGES) for c, v in plane(k, "a").items()})
    return starts.withColumns({f"_d{c}": v for k in range(FLAT_EDGES) for c, v in plane(k, "b", (f" - _ax{k}", f" - _ay{k}")).items()})


def _with_nearest(planes: DataFrame, where: str = "true") -> DataFrame:
    """Where along each flat edge the point of it nearest to the point lies, ``_t0, ...``."""
    def along(k):
        ax, ay, dx, dy = (f"_{c}{k}" for c in ("ax", "ay", "dx", "dy"))
        return F.expr(f"if({where}, greatest(0D, least(1D, coalesce(-({ax} * {dx} + {ay} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0D), 0D))), 0D)")

    return planes.withColumns({f"_t{k}": along(k) for k in range(FLAT_EDGES)})


def _flat_distance_m() -> Column:
    """``cell_ring_distance_m`` by the columns of ``_with_planes`` and ``_with_nearest``, which compile; infinite without an edge."""
    square = lambda k: f"if(_n_edges > {k}, pow(_ax{k} + _t{k} * _dx{k}, 2D) + pow(_ay{k} + _t{k} * _dy{k}, 2D), double('Infinity'))"
    return F.expr(f"sqrt(least({', '.join(map(square, range(FLAT_EDGES)))}))")


def inside_zone(lat, lon) -> Column:
    """Containment test against the zone columns of the row."""
    circle = geo.haversine_m(lat, lon, C("clat"), C("clon")) <= C("radius_m")
    return F.when(C("is_circle"), circle).otherwise(inside_ring(lat, lon, "ring"))


def _cell_zone(listed: bool, lat="latitude", lon="longitude") -> Column:
    """``inside_zone`` of a candidate pair."""
    circle = geo.haversine_m(lat, lon, "clat", "clon") <= C("radius_m")
    return F.when(C("is_circle"), circle).otherwise(inside_cell_ring(lat, lon, listed))


def in_altitude_band(altitude) -> Column:
    """Open ends are null."""
    return (C("altitude_min").isNull() | (X._c(altitude) >= C("altitude_min"))) & (
        C("altitude_max").isNull() | (X._c(altitude) <= C("altitude_max")))


def zone_cells(zones: DataFrame, buffer_m: float = 0.0) -> DataFrame:
    """Zones with their bounding box grown by the buffer, listed under the cells of the box."""
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    reach = C("radius_m") / METRES_PER_DEG
    pad = buffer_m / METRES_PER_DEG * 1.01 + 1e-6
    south = F.when(C("is_circle"), C("clat") - reach).otherwise(F.array_min(lats)) - pad
    north = F.when(C("is_circle"), C("clat") + reach).otherwise(F.array_max(lats)) + pad
    boxed = zones.withColumn("_s", south).withColumn("_n", north)
    shrink = F.cos(F.radians(F.greatest(F.abs(C("_s")), F.abs(C("_n"))) + 0.01))
    west = F.when(C("is_circle"), C("clon") - reach / shrink).otherwise(F.array_min(lons)) - pad / shrink
    east = F.when(C("is_circle"), C("clon") + reach / shrink).otherwise(F.array_max(lons)) + pad / shrink
    boxed = boxed.withColumn("_w", west).withColumn("_e", east)

    def span(low, high):
        return F.sequence(F.floor(C(low) / CELL_DEG).cast("long"), F.floor(C(high) / CELL_DEG).cast("long"))

    cells = boxed.withColumn("_cy", F.explode(span("_s", "_n"))).withColumn("_cx", F.explode(span("_w", "_e")))

    # An edge matters in a cell if it meets the cell's row, grown by the buffer, and is not wholly west of the cell.
    south, north, west = C("_cy") * CELL_DEG - pad, (C("_cy") + 1) * CELL_DEG + pad, C("_cx") * CELL_DEG - pad / shrink
    ends = F.transform(X.indices("ring"), lambda k: F.struct(X.at("ring", k).alias("a"), X.at("ring", F.pmod(k + 1, F.size("ring"))).alias("b")))
    edges = F.transform(ends, lambda e: F.struct(e["a"]["lat"].alias("alat"), e["a"]["lon"].alias("alon"), e["b"]["lat"].alias("blat"), e["b"]["lon"].alias("blon")))
    meets = lambda e: (F.least(e["alat"], e["blat"]) <= north) & (F.greatest(e["alat"], e["blat"]) >= south) & (F.greatest(e["alon"], e["blon"]) >= west)
    whole = lambda e: e["alat"].isNotNull() & e["alon"].isNotNull() & e["blat"].isNotNull() & e["blon"].isNotNull()
    number = lambda e: ~(F.isnan(e["alat"]) | F.isnan(e["alon"]))
    cells = cells.withColumn("_sound", F.coalesce(F.forall(edges, lambda e: whole(e) & number(e)), F.lit(False)))
    cells = cells.withColumn("_edges", F.when(~_circular(), F.filter(edges, lambda e: whole(e) & meets(e))))
    cells = cells.withColumn("_n_edges", F.coalesce(F.size("_edges"), F.lit(0)))
    return cells.selectExpr("*", *[f"coalesce(get(_edges, {k}).{end}{axis}, 0D) AS _{end}{axis}{k}" for k in range(FLAT_EDGES) for end in "ab" for axis in ("lat", "lon")])


CELL_COLUMNS = ["_s", "_n", "_w", "_e", "_sound", "_edges", "_n_edges", *[c for k in range(FLAT_EDGES) for c in _edge_columns(k)]]


def _meetings(positions: DataFrame, zones: DataFrame, buffer_m: float) -> tuple[DataFrame, list[tuple[DataFrame, bool]], Column]:
    """Positions ``p`` by cell, zones ``z`` by cell with whether their edges are listed, and when the two meet.

    A position may have many zones, so positions are spread, whatever their bytes.
    """
    if not positions.isStreaming:
        positions = positions.repartition(4 * positions.sparkSession.sparkContext.defaultParallelism)
    p = (positions.withColumn("_cy", F.floor(C("latitude") / CELL_DEG).cast("long"))
                  .withColumn("_cx", F.floor(C("longitude") / CELL_DEG).cast("long"))
                  .withColumn("_east", F.cos(F.radians("latitude")) * METRES_PER_DEG)).alias("p")
    in_box = C("p.latitude").between(C("z._s"), C("z._n")) & C("p.longitude").between(C("z._w"), C("z._e"))
    cells = zone_cells(zones, buffer_m)
    sides = [(cells, False)]
    if not zones.filter(~_circular() & (F.size("ring") > FLAT_EDGES)).isEmpty():
        sides = [(cells.filter(C("_n_edges") <= FLAT_EDGES), False), (cells.filter(C("_n_edges") > FLAT_EDGES), True)]
    return p, [(small_side(z).alias("z"), listed) for z, listed in sides], (C("p._cy") == C("z._cy")) & (C("p._cx") == C("z._cx")) & in_box


def with_zone_candidates(positions: DataFrame, zones: DataFrame, test: Callable[[DataFrame, bool], DataFrame], buffer_m: float = 0.0) -> DataFrame:
    """``test`` of the position-zone pairs whose position lies in the zone's (grown) box; the box test is part of the join.

    The pairs have ``CELL_COLUMNS`` and ``_east``, metres per degree of longitude.  ``test`` is
    told whether to take a cell's edges from their list, which is so in cells of more than
    FLAT_EDGES.
    """
    p, sides, meet = _meetings(positions, zones, buffer_m)
    keep = [C(f"p.{c}") for c in [*positions.columns, "_east"]] + [C(f"z.{c}") for c in [*zones.columns, *CELL_COLUMNS]]
    out = [test(p.join(z, meet).select(*keep), listed).drop("_east", *CELL_COLUMNS) for z, listed in sides]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def positions_in_zones(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """Positions inside some zone and its altitude band; a position's search ends with its first zone."""
    p, sides, meet = _meetings(positions, zones, 0.0)
    found, rest = [], p
    for z, listed in sides:
        within = meet & in_altitude_band("altitude") & _cell_zone(listed)
        found.append(rest.join(z, within, "left_semi").select(*positions.columns))
        rest = rest.join(z, within, "left_anti").alias("p")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _blocks(positions: DataFrame) -> DataFrame:
    """Positions in blocks of neighbours in a cell: their places ``_at``, lists ``_l0, _l1, ...`` of the columns and the circle around them.

    Positions are dealt and sorted along a curve through the cells, so blocks follow density and
    no place is in one task.  A block has at most BLOCK_ROWS rows and one cell of the zones' cells.
    """
    lat, lon = C("latitude"), C("longitude")
    n = 4 * positions.sparkSession.sparkContext.defaultParallelism

    def bits(x):
        for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = f"(({x} | shiftleft({x}, {by})) & {mask})"
        return x

    there = positions.filter(lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon))
    celled = there.withColumn("_cy", F.floor(lat / CELL_DEG).cast("long")).withColumn("_cx", F.floor(lon / CELL_DEG).cast("long"))
    curve = ["_cy", "_cx", "_z"]
    fine = {c: F.least(F.floor((axis / CELL_DEG - C(cell)) * 1024), F.lit(1023)).cast("int") for c, axis, cell in (("_fy", lat, "_cy"), ("_fx", lon, "_cx"))}
    sorted_ = celled.withColumns(fine).withColumn("_z", F.expr(f"shiftleft({bits('_fy')}, 1) | {bits('_fx')}")).repartitionByRange(n, *curve).sortWithinPartitions(*curve)
    cut = sorted_.withColumn("_block", F.floor(F.monotonically_increasing_id() / BLOCK_ROWS)).withColumn("_part", F.shiftright("_z", 16))
    lists = [F.collect_list(F.struct(C(f"`{c}`").alias("v"))).alias(f"_l{k}") for k, c in enumerate(positions.columns)]  # a struct, as lists leave out nulls
    blocks = cut.groupBy("_block", "_cy", "_cx", "_part").agg(
        F.collect_list(F.struct(F.coalesce(lat, F.lit(0.0)).alias("lat"), F.coalesce(lon, F.lit(0.0)).alias("lon"))).alias("_at"), *[f(c).alias(f"_b{e}") for c, f, e in ((lat, F.min, "s"), (lat, F.max, "n"), (lon, F.min, "w"), (lon, F.max, "e"))], *lists)
    wide, narrow = (f(F.cos(F.radians("_bs")), F.cos(F.radians("_bn"))) for f in (F.greatest, F.least))
    half = lambda low, high, metres: (C(high) - C(low)) / 2 * metres
    high, broad = half("_bs", "_bn", METRES_PER_DEG), half("_bw", "_be", METRES_PER_DEG * wide)
    middle = (C("_bs") + C("_bn")) / 2
    facts = {"_lat": middle, "_lon": (C("_bw") + C("_be")) / 2, "_east": F.cos(F.radians(middle)) * METRES_PER_DEG,
             "_r": F.sqrt(high * high + broad * broad) * 1.000001 + 0.001, "_warp": F.try_divide(wide, narrow)}
    return blocks.withColumns({c: F.coalesce(v, F.lit(math.inf)) for c, v in facts.items()}).drop("_block", "_part")


def _settled(met: DataFrame, buffer_m: float, alert_m: float, listed: bool) -> DataFrame:
    """Adds to a block and a zone what all positions are to it, ``_band``: 0 inside, 1 in the alert range, 2 in the buffer, -1 beyond; 3 if that takes the positions.

    The block's circle bounds the distances of its positions; a ring that does not touch the circle has all or none inside.
    The listed edges keep this out of the generated method of the pairs, which the JVM leaves uncompiled above 8000 bytes.
    """
    metres = F.coalesce(cell_ring_distance_m("_lat", "_lon"), F.lit(math.inf)) if listed else _flat_distance_m()
    middle = geo.haversine_m("_lat", "_lon", "clat", "clon") - C("radius_m")
    planes = met if listed else _with_nearest(_with_planes(met, "_lat", "_lon"))
    bounds = planes.withColumns({"_metres": F.when(C("is_circle"), middle).otherwise(metres), "_inner": F.coalesce(inside_cell_ring("_lat", "_lon", True), F.lit(False))})
    bounds = bounds.withColumns({
        "_near": F.when(C("is_circle"), C("_metres") - C("_r")).otherwise((C("_metres") - C("_r")) / C("_warp")) - 0.001,
        "_far": F.when(C("is_circle"), C("_metres") + C("_r")).otherwise((C("_metres") + C("_r")) * C("_warp")) + 0.001})
    apart = C("_near") > 0
    deep = F.when(C("is_circle"), C("_far") <= 0).otherwise(C("_sound") & apart & C("_inner"))
    off = F.when(C("is_circle"), apart).otherwise(C("_sound") & apart & ~C("_inner"))
    return bounds.withColumn("_band", F.when(deep, 0).when(off & (C("_near") > buffer_m), -1).when(off & (C("_far") <= min(alert_m, buffer_m)), 1)
                             .when(off & (C("_near") > alert_m) & (C("_far") <= buffer_m), 2).otherwise(3))


def _sides(zones: DataFrame, buffer_m: float) -> list[tuple[DataFrame, bool, bool]]:
    """Zones by cell, whether their edges are listed, and whether they go to every executor."""
    cells = zone_cells(zones, buffer_m)
    size = cells.agg(F.count("*").alias("n"), F.coalesce(F.sum("_n_edges"), F.lit(0)).alias("edges"), F.coalesce(F.max("_n_edges"), F.lit(0)).alias("most")).first()
    small = size["n"] * 1000 + size["edges"] * 64 <= BROADCAST_BYTES  # counted, as estimates do not see cells
    if size["most"] <= FLAT_EDGES:
        return [(cells, False, small)]
    return [(cells.filter(C("_n_edges") <= FLAT_EDGES), False, small), (cells.filter(C("_n_edges") > FLAT_EDGES), True, small)]


def _pairs(positions: DataFrame, zones: DataFrame, buffer_m: float, alert_m: float, test: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``test`` of the pairs of a position and a zone that may be near it, with ``_band`` of ``_settled``, the place ``_p`` and ``CELL_COLUMNS``."""
    blocks, out = _blocks(positions), []
    touch = (C("_bs") <= C("_n")) & (C("_bn") >= C("_s")) & (C("_bw") <= C("_e")) & (C("_be") >= C("_w"))
    for cells, listed, small in _sides(zones, buffer_m):
        if small:
            p, z = blocks.repartition(4 * positions.sparkSession.sparkContext.defaultParallelism), F.broadcast(cells)
        else:
            p, z = blocks, cells.hint("merge")
        p, z = p.alias("p"), z.alias("z")
        met = p.join(z, (C("p._cy") == C("z._cy")) & (C("p._cx") == C("z._cx")) & touch).drop(C("z._cy"), C("z._cx"))
        lists, kept = [f"_l{k}" for k in range(len(positions.columns))], [C(f"z.`{c}`") for c in [*zones.columns, *CELL_COLUMNS]]
        # A generator settles a block once; a filter on it would settle it twice.
        rows = _settled(met, buffer_m, alert_m, listed).select(*kept, "_band", *lists, F.posexplode(F.when(C("_band") >= 0, C("_at"))).alias("_i", "_p"))
        own = [F.get(c, C("_i"))["v"].alias(name) for c, name in zip(lists, positions.columns)]
        out.append(test(rows.select(*own, *zones.columns, *CELL_COLUMNS, "_band", "_p"), listed))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _within(positions: DataFrame, zones: DataFrame, also: Column) -> DataFrame:
    def test(pairs, listed):
        return pairs.filter(also & ((C("_band") == 0) | _cell_zone(listed, "_p.lat", "_p.lon")))

    if positions.isStreaming:
        return with_zone_candidates(positions, zones, lambda pairs, listed: pairs.filter(also & _cell_zone(listed)))
    return _pairs(positions, zones, 0.0, 0.0, test).select(*positions.columns, *zones.columns)


def inside(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """Every (position, zone) pair with the position inside the zone, at any altitude."""
    return _within(positions, zones, F.lit(True))


def containment(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """Every (position, zone) pair with the position inside the zone and its altitude band."""
    return _within(positions, zones, in_altitude_band("altitude"))


def proximity(positions: DataFrame, zones: DataFrame, buffer_m: float = 50.0, alert_m: float = 25.0) -> DataFrame:
    """Positions within the buffer of a zone: critical inside, alert near, warning in the buffer."""
    def test(pairs, listed):
        one = F.array(F.lit(True))
        placed = pairs.withColumns({"_lat": C("_p.lat"), "_lon": C("_p.lon")}).withColumn("_ring", (C("_band") == 3) & ~_circular())
        placed = placed.withColumns({"_east": F.when(C("_ring"), F.cos(F.radians("_lat")) * METRES_PER_DEG).otherwise(0.0), "_inner": F.when(C("_ring"), inside_cell_ring("_lat", "_lon", listed)).otherwise(False)})
        placed = placed if listed else _with_planes(placed, "_lat", "_lon", "_ring")
        boxed = C("_lat").between(C("_s"), C("_n")) & C("_lon").between(C("_w"), C("_e"))
        placed = placed.select("*", F.explode(F.when((C("_band") < 3) | boxed, one)).alias("_boxed"))
        placed = placed if listed else _with_nearest(placed, "_ring")
        circle = F.greatest(F.lit(0.0), geo.haversine_m("_lat", "_lon", "clat", "clon") - C("radius_m"))
        ring = F.when(C("_inner"), 0.0).otherwise(cell_ring_distance_m("_lat", "_lon") if listed else _flat_distance_m())
        metres = F.when(C("is_circle"), circle).otherwise(ring)
        tested = placed.withColumn("_m", F.when(C("_band") == 3, metres))
        # Generators for filters, which would repeat the terms of every edge; they also part the generated methods.
        near = tested.select("*", F.explode(F.when((C("_band") < 3) | (C("_m") <= buffer_m), one)).alias("_near"))
        apart = F.when(C("is_circle"), circle).otherwise(cell_ring_distance_m("_lat", "_lon", F.cos(F.radians("_lat")) * METRES_PER_DEG))  # listed, for the size of the method
        distance = F.when(C("_band") == 0, 0.0).when(C("_band") == 3, C("_m")).otherwise(apart)
        severity = F.when((C("_band") == 0) | (C("_m") == 0), "critical").when((C("_band") == 1) | (C("_m") <= alert_m), "alert").otherwise("warning")
        return near.select(*positions.columns, *zones.columns, distance.alias("distance_m"), severity.alias("severity"))

    return _pairs(positions, zones, buffer_m, alert_m, test)


def violations(messages: DataFrame, zones: DataFrame, key: str = "uas_id", slice_seconds: int = 3600) -> DataFrame:
    """Entries into active zones: inside now, and the previous fix of the emitter was not."""
    steps = tracking.with_steps(messages, [key], slice_seconds)
    def entered(pairs, listed):
        in_box = C("_plat").between(C("_s"), C("_n")) & C("_plon").between(C("_w"), C("_e"))
        before = F.coalesce(in_box & in_altitude_band("_palt") & inside_zone("_plat", "_plon"), F.lit(False))
        return pairs.filter(in_altitude_band("altitude") & _cell_zone(listed)).filter(C("_pus").isNull() | ~before)

    return with_zone_candidates(steps, zones.filter("active"), entered)


def zones_by_type(zones: DataFrame) -> DataFrame:
    return zones.filter("active").groupBy("zone_type").agg(F.count("*").alias("n"))


# -------------------------------------------------------------------------- heat maps
def heatmap_points(detections: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    return detections.filter((C("confidence") >= min_confidence) & C("latitude").isNotNull() & C("longitude").isNotNull()).select(
        "id", "latitude", "longitude", C("confidence").alias("intensity"))


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("latitude").alias("south"), F.min("longitude").alias("west"), F.max("latitude").alias("north"),
                      F.max("longitude").alias("east"), F.count("*").alias("total_points"))


def heatmap_grid(points: DataFrame, cell_deg: float) -> DataFrame:
    """Count per cell and its share of the fullest cell."""
    cells = points.groupBy(F.floor(C("latitude") / cell_deg).alias("row"), F.floor(C("longitude") / cell_deg).alias("col")).agg(
        F.count("*").alias("n"))
    return cells.withColumn("intensity", C("n") / cells.agg(F.max("n")).scalar())


def hotspots(detections: DataFrame, radius_km: float, minimum: int, k: int = 20) -> DataFrame:
    """Grid cells truncated toward zero with at least ``minimum`` detections, fullest first."""
    size = radius_km / 111.0
    return (detections.filter(C("latitude").isNotNull() & C("longitude").isNotNull())
            .groupBy((C("latitude") / size).cast("long").alias("cell_x"), (C("longitude") / size).cast("long").alias("cell_y"))
            .agg(F.count("*").alias("detection_count"), F.avg("latitude").alias("center_lat"), F.avg("longitude").alias("center_lon"))
            .filter(C("detection_count") >= minimum).orderBy(C("detection_count").desc(), "cell_x", "cell_y").limit(k))


def coverage(sensors: DataFrame, south: float, west: float, rows: int, cols: int, cell_deg: float) -> DataFrame:
    """Share of area cells whose centre lies within some sensor's radius.

    Each sensor lists the cells of its own bounding box, so no sensor meets a far cell.
    """
    reach = C("radius_m") / METRES_PER_DEG * 1.01
    shrink = F.cos(F.radians(F.abs(C("clat")) + reach))

    def span(centre, half, origin, count):
        low = F.greatest(F.floor((centre - half - origin) / cell_deg), F.lit(0))
        high = F.least(F.floor((centre + half - origin) / cell_deg), F.lit(count - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    cells = (sensors.withColumn("row", F.explode(span(C("clat"), reach, south, rows)))
                    .withColumn("col", F.explode(span(C("clon"), reach / shrink, west, cols))))
    centre_lat, centre_lon = south + (C("row") + 0.5) * cell_deg, west + (C("col") + 0.5) * cell_deg
    covered = cells.filter(geo.haversine_m(centre_lat, centre_lon, "clat", "clon") <= C("radius_m")).select("row", "col").distinct()
    total = rows * cols
    return covered.agg(F.count("*").alias("covered_cells")).select(
        "covered_cells", (F.lit(total) - C("covered_cells")).cast("long").alias("blind_cells"),
        (C("covered_cells") * 100.0 / total).alias("coverage_percent"))


# ---------------------------------------------------------------------------- GeoJSON
def point_feature(lat, lon, properties: Column) -> Column:
    geometry = F.struct(F.lit("Point").alias("type"), F.array(X._c(lon), X._c(lat)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def line_feature(points: Column, properties: Column) -> Column:
    coords = F.transform(points, lambda p: F.array(p["longitude"], p["latitude"]))
    geometry = F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def polygon_feature(ring, properties: Column) -> Column:
    coords = F.array(F.transform(closed(ring), lambda p: F.array(p["lon"], p["lat"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
