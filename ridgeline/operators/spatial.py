"""Points near other points, and the regions that contain points.

Regions: rings are cut into triangles by ear clipping; the triangles are
distributed through bounding-volume hierarchies, candidate triangles are tested
exactly and a region met through several triangles (a shared edge) counts once.
A hierarchy is broadcast only while it has at most ``max_broadcast`` triangles;
beyond that the triangles are dealt into cells of a degree and, where a cell is
crowded, into shards of about ``shard`` triangles; every shard has its own
hierarchy, and the points of a cell go to its shards, in as many parts as their
number asks for.

Circles: the box in latitude and longitude around each circle is two triangles
(four where it wraps at 180) that go the same way (:func:`within_circles`); the
pairs found are then tested by their exact great-circle distance.

Neighbours by a grid, for ids of any type: targets are written into every cell
of a latitude/longitude grid that their circle touches (longitude wraps at 180,
cells widen towards the poles), points look up their own cell: an equi join, so
no pair is formed that is not in the same cell (:func:`near`).

Defined cases: points with a null, NaN or impossible coordinate have no row;
rings with fewer than three distinct corners cover nothing; a point on an edge
belongs to the region, one on a hole's edge to the hole; repeated points keep
their own rows, repeated targets are found under each id; empty inputs give an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline import session

EARTH_KM = 6371.0088
MAX_BROADCAST = 200_000


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of the mean radius."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # (least() would pass over a null)


def valid_position(lat: Column, lon: Column) -> Column:
    """Both there, within the globe and no NaN (which sorts above any number)."""
    return lat.between(-90, 90) & lon.between(-180, 180)


# --- neighbours -----------------------------------------------------------


def _lon_steps(band: Column, cell_deg: float) -> Column:
    """Number of longitude cells of a latitude band: as many as keep a cell about as wide as high at the band's edge nearer to the pole."""
    edge = F.least(F.greatest(F.abs(band * cell_deg), F.abs((band + 1) * cell_deg)), F.lit(90.0))
    return F.greatest(F.floor(360.0 * F.cos(F.radians(edge)) / cell_deg), F.lit(1)).cast("bigint")


def _lon_cell(lon: Column, steps: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * steps), steps)


def near(points: DataFrame, targets: DataFrame, radius_km: float, *, point: tuple[str, str, str], target: tuple[str, str, str], salts: int = 1, by: str | None = None) -> DataFrame:
    """point id, target id, distance_km of every pair within ``radius_km`` (inclusive). ``point`` and ``target`` name id, latitude and longitude. With ``by``, only pairs that agree in that column, which the result has too. With ``salts`` > 1, cells are split so many times (targets are repeated), for data in which a few cells hold most points and the targets are too many to broadcast."""
    degrees = math.degrees(radius_km / EARTH_KM) * (1 + 1e-9) + 1e-12
    # a cell is a bit wider than the radius, so that a circle meets few cells
    cell = max(degrees * 1.5, 180.0 / 2**20)
    own = [F.col(by).alias("_by")] if by else []
    p = points.select(F.col(point[0]).alias("_pid"), F.col(point[1]).alias("_plat"), F.col(point[2]).alias("_plon"), *own).filter(valid_position(F.col("_plat"), F.col("_plon")))
    t = targets.select(F.col(target[0]).alias("_tid"), F.col(target[1]).alias("_tlat"), F.col(target[2]).alias("_tlon"), *own).filter(valid_position(F.col("_tlat"), F.col("_tlon")))
    band = lambda lat: F.floor(lat / cell).cast("bigint")
    p = p.withColumn("_band", band(F.col("_plat"))).withColumn("_cell", _lon_cell(F.col("_plon"), _lon_steps(F.col("_band"), cell)))
    t = t.withColumn("_band", F.explode(F.sequence(band(F.greatest(F.col("_tlat") - degrees, F.lit(-90.0))), band(F.least(F.col("_tlat") + degrees, F.lit(90.0))))))
    # half width in longitude of the circle; all longitudes once it reaches a pole
    ratio = F.lit(math.sin(math.radians(degrees))) / F.cos(F.radians("_tlat"))
    width = F.when((F.abs("_tlat") + degrees >= 90.0) | (ratio >= 1), 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9) + 1e-12)
    steps = _lon_steps(F.col("_band"), cell)
    first = F.floor((F.col("_tlon") - width + 180.0) / 360.0 * steps).cast("bigint")
    last = F.floor((F.col("_tlon") + width + 180.0) / 360.0 * steps).cast("bigint")
    t = t.withColumn("_cell", F.explode(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + steps - 1)), lambda x: F.pmod(x, steps)))))
    keys = ["_band", "_cell", *(["_by"] if by else [])]
    if salts > 1:
        p = p.withColumn("_salt", F.pmod(F.xxhash64("_pid"), F.lit(salts)))
        t = t.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        keys.append("_salt")
    pairs = p.join(t, keys).withColumn("distance_km", haversine_km(F.col("_plat"), F.col("_plon"), F.col("_tlat"), F.col("_tlon")))
    return pairs.filter(F.col("distance_km") <= radius_km).select(*([F.col("_by").alias(by)] if by else []), F.col("_pid").alias(point[0]), F.col("_tid").alias(target[0]), "distance_km")


# --- regions --------------------------------------------------------------


def _cross(ax, ay, bx, by, px, py):
    """Twice the signed area of a, b, p, computed from the lesser corner of the edge, so that both triangles at an edge see the same rounding."""
    swap = (ax > bx) | ((ax == bx) & (ay > by))
    ux, uy, vx, vy = np.where(swap, bx, ax), np.where(swap, by, ay), np.where(swap, ax, bx), np.where(swap, ay, by)
    area = (vx - ux) * (py - uy) - (vy - uy) * (px - ux)
    return np.where(swap, -area, area)


def ear_clip(xs: list[float], ys: list[float]) -> np.ndarray:
    """Triangles, shape (n, 3, 2), of a simple ring in either direction, closed or not. Degenerate ears (three corners in line) are dropped."""
    ring: list[tuple[float, float]] = []
    for x, y in zip(xs, ys):
        if x is None or y is None or x != x or y != y:
            continue
        if not ring or ring[-1] != (x, y):
            ring.append((float(x), float(y)))
    if len(ring) > 1 and ring[0] == ring[-1]:
        ring.pop()
    if len(ring) < 3:
        return np.zeros((0, 3, 2))
    pts = np.array(ring)
    nxt = np.roll(pts, -1, 0)
    if (pts[:, 0] * nxt[:, 1] - nxt[:, 0] * pts[:, 1]).sum() < 0:
        pts = pts[::-1].copy()
    idx, out = list(range(len(pts))), []

    def turn(a: int, b: int, c: int) -> float:
        return float(_cross(pts[a, 0], pts[a, 1], pts[b, 0], pts[b, 1], pts[c, 0], pts[c, 1]))

    while len(idx) > 3:
        for k in range(len(idx)):
            a, b, c = idx[k - 1], idx[k], idx[(k + 1) % len(idx)]
            area = turn(a, b, c)
            if area < 0:
                continue
            if area == 0:
                idx.pop(k)
                break
            rest = np.array([i for i in idx if i not in (a, b, c)])
            x, y = pts[rest, 0], pts[rest, 1]
            within = (_cross(*pts[a], *pts[b], x, y) >= 0) & (_cross(*pts[b], *pts[c], x, y) >= 0) & (_cross(*pts[c], *pts[a], x, y) >= 0)
            # a corner that repeats one of the ear's own does not block it
            same = (pts[rest] == pts[a]).all(1) | (pts[rest] == pts[b]).all(1) | (pts[rest] == pts[c]).all(1)
            if not (within & ~same).any():
                out.append((a, b, c))
                idx.pop(k)
                break
        else:  # only a ring that crosses itself has no ear: cut the convex corner of least area
            k = min((k for k in range(len(idx))), key=lambda k: abs(turn(idx[k - 1], idx[k], idx[(k + 1) % len(idx)])))
            out.append((idx[k - 1], idx[k], idx[(k + 1) % len(idx)]))
            idx.pop(k)
    if turn(*idx) != 0:
        out.append(tuple(idx))
    return pts[np.array(out)] if out else np.zeros((0, 3, 2))


def triangles(areas: DataFrame) -> DataFrame:
    """area_id, is_hole and the six coordinates of each triangle of each ring."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for area, hole, lat, lon in zip(batch.area_id, batch.is_hole, batch.ring_lat, batch.ring_lon):
                if lat is None or lon is None or area is None or area != area:
                    continue
                for t in ear_clip(list(lon), list(lat)):
                    rows.append((int(area), bool(hole), *map(float, t.ravel())))
            yield pd.DataFrame(rows, columns=["area_id", "is_hole", "x0", "y0", "x1", "y1", "x2", "y2"])

    return areas.select("area_id", F.coalesce("is_hole", F.lit(False)).alias("is_hole"), "ring_lat", "ring_lon").mapInPandas(cut, "area_id long, is_hole boolean, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double")


class Hierarchy:
    """A bounding-volume hierarchy over triangles, split at the median of the longer side; queries walk it with whole batches of points."""

    LEAF = 8

    def __init__(self, area: np.ndarray, hole: np.ndarray, corners: np.ndarray) -> None:
        self.area, self.hole, self.corners = area, hole, corners
        self.nodes: list[tuple[float, float, float, float, int, int, np.ndarray | None]] = []
        if len(area):
            self._build(np.arange(len(area)))

    def _build(self, rows: np.ndarray) -> int:
        t = self.corners[rows]
        low, high = t.min((0, 1)), t.max((0, 1))
        at = len(self.nodes)
        self.nodes.append((low[0], low[1], high[0], high[1], -1, -1, rows))
        if len(rows) > self.LEAF:
            order = np.argsort(t.mean(1)[:, int(high[1] - low[1] > high[0] - low[0])], kind="stable")
            half = len(rows) // 2
            left, right = self._build(rows[order[:half]]), self._build(rows[order[half:]])
            self.nodes[at] = (low[0], low[1], high[0], high[1], left, right, None)
        return at

    def query(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Point index, area and hole flag of every triangle that holds a point, edges included."""
        found_p, found_t = [], []
        stack = [(0, np.arange(len(x)))] if self.nodes else []
        while stack:
            node, pts = stack.pop()
            x0, y0, x1, y1, left, right, rows = self.nodes[node]
            pts = pts[(x[pts] >= x0) & (x[pts] <= x1) & (y[pts] >= y0) & (y[pts] <= y1)]
            if not len(pts):
                continue
            if rows is None:
                stack += [(left, pts), (right, pts)]
                continue
            for r in rows:
                (ax, ay), (bx, by), (cx, cy) = self.corners[r]
                px, py = x[pts], y[pts]
                inside = (_cross(ax, ay, bx, by, px, py) >= 0) & (_cross(bx, by, cx, cy, px, py) >= 0) & (_cross(cx, cy, ax, ay, px, py) >= 0)
                hit = pts[inside]
                found_p.append(hit)
                found_t.append(np.full(len(hit), r))
        if not found_p:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none.astype(bool)
        p, t = np.concatenate(found_p), np.concatenate(found_t)
        return p, self.area[t], self.hole[t]


def _from_pandas(t: pd.DataFrame) -> Hierarchy:
    return Hierarchy(t.area_id.to_numpy(np.int64), t.is_hole.to_numpy(bool), t[["x0", "y0", "x1", "y1", "x2", "y2"]].to_numpy(float).reshape(-1, 3, 2))


_HIT = "_pid long, _x double, _y double, area_id long, hole boolean"


def _hits(tree: Hierarchy, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """Every point with every area that it is in, each once."""
    p, area, hole = tree.query(x, y)
    once = pd.DataFrame({"p": p, "area_id": area, "hole": hole}).drop_duplicates()
    at = once.p.to_numpy()
    return pd.DataFrame({"_pid": ids[at], "_x": x[at], "_y": y[at], "area_id": once.area_id.to_numpy(), "hole": once.hole.to_numpy()})


def _candidates(p: DataFrame, cut: DataFrame, max_broadcast: int, shard: int, shard_by: list[str], part_points: int = 200_000) -> DataFrame:
    """_pid, _x, _y, area_id, hole of every point (_pid, _x, _y) and every area of the triangles that it lies in."""
    spark = p.sparkSession
    few = cut.limit(max_broadcast + 1).toPandas()  # bounded: decides how the triangles travel
    if len(few) <= max_broadcast:
        shared = spark.sparkContext.broadcast(few)
        trees: dict[int, Hierarchy] = {}

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if 0 not in trees:
                trees[0] = _from_pandas(shared.value)
            for batch in batches:
                yield _hits(trees[0], batch._pid.to_numpy(), batch._x.to_numpy(), batch._y.to_numpy())

        return p.mapInPandas(look_up, _HIT)
    cell = ["_cx", "_cy"]
    cells = lambda c: F.floor(c).cast("int")
    t = cut.select("*", F.explode(F.sequence(cells(F.least("x0", "x1", "x2")), cells(F.greatest("x0", "x1", "x2")))).alias("_cx"))
    t = t.select("*", F.explode(F.sequence(cells(F.least("y0", "y1", "y2")), cells(F.greatest("y0", "y1", "y2")))).alias("_cy"))
    q = p.withColumn("_cx", cells(F.col("_x"))).withColumn("_cy", cells(F.col("_y")))
    # a row per cell: how many shards its triangles need, and how many parts its points
    count = session.cut(t.groupBy(*cell).agg(F.ceil(F.count("*") / shard).cast("int").alias("_n")).join(q.groupBy(*cell).agg(F.ceil(F.count("*") / part_points).cast("int").alias("_m")), cell))
    t = t.join(count, cell).withColumn("_s", F.pmod(F.xxhash64(*shard_by), F.col("_n")).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    q = q.join(count, cell).withColumn("_part", F.pmod(F.xxhash64("_pid"), F.col("_m")).cast("int")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _hits(_from_pandas(right), left._pid.to_numpy(), left._x.to_numpy(), left._y.to_numpy())

    keys = [*cell, "_s", "_part"]
    return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(meet, _HIT)


def _points(points: DataFrame, point: tuple[str, str, str]) -> DataFrame:
    p = points.select(F.col(point[0]).alias("_pid"), F.col(point[1]).cast("double").alias("_y"), F.col(point[2]).cast("double").alias("_x"))
    return p.filter(valid_position(F.col("_y"), F.col("_x")))


def containing(points: DataFrame, areas: DataFrame, *, point: tuple[str, str, str], max_broadcast: int = MAX_BROADCAST, shard: int = 20_000) -> DataFrame:
    """point id, area_id of every area that holds the point and none of whose holes does. ``point`` names an id, unique per point, latitude and longitude."""
    hits = _candidates(_points(points, point), triangles(areas), max_broadcast, shard, ["area_id", "x0", "y0", "x1", "y1"])
    within = hits.groupBy("_pid", "area_id").agg(F.max("hole").alias("hole"))
    return within.filter(~F.col("hole")).select(F.col("_pid").alias(point[0]), "area_id")


def circle_triangles(targets: DataFrame, radius_km: float, target: tuple[str, str, str]) -> DataFrame:
    """area_id (the target's id), is_hole and the six coordinates of the triangles that cover each target's circle."""
    degrees = math.degrees(radius_km / EARTH_KM) * (1 + 1e-9) + 1e-12
    t = targets.select(F.col(target[0]).alias("area_id"), F.col(target[1]).alias("_lat"), F.col(target[2]).alias("_lon")).filter(valid_position(F.col("_lat"), F.col("_lon")))
    # half width in longitude of the circle; all longitudes once it reaches a pole
    ratio = F.lit(math.sin(math.radians(degrees))) / F.cos(F.radians("_lat"))
    width = F.when((F.abs("_lat") + degrees >= 90.0) | (ratio >= 1), 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9) + 1e-12)
    west, east = F.col("_lon") - width, F.col("_lon") + width
    span = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    whole, low, high = F.lit(-180.0), F.greatest(west, F.lit(-180.0)), F.least(east, F.lit(180.0))
    spans = F.when(width >= 180, F.array(span(whole, F.lit(180.0)))).otherwise(F.concat(F.array(span(low, high)), F.when(west < -180, F.array(span(west + 360, F.lit(180.0)))).when(east > 180, F.array(span(whole, east - 360))).otherwise(F.array().cast("array<struct<a:double,b:double>>"))))
    t = t.select("area_id", F.greatest(F.col("_lat") - degrees, F.lit(-90.0)).alias("s"), F.least(F.col("_lat") + degrees, F.lit(90.0)).alias("n"), F.explode(spans).alias("w"))
    corner = lambda x, y, i: [F.col(f"w.{x}").alias(f"x{i}"), F.col(y).alias(f"y{i}")]
    halves = F.array(F.struct(*corner("a", "s", 0), *corner("b", "s", 1), *corner("b", "n", 2)), F.struct(*corner("a", "s", 0), *corner("b", "n", 1), *corner("a", "n", 2)))
    return t.select("area_id", F.lit(False).alias("is_hole"), F.explode(halves).alias("h")).select("area_id", "is_hole", "h.*")


def within_circles(points: DataFrame, targets: DataFrame, radius_km: float, *, point: tuple[str, str, str], target: tuple[str, str, str], max_broadcast: int = MAX_BROADCAST, shard: int = 20_000) -> DataFrame:
    """point id, target id, distance_km of every pair within ``radius_km`` (inclusive), by the hierarchy over the circles. Ids are whole numbers; target ids are unique."""
    hits = _candidates(_points(points, point), circle_triangles(targets, radius_km, target), max_broadcast, shard, ["area_id"])  # a circle's triangles stay together
    t = targets.select(F.col(target[0]).alias("area_id"), F.col(target[1]).alias("_tlat"), F.col(target[2]).alias("_tlon"))
    pairs = hits.join(t, "area_id").withColumn("distance_km", haversine_km(F.col("_y"), F.col("_x"), F.col("_tlat"), F.col("_tlon")))
    return pairs.filter(F.col("distance_km") <= radius_km).select(F.col("_pid").alias(point[0]), F.col("area_id").alias(target[0]), "distance_km")
