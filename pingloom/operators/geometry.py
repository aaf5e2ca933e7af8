"""Snapping pings to route polylines and distances along them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pingloom.config import EARTH_RADIUS_MI_ROUND
from pingloom.functions.geo import haversine, planar_heading, segment_fraction


def shape_segments(shapes: DataFrame) -> DataFrame:
    """Each point with its successor; the last point of a shape is its own successor."""
    w = Window.partitionBy("shape_id").orderBy("seq")
    following = lambda c: F.coalesce(F.lead(c).over(w), F.col(c))
    return shapes.select(
        "shape_id", "seq", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("dist").alias("dist1"),
        following("lat").alias("lat2"), following("lon").alias("lon2"), following("dist").alias("dist2"),
        F.lead("seq").over(w).isNull().alias("is_last"),
    )


# The index of a shape: its pieces along a Hilbert curve over its area, in runs of 16, runs of 16 such runs, and so on, each with its
# box. Neighbours on the curve are neighbours in the plane, however the shape winds, so runs are compact.
FAN = 16
CURVE_BITS = 10
GROUP = 65_536  # points of a shape that one group searches for
PAIRS = 1 << 18  # of places and runs that are measured at once, in some ten arrays
_KEEP = 1 + 1e-9  # bounds are rounded: a run is out only if it is farther by more than this


def hilbert(x: Column, y: Column, bits: int = CURVE_BITS) -> Column:
    """Place along the Hilbert curve of a square's cell, ``x`` and ``y`` from 0 to 2 ** bits - 1: one turn of the curve a bit."""
    side = F.lit((1 << bits) - 1).cast("long")

    def turn(at: Column, bit: Column) -> Column:
        right, upper = (F.getbit(at[c], bit).cast("long") for c in "xy")
        quarter = F.when(upper == 1, F.when(right == 1, 2).otherwise(1)).otherwise(F.when(right == 1, 3).otherwise(0)).cast("long")
        flipped = (upper == 0) & (right == 1)
        a, b = F.when(flipped, side - at["x"]).otherwise(at["x"]), F.when(flipped, side - at["y"]).otherwise(at["y"])
        return F.struct(F.when(upper == 0, b).otherwise(a).alias("x"), F.when(upper == 0, a).otherwise(b).alias("y"), (at["d"] * 4 + quarter).alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.array(*map(F.lit, reversed(range(bits)))), start, turn)["d"]


def along_curve(pieces: DataFrame, ends: Sequence[str]) -> DataFrame:
    """``pieces`` that have their ``ends``, with ``_at``: their place along the Hilbert curve over their shape's area."""
    real = pieces.where(F.col("shape_id").isNotNull()).dropna(subset=list(ends))
    area = Window.partitionBy("shape_id")
    side = F.greatest(F.max("lat1").over(area) - F.min("lat1").over(area), F.max("lon1").over(area) - F.min("lon1").over(area))
    cell = lambda c: F.coalesce(F.floor(F.try_divide(F.col(c) - F.min(c).over(area), side) * F.lit((1 << CURVE_BITS) - 1)), F.lit(0))
    curved = real.withColumns({"_x": cell("lat1"), "_y": cell("lon1")}).withColumn("_d", hilbert(F.col("_x"), F.col("_y"))).drop("_x", "_y")
    return curved.withColumn("_at", (F.row_number().over(area.orderBy("_d", "seq")) - 1).cast("long")).drop("_d")


def _span(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distance from numbers to members of intervals."""
    return np.maximum(np.maximum(low - at, at - high), 0), np.maximum(high - at, at - low)


def _sin2(degrees: np.ndarray) -> np.ndarray:
    half = np.sin(np.radians(degrees) / 2)
    return half * half


class Vertices:
    """The great-circle distance, as the haversine itself, from places to the first vertices of pieces and of runs' boxes."""

    ends = ("lat1", "lon1")

    def __init__(self, pieces: pd.DataFrame):
        self.lat, self.lon = ([pieces[c].to_numpy(float) for c in self.ends if c.startswith(axis)] for axis in ("lat", "lon"))
        self.boxes = [self._box([*self.lat], [*self.lat], [*self.lon], [*self.lon])]
        while len(self.boxes[-1][0]) > FAN:
            south, north, west, east, _ = self.boxes[-1]
            starts = np.arange(0, len(south), FAN)
            merged = [f.reduceat(x, starts) for f, x in ((np.minimum, south), (np.maximum, north), (np.minimum, west), (np.maximum, east))]
            self.boxes.append((*merged, np.minimum(np.cos(np.radians(merged[0])), np.cos(np.radians(merged[1])))))

    @staticmethod
    def _box(south: list, north: list, west: list, east: list) -> tuple[np.ndarray, ...]:
        low, high = np.minimum.reduce(south), np.maximum.reduce(north)
        return low, high, np.minimum.reduce(west), np.maximum.reduce(east), np.minimum(np.cos(np.radians(low)), np.cos(np.radians(high)))

    def measure(self, lat: np.ndarray, lon: np.ndarray, piece: np.ndarray) -> np.ndarray:
        lat1, lon1 = self.lat[0][piece], self.lon[0][piece]
        return _sin2(lat1 - lat) + np.cos(np.radians(lat)) * np.cos(np.radians(lat1)) * _sin2(lon1 - lon)

    def low(self, lat: np.ndarray, lon: np.ndarray, level: int, run: np.ndarray) -> np.ndarray:
        """No member of the run is nearer."""
        south, north, west, east, narrow = (x[run] for x in self.boxes[level])
        across, far = _span(west, east, lon)
        # beyond half the globe places come nearer again; off the globe the cosine may be negative: no bound there
        turn = np.where(far > 360, 0, np.minimum(_sin2(across), _sin2(far)))
        cosine = np.cos(np.radians(lat))
        return np.where(cosine >= 0, _sin2(_span(south, north, lat)[0]) + cosine * narrow * turn, -np.inf)


class Segments(Vertices):
    """The squared planar distance in degrees from places to segments and to runs' boxes."""

    ends = ("lat1", "lon1", "lat2", "lon2")

    def measure(self, lat: np.ndarray, lon: np.ndarray, piece: np.ndarray) -> np.ndarray:
        lat1, lon1 = self.lat[0][piece], self.lon[0][piece]
        north, east = self.lat[1][piece] - lat1, self.lon[1][piece] - lon1
        square = north * north + east * east
        t = np.where(square < 1e-300, 0, np.clip(((lon - lon1) * east + (lat - lat1) * north) / np.where(square > 0, square, 1), 0, 1))
        return (lat - (lat1 + t * north)) ** 2 + (lon - (lon1 + t * east)) ** 2

    def low(self, lat: np.ndarray, lon: np.ndarray, level: int, run: np.ndarray) -> np.ndarray:
        south, north, west, east, _ = (x[run] for x in self.boxes[level])
        return _span(south, north, lat)[0] ** 2 + _span(west, east, lon)[0] ** 2


def search(shape: Vertices, seq: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest piece of each place (lowest sequence on a tie), and how many pieces were measured for it.

    All places descend together: on each level the runs are left whose lower bound isn't above the distance to some vertex seen. Where
    too many are left, as on a dense shape or far from it, half of the places go on first.
    """
    n, top, pieces = len(lat), np.arange(len(shape.boxes[-1][0])), len(seq)
    best, measured, bound = np.zeros(n, int), np.zeros(n, int), np.full(n, np.inf)
    todo = [(len(shape.boxes) - 1, np.repeat(np.arange(n), len(top)), np.tile(top, n))] if n else []
    while todo:
        level, place, run = todo.pop()
        if level:
            # a piece of each run, from its middle, for an upper bound
            middle = np.minimum(run * FAN ** level + FAN ** level // 2, pieces - 1)
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            own = place[first]
            bound[own] = np.minimum(bound[own], np.minimum.reduceat(shape.measure(lat[place], lon[place], middle), first) * _KEEP + 1e-300)
            kept = shape.low(lat[place], lon[place], level, run) <= bound[place]
            todo += [(level - 1, *_expanded(p, r, len(shape.boxes[level - 1][0]))) for p, r in _halves(place[kept], run[kept])]
        else:
            own, first, count = np.unique(place, return_index=True, return_counts=True)
            order = np.lexsort((seq[run], shape.measure(lat[place], lon[place], run), place))
            best[own], measured[own] = run[order[first]], count
    return best, measured


def _halves(place: np.ndarray, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs, cut between places until a part has at most ``PAIRS`` on the next level or is of one place."""
    if len(place) * FAN <= PAIRS or place[0] == place[-1]:
        yield place, run
        return
    middle = place[len(place) // 2]
    at = np.searchsorted(place, middle if middle > place[0] else middle + 1)
    yield from _halves(place[:at], run[:at])
    yield from _halves(place[at:], run[at:])


def _expanded(place: np.ndarray, run: np.ndarray, members: int) -> tuple[np.ndarray, np.ndarray]:
    """Each run's own runs on the next level, ``members`` in all."""
    place, run = np.repeat(place, FAN), (run[:, None] * FAN + np.arange(FAN)).ravel()
    real = run < members
    return place[real], run[real]


def _nearest(points: DataFrame, pieces: DataFrame, kind: type[Vertices], chunk: int = 8_192) -> DataFrame:
    """Points with ``_s``, the piece of their shape that is nearest (lowest sequence on a tie).

    Points are counted by shape first, so that a shape of many points is searched by many groups. A group builds the shape's boxes,
    a fifteenth of its pieces, and searches its points in chunks. A point without a place or a shape stays, with NULLs.
    """
    named = list(points.columns)
    fields = [c for c in pieces.columns if c != "shape_id"]
    counts = points.groupBy(F.col("shape_id").alias("_shape")).agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("_parts"))
    slots = points.withColumn("_slot", F.pmod(F.xxhash64(*named), F.lit(1 << 30)))
    met = slots.join(counts, F.col("shape_id").eqNullSafe(F.col("_shape"))).withColumn("_part", F.col("_slot") % F.col("_parts"))
    told = counts.withColumnRenamed("_shape", "shape_id").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts").cast("long") - 1)))
    lines = along_curve(pieces, kind.ends).join(told.select("shape_id", "_part"), "shape_id")
    piece = T.StructType([T.StructField(c, pieces.schema[c].dataType) for c in fields])
    schema = T.StructType([*points.schema.fields, T.StructField("_s", piece)])
    kinds = pa.struct([(f.name, to_arrow_type(f.dataType)) for f in piece])

    def run(batch: pa.Table, line: pa.Table) -> pa.Table:
        lat, lon = (pc.cast(batch[c], pa.float64()).to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0) for c in ("lat", "lon"))
        best = np.full(batch.num_rows, -1)
        placed = np.flatnonzero(~(np.isnan(lat) | np.isnan(lon)))
        if line.num_rows and len(placed):
            line = line.sort_by("_at")
            shape, seq = kind(line.select(list(kind.ends)).to_pandas()), line["seq"].to_numpy()
            for a in range(0, len(placed), chunk):
                at = placed[a:a + chunk]
                best[at] = search(shape, seq, lat[at], lon[at])[0]
        found = pa.array(np.where(best < 0, 0, best), pa.int64(), mask=best < 0)
        members = [pc.cast(line[c].combine_chunks(), t.type).take(found) for c, t in zip(fields, kinds, strict=True)]
        picked = pa.StructArray.from_arrays(members, fields=list(kinds), mask=pa.array(best < 0))
        return pa.table([*(batch[c] for c in named), picked], names=[*named, "_s"])

    left = met.select(*named, F.col("shape_id").alias("_shape"), F.col("_part").cast("long").alias("_part"))
    right = lines.select(F.col("shape_id").alias("_shape"), "_part", "_at", *fields)
    return left.groupBy("_shape", "_part").cogroup(right.groupBy("_shape", "_part")).applyInArrow(run, schema)


def _piece(*names: str) -> list[Column]:
    return [F.col(f"_s.{n}") for n in names]


def snap_to_shape(points: DataFrame, segments: DataFrame, key: list[str], radius: float = EARTH_RADIUS_MI_ROUND) -> DataFrame:
    """Distance along the shape at the foot on the segment after the nearest vertex, and how far off.

    ``points`` need ``shape_id, lat, lon``; ``key`` identifies a point together with its shape.
    """
    found = _nearest(points.select(*dict.fromkeys([*key, "shape_id", "lat", "lon"])), segments, Vertices)
    lat1, lon1, lat2, lon2, dist1, dist2 = _piece("lat1", "lon1", "lat2", "lon2", "dist1", "dist2")
    t = segment_fraction("lat", "lon", lat1, lon1, lat2, lon2)
    return found.select(*key, F.col("_s.seq").alias("seq"), F.when(F.col("_s").isNotNull(), dist1 + t * (dist2 - dist1)).alias("along"), haversine("lat", "lon", lat1, lon1, radius).alias("off"))


def project_onto_polyline(points: DataFrame, segments: DataFrame, key: list[str]) -> DataFrame:
    """Nearest segment by perpendicular distance: its index, the fraction on it, the foot, the distance."""
    real = segments.where(~F.col("is_last"))

    def foot(s) -> tuple[Column, Column, Column]:
        t = segment_fraction("lat", "lon", s["lat1"], s["lon1"], s["lat2"], s["lon2"], tiny=1e-300)
        return t, s["lat1"] + t * (s["lat2"] - s["lat1"]), s["lon1"] + t * (s["lon2"] - s["lon1"])

    found = _nearest(points.select(*dict.fromkeys([*key, "shape_id", "lat", "lon"])), real, Segments)
    t, foot_lat, foot_lon = foot(F.col("_s"))
    some = lambda c: F.when(F.col("_s").isNotNull(), c)
    return found.select(
        *key, F.col("_s.seq").alias("seq"), some(t).alias("fraction"), foot_lat.alias("foot_lat"), foot_lon.alias("foot_lon"),
        F.sqrt((F.col("lat") - foot_lat) * (F.col("lat") - foot_lat) + (F.col("lon") - foot_lon) * (F.col("lon") - foot_lon)).alias("distance"), planar_heading(*_piece("lat1", "lon1", "lat2", "lon2")).alias("heading"),
    )


def planar_lengths(segments: DataFrame) -> DataFrame:
    """Segments with their planar length and the length before them along the shape."""
    length = F.sqrt(F.pow(F.col("lat2") - F.col("lat1"), 2) + F.pow(F.col("lon2") - F.col("lon1"), 2))
    before = Window.partitionBy("shape_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return segments.where(~F.col("is_last")).withColumn("length", length).withColumn(
        "before", F.coalesce(F.sum("length").over(before), F.lit(0.0))
    )


def interpolate_along(moves: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Point at share ``t`` of the path between two places (segment index + fraction) on a shape.

    Both ends are looked up by (shape, index). The segment that holds the target length lies in the target's bucket: lengths
    are cut into as many equal buckets as the shape has segments, and a bucket lists the few segments that touch it.
    """
    line = planar_lengths(segments).select("shape_id", "seq", "before", "length", "lat1", "lon1", "lat2", "lon2")
    whole = line.groupBy("shape_id").agg(F.max(F.col("before") + F.col("length")).alias("_total"), F.count(F.lit(1)).alias("_n"))
    width = F.when(F.col("_total") > 0, F.col("_total") / F.col("_n")).otherwise(F.lit(1.0))
    sized = whole.select("shape_id", width.alias("_width"), F.floor(F.col("_total") / width).alias("_top"))
    bucket = lambda x: F.floor(x / F.col("_width"))
    touched = F.sequence(bucket(F.col("before")) - 1, bucket(F.col("before") + F.col("length")) + 1)
    listed = line.join(sized, "shape_id").withColumn("_bucket", F.explode(touched)).groupBy("shape_id", "_bucket").agg(
        F.array_sort(F.collect_list(F.struct("seq", "before", "length", "lat1", "lon1", "lat2", "lon2"))).alias("_line"))
    end = lambda name: line.select("shape_id", F.col("seq").alias(f"{name}_seq"), F.col("before").alias(f"_{name}_before"), F.col("length").alias(f"_{name}_length"))
    at = lambda name: F.col(f"_{name}_before") + F.col(f"{name}_fraction") * F.col(f"_{name}_length")
    joined = moves.join(end("from"), ["shape_id", "from_seq"]).join(end("to"), ["shape_id", "to_seq"]).join(sized, "shape_id")
    target = at("from") + F.col("t") * (at("to") - at("from"))
    placed = joined.withColumn("_target", target).withColumn("_bucket", F.greatest(F.lit(0), F.least(bucket(F.col("_target")), F.col("_top"))))
    holding = F.get(F.filter("_line", lambda s: s["before"] + s["length"] >= F.col("_target")), F.lit(0))
    spot = placed.join(listed, ["shape_id", "_bucket"]).withColumn("_seg", F.coalesce(holding, F.try_element_at("_line", F.lit(-1)))).withColumn(
        "_share", F.coalesce(F.try_divide(F.col("_target") - F.col("_seg.before"), F.col("_seg.length")), F.lit(0.0)))
    return spot.select(
        key,
        (F.col("_seg.lat1") + F.col("_share") * (F.col("_seg.lat2") - F.col("_seg.lat1"))).alias("lat"),
        (F.col("_seg.lon1") + F.col("_share") * (F.col("_seg.lon2") - F.col("_seg.lon1"))).alias("lon"),
    )


def route_distance(snapped: DataFrame, lengths: DataFrame, stop_dist: str = "stop_dist", fallback: str = "straight") -> DataFrame:
    """Way left to the stop along its shape; a passed stop is a whole loop away; no stop: straight line."""
    left = F.col(stop_dist) - F.col("along")
    looped = F.when(left < 0, F.col("shape_length") + left).otherwise(left)
    return snapped.join(lengths, "shape_id", "left").withColumn(
        "route_distance", F.coalesce(F.when(looped.isNotNull(), F.greatest(looped, F.lit(0.0))), F.col(fallback))
    )


def route_distance_multi(candidates: DataFrame, key: list[str], gate: float = 0.2, close: float = 0.1, past: float = 0.1, far: float = 5.0) -> DataFrame:
    """Best way to a stop over several shapes of a route.

    ``candidates`` has one row per (point, shape): ``along, off, stop_dist, shape_length``. Shapes
    farther than the gate are ignored. Approaching beats wrapped; among close approaching shapes the
    shortest way wins, otherwise the closest shape; a wrapped way above ``far`` is no answer.
    """
    left = F.col("stop_dist") - F.col("along")
    wrapped = left < -past
    way = F.when(left >= 0, left).when(wrapped, F.col("shape_length") + left).otherwise(F.lit(0.0))
    usable = candidates.where(F.col("off") <= gate).select(
        *key, way.alias("_way"), wrapped.alias("_wrapped"), "off").where(~F.col("_wrapped") | (F.col("_way") > 0))
    order = (
        F.when(~F.col("_wrapped") & (F.col("off") < close), F.struct(F.lit(0).alias("c"), F.col("_way").alias("a"), F.col("off").alias("b")))
        .when(~F.col("_wrapped"), F.struct(F.lit(1).alias("c"), F.col("off").alias("a"), F.col("_way").alias("b")))
        .otherwise(F.struct(F.lit(2).alias("c"), F.col("_way").alias("a"), F.col("off").alias("b")))
    )
    best = usable.groupBy(*key).agg(F.min(F.struct(order.alias("o"), F.col("_way").alias("w"))).alias("_b"))
    return best.select(
        *key, F.when((F.col("_b.o.c") == 2) & (F.col("_b.w") > far), F.lit(None)).otherwise(F.col("_b.w")).alias("route_distance")
    )
