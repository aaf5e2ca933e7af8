"""Near-duplicate vectors: an exact range join in the metric space of angles.

Two vectors link if the angle between them is at most ``reach`` (the angle of the threshold's cosine). Pivots cut the vectors into
cells, each vector in that of its nearest pivot. Where the sample shows many vectors close together, their centre is a pivot too, and
the members of its cell within ``reach / 2`` of it are its core: by the triangle inequality they all link with each other, so a group
of copies is counted and not compared, however large. The other members of a cell, and cores, are cut into units of bounded size.

Two units are compared at one of them. A vector is sent there only if it could link with a member: if its angle to the pivot lies
within ``reach`` of the members' angles (the triangle inequality), and it is within reach of the plane that separates the two cells. A
vector whose angle to a core's pivot plus the core's radius is within ``reach`` links with the whole core, without a comparison. What
is sent to a unit comes in groups of bounded size, compared independently; a group returns counts, and of the links those that connect
what is linked. Components are found from these by alternating stars.

The join is exact: pivots decide the work, not the result. Vectors without structure (uniform on a sphere of many dimensions) lie within
reach of most cells' bounds, and then most units are compared with each other.

Defined cases: vectors that are null, zero or hold a null or non-finite component link with nothing; vectors meet only vectors of their
own length; repeated rows are vectors of their own, as are rows that share an id; a row without an id links like others, a component's
id is its smallest known one, and rows of a component without any known id are all kept; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingloom.llm.ann import exact, unit
from pingloom.llm.neardup import components
from pingloom.plans.stages import materialize


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    rows: int = 8_192  # of a unit
    group: int = 4  # units whose vectors come to another one together
    sample: int = 4_096  # vectors from which pivots are chosen
    pivots: int = 512  # of a vector length, at most
    dense: int = 8  # vectors of the sample this close to one another make a core
    columns: int = 1_024  # compared with a unit at a time


_SLACK = 1e-6  # radians, and single-precision cosines are off by less than a hundred of it


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def choose(x: np.ndarray, count: int, s: Settings) -> tuple[np.ndarray, int]:
    """Pivots from a sample of unit vectors: first the centres of dense places (their number is the second result)."""
    half = math.acos(s.threshold) / 2 - 2 * _SLACK
    single = x.astype(np.float32)
    near = single @ single.T >= math.cos(half)
    left, balls = near.sum(1), []
    free = np.ones(len(x), bool)
    while len(balls) < s.pivots // 2 and (best := int(np.argmax(left))) >= 0 and left[best] >= s.dense:
        members = np.flatnonzero(near[best] & free)
        balls.append(unit(x[members].sum(0)[None])[0])
        free[members] = False
        left = left - near[:, members].sum(1)
        left[~free] = 0
    rest = x[free]
    centres = rest[:count]
    for _ in range(5 if len(centres) else 0):
        own = np.argmax(rest @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rest)
        full = np.abs(sums).max(1) > 0
        centres[full] = unit(sums[full])
    return np.vstack([np.array(balls).reshape(-1, x.shape[1]), centres]), len(balls)


def forest(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what ``mask`` links: of each component a star about one of its members."""
    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    mask = mask[np.ix_(rows, cols)]
    out, todo = [], np.ones(len(rows), bool)
    todo_cols = np.ones(len(cols), bool)
    for k in range(len(rows)):
        if not todo[k]:
            continue
        todo[k] = False
        centre, edge = int(left[rows[k]]), np.array([k])
        while len(edge):
            new = np.flatnonzero(mask[edge].any(0) & todo_cols)
            todo_cols[new] = False
            out += [(centre, y) for y in right[cols[new]].tolist() if y != centre]
            edge = np.flatnonzero(mask[:, new].any(1) & todo) if len(new) else new
            todo[edge] = False
            out += [(centre, x) for x in left[rows[edge]].tolist() if x != centre]
    return out


def linked(a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of at least the threshold, in double precision."""
    rough = unit(a).astype(np.float32) @ unit(b).astype(np.float32).T
    mask = rough >= s.threshold
    x, y = np.nonzero(np.abs(rough - np.float32(s.threshold)) < 1e-4)
    if len(x):
        mask[x, y] = exact(a[x], b[y]) >= s.threshold
    return mask


def _block(inner: pd.DataFrame, outer: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """Counts (x, null, n) and connecting links (x, y, null) of a unit with a group sent to it, or with itself if nothing was."""
    if not len(inner):  # a unit that the hash left empty
        return pd.DataFrame({"x": np.zeros(0, np.int64), "y": pd.array([], "Int64"), "n": pd.array([], "Int64")})
    ids, v = inner["rid"].to_numpy(), np.stack(inner["vec"].to_numpy()).astype(float)
    itself = not len(outer)
    other, w = (ids, v) if itself else (outer["rid"].to_numpy(), np.stack(outer["vec"].to_numpy()).astype(float))
    own, counts, links = np.zeros(len(ids), np.int64), [], []
    for k in range(0, len(other), s.columns):
        mask = linked(v, w[k:k + s.columns], s)
        if itself:
            mask[np.arange(k, k + mask.shape[1]), np.arange(mask.shape[1])] = False
        else:
            own += mask.sum(1)
        if mask.any():
            counts.append(mask.sum(0))
            links += forest(mask, ids, other[k:k + s.columns])
        else:
            counts.append(np.zeros(mask.shape[1], np.int64))
    x, n = (other, np.concatenate(counts)) if itself else (np.r_[ids, other], np.r_[own, np.concatenate(counts)])
    some = n > 0
    told = pd.DataFrame({"x": x[some], "y": pd.array([pd.NA] * int(some.sum()), "Int64"), "n": pd.array(n[some], "Int64")})
    joined = pd.DataFrame(sorted(set(links)), columns=["x", "y"]).astype({"x": "int64", "y": "Int64"})
    return pd.concat([told, joined.assign(n=pd.array([pd.NA] * len(joined), "Int64"))])


def _by_length(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for pdf in batches:
        for dim, part in pdf.groupby(pdf["vec"].map(len), sort=False):
            yield int(dim), part, unit(np.stack(part["vec"].to_numpy()).astype(float))


def links(vectors: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(rid, n_links) of vectors that link, and links (x, y) that connect them. ``vectors``: (rid, vec), usable and written."""
    spark, reach = vectors.sparkSession, math.acos(s.threshold)
    kind = vectors.schema["vec"].dataType.simpleString()
    head = vectors.orderBy(F.xxhash64("rid"), "rid").limit(s.sample).toPandas()
    pivots: dict[int, tuple[np.ndarray, int]] = {}
    total = vectors.count()
    for dim, part, x in _by_length([head] if len(head) else []):
        share = total * len(part) / len(head)
        pivots[dim] = choose(x, max(1, min(s.pivots - s.pivots // 2, math.ceil(share / s.rows))), s)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, part, x in _by_length(batches):
            cell, theta, core = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x), bool)
            if dim in pivots:
                centres, balls = pivots[dim]
                # the nearest by cosine, as the plane between two pivots tells it
                cell = np.argmax(x @ centres.T, 1)
                theta = np.arccos(np.clip((x * centres[cell]).sum(1), -1.0, 1.0))
                core = (cell < balls) & (theta <= reach / 2 - _SLACK)
            yield pd.DataFrame({"rid": part["rid"].to_numpy(), "vec": part["vec"].to_numpy(), "dim": np.int32(dim), "cell": cell.astype(np.int32), "theta": theta, "core": core})

    placed = materialize(vectors.mapInPandas(place, f"rid long, vec {kind}, dim int, cell int, theta double, core boolean"))
    # a row a zone (the core of a cell, or the rest of it): bounded by the number of pivots
    zones = placed.groupBy("dim", "cell", "core").agg(F.count("*").alias("n"), F.min("theta").alias("low"), F.max("theta").alias("high"), F.min("rid").alias("first")).orderBy("dim", "cell", "core").collect()
    parts = [max(1, -(-z["n"] // s.rows)) for z in zones]
    begins = np.cumsum([0, *parts]).tolist()
    number = {(z["dim"], z["cell"], z["core"]): k for k, z in enumerate(zones)}
    apart: dict[int, list[int]] = {}  # by length: the units that are no core, among which either of two may be the one to compare
    for k, z in enumerate(zones):
        if not z["core"]:
            apart.setdefault(z["dim"], []).extend(range(begins[k], begins[k + 1]))
    turn = {u: k for us in apart.values() for k, u in enumerate(us)}

    def meets(u: np.ndarray, v: np.ndarray, zu: int, zv: int) -> np.ndarray:
        """For units ``v`` of a zone: are their vectors sent to unit ``u`` of another zone or to another unit of their own?"""
        a, b = zones[zu], zones[zv]
        if a["core"] or b["core"]:
            return np.full(np.broadcast(u, v).shape, a["core"] and (not b["core"] or zu < zv))
        n = len(apart[a["dim"]])
        ahead = (v - u) % n
        return (ahead > 0) & ((2 * ahead < n) | ((2 * ahead == n) & (u < v)))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (dim, cell, core), part in pdf.groupby(["dim", "cell", "core"], sort=False):
                zv = number[dim, cell, core]
                x = unit(np.stack(part["vec"].to_numpy()).astype(float))
                rid = part["rid"].to_numpy()
                v = begins[zv] + part["slot"].to_numpy() % parts[zv]
                centres = pivots[dim][0] if dim in pivots else None
                cosine = x @ centres.T if centres is not None else None
                for zu, z in enumerate(zones):
                    if z["dim"] != dim or (zu == zv and core):
                        continue
                    could, whole = np.ones(len(x), bool), np.zeros(len(x), bool)
                    if cosine is not None:
                        far = np.arccos(np.clip(cosine[:, z["cell"]], -1.0, 1.0))
                        could = (far <= z["high"] + reach + _SLACK) & (far >= z["low"] - reach - _SLACK)
                        if z["cell"] != cell:
                            normal = centres[cell] - centres[z["cell"]]
                            length = math.sqrt(float(normal @ normal))
                            if length > 1e-9:
                                could &= (x @ normal) / length <= 2 * math.sin(reach / 2) + _SLACK
                        if z["core"]:
                            whole = (far + z["high"] <= reach - _SLACK) & meets(np.array(0), np.zeros(len(x), int), zu, zv)
                            could &= ~whole
                    if whole.any():
                        yield pd.DataFrame({"u": np.int64(zu), "g": np.int64(-1), "rid": rid[whole], "vec": None})
                    if not could.any():
                        continue
                    mine, places = rid[could], v[could]
                    for u in range(begins[zu], begins[zu + 1]):
                        if z["core"] or core:
                            hit = meets(np.array(0), places, zu, zv)
                            g = places // s.group
                        else:
                            own, theirs = turn[u], np.array([turn[p] for p in places.tolist()])
                            hit = meets(np.array(own), theirs, zu, zv)
                            g = ((theirs - own) % len(apart[dim]) - 1) // s.group
                        if hit.any():
                            yield pd.DataFrame({"u": np.int64(u), "g": g[hit].astype(np.int64), "rid": mine[hit], "vec": part["vec"].to_numpy()[could][hit]})

    slotted = placed.withColumn("slot", F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(1 << 30)))
    sent = materialize(slotted.mapInPandas(send, f"u long, g long, rid long, vec {kind}"))
    outer = sent.where(F.col("g") >= 0)
    shape = spark.createDataFrame([(z["dim"], z["cell"], z["core"], k, begins[k], parts[k], z["n"], z["first"]) for k, z in enumerate(zones)], "zdim int, zcell int, zcore boolean, zone long, base long, parts long, members long, first long")
    shape = materialize(shape)
    zoned = slotted.join(shape, (F.col("dim") == F.col("zdim")) & (F.col("cell") == F.col("zcell")) & (F.col("core") == F.col("zcore")))
    units = zoned.select("rid", "vec", "core", (F.col("base") + F.col("slot") % F.col("parts")).alias("u"))
    tasks = outer.select(F.col("u").alias("_u"), F.col("g").alias("_g")).distinct()
    inner = units.join(tasks, F.col("u") == F.col("_u")).select("u", F.col("_g").alias("g"), "rid", "vec").unionByName(units.where(~F.col("core")).select("u", F.lit(-1).cast("long").alias("g"), "rid", "vec"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _block(a, b, s)

    found = materialize(inner.groupBy("u", "g").cogroup(outer.groupBy("u", "g")).applyInPandas(compare, "x long, y long, n long"))
    # what links with a whole core, and the core's members with each other
    certain = materialize(sent.where(F.col("g") < 0).join(shape, F.col("u") == F.col("zone")).select("rid", "zone", "members", "first"))
    guests = certain.groupBy(F.col("zone").alias("_zone")).agg(F.count("*").alias("guests"))
    cores = zoned.where("core").join(guests, F.col("zone") == F.col("_zone"), "left").select("rid", "first", (F.col("members") - 1 + F.coalesce("guests", F.lit(0))).alias("n"))
    counts = found.where(F.col("y").isNull()).select(F.col("x").alias("rid"), "n").unionByName(certain.select("rid", F.col("members").alias("n"))).unionByName(cores.select("rid", "n"))
    pairs = found.where(F.col("y").isNotNull()).select("x", "y").unionByName(certain.select(F.col("rid").alias("x"), F.col("first").alias("y"))).unionByName(cores.where(F.col("rid") != F.col("first")).select(F.col("rid").alias("x"), F.col("first").alias("y")))
    return counts.groupBy("rid").agg(F.sum("n").alias("n_links")).where(F.col("n_links") > 0), pairs


def grouped(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """(``key``, n_links, component_id, kept) of every row."""
    single = isinstance(vectors.schema[vector].dataType, T.ArrayType) and isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    vec = F.col(f"`{vector}`").cast("array<float>" if single else "array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = materialize(vectors.select(F.col(f"`{key}`").alias("id"), vec.alias("vec")).withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("rid", F.monotonically_increasing_id()))
    counts, pairs = links(rows.where("fine").select("rid", "vec"), s)
    comps = components(materialize(pairs))
    named = comps.select(F.col("rid").alias("_rid"), "comp").join(rows.select("rid", "id"), F.col("_rid") == F.col("rid"))
    smallest = materialize(named.groupBy(F.col("comp").alias("_comp")).agg(F.min("id").alias("least")))
    reached = comps.join(smallest, F.col("comp") == F.col("_comp")).select(F.col("rid").alias("_r"), "least", F.lit(True).alias("joined"))
    told = rows.drop("vec").join(counts.withColumnRenamed("rid", "_c"), F.col("rid") == F.col("_c"), "left").join(reached, F.col("rid") == F.col("_r"), "left")
    component = F.when(F.coalesce("joined", F.lit(False)), F.col("least")).otherwise(F.col("id"))
    return told.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component.isNull() | F.coalesce(F.col("id") == component, F.lit(False))).alias("kept"))


def report(embeddings: DataFrame, s: Settings = Settings()) -> DataFrame:
    return grouped(embeddings, s=s)
