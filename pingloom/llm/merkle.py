"""A manifest of a dataset: hash trees over its rows, one a source, and proofs of every row.

A node is labelled by its level and by the interval [lo, hi) of leaf ranks it covers. All relations follow from the labels: a node's
ancestors are the nodes of higher levels whose intervals contain its own, and its siblings cover what remains of its parent's interval
without its own. Levels are handled in bands, and within a band intervals are bucketed by the cell (an interval of the band's top
level) that contains them: a node can only be contained in one of its own cell. So trees are built bottom-up, a band at a time, by
folding cells, and paths to the root are attached top-down, a band at a time, by a containment join of each cell's nodes with each
other, starting from the path of the cell's top. A cell has at most ``run ** band`` nodes on its lowest level, whatever a source holds.

Defined cases: a null column is hashed as ``-``, not as an empty text; rows are ranked by key, null keys first, equal keys by leaf hash
(so equal rows are interchangeable); a null source is a source, and first; a source of one row is its own root; an empty table has no
root and no rows; columns other than those hashed, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingloom.llm.ranks import ranked
from pingloom.plans.stages import materialize

HASHED = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Settings:
    run: int = 3  # children of a node
    band: int = 6  # levels of a cell


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(columns: list[Column]) -> Column:
    """Hash of a row: each value with its length in bytes, so that no two rows are written alike."""
    parts = []
    for c in columns:
        c = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows of equal (grp, cell), the first two columns, that follow each other."""
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
    return groupby(rows, key=lambda r: r[:2])


def _by_cell(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.repartition("grp", "cell").sortWithinPartitions("grp", "cell", *order)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_NODE = pa.schema([("grp", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("hash", pa.string())])


def build(leaves: DataFrame, s: Settings = Settings()) -> list[DataFrame]:
    """The inner nodes, a table a band: (grp, total, level, lo, hi, hash). ``leaves``: (grp, total, lo, hash), written."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    children = leaves.where(F.col("total") > 1).select("grp", "total", "lo", (F.col("lo") + 1).alias("hi"), "hash")
    bands, base = [], 0
    while s.run ** base < most:
        width = s.run ** (base + s.band)

        def fold(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            for (grp, _), rows in _cells(batches):
                rows = list(rows)
                total, nodes, level, out = rows[0][2], [r[3:] for r in rows], base, []
                while level < base + s.band and s.run ** level < total:
                    runs = [nodes[k:k + s.run] for k in range(0, len(nodes), s.run)]
                    nodes, level = [(r[0][0], r[-1][1], digest(*(n[2] for n in r))) for r in runs], level + 1
                    out += [(grp, total, level, *n) for n in nodes]
                yield _batch(out, _NODE)

        cells = children.select("grp", F.floor(F.col("lo") / F.lit(width)).alias("cell"), "total", "lo", "hi", "hash")
        bands.append(materialize(_by_cell(cells, F.col("lo")).mapInArrow(fold, "grp string, total long, level int, lo long, hi long, hash string")))
        base += s.band
        children = bands[-1].where((F.col("level") == base) & (F.col("total") > width))
    return bands


def tops(leaves: DataFrame, bands: list[DataFrame]) -> DataFrame:
    """(grp, hash): the root of each group."""
    out = leaves.where(F.col("total") == 1).select("grp", "hash")
    for b in bands:
        out = out.unionByName(b.where(F.col("hi") - F.col("lo") == F.col("total")).select("grp", "hash"))
    return out


Path = list[tuple[str, str]]  # a level each: the hashes of the siblings to the left and to the right, joined


def contained(levels: dict[int, list[tuple[int, int, str]]], base: int, upper: Path) -> Iterator[tuple[tuple[int, int, str], Path]]:
    """The nodes of a cell's lowest level with their paths, by containment of intervals; ``upper`` is the path of the cell's top."""
    paths = {}
    above: list[tuple[int, int, str]] = []
    for level in sorted(levels, reverse=True):
        nodes = levels[level]
        starts, ends = [n[0] for n in nodes], [n[1] for n in nodes]
        tips, here = [n[0] for n in above], {}
        for k, (lo, hi, _) in enumerate(nodes):
            if not above:
                here[lo] = upper
                continue
            # the parent is the node above whose interval contains this one; its interval without this one is the siblings'
            top = above[bisect_right(tips, lo) - 1]
            if not top[0] <= lo < hi <= top[1]:
                raise ValueError(f"no node of level {level + 1} contains [{lo}, {hi})")
            left = "".join(n[2] for n in nodes[bisect_left(starts, top[0]):k])
            right = "".join(n[2] for n in nodes[k + 1:bisect_right(ends, top[1])])
            here[lo] = [(left, right), *paths[top[0]]]
        paths, above = here, nodes
    for n in levels.get(base, []):
        yield n, paths[n[0]]


_SIDES = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def attach(leaves: DataFrame, bands: list[DataFrame], carriers: DataFrame, keep: Sequence[str], finish: Callable[[tuple, Path, str], tuple], fields: str, s: Settings = Settings()) -> DataFrame:
    """For each leaf what ``finish`` makes of (its ``keep`` columns and hash, its path to the root, its group's subroot).

    ``leaves``: (grp, total, lo, hash, *keep); ``carriers``: (grp, total, path, subroot), a row a group: the path from its subroot on.
    """
    none = [F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in keep]
    lower = None
    for k in reversed(range(max(len(bands), 1))):
        base, width = k * s.band, s.run ** ((k + 1) * s.band)
        cell = F.floor(F.col("lo") / F.lit(width)).alias("cell")
        # groups whose root lies in this band begin here
        begin = (F.col("total") <= width) & ((F.col("total") > s.run ** base) if k else F.lit(True))
        start = carriers.where(begin).select("grp", F.lit(0).cast("long").alias("cell"), "path", "subroot")
        start = start if lower is None else start.unionByName(lower.select("grp", cell, "path", "subroot"))
        no_path = [F.lit(None).cast(_SIDES).alias("path"), F.lit(None).cast("string").alias("subroot")]
        label = ["grp", cell, "level", "lo", "hi", "hash"]
        if k:
            children = bands[k - 1].where((F.col("level") == base) & (F.col("total") > s.run ** base)).select(*label, *no_path)
        else:
            children = leaves.withColumn("level", F.lit(0)).withColumn("hi", F.col("lo") + 1).select(*label, *no_path, *keep)
        parts = [children, start.select("grp", "cell", F.lit(None).cast("int").alias("level"), *[F.lit(None).cast("long").alias(c) for c in ("lo", "hi")], F.lit(None).cast("string").alias("hash"), "path", "subroot", *([] if k else none))]
        if bands:
            parts.append(bands[k].select(*label, *no_path, *([] if k else none)))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        out_schema = T.StructType.fromDDL("grp string, lo long, subroot string").add("path", _SIDES) if k else T.StructType.fromDDL(fields)

        def walk(batches: Iterator[pa.RecordBatch], base: int = base, last: bool = not k, schema: T.StructType = out_schema) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            for (grp, _), cell_rows in _cells(batches):
                (_, _, _, _, _, _, upper, subroot, *_), *nodes = cell_rows
                upper = [(p["left"], p["right"]) for p in upper]
                levels: dict[int, list] = {}
                for r in nodes:
                    levels.setdefault(r[2], []).append(r[3:6])
                found = contained(levels, base, upper)
                if last:
                    # leaves come in the order of their ranks, as do their rows
                    own = (r for r in nodes if r[2] == 0)
                    yield _batch([finish((*r[8:], n[2]), path, subroot) for r, (n, path) in zip(own, found, strict=True)], arrow)
                else:
                    yield _batch([(grp, n[0], subroot, [{"left": a, "right": b} for a, b in path]) for n, path in found], arrow)

        # a cell's carrier comes first, as its level is null
        lower = _by_cell(rows, F.col("level").asc_nulls_first(), F.col("lo")).mapInArrow(walk, out_schema)
        if k:
            lower = materialize(lower)
    return lower


def trees(leaves: DataFrame, s: Settings = Settings()) -> tuple[list[DataFrame], DataFrame, list[DataFrame], str | None]:
    """Inner nodes of all groups, the groups' subroots (grp, total, lo, hash) in order, the inner nodes above them, and the root."""
    bands = build(leaves, s)
    sizes = leaves.groupBy(F.col("grp").alias("g")).agg(F.max("total").alias("size"))
    subroots = tops(leaves, bands).join(sizes, F.col("grp").eqNullSafe(F.col("g"))).select("grp", "hash", "size")
    # a second tree: its one group is all sources, its leaves are their subroots
    upper = materialize(ranked(materialize(subroots), ["grp"], rank="lo").select(F.lit("").alias("grp"), F.col("grp").alias("source"), "size", "total", "lo", "hash"))
    above = build(upper, s)
    root = tops(upper, above).first()
    return bands, upper, above, root and root["hash"]


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", hashed: Sequence[str] = HASHED, s: Settings = Settings()) -> DataFrame:
    """All nodes: (tree, level, lo, hi, hash); ``tree`` is the group's struct, null for the tree above the groups."""
    leaves = ranked_leaves(docs, key, group, hashed)
    bands, upper, above, _ = trees(leaves, s)
    label = lambda tree: [tree.alias("tree"), "level", "lo", "hi", "hash"]
    zero = lambda df: df.withColumn("level", F.lit(0)).withColumn("hi", F.col("lo") + 1)
    own, none = F.struct(F.col("grp").alias("source")), F.lit(None).cast("struct<source string>")
    parts = [zero(leaves).select(*label(own)), *(b.select(*label(own)) for b in bands), zero(upper).select(*label(none)), *(b.select(*label(none)) for b in above)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked_leaves(docs: DataFrame, key: str, group: str, hashed: Sequence[str], claimed: Column | None = None) -> DataFrame:
    """(grp, key, hash, claimed, total, lo): a leaf a row, ranked within its group; ``claimed`` is a hash to be verified in its place."""
    col = lambda c: F.col(f"`{c}`")
    own = leaf_hash([col(c) for c in hashed])
    rows = materialize(docs.select(col(group).cast("string").alias("grp"), col(key).alias("key"), own.alias("hash"), (own if claimed is None else claimed).alias("claimed")).withColumn("row", F.monotonically_increasing_id()))
    return materialize(ranked(rows, ["key", "hash", "row"], ["grp"], "lo").drop("row"))


def verify(docs: DataFrame, claimed: Column, key: str = "doc_id", group: str = "source", hashed: Sequence[str] = HASHED, s: Settings = Settings()) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): each row's proof, applied to its ``claimed`` leaf hash."""
    leaves = ranked_leaves(docs, key, group, hashed, claimed)
    bands, upper, above, root = trees(leaves, s)
    tip = upper.groupBy("grp").agg(F.max("total").alias("total")).select("grp", "total", F.array().cast(_SIDES).alias("path"), F.lit("").alias("subroot"))

    def carry(row: tuple, path: Path, _: str) -> tuple:
        source, size, subroot = row
        return source, size, [{"left": a, "right": b} for a, b in path], subroot

    carriers = materialize(attach(upper, above, tip, ["source", "size"], carry, "grp string, total long, path array<struct<left:string,right:string>>, subroot string", s))

    def prove(row: tuple, path: Path, subroot: str) -> tuple:
        own, claim, leaf = row
        proof, node = hashlib.sha256(), claim
        for left, right in path:
            proof.update((left + right).encode())
            node = digest(left, node, right)
        return own, leaf, subroot, proof.hexdigest(), node

    kind = leaves.schema["key"].dataType.simpleString()
    out = attach(leaves, bands, carriers, ["key", "claimed"], prove, f"key {kind}, leaf string, subroot string, proof_sha256 string, folded_root string", s)
    told = F.lit(root).cast("string")
    return out.select(F.col("key").alias(key), "leaf", "subroot", told.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == told).alias("verified"))


def report(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Proofs of all documents; those of every other checksum are verified against a text that lost its line ends."""
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = leaf_hash([cut if c == "text" else F.col(c) for c in HASHED])
    return verify(docs, claimed, s=s)
