"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors pseudo-randomly, by three rounds of sign flips and a fast Hadamard transform, and files each under the
signed axis nearest to it. A query looks into the ``probes`` nearest axes of each table; what lies there is ranked exactly. Rows of a
bucket and queries that probe it meet in blocks of bounded size, however many share the bucket, and a block returns only the nearest
few of each query.

Defined cases: vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without an id; vectors
meet only vectors of their own length; rows that share an id are one candidate, with the best score among them, and never their own
neighbour; a query that finds fewer than ``k`` is searched against all rows, in blocks; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingloom.plans.stages import materialize


@dataclass(frozen=True)
class Settings:
    tables: int = 8
    probes: int = 12
    k: int = 5
    index_block: int = 8_192
    query_block: int = 1_024
    seed: int = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length a power of two)."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([seed, table, d]).choice([-1.0, 1.0], (3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(x: np.ndarray, table: int, seed: int, count: int) -> np.ndarray:
    """The ``count`` signed axes nearest to each row, nearest first: 2 * axis, plus 1 on its negative side."""
    y = rotate(x, table, seed)
    both = np.stack([y, -y], 2).reshape(len(y), -1)
    return np.argsort(-both, 1, kind="stable")[:, :count]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    # equal rows are one: copies would fill a block without adding a candidate
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine).distinct()


def filed(rows: DataFrame, s: Settings, probes: int) -> DataFrame:
    """A row for each table and each of the ``probes`` nearest axes: id, vec, dim, tab, axis."""

    def run(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["vec"].map(len), sort=False):
                x = unit(np.stack(part["vec"].to_numpy()))
                for t in range(s.tables):
                    a = axes(x, t, s.seed, probes)
                    n = a.shape[1]
                    yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), n), "vec": part["vec"].repeat(n).to_numpy(), "dim": np.int32(dim), "tab": np.int32(t), "axis": a.ravel().astype(np.int32)})

    return rows.mapInPandas(run, "id long, vec array<double>, dim int, tab int, axis int")


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of paired rows, each pair computed by itself so that equal pairs have equal scores."""
    q, v = (np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) for x in (q, v))
    return (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))


def nearest(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` ids nearest to each query of a block, ties to the smaller id."""
    out = []
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    vn, qn = unit(v), unit(q)
    for a in range(0, len(q), 64):
        rough = qn[a:a + 64] @ vn.T
        rough[qids[a:a + 64, None] == ids[None, :]] = -np.inf
        if len(first) > k:
            # the cut is at the k-th best id, not the k-th best row
            best = rough if len(first) == len(ids) else np.maximum.reduceat(rough, first, axis=1)
            edge = -np.partition(-best, k - 1, 1)[:, k - 1:k]
            row, col = np.nonzero((rough >= edge - 1e-9) & np.isfinite(rough))
        else:
            row, col = np.nonzero(np.isfinite(rough))
        score = exact(q[a + row], v[col])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        # of rows that share an id only the best counts
        pair = pd.DataFrame({"query_id": qids[a + row], "vec_id": ids[col], "score": score, "_q": a + row}).drop_duplicates(["_q", "vec_id"])
        out.append(pair[pair.groupby("_q").cumcount() < k])
    return pd.concat(out)[["query_id", "vec_id", "score"]]


_FOUND = "query_id long, vec_id long, score double"


def meet(index: DataFrame, queries: DataFrame, s: Settings) -> DataFrame:
    """The nearest rows of each (query, block) of equal dim, tab and axis."""
    place = ["dim", "tab", "axis"]
    sizes = materialize(index.groupBy(*place).agg(F.count("*").alias("ni")).join(queries.groupBy(*place).agg(F.count("*").alias("nq")), place)
                        .select(*place, F.ceil(F.col("ni") / s.index_block).cast("int").alias("pi"), F.ceil(F.col("nq") / s.query_block).cast("int").alias("pq")))

    def part(own: str, other: str, mine: str, its: str) -> tuple[Column, Column]:
        return F.pmod(F.xxhash64("id", "vec"), F.col(own)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(its)

    left = index.join(sizes, place).select("id", "vec", *place, *part("pi", "pq", "bi", "bq"))
    right = queries.join(sizes, place).select("id", "vec", *place, *part("pq", "pi", "bq", "bi"))
    key = [*place, "bi", "bq"]

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return nearest(a["id"].to_numpy(), np.stack(a["vec"].to_numpy()), b["id"].to_numpy(), np.stack(b["vec"].to_numpy()), s.k)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(block, _FOUND)


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row of ``queries``."""
    rows, asked = usable(vectors, key, vector), usable(queries, key, vector)
    found = materialize(meet(filed(rows, s, 1), filed(asked, s, s.probes), s).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= s.k)
    short = asked.join(enough, F.col("id") == F.col("query_id"), "left_anti")
    if short.limit(1).count():
        # exactly, against every row: one table with a single bucket, met in the same blocks
        flat = lambda d: d.select("id", "vec", F.size("vec").alias("dim"), F.lit(0).alias("tab"), F.lit(0).alias("axis"))
        found = found.unionByName(meet(flat(rows), flat(short), s)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, embeddings.where(F.col("vec_id") % 50 == 0))
