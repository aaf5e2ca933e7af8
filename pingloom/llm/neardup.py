"""Near duplicates by BagMinHash signatures, banding and exact verification.

A document is the multiset of its shingles of five words (lower case, split at white space). Signatures estimate the weighted Jaccard
similarity of multisets: every unit of a shingle's weight carries its own Poisson process of points in time, each point falling on one
register, and a register keeps its first point. The units are grouped in dyadic ranges (1, 2, 3-4, 5-8, ...), each one process of
joint rate whose points also draw a unit; points on units beyond the weight don't count. Only points up to the time by which all
registers should have one are generated, and more only for documents with a register left.

Documents of equal words are one class; classes that share a band meet in a bucket. A bucket isn't paired out: its members are verified
against one leader, which joins groups of copies at once. Members of a leader's buckets that aren't linked to it are then compared with
the other members, in blocks that return no more links than it takes to connect what they find. Whoever shares a bucket shares its leader, so no link between classes
that share a band is lost.

Defined cases: a null text is read as empty; texts of one to four words are one shingle; texts without a word are copies of each
other; rows repeat as they came; null ids come last when the kept document is chosen; an empty table gives an empty result; other
columns, whatever their names, are ignored by ``report`` and kept by ``distinct``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingloom.llm.common import fresh, map_texts, mix64, texts_of, word_hashes, words_of
from pingloom.plans.stages import materialize


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    bands: int = 30
    rows: int = 5
    outer: int = 256  # rows of a block that aren't linked to their leader
    inner: int = 512  # rows they are compared with


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash and weight of each distinct shingle, a hash of each document's sequence of words)."""
    doc, word, distinct = words_of(pc.utf8_lower(texts))
    h = word_hashes(distinct)[word] if len(word) else np.zeros(0, np.uint64)
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        at = np.arange(len(h)) - first[doc]
        sequence = np.zeros(n, np.uint64)
        np.add.at(sequence, doc, mix64(h ^ mix64(at.astype(np.uint64) * _GOLD)))
        sequence = mix64(sequence + count.astype(np.uint64))
        left = count[doc] - at  # words from here to the document's end
        short = count[doc] < size
        begins = np.flatnonzero((left >= size) | (short & (at == 0)))
        joined = np.zeros(len(begins), np.uint64)
        for k in range(size):
            here = np.minimum(begins + k, max(len(h) - 1, 0))
            joined = np.where(left[begins] > k, mix64(joined * _GOLD + h[here] + np.uint64(1)), joined)
    d = doc[begins]
    order = np.lexsort((joined, d))
    d, joined = d[order], joined[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (joined[1:] != joined[:-1])]) if len(d) else np.zeros(0, np.int64)
    return d[new], joined[new], np.diff(np.r_[new, len(d)]), sequence


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """The (docs, m) registers; a document without shingles has zeros."""
    total = np.bincount(doc, weight, docs)
    out = np.zeros((docs, m), np.uint64)
    # one process for each shingle and dyadic range of units: [0,1), [1,2), [2,4), [4,8), ...
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    own = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(own)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    d, limit = doc[own], weight[own].astype(float)
    with np.errstate(over="ignore"):
        seed = mix64(shingle[own] + mix64((level + 1).astype(np.uint64) * _GOLD))
    until = (np.log(m) + 4) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[d])
        time, step = np.zeros(len(live)), 0
        first = np.full(docs * m, np.inf)
        cells, times, names = [], [], []
        while len(live):
            with np.errstate(over="ignore"):
                r = mix64(seed[live] + np.uint64(2 * step + 1) * _GOLD)
                e = mix64(r + _GOLD)
            # 1 - u is never 0
            time = time - np.log1p(-(r >> np.uint64(11)).astype(float) / 9007199254740992.0) / (m * width[live])
            on = time <= until[d[live]]
            live, time, r, e = live[on], time[on], r[on], e[on]
            unit = low[live] + np.floor((e >> np.uint64(32)).astype(float) / 4294967296.0 * width[live])
            hit = unit < limit[live]
            cell = d[live[hit]] * m + ((e[hit] & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(first, cell, time[hit])
            cells.append(cell)
            times.append(time[hit])
            names.append(r[hit])
            step += 1
        cell, time, name = np.concatenate(cells), np.concatenate(times), np.concatenate(names)
        won = time == first[cell]
        flat = np.zeros(docs * m, np.uint64)
        flat[cell[won]] = name[won]
        done = todo & np.isfinite(first.reshape(docs, m)).all(1)
        out[done] = flat.reshape(docs, m)[done]
        todo &= ~done
        until = until * 2
    return out


def band_hashes(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    r = registers[:, :bands * rows].reshape(len(registers), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, r.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(rows):
            h = mix64(h * _GOLD + r[:, :, k])
    return h


def signed(docs: DataFrame, text: str, keep: list[str], s: Settings) -> tuple[DataFrame, list[str]]:
    """``keep`` and, under fresh names, the class of equal words (two longs) and the band hashes (none without words)."""
    names = fresh(docs.columns, "class_a", "class_b", "bands")

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        texts = texts_of(part.column(text))
        d, h, w, sequence = shingles(texts, s.words)
        n = len(texts)
        bands = band_hashes(signatures(d, h, w, n, s.bands * s.rows), s.bands, s.rows).view(np.int64)
        some = np.bincount(d, minlength=n) > 0
        with np.errstate(over="ignore"):
            second = np.zeros(n, np.uint64)
            np.add.at(second, d, mix64(h ^ _GOLD) * w.astype(np.uint64))
        offsets = np.r_[0, np.cumsum(np.where(some, s.bands, 0))].astype(np.int32)
        return [pa.array(sequence.view(np.int64)), pa.array(second.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[some].ravel()))]

    fields = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.ArrayType(T.LongType()))]
    return map_texts(docs.select(*dict.fromkeys([*keep, text])), text, fields, work, list(dict.fromkeys([*keep, text]))), names


def overlap(a: str, b: str, size: int) -> float:
    """Multiset Jaccard similarity of two texts' shingles."""
    d, h, w, _ = shingles(pa.array([a, b], pa.large_string()), size)
    both = np.concatenate([h[d == 0], h[d == 1]])
    order = np.argsort(both, kind="stable")
    both, w = both[order], w[order]
    same = np.flatnonzero(both[1:] == both[:-1])
    shared = np.minimum(w[same], w[same + 1]).sum()
    total = w.sum() - shared
    return float(shared / total) if total else 1.0


def verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(x, y, sim) of pairs of row numbers: two joins fetch the texts; adaptive execution splits hot leaders."""
    left = pairs.join(texts.select(F.col("rid").alias("x"), F.col("text").alias("tx")), "x")
    both = left.join(texts.select(F.col("rid").alias("y"), F.col("text").alias("ty")), "y").select("x", "y", "tx", "ty")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"x": pdf["x"], "y": pdf["y"], "sim": [overlap(a, b, s.words) for a, b in zip(pdf["tx"], pdf["ty"], strict=True)]})

    return materialize(both.mapInPandas(run, "x long, y long, sim double"))


def components(links: DataFrame) -> DataFrame:
    """(rid, comp) of all nodes of links (x, y): the smallest node of each connected component, by alternating stars."""
    edges = materialize(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    while True:
        # done when every node has one parent and no parent has one
        parents = edges.select(F.col("u").alias("p")).distinct()
        open_ = edges.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("u").union(edges.join(parents, F.col("v") == F.col("p"), "left_semi").select("u"))
        if not open_.limit(1).count():
            return materialize(edges.select(F.col("u").alias("rid"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("rid"), F.col("v").alias("comp")).distinct()))
        # large star: the larger neighbours of a node go to its smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
        large = materialize(both.join(least, F.col("u") == F.col("w")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        joined = large.join(least, F.col("u") == F.col("w"))
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
        edges = materialize(joined.select(ends.alias("e")).select("e.*").where(F.col("u") != F.col("v")).distinct())


_SIDE = ["leader", "i", "j", "rid", "star", "bands", "text"]


def block_links(outer: pd.DataFrame, inner: pd.DataFrame, s: Settings) -> list[tuple[int, int]]:
    """Linked pairs (rid of an outer row, rid of an inner row) of different stars that share a band.

    All that may be linked are compared; of the links found, those that connect what stars and earlier links don't are returned.
    """
    d, h, w, _ = shingles(pa.array([*outer["text"], *inner["text"]], pa.large_string()), s.words)
    names, ids = np.unique(h, return_inverse=True)
    n = len(outer)
    total = np.bincount(d, w, n + len(inner))
    edges = np.searchsorted(d, np.arange(n + 1))
    row, ids_in, w_in = d[edges[n]:] - n, ids[edges[n]:], w[edges[n]:]
    bands_out, bands_in = np.stack(outer["bands"].to_numpy()), np.stack(inner["bands"].to_numpy())
    star_in, rid_in = inner["star"].to_numpy(), inner["rid"].to_numpy()
    found, weight, above = [], np.zeros(len(names), np.int64), {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    for k, (rid, star) in enumerate(zip(outer["rid"].tolist(), outer["star"].tolist(), strict=True)):
        meets = (star_in != star) & (bands_in == bands_out[k]).any(1)
        if not meets.any():
            continue
        own = slice(edges[k], edges[k + 1])
        weight[ids[own]] = w[own]
        shared = np.bincount(row, np.minimum(weight[ids_in], w_in), len(inner))
        weight[ids[own]] = 0
        linked_ = meets & (shared / (total[k] + total[n:] - shared) >= s.threshold)
        for y, other in zip(rid_in[linked_].tolist(), star_in[linked_].tolist(), strict=True):
            a, b = top(star), top(other)
            if a != b:
                above[a] = b
                found.append((rid, y))
    return found


def across(members: DataFrame, s: Settings) -> DataFrame:
    """Links (x, y) among the members of a leader; ``members``: (leader, rid, close, star, bands, text), ``close``: linked to the leader.

    Members close to the leader need no comparing with each other. The others, in blocks of ``outer``, meet all members, in blocks
    of ``inner``; a block returns links that connect all it finds linked.
    """
    live = members.groupBy(F.col("leader").alias("l")).agg(F.count("*").alias("n"), F.count_if(~F.col("close")).alias("away")).where(F.col("away") > 0)
    live = materialize(live.select("l", F.ceil(F.col("n") / s.inner).cast("int").alias("nj"), F.ceil(F.col("away") / s.outer).cast("int").alias("ni")))
    blocks = live.agg(F.sum(F.col("ni").cast("long") * F.col("nj"))).first()[0] or 0
    parts = max(1, -(-blocks // 6))  # a group holds some six blocks, so its texts stay few megabytes where blocks are full
    rows = members.join(live, F.col("leader") == F.col("l"))
    slot = lambda n: F.pmod(F.xxhash64("rid", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = F.pmod(F.xxhash64("leader", "i", "j"), F.lit(parts)).alias("part")
    outer = rows.where(~F.col("close")).withColumn("i", slot("ni")).withColumn("j", every("nj")).select(part, *_SIDE)
    inner = rows.withColumn("j", slot("nj")).withColumn("i", every("ni")).select(part, *[F.col(c).alias(c) for c in _SIDE])

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        sides = {key: g for key, g in b.groupby(["leader", "i", "j"], sort=False)}
        found = [p for key, g in a.groupby(["leader", "i", "j"], sort=False) if key in sides for p in block_links(g, sides[key], s)]
        return pd.DataFrame(found, columns=["x", "y"]).astype("int64")

    return outer.groupBy("part").cogroup(inner.groupBy("part")).applyInPandas(compare, "x long, y long")


def linked(reps: DataFrame, texts_of_rows: DataFrame, s: Settings) -> DataFrame:
    """(rid, comp) of the classes that have a link; ``reps``: (rid, bands), ``texts_of_rows``: (rid, text)."""
    filed = reps.select("rid", F.explode("bands").alias("bucket"))
    leaders = filed.groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("rid").alias("h"), F.col("rid").alias("r"))).alias("l")).where(F.col("n") > 1)
    leaders = materialize(leaders.select("b", F.col("l.r").alias("leader")))
    pairs = materialize(filed.join(leaders, F.col("bucket") == F.col("b")).where(F.col("rid") != F.col("leader")).select("rid", "leader").distinct())
    members = pairs.select("rid").union(pairs.select("leader")).distinct().select(F.col("rid").alias("m"))
    banded = reps.select(F.col("rid").alias("r"), "bands").join(members, F.col("r") == F.col("m")).drop("m")
    texts = materialize(texts_of_rows.join(banded, F.col("rid") == F.col("r")).drop("r"))
    sims = verified(pairs.select(F.col("rid").alias("x"), F.col("leader").alias("y")), texts, s)
    links = sims.where(F.col("sim") >= s.threshold).select("x", "y")
    # a star: the leader of smallest hash that a class is linked to; two classes of one star are linked through it
    stars = links.groupBy(F.col("x").alias("sx")).agg(F.min(F.struct(F.xxhash64("y").alias("h"), F.col("y").alias("star"))).alias("s")).select("sx", "s.star")
    met = sims.select(F.col("y").alias("leader"), F.col("x").alias("rid"), (F.col("sim") >= s.threshold).alias("close"))
    met = met.union(met.select("leader", F.col("leader").alias("rid"), F.lit(True).alias("close")).distinct())
    # leaders all of whose members are close to them are done: most of them
    open_ = met.groupBy(F.col("leader").alias("o")).agg(F.bool_and("close").alias("done")).where(~F.col("done")).select("o")
    met = met.join(open_, F.col("leader") == F.col("o"), "left_semi")
    named = met.join(stars, F.col("rid") == F.col("sx"), "left").join(texts.withColumnRenamed("rid", "t"), F.col("rid") == F.col("t"))
    more = across(materialize(named.select("leader", "rid", "close", F.coalesce("star", "rid").alias("star"), "bands", "text")), s)
    return components(links.union(more))


def grouped(docs: DataFrame, text: str, doc_id: str, keep: list[str], s: Settings = Settings()) -> tuple[DataFrame, list[str]]:
    """(``keep``, text and, under the names of the second result, the group's smallest document id and whether this row is kept)."""
    rows, (class_a, class_b, bands) = signed(docs, text, list(dict.fromkeys([*keep, doc_id])), s)
    rid, group, kept = fresh(rows.columns, "rid", "group_id", "kept")
    rows = materialize(rows.withColumn(rid, F.monotonically_increasing_id()))
    light = rows.select(F.col(rid).alias("rid"), F.col(f"`{doc_id}`").alias("id"), F.col(class_a).alias("ca"), F.col(class_b).alias("cb"), F.col(bands).alias("bands"))
    # the first document of each class of equal words stands for it
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    reps = materialize(light.groupBy("ca", "cb").agg(F.min(order).alias("o"), F.first("bands").alias("bands")).select("ca", "cb", F.col("o.none").alias("none"), F.col("o.id").alias("id"), F.col("o.rid").alias("rid"), "bands"))
    comps = linked(reps.select("rid", "bands"), rows.select(F.col(rid).alias("rid"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), s)
    named = reps.join(comps.withColumnRenamed("rid", "c"), F.col("rid") == F.col("c"), "left").select("ca", "cb", "none", "id", "rid", F.coalesce("comp", "rid").alias("comp"))
    first = materialize(named.groupBy(F.col("comp").alias("fc")).agg(F.min(F.struct("none", "id", "rid")).alias("o")).select("fc", F.col("o.id").alias("first_id"), F.col("o.rid").alias("first_rid")))
    told = fresh(rows.columns, "ca", "cb", "first_id", "first_rid")
    answer = materialize(named.join(first, F.col("comp") == F.col("fc")).select("ca", "cb", "first_id", "first_rid").toDF(*told))
    ca, cb, first_id, first_rid = map(F.col, told)
    out = rows.join(answer, (F.col(class_a) == ca) & (F.col(class_b) == cb))
    return out.select(*[F.col(f"`{c}`") for c in keep], first_id.alias(group), (F.col(rid) == first_rid).alias(kept)), [group, kept]


def report(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, the smallest doc_id of its group (its own if it is alone) and whether it is the group's kept document."""
    return grouped(docs.select("doc_id", "text"), "text", "doc_id", ["doc_id"], s)[0]


def distinct(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One document of each group, unchanged: that of the smallest doc_id."""
    out, (_, kept) = grouped(docs, "text", "doc_id", docs.columns, s)
    return out.where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
