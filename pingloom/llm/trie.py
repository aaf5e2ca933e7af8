"""The prefix trie of conversations, its subtrees summed by the Euler-tour technique.

A node is a distinct sequence of first turns. A prefix is known by its depth and 128 bits: the sums, in four parts, of a hash of (place,
turn) over its turns, so prefixes of one conversation are running sums and no task reads a conversation from end to end. Its smallest
member and its depth number a node, in that order, so that the nodes one conversation alone passes are neighbours.

Every node has an arc that enters it and one that leaves it. An entering arc is followed by that of the first child (children in the
order of their smallest members), or else by the leaving arc; a leaving arc by the entering arc of the next sibling, or else by the
parent's leaving arc. This list is ranked by contraction: arcs are cut into blocks by number, the pieces of the tour that stay in a
block become one element each, and so on until one is left; should a round contract little, the rest is ranked by pointer jumping.
Ranking carries the sums of all weights from an arc to the tour's end, so a subtree's sum is that at its entering arc less that at
its leaving arc.

Defined cases: rows without a conversation take no part; a null role or text is empty; turns are ordered by number (null first), equal
numbers by the hash of role and text; repeated rows are turns of their own; a conversation may be turnless once rebuilt, and then ends
at the root; an empty table has no nodes; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingloom.llm.ranks import ranked, same
from pingloom.plans.slices import running_total
from pingloom.plans.stages import materialize


@dataclass(frozen=True)
class Settings:
    slice: int = 4_096  # turns of a conversation summed in one window
    block: int = 4_096  # arcs contracted in one group
    chunk: int = 1_024  # members written into one text


_KEY = ["k0", "k1", "k2", "k3"]


def contract(pdf: pd.DataFrame, weights: Sequence[str]) -> pd.DataFrame:
    """Each element of a block with the first element outside that its chain leads to, and the sums over the chain up to there."""
    ids = pdf["id"].to_numpy()
    order = np.argsort(ids)
    ids, following = ids[order], pdf["next"].to_numpy(dtype=float, na_value=-1)[order].astype(np.int64)
    at = np.searchsorted(ids, following)
    inside = (following >= 0) & (at < len(ids))
    inside[inside] = ids[at[inside]] == following[inside]
    to = np.where(inside, at, len(ids))  # one more element stands for the outside
    head = np.ones(len(ids), bool)
    head[at[inside]] = False
    sums = np.vstack([pdf[list(weights)].to_numpy(np.int64)[order], np.zeros((1, len(weights)), np.int64)])
    last = np.r_[np.arange(len(ids)), len(ids)]
    to = np.r_[to, len(ids)]
    while (to < len(ids)).any():
        sums = sums + sums[to]
        last = np.where(to < len(ids), last[to], last)
        to = to[to]
    out = pd.DataFrame({"id": ids, "next": pd.array(np.where(following[last[:-1]] >= 0, following[last[:-1]], 0), "Int64"), "head": head})
    out.loc[following[last[:-1]] < 0, "next"] = pd.NA
    for k, w in enumerate(weights):
        out[w] = sums[:-1, k]
    return out


def jumped(rows: DataFrame, weights: Sequence[str]) -> DataFrame:
    """Sums from each element to its list's end by pointer jumping: a round for each doubling of the length."""
    done = rows.where(F.col("next").isNull()).select("id", *weights)
    open_ = rows.where(F.col("next").isNotNull())
    while open_.limit(1).count():
        # what the ended ones lack is nothing, so an element that points at one ends too
        every = open_.unionByName(done.withColumn("next", F.lit(None).cast("long")))
        to = every.select(F.col("id").alias("_to"), F.col("next").alias("_onward"), *[F.col(w).alias(f"_{w}") for w in weights])
        step = materialize(open_.join(to, F.col("next") == F.col("_to")).select("id", F.col("_onward").alias("next"), *[(F.col(w) + F.col(f"_{w}")).alias(w) for w in weights]))
        done = done.unionByName(step.where(F.col("next").isNull()).select("id", *weights))
        open_ = step.where(F.col("next").isNotNull())
    return materialize(done)


def list_sums(rows: DataFrame, weights: Sequence[str], block: int) -> DataFrame:
    """(id, sums of ``weights`` from the element to its list's end). ``rows``: (id, next, weights), ids dense from 0, written."""
    schema = "id long, next long, head boolean" + "".join(f", {w} long" for w in weights)
    rounds, numbered = [], []
    while True:
        pieces = materialize(rows.select("id", "next", *weights, F.floor(F.col("id") / F.lit(block)).alias("_block")).groupBy("_block").applyInPandas(lambda pdf: contract(pdf, weights), schema))
        rounds.append(pieces)
        all_, left, onward = pieces.agg(F.count("*"), F.count_if("head"), F.count(F.when(F.col("head"), F.col("next")))).first()
        segments = pieces.where("head").select("id", "next", *weights)
        if not onward:
            sums = segments.select("id", *weights)
            break
        if left > all_ // 2:
            sums = jumped(segments, weights)
            break
        # number the pieces densely, in the order of their first arcs
        names = materialize(ranked(segments.select("id"), ["id"]).select(F.col("id").alias("_old"), F.col("rank").alias("_new")))
        numbered.append(names)
        to = names.select(F.col("_old").alias("_next"), F.col("_new").alias("_to"))
        rows = segments.join(names, F.col("id") == F.col("_old")).join(to, F.col("next") == F.col("_next"), "left").select(F.col("_new").alias("id"), F.col("_to").alias("next"), *weights)
        rows = materialize(rows)
    for k in reversed(range(len(rounds))):
        if k < len(numbered):
            sums = sums.join(numbered[k], F.col("id") == F.col("_new")).select(F.col("_old").alias("id"), *weights)
        rest = sums.select(F.col("id").alias("_to"), *[F.col(w).alias(f"_{w}") for w in weights])
        sums = materialize(rounds[k].join(rest, F.col("next") == F.col("_to"), "left").select("id", *[(F.col(w) + F.coalesce(f"_{w}", F.lit(0))).alias(w) for w in weights]))
    return sums


def member_hashes(ends: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    """(keys, ends_sha256): SHA-256 of the members of each key, ascending, joined by commas.

    Members are joined into texts of ``chunk`` members first; a key of more than one such text is hashed by a task that reads a
    row a chunk, one after the other.
    """
    at = ranked(ends, ["member"], keys)
    texts = at.groupBy(*keys, F.col("total").alias("_all"), F.floor(F.col("rank") / F.lit(s.chunk)).alias("_chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",").alias("text"))
    texts = materialize(texts)
    one = texts.where(F.col("_all") <= s.chunk).select(*keys, F.sha2(F.col("text").cast("binary"), 256).alias("ends_sha256"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        for key, parts in groupby(rows, key=lambda r: r[:-1]):
            sha, comma = hashlib.sha256(), b""
            for p in parts:
                sha.update(comma + p[-1].encode())
                comma = b","
            yield pa.RecordBatch.from_arrays([*(pa.array([k]) for k in key), pa.array([sha.hexdigest()])], names=[*keys, "ends_sha256"])

    many = texts.where(F.col("_all") > s.chunk).repartition(*keys).sortWithinPartitions(*keys, "_chunk").select(*keys, "text")
    kinds = {c: ends.schema[c].dataType.simpleString() for c in keys}
    return one.unionByName(many.mapInArrow(stream, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", ends_sha256 string"))


def trie(members: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``members``: (member, length); ``items``: (member, length, depth from 1, turn: a hash, size), both written.
    """
    mixed = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("turn")).cast("binary"))
    part = {f"_p{k}": F.conv(F.substring(mixed, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)}
    summed = running_total(items.select("*", *[c.alias(n) for n, c in part.items()]), ["member"], F.floor(F.col("depth") / F.lit(s.slice)), ["depth"], {k: F.col(f"_p{k[1]}") for k in _KEY})
    summed = materialize(summed.select("member", "length", "depth", "size", *_KEY, *[(F.col(k) - F.col(f"_p{k[1]}")).alias(f"p{k[1]}") for k in _KEY]))
    up = [f"p{k}" for k in range(4)]
    zero = [F.lit(0).cast("long").alias(k) for k in _KEY]
    nodes = summed.groupBy("depth", *_KEY).agg(F.min("member").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), *[F.min(p).alias(p) for p in up])
    root = members.agg(F.min("member").alias("conv_id"), F.count("*").alias("n_convs")).where(F.col("n_convs") > 0)
    root = root.select(F.lit(0).cast("long").alias("depth"), *zero, "conv_id", "n_convs", F.lit(0).cast("long").alias("size"), *[F.lit(None).cast("long").alias(p) for p in up])
    nodes = materialize(ranked(materialize(nodes.unionByName(root)), ["conv_id", "depth"], rank="nid").drop("total"))

    above = nodes.select((F.col("depth") + 1).alias("_depth"), *[F.col(k).alias(f"_{k}") for k in _KEY], F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where(F.col("depth") > 0).join(above, same(["depth", *up], ["_depth", *(f"_{k}" for k in _KEY)]))
    below = materialize(below.select("nid", "parent", "parent_conv_id", "conv_id"))
    kids = materialize(ranked(below.select("nid", "parent", "conv_id"), ["conv_id"], ["parent"], "place", "n_children"))
    first = kids.where(F.col("place") == 0).select(F.col("parent").alias("_of"), F.col("nid").alias("first"), "n_children")
    follow = kids.select(F.col("parent").alias("_parent"), (F.col("place") - 1).alias("_place"), F.col("nid").alias("sibling"))
    beside = kids.join(follow, same(["parent", "place"], ["_parent", "_place"]), "left").select(F.col("nid").alias("_nid"), "parent", "sibling")
    wired = nodes.join(beside, F.col("nid") == F.col("_nid"), "left").join(first, F.col("nid") == F.col("_of"), "left")
    wired = materialize(wired.select("nid", "depth", *_KEY, "conv_id", "n_convs", "size", "parent", "sibling", "first", F.coalesce("n_children", F.lit(0)).alias("n_children")))

    enter, leave = F.col("nid") * 2, F.col("nid") * 2 + 1
    into = F.struct(enter.alias("id"), F.coalesce(F.col("first") * 2, leave).alias("next"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    out_of = F.struct(leave.alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    tour = materialize(wired.select(F.explode(F.array(into, out_of)).alias("arc")).select("arc.*"))
    sums = list_sums(tour, ["leaves", "saved"], s.block)
    sign = F.when(F.col("id") % 2 == 0, 1).otherwise(-1)
    within = sums.groupBy(F.shiftright("id", 1).alias("_node")).agg(F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved_tokens"))

    ends = summed.where(F.col("depth") == F.col("length")).select("depth", *_KEY, "member")
    turnless = members.where(F.col("length") == 0).select(F.lit(0).cast("long").alias("depth"), *zero, "member")
    told = member_hashes(materialize(ends.unionByName(turnless)), ["depth", *_KEY], s)
    told = told.select(*[F.col(c).alias(f"_{c}") for c in ("depth", *_KEY)], "ends_sha256")
    parents = below.select(F.col("nid").alias("_child"), "parent_conv_id")
    joined = wired.join(within, F.col("nid") == F.col("_node")).join(parents, F.col("nid") == F.col("_child"), "left").join(told, same(["depth", *_KEY], [f"_{c}" for c in ("depth", *_KEY)]), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, size, place from 0, turns): each turn as a hash of its role and text, with its code points and place."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashed = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("number"), hashed.alias("turn"), F.char_length(text).cast("long").alias("size"))
    placed = ranked(materialize(rows.withColumn("row", F.monotonically_increasing_id())), ["number", "turn", "row"], ["conv"], "place", "turns")
    return materialize(placed.select("conv", "turn", "size", "place", "turns"))


def rebuilt(turns: DataFrame, donor: Column, borrowed: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Members and items of conversations that begin with the first ``borrowed`` turns of ``donor`` and go on with their own after as many.

    ``borrowed`` (at most ``most``) and ``donor`` are expressions over ``conv``; a donor's turns go to those who name it only.
    """
    convs = materialize(turns.groupBy("conv").agg(F.max("turns").alias("turns")).select("conv", "turns", donor.alias("donor"), borrowed.cast("long").alias("skip")))
    sizes = convs.select(F.col("conv").alias("_donor"), F.col("turns").alias("_turns"))
    taken = F.least("skip", F.coalesce("_turns", F.lit(0)))
    sized = convs.join(sizes, F.col("donor") == F.col("_donor"), "left").select(F.col("conv").alias("member"), "donor", "skip", taken.alias("taken"), (taken + F.greatest(F.col("turns") - F.col("skip"), F.lit(0))).alias("length"))
    sized = materialize(sized)
    own = turns.join(sized, F.col("conv") == F.col("member")).where(F.col("place") >= F.col("skip")).withColumn("depth", F.col("place") - F.col("skip") + F.col("taken") + 1)
    given = turns.where(F.col("place") < most).join(sized, F.col("conv") == F.col("donor")).where(F.col("place") < F.col("taken")).withColumn("depth", F.col("place") + 1)
    fields = ["member", "length", "depth", "turn", "size"]
    return sized.select("member", "length"), materialize(own.select(*fields).unionByName(given.select(*fields)))


def report(conversations: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The trie of conversations that begin with up to five turns of the first of their hundred."""
    conv = F.col("conv")
    borrowed = F.crc32(conv.cast("string").cast("binary")) % 6
    return trie(*rebuilt(turns_of(conversations), conv - conv % 100, borrowed, 5), s)
