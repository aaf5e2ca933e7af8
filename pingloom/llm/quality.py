"""Quality classifier on supervised subword embeddings.

Every word (split at white space, with its case and marks) has a hashed vector, as has each of its character n-grams; a document is
the average of all of them, and a softmax over that average gives the class. Word and n-gram vectors and the output layer are learned
together by numpy stochastic gradient descent, on a bounded sample of labelled rows. A word that repeats its predecessor adds one
shared "repeat" feature. Since average and output layer are linear, scoring needs one number a distinct word, found per run of rows.

Defined cases: a null text is read as empty; an empty text scores what the output layer's bias alone says; rows repeat as they came;
labels other than 0 and 1, null labels and labels without a document are not learned from; with no usable label every score is 0.5;
an empty table gives an empty result; other columns, whatever their names, are ignored by ``scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingloom.llm.common import fresh, map_texts, mix64, texts_of, words_of


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    dim: int = 8
    grams: tuple[int, ...] = (3, 4, 5)
    epochs: int = 3
    rate: float = 0.5
    batch: int = 32
    max_rows: int = 4_000  # labelled rows learned from: those of smallest hash
    max_chars: int = 40_000_000  # of those rows, in that order, the ones whose characters still fit in this many
    threshold: float = 0.3


REPEAT = 0  # the bucket of the repeat feature


def gram_features(words: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every hashed feature of the distinct words: the word itself and its n-grams, in bytes, with ends marked."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = pc.binary_join_element_wise(pa.scalar("<", pa.large_string()), words.cast(pa.large_string()), pa.scalar(">", pa.large_string()), pa.scalar("", pa.large_string()))
    _, off, data = marked.buffers()
    off = np.frombuffer(off, np.int64)[marked.offset:marked.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]].astype(np.uint64) + np.uint64(1)
    off = off - off[0]
    owner = np.repeat(np.arange(n), np.diff(off))
    left = off[owner + 1] - np.arange(len(raw))  # bytes from here to the word's end
    ids, feats = [], []
    with np.errstate(over="ignore"):
        rolling = raw.copy()
        for size in range(2, max(s.grams) + 1):
            rolling = rolling[:-1] * np.uint64(0x100000001B3) + raw[size - 1:] if len(rolling) > 1 else rolling[:0]
            if size in s.grams and len(rolling):
                ok = left[:len(rolling)] >= size
                ids.append(owner[:len(rolling)][ok])
                feats.append(mix64(rolling[ok] + np.uint64(size)) % np.uint64(s.buckets - 1))
        # the whole word: the sum of its bytes, each mixed with its place
        place = (np.arange(len(raw)) - off[owner]).astype(np.uint64)
        whole = np.add.reduceat(mix64(raw * np.uint64(0x9E3779B97F4A7C15) + place), off[:-1])
        ids.append(np.arange(n))
        feats.append(mix64(whole) % np.uint64(s.buckets - 1))
    return np.concatenate(ids), np.concatenate(feats).astype(np.int64) + 1


def doc_features(texts: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, weight) of the averaged features; weights of a document add up to 1."""
    doc, word, distinct = words_of(texts)
    ids, feats = gram_features(distinct, s)
    order = np.argsort(ids, kind="stable")
    ids, feats = ids[order], feats[order]
    each = np.bincount(ids, minlength=len(distinct))
    starts = np.cumsum(each) - each
    counted, times = np.unique(doc * max(len(distinct), 1) + word, return_counts=True)
    d, w = np.divmod(counted, max(len(distinct), 1))
    span = each[w] if len(w) else np.zeros(0, np.int64)
    at = np.repeat(starts[w] - (np.cumsum(span) - span), span) + np.arange(span.sum()) if len(w) else np.zeros(0, np.int64)
    same = (doc[1:] == doc[:-1]) & (word[1:] == word[:-1])
    repeats = np.bincount(doc[1:][same], minlength=len(texts)).astype(float)
    dd = np.concatenate([np.repeat(d, span), np.flatnonzero(repeats)])
    ff = np.concatenate([feats[at], np.full(int((repeats > 0).sum()), REPEAT)])
    # a repeat counts as much as a whole word with its n-grams does
    ww = np.concatenate([np.repeat(times, span).astype(float), 10.0 * repeats[repeats > 0]])
    keys, inverse = np.unique(dd * s.buckets + ff, return_inverse=True)
    weight = np.bincount(inverse, ww, len(keys)) if len(keys) else np.zeros(0)
    dd, ff = np.divmod(keys, s.buckets)
    total = np.bincount(dd, weight, len(texts))
    return dd, ff, weight / np.maximum(total[dd], 1e-12)


def train(texts: list[str], labels: list[int], s: Settings, seed: int = 7) -> tuple[np.ndarray, float]:
    """(logit of class 1 against class 0 by bucket, bias)."""
    if not texts:
        return np.zeros(s.buckets), 0.0
    rng = np.random.default_rng(seed)
    y = np.asarray(labels)
    E = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim))
    W, b = rng.uniform(-0.1, 0.1, (s.dim, 2)), np.log(np.bincount(y, minlength=2) + 1.0)
    rows = []
    for i in range(0, len(texts), 32):  # few at a time: the features before they are counted are many
        d, f, w = doc_features(pa.array(texts[i:i + 32], pa.large_string()), s)
        edges = np.searchsorted(d, np.arange(len(texts[i:i + 32]) + 1))
        rows += [(f[a:z].astype(np.int32), w[a:z].astype(np.float32)) for a, z in zip(edges, edges[1:], strict=False)]
    steps, total = 0, s.epochs * len(rows)
    for _ in range(s.epochs):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // s.batch)):
            rate = s.rate * max(0.02, 1 - steps / total)
            steps += len(at)
            f = np.concatenate([rows[i][0] for i in at])
            w = np.concatenate([rows[i][1] for i in at])
            d = np.repeat(np.arange(len(at)), [len(rows[i][0]) for i in at])
            used = E[f] * w[:, None]
            v = np.stack([np.bincount(d, used[:, k], len(at)) for k in range(s.dim)], 1)
            z = v @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p
            g[np.arange(len(at)), y[at]] -= 1
            back = g @ W.T
            uniq, inverse = np.unique(f, return_inverse=True)
            for k in range(s.dim):
                # averaged inputs make tiny gradients: the step is scaled to the number of features of a document
                E[uniq, k] -= rate * 40 * np.bincount(inverse, w * back[d, k], len(uniq))
            W -= rate * v.T @ g
            b = b - rate * 0.2 * g.mean(0)
    return E @ (W[:, 1] - W[:, 0]), float(b[1] - b[0])


def score_texts(texts: pa.Array, logits: np.ndarray, bias: float, s: Settings) -> np.ndarray:
    doc, word, distinct = words_of(texts)
    ids, feats = gram_features(distinct, s)
    value = np.bincount(ids, logits[feats], len(distinct))
    each = np.bincount(ids, minlength=len(distinct)).astype(float)
    total = np.bincount(doc, value[word], len(texts)) if len(doc) else np.zeros(len(texts))
    count = np.bincount(doc, each[word], len(texts)) if len(doc) else np.zeros(len(texts))
    same = (doc[1:] == doc[:-1]) & (word[1:] == word[:-1])
    repeats = 10.0 * np.bincount(doc[1:][same], minlength=len(texts))
    z = (total + repeats * logits[REPEAT]) / np.maximum(count + repeats, 1e-12) + bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Learn from at most ``max_rows`` labelled documents outside the held-out part; weights are of fixed size."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("lid"), F.col("quality").cast("int").alias("y")).distinct()
    # about twice the wanted number by hash first, so that what tasks send to be sorted doesn't grow with their number
    share = min(1.0, 2 * s.max_rows / max(1, usable.count()))
    hashed = usable.withColumn("h", F.xxhash64(F.lit(17), "lid", "y")).where(F.pmod("h", F.lit(1 << 31)) < share * (1 << 31))
    chosen = hashed.orderBy("h", "lid", "y").limit(s.max_rows)
    # lengths first: only texts that are learned from reach the driver
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"n": F.char_length("text").cast("long"), "th": F.xxhash64("text")})
    short = rows.drop("text").where(F.col("n") <= s.max_chars).join(chosen, F.col("doc_id") == F.col("lid")).select("h", "lid", "th", "n", "y").orderBy("h", "lid", "y", "th", "n").limit(s.max_rows).collect()
    room, taken = s.max_chars, []
    for r in short:
        if r["n"] <= room:
            room -= r["n"]
            taken.append(r)
    if not taken:
        return train([], [], s)
    wanted = docs.sparkSession.createDataFrame(list({(r["lid"], r["th"], r["n"]) for r in taken}), T.StructType([T.StructField("lid", usable.schema["lid"].dataType), T.StructField("wh", T.LongType()), T.StructField("wn", T.LongType())]))
    same = (F.col("doc_id") == F.col("lid")) & (F.col("th") == F.col("wh")) & (F.col("n") == F.col("wn"))
    # rows that repeat are brought once, and learned from as often as they were chosen
    # at most max_rows short rows, of which Spark knows no size: without the hint it would shuffle every text
    got = rows.join(F.broadcast(wanted), same).groupBy("lid", "wh", "wn").agg(F.min("text").alias("text")).toArrow()
    text_of = dict(zip(zip(*(got.column(c).to_pylist() for c in ("lid", "wh", "wn")), strict=True), got.column("text").to_pylist(), strict=True))
    return train([text_of[r["lid"], r["th"], r["n"]] for r in taken], [r["y"] for r in taken], s)


def scores(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, s: Settings = Settings()) -> DataFrame:
    """Columns ``keep`` (default: all) and the score of each document, in one pass over all whole texts."""
    kept = docs.columns if keep is None else keep
    (score,) = fresh(docs.columns, "score")
    logits, bias = fit(docs, labels, s)
    shared = docs.sparkSession.sparkContext.broadcast((logits, bias))  # size fixed by Settings: 8 bytes a bucket

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        w, b = shared.value
        return [pa.array(score_texts(texts_of(part.column("text")), w, b, s))]

    wanted = [*kept, *(c for c in ["text"] if c not in kept)]
    return map_texts(docs.select(*wanted), "text", [T.StructField(score, T.DoubleType())], work, kept)


def report(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    out = scores(docs, labels, ["doc_id"], s)
    score = out.columns[-1]
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= s.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents the classifier doesn't reject, unchanged."""
    out = scores(docs, labels, None, s)
    return out.where(F.col(f"`{out.columns[-1]}`") >= s.threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
