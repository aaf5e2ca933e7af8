"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that differ from all ``taken`` (Spark compares names without case)."""
    seen, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def texts_of(column: pa.Array) -> pa.Array:
    """A text column as plain strings, null read as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``size`` bytes of text, so memory follows bytes and not rows."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document of each word, word number of each word, the distinct words), words split at white space."""
    lists = pc.utf8_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    doc = np.repeat(np.arange(len(lists), dtype=np.int64), np.diff(offsets))
    if len(flat):
        full = pc.fill_null(pc.greater(pc.binary_length(flat), 0), False).to_numpy(zero_copy_only=False)
        if not full.all():
            flat, doc = flat.filter(pa.array(full)), doc[full]
    if not len(flat):
        return doc[:0], np.zeros(0, np.int64), pa.array([], pa.large_string())
    coded = flat.dictionary_encode()
    return doc, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def map_texts(df: DataFrame, text: str, fields: list[T.StructField], work: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """Append ``fields``, computed by ``work`` from slices of rows, to the columns ``keep`` (default: all)."""
    kept = df.columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *work(part)], names=names)

    return df.mapInArrow(run, schema)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its bytes, each mixed with its place."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_string())
    _, off, data = words.buffers()
    off = np.frombuffer(off, np.int64)[words.offset:words.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]].astype(np.uint64) if data is not None else np.zeros(0, np.uint64)
    off = off - off[0]
    size = np.diff(off)
    place = (np.arange(len(raw)) - np.repeat(off[:-1], size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = mix64((raw + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        return mix64(total[off[1:]] - total[off[:-1]] + size.astype(np.uint64))
