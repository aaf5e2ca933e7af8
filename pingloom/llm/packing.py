"""Packing token sequences by hierarchical residual best fit.

Documents are tokenised and cut into pieces of at most ``size`` tokens. Partitions pack their pieces locally, largest first, each into
the fullest bin that still has room; nearly full bins are final. What is left, bins as items, is merged up a tree, fewer groups a level,
and packed again by best fit until one group remains. A bin that was taken as an item keeps its inner order, so a piece's place is the sum
of the places on its way up.

Defined cases: a null text is read as empty; an empty text is the end mark alone, one token; rows repeat as they came, each with its
own pieces; an empty table gives an empty result; other columns, whatever their names, are ignored or kept as asked.
"""

from __future__ import annotations

import bisect
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingloom.llm.common import fresh, slices, texts_of, words_of
from pingloom.plans.stages import materialize

SIZE = 2048
END = 0  # the id that ends each document
GROUP_ITEMS = 100_000  # items packed by one task
NEARLY_FULL = 8  # a bin with at most this much room is final below the top
TOKEN_SLICE = 4 << 20  # bytes of text tokenised together: equal words of a slice are tokenised once
STUCK = 0.95  # of a level's items: if more are left open, packing them again would gain next to nothing
MOST_LEVELS = 24
CACHED = 500_000  # words a worker remembers
ODD = "[\x1c-\x1f]"


def vocabulary() -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts under a word-level vocabulary file, each distinct word encoded once.

    The vocabulary's pattern never matches across white space, so white-space words are encoded independently and remembered. A new
    word is normalised and cut by the vocabulary's own rules, and its parts go through its merge table. Texts with separators that
    only some libraries read as white space go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Fixed value: the vocabulary's word pattern
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        # the usual printable stand-ins of single bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = iter(range(256, 512))
        self.stand_in = {b: chr(b if b in plain else next(shifted)) for b in range(256)}
        self.cached = pa.array([], pa.large_string())
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.known_parts: dict[str, tuple[int, ...]] = {}

    def _part(self, part: str) -> tuple[int, ...]:
        got = self.known_parts.get(part)
        if got is None:
            if len(self.known_parts) >= CACHED:
                self.known_parts.clear()
            marked = part if part.isascii() and part.isalnum() else part.encode().decode("latin-1").translate(self.stand_in)
            got = self.known_parts[part] = tuple([t.id for t in self.tokenizer.model.tokenize(marked)])
        return got

    def _word(self, word: str) -> tuple[int, ...]:
        if "<|" in word:  # may hold the name of a special token
            return tuple(self.tokenizer.encode(word, add_special_tokens=False).ids)
        normal = word.lower() if word.isascii() else self.tokenizer.normalizer.normalize_str(word)
        if normal.isalpha():
            return self._part(normal)
        return tuple(chain.from_iterable(map(self._part, self.parts.findall(normal))))

    def _words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each word in the ids, its number of ids, the ids)."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.cached), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.cached) + len(new) > CACHED:  # keep what this run of texts uses
                used = np.unique(at[at >= 0])
                begin = np.cumsum(self.size) - self.size
                span = self.size[used]
                self.flat = self.flat[np.repeat(begin[used] - (np.cumsum(span) - span), span) + np.arange(span.sum())]
                self.cached, self.size = self.cached.take(pa.array(used)), span
                at[at >= 0] = np.searchsorted(used, at[at >= 0])
            words = distinct.take(pa.array(new))
            found = [self._word(w) for w in words.to_pylist()]
            more = np.fromiter(map(len, found), np.int64, len(found))
            at[new] = len(self.cached) + np.arange(len(new))
            self.cached = pa.concat_arrays([self.cached, words])
            self.size = np.concatenate([self.size, more])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(more.sum()))])
        return (np.cumsum(self.size) - self.size)[at], self.size[at], self.flat

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and end)."""
        doc, word, distinct = words_of(texts)
        begin, size, flat = self._words(distinct)
        span = size[word]
        at = np.repeat(begin[word] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        ids, lengths = flat[at], np.bincount(doc, span, len(texts)).astype(np.int64)
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False))
        if len(odd):
            each = np.split(ids, np.cumsum(lengths)[:-1])
            for i in odd.tolist():
                each[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, lengths = np.concatenate(each), np.array([len(x) for x in each])
        return ids, np.concatenate([[0], np.cumsum(lengths)])


def pieces(docs: DataFrame, text: str, keep: list[str], path: str, size: int = SIZE, ids: bool = False) -> DataFrame:
    """One row a piece: columns ``keep``, piece, start, length, ids_crc32 and, if asked for, the ids."""
    names = fresh(keep, "piece", "start", "length", "ids_crc32", *(["ids"] if ids else []))
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.IntegerType())]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, k) for n, k in zip(names, kinds, strict=False))])
    state: dict[str, Encoder] = {}

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, TOKEN_SLICE):
                encoder = state.get("e") or state.setdefault("e", Encoder(path))
                row, piece, start, length, crc, values = [], [], [], [], [], []
                found, edges = encoder.encode(texts_of(part.column(text)))
                for i in range(part.num_rows):
                    full = np.append(found[edges[i]:edges[i + 1]], np.uint32(END)).astype("<u4")
                    for k, a in enumerate(range(0, len(full), size)):
                        cut = full[a:a + size]
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        if ids:
                            values.append(cut.astype(np.int32))
                at = pa.array(row, pa.int64())
                new = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                new += [pa.array(values, pa.list_(pa.int32()))] if ids else []
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in keep), *new], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, place in it, fill of each bin): largest first, each into the fullest bin with room."""
    order = np.argsort(-sizes, kind="stable")
    where, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[int] = []  # the distinct amounts of room, ascending
    open_bins: dict[int, list[int]] = {}
    fill: list[int] = []
    for i, n in zip(order.tolist(), sizes[order].tolist(), strict=True):
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        where[i], place[i] = b, fill[b]
        fill[b] += n
        room -= n
        if room:
            if room not in open_bins:
                open_bins[room] = []
                bisect.insort(rooms, room)
            open_bins[room].append(b)
    return where, place, np.array(fill, np.int64)


_LINK = "item long, bin long, place long, size long, fill long, grp int"


def _pack_level(items: DataFrame, level: int, size: int) -> DataFrame:
    """Pack the items of each group; a row an item with its bin, the place in it and the bin's fill."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        where, place, fill = best_fit(pdf["size"].to_numpy(), size)
        g = int(pdf["grp"].iloc[0])
        bins = (np.int64(level) << 58) | (np.int64(g) << 32) | where
        return pd.DataFrame({"item": pdf["item"], "bin": bins, "place": place, "size": pdf["size"], "fill": fill[where], "grp": np.int32(g)})

    return items.groupBy("grp").applyInPandas(pack, _LINK)


def assign(placed: DataFrame, row: str, length: str, size: int = SIZE, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(``row``, sequence_id, offset) for every row of ``placed``; ``row`` must be unique, numbered from 0 within each partition.

    Level by level: groups of about ``group_items`` items are packed, and all bins that aren't nearly full go up as the items of the
    next level, dealt into as many groups as their number asks for. So groups keep their size and nothing is closed early. The tree
    ends with one group, or when a level of several groups leaves nearly as many open bins as it was given (``STUCK``): then there is
    hardly a pair of them that fits together.
    """
    n = placed.count()
    groups = max(1, -(-n // group_items))
    items = placed.select(F.col(row).alias("item"), F.col(length).alias("size"), F.pmod(F.xxhash64(row), F.lit(groups)).cast("int").alias("grp"))
    level, links = 1, []
    while True:
        packed = materialize(_pack_level(items, level, size))
        links.append(packed.select("item", "bin", "place"))
        up = packed.where((F.col("place") == 0) & (F.col("fill") < size - NEARLY_FULL)).select(F.col("bin").alias("item"), F.col("fill").alias("size"))
        left = up.count() if groups > 1 else 0
        if not left or (level > 1 and left > STUCK * n) or level == MOST_LEVELS:
            break
        n, level, groups = left, level + 1, -(-left // group_items)
        items = up.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)).cast("int"))
    # from the top down: the final bin and place of each bin, then of each item
    above = None
    for link in reversed(links):
        if above is None:
            above = link
            continue
        up = above.select(F.col("item").alias("_item"), F.col("bin").alias("_bin"), F.col("place").alias("_place"))
        joined = link.join(up, F.col("bin") == F.col("_item"), "left")
        above = joined.select("item", F.coalesce("_bin", "bin").alias("bin"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place"))
    return above.select(F.col("item").alias(row), F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once with a unique number a row, so that the number stays the same however often the rows are read."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def pack(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, size: int = SIZE, ids: bool = False) -> DataFrame:
    """One row a piece: ``keep`` (default: all columns but the text), piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    kept = [c for c in docs.columns if c != text] if keep is None else keep
    cut = pieces(docs, text, kept, path or vocabulary(), size, ids)
    names = cut.columns[len(kept):]
    row, seq, off, at = fresh(cut.columns, "row", "sequence_id", "offset", "at")
    stage = numbered(cut, row)
    places = assign(stage, row, names[2], size).select(F.col(row).alias(at), F.col("sequence_id").alias(seq), F.col("offset").alias(off))
    return stage.join(places, F.col(f"`{row}`") == F.col(at)).select(*[F.col(f"`{c}`") for c in [*cut.columns, seq, off]])
