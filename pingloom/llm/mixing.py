"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic). Raking finds one factor a source, a language and a topic so that the weighted
tokens meet the target share of every source, every language and every topic: the weights. How much is kept is a stated share of all
words (``Settings.budget``), whatever the rarest cell asks for. Documents are sampled by probabilities that are raked likewise, within
that budget and never above 1: a category that has fewer words than its target asks for is taken whole, the others share what it leaves
in proportion to their targets. ``targets`` tells what share each category was to have and has.

Sources may be many: their factors stay in a DataFrame, and a round of fitting is one aggregation over one row a source. Topics are few,
and so are languages: beyond the ``Settings.languages`` with the most words (a column that isn't clean may hold any number) all others
are one category together. Their factors are a small array on the driver.

Defined cases: a null source or language is a category of its own; a null text is read as empty; a document without a word has topic
-1, weight 0 and probability 0 and is not sampled; repeated rows share one decision; an empty table gives an empty result; other
columns, whatever their names, are ignored by ``report`` and kept by ``sample``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingloom.llm.common import fresh, map_texts, texts_of, word_hashes, words_of
from pingloom.plans.stages import materialize


@dataclass(frozen=True)
class Settings:
    """Targets are the observed token shares raised to a power and renormalised: 1 leaves a margin as it is, 0 levels it."""

    source_power: float = 0.8
    lang_power: float = 0.8
    topic_power: float = 0.8
    topics: int = 8
    rounds: int = 30
    tolerance: float = 1e-6
    seed: int = 11
    languages: int = 256  # with the most words, each a category; if there are more, all others are one category together
    budget: float = 2 / 3  # expected share of all words that is kept, the same at every size


def _category(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def counted(docs: DataFrame, text: str, keep: list[str], s: Settings) -> DataFrame:
    """``keep``, the words of each document and how many fall in each topic's part of the vocabulary."""
    tokens, groups = fresh(docs.columns, "tokens", "groups")

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        texts = texts_of(part.column(text))
        doc, word, distinct = words_of(texts)
        group = (word_hashes(distinct) % np.uint64(s.topics)).astype(np.int64)
        table = np.bincount(doc * s.topics + group[word], minlength=len(texts) * s.topics).reshape(-1, s.topics) if len(doc) else np.zeros((len(texts), s.topics), np.int64)
        return [pa.array(table.sum(1), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(table.ravel(), pa.int64()), s.topics).cast(pa.list_(pa.int64()))]

    fields = [T.StructField(tokens, T.LongType()), T.StructField(groups, T.ArrayType(T.LongType()))]
    return map_texts(docs.select(*dict.fromkeys([*keep, text])), text, fields, work, keep)


def _targets(mass: np.ndarray, power: float) -> np.ndarray:
    t = np.where(mass > 0, np.power(np.maximum(mass, 1e-300), power), 0.0)
    return t / t.sum()


def _shared(mass: np.ndarray, target: np.ndarray, total: float) -> np.ndarray:
    """``total`` dealt in proportion to the targets, to each no more than its mass."""
    full = np.zeros(len(mass), bool)
    while True:
        free = target[~full].sum()
        scale = max(total - mass[full].sum(), 0.0) / free if free else 0.0
        over = ~full & (scale * target >= mass)
        if not over.any():
            return np.where(full, mass, scale * target)
        full |= over


def _capped(mass: np.ndarray, wanted: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each row of cell masses the factor f by which sum(mass * min(1, f * u)) is what is wanted; at most what takes all of it."""
    order = np.argsort(-u, kind="stable")
    m, v = mass[:, order], u[order]
    whole = np.cumsum(m, 1) - m  # taken whole: all cells before this one
    rest = np.cumsum((m * v)[:, ::-1], 1)[:, ::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (wanted[:, None] - whole) / rest
        fits = (m > 0) & (f * v <= 1)
        least = np.where(m > 0, 1 / v, 0.0).max(1)
    return np.where(fits.any(1), np.take_along_axis(f, fits.argmax(1)[:, None], 1)[:, 0], least)


def _by_source(batches: Iterator[pa.RecordBatch], u: np.ndarray, scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their cell masses, their factors) in runs of bounded size."""
    step = max(1, 1_000_000 // len(u))
    for batch in batches:
        for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
            cells = part.column("cells")
            row, flat = pc.list_parent_indices(cells).to_numpy(), cells.flatten()
            mass = np.zeros((part.num_rows, len(u)))
            mass[row, flat.field("at").to_numpy()] = flat.field("mass").to_numpy()
            wanted = np.minimum(scale * part.column("target").to_numpy(), mass.sum(1))
            yield part, mass, _capped(mass, wanted, u)


def _probabilities(by_source: DataFrame, src: str, mass: np.ndarray, want_g: np.ndarray, want_h: np.ndarray, g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[DataFrame, np.ndarray]:
    """(factor of each source, factor of each language and topic): a document's probability is their product, at most 1.

    The last step is that of the sources, so the budget is met even where the targets of languages and topics can't be.
    """
    total = s.budget * float(mass.sum())
    want_g, want_h = _shared(mass.sum(1), want_g, total), _shared(mass.sum(0), want_h, total)
    # the sources' common scale: those that are taken whole only become more
    scale, full = total, -1
    while True:
        over = F.lit(scale) * F.col("target") >= F.col("words")
        r = by_source.withColumn("words", F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["mass"])).agg(
            F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("words")).otherwise(0.0)).alias("whole"), F.sum(F.when(over, 0.0).otherwise(F.col("target"))).alias("free")).first()
        if r["n"] == full or not r["free"]:
            break
        scale, full = max(scale, (total - r["whole"]) / r["free"]), r["n"]

    def taken(u: np.ndarray) -> np.ndarray:
        """By language and topic: words of cells taken whole, expected words of the others."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, m, f in _by_source(batches, u, scale):
                p = f[:, None] * u
                whole = p >= 1 - 1e-12
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(u), dtype=np.int32)), pa.array((m * whole).sum(0)), pa.array((m * np.where(whole, 0.0, p)).sum(0))], names=["at", "whole", "part"])

        out = np.zeros((2, len(u)))
        for r in by_source.mapInArrow(run, "at int, whole double, part double").groupBy("at").agg(F.sum("whole"), F.sum("part")).collect():
            out[:, r[0]] = r[1], r[2]
        return out.reshape(2, *mass.shape)

    last = np.inf
    for _ in range(s.rounds):
        whole, part = taken(np.outer(g, h).ravel())
        with np.errstate(divide="ignore", invalid="ignore"):
            off = max(np.nanmax(np.abs((whole + part).sum(1) / want_g - 1)), np.nanmax(np.abs((whole + part).sum(0) / want_h - 1)))
        if off < s.tolerance or abs(last - off) < s.tolerance / 10:
            break
        last = off
        for _ in range(100):
            a = _step(want_g - whole.sum(1), part.sum(1))
            part, g = part * a[:, None], g * a
            b = _step(want_h - whole.sum(0), part.sum(0))
            part, h = part * b, h * b
            if np.abs(b - 1).max(initial=0.0) < s.tolerance / 10:
                break
        g, h = np.where(g > 0, g / g.max(), 0.0), np.where(h > 0, h / h.max(), 0.0)
    u = np.outer(g, h).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, f in _by_source(batches, u, scale):
            yield pa.RecordBatch.from_arrays([part.column(src), pa.array(f)], names=[src, "chance"])

    return by_source.mapInArrow(run, T.StructType([T.StructField(src, T.StringType()), T.StructField("chance", T.DoubleType())])), u


def _step(wanted: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Factors towards what is wanted, in bounded steps as cells reach or leave probability 1 on the way."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(there > 0, np.clip(wanted / there, 0.25, 4.0), 1.0)


def weighted(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", doc_id: str = "doc_id", keep: list[str] | None = None, s: Settings = Settings()) -> tuple[DataFrame, list[str]]:
    """(``keep`` and, named by the second result, topic, tokens, weight, probability and kept for each document)."""
    spark = docs.sparkSession
    kept = docs.columns if keep is None else keep
    need = list(dict.fromkeys([*kept, source, lang, doc_id]))
    light = text not in kept
    # counts are written, texts never: a caller that keeps the text has it read a second time
    stage = materialize(counted(docs, text, need if light else list(dict.fromkeys([source, lang, doc_id])), s))
    tokens, groups = (F.col(f"`{c}`") for c in stage.columns[-2:])
    names = fresh(docs.columns, "topic", "tokens", "weight", "probability", "kept")
    # a document's topic: the part of the vocabulary it uses most beyond its share in the whole corpus
    total = stage.select(*[F.sum(F.get(groups, F.lit(g))).alias(f"g{g}") for g in range(s.topics)]).first()
    share = np.array([float(x or 0) for x in total])
    shares = F.array(*[F.lit(float(x)) for x in np.maximum(share / max(share.sum(), 1.0), 1e-12)])
    lift = F.transform(groups, lambda g, i: F.struct((g / F.get(shares, i)).alias("l"), (-i).alias("i")))
    topic = F.when(tokens > 0, -F.array_max(lift)["i"]).otherwise(F.lit(-1)).cast("int")
    named = _category(F.col(f"`{lang}`"))
    most = stage.where(tokens > 0).groupBy(named.alias("l")).agg(F.sum(tokens).alias("n")).orderBy(F.desc("n"), "l").limit(s.languages + 1).collect()
    if len(most) > s.languages:
        named = F.when(named.isin([r["l"] for r in most[:s.languages]]), named).otherwise(F.lit("~"))
    src, lng, top, tok = fresh(stage.columns, "src", "lng", "top", "tok")
    groups_name = fresh([*docs.columns, *stage.columns, src, lng, top, tok], "grp")[0]

    def placed(df: DataFrame, columns: list[str]) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in columns], groups.alias(groups_name), _category(F.col(f"`{source}`")).alias(src), named.alias(lng), topic.alias(top), tokens.alias(tok))

    rows = placed(stage if light else counted(docs, text, need, s), need)
    cells = materialize(placed(stage, []).where(F.col(tok) > 0).groupBy(src, lng, top).agg(F.sum(tok).cast("double").alias("mass")))
    langs = sorted(r[0] for r in cells.select(lng).distinct().collect())  # at most one more than Settings.languages
    grid = np.zeros((len(langs), s.topics))
    for r in cells.groupBy(lng, top).agg(F.sum("mass").alias("m")).collect():
        grid[langs.index(r[lng]), r[top]] = r["m"]
    if not grid.sum():
        grid = np.zeros((1, s.topics))
    place = F.create_map(*[x for i, name in enumerate(langs) for x in (F.lit(name), F.lit(i))]) if langs else F.create_map(F.lit(""), F.lit(0))
    at = F.try_element_at(place, F.col(lng)) * s.topics + F.col(top)
    by_source = cells.withColumn("at", at).groupBy(src).agg(F.sum("mass").alias("mass"), F.collect_list(F.struct("at", "mass")).alias("cells"))
    norm = by_source.agg(F.sum(F.pow("mass", F.lit(s.source_power))).alias("z")).first()["z"] or 1.0
    by_source = materialize(by_source.select(src, (F.pow("mass", F.lit(s.source_power)) / norm).alias("target"), "cells"))

    mass, g, h = grid, np.ones(grid.shape[0]), np.ones(s.topics)
    want_g, want_h = (_targets(grid.sum(1), s.lang_power), _targets(grid.sum(0), s.topic_power)) if grid.sum() else (g, h)

    def factors() -> DataFrame:
        """The factor of each source under the present factors of languages and topics."""
        u = F.array(*[F.lit(float(x)) for x in np.outer(g, h).ravel()])
        seen = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["mass"] * F.get(u, c["at"]))
        return by_source.select(src, (F.col("target") / seen).alias("factor"), F.transform("cells", lambda c: F.struct(c["at"].alias("at"), (c["mass"] * F.get(u, c["at"]) * F.col("target") / seen).alias("m"))).alias("cells"))

    for _ in range(s.rounds if grid.sum() else 0):
        fitted = factors().select(F.explode("cells").alias("c")).groupBy("c.at").agg(F.sum("c.m").alias("m")).collect()
        grid = np.zeros(len(g) * s.topics)
        for r in fitted:
            grid[r["at"]] = r["m"]
        grid = grid.reshape(len(g), s.topics)
        with np.errstate(divide="ignore", invalid="ignore"):
            off = max(np.nanmax(np.abs(grid.sum(1) / want_g - 1)), np.nanmax(np.abs(grid.sum(0) / want_h - 1)))
            if off < s.tolerance:
                break
            for _ in range(100):
                a = np.nan_to_num(want_g / grid.sum(1), posinf=0.0)
                grid, g = grid * a[:, None], g * a
                b = np.nan_to_num(want_h / grid.sum(0), posinf=0.0)
                grid, h = grid * b, h * b
                if np.abs(b[b > 0] - 1).max(initial=0.0) < s.tolerance / 10:
                    break
    u = F.array(*[F.lit(float(x)) for x in np.outer(g, h).ravel()])
    chances, v = _probabilities(by_source, src, mass, want_g, want_h, g, h, s) if mass.sum() else (by_source.select(src, F.lit(0.0).alias("chance")), np.zeros(mass.size))
    v = F.array(*[F.lit(float(x)) for x in v])
    key, factor, chance = fresh(rows.columns, "key", "factor", "chance")
    done = materialize(factors().select(src, "factor").join(chances, src).select(F.col(src).alias(key), F.col("factor").alias(factor), F.col("chance").alias(chance)))
    joined = rows.join(done, F.col(src) == F.col(key), "left")
    weight = F.when(F.col(tok) > 0, F.col(factor) * F.get(u, at)).otherwise(F.lit(0.0))
    # a cell that is taken whole may come out a rounding below 1
    chance = F.when(F.col(tok) > 0, F.col(chance) * F.get(v, at)).otherwise(F.lit(0.0))
    chance = F.when(chance >= 1 - 1e-12, F.lit(1.0)).otherwise(chance)
    draw = F.pmod(F.xxhash64(F.lit(s.seed), F.col(f"`{doc_id}`"), F.col(src), F.col(lng), F.col(groups_name)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    out = joined.select(*[F.col(f"`{c}`") for c in kept], F.col(top).alias(names[0]), F.col(tok).alias(names[1]), weight.alias(names[2]), chance.alias(names[3]), (draw < chance).alias(names[4]))
    return out, names


def sample(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The sampled documents, unchanged."""
    out, names = weighted(docs, s=s)
    return out.where(F.col(names[4])).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return weighted(docs.select("doc_id", "source", "lang", "text"), keep=["doc_id", "source", "lang"], s=s)[0]


def targets(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(margin, category, words, target, reached, met): the share each source, language and topic was to have of the kept words, and has."""
    out, (top, tok, weight, chance, _) = weighted(docs.select("doc_id", "source", "lang", "text"), keep=["source", "lang"], s=s)
    margins = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(c).cast("string").alias("category")) for m, c in (("source", "source"), ("lang", "lang"), ("topic", top))])).alias("m")
    sums = out.where(F.col(tok) > 0).select(margins, F.col(tok).alias("w"), (F.col(tok) * F.col(weight)).alias("t"), (F.col(tok) * F.col(chance)).alias("k")).groupBy("m").agg(F.sum("w").alias("words"), F.sum("t").alias("target"), F.sum("k").alias("k"))
    total = materialize(sums)
    kept = total.where(F.col("m.margin") == "topic").agg(F.sum("k")).first()[0] or 1.0
    reached = F.col("k") / F.lit(float(kept))
    return total.select("m.margin", "m.category", "words", "target", reached.alias("reached"), (F.abs(reached / F.col("target") - 1) < 1e-3).alias("met"))
