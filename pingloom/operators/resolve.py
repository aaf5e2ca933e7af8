"""Names to ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingloom.functions.scalars import normalize_name
from pingloom.plans.stages import materialize


def first_per_key(dictionary: DataFrame, key, value: str) -> DataFrame:
    """One id per name, the smallest, so that a doubled name cannot multiply rows."""
    return dictionary.groupBy(key.alias("_name")).agg(F.min(value).alias("_id")).where("_name IS NOT NULL")


def map_by_name(df: DataFrame, name: str, dictionary: DataFrame, dict_name: str, dict_id: str, output: str) -> DataFrame:
    """Trimmed exact match; rows without an entry keep NULL."""
    known = first_per_key(dictionary, F.trim(dict_name), dict_id)
    return df.withColumn("_name", F.trim(name)).join(known, "_name", "left").withColumnRenamed("_id", output).drop("_name")


def unmatched_names(df: DataFrame, name: str, dictionary: DataFrame, dict_name: str) -> DataFrame:
    """Names without an entry and how often they occur; equal names merge before the join."""
    counted = df.groupBy(F.trim(name).alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
    known = dictionary.select(F.trim(dict_name).alias("name"))
    return counted.join(known, "name", "left_anti")


def map_cascade(names: DataFrame, name: str, dictionary: DataFrame, dict_name: str, dict_id: str) -> DataFrame:
    """Exact, then case-insensitive, then normalised, then contained-in (as a substring, either way); works on distinct names.

    Containment has no join key of its own, so it goes through an index of letter triples. The first stages are plain key joins.
    A name of which nothing is left matches nothing.
    """
    todo = names.select(F.col(name).alias("name")).distinct()
    exact = first_per_key(dictionary, F.trim(dict_name), dict_id).select(F.col("_name").alias("_k0"), F.col("_id").alias("_id0"))
    lower = first_per_key(dictionary, F.lower(F.trim(dict_name)), dict_id).select(F.col("_name").alias("_k1"), F.col("_id").alias("_id1"))
    normal = first_per_key(dictionary, normalize_name(dict_name), dict_id).select(F.col("_name").alias("_k2"), F.col("_id").alias("_id2"))
    staged = (
        todo.withColumn("_k0", F.trim("name")).withColumn("_k1", F.lower(F.trim("name"))).withColumn("_k2", normalize_name("name"))
        .join(exact, "_k0", "left").join(lower, "_k1", "left").join(normal, "_k2", "left")
    )
    resolved = staged.select(
        "name", F.col("_k2").alias("_norm"), F.coalesce("_id0", "_id1", "_id2").alias("_id"),
        F.when(F.col("_id0").isNotNull(), "exact").when(F.col("_id1").isNotNull(), "case").when(F.col("_id2").isNotNull(), "normalized").alias("_how"),
    )
    contained = _contained(resolved.where("_id IS NULL").select("_norm"), normal.select(F.col("_k2").alias("_dict"), F.col("_id2").alias("_dict_id")))
    return resolved.join(contained, "_norm", "left").select(
        "name",
        F.coalesce("_id", "_contained_id").alias("id"),
        F.coalesce("_how", F.when(F.col("_contained_id").isNotNull(), "contains"), F.lit("unmatched")).alias("match_type"),
    )


def _grams(text, size: int):
    """The distinct runs of ``size`` letters; none in a shorter text."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def containment_candidates(inner: DataFrame, inner_key: str, outer: DataFrame, outer_key: str, size: int = 3) -> DataFrame:
    """Pairs that may contain each other: the container's letter triples include the rarest one of the contained text.

    A contained text shorter than a triple is looked up as a whole, among the runs of its own length.
    """
    postings = outer.select(outer_key, F.explode(F.concat(*[_grams(F.col(outer_key), k) for k in range(1, size + 1)])).alias("_gram"))
    whole = F.when(F.length(inner_key) < size, F.array(inner_key)).otherwise(_grams(F.col(inner_key), size))
    asked = inner.where(F.length(inner_key) > 0).select(inner_key, F.explode(whole).alias("_gram"))
    frequency = postings.groupBy("_gram").agg(F.count("*").alias("_f"))
    # a triple no container has rules the text out
    rarest = asked.join(frequency, "_gram", "left").groupBy(inner_key).agg(F.min_by("_gram", F.struct(F.coalesce("_f", F.lit(0)), "_gram")).alias("_gram"))
    return rarest.join(postings, "_gram").select(inner_key, outer_key)


def _contained(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Smallest dictionary id whose name contains the name, or is contained in it."""
    left, right = names.where(F.length("_norm") > 0).distinct(), dictionary.where(F.length("_dict") > 0)
    entries = right.select("_dict").distinct()
    inside = containment_candidates(entries, "_dict", left, "_norm").where(F.col("_norm").contains(F.col("_dict")))
    around = containment_candidates(left, "_norm", entries, "_dict").where(F.col("_dict").contains(F.col("_norm")))
    both = inside.select("_norm", "_dict").unionByName(around.select("_norm", "_dict"))
    return both.join(right, "_dict").groupBy("_norm").agg(F.min("_dict_id").alias("_contained_id"))


def edit_similarity(a, b):
    longest = F.greatest(F.length(a), F.length(b))
    return F.lit(1.0) - F.levenshtein(a, b) / longest


def fuzzy_match(
    names: DataFrame, name: str, dictionary: DataFrame, dict_name: str, dict_id: str, n: int = 3, cutoff: float = 0.65,
    overrides: DataFrame | None = None, wide: float | None = None,
) -> DataFrame:
    """Top ``n`` alternatives by edit similarity at or above the cutoff, the best one first.

    Two texts of similarity s differ by at most (1 - s) x length edits, so their lengths differ by
    no more than that, and (pigeonhole) cut into that many pieces plus one, a piece of the shorter
    survives unedited. Candidates therefore meet on a shared letter pair at nearly the same place,
    which loses nothing and avoids comparing every name with every entry. Cutoffs of 0.5 and below
    leave no such piece and go through an index of letters (:func:`nearest_entries`).

    ``wide``: a lower cutoff for names without a match; they stay unmatched but list alternatives.
    """
    asked = names.select(F.trim(F.col(name)).alias("name")).distinct().where("name <> ''")
    entries = dictionary.groupBy(F.trim(F.col(dict_name)).alias("entry")).agg(F.min(dict_id).alias("entry_id"))
    low = lambda c: F.lower(F.col(c))
    left = asked.withColumn("_l", low("name"))
    right = entries.withColumn("_r", low("entry"))
    texts, known = left.select("_l").distinct(), right.select("_r").distinct()

    def ranked_pairs(pairs: DataFrame) -> DataFrame:
        scored = left.join(pairs, "_l").join(right, "_r").select("name", "entry", "entry_id", "score")
        return scored.withColumn(
            "rank", F.row_number().over(Window.partitionBy("name").orderBy(
                F.desc("score"), F.desc(F.col("name") == F.col("entry")), F.col("entry"), F.col("entry_id")))
        ).where(F.col("rank") <= n)

    ranked = ranked_pairs(nearest_entries(texts, known, cutoff, n))
    best = ranked.groupBy("name").agg(
        F.min_by(F.struct("entry_id", "entry", "score"), "rank").alias("_best"),
        F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("_alts"),
    )
    joined = asked.join(best, "name", "left")
    if wide is not None:
        rest = materialize(joined.where(F.col("_best").isNull()).select(F.lower(F.col("name")).alias("_l")).distinct())
        more = ranked_pairs(nearest_entries(rest, known, wide, n)).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("_wide"))
        joined = joined.join(more, "name", "left").withColumn("_alts", F.coalesce("_alts", "_wide")).drop("_wide")
    if overrides is not None:
        joined = joined.join(overrides.select(F.col("name"), F.col("entry_id").alias("_manual")), "name", "left")
    else:
        joined = joined.withColumn("_manual", F.lit(None).cast("long"))
    score = F.col("_best.score")
    kind = (
        F.when(F.col("_manual").isNotNull(), "manual")
        .when(score.isNull(), "unmatched")
        .when(F.col("name") == F.col("_best.entry"), "exact")
        .when(F.lower("name") == F.lower(F.col("_best.entry")), "case_insensitive")
        .otherwise("fuzzy")
    )
    level = (
        F.when(kind.isin("manual", "exact"), "high").when(score >= 0.85, "high").when(score >= 0.65, "medium")
        .when(score.isNotNull(), "low").otherwise("none")
    )
    return joined.select(
        "name", F.coalesce("_manual", F.col("_best.entry_id")).alias("entry_id"), kind.alias("match_type"),
        level.alias("confidence"), score.alias("score"),
        F.transform(F.col("_alts"), lambda s: s["entry"]).alias("alternatives"),
    )


def nearest_entries(left: DataFrame, right: DataFrame, cutoff: float, n: int, steps: Sequence[float] = (0.51, 0.4, 0.3, 0.2)) -> DataFrame:
    """Pairs (_l, _r, score) that include each ``_l``'s ``n`` best entries at or above the cutoff, ties included.

    The cutoff falls in steps, and a text that has ``n`` entries at one step is done: whatever it lacks is less similar. So the low
    steps, which prune little, are left to the few texts that need them.
    """
    found, todo = None, left
    for step in [c for c in steps if c > cutoff] + [cutoff]:
        hits = materialize(_similar_pairs(todo, right, step) if step > 0.5 else _letter_pairs(todo, right, step))
        found = hits if found is None else found.unionByName(hits)
        if step > cutoff:
            enough = hits.groupBy(F.col("_l").alias("_done")).agg(F.count("*").alias("_n")).where(F.col("_n") >= n)
            todo = materialize(todo.join(enough, F.col("_l") == F.col("_done"), "left_anti"))
    # a text that went on has its earlier entries among the later ones, too
    return found.distinct()


def letter_candidates(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (_l, _r) whose similarity may reach the cutoff, by an inverted index of letters.

    A letter with its number of occurrence (the second e of a text) is a token. An edit changes one letter, so texts of similarity c
    share at least c x L tokens, L the longer length. Two texts that share t tokens share one among the first L - t + 1 of either, in
    any common order (prefix filter): here the rarest tokens come first, and only those are in the index. What meets there is counted
    out (count filter) before it is compared.
    """
    def tokens(df: DataFrame, text: str) -> DataFrame:
        letters = df.where(F.length(text) > 0).select(text, F.explode(F.split(text, "")).alias("_c")).where("_c <> ''").groupBy(text, "_c").agg(F.count("*").alias("_n"))
        return letters.select(text, F.explode(F.transform(F.sequence(F.lit(1), F.col("_n").cast("int")), lambda k: F.concat("_c", k.cast("string")))).alias("_t"))

    lt, rt = tokens(left, "_l"), tokens(right, "_r")
    often = lt.select("_t").unionByName(rt.select("_t")).groupBy("_t").agg(F.count("*").alias("_f"))

    def indexed(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
        every = df.join(often, "_t").groupBy(text).agg(F.array_sort(F.collect_list(F.struct("_f", "_t"))).alias("_all")).withColumn("_all", F.transform("_all", lambda x: x["_t"]))
        size = F.size("_all")
        first = every.select(text, F.explode(F.slice("_all", F.lit(1), size - F.ceil(size * F.lit(cutoff) - F.lit(1e-9)).cast("int") + 1)).alias("_t"))
        return every, first

    (le, lf), (re, rf) = indexed(lt, "_l"), indexed(rt, "_r")
    met = lf.join(rf, "_t").select("_l", "_r").where(F.least(F.length("_l"), F.length("_r")) >= F.greatest(F.length("_l"), F.length("_r")) * F.lit(cutoff) - F.lit(1e-9)).distinct()
    both = met.join(le.withColumnRenamed("_all", "_la"), "_l").join(re.withColumnRenamed("_all", "_ra"), "_r")
    shared = F.size(F.array_intersect("_la", "_ra"))
    return both.where(shared >= F.greatest(F.length("_l"), F.length("_r")) * F.lit(cutoff) - F.lit(1e-9)).select("_l", "_r")


def _letter_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    scored = letter_candidates(left, right, cutoff).withColumn("score", edit_similarity(F.col("_l"), F.col("_r")))
    return scored.where(F.col("score") >= cutoff - 1e-12)


def _similar_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """All pairs (_l, _r) with similarity at or above the cutoff, found through shared pieces.

    With L the longer length, at most d = floor((1 - cutoff) L) edits separate a pair. The shorter
    text cut into d + 1 pieces keeps one piece unedited, shifted by at most d places. Joining on
    (piece text, length of both) and filtering by the shift is exact: above a cutoff of 0.5 the
    shorter text always has at least d + 1 letters, so no piece is empty.
    """
    def edits(longer):
        return F.floor(longer * F.lit(1.0 - cutoff) + F.lit(1e-9)).cast("int")

    # lengths a text may be compared with: cutoff <= 1 - (longer - shorter) / longer
    def sizes(df: DataFrame, text: str) -> DataFrame:
        return df.groupBy(F.length(text).alias("_n")).agg(F.count(F.lit(1)).alias("_c"))

    l_sizes = sizes(left, "_l").select(F.col("_n").alias("_ln"))
    r_sizes = sizes(right, "_r").select(F.col("_n").alias("_rn"))
    # lengths are a bounded domain (texts of stop names); every fitting pair of lengths
    fitting = l_sizes.withColumn("_rn", F.explode(F.sequence(
        F.ceil(F.col("_ln") * cutoff).cast("int"), F.ceil(F.col("_ln") / F.lit(cutoff)).cast("int")))).join(r_sizes, "_rn")
    d = edits(F.greatest("_ln", "_rn"))
    fitting = fitting.withColumn("_d", d).withColumn("_pieces", F.col("_d") + 1)
    shorter_left = F.col("_ln") <= F.col("_rn")

    lt = left.withColumn("_ln", F.length("_l"))
    rt = right.withColumn("_rn", F.length("_r"))

    def cut(text, n, pieces):
        step = F.greatest(F.floor(n / pieces).cast("int"), F.lit(1))
        starts = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: i * step)
        return F.transform(starts, lambda s: F.struct(s.alias("at"), F.substring(text, s + 1, step).alias("piece")))

    def windows(text, n, pieces_of, pieces):
        step = F.greatest(F.floor(pieces_of / pieces).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(0), F.greatest(n - step, F.lit(0)))
        return F.transform(starts, lambda s: F.struct(s.alias("at"), F.substring(text, s + 1, step).alias("piece")))

    def meet(short: DataFrame, st: str, sn: str, long: DataFrame, lg: str, ln: str, plan: DataFrame) -> DataFrame:
        probes = short.join(plan, sn).select(st, F.col(ln).alias("_other"), "_d", F.explode(cut(F.col(st), F.col(sn), F.col("_pieces"))).alias("_p"))
        spots = long.join(plan, ln).select(lg, F.col(sn).alias("_mine"), F.col(ln).alias("_other"), F.explode(windows(F.col(lg), F.col(ln), F.col(sn), F.col("_pieces"))).alias("_q"))
        probes = probes.select(st, "_other", "_d", F.length(st).alias("_mine"), F.col("_p.at").alias("_pa"), F.col("_p.piece").alias("_piece"))
        spots = spots.select(lg, "_mine", "_other", F.col("_q.at").alias("_qa"), F.col("_q.piece").alias("_piece"))
        return probes.join(spots, ["_piece", "_mine", "_other"]).where(F.abs(F.col("_pa") - F.col("_qa")) <= F.col("_d")).select("_l", "_r")

    found = meet(lt, "_l", "_ln", rt, "_r", "_rn", fitting.where(shorter_left)).unionByName(
        meet(rt, "_r", "_rn", lt, "_l", "_ln", fitting.where(~shorter_left))
    ).distinct()
    score = edit_similarity(F.col("_l"), F.col("_r"))
    return found.withColumn("score", score).where(F.col("score") >= cutoff - 1e-12)


def key_overlap_report(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Common distinct values per key column; an empty overlap means the join cannot work."""
    parts = []
    for key in keys:
        common = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
        parts.append(common.agg(F.lit(key).alias("key"), F.count(F.lit(1)).alias("n_common")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("ok", (F.col("n_common") > 0).cast("int"))
