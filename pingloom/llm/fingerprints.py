"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph is a piece of the text that isn't blank; its digest is its 64-bit hash. Texts are cut where their words say so, not at
offsets: at line ends, and between two words whose last and first letters lie in given ranges, so an edit changes the pieces it
touches and those after it are cut as before. Pieces grow along the text, by the same rule for texts of any length: two code points
each of the first 8, words up to 32, a few words up to 256, then lines, cut about every hundred words where they are long. So short
texts have pieces, too, and versions that share two thirds of their code points share some. A sketch has three rows
of eight cells; a digest is added to one cell of each row: to the cell's count, and by exclusive or to its digest sum and check sum.
Sketches of two versions subtract cell by cell, equal paragraphs cancel, and peeling (taking out cells that hold a single digest) gives
the differing digests. If that fails, both sides are sketched again in a larger table, of as many blocks of 24 cells as their counts ask
for, each digest in the block that another hash names; a block that still fails is replaced by four, and so on.

Everything is a column expression. The one shuffle deals the texts in slices of neighbouring ids, so that each document meets the next.

Defined cases: a null text is read as empty; texts without paragraphs are alike (likeness 1); ids repeat in the order of their texts;
a null id comes last; a single document is its own successor; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Where pieces of a kind begin and what a piece is, as (first code point, one beyond the last, expression). Where no boundary comes, a
# piece ends after as many code points as its expression names; the next boundary brings both versions back in step.
_GAP = "[ \\t\\r\\n]+"
PIECES = (
    (0, 8, "(?s).{1,2}"),
    (8, 32, f"(?s)[^ \\t\\r\\n]{{1,16}}[ \\t\\r\\n]*|{_GAP}"),
    (32, 256, f"(?s).{{1,100}}?(?:(?<=[a-e]){_GAP}(?=[a-e])|\\n+|\\z)|.{{1,100}}"),
    (256, None, f"(?s).{{1,800}}?(?:(?<=[a-d]){_GAP}(?=[a-c][h-s])|\\n+|\\z)|.{{1,800}}"),
)
ROWS, WIDTH = 3, 8
CELLS = range(ROWS * WIDTH)
ROUNDS = 12  # of peeling; a table of 24 cells is peeled out in fewer or not at all
LOAD = 8  # digests a block of 24 cells is meant for when both sides are sketched again
SPLIT = 4  # blocks that replace one that still fails
LEVELS = 12

# The pieces below build SQL expressions. ``bound`` names a value so that it is evaluated once.


def bound(name: str, value: str, use: str) -> str:
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def paragraphs(text: str) -> str:
    """The distinct digests of a text's paragraphs."""
    def pieces(first: int, end: int | None, expression: str) -> str:
        part = f"substring({text}, {first + 1}, {'2147483647' if end is None else end - first})"
        literal = expression.replace("\\", "\\\\")
        return f"regexp_extract_all({part}, '({literal})', 1)"

    return f"array_distinct(transform(filter(concat({', '.join(pieces(*p) for p in PIECES)}), p -> trim(p) != ''), p -> xxhash64(p)))"


def holds(key: str, cell: int) -> str:
    """Whether a cell of the table holds a digest: three bits of the digest, others for each row."""
    return f"(shiftright({key}, {cell // WIDTH * 20}) & {WIDTH - 1}L) = {cell % WIDTH}L"


def _cell(count: str, keys: str) -> str:
    return f"struct({count} AS n, aggregate({keys}, 0L, (x, k) -> x ^ k) AS k, aggregate({keys}, 0L, (x, k) -> x ^ xxhash64(k)) AS h)"


def sketch(keys: str) -> str:
    """The 24 cells of an array of digests."""
    return f"array({', '.join(bound('m', f'filter({keys}, k -> {holds("k", c)})', _cell('size(m)', 'm')) for c in CELLS)})"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> struct(x.n - y.n AS n, x.k ^ y.k AS k, x.h ^ y.h AS h))"


def sketch_difference(a: str, b: str) -> str:
    """subtract(sketch(a), sketch(b)), cell by cell without the two sketches."""
    def cell(c: int) -> str:
        sides = f"struct(filter({a}, k -> {holds('k', c)}) AS a, filter({b}, k -> {holds('k', c)}) AS b)"
        return bound("m", sides, bound("both", "concat(m.a, m.b)", _cell("size(m.a) - size(m.b)", "both")))

    return f"array({', '.join(map(cell, CELLS))})"


def peel(cells: str) -> str:
    """The differing digests with the side they come from (1 or -1); null if cells are left that hold several."""
    single = "array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 AND c.h = xxhash64(c.k)), c -> struct(c.n AS n, c.k AS k)))"

    def less(i: int) -> str:
        out = "struct(aggregate(m, get(s.cells, {i}).n, (x, p) -> x - p.n) AS n, aggregate(m, get(s.cells, {i}).k, (x, p) -> x ^ p.k) AS k, aggregate(m, get(s.cells, {i}).h, (x, p) -> x ^ xxhash64(p.k)) AS h)"
        return bound("m", f"filter(pure, p -> {holds('p.k', i)})", f"if(size(m) = 0, get(s.cells, {i}), {out.format(i=i)})")

    onward = f"struct(array({', '.join(map(less, CELLS))}) AS cells, concat(s.found, pure) AS found, true AS on)"
    step = f"if(s.on, {bound('pure', single, f'if(size(pure) = 0, struct(s.cells AS cells, s.found AS found, false AS on), {onward})')}, s)"
    start = f"struct({cells} AS cells, cast(array() AS array<struct<n:int,k:bigint>>) AS found, true AS on)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, _round) -> {step}, s -> if(exists(s.cells, c -> c.n != 0 OR c.k != 0 OR c.h != 0), NULL, s.found))"


def _split(group: str, parts: str, seed: str, name: str) -> str:
    """A pair of digest arrays dealt into ``parts`` pairs by another hash of the digest."""
    deal = lambda side: f"filter({group}.{side}, k -> pmod(xxhash64(k, {seed}), {parts}) = {name}) AS {side}"
    return f"transform(sequence(0, {parts} - 1), {name} -> struct({deal('a')}, {deal('b')}))"


def larger(a: str, b: str) -> str:
    """How many digests differ, by a table of as many blocks as both sides need; what fails there is retried larger, block by block."""
    # dealt in two steps, so that a long array isn't searched once for every block
    groups = f"flatten(transform({_split('w.whole', 'w.coarse', '1', 'p')}, g -> {_split('g', 'w.fine', '2', 'q')}))"
    blocks = f"cast(ceil((size({a}) + size({b})) / {LOAD}) AS int)"
    coarse = bound("n", blocks, "struct(n AS n, least(n, 64) AS coarse)")
    sized = bound("c", coarse, f"struct(struct({a} AS a, {b} AS b) AS whole, c.coarse AS coarse, cast(ceil(c.n / c.coarse) AS int) AS fine)")
    tried = f"transform(s.rest, g -> struct(cast(size({peel(sketch_difference('g.a', 'g.b'))}) AS bigint) AS n, g AS g))"
    rest = f"flatten(transform(filter(results, r -> r.n IS NULL), r -> {_split('r.g', str(SPLIT), 'level + 2', 'p')}))"
    after = f"struct(aggregate(results, s.n, (x, r) -> x + coalesce(r.n, 0L)) AS n, {rest} AS rest)"
    start = f"struct(0L AS n, {bound('w', sized, groups)} AS rest)"
    return f"aggregate(sequence(1, {LEVELS}), {start}, (s, level) -> if(size(s.rest) = 0, s, {bound('results', tried, after)}), s -> if(size(s.rest) = 0, s.n, NULL))"


def differing(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """How many digests are in only one of two arrays: from their sketches, or from larger ones if that fails."""
    return f"coalesce(cast(size({peel(subtract(cells_a, cells_b))}) AS bigint), {larger(a, b)})"


def likeness(cells_a: str, cells_b: str, diff: str) -> str:
    """Jaccard likeness of two sets of digests, from their sizes and the number of differing ones."""
    held = lambda cells: f"aggregate(slice({cells}, 1, {WIDTH}), 0L, (x, c) -> x + c.n)"
    both = f"{held(cells_a)} + {held(cells_b)}"
    return bound("both", both, f"if(both = 0, 1.0D, cast(both - {diff} AS double) / (both + {diff}))")


def text_form(cells: str) -> str:
    return f"array_join(transform({cells}, c -> if(c.n = 0, '', concat_ws('.', c.n, hex(c.k), hex(c.h & 4294967295L)))), ',')"


def _slice_of(key: Column, bounds: list[int]) -> Column:
    """In which slice a key falls: a search in two steps over the sorted upper bounds."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    if not bounds:
        return F.lit(0)
    firsts = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    nested = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    coarse = F.size(F.filter(firsts, lambda x: x <= key))
    fine = F.size(F.filter(F.coalesce(F.get(nested, coarse - 1), F.array().cast("array<bigint>")), lambda x: x <= key))
    return (F.greatest(coarse - 1, F.lit(0)) * step + fine).cast("int")


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text, keys, cells, next text, keys and cells): each document with the one that follows by descending id, the first after the last.

    Ids are cut into slices at quantiles, four a shuffle partition; a slice is sorted in one task. The first document of each slice is
    copied to the slice before it, where only its predecessor looks at it.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("ord", F.coalesce("id", F.lit(low)))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = base.select("ord")
    cuts = ids.agg(F.percentile_approx("ord", [i / n for i in range(1, n)], 10 * n).alias("c")).first()["c"] or []
    cut = _slice_of(F.col("ord"), sorted(set(cuts)))
    tops = ids.select("ord", cut.alias("s")).groupBy("s").agg(F.max("ord").alias("top")).collect()  # a row a slice, at most n
    tops = sorted(((r["s"], r["top"]) for r in tops), reverse=True)  # in the order of descending ids
    before = [(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)]  # the slice that needs to see this first document
    ghosts = spark.createDataFrame(before, "top long, to int")
    # a ghost is a copy that only its predecessor looks at; it comes last in its slice
    # at most four rows a shuffle partition, of 12 bytes each
    placed = base.join(F.broadcast(ghosts), F.col("ord") == F.col("top"), "left").withColumn("own", cut)
    places = F.expr("filter(array(struct(own AS s, false AS ghost), struct(`to` AS s, true AS ghost)), x -> x.s IS NOT NULL)")
    both = placed.select("id", "text", "ord", F.explode(places).alias("p")).select("id", "text", "ord", "p.*").withColumn("keys", F.expr(paragraphs("text"))).withColumn("cells", F.expr(sketch("keys")))
    # a stable order among rows of one id
    w = Window.partitionBy("s").orderBy("ghost", F.desc("ord"), F.xxhash64("text"), "text")
    # plain columns: an expression here would be shuffled beside the text it is made of
    led = both.withColumns({"next_text": F.lead("text").over(w), "next_keys": F.lead("keys").over(w), "ncells": F.lead("cells").over(w)})
    return led.where(~F.col("ghost")).select("id", "text", "keys", "cells", "next_text", "next_keys", "ncells")


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text whose last third is replaced by the beginning of the next document."""
    rows = with_next(docs, "doc_id", "text").withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    rows = rows.withColumn("ekeys", F.expr(paragraphs("edited"))).withColumn("sha", F.sha2("edited", 256)).drop("text", "next_text", "edited")
    rows = rows.selectExpr("*", f"{sketch('ekeys')} AS ecells")
    rows = rows.selectExpr("*", f"{differing('keys', 'ekeys', 'cells', 'ecells')} AS de", f"{differing('keys', 'next_keys', 'cells', 'ncells')} AS dn")
    return rows.selectExpr("id AS doc_id", "n_chars", "sha AS edited_sha256", f"{text_form('cells')} AS fingerprint", f"{text_form('ecells')} AS edited_fingerprint", f"{likeness('cells', 'ecells', 'de')} AS near_edited", f"{likeness('cells', 'ncells', 'dn')} AS near_next")
