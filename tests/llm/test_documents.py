"""Fingerprints, near duplicates, mixing, packing and the quality classifier against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pingloom.llm import fingerprints, mixing, neardup, packing, quality

W = [a + b for a in "bcdfghklmnprst" for b in ("a", "e", "in", "or", "ut", "ish", "and")]


def prose(rng, n):
    return " ".join(rng.choice(W) + rng.choice(W) for _ in range(n))


def paragraphs(t):
    gap = r"[ \t\r\n]+"
    found = re.findall(r"(?s).{1,2}", t[:8]) + re.findall(rf"[^ \t\r\n]{{1,16}}[ \t\r\n]*|{gap}", t[8:32])
    found += re.findall(rf"(?s).{{1,100}}?(?:(?<=[a-e]){gap}(?=[a-e])|\n+|\Z)|.{{1,100}}", t[32:256])
    found += re.findall(rf"(?s).{{1,800}}?(?:(?<=[a-d]){gap}(?=[a-c][h-s])|\n+|\Z)|.{{1,800}}", t[256:])
    return {p for p in found if p.strip(" ")}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints_against_sets(docs_of, odd_texts):
    rng = random.Random(1)
    texts = [*odd_texts, *("\n".join(prose(rng, 12) for _ in range(rng.choice([1, 3, 9, 40]))) for _ in range(25))]
    texts += [texts[-1], "\n".join(f"line {i}" for i in range(3000)), "\U0001f600" * 7]
    docs = docs_of(texts, extra=["keys", "cells", "s"])
    got = {r["doc_id"]: r for r in fingerprints.report(docs).collect()}
    order = sorted(range(len(texts)), reverse=True)
    known = {}
    for at, i in enumerate(order):
        t, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        k = len(t) // 3
        edited = t[:len(t) - k] + following[:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(jaccard(paragraphs(t), paragraphs(edited)))
        assert r["near_next"] == pytest.approx(jaccard(paragraphs(t), paragraphs(following)))
        assert known.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        if edited == t:
            assert r["fingerprint"] == r["edited_fingerprint"]
    assert len(set(known.values())) >= len(known) - 1  # empty and blank texts have no paragraph
    assert fingerprints.report(docs.limit(0)).count() == 0
    one = fingerprints.report(docs.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0


def test_versions_that_share_text_share_pieces(docs_of):
    """Two thirds of any text in common are seen; an insertion at the start changes what is near it, not the rest of a long line."""
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (1, 1, 2, 3, 5, 9, 20, 60, 200, 3000)] + ["abc", "abcd", "word"]
    for r in fingerprints.report(docs_of(texts)).collect():
        assert r["near_edited"] > 0, r
    line = prose(rng, 4000)
    base = paragraphs(line)
    for changed in ("x" + line, "two words " + line, line[:9000] + "q" + line[9000:]):
        assert len(base - paragraphs(changed)) <= 22 and len(base & paragraphs(changed)) > 0.7 * len(base)


def test_fingerprints_with_ids_null_and_repeated(spark):
    docs = spark.createDataFrame([(None, "null id"), (5, "five a"), (5, "five b"), (9, None)], "doc_id long, text string")
    rows = fingerprints.report(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["5", "5", "9", "None"]


def shingles(t):
    w = (t or "").lower().split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def similarity(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def groups(texts, threshold=0.8):
    bags = [shingles(t) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= threshold:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(W) + "x"
    return " ".join(w)


def test_near_duplicate_groups_equal_brute_force(docs_of, odd_texts):
    rng = random.Random(2)
    texts = [t for t in odd_texts if t is None or len(t) < 10_000]
    for _ in range(12):
        base = prose(rng, rng.choice([30, 120, 300]))
        texts += [base, base.upper(), *(edited(rng, base, rng.choice([1, 2, 4, 9])) for _ in range(5))]
    # a chain whose ends differ, and one large group of copies of one text, so that buckets are split around leaders
    chain = prose(rng, 200)
    for _ in range(12):
        texts.append(chain)
        chain = edited(rng, chain, 2)
    big = prose(rng, 260)
    texts += [edited(rng, big, rng.choice([1, 3, 5])) for _ in range(90)]
    docs = docs_of(texts, extra=["bands", "rid", "kept"])
    s = neardup.Settings(outer=7, inner=9)
    rows = {r["doc_id"]: r for r in neardup.report(docs, s).collect()}
    want = groups(texts)
    assert {i: rows[i]["group_id"] for i in rows} == dict(enumerate(want))
    assert [i for i in rows if rows[i]["kept"]] and sorted(i for i in rows if rows[i]["kept"]) == sorted(set(want))
    kept = neardup.distinct(docs, s)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert neardup.report(docs.limit(0)).count() == 0


def test_near_duplicates_with_ids_null_and_repeated(spark):
    docs = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (3, "other words stand here in it")], "doc_id long, text string")
    rows = neardup.report(docs).collect()
    assert sorted((r["group_id"], r["kept"]) for r in rows) == [(3, True), (7, False), (7, False), (7, True)]


def test_signatures_estimate_the_weighted_jaccard():
    rng = random.Random(3)
    errors = []
    for k in range(40):
        a = prose(rng, 60).split()
        b = list(a)
        for _ in range(k % 9):
            b[rng.randrange(60)] = "zz"
        a, b = " ".join(a + a[:9] * (k % 4 * 3)), " ".join(b + b[:9] * 4)
        d, h, w, _ = neardup.shingles(pa.array([a, b], pa.large_string()), 5)
        assert neardup.overlap(a, b, 5) == pytest.approx(similarity(shingles(a), shingles(b)))
        r = neardup.signatures(d, h, w, 2, 1000)
        errors.append((r[0] == r[1]).mean() - similarity(shingles(a), shingles(b)))
    assert abs(np.mean(errors)) < 0.012 and max(map(abs, errors)) < 0.07


def test_mixing_meets_its_targets(spark, odd_texts):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(5, 60)), rng.choice(["en", "en", "en", "de", None]), rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(1500)]
    rows += [(2000 + i, t, "en", "a") for i, t in enumerate(odd_texts) if t is None or len(t) < 1000]
    docs = spark.createDataFrame([(*r, "t", "w") for r in rows], "doc_id long, text string, lang string, source string, tokens string, weight string")
    s = mixing.Settings()
    p = mixing.report(docs, s).toPandas()
    assert len(p) == len(rows)
    p["mass"], p["tokens"] = p["weight"] * p["tokens"], p["tokens"].astype(float)
    for by, power in (("source", s.source_power), ("lang", s.lang_power), ("topic", s.topic_power)):
        seen = p[p["tokens"] > 0].fillna({by: "?"}).groupby(by)
        target = seen["tokens"].sum() ** power
        pd.testing.assert_series_equal(seen["mass"].sum(), target / target.sum(), check_names=False, rtol=1e-4)
    assert p["probability"].max() == pytest.approx(1.0) and (p.loc[p["tokens"] == 0, "kept"] == False).all()  # noqa: E712
    expected = (p["probability"] * p["tokens"]).sum()
    assert abs(p.loc[p["kept"], "tokens"].sum() / expected - 1) < 0.1
    kept = mixing.sample(docs, s)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(p.loc[p["kept"], "doc_id"])
    assert mixing.report(docs.limit(0)).count() == 0


def test_a_tiny_category_changes_nothing_in_how_much_is_kept(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randrange(20, 60)), rng.choice(["en", "en", "en", "de"]), rng.choice(["hot"] * 8 + ["a", "b"])) for i in range(1200)]
    tiny = [(5000, "five words of its own", "xx", "tiny")]
    schema, s = "doc_id long, text string, lang string, source string", mixing.Settings()
    shares, hot = [], []
    for part in (rows, rows + tiny):
        p = mixing.report(spark.createDataFrame(part, schema), s).toPandas()
        assert (p["probability"] * p["tokens"]).sum() / p["tokens"].sum() == pytest.approx(s.budget, rel=1e-6)
        assert p["probability"].max() <= 1 and (p["doc_id"] < 5000).sum() == 1200
        shares.append(p.loc[p["kept"], "tokens"].sum() / p["tokens"].sum())
        hot.append((p["source"].eq("hot") & p["kept"]).sum())
    assert shares[1] == pytest.approx(shares[0], abs=0.01) and abs(hot[1] / hot[0] - 1) < 0.02
    assert p.set_index("doc_id").loc[5000, "probability"] == 1.0
    # what can be met is met; what can't is said
    seen = mixing.targets(spark.createDataFrame(rows + tiny, schema), s).toPandas().set_index(["margin", "category"])
    assert not seen.loc[("source", "tiny"), "met"] and seen.loc[("source", "tiny"), "reached"] < seen.loc[("source", "tiny"), "target"]
    assert seen.groupby("margin")["reached"].sum().to_numpy() == pytest.approx([1, 1, 1]) and len(seen) == 4 + 3 + 8


def test_capped_factors():
    rng = np.random.default_rng(3)
    mass, u = rng.integers(0, 4, (200, 12)) * rng.random((200, 12)), rng.random(12) + 0.01
    mass = mass[mass.sum(1) > 0]
    wanted = mass.sum(1) * rng.choice([0.1, 0.5, 0.9, 1.0], len(mass))
    f = mixing._capped(mass, wanted, u)
    assert np.allclose((mass * np.minimum(1, f[:, None] * u)).sum(1), wanted)
    assert mixing._shared(np.array([10.0, 1.0, 5.0]), np.array([0.5, 0.4, 0.1]), 8.0) == pytest.approx([35 / 6, 1, 7 / 6])


def fewest(sizes, capacity):
    """A bound no packing can beat: items over half a bin need bins of their own, and small items only what room those leave."""
    best = -(-sum(sizes) // capacity)
    for least in {n for n in sizes if 2 * n <= capacity} | {0}:
        alone = sum(n > capacity - least for n in sizes)
        large = [n for n in sizes if capacity - least >= n > capacity / 2]
        small = sum(n for n in sizes if least <= n <= capacity / 2)
        best = max(best, alone + len(large) + max(0, -(-(small - (len(large) * capacity - sum(large))) // capacity)))
    return best


def best_fit_check(sizes, capacity):
    where, place, fill = packing.best_fit(np.array(sizes), capacity)
    at = collections.defaultdict(list)
    for i, b in enumerate(where.tolist()):
        at[b].append((int(place[i]), sizes[i]))
    for b, items in at.items():
        end = 0
        for a, n in sorted(items):
            assert a == end
            end += n
        assert end == fill[b] <= capacity
    return len(fill)


def test_best_fit():
    assert best_fit_check([5, 5, 4, 3, 3], 10) == 2
    rng = random.Random(5)
    sizes = [rng.choice([1, 7, 300, 900, 2048, rng.randrange(1, 2049)]) for _ in range(3000)]
    # best fit of items in descending order needs at most 11/9 of the fewest bins and one more; with many small items hardly any more
    assert best_fit_check(sizes, 2048) <= 11 / 9 * fewest(sizes, 2048) + 1
    small = [rng.randrange(1, 700) for _ in range(3000)]
    assert best_fit_check(small, 2048) <= 1.005 * fewest(small, 2048) + 1


ODD_WORDS = ["It's  We'LL don’t 'S x's", "x<|endoftext|>y", "<|ENDOFTEXT|>", "日本語１２３ ①\xbd a_b--", "a\x1cb\x85c d", "\U0001f600‍", "İ̇ ΣΣ"]


def test_packing_is_exact(docs_of, odd_texts):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [*odd_texts, *ODD_WORDS, *(prose(rng, rng.choice([2, 50, 700, 2500])) for _ in range(40))]
    docs = docs_of(texts, extra=["piece", "row", "offset", "item"])
    rows = packing.pack(docs, "text", ["doc_id"]).toPandas()
    plain = Tokenizer.from_file(packing.vocabulary())
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        got = rows[rows["doc_id"] == i].sort_values("piece")
        want = [(k, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert [tuple(x) for x in got[["piece", "start", "length", "ids_crc32"]].itertuples(index=False)] == want
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    assert packing.pack(docs.limit(0), "text", ["doc_id"]).count() == 0
    full = packing.pack(docs_of(["one two", "three"]), ids=True)
    assert {r["doc_id"]: list(r["ids"]) for r in full.collect()} == {i: [*plain.encode(t).ids, 0] for i, t in enumerate(["one two", "three"])}


def test_packing_up_the_tree(spark):
    rng = random.Random(7)
    sizes = [rng.choice([30, 200, 700, 1100, rng.randrange(1, 2049)]) for _ in range(4000)]
    placed = spark.createDataFrame(list(enumerate(sizes)), "row long, length long")
    got = packing.assign(placed, "row", "length", 2048, group_items=300).join(placed, "row").toPandas()
    assert len(got) == len(sizes)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= 11 / 9 * fewest(sizes, 2048) + 1
    # what groups as small as 300 items cost against one group: 1221 sequences against 1193
    whole = packing.assign(placed, "row", "length", 2048).select("sequence_id").distinct().count()
    assert got["sequence_id"].nunique() <= 1.03 * whole


def test_items_that_never_fit_together_end_the_tree(spark):
    placed = spark.createDataFrame([(i, 1100 + i % 7) for i in range(500)], "row long, length long")
    got = packing.assign(placed, "row", "length", 2048, group_items=50).toPandas()
    assert len(got) == 500 and got["sequence_id"].nunique() == 500 and not got["offset"].any()


def test_quality_learns_and_holds_out(spark, docs_of, odd_texts):
    rng = random.Random(8)
    good = [prose(rng, rng.randrange(20, 80)) for _ in range(300)]
    bad = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(rng, 40).split()) for _ in range(150)] + [" ".join([w] * 12 + [w]) for w in (rng.choice(W) * 2 for _ in range(150))]
    texts = [*good, *bad, *odd_texts]
    docs = docs_of(texts, extra=["score", "lid", "h", "y"])
    marks = [(i, int(i < 300), 0) for i in range(600)] + [(9999, 1, 0), (None, 0, 0), (3, None, 0), (4, 7, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    p = quality.report(docs, labels).toPandas().set_index("doc_id")
    assert len(p) == len(texts) and p["score"].between(0, 1).all() and (p["predicted"] == (p["score"] >= 0.3)).all()
    assert [bool(p.loc[i, "held_out"]) for i in range(50)] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)]
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p.loc[i, "predicted"] == int(i < 300) for i in held]) >= 0.95
    # labels of the held-out part change nothing
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.report(docs, other).toPandas().set_index("doc_id")["score"].equals(p["score"])
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(p.index[p["predicted"] == 1])
    none = quality.report(docs, labels.limit(0)).toPandas()
    assert (none["score"] == 0.5).all() and quality.report(docs.limit(0), labels).count() == 0


def test_quality_passes_over_texts_that_do_not_fit(spark, docs_of, monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng, 30) if i % 2 else " ".join(w + "###" for w in prose(rng, 30).split()) for i in range(200)]
    marks = [(i, i % 2, 0) for i in range(200)]
    order = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    firsts = [r[0] for r in order.where(~quality.held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.lit(17), "doc_id", "quality")).limit(3).select("doc_id").collect()]
    s = quality.Settings(max_chars=150_000)
    long = {firsts[0]: 150_001, firsts[1]: 90_000, firsts[2]: 90_000}  # one that never fits, one that does, one that no longer does
    texts = [(t + " ") * (long[i] // len(t) + 1) if i in long else t for i, t in enumerate(texts)]
    texts = [t[:long[i]] if i in long else t for i, t in enumerate(texts)]
    seen = []
    plain = quality.train
    monkeypatch.setattr(quality, "train", lambda texts, labels, s: seen.append((list(texts), list(labels))) or plain(texts, labels, s))
    p = quality.report(docs_of(texts), order, s).toPandas().set_index("doc_id")
    ((learned, labels),) = seen
    usable = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 and i not in (firsts[0], firsts[2])]
    assert sorted(learned) == sorted(texts[i] for i in usable) and sum(map(len, learned)) <= s.max_chars
    assert labels == [texts.index(t) % 2 for t in learned]
    assert set(p["predicted"]) == {0, 1} and (p["score"] != 0.5).any()


def test_extra_columns_may_have_any_name(docs_of):
    extra = ["ca", "cb", "first_id", "first_rid", "_at", "row", "at", "rid", "comp", "fc", "class_a", "bands", "item"]
    docs = docs_of(["one two three four five six"] * 3 + ["another text", None], extra=extra)
    assert sorted(r["doc_id"] for r in neardup.distinct(docs).collect()) == [0, 3, 4]
    assert neardup.distinct(docs).columns == docs.columns
    packed = packing.pack(docs)
    assert set(extra) <= set(packed.columns) and packed.count() == 5


def test_a_language_column_that_is_not_clean(spark):
    """Any number of languages: those with the most words are raked each, the others together, and no row is lost."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 40), "en" if i % 2 else "de" if i % 4 else f"x{i}", f"s{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.report(docs, mixing.Settings(languages=2)).toPandas()
    assert len(out) == 400 and (out["probability"] > 0).all()
    few = out[out["lang"].str.startswith("x")]
    assert len(few) == 100 and abs((out["tokens"] * out["probability"]).sum() / out["tokens"].sum() - 2 / 3) < 1e-3
    share = {c: g["tokens"].sum() / out["tokens"].sum() for c, g in out.groupby(out["lang"].where(~out["lang"].str.startswith("x"), "~"))}
    want = {c: v ** 0.8 for c, v in share.items()}
    got = {c: (g["tokens"] * g["weight"]).sum() / out["tokens"].sum() for c, g in out.groupby(out["lang"].where(~out["lang"].str.startswith("x"), "~"))}
    scale = sum(got.values())
    assert all(abs(got[c] / scale - want[c] / sum(want.values())) < 1e-3 for c in want)


def test_the_sketch_of_the_next_document_comes_with_it(spark):
    from pingloom.llm import fingerprints

    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 11}" for j in range(3 * i))) for i in range(40)] + [(7, "twice"), (None, "no id")], "doc_id long, text string")
    rows = fingerprints.with_next(docs, "doc_id", "text")
    same = rows.selectExpr(f"cells = {fingerprints.sketch('keys')} AND ncells = {fingerprints.sketch('next_keys')} AS same").collect()
    assert len(same) == 42 and all(r["same"] for r in same)
