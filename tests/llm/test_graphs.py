"""Manifest trees, conversation tries and embedding links against plain computations."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingloom.llm import merkle, metric, trie

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, names=("doc_id", "source", "lang", "n_chars", "text")):
    return H(*("-" if row[n] is None else f"{len(str(row[n]).encode())}:{row[n]}" for n in names))


def grown(nodes):
    """All levels of a tree of threes."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k:k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def proof(levels, at):
    out = []
    for level in levels[:-1]:
        a = at // 3 * 3
        out.append(("".join(level[a:at]), "".join(level[at + 1:a + 3])))
        at //= 3
    return out


def expected(rows):
    order = lambda s: (s is not None, (s or "").encode())
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {s: grown([leaf(r) for r in g]) for s, g in groups.items()}
    sources = sorted(groups, key=order)
    above = grown([trees[s][-1][0] for s in sources])
    root = above[-1][0]
    out = []
    for s in sources:
        for k, r in enumerate(groups[s]):
            path = proof(trees[s], k) + proof(above, sources.index(s))
            claim = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                claim["text"] = r["text"].replace("\n", "")
            node = leaf(claim)
            for a, b in path:
                node = H(a, node, b)
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], root, H(*(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


FIELDS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(frame):
    return sorted((tuple(r[c] for c in FIELDS) for r in frame.collect()), key=str)


def doc_rows(n, seed=3):
    rng = np.random.default_rng(seed)
    sources = ["hot"] * 5 + ["b", "ü", None, "", "one row"]
    rows = []
    for i in range(n):
        text = [None, "", "a\nb\n", "é\n" * 50, "x" * 30_000, f"line {i}"][int(rng.integers(0, 6))]
        rows.append({"doc_id": int(rng.integers(-5, n * 2)), "text": text, "lang": None if i % 7 == 0 else "en", "source": sources[int(rng.integers(0, 9))], "n_chars": None if i % 11 == 0 else i})
    rows += [dict(rows[0])] * 4 + [{**rows[1], "doc_id": None}, {**rows[2], "doc_id": None}, {**rows[3], "source": "one row"}]
    return rows


def docs_frame(spark, rows, extra=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")), *("x" for _ in extra)) for r in rows], schema)


@pytest.mark.parametrize("band", [1, 2, 6])
def test_manifest_proofs(spark, band):
    rows = doc_rows(400)
    docs = docs_frame(spark, rows, ("hash", "lo", "grp", "total", "level", "key"))
    got = found(merkle.report(docs, merkle.Settings(band=band)))
    assert got == expected(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_small(spark):
    rows = doc_rows(4)[:1]
    docs = docs_frame(spark, rows)
    assert found(merkle.report(docs)) == expected(rows)
    assert merkle.report(docs.limit(0)).collect() == [] and merkle.manifest(docs.limit(0)).count() == 0
    same = [dict(rows[0])] * 10
    assert found(merkle.report(docs_frame(spark, same))) == expected(same)


def test_manifest_nodes_nest(spark):
    rows = doc_rows(300)
    nodes = merkle.manifest(docs_frame(spark, rows), s=merkle.Settings(band=2)).collect()
    assert len({(n["tree"], n["level"], n["lo"]) for n in nodes}) == len(nodes)
    tree = [n for n in nodes if n["tree"] and n["tree"]["source"] == "hot"]
    n = sum(r["source"] == "hot" for r in rows)
    for level in range(1, max(t["level"] for t in tree) + 1):
        for t in (x for x in tree if x["level"] == level):
            inside = sorted((x for x in tree if x["level"] == level - 1 and t["lo"] <= x["lo"] and x["hi"] <= t["hi"]), key=lambda x: x["lo"])
            assert 1 <= len(inside) <= 3 and t["hash"] == H(*(x["hash"] for x in inside))
    assert max(t["hi"] for t in tree) == n


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), key, role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + ts[h:]
    return out


def expected_trie(rows):
    convs = rebuilt(rows)
    members, ends = {}, {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
        ends.setdefault(tuple(ts), []).append(c)
    kids, order = {}, sorted(members, key=len, reverse=True)
    leaves, saved = {}, {}
    for p in order:
        kids.setdefault(p, 0)
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            up = p[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[p]
            saved[up] = saved.get(up, 0) + saved[p]
    return sorted((min(members[p]), len(p), min(members[p[:-1]]) if p else -1, len(members[p]), kids[p], leaves[p], saved[p], H(",".join(map(str, sorted(ends.get(p, [])))))) for p in members)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(frame):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in TRIE) for r in frame.collect())


def conversation_rows(n, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(-3, n):
        for t in range(int(rng.integers(1, 7)) if c != 7 else 60):
            rows.append((c * 3, t, [None, "user", "assistant"][int(rng.integers(0, 3))], [None, "", "hi", "é" * 9][int(rng.integers(0, 4))]))
    rows += [(300, 0, "user", "hi")] * 3 + [(None, 1, "user", "lost"), (600, None, "user", "no number"), (600, None, None, None), (9, 2, "a", "b")]
    # copies of one conversation
    rows += [(1000 + k, t, "user", f"same {t}") for k in range(150) for t in range(3)]
    return rows


def conversations_frame(spark, rows, extra=""):
    return spark.createDataFrame([(*r, *("x" for _ in extra.split(",") if _)) for r in rows], "conv_id long, turn long, role string, text string" + extra)


@pytest.mark.parametrize("s", [trie.Settings(), trie.Settings(slice=4, block=16, chunk=8)])
def test_conversation_trie(spark, s):
    rows = conversation_rows(150)
    frame = conversations_frame(spark, rows, ", depth string, member string, conv string, size string").repartition(3)
    assert found_trie(trie.report(frame, s)) == expected_trie(rows)


def test_conversation_trie_small(spark):
    one = [(5, 0, "user", "a")]
    assert found_trie(trie.report(conversations_frame(spark, one))) == expected_trie(one)
    assert trie.report(conversations_frame(spark, one).limit(0)).collect() == []
    same = [(5, 0, "user", "a" * 10_000)] * 30
    assert found_trie(trie.report(conversations_frame(spark, same), trie.Settings(slice=2, block=4, chunk=4))) == expected_trie(same)


@pytest.mark.parametrize("local", [True, False])
def test_list_sums(spark, local):
    """A list along its numbers contracts; one that jumps about is ranked by pointer jumping."""
    n = 500
    order = np.arange(n) if local else np.random.default_rng(1).permutation(n)
    weight = np.arange(n) ** 2 % 17
    rows = [(int(order[k]), int(order[k + 1]) if k + 1 < n else None, int(weight[k])) for k in range(n)]
    got = {r["id"]: r["w"] for r in trie.list_sums(spark.createDataFrame(rows, "id long, next long, w long"), ["w"], 8).collect()}
    assert got == {int(order[k]): int(weight[k:].sum()) for k in range(n)}


def expected_links(rows, threshold=0.95):
    """By comparing all pairs."""
    fine = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for d in {len(v) for (_, v), f in zip(rows, fine) if f}:
        at = [k for k in range(n) if fine[k] and len(rows[k][1]) == d]
        x = np.array([rows[k][1] for k in at], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        link[np.ix_(at, at)] = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    comp, name = np.full(n, -1), {}
    for k in range(n):
        if comp[k] < 0:
            edge = [k]
            comp[k] = k
            while edge:
                new = [j for j in np.flatnonzero(link[edge].any(0)) if comp[j] < 0]
                comp[new] = k
                edge = new
            ids = [rows[j][0] for j in np.flatnonzero(comp == k) if rows[j][0] is not None]
            name[k] = min(ids, default=None)
    return sorted(((rows[k][0], int(link[k].sum()), name[comp[k]], name[comp[k]] is None or rows[k][0] == name[comp[k]]) for k in range(n)), key=str)


def found_links(frame):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in frame.collect()), key=str)


def vector_rows(n, dim, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = lambda v, by: v + by * rng.normal(size=dim) / np.sqrt(dim)
    rows = [near(base[0], 0.08) for _ in range(n // 3)]  # a third of all: near copies
    rows += [base[1]] * (n // 10)  # copies
    rows += [near(base[0], 0.45) for _ in range(n // 5)]  # some reach some of them
    at = base[2]
    for _ in range(n // 10):  # a chain, whose ends are far apart
        at = near(at, 0.25)
        rows.append(at)
    rows += list(base[3:])
    out = [(int(i), [float(x) for x in v * rng.uniform(0.1, 9)]) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]
    odd = [(5001, None), (5002, [0.0] * dim), (5003, [float("nan")] * dim), (5004, [None] * dim), (5005, []), (5006, [float("inf")] + [1.0] * (dim - 1)), (5007, [1.0, 2.0]), (5008, [2.0, 4.1]), (None, [3.0, 6.0]), (None, [0.0]), (5009, [-7.0]), (5010, [-0.5]), (5011, [2.0])]
    return [*out, *odd, *out[:6]]


@pytest.mark.parametrize("dim,s", [(4, metric.Settings(rows=40, group=2, columns=16)), (24, metric.Settings(rows=64, group=3, columns=64, dense=30)), (24, metric.Settings()), (8, metric.Settings(rows=50, pivots=6, sample=60, dense=4))])
def test_metric_range_join(spark, dim, s):
    rows = vector_rows(300, dim)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, rid string, comp string").repartition(4)
    got = found_links(metric.report(frame, s))
    assert got == expected_links(rows)
    assert max(r[1] for r in got) > 100


def test_metric_range_join_small(spark):
    rows = [(3, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found_links(metric.report(frame)) == expected_links(rows) == sorted([(3, 1, 1, False), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=str)
    assert metric.report(frame.limit(0)).collect() == []
    assert found_links(metric.report(frame.where("embedding is null"))) == [(None, 0, None, True)]


def test_a_core_is_counted_not_compared(spark):
    """Of a group of copies the units get nothing, and the pairs returned grow with its rows."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.r_[1.0, 0.01 * rng.normal(size=15)]]) for i in range(2000)]
    rows += [(5000 + i, [float(x) for x in rng.normal(size=16)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "rid long, vec array<double>")
    counts, pairs = metric.links(frame, metric.Settings(rows=100))
    assert {(r["rid"], r["n_links"]) for r in counts.collect()} == {(i, 1999) for i in range(2000)}
    assert pairs.count() == 1999
