"""Archives, neighbours, the pipeline and the registered queries."""

import base64
import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check_oracle import TABLES, compare
from pingloom.llm import ann, neardup, queries, warc

SF = "/root/testdata/sf0.001"


def base32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.fixture
def ranges(spark):
    """Read files in ranges far smaller than a record."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 666\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_archives_round_trip(spark, ranges, tmp_path):
    bodies = [None, "", "plain", "plain", FAKE, f"before {FAKE} after {FAKE * 3}", "é" * 900, "WARC/1.1\r\n" * 40, "x" * 5000, f"\r\n\r\n{FAKE}", "last"]
    rows = [(i * 3, f"http://a.com/{i}\r\nX: y" if i == 2 else None, b, "extra") for i, b in enumerate(bodies)] + [(None, "u", "plain", "n"), (6, "again", "plain", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, body string").repartition(2)
    folder = str(tmp_path / "warc")
    got = warc.report(pages, folder).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    by_id = {r["page_id"]: r for r in got if r["page_id"] != 6}
    first = {}
    for page, _, b, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(b or "", page)
    for page, _, b, _ in rows:
        if page == 6:
            continue
        data = (b or "").encode()
        leader = first[b or ""]
        r = by_id[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base32(data))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if leader == page else ("revisit", leader))
    assert [r["record_type"] for r in got if r["page_id"] == 6] == ["response"] * 2
    read = {(r["page_id"], r["record_type"]): r for r in warc.read(spark, folder, payload=True).collect()}
    for page, _, b, _ in rows:
        if page in by_id and by_id[page]["record_type"] == "response":
            assert bytes(read[page, "response"]["payload"]) == (b or "").encode()


def test_archives_cut_anew_between_two_readings(spark, tmp_path, monkeypatch):
    """Executors come and go, and with them the ranges a file is read in: the second reading needn't have those of the first."""
    bodies = [f"{FAKE}{'z' * (i % 90)}{FAKE}{i}" if i % 3 == 0 else f"plain {i}" for i in range(300)]
    pages = spark.createDataFrame([(i, "u", b) for i, b in enumerate(bodies)], "page_id long, url string, html string").coalesce(2)
    old, cuts = {k: spark.conf.get(k, None) for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")}, []
    plain = warc._segments

    def segments(*args):
        cuts.append(spark.conf.set("spark.sql.files.minPartitionNum", str(4 + 3 * len(cuts))))
        return plain(*args)

    monkeypatch.setattr(warc, "_segments", segments)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.report(pages, str(tmp_path / "warc")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(cuts) == 2 and len(got) == 300 and all(r["intact"] for r in got)
    assert {(r["page_id"], r["payload_digest"]) for r in got} == {(i, base32(b.encode())) for i, b in enumerate(bodies)}


def test_archives_of_nothing_and_broken_chains(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "u", "two"), (3, "u", "three")], "page_id long, url string, html string")
    assert warc.report(pages.limit(0), str(tmp_path / "none")).count() == 0
    warc.write(pages.coalesce(1), str(tmp_path / "cut"))
    (name,) = [f for f in os.listdir(tmp_path / "cut") if f.startswith("part-")]
    data = (tmp_path / "cut" / name).read_bytes()
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "a.warc").write_bytes(data[:-9])  # the last record runs beyond the end
    (tmp_path / "short" / "b.warc").write_bytes(b"junk" + data)  # no mark at the start
    assert sorted(r["page_id"] for r in warc.read(spark, str(tmp_path / "short")).collect()) == [1, 2]


def exact(vectors, queries_, k=5):
    out = {}
    for q, a in queries_:
        best = {}
        for i, b in vectors:
            if i != q and len(a) == len(b):
                s = float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
                best[i] = max(best.get(i, -2.0), s)
        out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(900, 24))
    base[100:400] = base[100]  # a third of the rows are one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (1050, [float("inf")] * 24), (1004, [1.0, 2.0]), (1100, [2.0, 1.0]), (None, [1.0] * 24), (7, rows[8][1])]
    frame = spark.createDataFrame([(*r, "x") for r in [*rows, *odd]], "vec_id long, embedding array<double>, id string")
    s = ann.Settings(index_block=64, query_block=4)
    got = ann.search(frame, frame.where(F.col("vec_id") % 50 == 0), s=s).collect()
    fine = [(i, np.array(v)) for i, v in [*rows, odd[5], odd[6], odd[8]]]
    want = exact(fine, [(i, v) for i, v in fine if i % 50 == 0])
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == set(want) and found[1100] == {1: (1004, pytest.approx(0.8))}
    hits = total = 0
    for q, best in want.items():
        assert sorted(found[q]) == list(range(1, len(best) + 1))
        hits += len({found[q][k][0] for k in found[q]} & {i for i, _ in best})
        total += len(best)
    assert hits / total >= 0.9
    assert [found[100][k][0] for k in range(1, 6)] == [101, 102, 103, 104, 105]
    assert ann.report(frame.limit(0).drop("id")).count() == 0
    few = frame.where("vec_id < 4")
    assert ann.report(few).count() == 3


def test_repeated_ids_take_no_place(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    equal = [(i, [float(x) for x in v]) for i, v in enumerate(base) for _ in range(6)]
    near = [(i, [float(x) for x in v + 1e-3 * rng.normal(size=16)]) for i, v in enumerate(base) for _ in range(6)]
    for rows in (equal, near, [*equal, *near]):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        # one axis of few rows in some tables, one block in the exact search
        got = ann.search(frame, frame.where("vec_id in (3, 17)"), s=ann.Settings(tables=1, probes=1)).collect()
        fine = [(i, np.array(v)) for i, v in rows]
        for q in (3, 17):
            best = {}
            for i, v in fine:
                if i == q:
                    for j, found in exact(fine, [(q, v)], 40)[q]:
                        best[j] = max(best.get(j, -2.0), found)
            want = sorted(best, key=lambda j: (-best[j], j))[:5]
            assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    one = ann.nearest(np.repeat(np.arange(7), 6), np.repeat(base[:7], 6, 0), np.array([0]), base[:1], 5)
    assert one["vec_id"].nunique() == len(one) == 5


def test_hadamard_is_orthogonal():
    r = ann.rotate(np.eye(16), 0, 1)
    assert np.allclose(r @ r.T, np.eye(16))


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables missing")


@needs_tables
@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_on_the_tables(spark, sf):
    """Of the five nearest of each query, missing rows counted as misses."""
    v = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    x = v.toPandas().sort_values("vec_id")
    m = np.stack(x["embedding"].to_numpy()).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = ann.report(v).toPandas()
    queries_ = x["vec_id"][x["vec_id"] % 50 == 0]
    hits = 0
    for q in queries_:
        s = m @ m[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5]) & set(got[got["query_id"] == q]["vec_id"]))
    assert hits / (5 * len(queries_)) >= 0.9


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result, _ = compare(spark, con, SF, name, queries.QUERIES[name], queries.SQL[name])
    assert result.startswith("ok") and "TYPES" not in result, result


def test_one_query_for_each_operator():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@needs_tables
def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "PII", "mixing sources to target weights", "best-fit packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns and 0 < out.count() <= before
            before = out.count()
            ids = {r[0] for r in docs.select("doc_id").collect()}
            assert {r[0] for r in out.select("doc_id").collect()} <= ids
        docs, last = out, docs
    assert {r[0] for r in docs.select("doc_id").distinct().collect()} == {r[0] for r in last.select("doc_id").collect()}
    again = {r["doc_id"] for r in neardup.report(spark.read.parquet(str(tmp_path / "1"))).where(~F.col("kept")).collect()}
    assert not again
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
