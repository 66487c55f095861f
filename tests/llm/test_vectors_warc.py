"""Nearest neighbours and WARC archives."""

import gzip
import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import collected, key
from volpanel.llm import tables, vector_graph, warc

VECTORS = "vec_id long, embedding array<float>, dim string, shard int"


def brute(vectors, queries, k=10):
    ids = np.array(sorted(vectors))
    points = np.array([vectors[i] for i in ids], dtype=np.float64)
    out = {}
    for q in queries:
        gap = points - np.array(vectors[q], dtype=np.float64)
        score = np.sqrt((gap * gap).sum(axis=1))
        rows = sorted((s, i) for s, i in zip(score.tolist(), ids.tolist()) if i != q)
        out[q] = rows[:k]
    return out


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = vector_graph.nearest_neighbours(rows, F.col("vec_id") % 20 == 0, settings=vector_graph.Settings(shard_rows=700))
    vectors = {r["vec_id"]: r["embedding"] for r in rows.collect()}
    want = brute(vectors, [v for v in vectors if v % 20 == 0])
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"], r["rank"]))
    assert set(got) == set(want)
    hits = 0
    for q, rows_ in got.items():
        assert [r[2] for r in rows_] == list(range(1, 11))
        assert [r[:2] for r in rows_] == sorted(r[:2] for r in rows_)
        exact = {i: s for s, i in want[q]}
        hits += sum(i in exact for _, i, _ in rows_)
        assert all(s == pytest.approx(exact[i], rel=1e-12) for s, i, _ in rows_ if i in exact)
    assert hits / (10 * len(want)) >= 0.95


def test_vector_edges(spark):
    rng = np.random.default_rng(1)
    copies = [(i, [1.0, 2.0, 3.0]) for i in range(100, 400)]
    own = [(i, rng.normal(size=3).round(3).tolist()) for i in range(0, 60)]
    bad = [(1000, None), (1001, [0.0, 0.0, 0.0]), (1002, [1.0, None, 2.0]), (1003, [float("nan"), 1.0, 1.0]),
           (1004, [float("inf"), 1.0, 1.0]), (1005, []), (None, [1.0, 1.0, 1.0])]
    flat = [(2000, [1.0, 1.0]), (2100, [1.0, 2.0])]
    rows = [(i, v, "x", 7) for i, v in copies + own + bad + flat + own[:3]]
    found = vector_graph.nearest_neighbours(
        spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, settings=vector_graph.Settings(shard_rows=100)
    )
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {0, 100, 200, 300, 2000, 2100}
    assert got[100] == list(range(101, 111)) and got[200] == list(range(100, 110))
    assert (got[2000], got[2100]) == ([2100], [2000])
    # The repeated row of id 0 is a candidate and a query of its own, so both rows get the same answer.
    target = np.float32(own[0][1]).astype(np.float64)
    others = [(i, np.float32(v).astype(np.float64)) for i, v in copies + own[1:] + own[:3]]
    want = sorted((float(np.sqrt(((v - target) ** 2).sum())), i) for i, v in others)[:10]
    assert got[0] == [i for _, i in want for _ in range(2)] and want[0] == (0.0, 0)
    empty = spark.createDataFrame([], VECTORS)
    assert vector_graph.nearest_neighbours(empty, F.lit(True)).count() == 0


@pytest.mark.parametrize("query_rows", [1, 20_000])
def test_repeated_ids_keep_their_vectors(spark, query_rows):
    rng = np.random.default_rng(2)
    rows = [(i % 40, rng.normal(size=4).tolist(), "x", 7) for i in range(120)]
    given = vector_graph.usable(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding")
    settings = vector_graph.Settings(shard_rows=50)
    found = vector_graph.search(vector_graph.build_index(given, settings), given.where("vec_id % 20 = 0"), 10, settings, query_rows)
    points = [(i, np.float32(v).astype(np.float64)) for i, v, *_ in rows]
    want = []
    for at, (q, target) in enumerate(points):
        if q % 20 == 0:
            near = sorted((float(np.sqrt(((v - target) ** 2).sum())), i) for k, (i, v) in enumerate(points) if k != at)[:10]
            want += [(q, rank + 1, i) for rank, (_, i) in enumerate(near)]
    assert len(want) == 60
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()) == sorted(want)


def pages():
    big, other = "<p>é" + "x" * 1200, "y" * 1000
    return [
        (1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (None, "http://a/n", big),
        (5, "http://a/5", big), (2, "http://b\r\nX: y", other), (4, "http://b/4", other + "\r\n\r\nWARC/1.1"),
        (6, "http://c/6", "z" * 999), (7, "http://c/7", "z" * 999), (8, "u", None), (9, "u", ""), (None, None, None),
    ]


def test_archives_round_trip(spark):
    frame = spark.createDataFrame([(*p, "clash") for p in pages()], "page_id long, url string, html string, digest string")
    found = warc.round_trip(frame).collect()
    assert len(found) == len(pages())
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in found), key=key)
    want = [(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in pages()]
    assert got == sorted(want, key=key)
    big = [r for r in found if r["payload_bytes"] > 1200]
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in big) == [
        (0, "revisit", 5), (1, "revisit", 5), (3, "revisit", 5), (5, "response", None), (5, "revisit", 5),
    ]
    assert all(r["record_type"] == "response" and r["refers_to"] is None for r in found if r["payload_bytes"] < 1200)


def test_files_are_archives(spark, tmp_path):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string")
    warc.write_archives(frame, str(tmp_path / "w"))
    records = []
    for file in Path(tmp_path / "w").glob("*.gz"):
        records += warc._records(gzip.decompress(file.read_bytes()))
    assert len(records) == len(pages())
    assert len({h["WARC-Record-ID"] for h, _ in records}) == len(pages())
    for headers, block in records:
        assert int(headers["Content-Length"]) == len(block)
        assert (headers["WARC-Type"] == "revisit") == (not block)
        assert ("WARC-Refers-To" in headers) == (headers["WARC-Type"] == "revisit")


def test_equal_pages_have_ids_of_their_own_and_hot_responses_are_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 3)
    long = "q" * 30_000
    given = [(1, "u", "s")] * 3 + [(i % 40, "v", long) for i in range(80)] + [(100 + i // 2, "w", "r" * 1000) for i in range(4)]
    frame = spark.createDataFrame(given, "page_id long, url string, html string").repartition(5)
    warc.write_archives(frame, str(tmp_path / "w"))
    records = []
    for file in Path(tmp_path / "w").glob("*.gz"):
        records += warc._records(gzip.decompress(file.read_bytes()))
    ids = {h["WARC-Record-ID"]: h["WARC-Type"] for h, _ in records}
    assert len(records) == len(ids) == len(given)
    assert all(ids[h["WARC-Refers-To"]] == "response" for h, _ in records if h["WARC-Type"] == "revisit")
    found = warc.read_archives(spark, str(tmp_path / "w"))
    assert found.count() == len(given) and found.where("payload_digest IS NULL OR payload_bytes IS NULL").isEmpty()
    assert collected(found.where("payload_bytes = 30000").groupBy("record_type", "refers_to").count(), "record_type", "refers_to", "count") == [
        ("response", None, 1), ("revisit", 39, 79),
    ]
    assert collected(found.where("payload_bytes = 1000").groupBy("record_type", "refers_to").count(), "record_type", "refers_to", "count") == [
        ("response", None, 1), ("revisit", 101, 3),
    ]


def test_damaged_payload_is_noticed(spark, tmp_path):
    text = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha1:0\r\nContent-Length: 9\r\n\r\nHTTP\r\n\r\nx\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(text.encode())
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, str(tmp_path)).count()


def test_no_pages(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(frame).count() == 0
    assert collected(warc.round_trip(frame), "page_id") == []
