"""Exact dedup, n-gram join, the pipeline."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from llm_helpers import DOC_SCHEMA, collected, components, edge_docs, edge_texts, key, lower, no_docs, rows, sentence
from volpanel.llm import exact_dedup, fuse_filter, ngram_join, tables
from volpanel.llm.shingles import shingle_set
from volpanel.llm.tables import likely, slot_bitmap


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 30_000])
def test_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63, size=n)
    stored = fuse_filter.build(np.concatenate([keys, keys[: n // 2]]))
    assert fuse_filter.contains(keys, *stored).all()
    others = rng.integers(-(2**63), 2**63, size=20_000)
    assert fuse_filter.contains(others, *stored).mean() < 0.01


def deduplicated_plainly(texts):
    groups = {}
    for doc, text, *_ in texts:
        groups.setdefault(lower(text), []).append(doc)
    out = []
    for doc, text, *_ in texts:
        ids = groups[lower(text)]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc, keep, len(ids)))
    return sorted(out, key=key)


@pytest.mark.parametrize("stored", ["doc_id % 2 = 0", "true", "false", "null"])
def test_exact_dedup_edges(spark, stored):
    found = exact_dedup.deduplicate(edge_docs(spark), F.expr(stored).cast("boolean"))
    assert collected(found, "doc_id", "keep_id", "group_size") == deduplicated_plainly(edge_texts())
    kept = found.where("kept")
    assert kept.count() == found.select("text_sha256").distinct().count()
    assert kept.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).isEmpty()


def test_large_batch_meets_a_small_snapshot_in_parts(spark, tmp_path):
    ids = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    stored = ids.where("id < 50").select("sha", F.col("id").alias("doc_id"), F.col("id").alias("row"))
    exact_dedup.write_snapshot(exact_dedup.build_snapshot(stored), str(tmp_path / "kept"))
    snapshot = exact_dedup.read_snapshot(spark, str(tmp_path / "kept"))
    assert snapshot.buckets == 1 and snapshot.groups.count() == 50
    whole = exact_dedup.screen(ids, snapshot)
    parts = exact_dedup.screen(ids, snapshot, keys_per_part=100)
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()
    assert stored.join(parts, "sha").count() == 50 and parts.count() < 80
    with pytest.raises(Exception, match="(?i)already exists"):
        exact_dedup.write_snapshot(snapshot, str(tmp_path / "kept"))


def test_spread_join_is_a_left_join(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 10)
    left = spark.range(500).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 9 > 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.concat(F.lit("row"), F.col("id")).alias("name"),
    )
    right = left.where("k IS NOT NULL AND k <> 'k6'").groupBy("k").agg(F.count("*").alias("n"), F.max("name").alias("top"))
    found = tables.spread_join(left, F.col("k"), "name", right, "k", "n").select("k", "name", "found.n", "found.top")
    plain = left.join(right, "k", "left").select("k", "name", "n", "top")
    assert found.exceptAll(plain).isEmpty() and found.count() == 500
    assert tables.spread_join(left, F.col("k"), "name", right.limit(0), "k", "n").where("found IS NULL").count() == 500


def test_keep_one_returns_whole_rows(spark):
    docs = edge_docs(spark)
    kept = exact_dedup.keep_one(docs, F.expr("doc_id % 2 = 0"))
    assert kept.columns == docs.columns
    want = {}
    for doc, text, *_ in edge_texts():
        have = want.get(lower(text), (None,))[0]
        want[lower(text)] = (doc if have is None or (doc is not None and doc >= have) else have,)
    assert sorted(r["doc_id"] is not None and r["doc_id"] for r in kept.collect()) == sorted(
        v[0] is not None and v[0] for v in want.values()
    )
    assert exact_dedup.keep_one(no_docs(spark), F.lit(True)).count() == 0


def test_bitmap_splits_rows(spark):
    docs = spark.range(1000).withColumnRenamed("id", "_id")
    bitmap = slot_bitmap(docs.where("_id % 10 = 0"), "_id")
    inside, outside = likely(docs, F.col("_id"), bitmap), likely(docs, F.col("_id"), bitmap, inside=False)
    assert inside.where("_id % 10 = 0").count() == 100 and inside.count() < 110
    assert inside.count() + outside.count() == 1000


def near_texts():
    """Chains of near copies, shared passages, short texts, and many near copies of one text."""
    rng = np.random.default_rng(5)
    out, doc = [], 100
    for seed in range(6):
        words = sentence(seed + 10, 80).split()
        for _ in range(6):
            out.append((doc, " ".join(words)))
            doc -= 1
            words[rng.integers(len(words))] = f"w{rng.integers(10**6)}"
    base = sentence(50, 60).split()
    for _ in range(25):
        words = list(base)
        words[rng.integers(len(words))] = f"v{rng.integers(10**6)}"
        out.append((doc, " ".join(words)))
        doc -= 1
    passage = sentence(60, 30)
    out += [(200 + i, passage + " " + sentence(70 + i, 2 + i)) for i in range(20)]
    return out


@pytest.mark.parametrize("words,num", [(3, 90), (5, 80), (1, 50)])
def test_join_against_all_pairs(spark, words, num):
    texts = near_texts() + [t[:2] for t in edge_texts()]
    docs = spark.createDataFrame(rows([(*t, "en", "a") for t in texts]), DOC_SCHEMA).repartition(3)
    found = ngram_join.similarity_join(docs, join=ngram_join.Join(words, num, 100))
    assert collected(found, "doc_id", "n_shingles", "component_id") == sorted(components(texts, words, num, 100), key=key)


def test_join_keeps_one_row_per_component(spark):
    texts = near_texts() + [t[:2] for t in edge_texts()]
    docs = spark.createDataFrame(rows([(*t, "en", "a") for t in texts]), DOC_SCHEMA)
    join = ngram_join.Join(5, 80, 100)
    kept = ngram_join.keep_one(docs, join=join)
    assert kept.columns == docs.columns
    found = components(texts, 5, 80, 100)
    named = {c for _, n, c in found if n}
    empty = [d for d, n, _ in found if not n]
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(str(x) for x in got) == sorted([str(c) for c in named] + [str(d) for d in empty])
    assert ngram_join.keep_one(no_docs(spark)).count() == 0
    assert ngram_join.similarity_join(no_docs(spark)).count() == 0


def test_join_keeps_components_apart_without_clear_ids(spark):
    copies = [sentence(80, 50), sentence(80, 49), sentence(81, 50), sentence(82, 50), sentence(83, 50)]
    texts = [(None, t) for t in (*copies, copies[3])] + [(7, sentence(s, 50)) for s in (90, 91)] + [(8, sentence(90, 49)), (None, "")]
    docs = spark.createDataFrame(rows([(*t, "en", "a") for t in texts]), DOC_SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect()]
    one = [t for t in got if t[1] in copies[:2]]
    assert len(one) == 1
    want = [(None, t) for t in copies[2:]] + [(7, sentence(s, 50)) for s in (90, 91)] + [(None, "")]
    assert sorted((t for t in got if t not in one), key=str) == sorted(want, key=str)


def test_join_moves_sketches_and_sets_of_paired_nodes_alone(spark, monkeypatch):
    texts = [(i, sentence(1000 + i, 60)) for i in range(300)] + [(300 + i, sentence(1000, 60) + f" x{i}") for i in range(2)]
    staged, plain = {}, tables.Scratch.stage

    def noted(self, df, label):
        found = plain(self, df, label)
        staged.setdefault(label, []).append(found.count())
        return found

    monkeypatch.setattr(tables.Scratch, "stage", noted)
    docs = spark.createDataFrame(rows([(*t, "en", "a") for t in texts]), DOC_SCHEMA)
    found = ngram_join.similarity_join(docs, join=ngram_join.Join(3, 90, 100))
    assert collected(found, "doc_id", "component_id") == [(i, 0 if i >= 300 else i) for i in range(302)]
    assert staged["join-known"] == [302]
    # Sketches of few nodes besides the three that are paired; sets that moved are never staged a second time.
    assert max(staged["join-sketches"]) <= 10
    assert len(staged["join-sets"]) == len(staged["join-ends"])


def test_staged_tables_give_workers_small_batches(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([batch.nbytes], pa.int64())})

    wide = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 500).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    found = tables.stage(wide.mapInArrow(sizes, "bytes bigint"), "sizes").agg(F.max("bytes"), F.sum("bytes")).first()
    assert found[0] <= tables.BATCH_BYTES + 8000 and found[1] >= 4000 * 4000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_shingles_follow_the_words():
    for text in ["a b c d a b c", "A\tb\nc  d", "x", "", None, "é É\x0bß", "a\u00a0b c d", "word " * 5000]:
        words = lower(text).split(" ") if text and "\t" not in text and "  " not in text else None
        for k in (1, 3, 5):
            from llm_helpers import shingles

            assert len(shingle_set(text, k)) == len(shingles(text, k)), (text, k, words)
    assert set(shingle_set("A B c d", 3)) == set(shingle_set("a b  C D", 3))


def test_pipeline_against_plain_versions(spark):
    import corpus_pipeline
    from volpanel.llm import language_id
    from volpanel.llm.tables import stage

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, ""), name)
        after = [r.asDict() for r in docs.collect()]
        if name == "packing":
            assert {r["doc_id"] for r in after} == set(before)
            break
        assert docs.columns == columns
        ids = [r["doc_id"] for r in after]
        if name == "language_id":
            assert set(ids) == {d for d, r in before.items() if language_id.ngram_counts(r["text"]) is not None}
        if name == "exact_dedup":
            last = {lower(r["text"]): d for d, r in sorted(before.items())}
            assert sorted(ids) == sorted(last.values())
        if name == "ngram_join":
            assert sorted(ids) == sorted({c for _, _, c in components([(d, r["text"]) for d, r in before.items()], 5, 80, 100)})
        if name == "mixing":
            assert set(ids) <= set(before)
        for r in after:
            assert r == before[r["doc_id"]].asDict()
        before = {d: r for d, r in before.items() if d in set(ids)}


def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline
    from volpanel.llm.tables import stage

    for docs in (edge_docs(spark), no_docs(spark)):
        for name, step in corpus_pipeline.STAGES:
            given = docs.columns
            docs = stage(step(spark, docs, ""), name)
            assert name == "packing" or docs.columns == given


def test_staged_tables_are_written_and_read_in_small_parts(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    with tables.small_batches(spark):
        assert int(spark.conf.get(key)) == tables.READ_ROWS
    assert spark.conf.get(key) == before
    wide = spark.range(400, numPartitions=1).select("id", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.sha1(F.concat_ws("-", "id", i).cast("binary")))).alias("text"))
    staged = tables.stage(wide, "wide")
    files = [f.removeprefix("file:").replace("///", "/") for f in staged.inputFiles()]
    groups = [g for f in files for m in [pq.ParquetFile(f).metadata] for g in (m.row_group(i) for i in range(m.num_row_groups))]
    assert len(groups) > 2 and max(g.total_byte_size for g in groups) < 2 * tables.GROUP_BYTES
    assert staged.agg(F.sum(F.length("text"))).first()[0] == 400 * 4000 * 40
