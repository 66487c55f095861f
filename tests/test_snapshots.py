"""Committed snapshots: what readers see while writers write, stop or collide."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from volpanel.sources import snapshots

DAYS = [date(2020, 1, d) for d in (2, 3, 6)]


def rows(spark, *entries):
    return spark.createDataFrame(entries, "quote_date date, value int")


def seen(df):
    return sorted((r.quote_date, r["value"]) for r in df.select("quote_date", "value").collect())


def test_commits_replace_dates_and_old_versions_stay(spark, tmp_path):
    path = f"file:{tmp_path}/set"
    assert snapshots.version(spark, path) == 0
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, path)
    assert snapshots.commit(rows(spark, (DAYS[0], 1), (DAYS[0], 1), (DAYS[1], 2)), path) == 1
    assert snapshots.commit(rows(spark, (DAYS[1], 3), (DAYS[2], 4)), path) == 2
    assert seen(snapshots.load(spark, path, verify=True)) == [(DAYS[0], 1), (DAYS[0], 1), (DAYS[1], 3), (DAYS[2], 4)]
    assert seen(snapshots.load(spark, path, at=1)) == [(DAYS[0], 1), (DAYS[0], 1), (DAYS[1], 2)]
    assert seen(snapshots.load(spark, path, ["2020-01-03"])) == [(DAYS[1], 3)]
    counts = {r.quote_date: r.row_count for r in snapshots.manifest(spark, path).collect()}
    assert counts == {DAYS[0]: 2, DAYS[1]: 1, DAYS[2]: 1}
    with pytest.raises(FileNotFoundError, match="2020-02-01"):
        snapshots.load(spark, path, ["2020-01-03", "2020-02-01"])
    for wrong in ([], ["2020-01-03", date(2020, 1, 3)]):
        with pytest.raises(ValueError):
            snapshots.load(spark, path, wrong)


def test_a_stop_before_the_commit_leaves_the_old_state(spark, tmp_path):
    path = f"file:{tmp_path}/set"
    snapshots.commit(rows(spark, (DAYS[0], 1)), path)
    snapshots.stage_rows(rows(spark, (DAYS[0], 9), (DAYS[1], 9)), path)
    assert seen(snapshots.load(spark, path)) == [(DAYS[0], 1)] and snapshots.version(spark, path) == 1


def test_the_second_of_two_writers_fails(spark, tmp_path):
    path = f"file:{tmp_path}/set"
    base = snapshots.version(spark, path)
    first, second = [snapshots.stage_rows(rows(spark, (DAYS[i], i)), path) for i in range(2)]
    assert snapshots.publish(spark, path, first, base) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        snapshots.publish(spark, path, second, base)
    assert seen(snapshots.load(spark, path)) == [(DAYS[0], 0)]


def test_damage_and_repeated_entries_are_found(spark, tmp_path):
    path = f"file:{tmp_path}/set"
    snapshots.commit(rows(spark, (DAYS[0], 1), (DAYS[1], 2)), path)
    commit = snapshots.manifest(spark, path).first()["commit"]
    rows(spark, (DAYS[0], 5)).select("value").write.mode("append").parquet(f"{path}/data/commit={commit}/year=2020/quote_date=2020-01-02")
    assert seen(snapshots.load(spark, path, [DAYS[1]], verify=True)) == [(DAYS[1], 2)]
    with pytest.raises(ValueError, match="2020-01-02 are not those"):
        snapshots.load(spark, path, verify=True)
    snapshots.manifest(spark, path).where(F.col("quote_date") == F.lit(DAYS[0])).write.mode("append").parquet(f"{path}/manifests/{commit}")
    with pytest.raises(ValueError, match="more than once"):
        snapshots.load(spark, path)


def test_rows_without_a_date_and_empty_commits_are_refused(spark, tmp_path):
    path = f"file:{tmp_path}/set"
    with pytest.raises(ValueError, match="without a quote date"):
        snapshots.commit(rows(spark, (None, 1), (DAYS[0], 1)), path)
    with pytest.raises(Exception):
        snapshots.commit(rows(spark, (DAYS[0], 1)).where("value > 5"), path)
    assert snapshots.version(spark, path) == 0
