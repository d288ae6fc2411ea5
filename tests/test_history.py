"""Snapshot history: publishing, replacing, latest batches, pruning, clustering and drifting types."""

import datetime as dt
import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from salesflow import Analysis, AnalysisParams
from salesflow.sinks.snapshot import (
    commits, live_batches, obsolete_batches, read_snapshot, snapshot_counts, write_snapshot,
)
from salesflow.sources.fixtures import FixtureCatalog

from conftest import SF_SMALL


def values(df):
    return sorted(r.a for r in df.collect())


def frame(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "a int")


def test_failed_write_leaves_the_month(spark, tmp_path):
    path, good = str(tmp_path / "t"), frame(spark, 1, 2)
    write_snapshot(good, path, "202601")
    broken = spark.range(100, numPartitions=4).select(
        F.expr("CASE WHEN id = 99 THEN raise_error('lost') ELSE CAST(id AS INT) END").cast("int").alias("a"))
    for replace in (True, False):
        with pytest.raises(PySparkException):
            write_snapshot(broken, path, "202601", replace_month=replace)
        assert values(read_snapshot(spark, path, good.schema, "202601")) == [1, 2]
    assert commits(spark, path).count() == 1


def test_unpublished_files_are_not_read(spark, tmp_path):
    """What a job that died between writing and publishing leaves behind."""
    path, good = str(tmp_path / "t"), frame(spark, 1)
    write_snapshot(good, path, "202601")
    good.write.parquet(path + "/data/report_month=202601/batch_id=lost")
    good.write.parquet(path + "/data/report_month=202602/batch_id=lost")
    assert values(read_snapshot(spark, path, good.schema)) == [1]


def test_replace_from_the_table_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    write_snapshot(frame(spark, 1, 2, 3), path, "202601")
    write_snapshot(frame(spark, 9), path, "202602")
    old = read_snapshot(spark, path, frame(spark, 1).schema, "202601")
    write_snapshot(old.filter("a > 1"), path, "202601", replace_month=True)
    assert values(read_snapshot(spark, path, frame(spark, 1).schema, "202601")) == [2, 3]
    assert values(read_snapshot(spark, path, frame(spark, 1).schema)) == [2, 3, 9]
    write_snapshot(frame(spark, 4), path, "202601")
    assert values(read_snapshot(spark, path, frame(spark, 1).schema, "202601")) == [2, 3, 4]
    assert obsolete_batches(spark, path).count() == 1


def test_latest_batch_of_each_month(spark, tmp_path):
    path, schema = str(tmp_path / "t"), frame(spark, 1).schema
    for month, numbers in (("202601", (1,)), ("202602", (2, 3)), ("202602", (2, 3, 4)), ("202603", (5,))):
        write_snapshot(frame(spark, *numbers), path, month)
    assert values(read_snapshot(spark, path, schema)) == [1, 2, 2, 3, 3, 4, 5]
    latest = read_snapshot(spark, path, schema, latest=True)
    assert values(latest) == [1, 2, 3, 4, 5]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan  # only the folders of those batches are listed
    counts = {r.report_month: r.row_count for r in snapshot_counts(spark, path, latest=True).collect()}
    assert counts == {"202601": 1, "202602": 3, "202603": 1}
    assert all("/commits/" in f for f in snapshot_counts(spark, path).inputFiles())  # no data is read
    assert live_batches(spark, path).count() == 4


def test_never_written(spark, tmp_path):
    path, schema = str(tmp_path / "t"), frame(spark, 1).schema
    for options in ({}, {"latest": True}, {"drift": True}, {"report_month": "202601"}):
        assert values(read_snapshot(spark, path, schema, **options)) == []
    assert write_snapshot(frame(spark, 1).filter("a > 1"), path, "202601", skip_empty=True) is False
    assert write_snapshot(frame(spark, 1).filter("a > 1"), path, "202601") is True
    assert values(read_snapshot(spark, path, schema)) == []
    assert snapshot_counts(spark, path).first().row_count == 0


def test_drifting_types(spark, tmp_path):
    path = str(tmp_path / "t")
    write_snapshot(spark.createDataFrame([("07", 1.5), ("x", 2.5)], "a string, b double"), path, "202601")
    write_snapshot(spark.createDataFrame([(8, "n", "2026-02-01")], "a long, c string, d string"), path, "202602")
    write_snapshot(spark.createDataFrame([(9, "m", "never")], "a long, c string, d string"), path, "202602")
    wanted = spark.createDataFrame([], "a int, b double, c string, d date").schema
    rows = read_snapshot(spark, path, wanted, drift=True).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([
        (7, 1.5, None, None, "202601"), (None, 2.5, None, None, "202601"),
        (8, None, "n", dt.date(2026, 2, 1), "202602"), (9, None, "m", None, "202602")], key=str)
    assert [r.a for r in read_snapshot(spark, path, wanted, "202601", drift=True).orderBy("a").collect()] == [None, 7]


def test_clustered_batches_skip_row_groups(spark, tmp_path):
    """Of a month clustered by time few row groups can hold a day; of a plain one all can."""
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    rows = spark.range(20_000).selectExpr("CAST(pmod(xxhash64(id), 300) AS INT) AS d", "id").selectExpr(
        "CAST(date_add(DATE'2026-01-01', d) AS TIMESTAMP_NTZ) AS t", "id")

    def groups(path):
        seen = []
        for file in glob.glob(path + "/data/*/*/*.parquet"):
            meta = pq.ParquetFile(file).metadata
            seen += [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
        assert len(seen) > 3
        return sum(s.min <= day(40) <= s.max for s in seen) / len(seen)

    plain, ranged = str(tmp_path / "plain"), str(tmp_path / "ranged")
    write_snapshot(rows.repartition(8), plain, "202601")
    write_snapshot(rows, ranged, "202601", cluster_by=("t", "id"), files=8)
    assert groups(plain) == 1.0 and groups(ranged) <= 0.25
    found = read_snapshot(spark, ranged, rows.schema, "202601").filter("t = TIMESTAMP_NTZ '2026-02-10'")
    assert "PushedFilters: [IsNotNull(t), EqualTo(t,2026-02-10T00:00)]" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == rows.filter("t = TIMESTAMP_NTZ '2026-02-10'").count() > 0


def test_counts_of_a_run_without_a_scan(spark, tmp_path):
    a = Analysis(FixtureCatalog(spark, SF_SMALL), AnalysisParams(report_month="202601"))
    a.save_snapshots(str(tmp_path))
    got = {r.table_name: r.row_count for r in a.snapshot_counts(str(tmp_path)).collect()}
    want = {r.table_name: r.row_count for r in a.load_counts().collect()}
    assert got == {"products": want["products"], "orders": want["all_orders"], "inventory": want["inventory"],
                   "collections": want["collections"]}


def test_plain_read_and_older_commits(spark, tmp_path):
    path, df = f"{tmp_path}/t", spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    write_snapshot(df, path, "202601")
    assert spark.read.parquet(path).select("id", "v").count() == 2  # the folder of commits is hidden
    os.rename(f"{path}/_log/commits", f"{path}/commits")  # as an older release wrote it
    write_snapshot(df, path, "202601")
    write_snapshot(df, path, "202602", replace_month=True)
    assert read_snapshot(spark, path, df.schema).count() == 6
    assert sorted(r.version for r in commits(spark, path).collect()) == [1, 2, 3]
