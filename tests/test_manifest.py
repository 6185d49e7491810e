"""Audits that read changed files only, and repairs that write damaged files only."""

import os

import pytest
from pyspark.sql import functions as F

from revlens.operators import manifest
from revlens.operators.store import seal


def sealed(spark, numbers, bad=()):
    rows = seal(spark.createDataFrame([("r", str(i), f"payload {i}") for i in numbers], "repo string, id string, payload string"))
    return rows.withColumn("crc", F.col("crc") + F.when(F.col("id").isin([str(i) for i in bad]), 1).otherwise(0)).coalesce(1)


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    for k in range(4):
        sealed(spark, range(k * 10, k * 10 + 10), [13, 17] if k == 1 else []).write.mode("append").parquet(path)
    return path, spark.read.parquet(path).schema


def ids(df):
    return sorted(int(r.id) for r in df.collect())


def test_only_changed_files_are_read(spark, store):
    path, schema = store
    first = manifest.audit_files(spark, path, schema).collect()
    assert sorted((r.rows, r.bad, r.checked) for r in first) == [(10, 0, 0)] * 3 + [(10, 2, 0)]
    assert sorted(r.checked for r in manifest.audit_files(spark, path, schema).collect()) == [0] * 4
    sealed(spark, range(40, 45), [44]).write.mode("append").parquet(path)
    third = manifest.audit_files(spark, path, schema).collect()
    assert sorted((r.checked, r.rows, r.bad) for r in third) == [(0, 10, 0)] * 3 + [(0, 10, 2), (2, 5, 1)]
    assert ids(manifest.damaged_rows(spark, path, schema)) == [13, 17, 44]
    assert {r.checked for r in manifest.audit_files(spark, path, schema, whole=True).collect()} == {3}


def test_only_damaged_files_are_written(spark, store):
    path, schema = store
    before = {r.file for r in manifest.audit_files(spark, path, schema).where("bad = 0").collect()}
    want = [i for i in range(40) if i not in (13, 17)]
    assert ids(manifest.repair_files(spark, path, schema)) == want
    live = manifest.lines(spark, path).where("state = 'live'")
    assert {r.file for r in live.collect()} > before and live.count() == 4 and live.agg(F.sum("bad")).first()[0] == 0
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 3
    assert ids(manifest.repair_files(spark, path, schema)) == want
    manifest.audit_files(spark, path, schema)
    assert ids(manifest.stored_rows(spark, path, schema)) == want and manifest.damaged_rows(spark, path, schema).count() == 0


def test_a_repair_that_ended_before_the_old_files_went(spark, store, monkeypatch):
    path, schema = store
    manifest.audit_files(spark, path, schema)
    monkeypatch.setattr(manifest, "delete", lambda *_: None)
    want = [i for i in range(40) if i not in (13, 17)]
    assert ids(manifest.repair_files(spark, path, schema)) == want
    manifest.audit_files(spark, path, schema)
    assert ids(manifest.stored_rows(spark, path, schema)) == want
    manifest.audit_files(spark, path, schema, whole=True)
    assert ids(manifest.repair_files(spark, path, schema)) == want
