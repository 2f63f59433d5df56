"""Incremental ingest: only new files are appended, duplicates inside a batch collapse."""

import os

from conftest import days, make_cube
from thermocline.streaming import ingest_cube_files


def test_ingest_appends_only_new_files(spark, tmp_path):
    src, store, ck = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck")
    os.makedirs(src)
    make_cube(spark, [(d, 0, j, 1.0) for d in days("2000-12-30", 2) for j in range(2)]).write.parquet(src + "/f1")
    q = ingest_cube_files(spark, src + "/*", store, ck)
    q.awaitTermination()
    assert spark.read.parquet(store).count() == 4
    # a new file, plus a copy of a step already present within it
    rows = [(d, 0, j, float("nan")) for d in days("2001-01-01", 2) for j in range(2)]
    make_cube(spark, rows + rows[:1]).write.parquet(src + "/f2")
    q = ingest_cube_files(spark, src + "/*", store, ck)
    q.awaitTermination()
    back = spark.read.parquet(store)
    assert back.count() == 8
    assert back.where("sst is null").count() == 4
    assert sorted(r["year"] for r in back.select("year").distinct().collect()) == [2000, 2001]
    assert back.select("batch").distinct().count() == 2


def test_ingest_refuses_a_store_of_another_checkpoint(spark, tmp_path):
    import pytest

    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    os.makedirs(src)
    make_cube(spark, [(d, 0, 0, 1.0) for d in days("2000-12-30", 3)]).write.parquet(src + "/f1")
    ingest_cube_files(spark, src + "/*", store, str(tmp_path / "ck1")).awaitTermination()
    with pytest.raises(ValueError, match="checkpoint"):
        ingest_cube_files(spark, src + "/*", store, str(tmp_path / "ck2"))
    assert spark.read.parquet(store).count() == 3


def test_ingest_is_an_upsert_across_batches(spark, tmp_path):
    """A file sent again in a later batch leaves one row; a valid value comes before a missing one, whatever the order."""
    from thermocline.streaming.ingest import read_ingested

    src, store, ck = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck")
    os.makedirs(src)
    month = days("2003-05-01", 31)
    want = {}
    for n in range(6):
        rows = [(month[(n + k) % 31], 0, j, None if (n + k + j) % 4 == 0 else float(k)) for k in range(5) for j in range(2)]
        rows += [(d, 1, 0, 2.0) for d in days("2004-01-30", 4)]  # sent with every file
        make_cube(spark, rows).write.parquet(f"{src}/f{n}")
        for d, i, j, v in rows:
            old = want.get((d, i, j))
            want[d, i, j] = old if v is None else v if old is None else min(v, old)
        ingest_cube_files(spark, src + "/*", store, ck).awaitTermination()
    back = read_ingested(spark, store)
    got = {(r["t"], r["lat_idx"], r["lon_idx"]): r["sst"] for r in back.collect()}
    assert back.count() == len(got) and got == want
    folders = [f"{a}/{b}" for a in os.listdir(store) if a.startswith("batch=") for y in os.listdir(f"{store}/{a}") if y.startswith("year=") for b in os.listdir(f"{store}/{a}/{y}")]
    assert len(folders) <= 2 * 3  # two versions of each month at most
    assert len([a for a in os.listdir(store) if a.startswith("batch=")]) <= 3


def test_a_replayed_batch_gives_the_same_store(spark, tmp_path):
    from thermocline.streaming.ingest import INDEXED_SCHEMA, read_ingested, upsert

    store = str(tmp_path / "store")
    batches = [make_cube(spark, [(d, 0, j, float(n * 10 + j)) for d in days("2003-05-01", 3 + n) for j in range(2)]) for n in range(4)]
    for n, b in enumerate(batches):
        upsert(b, n, store)
    before = sorted(map(tuple, read_ingested(spark, store).collect()))
    upsert(batches[3], 3, store)  # as after a failure before the batch was noted as done
    assert sorted(map(tuple, read_ingested(spark, store).collect())) == before and len(before) == 12
    # a batch that did not finish does not count
    os.remove(f"{store}/batch=3/_SUCCESS")
    unfinished = sorted(map(tuple, read_ingested(spark, store).collect()))
    assert len(unfinished) == 10
    upsert(batches[3], 3, store)
    assert sorted(map(tuple, read_ingested(spark, store).collect())) == before
    assert read_ingested(spark, str(tmp_path / "none")).schema.names == INDEXED_SCHEMA.names
    upsert(make_cube(spark, [(None, 0, 0, 1.0), (None, 0, 0, 1.0)]), 4, store)  # without a time
    assert read_ingested(spark, store).count() == 13
