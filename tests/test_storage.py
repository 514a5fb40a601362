"""Stored tables: replacement by buckets, file statistics and compaction, archives and split files as sources."""

import glob
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lyrebird.operators import store, views
from lyrebird.plans import service_plans
from lyrebird.sources import archives, listings


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_replacement_touches_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2000).select((F.col("id") % 100).alias("p"), (F.col("id") / 100).cast("int").alias("i"), F.lit("old").alias("v"))
    store.write_children(rows, path, "p", 32)
    before = files(path)
    new = spark.createDataFrame([(3, 0, "new"), (3, 1, "new"), (41, 7, "new"), (500, 0, "new")], "p long, i int, v string")
    n = store.replace_stored(new, path, "p", 32)
    now = files(path)
    assert n <= 3 and 0 < len(set(before) - set(now)) <= n and all(now[f] == before[f] for f in set(before) & set(now))
    got = {(r.p, r.i, r.v) for r in store.read_children(spark, path).collect()}
    want = {(i % 100, i // 100, "old") for i in range(2000) if i % 100 not in (3, 41)} | {(3, 0, "new"), (3, 1, "new"), (41, 7, "new"), (500, 0, "new")}
    assert got == want
    assert store.replace_stored(new.limit(0), path, "p", 32) == 0 and files(path) == now


def test_a_failed_replacement_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_children(spark.range(50).select((F.col("id") % 5).alias("p"), F.col("id").alias("v")), path, "p", 4)
    before = files(path)
    broken = spark.range(3).select(F.col("id").alias("p"), F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("v"))
    with pytest.raises(Exception, match="no"):
        store.replace_stored(broken, path, "p", 4)
    assert files(path) == before and store.read_children(spark, path).count() == 50


def test_only_small_files_are_packed(spark, tmp_path):
    path = str(tmp_path / "a b")
    wide = lambda n, k: spark.range(n).select(F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("t"), F.lit(k).alias("k"))
    wide(40_000, 1).coalesce(1).write.partitionBy("k").parquet(path)
    for n in range(6):
        wide(300 + n, 1 + n % 2).coalesce(1).write.mode("append").partitionBy("k").parquet(path)
    before = files(path)
    big = max(before, key=os.path.getsize)
    rows = sorted(map(tuple, spark.read.parquet(path).collect()))
    stats = {r.file.rsplit("/", 1)[1]: r for r in views.file_stats(spark, path, F.col("id") < 100).collect()}
    assert len(stats) == 7 and stats[big.rsplit("/", 1)[1]].n_rows == 40_000
    assert all(r.dead_rows == 100 and r.bytes == os.path.getsize(next(f for f in before if f.endswith(name))) for name, r in stats.items())
    made = views.compact(spark, path, os.path.getsize(big) * 2 - 1000)
    now = files(path)
    assert made == 2 and len(now) == 3 and now[big] == before[big]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == rows and not glob.glob(f"{path}/_compact*")
    assert views.compact(spark, path, 1000) == 0
    sizes = {r.folder.rsplit("/", 1)[1]: (r.n_files, r.n_rows) for r in views.folder_sizes(views.file_stats(spark, path)).collect()}
    assert sizes == {"k=1": (2, 40_000 + 906), "k=2": (1, 909)}


def test_files_are_packed_first_fit():
    assert views.packed_files([("a", 6), ("b", 5), ("c", 4), ("d", 3), ("e", 10)], 10) == [["a", "c"], ["b", "d"]]
    assert views.packed_files([("a", 6)], 10) == []


def zipped(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_members_of_one_archive_are_many_tasks(spark, tmp_path):
    zipped(tmp_path / "a.zip", {f"in/{i}.srt": f"text {i}\r\nmore" for i in range(12)} | {"note.txt": "no"})
    (tmp_path / "x.txt").write_text("no archive")
    got = archives.read_members(spark, str(tmp_path), ".srt")
    assert got.rdd.getNumPartitions() == 12
    assert sorted((r.member, r.value) for r in got.collect()) == sorted((f"in/{i}.srt", f"text {i}\nmore") for i in range(12))
    empty = tmp_path / "none"
    empty.mkdir()
    assert archives.read_members(spark, str(empty)).collect() == []
    (empty / "bad.zip").write_bytes(b"no zip at all")
    with pytest.raises(Exception, match="PYTHON_DATA_SOURCE_ERROR"):
        archives.read_members(spark, str(empty)).collect()


def test_a_stream_takes_each_archive_once(spark, tmp_path):
    landing, seen = tmp_path / "in", []
    landing.mkdir()

    def step():
        def take(batch, _):
            seen.extend(r.member for r in batch.collect())

        q = archives.stream_members(spark, str(landing), ".srt", 1).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    for n in range(2):
        zipped(landing / f"{n}.zip", {f"{n}-{i}.srt": "x" for i in range(2)})
        os.utime(landing / f"{n}.zip", (1000 + n, 1000 + n))
    step()
    assert sorted(seen) == ["0-0.srt", "0-1.srt", "1-0.srt", "1-1.srt"]
    zipped(landing / "2.zip", {"2-0.srt": "x"})
    step()  # restarted from its checkpoint
    assert sorted(seen) == ["0-0.srt", "0-1.srt", "1-0.srt", "1-1.srt", "2-0.srt"]


def test_one_listing_file_is_read_by_several_tasks(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    line = '{"id": "v%d", "title": "Café %d", "description": "' + "x" * 200 + '"}'
    (tmp_path / "utf.jsonl").write_text("\r\n".join(line % (i, i) for i in range(2000)) + "\n\nbroken\n", encoding="utf-8")
    (tmp_path / "latin.jsonl").write_bytes("\n".join(line % (i, i) for i in range(5000, 6000)).encode("latin-1"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = {r.video_id: r.title for r in listings.read_listing(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"v{i}": f"Café {i}" for i in [*range(2000), *range(5000, 6000)]}


def test_each_packed_group_is_written_by_one_task(spark, tmp_path):
    """Groups keep apart: the largest task of packing sorts one of them, however many there are."""
    path = str(tmp_path / "t")
    for _ in range(3):
        spark.range(8 * 50).select(F.col("id"), (F.col("id") % 8).alias("k")).coalesce(1).write.mode("append").partitionBy("k").parquet(path)
    before = set(files(path))
    assert views.compact(spark, path, 1 << 20) == 8
    now = files(path)
    assert len(now) == 8 and not before & set(now)
    tasks = [os.path.basename(f).split("-")[1] for f in now]
    assert len(set(tasks)) == 8, "part numbers of the files name their tasks"


def test_stored_sizes_deals_a_large_table_to_more_tasks(spark, small, monkeypatch):
    """Rows of one writing task are bounded: parts grow with the table."""
    parts, write = [], service_plans.views.compact

    def seen(session, path, *args):
        parts.append(len({os.path.basename(f).split("-")[1] for f in files(path.removeprefix("file://"))}))
        return write(session, path, *args)

    monkeypatch.setattr(service_plans.views, "compact", seen)
    monkeypatch.setattr(service_plans, "ROWS_A_FILE_TASK", 500, raising=False)
    got = service_plans.stored_sizes(spark, small).agg(F.sum("n_rows")).first()[0]
    assert got == spark.read.parquet(f"{small}/lineitem.parquet").count() and parts[0] > 4
