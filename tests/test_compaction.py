from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keelstone.plans.catalog import writes as W
from keelstone.sinks import compaction as C
from keelstone.sinks import partitions
from tests.util import rows


def stored(size, name, folder="f"):
    return C.Stored(f"{folder}/{name}", folder, size)


def test_bins_are_packed():
    files = [stored(s, f"{k}") for k, s in enumerate([90, 80, 60, 50, 40, 30, 10, 75])]
    groups = C.pack(files, 100)
    assert all(sum(f.size for f in g.files) <= 100 and len(g.files) > 1 for g in groups)
    taken = [f.size for g in groups for f in g.files]
    assert 90 not in taken and 80 not in taken and 75 not in taken
    assert sorted(taken) == [10, 30, 40, 50, 60]
    assert C.pack([stored(10, "a"), stored(10, "b", "g")], 100) == []  # alone in their folders
    assert C.pack([], 100) == []


def test_overlapping_runs():
    files = [stored(10, n) for n in "abcdef"]
    ranges = dict(zip([f.path for f in files], [(0, 5), (5, 9), (4, 6), (20, 30), (None, None), (29, 40)], strict=True))
    groups = C.overlapping(files, ranges, 15)
    assert [[f.path[-1] for f in g.files] for g in groups] == [["a", "c", "b"], ["d", "f"]]
    assert [g.into for g in groups] == [2, 2]
    assert C.overlap(ranges) == 3


@pytest.fixture
def table(spark, tmp_path):
    """A folder by day: a large file, small ones, one with another column, a NULL day."""
    path = str(tmp_path / "t")
    large = spark.range(20_000).select("id", F.lit("mon").alias("day"), F.xxhash64("id").alias("v"))
    large.coalesce(1).write.partitionBy("day").parquet(path)
    for k in range(5):
        part = spark.range(k * 10, k * 10 + 30).select("id", F.when(F.col("id") % 3 > 0, "tue").alias("day"), F.lit(k).cast("bigint").alias("v"))
        (part if k else part.withColumn("more", F.lit("x"))).coalesce(1).write.mode("append").partitionBy("day").parquet(path)
    (large.limit(5)).coalesce(1).write.mode("append").partitionBy("day").parquet(path)
    return path


SCHEMA = "id bigint, v bigint, more string, day string"


def held(spark, path):
    return rows(spark.read.schema(SCHEMA).parquet(path))


def test_only_small_files_are_rewritten(spark, table):
    before, content = C.stored_files(spark, table), held(spark, table)
    biggest = max(before, key=lambda f: f.size)
    went, came = C.compact(spark, table, target_bytes=biggest.size)
    after = C.stored_files(spark, table)
    assert (went, came) == (10, 2) and len(after) == len(before) - 8
    assert biggest.path in {f.path for f in after}
    assert held(spark, table) == content
    assert {f.folder for f in after} == {f.folder for f in before}
    assert C.compact(spark, table, target_bytes=biggest.size) == (0, 0)
    read = C._rewritten(spark, [C.Group(after[0].folder, (after[0],), 1)], None).inputFiles()
    assert [f.rpartition("/")[2] for f in read] == [after[0].path.rpartition("/")[2]]


def test_folders_with_awkward_names(spark, tmp_path):
    path = str(tmp_path / "a b%25 t")
    values = [(k, p) for k, p in enumerate(["", "a/b", "a b", "%", "ä", None, "~"])]
    for _ in range(3):
        partitions.append_evolving(spark.createDataFrame(values, "id int, p string").coalesce(1), path, ["p"])
    went, came = C.compact(spark, path)
    assert (went, came) == (21, 7)
    assert rows(partitions.read_evolving(spark, path, "id int, p string", ["p"])) == sorted([repr(v) for v in values] * 3)


def test_overlapping_files_are_sorted_apart(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(4):
        spark.range(k, 4000, 4).coalesce(1).write.mode("append").parquet(path)
    spark.range(10_000, 12_000).coalesce(1).write.mode("append").parquet(path)
    files, content = C.stored_files(spark, path), rows(spark.read.parquet(path))
    first = C._ranges(spark, files, "id")
    apart = next(f for f in files if first[f.path][0] == 10_000)
    assert C.overlap(first) == 6
    assert C.compact(spark, path, target_bytes=apart.size, least_share=0.1, order_by="id")[0] == 4
    after = C.stored_files(spark, path)
    assert C.overlap(C._ranges(spark, after, "id")) == 0
    assert apart.path in {f.path for f in after} and len(after) > 2
    assert rows(spark.read.parquet(path)) == content
    assert C.compact(spark, path, target_bytes=apart.size, least_share=0.1, order_by="id") == (0, 0)


@pytest.mark.parametrize("step", ["write", "move", "delete"])
def test_a_compaction_cut_short_is_finished(spark, table, monkeypatch, step):
    content, calls = held(spark, table), []
    real = C._finish_one

    def broken(spark_, work):
        if step == "write":
            raise RuntimeError("lost")
        new = list(C._new_files(spark_, work))
        path_of, (_, fs) = spark_.sparkContext._jvm.org.apache.hadoop.fs.Path, C._fs(spark_, work)
        folders = C.json.loads(open(work.removeprefix("file:") + "/journal").read())
        moved = new[:1] if step == "move" else new
        for f in moved:
            group = int(f.folder.rpartition("=")[2])
            fs.rename(path_of(f.path), path_of(f"{folders['folders'][group]}/{f.path.rpartition('/')[2]}"))
        if step == "delete":
            fs.delete(path_of(folders["old"][0]), False)
        calls.append(work)
        raise RuntimeError("lost")

    monkeypatch.setattr(C, "_finish_one", broken)
    with pytest.raises(RuntimeError, match="lost"):
        C.compact(spark, table, target_bytes=1 << 30, least_share=1.0)
    monkeypatch.setattr(C, "_finish_one", real)
    assert C.finish(spark, table) == 1
    assert held(spark, table) == content
    assert C.finish(spark, table) == 0 and len(C.stored_files(spark, table)) == 3


def test_work_without_a_journal_is_dropped(spark, table):
    content = held(spark, table)
    spark.range(3).write.parquet(f"{table}/{C.WORK}/x/new")
    assert C.finish(spark, table) == 0
    assert held(spark, table) == content and C.compact(spark, str(table), 1) == (0, 0)


def test_partition_values_are_dealt_into_pieces(spark):
    some = spark.range(9_000).select("id", F.when(F.col("id") < 8_000, F.lit("a")).when(F.col("id") < 8_900, F.lit("")).alias("p"))
    dealt, pieces = partitions.dealt_evenly(some, ["p"], 1_000)
    found = dealt.groupBy("p", partitions.PIECE).count().collect()
    assert pieces == 10 and sorted(r[partitions.PIECE] for r in found) == [*range(10)]
    assert sorted(r["count"] for r in found if r.p is None) == [100]
    assert all(800 < r["count"] < 1_200 for r in found if r.p == "a")
    assert rows(dealt.drop(partitions.PIECE)) == rows(some)
    assert partitions.dealt_evenly(some.limit(0), ["p"], 5)[0].count() == 0


def test_the_written_files_have_a_bounded_size(spark, tmp_path, monkeypatch):
    made = spark.range(60_000).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "xxhash64(id) AS l_partkey", "id / 7 AS l_quantity",
        "CAST(make_date(1998 + CAST(id DIV 10 % 2 AS INT), 3, 1) AS TIMESTAMP_NTZ) AS l_shipdate",
    )
    made.write.parquet(f"{tmp_path}/lineitem.parquet")
    lists, real = [], C.stored_files
    monkeypatch.setattr(C, "stored_files", lambda *a: lists.append(real(*a)) or lists[-1])
    monkeypatch.setattr(W, "FILE_ROWS", 10_000, raising=False)
    found = W.compact_small_files(spark, str(tmp_path))
    large = spark.read.parquet(*[f.path for f in lists[0]]).groupBy("_metadata.file_path").count().collect()
    assert len(large) == len(lists[0]) == 6 and max(r["count"] for r in large) < 10_000
    assert len(lists[1]) == 30 and found.filter("small_went AND large_stayed").count() == 60_000
    assert rows(found.select(*W.LINE_COLUMNS)) == rows(made)
