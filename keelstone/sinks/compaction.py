"""Compaction of a table's small files, and of files whose ranges overlap, in place.

Files are packed into bins from the listing, folder by folder; only the files of a bin are
read and rewritten. A journal beside the new files says which old ones they replace, so that
a compaction that was cut short is finished by the next one, or by :func:`finish`.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORK = "_compaction"
_GROUP, _FILE = "_group", "_file"


@dataclass(frozen=True)
class Stored:
    """A file of the listing; ``uri`` names it as rows that are read from it do."""

    path: str
    folder: str
    size: int
    uri: str = ""


@dataclass(frozen=True)
class Group:
    """Files of one folder that are rewritten together, into so many."""

    folder: str
    files: tuple[Stored, ...]
    into: int


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored_files(spark: SparkSession, path: str) -> list[Stored]:
    """The data files under a path, as the file system lists them; hidden ones are not data."""
    at, fs = _fs(spark, path)
    base = fs.makeQualified(at).toString().rstrip("/")
    found, listing = [], fs.listFiles(at, True)
    while listing.hasNext():
        status = listing.next()
        name = status.getPath().toString()
        inside = name[len(base) + 1 :].split("/")
        if not any(p.startswith((".", "_")) and "=" not in p for p in inside):
            uri = re.sub("^file:/+", "/", status.getPath().toUri().toString())
            found.append(Stored(name, name.rpartition("/")[0], status.getLen(), uri))
    return sorted(found, key=lambda f: f.path)


def pack(files: Sequence[Stored], target_bytes: int, least_share: float = 0.75) -> list[Group]:
    """Small files in bins of at most ``target_bytes``, the largest first into the first that has room.

    Files of ``least_share`` of the target or more stay, as does one that would be alone.
    """
    by_folder = defaultdict(list)
    for f in files:
        if f.size < least_share * target_bytes:
            by_folder[f.folder].append(f)
    groups = []
    for folder, small in sorted(by_folder.items()):
        bins: list[tuple[int, list[Stored]]] = []
        for f in sorted(small, key=lambda f: (-f.size, f.path)):
            at = next((i for i, (used, _) in enumerate(bins) if used + f.size <= target_bytes), None)
            if at is None:
                bins.append((f.size, [f]))
            else:
                bins[at] = (bins[at][0] + f.size, [*bins[at][1], f])
        groups += [Group(folder, tuple(own), 1) for _, own in bins if len(own) > 1]
    return groups


def _uri() -> Column:
    """The file of a row."""
    return F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias(_FILE)


def _ranges(spark: SparkSession, files: Sequence[Stored], column: str) -> dict[str, tuple]:
    """Least and largest value of a column in every file, from that column alone."""
    rows = spark.read.option("mergeSchema", "true").parquet(*[f.path for f in files])
    found = rows.groupBy(_uri()).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    by_file = {r[_FILE]: (r.low, r.high) for r in found.collect()}
    return {f.path: by_file.get(f.uri, (None, None)) for f in files}


def overlapping(files: Sequence[Stored], ranges: dict[str, tuple], target_bytes: int) -> list[Group]:
    """Runs of files of a folder whose ranges overlap, each run to be rewritten in order.

    Files without a value overlap nothing. A file that only touches the next one's border
    does not overlap it.
    """
    by_folder = defaultdict(list)
    for f in files:
        if ranges[f.path][0] is not None:
            by_folder[f.folder].append(f)
    groups = []
    for folder, own in sorted(by_folder.items()):
        own.sort(key=lambda f: (ranges[f.path], f.path))
        run, high = [], None
        for f in [*own, None]:
            if run and (f is None or ranges[f.path][0] >= high):
                if len(run) > 1:
                    groups.append(Group(folder, tuple(run), max(1, -(-sum(x.size for x in run) // target_bytes))))
                run = []
            if f is not None:
                high = ranges[f.path][1] if not run else max(high, ranges[f.path][1])
                run.append(f)
    return groups


def overlap(ranges: dict[str, tuple]) -> int:
    """Pairs of files that overlap: what a filter on the column opens needlessly."""
    known = sorted(r for r in ranges.values() if r[0] is not None)
    return sum(1 for i, (_, high) in enumerate(known) for low, _ in known[i + 1 :] if low < high)


def _rewritten(spark: SparkSession, groups: Sequence[Group], order_by: str | None) -> DataFrame:
    """The rows of the groups' files, a partition for every new file."""
    names = [(f.uri, number) for number, g in enumerate(groups) for f in g.files]
    places = spark.createDataFrame(names, f"{_FILE} string, {_GROUP} int")
    paths = [f.path for g in groups for f in g.files]
    rows = spark.read.option("mergeSchema", "true").parquet(*paths)
    placed = rows.withColumn(_FILE, _uri()).join(places, _FILE).drop(_FILE)
    if order_by is None:
        return placed.repartitionById(len(groups), F.col(_GROUP))
    files = sum(g.into for g in groups)
    return placed.repartitionByRange(files, _GROUP, order_by).sortWithinPartitions(_GROUP, order_by)


def compact(
    spark: SparkSession,
    path: str,
    target_bytes: int = 128 << 20,
    least_share: float = 0.75,
    order_by: str | None = None,
) -> tuple[int, int]:
    """Rewrite small files together; returns how many files went and how many came.

    ``path`` is a folder of parquet files, partitioned or not. With ``order_by`` the files
    whose ranges of that column overlap are rewritten in its order as well, so that filters
    on it open fewer; the others stay as they are. Rows, their folders and all columns stay;
    a column that a file lacks is NULL in its new file.

    One writer at a time. A reader that starts while files are exchanged may see a group
    twice; one that listed the files before has to start again, as without a table format.
    """
    finish(spark, path)
    files = stored_files(spark, path)
    groups = []
    if order_by is not None and files:
        groups = overlapping(files, _ranges(spark, files, order_by), target_bytes)
    taken = {f.path for g in groups for f in g.files}
    small = pack([f for f in files if f.path not in taken], target_bytes, least_share)
    went = came = 0
    for chosen, order in ((groups, order_by), (small, None)):
        if chosen:
            gone, new = _exchange(spark, path, chosen, order)
            went, came = went + gone, came + new
    return went, came


def _exchange(spark: SparkSession, path: str, groups: Sequence[Group], order_by: str | None) -> tuple[int, int]:
    work = f"{path}/{WORK}/{uuid.uuid4().hex}"
    rows = _rewritten(spark, groups, order_by)
    rows.write.partitionBy(_GROUP).parquet(f"{work}/new")
    old = [f.path for g in groups for f in g.files]
    before, after = (spark.read.parquet(*p).count() for p in (old, [f"{work}/new"]))
    if before != after:
        raise RuntimeError(f"{after} rows written for {before}: the table was changed meanwhile")
    at, fs = _fs(spark, f"{work}/journal")
    stream = fs.create(at, True)
    stream.write(json.dumps({"old": old, "folders": [g.folder for g in groups]}).encode())
    stream.close()
    return len(old), _finish_one(spark, work)


def _finish_one(spark: SparkSession, work: str) -> int:
    """Move the new files of a journal in and the old ones out; again, if it was cut short."""
    at, fs = _fs(spark, f"{work}/journal")
    stream = fs.open(at)
    journal = json.loads(bytes(stream.readAllBytes()))
    stream.close()
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    came = 0
    for new in list(_new_files(spark, work)):
        group = int(new.folder.rpartition("=")[2])
        name = new.path.rpartition("/")[2]
        fs.rename(path_of(new.path), path_of(f"{journal['folders'][group]}/{name}"))
        came += 1
    for old in journal["old"]:
        fs.delete(path_of(old), False)
    fs.delete(path_of(work), True)
    return came


def _new_files(spark: SparkSession, work: str) -> Iterator[Stored]:
    _, fs = _fs(spark, work)
    if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{work}/new")):
        yield from stored_files(spark, f"{work}/new")


def finish(spark: SparkSession, path: str) -> int:
    """Finish what earlier compactions wrote a journal for, drop what has none; returns how many finished."""
    at, fs = _fs(spark, f"{path}/{WORK}")
    if not fs.exists(at):
        return 0
    finished = 0
    for status in fs.listStatus(at):
        work = status.getPath().toString()
        journal, _ = _fs(spark, f"{work}/journal")
        if fs.exists(journal):
            _finish_one(spark, work)
            finished += 1
        else:
            fs.delete(status.getPath(), True)
    return finished
