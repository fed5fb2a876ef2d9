"""Connected components of links, and groups cut into bounded tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm.batches import parallelism
from keelstone.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every end of the links ``a, b``: the smallest id reachable.

    Each round takes the smallest label among the neighbours, then the label of that label,
    until nothing changes; chains shrink by more than half a round. Labels are checkpointed,
    nothing but a count comes to the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.filter("a <> b").distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy("a")
            .agg(F.min("component").alias("near"))
            .withColumnRenamed("a", "id")
        )
        lower = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        of = labels.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        moved = cut_lineage(
            lower.join(of, "next").select("id", F.least("next", "jump").alias("component"), (F.col("component") != F.least("next", "jump")).alias("changed"))
        )
        labels = moved.select("id", "component")
        if not moved.filter("changed").limit(1).count():
            return labels


class Merged:
    """Union of array positions."""

    def __init__(self, size: int) -> None:
        self.label = np.arange(size)

    def join(self, positions: np.ndarray) -> None:
        """One class of all positions and what they were joined with."""
        found = np.unique(self.label[positions])
        if len(found) > 1:
            self.label[np.isin(self.label, found)] = found[0]

    def links(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A link from every member of a class to the smallest id of the class."""
        order = np.lexsort((ids, self.label))
        label, sorted_ids = self.label[order], ids[order]
        start = np.r_[True, label[1:] != label[:-1]] if len(label) else np.zeros(0, bool)
        roots = sorted_ids[np.flatnonzero(start)][np.cumsum(start) - 1]
        far = roots != sorted_ids
        return roots[far], sorted_ids[far]


#: Takes the payloads of a task's rows; gives, for a row's position, the positions similar to it.
Index = Callable[[list], Callable[[int], np.ndarray]]


def similar_links(ids: np.ndarray, payloads: list, queries: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all similar pairs of which one row is a query.

    Two rows of different classes are never both in the largest class: where every row is a
    query, only the rows outside the largest class have to be asked about.
    """
    merged, look = Merged(len(ids)), index(payloads)
    if queries.all():
        waiting = np.ones(len(ids), bool)
        while True:
            largest = np.bincount(merged.label).argmax()
            left = np.flatnonzero(waiting & (merged.label != largest))
            if not len(left):
                break
            waiting[left[0]] = False
            merged.join(look(left[0]))
    else:
        for q in np.flatnonzero(queries).tolist():
            merged.join(look(q))
    return merged.links(ids)


def group_links(rows: DataFrame, payload: str, weight: str, cap: int, index: Index) -> DataFrame:
    """Links ``a, b`` that connect what is similar within each group of ``rows``.

    ``rows`` has ``group, id``, a payload and a weight. ``index`` takes the payloads of a
    task's rows and gives a function from a position to the positions similar to it. No
    similar pair of a group is lost, but only a link to the smallest id of its class is
    returned per row, never all pairs.

    A group whose weights sum up to ``cap`` at most is one task's. A larger one is first
    compared with its smallest id alone, in as many tasks as it needs; then only the rows
    that this has not linked are compared with everything, block by block.
    """
    sizes = rows.groupBy("group").agg(F.sum(weight).alias("_w"), F.min("id").alias("_pivot"), F.count("*").alias("_n"))
    sizes = cut_lineage(sizes.filter("_n > 1"))
    schema = "group long, a long, b long"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        """Rows of a task in runs of equal block."""
        flat = (
            row
            for batch in batches
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j", "query", "id", payload)), strict=True)
        )
        for _, run in groupby(flat, key=lambda r: r[:3]):
            yield list(run)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in blocks(batches):
            ids = np.array([r[4] for r in run], np.int64)
            queries = np.array([r[3] for r in run], bool)
            a, b = similar_links(ids, [r[5] for r in run], queries, index)
            own = pa.array(np.full(len(a), run[0][0], np.int64))
            yield pa.RecordBatch.from_arrays([own, pa.array(a), pa.array(b)], names=["group", "a", "b"])

    tasks = max(parallelism(rows.sparkSession), 1)

    def linked(dealt: DataFrame) -> DataFrame:
        block = ["group", "i", "j"]
        dealt = dealt.select(*block, "query", "id", payload)
        return dealt.repartition(tasks, *block).sortWithinPartitions(*block, "id").mapInArrow(link, schema)

    small = rows.join(sizes.filter(F.col("_w") <= cap).select("group"), "group")
    out = linked(small.withColumns({"i": F.lit(0), "j": F.lit(0), "query": F.lit(True)}))
    hot = sizes.filter(F.col("_w") > cap).withColumn("_blocks", F.ceil(F.col("_w") * 2 / cap).cast("int"))
    if not hot.limit(1).count():
        return out.select("a", "b")
    large = rows.join(hot, "group")
    place = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    pivots = large.filter("id = _pivot").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    star = pivots.withColumn("query", F.lit(True)).unionByName(
        large.filter("id <> _pivot").withColumn("i", place).withColumn("query", F.lit(False))
    )
    star = star.withColumn("j", F.lit(-1))
    near = cut_lineage(linked(star).distinct())
    # Rows that the star has linked need no comparison among each other.
    ends = near.select("group", F.explode(F.array("a", "b")).alias("id")).distinct()
    judged = large.join(ends.withColumn("_tied", F.lit(True)), ["group", "id"], "left").withColumn("_free", F.col("_tied").isNull())
    counts = judged.groupBy("group").agg(
        F.sum(F.when(F.col("_free"), F.col(weight)).otherwise(0)).alias("_wf"),
        F.sum(F.when(F.col("_free"), 0).otherwise(F.col(weight))).alias("_wt"),
    )
    counts = counts.filter("_wf > 0").select(
        "group",
        F.ceil(F.col("_wf") * 2 / cap).cast("int").alias("_bf"),
        F.ceil(F.col("_wt") * 2 / cap).cast("int").alias("_bt"),
    )
    judged = judged.drop("_blocks").join(counts, "group")
    # Free blocks 0 .. bf - 1 meet each other and all tied blocks bf .. bf + bt - 1.
    own = F.when(F.col("_free"), F.pmod(F.xxhash64("id"), F.col("_bf"))).otherwise(
        F.col("_bf") + F.pmod(F.xxhash64("id"), F.greatest(F.col("_bt"), F.lit(1)))
    ).cast("int")
    last = F.when(F.col("_free"), F.col("_bf") + F.col("_bt") - 1).otherwise(F.col("_bf") - 1)
    judged = judged.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    crossed = judged.withColumns(
        {"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other"), "query": F.col("_free")}
    )
    return out.unionByName(near).unionByName(linked(crossed)).select("a", "b")
