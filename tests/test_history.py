from __future__ import annotations

import random
from itertools import permutations

import pytest

from keelstone.operators import keys as K
from keelstone.operators.history import splice_history
from keelstone.operators.scd import ScdSpec
from keelstone.plans import load as L
from keelstone.sinks.tables import empty_frame
from tests.util import rows

SPEC = ScdSpec(
    "sk", ("id",), changing=("c",), historical=("h",), fixed=("f",), valid_from="since", valid_to="until", confirmed="again"
)
DIM = "sk bigint, id string, c int, h string, f int, flag boolean, since int, until int, again array<int>, other string"
EVENTS = "id string, c int, h string, f int, at int"


def brute(events):
    """Versions of all events, whatever order they came in."""
    out = []
    for key in sorted({e[0] for e in events}):
        best = {}
        for _, c, h, f, at in [e for e in events if e[0] == key]:
            rank = [(x is not None, x or type(x or 0)()) for x in (h, c, f)]
            if at not in best or rank > best[at][0]:
                best[at] = (rank, h, c, f)
        times = sorted(best)
        groups = []
        for at in times:
            if groups and groups[-1][0] == best[at][1]:
                groups[-1][2].append(at)
            else:
                groups.append((best[at][1], at, []))
        for k, (h, since, again) in enumerate(groups):
            until = groups[k + 1][1] if k + 1 < len(groups) else None
            out.append((key, best[times[-1]][2], h, best[times[0]][3], until is None, since, until, again))
    return sorted(map(repr, out))


def events(seed, count=60):
    made = random.Random(seed)
    return [
        (made.choice("abcde"), made.choice([None, 1, 2, 3]), made.choice([None, "x", "y"]), made.choice([7, 8]), made.randrange(25))
        for _ in range(count)
    ]


def held(dim):
    return rows(dim.select("id", "c", "h", "f", "flag", "since", "until", "again"))


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_deliveries_does_not_matter(spark, seed):
    all_events = events(seed)
    parts = [all_events[k::3] for k in range(3)]
    for order in list(permutations(range(3)))[::2]:
        dim = empty_frame(spark, DIM)
        for k in order:
            dim = splice_history(spark.createDataFrame(parts[k], EVENTS), dim, SPEC, "at").checkpoint()
        assert held(dim) == brute(all_events)
        assert sorted(r.sk for r in dim.select("sk").collect()) == sorted({r.sk for r in dim.select("sk").collect()})
    again = splice_history(spark.createDataFrame(parts[1], EVENTS), dim, SPEC, "at")
    assert rows(again) == rows(dim)  # delivered again, nothing changes


@pytest.mark.parametrize("most", [K.ONE_TASK_ROWS, 0])
def test_late_versions_cut_intervals(spark, monkeypatch, most):
    monkeypatch.setattr(K, "ONE_TASK_ROWS", most)
    first = spark.createDataFrame([("a", 1, "x", 7, 10), ("a", 1, "x", 7, 30), ("b", 1, "x", 7, 5), (None, 1, "x", 7, 5)], EVENTS)
    with pytest.raises(Exception, match="NULL in merge key"):
        splice_history(first, empty_frame(spark, DIM), SPEC, "at").collect()
    dim = splice_history(first, empty_frame(spark, DIM), SPEC, "at", on_null_key="reject").checkpoint()
    assert held(dim) == ["('a', 1, 'x', 7, True, 10, None, [30])", "('b', 1, 'x', 7, True, 5, None, [])"]
    keys = {r.id: r.sk for r in dim.collect()}
    assert keys == {"a": 1, "b": 2}
    late = spark.createDataFrame([("a", 2, "y", 9, 20), ("a", 2, "x", 9, 3)], EVENTS)
    spliced = splice_history(late, dim, SPEC, "at")
    assert held(spliced) == [
        "('a', 1, 'x', 9, False, 3, 20, [10])",
        "('a', 1, 'x', 9, True, 30, None, [])",
        "('a', 1, 'y', 9, False, 20, 30, [])",
        "('b', 1, 'x', 7, True, 5, None, [])",
    ]
    # The version that begins earlier now keeps its key; the others get the next ones by time.
    assert {r.since: r.sk for r in spliced.filter("id = 'a'").collect()} == {3: 1, 20: 3, 30: 4}


def test_inferred_and_open_starts(spark):
    dim = spark.createDataFrame(
        [
            (4, "a", None, None, None, True, 10, None, None, "o"),  # inferred from a fact
            (5, "b", 1, "x", 7, True, None, None, None, "o"),  # valid since ever
            (-1, "-1", None, "Unknown", 0, True, None, None, None, "o"),
        ],
        DIM,
    )
    source = spark.createDataFrame([("a", 1, "x", 7, 20), ("b", 1, "y", 7, 20)], EVENTS)
    found = {(r.id, r.since): (r.sk, r.h, r.until, r.other) for r in splice_history(source, dim, SPEC, "at").collect()}
    assert found == {
        ("a", 10): (4, "x", None, None),
        ("b", None): (5, "x", 20, None),
        ("b", 20): (6, "y", None, None),
        ("-1", None): (-1, "Unknown", None, "o"),
    }


def test_nothing_to_splice(spark):
    empty = spark.createDataFrame([], EVENTS)
    assert splice_history(empty, empty_frame(spark, DIM), SPEC, "at").collect() == []
    dim = spark.createDataFrame([(1, "a", 1, "x", 7, True, 10, None, [12], "o")], DIM)
    assert rows(splice_history(empty, dim, SPEC, "at")) == rows(dim)
    with pytest.raises(ValueError, match="valid_from"):
        splice_history(empty, dim, ScdSpec("sk", ("id",), historical=("h",)), "at")


def test_histories_load_whole_and_by_partition(spark, tmp_path):
    all_events = events(9)
    spec = ScdSpec("sk", ("id",), SPEC.changing, SPEC.historical, SPEC.fixed, "flag", "since", "until", "again")
    options = L.LoadOptions(L.SCD_2, ("id",), scd=spec, effective="at", quarantine=str(tmp_path / "aside"))
    schema = "sk bigint, c int, h string, f int, flag boolean, since int, until int, again array<int>, id string"
    for part in (all_events[::2], [*all_events[1::2], ("", 1, "x", 7, 3), (None, 1, "x", 7, 3), ("a", 1, "x", 7, None)]):
        frame = spark.createDataFrame(part, EVENTS)
        whole = L.load(frame, str(tmp_path / "whole"), schema, options)
        parts = L.load_partitioned(frame, str(tmp_path / "parts"), schema, options, ["id"])
    assert held(whole) == held(parts) == brute([*all_events, ("", 1, "x", 7, 3)])
    reasons = spark.read.parquet(str(tmp_path / "aside")).groupBy("_reason").count()
    assert rows(reasons) == ["('NULL effective time', 2)", "('NULL key', 2)"]
