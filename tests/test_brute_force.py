"""Random small inputs against plain Python."""

from __future__ import annotations

import random

import pytest

from keelstone.operators import dedupe as D
from keelstone.operators import merge as M
from keelstone.operators import scd as S
from keelstone.operators.keys import assign_surrogate_keys, number_rows
from tests.util import rows

SEEDS = range(4)


def some(rng, values):
    return rng.choice([None, *values])


@pytest.mark.parametrize("seed", SEEDS)
def test_merge(spark, seed):
    rng = random.Random(seed)
    target = {k: (some(rng, "xyz"), some(rng, [1, 2])) for k in rng.sample(range(40), 25)}
    source = {k: (some(rng, "xyz"), some(rng, [1, 2])) for k in rng.sample(range(40), 25)}
    schema = "k int, a string, b int"
    t = spark.createDataFrame([(k, *v) for k, v in target.items()], schema)
    s = spark.createDataFrame([(k, *v) for k, v in source.items()], schema)
    for small in (False, True):
        merged = M.merge(t, s, ["k"], small_source=small)
        assert rows(merged) == sorted(repr((k, *v)) for k, v in (target | source).items())
    inserted = M.insert_missing(t, s, ["k"])
    assert rows(inserted) == sorted(repr((k, *v)) for k, v in (source | target).items())
    updated = M.update_matched(t, s, ["k"], ["b"])
    expected = {k: (a, source[k][1] if k in source else b) for k, (a, b) in target.items()}
    assert rows(updated) == sorted(repr((k, *v)) for k, v in expected.items())


@pytest.mark.parametrize("seed", SEEDS)
def test_latest_and_numbering(spark, seed):
    rng = random.Random(seed)
    # A third of the rows under one key, ties and copies among them.
    data = [(some(rng, "abcd") if i % 3 else "hot", some(rng, range(5)), some(rng, range(3))) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t int, v int").repartition(5)
    latest = {}
    for k, t, v in data:
        rank = (-(t if t is not None else -1), -1 if v is None else v)
        if k not in latest or rank < latest[k][0]:
            latest[k] = (rank, (k, t, v))
    assert rows(D.latest_per_key(df, ["k"], "t")) == sorted(repr(r) for _, r in latest.values())
    distinct = df.distinct()
    order = sorted(set(data), key=lambda r: [(x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r])
    numbered = number_rows(distinct, ["k", "t", "v"], "n")
    assert rows(numbered) == sorted(repr((*r, i + 1)) for i, r in enumerate(order))


@pytest.mark.parametrize("seed", SEEDS)
def test_scd_and_keys(spark, seed):
    rng = random.Random(seed)
    spec = S.ScdSpec("sk", ("k",), changing=("c",), historical=("h",))
    state, versions = {}, []
    for sk, k in enumerate(rng.sample(range(30), 18), start=1):
        if rng.random() < 0.3:
            versions.append((sk + 100, k, some(rng, "xy"), some(rng, "xy"), False))
        state[k] = (sk, k, some(rng, "xy"), some(rng, "xy"), True)
    source = {k: (some(rng, "xy"), some(rng, "xy")) for k in rng.sample(range(30), 18)}
    dim = spark.createDataFrame([*state.values(), *versions], "sk bigint, k int, c string, h string, flag boolean")
    src = spark.createDataFrame([(k, *v) for k, v in source.items()], "k int, c string, h string")

    expected, fresh = [], []
    inferred = {k for k, r in state.items() if r[2] is None and r[3] is None and k in source}
    for sk, k, c, h, flag in versions:
        expected.append((sk, k, *(source[k] if k in inferred else (c, h)), flag))
    for k, (sk, _, c, h, _) in state.items():
        if k not in source:
            expected.append((sk, k, c, h, True))
        elif k in inferred:
            expected.append((sk, k, *source[k], True))
        elif h != source[k][1]:
            expected.append((sk, k, c, h, False))
            fresh.append(k)
        else:
            expected.append((sk, k, source[k][0], h, True))
    fresh += [k for k in source if k not in state]
    highest = max([r[0] for r in [*state.values(), *versions]])
    expected += [(highest + i, k, *source[k], True) for i, k in enumerate(sorted(fresh), start=1)]
    assert rows(S.scd_load(src, dim, spec)) == sorted(map(repr, expected))

    keyed = assign_surrogate_keys(src, dim.filter("flag"), ["k"], "sk")
    top = max(r[0] for r in state.values())
    new = {k: top + i for i, k in enumerate(sorted(k for k in source if k not in state), start=1)}
    assert rows(keyed) == sorted(repr((k, *v, new.get(k) or state[k][0])) for k, v in source.items())
