from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stallwise.operators import ranking
from stallwise.operators.ranking import Target, interpolated_quantiles, order_statistics, tile_starts, with_tiles


def longs(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v bigint")


def every(rows):
    return range(1, rows + 1)


@pytest.mark.parametrize("buckets", [2, 3, 64, 1 << 16])
def test_every_rank_of_mixed_longs(spark, buckets):
    rng = random.Random(7)
    values = [rng.randrange(-(10**12), 10**12) for _ in range(150)] + [5] * 80 + [-(2**63), 2**63 - 1, 2**63 - 2]
    rows, found = order_statistics(longs(spark, values + [None]), [Target("v", every)], buckets)[0]
    assert rows == len(values)
    assert [found[r].value for r in every(rows)] == sorted(values)
    assert found[sorted(values).index(5) + 1].equal == 80


def test_close_large_longs_stay_apart(spark):
    values = [2**62 + i for i in range(10)]
    _, found = order_statistics(longs(spark, values), [Target("v", every)], 2)[0]
    assert [found[r].value for r in every(10)] == values


@pytest.mark.parametrize("buckets", [2, 64, 1 << 16])
def test_every_rank_of_doubles(spark, buckets):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) * 10 ** rng.randrange(-20, 20) for _ in range(120)] + [0.1] * 30
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    rows, found = order_statistics(frame, [Target("v", every)], buckets)[0]
    assert rows == len(values)
    assert [found[r].value for r in every(rows)] == sorted(values)


def test_doubles_at_the_ends_of_their_range(spark):
    values = [-1.7e308, -0.5, -1e-320, 5e-324, 1e-320, 3.0, 1e300, 1.7e308]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    _, found = order_statistics(frame, [Target("v", every)], 4)[0]
    assert [found[r].value for r in every(len(values))] == values
    with pytest.raises(ValueError, match="infinite"):
        order_statistics(frame.selectExpr("v * 10 AS v"), [Target("v", every)])


def test_ranks_beyond_the_rows_are_left_out(spark):
    assert order_statistics(longs(spark, [3, 1]), [Target("v", lambda n: [0, 2, 3])])[0][1].keys() == {2}
    assert order_statistics(longs(spark, []), [Target("v", lambda n: [1])]) == [(0, {})]


def test_only_numbers_rank(spark):
    with pytest.raises(TypeError):
        order_statistics(spark.createDataFrame([("a",)], "v string"), [Target("v", every)])


def test_groups_rank_apart(spark):
    frame = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(90)], "v bigint, g string")
    a, b = order_statistics(frame, [Target("v", every, "g", "a"), Target("v", every, "g", "b")], 4)
    assert [a[1][r].value for r in every(60)] == [i for i in range(90) if i % 3]
    assert [b[1][r].value for r in every(30)] == list(range(0, 90, 3))


def test_quantile_interpolates(spark):
    frame = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    assert interpolated_quantiles(frame, ["v"], 0.9)["v"] == pytest.approx(61.6)
    assert interpolated_quantiles(frame.filter("v < 0"), ["v"], 0.9) == {"v": None}
    assert interpolated_quantiles(frame.limit(1), ["v"], 0.9) == {"v": 1.0}


@pytest.mark.parametrize("rows", range(13))
def test_tile_starts(rows):
    sizes = [rows // 5 + (t < rows % 5) for t in range(5)]
    starts = tile_starts(rows, 5)
    tiles = [1 + sum(r >= s for s in starts) for r in range(1, rows + 1)]
    assert tiles == [t + 1 for t in range(5) for _ in range(sizes[t])]


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 4, 5, 7, 11, 400])
def test_tiles_equal_ntile(spark, rows):
    rng = random.Random(rows)
    data = [(i * 7919 % 10007, rng.randrange(4), rng.random()) for i in range(rows)]
    frame = spark.createDataFrame(data, "k bigint, few bigint, many double")
    tiled = with_tiles(frame, "k", {"few_tile": "few", "many_tile": "many"}, 5)
    expected = frame.select(
        "k",
        F.ntile(5).over(Window.orderBy("few", "k")).cast("long").alias("few_tile"),
        F.ntile(5).over(Window.orderBy("many", "k")).cast("long").alias("many_tile"),
    )
    got = tiled.select("k", "few_tile", "many_tile")
    assert sorted(got.collect()) == sorted(expected.collect())


def test_one_value_owning_most_rows(spark):
    data = [(k, 1 if k % 10 else k) for k in range(1000)]
    frame = spark.createDataFrame(data, "k bigint, v bigint")
    tiled = with_tiles(frame, "k", {"tile": "v"}, 5).select("k", "tile")
    expected = frame.select("k", F.ntile(5).over(Window.orderBy("v", "k")).cast("long").alias("tile"))
    assert sorted(tiled.collect()) == sorted(expected.collect())


def test_windows_of_the_search_are_partitioned(spark):
    frame = longs(spark, range(10))
    spans = [ranking._Span(0, 0, 9, 0, (3,))]
    targets = [Target("v", every)]
    plan = ranking._counted(frame, targets, *ranking._parts(targets, spans, 4))._jdf.queryExecution().toString()
    assert "Exchange SinglePartition" not in plan
    windows = [ranking._ladder(0, 0, [(2, 3), (7, 8)], 4)]
    plan = ranking._counted(frame, targets, windows, [ranking._Chain(0, 0, (3,))])._jdf.queryExecution().toString()
    assert "Exchange SinglePartition" not in plan


@pytest.mark.parametrize("wrong", [0, 200])
def test_a_wrong_sketch_costs_passes_only(spark, monkeypatch, wrong):
    """Ranks that lie outside the windows are found all the same."""
    values = [x * x for x in range(300)] + [77] * 40
    honest = ranking._extents

    def misled(frame, targets):
        return [replace(e, grid=(e.grid[wrong],) * len(e.grid)) for e in honest(frame, targets)]

    monkeypatch.setattr(ranking, "_extents", misled)
    _, found = order_statistics(longs(spark, values), [Target("v", every)])[0]
    assert [found[r].value for r in every(len(values))] == sorted(values)


def test_sketches_halve_the_passes(spark, monkeypatch):
    """Values over many magnitudes: equal value ranges would put nearly all of them into one bucket at first."""
    rng = random.Random(9)
    values = [int(10 ** (rng.random() * 17)) for _ in range(5000)]
    scans, counted = [], ranking._counted
    monkeypatch.setattr(ranking, "_counted", lambda *a: scans.append(1) or counted(*a))
    frame = longs(spark, values).cache()
    wanted = [500, 2500, 4000]
    _, found = order_statistics(frame, [Target("v", lambda n: wanted)], 4096)[0]
    assert [found[r].value for r in wanted] == [sorted(values)[r - 1] for r in wanted]
    with_sketch = len(scans)
    scans.clear()
    extent = ranking.Extent(len(values), min(values), max(values))
    order_statistics(frame, [Target("v", lambda n: wanted)], 4096, known=[extent])
    assert with_sketch <= 2 < len(scans)
