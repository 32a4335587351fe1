from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stallwise.operators import experiments, pricing


@pytest.fixture
def make_sessions(spark):
    def make(*arms: tuple):
        rows = []
        for variant, sessions, won, cancelled, segment in arms:
            rows += [
                (f"{variant}{segment}{i}", variant, int(i < won), 50.0 * (i < won), int(i < cancelled), segment)
                for i in range(sessions)
            ]
        return spark.createDataFrame(
            rows, "session_id string, variant string, converted int, gmv double, cancelled int, segment string"
        )

    return make


def z_test(nc, xc, nt, xt):
    pooled = (xc + xt) / (nc + nt)
    z = (xt / nt - xc / nc) / math.sqrt(pooled * (1 - pooled) * (1 / nc + 1 / nt))
    return z, math.erfc(abs(z) / math.sqrt(2))


def test_readout(make_sessions):
    sessions = make_sessions(("Control", 400, 40, 4, "a"), ("Treatment", 500, 80, 5, "a"))
    row = experiments.experiment_readout(sessions).first()
    z, p = z_test(400, 40, 500, 80)
    assert row.z == pytest.approx(z) and row.p_value == pytest.approx(p, abs=3e-7)
    assert row.lift_pct == pytest.approx(60.0) and row.gmv_per_session == pytest.approx(8.0)
    assert row.decision == "Strong evidence to test rollout"


def test_a_significant_loss_is_not_rolled_out(make_sessions):
    sessions = make_sessions(("Control", 500, 200, 0, "a"), ("Treatment", 500, 100, 0, "a"))
    row = experiments.experiment_readout(sessions).first()
    assert row.p_value < 0.05 and row.decision == "Do not roll out yet"


def test_missing_variant(make_sessions):
    sessions = make_sessions(("Control", 10, 5, 1, "a"))
    assert experiments.experiment_readout(sessions).count() == 0
    assert experiments.experiment_summary(sessions).count() == 1


@pytest.mark.parametrize("converted, z, lift", [(0, 0.0, 0.0), (10, 0.0, 0.0)])
def test_no_variance(make_sessions, converted, z, lift):
    sessions = make_sessions(("Control", 10, converted, 0, "a"), ("Treatment", 10, converted, 0, "a"))
    row = experiments.experiment_readout(sessions).first()
    assert (row.z, row.lift_pct) == (z, lift) and row.p_value == pytest.approx(1.0, abs=1e-6)


def test_no_control_conversion(make_sessions):
    row = experiments.experiment_readout(
        make_sessions(("Control", 10, 0, 0, "a"), ("Treatment", 10, 4, 0, "a"))
    ).first()
    assert row.lift_pct == 0.0 and row.decision == "Do not roll out yet"
    summary = experiments.experiment_summary(make_sessions(("Control", 10, 0, 0, "a"))).first()
    assert summary.cancel_rate is None and summary.conversion_rate == 0.0


def test_segments_are_corrected(make_sessions):
    sessions = make_sessions(
        ("Control", 200, 20, 0, "a"),
        ("Treatment", 200, 34, 0, "a"),
        ("Control", 100, 10, 0, "b"),
        ("Treatment", 100, 10, 0, "b"),
        ("Control", 9, 3, 0, "one-sided"),
    )
    rows = {r.segment: r for r in experiments.experiment_by_segment(sessions, "segment").collect()}
    assert set(rows) == {"a", "b"}
    _, p = z_test(200, 20, 200, 34)
    assert rows["a"].p_value == pytest.approx(p, abs=3e-7)
    assert rows["a"].p_value < 0.05 < rows["a"].p_adjusted
    assert rows["a"].decision == "Do not roll out yet" and rows["b"].p_adjusted == 1.0


def test_guardrails_interval_and_power(make_sessions):
    sessions = make_sessions(("Control", 400, 40, 4, "a"), ("Treatment", 500, 80, 24, "a"))
    rails = {r.guardrail: r for r in experiments.experiment_guardrails(sessions).collect()}
    assert rails["cancel_rate"].deteriorated and not rails["gmv_per_session"].deteriorated
    ci = experiments.experiment_ci(sessions).first()
    half = 1.959964 * math.sqrt(0.1 * 0.9 / 400 + 0.16 * 0.84 / 500)
    assert (ci.ci_low, ci.ci_high) == pytest.approx((0.06 - half, 0.06 + half), abs=1e-6)
    power = experiments.experiment_power(sessions, "segment", mde=0.05).first()
    needed = math.ceil((1.959964 + 0.841621) ** 2 * (0.1 * 0.9 + 0.15 * 0.85) / 0.05**2)
    assert power.required_per_variant == needed and not power.powered


@pytest.fixture
def make_products(spark):
    def make(*rows):
        data = [(i, float(p), float(d), float(c)) for i, (p, d, c) in enumerate(rows)]
        return spark.createDataFrame(
            data, "product_id bigint, reference_price double, base_demand double, unit_cost double"
        )

    return make


def test_demand_falls_when_price_rises(spark):
    low, high = (
        spark.range(1).select(pricing.demand_multiplier(F.lit(float(p)), F.lit(100.0)).alias("m")).first().m
        for p in (100, 120)
    )
    assert high < low == 1.0


def test_margin_floor(make_products):
    row = pricing.optimize_price(make_products((100, 100, 90))).first()
    assert row.recommended_price >= 90 / 0.8
    grid = pricing.price_grid(make_products((100, 100, 90))).collect()
    assert min(r.price for r in grid) >= 112.5 and max(r.price for r in grid) == 120.0


def test_no_feasible_price(make_products):
    products = make_products((100, 100, 110))
    assert pricing.optimize_price(products).first().recommended_price == pytest.approx(137.5)
    assert [r.price for r in pricing.price_grid(products).collect()] == pytest.approx([137.5])


def test_grid_ends(make_products):
    prices = sorted(r.price for r in pricing.price_grid(make_products((100, 10, 1))).collect())
    assert len(prices) == 41 and (prices[0], prices[-1]) == (80.0, 120.0)


@pytest.mark.parametrize("elasticity", [-0.5, -1.0, -1.15, -1.6, -3.0])
@pytest.mark.parametrize("max_change", [0.2, 0.99])
def test_optimum_is_the_best_of_the_grid(make_products, elasticity, max_change):
    rng = random.Random(5)
    products = make_products(*((rng.uniform(50, 500), 100, rng.uniform(1, 600)) for _ in range(120))).cache()
    args = {"elasticity": elasticity, "max_change": max_change}
    best = Window.partitionBy("product_id").orderBy(F.desc("contribution"), "price")
    expected = (
        pricing.price_grid(products, **args)
        .withColumn("rn", F.row_number().over(best))
        .filter("rn = 1")
        .select("product_id", "price", "contribution")
    )
    got = pricing.optimize_price(products, **args).select("product_id", "recommended_price", "expected_contribution")
    assert sorted(got.collect()) == sorted(expected.collect())


def test_margin_may_be_a_column(make_products):
    products = make_products((100, 100, 90), (100, 100, 90)).withColumn(
        "min_margin", F.when(F.col("product_id") == 0, 0.0).otherwise(0.2)
    )
    lowest = pricing.price_grid(products, "min_margin").groupBy("product_id").agg(F.min("price")).collect()
    assert dict(map(tuple, lowest)) == pytest.approx({0: 90.0, 1: 113.0})


def test_products_are_not_shuffled(make_products):
    plan = pricing.optimize_price(make_products((100, 100, 90)))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
