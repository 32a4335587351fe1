"""Contribution-margin pricing with constant demand elasticity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.numeric import col, let

# Elasticity, lowest price ratio the demand curve is used for, and grid size.
ELASTICITY = -1.15
LOWEST_RATIO = 0.05
GRID_STEPS = 41


def demand_multiplier(price: Column | str, reference_price: Column | str, elasticity: float = ELASTICITY) -> Column:
    """Demand at a price relative to demand at the reference price, null if that is 0."""
    ratio = F.try_divide(col(price), col(reference_price))
    return F.when(ratio.isNotNull(), F.pow(F.greatest(ratio, F.lit(LOWEST_RATIO)), F.lit(elasticity)))


def _grid(min_margin: Column, max_change: float, steps: int) -> dict[str, Column]:
    """Ends and step of the price grid, the margin floor, and whether the whole grid is below it."""
    reference = F.col("reference_price")
    low, high = reference * F.lit(1 - max_change), reference * F.lit(1 + max_change)
    floor = F.col("unit_cost") / (F.lit(1.0) - min_margin)
    return {
        "low": low,
        "high": high,
        "width": (high - low) / F.lit(float(steps - 1)),
        "floor": floor,
        "none_feasible": high < floor,
    }


def _candidate(step: Column, grid: dict[str, Column], steps: int) -> dict[str, Column]:
    """Price at a grid step. Where the whole grid is under the margin floor, the floor is the only price."""
    on_grid = F.when(step == steps - 1, grid["high"]).otherwise(grid["low"] + step * grid["width"])
    return {
        "price": F.when(grid["none_feasible"], grid["floor"]).otherwise(on_grid),
        "feasible": F.when(grid["none_feasible"], step == 0).otherwise(on_grid >= grid["floor"]),
    }


def _margin(min_margin: float | str) -> Column:
    return F.col(min_margin) if isinstance(min_margin, str) else F.lit(min_margin)


def price_grid(
    products: DataFrame,
    min_margin: float | str = 0.20,
    max_change: float = 0.20,
    elasticity: float = ELASTICITY,
    steps: int = GRID_STEPS,
    key: str = "product_id",
) -> DataFrame:
    """Feasible prices of every product with expected demand, revenue and contribution.

    ``products`` has reference_price, base_demand and unit_cost; the margin may
    be a number or the name of a column.
    """
    candidate = _candidate(F.col("step"), _grid(_margin(min_margin), max_change, steps), steps)
    return (
        products.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
        .select("*", *(value.alias(name) for name, value in candidate.items()))
        .filter("feasible")
        .withColumn("demand", F.col("base_demand") * demand_multiplier("price", "reference_price", elasticity))
        .select(
            key,
            "price",
            "demand",
            (F.col("price") * F.col("demand")).alias("revenue"),
            ((F.col("price") - F.col("unit_cost")) * F.col("demand")).alias("contribution"),
        )
    )


def optimize_price(
    products: DataFrame,
    min_margin: float | str = 0.20,
    max_change: float = 0.20,
    elasticity: float = ELASTICITY,
    steps: int = GRID_STEPS,
    key: str = "product_id",
) -> DataFrame:
    """The feasible price with the greatest contribution, the lowest one on ties.

    The grid is priced inside the product's row: nothing is expanded or shuffled.
    A product that can't be priced (no reference price, demand or cost) gets nulls.
    """
    grid = _grid(_margin(min_margin), max_change, steps)

    def price_at(step: Column, ends: Column) -> Column:
        candidate = _candidate(step, {name: ends[name] for name in grid}, steps)
        return F.when(candidate["feasible"], candidate["price"])

    def demand_at(price: Column) -> Column:
        return F.col("base_demand") * demand_multiplier(price, F.col("reference_price"), elasticity)

    def best_of(prices: Column) -> Column:
        worth = F.transform(prices, lambda price: (price - F.col("unit_cost")) * demand_at(price))
        # Prices ascend, so the first of equal contributions is that of the lowest price.
        return let(worth, lambda w: F.get(prices, F.array_position(w, F.array_max(w)).cast("int") - F.lit(1)))

    # The ends of the grid are bound to a name: a lambda works out what it mentions at every mention.
    ends = F.struct(*(value.alias(name) for name, value in grid.items()))
    all_steps = F.sequence(F.lit(0), F.lit(steps - 1))
    prices = let(ends, lambda found: F.transform(all_steps, lambda step: price_at(step, found)))
    best = products.select(key, "unit_cost", "reference_price", "base_demand", let(prices, best_of).alias("best"))
    demand = best.select(key, "unit_cost", "best", F.when(F.col("best").isNotNull(), demand_at(F.col("best"))).alias("demand"))
    return demand.select(
        key,
        F.col("best").alias("recommended_price"),
        F.col("demand").alias("expected_demand"),
        (F.col("best") * F.col("demand")).alias("expected_revenue"),
        ((F.col("best") - F.col("unit_cost")) * F.col("demand")).alias("expected_contribution"),
    )
