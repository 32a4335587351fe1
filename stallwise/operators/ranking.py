"""Exact global ranks without a global sort.

A window without PARTITION BY moves every row to one task. Quantiles and tile
numbers need far less than a full ranking: only the values at a few ranks.

The first pass sketches every wanted column (KLL, mergeable, a few KB) next to its extent.
The sketches say within a percent or so where the wanted ranks lie; the second pass counts
rows per value range there, and just counts what lies between. Where a range still holds
several values the next pass descends into it, and where a sketch was wrong, which it
may be, the rank is found in between: the counts are exact, the sketch only saves passes.

Every pass is one scan with map-side counting for all columns at once; no task ever sees
more than ``BUCKETS`` groups per range, and equal values always share a group, so hot
values cost nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SKETCH = 1000  # items a level of a sketch keeps: its ranks are within about 0.5 %
GRID = 256  # quantiles read off a sketch
SLACK = 3  # steps of that grid to look on either side of a rank
_EXACT_DOUBLE = 1 << 53

Ranks = Callable[[int], Sequence[int]]
Number = int | float


@dataclass(frozen=True)
class Target:
    """Ranks (from 1, ascending) wanted of a long or double column.

    ``ranks`` gets the number of ranked rows and names the wanted ones. With
    ``by``, only rows where that column has ``value`` are ranked. Nulls and NaN
    have no rank. Of a ``tie`` column, a long, the least and greatest value are
    found as well among the rows that equal the one at a rank.
    """

    column: str
    ranks: Ranks
    by: str | None = None
    value: Any = None
    tie: str | None = None

    def member(self) -> Column:
        return F.lit(True) if self.by is None else F.col(self.by).eqNullSafe(F.lit(self.value))


@dataclass(frozen=True)
class Found:
    """The value at a rank, how many rows are below it and how many equal it."""

    value: Number
    below: int
    equal: int
    ties: tuple[int, int] | None = None


@dataclass(frozen=True)
class Extent:
    """How many values there are, the least and the greatest, quantiles in between, and those of the tie column."""

    rows: int
    lo: Number | None
    hi: Number | None
    grid: tuple[Number, ...] = ()
    ties: tuple[int, int] | None = None


@dataclass(frozen=True)
class _Span:
    """A range of one target's values known to hold some of its ranks."""

    target: int
    lo: Number
    hi: Number
    below: int
    ranks: tuple[int, ...]


def _kind(frame: DataFrame, column: str) -> str:
    kind = frame.schema[column].dataType.simpleString()
    if kind not in ("bigint", "double"):
        raise TypeError(f"rank over bigint or double, not {kind} ({column})")
    return kind


def _ranked(frame: DataFrame, column: str) -> Column:
    """The column with null for every value that has no rank."""
    value = F.col(column)
    return value if _kind(frame, column) == "bigint" else F.when(~F.isnan(value), value)


# Spans become SQL text: one expression to parse instead of dozens of column calls.


def _text(number: Number) -> str:
    return f"{number}L" if isinstance(number, int) else f"{number!r}D"


def _bucket(span: _Span, buckets: int) -> str:
    """Position of a value in the span; the ends fall in different buckets, order is kept."""
    lo, width = span.lo, span.hi - span.lo
    if isinstance(lo, int):
        if width < buckets:
            return f"v - {_text(lo)}"
        if width < _EXACT_DOUBLE:
            share = f"double(v - {_text(lo)}) / {_text(float(width))}"
        else:
            share = f"(double(v) - {_text(float(lo))}) / {_text(float(span.hi) - float(lo))}"
    elif math.isinf(lo) or math.isinf(span.hi):
        raise ValueError("cannot rank infinite values")
    elif math.isinf(width):
        share = f"(v / 2 - {_text(lo / 2)}) / {_text(span.hi / 2 - lo / 2)}"
    else:
        share = f"(v - {_text(lo)}) / {_text(width)}"
    return f"least(floor({share} * {_text(float(buckets))}), {_text(buckets - 1)})"


@dataclass(frozen=True)
class _Part:
    """Ranges of which a row falls into at most one: of one target, or of targets that exclude each other.

    ``slot`` is SQL for the range of a value ``v`` of group ``g``, ``places`` SQL for the bucket in each range. A chain
    is a run of ranges that are counted through: (target, rows below it, wanted ranks); ``chains`` has that of each range.
    """

    members: tuple[int, ...]
    slot: str
    places: tuple[str, ...]
    chains: tuple[int, ...]


@dataclass(frozen=True)
class _Chain:
    target: int
    below: int
    ranks: tuple[int, ...]


def _windows(extent: Extent, ranks: Sequence[int]) -> list[tuple[Number, Number]]:
    """Ranges of values that should hold the ranks, by the sketch: ascending and apart."""
    found: list[tuple[Number, Number]] = []
    for r in ranks:
        low = math.floor((r - 1) / extent.rows * GRID) - SLACK
        high = math.ceil(r / extent.rows * GRID) + SLACK
        lo = extent.grid[low] if low > 0 else extent.lo
        hi = extent.grid[high] if high < GRID else extent.hi
        if found and lo <= found[-1][1]:
            lo, hi = found[-1][0], max(hi, found[-1][1])
            found.pop()
        found.append((lo, hi))
    return found


def _ladder(target: int, chain: int, windows: list[tuple[Number, Number]], buckets: int) -> _Part:
    """A part over all values of a target: its windows in buckets, and what lies before, between and behind as one each."""
    whens, places = [], []
    for i, (lo, hi) in enumerate(windows):
        whens += [f"WHEN v < {_text(lo)} THEN {2 * i}", f"WHEN v <= {_text(hi)} THEN {2 * i + 1}"]
        places += ["0", "0" if lo == hi else _bucket(_Span(target, lo, hi, 0, ()), buckets)]
    slot = f"CASE WHEN v IS NULL OR g IS NULL THEN NULL {' '.join(whens)} ELSE {2 * len(windows)} END"
    places.append("0")
    return _Part((target,), slot, tuple(places), (chain,) * len(places))


def _parts(targets: Sequence[Target], spans: Sequence[_Span], buckets: int) -> tuple[list[_Part], list[_Chain]]:
    """The search inside ranges that are known to hold ranks."""
    groups: dict[tuple, list[_Span]] = {}
    for span in spans:
        # Without ``by`` each target has the column to itself; with it, groups exclude each other.
        t = targets[span.target]
        groups.setdefault((t.column, t.by) if t.by else (span.target,), []).append(span)
    parts, chains = [], []
    for members in groups.values():
        slot = " ".join(
            f"WHEN g = {s.target} AND v BETWEEN {_text(s.lo)} AND {_text(s.hi)} THEN {i}" for i, s in enumerate(members)
        )
        numbers = tuple(range(len(chains), len(chains) + len(members)))
        places = tuple(_bucket(s, buckets) for s in members)
        parts.append(_Part(tuple(sorted({s.target for s in members})), f"CASE {slot} END", places, numbers))
        chains += [_Chain(s.target, s.below, s.ranks) for s in members]
    return parts, chains


def _counted(
    frame: DataFrame, targets: Sequence[Target], parts: Sequence[_Part], chains: Sequence[_Chain]
) -> DataFrame:
    """The buckets that hold the wanted ranks: chain, rows before it in the chain, rows, extents of value and ties."""
    ties = sorted({targets[t].tie for part in parts for t in part.members} - {None})
    rows = []
    for number, part in enumerate(parts):
        first = targets[part.members[0]]
        group = reduce(
            lambda whens, t: whens.when(targets[t].member(), t),
            part.members[1:],
            F.when(first.member(), part.members[0]),
        )
        value = _ranked(frame, first.column)
        long = _kind(frame, first.column) == "bigint"
        rows.append(
            F.struct(
                F.lit(number).alias("part"),
                group.alias("g"),
                (value if long else F.lit(None).cast("bigint")).alias("whole"),
                (F.lit(None).cast("double") if long else value).alias("broken"),
            )
        )
    # A row of the scan gives one row for each part, before the partial count.
    each = frame.select(*ties, F.explode(F.array(*rows)).alias("row")).select(*ties, "row.*")
    typed = {True: "whole", False: "broken"}

    def of_part(text: str, number: int, part: _Part) -> str:
        long = _kind(frame, targets[part.members[0]].column) == "bigint"
        return f"WHEN {number} THEN " + re.sub(r"\bv\b", typed[long], text)

    slots = " ".join(of_part(part.slot, n, part) for n, part in enumerate(parts))
    places = " ".join(
        of_part(f"CASE slot {' '.join(f'WHEN {i} THEN {p}' for i, p in enumerate(part.places))} END", n, part)
        for n, part in enumerate(parts)
    )
    chain = " ".join(
        f"WHEN {n} THEN CASE slot {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(part.chains))} END"
        for n, part in enumerate(parts)
    )
    holds = " OR ".join(
        f"chain = {i} AND before < {r - c.below} AND before + n >= {r - c.below}"
        for i, c in enumerate(chains)
        for r in c.ranks
    )
    slotted = each.withColumn("slot", F.expr(f"CASE part {slots} END")).where("slot IS NOT NULL")
    bucketed = slotted.withColumn("bucket", F.expr(f"CAST(CASE part {places} END AS BIGINT)"))
    counted = bucketed.groupBy("part", "slot", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        *(f(c).alias(f"{name}_{c}") for c in ("whole", "broken", *ties) for name, f in (("lo", F.min), ("hi", F.max))),
    )
    # At most BUCKETS rows a range, and one for what lies between ranges, reach this window.
    upto = F.sum("n").over(Window.partitionBy("chain").orderBy("slot", "bucket"))
    numbered = counted.withColumn("chain", F.expr(f"CASE part {chain} END")).withColumn("before", upto - F.col("n"))
    return numbered.where(holds)


def _read(frame: DataFrame, target: Target, row: Row) -> Extent:
    """The extent of a bucket."""
    kind = "whole" if _kind(frame, target.column) == "bigint" else "broken"
    ties = (row[f"lo_{target.tie}"], row[f"hi_{target.tie}"]) if target.tie else None
    return Extent(row.n, row[f"lo_{kind}"], row[f"hi_{kind}"], ties=ties)


def _extents(frame: DataFrame, targets: Sequence[Target]) -> list[Extent]:
    """Ranked rows, extent and sketched quantiles of every target, in one scan."""
    sums = []
    shares = F.array(*(F.lit(i / GRID) for i in range(GRID + 1)))
    for i, t in enumerate(targets):
        v = F.when(t.member(), _ranked(frame, t.column)) if t.by else _ranked(frame, t.column)
        kind = _kind(frame, t.column)
        sketch, quantile = getattr(F, f"kll_sketch_agg_{kind}"), getattr(F, f"kll_sketch_get_quantile_{kind}")
        sums += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        sums.append(F.when(F.count(v) > 0, quantile(sketch(v, SKETCH), shares)).alias(f"grid{i}"))
        if t.tie:
            tie = F.when(v.isNotNull(), F.col(t.tie))
            sums += [F.min(tie).alias(f"tie_lo{i}"), F.max(tie).alias(f"tie_hi{i}")]
    row = frame.agg(*sums).first()
    return [
        Extent(
            row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"], tuple(row[f"grid{i}"] or ()),
            (row[f"tie_lo{i}"], row[f"tie_hi{i}"]) if t.tie else None,
        )
        for i, t in enumerate(targets)
    ]


def order_statistics(
    frame: DataFrame, targets: Sequence[Target], buckets: int = BUCKETS, known: Sequence[Extent] | None = None
) -> list[tuple[int, dict[int, Found]]]:
    """Ranked rows of each target and the exact values at its wanted ranks.

    Ranks beyond the rows are left out. ``frame`` is read once per pass and must
    not change between passes: stage it first. Only one row per wanted rank comes
    back to the driver. Targets whose extents are ``known`` need no first pass.
    """
    if not targets:
        return []
    found: list[dict[int, Found]] = [{} for _ in targets]
    spans: list[_Span] = []

    def settle(target: int, extent: Extent, below: int, ranks: Sequence[int]) -> bool:
        """Record a range holding a single value; keep any other for the next pass."""
        if extent.lo == extent.hi:
            found[target].update({r: Found(extent.lo, below, extent.rows, extent.ties) for r in ranks})
            return True
        if extent.rows == 2:  # the least and the greatest
            ends = {1: Found(extent.lo, below, 1), 2: Found(extent.hi, below + 1, 1)}
            found[target].update({r: ends[r - below] for r in ranks})
            return True
        if any(isinstance(end, float) and math.isinf(end) for end in (extent.lo, extent.hi)):
            raise ValueError("cannot rank infinite values")
        spans.append(_Span(target, extent.lo, extent.hi, below, tuple(ranks)))
        return False

    extents = list(known) if known is not None else _extents(frame, targets)
    parts, chains = [], []
    for i, (target, extent) in enumerate(zip(targets, extents)):
        ranks = sorted({r for r in target.ranks(extent.rows) if 1 <= r <= extent.rows})
        if ranks and not settle(i, extent, 0, ranks) and extent.grid:
            spans.pop()
            windows = _windows(extent, ranks)
            parts.append(_ladder(i, len(chains), windows, max(2, buckets // len(windows))))
            chains.append(_Chain(i, 0, tuple(ranks)))
    while parts or spans:
        if not parts:
            parts, chains = _parts(targets, spans, buckets)
            spans.clear()
        for row in _counted(frame, targets, parts, chains).collect():
            chain = chains[row.chain]
            below = chain.below + row.before
            inside = [r for r in chain.ranks if below < r <= below + row.n]
            settle(chain.target, _read(frame, targets[chain.target], row), below, inside)
        parts, chains = [], []
    return [(extent.rows, at) for extent, at in zip(extents, found)]


def interpolated_quantiles(frame: DataFrame, columns: Sequence[str], q: float) -> dict[str, float | None]:
    """Quantile of each column with linear interpolation between neighbours; null without values."""

    def around(rows: int) -> list[int]:
        at = q * (rows - 1)
        return [math.floor(at) + 1, math.ceil(at) + 1]

    limits: dict[str, float | None] = {}
    for c, (rows, values) in zip(columns, order_statistics(frame, [Target(c, around) for c in columns])):
        if not values:
            limits[c] = None
            continue
        low, high = (values[r].value for r in around(rows))
        at = q * (rows - 1)
        limits[c] = low + (high - low) * (at - math.floor(at))
    return limits


def values_at(frame: DataFrame, column: str, ranks: Ranks) -> list[Number]:
    """Values of one staged column at the given ranks, which must exist."""
    rows, found = order_statistics(frame, [Target(column, ranks)])[0]
    return [found[r].value for r in ranks(rows)]


def tile_starts(rows: int, tiles: int) -> list[int]:
    """First rank of the second, third, … tile when ``rows`` are dealt into ``tiles``.

    Tiles differ by at most one row, the larger ones coming first. Tiles that
    stay empty begin beyond the last rank.
    """
    size, larger = divmod(rows, tiles)
    sizes = [size + (t < larger) for t in range(tiles)]
    starts = [1]
    for s in sizes[:-1]:
        starts.append(starts[-1] + s)
    return [start if s else rows + 1 for start, s in zip(starts[1:], sizes[1:])]


def with_tiles(frame: DataFrame, key: str, scores: dict[str, str], tiles: int = 5) -> DataFrame:
    """Add one tile number per ``{score: column}``, ranking by (column, key) ascending.

    Equal to ``ntile(tiles)`` over that order. ``frame`` must be staged, ``key``
    a unique long, and the ranked columns long or double without nulls.
    """
    columns = list(scores.values())
    wanted = [Target(c, lambda n: tile_starts(n, tiles), tie=key) for c in columns]
    cuts = [at for _, at in order_statistics(frame, wanted)]
    # A tile may begin among rows of equal value; there the key decides.
    ties: dict[tuple[str, Number], tuple[Extent, list[int]]] = {}
    for column, values in zip(columns, cuts):
        for start, at in values.items():
            if start - at.below > 1:
                extent = Extent(at.equal, *at.ties)
                ties.setdefault((column, at.value), (extent, []))[1].append(start - at.below)
    in_tie = [Target(key, lambda _, ranks=ranks: ranks, column, value) for (column, value), (_, ranks) in ties.items()]
    known = [extent for extent, _ in ties.values()]
    tie_keys = dict(zip(ties, (at for _, at in order_statistics(frame, in_tie, known=known))))

    def reached(column: str, start: int, at: Found) -> str:
        rank = start - at.below
        if rank == 1:
            return f"`{column}` >= {_text(at.value)}"
        cut = _text(tie_keys[column, at.value][rank].value)
        return f"`{column}` > {_text(at.value)} OR `{column}` = {_text(at.value)} AND `{key}` >= {cut}"

    def tile(column: str, values: dict[int, Found]) -> Column:
        return F.expr(" + ".join(["1L", *(f"bigint({reached(column, start, at)})" for start, at in values.items())]))

    return frame.select("*", *(tile(c, values).alias(score) for (score, c), values in zip(scores.items(), cuts)))
