"""Conversation structure repair by the method of Four Russians.

Rows of a conversation, in order, are edited into turns whose role initials read
``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 1, Delete 2 (the only edit for a
blank or repeated row), Insert an empty user or assistant turn 5, and 5 more for a
truncated row that stays.

The states of that pattern are nothing, after s, after u, after a. Before a row stands
a vector of four costs: what the rest costs from each state. Less its minimum it is
one of few (``Tables.vectors``, found from the vector of the end by every row symbol).
Rows are symbols (role by fault, nine of them), and for every block of ``BLOCK`` symbols
and every vector behind it the tables hold the vector before it, the cost gained, and
where each state leads. So a conversation is priced from its end, a lookup a block.
The cheapest edits that read least in ASCII are then traced from the start: each block
is expanded backward, symbol by symbol, from the vector stored behind it, so that at every
row all cheapest edits are known and the least letter among them is taken.

On Spark:

1. Rows meet by conversation and section (``SECTION`` values of turn; rows without a
   turn are a section, the first). A section's distinct messages are collected as a set,
   so copies of one message merge before the shuffle. How often a message occurs, and
   whether it was seen earlier, is counted over keys (ids, turns, roles, digests of
   texts) alone.
2. Sections are summarised by the tables for every vector behind them, so a conversation
   of any length is composed of its sections' summaries: a stream backward for the vectors,
   then forward for the states. Conversations of one section need none of this.
3. Each section is traced by itself. No task holds more than a section's texts.

Rows of one turn are ordered by role, then by the MD5 of their text; copies follow each
other. This decides nothing but the order of ties.

Edge cases: null roles and texts count as one space, so they are blank or of a role that
doesn't fit. A null conv_id is a conversation of its own. Null turns come first. Texts
of any length are treated whole. Repeated rows are repeated messages. Conversations
without rows keep a line with zeros. An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import arrow_rows, let
from stallwise.sources.staging import stage

# Edit costs, and the state that each role initial leads to ("" is not legal there).
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {
    (NOTHING, "s"): AFTER_S,
    (NOTHING, "u"): AFTER_U,
    (AFTER_S, "u"): AFTER_U,
    (AFTER_U, "a"): AFTER_A,
    (AFTER_A, "u"): AFTER_U,
}
ENDS = (NOTHING, AFTER_A)
LEGAL = ("su", "ua", "au")
ROLE = {"u": "user", "a": "assistant"}

GONE = 0  # symbol of a blank or repeated row; the others are 1 + 2 * role + truncated
ROLES = "sua"  # a role with another initial is the fourth
SYMBOLS = 1 + 2 * (len(ROLES) + 1)
BLOCK = 3
SECTION = 1024  # values of turn in a section
BROADCAST_SECTIONS = 1_000_000  # rows of 20 bytes
SECTION_ROWS = 64  # sections sent to Python at a time
# Conversation and section as columns without nulls, so that a join needs no other partitioning than the groups have.
KEY = ("conv", "no_conv", "part", "no_part")
SPACES = " \t\n\v\f\r"


Edits = tuple[tuple[str, str | None], ...]  # letter, and role where the edit sets one


class Tables(NamedTuple):
    """Transitions of normalised cost vectors; ``v`` is the number of the vector behind, ``s`` a state."""

    vectors: list[tuple[int, ...]]  # number 0 is that of the end
    before: np.ndarray  # symbol, v -> vector before the symbol
    gain: np.ndarray  # symbol, v -> cost taken out of it
    edits: list[list[list[tuple[Edits, int]]]]  # symbol, v, s -> least cheapest edits up to the row, state after it
    leads: np.ndarray  # symbol, v, s -> that state
    block_before: np.ndarray  # block, v
    block_gain: np.ndarray
    block_leads: np.ndarray  # block, v, s -> state behind the block
    end: list[Edits]  # s -> edits at the end


def _wanted(state: int) -> str:
    return "a" if state == AFTER_U else "u"


def _closed(costs: list[float]) -> list[float]:
    """With what inserted turns can save."""
    costs = list(costs)
    for _ in range(4):
        for s in range(4):
            costs[s] = min(costs[s], INSERT + costs[NEXT[s, _wanted(s)]])
    return costs


def _row_edits(symbol: int, state: int) -> Iterator[tuple[str, float, int]]:
    """Edits of a row in a state: letter, cost, state after it; in ASCII order of letters."""
    yield "D", DELETE, state
    if symbol == GONE:
        return
    role, cut_off = divmod(symbol - 1, 2)
    if role < len(ROLES) and (state, ROLES[role]) in NEXT:
        yield "K", CUT_OFF * cut_off, NEXT[state, ROLES[role]]
    yield "R", RENAME + CUT_OFF * cut_off, NEXT[state, _wanted(state)]


def _before(symbol: int, behind: tuple[int, ...]) -> list[int]:
    return _closed([min(cost + behind[to] for _, cost, to in _row_edits(symbol, s)) for s in range(4)])


def _traced(symbol: int, behind: tuple[int, ...], state: int) -> tuple[Edits, int]:
    """The least of the cheapest edits from a state up to and with the row, and the state after it."""
    costs, edits = _before(symbol, behind), ()
    while True:
        options = [(letter, cost + behind[to], to) for letter, cost, to in _row_edits(symbol, state)]
        options.append(("I", INSERT + costs[NEXT[state, _wanted(state)]], NEXT[state, _wanted(state)]))
        letter, _, to = min(o for o in options if o[1] == costs[state])
        edits += ((letter, ROLE[_wanted(state)] if letter in "IR" else None),)
        state = to
        if letter != "I":
            return edits, state


@cache
def tables(block: int = BLOCK) -> Tables:
    end_costs = _closed([0 if s in ENDS else float("inf") for s in range(4)])
    vectors = [tuple(end_costs)]
    number = {vectors[0]: 0}
    before, gain = [], []
    for vector in vectors:  # grows as new vectors are met
        for symbol in range(SYMBOLS):
            costs = _before(symbol, vector)
            least = min(costs)
            found = tuple(c - least for c in costs)
            if found not in number:
                number[found] = len(vectors)
                vectors.append(found)
            before.append(number[found])
            gain.append(least)
    before = np.array(before, np.int64).reshape(-1, SYMBOLS).T
    gain = np.array(gain, np.int64).reshape(-1, SYMBOLS).T
    traced = [[[_traced(c, vector, s) for s in range(4)] for vector in vectors] for c in range(SYMBOLS)]
    leads = np.array([[[to for _, to in states] for states in by_vector] for by_vector in traced])

    shape = (SYMBOLS**block, len(vectors))
    block_before, block_gain = np.empty(shape, np.int64), np.empty(shape, np.int64)
    block_leads = np.empty((*shape, 4), np.int64)
    for at, symbols in enumerate(product(range(SYMBOLS), repeat=block)):
        v, total = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        states = np.tile(np.arange(4), (len(vectors), 1))
        for symbol in reversed(symbols):
            states = np.take_along_axis(states, leads[symbol][v], axis=1)
            total, v = total + gain[symbol][v], before[symbol][v]
        block_before[at], block_gain[at], block_leads[at] = v, total, states
    end = []
    for state in range(4):
        edits: Edits = ()
        while state not in ENDS:
            edits, state = (*edits, ("I", ROLE[_wanted(state)])), NEXT[state, _wanted(state)]
        end.append(edits)
    return Tables(vectors, before, gain, traced, leads, block_before, block_gain, block_leads, end)


def _blocks(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """Symbols before the first whole block, and the blocks' numbers; blocks are counted from the end."""
    head = len(symbols) % BLOCK
    places = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
    return symbols[:head].tolist(), (symbols[head:].reshape(-1, BLOCK).astype(np.int64) @ places).tolist()


def summarise(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every vector behind the symbols: vector before, cost gained, and state that each state leads to."""
    t = tables()
    v, total = np.arange(len(t.vectors)), np.zeros(len(t.vectors), np.int64)
    states = np.tile(np.arange(4), (len(t.vectors), 1))
    head, blocks = _blocks(symbols)
    for block in reversed(blocks):
        states = np.take_along_axis(states, t.block_leads[block][v], axis=1)
        total, v = total + t.block_gain[block][v], t.block_before[block][v]
    for symbol in reversed(head):
        states = np.take_along_axis(states, t.leads[symbol][v], axis=1)
        total, v = total + t.gain[symbol][v], t.before[symbol][v]
    return v, total, states


def trace(symbols: np.ndarray, behind: int = 0, state: int = NOTHING) -> tuple[list[Edits], int, int, int]:
    """Edits of each row (turns inserted before it, then its own), the state after all, the vector before the
    first row, and the cost without what that vector says."""
    t = tables()
    head, blocks = _blocks(symbols)
    v, total, after = behind, 0, [behind] * len(blocks)
    for at in range(len(blocks) - 1, -1, -1):
        after[at] = v
        total += int(t.block_gain[blocks[at], v])
        v = int(t.block_before[blocks[at], v])
    edits: list[Edits] = []

    def expand(part: list[int], v: int) -> int:
        nonlocal state
        vectors = []
        for symbol in reversed(part):
            vectors.append(v)  # behind the symbol
            v = int(t.before[symbol, v])
        for symbol, k in zip(part, reversed(vectors)):
            found, state = t.edits[symbol][k][state]
            edits.append(found)
        return v

    first = v
    for symbol in reversed(head):
        total += int(t.gain[symbol, first])
        first = int(t.before[symbol, first])
    expand(head, v)
    for at, end in enumerate(after):
        low = len(head) + at * BLOCK
        expand(symbols[low : low + BLOCK].tolist(), end)
    return edits, state, first, total


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows with faults made by the CRC-32 of ``conv_id:turn``."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % F.lit(20)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """The key of a section and ``marks``: messages that occur more than once, and those seen in an earlier turn."""
    keys = rows.where("copies > 0").select(*KEY, "turn", "role", F.md5("text").alias("digest"), "copies")
    times = stage(keys.groupBy(*KEY, "turn", "role", "digest").agg(F.sum("copies").alias("times")), "messages")
    message = [*KEY[:2], "role", "digest"]
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = times.groupBy(*message).agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("turns"))
    seen = seen.where("turns > 1").drop("turns")
    late = F.coalesce(when > F.col("first"), F.lit(False)).alias("late")
    marks = times.join(seen, message, "left").select(*KEY, "turn", "role", "digest", "times", late)
    mark = F.struct("turn", "role", "digest", "times", "late")
    return marks.where("times > 1 OR late").groupBy(*KEY).agg(F.collect_list(mark).alias("marks"))


def sections(rows: DataFrame) -> DataFrame:
    """Staged: a row per conversation and section with its distinct messages in order, and its summary.

    ``rows`` has ``conv_id, turn, role, text, copies``; none of the last three is null.
    """
    section = F.floor(F.col("turn") / F.lit(SECTION))
    key = [part for c in (F.col("conv_id"), section) for part in (F.coalesce(c, F.lit(0).cast("long")), c.isNull())]
    rows = rows.select(*(part.alias(name) for part, name in zip(key, KEY)), "turn", "role", "text", "copies")
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    message = let(
        end,
        lambda end: F.struct(
            "turn", "role", F.md5("text").alias("digest"), (end == "").alias("blank"),
            end.isin(".", "!", "?").alias("closed"), "text",
        ),
    )
    held = rows.select(*KEY, F.when(F.col("copies") > 0, message).alias("message"))
    held = held.groupBy(*KEY).agg(F.sort_array(F.collect_set("message")).alias("messages"))
    # Both sides lie by this key already.
    held = held.join(_marked(rows), list(KEY), "left")
    named = [F.when(~F.col(KEY[k + 1]), F.col(KEY[k])).alias(name) for k, name in ((0, "conv_id"), (2, "section"))]
    held = held.select(*named, "messages", "marks")
    with arrow_rows(rows.sparkSession, SECTION_ROWS):
        return stage(held.mapInArrow(_summarised, f"{_SECTION}, {_SUMMARY}"), "sections")


_MESSAGE = "struct<turn:bigint,role:string,digest:string,blank:boolean,closed:boolean,text:string>"
_SECTION = f"conv_id bigint, section bigint, messages array<{_MESSAGE}>, symbols binary, times array<bigint>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "extra")
_SUMMARY = (
    ", ".join(f"{c} bigint" for c in _COUNTS) + ", first string, last string, before binary, gain binary, leads binary"
)


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols and times of each section's messages, its counts, and what it does to every vector behind it."""
    for batch in batches:
        lists = batch.column("messages")
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        turns, initials = flat.field("turn"), pc.utf8_slice_codeunits(flat.field("role"), 0, 1).to_pylist()
        blank = flat.field("blank").to_numpy(zero_copy_only=False).astype(bool)
        closed = flat.field("closed").to_numpy(zero_copy_only=False).astype(bool)
        role = np.array([ROLES.find(i) if i else len(ROLES) for i in initials], np.int64) % (len(ROLES) + 1)
        times, late = np.ones(len(flat), np.int64), np.zeros(len(flat), bool)
        for row, marks in enumerate(batch.column("marks").to_pylist()):
            if marks:
                low, high = ends[row], ends[row + 1]
                part = [flat.field(c).slice(low, high - low).to_pylist() for c in ("turn", "role", "digest")]
                place = {key: low + k for k, key in enumerate(zip(*part))}
                for mark in marks:
                    at = place[mark["turn"], mark["role"], mark["digest"]]
                    times[at], late[at] = mark["times"], mark["late"]
        symbols = np.where(blank | late, GONE, 1 + 2 * role + ~closed).astype(np.int8)
        rows = []
        for low, high in zip(ends, ends[1:]):
            here = slice(low, high)
            known = pc.drop_null(turns.slice(low, high - low)).to_numpy()
            pairs = (x + y not in LEGAL for x, y in zip(initials[low : high - 1], initials[low + 1 : high]))
            extra = int((times[here] - 1).sum())
            before, gain, leads = summarise(symbols[here])
            rows.append(
                (
                    symbols[here].tobytes(),
                    times[here],
                    int(times[here][blank[here]].sum()),
                    int(times[here][late[here] & ~blank[here]].sum() + (times[here] - 1)[~late[here] & ~blank[here]].sum()),
                    int((~(blank | late | closed))[here].sum()),
                    sum(pairs) + extra,
                    len(np.unique(known)),
                    int(known.min()) if len(known) else None,
                    int(known.max()) if len(known) else None,
                    extra,
                    initials[low] if high > low else None,
                    initials[high - 1] if high > low else None,
                    before.astype("<i4").tobytes(),
                    gain.astype("<i8").tobytes(),
                    leads.astype("<i1").tobytes(),
                )
            )
        kinds = [pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * len(_COUNTS), *[pa.string()] * 2, *[pa.binary()] * 3]
        names = ["symbols", "times", *_COUNTS, "first", "last", "before", "gain", "leads"]
        found = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("section"), lists, *found], ["conv_id", "section", "messages", *names]
        )


_JOINED = "conv_id bigint, section bigint, behind int, state int, alone boolean, start boolean, final boolean, joint bigint"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vector behind, and state before, each section of conversations whose sections come last first.

    Of the sections met, a few numbers each are kept until the conversation's first one.
    """

    def joined(conv_id, met: list[tuple]) -> pa.RecordBatch:
        rows, state, before = [], NOTHING, None
        for section, behind, leads, first, last in reversed(met):
            joint = int(before is not None and first is not None and before + first not in LEGAL)
            rows.append((conv_id, section, behind, state, False, not rows, len(rows) + 1 == len(met), joint))
            state, before = leads[state], before if last is None else last
        names = [c.split()[0] for c in _JOINED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.bool_()] * 3, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    met: list[tuple] = []
    current, vector = None, 0
    for batch in batches:
        for row in batch.to_pylist():
            if met and row["conv_id"] != current:
                yield joined(current, met)
                met, vector = [], 0
            current = row["conv_id"]
            leads = tuple(np.frombuffer(row["leads"], "<i1").reshape(-1, 4)[vector].tolist())
            met.append((row["section"], vector, leads, row["first"], row["last"]))
            vector = int(np.frombuffer(row["before"], "<i4")[vector])
    if met:
        yield joined(current, met)


def _chain(staged: DataFrame) -> DataFrame:
    """Staged: how the sections of conversations with several of them go together."""
    several = staged.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    links = staged.select("conv_id", "section", "first", "last", "before", "leads")
    links = links.join(several, links["conv_id"].eqNullSafe(several["c"]), "left_semi").repartition("conv_id")
    links = links.sortWithinPartitions("conv_id", F.col("section").desc_nulls_last())
    return stage(links.mapInArrow(_chained, _JOINED), "chained")


_EDIT = pa.struct([("edit", pa.string()), ("times", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each section, with role and text of the turns."""
    t = tables()
    for batch in batches:
        lists = batch.column("messages")
        offset = lists.offsets[0].as_py()
        flat = lists.flatten()
        roles, texts = flat.field("role").to_pylist(), flat.field("text")
        letters, numbers, spoken, source, ends, costs = [], [], [], [], [0], []
        columns = ["symbols", "times", "behind", "state", "start", "final", "extra"]
        rows = zip(lists.offsets.to_numpy() - offset, *(batch.column(c).to_pylist() for c in columns))
        for low, symbols, times, behind, state, start, final, extra in rows:
            edits, state, first, cost = trace(np.frombuffer(symbols, np.int8), behind, state)
            costs.append(cost + DELETE * extra + (t.vectors[first][NOTHING] if start else 0))
            for at, (found, number) in enumerate(zip(edits, times)):
                for letter, role in found:
                    letters.append(letter)
                    numbers.append(1)
                    spoken.append(role or roles[low + at])
                    source.append(None if letter == "I" else low + at)
                if number > 1:  # copies go
                    letters.append("D")
                    numbers.append(number - 1)
                    spoken.append(roles[low + at])
                    source.append(low + at)
            for letter, role in t.end[state] if final else ():
                letters.append(letter)
                numbers.append(1)
                spoken.append(role)
                source.append(None)
            ends.append(len(letters))
        kept = [None if letter == "D" else at for letter, at in zip(letters, source)]
        said = pc.if_else(pc.equal(pa.array(letters, pa.string()), "I"), "", texts.take(pa.array(kept, pa.int64())))
        made = pa.StructArray.from_arrays(
            [pa.array(letters, pa.string()), pa.array(numbers, pa.int64()), pa.array(spoken, pa.string()), said],
            fields=list(_EDIT),
        )
        columns = ["conv_id", "section", "alone", "joint", *_COUNTS]
        found = [*(batch.column(c) for c in columns), pa.array(costs, pa.int64())]
        edits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)
        yield pa.RecordBatch.from_arrays([*found, edits], [*columns, "cost", "edits"])


def repair(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """The edits that repair conversations: per conversation and section ``edits``, ``cost``, and counts of faults.

    ``edits`` lists ``edit, times, role, text`` in order: the repaired conversation is those that aren't D, in
    the order of their sections (null first). ``rows`` has ``conv_id, turn, role, text``; ``copies`` names a
    column that says how many rows one stands for. ``alone`` marks the only section of a conversation.
    """
    number = F.lit(1) if copies is None else F.col(copies)
    space = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    conv_id, turn = (F.col(c).cast("long").alias(c) for c in ("conv_id", "turn"))
    staged = sections(rows.select(conv_id, turn, *space, number.cast("long").alias("copies")))
    chained = _chain(staged)
    links = chained.select(*(F.col(c).alias(f"in_{c}") for c in chained.columns))
    here = staged["conv_id"].eqNullSafe(links["in_conv_id"]) & staged["section"].eqNullSafe(links["in_section"])
    small = links.count() <= BROADCAST_SECTIONS
    whole = staged.join(F.broadcast(links) if small else links, here, "left")
    alone = {"behind": 0, "state": NOTHING, "alone": True, "start": True, "final": True, "joint": 0}
    whole = whole.select(*staged.columns, *(F.coalesce(f"in_{c}", F.lit(v)).alias(c) for c, v in alone.items()))
    schema = (
        "conv_id bigint, section bigint, alone boolean, joint bigint, "
        + ", ".join(f"{c} bigint" for c in (*_COUNTS, "cost"))
        + ", edits array<struct<edit:string,times:bigint,role:string,text:string>>"
    )
    with arrow_rows(rows.sparkSession, SECTION_ROWS):
        return stage(whole.mapInArrow(_repaired, schema), "repaired")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of conversations whose sections come in order; texts pass through, one batch at a time."""

    def row(conv_id, audit: list[str], digest) -> pa.RecordBatch:
        columns = [pa.array([conv_id], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, ["c", "audit", "repaired_sha256"])

    current, audit, digest, begun = None, None, None, False
    for batch in batches:
        for conv_id, piece, lines in zip(*(batch.column(c) for c in ("conv_id", "audit", "lines"))):
            if audit is None or conv_id.as_py() != current:
                if audit is not None:
                    yield row(current, audit, digest)
                current, audit, digest, begun = conv_id.as_py(), [], hashlib.sha256(), False
            audit.append(piece.as_py())
            for line in lines.values:
                digest.update((b"\n" if begun else b"") + line.as_buffer().to_pybytes())
                begun = True
    if audit is not None:
        yield row(current, audit, digest)


def summary(repaired: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id``, gaps, counts of faults, cost, audit, and the digest of its repaired lines.

    A SHA-256 is taken in order, so the lines of a conversation of several sections pass through one task, as a
    stream; those of one section are hashed where they are.
    """
    lines = F.transform(
        F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"])
    )
    audit = F.expr("array_join(transform(edits, e -> repeat(e.edit, int(e.times))), '')")
    sums = {c: F.col(c) for c in ("blank", "duplicate", "truncated", "cost")}
    gaps = F.coalesce(F.col("high") - F.col("low") + F.lit(1) - F.col("turns"), F.lit(0).cast("long"))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    one = repaired.where("alone").select(
        "conv_id", gaps.alias("gaps"), *sums, "illegal", audit.alias("audit"),
        F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )
    several = repaired.where("NOT alone")
    counts = several.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost", "turns")),
        F.sum(F.col("illegal") + F.col("joint")).alias("illegal"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    pieces = several.select("conv_id", "section", audit.alias("audit"), lines.alias("lines")).repartition("conv_id")
    pieces = pieces.sortWithinPartitions("conv_id", "section").select("conv_id", "audit", "lines")
    hashed = pieces.mapInArrow(_hashed, "c bigint, audit string, repaired_sha256 string")
    counts = counts.join(hashed, counts["conv_id"].eqNullSafe(hashed["c"])).withColumn("gaps", gaps)
    return one.select(*names).unionByName(counts.select(*names))
