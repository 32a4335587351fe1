"""Conversation repair against cheapest paths found by plain search, and against SQL on tables with every edge."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stallwise.llm import conversations as C
from stallwise.llm.oracle import ORACLE

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(symbols) -> tuple[int, str]:
    """Least cost and, among the cheapest edits, the least in ASCII: all paths, state by state."""

    def with_inserts(best):
        for _ in range(4):
            for state, (cost, edits) in list(best.items()):
                to = C.NEXT[state, "a" if state == C.AFTER_U else "u"]
                found = (cost + 5, edits + "I")
                best[to] = min(best.get(to, found), found)
        return best

    best = with_inserts({C.NOTHING: (0, "")})
    for symbol in symbols:
        after = {}
        for state, (cost, edits) in best.items():
            options = [("D", 2, state)]
            if symbol:
                role, cut_off = divmod(symbol - 1, 2)
                initial = "sua?"[role]
                if (state, initial) in C.NEXT:
                    options.append(("K", 5 * cut_off, C.NEXT[state, initial]))
                options += [("R", 1 + 5 * cut_off, C.NEXT[state, r]) for r in "ua" if (state, r) in C.NEXT]
            for letter, more, to in options:
                found = (cost + more, edits + letter)
                after[to] = min(after.get(to, found), found)
        best = with_inserts(after)
    return min(best[s] for s in (C.NOTHING, C.AFTER_A) if s in best)


@pytest.mark.parametrize("seed", range(4))
def test_block_tables_give_the_least_of_the_cheapest_edits(seed):
    draw = random.Random(seed)
    t = C.tables()
    for _ in range(400):
        symbols = np.array([draw.randrange(C.SYMBOLS) for _ in range(draw.randrange(18))], np.int8)
        edits, state, first, gain = C.trace(symbols)
        audit = "".join(letter for found in [*edits, t.end[state]] for letter, _ in found)
        assert (gain + t.vectors[first][C.NOTHING], audit) == cheapest(symbols.tolist())


@pytest.mark.parametrize("seed", range(2))
def test_parts_of_a_conversation_chain_to_the_whole(seed):
    draw = random.Random(seed)
    for _ in range(200):
        symbols = np.array([draw.randrange(C.SYMBOLS) for _ in range(draw.randrange(1, 30))], np.int8)
        cut = draw.randrange(len(symbols) + 1)
        before, gain, leads = C.summarise(symbols[cut:])
        whole, state, first, total = C.trace(symbols)
        left = C.trace(symbols[:cut], behind=int(before[0]))
        right = C.trace(symbols[cut:], behind=0, state=left[1])
        assert left[0] + right[0] == whole and right[1] == state == leads[0][left[1]]
        assert left[2] == first and left[3] + gain[0] == total


def repaired(spark, rows, expected=None):
    frame = spark.createDataFrame(rows, SCHEMA)
    found = C.summary(C.repair(C.damage(frame), copies="copies"))
    db = duckdb.connect()
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype(
        {"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"}
    )
    db.register("conversations_", table)
    db.execute(
        "CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn,"
        " CAST(role AS VARCHAR) AS role, CAST(text AS VARCHAR) AS text FROM conversations_"
    )
    sql = db.execute(ORACLE["op11_conversations"]).df()

    def key(row):
        return tuple("" if pd.isna(x) else str(x) for x in row)

    mine = found.toPandas()
    assert sorted(mine.columns) == sorted(sql.columns)
    columns = sorted(mine.columns)
    mine["conv_id"], sql["conv_id"] = mine["conv_id"].astype("Int64"), sql["conv_id"].astype("Int64")
    assert sorted(map(key, mine[columns].values)) == sorted(map(key, sql[columns].values))
    return mine


def test_random_conversations_with_nulls_ties_and_repeated_rows(spark):
    draw = random.Random(5)
    texts = ["Yes.", "No", "Why?", "", " \n", None, "So!", "é… ", "and . then", "x" * 50_000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    rows = []
    for conv_id in [None, *range(-3, 60)]:
        for turn in range(draw.randrange(1, 12)):
            row = (conv_id, draw.choice([turn, turn, turn, turn * 2, None]), draw.choice(roles), draw.choice(texts))
            rows += [row] * draw.choice([1, 1, 1, 2, 3])
    mine = repaired(spark, rows)
    assert len(mine) == 64 and mine.duplicate.sum() > 20 and mine.audit.str.contains("R").any()


def test_conversations_of_many_sections(spark):
    draw = random.Random(6)
    rows = [(1, turn, draw.choice(["user", "assistant", "system"]), f"{turn % 911}.") for turn in range(0, 4000, 2)]
    rows += [(2, turn * 700, draw.choice(["user", "assistant"]), draw.choice(["a.", "b.", "c", "d."])) for turn in range(-9, 9)]
    rows += [(2, None, "system", "first."), (3, 0, "user", "u."), (3, 5000, "assistant", "a."), (4, 2000, "user", "x.")]
    mine = repaired(spark, rows)
    assert mine.set_index("conv_id").audit.str.len().loc[1] >= 1000


def test_empty_table_and_lost_conversations(spark):
    assert repaired(spark, []).empty
    # The damage drops this conversation's only row.
    gone = next(k for k in range(1000) if __import__("zlib").crc32(f"{k}:0".encode()) % 20 == 0)
    mine = repaired(spark, [(gone, 0, "user", "x.")])
    assert mine[["gaps", "blank", "cost", "audit"]].values.tolist() == [[0, 0, 0, ""]]


def test_repaired_turns_and_clashing_columns(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "b."), (1, 2, "assistant", "b.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame = frame.select("*", *(F.lit(c).alias(c) for c in ("copies", "section", "messages", "marks", "edit", "n", "c")))
    found = C.repair(frame).first()
    edits = [(e.edit, e.times, e.role, e.text) for e in found.edits]
    # The digests of "a." and "b." decide nothing: the turns differ. Rerole is cheaper than an inserted turn.
    assert edits == [("K", 1, "system", "s."), ("R", 1, "user", "a."), ("K", 1, "assistant", "b."), ("D", 1, "assistant", None)]
    assert (found.cost, found.duplicate, found.illegal) == (3, 1, 3)
