"""Cross-tokenizer alignment against all pairs of tokens of each text, compared byte by byte."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.llm import alignment as A

TEXTS = [
    (1, "The quick brown fox, and the  quick fox.\nNaïve café — 12,345!"),
    (2, "the quick fox <s> <|endoftext|> <0x41> é😀x"),
    (2, "the quick fox <s> <|endoftext|> <0x41> é😀x"),
    (3, None),
    (4, ""),
    (5, " "),
    (6, "  \n\t x"),
    (7, "mark ▁ in the text"),
    (8, "a\0b"),
    (9, " ".join(f"word{i % 311}" for i in range(6000))),
    (10, "x" * 3000),
    (None, "the quick fox"),
    (11, "あい 中文 the"),
]


@pytest.fixture(scope="module")
def documents(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    return frame.select("*", *(F.lit(c).alias(c) for c in ("row", "pairs", "n", "a", "n_a", "groups")))


@pytest.fixture(scope="module")
def pair():
    contents = []
    for file in (A.BYTE_VOCABULARY, A.PIECE_VOCABULARY):
        with open(file, "rb") as opened:
            contents.append(opened.read())
    return A.Pair(*contents)


def plain(pair, texts):
    """Every row's numbers, from the tokens' byte ranges."""
    found = []
    for doc_id, text in texts:
        ids_a, ids_b = next(pair.encode([text or ""]))
        ends = [np.cumsum([len(t.spelled[k]) for k in ids]).tolist() for t, ids in zip((pair.bytes_a, pair.bytes_b), (ids_a, ids_b))]
        starts = [[0, *e[:-1]] for e in ends]
        links = Counter()
        low = 0
        for i, a in enumerate(ids_a):
            while low < len(ids_b) and ends[1][low] <= starts[0][i]:
                low += 1
            for j in range(low, len(ids_b)):
                if starts[1][j] >= ends[0][i]:
                    break
                links[a, ids_b[j]] += 1
        groups, at_a, at_b = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            to_a, to_b = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, ids_a[at_a:to_a])) + "|" + ",".join(map(str, ids_b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        found.append((doc_id, ids_a, ids_b, groups, links))
    counts = Counter(link for *_, links in found for link in links)
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    rows = []
    for doc_id, ids_a, ids_b, groups, links in found:
        best = sum(n for (a, b), n in links.items() if counts[a, b] == most[a])
        total = sum(n * counts[link] for link, n in links.items())
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""
        rows.append((doc_id, len(ids_a), len(ids_b), len(groups), sum(links.values()), best, total, digest))
    return sorted(rows, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("limit", [A.SLICE, 150])
def test_whole_operator(documents, pair, limit):
    found = A.align_corpus(documents, spelled=True, limit=limit)
    rows = found.collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str) == plain(pair, TEXTS)
    for r in rows:
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "")


def test_texts_without_tokens(documents):
    rows = {r.doc_id: r for r in A.align_corpus(documents).collect()}
    for doc_id in (3, 4, 7):
        assert (rows[doc_id].n_a, rows[doc_id].n_links, rows[doc_id].groups_sha256) == (0, 0, "")
    assert rows[5].n_a and rows[8].n_a and rows[10].n_a  # a blank, a zero character, one long word


def test_groups_spell_the_text(pair, documents):
    for r in A.align_corpus(documents, spelled=True).where("n_a > 0 AND doc_id <> 2").collect():
        sides = [g.split("|") for g in r.groups.split(";")]
        for side, tokens in enumerate((pair.bytes_a, pair.bytes_b)):
            text = b"".join(tokens.spelled[int(k)] for g in sides for k in g[side].split(","))
            assert text == (" " + dict(TEXTS)[r.doc_id]).encode()


def test_known_windows_are_forgotten(pair):
    batch = [next(pair.encode([text])) for _, text in TEXTS[9:]]
    few, many = A.Aligner(pair, windows=3), A.Aligner(pair)
    for _ in range(3):
        first, second = few.align(batch), many.align(batch)
        assert first.groups == second.groups and np.array_equal(first.n_links, second.n_links)
    assert few.align(batch[:1]).groups == first.groups[:1] and len(few.known) < len(many.known)


def test_byte_encoder_is_that_of_the_vocabulary_file(pair):
    """Splitting into words hangs on the class of each character alone: all of them, in several places."""
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(A.BYTE_VOCABULARY)
    own.encode_special_tokens = True
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        texts = [f" a{c}a 1{c}1 {c}{c} .{c}. \n{c} {c}x" for c in points[k : k + 4000]]
        for text, encoding in zip(texts, own.encode_batch_fast(texts, add_special_tokens=False)):
            assert pair.a.encode_ordinary(text) == encoding.ids
    for text in (" " * 5000 + "a", "x" * 5000, "\n \t" * 3000, "<|endoftext|>", "I'll, we've: it's 12345 ¼ ²", "\r\n\r\n "):
        assert pair.a.encode_ordinary(text) == own.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    found = A.align_corpus(spark.createDataFrame([], "doc_id bigint, text string"))
    assert found.count() == 0
    assert found.drop("groups").columns[0] == "doc_id" and set(found.columns) >= set(COLUMNS)
