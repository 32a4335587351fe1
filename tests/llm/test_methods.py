"""Operators that SQL doesn't express, against brute-force versions, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallwise.llm import jaccard, languages, materialise, mixing, pseudonyms, queries, shingles, toxicity, warc
from stallwise.llm.components import components
from stallwise.sources.staging import stage

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


def brute_shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("chunk", [7, 100, 256_000])
def test_shingle_sets(monkeypatch, chunk):
    monkeypatch.setattr(shingles, "CHUNK_BYTES", chunk)
    draw = random.Random(1)
    parts = ["a", "B", "É", "é", " ", "\t", "\n", "  ", "ab", "Ab", "\x0b", "\x1c"]
    texts = [None, "", " ", "x"] + ["".join(draw.choices(parts, k=draw.choice([3, 20, 200, 900]))) for _ in range(300)]
    sets, found = [brute_shingles(t) for t in texts], list(shingles.shingle_sets(pa.array(texts)))
    assert [len(f) for f in found] == [len(s) for s in sets]
    for _ in range(500):
        i, j = draw.randrange(len(texts)), draw.randrange(len(texts))
        assert len(np.intersect1d(found[i], found[j])) == len(sets[i] & sets[j])


def brute_components(texts):
    sets = {i: brute_shingles(t) for i, t in texts.items()}
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i: root(i) for i in ids}


def near_copies(seed):
    """Chains and cliques of near copies, many of them close to the limit, and a passage that most texts share."""
    draw = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts, number = {}, 0
    for family in range(14):
        words = [f"f{family}x{i}" for i in range(draw.choice([8, 30, 90, 200]))]
        words = passage + words if draw.random() < 0.6 else words
        for _ in range(draw.choice([1, 2, 6, 15])):
            if draw.random() < 0.7:
                words = list(words)
                for _ in range(draw.choice([1, 1, 2, 5])):
                    words[draw.randrange(len(words))] = f"e{number}x{draw.randrange(10**6)}"
            texts[number] = " ".join(words)
            number += 1
    order = list(texts)
    draw.shuffle(order)
    return {new: texts[old] for new, old in enumerate(order)}


@pytest.mark.parametrize("seed", range(4))
def test_jaccard_join_loses_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "LEAST_HEAVY", 3)
    texts = near_copies(seed)
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame).collect()}
    low = brute_components(texts)
    assert found == {i: (len(brute_shingles(t)), low[i]) for i, t in texts.items()}


def template_families(seed, families, size, changed):
    """Texts of templates within a template, most too far from each other; some near copies of them."""
    draw = random.Random(seed)
    whole = [f"t{i}" for i in range(400)]
    texts = []
    for family in range(families):
        template = list(whole)
        for place in draw.sample(range(400), 6 if families > 1 else 0):
            template[place] = f"f{family}p{place}"
        for member in range(size):
            words = list(template)
            for place in draw.sample(range(400), changed):
                words[place] = f"f{family}m{member}p{place}"
            texts.append(" ".join(words))
            if draw.random() < 0.1:
                words[draw.randrange(400)] = f"near{len(texts)}"
                texts.append(" ".join(words))
    draw.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("families, size, changed", [(1, 150, 5), (3, 50, 4), (1, 60, 3)])
def test_families_of_a_template_do_not_cost_their_pairs(spark, monkeypatch, families, size, changed):
    monkeypatch.setattr(jaccard, "LEAST_HEAVY", 3)
    monkeypatch.setattr(jaccard, "PAIRED", 8)
    pairs, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda d, p: pairs.append(p.count()) or verified(d, p))
    texts = template_families(7, families, size, changed)
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame).collect()}
    assert found == brute_components(texts)
    assert sum(pairs) < 12 * len(texts)


@pytest.mark.parametrize("seed", range(2))
def test_ids_with_several_texts_lose_no_link(spark, monkeypatch, seed):
    """Rows that share an id are one document: it is linked by any of its texts."""
    monkeypatch.setattr(jaccard, "LEAST_HEAVY", 3)
    monkeypatch.setattr(jaccard, "PAIRED", 4)
    draw = random.Random(seed)
    texts = [*near_copies(seed).values(), *template_families(seed, 1, 20, 5).values()]
    rows = [(draw.randrange(len(texts) * 2 // 3), text) for text in texts]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame).collect()}
    whole = brute_components(dict(enumerate(texts)))
    low = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed, least = False, {}
        for (i, _), c in zip(rows, (whole[k] for k in range(len(rows)))):
            least[c] = min(least.get(c, low[i]), low[i])
        for (i, _), c in zip(rows, (whole[k] for k in range(len(rows)))):
            if least[c] < low[i]:
                low[i], changed = least[c], True
    assert found == low


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    low = {i: i for edge in edges for i in edge}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(low[a], low[b])
            changed |= (low[a], low[b]) != (least, least)
            low[a] = low[b] = least
    assert found == {i: c for i, c in low.items() if i != c}


@pytest.mark.parametrize("count", [1, 2, 3, 17, 1000, 65_537])
def test_slots_are_a_permutation(count):
    made = materialise.slots(np.arange(count), count)
    assert sorted(made.tolist()) == list(range(count))
    if count > 100:
        assert (made != np.arange(count)).mean() > 0.9
        assert made.tolist() != materialise.slots(np.arange(count), count, key=1).tolist()


def test_shards_hold_the_corpus_in_keyed_order(spark, tmp_path):
    length, per_shard = 128, 64
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(3, "doc_id")
    stream = materialise.tokenise(documents)
    path = f"file://{tmp_path}/shards"
    count = materialise.write_shards(stream, path, length, per_shard)
    parts = stream.orderBy("at").collect()
    tokens = b"".join(bytes(r.tokens) for r in parts)
    total = len(tokens) // 2
    assert count == -(-total // length)
    tokens += struct.pack("<H", materialise.END) * (count * length - total)
    expected = [tokens[2 * length * i : 2 * length * (i + 1)] for i in range(count)]
    slots = materialise.slots(np.arange(count), count)
    read = {r.slot: bytes(r.tokens) for r in materialise.read_shards(spark, path, length, per_shard, body=True).collect()}
    assert read == {int(s): expected[i] for i, s in enumerate(slots)}
    resumed = materialise.read_shards(spark, path, length, per_shard, start=per_shard + 5).collect()
    assert sorted(r.slot for r in resumed) == list(range(per_shard + 5, count))
    files = sorted(tmp_path.glob("shards/shard=*/part-*"))
    assert len(files) == -(-count // per_shard)
    assert files[0].stat().st_size == per_shard * materialise.stride(length)

    encoder = materialise._encoder(Path(materialise.VOCABULARY).read_bytes(), "test")
    texts = {r.doc_id: r.text for r in documents.collect() if r.text}
    assert {r.doc_id for r in parts} == set(texts)
    for row in parts:
        ids = np.frombuffer(bytes(row.tokens), "<u2").tolist()
        assert ids[-1] == materialise.END and encoder.decode(ids[:-1]) == texts[row.doc_id]


@pytest.mark.parametrize("count, band", [(1000, 64), (1000, 999), (130, 64), (5, 64)])
def test_bands_are_permuted_in_themselves(count, band):
    ids = np.random.default_rng(1).permutation(count)
    made = materialise.slots(ids, count, band=band)
    assert sorted(made.tolist()) == list(range(count)) and (made // band == ids // band).all()
    if count > band:
        first, second = (np.sort(ids)[k * band : (k + 1) * band] for k in (0, 1))
        if len(second) == band:
            assert (materialise.slots(first, count, band=band) != materialise.slots(second, count, band=band) - band).any()


def test_slots_do_not_hang_on_splits(spark, tmp_path):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(3, "doc_id")
    frame.write.option("parquet.block.size", 40_000).parquet(str(tmp_path / "documents"))
    key = "spark.sql.files.maxPartitionBytes"
    before, found, tasks = spark.conf.get(key), [], set()
    try:
        for size in ("20000b", "150000b", "128m"):
            spark.conf.set(key, size)
            documents = spark.read.parquet(str(tmp_path / "documents"))
            tasks.add(documents.rdd.getNumPartitions())
            found.append(sorted(map(str, materialise.materialise(documents, length=128).collect())))
    finally:
        spark.conf.set(key, before)
    assert len(tasks) >= 2 and found[0] == found[1] == found[2]


def test_order_of_documents_that_are_not_a_plain_scan(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for frame in (documents.where("doc_id % 3 = 0"), documents.unionByName(documents), documents.withColumn("_metadata", F.lit(1))):
        stream = materialise.tokenise(frame).orderBy("at").collect()
        assert [r.at for r in stream] == np.cumsum([0, *(r.n for r in stream)])[:-1].tolist()
        assert sorted(r.doc_id for r in stream) == sorted(r.doc_id for r in frame.where("text <> ''").collect())


def test_shards_follow_the_curriculum(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    staged = mixing.training_order(documents)
    order = {}
    for place, r in enumerate(staged.collect()):
        order.setdefault(r.doc_id, place)
    last = max(order.values())
    def times_of_shards(rows):
        """How the mean time of a shard's documents goes with its number."""
        shards = {}
        for r in rows:
            shards.setdefault(r.shard, []).extend(order[d] / last for d in r.doc_ids)
        return np.corrcoef(sorted(shards), [np.mean(shards[k]) for k in sorted(shards)])[0, 1], len(shards)

    rows = materialise.materialise(stage(staged, "mixed"), length=256, per_shard=40, band=40).collect()
    follows, number = times_of_shards(rows)
    assert number > 10 and follows > 0.8
    plain = materialise.materialise(stage(staged, "mixed"), length=256, per_shard=40).collect()
    assert abs(times_of_shards(plain)[0]) < 0.7
    assert sorted(r.tokens_sha256 for r in plain) == sorted(r.tokens_sha256 for r in rows)


def test_materialise_agrees_with_itself(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    first, second = (
        sorted(map(str, materialise.materialise(documents, length=256).collect())) for _ in range(2)
    )
    assert first == second


def test_training_order_follows_the_demand(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    mixed = mixing.mix(documents).cache()
    for row in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert 0 <= row.target - row.taken < 1
    copies = mixed.select("source", "target", F.explode("copies").alias("c")).select("source", "target", "c.*").collect()
    for turn, source in enumerate(sorted({r.source for r in copies})):
        slope = mixing.SLOPES[turn % 3]
        own = sorted((r for r in copies if r.source == source), key=lambda r: r.position)
        start = 0
        for r in own:  # the words taken before a copy are the demand up to its time
            t = r.position
            assert r.target * (t + slope * (t * t - t)) == pytest.approx(start, abs=1e-3)
            start += r.n_words


def luhn(digits):
    doubled = [int(d) * (2 if (len(digits) - i) % 2 == 0 else 1) for i, d in enumerate(digits)]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10


def brute_feistel(high, low, highs, lows, kind):
    x, y, xs, ys = high, low, highs, lows
    for turn in range(1, pseudonyms.ROUNDS + 1):
        text = "|".join([pseudonyms.KEY, kind, str(turn), str(xs), str(y)])
        noise = int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)
        x, y, xs, ys = y, (x + noise) % xs, ys, xs
    return x, y


def test_pseudonyms_against_a_plain_version(spark):
    card, ip = "4539 5787 6362 1486", "10.0.255.7"
    texts = {
        1: f"pay {card} now, {card.replace(' ', '')}.",
        2: f"from {ip}. then {ip}",
        3: "call +1 (389) 555-5010 or (389) 555-5010",
        4: "born 2001-02-28, 28.02.2001 and 28/02/2001 or 02/28/2001",
        5: "not 4539 5787 6362 1487, 300.1.1.1, 2001-02-30, 666-12-1234, 123456789",
        6: "ssn 123-45-6789 mail Jo.Doe7@mail.example.com twice jo.doe7@mail.example.com",
    }
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(frame).collect()}
    a, b = re.fullmatch(r"pay ((?:\d{4} ){3}\d{4}) now, (\d{16})\.", rows[1].text).groups()
    assert a.replace(" ", "") == b and luhn(b) == 0 and b != card.replace(" ", "")
    x, y = brute_feistel(int(card.replace(" ", "")[:7]), int(card.replace(" ", "")[7:15]), 10**7, 10**8, "card")
    assert b[:15] == f"{x:07d}{y:08d}"
    x, y = brute_feistel(10 * 256, 255 * 256 + 7, 65536, 65536, "ip")
    made = f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    assert rows[2].text == f"from {made}. then {made}"
    full, local = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4})", rows[3].text).groups()
    assert full[3:] == local != "(389) 555-5010"
    iso, dotted, slashed, us = re.fullmatch(r"born (\S+), (\S+) and (\S+) or (\S+)", rows[4].text).groups()
    y, m, d = iso.split("-")
    assert (dotted, slashed, us) == (f"{d}.{m}.{y}", f"{d}/{m}/{y}", f"{m}/{d}/{y}") and iso != "2001-02-28"
    assert rows[5].text == texts[5] and rows[5].n_replaced == 0
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4} mail ([a-z.]{6}\d@mail\.example\.com) twice \1", rows[6].text)
    assert (rows[1].n_card, rows[2].n_ip, rows[3].n_phone, rows[4].n_date, rows[6].n_email, rows[6].n_ssn) == (2, 2, 2, 4, 2, 1)


def test_social_security_numbers_stay_valid_and_distinct(spark):
    draw = random.Random(4)
    numbers = {f"{draw.choice([*range(1, 666), *range(667, 900)]):03d}-{draw.randrange(1, 100):02d}-{draw.randrange(1, 10_000):04d}" for _ in range(10_000)}
    numbers |= {"001-01-0001", "665-99-9999", "667-01-0001", "899-99-9999"}
    invalid = ["000-12-3456", "666-12-3456", "900-12-3456", "999-12-3456", "123-00-4567", "123-45-0000"]
    rows = [(i, f"id {n}.") for i, n in enumerate([*sorted(numbers), *invalid])]
    found = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    made = [found[i].text[3:-1] for i in range(len(numbers))]
    assert len(set(made)) == len(numbers) and sum(a == b for a, b in zip(made, sorted(numbers))) < 5
    for number in made:
        area, group, serial = map(int, number.split("-"))
        assert 1 <= area <= 899 and area != 666 and 1 <= group and 1 <= serial and len(number) == 11
    assert all(found[i].text == text and not found[i].n_replaced for i, text in rows[len(numbers) :])


def test_addresses_are_permuted(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    locals_ = [a + b for a in letters for b in "abcdefghij"] + [f"{a}{d}" for a in "xyz" for d in range(10)] + list(letters)
    long = "averylongname." * 12 + "x9"
    rows = [(i, f"write to {name}@Site.example.org now") for i, name in enumerate([*locals_, long, long.upper(), "..", "-"])]
    found = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    made = [re.fullmatch(r"write to (\S+)@Site\.example\.org now", found[i].text).group(1) for i in range(len(rows))]
    assert len(set(made[: len(locals_)])) == len(locals_)
    kinds = str.maketrans(letters + "0123456789", "a" * 26 + "0" * 10)
    assert [m.translate(kinds) for m in made[: len(locals_) + 1]] == [n.translate(kinds) for n in [*locals_, long]]
    assert made[len(locals_)] == made[len(locals_) + 1] != long and made[-2:] == ["..", "-"]


def test_long_unbroken_runs_take_linear_time(spark):
    runs = ["a" * 1_000_000, "a." * 500_000, "1" * 1_000_000, "1.1." * 250_000, "a@" * 500_000, "x@" + "b" * 1_000_000, "+1 " * 300_000]
    rows = [(i, f"{run} 123-45-6789 {run[:9]}") for i, run in enumerate(runs)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    start = time.monotonic()
    found = {r.doc_id: r for r in pseudonyms.pseudonymise(frame).collect()}
    assert time.monotonic() - start < 30
    assert all(r.n_ssn == 1 and "123-45-6789" not in r.text for r in found.values())
    assert all(len(found[i].text) == len(text) for i, text in rows)


def test_values_that_touch_and_texts_with_the_mark(spark):
    mark = pseudonyms.MARK
    texts = ["+1 (389) 555-5010abc@x.org", "8.8.8.8 a@b.org,c@d.org 8.8.4.4", f"8.8.8.8{mark}a@b.org,c@d.org {mark}{mark}8.8.4.4", f"{mark}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(frame).collect()}
    assert (rows[0].n_phone, rows[0].n_email) == (1, 1) and "abc@" not in rows[0].text
    assert [(rows[i].n_ip, rows[i].n_email) for i in (1, 2, 3)] == [(2, 2), (2, 2), (0, 0)]
    assert rows[2].text.replace(mark, " ").split() == rows[1].text.split() and rows[2].text.count(mark) == 3 and rows[3].text == mark


def test_feistel_is_a_permutation(spark):
    digits = F.lpad(F.col("id").cast("string"), 3, F.lit("0"))
    made = spark.range(1000).select(pseudonyms.permuted_digits(digits, "k", "t").alias("d")).collect()
    assert sorted(r.d for r in made) == [f"{i:03d}" for i in range(1000)]
    days = spark.range(73_050).select(
        pseudonyms.feistel(F.floor(F.col("id") / 487), F.col("id") % 487, F.lit(150), F.lit(487), "k", "t").alias("p")
    )
    assert days.select("p.x", "p.y").distinct().count() == 73_050
    assert days.where("p.x >= 150 OR p.y >= 487").count() == 0


def test_no_personal_value_of_the_corpus_remains(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = {r.doc_id: r.text for r in documents.collect()}
    after = {r.doc_id: r.text for r in queries.op10_pseudonyms(spark, SF_DIR).collect()}
    found = 0
    for i, text in before.items():
        for value in re.findall(r"\S+@\S+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d])", text):
            found += 1
            assert value not in after[i]
        for value in re.findall(r"(?<!\d)\d{16}(?!\d)", text):
            assert (value in after[i]) == (luhn(value) != 0)
        assert len(after[i]) >= len(text) - 40
    assert found > 0


def test_an_address_of_single_digits_is_replaced_wherever_it_stands(spark):
    ends = ["", ",", "\nnext", "a", " then", ";"]
    frame = spark.createDataFrame([(i, f"resolver 8.8.8.8{end}") for i, end in enumerate(ends)], "doc_id bigint, text string")
    rows = pseudonyms.pseudonymise(frame).collect()
    assert all(r.n_ip == 1 and "8.8.8.8" not in r.text for r in rows)
    assert len({r.text[: -len(ends[r.doc_id]) or None] for r in rows}) == 1


@pytest.mark.parametrize(
    "code, spellings",
    [
        ("1", ["+1 212 555 0142", "+12125550142", "+1 (212) 555-0142", "+1.212.555.0142", "+1-2125550142", "+121 255 50142"]),
        ("44", ["+44 20 7946 0958", "+442079460958", "+44-20-79460958", "+442 0794 60958"]),
        ("7", ["+7 495 123 45 67", "+74951234567"]),
        ("420", ["+420 601 123 456", "+420601123456", "+42 0601 123456"]),
    ],
)
def test_a_phone_number_has_one_pseudonym_in_every_spelling(spark, code, spellings):
    frame = spark.createDataFrame([(i, f"call {s}, now") for i, s in enumerate(spellings)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(frame).collect()}
    before = re.sub(r"\D", "", spellings[0])
    made = {re.sub(r"\D", "", r.text) for r in rows.values()}
    assert len(made) == 1 and made != {before} and made.pop().startswith(code)
    for i, spelling in enumerate(spellings):
        assert rows[i].n_phone == 1
        assert re.sub(r"\d", "0", rows[i].text) == re.sub(r"\d", "0", f"call {spelling}, now")


def card_of(digits):
    return next(digits + str(k) for k in range(10) if luhn(digits + str(k)) == 0)


@pytest.mark.parametrize("sep", [" ", "-"])
@pytest.mark.parametrize(
    "groups",
    [(4, 6, 5), (4, 6, 4), (4, 5, 6), (4, 7, 4), (4, 3, 3, 3), (6, 13), (4, 4, 5), (4, 4, 4, 4)]
    + [(4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3)],
)
def test_cards_in_their_usual_groups(spark, groups, sep):
    draw = random.Random(str(groups))
    card = card_of("3" + "".join(draw.choices("0123456789", k=sum(groups) - 2)))
    ends = np.cumsum((0, *groups))
    form = sep.join(card[a:b] for a, b in zip(ends, ends[1:]))
    frame = spark.createDataFrame([(1, f"pay {form}, now"), (2, f"pay {card}, now")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(frame).collect()}
    found = rows[1].text[4:-5]
    assert [len(g) for g in found.split(sep)] == list(groups) and luhn(re.sub(r"\D", "", found)) == 0
    assert rows[2].text[4:-5] == re.sub(r"\D", "", found) != card
    assert rows[1].n_card == rows[2].n_card == 1


def test_what_follows_a_card_is_not_taken_for_a_part_of_it(spark):
    card, amex = "4539 5787 6362 1486", "3782 822463 10005"
    frame = spark.createDataFrame(
        [(0, card)]
        + [(1, f"{card} 124"), (2, f"{card} 123-45-6789"), (3, f"{card} 12/05/2001"), (4, f"{card} 10.0.0.1")]
        + [(5, f"{card} 123@example.com"), (6, f"{card} 7 times"), (7, f"{amex} 4539 5787 6362 1486"), (8, f"{card} 123")],
        "doc_id bigint, text string",
    )
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(frame).collect()}
    alone = rows[0].text
    assert alone != card and all(rows[i].text.startswith(alone) for i in range(1, 7))
    assert rows[1].text == f"{alone} 124" and rows[6].text == f"{alone} 7 times"
    assert (rows[2].n_ssn, rows[3].n_date, rows[4].n_ip, rows[5].n_email) == (1, 1, 1, 1)
    assert rows[7].text.endswith(alone) and rows[7].n_card == 2
    # Sixteen digits and nineteen pass here: all of it is one card.
    assert rows[8].n_card == 1 and luhn(rows[8].text.replace(" ", "")) == 0 and not rows[8].text.endswith(" 123")


def brute_kernel(s, t):
    """Every pair of equal subsequences, weighted by what both span."""
    from itertools import combinations

    def all_of(word):
        spans = Counter()
        for places in combinations(range(len(word)), toxicity.P):
            spans["".join(word[p] for p in places), places[-1] - places[0] + 1] += 1
        return spans

    a, b = all_of(s), all_of(t)
    return sum(m * n * toxicity.DECAY ** (x + y) for (u, x), m in a.items() for (v, y), n in b.items() if u == v)


def test_subsequence_kernel(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST", 0.0)
    words = ["idiot", "idxiot", "moron", "stupid", "scum", "onron", "ththing", "idioti", "abcabcabc"]
    marks = toxicity.Landmarks(["idiot", "moron", "scum", "abcab"])
    found = marks.similarities(words)
    for i, word in enumerate(words):
        for j, mark in enumerate(marks.words):
            norm = (brute_kernel(word, word) * brute_kernel(mark, mark)) ** 0.5
            assert found[i, j] == pytest.approx(brute_kernel(word, mark) / norm, abs=1e-4)


def test_words_set_letter_by_letter():
    assert "idiot" in toxicity.units("an i d i o t here")
    assert "idiot" in toxicity.units("an i.d.i.o.t, here")
    marks = toxicity.Landmarks(["idiot"])
    assert marks.similarities(["id-iot"])[0, 0] == pytest.approx(1) and marks.similarities(["idiiot"])[0, 0] > 0.7


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    scored = queries.op5_toxicity(spark, sf_dir).where("held_out")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = scored.join(labels, "doc_id").collect()
    toxic = [r.score for r in rows if r.toxic == 1]
    clean = [r.score for r in rows if r.toxic == 0]
    assert sum(a > b for a in toxic for b in clean) / (len(toxic) * len(clean)) > 0.85
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(clean)


def test_two_inserted_letters_leave_a_similarity():
    words = ["sxcxum", "idxixot", "trxaxsh", "mxoroxn", "clxowxn", "loxsexr", "looooser", "stxupxid"]
    marks = toxicity.Landmarks(["scum", "idiot", "trash", "moron", "clown", "loser", "loser", "stupid"])
    assert (marks.similarities(words).diagonal() > 0.2).all()


def test_insults_with_two_inserted_letters_in_held_out_texts(spark):
    sf_dir = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    fold = queries.crc32_fold(F.col("doc_id"))
    model = toxicity.train(documents.where(fold != queries.HELD_OUT), labels)
    clean = documents.where(fold == queries.HELD_OUT).join(labels.where("toxic = 0"), "doc_id").select("doc_id", "text")
    insults = F.array(*(F.lit(w) for w in ["sxcxum", "idxixot", "trxaxsh", "mxoroxn", "clxowxn", "loxsexr", "stxupxid"]))
    insult = F.get(insults, (F.col("doc_id") % 7).cast("int"))
    with_insult = clean.select("doc_id", F.concat("text", F.lit(" you "), insult, F.lit(" there")).alias("text"))
    before = {r.doc_id: r.score for r in toxicity.score(clean, model).collect()}
    after = {r.doc_id: r.score for r in toxicity.score(with_insult, model).collect()}
    assert sum(after[i] > before[i] for i in before) > 0.7 * len(before)
    assert sum(a > b for a in after.values() for b in before.values()) > 0.75 * len(before) ** 2


def test_languages_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = queries.op6_language(spark, sf_dir).where("held_out")
    rows = found.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_grams_do_not_depend_on_chunks(monkeypatch):
    text = "Ünïcode wörds, and " * 40
    whole = languages.gram_counts(text)
    assert whole.sum() > 0
    monkeypatch.setattr(languages, "CHUNK_CHARS", 97)
    near = languages.gram_counts(text)
    assert np.abs(whole - near).sum() < 0.1 * whole.sum()


def archive(records):
    """An archive by hand, and what a plain reader finds in it."""
    out = b""
    for number, payload in enumerate(records):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        digest = hashlib.sha1(payload).hexdigest()
        head = f"WARC-Type: response\r\nWARC-Record-ID: <urn:page:{number}>\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
        out += f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return out


@pytest.mark.parametrize("split", [300, 1_000, 1_000_000])
def test_archives_with_archives_inside(spark, tmp_path, split):
    """Payloads that hold whole records, cut records and bare magic lines, in splits smaller than a record."""
    draw = random.Random(split)
    inner = archive([b"inner one", b"inner two " * 30])
    payloads = [b"", b"plain", inner, inner[:90], b"WARC/1.0\r\n", b"x" * 700, b"WARC/1.0\r\n" * 30, inner * 3, b"end"]
    payloads += [bytes(draw.choices(b"abc\r\n", k=draw.randrange(900))) for _ in range(20)] + [inner]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.warc").write_bytes(archive(payloads))
    (tmp_path / "a" / "2.warc").write_bytes(archive(payloads[::-1]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = warc.read_archive(spark, str(tmp_path / "a")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = Counter((n, len(p), hashlib.sha1(p).hexdigest(), True) for ps in (payloads, payloads[::-1]) for n, p in enumerate(ps))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.intact) for r in rows) == expected


def plain_grams(text):
    """Hashed n-gram counts of one text, letter by letter."""
    points = [32]
    for c in (text.lower() if text else ""):
        code = ord(c) if "a" <= c <= "z" or ord(c) >= 0xAA else 32
        if code != 32 or points[-1] != 32:
            points.append(code)
    if points[-1] != 32:
        points.append(32)
    counts = np.zeros(languages.FEATURES)
    for order in languages.ORDERS:
        for k in range(len(points) - order + 1):
            value = 0
            for code in points[k : k + order]:
                value = (value * 0x100000001B3 + code) % 2**64
            counts[int(shingles.mix(np.array([value], np.uint64), order)[0] % np.uint64(languages.FEATURES))] += 1
    return counts


@pytest.mark.parametrize("chunk", [1, 2, 5, 1000, 200_000])
def test_gram_counts_do_not_hang_on_chunks(monkeypatch, chunk):
    monkeypatch.setattr(languages, "CHUNK_CHARS", chunk)
    for text in ["a", "É1x\n\n..y", "  two words ", "über  den — Fluß 12 ab", "x" * 300, " . " * 40 + "z"]:
        assert np.array_equal(languages.gram_counts(text), plain_grams(text))


def test_whole_language_query_against_plain_cosines(spark):
    """Every prediction from counts, weights and cosines taken one by one, with the model's idf and centroids."""
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = languages.train(documents.where(fold != queries.HELD_OUT))
    short = documents.where("length(text) < 1500")
    found = {r.doc_id: r for r in queries.op6_language(spark, SF_DIR).collect()}
    rows = short.collect()
    assert len(rows) > 50
    for row in rows:
        counts = plain_grams(row.text)
        vector = np.array([np.log1p(n) * w for n, w in zip(counts, model.idf)])
        vector = vector / max(np.sqrt((vector**2).sum()), 1e-9)
        best = [max(float(vector @ c) for c, owner in zip(model.centroids, model.owner) if owner == k) for k in range(len(model.languages))]
        chosen = int(np.argmax(best))
        share = 1 / sum(np.exp(languages.SHARPNESS * (b - best[chosen])) for b in best)
        got = found[row.doc_id]
        assert got.lang_pred == model.languages[chosen] or sorted(best)[-1] - sorted(best)[-2] < 1e-5
        assert got.score == pytest.approx(share, abs=1e-3) and got.rejected == (best[chosen] < model.limit[chosen])


def test_foreign_scripts_are_rejected(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = languages.train(documents)
    texts = ["Это обычный русский текст о погоде", "这是一个中文的句子，没有空格。", "Ελληνικά κείμενα για δοκιμή " * 30, "これは日本語のテキストです"]
    strange = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert all(r.rejected for r in languages.predict(strange, model).collect())
    known = languages.predict(documents, model).where("lang_pred <> 'und'")
    assert known.where("rejected").count() <= 0.01 * known.count()


def test_language_sample_is_that_of_least_hashes(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL")
    twice = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 10**9))
    rows = twice.where(F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).collect()
    expected = set()
    for lang in {r.lang for r in rows}:
        expected |= {r.doc_id for r in sorted((r for r in rows if r.lang == lang), key=lambda r: (r.h, r.doc_id))[:5]}
    drawn, original = [], languages.stage
    try:
        languages.stage = lambda frame, label: drawn.append(original(frame, label)) or drawn[-1]
        languages.train(twice, rows=5)
    finally:
        languages.stage = original
    assert {r.doc_id for r in drawn[0].collect()} == expected


def test_whole_toxicity_score_against_plain_kernels(spark):
    """Every score of short texts from brute-force kernels of each word with each landmark."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(documents, labels, texts=60, landmarks=6)
    assert model.constant is None and 2 <= len(model.landmarks) <= 6
    own = {m: brute_kernel(m, m) for m in model.landmarks}
    known = {}

    def similar(word):
        core = word.strip(toxicity._EDGE)
        core = core if core.isalnum() else toxicity._NOT_LETTER.sub("", core)
        if core not in known:
            row = [0.0] * len(model.landmarks)
            if toxicity.P <= len(core) <= 14:
                norm = brute_kernel(core, core)
                for k, mark in enumerate(model.landmarks):
                    value = brute_kernel(core, mark) / np.sqrt(norm * own[mark])
                    row[k] = value if value >= toxicity.LEAST else 0.0
            known[core] = np.array(row)
        return known[core]

    texts = documents.where("length(text) < 400").collect()
    texts = [(r.doc_id, r.text) for r in texts if all(len(w) <= 14 for w in (r.text or "").split())][:25]
    texts += [(-1, None), (-2, ""), (-3, f"such a {model.landmarks[0]}!"), (-4, " ".join(model.landmarks[0]) + " you")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    for doc_id, text in texts:
        text = (text or "").lower()
        alike = {w for w in toxicity.units(text) if similar(w).any()}
        rows = [np.max([similar(w) for w in toxicity.units(s) if w in alike], axis=0)
                for s in toxicity._SENTENCE.split(text) if toxicity.units(s) & alike]
        if alike and not rows:
            rows = [np.max([similar(w) for w in alike], axis=0)]
        rows = np.array(rows) if rows else np.zeros((1, len(model.landmarks)))
        assert found[doc_id] == pytest.approx(model.score(rows), abs=2e-3)
    assert found[-3] > found[-2]
