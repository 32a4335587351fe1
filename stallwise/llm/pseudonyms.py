"""Format-preserving pseudonyms for personal numbers and dates.

Personal values are found by pattern and validated (check digits, ranges of parts,
calendar). A valid one is replaced by another of the same format through a keyed
Feistel network over exactly the values of that format, so

* equal values get equal pseudonyms in every document, however they are spaced,
* different values of a format never share one,
* a pseudonym is again valid (a card passes its check digit, a date exists, an SSN's parts are in range), and
* who holds the key can invert the permutation.

``KEY`` is a public default: set another wherever texts leave the house.

Formats: payment cards (13 to 19 digits, Luhn, in one run or in the groups listed at
their pattern), IPv4 addresses, phone numbers with a country code or an area code in
brackets, US social security numbers, and dates (``yyyy-mm-dd``, ``dd.mm.yyyy``,
``dd/mm/yyyy``, else ``mm/dd/yyyy``) between 1900 and 2099. E-mail addresses keep
their domain and the kind of each character; letter case has no part in them.
Values that don't validate stay as they are. Where sixteen digits in groups and up to
three more after a separator pass the check as one number, they are one card, else the
sixteen are.

All of it are column expressions on the row: no shuffle, no Python in tasks. Texts
that match no pattern are passed through.

Edge cases: a null or empty text is returned as it is, with counts of 0. Texts of
any length are treated whole. Repeated rows are returned each. An empty table gives
no rows. ``pseudonymise`` keeps extra columns, but for the text and its counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import let

KEY = "set a secret of your own"
ROUNDS = 10  # even, so that both halves end where they began

# The formats, in order of precedence.
ADDRESS = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
PATTERNS = {
    # Only where a run of letters begins, or right behind another value: long runs are read once.
    "email": rf"(?:(?<![A-Za-z0-9._%+-])|\G){ADDRESS}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d|[./-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "phone": r"(?<!\d)\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
}
# Cards: 4-4-4-4 and up to three more, 4-4-4 and the rest, 4-6-5, 4-6-4, 4-5-6, 4-7-4, 4-3-3-3 and 6-13, or no groups at all.
# What follows a card isn't its last group where another value begins there.
_OTHER = "|".join(f"(?:{p})" for p in (ADDRESS, *(PATTERNS[kind] for kind in ("ip", "date", "ssn"))))
_LAST = rf"[ -](?!{_OTHER})"
PATTERNS["card"] = (
    rf"(?<!\d)(?:\d{{4}}(?:[ -]?\d{{4}}){{3}}{_LAST}\d{{1,3}}|\d{{4}}(?:[ -]?\d{{4}}){{2}}[ -]?\d{{1,7}}"
    rf"|\d{{4}}[ -](?:\d{{6}}{_LAST}\d{{4,5}}|\d{{5}}{_LAST}\d{{6}}|\d{{7}}{_LAST}\d{{4}}|\d{{3}}[ -]\d{{3}}{_LAST}\d{{3}})"
    rf"|\d{{6}}{_LAST}\d{{13}})(?!\d)"
)
# Sixteen digits in groups, and what may be a number of its own after them.
LONG_CARD = r"^(\d{4}(?:[ -]?\d{4}){3})([ -]\d{1,3})$"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# A text without any of these can't match.
HINT = r"@|\d[\d() .+/-]{7}|\d\.\d{1,3}\.\d{1,3}\.\d"
# Country codes (ITU-T E.164): those of one and of two digits; all others have three.
COUNTRY_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
AREAS, GROUPS, SERIALS = 898, 99, 9999  # of valid SSNs: 001 to 899 without 666, 01 to 99, 0001 to 9999
MARK = "\U0010ffff"  # stands for no character; set around what is found
FIRST_DAY, DAYS = "1900-01-01", (150, 487)  # 73,050 days: the last is 2100-01-01


def _power(digits: Column) -> Column:
    """10 to the power of 0 to 10, as long."""
    return F.get(F.array(*(F.lit(10**k).cast("long") for k in range(11))), digits)


def _noise(key: str, kind: str, round_: Column, half: Column, modulus: Column) -> Column:
    parts = F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), modulus.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(parts, 256), 1, 15), 16, 10).cast("long")


def feistel(high: Column, low: Column, highs: Column, lows: Column, key: str, kind: str) -> Column:
    """``struct(x, y)``: a keyed permutation of the pairs (high < highs, low < lows).

    Each round adds noise made from one half to the other, modulo that half's size,
    so every size is permuted exactly and nothing has to be walked back into range.
    """

    def turn(state: Column, round_: Column) -> Column:
        mixed = F.pmod(state["x"] + F.pmod(_noise(key, kind, round_, state["y"], state["xs"]), state["xs"]), state["xs"])
        return F.struct(
            state["y"].alias("x"), mixed.alias("y"), state["ys"].alias("xs"), state["xs"].alias("ys")
        )

    def named(*columns: Column) -> Column:
        return F.struct(*(c.cast("long").alias(n) for n, c in zip(("x", "y", "xs", "ys"), columns)))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, named(high, low, highs, lows), turn)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 20 digits as another of the same length."""

    def permuted(d: Column) -> Column:
        n = F.length(d)
        left = F.floor(n / F.lit(2)).cast("int")
        right = n - left
        high, low = F.substring(d, F.lit(1), left).cast("long"), F.substring(d, left + F.lit(1), right).cast("long")
        made = feistel(high, low, _power(left), _power(right), key, f"{kind}")
        return let(
            made,
            lambda m: F.concat(
                F.lpad(m["x"].cast("string"), left, F.lit("0")), F.lpad(m["y"].cast("string"), right, F.lit("0"))
            ),
        )

    return let(digits, permuted)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(found: Column, digits: Column) -> Column:
    """``found`` with its digits replaced, in order, by ``digits``."""

    def at(i: Column) -> Column:
        char = F.substring(found, i, F.lit(1))
        return F.when(char.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(found, F.lit(1), i))), F.lit(1))).otherwise(char)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(found)), at), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string."""

    def value(i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * F.lit(2)
        doubled = F.when(twice > 9, twice - F.lit(9)).otherwise(twice)
        return F.when((F.length(digits) - i) % F.lit(2) == 1, doubled).otherwise(digit)

    places = F.transform(F.sequence(F.lit(1), F.length(digits)), value)
    return F.aggregate(places, F.lit(0), lambda a, b: a + b) % F.lit(10)


def _card(found: Column, key: str) -> Column:
    def made(part: Column, digits: Column) -> Column:
        body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - F.lit(1)), key, "card")
        check = let(F.concat(body, F.lit("0")), lambda b: F.concat(
            F.substring(b, F.lit(1), F.length(b) - F.lit(1)), ((F.lit(10) - _luhn(b)) % F.lit(10)).cast("string")
        ))
        return _refilled(part, check)

    def card(part: Column) -> Column:
        valid = F.length(_digits(part)).between(13, 19)
        return F.when(valid, let(_digits(part), lambda d: F.when(_luhn(d) == 0, made(part, d))))

    # A number of sixteen digits if all of it is none.
    first = let(F.regexp_extract(found, LONG_CARD, 1), card)
    return F.coalesce(card(found), F.when(found.rlike(LONG_CARD), F.concat(first, F.regexp_extract(found, LONG_CARD, 2))))


def _ip(found: Column, key: str) -> Column:
    def made(octets: Column) -> Column:
        part = [F.get(octets, k).cast("int") for k in range(4)]
        size = F.lit(65536)
        pair = feistel(part[0] * F.lit(256) + part[1], part[2] * F.lit(256) + part[3], size, size, key, "ip")
        valid = reduce(lambda a, b: a & b, (p <= 255 for p in part))
        halves = lambda m: [F.floor(m / F.lit(256)), m % F.lit(256)]
        return F.when(valid, let(pair, lambda m: F.concat_ws(".", *(h.cast("string") for h in [*halves(m["x"]), *halves(m["y"])]))))

    return let(F.split(found, r"\."), made)


def _phone(found: Column, key: str) -> Column:
    """The country code stays; the rest of the digits is permuted. Digits alone tell them apart, not how they are spaced."""

    def made(d: Column) -> Column:
        code = F.when(F.startswith(found, F.lit("+")), F.length(F.regexp_extract(d, COUNTRY_CODE, 0))).otherwise(F.lit(0))
        rest = F.substring(d, code + F.lit(1), F.length(d) - code)
        return _refilled(found, F.concat(F.substring(d, F.lit(1), code), permuted_digits(rest, key, "phone")))

    return let(_digits(found), lambda d: F.when(F.length(d).between(8, 15), made(d)))


def _ssn(found: Column, key: str) -> Column:
    """Area, group and serial permuted over those that are valid."""

    def part(start: int, length: int) -> Column:
        return F.substring(found, start, length).cast("long")

    def padded(number: Column, width: int) -> Column:
        return F.lpad(number.cast("string"), width, F.lit("0"))

    def written(m: Column) -> Column:
        area = F.floor(m["x"] / F.lit(GROUPS))
        area = area + F.when(area < 665, F.lit(1)).otherwise(F.lit(2))
        return F.concat_ws(
            "-", padded(area, 3), padded(m["x"] % F.lit(GROUPS) + F.lit(1), 2), padded(m["y"] + F.lit(1), 4)
        )

    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area < 666, F.lit(1)).otherwise(F.lit(2))
    pair = feistel(
        place * F.lit(GROUPS) + group - F.lit(1), serial - F.lit(1), F.lit(AREAS * GROUPS), F.lit(SERIALS), key, "ssn"
    )
    return F.when(valid, let(pair, written))


def _date(found: Column, key: str) -> Column:
    def made(day: Column, form: str) -> Column:
        number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        high, low = F.floor(number / F.lit(DAYS[1])), number % F.lit(DAYS[1])
        pair = feistel(high, low, F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")
        other = let(pair, lambda m: F.date_add(F.lit(FIRST_DAY).cast("date"), (m["x"] * F.lit(DAYS[1]) + m["y"]).cast("int")))
        return F.when((number >= 0) & (number < DAYS[0] * DAYS[1]), F.date_format(other, form))

    def read(form: str) -> Column:
        return let(F.try_to_timestamp(found, F.lit(form)).cast("date"), lambda day: made(day, form))

    return (
        F.when(found.rlike("-"), read("yyyy-MM-dd"))
        .when(found.rlike(r"\."), read("dd.MM.yyyy"))
        .otherwise(F.coalesce(read("dd/MM/yyyy"), read("MM/dd/yyyy")))
    )


def _email(found: Column, key: str) -> Column:
    """The local part's letters and digits are permuted, each among its kind, by a Feistel network whose halves are strings."""
    domain = F.lower(F.substring_index(found, "@", -1))

    def shifted(half: Column, other: Column, turn: Column) -> Column:
        noise = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), turn.cast("string"), domain, other), 512)

        def at(i: Column, digest: Column) -> Column:
            char = F.substring(half, i, F.lit(1))
            value = F.conv(F.substring(digest, (i * F.lit(2)) % F.lit(126) + F.lit(1), F.lit(2)), 16, 10).cast("int")

            def moved(first: int, size: int) -> Column:
                return F.char(F.lit(first) + (F.ascii(char) - F.lit(first) + value) % F.lit(size))

            return F.when(char.rlike("[0-9]"), moved(48, 10)).when(char.rlike("[a-z]"), moved(97, 26)).otherwise(char)

        places = F.sequence(F.lit(1), F.length(half))
        joined = let(noise, lambda digest: F.array_join(F.transform(places, lambda i: at(i, digest)), ""))
        return F.when(F.length(half) == 0, half).otherwise(joined)

    def turn(state: Column, number: Column) -> Column:
        return F.struct(state["y"].alias("x"), shifted(state["x"], state["y"], number).alias("y"))

    def made(local: Column) -> Column:
        middle = F.floor(F.length(local) / F.lit(2)).cast("int")
        halves = F.struct(
            F.substring(local, F.lit(1), middle).alias("x"), F.substring(local, middle + F.lit(1), F.length(local)).alias("y")
        )
        rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
        return let(F.aggregate(rounds, halves, turn), lambda m: F.concat(m["x"], m["y"]))

    return F.concat(
        let(F.lower(F.substring_index(found, "@", 1)), made), F.lit("@"), F.substring_index(found, "@", -1)
    )


MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _pseudonym(found: Column, key: str) -> Column:
    """``struct(kind, value)`` of the first format that matches and validates, else null."""
    made = F.lit(None).cast("struct<kind:string,value:string>")
    for kind in reversed(PATTERNS):
        made = F.when(found.rlike(f"^(?:{PATTERNS[kind]})$"), _kind(kind, found, key)).otherwise(made)
    return made


def _kind(kind: str, found: Column, key: str) -> Column:
    def named(value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    return let(MAKERS[kind](found, key), named)


def replaced(text: Column, key: str = KEY) -> Column:
    """``struct(text, kinds)``: the text with pseudonyms, and the kind of each value replaced."""

    def changed(parts: Column) -> Column:
        made = F.transform(parts, lambda p, i: F.when(i % F.lit(2) == 1, _pseudonym(p, key)))
        return let(made, lambda m: joined(parts, m))

    def joined(parts: Column, made: Column) -> Column:
        body = F.array_join(F.zip_with(parts, made, lambda p, m: F.coalesce(m["value"], p)), "")
        kinds = F.transform(F.array_compact(made), lambda m: m["kind"])
        return F.struct(body.alias("text"), kinds.alias("kinds"))

    # What lies between the values and the values, in turn. One search finds both, but in texts that hold the mark.
    parts = F.split(F.regexp_replace(text, F.lit(f"(?:{ANY})"), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    searched = F.zip_with(
        F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), 0), lambda b, f: F.array(b, F.coalesce(f, F.lit("")))
    )
    parts = F.when(F.contains(text, F.lit(MARK)), F.flatten(searched)).otherwise(parts)
    same = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike(HINT), let(parts, changed)).otherwise(same)


def pseudonymise(documents: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with pseudonyms in ``text`` and counts ``n_replaced``, ``n_email``, ``n_ip`` and so on."""
    counts = [f"n_{kind}" for kind in PATTERNS]
    kept = [c for c in documents.columns if c not in ("text", "n_replaced", *counts)]
    rows = documents.select(*(F.col(f"`{c}`") for c in kept), replaced(F.col("text"), key).alias("pseudonyms_"))
    kinds = F.col("pseudonyms_.kinds")
    return rows.select(
        *(F.col(f"`{c}`") for c in kept),
        F.col("pseudonyms_.text").alias("text"),
        F.size(kinds).cast("long").alias("n_replaced"),
        *(F.size(F.filter(kinds, _equals(kind))).cast("long").alias(f"n_{kind}") for kind in PATTERNS),
    )


def _equals(kind: str):
    return lambda k: k == kind
