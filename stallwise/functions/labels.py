"""Category maps and identifier formats."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallwise.functions.numeric import col


def lookup(value: Column | str, mapping: Mapping, default=None) -> Column:
    """Value of a small fixed map; ``default`` (or null) where the key is not in it."""
    entries = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    found = F.try_element_at(entries, col(value))
    return found if default is None else F.coalesce(found, F.lit(default))


def ordinal(value: Column | str, mapping: Mapping[str, int]) -> Column:
    """Category as its ordinal. A category outside the map fails the job rather than becoming null."""
    message = F.concat(F.lit("unknown category: "), F.coalesce(col(value), F.lit("null")))
    return F.coalesce(lookup(value, mapping), F.raise_error(message).cast("int"))


def padded_id(prefix: str, number: Column | str, width: int = 7) -> Column:
    """Prefix and zero-padded number. Longer numbers keep all their digits."""
    digits = col(number).cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))
