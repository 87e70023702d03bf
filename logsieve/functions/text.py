"""String columns: stripping, first-key and first-value picks, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def first_key(fields: Column, names: tuple[str, ...]) -> Column:
    """Value of the first of ``names`` that is a key of the map, even if that value is null."""
    picked = F.when(F.map_contains_key(fields, names[0]), F.try_element_at(fields, F.lit(names[0])))
    for name in names[1:]:
        picked = picked.when(F.map_contains_key(fields, name), F.try_element_at(fields, F.lit(name)))
    return picked


def has_any_key(fields: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.map_keys(fields), F.array(*map(F.lit, names)))


def first_filled(fields: Column, names: tuple[str, ...]) -> Column:
    """First value among ``names`` that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in names))


def short_digest(c: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)
