"""Names and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopgrid.params import ARROWS, NAME_MARKS, SIDO_SHORT, SPLIT_END, SPLIT_MARKS


def normalize_name(c: Column) -> Column:
    """Without spaces, brackets and marks, in lower case."""
    return F.lower(F.regexp_replace(c, NAME_MARKS, ""))


def direction_free_key(c: Column) -> Column:
    """One key for a route's name in either direction."""
    t = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    parts = F.filter(F.split(t, ARROWS), lambda x: x != "")
    return F.when(t.isin("", "nan", "none"), "").when(F.size(parts) > 1, F.array_join(F.array_sort(parts), "|")).otherwise(t)


def num_clean(c: Column) -> Column:
    """A number with thousand separators; 0 if it is none."""
    return F.coalesce(F.regexp_replace(c, ",", "").try_cast("double"), F.lit(0.0))


def admin_level(code: Column) -> Column:
    """The level of a ten-digit region code."""
    return F.when(F.substring(code, 6, 3) != "000", "dong").when(F.substring(code, 3, 3) != "000", "sigungu").otherwise("sido")


def sido_short(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SIDO_SHORT.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.substring(c, 1, 2))


def dong_key(c: Column) -> Column:
    """A full region name without its first part and spaces."""
    parts = F.split(F.trim(c), r"\s+")
    return F.array_join(F.slice(parts, 2, 99), "")


def sido_dong_key(c: Column) -> Column:
    """The first two letters of a full region name and its last part; a name of one part is its own key."""
    parts = F.split(F.trim(c), r"\s+")
    return F.when(F.size(parts) > 1, F.concat_ws("|", F.substring(parts[0], 1, 2), F.element_at(parts, -1))).otherwise(c)


def split_base(c: Column) -> Column:
    """A quarter's name without numbers, dots and its last syllable."""
    return F.regexp_replace(F.regexp_replace(c, SPLIT_MARKS, ""), f"{SPLIT_END}+$", "")
