"""Column functions on event keys and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_KEY = 999_999_999
PLANES = {"U": 0, "V": 1, "Y": 2}


def sort_key(key: Column, zero_is_missing: bool = False) -> Column:
    """Key for ordering events; a missing one (with ``zero_is_missing`` also 0) goes last."""
    value = F.nullif(key, F.lit(0)) if zero_is_missing else key
    return F.coalesce(value.cast("long"), F.lit(MISSING_KEY))


def provenance_key(key: Column, zero_is_missing: bool = False) -> Column:
    """Key for output: -1 where it is missing, the sentinel or (with ``zero_is_missing``) 0."""
    value = F.nullif(F.nullif(key.cast("long"), F.lit(MISSING_KEY)), F.lit(0)) if zero_is_missing else F.nullif(key.cast("long"), F.lit(MISSING_KEY))
    return F.coalesce(value, F.lit(-1))


def whole_or_minus_one(x: Column) -> Column:
    """Integer of a float column, -1 for NaN and null; 0 stays 0."""
    return F.when(x.isNull() | F.isnan(x), -1).otherwise(x.cast("long")).cast("long")


def key_columns(names: list[str]) -> dict[str, str]:
    """Which columns hold run, subrun and event number, by their names; of several the last, and absent ones are left out."""
    kinds = ("subrun", "run", "evt")
    return {kind: name for name in names for kind in [next((k for k in kinds if k in name.lower()), None)] if kind}


def hit_prefixes(names: list[str]) -> list[str]:
    """Prefixes before the last dot, once each, sorted; names without a dot have none."""
    return sorted({n.rpartition(".")[0] for n in names if "." in n})


def ordered_union(*lists: list[str]) -> list[str]:
    """Names of all lists once each, in order of first appearance."""
    return list(dict.fromkeys(n for names in lists for n in names))


def split_metadata(names: list[str], metadata: list[str]) -> tuple[list[str], list[str]]:
    """The names that are metadata and those that are not, in order."""
    drop = set(metadata)
    return [n for n in names if n in drop], [n for n in names if n not in drop]


def slug(name: str) -> str:
    """A name as a word for file and variant names: its ASCII letters and digits, an underscore for each run of others between them."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in name).split()
    return "_".join(words) or "branch"


def wire_name(name: Column) -> Column:
    """Struct (plane, wire, channel) of names like ``posWire_U_12``, further parts ignored; what cannot be read is null by itself, other names are all null."""
    parts = F.split(name, "_")
    known = (F.get(parts, F.lit(0)) == "posWire") & (F.size(parts) >= 3)
    number = F.when(known, F.get(parts, F.lit(2)).try_cast("int"))
    planes = F.create_map(*[x for k, v in PLANES.items() for x in (F.lit(k), F.lit(v))])
    plane = F.when(known, F.try_element_at(planes, F.upper(F.get(parts, F.lit(1)))))
    return F.struct(plane.alias("plane"), number.alias("wire"), number.alias("channel"))
