"""Task grids, reserved sets and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 10_000  # configurations of a grid; they are settings, not data


def grid(rows: DataFrame, **dimensions: list) -> DataFrame:
    """Every row with every combination of the given settings, without a join.

    The number of combinations is checked, as each multiplies the rows.
    """
    cells = reduce(lambda a, b: a * len(b), dimensions.values(), 1)
    if cells > MAX_CELLS:
        raise ValueError(f"{cells} combinations")
    for name, values in dimensions.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows


def without(rows: DataFrame, reserved: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not reserved, such as variables that serve as examples."""
    return rows.join(reserved.select(*([on] if isinstance(on, str) else on)).distinct(), on, "left_anti")


def resolve_fixed(rows: DataFrame, names: list[str], on: str) -> DataFrame:
    """The named rows in the given order; a missing name is an error."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(on))
    found = rows.where(F.col(on).isin(names)).withColumn("place", place)
    missing = set(names) - {r[0] for r in found.select(on).distinct().collect()}
    if missing:
        raise RuntimeError(f"not found: {sorted(missing)}")
    return found.orderBy("place")


def first_by(rows: DataFrame, on: str, n: int, unlimited: bool = True) -> DataFrame:
    """The first n rows by name; 0 means all of them where ``unlimited`` says so."""
    return rows.orderBy(on) if n == 0 and unlimited else rows.orderBy(on).limit(n)


def sample_exact(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Exactly k rows (all, if fewer), the same for a seed whatever the partitioning; no global sort."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(k)


def flatten_lists(rows: DataFrame, items: str, keep: list[str]) -> DataFrame:
    """One row per element of a list of structs, with the kept columns; empty and null lists give none."""
    return rows.select(*keep, F.inline(items))
