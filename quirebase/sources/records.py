"""Record tables kept as Parquet: read, upsert by key, delete with everything that hangs on a key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key new doesn't have, and all of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def without(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table less the rows of the keys in gone."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}
