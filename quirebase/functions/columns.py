"""Operators on columns and the registry of named plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_private(df: DataFrame) -> DataFrame:
    """Columns whose names begin with an underscore go; they are for later stages only."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def enriched(pages: DataFrame, predict: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Pages with what predict finds for them (unique by key); pages it finds nothing for stay, with a warning."""
    found = predict(pages).withColumn("_found", F.lit(True))
    out = pages.join(found, key, "left").withColumn("warning", F.when(F.col("_found").isNull(), F.lit("not enriched")))
    return without_private(out)


class Strategies:
    """Named chains of steps DataFrame -> DataFrame. Unknown names fall back to the default."""

    def __init__(self, default: str):
        self.default, self.chains = default, {}

    def add(self, name: str, *steps: Callable[[DataFrame], DataFrame]) -> None:
        self.chains[name] = steps

    def run(self, name: str | None, df: DataFrame) -> DataFrame:
        for step in self.chains.get((name or "").strip().lower(), self.chains[self.default]):
            df = df.transform(step)
        return df
