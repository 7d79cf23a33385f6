"""Registry of the queries and, where SQL can state them, their oracle."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Build
    sql: str | None = None
    rounding: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        df = self.build(spark, sf_dir)
        return df.select(*[F.round(c, self.rounding[c]).alias(c) if c in self.rounding else F.col(c)
                           for c in df.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.rounding:
            return self.sql
        rounded = ", ".join(f"round({c}, {d}) AS {c}" for c, d in self.rounding.items())
        return f"SELECT * REPLACE ({rounded}) FROM ({self.sql})"


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, floats: str = "", digits: int = 8) -> Callable[[Build], Build]:
    """Register a query; ``floats`` names the columns both sides round for comparison."""
    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, build, sql, {c: digits for c in floats.split()})
        return build
    return add
