"""A decision: SQL over named state tables, run by Spark on DataFrames of any origin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Decision:
    """``sql`` names its inputs in braces.  ``check`` is DuckDB text where the two dialects part; else ``sql`` itself."""

    name: str
    inputs: tuple[str, ...]
    sql: str
    doc: str = ""
    check: str | None = None

    def apply(self, spark: SparkSession, **tables: DataFrame) -> DataFrame:
        missing = [t for t in self.inputs if t not in tables]
        if missing:
            raise TypeError(f"{self.name} needs the tables {', '.join(missing)}")
        return spark.sql(self.sql, **{t: tables[t] for t in self.inputs})


REGISTRY: dict[str, Decision] = {}


def decision(name: str, inputs: str, sql: str, doc: str = "", check: str | None = None) -> Decision:
    """Register a decision; ``inputs`` are table names separated by blanks."""
    REGISTRY[name] = Decision(name, tuple(inputs.split()), sql, doc, check)
    return REGISTRY[name]
