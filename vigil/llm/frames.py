"""Small DataFrame helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plus(schema: StructType, **kinds: str) -> StructType:
    """A new schema with further fields, their types as DDL."""
    return StructType([*schema.fields, *[StructField(n, StructType.fromDDL(f"x {k}")[0].dataType) for n, k in kinds.items()]])
