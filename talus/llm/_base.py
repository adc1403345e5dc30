"""What the operators of this subpackage share: tables, scratch tables in the shared folder, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import among, components, drop_scratch, salt, salts_of, salts_seen, scratch_of, shared_dir, written

__all__ = ["among", "components", "drop_scratch", "own", "salt", "salts_of", "salts_seen", "scratch_of", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under names of our own, so that extra or clashing columns do no harm."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])
