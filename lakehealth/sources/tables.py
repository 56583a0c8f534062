"""User data tables: one Parquet dataset per table under a folder."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

# The driver's test tables (a folder of ``<name>.parquet``).
TEST_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class LazyTables(Mapping):
    """``{name: DataFrame}`` that creates each reader on first access.

    Creating a Parquet reader resolves the schema (a footer read on the
    driver); checks that touch a few tables should not pay that for all.
    """

    def __init__(self, spark: SparkSession, folder: str, names: list[str]):
        self._spark, self._folder, self._names, self._dfs = spark, folder.rstrip("/"), list(names), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._dfs:
            self._dfs[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._dfs[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def load_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> Mapping[str, DataFrame]:
    """DataFrames keyed by table name; nothing is read until a check runs."""
    return LazyTables(spark, folder, names or TEST_TABLES)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Expose each table as a temp view so SQL rules can name it."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
