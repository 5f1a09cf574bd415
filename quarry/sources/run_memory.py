"""The stored run memory: tables of runs, mappings, rules and patterns that whole versions replace.

A write makes a new folder beside the old one and then creates the version's mark, in one step that fails if another writer was faster. Readers
take the highest mark, so a write that fails or is lost midway changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import stores
from ..operators import memory

# Tables of the run memory, their columns and keys.
TABLES = {
    "runs": ("run_id string, dataset_name string, domain string, schema_hash string, sample_hash string, timestamp timestamp, confidence_score double, quality_score double, rows_processed long, columns_processed long, success int", ["run_id"]),
    "schema_mappings": ("schema_hash string, original_column string, canonical_column string, suggested_type string, confidence double, usage_count long, last_used timestamp", ["schema_hash", "original_column"]),
    "transform_rules": ("rule_id string, rule_type string, column_pattern string, action string, parameters string, success_rate double, usage_count long, created_at timestamp, last_used timestamp", ["rule_id"]),
    "quality_patterns": ("pattern_id string, domain string, issue_type string, pattern_description string, remediation string, effectiveness_score double, usage_count long, created_at timestamp", ["pattern_id"]),
}
#: The column by which rows of a table grow old; the others are kept.
AGES = {"runs": "timestamp", "schema_mappings": "last_used", "transform_rules": "last_used"}


class Conflict(RuntimeError):
    """Another writer has made the next version meanwhile."""


class RunMemory:
    """The run memory in a folder that all who use it share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _marks(self, table: str) -> list[str]:
        return [n for n in stores.names_in(self.spark, f"{self.folder}/{table}/versions") if n.isdigit()]

    def _data(self, table: str, mark: str) -> str:
        return f"{self.folder}/{table}/{self.spark.read.text(f'{self.folder}/{table}/versions/{mark}').first()[0]}"

    def read(self, table: str) -> DataFrame:
        """The last whole version of a table; empty before the first."""
        schema, marks = TABLES[table][0], self._marks(table)
        return self.spark.read.schema(schema).parquet(self._data(table, marks[-1])) if marks else self.spark.createDataFrame([], schema)

    def replace(self, table: str, change) -> None:
        """Makes the next version by change(last version). Raises Conflict if another writer was faster; then nothing has changed."""
        marks = self._marks(table)
        number = int(marks[-1]) + 1 if marks else 0
        schema = self.spark.createDataFrame([], TABLES[table][0]).schema
        name = f"data-{uuid.uuid4().hex}"
        new = change(self.read(table))
        new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).coalesce(8).write.parquet(f"{self.folder}/{table}/{name}")
        if not stores.write_once(self.spark, f"{self.folder}/{table}/versions/{number:09d}", name):
            raise Conflict(f"version {number} of {table} exists")
        self._clean(table)

    def _clean(self, table: str, keep: int = 2) -> None:
        """Removes versions older than the last two, which readers may still hold."""
        marks = self._marks(table)
        for mark in marks[:-keep]:
            for path in (self._data(table, mark), f"{self.folder}/{table}/versions/{mark}"):
                files, p = stores.hadoop(self.spark, path)
                files.delete(p, True)

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows by key: those that are there are replaced, others added. Of rows with one key in `rows` one is taken."""
        keys = TABLES[table][1]
        self.replace(table, lambda old: memory.upsert(old, rows.dropDuplicates(keys).select(old.columns), keys))

    def count_up(self, table: str, rows: DataFrame) -> None:
        """Rows by key with usage_count added to that of the rows that are there, their time of creation kept, and all else as in `rows`."""
        keys = TABLES[table][1]

        def merged(old: DataFrame) -> DataFrame:
            known = old.select(*keys, F.col("usage_count").alias("_n"), *([F.col("created_at").alias("_created")] if "created_at" in old.columns else []))
            new = rows.groupBy(keys).agg(F.sum("usage_count").alias("usage_count"), F.max_by(F.struct(*[c for c in old.columns if c not in (*keys, "usage_count")]), F.coalesce(rows["last_used"] if "last_used" in rows.columns else rows["created_at"], F.lit(0).cast("timestamp"))).alias("_r"))
            new = new.select(*keys, "usage_count", "_r.*").join(known, keys, "left").withColumn("usage_count", F.col("usage_count") + F.coalesce("_n", F.lit(0)))
            if "created_at" in old.columns:
                new = new.withColumn("created_at", F.coalesce("_created", "created_at"))
            return memory.upsert(old, new.select(old.columns), keys)

        self.replace(table, merged)

    def trim(self, now: str, days: int = 90) -> None:
        """Drops rows of AGES that are older than days before now."""
        for table, age in AGES.items():
            if self._marks(table):
                self.replace(table, lambda old, age=age: memory.keep_recent(old, age, days, now))

    def views(self) -> None:
        """Makes the tables readable from SQL by their names."""
        memory.register_views({name: self.read(name) for name in TABLES})
