"""Progress of a loop in a folder: each round's tables, and a table of commits that says which rounds are whole.

A round is committed by one row, written after all its tables. A run that ends in between leaves tables that no commit names;
the next run starts after the last commit. A folder belongs to one version of what is run in it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

COMMIT = "version string, round int, tables map<string, string>"


class Progress:
    """The committed rounds of one loop in ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version
        # a row a round; the folder is made by the first write
        self.spark.createDataFrame([], COMMIT).write.mode("append").parquet(f"{self.folder}/commits")
        rows = self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits").collect()
        if others := {r.version for r in rows} - {version}:
            raise ValueError(f"{folder} holds rounds of version {', '.join(sorted(others))}, not {version}")
        self.rounds = {r["round"]: dict(r["tables"]) for r in rows}

    @property
    def last(self) -> int:
        """The last round up to which all are committed; -1 without any."""
        last = -1
        while last + 1 in self.rounds:
            last += 1
        return last

    def table(self, round_: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self.rounds[round_][name])

    def commit(self, round_: int, **tables: DataFrame) -> dict[str, DataFrame]:
        """The tables written, the round committed; the tables as they are read back."""
        paths = {n: f"{self.folder}/round-{round_}/{n}-{uuid.uuid4().hex}" for n in tables}
        for name, df in tables.items():
            df.write.parquet(paths[name])
        row = self.spark.createDataFrame([(self.version, round_, paths)], COMMIT)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        self.rounds[round_] = paths
        return {n: self.spark.read.schema(df.schema).parquet(paths[n]) for n, df in tables.items()}
