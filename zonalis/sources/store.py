"""A store of results by key, for many keys at once.

Every save writes its rows, then its status rows, under a new run; nothing is overwritten, so readers of older runs go on.
The newest status of a key within its lifetime decides: a success gives the rows of its run, an error gives none and is
tried again. Wanted keys are told from stored ones by an anti join; no key reaches the driver.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = "key string, run string, state string, message string, at double"


@dataclass
class ResultStore:
    """Results of one form (one query over one environment) under `root`, in any store that Spark reaches."""

    spark: SparkSession
    root: str
    lifetime: float = 172_800

    def status(self) -> DataFrame:
        """(key, run, state, message, at): the newest status of every key within the lifetime."""
        try:
            runs = self.spark.read.schema(STATUS).parquet(f"{self.root}/status")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STATUS)
        young = runs.where(F.col("at") > F.lit(time.time() - self.lifetime))
        last = young.groupBy("key").agg(F.max(F.struct("at", "run", "state", "message")).alias("s"))
        return last.select("key", "s.run", "s.state", "s.message", "s.at")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The rows of wanted (key, ...) whose key has no stored success."""
        return wanted.join(self.status().where("state = 'success'").select("key"), "key", "left_anti")

    def save(self, rows: DataFrame, status: DataFrame) -> None:
        """rows (key, ...) and status (key, state, message) of the same keys; keys count from when their status is written."""
        run = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/rows/run={run}")
        out = status.select("key", F.lit(run).alias("run"), "state", "message", F.lit(time.time()).alias("at"))
        out.write.mode("append").parquet(f"{self.root}/status")

    def get(self, wanted: DataFrame) -> DataFrame | None:
        """The stored rows of the wanted (key) that succeeded; None where nothing was ever stored."""
        good = self.status().where("state = 'success'").join(wanted.select("key").distinct(), "key", "left_semi").select("key", "run")
        try:
            rows = self.spark.read.parquet(f"{self.root}/rows")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.join(good, ["key", "run"]).drop("run")
