"""A history of assessment runs: an append-only log, in which a deletion is a mark, read as what is left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "run_id string, user_id string, source string, score double, tier string, detail string, at timestamp, deleted boolean"


@dataclass
class HistoryStore:
    """A log in a folder that all executors share; a run recorded again replaces its earlier record."""

    spark: SparkSession
    path: str

    def record(self, runs: DataFrame) -> None:
        """Appends runs (run_id, user_id, source, score, tier, detail, at); those without run or user are refused."""
        runs.where("run_id <> '' and user_id <> ''").select("run_id", "user_id", "source", "score", "tier", "detail", F.col("at").cast("timestamp").alias("at"), F.lit(False).alias("deleted")).write.mode("append").parquet(self.path)

    def delete(self, runs: DataFrame) -> None:
        """Marks runs (run_id, user_id) as deleted: a user deletes only their own."""
        own = self.runs().join(runs.select("run_id", "user_id").distinct(), ["run_id", "user_id"], "left_semi")
        own.withColumn("deleted", F.lit(True)).select(*[c.split()[0] for c in LOG.split(", ")]).write.mode("append").parquet(self.path)

    def runs(self) -> DataFrame:
        """The runs that are left: of each the latest record, unless one says deleted. Records combine before the shuffle."""
        log = self.spark.read.schema(LOG).parquet(self.path)
        last = log.groupBy("run_id").agg(F.max(F.struct("at", *[c for c in log.columns if c not in ("run_id", "at", "deleted")])).alias("s"), F.bool_or("deleted").alias("gone"))
        return last.where("not gone").select("run_id", "s.*")

    def recent(self, user_id: str, most: int) -> DataFrame:
        """A user's runs, the latest first."""
        return self.runs().where(F.col("user_id") == user_id).orderBy(F.desc("at"), "run_id").limit(most)

    def recent_of_all(self, most: int) -> DataFrame:
        """The latest runs of every user; each task keeps its own first before the shuffle."""
        place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), "run_id"))
        return self.runs().withColumn("place", place).where(F.col("place") <= most)

    def users(self) -> DataFrame:
        """(user_id, runs, mean_score, last_at)."""
        return self.runs().groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.avg("score").alias("mean_score"), F.max("at").alias("last_at"))
