"""Versions of entities as an append-only log of transitions, folded to their present states.

A batch of transitions is checked against the states before it: what is legal is appended as files of its own, what is not
comes back with a reason. A version's state is that of its last transition, one grouped maximum that combines before the
shuffle, so that an entity of any number of versions is no task's burden. The snapshot keeps states in buckets of entities
and is overwritten only in the buckets that a batch touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "batch int, place long, entity_id string, version_number long, status string, data string, rolled_back_from long"
STATES = "entity_id string, version_number long, status string, data string, checksum string, rolled_back_from long"
#: What a transition makes of the version that it names; create and rollback make a new one.
EFFECTS = {"deprecate": "deprecated", "archive": "archived", "rollback": "rolled_back"}
ACTIVE = "active"
BUCKETS = 64


@dataclass
class VersionStore:
    """A store in a folder that all executors share; batches are numbered by the caller's appends."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    batches: int = 0

    def log(self) -> DataFrame:
        empty = self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log") if self.batches else empty

    def states(self) -> DataFrame:
        """(entity_id, version_number, status, data, checksum, rolled_back_from): every version after all batches."""
        last = self.log().groupBy("entity_id", "version_number").agg(F.max(F.struct("batch", "place", "status")).alias("s"), F.max("data").alias("data"), F.max("rolled_back_from").alias("rolled_back_from"))
        return last.select("entity_id", "version_number", "s.status", "data", F.sha2("data", 256).alias("checksum"), "rolled_back_from")

    def snapshot(self) -> DataFrame:
        """The states that were written last; those of buckets that no batch has touched are as they were."""
        return self.spark.read.schema(f"{STATES}, bucket int").parquet(f"{self.path}/states").drop("bucket")

    def append(self, actions: DataFrame) -> DataFrame:
        """Applies actions (place, entity_id, action, version_number, data) and returns the refused ones with a reason.

        create takes data and numbers a new version; rollback makes a new version with the data of the one that it names;
        deprecate and archive change the one that they name. Actions see the states before the batch: one that names a
        version of its own batch is refused, as are empty entities and data, unknown actions and versions that the entity
        lacks. Places order the batch and are distinct; of several actions on a version the last one counts.
        """
        states = self.states().select("entity_id", "version_number", F.col("data").alias("__data"))
        known = actions.select("place", "entity_id", "action", F.col("version_number").cast("long").alias("version_number"), "data").join(states, ["entity_id", "version_number"], "left")
        create = F.col("action") == "create"
        reason = (
            F.when(F.coalesce("entity_id", F.lit("")) == "", "entity_id is empty").when(create & (F.coalesce("data", F.lit("")) == ""), "data is empty")
            .when(F.coalesce(~F.col("action").isin("create", *EFFECTS), F.lit(True)), "unknown action").when(~create & F.col("__data").isNull(), "no such version")
        )
        batch = f"{self.path}/checked/{self.batches}"
        known.withColumn("reason", reason).write.parquet(batch)
        checked = self.spark.read.parquet(batch)
        legal = checked.where("reason is null")
        made = legal.where("action in ('create', 'rollback')")
        newest = self.states().groupBy("entity_id").agg(F.max("version_number").alias("__newest"))
        number = F.row_number().over(Window.partitionBy("entity_id").orderBy("place"))
        fresh = made.withColumn("__n", number).join(newest, "entity_id", "left").select(
            F.lit(self.batches).alias("batch"), "place", "entity_id", (F.coalesce("__newest", F.lit(0)) + F.col("__n")).cast("long").alias("version_number"), F.lit(ACTIVE).alias("status"),
            F.when(F.col("action") == "create", F.col("data")).otherwise(F.col("__data")).alias("data"), F.when(F.col("action") == "rollback", F.col("version_number")).alias("rolled_back_from"))
        effect = F.create_map(*[F.lit(x) for kv in EFFECTS.items() for x in kv])[F.col("action")]
        changed = legal.where("action <> 'create'").select(F.lit(self.batches).alias("batch"), "place", "entity_id", "version_number", effect.alias("status"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("long").alias("rolled_back_from"))
        fresh.unionByName(changed).write.mode("append").parquet(f"{self.path}/log")
        self.batches += 1
        bucket = F.pmod(F.xxhash64("entity_id"), F.lit(self.buckets)).cast("int")
        touched = legal.select(bucket.alias("bucket")).distinct()
        dealt = self.states().withColumn("bucket", bucket).join(F.broadcast(touched), "bucket", "left_semi")
        dealt.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/states")
        return checked.where("reason is not null").select("place", "entity_id", "action", "version_number", "reason")


def version_statistics(states: DataFrame) -> DataFrame:
    """(entity_id, total, active, deprecated, archived, rolled_back, bytes, latest) of states."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in (ACTIVE, *EFFECTS.values())]
    return states.groupBy("entity_id").agg(F.count(F.lit(1)).alias("total"), *counts, F.sum(F.octet_length("data")).alias("bytes"), F.max("version_number").alias("latest"))
