"""The event log as a store whose maintenance rewrites partitions under a manifest.

Tables lie in folders by key, day and version.  The manifest, a small Parquet table per version, says which
(partition, version) is in force; readers join it, so Spark prunes to live folders.  A change writes new folders for the
partitions it touches, then the next manifest, and with that takes effect at once; partitions it does not touch keep
their files.  A change that fails before its manifest leaves nothing but folders that nobody reads, which `vacuum`
removes.  One writer at a time.  Audit rows are only ever added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policylens.operators.joins import known_rewards
from policylens.operators.retention import unlearned_losses
from policylens.schema import AUDIT, DECISIONS, KEY, MODEL_HEADER, MODEL_SLOTS, REWARDS
from policylens.session import attach, checkpointed

SCHEMAS = {"decisions": DECISIONS, "rewards": REWARDS, "models": MODEL_HEADER, "slots": MODEL_SLOTS, "audit": AUDIT}
#: Tables cut by day as well as by key.
DAILY = ("decisions", "rewards")
PARTITION = [*KEY, "day", "version_"]


class RefusedError(ValueError):
    """The change would lose rewards that no model has learned from."""


def day_of(table: str) -> Column:
    """The day partition of a row; one for all days where a table is not cut by day."""
    return F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd") if table in DAILY else F.lit("all")


class Store:
    """A store under `root`, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.version = self._latest()

    def _folder(self) -> tuple:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> int:
        """The newest manifest that was written whole; 0 for an empty store."""
        jvm, fs = self._folder()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/*/_SUCCESS")) or []
        return max((int(s.getPath().getParent().getName().removeprefix("v")) for s in found), default=0)

    def manifest(self) -> DataFrame:
        """(table, KEY, day, version_, rows): the folders in force."""
        schema = "table string, tenant string, job string, capsule string, day string, version_ bigint, rows bigint"
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/manifest/v{self.version}")

    def read(self, table: str) -> DataFrame:
        """The rows of a table that are in force."""
        columns = SCHEMAS[table].fieldNames()
        live = self.manifest().filter(F.col("table") == table).select(*PARTITION)
        if not self.version or live.isEmpty():
            return self.spark.createDataFrame([], SCHEMAS[table])
        return attach(self._files(table), live, PARTITION).select(*columns)

    def _files(self, table: str) -> DataFrame:
        inside = [f for f in SCHEMAS[table].fields if f.name not in KEY]
        cut = [T.StructField(c, T.LongType() if c == "version_" else T.StringType()) for c in PARTITION]
        return self.spark.read.schema(T.StructType([*inside, *cut])).parquet(f"{self.root}/{table}")

    def _write(self, table: str, rows: DataFrame, version: int) -> DataFrame:
        """New folders of one version; their manifest rows."""
        fields = SCHEMAS[table].fields
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).withColumn("day", day_of(table)).withColumn("version_", F.lit(version).cast("long"))
        # one task's file per partition; AQE cuts a large one
        out.hint("rebalance", *KEY, "day").write.mode("append").partitionBy(*PARTITION).parquet(f"{self.root}/{table}")
        written = self._files(table).filter(F.col("version_") == version)
        return written.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("table"), *PARTITION, "rows")

    def commit(
        self, replaced: dict[str, DataFrame] | None = None, gone: DataFrame | None = None, added: dict[str, DataFrame] | None = None
    ) -> int:
        """The next version: `gone` names (table, KEY, day) partitions that end, `replaced` holds the rows that stay of
        them, and `added` rows that come beside what is there.  Returns the version."""
        version = self.version + 1
        kept = self.manifest()
        if gone is not None:
            kept = kept.join(gone.select("table", *KEY, "day").distinct(), ["table", *KEY, "day"], "left_anti")
        made = [self._write(t, rows, version) for t, rows in [*(replaced or {}).items(), *(added or {}).items()]]
        for part in made:
            kept = kept.unionByName(part)
        kept.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v{version}")
        self.version = version
        return version

    def append(self, **tables: DataFrame) -> int:
        """Rows added to tables (E1's and E2's winners, new models, audit rows)."""
        return self.commit(added=tables)

    def _audit(self, counts: DataFrame, now_ms: int, event: str, fields: list[str]) -> DataFrame:
        """An audit row per capsule of `counts`."""
        last = self.read("audit").groupBy(*KEY).agg(F.max("seq").alias("last"))
        return counts.join(last, KEY, "left").select(
            *KEY, (F.coalesce("last", F.lit(0)) + 1).alias("seq"), F.lit(now_ms).cast("long").alias("ts_ms"), F.lit(event).alias("event"),
            F.to_json(F.struct(*fields)).alias("detail"),
        )

    def prune(self, before_ms: int, now_ms: int) -> DataFrame:
        """Decisions before a time go with their rewards (E7); refused if a model has yet to learn from one of these.

        Days that end before it are dropped by name; the day it falls on, and the partitions that hold a removed reward,
        are written again.  Returns the counts per capsule, which the audit log keeps.
        """
        decisions, rewards = self.read("decisions"), self.read("rewards")
        lost = unlearned_losses(decisions, rewards, self.read("models"), before_ms)
        if (n := lost.count()) > 0:
            raise RefusedError(f"{n} capsules would lose rewards that their model has not learned: fold a model first")
        gone = decisions.filter(F.col("ts_ms") < before_ms)
        removed = checkpointed(known_rewards(rewards, gone))
        paid = removed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("removedRewards"))
        counts = checkpointed(gone.groupBy(*KEY).agg(F.count(F.lit(1)).alias("removedDecisions")).join(paid, KEY, "left").fillna(0))
        touched = checkpointed(
            gone.select(F.lit("decisions").alias("table"), *KEY, day_of("decisions").alias("day"))
            .unionByName(removed.select(F.lit("rewards").alias("table"), *KEY, day_of("rewards").alias("day"))).distinct()
        )

        def left(table: str, rows: DataFrame) -> DataFrame:
            """Rows of the touched partitions of a table."""
            here = touched.filter(F.col("table") == table).select(*KEY, "day")
            return attach(rows.withColumn("day", day_of(table)), here, [*KEY, "day"]).drop("day")

        stays = left("decisions", decisions).filter(F.col("ts_ms") >= before_ms)
        still = known_rewards(left("rewards", rewards), gone, known=False)
        self.commit(
            {"decisions": stays, "rewards": still}, touched,
            {"audit": self._audit(counts, now_ms, "logs_pruned", ["removedDecisions", "removedRewards"])},
        )
        return counts

    def erase(self, prefix: tuple[str, ...], now_ms: int) -> DataFrame:
        """A tenant, job or capsule goes from all tables but the audit log (E8), by folder; no row is read."""
        hit = F.col("table") != "audit"
        for name, value in zip(KEY, prefix, strict=False):
            hit = hit & (F.col(name) == value)
        gone = checkpointed(self.manifest().filter(hit))
        counts = checkpointed(gone.groupBy(*KEY).agg(F.sum("rows").alias("removedRows")))
        self.commit(gone=gone, added={"audit": self._audit(counts, now_ms, "capsule_deleted", ["removedRows"])})
        return counts

    def purge(self, key: tuple[str, str, str], now_ms: int) -> DataFrame:
        """A capsule's decisions and rewards go, its models stay (E9); refused while rewards are not learned."""
        hit = F.lit(True)
        for name, value in zip(KEY, key, strict=True):
            hit = hit & (F.col(name) == value)
        mine = [self.read(t).filter(hit) for t in ("decisions", "rewards", "models")]
        if not unlearned_losses(*mine, 1 << 62).isEmpty():
            raise RefusedError("its model has not learned from all rewards: fold a model first")
        gone = checkpointed(self.manifest().filter(hit & F.col("table").isin(*DAILY)))
        counts = checkpointed(gone.groupBy(*KEY).agg(
            *[F.sum(F.when(F.col("table") == t, F.col("rows")).otherwise(0)).alias(f"removed{t.capitalize()}") for t in DAILY]
        ))
        self.commit(gone=gone, added={"audit": self._audit(counts, now_ms, "logs_purged", [f"removed{t.capitalize()}" for t in DAILY])})
        return counts

    def keep_newest_models(self, keep: int, now_ms: int) -> None:
        """Older models than the newest `keep` of each capsule go, header and slots (W2); only capsules that have more are written."""
        heads = self.read("models")
        many = checkpointed(heads.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("version"), asc=False)[keep - 1].alias("least")).filter(F.col("n") > keep))
        parts = many.select(*KEY, F.lit("all").alias("day"), F.explode(F.array(F.lit("models"), F.lit("slots"))).alias("table"))
        rest = {t: self.read(t).join(many.select(*KEY, "least"), KEY).filter("version >= least").drop("least") for t in ("models", "slots")}
        self.commit(rest, parts, {"audit": self._audit(many.select(*KEY, (F.col("n") - keep).alias("removedModels")), now_ms, "models_pruned", ["removedModels"])})

    def vacuum(self) -> int:
        """Deletes the folders and manifests that are no longer in force; returns how many folders went.

        What a change drops stays readable by the version before it until then; erased data is gone after this.
        """
        jvm, fs = self._folder()
        live = {(r["table"], *(r[c] for c in PARTITION)) for r in self.manifest().collect()}  # folders, not rows
        n = 0
        for table in SCHEMAS:
            for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/*/*/*/*/*")) or []:
                parts = [jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(p.split("=", 1)[1]) for p in status.getPath().toString().split("/")[-5:]]
                if (table, *parts[:4], int(parts[4])) not in live:
                    fs.delete(status.getPath(), True)
                    n += 1
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/*")) or []:
            if status.getPath().getName() != f"v{self.version}":
                fs.delete(status.getPath(), True)
        return n
