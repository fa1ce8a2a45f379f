"""Round-by-round iteration over a table of open rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.plans.manifest import read_manifests, write_manifest
from ballast.plans.scratch import drop_folder, new_folder

# Fixed value: the loop that this one stands for ends after so many rounds.
MAX_ROUNDS = 1000

# Open rows per task: with fewer than the first number another task is not worth it, with
# more than the second the written table has enough parts by itself.
FEW_ROWS = 100
MANY_ROWS = 100_000

HISTORY = "round INT, n_open BIGINT, n_closed BIGINT, stop_reason STRING"

# The folder of a round.
ROUND = "loop_round"

Step = Callable[[DataFrame, int, int], DataFrame]
Park = Callable[[DataFrame, int], DataFrame | None]
Revive = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Iteration:
    """``emitted``: closed rows of all rounds; ``open``: rows left open at the end, parked ones too;
    ``history``: (round, n_open, n_closed, stop_reason); ``stop_reason``: empty, halted or
    max_rounds; ``folder``: where the loop has its tables, for :func:`resume`; ``rows``: all rows of all rounds that are
    still there."""

    emitted: DataFrame
    open: DataFrame
    history: DataFrame
    stop_reason: str
    rounds: int
    folder: str
    rows: DataFrame


def iterate_until_empty(
    seed: DataFrame,
    step: Step,
    max_rounds: int | None = MAX_ROUNDS,
    halt: Column | None = None,
    label: str = "frontier",
    park: Park | None = None,
    revive: Revive | None = None,
    keep: bool = False,
    deal_up_to: int | None = None,
) -> Iteration:
    """Apply ``step`` to the open rows until none is left.

    ``step(open_rows, round, n_open)`` returns the columns of ``seed`` and a boolean
    ``open``; rows with ``open = false`` are emitted, the others enter the next round.
    ``halt`` is a condition on those rows that ends the loop when it holds for any of them.
    ``max_rounds=None`` sets no limit.

    Each round is one job. Its rows are written to the shared scratch folder, which ends
    the lineage, and the open rows of the round before are dropped, unless ``keep`` says that they are still
    needed. Open rows that are few are dealt out evenly to all tasks, unless there are more than ``deal_up_to``: a step that spreads so
    many by itself would send them twice. Only the counts and the halt flag come to the driver.

    ``park(open_rows, n_open)`` may hold rows back: it returns them with an INT ``wave``, or None if all of them enter the next
    round. Those of wave 0 enter. The others wait in a table; when a later round leaves nothing open, the next wave of the
    newest such table enters, as far as ``revive(waiting_rows, emitted)``, by default all of them, still returns its rows. Waves
    are few: the driver keeps a count for each.

    Every finished round leaves a manifest; :func:`resume` goes on behind the last one.
    """
    spark = seed.sparkSession
    folder = new_folder(spark, label)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in seed.schema.fields])
    loop = _Loop(spark, folder, schema, step, halt, park, revive, keep, deal_up_to)
    loop.start(seed)
    return loop.run(max_rounds)


def resume(
    spark: SparkSession,
    folder: str,
    step: Step,
    max_rounds: int | None = MAX_ROUNDS,
    halt: Column | None = None,
    park: Park | None = None,
    revive: Revive | None = None,
    keep: bool = False,
    deal_up_to: int | None = None,
) -> Iteration:
    """Go on with a loop whose driver was lost or that ended at its round limit, behind its last finished round.

    ``folder`` is that of its tables, the other arguments are those of the loop. What an unfinished round has
    written is written anew.
    """
    loop = _Loop(spark, folder, None, step, halt, park, revive, keep, deal_up_to)
    loop.recover()
    return loop.run(max_rounds)


class _Loop:
    """The state between rounds: the manifest of the last one is all of it, besides the tables."""

    def __init__(self, spark, folder, schema, step, halt, park, revive, keep, deal_up_to):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.step, self.halt, self.park, self.revive, self.keep = step, halt, park, revive, keep
        self.deal_up_to = deal_up_to
        self.history: list[tuple] = []

    def start(self, seed: DataFrame) -> None:
        self.state = {"round": 0, "schema": self.schema.json(), "waiting": []}
        self.finish(self.write(seed.withColumn("open", F.lit(True)), 0))

    def recover(self) -> None:
        records = read_manifests(self.spark, self.folder)
        if not records:
            raise ValueError(f"no round of {self.folder} is complete")
        self.schema = T.StructType.fromJson(json.loads(records[0]["schema"]))
        self.history = [tuple(r["counts"]) for r in records]
        self.state = records[-1]

    def finish(self, seen: dict) -> None:
        """Record a round that has been written."""
        number = self.state["round"]
        held = self.held()
        self.state |= {"n_open": seen["n_open"], "halted": seen["halted"]}
        self.state["counts"] = [number, seen["n_open"] + held, seen["n_closed"]]
        self.history.append(tuple(self.state["counts"]))
        write_manifest(self.spark, self.folder, number, self.state)

    @property
    def stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("is_open", T.IntegerType())])

    def write(self, rows: DataFrame, number: int) -> dict:
        flag = F.coalesce(self.halt, F.lit(False)) if self.halt is not None else F.lit(False)
        seen = Observation()
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], "open")
        rows = rows.observe(
            seen,
            F.coalesce(F.count_if("open"), F.lit(0)).alias("n_open"),
            F.coalesce(F.count_if(~F.col("open")), F.lit(0)).alias("n_closed"),
            F.coalesce(F.bool_or(flag), F.lit(False)).alias("halted"),
        )
        rows = rows.withColumn("is_open", F.col("open").cast("int")).drop("open")
        rows.write.mode("overwrite").partitionBy("is_open").parquet(f"{self.folder}/rounds/{ROUND}={number}")
        return seen.get

    def dealt(self, rows: DataFrame, n_open: int) -> DataFrame:
        # The tasks that a shuffle has; executors may come and go between rounds.
        parallelism = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if n_open > parallelism * MANY_ROWS:
            return rows
        return rows.repartition(min(parallelism, n_open // FEW_ROWS + 1))

    def open_rows(self, number: int) -> DataFrame:
        path = f"{self.folder}/rounds/{ROUND}={number}"
        return self.spark.read.schema(self.stored).parquet(path).where("is_open = 1").drop("is_open")

    def emitted(self) -> DataFrame:
        return self.rows().where("is_open = 0").select(*self.schema.names)

    def rows(self) -> DataFrame:
        stored = T.StructType([*self.stored.fields, T.StructField(ROUND, T.IntegerType())])
        done = [f"{self.folder}/rounds/{ROUND}={r[0]}" for r in self.history]
        return self.spark.read.schema(stored).option("basePath", f"{self.folder}/rounds").parquet(*done)

    def held(self) -> int:
        return sum(n for _, waves in self.state["waiting"] for _, n in waves)

    def parked(self, path: str, first: int = 0) -> DataFrame:
        """The rows of a waiting table from a wave on."""
        stored = T.StructType([*self.schema.fields, T.StructField("wave", T.IntegerType())])
        return self.spark.read.schema(stored).parquet(path).where(F.col("wave") >= first)

    @staticmethod
    def waves(rows: DataFrame) -> list[list[int]]:
        return sorted([r["wave"], r["count"]] for r in rows.groupBy("wave").count().collect())

    def admit(self) -> tuple[DataFrame | None, int]:
        """The rows of the next round and their number; ``waiting`` is what then still waits."""
        number, n_open = self.state["round"], self.state["n_open"]
        self.waiting = list(self.state["waiting"])
        if n_open:
            rows = self.open_rows(number)
            waved = self.park(rows, n_open) if self.park is not None else None
            if waved is None:
                return rows, n_open
            path = f"{self.folder}/waiting/{number}"
            waved.select(*self.schema.names, F.col("wave").cast("int").alias("wave")).write.mode("overwrite").parquet(path)
            waves = self.waves(self.parked(path))
            now = [n for w, n in waves if w == 0]
            if later := [x for x in waves if x[0] > 0]:
                self.waiting.append([path, later])
            if now:
                return self.parked(path).where("wave = 0").drop("wave"), now[0]
        while self.waiting:
            path, waves = self.waiting.pop()
            rows = self.parked(path, waves[0][0])
            if self.revive is not None:
                rows = self.revive(rows, self.emitted())
                waves = self.waves(rows)
            if waves:
                if waves[1:]:
                    self.waiting.append([path, waves[1:]])
                return rows.where(F.col("wave") == waves[0][0]).select(*self.schema.names), waves[0][1]
        return None, 0

    def run(self, max_rounds: int | None) -> Iteration:
        while True:
            number = self.state["round"]
            if self.state["halted"]:
                reason = "halted"
            elif self.state["n_open"] == 0 and not self.state["waiting"]:
                reason = "empty"
            elif number == max_rounds:
                reason = "max_rounds"
            else:
                rows, n_open = self.admit()
                self.state = self.state | {"round": number + 1, "waiting": self.waiting}
                if n_open:
                    if self.deal_up_to is None or n_open <= self.deal_up_to:
                        rows = self.dealt(rows, n_open)
                    seen = self.write(self.step(rows, number, n_open), number + 1)
                else:  # nothing that was held back is worth a round any more
                    empty = self.spark.createDataFrame([], self.schema).withColumn("open", F.lit(True))
                    seen = self.write(empty, number + 1)
                self.finish(seen)
                if not self.keep:
                    drop_folder(self.spark, f"{self.folder}/rounds/{ROUND}={number}/is_open=1")
                continue
            break
        left = self.open_rows(number)
        for path, waves in self.state["waiting"]:
            left = left.unionByName(self.parked(path, waves[0][0]).drop("wave"))
        history = [(*row, None) for row in self.history]
        history[-1] = (*history[-1][:3], reason)
        n_left = self.state["n_open"] + self.held()
        frame = self.spark.createDataFrame(history, HISTORY)
        return Iteration(self.emitted(), self.dealt(left, n_left), frame, reason, number, self.folder, self.rows())
