"""Stores that streams write to: a batch that is retried replaces itself, and the last row of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import filesystem, remove


class MergedStore:
    """Rows below path, of which the last of every key counts.

    Every batch is a folder of its own (batch=N), written as a whole: a retried batch replaces its folder and nothing else,
    so that it is stored once however often it runs. compact() merges what is stored into a base (base=N, all batches up to
    N) beside it and deletes what it holds afterwards; a base counts once its writer has marked it as complete. Reading
    takes the newest base and the batches after it.

    schema: of the rows; keys: columns that tell what a row is about; order: columns that order the rows of a key within a
    batch (the last stays); day: a timestamp column whose date parts the files, so that reading a range of days reads only
    those."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], day: str | None = None):
        self.spark, self.path, self.schema, self.keys, self.order, self.day = spark, path.rstrip("/"), schema, keys, order, day

    def _folders(self, kind: str) -> list[int]:
        fs, at = filesystem(self.spark, self.path)
        if not fs.exists(at):
            return []
        named = (s.getPath().getName() for s in fs.listStatus(at))
        found = sorted(int(n.split("=")[1]) for n in named if n.startswith(f"{kind}="))
        return [n for n in found if fs.exists(filesystem(self.spark, f"{self.path}/{kind}={n}/_SUCCESS")[1])]

    def _write(self, rows: DataFrame, folder: str) -> None:
        out = rows.withColumn("_day", F.to_date(self.day)) if self.day else rows
        writer = out.write.mode("overwrite")
        (writer.partitionBy("_day") if self.day else writer).parquet(f"{self.path}/{folder}")

    def _last(self, rows: DataFrame, order: list[str | Column]) -> DataFrame:
        w = Window.partitionBy(*self.keys).orderBy(*(F.desc(c) for c in order))
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def write(self, batch: DataFrame, number: int) -> None:
        """Stores a batch under its number, in place of what was stored under it; the batches of a base are done with."""
        base = self._folders("base")
        if base and number <= base[-1]:
            return
        self._write(self._last(batch.select(*self.schema.names), self.order), f"batch={number}")

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The last row of every key, of the days from first to last (ISO dates) if given."""
        base, batches = self._folders("base"), self._folders("batch")
        held = None
        after = [("batch", n) for n in batches if not base or n > base[-1]]
        for kind, n in ([("base", base[-1])] if base else []) + after:
            schema = T.StructType([*self.schema.fields, T.StructField("_day", T.DateType())]) if self.day else self.schema
            one = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}={n}")
            if self.day and (first or last):
                one = one.where(F.col("_day").between(F.to_date(F.lit(first or "0001-01-01")), F.to_date(F.lit(last or "9999-12-31"))))
            one = one.select(*self.schema.names, F.lit(n).cast("long").alias("_batch"))
            held = one if held is None else held.unionByName(one)
        if held is None:
            return self.spark.createDataFrame([], self.schema)
        return self._last(held, ["_batch", *self.order]).select(*self.schema.names)

    def compact(self) -> None:
        """Merges all that is stored into a base and deletes the folders it replaces."""
        base, batches = self._folders("base"), self._folders("batch")
        upto = max([*base, *batches], default=None)
        if upto is None or (base and upto == base[-1]):
            return
        self._write(self.read(), f"base={upto}")
        for kind, numbers in (("base", base), ("batch", batches)):
            for n in numbers:
                if n <= upto:
                    remove(self.spark, f"{self.path}/{kind}={n}") if (kind, n) != ("base", upto) else None

    def sink(self, stream: DataFrame, checkpoint: str):
        """Starts a query that drains the stream into the store. Returns the query."""
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def depth_store(spark: SparkSession, path: str, snapshots: DataFrame, order: list[str]) -> MergedStore:
    """The store of depth snapshots with the columns of snapshots: of a symbol and time the last stays."""
    return MergedStore(spark, path, snapshots.schema, ["symbol", "ts"], order, "ts")


def reaction_store(spark: SparkSession, path: str, reactions: DataFrame, order: list[str]) -> MergedStore:
    """The store of reactions to events with the columns of reactions: of a symbol and event time the last stays."""
    return MergedStore(spark, path, reactions.schema, ["symbol", "event_time"], order)
