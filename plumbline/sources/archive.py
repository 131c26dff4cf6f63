"""Bar stores: a partitioned archive that never changes what it holds, a versioned store, a hot store of the newest bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)


class SchemaError(ValueError):
    """A frame hasn't the columns of bars."""


class ImmutableArchiveError(ValueError):
    """A write would change bars that the archive holds."""


def ensure_bars(df: DataFrame) -> DataFrame:
    """Bars with their columns in order; any other set of columns is an error."""
    if set(df.columns) != set(BAR_SCHEMA.names):
        raise SchemaError(f"expected {BAR_SCHEMA.names}, got {df.columns}")
    return df.select(*(F.col(f.name).cast(f.dataType) for f in BAR_SCHEMA))


def empty_bars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BAR_SCHEMA)


def between(bars: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows of the closed range."""
    return bars.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def concat(frames: list[DataFrame], spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.unionByName, frames, empty_bars(spark)).orderBy("symbol", "ts")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality without regard to order; repeated rows count."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def keep_last(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Of the rows of a key the last by order."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest(bars: DataFrame, n: int, by: str = "symbol", ts: str = "ts") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(ts))
    return bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def merged(held: DataFrame, incoming: DataFrame, most: int) -> DataFrame:
    """The hot store after a write: incoming bars win, then the newest of each symbol stay."""
    both = held.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)))
    return newest(keep_last(both, ("symbol", "ts"), ("_src",)).drop("_src"), most)


class ParquetArchive:
    """Bars in symbol=/date= folders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _held(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(T.StructType([*BAR_SCHEMA.fields, T.StructField("date", T.DateType())])).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def write(self, bars: DataFrame) -> None:
        """Adds days that aren't held; a day that is must be the same, or nothing is written."""
        bars = ensure_bars(bars).withColumn("date", F.to_date("ts"))
        held = self._held()
        if held is not None:
            days = held.select("symbol", "date").distinct()
            again = bars.join(days, ["symbol", "date"], "left_semi")
            old = held.join(again.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi")
            if not same_rows(again, old):
                raise ImmutableArchiveError("bars of a stored day differ")
            bars = bars.join(days, ["symbol", "date"], "left_anti")
        bars.write.mode("append").partitionBy("symbol", "date").parquet(self.path)

    def read(self, symbol: str, start: str, end: str) -> DataFrame:
        """A symbol's bars of the closed range, in order; whole days are pruned by their folders."""
        held = self._held()
        if held is None:
            return empty_bars(self.spark)
        days = F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
        return between(held.where((F.col("symbol") == symbol) & days), start, end).select(*BAR_SCHEMA.names).orderBy("ts")

    def symbols(self) -> list[str]:
        held = self._held()
        return [] if held is None else [r[0] for r in held.select("symbol").distinct().orderBy("symbol").collect()]


class VersionedStore:
    """Every write of a symbol that changes something is a version, from 1."""

    def __init__(self, spark: SparkSession, path: str):
        self.archive = ParquetArchive(spark, path)
        self.spark, self.path = spark, path
        self.schema = T.StructType([*BAR_SCHEMA.fields, T.StructField("version", T.IntegerType())])

    def _held(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def versions(self, symbol: str) -> list[int]:
        held = self._held()
        return [] if held is None else sorted(r[0] for r in held.where(F.col("symbol") == symbol).select("version").distinct().collect())

    def write(self, symbol: str, bars: DataFrame) -> int:
        bars, known = ensure_bars(bars).where(F.col("symbol") == symbol), self.versions(symbol)
        if known and same_rows(bars, self.read(symbol)):
            return known[-1]
        version = (known[-1] if known else 0) + 1
        bars.withColumn("version", F.lit(version)).write.mode("append").partitionBy("symbol", "version").parquet(self.path)
        return version

    def read(self, symbol: str, version: int | None = None) -> DataFrame:
        known = self.versions(symbol)
        version = version if version is not None else (known[-1] if known else 0)
        if version not in known:
            raise KeyError(f"{symbol} has no version {version}")
        return self._held().where((F.col("symbol") == symbol) & (F.col("version") == version)).drop("version").select(*BAR_SCHEMA.names).orderBy("ts")


def verify_chain(entries: DataFrame) -> DataFrame:
    """Entries (seq, payload, prev_hash, entry_hash) with ok: the hash is that of seq, payload and the previous hash,
    and the numbers are without gap. One ordered pass, as a log is one chain."""
    w = Window.partitionBy("log").orderBy("seq")
    expected = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "payload", "prev_hash"), 256)
    linked = F.coalesce(F.lag("entry_hash").over(w), F.lit("")) == F.col("prev_hash")
    step = F.col("seq") - F.coalesce(F.lag("seq").over(w), F.col("seq") - 1) == 1
    return entries.withColumn("ok", (expected == F.col("entry_hash")) & linked & step)


def assembled(shards: DataFrame, identifier: str, order: tuple[str, ...]) -> DataFrame:
    """date, symbol, close of united shards (identifier, symbol, ts, close): an identifier's rows go under the name that it
    has in its latest row by order, and of a name's rows of a day the last by order stays."""
    at = F.struct(*order)
    latest = shards.groupBy(identifier).agg(F.max_by("symbol", at).alias("_name"))
    named = shards.join(latest, identifier)
    return named.groupBy(F.to_date("ts").alias("date"), F.col("_name").alias("symbol")).agg(F.max_by("close", at).alias("close"))
