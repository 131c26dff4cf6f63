"""Daily files of an exchange, dimension files, change logs and made-up bars."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The two layouts of the exchange's daily file, our name and theirs.
LAYOUTS = {
    "new": {"symbol": "TckrSymb", "isin": "ISIN", "series": "SctySrs", "open": "OpnPric", "high": "HghPric", "low": "LwPric", "close": "ClsPric", "volume": "TtlTradgVol", "value": "TtlTrfVal", "trades": "TtlNbOfTxsExctd"},
    "legacy": {"symbol": "SYMBOL", "isin": "ISIN", "series": "SERIES", "open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "volume": "TOTTRDQTY", "value": "TOTTRDVAL", "trades": "TOTALTRADES"},
}


def unzipped(files: DataFrame) -> DataFrame:
    """file, header, line of the first CSV member of every zip of files (path, content); a file without one is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if n.lower().endswith(".csv")]
                    if not names:
                        raise ValueError(f"{path} holds no CSV")
                    text = archive.read(names[0]).decode("utf-8-sig").splitlines()
                head, rows = text[0], [x for x in text[1:] if x.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([head] * len(rows), pa.string()), pa.array(rows, pa.string())], ["file", "header", "line"])

    return files.select("path", "content").mapInArrow(run, "file string, header string, line string")


def daily_rows(lines: DataFrame, day: Column, series: tuple[str, ...] = ("EQ",)) -> DataFrame:
    """symbol, isin, series, ts, open, high, low, close, volume, value, trades of lines (header, line) of daily files.

    A file's layout follows from its header; a header of neither is an error. Values are trimmed; a price that is no number
    is missing, a count that is none is 0. ts is day's market close. Lines hold no quoted commas, as the exchange's don't."""
    names = F.transform(F.split("header", ","), lambda x: F.trim(x))
    cells = F.transform(F.split("line", ","), lambda x: F.trim(x))
    held = lines.withColumns({"_n": names, "_c": cells})
    new, old = F.array_contains("_n", "TckrSymb"), F.array_contains("_n", "SYMBOL") & F.array_contains("_n", "SERIES")
    unknown = F.raise_error(F.concat(F.lit("unknown daily file: "), F.col("header")))

    def cell(name: str) -> Column:
        at = F.when(new, F.array_position("_n", LAYOUTS["new"][name])).when(old, F.array_position("_n", LAYOUTS["legacy"][name])).otherwise(unknown.cast("long"))
        return F.get("_c", (at - 1).cast("int"))

    prices = {c: cell(c).try_cast("double") for c in ("open", "high", "low", "close")}
    counts = {c: F.coalesce(cell(c).try_cast("double").try_cast("bigint"), F.lit(0).cast("long")) for c in ("volume", "trades")}
    close = F.timestamp_add("MINUTE", F.lit(15 * 60 + 30), day.cast("timestamp_ntz"))
    out = held.select(
        cell("symbol").alias("symbol"), cell("isin").alias("isin"), cell("series").alias("series"), close.alias("ts"),
        *(v.alias(k) for k, v in prices.items()), counts["volume"].alias("volume"), cell("value").try_cast("double").alias("value"), counts["trades"].alias("trades"),
    )
    return out.where(F.col("series").isin(*series))


def daily_files(spark: SparkSession, path: str, day: Column, series: tuple[str, ...] = ("EQ",)) -> DataFrame:
    """daily_rows() of the zipped files below path; day is a column of the file's name (file)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return daily_rows(unzipped(files), day, series)


def canonical(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", "ts", "open", "high", "low", "close", "volume")


def sector_map(rows: DataFrame) -> DataFrame:
    """symbol, sector of a dimension (symbol, sector), trimmed; rows without either are dropped, of repeated symbols the
    smallest sector stays."""
    trimmed = rows.select(F.trim("symbol").alias("symbol"), F.trim("sector").alias("sector"))
    return trimmed.where("symbol <> '' and sector <> ''").groupBy("symbol").agg(F.min("sector").alias("sector"))


def review_events(changes: DataFrame) -> DataFrame:
    """review, announced, effective, adds, deletes (sorted symbols) of a change log (review, announced, effective, action,
    symbol); an action other than add or delete is an error."""
    action = F.lower(F.trim("action"))
    known = F.when(action.isin("add", "delete"), action).otherwise(F.raise_error(F.concat(F.lit("unknown action: "), F.coalesce("action", F.lit("null")))))
    one = changes.withColumn("_a", known)
    side = lambda x: F.array_sort(F.collect_set(F.when(F.col("_a") == x, F.trim("symbol"))))
    return one.groupBy("review", "announced", "effective").agg(side("add").alias("adds"), side("delete").alias("deletes"))


def redacted(mapping: Column, words: tuple[str, ...] = ("token", "secret", "password", "api_key", "access_key")) -> Column:
    """A map whose values are *** where the key holds one of the words, in any case."""
    hidden = lambda k: F.lower(k).rlike("|".join(words))
    return F.transform_values(mapping, lambda k, v: F.when(hidden(k), F.lit("***")).otherwise(v))


def random_walk_bars(spark: SparkSession, symbols: list[str], days: list[str], minutes: int, deviation: float, seed: int, start: float = 100.0) -> DataFrame:
    """Minute bars of a driftless geometric walk over the sessions of days from 9:15: symbol, ts, open, high, low, close,
    volume. A step is a normal deviate from a hash of the seed, the symbol and the bar, so that reruns agree."""
    names = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    sessions = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "day int, date string")
    grid = names.join(F.broadcast(sessions)).select("symbol", "day", "date", F.explode(F.sequence(F.lit(0), F.lit(minutes - 1))).alias("minute"))
    place = F.col("day") * minutes + F.col("minute")
    u = [(F.pmod(F.xxhash64("symbol", place, F.lit(seed + k)), F.lit(1_000_003)) + 0.5) / 1_000_003 for k in (0, 1, 2)]
    z = F.sqrt(-2 * F.ln(u[0])) * F.cos(6.283185307179586 * u[1])
    w = Window.partitionBy("symbol").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    walk = grid.withColumns({"place": place, "z": z, "u": u[2]})
    # the walk's mean stays start: each step loses half its variance
    walk = walk.withColumn("close", start * F.exp(F.sum(deviation * F.col("z") - deviation * deviation / 2).over(w)))
    walk = walk.withColumn("open", F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("place")), F.lit(start)))
    wide = 1 + deviation * F.col("u") / 2
    ts = F.timestamp_add("MINUTE", 9 * 60 + 15 + F.col("minute"), F.col("date").cast("timestamp_ntz"))
    return walk.select(
        "symbol", ts.alias("ts"), "open", (F.greatest("open", "close") * wide).alias("high"), (F.least("open", "close") / wide).alias("low"), "close", (100 + F.floor(F.col("u") * 900)).cast("long").alias("volume"),
    )


def chart_closes(raw: DataFrame, value: str = "value") -> DataFrame:
    """symbol, ts, close of charts as JSON: a symbol with arrays of times and closes; null closes are no rows."""
    chart = raw.select(F.from_json(value, "symbol string, timestamp array<bigint>, close array<double>").alias("c"))
    points = chart.select("c.symbol", F.explode(F.arrays_zip(F.col("c.timestamp").alias("ts"), F.col("c.close").alias("close"))).alias("p"))
    return points.select("symbol", F.col("p.ts").alias("ts"), F.col("p.close").alias("close")).where("close is not null")
