"""An append-only table of runs: every append is a numbered commit, which one writer alone can make."""

from __future__ import annotations

import json
import os
import time
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem

SCHEMA = "name string, at double, params map<string,string>, metrics map<string,double>, tags map<string,string>"


class RunLog:
    """Runs below a folder that all writers share: 00000001.json, 00000002.json, ...

    A writer reads the largest number, prepares its record in a file of its own, and gives it the next number's name in one
    step that fails where the name is taken; then it tries the next. So two writers never share a number, none is
    left out, and a writer that dies leaves no half record."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        fs, at = filesystem(spark, self.path)
        fs.mkdirs(at)
        # a local or mounted file system has a link that fails where the name exists, others a rename that does
        self.local = unquote(urlparse(str(fs.makeQualified(at).toString())).path) if fs.getScheme() == "file" else None

    def last(self) -> int:
        fs, at = filesystem(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def append(self, name: str, params: dict | None = None, metrics: dict | None = None, tags: dict | None = None, at: float | None = None) -> int:
        """Adds a run and returns its number."""
        record = {"name": name, "at": time.time() if at is None else at, "params": {k: str(v) for k, v in (params or {}).items()}, "metrics": {k: float(v) for k, v in (metrics or {}).items()}, "tags": {k: str(v) for k, v in (tags or {}).items()}}
        own = f"_{uuid.uuid4().hex}"
        self._write(own, json.dumps(record))
        number = self.last() + 1
        while not self._named(own, f"{number:08d}.json"):
            number = max(number, self.last()) + 1
        return number

    def _write(self, own: str, text: str) -> None:
        if self.local:
            with open(f"{self.local}/{own}", "w") as f:
                f.write(text)
            return
        fs, at = filesystem(self.spark, f"{self.path}/{own}")
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _named(self, own: str, name: str) -> bool:
        if self.local:
            try:
                os.link(f"{self.local}/{own}", f"{self.local}/{name}")
            except FileExistsError:
                return False
            os.unlink(f"{self.local}/{own}")
            return True
        jvm = self.spark._jvm
        fs, at = filesystem(self.spark, f"{self.path}/{own}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(at), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def runs(self) -> DataFrame:
        """run, name, at, params, metrics, tags of every run."""
        if not self.last():
            return self.spark.createDataFrame([], f"run long, {SCHEMA}")
        number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json", 1).cast("long").alias("run")
        return self.spark.read.schema(SCHEMA).option("pathGlobFilter", "[0-9]*.json").json(self.path).select(number, "*")

    def trials(self, metric: str) -> DataFrame:
        """One row: trials (all runs, whatever they measured), variance of the metric over those that have it (0 below two)."""
        return self.runs().agg(F.count("*").alias("trials"), F.coalesce(F.var_samp(F.col("metrics")[metric]), F.lit(0.0)).alias("variance"))
