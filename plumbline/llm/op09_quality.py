"""Quality rules: per-text measures, and limits that follow from mergeable quantile sketches of each language and source."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, materialize, table
from .textbytes import NON_SPACE, Hashes, class_table, counts, mix, pieces

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_MEASURED = T.StructType([T.StructField(c, T.LongType()) for c in MEASURES])
_SYMBOL = ~class_table(b"#*$%&|<>")
_LINE = class_table(b"\n")

#: Relative error of a sketch's quantiles: neighbouring bins differ by this factor.
GAMMA = 1.02
#: Documents that a language's sketch counts for when it is merged into its groups' sketches, and that of all documents
#: when it is merged into the languages', so that a group's limits go over into its language's the fewer texts it has.
PRIOR = 100.0
REACH = 3.0
#: rule: (its ratio, the least spread that counts, whether small values fail too)
RULES = {
    "symbols": ("try_divide(n_symbols, n_words)", 0.02, False),
    "dup_lines": ("try_divide(n_dup_lines, n_lines)", 0.15, False),
    "repeats": ("try_divide(n_repeat_words, n_words)", 0.15, False),
    "word_length": ("try_divide(word_chars, n_words)", 1.0, True),
}
#: Groups up to which the table of limits is broadcast (some 100 bytes each); beyond that it is a shuffle join.
BROADCAST_GROUPS = 10_000
#: Rows of languages and rules up to which their sketches are broadcast (some 20 kB each).
BROADCAST_LANGUAGES = 1000


def _piece_measures(p) -> list[np.ndarray]:
    s, e, row = p.spans(NON_SPACE)
    inside = NON_SPACE[p.buf]

    def per_row(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return c[p.offs[1:]] - c[p.offs[:-1]]

    chars = per_row(inside & ((p.buf & 0xC0) != 0x80))
    hashes = Hashes(p.buf)

    ls, le, lrow = p.spans(_LINE)
    c = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    worded = c[le] > c[ls]
    ls, le, lrow = ls[worded], le[worded], lrow[worded]
    lines = np.unique(np.stack([lrow.astype(np.uint64), hashes.of(ls, le)], axis=1), axis=0) if len(ls) > 1 else lrow[:, None]
    n_lines = counts(lrow, p.rows)
    dup = n_lines - counts(lines[:, 0].astype(np.int64), p.rows)

    repeated = np.zeros(len(s) + 2, bool)
    if len(s) >= 3:
        w = hashes.of(s, e)
        g = mix(w[:-2] + mix(w[1:-1] + mix(w[2:] + row[2:].astype(np.uint64))))
        g[row[:-2] != row[2:]] = 0
        srt = np.sort(g)
        twice = np.unique(srt[1:][srt[1:] == srt[:-1]])
        twice = twice[twice != 0]
        if len(twice):
            at = np.searchsorted(twice, g)
            found = twice[np.minimum(at, len(twice) - 1)] == g
            for k in range(3):
                repeated[k : k + len(g)] |= found
    repeat = counts(row, p.rows, repeated[: len(s)])
    return [counts(row, p.rows), chars, per_row(_SYMBOL[p.buf]), dup, repeat, n_lines]


@F.arrow_udf(_MEASURED)
def _measure(texts: pa.Array) -> pa.Array:
    found = [_piece_measures(p) for p in pieces(texts)]
    columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in (zip(*found, strict=True) if found else [()] * len(MEASURES))]
    return pa.StructArray.from_arrays(columns, MEASURES)


def measures(text: str | Column) -> Column:
    """Struct of MEASURES for a text column; a null text counts as empty (all zero)."""
    return _measure(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def sketches(measured: DataFrame) -> DataFrame:
    """Log-spaced histograms of every rule's ratio: lang, source, rule, bin, n. Adding the n of equal bins merges two."""
    ratios = F.array(*(F.struct(F.lit(r).alias("rule"), F.expr(x).alias("x")) for r, (x, _, _) in RULES.items()))
    long = measured.select("lang", "source", F.explode(ratios).alias("r")).select("lang", "source", "r.rule", F.coalesce("r.x", F.lit(0.0)).alias("x"))
    bin_of = F.when(F.col("x") < 1e-6, -10_000).otherwise(F.ceil(F.ln("x") / math.log(GAMMA)).cast("int"))
    return long.groupBy("lang", "source", "rule", bin_of.alias("bin")).agg(F.count("*").alias("n"))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is computed once and not for every element that f visits."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _total(sketch: Column) -> Column:
    return F.aggregate(sketch, F.lit(0.0), lambda a, v: a + v["n"])


def _bins(n: Column) -> Column:
    return F.collect_list(F.struct("bin", n.cast("double").alias("n")))


def merged(sketch: DataFrame) -> DataFrame:
    """lang, source, rule, sketch (ascending bins with their n) of every group: its own bins and, at the weight of PRIOR
    documents, those of its language, into which those of all documents are merged the same way.

    A sketch is an array of some 1,300 bins at most, so a language's is one row a rule, and a group's merges with it within
    a row: rows grow with the groups, whatever bins their languages have."""
    held = sketch.groupBy("lang", "source", "rule", "bin").agg(F.sum("n").alias("n"))

    def weighed(x: Column) -> Column:
        """x at the weight of PRIOR documents."""
        each = lambda all_: F.transform(x, lambda v: F.struct(v["bin"].alias("bin"), (PRIOR * v["n"] / all_).alias("n")))
        return _once(_total(x), each)

    total = held.groupBy("rule", "bin").agg(F.sum("n").alias("n")).groupBy("rule").agg(F.array_sort(_bins(F.col("n"))).alias("whole"))
    total = materialize(total.select("rule", weighed(F.col("whole")).alias("whole")), "whole")
    langs = held.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n")).groupBy("lang", "rule").agg(_bins(F.col("n")).alias("own"))
    langs = langs.join(F.broadcast(total), "rule").select("lang", "rule", F.array_sort(F.concat("own", "whole")).alias("both"))  # a row a rule
    langs = materialize(langs.select(F.col("lang").alias("_lang"), F.col("rule").alias("_rule"), weighed(F.col("both")).alias("prior")), "languages")
    few = langs.count() <= BROADCAST_LANGUAGES
    groups = held.groupBy("lang", "source", "rule").agg(_bins(F.col("n")).alias("own"))
    met = groups.join(F.broadcast(langs) if few else langs, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rule") == F.col("_rule")))
    return met.select("lang", "source", "rule", F.array_sort(F.concat("own", "prior")).alias("sketch"))


def quartiles(sketch: Column) -> Column:
    """Struct of q1, q2, q3 of a sketch: the values of the first bins that reach a quarter, half and three quarters."""

    def step(a: Column, v: Column) -> Column:
        upto = a["upto"] + v["n"]
        reached = (F.coalesce(a[f"b{i}"], F.when(upto >= a["all"] * i / 4, v["bin"])).alias(f"b{i}") for i in (1, 2, 3))
        return F.struct(a["all"].alias("all"), upto.alias("upto"), *reached)

    start = F.struct(_total(sketch).alias("all"), F.lit(0.0).alias("upto"), *(F.lit(None).cast("int").alias(f"b{i}") for i in (1, 2, 3)))
    value = lambda b: F.when(b == -10_000, 0.0).otherwise(F.pow(F.lit(GAMMA), b - 0.5))
    return _once(F.aggregate(sketch, start, step), lambda found: F.struct(*(value(found[f"b{i}"]).alias(f"q{i}") for i in (1, 2, 3))))


def limits(sketch: DataFrame) -> DataFrame:
    """lang, source, limits (rule to low, high) for every group of sketch (lang, source, rule, bin, n): the quartiles of
    its merged() sketch, widened by REACH times their distance from the median. A null language or source is a group
    of its own, one document makes a group, no sketch gives no limits."""
    found = merged(sketch).select("lang", "source", "rule", quartiles(F.col("sketch")).alias("q")).select("lang", "source", "rule", "q.*")
    least = F.create_map(*(x for r, (_, spread, _) in RULES.items() for x in (F.lit(r), F.lit(spread))))[F.col("rule")]
    both = F.create_map(*(x for r, (_, _, b) in RULES.items() for x in (F.lit(r), F.lit(b))))[F.col("rule")]
    found = found.select(
        "lang", "source", "rule",
        (F.col("q3") + REACH * F.greatest(F.col("q3") - F.col("q2"), least)).alias("high"),
        F.when(both, F.col("q2") - REACH * F.greatest(F.col("q2") - F.col("q1"), least)).otherwise(F.lit(-1.0)).alias("low"),
    )
    return found.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct("low", "high")))).alias("limits"))


def judge(measured: DataFrame, found: DataFrame, m: Column, verdict: str = "failed") -> DataFrame:
    """Adds a column verdict: the rules that a row breaks, base first. measured: has lang and source, and its measures
    in m; a null measure breaks no limit. found: a written table of limits(), joined by a broadcast where it is counted
    to be small. Repeated rows get the same verdict, no rows give none; measured's other columns may have any names."""
    few = found.count() <= BROADCAST_GROUPS
    lang, source, limit_of = (free(measured, x) for x in ("own_lang", "own_source", "limits"))
    right = found.select(F.col("lang").alias(lang), F.col("source").alias(source), F.col("limits").alias(limit_of))
    joined = measured.join(
        F.broadcast(right) if few else right,
        measured["lang"].eqNullSafe(F.col(lang)) & measured["source"].eqNullSafe(F.col(source)),
        "left",
    )
    broken = [F.when(base_failed(m), F.lit("base"))]
    of = {c: m[c] for c in MEASURES}
    ratio = {
        "symbols": F.try_divide(of["n_symbols"], of["n_words"]),
        "dup_lines": F.try_divide(of["n_dup_lines"], of["n_lines"]),
        "repeats": F.try_divide(of["n_repeat_words"], of["n_words"]),
        "word_length": F.try_divide(of["word_chars"], of["n_words"]),
    }
    for rule in RULES:
        limit, x = F.col(limit_of)[rule], F.coalesce(ratio[rule], F.lit(0.0))
        broken.append(F.when((x > limit["high"]) | (x < limit["low"]), F.lit(rule)))
    return joined.withColumn(verdict, F.array_compact(F.array(*broken))).drop(lang, source, limit_of)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, MEASURES, base_failed, kept, failed for every row of docs (doc_id, text, lang, source).

    Null or blank texts have zero measures and fail the base rule; a null language or source is a group of its own;
    repeated rows are judged alike; an empty table gives an empty one. Other columns of docs are ignored.
    """
    m = materialize(docs.select("doc_id", "lang", "source", measures("text").alias("m")).select("doc_id", "lang", "source", "m.*"), "measures")
    found = materialize(limits(sketches(m)), "limits")
    whole = F.struct(*(F.col(c) for c in MEASURES))
    judged = judge(m, found, whole)
    return judged.select("doc_id", "lang", "source", *MEASURES, base_failed(whole).alias("base_failed"), (F.size("failed") == 0).alias("kept"), "failed")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass every rule, with their columns, whatever the others' names; texts are read twice and
    never shuffled. Null, empty and short texts go by the base rule, repeated rows stay or go together, an empty table
    gives an empty one."""
    m = docs.select("lang", "source", measures("text").alias("m")).select("lang", "source", "m.*")
    found = materialize(limits(sketches(m)), "limits")
    measured, failed = free(docs, "measures"), free(docs, "failed")
    judged = judge(docs.withColumn(measured, measures("text")), found, F.col(measured), failed)
    return judged.where(F.size(failed) == 0).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed", ",").alias("failed_rules"),
    )
