"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, mixing.

Each stage takes the documents that the one before kept, as a written table, and returns documents with the columns of
`documents`; the last returns what the mix takes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import op04_simhash, op07_mix, op08_decontaminate, op09_quality, op10_lines
from plumbline.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the base rules or their group's limits go; null, empty and short texts break the base rules.
    Equal texts of a group stay or go together, a null language or source is a group, no documents give none."""
    return op09_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, exactly or nearly, go, and documents that lose every worded line. Earlier is by
    doc_id, null last; rows that repeat an id and a text are one document; null and blank texts stay as they are."""
    return op10_lines.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies stays; all rows that repeat that id do. Null and empty texts
    are copies of each other. Documents without an id stay only where their group has no id."""
    return op04_simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go; null and empty texts, and all texts if there is no benchmark, stay."""
    return op08_decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of the documents that the mix takes words of. A null source is a
    source; null and empty texts have size 0, so nothing is taken of them; repeated rows are taken or not each for itself."""
    return op07_mix.mix(materialize(op07_mix.sizes(docs), "sizes")).where("taken > 0")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]
#: SQL has no MinHash, SimHash or cube method; tests compare each stage with brute force (tests/llm/test_cases.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
