"""Preference formatting: the longest common turn prefix of two conversations is the prompt, the rest masked completions.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A turn is rendered as header, text, end; only the text and end of TRAINED turns are trained on.
TRAINED = "assistant"
END = "<|end|>\n"


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text, in order of turn, role, text; null role or text: empty) for each conv_id."""
    slim = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = slim.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected: chosen is the conversation up to its last assistant turn, rejected the same with that
    turn's text replaced by the last assistant turn of its neighbour (ids 2k and 2k + 1). Without an assistant turn
    chosen is the whole conversation; rejected is null then, and where the neighbour has no assistant turn."""
    whole = turns_of(conversations)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i + 1)))
    own = whole.withColumn("last", last)
    replies = own.where("last is not null").select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("_of"), F.get("turns", F.col("last") - 1)["text"].alias("reply"))
    joined = own.join(replies, own.conv_id == replies["_of"], "left")
    kept = F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.slice("turns", F.lit(1), F.col("last")))
    other = F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.array(F.struct(F.lit(TRAINED).alias("role"), F.col("reply").alias("text"))))
    return joined.select("conv_id", kept.alias("chosen"), F.when(F.col("last").isNotNull() & F.col("reply").isNotNull(), other).alias("rejected"))


def common_turns(a: str | Column, b: str | Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t["role"]), t["text"], F.lit(END))), "")


def trained_spans(turns: Column) -> Column:
    """start-end of what is trained on, in characters of rendered(turns), comma-joined."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_header(t["role"]))
        end = begin + F.length(t["text"]) + len(END)
        span = F.concat_ws("-", begin.cast("string"), end.cast("string"))
        spans = F.when(t["role"] == TRAINED, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.cast("long").alias("at"), spans.cast("array<string>").alias("spans"))

    return F.array_join(F.aggregate(turns, start, add, lambda acc: acc["spans"]), ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Every row of pairs (conv_id, chosen, rejected: arrays of role and text), formatted.

    n_prompt_turns, prompt, chosen, rejected (what follows the common turns), chosen_mask, rejected_mask (spans to
    train on), paired (false if one side is null: the other is all prompt), tied (both sides are equal: both
    completions are empty). One side may be a prefix of the other; its completion is empty then. Repeated pairs give
    a row each.
    """
    both = F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    a = F.coalesce("chosen", "rejected", F.array().cast("array<struct<role:string,text:string>>"))
    b = F.coalesce("rejected", "chosen", F.array().cast("array<struct<role:string,text:string>>"))
    cut = pairs.select("conv_id", both.alias("paired"), a.alias("a"), b.alias("b")).withColumn("n", common_turns("a", "b"))
    rest = [F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0))) for x in ("a", "b")]
    parts = cut.select("conv_id", "paired", "n", F.slice("a", F.lit(1), F.col("n")).alias("head"), rest[0].alias("ca"), rest[1].alias("cb"))
    return parts.select(
        "conv_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        "paired",
        (F.col("paired") & (F.size("ca") == 0) & (F.size("cb") == 0)).alias("tied"),
        rendered(F.col("head")).alias("prompt"),
        rendered(F.col("ca")).alias("chosen"),
        rendered(F.col("cb")).alias("rejected"),
        trained_spans(F.col("ca")).alias("chosen_mask"),
        trained_spans(F.col("cb")).alias("rejected_mask"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(reply_pairs(table(spark, sf_dir, "conversations")))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations),
k AS (SELECT conv_id, count(*) AS turns, max(n) FILTER (role = 'assistant') AS last,
             arg_max(text, n) FILTER (role = 'assistant') AS reply FROM t GROUP BY conv_id),
p AS (SELECT a.conv_id, coalesce(a.last, a.turns) AS kept, a.last IS NOT NULL AND b.last IS NOT NULL AS paired,
             a.reply AS mine, b.reply AS other FROM k a LEFT JOIN k b ON b.conv_id = xor(a.conv_id, 1)),
q AS (SELECT *, paired AND mine = other AS tied, CASE WHEN paired AND mine <> other THEN kept - 1 ELSE kept END AS np FROM p),
r AS (SELECT q.conv_id, coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY n) FILTER (n <= np), '') AS prompt
      FROM q JOIN t USING (conv_id) GROUP BY q.conv_id)
SELECT q.conv_id, np AS n_prompt_turns, paired, tied, prompt,
       CASE WHEN np < kept THEN '<|assistant|>' || chr(10) || mine || '<|end|>' || chr(10) ELSE '' END AS chosen,
       CASE WHEN np < kept THEN '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) ELSE '' END AS rejected,
       CASE WHEN np < kept THEN '14-' || (14 + length(mine) + 8) ELSE '' END AS chosen_mask,
       CASE WHEN np < kept THEN '14-' || (14 + length(other) + 8) ELSE '' END AS rejected_mask
FROM q JOIN r USING (conv_id)
"""
