"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and the loss mask covers that reply alone.  Turns after the last
assistant turn (or a conversation without one) give one more example with an
empty mask, so the output holds every turn.

A turn is written ``<|im_start|>role<|im_sep|>text<|im_end|>``.  Inside roles
and texts a backslash is doubled and every control string gets a backslash
after its first character; dropping each backslash and keeping the character
after it undoes both.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

# Control strings of common chat templates, escaped wherever a text holds them.
CONTROL = [START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand_prefix_targets(df: DataFrame, conv: str = "conv_id", turn: str = "turn",
                          role: str = "role", text: str = "text") -> DataFrame:
    """Examples of every conversation: ``conv``, example, is_last, formatted, loss_start, loss_len.

    The mask is the code points [loss_start, loss_start + loss_len) of
    ``formatted``.  Turns are ordered by turn, role and text (null first); null
    roles and texts count as empty, null conversation ids form one
    conversation, repeated rows are turns of their own.  An empty table gives no
    examples.  Other columns are not read.

    An example is one string with the whole context, so a row holds a
    conversation; examples are made one row at a time, never all at once.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.concat(F.lit(START), escape(blank(role)), F.lit(SEP))
    body = escape(blank(text))
    turns = df.select(
        F.col(conv), F.struct(
            F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"),
            head.alias("head"), body.alias("body")).alias("t"))
    whole = (turns.groupBy(conv).agg(F.array_sort(F.collect_list("t")).alias("turns"))
             .select(conv, "turns", F.size("turns").alias("n")))
    targets = F.filter(F.sequence(F.lit(1), F.col("n")),
                       lambda i: F.element_at(F.col("turns"), i)["role"] == "assistant")
    # the last example holds all turns; 0 - n marks one without a target
    wanted = whole.select(conv, "turns", "n", F.explode(
        F.when(F.element_at(F.col("turns"), -1)["role"] == "assistant", targets)
        .otherwise(F.concat(targets, F.array(-F.col("n"))))).alias("at"))
    upto = F.abs("at")
    context = F.array_join(
        F.transform(F.slice("turns", 1, upto - 1),
                    lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    target = F.element_at(F.col("turns"), upto)
    out = wanted.select(
        conv, F.col("n"), F.col("at"), context.alias("context"), target["head"].alias("head"),
        target["body"].alias("body"))
    return out.select(
        conv, upto.alias("example"), (upto == F.col("n")).alias("is_last"),
        F.concat("context", "head", "body", F.lit(END)).alias("formatted"),
        (F.length("context") + F.length("head")).alias("loss_start"),
        F.when(F.col("at") > 0, F.length("body")).otherwise(0).alias("loss_len"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped."""
    parts = F.split(formatted, re.escape(END))
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEP, 1)).alias("role"),
            unescape(F.substring_index(p, SEP, -1)).alias("text")))


def digest(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the examples: turns, masked text and lengths."""
    lines = F.transform(read_turns(F.col("formatted")),
                        lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = examples.select(
        conv, "example", F.length("formatted").cast("long").alias("chars"),
        unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_len"))).alias("loss"),
        F.when(F.col("is_last"), lines).alias("lines"))
    read = read.select(conv, "example", "chars", "loss", F.size("lines").alias("n"),
                       F.sha2(F.array_join("lines", ""), 256).alias("sha"), "lines")
    per = read.groupBy(conv).agg(
        F.max(F.when(F.col("lines").isNotNull(), F.col("n"))).cast("long").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))),
                                 lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"))
    return per.select(conv, "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op9_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    return digest(expand_prefix_targets(given.unionByName(extra)))


def _sql_escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP9_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length({_sql_escaped('role')}) + length({_sql_escaped('text')})
            + {len(START + SEP + END)} AS chars FROM given),
placed AS (
  SELECT *, sum(chars) OVER w AS upto, row_number() OVER w AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
