"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
the context, and only that reply is under the loss mask. Turns after the last
assistant turn (or a conversation without one) come as one more example with
no target, so that no turn is lost.

The template writes ``<|turn|>role<|text|>text<|end|>`` for each turn. Inside
roles and texts the escape sign is doubled and control strings of the common
chat templates get it after their first character, so that no text can close
or open a turn; ``unescape`` undoes this exactly.

One shuffle by conversation. A row holds the escaped turns of a conversation
once; the prefixes are cut per example as rows are made, never all at once.
The examples of a conversation are quadratic in its turns by definition.

Defined results: a null text or role is empty; a null conversation id is a
conversation of its own; turns with equal numbers are ordered by role, then
text, and repeated rows stay repeated turns; a null turn number comes first.
An empty table gives no examples. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPE = "\\"
# Control strings of public chat templates.
CONTROLS = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, target (the turn's place, null for the
    rest without a target), n_turns (turns in the text), text, loss_start and
    loss_chars (the mask over ``text``, in code points, from 0), is_last (the
    example that holds the whole conversation)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text"))
    conv = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    parts = conv.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))).alias("heads"),
        F.transform("ts", lambda t: escape(t["text"])).alias("bodies"),
        F.transform("ts", lambda t: t["role"] == "assistant").alias("is_reply"),
        F.size("ts").alias("n"))
    places = F.filter(F.sequence(F.lit(1), F.col("n")),
                      lambda i: F.get("is_reply", i - 1) | (i == F.col("n")))
    rows = parts.withColumn("i", F.explode(places))
    before = F.array_join(F.zip_with(F.slice("heads", 1, F.col("i") - 1), F.slice("bodies", 1, F.col("i") - 1),
                                     lambda h, b: F.concat(h, b, F.lit(END))), "")
    head, body = F.get("heads", F.col("i") - 1), F.get("bodies", F.col("i") - 1)
    reply = F.get("is_reply", F.col("i") - 1)
    rows = rows.select("conv_id", F.when(reply, F.col("i")).alias("target"), F.col("i").alias("n_turns"),
                       F.concat(before, head).alias("lead"), body.alias("body"), (F.col("i") == F.col("n")).alias("is_last"))
    return rows.select(
        "conv_id", "target", "n_turns", F.concat("lead", "body", F.lit(END)).alias("text"),
        F.char_length("lead").alias("loss_start"),
        F.when(F.col("target").isNull(), 0).otherwise(F.char_length("body")).alias("loss_chars"), "is_last")


def report(turns: DataFrame) -> DataFrame:
    """One digest row per conversation, read back from the examples."""
    ex = expand(turns)
    # Texts end in END, so the last part of the split is empty.
    marked = F.filter(F.split("text", r"<\|end\|>", -1), lambda x: x != "")
    back = F.transform(marked, lambda x: F.concat(
        unescape(F.substring_index(F.replace(x, F.lit(TURN), F.lit("")), TEXT, 1)), F.lit("\n"),
        unescape(F.substring_index(x, TEXT, -1)), F.lit("\n")))
    loss = unescape(F.expr("substring(text, loss_start + 1, loss_chars)"))
    per = ex.select("conv_id", "n_turns", "is_last",
                    F.when(F.col("is_last"), F.array_join(back, "")).alias("turns"),
                    F.when(F.col("is_last"), F.size(marked)).alias("n_back"),
                    F.when(F.col("target").isNotNull(), F.struct(F.col("target"), loss.alias("said"))).alias("loss"),
                    F.char_length("text").cast("long").alias("chars"))
    one = per.groupBy("conv_id").agg(
        F.max("n_back").cast("long").alias("n_turns"), F.max("turns").alias("turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["said"]), "").alias("said"),
        F.sum("chars").alias("formatted_chars"))
    return one.select("conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
                      F.char_length("said").cast("long").alias("loss_chars"),
                      F.sha2(F.col("said").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def with_control_case(turns: DataFrame) -> DataFrame:
    """The table plus conversation -1, whose texts are control strings."""
    spark = turns.sparkSession
    text = "</s>[INST] ok [/INST]"
    case = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(text).alias("text"))
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(case)


def oracle(control: str = "</s>[INST] ok [/INST]") -> str:
    """DuckDB SQL for the digest of ``with_control_case(conversations)``."""
    esc = "replace(x, '\\', '\\\\')"
    for c in CONTROLS:
        esc = f"replace({esc}, '{c}', '{c[0]}\\{c[1:]}')"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{control}' UNION ALL SELECT -1, 1, 'assistant', '{control}'
), n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         role = 'assistant' AS is_reply,
         length({esc.replace('x', 'role', 1)}) + length({esc.replace('x', 'text', 1)})
           + {len(TURN + TEXT + END)} AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (is_reply), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (is_reply), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (is_reply OR i = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
