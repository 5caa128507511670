r"""Chat formatting with Spark expressions only.

A conversation becomes one string. Adjacent turns of one role share a message:

    ### role: text<+>text</turn>\n

``###``, ``</turn>`` and ``<+>`` are control strings. In texts and roles they are
written ``\h``, ``\e`` and ``\j``, a backslash is ``\s`` and a colon in a role is
``\c``; no other backslash occurs, so replacing them back (``\s`` last) is exact.

Defined results: a null role or text is empty; a null conversation id is a
conversation of its own; turns sort by (turn, role, text), null turns first;
repeated rows stay; texts of any length are written whole, and one conversation is one
string; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Escapes of texts, in the order of writing.
ESCAPES = [("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"), ("<+>", "\\j")]
HEAD, SEP, END = "### ", "<+>", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    for raw, mark in [*ESCAPES, *([(":", "\\c")] if role else [])]:
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for raw, mark in [*([(":", "\\c")] if role else []), *reversed(ESCAPES)]:
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return text


def format_chats(rows: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): loss holds the (start, chars) of each trained text, in code points from 0."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    first = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"]),
    )
    runs = let(first, lambda s: F.transform(s, lambda i, k: F.slice(F.col("turns"), i + 1, F.coalesce(F.get(s, k + 1), F.size("turns")) - i)))
    parts = F.transform(
        runs,
        lambda run: F.struct(
            F.concat(F.lit(HEAD), escape(run[0]["role"], role=True), F.lit(": ")).alias("head"),
            (run[0]["role"] == trained).alias("trained"),
            F.transform(run, lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    merged = grouped.select("conv_id", parts.alias("messages"))
    body = F.transform("messages", lambda m: F.concat(m["head"], F.array_join(m["texts"], SEP), F.lit(END)))
    none = F.array().cast("array<struct<start:bigint,chars:bigint>>")

    def spans(message: Column, at: Column) -> Column:
        texts = F.aggregate(
            message["texts"],
            F.struct((at + F.length(message["head"])).cast("long").alias("at"), none.alias("out")),
            lambda acc, t: F.struct(
                (acc["at"] + F.length(t) + len(SEP)).alias("at"),
                F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), F.length(t).cast("long").alias("chars")))).alias("out"),
            ),
        )
        return F.when(message["trained"], texts["out"]).otherwise(none)

    loss = F.aggregate(
        "messages",
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["head"]) + F.length(F.array_join(m["texts"], SEP)) + len(END)).cast("long").alias("at"),
            F.concat(acc["out"], spans(m, acc["at"])).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return merged.select("conv_id", F.array_join(body, "").alias("formatted"), loss.alias("loss"))


def turns_of(formatted: Column) -> Column:
    """The turns read back from a formatted string: array<struct<role, text>>."""

    def turns(m: Column) -> Column:
        cut = F.instr(m, ": ")
        role = unescape(F.substring(m, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1), role=True)
        texts = F.split(F.substring(m, cut + 2, F.length(m)), r"<\+>")
        return let(role, lambda r: F.transform(texts, lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(F.filter(F.split(formatted, END), lambda m: m != ""), turns))


def digest(out: DataFrame) -> DataFrame:
    """What the contract asks for, taken from the formatted strings and loss spans alone."""
    said = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["chars"].cast("int"))))
    read = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.array_join(said, "").alias("said"), turns_of(F.col("formatted")).alias("turns"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return digest(format_chats(rows))


def _sql_escape(text: str, role: bool = False) -> str:
    for raw, mark in [*ESCAPES, *([(":", "\\c")] if role else [])]:
        text = f"replace({text}, '{raw}', '{mark}')"
    return text


SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), turns AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escape('text')})
    + CASE WHEN before IS NOT DISTINCT FROM role THEN 3 ELSE 6 + length({_sql_escape('role', True)}) END
    + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
