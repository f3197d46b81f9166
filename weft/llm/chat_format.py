"""Chat formatting in Spark expressions: sorted turn structs, merged runs of one role, a loss mask and its way back.

The template::

    <|start|>ROLE\\nTEXT<|also|>TEXT ...<|end|>\\n<|start|>ROLE\\nTEXT<|end|>\\n

Adjacent turns of one role are merged into one block, parted by ``<|also|>``. In roles and texts ``&`` is written
``&amp;`` and ``<`` is written ``&lt;``, in roles a newline ``&nl;`` as well, so nothing that a user types can be
taken for a mark, and undoing these in the opposite order gives the text back. The loss mask is a list of runs
(skip, take) of UTF-8 bytes of the formatted string, one for each turn; only assistant turns take any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._common import table

START, ALSO, END = "<|start|>", "<|also|>", "<|end|>\n"
LEARNED = "assistant"
#: Runs of a mask that are summed up in one piece.
BLOCK = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_mask array<struct<skip:int,take:int>>), one row for each conversation.

    Turns are sorted by (turn, role, text), null turns first; equal turns stay in the result as often as they occur.
    A null role or text counts as empty; rows whose conversation is null form one conversation. A conversation is one
    value of the result, so its turns meet in one row by definition. Other columns aren't read.
    """
    turns = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    same = lambda i: (i > 0) & (F.get(F.col("ts"), i - 1)["role"] == F.get(F.col("ts"), i)["role"])
    head = lambda t, i: F.when(same(i), F.lit(ALSO)).otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), _escape_role(t["role"]), F.lit("\n")))
    pieces = sorted_turns.withColumn("ps", F.transform("ts", lambda t, i: F.struct(head(t, i).alias("head"), escape(t["text"]).alias("body"), (t["role"] == LEARNED).alias("learn"))))
    formatted = F.concat(F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END))
    runs = F.transform("ps", lambda p: F.struct((F.octet_length(p["head"]) + F.when(p["learn"], 0).otherwise(F.octet_length(p["body"]))).alias("skip"), F.when(p["learn"], F.octet_length(p["body"])).otherwise(0).alias("take")))
    return pieces.select("conv_id", formatted.alias("formatted"), runs.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>), parsed from the formatted string alone."""
    blocks = F.split(F.substring(F.col("formatted"), F.lit(len(START) + 1), F.char_length("formatted") - len(START) - len(END)), r"<\|end\|>\n<\|start\|>", -1)
    parsed = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(F.substring(b, F.instr(b, "\n") + 1, F.char_length(b)), r"<\|also\|>", -1),
            lambda s: F.struct(_unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(s).alias("text")),
        ),
    )
    return formatted.withColumn("turns", F.flatten(parsed))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The text under the mask, run by run, unescaped. Bytes are addressed, so a run costs what it takes, wherever it is.

    Places are sums of the runs before, taken within blocks of BLOCK runs and then over blocks, as a list that grows by
    one is copied each time: a conversation of a million turns stays cheap.
    """
    place = lambda at, n: F.struct(at.cast("int").alias("at"), n.cast("int").alias("n"))
    none = F.array().cast("array<struct<at:int,n:int>>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(mask) - 1) / BLOCK).cast("int")), lambda b: F.slice(mask, b * BLOCK + 1, F.lit(BLOCK)))
    length = lambda b: F.aggregate(b, F.lit(0), lambda acc, r: (acc + r["skip"] + r["take"]).cast("int"))

    def spread(items: Column, start: Column, size, entry) -> Column:
        """entry(place, item) for each item, places being sums of sizes."""
        zero = F.struct(start.cast("int").alias("at"), none.alias("runs"))
        grown = lambda acc, x: F.struct((acc["at"] + size(x)).cast("int").alias("at"), entry(acc, x).alias("runs"))
        return F.aggregate(items, zero, grown)["runs"]

    starts = spread(blocks, F.lit(1), length, lambda acc, b: F.array_append(acc["runs"], place(acc["at"], F.lit(0))))
    taken = lambda acc, r: F.when(r["take"] > 0, F.array_append(acc["runs"], place(acc["at"] + r["skip"], r["take"]))).otherwise(acc["runs"])
    places = F.flatten(F.zip_with(blocks, starts, lambda b, s: spread(b, s["at"], lambda r: r["skip"] + r["take"], taken)))
    return F.array_join(F.transform(places, lambda r: unescape(F.substring(formatted.cast("binary"), r["at"], r["n"]).cast("string"))), "")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation and one for -1; null roles and texts are empty, null ids one conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT CAST(-1 AS BIGINT) AS conv_id, * FROM VALUES (CAST(0 AS BIGINT), 'user', '{control}'), (CAST(1 AS BIGINT), 'assistant', '{control}') AS t(turn, role, text)")
    out = read_back(format_chats(rows.unionByName(extra))).withColumn("loss", under_mask(F.col("formatted"), F.col("loss_mask")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
     o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS prev FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
     e AS (SELECT *, length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS n,
                  length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;')) AS m FROM o)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN role = prev THEN 8 ELSE m + 10 + 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
