"""Chat formatting with a grammar round trip, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The grammar. chat := turn*; turn := OPEN role BAR level CLOSE text END
# Level 0 text stands as it is, level 1 text is escaped. A role is always escaped.
OPEN, BAR, CLOSE, END = "<|turn:", "|", "|>", "<|end|>"
MARK, ESC = "<|", "\\"


def escape(text: Column) -> Column:
    """No MARK is left: a backslash is doubled, the bar of a mark gets one before it."""
    return F.replace(F.replace(text, F.lit(ESC), F.lit(ESC * 2)), F.lit(MARK), F.lit("<" + ESC + "|"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit(ESC), F.lit(ESC * 2)), F.lit("|"), F.lit(ESC + "b")), F.lit("<"), F.lit(ESC + "l"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def unescape_role(role: Column) -> Column:
    """Doubled backslashes stand aside as pairs while the letters are read."""
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit(ESC + "b"), F.lit("|")), F.lit(ESC + "l"), F.lit("<"))), ESC)


def render(turns: Column, level: Column | int) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    one = lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(BAR), level.cast("string"), F.lit(CLOSE), F.when(level == 0, t["text"]).otherwise(escape(t["text"])), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def parse(chat: Column) -> Column:
    """The turns (role, text) of a chat, read from left to right. What doesn't follow the grammar comes out as it is
    found, so that the comparison with the source fails."""
    pattern = r"(?s)^<\|turn:([^|]*)\|([01])\|>(.*)$"
    bodies = F.split(chat, r"<\|end\|>", -1)
    bodies = F.slice(bodies, 1, F.size(bodies) - 1)

    def turn(b: Column) -> Column:
        text = F.regexp_extract(b, pattern, 3)
        sound = b.rlike(pattern) & ~F.contains(text, F.lit(OPEN))  # a turn that begins inside another is no turn
        role = F.when(sound, unescape_role(F.regexp_extract(b, pattern, 1)))
        return F.struct(role.alias("role"), F.when(F.regexp_extract(b, pattern, 2) == "1", unescape(text)).otherwise(text).alias("text"))

    return F.transform(bodies, turn)


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, level, turns for each conversation of ``rows`` (conv_id, turn, role, text).

    Turns stand in the order of turn, then of the input's role and text (repeated rows are turns of their own; null turns
    come first). A null text or role is empty. All rows without conv_id are one conversation. A conversation is rendered
    plainly (level 0) and read back by the parser; where the turns that come back differ from the source, its texts are
    escaped (level 1) and the result must come back identical, or the query fails. turns is what the parser reads.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("said"))
    chats = chats.select("conv_id", F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("said"))
    plain = F.coalesce(parse(render(F.col("said"), 0)) == F.col("said"), F.lit(False))
    chats = chats.withColumn("level", F.when(plain, 0).otherwise(1))
    chats = chats.withColumn("formatted", render(F.col("said"), F.col("level"))).withColumn("turns", parse(F.col("formatted")))
    same = F.when(F.col("turns") == F.col("said"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation doesn't come back from its format")).cast(chats.schema["turns"].dataType))
    return chats.select("conv_id", "formatted", "level", same.alias("turns"))


def digests(chats: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    hexed = lambda c: F.sha2(c.cast("binary"), 256)
    chats = chats.select("*", said.alias("said"), loss.alias("loss"))
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), hexed(F.col("said")).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), hexed(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "level")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(format_chats(told.unionByName(extra)))


ORACLE = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c as (select conv_id, count(*) n_turns,
        string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) said,
        coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') loss,
        sum(length(replace(replace(replace(role, '\', '\\'), '|', '\b'), '<', '\l')) + length('<|turn:|0|><|end|>')) head,
        sum(length(text)) plain,
        sum(length(replace(replace(text, '\', '\\'), '<|', '<\|'))) escaped,
        bool_or(contains(text, '<|end|>') or contains(text, '<|turn:')) clash
      from t group by conv_id)
select conv_id, n_turns, sha256(said) turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256,
  (head + case when clash then escaped else plain end)::bigint formatted_chars, clash::integer as level from c
"""
