"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a dialogue (each role but ``system``) the dialogue is
rendered with that speaker's turns as the assistant's, the others' as named
users', and a mask: spans of characters that count for the loss, which are the
speaker's own contents with their end mark.

Messages are in order of turn (null first), then role, then the MD5 of the text. A
dialogue of up to PART_TURNS messages is one row for each speaker. A longer one is
given in parts of as many messages, so a row is bounded and one very long
dialogue is spread over tasks: each later part opens with the dialogue's first
system message and the last CONTEXT messages of the part before, which never
count for the loss, so every message counts once. Participants are those of the
whole dialogue.

A message's place comes from one range shuffle of all messages: its number within
its partition, plus the numbers of its dialogue's messages in the partitions
before, which is one small row for each dialogue and partition. So no dialogue,
no turn and no null is one task's.

Marks in contents are escaped so that they cannot forge turns: a ``<``, any
backslashes and ``|im_`` get one backslash more; in roles a backslash becomes two
and a line end ``\\n`` (or ``\\r``). ``unescaped`` and ``unescaped_role`` are the ways
back.

Defined cases: null text is empty, null role is the participant ``unknown``; rows
with null conv_id are one dialogue; rows without turn come first; a dialogue of
system turns alone has no participant and gives no row; a repeated message is
rendered each time; very long texts are whole; other columns take no part; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common

PART_TURNS, CONTEXT = 1024, 8
START, END = "<|im_start|>", "<|im_end|>"
KEYS = ["lost", "conv"]


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|im_", r"<\\$1|im_")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|im_", "<$1|im_")


def escaped_role(role: Column) -> Column:
    for plain, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        role = F.replace(role, F.lit(plain), F.lit(shown))
    return F.replace(role, F.lit("<|im_"), F.lit("<\\|im_"))


def unescaped_role(role: Column) -> Column:
    role = F.replace(role, F.lit("<\\|im_"), F.lit("<|im_"))
    pieces = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(pieces, "\\")


def _head(role: Column, speaker: Column) -> Column:
    name = F.when(role == speaker, "assistant").when(role == "system", "system").otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(START), name, F.lit("\n"))


def placed(rows: DataFrame) -> DataFrame:
    """The messages with ``place`` (from 0) in their dialogue and ``total``, its number of messages."""
    order = [*KEYS, "turn", "role", "sum"]
    dealt = rows.withColumn("sum", F.md5(F.col("text").cast("binary"))).withColumn("tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("sum", "tie")
    turns = common.written(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33)), "turns", keep=True)
    firsts = turns.groupBy(*KEYS, "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*KEYS).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(*KEYS)))
    numbered = turns.join(firsts.drop("n"), [*KEYS, "task"])
    return numbered.select(*KEYS, "role", "text", (F.col("offset") + F.col("at") - F.col("first")).alias("place"), "total")


def in_parts(rows: DataFrame, part_turns: int, context: int) -> DataFrame:
    """(part, place, role, text, own) of the messages in each part; ``own`` is false for what opens a later part."""
    part = F.floor(F.col("place") / part_turns)
    each = rows.withColumn("part", part).withColumn("own", F.lit(True))
    again = (F.col("place") % part_turns >= part_turns - context) & ((part + 1) * part_turns < F.col("total"))
    repeated = rows.where(again).withColumn("part", part + 1).withColumn("own", F.lit(False))
    heads = rows.where("role = 'system'").groupBy(*KEYS, "total").agg(F.min("place").alias("place"), F.min_by("role", "place").alias("role"), F.min_by("text", "place").alias("text"))
    last = F.floor((F.col("total") - 1) / part_turns)
    heads = heads.where(last > part).withColumn("part", F.explode(F.sequence(part + 1, last)))
    heads = heads.where(F.col("place") < F.col("part") * part_turns - context).withColumn("own", F.lit(False))
    out = [*KEYS, "part", "place", "role", "text", "own"]
    return each.select(out).unionByName(repeated.select(out)).unionByName(heads.select(out))


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS, context: int = CONTEXT) -> DataFrame:
    """(conv_id, part, speaker, rendered, mask): mask lists spans (n_chars, loss) in order, which cover ``rendered``."""
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    role, text = escaped_role(F.coalesce(F.col(role_col), F.lit("unknown"))), escaped(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(conv.isNull().alias("lost"), F.coalesce(conv, F.lit(0)).alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    rows = placed(rows)
    speakers = rows.where("role <> 'system'").select(*KEYS, F.col("role").alias("speaker")).distinct()
    parts = in_parts(rows, part_turns, context).groupBy(*KEYS, "part").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "own"))).alias("m"))
    seen = parts.join(speakers, KEYS)
    speaker = F.col("speaker")
    rendered = F.array_join(F.transform("m", lambda x: F.concat(_head(x["role"], speaker), x["text"], F.lit(END + "\n"))), "")
    span = lambda n, loss: F.struct(n.cast("long").alias("n_chars"), loss.alias("loss"))
    no = F.lit(False)
    spans = F.flatten(F.transform("m", lambda x: F.array(span(F.length(_head(x["role"], speaker)), no), span(F.length(x["text"]) + len(END), (x["role"] == speaker) & x["own"]), span(F.lit(1), no))))
    return seen.select(F.when(~F.col("lost"), F.col("conv")).alias("conv_id"), "part", "speaker", rendered.alias("rendered"), spans.alias("mask"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = rotate(common.table(spark, sf_dir, "conversations"))
    lost = F.filter("mask", lambda s: s["loss"])
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["n_chars"])
    mask = F.array_join(F.transform("mask", lambda s: F.concat(s["n_chars"].cast("string"), F.when(s["loss"], "+").otherwise("-"))), "")
    return seen.select(
        "conv_id", "part", "speaker", F.expr("size(mask) div 3").cast("long").alias("n_messages"), F.size(lost).cast("long").alias("n_loss_messages"),
        total(F.col("mask")).alias("n_chars"), total(lost).alias("n_loss_chars"), F.sha2("rendered", 256).alias("rendered_sha256"), F.sha2(mask, 256).alias("mask_sha256"),
    )


SQL = rf"""
WITH rows AS (SELECT conv_id, turn, replace(replace(replace(replace(coalesce(role, 'unknown'), '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<|im_', '<\|im_') AS role, regexp_replace(coalesce(text, ''), '<(\\*)\|im_', '<\\\1|im_', 'g') AS text FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS total FROM rows),
first_system AS (SELECT conv_id, min(place) AS place, arg_min(text, place) AS text, any_value(total) AS total FROM numbered WHERE role = 'system' GROUP BY conv_id),
parted AS (SELECT conv_id, place // {PART_TURNS} AS part, place, role, text, TRUE AS own FROM numbered
  UNION ALL SELECT conv_id, place // {PART_TURNS} + 1, place, role, text, FALSE FROM numbered WHERE place % {PART_TURNS} >= {PART_TURNS - CONTEXT} AND (place // {PART_TURNS} + 1) * {PART_TURNS} < total
  UNION ALL SELECT conv_id, part, place, 'system', text, FALSE FROM (SELECT *, unnest(range(place // {PART_TURNS} + 1, (total - 1) // {PART_TURNS} + 1)) AS part FROM first_system) WHERE place < part * {PART_TURNS} - {CONTEXT}),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM rows WHERE role <> 'system'),
seen AS (SELECT r.*, speaker, '{START}' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head, role = speaker AND own AS loss FROM parted r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id)
SELECT conv_id, part::BIGINT AS part, speaker, count(*) AS n_messages, count(*) FILTER (WHERE loss) AS n_loss_messages,
  sum(length(head) + length(text) + {len(END) + 1})::BIGINT AS n_chars, coalesce(sum(length(text) + {len(END)}) FILTER (WHERE loss), 0)::BIGINT AS n_loss_chars,
  sha256(string_agg(head || text || '{END}' || chr(10), '' ORDER BY place)) AS rendered_sha256,
  sha256(string_agg(length(head) || '-' || (length(text) + {len(END)}) || CASE WHEN loss THEN '+' ELSE '-' END || '1-', '' ORDER BY place)) AS mask_sha256
FROM seen GROUP BY conv_id, part, speaker
"""
