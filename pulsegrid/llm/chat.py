"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens choose the windows: the running count of tokens is cut into cells of equal size; turns that lie
wholly in a cell form a window, a turn that crosses from one cell to another is a window of its own. So no window's new turns
exceed the cell, but for a single turn that does so alone. A window starts with the conversation's system turn and with the
last turns of the window before it, as far as the history budget goes. Only new assistant turns are under the loss mask.

Sums are taken in two steps, within blocks of turns and over blocks, so a very long conversation is no single task's work.

The template writes a turn as `<turn ROLE>`, a new line, the text, `</turn>` and a new line. In texts and roles a backslash
becomes `\\b`, `<` becomes `\\l` and `>` in roles `\\g`: no control string is left inside, and plain replacement restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of new turns in a window, and of repeated history. A turn counts a token for each four characters and four more.
SPAN = 384
HISTORY = 96
#: Turns in a block of the two-step sums.
BLOCK = 256

_OPEN, _MIDDLE, _CLOSE = "<turn ", ">\n", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def restored(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def _plain_role(role: Column) -> Column:
    return restored(F.replace(role, F.lit("\\g"), F.lit(">")))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, tokens, end): turns numbered from 0, with the running sum of tokens.

    Turns go by turn (nulls first), then role and text. Blocks are cut by turn number, so equal or missing numbers share one.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.floor((F.char_length("text") + 3) / 4) + 4).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("of"), F.col("block").alias("part"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before_n"), F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("before"))
    inner = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("inner", F.row_number().over(inner)).withColumn("sum", F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("part")))
    return rows.select("conv_id", (F.col("before_n") + F.col("inner") - 1).alias("pos"), "role", "text", "tokens", (F.col("before") + F.col("sum")).alias("end"))


def windows(turns: DataFrame, span: int = SPAN, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, context (leading turns that are repeated), loss (array of start, end).

    Offsets count code points of formatted, the end is exclusive, and a span covers a turn's escaped text without its marks.
    turns: conv_id, turn, role, text; null texts and roles count as empty, null conversation ids as one conversation. Repeated
    rows are turns of their own. The first turn of a conversation whose role is system is its system turn. An empty table
    gives no windows; further columns are not looked at.
    """
    rows = numbered_turns(turns)
    first_cell, last_cell = F.floor((F.col("end") - F.col("tokens")) / span), F.floor((F.col("end") - 1) / span)
    key = F.when(first_cell == last_cell, 2 * first_cell).otherwise(2 * last_cell - 1)
    rows = rows.withColumn("key", key)
    # windows are few turns each, as each turn counts at least four tokens
    one = Window.partitionBy("conv_id", "key")
    rows = rows.withColumn("window_end", F.max("end").over(one)).withColumn("is_system", (F.col("role") == "system") & (F.col("pos") == 0))
    repeats = (F.col("window_end") - F.col("end") + F.col("tokens") <= history) & ~F.col("is_system")

    keys = rows.groupBy("conv_id", "key").agg(F.max("window_end").alias("upto"), F.min("pos").alias("first_pos"))
    next_key = F.lead("key").over(Window.partitionBy("conv_id").orderBy("key"))
    follow = keys.select(F.col("conv_id").alias("of"), F.col("key").alias("from_key"), next_key.alias("next_key"))
    carried = rows.where(repeats).join(follow, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("from_key"))).where("next_key is not null")
    fields = ["conv_id", "pos", "role", "text"]
    new = rows.select(*fields, "key", F.lit(2).alias("kind"))
    old = carried.select(*fields, F.col("next_key").alias("key"), F.lit(1).alias("kind"))
    system = rows.where("is_system").select(*fields).join(keys.where("first_pos > 0").select(F.col("conv_id").alias("of"), "key"), F.col("conv_id").eqNullSafe(F.col("of")))
    system = system.select(*fields, "key", F.lit(0).alias("kind"))

    rows = new.unionByName(old).unionByName(system)
    rows = rows.withColumn("body", escaped(F.col("text"))).withColumn("head", F.concat(F.lit(_OPEN), _role(F.col("role")), F.lit(_MIDDLE)))
    order = Window.partitionBy("conv_id", "key").orderBy("kind", "pos")
    size = F.char_length("head") + F.char_length("body") + F.lit(len(_CLOSE))
    start = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.char_length("head")
    rows = rows.withColumn("start", start)
    under = (F.col("kind") == 2) & (F.col("role") == "assistant")
    turn = F.struct("kind", "pos", F.concat("head", "body", F.lit(_CLOSE)).alias("said"), under.alias("under"), "start", (F.col("start") + F.char_length("body")).alias("end"))
    out = rows.groupBy("conv_id", "key").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["under"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return out.select("conv_id", F.col("key").alias("window"), F.array_join("turns.said", "").alias("formatted"), F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("context"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What windows() wrote, read from its strings and masks alone: one row per conversation.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars. A digest covers a conversation's
    whole text, so here its windows meet in one row.
    """
    whole = F.lit(r"<turn ([^<>]*)>\n([^<]*)</turn>\n")
    roles, bodies = F.regexp_extract_all("formatted", whole, F.lit(1)), F.regexp_extract_all("formatted", whole, F.lit(2))
    pairs = F.arrays_zip(roles.alias("role"), bodies.alias("body"))
    fresh = F.slice(pairs, F.col("context") + 1, F.greatest(F.lit(0), F.size(pairs) - F.col("context")))
    said = F.transform(fresh, lambda t: F.concat(_plain_role(t["role"]), F.lit("\n"), restored(t["body"]), F.lit("\n")))
    masked = F.transform("loss", lambda s: restored(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    rows = formatted.select("conv_id", "window", F.size(fresh).cast("long").alias("n"), F.array_join(said, "").alias("said"), F.array_join(masked, "").alias("masked"), F.char_length("formatted").cast("long").alias("chars"))
    by = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "said", "masked"))).alias("parts"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join("parts.masked", "")
    return by.select("conv_id", "n_turns", F.sha2(F.array_join("parts.said", ""), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
