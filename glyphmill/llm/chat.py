"""Chat formatting in budgeted windows.

A conversation's turns are laid on a line by prefix sums of their token counts.  The line is cut in cells of half the budget (less the
system turn); the turns that start in a cell are the new turns of one window, and a turn longer than a cell, which is
always the last to start in it, has a window of its own.  So windows are turn-aligned, keep within the budget unless a
single turn does not, and are found without walking through the conversation.  A window repeats the system turn and, as
far as there is room, the turns just before its new ones.  Only assistant turns that are new in a window are targets, so
each is one exactly once.

Template: ``### role: text </turn>`` and a line feed per turn.  Inside roles and texts a backslash is written ``\\0``, ``###``
``\\1`` and ``</turn>`` ``\\2``, in roles also a colon ``\\3``.  Every backslash is followed by a digit, so this is undone by
replacing in the opposite order.

Prefix sums are summed in two levels, over runs of ``RUN`` turn numbers and inside a run, so a conversation that holds a
third of all rows is dealt over many tasks, and the windows are groups of bounded size.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glyphmill.llm.base import read

BUDGET = 1024
HISTORY = 256
#: Tokens that the template adds to a turn.
FRAME = 4
RUN = 256
#: What counts as a token: a run of letters and digits, or any other visible character.
TOKEN = r"[\p{L}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{N}]"
#: Fixed values of the template.
OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
ESCAPES = (("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\3"))


def escaped(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _on(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def placed_turns(convs: DataFrame, budget: int, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, pos, role, text, cost, start, w (window; null for a leading system turn), sys (that turn's cost)."""
    base = convs.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumns({"cost": (F.regexp_count("text", F.lit(TOKEN)) + FRAME).cast("long"), "run": F.floor(F.col("turn") / RUN)})
    first = F.min(F.struct("turn", "role", F.col("text").alias("t"), "cost")).alias("first")
    runs = base.groupBy("conv_id", "run").agg(F.sum("cost").alias("c"), F.count(F.lit(1)).alias("n"), first)
    line = Window.partitionBy("conv_id").orderBy("run")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    head = F.first("first").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = runs.select(
        F.col("conv_id").alias("_c"), F.col("run").alias("_r"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_at"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_pos"),
        F.when(head["role"] == "system", head["cost"]).otherwise(0).alias("sys"))
    inside = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    own = base.withColumns({"_own": F.coalesce(F.sum("cost").over(inside), F.lit(0)), "_n": F.count(F.lit(1)).over(inside)})
    on = own.join(placed, _on(["conv_id", "run"], ["_c", "_r"]))
    pos = F.col("_pos") + F.col("_n")
    cell = F.greatest(F.lit(budget // 4), F.floor((budget - F.col("sys")) / 2))
    body = ~((pos == 0) & (F.col("sys") > 0))
    start = F.col("_at") + F.col("_own") - F.col("sys")
    return on.select(
        "conv_id", pos.alias("pos"), "role", "text", "cost", F.when(body, start).alias("start"),
        F.when(body, (2 * F.floor(start / cell) + (F.col("cost") > cell).cast("long"))).alias("w"), "sys")


def windows(convs: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: conv_id, window, formatted, loss_spans (code points, end exclusive), fresh (per turn: not repeated), n_tokens.

    Rows are taken by turn, equal turns by role and text (nulls first); repeated rows are turns of their own.  A null conversation id
    is a conversation, a null role or text is empty.  A single turn beyond the budget makes one window beyond it.  No
    rows give no rows; other columns are not looked at.
    """
    turns = placed_turns(convs, budget, conv_col, turn_col, role_col, text_col)
    body = turns.filter("w is not null")
    system = turns.filter("w is null")
    seg = [F.lit(1).alias("kind"), "pos", "role", "text", "cost"]
    new = body.select("conv_id", "w", *seg, F.lit(True).alias("fresh"))
    spans = body.groupBy("conv_id", "w").agg(F.min("start").alias("from"), F.sum("cost").alias("used"), F.max("sys").alias("sys"))
    room = F.greatest(F.lit(0), F.least(F.lit(history), budget - F.col("sys") - F.col("used")))
    wide = max(1, history)
    back = spans.filter(F.col("from") > 0).select(F.col("conv_id").alias("_c"), F.col("w").alias("_w"), "from", (F.col("from") - room).alias("to"), F.floor(F.col("from") / wide).alias("_g"))
    near = body.withColumn("_h", F.explode(F.array(F.floor(F.col("start") / wide), F.floor(F.col("start") / wide) + 1)))
    again = near.join(back, _on(["conv_id", "_h"], ["_c", "_g"]) & (F.col("start") < F.col("from")) & (F.col("start") >= F.col("to"))).select(
        "conv_id", F.col("_w").alias("w"), *seg, F.lit(False).alias("fresh"))
    lone = system.select(F.col("conv_id").alias("_c"), "pos", "role", "text", "cost")
    led = spans.select("conv_id", "w", "from")
    heads = led.join(lone, _on(["conv_id"], ["_c"])).select(
        "conv_id", "w", F.lit(0).alias("kind"), "pos", "role", "text", "cost", (F.col("from") == 0).alias("fresh"))
    only = system.join(led.select(F.col("conv_id").alias("_c")), _on(["conv_id"], ["_c"]), "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("w"), F.lit(0).alias("kind"), "pos", "role", "text", "cost", F.lit(True).alias("fresh"))
    rows = new.unionByName(again).unionByName(heads).unionByName(only)

    lead = F.concat(F.lit(OPEN), escaped(F.col("role"), ROLE_ESCAPES), F.lit(BETWEEN))
    written = rows.select("conv_id", "w", "cost", F.struct(
        "kind", "pos", F.concat(lead, escaped(F.col("text")), F.lit(CLOSE)).alias("s"), F.char_length(lead).alias("lead"),
        F.char_length(escaped(F.col("text"))).alias("chars"), (F.col("fresh") & (F.col("role") == "assistant")).alias("target"), "fresh").alias("x"))
    packed = written.groupBy("conv_id", "w").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("cost").alias("n_tokens"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    marked = F.aggregate("x", start, lambda a, x: F.struct(
        (a["at"] + F.char_length(x["s"])).alias("at"),
        F.when(x["target"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["lead"]).alias("start"), (a["at"] + x["lead"] + x["chars"]).alias("end")))))
        .otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])
    return packed.select("conv_id", F.col("w").alias("window"), F.array_join(F.col("x.s"), "").alias("formatted"), marked.alias("loss_spans"),
                         F.col("x.fresh").alias("fresh"), "n_tokens")


def parsed(formatted: Column) -> Column:
    """The turns of a formatted window: array of struct(role, text)."""
    parts = F.filter(F.split(formatted, CLOSE), lambda s: s != "")

    def turn(s: Column) -> Column:
        lead = F.substring_index(s, BETWEEN, 1)
        return F.struct(unescaped(F.substring(lead, F.lit(len(OPEN) + 1), F.char_length(lead)), ROLE_ESCAPES).alias("role"),
                        unescaped(F.substring(s, F.char_length(lead) + len(BETWEEN) + 1, F.char_length(s))).alias("text"))

    return F.transform(parts, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the windows.

    A digest of a whole conversation needs its text in one row; only here does a conversation come together.
    """
    turns = F.filter(F.arrays_zip(parsed(F.col("formatted")).alias("t"), F.col("fresh").alias("f")), lambda z: z["f"])
    read_back = formatted.withColumn("t", turns).select(
        "conv_id", "window", F.size("t").alias("n"), F.char_length("formatted").alias("chars"),
        F.array_join(F.transform("t", lambda z: F.concat(z["t"]["role"], F.lit("\n"), z["t"]["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "").alias("loss"))
    whole = read_back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("x"))
    loss = F.array_join(F.col("x.loss"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("x.said"), ""), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return digests(windows(convs.unionByName(probe)))


ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), k as (
  select *, 4 + len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{N}]')) as cost,
    length('### ' || replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), ':', '\3') || ': '
      || replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2') || ' </turn>' || chr(10)) as chars from c
), o as (
  select *, row_number() over l - 1 as pos, coalesce(sum(cost) over (partition by conv_id order by turn, role, text rows between unbounded preceding and 1 preceding), 0) as ahead,
    case when first_value(role) over l = 'system' then first_value(cost) over l else 0 end as sys,
    case when first_value(role) over l = 'system' then first_value(chars) over l else 0 end as sys_chars
  from k window l as (partition by conv_id order by turn, role, text)
), b as (
  select *, ahead - sys as start, greatest(256, (1024 - sys) // 2) as cell from o where not (pos = 0 and sys > 0)
), w as (
  select *, 2 * (start // cell) + case when cost > cell then 1 else 0 end as w from b
), s as (
  select conv_id, w, min(start) as f, sum(cost) as used, max(sys) as sys, max(sys_chars) as sys_chars, sum(chars) as chars from w group by 1, 2
), h as (
  select s.conv_id, sum(w.chars) as chars from s join w on w.conv_id = s.conv_id and w.start < s.f
    and w.start >= s.f - greatest(0, least(256, 1024 - s.sys - s.used)) group by 1
), f as (
  select conv_id, sum(chars + sys_chars) as chars from s group by 1
  union all select conv_id, chars from h
  union all select conv_id, sys_chars from o where pos = 0 and sys > 0 and conv_id not in (select conv_id from s)
), fc as (select conv_id, cast(sum(chars) as bigint) as formatted_chars from f group by 1)
select c.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, any_value(formatted_chars) as formatted_chars
from c join fc on fc.conv_id = c.conv_id group by 1
"""
