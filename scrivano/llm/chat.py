"""Operator 6: chat formatting in budgeted windows.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import materialize

# The template's control strings.  A repeated turn is context only.
NEW, AGAIN, END = "<turn>", "<turn again>", "</turn>\n"
# Characters of control strings and what stands for them in texts, in the order of escaping.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
#: Turns of a conversation that are summed in one task.
CHUNK = 1024


def escape(text: Column) -> Column:
    """No control string is left; ``unescape`` restores the text."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def turn_tokens(text: Column) -> Column:
    """A turn's size: a token for every four characters, and four for the template."""
    return (F.ceil(F.length(text) / 4) + 4).cast("long")


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """Format conversations as training windows of at most ``budget`` tokens.

    turns: conv_id, turn, role, text and any other columns (ignored).  Returns
    conv_id, window (0, 1, ... of a conversation), text (the formatted turns), loss
    (array of start and length in code points: the escaped texts under the loss mask),
    n_tokens, n_new, n_repeated.

    The first turn, if its role is system, is retained: every later window begins with it.
    The stride is what the budget leaves beside it and the history, one token at least.
    Prefix sums of the other turns' tokens choose turn-aligned spans: the turns that begin
    and end in the same stride are a window; a turn that crosses the end of a stride is
    a window of its own.  Before its new turns a window repeats the latest turns within
    ``history`` tokens (a stride at most), as far as the budget has room.  So a window
    exceeds the budget only if it has one new turn, and then repeats the system turn alone.
    Repeated turns are marked and are outside the loss, so each assistant text is
    learnt once.

    A null text or role is empty.  Rows of one turn number are ordered by role and
    text; equal rows are turns of their own.  A null turn comes first, a null
    conv_id is a conversation.  Empty table: no rows.  Prefix sums run in
    chunks of the turn number, so a long conversation is spread over tasks.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))).cast("long").alias("chunk"), turn_tokens(text).alias("size"))
    inside = W.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    summed = materialize(rows.withColumns({"upto": F.sum("size").over(inside), "nth": F.row_number().over(inside)}))
    # A row for each chunk: what comes before it, and the conversation's system turn.
    sums = summed.groupBy("conv_id", "chunk").agg(F.sum("size").alias("sum"), F.count("*").alias("many"), F.max(F.when((F.col("nth") == 1) & (F.col("role") == "system"), F.col("size"))).alias("opens"))
    by_conv = W.partitionBy("conv_id").orderBy("chunk")
    earlier = by_conv.rowsBetween(W.unboundedPreceding, 0)
    base = sums.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), (F.sum("sum").over(earlier) - F.col("sum")).alias("base"), (F.sum("many").over(earlier) - F.col("many")).alias("base_n"), F.coalesce(F.first("opens").over(by_conv), F.lit(0)).alias("system"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))
    placed = summed.join(base, same).select("conv_id", "role", "text", "size", "system", (F.col("base_n") + F.col("nth") - 1).alias("nth"), (F.col("base") + F.col("upto") - F.col("size") - F.col("system")).alias("at"))
    is_system = (F.col("at") < 0).alias("is_system")
    stride = F.greatest(F.lit(budget - history) - F.col("system"), F.lit(1))
    placed = placed.select("*", is_system, stride.alias("stride"))
    placed = materialize(placed.select("*", F.floor(F.col("at") / F.col("stride")).cast("long").alias("cell"), F.floor((F.col("at") + F.col("size") - 1) / F.col("stride")).cast("long").alias("to")))

    # A row for each window: where it begins, and the room that is left for history.
    spans = placed.where("NOT is_system").groupBy("conv_id", "cell", "to").agg(F.min("at").alias("begin"), F.sum("size").alias("new"), F.first("system").alias("system"), F.first("stride").alias("stride"))
    spans = spans.withColumn("window", (F.row_number().over(W.partitionBy("conv_id").orderBy("begin")) - 1).cast("long"))
    room = F.least(F.lit(history), F.col("stride"), F.lit(budget) - F.col("system") - F.col("new"))
    spans = materialize(spans.select(F.col("conv_id").alias("c"), F.col("cell").alias("of"), F.col("to").alias("end"), "begin", "window", "stride", room.alias("room")))

    here = F.col("conv_id").eqNullSafe(F.col("c"))
    columns = ("conv_id", "window", "nth", "role", "text", "size", "again")
    first = placed.where("is_system").withColumns({"window": F.lit(0).cast("long"), "again": F.lit(False)})
    new = placed.where("NOT is_system").join(spans, here & (F.col("cell") == F.col("of")) & (F.col("to") == F.col("end"))).withColumn("again", F.lit(False))
    # History reaches back a stride at most, so it begins in the window's cell or the one before.
    back = F.floor(F.greatest(F.col("begin") - F.col("room"), F.lit(0)) / F.col("stride")).cast("long")
    wanted = spans.where("window > 0 AND room > 0").select("c", "window", "begin", "room", F.explode(F.sequence(back, F.floor((F.col("begin") - 1) / F.col("stride")).cast("long"))).alias("of"))
    recent = placed.where("NOT is_system").join(wanted, here & (F.col("cell") == F.col("of"))).where("at < begin AND begin - at <= room").withColumn("again", F.lit(True))
    kept = placed.where("is_system").join(spans.where("window > 0").select("c", "window"), here).withColumn("again", F.lit(True))
    all_turns = first.select(*columns).unionByName(new.select(*columns)).unionByName(recent.select(*columns)).unionByName(kept.select(*columns))

    body = escape(F.col("text"))
    head = F.concat(F.when(F.col("again"), F.lit(AGAIN)).otherwise(F.lit(NEW)), _escape_role(F.col("role")), F.lit("\n"))
    item = F.struct((~F.col("again")).alias("fresh"), "nth", F.concat(head, body, F.lit(END)).alias("piece"), F.length(head).alias("lead"), F.length(body).alias("body"), (~F.col("again") & (F.col("role") == "assistant")).alias("learn"))
    packed = all_turns.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("size").alias("n_tokens"), F.count_if(~F.col("again")).alias("n_new"), F.count_if("again").alias("n_repeated"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    # A window has budget / 4 turns at most.
    loss = F.aggregate(
        "items",
        start,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["piece"])).alias("at"),
            F.concat(acc["loss"], F.when(x["learn"], F.array(F.struct((acc["at"] + x["lead"]).alias("start"), x["body"].alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    return packed.select("conv_id", "window", F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("text"), loss.alias("loss"), "n_tokens", "n_new", "n_repeated")


def read_turns(windows: DataFrame) -> DataFrame:
    """Parse formatted windows: conv_id, window, at, role, text of the turns that are new in them."""
    pieces = windows.select("conv_id", "window", F.posexplode(F.split("text", END, -1)).alias("at", "piece"))
    turns = pieces.where(F.startswith("piece", F.lit(NEW)))
    role = F.substring_index(F.expr(f"substring(piece, {len(NEW) + 1})"), "\n", 1)
    text = F.expr("substring(piece, locate('\n', piece) + 1)")
    return turns.select("conv_id", "window", "at", unescape(F.replace(role, F.lit("\\n"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))


def chat_digest(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """What the formatted windows hold, read back from them, for each conversation."""
    windows = materialize(chat_windows(turns, budget, history))
    told = read_turns(windows).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "at", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("line")))).alias("lines"), F.count("*").alias("n_turns"))
    told = told.select(F.col("conv_id").alias("c"), "n_turns", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), ""), 256).alias("turns_sha256"))
    learnt = unescape(F.array_join(F.transform("loss", lambda s: F.substring(F.col("text"), s["start"] + 1, s["length"])), ""))
    masked = windows.select("conv_id", "window", learnt.alias("learnt"), F.length("text").cast("long").alias("chars"))
    sums = masked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "learnt"))).alias("parts"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("parts", lambda x: x["learnt"]), "")
    sums = sums.select("conv_id", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
    return sums.join(told, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
