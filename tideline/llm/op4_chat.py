"""Chat formatting into budgeted windows, with DataFrame functions only.

Running sums of turn tokens place each turn in a span: span number = tokens before the turn over a stride. A turn
longer than the stride stands alone; else a span has at most two strides of tokens, so that it fits the budget together
with the system turn and the history that each later window repeats. Repeated turns are masked: the loss covers the text
of each assistant turn once, in the window where it is new.

A context turn is ``[INST]role[SAYS]text[/INST]``, an assistant's ``<s>assistant[SAYS]text</s>``. In roles and texts a
backslash is doubled, and one is put behind the first character of each control string, so none is left and reading
back is exact.

Running sums are made of sums over blocks of turn numbers and a sum within the block, so a conversation of any length
is spread; only the digest over a whole conversation needs its text in one row.

Defined cases: null text and null role are empty; a null turn comes first; turns with an equal number are ordered by
role and text; a null conv_id is one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET, HISTORY_BUDGET, HISTORY_TURNS = 512, 128, 2
TURN_TOKENS = 4  #: what a turn's marks count
BLOCK = 64
CONTROL = r"(?=/?(?:s>|INST\])|SAYS\])"
TURN = r"(?s)(?:<s>|\[INST\])(.*?)\[SAYS\](.*?)(?:</s>|\[/INST\])"


def escape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), r"([<\[])" + CONTROL, r"$1\\")


def unescape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"([<\[])\\" + CONTROL, "$1"), r"\\\\", r"\\")


def tokens(x: Column) -> Column:
    return (F.regexp_count(x, F.lit(r"\S+")) + TURN_TOKENS).cast("long")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def placed_turns(conversations: DataFrame, budget: int, history: int) -> DataFrame:
    """conv_id, at (from 0), role, text, n (tokens), span: each turn in its span."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block")
    ).withColumn("n", tokens(F.col("text")))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("turns"), F.sum("n").alias("tokens"))
    blocks = blocks.select(
        F.col("conv_id").alias("conv"), F.col("block").alias("block_"), F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"), F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("tokens_before")
    )
    inside = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    turns = turns.withColumn("r", F.row_number().over(inside) - 1).withColumn("s", F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    turns = turns.join(blocks, _same("conv_id", "conv") & (F.col("block") == F.col("block_"))).select(
        "conv_id", (F.col("turns_before") + F.col("r")).alias("at"), "role", "text", "n", (F.col("tokens_before") + F.col("s")).alias("before")
    )
    system = turns.where("at = 0 and role = 'system'").select(F.col("conv_id").alias("conv"), F.col("n").alias("system_n"))
    stride = F.greatest(F.lit(1), F.floor((budget - history - F.coalesce("system_n", F.lit(0))) / 2))
    span = F.floor(F.col("before") / F.col("stride")) * 2 + (F.col("n") > F.col("stride")).cast("long")
    return turns.join(system, _same("conv_id", "conv"), "left").withColumn("stride", stride).select("conv_id", "at", "role", "text", "n", span.alias("span"))


def windows(conversations: DataFrame, budget: int = BUDGET, history_budget: int = HISTORY_BUDGET, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row per window: conv_id, span, n_repeated (leading turns seen before), n_tokens, formatted, loss_spans.

    loss_spans are [start, end) of characters of ``formatted``. A window is longer than the budget only where one turn,
    or the system turn, alone is.
    """
    turns = placed_turns(conversations, budget, history_budget)
    spans = turns.groupBy("conv_id", "span").agg(F.min("at").alias("first"))
    target = F.col("role") == "assistant"
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.when(target, F.lit("<s>")).otherwise(F.lit("[INST]")), role, F.lit("[SAYS]"))
    marked = turns.select("conv_id", "at", "span", "n", "role", target.alias("target"), F.length(head).alias("skip"), F.length(text).alias("size"), F.concat(head, text, F.when(target, F.lit("</s>")).otherwise(F.lit("[/INST]"))).alias("line"))
    item = lambda repeated: F.struct(F.col("at"), F.lit(repeated).alias("repeated"), F.col("n"), F.col("target"), F.col("skip"), F.col("size"), F.col("line")).alias("item")
    new = marked.select("conv_id", "span", item(False))
    later = spans.where("first > 0").select(F.col("conv_id").alias("conv"), F.col("span").alias("of"), "first")
    system = marked.where("at = 0 and role = 'system'").join(later, _same("conv_id", "conv")).select("conv_id", F.col("of").alias("span"), item(True))
    wanted = later.select("conv", "of", "first", F.explode(F.sequence(F.lit(1), F.lit(history_turns))).alias("back")).select("conv", "of", "back", (F.col("first") - F.col("back")).alias("wanted"))
    past = marked.join(wanted, _same("conv_id", "conv") & (F.col("at") == F.col("wanted"))).where("not (at = 0 and role = 'system')")
    so_far = F.sum("n").over(W.partitionBy("conv_id", "of").orderBy("back"))
    past = past.withColumn("so_far", so_far).where(F.col("so_far") <= history_budget).select("conv_id", F.col("of").alias("span"), item(True))
    gathered = new.unionByName(system).unionByName(past).groupBy("conv_id", "span").agg(F.array_sort(F.collect_list("item")).alias("items"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["line"])).alias("at"),
        F.when(x["target"] & ~x["repeated"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["skip"]).alias("start"), (acc["at"] + x["skip"] + x["size"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    return gathered.select(
        "conv_id",
        "span",
        F.size(F.filter("items", lambda x: x["repeated"])).alias("n_repeated"),
        F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n_tokens"),
        F.array_join(F.transform("items", lambda x: x["line"]), "").alias("formatted"),
        F.aggregate("items", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    roles, said = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1)), F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2))
    new = lambda x: F.slice(x, F.col("n_repeated") + 1, F.greatest(F.size(x) - F.col("n_repeated"), F.lit(0)))
    lines = F.zip_with(new(roles), new(said), lambda r, t: F.concat(unescape(r), F.lit("\n"), unescape(t), F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"])))
    parts = formatted.select("conv_id", F.struct("span", F.size(lines).cast("long").alias("n"), F.array_join(lines, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("chars")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    added = lambda name: F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + p[name])
    whole = whole.select("conv_id", added("n").alias("n_turns"), joined("turns").alias("turns"), joined("loss").alias("loss"), added("chars").alias("formatted_chars"), F.size("parts").cast("long").alias("n_windows"))
    return whole.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows")
