"""Chat formatting: collapse cumulative snapshots, render what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lexigrid.llm.common import Scratch


def number_turns(turns: DataFrame) -> DataFrame:
    """conv_id, k (1, 2, .. by turn, nulls first; ties by role, then text), n
    (turns of the conversation), role, text, h1 and h2: rolling hashes of the
    first k turns, null and empty text being different.

    The hash of a prefix is the xor of hashes of (k, role, text), so it rolls
    as a running aggregate and no conversation is gathered in one array. Rows
    of a null conv_id form one conversation."""
    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy("conv_id")))
    told = [F.col("role").isNull().cast("int"), "role", F.col("text").isNull().cast("int"), "text"]
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("x1", F.xxhash64("k", *told)).withColumn("x2", F.xxhash64(F.lit("second"), *told, "k"))
    return rows.select("conv_id", "k", "n", "role", "text", F.bit_xor("x1").over(upto).alias("h1"), F.bit_xor("x2").over(upto).alias("h2"))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, status of every conversation: ``prefix`` (its turns
    begin a longer one), else ``kept``, or ``duplicate`` of the equal one with
    the smallest id (null is the smallest).

    Groups of equal prefixes shrink map-side to a row a task, and the
    anti-join meets each prefix once, so a first turn or a whole conversation
    that a third of the logs share costs no more than a rare one."""
    scratch = Scratch(turns.sparkSession, "chats")
    rolled = scratch.save(number_turns(turns).select("conv_id", "k", "n", "h1", "h2"))
    key = ["k", "h1", "h2"]
    finals = rolled.where("k = n").select("conv_id", *key)
    inner = rolled.where("k < n").select(*key).distinct()
    unique = finals.groupBy(*key).agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("some"), "conv_id"))["conv_id"].alias("first"))
    maximal = scratch.save(unique.join(inner, key, "left_anti"))
    state = finals.join(maximal.withColumn("maximal", F.lit(True)), key, "left")
    status = F.when(F.col("maximal").isNull(), "prefix").when(F.col("conv_id").eqNullSafe(F.col("first")), "kept").otherwise("duplicate")
    return state.select("conv_id", F.col("k").cast("bigint").alias("n_turns"), status.alias("status"))


# The marks of the chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, chat: the template's text of the conversations whose ids are in
    kept. A null role or text is empty; ``<|`` inside a text becomes ``<\\|``,
    so that no text can forge a mark."""
    safe = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("<\\|"))
    one = F.concat(F.lit(OPEN), safe("role"), F.lit("\n"), safe("text"), F.lit(CLOSE), F.lit("\n"))
    rows = number_turns(turns).select("conv_id", "k", one.alias("t"))
    chat = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "")
    ids = kept.select(F.col("conv_id").alias("id"))
    return rows.join(ids, rows["conv_id"].eqNullSafe(ids["id"]), "left_semi").groupBy("conv_id").agg(chat.alias("chat"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, status, chat (null unless kept)."""
    state = Scratch(turns.sparkSession, "chats").save(collapse(turns))
    chats = render(turns, state.where("status = 'kept'")).withColumnRenamed("conv_id", "id")
    return state.join(chats, state["conv_id"].eqNullSafe(chats["id"]), "left").drop("id")
