"""Chat history: trimming, context for the model and for retrieval, and what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from .changes import latest

ROLES = ("system", "user", "assistant", "tool")
# The names of the roles and the heading in contexts.
LABELS = {"system": "Инструкции агента/проекта", "user": "Пользователь", "assistant": "Ассистент", "tool": "Инструмент"}
HEADING = "Предыдущие вопросы пользователя:"
KEYS = ("user_id", "chat_id")


def usable(messages: DataFrame) -> DataFrame:
    """Messages of a known role with content, stripped; each (user, chat, position) once, the one
    loaded last, of several of that time the one with the greatest columns."""
    one = latest(messages, (*KEYS, "position"), *[c for c in ("loaded_at",) if c in messages.columns])
    return one.where(F.col("role").isin(*ROLES)).withColumn("content", T.strip(F.col("content"))).where("content <> ''")


def _suffix(c: Column, n: Column) -> Column:
    return F.when(n >= F.length(c), c).otherwise(F.substring(c, F.length(c) - n + 1, F.greatest(n, F.lit(0))))


def _newest_first() -> W:
    return W.partitionBy(*KEYS).orderBy(F.desc("position"))


def trim(messages: DataFrame, most: int = 100, chars: int = 500_000) -> DataFrame:
    """The last `most` messages of each chat, newest first within `chars`; the oldest one kept may lose its beginning."""
    w = _newest_first()
    kept = usable(messages).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    before = F.coalesce(F.sum(F.length("content")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return kept.withColumn("_left", F.lit(chars) - before).where("_left > 0").withColumn("content", _suffix(F.col("content"), F.col("_left"))).drop("_n", "_left")


def latest_question(messages: DataFrame) -> DataFrame:
    """(user_id, chat_id, question): the last user message with content."""
    users = usable(messages).where("role = 'user'")
    return users.groupBy(*KEYS).agg(F.max(F.struct("position", "content")).alias("m")).select(*KEYS, F.col("m.content").alias("question"))


def _before_question(messages: DataFrame) -> DataFrame:
    last = F.max(F.when(F.col("role") == "user", F.col("position"))).over(W.partitionBy(*KEYS))
    return usable(messages).withColumn("_last", last).where("position < _last").drop("_last")


def conversation_context(messages: DataFrame, most: int = 20, chars: int = 24_000) -> DataFrame:
    """(user_id, chat_id, context): labelled turns before the last question, oldest first, blank lines between.

    Turns are taken newest first until one has no room; the last one taken may lose its beginning.
    """
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    w = _newest_first()
    turns = _before_question(messages).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).withColumn("_label", labels[F.col("role")])
    turns = turns.withColumn("_cost", F.length("_label") + 2 + F.length("content"))
    before = F.coalesce(F.sum("_cost").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("_room", F.lit(chars) - before - F.length("_label") - 2)
    turns = turns.withColumn("_full", F.max(F.when(F.col("_room") <= 0, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))).where("_full = 0")
    block = F.concat("_label", F.lit(":\n"), _suffix(F.col("content"), F.col("_room")))
    blocks = turns.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))).alias("_b"))
    return blocks.select(*KEYS, F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n").alias("context"))


def retrieval_context(messages: DataFrame, most: int = 3, chars: int = 2_000) -> DataFrame:
    """(user_id, chat_id, context): the questions before the last one as a list, oldest first, within `chars`."""
    w = _newest_first()
    asked = _before_question(messages).where("role = 'user'").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    before = F.coalesce(F.sum(F.length("content")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    asked = asked.withColumn("_room", F.lit(chars) - before).where("_room > 0")
    line = F.concat(F.lit("- "), _suffix(F.col("content"), F.col("_room")))
    lines = asked.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("position", line.alias("b")))).alias("_b"))
    return lines.select(*KEYS, F.concat(F.lit(HEADING + "\n"), F.array_join(F.transform("_b", lambda x: x["b"]), "\n")).alias("context"))


def synced(stored: DataFrame, incoming: DataFrame, most: int = 100, chars: int = 500_000) -> DataFrame:
    """Histories after a request: one incoming message is added unless it repeats the last; several replace the chat.

    Both sides: user_id, chat_id, position, role, content. Chats that nothing came in for stay as they are.
    """
    columns = [*KEYS, "position", "role", "content"]
    new = trim(incoming, most, chars).select(*columns)
    counts = new.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    ends = stored.groupBy(*KEYS).agg(F.max(F.struct("position", "role", "content")).alias("_e"))
    marked = new.join(counts, list(KEYS)).join(ends, list(KEYS), "left")
    single = (F.col("_n") == 1) & F.col("_e").isNotNull()
    repeated = single & (F.col("role") == F.col("_e.role")) & (F.col("content") == F.col("_e.content"))
    added = marked.where(~F.coalesce(repeated, F.lit(False))).withColumn("position", F.when(single, F.col("_e.position") + 1).otherwise(F.col("position"))).select(*columns)
    replaced = counts.join(ends, list(KEYS), "left").where("_n > 1 or _e is null").select(*KEYS)
    kept = stored.select(*columns).join(replaced, list(KEYS), "left_anti")
    merged = trim(kept.unionByName(added), most, chars).select(*columns)
    return merged.withColumn("position", F.row_number().over(W.partitionBy(*KEYS).orderBy("position")) - 1)
