"""Event logs, token streams, conversations and save slots as batch operators; ``streaming`` has their streaming twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


# --- session statistics ---
def session_stats(events: DataFrame, session: str = "user_id", kind: str = "event_type", value: str = "value", kinds: tuple[str, ...] = ()) -> DataFrame:
    """Per session: events of each kind, mean value of each kind (0 if there is none), errors."""
    per = [x for k in kinds for x in (F.count_if(F.col(kind) == k).alias(f"n_{k}"), F.coalesce(F.avg(F.when(F.col(kind) == k, F.col(value))), F.lit(0.0)).alias(f"mean_{k}"))]
    return events.groupBy(session).agg(F.count(F.lit(1)).alias("n"), *per)


def turns(events: DataFrame, session: str, order: list[str], starts: Column) -> DataFrame:
    """``turn``: how many turns of the session have started at each event; 0 before the first."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("turn", F.sum(starts.cast("int")).over(w))


def turn_summary(rows: DataFrame, session: str, ts: str, kind: str, short: str, done: str) -> DataFrame:
    """One row per turn: first and last time, milliseconds, events, whether it was short-circuited or completed."""
    out = rows.where("turn > 0").groupBy(session, "turn").agg(
        F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col(kind) == short).alias("short_circuit"), F.bool_or(F.col(kind) == done).alias("complete")
    )
    return out.withColumn("ms", F.unix_millis(F.col("ended").cast("timestamp")) - F.unix_millis(F.col("began").cast("timestamp")))


# --- routing ---
# Intents that end a turn with a canned answer.
SHORT = ("OUT_OF_DOMAIN", "AMBIGUOUS")
CANNED = {"OUT_OF_DOMAIN": "out of domain", "AMBIGUOUS": "please be more specific"}


def routed(rows: DataFrame, intent: str = "intent") -> DataFrame:
    """``branch`` and, for short-circuited rows, the canned ``message``."""
    message = F.lit(None).cast("string")
    for name, text in CANNED.items():
        message = F.when(F.col(intent) == name, F.lit(text)).otherwise(message)
    return rows.withColumn("branch", F.when(F.col(intent).isin(*SHORT), "short_circuit").otherwise("full")).withColumn("message", message)


def rewritten(rows: DataFrame, query: str, rewrite: str, history_size: str) -> DataFrame:
    """The query as it is at the first turn or where the rewrite failed or is empty, else the rewrite."""
    cleaned = F.nullif(T.clean_rewrite(F.col(rewrite)), F.lit(""))
    return rows.withColumn("final_query", F.when(F.col(history_size) == 0, F.col(query)).otherwise(F.coalesce(cleaned, F.col(query))))


# --- history ---
def last_messages(messages: DataFrame, conversation: str, order: str, n: int) -> DataFrame:
    """The last n messages of each conversation."""
    rank = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(order)))
    return messages.withColumn("r", rank).where(F.col("r") <= n).drop("r")


def history_before(messages: DataFrame, conversation: str, order: str, text: str, n: int) -> DataFrame:
    """``history``: the n texts before each message, oldest first."""
    return messages.withColumn("history", F.collect_list(text).over(Window.partitionBy(conversation).orderBy(order).rowsBetween(-n, -1)))


# --- token streams ---
FRAME = "type string, content string, message string, usage int, finish_reason string"


def frames(lines: DataFrame, stream: str, order: str, line: str) -> DataFrame:
    """Events of ``data:`` lines; other lines, end markers and broken JSON are left out."""
    body = F.trim(F.substring(F.col(line), 7, 1 << 30))
    parsed = lines.where(F.col(line).startswith("data: ") & (body != "[DONE]")).select(stream, order, F.from_json(body, FRAME).alias("e"))
    return parsed.where("e.type is not null").select(stream, order, "e.*")


def answers(events: DataFrame, stream: str, order: str) -> DataFrame:
    """One row per stream: deltas in order, last usage and finish reason, whether it ended well. A stream that ends in an
    error has no content."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("type") == "delta", F.struct(order, "content"))))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))
    out = events.groupBy(stream).agg(ordered.alias("d"), last("usage").alias("usage"), last("finish_reason").alias("finish_reason"), F.bool_or(F.col("type") == "error").alias("failed"), F.bool_or(F.col("type") == "done").alias("done"))
    content = F.array_join(F.transform("d", lambda x: F.coalesce(x["content"], F.lit(""))), "")
    return out.select(stream, F.when(~F.col("failed"), content).alias("content"), "usage", "finish_reason", "failed", "done")


def contract_breaches(events: DataFrame, stream: str, order: str) -> DataFrame:
    """Streams that don't keep to: one metadata first, then deltas, then one done or error, and nothing after."""
    w = Window.partitionBy(stream).orderBy(order)
    place, after = F.row_number().over(w), F.lead("type").over(w)
    end = F.col("type").isin("done", "error")
    first = F.col("place") == 1
    wrong = (
        F.when(first & (F.col("type") != "metadata"), "no_metadata")
        .when(~first & (F.col("type") == "metadata"), "second_metadata")
        .when(end & F.col("after").isNotNull(), "after_end")
        .when(~end & F.col("after").isNull(), "no_end")
    )
    return events.withColumn("place", place).withColumn("after", after).withColumn("breach", wrong).where("breach is not null").select(stream, order, "breach")


# --- conversations and slots ---
def upsert_latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c != key]), order).alias("x"))
    return last.select(key, "x.*")


def children(parents: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of existing parents, in order."""
    return rows.join(parents.select(key).distinct(), key, "left_semi").orderBy(key, order)


def append_turn(messages: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Messages with new ones after each conversation's last; a new conversation begins at 0."""
    last = messages.groupBy(key).agg(F.max(order).alias("__last__"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    placed = new.withColumn("__r__", rank).join(last, key, "left").withColumn(order, F.coalesce("__last__", F.lit(-1)) + F.col("__r__")).drop("__r__", "__last__")
    return messages.unionByName(placed, allowMissingColumns=True)


def without_conversations(messages: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Deletion of parents takes their messages along."""
    return messages.join(gone.select(key).distinct(), key, "left_anti")


def registry_hop(rows: DataFrame, entries: DataFrame, key: str, entry_key: str) -> DataFrame:
    """Entry of each key with the keys before and after it; null where there is none."""
    w = Window.partitionBy(F.lit(1)).orderBy(entry_key)  # a static registry: a few hundred entries
    linked = entries.withColumns({"previous": F.lag(entry_key).over(w), "following": F.lead(entry_key).over(w)})
    return rows.join(linked, F.col(key) == F.col(entry_key), "left")
