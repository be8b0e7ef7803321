"""Queries of sessions, streams, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import plugins as X
from ..operators import reducers as N
from ..operators import sessions as P
from ..session import shared_path
from ..sources import jsonl, keyed, tables
from ..sources.prompts import text_file
from ..streaming import sinks, sse, twins
from .catalog import CHUNKS, chunks, query, table

CONV = "conv_id long, turn long, role string, text string"
_KINDS = ("click", "view")


def place(spark: SparkSession, tag: str) -> str:
    return shared_path(spark, tag)


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


_STATS = "select user_id, count(*) as n, " + ", ".join(f"count(*) filter (event_type = '{k}') as n_{k}, round(coalesce(avg(value) filter (event_type = '{k}'), 0.0), 6) as mean_{k}" for k in _KINDS) + " from events group by user_id"


@query(_STATS)
def a34_session_stats(spark: SparkSession, d: str) -> DataFrame:
    out = P.session_stats(events(spark, d), kinds=_KINDS)
    return out.withColumns({f"mean_{k}": F.round(f"mean_{k}", 6) for k in _KINDS})


@query(_STATS)
def t09_streaming_session_stats(spark: SparkSession, d: str) -> DataFrame:
    out = twins.run_to_table(twins.session_stats(twins.event_stream(spark, d), _KINDS), place(spark, "t09"), "complete")
    return out.withColumns({f"mean_{k}": F.round(f"mean_{k}", 6) for k in _KINDS})


@query("select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def t_ext_hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    out = twins.run_to_table(twins.windowed(twins.event_stream(spark, d), "1 hour", "1 day"), place(spark, "hourly"), "complete")
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))


@query("select user_id, round(case when sum(value) > 0 then round(count(*) * 1000.0 / sum(value), 1) else 0.0 end, 1)::double as per_second from events group by user_id")
def f25_rate(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("ms")).select("user_id", S.rate(F.col("n"), F.col("ms")).alias("per_second"))


_TURNS = "t as (select *, sum(cast(event_id % 5 = 0 as int)) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as turn from events)"


@query(f"with {_TURNS} select user_id, cast(turn as bigint) as turn, count(*) as n, bool_or(event_type = 'view') as short_circuit, bool_or(event_type = 'click') as complete, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 as ms from t where turn > 0 group by all")
def t06_turn_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    rows = P.turns(events(spark, d), "user_id", ["ts", "event_id"], F.col("event_id") % 5 == 0)
    return P.turn_summary(rows, "user_id", "ts", "event_type", "view", "click").select("user_id", F.col("turn").cast("long").alias("turn"), "n", "short_circuit", "complete", "ms")


_INTENT = "case turn % 4 when 0 then 'OUT_OF_DOMAIN' when 1 then 'AMBIGUOUS' else 'COMMENTARY' end"


@query(f"select conv_id, turn, case when {_INTENT} = 'COMMENTARY' then 'full' else 'short_circuit' end as branch, case {_INTENT} when 'OUT_OF_DOMAIN' then 'out of domain' when 'AMBIGUOUS' then 'please be more specific' end as message from conversations")
def t07_routing(spark: SparkSession, d: str) -> DataFrame:
    intent = F.when(F.col("turn") % 4 == 0, "OUT_OF_DOMAIN").when(F.col("turn") % 4 == 1, "AMBIGUOUS").otherwise("COMMENTARY")
    return P.routed(conversations(spark, d).withColumn("intent", intent)).select("conv_id", "turn", "branch", "message")


@query("select conv_id, turn, case when turn = 0 then text when turn % 2 = 1 then text else 'rewrite ' || turn end as final_query from conversations")
def t08_rewrite_fallback(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("turn") % 2 == 1, "  \n").otherwise(F.concat(F.lit('Query: "rewrite '), F.col("turn").cast("string"), F.lit('"')))
    rows = conversations(spark, d).withColumn("raw", raw)
    return P.rewritten(rows, "text", "raw", "turn").select("conv_id", "turn", "final_query")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 6")
def w07_recent_history(spark: SparkSession, d: str) -> DataFrame:
    return P.last_messages(conversations(spark, d), "conv_id", "turn", 6).select("conv_id", "turn", "role")


@query("select conv_id, turn, cast(len(list(text) over (partition by conv_id order by turn rows between 6 preceding and 1 preceding)) as int) as n from conversations".replace("len(list", "coalesce(len(list").replace("preceding)) as int", "preceding)), 0) as int"))
def w07_history_window(spark: SparkSession, d: str) -> DataFrame:
    return P.history_before(conversations(spark, d), "conv_id", "turn", "text", 6).select("conv_id", "turn", F.size("history").alias("n"))


def sse_lines(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as token streams: metadata, texts as deltas, an end; some noise between."""
    rows = conversations(spark, d)
    body = F.to_json(F.struct(F.lit("delta").alias("type"), F.col("text").alias("content")))
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("t"))
    end = F.when(F.col("conv_id") % 10 == 3, '{"type":"error","message":"x"}').otherwise('{"type":"done","usage":7,"finish_reason":"stop"}')
    line = lambda c: F.concat(F.lit("data: "), c)
    return (
        rows.select("conv_id", (F.col("turn") * 2 + 2).alias("seq"), line(body).alias("line"))
        .unionByName(rows.select("conv_id", (F.col("turn") * 2 + 3).alias("seq"), F.when(F.col("turn") % 2 == 0, ": comment").otherwise("data: {broken").alias("line")))
        .unionByName(last.select("conv_id", F.lit(0).cast("long").alias("seq"), F.lit('data: {"type":"metadata"}').alias("line")))
        .unionByName(last.where("conv_id % 10 <> 4").select("conv_id", (F.col("t") * 2 + 10).alias("seq"), line(end).alias("line")))
        .unionByName(last.select("conv_id", (F.col("t") * 2 + 11).alias("seq"), F.lit("data: [DONE]").alias("line")))
    )


@query("select conv_id, turn * 2 + 2 as seq, 'delta' as type from conversations union all select distinct conv_id, 0, 'metadata' from conversations union all select conv_id, max(turn) * 2 + 10, case when conv_id % 10 = 3 then 'error' else 'done' end from conversations where conv_id % 10 <> 4 group by conv_id")
def t01_stream_frames(spark: SparkSession, d: str) -> DataFrame:
    return P.frames(sse_lines(spark, d), "conv_id", "seq", "line").select("conv_id", "seq", "type")


@query("select conv_id, case when conv_id % 10 <> 3 then md5(string_agg(text, '' order by turn)) end as content, case when conv_id % 10 not in (3, 4) then 7 end as usage, case when conv_id % 10 not in (3, 4) then 'stop' end as finish_reason, conv_id % 10 = 3 as failed from conversations group by conv_id")
def t02_delta_accumulation(spark: SparkSession, d: str) -> DataFrame:
    out = P.answers(P.frames(sse_lines(spark, d), "conv_id", "seq", "line"), "conv_id", "seq")
    return out.select("conv_id", F.md5("content").alias("content"), "usage", "finish_reason", "failed")


@query("select case when text is null or length(text) < 100 then 'short' when role = 'user' then 'search' else 'unrouted' end as route, count(*) as n, sum(length(text))::bigint as chars from conversations group by 1")
def t07_routed_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Messages as a stream with three sinks: short ones, the user's, all others."""
    path = place(spark, "t07")
    conversations(spark, d).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(CONV).parquet(f"{path}/in")
    same = lambda df: df
    routes = [("short", F.col("text").isNull() | (F.char_length("text") < 100), same), ("search", F.col("role") == "user", same)]
    sinks.run_routes(stream, routes, f"{path}/out")
    one = lambda name: sinks.routed(stream, name, f"{path}/out").agg(F.lit(name).alias("route"), F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))
    return one("short").unionByName(one("search")).unionByName(one("unrouted")).where("n > 0")


#: Bytes of a piece of a stream, and the minutes between the two batches in which pieces arrive.
PIECE, MINUTES = 53, 2


@query("""select conv_id, case when conv_id % 10 <> 3 then md5(string_agg(text, '' order by turn)) end as content, case when conv_id % 10 not in (3, 4) then 7 end as usage,
  case when conv_id % 10 not in (3, 4) then 'stop' end as finish_reason, conv_id % 10 = 3 as failed, case when conv_id % 10 = 4 then 'no_end' end as breach from conversations group by conv_id""")
def t01_t02_byte_stream(spark: SparkSession, d: str) -> DataFrame:
    """The streams as bytes, cut into pieces anywhere, that arrive in two batches; a last row lets time go on."""
    whole = sse_lines(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("x"))
    whole = whole.select("conv_id", F.concat(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("\n")).cast("binary").alias("b"))
    last = F.floor((F.octet_length("b") - 1) / PIECE)
    pieces = whole.select("conv_id", "b", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"))
    batch = F.floor(F.col("seq") * 2 / (F.col("last") + 1))
    at = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), batch * MINUTES, F.lit(0))
    pieces = pieces.select("conv_id", "seq", F.substring("b", F.col("seq") * PIECE + 1, F.lit(PIECE)).alias("bytes"), at.alias("at"), batch.alias("batch"))
    schema, path = "conv_id long, seq long, bytes binary, at timestamp", place(spark, "t01")
    with sse.rocks(spark):
        for k in (0, 1):
            rows = pieces.where(F.col("batch") == k).drop("batch")
            end = spark.sql("select -1L as conv_id, 0L as seq, cast('' as binary) as bytes, timestamp'2024-01-02 00:00:00' as at")
            (rows.unionByName(end) if k else rows).write.mode("append").parquet(f"{path}/in")
            stream = sse.answer_stream(spark.readStream.schema(schema).parquet(f"{path}/in"), "conv_id")
            stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    out = spark.read.schema(f"conv_id long, {sse.ANSWER}").parquet(f"{path}/out")
    return out.select("conv_id", F.md5("content").alias("content"), "usage", "finish_reason", "failed", "breach")


@query("select conv_id, max(turn) * 2 + 2 as seq, 'no_end' as breach from conversations where conv_id % 10 = 4 group by conv_id")
def t15_stream_contract(spark: SparkSession, d: str) -> DataFrame:
    return P.contract_breaches(P.frames(sse_lines(spark, d), "conv_id", "seq", "line"), "conv_id", "seq")


def dialogue_events(spark: SparkSession, d: str, of: dict[str, list[str]], other: list[str]) -> DataFrame:
    """conv_id, turn, at, kind: the events that each message stands for, by its role, in order."""
    kinds = F.array(*map(F.lit, other))
    for role, own in of.items():
        kinds = F.when(F.col("role") == role, F.array(*map(F.lit, own))).otherwise(kinds)
    rows = conversations(spark, d).select("conv_id", "turn", F.posexplode(kinds).alias("k", "kind"))
    return rows.select("conv_id", "turn", (F.col("turn") * 2 + F.col("k")).alias("at"), "kind")


@query("select conv_id, turn, count(*) filter (role = 'user') over (partition by conv_id order by turn rows between unbounded preceding and current row) >= 1 and role = 'assistant' as open from conversations")
def t05_transition_gate(spark: SparkSession, d: str) -> DataFrame:
    """Open when the dialogue is idle (its last message is an answer) and the user has spoken. A question starts an answer, which
    the assistant's message ends."""
    events = dialogue_events(spark, d, {"user": ["user", "start"], "assistant": ["booting", "done"]}, ["booting", "booting"])
    states = N.gate(N.states_along(events, "conv_id", "at", "kind", N.DIALOGUE))
    return states.where("at % 2 = 1").select("conv_id", F.floor(F.col("at") / 2).alias("turn"), F.col("may_leave").alias("open"))


@query("select conv_id, 'idle' as status, count(*) filter (role = 'user') as user_turns, count(*) filter (role in ('user', 'assistant')) as messages, 'False' as open, cast(null as varchar) as error from conversations group by conv_id")
def t03_t04_dialogue_state(spark: SparkSession, d: str) -> DataFrame:
    events = dialogue_events(spark, d, {"user": ["user"], "assistant": ["start", "done"]}, ["booting", "done"])
    return N.final_states(events, "conv_id", "at", "kind", N.DIALOGUE)


@query("""select conv_id, turn, turn // 4 || '' as screen, coalesce(last_value(case role when 'assistant' then 'streaming' when 'system' then 'booting' end ignore nulls) over w, 'idle') as status,
  count(*) filter (role = 'user') over w as user_turns, count(*) filter (role in ('user', 'assistant')) over w as messages from conversations window w as (partition by conv_id, turn // 4 order by turn rows between unbounded preceding and current row)""")
def t04_panel_states(spark: SparkSession, d: str) -> DataFrame:
    """Every four messages are about another screen, with which the panel starts anew; the first message names it."""
    rows = conversations(spark, d).select("conv_id", "turn", F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "start").otherwise("booting").alias("kind"), F.when(F.col("turn") % 4 == 0, F.floor(F.col("turn") / 4).cast("string")).alias("screen"))
    return N.panel_states(rows, "conv_id", "turn", "kind", "screen").select("conv_id", "turn", "screen", "status", "user_turns", "messages")


@query("select user_id, max_by(event_id, (ts, event_id)) as event_id, max_by(substring(props, 1, 80), (ts, event_id)) as preview, true as ok from events group by user_id")
def t11_save_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("o", F.struct("ts", "event_id")).select("user_id", "event_id", F.substring("props", 1, 80).alias("preview"), "o")
    return P.upsert_latest(rows, "user_id", "o").select("user_id", "event_id", "preview", F.lit(True).alias("ok"))


@query("with l as (select conv_id, max(turn) as t from conversations group by 1) select conv_id, turn, role from conversations where conv_id % 7 <> 0 union all select conv_id, t + 1, 'user' from l where conv_id % 2 = 0 and conv_id % 7 <> 0 union all select conv_id, t + 2, 'assistant' from l where conv_id % 2 = 0 and conv_id % 7 <> 0 union all values (1000000, 0, 'user')")
def t12_append_and_delete(spark: SparkSession, d: str) -> DataFrame:
    rows = conversations(spark, d)
    both = rows.where("conv_id % 2 = 0").select("conv_id").distinct().withColumn("m", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))))
    new = both.select("conv_id", F.col("m.turn").cast("long").alias("turn"), "m.role").unionByName(spark.createDataFrame([(1_000_000, 0, "user")], "conv_id long, turn long, role string"))
    grown = P.append_turn(rows, new, "conv_id", "turn")
    return P.without_conversations(grown, rows.where("conv_id % 7 = 0"), "conv_id").select("conv_id", "turn", "role")


@query("select conv_id, turn, role from conversations where conv_id in (select conv_id from conversations where turn = 3)")
def j16_parent_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = conversations(spark, d)
    return P.children(rows.where("turn = 3"), rows.select("conv_id", "turn", "role"), "conv_id", "turn")


@query("select conv_id, turn, r_name as entry, previous, following from conversations left join (select r_regionkey, r_name, lag(r_regionkey) over (order by r_regionkey) as previous, lead(r_regionkey) over (order by r_regionkey) as following from region) on turn = r_regionkey")
def j17_registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("entry"))
    return P.registry_hop(conversations(spark, d), entries, "turn", "r_regionkey").select("conv_id", "turn", "entry", "previous", "following")


@query("select conv_id, turn from conversations where turn % 3 <> 0")
def t13_resumed_batch(spark: SparkSession, d: str) -> DataFrame:
    """A file stream that is run twice over a growing folder: the second run sees only new files."""
    return twins.resumed(conversations(spark, d).select("conv_id", "turn"), "turn % 3 = 0", place(spark, "t13"), "conv_id long, turn long")


# --- plug-ins ---
@query()
def x01_scorer(spark: SparkSession, d: str) -> DataFrame:
    return X.score(table(spark, d, "documents"), "doc_id", "text")


#: Rubrics that are handed in, by category.
RUBRICS = {"JW": "a >= 3 and sc >= 2", "GM": "a + b >= 6", "EH": "c = 5 or den > 4"}


@query(f"with {CHUNKS} select id, work, case work when 'JW' then a >= 3 and sc >= 2 when 'GM' then a + b >= 6 when 'EH' then c = 5 or den > 4 else false end as passed from chunks")
def x05_rubric_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("id", "work", X.gate_by(RUBRICS, "work").alias("passed"))


@query()
def x02_embedder(spark: SparkSession, d: str) -> DataFrame:
    return X.embed(table(spark, d, "benchmark"), "item_id", "text", X.hash_embedder(16))


@query("select conv_id, ['x', 'y', 'z'][1 + count(*) filter (role = 'assistant') % 3] as generated from conversations group by conv_id")
def x03_mock_generator(spark: SparkSession, d: str) -> DataFrame:
    return X.generate_mock(conversations(spark, d), "conv_id", ["x", "y", "z"])


@query("select doc_id, cast(k - 1 as int) as k, 'q' || k as question, 'a' || doc_id as answer from documents, range(1, 4) t(k)")
def x04_expand_samples(spark: SparkSession, d: str) -> DataFrame:
    items = ", ".join(f'{{"question": "q{k}", "answer": "a%"}}' for k in range(1, 6))
    raw = F.replace(F.lit(f"[{items}]"), F.lit("%"), F.col("doc_id").cast("string"))
    return X.expand(table(spark, d, "documents").select("doc_id", raw.alias("raw")), "doc_id", "raw", ["question", "answer"])


# --- sources and sinks ---
@query("select conv_id, turn, role, text from conversations")
def s01_s09_jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "s01")
    jsonl.write(conversations(spark, d), path)
    return jsonl.read_required(spark, path, CONV)


@query("select count(*) filter (turn <> 0) as good, count(*) filter (turn = 0) as broken from conversations")
def s02_tolerant_scan(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "s02")
    rows = conversations(spark, d)
    rows.select(F.when(F.col("turn") == 0, "{broken").otherwise(F.to_json(F.struct(*rows.columns))).alias("value")).write.text(path)
    read = jsonl.read_tolerant(spark, path, CONV)
    bad = F.col(jsonl.BROKEN).isNotNull() & F.col("conv_id").isNull()
    return read.agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("broken"))


@query("select conv_id, turn from conversations where role = 'user'")
def s03_s07_done_keys(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "s03")
    jsonl.write(conversations(spark, d).select("conv_id", F.when(F.col("role") == "user", F.col("turn")).alias("turn")), path)
    missing = jsonl.read_done(spark, path + "-missing", CONV, ["conv_id", "turn"])
    return jsonl.read_done(spark, path, CONV, ["conv_id", "turn"]).unionByName(missing)


@query("select conv_id, turn from conversations")
def s04_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "s04")
    rows = conversations(spark, d)
    rows.select(F.concat(F.to_json(F.struct("conv_id", "turn")), F.lit("\n  \n")).alias("value")).write.text(path)
    return jsonl.read_skipping_blank(spark, path, "conv_id long, turn long")


@query("select role as file, count(*) as n from conversations group by role")
def s05_s11_partitioned_folder(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "s05")
    jsonl.write(conversations(spark, d), path, by=["role"])
    rows = jsonl.read_directory(spark, path, CONV, "*/*.json")
    return rows.groupBy(F.regexp_extract("folder", "role=([^/]*)$", 1).alias("file")).agg(F.count(F.lit(1)).alias("n"))


@query("select conv_id, conv_id % 3 = 0 and conv_id in (select conv_id from conversations) as deleted from (select distinct conv_id * k as conv_id from conversations, range(1, 3) t(k)) where conv_id % 3 = 0")
def t11_slot_delete(spark: SparkSession, d: str) -> DataFrame:
    """Slots of all conversations; those asked for by ids, some of which don't exist, are deleted, and each id learns whether."""
    rows = conversations(spark, d).groupBy("conv_id").agg(F.max_by("text", "turn").alias("preview"))
    slots = keyed.KeyedTable(spark, place(spark, "t11"), "conv_id", "conv_id long, preview string")
    slots.upsert(rows)
    ids = conversations(spark, d).select(F.explode(F.array("conv_id", F.col("conv_id") * 2)).alias("conv_id")).where("conv_id % 3 = 0")
    return slots.delete(ids)


@query("select conv_id, max(turn) as last_turn, count(*) as n_turns, max(turn) + 1 = count(*) as whole from conversations where conv_id % 4 <> 1 group by conv_id")
def s17_t11_migrated_slots(spark: SparkSession, d: str) -> DataFrame:
    """A table of slots that is filled in two upserts, loses some rows, and gets two more columns by migrations."""
    rows = conversations(spark, d).groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"))
    slots = keyed.KeyedTable(spark, place(spark, "s17"), "conv_id", "conv_id long, last_turn long, n long")
    slots.upsert(rows.withColumn("n", F.lit(0)))
    slots.upsert(rows)
    slots.delete(rows.where("conv_id % 4 = 1"))
    slots.migrate([("rename", lambda t: t.withColumnRenamed("n", "n_turns")), ("whole", lambda t: t.withColumn("whole", F.col("last_turn") + 1 == F.col("n_turns")))])
    return slots.rows()


@query("select doc_id, lang from documents order by doc_id limit 50")
def s08_first_rows(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.first_rows(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], 50)


@query("select conv_id, turn from conversations union all select conv_id, turn from conversations where turn = 1")
def s10_s16_append(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "s10")
    rows = conversations(spark, d).select("conv_id", "turn")
    jsonl.append(rows, path)
    jsonl.append(rows.where("turn = 1"), path)
    return jsonl.read_strict(spark, path, "conv_id long, turn long")


@query("""select '[' || string_agg('{"role":"' || role || '","n":' || n || '}', ',' order by role) || ']' as report from (select role, count(*) as n from conversations group by role)""")
def s12_json_report(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.report(conversations(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n")))


@query("select label, count(*) as n from embeddings group by label")
def s14_vector_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    store = tables.VectorTable(spark, place(spark, "s14"), 64)
    store.insert(rows)
    store.clear()
    store.insert(rows.where("vec_id % 2 = 0"))
    store.insert(rows.where("vec_id % 2 <> 0"))
    return store.read().groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("select vec_id, label from embeddings")
def s15_s17_recreated_table(spark: SparkSession, d: str) -> DataFrame:
    name = f"vectors_{uuid.uuid4().hex}"
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    tables.create(spark, name, "vec_id long")
    tables.recreate(rows, name)
    return spark.table(name)


@query("select conv_id, turn, 'Answer briefly. ' || text as prompt from conversations where role = 'user'")
def s18_prompt_constant(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "s18")
    spark.createDataFrame([("Answer briefly. ",)], "value string").coalesce(1).write.text(path)
    prompt = text_file(spark, path)
    return conversations(spark, d).where("role = 'user'").select("conv_id", "turn", F.concat(F.lit(prompt), F.col("text")).alias("prompt"))
