"""Queries of text functions and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import curate as C
from ..operators.split import stratified_split
from .catalog import CHUNKS, RESP, SAMPLES, SQL_SENTENCES, SQL_SQUEEZE, SQL_STRIP, SQL_TRIM, chunks, query, responses, samples, sql_map, table

#: Stand-in phrases: the tables hold no Korean.
PHRASES = ["the (and|of) ", "stupid", "der .*die"]
_FIXED = f"select *, {sql_map('pattern', C.PATTERN_FIXES)} as p2, {sql_map('concept', C.CONCEPT_FIXES)} as c2 from samples"
_IN = lambda col, xs: f"{col} in ({', '.join(map(repr, xs))})"
_ENUM = f"""case when not {_IN("p2", C.PATTERNS)} then 'invalid_pattern:' || p2 when not {_IN("c2", C.CONCEPTS)} then 'invalid_concept:' || c2
  when not {_IN("question", C.QUESTION_TYPES)} then 'invalid_qtype:' || question when not {_IN("difficulty", C.DIFFICULTIES)} then 'invalid_difficulty:' || difficulty end"""
_LENGTH = f"""({SQL_SENTENCES.format("text")} between case difficulty when 'easy' then 1 when 'medium' then 3 when 'hard' then 5 else 1 end
  and case difficulty when 'easy' then 7 when 'medium' then 10 when 'hard' then 14 else 14 end)"""
_GRAMS = "unnest(list_transform(range(1, greatest(length(s) - 13, 1)), lambda i: substring(s, i, 15)))"
_SHARED = f"""bad as (select distinct {_GRAMS} as gram from (select {SQL_SQUEEZE.format(SQL_STRIP.format("text"))} as s from benchmark) where length(s) >= 15),
  shared as (select distinct doc_id from (select doc_id, {_GRAMS} as gram from (select doc_id, {SQL_SQUEEZE.format(SQL_STRIP.format("text"))} as s from documents) where length(s) >= 15) where gram in (select gram from bad))"""
_REASON = f"""fixed as ({_FIXED}), judged as (select f.*, coalesce({_ENUM},
  case when {SQL_TRIM.format("coalesce(text, '')")} = '' then 'empty_assistant' when id in (select doc_id from shared) then 'plagiarism'
  when regexp_matches(text, '{"|".join(f"(?:{p})" for p in PHRASES)}') then 'comfort' when not {_LENGTH} then 'length' end) as reason from fixed f)"""


def fixed_samples(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).withColumn("p2", C.mapped(F.col("pattern"), C.PATTERN_FIXES)).withColumn("c2", C.mapped(F.col("concept"), C.CONCEPT_FIXES))


def judged_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_overlap(fixed_samples(spark, d), table(spark, d, "benchmark"), "id", "text", "text")
    enum = C.enum_reason(F.col("p2"), F.col("c2"), F.col("question"), F.col("difficulty"))
    return rows.withColumn("reason", C.hygiene_reason(enum, F.col("text"), F.col("shares"), F.col("difficulty"), PHRASES))


# --- functions ---
@query(f"select doc_id, length({SQL_STRIP.format('text')}) as n, md5({SQL_STRIP.format('text')}) as h from documents")
def f01_strip_marks(spark: SparkSession, d: str) -> DataFrame:
    s = T.strip_marks(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.char_length(s).cast("long").alias("n"), F.md5(s).alias("h"))


@query(f"select doc_id, md5({SQL_SQUEEZE.format('text')}) as h, md5({SQL_TRIM.format('text')}) as t from documents")
def f02_without_space(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.without_space(F.col("text"))).alias("h"), F.md5(T.trim_all(F.col("text"))).alias("t"))


@query(f"select doc_id, cast({SQL_SENTENCES.format('text')} as int) as sentences from documents")
def f03_sentence_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.sentence_count(F.col("text")).alias("sentences"))


@query("select item_id, cast(len(list_distinct(list_transform(range(1, greatest(length(text) - 13, 1)), lambda i: substring(text, i, 15)))) as int) as n from benchmark")
def f04_char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.size(F.array_distinct(T.ngrams(F.col("text"), 15))).alias("n"))


_JSON = """('note {"q1": ' || doc_id % 7 || ', "q2": "' || doc_id % 4 || '"} end')"""


@query(f"""select doc_id, cast(greatest(1, least(5, coalesce(try_cast(json_extract_string(j, '$.q1') as int), 0))) as int) as q1,
  cast(greatest(1, least(5, coalesce(try_cast(json_extract_string(j, '$.q2') as int), 0))) as int) as q2, 1 as q3,
  coalesce(try_cast(json_extract_string(j, '$.q1') as int) between 1 and 5, false) as ok
  from (select doc_id, regexp_extract({_JSON}, '\\{{[^{{}}]*\\}}') as j from documents)""")
def f05_f08_json_scores(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('note {"q1": '), (F.col("doc_id") % 7).cast("string"), F.lit(', "q2": "'), (F.col("doc_id") % 4).cast("string"), F.lit('"} end'))
    j = table(spark, d, "documents").select("doc_id", F.from_json(T.flat_json(raw), "map<string,string>").alias("j"))
    return j.select("doc_id", *[S.clamp(F.col("j")[k]).alias(k) for k in ("q1", "q2", "q3")], S.valid(F.col("j")["q1"]).alias("ok"))


@query("select doc_id, cast(length(coalesce(text, '')) % 5 + 1 as int) as q1, source as a from documents")
def f06_first_json_value(spark: SparkSession, d: str) -> DataFrame:
    """A reply that quotes the whole text before its JSON, which holds an object of its own and is followed by words."""
    quoted = F.translate(F.coalesce("text", F.lit("")), "{", "(")
    reply = F.concat(quoted, F.to_json(F.struct((F.char_length(F.coalesce("text", F.lit(""))) % 5 + 1).alias("q1"), F.struct(F.col("source").alias("a")).alias("why"))), F.lit(" and more {"))
    return table(spark, d, "documents").select("doc_id", T.json_from_first_brace(reply, "q1 int, why struct<a:string>").alias("j")).select("doc_id", "j.q1", "j.why.a")


@query("select doc_id, k as item, 'v' || doc_id as value from documents, range(1, 4) t(k) where k <> 2 order by all")
def f07_json_items(spark: SparkSession, d: str) -> DataFrame:
    one = lambda k: f'{{"item": "{k}", "value": "v%"}}'
    raw = F.replace(F.lit(f'Here: [ {one(1)}, {{"item": "2"}}, {one(3)} ] done'), F.lit("%"), F.col("doc_id").cast("string"))
    items = table(spark, d, "documents").select("doc_id", F.explode(T.json_items(raw, ["item", "value"])).alias("m"))
    return items.select("doc_id", F.col("m")["item"].cast("long").alias("item"), F.col("m")["value"].alias("value"))


@query("select doc_id, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end as short from documents")
def f09_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 200).alias("short"))


@query(f"with {RESP} select sample_id, split_part(collapse_reason, '=', 1) as kind from resp")
def f10_reason_keyword(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("sample_id", T.before(F.col("collapse_reason"), "=").alias("kind"))


COLLAPSE_SQL = """chars as (select doc_id, pos, substring(text, pos, 1) as c from (select doc_id, text, unnest(range(1, length(text) + 1)) as pos from documents)),
  runs as (select doc_id, max(n) as run from (select doc_id, count(*) as n from (select doc_id, c, pos - row_number() over (partition by doc_id, c order by pos) as g from chars) group by doc_id, c, g) group by doc_id),
  kinds as (select doc_id, count(distinct c) / count(*) as diversity from chars group by doc_id),
  grams as (select doc_id, len(list_distinct(g)) / len(g) as distinct_share from (select doc_id, list_transform(range(1, length(text) - 8), lambda i: substring(text, i, 10)) as g from documents where length(text) >= 50)),
  collapse as (select d.doc_id, case when coalesce(length(text), 0) = 0 then 'empty' when run >= 30 then 'max_run' when diversity < 0.05 then 'char_diversity'
    when distinct_share < 0.15 then 'ngram_distinct' when length(text) >= 3000 and diversity < 0.15 then 'long_low_diversity' end as reason
    from documents d left join runs using (doc_id) left join kinds using (doc_id) left join grams using (doc_id))"""


@query(f"with {COLLAPSE_SQL} select doc_id, reason from collapse")
def f11_degenerate_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.collapse_reason(F.col("text")).alias("reason"))


@query(f"""select doc_id, unnest([{SQL_TRIM.format("'~' || split_part(text, ' ', 1)[1:10]")}, '~end']) as ending from documents where text is not null""")
def f12_quoted_endings(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring(F.split_part("text", F.lit(" "), F.lit(1)), 1, 10)
    reason = F.concat(F.lit("ends on '~"), first, F.lit("' and \"~end\" but not '~far too long to be an ending'"))
    return table(spark, d, "documents").select("doc_id", F.explode(T.quoted_endings(reason)).alias("ending"))


@query("""select conv_id, turn, regexp_replace(split_part(text, chr(10), 1), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as q from conversations""")
def f13_clean_rewrite(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('  Rewritten query: "'), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit('"\nsecond line'))
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean_rewrite(raw).alias("q"))


@query("select vec_id, '[' || row_number() over (order by vec_id) || '] (' || case when label % 2 = 0 then 'Original' else 'Commentary' end || ' / ' || vec_id || ')' || chr(10) || label as snippet from embeddings")
def f17_snippets(spark: SparkSession, d: str) -> DataFrame:
    ranked = C.numbered(table(spark, d, "embeddings"), ["vec_id"], out="rank")
    label = F.when(F.col("label") % 2 == 0, "Original").otherwise("Commentary")
    return ranked.select("vec_id", T.snippet(F.col("rank"), label, F.col("vec_id").cast("string"), F.col("label").cast("string")).alias("snippet"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, cast(epoch_us(ts) // 1000 as bigint) as ms from events")
def f26_timestamps(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_millis(ts).alias("ms"))


def dialogues(spark: SparkSession, d: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("messages"))


@query("select conv_id, cast(count(*) as int) as n, min_by(text, turn) as head from conversations group by conv_id")
def f27_json_messages(spark: SparkSession, d: str) -> DataFrame:
    packed = dialogues(spark, d).select("conv_id", F.to_json("messages").alias("j"))
    back = packed.select("conv_id", F.from_json("j", "array<struct<turn:long,role:string,content:string>>").alias("m"))
    return back.select("conv_id", F.size("m").alias("n"), F.get("m", F.lit(0))["content"].alias("head"))


@query("select conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' order by turn)) as h from conversations group by conv_id")
def f28_chat_template(spark: SparkSession, d: str) -> DataFrame:
    return dialogues(spark, d).select("conv_id", F.md5(T.chat_template(F.col("messages"))).alias("h"))


# --- projections and predicates ---
@query(f"with {SAMPLES}, fixed as ({_FIXED}) select id, p2, c2 from fixed")
def p01_enum_repair(spark: SparkSession, d: str) -> DataFrame:
    return fixed_samples(spark, d).select("id", "p2", "c2")


@query(f"with {SAMPLES}, fixed as ({_FIXED}) select id, {_ENUM} as reason from fixed")
def p02_enum_domain(spark: SparkSession, d: str) -> DataFrame:
    return fixed_samples(spark, d).select("id", C.enum_reason(F.col("p2"), F.col("c2"), F.col("question"), F.col("difficulty")).alias("reason"))


@query(f"with {SAMPLES}, {_SHARED}, {_REASON} select id, reason from judged")
def p03_hygiene_cascade(spark: SparkSession, d: str) -> DataFrame:
    return judged_samples(spark, d).select("id", "reason")


@query("select conv_id, coalesce(min_by(text, turn) filter (role = 'assistant'), '') as first_answer, coalesce(max_by(text, turn) filter (role = 'user'), '') as last_question from conversations group by conv_id")
def p04_p05_message_by_role(spark: SparkSession, d: str) -> DataFrame:
    return dialogues(spark, d).select("conv_id", T.first_of(F.col("messages"), "assistant").alias("first_answer"), T.last_of(F.col("messages"), "user").alias("last_question"))


@query(f"select doc_id, regexp_matches(text, '{'|'.join(f'(?:{p})' for p in PHRASES)}') as found from documents")
def p06_phrases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.any_phrase(F.col("text"), PHRASES).alias("found"))


@query(f"with {SAMPLES} select id, {_LENGTH} as ok from samples")
def p07_length_gate(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("id", T.length_ok(F.col("text"), F.col("difficulty")).alias("ok"))


@query(f"with {_SHARED} select doc_id from shared")
def p08_j03_ngram_overlap(spark: SparkSession, d: str) -> DataFrame:
    return C.overlapping(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "text")


_GATE = f"case work {' '.join(f'when {w!r} then ({g})' for w, g in C.GATES.items())} else false end"


@query(f"with {CHUNKS} select id, {_GATE} as passed from chunks")
def p09_rubric_gate(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("id", C.gate().alias("passed"))


@query(f"""with {CHUNKS} select id, case work when 'JW' then 'JW fail (A=' || a || ',B=' || b || ',sc=' || sc || ',den=' || den || ')'
  when 'BGE' then 'BGE fail (B=' || b || ',sc=' || sc || ',den=' || den || ')' when 'GM' then 'GM fail (B=' || b || ',sc=' || sc || ',den=' || den || ')'
  when 'TI' then 'TI Ch' || ch || ' fail (A=' || a || ',B=' || b || ',sc=' || sc || ',den=' || den || ')' when 'EH' then 'EH fail (B=' || b || ',C=' || c || ',sc=' || sc || ')' end as reason
  from chunks where not {_GATE}""")
def p09_reject_reason(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where(~C.gate()).select("id", C.gate_reason().alias("reason"))


@query(f"""with {CHUNKS} select id, case when {_GATE} then case when a >= 3 and b >= 3 and c >= 3 then 'all' when a >= 3 and b >= 3 then 'existential+philosophical'
  when b >= 3 and c >= 3 then 'philosophical+biographical' when a >= 3 and c >= 3 then 'existential+biographical' when a >= 3 then 'existential' when b >= 3 then 'philosophical' when c >= 3 then 'biographical' end end as use_case from chunks""")
def p10_use_case(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("id", F.when(C.gate(), C.use_case(F.col("a") >= 3, F.col("b") >= 3, F.col("c") >= 3)).alias("use_case"))


@query(f"with {RESP} select sample_id, round(score, 6) as score, grade from resp")
def p11_grade(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("sample_id", F.round("score", 6).alias("score"), "grade")


@query(f"with {RESP} select sample_id, grade from resp where grade in ('A', 'B')")
def p12_grade_filter(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).where(F.col("grade").isin("A", "B")).select("sample_id", "grade")


@query(f"with {RESP} select sample_id, model_tag from resp where model_tag in ('m1', 'm3') and not collapsed and q1 is not null")
def p13_row_filters(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).where(F.col("model_tag").isin("m1", "m3") & ~F.col("collapsed") & F.col("q1").isNotNull()).select("sample_id", "model_tag")


_UC = "case id % 3 when 0 then 'existential' when 1 then 'philosophical' else 'unknown' end"


@query(f"""with {CHUNKS} select id, case work {" ".join(f"when {k!r} then {v!r}" for k, v in C.VOICES.items())} end as voice,
  case work {" ".join(f"when {k!r} then {v!r}" for k, v in C.PERIODS.items())} end as period,
  unnest(case {_UC} when 'existential' then {C.USE_CASE_PATTERNS["existential"]} when 'philosophical' then {C.USE_CASE_PATTERNS["philosophical"]} else [] end) as allowed from chunks""")
def p14_constants(spark: SparkSession, d: str) -> DataFrame:
    known = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    case = F.when(F.col("id") % 3 == 0, "existential").when(F.col("id") % 3 == 1, "philosophical").otherwise("unknown")
    lists = F.create_map(*[x for k, v in C.USE_CASE_PATTERNS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = chunks(spark, d).select("id", known(C.VOICES)[F.col("work")].alias("voice"), known(C.PERIODS)[F.col("work")].alias("period"), lists[case].alias("xs"))
    return rows.select("id", "voice", "period", F.explode("xs").alias("allowed"))


@query(f"""with {CHUNKS} select id, case work when 'GM' then 'GM_e' || ch || '_s' || number when 'TI' then 'TI_c' || ch || '_s' || number
  when 'EH' then case when sub <> 0 then 'EH_c' || ch || '_sub' || sub || '_s' || number else 'EH_c' || ch || '_s' || number end
  when 'BGE' then 'BGE_p' || ch || '_s' || number else 'JW_s' || number end as ref from chunks""")
def p15_source_ref(spark: SparkSession, d: str) -> DataFrame:
    ch = F.col("ch")
    return chunks(spark, d).select("id", C.source_ref(F.col("work"), ch, ch, F.col("sub"), ch, F.col("number")).alias("ref"))


@query(f"with {CHUNKS} select id, split_part(work || '_s' || number, '_', 1) as family from chunks")
def p16_source_family(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("id", T.before(F.concat("work", F.lit("_s"), F.col("number").cast("string")), "_").alias("family"))


@query("select doc_id, coalesce(nullif(case when doc_id % 2 = 0 then '' else lang end, ''), nullif(source, ''), '') as name from documents")
def p17_first_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.first_text(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.col("source")).alias("name"))


@query(f"with {CHUNKS} select id, work, ch, sub, number, a, b, c, sc, den, n_chars, n_chars * 2 as ko_char_count, 'ok' as status from chunks")
def p18_p19_extend_and_drop(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).withColumns({"ko_char_count": F.col("n_chars") * 2, "status": F.lit("ok")}).drop("text")


@query("""select conv_id, 'History:' || chr(10) || string_agg(case role when 'user' then 'User: ' else 'Guide: ' end || text, chr(10) order by turn) || chr(10) || '  - clear' || chr(10) || '  - short' as prompt from conversations group by conv_id""")
def p20_prompt(spark: SparkSession, d: str) -> DataFrame:
    line = lambda m: F.concat(F.when(m["role"] == "user", "User: ").otherwise("Guide: "), m["content"])
    checks = F.array_join(F.transform(F.array(F.lit("clear"), F.lit("short")), lambda c: F.concat(F.lit("  - "), c)), "\n")
    return dialogues(spark, d).select("conv_id", F.concat(F.lit("History:\n"), F.array_join(F.transform("messages", line), "\n"), F.lit("\n"), checks).alias("prompt"))


@query("""select doc_id, axis, case when length(t) > 200 then substring(t, 1, 200) || '...' else t end as shown from
  (select doc_id, 1 as axis, text as t from documents union all select doc_id, 2, source from documents union all select doc_id, 3, lang from documents)
  where contains(t, 'en') order by doc_id, axis limit 50""")
def p21_o04_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    axes = F.array(*[F.struct(F.lit(k).alias("axis"), F.col(c).alias("t")) for k, c in ((1, "text"), (2, "source"), (3, "lang"))])
    rows = table(spark, d, "documents").select("doc_id", F.explode(axes).alias("x")).select("doc_id", "x.axis", "x.t")
    return rows.where(F.contains("t", F.lit("en"))).orderBy("doc_id", "axis").limit(50).select("doc_id", "axis", T.truncate(F.col("t"), 200).alias("shown"))


_RATIO = "case when coalesce(b.n, 0) = 0 then 'none' when d.n_chars / b.n < 0.7 then 'shorter' when d.n_chars / b.n > 1.3 then 'longer' else 'same' end"


@query(f"select d.doc_id, {_RATIO} as bucket from documents d left join (select item_id, length(text) as n from benchmark) b on d.doc_id = b.item_id")
def p22_j06_length_ratio(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.char_length("text").alias("n"))
    n, r = F.coalesce("n", F.lit(0)), F.try_divide("n_chars", "n")
    bucket = F.when(n == 0, "none").when(r < 0.7, "shorter").when(r > 1.3, "longer").otherwise("same")
    return table(spark, d, "documents").join(base, "doc_id", "left").select("doc_id", bucket.alias("bucket"))


@query("select conv_id, turn, case when coalesce(text, '') = '' then 'empty' when length(text) > 500 then 'too_long' when role not in ('user', 'assistant') then 'role' end as reject from conversations")
def p23_input_validation(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    reject = F.when(t == "", "empty").when(F.char_length(t) > 500, "too_long").when(~F.col("role").isin("user", "assistant"), "role")
    return table(spark, d, "conversations").select("conv_id", "turn", reject.alias("reject"))


@query("select conv_id, string_agg(case when turn % 3 = 2 then '...' else text end, '|' order by turn) as history from conversations where turn % 4 <> 3 group by conv_id")
def p25_history_projection(spark: SparkSession, d: str) -> DataFrame:
    live = F.filter("messages", lambda m: m["turn"] % 4 != 3)  # rows that still stream
    shown = F.transform(live, lambda m: F.when(m["turn"] % 3 == 2, "...").otherwise(m["content"]))
    return dialogues(spark, d).where(F.size(live) > 0).select("conv_id", F.array_join(shown, "|").alias("history"))


@query("select conv_id, turn, case turn % 4 when 0 then 'OUT_OF_DOMAIN' when 1 then 'AMBIGUOUS' else 'COMMENTARY' end as intent from conversations")
def p26_intent(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("turn") % 4 == 0, " out_of_domain\nbecause").when(F.col("turn") % 4 == 1, "Ambiguous: x").when(F.col("turn") % 4 == 2, "COMMENTARY").otherwise("no idea")
    return table(spark, d, "conversations").select("conv_id", "turn", T.intent(raw).alias("intent"))


# --- curation aggregates, joins and windows ---
@query(f"with {SAMPLES}, {_SHARED}, {_REASON} select coalesce(split_part(reason, ':', 1), 'kept') as reason, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from judged group by 1")
def a01_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = judged_samples(spark, d).groupBy(F.coalesce(T.before(F.col("reason"), ":"), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("total"))  # a row for each reason: small
    return rows.crossJoin(total).select("reason", "n", F.round(S.percent(F.col("n"), F.col("total")), 6).alias("pct"))


@query(f"with {SAMPLES}, fixed as ({_FIXED}) select 'pattern' as kind, pattern as value, count(*) as n from fixed where pattern <> p2 group by 2 union all select 'concept', concept, count(*) from fixed where concept <> c2 group by 2")
def a02_fix_log(spark: SparkSession, d: str) -> DataFrame:
    rows = fixed_samples(spark, d)
    one = lambda kind, a, b: rows.where(F.col(a) != F.col(b)).groupBy(F.lit(kind).alias("kind"), F.col(a).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return one("pattern", "pattern", "p2").unionByName(one("concept", "concept", "c2"))


_AXES = ("pattern", "concept", "question", "difficulty", "lang", "source")


@query(f"with {SAMPLES} " + " union all ".join(f"select '{a}' as axis, {a} as value, count(*) as n from samples group by {a}" for a in _AXES))
def a03_distributions(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in _AXES]))
    return samples(spark, d).select(pairs.alias("p")).groupBy("p.axis", "p.value").agg(F.count(F.lit(1)).alias("n")).orderBy("axis", F.desc("n"), "value")


@query(f"with {CHUNKS}, refs as (select *, case when work = 'GM' then 'GM_' || number else 'O_' || number end as ref from chunks), last as (select ref, max_by(n_chars, id) as n from refs group by ref) select c.doc_id as id, coalesce(cast(l.n as varchar), '') as found from documents c left join last l on l.ref = 'GM_' || (c.doc_id % 200)")
def j01_lookup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    refs = chunks(spark, d).withColumn("ref", F.concat(F.when(F.col("work") == "GM", "GM_").otherwise("O_"), F.col("number").cast("string"))).withColumn("v", F.col("n_chars").cast("string"))
    left = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("GM_"), (F.col("doc_id") % 200).cast("string")).alias("key"))
    return C.lookup_last(left, "key", refs, "ref", "v", "id", "found").select("id", "found")


_SPLIT = """ranked as (select *, count(*) over s as n, row_number() over (partition by voice, pattern, difficulty order by score, sample_id) as r from good window s as (partition by voice, pattern, difficulty)),
  parted as (select sample_id, voice, pattern, difficulty, grade, case when n >= 5 and r <= greatest(1, cast(round_even(n * 0.05, 0) as int)) then 'eval' else 'train' end as split from ranked)"""
_GOOD = f"with {RESP}, good as (select * from resp where q1 is not null), {_SPLIT}"


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    return stratified_split(responses(spark, d).where("q1 is not null"), ["voice", "pattern", "difficulty"], "score", "sample_id")


@query(f"{_GOOD} select sample_id, split from parted")
def w03_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return split_rows(spark, d).select("sample_id", "split")


@query(f"{_GOOD} select split, count(*) as n, count(distinct voice || pattern || difficulty) as strata from parted group by split")
def w03_split_report(spark: SparkSession, d: str) -> DataFrame:
    return split_rows(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.concat("voice", "pattern", "difficulty")).alias("strata"))


@query("select doc_id, 'sft_' || lpad(cast(row_number() over (order by doc_id) + 100 as varchar), 6, '0') as id from documents")
def w08_sequential_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = C.numbered(table(spark, d, "documents").select("doc_id"), ["doc_id"], start=101)
    return rows.select("doc_id", F.concat(F.lit("sft_"), F.lpad(F.col("ordinal").cast("string"), 6, "0")).alias("id"))


@query("select d.doc_id from documents d where d.doc_id not in (select doc_id from labels) order by doc_id limit 25")
def j04_o02_remaining_with_limit(spark: SparkSession, d: str) -> DataFrame:
    return C.remaining(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"]).orderBy("doc_id").limit(25)


_KEYS = "select id, work, case when sub = 0 then null else sub end as sub, case when ch > 9 then null else ch end as ch, number from chunks"


@query(f"with {CHUNKS}, k as ({_KEYS}) select id from k where not exists (select 1 from k j where j.id % 3 = 0 and j.work = k.work and j.sub is not distinct from k.sub and j.ch is not distinct from k.ch and j.number = k.number)")
def j05_null_safe_resume(spark: SparkSession, d: str) -> DataFrame:
    k = chunks(spark, d).select("id", "work", F.nullif("sub", F.lit(0)).alias("sub"), F.when(F.col("ch") <= 9, F.col("ch")).alias("ch"), "number")
    return C.remaining(k, k.where("id % 3 = 0"), ["work", "sub", "ch", "number"], null_safe=True).select("id")


@query(f"with {COLLAPSE_SQL}, r as (select coalesce(reason, 'fine') as reason, {SQL_SENTENCES.format('text')} as s from collapse join documents using (doc_id)) select reason, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct, cast(sum(s) as bigint) as sentences from r group by reason")
def corpus_hygiene_report(spark: SparkSession, d: str) -> DataFrame:
    """Degenerate-text reasons of the corpus with counts, shares and sentences."""
    docs = table(spark, d, "documents").select(F.coalesce(T.collapse_reason(F.col("text")), F.lit("fine")).alias("reason"), T.sentence_count(F.col("text")).alias("s"))
    rows = docs.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("sentences"))
    return rows.crossJoin(rows.agg(F.sum("n").alias("total"))).select("reason", "n", F.round(S.percent(F.col("n"), F.col("total")), 6).alias("pct"), "sentences")
