"""Queries of evaluation analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from .catalog import CHUNKS, MODELS, RESP, chunks, query, responses, table


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Rounded for comparison, without negative zeros."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


@query(f"with {RESP} select model_tag, count(*) as n, round(avg(t), 6) as avg_tokens, min(t) as min_tokens, max(t) as max_tokens, round(avg(generated_len), 6) as avg_chars, count(*) filter (t >= 768) as cut, count(*) filter (gen_tokens is null) as estimated, round(100.0 * count(*) filter (t >= 768) / count(*), 6) as cut_pct from (select *, coalesce(gen_tokens, generated_len // 3) as t from resp) group by model_tag")
def a06_a07_token_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.token_stats(responses(spark, d)), "avg_tokens", "avg_chars", "cut_pct")


def _pivot_sql(by: str, value: str) -> str:
    return f"with {RESP} select {by}, {', '.join(f'round(avg({value}) filter (model_tag = {m!r}), 6) as {m}' for m in MODELS)} from resp group by {by}"


@query(_pivot_sql("pattern", "coalesce(gen_tokens, generated_len // 3)"))
def a08_pattern_tokens(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.pivot_mean(responses(spark, d), "pattern", MODELS, E.tokens()), *MODELS)


@query(_pivot_sql("difficulty", "coalesce(gen_tokens, generated_len // 3)"))
def a08_difficulty_tokens(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.pivot_mean(responses(spark, d), "difficulty", MODELS, E.tokens()), *MODELS)


@query(f"with {RESP}, s as (select model_tag, avg(coalesce(gen_tokens, generated_len // 3)) as a, 100.0 * count(*) filter (coalesce(gen_tokens, generated_len // 3) >= 768) / count(*) as p from resp group by 1) select model_tag, cast(floor(a / max(a) over () * 60) as int) as bar, p >= 10 as flag from s")
def a09_bars(spark: SparkSession, d: str) -> DataFrame:
    return E.bars(E.token_stats(responses(spark, d)), "avg_tokens").select("model_tag", "bar", "flag")


@query(f"with {RESP}, s as (select model_tag, avg(score) as mean from resp group by 1) select model_tag, round(mean, 6) as mean, round(100.0 * (mean - b) / b, 6) + 0.0 as change_pct from s, (select mean as b from s where model_tag = 'm0')")
def a10_change_against_baseline(spark: SparkSession, d: str) -> DataFrame:
    stats = responses(spark, d).groupBy("model_tag").agg(F.avg("score").alias("mean"))
    return rounded(E.against_baseline(stats, "mean", "m0"), "mean", "change_pct")


@query("select 'documents' as name, count(*) as n, count(*) = 973 as expected from documents")
def a11_row_count_check(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, d, "documents").agg(n.alias("n"), (n == 973).alias("expected")).select(F.lit("documents").alias("name"), "n", "expected")


_STATS = "count(*) as n, round(coalesce(avg(score), 0.0), 6) as mean, round(coalesce(median(score), 0.0), 6) as median, round(coalesce(stddev_samp(score), 0.0), 6) as stdev"
_OVERALL = f"select model_tag, {_STATS}, {', '.join(f'round(avg({q}), 6) as {q}_mean' for q in E.AXES)}, count(*) filter (collapsed) as collapsed, {', '.join(f'count(*) filter (grade = {g!r}) as grade_{g.lower()}' for g in 'ABCF')} from resp group by model_tag"


@query(f"with {RESP} {_OVERALL}")
def a12_a13_overall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.overall(responses(spark, d)), "mean", "median", "stdev", *[f"{q}_mean" for q in E.AXES])


@query(f"with {RESP}, o as (select model_tag, avg(score) as mean, avg(q3) as q3_mean from resp group by 1) select model_tag, round(mean, 6) as mean, round(q3_mean, 6) as q3_mean from o order by mean desc, q3_mean desc nulls last, model_tag limit 1")
def a14_best_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.best_model(E.overall(responses(spark, d)), MODELS), "mean", "q3_mean")


@query(f"with {RESP} select voice, {', '.join(f'round(avg(score) filter (model_tag = {m!r}), 6) as {m}, count(*) filter (model_tag = {m!r}) as n_{m}' for m in MODELS)} from resp group by voice")
def a15_voice_by_model(spark: SparkSession, d: str) -> DataFrame:
    rows = responses(spark, d)
    means = [F.round(F.avg(F.when(F.col("model_tag") == m, F.col("score"))), 6).alias(m) for m in MODELS]
    return rows.groupBy("voice").agg(*means, *[F.count_if(F.col("model_tag") == m).alias(f"n_{m}") for m in MODELS])


@query(_pivot_sql("pattern", "q1"))
def a16_pattern_q1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.pivot_mean(responses(spark, d), "pattern", MODELS, F.col("q1")), *MODELS)


@query(f"""with {RESP}, k as (select model_tag, split_part(collapse_reason, '=', 1) as k, count(*) as c from resp where collapsed group by all),
  t as (select *, row_number() over (partition by model_tag order by c desc, k) as r from k),
  j as (select model_tag, string_agg(k || '(' || c || ')', ', ' order by r) as reasons from t where r <= 3 group by 1)
  select m.model_tag, n, collapsed, median_len, max_len, reasons, round(collapsed / n, 6) as ratio from
  (select model_tag, count(*) as n, count(*) filter (collapsed) as collapsed, median(generated_len) filter (collapsed) as median_len, max(generated_len) filter (collapsed) as max_len from resp group by 1) m left join j using (model_tag)""")
def a17_collapse_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.collapse_summary(responses(spark, d)), "ratio")


@query(f"with {RESP} select model_tag, round(avg(generated_len), 6) as mean, median(generated_len) as median, max(generated_len) as max, round(coalesce(avg(generated_len) filter (not collapsed), 0.0), 6) as mean_fine from resp group by 1")
def a18_length_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.length_stats(responses(spark, d)), "mean", "mean_fine")


@query(f"with {RESP} select model_tag, round(avg(score), 6) as mean, round(avg(score) - 0.25, 6) + 0.0 as delta, case when avg(score) - 0.25 > 0 then '+' when avg(score) - 0.25 < 0 then '-' else '=' end as sign from resp group by 1")
def a19_delta_to_reference(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.against_reference(E.overall(responses(spark, d)), 0.25), "mean", "delta")


@query(f"with {RESP} select voice, count(*) as n, count(*) filter (q3 <= 2) as low, round(avg(q3), 6) as avg_q3, round(count(*) filter (q3 <= 2) / count(*), 6) as rate from resp where q1 is not null and not collapsed and model_tag in ('m1', 'm2', 'm3') group by voice")
def a20_voice_defect(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.voice_defect(responses(spark, d), ["m1", "m2", "m3"]), "avg_q3", "rate")


@query(f"with {RESP}, e as (select regexp_replace('~' || split_part(generated, ' ', 1)[1:12], '[\\s\\p{{Z}}]+$', '') as ending, count(*) as n from resp group by 1) select ending, n, cast(row_number() over (order by n desc, ending) as int) as rank from e order by n desc, ending limit 20")
def a21_w06_ending_top(spark: SparkSession, d: str) -> DataFrame:
    reason = F.concat(F.lit("it ends with '~"), F.substring(F.split_part("generated", F.lit(" "), F.lit(1)), 1, 12), F.lit("'."))
    return E.ending_top(responses(spark, d), reason, 20)


def other_run(spark: SparkSession, d: str) -> DataFrame:
    """A second judging run: two thirds of the rows, some scores lower."""
    rows = responses(spark, d).where("sample_id % 3 <> 1 and model_tag <> 'm5'")
    return rows.withColumn("score", F.when(F.col("sample_id") % 4 == 0, F.col("score") * 0.9).otherwise(F.col("score")))


_OTHER = "other as (select * replace (case when sample_id % 4 = 0 then score * 0.9 else score end as score) from resp where sample_id % 3 <> 1 and model_tag <> 'm5')"


@query(f"with {RESP}, {_OTHER}, a as (select model_tag, count(*) as n, avg(score) as m from resp group by 1), b as (select model_tag, count(*) as n, avg(score) as m from other group by 1) select model_tag, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b, round(coalesce(a.m, 0.0), 6) as mean_a, round(coalesce(b.m, 0.0), 6) as mean_b, round(coalesce(b.m, 0.0) - coalesce(a.m, 0.0), 6) + 0.0 as delta from a full join b using (model_tag)")
def a22_j08_u04_compare_modes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.compare_modes(responses(spark, d), other_run(spark, d)), "mean_a", "mean_b", "delta")


@query(f"with {RESP} " + " union all ".join(f"select model_tag, '{q}' as axis, count(*) as n, round(avg({q}), 6) as mean, {', '.join(f'count(*) filter ({q} = {k}) as n{k}' for k in range(1, 6))} from resp where q1 is not null group by 1" for q in E.AXES))
def a23_q_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.q_distribution(responses(spark, d)), "mean")


@query(f"with {RESP} select pattern, round(avg(score) filter (model_tag = 'm0'), 6) as m0, round(avg(score) filter (model_tag = 'm1'), 6) as m1, round(avg(score) filter (model_tag = 'm1') - avg(score) filter (model_tag = 'm0'), 6) + 0.0 as delta from resp group by pattern")
def a24_pattern_defect(spark: SparkSession, d: str) -> DataFrame:
    means = E.pivot_mean(responses(spark, d), "pattern", ["m0", "m1"], F.col("score"))
    return rounded(means.withColumn("delta", F.col("m1") - F.col("m0")), "m0", "m1", "delta")


@query(f"with {RESP} select model_tag, count(*) as n, round(case when stddev_samp(generated_len) * stddev_samp(score) > 0 then covar_pop(generated_len, score) / (stddev_samp(generated_len) * stddev_samp(score)) else 0.0 end, 6) as r from resp where q1 is not null and not collapsed group by 1 having count(*) >= 2")
def a25_length_vs_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.length_vs_score(responses(spark, d)), "r")


@query(f"with {RESP}, {_OTHER}, p as (select model_tag, b.score - a.score as delta from resp a join other b using (sample_id, model_tag)) select model_tag, count(*) as n, count(*) filter (abs(delta) < 0.001) as same, round(avg(delta), 6) + 0.0 as mean_delta, round(avg(abs(delta)), 6) as mean_abs, round(max(abs(delta)), 6) as max_abs, round(count(*) filter (abs(delta) < 0.001) / count(*), 6) as rate from p group by 1")
def a26_j07_agreement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.agreement(responses(spark, d), other_run(spark, d)), "mean_delta", "mean_abs", "max_abs", "rate")


_LANGS = ["en", "fr", "de", "es"]


@query(f"with {RESP} select pattern, {', '.join(f'round(avg(score) filter (voice = {v!r}), 6) as {v}_mean, count(score) filter (voice = {v!r}) as {v}_n' for v in _LANGS)} from resp where model_tag = 'm1' group by pattern")
def a27_voice_pattern_cross(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.cross(responses(spark, d), "m1", "pattern", "voice", _LANGS), *[f"{v}_mean" for v in _LANGS])


@query(f"with {CHUNKS} select work, cast(floor(avg(n_chars)) as bigint) as mean, min(n_chars) as low, max(n_chars) as high, count(*) filter (n_chars < 100) as short, count(*) filter (trim(text) = '') as empty from chunks group by work")
def a28_chunk_lengths(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return chunks(spark, d).groupBy("work").agg(F.floor(F.avg(n)).alias("mean"), F.min(n).alias("low"), F.max(n).alias("high"), F.count_if(n < 100).alias("short"), F.count_if(F.trim("text") == "").alias("empty"))


@query("select md5(substring(text, 1, 200)) as prefix, count(*) as n from documents group by substring(text, 1, 200) having count(*) > 1")
def a29_prefix_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.md5(F.substring("text", 1, 200)).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"with {CHUNKS} select work, count(*) - count(distinct number) as duplicates from chunks group by work")
def a30_distinct_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("work").agg((F.count(F.lit(1)) - F.count_distinct("number")).alias("duplicates"))


@query(f"with {CHUNKS}, r as (select work, min(number) as lo, max(number) as hi from chunks where number % 7 <> 3 group by work) select work, cast(k as int) as number from r, lateral (select unnest(range(lo, hi + 1)) as k) where (work, k) not in (select (work, number) from chunks where number % 7 <> 3)")
def a31_u03_missing_numbers(spark: SparkSession, d: str) -> DataFrame:
    have = chunks(spark, d).where("number % 7 <> 3").select("work", "number")
    wanted = have.groupBy("work").agg(F.min("number").alias("lo"), F.max("number").alias("hi")).select("work", F.explode(F.sequence("lo", "hi")).alias("number"))
    return wanted.join(have.distinct(), ["work", "number"], "left_anti")


@query(f"with {CHUNKS}, c as (select *, case when ch = 12 then null else ch end as chapter from chunks) select chapter, count(*) as n, count(distinct sub) as subs from c group by chapter order by chapter nulls last")
def a32_o06_chapters(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).withColumn("chapter", F.nullif("ch", F.lit(12)))
    return rows.groupBy("chapter").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sub").alias("subs")).orderBy(F.asc_nulls_last("chapter"))


@query("select label, count(*) as n from embeddings group by label")
def a33_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("select conv_id, count(*) filter (role = 'assistant') as answers, ['a', 'b', 'c'][1 + count(*) filter (role = 'assistant') % 3] as pick from conversations group by conv_id")
def a35_modulo_pick(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_if(F.col("role") == "assistant")
    return table(spark, d, "conversations").groupBy("conv_id").agg(n.alias("answers")).withColumn("pick", F.get(F.array(*map(F.lit, "abc")), (F.col("answers") % 3).cast("int")))


@query("select conv_id, md5(string_agg(text, chr(10) order by turn)) as h from conversations group by conv_id")
def a36_ordered_text(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(parts, "\n")).alias("h"))


@query(f"with {RESP} select pattern, difficulty, count(*) as n from resp group by cube (pattern, difficulty)")
def a37_cross_totals(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).cube("pattern", "difficulty").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {RESP}, e as (select voice, case when regexp_matches(generated, '[.]$') then 'period' when regexp_matches(generated, '[!?]$') then 'mark' else 'other' end as style from resp) select voice, style, n, round(100.0 * n / sum(n) over (partition by voice), 6) as pct from (select voice, style, count(*) as n from e group by all)")
def a38_ending_styles(spark: SparkSession, d: str) -> DataFrame:
    style = F.when(F.col("generated").rlike(r"[.]\z"), "period").when(F.col("generated").rlike(r"[!?]\z"), "mark").otherwise("other")
    counts = responses(spark, d).groupBy("voice", style.alias("style")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("voice").agg(F.sum("n").alias("t"))
    return counts.join(total, "voice").select("voice", "style", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("pct"))


@query("select source, count(distinct lang) = 1 as single from documents group by source")
def a39_single_voice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg((F.count_distinct("lang") == 1).alias("single"))


@query(f"with {CHUNKS} select work, count(*) as n from chunks group by rollup (work)")
def a40_counts_and_total(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).rollup("work").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {RESP} select grade, count(*) as n, round(avg(score), 6) as mean, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from resp group by grade")
def a04_by_grade(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.by_grade(responses(spark, d)), "mean", "pct")


@query(f"with {RESP} select round(avg(q1), 6) as q1, round(avg(q2), 6) as q2, round(avg(q3), 6) as q3 from resp where q1 is not null")
def a05_axis_means(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).where("q1 is not null").agg(*[F.round(F.avg(q), 6).alias(q) for q in E.AXES])


@query(f"with {RESP} select r.sample_id, case when m.doc_id is null then 'eval_meta_missing' end as error, round(case when m.doc_id is null then 0.0 else r.score end, 6) as score, case when m.doc_id is null then 'F' else r.grade end as grade from resp r left join (select distinct doc_id from labels where doc_id % 5 <> 0) m on r.sample_id = m.doc_id")
def j02_metadata_join(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "labels").where("doc_id % 5 <> 0").select("doc_id").distinct()
    return E.with_metadata(responses(spark, d), meta, "sample_id", "doc_id").select("sample_id", "error", F.round("score", 6).alias("score"), "grade")


@query(f"with {RESP} select a.sample_id, a.model_tag, a.grade, substring(b.generated, 1, 300) as shown from resp a left join (select * from resp where sample_id % 2 = 0) b using (sample_id, model_tag) where a.grade = 'C'")
def j09_deep_dive(spark: SparkSession, d: str) -> DataFrame:
    rows = responses(spark, d)
    return E.deep_dive(rows, rows.where("sample_id % 2 = 0"), F.col("grade") == "C")


_BW = "select model_tag, '{0}' as side, cast(r as int) as r, sample_id, round(score, 6) as score, substring(generated, 1, 120) as shown from (select *, row_number() over (partition by model_tag order by score {1}, sample_id {1}) as r from resp) where r <= 5"


@query(f"with {RESP} {_BW.format('worst', 'asc')} union all {_BW.format('best', 'desc')}")
def w02_best_worst(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.best_worst(responses(spark, d), 5), "score")


@query("select conv_id, min_by(text, turn) as head, max_by(text, turn) as tail from conversations group by conv_id")
def w10_first_and_last(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("head"), F.max_by("text", "turn").alias("tail"))


@query(f"with {RESP} select model_tag, cast(case when model_tag in ('m3', 'm1') then list_position(['m3', 'm1'], model_tag) else 999 end as int) as place, count(*) as n from resp group by 1 order by 2, 1")
def o01_custom_order(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).groupBy("model_tag", E.model_order(["m3", "m1"]).alias("place")).agg(F.count(F.lit(1)).alias("n")).orderBy("place", "model_tag")


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 3")
def o03_longest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(3)


@query("select event_id, ts from events order by ts, event_id")
def o05_by_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts").orderBy("ts", "event_id")


@query("select doc_id as id, lang as kind, cast(null as int) as label from documents union all select vec_id, null, label from embeddings")
def u01_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"))
    return a.unionByName(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), allowMissingColumns=True)


@query("select doc_id from documents intersect select doc_id from labels")
def u02_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("select doc_id from documents except select doc_id from labels")
def u03_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("select distinct source from documents order by source")
def u05_distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").distinct().orderBy("source")


@query("select source, max(doc_id) as doc_id, max_by(lang, doc_id) as lang from documents group by source")
def u06_keep_last(spark: SparkSession, d: str) -> DataFrame:
    last = F.max_by(F.struct("doc_id", "lang"), "doc_id").alias("x")
    return table(spark, d, "documents").groupBy("source").agg(last).select("source", "x.doc_id", "x.lang")
