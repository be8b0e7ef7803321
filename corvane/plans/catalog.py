"""The registry and the stand-ins: how the test tables play the engine's entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import curate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def sql_pick(index: str, values: list[str]) -> str:
    return f"[{', '.join(repr(v) for v in values)}][1 + ({index}) % {len(values)}]"


def sql_map(value: str, pairs: dict[str, str]) -> str:
    return f"case {value} {' '.join(f'when {k!r} then {v!r}' for k, v in pairs.items())} else {value} end"


MODELS = [f"m{k}" for k in range(6)]
LEVELS = ["easy", "medium", "hard"]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged answers of models: documents as answers, labels as scored rows and defects."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i, n = F.col("doc_id"), F.char_length("text")
    scored = F.col("quality").isNotNull()
    q = lambda x: F.when(scored, (1 + x % 5).cast("int"))
    rows = d.join(l, "doc_id", "left").select(
        i.alias("sample_id"),
        F.concat(F.lit("m"), (i % 6).cast("string")).alias("model_tag"),
        F.col("lang").alias("voice"),
        F.concat(F.lit("p"), (F.floor(i / 6) % 9).cast("string")).alias("pattern"),
        pick(i, LEVELS).alias("difficulty"),
        F.col("source"),
        F.col("text").alias("generated"),
        n.cast("long").alias("generated_len"),
        F.when(i % 4 == 0, F.lit(None)).otherwise(F.floor(n / 4)).cast("long").alias("gen_tokens"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("collapsed"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("k"), (i % 5).cast("string"), F.lit("=x"))).otherwise("").alias("collapse_reason"),
        q(i * 7).alias("q1"),
        q(i * 3 + n).alias("q2"),
        q(n).alias("q3"),
    )
    cols = [F.col("q1"), F.col("q2"), F.col("q3")]
    return rows.withColumn("score", S.normalized(*cols)).withColumn("grade", S.grade(*cols))


RESP = f"""resp0 as (select d.doc_id as sample_id, 'm' || (d.doc_id % 6) as model_tag, d.lang as voice,
  'p' || ((d.doc_id // 6) % 9) as pattern, {sql_pick("d.doc_id", LEVELS)} as difficulty, d.source, d.text as generated,
  cast(length(d.text) as bigint) as generated_len,
  case when d.doc_id % 4 = 0 then null else cast(length(d.text) // 4 as bigint) end as gen_tokens,
  coalesce(l.toxic, 0) = 1 as collapsed, case when l.toxic = 1 then 'k' || (d.doc_id % 5) || '=x' else '' end as collapse_reason,
  case when l.quality is not null then cast(1 + (d.doc_id * 7) % 5 as int) end as q1,
  case when l.quality is not null then cast(1 + (d.doc_id * 3 + length(d.text)) % 5 as int) end as q2,
  case when l.quality is not null then cast(1 + length(d.text) % 5 as int) end as q3
  from documents d left join labels l using (doc_id)),
resp as (select *, coalesce((q1 + q2 + q3) / 15.0, 0.0)::double as score,
  case when q1 + q2 + q3 >= 13 then 'A' when q1 + q2 + q3 >= 11 then 'B' when q1 + q2 + q3 >= 9 then 'C' else 'F' end as grade from resp0)"""

_P = [*curate.PATTERNS, "reflection-reframing", "reflection_refframing", "unknown"]
_C = [*curate.CONCEPTS, "value-creation", "art-tragedy", "nothing"]
_Q = [*curate.QUESTION_TYPES, *curate.QUESTION_TYPES, "other"]
_D = [*curate.DIFFICULTIES, *curate.DIFFICULTIES, *curate.DIFFICULTIES, "none"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate samples: documents as answers with enumerations that hold some misspelt and unknown values."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), pick(i, _P).alias("pattern"), pick(i * 5, _C).alias("concept"), pick(i * 3, _Q).alias("question"), pick(i, _D).alias("difficulty"), "text", "lang", "source"
    )


SAMPLES = f"""samples as (select doc_id as id, {sql_pick("doc_id", _P)} as pattern, {sql_pick("doc_id * 5", _C)} as concept,
  {sql_pick("doc_id * 3", _Q)} as question, {sql_pick("doc_id", _D)} as difficulty, text, lang, source from documents)"""

WORKS = ["JW", "BGE", "GM", "TI", "EH", "XX"]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored chunks: works, chapters and five scores from ids and lengths."""
    i, n = F.col("doc_id"), F.col("n_chars")
    s = lambda x: (1 + x % 5).cast("int")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), pick(i, WORKS).alias("work"), (F.floor(i / 6) % 13).cast("int").alias("ch"), (i % 4).cast("int").alias("sub"), (i % 90).cast("int").alias("number"),
        s(n).alias("a"), s(n + i).alias("b"), s(i * 3 + n).alias("c"), s(F.floor(n / 5)).alias("sc"), s(F.floor(n / 25)).alias("den"), "text", "n_chars",
    )


CHUNKS = f"""chunks as (select doc_id as id, {sql_pick("doc_id", WORKS)} as work, cast((doc_id // 6) % 13 as int) as ch,
  cast(doc_id % 4 as int) as sub, cast(doc_id % 90 as int) as number, cast(1 + n_chars % 5 as int) as a,
  cast(1 + (n_chars + doc_id) % 5 as int) as b, cast(1 + (doc_id * 3 + n_chars) % 5 as int) as c,
  cast(1 + (n_chars // 5) % 5 as int) as sc, cast(1 + (n_chars // 25) % 5 as int) as den, text, n_chars from documents)"""



class Sql(str):
    """SQL text with a hole for one expression."""

    def format(self, x: str) -> str:
        return self.replace("{0}", x)


#: Text functions in the oracle's dialect.
SQL_STRIP = Sql(r"regexp_replace(regexp_replace({0}, '\*+([^*]+)\*+', '\1', 'g'), '_+([^_]+)_+', '\1', 'g')")
SQL_TRIM = Sql(r"regexp_replace({0}, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')")
SQL_SQUEEZE = Sql(r"regexp_replace({0}, '[\s\p{Z}]+', '', 'g')")
SQL_SENTENCES = Sql(r"len(list_filter(regexp_split_to_array(" + SQL_TRIM.format(SQL_STRIP) + r", '[.!?]+(?:\s|$)'), lambda x: regexp_matches(x, '\S')))")
