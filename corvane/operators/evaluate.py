"""Evaluation analytics over judged responses: sample_id, model_tag, voice, pattern, difficulty, generated, generated_len,
gen_tokens, collapsed, collapse_reason, q1, q2, q3, score, grade.

Every operator is one aggregation, or one per side of a comparison; none collects rows.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import render
from ..functions import scores as S
from ..functions import text as T
from ..sources import jsonl

#: Characters of a token, where a response has no token count; tokens at which a response was cut.
TOKEN_CHARS, CUT_TOKENS = 3, 768
AXES = ("q1", "q2", "q3")


def scored(rows: DataFrame) -> DataFrame:
    return rows.where("q1 is not null and not collapsed")


def model_order(models: list[str], col: str = "model_tag") -> Column:
    """Place of a model in a given list; unknown models come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, models)), F.col(col)), F.lit(0)), F.lit(999)).cast("int")


def tokens() -> Column:
    return F.coalesce("gen_tokens", F.floor(F.col("generated_len") / TOKEN_CHARS))


def token_stats(rows: DataFrame) -> DataFrame:
    t = rows.withColumn("t", tokens())
    out = t.groupBy("model_tag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("t").alias("avg_tokens"), F.min("t").alias("min_tokens"), F.max("t").alias("max_tokens"),
        F.avg("generated_len").alias("avg_chars"), F.count_if(F.col("t") >= CUT_TOKENS).alias("cut"), F.count_if(F.col("gen_tokens").isNull()).alias("estimated"),
    )
    return out.withColumn("cut_pct", S.percent(F.col("cut"), F.col("n")))


def bars(stats: DataFrame, value: str, width: int = 60) -> DataFrame:
    """Length of each group's bar: the share of the largest value, rounded down; groups are few."""
    return stats.withColumn("bar", F.floor(F.col(value) / F.max(value).over(Window.partitionBy(F.lit(1))) * width).cast("int")).withColumn("flag", F.col("cut_pct") >= 10)


def pivot_mean(rows: DataFrame, by: str, models: list[str], value: Column, prefix: str = "") -> DataFrame:
    """Means of a value by group and model, one column for each model; null where there is no row."""
    return rows.groupBy(by).agg(*[F.avg(F.when(F.col("model_tag") == m, value)).alias(f"{prefix}{m}") for m in models])


def against_baseline(stats: DataFrame, value: str, baseline: str) -> DataFrame:
    """Change of each model against the baseline in percent."""
    base = stats.where(F.col("model_tag") == baseline).select(F.col(value).alias("base"))
    return stats.crossJoin(F.broadcast(base.limit(1))).select("model_tag", value, F.when(F.col("base") != 0, 100.0 * (F.col(value) - F.col("base")) / F.col("base")).alias("change_pct"))


def overall(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model_tag").agg(
        F.count(F.lit(1)).alias("n"), S.safe_mean(F.col("score")).alias("mean"), F.coalesce(F.median("score"), F.lit(0.0)).alias("median"), S.stdev(F.col("score")).alias("stdev"),
        *[F.avg(q).alias(f"{q}_mean") for q in AXES], F.count_if("collapsed").alias("collapsed"), *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCF"],
    )


def best_model(stats: DataFrame, models: list[str]) -> DataFrame:
    """The model of highest mean, then highest third axis; the first in order on ties."""
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("mean"), F.desc_nulls_last("q3_mean"), model_order(models)))
    return stats.withColumn("r", rank).where("r = 1").select("model_tag", "mean", "q3_mean")


def collapse_summary(rows: DataFrame, top: int = 3) -> DataFrame:
    """Collapsed rows of each model, with the commonest reasons as text."""
    reasons = rows.where("collapsed").groupBy("model_tag", T.before(F.col("collapse_reason"), "=").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    rank = F.row_number().over(Window.partitionBy("model_tag").orderBy(F.desc("c"), "k"))
    first = reasons.withColumn("r", rank).where(F.col("r") <= top).groupBy("model_tag").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "k", "c"))), lambda x: F.concat(x["k"], F.lit("("), x["c"].cast("string"), F.lit(")"))), ", ").alias("reasons")
    )
    bad = F.when(F.col("collapsed"), F.col("generated_len"))
    counts = rows.groupBy("model_tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("collapsed").alias("collapsed"), F.median(bad).alias("median_len"), F.max(bad).alias("max_len"))
    return counts.join(first, "model_tag", "left").withColumn("ratio", F.col("collapsed") / F.greatest("n", F.lit(1)))


def length_stats(rows: DataFrame) -> DataFrame:
    n = F.col("generated_len")
    return rows.groupBy("model_tag").agg(F.avg(n).alias("mean"), F.median(n).alias("median"), F.max(n).alias("max"), S.safe_mean(F.when(~F.col("collapsed"), n)).alias("mean_fine"))


def against_reference(stats: DataFrame, reference: float) -> DataFrame:
    delta = F.col("mean") - F.lit(reference)
    return stats.select("model_tag", "mean", delta.alias("delta"), F.when(delta > 0, "+").when(delta < 0, "-").otherwise("=").alias("sign"))


def voice_defect(rows: DataFrame, models: list[str], threshold: int = 2) -> DataFrame:
    out = scored(rows).where(F.col("model_tag").isin(models)).groupBy("voice").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q3") <= threshold).alias("low"), F.avg("q3").alias("avg_q3"))
    return out.withColumn("rate", F.col("low") / F.col("n"))


def ending_top(rows: DataFrame, reason: Column, top: int, models: list[str] | None = None, live: bool = False) -> DataFrame:
    """Quoted endings by frequency, of some models' rows if they are named, and only of rows that aren't collapsed if ``live``.
    The rank is over counts of endings, of which a sort keeps the first."""
    rows = rows if models is None else rows.where(F.col("model_tag").isin(models))
    rows = rows.where(~F.coalesce("collapsed", F.lit(False))) if live else rows
    counts = rows.select(F.explode(T.quoted_endings(reason)).alias("ending")).groupBy("ending").agg(F.count(F.lit(1)).alias("n"))
    first = counts.orderBy(F.desc("n"), "ending").limit(top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "ending")))


def compare_modes(a: DataFrame, b: DataFrame, axes: tuple[str, ...] = ()) -> DataFrame:
    """Counts and means of two runs by model, 0 where one has none; with ``axes`` also the means of these and their changes."""
    named = ["score", *axes]
    short = lambda c: "mean" if c == "score" else f"{c}_mean"
    one = lambda rows, s: rows.groupBy("model_tag").agg(F.count(F.lit(1)).alias(f"n_{s}"), *[F.avg(c).alias(f"{short(c)}_{s}") for c in named])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = one(a, "a").join(one(b, "b"), "model_tag", "full_outer")
    out = [F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in "ab"]
    for c in named:
        m = short(c)
        out += [*[zero(f"{m}_{s}").alias(f"{m}_{s}") for s in "ab"], (zero(f"{m}_b") - zero(f"{m}_a")).alias("delta" if c == "score" else f"{c}_delta")]
    return both.select("model_tag", *out)


def q_distribution(rows: DataFrame) -> DataFrame:
    axes = F.explode(F.array(*[F.struct(F.lit(q).alias("axis"), F.col(q).alias("v")) for q in AXES]))
    long = rows.where("q1 is not null").select("model_tag", axes.alias("x")).select("model_tag", "x.axis", "x.v")
    return long.groupBy("model_tag", "axis").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), *[F.count_if(F.col("v") == k).alias(f"n{k}") for k in range(1, 6)])


def best_worst(rows: DataFrame, n: int) -> DataFrame:
    """The n lowest scores of each model, earlier rows first on ties, and the n highest, later rows first."""
    low = F.row_number().over(Window.partitionBy("model_tag").orderBy(F.asc("score"), F.asc("sample_id")))
    high = F.row_number().over(Window.partitionBy("model_tag").orderBy(F.desc("score"), F.desc("sample_id")))
    side = lambda name, r: rows.withColumn("r", r).where(F.col("r") <= n).select("model_tag", F.lit(name).alias("side"), "r", "sample_id", "score", T.truncate(F.col("generated"), 120, "").alias("shown"))
    return side("worst", low).unionByName(side("best", high))


def length_vs_score(rows: DataFrame) -> DataFrame:
    x, y = F.col("generated_len").cast("double"), F.col("score")
    return scored(rows).groupBy("model_tag").agg(F.count(F.lit(1)).alias("n"), S.loose_correlation(x, y).alias("r")).where("n >= 2")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    pair = a.select("sample_id", "model_tag", F.col("score").alias("x")).join(b.select("sample_id", "model_tag", F.col("score").alias("y")), ["sample_id", "model_tag"])
    delta = F.col("y") - F.col("x")
    out = pair.groupBy("model_tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(delta) < 0.001).alias("same"), F.avg(delta).alias("mean_delta"), F.avg(F.abs(delta)).alias("mean_abs"), F.max(F.abs(delta)).alias("max_abs"))
    return out.withColumn("rate", F.col("same") / F.col("n"))


def cross(rows: DataFrame, model: str, a: str, b: str, values: list[str]) -> DataFrame:
    """Mean and number of one model's rows by two groupings, a column pair for each value of the second."""
    own = rows.where(F.col("model_tag") == model)
    aggs = [f(F.when(F.col(b) == v, F.col("score"))).alias(f"{v}_{name}") for v in values for name, f in (("mean", F.avg), ("n", F.count))]
    return own.groupBy(a).agg(*aggs)


def deep_dive(judged: DataFrame, texts: DataFrame, condition: Column) -> DataFrame:
    shown = texts.select("sample_id", "model_tag", F.substring("generated", 1, 300).alias("shown"))
    return judged.where(condition).select("sample_id", "model_tag", "grade").join(shown, ["sample_id", "model_tag"], "left")


def with_metadata(rows: DataFrame, meta: DataFrame, key: str, meta_key: str) -> DataFrame:
    """Left join with metadata; a miss is a row with an error, score 0 and grade F."""
    joined = rows.join(meta.withColumn("__there__", F.lit(True)), F.col(key) == F.col(meta_key), "left")
    miss = F.col("__there__").isNull()
    return joined.withColumns({"error": F.when(miss, "eval_meta_missing"), "score": F.when(miss, 0.0).otherwise(F.col("score")), "grade": F.when(miss, "F").otherwise(F.col("grade"))}).drop("__there__")


def by_grade(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).withColumn("pct", S.percent(F.col("n"), F.col("total"))).drop("total")


def reason_search(rows: DataFrame, keywords: list[str], axes: tuple[str, ...] = AXES, models: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A row for each record and axis whose reason (column ``<axis>_reason``) holds one of the keywords; with ``limit`` the
    first by sample, model and axis."""
    long = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value"), F.col(f"{a}_reason").alias("reason")) for a in axes]))
    chosen = rows if models is None else rows.where(F.col("model_tag").isin(models))
    found = chosen.select("sample_id", "model_tag", long.alias("x")).select("sample_id", "model_tag", "x.axis", "x.value", T.truncate(F.col("x.reason"), 200).alias("shown"), F.col("x.reason").alias("__r__"))
    held = F.lit(False)
    for k in keywords:
        held = held | F.contains("__r__", F.lit(k))
    found = found.where(held).drop("__r__")
    return found if limit is None else found.orderBy("sample_id", "model_tag", "axis").limit(limit)


def per_pattern_defect(rows: DataFrame, models: list[str]) -> DataFrame:
    """Means of the score by pattern, a column for each model, and the second model's change against the first."""
    out = pivot_mean(scored(rows), "pattern", models, F.col("score"))
    return out.withColumn("delta", F.col(f"`{models[1]}`") - F.col(f"`{models[0]}`"))


#: Sub-commands by name; each takes the judged rows and keyword options.
COMMANDS: dict[str, Callable[..., DataFrame]] = {
    "voice-defect": voice_defect,
    "ending-top": ending_top,
    "compare-modes": compare_modes,
    "collapse-detail": collapse_summary,
    "q-distribution": q_distribution,
    "best-worst": best_worst,
    "length-vs-score": length_vs_score,
    "agreement": agreement,
    "voice-pattern-cross": cross,
    "sample-deepdive": deep_dive,
    "reason-search": reason_search,
    "per-pattern-defect": per_pattern_defect,
}


def run_command(name: str, rows: DataFrame, **options) -> DataFrame:
    """A command's result. Options that a command doesn't have are ignored, so that one set of options serves several."""
    if name not in COMMANDS:
        raise KeyError(f"unknown command {name}; there are {', '.join(COMMANDS)}")
    known = inspect.signature(COMMANDS[name]).parameters
    return COMMANDS[name](rows, **{k: v for k, v in options.items() if k in known})


def run_report(spark: SparkSession, name: str, path: str, schema: str, fmt: str = "text", digits: int = 3, **options) -> str:
    """A command over the judged rows of a JSON-lines file or folder, rendered in one format or ``all``."""
    rows = jsonl.read_required(spark, path, schema)
    return render.render(run_command(name, rows, **options), name, fmt, digits)
