"""Places for models: scorers, embedders and generators are functions that are handed in; deterministic stand-ins let the
engine run offline."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Scorer = Callable[[pd.Series], pd.DataFrame]
Embedder = Callable[[pd.Series], pd.Series]
AXES = ("q1", "q2", "q3")


def hash_scorer(prompts: pd.Series) -> pd.DataFrame:
    """Scores from 1 to 5 that depend on the prompt's bytes only."""
    import xxhash

    h = prompts.map(lambda p: xxhash.xxh64_intdigest((p or "").encode()))
    return pd.DataFrame({q: [1 + (x >> (8 * k)) % 5 for x in h] for k, q in enumerate(AXES)}, dtype="int32")


def hash_embedder(size: int) -> Embedder:
    """Unit vectors that depend on the text's bytes only."""

    def embed(texts: pd.Series) -> pd.Series:
        import numpy as np
        import xxhash

        def one(t: str) -> list[float]:
            v = np.random.default_rng(xxhash.xxh64_intdigest((t or "").encode())).standard_normal(size)
            return (v / np.linalg.norm(v)).tolist()

        return texts.map(one)

    return embed


def with_retries(f: Scorer, tries: int = 3, wait: float = 0.5) -> Scorer:
    """Try a model several times, waiting longer each time; rows of a batch that keeps failing have null scores."""

    def run(prompts: pd.Series) -> pd.DataFrame:
        for k in range(1, tries + 1):
            try:
                return f(prompts)
            except Exception:  # a model's failure must not fail the job
                if k < tries:
                    time.sleep(wait * k)
        return pd.DataFrame({q: pd.array([None] * len(prompts), dtype="Int32") for q in AXES})

    return run


def score(rows: DataFrame, key: str, prompt: str, scorer: Scorer = hash_scorer, concurrency: int | None = None) -> DataFrame:
    """key and scores; ``concurrency`` is the number of partitions, that is of calls at a time."""
    dealt = rows.select(key, prompt)
    dealt = dealt.repartition(concurrency) if concurrency else dealt
    safe = with_retries(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.concat([pdf[[key]].reset_index(drop=True), safe(pdf[prompt]).reset_index(drop=True)], axis=1)

    kind = dict(rows.dtypes)[key]
    return dealt.mapInPandas(run, f"{key} {kind}, q1 int, q2 int, q3 int")


def embed(rows: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "embedding": embedder(pdf[text])})

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<float>")


def generate_mock(messages: DataFrame, conversation: str, lines: list[str]) -> DataFrame:
    """The mock generator: a line picked by the number of answers so far."""
    n = F.count_if(F.col("role") == "assistant")
    return messages.groupBy(conversation).agg(n.alias("n")).select(conversation, F.get(F.array(*map(F.lit, lines)), (F.col("n") % len(lines)).cast("int")).alias("generated"))


def expand(rows: DataFrame, key: str, raw: str, fields: list[str], most: int = 3) -> DataFrame:
    """Samples out of a generator's JSON array: items with all fields, at most ``most`` for each row."""
    items = F.slice(T.json_items(F.col(raw), fields), F.lit(1), F.lit(most))
    return rows.select(key, F.posexplode(items).alias("k", "m")).select(key, "k", *[F.col("m")[f].alias(f) for f in fields])


def gate_by(rules: dict[str, str], category: str) -> Column:
    """Rubric plug-ins: a SQL condition for each category; unknown categories don't pass."""
    out = F.lit(False)
    for name, condition in rules.items():
        out = F.when(F.col(category) == name, F.coalesce(F.expr(condition), F.lit(False))).otherwise(out)
    return out
