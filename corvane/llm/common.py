"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes outside words become spaces, A-Z become a-z. Words are runs of 0-9, a-z and all bytes from 0x80 up, which is
#: the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] of the lower-cased text in UTF-8.
_WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if (b >= 128 or chr(b).isalnum()) else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text after lower-casing A-Z; none for null."""
    return text.translate(_WORD_BYTES).split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as bytes, without decoding it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch for each input batch; batches are bounded by the session's Arrow limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


#: A key that more than so large a part of the rows holds is hot; there are fewer than ``HOT`` of them.
HOT = 20_000
#: Keys with up to so many rows are never dealt.
PART_ROWS = 16


def spread_join(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` by ``key`` without a task that holds all rows of a hot key.

    ``facts`` has one row for each key, and in ``n`` the number of ``rows`` that hold it; ``total`` is their sum or more. It
    is read twice, so it should be a stored table. The list of hot keys (fewer than ``HOT``, whatever the input) is sent to
    all tasks; their rows are dealt into parts of about a ``HOT``-th of ``total``, and their fact is repeated for each part. All other
    keys have one part. Null keys of an outer join are dealt as well. The result has no column ``n``.
    """
    bound = max(total // HOT, PART_ROWS)
    hot = facts.where(F.col(n) > bound).select(key, F.ceil(F.col(n) / bound).alias("__parts__"))
    own = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    part = F.when(F.col(key).isNull(), F.pmod(own, F.lit(HOT))).otherwise(F.coalesce(F.pmod(own, F.col("__parts__")), F.lit(0)))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__part__", part).drop("__parts__")
    parts = F.when(F.col(n) > bound, F.ceil(F.col(n) / bound)).otherwise(F.lit(1))
    copies = facts.withColumn("__part__", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(n)
    return dealt.join(copies, [key, "__part__"], how).drop("__part__")
