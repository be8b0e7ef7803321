"""Queries of whole books: each is written from the documents' words in a profile's marks and cut by the profile again.

A part begins with every tenth document, a book with its first part; passages are numbered in their part. A book that may
begin a passage on its number's line does so for every second one. The SQL twins state what the books were made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segment as G
from .catalog import query, table

#: Passages in a part.
PART = 10
# Titles of parts and marks of the end, as each book has them.
TITLES = {
    "JW": ["BOOK FIRST", "BOOK SECOND", "BOOK THIRD", "BOOK FOURTH", "BOOK FIFTH"],
    "BGE": [f"CHAPTER {r}. A TITLE" for r in ("I", "II", "III", "IV", "V")],
    "GM": ["FIRST ESSAY.", "SECOND ESSAY.", "THIRD ESSAY."],
    "TI": ["MAXIMS AND MISSILES", "THE PROBLEM OF SOCRATES", "MORALITY AS ENEMY", "THE FOUR ERRORS", "THINGS I OWE"],
    "EH": ["PREFACE", "WHY I AM SO WISE", "WHY I AM SO CLEVER", "WHY I WRITE SUCH EXCELLENT BOOKS", "WHY I AM A FATALITY"],
}
END = {"JW": "APPENDIX", "BGE": "FROM THE HEIGHTS", "GM": "PEOPLES AND COUNTRIES", "TI": "THE END", "EH": "EDITORIAL NOTE TO POETRY"}


def body(text: str = "text") -> Column:
    """A passage of two lines: all words of a document in small letters, without marks, and an end."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z]+", " "))
    return F.concat(F.lit("p "), words, F.lit("\nq"))


def size(work: str) -> int:
    """Passages in a book."""
    return PART * len(TITLES[work])


def library(spark: SparkSession, d: str, work: str) -> DataFrame:
    """book, text: books of ``size`` documents each, with contents, parts, passages, an end and lines after the end."""
    profile, titles = G.PROFILES[work], TITLES[work]
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / size(work)).alias("book"), (F.col("doc_id") % size(work)).alias("at"), body().alias("body"))
    number = (F.col("at") % PART + 1).cast("string")
    if work == "JW":
        marked = F.concat(F.lit(" " * 12), number, F.lit(".\n"), "body")
    elif profile.may_inline:
        marked = F.concat(number, F.when(F.col("at") % 2 == 0, ". ").otherwise(".\n" if work != "TI" else "\n"), "body")
    else:
        marked = F.concat(number, F.lit(".\n"), "body")
    title = F.get(F.array(*map(F.lit, titles)), F.floor(F.col("at") / PART).cast("int"))
    opened = F.when(F.col("at") % PART == 0, F.concat(F.lit("\n"), title, F.lit("\n\n"))).otherwise(F.lit(""))
    lines = F.array_sort(F.collect_list(F.struct("at", F.concat(opened, marked).alias("x"))))
    contents = F.lit("contents\n" * max(profile.guard, 1))
    whole = F.concat(contents, F.array_join(F.transform(lines, lambda x: x["x"]), "\n"), F.lit(f"\n{END[work]}\n1. after\n"))
    return docs.groupBy("book").agg(whole.alias("text"))


def cut(spark: SparkSession, d: str, work: str) -> DataFrame:
    found = G.passages(G.lines_of(library(spark, d, work), "book", "text"), G.PROFILES[work])
    return found.select("work", "book", "part", "aph_num", F.md5("text_en").alias("body"), F.col("char_count").cast("int").alias("chars"))


def _sql(work: str) -> str:
    text = r"'p ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')) || chr(10) || 'q'"
    if G.PROFILES[work].may_inline:  # a passage that begins on its number's line keeps that line
        text = f"case when doc_id % 2 = 0 then doc_id % {PART} + 1 || '. ' else '' end || {text}"
    return f"""select '{work}' as work, doc_id // {size(work)} as book, cast(doc_id % {size(work)} // {PART} + 1 as int) as part, cast(doc_id % {PART} + 1 as int) as aph_num, md5({text}) as body, cast(length({text}) as int) as chars from documents"""


@query(_sql("JW"))
def w04_f29_book_jw(spark: SparkSession, d: str) -> DataFrame:
    return cut(spark, d, "JW")


@query(_sql("BGE"))
def w04_f29_book_bge(spark: SparkSession, d: str) -> DataFrame:
    return cut(spark, d, "BGE")


@query(_sql("GM"))
def w04_f29_book_gm(spark: SparkSession, d: str) -> DataFrame:
    return cut(spark, d, "GM")


@query(_sql("TI"))
def w04_f29_book_ti(spark: SparkSession, d: str) -> DataFrame:
    return cut(spark, d, "TI")


@query(_sql("EH"))
def w04_f29_book_eh(spark: SparkSession, d: str) -> DataFrame:
    return cut(spark, d, "EH")
