"""Segmentation of books into addressable passages, by scans over numbered lines (book, line_no, line).

A profile states how a book marks its parts and its passages; the engine is the same for all: boundaries are filtered lines,
the current part is carried forward, passages run from one number to the next.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored
from .scan import neighbours, scanned


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered lines, from 0, of whole texts."""
    return docs.select(F.col(key).alias("book"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _by(*order: str) -> Window:
    return Window.partitionBy("book").orderBy(*(order or ("line_no",)))


def ranges(headers: DataFrame, ends: DataFrame) -> DataFrame:
    """Headers (book, line_no) with ``until``: the next header's line, or the book's end."""
    after = F.lead("line_no").over(_by())
    return headers.withColumn("__next__", after).join(ends, "book").withColumn("until", F.coalesce("__next__", "end")).drop("__next__", "end")


def with_isolated(rows: DataFrame, line: str = "line", out: str = "isolated") -> DataFrame:
    """Whether the line before or after is blank or missing."""
    blank = lambda c: F.coalesce(T.trim_all(F.col(c)) == "", F.lit(True))
    return neighbours(rows, ["book"], "line_no", line).withColumn(out, blank("previous") | blank("following")).drop("previous", "following")


def with_resets(rows: DataFrame, number: str, order: str = "line_no", keys: tuple[str, ...] = ("book",), out: str = "sub_chapter") -> DataFrame:
    """How often the number has failed to rise so far; the number before the first is 0."""
    return scanned(rows, list(keys), order, resets={out: number})


def longest_run(text: Column) -> Column:
    """Longest run of one character, exactly: the longest match of a repeated character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(.)\1*"), F.lit(0)), lambda x: F.char_length(x))), F.lit(0))


def inline(line: Column, digits: Column) -> Column:
    """Whether text follows the number on its own line."""
    return F.contains(line, F.lit(".")) & (F.char_length(line) > F.char_length(digits) + 1)


@dataclass(frozen=True)
class Profile:
    """``part``: a regular expression whose first group names the part; ``parts``: names to numbers (else the part's rank);
    ``number``: whose first group is a passage's number; ``guard``: lines before are contents; ``start``/``end``: markers
    of the body (a line equal to start, a line that contains an end); ``skip``: part lines that aren't; ``lonely``: a part
    line needs a blank neighbour; ``may_inline``: a passage may begin on its number's line; ``sub``: numbers that restart
    open a sub-chapter; ``whole``: a part without numbers is one passage."""

    work: str
    part: str
    number: str
    parts: dict[str, int] = field(default_factory=dict)
    guard: int = 0
    start: str | None = None
    end: tuple[str, ...] = ()
    end_equals: bool = False
    skip: tuple[str, ...] = ()
    lonely: bool = False
    may_inline: bool = False
    sub: bool = False
    whole: bool = False


_ROMAN = {r: k for k, r in enumerate("I II III IV V VI VII VIII IX X".split(), 1)}
# How each book marks its parts and passages.
PROFILES = {
    "JW": Profile("JW", r"^\s*(BOOK (?:FIRST|SECOND|THIRD|FOURTH|FIFTH))\s*$", r"^\s{10,}(\d+)\.\s*$", {f"BOOK {n}": k for k, n in enumerate("FIRST SECOND THIRD FOURTH FIFTH".split(), 1)}, end=("APPENDIX",), end_equals=True),
    "BGE": Profile("BGE", r"^CHAPTER\s+([IVX]+)\.\s+.+$", r"^(\d+)\.(?:\s|--|$)", _ROMAN, end=("FROM THE HEIGHTS", "*** END"), may_inline=True),
    "GM": Profile("GM", r"^\s*(FIRST|SECOND|THIRD)\s+ESSAY\.", r"^(\d+)\.\s*$", {"FIRST": 1, "SECOND": 2, "THIRD": 3}, guard=100, end=("PEOPLES AND COUNTRIES", "Peoples and Countries", "*** END OF THE PROJECT GUTENBERG")),
    "TI": Profile("TI", "^([\"“]?[A-Z][A-Z0-9 \".“”'’\\-—!?]{4,80})$", r"^(\d+)(?:\.\s+|$)", guard=200, end=("THE END",), skip=("THE TWILIGHT OF THE IDOLS", "THE END.", "THE END", "THE HISTORY OF AN ERROR"), lonely=True, may_inline=True, whole=True),
    "EH": Profile("EH", r"^(PREFACE|WHY I AM SO WISE|WHY I AM SO CLEVER|WHY I WRITE SUCH EXCELLENT BOOKS|WHY I AM A FATALITY)\s*$", r"^(\d+)(?:\.\s*|$)", guard=200, end=("EDITORIAL NOTE TO POETRY", "*** END OF THE PROJECT GUTENBERG"), may_inline=True, sub=True, whole=True),
}


def passages(lines: DataFrame, profile: Profile) -> DataFrame:
    """work, book, part, chapter_title, sub_chapter, aph_num, text_en, line_start, line_end, char_count.

    Parts, numbers and resets run along the lines as prefix scans, so a book may be as large as the table. Marks alone are scanned;
    the lines' texts move twice, to their places in a passage and to the passage. Places and passages are as many as the lines, however small their files, so
    they are merged with the texts and never sent to all tasks.
    """
    p = profile
    lines = stored(lines.select("book", "line_no", "line"), "book-lines")
    bare = F.regexp_replace("line", r"\s+$", "")
    named = F.regexp_extract(bare, p.part, 1)
    is_part = (named != "") & (F.col("line_no") >= p.guard) & ~T.trim_all(F.col("line")).isin(*(p.skip or ("",)))
    stop = F.lit(False)
    for mark in p.end:
        stop = stop | ((T.trim_all(F.col("line")) == mark) if p.end_equals else F.contains("line", F.lit(mark)))
    digits = F.regexp_extract(bare, p.number, 1)
    marks = lines.select("book", "line_no", F.when(is_part, named).alias("title"), stop.alias("stop"), (T.trim_all(F.col("line")) == "").alias("blank"),
                         F.when(digits != "", digits.try_cast("int")).alias("number"), (inline(bare, digits) if p.may_inline else F.lit(False)).alias("inline"))
    rows = stored(marks, "book-marks")
    if p.lonely:
        alone = F.coalesce("previous", F.lit(True)) | F.coalesce("following", F.lit(True))
        rows = stored(neighbours(rows, ["book"], "line_no", "blank").withColumn("title", F.when(alone, F.col("title"))).drop("previous", "following"), "book-marks")
    first = rows.where("title is not null").groupBy("book").agg(F.min("line_no").alias("first"))
    after = rows.where("stop").join(first, "book").where("line_no > first").groupBy("book").agg(F.min("line_no").alias("end"))
    bounds = stored(first.join(after, "book", "left"), "book-bounds")
    body = rows.join(bounds, "book").where((F.col("line_no") >= F.col("first")) & (F.col("end").isNull() | (F.col("line_no") < F.col("end"))))
    body = body.withColumn("num", F.when(F.col("title").isNull(), F.col("number")))
    body = scanned(body.drop("first", "end", "stop", "number"), ["book"], "line_no", carried={"chapter_title": "title"}, counted={"seq": "title"})
    body = scanned(body, ["book", "seq"], "line_no", counted={"item": "num"})
    if p.whole:
        body = body.join(body.groupBy("book", "seq").agg(F.count("num").alias("numbers")), ["book", "seq"])
    wanted = (F.col("item") > 0) | (F.col("numbers") == 0) if p.whole else F.col("item") > 0
    keep_line = F.when(F.col("num").isNotNull(), F.col("inline")).otherwise(F.col("title").isNull())
    placed = stored(body.where(wanted).select("book", "line_no", "seq", "chapter_title", "item", "num", "blank", keep_line.alias("kept")), "book-places")
    key = ["book", "seq", "item"]
    made = placed.groupBy(*key).agg(F.max("chapter_title").alias("chapter_title"), F.max("num").alias("aph_num"), F.min("line_no").alias("line_start"), (F.max("line_no") + 1).alias("line_end"), F.max(F.col("kept") & ~F.col("blank")).alias("real"))
    made = made.withColumn("aph_num", F.coalesce("aph_num", F.lit(1))).where("real").drop("real")
    part = F.col("seq").cast("int")
    for name, k in reversed(p.parts.items()):
        part = F.when(F.col("chapter_title") == name, F.lit(k)).otherwise(part)
    made = made.withColumn("part", part)
    made = with_resets(made, "aph_num", "line_start", ("book", "seq")) if p.sub else made.withColumn("sub_chapter", F.lit(None).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    texts = lines.join(placed.where("kept").select("line_no", *key).hint("merge"), ["book", "line_no"]).groupBy(*key).agg(T.trim_all(text).alias("text_en"))
    made = made.join(texts.hint("merge"), key)
    return made.select(F.lit(p.work).alias("work"), "book", "part", "chapter_title", F.col("sub_chapter").cast("int").alias("sub_chapter"), "aph_num", "text_en", "line_start", "line_end", F.char_length("text_en").alias("char_count"))
