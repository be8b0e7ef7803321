"""Scalar text functions as column expressions. Lengths and offsets are code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the degenerate-text detector, in the order in which its rules are asked.
MAX_RUN = 30
MIN_DIVERSITY = 0.05
GRAM = 10
MIN_DISTINCT = 0.15
LONG, LONG_DIVERSITY = 3000, 0.15
# Sentences allowed for each difficulty, and the default.
SENTENCES = {"easy": (3, 5), "medium": (5, 8), "hard": (7, 12)}
ANY_SENTENCES = (3, 12)
# Phrases of comfort that disqualify an answer.
COMFORT = [
    "힘내",
    "괜찮(아|을|습니다)",
    "할 수 있어",
    "걱정.*마(세요|십시오)",
    "이해해(요|줍니다)",
    "마음.*알아(요|줘)",
    "모두가.*경험",
    "누구나.*겪",
]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_marks(text: Column) -> Column:
    """Asterisks and underscores around emphasised text go; the text stays."""
    return F.regexp_replace(F.regexp_replace(text, r"\*+([^*]+)\*+", "$1"), r"_+([^_]+)_+", "$1")


def trim_all(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def ngrams(text: Column, n: int, whole_if_short: bool = False) -> Column:
    """All windows of n characters; a shorter text gives none, or itself. Windows are taken from an array of characters,
    since a substring is found by counting from the text's start."""
    windows = let(F.split(text, ""), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, F.lit(n)), "")))
    short = F.array(text) if whole_if_short else F.array().cast("array<string>")
    return F.when(F.char_length(text) >= n, windows).otherwise(short)


def sentence_count(text: Column) -> Column:
    parts = F.split(trim_all(strip_marks(text)), r"[.!?]+(?:\s|$)")
    return F.size(F.filter(parts, lambda p: p.rlike(r"\S")))


def length_ok(text: Column, difficulty: Column, tolerance: int = 2) -> Column:
    low, high = ANY_SENTENCES
    lo, hi = F.lit(low), F.lit(high)
    for name, (a, b) in SENTENCES.items():
        lo, hi = F.when(difficulty == name, a).otherwise(lo), F.when(difficulty == name, b).otherwise(hi)
    return let(sentence_count(text), lambda n: n.between(lo - tolerance, hi + tolerance))


def any_phrase(text: Column, phrases: list[str] = COMFORT) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in phrases))


def diversity(text: Column) -> Column:
    return F.size(F.array_distinct(F.split(text, ""))) / F.char_length(text)


def collapse_reason(text: Column) -> Column:
    """Name of the first rule by which a text is degenerate, else null. Later rules are evaluated only where needed."""
    n = F.char_length(text)
    grams = ngrams(text, GRAM)
    return (
        F.when(text.isNull() | (n == 0), F.lit("empty"))
        .when(text.rlike(rf"(?s)(.)\1{{{MAX_RUN - 1}}}"), F.lit("max_run"))
        .when(diversity(text) < MIN_DIVERSITY, F.lit("char_diversity"))
        .when((n >= 5 * GRAM) & let(grams, lambda g: F.size(F.array_distinct(g)) / F.size(g) < MIN_DISTINCT), F.lit("ngram_distinct"))
        .when((n >= LONG) & (diversity(text) < LONG_DIVERSITY), F.lit("long_low_diversity"))
    )


def truncate(text: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit(suffix))).otherwise(text)


def before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def quoted_endings(text: Column) -> Column:
    """Endings that a judge quotes, such as '~word'."""
    return F.transform(F.regexp_extract_all(text, F.lit("['\"]([~∼][^'\"]{0,15})['\"]"), F.lit(1)), trim_all)


def flat_json(text: Column) -> Column:
    """The first object without nested braces; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"\{[^{}]*\}", 0), F.lit(""))


def json_from_first_brace(text: Column, schema: str) -> Column:
    """The first JSON value from the first brace on; what follows it is ignored."""
    at = F.instr(text, "{")
    return F.when(at > 0, F.from_json(F.substr(text, at), schema))


def json_items(text: Column, keys: list[str]) -> Column:
    """Objects of the widest array in the text that have all keys."""
    found = F.nullif(F.regexp_extract(text, r"(?s)\[\s*\{.*\}\s*\]", 0), F.lit(""))
    items = F.from_json(found, "array<map<string,string>>")
    has = lambda m: reduce(lambda a, k: a & F.map_contains_key(m, k), keys, F.lit(True))
    return F.coalesce(F.filter(items, has), F.array().cast("array<map<string,string>>"))


def clean_rewrite(text: Column, prefix: str = r"(?i)^(?:rewritten\s+query|query|question|output)\s*[:：]\s*") -> Column:
    """First line of a model's rewrite, without a leading label and quotes around it."""
    line = F.split_part(trim_all(F.regexp_replace(trim_all(text), prefix, "")), F.lit("\n"), F.lit(1))
    return trim_all(F.regexp_replace(trim_all(line), r"""^["'“”‘’`]+|["'“”‘’`]+$""", ""))


def intent(text: Column, names: tuple[str, ...] = ("COMMENTARY", "OUT_OF_DOMAIN", "AMBIGUOUS"), fallback: str = "COMMENTARY") -> Column:
    """The intent that the first line of a router's answer names."""
    line = F.upper(trim_all(F.split_part(trim_all(text), F.lit("\n"), F.lit(1))))
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(line.startswith(name), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(fallback))


def first_text(*options: Column) -> Column:
    """The first text that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def snippet(rank: Column, label: Column, key: Column, text: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] ("), label, F.lit(" / "), key, F.lit(")\n"), text)


def chat_template(messages: Column) -> Column:
    """Turns as ``<|role|>`` lines, in order."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")


def first_of(messages: Column, role: str) -> Column:
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))


def last_of(messages: Column, role: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"], F.lit(""))
