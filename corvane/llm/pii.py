"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped contextual extraction.

All of it is DataFrame expressions. Base kinds are found by patterns and checked (ranges, Luhn, digits). Candidates are
words of letters and digits outside base spans; each has a lexical pattern (the word and marks before it) and a shape pattern
(hex digits or a key's prefix with the length, else the classes of its characters). Seeds (known key formats, values assigned to names of secrets) have
score 1; instances after a word that names something else (``NEGATIVES``) have 0, and so has whatever stands in prose without a lexical pattern.
Patterns are scored by the mean score of their distinct instances, other instances by their two
patterns (noisy or), for a fixed number of rounds over the pattern-instance graph; patterns of high confidence then discover identifiers that no seed
has. A plain word before a blank is no lexical pattern, since in prose any word may follow it. A shape alone is never enough: checksums look like
keys. It counts only where something is assigned. Numbers are identifiers by their lexical pattern only. The most frequent patterns are literals; all others are joined.

Defined results: null text is empty and has no spans; an empty table gives an empty table; ``extract`` keeps extra columns but
for ones named ``base`` and ``found``; without candidates nothing is learned and only base spans are found;
spans of the method that overlap a base span are dropped; offsets are code points, ends exclusive; repeated rows give
repeated results and count once as instances.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept, scratch, stored
from .quality import let

# The base patterns, written so that a run of characters is entered only at its start and never backtracked.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Words of at least eight letters, digits, ``_``, ``-`` or ``/``, one of them a digit, with a letter or digit at both ends.
CANDIDATE = r"(?<![A-Za-z0-9_/-])(?=[A-Za-z_/-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_/-]{6,}(?<=[A-Za-z0-9])(?![A-Za-z0-9])"
#: Seed entities besides base matches: a public format of access keys, and what is assigned to a name of a secret. A run of
#: hex digits alone is none: checksums look the same.
SEEDS, SECRETS = r"^AKIA[0-9A-Z]{16}$", r"^(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|apikey|auth)[^\p{L}\p{N}_]{1,5}$\z"
#: Words before a value that is public: such an instance counts against its shape, and its own lexical pattern is never accepted.
NEGATIVES = r"^(?:commit|sha|md|digest|checksum|hash|etag|rev|revision|version|isbn|issn|doi|iso|utf|rfc|uuid|page|line|section|figure|table|build|release)[^\p{L}\p{N}_]{1,5}$\z"
#: Marks by which something is assigned.
ASSIGNED = "[=:>]"
#: Rounds over the graph, least confidence of an accepted pattern, distinct instances it needs, patterns of a kind held as literals.
ROUNDS, CONFIDENCE, INSTANCES, PATTERNS = 6, 0.8, 5, 500
#: Up to so many further patterns are sent to all tasks; beyond, candidates are shuffled, each pattern's over so many parts.
BROADCAST_ROWS, PARTS = 200_000, 16


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        x = F.ascii(c) - 48
        return F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, F.lit(9)).otherwise(F.lit(0)))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.char_length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """All leftmost matches as array of start, value, before (the text since the match before)."""
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,value:string,before:string>>")

    def add(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.char_length(z["before"])
        return F.struct(
            (start + F.char_length(z["value"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), z["value"].alias("value"), z["before"].alias("before")))).alias("out"),
        )

    def walk(found: Column) -> Column:
        zipped = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("before"), m.alias("value")))
        return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda a: a["out"])

    return let(matches, lambda found: F.when(F.size(found) == 0, empty).otherwise(walk(found)))


def _span(kind: Column | str, m: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.char_length(m["value"])).alias("end"))


_EMPTY = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind, then start."""

    def of(kind: str) -> Column:
        spans = F.transform(F.filter(located(text, KINDS[kind]), lambda m: _holds(kind, m["value"])), lambda m: _span(kind, m))
        may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
        return F.when(may, spans).otherwise(F.array().cast(_EMPTY))

    return F.concat(*[of(k) for k in KINDS])


def _lexical(before: Column) -> Column:
    """The word before a candidate with the marks between, lower-cased; null for a plain blank."""
    near = F.regexp_extract(F.lower(F.right(before, F.lit(40))), r"([\p{L}_]{2,20}[^\p{L}\p{N}]{1,5})$", 1)
    return F.when(near.rlike(r"[^\p{L}_\s]"), near)


def _shape(value: Column) -> Column:
    return (
        F.when(value.rlike("^[0-9]+$"), F.concat(F.lit("digits:"), F.char_length(value)))
        .when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.concat(F.lit("hex:"), F.char_length(value)))
        .when(value.rlike("^[A-Z]{3,5}[0-9A-Z]+$"), F.concat(F.lit("key:"), F.left(value, F.lit(4)), F.lit(":"), F.char_length(value)))
        .otherwise(F.concat(F.lit("form:"), F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[B-Z]", "A"), "[0-9]", "9")))
    )


def candidates(text: Column) -> Column:
    """Candidates as array of start, value, lexical, shape."""
    found = F.transform(located(text, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), m["value"].alias("value"), _lexical(m["before"]).alias("lexical"), _shape(m["value"]).alias("shape")))
    none = F.array().cast("array<struct<start:int,value:string,lexical:string,shape:string>>")
    return F.when(text.rlike("[0-9]"), found).otherwise(none)


def _overlaps(spans: Column, start: Column, value: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < start + F.char_length(value)) & (start < s["end"]))


def _is_seed(c: Column) -> Column:
    return c["value"].rlike(SEEDS) | F.coalesce(c["lexical"].rlike(SECRETS), F.lit(False))


def _negative(lexical: Column) -> Column:
    return F.coalesce(lexical.rlike(NEGATIVES), F.lit(False))


def _shape_counts(c: Column) -> Column:
    """Whether the shape may make this candidate an identifier: letters in it, and assigned to something that isn't public."""
    return c["value"].rlike("[A-Za-z]") & F.coalesce(c["lexical"].rlike(ASSIGNED), F.lit(False)) & ~_negative(c["lexical"])


@dataclass(frozen=True)
class Patterns:
    """Accepted patterns: the most frequent of each kind, and a table (kind, pattern) of all others if there are any."""

    lexical: tuple[str, ...] = ()
    shape: tuple[str, ...] = ()
    rest: DataFrame | None = None


def bootstrap(docs: DataFrame, text: str = "text") -> Patterns:
    """Patterns of high confidence, learned from all documents. Instances are counted once however often they stand."""
    body = F.coalesce(F.col(text), F.lit(""))
    with scratch(docs.sparkSession):
        arrays = docs.where(body.rlike("[0-9]")).select(base_spans(body).alias("b"), candidates(body).alias("cs"))
        # Pieces of e-mail addresses and the like are no instances: they'd make their shapes those of identifiers.
        outside = F.filter("cs", lambda c: ~_overlaps(F.col("b"), c["start"], c["value"]))
        found = arrays.select(F.explode(outside).alias("c"))
        seed = _is_seed(F.col("c"))
        graph = stored(found.select("c.value", "c.lexical", "c.shape", seed.alias("seed")).groupBy("value", "lexical", "shape").agg(F.max("seed").alias("seed")), "pii-graph")
        scored = graph.withColumn("score", F.col("seed").cast("double"))
        patterns: dict[str, DataFrame] = {}
        for _ in range(ROUNDS):
            for kind in ("lexical", "shape"):
                rows = scored.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
                patterns[kind] = stored(rows.select(kind, (F.col("s") / (F.col("n") + 1)).alias(f"{kind}_score"), "n"), "pii-patterns")
            # Most instances have no lexical pattern: a key of their own each, so that nulls don't meet in one task.
            keyed = graph.withColumn("__l__", F.coalesce("lexical", F.concat(F.lit("\x00"), "value")))
            linked = keyed.join(patterns["lexical"].drop("n").withColumnRenamed("lexical", "__l__"), "__l__", "left").drop("__l__")
            # A frequent shape's instances can be split over tasks: its score is one row.
            linked = linked.join(patterns["shape"].drop("n"), "shape", "left")
            either = 1 - (1 - F.coalesce("lexical_score", F.lit(0.0))) * (1 - F.coalesce("shape_score", F.lit(0.0)))
            scored = stored(linked.select("value", "lexical", "shape", "seed", F.when(F.col("seed"), F.lit(1.0)).when(_negative(F.col("lexical")) | F.col("lexical").isNull(), F.lit(0.0)).otherwise(either).alias("score")), "pii-scores")
        best, rest = {}, []
        for kind, rows in patterns.items():
            accepted = rows.where((F.col(f"{kind}_score") >= CONFIDENCE) & (F.col("n") >= INSTANCES))
            accepted = accepted.where(~_negative(F.col(kind))) if kind == "lexical" else accepted
            top = [r[kind] for r in accepted.orderBy(F.desc("n"), kind).limit(PATTERNS + 1).collect()]
            best[kind] = tuple(top[:PATTERNS])
            if len(top) > PATTERNS:
                rest.append(accepted.where(~F.col(kind).isin(*best[kind])).select(F.lit(kind).alias("kind"), F.col(kind).alias("pattern")))
        return Patterns(**best, rest=kept(reduce(DataFrame.union, rest), "pii-rest") if rest else None)


def _joined(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """``rows`` with ``starts``: places of the open candidates that have one of the patterns."""
    c, part = F.col("c"), F.pmod(F.col("row"), F.lit(PARTS)).alias("part")
    kinds = F.array(F.struct(F.lit("lexical").alias("kind"), c["lexical"].alias("pattern")), F.struct(F.lit("shape").alias("kind"), F.when(c["shaped"], c["shape"]).alias("pattern")))
    keys = rows.select("row", F.explode(F.filter("cs", lambda x: ~x["known"])).alias("c")).select("row", part, c["start"].alias("start"), F.explode(kinds).alias("k"))
    keys = keys.where(F.col("k.pattern").isNotNull()).select("row", "part", "start", "k.kind", "k.pattern")
    if rest.count() <= BROADCAST_ROWS:
        hits = keys.join(F.broadcast(rest), ["kind", "pattern"], "left_semi")
    else:
        spread = rest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        hits = keys.join(spread, ["kind", "pattern", "part"], "left_semi")
    # A document's own candidates bound the list.
    return rows.join(hits.groupBy("row").agg(F.collect_set("start").alias("starts")), "row", "left")


def extract(docs: DataFrame, patterns: Patterns, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``base`` and ``found`` (spans of the method, kind ``id``)."""
    body = F.coalesce(F.col(text), F.lit(""))
    known = lambda c, names: F.coalesce(c.isin(*names), F.lit(False)) if names else F.lit(False)
    chosen = lambda c: _is_seed(c) | known(c["lexical"], patterns.lexical) | (_shape_counts(c) & known(c["shape"], patterns.shape))
    free = lambda c: ~_overlaps(F.col("base"), c["start"], c["value"])
    based = docs.withColumn("base", base_spans(body))
    if patterns.rest is None:
        return based.withColumn("found", F.transform(F.filter(candidates(body), lambda c: chosen(c) & free(c)), lambda c: _span("id", c))).drop(text)
    judged = F.transform(F.filter(candidates(body), free), lambda c: F.struct(c["start"].alias("start"), c["value"].alias("value"), c["lexical"].alias("lexical"), c["shape"].alias("shape"), _shape_counts(c).alias("shaped"), chosen(c).alias("known")))
    rows = kept(based.withColumn("cs", judged).drop(text).withColumn("row", F.monotonically_increasing_id()), "pii-candidates")
    passed = F.filter("cs", lambda c: c["known"] | F.coalesce(F.array_contains("starts", c["start"]), F.lit(False)))
    return _joined(rows, patterns.rest).withColumn("found", F.transform(passed, lambda c: _span("id", c))).drop("row", "cs", "starts")


def report(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "text")
    spans = extract(own, bootstrap(own))
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        shown(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_id"),
        (F.size("base") + F.size("found")).cast("long").alias("n_spans"),
        (F.size("base") + F.size("found") > 0).alias("private"),
    )
