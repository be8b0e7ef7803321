"""Byte-level BPE encoding and decoding with Spark higher-order functions.

A text is split by the tokenizer's pattern. Ranks are an array of small maps, dealt by the hash of the token, so that a look-up
costs the same for any vocabulary. It is a table of one row that expressions read as a scalar subquery: when a query runs
Spark puts the value into the plan as a literal, but neither the plan's text nor the optimizer holds it. A piece's bytes are folded: each step merges the leftmost adjacent
pair of lowest rank until none has a rank. Up to 64 bytes the state is one array of numbers (rank of the pair that a part begins,
place, id), and pairs of ids are looked up; longer pieces hold parts as texts, so that all places of a pair can merge in one step. Distinct pieces are counted over the whole corpus and folded once each; the most
frequent ones, up to a bound in bytes, are held in a second such table. Pieces beyond the bound, and those that stand once only, are folded where they stand. No document is shuffled. Decoding looks up the ids'
bytes in the vocabulary and concatenates them: for each piece when its ids are known, and a text's pieces are joined as bytes of both kinds.

Inside expressions a byte is a character from U+0000 to U+00FF; results are turned into binary at the end.

Defined results: null and empty texts have no tokens, and their digests are those of no bytes; an empty table gives an empty
table; repeated rows give repeated results; extra columns are kept, but for ones named ``ids`` and ``decoded``, which are
replaced; special tokens are ordinary text; a vocabulary without a rank for every byte is a ValueError.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept, scratch, stored

#: White space as the tokenizer's pattern means it (Unicode White_Space), for Java's engine.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Bytes of the table of frequent pieces (by estimate: what an entry takes besides its piece and ids, and for each byte of a piece).
HELD_BYTES, ENTRY, EACH = 54 << 20, 88, 3
#: Small maps of the ranks, of the pairs of ids, and of the table of frequent pieces.
BUCKETS, PAIR_BUCKETS, HELD_BUCKETS = 32_768, 131_072, 262_144
#: A byte in the table of first pairs: 256 stands for the fence.
_BYTES = 257
#: Bytes from which on all places of a pair are merged in one step where that gives the same parts.
LONG = 64
#: More than any list holds: a slice of so many takes what is left.
_REST = 1 << 30
#: What is known of a coded piece: its ids as bytes, and the bytes that they decode to.
CODED = "struct<i:string,d:string>"
_OPEN, _CLOSE, _FENCE = "Ā", "ā", "Ă"
#: A part as a number: rank of the pair it begins, its place (of ``LONG`` bytes and two fences), its id. The last id stands for none.
ID_BITS, PLACE_BITS = 24, 7
_NONE, _LOW = (1 << ID_BITS) - 1, ID_BITS + PLACE_BITS


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. Unlike a transform, an aggregate over nothing doesn't copy what it returns."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def java_pattern(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` written out, which Java limits to ASCII."""
    out, inside = "", False
    k = 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out, k = out + (_SPACE if inside else f"[{_SPACE}]"), k + 2
        elif two == r"\S":
            out, k = out + f"[^{_SPACE}]", k + 2
        elif two[0] == "\\":
            out, k = out + two, k + 2
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out, k = out + two[0], k + 1
    return out


def load_ranks(path: str) -> dict[str, int]:
    """A rank file (base64 token, rank on each line) as token in byte characters -> rank. Read by the driver only."""
    lines = Path(path).read_bytes().split(b"\n")
    return {base64.b64decode(t).decode("latin-1"): int(r) for t, r in (x.split() for x in lines if x.strip())}


def _one_row(entries: DataFrame, kind: str, buckets: int, tag: str) -> DataFrame:
    """A table of one row: array ``a`` of maps of type ``kind``; key k of the entries (k, v) stands in map hash(k) mod ``buckets``."""
    maps = entries.groupBy(F.pmod(F.hash("k"), F.lit(buckets)).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    rows = entries.sparkSession.range(buckets).withColumnRenamed("id", "b").join(stored(maps, tag), "b", "left")
    all_ = F.collect_list(F.struct("b", F.coalesce("m", F.create_map().cast(kind)).alias("m")))
    placed = rows.agg(F.array_sort(all_, lambda x, y: (x["b"] - y["b"]).cast("int")).alias("a"))
    return kept(placed.select(F.transform("a", lambda x: x["m"]).alias("a")), tag)


def _find(table: Column, key: Column, buckets: int | None = None) -> Column:
    return F.get(table, F.pmod(F.hash(key), F.lit(buckets or BUCKETS)))[key]


def _pairs(p: Column, ranks: Column) -> Column:
    """Ranks of the adjacent pairs of parts, null for pairs that have none."""
    return F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), _REST), lambda a, b: _find(ranks, F.concat(a, b)))


def _at_place(p: Column, r: Column, i: Column, ranks: Column) -> Column:
    """Parts and ranks after the pair at place i (from 1) is merged; only the two pairs that this makes are looked up."""
    body = lambda ab: F.struct(
        F.flatten(F.array(F.slice(p, F.lit(1), i - 1), F.array(ab), F.slice(p, i + 2, _REST))).alias("p"),
        F.flatten(
            F.array(
                F.slice(r, F.lit(1), i - 2),
                F.array(_find(ranks, F.concat(F.get(p, i - 2), ab)), _find(ranks, F.concat(ab, F.get(p, i + 1)))),
                F.slice(r, i + 2, _REST),
            )
        ).alias("r"),
    )
    return bind(F.concat(F.get(p, i - 1), F.get(p, i)), body)


def _at_all(p: Column, r: Column, i: Column, ranks: Column) -> Column:
    """Parts and ranks after all places of the pair at place i are merged, if one after another would give the same: no
    other pair has its rank m, and no pair that a merge makes, for good or until the next merge, comes before the rest."""
    a, b, m = F.get(p, i - 1), F.get(p, i), F.get(r, i - 1)
    alone = ~F.exists(F.zip_with(r, F.slice(p, F.lit(1), F.size(r)), lambda x, y: F.coalesce((x == m) & (y != a), F.lit(False))), lambda x: x)
    text = F.concat(F.lit(_OPEN), F.array_join(p, _CLOSE + _OPEN), F.lit(_CLOSE))
    pair, whole = F.concat(F.lit(_OPEN), a, F.lit(_CLOSE + _OPEN), b, F.lit(_CLOSE)), F.concat(F.lit(_OPEN), a, b, F.lit(_CLOSE))
    parts = bind(F.replace(text, pair, whole), lambda t: F.split(F.substring(t, F.lit(2), F.char_length(t) - 2), _CLOSE + _OPEN))
    above = lambda x: F.coalesce(x > m, F.lit(True))
    one = _at_place(p, r, i, ranks)
    both = lambda q: bind(_pairs(q, ranks), lambda s: F.when(above(F.array_min(s)) & above(_find(ranks, F.concat(a, b, a))), F.struct(q.alias("p"), s.alias("r"))).otherwise(one))
    return F.when(alone, bind(parts, both)).otherwise(one)


def _long(piece: Column, ranks: Column) -> Column:
    """Ids of a long piece: each step merges the leftmost pair of lowest rank. The ends are fenced by a character that no token
    has, so that every pair has neighbours."""
    fence, steps = F.array(F.lit(_FENCE)), F.sequence(F.lit(1), F.char_length(piece))
    start = bind(F.concat(fence, F.split(piece, ""), fence), lambda p: F.struct(p.alias("p"), _pairs(p, ranks).alias("r"), F.lit(False).alias("done")))
    state = lambda x, done: F.struct(x["p"].alias("p"), x["r"].alias("r"), F.lit(done).alias("done"))

    def step(s: Column, _: Column) -> Column:
        place = F.array_position(s["r"], F.array_min(s["r"])).cast("int")  # null where no pair has a rank
        merged = lambda i: bind(_at_all(s["p"], s["r"], i, ranks), lambda x: state(x, False))
        return F.when(s["done"], s).otherwise(bind(place, lambda i: F.when(i.isNull(), state(s, True)).otherwise(merged(i))))

    return F.aggregate(steps, start, step, lambda s: F.transform(F.slice(s["p"], F.lit(2), F.size(s["p"]) - 2), lambda p: _find(ranks, p)))


def _short(piece: Column, pairs: Column, first: Column) -> Column:
    """Ids of a piece of up to ``LONG`` bytes, by the same merges. As places grow from left to right and no two parts have the
    same, the least number is the leftmost pair of lowest rank. The numbers of single bytes, by the byte and the next one, are looked
    up in ``first``. A piece that is no token ends as two parts at least, so two steps fewer than bytes do."""
    fence, low, end = F.array(F.lit(_BYTES - 1)), F.lit((1 << _LOW) - 1), F.lit(_NONE << _LOW)
    # A number's index is counted by places: array_position throws an exception to leave its loop, which took most of a merge.
    places = F.lit((1 << _LOW) - 1 - _NONE)
    whose = lambda x: x.bitwiseAND(F.lit(_NONE))
    rank = lambda a, b: F.shiftleft(F.coalesce(_find(pairs, F.shiftleft(a, ID_BITS).bitwiseOR(b), PAIR_BUCKETS), F.lit(_NONE).cast("long")), _LOW)
    part = lambda f: lambda x, k: F.get(first, x * _BYTES + F.coalesce(F.get(f, k + 1), F.lit(_BYTES - 1))).bitwiseOR(F.shiftleft(k.cast("long"), ID_BITS))
    values = F.transform(F.split(piece, ""), lambda c: F.ascii(c))
    start = bind(F.concat(fence, values, fence), lambda f: F.transform(f, part(f)))

    def merged(s: Column, least: Column, i: Column) -> Column:
        before, new, after = F.get(s, i - 2), F.shiftright(least, _LOW), F.get(s, i + 1)
        two = bind(
            new,
            lambda n: F.array(
                rank(whose(before), n).bitwiseOR(before.bitwiseAND(low)),
                rank(n, whose(after)).bitwiseOR(least.bitwiseAND(F.lit((1 << _LOW) - 1 - _NONE))).bitwiseOR(n),
            ),
        )
        return F.flatten(F.array(F.slice(s, F.lit(1), i - 2), two, F.slice(s, i + 2, _REST)))

    def step(s: Column, _: Column) -> Column:
        upto = lambda least: bind(least.bitwiseAND(places), lambda p: F.size(F.filter(s, lambda x: x.bitwiseAND(places) <= p)))
        return bind(F.array_min(s), lambda least: F.when(least >= end, s).otherwise(bind(upto(least), lambda i: merged(s, least, i))))

    return F.aggregate(F.array_repeat(F.lit(0), F.char_length(piece) - 2), start, step, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: whose(x).cast("int")))


@dataclass(frozen=True)
class Tables:
    """What expressions look up: ranks by token, merged ids by pair of ids, bytes and code by id, parts by pair of single bytes,
    frequent pieces with their ids and what these decode to."""

    ranks: Column
    pairs: Column
    tokens: Column
    held: Column

    def fold(self, piece: Column) -> Column:
        """Ids of a piece (in byte characters): merges in order of rank."""
        known = F.when(F.char_length(piece) <= LONG, _short(piece, self.pairs, self.tokens["b"])).otherwise(_long(piece, self.ranks))
        return bind(_find(self.ranks, piece), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(known))

    def coded(self, piece: Column) -> Column:
        """A piece's ids as bytes, and the bytes that the vocabulary has for these ids."""
        joined = lambda ids, table: F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
        return bind(self.fold(_bytes_of(piece)), lambda ids: F.struct(joined(ids, self.tokens["i"]).alias("i"), joined(ids, self.tokens["d"]).alias("d")))


def _bytes_of(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _little_endian(i: Column) -> Column:
    """An id as four byte characters."""
    part = lambda k: F.chr(F.shiftright(i, k).bitwiseAND(F.lit(255)))
    return F.concat(part(0), part(8), part(16), part(24))


class Tokenizer:
    """Ranks and pattern, with the expressions that encode and decode."""

    def __init__(self, spark: SparkSession, ranks: dict[str, int], pattern: str):
        missing = [b for b in range(256) if chr(b) not in ranks]
        if missing or max(ranks.values()) >= _NONE:
            raise ValueError(f"every byte needs a rank (none for {missing[:5]}), and ranks must be below {_NONE}")
        self.pattern = java_pattern(pattern)
        # Placed by rank; a vocabulary is bounded. Ranks that no token has stay null.
        rows = spark.createDataFrame(list(ranks.items()), "k string, v int")
        with scratch(spark):
            self.ranks = _one_row(rows, "map<string,int>", BUCKETS, "bpe-ranks")
            # A token may be cut wherever both halves are tokens.
            long = F.col("v").cast("long")
            cuts = rows.where(F.char_length("k") > 1).select(long.alias("v"), "k", F.explode(F.sequence(F.lit(1), F.char_length("k") - 1)).alias("n"))
            cuts = cuts.select("v", F.left("k", F.col("n")).alias("a"), F.substring("k", F.col("n") + 1, F.lit(_REST)).alias("b"))
            cuts = cuts.join(rows.select(F.col("k").alias("a"), long.alias("x")), "a").join(rows.select(F.col("k").alias("b"), long.alias("y")), "b")
            self.pairs = _one_row(cuts.select(F.shiftleft("x", ID_BITS).bitwiseOR(F.col("y")).alias("k"), "v"), "map<bigint,bigint>", PAIR_BUCKETS, "bpe-pairs")
            # Dense arrays by id: each token's bytes, and each id as bytes; by byte and next byte: the part that begins there.
            known, last = F.map_from_entries(F.collect_list(F.struct("v", "k"))), max(ranks.values())
            ids = F.sequence(F.lit(0), F.lit(last))
            dense = sorted(ranks.values()) == list(range(len(ranks)))
            tokens = F.transform(F.array_sort(F.collect_list(F.struct("v", "k"))), lambda x: x["k"]) if dense else bind(known, lambda m: F.transform(ids, lambda i: m[i]))
            singles = [*(ranks[chr(b)] for b in range(256)), _NONE]
            inside = lambda a, b: ranks.get(chr(a) + chr(b), _NONE) if max(a, b) < _BYTES - 1 else _NONE
            first = spark.createDataFrame([([inside(a, b) << _LOW | singles[a] for a in range(_BYTES) for b in range(_BYTES)],)], "b array<bigint>")
            by_id = rows.agg(tokens.alias("d"), F.transform(ids, _little_endian).alias("i"))
            self.tokens = kept(by_id.crossJoin(first).select(F.struct("d", "i", "b").alias("a")), "bpe-tokens")

    def pieces(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def held(self, docs: DataFrame, text: str, most: int = HELD_BYTES) -> DataFrame | None:
        """The most frequent distinct pieces, encoded, as one row: an array of small maps. Counts are over the whole corpus;
        the pieces that are held take at most ``most`` bytes by estimate, of the last count that fits in part those of least
        hash. None if no piece stands twice."""
        size = F.lit(ENTRY) + EACH * F.octet_length("piece")
        with scratch(docs.sparkSession):
            counts = docs.select(F.explode(self.pieces(F.col(text))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
            counts = stored(counts.where("n > 1 and octet_length(piece) <= 64").withColumn("n", F.least("n", F.lit(1 << 16))), "bpe-pieces")
            least, share, room = 1, 1.0, most
            for n, b in counts.groupBy("n").agg(F.sum(size).alias("b")).orderBy(F.desc("n")).collect():
                least, share = n, min(1.0, room / b)
                if (room := room - b) <= 0:
                    break
            if least == 1:
                return None
            parts = 1 << 20
            chosen = counts.where((F.col("n") > least) | ((F.col("n") == least) & (F.pmod(F.xxhash64("piece"), F.lit(parts)) < int(share * parts))))
            # Few counts are read, but each piece is costly: dealt out by hash over all cores.
            chosen = chosen.select("piece").repartition(docs.sparkSession.sparkContext.defaultParallelism * 4, "piece")
            coded = self.with_tables(chosen, "v", lambda t: t.coded(F.col("piece")))
            return _one_row(coded.withColumnRenamed("piece", "k"), f"map<string,{CODED}>", HELD_BUCKETS, "bpe-held")

    def with_tables(self, rows: DataFrame, out: str, body: Callable[[Tables], Column], held: DataFrame | None = None) -> DataFrame:
        """``rows`` with a column of an expression over the tables. They are columns of their own for the analyser, which allows
        no subquery inside higher-order functions; each is named once, so the optimizer puts the subquery in its place and no
        row carries a table."""
        tables = {"__ranks__": self.ranks.scalar(), "__pairs__": self.pairs.scalar(), "__tokens__": self.tokens.scalar(), "__held__": F.lit(None) if held is None else held.scalar()}

        def bound(names: list[str], *columns: Column) -> Column:
            return bind(F.col(names[0]), lambda c: bound(names[1:], *columns, c)) if names else body(Tables(*columns))

        return rows.withColumns(tables).withColumn(out, bound(list(tables))).drop(*tables)

    def encode(self, docs: DataFrame, text: str = "text", most: int = HELD_BYTES) -> DataFrame:
        """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (binary, from the ids)."""
        held = self.held(docs, text, most)
        known = (lambda t, p: F.lit(None).cast(CODED)) if held is None else (lambda t, p: _find(t.held, p, HELD_BUCKETS))
        piece = lambda t: lambda p: F.coalesce(known(t, p), t.coded(p))
        joined = lambda c, f: F.encode(F.array_join(c[f], ""), "ISO-8859-1").alias(f)
        both = lambda c: F.struct(joined(c, "i"), joined(c, "d"))
        coded = self.with_tables(docs, "__coded__", lambda t: bind(F.transform(self.pieces(F.col(text)), piece(t)), both), held)
        return coded.withColumns({"ids": F.col("__coded__.i"), "decoded": F.col("__coded__.d")}).drop("__coded__")


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    coded = Tokenizer(docs.sparkSession, load_ranks(path), pattern).encode(docs.select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
