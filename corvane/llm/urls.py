"""URL filter: rules by host and start of path, found in a sorted array of digests.

Rules (host, path, verdict) become two sorted arrays of 64-bit xxhash digests in a folder that all executors share: one of
rules, one of hosts with the lengths of their rules' paths. Spark sorts the digests by range; each range is a shard of three
files (digests, ends, strings), so a list has no bound on its size. Tasks map the shards' files into memory, probe them with
a vectorised binary search, and compare the stored strings, so that equal digests of different strings never match. A URL
asks for its host and all parent domains first, and then only for starts of its path that are as long as a rule of that host.

URLs are judged where they are read, without a shuffle: a frequent host costs no more than others.

Defined results: a null URL and one without ``://`` have an empty host and path, which no rule fits, and so get the default
verdict. Rules without host, with a null verdict or a null path (read as empty) are the same: those without host are dropped, of rules with equal
host and path the least verdict ("allow") stays. Of several rules that fit, the longest (host and path together) wins, then the longer host.
Rows that repeat are judged alike; an empty table gives no rows, an empty list the default verdict. Other columns stay as
they are, but for one named as the added column.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, stored
from .warc import file_system

#: The seed of Spark's xxhash64.
SEED = 42
#: Rules of a shard, about.
SHARD_ROWS = 4_000_000
# The contract's rules, in its order.
BASE = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
# Names that public pages can't have, by RFC 6761, 6762, 7686 and 8375.
SPECIAL = ["test", "invalid", "localhost", "local", "onion", "home.arpa"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, lower)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Shard:
    """A range of digests and its files: 64-bit digests, 64-bit ends of the strings, the strings."""

    first: int
    last: int
    path: str


def _files(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shard's arrays: mapped where the folder is mounted, read from other storage."""
    fs, name = file_system(path)
    out = []
    for part, kind in (("digests", np.uint64), ("ends", np.uint64), ("strings", np.uint8)):
        if isinstance(fs, pafs.LocalFileSystem):
            out.append(np.memmap(f"{name}.{part}", dtype=kind, mode="r"))
        else:
            with fs.open_input_file(f"{name}.{part}") as f:
                out.append(np.frombuffer(f.read_buffer(), dtype=kind))
    return tuple(out)


@dataclass
class DigestArray:
    """Strings by digest. Files are opened in the task that probes them, when a probe falls into their range."""

    shards: list[Shard]
    _open: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"shards": self.shards, "_open": {}}

    def find(self, asked: list[bytes]) -> list[bytes | None]:
        """For each string the stored one that starts with it and a line feed (what follows is its value), or None."""
        out: list[bytes | None] = [None] * len(asked)
        if not asked or not self.shards:
            return out
        digests = np.array([xxhash.xxh64_intdigest(x, SEED) for x in asked], dtype=np.uint64)
        lasts = np.array([s.last for s in self.shards], dtype=np.uint64)
        shard = np.searchsorted(lasts, digests)
        for k in np.unique(shard[shard < len(lasts)]).tolist():
            if k not in self._open:
                self._open[k] = _files(self.shards[k].path)
            keys, ends, text = self._open[k]
            own = np.flatnonzero(shard == k)
            low = np.searchsorted(keys, digests[own])
            high = np.searchsorted(keys, digests[own], side="right")
            for i, a, b in zip(own[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                for j in range(a, b):
                    one = text[int(ends[j - 1]) if j else 0 : int(ends[j])].tobytes()
                    if one.startswith(asked[i] + b"\n"):
                        out[i] = one[len(asked[i]) + 1 :]
                        break
        return out


def digest_array(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DigestArray:
    """The sorted array of ``rows`` (name, value), written shard by shard; names are distinct and hold no line feed."""
    folder = shared_path(rows.sparkSession, "digests")
    # As signed numbers with the highest bit turned, digests sort as the unsigned ones do.
    low = F.lit(-(1 << 63)).cast("long")
    held = stored(rows.select(F.xxhash64("name").bitwiseXOR(low).alias("d"), F.concat("name", F.lit("\n"), "value").alias("s")), "digest-rows")
    parts = -(-max(1, held.count()) // shard_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, first, last, end, files = uuid.uuid4().hex, None, None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                fs.create_dir(root, recursive=True)
                files = [fs.open_output_stream(f"{root}/{name}.{p}", compression=None) for p in ("digests", "ends", "strings")]
            digests = batch.column(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            texts = [x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            ends = end + np.cumsum([len(x) for x in texts]).astype(np.uint64)
            for f, data in zip(files, (digests.tobytes(), ends.tobytes(), b"".join(texts))):
                f.write(data)
            first, last, end = int(digests[0]) if first is None else first, int(digests[-1]), int(ends[-1])
        if files is not None:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({"first": [str(first)], "last": [str(last)], "path": [f"{folder}/{name}"]})

    # A task that runs again writes other files; only those that its row names are read.
    listed = stored(held.repartitionByRange(parts, "d").sortWithinPartitions("d", "s").mapInArrow(run, "first string, last string, path string"), "digest-shards")
    return DigestArray(sorted((Shard(int(r["first"]), int(r["last"]), r["path"]) for r in listed.collect()), key=lambda s: s.first))


@dataclass
class RuleList:
    rules: DigestArray
    hosts: DigestArray

    def judged(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[bytes, bytes] | None]:
        """rule and verdict for each URL, or None."""
        labels = [[h, *(h[i + 1 :] for i, c in enumerate(h) if c == 46)] if h else [] for h in hosts]
        names = {name for own in labels for name in own}
        listed = list(names)
        lengths = {n: [int(x) for x in v.split(b",")] for n, v in zip(listed, self.hosts.find(listed)) if v is not None}
        asked = [[(name, path[:k]) for name in own if name in lengths for k in lengths[name] if k <= len(path)] for own, path in zip(labels, paths)]
        rules = list({h + p for own in asked for h, p in own})
        verdicts = {r: v for r, v in zip(rules, self.rules.find(rules)) if v is not None}
        best = [max(((len(h) + len(p), len(h), h + p) for h, p in own if h + p in verdicts), default=None) for own in asked]
        return [b and (b[2], verdicts[b[2]]) for b in best]


def rule_list(rules: DataFrame, shard_rows: int = SHARD_ROWS) -> RuleList:
    """Arrays of ``rules`` (host, path, verdict)."""
    rules = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' and verdict is not null")
    # A path begins with a slash, so host and path can be told apart in a rule's name; others never fit a URL.
    rules = rules.where("(path = '' or startswith(path, '/')) and not contains(host, '\n') and not contains(host, '/') and not contains(path, '\n')")
    rules = stored(rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")), "rules")
    hosts = rules.groupBy("host").agg(F.array_join(F.array_sort(F.collect_set(F.octet_length("path").cast("string"))), ",").alias("value"))
    return RuleList(
        digest_array(rules.select(F.concat("host", "path").alias("name"), F.col("verdict").alias("value")), shard_rows),
        digest_array(hosts.withColumnRenamed("host", "name"), shard_rows),
    )


def with_verdicts(pages: DataFrame, rules: RuleList, url: str = "url", default: str = "allow", added: str = "__url__") -> DataFrame:
    """``pages`` with a struct ``added``: host, path, the rule that fits or null, and its verdict or ``default``."""

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def judged(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        pairs = list(zip(hosts.cast(pa.binary()).to_pylist(), paths.cast(pa.binary()).to_pylist()))
        known = list(set(pairs))
        found = dict(zip(known, rules.judged([h for h, _ in known], [p for _, p in known])))
        own = [found[x] for x in pairs]
        rule = pa.array([r and r[0].decode("utf-8", "replace") for r in own], pa.string())
        return pa.StructArray.from_arrays([rule, pa.array([r[1].decode() if r else default for r in own], pa.string())], ["rule", "verdict"])

    # As a non-deterministic one it is evaluated here, once, and not inside expressions that use it.
    parts = pages.withColumn(added, F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")))
    found = parts.withColumn(added, F.struct(f"{added}.host", f"{added}.path", judged.asNondeterministic()(f"{added}.host", f"{added}.path").alias("found")))
    return found.withColumn(added, F.struct(f"{added}.host", f"{added}.path", f"{added}.found.rule", f"{added}.found.verdict"))


def default_rules(spark: SparkSession) -> DataFrame:
    """The contract's rules and the special-use names, which are blocked."""
    rows = BASE + [(name, "", "block") for name in SPECIAL]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def report(pages: DataFrame) -> DataFrame:
    made = with_verdicts(pages.select("page_id", "url"), rule_list(default_rules(pages.sparkSession)))
    return made.select("page_id", "__url__.host", "__url__.path", "__url__.rule", "__url__.verdict")
