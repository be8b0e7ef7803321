"""Chat formatting: heterogeneous records to one template, with a loss mask.

Each JSON record is fingerprinted: the hash of its sorted nested field paths, restricted to the paths that any declared
layout names. The fingerprint selects a declarative mapping that yields canonical turns; these are put into a template whose
control strings are escaped inside roles and texts, so that the formatted text can be parsed back exactly.

A record of several layouts' paths takes the one of most paths.

Defined results: null texts and roles are empty; a record in which no layout has all its paths, that is no JSON object or
that nests too deeply to be read, gets layout null and no turns (``layout_counts`` counts them); extra fields don't change
the layout; turns with equal numbers go by role, then text, null turns come first; repeated rows are kept as turns of their
own; a null conv_id is a conversation; extra columns are kept by ``format_records`` but for ones named like what it adds,
and ignored by the report; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# --- layouts ---------------------------------------------------------------------------------------------------------
#: name -> steps. ("each", list path, role field, text field), ("turn", role, path) or ("join", role, paths).
LAYOUTS: dict[str, tuple[tuple, ...]] = {
    "messages": (("each", "messages", "role", "content"),),
    "messages_text": (("each", "messages", "role", "text"),),
    "messages_parts": (("each", "messages", "role", "content[].text"),),
    "messages_system": (("turn", "system", "system"), ("each", "messages", "role", "content")),
    "sharegpt": (("each", "conversations", "from", "value"),),
    "sharegpt_system": (("turn", "system", "system"), ("each", "conversations", "from", "value")),
    "dialogue": (("each", "dialogue", "speaker", "text"),),
    "prompt_response": (("turn", "user", "prompt"), ("turn", "assistant", "response")),
    "prompt_completion": (("turn", "user", "prompt"), ("turn", "assistant", "completion")),
    "instruction": (("turn", "user", "instruction"), ("turn", "assistant", "output")),
    "instruction_input": (("join", "user", ("instruction", "input")), ("turn", "assistant", "output")),
    "question_answer": (("turn", "user", "question"), ("turn", "assistant", "answer")),
    "system_question": (("turn", "system", "system"), ("turn", "user", "question"), ("turn", "assistant", "answer")),
    "nested_prompt": (("turn", "user", "data.prompt"), ("turn", "assistant", "data.response")),
}
#: Other names of roles, in layouts that don't call the field a role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _declared(steps: tuple[tuple, ...]) -> set[str]:
    out: set[str] = set()
    for step in steps:
        if step[0] == "each":
            out |= {f"{step[1]}[].{step[2]}", f"{step[1]}[].{step[3]}"}
        else:
            out |= {step[2]} if step[0] == "turn" else set(step[2])
    return out


KNOWN = frozenset(p for steps in LAYOUTS.values() for p in _declared(steps))


def paths(value: Any, at: str = "") -> Iterator[str]:
    """Nested field paths of a record's leaves; list items share ``[]``."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from paths(v, f"{at}.{k}" if at else str(k))
    elif isinstance(value, list):
        for v in value:
            yield from paths(v, f"{at}[]")
    else:
        yield at


def fingerprint(found: Iterator[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(KNOWN.intersection(found))).encode()).hexdigest()


MAPPINGS: dict[str, str | None] = {fingerprint(_declared(steps)): name for name, steps in LAYOUTS.items()}


def layout_of(found: set[str]) -> str | None:
    """The layout that the fingerprint of a record's paths selects. For a fingerprint that isn't declared as such it is the
    layout of most paths, all of which are there (the first declared on ties); the choice is remembered with it."""
    key = fingerprint(found)
    if key not in MAPPINGS:
        fits = [(len(d), name) for name, steps in LAYOUTS.items() if (d := _declared(steps)) <= found]
        MAPPINGS[key] = max(fits, key=lambda x: x[0])[1] if fits else None
    return MAPPINGS[key]


def _get(value: Any, path: str) -> Any:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _field(item: dict, path: str) -> str:
    """A list item's text; ``a[].b`` joins the field b of all parts of a, and takes a plain text as it is."""
    name, parts, inner = path.partition("[].")
    value = item.get(name)
    if not parts or not isinstance(value, list):
        return _text(value)
    return "".join(_text(x.get(inner) if isinstance(x, dict) else x) for x in value)


def canonical(value: Any) -> tuple[str | None, list[tuple[str, str]]]:
    """The layout of a record and its turns as (role, text)."""
    name = layout_of(set(paths(value))) if isinstance(value, dict) else None
    turns: list[tuple[str, str]] = []
    for step in LAYOUTS.get(name or "", ()):
        if step[0] == "each":
            names = {} if step[2] == "role" else ROLES
            turns += [(names.get(r := _text(x.get(step[2])), r), _field(x, step[3])) for x in _get(value, step[1]) or () if isinstance(x, dict)]
        elif step[0] == "turn":
            turns.append((step[1], _text(_get(value, step[2]))))
        else:
            turns.append((step[1], "\n\n".join(t for p in step[2] if (t := _text(_get(value, p))))))
    return name, turns


# --- template --------------------------------------------------------------------------------------------------------
OPEN, CLOSE, ESC = "<|turn|>", "<|end|>\n", "␛"
#: Control strings of this and other public templates. After the first character of each an escape is put.
_CONTROL = re.compile(r"<\||</?s>|\[/?INST\]|<</?SYS>>|</?(?:bos|eos|start_of_turn|end_of_turn|pad|unk)>")
_BACK = {ESC + "0": ESC, ESC + "1": "", ESC + "2": "\n"}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}{ESC}1{m[0][1:]}", text.replace(ESC, ESC + "0"))


def unescape(text: str) -> str:
    return re.sub(f"{ESC}[012]", lambda m: _BACK[m[0]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of it (code points, end exclusive) that count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(chr(10), ESC + '2')}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(OPEN)[1:]:
        head, _, body = part.partition("\n")
        turns.append((unescape(head), unescape(body.removesuffix(CLOSE))))
    return turns


def format_records(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` without its JSON column, with ``layout``, ``formatted`` and ``loss_spans`` added. No shuffle."""
    keep = [f for f in records.schema.fields if f.name not in (record, "layout", "formatted", "loss_spans")]
    names = [f.name for f in keep]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        layouts, texts, masks = [], [], []
        for raw in batch.column(len(names)).to_pylist():
            try:
                layout, turns = canonical(json.loads(raw) if raw else None)
            except (ValueError, RecursionError):  # no JSON, or nested deeper than any layout
                layout, turns = None, []
            text, spans = render(turns)
            layouts.append(layout)
            texts.append(text)
            masks.append([{"start": s, "end": e} for s, e in spans])
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(layouts, pa.string()), pa.array(texts, pa.string()), pa.array(masks, spans_type)], [*names, "layout", "formatted", "loss_spans"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "layout string, formatted string, loss_spans array<struct<start:long,end:long>>"])
    return map_batches(records.select(*[F.col(f"`{c}`") for c in names], F.col(record)), run, ddl)


#: Turns of a conversation that are gathered into one record.
PART = 64


#: Layouts in which conversations are written, by what their turns allow.
LISTS, PAIRS = ("messages", "messages_text", "messages_parts", "sharegpt", "dialogue"), ("prompt_response", "prompt_completion", "instruction", "question_answer", "nested_prompt")


def conversation_records(rows: DataFrame) -> DataFrame:
    """Flat rows (conv_id, turn, role, text) as JSON records of different layouts, dealt by conv_id. A record has at most
    ``PART`` turn numbers, so that a conversation with very many rows is first gathered in parts by many tasks. Layouts
    that rename roles take conversations of plain roles only; pairs take a user's and then an assistant's turn."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    parts = rows.groupBy("conv_id", F.floor(F.col("turn") / PART).alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    renamed = lambda t: F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"])
    each = lambda name, role, text, body=lambda t: t["content"], of=lambda t: t["role"]: F.struct(F.transform("turns", lambda t: F.struct(of(t).alias(role), body(t).alias(text))).alias(name))
    said = lambda k: F.get("turns", F.lit(k))["content"]
    two = lambda a, b, first=0: F.struct(said(first).alias(a), said(first + 1).alias(b))
    shaped = {
        "messages": each("messages", "role", "content"),
        "messages_text": each("messages", "role", "text"),
        "messages_parts": each("messages", "role", "content", lambda t: F.array(F.struct(F.lit("text").alias("type"), t["content"].alias("text")))),
        "sharegpt": each("conversations", "from", "value", of=renamed),
        "dialogue": each("dialogue", "speaker", "text", of=renamed),
        "prompt_response": two("prompt", "response"),
        "prompt_completion": two("prompt", "completion"),
        "instruction": two("instruction", "output"),
        "question_answer": two("question", "answer"),
        "nested_prompt": F.struct(two("prompt", "response").alias("data")),
        "system_question": F.struct(said(0).alias("system"), said(1).alias("question"), said(2).alias("answer")),
    }
    roles = F.transform("turns", lambda t: t["role"])
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    dealt = lambda names: F.get(F.array(*map(F.lit, names)), F.pmod(F.xxhash64("conv_id"), F.lit(len(names))).cast("int"))
    plain = F.forall("turns", lambda t: t["role"].isin("user", "assistant", "system"))
    layout = F.when(is_("user", "assistant"), dealt(PAIRS)).when(is_("system", "user", "assistant"), F.lit("system_question")).when(plain, dealt(LISTS)).otherwise(F.lit("messages"))
    record = F.lit(None).cast("string")
    for name, shape in shaped.items():
        record = F.when(F.col("layout") == name, F.to_json(shape)).otherwise(record)
    return parts.withColumn("layout", layout).select("conv_id", "part", record.alias("record"))


def layout_counts(formatted: DataFrame) -> DataFrame:
    """layout, n: how many records each layout took; null counts those that none fits, whose turns are not formatted."""
    return formatted.groupBy("layout").agg(F.count(F.lit(1)).alias("n"))


def join_parts(formatted: DataFrame) -> DataFrame:
    """Parts of each conversation in order: the template has nothing outside turns, so formatted parts concatenate."""
    whole = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "formatted", "loss_spans"))).alias("p"))
    starts = F.transform("p", lambda x, i: F.aggregate(F.slice("p", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + F.char_length(y["formatted"])))
    spans = F.flatten(F.transform(F.arrays_zip(F.col("p").alias("p"), starts.alias("at")), lambda z: F.transform(z["p"]["loss_spans"], lambda s: F.struct((s["start"] + z["at"]).alias("start"), (s["end"] + z["at"]).alias("end")))))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["formatted"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The contract's digests, taken from the formatted texts and masks alone."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for conv_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            turns = parse(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_batches(formatted.select("conv_id", "formatted", "loss_spans"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def report(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -7, whose texts are control strings themselves."""
    spark = conversations.sparkSession
    own = "</s>[INST] ok [/INST]"
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(
        spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    )
    return read_back(join_parts(format_records(conversation_records(rows))))
