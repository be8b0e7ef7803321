"""The training-data operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, langid, licenses, line_dedup, ngram_join, periodic, pii, quality, urls, warc, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(table(spark, sf_dir, "pages"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_decontamination, op4_pii, op5_byte_bpe, op6_ngram_join, op7_language_id, op8_line_dedup, op9_warc, op10_chat_format, op11_url_filter, op12_periodic_runs, op13_whitening, pipeline)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce({{0}}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""with items as (select item_id, w, least(13, len(w)) as n from (select item_id, {WORDS.format("text")} as w from benchmark) where len(w) > 0),
  wins as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as i from items)),
  docs as (select doc_id, {WORDS.format("text")} as w from documents),
  places as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from wins) where len(w) >= n)),
  hits as (select doc_id, i, p.n, item_id from places p join wins using (n, g)),
  words as (select doc_id, count(distinct k) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as k from hits) group by 1),
  found as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hits) group by 1)
  select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from docs d left join words using (doc_id) left join found using (doc_id)"""

OP6 = f"""with recursive docs as (select doc_id, {WORDS.format("text")} as w from documents),
  sets as (select doc_id, case when len(w) = 0 then [] else list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) end as g from docs),
  keyed as (select doc_id, g, case when len(g) = 0 then 'none' || doc_id else array_to_string(g, '|') end as k from sets),
  classes as (select min(doc_id) as c, count(*) as copies, k, any_value(g) as g from keyed group by k),
  grams as (select c, len(g) as n, unnest(g) as x from classes),
  pairs as (select a.c as a, b.c as b from grams a join grams b using (x) where a.c < b.c group by a.c, b.c, a.n, b.n having count(*) / (a.n + b.n - count(*)) >= 0.8),
  edges as (select a, b from pairs union all select b, a from pairs),
  reach as (select c as a, c as b from classes union select r.a, e.b from reach r join edges e on r.b = e.a),
  heads as (select a, min(b) as head from reach group by a),
  links as (select e.a, sum(copies)::bigint as weight, count(*) as n from edges e join classes on c = e.b group by e.a)
  select d.doc_id, head as class_id, c as copy_class, copies - 1 + coalesce(weight, 0) as n_links, coalesce(n, 0) as n_class_links
  from keyed d join classes using (k) join heads h on h.a = c left join links l on l.a = c"""

OP8 = r"""with lines as (select doc_id, i - 1 as line, list_filter(regexp_split_to_array(ls[i], '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') as w from
    (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents))),
  own as (select *, row_number() over (order by doc_id, line) as o from lines where len(w) > 0),
  firsts as (select w, min(o) as o, len(w) as n from own group by w),
  subs as (select o, n || ':' || i || ':' || array_to_string(w[1:i - 1], ' ') || chr(10) || array_to_string(w[i + 1:], ' ') as k from (select *, unnest(range(1, n + 1)) as i from firsts where n >= 8)),
  dels as (select o, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') as k from (select *, unnest(range(1, n + 1)) as i from firsts where n >= 8)),
  whole as (select o, array_to_string(w, ' ') as k from firsts where n >= 7),
  lost as (select b.o from subs a join subs b using (k) where a.o < b.o union select greatest(a.o, b.o) from whole a join dels b using (k)),
  judged as (select l.doc_id, l.line, f.o in (select o from lost) as near, l.o <> f.o or f.o in (select o from lost) as gone from own l join firsts f on l.w = f.w)
  select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, count(*) filter (near) as n_near, coalesce(string_agg(line::varchar, ',' order by line) filter (gone), '') as removed from judged group by doc_id"""

OP9 = """select page_id, octet_length(encode(p)) as payload_bytes, sha1(p) as payload_digest, case when big and page_id <> m then 'revisit' else 'response' end as record_type,
  case when big and page_id <> m then m end as refers_to from (select page_id, p, octet_length(encode(p)) >= 1000 as big, max(page_id) over (partition by p) as m from (select page_id, coalesce(html, '') as p from pages))"""

OP10 = r"""with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
  coded as (select *, length(regexp_replace(replace(text, '␛', '␛0'), '(<\||</?s>|\[/?INST\]|<</?SYS>>|</?(?:bos|eos|start_of_turn|end_of_turn|pad|unk)>)', '\1..', 'g')) as n from turns)
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(17 + length(role) + n) as bigint) as formatted_chars from coded group by conv_id"""


_RULES = ", ".join(str(x) for x in [*urls.BASE, *((name, "", "block") for name in urls.SPECIAL)])
OP11 = f"""with rules(rh, rp, verdict) as (values {_RULES}),
  tails as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as t from pages),
  parts as (select page_id, translate(regexp_replace(t, '(?s)[/?#].*$', ''), '{UPPER}', '{LOWER}') as host, case when regexp_matches(t, '^[^/?#]*/') then regexp_replace(substr(t, strpos(t, '/')), '(?s)[?#].*$', '') else '' end as path from tails),
  best as (select page_id, host, path, arg_max({{'r': rh || rp, 'v': verdict}}, length(rh || rp)) as b from parts join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by all)
  select p.page_id, p.host, p.path, b.r as rule, coalesce(b.v, 'allow') as verdict from parts p left join best using (page_id)"""


_CRC32 = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda e, k: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295)"
OP12 = rf"""with own as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') as w, {_CRC32} as h from documents),
  sized as (select doc_id, w, len(w) as n, h, h // 10 as g from own),
  spots as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from sized),
  docs as (select doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) end as w from spots),
  grids as (select doc_id, p, w[1:n:p] as g from (select *, unnest(range(1, n // 4 + 1)) as p from docs)),
  probed as (select doc_id, p from grids where len(list_filter(range(1, len(g) - 2), lambda k: g[k] = g[k + 1] and g[k + 1] = g[k + 2] and g[k + 2] = g[k + 3])) > 0),
  same as (select doc_id, p, i from (select doc_id, p, w, unnest(range(1, n - p + 1)) as i from probed join docs using (doc_id)) where w[i] = w[i + p]),
  islands as (select doc_id, p, min(i) - 1 as start, count(*) + p as length from (select *, i - row_number() over (partition by doc_id, p order by i) as k from same) group by doc_id, p, k),
  runs as (select doc_id, start, length, min(p) as period from islands where length >= greatest(6, 4 * p) group by doc_id, start, length),
  listed as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as s, arg_max({{'start': start, 'length': length, 'period': period}}, [length, -start, -period]) as b from runs group by doc_id),
  gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
  words as (select doc_id, unnest(range(n)) as i, unnest(w) as x from docs),
  kept as (select doc_id, string_agg(x, ' ' order by i) as s from words anti join gone using (doc_id, i) group by doc_id)
  select d.doc_id, coalesce(n_runs, 0) as n_runs, b.start as start, b.length as length, b.period as period, 1000 * b.length // b.period as exponent_milli, sha256(coalesce(l.s, '')) as runs_sha256, sha256(coalesce(k.s, '')) as collapsed_sha256
  from docs d left join listed l using (doc_id) left join kept k using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL twins. The others learn from the tables or hold a tokenizer's merges; tests hold them against brute force."""
    return {"op3_decontamination": OP3, "op6_ngram_join": OP6, "op8_line_dedup": OP8, "op9_warc": OP9, "op10_chat_format": OP10, "op11_url_filter": OP11, "op12_periodic_runs": OP12}
