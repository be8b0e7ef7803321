"""Queries of retrieval, deduplication and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import dedup as D
from ..operators import nearest as N
from ..operators import retrieve as R
from ..operators import segment as G
from ..operators import setjoin as J
from ..operators.scan import scanned
from .catalog import SQL_SQUEEZE, SQL_STRIP, query, table

_V = "cast(embedding as double[])"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query(f"select vec_id, round(sqrt(list_inner_product({_V}, {_V})), 6) as norm, round(list_sum(list_transform({_V}, lambda x: x / sqrt(list_inner_product({_V}, {_V})))), 6) as total from embeddings")
def f19_unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("n", V.norm(F.col("embedding")))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") / F.col("n"))
    return rows.select("vec_id", F.round("n", 6).alias("norm"), F.round(total, 6).alias("total"))


@query(f"with p as (select a.vec_id, {_V.replace('embedding', 'a.embedding')} as x, {_V.replace('embedding', 'b.embedding')} as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select vec_id, round(sqrt(greatest(0, list_inner_product(x, x) + list_inner_product(y, y) - 2 * list_inner_product(x, y))), 5) as l2, round(list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)), 6) as cosine from p")
def f20_distances(spark: SparkSession, d: str) -> DataFrame:
    a = vectors(spark, d).select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.l2(F.col("x"), F.col("y")), 5).alias("l2"), F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


def _knn_sql(k: int, where: str) -> str:
    return f"""select query, id, rank, round(distance, 5) as distance from (select q.vec_id as query, c.vec_id as id, sqrt(greatest(0, list_inner_product(cv, cv) + list_inner_product(qv, qv) - 2 * list_inner_product(cv, qv))) as distance,
      cast(row_number() over (partition by q.vec_id order by distance, c.vec_id) as int) as rank from (select vec_id, {_V} as qv from embeddings where vec_id % 50 = 0) q, (select vec_id, {_V} as cv from embeddings where {where}) c) where rank <= {k}"""


def nearest(spark: SparkSession, d: str, k: int, where=None) -> DataFrame:
    rows = vectors(spark, d)
    return R.knn(rows, rows.where("vec_id % 50 = 0"), k, "vec_id", "vec_id", where=where).withColumn("distance", F.round("distance", 5))


@query(_knn_sql(5, "true"))
def j14_w01_nearest(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d, 5)


@query(_knn_sql(5, "label in (1, 3)"))
def p24_nearest_with_filter(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d, 5, F.col("label").isin(1, 3))


_TERMS = "select {0} as id, term, count(*) as weight from (select {0}, unnest(string_split(text, ' ')) as term from {1}) group by all"
_SPARSE = f"c as ({_TERMS.format('doc_id', 'documents')}), q as (select id as query, term, weight as w from ({_TERMS.format('item_id', 'benchmark')})), s as (select query, id, sum(weight * w)::bigint as score from c join q using (term) group by all)"


def sparse(spark: SparkSession, d: str, k: int) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.split("text", " ")).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("weight"))
    return N.text_top(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), asked, k)


@query(f"with {_SPARSE} select query, id, score, cast(rank as int) as rank from (select *, row_number() over (partition by query order by score desc, id) as rank from s) where rank <= 10")
def f21_sparse_top(spark: SparkSession, d: str) -> DataFrame:
    return sparse(spark, d, 10)


@query(f"""with {_SPARSE}, a as (select * from (select query, id, row_number() over (partition by query order by score desc, id) as rank from s) where rank <= 10),
  b as (select * from (select i.query, d.doc_id as id, row_number() over (partition by i.query order by abs(d.n_chars - i.n), d.doc_id) as rank from documents d, (select item_id as query, length(text) as n from benchmark) i) where rank <= 10),
  f as (select query, id, sum(1.0::double / (60 + rank)) as score from (select * from a union all select * from b) group by all)
  select query, id, round(score, 6) as score, cast(rank as int) as rank from (select *, row_number() over (partition by query order by round(score, 9) desc, id) as rank from f) where rank <= 5""")
def f22_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.char_length("text").cast("long").alias("value"))
    near = N.nearest_values(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("value")), asked, 10)
    fused = R.fuse(sparse(spark, d, 10), near, 1000)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
    return fused.withColumn("rank", rank).where("rank <= 5").select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("select a.vec_id, b.vec_id as original, b.label from (select vec_id, unnest([vec_id + 1, vec_id * 2]) as t from embeddings) a join embeddings b on b.vec_id = a.t")
def j15_grounding(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("vec_id", F.array(F.col("vec_id") + 1, F.col("vec_id") * 2).alias("targets"))
    return R.grounding(rows, "vec_id", "targets", vectors(spark, d).select(F.col("vec_id").alias("original"), "label"), "original")


# --- near-duplicates ---
@query(f"with v as (select vec_id, list_transform({_V}, lambda x: x / sqrt(list_inner_product({_V}, {_V}))) as u from embeddings) select a.vec_id as i, b.vec_id as j, round(list_inner_product(a.u, b.u), 6) as similarity from v a join v b on a.vec_id < b.vec_id where list_inner_product(a.u, b.u) >= 0.5")
def j10_dense_pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.dense_pairs(vectors(spark, d), "vec_id", "embedding", 0.5).withColumn("similarity", F.round("similarity", 6))


_SH = r"select item_id, list_distinct(list_transform(range(1, length(s) - 3), lambda i: substring(s, i, 5))) as g from (select item_id, regexp_replace(text, '\s+', '', 'g') as s from benchmark)"


@query(f"with b as ({_SH}) select a.item_id as i, c.item_id as j, round(len(list_intersect(a.g, c.g)) / (len(a.g) + len(c.g) - len(list_intersect(a.g, c.g))), 6) as similarity from b a join b c on a.item_id < c.item_id where len(list_intersect(a.g, c.g)) / (len(a.g) + len(c.g) - len(list_intersect(a.g, c.g))) >= 0.1")
def j11_exact_jaccard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", D.shingles(F.col("text")).alias("g"))
    grams = rows.select("item_id", F.size("g").alias("n"), F.explode("g").alias("x"))
    a, b = (grams.toDF(f"{p}", f"n{p}", "x") for p in "ij")
    both = a.join(b, "x").where("i < j").groupBy("i", "j", "ni", "nj").agg(F.count(F.lit(1)).alias("c"))
    return both.withColumn("similarity", F.col("c") / (F.col("ni") + F.col("nj") - F.col("c"))).where("similarity >= 0.1").select("i", "j", F.round("similarity", 6).alias("similarity"))


def _shingles_sql(text: str) -> str:
    s = SQL_SQUEEZE.format(SQL_STRIP.format(f"coalesce({text}, '')"))
    return f"(select list_sort(list_distinct(list_transform(range(1, greatest(length(s) - 3, 2)), lambda i: substring(s, i, 5)))) from (select {s} as s))"


# Classes of equal sets, and class pairs at the threshold, from (id, g).
_CLASSES = """classes as (select min(id) as c, count(*) as n, g from sets where g <> [''] group by g),
  grams as (select c, len(g) as k, unnest(g) as x from classes),
  pairs as (select a.c as i, b.c as j, count(*) / (a.k + b.k - count(*)) as similarity from grams a join grams b using (x) where a.c < b.c and a.k >= 0.85 * b.k and b.k >= 0.85 * a.k group by a.c, b.c, a.k, b.k having count(*) / (a.k + b.k - count(*)) >= 0.85)"""
_DOC_SETS = f"sets as (select doc_id as id, {_shingles_sql('text')} as g from documents)"
_LINKS = "edges as (select i as c, j as o from pairs union all select j, i from pairs), others as (select b.c, sum(n)::bigint as l from edges b join classes o on o.c = b.o group by b.c)"


@query(f"with {_DOC_SETS}, {_CLASSES} select i, j, round(similarity, 6) as similarity from pairs")
def j11_surface_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different whole texts whose 5-character shingles have a Jaccard of at least 0.85; copies stand for each other."""
    pairs, _ = J.similar_pairs(table(spark, d, "documents"), "doc_id", ["text"])
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query(f"with {_DOC_SETS}, {_CLASSES}, {_LINKS} select id as key, k.c as class_id, n - 1 + coalesce(l, 0) as n_links from sets join classes k using (g) left join others o on o.c = k.c")
def j11_surface_links(spark: SparkSession, d: str) -> DataFrame:
    return J.linked(*J.similar_pairs(table(spark, d, "documents"), "doc_id", ["text"]))


def exchanges(spark: SparkSession, d: str) -> DataFrame:
    """Samples: of each document's text the first half stands for the question, the rest for the answer."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = table(spark, d, "documents").withColumn("half", half)
    return rows.select(F.col("doc_id").alias("id"), F.substr("text", F.lit(1), F.col("half")).alias("question"), F.substr("text", F.col("half") + 1).alias("answer"))


_BOTH = f"""samples as (select doc_id as id, substring(text, 1, length(text) // 2) as question, substring(text, length(text) // 2 + 1) as answer from documents),
  parts as (select id, {_shingles_sql('question')} as q, {_shingles_sql('answer')} as a from samples), real as (select * from parts where q <> [''] and a <> ['']),
  grams as (select id, len(a) as k, unnest(a) as x from real),
  near as (select x.id as i, y.id as j, count(*) / (x.k + y.k - count(*)) as similarity from grams x join grams y using (x) where x.id < y.id and x.k >= 0.85 * y.k and y.k >= 0.85 * x.k group by x.id, y.id, x.k, y.k having count(*) / (x.k + y.k - count(*)) >= 0.85),
  surface as (select i, j, similarity from near join real x on x.id = i join real y on y.id = j where len(list_intersect(x.q, y.q)) / (len(x.q) + len(y.q) - len(list_intersect(x.q, y.q))) >= 0.85)"""


@query(f"with {_BOTH} select i, j, round(similarity, 6) as similarity from surface")
def j18_surface_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Samples whose questions and whose answers both are nearly the same; copies are expanded."""
    pairs, members = J.similar_pairs(exchanges(spark, d), "id", ["question", "answer"])
    return J.expanded(pairs, members).withColumn("similarity", F.round("similarity", 6))


@query()
def j11_f18_minhash_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The similar samples with their similarity and its estimate by signatures of 128 minimum hashes."""
    return D.minhash_pairs(exchanges(spark, d), "id", "question", "answer")


_ANSWERS = f"v as (select vec_id, {_V}[1:6] as x from embeddings), u as (select vec_id, list_transform(x, lambda e: e / sqrt(list_inner_product(x, x))) as u, x from v), k as (select min(vec_id) as c, count(*) as n, x, any_value(u) as u from u group by x)"


@query(f"with {_ANSWERS}, p as (select a.c, sum(b.n)::bigint as l from k a join k b on a.c <> b.c and list_inner_product(a.u, b.u) >= 0.85 group by a.c) select vec_id as key, k.c as class_id, n - 1 + coalesce(l, 0) as n_links from u join k using (x) left join p on p.c = k.c")
def j10_semantic_links(spark: SparkSession, d: str) -> DataFrame:
    """For each row its class of equal answer vectors and the number of rows with a cosine of at least 0.85."""
    return D.dense_links(parts(spark, d), "vec_id", "answer", D.BOTH)


@query(f"with v as (select vec_id, label, list_transform({_V}, lambda x: x / sqrt(list_inner_product({_V}, {_V}))) as u from embeddings) select a.vec_id as i, b.vec_id as j, case when a.label < b.label then a.vec_id else b.vec_id end as loser from v a join v b on a.vec_id < b.vec_id where list_inner_product(a.u, b.u) >= 0.5")
def j18_loser_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    pairs = D.dense_pairs(rows, "vec_id", "embedding", 0.5)
    named = pairs.join(rows.select(F.col("vec_id").alias("i"), F.col("label").alias("si")), "i").join(rows.select(F.col("vec_id").alias("j"), F.col("label").alias("sj")), "j")
    return named.select("i", "j", D.loser(F.col("si"), F.col("sj"), F.col("i"), F.col("j")).alias("loser"))


@query()
def j18_greedy_removal(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return D.greedy_removed(rows, D.dense_pairs(rows, "vec_id", "embedding", 0.5), "vec_id", "label").select("removed")


def _unit(part: str) -> str:
    return f"list_transform({part}, lambda x: x / sqrt(list_inner_product({part}, {part})))"


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Two vectors for each row: its first six dimensions stand for the answer, the next six for the question."""
    return vectors(spark, d).select("vec_id", "label", F.slice("embedding", F.lit(1), F.lit(6)).alias("answer"), F.slice("embedding", F.lit(7), F.lit(6)).alias("question"))


def semantic_edges(spark: SparkSession, d: str) -> DataFrame:
    return D.dense_rule_edges(parts(spark, d), "vec_id", "answer", "question")


@query(f"""with v as (select vec_id, {_unit(_V + '[1:6]')} as a, {_unit(_V + '[7:12]')} as q from embeddings),
  p as (select x.vec_id as i, y.vec_id as j, list_inner_product(x.a, y.a) as a, list_inner_product(x.q, y.q) as q from v x join v y on x.vec_id < y.vec_id)
  select i, j, case when a >= {D.ANSWER} then 'answer' when q >= {D.QUESTION} and a >= {D.BOTH} then 'question_answer' end as rule from p where a >= {D.ANSWER} or (q >= {D.QUESTION} and a >= {D.BOTH})""")
def j18_rule_edges(spark: SparkSession, d: str) -> DataFrame:
    return semantic_edges(spark, d)


def two_rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Surface pairs of samples, then semantic edges of vectors, with ids in common."""
    surface, members = J.similar_pairs(exchanges(spark, d), "id", ["question", "answer"])
    return D.removed_by_rules(parts(spark, d), "vec_id", "label", J.expanded(surface, members), semantic_edges(spark, d))


@query()
def j18_two_rules(spark: SparkSession, d: str) -> DataFrame:
    return two_rules(spark, d)[0]


@query()
def j18_rule_counters(spark: SparkSession, d: str) -> DataFrame:
    """Pairs judged and rows removed by each rule."""
    return two_rules(spark, d)[1]


# --- segmentation: a document is a book, lines of few words are headers ---
_LINES = "lines as (select doc_id as book, cast(n - 1 as int) as line_no, list_extract(ls, n) as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as n from (select doc_id, string_split(text, chr(10)) as ls from documents)))"
_HEAD = "heads as (select *, case when len(string_split(line, ' ')) <= 2 then cast(1 + length(line) % 7 as int) end as num from lines)"


def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = G.lines_of(table(spark, d, "documents"), "doc_id", "text")
    return rows.withColumn("num", F.when(F.size(F.split("line", " ")) <= 2, (1 + F.char_length("line") % 7).cast("int")))


@query(f"with {_LINES} select * from lines")
def s06_numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    return G.lines_of(table(spark, d, "documents"), "doc_id", "text")


@query(f"with {_LINES}, {_HEAD} select book, line_no, last_value(num ignore nulls) over (partition by book order by line_no rows between unbounded preceding and current row) as current from heads")
def j12_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return scanned(numbered_lines(spark, d).drop("line"), ["book"], "line_no", carried={"current": "num"}).select("book", "line_no", "current")


_RANGES = "ranges as (select book, line_no, num, coalesce(lead(line_no) over (partition by book order by line_no), fin) as until from heads join (select book, max(line_no) + 1 as fin from lines group by 1) using (book) where num is not null)"


@query(f"with {_LINES}, {_HEAD}, {_RANGES} select book, line_no, num, until from ranges")
def j13_header_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = numbered_lines(spark, d)
    ends = rows.groupBy("book").agg((F.max("line_no") + 1).alias("end"))
    return G.ranges(rows.where("num is not null").select("book", "line_no", "num"), ends)


@query(f"with {_LINES}, {_HEAD}, s as (select *, count(num) over (partition by book order by line_no rows between unbounded preceding and current row) as item from heads) select book, item, max(num) as num, md5(string_agg(line, chr(10) order by line_no) filter (num is null)) as body from s where item > 0 group by book, item")
def w04_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = scanned(numbered_lines(spark, d), ["book"], "line_no", counted={"item": "num"})
    text = F.collect_list(F.when(F.col("num").isNull(), F.struct("line_no", "line")))
    made = rows.where("item > 0").groupBy("book", "item").agg(F.max("num").alias("num"), F.array_sort(text).alias("t"))
    return made.select("book", "item", "num", F.when(F.size("t") > 0, F.md5(F.array_join(F.transform("t", lambda x: x["line"]), "\n"))).alias("body"))


@query(f"with {_LINES}, {_HEAD}, b as (select *, lag(num, 1, 0) over (partition by book order by line_no) as p from heads where num is not null) select book, line_no, num, cast(sum(cast(num <= p as int)) over (partition by book order by line_no rows between unbounded preceding and current row) as int) as sub_chapter from b")
def w05_number_resets(spark: SparkSession, d: str) -> DataFrame:
    rows = numbered_lines(spark, d).where("num is not null")
    return G.with_resets(rows, "num").select("book", "line_no", "num", F.col("sub_chapter").cast("int").alias("sub_chapter"))


@query(f"with {_LINES} select book, line_no, coalesce(trim(lag(line) over w) = '', true) or coalesce(trim(lead(line) over w) = '', true) as isolated from lines window w as (partition by book order by line_no)")
def w09_blank_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return G.with_isolated(G.lines_of(table(spark, d, "documents"), "doc_id", "text")).select("book", "line_no", "isolated")


@query("""with c as (select item_id, pos, substring(text, pos, 1) as c from (select item_id, text, unnest(range(1, length(text) + 1)) as pos from benchmark)),
  g as (select item_id, c, pos - row_number() over (partition by item_id, c order by pos) as g from c) select item_id, cast(max(n) as int) as run from (select item_id, count(*) as n from g group by item_id, c, g) group by item_id""")
def w11_longest_run(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", G.longest_run(F.col("text")).alias("run"))


@query(f"with {_LINES} select book, line_no, regexp_extract(line, '^([0-9]+)[.]', 1) as digits, contains(line, '.') and length(line) > length(regexp_extract(line, '^([0-9]+)[.]', 1)) + 1 as inline from lines")
def f14_f15_headers(spark: SparkSession, d: str) -> DataFrame:
    rows = G.lines_of(table(spark, d, "documents"), "doc_id", "text")
    digits = F.regexp_extract("line", r"^([0-9]+)[.]", 1)
    return rows.select("book", "line_no", digits.alias("digits"), G.inline(F.col("line"), digits).alias("inline"))


@query(f"with {_LINES}, {_HEAD}, f as (select book, min(line_no) filter (num = 1) as start, min(line_no) filter (line_no >= 5 and contains(line, 'de')) as fin from heads where line_no >= 2 group by book) select book, start, fin from f")
def f16_f29_boundaries(spark: SparkSession, d: str) -> DataFrame:
    rows = numbered_lines(spark, d).where("line_no >= 2")
    return rows.groupBy("book").agg(F.min(F.when(F.col("num") == 1, F.col("line_no"))).alias("start"), F.min(F.when((F.col("line_no") >= 5) & F.contains("line", F.lit("de")), F.col("line_no"))).alias("fin"))
