"""The registered queries of the operators, each over its whole table, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate as decon
from threadloom.llm import byte_repeats, collocations, line_templates, main_text, near_vectors, ngram_join, personal_data, sharding
from threadloom.llm import stages, toxicity, word_repeats, word_runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = rf"""
with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w
               from documents),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w
          from benchmark),
windows as (select item_id, array_to_string(w[i:i + 9], ' ') as g, least(10, len(w)) as n
            from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0)),
lengths as (select distinct n from windows),
places as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
           from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where len(w) >= n)),
found as (select distinct doc_id, i, n, item_id from places join windows using (g, n)),
hits as (select doc_id, count(distinct p)::bigint as n_hit
         from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
named as (select doc_id, count(*)::bigint as n_items, sha256(string_agg(s, ',' order by s)) as h
          from (select distinct doc_id, item_id::varchar as s from found) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       coalesce(h, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hits using (doc_id) left join named using (doc_id)
"""


@query("op1_benchmark_decontamination", OP1_SQL)
def op1_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decon.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(toxicity.held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op3_packing")
def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return stages.pack_sequences(spark, table(spark, sf, "documents"), sf)


OP4_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
                     where embedding is not null and len(embedding) > 0
                       and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                       and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as i, b.vec_id as j from v a, v b
          where a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
reach(i, j) as (select vec_id, vec_id from embeddings union select r.i, l.j from reach r join links l on r.j = l.i)
select e.vec_id, (select count(*) from links where i = e.vec_id)::bigint as n_links,
       c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select i, min(j) as component_id from reach group by i) c on c.i = e.vec_id
"""


@query("op4_embedding_near_dedup", OP4_SQL)
def op4_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = near_vectors.near_vectors(table(spark, sf, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf, "documents"), 16)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    left = line_templates.drop_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return left.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP7_SQL = rf"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w
                         from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from s group by doc_id),
links as (select x.doc_id as i, y.doc_id as j from s x join s y on x.g = y.g and x.doc_id <> y.doc_id
          join sizes a on a.doc_id = x.doc_id join sizes b on b.doc_id = y.doc_id
          group by x.doc_id, y.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(i, j) as (select doc_id, doc_id from documents union select r.i, l.j from reach r join links l on r.j = l.i)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c.component_id
from documents d left join sizes using (doc_id) join (select i, min(j) as component_id from reach group by i) c on c.i = d.doc_id
"""


@query("op7_ngram_jaccard_join", OP7_SQL)
def op7_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    found = ngram_join.ngram_join(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return main_text.extract(table(spark, sf, "pages")).withColumnRenamed("id", "page_id")


@query("op9_suffix_array_dedup")
def op9_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    left = byte_repeats.drop_repeats(table(spark, sf, "documents"))
    return left.drop("kept").withColumnRenamed("id", "doc_id")


OP10_SQL = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g
            from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words where len(w) >= 13)),
firsts as (select g, min(doc_id) as first from windows group by g),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from windows join firsts using (g) where doc_id > first),
gathered as (select doc_id, count(*) as n_removed from gone group by doc_id),
left_over as (select doc_id, string_agg(x, ' ' order by p) as kept
              from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from words) anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from words left join gathered using (doc_id) left join left_over using (doc_id)
"""


@query("op10_substring_dedup", OP10_SQL)
def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    left = word_repeats.drop_repeats(table(spark, sf, "documents"))
    return left.drop("kept").withColumnRenamed("id", "doc_id")


@query("op11_pii")
def op11_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in personal_data.BASE_KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


OP12_SQL = rf"""
with recursive pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, p, unnest(w) as x, generate_subscripts(w, 1) as i
      from (select lang, row_number() over () as p, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces)),
leads as (select lang, x as w1, lead(x) over t as w2, lead(x, 2) over t as w3, lead(x, 3) over t as w4 from w window t as (partition by p order by i)),
grams as (select lang, 1 as size, w1, null::varchar as w2, null::varchar as w3, null::varchar as w4, count(*) as f from leads group by all
          union all select lang, 2, w1, w2, null, null, count(*) from leads where w2 is not null group by all
          union all select lang, 3, w1, w2, w3, null, count(*) from leads where w3 is not null group by all
          union all select lang, 4, w1, w2, w3, w4, count(*) from leads where w4 is not null group by all),
f as (select lang, size, list_filter([w1, w2, w3, w4], lambda w: w is not null) as words, concat_ws(' ', w1, w2, w3, w4) as phrase, f
      from grams where f >= 30 or size = 1),
n as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
c as (select lang, size, words, phrase, f as a from f where size >= 2 and f >= 30),
cuts as (select lang, size, words, phrase, a, unnest(range(1, size)) as k from c),
scored as (select cuts.*, x.f as l, y.f as r, (2000000::hugeint * a) // (x.f + y.f) as score
           from cuts join f x on x.lang = cuts.lang and x.phrase = array_to_string(cuts.words[1:k], ' ')
                     join f y on y.lang = cuts.lang and y.phrase = array_to_string(cuts.words[k + 1:], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
parts as (select lang, a as longer, unnest([[1, 2], [2, 3], [3, 4], [1, 3], [2, 4]]) as p, size, words from c where size > 2),
inner_ as (select lang, longer, array_to_string(words[p[1]:p[2]], ' ') as phrase from parts where p[2] <= size and p[2] - p[1] + 1 < size),
covered as (select lang, phrase, max(longer) as longest from inner_ group by all),
ranked as (select best.*, row_number() over (partition by best.lang order by score desc, a desc, best.phrase) as rank
           from best left join covered on covered.lang = best.lang and covered.phrase = best.phrase
           where longest is null or 100::hugeint * longest < 80::hugeint * a)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join n using (lang) where rank <= 2000
"""


@query("op12_phrase_collocations", OP12_SQL)
def op12_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = word_runs.periodic_runs(table(spark, sf, "documents"), planted=True)
    # Greatest length, then smallest start, then smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("from_end"), (-r["period"]).alias("shortness"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.from_end")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.shortness")).alias("period"),
        F.expr("1000 * best.length div -best.shortness").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
