"""Input tables of the registered queries, derived from the given tables on Spark.

Every view covers all rows of its table and whole texts; ``views_sql`` holds the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from suite.templates import TEMPLATES

EXTENSIONS = ["go", "java", "py", "js", "ts", "tsx", "jsx", "cs", "kt", "KTS", "md", "txt"]
SYMBOL_EXTENSIONS = ["go", "py", "java", "ts", "kts"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _div(column: Column, by: int) -> Column:
    return F.floor(column / by)


def word5(text: Column) -> Column:
    return F.regexp_extract(text, "[A-Za-z]{5,}", 0)


def _file_path() -> Column:
    doc = F.col("doc_id")
    return F.concat(
        F.lit("/ws/"),
        F.when(doc % 50 == 0, F.lit(".hidden/")).otherwise(F.lit("")),
        "source",
        F.lit("/f"),
        doc.cast("string"),
        F.lit("."),
        _pick(EXTENSIONS, doc % 12),
    )


def _source_number() -> Column:
    return F.substring("source", 4, 10).cast("int")


def v_files(spark: SparkSession, sf: str) -> DataFrame:
    nxt = ((_source_number() + 1) % 20).cast("string")
    return table(spark, sf, "documents").select(
        "doc_id",
        "source",
        "lang",
        _file_path().alias("file_path"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("sha256"),
        F.array(F.concat(F.lit("lib/src"), nxt)).alias("imports"),
    )


def v_files_prev(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier state: French files differed, those of one source did not exist yet."""
    content = F.when(F.col("lang") == "fr", F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    return (
        v_files(spark, sf)
        .where(F.col("source") != "src3")
        .withColumn("content", content)
        .withColumn("sha256", F.sha2("content", 256))
    )


def v_code(spark: SparkSession, sf: str) -> DataFrame:
    """Source files in ten languages; the whole document stands in them as comment lines."""
    docs = table(spark, sf, "documents")
    found = word5(F.col("text"))
    word = F.lower(F.when(found == "", F.lit("item")).otherwise(found))
    ext = _pick(EXTENSIONS, F.col("doc_id") % 12)
    content = None
    for extensions, mark, text in TEMPLATES:
        filled = F.lit(text)
        for slot, value in {
            "@W@": F.initcap(word),
            "@w@": word,
            "@n@": F.col("doc_id").cast("string"),
            "@t@": F.concat(F.lit(mark), F.replace(F.col("text"), F.lit("\n"), F.lit("\n" + mark))),
        }.items():
            filled = F.replace(filled, F.lit(slot), value)
        content = (F if content is None else content).when(ext.isin(extensions), filled)
    return docs.select(_file_path().alias("file_path"), content.alias("content"))


def v_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as symbols: up to 20 per file, 100 per directory."""
    group, k = _div(F.col("doc_id"), 2000), _div(F.col("doc_id"), 20) % 5
    docs = table(spark, sf, "documents").select(
        "doc_id",
        "text",
        F.concat(F.lit("/ws/"), "source", F.lit("_"), group.cast("string")).alias("dir"),
        k.alias("k"),
        _source_number().alias("n"),
        group.alias("g"),
        word5(F.col("text")).alias("name"),
    )
    path = F.concat("dir", F.lit("/m"), F.col("k").cast("string"), F.lit("."), _pick(SYMBOL_EXTENSIONS, F.col("k")))
    size = F.size(F.split("text", "\n"))
    before = W.partitionBy("file_path").orderBy("doc_id")
    sized = docs.withColumn("file_path", path).withColumn("size", size)
    placed = sized.withColumn("line_end", F.sum("size").over(before).cast("int"))
    return placed.where(F.col("name") != "").select(
        F.concat("file_path", F.lit(":d"), F.col("doc_id").cast("string")).alias("id"),
        F.concat("file_path", F.lit(":"), "name").alias("dup_id"),
        "name",
        F.lit("function").alias("type"),
        "file_path",
        (F.col("line_end") - F.col("size") + 1).cast("int").alias("line_start"),
        "line_end",
        F.substring_index("text", "\n", 1).alias("signature"),
        F.col("text").alias("body"),
        F.transform(
            F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0)),
            lambda w: F.concat(F.lit("pkg."), w),
        ).alias("dependencies"),
        "dir",
        "doc_id",
        "k",
        "n",
        "g",
    )


def v_symbol_files(spark: SparkSession, sf: str) -> DataFrame:
    return files_of(v_symbols(spark, sf))


def files_of(symbols: DataFrame) -> DataFrame:
    """One row per file of ``v_symbols``, with what it imports."""

    def near(step: int) -> Column:
        return F.concat(((F.col("n") + step) % 20).cast("string"), F.lit("_"), F.col("g").cast("string"))

    by_name = F.concat(F.lit("lib/src"), near(1))
    by_text = F.concat(F.lit("ws/src"), near(2), F.lit("/m1"))
    return (
        symbols.groupBy("file_path", "dir", "n", "g", "k")
        .agg(F.count("*").alias("n_symbols"))
        .select(
            "file_path",
            "dir",
            F.sha2("file_path", 256).alias("sha256"),
            F.when(F.col("k") == 0, F.array(by_name, by_text)).otherwise(F.array(by_name)).alias("imports"),
        )
    )


def _request_file(item: Column) -> Column:
    return F.concat(
        F.lit("/ws/src"),
        (item % 20).cast("string"),
        F.lit("_"),
        _div(item, 40).cast("string"),
        F.lit("/m"),
        (item % 5).cast("string"),
        F.lit("."),
        _pick(SYMBOL_EXTENSIONS, item % 5),
    )


def v_requests(spark: SparkSession, sf: str) -> DataFrame:
    item = F.col("item_id")
    own = _request_file(item)
    return table(spark, sf, "benchmark").select(
        item.alias("request_id"),
        F.col("text").alias("query"),
        F.when(item % 2 == 0, F.array(own)).otherwise(F.array(_request_file(item + 1))).alias("open_files"),
        own.alias("cursor_file"),
        (1 + (item * 7) % 40).cast("int").alias("cursor_line"),
        F.when(item % 3 != 0, (item * 100).cast("int")).alias("max_tokens"),
        F.when(item % 4 != 0, F.lit("acme")).alias("provider"),
        F.when(item % 5 != 0, F.lit("m1")).otherwise(F.lit("")).alias("model"),
    )


def v_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def v_answer_cache(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("label").cast("string")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("seq"),
        F.concat(F.lit("question "), F.col("vec_id").cast("string")).alias("query"),
        F.concat(F.lit("answer "), F.col("vec_id").cast("string")).alias("response"),
        "embedding",
        F.when(F.col("label") == 9, none)
        .otherwise(F.create_map(F.concat(F.lit("f"), label), F.sha2(label, 256)))
        .alias("file_hashes"),
    )


def v_answer_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector blended with the next one, with the file hashes of now."""
    own = table(spark, sf, "embeddings")
    after = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    weight = (_div(F.col("vec_id"), 10) % 5) * F.lit(0.1)
    blend = F.zip_with(
        "embedding",
        F.coalesce("after", "embedding"),
        lambda a, b: ((1 - F.col("w")) * a.cast("double") + F.col("w") * b.cast("double")).cast("float"),
    )
    label = F.col("label").cast("string")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    now = F.when(F.col("label") == 3, F.sha2(F.concat(label, F.lit("x")), 256)).otherwise(F.sha2(label, 256))
    return (
        own.join(after, "vec_id", "left")
        .withColumn("w", weight)
        .select(
            F.col("vec_id").alias("request_id"),
            blend.alias("embedding"),
            F.when(F.col("label") == 5, none)
            .otherwise(F.create_map(F.concat(F.lit("f"), label), now))
            .alias("file_hashes"),
        )
    )


def v_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with a made-up secret behind it, half of them right after an accented letter."""
    doc = F.col("doc_id")
    sha = F.sha2(doc.cast("string"), 256)

    def part(start: int, size: int) -> Column:
        return F.substring(sha, start, size)

    secret = (
        F.when(doc % 7 == 0, F.concat(F.lit("AKIA"), F.upper(part(1, 16))))
        .when(
            doc % 7 == 1,
            F.concat(
                F.lit("https://hooks.slack.com/services/T"),
                F.upper(part(1, 6)),
                F.lit("/B"),
                F.upper(part(7, 6)),
                F.lit("/"),
                part(20, 12),
            ),
        )
        .when(
            doc % 7 == 2,
            F.concat(F.lit("eyJ"), part(1, 12), F.lit(".eyJ"), part(13, 12), F.lit("."), part(25, 20)),
        )
        .when(doc % 7 == 3, F.concat(F.lit("user"), doc.cast("string"), F.lit("@mail.example.org")))
        .when(doc % 7 == 4, F.concat(F.lit("10.0."), (doc % 256).cast("string"), F.lit(".17")))
        .when(
            doc % 7 == 5, F.concat(F.lit("postgres://admin:"), part(1, 12), F.lit("@db.example.org:5432/app"))
        )
        .otherwise(
            F.concat(
                F.lit('api_key = "'),
                F.when(doc % 3 == 0, F.lit("QWERTYUIOPASDFGHJKLZ")).otherwise(F.lit("")),
                part(1, 24),
                F.lit('"'),
            )
        )
    )
    lead = F.when(doc % 2 == 0, F.lit("\né")).otherwise(F.lit("\nkey "))
    tail = F.when(doc % 4 < 2, F.lit("è end")).otherwise(F.lit(" end"))
    return table(spark, sf, "documents").select("doc_id", F.concat("text", lead, secret, tail).alias("text"))


def v_conn(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    host = F.concat(F.lit("@db"), (key % 10).cast("string"), F.lit(":5432/app"))
    conn = (
        F.when(key % 3 == 0, F.concat(F.lit("postgres://"), "c_name", F.lit(":pw"), key.cast("string"), host))
        .when(key % 3 == 1, F.concat(F.lit("postgres://"), "c_name", host))
        .otherwise(F.lit(""))
    )
    return table(spark, sf, "customer").select("c_custkey", conn.alias("conn"))


def v_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit_of(table(spark, sf, "events"))


def audit_of(events: DataFrame) -> DataFrame:
    raw = F.floor(F.col("value") * 100).cast("int")
    optimized = F.floor(F.col("value") * 30).cast("int")
    return events.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("provider"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        raw.alias("raw_tokens"),
        optimized.alias("optimized_tokens"),
        F.when(raw > 0, (raw - optimized) * 100.0 / raw).otherwise(0.0).alias("savings_percent"),
        (F.col("event_id") % 500).cast("int").alias("duration_ms"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
