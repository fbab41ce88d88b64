"""The registered queries, each next to the SQL it is checked against."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from suite import sql_parts as P
from suite import views as V
from suite.registry import query
from suite.views_sql import fields, text, trim_space, with_views
from threadloom.functions import blocks, hashing, paths, vectors
from threadloom.functions import text as T
from threadloom.functions.masking import RULE_NAMES, mask, mask_counts
from threadloom.operators import answers, catalog, compress, extract, linking, ranking, report, traverse
from threadloom.operators import vectors as vec
from threadloom.plans import index, requests
from threadloom.schemas import ANSWERS, SYMBOLS
from threadloom.session import checkpoint_dir, cut_lineage
from threadloom.sources import tables
from threadloom.sources.keyed import KeyedTable
from threadloom.streaming import jobs

Spark = SparkSession

# ================================================================ scans, sources, sinks


@query("scan_files", with_views(["v_files"], "select file_path, content, strlen(content)::int as n_bytes from v_files"))
def scan_files(spark: Spark, sf: str) -> DataFrame:
    return V.v_files(spark, sf).select("file_path", "content", F.octet_length("content").alias("n_bytes"))


@query(
    "filter_hidden_paths",
    with_views(["v_files"], r"select file_path from v_files where not regexp_matches(file_path, '(^|/)\.[^/]')"),
)
def filter_hidden_paths(spark: Spark, sf: str) -> DataFrame:
    return V.v_files(spark, sf).where(~paths.is_hidden(F.col("file_path"))).select("file_path")


@query(
    "filter_supported_lang",
    with_views(
        ["v_files"],
        f"select * from (select file_path, {P.language('file_path')} as language from v_files) where language <> 'unknown'",
    ),
)
def filter_supported_lang(spark: Spark, sf: str) -> DataFrame:
    named = V.v_files(spark, sf).select("file_path", paths.language(F.col("file_path")).alias("language"))
    return named.where(F.col("language") != "unknown")


_GO_NOISE = r"\"(?:[^\"\\]|\\.)*\"|`[^`]*`|'(?:[^'\\]|\\.)*'|//.*$|/\*.*?\*/"
_GO_LINE = (
    f"regexp_replace(regexp_replace(l, {text(_GO_NOISE)}, '', 'g'), "
    r"'\b(interface|struct) ?\{\}', '\1', 'g')"
)
_STATUS = f"""
  case when {P.language("file_path")} = 'go' and (not regexp_matches(content, '(?m)^package\\s+\\w+')
    or list_sum(list_transform(list_transform(string_split(content, chr(10)), lambda l: {_GO_LINE}),
      lambda l: length(replace(l, '}}', '')) - length(replace(l, '{{', '')))) <> 0) then 'error' else 'ok' end"""


@query(
    "quarantine_files",
    with_views(
        ["v_files", "v_code"],
        f"""select file_path, {_STATUS} as parse_status from (
          select file_path, content from v_files union all select file_path, content from v_code)
        where {P.language("file_path")} <> 'unknown'""",
    ),
)
def quarantine_files(spark: Spark, sf: str) -> DataFrame:
    """Plain documents under Go names are no Go text, so they are set aside."""
    both = V.v_files(spark, sf).select("file_path", "content").unionByName(V.v_code(spark, sf))
    return extract.describe_files(both).select("file_path", "parse_status")


@query(
    "index_summary",
    with_views(
        ["v_symbols", "v_symbol_files"],
        "select (select count(*) from v_symbol_files) as files, (select count(*) from v_symbols) as symbols",
    ),
)
def index_summary(spark: Spark, sf: str) -> DataFrame:
    return catalog.index_summary(V.v_symbol_files(spark, sf), V.v_symbols(spark, sf))


@query(
    "latest_file_snapshot",
    with_views(
        ["v_files", "v_files_prev"],
        """select file_path, sha256, version from (
          select *, row_number() over (partition by file_path order by version desc) as rn from (
            select file_path, sha256, 1 as version from v_files_prev
            union all select file_path, sha256, 2 as version from v_files)) where rn = 1""",
    ),
)
def latest_file_snapshot(spark: Spark, sf: str) -> DataFrame:
    def versions(df: DataFrame, number: int) -> DataFrame:
        return df.select("file_path", "sha256", F.lit(number).alias("version"))

    both = versions(V.v_files_prev(spark, sf), 1).unionByName(versions(V.v_files(spark, sf), 2))
    return catalog.last_wins(both, ["file_path"], ["version"])


@query(
    "vector_upsert",
    """with every as (
      select vec_id as id, 1 as batch, embedding as vector from embeddings union all
      select vec_id, 2, list_transform(embedding, lambda x: -x) from embeddings where label < 5)
    select id, batch, vector from (
      select *, row_number() over (partition by id order by batch desc) as rn from every) where rn = 1""",
)
def vector_upsert(spark: Spark, sf: str) -> DataFrame:
    """Vectors of half of the labels arrive again, negated."""
    own = V.v_vectors(spark, sf)
    old = own.select("id", F.lit(1).alias("batch"), "vector")
    new = own.where(F.col("label") < 5).select(
        "id", F.lit(2).alias("batch"), F.transform("vector", lambda x: -x).alias("vector")
    )
    return vec.vector_upsert(old, new)


@query("vector_index_build")
def vector_index_build(spark: Spark, sf: str) -> DataFrame:
    return vec.vector_index(V.v_symbols(spark, sf), lambda t: vectors.hash_embedding(t, 64))


_CCR = "select sha256(body)[1:12] as key, min(body) as body from v_symbols group by 1"


@query("ccr_store", with_views(["v_symbols"], _CCR))
def ccr_store(spark: Spark, sf: str) -> DataFrame:
    return compress.ccr_store(V.v_symbols(spark, sf))


@query(
    "answer_cache_append",
    with_views(
        ["v_answer_cache"],
        """select query, response, false as is_new from v_answer_cache union all
        select 'asked ' || vec_id, 'said ' || vec_id, true from embeddings""",
    ),
)
def answer_cache_append(spark: Spark, sf: str) -> DataFrame:
    cache = V.v_answer_cache(spark, sf)
    new = V.v_answer_requests(spark, sf).select(
        "request_id",
        F.concat(F.lit("asked "), F.col("request_id").cast("string")).alias("query"),
        F.concat(F.lit("said "), F.col("request_id").cast("string")).alias("response"),
        "embedding",
        "file_hashes",
    )
    last = cache.agg(F.max("seq")).first()[0]
    grown = answers.append_answers(cache, new, last)
    return grown.select("query", "response", (F.col("seq") > last).alias("is_new"))


# ================================================================ scalar expressions


@query("detect_language", with_views(["v_files"], f"select file_path, {P.language('file_path')} as language from v_files"))
def detect_language(spark: Spark, sf: str) -> DataFrame:
    return V.v_files(spark, sf).select("file_path", paths.language(F.col("file_path")).alias("language"))


@query("fence_language", with_views(["v_files"], f"select file_path, {P.fence('file_path')} as fence from v_files"))
def fence_language(spark: Spark, sf: str) -> DataFrame:
    return V.v_files(spark, sf).select("file_path", paths.fence(F.col("file_path")).alias("fence"))


@query("content_sha256", with_views(["v_files"], "select file_path, sha256(content) as sha256 from v_files"))
def content_sha256(spark: Spark, sf: str) -> DataFrame:
    return V.v_files(spark, sf).select("file_path", hashing.content_sha256(F.col("content")).alias("sha256"))


@query("ccr_key", with_views(["v_symbols"], "select id, sha256(body)[1:12] as key from v_symbols"))
def ccr_key(spark: Spark, sf: str) -> DataFrame:
    return V.v_symbols(spark, sf).select("id", hashing.ccr_key(F.col("body")).alias("key"))


@query("vector_id", with_views(["v_symbols"], "select id, sha256(id)[1:32] as vector_id from v_symbols"))
def vector_id(spark: Spark, sf: str) -> DataFrame:
    return V.v_symbols(spark, sf).select("id", hashing.vector_id(F.col("id")).alias("vector_id"))


@query("symbol_id", with_views(["v_symbols"], "select id, file_path || ':' || name as symbol_id from v_symbols"))
def symbol_id(spark: Spark, sf: str) -> DataFrame:
    return V.v_symbols(spark, sf).select(
        "id", hashing.symbol_id(F.col("file_path"), F.col("name")).alias("symbol_id")
    )


@query(
    "simple_name",
    with_views(["v_symbols"], "select distinct d as name, string_split(d, '.')[-1] as simple_name from (select unnest(dependencies) as d from v_symbols)"),
)
def simple_name(spark: Spark, sf: str) -> DataFrame:
    names = V.v_symbols(spark, sf).select(F.explode("dependencies").alias("name")).distinct()
    return names.select("name", paths.simple_name(F.col("name")).alias("simple_name"))


@query(
    "path_parts",
    with_views(
        ["v_files"],
        """select file_path, regexp_extract(file_path, '^(.*)/[^/]*$', 1) as directory,
          string_split(regexp_extract(file_path, '^(.*)/[^/]*$', 1), '/')[-1] as package,
          string_split(imports[1], '/')[-1] as import_segment from v_files""",
    ),
)
def path_parts(spark: Spark, sf: str) -> DataFrame:
    path = F.col("file_path")
    return V.v_files(spark, sf).select(
        "file_path",
        paths.directory(path).alias("directory"),
        paths.package(path).alias("package"),
        paths.last_segment(F.element_at("imports", 1)).alias("import_segment"),
    )


@query(
    "query_terms",
    f"""select item_id, {fields("lower(text)")} as words,
      list_filter({fields("lower(text)")}, lambda w: strlen(w) >= 3) as terms from benchmark""",
)
def query_terms(spark: Spark, sf: str) -> DataFrame:
    return V.table(spark, sf, "benchmark").select(
        "item_id", T.query_words(F.col("text")).alias("words"), T.query_terms(F.col("text")).alias("terms")
    )


_RAW = "encode(signature || chr(10) || body)"


def _clean_cut(end: int) -> str:
    return f"hex({_RAW}[{end + 1}:{end + 1}]) not between '80' and 'BF'"


@query(
    "embed_preview",
    with_views(
        ["v_symbols"],
        f"""select id, case when octet_length({_RAW}) <= 800 then signature || chr(10) || body
          else decode({_RAW}[1:case when {_clean_cut(800)} then 800 when {_clean_cut(799)} then 799
            when {_clean_cut(798)} then 798 else 797 end]) end as preview from v_symbols""",
    ),
)
def embed_preview(spark: Spark, sf: str) -> DataFrame:
    return V.v_symbols(spark, sf).select("id", T.embed_preview(F.col("signature"), F.col("body")).alias("preview"))


@query("token_estimate", "select doc_id, (strlen(text) // 4)::int as tokens from documents")
def token_estimate(spark: Spark, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select(
        "doc_id", T.token_estimate(F.octet_length("text")).alias("tokens")
    )


@query(
    "savings_percent",
    f"""select event_id, round({P.savings_percent("raw", "opt")}, 6) as savings from (
      select event_id, floor(value * 100)::bigint as raw, floor(value * 30)::bigint + event_id % 90 as opt from events)""",
)
def savings_percent(spark: Spark, sf: str) -> DataFrame:
    raw = F.floor(F.col("value") * 100)
    optimized = F.floor(F.col("value") * 30) + F.col("event_id") % 90
    return V.table(spark, sf, "events").select(
        "event_id", F.round(T.savings_percent(raw, optimized), 6).alias("savings")
    )


@query(
    "token_entropy",
    f"""select word, round({P.entropy("word")}, 6) as entropy from (
      select distinct unnest({fields("text")}) as word from documents)""",
)
def token_entropy(spark: Spark, sf: str) -> DataFrame:
    words = V.table(spark, sf, "documents").select(F.explode(T.fields(F.col("text"))).alias("word")).distinct()
    return words.select("word", F.round(T.entropy(F.col("word")), 6).alias("entropy"))


@query(
    "cosine_pairs",
    f"""select a.vec_id, round({P.cosine("a.embedding", "b.embedding")}, 5) as score
    from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
)
def cosine_pairs(spark: Spark, sf: str) -> DataFrame:
    """Each vector against the next one."""
    own = V.table(spark, sf, "embeddings")
    after = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return own.join(after, "vec_id").select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("after")), 5).alias("score")
    )


@query(
    "clean_code_lines",
    with_views(["v_code"], f"select file_path, {P.clean_lines('content', 'file_path')} as code from v_code"),
)
def clean_code_lines(spark: Spark, sf: str) -> DataFrame:
    return V.v_code(spark, sf).select(
        "file_path", T.clean_lines(F.col("content"), F.col("file_path")).alias("code")
    )


@query(
    "skeletonize",
    with_views(["v_symbols"], f"select id, {P.skeleton('signature', 'body', 'file_path')} as skeleton from v_symbols"),
)
def skeletonize(spark: Spark, sf: str) -> DataFrame:
    return V.v_symbols(spark, sf).select(
        "id",
        T.skeleton(F.col("signature"), hashing.ccr_key(F.col("body")), F.col("file_path")).alias("skeleton"),
    )


@query(
    "mask_conn_str",
    with_views(
        ["v_conn"],
        """select c_custkey, case when conn = '' then '[local-in-memory fallback]'
          when contains(conn, '@') and len(string_split(string_split(conn, '@')[1], ':')) > 2
            then string_split(conn, ':')[1] || ':[MASKED]@' || string_split(conn, '@')[2]
          else conn end as shown from v_conn""",
    ),
)
def mask_conn_str(spark: Spark, sf: str) -> DataFrame:
    return V.v_conn(spark, sf).select("c_custkey", T.mask_conn_str(F.col("conn")).alias("shown"))


@query(
    "poly_hash32",
    """select conv_id, turn, list_reduce(list_prepend(37::bigint, list_transform(range(octet_length(encode(text))),
        lambda i: ('0x' || hex(encode(text))[2 * i + 1 : 2 * i + 2])::bigint)),
      lambda h, b: (h * 31 + b) & 4294967295) as hash from conversations""",
)
def poly_hash32(spark: Spark, sf: str) -> DataFrame:
    return V.table(spark, sf, "conversations").select(
        "conv_id", "turn", hashing.poly_hash32(F.col("text")).alias("hash")
    )


@query("hash_embedding")
def hash_embedding(spark: Spark, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select(
        "doc_id", vectors.hash_embedding(F.col("text"), 256).alias("vector")
    )


@query(
    "l2_normalize",
    """select vec_id, list_transform(embedding, lambda x: round((x / n)::float::double, 5)) as unit from (
      select *, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings)""",
)
def l2_normalize(spark: Spark, sf: str) -> DataFrame:
    unit = vectors.l2_normalize(F.col("embedding"))
    return V.table(spark, sf, "embeddings").select(
        "vec_id", F.transform(unit, lambda x: F.round(x.cast("double"), 5)).alias("unit")
    )


@query(
    "request_defaults",
    with_views(
        ["v_requests"],
        """select request_id, case when max_tokens > 0 then max_tokens else 4096 end as max_tokens,
          coalesce(nullif(provider, ''), 'ollama') as provider, coalesce(nullif(model, ''), 'codellama') as model
        from v_requests""",
    ),
)
def request_defaults(spark: Spark, sf: str) -> DataFrame:
    return requests.with_defaults(V.v_requests(spark, sf)).select("request_id", "max_tokens", "provider", "model")


_TURNS = "select conv_id * 1000 + turn as request_id, case when role = 'user' then text else '' end as query from conversations"


@query("valid_requests", f"select * from ({_TURNS}) where length(query) > 0")
def valid_requests(spark: Spark, sf: str) -> DataFrame:
    """Only user turns ask something."""
    return requests.valid_requests(_turns(spark, sf))


@query("rejected_requests", f"select *, 'query is required' as reason from ({_TURNS}) where length(query) = 0")
def rejected_requests(spark: Spark, sf: str) -> DataFrame:
    return requests.rejected_requests(_turns(spark, sf))


def _turns(spark: Spark, sf: str) -> DataFrame:
    return V.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit("")).alias("query"),
    )


# ================================================================ extraction


@query(
    "explode_lines",
    with_views(
        ["v_code"],
        """select file_path, generate_subscripts(string_split(content, chr(10)), 1)::int as line,
          unnest(string_split(content, chr(10))) as text from v_code""",
    ),
)
def explode_lines(spark: Spark, sf: str) -> DataFrame:
    code = V.v_code(spark, sf)
    return code.select("file_path", F.posexplode(blocks.lines(F.col("content"))).alias("i", "text")).select(
        "file_path", (F.col("i") + 1).alias("line"), "text"
    )


_LINES = "string_split(content, chr(10))"


def _line_imports(value: str) -> str:
    return f"list_filter(list_transform({_LINES}, lambda l: {trim_space(value)}), lambda m: m <> '')"


def _group(lang: str, group: int) -> str:
    return f"regexp_extract(l, {text(extract.IMPORTS[lang])}, {group})"


_IMPORTS = f"""case {P.language("file_path")}
  when 'go' then list_concat(
    flatten(list_transform(regexp_extract_all(content, '(?ms)^import\\s*\\((.*?)\\)', 1),
      lambda b: regexp_extract_all(b, '"([^"]+)"', 1))),
    regexp_extract_all(content, '(?m)^import\\s+(?:[\\w.]+\\s+)?"([^"]+)"', 1))
  when 'java' then {_line_imports(_group("java", 1))} when 'kotlin' then {_line_imports(_group("java", 1))}
  when 'python' then {_line_imports(
    f"case when {_group('python', 1)} <> '' then {_group('python', 1)} when {_group('python', 2)} <> '' "
    f"then {_group('python', 2)} || '.' || {_group('python', 3)} else '' end")}
  when 'csharp' then {_line_imports(_group("csharp", 1))}
  else {_line_imports(
    f"case when {_group('javascript', 1)} <> '' then {_group('javascript', 1)} else {_group('javascript', 2)} end")}
  end"""


@query(
    "extract_imports",
    with_views(
        ["v_code"],
        f"select file_path, {_IMPORTS} as imports from v_code where {P.language('file_path')} <> 'unknown'",
    ),
)
def extract_imports(spark: Spark, sf: str) -> DataFrame:
    return extract.describe_files(V.v_code(spark, sf)).select("file_path", "imports")


# Lines of every file with running figures; block ends by definition, per start line.
_LINE_STEPS = {
    "code": f"select file_path, content, {P.language('file_path')} as language from v_code",
    "rows": f"""
      select file_path, language, generate_subscripts({_LINES}, 1)::int as line, unnest({_LINES}) as l
      from code where language not in ('unknown', 'go')""",
    "marked": f"""
      select *, length(replace(l, '}}', '')) - length(replace(l, '{{', '')) as net,
        contains(l, '{{') as opened,
        length(regexp_extract(l, '^[ \\t]*')) + 3 * (length(regexp_extract(l, '^[ \\t]*'))
          - length(replace(regexp_extract(l, '^[ \\t]*'), chr(9), ''))) as indent,
        {trim_space("l")} = '' or starts_with({trim_space("l")}, '#') as skipped
      from rows""",
    "summed": """
      select *, sum(net) over w as balance, sum(opened::int) over w as n_opened,
        max(line) over (partition by file_path) as last
      from marked window w as (partition by file_path order by line rows unbounded preceding)""",
}
_BRACE_ENDS = """
  select s.file_path, s.line as line_start, coalesce(min(e.line), any_value(s.last))::int as line_end
  from {starts} s left join summed e on e.file_path = s.file_path and e.line >= s.line
    and e.balance <= s.balance - s.net and e.n_opened > s.n_opened - s.opened::int
  where s.language <> 'python' group by s.file_path, s.line"""
_INDENT_ENDS = """
  select s.file_path, s.line as line_start, coalesce(min(e.line) - 1, any_value(s.last))::int as line_end
  from {starts} s left join summed e on e.file_path = s.file_path and e.line > s.line
    and not e.skipped and e.indent <= s.indent
  where s.language = 'python' and not s.skipped group by s.file_path, s.line"""


def _code_lines(spark: Spark, sf: str) -> DataFrame:
    path = F.col("file_path")
    code = V.v_code(spark, sf).withColumn("language", paths.language(path))
    return code.where(~F.col("language").isin("unknown", "go")).withColumn("lines", blocks.lines(F.col("content")))


@query("brace_block_end", with_views(["v_code"], _BRACE_ENDS.format(starts="summed"), _LINE_STEPS))
def brace_block_end(spark: Spark, sf: str) -> DataFrame:
    """Block end of every line of the brace languages, taken as a start."""
    code = _code_lines(spark, sf).where(F.col("language") != "python")
    ends = blocks.block_ends(
        F.lit(True),
        F.transform("lines", blocks.net_braces),
        F.transform("lines", lambda x: blocks.open_braces(x) > 0),
    )
    return code.select("file_path", F.posexplode(ends).alias("i", "line_end")).select(
        "file_path", (F.col("i") + 1).alias("line_start"), "line_end"
    )


@query("indent_block_end", with_views(["v_code"], _INDENT_ENDS.format(starts="summed"), _LINE_STEPS))
def indent_block_end(spark: Spark, sf: str) -> DataFrame:
    """Block end of every line of Python files that can start a block."""
    code = _code_lines(spark, sf).where(F.col("language") == "python")
    skipped = F.transform("lines", blocks.is_blank_or_hash)
    ends = blocks.block_ends(F.lit(False), F.transform("lines", blocks.indent_level), skipped)
    return (
        code.select("file_path", skipped.alias("skipped"), ends.alias("ends"))
        .select("file_path", F.posexplode(F.arrays_zip("skipped", "ends")).alias("i", "row"))
        .where(~F.col("row.skipped"))
        .select("file_path", (F.col("i") + 1).alias("line_start"), F.col("row.ends").alias("line_end"))
    )


@query("indent_level", with_views(["v_code"], "select file_path, line, indent::int as indent from marked", _LINE_STEPS))
def indent_level(spark: Spark, sf: str) -> DataFrame:
    code = _code_lines(spark, sf)
    return code.select("file_path", F.posexplode("lines").alias("i", "text")).select(
        "file_path", (F.col("i") + 1).alias("line"), blocks.indent_level(F.col("text")).cast("int").alias("indent")
    )


def _name(table: dict[str, str], lang: str) -> str:
    pattern = text(table[lang].replace(r"\s++", r"\s"))
    n = extract.GROUPS.get(lang, 1) if table is extract.FUNCTIONS else 1
    return " || ".join(f"regexp_extract(l, {pattern}, {g + 1})" for g in range(n))


def _found(table: dict[str, str], kind: str) -> str:
    arms = " ".join(f"when {text(lang)} then {_name(table, lang)}" for lang in table)
    return f"select *, {text(kind)} as type, case language {arms} else '' end as name from summed"


_DECLARED_STEPS = {
    **_LINE_STEPS,
    "found": (
        f"select * from ({_found(extract.CLASSES, 'class')} union all {_found(extract.FUNCTIONS, 'function')}) "
        "where name <> ''"
    ),
    "starts": "select distinct file_path, language, line, net, opened, n_opened, balance, indent, skipped, last from found",
    "ends": f"{_BRACE_ENDS.format(starts='starts')} union all {_INDENT_ENDS.format(starts='starts')}",
    "declared": f"""
      select f.file_path || ':' || f.name as id, f.name, f.type, f.file_path, e.line_start, e.line_end,
        {trim_space("f.l")} as signature,
        array_to_string({_LINES}[e.line_start:e.line_end], chr(10)) as body, f.language
      from found f join ends e on e.file_path = f.file_path and e.line_start = f.line
        join code c on c.file_path = f.file_path""",
}
_DECLARED = "id, name, type, file_path, line_start, line_end, signature, language"


def _declared(spark: Spark, sf: str) -> DataFrame:
    files = extract.describe_files(V.v_code(spark, sf))
    return extract.declarations(files.where(F.col("language") != "go"))


@query("declarations", with_views(["v_code"], f"select {_DECLARED} from declared", _DECLARED_STEPS))
def declarations(spark: Spark, sf: str) -> DataFrame:
    return _declared(spark, sf).select(*_DECLARED.split(", "))


@query("block_body", with_views(["v_code"], "select id, line_start, type, body from declared", _DECLARED_STEPS))
def block_body(spark: Spark, sf: str) -> DataFrame:
    return _declared(spark, sf).select("id", "line_start", "type", "body")


@query(
    "dedupe_last_wins",
    with_views(
        ["v_code"],
        f"""select {_DECLARED}, body from (select *, row_number() over (
          partition by id order by line_start desc, (type = 'class')::int) as rn from declared) where rn = 1""",
        _DECLARED_STEPS,
    ),
)
def dedupe_last_wins(spark: Spark, sf: str) -> DataFrame:
    return extract.dedupe_last_wins(_declared(spark, sf)).select(*_DECLARED.split(", "), "body")


@query("go_symbols")
def go_symbols(spark: Spark, sf: str) -> DataFrame:
    files = extract.describe_files(V.v_code(spark, sf))
    return extract.extract_symbols(files.where(F.col("language") == "go"))


_GO_CALL = r"(^|[^\w.])((?:[A-Za-z_]\w*\.)?[A-Za-z_]\w*)\("


@query(
    "call_refs",
    with_views(
        ["v_code"],
        f"""select file_path, list_filter(regexp_extract_all(replace(content, '(', '( '), {text(_GO_CALL)}, 2),
          lambda c: c not in ({", ".join(text(w) for w in extract.GO_WORDS)})) as calls from v_code""",
    ),
)
def call_refs(spark: Spark, sf: str) -> DataFrame:
    return V.v_code(spark, sf).select("file_path", extract.call_refs(F.col("content")).alias("calls"))


# ================================================================ links


def _tables(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Symbol and file tables, written out once as an index would hold them."""
    symbols = cut_lineage(V.v_symbols(spark, sf), "zstd")
    return symbols, V.files_of(symbols)


def _links(spark: Spark, sf: str) -> linking.Links:
    return linking.link_symbols(*_tables(spark, sf))


_SYMBOL_VIEWS = ["v_symbols", "v_symbol_files"]


@query("link_by_call", with_views(_SYMBOL_VIEWS, P.CALL_EDGES))
def link_by_call(spark: Spark, sf: str) -> DataFrame:
    symbols, files = _tables(spark, sf)
    scopes = linking.file_scopes(files, symbols)
    return linking.resolved_edges(linking.factored_links(symbols, scopes, linking.call_names(symbols, linking.seen_names(symbols, scopes))))


@query("link_lexical", with_views(_SYMBOL_VIEWS, P.LEXICAL_EDGES))
def link_lexical(spark: Spark, sf: str) -> DataFrame:
    symbols, files = _tables(spark, sf)
    scopes = linking.file_scopes(files, symbols)
    return linking.resolved_edges(linking.factored_links(symbols, scopes, linking.lexical_names(symbols, linking.seen_names(symbols, scopes))))


@query("link_symbols", with_views(_SYMBOL_VIEWS, "select * from edges", P.EDGE_STEPS))
def link_symbols(spark: Spark, sf: str) -> DataFrame:
    return linking.resolved_edges(_links(spark, sf))


@query(
    "visible_files",
    with_views(
        _SYMBOL_VIEWS,
        """select s.file_path, s.scope, count(*) as n_files from (
          select file_path, 'd:' || dir as scope from v_symbol_files
          union select file_path, 'p:' || string_split(i, '/')[-1]
            from (select file_path, unnest(imports) as i from v_symbol_files)
          union select file_path, 'i:' || i from (select file_path, unnest(imports) as i from v_symbol_files)) s
        join v_symbol_files t on case s.scope[1:2] when 'd:' then t.dir = s.scope[3:]
          when 'p:' then string_split(t.dir, '/')[-1] = s.scope[3:] else contains(t.file_path, s.scope[3:]) end
        group by all""",
    ),
)
def visible_files(spark: Spark, sf: str) -> DataFrame:
    """What each file sees, by scope: directory, imported package, imported path."""
    symbols, files = _tables(spark, sf)
    return linking.visible_scopes(linking.file_scopes(files, symbols))


@query(
    "reverse_edges",
    with_views(_SYMBOL_VIEWS, "select distinct dst_id as id, src_id as referrer_id from edges", P.EDGE_STEPS),
)
def reverse_edges(spark: Spark, sf: str) -> DataFrame:
    return linking.reverse_edges(linking.resolved_edges(_links(spark, sf)))


@query(
    "name_index",
    with_views(
        ["v_symbols"],
        """select name, 0 as shard, len(list(id))::int as n_ids, list_sort(list(id)) as ids
        from v_symbols group by name""",
    ),
)
def name_index(spark: Spark, sf: str) -> DataFrame:
    return linking.name_index(V.v_symbols(spark, sf))


_REQUEST_VIEWS = ["v_symbols", "v_symbol_files", "v_requests"]


@query("cursor_symbol", with_views(_REQUEST_VIEWS, P.ACTIVE))
def cursor_symbol(spark: Spark, sf: str) -> DataFrame:
    return ranking.cursor_symbol(V.v_requests(spark, sf), V.v_symbols(spark, sf))


@query("open_file_symbols", with_views(_REQUEST_VIEWS, P.OPENED))
def open_file_symbols(spark: Spark, sf: str) -> DataFrame:
    return ranking.open_file_symbols(V.v_requests(spark, sf), V.v_symbols(spark, sf))


@query("seed_union", with_views(_REQUEST_VIEWS, f"select * from ({P.ACTIVE}) union select * from ({P.OPENED})"))
def seed_union(spark: Spark, sf: str) -> DataFrame:
    return ranking.seed_union(V.v_requests(spark, sf), V.v_symbols(spark, sf))


@query("bfs_distance", with_views(_REQUEST_VIEWS, "select * from dist", P.BFS_STEPS, recursive=True))
def bfs_distance(spark: Spark, sf: str) -> DataFrame:
    symbols, files = _tables(spark, sf)
    seeds = ranking.seed_union(V.v_requests(spark, sf), symbols)
    return traverse.link_distance(seeds, linking.link_symbols(symbols, files))


@query("bfs_distance_edges", with_views(_REQUEST_VIEWS, "select * from dist", P.BFS_STEPS, recursive=True))
def bfs_distance_edges(spark: Spark, sf: str) -> DataFrame:
    """The same distances over the spelled-out edge list."""
    symbols, files = _tables(spark, sf)
    seeds = ranking.seed_union(V.v_requests(spark, sf), symbols)
    return traverse.bfs_distance(seeds, linking.resolved_edges(linking.link_symbols(symbols, files)), symbols)


# ================================================================ ranking and packing


@query(
    "keyword_score",
    with_views(
        _REQUEST_VIEWS,
        "select request_id, id, round(hits / n_words::double, 9) as keyword_score from hits where hits > 0",
        P.KEYWORD_STEPS,
    ),
)
def keyword_score(spark: Spark, sf: str) -> DataFrame:
    scores = ranking.keyword_score(V.v_requests(spark, sf), V.v_symbols(spark, sf))
    return scores.withColumn("keyword_score", F.round("keyword_score", 9))


def _scored(spark: Spark, sf: str) -> DataFrame:
    symbols, files = _tables(spark, sf)
    return ranking.score_context(V.v_requests(spark, sf), symbols, linking.link_symbols(symbols, files))


def _ranked(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Ranking and the symbols it is about."""
    symbols, files = _tables(spark, sf)
    links = linking.link_symbols(symbols, files)
    return ranking.rank_context(V.v_requests(spark, sf), symbols, links), symbols


def _rank_sql(body: str) -> str:
    return with_views(_REQUEST_VIEWS, body, P.COMPRESS_STEPS, recursive=True)


@query("rank_context", _rank_sql("select request_id, id, round(score, 9) as score, distance, rank from ranked"))
def rank_context(spark: Spark, sf: str) -> DataFrame:
    return _ranked(spark, sf)[0].withColumn("score", F.round("score", 9))


@query("rank_order", _rank_sql("select request_id, id, rank from ranked"))
def rank_order(spark: Spark, sf: str) -> DataFrame:
    """Ranks from one distributed sort, the way for requests of any size."""
    return ranking.rank_by_range(_scored(spark, sf)).select("request_id", "id", "rank")


@query(
    "full_body_flag",
    _rank_sql("select request_id, id, score >= 0.8::double or distance = 0 as full_body from ranked"),
)
def full_body_flag(spark: Spark, sf: str) -> DataFrame:
    return _scored(spark, sf).select(
        "request_id", "id", compress.full_body(F.col("score"), F.col("distance")).alias("full_body")
    )


@query(
    "line_order",
    with_views(
        ["v_symbols"],
        """select file_path, id, row_number() over (partition by file_path order by line_start, id)::int as position
        from v_symbols""",
    ),
)
def line_order(spark: Spark, sf: str) -> DataFrame:
    """Position of each symbol in its file; a file holds a bounded number of symbols."""
    rows = V.v_symbols(spark, sf).groupBy("file_path").agg(
        F.array_sort(F.collect_list(F.struct("line_start", "id"))).alias("rows")
    )
    return rows.select("file_path", F.posexplode("rows.id").alias("i", "id")).select(
        "file_path", "id", (F.col("i") + 1).alias("position")
    )


def _rendered(spark: Spark, sf: str) -> DataFrame:
    return compress.render(*_ranked(spark, sf))


@query("pack_by_file", _rank_sql("select request_id, file_path, piece, text from framed"))
def pack_by_file(spark: Spark, sf: str) -> DataFrame:
    ranked, symbols = _ranked(spark, sf)
    ranked = cut_lineage(ranked, "zstd")
    return compress.pack_by_file(compress.flags(ranked), compress.renderings(symbols))


@query(
    "compression_stats",
    _rank_sql(
        "select request_id, raw_bytes, optimized_bytes, included_count, round(savings_percent, 6) as savings_percent from stats"
    ),
)
def compression_stats(spark: Spark, sf: str) -> DataFrame:
    stats = compress.compression_stats(_rendered(spark, sf))
    return stats.withColumn("savings_percent", F.round("savings_percent", 6))


@query("compress_context", _rank_sql("select request_id, prompt from joined"))
def compress_context(spark: Spark, sf: str) -> DataFrame:
    """The whole prompt of every request in one row."""
    ranked, symbols = _ranked(spark, sf)
    ranked = cut_lineage(ranked, "zstd")
    prompts = compress.assemble(compress.pack_by_file(compress.flags(ranked), compress.renderings(symbols)), ranked)
    return compress.whole_prompts(prompts, ranked)


@query(
    "elided_bodies",
    _rank_sql(
        """select sha256(body)[1:12] as key, min(body) as body from v_symbols
        where id in (select id from rendered where not is_full) group by 1"""
    ),
)
def elided_bodies(spark: Spark, sf: str) -> DataFrame:
    ranked, symbols = _ranked(spark, sf)
    return compress.elided_bodies(compress.flags(ranked), symbols)


@query(
    "included_symbols",
    _rank_sql(
        """select request_id, ((rank - 1) // 1000)::int as block, list(id order by rank) as ids
        from ranked group by 1, 2"""
    ),
)
def included_symbols(spark: Spark, sf: str) -> DataFrame:
    return ranking.included_symbols(_ranked(spark, sf)[0])


def optimize(spark: Spark, sf: str) -> requests.Optimized:
    symbols, files = _tables(spark, sf)
    return requests.optimize(V.v_requests(spark, sf), symbols, linking.link_symbols(symbols, files))


@query(
    "optimize_context",
    _rank_sql(
        """select request_id, prompt as compressed_prompt, raw_tokens, optimized_tokens,
          round(token_savings, 6) as token_savings, included_count
        from joined join tokens using (request_id)"""
    ),
)
def optimize_context(spark: Spark, sf: str) -> DataFrame:
    return requests.optimized_prompts(optimize(spark, sf)).select(
        "request_id",
        F.col("prompt").alias("compressed_prompt"),
        "raw_tokens",
        "optimized_tokens",
        F.round("token_savings", 6).alias("token_savings"),
        "included_count",
    )


_PROMPT_MASK, _PROMPT_LAST = P.mask_steps("whole", "prompt")


@query(
    "prompt_pack",
    with_views(
        _REQUEST_VIEWS,
        f"""select request_id, p.stage, p.file_path, p.piece, prompt,
          case when p.stage = 0 then n else 0 end as items_masked
        from (select request_id, unnest(pieces) as p, unnest(string_split(now, {P.PIECE_MARK})) as prompt, n from {_PROMPT_LAST})
        union all select request_id, 2, '', 0, chr(10) || chr(10) || 'User Question:' || chr(10) || query, 0
        from v_requests where request_id in (select request_id from prompts)""",
        {**P.COMPRESS_STEPS, **_PROMPT_MASK},
        recursive=True,
    ),
)
def prompt_pack(spark: Spark, sf: str) -> DataFrame:
    """Every prompt masked as one text over its pieces, and the question as the last piece."""
    return requests.final_prompts(cut_lineage(optimize(spark, sf).prompts), V.v_requests(spark, sf))


@query("ccr_put", with_views(["v_symbols"], _CCR))
def ccr_put(spark: Spark, sf: str) -> DataFrame:
    """Bodies put twice, the second time those of one directory in ten, stay one row per key."""
    symbols = V.v_symbols(spark, sf)
    store = tables.ccr_table(_folder(spark, "ccr"))
    store.put(compress.ccr_store(symbols))
    store.put(compress.ccr_store(symbols.where(F.col("n") % 10 == 0)))
    return store.read(spark)


@query(
    "ccr_retrieve",
    with_views(
        ["v_symbols"],
        f"""select k.key, s.body, s.body is not null as success from (
          select doc_id, case when lang = 'fr' then 'absent' || doc_id else sha256(text)[1:12] end as key from documents) k
        left join ({_CCR}) s using (key)""",
    ),
)
def ccr_retrieve(spark: Spark, sf: str) -> DataFrame:
    """Keys of all documents; those of French ones are unknown."""
    key = F.when(F.col("lang") == "fr", F.concat(F.lit("absent"), F.col("doc_id").cast("string"))).otherwise(
        hashing.ccr_key(F.col("text"))
    )
    keys = V.table(spark, sf, "documents").select(key.alias("key"))
    return compress.ccr_retrieve(keys, compress.ccr_store(V.v_symbols(spark, sf)))


# ================================================================ masking


def _mask_sql(source: str, views: list[str], column: str, keys: str, rules: list[str] | None) -> str:
    steps, last = P.mask_steps(source, column, rules)
    return with_views(views, f"select {keys}, now as masked_text, n as items_masked from {last}", steps)


_MASK_QUERIES = {
    "mask_email": ["EMAIL"],
    "mask_ipv4": ["IPV4"],
    "mask_aws_key": ["AWS_KEY"],
    "mask_slack": ["SLACK_WEBHOOK"],
    "mask_jwt": ["JWT_TOKEN"],
    "mask_db_uri": ["DB_URI"],
    "mask_generic_secret": ["GENERIC_SECRET"],
    "mask_high_entropy": ["HIGH_ENTROPY"],
    "mask_text": None,
}


def _add_mask_query(name: str, rules: list[str] | None) -> None:
    def run(spark: Spark, sf: str) -> DataFrame:
        texts = V.v_secrets(spark, sf).withColumnRenamed("text", "original")
        return mask(texts, "original", rules=rules).drop("original")

    query(name, _mask_sql("v_secrets", ["v_secrets"], "text", "doc_id", rules))(run)


for _query_name, _rules in _MASK_QUERIES.items():
    _add_mask_query(_query_name, _rules)


@query("mask_documents", _mask_sql("documents", [], "text", "doc_id", None))
def mask_documents(spark: Spark, sf: str) -> DataFrame:
    return mask(V.table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


_COUNT_STEPS, _COUNT_LAST = P.mask_steps("v_secrets", "text")


@query(
    "mask_counts",
    with_views(
        ["v_secrets"],
        f"select doc_id, {', '.join(f'n_{r.lower()}' for r in RULE_NAMES)} from {_COUNT_LAST}",
        _COUNT_STEPS,
    ),
)
def mask_counts_query(spark: Spark, sf: str) -> DataFrame:
    return mask_counts(V.v_secrets(spark, sf), "text").drop("text")


# ================================================================ vectors and answers


@query(
    "vector_topk",
    f"""select vec_id as id, round({P.cosine("embedding", "(select embedding from embeddings where vec_id = 0)")}, 5) as score
    from embeddings order by {P.cosine("embedding", "(select embedding from embeddings where vec_id = 0)")} desc, vec_id
    limit 10""",
)
def vector_topk(spark: Spark, sf: str) -> DataFrame:
    """Nearest vectors of the first one."""
    own = V.v_vectors(spark, sf)
    probe = own.where(F.col("id") == 0).first()["vector"]
    return vec.vector_topk(own, probe, 10).select("id", F.round("score", 5).alias("score"))


@query(
    "vector_topk_batch",
    f"""select query_id, id, score, rank::int as rank from (
      select a.vec_id as query_id, b.vec_id as id, round({P.cosine("a.embedding", "b.embedding")}, 5) as score,
        row_number() over (partition by a.vec_id order by {P.cosine("a.embedding", "b.embedding")} desc, b.vec_id) as rank
      from embeddings a cross join embeddings b) where rank <= 5""",
)
def vector_topk_batch(spark: Spark, sf: str) -> DataFrame:
    own = V.v_vectors(spark, sf)
    probes = own.select(F.col("id").alias("query_id"), F.col("vector").alias("probe"))
    return vec.nearest(probes, own, 5).withColumn("score", F.round("score", 5))


_BEST_STEPS = {
    "scored": f"select r.request_id, r.path, r.hash, c.seq, {P.cosine('r.embedding', 'c.embedding')} as score, c.response, "
    "c.path as cached_path, c.hash as cached_hash from v_answer_requests r cross join v_answer_cache c",
    "best": "select * from (select *, row_number() over (partition by request_id order by score desc, seq) as rn from scored) where rn = 1",
    "lookup": """
      select request_id, ok as hit, case when ok then seq end as seq, case when ok then round(score, 5) end as score,
        case when ok then response end as response
      from (select *, score >= 0.92::double and (cached_path is null
        or coalesce(cached_path = path and cached_hash = hash, false)) as ok from best)""",
}
_ANSWER_VIEWS = ["v_answer_cache", "v_answer_requests"]


@query("nearest_cached", with_views(_ANSWER_VIEWS, "select request_id, seq, round(score, 5) as score from best", _BEST_STEPS))
def nearest_cached(spark: Spark, sf: str) -> DataFrame:
    best = answers.nearest_cached(V.v_answer_requests(spark, sf), V.v_answer_cache(spark, sf))
    return best.withColumn("score", F.round("score", 5))


@query("answer_lookup", with_views(_ANSWER_VIEWS, "select * from lookup", _BEST_STEPS))
def answer_lookup(spark: Spark, sf: str) -> DataFrame:
    found = answers.answer_lookup(V.v_answer_requests(spark, sf), V.v_answer_cache(spark, sf))
    return found.withColumn("score", F.round("score", 5))


@query(
    "cache_validity",
    with_views(
        _ANSWER_VIEWS,
        """select c.seq, c.path is null or coalesce(c.path = r.path and c.hash = r.hash, false) as valid
        from v_answer_cache c join v_answer_requests r on r.request_id = c.seq""",
    ),
)
def cache_validity(spark: Spark, sf: str) -> DataFrame:
    """Each cached answer against the hashes a request of the same number sees."""
    cached = V.v_answer_cache(spark, sf).select("seq", F.col("file_hashes").alias("cached"))
    now = V.v_answer_requests(spark, sf).select(F.col("request_id").alias("seq"), "file_hashes")
    return cached.join(now, "seq").select(
        "seq", answers.hashes_valid(F.col("cached"), F.col("file_hashes")).alias("valid")
    )


@query(
    "request_file_hashes",
    with_views(
        _REQUEST_VIEWS,
        """select r.request_id, coalesce(list_sort(list(f.file_path || '=' || f.sha256)
            filter (where f.file_path is not null)), []) as hashes
        from (select distinct request_id, unnest(open_files) as file_path from v_requests) r
        left join v_symbol_files f using (file_path) group by r.request_id""",
    ),
)
def request_file_hashes(spark: Spark, sf: str) -> DataFrame:
    found = answers.request_file_hashes(V.v_requests(spark, sf), V.v_symbol_files(spark, sf))
    pairs = F.transform(F.map_entries("file_hashes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("request_id", F.sort_array(pairs).alias("hashes"))


@query(
    "changed_files",
    with_views(
        ["v_files", "v_files_prev"],
        """select file_path, sha256 from v_files f where not exists (
          select 1 from v_files_prev p where p.file_path = f.file_path and p.sha256 = f.sha256)""",
    ),
)
def changed_files(spark: Spark, sf: str) -> DataFrame:
    return catalog.changed_files(V.v_files(spark, sf), V.v_files_prev(spark, sf)).select("file_path", "sha256")


# ================================================================ audit and reports


@query(
    "audit_rows",
    with_views(
        [*_ANSWER_VIEWS, "v_audit"],
        """select 'batch' as user_id, 'acme' as provider, 'm1' as model,
          case when l.hit then 1000 else n_raw end as raw_tokens, case when l.hit then 0 else n_opt end as optimized_tokens,
          case when l.hit then 100.0::double else 50.0::double end as savings_percent, 5 as duration_ms,
          timestamp '2024-01-01 00:00:00' as ts
        from lookup l join (select vec_id as request_id, (vec_id * 4)::int as n_raw, (vec_id * 2)::int as n_opt
          from embeddings) using (request_id)""",
        _BEST_STEPS,
    ),
)
def audit_rows(spark: Spark, sf: str) -> DataFrame:
    """Hits get fixed figures, misses their own."""
    asked = V.v_answer_requests(spark, sf)
    tokens = asked.select(
        "request_id",
        (F.col("request_id") * 4).cast("int").alias("raw_tokens"),
        (F.col("request_id") * 2).cast("int").alias("optimized_tokens"),
        F.lit(50.0).alias("token_savings"),
    )
    described = asked.select(
        "request_id",
        F.lit("batch").alias("user_id"),
        F.lit("acme").alias("provider"),
        F.lit("m1").alias("model"),
        F.lit(5).alias("duration_ms"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"),
    )
    rows = answers.audit_rows(described, answers.answer_lookup(asked, V.v_answer_cache(spark, sf)), tokens)
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_REPORT = """
  count(*) as requests, count(*) filter (raw_tokens > 0) as passed,
  count(*) filter (not raw_tokens > 0) as failed,
  coalesce(sum(raw_tokens) filter (raw_tokens > 0), 0)::bigint as raw_tokens,
  coalesce(sum(optimized_tokens) filter (raw_tokens > 0), 0)::bigint as optimized_tokens,
  (coalesce(sum(raw_tokens) filter (raw_tokens > 0), 0)
    - coalesce(sum(optimized_tokens) filter (raw_tokens > 0), 0))::bigint as saved_tokens,
  round((sum(raw_tokens) filter (raw_tokens > 0) - sum(optimized_tokens) filter (raw_tokens > 0)) * 100.0::double
    / sum(raw_tokens) filter (raw_tokens > 0), 8) as saved_percent,
  round(avg(savings_percent) filter (raw_tokens > 0), 8) as mean_savings_percent,
  round(avg(duration_ms) filter (raw_tokens > 0), 8) as mean_duration_ms,
  round((coalesce(sum(raw_tokens) filter (raw_tokens > 0), 0)
    - coalesce(sum(optimized_tokens) filter (raw_tokens > 0), 0))::bigint * 2.5::double / 1000000, 8) as dollars_saved"""
_ROUNDED = ["saved_percent", "mean_savings_percent", "mean_duration_ms", "dollars_saved"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) for c in _ROUNDED})


@query("savings_report", with_views(["v_audit"], f"select {_REPORT} from v_audit"))
def savings_report(spark: Spark, sf: str) -> DataFrame:
    return _rounded(report.savings_report(V.v_audit(spark, sf)))


@query(
    "throughput",
    with_views(
        ["v_audit"],
        """select requests, round(seconds, 6) as seconds, round(requests / seconds, 6) as requests_per_second from (
          select count(*) as requests, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 as seconds from v_audit)""",
    ),
)
def throughput(spark: Spark, sf: str) -> DataFrame:
    return report.throughput(V.v_audit(spark, sf)).select(
        "requests",
        F.round("seconds", 6).alias("seconds"),
        F.round("requests_per_second", 6).alias("requests_per_second"),
    )


# ================================================================ pipelines


@query("index_sources")
def index_sources(spark: Spark, sf: str) -> DataFrame:
    """Per file: language, imports, symbols and references found."""
    done = index.index_sources(V.v_code(spark, sf), "/ws")
    symbols = done.symbols.groupBy("file_path").agg(
        F.count("*").alias("n_symbols"), F.sum(F.octet_length("body")).alias("symbol_bytes")
    )
    refs = (
        done.links.refs.join(done.symbols.select("id", "file_path"), "id")
        .groupBy("file_path")
        .agg(F.count("*").alias("n_references"))
    )
    return (
        done.files.select("file_path", "language", F.size("imports").alias("n_imports"))
        .join(symbols, "file_path", "left")
        .join(refs, "file_path", "left")
        .na.fill(0)
    )


# ================================================================ streams


def _folder(spark: Spark, name: str) -> str:
    """Fresh folder in the shared place for materialised tables."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark: Spark, sf: str, name: str) -> DataFrame:
    schema = V.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


_ADDED = "\nclass Added:\n    pass\n"
_NOW_STEPS = {
    "v_code_now": f"""
      select file_path, case when file_path like '%.py' and length(file_path) % 2 = 1 then content || {text(_ADDED)}
        else content end as content from v_code""",
    **{name: re.sub(r"\bv_code\b", "v_code_now", step) for name, step in _DECLARED_STEPS.items()},
}


@query("stream_changed_files", with_views(["v_code"], f"select {_DECLARED} from declared", _NOW_STEPS))
def stream_changed_files(spark: Spark, sf: str) -> DataFrame:
    """Declarations after three batches of file versions: all files, Python files with a class more, half of those without."""
    code = V.v_code(spark, sf)
    python = code.where(F.col("file_path").endswith(".py"))
    back = python.where(F.length("file_path") % 2 == 0)
    arriving, offsets = _folder(spark, "versions"), _folder(spark, "offsets")
    files = KeyedTable(_folder(spark, "files"), ["file_path"], StructType.fromDDL("file_path string, sha256 string"))
    symbols = KeyedTable(_folder(spark, "symbols"), ["file_path"], SYMBOLS)

    def parse(changed: DataFrame) -> DataFrame:
        described = extract.describe_files(changed.select("file_path", "content"))
        return extract.declarations(described.where(F.col("language") != "go")).withColumn("dependencies", F.lit(None))

    fields = "file_path string, content string, version int"
    for i, state in enumerate([code, python.withColumn("content", F.concat("content", F.lit(_ADDED))), back]):
        state.withColumn("version", F.lit(i)).write.mode("append").parquet(arriving)
        jobs.stream_changed_files(
            spark.readStream.schema(fields).parquet(arriving).withColumn("sha256", F.sha2("content", 256)),
            files,
            symbols,
            offsets,
            parse,
        ).awaitTermination()
    return symbols.read(spark).withColumn("language", paths.language(F.col("file_path"))).select(*_DECLARED.split(", "))


_TWO_BATCHES = {
    "lookup_0": """
      select request_id, path, hash, embedding, coalesce(ok, false) as hit, case when ok then score end as score,
        case when ok then response end as response
      from (select r.request_id, r.path, r.hash, r.embedding, c.response, {cosine} as score,
          {cosine} >= 0.92::double and (c.path is null or coalesce(c.path = r.path and c.hash = r.hash, false)) as ok,
          row_number() over (partition by r.request_id order by {cosine} desc, c.seq) as rn
        from v_answer_requests r cross join v_answer_cache c where r.request_id % 2 = 0) where rn = 1""",
    "grown": """
      select seq, path, hash, embedding, response from v_answer_cache union all
      select 1000000000 + request_id, path, hash, embedding, 'fresh answer ' || request_id from lookup_0 where not hit""",
    "lookup_1": """
      select request_id, coalesce(ok, false) as hit, case when ok then score end as score, case when ok then response end as response
      from (select r.request_id, c.response, {cosine} as score,
          {cosine} >= 0.92::double and (c.path is null or coalesce(c.path = r.path and c.hash = r.hash, false)) as ok,
          row_number() over (partition by r.request_id order by {cosine} desc, c.seq) as rn
        from v_answer_requests r cross join grown c where r.request_id % 2 = 1) where rn = 1""",
}


@query(
    "stream_answer_lookup",
    with_views(
        _ANSWER_VIEWS,
        """select request_id, hit, round(score, 5) as score, response from lookup_0
        union all select request_id, hit, round(score, 5), response from lookup_1""",
        {name: step.replace("{cosine}", P.cosine("r.embedding", "c.embedding")) for name, step in _TWO_BATCHES.items()},
    ),
)
def stream_answer_lookup(spark: Spark, sf: str) -> DataFrame:
    """Requests arrive in two batches; the second also finds the answers that the misses of the first got."""
    asked = V.v_answer_requests(spark, sf)
    cache = KeyedTable(_folder(spark, "cache"), ["seq"], ANSWERS)
    cache.put(V.v_answer_cache(spark, sf).withColumn("created_at", F.lit(None).cast("timestamp")), 0)
    arriving, out, offsets = _folder(spark, "requests"), _folder(spark, "lookup"), _folder(spark, "offsets")

    def answer(misses: DataFrame) -> DataFrame:
        said = F.concat(F.lit("fresh answer "), F.col("request_id").cast("string"))
        return misses.withColumns({"query": said, "response": said, "created_at": F.lit(None).cast("timestamp")})

    for part in (0, 1):
        asked.where(F.col("request_id") % 2 == part).select("request_id").write.mode("append").parquet(arriving)
        requests_now = spark.readStream.schema("request_id long").parquet(arriving).join(asked, "request_id")
        jobs.stream_answer_lookup(requests_now, cache, out, offsets, answer=answer).awaitTermination()
    return spark.read.parquet(out).select("request_id", "hit", F.round("score", 5).alias("score"), "response")


@query(
    "windowed_savings",
    with_views(
        ["v_audit"],
        f"""select time_bucket(interval 1 hour, ts) as window_start,
          time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, {_REPORT} from v_audit group by 1, 2""",
    ),
)
def windowed_savings(spark: Spark, sf: str) -> DataFrame:
    return _plain_windows(jobs.windowed_savings(V.v_audit(spark, sf)))


def _plain_windows(df: DataFrame) -> DataFrame:
    """Window bounds without time zone."""
    return _rounded(df).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query(
    "stream_savings",
    with_views(
        ["v_audit"],
        f"""select time_bucket(interval 1 hour, ts) as window_start,
          time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, {_REPORT} from v_audit group by 1, 2
        having window_end <= (select max(ts) from v_audit) - interval 2 hours""",
    ),
)
def stream_savings(spark: Spark, sf: str) -> DataFrame:
    """Windows the watermark has closed."""
    out = _folder(spark, "savings")
    jobs.stream_savings(
        V.audit_of(_stream(spark, sf, "events")), out, _folder(spark, "offsets")
    ).awaitTermination()
    return _plain_windows(spark.read.parquet(out))
