"""SQL of shared expressions and steps."""

from __future__ import annotations

from suite.views_sql import fields, text, trim_space
from threadloom.functions.secrets import (
    PATTERNS,
    RULES,
    SECRET_ENTROPY,
    SWEEP_ENTROPY,
    SWEEP_MAX_BYTES,
    SWEEP_MIN_BYTES,
    SWEEP_TRIM,
)
from threadloom.functions.paths import FENCES, LANGUAGES
from threadloom.operators.compress import LINES_PER_PIECE, preamble


def _case(subject: str, table: dict[str, str], default: str) -> str:
    arms = " ".join(f"when {text(k)} then {text(v)}" for k, v in table.items())
    return f"case {subject} {arms} else {text(default)} end"


def language(path: str) -> str:
    return _case(f"lower(regexp_extract({path}, '(\\.[^./]*)$', 1))", LANGUAGES, "unknown")


def fence(path: str) -> str:
    return _case(f"lower(string_split({path}, '.')[-1])", FENCES, "")


def clean_lines(code: str, path: str) -> str:
    bare = trim_space("l")
    marker = f"(case when {fence(path)} = 'python' then '#' else '//' end)"
    return (
        f"array_to_string(list_filter(string_split({code}, chr(10)), lambda l: {bare} <> '' and "
        f"(not starts_with({bare}, {marker}) or contains({bare}, 'optimized out'))), chr(10))"
    )


def skeleton(signature: str, body: str, path: str) -> str:
    note = f"' ... method body optimized out (CCR Key: ' || sha256({body})[1:12] || ')'"
    return (
        f"case when {fence(path)} = 'python' then {signature} || chr(10) || '    #' || {note} "
        f"else {signature} || ' {{' || chr(10) || '    //' || {note} || chr(10) || '}}' end"
    )


def entropy(x: str) -> str:
    share = f"((length({x}) - length(replace({x}, ch, ''))) / strlen({x})::double)"
    return (
        f"coalesce(list_sum(list_transform(list_distinct(string_split({x}, '')), "
        f"lambda ch: -{share} * log2({share}))), 0.0::double)"
    )


def savings_percent(raw: str, optimized: str) -> str:
    return (
        f"case when {raw} > 0 then greatest(0.0::double, ({raw} - {optimized}) / ({raw})::double * 100.0::double) "
        f"else 0.0::double end"
    )


def _values(rule: str, now: str, original: str) -> str:
    if rule == "HIGH_ENTROPY":
        bare = f"list_transform({fields(original)}, lambda w: trim(w, {text(SWEEP_TRIM)}))"
        return (
            f"list_filter({bare}, lambda v: strlen(v) between {SWEEP_MIN_BYTES} and {SWEEP_MAX_BYTES} "
            f"and not contains(v, 'MASKED') and {entropy('v')} > {SWEEP_ENTROPY})"
        )
    pattern = text(PATTERNS[rule])
    if rule == "DB_URI":
        return f"regexp_extract_all({now}, {pattern}, 1)"
    if rule == "GENERIC_SECRET":
        return (
            f"list_filter(regexp_extract_all({now}, {pattern}, 1), lambda v: {entropy('v')} > {SECRET_ENTROPY})"
        )
    return f"regexp_extract_all({now}, {pattern})"


def mask_steps(source: str, column: str, rules: list[str] | None = None) -> tuple[dict[str, str], str]:
    """Steps that add now (masked text), n (items) and n_<rule>; and the name of the last step."""
    steps = {"m0": f"select *, {column} as now, 0 as n from {source}"}
    last = "m0"
    for i, rule in enumerate(r for r in RULES if rules is None or r.name in rules):
        steps[f"v{i + 1}"] = f"select *, {_values(rule.name, 'now', column)} as vals from {last}"
        hits = "len(vals)"
        if rule.per_label:
            hits = f"(case when len(vals) > 0 and not contains(now, {text(rule.placeholder)}) then 1 else 0 end)"
        steps[f"m{i + 1}"] = (
            f"select * exclude (now, n, vals), {hits}::int as n_{rule.name.lower()}, (n + {hits})::int as n, "
            f"list_reduce(list_prepend(now, vals), lambda a, m: replace(a, m, {text(rule.placeholder)})) as now "
            f"from v{i + 1}"
        )
        last = f"m{i + 1}"
    return steps, last


PIECE_MARK = "chr(57344)"
LOWER_WORDS = fields("lower(query)")

# Files that see each other, edges by text and by call.
_SEES = (
    "(s.dir = t.dir or len(list_filter(f.imports, lambda i: string_split(i, '/')[-1] = "
    "string_split(t.dir, '/')[-1] or contains(t.file_path, i))) > 0)"
)


def _edges(condition: str) -> str:
    return (
        "select distinct s.id as src_id, t.id as dst_id from v_symbols s join v_symbol_files f using (file_path) "
        f"join v_symbols t on {condition} and s.id <> t.id and {_SEES}"
    )


LEXICAL_EDGES = _edges("contains(s.body, t.name)")
CALL_EDGES = _edges("list_contains(list_transform(s.dependencies, lambda d: string_split(d, '.')[-1]), t.name)")
EDGE_STEPS = {"edges": f"select * from ({LEXICAL_EDGES}) union select * from ({CALL_EDGES})"}

ACTIVE = """
  select request_id, id from (
    select r.request_id, s.id,
      row_number() over (partition by r.request_id order by s.line_end - s.line_start, s.id) as rn
    from v_requests r join v_symbols s
      on r.cursor_file = s.file_path and r.cursor_line between s.line_start and s.line_end)
  where rn = 1"""
OPENED = """
  select distinct r.request_id, s.id
  from (select request_id, unnest(open_files) as file_path from v_requests) r join v_symbols s using (file_path)"""
BFS_STEPS = {
    "active": ACTIVE,
    "opened": OPENED,
    "seeds": "select * from active union select * from opened",
    **EDGE_STEPS,
    "hops": "select src_id as a, dst_id as b from edges union select dst_id, src_id from edges",
    "walk": (
        "select request_id, id, 0 as d from seeds union "
        "select w.request_id, h.b, w.d + 1 from walk w join hops h on w.id = h.a where w.d < 3"
    ),
    "dist": "select request_id, id, min(d)::int as distance from walk group by all",
}
KEYWORD_STEPS = {
    "asked": f"select request_id, {LOWER_WORDS} as words from v_requests",
    "low": (
        "select id, lower(name) as ln, lower(signature) as ls, lower(body) as lb from v_symbols"
    ),
    "hits": (
        "select request_id, id, len(words) as n_words, list_sum(list_transform(list_filter(words, "
        "lambda w: strlen(w) >= 3), lambda w: case when contains(ln, w) then 5 when contains(ls, w) then 3 "
        "when contains(lb, w) then 1 else 0 end))::bigint as hits from asked cross join low"
    ),
}
RANK_STEPS = {
    **BFS_STEPS,
    **KEYWORD_STEPS,
    "scored": """
      select h.request_id, h.id, coalesce(d.distance, -1) as distance,
        coalesce(1.0::double / (d.distance + 1), 0.0::double) + coalesce(h.hits / h.n_words::double, 0.0::double)
          + case when a.id is not null then 1.5::double else 0.0::double end
          + case when o.id is not null then 0.5::double else 0.0::double end as score
      from hits h left join dist d using (request_id, id)
        left join active a on a.request_id = h.request_id and a.id = h.id
        left join opened o on o.request_id = h.request_id and o.id = h.id""",
    "ranked": """
      select *, row_number() over (partition by request_id order by round(score, 9) desc, id) as rank
      from scored where score > 0""",
}
COMPRESS_STEPS = {
    **RANK_STEPS,
    "texts": (
        f"select id, file_path, line_start, strlen(body) as raw_bytes, {clean_lines('body', 'file_path')} as full_text, "
        f"{clean_lines('skel', 'file_path')} as skeleton_text from "
        f"(select *, {skeleton('signature', 'body', 'file_path')} as skel from v_symbols)"
    ),
    "rendered": """
      select request_id, id, file_path, line_start, raw_bytes, score >= 0.8::double or distance = 0 as is_full,
        case when score >= 0.8::double or distance = 0 then full_text else skeleton_text end as text
      from ranked join texts using (id)""",
    "sections": f"""
      select request_id, file_path, ((line_start - 1) // {LINES_PER_PIECE})::int as piece,
        string_agg(text || chr(10) || chr(10), '' order by line_start, id) as body
      from rendered group by all""",
    "framed": f"""
      select request_id, file_path, piece,
        case when piece = min(piece) over w then '### File: ' || file_path || chr(10) || '```'
          || {fence("file_path")} || chr(10) else '' end || body
        || case when piece = max(piece) over w then '```' || chr(10) || chr(10) else '' end as text
      from sections window w as (partition by request_id, file_path)""",
    "prompts": f"""
      select distinct request_id, 0 as stage, '' as file_path, 0 as piece, {text(preamble())} as prompt from framed
      union all select request_id, 1, file_path, piece, text from framed""",
    "joined": """
      select request_id, string_agg(prompt, '' order by stage, file_path, piece) as prompt from prompts group by request_id""",
    # One text per request, with a mark between the pieces that no pattern takes.
    "whole": f"""
      select request_id, string_agg(prompt, {PIECE_MARK} order by stage, file_path, piece) as prompt,
        list(struct_pack(stage, file_path, piece) order by stage, file_path, piece) as pieces
      from prompts group by request_id""",
    "stats": f"""
      select *, {savings_percent("raw_bytes", "optimized_bytes")} as savings_percent from (
        select request_id, sum(raw_bytes)::bigint as raw_bytes, sum(strlen(text))::bigint as optimized_bytes,
          count(*) as included_count
        from rendered group by request_id)""",
    "tokens": """
      select request_id, (raw_bytes // 4)::int as raw_tokens, (optimized_bytes // 4)::int as optimized_tokens,
        savings_percent as token_savings, included_count from stats""",
}

COSINE_STEP = """
  coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] * p[2])::double))
    / nullif(sqrt(list_sum(list_transform({a}, lambda x: (x * x)::double)))
      * sqrt(list_sum(list_transform({b}, lambda x: (x * x)::double))), 0), 0.0::double)"""


def cosine(a: str, b: str) -> str:
    return COSINE_STEP.format(a=a, b=b)


