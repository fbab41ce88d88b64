"""The views of ``suite.views`` in SQL, for checking results with a second engine."""

from __future__ import annotations

from suite.templates import TEMPLATES
from suite.views import EXTENSIONS, SYMBOL_EXTENSIONS

WS = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def text(value: str) -> str:
    """String literal."""
    return "'" + value.replace("'", "''") + "'"


def pick(values: list[str], index: str) -> str:
    return "[" + ", ".join(text(v) for v in values) + f"][({index}) + 1]"


def trim_space(x: str) -> str:
    return f"regexp_replace({x}, {text(f'^{WS}+|{WS}+$')}, '', 'g')"


def fields(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {text(WS + '+')}), lambda w: w <> '')"


_FILE_PATH = (
    "'/ws/' || case when doc_id % 50 = 0 then '.hidden/' else '' end || source || '/f' || doc_id || '.' || "
    + pick(EXTENSIONS, "doc_id % 12")
)


def _code() -> str:
    cases = []
    for extensions, mark, template in TEMPLATES:
        filled = text(template)
        for slot, value in {
            "@W@": "upper(w[1]) || w[2:]",
            "@w@": "w",
            "@n@": "doc_id::varchar",
            "@t@": f"{text(mark)} || replace(text, chr(10), chr(10) || {text(mark)})",
        }.items():
            filled = f"replace({filled}, {text(slot)}, {value})"
        listed = ", ".join(text(e) for e in extensions)
        cases.append(f"when {pick(EXTENSIONS, 'doc_id % 12')} in ({listed}) then {filled}")
    word = "lower(case when regexp_extract(text, '[A-Za-z]{5,}') = '' then 'item' else regexp_extract(text, '[A-Za-z]{5,}') end)"
    return (
        f"select {_FILE_PATH} as file_path, case {' '.join(cases)} end as content "
        f"from (select *, {word} as w from documents)"
    )


def _request_file(item: str) -> str:
    return (
        f"'/ws/src' || (({item}) % 20) || '_' || (({item}) // 40) || '/m' || (({item}) % 5) || '.' || "
        + pick(SYMBOL_EXTENSIONS, f"({item}) % 5")
    )


def _near(step: int) -> str:
    return f"((n + {step}) % 20) || '_' || g"


VIEWS = {
    "v_files": f"""
        select doc_id, source, lang, {_FILE_PATH} as file_path, text as content, sha256(text) as sha256,
          ['lib/src' || ((substr(source, 4)::int + 1) % 20)] as imports
        from documents""",
    "v_files_prev": """
        select doc_id, source, lang, file_path, content, sha256(content) as sha256, imports from (
          select * replace (case when lang = 'fr' then content || 'x' else content end as content)
          from v_files where source <> 'src3')""",
    "v_code": _code(),
    "v_symbols": f"""
        select file_path || ':d' || doc_id as id, file_path || ':' || name as dup_id, name,
          'function' as type, file_path, (line_end - size + 1)::int as line_start, line_end::int as line_end,
          split_part(text, chr(10), 1) as signature, text as body,
          list_transform(regexp_extract_all(text, '[A-Z][a-z]{{4,}}'), lambda w: 'pkg.' || w) as dependencies,
          dir, doc_id, k, n, g
        from (
          select *, sum(size) over (partition by file_path order by doc_id) as line_end
          from (
            select *, dir || '/m' || k || '.' || {pick(SYMBOL_EXTENSIONS, "k")} as file_path
            from (
              select doc_id, text, len(string_split(text, chr(10))) as size,
                '/ws/' || source || '_' || (doc_id // 2000) as dir, (doc_id // 20) % 5 as k,
                substr(source, 4)::int as n, doc_id // 2000 as g,
                regexp_extract(text, '[A-Za-z]{{5,}}') as name
              from documents)))
        where name <> ''""",
    "v_symbol_files": f"""
        select distinct file_path, dir, sha256(file_path) as sha256,
          case when k = 0 then ['lib/src' || {_near(1)}, 'ws/src' || {_near(2)} || '/m1']
            else ['lib/src' || {_near(1)}] end as imports
        from v_symbols""",
    "v_requests": f"""
        select item_id as request_id, text as query,
          case when item_id % 2 = 0 then [{_request_file("item_id")}]
            else [{_request_file("item_id + 1")}] end as open_files,
          {_request_file("item_id")} as cursor_file, (1 + (item_id * 7) % 40)::int as cursor_line,
          case when item_id % 3 <> 0 then (item_id * 100)::int end as max_tokens,
          case when item_id % 4 <> 0 then 'acme' end as provider,
          case when item_id % 5 <> 0 then 'm1' else '' end as model
        from benchmark""",
    "v_answer_cache": """
        select vec_id as seq, 'question ' || vec_id as query, 'answer ' || vec_id as response, embedding,
          case when label = 9 then null else 'f' || label end as path,
          case when label = 9 then null else sha256(label::varchar) end as hash
        from embeddings""",
    "v_answer_requests": """
        select a.vec_id as request_id,
          list_transform(list_zip(a.embedding, coalesce(b.embedding, a.embedding)), lambda p:
            ((1 - ((a.vec_id // 10) % 5) * 0.1::double) * p[1]::double
              + (((a.vec_id // 10) % 5) * 0.1::double) * p[2]::double)::float) as embedding,
          case when a.label = 5 then null else 'f' || a.label end as path,
          case when a.label = 5 then null when a.label = 3 then sha256(a.label || 'x')
            else sha256(a.label::varchar) end as hash
        from embeddings a left join embeddings b on b.vec_id = a.vec_id + 1""",
    "v_secrets": """
        select doc_id, text || case when doc_id % 2 = 0 then chr(10) || 'é' else chr(10) || 'key ' end
          || case doc_id % 7
            when 0 then 'AKIA' || upper(s[1:16])
            when 1 then 'https://hooks.slack.com/services/T' || upper(s[1:6]) || '/B' || upper(s[7:12]) || '/'
              || s[20:31]
            when 2 then 'eyJ' || s[1:12] || '.eyJ' || s[13:24] || '.' || s[25:44]
            when 3 then 'user' || doc_id || '@mail.example.org'
            when 4 then '10.0.' || (doc_id % 256) || '.17'
            when 5 then 'postgres://admin:' || s[1:12] || '@db.example.org:5432/app'
            else 'api_key = "' || case when doc_id % 3 = 0 then 'QWERTYUIOPASDFGHJKLZ' else '' end
              || s[1:24] || '"' end
          || case when doc_id % 4 < 2 then 'è end' else ' end' end as text
        from (select doc_id, text, sha256(doc_id::varchar) as s from documents)""",
    "v_conn": """
        select c_custkey, case c_custkey % 3
          when 0 then 'postgres://' || c_name || ':pw' || c_custkey || '@db' || (c_custkey % 10) || ':5432/app'
          when 1 then 'postgres://' || c_name || '@db' || (c_custkey % 10) || ':5432/app'
          else '' end as conn
        from customer""",
    "v_audit": """
        select user_id::varchar as user_id, event_type as provider, 'm' || (user_id % 3) as model,
          floor(value * 100)::int as raw_tokens, floor(value * 30)::int as optimized_tokens,
          case when floor(value * 100) > 0
            then (floor(value * 100)::int - floor(value * 30)::int) * 100.0::double / floor(value * 100)::int
            else 0.0::double end as savings_percent,
          (event_id % 500)::int as duration_ms, ts
        from events""",
}
NEEDS = {
    "v_files_prev": ["v_files"],
    "v_symbol_files": ["v_symbols"],
}


def with_views(names: list[str], query: str, more: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Query behind the views it needs, ``more`` being named steps of its own."""
    steps: dict[str, str] = {}
    for name in names:
        for need in [*NEEDS.get(name, []), name]:
            steps[need] = VIEWS[need]
    steps.update(more or {})
    if not steps:
        return query
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(f"{n} as ({q})" for n, q in steps.items()) + "\n" + query
