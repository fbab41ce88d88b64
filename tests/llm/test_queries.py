"""Each query against SQL or a brute-force version, on given tables and on small tables of awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom.llm.queries import QUERIES, SQL

DOCS = "doc_id bigint, text string, lang string, source string, key string, id bigint, c int, score double"
COMMON = " ".join(f"word{i}" for i in range(40))
BYTES = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(700))
TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "one",
    COMMON,
    COMMON,
    COMMON + " tail",
    "Lead " + COMMON.upper(),
    "a " * 600,
    "x" * 1500,
    BYTES,
    "prefix é " + BYTES[100:650] + " suffix 日本",
    " ".join(f"w{i % 7}" for i in range(200)) + " " + COMMON,
    " ".join(f"long{i}" for i in range(20000)) + " " + COMMON,
]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Nulls, empty and very long texts, ties and extra columns whose names clash with inner ones."""
    at = str(tmp_path_factory.mktemp("awkward"))
    rows = [(i, t, None if i % 2 else "en", "s", None, 7, 1, 0.5) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    items = [(1, COMMON), (2, "one"), (3, None), (4, ""), (5, "w1 w2 w3"), (6, "absent words")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    vectors = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [1.0, 0.3]), (7, [1.0, 0.31]), (8, [0.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    labels = [(i, int(i % 2)) for i in range(len(TEXTS))]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(1, "u", None), (2, "u", ""), (3, None, "<p>plain"), (4, "v", PAGE)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ["documents", "benchmark", "embeddings", "labels", "pages"]:
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return at


STORY = "The river rose in the night, and by morning, as the keepers had feared, the lower fields were under water. "
PAGE = (
    "<html><head><title>t</title><script>var a = 1;</script></head><body><nav><a href='/'>Home</a> <a href='/b'>Menu</a></nav>"
    f"<div><article><p>{STORY * 3}</p><p>Second &amp; last, {STORY * 3}</p></article></div><footer>Copyright notice</footer></body></html>"
)


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted(map(repr, (tuple(r[n] for n in names) for r in frame.collect())))


def by_sql(name, at):
    with duckdb.connect() as db:
        for table in ["documents", "benchmark", "embeddings"]:
            path = f"{at}/{table}.parquet"
            db.execute(f"create view {table} as select * from read_parquet(['{path}' || (case when '{at}' like '/root/%' then '' else '/*.parquet' end)])")
        done = db.execute(SQL[name])
        names = [d[0] for d in done.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(repr(tuple(r[i] for i in order)) for r in done.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("which", ["sf", "awkward"])
def test_sql(spark, request, name, which):
    at = request.getfixturevalue(which)
    assert rows_of(QUERIES[name](spark, at)) == by_sql(name, at)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("which", ["sf", "awkward"])
def test_byte_repeats_by_brute_force(spark, request, which):
    at = request.getfixturevalue(which)
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()}
    seen = Counter(t[i : i + 400] for t in texts.values() for i in range(len(t) - 399))
    want = {}
    for doc, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\x01" * 400
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[doc] = (len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = QUERIES["op9_suffix_array_dedup"](spark, at).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


@pytest.mark.parametrize("which", ["sf", "awkward"])
def test_pieces_of_the_packing(spark, request, which):
    import public_tokenizers
    from tokenizers import Tokenizer

    at = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = QUERIES["op3_packing"](spark, at).collect()
    places, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 2048
    for doc in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect():
        ids = tokenizer.encode(doc.text or "", add_special_tokens=False).ids + [1]
        end = 0
        for r in sorted(pieces[doc.doc_id], key=lambda r: r.start):
            assert r.start == end and r.doc_tokens == len(ids)
            part = b"".join(i.to_bytes(4, "little") for i in ids[end : end + r.length])
            assert r.ids_crc32 == zlib.crc32(part)
            end += r.length
        assert end == len(ids)


@pytest.mark.parametrize("which", ["sf", "awkward"])
def test_shards(spark, request, which):
    at = request.getfixturevalue(which)
    got = QUERIES["op8_sharding"](spark, at).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in texts.items()}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1


def test_toxicity_held_out(spark):
    at = "/root/testdata/sf0.01"
    got = QUERIES["op6_toxicity"](spark, at).join(spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    held = got.where("held_out")
    right = held.where("predicted = toxic").count() / held.count()
    assert right >= 0.95
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)).count() == 0


def test_toxicity_awkward(spark, awkward):
    got = QUERIES["op6_toxicity"](spark, awkward).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(TEXTS))) and all(0 <= r.score <= 1 for r in got)


def test_main_text(spark, awkward):
    got = {r.page_id: r for r in QUERIES["op2_html_extraction"](spark, awkward).collect()}
    story = (STORY * 3).strip()
    assert got[1].text == got[2].text == "" and got[3].text == "plain"
    assert got[4].text == f"{story}\nSecond & last, {story}" and got[4].n_chars == len(got[4].text)


def test_template_lines(spark):
    from threadloom.llm import line_templates

    rows = [(i, f"own line number{'abcdefghijklmnopqrstuvwxyz'[i % 26]} kept by {chr(65 + i % 26) * 3} alone\nPage {i} of 90 visited at 10:{i:02d}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n")]
    got = {r.doc_id: r for r in line_templates.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(got) == len(rows)
    assert [i for i in range(60) if "visited" in got[i].text] == [0]  # the first line of a template stays
    assert not got[100].text and got[101].text == ""


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in QUERIES) == list(range(1, 14))


def test_anchors_of_windows():
    """Equal windows have anchors with equal cores whatever stands around them, alone or among other texts."""
    import numpy as np
    import pyarrow as pa

    from threadloom.llm import word_repeats as wr
    from threadloom.llm.common import word_digests

    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in rng.integers(0, 30, 60)] + ["run"] * 17 + [f"q{i}" for i in range(40)]
    texts = [b"", b"short text", b"same " * 40]
    for _ in range(25):
        around = [[f"w{i}" for i in rng.integers(0, 400, rng.integers(0, 50))] for _ in range(2)]
        texts.append(" ".join(around[0] + passage + around[1]).encode())
    array = pa.array([None, *texts, None], pa.binary())
    doc, core, whole, lo, hi = wr.anchors(*word_digests(array))
    cores, places = defaultdict(set), Counter()
    for d, c, a, b in zip(doc.tolist(), core.tolist(), lo.tolist(), hi.tolist()):
        words = array[d].as_py().split()
        for start in range(a, b + 1):
            cores[tuple(words[start : start + wr.WIDTH])].add(c)
            places[d, start] += 1
    assert all(len(found) == 1 for found in cores.values())
    assert set(places.values()) == {1}
    assert places.total() == sum(max(len(t.split()) - wr.WIDTH + 1, 0) for t in texts)
    for i, text in enumerate(texts):
        alone = wr.anchors(*word_digests(pa.array([text], pa.binary())))
        for got, want in zip(alone[1:], (core, whole, lo, hi)):
            assert got.tolist() == want[doc == i + 1].tolist()
    rows = pa.RecordBatch.from_arrays([array], ["text"])
    for size in (1, 500, 1 << 20):
        parts = list(wr.portions(rows, size))
        assert [x for p in parts for x in p.column(0).to_pylist()] == array.to_pylist() and all(p.num_rows for p in parts)
    assert not list(wr.portions(rows.slice(0, 0), 10))


LINES = [f"{STORY}Part {i} of the report follows, with more of the same kind." for i in range(4)]
PARAS = "".join(f"<p>{x}</p>" for x in LINES)
NAV = "<nav><a href='/'>Home</a></nav>"


@pytest.mark.parametrize(
    "body, want",
    [
        (f"{NAV}<div class='elementor-widget'><article>{PARAS}</article></div>", LINES),
        (f"{NAV}<div class='post widget'>{PARAS}</div>", LINES),
        (f"<div class='has-sidebar'><h1>Head</h1>{PARAS}<div class='sidebar'><p>{STORY}</p></div></div>", ["Head", *LINES]),
        (f"<article><div class='entry-header'><h1>Head</h1><p>Stand first.</p></div>{PARAS}</article>", ["Head", "Stand first.", *LINES]),
        (f"<div class='site-header'><h1>Site</h1></div><article>{PARAS}</article>", LINES),
        (f"<article><div class='social-history'><p>{LINES[0]}</p></div><div class='social-share'><p>Share it.</p></div>{PARAS}</article>", [LINES[0], *LINES]),
        (f"<main><section>{PARAS}</section><section><p>Short but true.</p></section></main>", [*LINES, "Short but true."]),
        (f"<article><p>{LINES[0]}</p></article><div class='comments'>" + f"<article>{PARAS}</article>" * 9 + "</div>", LINES[:1]),
        (f"<article>{PARAS}<div class='related'><article>{PARAS}</article></div></article>", LINES),
    ],
)
def test_main_text_keeps_articles(body, want):
    from threadloom.llm.main_text import main_text

    assert main_text(f"<html><body>{body}<footer>Copyright</footer></body></html>").split("\n") == [" ".join(x.split()) for x in want]


@pytest.mark.parametrize(
    "html",
    [
        "<b>" * 60_000 + "</i>" * 60_000 + "x",
        "<div>" * 50_000 + "<header>" * 50_000 + "x",
        "<b>" * 50_000 + "<p>x</p>" * 50_000,
        "<div class='widget'>" * 50_000 + "x",
        "<a href='" * 50_000,
        "<li>x" * 100_000 + "</ul>" * 50_000,
    ],
)
def test_main_text_is_linear(html):
    import time

    from threadloom.llm.main_text import main_text

    began = time.perf_counter()
    main_text(html)
    assert time.perf_counter() - began < 20
