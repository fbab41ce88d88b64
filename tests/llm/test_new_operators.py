"""Personal data, collocations and periodic runs against plain versions, and their cases one by one."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threadloom.llm import collocations, personal_data, word_runs
from threadloom.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, id string, spans int, n int, runs int"
CARD = "4111 1111 1111 1111"
IBAN = "DE89 3704 0044 0532 0130 00"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, at, rows):
    """A documents table with columns whose names the operators use themselves."""
    full = [(i, t, lang, "x", 1, 2, 3) for i, t, lang in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{at}/documents.parquet")
    return str(at)


def luhn_by_hand(digits: str) -> bool:
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def base_by_hand(text: str) -> dict[str, list[tuple[int, int]]]:
    """The contract's patterns as they stand, run by the regex engine."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn_by_hand(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15],
    }


PII = [
    None,
    "",
    f"mail a.b+c@x-1.example.com, {CARD} or +1 (521) 555-6210; host 10.0.0.255, not 10.0.0.256",
    "a@b.c@d.e @x.y z@@p.q -@-.-. a@b a@.c .@a..b",
    "1.2.3.4.5.6.7.8 001.002.003.0004 1.2.3 1..2.3.4",
    "4111111111111111 4111-1111-1111-1111 4111  1111 1111 1111 4111111111111112 4242424242424242424242",
    "+12 3 +1 22 +1234567 +12345678 +123456789012345 +1234567890123456 ++12345678 +1(2)3-4.5 67 89.",
    "é日本 " * 5 + "a@b.cd " + "😀 +49 30 1234567",
    "1 " * 3000 + "+" * 3000 + "a" * 50000 + "." * 3000 + "@" * 3000 + "9" * 9000,
    f"IBAN {IBAN}, wrong DE89 3704 0044 0532 0130 01. SSN 536-90-4399; order 536-90-4399 of part 1",
    "Call (212) 555-0199 today, fax 212-555-0199. Amex card 3782 822463 10005. Server ip 2001:db8:0:0:1:0:0:1.",
    f"{CARD} 12 {CARD}",
]


@pytest.fixture(scope="module")
def pii(spark, tmp_path_factory):
    rows = [(i, t, "en") for i, t in enumerate(PII)] + [(2, PII[2], "en"), (None, PII[3], None)]
    return table(spark, tmp_path_factory.mktemp("pii"), rows)


@pytest.mark.parametrize("which", ["sf", "pii"])
def test_base_spans_by_plain_patterns(spark, request, which):
    at = request.getfixturevalue(which)
    want, texts = Counter(), {}
    for doc, text in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect():
        found = base_by_hand(text or "")
        listed = ",".join(f"{k}:{s}:{e}" for k in found for s, e in found[k])
        want[(doc, *(len(found[k]) for k in found), sha(listed))] += 1
        texts[doc, sha(listed)] = listed
    got = QUERIES["op11_pii"](spark, at).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        assert not set(filter(None, texts[r.doc_id, r.base_sha256].split(","))) - set(r.spans.split(","))


def test_added_spans_need_evidence():
    def kinds(text):
        return [(k, text[s:e]) for k, s, e, _, base in personal_data.spans_of(text) if not base]

    assert kinds(PII[9]) == [("iban", IBAN), ("ssn", "536-90-4399")]
    assert [k for k, _ in kinds(PII[10])] == ["ipv6", "other_card", "national_phone", "national_phone"]
    assert kinds("ref 536-90-4399, code AB12 3456, 12:30:45 and 3782 822463 10005") == []
    assert kinds("invoice number 212-555-0199, call us") == []
    assert kinds("IBAN XX89 3704 0044 0532 0130 00") == []  # no such country
    assert kinds(f"phone {CARD}") == []  # a base span covers it


def test_redaction(spark):
    docs = spark.createDataFrame([(1, f"Write a@b.co or {IBAN}."), (2, None), (3, "")], "doc_id int, text string")
    got = {r.id: r.text for r in personal_data.redact_documents(docs).collect()}
    assert got == {1: "Write [EMAIL] or [IBAN].", 2: None, 3: ""}
    assert personal_data.redact("abcdef", [("x", 1, 3), ("y", 2, 5)]) == "a[X]f"


def test_patterns_are_linear():
    import time

    for text in ["a@" * 200_000, "a" * 400_000, "1." * 200_000, "1-" * 200_000, "+1 " * 150_000, "AB12 " * 80_000, "a:" * 200_000, "call 212-555-0199 " * 20_000]:
        began = time.perf_counter()
        personal_data.spans_of(text)
        assert time.perf_counter() - began < 20, text[:20]


def phrases_by_hand(rows, least, top):
    """Counts of all phrases, scores, covered ones and ranks, as the definitions say."""
    f, out = Counter(), []
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f[("und" if lang is None else lang, *w[i : i + size])] += 1
    found = {p: n for p, n in f.items() if len(p) > 2 and n >= least}
    for lang in {p[0] for p in found}:
        ranked = []
        for p, a in found.items():
            if p[0] != lang:
                continue
            words = p[1:]
            inside = [q[1:] for q, n in found.items() if q[0] == lang and len(q) > len(p) and 100 * n >= 80 * a]
            if any(words == q[i : i + len(words)] for q in inside for i in range(len(q) - len(words) + 1)):
                continue
            cuts = [(2_000_000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
        n = sum(v for p, v in f.items() if p[0] == lang and len(p) == 2)
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least, top", [(2, 2000), (5, 7)])
def test_collocations_by_hand(spark, least, top):
    rng = np.random.default_rng(3)
    vocabulary = ["The", "the", "é", "日本", "a\x0bb", "x-y", "\x1c", "big", "Cat", "sat"]
    rows = [(None, "en"), ("", "en"), (" \t\n.,", None), ("one", "zz"), ("und und und", "und"), ("und und", None)]
    for i in range(60):
        words = [vocabulary[j] for j in rng.integers(0, len(vocabulary), 40)] + ["new", "york", "city"] * (i % 3)
        marks = rng.choice([" ", "  ", "\t", ". ", ",", "\n", "! "], len(words), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        rows.append(("".join(w + m for w, m in zip(words, marks)), ["en", None, "fr", "und"][i % 4]))
    rows += [("a b c d a b c d " * 500, "long")] + [("exact copy of one line", "en")] * 6
    docs = spark.createDataFrame([(i, t, lang, "x", 1, 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA)
    got = collocations.collocations(docs, least, top).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == phrases_by_hand(rows, least, top)


def test_collocations_do_not_depend_on_the_tables(spark, monkeypatch):
    """A table of one block, full of marks, only cuts fewer windows."""
    docs = spark.createDataFrame([(i, f"red fox runs. {i} red fox {i % 3}", None, "x", 1, 2, 3) for i in range(50)], SCHEMA)
    want = sorted(map(tuple, collocations.collocations(docs, 3).collect()))
    monkeypatch.setattr(collocations, "frequent", lambda *_: collocations.Table(np.full(4096, 255, np.uint8), 1 << 15))
    assert sorted(map(tuple, collocations.collocations(docs, 3).collect())) == want != []


def test_prefixes_are_summed_where_the_texts_are(spark):
    """A chunk gives one row per distinct prefix and one per language, however many windows begin with it."""
    docs = spark.createDataFrame([("l", b"a b c d a b c d. " * 500), ("l", b""), ("l", None)], "lang string, text binary").coalesce(1)
    everything = collocations.Table(np.full(4096, 255, np.uint8), 1 << 15)
    rows = [tuple(r) for r in collocations.prefixes(docs, [everything] * 2).collect()]
    counts = {phrase: n for _, phrase, n in rows}
    assert len(rows) == len(counts) == 1 + 4 + 4 + 4 + 4
    assert (counts[None], counts["a"], counts["d a"], counts["b c d"], counts["a b c d"]) == (4000, 1000, 500, 1000, 1000)


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000
    counts = spark.createDataFrame([("l", ["a"], big, "a"), ("l", ["b"], big + 1, "b"), ("l", ["a", "b"], big - 1, "a b")], "lang string, words array<string>, f long, phrase string")
    candidates = counts.where("size(words) > 1").withColumnRenamed("f", "a").selectExpr("*", "size(words) as size")
    (r,) = collocations.score_cuts(candidates, counts).collect()
    assert r.score == 2_000_000 * (big - 1) // (2 * big + 1)


def runs_by_hand(words, least=word_runs.LEAST):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, 2 * q):
                out.setdefault((start, length), q)  # the smallest period comes first
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def changed_by_hand(words, doc):
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def row_by_hand(doc, text):
    words = changed_by_hand(re.findall(r"[^\x20\x09-\x0D]+", text or ""), doc)
    runs = runs_by_hand(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc, len(runs), s, n, q, 1000 * n // q if runs else None, sha(listed), sha(kept)


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.fixture(scope="module")
def periodic(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a " * 11, "a " * 12, "a " * 700, "a b " * 6, "a b c d e f " * 2, "a b c d e " * 2, "日 é\x85x \x1c " * 9]
    texts += ["x " + "a b c " * 7 + "a y " + "a b c " * 5, "a a b " * 20 + "c " + "a a b " * 20, "a b a a b a b a " * 4, ("p q r s t u v w x " * 3 + "z ") * 3]
    texts += [" ".join("ab"[i] for i in rng.integers(0, 2, 150)) for _ in range(30)]
    texts += [" ".join(f"w{i}" for i in rng.integers(0, 9, 60)) for _ in range(60)] + [" ".join(f"line {i} of the same phrase here now" for i in range(60))]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(11, texts[11], "en"), (None, "a b " * 9, None)]
    return table(spark, tmp_path_factory.mktemp("periodic"), rows)


@pytest.mark.parametrize("which", ["sf", "periodic"])
def test_runs_by_hand(spark, request, which):
    at = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
    docs = [r for r in docs if len((r.text or "").split()) < 900]  # the plain version takes time with the square
    got = Counter(tuple(r[c] for c in RUN_COLUMNS) for r in QUERIES["op13_periodic_runs"](spark, at).collect())
    assert not Counter(row_by_hand(*r) for r in docs) - got
    assert got.total() == spark.read.parquet(f"{at}/documents.parquet").count()


@pytest.mark.parametrize("least", [2, 3, 4, 5, 7, 8, 12])
def test_runs_of_random_sequences(least):
    rng = np.random.default_rng(least)
    for _ in range(150):
        words = [bytes([97 + c]) for c in rng.integers(0, rng.integers(1, 4), rng.integers(0, 45))]
        assert word_runs.find_runs(word_runs.number_words([words]), least) == runs_by_hand(words, least)


def test_runs_stay_within_a_document():
    words = [b"a", b"b"] * 4
    assert word_runs.find_runs(word_runs.number_words([words, words, words])) == []


def test_a_long_periodic_text_takes_seconds():
    import time

    began = time.perf_counter()
    text = word_runs.number_words([[b"a"] * 300_000, [b"a", b"b", b"c"] * 100_000, [x for i in range(20_000) for x in (b"%d" % i, b"p", b"q", b"r", b"s", b"t", b"u")]])
    found = word_runs.find_runs(text)
    assert [(n, p) for _, n, p in found] == [(300_000, 1), (300_000, 3)]
    assert time.perf_counter() - began < 60


def test_ids_by_ranks_are_the_tokenizers():
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from threadloom.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tokenizer = packing.Encoder(path), Tokenizer.from_file(path)
    assert encoder.fast
    assert not packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).fast
    draw = random.Random(5)
    texts = ["".join(draw.choice(" \t\n\r'abestrvlSTM09.,-–“é\x85\xa0\x1cſßİ日<|") for _ in range(draw.randrange(80))) for _ in range(3000)]
    texts += ["", "a<|endoftext|>b", "x" * 5000, *(f" {chr(c)}9{chr(c)}{chr(c)} a" for c in range(0x250))]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_leaves_and_boxes_give_the_same_pairs():
    import pandas as pd
    import pyarrow as pa

    from threadloom.llm import ngram_join as join

    rng = np.random.default_rng(3)
    rows = []
    for token in range(60):
        base = rng.integers(-(1 << 62), 1 << 62, 400 if token % 7 else 4000)
        for _ in range(rng.integers(2, 3 * join.LEAF)):
            found = np.unique(np.where(rng.random(len(base)) < rng.choice([0, 0.05, 0.3]), rng.integers(-(1 << 62), 1 << 62, len(base)), base))
            point = np.bincount(found & (join.GROUPS - 1), minlength=join.GROUPS)
            counts = point.astype("u1" if point.max() < 256 and token % 2 else "<u4").tobytes()
            node = join._digest(found)
            rows.append((token, 0, 0, False, node, len(found), len(found) - int(rng.integers(0, 30)), node if rng.random() < 0.8 else 7, counts))
    names = ["token", "i", "j", "right", "node", "n", "rest", "root", "counts"]
    table = pd.DataFrame(rows, columns=names)
    want = set()
    for _, group in table.groupby("token"):
        want |= set(join.survivors(group, group, True).itertuples(index=False, name=None))
    arrow = pa.Table.from_pandas(table, preserve_index=False)
    for size in (7, 100, 10_000):
        got = [b.to_pylist() for b in join._tree_pairs(iter(arrow.to_batches(max_chunksize=size)))]
        assert {(r["a"], r["b"]) for part in got for r in part} == want
    assert want and not list(join._tree_pairs(iter([])))


def test_near_copies_are_joined_in_as_many_pairs_as_there_are():
    """A group of near copies that are no class yet: its tree would give the pairs of all with all."""
    import pyarrow as pa

    from threadloom.llm import ngram_join as join

    m = 200
    points = np.full((m, join.GROUPS), 1, np.uint8)
    points[np.arange(m), np.arange(m)] = 0
    numbers = {"node": np.arange(m) + 7, "root": np.arange(m) + 7, "token": np.zeros(m), "i": np.zeros(m), "j": np.zeros(m)}
    columns = {k: pa.array(v.astype(np.int64)) for k, v in numbers.items()}
    columns |= {k: pa.array(np.full(m, join.GROUPS - 1)) for k in ("n", "rest")}
    columns |= {"right": pa.array([False] * m), "counts": pa.array([p.tobytes() for p in points])}
    (batch,) = pa.table(columns).to_batches()
    everything = {tuple(r.values()) for b in join._tree_pairs(iter([batch])) for r in b.to_pylist()}
    some = {tuple(r.values()) for b in join._nearest_pairs(iter([batch])) for r in b.to_pylist()}
    assert len(everything) == m * (m - 1) // 2 and len(some) == m - 1 and some <= everything
    reached = {7}
    for _ in range(m):
        reached |= {x for pair in some if reached & {*pair} for x in pair}
    assert len(reached) == m
