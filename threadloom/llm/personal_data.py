"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Two sets of rules run over each whole text. The base rules are patterns with a hard test (part of an address at most 255,
Luhn, number of digits); what they confirm is always reported. The added rules look for kinds that the base does not know
(``iban``, ``ssn``, ``ipv6``, ``other_card``, ``national_phone``). They start from a prior score, gain by a checksum
(mod 97, Luhn, the address parser) and by a word close by that names the kind, lose by a word before it that names
something else (order, invoice, version), and are reported from ``THRESHOLD`` on, where no reported span covers them already.

Every pattern takes time linear in the text: each run of characters is read by one match attempt only.

A null or empty text has no spans and still a row; a null id is kept. Repeated rows are one row each with equal results.
Ties between overlapping added spans go to the higher score, then to the smaller start, then to the longer span. Only the
id and text columns are read, so other columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import column, map_batches, record

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["iban", "ssn", "ipv6", "other_card", "national_phone"]
THRESHOLD = 0.6
CONTEXT_CHARS = 48
BOOST, PENALTY = 0.35, 0.4

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Check digit of card numbers."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    """Check digits of account numbers: four characters go to the end, letters count from 10 on, the rest is 1."""
    rest = 0
    for c in code[4:] + code[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[Span]:
    """Found from the ``@``: the domain to its right, then the longest local part to its left."""
    free = 0
    for m in _AT.finditer(text):
        at = m.start()
        left = text[max(free, text.rfind("@", free, at) + 1) : at]
        start = at - len(left) + len(left.rstrip(_LOCAL))
        if start < at:
            yield start, m.end()
            free = m.end()


def addresses(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            yield m.span()


BASE: dict[str, tuple[str, Callable[[str], Iterator[Span]]]] = {
    "email": ("@", emails),
    "ip": (".", addresses),
    "card": ("", cards),
    "phone": ("+", phones),
}

# Length of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
# First digits and lengths of the card schemes that have fewer than 16 digits.
SHORT_CARDS = re.compile(r"3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}")


def _iban(found: str) -> tuple[int, bool] | None:
    """How much of the match is the account number, and whether its check digits are right."""
    code, ends = "", []
    for i, c in enumerate(found):
        if c not in " -":
            code += c
            ends.append(i + 1)
    length = IBAN_LENGTHS.get(code[:2])
    if length is None or len(code) < length:
        return None
    end = ends[length - 1]
    whole = end == len(found) or found[end] in " -"
    return (end, mod97(code[:length])) if whole else None


def _ssn(found: str) -> tuple[int, bool] | None:
    area, group, serial = found.split("-")
    return None if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" else (len(found), False)


def _ipv6(found: str) -> tuple[int, bool] | None:
    try:
        ipaddress.IPv6Address(found)
    except ValueError:
        return None
    return len(found), found.count(":") == 7 or len(found) >= 12


def _short_card(found: str) -> tuple[int, bool] | None:
    digits = _digits(found)
    return (len(found), True) if SHORT_CARDS.fullmatch(digits) and luhn(digits) else None


def _national(found: str) -> tuple[int, bool] | None:
    return len(found), False


@dataclass(frozen=True)
class Added:
    """A kind that needs evidence: prior score, what a checksum adds, and the words that speak for it."""

    kind: str
    hint: str  # a text without it cannot match
    pattern: re.Pattern
    check: Callable[[str], tuple[int, bool] | None]  # length of the span and whether a checksum holds; None: not one
    prior: float
    checked: float
    words: re.Pattern


def _words(*names: str) -> re.Pattern:
    return re.compile(rf"(?<!\w)(?:{'|'.join(names)})(?!\w)", re.IGNORECASE)


ADDED = [
    Added("iban", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), _iban, 0.2, 0.6,
          _words("iban", "account", "bank", "konto", "compte", "cuenta", "banque", "banco")),
    Added("ssn", "-", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _ssn, 0.4, 0.0,
          _words("ssn", "social security", "social sec", "sozialversicherung")),
    Added("ipv6", ":", re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:]|\.[0-9])"), _ipv6, 0.3, 0.4,
          _words("ip", "ipv6", "address", "host", "adresse")),
    Added("other_card", "3", re.compile(r"(?<![0-9-])3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{4,5}(?![0-9-])"), _short_card, 0.1, 0.4,
          _words("card", "credit", "amex", "visa", "payment", "karte", "kreditkarte", "carte", "tarjeta")),
    Added("national_phone", "", re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"), _national, 0.3, 0.0,
          _words("phone", "call", "tel", "telephone", "mobile", "cell", "fax", "telefon", "handy", "téléphone", "appelez", "teléfono", "llame")),
]
_AGAINST = _words("order", "invoice", "version", "isbn", "issn", "part no", "serial", "tracking", "ticket", "sku", "build")


def added_spans(text: str, taken: list[Span]) -> list[tuple[str, int, int, float]]:
    """``kind, start, end, score`` of added spans that overlap neither ``taken`` nor each other."""
    found = []
    for rule in ADDED:
        if rule.hint not in text:
            continue
        for m in rule.pattern.finditer(text):
            checked = rule.check(m.group())
            if checked is None:
                continue
            start, end = m.start(), m.start() + checked[0]
            before, behind = text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS]
            score = rule.prior + rule.checked * checked[1] + BOOST * bool(rule.words.search(before) or rule.words.search(behind))
            score = min(1.0, max(0.0, score - PENALTY * bool(_AGAINST.search(before))))
            if score >= THRESHOLD:
                found.append((rule.kind, start, end, score))
    blocked: list[Span] = []  # disjoint and in order, so a neighbour on either side is all that can overlap
    for start, end in sorted(taken):
        if blocked and start < blocked[-1][1]:
            blocked[-1] = (blocked[-1][0], max(end, blocked[-1][1]))
        else:
            blocked.append((start, end))
    best = []
    for span in sorted(found, key=lambda s: (-s[3], s[1], s[1] - s[2])):
        at = bisect_left(blocked, (span[1], span[2]))
        if (at == 0 or blocked[at - 1][1] <= span[1]) and (at == len(blocked) or span[2] <= blocked[at][0]):
            blocked.insert(at, (span[1], span[2]))
            best.append(span)
    return sorted(best, key=lambda s: (ADDED_KINDS.index(s[0]), s[1]))


def spans_of(text: str) -> list[tuple[str, int, int, float, bool]]:
    """``kind, start, end, score, base`` in code points, by kind in the listed order, then by start."""
    base = [(k, s, e, 1.0, True) for k, (hint, find) in BASE.items() if hint in text for s, e in find(text)]
    return base + [(*x, False) for x in added_spans(text, [(s, e) for _, s, e, _, _ in base])]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans`` for every row; spans are ``struct<kind, start, end, score, base>``, end exclusive, in code points."""

    def work(batch: pa.RecordBatch):
        names = [f.name for f in _SPAN]
        out = [[dict(zip(names, s, strict=True)) for s in spans_of(t)] if t else [] for t in column(batch, "text")]
        yield record(["id", "spans"], [batch.column(0), pa.array(out, pa.list_(_SPAN))])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, work, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text`` with all personal data replaced; a null text stays null."""

    def work(batch: pa.RecordBatch):
        out = [redact(t, [s[:3] for s in spans_of(t)]) if t else t for t in column(batch, "text")]
        yield record(["id", "text"], [batch.column(0), pa.array(out, pa.string())])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, text string")
