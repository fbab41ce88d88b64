"""Finding and hiding secrets in one text, in time linear in the text.

Small helpers for the Arrow functions of ``masking``. Every rule reads each character a bounded number of times: a rule is
anchored at the character it cannot do without, and what failed once at an anchor is not tried again from another start.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import log2

import ahocorasick

# The patterns, with \b for an ASCII word boundary.
PATTERNS = {
    "DB_URI": r"\b[a-zA-Z]+://[^:]+:([^@\s]+)@(?:[a-zA-Z0-9.-]+)(?::[0-9]+)?/[^\s]*\b",
    "GENERIC_SECRET": (
        r"(?i)\b(?:api[_-]?key|secret|password|passwd|token|credential|auth|private[_-]?key)\b"
        r"\s*[:=]\s*['\"]([a-zA-Z0-9-_=]{16,128})['\"]"
    ),
    "JWT_TOKEN": r"\beyJ[A-Za-z0-9-_=]+\.eyJ[A-Za-z0-9-_=]+\.?[A-Za-z0-9-_.+/=]*\b",
    "SLACK_WEBHOOK": r"https://hooks\.slack\.com/services/[T\[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+",
    "AWS_KEY": r"\bAKIA[0-9A-Z]{16}\b",
    "EMAIL": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "IPV4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
}
SECRET_ENTROPY = 3.8
SWEEP_ENTROPY = 3.2
SWEEP_MIN_BYTES = 32
SWEEP_MAX_BYTES = 128
SWEEP_TRIM = "'\"(),;{}[]"

AUTOMATON_FROM = 32  # values from which one automaton is cheaper than as many replacements; both give the same text

_ASCII_SPACE = " \t\n\x0b\f\r"
_SCHEME = re.compile(r"\b[a-zA-Z]++://", re.ASCII)
_STOP = re.compile(r"[@\s]", re.ASCII)
_HOST = re.compile(r"@[a-zA-Z0-9.-]++(?::[0-9]++)?/[^\s]*\b", re.ASCII)
_GENERIC = re.compile(PATTERNS["GENERIC_SECRET"], re.ASCII)
# The second part of the pattern is any mix of its two classes, so one class after one character of the other says the same.
_JWT = re.compile(r"\b(eyJ[A-Za-z0-9_=-]++\.eyJ[A-Za-z0-9_=-][A-Za-z0-9_.+/=-]*\b)|\beyJ[A-Za-z0-9_=-]++", re.ASCII)
_SLACK = re.compile(PATTERNS["SLACK_WEBHOOK"], re.ASCII)
_AWS = re.compile(PATTERNS["AWS_KEY"], re.ASCII)
_IPV4 = re.compile(PATTERNS["IPV4"], re.ASCII)
_DOMAIN = re.compile(r"@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", re.ASCII)
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_EDGE = re.compile(r"\b", re.ASCII)
# Words by the White_Space property of Unicode. So many bytes take at least a quarter as many characters.
_LONG = re.compile(rf"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{SWEEP_MIN_BYTES // 4},}}")


def entropy(text: str) -> float:
    """Shannon entropy in bits: counts per character over the byte length."""
    size, total = len(text.encode()), 0.0
    for ch in dict.fromkeys(text):
        p = text.count(ch) / size
        total -= p * log2(p)
    return total


def uri_passwords(text: str, inside: bool = False) -> tuple[list[str], bool]:
    """Passwords in connection strings, and whether the text ends behind a scheme that no colon has followed yet.

    ``inside``: the text goes on behind such a scheme. Between the scheme and the colon anything may stand, so this flag is
    all that a following text has to know of the ones before it.
    """
    values: list[str] = []
    free, refused, stop = 0, -1, -1

    def password(colon: int) -> int | None:
        """End of the match whose password begins after the colon."""
        nonlocal refused, stop
        if stop <= colon:
            m = _STOP.search(text, colon + 1)
            stop = m.start() if m else len(text)
        if stop == len(text) or text[stop] != "@" or stop == colon + 1 or stop == refused:
            return None
        m = _HOST.match(text, stop)
        if m is None:
            refused = stop
            return None
        values.append(text[colon + 1 : stop])
        return m.end()

    if inside:
        colon = text.find(":")
        if colon < 0:
            return values, True
        free = password(colon) or 0
    while (m := _SCHEME.search(text, free)) is not None:
        free = m.end()
        colon = text.find(":", free)
        if colon < 0:
            return values, free < len(text)
        if colon > free:
            free = password(colon) or free
    return values, False


def generic_secrets(text: str) -> list[str]:
    return [v for v in _GENERIC.findall(text) if entropy(v) > SECRET_ENTROPY]


def emails(text: str) -> list[str]:
    """Found from the ``@``: from the first word boundary of the run to its left to the end of the domain."""
    values, free, at = [], 0, text.find("@")
    while at >= 0:
        low = max(free, text.rfind("@", free, at) + 1)
        run = low + len(text[low:at].rstrip(_LOCAL))
        end = at + 1
        if run < at and (m := _DOMAIN.match(text, at)):
            edge = _EDGE.search(text, run, at)
            if edge and edge.start() < at:
                end = free = m.end()
                values.append(text[edge.start() : end])
        at = text.find("@", end)
    return values


def sweep_values(text: str) -> list[str]:
    """Long random-looking words, without surrounding quotes and brackets."""
    values = []
    for word in _LONG.findall(text):
        if len(word.encode()) >= SWEEP_MIN_BYTES:
            bare = word.strip(SWEEP_TRIM)
            if SWEEP_MIN_BYTES <= len(bare.encode()) <= SWEEP_MAX_BYTES and "MASKED" not in bare and entropy(bare) > SWEEP_ENTROPY:
                values.append(bare)
    return values


@dataclass(frozen=True)
class Rule:
    """One masking step: which values to hide, under what name, and how they are counted."""

    name: str
    placeholder: str
    hint: str  # a text without it holds no value
    find: Callable[[str], Iterable[str]]
    per_label: bool  # count the label once, not every value
    on_original: bool = False  # look at the text as it was before all rules


def _label(name: str, hint: str, find: Callable[[str], Iterable[str]]) -> Rule:
    return Rule(name, f"[{name}]", hint, find, True)


RULES = [
    Rule("DB_URI", "[MASKED_PASSWORD]", ":", lambda t: uri_passwords(t)[0], False),
    Rule("GENERIC_SECRET", "[MASKED_SECRET]", "", generic_secrets, False),
    _label("JWT_TOKEN", "eyJ", lambda t: [v for v in _JWT.findall(t) if v]),
    _label("SLACK_WEBHOOK", "hooks.slack.com", _SLACK.findall),
    _label("AWS_KEY", "AKIA", _AWS.findall),
    _label("EMAIL", "@", emails),
    _label("IPV4", ".", _IPV4.findall),
    Rule("HIGH_ENTROPY", "[MASKED_HIGH_ENTROPY_KEY]", "", sweep_values, False, True),
]
RULE_NAMES = [r.name for r in RULES]


def values_of(rule: Rule, now: str, original: str, inside: bool = False) -> list[str]:
    """Values of a rule in order, with repeats; ``inside`` as for ``uri_passwords``."""
    if rule.name == "DB_URI":
        return uri_passwords(now, inside)[0] if ":" in now else []
    text = original if rule.on_original else now
    return list(rule.find(text)) if rule.hint in text else []


def _may_join(value: str, placeholder: str) -> bool:
    """Whether the value can stand in a text across or inside the placeholder."""
    if value in placeholder or placeholder in value:
        return True
    return any(value.endswith(placeholder[:i]) or value.startswith(placeholder[-i:]) for i in range(1, len(placeholder)))


def replace_values(text: str, values: Iterable[str], placeholder: str) -> str:
    """Hide every value wherever it stands, one value after another.

    Many values are found by one automaton in one pass; an earlier value takes its places before a later one, each from the
    left. That is the same unless a value can be made up of a placeholder and the text around it.
    """
    values = [v for v in dict.fromkeys(values) if v]
    if len(values) < AUTOMATON_FROM or any(_may_join(v, placeholder) for v in values):
        for value in values:
            text = text.replace(value, placeholder)
        return text
    automaton = ahocorasick.Automaton()
    for rank, value in enumerate(values):
        automaton.add_word(value, (rank, len(value)))
    automaton.make_automaton()
    taken, spans = bytearray(len(text)), []
    for rank, start, end in sorted((rank, last + 1 - size, last + 1) for last, (rank, size) in automaton.iter(text)):
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\x01" * (end - start)
            spans.append((start, end))
    out, at = [], 0
    for start, end in sorted(spans):
        out += [text[at:start], placeholder]
        at = end
    return "".join(out) + text[at:]


class Finder:
    """The numbers of those of many distinct, non-empty values that replacing in a text can meet, by one automaton.

    These are the values inside the text and, where there are any, those that may stand across or inside a placeholder.
    Only words are read that are as long as the shortest value and hold the characters that all values share.
    """

    def __init__(self, values: list[str], placeholder: str) -> None:
        self.values, self.placeholder = values, placeholder
        self.automaton = None

    def __getstate__(self) -> dict:
        return {"values": self.values, "placeholder": self.placeholder, "automaton": None}  # built once by each worker

    def _build(self) -> None:
        self.joining = frozenset(no for no, v in enumerate(self.values) if _may_join(v, self.placeholder))
        self.shared = frozenset.intersection(*map(frozenset, self.values))
        self.size = min(map(len, self.values))
        self.in_words = all(v.split() == [v] for v in self.values)
        self.automaton = ahocorasick.Automaton()
        for no, value in enumerate(self.values):
            self.automaton.add_word(value, no)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[int]:
        if not self.values:
            return []
        if self.automaton is None:
            self._build()
        if not all(c in text for c in self.shared):
            return []
        words = [w for w in set(text.split()) if len(w) >= self.size and self.shared.issubset(w)] if self.in_words else [text]
        found = {no for word in words for _, no in self.automaton.iter(word)}
        return sorted(found | self.joining) if found else []


def mask_text(text: str, rules: list[Rule]) -> tuple[str, list[int]]:
    """The masked text and the number of items per rule; rules run one after another."""
    now, counts = text, []
    for rule in rules:
        values = values_of(rule, now, text)
        if rule.per_label:
            counts.append(int(bool(values) and rule.placeholder not in now))
        else:
            counts.append(len(values))
        if values:
            now = replace_values(now, values, rule.placeholder)
    return now, counts


# ---------------------------------------------------------------- texts in pieces

_SPACES = re.compile(r"[ \t\n\x0b\f\r]++", re.ASCII)
_UNSAFE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz:=" + _ASCII_SPACE)


def cuts(text: str) -> Iterator[int]:
    """Places after white space that no value and no match but a connection string can cross.

    No value holds white space. Around a generic secret it may stand after its keyword, a colon or an equals sign only.
    """
    for m in _SPACES.finditer(text):
        if m.start() > 0 and text[m.start() - 1] not in _UNSAFE:
            yield m.end()


def first_cut(text: str) -> tuple[int, bool]:
    """The first cut inside the text, -1 if there is none, and whether the text may be cut at its end."""
    first = next(cuts(text), -1)
    bare = text.rstrip(_ASCII_SPACE)
    at_end = 0 < len(bare) < len(text) and bare[-1] not in _UNSAFE
    return first, at_end
