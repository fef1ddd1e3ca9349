"""PII by anchor expansion.

An Aho-Corasick automaton passes once over the whole text and stops only at anchors: at-signs, scheme separators,
digits, plus signs and identifier cues. At each anchor a deterministic parser expands to the boundaries of an e-mail
address, number, network address, link or account and validates them. What the base patterns match is found exactly:
every base match starts at an anchor, or at the maximal run of local-part characters before an at-sign.

Defined results: null and empty texts have no spans; texts are scanned whole, whatever their length; repeated rows each
give their own row; columns other than the two named ones are not looked at (scan) or are passed on (redact).
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: In the order in which spans that start together are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret")
BASE = KINDS[:4]

#: Words after which an identifier may stand, and the kind of that identifier.
CUES = {"account": "account", "acct": "account", "user id": "account", "userid": "account", "username": "account", "passport": "account", "iban": "iban", "token": "secret", "api key": "secret", "api_key": "secret", "password": "secret", "secret": "secret"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9 .()+-]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LINK = re.compile(r"://[A-Za-z0-9\[][^\s<>\"'|\\^`{}]*")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_IBAN = re.compile(r"[\s:#=]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[ _-]?(?:number|no\.?|id|nr\.?))?\s{0,2}[:=#]\s{0,2}[\"']?([A-Za-z0-9](?:[A-Za-z0-9_-]{4,62})[A-Za-z0-9])(?![A-Za-z0-9_-])", re.I)
_SECRET = re.compile(r"\s{0,2}[:=]\s{0,2}[\"']([^\s\"']{8,512})[\"']")
_automata: dict = {}


def _automaton():
    if "all" not in _automata:
        found = ahocorasick.Automaton()
        for c in "0123456789+":
            found.add_word(c, ("number", 1))
        found.add_word("@", ("email", 1))
        found.add_word("://", ("url", 3))
        for cue, kind in CUES.items():
            for form in {cue, cue.title(), cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
        found.make_automaton()
        _automata["all"] = found
    return _automata["all"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _iban(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    mail_end = run_end = link_end = 0
    for last, (kind, size) in _automaton().iter(text):
        at = last + 1 - size
        if kind == "number":
            if at < run_end:
                continue
            run_end = _RUN.match(text, at).end()
            for m in _IP.finditer(text, at, run_end):
                if all(map(_small, m.group().split("."))):
                    out.append((m.start(), m.end(), "ip"))
            for m in _CARD.finditer(text, at, run_end):
                if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                    out.append((m.start(), m.end(), "card"))
            for m in _PHONE.finditer(text, at, run_end):
                if 10 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), m.end(), "phone"))
        elif kind == "email":
            if at < mail_end or not (m := _DOMAIN.match(text, at)):
                continue
            start = at
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                mail_end = m.end()
                out.append((start, mail_end, "email"))
        elif kind == "url":
            if at < link_end or not (m := _LINK.match(text, at)):
                continue
            start = at
            while start > link_end and at - start < 32 and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not (text[start].isascii() and text[start].isalpha()):
                start += 1
            if start < at:
                link_end = start + len(text[start : m.end()].rstrip(".,;:!?)]"))
                out.append((start, link_end, "url"))
        elif at and text[at - 1].isalnum():
            continue
        elif kind == "iban":
            if (m := _IBAN.match(text, last + 1)) and _iban(m.group(1)):
                out.append((*m.span(1), "iban"))
        elif kind == "account":
            if (m := _ACCOUNT.match(text, last + 1)) and any("0" <= c <= "9" for c in m.group(1)):
                out.append((*m.span(1), "account"))
        elif m := _SECRET.match(text, last + 1):
            out.append((*m.span(1), "secret"))
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str | None) -> str | None:
    """The text with each maximal stretch of overlapping spans replaced by the kind of its first span, as in [EMAIL]."""
    spans = find(text)
    if not spans:
        return text
    parts, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        parts += [text[at:start], f"[{kind.upper()}]"]
        at, k = end, k + 1
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, counts by kind, digest of the base spans, and all spans."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    names = schema.names

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for text in b.column(1).to_pylist():
                spans = find(text)
                base = _joined(s for s in spans if s[2] in BASE)
                got = [s[2] for s in spans]
                for c, v in zip(cols, [*map(got.count, KINDS), hashlib.sha256(base.encode()).hexdigest(), _joined(spans)], strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:-2]), *(pa.array(c, pa.string()) for c in cols[-2:])], names=names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with the spans in its texts replaced; a column of code points is brought up to date."""
    schema, names = docs.schema, docs.columns
    text_at = names.index(text_col)
    chars_at = names.index(chars_col) if chars_col in names else None

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            old = cols[text_at].to_pylist()
            new = [redacted(t) for t in old]
            if any(a is not c for a, c in zip(old, new, strict=True)):
                cols[text_at] = pa.array(new, cols[text_at].type)
                if chars_at is not None:
                    cols[chars_at] = pa.array([v if a is c else len(c) for v, a, c in zip(cols[chars_at].to_pylist(), old, new, strict=True)], cols[chars_at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, schema)
