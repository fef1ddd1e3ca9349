import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sieveworks.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    out = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]
    return sorted(out, key=lambda s: (s[0], pii.BASE.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text("0123456789.@+-() aé_%\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.find(text) if s[2] in pii.BASE] == brute(text)


def test_base_spans_in_dense_texts():
    rng = random.Random(0)
    parts = ["a.b@c.d", "x@y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (017) 555-7713", "+", "@", " ", "-", "word", "@@a.b", "9807915762804490", "..", " ", "é", "1-2-3-4", "+49.30.1234567", "a@b-.c-@d.e"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(12)))
        assert [s for s in pii.find(text) if s[2] in pii.BASE] == brute(text), text


def test_added_kinds():
    text = 'see https://ex.org/a?b=1, IBAN DE89 3704 0044 0532 0130 00; Account no: AB-12345; token = "04dbebab91ab85687d33"'
    assert [text[a:b] for a, b, k in pii.find(text) if k not in pii.BASE] == ["https://ex.org/a?b=1", "DE89 3704 0044 0532 0130 00", "AB-12345", "04dbebab91ab85687d33"]


def test_table(spark, docs):
    texts = ["mail a@b.co now", None, "", "x" * 300_000 + " 1.2.3.4", "mail a@b.co now"]
    got = {r["doc_id"]: r for r in pii.scan(docs(texts)).collect()}
    assert [got[i]["spans"] for i in range(5)] == ["email:5:11", "", "", "ip:300001:300008", "email:5:11"]
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[0]["n_email"] == 1
    assert pii.scan(docs([])).count() == 0
    clean = {r["doc_id"]: r for r in pii.redact(docs(texts)).collect()}
    assert clean[0]["text"] == "mail [EMAIL] now" and clean[0]["n_chars"] == 16 and clean[1]["text"] is None and clean[3]["text"].endswith(" [IP]")
    assert clean[0]["score"] == "x" and list(clean[0].asDict()) == docs([]).columns


def test_overlapping_spans_are_one():
    assert pii.redacted("https://u@ex.org/1.2.3.4 end") == "[URL] end"
