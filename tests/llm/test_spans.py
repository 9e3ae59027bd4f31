"""Personal data and secrets against regular expressions of Python."""

import hashlib
import re

from quillgauge.llm import pii, secrets

ASSIGN = re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
SECRET_TEXTS = [
    "password=hunter2x token: 'abc' API_KEY = \"zzzzzzz\" Secret==abcdef", "AKIA" + "A1" * 10 + " AKIAshort", "deadbeef" * 4 + " cafe" + "0" * 30 + "g",
    "token = secret = abcdefgh passwd:password=1234567", "user: alice\nhost: db.example.org\nAbCdEfGhIjKlMnOpQrSt12345 end", "AbCdEfGhIjKlMnOpQrSt12345 alone",
    "apikey:x" * 40, "ſecret=abcdefgh token=ab́cdefg",
]
PII_TEXTS = [
    "a@b.c_d@e.f x.y@z-.org.. @no.at q@w", "1.2.3.4 256.1.1.1 01.002.0003.4 1.2.3.4.5.6.7.8 9999999999999999999999.1.1.1", "4111 1111-1111 1111, 4111111111111112 0000000000000",
    "+1 (415) 555-0100. +123 +1-2-3-4-5-6-7-8-9 +49 30 1234567890123456", "call +44 20 7946 0958+33 1 23 45 67 89", "1.1.1.12.2.2.2", "x" * 50_000 + "1" * 50_000,
    "jane dot doe at mail dot example dot org", "𝒳 é +4930123456789 ok@ä.de u@v.de",
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        value = int(c) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


def secret_spans(text):
    made = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    made += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    made += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(made)]


def pii_spans(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return [(k, *m.span()) for k, m in found]


def check(spark, edge, documents, digest, texts, spans_of, kinds):
    rows = [(1000 + k, t) for k, t in enumerate(texts)] + [(r["doc_id"], r["text"]) for r in edge.collect()] + [(r["doc_id"] + 5000, r["text"]) for r in documents.collect()]
    got = digest(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert len(got) == len(rows)
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    want = []
    for i, text in rows:
        spans = spans_of(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, hashlib.sha256(joined.encode()).hexdigest(), *[sum(s[0] == k for s in spans) for k in kinds]))
    assert sorted(((r["doc_id"], r["base_sha256"], *[r[f"n_{k}"] for k in kinds]) for r in got), key=key) == sorted(want, key=key)
    base = {i: {f"{k}:{a}:{b}" for k, a, b in spans_of(t or "")} for i, t in rows}
    assert all(base[r["doc_id"]] <= set(r["spans"].split(",")) | {""} for r in got if r["doc_id"] != 7)
    return {r["doc_id"]: r["spans"] for r in got}


def test_secrets(spark, edge, documents, nothing):
    # Python's own rule for small letters reaches beyond ASCII unless told otherwise.
    spans = check(spark, edge, documents, secrets.digest, SECRET_TEXTS, secret_spans, secrets.BASE)
    linked = {s.split(":")[0] for s in spans[1004].split(",")}
    assert linked == {"name", "endpoint", "random"} and spans[1005] == ""
    assert secrets.digest(nothing).collect() == []


def test_personal_data(spark, edge, documents, nothing):
    check(spark, edge, documents, pii.digest, PII_TEXTS, pii_spans, pii.BASE)
    assert pii.digest(nothing).collect() == []


def test_trees_add_what_looks_like_base_spans(spark):
    rows = [(k, f"word ten.{k}@mail{k % 7}.example.org word" if k % 2 else f"code {k * 7919 % 10**7 + 10**7} word") for k in range(800)]
    rows += [(10_000 + k, f"word ten.{k}(at)mail{k % 7}.example.org word") for k in range(20)]
    got = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert all(got[k]["n_email"] == k % 2 for k in range(800))
    assert not any("number" in got[k]["spans"] for k in range(0, 800, 2))


def test_redaction(spark):
    rows = [(1, "x token=" + "ab12" * 8 + " y", 99), (2, None, 0), (3, "plain", 5), (1, "x token=" + "ab12" * 8 + " y", 99), (None, "𝒳 password: abcdefg.", 3)]
    got = secrets.redact(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, n_chars BIGINT")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        (1, "x [secret] y", 12), (1, "x [secret] y", 12), (2, None, 0), (3, "plain", 5), (None, "𝒳 [secret]", 10)]))
