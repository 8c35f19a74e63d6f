import hashlib
import random
import re

from helpers import edge, empty

from rillstone.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": True,
        "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")),
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def brute(text):
    spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in BASE.items()]
    return [len(x) for x in spans], hashlib.sha256(",".join(sum(spans, [])).encode()).hexdigest(), sum(spans, [])


def run(monkeypatch, spark, df):
    monkeypatch.setattr(queries, "table", lambda *a: df)
    return queries.op1_pii(spark, "").collect()


def test_same_as_brute_force(monkeypatch, spark):
    rng = random.Random(5)
    parts = ["a@b.c", "x.y@z-1.co.uk", "_q@d.e", "1.2.3.4", "256.1.1.1", "00255.0.0.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (873) 555-4781"]
    parts += ["+49.30.1234567", "é😀", "  ", "\n", "-", ".", "@", "+", "GB82 WEST 1234 5698 7654 32", "call 212-555-0199", "7"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in run(monkeypatch, spark, df):
        n, digest, spans = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n and r.base_sha256 == digest, texts[r.doc_id]
        assert r.spans.split(",")[: len(spans)] == spans or not spans


def test_long_and_hard_texts(monkeypatch, spark):
    hard = ["a" * 100_000, "1" * 100_000, "1 " * 50_000, "1." * 20_000, "a@" + "b." * 50_000 + "c", "+1" + " " * 50_000, "+1" * 20_000]
    got = {r.doc_id: r for r in run(monkeypatch, spark, spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string"))}
    assert got[3].n_ip == 5000 and got[4].n_email == 1 and got[1].n_card == 0


def test_validators_and_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "IBAN GB83 WEST 1234 5698 7654 32", "ssn 123-45-6789", "order 123-45-6789", "call me: 212-555-0199", "212-555-0199"]
    got = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(len(r.iban), len(r.ssn), len(r.national)) for r in got] == [(1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0)]
    assert got[0].iban[0].score == 0.95


def test_account_numbers_by_length(spark):
    """A valid number followed by short words, by another number, or cut off."""
    good, de = "ES91 2100 0418 4502 0005 1332", "DE89370400440532013000"
    texts = [f"{good} EUR", f"{good} ok", f"{good} PAID NOW1 AB12", f"{good} {de} X", f"{good}1", good[:-1], f"{de} BIC COBADEFF", "ZZ91 2100 0418 4502 0005 1332", f"x{de}"]
    got = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[t[s.start : s.end] for s in r.iban] for t, r in zip(texts, got, strict=True)] == [[good], [good], [good], [good, de], [], [], [de], [], []]


def test_context_before_and_after(spark):
    texts = ["SSN: 123-45-6789, 234-56-7890", "123-45-6789 is my social security number", "123-45-6789 " + "x" * 50 + " ssn", 'api_key = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"', "sha 9f8e7d6c5b4a39281706f5e4d3c2b1a0", "token = aaaaaaaaaaaaaaaaaaaaaaaa1111"]
    got = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(len(r.ssn), len(r.secret)) for r in got] == [(2, 0), (1, 0), (0, 0), (0, 1), (0, 0), (0, 0)]
    assert texts[3][got[3].secret[0].start : got[3].secret[0].end] == "9f8e7d6c5b4a39281706f5e4d3c2b1a0"


def test_many_matches_in_one_text(monkeypatch, spark):
    text = "a@b.cd é " * 100_000
    r = run(monkeypatch, spark, spark.createDataFrame([(1, text)], "doc_id long, text string"))[0]
    assert (r.n_email, r.n_found) == (100_000, 100_000) and r.base_sha256 == brute(text)[1] and r.scored.startswith("email:0:6:0.8,email:9:15:0.8")


def test_edges_and_mask(monkeypatch, spark):
    assert len(run(monkeypatch, spark, edge(spark))) == 11 and run(monkeypatch, spark, empty(spark)) == []
    df = spark.createDataFrame([(1, "mail é a@b.cd or +49 30 1234567, x"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.mask(df).orderBy("doc_id").collect()] == ["mail é <EMAIL> or <PHONE>, x", ""]


def test_no_python_in_the_plan(spark):
    plan = pii.find_spans(edge(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
