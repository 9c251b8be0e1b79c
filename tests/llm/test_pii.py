import hashlib
import random
import re

from pyspark.sql import functions as F

from weftgraph.llm.pii import BASE, anchors, find_pii, luhn, mask_pii, scan_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (
                k == "ip" and any(int(x) > 255 for x in m[0].split("."))
                or k == "card" and not (12 <= len(d) <= 19 and luhn(d))
                or k == "phone" and not 9 <= len(d) <= 15
            ):
                continue
            out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def test_random_texts():
    r, a = random.Random(1), anchors()
    for _ in range(20_000):
        text = "".join(r.choice("a.@0123456789 -+()é%\nK" if r.random() < 0.6 else "0123456789.@ -") for _ in range(r.randint(0, 40)))
        assert sorted(s for s in find_pii(text, a) if s[0] in BASE) == sorted(brute(text)), text


def test_added_spans():
    a = anchors()
    kinds = lambda t: {k: t[x:y] for k, x, y in find_pii(t, a)}
    assert kinds("see https://joe:pw1@host.example/x")["login"] == "https://joe:pw1@host.example"
    assert kinds("Account number: 8812345 ok")["account"] == "8812345"
    assert "account" not in kinds("on account of the rain: 12")


def test_accounts_in_prose():
    a = anchors()
    found = lambda t: [t[x:y] for k, x, y in find_pii(t, a) if k == "account"]
    for text, value in (
        ("account 12345678 was", "12345678"),
        ("my account number is 12345678.", "12345678"),
        ("SSN 123-45-6789", "123-45-6789"),
        ("ssn: 123 45 6789, born", "123 45 6789"),
        ("IBAN DE89370400440532013000", "DE89370400440532013000"),
        ("IBAN: DE89 3704 0044 0532 0130 00 is mine", "DE89 3704 0044 0532 0130 00"),
        ("iban: GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 32"),
        ("account: 1234 5678 9012 on 3 May", "1234 5678 9012"),
        ("Konto: 12345678 10.0.0.1", "12345678"),
    ):
        assert found(text) == [value], text
    for text in ("IBAN DE89370400440532013001", "SSN 000-45-6789", "SSN 666-45-6789", "SSN 912-45-6789", "SSN 123-00-6789", "SSN 123-45-0000", "account 2024 was", "accounting 12345678", "on account of 12345678"):
        assert found(text) == [], text


def test_query_columns(docs_of):
    texts = [None, "", "ünï a@b.co und 10.0.0.1, +49 (30) 123456-7", "4539 1488 0343 6467 " * 3, "x" * 200_000 + " me@site.org", "a@b@c.de"]
    df = docs_of(list(enumerate(texts))).withColumn("_spans", F.lit(1)).withColumn("n_ip", F.lit(2))
    for r in scan_pii(df).collect():
        text = texts[r.doc_id] or ""
        want = brute(text)
        assert [r._n_email, r._n_ip, r._n_card, r._n_phone] == [sum(s[0] == k for s in want) for k in BASE]
        assert r._base_sha256 == hashlib.sha256(",".join(f"{k}:{x}:{y}" for k, x, y in want).encode()).hexdigest()
        assert r.n_ip == 2
    assert scan_pii(df.where("false")).count() == 0


def test_mask():
    text = "ü a@b.co, a@b.co"
    spans = ",".join(f"{k}:{x}:{y}" for k, x, y in find_pii(text, anchors()))
    assert mask_pii(text, spans) == "ü [EMAIL], [EMAIL]" and mask_pii("x", "") == "x"
