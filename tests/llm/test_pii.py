"""op5 against a plain Python reading of the contract."""

import hashlib
import re

from pyspark.sql import functions as F

from lintel.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TEXTS = [
    None, "", "a@b.c_d@e.f, x@y", "é ünï mail me: joe.x+1@mail.example.com. now", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0000255.9 9.9.9", "9" * 5000, "1 2 " * 3000,
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004", "4111  1111 1111 1111", "+49 (30) 1234-567 x +1 2 +12 34 5678 901 234 5678 +1 (", "a" * 60000, "@@a@@b.c", "a@b..c a@b.c.", "((((+1(((((((9",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 bad DE88370400440532013000", "𝒳 a@b.cd 𝒳 10.0.0.1", "1.1.1.1" * 50, "12.1.1.1.1@x.y.z", "\n1.2.3.4\n",
]


def test_base_spans_equal_the_plain_reading(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in pii.find_pii(docs).select("doc_id", F.sha2(pii.shown(F.filter("spans", lambda s: s.kind != "iban")), 256).alias("sha"), "spans").collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].sha == hashlib.sha256(base(t or "").encode()).hexdigest(), (t or "")[:80]
        assert all((t[s.start : s.end] == s.match) for s in got[i].spans)


def test_iban_and_context(spark):
    docs = spark.createDataFrame([(1, TEXTS[14]), (2, "4111111111111111"), (3, "card 4111111111111111")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert [s.match for s in got[1] if s.kind == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert got[3][0].score > got[2][0].score


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.op5_pii(spark, "/root/testdata/sf0.001").collect():
        assert r.base_sha256 == hashlib.sha256(base(texts[r.doc_id] or "").encode()).hexdigest()


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
