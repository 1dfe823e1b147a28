import hashlib
import re

import pytest

from umbra.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "no data", "a@b.com_x@c.de, x@y@z.com a@@b.c", "😀é bob.o@mail.example.co.uk!", "1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.255 1.2.3", "4111 1111-1111 1111 and 4111111111111112",
    "+1 (743) 555-3824, +1(((, +12 345 678 9012 3456 789", "9" * 5000, "a" * 20000 + "@b", "1-2 " * 3000, ("x@y.zz " * 900) + "é", "a@b" + ".c" * 5000, "+1 4111111111111111 10.0.0.1.4 4111111111111111",
    "iban GB82 WEST 1234 5698 7654 32 and GB00 WEST 1234 5698 7654 32", "my ssn 123-45-6789 then 321-54-9876", 'token = "51b45cafb470023d530328210c992de051d8e541"',
    "call +1 (269) 555-3296 4524132264652876 now", "+1 (743) 555-3824 70.23.22.57", "70.23.22.57 4111111111111111", "4111111111111111@x.com", "4111111111111111 " * 600,
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, kind int")
    return {r["doc_id"]: r for r in pii.report(df).collect()}


def test_base_spans_equal_brute_force(rows):
    for i, t in enumerate(TEXTS):
        spans = [":".join(map(str, s)) for s in brute(t)]
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), (i, spans, rows[i]["spans"])
        assert [rows[i][f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in spans) for k in PLAIN]
        assert rows[i]["spans"].startswith(",".join(spans))


def test_added_kinds(rows):
    assert rows[14]["spans"].split(",")[-1] == "iban:5:32" and "iban" not in rows[14]["spans"].replace("iban:5:32", "")
    assert "ssn:7:18" in rows[15]["spans"] and rows[15]["spans"].count("ssn") == 1
    assert "secret:0:" in rows[16]["spans"]


def test_numbers_side_by_side(rows):
    assert rows[17]["spans"] == "card_part:23:39,phone_part:5:22" and rows[17]["n_card"] == rows[17]["n_phone"] == 0
    assert "ip:18:29" in rows[18]["spans"] and "phone_part:0:17" in rows[18]["spans"]
    assert rows[19]["spans"] == "ip:0:11,card_part:12:28"
    assert rows[21]["spans"].count("card_part") == 600


def test_redact_leaves_no_confirmed_span(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = pii.redact(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert brute(r["text"]) == []
        assert "123-45-6789" not in (r["text"] or "") and "555-3296" not in (r["text"] or "") and "555-3824" not in (r["text"] or "")
        assert "4111111111111111" not in (r["text"] or "") and "4524132264652876" not in (r["text"] or "")
        if TEXTS[r["doc_id"]] in (None, "", "no data"):
            assert r["text"] == TEXTS[r["doc_id"]]


def test_whole_sample_and_empty_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["base_sha256"] for r in pii.report(df).collect()}
    for r in df.collect():
        assert got[r["doc_id"]] == hashlib.sha256(",".join(":".join(map(str, s)) for s in brute(r["text"])).encode()).hexdigest()
    assert pii.report(df.limit(0)).count() == 0


def test_redact_has_no_reserved_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.com", "keep", "m", "g", 2, "o")], "doc_id long, body string, text string, m_email string, g_email string, n int, others string")
    out = pii.redact(df, "body")
    assert out.columns == df.columns and tuple(out.first()) == (1, "mail [EMAIL]", "keep", "m", "g", 2, "o")


def test_context_moves_scores_and_a_decision(spark):
    df = spark.createDataFrame([(1, "ssn 123-45-6789 email a@b.com"), (2, "number 123-45-6789 a@b.com")], "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"], r["scores"]) for r in pii.report(df).collect()}
    assert got == {1: ("email:22:29,ssn:4:15", "1.0,0.5"), 2: ("email:19:26", "0.8")}
