from pathlib import Path

import pytest

from umbra.llm import licenses

TEXTS = Path("/usr/share/common-licenses")


def test_whole_texts_and_lines(spark):
    texts = [
        "MIT LICENCE\n\nCopyright (c) 2020 Someone\n\n" + licenses.MIT.replace('"', "'").replace(". ", ".\n"),
        "© 2001 X\n" + licenses.ISC_GRANT.replace(" is hereby", "\n  is hereby") + ". " + licenses.ISC_END,
        "words\nLICENSED under the Apache Licence -- version 2.0\nmore",
        "copyright notice and no licence", None, "", "!!!", "x " * 50000,
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[0], "z")], "doc_id long, text string, digest string")
    rows = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [rows[i]["license"] for i in range(8)] == ["MIT", "0BSD", None, None, None, None, None, None]
    assert rows[2]["line_licenses"] == "Apache-2.0" and rows[2]["n_license_lines"] == 1
    assert [rows[i]["digest"] for i in (4, 5, 6)] == [None] * 3 and rows[3]["n_license_lines"] == 0
    assert licenses.scan(df).count() == 9 and licenses.scan(df.limit(0)).count() == 0


def test_every_known_text_is_found_whole(spark):
    """In capitals, rewrapped, with a copyright line in front: still the same licence; with a clause added, none."""
    rows = [(i, "Copyright (c) 1999-2020 Someone, all rights reserved\n" + t.upper().replace(". ", ".\n\n")) for i, (_, t) in enumerate(licenses.KNOWN)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: n for i, (n, _) in enumerate(licenses.KNOWN)}
    other = [(i, t + "\n(c) You must retain this clause") for i, t in rows]
    assert {r["license"] for r in licenses.scan(spark.createDataFrame(other, "doc_id long, text string")).collect()} == {None}


def test_null_ids_keep_their_lines(spark):
    df = spark.createDataFrame([(None, "a\nlicensed under the apache license version 2.0"), (None, "b"), (1, "c")], "doc_id long, text string")
    rows = licenses.scan(df).collect()
    assert sorted((r["doc_id"] or 0, r["line_licenses"], r["n_license_lines"]) for r in rows) == [(0, "Apache-2.0", 1), (0, "Apache-2.0", 1), (1, "", 0)]


def test_ties_go_to_the_first_name(spark):
    texts = [("B", "One licence text."), ("A", "one LICENSE text")]
    assert [r["license"] for r in licenses.scan(spark.createDataFrame([(1, "One license text")], "doc_id long, text string"), texts).collect()] == ["A"]


@pytest.mark.skipif(not TEXTS.is_dir(), reason="the texts come with the operating system")
def test_long_licences_are_found_whole(spark):
    """As they stand and in capitals, between other blanks and with another scheme in their links; with a sentence added, none."""
    names = [n for n, _ in licenses.DIGESTS if (TEXTS / n.removesuffix(".0")).exists() or (TEXTS / n).exists()]
    assert len(names) > 8
    texts = [next(p for p in (TEXTS / n, TEXTS / n.removesuffix(".0")) if p.exists()).read_text("utf-8") for n in names]
    forms = [(t, t.upper().replace("\n", " \n\n"), t.replace("http://", "https://"), t + "\nOne more sentence.") for t in texts]
    rows = [(4 * i + j, x) for i, f in enumerate(forms) for j, x in enumerate(f)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {4 * i + j: n if j < 3 else None for i, n in enumerate(names) for j in range(4)}
