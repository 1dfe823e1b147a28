import base64
import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from umbra.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RAW = f.read()
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}, special_tokens={})
CODEC = bpe.Codec(RAW, P.PATTERN)
ODD = ["", "a" * 3000, "  a  b\n\n\nc \t\x1c x\x85y\xa0z", "²³ ½ x² Ⅷ 漢字 ひらがな 😀👍🏽 'll I'll 's", " <|endoftext|> ", "a　b  \n", "!" * 40, None, " ", "\n"]


def test_equals_tiktoken_on_odd_texts():
    assert CODEC.encode(ODD) == [ENC.encode_ordinary(t or "") for t in ODD]
    assert CODEC.encode([]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_equals_tiktoken_and_round_trips(texts):
    ids = CODEC.encode(texts)
    assert ids == [ENC.encode_ordinary(t) for t in texts]
    assert [CODEC.decode(i).decode() for i in ids] == texts


def test_query_form(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    got = bpe.digests(df, PATH, P.PATTERN).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = ENC.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())


def test_operators_and_cases(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(0, "", "x")], "doc_id long, text string, ids string")
    ids = bpe.encode(df, PATH, P.PATTERN)
    assert sorted((r["doc_id"], list(r["ids"])) for r in ids.collect()) == sorted([(i, ENC.encode_ordinary(t or "")) for i, t in enumerate(ODD)] + [(0, [])])
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(ids, PATH, P.PATTERN).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0
