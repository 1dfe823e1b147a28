import base64
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_jaccard import brute
from tests.llm.test_pii import brute as spans
from umbra.llm import quality
from umbra.llm.common import stash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", None, None), (9002, "", None, "src1", 0), (9003, "x " * 30000, "en", "src1", 60000)], docs.schema)
    out = [docs.unionByName(odd)]
    for name, stage in cp.STAGES:
        out.append(stash(stage(spark, out[-1], SF), name))
    return out


def test_stages_against_brute_force(spark, steps):
    docs, good, single, clean, mixed, encoded = steps
    for s in (good, single, clean, mixed):
        assert s.columns == docs.columns
    machine = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = set()
    for r in docs.collect():
        at, x = quality.features(r["text"])
        if machine.score(at, x, np.array([0]))[0] >= 0.3:
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in good.collect()} == want
    labelled = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(good, "doc_id", "left_anti").count()
    assert labelled <= 2

    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, c, _, _ in brute(rows) if i == c)

    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert spans(r["text"]) == [] and (spans(before[r["doc_id"]]) or re.search("password|token|iban", before[r["doc_id"]] or "") or r["text"] == before[r["doc_id"]])
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)

    total = sum(len(r["text"].split()) for r in clean.where("text is not null").collect())
    taken = sum(len(r["text"].split()) for r in mixed.collect())
    assert abs(taken - total) <= 0.1 * total
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r["doc_id"], list(r["ids"])) for r in encoded.collect()) == sorted((r["doc_id"], enc.encode_ordinary(r["text"])) for r in mixed.collect())
    assert encoded.where("not exact").count() == 0


def test_empty(spark, steps):
    docs = steps[0].limit(0)
    for _, stage in cp.STAGES:
        docs = stash(stage(spark, docs, SF), "empty")
    assert docs.count() == 0
