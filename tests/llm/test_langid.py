import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from umbra.llm import langid
from umbra.llm.common import crc_fold


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(df.where(crc_fold() != 0))
    got = langid.predict(df, model, keep=[(crc_fold() == 0).alias("held_out"), F.col("lang")]).where("held_out").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixed_text_scripts_and_cases(spark):
    train = [(i, f"the cat and the dog {w}", "en") for i, w in enumerate(["house", "with", "this", "water"] * 20)]
    train += [(100 + i, f"der hund und die katze {w}", "de") for i, w in enumerate(["haus", "mit", "nicht", "wasser"] * 20)]
    train += [(200 + i, "кошка и собака в доме", "ru") for i in range(20)]
    train += [(300, "nothing", None), (301, None, "en")]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.learn(df)
    half = "the cat and the dog with this water " * 4
    text = half + "der hund und die katze nicht wasser " * 5
    rows = [(1, text), (2, None), (3, "123 -- !"), (4, "ωmega"), (5, "собака"), (5, "собака"), (6, "the dog " * 60000)]
    test = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    out = langid.label_spans(test, model).collect()
    spans = {r["doc_id"]: r["spans"] for r in out}
    assert [s["lang"] for s in spans[1]] == ["en", "de"] and abs(spans[1][1]["start"] - len(half)) < 10
    pred = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(test, model).collect()]
    assert sorted((r["doc_id"], r["lang_pred"]) for r in out) == sorted(pred)
    assert dict(pred) | {4: "?"} == {1: "de", 2: "und", 3: "und", 4: "?", 5: "ru", 6: "en"} and len(pred) == 7
    none = langid.learn(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(test, none).collect()} == {"und"}
    assert langid.predict(test.limit(0), model).count() == 0


def test_two_other_languages_beat_the_best_single_one():
    model = langid.Model(["a", "b", "c"], np.ones((langid.BUCKETS, 3)), np.ones((len(langid.NAMES), 3)))
    model.scores = np.array([[0, 10, -30], [0, -30, 10]])
    assert model.label(np.array([0, 1]))[0].tolist() == [1, 2]
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = model.scores = rng.normal(0, 8, (rng.integers(1, 6), 3)).round(3)
        worth = lambda path: sum(s[t][k] for t, k in enumerate(path)) - langid.PENALTY * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
        assert worth(model.label(np.arange(len(s)))[0]) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=len(s)))))


def plain_grams(word):
    """Hashed n-grams of one word, letter by letter."""
    out, text = [], f"<{word}>"
    for n in langid.GRAMS:
        for i in range(len(text) - n + 1):
            if n > 1 or 0 < i < len(text) - 1:
                h = n
                for c in text[i : i + n]:
                    h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % 2**64
                    h ^= h >> 29
                out.append((h >> 20) % langid.BUCKETS)
    return out


def test_scores_equal_their_definition():
    """A word's score is the sum of its n-grams' log shares over the root of their number; a text's are sums over words."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, (langid.BUCKETS, 3)).astype(float)
    model = langid.Model(["a", "b", "c"], counts, np.ones((len(langid.NAMES), 3)))
    words = ["a", "über", "кошка", "word", "漢字", "x" * 50]
    at, own = langid.grams(words)
    for i, w in enumerate(words):
        assert sorted(at[own == i].tolist()) == sorted(plain_grams(w))
    names, scores = model.predict([" ".join(words), "word word"])
    log = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * langid.BUCKETS))
    each = {w: log[plain_grams(w)].sum(0) / np.sqrt(len(plain_grams(w))) for w in words}
    assert all(np.allclose(model.scores[model.at[w]], each[w], atol=1e-2) for w in words)
    total = 2 * each["word"]
    best = int(total.argmax())
    assert names[1] == "abc"[best] and abs(scores[1] - max(0.5, 1 / np.exp(total - total[best]).sum())) < 1e-3


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aé²x_3 \u0301Ⅷहि"), st.characters(codec="utf-8")), max_size=20))
def test_the_fast_pattern_finds_the_same_words(text):
    assert langid.word_pattern(text).findall(text) == langid.WORD.findall(text)


def test_rows_without_an_id(spark):
    from umbra.llm import queries
    from umbra.llm.common import held_out

    df = spark.createDataFrame([(None, "the dog", "en"), (1, "der hund", "de")], "doc_id long, text string, lang string")
    got = langid.predict(df, langid.learn(df), keep=[held_out().alias("held_out")]).collect()
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False] and len(got) == 2
    assert queries.held_out is held_out


def test_words_are_letters_and_their_marks():
    """Numerals are no letters; marks belong to their letters; the script is that of most letters."""
    assert langid.WORD.findall("² ½ ① Ⅷ 3 _ ٣") == []
    assert langid.WORD.findall("हिन्दी cafe\u0301s x²y") == ["हिन्दी", "cafe\u0301s", "x", "y"]
    name = lambda w: langid.NAMES[langid.script(w)]
    assert [name(w) for w in ("word", "über", "हिन्दी", "aсобака", "漢字かな", "ωmega")] == ["Latin", "Latin", "Devanagari", "Cyrillic", "Han", "Latin"]
    model = langid.Model(["a", "b"], np.ones((langid.BUCKETS, 2)), np.ones((len(langid.NAMES), 2)))
    assert model.predict(["² ½ ①", "", None, "a²"])[0][:3] == ["und"] * 3 and model.spans(["² ½"])[0][0] == "und"
