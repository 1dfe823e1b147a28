"""Differential privacy: bounds on what a unit changes, draws, the ledger; keyed hashes against published vectors."""

import math
import time

import pytest
from pyspark.sql import functions as F

from umbra.functions import draws, fpe, keyed
from umbra.operators import dp, quasi


def test_fresh_draws_differ_between_runs_and_derived_ones_do_not(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 4)
    run = lambda draw: sorted(map(tuple, dp.private_agg(df, ["g"], "id", "id", "id", (0, 10), 1, 1.0, draw=draw).collect()))
    assert run(draws.uniform) == run(draws.uniform)
    assert run(draws.fresh) != run(draws.fresh)
    u = [r[0] for r in spark.range(4000).select(draws.fresh("x", "id")).collect()]
    assert all(0 < x < 1 for x in u) and len(set(u)) == 4000 and abs(sum(u) / 4000 - 0.5) < 0.05


def test_draws_tell_null_keys_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "a")], "x string, y string")
    assert len({r[0] for r in df.select(draws.uniform("s", "x", "y")).collect()}) == 3


def test_a_unit_changes_at_most_m_partitions_by_one(spark):
    base = [(u, g) for u in range(40) for g in range(u % 7 + 1)]
    one = [(99, g) for g in range(7)] * 3
    frame = lambda rows: spark.createDataFrame(rows, "u long, g long")
    run = lambda rows: {r["g"]: r["noisy_units"] for r in dp.select_partitions(frame(rows), ["g"], "u", 50.0, 0.4, 3, draws.uniform).collect()}
    without, with_ = run(base), run(base + one)
    moved = [with_[g] - without[g] for g in with_ if g in without and abs(with_[g] - without[g]) > 1e-9]
    assert len(moved) <= 3 and all(x == pytest.approx(1) for x in moved)
    assert run([(1, g) for g in range(7)]) == {}  # groups of one unit stay hidden
    assert dp.partition_threshold(1.0, 1e-6, 3) == pytest.approx(1 + 3 * math.log(1 / (2 * (1 - (1 - 1e-6) ** (1 / 3)))))


def test_gaussian_calibration_is_tight():
    phi = lambda x: (1 + math.erf(x / math.sqrt(2))) / 2
    for epsilon, delta in ((0.1, 1e-6), (1.0, 1e-5), (4.0, 1e-3)):
        s = dp.gaussian_sigma(epsilon, delta, 1.0)
        assert phi(1 / (2 * s) - epsilon * s) - math.exp(epsilon) * phi(-1 / (2 * s) - epsilon * s) == pytest.approx(delta, rel=1e-3)
    with pytest.raises(ValueError):
        dp.gaussian_sigma(1.0, 0.0, 1.0)


def test_ledger():
    ledger = dp.Ledger(1.0, 1e-5)
    for i in range(4):
        ledger.spend(f"q{i}", 0.25, 2e-6)
    assert ledger.total() == pytest.approx((1.0, 8e-6))
    with pytest.raises(ValueError, match="over budget"):
        ledger.spend("more", 0.01)
    e, d = ledger.advanced(1e-6)
    assert e == pytest.approx(1.0) and d == pytest.approx(9e-6, rel=1e-4)  # no better than the sum for four mechanisms


def test_quantile_falls_between_values(spark):
    """With a large budget the answer lies in the gap at the rank, whatever the bounds' width; ties and nulls too."""
    rows = [(float(v),) for v in range(1000)] + [(None,)] * 50
    df = spark.createDataFrame(rows, "v double")
    assert 740 <= dp.private_quantile(df, "v", 0.75, 0.0, 1e9, 50.0).first()[0] <= 760
    assert 0 <= dp.private_quantile(df.limit(0), "v", 0.5, 0.0, 8.0, 1.0).first()[0] <= 8


def test_local_reports_estimate_counts(spark):
    domain = ["a", "b", "c", "d"]
    df = spark.range(20000).select("id", F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("v"))
    want = {"a": 12000, "b": 6000, "c": 2000, "d": 0}
    said = dp.randomize(df, "v", domain, 2.0, "id", draw=draws.fresh)
    got = {r["v"]: r["estimate"] for r in dp.estimate_frequencies(said, "v", domain, 2.0).collect()}
    hashed = {r["value"]: r["estimate"] for r in dp.estimate_hashed(dp.local_hash_report(df, "v", 2.0, "id"), domain, 2.0).collect()}
    assert all(abs(got.get(v, 0) - n) < 900 and abs(hashed[v] - n) < 900 for v, n in want.items())
    odd = spark.createDataFrame([(1, None), (2, "zz")], "id long, v string")
    assert all(r["v"] in domain for r in dp.randomize(odd, "v", domain, 1.0, "id").collect())


def test_hmac_of_rfc_4231(spark):
    vectors = [(b"\x0b" * 20, "Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"), (b"Jefe", "what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"), (b"\xaa" * 131, "Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54")]
    for key, text, want in vectors:
        assert spark.createDataFrame([(text,)], "x string").select(keyed.hmac("x", key)).first()[0] == want


def test_pram_matrix_must_be_stochastic(spark):
    with pytest.raises(ValueError):
        quasi.pram(spark.range(1).withColumn("v", F.lit("a")), "v", {"a": {"a": 0.5}}, "id", "s")


def test_advanced_composition_admits_what_the_sum_refuses():
    basic, advanced = dp.Ledger(1.0, 1e-5), dp.Ledger(1.0, 1e-5, slack=1e-6)
    for i in range(100):
        basic.spend(f"q{i}", 0.01)
    with pytest.raises(ValueError, match="over budget"):
        basic.spend("q100", 0.01)
    for i in range(300):
        advanced.spend(f"q{i}", 0.01 if i % 2 else 0.008, 1e-9)
    squares = 150 * (0.01**2 + 0.008**2)
    want = math.sqrt(2 * math.log(1e6) * squares) + squares / 2
    assert advanced.total() == pytest.approx((want, 300e-9 + 1e-6)) and want < 1.0 < 300 * 0.009
    e, d = advanced.advanced(1e-6)
    assert e < 1.0 and d == pytest.approx(1.3e-6, rel=1e-3)
    with pytest.raises(ValueError, match="over budget"):
        advanced.spend("large", 0.9)
    advanced.spend("small", 0.01)
    with pytest.raises(ValueError, match="over budget"):  # delta has no slack left
        advanced.spend("delta", 0.001, 9e-6)
    with pytest.raises(ValueError, match="negative"):
        advanced.spend("refund", -0.5)


def test_every_mechanism_charges_the_ledger(spark):
    df = spark.range(10).select("id", F.col("id").cast("double").alias("v"), F.lit("a").alias("s"), F.lit(True).alias("f"), F.current_timestamp().alias("ts"))
    from umbra.streaming import ops

    runs = {
        "agg": lambda x: dp.private_agg(df, ["s"], "id", "id", "v", (0, 1), 1, 1.0, ledger=x),
        "max": lambda x: dp.noisy_max(df, "s", "v", 1.0, 1.0, ledger=x),
        "quantile": lambda x: dp.private_quantile(df, "v", 0.5, 0.0, 9.0, 1.0, ledger=x),
        "partitions": lambda x: dp.select_partitions(df, ["s"], "id", 1.0, 1e-6, 1, ledger=x),
        "response": lambda x: dp.randomize(df, "s", ["a", "b"], 1.0, "id", ledger=x),
        "coin": lambda x: dp.randomized_response(df, "f", math.tanh(0.5), "id", ledger=x),
        "bloom": lambda x: dp.bloom_report(df, "s", 16, 2, 1.0, "id", ledger=x),
        "hash": lambda x: dp.local_hash_report(df, "s", 1.0, "id", ledger=x),
        "continual": lambda x: ops.continual_count(df, "s", "ts", "2024-01-01", "1 day", 4, 1.0, ledger=x),
    }
    for name, run in runs.items():
        ledger = dp.Ledger(1.0, 1e-6)
        run(ledger)
        assert [(n, pytest.approx(e)) for n, e, _ in ledger.spent] == [(name, 1.0)]
        with pytest.raises(ValueError, match=f"{name}: over budget"):
            run(dp.Ledger(0.999, 1e-6))


def test_noise_differs_between_runs_by_default(spark):
    """Noise that a run repeats can be taken off."""
    df = spark.range(60).select("id", F.lit(5.0).alias("v"), F.lit("a").alias("s"), F.array(F.lit(0.5), F.lit(0.25)).alias("e"), F.lit(True).alias("f"))
    runs = {
        "add_noise": lambda: quasi.add_noise(df, "v", 1.0, "id", "n"),
        "pram": lambda: quasi.pram(df, "s", {"a": {"a": 0.5, "b": 0.5}}, "id", "p"),
        "noise_vector": lambda: quasi.noise_vector(df, "e", 1.0, 0.1, "id", "v"),
        "bloom_report": lambda: dp.bloom_report(df, "s", 32, 2, 1.0, "id"),
        "local_hash_report": lambda: dp.local_hash_report(df, "s", 1.0, "id"),
        "randomize": lambda: dp.randomize(df, "s", ["a", "b", "c"], 1.0, "id"),
        "randomized_response": lambda: dp.randomized_response(df, "f", 0.1, "id"),
    }
    for name, run in runs.items():
        assert run().columns[: len(df.columns)] == df.columns
        one, two = (sorted(map(str, run().collect())) for _ in range(2))
        assert one != two and len(one) == 60, name


def test_noise_of_nulls(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, 1.0, [], "a"), (3, 2.0, [1.0, None], "b")], "id long, v double, e array<float>, s string")
    assert [r["v"] is None for r in quasi.add_noise(df, "v", 1.0, "id", "n").orderBy("id").collect()] == [True, False, False]
    got = [r["e"] for r in quasi.noise_vector(df, "e", 1.0, 0.1, "id", "n").orderBy("id").collect()]
    assert got[0] is None and got[1] == [] and len(got[2]) == 2 and got[2][1] is None
    assert all(len(r["report"]) == 8 for r in dp.bloom_report(df, "s", 8, 2, 1.0, "id").collect())
    assert all(0 <= r["cell"] < 4 for r in dp.local_hash_report(df, "s", 1.0, "id").collect())


def test_bloom_reports_decode(spark):
    """Counts from fresh reports, within five standard errors; candidates that nobody holds come out near nothing."""
    domain = [f"value {i}" for i in range(40)]
    n = {v: 4000 // (i + 1) for i, v in enumerate(domain[:12])}
    df = spark.createDataFrame([(v, c) for v, c in n.items()], "v string, c int").withColumn("i", F.explode(F.sequence(F.lit(1), "c"))).select("v", F.monotonically_increasing_id().alias("id"))
    said = dp.bloom_report(df, "v", 128, 2, 4.0, "id")
    got = {r["value"]: r for r in dp.estimate_bloom(said, domain, 128, 2, 4.0).collect()}
    assert len(got) == 40 and all(r["estimate"] >= 0 for r in got.values())
    assert all(abs(r["estimate"] - n.get(v, 0)) <= 5 * r["error"] for v, r in got.items())
    with pytest.raises(ValueError, match="bits x candidates"):
        dp.estimate_bloom(said, ["x"] * 100_000, 128, 2, 4.0)
    empty = dp.estimate_bloom(said.limit(0), ["a", "b"], 128, 2, 4.0).collect()
    assert [r["estimate"] for r in empty] == [0.0, 0.0]


def test_least_squares_without_negatives():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(20):
        a, y = rng.integers(0, 2, (12, 5)).astype(float), rng.normal(size=12)
        x = dp.least_squares(a, y)
        slope = a.T @ (a @ x - y)
        assert (x >= 0).all() and (slope >= -1e-6).all() and abs(slope @ x) < 1e-6  # the optimum's conditions


#: Sample vectors of NIST for FF1: key bytes, tweak, plain, sealed.
FF1_KEY = "2B7E151628AED2A6ABF7158809CF4F3CEF4359D8D580AA4F7F036D6F04FC6A94"
FF1 = [
    (16, "", "0123456789", "2433477484"),
    (16, "39383736353433323130", "0123456789", "6124200773"),
    (16, "3737373770717273373737", "0123456789abcdefghi", "a9tv40mll9kdu509eum"),
    (24, "", "0123456789", "2830668132"),
    (24, "39383736353433323130", "0123456789", "2496655549"),
    (24, "3737373770717273373737", "0123456789abcdefghi", "xbj3kv35jrawxv32ysr"),
    (32, "", "0123456789", "6657667009"),
    (32, "39383736353433323130", "0123456789", "1001623463"),
    (32, "3737373770717273373737", "0123456789abcdefghi", "xs8a0azh2avyalyzuwd"),
]


@pytest.mark.parametrize(("size", "tweak", "plain", "sealed"), FF1)
def test_ff1_vectors(spark, size, tweak, plain, sealed):
    letters = fpe.DIGITS + ("abcdefghijklmnopqrstuvwxyz" if "a" in plain else "")
    cipher = fpe.FF1(bytes.fromhex(FF1_KEY[: 2 * size]), bytes.fromhex(tweak), letters)
    row = spark.createDataFrame([(plain,)], "x string").select(cipher.encrypt("x").alias("c")).select("c", cipher.decrypt("c").alias("p")).first()
    assert (row["c"], row["p"]) == (sealed, plain)


def test_ff1_keeps_form_and_reverses(spark):
    cipher = fpe.FF1(b"k" * 16, b"t")
    values = ["Customer#000000001", "4785-3805 9239/1139", "12345", "", None, "no digits", "é1²2x3-4５5 6", "9" * cipher.most, "9" * (cipher.most + 1)] + [f"{i:0{n}}" for n in range(6, 20) for i in (0, 10**n - 1)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    out = df.select("i", "x", cipher.encrypt("x").alias("c")).withColumn("p", cipher.decrypt("c"))
    for r in out.collect():
        digits = sum(c in fpe.DIGITS for c in r["x"] or "")
        if r["x"] is None or not cipher.least <= digits <= cipher.most:
            assert r["c"] is None
        else:
            assert r["p"] == r["x"] and r["c"] != r["x"]
            assert [c for c in r["c"] if c not in fpe.DIGITS] == [c for c in r["x"] if c not in fpe.DIGITS] and len(r["c"]) == len(r["x"])
    many = spark.range(1000).select(cipher.encrypt(F.lpad(F.col("id").cast("string"), 6, "0")).alias("c"))
    assert many.distinct().count() == 1000
    assert "Python" not in many._jdf.queryExecution().executedPlan().toString()
    for bad in (lambda: fpe.FF1(b"short"), lambda: fpe.FF1(b"k" * 16, alphabet="aa")):
        with pytest.raises(ValueError):
            bad()


def test_vault_numbers_once(spark, tmp_path):
    from umbra.operators.identifiers import Vault, tokenize

    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "x string")
    vault = Vault(spark, f"file://{tmp_path}/vault", b"key")
    assert vault.table().count() == 0
    one = {r["value"]: r["token"] for r in vault.grow(frame("a", "b", "b", None, ""), "x", "monday").collect()}
    assert sorted(one) == ["", "a", "b"] and sorted(one.values()) == [1, 2, 3]
    two = {r["value"]: r["token"] for r in vault.grow(frame("b", "c", "d", "a"), "x", "tuesday").collect()}
    assert {k: two[k] for k in one} == one and sorted(two.values()) == [1, 2, 3, 4, 5]
    again = vault.grow(frame("b", "c", "zzz"), "x", "tuesday")  # a finished run that is tried again changes nothing
    assert {r["value"]: r["token"] for r in again.collect()} == two
    (tmp_path / "vault" / "run=tuesday" / "_SUCCESS").unlink()  # one that died on its way is replaced
    redone = {r["value"]: r["token"] for r in vault.grow(frame("b", "c", "d", "a"), "x", "tuesday").collect()}
    assert redone == two
    assert vault.grow(frame("a", None), "x", "nothing new").count() == 5
    got = [r["x"] for r in tokenize(frame("a", "unknown", None, "d"), "x", vault.table()).collect()]
    assert sorted(map(str, got)) == sorted(["None", "None", str(two["a"]), str(two["d"])])


def test_ff1_runs_its_rounds_once_a_value(spark):
    """The cost is that of its AES calls, ten a value; it was that of ten for each of a value's characters."""
    df = spark.range(1500).select(F.format_string("Customer#%09d", "id").alias("x")).repartition(1).cache()
    cipher = fpe.FF1(bytes(range(32)), b"x")
    key, blank = F.unhex(F.lit(bytes(range(32)).hex())), F.unhex(F.lit("00" * 16))
    calls = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.aes_encrypt(F.unhex(F.lpad(F.hex(i), 64, "0")), key, F.lit("CBC"), F.lit("DEFAULT"), blank))

    def took(col):
        best = []
        for _ in range(3):
            began = time.perf_counter()
            df.select(col.alias("y")).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        return min(best)

    assert took(cipher.encrypt("x")) < 10 * took(calls)
