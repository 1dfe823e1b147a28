"""Named queries over the operators, and their DuckDB counterparts."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws, fpe, keyed, strings
from ..operators import asof, dp, groups, identifiers, quasi, risk, text, utility
from ..sources import io
from ..streaming import ops

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
KEY = b"umbra demonstration key"
QI = ["r_name", "c_mktsegment", "bal"]
u_sql = draws.uniform_sql


def query(sql: str | None = None):
    """Register a function of `t`, which gives a table by its name; sql None: rows-only check."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def t(name: str) -> DataFrame:
                return io.read(spark, sf_dir, name)

            t.spark, t.dir = spark, sf_dir
            return f(t)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def r(c, d: int = 6):
    return F.round(c, d)


def customers(t) -> DataFrame:
    """Customers with region, market segment and 5000-wide balance bins."""
    nation, region = t("nation"), t("region")
    small = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    c = t("customer")
    return c.join(small, c.c_nationkey == small.n_nationkey).withColumn("bal", quasi.bin_("c_acctbal", 5000)).select("c_custkey", "c_name", "n_name", "r_name", "c_mktsegment", "bal", "c_acctbal")


CUST = "(SELECT c_custkey, c_name, n_name, r_name, c_mktsegment, (floor(c_acctbal / 5000::double) * 5000)::bigint AS bal, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
INNER, OUTER = keyed.pads(KEY)


def hmac_sql(x: str) -> str:
    return f"sha256(from_hex('{OUTER}') || from_hex(sha256(from_hex('{INNER}') || encode(({x})::varchar))))"


# A. Sources and sinks


@query("SELECT r_regionkey, r_name FROM region")
def a1_parquet_scan(t):
    return t("region")


def _through(t, fmt: str, **options) -> DataFrame:
    df = t("events").select("event_id", "event_type", "value", "props")
    path = io.scratch(t.spark, fmt)
    io.release(df, path, fmt)
    return io.read_as(t.spark, fmt, path, df.schema, **options)


EVENTS = "SELECT event_id, event_type, value, props FROM events"


@query(EVENTS)
def a2_json_scan(t):
    return _through(t, "json")


@query(EVENTS)
def a2_orc_scan(t):
    return _through(t, "orc")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def a2_csv_scan(t):
    df = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    path = io.scratch(t.spark, "csv")
    io.release(df, path, "csv")
    return io.read_as(t.spark, "csv", path, df.schema)


@query("SELECT r_regionkey, r_name FROM region")
def a2_jdbc_scan(t):
    """From a read-only database in the shared folder, which every executor opens."""
    return io.read_as(t.spark, "jdbc", **io.database(t("region"), "REGION")).select("r_regionkey", "r_name")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def a4_partitioned_sink(t):
    path = io.scratch(t.spark, "release")
    io.release(t("customer").select("c_custkey", "c_mktsegment"), path, partition_by=("c_mktsegment",))
    return t.spark.read.parquet(path).groupBy(F.col("c_mktsegment").cast("string").alias("c_mktsegment")).agg(F.count("*").alias("n"))


# B. Relational substrate


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def b1_b2_project_filter(t):
    return t("customer").where("c_acctbal > 5000 and c_mktsegment = 'BUILDING'").select("c_custkey", "c_nationkey")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def b3_inner_join(t):
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def b4_semi_join(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def b4_anti_join(t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY 1")
def b5_left_join(t):
    return t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT r_name, c_mktsegment FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)")
def b5_cross_join(t):
    """The grid of all classes; both sides are lists of values."""
    return t("region").select("r_name").crossJoin(F.broadcast(t("customer").select("c_mktsegment").distinct()))


@query("SELECT p_partkey, b.lo FROM part JOIN (VALUES (1, 10), (11, 30), (31, 50)) AS b(lo, hi) ON p_size BETWEEN b.lo AND b.hi")
def b6_range_join(t):
    bands = t.spark.createDataFrame([(1, 10), (11, 30), (31, 50)], "lo int, hi int")
    return t("part").join(F.broadcast(bands), F.col("p_size").between(F.col("lo"), F.col("hi"))).select("p_partkey", "lo")


@query("SELECT e.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'view') AS e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) AS p ON e.user_id = p.user_id AND e.ts >= p.ts")
def b7_asof_join(t):
    """The last purchase at or before each view of the same user: one ordered window over both sides, no pairs."""
    e = t("events").where("event_type in ('view', 'purchase')")
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") != "purchase", "event_id")
    return e.withColumn("last_purchase", F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("event_type = 'view'").select("event_id", "last_purchase")


@query("""SELECT e.event_id, o.o_orderkey, o.d AS ordered FROM events AS e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate + INTERVAL 9131 DAY AS d, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) AS o
ON e.user_id = o.o_custkey AND e.ts >= o.d""")
def b7_asof_join_tables(t):
    """The last order of an event's user, dates moved by 25 years into the events' time: two tables, sorted by ranges."""
    orders = t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderdate") + F.expr("interval 9131 days")).alias("ordered"))
    out = asof.asof_join(t("events").select("event_id", "user_id", "ts"), orders, {"user_id": "o_custkey"}, ("ts", "ordered"), "o_orderkey")
    return out.select("event_id", "o_orderkey", "ordered")


@query("""SELECT event_id, CASE WHEN ts - d <= INTERVAL 90 DAY THEN o_orderkey END AS o_orderkey FROM (SELECT e.event_id, e.ts, o.o_orderkey, o.d FROM events AS e ASOF LEFT JOIN
(SELECT o_custkey, o_orderdate + INTERVAL 9131 DAY AS d, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) AS o ON e.user_id = o.o_custkey AND e.ts >= o.d)""")
def b7_asof_join_tolerance(t):
    orders = t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderdate") + F.expr("interval 9131 days")).alias("ordered"))
    return asof.asof_join(t("events").select("event_id", "user_id", "ts"), orders, {"user_id": "o_custkey"}, ("ts", "ordered"), "o_orderkey", F.expr("interval 90 days")).select("event_id", "o_orderkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2")
def b8_group_aggregate(t):
    return t("lineitem").where("l_shipdate <= timestamp_ntz '2000-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("qty"), r(F.avg("l_discount")).alias("disc"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def b9_distinct_aggregate(t):
    return t("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query(f"SELECT r_name, c_mktsegment, grouping_id(r_name, c_mktsegment)::bigint AS g, count(*) AS n FROM {CUST} GROUP BY CUBE (r_name, c_mktsegment)")
def b10_cube(t):
    return customers(t).cube("r_name", "c_mktsegment").agg(F.grouping_id().cast("bigint").alias("g"), F.count("*").alias("n"))


@query(f"SELECT r_name, c_mktsegment, count(*) AS n FROM {CUST} GROUP BY GROUPING SETS ((r_name), (c_mktsegment))")
def b10_grouping_sets(t):
    return customers(t).groupingSets([[F.col("r_name")], [F.col("c_mktsegment")]], "r_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query(f"SELECT r_name, n_name, count(*) AS n FROM {CUST} GROUP BY ROLLUP (r_name, n_name)")
def b11_rollup(t):
    return customers(t).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, row_number() OVER w AS rn, ntile(4) OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
def b12_ranking(t):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return t("orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("rn"), F.ntile(4).over(w).cast("bigint").alias("q"))


@query("SELECT event_id, lag(value) OVER w AS prev, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def b13_analytic(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.lag("value").over(w).alias("prev"), r(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def b14_topk_per_group(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey")


@query("(SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def b15_set_operations(t):
    c, s = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))
    return c.exceptAll(s).unionAll(c.intersect(s))


@query("SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def b16_percentile(t):
    """By counts and ranks: no group's values are held at once."""
    return groups.grouped_quantiles(t("events"), ["event_type"], "value", 0.9, "p90").withColumn("p90", r("p90"))


NEAR = "SELECT event_type, count(DISTINCT user_id) AS users, true AS count_ok, true AS hll_ok, true AS theta_ok FROM events GROUP BY 1"


@query(NEAR)
def b17_approx_distinct(t):
    """Three estimators, each within 5 % of the exact count."""
    ok = lambda c: F.abs(c - F.col("users")) <= 0.05 * F.col("users")
    exact = t("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    near = t("events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 14)).alias("h"), F.theta_sketch_estimate(F.theta_sketch_agg("user_id")).alias("th"))
    return exact.join(near, "event_type").select("event_type", "users", ok(F.col("a")).alias("count_ok"), ok(F.col("h")).alias("hll_ok"), ok(F.col("th")).alias("theta_ok"))


@query("SELECT event_type, true AS percentile_ok, true AS kll_ok FROM events GROUP BY 1")
def b18_approx_quantile(t):
    """The share of rows up to an estimated quantile is within 0.05 of the share asked for."""
    shares = [0.5, 0.9, 0.99]
    kll = F.kll_sketch_agg_double("value")
    e = t("events").select("event_type", "value")
    near = e.groupBy("event_type").agg(F.percentile_approx("value", shares).alias("p"), kll.alias("k")).select("event_type", "p", F.array(*[F.kll_sketch_get_quantile_double("k", F.lit(p)) for p in shares]).alias("k"))
    upto = [F.avg((F.col("value") <= F.col(c)[i]).cast("double")).alias(f"{c}{i}") for c in ("p", "k") for i in range(3)]
    ranks = e.join(near, "event_type").groupBy("event_type").agg(*upto)
    small = F.lit(1.0) / 20 + F.lit(0.01)
    ok = lambda c: F.forall(F.array(*[F.abs(F.col(f"{c}{i}") - p) for i, p in enumerate(shares)]), lambda d: d <= small)
    return ranks.select("event_type", ok("p").alias("percentile_ok"), ok("k").alias("kll_ok"))


@query("SELECT user_id, s AS session, count(*) AS n FROM (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::bigint AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY 1, 2")
def b19_sessions(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 6 hours"), 0).otherwise(1)
    return t("events").withColumn("f", gap).withColumn("session", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def b20_global_topk(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, upper(c_mktsegment) AS a, substring(c_name, 10, 4) AS b, length(trim(c_name))::bigint AS n FROM customer WHERE c_name LIKE '%7'")
def b21_string_functions(t):
    return t("customer").where("c_name like '%7'").select("c_custkey", F.upper("c_mktsegment").alias("a"), F.substring("c_name", 10, 4).alias("b"), F.length(F.trim("c_name")).cast("bigint").alias("n"))


@query("SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 5) AS a, round(power(s_acctbal / 1000, 2), 5) AS b FROM supplier")
def b22_math_functions(t):
    return t("supplier").select("s_suppkey", r(F.sqrt(F.abs("s_acctbal")), 5).alias("a"), r(F.pow(F.col("s_acctbal") / 1000, F.lit(2)), 5).alias("b"))


@query("SELECT p_partkey, len(list_distinct(string_split(p_name, ' ')))::bigint AS n, array_to_string(list_sort(string_split(upper(p_name), ' ')), '-') AS s FROM part")
def b23_array_functions(t):
    return t("part").select("p_partkey", F.size(F.array_distinct(F.split("p_name", " "))).cast("bigint").alias("n"), F.array_join(F.array_sort(F.transform(F.split("p_name", " "), F.upper)), "-").alias("s"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS rule FROM events")
def b24_map_lookup(t):
    return t("events").select("event_id", F.try_element_at(F.create_map(F.lit("click"), F.lit(1), F.lit("view"), F.lit(2)), F.col("event_type")).alias("rule"))


@query("SELECT o_orderkey, year(o_orderdate)::bigint AS y, (date_trunc('month', o_orderdate))::timestamp AS m, o_orderdate + INTERVAL 3 DAY AS later FROM orders")
def b25_date_functions(t):
    return t("orders").select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("y"), quasi.trunc_date("o_orderdate", "month").alias("m"), (F.col("o_orderdate") + F.expr("interval 3 days")).alias("later"))


@query("SELECT event_id, json_extract_string(props, '$.k')::bigint AS k FROM events")
def b26_json_functions(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# C. Direct identifiers


@query("SELECT c_custkey, NULL::varchar AS c_name FROM customer")
def c1_suppress_columns(t):
    return identifiers.suppress_columns(t("customer"), ["c_name"]).select("c_custkey", "c_name")


@query("SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_name FROM customer")
def c2_mask(t):
    return t("customer").select("c_custkey", keyed.mask_chars("c_name").alias("c_name"))


@query("SELECT c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) AS c_name FROM customer")
def c3_keep_last(t):
    return t("customer").select("c_custkey", keyed.keep_last("c_name", 4).alias("c_name"))


@query("SELECT sha256('pepper' || c_name) AS h FROM customer")
def c4_salted_hash(t):
    return t("customer").select(keyed.salted("c_name", "pepper").alias("h"))


@query(f"SELECT {hmac_sql('c_custkey')} AS id, {hmac_sql('c_name')} AS name FROM customer")
def c5_keyed_hash(t):
    return identifiers.pseudonymize(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), ["id", "name"], KEY)


@query("SELECT c_custkey, c_name FROM customer")
def c6_encrypt_decrypt(t):
    key = "0123456789abcdef"
    return identifiers.decrypt(identifiers.encrypt(t("customer").select("c_custkey", "c_name"), "c_name", key), "c_name", key)


@query(f"SELECT c_custkey, substring({hmac_sql('c_name')}, 1, 16) AS c_name FROM customer")
def c7_tokenize(t):
    c = t("customer").select("c_custkey", "c_name")
    return identifiers.tokenize(c, "c_name", identifiers.new_vault(c, "c_name", KEY))


@query("SELECT count(DISTINCT c_name) AS n, count(DISTINCT c_name) AS n_tokens, 1::bigint AS least, count(DISTINCT c_name) AS most, count(*) AS n_rows, true AS kept FROM customer")
def c7_stored_vault(t):
    """Two runs, the first over a third of the customers: tokens without gaps, each once, and the first run's kept."""
    c = t("customer").select("c_custkey", "c_name")
    vault = identifiers.Vault(t.spark, io.scratch(t.spark, "vault"), KEY)
    first = vault.grow(c.where("c_custkey % 3 = 0"), "c_name", "1").withColumnRenamed("token", "old")
    whole = vault.grow(c, "c_name", "2")
    rows = identifiers.tokenize(c, "c_name", whole).agg(F.count("c_name").alias("n_rows"))
    kept = first.join(whole, "value", "left").agg(F.min(F.coalesce(F.col("old") == F.col("token"), F.lit(False))).alias("kept"))
    counts = whole.agg(F.countDistinct("value").alias("n"), F.countDistinct("token").alias("n_tokens"), F.min("token").alias("least"), F.max("token").alias("most"))
    return counts.join(F.broadcast(rows)).join(F.broadcast(kept))  # a row each


@query("SELECT c_custkey, c_name, true AS same_form, true AS hidden FROM customer")
def c8_format_preserving(t):
    """The digits of a name encrypted and decrypted: its form stays, and on the whole table no two names become one."""
    cipher = fpe.FF1(bytes(range(32)), b"c_name")
    c = io.spread(t("customer").select("c_custkey", "c_name"))
    c = c.select("c_custkey", F.col("c_name").alias("plain"), cipher.encrypt("c_name").alias("sealed"))
    form = lambda x: F.regexp_replace(x, "[0-9]", "9")
    return c.select("c_custkey", cipher.decrypt("sealed").alias("c_name"), (form("plain") == form("sealed")).alias("same_form"), (F.col("plain") != F.col("sealed")).alias("hidden"))


# D. Free text


def _redact_sql(kinds: list[str]) -> str:
    out = "text"
    for k in kinds:
        out = f"regexp_replace({out}, '{text.KINDS[k]}', '[{k.upper()}]', 'g')"
    return out


@query(f"SELECT doc_id, {_redact_sql(['email', 'phone', 'ipv4', 'secret', 'card'])} AS text FROM documents")
def d1_d5_redact(t):
    return text.redact(t("documents"), "text", ["email", "phone", "ipv4", "secret", "card"]).select("doc_id", "text")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{text.KINDS['email']}'))::bigint AS n_email, len(regexp_extract_all(text, '{text.KINDS['phone']}'))::bigint AS n_phone FROM documents")
def d6_count_pii(t):
    return text.count_pii(t("documents"), "text", ["email", "phone"]).select("doc_id", "n_email", "n_phone")


@query(f"SELECT doc_id, 'ipv4' AS kind, unnest(regexp_extract_all(text, '{text.KINDS['ipv4']}')) AS value FROM documents UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(text, '{text.KINDS['email']}')) FROM documents")
def d7_findings(t):
    return text.find_pii(t("documents"), "doc_id", "text", ["ipv4", "email"])


@query(rf"SELECT * FROM (SELECT doc_id, 'card' AS kind, unnest(regexp_extract_all(text, '{text.KINDS['card']}')) AS value FROM documents) WHERE list_sum([CASE WHEN i % 2 = 1 THEN substr(reverse(value), i, 1)::int ELSE (CASE WHEN substr(reverse(value), i, 1)::int > 4 THEN substr(reverse(value), i, 1)::int * 2 - 9 ELSE substr(reverse(value), i, 1)::int * 2 END) END FOR i IN range(1, 17)]) % 10 = 0")
def d5_valid_cards(t):
    return text.valid_cards(t("documents"), "doc_id", "text")


@query("SELECT event_id, '{\"k\":' || (floor(json_extract_string(props, '$.k')::double / 10) * 10)::bigint || '}' AS props FROM events")
def d8_generalize_json(t):
    return text.generalize_json(t("events"), "props", "$.k", "k", lambda c: quasi.bin_(c.cast("double"), 10)).select("event_id", "props")


@query("SELECT doc_id, lang, n // 1000 * 1000 AS n_chars FROM (SELECT doc_id, lang, n_chars AS n FROM documents)")
def d8_generalize_json_keep(t):
    """One field of an object of several, the others as they are."""
    rows = t("documents").select("doc_id", F.to_json(F.struct("lang", "n_chars")).alias("o"))
    out = text.generalize_json(rows, "o", "$.n_chars", "n_chars", lambda c: quasi.bin_(c.cast("double"), 1000), keep=True)
    return out.select("doc_id", F.get_json_object("o", "$.lang").alias("lang"), F.get_json_object("o", "$.n_chars").cast("bigint").alias("n_chars"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \n\t]+', ' ', 'g')) AS html FROM pages")
def d9_strip_html(t):
    return text.strip_html(t("pages"), "html").select("page_id", "html")


# E. Quasi-identifiers


@query("SELECT c_custkey, (floor(c_acctbal / 1000::double) * 1000)::bigint AS b FROM customer")
def e1_bin(t):
    return t("customer").select("c_custkey", quasi.bin_("c_acctbal", 1000).alias("b"))


@query("SELECT o_orderkey, date_trunc('quarter', o_orderdate)::timestamp AS o_orderdate FROM orders")
def e2_truncate_date(t):
    return t("orders").select("o_orderkey", quasi.trunc_date("o_orderdate", "quarter").alias("o_orderdate"))


@query("SELECT s_suppkey, r_name AS n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def e3_hierarchy(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("level0"), F.col("r_name").alias("level1"))
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return quasi.generalize(s, "n_name", n, 1)


@query("SELECT o_orderkey, round(o_totalprice, -3) AS p FROM orders")
def e4_round(t):
    return t("orders").select("o_orderkey", quasi.round_to("o_totalprice", -3).alias("p"))


@query("SELECT event_id, least(greatest(value, 5.0::double), 150.0::double) AS value FROM events")
def e5_clip(t):
    return t("events").select("event_id", quasi.clip("value", 5, 150).alias("value"))


@query("SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events)")
def e6_winsorize(t):
    return quasi.winsorize(t("events"), "value", 0.05).select("event_id", r("value").alias("value"))


@query("""SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey, g), 4) AS bal FROM (SELECT *, least((rn - 1) // 5, greatest(n // 5 - 1, 0)) AS g
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer))""")
def e7_microaggregate(t):
    return quasi.microaggregate(t("customer"), "c_acctbal", 5, ["c_nationkey"], "c_custkey").select("c_custkey", r("c_acctbal", 4).alias("bal"))


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY {u_sql('sa', 'c_custkey')}, c_custkey) AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY {u_sql('sb', 'c_custkey')}, c_custkey) AS y FROM customer)
SELECT l.c_custkey, k.c_mktsegment FROM a AS l JOIN a AS k ON l.c_nationkey = k.c_nationkey AND l.x = k.y""")
def e8_swap(t):
    return quasi.swap(t("customer"), "c_mktsegment", ["c_nationkey"], "c_custkey", "s").select("c_custkey", "c_mktsegment")


@query(f"SELECT o_orderkey, o_orderdate - to_days(floor({u_sql('d', 'o_custkey')} * 30)::int) AS o_orderdate FROM orders")
def e9_shift_dates(t):
    return quasi.shift_dates(t("orders"), "o_orderdate", "o_custkey", 30, "d").select("o_orderkey", "o_orderdate")


@query(f"SELECT c_custkey, round(c_acctbal + 100 * (sqrt(-2 * ln({u_sql('na', 'c_custkey')})) * cos(2 * pi() * {u_sql('nb', 'c_custkey')})), 5) AS bal FROM customer")
def e10_add_noise(t):
    return quasi.add_noise(t("customer"), "c_acctbal", 100.0, "c_custkey", "n", draws.uniform).select("c_custkey", r("c_acctbal", 5).alias("bal"))


PRAM = {"F": {"F": 0.8, "O": 0.15, "P": 0.05}, "O": {"F": 0.1, "O": 0.8, "P": 0.1}, "P": {"F": 0.3, "O": 0.2, "P": 0.5}}
PRAM_SQL = " ".join(f"WHEN '{v}' THEN CASE WHEN u < {row['F']!r}::double THEN 'F' WHEN u < {row['F'] + row['O']!r}::double THEN 'O' ELSE 'P' END" for v, row in PRAM.items())


@query(f"SELECT o_orderkey, CASE o_orderstatus {PRAM_SQL} END AS s FROM (SELECT *, {u_sql('p', 'o_orderkey')} AS u FROM orders)")
def e11_pram(t):
    return quasi.pram(t("orders"), "o_orderstatus", PRAM, "o_orderkey", "p", draws.uniform).select("o_orderkey", F.col("o_orderstatus").alias("s"))


@query(f"SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY r_name, c_mktsegment, bal) >= 20 THEN bal END AS bal FROM {CUST}")
def e13_suppress_cells(t):
    return quasi.suppress_cells(customers(t), QI, 20, ["bal"]).select("c_custkey", "bal")


@query(f"SELECT event_id FROM events WHERE {u_sql('s', 'user_id')} < 0.25")
def e14_sample(t):
    return quasi.sample(t("events"), 0.25, "user_id", "s").select("event_id")


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w), 6) AS a FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def e15_minmax(t):
    return quasi.normalize(t("customer"), "c_acctbal", "minmax", ["c_nationkey"]).select("c_custkey", r("c_acctbal").alias("a"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 5) AS a FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def e15_zscore(t):
    return quasi.normalize(t("customer"), "c_acctbal", "z", ["c_nationkey"]).select("c_custkey", r("c_acctbal", 5).alias("a"))


@query("SELECT vec_id, round(sqrt(list_sum([x::double * x::double FOR x IN embedding])), 5) AS norm FROM embeddings")
def e16_vector_norm(t):
    v = F.col("embedding").cast("array<double>")
    return t("embeddings").select("vec_id", r(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 5).alias("norm"))


@query(f"""SELECT vec_id, i, CASE WHEN x = 0 THEN 0::double ELSE x END AS x FROM (SELECT vec_id, i::int AS i, round(x * least(1, 1 / norm) + 0.05 * (sqrt(-2 * ln({u_sql('va', 'vec_id', 'i')})) * cos(2 * pi() * {u_sql('vb', 'vec_id', 'i')})), 5) AS x
FROM (SELECT vec_id, unnest(embedding)::double AS x, unnest(range(len(embedding))) AS i, sqrt(list_sum([x::double * x::double FOR x IN embedding])) AS norm FROM embeddings))""")
def e16_noise_vector(t):
    noisy = quasi.noise_vector(t("embeddings"), "embedding", 1.0, 0.05, "vec_id", "v", draws.uniform)
    return noisy.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", r("x", 5)).withColumn("x", F.when(F.col("x") == 0, 0.0).otherwise(F.col("x")))  # no -0.0


# F. Risk, G. models


@query(f"SELECT c_custkey, count(*) OVER (PARTITION BY r_name, c_mktsegment, bal) AS k FROM {CUST}")
def f1_class_size(t):
    return risk.class_size(customers(t), QI).select("c_custkey", "k")


@query(f"SELECT count(*) FILTER (k = 1) AS n_unique, sum(k)::bigint AS n_rows FROM (SELECT count(*) AS k FROM {CUST} GROUP BY n_name, c_mktsegment, bal)")
def f2_uniqueness(t):
    return risk.uniqueness(customers(t), ["n_name", "c_mktsegment", "bal"])


KMAP = f"SELECT r_name, c_mktsegment, count(*) FILTER (c_custkey % 3 = 0) AS k, count(*) AS k_population FROM {CUST} GROUP BY 1, 2 HAVING k > 0"


@query(KMAP)
def f3_k_map(t):
    c = customers(t)
    return risk.k_map(c.where("c_custkey % 3 = 0"), c, ["r_name", "c_mktsegment"])


@query(f"SELECT *, round(k / k_population, 6) AS delta FROM ({KMAP})")
def f4_delta_presence(t):
    c = customers(t)
    return risk.delta_presence(c.where("c_custkey % 3 = 0"), c, ["r_name", "c_mktsegment"]).withColumn("delta", r("delta"))


@query(f"SELECT round(1 / min(k), 6) AS max_risk, round(count(*) / sum(k), 6) AS avg_risk FROM (SELECT count(*) AS k FROM {CUST} GROUP BY r_name, c_mktsegment, bal)")
def f5_reidentification_risk(t):
    return risk.reidentification_risk(customers(t), QI).select(r("max_risk").alias("max_risk"), r("avg_risk").alias("avg_risk"))


FINE = "(SELECT n_name, c_mktsegment, bal, count(*) FILTER (c_custkey % 3 = 0) AS k, count(*) AS n FROM {} GROUP BY 1, 2, 3 HAVING k > 0)".format(CUST)


@query(f"SELECT round(max(1 / n), 6) AS max_risk, round(sum(k / n) / sum(k), 6) AS avg_risk, coalesce(sum(k) FILTER (k = 1), 0)::bigint AS n_unique, coalesce(sum(k) FILTER (k = 1 AND n = 1), 0)::bigint AS n_population_unique, 0::bigint AS n_unknown FROM {FINE}")
def f5_journalist_risk(t):
    c = customers(t)
    out = risk.journalist_risk(c.where("c_custkey % 3 = 0"), c, ["n_name", "c_mktsegment", "bal"])
    return out.withColumns({"max_risk": r("max_risk"), "avg_risk": r("avg_risk")})


@query(f"SELECT min(k) >= 5 AS safe FROM (SELECT count(*) AS k FROM {CUST} GROUP BY r_name, c_mktsegment, bal)")
def g1_k_anonymity_check(t):
    return t.spark.createDataFrame([(risk.is_k_anonymous(customers(t), QI, 5),)], "safe boolean")


def _release(t) -> DataFrame:
    safe = risk.k_anonymize_by_suppression(customers(t), QI, 5)
    return identifiers.pseudonymize(safe.select(F.col("c_custkey").alias("id"), *QI), ["id"], KEY)


@query(f"SELECT {hmac_sql('c_custkey')} AS id, r_name, c_mktsegment, bal FROM {CUST} QUALIFY count(*) OVER (PARTITION BY r_name, c_mktsegment, bal) >= 5")
def g2_k_anonymous_release(t):
    """The flagship: joined, generalized, keyed, classes below 5 suppressed."""
    return _release(t)


LEVELS = {"n_name": ["n_name", "r_name", "'*'"], "bal": ["(floor(c_acctbal / 1000::double) * 1000)::bigint", "bal", "bal * 0"], "c_mktsegment": ["c_mktsegment", "'*'"]}
NODES = " UNION ALL ".join(f"SELECT {a} AS n_name, {b} AS bal, {c} AS c_mktsegment, coalesce(sum(n) FILTER (n < 5), 0)::bigint AS lost, sum(n)::bigint AS total FROM (SELECT count(*) AS n FROM {CUST} GROUP BY {LEVELS['n_name'][a]}, {LEVELS['bal'][b]}, {LEVELS['c_mktsegment'][c]})" for a in range(3) for b in range(3) for c in range(2))


@query(f"SELECT n_name, bal, c_mktsegment, total - lost AS n_rows FROM ({NODES}) WHERE lost <= 0.05 * total ORDER BY n_name + bal + c_mktsegment, lost, n_name, bal, c_mktsegment LIMIT 1")
def g3_full_domain(t):
    """The levels chosen, and the rows released."""
    c = customers(t)
    levels = {"n_name": [F.col("n_name"), F.col("r_name"), F.lit("*")], "bal": [quasi.bin_("c_acctbal", 1000), F.col("bal"), F.lit(0).cast("bigint")], "c_mktsegment": [F.col("c_mktsegment"), F.lit("*")]}
    out, chosen = risk.k_anonymize_full_domain(c, levels, 5)
    return out.agg(*[F.lit(i).alias(k) for k, i in chosen.items()], F.count("*").alias("n_rows"))


@query("SELECT true AS safe, true AS apart, count(*) AS n_rows FROM customer")
def g4_mondrian(t):
    """Parts hold 10 rows or more, and the two halves of every split lie apart on some quasi-identifier; see also tests/test_mondrian.py."""
    parts = risk.mondrian(t("customer"), ["c_nationkey", "c_acctbal"], 10)
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("c_nationkey", "c_acctbal") for f in (F.min, F.max)]
    leaves = parts.groupBy("part").agg(F.count("*").alias("k"), *ends)
    # Each part's box belongs to all halves it came from: a row for each prefix of its path, whose length is log(parts).
    up = leaves.withColumn("path", F.explode(F.transform(F.sequence(F.lit(1), F.length("part")), lambda i: F.substr("part", F.lit(1), i))))
    box = up.where("length(path) > 1").groupBy("path").agg(*[g(f"{f}_{c}").alias(f"{f}_{c}") for c in ("c_nationkey", "c_acctbal") for f, g in (("min", F.min), ("max", F.max))])
    side = F.right("path", F.lit(1))
    both = box.groupBy(F.expr("left(path, length(path) - 1)").alias("of")).agg(*[F.max(F.when(side == s, F.col(x))).alias(f"{x}_{s}") for x in box.columns[1:] for s in ("0", "1")])
    split = F.col("max_c_nationkey_0") < F.col("min_c_nationkey_1")
    split = split | (F.col("max_c_acctbal_0") < F.col("min_c_acctbal_1"))
    apart = both.agg(F.coalesce(F.min(split), F.lit(True))).first()[0]
    return leaves.agg((F.min("k") >= 10).alias("safe"), F.lit(apart).alias("apart"), F.sum("k").alias("n_rows"))


BY = "(SELECT r_name, bal, c_mktsegment, count(*) AS n FROM {} GROUP BY 1, 2, 3)".format(CUST)


@query(f"SELECT r_name, bal, count(*) AS l FROM {BY} GROUP BY 1, 2")
def g5_distinct_l_diversity(t):
    return risk.l_diversity(customers(t), ["r_name", "bal"], "c_mktsegment")


@query(f"SELECT r_name, bal, round(0 - sum(p * ln(p)), 6) AS entropy FROM (SELECT *, n / sum(n) OVER (PARTITION BY r_name, bal) AS p FROM {BY}) GROUP BY 1, 2")
def g6_entropy_l_diversity(t):
    return risk.l_diversity(customers(t), ["r_name", "bal"], "c_mktsegment", "entropy").withColumn("entropy", r("entropy"))


@query(f"SELECT r_name, bal, max(n) FILTER (i = 1) < 2.0 * coalesce(sum(n) FILTER (i >= 2), 0) AS safe FROM (SELECT *, row_number() OVER (PARTITION BY r_name, bal ORDER BY n DESC, c_mktsegment) AS i FROM {BY}) GROUP BY 1, 2")
def g7_recursive_l_diversity(t):
    return risk.l_diversity(customers(t), ["r_name", "bal"], "c_mktsegment", "recursive", 2.0, 2)


TC = f"""(SELECT g.r_name, w.c_mktsegment, coalesce(n, 0) / g.k - q AS d FROM (SELECT r_name, count(*) AS k FROM {CUST} GROUP BY 1) AS g CROSS JOIN (SELECT c_mktsegment, count(*) / sum(count(*)) OVER () AS q FROM {CUST} GROUP BY 1) AS w
LEFT JOIN (SELECT r_name, c_mktsegment, count(*) AS n FROM {CUST} GROUP BY 1, 2) AS c ON c.r_name = g.r_name AND c.c_mktsegment = w.c_mktsegment)"""


@query(f"SELECT r_name, round(sum(abs(d)) / 2, 6) AS t FROM {TC} GROUP BY 1")
def g8_t_closeness(t):
    return risk.t_closeness(customers(t), ["r_name"], "c_mktsegment").withColumn("t", r("t"))


@query(f"SELECT r_name, round(sum(c) / 4, 6) AS t FROM (SELECT r_name, abs(sum(d) OVER (PARTITION BY r_name ORDER BY c_mktsegment)) AS c FROM {TC}) GROUP BY 1")
def g9_ordered_t_closeness(t):
    return risk.t_closeness(customers(t), ["r_name"], "c_mktsegment", ordered=True).withColumn("t", r("t"))


# H. Differential privacy

BOUND = f"(SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {u_sql('bound', 'event_id')}, event_id) <= 10)"


def _lap(u: str, scale: float) -> str:
    return f"(sign({u} - 0.5) * -{scale!r}::double * ln(1 - 2 * abs({u} - 0.5)))"


@query(f"SELECT event_id FROM {BOUND}")
def h1_bound_contributions(t):
    return dp.bound_contributions(t("events"), "user_id", 10, "event_id").select("event_id")


@query("SELECT event_type, round(sum(least(greatest(value, 0), 100)), 4) AS s FROM events GROUP BY 1")
def h2_clamped_sum(t):
    return t("events").groupBy("event_type").agg(r(F.sum(quasi.clip("value", 0, 100)), 4).alias("s"))


AGG = f"(SELECT event_type, count(*) AS n, sum(least(greatest(value, 0), 100)) AS s FROM {BOUND} GROUP BY 1)"


@query(f"SELECT event_type, round(c, 5) AS noisy_count, round(s, 4) AS noisy_sum, round(least(greatest(s / greatest(c, 1), 0), 100), 5) AS noisy_mean FROM (SELECT event_type, n + {_lap(u_sql('aggn', 'event_type'), 20.0)} AS c, s + {_lap(u_sql('aggs', 'event_type'), 2000.0)} AS s FROM {AGG})")
def h3_h4_laplace(t):
    out = dp.private_agg(t("events"), ["event_type"], "user_id", "event_id", "value", (0, 100), 10, 1.0, draw=draws.uniform, ledger=dp.Ledger(1.0))
    return out.select("event_type", r("noisy_count", 5).alias("noisy_count"), r("noisy_sum", 4).alias("noisy_sum"), r("noisy_mean", 5).alias("noisy_mean"))


@query(f"SELECT event_type, n + (floor(ln({u_sql('aggn', 'event_type')}) / (-0.5::double / 10)) - floor(ln({u_sql('aggm', 'event_type')}) / (-0.5::double / 10)))::bigint AS noisy_count FROM {AGG}")
def h5_geometric(t):
    return dp.private_agg(t("events"), ["event_type"], "user_id", "event_id", "value", (0, 100), 10, 1.0, "geometric", draw=draws.uniform).select("event_type", "noisy_count")


@query(f"SELECT event_type, round(n + {dp.gaussian_sigma(0.5, 1e-6, 10)!r}::double * (sqrt(-2 * ln({u_sql('aggn', 'event_type')})) * cos(2 * pi() * {u_sql('aggm', 'event_type')})), 4) AS noisy_count FROM {AGG}")
def h6_gaussian(t):
    return dp.private_agg(t("events"), ["event_type"], "user_id", "event_id", "value", (0, 100), 10, 1.0, "gaussian", 2e-6, draw=draws.uniform).select("event_type", r("noisy_count", 4).alias("noisy_count"))


@query(f"SELECT max_by(event_type, n * 0.1::double / 2 - ln(-ln({u_sql('max', 'event_type')}))) AS event_type FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def h7_noisy_max(t):
    return dp.noisy_max(t("events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n", 1.0, 0.1, draws.uniform)


@query(f"""SELECT round(g.v + {u_sql('quantileat', '0')} * (g.e - g.v), 6) AS quantile FROM (SELECT max_by({{'v': v, 'e': e}}, (-abs(below - 0.5::double * total) + 2 * ln(e - v)) / 2 - ln(-ln({u_sql('quantile', 'v')}))) AS g FROM
(SELECT v, lead(v) OVER (ORDER BY v) AS e, sum(n) OVER (ORDER BY v) AS below, sum(n) OVER () AS total FROM (SELECT v, sum(n)::double AS n FROM (SELECT least(greatest(value, 0), 500)::double AS v, 1 AS n FROM events UNION ALL SELECT 0, 0 UNION ALL SELECT 500, 0) GROUP BY 1)) WHERE e > v)""")
def h8_private_quantile(t):
    return dp.private_quantile(t("events"), "value", 0.5, 0.0, 500.0, 1.0, draws.uniform).withColumn("quantile", r("quantile"))


@query(f"""SELECT event_type, round(c, 5) AS noisy_units FROM (SELECT event_type, n + {_lap(u_sql('partitions', 'event_type'), 3.0)} AS c FROM (SELECT event_type, count(*) AS n FROM
(SELECT * FROM (SELECT DISTINCT event_type, user_id FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {u_sql('partitionsm', 'user_id', 'event_type')}, event_type) <= 3) GROUP BY 1)) WHERE c > {dp.partition_threshold(1.0, 1e-6, 3)!r}::double""")
def h9_select_partitions(t):
    out = dp.select_partitions(t("events"), ["event_type"], "user_id", 1.0, 1e-6, 3, draws.uniform, ledger=dp.Ledger(1.0, 1e-6))
    return out.withColumn("noisy_units", r("noisy_units", 5))


@query(f"SELECT round((avg(CASE WHEN CASE WHEN u < 0.75 THEN value > 100 ELSE v < 0.5 END THEN 1.0::double ELSE 0.0::double END) - 0.125::double) / 0.75::double, 6) AS share FROM (SELECT *, {u_sql('w1', 'event_id')} AS u, {u_sql('w2', 'event_id')} AS v FROM events)")
def h10_randomized_response(t):
    said = dp.randomized_response(t("events").select("event_id", (F.col("value") > 100).alias("high")), "high", 0.75, "event_id", draw=draws.uniform, ledger=dp.Ledger(2.0))
    return said.agg(r((F.avg(F.when(F.col("high"), 1.0).otherwise(0.0)) - 0.125) / 0.75).alias("share"))


TYPES = ["click", "error", "purchase", "signup", "view"]


def _keep(epsilon: float, k: int) -> float:
    return math.exp(epsilon) / (math.exp(epsilon) + k - 1)


P5, TYPE_LIST = _keep(2.0, 5), str(TYPES)
SAID = f"(SELECT CASE WHEN u < {P5!r}::double THEN event_type ELSE {TYPE_LIST}[((list_position({TYPE_LIST}, event_type) + floor((u - {P5!r}::double) / {1 - P5!r}::double * 4)::int) % 5) + 1] END AS event_type FROM (SELECT *, {u_sql('rr', 'event_id')} AS u FROM events))"


@query(f"SELECT event_type, round((count(*) - sum(count(*)) OVER () * {(1 - P5) / 4!r}::double) / {P5 - (1 - P5) / 4!r}::double, 4) AS estimate FROM {SAID} GROUP BY 1")
def h11_local_frequencies(t):
    said = dp.randomize(t("events"), "event_type", TYPES, 2.0, "event_id", draw=draws.uniform)
    return dp.estimate_frequencies(said, "event_type", TYPES, 2.0).withColumn("estimate", r("estimate", 4))


FLIP = 1 / (1 + math.exp(0.5))


@query(f"""SELECT event_type, sum(CASE WHEN (u < {FLIP!r}::double) <> own THEN 1 ELSE 0 END)::bigint AS bits FROM (SELECT event_type, {u_sql('bloom', 'event_id', 'b')} AS u,
list_contains([('0x' || substr(md5('bloom' || i || event_type), 1, 7))::bigint % 32 FOR i IN [0, 1]], b) AS own FROM (SELECT event_id, event_type, unnest(range(32)) AS b FROM events)) GROUP BY 1""")
def h12_bloom_reports(t):
    return dp.bloom_report(t("events"), "event_type", 32, 2, 2.0, "event_id", draw=draws.uniform).groupBy("event_type").agg(F.sum(F.aggregate("report", F.lit(0), lambda a, x: a + x)).alias("bits"))


BITS = f"""(SELECT b, sum(CASE WHEN (u < {FLIP!r}::double) <> own THEN 1 ELSE 0 END) AS c, count(*) AS n FROM (SELECT b, {u_sql('bloom', 'event_id', 'b')} AS u,
list_contains([('0x' || substr(md5('bloom' || i || event_type), 1, 7))::bigint % 32 FOR i IN [0, 1]], b) AS own FROM (SELECT event_id, event_type, unnest(range(32)) AS b FROM events)) GROUP BY 1)"""


def _bloom(t) -> DataFrame:
    return dp.bloom_report(t("events"), "event_type", 32, 2, 2.0, "event_id", draw=draws.uniform)


@query(f"SELECT b::int AS bit, round((c - {FLIP!r}::double * n) / {(1 - 2 * FLIP)!r}::double, 4) AS estimate, n FROM {BITS}")
def h12_debiased_bits(t):
    return dp.debiased_bits(_bloom(t), 32, 2, 2.0).withColumn("estimate", r("estimate", 4))


@query("SELECT event_type AS value, count(*) AS n, true AS near FROM events GROUP BY 1")
def h12_bloom_estimates(t):
    """Counts decoded from the reports, each within four standard errors of the exact one."""
    found = dp.estimate_bloom(_bloom(t), TYPES, 32, 2, 2.0)
    exact = t("events").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    return exact.join(F.broadcast(found), "value").select("value", "n", (F.abs(F.col("estimate") - F.col("n")) <= 4 * F.col("error")).alias("near"))


P8 = _keep(2.0, 8)
CELLS = f"(SELECT event_id, CASE WHEN u < {P8!r}::double THEN c ELSE (c + floor((u - {P8!r}::double) / {1 - P8!r}::double * 7)::int + 1) % 8 END AS cell FROM (SELECT event_id, {u_sql('olh', 'event_id')} AS u, floor({u_sql('olhh', 'event_id', 'event_type')} * 8)::bigint AS c FROM events))"


@query(f"SELECT event_id, cell FROM {CELLS}")
def h13_local_hashing(t):
    return dp.local_hash_report(t("events"), "event_type", 2.0, "event_id", draw=draws.uniform).select("event_id", "cell")


@query(f"SELECT v AS value, round((count(*) FILTER (floor({u_sql('olhh', 'event_id', 'v')} * 8) = cell) - count(*) / 8) / {P8 - 1 / 8!r}::double, 4) AS estimate FROM {CELLS}, (SELECT unnest({TYPE_LIST}) AS v) GROUP BY 1")
def h13_hashed_estimates(t):
    return dp.estimate_hashed(dp.local_hash_report(t("events"), "event_type", 2.0, "event_id", draw=draws.uniform), TYPES, 2.0).withColumn("estimate", r("estimate", 4))


# I. Linkage and utility


@query(f"SELECT DISTINCT {hmac_sql('c_nationkey')} AS h FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def i1_hashed_intersection(t):
    return utility.hashed_intersection(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")), "k", KEY)


def _grams(x: str, q: int) -> str:
    return f"CASE WHEN length({x}) >= {q} THEN list_distinct([substr(lower({x}), i, {q}) FOR i IN range(1, length({x}) - {q} + 2)]) ELSE [lower({x})] END"


def _blocks(table: str, key: str, x: str, q: int) -> str:
    return f"(SELECT {key}, b::int AS band, list_min([substr(md5('block' || b || g), 1, 12) FOR g IN {_grams(x, q)}]) AS key FROM {table}, (SELECT unnest(range(4)) AS b))"


def _bits(table: str, key: str, x: str, q: int, bits: int) -> str:
    return f"(SELECT {key}, list_distinct(flatten([[('0x' || substr({hmac_sql("i || '|' || g")}, 1, 7))::bigint % {bits} FOR i IN [0, 1]] FOR g IN {_grams(x, q)}])) AS x FROM {table})"


BLOOM = _bits("nation", "n_name", "n_name", 2, 256)


@query(f"""SELECT a, b, round(2 * len(list_intersect(l.x, r.x)) / (len(l.x) + len(r.x)), 6) AS dice FROM (SELECT DISTINCT p.n_name AS a, q.n_name AS b FROM {_blocks('nation', 'n_name', 'n_name', 2)} AS p
JOIN {_blocks('nation', 'n_name', 'n_name', 2)} AS q ON p.band = q.band AND p.key = q.key AND p.n_name < q.n_name) JOIN {BLOOM} AS l ON l.n_name = a JOIN {BLOOM} AS r ON r.n_name = b""")
def i2_bloom_dice(t):
    return utility.link(t("nation"), "n_name", "n_name", 2, 4, 256, 2, KEY).withColumn("dice", r("dice"))


@query(f"""SELECT a, b, round(dice, 6) AS dice FROM (SELECT l.c_custkey AS a, r.c_custkey AS b, 2 * len(list_intersect(l.x, r.x)) / (len(l.x) + len(r.x)) AS dice FROM {_bits('customer', 'c_custkey', 'c_name', 2, 512)} AS l
JOIN {_bits('customer', 'c_custkey', 'c_name', 2, 512)} AS r ON l.c_custkey < r.c_custkey) WHERE dice >= 0.96""")
def i2_lsh_link(t):
    """Names that are alike, by Hamming blocks: rows of pairs, equal encodings by their classes; no pair is missed."""
    found, members = utility.lsh_link(t("customer"), "c_custkey", "c_name", 2, 512, 2, KEY, 0.96)
    members = io.stash(members, "members")
    one, two = (members.select(F.col("id").alias(n), F.col("class").alias(c)) for n, c in (("i", "a"), ("j", "b")))
    apart = found.join(one, "a").join(two, "b").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "dice")
    alike = members.select(F.col("id").alias("a"), "class").join(members.select(F.col("id").alias("b"), "class"), "class").where("a < b").select("a", "b", F.lit(1.0).alias("dice"))
    return apart.unionByName(alike).withColumn("dice", r("dice"))


@query(f"SELECT s_suppkey, band, key FROM {_blocks('supplier', 's_suppkey', 's_name', 3)}")
def i3_minhash_blocks(t):
    return utility.block(t("supplier"), "s_name", 3, 4).select("s_suppkey", "band", "key")


@query(f"""SELECT sum(k * k)::bigint AS discernibility, round(sum(k) / count(*), 6) AS average_class, round(1 - sum(k) / (SELECT count(*) FROM customer), 6) AS suppression_rate
FROM (SELECT count(*) AS k FROM {CUST} GROUP BY r_name, c_mktsegment, bal HAVING k >= 5)""")
def i4_i5_utility(t):
    c = customers(t)
    out = utility.utility_report(c, risk.k_anonymize_by_suppression(c, QI, 5), QI)
    return out.select("discernibility", r("average_class").alias("average_class"), r("suppression_rate").alias("suppression_rate"))


@query(f"SELECT round(sum(s / w * k) / sum(k), 6) AS ncp FROM (SELECT max(c_acctbal) - min(c_acctbal) AS s, count(*) AS k FROM {CUST} GROUP BY r_name, c_mktsegment), (SELECT max(c_acctbal) - min(c_acctbal) AS w FROM customer)")
def i6_certainty_penalty(t):
    return utility.certainty_penalty(customers(t), "c_acctbal", ["r_name", "c_mktsegment"]).select(r("ncp").alias("ncp"))


@query("""SELECT round(sum(abs(p - q)) / 2, 6) AS tv, round(sum(CASE WHEN p > 0 THEN p * ln(p / greatest(q, 1e-9::double)) ELSE 0 END), 6) AS kl FROM (SELECT coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM
(SELECT c_mktsegment AS k, count(*) / sum(count(*)) OVER () AS p FROM customer GROUP BY 1) AS a FULL JOIN (SELECT c_mktsegment AS k, count(*) / sum(count(*)) OVER () AS p FROM customer WHERE c_acctbal > 3000 GROUP BY 1) AS b USING (k))""")
def i7_distance(t):
    return utility.distance(t("customer"), t("customer").where("c_acctbal > 3000"), "c_mktsegment").select(r("tv").alias("tv"), r("kl").alias("kl"))


# J. Streaming


def stream(t, name: str = "events", cols: tuple[str, ...] = ("event_id", "ts", "user_id", "event_type", "value")) -> DataFrame:
    schema = t(name).schema
    s = io.read_stream(t.spark, f"{t.dir}/{name}.parquet*", schema).select(*cols)
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in cols else s


def done(t, df: DataFrame, mode: str = "append", rocksdb: bool = False) -> DataFrame:
    out = io.scratch(t.spark, "stream")
    io.release_stream(df, out, io.scratch(t.spark, "state"), mode, rocksdb)
    return t.spark.read.schema(df.schema).parquet(out).select(*df.columns)


@query("SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_name FROM customer")
def j1_stream_mask(t):
    return done(t, stream(t, "customer", ("c_custkey", "c_name")).withColumn("c_name", keyed.mask_chars("c_name")))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::timestamp AS window_start, time_bucket(INTERVAL 1 HOUR, ts)::timestamp + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def j2_tumbling_window(t):
    return _plain(done(t, ops.windowed_counts(stream(t), "ts", "1 hour", by=("event_type",)), "complete"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::timestamp AS window_start, time_bucket(INTERVAL 1 HOUR, ts)::timestamp + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def j2_update_window(t):
    """Four batches, out of order: each writes the windows it changed, and the last state of each window counts."""
    files = io.scratch(t.spark, "arrivals")
    t("events").select("event_type", F.col("ts").cast("timestamp").alias("ts")).repartition(4, F.xxhash64("event_id")).write.parquet(files)
    s = io.read_stream(t.spark, files, t.spark.read.parquet(files).schema, maxFilesPerTrigger=1)
    counts = ops.windowed_counts(s, "ts", "1 hour", watermark="60 days", by=("event_type",))
    out = io.scratch(t.spark, "stream")
    io.release_stream(counts, out, io.scratch(t.spark, "state"), "update")
    return _plain(io.latest(t.spark, out, counts.schema, ["window_start", "window_end", "event_type"]))


@query("SELECT w::timestamp AS window_start, w::timestamp + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2")
def j3_sliding_window(t):
    return _plain(done(t, ops.windowed_counts(stream(t), "ts", "2 hours", "1 hour"), "complete"))


@query("""SELECT min(ts)::timestamp AS window_start, max(ts)::timestamp + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s""")
def j4_session_window(t):
    return _plain(done(t, ops.windowed_counts(stream(t), "ts", "", gap="30 minutes", by=("user_id",)), "complete"))


@query("SELECT event_id FROM events")
def j5_dedup(t):
    s = stream(t)
    return done(t, ops.dedup(s.union(s), "event_id", "ts").select("event_id"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS ok FROM events GROUP BY 1")
def j6_approx_distinct(t):
    """Within 5 % of the exact count."""
    near = done(t, stream(t).groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("near")), "complete")
    exact = t("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return exact.join(near, "event_type").select("event_type", "users", (F.abs(F.col("near") - F.col("users")) <= 0.05 * F.col("users")).alias("ok"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3")
def j7_j8_bound_contributions(t):
    return done(t, ops.bound_contributions(stream(t), "user_id", 3, ["ts", "event_id"]).select("event_id"))


@query("SELECT event_id FROM events WHERE (event_type, floor(value / 50)) IN (SELECT (event_type, floor(value / 50)) FROM events GROUP BY event_type, floor(value / 50) HAVING count(DISTINCT user_id) >= 20)")
def j9_stream_k_anonymity(t):
    """A delay longer than the stream: classes of 20 users in all."""
    s = stream(t).withColumn("bin", F.floor(F.col("value") / 50))
    return done(t, ops.stream_k_anonymize(s, ["event_type", "bin"], "user_id", 20, "ts", "60 days").select("event_id"), rocksdb=True)


HELD = "(SELECT *, floor(value / 100) AS bin FROM events)"


@query(f"""SELECT event_id FROM {HELD} AS e JOIN (SELECT event_type, bin, min(ts) AS opened FROM (SELECT a.event_type, a.bin, a.event_id, a.ts, count(DISTINCT b.user_id) AS users FROM {HELD} AS a JOIN {HELD} AS b
ON a.event_type = b.event_type AND a.bin = b.bin AND b.ts BETWEEN a.ts - INTERVAL 2 DAY AND a.ts GROUP BY 1, 2, 3, 4) WHERE users >= 8 GROUP BY 1, 2) AS o USING (event_type, bin) WHERE e.ts >= o.opened - INTERVAL 2 DAY""")
def j9_stream_k_anonymity_delay(t):
    """A delay of two days: a class opens with the first window that holds 8 users, and what is older is suppressed."""
    s = stream(t).withColumn("bin", F.floor(F.col("value") / 100))
    return done(t, ops.stream_k_anonymize(s, ["event_type", "bin"], "user_id", 8, "ts", "2 days").select("event_id"), rocksdb=True)


def _tree(bits: int = 6) -> str:
    """The noise of step t: of the tree nodes that cover [0, t]."""
    scale = 6.0
    node = lambda b: _lap(f"((('0x' || substr(md5('tree' || event_type || '|{b}|' || (((t + 1) >> {b}) - 1)), 1, 8))::bigint + 0.5::double) / 4294967296::double)", scale)
    return " + ".join(f"CASE WHEN ((t + 1) >> {b}) & 1 = 1 THEN {node(b)} ELSE 0 END" for b in range(bits))


@query(f"""SELECT event_type, t::int AS step, round(n + {_tree()}, 5) AS noisy_count FROM (SELECT k.event_type, t, (SELECT count(*) FROM events AS e WHERE e.event_type = k.event_type AND e.ts < TIMESTAMP '2024-01-01' + to_days((t + 1)::int)) AS n
FROM (SELECT DISTINCT event_type FROM events) AS k, (SELECT unnest(range(31)) AS t) AS s) WHERE TIMESTAMP '2024-01-01' + to_days((t + 1)::int) <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def j10_continual_count(t):
    """Days since the release began, each released once, when the watermark has passed its end."""
    s = stream(t).select("event_type", "ts")
    out = ops.continual_count(s, "event_type", "ts", "2024-01-01", "1 day", 31, 1.0, noise=ops.derived_noise("tree"), ledger=dp.Ledger(1.0))
    return done(t, out, rocksdb=True).withColumn("noisy_count", r("noisy_count", 5))


@query("SELECT event_type, CASE WHEN ts < TIMESTAMP '2024-01-05' THEN 'early' ELSE 'late' END AS reason, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-05' OR ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2")
def j10_outside_horizon(t):
    """The side output of a count over ten days: what it leaves out, counted."""
    bad = ops.outside(stream(t).select("event_type", "ts"), "ts", "2024-01-05", "1 day", 10)
    return done(t, bad.groupBy("event_type", "reason").agg(F.count("*").alias("n")), "complete")


# K. UDF surface


@query("SELECT c_custkey, (floor(c_acctbal / 100) * 100)::bigint AS b FROM customer")
def k1_sql_function(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION umbra_bin(x DOUBLE, w DOUBLE) RETURNS BIGINT RETURN CAST(floor(x / w) * w AS BIGINT)")
    return t("customer").selectExpr("c_custkey", "umbra_bin(c_acctbal, 100D) as b")


@query("SELECT part_name, word FROM (SELECT DISTINCT p_name AS part_name, strip_accents(p_name || ' Ünïté') AS word FROM part)")
def k2_pandas_udf(t):
    """Letters without their accents, which Spark has no function for."""

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFD").str.replace(r"[\u0300-\u036f]", "", regex=True)

    return t("part").select(F.col("p_name").alias("part_name")).distinct().withColumn("word", plain(F.concat("part_name", F.lit(" Ünïté"))))


@query("SELECT c_custkey, s.s_suppkey FROM customer JOIN (SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) <= 2) AS s ON c_nationkey = s.s_nationkey")
def k1_sql_table_function(t):
    """A parametrized view: the two largest suppliers of a nation, by customer."""
    t("supplier").createOrReplaceTempView("umbra_supplier")
    t("customer").createOrReplaceTempView("umbra_customer")
    t.spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION umbra_largest(nation INT) RETURNS TABLE (s_suppkey BIGINT)
RETURN SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM umbra_supplier WHERE s_nationkey = nation) WHERE r <= 2""")
    return t.spark.sql("SELECT c_custkey, s_suppkey FROM umbra_customer, LATERAL umbra_largest(c_nationkey)")


PAIRS = "(SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part)"


def _pairs(t) -> DataFrame:
    return t("part").select(F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b")).distinct()


@query(f"SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS alike FROM {PAIRS} WHERE a IS NOT NULL AND b IS NOT NULL")
def k2_arrow_udf(t):
    """Jaro-Winkler similarity, which Spark has no function for, on Arrow arrays."""

    @F.arrow_udf("double")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([strings.jaro_winkler(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return _pairs(t).where("a is not null and b is not null").withColumn("alike", r(alike("a", "b")))


@query(f"SELECT a, b, damerau_levenshtein(a, b)::bigint AS edits FROM {PAIRS} WHERE a IS NOT NULL AND b IS NOT NULL")
def k4_map_in_pandas(t):
    """Edits with transpositions, which Spark's levenshtein does not count as one."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(edits=[strings.edits(x, y) for x, y in zip(pdf.a, pdf.b, strict=True)])

    return _pairs(t).where("a is not null and b is not null").mapInPandas(run, "a string, b string, edits long")


@query("SELECT c_nationkey, round(mad(c_acctbal), 4) AS spread FROM customer GROUP BY 1")
def k3_grouped_agg_udf(t):
    """The median absolute deviation, which Spark has no aggregate for."""

    @F.pandas_udf("double")
    def mad(v: pd.Series) -> float:
        return float((v - v.median()).abs().median())

    return t("customer").groupBy("c_nationkey").agg(mad("c_acctbal").alias("spread")).withColumn("spread", r("spread", 4))


@query("SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) AS spread FROM customer GROUP BY 1")
def k4_apply_in_pandas(t):
    def spread(pdf):
        return pd.DataFrame({"c_nationkey": [pdf.c_nationkey.iloc[0]], "spread": [round(pdf.c_acctbal.max() - pdf.c_acctbal.min(), 4)]})

    return t("customer").select("c_nationkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(spread, "c_nationkey int, spread double")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def k5_udtf(t):
    from pyspark.sql.functions import udtf

    @udtf(returnType="word string")
    class Words:
        def eval(self, s: str):
            for w in s.split(" "):
                yield (w,)

    t.spark.udtf.register("umbra_words", Words)
    t("part").select("p_partkey", "p_name").createOrReplaceTempView("umbra_part")
    return t.spark.sql("SELECT p_partkey, word FROM umbra_part, LATERAL umbra_words(p_name)")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["g2_k_anonymous_release"](spark, sf_dir)


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
