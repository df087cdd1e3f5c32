"""linq, dialect, sources, operators and streams on small literal inputs."""

import datetime
import decimal
import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from veldt import catalog
from veldt.functions.aggregates import aggregate, exact_sum, text_sum
from veldt.functions.dialect import to_spark_sql
from veldt.functions.scalar import call
from veldt.operators import changes, joins, relational
from veldt.session import Catalog, linq
from veldt.sources.tables import from_files, from_rest, from_rows, save, save_bucketed
from veldt.streaming.stateless import run_once, stream_files

USERS = [{"id": 1, "name": "John", "age": 11}, {"id": 2, "name": "Steve", "age": 12}, {"id": 3, "name": "David", "age": 10}, {"id": 4, "name": "Alex", "age": 9}]
ACCOUNTS = [{"id": 1, "user_id": 1, "amount": 12000}, {"id": 3, "user_id": 3, "amount": 1000}, {"id": 4, "user_id": 4, "amount": 0}, {"id": 5, "user_id": 3, "amount": 1000}]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_linq_joins_lists(spark):
    text = "SELECT u.id, a.id AS account FROM {users} u {kind} JOIN {accounts} a ON u.id = a.user_id"
    assert rows(linq(text.replace("{kind}", ""), spark=spark, users=USERS, accounts=ACCOUNTS)) == [(1, 1), (3, 3), (3, 5), (4, 4)]
    assert (2, None) in rows(linq(text.replace("{kind}", "LEFT"), spark=spark, users=USERS, accounts=ACCOUNTS))
    assert rows(linq("SELECT a.id FROM {users} u JOIN {accounts} a ON u.id = a.user_id AND u.id = :who", {"who": 3}, spark=spark, users=USERS, accounts=ACCOUNTS)) == [(3,), (5,)]


def test_parameters_are_values(spark):
    assert rows(linq("SELECT :x AS x", {"x": "' OR 1=1 --"}, spark=spark)) == [("' OR 1=1 --",)]


def test_rows_with_gaps_and_none(spark):
    df = from_rows(spark, [{"a": 1}, {"b": "x", "a": 2}])
    assert df.columns == ["a", "b"] and rows(df) == [(1, None), (2, "x")]
    with pytest.raises(ValueError):
        from_rows(spark, [])
    assert from_rows(spark, [], "a int").count() == 0


def test_short_list_is_broadcast(spark, tmp_path):
    """Else the other side, beyond the limit, is dealt by the few keys of the list."""
    spark.range(1000).selectExpr("CAST(id % 3 AS STRING) AS code").write.parquet(f"{tmp_path}/many")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "256")
    try:
        df = linq("SELECT l.name, COUNT(*) AS n FROM {few} l JOIN {many} m ON m.code = l.code GROUP BY l.name", spark=spark, few=[{"code": "0", "name": "none"}, {"code": "2", "name": "two"}], many=f"{tmp_path}/many")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert rows(df) == [("none", 334), ("two", 333)] and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset(limit)


def test_list_keeps_its_types(spark):
    full = {"i": 1, "f": 0.5, "b": True, "s": "é", "raw": bytearray(b"\x00\xff"), "d": datetime.date(1582, 10, 4), "t": datetime.datetime(2020, 2, 29, 1, 2, 3, 4), "m": decimal.Decimal("1.50"), "a": [1, None], "o": {"k": None}, "r": Row(x=1, y=Row(z="w")), "gap": datetime.timedelta(days=1, microseconds=5)}
    kind = "i long, f double, b boolean, s string, raw binary, d date, t timestamp, m decimal(10,2), a array<long>, o map<string,string>, r struct<x:long,y:struct<z:string>>, gap interval day to second, none void"
    plain = spark.createDataFrame([tuple({**full, "none": None}.values()), (None,) * 13], kind)
    df = from_rows(spark, [full, {}], kind)
    assert df.schema == plain.schema and df.collect() == plain.collect()
    guessed = from_rows(spark, [{k: v for k, v in full.items() if k != "o"}, {"i": 2}])
    assert guessed.columns == [k for k in full if k != "o"] and guessed.select("r", "gap").collect() == [(full["r"], full["gap"]), (None, None)]
    many = [{"i": i} for i in range(10_001)]
    assert from_rows(spark, many).count() == 10_001 and from_rows(spark, many[:10_000]).agg(F.sum("i")).first()[0] == 49_995_000


@pytest.mark.parametrize(
    "text, result",
    [
        ("SELECT 17 MOD 5 AS x", 2),
        ("SELECT 17 DIV 5 AS x", 3),
        ("SELECT MOD(17, 5) AS x", 2),
        ("SELECT 'a MOD b' AS x", "a MOD b"),
        ("SELECT NULL IS NULL AS x", True),
        ("SELECT 1 IS 1 AS x", True),
        ("SELECT 1 IS NOT 2 AS x", True),
        ("SELECT NULL IS 1 AS x", False),
        ("SELECT 3 > ALL (SELECT 1 UNION ALL SELECT NULL) AS x", None),
        ("SELECT 3 > ANY (SELECT 1 UNION ALL SELECT NULL) AS x", True),
        ("SELECT 0 > ANY (SELECT 1 UNION ALL SELECT NULL) AS x", None),
        ("SELECT 3 > ALL (SELECT 1 WHERE false) AS x", True),
        ("SELECT 3 = ANY (SELECT 1 WHERE false) AS x", False),
        ("SELECT year(ADDDATE(DATE '2020-02-28', INTERVAL 2 DAY)) * 100 + month(ADDDATE(DATE '2020-02-28', INTERVAL 2 DAY)) AS x", 202003),
        ("SELECT hex(BINARY 'a') AS x", "61"),
        ("SELECT 1 + 2 AS x", 3),
        ("SELECT NOT TRUE AS x", False),
        ("SELECT 1.5 + NULL AS x", None),
        ("SELECT TRUE AND NULL AND FALSE AS x", False),
        ("SELECT NULL OR FALSE AS x", None),
        ("SELECT 5 ^ 3 AS x", 6),
        ("SELECT ~5 AS x", -6),
        ("SELECT 1 << 33 AS x", 2),
        ("SELECT -7 % 3 AS x", -1),
    ],
)
def test_dialect(spark, text, result):
    assert linq(text, spark=spark).collect()[0][0] == result


def test_dialect_leaves_text_alone():
    text = "SELECT 'x IS y', \"MOD\", `MOD` /* a MOD b */ -- IS\nFROM t WHERE a IS NOT NULL"
    assert to_spark_sql(text) == text


def test_functions(spark):
    one = spark.range(1)
    assert one.select(call("LOG", F.lit(8.0), F.lit(2.0))).collect()[0][0] == pytest.approx(3)
    assert one.select(call("log", F.lit(1.0))).collect()[0][0] == 0
    assert one.select(call("mod", F.lit(-7), F.lit(3)), call("mod", F.lit(1), F.lit(0)), call("coalesce", F.lit(None), F.lit(2))).collect()[0][:] == (-1, None, 2)
    with pytest.raises(ValueError):
        call("nothing")


def test_groups_with_text_and_nulls(spark):
    data = [(1, "1000"), (1, "2000"), (2, "-10"), (2, "500"), (3, None), (3, "25"), (3, "-11"), (4, "bow"), (4, "wow")]
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(data)], "n int, k int, v string")
    out = relational.group_with_first(df, ["k"], "n", text_sum(F.col("v")).alias("s"), aggregate("count", "v").alias("c"), aggregate("min", "v").alias("low"))
    assert rows(out.select("k", "v", "s", "c")) == [(1, "1000", 3000.0, 2), (2, "-10", 490.0, 2), (3, None, 14.0, 2), (4, "bow", None, 2)]


def test_exact_sum(spark):
    rng = random.Random(2)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-30, 20) for _ in range(400)] + [0.1, 0.2, 0.3, 5e-324, -0.0]
    for case in (values, [0.1] * 10, [1e-20, 1.0, -1.0], [75462.67, 372772.98], [1 / 3, 2 / 3]):
        sums = set()
        for _ in range(4):
            rng.shuffle(case)
            sums.add(spark.createDataFrame([(v,) for v in [*case, None]], "v double").agg(exact_sum(F.col("v"))).first()[0])
        assert len(sums) == 1 and sums.pop() == pytest.approx(math.fsum(case), rel=1e-15)
    for case in ([], [None], [1e300, 1.0], [6e27, 6e27], [float("inf"), 1.0], [float("nan"), 1.0]):
        df = spark.createDataFrame([(v,) for v in case], "v double")
        assert df.agg(exact_sum(F.col("v")).cast("string")).first() == df.agg(F.sum("v").cast("string")).first(), case


def test_materialized_totals_of_same_prices_are_equal(spark, tmp_path):
    """Customers 1 and 51 have the same prices in another order, 101 has more."""
    prices = [(1, 0.1), (1, 0.2), (1, 0.3), (51, 0.3), (51, 0.2), (51, 0.1), (101, 9.0)]
    spark.createDataFrame(prices, "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(catalog.queries()["subq_materialized"](spark, str(tmp_path))) == [(1, 1), (51, 1)]


def test_limit_and_names(spark):
    df = relational.sort(spark.range(1000), "id")
    assert rows(relational.limit(df, 2, 495)) == [(495,), (496,)]
    assert relational.project(df, F.col("id") + 1, (F.col("id"), "own")).columns == ["0", "own"]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_or_join_like_plain_join(spark, how):
    rng = random.Random(4)
    make = lambda n: [(rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2, 3]), i) for i in range(n)]
    a, b = spark.createDataFrame(make(25), "x int, y int, i int").alias("a"), spark.createDataFrame(make(25), "x int, y int, i int").alias("b")
    arms = [[F.col("a.x") == F.col("b.x")], [F.col("a.y") == F.col("b.y"), F.col("a.x") != F.col("b.y")], [F.col("a.x") == F.col("b.y")]]
    rest = F.col("a.i") % 3 != F.col("b.i") % 3
    got = joins.or_join(a, b, arms, rest, how)
    want = a.join(b, (arms[0][0] | (arms[1][0] & arms[1][1]) | arms[2][0]) & rest, how)
    assert rows(got) == rows(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_or_join_deals_few_keys(spark, tmp_path, how):
    """All rows of a key that all share, from one file, meet in several tasks."""
    spark.range(2000).selectExpr("1 AS x", "id AS i").coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.range(40).selectExpr("1 AS x", "id AS j").write.parquet(f"{tmp_path}/b")
    a, b = spark.read.parquet(f"{tmp_path}/a").alias("a"), spark.read.parquet(f"{tmp_path}/b").alias("b")
    arms = [[F.col("a.x") == F.col("b.x")], [F.col("a.i") == F.col("b.j")]]
    rest = F.col("a.i") > F.col("b.j")
    got = joins.or_join(a, b, arms, rest, how, salts=[16, 1])
    assert got.columns == ["x", "i", "x", "j"]
    assert rows(got.select("i", "j")) == rows(a.join(b, (arms[0][0] | arms[1][0]) & rest, how).select("i", "j"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        joins.or_join(a, b, arms, rest, how, salts=[16])


@pytest.mark.parametrize("name", ["join_or_keys", "join_or_left", "join_or_and_mixed", "join_or_and_left"])
def test_nations_meet_in_several_tasks(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == (2 if name.endswith("left") else 1) and "xxhash64" in plan


def test_changes(spark):
    t = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "k int, v int")
    assert rows(changes.delete(t, F.col("v") > 6)) == [(1, 5), (2, None)]
    assert rows(changes.update(t, {"v": F.lit(0)}, F.col("v") > 6)) == [(1, 5), (2, None), (3, 0)]
    assert rows(changes.insert(t, spark.createDataFrame([(4,)], "k int")))[-1] == (4, None)
    assert changes.delete(t).count() == 0


def test_catalog_and_files(spark, tmp_path):
    save(spark.createDataFrame(USERS), f"{tmp_path}/u.json", "json")
    names = Catalog(spark)
    names.add("users_of_test", from_files(spark, f"{tmp_path}/u.json", schema="id long, name string, age long"))
    assert names.sql("SELECT COUNT(*) AS n FROM users_of_test WHERE age MOD 2 = 0").collect()[0][0] == 2
    assert names.get("users_of_test").columns == ["id", "name", "age"]
    spark.sql("DROP TABLE IF EXISTS accounts_dealt")
    save_bucketed(spark.createDataFrame(ACCOUNTS), "accounts_dealt", 2, ["user_id"], "overwrite")
    plan = spark.table("accounts_dealt").groupBy("user_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


class Endpoint(BaseHTTPRequestHandler):
    asked: list[dict] = []

    def do_GET(self):
        query = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Endpoint.asked.append(query)
        low, high = int(query.get("_low", -1)), int(query.get("_high", 1 << 30))
        found = [u for u in USERS if low <= u["id"] < high and ("name" not in query or u["name"] == query["name"])]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(found).encode())

    def log_message(self, *args):
        pass


def test_rest(spark):
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/users"
    df = from_rest(spark, url, "id long, name string, age long", key="id", searchable="name", splits="3")
    assert rows(df.select("id")) == [(1,), (2,), (3,), (4,)]
    Endpoint.asked.clear()
    assert rows(df.filter("name = 'Alex' AND id >= 2 AND age < 10")) == [(4, "Alex", 9)]
    assert all(q.get("name") == "Alex" for q in Endpoint.asked) and {q.get("_low") for q in Endpoint.asked} == {"2", "3"}
    server.shutdown()


def test_stream(spark, tmp_path):
    df = spark.createDataFrame(USERS)
    df.write.parquet(f"{tmp_path}/in")
    stream = stream_files(spark, f"{tmp_path}/in", df.schema)
    for _ in range(2):  # the second time nothing is new
        run_once(stream, lambda d: relational.where(d, F.col("age") > 9).select("id"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [(1,), (2,), (3,)]
