"""Rewriting, graphs, access paths, WHERE + ON plans, predicates from text, and what Catalyst does with them."""

import random

import pytest
from pyspark.sql import functions as F

from veldt.functions.aggregates import REGISTERED, aggregate, register, register_fold
from veldt.functions.dialect import to_spark_sql
from veldt.functions.scalar import truth
from veldt.operators import joins
from veldt.plans import access, text
from veldt.plans import joins as planned
from veldt.plans import predicates as p
from veldt.session import Catalog, linq
from veldt.sources.tables import Remote, from_jdbc

A, B, K = p.Col("a"), p.Col("b"), p.Lit


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- trees ---


def test_rewrite_goes_down_and_up():
    tree = text.condition("NOT (a = 1 OR a > 2) AND b IN (1, 3) AND a + b * 2 BETWEEN 1 AND -4 AND b IS NOT NULL")
    seen = []
    assert p.rewrite(tree, before=lambda t: seen.append(t) or t) == tree and seen == list(p.walk(tree))
    up = []
    p.rewrite(tree, after=lambda t: up.append(t) or t)
    assert up[-1] == tree and up[0] == A and len(up) == len(seen)
    swapped = p.rewrite(tree, after=lambda t: B if t == A else t)
    assert p.columns_of(swapped) == {B} and p.columns_of(tree) == {A, B}
    # What before returns is gone into, what after returns is not.
    assert p.rewrite(K(0), before=lambda t: p.Op("+", A, K(1)) if t == K(0) else B if t == A else t) == p.Op("+", B, K(1))
    assert p.rewrite(A, after=lambda t: p.Op("+", A, A) if t == A else t) == p.Op("+", A, A)


def test_digest_tells_structures_apart():
    one, two = text.condition("a = 1 AND b > 'x'"), text.condition("a = 1  AND b > 'x'")
    assert p.digest(one) == p.digest(two) != p.digest(text.condition("a = 1 AND b > 'y'"))
    assert 0 <= p.digest(one) < 1 << 64
    assert p.digest(p.And((A, p.And((B, A))))) != p.digest(p.And((p.And((A, B)), A)))


@pytest.mark.parametrize(
    "sql, tree",
    [
        ("a = 1", p.Compare("=", A, K(1))),
        ("x.a <> 'it''s'", p.Compare("!=", p.Col("a", "x"), K("it's"))),
        ("NOT a < 1 OR b >= 2.5 AND a IS NULL", p.Or((p.Not(p.Compare("<", A, K(1))), p.And((p.Compare(">=", B, K(2.5)), p.IsNull(A)))))),
        ("a NOT IN (1, -2)", p.Not(p.In(A, (K(1), K(-2))))),
        ("a NOT BETWEEN 1 AND 2 + b", p.Not(p.Between(A, K(1), p.Op("+", K(2), B)))),
        ("(a + 1) * -b / 2 - 3 = 0", p.Compare("=", p.Op("-", p.Op("/", p.Op("*", p.Op("+", A, K(1)), p.Op("neg", B)), K(2)), K(3)), K(0))),
        ("TRUE AND `a` = NULL", p.And((p.TRUE, p.Compare("=", A, K(None))))),
    ],
)
def test_condition_from_text(sql, tree):
    assert text.condition(sql) == tree


@pytest.mark.parametrize("bad", ["a =", "a = 1 b", "a NOT 1", "(a = 1", "", "a IN 1", ")"])
def test_bad_conditions_raise(bad):
    with pytest.raises(ValueError):
        text.condition(bad)


def test_clauses_of_a_select():
    sql = "SELECT f(a, b) AS x, c FROM t WHERE a = 1 AND b IN (SELECT 1 WHERE 2 = 2) ORDER BY a DESC, t.b LIMIT 3"
    assert text.columns(sql) == ["f(a, b) AS x", "c"]
    assert text.order_by(sql) == [(A, "desc"), (p.Col("b", "t"), "asc")]
    assert text.clauses(sql)["WHERE"].endswith("2 = 2)") and text.clauses(sql)["LIMIT"] == "3"
    assert text.where("SELECT a FROM t WHERE a > 3") == p.Compare(">", A, K(3)) and text.where("SELECT a FROM t") == p.TRUE


def test_isolating_keeps_whole_bounds_and_leaves_the_rest():
    assert p.isolate(text.condition("a * 5 > 26")) == p.Compare(">", A, K(5))
    assert p.isolate(text.condition("a * 5 <= 26")) == p.Compare("<=", A, K(5))
    assert p.isolate(text.condition("a * 5 >= 26")) == p.Compare(">=", A, K(6))
    assert p.isolate(text.condition("a * -5 < 26")) == p.Compare(">", A, K(-6))
    assert p.isolate(text.condition("a * 5 = 26")) == p.And((p.Not(p.IsNull(A)), p.FALSE))
    assert p.isolate(text.condition("a * 5 <> 26")) == p.Not(p.IsNull(A))
    for same in ("a * 0.01 = 0.07", "a / 3 > 5", "a + 0.5 > 1", "a + b > 1"):
        assert p.isolate(text.condition(same)) == text.condition(same)
    assert p.isolate(text.condition("a * 5 > 25"), {"b"}) == text.condition("a * 5 > 25")


def test_isolated_whole_numbers_hold_for_the_same_values():
    rng = random.Random(4)
    for _ in range(3000):
        factor, shift, bound, sign = rng.randrange(-7, 8), rng.randrange(-9, 10), rng.randrange(-60, 60), rng.choice(list(p.FLIPPED))
        tree = p.fold(p.isolate(p.Compare(sign, p.Op("+", p.Op("*", A, K(factor)), K(shift)), K(bound))))
        for x in range(-20, 21):
            want = p._holds(sign, x * factor + shift, bound)
            match tree:
                case p.Compare(s, p.Col(), p.Lit(v)):
                    assert p._holds(s, x, v) == want
                case p.Not():
                    assert want
                case _:
                    assert not want


def test_graph():
    tree = text.condition("a.a > 1 AND b.d = b.c AND a.a = b.c AND a.x < b.d AND b.y + 1 = 3 AND a.x <= 9")
    g = p.graph(tree)
    aa, bc, bd, ax = p.Col("a", "a"), p.Col("c", "b"), p.Col("d", "b"), p.Col("x", "a")
    assert set(g.classes) == {frozenset({aa, bc, bd}), frozenset({ax})}
    one, other = g.class_of(bc), g.class_of(ax)
    assert g.constraints[one] == ((">", 1),) and g.constraints[other] == (("<=", 9),)
    assert g.connections == ((other, "<", one),) and g.rest == (p.Compare("=", p.Op("+", p.Col("y", "b"), K(1)), K(3)),)
    assert not g.contradicts() and p.graph(text.condition("a = b AND a > 3 AND b < 2")).contradicts()
    assert p.graph(g.tree()).classes and set(p.graph(g.tree()).connections)


# ------------------------------------------------------------ access paths ---


def index(name, columns, bins):
    return access.Index(name, tuple(columns), f"/none/{name}", tuple(bins))


def test_choice_of_an_index():
    by_a = index("a", ["a"], [((i * 10,), (i * 10 + 9,), 100) for i in range(10)])
    by_ab = index("ab", ["a", "b"], [((i * 10, 0), (i * 10 + 9, 9), 100) for i in range(10)])
    by_b = index("b", ["b"], [((i,), (i,), 100) for i in range(10)])
    every = [by_a, by_ab, by_b]
    assert access.index_map(every) == {"a": [by_a, by_ab], "b": [by_ab, by_b]}
    choose = lambda sql, **k: access.choose(text.condition(sql), every, 1000, **k)
    one = choose("a = 15 AND b = 3")
    assert [s.index.name for s in one.scans] == ["ab"] and one.rows() == 100
    assert [s.index.name for s in choose("b = 3 AND a > 5").scans] == ["b"]
    assert [s.index.name for s in choose("a = 15 OR b = 4").scans] == ["a", "b"] or [s.index.name for s in choose("a = 15 OR b = 4").scans] == ["ab", "b"]
    same = choose("a = 15 OR a = 71 OR a BETWEEN 20 AND 29")
    assert len(same.scans) == 1 and same.rows() == 300 and len(same.scans[0].arms) == 3
    assert choose("a = 1 AND a = 2").scans == () and choose("a = 1 OR c = 4").scans[0].index is None
    assert choose("a >= 0").scans[0].index is None  # costs as much as the table
    assert choose("a = 15", order=("a",)).sort == ("a",)
    assert by_ab.usable({A: p.Range(1, True, 5, True), B: p.Range(1, True, 1, True)}) == [p.Range(1, True, 5, True)]


def test_indexed_table_reads_what_the_predicate_selects(spark, tmp_path):
    rng = random.Random(3)
    data = [(rng.choice([None, *range(1, 10)]), rng.randrange(1, 7), rng.choice("xyz"), i) for i in range(3000)]
    spark.createDataFrame(data, "a int, b int, c string, n int").write.parquet(f"{tmp_path}/t")
    table = access.IndexedTable(spark.read.parquet(f"{tmp_path}/t"))
    for columns in (["a"], ["b"], ["a", "b"], ["c", "b"]):
        table.add_index("_".join(columns), columns, f"{tmp_path}/{'_'.join(columns)}", files=6)
    for sql in ("a > 8 OR (a = 3 AND b >= 2)", "a = 3 OR b = 4 OR a = 6", "a = 1 AND a = 2", "c = 'x' AND b * 2 = 6", "n < 40", "NOT (a <> 2 OR b > 1)", "b > 4 AND c >= 'y' OR a = 9", "a IS NULL"):
        tree = text.condition(sql)
        want = [r for r in rows(table.frame.where(sql))]
        assert rows(table.where(tree)) == want, sql
        assert rows(table.where(tree, ("n",))) == want
        assert table.plan(tree).rows() >= (len(want) if table.plan(tree).scans else 0)
    span = [p.Range(3, True, 3, True), p.Range(2, True, None, False)]
    assert rows(table.fetch("a_b", span)) == rows(table.frame.where("a = 3 AND b >= 2"))
    assert table.statistics("a_b", span) >= table.fetch("a_b", span).count() and table.fetch().count() == table.count() == 3000
    assert "GreaterThanOrEqual(b,2)" in plan_of(table.fetch("a_b", span))


def test_plan_of_where_and_on(spark):
    where = text.condition("x.id > 52 AND x.id = y.id AND y.v <> z.v AND 1 = 1")
    found = planned.plan(["x", "y", "z"], where, (text.condition("z.k = y.k"),))
    assert found.filters["y"] == p.Compare(">", p.Col("id", "y"), K(52)) and found.filters["z"] == p.TRUE
    assert [s.table for s in found.steps] == ["y", "z"] and found.steps[1].keys == ((p.Col("k", "y"), p.Col("k", "z")),)
    assert found.steps[1].condition == p.Compare("!=", p.Col("v", "y"), p.Col("v", "z"))
    assert planned.plan(["x", "z", "y"], where, (text.condition("z.k = y.k"),)).steps[0].table == "y"
    t = {n: spark.createDataFrame([(i, i % 7, i % 3) for i in range(40, 70)], "id int, k int, v int") for n in "xyz"}
    want = spark.sql("SELECT x.id, z.id AS other FROM {x} x, {y} y, {z} z WHERE x.id > 52 AND x.id = y.id AND y.v <> z.v AND z.k = y.k", **t)
    frame = found.frame(t)
    assert rows(frame.select("x.id", F.col("z.id").alias("other"))) == rows(want) and want.count() > 10
    alone = planned.plan(["x", "y"]).frame({n: t[n] for n in "xy"})
    assert alone.count() == 900


def test_merge_prefix(spark):
    col = lambda n: p.Col(n.split(".")[1], n.split(".")[0])
    up = lambda *names: [(col(n), "asc") for n in names]
    both = ["l"], ["r"]
    assert planned.merge_prefix(text.condition("l.a = r.a AND l.b = r.b"), *both, up("l.a", "l.b"), up("r.a", "r.b")) == 2
    assert planned.merge_prefix(text.condition("r.a = l.a AND l.c = r.b"), *both, up("l.a", "l.b"), up("r.a", "r.b")) == 1
    assert planned.merge_prefix(text.condition("l.a = r.a OR l.b = r.b"), *both, up("l.a", "l.b"), up("r.a", "r.b")) == 0
    assert planned.merge_prefix(text.condition("l.a = r.b AND l.b = r.a"), *both, up("l.a", "l.b"), up("r.a", "r.b")) == 0
    assert planned.merge_prefix(text.condition("l.a = r.a"), *both, up("l.a"), [(col("r.a"), "desc")]) == 0
    assert planned.merge_prefix(text.condition("l.a > r.a AND l.b = r.b"), *both, up("l.a", "l.b"), up("r.a", "r.b")) == 0
    order = up("l.a", "l.b")
    df = spark.range(100).select((F.col("id") % 10).alias("a"), F.col("id").alias("b"))
    sides = [planned.sorted_for_merge(d, order, 2) for d in (df, df.withColumnRenamed("b", "c").withColumn("b", F.col("c")))]
    plan = plan_of(sides[0].join(sides[1].hint("merge"), ["a", "b"]))
    assert plan.count("Exchange hashpartitioning") == 2 and "ENSURE_REQUIREMENTS" not in plan


# ------------------------------------------------------ sessions, sources ---


def test_truth_of_values(spark):
    df = spark.createDataFrame([("1",), ("0",), ("x",), (None,), ("-2.5",)], "v string")
    assert [r[0] for r in df.select(truth(F.col("v"))).collect()] == [True, False, None, None, True]


def test_registered_aggregates(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 4.0), ("x", None), ("y", None)], "k string, v double")
    register("Middle", lambda v: F.exp(F.avg(F.ln(v))))
    register_fold("joined", lambda: [], lambda state, v: [*state, v], lambda state: ",".join(f"{v:g}" for v in sorted(state)), "string")
    try:
        assert rows(df.groupBy("k").agg(aggregate("middle", "v").alias("m"))) == [("x", 2.0), ("y", None)]
        assert rows(df.groupBy("k").agg(aggregate("JOINED", "v").alias("m"))) == [("x", "1,4"), ("y", "")]
        with pytest.raises(ValueError):
            aggregate("middle", "v", distinct=True)
    finally:
        REGISTERED.clear()
    with pytest.raises(ValueError):
        aggregate("middle", "v")


def test_materialized_query_is_computed_once(spark):
    catalog = Catalog(spark)
    catalog.add("numbers", [{"n": i} for i in range(50)])
    kept = catalog.materialize("halves", "SELECT n DIV 2 AS h FROM numbers WHERE n > :low", {"low": 9})
    assert "InMemoryTableScan" in plan_of(catalog.sql("SELECT a.h FROM halves a JOIN halves b ON a.h = b.h")) and kept.count() == 40
    catalog.drop("halves")
    assert not kept.is_cached and "halves" not in catalog.tables


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "ID int, NAME string").write.format("jdbc").option("url", url).option("dbtable", "people").options(**driver).save()
    df = from_jdbc(spark, url, "SELECT id, name FROM people WHERE id > 1", **driver)
    assert [(r[0], r[1]) for r in sorted(df.collect())] == [(2, "b"), (3, None)]
    assert "PushedFilters: [*IsNotNull(ID), *EqualTo(ID,2)]" in plan_of(df.where("id = 2"))
    remote = Remote("jdbc", url, "SELECT id, name FROM people", options=driver)
    assert rows(linq("SELECT p.name FROM {people} p JOIN {own} o ON o.id = p.id", spark=spark, people=remote, own=[{"id": 2}])) == [("b",)]
    with pytest.raises(ValueError):
        linq("SELECT * FROM {x}", spark=spark, x=Remote("ftp", "x"))


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    for values, want in (([], [(1,), (2,), (None,)]), ([2], [(1,)]), ([2, 2, 5], [(1,)]), ([None], []), ([2, None], [])):
        right = spark.createDataFrame([(v,) for v in values], "b int")
        assert rows(joins.not_in(left, right, "a", "b")) == sorted(want, key=str), values
        plain = spark.sql("SELECT a FROM {l} WHERE a NOT IN (SELECT b FROM {r})", l=left, r=right)
        assert rows(plain) == sorted(want, key=str)


def test_salts_are_the_same_each_time(spark):
    big = spark.createDataFrame([(i % 3, i, "own") for i in range(60)], "k int, v int, _salt string").repartition(3)
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, w string")
    joined = joins.spread_join(big, small, ["k"], salts=4)
    assert joined.columns == ["k", "v", "_salt", "w"] and joined.count() == 40 and "rand" not in plan_of(joined)


@pytest.mark.parametrize("how, count", [("inner", 300), ("left", 400), ("semi", 300), ("anti", 100)])
def test_salted_copies_are_not_broadcast(spark, tmp_path, how, count):
    spark.range(3).selectExpr("id AS k", "id AS w").write.parquet(f"{tmp_path}/small")  # a size that Catalyst knows
    big = spark.range(400).selectExpr("id % 4 AS k", "id AS v")
    joined = joins.spread_join(big, spark.read.parquet(f"{tmp_path}/small"), ["k"], how=how)
    assert joined.count() == count and "Broadcast" not in plan_of(joined)


VALUES = ("SELECT 1 AS v WHERE 1 = 0", "SELECT 1 AS v", "SELECT 1 AS v UNION ALL SELECT 3", "SELECT 1 AS v UNION ALL SELECT CAST(NULL AS INT)", "SELECT CAST(NULL AS INT) AS v", "SELECT 2 AS v UNION ALL SELECT 2")


@pytest.mark.parametrize("sign", ["=", "<>", "!=", "<", "<=", ">", ">="])
@pytest.mark.parametrize("word", ["ANY", "SOME", "ALL"])
def test_quantified_comparisons(spark, sign, word):
    """Against three-valued logic over the listed values."""
    sets = ([], [1], [1, 3], [1, None], [None], [2, 2])
    columns, want = [], []
    for own in (None, 1, 2, 3):
        for query, values in zip(VALUES, sets, strict=True):
            columns.append(f"{'CAST(NULL AS INT)' if own is None else own - 1} + 1 {sign} {word} ({query}) AS c{len(columns)}")
            each = [None if own is None or v is None else p._holds("!=" if sign == "<>" else sign, own, v) for v in values]
            if word == "ALL":
                want.append(False if False in each else None if None in each else True)
            else:
                want.append(True if True in each else None if None in each else False)
    assert list(spark.sql(to_spark_sql("SELECT " + ", ".join(columns))).first()) == want


def test_quantified_comparison_is_one_row(spark):
    data = "/root/testdata/sf0.001"
    part, nation = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("part", "nation"))
    df = linq("SELECT p_partkey FROM {part} WHERE p_size > ALL (SELECT n_nationkey FROM {nation})", part=part, nation=nation)
    df.collect()
    plan = plan_of(df)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_left_join_becomes_inner_where_nulls_are_rejected(spark):
    left, right = spark.range(10), spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    left.createOrReplaceTempView("o_left")
    right.createOrReplaceTempView("o_right")
    assert "LeftOuter" not in plan_of(linq("SELECT id FROM o_left LEFT JOIN o_right ON id = k WHERE v > 2", spark=spark))
    assert "LeftOuter" in plan_of(linq("SELECT id FROM o_left LEFT JOIN o_right ON id = k", spark=spark))


def test_sorted_input_is_not_sorted_again(spark):
    df = spark.range(100).repartition(4, "id").sortWithinPartitions("id")
    assert plan_of(df.sortWithinPartitions("id")).count("Sort ") == 1
    joined = df.hint("merge").join(df.select(F.col("id").alias("k")), F.col("id") == F.col("k"))
    assert plan_of(joined).count("Sort ") == 2
