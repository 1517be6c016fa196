import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from shelfledger.operators import relational as R
from shelfledger.sources.readers import cut_lineage

from .conftest import rows


def test_latest_keeps_ties_and_null_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 3, "n"), (None, 1, "m")],
                               "k string, t int, v string")
    assert rows(R.latest_per_key(df, ["k"], "t").select("v")) == [("n",), ("y",), ("z",)]


def test_share_of_group_and_grand_total(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "k string, x double")
    assert rows(R.share_of(df, ["k"], "x", "s").select("x", "s")) == [(1.0, 0.25), (3.0, 0.75), (5.0, 1.0)]
    total = R.share_of(df, [], "x", "s").agg(F.sum("s")).first()[0]
    assert abs(total - 1) < 1e-12


def test_top1_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("s", "b", 0.5), ("s", "a", 0.5), ("s", "c", 0.4)], "k string, n string, v double")
    assert rows(R.top1(df, ["k"], "v", "n").select("n")) == [("a",)]


def test_join_any_keeps_one_match(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 5, "e"), (1, 3, "c")], "k int, o int, v string")
    assert rows(R.join_any(left, right, ["k"], ["o"]).select("k", "v")) == [(1, "c"), (2, None)]


def test_asof_against_brute_force(spark):
    rnd = random.Random(3)
    day = lambda: date(2024, 1, 1) + timedelta(days=rnd.randrange(40))
    # one key holds most rows
    left = [(rnd.choice("aaaab"), day(), float(i)) for i in range(300)] + [("z", date(2024, 1, 9), 9.0)]
    right = {(rnd.choice("aaab"), day()): float(i) for i in range(30)}
    l_df = spark.createDataFrame(left, "k string, d date, x double")
    r_df = spark.createDataFrame([(k, d, v) for (k, d), v in right.items()], "k string, s date, p double")
    got = rows(R.asof_join(l_df, r_df, "k", "d", "s", "p").select("x", "p"))
    want = []
    for k, d, x in left:
        prior = [(s, v) for (rk, s), v in right.items() if rk == k and s < d]
        want.append((x, max(prior)[1] if prior else None))
    assert got == sorted(want, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_asof_takes_the_last_setting_of_a_day(spark):
    left = spark.createDataFrame([("k", date(2024, 1, 2)), ("k", date(2024, 1, 1))], "k string, d date")
    right = spark.createDataFrame([("k", datetime(2024, 1, 1, 8), 9.0), ("k", datetime(2024, 1, 1, 18), 5.0)], "k string, at timestamp_ntz, p double")
    assert rows(R.asof_join(left, right, "k", "d", "at", "p").select("p")) == [(None,), (5.0,)]


def test_first_known_by_order(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, None), ("a", 2, "x"), ("a", None, "w"), (None, None, "z"), ("b", 1, None)], "k string, o int, v string")
    got = R.first_known(df, ["k"], "v", ["o", "v"], "first").select("k", "first").distinct()
    assert rows(got) == [(None, "z"), ("a", "x"), ("b", None)]


def test_hierarchy_depth_root_and_cycle(spark):
    nodes = [("r", None), ("a", "r"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("alone", None),
             ("x", "y"), ("y", "x"), ("below", "x"), ("lost", "nowhere")]
    df = spark.createDataFrame(nodes, "id string, up string")
    got = {r.id: r.root for r in R.hierarchy_root(df, "id", "up", "root", cut_lineage).collect()}
    assert got == {"r": None, "a": "r", "b": "r", "c": "r", "d": "r", "e": "r", "alone": None,
                   "x": None, "y": None, "below": None, "lost": None}


def test_transpose_and_union(spark):
    df = spark.createDataFrame([("s", 1.0, 2)], "k string, a double, b int")
    assert rows(R.transpose_long(df, ["k"], [("a", "A"), ("b", "B")])) == [("s", 1, "A", 1.0), ("s", 2, "B", 2.0)]
    u = R.union_by_name(df.select("k", "a"), df.select("k", "b"))
    assert rows(u) == [("s", None, 2), ("s", 1.0, None)]


def test_hot_keys_are_dealt_and_unknown_ones_meet_no_join(spark):
    """The result is that of a left join; the rows of one key lie in many partitions, those without a key in no join."""
    n = 20_000
    left = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id % 500 END AS k", "id AS v", "id % 2 AS w")
    right = spark.range(0, 600, 2).selectExpr("id AS k", "concat('d', id) AS name", "CASE WHEN id > 9 THEN id END AS size").union(spark.createDataFrame([(7, "hot", 1)], "k long, name string, size long"))
    want = rows(left.join(right, "k", "left").select("k", "v", "w", "name", "size"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(keep, ("-1", "-1", "16", "false")):
            spark.conf.set(k, v)
        got = R.join_hot(left, right, "k", least=50)
        assert got.columns == ["k", "v", "w", "name", "size"] and rows(got) == want
        hot = got.filter("k = 7").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(hot) >= 10 and max(r["count"] for r in hot) < n / 3 / 4
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert "isnotnull" in plan and rows(R.join_hot(left.limit(0), right, "k")) == []
    assert rows(R.join_hot(left.filter("k is null"), right, "k").select("name").distinct()) == [(None,)]
