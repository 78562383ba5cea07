from pyspark.sql import functions as F

from tributary.operators import folds


def out(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_dedup_restarts_after_last_emitted(spark):
    rows = [(1, "u1e1", 0.0), (2, "u1e1", 5.0), (3, "u2e1", 6.0), (4, "u1e2", 7.0), (5, "u1e1", 11.0), (6, "u1e1", 15.0)]
    df = spark.createDataFrame(rows, "seq long, k string, t double")
    got = folds.dedup_window(df, "k", "t", ["seq"], 10, ["seq", "k"])
    assert sorted(out(got, "seq")) == [(1,), (3,), (4,), (5,)]


def test_token_bucket_drop(spark):
    rows = [(i, "u1", 100 + i / 10) for i in range(6)] + [(6, "u1", 102.5), (7, "u2", 100.0)]
    df = spark.createDataFrame(rows, "seq long, u string, t double")
    got = folds.keyed_fold(df, "u", ["seq"], folds.bucket_step(5, 1, "t", ["seq"]), "seq long")
    assert sorted(out(got, "seq")) == [(0,), (1,), (2,), (3,), (4,), (6,), (7,)]


def test_token_bucket_label(spark):
    rows = [(1, "u1", 100.0, 5.0), (2, "u1", 101.0, 6.0), (3, "u2", 101.0, 11.0), (4, "u1", 102.0, 2.0), (5, "u1", 105.0, -1.0), (6, "u1", 105.5, 10.0)]
    df = spark.createDataFrame(rows, "seq long, u string, t double, cost double")
    got = folds.keyed_fold(df, "u", ["seq"], folds.bucket_step(10, 2, "t", ["seq"], "cost", "allowed"), "seq long, allowed boolean")
    assert [x[1] for x in sorted(out(got, "seq", "allowed"))] == [True, True, False, True, True, True]


def test_fraud(spark):
    rows = [(1, "u1", "login", 0.0, 1000), (2, "u1", "transaction", 1500.0, 1050), (3, "u1", "transaction", 1200.0, 1100), (4, "u1", "transaction", 2000.0, 1200),
            (5, "u2", "login", 0.0, 1000), (6, "u2", "transaction", 1500.0, 1010), (7, "u2", "logout", 0.0, 1020), (8, "u2", "transaction", 1500.0, 1030), (9, "u2", "transaction", 1500.0, 1040),
            (10, "u3", "login", 0.0, 1000), (11, "u3", "transaction", 1500.0, 1100), (12, "u3", "transaction", 1500.0, 1200), (13, "u3", "transaction", 1500.0, 1350)]
    df = spark.createDataFrame(rows, "seq long, u string, kind string, amount double, t long")
    got = folds.keyed_fold(df, "u", ["seq"], folds.fraud_step("t", "kind", "amount", "u"), "u string, login_ts double, alert_ts double")
    assert out(got, "u", "alert_ts") == [("u1", 1200.0)]


def test_carts(spark):
    rows = [(1, "u1", "add", "shoes", 0.0), (2, "u1", "add", "socks", 0.1), (3, "u2", "add", "laptop", 0.2), (4, "u2", "checkout", None, 0.3), (5, "u3", "add", "phone", 0.4)]
    df = spark.createDataFrame(rows, "seq long, u string, kind string, item string, t double")
    got = folds.timed_fold(df, "u", "t", ["seq"], folds.Carts("t", "kind", "item", "u", 1), "u string, first_ts double, items array<string>").withColumn("items", F.array_join("items", ","))
    assert sorted(out(got, "u", "items")) == [("u1", "shoes,socks"), ("u3", "phone")]


def test_running_top(spark):
    rows = [(1, "A", 1), (2, "B", 1), (3, "C", 1), (4, "A", 2), (5, "D", 4), (6, "B", 1), (7, "C", 5)]
    df = spark.createDataFrame(rows, "seq long, p string, inc long")
    got = folds.keyed_fold(df, None, ["seq"], folds.top_step("p", "inc", "seq", 3), "seq long, top string")
    assert sorted(out(got, "seq", "top"))[-1] == (7, "C:6,D:4,A:3")


def test_running_top_by_ranges(spark):
    """Ranges folded each by itself give what one fold of all rows gives."""
    rows = [(i, "abcdefg"[i * i % 7], (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, p string, inc long").repartition(3)
    whole = folds.keyed_fold(df, None, ["seq"], folds.top_step("p", "inc", "seq", 3), "seq long, top string")
    got = folds.running_top(df, "p", "inc", "seq", 3)
    assert sorted(out(got, "seq", "top")) == sorted(out(whole, "seq", "top"))
    assert folds.running_top(df.where("false"), "p", "inc", "seq", 3).count() == 0


def test_timers(spark):
    class Echo(folds.Logic):
        """Emits what it holds 10 seconds after the last row, and at the end."""

        def on_item(self, state, row):
            return [], (row["k"], row["t"], [*(state[2] if state else []), row["v"]])

        def notify_at(self, state):
            return state[1] + 10

        def on_notify(self, state, at):
            return [{"k": state[0], "held": state[2], "why": "timer"}], None

        def on_eof(self, state):
            return [{"k": state[0], "held": state[2], "why": "end"}]

    rows = [("a", 0.0, 1), ("a", 5.0, 2), ("a", 15.0, 3), ("a", 25.5, 4), ("b", 3.0, 9)]
    got = folds.timed_fold(spark.createDataFrame(rows, "k string, t double, v int"), "k", "t", ["t"], Echo(), "k string, held array<int>, why string")
    assert sorted(out(got, "k", "held", "why")) == [("a", [1, 2, 3], "timer"), ("a", [4], "end"), ("b", [9], "end")]


def test_join_clears(spark):
    rows = [(1, "u", "l", "1"), (2, "u", "r", "2"), (3, "u", "r", "3"), (4, "u", "l", "4")]
    df = spark.createDataFrame(rows, "seq long, k string, side string, v string")
    run = lambda clear: out(folds.keyed_fold(df, "k", ["seq"], folds.join_step("side", ["l", "r"], "v", "k", clear), "k string, l string, r string"), "l", "r")
    assert run(True) == [("1", "2"), ("4", "3")] and run(False) == [("1", "2"), ("1", "3"), ("4", "3")]


def test_union_find_and_components(spark):
    df = spark.createDataFrame([(1, "A", "B"), (2, "B", "C"), (3, "A", "C"), (4, "D", "E"), (5, "C", "E")], "seq long, u string, v string")
    got = folds.keyed_fold(df, None, ["seq"], folds.union_step("u", "v", "seq"), "seq long, u string, v string, status string, new_component_size int, component_size int").withColumn("size", F.coalesce("new_component_size", "component_size"))
    assert sorted(out(got, "seq", "status", "size")) == [(1, "merged", 2), (2, "merged", 3), (3, "already_connected", 3), (4, "merged", 2), (5, "merged", 5)]
    assert {c for _, c in out(folds.components(df), "node", "component")} == {"A"}


def test_components_of_long_chains(spark):
    """Ascending labels, which hooking to the smallest neighbour shortens by one node a round."""
    links = [(f"N{i:04}", f"N{i + 1:04}") for i in range(199)] + [("Z1", "Z2"), ("Z3", "Z3")]
    got = dict(out(folds.components(spark.createDataFrame(links, "u string, v string")), "node", "component"))
    assert got == {**{f"N{i:04}": "N0000" for i in range(200)}, "Z1": "Z1", "Z2": "Z1", "Z3": "Z3"}


def test_state_crosses_batches_and_empty_input(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        step = lambda n, row: ((n or 0) + 1, [{"id": row["id"], "n": (n or 0) + 1}])
        df = spark.range(100).withColumn("k", F.lit("hot"))
        assert max(r["n"] for r in folds.keyed_fold(df, "k", ["id"], step, "id long, n long").collect()) == 100
        assert folds.keyed_fold(df.where("id < 0"), "k", ["id"], step, "id long, n long").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_join_and_collect_steps(spark):
    rows = [(1, "u1", "imp", "a0"), (2, "u1", "imp", "a1"), (3, "u2", "imp", "a2"), (4, "u1", "click", "c1"), (5, "u3", "click", "c2"), (6, "u1", "click", "c3")]
    df = spark.createDataFrame(rows, "seq long, u string, side string, v string")
    got = folds.keyed_fold(df, "u", ["seq"], folds.join_step("side", ["imp", "click"], "v", "u"), "u string, imp string, click string")
    assert out(got, "u", "imp", "click") == [("u1", "a1", "c1"), ("u1", "a1", "c3")]
    got = folds.keyed_fold(df, "u", ["seq"], folds.collect_step("v", 3, "u"), "u string, items array<string>", folds.collect_end("u"))
    assert sorted((u, len(i)) for u, i in out(got, "u", "items")) == [("u1", 1), ("u1", 3), ("u2", 1), ("u3", 1)]
