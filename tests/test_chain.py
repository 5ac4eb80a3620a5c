"""Sources in turn, the chain to feedback, signatures and scopes."""

import hashlib
import itertools

from pyspark.sql import functions as F

from markwright.operators import matching, review


def _source(rows, calls, name):
    def match(asked):
        calls.append((name, sorted(r["id"] for r in asked.collect())))
        return asked.select("id").join(rows, "id")

    return match


def _results(spark, rows):
    return spark.createDataFrame(rows, "id long, item_id long, confidence double, status string")


def test_the_second_source_sees_failures_alone(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, text string")
    first = _results(spark, [(1, 10, 0.9, "accepted"), (2, 11, 0.05, "failed"), (3, None, 0.0, "failed")])
    second = _results(spark, [(1, 99, 1.0, "accepted"), (2, 20, 0.5, "accepted"), (3, 21, 0.02, "failed")])
    calls = []
    got = {r["id"]: (r["item_id"], r["status"], r["confidence"], r["fallback_used"]) for r in matching.in_turn(asked, _source(first, calls, "first"), _source(second, calls, "second"), "id").collect()}
    assert got == {1: (10, "accepted", 0.9, False), 2: (20, "accepted", 0.5, True), 3: (21, "failed", 0.02, True)}
    assert calls == [("first", [1, 2, 3]), ("second", [2, 3])]


def test_without_failures_the_second_source_is_not_read(spark):
    asked = spark.createDataFrame([(1, "a")], "id long, text string")
    calls = []
    got = matching.in_turn(asked, _source(_results(spark, [(1, 10, 0.9, "accepted")]), calls, "first"), _source(None, calls, "second"), "id")
    assert [tuple(r) for r in got.select("id", "item_id", "fallback_used").collect()] == [(1, 10, False)] and [c[0] for c in calls] == ["first"]


def test_chain_with_options_points_and_none(spark):
    asked = spark.createDataFrame([(1, "Ans: b"), (2, "heat rises in water"), (3, "x")], "id long, answer string")
    matched = spark.createDataFrame([(1, 10, False, "accepted"), (2, 11, True, "review_required"), (3, 12, True, "failed")], "id long, item_id long, fallback_used boolean, status string")
    schemes = spark.createDataFrame([(10, "Correct answer is B"), (11, "heat rises. cold air sinks below")], "item_id long, scheme string")
    got = {r["id"]: r for r in review.chained(asked, matched, schemes).collect()}
    assert (got[1]["score"], got[1]["label"], got[1]["n_points"]) == (1.0, "fully_correct", 2)
    assert (got[2]["score"], got[2]["label"], got[2]["feedback_md5"]) == (0.5, "partially_correct", hashlib.md5(b"Partly right (50.0%). Add: cold air sinks below").hexdigest())
    assert (got[3]["item_id"], got[3]["score"], got[3]["label"], got[3]["n_points"]) == (None, 0.0, "not_marked", 0)


def test_signature_of_one_large_owner(spark, monkeypatch):
    monkeypatch.setattr(review, "TREE_BITS", 3)
    rows = [("big", i * 7 - 300, f"v{i}") for i in range(1500)] + [("small", 5, "x"), ("two", 1 << 40, "x"), ("two", -1, "y")]
    frame = spark.createDataFrame(rows, "owner string, k long, v string").repartition(5)

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    def tree(own):
        nodes = {k: sha(f"{k}\u0001{v}") for k, v in own}
        for level in range(23):
            groups = {k: sorted(g) for k, g in itertools.groupby(sorted(nodes), key=lambda k: k >> 3 if level < 22 else 0)}
            nodes = {k: nodes[g[0]] if len(g) == 1 else sha(",".join(f"{c}:{nodes[c]}" for c in g)) for k, g in groups.items()}
        return nodes[0]

    want = {o: (tree([(k, v) for w, k, v in rows if w == o]), sum(w == o for w, *_ in rows)) for o in ("big", "small", "two")}
    signed = lambda f: {r["owner"]: (r["signature"], r["records"]) for r in review.signature(f, "owner", "k", ["k", "v"]).collect()}
    assert signed(frame) == want
    assert signed(frame.where("owner = 'small'")) == {"small": want["small"]}  # other owners don't count
    assert signed(frame.withColumn("v", F.when(F.col("k") == 1, "changed").otherwise(F.col("v"))))["big"] != want["big"]


def test_scopes_contain_or_are_contained(spark):
    areas = ["Biology", "biology 5090", "Bio", "Chemistry", "", "x", None]
    grants = [(["BIO"], True, False), (["chemistry and biology"], False, True), ([], False, False), (["", "zzz"], True, True), ([None, "x"], False, False), (["bio", "logy"], True, False)]
    low = lambda s: s.lower()
    covers = lambda scope, a: not scope or (a is not None and any(s is not None and (low(s) in low(a) or low(a) in low(s)) for s in scope))
    frame = spark.createDataFrame([(a, i) for i, a in enumerate(areas)], "area string, i int")
    got = review.granted(frame, spark.createDataFrame(grants, "scope array<string>, can_view boolean, can_edit boolean"), "area")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        own = [g for g in grants if covers(g[0], r["area"]) or (r["area"] is None and "" in g[0])]
        assert (r["n_grants"], r["can_view"], r["can_edit"]) == (len(own), any(g[1] for g in own), any(g[2] for g in own)), r
    assert got.count() == len(areas)
