"""Boxes of pages against loops over all pairs."""

import numpy as np
from pyspark.sql import functions as F

from markwright.operators import geometry


def test_points_in_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(1)
    boxes = [(int(p), float(x), float(y), float(x + w), float(y + h)) for p, x, y, w, h in zip(rng.integers(0, 4, 120), rng.uniform(-50, 500, 120), rng.uniform(-50, 500, 120), rng.exponential(20, 120) * rng.integers(0, 9, 120), rng.exponential(20, 120), strict=True)]
    boxes += [(1, 0.0, 0.0, 1e6, 1e6), (2, 5.0, 5.0, 5.0, 5.0), (2, 9.0, 9.0, 1.0, 1.0), (3, None, 1.0, 2.0, 2.0)]
    points = [(int(p), float(x), float(y), i) for i, (p, x, y) in enumerate(zip(rng.integers(0, 5, 400), rng.integers(-60, 560, 400), rng.integers(-60, 560, 400), strict=True))]
    points += [(2, 5.0, 5.0, 1000), (2, 5.0, 5.0, 1001), (2, None, 5.0, 1002)]
    frame = spark.createDataFrame(points, "page int, x double, y double, i int")
    for pad_x, pad_y in ((0.0, 0.0), (8.0, 5.0)):
        found = geometry.points_in_boxes(frame, spark.createDataFrame(boxes, "page int, x0 double, y0 double, x1 double, y1 double"), "page", pad_x, pad_y)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        whole = [b for b in boxes if None not in b]
        want = sorted(i for p, x, y, i in points if x is not None and any(p == q and a - pad_x <= x <= c + pad_x and b - pad_y <= y <= e + pad_y for q, a, b, c, e in whole))
        assert sorted(r["i"] for r in found.collect()) == want
    assert geometry.points_in_boxes(frame, spark.createDataFrame([], "page int, x0 double, y0 double, x1 double, y1 double"), "page").count() == 0


def test_lines_by_gaps(spark):
    words = [("p", "b", 50, 1, 90, 13), ("p", "a", 0, 0, 40, 12), ("p", "c", 0, 13, 40, 25), ("p", "d", 50, 20, 90, 30), ("p", "e", 0, 31, 9, 40), ("q", "x", 0, 5, 1, 6)]
    frame = spark.createDataFrame([(p, t, *map(float, box)) for p, t, *box in words], "page string, text string, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["page"], r["line"], r["text"], r["y0"], r["y1"]) for r in geometry.line_boxes(geometry.lines_of(frame, "page"), "page").collect())
    assert got == [("p", 1, "a b", 0, 13), ("p", 2, "c d", 13, 30), ("p", 3, "e", 31, 40), ("q", 1, "x", 5, 6)]


def test_passage_of_a_page(spark):
    lines = ["Write a precis of this.", *["The quick brown fox jumps over lazy dogs"] * 6, "two words", "12"]
    words = [("p", w, 50.0 * j, 20.0 * i, 50.0 * j + 40, 20.0 * i + 12) for i, line in enumerate(lines) for j, w in enumerate(line.split())]
    (row,) = geometry.passage_words(spark.createDataFrame(words, "page string, text string, x0 double, y0 double, x1 double, y1 double"), "page").collect()
    assert (row["by_lines"], row["in_regions"], row["by_text"]) == (48, 48, 56)
    assert row["in_band"] == 50 and row["by_length"] == round((6 * len(lines[1]) + 5) / 5.2)  # the first and the last line lie outside the band
    assert row["words"] == 45  # the middle of 40, 42, 42, 48, 48, 48


def test_passage_lines(spark):
    cases = [("one two three four five", True), ("one two three.", True), ("one two three", False), ("", False), ("Answer the question in five words now", False)]
    rows = spark.createDataFrame(cases, "t string, want boolean")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", geometry.is_passage(F.col("t"))).collect())


def test_what_is_dealt_by_page_is_not_shuffled_again(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0)], "page int, x double, y double").repartition(8, "page")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0)], "page int, x0 double, y0 double, x1 double, y1 double").repartition(8, "page")
    found = geometry.points_in_boxes(points, boxes, "page")
    assert found.count() == 1
    assert found._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 2
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2 and "ENSURE_REQUIREMENTS" not in plan
