from collections import Counter

from pyspark.sql import functions as F

from markwright.operators import analytics, corpus, relational
from markwright.sources import listing, readers
from markwright.streaming import limits, sinks


def test_course_files(spark):
    text = '{"2019": {"May_June": {"1": {"2": [{"question_number": "1", "sub_question": "a", "question_text": "q", "marking_scheme": "m", "page_number": 3}]}}}}'
    row = readers.course_records(spark.createDataFrame([("f", text)], "path string, content string")).first()
    assert (row["year"], row["session"], row["paper"], row["variant"], row["question_id"]) == (2019, "May_June", "1", "2", "main|2019|May_June|1|2|1a")


def test_accepted_pairs(spark):
    s = spark.createDataFrame([("p", "accepted"), ("r", "failed")], "paper_id string, status string")
    q = spark.createDataFrame([("p", "1", None, "t"), ("r", "1", None, "t")], "paper_id string, question_number string, sub_question string, question_text string")
    e = spark.createDataFrame([("p", "1", None, 0, "first"), ("p", "1", None, 1, "second")], "paper_id string, question_number string, sub_question string, position int, marking_scheme string")
    assert [(r["paper_id"], r["marking_scheme"]) for r in readers.accepted_pairs(s, q, e).collect()] == [("p", "first")]


def test_file_names(spark):
    names = ["Physics_2019_May_June_Paper_1_Variant_2_QP.pdf", "Add_Maths_2020_Oct_Nov_Paper_2_ms_1.pdf", "Art_2018_Oct_Nov_ER.pdf", "notes.pdf"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(readers.file_name_fields(F.col("n")).alias("f")).collect()
    assert [tuple(r["f"]) if r["f"] else None for r in rows] == [("exam_paper", "Physics", 2019, "May_June", 1, 2, "QP", None), ("exam_paper", "Add Maths", 2020, "Oct_Nov", 2, None, "MS", None), ("session_doc", "Art", 2018, "Oct_Nov", None, None, "ER", None), None]


def test_crawl(spark):
    rows = spark.createDataFrame([("oa/maths/2019",), ("oa/maths/1999",), ("oa/maths",), ("xx/maths/2019",)], "path string")
    got = readers.crawl(rows, {"root": ["oa"], "subject": None, "year": None}, 2010, 2020)
    assert [r["malformed"] for r in got.collect()] == [None, "year", "depth", "root"]
    assert {r["malformed"]: r["n"] for r in readers.skip_reasons(got).collect()} == {"year": 1, "depth": 1, "root": 1}


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, t int")
    assert sorted(map(tuple, readers.upsert(old, new, ["id"], [F.desc("t")]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    seen = spark.createDataFrame([("x",)], "content string").select(F.sha2("content", 256).alias("content_hash"))
    assert [r["content"] for r in readers.insert_new(seen, spark.createDataFrame([("x",), ("y",), ("y",)], "content string")).collect()] == ["y"]


def test_csv_cells(spark):
    rows = spark.createDataFrame([('a"b', None, "x,y")], "a string, b string, c string")
    assert readers.csv_lines(rows, ["a", "b", "c"]).first()["line"] == '"a""b",,"x,y"'


def test_pairing_coverage(spark):
    left = spark.createDataFrame([("p", 1, 1), ("p", 2, 2)], "paper string, n int, pos int").withColumn("q", F.lit(1))
    right = spark.createDataFrame([("p", 1, 1), ("p", 2, 2), ("p", 3, 3), ("p", 4, 4)], "paper string, n int, pos int").withColumn("e", F.lit(1))
    row = relational.pairing_quality(relational.pair_once(left, right, ["paper", "n"], "pos"), "paper", "q", "e").first()
    assert (row["left_coverage"], row["right_coverage"], row["balanced"], row["status"]) == (1.0, 0.5, 0.5, "review_required")


def test_no_positional_fallback(spark):
    left = spark.createDataFrame([("p", "1", 1), ("p", "2", 2)], "paper string, n string, pos int").withColumn("q", F.lit(1))
    right = spark.createDataFrame([("p", "1", 1), ("p", "5", 2)], "paper string, n string, pos int").withColumn("e", F.lit(1))
    got = relational.pair_once(left, right, ["paper", "n"], "pos").where("q = 1 AND e = 1").collect()
    assert [r["n"] for r in got] == ["1"]


def test_safe_fallback_of_pairing(spark):
    kinds = "paper string, number string, sub string, pos long"
    q = spark.createDataFrame([("p", "1", "", 1), ("p", "2", "", 2), ("p", "3", "a", 3), ("p", "4", "", 4)], kinds)
    e = spark.createDataFrame([("p", "1", "", 1), ("p", "2", "a", 2), ("p", "3", "b", 3), ("p", "4", "a", 4), ("p", "4", "b", 5)], kinds)
    got = {r["q_pos"]: (r["e_pos"], r["method"], r["ambiguous"]) for r in relational.pair_with_fallback(q, e, "paper").where("q_pos IS NOT NULL").collect()}
    assert got == {1: (1, "exact_key", False), 2: (2, "same_question_unique_sub_safe", False), 3: (None, None, False), 4: (None, None, True)}
    assert relational.pair_with_fallback(q, e, "paper").count() == 7


def test_places_within_buckets(spark):
    rows = spark.createDataFrame([(g, x) for g in (1, 2, None) for x in (5, 3, 3, 9, 14, 27)], "g int, x int")
    got = sorted((r["g"] or 0, r["place"], r["x"]) for r in relational.placed(rows, "g", F.floor(F.col("x") / 10).cast("int"), "x").collect())
    assert got == [(g, k + 1, x) for g in (0, 1, 2) for k, x in enumerate((3, 3, 5, 9, 14, 27))]


def test_both_stores(spark, tmp_path):
    _events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id long, user_id long, s int, ts timestamp").parquet(str(tmp_path / "in"))
    sinks.write_both(source, str(tmp_path / "a"), str(tmp_path / "b"), F.col("user_id") == 7, str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 6 and spark.read.parquet(str(tmp_path / "b")).count() == 5
    (tmp_path / "full").write_text("no folder")
    sinks.write_both(source, str(tmp_path / "d"), str(tmp_path / "full"), F.col("user_id") == 7, str(tmp_path / "e")).awaitTermination(120)
    lost = spark.read.parquet(str(tmp_path / "d-retry"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 6 and lost.count() == 5 and lost.where("_reason <> '' AND _batch = 0").count() == 5


def test_json_lines_skip_blank_ones(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n   \n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.json_lines(spark, str(tmp_path), "a int").collect()) == [1, 2]


def test_interval_conflicts_touching(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 1, TIMESTAMP'2024-01-01 00:00', TIMESTAMP'2024-01-01 01:00'), (2, 1, TIMESTAMP'2024-01-01 01:00', TIMESTAMP'2024-01-01 03:30'), (3, 1, TIMESTAMP'2024-01-01 02:59', TIMESTAMP'2024-01-01 04:00') AS t(id, k, s, e)")
    assert [(r["id_a"], r["id_b"]) for r in relational.interval_conflicts(rows, "k", "id", "s", "e").collect()] == [(2, 3)]


def test_question_chunks(spark):
    pages = spark.createDataFrame([("d", 1, "cover\n1 First part\nmore\n3 Skipped number"), ("d", 2, "2 Second part\nend")], "doc string, page int, text string")
    got = {r["question"]: (r["page"], r["chunk"]) for r in corpus.question_chunks(pages).collect()}
    assert got == {None: (1, "cover"), 1: (1, "1 First part\nmore\n3 Skipped number"), 2: (2, "2 Second part\nend")}


def test_fragments(spark):
    f = spark.createDataFrame([("1", "a", "later", 0.9, True, 2), ("1", "a", "first", 0.5, True, 1), ("2", "a", " ", 0.9, True, 1), ("3", "a", "x", 0.2, True, 1)], "question string, part string, text string, confidence double, legible boolean, page int")
    got = {r["question"]: (r["text"], r["flag"]) for r in corpus.fold_fragments(f).collect()}
    assert got["1"] == ("first\nlater", "low_confidence") and got["2"][1] == "blank" and got["3"][1] == "unreadable"


def test_fragment_numbers(spark):
    f = spark.createDataFrame([("3a",), ("10",), ("1",)], "fragment_number string")
    q = spark.createDataFrame([("3",), ("1",), ("10",)], "question_number string")
    assert sorted((r["fragment_number"], r["question_number"]) for r in corpus.fragment_question(f, q).collect()) == [("1", "1"), ("10", "10"), ("3a", "3")]


def test_canonical_topic(spark):
    raw = spark.createDataFrame([(1, "Waves"), (2, "light and optics"), (3, "zzz")], "id int, topic string")
    topics = ["optics", "waves and sound", "waves"]
    assert {r["id"]: r["name"] for r in corpus.canonical_topic(raw, topics).collect()} == {1: "waves", 2: "optics"}


def _events(spark):
    rows = [(1, 7, 0), (2, 7, 10), (3, 7, 59), (4, 7, 60), (5, 8, 5), (6, 7, 61)]
    return spark.createDataFrame(rows, "event_id long, user_id long, s int").withColumn("ts", F.timestamp_seconds(F.col("s") + 1700000000))


def test_rate_limit_is_anchored_at_the_first_event(spark):
    got = {r["event_id"]: (r["n"], r["allowed"]) for r in limits.rate_limit(_events(spark), "user_id", "ts", "event_id", 60, 2).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, False), 4: (1, True), 6: (2, True), 5: (1, True)}


def test_streams_agree_with_batch(spark, tmp_path):
    _events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id long, user_id long, s int, ts timestamp").parquet(str(tmp_path / "in"))
    marked = limits.stream_rate_limit(source, "user_id", "ts", "event_id", 60, 2)
    run = marked.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = limits.rate_limit(_events(spark), "user_id", "ts", "event_id", 60, 2)
    assert sorted(map(tuple, spark.table("limited").select("event_id", "n", "allowed").collect())) == sorted(map(tuple, batch.select("event_id", "n", "allowed").collect()))
    once = limits.idempotent_stream(source.unionByName(source), "event_id", "ts", "1 hour")
    run = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("once").count() == 6


def test_stratified_pack_fills_up(spark):
    rows = spark.createDataFrame([(i, i < 3, "s") for i in range(20)], "id int, mcq boolean, s string")
    got = relational.stratified_packs(rows, "s", "id", "mcq", 5, 8, 1).collect()
    again = relational.stratified_packs(rows.repartition(3), "s", "id", "mcq", 5, 8, 1).collect()
    assert len({r["id"] for r in got}) == 8 and sum(r["mcq"] for r in got) == 3
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_regroup_and_order(spark):
    rows = spark.createDataFrame([(2019, "June", "p2"), (2019, "June", "p1"), (2019, "Nov", "p1"), (2019, "June", "p1")], "year int, session string, paper string")
    assert [(g["session"], g["items"]) for g in relational.regroup(rows, "year", "session", "paper").first()["groups"]] == [("June", ["p1", "p2"]), ("Nov", ["p1"])]
    files = spark.createDataFrame([("b", "file"), ("Z", "folder"), ("a", "paper")], "name string, kind string")
    assert [r["name"] for r in files.orderBy(*relational.folder_order("name", "kind")).collect()] == ["Z", "a", "b"]


def test_files_and_backfill(spark, tmp_path):
    (tmp_path / "top" / "x").mkdir(parents=True)
    (tmp_path / "top" / "x" / "f.txt").write_text("hi")
    assert [(r["length"], r["parts"]) for r in listing.list_tree(spark, str(tmp_path / "top")).collect()] == [(2, ["x", "f.txt"])]
    docs = spark.createDataFrame([("s", [(1, 10, "old"), (1, 20, "new"), (None, 5, "x")])], "owner string, items array<struct<id:int,at:int,v:string>>")
    assert [(r["id"], r["v"]) for r in readers.backfill_items(docs, "owner", "items", "id", "at").collect()] == [(1, "new")]


def test_listing_of_many_files(spark, tmp_path):
    for i in range(10_000):
        folder = tmp_path / f"a{i % 7}" / f"b{i % 11}" if i % 3 else tmp_path / "flat"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.txt").touch()
    (tmp_path / "link").symlink_to(tmp_path)
    (tmp_path / "empty").mkdir()
    rows = listing.list_tree(spark, f"file://{tmp_path}").collect()
    assert {r["parts"][-1] for r in rows} == {f"{i}.txt" for i in range(10_000)} and len(rows) == 10_000
    assert {len(r["parts"]) for r in rows} == {2, 3} and all(r["length"] == 0 and r["modified"] for r in rows)
    assert {r["path"].removeprefix(f"file://{tmp_path}/") for r in rows} == {"/".join(r["parts"]) for r in rows}
    assert listing.list_tree(spark, str(tmp_path), 2).count() == 3334
    assert listing.list_tree(spark, str(tmp_path / "empty")).count() == 0


def test_percents_that_end_in_a_half(spark):
    marks = [(1, 24.0, 24.0 * (1 - 0.07)), (1, 416.0, 397.88), (2, 3.0, 1.0), (3, 0.0, 0.0), (4, 4.0, -0.1)]
    for rows in (marks, marks[::-1]):
        got = {r["question"]: (r["pct"], r["answers"]) for r in analytics.difficulty(spark.createDataFrame(rows, "question long, available double, earned double")).collect()}
        assert got == {1: (96, 2), 2: (33, 1), 3: (0, 1), 4: (-2, 1)}  # 420.2 of 440 is 95.5


def test_flags_find_words_beside_accents(spark):
    rows = spark.createDataFrame([("POURÈ here", "chemistry"), ("éCo2 x", "chemistry"), ("POURA_ È", "chemistry"), ("5 paé", "physics")], "whole string, subject string")
    rows = rows.select("*", *[F.lit(x).alias(n) for n, x in (("question", "q"), ("answer", "a"), ("ocr", 1.0), ("split", 1.0), ("classification", 1.0))])
    got = {r["whole"]: r["flags"] for r in corpus.validation_flags(rows).collect()}
    assert got == {"POURÈ here": ["potential_chemistry_formula_ambiguity"], "éCo2 x": [], "POURA_ È": [], "5 paé": ["potential_physics_unit_ambiguity"]}


def test_pairs_of_a_place_as_classes(spark):
    rows = [(k % 2, "a" if k % 3 else "b", k * 30_000) for k in range(1, 40)] + [(1, "a", 1), (0, "b", 7), (0, "a", 2), (0, "a", 2), (None, "a", 4)]
    found = relational.pairs_by_class(spark.createDataFrame(rows, "n int, s string, id long"), ["n", "s"], "id", F.col("id") % 4 == 0)
    assert "BroadcastNestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    whole = [r for r in rows if r[0] is not None]
    pairs = [(x, y) for x in whole for y in whole if x[:2] == y[:2] and x[2] < y[2] and x[2] % 4 == 0]
    want = {(z[2], min(q[2] for q in whole if q[:2] == z[:2]), sum((x[2] == z[2] and x[:2] == z[:2]) + (y[2] == z[2] and y[:2] == z[:2]) for x, y in pairs)) for z in whole}
    assert set(map(tuple, found.collect())) == want and found.count() == len(want)


def test_pairs_of_a_place_are_all_there(spark):
    rows = [(k % 2, "a" if k % 3 else "b", k * 30_000) for k in range(1, 60)] + [(1, "a", 1), (0, "b", 7), (0, "a", 2), (0, "a", 2), (None, "a", 4), (1, "a", 2), (1, "a", 60_000), (0, "b", 60_000), (1, "a", None)]
    whole = [r for r in rows if None not in r]
    want = Counter((x[2], y[2]) for x in whole for y in whole if x[:2] == y[:2] and x[2] < y[2] and x[2] % 2 == 0)
    for block in (3, 2048):
        found = relational.pairs_within(spark.createDataFrame(rows, "n int, s string, id long"), ["n", "s"], "id", F.col("id") % 2 == 0, block=block)
        got = found.collect()
        assert {(r["a"], r["b"]): r["n"] for r in got} == want and len(got) == len(want) and max(want.values()) > 2


def test_same_places_gives_every_pair(spark, tmp_path):
    from __spark_entry__ import queries

    rows = [(k, k % 3, "AB"[k % 2]) for k in range(1, 70)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    want = {(a[0] * 1000 + b[0], f"{a[0]},{b[0]}", 1) for a in rows for b in rows if a[1:] == b[1:] and a[0] < b[0] and a[0] % 2 == 0}
    assert set(map(tuple, queries()["same_places"](spark, str(tmp_path)).collect())) == want
