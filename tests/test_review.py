from pyspark.sql import Row
from pyspark.sql import functions as F

from markwright.operators import review


def test_paper_pick(spark):
    wanted = spark.createDataFrame([(1, "Bio_2019_Paper_1_Variant_2", "ms"), (2, "Bio_2019_Paper_2", "qp")], "id int, stem string, kind string")
    files = spark.createDataFrame([("bio_2019_paper_1", "Bio_2019_Paper_1_QP.pdf"), ("bio_2019_paper_1", "Bio_2019_Paper_1_MS.pdf"), ("bio_2019_paper_2", "Bio_2019_Paper_2_QP.pdf"), ("bio_2019_paper_2", "A_QP.pdf")], "stem_key string, name string")
    assert sorted(map(tuple, review.paper_pick(wanted, files).collect())) == [(1, "Bio_2019_Paper_1_MS.pdf", 2), (2, "Bio_2019_Paper_2_QP.pdf", 0)]


def test_comment_upsert(spark):
    rows = spark.createDataFrame([([Row(index=0, text="a")],)], "cs array<struct<index:int,text:string>>")
    got = rows.select(review.comment_upsert(F.col("cs"), F.lit(0), F.lit("b")).alias("x"), review.comment_upsert(F.col("cs"), F.lit(1), F.lit("c")).alias("y")).first()
    assert [tuple(c) for c in got["x"]] == [(0, "b")] and [tuple(c) for c in got["y"]] == [(0, "a"), (1, "c")]


def test_prose_run_bridges_one_short_line(spark):
    lines = [["one two three four", "ok", "five six seven eight"], ["a b c d", "x", "y", "e f g h i"], []]
    rows = spark.createDataFrame([(x,) for x in lines], "ls array<string>")
    assert [r["n"] for r in rows.select(review.prose_run(F.col("ls")).alias("n")).collect()] == [9, 5, 0]


def test_reclaim_leaks(spark):
    rows = [("p", 1, 1, "first answer\n2 second answer"), ("p", 2, 2, ""), ("p", 3, 3, None), ("q", 1, 2, "")]
    got = review.reclaim_leaks(spark.createDataFrame(rows, "paper string, at int, number int, scheme string"), "paper", "at")
    assert [tuple(r) for r in got.collect()] == [("p", 2, 2, 1, "second answer")]


def test_rebuild_reason(spark):
    kinds = ", ".join(f"{f} string" for f in review.INDEX_FIELDS)
    same, other = {f: "1" for f in review.INDEX_FIELDS}, {f: "1" for f in review.INDEX_FIELDS} | {"record_count": "2", "index_version": "9"}
    full, bare = Row(manifest=True, records=True, embeddings=True), Row(manifest=True, records=False, embeddings=True)
    rows = [(Row(**same), Row(**same), full, True), (Row(**same), Row(**other), full, True), (Row(**same), Row(**other), full, False), (Row(**same), Row(**same), bare, True)]
    frame = spark.createDataFrame(rows, f"m struct<{kinds.replace(' ', ':')}>, c struct<{kinds.replace(' ', ':')}>, p struct<manifest:boolean,records:boolean,embeddings:boolean>, auto boolean".replace(",:", ", "))
    got = [r["r"] for r in frame.select(review.rebuild_reason(F.col("m"), F.col("c"), F.col("p"), F.col("auto")).alias("r")).collect()]
    assert got == ["up_to_date", "record_count_changed", "auto_rebuild_disabled", "missing_records"]


def test_feedback(spark):
    rows = spark.createDataFrame([("partially_correct", 50.0, ["a", "b", "c"], None), ("weak", 0.0, [], "C")], "l string, p double, m array<string>, o string")
    got = [r["t"] for r in rows.select(review.feedback_text(F.col("l"), F.col("p"), F.col("m"), F.col("o")).alias("t")).collect()]
    assert got == ["Partly right (50.0%). Add: a; b", "The right option is C."]


def test_companions(spark):
    files = spark.createDataFrame([("eng_2015_qp.pdf", "f"), ("eng_2015_source.pdf", "f"), ("eng_2015_ms.pdf", "f"), ("eng_2015_source.pdf", "g")], "name string, folder string")
    assert sorted((r["folder"], r["file"], r["companion"], r["score"]) for r in review.companions(files).collect()) == [("f", "eng_2015_ms.pdf", "eng_2015_source.pdf", 13), ("f", "eng_2015_qp.pdf", "eng_2015_source.pdf", 13)]


def test_readings_are_compared_once_before_and_once_after_a_repair(spark):
    rows = spark.createDataFrame([(p, at, f"{'log x = 2 ' * at}line {p}", 0.7) for p in range(3) for at in range(3)], "page long, at int, text string, confidence double")
    repairs = rows.where("at = 0").select("page", F.lit("lost").alias("text"))
    found = review.repaired_readings(rows, repairs, "page")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    first = {r["page"]: (False, r["text"]) for r in review.scored_readings(rows, "page").where("rank = 1").collect()}
    assert {r["page"]: (r["accepted"], r["text"]) for r in found.collect()} == first
