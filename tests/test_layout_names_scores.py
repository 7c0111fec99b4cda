from pyspark.sql import functions as F

from inkfold.operators import names, scoring
from inkfold.plans import layout_queries

SF_DIR = "/root/testdata/sf0.001"


def test_line_clusters_take_all_pages(spark):
    items = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_suppkey").count().collect()
    rows = layout_queries.line_clusters(spark, SF_DIR).collect()
    assert sorted((r.page, r.n) for r in rows) == sorted((r[0], r[1]) for r in items)


def test_votes_align_inserted_and_missing_characters(spark):
    cases = {"bcd": ["abcd", "bcd", "bcd"], "abcd": ["abcd", "abcd", "bcd"], "axbcd": ["abcd", "axbcd", "axbcd"], "abcde": ["abcd", "abcde", "abcde"], "aXYZd": ["abcd", "aXYZd", "aXYZd"], "": ["", "", "x"], "ab": ["ab", "", "abc"]}
    rows = [(name, n, 1.0, text) for name, readings in cases.items() for n, text in enumerate(readings)]
    got = names.voted(spark.createDataFrame([*rows, ("ab", 3, 9.0, None)], "key string, reader int, weight double, text string"), "key").collect()
    assert {r.key: r.name for r in got} == {k: k for k in cases}


def test_misread_and_moved_rows_are_aligned_in_order(spark):
    ddl = "page int, sig string, ord int, name string"
    key = [(1, s, i, s) for i, s in enumerate("abcde")] + [(2, "a", 0, "a"), (2, "b", 1, "b"), (None, "q", 0, "q")]
    got = [(1, s, i, "c" if s == "X" else s) for i, s in enumerate("abXef")] + [(2, "b", 0, "b"), (2, "a", 1, "a"), (None, "q", 0, "q")]
    pairs = scoring.aligned_in_order(spark.createDataFrame(key, ddl), spark.createDataFrame(got, ddl), ["page"], "sig", "ord")
    assert {(r.page, r.key_sig, r.got_sig) for r in pairs.collect()} == {
        (1, "a", "a"), (1, "b", "b"), (1, "c", "X"), (1, "d", None), (1, "e", "e"), (1, None, "f"),
        (2, None, "b"), (2, "a", "a"), (2, "b", None), (None, "q", "q"),
    }
    (one,) = scoring.report(pairs.where("page = 1"), ["name"], ["page"]).collect()
    assert (one.key_rows, one.got_rows, one.missing, one.extra, one.perfect, one.name_ok) == (5, 5, 1, 1, 4, 4)


def test_readings_are_cleaned(spark):
    cases = {
        "น.ส, สุบิน ทองปลูก": "น.ส. สุบิน ทองปลูก", "เด็กขายวีระ ชัยเชิดชู": "เด็กชายวีระ ชัยเชิดชู", "นจิงสาวปรียานันท์": "นางสาวปรียานันท์", "นส วาริณี นามมนตรี": "น.ส. วาริณี นามมนตรี",
        "ดช. สมชาย": "ด.ช. สมชาย", "นสรี ดีใจ": "นสรี ดีใจ", "นาย โนน . ปาระมัด": "นาย โนน ปาระมัด", "นาย คำเขียน- สิงห์สวัสดิ": "นาย คำเขียน สิงห์สวัสดิ", "น.ส.. วาริณี นามมนตรี": "น.ส. วาริณี นามมนตรี",
        "ส.ต.อ. พงศ์ธร ใบชา": "ส.ต.อ. พงศ์ธร ใบชา", "นาย บุญถัน บุญส่ง '": "นาย บุญถัน บุญส่ง", "น.ส. ลำไย อ้วนกลม 0": "น.ส. ลำไย อ้วนกลม", "นางนวล ดี": "นางนวล ดี",
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "raw string").select("raw", names.cleaned(F.col("raw")).alias("clean")).collect()
    assert {r.raw: r.clean for r in rows} == {**cases, None: ""}


def test_names_are_settled_from_their_readings(spark):
    readings = {
        1: ["นาย สนอง ทองปลูก"] * 3, 2: ["นาง วิลา บุญโต", "นาง วิลา บุญเต", "นาง วิลา บุญโต"], 3: ["นาง ประยงค์ ซิตชม", "นาง ประยงค์ ชิดชม", "นาง ประยงค์ ชิดชม"], 4: ["นาย ณัฐพล", "นาย ญัฐพล"], 5: ["นาย กอน บุญทาทอง", None],
    }
    rows = [(k, n, 1.1 - n / 10, t) for k, own in readings.items() for n, t in enumerate(own)]
    df = spark.createDataFrame(rows, "name_id int, reader int, weight double, text string")
    got = {r.name_id: (r["name"], round(r.agreement, 4)) for r in names.read_names(df, "name_id").collect()}
    assert got == {1: ("นาย สนอง ทองปลูก", 1.0), 2: ("นาง วิลา บุญโต", 0.6667), 3: ("นาง ประยงค์ ชิดชม", 0.6667), 4: ("นาย ณัฐพล", 0.5), 5: ("นาย กอน บุญทาทอง", 1.0)}


def test_letters_that_look_alike_follow_known_spellings(spark):
    model = names.Model.of(["ชิดชม", "ธิดา", "ชลธิดา"], ["ธิดา"])
    assert model.respelt("น.ส. ชลธิตา", ["น.ส. ชลธิตา"]) == "น.ส. ชลธิดา"
    assert names.Model.of(["สมชาย"], []).respelt("นาย สมกาย", ["นาย สมกาย"]) == "นาย สมกาย"
    assert len(names.spellings("ชดใบ")) == 3 * 2 * 2 * 2 and names.spellings("ช" * 6) == ["ช" * 6]
    df = spark.createDataFrame([(1, 0, 1.0, "น.ส. ชลธิตา")], "k int, reader int, weight double, text string")
    (row,) = names.read_names(df, "k", model).collect()
    assert (row["name"], row.agreement) == ("น.ส. ชลธิดา", 0.0)
    known = names.known_words([spark.createDataFrame([("ชิดชม",), ("ธิดา",)], "word string"), spark.createDataFrame([("ธิดา",), ("ชลธิดา",)], "word string")], spark.createDataFrame([("ธิดา",)], "word string"))
    grams = {r.gram: r.weight for r in names.grams(known, "word", F.col("weight")).collect()}
    assert grams == {g: n for g, n in model.counts.items()}
    assert {r.word: r.is_known for r in names.with_known(spark.createDataFrame([("ธิดา",), ("x",)], "word string"), known).collect()} == {"ธิดา": True, "x": False}


def test_cell_scores_and_review_rates(spark):
    ddl = "page int, ord int, date string, recipient_id string, trade_name string, received int, needs_review boolean"
    key = [(1, 0, "1 ม.ค. 68", "1 2345", "Loraze p.", 5, None), (1, 1, "2  x", "77", "a", None, None), (1, 2, "3", "8", "b", 1, None)]
    got = [(1, 0, "1 ม.ค. 68", "12345", "lorazep", 5, False), (1, 1, "2 x", "77", "a", None, True), (1, 2, "4", "8", "b", 2, False), (1, 3, "9", "9", "c", 9, True)]
    pairs = scoring.zipped(spark.createDataFrame(key, ddl), spark.createDataFrame(got, ddl), ["page"], "ord")
    rows = {r.column: (r.right, r.n) for r in scoring.cell_scores(pairs, ["date", "recipient_id", "trade_name", "received"], ["received"], "recipient_id").collect()}
    assert rows == {"date": (2, 3), "recipient_id": (2, 3), "trade_name": (2, 3), "received": (2, 3), "recipient_id*": (3, 3), "all cells": (8, 12)}
    both = scoring.aligned_in_order(spark.createDataFrame(key, ddl), spark.createDataFrame(got, ddl), ["page"], "recipient_id", "ord")
    (rate,) = scoring.review_rates(both, ["date", "recipient_id", "trade_name", "received"], ["page"]).collect()
    assert (rate.rows, rate.review_rate, rate.wrong, rate.unflagged) == (4, 0.5, 2, 1)
    (page,) = scoring.page_quality(spark.createDataFrame([(1, 0.5), (1, None), (1, 0.25)], "page int, confidence double"), ["page"]).collect()
    assert (page["rows"], page.confidence) == (3, 0.375)
