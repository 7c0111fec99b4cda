"""Findings of reviews, each with a table that would have failed before."""

import datetime
import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from inkfold.functions import cells, html, text
from inkfold.operators import layout, ledger, pages
from inkfold.plans import registry


def test_titles_that_end_inside_a_reference_equal_their_sql(spark, tmp_path):
    titles = ["The&amp;&amp; the&amp", "A &lt b &gt;", "x &copy 2026 &quot", "one & two &amp; three", "&#x27;q&#x27 and &#38", "plain"]
    bodies = [f"<html><head><title>{t}</title><script>var u = 'a&amp';</script></head><body><h1>{t}</h1></body></html>" for t in titles]
    spark.createDataFrame([(i, f"http://a.b/{i}", b) for i, b in enumerate(bodies)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.QUERIES["news_page_titles"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(registry.ORACLES["news_page_titles"]).fetchall())
    # browsers read them, and so does the operator if not told otherwise
    assert html.article_title(html.parsed(bodies[0])) == "The&& the&"
    assert "".join(html.parsed(bodies[0], strict=True).scripts[0][1]) == "var u = 'a&amp';"


def test_days_are_recovered_without_holding_a_page():
    """One page in many batches: each is given before the next one is read, and the latest day goes on over them."""
    day = datetime.date(2024, 1, 7)
    lines = [(day, None), (None, [(5, False), (9, False)]), (None, [(8, True)]), (None, [(1, False), (12, False)])]
    schema = pa.schema([("document", pa.int32()), ("page", pa.int32()), ("entry_date", pa.date32()), ("__year", pa.int32()), ("__in", pa.int32()), ("__days", pa.list_(pa.struct([("day", pa.int32()), ("near", pa.bool_())]))), ("__recovered", pa.bool_())])
    read = []

    def batches():
        for n, (date, days) in enumerate(lines):
            read.append(n)
            row = {"document": 1, "page": 1, "entry_date": date, "__year": 2024, "__in": 1, "__days": days and [{"day": d, "near": near} for d, near in days], "__recovered": False}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    out = []
    for batch in ledger._recovered(["document", "page"])(batches()):
        assert len(read) == len(out) + 1
        out += batch.to_pylist()
    # 9 is the only day from the 7th on; 8 comes before it; 12 comes after
    assert [(r["entry_date"], r["__recovered"]) for r in out] == [(day, False), (day.replace(day=9), True), (None, False), (day.replace(day=12), True)]


def odd_pages():
    """Pages of two forms with boxes in disorder: wrapped and split cells, slanted lines, a skewed page, nulls, a page of no form and one of no grid."""
    rng = random.Random(7)
    boxes, grids = [], []
    for doc in range(12):
        _, _, shares, _ = layout.FORMS[5 if doc % 3 == 2 else 0]
        rules = [100.0 + 2000 * sum(shares[:i]) for i in range(len(shares) + 1)]
        skew = 0.7 if doc in (4, 5) else 0.0
        y_rules = [600.0, *[700.0 + 60 * n for n in range(12)], 1500.0] if doc == 6 else [600.0, 640.0, 1500.0]
        grids.append((doc, 1, [1.0, 2.0, 3.0] if doc == 7 else [] if doc == 8 else rules, [] if doc == 8 else y_rules, skew, 2200.0, 3000.0, doc != 5, "th"))
        for n in range(180):
            text = rng.choice(["450", "4x7", "-", "1/3/69", "45", "0", " a  b ", "รวม", "๔๕", "คงเหลือ", "นํา", "Lorazepam", None, "x y", "12 34", "แบบ บวจ 9"])
            x, y = rng.uniform(80, 2120), rng.choice([rng.uniform(560, 1520), 700.0 + 60 * rng.randrange(12) + rng.choice([0, 0, 3, 14, 20])])
            box = [x, y, x + rng.choice([20, 60]), y + rng.choice([20, 40])]
            if n % 60 == 59:
                box[rng.randrange(4)] = None
            boxes.append((doc, 1, n, text, *box, rng.choice([0.5, 0.9, None]), rng.choice([True, False, None])))
        boxes.append((doc, 1, 999, "ชื่อการค้า (ถ้ามี) Loraze", 400.0, 300.0, 700.0, 340.0, 0.9, False))
    boxes += [(99, 1, 0, "450", 1500.0, 800.0, 1520.0, 820.0, 0.9, False), (None, 1, 0, "450", 1500.0, 800.0, 1520.0, 820.0, 0.9, False)]
    rng.shuffle(boxes)
    return boxes, grids


def test_rows_in_one_stream_are_those_of_bands_and_cells(spark):
    """Pages over batches of seven boxes give what clusters, edges and cell texts give step by step."""
    types = "doc int, page int, ord bigint, text string, x0 double, y0 double, x1 double, y1 double, confidence double, space_before boolean"
    boxes, grids = (spark.createDataFrame(t, s) for t, s in zip(odd_pages(), (types, "doc int, page int, x_rules array<double>, y_rules array<double>, skew double, width double, height double, text_layer boolean, language string")))
    facts = pages.page_facts(boxes, grids).cache()
    texts = layout.cell_text(pages.row_bands(pages.in_table(boxes, facts), grids), [*pages.PAGE, "band", "role"])
    texts = texts.select("doc", "band", "role", text.clean_text(F.col("text")).alias("text")).where("role is not null")
    want = sorted(map(tuple, texts.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = pages.rows_of(boxes, facts).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    above = {r.doc for r in rows if "trade_name" not in r.roles}
    assert above and all(r.cells["trade_name"] == "Loraze" for r in rows if r.doc in above)
    got = sorted((r.doc, r.band, role, said) for r in rows for role, said in r.cells.items() if not (role == "trade_name" and r.doc in above))
    assert len(want) > 300 and got == want
    assert all(r.raw_text == " | ".join(f"{role}={r.cells[role]}" for role in r.roles if role in r.cells) for r in rows)


def test_counts_of_pages_need_no_dates(spark):
    """What became of a page takes the number of its rows, which neither dates nor sums change: their folds aren't run for it."""
    boxes, grids = odd_pages()
    types = "doc int, page int, ord bigint, text string, x0 double, y0 double, x1 double, y1 double, confidence double, space_before boolean"
    made = pages.extract(spark.createDataFrame(boxes, types), spark.createDataFrame(grids, "doc int, page int, x_rules array<double>, y_rules array<double>, skew double, width double, height double, text_layer boolean, language string"))
    rows, outcomes = made
    assert outcomes._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = {(r.doc, r.page): r.n for r in rows.groupBy("doc", "page").agg(F.count("*").alias("n")).collect()}
    got = {(r.doc, r.page): r.rows for r in outcomes.collect()}
    assert len(got) == 12 and sum(got.values()) and {k: n for k, n in got.items() if n} == want


def test_plain_cells_are_read_as_the_general_way_reads_them(spark):
    """A blank in front leads a cell past the short ways, and changes nothing."""
    said = ["450", "0", "007", "123456789", "1234567890", "-", "", "4x7", "1/3/69", "31/2/69", "29/2/67", "0/3/69", "1/13/69", "1/3/00", "1/3/2569", "01/03/69", "1/3", "12 ขวด", "฿ 1,250", ". 5", "12 34"]
    df = spark.createDataFrame([(t,) for t in said], "t string").select("t", F.concat(F.lit(" "), "t").alias("u"))
    for read in (cells.quantity, cells.numeric_date, cells.holds_two_figures, lambda t: cells.thai_date(t)):
        assert [r.t for r in df.select("t", (~read(F.col("t")).eqNullSafe(read(F.col("u")))).alias("other")).where("other").collect()] == []
