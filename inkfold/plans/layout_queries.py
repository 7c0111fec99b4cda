"""Queries of page layout, name readings and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfold.operators import layout, names, scoring
from inkfold.plans.fixtures import literal, rows_df, rows_sql

FORM_EDGES = [sum(layout.FORMS[0][2][:i]) * 2000 + 100 for i in range(len(layout.FORMS[0][2]) + 1)]
EDGES_SQL = "[" + ", ".join(repr(e) for e in FORM_EDGES) + "]"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from lineitem: a page for each supplier, x from the part, y from the order."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        F.col("l_suppkey").alias("page"), F.row_number().over(_order()).cast("bigint").alias("ord"), (F.col("l_partkey") % 2300).cast("double").alias("cx"), (F.col("l_orderkey") % 1500).cast("double").alias("cy"),
        (F.col("l_quantity") + 10).alias("height"), F.col("l_partkey").cast("string").alias("text"),
    )


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


BOXES = """(SELECT l_suppkey AS page, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS ord,
  CAST(l_partkey % 2300 AS DOUBLE) AS cx, CAST(l_orderkey % 1500 AS DOUBLE) AS cy, l_quantity + 10 AS height, CAST(l_partkey AS VARCHAR) AS text FROM lineitem)"""


def box_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = boxes(spark, sf_dir).withColumn("col", layout.interval_of(F.array(*map(F.lit, FORM_EDGES)), F.col("cx")))
    role = layout.role_of(F.lit(layout.FORMS[0][0]), F.col("col"))
    return placed.select("page", "ord", "col", role.alias("role"), layout.is_anchor(role, F.col("text")).alias("anchor"))


ROLES_SQL = f"""
SELECT page, ord, CASE WHEN n BETWEEN 1 AND {len(FORM_EDGES) - 1} THEN CAST(n - 1 AS INT) END AS col, CASE WHEN n BETWEEN 1 AND {len(FORM_EDGES) - 1} THEN string_split('{layout.FORMS[0][1]}', ' ')[n] END AS role,
  n BETWEEN 8 AND 10 OR n = 7 AS anchor
FROM (SELECT *, len(list_filter({EDGES_SQL}, lambda e: e <= cx)) AS n FROM {BOXES})
"""

WIDTHS = [(0, [w * 1500 for w in layout.FORMS[0][2]], layout.FORMS[0][0]), (1, [w * 900 for w in layout.FORMS[2][2]], layout.FORMS[2][0]), (2, [1.0] * 12, None), (3, [1.0] * 5, None), (4, [w * 700 + (3 if i == 2 else 0) for i, w in enumerate(layout.FORMS[5][2])], layout.FORMS[5][0])]


def forms_by_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_df(spark, "ord int, widths array<double>", [w[:2] for w in WIDTHS]).select("ord", layout.form_by_widths(F.col("widths"))["code"].alias("code"))


TITLES = [(0, "บัญชี จำหน่ายยาเสพติด ให้โทษใน ประเภท ๒", layout.FORMS[3][0]), (1, "รายงาน การดำเนินกิจการจำหน่ายยาเสพติดให้โทษ", layout.FORMS[4][0]), (2, "other", None)]


def forms_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_df(spark, "ord int, body string", [t[:2] for t in TITLES]).select("ord", layout.form_by_title(F.col("body")).alias("code"))


def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = boxes(spark, sf_dir).withColumn("col", layout.interval_of(F.array(*map(F.lit, FORM_EDGES)), F.col("cx")))
    return layout.clusters(made, ["page"], 0.6).groupBy("page").agg(F.max("line").alias("last_line"), F.count("*").alias("n"))


CLUSTERS_SQL = f"""
WITH RECURSIVE placed AS MATERIALIZED (
  SELECT page, cy, row_number() OVER (PARTITION BY page ORDER BY cy, ord) AS k, CASE WHEN n BETWEEN 1 AND {len(FORM_EDGES) - 1} THEN CAST(n - 1 AS INT) END AS col, unit
  FROM (SELECT *, len(list_filter({EDGES_SQL}, lambda e: e <= cx)) AS n FROM {BOXES})
  JOIN (SELECT page, list_sort(list(height))[count(*) // 2 + 1] AS unit FROM {BOXES} GROUP BY page) USING (page)
), lines AS (
  SELECT page, 0::BIGINT AS k, -1 AS line, 0.0::DOUBLE AS total, 0 AS held, CAST([] AS STRUCT(c INT, y DOUBLE)[]) AS own FROM (SELECT DISTINCT page FROM placed)
  UNION ALL
  SELECT page, k, CASE WHEN joins THEN line ELSE line + 1 END, CASE WHEN joins THEN total + cy ELSE cy END, CASE WHEN joins THEN held + 1 ELSE 1 END, CASE WHEN joins THEN list_append(own, box) ELSE [box] END
  FROM (
    SELECT p.page, p.k, l.line, l.total, l.held, l.own, p.cy, {{'c': p.col, 'y': p.cy}} AS box,
      coalesce(l.held > 0 AND p.cy - l.total / l.held <= 0.6 * p.unit AND len(list_filter(l.own, lambda o: o.c = p.col AND abs(o.y - p.cy) > 0.35 * p.unit)) = 0, false) AS joins
    FROM lines l JOIN placed p ON p.page = l.page AND p.k = l.k + 1)
)
SELECT page, max(line) AS last_line, count(*) AS n FROM lines WHERE k > 0 GROUP BY page
"""


def row_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = boxes(spark, sf_dir).select("page", "cy").distinct().withColumns({"top": F.lit(-50.0), "bottom": F.lit(2000.0)})
    return layout.row_edges(centres, ["page"]).select("page", F.col("band").cast("int").alias("band"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


EDGES_OF_ROWS = f"""
SELECT page, CAST(row_number() OVER w - 1 AS INT) AS band, round(coalesce((lag(cy) OVER w + cy) / 2, CASE WHEN n = 1 THEN -50.0 ELSE cy - spread / (n - 1) / 2 END), 4) AS low, round(coalesce((cy + lead(cy) OVER w) / 2, 2000.0), 4) AS high
FROM (SELECT page, cy, count(*) OVER (PARTITION BY page) AS n, max(cy) OVER (PARTITION BY page) - min(cy) OVER (PARTITION BY page) AS spread FROM (SELECT DISTINCT page, cy FROM {BOXES}))
WINDOW w AS (PARTITION BY page ORDER BY cy)
"""

WORDS = [(1, 0, "45", 0.0, 0.0, 10.0, 10.0, False), (1, 1, "0", 10.2, 0.0, 15.0, 10.0, False), (1, 2, "x", 20.0, 0.0, 25.0, 10.0, False), (2, 0, "a", 0.0, 0.0, 5.0, 10.0, False), (2, 1, "b", 0.0, 12.0, 5.0, 22.0, False), (2, 2, "c", 5.0, 12.0, 9.0, 22.0, True)]


def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cell_text(rows_df(spark, "cell int, ord int, text string, x0 double, y0 double, x1 double, y1 double, space_before boolean", WORDS), ["cell"])


def merged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("cell"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("text"), F.col("p_retailprice").alias("x0"), (F.col("p_partkey") % 7).cast("double").alias("y0"), (F.col("p_retailprice") + 3).alias("x1"), (F.col("p_partkey") % 11).cast("double").alias("y1"), (F.col("p_partkey") % 100 / 100).alias("confidence"))
    return layout.merged_line(words, ["cell"])


MERGED_SQL = """
SELECT p_size AS cell, string_agg(p_brand, ' ' ORDER BY p_retailprice, p_partkey) AS text, min(p_retailprice) AS x0, min(CAST(p_partkey % 7 AS DOUBLE)) AS y0, max(p_retailprice + 3) AS x1, max(CAST(p_partkey % 11 AS DOUBLE)) AS y1, min(p_partkey % 100 / 100) AS confidence FROM part GROUP BY 1
"""

BANDS = [(0, {"date": "1/2/69"}, False, True), (1, {"issued_to": "รวม", "received": "5", "issued": "6"}, False, False), (2, {"received": "5", "balance": "6"}, False, True), (3, {"balance_brought": "7"}, True, True), (4, {"balance_brought": "7"}, False, False), (5, {"generic_name": "Diazepam"}, False, True), (6, {"remark": "x"}, True, False)]


def row_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_df(spark, "ord int, cells map<string,string>, first boolean", [b[:3] for b in BANDS]).select("ord", layout.accepts_row(F.col("cells"), F.col("first")).alias("accepted"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an answer key; the result lacks every eleventh row, has every thirteenth twice, and misreads some fields."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = events.select((F.col("user_id") % 50).alias("page"), F.col("event_type").alias("sig"), F.col("event_id").alias("ord"), F.col("value").cast("int").alias("issued"), F.concat(F.col("event_type"), F.col("user_id").cast("string")).alias("name"))
    got = base.where("ord % 11 <> 0").withColumns({"issued": F.when(F.col("ord") % 7 == 0, F.col("issued") + 1).otherwise(F.col("issued")), "name": F.when(F.col("ord") % 5 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name"))})
    return scoring.aligned(base, got.unionByName(got.where("ord % 13 = 0")), ["page"], "sig", "ord")


def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.report(_pairs(spark, sf_dir), ["issued", "name"], ["page"]).select("page", "key_rows", "got_rows", "missing", "extra", "perfect", "issued_ok", "name_ok", F.round("issued_share", 6).alias("issued_share"))


REPORT_SQL = """
WITH base AS (SELECT user_id % 50 AS page, event_type AS sig, event_id AS ord, CAST(trunc(value) AS INT) AS issued, event_type || user_id AS name FROM events),
once AS (SELECT page, sig, ord, CASE WHEN ord % 7 = 0 THEN issued + 1 ELSE issued END AS issued, CASE WHEN ord % 5 = 0 THEN name || 'x' ELSE name END AS name FROM base WHERE ord % 11 <> 0),
got AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE ord % 13 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY page, sig ORDER BY ord) AS n FROM base), g AS (SELECT *, row_number() OVER (PARTITION BY page, sig ORDER BY ord) AS n FROM got),
p AS (SELECT coalesce(k.page, g.page) AS page, k.ord AS ko, g.ord AS go, k.issued AS ki, g.issued AS gi, k.name AS kn, g.name AS gn FROM k FULL JOIN g ON k.page = g.page AND k.sig = g.sig AND k.n = g.n)
SELECT page, count(ko) AS key_rows, count(go) AS got_rows, count(*) FILTER (go IS NULL) AS missing, count(*) FILTER (ko IS NULL) AS extra,
  count(*) FILTER (ki = gi AND lower(kn) = lower(gn)) AS perfect, count(*) FILTER (ki = gi) AS issued_ok, count(*) FILTER (lower(kn) = lower(gn)) AS name_ok,
  round(count(*) FILTER (ki = gi) / count(*) FILTER (ko IS NOT NULL AND go IS NOT NULL), 6) AS issued_share
FROM p GROUP BY page
"""


def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.groupBy("p_size").agg(F.round(scoring.error_rate(F.col("p_name"), F.col("p_type")), 6).alias("error_rate"))


RATES_SQL = "SELECT p_size, round(sum(levenshtein(p_name, p_type)) / sum(greatest(length(p_name), 1)), 6) AS error_rate FROM part GROUP BY 1"


def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 40).alias("page"), F.col("o_orderkey").alias("ord"))
    pairs = scoring.zipped(orders, orders.where("ord % 3 <> 0"), ["page"], "ord")
    return pairs.groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.col("key_ord") == F.col("got_ord")).alias("same"))


ZIPPED_SQL = """
WITH o AS (SELECT o_custkey % 40 AS page, o_orderkey AS ord FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ord) AS n FROM o),
g AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ord) AS n FROM o WHERE ord % 3 <> 0)
SELECT k.page, count(*) AS n, count(*) FILTER (k.ord = g.ord) AS same FROM k JOIN g USING (page, n) GROUP BY 1
"""


def name_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    weight = F.when(F.col("p_partkey") % 2 == 0, 3).otherwise(1)
    return names.grams(parts, "p_type", weight)


GRAMS_SQL = """
SELECT gram, n, CAST(sum(w) AS BIGINT) AS weight FROM (
  SELECT w, CAST(n AS INT) AS n, substr(t, e - n + 1, n) AS gram FROM (
    SELECT '^^^' || p_type || '$' AS t, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END AS w, unnest(range(4, length(p_type) + 5)) AS e FROM part), range(1, 5) AS r(n))
GROUP BY 1, 2
"""


def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    model = names.grams(parts, "p_type", F.lit(1))
    return names.scored(parts, "p_type", model).select("word", F.round("per_char", 5).alias("per_char"))


SCORES_SQL = f"""
WITH places AS (SELECT w AS word, e, CAST(n AS INT) AS n, substr(t, e - n + 1, n) AS gram, substr(t, e - n + 1, n - 1) AS context FROM (SELECT DISTINCT p_type AS w, '^^^' || p_type || '$' AS t, unnest(range(4, length(p_type) + 5)) AS e FROM part), range(1, 5) AS r(n)),
model AS (SELECT substr(t, e - n + 1, n) AS gram, CAST(n AS INT) AS n, count(*) AS hits FROM (SELECT '^^^' || p_type || '$' AS t, unnest(range(4, length(p_type) + 5)) AS e FROM part), range(1, 5) AS r(n) GROUP BY 1, 2),
contexts AS (SELECT substr(gram, 1, n - 1) AS context, n, sum(hits) AS total FROM model GROUP BY 1, 2)
SELECT word, round(avg(lp), 5) AS per_char FROM (
  SELECT word, e, ln(sum((coalesce(hits, 0) + 0.01) / (coalesce(total, 0) + 0.8) * [{", ".join(map(literal, names.LAMBDAS))}][n])) AS lp
  FROM places LEFT JOIN model USING (gram, n) LEFT JOIN contexts USING (context, n) GROUP BY word, e)
GROUP BY word
"""

READINGS = [(1, 0, 1.1, "abcd"), (1, 1, 1.0, "abxd"), (1, 2, 0.9, "abxd"), (2, 0, 1.0, "ef"), (2, 1, 1.0, "eg")]


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = rows_df(spark, "name_id int, reader int, weight double, text string", READINGS)
    return names.agreement(readings, names.voted(readings, "name_id"), "name_id").select("name_id", "name", F.round("agreement", 4).alias("agreement"))


TITLED = [
    (0, "นางสาง สมศรี", "นางสาง สมศรี"), (1, "นาย ก", "นาย ก"), (2, "นายย ก", "นายย ก"), (3, "สมศรี", "สมศรี"), (4, "เด็กขายวีระ", "เด็กชายวีระ"), (5, "นส วาริณี", "น.ส. วาริณี"), (6, "นสรี ดีใจ", "นสรี ดีใจ"),
    (7, "นจิงสาวปรียา", "นางสาวปรียา"), (8, "นาข สม", "นาย สม"), (9, "นาวิน", "นาวิน"), (10, "ดช. สมชาย", "ด.ช. สมชาย"),
]


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_df(spark, "ord int, raw string", [t[:2] for t in TITLED]).select("ord", names.titled(F.col("raw")).alias("shown"))


TABLE = [
    ("layout_box_roles", box_roles, ROLES_SQL),
    ("layout_forms_by_widths", forms_by_widths, rows_sql("ord int, code varchar", [(w[0], w[2]) for w in WIDTHS])),
    ("layout_forms_by_title", forms_by_title, rows_sql("ord int, code varchar", [(t[0], t[2]) for t in TITLES])),
    ("layout_line_clusters", line_clusters, CLUSTERS_SQL),
    ("layout_row_edges", row_edges, EDGES_OF_ROWS),
    ("layout_cell_text", cell_texts, rows_sql("cell int, text varchar", [(1, "450 x"), (2, "a b c")])),
    ("layout_merged_line", merged_words, MERGED_SQL),
    ("layout_row_acceptance", row_acceptance, rows_sql("ord int, accepted boolean", [(b[0], b[3]) for b in BANDS])),
    ("score_report", score_report, REPORT_SQL),
    ("score_error_rate", error_rates, RATES_SQL),
    ("score_zipped", zipped, ZIPPED_SQL),
    ("names_grams", name_grams, GRAMS_SQL),
    ("names_per_char", name_scores, SCORES_SQL),
    ("names_votes", votes, rows_sql("name_id int, name varchar, agreement double", [(1, "abxd", 0.6667), (2, "ef", 0.5)])),
    ("names_titles", titles, rows_sql("ord int, shown varchar", [(t[0], t[2]) for t in TITLED])),
]
