"""Queries of the ledger half: ordered repair over ledgers made from lineitem, and cleaners on literal cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfold.functions import cells, text
from inkfold.operators import ledger
from inkfold.plans.fixtures import rows_df, rows_sql

KEYS = ["document_id", "page_number"]
#: A ledger: a page for each supplier and year; stock starts at 1000; cells are lost where a key's remainder is zero.
LEDGER = """
SELECT document_id, page_number, ord, named, form_code, l_shipdate, l_orderkey, l_partkey,
  CASE WHEN u_b THEN NULL ELSE bal - moved END AS balance_brought, CASE WHEN lost OR u_r OR moved < 0 THEN NULL ELSE moved END AS received,
  CASE WHEN lost OR u_i OR moved > 0 THEN NULL ELSE -moved END AS issued, CASE WHEN u_z THEN NULL ELSE bal END AS balance, u_b, u_r, u_i, u_z
FROM (
  SELECT *, CAST(1000 + sum(moved) OVER (PARTITION BY document_id, page_number ORDER BY ord) AS INT) AS bal FROM (
    SELECT l_suppkey AS document_id, year(l_shipdate) AS page_number, l_shipdate, l_orderkey, l_partkey,
      row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
      l_linenumber = 1 AND l_orderkey % 5 = 0 AS named, CASE WHEN l_partkey % 3 = 0 THEN 'A' ELSE 'B' END AS form_code,
      CAST(l_quantity AS INT) * CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE -1 END AS moved, l_partkey % 17 = 0 AS lost, l_orderkey % 7 = 0 AS u_b,
      l_partkey % 3 = 0 AND l_partkey % 13 = 0 AND l_partkey % 17 <> 0 AS u_r, l_partkey % 3 <> 0 AND l_partkey % 13 = 0 AND l_partkey % 17 <> 0 AS u_i, l_orderkey % 11 = 0 AS u_z
    FROM lineitem)
)
"""


def rows(spark: SparkSession, sf_dir: str, ledger_sql: str = LEDGER) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    made = spark.sql(ledger_sql.replace("FROM lineitem", "FROM {lineitem}"), lineitem=items)
    lost = [F.when(F.col(u), F.lit(q)) for u, q in zip(("u_b", "u_r", "u_i", "u_z"), ledger.QUANTITIES)]
    return made.withColumn("unread", F.array_compact(F.array(*lost))).withColumn("notes", F.array().cast("array<string>"))


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = ledger.line_numbers(rows(spark, sf_dir), KEYS, ["ord"])
    return numbered.select(*KEYS, "ord", "form_code", "sequence")


NUMBERS_SQL = f"""
SELECT document_id, page_number, ord, form_code, row_number() OVER (PARTITION BY document_id, page_number, island ORDER BY ord) AS sequence FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY document_id, page_number ORDER BY ord) AS island FROM (
    SELECT *, CASE WHEN form_code IS DISTINCT FROM lag(form_code) OVER (PARTITION BY document_id, page_number ORDER BY ord) THEN 1 ELSE 0 END AS fresh FROM ({LEDGER})))
"""


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ledger.reconcile(rows(spark, sf_dir), KEYS)
    return done.select(*KEYS, "ord", *ledger.QUANTITIES, F.size("unread").alias("n_unread"), F.size("notes").alias("n_notes"))


RECONCILED_SQL = f"""
WITH RECURSIVE ledger AS MATERIALIZED (SELECT * FROM ({LEDGER})),
lines AS (
  SELECT document_id, page_number, 0::BIGINT AS ord, NULL::INT AS b, NULL::INT AS r, NULL::INT AS i, NULL::INT AS z, 0 AS n_unread, 0 AS n_notes, NULL::INT AS running
  FROM (SELECT DISTINCT document_id, page_number FROM ledger)
  UNION ALL
  SELECT document_id, page_number, ord, b, r, i, z, n_unread, n_notes + CASE WHEN b + coalesce(r, 0) - coalesce(i, 0) <> z THEN 1 ELSE 0 END,
    CASE WHEN z IS NOT NULL THEN z WHEN coalesce(r, 0) = 0 AND coalesce(i, 0) = 0 AND running IS NULL THEN NULL ELSE coalesce(b, running, 0) + coalesce(r, 0) - coalesce(i, 0) END
  FROM (
    SELECT document_id, page_number, ord, b, z, running,
      CASE WHEN moves AND z > running THEN z - running ELSE r END AS r, CASE WHEN moves AND z < running THEN running - z ELSE i END AS i,
      n_unread - CASE WHEN moves AND (z < running AND u_i OR z > running AND u_r) THEN 1 ELSE 0 END AS n_unread, n_notes + CASE WHEN moves THEN 1 ELSE 0 END AS n_notes
    FROM (
      SELECT *, coalesce(running IS NOT NULL AND z IS NOT NULL AND z <> running AND r IS NULL AND i IS NULL AND (b IS NULL OR b = running), false) AS moves
      FROM (
        SELECT document_id, page_number, ord, running, u_i, u_r, n_notes + CASE WHEN v >= 0 THEN 1 ELSE 0 END AS n_notes, CASE WHEN v >= 0 THEN 0 ELSE n_unread END AS n_unread,
          CASE WHEN v >= 0 AND u_b THEN v ELSE b END AS b, CASE WHEN v >= 0 AND u_r THEN v ELSE r END AS r,
          CASE WHEN v >= 0 AND u_i THEN v ELSE i END AS i, CASE WHEN v >= 0 AND u_z THEN v ELSE z END AS z
        FROM (
          SELECT *, CASE WHEN n_unread <> 1 THEN NULL WHEN u_z THEN b + coalesce(r, 0) - coalesce(i, 0) WHEN u_b THEN z - coalesce(r, 0) + coalesce(i, 0)
            WHEN u_i THEN b + coalesce(r, 0) - z WHEN u_r THEN z - b + coalesce(i, 0) END AS v
          FROM (
            SELECT l.document_id, l.page_number, l.ord, CASE WHEN l.named THEN NULL ELSE p.running END AS running,
              CASE WHEN l.u_b AND p.z IS NOT NULL THEN p.z ELSE l.balance_brought END AS b, l.received AS r, l.issued AS i, l.balance AS z,
              l.u_b AND p.z IS NULL AS u_b, l.u_r, l.u_i, l.u_z, CASE WHEN l.u_b AND p.z IS NOT NULL THEN 1 ELSE 0 END AS n_notes,
              CAST(l.u_b AND p.z IS NULL AS INT) + CAST(l.u_r AS INT) + CAST(l.u_i AS INT) + CAST(l.u_z AS INT) AS n_unread
            FROM lines p JOIN ledger l ON l.document_id = p.document_id AND l.page_number = p.page_number AND l.ord = p.ord + 1)))))
)
SELECT document_id, page_number, ord, b AS balance_brought, r AS received, i AS issued, z AS balance, n_unread, n_notes FROM lines WHERE ord > 0
"""


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date cells over events as lines: every third has a date, every tenth is unreadable, the rest are blank."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    dated, broken = F.col("event_id") % 3 == 0, F.col("event_id") % 10 == 1
    rows = events.select(
        F.col("user_id").alias("page"), F.col("event_id").alias("ord"), F.when(dated, F.date_format("ts", "d/M/yy")).when(broken, "unreadable").otherwise(F.lit("-")).alias("date_text"),
        F.when(dated, F.to_date("ts")).alias("entry_date"), dated.alias("date_certain"), F.array(F.lit("date could not be read"), F.lit("other")).alias("notes"),
    )
    out = ledger.carry_dates(rows, ["page"], ["ord"])
    return out.select("page", "ord", "entry_date", "date_certain", F.size("notes").alias("n_notes"))


CARRIED_SQL = """
WITH lines AS (
  SELECT user_id AS page, event_id AS ord, event_id % 3 = 0 AS dated, event_id % 10 = 1 AND event_id % 3 <> 0 AS broken, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS d FROM events
), marked AS (
  SELECT *, max(CASE WHEN dated OR broken THEN ord END) OVER (PARTITION BY page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM lines
)
SELECT m.page, m.ord, CASE WHEN m.dated OR m.broken THEN m.d ELSE a.d END AS entry_date, CASE WHEN m.dated OR m.broken THEN m.dated ELSE coalesce(a.dated, false) END AS date_certain,
  CASE WHEN NOT m.dated AND NOT m.broken AND a.d IS NOT NULL THEN 1 ELSE 2 END AS n_notes
FROM marked m LEFT JOIN lines a ON a.page = m.page AND a.ord = m.anchor
"""


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select("user_id", F.col("event_id").alias("ord"), F.to_date("ts").alias("entry_date"), (F.col("event_id") % 4 != 0).alias("date_certain"))
    return ledger.modal_months(rows, ["user_id"])


MONTHS_SQL = """
SELECT user_id, month FROM (
  SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n, min(event_id) AS first FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1
"""


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of events: dates by day of the month; every fifth is unread but for its digits, every ninth is of another month."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day, unread, off = F.dayofmonth("ts"), F.col("event_id") % 5 == 0, F.col("event_id") % 9 == 1
    date = F.when(unread, None).when(off, F.date_add(F.to_date("ts"), 62)).otherwise(F.to_date("ts"))
    rows = events.select(
        F.lit(1).alias("document"), F.date_format("ts", "yyyyMM").cast("int").alias("page"), F.col("event_id").alias("ord"), F.when(unread, day.cast("string")).otherwise(F.date_format(date, "d/M/yy")).alias("date_text"),
        date.alias("entry_date"), (~unread).alias("date_certain"), F.array().cast("array<string>").alias("notes"),
    )
    return ledger.settle_dates(rows, "document", "page").select("page", "ord", "entry_date", "date_certain", F.size("notes").alias("n_notes"))


SETTLED_SQL = """
WITH RECURSIVE read AS MATERIALIZED (
  SELECT event_id AS ord, CAST(strftime(ts, '%Y%m') AS INT) AS page, event_id % 5 = 0 AS unread, day(ts) AS own_day,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 9 = 1 THEN CAST(ts AS DATE) + 62 ELSE CAST(ts AS DATE) END AS d FROM events
), months AS (
  SELECT page, month FROM (SELECT page, date_trunc('month', d) AS month, count(*) AS n, min(ord) AS first FROM read WHERE NOT unread GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, first) = 1
), placed AS MATERIALIZED (
  SELECT r.page, ord, row_number() OVER (PARTITION BY r.page ORDER BY ord) AS k, year(month) AS y, month(month) AS m, coalesce(date_trunc('month', d) <> month, false) AS off,
    CASE WHEN unread OR date_trunc('month', d) <> month THEN NULL ELSE d END AS d, NOT unread AS sure,
    CASE WHEN unread THEN CAST(own_day AS VARCHAR) ELSE CAST(day(d) AS VARCHAR) || CAST(month(d) AS VARCHAR) || strftime(d, '%y') END AS digits
  FROM read r JOIN months USING (page)
), lines AS (
  SELECT page, 0::BIGINT AS k, NULL::BIGINT AS ord, NULL::DATE AS entry_date, false AS date_certain, 0 AS n_notes, 0 AS latest FROM (SELECT DISTINCT page FROM placed)
  UNION ALL
  SELECT page, k, ord, coalesce(d, found), sure AND NOT off, CAST(off AS INT) + CAST(d IS NULL AND found IS NOT NULL AS INT), coalesce(day(coalesce(d, found)), latest)
  FROM (
    SELECT *, CASE WHEN len(fits) = 1 THEN try_cast(printf('%04d-%02d-%02d', y, m, fits[1]) AS DATE) WHEN len(near) = 1 THEN try_cast(printf('%04d-%02d-%02d', y, m, near[1]) AS DATE) END AS found
    FROM (
      SELECT *, list_filter(fits, lambda x: contains(substr(digits, len(CAST(x AS VARCHAR)) + 1, 2), CAST(m AS VARCHAR))) AS near
      FROM (
        SELECT p.*, l.latest, list_filter(list_distinct([CAST(substr(p.digits, 1, 1) AS INT), CASE WHEN len(p.digits) > 1 THEN CAST(substr(p.digits, 1, 2) AS INT) END]), lambda x: x IS NOT NULL AND x >= l.latest AND x <= 31) AS fits
        FROM lines l JOIN placed p ON p.page = l.page AND p.k = l.k + 1)))
)
SELECT page, ord, entry_date, date_certain, n_notes FROM lines WHERE k > 0
"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", F.col("p_retailprice").alias("x"))
    out = ledger.merged_positions(parts, ["p_size"], "x", 20.0)
    return out.select("p_size", "run", F.round("position", 4).alias("position"), "n")


MERGED_SQL = """
SELECT p_size, CAST(run AS BIGINT) AS run, round(avg(x), 4) AS position, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY p_size ORDER BY x) AS run FROM (
    SELECT p_size, p_retailprice AS x, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_size ORDER BY p_retailprice) > 20 THEN 1 ELSE 0 END AS fresh FROM part))
GROUP BY 1, 2
"""


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy("o_custkey").agg(ledger.upper_median(F.collect_list("o_totalprice")).alias("median"))


MEDIANS_SQL = "SELECT o_custkey, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS median FROM orders GROUP BY 1"


def output(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows(spark, sf_dir).withColumns({
        "entry_date_text": F.when(F.col("l_partkey") % 2 == 0, F.date_format("l_shipdate", "d/M/yyyy")).otherwise(F.lit("")), "date_cell": F.when(F.col("l_partkey") % 3 == 0, "cell"),
        "generic_name": F.when(F.col("named"), F.lit("drug")), "trade_name": F.lit(None).cast("string"), "batch_no": F.col("l_partkey").cast("string"), "received_from": F.lit(None).cast("string"),
        "issued_to": F.lit("ward"), "recipient_id": F.lit(""),
    })
    return ledger.output_rows(made, KEYS, ["ord"]).select(*KEYS, *ledger.OUTPUT)


OUTPUT_SQL = f"""
SELECT n.document_id, n.page_number, n.sequence, CASE WHEN l_partkey % 2 = 0 THEN strftime(l_shipdate, '%-d/%-m/%Y') WHEN l_partkey % 3 = 0 THEN 'cell' ELSE '' END AS date,
  CASE WHEN named THEN 'drug' ELSE '' END AS generic_name, '' AS trade_name, CAST(l_partkey AS VARCHAR) AS batch_no, '' AS received_from, 'ward' AS issued_to, '' AS recipient_id,
  balance_brought, received, issued, balance
FROM ({LEDGER}) l JOIN ({NUMBERS_SQL}) n ON n.document_id = l.document_id AND n.page_number = l.page_number AND n.ord = l.ord
"""

QUANTITY_CELLS = [
    (0, "450", 450, True, False), (1, "45 0", 450, True, False), (2, "-", None, True, False), (3, "3$0", 380, False, False), (4, "0b E", None, False, False), (5, "", None, True, False),
    (6, "1.5", 15, True, False), (7, "| 5", 15, True, False), (8, "12 ขวด", 12, True, False), (9, "๔๕", 45, True, False), (10, None, None, True, False), (11, "39 o 410", 390410, False, True),
    (12, "1,250", 1250, True, False), (13, "—", None, True, False), (14, "abc", None, False, False), (15, "99999999999", None, True, False),
]


def quantity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cells.quantity(F.col("raw"))
    return rows_df(spark, "ord int, raw string", [c[:2] for c in QUANTITY_CELLS]).select("ord", "raw", q["value"].alias("value"), q["certain"].alias("certain"), cells.holds_two_figures(F.col("raw")).alias("two"))


DATE_CELLS = [
    (0, "16/3/69", "2026-03-16", True), (1, "1/3/69", "2026-03-01", True), (2, "", None, True), (3, "1369", "2026-03-01", False), (4, "173169", None, False), (5, "31/2/69", None, True),
    (6, "16369", "2026-03-16", False), (7, None, None, True), (8, "l/3/69", "2026-03-01", False), (9, "16-3-2569", "2026-03-16", True), (10, "no date", None, False),
]


def date_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cells.numeric_date(F.col("raw"))
    return rows_df(spark, "ord int, raw string", [c[:2] for c in DATE_CELLS]).select("ord", "raw", d["value"].alias("value"), d["certain"].alias("certain"))


MONTH_CELLS = [
    (0, "3 ม.ค.68", "2025-01-03", True, "3 ม.ค.68"), (1, "15 มกราคม 2568", "2025-01-15", True, "15 มกราคม 2568"), (2, "3-31 ม.ค. 68", None, True, None), (3, "", None, True, None), (4, "16/3/69", None, False, None),
    (5, "7  ธันวาคม 69", "2026-12-07", True, "7 ธันวาคม 69"), (6, None, None, True, None),
]


def month_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cells.thai_date(F.col("raw"))
    out = rows_df(spark, "ord int, raw string", [c[:2] for c in MONTH_CELLS]).select("ord", "raw", d["value"].alias("value"), d["certain"].alias("certain"))
    return out.withColumn("shown", F.when(F.col("value").isNotNull(), cells.thai_date_text(F.col("raw"), F.col("value"))))


BATCH_CELLS = [(0, "T 25 275", "T25275", True), (1, "ab.12 3", "AB123", True), (2, "hello", "hello", False), (3, "", "", True), (4, None, "", True), (5, " 1 2 ", "12", True)]


def batch_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = cells.batch_no(F.col("raw"))
    return rows_df(spark, "ord int, raw string", [c[:2] for c in BATCH_CELLS]).select("ord", "raw", b["value"].alias("value"), b["certain"].alias("certain"))


IDENTITY_CELLS = [(0, "3 3301 01 1 15 41 7", "3 3301 01115 41 7"), (1, "3440600130976", "3440600130976"), (2, "a | b", "a b"), (3, "  x  ", "x"), (4, None, "")]


def identity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_df(spark, "ord int, raw string", [c[:2] for c in IDENTITY_CELLS]).select("ord", "raw", text.identity_text(F.col("raw")).alias("shown"))


DAYS = [(0, "287376", 0, 3, 28), (1, "3169", 0, 6, None), (2, "5/3", 2, 3, 5), (3, "1x", 5, 3, None), (4, "", 0, 3, None), (5, "31", 4, 1, 31), (6, "2o3", 1, 3, None)]


def possible_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_df(spark, "ord int, raw string, day_before int, month int", [c[:4] for c in DAYS])
    return rows.select("ord", "raw", ledger.possible_day(F.col("raw"), F.col("day_before"), F.col("month")).alias("day"))


TABLE = [
    ("ledger_line_numbers", line_numbers, NUMBERS_SQL),
    ("ledger_output_rows", output, OUTPUT_SQL),
    ("ledger_reconcile", reconciled, RECONCILED_SQL),
    ("ledger_settle_dates", settled, SETTLED_SQL),
    ("ledger_carry_dates", carried, CARRIED_SQL),
    ("ledger_modal_months", months, MONTHS_SQL),
    ("ledger_merged_positions", merged, MERGED_SQL),
    ("ledger_upper_median", medians, MEDIANS_SQL),
    ("cells_quantity", quantity_cells, rows_sql("ord int, raw varchar, value int, certain boolean, two boolean", QUANTITY_CELLS)),
    ("cells_numeric_date", date_cells, rows_sql("ord int, raw varchar, value date, certain boolean", DATE_CELLS)),
    ("cells_thai_date", month_cells, rows_sql("ord int, raw varchar, value date, certain boolean, shown varchar", MONTH_CELLS)),
    ("cells_batch_no", batch_cells, rows_sql("ord int, raw varchar, value varchar, certain boolean", BATCH_CELLS)),
    ("cells_identity", identity_cells, rows_sql("ord int, raw varchar, shown varchar", IDENTITY_CELLS)),
    ("ledger_possible_day", possible_days, rows_sql("ord int, raw varchar, day int", [(d[0], d[1], d[4]) for d in DAYS])),
]
