"""Named demonstrators over the driver's tables, each with the DuckDB statement for the same result.

``@query(sql)`` registers a function (spark, sf_dir) -> DataFrame under its own name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.functions import dates, numbers, text, vectors
from ledgerspark.operators import calculator, chunking, classification, extraction, registry, retrieval, star, tables, validation, workflow
from ledgerspark.plans import governance
from ledgerspark.streaming import activity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c) -> F.Column:
    return c.cast("decimal(15,2)")


# ---- governed surface, searches, pages -------------------------------------------------------

ANALYST = governance.Principal("FINANCE_ANALYST", 3)
#: Customers (and with them orders) that the demonstration's analyst owns.
_OWNED = "o_custkey % 5 = 3"


def _portfolio(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The star of the governed surface over the driver's tables: an order is a document with one invoice."""
    o, line, sup = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    status = F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "PENDING_APPROVAL").otherwise("VALIDATED")
    docs = o.select(
        F.col("o_orderkey").alias("id"), F.lit("NPO").alias("document_type"), status.alias("status"), (F.col("o_custkey") % 5).alias("uploaded_by"),
        (F.col("o_orderkey") % 97 == 0).alias("is_deleted"), F.col("o_orderdate").alias("created_at"))
    invoices = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 10 + 1).alias("vendor_id"),
        F.col("o_orderpriority").alias("currency"), _money(F.col("o_totalprice")).alias("grand_total_amount"), F.col("o_orderdate").cast("date").alias("invoice_date"))
    vendors = sup.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("canonical_name"), F.col("s_suppkey").cast("string").alias("vendor_code"))
    items = line.select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line_number"), F.col("l_quantity").cast("decimal(15,4)").alias("quantity"),
        _money(F.col("l_extendedprice")).alias("net_amount"))
    obligations = o.select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_orderpriority").alias("currency"), _money(F.col("o_totalprice")).alias("amount_due"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(_money(F.col("o_totalprice"))).cast("decimal(15,2)").alias("amount_outstanding"),
        F.date_add(F.col("o_orderdate").cast("date"), 30).alias("due_date"), F.when(F.col("o_orderstatus") == "F", "PAID").otherwise("OPEN").alias("status"))
    return {"documents": docs, "invoices": invoices, "vendors": vendors, "invoice_line_items": items, "payment_obligations": obligations}


_PORTFOLIO_SQL = """
docs AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PENDING_APPROVAL' ELSE 'VALIDATED' END AS status,
  o_custkey % 5 AS uploaded_by, o_orderkey % 97 = 0 AS is_deleted, o_orderdate AS created_at FROM orders),
visible AS (SELECT * FROM docs WHERE NOT is_deleted AND uploaded_by = 3),
inv AS (SELECT o_orderkey AS id, o_custkey % 10 + 1 AS vendor_id, o_orderpriority AS currency, CAST(o_totalprice AS DECIMAL(15,2)) AS grand_total_amount,
  CAST(o_orderdate AS DATE) AS invoice_date FROM orders WHERE o_orderkey IN (SELECT id FROM visible)),
obl AS (SELECT o_orderkey AS invoice_id, o_orderpriority AS currency, CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS DECIMAL(15,2)) AS amount_outstanding,
  CAST(o_orderdate AS DATE) + 30 AS due_date, CASE WHEN o_orderstatus = 'F' THEN 'PAID' ELSE 'OPEN' END AS status FROM orders WHERE o_orderkey IN (SELECT id FROM visible))
"""

_VENDOR_RANK = """
SELECT currency, vendor, spend, position FROM (
  SELECT i.currency, v.canonical_name AS vendor, SUM(i.grand_total_amount) AS spend,
    CAST(ROW_NUMBER() OVER (PARTITION BY i.currency ORDER BY SUM(i.grand_total_amount) DESC, v.canonical_name) AS BIGINT) AS position
  FROM {inv} i JOIN {ven} v ON v.id = i.vendor_id GROUP BY i.currency, v.canonical_name) r
WHERE position <= 5
"""


@query(f"WITH {_PORTFOLIO_SQL}, ven AS (SELECT s_suppkey AS id, s_name AS canonical_name FROM supplier) " + _VENDOR_RANK.format(inv="inv", ven="ven"))
def governed_vendor_rank(spark, sf_dir):
    """Flagship (S-03, Z-01 to Z-09, A-08, W-04): an analyst's SQL through secured views; vendors ranked within each currency."""
    return governance.execute(spark, _VENDOR_RANK.format(inv="invoices", ven="vendors"), _portfolio(spark, sf_dir), ANALYST)


@query(f"WITH {_PORTFOLIO_SQL} SELECT currency, SUM(amount_outstanding) AS outstanding, COUNT(*) FILTER (WHERE due_date < DATE '1998-08-01' AND amount_outstanding > 0 AND status <> 'PAID') AS overdue, COUNT(*) AS total FROM obl GROUP BY currency")
def governed_outstanding(spark, sf_dir):
    """Z-06, A-04, A-05, P-09: outstanding and overdue by currency, as an analyst sees it, an OR in the filter included."""
    sql = "SELECT currency, SUM(amount_outstanding) AS outstanding, COUNT(*) FILTER (WHERE due_date < DATE '1998-08-01' AND amount_outstanding > 0 AND status <> 'PAID') AS overdue, COUNT(*) AS total FROM payment_obligations WHERE status = 'PAID' OR 1 = 1 GROUP BY currency"
    return governance.execute(spark, sql, _portfolio(spark, sf_dir), ANALYST)


@query("SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(15,2)) AS net_amount FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 3 AND o_orderkey % 97 <> 0)")
def visible_child_rows(spark, sf_dir):
    """J-05, Z-06: line items by way of invoices and documents, three levels of left-semi joins."""
    v = governance.secured("invoice_line_items", _portfolio(spark, sf_dir), ANALYST)
    return v.select(F.col("invoice_id").alias("l_orderkey"), F.col("line_number").alias("l_linenumber"), "net_amount")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND text ILIKE '%license%' AND n_chars >= 100 AND n_chars <= 5000 ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 2")
def doc_search_page(spark, sf_dir):
    """P-01, T-01, F-04."""
    d = tables.search(read(spark, sf_dir, "documents"), {"lang": "en", "source": None}, {"text": "license"}, {"n_chars": (100, 5000)})
    return tables.page(d.select("doc_id", "lang", "source", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 50, 2)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE lang = 'en') AS english FROM documents WHERE n_chars >= 100")
def search_count(spark, sf_dir):
    """A-01."""
    return tables.search(read(spark, sf_dir, "documents"), ranges={"n_chars": (100, None)}).agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("english"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' AND user_id <= 50")
def audit_search(spark, sf_dir):
    """P-03."""
    return tables.search(read(spark, sf_dir, "events"), {"event_type": "purchase"}, ranges={"user_id": (None, 50)}).select("event_id", "user_id", "event_type")


@query("SELECT doc_id FROM documents WHERE doc_id IN (3, 5, 8) UNION ALL SELECT doc_id FROM documents WHERE FALSE")
def id_lists(spark, sf_dir):
    """P-05: an empty list matches nothing."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    return tables.in_ids(d, "doc_id", [3, 5, 8]).unionByName(tables.in_ids(d, "doc_id", []))


# ---- joins and aggregates --------------------------------------------------------------------

@query("SELECT count(*) FILTER (WHERE late) AS overdue, count(*) AS total, round(100.0 * count(*) FILTER (WHERE late) / count(*), 6) AS percent FROM (SELECT CAST(o_orderdate AS DATE) + 30 < DATE '1998-01-01' AND o_totalprice > 0 AND o_orderstatus <> 'F' AS late FROM orders)")
def overdue_ratio(spark, sf_dir):
    """P-09, A-05."""
    late = tables.overdue(F.date_add(F.col("o_orderdate").cast("date"), 30), F.col("o_totalprice"), F.when(F.col("o_orderstatus") == "F", "PAID").otherwise("OPEN"), "1998-01-01")
    return read(spark, sf_dir, "orders").agg(F.count_if(late).alias("overdue"), F.count("*").alias("total"), F.round(100.0 * F.count_if(late) / F.count("*"), 6).alias("percent"))


@query("SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS spend FROM orders GROUP BY 1")
def quarter_counts(spark, sf_dir):
    """A-07, F-44."""
    return read(spark, sf_dir, "orders").groupBy(F.date_format(F.trunc(F.col("o_orderdate").cast("date"), "quarter"), "yyyy-MM-dd").alias("quarter")).agg(F.count("*").alias("orders"), F.sum(_money(F.col("o_totalprice"))).cast("decimal(25,2)").alias("spend"))


@query("SELECT o_orderpriority AS currency, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS spend, count(*) AS orders FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-06-02' AND CAST(o_orderdate AS DATE) < DATE '1998-07-02' GROUP BY 1")
def spend_last_30d(spark, sf_dir):
    """A-07: a 30-day window before an as-of date."""
    d = F.col("o_orderdate").cast("date")
    as_of = F.lit("1998-07-02").cast("date")
    o = read(spark, sf_dir, "orders").where((d >= F.date_sub(as_of, 30)) & (d < as_of))
    return o.groupBy(F.col("o_orderpriority").alias("currency")).agg(F.sum(_money(F.col("o_totalprice"))).cast("decimal(25,2)").alias("spend"), F.count("*").alias("orders"))


@query("SELECT l_returnflag AS currency, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS spend, count(*) AS items FROM lineitem GROUP BY 1")
def spend_by_currency(spark, sf_dir):
    """A-04: currencies are never added up."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("currency")).agg(F.sum(_money(F.col("l_extendedprice"))).cast("decimal(25,2)").alias("spend"), F.count("*").alias("items"))


@query("SELECT s_name AS vendor, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS unpaid FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus <> 'F' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def top_unpaid_vendor(spark, sf_dir):
    """J-04, T-07: pre-aggregated by supplier before the name is joined."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey")
    li = read(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    by = li.groupBy("l_suppkey").agg(F.sum(_money(F.col("l_extendedprice"))).cast("decimal(25,2)").alias("unpaid"))
    s = read(spark, sf_dir, "supplier")
    return by.join(s, by["l_suppkey"] == s["s_suppkey"]).select(F.col("s_name").alias("vendor"), "unpaid").orderBy(F.desc("unpaid"), "vendor").limit(1)


@query("SELECT o_orderstatus AS status, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 1, 2")
def count_by_status(spark, sf_dir):
    """A-06."""
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS task_type, count(*) AS n FROM events WHERE value > 10 GROUP BY 1")
def count_by_task(spark, sf_dir):
    """A-02, A-03."""
    return read(spark, sf_dir, "events").where("value > 10").groupBy(F.col("event_type").alias("task_type")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, sf_dir):
    """W-01 with a tie-break."""
    return tables.latest_per_key(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_type, last_activity_at, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_activity_at DESC, event_type) AS INTEGER) AS position FROM (SELECT user_id, event_type, max(ts) AS last_activity_at FROM events GROUP BY 1, 2)) WHERE position <= 5")
def recently_viewed(spark, sf_dir):
    """ST-07, T-08."""
    return workflow.recently_viewed(read(spark, sf_dir, "events"), "user_id", "event_type", "ts", 5)


@query("SELECT conv_id, turn, role, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def turn_window(spark, sf_dir):
    """W-06, ST-09."""
    return tables.last_turns(read(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role", F.length("text").alias("chars"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 7 = 0")
def replace_keys(spark, sf_dir):
    """S-15, S-16, S-18: whole-key replacement."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return tables.replace_by_key(o, o.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


@query("SELECT doc_id, first_id, copies FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS copies FROM documents) WHERE copies > 1")
def exact_duplicates(spark, sf_dir):
    """S-05, J-09, V-21, W-02: every row that shares its bytes, the original included."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return validation.file_duplicates(d, "digest", "doc_id").select("doc_id", "first_id", "copies")


@query("""
WITH d AS (SELECT o_orderkey AS id, o_custkey AS seller, o_orderpriority AS number, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderstatus AS total FROM orders),
g AS (SELECT seller, number, date, total, min(id) AS other_id FROM d GROUP BY ALL HAVING count(*) > 1)
SELECT id, other_id, 'strong' AS kind FROM d JOIN g USING (seller, number, date, total) WHERE id <> other_id
""")
def semantic_duplicates(spark, sf_dir):
    """J-03, V-22: the same type, seller, number, date and total."""
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.lit("NPO").alias("document_type"), F.col("o_custkey").cast("string").alias("seller"), F.col("o_orderpriority").alias("number"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderstatus").alias("total"))
    return validation.semantic_duplicates(rows).where("kind = 'strong'")


@query("""
WITH d AS (SELECT o_orderkey AS id, o_custkey AS seller, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS total FROM orders),
c AS (SELECT *, min(id) OVER (PARTITION BY seller, date, total) AS own_id FROM d)
SELECT a.id, b.id AS other_id, 'potential' AS kind FROM c a JOIN c b USING (seller)
WHERE b.id = b.own_id AND a.id <> b.id AND NOT (a.id = a.own_id AND b.id > a.id)
  AND (a.date IS NULL OR b.date IS NULL OR a.date = b.date) AND (a.total IS NULL OR b.total IS NULL OR a.total = b.total)
  AND (a.date IS NULL OR b.date IS NULL OR a.total IS NULL OR b.total IS NULL)
""")
def potential_duplicates(spark, sf_dir):
    """J-03, V-23: dates and totals that are missing in part, each row against every content of its group."""
    o = read(spark, sf_dir, "orders")
    date = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date"))
    total = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.lit("NPO").alias("document_type"), F.col("o_custkey").cast("string").alias("seller"), F.lit("1").alias("number"), date.alias("date"), total.alias("total"))
    return validation.semantic_duplicates(rows).where("kind = 'potential'")


# ---- calculator and scalar functions ---------------------------------------------------------

@query("""
SELECT currency, CAST(sum(g) AS DECIMAL(28,2)) AS total_gross, CAST(sum(s) AS DECIMAL(28,2)) AS total_savings, CAST(sum(g - s) AS DECIMAL(28,2)) AS total_payable, count(*) AS items FROM (
  SELECT l_returnflag AS currency, CAST(l_extendedprice AS DECIMAL(18,2)) AS g, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(round(l_discount * 100) AS INTEGER) / 100.0 + 1e-9, 2) AS DECIMAL(18,2)) AS s FROM lineitem) GROUP BY 1
""")
def batch_discounts(spark, sf_dir):
    """A-10, F-27, F-28."""
    li = read(spark, sf_dir, "lineitem").select("l_extendedprice", "l_returnflag", F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("p"))
    out = calculator.batch_discounts(li, "l_extendedprice", "p", "l_returnflag")
    return out.select("currency", *[F.col(c).cast("decimal(28,2)").alias(c) for c in ("total_gross", "total_savings", "total_payable")], "items")


@query("""
SELECT CAST(sum(v) AS DECIMAL(38,2)) AS total, CAST(min(v) AS DECIMAL(38,2)) AS lowest, CAST(max(v) AS DECIMAL(38,2)) AS highest, count(*) AS n, round(avg(CAST(v AS DOUBLE)), 2) AS mean, round(var_pop(CAST(v AS DOUBLE)), 2) AS variance
FROM (SELECT CAST(l_quantity AS DECIMAL(18,4)) AS v FROM lineitem)
""")
def decimal_aggregates(spark, sf_dir):
    """A-09: every kind in one pass, population variance."""
    kinds = {"total": "sum", "lowest": "min", "highest": "max", "mean": "avg", "variance": "variance"}
    out = calculator.column_aggregates(read(spark, sf_dir, "lineitem"), "l_quantity", kinds)
    return out.withColumns({"mean": F.col("mean").cast("double"), "variance": F.col("variance").cast("double")})


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN NULL WHEN 6 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END AS number FROM orders")
def parse_numbers(spark, sf_dir):
    """F-20: every order's total in eight spellings, a negative and an unreadable one among them."""
    us = F.format_number(F.col("o_totalprice").cast("decimal(15,2)"), 2)
    eu, plain = F.translate(us, ",.", ".,"), F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    forms = [us, eu, F.translate(us, ",.", " ,"), F.concat(F.lit("Rs. "), us), F.concat(F.lit("$ "), F.translate(us, ",.", " ,")), F.translate(plain, ".", ","), F.concat(F.lit("-"), plain), F.concat(F.lit("n/a "), F.regexp_replace(plain, r"[0-9.]", "x"))]
    raw = F.get(F.array(*forms), (F.col("o_orderkey") % 8).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(numbers.parse_numeric(raw), 2).alias("number"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS number FROM lineitem")
def parse_formatted_numbers(spark, sf_dir):
    """F-20 over a whole table: prices written in three ways are read back."""
    p = F.col("l_extendedprice").cast("decimal(15,2)")
    us = F.format_number(p, 2)
    eu = F.translate(us, ",.", ".,")
    raw = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("USD "), us)).when(F.col("l_linenumber") % 3 == 1, eu).otherwise(F.concat(F.lit("€ "), F.translate(us, ",.", " ,")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(numbers.parse_numeric(raw), 2).alias("number"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 6 = 2 AND day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def parse_dates(spark, sf_dir):
    """F-40: every order's date in six spellings: day first, then month first; days that don't exist give null."""
    d = F.col("o_orderdate").cast("date")
    forms = [F.concat(F.dayofmonth(d), F.lit("th "), F.date_format(d, "MMMM yyyy")), F.date_format(d, "dd-MMM-yyyy"), F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "yyyy.M.d"),
             F.concat(F.lit("Due: "), F.date_format(d, "MMMM d, yyyy"), F.lit(" net")), F.concat(F.lit("31/02/"), F.year(d))]
    raw = F.get(F.array(*forms), (F.col("o_orderkey") % 6).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.normalize_date(raw).alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def parse_formatted_dates(spark, sf_dir):
    """F-40 over a whole table: dates written in four ways are read back."""
    d = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(d, "d MMMM yyyy")).when(k == 1, F.date_format(d, "dd-MM-yyyy")).when(k == 2, F.date_format(d, "MMM d, yyyy")).otherwise(F.date_format(d, "yyyy/MM/dd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.normalize_date(raw).alias("day"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' WHEN 2 THEN 'INR' WHEN 3 THEN 'QZ' || chr(65 + CAST(o_custkey % 26 AS INTEGER)) END AS code FROM orders")
def norm_currency(spark, sf_dir):
    """F-06: symbols alone, inside an amount, codes of any three letters, and texts without a currency, one for each order."""
    forms = [F.lit("$"), F.concat(F.lit("US$ "), F.col("o_totalprice").cast("decimal(15,2)").cast("string")), F.concat(F.lit("Rs."), F.col("o_custkey").cast("string")),
             F.concat(F.lit("qz"), F.char(97 + F.col("o_custkey") % 26)), F.concat(F.lit("?? "), F.col("o_custkey").cast("string"))]
    raw = F.get(F.array(*forms), (F.col("o_orderkey") % 5).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.normalize_currency(raw).alias("code"))


@query("SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'pcs' WHEN 1 THEN 'pcs' WHEN 2 THEN 'hours' WHEN 3 THEN 'unit ' || l_suppkey END AS unit FROM lineitem")
def norm_unit(spark, sf_dir):
    """F-05, F-01: known units in several spellings, unknown and blank ones, one for each line item."""
    forms = [F.lit("PCS"), F.lit(" Stk. "), F.lit("hrs"), F.concat(F.lit("Unit   "), "l_suppkey", F.lit(" ")), F.lit("\u00a0 ")]
    raw = F.get(F.array(*forms), (F.col("l_partkey") % 5).cast("int"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.normalize_unit(raw).alias("unit"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 2 THEN 0.1::DOUBLE ELSE round((2 + l_suppkey % 9) / 100.0::DOUBLE, 4) END AS rate FROM lineitem")
def tax_rates(spark, sf_dir):
    """F-25: percentages with point and comma, and damaged ones that net and gross explain, one for each line item."""
    percent, net = 2 + F.col("l_suppkey") % 9, F.col("l_extendedprice").cast("double")
    damaged = F.col("l_orderkey") % 3 == 2
    raw = F.when(damaged, "1090").when(F.col("l_orderkey") % 3 == 1, F.concat(percent.cast("string"), F.lit(",0%"))).otherwise(F.concat(percent.cast("string"), F.lit("%")))
    gross = F.when(damaged, net * 1.1)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(numbers.tax_rate(raw, F.when(damaged, net), gross), 4).alias("rate"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) WHEN 3 THEN NULL ELSE printf('%.2f', round(o_totalprice, 2)) END AS amount FROM orders")
def norm_amount(spark, sf_dir):
    """F-21: every order's total as a plain number: with places where they were written."""
    p = F.col("o_totalprice").cast("decimal(15,2)")
    us = F.format_number(p, 2)
    forms = [F.concat(F.lit("Rs. "), us), F.floor("o_totalprice").cast("string"), F.translate(us, ",.", " ,"), F.concat(F.lit("x"), F.translate(us, "0123456789,.", "xxxxxxxxxxxx"))]
    raw = F.get(F.array(*forms), (F.col("o_orderkey") % 4).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.normalize_amount(raw).alias("amount"))


# ---- retrieval -------------------------------------------------------------------------------

def _vector(spark, sf_dir, key: int) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").where(F.col("vec_id") == key).first()["embedding"])


_DENSE_SQL = """
SELECT vec_id, round(distance, 6) AS distance, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY distance, vec_id) AS INTEGER) AS rank FROM (
  SELECT e.vec_id, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q {where})) WHERE rank <= 30
"""


@query(_DENSE_SQL.format(where=""))
def vector_topk(spark, sf_dir):
    """R-02, T-03."""
    hits = retrieval.dense(read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), key="vec_id")
    return hits.select("vec_id", F.round("distance", 6).alias("distance"), F.col("dense_rank").alias("rank"))


@query(_DENSE_SQL.format(where="WHERE e.label = 3"))
def vector_topk_scoped(spark, sf_dir):
    """R-03: the scope stands before the ranking."""
    hits = retrieval.dense(read(spark, sf_dir, "embeddings").where("label = 3"), _vector(spark, sf_dir, 0), key="vec_id")
    return hits.select("vec_id", F.round("distance", 6).alias("distance"), F.col("dense_rank").alias("rank"))


@query("""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 30),
b AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) - length(replace(text, 'e', '')) DESC, doc_id) AS r FROM documents QUALIFY r <= 30),
f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.r AS ar, b.r AS br, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) AS s FROM a FULL JOIN b USING (doc_id))
SELECT doc_id, round(s, 9) AS rrf FROM f ORDER BY s DESC, ar ASC NULLS LAST, br ASC NULLS LAST, doc_id LIMIT 25
""")
def rrf_fusion(spark, sf_dir):
    """R-05, J-06, U-03, W-03, T-05: two rankings of documents, fused."""
    d = read(spark, sf_dir, "documents")
    a = retrieval.ranked(d.select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 30, "dense_rank")
    e = d.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).alias("e"))
    b = retrieval.ranked(e, [F.desc("e"), F.asc("doc_id")], 30, "sparse_rank")
    return retrieval.fuse(a, b, key="doc_id").select("doc_id", F.round("rrf", 9).alias("rrf"))


@query("""
WITH s AS (SELECT doc_id, (CAST(regexp_matches(lower(text), '(^|[^a-z0-9''])license([^a-z0-9'']|$)') AS INT) + CAST(regexp_matches(lower(text), '(^|[^a-z0-9''])apache([^a-z0-9'']|$)') AS INT)) / 2.0::DOUBLE AS rerank_score FROM documents),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY rerank_score DESC, doc_id) AS INTEGER) AS position FROM s)
SELECT doc_id, rerank_score, position FROM r WHERE position <= 5 AND (rerank_score >= 0.75 OR position = 1)
""")
def rerank_threshold(spark, sf_dir):
    """R-06, T-06: over the threshold, or at least the best one."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.rerank(d, retrieval.overlap_score(F.col("text"), "apache license"), 0.75, 5, "doc_id").select("doc_id", "rerank_score", "position")


@query(None)
def full_text_topk(spark, sf_dir):
    """R-04, T-04: terms, a phrase and an exclusion; the score has no SQL counterpart."""
    return retrieval.sparse(read(spark, sf_dir, "documents").select("doc_id", "text"), 'licensed "apache license" -gnu', key="doc_id", text="text").select("doc_id", F.round("score", 6).alias("score"), F.col("sparse_rank").alias("rank"))


# ---- chunks and tables -----------------------------------------------------------------------

@query("""
WITH n AS (SELECT l_suppkey, list(l_orderkey * 10 + l_linenumber ORDER BY l_orderkey, l_linenumber) AS items FROM lineitem GROUP BY 1),
s AS (SELECT l_suppkey, items, unnest(CASE WHEN len(items) <= 15 THEN [0] ELSE list_filter(range(0, len(items), 8), lambda s: s = 0 OR s - 8 + 10 < len(items)) END) AS start FROM n)
SELECT l_suppkey, CAST(start AS INTEGER) AS start, CAST(len(part) AS INTEGER) AS size, part[1] AS first, part[len(part)] AS last FROM (SELECT l_suppkey, start, CASE WHEN len(items) <= 15 THEN items ELSE items[start + 1 : start + 10] END AS part FROM s)
""")
def table_windows(spark, sf_dir):
    """W-05, C-04: windows of 10 by steps of 8 over tables longer than 15 rows."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.col("l_orderkey") * 10 + F.col("l_linenumber"))).alias("items"))
    w = chunking.windows(li, "items")
    return w.select("l_suppkey", "start", F.size("items").alias("size"), F.element_at("items", 1).alias("first"), F.element_at("items", -1).alias("last"))


@query("SELECT o_orderkey, p AS page_number, 'status ' || o_orderstatus || ' part ' || p AS page_text FROM orders, (SELECT unnest([1, 2]) AS p)")
def page_split(spark, sf_dir):
    """C-01: marked pages; text before the first marker goes."""
    body = F.concat(F.lit("lost\n=== PAGE 1 ===\nstatus "), "o_orderstatus", F.lit(" part 1\n\n=== PAGE 2 ===\nstatus "), "o_orderstatus", F.lit(" part 2\n"))
    return chunking.pages(read(spark, sf_dir, "orders").select("o_orderkey", body.alias("text"))).select("o_orderkey", "page_number", "page_text")


@query("SELECT o_orderkey, CAST(r AS INTEGER) AS row_number, CASE r WHEN 1 THEN 'Pen ' || o_orderstatus ELSE 'Ink' END AS description, CASE r WHEN 1 THEN '2' ELSE '5' END AS quantity, CASE r WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE '9.50' END AS net_amount FROM orders, (SELECT unnest([1, 2]) AS r)")
def md_table_rows(spark, sf_dir):
    """C-07, F-08: a Markdown table to line items."""
    body = F.concat(F.lit("Items\n| No. | Description | Qty | Net worth |\n| --- | --- | --- | --- |\n| 1 | Pen "), "o_orderstatus", F.lit(" | 2 | "), F.col("o_custkey").cast("string"), F.lit(" |\n| 2 | Ink | 5 | 9.50 |\nend"))
    rows = chunking.markdown_rows(read(spark, sf_dir, "orders").select("o_orderkey", body.alias("text")))
    return rows.select("o_orderkey", "row_number", "description", "quantity", "net_amount")


# ---- classification, extraction, reconciliation ----------------------------------------------

_SAMPLES = [
    (1, "Tax Invoice\nInvoice No: INV-2044\nPO Number: PO-7781\nVendor: Nordic Tools\nBill To: Acme\nGrand total 44.00", "POI"),
    (2, "Invoice Number INV-99 Date of issue 2024-01-02 Seller: A Client: B Tax Id 1 Gross worth 3 Invoice No: 4", "NPO"),
    (3, "Expense claim form: employee travel reimbursement, per diem and mileage", "IMA"),
    (4, "Sales invoice. Ship To: Rome. Ship Mode: air. Order ID: 7. Customer name: C", "MSI"),
    (5, "Pay in slip. PIS number 4. Cash deposit amount 20, bank name X, receipt", "PSI"),
    (6, "Journal entry JE-100 posting date, debit and credit, GL account code 44, narration", "JER"),
    (7, "Bank advice: debit advice, advice date, advice amount, account number 12345678", "BKA"),
    (8, "Down payment request DPR-12, advance percentage 20, requested amount", "DPR"),
    (9, "Letter of credit LC-77 issuing bank, beneficiary name, shipment reference", "LCA"),
    (10, "qwe rty", "UNKNOWN"), (11, "   ", "UNKNOWN"),
]


@query(f"SELECT o_orderkey AS id, predicted_type FROM orders JOIN (VALUES {_values([(i - 1, t) for i, _, t in _SAMPLES])}) t(k, predicted_type) ON k = o_orderkey % 11")
def classify_samples(spark, sf_dir):
    """K-01 to K-05: a text of each type for every order, with the order's own number and status."""
    texts = F.array(*[F.lit(t) for _, t, _ in _SAMPLES])
    body = F.concat(F.get(texts, (F.col("o_orderkey") % 11).cast("int")), F.lit("\nq"), F.lower("o_orderstatus"), F.lit(" "), F.col("o_orderkey").cast("string"))
    return classification.classify(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), body.alias("text"))).select("id", "predicted_type")


@query("SELECT o_orderkey, 'INV-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, 'Customer ' || o_custkey AS buyer_name, printf('%.2f', o_totalprice) AS grand_total, CAST(5 AS INTEGER) AS found FROM orders")
def label_extract(spark, sf_dir):
    """F-02, E-03, E-11 to E-13: fields from text by their labels, over every order."""
    body = F.concat(
        F.lit("Invoice Number: INV-"), "o_orderkey", F.lit("\nInvoice Date: "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit("  Bill To: Customer "), "o_custkey",
        F.lit("\nAmount Due - USD "), F.format_string("%.2f", "o_totalprice"), F.lit("\nCurrency: USD\n"))
    d = extraction.extract(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", body.alias("text")), "NPO")
    v = lambda k: F.col("fields")[k]["value"]
    amount = F.format_string("%.2f", v("grand_total_amount").cast("double"))
    return d.select("o_orderkey", v("invoice_number").alias("invoice_number"), v("invoice_date").alias("invoice_date"), v("buyer_name").alias("buyer_name"), amount.alias("grand_total"), "found")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'agreed' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'rule' ELSE 'llm' END AS provenance,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN 'other' WHEN 2 THEN o_orderstatus ELSE lower(o_orderstatus) END AS value,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.7 WHEN 2 THEN 0.7 ELSE 0.8 END AS DOUBLE) AS confidence, CASE o_orderkey % 4 WHEN 1 THEN o_orderstatus END AS conflict_value FROM orders
""")
def reconcile_fields(spark, sf_dir):
    """E-25 to E-29, F-29: two extractions of a field, reconciled."""
    k = F.col("o_orderkey") % 4
    rule = extraction.field(F.when(k != 3, F.col("o_orderstatus")), F.lit(0.7), F.lit("r"))
    model = extraction.field(F.when(k == 1, "other").when(k != 2, F.lower("o_orderstatus")), F.lit(0.8), F.lit("m"))
    d = read(spark, sf_dir, "orders").select("o_orderkey", rule.alias("rule"), model.alias("model"), F.lit("text").alias("kind"))
    return extraction.reconcile(d).select("o_orderkey", "field.provenance", "field.value", "field.confidence", "field.conflict_value")


@query("SELECT CASE o_orderkey % 4 WHEN 0 THEN 'agreed' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'rule' ELSE 'llm' END AS provenance, count(*) AS n FROM orders GROUP BY 1")
def provenance_counts(spark, sf_dir):
    """A-16."""
    return reconcile_fields(spark, sf_dir).groupBy("provenance").agg(F.count("*").alias("n"))


# ---- validation ------------------------------------------------------------------------------

def _lines(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    q, net = F.col("l_quantity"), F.round("l_extendedprice", 2)
    item = F.struct(
        q.alias("quantity"), F.round(F.when(F.col("l_linenumber") == 3, net / q + 1).otherwise(net / q), 6).alias("unit_price"), net.alias("net_amount"),
        F.round(net * F.col("l_tax"), 2).alias("tax_amount"), F.round(net + F.round(net * F.col("l_tax"), 2), 2).alias("gross_amount"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("i")))).alias("x")).select("l_orderkey", F.transform("x", lambda v: v["i"]).alias("line_items"))


@query("""
SELECT l_orderkey, CAST(CASE WHEN sum(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END AS INTEGER) AS warnings, TRUE AS is_valid FROM lineitem GROUP BY 1
""")
def validate_lines(spark, sf_dir):
    """V-11 to V-14, V-24, A-14: line arithmetic over arrays; one line of some orders is off."""
    d = _lines(spark, sf_dir).withColumn("issues", F.array_compact(F.array(*validation.line_rules())))
    return validation.tally(d).select("l_orderkey", F.col("warning_count").alias("warnings"), "is_valid")


@query("SELECT o_orderkey, CAST((o_orderkey % 3 = 0)::INT AS INTEGER) AS mismatch, CAST((o_orderkey % 5 = 0)::INT AS INTEGER) AS missing FROM orders")
def validate_totals(spark, sf_dir):
    """V-01, V-08, V-24: totals and mandatory fields of every order."""
    t = F.col("o_totalprice").cast("decimal(15,2)")
    f = lambda v: extraction.field(v, F.lit(0.9), F.lit("x"))
    k = F.col("o_orderkey")
    values = {
        "invoice_number": F.concat(F.lit("INV-"), k), "invoice_date": F.date_format("o_orderdate", "yyyy-MM-dd"), "seller_name": F.lit("S"),
        "buyer_name": F.when(k % 5 != 0, "B"), "currency": F.lit("USD"), "subtotal_net_amount": F.format_string("%.2f", t.cast("double")),
        "total_tax_amount": F.lit("10.00"), "grand_total_amount": F.format_string("%.2f", F.when(k % 3 == 0, t + 15).otherwise(t + 10).cast("double")),
    }
    d = read(spark, sf_dir, "orders").withColumn("fields", F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), f(v).alias("value")) for n, v in values.items()])))
    has = lambda r: F.size(F.filter("issues", lambda i: i["rule_type"] == r)).cast("int")
    return validation.validate(d, "NPO").select("o_orderkey", has("total_mismatch").alias("mismatch"), has("mandatory").alias("missing"))


@query("SELECT label, round(avg(m), 6) AS confidence FROM (SELECT label, vec_id % 3 AS page, avg(vec_id % 100 / 100.0::DOUBLE) AS m FROM embeddings GROUP BY 1, 2) GROUP BY 1")
def confidence_rollup(spark, sf_dir):
    """A-12: the mean of the pages' means."""
    from ledgerspark.operators.layout import page_confidence

    e = read(spark, sf_dir, "embeddings").select(F.col("label").alias("document_id"), (F.col("vec_id") % 3).alias("page_number"), (F.col("vec_id") % 100 / 100.0).alias("confidence"))
    return page_confidence(e).select(F.col("document_id").alias("label"), F.round("average_confidence", 6).alias("confidence"))


@query("""
SELECT doc_id, CASE WHEN q >= 0.85 THEN 'excellent' WHEN q >= 0.7 THEN 'good' WHEN q >= 0.5 THEN 'fair' ELSE 'poor' END AS grade FROM (SELECT doc_id, round(0.35 * quality + 0.25 * (1 - toxic) + 0.25 * 0.5 + 0.15 * 0.8, 4) AS q FROM labels)
""")
def quality_grades(spark, sf_dir):
    """Q-05."""
    d = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("confidence"), (1 - F.col("toxic")).cast("double").alias("structure"), F.lit(0.5).alias("validation"), F.lit(0.8).alias("completeness"))
    return validation.quality_score(d).select("doc_id", "grade")


# ---- star schema, workflow, activity ---------------------------------------------------------

def _results(spark, sf_dir):
    f = lambda v: extraction.field(v, F.lit(0.9), F.lit("x"))
    values = {
        "invoice_number": F.concat(F.lit("INV-"), "o_orderkey"), "invoice_date": F.date_format("o_orderdate", "dd/MM/yyyy"), "vendor_code": F.concat(F.lit("V"), F.col("o_custkey") % 50),
        "seller_name": F.concat(F.lit("Seller "), F.col("o_custkey") % 50), "currency": F.lit("USD"), "grand_total_amount": F.format_string("%,.2f", "o_totalprice"),
    }
    o = read(spark, sf_dir, "orders")
    r = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at"), F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), f(v).alias("value")) for n, v in values.items()])).alias("fields"))
    older = r.withColumns({"id": -F.col("id"), "created_at": F.expr("created_at - INTERVAL 1 DAY")})
    return r.unionByName(older)


@query("SELECT o_orderkey AS document_id, o_orderkey AS source_extraction_result_id, 'INV-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, CAST(o_totalprice AS DECIMAL(15,2)) AS grand_total_amount FROM orders")
def star_projection(spark, sf_dir):
    """X-01, X-05, F-22, F-42: invoices from the latest results."""
    return star.invoices(_results(spark, sf_dir)).select("document_id", "source_extraction_result_id", "invoice_number", F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"), "grand_total_amount")


@query("SELECT 'V' || (o_custkey % 50) AS vendor_code, 'Seller ' || (o_custkey % 50) AS canonical_name, count(*) AS documents FROM orders GROUP BY 1, 2")
def vendor_resolution(spark, sf_dir):
    """X-02, J-08."""
    return star.vendors(star.invoices(_results(spark, sf_dir))).select("vendor_code", "canonical_name", "documents")


@query("SELECT status, count(*) AS n, CAST(sum(due) AS DECIMAL(25,2)) AS outstanding FROM (SELECT 'OPEN' AS status, CAST(o_totalprice AS DECIMAL(15,2)) AS due FROM orders) GROUP BY 1")
def obligation_status(spark, sf_dir):
    """X-04."""
    o = star.obligations(star.invoices(_results(spark, sf_dir)))
    return o.groupBy("status").agg(F.count("*").alias("n"), F.sum("amount_outstanding").cast("decimal(25,2)").alias("outstanding"))


@query("""
SELECT o_orderkey AS document_id, CASE o_orderkey % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'PENDING_APPROVAL' ELSE 'REJECTED' END AS status,
  CAST(CASE o_orderkey % 3 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS accepted, CAST(CASE o_orderkey % 3 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS refused FROM orders
""")
def state_fold(spark, sf_dir):
    """ST-03: request, then approve (by a manager), approve (by an analyst: refused) or reject with a comment."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    k = F.col("document_id") % 3
    first = o.select("document_id", F.lit(1).cast("bigint").alias("seq"), F.lit("REQUEST_APPROVAL").alias("action"), F.lit("FINANCE_ANALYST").alias("role"), F.lit(None).cast("string").alias("comment"))
    second = o.select(
        "document_id", F.lit(2).cast("bigint").alias("seq"), F.when(k == 2, "REJECT").otherwise("APPROVE").alias("action"),
        F.when(k == 1, "FINANCE_ANALYST").otherwise("FINANCE_MANAGER").alias("role"), F.when(k == 2, "wrong vendor").alias("comment"))
    return workflow.fold_actions(o.withColumn("status", F.lit("VALIDATED")), first.unionByName(second))


@query("SELECT label AS kind, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY 1")
def training_counts(spark, sf_dir):
    """A-03, T-12."""
    return read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


@query("""
SELECT o_orderkey, document_type, CAST(fields AS BIGINT) AS fields, CAST(mandatory AS BIGINT) AS mandatory FROM orders
JOIN (VALUES (0, 'POI', 23, 8), (1, 'NPO', 19, 6), (2, 'IMA', 16, 6), (3, 'MSI', 21, 6), (4, 'PSI', 15, 7), (5, 'JER', 16, 6), (6, 'BKA', 15, 6), (7, 'DPR', 16, 8), (8, 'LCA', 16, 7)) t(k, document_type, fields, mandatory) ON k = o_orderkey % 9
""")
def field_registry(spark, sf_dir):
    """Section 1.4, U-02: what the registry asks of each order's document, by its type."""
    asked = registry.field_schema(spark).groupBy("document_type").agg(F.count("*").alias("fields"), F.count_if("mandatory").alias("mandatory"))
    types = F.array(*[F.lit(t) for t in registry.TYPES])
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.get(types, (F.col("o_orderkey") % 9).cast("int")).alias("document_type"))
    return o.join(F.broadcast(asked), "document_type").select("o_orderkey", "document_type", "fields", "mandatory")


# ---- beyond parity: windows, sets, cubes, as-of ----------------------------------------------

@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_tumbling(spark, sf_dir):
    """Beyond parity: event-time windows (the batch form of the stream)."""
    out = activity.tumbling(read(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", "event_type")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS spend FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def rollup_cube(spark, sf_dir):
    """Beyond parity."""
    return read(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(_money(F.col("o_totalprice"))).cast("decimal(25,2)").alias("spend"))


@query("(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_ops(spark, sf_dir):
    """Beyond parity, U-04, U-07, U-09."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.select(F.col("o_custkey").alias("k")).intersect(c.select("c_custkey")).exceptAll(o.where("o_orderstatus = 'P'").select("o_custkey").distinct()).distinct()


@query("SELECT e.event_id, max(p.ts) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts GROUP BY 1")
def asof_last_event(spark, sf_dir):
    """Beyond parity: as-of join by one sort within users, instead of a range join."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    e = read(spark, sf_dir, "events").withColumn("u", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("u").rangeBetween(Window.unboundedPreceding, -1)
    return e.select("event_id", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w).alias("last_purchase"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS length FROM embeddings")
def vector_lengths(spark, sf_dir):
    """R-01's check: the length of each vector."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"))


@query("SELECT conv_id, turn, substr(trim(text), 1, 300) AS snippet FROM conversations")
def snippets(spark, sf_dir):
    """F-14."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.snippet(F.col("text")).alias("snippet"))


from ledgerspark import more_queries, stateful_queries  # noqa: E402, F401  (they register the rest under the same tables)
