"""Demonstrators of what is kept from batch to batch: tables, vendors, chunks, sessions, indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators import extraction, line_tables, retrieval, star_store, text_index, vector_index
from ledgerspark.queries import query, read
from ledgerspark.sources.workspace import Workspace, shared_folder
from ledgerspark.streaming import ingestion, sessions


# ---- the star over two batches ---------------------------------------------------------------

#: A document's second result says another total: a tenth more for a third of them, none for some.
_CHANGED = "CASE WHEN o_orderkey % 10 = 7 THEN NULL WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(15,2)) + 100 ELSE CAST(o_totalprice AS DECIMAL(15,2)) END"


def _orders_as_results(orders: DataFrame, second: bool) -> DataFrame:
    total = F.expr(_CHANGED) if second else F.col("o_totalprice").cast("decimal(15,2)")
    values = {
        "invoice_number": F.concat(F.lit("R-" if second else "INV-"), "o_orderkey"), "invoice_date": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "vendor_code": F.concat(F.lit("C"), "o_custkey"), "seller_name": F.concat(F.lit("Seller "), "o_custkey"), "currency": F.col("o_orderpriority"), "grand_total_amount": total.cast("string"),
    }
    entries = [F.struct(F.lit(k).alias("key"), extraction.field(v, F.lit(0.9), F.lit("x")).alias("value")) for k, v in values.items()]
    return orders.select(
        (F.col("o_orderkey") * 2 + int(second)).alias("id"), F.col("o_orderkey").alias("document_id"), F.lit("2024-02-01" if second else "2024-01-01").cast("timestamp").alias("created_at"),
        F.map_from_entries(F.array(*entries)).alias("fields"))


@query(f"""
WITH o AS (SELECT *, month(o_orderdate) <= 8 AS one, month(o_orderdate) >= 6 AS two, CAST(o_totalprice AS DECIMAL(15,2)) AS total, {_CHANGED} AS changed FROM orders),
v AS (SELECT o_custkey, min(o_orderkey) AS first FROM o WHERE one GROUP BY 1),
w AS (SELECT o_custkey, row_number() OVER (ORDER BY first) AS vendor_id FROM v
  UNION ALL SELECT o_custkey, (SELECT count(*) FROM v) + row_number() OVER (ORDER BY min(o_orderkey)) FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM v) GROUP BY 1),
p AS (SELECT *, CASE WHEN one AND o_orderkey % 7 = 0 THEN CAST(10 AS DECIMAL(15,2)) ELSE CAST(0 AS DECIMAL(15,2)) END AS paid, CASE WHEN two THEN changed ELSE total END AS due FROM o)
SELECT o_orderkey AS document_id, vendor_id, CASE WHEN two THEN 'R-' ELSE 'INV-' END || o_orderkey AS invoice_number, due AS amount_due, paid AS amount_paid,
  CAST(due - paid AS DECIMAL(15,2)) AS amount_outstanding, CASE WHEN one AND o_orderkey % 7 = 0 THEN 'PARTIAL' WHEN one OR due IS NOT NULL THEN 'OPEN' ELSE 'UNKNOWN' END AS status
FROM p JOIN w USING (o_custkey)
""")
def kept_star(spark, sf_dir):
    """X-01 to X-04, S-16, S-18: two batches over all orders, the second overlapping the first by three months; payments come between them."""
    store = star_store.StarStore(spark, shared_folder(spark, "kept-star"))
    o = read(spark, sf_dir, "orders")
    store.sync(_orders_as_results(o.where("month(o_orderdate) <= 8"), False), ("orders", 0))
    paid = store.obligations.read().where("document_id % 7 = 0").withColumns({"amount_paid": F.lit(10).cast("decimal(15,2)"), "status": F.lit("PARTIAL"), "amount_outstanding": F.expr("CAST(amount_due - 10 AS DECIMAL(15,2))")})
    store.obligations.upsert(paid, batch=("payments", 0))
    store.sync(_orders_as_results(o.where("month(o_orderdate) >= 6"), True), ("orders", 1))
    due = store.obligations.read().select("document_id", "amount_due", "amount_paid", "amount_outstanding", "status")
    return store.invoices.read().select("document_id", "vendor_id", "invoice_number").join(due, "document_id")


_IDENTITIES = """
d AS (SELECT o_orderkey AS id, o_orderkey % 2 AS batch, CASE WHEN o_orderkey % 3 = 0 THEN 'C' || o_custkey END AS code,
  CASE WHEN o_orderkey % 3 < 2 THEN 'T' || o_custkey // 2 END AS tax, CASE WHEN o_orderkey % 3 > 0 THEN 'Seller ' || o_custkey // 3 END AS name FROM orders),
k AS (SELECT id, batch, 1 AS i, 'c:' || code AS key FROM d WHERE code IS NOT NULL UNION ALL SELECT id, batch, 2, 't:' || tax FROM d WHERE tax IS NOT NULL UNION ALL SELECT id, batch, 3, 'n:' || lower(name) FROM d WHERE name IS NOT NULL),
e AS (SELECT DISTINCT a.batch, a.key AS a, b.key AS b FROM k a JOIN k b ON a.id = b.id),
r AS (SELECT batch, a, b FROM e UNION SELECT r.batch, r.a, e.b FROM r JOIN e ON e.batch = r.batch AND e.a = r.b),
c AS (SELECT batch, a AS key, min(b) AS comp FROM r GROUP BY 1, 2),
g AS (SELECT k.id, k.batch, min(comp) AS comp FROM k JOIN c USING (batch, key) GROUP BY 1, 2)
"""


@query(f"""
WITH RECURSIVE {_IDENTITIES},
n0 AS (SELECT comp, row_number() OVER (ORDER BY min(id)) AS vendor_id FROM g WHERE batch = 0 GROUP BY 1),
m0 AS (SELECT g.id, vendor_id FROM g JOIN n0 USING (comp) WHERE batch = 0),
v0 AS (SELECT vendor_id, arg_min(code, id) FILTER (code IS NOT NULL) AS code, arg_min(tax, id) FILTER (tax IS NOT NULL) AS tax, arg_min(name, id) FILTER (name IS NOT NULL) AS name FROM d JOIN m0 USING (id) GROUP BY 1),
v1 AS (SELECT vendor_id, code, tax, coalesce(name, 'Vendor ' || coalesce(code, tax)) AS name FROM v0),
x AS (SELECT key, min(vendor_id) AS vendor_id FROM (SELECT vendor_id, 'c:' || code AS key FROM v1 WHERE code IS NOT NULL UNION ALL SELECT vendor_id, 't:' || tax FROM v1 WHERE tax IS NOT NULL UNION ALL SELECT vendor_id, 'n:' || lower(name) FROM v1) GROUP BY 1),
h AS (SELECT id, arg_min(vendor_id, i) AS direct FROM k JOIN x USING (key) WHERE batch = 1 GROUP BY 1),
q AS (SELECT comp, min(direct) AS known, min(g.id) AS first FROM g LEFT JOIN h USING (id) WHERE batch = 1 GROUP BY 1),
n1 AS (SELECT comp, known AS vendor_id FROM q WHERE known IS NOT NULL UNION ALL SELECT comp, (SELECT max(vendor_id) FROM v1) + row_number() OVER (ORDER BY first) FROM q WHERE known IS NULL),
m1 AS (SELECT g.id, coalesce(direct, n1.vendor_id) AS vendor_id FROM g JOIN n1 USING (comp) LEFT JOIN h USING (id) WHERE batch = 1),
t AS (SELECT vendor_id, arg_min(code, id) FILTER (code IS NOT NULL) AS code, arg_min(tax, id) FILTER (tax IS NOT NULL) AS tax, arg_min(name, id) FILTER (name IS NOT NULL) AS name FROM d JOIN m1 USING (id) GROUP BY 1),
w AS (SELECT vendor_id, coalesce(v1.code, t.code) AS vendor_code, coalesce(v1.tax, t.tax) AS tax_id, coalesce(v1.name, t.name, 'Vendor ' || coalesce(t.code, t.tax)) AS canonical_name FROM t FULL JOIN v1 USING (vendor_id)),
m AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1)
SELECT m.id AS document_id, m.vendor_id, vendor_code, tax_id, canonical_name FROM m JOIN w USING (vendor_id)
""")
def vendors_across_batches(spark, sf_dir):
    """X-02, J-08: documents known by code, tax id and name in turns; chains of them are one vendor, also over batches."""
    work = Workspace(spark, "vendors")
    c = F.col("o_custkey")
    kind = F.col("o_orderkey") % 3
    d = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.when(kind == 0, F.concat(F.lit("C"), c)).alias("vendor_code"), F.when(kind < 2, F.concat(F.lit("T"), F.expr("o_custkey div 2"))).alias("seller_tax_id"),
        F.when(kind > 0, F.concat(F.lit("Seller "), F.expr("o_custkey div 3"))).alias("seller_name"), F.lit(None).cast("string").alias("address"))
    kept = star_store.KeyedTable(spark, f"{work.folder}/vendors", star_store.VENDORS, ["vendor_id"])
    owners = []
    for batch in (0, 1):
        found = star_store.resolve_vendors(d.where(F.col("document_id") % 2 == batch), kept.read(), work)
        kept.upsert(found.vendors, batch=("orders", batch))
        owners.append(found.documents)
    return owners[0].unionByName(owners[1]).join(kept.read().drop("address"), "vendor_id")


# ---- ingestion and sessions ------------------------------------------------------------------

def _paragraphs(texts: DataFrame) -> DataFrame:
    """Parts between blank lines; a text that begins with an uppercase X can't be read, to show what becomes of such."""
    bad = F.col("full_text").rlike("^X")
    parts = F.filter(F.split("full_text", r"\n\n+"), lambda p: p.rlike(r"[^ \t\n\r\f\x0b]"))
    rows = texts.select("document_id", F.when(bad, "unreadable").alias("error"), F.posexplode_outer(F.when(bad, F.array(F.lit(""))).otherwise(parts)).alias("chunk", "content"))
    return rows.where("content IS NOT NULL").select("document_id", F.lit(1).alias("page_number"), "chunk", F.lit("GENERAL").alias("chunk_type"), F.lit("OTHER").alias("section"), "content", "error")


@query(r"""
WITH t AS (SELECT doc_id, 1 AS n, CASE WHEN doc_id % 19 = 4 THEN ' ' ELSE coalesce(text, '') END AS body FROM documents
  UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 15 = 2 THEN 'X' || coalesce(text, '') WHEN doc_id % 15 = 8 THEN NULL ELSE coalesce(text, '') || chr(10) || chr(10) || 'Signed ' || doc_id END FROM documents WHERE doc_id % 3 = 2),
r AS (SELECT doc_id, n, body, CASE WHEN doc_id % 13 = 5 THEN 'not_found' WHEN doc_id % 11 = 0 THEN 'soft_deleted' WHEN NOT regexp_matches(coalesce(body, ''), '[^ \t\n\r\f\x0b]') THEN 'no_ocr_text' END AS reason,
  coalesce(starts_with(body, 'X'), false) AS bad, len(list_filter(string_split_regex(coalesce(body, ''), '\n\n+'), lambda p: regexp_matches(p, '[^ \t\n\r\f\x0b]'))) AS parts FROM t),
s AS (SELECT doc_id, arg_max(CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN bad THEN 'failed' ELSE 'success' END, n) AS status,
  arg_max(struct_pack(x := coalesce(reason, CASE WHEN bad THEN 'unreadable' END)), n).x AS reason, arg_max(parts, n) FILTER (reason IS NULL AND NOT bad) AS chunk_count FROM r GROUP BY 1)
SELECT doc_id AS document_id, status, reason, CAST(coalesce(chunk_count, 0) AS BIGINT) AS chunk_count, CAST(coalesce(chunk_count, 0) AS BIGINT) AS held FROM s
""")
def ingestion_outcomes(spark, sf_dir):
    """ST-01, ST-02, S-16: every document's text, then new texts for a third of them; the newer ones come first for some."""
    d = read(spark, sf_dir, "documents")
    known = d.where("doc_id % 13 <> 5").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 11 == 0).alias("is_deleted"))
    k, text = F.col("doc_id") % 15, F.coalesce("text", F.lit(""))
    first = d.select((F.col("doc_id") * 2).alias("id"), F.col("doc_id").alias("document_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.when(F.col("doc_id") % 19 == 4, " ").otherwise(text).alias("full_text"))
    second = d.where("doc_id % 3 = 2").select(
        (F.col("doc_id") * 2 + 1).alias("id"), F.col("doc_id").alias("document_id"), F.lit("2024-01-02").cast("timestamp").alias("created_at"),
        F.when(k == 2, F.concat(F.lit("X"), text)).when(k != 8, F.concat(text, F.lit("\n\nSigned "), "doc_id")).alias("full_text"))
    ingestor = ingestion.Ingestor(spark, shared_folder(spark, "ingestion"), known, _paragraphs)
    late = "document_id % 2 = 0"
    ingestor.apply(first.where(f"NOT ({late})").unionByName(second.where(late)), ("batch", 0))
    ingestor.apply(first.where(late).unionByName(second.where(f"NOT ({late})")), ("batch", 1))
    held = ingestor.chunks.read().groupBy("document_id").agg(F.count("*").alias("held"))
    return ingestor.status.read().join(held, "document_id", "left").select("document_id", "status", "reason", "chunk_count", F.coalesce("held", F.lit(0)).alias("held"))


def _offers(spark, sf_dir) -> DataFrame:
    """Conversations in which answers offer to check their own first word, users agree or decline in turns, and some sessions are cleared."""
    c = read(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 4
    word = F.substring(F.regexp_extract("text", r"^[^ .,?]*", 0), 1, 20)
    role = F.when((F.col("turn") == 5) & (F.col("conv_id") % 7 == 3), "clear").otherwise(F.col("role"))
    said = (
        F.when((F.col("role") == "assistant") & (k == 1), F.concat("text", F.lit(" Would you like me to check for "), word, F.lit("?")))
        .when((F.col("role") == "assistant") & (k == 2), F.concat("text", F.lit(" I can look at payment terms.")))
        .when((F.col("role") == "user") & (k == 2), "Yes, please").when((F.col("role") == "user") & (k == 3), " no thanks ").otherwise(F.col("text")))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * (F.col("conv_id") % 5 + 1) * 60)
    return sessions.marked(c.select("conv_id", "turn", at.alias("at"), role.alias("role"), said.alias("text")), "conv_id")


@query(r"""
WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 4 AS k, turn * (conv_id % 5 + 1) * 60 AS tm, CASE WHEN turn = 5 AND conv_id % 7 = 3 THEN 'clear' ELSE role END AS role, role AS r0, text AS t0 FROM conversations),
s AS (SELECT conv_id, turn, tm, role, coalesce(CASE WHEN r0 = 'assistant' AND k = 1 THEN t0 || ' Would you like me to check for ' || substr(regexp_extract(t0, '^[^ .,?]*'), 1, 20) || '?'
  WHEN r0 = 'assistant' AND k = 2 THEN t0 || ' I can look at payment terms.' WHEN r0 = 'user' AND k = 2 THEN 'Yes, please' WHEN r0 = 'user' AND k = 3 THEN ' no thanks ' ELSE t0 END, '') AS text FROM c),
w AS (SELECT *, lower(trim(text)) AS low, list_filter(string_split_regex(lower(trim(text)), '\s+'), lambda w: w <> '') AS words, lower(text) AS a FROM s),
z AS (SELECT *, role = 'user' AND (low IN ('yes', 'yep', 'yeah', 'sure', 'ok', 'okay', 'please', 'please do', 'confirm', 'proceed', 'go ahead') OR len(words) <= 3 AND len(list_intersect(words, ['yes', 'yep', 'yeah', 'sure', 'ok', 'okay', 'please', 'confirm', 'proceed'])) > 0) AS yes,
  role = 'user' AND (low IN ('no', 'nope', 'cancel', 'dont', 'don''t', 'no thanks', 'stop') OR len(words) <= 3 AND len(list_intersect(words, ['no', 'nope', 'cancel', 'dont', 'don''t', 'stop'])) > 0) AS no,
  NOT (len(list_intersect(regexp_extract_all(low, '[a-z0-9'']+'), ['yes', 'yeah', 'yep', 'sure', 'ok', 'okay', 'please', 'confirm', 'proceed', 'no', 'nope', 'cancel', 'dont', 'don''t', 'that', 'it', 'they', 'them', 'those', 'this', 'these', 'second', 'third', 'first', 'last', 'previous', 'other', 'why'])) > 0
      OR regexp_matches(low, '^(what|how) about'))
    AND (len(words) >= 5 AND regexp_matches(low, '^(what is|what are|who is|who are|list all|show all|verify the|calculate|how many)') OR len(words) >= 4 OR regexp_matches(low, 'invoice|vendor|total|amount|date|status')) AS alone,
  nullif(trim(regexp_extract(a, 'would you like (?:me to )?check (?:for )?(?:any other )?([^?]+)\?', 1)), '') AS target FROM w),
f AS (SELECT *, CASE WHEN role = 'assistant' THEN struct_pack(turn := turn, tm := tm, request := CASE WHEN regexp_matches(target, 'payment|term') THEN 'P' WHEN target IS NOT NULL THEN 'Check the document for ' || target || '.' END)
    WHEN role = 'user' AND (yes OR no) OR role = 'clear' THEN struct_pack(turn := turn, tm := tm, request := CAST(NULL AS VARCHAR)) END AS effect,
  CASE WHEN role = 'assistant' THEN struct_pack(turn := turn, note := CASE WHEN regexp_matches(a, 'check|look') THEN CASE WHEN regexp_matches(a, 'payment|terms') THEN 'P' ELSE 'Proceed with checking the details mentioned in: ''' || substr(text, 1, 120) || '''' END END) END AS answer,
  CASE WHEN role = 'clear' THEN turn END AS clear, CASE WHEN role <> 'clear' THEN turn END AS other FROM z),
l AS (SELECT *, last_value(effect IGNORE NULLS) OVER p AS e, last_value(answer IGNORE NULLS) OVER p AS n, last_value(clear IGNORE NULLS) OVER p AS c, last_value(other IGNORE NULLS) OVER p AS o FROM f
  WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, o IS NOT NULL AND (c IS NULL OR o > c) AS history, CASE WHEN yes THEN coalesce(CASE WHEN tm - e.tm <= 150 THEN e.request END, CASE WHEN c IS NULL OR n.turn > c THEN n.note END) END AS agreed FROM l WHERE role = 'user')
SELECT conv_id AS session, turn, CASE WHEN NOT history THEN 'none' WHEN agreed IS NOT NULL THEN 'confirmation_affirmative' WHEN no THEN 'confirmation_negative' WHEN alone THEN 'none' ELSE 'reference' END AS action,
  CASE WHEN NOT history THEN trim(text) WHEN agreed = 'P' THEN 'Check the document for other payment-related terms such as payment terms, early settlement discounts, due dates, or contractual penalties.' WHEN agreed IS NOT NULL THEN agreed
    WHEN no THEN 'The user declined the offer. Acknowledge politely without calling retrieval tools.' ELSE trim(text) END AS request FROM g
""")
def session_offers(spark, sf_dir):
    """ST-08, G-06: pending offers over whole conversations, accepted, declined, replaced, cleared or too old."""
    return sessions.resolve_table(_offers(spark, sf_dir), 150)


# ---- indexes ---------------------------------------------------------------------------------

_STEM = r"regexp_replace({}, '^(.*?\w{{3}})(ings?|ed|ies|es|s|e)$', '\1')"


@query(rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}'']+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}'']+'), 1) AS loc FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, loc, {_STEM.format("word")} AS term FROM w),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}'']+') AS ws FROM benchmark),
stop AS (SELECT unnest(['a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'he', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'that', 'the', 'to', 'was', 'were', 'will', 'with']) AS word),
q AS (SELECT item_id * 3 AS query_id, ws[3] || ' ' || ws[8] AS raw, [ws[3], ws[8]] AS terms, 'and' AS kind FROM b
  UNION ALL SELECT item_id * 3 + 1, '"' || ws[4] || ' ' || ws[5] || '"', [ws[4], ws[5]], 'phrase' FROM b
  UNION ALL SELECT item_id * 3 + 2, ws[2] || ' -' || ws[6], [ws[2], ws[6]], 'not' FROM b),
k AS (SELECT query_id, kind, unnest(terms) AS word, generate_subscripts(terms, 1) AS i FROM q),
l AS (SELECT query_id, kind, i, {_STEM.format("word")} AS term FROM k WHERE kind = 'phrase' OR word NOT IN (SELECT word FROM stop)),
n AS (SELECT query_id, kind, count(*) FILTER (kind <> 'not' OR i = 1) AS wanted, count(*) FILTER (kind = 'not' AND i = 2) AS unwanted FROM l GROUP BY ALL),
o AS (SELECT query_id, kind, i, doc_id, loc FROM l JOIN t USING (term)),
p AS (SELECT a.query_id, a.doc_id, count(*) AS n FROM o a JOIN o b ON a.kind = 'phrase' AND a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.i = 1 AND b.i = 2 AND b.loc = a.loc + 1 GROUP BY ALL),
m AS (SELECT query_id, doc_id, loc, i, lag(i) OVER x AS i0, lag(loc) OVER x AS at0 FROM o WHERE kind = 'and' WINDOW x AS (PARTITION BY query_id, doc_id ORDER BY loc, i)),
two AS (SELECT m.query_id, doc_id, CASE WHEN any_value(wanted) = 1 THEN count(*) * 0.1::DOUBLE WHEN any_value(same) THEN count(DISTINCT loc) * 0.1::DOUBLE ELSE coalesce(sum(0.1::DOUBLE / (loc - at0 + 1)) FILTER (i <> i0), 0) END AS score, count(DISTINCT i) AS n, any_value(wanted) AS wanted
  FROM m JOIN n USING (query_id) JOIN (SELECT query_id, count(DISTINCT term) < count(*) AS same FROM l GROUP BY 1) USING (query_id) GROUP BY ALL),
one AS (SELECT o.query_id, o.doc_id, count(*) * 0.1::DOUBLE AS score FROM o WHERE kind = 'not' AND i = 1 AND NOT EXISTS (SELECT 1 FROM o x WHERE x.query_id = o.query_id AND x.doc_id = o.doc_id AND x.i = 2) GROUP BY ALL),
rest AS (SELECT n.query_id, d.doc_id, 0.0::DOUBLE AS score FROM n, documents d WHERE n.kind = 'not' AND n.wanted = 0 AND n.unwanted > 0 AND d.text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o x WHERE x.query_id = n.query_id AND x.doc_id = d.doc_id AND x.i = 2)),
h AS (SELECT query_id, doc_id, n * 0.1::DOUBLE AS score FROM p UNION ALL SELECT query_id, doc_id, score FROM two WHERE n = wanted UNION ALL SELECT * FROM one UNION ALL SELECT * FROM rest
  UNION ALL SELECT query_id, doc_id, 0.0::DOUBLE FROM q, documents WHERE contains(lower(text), raw)),
g AS (SELECT query_id, doc_id, max(round(score, 9)) AS score FROM h GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM g)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 30
""")
def indexed_search(spark, sf_dir):
    """R-04, T-04: two words, a phrase and an exclusion of every benchmark item, all at once, against an index of all documents."""
    d = read(spark, sf_dir, "documents")
    index = text_index.TextIndex(spark, shared_folder(spark, "text-index"), retrieval.stem).build(d, "doc_id", "text")
    ws = F.regexp_extract_all(F.lower("text"), F.lit(text_index.WORD), F.lit(0))
    w = lambda i: F.get("ws", F.lit(i - 1))
    asked = F.array(
        F.concat_ws(" ", w(3), w(8)), F.concat(F.lit('"'), w(4), F.lit(" "), w(5), F.lit('"')), F.concat(w(2), F.lit(" -"), w(6)))
    q = read(spark, sf_dir, "benchmark").select("item_id", ws.alias("ws")).select("item_id", F.posexplode(asked).alias("i", "query"))
    hits = index.search(q.select((F.col("item_id") * 3 + F.col("i")).alias("query_id"), "query"), d, 30, "doc_id", "text")
    return hits.select("query_id", F.col("chunk").alias("doc_id"), F.round("score", 9).alias("score"), "rank")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, 1 - list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS distance FROM q, embeddings x),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, vec_id, abs(round(distance, 6)) AS distance, rank FROM r WHERE rank <= 30
""")
def clustered_neighbours(spark, sf_dir):
    """R-02, R-03, T-03: the 30 nearest of every fiftieth vector, over an index of all."""
    e = read(spark, sf_dir, "embeddings")
    index = vector_index.VectorIndex(spark, shared_folder(spark, "vector-index"), cells=32).build(e, "vec_id")
    hits, _ = index.search(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 30)
    return hits.select("query_id", F.col("chunk").alias("vec_id"), F.abs(F.round("distance", 6)).alias("distance"), "rank")


# ---- line items of pages ---------------------------------------------------------------------

def _invoice_pages(spark, sf_dir) -> DataFrame:
    """A page for each order: a letter head with more headings than the table, a lesser band above it, and items of one to three lines of uneven height."""
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    li = read(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w))
    lines = F.col("l_partkey") % 3
    li = li.withColumns({"y": 240.0 + F.col("n") * 80, "high": 8.0 + F.col("l_suppkey") % 5})
    y, high = F.col("y"), F.col("high")

    def at(text, x, y, width, height, block, confidence=0.9):
        return F.struct(text.alias("text"), F.lit(float(x)).alias("x"), y.alias("y"), F.lit(float(width)).alias("width"), height.cast("double").alias("high"), block.cast("bigint").alias("block"), F.lit(confidence).alias("confidence"))

    k = F.col("n") * 10
    rows = F.array(
        at(F.col("n").cast("string"), 12, y, 10, high, k), at(F.concat(F.lit("Part "), "l_partkey"), 100, y + 3, 90, high, k + 1), at(F.col("l_quantity").cast("int").cast("string"), 505, y - 2, 20, high, k + 2, 0.7),
        at(F.col("l_extendedprice").cast("decimal(15,2)").cast("string"), 705, y + 1, 60, high, k + 3),
        at(F.when(lines > 0, F.concat(F.lit("from "), "l_suppkey")).otherwise(""), 102, y + 22, 60, high, k + 4), at(F.when(lines > 0, F.lit("by")).otherwise(""), 200, y + 24, 20, high, k + 5),
        at(F.when(lines > 1, F.lower("l_linestatus")).otherwise(""), 104, y + 44, 60, high, k + 6))
    c = lambda text, x, y, width, block: at(F.lit(text), x, F.lit(float(y)), width, F.lit(10.0), F.lit(block))
    fixed = [("Quantity", 10, 10, 60), ("Price", 200, 10, 50), ("Vat", 400, 10, 30), ("Gross Amount", 600, 10, 90), ("Pos", 10, 120, 30), ("Qty", 500, 120, 30),
             ("No.", 10, 200, 30), ("Item Description", 100, 205, 150), ("Qty", 500, 200, 40), ("Net Worth", 700, 196, 90)]
    frame = [c(t, x, y, width, 1_000_000 + i) for i, (t, x, y, width) in enumerate(fixed)]
    # every second page ends with a sum; the others with a remark below 95 % of their height
    last = F.when(F.col("l_orderkey") % 2 == 0, c("Total Net", 600, 1890, 60, 2_000_000)).otherwise(c("7", 505, 1950, 10, 2_000_000))
    late = c("9 days net", 505, 1960, 60, 2_000_001)
    # the order's first line brings the page's own blocks: all blocks come from one pass over the lines
    own = F.when(F.col("n") == 1, F.concat(F.array(*frame), F.array(last, late))).otherwise(F.array().cast("array<struct<text:string,x:double,y:double,width:double,high:double,block:bigint,confidence:double>>"))
    every = F.concat(rows, own)
    page = li.select(F.col("l_orderkey").alias("document_id"), F.inline(every))
    # boxes are made after the blocks stand in rows of their own: code for one box, not for a page of them
    box = F.struct(F.col("x").alias("left"), F.col("y").alias("top"), (F.col("x") + F.col("width")).alias("right"), (F.col("y") + F.col("high")).alias("bottom"),
                   (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("high") / 2).alias("cy"), F.col("high").alias("height"))
    page = page.select("document_id", "text", box.alias("box"), "block", "confidence")
    return page.withColumns({"page_number": F.lit(1), "page_width": F.lit(1000.0), "page_height": F.lit(2000.0)})


@query("""
WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n FROM lineitem)
SELECT l_orderkey AS document_id, n AS item, CAST(n AS VARCHAR) AS item_number, 'Part ' || l_partkey || CASE WHEN l_partkey % 3 > 0 THEN ' from ' || l_suppkey || ' by' ELSE '' END || CASE WHEN l_partkey % 3 > 1 THEN ' ' || lower(l_linestatus) ELSE '' END AS description,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR) AS net_amount, 0.85::DOUBLE AS confidence FROM li
""")
def continued_items(spark, sf_dir):
    """L-05 to L-09, W-08, J-12, A-19: whole line items of every order's page, descriptions broken over up to three lines."""
    found = line_tables.line_items(_invoice_pages(spark, sf_dir))
    return found.select("document_id", "item", "item_number", "description", "quantity", "net_amount", "confidence")


# ---- near-equal queries of a session ---------------------------------------------------------

@query(r"""
WITH q AS (SELECT o_custkey AS session, o_orderkey AS turn, 'What was spent on ' || o_orderpriority || ' orders in ' || monthname(o_orderdate) || ' ' || year(o_orderdate) || CASE WHEN o_orderkey % 4 = 1 THEN ' and with which vendors' ELSE '' END AS text FROM orders),
w AS (SELECT session, turn, list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: length(w) > 2 AND w NOT IN
  ('the', 'for', 'and', 'or', 'in', 'of', 'to', 'document', 'details', 'any', 'other', 'is', 'a', 'an'))) AS s FROM q),
p AS (SELECT a.session, a.turn, b.turn AS other, len(list_intersect(a.s, b.s)) AS n, len(a.s) AS x, len(b.s) AS y FROM w a JOIN w b ON a.session = b.session AND b.turn < a.turn)
SELECT w.session, w.turn, min(other) AS similar_to FROM w LEFT JOIN p ON p.session = w.session AND p.turn = w.turn AND (n / (x + y - n) >= 0.70 OR n >= 2 AND n / least(x, y) >= 0.75) GROUP BY ALL
""")
def repeated_questions(spark, sf_dir):
    """U-06: every order asks a question in its customer's session; which were asked before, in nearly the same words."""
    o = read(spark, sf_dir, "orders")
    text = F.concat(F.lit("What was spent on "), "o_orderpriority", F.lit(" orders in "), F.date_format("o_orderdate", "MMMM yyyy"), F.when(F.col("o_orderkey") % 4 == 1, " and with which vendors").otherwise(""))
    return retrieval.repeated_queries(o.withColumn("text", text), "o_custkey", "o_orderkey", "text")
