"""No statement, however it is written, shows a role more than its rows, columns and tables."""

import pytest

from ledgerspark.plans.governance import MAX_ROWS, Principal, Refused, check_statement, execute, fetch, secured

ANALYST, AUDITOR, ADMIN = Principal("FINANCE_ANALYST", 1), Principal("AUDITOR", 9), Principal("ADMIN", 8)


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, f"f{i}.pdf", "NPO", "APPROVED", 1 + i % 2, i == 5) for i in range(300)]
    return {
        "documents": spark.createDataFrame(docs, "id bigint, original_filename string, document_type string, status string, uploaded_by bigint, is_deleted boolean"),
        "invoices": spark.createDataFrame([(i, i, i % 7, float(i)) for i in range(300)], "id bigint, document_id bigint, vendor_id bigint, grand_total_amount double"),
        "vendors": spark.createDataFrame([(i, f"V{i}") for i in range(9)], "id bigint, canonical_name string"),
        "users": spark.createDataFrame([(1, "a", "secret")], "id bigint, username string, password_hash string"),
    }


@pytest.mark.parametrize("sql", [
    "SELECT id FROM documents WHERE 1 = 1 OR uploaded_by = 2",
    "SELECT d.id FROM documents d WHERE d.id IN (SELECT document_id FROM invoices) OR TRUE",
    "WITH x AS (SELECT * FROM documents) SELECT id FROM x UNION ALL SELECT document_id FROM invoices",
    "SELECT document_id AS id FROM invoices ORDER BY id DESC",
])
def test_an_analyst_sees_own_live_documents_only(spark, tables, sql):
    ids = [r["id"] for r in execute(spark, sql, tables, ANALYST).collect()]
    assert ids and len(ids) <= MAX_ROWS and all(i % 2 == 0 and i != 5 for i in ids)


def test_other_roles_see_all_but_deleted(spark, tables):
    n = execute(spark, "SELECT count(*) AS n FROM invoices", tables, AUDITOR).first()["n"]
    assert n == 299


@pytest.mark.parametrize("sql", [
    "", "DROP TABLE documents", "INSERT INTO documents VALUES (1)", "not sql at all", "SHOW TABLES", "SET a = b",
    "SELECT * FROM parquet.`/etc`", "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT input_file_name() FROM documents",
])
def test_refused_statements(spark, sql):
    with pytest.raises(Refused):
        check_statement(spark, sql)


def test_hidden_columns_and_tables(spark, tables):
    assert secured("users", tables, ADMIN).columns == ["id", "username"]
    for who in (ANALYST, AUDITOR):
        with pytest.raises(Refused):
            secured("users", tables, who)
    with pytest.raises(Exception, match="users|TABLE_OR_VIEW"):
        execute(spark, "SELECT * FROM users", tables, AUDITOR).collect()
    with pytest.raises(Refused):
        secured("documents", tables, ANALYST, "forbidden")


@pytest.fixture(scope="module")
def outside(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("outside"))
    df = spark.createDataFrame([(1, "hidden")], "id bigint, word string")
    df.write.mode("overwrite").option("path", f"{at}/t").saveAsTable("default.secret_t")
    df.write.parquet(f"{at}/plain.parquet")
    df.createOrReplaceGlobalTempView("gsecret")
    df.createOrReplaceTempView("invoice_payments")
    yield at
    spark.sql("DROP TABLE default.secret_t")
    spark.catalog.dropTempView("invoice_payments")


@pytest.mark.parametrize("sql", [
    "SELECT * FROM default.secret_t", "SELECT * FROM secret_t", "SELECT * FROM global_temp.gsecret", "SELECT * FROM parquet./* x */`{at}/plain.parquet`",
    "WITH x AS (SELECT * FROM documents) INSERT INTO default.secret_t SELECT id, status FROM x", "SELECT * FROM invoice_payments", "SELECT * FROM range(5)",
    "SELECT id FROM documents WHERE id IN (SELECT id FROM default.secret_t)", "SELECT (SELECT max(word) FROM secret_t) AS w FROM documents",
    "SELECT id FROM documents WHERE EXISTS (SELECT 1 FROM parquet.`{at}/plain.parquet`)", "WITH a AS (SELECT * FROM secret_t) SELECT * FROM a",
    "SELECT current_user FROM documents", "SELECT current_user() AS u", "SELECT spark_catalog.default.f(1)", "SELECT max(reflect('java.lang.System', 'getenv')) FROM documents",
    "SELECT id FROM documents ORDER BY (SELECT max(id) FROM secret_t)", "SELECT d.id FROM documents d JOIN secret_t s ON d.id = s.id", "TABLE default.secret_t",
    "WITH secret_t AS (SELECT * FROM secret_t) SELECT * FROM secret_t", "WITH a AS (WITH secret_t AS (SELECT * FROM secret_t) SELECT * FROM secret_t) SELECT * FROM a",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a", "WITH a AS (SELECT 1 AS x) SELECT * FROM (WITH secret_t AS (SELECT * FROM a) SELECT x FROM secret_t) t JOIN secret_t s ON s.id = t.x",
    "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT n FROM r", "SELECT id FROM documents WHERE id IN (WITH secret_t AS (SELECT id FROM secret_t) SELECT id FROM secret_t)",
    "SELECT repeat('x', 2000000000) FROM documents", "SELECT lpad('x', 2000000000, 'y') FROM documents",
    "FROM secret_t SELECT *", "SELECT assert_true(false)", "SELECT id FROM documents LATERAL VIEW explode(array(1)) t AS x", "SELECT * FROM IDENTIFIER('default.secret_t')",
])
def test_nothing_outside_the_views_is_reached(spark, tables, outside, sql):
    with pytest.raises(Refused):
        execute(spark, sql.replace("{at}", outside), tables, ANALYST)
    assert spark.table("default.secret_t").count() == 1


def test_the_resolved_plan_is_a_second_wall(spark, tables, outside):
    from ledgerspark.plans.governance import check_resolved

    resolved = lambda sql: spark.sql(sql)._jdf.queryExecution().analyzed()
    spark.sql("SELECT 1 AS id").createOrReplaceTempView("documents")
    try:
        check_resolved(resolved("SELECT id FROM documents WHERE id IN (SELECT id FROM documents) UNION SELECT 2"), {"documents"})
        for sql in ("SELECT * FROM default.secret_t", "SELECT id FROM documents WHERE EXISTS (SELECT 1 FROM default.secret_t)", "WITH a AS (SELECT * FROM default.secret_t) SELECT 1 AS x FROM documents, a",
                    "SELECT * FROM invoice_payments", "SELECT (SELECT max(word) FROM default.secret_t) AS w", f"SELECT * FROM parquet.`{outside}/plain.parquet`"):
            with pytest.raises(Refused):
                check_resolved(resolved(sql), {"documents"})
    finally:
        spark.catalog.dropTempView("documents")


def test_constant_selects_run(spark, tables):
    assert execute(spark, "SELECT 1 AS x", tables, ANALYST).first()["x"] == 1
    assert execute(spark, "WITH c AS (SELECT 2 AS x) SELECT c.x + d.n AS s FROM c CROSS JOIN (SELECT count(*) AS n FROM documents) d", tables, ANALYST).first()["s"] > 2


def test_names_of_the_statement_itself_are_tables_too(spark, tables):
    sql = "WITH a AS (SELECT id FROM documents), b AS (SELECT id FROM a) SELECT count(*) AS n, (SELECT max(id) FROM b) AS m FROM b"
    assert execute(spark, sql, tables, ANALYST).first()["n"] > 0


def test_nulls_are_ordered_explicitly(spark, tables):
    t = tables | {"vendors": spark.createDataFrame([(2, "b"), (None, "a"), (1, None)], "id bigint, canonical_name string")}
    ids = lambda sql: [r["id"] for r in execute(spark, sql, t, AUDITOR).collect()]
    assert ids("SELECT id FROM vendors ORDER BY id") == [1, 2, None]
    assert ids("SELECT id FROM vendors ORDER BY id DESC") == [None, 2, 1]
    assert ids("SELECT id FROM vendors ORDER BY id ASC NULLS FIRST, canonical_name") == [None, 1, 2]
    ranked = "SELECT id, row_number() OVER (ORDER BY id) AS n FROM vendors ORDER BY n DESC"
    assert ids(ranked) == [None, 2, 1]


def test_a_query_beyond_its_time_is_cancelled_and_no_other_job(spark, tables):
    import time

    slow = "SELECT count(*) AS n FROM documents a JOIN documents b ON a.id <> b.id JOIN documents c ON c.id <> a.id JOIN documents d ON d.id <> b.id AND sqrt(d.id * c.id + a.id) < 0"
    with pytest.raises(Exception, match="(?i)cancel"):
        fetch(spark, slow, tables, ADMIN, seconds=1.0)
    got = fetch(spark, "SELECT id FROM vendors ORDER BY id", tables, AUDITOR, seconds=30.0)
    assert got["row_count"] == 9 and got["columns"] == ["id"] and got["rows"][0] == {"id": 0}
    execute(spark, "SELECT id FROM vendors", tables, AUDITOR)
    fetch(spark, "SELECT id FROM vendors", tables, AUDITOR, seconds=2.0)
    # an unrelated job of this thread outlives every timer
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert spark.sparkContext.parallelize(range(4), 4).map(lambda i: time.sleep(3) or i).count() == 4
