"""Governed SQL: role views with row and column security, statement checks, row limit (Z-01 to Z-11, S-03, P-12, J-05, ST-10).

A role's session holds secured views only. Spark resolves every mention of a table, at any depth, to
its view, so that no predicate has to be injected into the user's text and no OR can weaken it. What
could reach past the views (other relations, paths, table functions, commands) is refused from the
parsed plan: every node and every function of it must be on a list.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 100
# Tables of each role and columns of each table.
ROLE_TABLES = {
    "FINANCE_ANALYST": ["documents", "extraction_results", "classification_results", "validation_results", "invoices", "invoice_line_items", "payment_obligations", "vendors", "vendor_aliases", "invoice_payments"],
    "FINANCE_MANAGER": ["documents", "extraction_results", "classification_results", "validation_results", "invoices", "invoice_line_items", "payment_obligations", "vendors", "vendor_aliases", "invoice_payments"],
    "AUDITOR": ["documents", "extraction_results", "classification_results", "validation_results", "invoices", "invoice_line_items", "payment_obligations", "vendors", "vendor_aliases", "invoice_payments", "workflow_history"],
    "ADMIN": ["documents", "extraction_results", "classification_results", "validation_results", "invoices", "invoice_line_items", "payment_obligations", "vendors", "vendor_aliases", "invoice_payments", "users", "workflow_history"],
}
COLUMNS = {
    "documents": ["id", "original_filename", "stored_filename", "document_type", "status", "company_code", "vendor_code", "validation_status", "file_size_bytes", "mime_type", "page_count", "is_deleted", "uploaded_by", "created_at", "updated_at"],
    "extraction_results": ["id", "document_id", "engine_name", "overall_confidence", "fields", "created_at", "updated_at"],
    "validation_results": ["id", "document_id", "is_valid", "error_count", "warning_count", "issues", "created_at", "updated_at"],
    "classification_results": ["id", "document_id", "predicted_type", "confidence", "scores_by_type", "created_at", "updated_at"],
    "users": ["id", "username", "email", "full_name", "role", "is_active", "created_at"],
    "invoices": ["id", "document_id", "source_extraction_result_id", "invoice_number", "invoice_date", "vendor_id", "buyer_name", "buyer_tax_id", "currency", "subtotal_amount", "tax_amount", "discount_amount", "shipping_amount", "rounding_amount", "other_charges_amount", "grand_total_amount", "po_number", "created_at", "updated_at"],
    "vendors": ["id", "canonical_name", "vendor_code", "tax_id", "address", "created_at", "updated_at"],
    "vendor_aliases": ["id", "vendor_id", "alias", "created_at"],
    "invoice_line_items": ["id", "invoice_id", "line_number", "description", "quantity", "uom", "unit_price", "net_amount", "tax_rate", "tax_amount", "gross_amount", "created_at"],
    "payment_obligations": ["id", "invoice_id", "amount_due", "amount_paid", "amount_outstanding", "currency", "due_date", "status", "payment_terms", "paid_at", "early_payment_deadline", "early_payment_discount", "late_payment_penalty", "created_at", "updated_at"],
    "invoice_payments": ["id", "invoice_id", "payment_date", "amount", "currency", "payment_reference", "payment_method", "created_at"],
    "workflow_history": ["id", "document_id", "action", "from_status", "to_status", "comment", "performed_by", "created_at"],
}
_BY_DOCUMENT = {"extraction_results", "classification_results", "validation_results", "invoices", "workflow_history"}
_BY_INVOICE = {"invoice_line_items", "payment_obligations", "invoice_payments"}
#: Nodes that a parsed query may consist of.
NODES = {
    "Project", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Filter", "UnresolvedHaving", "UnresolvedWith", "WithWindowDefinition",
    "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedRelation", "Join", "UnresolvedSubqueryColumnAliases", "OneRowRelation", "UnresolvedInlineTable",
}
#: Functions that a query may call; none of them looks outside its arguments.
FUNCTIONS = set("""
abs add_months any approx_count_distinct array array_agg avg bool_and bool_or bround cast cbrt ceil ceiling char_length coalesce collect_list collect_set
concat concat_ws contains corr count count_if cume_dist current_date current_timestamp date date_add date_diff date_format date_from_unix_date date_part
date_sub date_trunc dateadd datediff datepart day dayofmonth dayofweek dayofyear dense_rank element_at endswith every exp extract first first_value floor
format_number greatest hour if ifnull ilike initcap instr isnotnull isnull lag last last_day last_value lcase lead least left len length like ln log log10
lower ltrim make_date map_keys map_values max max_by mean median min min_by minute mod mode month months_between negative next_day now nth_value ntile
nullif nvl nvl2 percent_rank percentile percentile_approx pmod position power quarter rank regexp_count regexp_extract regexp_like regexp_replace
replace right rlike round row_number rtrim second sign size some split split_part sqrt startswith std stddev stddev_pop stddev_samp string strpos
substr substring sum to_char to_date to_number to_timestamp translate trim trunc try_add try_avg try_cast try_divide try_multiply try_subtract try_sum
try_to_date try_to_number ucase unix_date upper var_pop var_samp variance weekday weekofyear year timestampdiff timestampadd decimal double int bigint
""".split())
#: Bare names that Spark would take for the session's own properties.
SESSION_NAMES = {"current_user", "session_user", "user", "current_catalog", "current_database", "current_schema", "current_path", "grouping__id"}


class Refused(ValueError):
    """A statement that the governed surface does not run."""


@dataclass(frozen=True)
class Principal:
    role: str
    user_id: int

    def __post_init__(self):
        if self.role not in ROLE_TABLES:
            raise Refused(f"unknown role {self.role!r}")


def secured(name: str, tables: dict[str, DataFrame], who: Principal, analyst_policy: str = "scoped") -> DataFrame:
    """Z-04 to Z-07, Z-10: one table as a role may see it."""
    if analyst_policy not in ("scoped", "forbidden"):
        raise Refused(f"unknown policy {analyst_policy!r}")
    if name not in ROLE_TABLES[who.role]:
        raise Refused(f"{who.role} may not read {name}")
    analyst = who.role == "FINANCE_ANALYST"
    if analyst and analyst_policy == "forbidden":
        raise Refused("analysts may not query")
    docs = tables["documents"].where(~F.col("is_deleted"))
    if analyst:
        docs = docs.where(F.col("uploaded_by") == F.lit(who.user_id))
    ids = docs.select(F.col("id").alias("_doc"))
    df = tables[name]
    if name == "documents":
        out = docs
    elif name in _BY_DOCUMENT:
        out = df.join(ids, df["document_id"] == ids["_doc"], "left_semi")
    elif name in _BY_INVOICE:
        inv = secured("invoices", tables, who, analyst_policy).select(F.col("id").alias("_inv"))
        out = df.join(inv, df["invoice_id"] == inv["_inv"], "left_semi")
    elif name in ("vendors", "vendor_aliases"):
        out = df
        if analyst:
            own = secured("invoices", tables, who, analyst_policy).select(F.col("vendor_id").alias("_v"))
            out = df.join(own, df["id" if name == "vendors" else "vendor_id"] == own["_v"], "left_semi")
    elif name == "users" and not analyst:
        out = df
    else:
        raise Refused(f"no policy for {name}")  # fail closed
    return out.select(*[c for c in COLUMNS[name] if c in out.columns])


def _parsed(spark: SparkSession, sql: str):
    if not sql or not sql.strip():
        raise Refused("empty statement")
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused(f"not a statement: {str(e).splitlines()[0]}") from e


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _walk(plan):
    """(is a relation or operator, node, WITH names that hold there) of a parsed plan: common table expressions, expressions and their subqueries included.

    The name of a WITH holds in the tables defined after it and in the query below, not in its own table.
    """
    stack = [(True, plan, frozenset())]
    while stack:
        whole, node, names = stack.pop()
        yield whole, node, names
        if whole:
            inner = names
            if _name(node) == "UnresolvedWith":  # it keeps its tables beside its children
                for pair in _listed(node.cteRelations()):
                    stack.append((True, pair._2(), inner))
                    inner |= {pair._1().lower()}
            stack += [(True, x, inner) for x in _listed(node.children())] + [(False, x, inner) for x in _listed(node.expressions())]
        else:
            stack += [(False, x, names) for x in _listed(node.children())]
            if _name(node) in ("ScalarSubquery", "ListQuery", "Exists"):
                stack.append((True, node.plan(), names))
            elif "Subquery" in _name(node) and _name(node) != "InSubquery":
                raise Refused(f"{_name(node)} is not allowed")


def check_statement(spark: SparkSession, sql: str, allowed: set[str] | None = None) -> None:
    """Z-01 to Z-04: one parseable query made of listed nodes and functions, over allowed tables and its own WITH names alone."""
    allowed = set(COLUMNS) if allowed is None else allowed
    for whole, node, names in _walk(_parsed(spark, sql)):
        kind = _name(node)
        if whole:
            if kind not in NODES:
                raise Refused(f"only queries are run, not {kind}")
            if kind == "UnresolvedRelation":
                name = [str(x) for x in _listed(node.multipartIdentifier())]
                if len(name) != 1 or name[0].lower() not in allowed | names:
                    raise Refused(f"the table {'.'.join(name)} is not allowed")
        elif kind == "UnresolvedFunction":
            name = [str(x) for x in _listed(node.nameParts())]
            if len(name) != 1 or name[0].lower() not in FUNCTIONS:
                raise Refused(f"the function {'.'.join(name)} is not allowed")
        elif kind == "UnresolvedAttribute":
            name = [str(x).lower() for x in _listed(node.nameParts())]
            if len(name) == 1 and name[0] in SESSION_NAMES:
                raise Refused(f"{name[0]} is not allowed")
        elif kind in ("CurrentUser", "CurrentDatabase", "CurrentCatalog", "SessionUser") or kind.startswith("Unresolved") and "Identifier" in kind:
            raise Refused(f"{kind} is not allowed")


#: Leaves of a resolved statement that hold no stored data.
PLAIN_LEAVES = {"OneRowRelation", "LocalRelation", "CTERelationRef", "ResolvedInlineTable"}


def check_resolved(plan, views: set[str]) -> None:
    """The second wall: whatever the text looked like, each leaf of the resolved plan lies in a registered view or holds no stored data."""
    stack = [plan]
    while stack:
        node = stack.pop()
        if _name(node) == "View":
            name = str(node.desc().identifier().table()).lower()
            if not node.isTempView() or name not in views:
                raise Refused(f"the view {name} is not allowed")
            continue
        below = _listed(node.children())
        if not below and _name(node) not in PLAIN_LEAVES:
            raise Refused(f"{_name(node)} is not allowed")
        stack += below
        inside = _listed(node.expressions())
        while inside:
            e = inside.pop()
            inside += _listed(e.children())
            if _name(e) in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
                stack.append(e.plan())


def explicit_nulls(spark: SparkSession, sql: str) -> str:
    """Section 2.6: nulls sort as in the surface's dialect, last when ascending and first when descending, where the statement does not say."""
    ends = []
    for whole, node, _ in _walk(_parsed(spark, sql)):
        if not whole and _name(node) == "SortOrder" and node.origin().stopIndex().isDefined():
            start, stop = node.origin().startIndex().get(), node.origin().stopIndex().get() + 1
            if not re.search(r"(?i)\bnulls\s+(first|last)\s*$", sql[start:stop]):
                ends.append((stop, " NULLS FIRST" if str(node.direction().sql()).upper() == "DESC" else " NULLS LAST"))
    for stop, text in sorted(set(ends), reverse=True):
        sql = sql[:stop] + text + sql[stop:]
    return sql


def execute(spark: SparkSession, sql: str, tables: dict[str, DataFrame], who: Principal, analyst_policy: str = "scoped") -> DataFrame:
    """Z-01 to Z-10: at most 100 rows of a governed query, not yet run.

    The role's views live in a session of their own; a table for which no data is given can't be named.
    """
    named = [n for n in ROLE_TABLES[who.role] if n in tables]
    check_statement(spark, sql, set(named))
    own = spark.newSession()
    for name in named:
        _register(own, name, secured(name, tables, who, analyst_policy))
    out = own.sql(explicit_nulls(spark, _clamped(sql)))
    check_resolved(out._jdf.queryExecution().analyzed(), set(named))
    return out.limit(MAX_ROWS)


def fetch(spark: SparkSession, sql: str, tables: dict[str, DataFrame], who: Principal, analyst_policy: str = "scoped", seconds: float = 5.0) -> dict:
    """S-03, ST-10: runs a governed query: {sql, row_count, columns, rows, execution_time_ms}; its jobs, and no others, are cancelled beyond the time."""
    out = execute(spark, sql, tables, who, analyst_policy)
    sc = spark.sparkContext
    kept = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    group = f"governed-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, sc.cancelJobGroup, [group])
    timer.daemon = True
    began = time.perf_counter()
    sc.setJobGroup(group, "governed query", interruptOnCancel=True)
    timer.start()
    try:
        rows = [r.asDict() for r in out.collect()]  # MAX_ROWS at most
    finally:
        timer.cancel()
        for k, v in kept.items():
            sc.setLocalProperty(k, v)
    return {"sql": sql, "row_count": len(rows), "columns": out.columns, "rows": rows, "execution_time_ms": round(1000 * (time.perf_counter() - began))}


def _register(own: SparkSession, name: str, view: DataFrame) -> None:
    plan = own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, view._jdf.logicalPlan())
    plan.createOrReplaceTempView(name)


def _clamped(sql: str) -> str:
    return sql.strip().rstrip(";")
