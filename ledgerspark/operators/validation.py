"""Validation rules and quality scores (V-01 to V-25, Q-01 to Q-05, A-13 to A-15, A-18).

Rules are expressions that give an issue or null; an array collects them, so that all rules run in
one pass over a row. Issues are structs of rule_type, severity, field_key and message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.dates import iso_calendar_ok, iso_format_ok
from ledgerspark.functions.numbers import strict_decimal
from ledgerspark.functions.text import recognised_currency
from ledgerspark.operators.registry import FIELDS, MANDATORY, MANDATORY_FOR_ALL

TOLERANCE = 0.01
ISSUE = "array<struct<rule_type:string,severity:string,field_key:string,message:string>>"


def issue(when: Column, rule: str, severity: str, key: str, message: str) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule_type"), F.lit(severity).alias("severity"), F.lit(key).alias("field_key"), F.lit(message).alias("message")))


def value_of(key: str, fields: str = "fields") -> Column:
    """F-51: a field's value, blank counting as absent."""
    v = F.try_element_at(F.col(fields), F.lit(key))["value"]
    return F.when(F.trim(v) != "", v)


def _number(key: str) -> Column:
    return strict_decimal(value_of(key)).cast("double")


def mandatory_rules(document_type: str) -> list[Column]:
    """V-01, V-02: the mandatory set, sorted by key."""
    return [
        issue(value_of(k).isNull(), "mandatory", "ERROR", k, f"{k} is required")
        for k in sorted([*MANDATORY.get(document_type, []), *MANDATORY_FOR_ALL])
    ]


def format_rules(document_type: str) -> list[Column]:
    """V-03 to V-07: dates, amounts, tax ids and currency."""
    out = []
    for key, (kind, _) in FIELDS.get(document_type, {}).items():
        v = value_of(key)
        if kind == "date":
            out.append(issue(~iso_format_ok(v), "date_format", "ERROR", key, "not an ISO date"))
            out.append(issue(iso_format_ok(v) & ~iso_calendar_ok(v), "date_calendar", "ERROR", key, "no such day"))
        elif kind == "amount":
            out.append(issue(~v.rlike(r"^\d+(\.\d{1,2})?$"), "amount_format", "ERROR", key, "not an amount"))
        elif key.endswith("tax_id"):
            odd = (F.length(v) >= 13) & v.rlike(r"^\d{2}") & ~v.rlike(r"^\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]$")
            out.append(issue(odd, "tax_id_format", "WARNING", key, "looks like a GST number but isn't one"))
    c = value_of("currency")
    out.append(issue(c.isNotNull() & ~recognised_currency(c), "currency", "WARNING", "currency", "currency not recognised"))
    return out


def off(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """True only where both are known and further apart than the tolerance (with room for binary fractions)."""
    return F.coalesce(F.abs(a - b) > tolerance + 1e-9, F.lit(False))


def business_rules(document_type: str) -> list[Column]:
    """V-08 to V-10 and V-16 to V-20: arithmetic and order between fields."""
    zero = lambda k: F.coalesce(_number(k), F.lit(0.0))
    total, net, tax = _number("grand_total_amount"), _number("subtotal_net_amount"), _number("total_tax_amount")
    match document_type:
        case "NPO":
            made = net + tax - zero("discount") + zero("shipping") + zero("other_charges") + zero("rounding")
            return [issue(off(total, made), "total_mismatch", "WARNING", "grand_total_amount", "total differs from its parts")]
        case "POI" | "MSI":
            return [issue(off(total, net + tax), "total_mismatch", "WARNING", "grand_total_amount", "total differs from net plus tax")]
        case "JER":
            return [issue(off(_number("debit_amount"), _number("credit_amount")), "unbalanced", "ERROR", "debit_amount", "debit differs from credit")]
        case "IMA":
            return [
                issue(F.coalesce(value_of("travel_end_date") < value_of("travel_start_date"), F.lit(False)), "date_order", "ERROR", "travel_end_date", "travel ends before it starts"),
                issue(F.coalesce(_number("approved_amount") > _number("claim_amount"), F.lit(False)), "over_claim", "WARNING", "approved_amount", "more approved than claimed"),
            ]
        case "LCA":
            return [issue(F.coalesce(value_of("expiry_date") <= value_of("issue_date"), F.lit(False)), "date_order", "ERROR", "expiry_date", "expires before it is issued")]
        case "DPR":
            p = _number("advance_percentage")
            return [issue(F.coalesce(~p.between(0, 100), F.lit(False)), "percentage_range", "ERROR", "advance_percentage", "not between 0 and 100")]
    return []


def line_rules(items: str = "line_items", subtotal: Column | None = None, total_tax: Column | None = None) -> list[Column]:
    """V-11 to V-14 over an array of (quantity, unit_price, net_amount, tax_amount, gross_amount)."""
    x = F.col(items)

    def any_line(test):
        return F.exists(x, test)

    def summed(name):
        return F.when(F.size(x) > 0, F.when(~F.exists(x, lambda i: i[name].isNull()), F.aggregate(x, F.lit(0.0), lambda s, i: s + i[name].cast("double"))))

    out = [
        issue(any_line(lambda i: off(i["quantity"] * i["unit_price"], i["net_amount"])), "line_net", "WARNING", items, "quantity times price differs from net"),
        issue(any_line(lambda i: off(i["net_amount"] + i["tax_amount"], i["gross_amount"])), "line_gross", "WARNING", items, "net plus tax differs from gross"),
    ]
    if subtotal is not None:
        out.append(issue(off(summed("net_amount"), subtotal), "subtotal", "WARNING", items, "lines don't add up to the subtotal"))
    if total_tax is not None:
        out.append(issue(off(summed("tax_amount"), total_tax), "total_tax", "WARNING", items, "line taxes don't add up"))
    return out


def tax_rules(taxes: str = "taxes") -> Column:
    """V-15: taxable times rate gives the tax, to 0.05; the rate under either of its names."""
    bad = F.exists(F.col(taxes), lambda t: off(t["taxable_amount"] * F.coalesce(t["rate_percentage"], t["tax_rate"]) / 100, t["tax_amount"], 0.05))
    return issue(bad, "tax_amount", "WARNING", taxes, "taxable times rate differs from tax")


def validate(df: DataFrame, document_type: str, extra: list[Column] | None = None) -> DataFrame:
    """V-24: adds ``issues``, ``error_count``, ``warning_count`` and ``is_valid``."""
    rules = [*mandatory_rules(document_type), *format_rules(document_type), *business_rules(document_type), *(extra or [])]
    return tally(df.withColumn("issues", F.array_compact(F.array(*rules))))


def tally(df: DataFrame) -> DataFrame:
    """A-15."""
    of = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    return df.withColumns({"error_count": of("ERROR"), "warning_count": of("WARNING")}).withColumn("is_valid", F.col("error_count") == 0)


def next_status(status: Column, is_valid: Column) -> Column:
    """V-25."""
    return F.when(is_valid, "VALIDATED").otherwise(status)


def file_duplicates(docs: DataFrame, digest: str = "file_hash", key: str = "id") -> DataFrame:
    """V-21, J-09, W-02: (key, digest, first_id, copies) of every row that shares its bytes with another one.

    Counted by digest, then joined: a digest that half of the rows share splits over tasks.
    """
    groups = docs.groupBy(digest).agg(F.min(key).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return docs.select(key, digest).join(groups, digest)


def semantic_duplicates(rows: DataFrame, key: str = "id") -> DataFrame:
    """V-22, V-23: pairs of (document_type, seller, number) equals, strong with equal date and total, potential where one is missing.

    Rows are first reduced to one for each distinct content, so that equal rows never pair up by the
    square; each row is paired with the first row of every other content that it may repeat, and with
    the first of its own. Two first rows make one pair, under the later one's key. ``duplicate_flags``
    says for every row, the first included, whether it has a duplicate.
    """
    norm = lambda c: F.lower(F.trim(c))
    d = rows.select(key, "document_type", norm(F.col("seller")).alias("seller"), norm(F.col("number")).alias("number"), F.col("date").cast("string").alias("date"), F.col("total").cast("string").alias("total"))
    d = d.where("seller <> '' AND number <> ''")
    group = ["document_type", "seller", "number"]
    contents = d.groupBy(*group, "date", "total").agg(F.min(key).alias("least"), F.count("*").alias("n"))
    equal = contents.where("n > 1 AND date IS NOT NULL AND total IS NOT NULL").select(*group, "date", "total", F.col("least").alias("other_id"))
    strong = d.join(equal, [*group, "date", "total"]).where(F.col(key) != F.col("other_id")).select(key, "other_id", F.lit("strong").alias("kind"))
    # contents that lack nothing, the total, the date or both; each kind of link is joined by what it must have equal
    has = lambda c: c.select(*group, "date", "total", "least")
    full, dated = has(contents.where("date IS NOT NULL AND total IS NOT NULL")), has(contents.where("date IS NOT NULL AND total IS NULL"))
    totalled, bare = has(contents.where("date IS NULL AND total IS NOT NULL")), has(contents.where("date IS NULL AND total IS NULL"))

    def link(x: DataFrame, y: DataFrame, *same: str) -> DataFrame:
        on = [*group, *same]
        return x.select(*on, F.col("least").alias("x")).join(y.select(*on, F.col("least").alias("y")), on).select("x", "y")

    links = link(dated, full, "date").unionByName(link(totalled, full, "total")).unionByName(link(dated, totalled))
    links = links.unionByName(link(bare, full.unionByName(dated).unionByName(totalled)))
    own = contents.where("n > 1 AND (date IS NULL OR total IS NULL)").select(F.col("least").alias("x"), F.col("least").alias("y"))
    links = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(own)
    c = contents.select(*[F.col(k).alias(f"c_{k}") for k in (*group, "date", "total")], F.col("least").alias("x"))
    placed = d.join(c, [*[F.col(k) == F.col(f"c_{k}") for k in group], *[F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in ("date", "total")]]).select(key, "x")
    loose = placed.join(links, "x").where((F.col(key) != F.col("y")) & ~((F.col(key) == F.col("x")) & (F.col("y") > F.col("x"))))
    return strong.unionByName(loose.select(key, F.col("y").alias("other_id"), F.lit("potential").alias("kind")))


def duplicate_flags(rows: DataFrame, key: str = "id") -> DataFrame:
    """V-22, V-23, seen from each row: (key, strong, potential), of rows that have either; both sides of a pair are flagged."""
    pairs = semantic_duplicates(rows, key)
    sides = pairs.select(F.col(key), "kind").unionByName(pairs.select(F.col("other_id").alias(key), "kind"))
    return sides.groupBy(key).agg(F.max(F.col("kind") == "strong").alias("strong"), F.max(F.col("kind") == "potential").alias("potential"))


def plain_number_key(value: Column) -> Column:
    """F-24: an amount as it is compared between documents: commas go, the written form stays, so that 100.0 and 100.00 differ."""
    bare = F.replace(F.trim(value), F.lit(","), F.lit(""))
    return F.coalesce(F.when(bare.try_cast("decimal(38,10)").isNotNull(), bare), F.nullif(F.trim(value), F.lit("")))


def item_amount_rules(items: Column, names: tuple[str, ...] = ("unit_price", "net_amount", "tax_rate", "tax_amount", "gross_amount")) -> Column:
    """V-05: an issue for each amount of each line item (structs of text) that is no plain amount."""

    def of_item(i: Column, at: Column) -> Column:
        found = [F.when(~F.trim(i[n]).rlike(r"^\d+(\.\d{1,2})?$"), F.struct(
            F.lit("amount_format").alias("rule_type"), F.lit("ERROR").alias("severity"),
            F.concat(F.lit("line_items["), at.cast("string"), F.lit(f"].{n}")).alias("field_key"), F.lit("not an amount").alias("message"))) for n in names]
        return F.array_compact(F.array(*found))

    return F.coalesce(F.flatten(F.transform(items, of_item)), F.array().cast(ISSUE))


# What stands for an invoice number, a date, a seller and a buyer in a text.
TOKENS = {
    "invoice_number": ["INVOICE NO", "INVOICE #", "INV-", "INVOICE NUMBER"], "issue_date": ["DATE", "DATE OF ISSUE", "INVOICE DATE"],
    "seller_name": ["SELLER", "VENDOR", "SUPPLIER", "FROM:"], "buyer_name": ["CLIENT", "BUYER", "BILL TO", "CUSTOMER"],
}


def token_flags(text: Column) -> Column:
    """Q-02: (invoice_number, issue_date, seller_name, buyer_name): whether the text has a word for each."""
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.struct(*[up.rlike("|".join(words)).alias(name) for name, words in TOKENS.items()])


def close(a: Column, b: Column) -> Column:
    """F-30: within 1.0 or 2 percent."""
    return (F.abs(a - b) <= 1.0) | (F.abs(a - b) <= 0.02 * F.abs(b))


def total_flags(net_sum: Column, subtotal: Column, vat: Column, grand: Column) -> Column:
    """Q-03: (items_ok, grand_ok): lines against the subtotal, subtotal and tax against the total; null where something is missing."""
    return F.struct(close(net_sum, subtotal).alias("items_ok"), close(F.round(subtotal + vat, 2), grand).alias("grand_ok"))


def flag_tally(flags: Column) -> Column:
    """Q-04, A-18: (passed, failed, warnings, is_valid, pass_rate) of an array of (severity, ok)."""
    count = lambda test: F.size(F.filter(flags, test))
    passed, failed = count(lambda f: f["ok"]), count(lambda f: ~f["ok"] & (f["severity"] == "ERROR"))
    warned = count(lambda f: ~f["ok"] & (f["severity"] == "WARNING"))
    return F.struct(passed.alias("passed"), failed.alias("failed"), warned.alias("warnings"), (failed == 0).alias("is_valid"),
                    F.when(F.size(flags) > 0, passed / F.size(flags)).otherwise(1.0).alias("pass_rate"))


def structure_score(text: Column, n_headers: Column, n_items: Column) -> Column:
    """Q-05's second part: length, parties in columns, headings and items of the table."""
    t = F.coalesce(text, F.lit(""))
    score = F.when(F.length(F.trim(t)) > 50, 0.30).otherwise(0.0) + F.when(F.contains(t, F.lit("Seller:")) & F.contains(t, F.lit("Client:")), 0.30).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when(n_headers >= 4, 0.20).otherwise(0.0) + F.when(n_items > 0, 0.20).otherwise(0.0))


def completeness_score(text: Column) -> Column:
    """Q-05's fourth part: a quarter for each token group that occurs."""
    flags = token_flags(text)
    return sum((F.when(flags[name], 0.25).otherwise(0.0) for name in TOKENS), F.lit(0.0))


def line_checks(items: DataFrame) -> DataFrame:
    """Q-01: per line, whether a description is there and the products agree within 1.0 or 2 percent."""
    return items.withColumns({
        "has_description": F.coalesce(F.trim("description") != "", F.lit(False)),
        "net_ok": close(F.col("quantity") * F.col("unit_price"), F.col("net_amount")),
        "gross_ok": close(F.col("net_amount") * (1 + F.col("vat_rate")), F.col("gross_amount")),
    })


def quality_score(df: DataFrame) -> DataFrame:
    """Q-05: .35 confidence, .25 structure, .25 validation, .15 completeness, and a grade."""
    s = 0.35 * F.col("confidence") + 0.25 * F.col("structure") + 0.25 * F.col("validation") + 0.15 * F.col("completeness")
    return df.withColumn("quality", F.round(s, 4)).withColumn(
        "grade", F.when(F.col("quality") >= 0.85, "excellent").when(F.col("quality") >= 0.70, "good").when(F.col("quality") >= 0.50, "fair").otherwise("poor"))


def sum_if_complete(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A-13: a total only where every item has a value."""
    return df.groupBy(*keys).agg(F.when(F.count("*") == F.count(value), F.sum(value)).alias("total"))


def earliest_flag(df: DataFrame, digest: str, key: str) -> DataFrame:
    """W-02 as a flag."""
    return df.withColumn("is_first", F.col(key) == F.min(key).over(Window.partitionBy(digest)))
