"""Field maps and what models answer: look-ups, paths, coercion, hybrid choice, refinement (F-50 to F-58, E-14 to E-24, E-29 to E-34, R-09, R-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.dates import normalize_date
from ledgerspark.functions.numbers import normalize_amount, parse_numeric, tax_rate
from ledgerspark.functions.text import normalize_currency, normalize_unit, normalize_whitespace, once
from ledgerspark.operators.extraction import field, reconcile, with_confidence
from ledgerspark.operators.registry import COMMON, FIELDS, PATHS

#: Keys that the system fills in itself.
SYSTEM_KEYS = ["document_id", "processing_status", "validation_status", "company_code", "vendor_code", "customer_code"]
_FLAT = {path: key for key, path in PATHS.items()}


def unwrapped(value: Column) -> Column:
    """F-52: a JSON text's ``value``, or the scalar itself."""
    inner = F.get_json_object(value, "$.value")
    return F.when(F.trim(value).startswith("{"), inner).otherwise(value)


def field_value(key: str, fields: str = "fields", canonical: str | None = "canonical") -> Column:
    """F-50, F-51: a value by key: the key itself, its path, its flat key, then the canonical map (path -> text)."""
    path, flat = PATHS.get(key, key), _FLAT.get(key, key)
    at = lambda k: F.try_element_at(F.col(fields), F.lit(k))
    options = [F.when(F.map_contains_key(fields, k), at(k)["value"]) for k in dict.fromkeys([key, path, flat])]
    # a key that is there decides, even without a value
    found = F.lit(None).cast("string")
    for k, v in reversed(list(zip(dict.fromkeys([key, path, flat]), options))):
        found = F.when(F.map_contains_key(fields, k), v).otherwise(found)
    if canonical is None:
        return found
    any_key = F.lit(False)
    for k in dict.fromkeys([key, path, flat]):
        any_key = any_key | F.map_contains_key(fields, k)
    return F.when(any_key, found).otherwise(F.try_element_at(F.col(canonical), F.lit(path)))


def to_paths(fields: Column) -> Column:
    """F-53: a map under flat keys becomes one under paths; keys without a path keep their name."""
    table = F.create_map(*[F.lit(x) for pair in PATHS.items() for x in pair])
    return F.transform_keys(_last_of_path(fields), lambda k, _: F.coalesce(F.try_element_at(table, k), k))


def to_flat(fields: Column) -> Column:
    """F-53, the other way: of two flat keys with one path, the path's own."""
    table = F.create_map(*[F.lit(x) for pair in _FLAT.items() for x in pair])
    return F.transform_keys(fields, lambda k, _: F.coalesce(F.try_element_at(table, k), k))


def _last_of_path(fields: Column) -> Column:
    """Without keys whose path another present key owns: two keys may share a path."""
    owner = {k: _FLAT[p] for k, p in PATHS.items() if _FLAT[p] != k}
    spare = F.create_map(*[F.lit(x) for pair in owner.items() for x in pair])
    return F.map_filter(fields, lambda name, _: ~F.coalesce(F.map_contains_key(fields, F.try_element_at(spare, name)), F.lit(False)))


def flattened(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """F-54: (keys…, path, value) of every leaf of a nested column: struct fields and list places joined with dots."""

    def walk(kind: T.DataType, value: Column, path: Column) -> Column:
        if isinstance(kind, T.StructType):
            return F.concat(*[walk(f.dataType, value[f.name], F.concat_ws(".", F.nullif(path, F.lit("")), F.lit(f.name))) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            each = F.transform(value, lambda x, i: walk(kind.elementType, x, F.concat_ws(".", F.nullif(path, F.lit("")), i.cast("string"))))
            return F.coalesce(F.flatten(each), F.array().cast("array<struct<path:string,value:string>>"))
        return F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))

    leaves = walk(df.schema[column].dataType, F.col(column), F.lit(""))
    return df.select(*keys, F.inline(leaves))


def as_json(value: Column) -> Column:
    """F-57."""
    return F.to_json(value)


def items_of(plain: Column, wrapped: Column, canonical: Column) -> Column:
    """F-58: line items or taxes: the field's own list, its ``value``, else the canonical one."""
    return F.coalesce(plain, wrapped, canonical)


def synced(fields: Column, key: str, value: Column) -> Column:
    """F-56: a correction under the flat key and under its path alike."""
    new = F.struct(
        value.alias("value"), F.lit(1.0).alias("confidence"), value.alias("matched_text"), value.isNotNull().alias("is_found"),
        F.lit(True).alias("manually_entered"), F.lit("manual").alias("provenance"), F.lit(None).cast("string").alias("conflict_value"))
    names = list(dict.fromkeys([key, PATHS.get(key, key), _FLAT.get(key, key)]))
    rest = F.map_filter(fields, lambda k, _: ~k.isin(names))
    return F.map_concat(rest, F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[new for _ in names])))


# ---- hybrid choice (E-14 to E-16, E-18) ---------------------------------------------------------

def _found(f: Column) -> Column:
    return F.coalesce(f["is_found"], F.lit(False))


def hybrid_text(text: Column, spatial: Column) -> Column:
    """E-14: the text's answer from 0.70 up, else the layout's, else the text's after all."""
    return F.when(_found(text) & (text["confidence"] >= 0.70), text).when(_found(spatial), spatial).otherwise(text)


def hybrid_date(text: Column, spatial: Column) -> Column:
    """E-15: the text's answer from 0.60 up if it is a normalised date already."""
    sure = _found(text) & (text["confidence"] >= 0.60) & F.coalesce(normalize_date(text["value"]) == text["value"], F.lit(False))
    return F.when(sure, text).when(_found(spatial), spatial).otherwise(text)


def hybrid_amount(text: Column, spatial: Column, table: Column) -> Column:
    """E-16: the text's answer from 0.60 up if it is a normalised amount, else the layout's, else the table's."""
    sure = _found(text) & (text["confidence"] >= 0.60) & F.coalesce(normalize_amount(text["value"]) == text["value"], F.lit(False))
    return F.when(sure, text).when(_found(spatial), spatial).when(_found(table), table).otherwise(text)


def table_amount(items: Column, role: str) -> Column:
    """E-18, A-13: a FieldStruct from a table's items (net_amount and gross_amount as text), only if every item has a number."""
    number = lambda x: normalize_amount(x).try_cast("double")

    def whole(name: str) -> Column:
        values = F.transform(items, lambda i: number(i[name]))
        full = (F.size(items) > 0) & ~F.exists(values, lambda v: v.isNull())
        return F.when(full, F.aggregate(values, F.lit(0.0), lambda s, v: s + v))

    def made(v: Column, confidence: float, what: str) -> Column:
        return field(F.when(v > 0, F.format_string("%.2f", v)), F.lit(confidence), F.lit(f"table {what}"))

    if role in ("subtotal_net_amount", "net_amount"):
        return once(whole("net_amount"), lambda v: made(v, 0.82, "net total"))
    if role in ("grand_total_amount", "invoice_amount", "gross_amount"):
        return once(whole("gross_amount"), lambda v: made(v, 0.82, "gross total"))
    if role in ("total_tax_amount", "tax_amount"):
        return once(whole("gross_amount") - whole("net_amount"), lambda v: made(F.round(v, 6), 0.80, "tax total"))
    return field(F.lit(None).cast("string"), F.lit(0.0), F.lit(None).cast("string"))


# ---- model answers (E-19 to E-24, E-29) ---------------------------------------------------------

def coerced(answer: Column) -> Column:
    """E-20: one leaf of a model's answer (JSON text of a scalar or of {value, confidence}) as FieldStruct.

    A scalar counts 0.85, as does a value without a positive confidence; blanks are not found.
    """
    boxed = F.trim(answer).startswith("{")
    value = F.nullif(F.trim(F.when(boxed, F.get_json_object(answer, "$.value")).otherwise(answer)), F.lit(""))
    given = F.get_json_object(answer, "$.confidence").try_cast("double")
    confidence = F.when(boxed & (given > 0), given).otherwise(0.85)
    return once(F.struct(value.alias("v"), confidence.alias("c")), lambda x: field(x["v"], x["c"], x["v"]))


def normalised_leaf(path: Column, value: Column) -> Column:
    """E-21: dates, currencies, amounts and percentages by their path; what can't be read stays as it is."""
    date = path.rlike(r"(invoice_date|due_date)$")
    money = path.rlike(r"(^totals\.(subtotal|total_tax|grand_total|discount|shipping|other_charges|rounding)|\.(unit_price|net_amount|tax_amount|gross_amount|taxable_amount))$")
    return (
        F.when(date, F.coalesce(normalize_date(value), value)).when(path.endswith(".currency"), F.coalesce(normalize_currency(value), value))
        .when(path.rlike(r"\.tax_rate$"), F.trim(F.replace(value, F.lit("%"), F.lit("")))).when(money, F.coalesce(normalize_amount(value), value))
        .when(path.rlike(r"\.quantity$"), F.trim(value)).otherwise(value)
    )


def model_fields(answers: DataFrame, key: str = "document_id", path: str = "path", answer: str = "answer") -> DataFrame:
    """E-19 to E-22: (document_id, path, answer) leaves of model answers -> (document_id, fields): FieldStructs under paths and flat keys."""
    leaf = answers.where(F.col(path).isNotNull()).withColumn("_f", coerced(F.col(answer)))
    leaf = leaf.withColumn("_f", F.col("_f").withField("value", normalised_leaf(F.col(path), F.col("_f.value"))))
    flat = F.create_map(*[F.lit(x) for pair in _FLAT.items() for x in pair])
    both = leaf.select(key, F.explode(F.array_distinct(F.array(F.col(path), F.coalesce(F.try_element_at(flat, F.col(path)), F.col(path))))).alias("k"), "_f")
    best = both.groupBy(key, "k").agg(F.max_by("_f", F.struct("_f.confidence", "_f.value")).alias("f"))
    return with_confidence(best.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "f")))).alias("fields")))


def first_answer(df: DataFrame, model: str, rules: str, tries: int = 3) -> DataFrame:
    """E-19, E-24: ``model`` is an array of up to ``tries`` answers (null: failed): the first that came, else the rules' fields; the engine's name stays."""
    got = F.get(F.filter(F.slice(F.col(model), 1, tries), lambda x: x.isNotNull()), 0)
    return df.withColumn("fields", F.coalesce(got, F.col(rules))).withColumn("fell_back", got.isNull())


def with_system_fields(df: DataFrame, document_type: str, fields: str = "fields") -> DataFrame:
    """E-29: what the system knows about a document replaces what was read (document_id, status, codes)."""
    def system(value: Column, confidence: Column) -> Column:
        v = value.cast("string")
        return F.struct(v.alias("value"), confidence.alias("confidence"), F.lit(None).cast("string").alias("matched_text"), v.isNotNull().alias("is_found"),
                        F.lit(False).alias("manually_entered"), F.lit("system").alias("provenance"), F.lit(None).cast("string").alias("conflict_value"))

    known = lambda c: F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)
    made = {
        "document_id": system(F.col("document_id"), known("document_id")), "processing_status": system(F.lit("EXTRACTED"), F.lit(1.0)),
        "validation_status": system(F.coalesce("validation_status", F.lit("PENDING")), known("validation_status")), "company_code": system(F.col("company_code"), known("company_code")),
    }
    for code in ("vendor_code", "customer_code"):
        if code in FIELDS.get(document_type, {}) and code in df.columns:
            made[code] = system(F.col(code), known(code))
    rest = F.map_filter(F.col(fields), lambda k, _: ~k.isin(list(made)))
    return df.withColumn(fields, F.map_concat(rest, F.map_from_arrays(F.array(*[F.lit(k) for k in made]), F.array(*made.values()))))


def flat_schema(document_type: str) -> T.StructType:
    """E-34: the answer expected of a model: every field of the type but the system's own."""
    keys = [k for k in {**COMMON, **FIELDS.get(document_type, {})} if k not in SYSTEM_KEYS]
    return T.StructType([T.StructField(k, T.StringType()) for k in keys])


def normalised_items(items: DataFrame) -> DataFrame:
    """L-10, E-23, E-30: adds norm_* beside the raw columns of line items (all text)."""
    net, gross = parse_numeric(F.col("net_amount")), parse_numeric(F.col("gross_amount"))
    out = items.withColumns({
        "norm_item_number": F.regexp_replace("item_number", r"\D", "").try_cast("int"), "norm_description": normalize_whitespace(F.col("description")),
        "norm_quantity": parse_numeric(F.col("quantity")), "norm_unit": normalize_unit(F.col("unit")), "norm_unit_price": parse_numeric(F.col("unit_price")),
        "norm_net_amount": net, "norm_gross_amount": gross,
    })
    return out.withColumn("norm_vat_rate", tax_rate(F.col("vat_rate"), F.col("norm_net_amount"), F.col("norm_gross_amount")))


# ---- diagnosis (R-09, R-10) ---------------------------------------------------------------------

def _amount(key: str, fields: str = "fields") -> Column:
    return F.try_element_at(F.col(fields), F.lit(key))["value"].try_cast("double")


def audit_reasons(df: DataFrame) -> DataFrame:
    """R-09: adds ``reasons``: why an extraction (fields, overall_confidence, page_count) deserves another look."""
    net, tax, total = _amount("subtotal_net_amount"), _amount("total_tax_amount"), _amount("grand_total_amount")
    core = ["seller_name", "vendor_name", "buyer_name", "customer_name", "invoice_number", "sales_invoice_number"]
    blank = lambda k: F.map_contains_key("fields", k) & F.coalesce(F.nullif(F.try_element_at(F.col("fields"), F.lit(k))["value"], F.lit("")), F.lit("")).eqNullSafe("")
    missing = F.lit(False)
    for k in core:
        missing = missing | blank(k)
    reasons = F.array(
        F.when(F.abs(net + tax - total) > 0.05 + 1e-9, "net plus tax differs from total"),
        F.when(F.abs(_amount("debit_amount") - _amount("credit_amount")) > 0.05 + 1e-9, "debit differs from credit"),
        F.when((F.col("overall_confidence") > 0) & (F.col("overall_confidence") < 0.70), "low confidence"),
        F.when((F.col("page_count") > 1) & missing, "several pages, but no party or number"))
    return df.withColumn("reasons", F.array_compact(reasons))


def refined(df: DataFrame) -> DataFrame:
    """R-10: fills a missing total with net plus tax, or a missing net with total less tax, at 0.85; only where ``reasons`` and ``has_chunks`` say so."""
    net, tax, total = _amount("subtotal_net_amount"), _amount("total_tax_amount"), _amount("grand_total_amount")
    has = lambda k: F.map_contains_key("fields", k)
    go = (F.size("reasons") > 0) & F.col("has_chunks")
    fill_total = go & has("grand_total_amount") & net.isNotNull() & tax.isNotNull() & total.isNull()
    fill_net = go & has("subtotal_net_amount") & total.isNotNull() & tax.isNotNull() & net.isNull() & (total - tax > 0)
    made = lambda v, what: F.create_map(F.lit(what), field(F.format_string("%.2f", v), F.lit(0.85), F.lit("from the other two amounts")))
    without = lambda k: F.map_filter("fields", lambda n, _: n != k)
    new = F.when(fill_total, F.map_concat(without("grand_total_amount"), made(net + tax, "grand_total_amount"))).when(
        fill_net, F.map_concat(without("subtotal_net_amount"), made(total - tax, "subtotal_net_amount"))).otherwise(F.col("fields"))
    return df.withColumn("fields", new)


# ---- two extractions of a document (J-07, E-24, E-26), corrections (E-31), context (E-33) -------

def reconciled(rules: DataFrame, model: DataFrame, schema: DataFrame, table_amounts: DataFrame | None = None) -> DataFrame:
    """J-07, E-24, E-26: (document_id, document_type, fields) twice -> (document_id, key, ord, field): every field of the type's schema.

    ``schema`` is the registry's table (a few hundred rows, broadcast); a document that one side lacks is
    reconciled with nothing. ``table_amounts``: (document_id, key, amount) settles amounts in dispute.
    """
    a = rules.select("document_id", "document_type", F.col("fields").alias("_rules"))
    b = model.select("document_id", F.col("document_type").alias("_type"), F.col("fields").alias("_model"))
    both = a.join(b, "document_id", "full_outer").withColumn("document_type", F.coalesce("document_type", "_type"))
    if table_amounts is not None:  # joined by document, before a document becomes a row for each field
        by_document = table_amounts.groupBy("document_id").agg(F.collect_list(F.struct("key", "amount")).alias("_amounts"))
        both = both.join(by_document, "document_id", "left")
    rows = both.join(F.broadcast(schema.select("document_type", "key", "kind", "ord")), "document_type")
    kept = ["document_id", "key", "kind", "ord", F.try_element_at("_rules", "key").alias("rule"), F.try_element_at("_model", "key").alias("model")]
    if table_amounts is None:
        return reconcile(rows.select(*kept)).select("document_id", "key", "ord", "field")
    own = F.transform(F.filter("_amounts", lambda x: x["key"] == F.col("key")), lambda x: x["amount"])
    rows = rows.select(*kept, F.explode_outer(own).alias("_table"))  # a field without an amount stays
    return reconcile(rows, table_amount="_table").select("document_id", "key", "ord", "field")


def kind_of(key: str) -> str:
    """E-31: what a field's name says of its kind."""
    return "date" if key.endswith("date") else "amount" if key.endswith(("amount", "rate")) else "code" if key.endswith(("number", "code", "_id")) else "text"


def typed_correction(fields: Column, key: str, value: Column) -> Column:
    """E-31: a correction as F-56, the value normalised by its kind where it can be read."""
    kind = kind_of(key)
    read = normalize_date(value) if kind == "date" else normalize_amount(value) if kind == "amount" else F.trim(value)
    return synced(fields, key, F.coalesce(read, F.trim(value)))


def context_text(*parts: tuple[str, Column]) -> Column:
    """E-33: titled sections of a context, blank ones left out."""
    some = [F.when(F.trim(v) != "", F.concat(F.lit(f"## {title}\n"), F.trim(v))) for title, v in parts]
    return F.array_join(F.array_compact(F.array(*some)), "\n\n")
