"""Label extraction and field reconciliation (E-01 to E-31, F-02, A-11, A-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.dates import normalize_date
from ledgerspark.functions.numbers import normalize_amount
from ledgerspark.functions.text import clean_code, once
from ledgerspark.operators.registry import COMMON, FIELDS, known_labels

FIELD = "struct<value:string,confidence:double,matched_text:string,is_found:boolean,manually_entered:boolean,provenance:string,conflict_value:string>"
MAX_VALUE = 80


def _quote(label: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in label)


def marked(text: Column) -> Column:
    """The text with a form feed before each known label that a separator follows: where a value must end.

    One scan for all labels, instead of one look-ahead over all labels for each of them.
    """
    stop = "|".join(_quote(k) for k in known_labels())
    return F.regexp_replace(text, rf"(?i)\b({stop})(?!\w)(?=\s*[:\-](?:\s|$))", "\f$1")


def _pattern(label: str) -> str:
    """Label, an optional remark in brackets, a separator, and the value up to two spaces, a line end or the next label."""
    edge = r"\b" if label[-1].isalnum() else ""
    return rf"(?i)\b{_quote(label)}{edge}(?:\s*\([^)\n]{{0,30}}\))?[:\-=]?(?:(?!\f)\s)*([^\n\f]*?)(?=\s{{2,}}|\n|\f|$)"


def field(value: Column, confidence: Column, matched: Column) -> Column:
    """A FieldStruct; without a value it is one that was not found."""
    found = value.isNotNull()
    return F.struct(
        value.alias("value"), F.when(found, confidence).otherwise(0.0).alias("confidence"), F.when(found, matched).alias("matched_text"),
        found.alias("is_found"), F.lit(False).alias("manually_entered"), F.lit(None).cast("string").alias("provenance"), F.lit(None).cast("string").alias("conflict_value"),
    )


def by_labels(text: Column, labels: list[str]) -> Column:
    """F-02 over a ``marked`` text: the first label, in order of preference, that has a value; confidence falls with the order."""

    def option(i: int, label: str) -> Column:
        confidence = max(0.3, round(0.9 - 0.1 * i, 2))
        raw = F.regexp_replace(F.trim(F.regexp_extract(text, _pattern(label), 1)), r"^[:\-\s]+|[:\-\s]+$", "")
        return once(raw, lambda r: F.when(r != "", F.struct(
            F.trim(F.substring(r, 1, MAX_VALUE)).alias("value"),
            F.when(F.length(r) > MAX_VALUE, round(max(0.0, confidence - 0.2), 2)).otherwise(confidence).alias("confidence"), F.lit(label).alias("label"))))

    best = F.coalesce(*[option(i, label) for i, label in enumerate(labels)])
    return once(best, lambda b: field(b["value"], b["confidence"], F.concat_ws(": ", b["label"], b["value"])))


def typed(found: Column, kind: str) -> Column:
    """E-12, E-13: normalised dates and amounts; what can't be read keeps its text at 0.4 of its confidence."""
    if kind == "code":
        return found.withField("value", clean_code(found["value"]))
    if kind not in ("date", "amount"):
        return found
    value = normalize_date(found["value"]) if kind == "date" else normalize_amount(found["value"])
    weak = found["is_found"] & value.isNull()
    return found.withField("value", F.coalesce(value, found["value"])).withField(
        "confidence", F.when(weak, F.round(found["confidence"] * 0.4, 2)).otherwise(found["confidence"]))


def extract(docs: DataFrame, document_type: str, text: str = "text") -> DataFrame:
    """E-01 to E-11: adds ``fields`` (map by key), ``found``, ``total`` and ``overall_confidence`` for one type's documents."""
    keys = {**COMMON, **FIELDS.get(document_type, {})}
    docs = docs.withColumn("_t", marked(F.coalesce(F.col(text), F.lit(""))))
    items = [
        F.struct(F.lit(k).alias("key"), once(by_labels(F.col("_t"), labels), lambda f: typed(f, kind)).alias("value"))
        for k, (kind, labels) in keys.items()
    ]
    return with_confidence(docs.withColumn("fields", F.map_from_entries(F.array(*items))).drop("_t"))


def with_confidence(df: DataFrame) -> DataFrame:
    """A-11: the mean confidence of the fields that were found."""
    found = F.filter(F.map_values("fields"), lambda f: f["is_found"])
    total = F.aggregate(found, F.lit(0.0), lambda s, f: s + f["confidence"])
    return df.withColumns({
        "found": F.size(found), "total": F.size(F.map_keys("fields")),
        "overall_confidence": F.when(F.size(found) > 0, total / F.size(found)).otherwise(0.0),
    })


def same_value(a: Column, b: Column, kind: Column) -> Column:
    """E-25: text without regard to case, dates and amounts by what they mean."""
    text = F.lower(F.trim(a)) == F.lower(F.trim(b))
    date = normalize_date(a) == normalize_date(b)
    amount = F.abs(normalize_amount(a).try_cast("double") - normalize_amount(b).try_cast("double")) <= 0.01
    return text | F.coalesce(F.when(kind == "date", date).when(kind == "amount", amount), F.lit(False))


def reconcile(df: DataFrame, rule: str = "rule", model: str = "model", kind: str = "kind", table_amount: str | None = None) -> DataFrame:
    """E-25 to E-28: two candidate FieldStructs become ``field``, with provenance and the losing value.

    Agreement raises the confidence, an unresolved conflict lowers it to the smaller of the two.
    """
    r, m = F.col(rule), F.col(model)
    has_r, has_m = F.coalesce(r["is_found"], F.lit(False)), F.coalesce(m["is_found"], F.lit(False))
    k = F.col(kind)
    # what each value means is read once, as a column of its own
    date = lambda v: F.when(k == "date", normalize_date(v))
    number = lambda v: F.when(k == "amount", normalize_amount(v).try_cast("double"))
    df = df.withColumn("_means", F.struct(date(r["value"]).alias("rd"), date(m["value"]).alias("md"), number(r["value"]).alias("ra"), number(m["value"]).alias("ma")))
    rd, md, ra, ma = (F.col(f"_means.{x}") for x in ("rd", "md", "ra", "ma"))
    agreed = (F.lower(F.trim(r["value"])) == F.lower(F.trim(m["value"]))) | F.coalesce(rd == md, F.lit(False)) | F.coalesce(F.abs(ra - ma) <= 0.01, F.lit(False))
    only_r_date = (k == "date") & rd.isNotNull() & md.isNull()
    only_m_date = (k == "date") & md.isNotNull() & rd.isNull()
    if table_amount:
        t = F.col(table_amount)
        amount = lambda x: F.coalesce(F.abs(x - t) <= 0.01, F.lit(False))
        r_table, m_table = amount(ra) & ~amount(ma), amount(ma) & ~amount(ra)
    else:
        r_table = m_table = F.lit(False)
    model_wins = m["confidence"] >= r["confidence"]

    def made(value, confidence, matched, provenance, conflict=None):
        return F.struct(
            value.alias("value"), F.round(confidence, 4).alias("confidence"), matched.alias("matched_text"), F.lit(True).alias("is_found"),
            F.lit(False).alias("manually_entered"), F.lit(provenance).alias("provenance"),
            (F.lit(None).cast("string") if conflict is None else conflict).alias("conflict_value"),
        )

    low = F.greatest(F.lit(0.2), F.least(r["confidence"], m["confidence"]))
    none = F.lit(None).cast("string")
    out = (
        F.when(has_r & has_m & agreed, made(r["value"], F.least(F.lit(1.0), F.greatest(r["confidence"], m["confidence"]) + 0.05), r["matched_text"], "agreed"))
        .when(has_r & has_m & (only_r_date | r_table), made(r["value"], F.when(only_r_date, r["confidence"]).otherwise(0.88), r["matched_text"], "reconciled_rule", m["value"]))
        .when(has_r & has_m & (only_m_date | m_table), made(m["value"], F.when(only_m_date, m["confidence"]).otherwise(0.88), m["matched_text"], "reconciled_llm", r["value"]))
        .when(has_r & has_m & model_wins, made(m["value"], low, m["matched_text"], "unresolved", r["value"]))
        .when(has_r & has_m, made(r["value"], low, r["matched_text"], "unresolved", m["value"]))
        .when(has_r, made(r["value"], r["confidence"], r["matched_text"], "rule"))
        .when(has_m, made(m["value"], m["confidence"], m["matched_text"], "llm"))
        .otherwise(F.struct(
            none.alias("value"), F.lit(0.0).alias("confidence"), none.alias("matched_text"), F.lit(False).alias("is_found"),
            F.lit(False).alias("manually_entered"), F.lit("not_found").alias("provenance"), none.alias("conflict_value")))
    )
    return df.withColumn("field", out).drop("_means")


def patched(fields: Column, key: str, value: Column) -> Column:
    """E-31, F-56: a manual correction: full confidence, entered by hand."""
    new = F.struct(
        value.alias("value"), F.lit(1.0).alias("confidence"), value.alias("matched_text"), value.isNotNull().alias("is_found"),
        F.lit(True).alias("manually_entered"), F.lit("manual").alias("provenance"), F.lit(None).cast("string").alias("conflict_value"),
    )
    return F.map_concat(F.map_filter(fields, lambda k, _: k != key), F.create_map(F.lit(key), new))


#: E-32: extraction engines by name; each takes (documents, document_type). Others are registered by their adapters.
ENGINES = {"rule_based": extract}


def engine(name: str):
    """E-32: an engine by name, the rules where it is unknown."""
    return ENGINES.get(name, extract)
