"""Rule-based and trained document classification (K-01 to K-07)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.text import contains_term, once
from ledgerspark.operators.registry import TYPES

#: Terms of a kind that a trained classifier keeps, the most frequent ones.
TERMS = 1 << 18
#: Below this the answer is UNKNOWN.
FLOOR = 0.23
# Fixed values: (weight, term or /pattern/) by type, each pattern whole.
RULES: dict[str, list[tuple[float, str]]] = {
    "POI": [
        (2.5, "purchase order"),
        (3.0, r"/\bpo\s*(?:number|no\.?|#)?\s*[:\-]?\s*(?=[a-z0-9\-]{0,10}\d)[a-z0-9\-]{3,}"),
        (2.5, r"/\bpo\s*(?:number|no\.?|#)"),
        (2.0, r"/\binvoice\s*(?:number|no\.?|#)?\s*[:\-]?\s*(?=[a-z0-9\-]{0,10}\d)[a-z0-9\-]{3,}"),
        (1.5, "invoice number"),
        (1.0, "invoice"),
        (1.5, "grn"),
        (1.0, "srn"),
        (1.0, r"/\b(?:vendor|seller|supplier)\b"),
        (1.0, r"/\b(?:bill\s+to|client|buyer)\b"),
        (1.0, "tax invoice"),
        (1.0, "gstin"),
    ],
    "NPO": [
        (2.5, "invoice number"),
        (3.0, r"/\binvoice\s*(?:number|no\.?|#)?\s*[:\-]?\s*(?=[a-z0-9\-]{0,10}\d)[a-z0-9\-]{3,}"),
        (2.5, r"/\binvoice\s*no\.?"),
        (1.5, "invoice"),
        (2.0, r"/\b(?:bill\s+to|client|buyer|billed\s+to)\b"),
        (2.0, r"/\b(?:vendor|seller|supplier|billed\s+by)\b"),
        (2.0, "vendor code"),
        (2.0, "tax invoice"),
        (1.5, "gstin"),
        (1.5, r"/\btax\s*id\b"),
        (1.5, "date of issue"),
        (1.5, r"/\b(?:amount\s+due|gross\s+worth|net\s+worth|total\s+amount|grand\s+total)\b"),
        (1.5, "remit to"),
    ],
    "IMA": [
        (3.0, "reimbursement"),
        (3.0, "expense claim"),
        (2.5, "expense report"),
        (1.5, r"/\btravel\b"),
        (2.5, "travel end date"),
        (1.5, r"/\bemployee\b"),
        (2.0, "claim form"),
        (1.5, "per diem"),
        (1.0, r"/\bmileage\b"),
    ],
    "MSI": [
        (1.5, r"/\bcustomer\b"),
        (2.5, "customer code"),
        (1.5, "customer name"),
        (3.0, "sales invoice"),
        (3.0, "msi invoice"),
        (1.0, "invoice number"),
        (2.0, "ship to"),
        (2.0, "sold to"),
        (2.0, "ship mode"),
        (1.5, "order id"),
    ],
    "PSI": [
        (3.0, "pay in slip"),
        (3.0, "pay-in slip"),
        (2.5, "pis number"),
        (1.5, r"/\bdeposit\b"),
        (2.0, "deposit amount"),
        (1.0, r"/\breceipt\b"),
        (2.5, "customer receipt"),
        (1.0, "bank name"),
        (1.0, r"/\bcheque\b"),
        (1.5, "cash deposit"),
    ],
    "JER": [
        (3.0, "journal entry"),
        (2.5, "journal voucher"),
        (2.5, "gl account"),
        (3.0, "gl account code"),
        (2.0, "general ledger"),
        (1.5, r"/\bdebit\b"),
        (1.5, r"/\bcredit\b"),
        (1.5, "posting date"),
        (1.0, r"/\bnarration\b"),
        (2.0, r"/\bje\s*(?:number|no\.?|#)?\s*[:\-]?\s*(?=[a-z0-9\-]{0,10}\d)[a-z0-9\-]+"),
    ],
    "BKA": [
        (1.5, "bank name"),
        (2.5, "advice date"),
        (2.5, "advice amount"),
        (3.0, "bank advice"),
        (2.5, "debit advice"),
        (2.5, "credit advice"),
        (1.5, "account number"),
        (1.5, r"/\bifsc\b"),
        (1.5, r"/\baccount\s*(?:number|no\.?|#)?\s*[:\-]?\s*(?=[a-z0-9\-]{0,10}\d)[a-z0-9\-]{6,}"),
    ],
    "DPR": [
        (3.0, "down payment request"),
        (2.0, "down payment"),
        (2.0, "advance payment"),
        (2.5, "advance percentage"),
        (2.0, "requested amount"),
        (2.0, "request number"),
        (2.5, r"/\bdpr\s*(?:number|no\.?|#)?\s*[:\-]?\s*(?=[a-z0-9\-]{0,10}\d)[a-z0-9\-]+"),
        (0.5, r"/\bpurpose\b"),
    ],
    "LCA": [
        (3.0, "letter of credit"),
        (2.5, r"/\blc\s*(?:number|no\.?|#)?\s*[:\-]?\s*(?=[a-z0-9\-]{0,10}\d)[a-z0-9\-]+"),
        (2.5, "issuing bank"),
        (2.0, r"/\bbeneficiary\b"),
        (2.5, "beneficiary name"),
        (2.0, "shipment reference"),
        (2.0, "trade reference"),
        (2.0, "lc amount"),
        (1.0, "expiry date"),
    ],
}
#: Rules that tell invoices with a purchase order, and shipping from vendor language.
_ORDERED = ["purchase order", r"/\bpo\s*(?:number|no\.?|#)?\s*[:\-]?\s*(?=[a-z0-9\-]{0,10}\d)[a-z0-9\-]{3,}", r"/\bpo\s*(?:number|no\.?|#)"]
_SHIPPING = ["ship to", "ship mode", "order id"]
_VENDOR = [r"/\b(?:vendor|seller|supplier|billed\s+by)\b", "vendor code", "tax invoice", "gstin", r"/\btax\s*id\b", "remit to"]


def _literal(rule: str) -> str:
    """What every text that the rule fits holds: of a pattern its leading word, or nothing."""
    return re.match(r"(?:/\\b)?([a-z ]*)", rule)[1]


def fires(low: Column, rule: str) -> Column:
    """Whether a rule fits a text in lower case; patterns are tried only where their leading word occurs."""
    if not rule.startswith("/"):
        return contains_term(low, rule, lowered=True)
    head = _literal(rule)
    fits = low.rlike(rule[1:])
    return F.contains(low, F.lit(head)) & fits if head else fits


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """K-01 to K-05: adds ``predicted_type``, ``confidence``, ``scores_by_type`` and ``matched`` (the winner's rules).

    The text is lowered once; the rules that fire are numbered in an array, from which scores and
    matches are looked up; no rule table is joined.
    """
    rules = list(dict.fromkeys(r for t in TYPES for _, r in RULES[t]))
    at = {r: i for i, r in enumerate(rules)}
    t = F.coalesce(F.col(text), F.lit(""))
    flags = once(F.lower(t), lambda low: F.array_compact(F.array(*[F.when(fires(low, r), F.lit(i)) for r, i in at.items()])))
    by_type = {k: [(w / sum(w for w, _ in RULES[k]), at[r]) for w, r in RULES[k]] for k in TYPES}
    weights = F.array(*[F.map_from_arrays(F.array(*[F.lit(i) for _, i in rs]), F.array(*[F.lit(w) for w, _ in rs])) for rs in by_type.values()])
    names = F.array(*[F.lit(r.lstrip("/")) for r in rules])

    def judged(hit: Column) -> Column:
        some = lambda rs: F.arrays_overlap(hit, F.array(*[F.lit(at[r]) for r in rs]))
        factor = once(F.struct(some(_ORDERED).alias("ordered"), (some(_SHIPPING) & ~some(_VENDOR)).alias("shipped")), lambda f: F.array(*[
            {"NPO": F.when(f["ordered"], 0.4).otherwise(1.0) * F.when(f["shipped"], 0.5).otherwise(1.0), "POI": F.when(f["ordered"], 1.0).otherwise(0.5),
             "MSI": F.when(f["shipped"], 1.8).otherwise(1.0)}.get(k, F.lit(1.0)) for k in TYPES]))
        raw = F.transform(weights, lambda m: F.aggregate(hit, F.lit(0.0), lambda s, i: s + F.coalesce(F.try_element_at(m, i), F.lit(0.0))))
        scores = F.zip_with(raw, factor, lambda s, f: F.least(s * f, F.lit(1.0)))
        return once(scores, lambda s: once(F.array_max(s), lambda best: F.struct(
            s.alias("scores"), best.alias("best"), (F.array_position(s, best) - 1).cast("int").alias("first"))))  # ties go to the earlier type

    blank = F.trim(t) == ""
    scored = docs.withColumn("_hit", flags).withColumn("_s", judged(F.col("_hit")))
    known = (F.col("_s.best") >= FLOOR) & ~blank
    winner = F.get(weights, F.col("_s.first"))
    return scored.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(known, F.get(F.array(*[F.lit(k) for k in TYPES]), F.col("_s.first"))).otherwise("UNKNOWN").alias("predicted_type"),
        F.when(blank, 0.0).otherwise(F.round("_s.best", 4)).alias("confidence"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in TYPES]), F.transform("_s.scores", lambda v: F.when(blank, 0.0).otherwise(F.round(v, 4)))).alias("scores_by_type"),
        F.when(known, F.transform(F.filter(F.map_keys(winner), lambda i: F.array_contains(F.col("_hit"), i)), lambda i: F.get(names, i)))
        .otherwise(F.array().cast("array<string>")).alias("matched"),
    )


def corrected(results: DataFrame, corrections: DataFrame) -> DataFrame:
    """K-07: (document_id, predicted_type) corrections win with confidence 1."""
    c = corrections.select("document_id", F.col("predicted_type").alias("_to"))
    out = results.join(c, "document_id", "left")
    return out.withColumns({
        "confidence": F.when(F.col("_to").isNotNull(), 1.0).otherwise(F.col("confidence")),
        "predicted_type": F.coalesce("_to", "predicted_type"),
    }).drop("_to")


def train(examples: DataFrame, text: str = "source_text", label: str = "document_type"):
    """K-06: TF-IDF over words and word pairs (all of them up to ``TERMS`` each), then logistic regression; needs two classes with two rows each."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, StringIndexer, VectorAssembler

    enough = examples.groupBy(label).count().where("count >= 2").count()
    if enough < 2:
        raise ValueError("training needs two classes with two examples each")
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip"),
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+"), NGram(n=2, inputCol="_w", outputCol="_p"),
        CountVectorizer(inputCol="_w", outputCol="_tw", minDF=1.0, vocabSize=TERMS), CountVectorizer(inputCol="_p", outputCol="_tp", minDF=1.0, vocabSize=TERMS),
        IDF(inputCol="_tw", outputCol="_iw"), IDF(inputCol="_tp", outputCol="_ip"),
        VectorAssembler(inputCols=["_iw", "_ip"], outputCol="features"), LogisticRegression(maxIter=200),
    ]).fit(examples)


#: K-08: classification engines by name; each adds ``predicted_type`` to a table with a column ``text``.
ENGINES = {"rule_based": classify}


def engine(name: str):
    """K-08: an engine by name, the rules where it is unknown."""
    return ENGINES.get(name, classify)
