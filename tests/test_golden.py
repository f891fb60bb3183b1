"""Golden spellings of single values, beside the queries over whole tables."""

from pyspark.sql import functions as F

from ledgerspark.functions import dates, numbers, text
from ledgerspark.operators import classification

_NUMBERS = [("1 394,67", 1394.67), ("1.394,67", 1394.67), ("1,394.67", 1394.67), ("689,70", 689.70), ("$ 5 640,17", 5640.17), ("52.,083.00", 52083.0), (",70", 0.70), ("1,676,976", 1676976.0), ("1.676.976,00", 1676976.0), ("667.080.00", 667080.0), ("Rs. 15,000.00", 15000.0), ("1,394", 1.394), ("abc", None), ("", None), ("-12.5", -12.5)]
_DATES = [("21st March 2012", "2012-03-21"), ("05-Jun-2026", "2026-06-05"), ("03/04/2024", "2024-04-03"), ("04/25/2024", "2024-04-25"), ("2024.1.9", "2024-01-09"), ("Due: January 5, 2024 net", "2024-01-05"), ("31/02/2024", None), ("soon", None), ("1-2-24", None)]
_MONEY = [("$", "USD"), ("Rs.", "INR"), ("C$", "CAD"), ("US$ 5", "USD"), ("chf", "CHF"), ("sek", "SEK"), ("hours", "INR"), ("??", None), ("", None)]
_UNITS = [("PCS", "pcs"), (" Stk. ", "pcs"), ("hrs", "hours"), ("Barrel", "barrel"), ("", None)]
_RATES = [("10%", None, None, 0.10), ("18", None, None, 0.18), ("0.2", None, None, 0.2), ("1090", 100.0, 110.0, 0.10), ("1090", 100.0, 150.0, None), ("7,7%", None, None, 0.077)]
_AMOUNTS = [("Rs. 15,000.00", "15000.00"), ("1 394,67", "1394.67"), ("689,70", "689.70"), ("1200", "1200"), ("12.5", "12.50"), ("x", None)]
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


def told(spark, rows, schema, column):
    raw = [(i, *r[:-1]) for i, r in enumerate(rows)]
    got = {r["i"]: r["v"] for r in spark.createDataFrame(raw, "i int, " + schema).select("i", column.alias("v")).collect()}
    return [got[i] for i in range(len(rows))]


def test_values(spark):
    raw = F.col("raw")
    for rows, column in ((_NUMBERS, numbers.parse_numeric(raw)), (_DATES, dates.normalize_date(raw)), (_MONEY, text.normalize_currency(raw)), (_UNITS, text.normalize_unit(raw)), (_AMOUNTS, numbers.normalize_amount(raw))):
        assert told(spark, rows, "raw string", column) == [r[-1] for r in rows]
    assert told(spark, _RATES, "raw string, net double, gross double", numbers.tax_rate(raw, F.col("net"), F.col("gross"))) == [r[-1] for r in _RATES]


def test_types(spark):
    d = spark.createDataFrame([(i, t) for i, t, _ in _SAMPLES], "id bigint, text string")
    assert {r["id"]: r["predicted_type"] for r in classification.classify(d).collect()} == {i: t for i, _, t in _SAMPLES}
