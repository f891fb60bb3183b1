"""Field registry as data (section 1.4): types, fields, labels, mandatory sets. Fixed values, in their natural order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TYPES = ["POI", "NPO", "IMA", "MSI", "PSI", "JER", "BKA", "DPR", "LCA"]
CATEGORY = {"POI": "AP", "NPO": "AP", "DPR": "AP", "IMA": "AP", "MSI": "R2R", "PSI": "R2R", "JER": "R2R", "BKA": "R2R", "LCA": "R2R"}

# key: (kind, labels in order of preference)
COMMON = {
    "document_id": ("code", ["Document ID", "Doc ID", "DOCID"]),
    "processing_status": ("text", ["Processing Status"]),
    "validation_status": ("text", ["Validation Status"]),
    "company_code": ("code", ["Company Code", "COCODE", "CO CODE"]),
    "currency": ("text", ["Currency"]),
    "barcode": ("text", ["Barcode", "Bar Code"]),
}
FIELDS = {
    "POI": {
        "vendor_code": ("code", ["Vendor Code"]),
        "po_number": ("code", ["PO Number", "Purchase Order Number", "PO No"]),
        "grn_number": ("code", ["GRN Number", "GRN No", "GRN"]),
        "srn_number": ("code", ["SRN Number", "SRN No", "SRN"]),
        "invoice_number": ("code", ["Invoice Number", "Invoice No"]),
        "invoice_date": ("date", ["Invoice Date"]),
        "seller_name": ("text", ["Seller Name", "Vendor Name", "Vendor", "Supplier"]),
        "seller_address": ("text", ["Seller Address", "Vendor Address", "Supplier Address"]),
        "seller_tax_id": ("code", ["Seller Tax ID", "Vendor Tax ID", "GSTIN", "VAT", "Tax ID"]),
        "buyer_name": ("text", ["Buyer Name", "Customer Name", "Bill To", "Company Name"]),
        "buyer_address": ("text", ["Buyer Address", "Customer Address", "Bill To Address"]),
        "buyer_tax_id": ("code", ["Buyer Tax ID", "Customer Tax ID", "Buyer GSTIN"]),
        "subtotal_net_amount": ("amount", ["Subtotal Net Amount", "Net Amount", "Subtotal"]),
        "tax_rate": ("amount", ["Tax Rate", "GST Rate", "VAT Rate"]),
        "total_tax_amount": ("amount", ["Total Tax Amount", "Tax Amount", "GST Amount", "Tax"]),
        "grand_total_amount": ("amount", ["Grand Total Amount", "Invoice Amount", "Total Amount", "Gross Amount"]),
        "payment_terms": ("text", ["Payment Terms"]),
    },
    "NPO": {
        "vendor_code": ("code", ["Vendor Code"]),
        "invoice_number": ("code", ["Invoice Number", "Invoice No"]),
        "invoice_date": ("date", ["Invoice Date"]),
        "seller_name": ("text", ["Seller Name", "Vendor Name", "Vendor", "Supplier"]),
        "seller_address": ("text", ["Seller Address", "Vendor Address", "Supplier Address"]),
        "seller_tax_id": ("code", ["Seller Tax ID", "Vendor Tax ID", "GSTIN", "VAT", "Tax ID"]),
        "buyer_name": ("text", ["Buyer Name", "Customer Name", "Bill To", "Company Name"]),
        "buyer_address": ("text", ["Buyer Address", "Customer Address", "Bill To Address"]),
        "buyer_tax_id": ("code", ["Buyer Tax ID", "Customer Tax ID", "Buyer GSTIN"]),
        "subtotal_net_amount": ("amount", ["Subtotal Net Amount", "Net Amount", "Subtotal"]),
        "tax_rate": ("amount", ["Tax Rate", "GST Rate", "VAT Rate"]),
        "total_tax_amount": ("amount", ["Total Tax Amount", "Tax Amount", "GST Amount"]),
        "grand_total_amount": ("amount", ["Grand Total Amount", "Invoice Amount", "Amount Due", "Total Amount"]),
    },
    "DPR": {
        "request_number": ("code", ["Request Number", "DPR Number", "Request No"]),
        "request_date": ("date", ["Request Date"]),
        "vendor_code": ("code", ["Vendor Code"]),
        "seller_name": ("text", ["Seller Name", "Vendor Name", "Vendor"]),
        "buyer_name": ("text", ["Buyer Name", "Company Name", "Customer Name"]),
        "po_number": ("code", ["PO Number", "PO No"]),
        "requested_amount": ("amount", ["Requested Amount"]),
        "advance_percentage": ("text", ["Advance Percentage", "Advance %"]),
        "purpose": ("text", ["Purpose"]),
        "approval_status": ("text", ["Approval Status"]),
    },
    "IMA": {
        "employee_id": ("code", ["Employee ID", "Employee Code"]),
        "employee_name": ("text", ["Employee Name", "Employee"]),
        "claim_number": ("code", ["Claim Number", "Claim No"]),
        "claim_date": ("date", ["Claim Date"]),
        "travel_start_date": ("date", ["Travel Start Date"]),
        "travel_end_date": ("date", ["Travel End Date"]),
        "expense_category": ("text", ["Expense Category"]),
        "claim_amount": ("amount", ["Claim Amount", "Reimbursement Amount"]),
        "approved_amount": ("amount", ["Approved Amount"]),
        "manager_approval_status": ("text", ["Manager Approval Status", "Approval Status"]),
    },
    "MSI": {
        "customer_code": ("code", ["Customer Code"]),
        "sales_invoice_number": ("code", ["Sales Invoice Number", "MSI Invoice Number", "Invoice Number", "Invoice #", "Invoice"]),
        "sales_invoice_date": ("date", ["Sales Invoice Date", "MSI Invoice Date", "Invoice Date", "Date"]),
        "seller_name": ("text", ["Seller Name", "Vendor Name", "Company Name"]),
        "seller_address": ("text", ["Seller Address", "Vendor Address"]),
        "seller_tax_id": ("code", ["Seller Tax ID", "Vendor Tax ID", "GSTIN", "VAT"]),
        "buyer_name": ("text", ["Buyer Name", "Customer Name", "Customer", "Bill To"]),
        "buyer_address": ("text", ["Buyer Address", "Customer Address", "Bill To Address"]),
        "buyer_tax_id": ("code", ["Buyer Tax ID", "Customer Tax ID", "Buyer GSTIN"]),
        "subtotal_net_amount": ("amount", ["Subtotal Net Amount", "Net Amount", "Subtotal"]),
        "tax_rate": ("amount", ["Tax Rate", "GST Rate", "VAT Rate"]),
        "total_tax_amount": ("amount", ["Total Tax Amount", "Tax Amount"]),
        "grand_total_amount": ("amount", ["Grand Total Amount", "Invoice Amount", "MSI Invoice Amount", "Total"]),
        "due_date": ("date", ["Due Date"]),
        "payment_terms": ("text", ["Payment Terms"]),
    },
    "PSI": {
        "pis_number": ("code", ["PIS Number", "Pay In Slip Number"]),
        "pis_date": ("date", ["PIS Date"]),
        "customer_code": ("code", ["Customer Code", "PIS Customer Code"]),
        "buyer_name": ("text", ["Buyer Name", "Customer Name", "PIS Customer Name"]),
        "bank_name": ("text", ["Bank Name"]),
        "deposit_amount": ("amount", ["Deposit Amount", "PIS Deposit Amount"]),
        "deposit_reference_number": ("code", ["Deposit Reference Number", "Reference Number"]),
        "deposit_date": ("date", ["Deposit Date"]),
        "reconciliation_status": ("text", ["Reconciliation Status"]),
    },
    "JER": {
        "journal_entry_number": ("code", ["Journal Entry Number", "JE Number", "JE No"]),
        "posting_date": ("date", ["Posting Date"]),
        "gl_account_code": ("code", ["GL Account Code", "GL Account"]),
        "gl_account_description": ("text", ["GL Account Description", "Account Description"]),
        "debit_amount": ("amount", ["Debit Amount", "Debit"]),
        "credit_amount": ("amount", ["Credit Amount", "Credit"]),
        "cost_center": ("text", ["Cost Center", "Cost Centre"]),
        "profit_center": ("text", ["Profit Center", "Profit Centre"]),
        "reference_number": ("code", ["Reference Number"]),
        "approval_status": ("text", ["Approval Status"]),
    },
    "BKA": {
        "advice_number": ("code", ["Advice Number", "Advice No"]),
        "advice_date": ("date", ["Advice Date"]),
        "bank_name": ("text", ["Bank Name"]),
        "account_number": ("code", ["Account Number", "Account No"]),
        "transaction_reference": ("code", ["Transaction Reference", "Transaction Ref"]),
        "transaction_type": ("text", ["Transaction Type"]),
        "transaction_amount": ("amount", ["Transaction Amount", "Advice Amount"]),
        "value_date": ("date", ["Value Date"]),
        "reconciliation_status": ("text", ["Reconciliation Status"]),
    },
    "LCA": {
        "lc_number": ("code", ["LC Number", "Letter of Credit Number"]),
        "issue_date": ("date", ["Issue Date"]),
        "expiry_date": ("date", ["Expiry Date"]),
        "issuing_bank": ("text", ["Issuing Bank"]),
        "beneficiary_name": ("text", ["Beneficiary Name", "Beneficiary"]),
        "lc_amount": ("amount", ["LC Amount"]),
        "shipment_reference": ("code", ["Shipment Reference"]),
        "trade_reference_number": ("code", ["Trade Reference Number", "Trade Reference"]),
        "country": ("text", ["Country"]),
        "approval_status": ("text", ["Approval Status"]),
    },
}
# Labels that end a value without being a field's own label.
OTHER_LABELS = ["Document Category", "Document Source", "Document Date", "Vertical Code", "Location Code", "Fiscal Year", "Doc Source", "LOC CODE", "Doc Date", "FY", "Ship To", "Ship Mode", "Order ID"]
MANDATORY = {
    "POI": ["po_number", "invoice_number", "invoice_date", "grand_total_amount", "vendor_code", "seller_name", "buyer_name"],
    "NPO": ["invoice_number", "invoice_date", "grand_total_amount", "seller_name", "buyer_name"],
    "DPR": ["request_number", "request_date", "vendor_code", "seller_name", "buyer_name", "po_number", "requested_amount"],
    "IMA": ["employee_id", "employee_name", "claim_number", "claim_date", "claim_amount"],
    "MSI": ["customer_code", "buyer_name", "sales_invoice_number", "sales_invoice_date", "grand_total_amount"],
    "PSI": ["pis_number", "pis_date", "bank_name", "customer_code", "buyer_name", "deposit_amount"],
    "JER": ["journal_entry_number", "posting_date", "gl_account_code", "debit_amount", "credit_amount"],
    "BKA": ["bank_name", "account_number", "advice_date", "advice_number", "transaction_amount"],
    "LCA": ["lc_number", "issue_date", "expiry_date", "issuing_bank", "beneficiary_name", "lc_amount"],
}
MANDATORY_FOR_ALL = ["currency"]
# Flat keys of a hierarchical invoice and their paths; of two keys with one path the later is the path's own.
PATHS = {
    "invoice_number": "invoice_information.invoice_number", "invoice_date": "invoice_information.invoice_date",
    "currency": "invoice_information.currency", "seller_name": "seller.name", "seller_address": "seller.address",
    "seller_tax_id": "seller.tax_id", "buyer_name": "buyer.name", "buyer_address": "buyer.address", "buyer_tax_id": "buyer.tax_id",
    "subtotal_net_amount": "totals.subtotal", "tax_rate": "totals.total_tax", "total_tax_amount": "totals.total_tax",
    "grand_total_amount": "totals.grand_total", "vendor_code": "metadata.vendor_code", "company_code": "metadata.company_code",
    "document_id": "metadata.document_id", "processing_status": "metadata.processing_status",
    "validation_status": "metadata.validation_status", "barcode": "metadata.barcode",
}


def known_labels() -> list[str]:
    """Every label, longest first: a value ends where another label begins."""
    found = set(OTHER_LABELS)
    for table in (COMMON, *FIELDS.values()):
        for _, labels in table.values():
            found.update(labels)
    return sorted(found, key=lambda x: (-len(x), x))


def schema_rows() -> list[tuple[str, str, str, str, bool, str | None, int]]:
    rows = []
    for t in TYPES:
        for i, (key, (kind, labels)) in enumerate({**COMMON, **FIELDS[t]}.items()):
            must = key in MANDATORY[t] or key in MANDATORY_FOR_ALL
            rows.append((t, key, labels[0], kind, must, PATHS.get(key) if t == "NPO" else None, i))
    return rows


def field_schema(spark: SparkSession) -> DataFrame:
    """(document_type, key, label, kind, mandatory, path, ord): the registry as a table, a few hundred rows."""
    return spark.createDataFrame(schema_rows(), "document_type string, key string, label string, kind string, mandatory boolean, path string, ord int")
