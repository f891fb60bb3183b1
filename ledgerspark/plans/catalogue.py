"""Question templates of the governed surface (Z-11): a deterministic stand-in for statements that a model would write."""

from __future__ import annotations

import re

#: (pattern, statement); statements run through the governed surface like any other.
TEMPLATES = [
    (r"how many (documents|invoices|vendors)", "SELECT count(*) AS n FROM {0}"),
    (r"(?:total )?spend (?:by|per) currency", "SELECT currency, sum(grand_total_amount) AS spend FROM invoices GROUP BY currency"),
    (r"outstanding (?:by|per) currency", "SELECT currency, sum(amount_outstanding) AS outstanding FROM payment_obligations GROUP BY currency"),
    (r"(?:spend|top) (?:by|per)? ?vendors?", "SELECT i.currency, v.canonical_name AS vendor, sum(i.grand_total_amount) AS spend FROM invoices i JOIN vendors v ON v.id = i.vendor_id GROUP BY i.currency, v.canonical_name ORDER BY spend DESC"),
    (r"documents (?:by|per) status", "SELECT status, count(*) AS n FROM documents GROUP BY status"),
    (r"(?:awaiting|pending) (?:review|approval)", "SELECT count(*) AS n FROM documents WHERE status = 'PENDING_APPROVAL'"),
]


def statement_for(question: str) -> str | None:
    """The statement of the first template that fits a question, or None."""
    for pattern, sql in TEMPLATES:
        hit = re.search(pattern, question.lower())
        if hit:
            return sql.format(*hit.groups())
    return None
