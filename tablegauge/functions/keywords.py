"""The name keywords the classifiers and checks look for."""

from __future__ import annotations

# Fixed values. Matched as name tokens or substrings, see the functions that use them.
TARGET_WORDS = (
    "target", "label", "class", "outcome", "result", "price", "rating",
    "churn", "fraud", "survived", "diagnosis", "default",
)
ID_WORDS = ("id", "no", "number", "code", "key", "uuid", "ref", "serial", "index")
DATETIME_WORDS = (
    "date", "time", "timestamp", "datetime", "created", "updated",
    "modified", "at", "dt", "ts", "_at", "_date", "_time", "_ts",
)
DATETIME_SUFFIXES = ("_at", "_date", "_time", "_ts", "_datetime")
CRITICAL_WORDS = (
    "id", "customer", "order", "product", "transaction", "invoice",
    "payment", "price", "amount", "revenue", "cost", "salary",
    "target", "label", "class", "outcome", "fraud", "churn",
)
OPTIONAL_WORDS = (
    "comment", "description", "note", "review", "text", "message",
    "feedback", "remark", "body", "content", "summary", "detail",
    "title", "subject", "narrative",
)
NEGATIVE_INVALID_WORDS = (
    "price", "age", "qty", "quantity", "amount", "salary",
    "weight", "height", "distance", "count", "payment", "value",
)
ZERO_INVALID_WORDS = ("bmi", "salary", "price", "age", "weight", "height")
FINANCIAL_WORDS = ("price", "amount", "payment", "revenue", "cost", "value", "salary")
KEY_LIKE_WORDS = ("_id", "id_", "customerid", "orderid", "productid")
FOREIGN_KEY_WORDS = ("id", "key", "code", "no")
JOIN_KEY_WORDS = ("id", "key")

# Fixed values. Text that a delimited file uses for "no value".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Fixed values. Severity levels from worst to mildest, and importance classes.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
IMPORTANCES = ("CRITICAL", "IMPORTANT", "OPTIONAL")

# Fixed values. Limits shared by several operators.
ID_DISTINCT_RATIO = 0.85
ORDINAL_DISTINCT = 10
FEW_DISTINCT = 20
FEW_DISTINCT_RATIO = 0.05
FENCE_FACTOR = 1.5
Z_LIMIT = 3.0


def has_word(name: str, words) -> bool:
    """True if the lower-cased name contains one of the words."""
    lower = name.lower()
    return any(w in lower for w in words)
