"""Does a text column hold dates or numbers? Each probe is a pure expression on the text.

A format is tried as a cheap anchored pattern first and as a real parse only where the
pattern fits, because a failing parse costs far more than a failing pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (Spark datetime format, pattern of the text it may apply to).
DATETIME_FORMATS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{3}|\.\d{6})?$"),
    ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]",
     r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3}|\.\d{6})?(Z|[+-]\d{2}:\d{2})?$"),
    ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("MMM d yyyy", r"^[A-Z][a-z]{2} \d{1,2} \d{4}$"),
    ("yyyy", r"^(1678|1679|16[89]\d|1[789]\d{2}|2[01]\d{2}|22[0-5]\d|226[01])$"),
    ("HH:mm", r"^\d{2}:\d{2}$"),
)
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def looks_like(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def parse_datetime(text: Column, fmt: str, pattern: str) -> Column:
    """The timestamp, or NULL where the text does not follow the format."""
    return F.when(looks_like(text, pattern), F.try_to_timestamp(text, F.lit(fmt)))


def parse_datetime_any(text: Column) -> Column:
    """First format that fits the value."""
    return F.coalesce(*[parse_datetime(text, f, p) for f, p in DATETIME_FORMATS])


def parse_number(text: Column) -> Column:
    """The double, or NULL. Guarded: a bare cast would also accept ``1d`` and ``1f``."""
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
