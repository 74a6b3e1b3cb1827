"""Which errors may be recorded and passed over, and which must end a run."""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException

# What Spark calls a file that it cannot read, while a job runs.
_UNREADABLE = ("FAILED_READ_FILE", "CANNOT_READ", "MALFORMED_", "INVALID_PARQUET", "PARQUET_")


def cannot_read(exc: Exception) -> bool:
    """Whether an error says that a table cannot be read or does not suit; lost executors and mistakes in code do not."""
    if isinstance(exc, (ValueError, OSError, AnalysisException)):
        return True
    return isinstance(exc, PySparkException) and str(exc.getCondition() or "").startswith(_UNREADABLE)
