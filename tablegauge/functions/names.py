"""Column-name classifiers, as expressions over a column of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import keywords as K


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def name_tokens(name: Column) -> Column:
    """Lower-cased pieces between ``_``, ``-`` and blanks, plus the whole lower-cased name."""
    lower = F.lower(name)
    return F.array_union(F.split(lower, r"[_\-\s]+"), F.array(lower))


def contains_any(name: Column, words) -> Column:
    lower = F.lower(name)
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(lower, F.lit(w))
    return hit


def name_is_id_like(name: Column) -> Column:
    return F.arrays_overlap(name_tokens(name), _words(K.ID_WORDS))


def is_id_like(name: Column, n_distinct: Column, n_rows: Column) -> Column:
    """ID keyword in the name, or more than 85 % of all rows distinct."""
    ratio = F.coalesce(F.try_divide(n_distinct, n_rows), F.lit(0.0))
    return name_is_id_like(name) | (ratio > K.ID_DISTINCT_RATIO)


def column_importance(name: Column, target: str | None = None) -> Column:
    """CRITICAL, IMPORTANT or OPTIONAL.

    Keywords match as substrings, so ``width`` or ``paid`` count as CRITICAL because of ``id``.
    """
    is_target = F.lit(False) if target is None else name == F.lit(target)
    return (
        F.when(is_target, "CRITICAL")
        .when(contains_any(name, K.CRITICAL_WORDS), "CRITICAL")
        .when(contains_any(name, K.OPTIONAL_WORDS), "OPTIONAL")
        .otherwise("IMPORTANT")
    )


def name_suggests_datetime(name: Column) -> Column:
    lower = F.lower(name)
    hit = F.arrays_overlap(name_tokens(name), _words(K.DATETIME_WORDS))
    for suffix in K.DATETIME_SUFFIXES:
        hit = hit | F.endswith(lower, F.lit(suffix))
    return hit


def few_distinct(n_distinct: Column, n_rows: Column) -> Column:
    ratio = F.try_divide(n_distinct, n_rows)
    return (n_distinct < K.FEW_DISTINCT) | F.coalesce(ratio < K.FEW_DISTINCT_RATIO, F.lit(False))


def resolve_target(df: DataFrame, target: str) -> str:
    """The column called ``target``: exact match first, else ignoring case and outer blanks."""
    if target in df.columns:
        return target
    wanted = target.strip().lower()
    matches = [c for c in df.columns if c.strip().lower() == wanted]
    if not matches:
        raise KeyError(f"no column {target!r}; columns are {df.columns}")
    return matches[-1]
