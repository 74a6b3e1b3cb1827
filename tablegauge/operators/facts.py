"""The passes over a table that everything else is derived from.

Collected are a handful of numbers per column; they bound the driver's share by the width of the
table, never by its length. Each pass reads only the columns it needs:

1. counts, sums, extremes, sign counts and text lengths,
2. distinct counts, and the most frequent text values,
3. central moments around the means of pass 1,
4. parses of the text columns that may hold dates or numbers; where pass 2 is made, of their different values,
5. exact quartiles of numeric columns (see ``quantiles``),
6. rows outside the fences and beyond three standard deviations.

A pass turns columns into (column, value) rows and groups them by column. The generated code is
then the same short loop for ten or a thousand columns, and what leaves a task is one row per column.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions import keywords as K
from tablegauge.functions.classes import WIDTHS, dtype_class, text_form
from tablegauge.functions.nulls import quoted, sql_name
from tablegauge.functions.session import checkpointed, local_rows, together
from tablegauge.functions.probes import DATETIME_FORMATS, parse_datetime, parse_number
from tablegauge.operators import distinct as D
from tablegauge.operators.quantiles import quantiles, sketched_quantiles

@dataclass
class ColumnFacts:
    name: str
    ordinal: int
    dtype_raw: str
    dtype_class: str
    present: int = 0
    distinct: int | None = 0  # None where values were not counted
    suggested: str = ""
    mean: float | None = None
    minimum: float | None = None
    maximum: float | None = None
    std: float | None = None
    std_pop: float | None = None
    variance: float | None = None
    skewness: float | None = None
    kurtosis: float | None = None
    quartiles: list = field(default_factory=lambda: [None, None, None])
    outliers_iqr: int | None = None
    outliers_zscore: int | None = None
    negatives: int = 0
    zeros: int = 0
    top_value: str | None = None
    top_freq: int | None = None
    text_bytes: int = 0
    longest: int = 0

    @property
    def numeric(self) -> bool:
        return self.dtype_class == "numeric"

    @property
    def has_stats(self) -> bool:
        return self.numeric and self.present >= 2

    @property
    def ordinal_like(self) -> bool | None:
        return None if self.distinct is None else self.distinct <= K.ORDINAL_DISTINCT


@dataclass
class TableFacts:
    rows: int
    complete_rows: int
    columns: list[ColumnFacts]

    def __getitem__(self, name: str) -> ColumnFacts:
        return next(c for c in self.columns if c.name == name)

    def id_like(self, c: ColumnFacts) -> bool:
        tokens = set(_split(c.name)) | {c.name.lower()}
        by_name = bool(tokens & set(K.ID_WORDS))
        return by_name or (self.rows > 0 and (c.distinct or 0) / self.rows > K.ID_DISTINCT_RATIO)


def _split(name: str) -> list[str]:
    return name.lower().replace("-", "_").replace("\t", " ").replace(" ", "_").split("_")


def _plain(c: ColumnFacts) -> Column:
    return quoted(c.name).cast("double")


def _new_columns(df: DataFrame) -> list[ColumnFacts]:
    return [
        ColumnFacts(f.name, i, f.dataType.simpleString(), dtype_class(f.dataType))
        for i, f in enumerate(df.schema)
    ]


def collect_facts(
    df: DataFrame,
    *,
    distinct: str = "exact",
    quartiles: bool | str = True,
    probes: bool = True,
) -> TableFacts:
    """All facts of a table whose missing values are all NULL (see ``normalize_nulls``).

    ``distinct`` is exact, approx (sketches) or skip: then the number of values, and what follows from
    it, is unknown (None). ``quartiles`` is true, false, or approx: then they are values near the rank (see
    ``quantiles.rank_error``), found by sketches in one pass.
    Passes that do not need each other are submitted together; Spark shares its cores among them.
    """
    flat = text_form(df)
    facts = _first_pass(flat, _new_columns(df))
    if distinct == "skip":
        for c in facts.columns:
            c.distinct = None
    if facts.rows:
        work = []
        if probes:
            # Short texts are tried once per different value, where these are counted.
            known = [c for c in _probed(flat, facts) if distinct != "skip" and c.longest <= D.LONG_TEXT and flat.schema[c.ordinal].dataType == T.StringType()]
            work.append(lambda: _probe_pass(flat, [c for c in _probed(flat, facts) if c not in known]))
        else:
            known = []
        if distinct != "skip":
            work.append(lambda: _distinct_pass(flat, facts, distinct, known))
        if quartiles:
            work.append(lambda: _quartile_pass(df, facts, quartiles == "approx"))
        together(work)
        if quartiles:
            _outlier_pass(df, facts)
    return facts


def _measure(c: ColumnFacts) -> str:
    """One number per cell: a number's value, a text's length in bytes, else only its presence."""
    x = sql_name(c.name)
    if c.numeric:
        return f"cast({x} as double)"
    if c.dtype_class == "categorical":
        return f"cast(octet_length({x}) as double)"
    return f"case when {x} is not null then 0D end"


def _first_pass(flat: DataFrame, cols: list[ColumnFacts]) -> TableFacts:
    """One grouped aggregate over (column, number) rows: small code for any number of columns.

    Spark merges the central moments of the parts, so they need no mean of an earlier pass.
    """
    whole = " and ".join(f"{sql_name(c.name)} is not null" for c in cols)
    names = [str(c.ordinal) for c in cols]
    cells = flat.selectExpr(f"{whole} as whole", *[f"{_measure(c)} as `{c.ordinal}`" for c in cols])
    got = cells.unpivot(["whole"], names, "i", "d").groupBy("i").agg(*[F.expr(e) for e in (
        "count(*) as rows", "count_if(whole) as whole", "count(d) as present", "avg(d) as mean", "sum(d) as total",
        "min(d) as low", "max(d) as high", "count_if(d < 0) as negatives", "count_if(d = 0) as zeros", "stddev_pop(d) as spread", "skewness(d) as skew", "kurtosis(d) as kurt")]).collect()
    for r in got:
        c = cols[int(r["i"])]
        c.present = r["present"]
        if c.numeric:
            c.mean, c.minimum, c.maximum = r["mean"], r["low"], r["high"]
            c.negatives, c.zeros = r["negatives"], r["zeros"]
            _set_moments(c, r["spread"], r["skew"], r["kurt"])
        elif c.dtype_class == "categorical":
            c.longest, c.text_bytes = int(r["high"] or 0), int(r["total"] or 0)
    return TableFacts(got[0]["rows"] if got else 0, got[0]["whole"] if got else 0, cols)


def _distinct_pass(flat: DataFrame, facts: TableFacts, how: str, probed: list[ColumnFacts]) -> None:
    """Distinct counts, the most frequent texts, and the probes of the ``probed`` columns."""
    text = [c.name for c in facts.columns if c.dtype_class == "categorical" and c.present]
    other = [c.name for c in facts.columns if c.dtype_class != "categorical" and c.present]

    def texts() -> None:
        freq, ends = checkpointed(D.text_frequencies(flat, text)), {}
        for r in D.text_tops(freq).collect():
            c = facts[r["column_name"]]
            c.distinct, c.top_freq, c.top_value = r["n_distinct"], r["top_freq"], r["top_key"]
            ends[c.ordinal] = r["low"], r["high"]
        _probe_values(freq, probed, ends)
        for c in facts.columns:
            if c.top_freq is not None and c.longest > D.LONG_TEXT:
                c.top_value = D.smallest_top_text(flat, c.name, c.top_freq).first()["top_value"]

    def others(part: DataFrame) -> None:
        for r in part.collect():
            facts[r["column_name"]].distinct = r["n_distinct"]

    work = [texts] if text else []
    if other and how == "approx":
        work.append(lambda: others(D.approx_distinct_counts(flat, other)))
    elif other:
        work += [lambda p=p: others(p) for p in D.distinct_parts(flat, other, sum(facts[c].present for c in other))]
    together(work)


def _probed(flat: DataFrame, facts: TableFacts) -> list[ColumnFacts]:
    """The text columns that may hold dates or numbers."""
    text = (T.StringType, T.VarcharType, T.CharType)
    return [c for c in facts.columns if isinstance(flat.schema[c.ordinal].dataType, text) and c.dtype_raw != "binary" and c.present]


def _probe_tests(chosen: list[ColumnFacts], ends: DataFrame) -> dict[str, tuple[ColumnFacts, Callable[[Column], Column]]]:
    """The probes that may fit: what the smallest (``low``) or the largest value (``high``) does not follow cannot hold for all.

    Most formats end here, without a test per row.
    """
    tests: dict[str, tuple[ColumnFacts, Callable[[Column], Column]]] = {}
    for c in chosen:
        for k, (fmt, pattern) in enumerate(DATETIME_FORMATS):
            tests[f"d{c.ordinal}_{k}"] = (c, partial(parse_datetime, fmt=fmt, pattern=pattern))
        if not _datetime_name(c.name):
            tests[f"n{c.ordinal}"] = (c, parse_number)
    if not tests:
        return {}
    both = ends.select(*[(probe(quoted(f"low{c.ordinal}")).isNotNull() & probe(quoted(f"high{c.ordinal}")).isNotNull()).alias(k)
                         for k, (c, probe) in tests.items()]).first()
    return {k: test for k, test in tests.items() if both[k]}


def _suggest(chosen: list[ColumnFacts], fits: set[str]) -> None:
    for c in chosen:
        if any(f"d{c.ordinal}_{k}" in fits for k in range(len(DATETIME_FORMATS))):
            c.suggested = "datetime"
        elif f"n{c.ordinal}" in fits:
            c.suggested = "numeric"


def _probe_pass(flat: DataFrame, chosen: list[ColumnFacts]) -> None:
    """Text columns whose every value is a date of one format, or else a number."""
    if not chosen:
        return
    tests = _probe_tests(chosen, flat.agg(*[end(quoted(c.name)).alias(f"{label}{c.ordinal}") for c in chosen for label, end in (("low", F.min), ("high", F.max))]))
    if not tests:
        return
    # Values of another shape are not parsed: the anchored pattern of a probe comes first.
    parsed = flat.agg(*[F.count(probe(quoted(c.name))).alias(k) for k, (c, probe) in tests.items()]).first()
    _suggest(chosen, {k for k, (c, _) in tests.items() if parsed[k] == c.present})


def _probe_values(freq: DataFrame, chosen: list[ColumnFacts], ends: dict[int, tuple[str, str]]) -> None:
    """The same from the different values of each column, and the smallest and the largest of them."""
    if not chosen:
        return
    row = tuple(v for c in chosen for v in ends[c.ordinal])
    names = ", ".join(f"{label}{c.ordinal} string" for c in chosen for label in ("low", "high"))
    tests = _probe_tests(chosen, local_rows(freq.sparkSession, [row], names))
    if not tests:
        return
    parsed = freq.agg(*[F.count(F.when(F.col("column_name") == c.name, probe(F.col("value")))).alias(k) for k, (c, probe) in tests.items()]).first()
    _suggest(chosen, {k for k, (c, _) in tests.items() if parsed[k] == c.distinct})


def _datetime_name(name: str) -> bool:
    tokens = set(_split(name)) | {name.lower()}
    return bool(tokens & set(K.DATETIME_WORDS)) or name.lower().endswith(K.DATETIME_SUFFIXES)


def _set_moments(c: ColumnFacts, spread: float | None, skew: float | None, kurt: float | None) -> None:
    """Sample and population moments from the population's; a constant column has exactly no spread."""
    n = c.present
    if not c.has_stats or not math.isfinite(c.mean):
        return
    flat = c.minimum == c.maximum
    c.std_pop = 0.0 if flat else spread
    c.variance = c.std_pop**2 * n / (n - 1)
    c.std = math.sqrt(c.variance)
    c.skewness = 0.0 if n < 3 else _known(skew, flat)
    c.kurtosis = 0.0 if n < 4 else _known(kurt, flat)


def _known(moment: float | None, flat: bool) -> float | None:
    return None if flat or moment is None or not math.isfinite(moment) else moment


def _quartile_pass(df: DataFrame, facts: TableFacts, sketched: bool) -> None:
    chosen = [c for c in facts.columns if c.has_stats]
    if chosen:
        exprs, shares = {c.name: _plain(c) for c in chosen}, [0.25, 0.5, 0.75]
        found = sketched_quantiles(df, exprs, shares) if sketched else quantiles(df, exprs, shares, {c.name: c.present for c in chosen})
        for c in chosen:
            c.quartiles = found[c.name]


def _outlier_pass(df: DataFrame, facts: TableFacts) -> None:
    """Rows outside the fences (code 1) and beyond three standard deviations (code 2)."""
    codes = []
    for c in facts.columns:
        if not c.has_stats or c.ordinal_like is None:
            continue
        c.outliers_iqr = c.outliers_zscore = 0
        if c.ordinal_like:
            continue
        low, high = fences(c)
        code = F.lit(0)
        if high > low:
            code = code + outside(_plain(c), low, high).cast("int")
        if c.std_pop and c.present >= 3:
            code = code + 2 * (F.abs(_plain(c) - c.mean) / c.std_pop > K.Z_LIMIT).cast("int")
        codes.append(code.alias(str(c.ordinal)))
    if not codes:
        return
    names = [str(c.ordinal) for c in facts.columns if c.has_stats and c.ordinal_like is False]
    long = df.select(codes).unpivot([], names, "i", "code").filter("code > 0")
    for r in long.groupBy("i", "code").agg(F.count("*").alias("n")).collect():
        c = facts.columns[int(r["i"])]
        c.outliers_iqr += r["n"] if r["code"] & 1 else 0
        c.outliers_zscore += r["n"] if r["code"] & 2 else 0


def fences(c: ColumnFacts) -> tuple[float, float]:
    q25, _, q75 = c.quartiles
    reach = K.FENCE_FACTOR * (q75 - q25)
    return q25 - reach, q75 + reach


def outside(x: Column, low: float, high: float) -> Column:
    return (x < F.lit(low)) | (x > F.lit(high))


def logical_bytes(df: DataFrame, facts: TableFacts) -> int:
    """Bytes of the values: fixed widths for fixed types, UTF-8 length for text."""
    total = 0
    for c, f in zip(facts.columns, df.schema):
        total += c.text_bytes if c.dtype_class == "categorical" else facts.rows * WIDTHS.get(type(f.dataType), 16)
    return total
