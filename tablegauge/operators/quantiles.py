"""Exact order statistics and interpolated quantiles without a sort or a shuffle of the rows.

``percentile`` keeps every distinct value of a column in one task, which a column of measured
values at scale does not survive. Here a mergeable sketch of each column gives pivots around each
wanted rank, one counting pass says how many rows lie below, on and between the pivots, and only the
rows strictly between them are looked at again. Each round keeps about one row in a hundred, so the
number of passes grows with the logarithm of the row count. The sketches steer the speed only;
ranks are counted over all rows, so the result does not depend on them.

Where a known error of rank is good enough, ``sketched_quantiles`` stops after the sketches: one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.nulls import number
from tablegauge.functions.session import checkpointed, local_rows

# Size of a sketch, and the rows left between pivots that are handed to one aggregate as a whole.
SKETCH_SIZE = 4_000
FINISH_ROWS = 40_000
_CODED = pa.schema([("slot", pa.string()), ("code", pa.int64()), ("n", pa.int64())])


@dataclass
class _Hunt:
    """One wanted rank of one column, and the open interval (low, high) it is known to be in."""

    column: str
    rank: int
    low: float | None = None
    high: float | None = None
    below: int = 0  # rows at or below low
    inside: int = 0  # rows strictly inside
    value: float | None = None


def _number(v: float) -> str:
    """The exact value as SQL. Long lists of comparisons are built as text, which plans faster."""
    return f"{float(v)!r}D" if math.isfinite(v) else f"double('{v}')"


def _between(c: str, low: float | None, high: float | None) -> str:
    keep = [f"{c} is not null"]
    if low is not None:
        keep.append(f"{c} > {_number(low)}")
    if high is not None:
        keep.append(f"{c} < {_number(high)}")
    return "(" + " and ".join(keep) + ")"


def order_statistics(
    df: DataFrame, columns: dict[str, Column], wanted: dict[str, list[int]], counts: dict[str, int]
) -> dict[tuple[str, int], float]:
    """The values at 0-based ranks of each column's non-null values in ascending order.

    ``columns`` maps a label to a numeric expression on ``df``, ``counts`` to its non-null count.
    """
    hunts = [
        _Hunt(label, r, inside=counts[label])
        for label, ranks in wanted.items()
        for r in sorted(set(ranks))
        if 0 <= r < counts[label]
    ]
    kept = None  # the values still in question, once they are few
    while True:
        open_ = [h for h in hunts if h.value is None]
        if not open_:
            return {(h.column, h.rank): h.value for h in hunts}
        small = [h for h in open_ if h.inside <= FINISH_ROWS]
        large = [h for h in open_ if h.inside > FINISH_ROWS]
        if all(h.low is None and h.high is None for h in open_):  # the first round
            cells = None
        elif large and kept is None:
            # Several more passes: they read what lies between the pivots only.
            cells = kept = checkpointed(_cells(df, columns, open_))
        else:
            cells = kept or _cells(df, columns, open_)
        if small:
            _finish(df, columns, cells, small)
        if large:
            _narrow(df, columns, cells, large)


def _groups(hunts: list[_Hunt]):
    """Hunts that share a column and an interval are served by one aggregate."""
    groups: dict[tuple, list[_Hunt]] = {}
    for h in hunts:
        groups.setdefault((h.column, h.low, h.high), []).append(h)
    return list(groups.items())


def _cells(df: DataFrame, columns: dict[str, Column], hunts: list[_Hunt]) -> DataFrame:
    """``(x, value)``: the values inside at least one interval, with the place of their column.

    They become rows before they are filtered. A filter over the columns would move below whatever they
    are computed from, and compute that again for each end of each interval.
    """
    used = {h.column for h in hunts}
    cells = [x.cast("double").alias(str(i)) for i, (c, x) in enumerate(columns.items()) if c in used]
    names = [str(i) for i, c in enumerate(columns) if c in used]
    long = df.select(cells).unpivot([], names, "x", "value")
    return long.filter(" or ".join(_picks(columns, _groups(hunts))))


def _picks(columns: dict[str, Column], groups) -> list[str]:
    """For each group, whether a row of cells is inside its interval."""
    place = {c: i for i, c in enumerate(columns)}
    return [f"(x = '{place[c]}' and {_between('value', low, high)})" for (c, low, high), _ in groups]


def _slots(cells: DataFrame, columns: dict[str, Column], groups) -> DataFrame:
    """``(slot, value)``: for each group the values inside its interval; intervals may overlap."""
    slots = ", ".join(f"case when {pick} then '{i}' end" for i, pick in enumerate(_picks(columns, groups)))
    return cells.selectExpr(f"explode(array_compact(array({slots}))) as slot", "value")


def _wide(df: DataFrame, columns: dict[str, Column], groups) -> DataFrame:
    """A column per group; in the first round each has all values of its column."""
    return df.select([columns[c].cast("double").alias(str(i)) for i, ((c, _, _), _) in enumerate(groups)])


def _at_places(slots: DataFrame, places: list[list[float]]) -> dict[int, list[float]]:
    """Per slot, the values at the given relative places (0 to 1) of its sorted values.

    The values of a slot are held by one task; the caller keeps them to some ten thousand.
    """
    spark = slots.sparkSession
    wanted = local_rows(spark, [(str(i), p) for i, p in enumerate(places)], "slot string, places array<double>")
    ordered = slots.groupBy("slot").agg(F.sort_array(F.collect_list("value")).alias("sorted"))
    got = ordered.join(F.broadcast(wanted), "slot").selectExpr(  # one row per slot
        "slot",
        "transform(places, p -> element_at(sorted, least(size(sorted), greatest(1, int(floor(p * size(sorted))) + 1)))) as found",
    )
    return {int(r["slot"]): r["found"] for r in got.collect()}


def _finish(df: DataFrame, columns: dict[str, Column], cells: DataFrame | None, hunts: list[_Hunt]) -> None:
    groups = _groups(hunts)
    if cells is None:
        slots = _wide(df, columns, groups).unpivot([], [str(i) for i in range(len(groups))], "slot", "value").filter("value is not null")
    else:
        slots = _slots(cells, columns, groups)
    # The middle of the step that belongs to the rank, so that rounding cannot miss it.
    places = [[(h.rank - h.below + 0.5) / h.inside for h in members] for _, members in groups]
    found = _at_places(slots, places)
    for i, (_, members) in enumerate(groups):
        for h, v in zip(members, found[i]):
            h.value = v


def _neighbours(members: list[_Hunt]) -> list[list[_Hunt]]:
    """Ranks next to each other (the two ends of an interpolation) share their pivots."""
    runs: list[list[_Hunt]] = []
    for h in sorted(members, key=lambda h: h.rank):
        if runs and h.rank - runs[-1][-1].rank <= 1:
            runs[-1].append(h)
        else:
            runs.append([h])
    return runs


def _narrow(df: DataFrame, columns: dict[str, Column], cells: DataFrame | None, hunts: list[_Hunt]) -> None:
    groups = _groups(hunts)
    rows = _wide(df, columns, groups) if cells is None else _slots(cells, columns, groups)
    pivots = _pivots(rows, groups)
    known: dict[int, set[float]] = {}
    for i, h, marks in pivots:
        if marks[0] is None:
            raise ValueError(f"{h.column}: the counts tell of values that are not numbers")
        known.setdefault(i, set()).update(marks)
    below = _rows_below(rows, known)
    for i, h, (low, high) in pivots:
        (lt_low, le_low), (lt_high, le_high) = below[i, low], below[i, high]
        at = h.rank - h.below
        if at < lt_low:
            h.high, h.inside = low, lt_low
        elif at < le_low:
            h.value = low
        elif at < lt_high:
            h.low, h.high, h.below, h.inside = low, high, h.below + le_low, lt_high - le_low
        elif at < le_high:
            h.value = high
        else:
            h.low, h.below, h.inside = high, h.below + le_high, h.inside - le_high


def rank_error(size: int) -> float:
    """Share of the rows that a rank from a sketch of this size is off by at most, in 99 of 100 cases."""
    return 2.296 / size**0.9021


def _sketched(rows: DataFrame, values: list[str], places: list[list[float]]) -> list[list[float] | None]:
    """For each expression about the values at the given relative places, in one pass; None where it has no values."""
    pairs = [(F.expr(v), p) for v, p in zip(values, places)]
    sketches = rows.agg(*[F.kll_sketch_agg_double(x, SKETCH_SIZE).alias(f"s{i}") for i, (x, _) in enumerate(pairs)], *[F.count(x).alias(f"n{i}") for i, (x, _) in enumerate(pairs)])
    # A sketch without values cannot be asked.
    found = sketches.select(*[F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", F.array(*[F.lit(float(q)) for q in p]))) for i, (_, p) in enumerate(pairs)]).first()
    return list(found)


def _pivots(rows: DataFrame, groups) -> list[tuple[int, _Hunt, tuple[float | None, float | None]]]:
    """Two values of a sketch per hunt that most likely enclose its rank, with the place of its group."""
    slack, places = 2 * rank_error(SKETCH_SIZE), []
    for _, members in groups:
        own = []
        for run in _neighbours(members):
            for h, side in ((run[0], -1), (run[-1], 1)):
                p = (h.rank - h.below + 0.5) / h.inside
                own.append(min(1.0, max(0.0, p + side * slack)))
        places.append(own)
    long = "slot" in rows.columns
    values = [f"case when slot = '{i}' then value end" if long else f"`{i}`" for i in range(len(groups))]
    found = _sketched(rows, values, places)
    out = []
    for i, (marks, (_, members)) in enumerate(zip(found, groups)):
        runs = _neighbours(members)
        marks = marks or [None] * (2 * len(runs))
        for j, run in enumerate(runs):
            out += [(i, h, (marks[2 * j], marks[2 * j + 1])) for h in run]
    return out


def _coded_slots(rows: DataFrame, ordered: dict[int, list[float]]) -> DataFrame:
    """``(slot, code, count)`` of rows of (slot, value)."""
    codes = {}
    for i, values in ordered.items():
        steps = " ".join(f"when value < {_number(v)} then {2 * k} when value = {_number(v)} then {2 * k + 1}"
                         for k, v in enumerate(values))
        codes[i] = f"case when value is not null then case {steps} else {2 * len(values)} end end"
    coded = rows.selectExpr("slot", "case slot " + " ".join(f"when '{i}' then {code}" for i, code in codes.items()) + " end as code")
    return coded.groupBy("slot", "code").count()


def _coded_columns(rows: DataFrame, ordered: dict[int, list[float]]) -> DataFrame:
    """``(slot, code, count)`` of a column per slot; each task counts its batches by binary search."""
    pivots = {i: np.array(values) for i, values in ordered.items()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(2 * len(v) + 1, dtype=np.int64) for v in pivots.values()]
        for batch in batches:
            for total, v, column in zip(totals, pivots.values(), batch.columns):
                x = column.drop_null().to_numpy(zero_copy_only=False)
                total += np.bincount(np.searchsorted(v, x, "left") + np.searchsorted(v, x, "right"), minlength=len(total))
        for i, total in zip(pivots, totals):
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"slot": [str(i)] * len(met), "code": met, "n": total[met]}, schema=_CODED)

    coded = rows.select([F.col(f"`{i}`") for i in pivots]).mapInArrow(counted, "slot string, code bigint, n bigint")
    return coded.groupBy("slot", "code").agg(F.sum("n").alias("count"))


def _rows_below(rows: DataFrame, known: dict[int, set[float]]) -> dict[tuple[int, float], tuple[int, int]]:
    """For each group and value: how many of its rows lie below it, and how many at or below it.

    A row's code counts the pivots it has reached and passed, so one small grouped count
    (groups times codes) answers all pivots of all groups.
    """
    ordered = {i: sorted(values) for i, values in known.items()}
    counts: dict[int, dict[int, int]] = {i: {} for i in ordered}
    for r in (_coded_slots(rows, ordered) if "slot" in rows.columns else _coded_columns(rows, ordered)).collect():
        counts[int(r["slot"])][r["code"]] = r["count"]
    out = {}
    for i, values in ordered.items():
        seen = counts[i]
        for k, v in enumerate(values):
            lt = sum(n for code, n in seen.items() if code <= 2 * k)
            out[i, v] = (lt, lt + seen.get(2 * k + 1, 0))
    return out


def quantiles(
    df: DataFrame, columns: dict[str, Column], shares: list[float], counts: dict[str, int]
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles (position ``share * (n - 1)``) per labelled expression."""
    wanted: dict[str, list[int]] = {}
    for label in columns:
        n = counts[label]
        wanted[label] = []
        for p in shares:
            if n:
                place = p * (n - 1)
                wanted[label] += [math.floor(place), math.ceil(place)]
    found = order_statistics(df, columns, wanted, counts)
    out: dict[str, list[float | None]] = {}
    for label in columns:
        n, values = counts[label], []
        for p in shares:
            if not n:
                values.append(None)
                continue
            place = p * (n - 1)
            low, high = found[label, math.floor(place)], found[label, math.ceil(place)]
            part = place - math.floor(place)
            values.append(low if part == 0 else low + (high - low) * part)
        out[label] = values
    return out


def sketched_quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    """Values of each labelled expression whose rank is within ``rank_error(SKETCH_SIZE)`` of the shares, in one pass.

    They are values of the column, not interpolated.
    """
    if not columns:
        return {}
    rows = df.select([x.cast("double").alias(f"x{i}") for i, x in enumerate(columns.values())])
    found = _sketched(rows, [f"x{i}" for i in range(len(columns))], [shares] * len(columns))
    return {c: v or [None] * len(shares) for c, v in zip(columns, found)}


def column_quantiles(df: DataFrame, names: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Quantiles of plain numeric columns; counts the non-null values first."""
    if not names:
        return {}
    exprs = {c: number(c) for c in names}
    row = df.agg(*[F.count(exprs[c]).alias(f"n{i}") for i, c in enumerate(names)]).first()
    return quantiles(df, exprs, shares, {c: row[f"n{i}"] for i, c in enumerate(names)})
