"""Exact quantiles of any number of rows in bounded memory."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Values are placed on 2**PLACE_BITS steps; each pass settles STEP_BITS of them.
PLACE_BITS = 40
STEP_BITS = 10

# Rows around a quantile that are sorted out by value.
BRACKET_ROWS = 100_000


def _between(low: float, high: float, weight: float) -> float:
    if low == high or not weight:
        return low
    if math.isinf(low) or math.isinf(high):
        return low * (1 - weight) + high * weight
    return low + (high - low) * weight


def _rising(value: float) -> float:
    return math.copysign(math.log1p(abs(value)), value)


def _known(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """The values of each of ``n`` marks of a row that are not NULL or NaN."""
    marks = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n).T
    return [column[~np.isnan(column)] for column in marks]


def _places(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """Steps of values between ``low`` and ``high`` (both as ``_rising`` gives them)."""
    if high <= low:
        return np.zeros(len(values), np.int64)
    step = np.floor((np.copysign(np.log1p(np.abs(values)), values) - low) / (high - low) * float(1 << PLACE_BITS))
    return np.clip(step, 0, (1 << PLACE_BITS) - 1).astype(np.int64)


_ENDS = pa.schema([("of", pa.int32()), *[(c, pa.int64()) for c in ("n", "below", "above")], ("low", pa.float64()), ("high", pa.float64())])
_COUNTED = pa.schema([("of", pa.int32()), ("to", pa.int64()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], bracket_rows: int = BRACKET_ROWS) -> dict[str, list[float | None]]:
    """Quantiles of each column, linear between neighbours, without NULLs and NaNs; infinities count as values.

    Every wanted rank gets a bracket that counting passes narrow until few rows are left in it; the distinct
    values inside are then counted in order. Places rise with the logarithm on both sides of zero, so wide ranges
    take no more passes than narrow ones. A pass brings back 2**STEP_BITS counts per bracket, whatever the rows.
    """
    if not columns:
        return {}
    clean = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = clean.columns

    def marked(of: list[str]) -> DataFrame:
        """One array a row, with a mark for each column asked for."""
        return clean.select(F.array(*[F.col(c) for c in of]).alias("marks"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, values in enumerate(_known(batch, len(names))):
                finite = values[np.isfinite(values)]
                some = (float(finite.min()), float(finite.max())) if len(finite) else (None, None)
                rows.append((i, len(values), int((values == -np.inf).sum()), int((values == np.inf).sum()), *some))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_ENDS)], schema=_ENDS)

    totals = [F.sum(c).alias(c) for c in ("n", "below", "above")] + [F.min("low").alias("low"), F.max("high").alias("high")]
    # One row per column: values, infinite ones of either sign, least and greatest finite one.
    found = marked(names).mapInArrow(ends, "of int, n long, below long, above long, low double, high double").groupBy("of").agg(*totals).collect()
    known = {c: (0, 0, 0, None, None) for c in names} | {names[r["of"]]: tuple(r)[1:] for r in found}

    ranks: dict[str, list[tuple[int, int, float]]] = {}
    values: dict[tuple[str, int], float] = {}
    # (column, rank) -> [shift, prefix, rank inside, rows inside]
    brackets: dict[tuple[str, int], list[int]] = {}
    for c in names:
        n, low, high, *_ = known[c]
        ranks[c] = []
        for share in shares if n else []:
            place = share * (n - 1)
            first = int(place)
            ranks[c].append((first, min(first + 1, n - 1), place - first))
            for rank in ranks[c][-1][:2]:
                if rank < low or rank >= n - high:
                    values[c, rank] = float("-inf") if rank < low else float("inf")
                else:
                    brackets[c, rank] = [PLACE_BITS, 0, rank - low, n - low - high]

    edges = {c: tuple(map(_rising, known[c][3:])) for c in {k[0] for k in brackets}}

    def inside(batch: pa.RecordBatch, of: list[tuple[str, int, list[int]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(of, values, places, number of the prefix) of the values inside the brackets of ``of``."""
        for i, ((c, shift, prefixes), values) in enumerate(zip(of, _known(batch, len(of)))):
            values = values[np.isfinite(values)]
            places = _places(values, *edges[c])
            at = np.minimum(np.searchsorted(prefixes, places >> shift), len(prefixes) - 1)
            on = np.array(prefixes)[at] == places >> shift
            yield i, values[on], places[on], at[on]

    def narrowed(of: list[tuple[str, int, list[int]]]) -> DataFrame:
        """(of, to, n, low, high): counts and ends of each step inside the brackets, added up in the task."""
        size = 1 << STEP_BITS

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = [(np.zeros(len(p) * size, np.int64), np.full(len(p) * size, np.inf), np.full(len(p) * size, -np.inf)) for _, _, p in of]
            for batch in batches:
                for i, values, places, at in inside(batch, of):
                    step = at * size + (places >> (of[i][1] - STEP_BITS)) % size
                    made[i][0][:] += np.bincount(step, minlength=len(made[i][0]))
                    np.minimum.at(made[i][1], step, values)
                    np.maximum.at(made[i][2], step, values)
            for i, (n, low, high) in enumerate(made):
                there = np.flatnonzero(n)
                to = np.array(of[i][2], np.int64)[there // size] * size + there % size
                columns = [np.full(len(there), i, np.int32), to, n[there], low[there], high[there]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_COUNTED)

        counted = marked([c for c, *_ in of]).mapInArrow(count, "of int, to long, n long, low double, high double")
        return counted.groupBy("of", "to").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    def values_inside(of: list[tuple[str, int, list[int]]]) -> DataFrame:
        """(of, to, value, n): how often each distinct value inside the brackets comes."""

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, values, places, _ in inside(batch, of):
                    columns = {"of": np.full(len(values), i, np.int32), "to": places >> of[i][1], "value": values}
                    yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

        picked = marked([c for c, *_ in of]).mapInArrow(pick, "of int, to long, value double")
        return picked.groupBy("of", "to", "value").agg(F.count(F.lit(1)).alias("n"))

    def grouped(keys: set[tuple[str, int, int]]) -> list[tuple[str, int, list[int]]]:
        found: dict[tuple[str, int], set[int]] = {}
        for c, shift, prefix in keys:
            found.setdefault((c, shift), set()).add(prefix)
        return [(c, shift, sorted(found[c, shift])) for c, shift in sorted(found)]

    while wide := {(c, b[0], b[1]) for (c, _), b in brackets.items() if b[3] > bracket_rows and b[0]}:
        of = grouped(wide)
        found: dict[tuple[str, int, int], list[tuple]] = {}
        for row in narrowed(of).collect():
            c, shift, _ = of[row["of"]]
            found.setdefault((c, shift, row["to"] >> STEP_BITS), []).append((row["to"], row["n"], row["low"], row["high"]))
        for key, bracket in list(brackets.items()):
            if (key[0], *bracket[:2]) not in wide:
                continue
            for to, n, low, high in sorted(found[key[0], bracket[0], bracket[1]]):
                if bracket[2] < n:
                    bracket[:] = [bracket[0] - STEP_BITS, to, bracket[2], n]
                    if low == high:
                        # One value fills the bracket; no negative zero.
                        values[key] = low + 0.0
                        del brackets[key]
                    break
                bracket[2] -= n

    of = grouped({(c, b[0], b[1]) for (c, _), b in brackets.items()})
    if of:
        upto = Window.partitionBy("of", "to").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        running = values_inside(of).withColumn("upto", F.sum("n").over(upto))
        at = {(c, shift): i for i, (c, shift, _) in enumerate(of)}
        wanted = F.lit(False)
        for (c, _), b in brackets.items():
            wanted = wanted | ((F.col("of") == at[c, b[0]]) & (F.col("to") == b[1]) & (F.col("upto") > b[2]) & (F.col("upto") - F.col("n") <= b[2]))
        rows = running.where(wanted).collect()
        for key, b in brackets.items():
            place_of = (at[key[0], b[0]], b[1])
            values[key] = next(r["value"] for r in rows if (r["of"], r["to"]) == place_of and r["upto"] - r["n"] <= b[2] < r["upto"])
    return {
        column: [_between(values[c, low], values[c, high], weight) for low, high, weight in ranks[c]] or [None] * len(shares)
        for c, column in zip(names, columns)
    }
