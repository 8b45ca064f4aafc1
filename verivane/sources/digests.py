"""Checks that read only what has changed: digests of parts say which."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from verivane.operators.quality import leakage_report
from verivane.schema import FEATURE_COLUMNS, KEYS, MEASURES, TABLES
from verivane.sources.tables import State, _fs, measure, put, read_parts, state

#: What decides whether a feature is right.
READ = {"observations": [*KEYS["observations"], *MEASURES], "features": [*KEYS["features"], *FEATURE_COLUMNS]}


def verify(spark: SparkSession, root: str, name: str) -> DataFrame:
    """part, column (`rows` for their number) where a part's files don't hold what its version says; a part without rows differs in all. One pass over the table."""
    now, schema = state(spark, root, name), TABLES[name]
    found = measure(spark, root, name, schema, now, now.parts)
    values = lambda about: {"rows": about["rows"], **about["digests"]} if about else {}
    wrong = [(part, c) for part, about in sorted(now.parts.items()) for c, v in values(about).items() if values(found.get(part)).get(c) != v]
    return spark.createDataFrame(wrong, "part string, column string")


# ---- leakage ------------------------------------------------------------------------------------------


def mark(spark: SparkSession, root: str) -> dict[str, State]:
    """The versions of observations and features that stand now."""
    return {name: state(spark, root, name) for name in READ}


def _spans(s: State, part: str) -> tuple[int, int, int]:
    """Year, number of low bits and their value that the hashes of a part's cities share."""
    bucket, year, n = s.of(part)
    bits = (n - 1).bit_length()
    whole = bucket >= 1 << bits >> 1 or bucket + (1 << bits >> 1) < n  # not waiting for its split
    return year, bits if whole else bits - 1, bucket


def _changed(before: State, now: State, columns: list[str]) -> set[tuple[int, int, int]]:
    """Spans of the parts, old or new, whose values in the columns differ."""
    digests = lambda s: {_spans(s, p): (about["rows"], *(about["digests"][c] for c in columns)) for p, about in s.parts.items()}
    a, b = digests(before), digests(now)
    return {span for span in a.keys() | b.keys() if a.get(span) != b.get(span)}


class _Reach:
    """Whether parts share cities with any of the given spans, and in which years."""

    def __init__(self, spans: set[tuple[int, int, int]]):
        self.depths = {bits for _, bits, _ in spans}
        self.years: dict[tuple[int, int, int], tuple[int, int]] = {}  # depth and leading bits in common: first and last year
        for year, bits, value in spans:
            for b in range(bits + 1):
                at = bits, b, value & ((1 << b) - 1)
                first, last = self.years.get(at, (year, year))
                self.years[at] = min(first, year), max(last, year)

    def _found(self, bits: int, value: int) -> list[tuple[int, int]]:
        """Cities are shared where the bits that both have are the same."""
        keys = [(d, min(d, bits), value & ((1 << min(d, bits)) - 1)) for d in self.depths]
        return [self.years[k] for k in keys if k in self.years]

    def by(self, span: tuple[int, int, int]) -> bool:
        """In the part's year or before it."""
        return any(first <= span[0] for first, _ in self._found(*span[1:]))

    def since(self, span: tuple[int, int, int]) -> bool:
        """In the part's year or after it."""
        return any(last >= span[0] for _, last in self._found(*span[1:]))


def leakage_since(spark: SparkSession, root: str, before: dict[str, State] | None = None, now: dict[str, State] | None = None) -> DataFrame:
    """leakage_report() of the stored features, of the parts alone whose outcome can have changed since `before` (None: of all): parts whose own
    values have changed, and those of the same cities in the years from a change of observations on. Of the observations, these cities' parts up to these years are read."""
    now = now or mark(spark, root)
    before = before or {name: State(0, {}, {}) for name in READ}
    moved = _Reach(_changed(before["observations"], now["observations"], READ["observations"]))
    own = _changed(before["features"], now["features"], READ["features"])
    wanted = {p for p in now["features"].parts if (span := _spans(now["features"], p)) in own or moved.by(span)}
    judged = _Reach({_spans(now["features"], p) for p in wanted})
    needed = {p for p in now["observations"].parts if judged.since(_spans(now["observations"], p))}
    rows = {n: read_parts(spark, root, n, TABLES[n], now[n], p) for n, p in (("features", wanted), ("observations", needed))}
    return leakage_report(rows["features"], rows["observations"])


def leakage_gate(spark: SparkSession, root: str) -> DataFrame:
    """leakage_since() the last time that nothing was found; where nothing is found, that is noted beside the features."""
    fs, path = _fs(spark, f"{root}/features/clean.json")
    before = json.loads(spark.read.text(path.toString(), wholetext=True).first()[0]) if fs.exists(path) else None
    now = mark(spark, root)
    report = leakage_since(spark, root, {n: State(*s) for n, s in before.items()} if before else None, now)
    if report.isEmpty():
        put(spark, json.dumps(now), path.toString(), overwrite=True)
    return report
