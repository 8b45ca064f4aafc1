"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Components c become whole numbers x = floor(256 c). The fit list, each distinct x once, gives n, sums S and the integer scatter
M = n * sum(x x') - S S', which is n^2 times the covariance V. Sums of products come from each task and are added up in Spark.
The characteristic polynomial of M is computed modulo primes, a Spark row each: reduction to Hessenberg form, then the recurrence over
its leading blocks. As many primes are taken as the bound of its coefficients asks for (M is positive semidefinite, so that they
are at most C(d, k) (trace / d)^k in size), and Chinese remaindering gives the exact whole numbers.

All roots are real, so that the sign changes of the polynomial shifted to t count the roots beyond t exactly, repeated ones as often as
they occur: bisection by that count isolates the largest roots, bisection by sign narrows a single one down to 2^-128 of its
size. Roots that are closer than that share an eigenspace. Inverse iteration on the null space of M - root, in decimals
with more digits than the closest roots share, gives the components, orthogonal where a root is repeated.

Only what the width d bounds comes to the driver: d (d + 1) / 2 sums, d + 1 residues a prime.

Rows whose vector is null, empty, or holds null or non-finite entries are left out, and those whose length is not the commonest
(of several the longest); a null id stays. Equal vectors get equal values; repeated rows are all returned. A component without
variance can't be whitened: as many components are returned as have an eigenvalue above 0, at most `components`; none where
all vectors are equal. An empty table gives no rows. Only the id and the vector are read; other columns, of any name, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verivane.llm.common import discard, materialize, table
from verivane.llm.vectors import matrix, usable, whole

COMPONENTS = 4
CLOSE = 128  #: bits to which a root is known; roots that agree in all of them share an eigenspace
ROWS = 4096  #: rows whose products are summed at a time


@dataclass(frozen=True)
class Whitener:
    """What whitens a row: n, sums, and for each component its vector over the root of its eigenvalue, and its share of the variance."""

    n: int
    sums: list[int]
    directions: np.ndarray  # d x components, unit vectors
    deviations: np.ndarray  # roots of the eigenvalues
    explained: np.ndarray


# ---- scatter --------------------------------------------------------------------------------------------


def products(x: np.ndarray) -> np.ndarray:
    """The exact sum of x x' over the rows of x, as Python's numbers."""
    top = int(np.abs(x).max(initial=0))
    if top * top * ROWS < 1 << 53:  # doubles hold each slice's sums
        parts = [x[i : i + ROWS].astype(np.float64) for i in range(0, len(x), ROWS)]
        return sum((p.T @ p).astype(np.int64).astype(object) for p in parts) if parts else np.zeros((x.shape[1],) * 2, object)
    return x.astype(object).T @ x.astype(object)


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and M of the rows of fit (x)."""
    upper = np.triu_indices(d + 1)  # a constant 1 beside x gives n and S

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for b in batches:
            x = matrix(b["x"], d, np.int64)
            total = total + products(np.c_[np.ones(len(x), np.int64), x])
        cells = [int(v) for v in total[upper]]
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(cells, pa.decimal128(38, 0))], ["i", "j", "v"])

    rows = fit.select("x").mapInArrow(sums, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    q = [[0] * (d + 1) for _ in range(d + 1)]
    for i, j, v in rows:
        q[i][j] = q[j][i] = int(v)
    n, s = q[0][0], q[0][1:]
    return n, s, [[n * q[i + 1][j + 1] - s[i] * s[j] for j in range(d)] for i in range(d)]


# ---- characteristic polynomial -----------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that are enough below 2^32."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 61)):
        return n in (2, 3, 5, 7, 61)
    odd = (n - 1) // ((n - 1) & (1 - n))
    return all(pow(a, odd, n) == 1 or any(pow(a, odd << k, n) == n - 1 for k in range(((n - 1) // odd).bit_length() - 1)) for a in (2, 7, 61))


def primes(bound: int) -> list[int]:
    """The largest primes below 2^31, as many as make a product above `bound`."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to a modulo p, without entries below the subdiagonal."""
    h, d = a.copy(), len(a)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[m, i]] = h[[i, m]]
            h[:, [m, i]] = h[:, [i, m]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(1)) % p
    return h


def characteristic(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, from the constant up, of det(t - a) modulo p."""
    h, d = hessenberg(a, p), len(a)
    block = np.zeros((d + 1, d + 1), np.int64)  # of each leading block
    block[0, 0] = 1
    for m in range(d):
        row = np.r_[0, block[m, :-1]] - h[m, m] * block[m] % p
        chain = 1
        for i in range(m - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            row = row - (chain * int(h[i, m]) % p) * block[i] % p
        block[m + 1] = row % p
    return block[d]


def polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """The exact characteristic polynomial of a positive semidefinite integer matrix, from the constant coefficient up; a prime is a row."""
    d = len(m)
    trace = sum(m[i][i] for i in range(d))
    bound = max(math.comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    moduli = primes(2 * bound)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [characteristic(np.array([[v % p for v in row] for row in m], np.int64), p) for p in b["p"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["p"], pa.array(found, pa.list_(pa.int64()))], ["p", "c"])

    rows = spark.createDataFrame([(p,) for p in moduli], "p long").mapInArrow(residues, "p long, c array<long>").collect()
    product = math.prod(r["p"] for r in rows)
    parts = [(r["c"], (product // r["p"]) * pow(product // r["p"], -1, r["p"])) for r in rows]
    out = [sum(c[k] * w for c, w in parts) % product for k in range(d + 1)]
    return [v - product if v > product // 2 else v for v in out]


# ---- roots ------------------------------------------------------------------------------------------------


def beyond(c: list[int], t: Fraction) -> int:
    """How many roots of a polynomial with real roots only are above t, repeated ones as often as they occur: sign changes after a shift."""
    d, a, b = len(c) - 1, t.numerator, t.denominator
    s = [v * b ** (d - i) for i, v in enumerate(c)]  # in units of 1 / b
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            s[j] += a * s[j + 1]
    signs = [v > 0 for v in s if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def positive(c: list[int], t: Fraction) -> bool:
    a, b = t.numerator, t.denominator
    value, unit = 0, 1
    for v in reversed(c):
        value, unit = value * a + v * unit, unit * b
    return value > 0


def largest_roots(c: list[int], top: int, most: int) -> list[tuple[Fraction, int]]:
    """The largest positive roots and how often each occurs, until they are `most` in all; none is above `top`."""
    zeros = next(i for i, v in enumerate(c) if v)  # how often 0 is a root
    c = c[zeros:]
    out: list[tuple[Fraction, int]] = []
    high, done = Fraction(2) ** max(top, 1).bit_length(), 0
    while done < min(most, len(c) - 1):
        lo, hi, inside = Fraction(0), high, len(c) - 1 - done  # roots in (lo, hi]
        while hi - lo > hi / (1 << CLOSE):
            middle = (lo + hi) / 2
            if inside > 1:
                above = beyond(c, middle) - done
                lo, hi, inside = (middle, hi, above) if above else (lo, middle, inside)
            elif positive(c, middle) == (done % 2 == 0):  # an even number of roots lies above
                hi = middle
            else:
                lo = middle
        out.append(((lo + hi) / 2, inside))
        done += inside
        high = lo
    return out


# ---- components -------------------------------------------------------------------------------------------


def solve(a: list[list[Decimal]], columns: list[list[Decimal]], tiny: Decimal) -> list[list[Decimal]]:
    """Gaussian elimination with row pivots; a pivot of 0 counts as `tiny`, so that a singular matrix gives its null space."""
    d = len(a)
    rows = [list(r) + [c[i] for c in columns] for i, r in enumerate(a)]
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(rows[i][k]))
        rows[k], rows[best] = rows[best], rows[k]
        pivot = rows[k][k] = rows[k][k] if abs(rows[k][k]) > tiny else tiny
        for i in range(k + 1, d):
            if rows[i][k]:
                f = rows[i][k] / pivot
                head = rows[k]
                rows[i] = [*rows[i][: k + 1], *(x - f * y for x, y in zip(rows[i][k + 1 :], head[k + 1 :], strict=True))]
    out = []
    for c in range(len(columns)):
        y = [Decimal(0)] * d
        for i in range(d - 1, -1, -1):
            y[i] = (rows[i][d + c] - sum((rows[i][j] * y[j] for j in range(i + 1, d)), Decimal(0))) / rows[i][i]
        out.append(y)
    return out


def orthonormal(vectors: list[list[Decimal]]) -> list[list[Decimal]]:
    out: list[list[Decimal]] = []
    for v in vectors:
        for _ in range(2):
            for u in out:
                dot = sum((x * y for x, y in zip(u, v, strict=True)), Decimal(0))
                v = [x - dot * y for x, y in zip(v, u, strict=True)]
            size = sum((x * x for x in v), Decimal(0)).sqrt()
            v = [x / size for x in v]
        out.append(v)
    return out


def eigenvectors(m: list[list[int]], root: Fraction, times: int) -> list[list[float]]:
    """Unit vectors of the eigenspace of a root that occurs `times` times, each with its largest entry above 0."""
    d, top = len(m), max(1, max(abs(v) for row in m for v in row))
    with localcontext() as context:
        context.prec = 2 * CLOSE * 3 // 10 + len(str(top)) + len(str(d)) + 40
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        a = [[Decimal(v) - shift if i == j else Decimal(v) for j, v in enumerate(row)] for i, row in enumerate(m)]
        tiny = Decimal(top).scaleb(-context.prec + 10)
        start = np.random.default_rng(d).integers(1, 1000, (times, d))
        v = [[Decimal(int(x)) for x in s] for s in start]
        for _ in range(3):
            v = orthonormal(solve(a, v, tiny))
        return [[float(x * (1 if max(u, key=abs) > 0 else -1)) for x in u] for u in v]


def fit_whitener(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitener:
    """From the distinct vectors x of d whole numbers."""
    n, s, m = scatter(fit, d)
    trace = sum(m[i][i] for i in range(d))
    roots = largest_roots(polynomial(fit.sparkSession, m), trace, components) if trace else []
    values = [r for r, times in roots for _ in range(times)][:components]
    vectors = [v for r, times in roots for v in eigenvectors(m, r, times)][:components]
    return Whitener(
        n, s, np.array(vectors, float).reshape(-1, d).T, np.array([math.sqrt(r) / n for r in values]), np.array([float(r / trace) for r in values])
    )


# ---- application ------------------------------------------------------------------------------------------


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact."""
    top = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    kind = np.int64 if top < 1 << 62 else object
    return x.astype(kind) * n - np.array(sums, kind)


def applied(rows: DataFrame, d: int, w: Whitener, keep: list[str]) -> DataFrame:
    """`keep`, deviation (sum of squares of n x - S) and whitened (a list) of each row's x."""
    directions = w.directions / w.deviations

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = deviations(matrix(b["x"], d, np.int64), w.n, w.sums)
            top = int(np.abs(off).max(initial=0))
            squares = (off * off).sum(1) if top * top * d < 1 << 63 else (off.astype(object) ** 2).sum(1)
            values = off.astype(np.float64) / w.n @ directions
            square = pa.array([int(v) for v in squares], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], square, pa.array(list(values), pa.list_(pa.float64()))], [*keep, "deviation", "whitened"])

    kinds = [f"{c} {t}" for c, t in rows.select(*keep).dtypes]
    return rows.select(*keep, "x").mapInArrow(apply, ", ".join([*kinds, "deviation decimal(38,0)", "whitened array<double>"]))


def identity_error(fit: DataFrame, d: int, w: Whitener) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(w.explained)
    values = applied(fit, d, w, []).select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(k)])
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = values.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in cells]).first()
    return max((abs(c - (i == j)) for c, (i, j) in zip(row, cells, strict=True)), default=0.0)


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component (from 1), n, deviation (decimal), whitened, explained, identity_error of each usable row and component."""
    good, d = usable(rows, [id_column], vector)
    empty = rows.select(id_column).where("false").selectExpr(f"`{id_column}`", "0 component", "0L n", "cast(0 as decimal(38,0)) deviation", "0D whitened", "0D explained", "0D identity_error")
    if not d:
        return empty
    x = good.select(id_column, whole().alias("x"))
    fit = materialize(x.select("x").distinct(), "whitening-fit")
    w = fit_whitener(fit, d, components)
    if not len(w.explained):
        discard(fit)
        return empty
    error = identity_error(fit, d, w)
    discard(fit)
    shares = F.array(*[F.lit(float(v)) for v in w.explained])
    each = applied(x, d, w, [id_column]).select(id_column, "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return each.select(
        id_column, (F.col("_k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_k")).alias("explained"), F.lit(error).alias("identity_error")
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
ORACLE_SQL: dict[str, str] = {}
