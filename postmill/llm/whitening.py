"""Whitening of vectors by exact principal components.

The entries become integers, so the scatter of the distinct vectors is an integer matrix, summed exactly
on Spark. Its characteristic polynomial is found modulo many primes (Hessenberg reduction, a task takes
some primes) and put together by Chinese remaindering. All roots of that polynomial are real, so the sign
changes of its shifted coefficients count the roots beyond a place exactly: bisection isolates each
eigenvalue, however close its neighbours are, to 200 bits. The component is the null space of the matrix
less its eigenvalue, by inverse iteration in 100-digit arithmetic.

What passes through the driver is bounded by the number of dimensions: the scatter, residues and components.

Edge cases: a vector that is null, or that holds a null, non-finite or too large entry (2^62 / 256 and
beyond), is left out. A shorter vector counts as ending in zeros. Rows with the same id or vector are each
answered; the fit takes a vector once. Only directions of positive variance are components, so an empty
table, one distinct vector or equal vectors give no rows. Other columns are ignored. Where the exact
deviation exceeds a long, it is null.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import shared_folder, staged

#: Steps of the integers to one unit of an entry.
SCALE = 256

#: An entry is used while its integer is below this.
LARGEST = 2.0**62

#: Rows of one exact matrix product: digits of 21 bits, 2048 products, 53 bits of a double.
DIGIT, ROWS = 21, 2048

#: Bits of a digit of the summed scatter on its way through Spark.
WORD = 30

#: Roots closer than this share of themselves count as one root with several components.
SAME_BITS = 120

#: Bits of an eigenvalue, decimal digits of the inverse iteration and its rounds.
ROOT_BITS, DIGITS, ROUNDS = 200, 100, 3

#: Fraction bits of the places that bisection tries.
FRACTION = 320


def integers(vector: Column) -> Column:
    """floor(256 * entry) of every entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long"))


def usable(vector: Column) -> Column:
    """Vectors whose entries all become longs; a NaN is beyond every number."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double") * F.lit(float(SCALE))) < LARGEST))


def matrix_of(x: pa.Array, d: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows."""
    return np.asarray(x.flatten(), dtype=np.int64).reshape(-1, d)


def exact_product(y: np.ndarray) -> np.ndarray:
    """y.T @ y over Python integers: products of 21-bit digits are exact in doubles."""
    places = max(1, -(-int(np.abs(y).max(initial=1)).bit_length() // DIGIT))
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for k in range(0, len(y), ROWS):
        part = y[k : k + ROWS]
        sign, size = np.sign(part), np.abs(part)
        digits = [((size >> (DIGIT * p)) & ((1 << DIGIT) - 1)) * sign for p in range(places)]
        digits = [d.astype(np.float64) for d in digits]
        for p, a in enumerate(digits):
            for q, b in enumerate(digits):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << (DIGIT * (p + q)))
    return total


def scatter_sums(fit: DataFrame, d: int) -> np.ndarray:
    """Sums over the fit list of (1, x) times (1, x): row 0 holds the count and the sums."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), dtype=object)
        for batch in batches:
            x = matrix_of(batch.column("x"), d)
            total += exact_product(np.hstack([np.ones((len(x), 1), np.int64), x]))
        rows = []
        for i in range(d + 1):
            for j in range(i, d + 1):
                sign, rest, k = (-1 if total[i, j] < 0 else 1), abs(int(total[i, j])), 0
                while rest:
                    rows.append((i, j, k, sign * (rest & ((1 << WORD) - 1))))
                    rest, k = rest >> WORD, k + 1
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "k", "digit"])

    digits = fit.mapInArrow(products, "i int, j int, k int, digit long")
    out = np.zeros((d + 1, d + 1), dtype=object)
    for r in digits.groupBy("i", "j", "k").agg(F.sum("digit").alias("digit")).collect():
        out[r["i"], r["j"]] += r["digit"] << (WORD * r["k"])
    return np.triu(out) + np.triu(out, 1).T


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every 32-bit number."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    twos = (n - 1 & 1 - n).bit_length() - 1
    for base in (2, 3, 5, 7):
        x = pow(base, (n - 1) >> twos, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(limit: int) -> list[int]:
    """Primes below 2^31, from the top, whose product exceeds `limit`."""
    found, product, n = [], 1, 1 << 31
    while product <= limit:
        n -= 1
        if is_prime(n):
            found.append(n)
            product *= n
    return found


def modular_polynomial(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of the characteristic polynomial modulo p, constant term first."""
    a, d = (matrix % p).astype(np.int64), len(matrix)
    for m in range(1, d - 1):  # similar to an upper Hessenberg matrix
        below = np.flatnonzero(a[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            a[[m, i]] = a[[i, m]]
            a[:, [m, i]] = a[:, [i, m]]
        u = a[m + 1 :, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1 :] = (a[m + 1 :] - u[:, None] * a[m] % p) % p
        a[:, m] = (a[:, m] + (a[:, m + 1 :] * u % p).sum(1)) % p
    polys = [np.array([1] + [0] * d, dtype=np.int64)]
    for k in range(d):  # polynomial of the leading block of k + 1 rows from those of smaller blocks
        new = (np.roll(polys[k], 1) - a[k, k] * polys[k] % p) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(a[i + 1, i]) % p
            if not chain:
                break
            new = (new - int(a[i, k]) * chain % p * polys[i] % p) % p
        polys.append(new)
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Integer coefficients, constant term first; a task handles some of the primes."""
    d, trace = len(matrix), int(np.trace(matrix))
    # The k-th coefficient of a matrix without negative eigenvalues is at most C(d, k) (trace / d)^k.
    primes = primes_beyond(2 * (2 + trace // d) ** d)
    shared = spark.sparkContext.broadcast(matrix)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                found = modular_polynomial(shared.value, p).tolist()
                yield pa.RecordBatch.from_pydict({"p": pa.array([p]), "residues": pa.array([found], pa.list_(pa.int64()))})

    numbers = spark.createDataFrame([(p,) for p in primes], "p long")
    tasks = min(len(primes), max(1, 2 * spark.sparkContext.defaultParallelism))
    rows = numbers.repartition(tasks).mapInArrow(residues, "p long, residues array<long>").collect()
    shared.unpersist()
    product = math.prod(primes)
    unit = {r["p"]: (product // r["p"]) * pow(product // r["p"], -1, r["p"]) for r in rows}
    whole = [sum(unit[r["p"]] * r["residues"][k] for r in rows) % product for k in range(d + 1)]
    return [c - product if 2 * c > product else c for c in whole]


def roots_above(poly: list[int], place: int, one: int = 1) -> int:
    """How many roots exceed place / one: the sign changes of the polynomial shifted there, as all roots are real."""
    scaled, power = [], 1
    for c in reversed(poly):  # multiples of the roots by `one`
        scaled.append(c * power)
        power *= one
    shifted = scaled
    for k in range(len(poly) - 1, 0, -1):
        row = [shifted[0]]
        for c in shifted[1 : k + 1]:
            row.append(c + row[-1] * place)
        shifted[: k + 1] = row
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign_at(poly: list[int], place: int, bits: int) -> int:
    """Sign of the polynomial at place / 2^bits."""
    value = 0
    for k, c in enumerate(reversed(poly)):
        value = value * place + (c << (bits * k))
    return (value > 0) - (value < 0)


@dataclass(frozen=True)
class Root:
    """An eigenvalue: low <= 2^320 value <= high, how many roots are larger, and how many it stands for."""

    low: int
    high: int
    larger: int
    count: int


def isolate(poly: list[int], k: int, limit: int) -> Root:
    """The k-th largest root (from 1, with multiplicity), which is positive and at most `limit`."""
    one = 1 << FRACTION
    low, high, above_low, above_high = 0, limit + 1, roots_above(poly, 0), 0
    bits = 0  # the interval is (low, high] / 2^bits
    while above_low - above_high > 1 and (high - low) << SAME_BITS > low:
        if high - low < 2:
            step = min(32, FRACTION - bits)
            if not step:
                break
            low, high, bits = low << step, high << step, bits + step
        middle = (low + high) // 2
        above = roots_above(poly, middle, 1 << bits)
        if above >= k:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    count = above_low - above_high
    low, high = low << (FRACTION - bits), high << (FRACTION - bits)
    over = sign_at(poly, high, FRACTION) if count == 1 else 0
    while high - low > 1 and (high - low) << ROOT_BITS > low:
        middle = (low + high) // 2
        # One root alone is where the sign changes; several are counted.
        sign = sign_at(poly, middle, FRACTION) if count == 1 else 0
        if count == 1 and over and sign in (0, over):
            high = middle
        elif (count == 1 and over) or roots_above(poly, middle, one) >= k:
            low = middle
        else:
            high = middle
    return Root(low, high, above_high, count)


def null_vectors(matrix: np.ndarray, value: decimal.Decimal, count: int) -> list[list[decimal.Decimal]]:
    """Orthonormal vectors of the null space of matrix - value, by inverse iteration."""
    d = len(matrix)
    rows = [[decimal.Decimal(int(v)) for v in row] for row in matrix]
    for i in range(d):
        rows[i][i] -= value
    tiny = max(abs(v) for row in rows for v in row).scaleb(-DIGITS) or decimal.Decimal(1)
    order = list(range(d))
    for k in range(d):  # elimination with row exchange; the factors stay below the diagonal
        best = max(range(k, d), key=lambda i: abs(rows[i][k]))
        rows[k], rows[best], order[k], order[best] = rows[best], rows[k], order[best], order[k]
        if abs(rows[k][k]) < tiny:
            rows[k][k] = tiny
        pivot = rows[k]
        for row in rows[k + 1 :]:
            if row[k]:
                factor = row[k] = row[k] / pivot[k]
                row[k + 1 :] = [a - factor * b for a, b in zip(row[k + 1 :], pivot[k + 1 :], strict=True)]

    def solve(b: list) -> list:
        x = [b[i] for i in order]
        for i in range(d):
            x[i] -= sum(f * v for f, v in zip(rows[i][:i], x[:i], strict=True))
        for i in range(d - 1, -1, -1):
            x[i] = (x[i] - sum(f * v for f, v in zip(rows[i][i + 1 :], x[i + 1 :], strict=True))) / rows[i][i]
        return x

    def unit(x: list, found: list[list]) -> list:
        for _ in range(2):
            for f in found:
                along = sum(a * b for a, b in zip(x, f, strict=True))
                x = [a - along * b for a, b in zip(x, f, strict=True)]
        length = sum(v * v for v in x).sqrt()
        return [v / length for v in x]

    found: list[list] = []
    for c in range(count):
        start = np.random.default_rng(c).integers(1, 1 << 20, d)
        x = unit([decimal.Decimal(int(v)) for v in start], found)
        for _ in range(ROUNDS):
            x = unit(solve(x), found)
        found.append(x)
    return found


def component(matrix: np.ndarray, poly: list[int], k: int) -> tuple[str, list[float]]:
    """Eigenvalue (as decimal text) and unit eigenvector of the k-th component, its largest entry positive."""
    with decimal.localcontext() as ctx:
        ctx.prec, ctx.Emax, ctx.Emin = DIGITS, decimal.MAX_EMAX, decimal.MIN_EMIN
        root = isolate(poly, k, int(np.trace(matrix)))
        value = decimal.Decimal(root.low + root.high) / (decimal.Decimal(2) ** (FRACTION + 1))
        vector = [float(v) for v in null_vectors(matrix, value, k - root.larger)[-1]]
        return str(value), vector if max(vector, key=abs) > 0 else [-v for v in vector]


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: count and sums of the fit list, unit components, their variances and shares."""

    n: int
    sums: list[int]
    components: list[list[float]]
    variances: list[float]
    explained: list[float]
    identity_error: float

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer vectors."""
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ np.array(self.components).T / np.sqrt(np.array(self.variances))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2: exact by arithmetic modulo 2^64 where they are below 2^63."""
        rough = ((self.n * x.astype(np.float64) - np.array([float(s) for s in self.sums])) ** 2).sum(1)
        n, sums = np.uint64(self.n % 2**64), np.array([s % 2**64 for s in self.sums], np.uint64)
        exact = ((x.view(np.uint64) * n - sums) ** 2).sum(1, dtype=np.uint64).view(np.int64)
        return [int(e) if r < 2.0**63 and e >= 0 else None for r, e in zip(rough, exact, strict=True)]

    def transform(self, embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(key, deviation, whitened: one number a component) of every usable row."""
        rows = _rows(embeddings, vector, len(self.sums), F.col(key).alias("id"))
        out = f"id {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix_of(batch.column("x"), len(self.sums))
                white = pa.array(self.projected(x).tolist(), pa.list_(pa.float64()))
                arrays = [batch.column("id"), pa.array(self.deviations(x), pa.int64()), white]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "deviation", "whitened"])

        return rows.mapInArrow(run, out).withColumnRenamed("id", key)


def _rows(embeddings: DataFrame, vector: str, d: int, *others: Column) -> DataFrame:
    """Integer vectors of d entries of the usable rows; longer ones belong to no fit of d dimensions and go."""
    v = F.col(vector)
    x = integers(v)
    padded = F.when(F.size(v) < d, F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(v)))).otherwise(x)
    return embeddings.filter(usable(v) & (F.size(v) <= d)).select(*others, padded.alias("x"))


def fit(embeddings: DataFrame, components: int = 4, vector: str = "embedding") -> Whitening | None:
    """The whitening of a table's distinct vectors; None where nothing varies."""
    spark = embeddings.sparkSession
    d = embeddings.filter(usable(F.col(vector))).agg(F.max(F.size(vector))).first()[0]
    if not d:
        return None
    distinct = staged(_rows(embeddings, vector, d).distinct(), shared_folder(spark), "fit")
    sums = scatter_sums(distinct, d)
    n, first = int(sums[0, 0]), sums[0, 1:]
    scatter = n * sums[1:, 1:] - np.outer(first, first)  # n^2 times the covariance
    trace = int(np.trace(scatter))
    if not trace:
        return None
    poly = characteristic_polynomial(spark, scatter)
    rank = d - next(k for k, c in enumerate(poly) if c)
    wanted = min(components, rank)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                value, found = component(scatter, poly, k)
                columns = [pa.array([k]), pa.array([value]), pa.array([found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["k", "value", "vector"])

    tasks = spark.range(1, wanted + 1, numPartitions=wanted)
    found = sorted(tasks.mapInArrow(solve, "k long, value string, vector array<double>").collect())
    values = [decimal.Decimal(r["value"]) for r in found]
    model = Whitening(
        n,
        [int(s) for s in first],
        [r["vector"] for r in found],
        [float(v / (decimal.Decimal(n) ** 2)) for v in values],
        [float(v / trace) for v in values],
        0.0,
    )
    return Whitening(**{**model.__dict__, "identity_error": _identity_error(model, distinct)})


def _identity_error(model: Whitening, distinct: DataFrame) -> float:
    """Largest entry of the whitened fit list's covariance less the identity; the moments are merged centred."""
    k, d = len(model.variances), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            white = model.projected(matrix_of(batch.column("x"), d))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in white.T], [f"w{i}" for i in range(k)])

    white = distinct.mapInArrow(run, ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = white.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, row, strict=True))


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_rows(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """One row per usable vector and component."""
    model = fit(embeddings, components)
    if model is None:
        kind = embeddings.schema["vec_id"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, {OUT}")
    each = model.transform(embeddings).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(s) for s in model.explained])
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
