"""Whitening of embeddings: covariance in one distributed pass, its leading eigenpairs by contour integration.

FEAST: the spectrum is cut into intervals that hold a few eigenvalues each, a
quadrature of complex shifted solves (z - V)^-1 Y around an interval projects
onto its eigenvectors, Rayleigh-Ritz extracts them, and inertia counts at both
ends of the interval tell how many there must be.  Intervals are independent
and run as Spark tasks.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import discard, stage

COMPONENTS = 16
#: Entries become floor(SCALE * c) + OFFSET; beyond LARGEST they stop, so that they stay exact.
SCALE, OFFSET, LARGEST = 64, 1_000_000, float(2**52)
#: Eigenvalues of an interval and its largest quotient of ends, points on the upper half of its contour, passes.
PER_INTERVAL, WIDE, POINTS, PASSES = 8, 2, 8, 40
#: Parts of the largest eigenvalue: below it a component counts as without variance; two eigenvalues nearer than this are not cut apart.
LEAST, NEAR = 1e-12, 1e-9


def entries(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows key, x of the vectors whose entries are all given and finite."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    limit = F.lit(LARGEST)
    x = F.transform(v, lambda c: F.floor(F.greatest(-limit, F.least(limit, F.lit(float(SCALE)) * c))) + OFFSET)
    return vectors.filter(F.col(vector).isNotNull() & ~bad & (F.size(vector) > 0)).select(key, x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums per dimension; one row per task and dimension is shuffled."""
    def run(batches):
        n, total = 0, [0] * dims
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n += len(x)
            # Whole numbers of any size: halves of 32 bits, whose sums over a batch fit into 64.
            high = (x >> 32).sum(0).tolist()
            low = (x & 0xFFFFFFFF).sum(0).tolist()
            total = [t + (h << 32) + l for t, h, l in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int32()), pa.array(list(map(str, [n, *total])))], names=["dim", "total"])

    found = fit.select("x").mapInArrow(run, "dim int, total string")
    per = {r[0]: int(r[1]) for r in found.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string")).collect()}
    return per.get(-1, 0), [per.get(d, 0) for d in range(dims)]


def _added(parts: DataFrame, dims: int) -> np.ndarray:
    """Sum of matrices given as rows (i, values): each task adds the rows that it gets, a few per row number reach the driver."""
    def run(batches):
        total = {}
        for batch in batches:
            for i, values in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), dims)):
                total[i] = total[i] + values if i in total else values
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["i", "row"])

    out = np.zeros((dims, dims))
    for r in parts.repartition("i").mapInArrow(run, "i int, row array<double>").collect():
        out[r["i"]] += r["row"]
    return out


def _products(rows: DataFrame, made, dims: int, width: int) -> np.ndarray:
    """Sum over the rows x of the outer product of made(x), a row of `width` doubles, with itself."""
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            w = made(_matrix(batch.column(0), dims))
            total += w.T @ w
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    return _added(rows.select("x").mapInArrow(run, "i int, row array<double>"), width)


def centre(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Means as whole parts and rests, so that x - whole is exact."""
    whole = [(2 * t + n) // (2 * n) for t in total]
    return np.array(whole, np.int64), np.array([(t - w * n) / n for t, w in zip(total, whole)])


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a symmetric matrix after reflections, which keep its eigenvalues."""
    a = v.copy()
    side = np.zeros(max(0, len(a) - 1))
    for k in range(len(a) - 1):
        u = a[k + 1:, k].copy()
        side[k] = -np.copysign(np.linalg.norm(u), u[0])
        u[0] -= side[k]
        square = u @ u
        if square > 0:
            rest = a[k + 1:, k + 1:]
            p = rest @ u * (2 / square)
            w = p - u * (u @ p / square)
            rest -= np.outer(u, w) + np.outer(w, u)
    return a.diagonal().copy(), side


def above(form: tuple[np.ndarray, np.ndarray], shifts) -> np.ndarray:
    """Inertia: how many eigenvalues stand above each shift, by the signs of the pivots of the shifted matrix (Sylvester's law)."""
    diagonal, side = form
    shifts = np.asarray(shifts, float)
    least = np.finfo(float).tiny * max(1.0, float((side**2).max(initial=0.0)))
    count = np.zeros(shifts.shape, np.int64)
    pivot = np.ones(shifts.shape)
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shifts - (side[k - 1] ** 2 / pivot if k else 0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot > 0
    return count


def intervals(v: np.ndarray, wanted: int, per: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues between) from the top down, until `wanted` eigenvalues of variance are covered.

    Bisection by inertia counts.  An interval of more than `per` eigenvalues is
    cut unless it is narrower than NEAR of the largest, and so is one that is
    WIDE: many small eigenvalues would stand close below it, beside its width.
    Of some cuts the one that the fewest eigenvalues are near is taken, as
    those would converge slowly.
    """
    top = float(np.abs(v).sum(1).max(initial=0.0)) * (1 + 1e-12)  # no eigenvalue is above it
    form = tridiagonal(v)

    def count(*shifts):
        found = above(form, shifts).tolist()
        return found if len(found) > 1 else found[0]

    low, high = LEAST * top, top
    wanted = min(wanted, count(low))
    if not top or not wanted:
        return []
    end = high
    while count(low) > wanted and end - low > NEAR * top:
        middle = (low + end) / 2
        if count(middle) >= wanted:
            low = middle
        else:
            end = middle
    out, todo = [], [(low, high)]
    while todo:
        low, high = todo.pop()
        under, over = count(low, high)
        if under == over:
            continue
        if under - over <= per and high <= WIDE * low or high - low <= NEAR * top:
            out.append((low, high, under - over))
            continue
        at = np.linspace(0.375, 0.625, 9)
        tries = low * (high / low) ** at if high > WIDE * low else low + (high - low) * at
        margin = np.diff(tries).min() / 2
        near = above(form, tries - margin) - above(form, tries + margin)
        cut = float(min(zip(near, np.abs(at - 0.5), tries))[2])
        todo += [(low, cut), (cut, high)]
    return sorted(out, reverse=True)


def feast(v: np.ndarray, low: float, high: float, held: int) -> tuple[np.ndarray, np.ndarray]:
    """The `held` eigenvalues of v in (low, high] and their unit vectors as columns.

    Gauss points on a circle around the interval; passes until the residuals
    stand at rounding.  What the circle lets through of others is damped in
    each pass, so a few more columns than eigenvalues are carried.
    """
    dims = len(v)
    columns = min(dims, held + max(8, held))
    middle, radius = (low + high) / 2, (high - low) / 2 * 1.0000001 + 1e-300
    points, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = (points + 1) * np.pi / 2
    nodes = middle + radius * np.exp(1j * angles)
    factors = weights / 2 * radius * np.exp(1j * angles)
    y = np.random.default_rng(held).standard_normal((dims, columns))
    scale, best = np.abs(v).max(), (np.inf, None, None)
    for _ in range(PASSES):
        # The lower half of the circle is the conjugate of the upper one.
        q = sum((f * np.linalg.solve(z * np.eye(dims) - v, y)).real for z, f in zip(nodes, factors))
        q, _ = np.linalg.qr(q)
        values, turn = np.linalg.eigh(q.T @ v @ q)
        y = q @ turn
        inside = (values > low) & (values <= high)
        if inside.sum() == held:
            residual = np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0).max()
            if residual < best[0]:
                best = residual, values[inside], y[:, inside]
            elif best[0] <= 1e-13 * dims * scale:
                break  # no pass improves it any more
    if best[1] is None or best[0] > 1e-9 * dims * scale:
        raise ArithmeticError(f"{held} eigenvalues were counted in ({low}, {high}], and not found")
    return best[1], best[2]


def eigenpairs(spark, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their vectors as columns; those without variance are left out.

    Each interval is a task; all that comes back are `wanted` vectors.
    """
    cuts = intervals(v, wanted)
    if not cuts:
        return np.empty(0), np.empty((len(v), 0))

    def run(batches):
        for batch in batches:
            for cut in batch.to_pylist():
                values, vectors = feast(v, cut["low"], cut["high"], cut["held"])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], names=["value", "vector"])

    tasks = spark.createDataFrame(cuts, "low double, high double, held int").repartition(len(cuts), "low")
    found = sorted(tasks.mapInArrow(run, "value double, vector array<double>").collect(), key=lambda r: -r["value"])
    vectors = np.array([r["vector"] for r in found]).T
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return np.array([r["value"] for r in found])[:wanted], (vectors * signs)[:, :wanted]


def _decimals(values: list[int]) -> pa.Array:
    """Whole numbers as decimals; null beyond 38 digits."""
    return pa.array([Decimal(v) if v < 10**38 else None for v in values], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows key, component, n, deviation (decimal), whitened, explained, identity_error of every usable vector.

    The covariance is over the distinct vectors.  Vectors that are null, empty
    or hold null or non-finite entries are dropped, and so are those that are
    not of the most frequent length (of equally frequent ones the longest).
    Components without variance are left out: few distinct vectors give fewer,
    one or none give no rows.  Null and repeated keys are rows like others.
    Other columns are not read.  Entries beyond 2**52 / 64 count as that.

    What passes the driver is a matrix of the dimensions, whatever the rows.
    """
    spark = vectors.sparkSession
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    if key in names:
        raise ValueError(f"column {key} is the result's, name the key otherwise")
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = entries(vectors, key, vector)
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    empty = spark.createDataFrame([], schema)
    if lengths is None:
        return empty
    dims = lengths["dims"]
    rows = rows.filter(F.size("x") == dims)
    fit = stage(rows.select("x").distinct(), "fit")
    n, total = sums(fit, dims)
    whole, rest = centre(n, total)
    covariance = _products(fit, lambda x: (x - whole) - rest, dims, dims) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = eigenpairs(spark, covariance, components)
    count = len(values)
    if not count:
        discard(fit)
        return empty
    turn = axes / np.sqrt(values)

    def project(x):
        return ((x - whole) - rest) @ turn

    # The mean of what is projected is a rounding error; with a column of ones its square is taken off all the same.
    moments = _products(fit, lambda x: np.column_stack([project(x), np.ones(len(x))]), dims, count + 1) / n
    error = float(np.abs(moments[:count, :count] - np.outer(moments[count, :count], moments[count, :count]) - np.eye(count)).max())
    discard(fit)
    explained = values / covariance.trace()
    # n * x - S is n * (x - whole) - off, of few bits.
    off = [t - int(w) * n for t, w in zip(total, whole)]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            rows, near = batch.num_rows, x - whole
            if (n * (int(np.abs(near).max(initial=0)) + 1)) ** 2 * dims < 2**63:
                deviation = ((n * near - np.array(off)) ** 2).sum(1).tolist()
            else:
                deviation = [sum((n * a - o) ** 2 for a, o in zip(r, off)) for r in near.tolist()]
            repeat = pa.array(np.repeat(np.arange(rows), count))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(repeat), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)), pa.array(np.full(rows * count, n)),
                _decimals(deviation).take(repeat), pa.array(project(x).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * count, error))],
                names=[key, *names])

    return rows.select(key, "x").mapInArrow(run, schema)
