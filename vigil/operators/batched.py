"""Many binary regressions at once: one pass over the features serves all problems.

A problem is a set of training rows of a common table (a corpus under a split seed, say).
Problems differ in the rows they train on, in their class weights and in a scale per
feature (the idf of their own vocabulary, 0 for terms outside it). Rows are cut once into
blocks; an iteration broadcasts the coefficients of all problems and sums the gradients of
all problems in one pass, so k fits cost the passes of one. Each problem has its own L-BFGS
history and step, and stops by its own gradient.

Rows that train the same problems share a block, and a pass works on a block for its
problems alone. A block numbers its own features, so its products stay in the cache and an
entry takes two bytes. A pass has a task per core, whatever the number of partitions: each
task sends one gradient.

The objective is that of the single fits: class-balanced logistic loss, summed, plus the
squared coefficients over 2C; the intercept is free.

Few passes need a start near the inverse Hessian. Its few steep directions (frequent
features) are taken from some rows of each problem, drawn by their share of the curvature
and weighted by its inverse, in a pass every ``REFRESH`` turns; all rows still give every
value and gradient, so the rows drawn change the number of passes, not the optimum.

Memory: the driver holds ``(2 * GOOD_HISTORY + 4)`` vectors of features x problems; ``batches``
cuts the problems so that they stay below ``STATE_BYTES``. Where these bytes have room,
histories are longer (``steps_held``): fewer passes. Of drawn rows it holds some
``SAMPLE_ROWS`` per problem and ``SAMPLE_ENTRIES`` in all. Tasks hold one gradient.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import scratch_path

BLOCK_ENTRIES = 1 << 18
#: Blocks' worth of entries that a task holds while it deals rows to blocks by their problems.
OPEN_BLOCKS = 8
ROW_GROUP = 4 << 20
HISTORY = 8
LONGEST_HISTORY = 20
#: Shorter histories, and fewer drawn rows a problem, cost more passes than another group.
GOOD_HISTORY = 16
STATE_BYTES = 256 << 20
#: Features of one slice of a gradient, and the bytes of all tasks' gradients up to which
#: the driver adds them up itself.
SLICE = 4096
DIRECT_BYTES = 48 << 20
TOLERANCE = 1e-7
#: Turns after which rows are drawn again (and after the first three, when the curvature has
#: found its place), and steps of the history that are kept then.
REFRESH = 10
KEPT_STEPS = 5
SAMPLE_ROWS = 1000
SAMPLE_ENTRIES = 1 << 22
#: Columns of the drawn rows that are multiplied at a time; columns of fewer rows than ``FEW``
#: add the products of their pairs, so many at a time.
COLUMNS = 8192
FEW = 12
PAIRS = 1 << 20


def member(k: int, bits: str = "bits") -> Column:
    """1 where a row trains problem ``k``, else 0."""
    return F.shiftrightunsigned(F.col(bits), k).bitwiseAND(F.lit(1).cast("long"))


@dataclass
class Blocks:
    """Rows in blocks, their number of features, and per problem the rows per class."""

    data: DataFrame
    size: int
    counts: np.ndarray
    scale: np.ndarray | None
    partitions: int
    #: The blocks as arrays, where a fit holds them in the executors (memory, then disk).
    held: RDD | None = None

    def opened(self) -> RDD:
        return self.held or self.data.select(*NAMES).rdd.map(lambda r: _arrays(r.__getitem__))


def class_table(rows: DataFrame, problems: int) -> np.ndarray:
    """Training rows of each problem and class."""
    sums = [F.coalesce(F.sum(F.when(F.col("y") == c, member(k))), F.lit(0)).alias(f"c{k}_{c}") for k in range(problems) for c in (0, 1)]
    return np.array(rows.agg(*sums).first(), dtype=float).reshape(problems, 2)


def blocks_of(rows: DataFrame, size: int, problems: int, scale: np.ndarray | None = None) -> Blocks:
    """Blocks of ``rows`` (id, y, bits, i: indices, v: values; without v all are 1), written to the shared folder.

    ``scale``: features x problems; None means 1 everywhere. Rows are divided by their
    length after scaling."""
    shared, valued = rows.sparkSession.sparkContext.broadcast(scale), "v" in rows.columns

    def run(batches):
        s = shared.value

        def packed(held):
            sizes = np.array([len(h[3]) for h in held])
            i = np.concatenate([h[3] for h in held])
            v = np.concatenate([h[4] for h in held]) if valued else np.ones(len(i))
            square = np.zeros((len(held), problems))
            full = np.flatnonzero(sizes)
            if len(full):
                begin = (np.cumsum(sizes) - sizes)[full]
                each = v[:, None] ** 2 * (np.ones((1, problems)) if s is None else s[i] ** 2)
                square[full] = np.add.reduceat(each, begin, axis=0)
            with np.errstate(divide="ignore"):
                inverse = np.where(square > 0, 1 / np.sqrt(square), 0.0)
            # Values that are all 1 (binary features) are not stored.
            kept = np.zeros(0) if (v == 1).all() else v
            seen = np.zeros(size, dtype=bool)
            seen[i] = True
            used = np.flatnonzero(seen)
            place = np.zeros(size, dtype=_local(len(used)))
            place[used] = np.arange(len(used))
            arrays = (sizes, used.astype("<i4"), place[i], kept, inverse, np.array([h[1] for h in held], dtype="<i4"), np.array([h[2] for h in held], dtype="<i8"))
            ids = pa.array([[h[0] for h in held]], pa.list_(pa.int64()))
            data = [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]
            return pa.RecordBatch.from_arrays([ids, *data], names=["ids", *NAMES])

        most = BLOCK_ENTRIES // max(1, problems // 4)
        groups, entries = {}, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "y", "bits")]
            for id_, y, bits, i, v in zip(*columns, batch.column("i"), batch.column("v" if valued else "i")):
                # Copies: a view would hold its whole batch until the block is full.
                groups.setdefault(bits, []).append((id_, -1 if y is None else y, bits, np.array(i.values), np.array(v.values) if valued else None))
                entries[bits] = entries.get(bits, 0) + len(groups[bits][-1][3])
                full = bits if entries[bits] >= most else None
                if full is None and sum(entries.values()) >= OPEN_BLOCKS * most:
                    full = max(entries, key=entries.get)
                if full is not None:
                    yield packed(groups.pop(full))
                    del entries[full]
        # What is left is packed together, rows of like problems next to each other.
        held, left = [], 0
        for bits in sorted(groups):
            held, left = held + groups[bits], left + entries[bits]
            if left >= most:
                yield packed(held)
                held, left = [], 0
        if held:
            yield packed(held)

    made = rows.select("id", F.col("y").cast("int").alias("y"), "bits", "i", *(["v"] if valued else [])).mapInArrow(run, "ids array<long>, " + ", ".join(f"{n} binary" for n in NAMES))
    path = scratch_path(rows.sparkSession, "blocks")
    # Row groups are what a scan can be split at.
    made.write.options(**{"parquet.block.size": ROW_GROUP, "parquet.block.size.row.check.min": 1}).parquet(path)
    data = rows.sparkSession.read.schema(made.schema).parquet(path)
    return Blocks(data, size, _classes(data, problems), scale, data.rdd.getNumPartitions())


def _classes(data: DataFrame, problems: int) -> np.ndarray:
    """As :func:`class_table`, of written blocks: only labels and bits are read."""

    def run(batches):
        found = np.zeros((problems, 2))
        for batch in batches:
            for at in range(batch.num_rows):
                y, bits = (np.frombuffer(batch.column(n)[at].as_buffer(), k) for n, k in (("y", "<i4"), ("bits", "<i8")))
                found += [[((bits >> k) & 1)[y == c].sum() for c in (0, 1)] for k in range(problems)]
        yield pa.RecordBatch.from_arrays([pa.array([found.ravel().tolist()], pa.list_(pa.float64()))], names=["found"])

    rows = data.select("y", "bits").mapInArrow(run, "found array<double>").collect()
    return np.sum([np.array(r[0]).reshape(problems, 2) for r in rows] or [np.zeros((problems, 2))], axis=0)


NAMES = ("sizes", "used", "local", "v", "inverse", "y", "bits")
KINDS = ("<i8", "<i4", None, "<f8", "<f8", "<i4", "<i8")


def _local(used: int) -> str:
    """Kind of the numbers of a block's own features."""
    return "<u2" if used <= 1 << 16 else "<u4"


def _arrays(of) -> dict[str, np.ndarray]:
    """The arrays of a block from their bytes; ``used[local]`` are the features of its entries."""
    b = {n: np.frombuffer(of(n), k) for n, k in zip(NAMES, KINDS) if k}
    return b | {"local": np.frombuffer(of("local"), _local(len(b["used"])))}


def _opened(batch: pa.RecordBatch, at: int) -> dict[str, np.ndarray]:
    return _arrays(lambda n: batch.column(n)[at].as_buffer())


def _margins(b: dict, at: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Rows x problems: products of the rows with ``beta`` (problems x features, already scaled);
    ``at`` is ``local`` as numpy indexes with it."""
    sizes = b["sizes"]
    out = np.zeros((len(sizes), len(beta)))
    full = np.flatnonzero(sizes)
    if len(full):
        begin = (np.cumsum(sizes) - sizes)[full]
        for k, row in enumerate(beta):
            each = row[b["used"]].take(at, mode="clip")
            if len(b["v"]):
                each *= b["v"]
            out[full, k] = np.add.reduceat(each, begin)
    return out


def _by_column(b: dict, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each of the block's features the sum over its rows of their value by their number in ``rows``."""
    each = np.repeat(rows, b["sizes"])
    if len(b["v"]):
        each *= b["v"]
    return np.bincount(at, weights=each, minlength=len(b["used"]))


def _members(b: dict, chosen: np.ndarray) -> np.ndarray:
    """Places in ``chosen`` of the problems that a row of the block trains."""
    return np.flatnonzero((np.bitwise_or.reduce(b["bits"]) >> chosen) & 1)


def _summed(blocks: Blocks, k: int, shared, of_block) -> tuple[np.ndarray, np.ndarray]:
    """The head (3 x k) and the features x k that ``of_block`` adds to, over all blocks."""
    size = blocks.size

    def run(opened):
        given = shared.value
        gradient, head = np.zeros((k, size)), np.zeros((3, k))
        for b in opened:
            of_block(b, given, head, gradient)
        yield -1, head
        for j, a in enumerate(range(0, size, SLICE)):
            part = gradient[:, a : a + SLICE].T
            if part.any():
                yield j, np.ascontiguousarray(part)

    partial = blocks.opened().mapPartitions(run)
    if blocks.partitions * size * k * 8 > DIRECT_BYTES:

        def added(parts):
            sums: dict = {}
            for j, part in parts:
                if j in sums:
                    sums[j] += part
                else:
                    sums[j] = part.copy()
            yield from sums.items()

        # A task sends a slice once, so nothing is to be added before the slices meet.
        partial = partial.partitionBy(blocks.partitions, lambda j: j + 1).mapPartitions(added)
    head, total = np.zeros((3, k)), np.zeros((size, k))
    for j, part in partial.collect():
        if j < 0:
            head += part
        else:
            total[j * SLICE : j * SLICE + len(part)] += part
    shared.destroy()
    return head, total


def _class_weights(counts: np.ndarray) -> np.ndarray:
    return counts.sum(axis=1, keepdims=True) / (2 * np.maximum(counts, 1))


def _row_weights(b: dict, weights: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    inside = (b["bits"][:, None] >> chosen[None, :]) & 1
    return inside * np.where(b["y"][:, None] == 1, weights[None, :, 1], weights[None, :, 0])


def _rows(beta: np.ndarray, scale: np.ndarray | None) -> np.ndarray:
    """Scaled coefficients as problems x features."""
    return np.ascontiguousarray((beta if scale is None else beta * scale).T)


def _gradients(blocks: Blocks, problems: np.ndarray, beta: np.ndarray, intercept: np.ndarray) -> tuple[np.ndarray, ...]:
    """Loss, gradient, intercept gradient and curvature (of the intercept) of the summed loss of ``problems``."""
    scale = None if blocks.scale is None else blocks.scale[:, problems]
    shared = blocks.data.sparkSession.sparkContext.broadcast((_rows(beta, scale), intercept, _class_weights(blocks.counts[problems]), problems))

    def of_block(b, given, head, gradient):
        scaled, free, weights, chosen = given
        own = _members(b, chosen)
        if not len(own):
            return
        inverse = b["inverse"].reshape(len(b["sizes"]), -1)[:, chosen[own]]
        at, y, w = b["local"].astype(np.intp), b["y"][:, None], _row_weights(b, weights[own], chosen[own])
        m = _margins(b, at, scaled[own]) * inverse + free[own]
        signed = np.where(y == 1, -m, m)
        wrong = 1 / (1 + np.exp(-signed))
        residual = w * np.where(y == 1, -1.0, 1.0) * wrong
        head[:, own] += np.stack(((w * np.logaddexp(0, signed)).sum(axis=0), residual.sum(axis=0), (w * wrong * (1 - wrong)).sum(axis=0)))
        for k, rows in zip(own, (residual * inverse).T):
            gradient[k][b["used"]] += _by_column(b, at, rows)

    head, gradient = _summed(blocks, len(problems), shared, of_block)
    return head[0], gradient if scale is None else gradient * scale, head[1], head[2]


def _drawn(blocks: Blocks, problems: np.ndarray, beta: np.ndarray, intercept: np.ndarray, curved: np.ndarray, turn: int) -> list[list]:
    """For each of ``problems`` rows (indices, values, root of their weight), drawn by their
    share of its curvature at these coefficients; the sum of weight x square estimates the Hessian."""
    scale = None if blocks.scale is None else blocks.scale[:, problems]
    spark, k = blocks.data.sparkSession, len(problems)
    rate = np.full(k, SAMPLE_ROWS) / np.maximum(curved, 1e-300)
    shared = spark.sparkContext.broadcast((_rows(beta, scale), intercept, _class_weights(blocks.counts[problems]), problems, rate, scale))

    def run(task, opened):
        scaled, free, weights, chosen, rate, scale = shared.value
        r = np.random.default_rng((turn, task))
        for b in opened:
            mine = _members(b, chosen)
            if not len(mine):
                continue
            inverse = b["inverse"].reshape(len(b["sizes"]), -1)[:, chosen[mine]]
            p = 1 / (1 + np.exp(-(_margins(b, b["local"].astype(np.intp), scaled[mine]) * inverse + free[mine])))
            weight = _row_weights(b, weights[mine], chosen[mine]) * p * (1 - p)
            # The bound on all entries makes rows of many entries rarer, and heavier.
            most = SAMPLE_ENTRIES / len(chosen) / SAMPLE_ROWS / np.maximum(b["sizes"][:, None], 1)
            chance = np.minimum(1, weight * rate[mine] * np.minimum(1, most))
            begin = np.cumsum(b["sizes"]) - b["sizes"]
            for row, at in np.argwhere(r.random(chance.shape) < chance):
                own, j = slice(begin[row], begin[row] + b["sizes"][row]), int(mine[at])
                root, i = np.sqrt(weight[row, at] / chance[row, at]), b["used"][b["local"][own]]
                v = np.full(b["sizes"][row], root * inverse[row, at]) * (b["v"][own] if len(b["v"]) else 1.0)
                yield j, (i, v if scale is None else v * scale[i, j], root)

    found: list[list] = [[] for _ in range(k)]
    for j, row in blocks.opened().mapPartitionsWithIndex(run).collect():
        found[j].append(row)
    shared.destroy()
    return found


def _inverse(rows: list, size: int, c: float, n: float):
    """Product with the inverse of the mean Hessian that ``rows`` estimate: the penalty and
    the squares of the rows, whose products with each other are all that is factored."""
    i = np.concatenate([r[0] for r in rows] or [np.zeros(0, dtype=np.int32)])
    v = np.concatenate([r[1] for r in rows] or [np.zeros(0)])
    root, sizes = np.array([r[2] for r in rows]), np.array([len(r[0]) for r in rows], dtype=int)
    owner = np.repeat(np.arange(len(rows)), sizes)
    free = 1e-6 * n
    products = np.eye(len(rows)) + np.outer(root, root) / free
    # Columns of one row add to the diagonal alone.
    uses = np.bincount(i, minlength=size)
    times = uses[i]
    products[np.diag_indices(len(rows))] += c * np.bincount(owner, weights=v * v * (times == 1), minlength=len(rows))
    for u in range(2, FEW):
        own = np.flatnonzero(times == u)
        own = own[np.argsort(i[own], kind="stable")].reshape(-1, u)
        for a in range(0, len(own), PAIRS // (u * u)):
            o, w = owner[own[a : a + PAIRS // (u * u)]], v[own[a : a + PAIRS // (u * u)]]
            pairs, both = o[:, :, None] * len(rows) + o[:, None, :], w[:, :, None] * w[:, None, :]
            products += c * np.bincount(pairs.ravel(), weights=both.ravel(), minlength=len(rows) ** 2).reshape(len(rows), -1)
    place = np.cumsum(uses >= FEW) - 1
    often = np.flatnonzero(times >= FEW)
    for a in range(0, int((uses >= FEW).sum()), COLUMNS):
        own = often[(place[i[often]] >= a) & (place[i[often]] < a + COLUMNS)]
        part = np.zeros((len(rows), COLUMNS), dtype=np.float32)
        part[owner[own], place[i[own]] - a] = v[own]
        products += c * (part @ part.T)
    lower = np.linalg.inv(np.linalg.cholesky(products))

    def product(q: np.ndarray) -> np.ndarray:
        out = np.append(c * q[:-1], q[-1] / free)
        z = lower.T @ (lower @ (np.bincount(owner, weights=out[i] * v, minlength=len(rows)) + root * out[-1]))
        out[:-1] -= c * np.bincount(i, weights=z[owner] * v, minlength=size)
        out[-1] -= root @ z / free
        return n * out

    return product


@dataclass
class Fitted:
    """Coefficients (features x problems, of the unscaled features' scale), intercepts,
    iterations used and the largest gradient component left, per problem."""

    coefficients: np.ndarray
    intercepts: np.ndarray
    iterations: np.ndarray
    left: np.ndarray


def batches(problems: int, size: int) -> list[np.ndarray]:
    """Problems in groups whose solver state, with histories of ``GOOD_HISTORY`` steps, stays
    below ``STATE_BYTES``. Neighbours mostly share their rows, and a group reads its own alone."""
    each = max(1, STATE_BYTES // (8 * size * (2 * GOOD_HISTORY + 4)))
    return [np.arange(a, min(problems, a + each)) for a in range(0, problems, each)]


def steps_held(problems: int, size: int) -> int:
    """Steps that a problem's history holds in a group of so many problems."""
    vectors = STATE_BYTES // (8 * size * max(1, problems))
    return int(np.clip((vectors - 4) // 2, HISTORY, LONGEST_HISTORY))


def fit(blocks: Blocks, c: float | np.ndarray = 1.0, max_iter: int = 1000, tolerance: float = TOLERANCE, path: list | None = None) -> Fitted:
    """Fits all problems; ``c`` may differ by problem. ``path`` collects (iteration,
    coefficients, intercepts) if given."""
    n = len(blocks.counts)
    cs = np.broadcast_to(np.asarray(c, dtype=float), (n,))
    parts = []
    for group in batches(n, blocks.size):
        # Rows that train none of the group are left out.
        held = blocks.opened().filter(lambda b, group=group: len(_members(b, group)) > 0).persist(StorageLevel.MEMORY_AND_DISK)
        tasks = max(1, min(blocks.partitions, held.ctx.defaultParallelism))
        try:
            parts.append(_fit(replace(blocks, held=held.coalesce(tasks), partitions=tasks), group, cs[group], max_iter, tolerance, path))
        finally:
            held.unpersist()
    return Fitted(*[np.concatenate(x, axis=-1) for x in zip(*parts)])


def _fit(blocks: Blocks, problems: np.ndarray, c: np.ndarray, max_iter: int, tolerance: float, path: list | None):
    n, size = blocks.counts[problems].sum(axis=1), blocks.size
    n = np.maximum(n, 1)

    def value(x: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean objective, gradient (the last row is free) and curvature of the problems ``which``."""
        loss, gradient, free, curved = _gradients(blocks, problems[which], x[:-1], x[-1])
        f = (loss + (x[:-1] ** 2).sum(axis=0) / (2 * c[which])) / n[which]
        return f, np.vstack((gradient + x[:-1] / c[which], free)) / n[which], curved

    k, held = len(problems), steps_held(len(problems), size)
    x = np.zeros((size + 1, k))
    f, g, curved = value(x, np.arange(k))
    inverses: list = [None] * k
    goal = tolerance * np.maximum(1e-3, np.abs(g).max(axis=0))
    used, history = np.zeros(k, dtype=int), [[] for _ in range(k)]
    active = np.flatnonzero(np.abs(g).max(axis=0) > goal)
    for turn in range(1, max_iter + 1):
        if not len(active):
            break
        if turn % REFRESH == 1 or turn == 4:
            for j, rows in zip(active, _drawn(blocks, problems[active], x[:-1, active], x[-1, active], curved[active], turn)):
                inverses[j], history[j] = _inverse(rows, size, c[j], n[j]), history[j][-KEPT_STEPS:]
        direction = np.stack([_two_loops(g[:, j], history[j], inverses[j]) for j in active], axis=1)
        slope = (direction * g[:, active]).sum(axis=0)
        for place in np.flatnonzero(slope >= 0):
            j = active[place]
            direction[:, place] = -inverses[j](g[:, j])
            slope[place] = direction[:, place] @ g[:, j]
        step = np.ones(len(active))
        todo = np.arange(len(active))
        for _ in range(30):
            at = active[todo]
            new = x[:, at] + step[todo] * direction[:, todo]
            f_new, g_new, curved_new = value(new, at)
            # Near the optimum values differ by rounding only; the gradient decides there.
            fine = (f_new <= f[at] + 1e-4 * step[todo] * slope[todo]) | ((f_new <= f[at] + 1e-12 * np.abs(f[at])) & (np.abs(g_new).max(axis=0) < np.abs(g[:, at]).max(axis=0)))
            for place in np.flatnonzero(fine):
                j = at[place]
                s, y = new[:, place] - x[:, j], g_new[:, place] - g[:, j]
                if s @ y > 1e-14 * (y @ y):
                    history[j] = [*history[j][-(held - 1) :], (s, y, 1 / (s @ y))]
                x[:, j], f[j], g[:, j], curved[j] = new[:, place], f_new[place], g_new[:, place], curved_new[place]
                used[j] = turn
            todo = todo[~fine]
            if not len(todo):
                break
            step[todo] /= 2
        stuck = active[todo]
        if path is not None:
            path.append((turn, problems.copy(), x.copy()))
        active = np.array([j for j in active if np.abs(g[:, j]).max() > goal[j] and j not in stuck], dtype=int)
    return x[:-1], x[-1], used, np.abs(g).max(axis=0)


def _two_loops(g: np.ndarray, history: list, inverse) -> np.ndarray:
    """The L-BFGS direction, from the product ``inverse`` with an inverse Hessian."""
    q, alphas = -g, []
    for s, y, rho in reversed(history):
        a = rho * (s @ q)
        q = q - a * y
        alphas.append(a)
    q = inverse(q)
    for (s, y, rho), a in zip(history, reversed(alphas)):
        q = q + s * (a - rho * (y @ q))
    return q


def scores(blocks: Blocks, coefficients: np.ndarray, intercepts: np.ndarray) -> DataFrame:
    """id, problem, p_hate of every row for every problem, in one pass."""
    shared = blocks.data.sparkSession.sparkContext.broadcast((_rows(coefficients, blocks.scale), intercepts))

    def run(batches):
        scaled, free = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                b = _opened(batch, at)
                m = _margins(b, b["local"].astype(np.intp), scaled) * b["inverse"].reshape(len(b["sizes"]), -1) + free
                p = 1 / (1 + np.exp(-m))
                ids = np.repeat(np.asarray(batch.column("ids")[at].values), p.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(p.shape[1], dtype=np.int32), len(p))), pa.array(p.ravel())], names=["id", "problem", "p_hate"])

    return blocks.data.mapInArrow(run, "id long, problem int, p_hate double")
