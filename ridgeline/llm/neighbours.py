"""The k most similar vectors of every vector, by a block join with bounds.

Rows of a model are dealt to blocks of similar rows (centres from a sample of
them say where a row goes, never what is compared). In its block a row meets the
rows near it first: small groups are multiplied as int8 codes, whose products
are whole numbers below 2**24, so single-precision BLAS gives them exactly; with
the norms of what the scaling lost, every product bounds the cosine from both
sides, survivors are recomputed in double precision from the vectors as given,
and the k-th best is a lower bound for the row.

A block is kept as balls around some of its rows, with their radius. By the
triangle inequality of angles a row need not be compared with a ball that lies
farther away than its k-th best; all other pairs are compared in single
precision, with a margin for its error, and recomputed in double precision. So
the result is exact: recall 1 against brute force, whatever the data. Rows
without a ball, and rows whose bound keeps most of a block, are compared with the
whole block.

Where the products cannot tell rows apart (bursts of nearly equal or parallel
vectors), most pairs of a tile would survive. A tile of which more than
``CROWDED`` pairs a row do is computed in double precision at once and keeps the
k best of each of its rows, so that memory stays bounded whatever the data.

The vectors are shuffled twice, by key and by block, whatever their number:
blocks lie in the shared folder once and are read there by the task of each pair
of blocks, which returns for a row only keys that reach its bound. The work grows
with n**2 only for balls, and for rows that have no k rows near them in their
block. Of exactly equal vectors, the k + 1 smallest keys are compared (any k best
keys lie among them); the other keys take the list of the first.

Defined cases: of several rows of a key the latest counts; a null, short, NaN or
all-zero vector takes no part; vectors of different length are never compared; a
model with one vector gives no pair; ties go to the smaller key; cosines are
compared rounded to ``decimals``.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import cut, remove, shared_folder

TILE = 2048
#: Pairs a row that may survive in a tile before it is computed at once.
CROWDED = 32
#: Rows and columns of a single-precision product that stay in the cache.
STEP = 1024
#: Least cosine between a ball's centre and its rows.
BALL = 0.75
#: Bytes of vectors in a block, and blocks that a task compares with one block.
BLOCK_BYTES, AT_ONCE = 1 << 23, 2
#: Classes of equal vectors with more than k keys that are broadcast; more are joined.
BROADCAST = 500_000


def usable(rows: DataFrame) -> DataFrame:
    """content_hash, model, vector of the latest row of each key whose vector can be compared."""
    rows = rows.select("content_hash", "made_at", "model", "dims", "vector").filter("content_hash is not null")
    last = rows.groupBy("content_hash").agg(F.max(F.struct("made_at", "model", "dims", "vector")).alias("r")).select("content_hash", "r.model", "r.dims", "r.vector")
    good = F.col("vector").isNotNull() & (F.size("vector") == F.col("dims")) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    return last.filter(F.coalesce(good, F.lit(False)) & F.col("model").isNotNull()).select("content_hash", "model", "vector")


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (in float32 for BLAS), their scale, and the norm of what is lost."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes.astype(np.float32), scale.astype(np.float32), lost.astype(np.float32)


def _keep_best(kth: np.ndarray, rows: np.ndarray, lower: np.ndarray, k: int) -> None:
    """Raises the k best lower bounds of ``rows`` (one row of ``lower`` each) in place."""
    part = lower if lower.shape[1] <= k else np.partition(lower, lower.shape[1] - k, axis=1)[:, -k:]
    both = np.concatenate([kth[rows], part], axis=1)
    kth[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]


def _best_of_tile(cos: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are among the k best of their row, ties to the first columns."""
    if cos.shape[1] <= k:
        return np.ones(cos.shape, bool)
    least = np.partition(cos, cos.shape[1] - k, axis=1)[:, -k, None]
    above, tie = cos > least, cos == least
    return above | (tie & (np.cumsum(tie, axis=1) <= k - above.sum(1, keepdims=True)))


def best_pairs(a: np.ndarray, b: np.ndarray | None, k: int, decimals: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right, cosine of the pairs of rows of ``a`` and ``b`` (of ``a`` with itself, left < right, if ``b`` is None) that may be among the k best of either row."""
    same = b is None
    b = a if same else b
    length = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(1))
    la, lb = length(a), length(b)
    qa, sa, ea = quantise(a / la[:, None])
    qb, sb, eb = (qa, sa, ea) if same else quantise(b / lb[:, None])
    # |cos - product| <= |lost_a| * |b| + |coded_a| * |lost_b|, and a little for single precision
    low_a = np.full((len(a), k), -2, np.float32)
    low_b = low_a if same else np.full((len(b), k), -2, np.float32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(a), TILE):
        ra = slice(i, i + TILE)
        for j in range(i if same else 0, len(b), TILE):
            rb = slice(j, j + TILE)
            cos = (qa[ra] @ qb[rb].T) * sa[ra, None] * sb[None, rb]
            slack = ea[ra, None] + (1 + ea[ra, None]) * eb[None, rb] + np.float32(1e-5)
            if same and i == j:
                cos[np.tril_indices(len(cos), 0, cos.shape[1])] = -4
            cos += slack  # upper bounds from here on
            open_a = cos >= low_a[ra].min(1)[:, None]
            open_b = cos >= low_b[rb].min(1)[None, :]
            lower = lambda rows, cols: cos[rows][:, cols] - 2 * slack[rows][:, cols]  # noqa: B023, E731
            hit_a, hit_b = np.flatnonzero(open_a.any(1)), np.flatnonzero(open_b.any(0))
            if len(hit_a):
                _keep_best(low_a, hit_a + i, lower(hit_a, slice(None)), k)
            if len(hit_b):
                _keep_best(low_b, hit_b + j, lower(slice(None), hit_b).T, k)
            good = (cos >= low_a[ra].min(1)[:, None]) | (cos >= low_b[rb].min(1)[None, :])
            if good.sum() > CROWDED * min(cos.shape):
                full = np.round((a[ra].astype(np.float64) @ b[rb].astype(np.float64).T) / (la[ra, None] * lb[None, rb]), decimals)
                if same and i == j:
                    np.fill_diagonal(full, -4)
                good = _best_of_tile(full, k) | _best_of_tile(full.T, k).T
                if same and i == j:
                    good = np.triu(good | good.T, 1)
            x, y = np.nonzero(good)
            found.append(((x + i).astype(np.int32), (y + j).astype(np.int32), cos[x, y]))
    left, right, upper = (np.concatenate(p) for p in zip(*found))
    alive = (upper >= low_a.min(1)[left]) | (upper >= low_b.min(1)[right])
    alive &= upper > -2
    left, right = left[alive], right[alive]
    exact = np.empty(len(left))
    for i in range(0, len(left), 65536):
        x, y = left[i : i + 65536], right[i : i + 65536]
        exact[i : i + 65536] = np.einsum("ij,ij->i", a[x].astype(np.float64), b[y].astype(np.float64)) / (la[x] * lb[y])
    return left, right, np.round(exact, decimals)


def _top(owner: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each owner, by cosine, then by the other's number."""
    order = np.lexsort((other, -cos, owner))
    owner, other, cos = owner[order], other[order], cos[order]
    new = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
    keep = place < k
    return owner[keep], other[keep], cos[keep]


def _lists(owner: np.ndarray, cos: np.ndarray, keys: pa.Array, near: pa.Array) -> pa.RecordBatch:
    """cid, near of rows sorted by owner."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    pair = pa.StructArray.from_arrays([pa.array(cos, pa.float64()), near], ["cos", "cid"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(owner)].astype(np.int32)), pair)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(owner[first])), lists], ["cid", "near"])


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in single precision, and the lengths."""
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    return np.divide(vectors, length[:, None], out=np.empty(vectors.shape, np.float32), casting="unsafe"), length


def _margin(dims: int) -> float:
    """More than the error of a single-precision product of vectors of length 1."""
    return (dims + 16) * 2.0**-23


def _balls(unit: np.ndarray, at_once: int = 256) -> list[tuple[int, np.ndarray]]:
    """centre, rows of groups of two rows and more within ``BALL`` of a centre; each row is in one at most."""
    left, found = np.arange(len(unit)), []
    while len(left) > 1:
        pick = left[np.unique(np.linspace(0, len(left) - 1, at_once).astype(int))]
        close = unit[pick] @ unit[pick].T >= BALL
        taken = np.zeros(len(pick), bool)
        for x in range(len(pick)):  # no two centres in one ball
            taken[x] = not (close[x, :x] & taken[:x]).any()
        pick = pick[taken]
        cos = unit[left] @ unit[pick].T
        best = cos.argmax(1)
        best[np.searchsorted(left, pick)] = np.arange(len(pick))
        inside = cos[np.arange(len(left)), best] >= BALL
        inside[np.searchsorted(left, pick)] = True
        order = np.argsort(best[inside], kind="stable")
        rows, of = left[inside][order], best[inside][order]
        found += [(pick[x], own) for x, own in zip(np.unique(of), np.split(rows, np.flatnonzero(np.diff(of)) + 1)) if len(own) > 1]
        left = left[~inside]
    return found


class Block:
    """Rows of one model with their lengths, balls and the k best of each row among them.

    Rows are numbered as they lie: by ball, then the rows without one; ``rank`` is their place by key. ``owner``, ``other``
    and ``cos`` are the k best (``other`` by rank), ``low`` the k-th best cosine, -2 below k rows.
    """

    def __init__(self, keys: pa.Array, vectors: np.ndarray, k: int, decimals: int, few: int = 64) -> None:
        """``keys`` sorted."""
        unit, _ = _unit(vectors)
        balls = _balls(unit) if len(keys) > few else []
        loose = np.ones(len(keys), bool)
        for _, own in balls:
            loose[own] = False
        self.keys, self.rank = keys, np.concatenate([*(own for _, own in balls), np.flatnonzero(loose)]).astype(np.int32)
        self.vectors, unit = vectors[self.rank], unit[self.rank]
        self.ends = np.cumsum([0, *(len(own) for _, own in balls)])
        where = np.argsort(self.rank)
        self.centre = where[[c for c, _ in balls]].astype(np.int32) if balls else np.zeros(0, np.int32)
        self.reach = np.array([(unit[a:b] @ unit[c]).min() for a, b, c in zip(self.ends, self.ends[1:], self.centre)], np.float64) - _margin(vectors.shape[1])
        self._set(*self._near_rows(k, decimals), k)
        if balls:
            # of the centres, too, k are rows as good as any; a centre's own product does not count
            if len(balls) > k:
                for i in range(0, len(unit), STEP):
                    cos = unit[i : i + STEP] @ unit[self.centre].T
                    mine = np.flatnonzero((self.centre >= i) & (self.centre < i + STEP))
                    cos[self.centre[mine] - i, mine] = -2
                    self.low[i : i + STEP] = np.maximum(self.low[i : i + STEP], np.partition(cos, len(balls) - k, axis=1)[:, -k] - _margin(vectors.shape[1]))
            self._set(*scan(self, self, k, decimals), k)

    def _near_rows(self, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each row in its ball, or among the rows without one."""
        found = []
        for a, b in zip(self.ends, [*self.ends[1:], len(self.keys)]):
            if b - a > 1:
                left, right, cos = best_pairs(self.vectors[a:b], None, k, decimals)
                left, right = left + a, right + a
                found.append(_top(np.r_[left, right], self.rank[np.r_[right, left]], np.r_[cos, cos], k))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def _set(self, owner: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> None:
        self.owner, self.other, self.cos, self.low = owner.astype(np.int32), other.astype(np.int32), cos, _kth(owner, cos, len(self.keys), k)

    def lists(self) -> pa.RecordBatch:
        return _lists(self.owner, self.cos, self.keys.take(pa.array(self.rank)), self.keys.take(pa.array(self.other)))


def _kth(owner: np.ndarray, cos: np.ndarray, rows: int, k: int) -> np.ndarray:
    """The smallest of the k best cosines of each row, -2 of rows that have fewer. Sorted by owner, best first."""
    low = np.full(rows, -2.0)
    last = np.flatnonzero(owner[k - 1 :] == owner[: max(0, len(owner) - k + 1)]) + k - 1
    low[owner[last]] = cos[last]
    return low


def scan(a: Block, b: Block, k: int, decimals: int, flush: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner (row of ``a``), other (rank in ``b``), cosine: the k best rows of ``b`` of each row of ``a``, but those below the row's bound."""
    (ua, la), (ub, lb) = _unit(a.vectors), _unit(b.vectors)
    margin, low = _margin(ua.shape[1]), a.low.copy()
    best, waiting, held = (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), [], 0

    def merge() -> None:
        nonlocal best, waiting, held
        best = _top(*(np.concatenate(x) for x in zip(best, *waiting)), k)
        np.maximum(low, _kth(best[0], best[2], len(low), k), out=low)
        waiting, held = [], 0

    def compare(rows: np.ndarray, start: int, end: int) -> None:
        nonlocal held
        for i in range(0, len(rows), STEP):
            for j in range(start, end, STEP):
                r, c = rows[i : i + STEP], slice(j, min(j + STEP, end))
                good = ua[r] @ ub[c].T >= (low[r] - margin).astype(np.float32)[:, None]
                if a is b:
                    mine = np.flatnonzero((r >= c.start) & (r < c.stop))
                    good[mine, r[mine] - c.start] = False
                if crowded := np.count_nonzero(good) > CROWDED * len(r):
                    # columns by key, as ties go to the first
                    by_key = np.argsort(b.rank[c], kind="stable") + c.start
                    full = np.round((a.vectors[r].astype(np.float64) @ b.vectors[by_key].astype(np.float64).T) / (la[r, None] * lb[None, by_key]), decimals)
                    if a is b:
                        full[r[:, None] == by_key[None, :]] = -4
                    x, y = np.nonzero(_best_of_tile(full, k) & (full > -4))
                    found = r[x], b.rank[by_key[y]], full[x, y]
                else:
                    x, y = np.divmod(np.flatnonzero(good), good.shape[1])
                    row, col, cos = r[x], y + c.start, np.empty(len(x))
                    for n in range(0, len(x), 65536):
                        p, q = row[n : n + 65536], col[n : n + 65536]
                        cos[n : n + 65536] = np.einsum("ij,ij->i", a.vectors[p].astype(np.float64), b.vectors[q].astype(np.float64)) / (la[p] * lb[q])
                    cos = np.round(cos, decimals)
                    keep = cos >= low[row] - 10.0**-decimals
                    found = row[keep], b.rank[col[keep]], cos[keep]
                if len(found[0]):
                    waiting.append(found)
                    held += len(found[0])
                    if held > flush or crowded:
                        merge()

    sizes = np.diff(b.ends)
    # the cosine of the sum of two angles as a product with two more columns
    balls = np.c_[ub[b.centre], b.reach, np.sqrt(np.maximum(0, 1 - b.reach**2))].astype(np.float32).T
    for i in range(0, len(ua), STEP):
        rows = np.arange(i, min(i + STEP, len(ua)))
        if not len(sizes):
            compare(rows, 0, len(ub))
            continue
        bound = np.clip(low[rows] - margin, -1, 1)
        wide = bound < -0.6  # together with a ball's angle this may be half a turn
        angle = np.c_[np.where(wide, 4, -bound), np.where(wide, 0, np.sqrt(1 - bound**2))]
        near = np.c_[ua[rows], angle].astype(np.float32) @ balls >= -4 * margin - 1e-5
        visits = near @ sizes.astype(np.float32)
        whole = visits > 0.25 * len(ub)
        if whole.any():
            compare(rows[whole], 0, len(ub))
        rows, near = rows[~whole], near[~whole]
        for ball in np.flatnonzero(near.any(0)):
            compare(rows[near[:, ball]], b.ends[ball], b.ends[ball + 1])
        if len(rows) and b.ends[-1] < len(ub):
            compare(rows, b.ends[-1], len(ub))
    merge()
    return best


NEAR = "cid string, near array<struct<cos:double,cid:string>>"


def _matrix(vectors: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float32)


def _pack(batches: Iterator[pa.RecordBatch], k: int, decimals: int) -> Iterator[pa.RecordBatch]:
    """m, b, block of the models, or of the part of a model, in one partition."""
    batches = [x for x in batches if x.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    del batches
    place = np.array(table["content_hash"].to_pylist(), dtype=object).argsort(kind="stable")
    table = table.take(pa.array(place))
    model, dims = (np.unique(np.array(table[x].to_pylist()), return_inverse=True)[1] for x in ("model", "dims"))
    of = model * (dims.max() + 1) + dims
    order = np.argsort(of, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        part = table.take(pa.array(rows)) if len(rows) < len(of) else table
        block = Block(part["content_hash"].combine_chunks(), _matrix(part["vector"], part["dims"][0].as_py()), k, decimals)
        yield pa.RecordBatch.from_pydict({"m": pa.array([part["m"][0].as_py()], pa.int32()), "b": pa.array([part["b"][0].as_py()], pa.int32()), "block": pa.array([pickle.dumps(block, protocol=5)], pa.binary())})


def _across(batches: Iterator[pa.RecordBatch], k: int, decimals: int) -> Iterator[pa.RecordBatch]:
    """cid, near of the rows of a block that have near rows in those that follow: a row with ``block`` begins, ``block2`` follow."""
    a, held = None, []

    def lists() -> Iterator[pa.RecordBatch]:
        if held:
            owner, cos = (np.concatenate([x[n] for x in held]) for n in (0, 1))
            order = np.argsort(owner, kind="stable")
            yield _lists(owner[order], cos[order], a.keys.take(pa.array(a.rank)), pa.concat_arrays([x[2] for x in held]).take(pa.array(order)))

    for batch in batches:
        for first, second in zip(batch["block"], batch["block2"]):
            if first.is_valid:
                yield from lists()
                a, held = pickle.loads(first.as_buffer()), []
            if second.is_valid:
                b = pickle.loads(second.as_buffer())
                owner, other, cos = scan(a, b, k, decimals)
                held.append((owner, cos, b.keys.take(pa.array(other))))
                # what is found raises the bounds of the blocks that follow
                owner, cos = (np.concatenate([x[n] for x in held]) for n in (0, 1))
                order = np.lexsort((-cos, owner))
                np.maximum(a.low, _kth(owner[order], cos[order], len(a.low), k), out=a.low)
                held = [(o[keep], c[keep], keys.filter(pa.array(keep))) for o, c, keys in held for keep in [c >= a.low[o] - 10.0**-decimals]]
    yield from lists()


def centres(vectors: np.ndarray, blocks: int, cells: int = 4, rounds: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of about ``cells`` times ``blocks`` cells of a sample, like ones beside each other; the first block of each and
    over how many it is dealt, so that blocks get like numbers of rows."""
    unit, _ = _unit(vectors)
    count = max(1, min(cells * blocks, len(unit) // 8))
    middle = unit[np.linspace(0, len(unit) - 1, count).astype(int)] if len(unit) else np.zeros((1, vectors.shape[1]), np.float32)
    share = np.ones(count)
    for _ in range(rounds if len(unit) else 0):
        of = (unit @ middle.T).argmax(1)
        total = np.zeros_like(middle)
        np.add.at(total, of, unit)
        share, length = np.bincount(of, minlength=count).astype(float), np.linalg.norm(total, axis=1)
        middle = np.where((length > 0)[:, None], total / np.maximum(length, 1e-30)[:, None], middle).astype(np.float32)
    share *= blocks / max(1, share.sum())
    like, left, chain = middle @ middle.T, np.ones(count, bool), [0]
    for _ in range(count - 1):
        left[chain[-1]] = False
        chain.append(int(np.where(left, like[chain[-1]], -9).argmax()))
    first, parts, block, full = np.zeros(count, int), np.ones(count, int), 0, 0.0
    for c in chain:
        if full and full + share[c] > 1.05:
            block, full = block + 1, 0.0
        first[c], parts[c] = block, max(1, math.ceil(share[c] - 0.1))
        full += share[c]
        if parts[c] > 1:
            block, full = block + parts[c], 0.0
    return middle, first, parts


def nearest(rows: DataFrame, k: int = 5, *, decimals: int = 9, group_rows: int = 32_768, spread: int = 6, small: int = 4096) -> DataFrame:
    """content_hash, near: its k most similar keys of the same model, as array of (cos, content_hash), best first. ``rows`` as of :func:`usable`.

    Blocks: n / group_rows (fewer rows of long vectors), but at least ``spread`` once a model has ``spread * small`` rows, so that all cores take part.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "vectors")
    rows.select("content_hash", "model", F.size("vector").alias("dims"), "vector", F.xxhash64("model", "vector").alias("_h"), F.xxhash64(F.lit(1), "vector", "model").alias("_h2")).write.option("parquet.enable.dictionary", "false").parquet(folder)
    rows = spark.read.parquet(folder)

    # of equal vectors only the k + 1 smallest keys can be among the k best of any row
    thin = rows.select("content_hash", "_h", "_h2")
    ranked = thin.withColumn("_n", F.row_number().over(Window.partitionBy("_h", "_h2").orderBy("content_hash"))).filter(F.col("_n") <= k + 1)
    edges = cut(ranked.groupBy("_h", "_h2").agg(F.min("content_hash").alias("first"), F.max("content_hash").alias("edge"), F.count("*").alias("_c")).filter(F.col("_c") > k).drop("_c"))
    spare = None
    if crowds := edges.count():
        edges = F.broadcast(edges) if crowds <= BROADCAST else edges
        spare = cut(thin.join(edges, ["_h", "_h2"]).filter("content_hash > edge").select("content_hash", "first"))
        rows = rows.join(edges, ["_h", "_h2"], "left").filter("edge is null or content_hash <= edge").drop("first", "edge")

    most = F.least(F.lit(group_rows), F.greatest(F.lit(1), F.floor(BLOCK_BYTES / (4 * F.col("dims")))))
    blocks = F.greatest(F.ceil(F.col("count") / most), F.least(F.lit(spread), F.ceil(F.col("count") / small))).cast("int")
    sizes = cut(rows.groupBy("model", "dims").count().withColumn("blocks", blocks))
    alone = sizes.filter("blocks = 1").agg(F.sum("count")).first()[0] or 0
    large, start, index = sizes.filter("blocks > 1").orderBy("model", "dims").collect(), 0, {}
    if large:
        rate = spark.createDataFrame([(r.model, r.dims, min(1.0, 160 * r.blocks / r["count"])) for r in large], "model string, dims int, rate double")
        sample = rows.join(F.broadcast(rate), ["model", "dims"]).filter(F.pmod("_h2", F.lit(1_000_000)) < F.col("rate") * 1_000_000).select("model", "dims", "vector").toArrow()
        models, lengths = np.array(sample["model"].to_pylist(), dtype=object), sample["dims"].to_numpy()
        for m, r in enumerate(large):
            middle, first, parts = centres(_matrix(sample["vector"].take(pa.array(np.flatnonzero((models == r.model) & (lengths == r.dims)))), r.dims), r.blocks)
            index[r.model, r.dims] = m, middle, first + start, parts
            start += int((first + parts).max())
    bins = max(1, min(spread, math.ceil(alone / small)), math.ceil(alone / group_rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, m = batch["_s"].to_numpy().astype(np.int32), np.full(batch.num_rows, -1, np.int32)
            models, lengths = np.array(batch["model"].to_pylist(), dtype=object), batch["dims"].to_numpy()
            for (model, dims), (n, middle, first, parts) in index.items() if batch.num_rows else ():
                if len(own := np.flatnonzero((models == model) & (lengths == dims))):
                    of = (_unit(_matrix(batch["vector"].take(pa.array(own)), dims))[0] @ middle.T).argmax(1)
                    b[own], m[own] = first[of] + batch["_h"].to_numpy()[own] % parts[of], n
            yield pa.RecordBatch.from_pydict({"b": pa.array(b), "m": pa.array(m)} | {c: batch[c] for c in ("content_hash", "model", "dims", "vector")})

    dealt = rows.withColumn("_s", F.pmod(F.xxhash64("model", "dims"), F.lit(bins)).cast("int") + start).mapInArrow(deal, "b int, m int, content_hash string, model string, dims int, vector array<float>")
    packed = cut(dealt.repartitionById(start + bins, "b").mapInArrow(lambda t: _pack(t, k, decimals), "m int, b int, block binary"))
    remove(spark, folder)

    near = packed.mapInArrow(lambda t: (pickle.loads(x.as_buffer()).lists() for batch in t for x in batch["block"]), NEAR)
    if large:
        left = packed.filter("m >= 0")
        right = left.coalesce(math.ceil((start + bins) / AT_ONCE)).select(F.col("m").alias("m2"), F.col("b").alias("b2"), F.col("block").alias("block2"), (F.monotonically_increasing_id() % (1 << 33) == 0).alias("first"))
        # no shuffle: each task reads its blocks in the shared folder, and is given the left one once
        other = (F.col("m") == F.col("m2")) & (F.col("b") != F.col("b2"))
        both = left.join(right.hint("shuffle_replicate_nl"), F.col("first") | other).select(F.when(F.col("first"), F.col("block")).alias("block"), F.when(other, F.col("block2")).alias("block2"))
        near = near.unionByName(both.mapInArrow(lambda t: _across(t, k, decimals), NEAR))
    best = lambda near: F.array_sort(near, lambda x, y: F.when(x["cos"] > y["cos"], -1).when(x["cos"] < y["cos"], 1).when(x["cid"] < y["cid"], -1).when(x["cid"] > y["cid"], 1).otherwise(0))
    merged = near.groupBy("cid").agg(F.flatten(F.collect_list("near")).alias("near")).select(F.col("cid").alias("content_hash"), F.slice(best(F.col("near")), 1, k).alias("near"))
    if spare is None:
        return merged
    # the other keys of a vector: the list of its first key, and that key
    firsts = cut(merged)
    own = F.array(F.struct(F.lit(1.0).alias("cos"), F.col("first").alias("cid")))
    others = spare.join(firsts.withColumnRenamed("content_hash", "first"), "first").select("content_hash", F.slice(best(F.concat("near", own)), 1, k).alias("near"))
    return firsts.unionByName(others)


def pairs(nearest_keys: DataFrame) -> DataFrame:
    """hash_a < hash_b of every pair in which one is among the other's nearest."""
    p = nearest_keys.select("content_hash", F.explode("near.cid").alias("other"))
    return p.select(F.least("content_hash", "other").alias("hash_a"), F.greatest("content_hash", "other").alias("hash_b")).distinct()
