import numpy as np
import pyarrow as pa
import pytest

from ridgeline.llm import neighbours as N

SCHEMA = "content_hash string, made_at string, model string, dims int, vector array<float>, cid string"


def brute(rows, k):
    last = {}
    for h, at, m, d, v, _ in rows:
        if h is not None and (h not in last or at > last[h][0]):
            last[h] = (at, m, d, v)
    ok = {h: (m, np.array(v, dtype=np.float32).astype(float)) for h, (_, m, d, v) in last.items() if v is not None and len(v) == d and not np.isnan(np.array(v, dtype=float)).any() and np.any(np.array(v) != 0)}
    out = set()
    for h, (m, v) in ok.items():
        near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), g) for g, (n, w) in ok.items() if g != h and n == m)
        out |= {tuple(sorted((h, g))) for _, g in near[:k]}
    return out


@pytest.mark.parametrize("spread", [1, 3])
def test_exact_with_dirt(spark, spread):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(150):
        v = (centres[i % 6] + rng.normal(scale=0.2, size=16)) * rng.choice([0.1, 1, 30])
        rows.append((f"{rng.integers(1e12):012d}", "2024", "m", 16, [float(x) for x in v], "clash"))
    hot = [float(x) for x in centres[0]]
    rows += [(f"hot{i:03d}", "2024", "m", 16, hot, "x") for i in range(40)]  # one vector under many keys
    rows += [(f"hot{i:03d}b", "2024", "m", 16, [2 * x for x in hot], "x") for i in range(8)]
    rows += [(rows[0][0], "2023", "m", 16, [1.0] * 16, "x"), rows[1]]
    rows += [("null", "2024", "m", 16, None, "x"), ("short", "2024", "m", 16, [1.0], "x"), ("zero", "2024", "m", 16, [0.0] * 16, "x"), ("nan", "2024", "m", 16, [float("nan")] * 16, "x"), (None, "2024", "m", 16, hot, "x")]
    rows += [(f"other{i}", "2024", "n", 4, [float(x) for x in rng.normal(size=4)], "x") for i in range(3)] + [("single", "2024", "o", 4, [1.0, 0.0, 0.0, 0.0], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.hash_a, r.hash_b) for r in N.pairs(N.nearest(N.usable(df), 5, spread=spread, small=40)).collect()}
    assert got == brute(rows, 5)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.pairs(N.nearest(N.usable(df), 5)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(50, 8))
    a /= np.linalg.norm(a, axis=1)[:, None]
    q, s, e = N.quantise(a)
    product = (q @ q.T) * s[:, None] * s[None, :]
    slack = e[:, None] + (1 + e[:, None]) * e[None, :] + 1e-5
    assert (np.abs(a @ a.T - product) <= slack).all()


def best(a, b, k, same):
    cos = np.round(a.astype(float) @ b.astype(float).T / np.linalg.norm(a.astype(float), axis=1)[:, None] / np.linalg.norm(b.astype(float), axis=1)[None, :], 9)
    pick = lambda c, r: sorted((j for j in range(c.shape[1]) if not (same and j == r)), key=lambda j: (-c[r, j], j))[:k]
    rows = {(r, j) for r in range(len(a)) for j in pick(cos, r)}
    return {(min(p), max(p)) for p in rows} if same else rows | {(j, r) for r in range(len(b)) for j in pick(cos.T, r)}


@pytest.mark.parametrize("crowded", [0, 1, 32])
@pytest.mark.parametrize("kind", ["equal", "burst", "parallel", "apart"])
def test_all_data_keep_the_best(monkeypatch, kind, crowded):
    monkeypatch.setattr(N, "TILE", 7)
    monkeypatch.setattr(N, "CROWDED", crowded)
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    make = {"equal": lambda n: np.tile(base, (n, 1)), "burst": lambda n: base + rng.normal(scale=1e-4, size=(n, 8)), "parallel": lambda n: base * rng.uniform(0.5, 9, (n, 1)), "apart": lambda n: rng.normal(size=(n, 8))}[kind]
    a, b = make(40).astype(np.float32), make(30).astype(np.float32)
    for other in (None, b):
        left, right, cos = N.best_pairs(a, other, 4)
        got = set(zip(left.tolist(), right.tolist()))
        assert len(got) == len(left) and best(a, a if other is None else b, 4, other is None) <= got


def test_bursts_stay_small(monkeypatch):
    monkeypatch.setattr(N, "TILE", 256)
    rng = np.random.default_rng(4)
    burst = (np.ones(16) + rng.normal(scale=1e-4, size=(2000, 16))).astype(np.float32)
    left, _, _ = N.best_pairs(burst, None, 5)
    assert len(left) <= 2000 * 8 * 32


def test_bursts(spark):
    """Nearly equal and parallel vectors, beside others."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=12)
    rows = [(f"{rng.integers(1e12):012d}", "2024", "m", 12, [float(x) for x in v], "x") for v in [base + rng.normal(scale=1e-4, size=12) for _ in range(90)] + [base * s for s in rng.uniform(0.5, 9, 60)] + list(rng.normal(size=(80, 12)))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.hash_a, r.hash_b) for r in N.pairs(N.nearest(N.usable(df), 5, spread=3, small=40)).collect()}
    assert got == brute(rows, 5)


def clustered(rng, groups, size, dims):
    """Groups of like vectors, of any length, beside some vectors of their own."""
    near = np.repeat(rng.normal(size=(groups, dims)), size, axis=0) + rng.normal(scale=0.2, size=(groups * size, dims))
    return (np.concatenate([near, rng.normal(size=(groups, dims))]) * rng.uniform(0.1, 9, (groups * size + groups, 1))).astype(np.float32)


@pytest.mark.parametrize("kind", ["clustered", "apart", "burst", "equal"])
def test_balls_lose_nothing(kind):
    rng = np.random.default_rng(5)
    make = {"clustered": lambda: clustered(rng, 25, 12, 16), "apart": lambda: rng.normal(size=(300, 16)), "burst": lambda: np.ones(16) + rng.normal(scale=1e-4, size=(300, 16)), "equal": lambda: np.repeat(rng.normal(size=(60, 16)), 5, axis=0)}[kind]
    vectors = make().astype(np.float32)
    vectors = np.concatenate([vectors, vectors[::3] + rng.normal(scale=0.05, size=vectors[::3].shape)]).astype(np.float32)
    vectors, keys, k = vectors[rng.permutation(len(vectors))], [f"{i:05d}" for i in range(len(vectors))], 5
    half = len(vectors) // 2
    a, b = N.Block(pa.array(keys[:half]), vectors[:half], k, 9), N.Block(pa.array(keys[half:]), vectors[half:], k, 9)
    assert kind == "apart" or len(a.centre)
    found = {}
    for row, other, cos in [*zip(a.rank[a.owner], a.other, a.cos), *zip(b.rank[b.owner] + half, b.other + half, b.cos)]:
        found.setdefault(int(row), []).append((-cos, int(other)))
    for (x, y, at, to) in ((a, b, 0, half), (b, a, half, 0)):
        for row, other, cos in zip(*N.scan(x, y, k, 9)):
            found.setdefault(int(x.rank[row]) + at, []).append((-cos, int(other) + to))
    got = {(min(r, c), max(r, c)) for r, near in found.items() for _, c in sorted(near)[:k]}
    assert got == best(vectors, vectors, k, True)


def test_vectors_are_not_copied_for_each_pair_of_blocks(spark):
    vectors = clustered(np.random.default_rng(6), 60, 19, 128)
    rows = [(f"{i * 7919 % 100003:06d}", "2024", "m", 128, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA).select("content_hash", "made_at", "model", "dims", "vector")
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    before = written()
    got = {(r.hash_a, r.hash_b) for r in N.pairs(N.nearest(N.usable(df), 5, group_rows=100)).collect()}
    assert written() - before < 6 * vectors.nbytes
    assert got == brute(rows, 5)
