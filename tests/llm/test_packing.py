import random
from collections import Counter, defaultdict

from ridgeline.llm import packing as P


def test_every_token_once(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice([0, 1, 5, 37, 64, 65, 200, 256, 257, 1000, 1024, 2050, 5000])) for i in range(400)] + [(1000 + i, 37) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, n_tokens long")
    caps = [("short", 64), ("mid", 256), ("long", 1024)]
    packed = P.pack(df, caps, step_tokens=2048, rows_per_salt=50)
    rows = packed.collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.window_id].append(r)
    for d, n in docs:
        got = sorted(by_doc[d], key=lambda r: r.start_token)
        assert sum(r.n_tokens for r in got) == n
        assert len(got) == -(-n // 1024)  # split only beyond the largest window
        at = 0
        for r in got:
            assert r.start_token == at
            at += r.n_tokens
    size = dict(caps)
    for rs in by_window.values():
        rs.sort(key=lambda r: r.window_offset)
        at = 0
        for r in rs:
            assert r.window_offset == at
            at += r.n_tokens
        assert at <= size[rs[0].target_name]
    steps = Counter()
    for w, rs in by_window.items():
        steps[rs[0].step_group] += size[rs[0].target_name]
    assert all(n <= 2048 for n in steps.values())
    used = {r.target_name: r.used for r in P.utilisation(packed).collect()}
    assert used["long"] > 0.97


def test_histogram_is_used_up():
    rng = random.Random(4)
    h = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(40)}
    got = Counter()
    for cap, times, pattern in P.pack_sizes(h, [20, 100]):
        assert sum(s * n for s, n in pattern.items()) <= cap
        for s, n in pattern.items():
            got[s] += n * times
    assert got == h
    assert P.pack_sizes({}, [8]) == []


def test_token_counts(spark):
    long = "word " * 60_000
    df = spark.createDataFrame([(1, "hello world", "clash"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (1, "hello world", "x")], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id, r.n_tokens) for r in P.token_counts(df).collect())
    assert got[:2] == [(1, 2), (1, 2)] and got[2] == (4, len(P.encoder().encode_ordinary(long)))
    assert "".join(P.parts(long)) == long
    glued = "word," * 60_000 + "then a blank"
    assert P.parts(glued, 1000)[0].startswith("word,") and sum(len(P.encoder().encode_ordinary(x)) for x in P.parts(glued, 1000)) == len(P.encoder().encode_ordinary(glued))
    empty = P.pack(P.token_counts(df.limit(0)), [("w", 8)])
    assert empty.count() == 0
