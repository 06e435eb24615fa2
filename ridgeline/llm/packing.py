"""Filling fixed-capacity windows with documents, measured in tokens.

Hierarchical multi-length packing. A document longer than the largest window is
cut into full windows and a rest; every other piece stays whole and is routed to
the smallest window (tier) that holds it. Tiers are packed from the longest to
the shortest by best fit decreasing, and what room a long window keeps is filled
with the largest pieces of shorter tiers that fit. Windows are numbered by their
fill and dealt round robin to step groups of one tier and an equal token
budget, which balances the groups.

Only the histogram of piece sizes reaches the driver: at most one count per
possible size, however many documents there are. It is packed as patterns (sizes
that fill a window together, and how often), and each piece finds its window
from its rank within its size. Ranks are taken within salts, so that a size
which a third of all documents share is no hot group.

Defined cases: null and empty texts have no tokens and no window; equal texts
are packed once per id; a repeated id is packed as often as it stands.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Public pre-tokenisation pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_CAPACITY = 1_000_000
#: Longer texts are encoded in parts cut before a blank, where the pattern cuts anyway.
PART = 50_000
#: More than the pieces of one size ever are; times MAX_CAPACITY it is within a long.
RANKS = 1 << 42
_encoders: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a ranks file, loaded once per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def parts(text: str, size: int = PART) -> list[str]:
    """Parts of at least ``size`` characters, cut before a single blank between words, where the pattern cuts too; a text without such a blank stays whole."""
    out, at = [], 0
    while len(text) - at > 2 * size:
        to = at + size
        while to < len(text) - 1 and not (text[to] == " " and text[to - 1].isalnum() and text[to + 1].isalnum()):
            to += 1
        if to >= len(text) - 1:
            break
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of every document with text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "n_tokens": [sum(len(encode(p)) for p in parts(t)) for t in batch.text]})

    return documents.select("doc_id", "text").filter("text is not null and text <> ''").mapInPandas(count, "doc_id long, n_tokens long")


def pack_sizes(histogram: dict[int, int], capacities: list[int]) -> list[tuple[int, int, dict[int, int]]]:
    """(capacity, windows, {size: pieces in each window}) that use every piece of the histogram once. No size may exceed the largest capacity."""
    left = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    sizes = sorted(left)
    out = []
    tiers = sorted(set(capacities))
    for at in range(len(tiers) - 1, -1, -1):
        cap, low = tiers[at], tiers[at - 1] if at else 0
        while sizes and sizes[-1] > low:
            pattern: dict[int, int] = {}
            room, times = cap, None
            upto = len(sizes)
            while room > 0 and (k := bisect.bisect_right(sizes, room, 0, upto) - 1) >= 0:
                s = sizes[k]
                fit = min(room // s, left[s])
                pattern[s] = fit
                room -= fit * s
                upto = k  # smaller ones only: the rest of this size does not fit or is used up
            times = min(left[s] // n for s, n in pattern.items())
            out.append((cap, times, pattern))
            for s, n in pattern.items():
                left[s] -= n * times
                if not left[s]:
                    sizes.pop(bisect.bisect_left(sizes, s))
    return out


def pack(counts: DataFrame, capacities: list[tuple[str, int]], *, step_tokens: int = 65_536, rows_per_salt: int = 200_000) -> DataFrame:
    """doc_id, piece_no, start_token, n_tokens, target_name, window_id, window_offset, step_group of every piece. ``counts`` has doc_id and n_tokens."""
    spark = counts.sparkSession
    names = {c: n for n, c in sorted(capacities, reverse=True)}
    largest = max(names)
    if largest > MAX_CAPACITY:
        raise ValueError(f"a capacity above {MAX_CAPACITY} tokens would make the histogram of sizes too large")
    n_pieces = F.ceil(F.col("n_tokens") / largest).cast("int")
    cuts = counts.filter("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), n_pieces)).alias("piece_no"))
    cuts = cuts.withColumn("start_token", (F.col("piece_no") - 1).cast("bigint") * largest)
    cuts = cut(cuts.select("doc_id", "piece_no", "start_token", F.least(F.col("n_tokens") - F.col("start_token"), F.lit(largest)).cast("int").alias("size")))
    histogram = {r["size"]: r["n"] for r in cuts.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most ``largest`` rows
    patterns = pack_sizes(histogram, list(names))
    # number the windows of a tier by fill, fullest first, and find each size's slots in that order
    base: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    filled: dict[int, int] = {}
    for cap, times, pattern in sorted(patterns, key=lambda p: (-p[0], -sum(s * n for s, n in p[2].items()))):
        first = base.get(cap, 0)
        base[cap] = first + times
        for s, n in pattern.items():
            slots.setdefault(s, []).append((filled.get(s, 0), n, cap, first, times))
            filled[s] = filled.get(s, 0) + n * times
    groups = {cap: -(-n // max(1, step_tokens // cap)) for cap, n in base.items()}
    # slots of all sizes in one sorted array: a piece finds its slot by size and rank
    rows = sorted((s, *slot) for s, some in slots.items() for slot in some)
    size_of, start, per, cap_of, first, _ = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else [()] * 6))
    shared = spark.sparkContext.broadcast((size_of * RANKS + start, start, per, cap_of, first, groups, names))

    salts = max(1, min(4096, -(-max([0, *histogram.values()]) // rows_per_salt)))
    keyed = cuts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int"))
    per_salt = keyed.groupBy("size", "_salt").agg(F.count("*").alias("_n"))
    offset = per_salt.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy("size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("size", "_salt").orderBy("doc_id", "piece_no")) - 1)
    ranked = ranked.join(offset, ["size", "_salt"]).select("doc_id", "piece_no", "start_token", "size", (F.col("_r") + F.col("_o")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, per, cap_of, first, steps, name_of = shared.value
        for b in batches:
            rank = b["rank"].to_numpy(np.int64)
            k = np.searchsorted(key, b["size"].to_numpy(np.int64) * RANKS + rank, side="right") - 1
            number, cap = first[k] + (rank - start[k]) // per[k], cap_of[k]
            yield pd.DataFrame({"doc_id": b.doc_id, "piece_no": b.piece_no, "start_token": b.start_token, "n_tokens": b["size"], "target_name": [name_of[c] for c in cap], "window_no": number, "capacity": cap, "step_group": number % np.array([steps[c] for c in cap], dtype=np.int64)})

    placed = ranked.mapInPandas(place, "doc_id long, piece_no int, start_token long, n_tokens int, target_name string, window_no long, capacity int, step_group long")
    inside = Window.partitionBy("target_name", "window_no").orderBy(F.desc("n_tokens"), "doc_id", "piece_no").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("window_offset", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).cast("int")).select(
        "doc_id", "piece_no", "start_token", "n_tokens", "target_name", F.concat_ws("-", "target_name", F.col("window_no").cast("string")).alias("window_id"), "window_offset", "capacity", F.concat_ws("-", "target_name", F.col("step_group").cast("string")).alias("step_group")
    )


def utilisation(packed: DataFrame) -> DataFrame:
    """Per target: windows, tokens in them, share of room used, and the least and largest tokens of a step group."""
    groups = packed.groupBy("target_name", "step_group").agg(F.sum("n_tokens").alias("t"))
    steps = groups.groupBy("target_name").agg(F.min("t").alias("least_step_tokens"), F.max("t").alias("largest_step_tokens"))
    windows = packed.groupBy("target_name", "window_id", "capacity").agg(F.sum("n_tokens").alias("t"))
    total = windows.groupBy("target_name").agg(F.count("*").alias("windows"), F.sum("t").alias("tokens"), (F.sum("t") / F.sum("capacity")).alias("used"))
    return total.join(steps, "target_name")
