"""Connected components over pairwise matches.

The giant component is peeled off first: breadth-first joins from the ``seeds``
vertices of highest degree at once, as the very highest may stand in a small
dense group; the frontier grows fast while the giant lasts. As soon as a round
adds little (a long tail, or the components are done) what each seed reached is
contracted to it and taken out of the edges by an anti join. What
remains is labelled by minimum propagation. Edges are dealt by their hash to
parts of at most about ``part_edges`` edges, smaller ones if cores would be idle; each part propagates minima among its own
edges until nothing changes, so that a chain inside a part takes one round
however long it is. A vertex that parts gave several minima takes the smallest
and links the others to it; only these links go into the next round. Vertices
are compared by a random rank and edges dealt anew each round, so that the links
shrink by about a third a round whatever the order of the names. Labels are
mapped from the first round to the last, and the smallest member names each
group.

A vertex is never gathered with its neighbours: edges are dealt by both ends,
degrees and minima are aggregated with map-side combining, and a vertex has at
most one row per part, so a vertex with a third of all edges is no hot group.
Each round is written to the shared checkpoint folder.

Defined cases: null ends are ignored; a vertex paired only with itself is its
own group; repeated and reversed pairs count once; an empty table has no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.session import cut


#: Edges that are worth a core of their own.
CORE_EDGES = 10_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def peel(edges: DataFrame, *, seeds: int = 16, growth: float = 0.3, rounds: int = 8) -> DataFrame | None:
    """v, seed of the vertices reached from the ``seeds`` vertices of highest degree, each by one of the seeds that reach it first; stops when a round adds less than the share ``growth`` of what was reached before. None without edges."""
    arcs = _both_ways(edges)
    top = [r["a"] for r in arcs.groupBy("a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").limit(seeds).collect()]
    if not top:
        return None
    visited = edges.sparkSession.createDataFrame([(v, v) for v in top], "v string, seed string")
    frontier, total = visited, len(top)
    for _ in range(rounds):
        reached = arcs.join(frontier.select(F.col("v").alias("a"), "seed"), "a").groupBy(F.col("b").alias("v")).agg(F.min("seed").alias("seed"))
        frontier = cut(reached.join(visited.select("v"), "v", "left_anti"))
        new = frontier.count()
        if not new:
            break
        visited = cut(visited.unionByName(frontier))
        total += new
        if new < growth * total:
            break
    return visited


def minima(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of the component of each of n vertices: every edge hands the lesser label to the label of its other end, and labels are followed to their own, until nothing changes."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        after = label.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        while not np.array_equal(jumped := after[after], after):
            after = jumped
        if np.array_equal(after, label):
            return label
        label = after


def _within_part(seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """v, m, r of every vertex of a part: the vertex of least rank that it is linked to inside the part, and its rank, a hash of its name and ``seed``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        edges = pd.concat(rows)
        names, codes = np.unique(np.concatenate([edges.a.to_numpy(object), edges.b.to_numpy(object)]).astype(str), return_inverse=True)
        rank = pd.util.hash_array(names.astype(object), hash_key=f"{seed:016d}", categorize=False).view(np.int64)
        order = np.lexsort((np.arange(len(names)), rank))
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        codes = place[codes]
        least = order[minima(codes[: len(edges)], codes[len(edges) :], len(names))[place]]
        yield pd.DataFrame({"v": names.astype(object), "m": names[least].astype(object), "r": rank[least]})

    return run


def propagate(edges: DataFrame, *, part_edges: int = 200_000, rounds: int = 40) -> DataFrame | None:
    """v, root of every vertex of ``edges`` (a, b); roots are the same for linked vertices and only for these. Edges that are left after ``rounds`` are an error."""
    labels: DataFrame | None = None
    for seed in itertools.count():
        count = edges.count()
        if not count:
            break
        if seed == rounds:
            raise RuntimeError(f"{count} links between parts are left after {rounds} rounds")
        parts = max(-(-count // part_edges), min(edges.sparkSession.sparkContext.defaultParallelism, count // CORE_EDGES))
        stars = cut(edges.repartition(max(1, parts), "a", "b", F.lit(seed)).mapInPandas(_within_part(seed), "v string, m string, r long"))
        level = stars.groupBy("v").agg(F.min(F.struct("r", "m")).alias("_m")).select("v", F.col("_m.m").alias("root"))
        # a root of the rounds before is a vertex of this one, unless its component was done
        labels = cut(level if labels is None else labels.join(level.select(F.col("v").alias("root"), F.col("root").alias("_r")), "root", "left").select("v", F.coalesce("_r", "root").alias("root")))
        if parts <= 1:
            break  # one part has seen every edge
        edges = cut(stars.join(level, "v").filter("m <> root").select(F.col("m").alias("a"), F.col("root").alias("b")).distinct())
    return labels


def components(pairs: DataFrame, a: str, b: str, *, part_edges: int = 200_000) -> DataFrame:
    """vertex, label: the smallest vertex linked to it directly or through others."""
    edges = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).filter("a is not null and b is not null")
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    alone = edges.filter("a = b").select(F.col("a").alias("v"))
    links = edges.filter("a <> b")
    giant = peel(links)
    if giant is None:
        return alone.select(F.col("v").alias("vertex"), F.col("v").alias("label"))
    # what a seed reached becomes the seed; edges within it go, edges that leave it now leave the seed
    flag = lambda e, c: e.join(giant.select(F.col("v").alias(c), F.col("seed").alias(f"_{c}")), c, "left")
    rest = flag(flag(links, "a"), "b").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    rest = cut(rest.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rooted = giant.select("v", F.col("seed").alias("root"))
    labels = propagate(rest, part_edges=part_edges)
    if labels is not None:
        # the seeds' own roots, if a tail of the giant or another seed reached back to them
        seeds = giant.select(F.col("seed").alias("v")).distinct()
        of_seed = labels.join(seeds, "v", "left_semi").select(F.col("v").alias("root"), F.col("root").alias("_s"))
        rooted = rooted.join(of_seed, "root", "left").select("v", F.coalesce("_s", "root").alias("root"))
        rooted = rooted.unionByName(labels.join(seeds, "v", "left_anti"))
    rooted = rooted.unionByName(alone.join(rooted, "v", "left_anti").select("v", F.col("v").alias("root")))
    rooted = cut(rooted.distinct())
    names = rooted.groupBy("root").agg(F.min("v").alias("label"))
    return rooted.join(names, "root").select(F.col("v").alias("vertex"), "label")
