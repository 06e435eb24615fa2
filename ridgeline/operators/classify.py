"""Tags and page scores from embedding vectors and a small matrix of prompts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import fixed
from ridgeline.functions.time import season, time_of_day


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def tag_rows(sims: np.ndarray) -> list[list[str]]:
    """Tags of each row of prompt similarities, facets first, then yes/no pairs."""
    scaled = np.asarray(sims, dtype=float) * fixed.SOFTMAX_SCALE
    chosen: dict[str, np.ndarray] = {}
    at = 0
    for facet, (threshold, labels) in fixed.FACETS.items():
        share = softmax(scaled[:, at : at + len(labels)])
        at += len(labels)
        names = list(dict.fromkeys(labels))
        per = np.stack([share[:, [i for i, x in enumerate(labels) if x == n]].sum(1) for n in names], 1)
        best = per.argmax(1)
        chosen[facet] = np.array([names[b] if names[b] and p[b] >= threshold else None for b, p in zip(best, per)], dtype=object)
    yes: dict[str, np.ndarray] = {}
    for name, threshold in fixed.BINARY.items():
        yes[name] = softmax(scaled[:, at : at + 2])[:, 0] >= threshold
        at += 2
    out = []
    for r in range(len(scaled)):
        people, activity, terrain, subject = (chosen[f][r] for f in ("people", "activity", "terrain", "subject"))
        weather = [n for n in yes if yes[n][r]]
        if subject in fixed.DOCUMENT_TAGS:
            people = activity = terrain = None
            weather = []
        if people is None:
            activity = None
        if terrain == "indoors":
            weather = []
        tags = [t for t in (activity, terrain, subject, *weather) if t]
        if people and "portrait" not in tags:
            tags.append("people")
        out.append(list(dict.fromkeys(tags))[: fixed.MAX_TAGS])
    return out


def n_prompts() -> int:
    return sum(len(x) for _, x in fixed.FACETS.values()) + 2 * len(fixed.BINARY)


def tagged(items: DataFrame, prompts: np.ndarray, *, key: str, vector: str) -> DataFrame:
    """key, tags of every vector; the prompt matrix has one row per prompt (a few dozen) and travels with the function. Vectors of another length or with NaN have no tags."""
    kind = dict(items.dtypes)[key]
    width = prompts.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [v is not None and len(v) == width and not np.isnan(np.asarray(v, dtype=float)).any() for v in b[vector]]
            tags: list[list[str]] = [[] for _ in good]
            rows = [i for i, g in enumerate(good) if g]
            if rows:
                found = tag_rows(np.stack([np.asarray(b[vector].iloc[i], dtype=float) for i in rows]) @ prompts.T)
                for i, t in zip(rows, found):
                    tags[i] = t
            yield pd.DataFrame({key: b[key], "tags": tags})

    return items.select(key, vector).mapInPandas(run, f"{key} {kind}, tags array<string>")


def with_clock(tags: Column, ts: Column) -> Column:
    """Tags and what the time tells, but for documents."""
    extra = F.filter(F.array(season(ts), time_of_day(ts)), lambda x: x.isNotNull())
    paper = F.arrays_overlap(tags, F.array(*map(F.lit, fixed.DOCUMENT_TAGS)))
    return F.when(F.coalesce(paper, F.lit(False)), tags).otherwise(F.slice(F.array_distinct(F.concat(tags, extra)), 1, fixed.MAX_TAGS))


def unplaceable(tags: Column) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, fixed.UNPLACEABLE))), F.lit(False))


def dot(vector: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, weights)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def first_share(vector: Column, prompts: list[list[float]], first: int, scale: float) -> Column:
    """Softmax share of the first prompts, as expressions."""
    sims = F.array(*[dot(vector, p) * scale for p in prompts])
    exps = F.transform(sims, lambda s: F.exp(s - F.array_max(sims)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return total(F.slice(exps, 1, first)) / total(exps)
