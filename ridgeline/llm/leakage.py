"""Evaluation passages that leaked into documents.

Passages and documents are reduced to words: runs of letters and digits after
compatibility decomposition, lower-casing and dropping accents and invisible
format characters. A leak is a run of at least ``run`` words of a passage. Any
such run holds a whole aligned chunk of ``(run + 1) // 2`` words, so one
Aho-Corasick automaton over the aligned chunks of all passages, scanned once over
a document, finds every candidate; each hit is extended word by word both ways
along the passage and kept if the run is long enough. Offsets are mapped back
to the text as it stands.

The passages are broadcast (not the automaton, which each Python worker builds
once). An automaton has about ``max_chunks`` chunks at most: more passages are
dealt by their hash to as many automata as it takes, each of which scans the
documents in turn.

Defined cases: null and empty texts have no row; passages shorter than ``run``
words cannot leak; a document with a passage twice has one row in ``leaks`` and
two in ``spans``; wording shared by several items gives away each of them.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DROP = regex.compile(r"[\p{M}\p{Cf}]+")
_GAP = regex.compile(r"[^\p{L}\p{N}]+")


def words(text: str) -> list[str]:
    """The words of a text."""
    if text.isascii():
        return _GAP.sub(" ", text.lower()).split()
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).lower())
    return _GAP.sub(" ", _DROP.sub("", plain)).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end in the text as it stands of each of its words, in the order of :func:`words`."""
    out: list[list[int]] = []
    open_word = False
    for i, ch in enumerate(text):
        plain = ch.lower() if ch.isascii() else _DROP.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).lower()))
        for part in plain:
            if _GAP.match(part):
                open_word = False
            elif open_word:
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1])
                open_word = True
        if not plain and open_word and out:
            out[-1][1] = i + 1
    return [(a, b) for a, b in out]


def chunks(items: list[tuple[int, list[str]]], run: int) -> dict[str, list[tuple[int, int]]]:
    """Aligned chunks of passages of at least ``run`` words: (item index, word position)."""
    size, out = (run + 1) // 2, {}
    for n, (_, passage) in enumerate(items):
        if len(passage) >= run:
            for at in range(0, len(passage) - size + 1, size):
                out.setdefault(" ".join(passage[at : at + size]), []).append((n, at))
    return out


def extend(doc: list[str], at: int, passage: list[str], start: int, size: int) -> tuple[int, int]:
    """First and last word (exclusive) in the document of the run around a chunk."""
    a, b, p, q = at, at + size, start, start + size
    while a and p and doc[a - 1] == passage[p - 1]:
        a, p = a - 1, p - 1
    while b < len(doc) and q < len(passage) and doc[b] == passage[q]:
        b, q = b + 1, q + 1
    return a, b


class Scanner:
    """An Aho-Corasick automaton over the chunks of all passages."""

    def __init__(self, items: list[tuple[int, str]], run: int) -> None:
        import ahocorasick

        self.run, self.size = run, (run + 1) // 2
        self.items = [(i, words(p)) for i, p in items]
        self.automaton = ahocorasick.Automaton()
        for chunk, places in chunks(self.items, run).items():
            self.automaton.add_word(f" {chunk} ", (len(chunk), places))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """item_id, first and last word (exclusive) of every leaked run."""
        if not text or self.empty:
            return []
        doc = words(text)
        joined = f" {' '.join(doc)} "
        found, counted, upto = set(), 0, 0
        for end, (length, places) in self.automaton.iter(joined):
            start = end - length - 1  # the blank before the chunk
            counted += joined.count(" ", upto, start)
            upto = start
            for n, at in places:
                item, passage = self.items[n]
                a, b = extend(doc, counted, passage, at, self.size)
                if b - a >= self.run:
                    found.add((item, a, b))
        return sorted(found)


def _scan(documents: DataFrame, items: DataFrame, run: int, max_chunks: int, offsets: bool) -> DataFrame:
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").filter("text is not null")
    clean = items.select("item_id", "passage").filter("passage is not null and item_id is not null").dropDuplicates(["item_id", "passage"])
    schema = "doc_id long, item_id long" + (", start_char int, end_char int, n_words int" if offsets else "")

    def rows(doc_id: int, text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
        if not offsets:
            return [(doc_id, item) for item in sorted({s[0] for s in spans})]
        where = word_spans(text) if spans else []
        return [(doc_id, item, where[a][0], where[b - 1][1], b - a) for item, a, b in spans]

    columns = [c.split()[0] for c in schema.split(", ")]
    # every chunk has at least one word of a letter, so this bounds the chunks too
    bound = clean.agg(F.coalesce(F.sum(F.length("passage") / run), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, math.ceil(bound / max_chunks))

    def scan_with(shard: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        mine = clean.filter(F.pmod(F.xxhash64("item_id", "passage"), F.lit(shards)) == shard) if shards > 1 else clean
        shared = spark.sparkContext.broadcast([(r.item_id, r.passage) for r in mine.collect()])
        built: list[Scanner] = []

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if not built:
                built.append(Scanner(shared.value, run))
            for batch in batches:
                out = [r for d, t in zip(batch.doc_id, batch.text) for r in rows(d, t, built[0].spans(t))]
                yield pd.DataFrame(out, columns=columns)

        return scan

    found = reduce(DataFrame.unionByName, [docs.mapInPandas(scan_with(shard), schema) for shard in range(shards)])
    return found.distinct() if shards > 1 else found  # an item may have passages in several shards


def leaks(documents: DataFrame, items: DataFrame, *, run: int = 12, max_chunks: int = 2_000_000) -> DataFrame:
    """doc_id, item_id of every document that holds ``run`` consecutive words of an item's passage."""
    return _scan(documents, items, run, max_chunks, offsets=False)


def spans(documents: DataFrame, items: DataFrame, *, run: int = 12, max_chunks: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, start_char, end_char, n_words of every leaked run."""
    return _scan(documents, items, run, max_chunks, offsets=True)
