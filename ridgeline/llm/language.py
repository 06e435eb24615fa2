"""Language of each document and of each mixed-language segment.

Multinomial naive Bayes over hashed character n-grams (one to four letters of
words in lower case, with their edges): a matrix of log probabilities, one row
per hash bucket, is broadcast; batches of new words are scored by gathering its
rows, and sentences by adding up their words. Sentences of a document are then decoded together by the
Viterbi algorithm with a cost for changing language, and neighbours of one
language form a segment. A document is read and scored once, in one task:
whatever is asked of it (its segments, its main language, whether its label is
doubtful) follows from its own sentences, without a shuffle.

The classifier is fitted on at most ``train_samples`` trusted samples first and
then, twice, on the sentences of at most ``train_docs`` labelled documents of at
most ``train_chars`` characters (each the rows with the smallest hash of their
id) whose label the fit before confirms. Everything else covers every document
whole.

Defined cases: null and empty texts have no row; a row that stands twice is
judged twice; a sentence counts only with two
words of two letters or more outside file names, grades and numbers, so that
paragraphs without language have no segment; a sentence with less joins the one
before it; ties go to the language first in the alphabet.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["de", "en", "es", "fr", "it", "nb"]
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
#: Spellings of language labels. Anything else names no language.
LABELS = {
    "de": "de", "deu": "de", "ger": "de", "deutsch": "de", "german": "de", "allemand": "de", "tedesco": "de", "aleman": "de", "tysk": "de",
    "en": "en", "eng": "en", "english": "en", "englisch": "en", "anglais": "en", "inglese": "en", "ingles": "en", "engelsk": "en",
    "es": "es", "spa": "es", "espanol": "es", "castellano": "es", "spanish": "es", "spanisch": "es", "espagnol": "es", "spagnolo": "es", "spansk": "es",
    "fr": "fr", "fra": "fr", "fre": "fr", "francais": "fr", "french": "fr", "franzosisch": "fr", "francese": "fr", "frances": "fr", "fransk": "fr",
    "it": "it", "ita": "it", "italiano": "it", "italian": "it", "italienisch": "it", "italien": "it", "italiensk": "it",
    "nb": "nb", "nob": "nb", "no": "nb", "nor": "nb", "norsk": "nb", "bokmal": "nb", "norwegian": "nb", "norwegisch": "nb", "norvegien": "nb", "norvegese": "nb", "noruego": "nb",
}
_SENTENCE = regex.compile(r"(?<=[.!?…][\"'»”)\]]?)\s+")
_LETTERS = regex.compile(r"[^\p{L}']+")
_WORD = regex.compile(r"^\P{L}*\p{L}[\p{L}\p{M}'’-]*\p{L}\P{L}*$")


def label_language(label: str | None) -> str | None:
    """The language that a label names, however spelt; null if it names none."""
    if label is None or label != label:
        return None
    plain = unicodedata.normalize("NFKD", str(label)).lower()
    plain = "".join(c for c in plain if not unicodedata.combining(c)).strip()
    return next((LABELS[p] for p in [plain, *regex.split(r"[-_ ,;/]+", plain)] if p in LABELS), None)


def paragraphs(text: str) -> list[str]:
    """Runs of lines that are not blank."""
    out: list[list[str]] = []
    open_para = False
    for line in text.split("\n"):
        if not line.strip():
            open_para = False
        elif open_para:
            out[-1].append(line)
        else:
            out.append([line])
            open_para = True
    return ["\n".join(p) for p in out]


@lru_cache(maxsize=200_000)
def _word(token: str) -> frozenset[str] | None:
    """The folded words of a token that a language may show in: letters only, two or more, not a file name or number; None for others."""
    if not _WORD.match(token) or "_" in token or any(c.isdigit() for c in token):
        return None
    return frozenset(name_words(token))


def n_words(piece: str, names: frozenset[str] = frozenset(), enough: int = 2) -> int:
    """Words that a language may show in and that are no part of a proper name in ``names`` (as of :func:`name_words`), counted up to ``enough``."""
    n = 0
    for token in piece.split():
        folded = _word(token)
        if folded is not None and folded.isdisjoint(names):
            n += 1
            if n == enough:
                break
    return n


def name_words(name: str) -> set[str]:
    """Words of a proper name without case and accents."""
    return set(_LETTERS.sub(" ", without_accents(name).lower()).split())


def sentences(paragraph: str, names: frozenset[str] = frozenset()) -> list[str]:
    """Sentences and captions; a piece without two words joins the one before it, at the start the one after. Line feeds inside a paragraph are wraps."""
    out: list[str] = []
    waiting = ""
    for piece in _SENTENCE.split(paragraph):
        piece = piece.strip()
        if not piece:
            continue
        if n_words(piece, names) >= 2:
            out.append(f"{waiting} {piece}".strip() if waiting else piece)
            waiting = ""
        elif out:
            out[-1] += " " + piece
        else:
            waiting = f"{waiting} {piece}".strip()
    return out


def plain(sentence: str) -> str:
    """Lower-case letters, single blanks, a blank at either end."""
    return f" {_LETTERS.sub(' ', unicodedata.normalize('NFC', sentence).lower().replace('’', chr(39))).strip()} "


def buckets(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of every n-gram of every piece, and the piece of each."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(p) for p in pieces])
    ends = np.repeat(np.cumsum(lengths), lengths)
    piece = np.repeat(np.arange(len(pieces)), lengths)
    hashed, owner = [], []
    at = np.arange(len(codes))
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: len(codes) - n + 1] = codes[n - 1 :] if n <= len(codes) else shifted[:0]
        rolling = rolling * np.uint64(1_000_003) + shifted + np.uint64(n)
        if n in ORDERS:
            keep = at + n <= ends
            mixed = rolling[keep] * np.uint64(0x9E3779B97F4A7C15)
            hashed.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32))
            owner.append(piece[keep])
    return np.concatenate(hashed), np.concatenate(owner)


class Model:
    """Log probabilities, one row per bucket and one column per language.

    N-grams stay within a word and its edges, so that a word always scores the
    same: scores of words are kept, at most ``keep`` at a time, and a text is the
    sum of its words.
    """

    def __init__(self, pieces: list[str], langs: list[str], smoothing: float = 0.05, keep: int = 400_000) -> None:
        counts = np.zeros((BUCKETS, len(LANGUAGES)))
        for k, lang in enumerate(LANGUAGES):
            words = Counter(w for p, x in zip(pieces, langs) if x == lang for w in p.split())
            if words:
                hashed, owner = buckets([f" {w} " for w in words])
                counts[:, k] = np.bincount(hashed, weights=np.array(list(words.values()), dtype=float)[owner], minlength=BUCKETS)
        # buckets never seen in training say nothing; smoothing is a share of the mean count
        seen = counts.sum(1) > 0
        raised = counts + smoothing * max(1.0, counts.sum() / max(1, seen.sum()) / len(LANGUAGES)) * 0.1
        table = np.log(raised / raised.sum(0))
        table -= table.max(1, keepdims=True)
        table[~seen] = 0
        self.table, self.keep = table.astype(np.float32), keep
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(LANGUAGES)))

    def __getstate__(self) -> dict:
        return {"table": self.table, "keep": self.keep}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _learn(self, words: list[str]) -> None:
        """Scores of words not met before, in batches of a bounded size."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            hashed, owner = buckets([f" {w} " for w in part])
            gathered = self.table[hashed]
            new = np.stack([np.bincount(owner, weights=gathered[:, k], minlength=len(part)) for k in range(len(LANGUAGES))], 1)
            self.known.update(zip(part, range(len(self.rows), len(self.rows) + len(part))))
            self.rows = np.concatenate([self.rows, new])

    def scores(self, pieces: list[str]) -> np.ndarray:
        """Summed log probabilities of each piece."""
        words = [p.split() for p in pieces]
        new = {w for ws in words for w in ws if w not in self.known}
        if new:
            if len(self.known) + len(new) > self.keep:
                self._forget()
                new = {w for ws in words for w in ws}
            self._learn(sorted(new))
        sizes = np.array([len(ws) for ws in words])
        out = np.zeros((len(pieces), len(LANGUAGES)))
        at = np.fromiter((self.known[w] for ws in words for w in ws), dtype=np.int64, count=int(sizes.sum()))
        filled = np.flatnonzero(sizes)
        if len(filled):
            starts = np.r_[0, np.cumsum(sizes[filled])[:-1]]
            out[filled] = np.add.reduceat(self.rows[at], starts, axis=0)
        return out


def posterior(scores: np.ndarray, sharp: float = 1.0) -> np.ndarray:
    e = np.exp(sharp * (scores - scores.max(1, keepdims=True)))
    return e / e.sum(1, keepdims=True)


def decode(scores: np.ndarray, change: float) -> np.ndarray:
    """The best path of languages over the sentences of a document when a change costs ``change``."""
    best = scores[0].copy()
    back = []
    for row in scores[1:]:
        stay, jump = best, best.max() - change
        back.append(np.where(stay >= jump, np.arange(len(row)), best.argmax()))
        best = np.maximum(stay, jump) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


def without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def fit(samples: list[tuple[str, str]], labelled: list[tuple[str, str]], rounds: int = 2) -> Model:
    """From (language, text) of trusted samples and of labelled documents."""
    base = [(lang, plain(s)) for lang, text in samples for p in paragraphs(text) for s in sentences(p) or [p]]
    base += [(lang, without_accents(s)) for lang, s in base]
    model = Model([s for _, s in base], [lang for lang, _ in base])
    pool = [(lang, plain(s)) for lang, text in labelled for p in paragraphs(text) for s in sentences(p)]
    if not pool:
        return model
    for _ in range(rounds):
        score = model.scores([s for _, s in pool])
        order = np.sort(score, 1)
        sure = (order[:, -1] - order[:, -2]) > 2.0
        keep = [x for x, guess, ok in zip(pool, score.argmax(1), sure) if ok and LANGUAGES[guess] == x[0]]
        keep += [(lang, without_accents(s)) for lang, s in keep]
        model = Model([s for _, s in base + keep], [lang for lang, _ in base + keep])
    return model


def train(documents: DataFrame, samples: DataFrame, *, train_docs: int = 8000, train_chars: int = 2000, train_samples: int = 10_000) -> Model:
    """A model from a bounded number of samples and of labelled documents."""
    labelled = documents.select("doc_id", "lang", "text").filter((F.length("text").between(20, train_chars)) & F.col("lang").isNotNull())
    rows = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).select("lang", "text").toPandas()
    pool = [(x, t) for lang, t in zip(rows.lang, rows.text) if (x := label_language(lang))]
    trusted = samples.filter("sample_text is not null").orderBy(F.xxhash64("sample_id"), "sample_id").limit(train_samples).select("lang", "sample_text")
    return fit([(x, r.sample_text) for r in trusted.orderBy("lang", "sample_text").collect() if r.sample_text and (x := label_language(r.lang))], pool)


def with_names(documents: DataFrame, peaks: DataFrame, limit: int = 500_000) -> tuple[DataFrame, frozenset[str]]:
    """``documents`` and the words of all names and aliases, which are no words of a language.

    More than ``limit`` names are not gathered: each document then gets, by a join of its words with theirs, a column ``names`` of those that it holds, which has the same effect.
    """
    names = peaks.select(F.explode(F.concat(F.array("peak_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).filter("n is not null").distinct()
    few = names.limit(limit + 1).toPandas().n
    if len(few) <= limit:
        return documents, frozenset().union(*map(name_words, few))

    def of_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": sorted(frozenset().union(*map(name_words, b.n)))})

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(d, w) for d, t in zip(b.doc_id, b.text) for w in name_words(t)], columns=["doc_id", "word"])

    words = documents.select("doc_id", "text").filter("text is not null").mapInPandas(of_texts, "doc_id long, word string")
    held = words.join(names.mapInPandas(of_names, "word string").distinct(), "word").groupBy("doc_id").agg(F.collect_set("word").alias("names"))
    return documents.join(held, "doc_id", "left"), frozenset()


class Reader:
    """Cuts texts into sentences and scores them. What a blank-separated token is (whether a language may show in it, the scores of its words) is found once and kept, at most ``keep`` tokens at a time; a sentence is the sum of its tokens."""

    def __init__(self, model: Model, names: frozenset[str], keep: int = 400_000) -> None:
        self.model, self.names, self.keep = model, names, keep
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows, self.counts, self.folded = np.zeros((0, len(LANGUAGES))), np.zeros(0, bool), []

    def _ids(self, tokens: list[str]) -> np.ndarray:
        new = {t for t in tokens if t not in self.known}
        if len(self.known) + len(new) > self.keep:
            self._forget()
            new = set(tokens)
        if new:
            new = sorted(new)
            self.known.update(zip(new, range(len(self.folded), len(self.folded) + len(new))))
            folded = [_word(t) for t in new]
            self.folded += folded
            self.counts = np.concatenate([self.counts, [f is not None and f.isdisjoint(self.names) for f in folded]])
            self.rows = np.concatenate([self.rows, self.model.scores([plain(t) for t in new])])
        return np.fromiter((self.known[t] for t in tokens), dtype=np.int64, count=len(tokens))

    def read(self, texts: list[str], names: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, paragraph, sentence, characters and scores of every sentence; ``names`` are words of names of each text besides those known. As :func:`sentences`."""
        where, tokens, ends, length = [], [], [], []
        for n, text in enumerate(texts):
            for para_no, para in enumerate(paragraphs(text), 1):
                for piece in _SENTENCE.split(para):
                    if words := piece.split():
                        where.append((n, para_no))
                        tokens += words
                        ends.append(len(tokens))
                        length.append(len(piece.strip()))
        if not where:
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros((0, len(LANGUAGES)))
        ids = self._ids(tokens)
        starts = np.array([0, *ends[:-1]], dtype=np.int64)
        counts = self.counts[ids]
        if names is not None:
            of_token = np.repeat([w[0] for w in where], np.diff(np.r_[0, ends]))
            for k in np.flatnonzero(counts):
                own = names[of_token[k]]
                counts[k] = own is None or self.folded[ids[k]].isdisjoint(own)
        enough = np.add.reduceat(counts.astype(np.int64), starts) >= 2
        owner, found = np.full(len(where), -1), []
        last, now, waiting, k = None, -1, [], 0
        for i, at in enumerate(where):
            if at != last:
                last, now, waiting, k = at, -1, [], 0
            if enough[i]:
                k += 1
                now = len(found)
                found.append((*at, k))
                owner[waiting] = now
                waiting = []
            if now >= 0:
                owner[i] = now
            else:
                waiting.append(i)
        kept = np.flatnonzero(owner >= 0)
        scores = np.zeros((len(found), len(LANGUAGES)))
        np.add.at(scores, owner[kept], np.add.reduceat(self.rows[ids], starts, axis=0)[kept])
        chars = np.bincount(owner[kept], np.array(length)[kept] + 1, len(found)).astype(np.int64) - 1
        text, para, no = np.array(found, dtype=np.int64).reshape(-1, 3).T
        return text, para, no, chars, scores


def _judged(documents: DataFrame, model: Model, names: frozenset[str], change: float, report: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 500) -> DataFrame:
    """What ``report`` makes of the sentences of some whole documents: row (its number), doc_id, label, para_no, sentence_no, lang, confidence, n_chars."""
    shared = documents.sparkSession.sparkContext.broadcast((model, names))
    columns = [c.split()[0] for c in schema.split(", ")]

    def some(reader: Reader, batch: pd.DataFrame) -> pd.DataFrame:
        doc, para, no, chars, scores = reader.read(list(batch.text), list(batch.names) if "names" in batch else None)
        if not len(doc):
            return pd.DataFrame(columns=columns)
        path = np.empty(len(doc), int)
        for a, b in _runs(doc):
            path[a:b] = decode(scores[a:b], change)
        sure = posterior(scores, 0.3)[np.arange(len(path)), path]
        labels = np.array([label_language(x) for x in batch.lang], dtype=object)
        return report(pd.DataFrame({"row": doc, "doc_id": batch.doc_id.to_numpy()[doc], "label": labels[doc], "para_no": para, "sentence_no": no, "lang": np.array(LANGUAGES, dtype=object)[path], "confidence": sure, "n_chars": chars}))[columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*shared.value)
        for batch in batches:
            for at in range(0, len(batch), rows):
                yield some(reader, batch.iloc[at : at + rows])

    columns_in = ["doc_id", "lang", "text", *(["names"] if "names" in documents.columns else [])]
    return documents.select(*columns_in).filter("text is not null").mapInPandas(run, schema)


def segment(documents: DataFrame, model: Model, *, names: frozenset[str] = frozenset(), change: float = 16.0) -> DataFrame:
    """doc_id, label, para_no, sentence_no, lang, confidence, n_chars of every sentence with language."""
    return _judged(documents, model, names, change, lambda s: s, "doc_id long, label string, para_no int, sentence_no int, lang string, confidence double, n_chars int")


def _runs(owner: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(owner)) + 1
    return list(zip([0, *cuts], [*cuts, len(owner)]))


def document_languages(documents: DataFrame, model: Model, *, names: frozenset[str] = frozenset(), change: float = 16.0) -> DataFrame:
    """doc_id, label, lang (of most characters), confidence, n_languages."""

    def report(s: pd.DataFrame) -> pd.DataFrame:
        per = s.groupby(["row", "lang"], sort=True).agg(doc_id=("doc_id", "first"), label=("label", "first"), n=("n_chars", "sum"), confidence=("confidence", "mean")).reset_index()
        per["n_languages"] = per.groupby("row").lang.transform("count")
        return per.sort_values(["row", "n", "lang"], ascending=[True, False, True], kind="stable").drop_duplicates("row")

    return _judged(documents, model, names, change, report, "doc_id long, label string, lang string, confidence double, n_languages long")


def doubtful(documents: DataFrame, model: Model, *, names: frozenset[str] = frozenset(), change: float = 16.0) -> DataFrame:
    """doc_id, para_no, lang of documents whose label is missing or names none of their languages, or which have several."""

    def report(s: pd.DataFrame) -> pd.DataFrame:
        several = s.groupby("row").lang.transform("nunique") > 1
        right = (s.label == s.lang).groupby(s.row).transform("any")
        return s[several | ~right].drop_duplicates(["row", "para_no", "lang"])

    return _judged(documents, model, names, change, report, "doc_id long, para_no int, lang string")
