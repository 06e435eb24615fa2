"""Repair of text read from photographed pages.

Four kinds of noise are found per line: words broken at the line's end
(``hyphen``), words with wrong characters (``misread``), running titles
(``header``) and page numbers (``page_no``). The repaired text has none of them
and is reflowed into paragraphs.

Words with wrong characters: a word that the vocabulary does not hold is run
through the vocabulary's trie together with a Levenshtein automaton that knows
the usual confusions of characters as cheap moves (one character for another,
two for one, one for two), so every word within the cost limit is retrieved, not
a sample. Candidates are ranked by cost, by how often they follow the word before
and precede the word after in the clean texts, and by frequency. The vocabulary
comes from clean texts and a gazetteer. It is never broadcast: unknown words
(each once) and shards of the vocabulary meet in a co-grouped join.

Running titles: lines in capitals, letter-spaced, indented or beside a page
number are titles by their form; other short lines that stand outside the
sentences are titles if their folded form (confusable characters made equal) is
one that title forms elsewhere in the corpus have.

Broken words: a hyphen sign that only breaks words decides alone; a plain hyphen
does not count if the hyphenated word is more frequent in the clean texts than
the joined one, or if only its two halves are words.

Defined cases: null, empty and blank texts have no case and repair to ''; a
word without a candidate stays as it is; ties between candidates go to the
first in the alphabet; repeated keys keep a result each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import cut

#: Characters and how a reading machine confuses them (right, read).
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("o", "0"), ("t", "f"), ("f", "t"), ("i", "!"), ("l", "!"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("g", "9"), ("q", "9"), ("s", "5"), ("b", "8"), ("b", "6"), ("z", "2"),
    ("h", "b"), ("b", "h"), ("é", "6"), ("è", "6"), ("ó", "6"), ("ö", "6"), ("ò", "6"), ("å", "ä"), ("ä", "å"), ("ø", "o"), ("ß", "B"), ("n", "u"), ("u", "n"), ("u", "v"), ("v", "u"), ("a", "o"), ("o", "a"), ("o", "c"), ("c", "o"),
    ("u", "ll"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("ü", "ii"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"), ("ri", "n"), ("n", "ri"), ("in", "m"), ("m", "in"), ("ni", "m"), ("nn", "m"),
]
BREAKS = "-¬­‐‑"
#: Signs that only ever break a word.
SURE_BREAKS = "¬­‐‑"
EDGE = ".,;:()[]{}\"«»“”„’‘'?…·–—"
_ROMAN = r"[ivxlc]{1,7}"
_NUMBER = rf"(?:\d{{1,4}}|{_ROMAN})"
_PAGE_NO = regex.compile(rf"^\s*(?:[·\-–—\[(*|~]\s*)?(?:(?:pag|pág|page|seite|side|página|pagina|[sp])\.?\s*)?{_NUMBER}(?:\s*/\s*\d{{1,4}})?(?:\s*[·\-–—\])*|~])?\s*$", regex.I)
_TITLE_LEFT = regex.compile(rf"^\s*({_NUMBER})\s{{2,}}(\S.*?)\s*$")
_TITLE_RIGHT = regex.compile(rf"^\s*(\S.*?)\s{{2,}}({_NUMBER})\s*$")
_CODE = regex.compile(r"^(?:[A-Za-z]?\d+[a-c]?[+\-]?|[IVX]+[+\-]?|\d+[.,:]\d+|\d+\s?m)$")
_ENDED = regex.compile(r"[.!?…][\"»”’)\]]*\s*$")
#: Confusable characters that a title's folded form holds equal.
_FOLD = str.maketrans({"0": "o", "6": "o", "é": "o", "è": "o", "e": "o", "c": "o", "ö": "o", "ó": "o", "ò": "o", "1": "l", "!": "l", "i": "l", "í": "l", "5": "s", "9": "g", "q": "g", "8": "b", "h": "b", "f": "t", "å": "a", "ä": "a", "à": "a", "ü": "u", "ù": "u", "ú": "u"})


def n_letters(text: str) -> int:
    return sum(map(str.isalpha, text))


def letter_spaced(line: str) -> bool:
    tokens = line.split()
    return len(tokens) >= 5 and sum(len(t) == 1 for t in tokens) >= 0.75 * len(tokens)


def closed_up(line: str) -> str:
    """A letter-spaced line with its letters together again: blanks part letters, two or more part words."""
    return " ".join("".join(w.split()) for w in regex.split(r"\s{2,}", line.strip())) if letter_spaced(line) else " ".join(line.split())


def title_key(line: str) -> str:
    """Folded form of a title without its page number."""
    text = closed_up(strip_number(line)[0]).lower()
    for read, right in (("rn", "m"), ("ll", "u"), ("vv", "w"), ("ii", "u"), ("in", "m"), ("ni", "m"), ("nn", "m"), ("li", "b"), ("cl", "d"), ("ri", "n")):
        text = text.replace(read, right)
    return "".join(regex.findall(r"[\p{L}\p{N}]", text.translate(_FOLD)))


def strip_number(line: str) -> tuple[str, bool]:
    """A title without the page number beside it; whether it had one."""
    for pattern, group in ((_TITLE_LEFT, 2), (_TITLE_RIGHT, 1)):
        m = pattern.match(line)
        if m and n_letters(m[group]) >= 4 and not _ENDED.search(m[group]):
            if letter_spaced(m[group]) and not regex.search(r"\s{4,}", line.strip()):
                continue
            return m[group], True
    return line.strip(), False


def is_code(line: str) -> bool:
    """A line without words: grades, heights, times, pitches."""
    return not any(n_letters(t) >= 3 for t in line.split()) and not letter_spaced(line)


def line_forms(lines: list[str]) -> list[tuple[str, bool]]:
    """For each line: ``blank``, ``page_no``, ``title`` (by its form), ``maybe`` (a title if the corpus knows it) or ``text``, and whether a page number stands beside it."""
    out: list[tuple[str, bool]] = []
    # a page holds sentences; a sign or a bare list has no running title
    worded = (x for x in lines if sum(n_letters(t) >= 2 for t in x.split()) >= 3)
    page = next(worded, None) is not None and next(worded, None) is not None
    prev_open = False
    for line in lines:
        if not line.strip():
            out.append(("blank", False))
            continue
        title, numbered = strip_number(line)
        letters = [c for c in title if c.isalpha()]
        capital = len(letters) >= 5 and sum(x.isupper() or not x.islower() for x in letters) >= 0.85 * len(letters)
        if page and _PAGE_NO.match(line):
            out.append(("page_no", False))
        elif page and (numbered or letter_spaced(title) or capital or (line[:2].isspace() and not _ENDED.search(line) and len(letters) >= 4)) and not is_code(title):
            out.append(("title", numbered))
        elif page and not prev_open and not _ENDED.search(line) and line.strip()[-1] not in BREAKS + ",;:" and len(line.split()) <= 9 and len(letters) >= 4 and not is_code(line):
            out.append(("maybe", False))
            prev_open = True
            continue
        else:
            out.append(("text", False))
            prev_open = not _ENDED.search(line) and not is_code(line)
            continue
    return out


def bare(token: str) -> str:
    """A token without punctuation around it, in lower case; an exclamation mark may be a letter misread and stays."""
    return token.strip(EDGE).lower()


def checkable(word: str) -> bool:
    """Whether a word can be judged: two letters, no code, not only digits."""
    return n_letters(word) >= 2 and not _CODE.match(word) and (len(word) >= 3 or any(c.isdigit() or c == "!" for c in word))


def page_words(lines: list[str], forms: list[str]) -> Iterator[tuple]:
    """Words of the sentences: (line, next line or -1, cut, word, half before, half after, break sign, word before, word after); broken words are put together, ``cut`` is the length of their first half."""
    flow: list[tuple] = []
    skip_first = False
    body = [i for i, f in enumerate(forms) if f in ("text", "maybe") and not is_code(lines[i])]
    for n, i in enumerate(body):
        tokens = lines[i].split()
        if skip_first:
            tokens = tokens[1:]
        skip_first = False
        for k, token in enumerate(tokens):
            last = k == len(tokens) - 1
            if last and len(token) > 1 and token[-1] in BREAKS and (token[-2].isalpha() or token[-2] in "01!569"):
                after = lines[body[n + 1]].split() if n + 1 < len(body) else []
                if after and (after[0][0].islower() or after[0][0] in "01!569"):
                    a, b = token[:-1].lstrip(EDGE).lower(), after[0].rstrip(EDGE).lower()
                    flow.append((i, body[n + 1], len(a), a + b, a, b, token[-1]))
                    skip_first = True
                    continue
                if token[-1] in SURE_BREAKS:
                    flow.append((i, -1, len(token) - 1, bare(token[:-1]), token[:-1].lower(), "", token[-1]))
                    continue
            word = bare(token)
            if word.endswith("!"):  # a letter misread if the sentence goes on
                later = tokens[k + 1 :] or (lines[body[n + 1]].split() if n + 1 < len(body) else [])
                if not (later and later[0].lstrip(EDGE)[:1].islower()):
                    word = word.rstrip("!")
            if word:
                flow.append((i, -1, 0, word, "", "", ""))
    for n, x in enumerate(flow):
        yield (*x, flow[n - 1][3] if n else "", flow[n + 1][3] if n + 1 < len(flow) else "")


# --- vocabulary and candidates ---------------------------------------------


def clean_words(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """doc words in their order, as one array per text, in lower case without punctuation at their edges; and the columns ``keep``."""
    tokens = F.split(F.lower(F.regexp_replace(F.col(text), "\\p{Cf}", "")), r"[\s ]+")
    return texts.filter(F.col(text).isNotNull()).select(F.filter(F.transform(tokens, lambda t: F.btrim(t, F.lit(EDGE + "!"))), lambda t: t != "").alias("words"), *keep)


def vocabulary(words: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """word, n of the words of clean texts that stand there ``least`` times, and of all names, which count once more than they stand in the texts."""
    counts = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    named = clean_words(names, "name").select(F.explode("words").alias("word")).distinct().withColumn("_named", F.lit(1).cast("bigint"))
    both = counts.join(named, "word", "full").filter((F.col("n") >= least) | F.col("_named").isNotNull())
    return cut(both.select("word", (F.coalesce("n", F.lit(0)) + F.coalesce("_named", F.lit(0))).alias("n")))


class Trie:
    """A vocabulary as nested dicts; a word's count stands under the empty key."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        self.root: dict = {}
        for w, n in zip(words, counts):
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = n
        self.single: dict[str, list[str]] = {}
        self.pair: dict[str, list[str]] = {}
        for right, read in CONFUSIONS:
            (self.single if len(right) == 1 else self.pair).setdefault(right, []).append(read)

    def search(self, word: str, limit: int = 2) -> list[tuple[str, int, int]]:
        """(candidate, cost, count) of every word of the vocabulary that the automaton of ``word`` accepts within ``limit``: a confusion costs 1, any other change of a character 2, a digit or ! in place of a letter 1."""
        size = len(word)
        odd = [c.isdigit() or c == "!" for c in word]
        found: dict[str, tuple[int, int]] = {}

        def close(states: dict[int, int]) -> dict[int, int]:
            # characters of the word that the candidate does not have
            i, last = min(states), max(states)
            while i <= last and i < size:
                if i in states and states[i] + 2 <= limit and states.get(i + 1, 99) > states[i] + 2:
                    states[i + 1] = states[i] + 2
                    last = max(last, i + 1)
                i += 1
            return states

        def put(to: dict[int, int], i: int, cost: int) -> None:
            if cost <= limit and to.get(i, 99) > cost:
                to[i] = cost

        stack = [(self.root, "", close({0: 0}), {})]
        while stack:
            node, prefix, states, early = stack.pop()
            if "" in node and size in states:
                if prefix not in found or found[prefix][0] > states[size]:
                    found[prefix] = (states[size], node[""])
            for ch, child in node.items():
                if ch == "":
                    continue
                nxt: dict[int, int] = dict(early.get(ch, {}))
                for i, cost in states.items():
                    if i < size:
                        put(nxt, i + 1, cost + (0 if word[i] == ch else 1 if odd[i] or word[i] in self.single.get(ch, ()) else 2))
                    put(nxt, i, cost + 2)
                    for read in self.single.get(ch, ()):
                        if len(read) == 2 and word.startswith(read, i):
                            put(nxt, i + 2, cost + 1)
                # two characters of the candidate read as one: known a step ahead
                ahead: dict[str, dict[int, int]] = {}
                for pair, reads in self.pair.items():
                    if pair[0] == ch:
                        for i, cost in states.items():
                            for read in reads:
                                if word.startswith(read, i):
                                    put(ahead.setdefault(pair[1], {}), i + len(read), cost + 1)
                if nxt or ahead:
                    stack.append((child, prefix + ch, close(nxt) if nxt else {}, ahead))
        return sorted(((w, c, n) for w, (c, n) in found.items()), key=lambda x: (x[1], -x[2], x[0]))


def candidates(unknown: DataFrame, vocab: DataFrame, *, part_words: int = 2000, shard_words: int = 100_000, limit: int = 2) -> DataFrame:
    """word, candidate, cost, n of all vocabulary words near each unknown word; a task has about ``part_words`` of the one and ``shard_words`` of the other."""
    shards, parts = (max(1, -(-df.count() // most)) for df, most in ((vocab, shard_words), (unknown, part_words)))
    w = unknown.select("word", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    v = vocab.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            trie = Trie(list(right.word), list(right.n))
            rows = [(word, c, cost, n) for word in left.word for c, cost, n in trie.search(word, limit)]
        return pd.DataFrame(rows, columns=["word", "candidate", "cost", "n"])

    return w.groupBy("part", "shard").cogroup(v.groupBy("part", "shard")).applyInPandas(meet, "word string, candidate string, cost int, n long")


# --- analysis of pages ------------------------------------------------------


def pages_of(*tables: tuple[str, DataFrame, str, str]) -> DataFrame:
    """table_name, row_key, text of several tables given as (name, rows, key, text)."""
    out = None
    for name, df, key, text in tables:
        rows = df.select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("row_key"), F.col(text).alias("text")).filter(F.trim(F.translate("text", "\n\t\r", "   ")) != "")
        out = rows if out is None else out.unionByName(rows)
    return out


_READ = "what string, table_name string, row_key long, line_no int, form string, numbered boolean, title string, next_line int, cut int, word string, half_a string, half_b string, sign string, before string, after string, maybe string, maybe_next string"


def read_pages(pages: DataFrame, frequent: frozenset[str]) -> tuple[DataFrame, DataFrame]:
    """In one pass over the pages: the lines that are furniture or may be (form, whether a number stands beside, title key), and the words to judge, which are broken ones and those not among the ``frequent`` (a bounded set that only saves rows). A word on a line that may be a title names its key."""
    shared = pages.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            rows = []
            for t, k, text in zip(b.table_name, b.row_key, b.text):
                lines = text.split("\n")
                forms = line_forms(lines)
                keys = [title_key(line) if form in ("title", "maybe") else "" for line, (form, _) in zip(lines, forms)]
                for i, (form, numbered) in enumerate(forms):
                    if form in ("page_no", "title", "maybe"):
                        rows.append(("line", t, k, i + 1, form, numbered, keys[i], -1, 0, "", "", "", "", "", "", "", ""))
                plain = [form for form, _ in forms]
                for i, nxt, cut_at, word, half_a, half_b, sign, before, after in page_words(lines, plain):
                    if sign or (word not in known and checkable(word)):
                        maybe = [keys[j] if j >= 0 and plain[j] == "maybe" else "" for j in (i, nxt)]
                        rows.append(("word", t, k, i + 1, "", False, "", nxt + 1 if nxt >= 0 else -1, cut_at, word, half_a, half_b, sign, before, after, *maybe))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _READ.split(", ")])

    read = cut(pages.mapInPandas(run, _READ))
    page = ["table_name", "row_key", "line_no"]
    return read.filter("what = 'line'").select(*page, "form", "numbered", "title"), read.filter("what = 'word'").drop("what", "form", "numbered", "title")


def _wrong_lines(word: str, right: str, cut_at: int) -> tuple[bool, bool]:
    """Whether the wrong characters stand in the first and in the second half of a broken word."""
    same = 0
    while same < min(len(word), len(right)) and word[same] == right[same]:
        same += 1
    tail = 0
    while tail < min(len(word), len(right)) - same and word[len(word) - 1 - tail] == right[len(right) - 1 - tail]:
        tail += 1
    end = max(len(word) - tail, same + 1)
    return (same < cut_at or not cut_at, bool(cut_at) and end > cut_at)


def analyse(pages: DataFrame, clean: DataFrame, names: DataFrame, *, frequent: int = 20_000, limit: int = 2, ratio: float = 20.0, few_pairs: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Cases (table_name, row_key, line_no, noise_kind) and repairs (table_name, row_key, line_no, word, right, cut, sign) of pages.

    ``clean`` has a column ``text`` of clean texts, ``names`` a column ``name``. At most the ``frequent`` most frequent words go to the executors as a set; whether a word is known is decided by a join with the whole vocabulary.
    """
    words = clean_words(clean, "text")
    vocab = vocabulary(words, names)
    top = frozenset(r["word"] for r in vocab.orderBy(F.desc("n"), "word").limit(frequent).collect())
    page = ["table_name", "row_key"]

    lines, judged = read_pages(pages, top)
    sure = lines.filter("form = 'title' and length(title) >= 4").groupBy("title").agg(F.count("*").alias("forms"))
    maybe = lines.filter("form = 'maybe'").join(sure.select("title"), "title", "left_semi")
    headers = lines.filter("form = 'title'").select(*page, "line_no", "numbered").unionByName(maybe.select(*page, "line_no", "numbered"))
    cases = headers.select(*page, "line_no", F.lit("header").alias("noise_kind"))
    cases = cases.unionByName(headers.filter("numbered").select(*page, "line_no", F.lit("page_no").alias("noise_kind")))
    cases = cases.unionByName(lines.filter("form = 'page_no'").select(*page, "line_no", F.lit("page_no").alias("noise_kind")))

    titles = sure.select(F.col("title").alias("maybe"), F.lit(True).alias("_t"))
    # lines that turned out to be titles are no sentences
    judged = cut(judged.join(titles, "maybe", "left").filter("_t is null").drop("_t"))
    count_of = lambda name: vocab.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    broken = judged.filter("sign <> ''").withColumn("hyphened", F.concat_ws("-", "half_a", "half_b"))
    broken = broken.join(count_of("word"), "word", "left").join(count_of("hyphened"), "hyphened", "left").join(count_of("half_a"), "half_a", "left").join(count_of("half_b"), "half_b", "left")
    n = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(0))
    own_hyphen = (F.col("sign") == "-") & ((n("hyphened") > n("word")) | ((n("word") == 0) & (n("half_a") > 0) & (n("half_b") > 0) & (F.length("half_a") > 2) & (F.length("half_b") > 2)))
    broken = cut(broken.withColumn("own", own_hyphen))
    cases = cases.unionByName(broken.filter("not own").select(*page, "line_no", F.lit("hyphen").alias("noise_kind")))

    # every unknown word once
    whole = judged.filter("sign = ''").select(*page, "line_no", F.lit(-1).alias("next_line"), F.lit(0).alias("cut"), "word", "sign", "before", "after")
    joined = broken.filter("not own").select(*page, "line_no", "next_line", "cut", "word", "sign", "before", "after")
    # a word with a hyphen of its own is one word, with the hyphen
    own = broken.filter("own").select(*page, "line_no", "next_line", (F.col("cut") + 1).alias("cut"), F.col("hyphened").alias("word"), "sign", "before", "after")
    spots = whole.unionByName(joined).unionByName(own).filter("length(word) >= 2")
    spots = cut(spots.join(vocab.select("word"), "word", "left_anti"))
    # texts that have it: copies of a page are no further evidence
    copy = F.xxhash64("text").alias("copy")
    unknown = cut(spots.select(*page, "word").distinct().join(pages.select(*page, copy), page).groupBy("word").agg(F.count_distinct("copy").alias("seen")))
    near = cut(candidates(unknown, vocab, limit=limit).join(unknown, "word"))
    # a word that reads otherwise must be far more frequent, in the clean texts and where it is read right on the pages, than the form on the pages, but for names and odd characters; up to 3 texts are too few to tell
    odd = F.col("word").rlike(r"[0-9!]")
    enough = lambda n: odd | (n >= ratio * F.col("seen")) | ((F.col("cost") <= 1) & (F.col("seen") <= F.greatest(F.lit(3), n)))
    asked_for = near.filter(~enough(F.col("n"))).select("candidate").distinct()
    read = clean_words(pages.select("text", copy), "text", "copy").select("copy", F.explode(F.array_distinct("words")).alias("candidate"))
    read = read.join(asked_for, "candidate", "left_semi").groupBy("candidate").agg(F.count_distinct("copy").alias("n_read"))
    near = cut(near.join(read, "candidate", "left").filter(enough(F.col("n") + F.coalesce("n_read", F.lit(0)))).drop("n_read"))
    # context: how often the candidate follows the word before, and precedes the word after, in the clean texts
    asked = spots.join(near.select("word", "candidate", "cost", "n"), "word").filter("length(word) >= 2")
    several = Window.partitionBy(*page, "line_no", "word", "before", "after")
    asked = cut(asked.withColumn("choices", F.count("*").over(several)))
    open_pairs = asked.filter("choices > 1")
    ends = F.size("words") - 1
    grams = F.explode(F.arrays_zip(F.slice("words", F.lit(1), ends).alias("a"), F.slice("words", F.lit(2), ends).alias("b"))).alias("g")
    wanted = cut(open_pairs.select(F.col("before").alias("a"), F.col("candidate").alias("b")).unionByName(open_pairs.select(F.col("candidate").alias("a"), F.col("after").alias("b"))).distinct())
    pairs = words.filter("size(words) > 1").select(grams).select("g.*")
    # few pairs asked for are looked up before counting; more meet the counts of all pairs
    if wanted.count() <= few_pairs:
        pairs = pairs.join(F.broadcast(wanted), ["a", "b"], "left_semi")
    bigrams = cut(pairs.groupBy("a", "b").agg(F.count("*").alias("n_pair")).join(wanted, ["a", "b"], "left_semi"))
    left = bigrams.select(F.col("a").alias("before"), F.col("b").alias("candidate"), F.col("n_pair").alias("n_left"))
    right = bigrams.select(F.col("a").alias("candidate"), F.col("b").alias("after"), F.col("n_pair").alias("n_right"))
    ranked = asked.join(left, ["before", "candidate"], "left").join(right, ["candidate", "after"], "left")
    context = F.log1p(F.coalesce("n_left", F.lit(0))) + F.log1p(F.coalesce("n_right", F.lit(0)))
    score = context + 0.3 * F.log1p("n") - 2.5 * F.col("cost")
    spot = [*page, "line_no", "next_line", "cut", "word", "sign", "before", "after"]
    best = ranked.groupBy(*spot).agg(F.min_by("candidate", F.struct(-score, F.col("candidate"))).alias("right"))
    schema = "table_name string, row_key long, line_no int, next_line int, cut int, word string, sign string, before string, after string, right string, in_first boolean, in_second boolean"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            where = [_wrong_lines(w, r, c) for w, r, c in zip(b.word, b.right, b.cut)]
            yield b.assign(in_first=[x for x, _ in where], in_second=[y for _, y in where])

    fixed = cut(best.mapInPandas(place, schema))
    cases = cases.unionByName(fixed.filter("in_first").select(*page, "line_no", F.lit("misread").alias("noise_kind")))
    cases = cases.unionByName(fixed.filter("in_second").select(*page, F.col("next_line").alias("line_no"), F.lit("misread").alias("noise_kind")))
    repairs = fixed.select(*page, "line_no", "word", "right", F.lit("word").alias("what"))
    repairs = repairs.unionByName(broken.select(*page, "line_no", "word", F.col("sign").alias("right"), F.when(F.col("own"), "own").otherwise("join").alias("what")))
    repairs = repairs.unionByName(headers.select(*page, "line_no", F.lit("").alias("word"), F.lit("").alias("right"), F.lit("drop").alias("what")))
    return cases.distinct(), repairs


def noise(pages: DataFrame, clean: DataFrame, names: DataFrame, **options) -> DataFrame:
    """table_name, row_key, line_no, noise_kind."""
    return analyse(pages, clean, names, **options)[0]


def _like(word: str, right: str) -> str:
    """``right`` in the case of ``word``."""
    return right.upper() if len(word) > 1 and word.isupper() else right[:1].upper() + right[1:] if word[:1].isupper() else right


def reflow(text: str, fixes: dict[tuple[int, str], str], own: set[int], dropped: set[int]) -> str:
    """Paragraphs of a page: furniture dropped, broken words joined, misread words replaced, wraps undone."""
    lines = text.split("\n")
    forms = [f for f, _ in line_forms(lines)]
    paras: list[list[str]] = [[]]
    open_break = ""
    for i, line in enumerate(lines):
        if forms[i] in ("page_no", "title") or i + 1 in dropped:
            continue
        if forms[i] == "blank":
            if paras[-1] and not open_break:
                paras.append([])
            continue
        for token in line.split():
            no = i + 1
            if open_break:
                head, no, glue = open_break
                paras[-1].pop()
                token = head + glue + token
                open_break = ""
            core = token.strip(EDGE)
            right = fixes.get((no, core.lower()))
            if right is not None and core:
                at = token.find(core)
                token = token[:at] + _like(core, right) + token[at + len(core) :]
            paras[-1].append(token)
        last = line.split()[-1]
        if len(last) > 1 and last[-1] in BREAKS and any(forms[j] in ("text", "maybe") and j + 1 not in dropped for j in range(i + 1, len(lines))):
            open_break = (paras[-1][-1][:-1], i + 1, "-" if i + 1 in own else "")
    return "\n\n".join(" ".join(p) for p in paras if p)


def repaired(pages: DataFrame, clean: DataFrame, names: DataFrame, **options) -> DataFrame:
    """table_name, row_key, text of continuous paragraphs."""
    _, repairs = analyse(pages, clean, names, **options)
    page = ["table_name", "row_key"]
    # a page's repairs are bounded by its lines and words
    lists = repairs.groupBy(*page).agg(F.collect_set(F.struct("line_no", "word", "right", "what")).alias("repairs"))
    rows = pages.join(lists, page, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, found in zip(b.text, b.repairs):
                found = [] if found is None else list(found)
                fixes = {(r["line_no"], r["word"]): r["right"] for r in found if r["what"] == "word"}
                own = {r["line_no"] for r in found if r["what"] == "own"}
                dropped = {r["line_no"] for r in found if r["what"] == "drop"}
                out.append(reflow(text, fixes, own, dropped))
            yield b[page].assign(text=out)

    return rows.mapInPandas(run, "table_name string, row_key long, text string")
