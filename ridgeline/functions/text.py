"""String functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions import fixed


def _fold_table() -> tuple[str, str]:
    """Every letter of the Latin blocks whose compatibility decomposition begins with one ASCII character, and that character."""
    source, to = [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(chr(code))
            to.append(plain)
    return "".join(source), "".join(to)


_SOURCE, _TO = _fold_table()


def ascii_fold(text: Column) -> Column:
    """ASCII letters of a text; letters that do not decompose (o with a stroke, sharp s) are dropped."""
    return F.regexp_replace(F.translate(text, _SOURCE, _TO), "[^\\x00-\\x7F]", "")


def normalise_name(text: Column) -> Column:
    """Lower-case ASCII words of a name, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9\\s]", " "), "\\s+", " "))


def name_tokens(normal: Column) -> Column:
    """Words of a normalised name that tell something; all words of two letters or more if none does."""
    words = F.filter(F.split(normal, " "), lambda w: F.length(w) > 1)
    telling = F.filter(words, lambda w: ~w.isin(fixed.STOPWORDS))
    return F.when(F.size(telling) > 0, telling).otherwise(words)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 for equal texts, else 1 - edits / longer length; 0 if one is empty or more than half longer."""
    longer = F.greatest(F.length(a), F.length(b))
    far = F.abs(F.length(a) - F.length(b)) / longer > 0.5
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0) | far, 0.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def name_similarity(query: Column, candidate: Column) -> Column:
    """Of two normalised names: the better of the whole and the words, words weighted by how much of the candidate they cover."""
    qt, ct = F.array_distinct(name_tokens(query)), F.array_distinct(name_tokens(candidate))
    best = F.transform(qt, lambda q: F.array_max(F.transform(ct, lambda c: edit_ratio(q, c))))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(qt)
    by_word = mean * F.pow(F.least(F.lit(1.0), F.size(qt) / F.size(ct)), F.lit(0.25))
    whole = edit_ratio(query, candidate)
    return F.when((query == "") | (candidate == ""), 0.0).when(query == candidate, 1.0).when((F.size(qt) == 0) | (F.size(ct) == 0), whole).otherwise(F.greatest(whole, by_word))


def slug(text: Column, length: int = 40) -> Column:
    """Letters and digits of a text joined by hyphens, case kept."""
    joined = F.regexp_replace(F.regexp_replace(ascii_fold(text), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(joined, 1, length), "-+$", "")


def safe_label(text: Column, length: int = 60) -> Column:
    """A text usable as a folder name on any system."""
    plain = F.regexp_replace(ascii_fold(text), fixed.UNSAFE_CHARS, " ")
    plain = F.regexp_replace(F.regexp_replace(plain, "[\\s._-]+", "_"), "^_+|_+$", "")
    plain = F.when(F.upper(plain).isin(fixed.RESERVED_NAMES), F.concat(plain, F.lit("_place"))).otherwise(plain)
    return F.regexp_replace(F.substring(plain, 1, length), "[_. ]+$", "")


def long_words(text: Column) -> Column:
    """Number of words of four Latin letters or more."""
    return F.size(F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ɏ]{4,}"), F.lit(0)))


def is_specific(name: Column) -> Column:
    """Two words or eleven characters, with a word of five that is no article and no generic."""
    words = F.filter(F.transform(F.split(F.trim(name), "\\s+"), lambda w: F.regexp_replace(w, "^[-–—]+|[-–—]+$", "")), lambda w: w != "")
    core = F.exists(words, lambda w: (F.length(w) >= 5) & ~F.lower(w).isin(fixed.ARTICLES + fixed.GENERIC))
    return ((F.size(words) >= 2) | ((F.size(words) == 1) & (F.length(name) >= 11))) & core


def followed_by_grade(name: Column, text: Column) -> Column:
    """Whether the name stands in the text with a climbing grade after it."""
    quoted = F.concat(F.lit("(?i)\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E[\\s:.,\\-]{0,4}\\(?" + fixed.GRADE + fixed.GRADE_END))
    return F.coalesce((F.length(name) > 0) & F.regexp_like(text, quoted), F.lit(False))


def blacklisted(text: Column, terms: list[str]) -> Column:
    """The first of ``terms`` that is a whole word of the text."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.get(F.filter(F.array(*map(F.lit, terms)), lambda t: F.array_contains(words, F.lower(t))), F.lit(0))


def human_bytes(n: Column) -> Column:
    """A size in the largest unit below 1024."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        out = out.when((n < 1024 ** (k + 1)) | (F.lit(unit) == "TB"), F.concat(F.format_string("%.1f", F.round(n / float(1024**k), 1)), F.lit(f" {unit}")))
    return out


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; '' for none (a leading dot is no extension)."""
    return F.lower(F.regexp_extract(base_name(path), "[^.].*(\\.[^.]*)$|^[^.](\\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), "(?<=.)\\.[^.]*$", "")


def toml_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
