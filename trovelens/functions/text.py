"""Text functions as Columns: folding, tokens, names, query terms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of Latin-1 and Latin Extended-A that decompose to a base letter and marks.
_LATIN = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1]
_FROM, _TO = "".join(a for a, _ in _LATIN), "".join(b for _, b in _LATIN)

# What cameras and phones put before a number.
CAMERA_PREFIXES = ["img", "dsc", "dscn", "dscf", "pxl", "pict", "mvimg", "vid"]

# Function words of English and Spanish.
STOP_WORDS = (
    "a an the of in on at to for with and or my me that this these those from about where what which who when is "
    "was are were be it its some any el la los las un una unos unas de del al en y o con para por mi mis que este "
    "esta estos estas ese esa donde cual quien cuando es era son lo su sus"
).split()


def fold(text: Column) -> Column:
    """``text`` without the accents of Latin letters; stays in generated code."""
    return F.translate(F.regexp_replace(text, r"\p{M}+", ""), _FROM, _TO)


def trim_all(text: Column) -> Column:
    """``text`` without any white space at its ends, not only U+0020."""
    t = F.trim(text)  # most texts have only spaces there, and need no search for others
    ends = F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).otherwise(t)


def tokens(text: Column) -> Column:
    """Lower-case accent-free runs of letters and digits: what the keyword index holds."""
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))  # the same for ASCII texts, in less time
    return F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(F.regexp_extract_all(F.lower(fold(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def token_text(text: Column) -> Column:
    """``tokens`` joined by one space, made without an array of them."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.trim(F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(F.regexp_replace(F.lower(fold(text)), r"[^\p{L}\p{N}]+", " ")))


def camel_split(text: Column) -> Column:
    """A space between a lower-case letter and the upper-case letter after it."""
    return F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})", " ")


def match_words(text: Column) -> Column:
    """Accent-free words, also parted at camelCase, in lower case."""
    return F.regexp_extract_all(F.lower(camel_split(fold(text))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def name_words(path: Column) -> Column:
    """The words of a file's path, parted at delimiters and camelCase, joined by one space."""
    parts = F.split(F.regexp_replace(camel_split(path), r"[/_\-.\s]+", " "), " ")
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def query_terms(query: Column) -> Column:
    """Distinct content words in order: two characters or more and not a function word."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(tokens(query), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t)))


def question_terms(question: Column) -> Column:
    """Distinct lower-case words of three characters or more, accents kept."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda t: F.length(t) >= 3))


def is_lookup(terms: Column) -> Column:
    """Whether every term has a digit (and there is one)."""
    return (F.size(terms) > 0) & F.forall(terms, lambda t: t.rlike(r"\p{N}"))


def is_opaque_name(name: Column) -> Column:
    """Whether a file's name has no word in it: digits, hashes and camera names only."""
    stem = F.lower(F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1"))
    runs = F.regexp_extract_all(stem, F.lit(r"\p{IsAlphabetic}+"), F.lit(0))
    camera = F.array(*[F.lit(p) for p in CAMERA_PREFIXES])

    def is_word(run: Column) -> Column:
        long_enough = (F.length(run) >= 3) | ~run.rlike(r"^[\x00-\x7f]*$")
        hash_like = stem.rlike("[0-9]") & run.rlike("^[0-9a-f]+$")
        return long_enough & ~hash_like & ~F.array_contains(camera, run)

    return ~F.exists(runs, is_word)


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def sanitised(query: Column) -> Column:
    """Each white-space word quoted (inner quotes doubled), the last one a prefix."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(words) == 0, "").otherwise(F.concat(F.array_join(quoted, " "), F.lit("*")))
