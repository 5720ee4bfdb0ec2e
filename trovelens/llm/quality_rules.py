"""Line-first quality rules: judge and remove lines, then reject documents that lose too much."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.llm.columns import documents, needed, rows

SYMBOLS = "[#*$%&|<>]"
SENTENCE = "[.!?:;…。！？]"
#: Lines that say only this, in one of four languages, are navigation.
NAVIGATION = (
    r"^[^A-Za-z]*(home|menu|next|next page|previous|previous page|back|back to top|log ?in|sign ?in|sign ?up|register|"
    r"search|contact|contact us|about|about us|read more|click here|share|top|skip to content|continue reading|"
    r"accueil|suivant|page suivante|retour|connexion|rechercher|lire la suite|partager|haut de page|"
    r"startseite|weiter|zur.ck|nach oben|anmelden|registrieren|suche|kontakt|mehr lesen|weiterlesen|teilen|"
    r"inicio|siguiente|anterior|volver|volver arriba|iniciar sesi.n|registrarse|buscar|contacto|leer m.s|compartir)[^A-Za-z]*$"
)
#: Lines that hold this are boilerplate.
BOILERPLATE = (
    r"(all rights reserved|terms of (use|service)|privacy policy|cookie|subscribe|javascript|lorem ipsum|"
    r"licensed under|copyright (\(c\)|©|[0-9]{4})|"
    r"tous droits r.serv|mentions l.gales|politique de confidentialit|conditions d.utilisation|"
    r"alle rechte vorbehalten|datenschutzerkl|impressum|nutzungsbedingungen|"
    r"todos los derechos reservados|aviso legal|pol.tica de privacidad|t.rminos de uso)"
)
_HINTS = (
    "rights", "terms of", "policy", "cookie", "subscribe", "script", "lorem", "licen", "copyright",
    "droits", "mentions", "confidentialit", "conditions", "rechte", "datenschutz", "impressum", "nutzungs", "derechos", "aviso", "privacidad", "de uso",
)
MIN_WORDS, LONG_LINE, DISTINCT = 50, 10, 4

_SYMBOL, _SENTENCE = re.compile(SYMBOLS), re.compile(SENTENCE)
_NAVIGATION = re.compile(NAVIGATION, re.I | re.A)
_BOILERPLATE = re.compile(BOILERPLATE, re.I | re.A)
_SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, lost_chars long, clean_text string"


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included; exact."""
    n = len(words)
    if n < 4:
        return 0
    index: dict = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    v = len(index)
    if v == n:
        return 0
    pair = ids[:-1] * v + ids[1:]
    if v > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * v + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def line_fails(line: str, words: list, symbols: bool = True, hinted: bool = True) -> bool:
    """Whether a line with words breaks a rule on symbols, shouting, sentences, repetition, navigation or boilerplate."""
    n = len(words)
    if symbols and 3 * len(_SYMBOL.findall(line)) > n or line.count("!") > n:
        return True
    if n >= LONG_LINE and (not _SENTENCE.search(line) or DISTINCT * len(set(words)) < n):
        return True
    return bool(n <= 5 and _NAVIGATION.search(line)) or bool(hinted and _BOILERPLATE.search(line))


def measure(text: str) -> tuple:
    """The counts of a text, base_failed, kept, the word characters of failed lines and the lines that stay."""
    words = text.encode("utf-8").split()  # on bytes: exactly space and 09-0D
    lower = text.lower()
    hinted = any(h in lower for h in _HINTS)
    symbols = len(_SYMBOL.findall(text))
    seen: set[str] = set()
    dup = lost = 0
    stay = []
    for line in text.split("\n"):
        own = line.encode("utf-8").split()
        if not own:
            stay.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if again or line_fails(line, own, symbols > 0, hinted):
            lost += len(line.translate(_SPACES))
        else:
            stay.append(line)
    chars = len(text.translate(_SPACES))
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > 50 * len(words)
    return len(words), chars, symbols, dup, repeats, failed, not failed and 2 * lost <= chars, lost, "\n".join(stay)


def cleaned(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, the verdicts and the text without the lines that failed.

    A null or empty text has no words, so it fails the base rules. A null doc_id is carried through;
    ties and repeated rows are judged alike, each on its own. Lines are looked at one at a time, so
    memory follows the longest text. Other columns are ignored.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches, "doc_id", "text"):
            found = list(zip(*[measure(t or "") for t in texts], strict=True))
            columns = [pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in found[:5]]]
            columns += [pa.array(found[5], pa.bool_()), pa.array(found[6], pa.bool_()), pa.array(found[7], pa.int64()), pa.array(found[8], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "kept", "lost_chars", "clean_text"])

    return needed(docs, "doc_id", "text").mapInArrow(judge, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(documents(spark, sf_dir)).select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l1 AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws,
  row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again FROM l0),
l2 AS (SELECT doc_id, again, len(ws) AS n, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
  again OR 3 * len(regexp_extract_all(line, '{SYMBOLS}')) > len(ws) OR length(line) - length(replace(line, '!', '')) > len(ws)
  OR (len(ws) >= {LONG_LINE} AND (NOT regexp_matches(line, '{SENTENCE}') OR {DISTINCT} * len(list_distinct(ws)) < len(ws)))
  OR (len(ws) <= 5 AND regexp_matches(line, '(?i){NAVIGATION}')) OR regexp_matches(line, '(?i){BOILERPLATE}') AS fails
  FROM l1 WHERE len(ws) > 0),
l AS (SELECT doc_id, count(*) FILTER (WHERE again) AS dup, coalesce(sum(chars) FILTER (WHERE fails), 0) AS lost FROM l2 GROUP BY 1),
p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS pos FROM w),
g AS (SELECT doc_id, pos, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, x, y, z) AS c FROM g WHERE z IS NOT NULL),
rw AS (SELECT doc_id, count(DISTINCT q) AS rep FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS q FROM r WHERE c >= 2) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words,
  coalesce(lost, 0) AS lost FROM w LEFT JOIN l USING (doc_id) LEFT JOIN rw USING (doc_id)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 2 * lost <= word_chars AS kept FROM v
"""
