"""Byte-pair encoding by dynamic programming over prefixes, and decoding, exact to the token id."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from trovelens.llm.columns import documents, needed, rows

VOCABULARY = "word_bpe_49k.json"
#: Bounds of a worker's memory of words; longer words are never kept.
WORDS_KEPT, PIECES_KEPT, PAIRS_KEPT, LONGEST_KEPT = 50_000, 250_000, 500_000, 64
#: str.split() parts at these; the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Texts of these characters only are in normal form, have one lower-case letter for each upper-case one and are cut by one pattern.
_LATIN = re.compile("[\x00-\x1b\x20-\x7eÀ-ÖØ-öø-įı-ſ‐-‧]*")
_LATIN_PIECES = re.compile("[a-zß-öø-įı-ſ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s0-9a-zß-öø-įı-ſ]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Kept(dict):
    """A dictionary that makes what it lacks. When it is full, what it holds becomes the older half; what is not asked for until it is full again goes."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = made
        return made


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes as themselves, others from 256 up."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Encodes with a word-end BPE vocabulary whose ids follow the order of its merges.

    A word is a string of symbols, one for each byte, the last one marked as the word's end. Two
    tokens are compatible if BPE leaves them side by side; an encoding is right if and only if each
    neighbouring pair is compatible, so for each prefix exactly one last token is possible. An
    automaton with suffix links gives the tokens that end at each position, the pair test picks the
    one that fits behind the prefix before it, and back-pointers from the end give the ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, self.tokenizer = told["model"], Tokenizer.from_file(path)
        self.names = [""] * len(model["vocab"])
        for name, i in model["vocab"].items():
            self.names[i] = name
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        base = len(self.names) - len(merges)
        end = model["end_of_word_suffix"]
        self.parts = [(i, i) for i in range(base)]
        symbols = []
        for name in self.names[:base]:
            marked = name.endswith(end) and len(name) > 1
            symbols.append(chr(self.letters[name.removesuffix(end) if marked else name] + 256 * marked))
        self.merged: dict[tuple[int, int], int] = {}
        ids = model["vocab"]
        for k, (left, right) in enumerate(merges):
            pair = ids[left], ids[right]
            if ids.get(self.names[base + k]) != base + k or base + k <= max(pair):
                raise ValueError("ids do not follow the merges")
            self.merged[pair] = base + k
            self.parts.append(pair)
            symbols.append(symbols[pair[0]] + symbols[pair[1]])
        self.symbol_id = {s: i for i, s in enumerate(symbols[:base])}
        automaton = ahocorasick.Automaton()
        for i, s in enumerate(symbols):
            if i < base or self.merge_plainly(s) == [i]:  # a token that BPE never makes can never stand
                automaton.add_word(s, (i, len(s)))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.whole = {s: automaton.get(s)[0] for s in symbols if s in automaton}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(len(self.names))]
        self.pairs: dict[int, bool] = {}
        self.pieces = Kept(self._piece, PIECES_KEPT)
        self.bare = Kept(self._bare, 2 * PIECES_KEPT)
        self.words = Kept(self._word, WORDS_KEPT)

    def merge_plainly(self, symbols: str) -> list[int]:
        """BPE as defined: merge the lowest pair, leftmost first, until none is left."""
        ids = [self.symbol_id[c] for c in symbols]
        while len(ids) > 1:
            best = min((m, k) for k in range(len(ids) - 1) for m in [self.merged.get((ids[k], ids[k + 1]), 1 << 40)])
            if best[0] == 1 << 40:
                break
            ids[best[1] : best[1] + 2] = [best[0]]
        return ids

    def compatible(self, one: int, two: int) -> bool:
        """Whether BPE leaves ``one`` and ``two`` side by side: undo their merges, latest first; no pair across the gap may merge earlier."""
        merged, parts, limit = self.merged.get, self.parts, 1 << 40
        while True:
            if merged((one, two), limit) < limit:
                return False
            if one > two:
                limit = one
                one = parts[one][1]
                if one == limit:
                    limit = two + 1
                    two = parts[two][0]
                    if two + 1 == limit:
                        return True
            else:
                limit = two + 1
                two = parts[two][0]
                if two + 1 == limit:
                    limit = one
                    one = parts[one][1]
                    if one == limit:
                        return True

    def encode_symbols(self, symbols: str) -> list[int]:
        """The ids of a symbol string. token[k]: the last token of the encoding of the first k symbols; size[k]: its length."""
        whole = self.whole.get(symbols)
        if whole is not None:
            return [whole]
        n = len(symbols)
        token, size, pairs = [-1] * (n + 1), [0] * (n + 1), self.pairs
        known = pairs.get
        for at, (found, length) in self.matches(symbols):
            at += 1
            if token[at] < 0:
                if length < at:
                    before = token[at - length]
                    if before < 0:
                        continue
                    key = before << 20 | found
                    fits = known(key)
                    if fits is None:
                        if len(pairs) >= PAIRS_KEPT:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(before, found)
                    if not fits:
                        continue
                token[at], size[at] = found, length
        out = []
        while n:
            out.append(token[n])
            n -= size[n]
        out.reverse()
        return out

    def _ids(self, piece: str) -> list[int]:
        raw = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        return self.encode_symbols(raw[:-1] + chr(ord(raw[-1]) + 256))

    def _bare(self, piece: str) -> bytes:
        return b"".join([self.id_bytes[i] for i in self._ids(piece)])

    def _piece(self, piece: str) -> tuple[bytes, str]:
        ids = self._ids(piece)
        return b"".join([self.id_bytes[i] for i in ids]), " ".join([self.names[i] for i in ids])

    def cut(self, text: str) -> list[str]:
        """Normalised pieces between which no merge is made."""
        if _LATIN.fullmatch(text):
            return _LATIN_PIECES.findall(text.lower())
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [bytes([self.letters[c] for c in p]).decode("utf-8") for p, _ in found]

    def ids(self, text: str) -> bytes:
        """The ids alone."""
        if "<|" not in text and _LATIN.fullmatch(text):
            return b"".join(map(self.bare.__getitem__, _LATIN_PIECES.findall(text.lower())))
        return self.encode(text)[0]

    def _word(self, word: str) -> tuple[bytes, str]:
        if "<|" in word:
            return self._join([x for part in self.special_at.split(word) if part for x in ([(self.special[part].to_bytes(4, "little"), part)] if part in self.special else map(self.pieces.__getitem__, self.cut(part)))])
        return self._join(list(map(self.pieces.__getitem__, self.cut(word))))

    @staticmethod
    def _join(found: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        return found[0] if len(found) == 1 else (b"".join([x[0] for x in found]), " ".join([x[1] for x in found]))

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids of a whole text as little-endian unsigned 32-bit integers, and the text decoded from them."""
        if "<|" not in text and _LATIN.fullmatch(text):
            return self._join(list(map(self.pieces.__getitem__, _LATIN_PIECES.findall(text.lower()))))
        if _SEPARATORS.search(text):
            return self._word(text)
        return self._join(list(map(self.words.__getitem__, text.split())))


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder for each worker process."""
    return PrefixEncoder(path)


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text of each whole text.

    A null or empty text has no ids and decodes to the empty text. Null ids are carried through,
    repeated rows are encoded alike, other columns are ignored. Time is linear in a text's length.
    """
    return needed(docs, "doc_id", "text").mapInArrow(_encode(path or vocabulary_path(), digest=False), SCHEMA)


def _encode(path: str, digest: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for ids, texts in rows(batches, "doc_id", "text"):
            for k in range(0, len(ids), 100):
                some = [own.encode(t) if t else (b"", "") for t in texts[k : k + 100]]
                columns = [pa.array(ids[k : k + 100], pa.int64()), pa.array([len(a) // 4 for a, _ in some], pa.int64())]
                if digest:
                    columns += [pa.array([hashlib.sha256(a).hexdigest() for a, _ in some]), pa.array([hashlib.sha256(b.encode("utf-8")).hexdigest() for _, b in some])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    columns += [pa.array([a for a, _ in some], pa.binary()), pa.array([b for _, b in some], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    return encode


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return needed(documents(spark, sf_dir), "doc_id", "text").mapInArrow(_encode(vocabulary_path(), digest=True), schema)
