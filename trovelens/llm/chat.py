"""Conversations as training text with a loss mask, and read back from it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.llm.columns import needed, rows
from trovelens.llm.templates import compiled

TEMPLATE = (
    "{% for m in messages %}{{ '<s>' ~ '[INST] ' }}{{ m.role|protect }} [/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|protect }}{% endgeneration %}{% else %}{{ m.text|protect }}{% endif %}</s>{% endfor %}"
)
_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"
_PROTECT = re.compile(rf"\\|{_CONTROL}")
_SCAN = re.compile(rf"\\(?:\\|{_CONTROL})|{_CONTROL}")


def protect(text: str | None) -> str:
    """``text`` with a backslash before each backslash and control string."""
    return _PROTECT.sub(lambda m: "\\" + m[0], text or "")


def unprotect(text: str) -> str:
    """The inverse of ``protect``."""
    return _SCAN.sub(lambda m: m[0][1:] if m[0][0] == "\\" else m[0], text)


def turns_of(pieces: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the loss mask, characters) of each turn, read from formatted pieces alone.

    Only the turn that is being read is held. Text outside a turn's marks is an error.
    """
    held, mask = "", []
    for piece, generated in pieces:
        if not piece:
            continue
        mask.append((len(held), len(held) + len(piece), generated))
        held += piece
        if "</s>" not in piece:
            continue
        stop = marks = 0
        where = {}
        for found in _SCAN.finditer(held):
            if found[0][0] == "\\":
                continue
            where.setdefault(found[0], found.span())
            marks += 1
            if found[0] == "</s>":
                stop = found.end()
                break
        if not stop:
            continue
        if marks != 4 or where["<s>"] != (0, 3) or stop != len(held):
            raise ValueError("marks out of place")
        role = unprotect(held[where["[INST]"][1] + 1 : where["[/INST]"][0] - 1])
        text = unprotect(held[where["[/INST]"][1] : where["</s>"][0]])
        yield role, text, unprotect("".join(held[a:b] for a, b, g in mask if g)), len(held)
        held, mask = "", []
    if held:
        raise ValueError("a turn is not closed")


def in_order(conversations: DataFrame) -> DataFrame:
    """Rows dealt by conversation and in the order (turn, role, text) within it."""
    dealt = needed(conversations, "conv_id", "turn", "role", "text").repartition(F.col("conv_id"))
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    flat = ((c, r, t) for cs, rs, ts in rows(batches, "conv_id", "role", "text") for c, r, t in zip(cs, rs, ts, strict=True))
    for conv, own in groupby(flat, key=lambda x: x[0]):
        yield conv, ({"role": r, "text": t} for _, r, t in own)


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The training text in rows of one piece each: conv_id, piece (order), text, generated (the loss mask).

    Joined by piece the texts are the formatted conversation. A long conversation streams through:
    no more than a batch of its turns is held. Null texts and roles are empty; rows with a null
    conv_id are one conversation; tied or repeated turns follow each other by role and text.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template, {"protect": protect})
        held: list[tuple] = []
        names = ["conv_id", "piece", "text", "generated"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        for conv, messages in _conversations(batches):
            for k, (text, generated) in enumerate(render({"messages": messages})):
                held.append((conv, k, text, generated))
                if len(held) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return in_order(conversations).mapInArrow(write, "conv_id long, piece long, text string, generated boolean")


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """For each conversation what its formatted text says when it is read again: turns, loss text and sizes.

    The digests are over the turns in order and so are taken in one task for each conversation, as a
    stream: memory is bounded by a batch of turns whatever a conversation's length. Null texts and
    roles count as empty, an empty table gives an empty result, other columns are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template, {"protect": protect})
        out: list[tuple] = []
        for conv, messages in _conversations(batches):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text, learned, size in turns_of(render({"messages": messages})):
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(learned.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(learned), chars + size
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return in_order(conversations).mapInArrow(read, SCHEMA)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])


#: A conversation that says the control strings themselves.
PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = needed(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(own.unionByName(probe))


_LONGER = r"regexp_replace(x, '(\\|</?s>|\[/?INST\])', '\\\1', 'g')"
ORACLE_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_LONGER.replace("(x", "(text")}) + length({_LONGER.replace("(x", "(role")}) + length('<s>[INST]  [/INST]</s>')) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
