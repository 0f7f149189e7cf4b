"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and its sorted assistant spans are intersected with the
token spans by binary search. Turns are marked by control strings, which are tokens of their own on either side of a
text, so no token reaches over a text's edge (a mask that did would be an error). Where a text or role holds something that reads as
one (of this template or another usual one), a backslash goes behind its first character, and one backslash more where
some stand there already, so unescaping gives the text back.

Rows are taken by turn, ties by role and text. Null roles and texts are empty, null turns come first. Conversations
stream through a task turn by turn, in segments of at least SEGMENT characters that end with a turn, so a very long
one needs no more memory than its longest turn. Repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ASSISTANT = "assistant"
SEGMENT = 1 << 20
_CONTROL = r"(\||/?s>|/?INST\]|/?SYS>)"
_RAW = re.compile(r"([<\[])(\\*)" + _CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
FORMATTED = "conv_id long, segment int, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def escape(text: str) -> str:
    return _RAW.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of its assistant texts."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == ASSISTANT and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str):
    """(role, text) of each turn, in order, unescaped."""
    at = 0
    while (at := formatted.find(START, at)) >= 0:
        line = formatted.index(SEP, at)
        end = formatted.index(END, line)
        yield unescape(formatted[at + len(START) : line]), unescape(formatted[line + len(SEP) : end])
        at = end + len(END)


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens touch a span: the first span that ends behind the token's start is found by binary search."""
    if not spans:
        return np.zeros(len(starts), bool)
    begin, stop = np.array(spans).T
    i = np.searchsorted(stop, starts, "right")
    near = np.minimum(i, len(begin) - 1)
    under = (i < len(begin)) & (begin[near] < ends)
    if (under & ((starts < begin[near]) | (ends > stop[near]))).any():
        raise ValueError("a token reaches over the edge of a text")
    return under


def _tokenizer(path: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    t.add_special_tokens([START, SEP, END])
    return t


def format_conversations(turns: DataFrame, path: str | None = None) -> DataFrame:
    """A row per segment (all but very long conversations have one): text, token ids, offsets in code points, loss mask."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def build(batches):
        tokenizer = _tokenizer(path)
        done: list[tuple] = []

        def close(conv, segment, own):
            text, spans = render(own)
            e = tokenizer.encode(text, add_special_tokens=False)
            starts, ends = np.array(e.offsets, np.int32).reshape(-1, 2).T
            done.append((conv, segment, len(own), text, e.ids, starts, ends, mask(starts, ends, spans)))

        def flush():
            columns = list(zip(*done, strict=True)) or [()] * 8
            done.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()))
            return pa.record_batch([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in FORMATTED.split(", ")])

        key, segment, own, size = None, 0, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if own and (conv != key or size >= SEGMENT):
                    close(key, segment, own)
                    own, size = [], 0
                    segment = segment + 1 if conv == key else 0
                key = conv
                own.append((role, text))
                size += len(text)
                if sum(len(x[3]) for x in done[-1:]) >= SEGMENT or len(done) >= 256:
                    yield flush()
        if own:
            close(key, segment, own)
        yield flush()

    return rows.mapInArrow(build, FORMATTED)


def under_mask(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """All text under the loss mask, run by run, unescaped; it is read off the tokens and their mask alone."""
    edges = np.zeros(len(formatted) + 1, np.int64)
    np.add.at(edges, starts[loss], 1)
    np.add.at(edges, ends[loss], -1)
    turns = np.flatnonzero(np.diff(np.concatenate([[0], (edges.cumsum() > 0).astype(np.int8), [0]])))
    return [unescape(formatted[a:b]) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]


def digests(formatted: DataFrame) -> DataFrame:
    """A row per conversation, read back from the rows of ``format_conversations`` in their order."""

    def read(batches):
        rows, key, turns = [], None, 0

        def result():
            return (key, turns, all_text.hexdigest(), loss_chars, loss_text.hexdigest(), chars)

        for batch in batches:
            for i in range(batch.num_rows):
                conv, segment, text = (batch.column(c)[i].as_py() for c in ("conv_id", "segment", "formatted"))
                if segment == 0:
                    if turns:
                        rows.append(result())
                    key, turns, chars, loss_chars, all_text, loss_text = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                for role, whole in parse(text):
                    turns += 1
                    all_text.update(f"{role}\n{whole}\n".encode())
                for under in under_mask(text, *(batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss"))):
                    loss_text.update(under.encode())
                    loss_chars += len(under)
            if len(rows) > 1000:
                yield batch_of(rows)
                rows = []
        if turns:
            rows.append(result())
        yield batch_of(rows)

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.record_batch([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
