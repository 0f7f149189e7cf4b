"""Bounded-space online packing of token sequences.

Every partition packs its documents as they come, in one pass, and keeps at most ``windows`` open windows. A document
goes into the fullest open window that holds it whole (best fit); when none does and no more may be opened, the fullest
is filled up with the document's first tokens and emitted, and the rest goes on. What is longer than a window is cut into
whole windows first. Windows that are still open when a partition ends are carried as rows with their ids and packed
again by the same rule, FAN partitions at a time, until one task has what is left of all; that closes its windows and
cuts the last rest into powers of two. So every sequence is full or a power of two long, and nothing is padding.

A worker holds ``windows`` windows and a batch of texts. Sequence ids name round, task and count, so a task that runs
again gives the same rows.

Null and empty texts are one end token. Repeated rows and null doc_ids are packed like any others; a text is
encoded whole; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.session import Scratch, stage

CAPACITY = 2048
WINDOWS = 32  # open at once in a task
FAN = 32  # tasks whose open windows meet in one task of the next round
END = 1
#: Fixed values of the public vocabulary: the one special token that its texts may hold, and the pre-tokenizer's pattern
#: (the vocabulary's own, with possessive repeats, which match the same).
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_encodings: dict[str, object] = {}


def encoder(path: str | None = None):
    """text -> its ids as an array of 32-bit numbers, without an end token; a worker reads the vocabulary's list of ranks once."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    encoding = _encodings[path]
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


class Window:
    """Pieces of one sequence: (doc_id, start, ids, tokens of the document)."""

    def __init__(self):
        self.pieces, self.used = [], 0


class Packer:
    """Online packing with bounded space; ``emit`` gets closed windows."""

    def __init__(self, emit, capacity: int = CAPACITY, windows: int = WINDOWS):
        self.emit, self.capacity, self.windows, self.open = emit, capacity, windows, []

    def add(self, doc_id, start: int, ids: bytes, tokens: int) -> None:
        """Place a document's ids, or a piece of them that begins at ``start``."""
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.open if w.used + n <= self.capacity]
            if n >= self.capacity or not fits and len(self.open) < self.windows:
                best = Window()
                self.open.append(best)
            else:
                best = max(fits or self.open, key=lambda w: w.used)
            take = min(n, self.capacity - best.used)
            best.pieces.append((doc_id, start, ids[: 4 * take], tokens))
            best.used += take
            start, ids = start + take, ids[4 * take :]
            if best.used == self.capacity:
                self.open.remove(best)
                self.emit(best)

    def close(self) -> None:
        """Emit what is open: whole windows, then powers of two."""
        pieces = deque(p for w in self.open for p in w.pieces)
        left, self.open = sum(w.used for w in self.open), []
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            window = Window()
            while window.used < room:
                doc_id, start, ids, tokens = pieces.popleft()
                take = min(len(ids) // 4, room - window.used)
                window.pieces.append((doc_id, start, ids[: 4 * take], tokens))
                window.used += take
                if len(ids) > 4 * take:
                    pieces.appendleft((doc_id, start + take, ids[4 * take :], tokens))
            left -= room
            self.emit(window)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("team", pa.int64())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, team long"


def _packed(teams: Iterator[tuple[int, Iterator[tuple]]], first_id: int, last: bool, keep_ids: bool, capacity: int, windows: int) -> Iterator[pa.RecordBatch]:
    """Rows of the windows that are emitted, and with their ``team`` and ids those of windows left open."""
    rows: list[tuple] = []
    count = first_id

    def put(window: Window, team: int | None = None) -> None:
        nonlocal count
        at = 0
        for doc_id, start, ids, tokens in window.pieces:
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, count, at, ids if keep_ids or team is not None else None, team))
            at += len(ids) // 4
        count += 1

    def batch() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
        rows.clear()
        return out

    for team, documents in teams:
        packer = Packer(put, capacity, windows)
        for document in documents:
            packer.add(*document)
            if len(rows) >= 4096:
                yield batch()
        if last:
            packer.close()
        for window in packer.open:
            put(window, team)
    if rows:
        yield batch()


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, windows: int = WINDOWS, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of the documents' ids, END behind each; ``keep_ids`` adds ``ids``."""
    scratch = Scratch(docs.sparkSession, "windows")
    end = array("I", [END]).tobytes()

    def first(batches):
        task = TaskContext.get().partitionId()

        def documents():
            encode = encoder(path)
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                    ids = encode(text.as_py() or "")
                    yield doc_id.as_py(), 0, ids.astype("<u4").tobytes() + end, len(ids) + 1

        return _packed(iter([(task, documents())]), task << 36, False, keep_ids, capacity, windows)

    slim = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    done = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, _DDL), "packed")
    open_rows, out, round_ = done.where("team is not null"), done.where("team is null").select(*slim), 0
    while True:
        teams = open_rows.agg(F.max("team")).first()[0]
        if teams is None:
            break
        round_ += 1
        last = teams < FAN

        def again(batches, round_=round_, last=last):
            def grouped():
                rows = ((r["next"], (r["doc_id"], r["start"], r["ids"], r["doc_tokens"])) for b in batches for r in b.to_pylist())
                held = next(rows, None)

                def own(team):
                    nonlocal held
                    while held and held[0] == team:
                        yield held[1]
                        held = next(rows, None)

                while held:
                    team = held[0]
                    yield team, own(team)

            return _packed(grouped(), (round_ << 60) | (TaskContext.get().partitionId() << 36), last, keep_ids, capacity, windows)

        dealt = open_rows.select((F.floor(F.col("team") / FAN)).cast("long").alias("next"), "team", "sequence_id", "offset", "doc_id", "start", "ids", "doc_tokens")
        dealt = dealt.repartition(teams // FAN + 1, "next").sortWithinPartitions("next", "team", "sequence_id", "offset")
        # the first round's result is read from its own table; later ones are small
        packed = stage(dealt.mapInArrow(again, _DDL), "packed") if last else scratch.stage(dealt.mapInArrow(again, _DDL), f"round{round_}")
        emitted = packed.where("team is null").select(*slim)
        out = out.union(emitted if last else stage(emitted, "packed"))
        open_rows = packed.where("team is not null")
        if last:
            break
    scratch.close()
    return out
