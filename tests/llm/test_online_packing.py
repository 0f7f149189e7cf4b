"""Bounded-space packing: ids of the tokenizer, whole documents in pieces, full sequences, odd inputs."""

import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from costweave.llm import online_packing, queries
from costweave.session import table

DATA = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "\n", " a", "a ", "a  ", "a  b", "a \n b", "a\n b", "a \n\n  b\t\tc ", "x \n", "x\n ", "x\n\n y", "\n\n \n", "é à  漢字 　 ü", "a  b  c", "it's I'll 'Tis 12 34a ?!.", "<|endoftext|>", "a  <|endoftext|>  b<|endoftext|>", "\x1c \x1d a", "\x85 \x85", "<|endoftext|> <|endoftext"]


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def whole(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, online_packing.END]


def check(rows, docs, capacity=online_packing.CAPACITY):
    """Pieces tile their documents, sequences have no gaps and are full or powers of two."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    assert sum(sum(n for _, n in own) < capacity for own in sequences.values()) <= capacity.bit_length()
    for doc_id, ids in docs:
        own = sorted((r for r in pieces[doc_id, len(ids)]), key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at
            at += r.length
            assert r.ids_crc32 == zlib.crc32(array("I", ids[r.start : at]).tobytes())
        assert at == len(ids)


def test_ids_equal_the_tokenizer():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices([" ", "  ", "\n", "a", "B'", "é", "漢", "7", "?", "\t", " ", "<|endoftext|>", "\x1c"], k=rng.randrange(30))) for _ in range(3000)]
    encode = online_packing.encoder()
    assert [(t, encode(t).tolist()) for t in texts] == [(t, whole(t)[:-1]) for t in texts]


def test_query_packs_every_document(spark):
    docs = [(r.doc_id, whole(r.text)) for r in table(spark, DATA, "documents").collect()]
    rows = queries.QUERIES["op11_online_packing"](spark, DATA).collect()
    check(rows, docs)
    assert sum(r.length for r in rows) == sum(len(x) for _, x in docs)


def test_rounds_of_open_windows_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(online_packing, "FAN", 2)
    rng = random.Random(2)
    texts = [*ODD, "long words " * 50_000, *(" ".join(rng.choices(["alpha", "beta", "x", "?"], k=rng.choice([1, 5, 300, 900]))) for _ in range(300))]
    rows = [(i, x, "ids", 1) for i, x in enumerate(texts)] + [(1000, None, "ids", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, team int").repartition(9)
    got = online_packing.pack(docs, windows=3).collect()
    check(got, [(i, whole(x)) for i, x, *_ in rows])
    assert len({r.sequence_id >> 60 for r in got}) > 2
    twice = online_packing.pack(spark.createDataFrame([(1, "same"), (1, "same"), (None, "same")], "doc_id long, text string"), keep_ids=True).collect()
    own = array("I", whole("same")).tobytes()
    assert b"".join(r.ids for r in sorted(twice, key=lambda r: (r.sequence_id, r.offset))) == 3 * own
    assert {r.doc_id for r in twice} == {1, None}
    assert online_packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
