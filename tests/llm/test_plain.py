"""Operators against SQL and plain versions: masks, archives, quality, leaks, and the pipeline as a whole."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from costweave.llm import chat, decontaminate, ngram_jaccard, packing, quality, queries, warc
from costweave.session import table

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    columns, key = sorted(want.columns), want.columns[0]
    assert sorted(got.columns) == columns
    assert got[columns].sort_values(key).values.tolist() == want[columns].sort_values(key).values.tolist()


TURNS = [
    [("user", "\n\n hi"), ("assistant", "\n\nhello\n world  "), ("assistant", " ")],
    [("assistant", "</s>[INST] ok [/INST] <|im_sep|> <|im_end|>\\ <\\|x é漢字"), ("a\nb", ""), ("", "<\\\\|")],
    [("assistant", ""), ("assistant", "a"), ("assistant", "b")],
]


@pytest.mark.parametrize("turns", TURNS)
def test_masks_cover_assistant_texts_alone(turns):
    formatted, spans = chat.render(turns)
    encoded = chat._tokenizer(None).encode(formatted, add_special_tokens=False)
    starts, ends = np.array(encoded.offsets, np.int32).reshape(-1, 2).T
    assert list(chat.parse(formatted)) == turns
    loss = chat.mask(starts, ends, spans)
    assert "".join(chat.under_mask(formatted, starts, ends, loss)) == "".join(t for r, t in turns if r == "assistant")
    assert "".join(chat.under_mask(formatted, starts, ends, np.ones(len(starts), bool))) != "".join(t for r, t in turns if r == "assistant")


def test_odd_turns_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 50)
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 300), (1, 1, "assistant", "x" * 300), (1, None, None, "first"), (None, 0, "assistant", "lost"), (2, 0, "assistant", "")]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (4, 600), None: (1, 4), 2: (1, 0)}


def test_archives_roll_and_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "DICT_SAMPLE", 2000)
    rng = random.Random(4)
    rows = [(i, f"http://x/{i}", "".join(rng.choices("abcdef <>", k=400))) for i in range(200)] + [(300, None, None), (301, "u", ""), (5, "u", "twice"), (302, "u", "twice"), (None, "u", "twice"), (None, "u", "alone"), (303, "u", "long " * 300_000)]
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, key string")
    out = warc.round_trip(pages).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted(((i, len((h or "").encode()), None if first.get(h or "", i) == i else first[h or ""]) for i, _, h in rows), key=repr)
    assert sorted(((r.page_id, r.payload_bytes, r.refers_to) for r in out), key=repr) == want
    assert len({r.archive for r in out}) > 4
    assert all((r.payload is None) == (r.record_type == "revisit") for r in out)


def test_quality_on_labels_not_seen(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    clashing = docs.selectExpr("*", "1 as p", "2 as p_host", "3 as prior", "4 as host", "5 as h", "6 as evidence", "7 as row")
    out = quality.classify(clashing, labels.where("doc_id % 2 = 0"))
    assert sorted(out.columns) == sorted({*clashing.columns, "evidence", "prior", "posterior", "keep"})
    truth = labels.where("doc_id % 2 = 1 and quality is not null").groupBy("doc_id").agg({"quality": "max"}).withColumnRenamed("max(quality)", "quality")
    rows = out.select("doc_id", "keep").join(truth, "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in rows) >= 0.9 * len(rows) > 0


def weighted(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def test_leaks_against_all_windows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choices(vocabulary, k=rng.choice([12, 40, 80]))) for _ in range(300)]
    index = decontaminate.Index(list(range(300)), items)
    prints = np.random.default_rng(1).integers(0, 2**64, (100, decontaminate.BITS // 64), dtype=np.uint64)
    for n, own in index.by_size.items():
        assert index.candidates(prints, n)[1] <= 0.05 * 100 * len(own)  # few random pairs become candidates
    texts, want = [], set()
    for _ in range(200):
        i = rng.randrange(300)
        words = items[i].split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(len(words))] = f"z{rng.random()}"
        text = " ".join(rng.choices(vocabulary, k=30) + words + rng.choices(vocabulary, k=30))
        all_words, target, size = text.split(), weighted(items[i]), len(items[i].split())
        best = max(sum((target & w).values()) / sum((target | w).values()) for w in (weighted(" ".join(all_words[k : k + size])) for k in range(len(all_words) - size + 1)))
        if best >= 0.8:
            want.add((len(texts), i))
        texts.append(text)
    texts.append(" ".join(rng.choices(vocabulary, k=60_000)) + " " + items[0] + " " + items[0])
    want.add((200, 0))
    found = {(r, i) for r, i, *_ in index.search(pa.array([*texts, None, ""]))}
    assert found <= want
    assert len(found) >= 0.9 * len(want)


def test_pipeline_stages_take_effect(spark):
    docs, labels, benchmark = (table(spark, DATA, t) for t in ("documents", "labels", "benchmark"))
    kept = {r.doc_id for r in quality.classify(docs, labels).where("keep").collect()}
    classes = {r.doc_id: r.component_id for r in ngram_jaccard.similar_classes(docs.where(docs.doc_id.isin(*kept))).collect()}
    kept = {i for i, c in classes.items() if i == c}
    leaks = {r.doc_id for r in decontaminate.contaminated(docs, benchmark).collect()}
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in rows} == kept - leaks
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in own) <= packing.CAPACITY for own in places.values())
