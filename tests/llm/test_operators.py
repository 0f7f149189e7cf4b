"""Operators against plain versions, with nulls, empty texts, repeated rows and extra columns."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from costweave.llm import decontaminate, ngram_jaccard, packing, quality, queries, secrets, suffix_dedup
from costweave.llm.words import batch_shingles
from costweave.session import table

DATA = "/root/testdata/sf0.001"


def documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "one two"), (4, "ab " * 300)]
    for i in range(5, 60):
        base = " ".join(rng.choices(words, k=80))
        rows.append((i, base))
        if i % 3 == 0:
            rows.append((100 + i, base.replace(base.split()[40], "changed", 1)))
        if i % 7 == 0:
            rows.append((200 + i, "intro " + base + " " + base[:250]))
    return rows, spark.createDataFrame([(i, t, "en", "a.example", i, "x") for i, t in rows], "doc_id long, text string, lang string, source string, keep int, secret_spans string")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_jaccard_against_all_pairs(spark):
    rows, docs = documents(spark)
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sorted(root):
        for b in sorted(root):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                ra, rb = root[a], root[b]
                root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.similar_classes(docs).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in root}
    assert len(set(root.values())) < len(root)
    kept = ngram_jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(root.values())


def linked(texts):
    """Smallest id of every text's component, from all pairs."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                ra, rb = root[a], root[b]
                root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    return root


def components_of(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in ngram_jaccard.similar_classes(docs).collect()}


def test_jaccard_inside_groups_no_other_group_meets(spark):
    rng, texts = random.Random(11), {}
    for k in range(60):
        a = [f"t{k}x{rng.random()}" for _ in range(13)]
        b = [*a[:9], "other", *a[10:]]
        texts |= {10 * k: " ".join(a), 10 * k + 1: " ".join(b), 10 * k + 2: " ".join([*b[:12], "last"])}
    want = linked(texts)
    assert all(want[10 * k + 2] == 10 * k + 1 for k in range(60))
    assert components_of(spark, texts) == want


def test_jaccard_inside_groups_that_share_one_shingle_with_another(spark):
    rng, texts, found = random.Random(12), {}, 0
    while found < 4:
        a = [f"t{rng.random()}" for _ in range(34)]
        b = [*a[:16], "other", *a[17:]]
        triple = [" ".join(x) for x in (a, b, [*b[:33], "last"])]
        hashes = [own.tolist() for own in np.split(*(lambda h, at: (h, at[1:-1]))(*batch_shingles(pa.array(triple))))]
        prefixes = [sorted(own)[:7] for own in hashes]
        k = hashes[0].index(prefixes[0][0])
        fresh = [f"t{rng.random()}" for _ in range(14)]
        beside = " ".join([*fresh, *a[k : k + 5], *(f"t{rng.random()}" for _ in range(15))])
        if prefixes[0] == prefixes[1] == prefixes[2] and prefixes[0][0] in sorted(batch_shingles(pa.array([beside]))[0].tolist())[:7]:
            texts |= {10 * found + i: t for i, t in enumerate([*triple, beside])}
            found += 1
    want = linked(texts)
    assert all(want[10 * k + 2] == 10 * k + 1 for k in range(found))
    assert components_of(spark, texts) == want


def without_repeats(rows):
    """n_bytes, n_removed, n_spans and digest by place of the row, from all 400-byte windows."""
    raw, starts = [(t or "").encode() for _, t in rows], defaultdict(list)
    for i, b in enumerate(raw):
        for k in range(len(b) - 399):
            starts[b[k : k + 400]].append((i, k))
    gone = defaultdict(set)
    for places in starts.values():
        for i, k in places if len(places) > 1 else ():
            gone[i].update(range(k, k + 400))
    want = []
    for i, b in enumerate(raw):
        spans = sum(1 for k in gone[i] if k - 1 not in gone[i])
        want.append((rows[i][0], len(b), len(gone[i]), spans, hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in gone[i])).hexdigest()))
    return sorted(want, key=repr)


def removed(docs):
    out = suffix_dedup.digests(suffix_dedup.remove_repeats(docs)).collect()
    assert all(r.repeated == (r.n_removed > 0) for r in out)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=repr)


def test_suffix_dedup_against_all_windows(spark):
    rows, docs = documents(spark)
    want = without_repeats(rows)
    assert removed(docs) == want
    assert any(x[2] for x in want)


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    rng = random.Random(8)
    middle = "".join(rng.choices("abcdefgh ", k=330))
    tails = ["".join(rng.choices("xyz", k=90)) for _ in range(4)]
    rows = [(i, "".join(rng.choices("rstu", k=60)) + tails[i % 3][:40] + middle + tails[i % 4] + "".join(rng.choices("rstu", k=200))) for i in range(24)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (50, "ab" * 700), (51, "é" * 300 + middle), (52, None), (53, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = without_repeats(rows)
    for group in (1, 2, 20_000):
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        assert removed(docs) == want


def test_suffix_dedup_across_chunks_of_a_long_text(spark):
    rng = random.Random(9)
    letters = lambda x, n: "".join(rng.choices(x, k=n))
    passage = letters("abcdefghij ", 900)
    before, after = letters("klmnopqrst", suffix_dedup.CHUNK - 450), letters("klmnopqrst", 1000)
    docs = spark.createDataFrame([(1, before + passage + after), (2, passage), (3, "z" * 1500)], "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert removed(docs) == [(1, len(before + after) + 900, 900, 1, sha(before + after)), (2, 900, 900, 1, sha("")), (3, 1500, 1500, 1, sha(""))]


def test_multikey_quicksort(spark):
    keys = np.random.default_rng(1).integers(0, 4, (500, 6)).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(keys)
    assert sorted(order.tolist()) == list(range(500))
    assert keys[order].tolist() == sorted(keys.tolist())


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN[4:], text, re.I | re.A) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets_against_regular_expressions(spark):
    docs = table(spark, DATA, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert got[i].base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest(), i
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    assert all(base_spans(r.text or "") == "" or "<secret>" not in r.text for r in clean.collect())


HELD_OUT = """TransactionProcessingServiceFactory AbstractSingletonProxyFactoryBean SimpleAnnotationMetadataReader
user_authentication_token_expiry get_all_active_subscriptions internal_server_error_handler com/example/project/module/Component
the-quick-brown-fox-jumps-over FEATURE_FLAG_ENABLE_DARK_MODE handleIncomingWebSocketMessage programmation-orientee-objet-avancee
Bundesausbildungsfoerderungsgesetz 2020-05-05T12-00-00-0000 test_should_return_error_when_empty LinkedBlockingQueueConsumerThread""".split()


def test_markov_spans_on_random_strings_and_identifiers(spark):
    rng = random.Random(21)
    random_strings = ["".join(rng.choices(secrets.ALPHABET[:n], k=k)) for n in (62, 64) for k in (24, 32, 48) for _ in range(20)]
    rows = [(i, f"see {x} here") for i, x in enumerate(random_strings + HELD_OUT)] + [(900, "id " + random_strings[0] + "=password=" + "q" * 9), (901, "0" * 31 + "f" + "Z" + random_strings[1])]
    found = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(random_strings)
    assert sum("markov:4:" in found[i] for i in range(n)) >= 0.95 * n
    assert not any("markov" in found[i] for i in range(n, n + len(HELD_OUT)))
    assert "assign" in found[900] and "markov" not in found[900] and found[901] == "hex:0:32"


def test_secrets_in_very_long_texts(spark):
    parts = [f"token = {'abcdefgh' * 2}{i} AKIA{'Q7' * 8} {'0f' * 18} w{i}" for i in range(9000)]
    long = " ".join(parts)
    rows = [(1, long), (2, None), (3, ""), (3, "token: 12345678"), (3, "token: 12345678"), (None, "token: 12345678")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, secret_base string, row int")
    start = time.time()
    got = sorted(((r.doc_id, r.base_sha256) for r in secrets.scan(docs).collect()), key=repr)
    assert got == sorted(((i, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in rows), key=repr)
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    texts = [r.text for r in clean.where("doc_id = 1 or doc_id = 3").orderBy("doc_id", "text").collect()]
    assert texts[0] == " ".join(f"<secret> <secret> <secret> w{i}" for i in range(9000)) and texts[1:] == ["", "<secret>", "<secret>"]
    assert time.time() - start < 60


def test_packing_is_gapless(spark):
    _, docs = documents(spark)
    rows = packing.pack(packing.pieces(docs)).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_filters_keep_columns_and_clean_rows(spark):
    _, docs = documents(spark)
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, 1, 0), (4, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, labels).columns == docs.columns
    item = docs.where("doc_id = 10").selectExpr("1L as item_id", "text")
    clean = decontaminate.decontaminate(docs, item)
    assert clean.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    assert 10 in gone and gone <= {10, 110, 210}


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_warc"])
def test_round_trips(spark, name):
    rows = queries.QUERIES[name](spark, DATA).collect()
    if name == "op1_chat_format":
        turns = defaultdict(list)
        for r in table(spark, DATA, "conversations").collect():
            turns[r.conv_id].append((r.turn, r.role, r.text or ""))
        turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
        for r in rows:
            own = [(role, text) for _, role, text in sorted(turns[r.conv_id])]
            loss = "".join(text for role, text in own if role == "assistant")
            assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
            assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert len(rows) == len(turns)
    else:
        first, pages = {}, {r.page_id: (r.html or "").encode() for r in table(spark, DATA, "pages").collect()}
        for i in sorted(pages):
            first.setdefault(pages[i], i)
        want = {i: (len(b), None if first[b] == i else first[b]) for i, b in pages.items()}
        assert {r.page_id: (r.payload_bytes, r.refers_to) for r in rows} == want
