"""Empty tables, payloads read back, and held-out scores."""

import hashlib
import zlib

import pytest

from costweave.llm import chat, decontaminate, media, ngram_jaccard, packing, quality, queries, secrets, suffix_dedup, toxicity, warc
from costweave.session import table

DATA = "/root/testdata/sf0.001"

EMPTY = {
    "chat": lambda t: chat.digests(chat.format_conversations(t("conversations").where("conv_id < -1"))),
    "warc": lambda t: warc.round_trip(t("pages").where("page_id < -1")),
    "secrets": lambda t: secrets.scan(t("documents").where("doc_id < -1")),
    "quality": lambda t: quality.keep_good(t("documents").where("doc_id < -1"), t("labels")),
    "packing": lambda t: packing.pack(packing.pieces(t("documents").where("doc_id < -1"))),
    "toxicity": lambda t: toxicity.score(t("documents").where("doc_id < -1"), toxicity.train(t("documents").where("doc_id < -1"), t("labels"))),
    "media": lambda t: media.digests(media.media(t("documents").where("doc_id < -1"))),
    "leaks": lambda t: decontaminate.contaminated(t("documents"), t("benchmark").where("item_id < -1")),
    "repeats": lambda t: suffix_dedup.digests(suffix_dedup.remove_repeats(t("documents").where("doc_id < -1"))),
    "jaccard": lambda t: ngram_jaccard.similar_classes(t("documents").where("doc_id < -1")),
}


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_empty_tables_give_empty_results(spark, name):
    assert EMPTY[name](lambda t: table(spark, DATA, t)).collect() == []


def test_media_payloads(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, DATA, "documents").collect()}
    for r in queries.QUERIES["op7_media"](spark, DATA).collect():
        raw = texts.pop(r.doc_id)
        padded = raw + b"\0" * (max(-(-len(raw) // 64), 1) * 64 - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
    assert not texts


def test_toxicity_on_held_out_rows(spark):
    labels = table(spark, "/root/testdata/sf0.1", "labels").where("toxic is not null").select("doc_id", "toxic")
    rows = queries.QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.8 * sum(r.toxic for r in rows)
    assert hits >= 0.85 * sum(r.predicted for r in rows)
