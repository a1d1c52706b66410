"""Every query against a plain version over a small hostile table, and over empty tables."""

import hashlib
import zlib

import numpy as np
import pytest

from pairwise.llm import byte_bpe
from pairwise.llm.queries import QUERIES, SQL
from tests.llm import brute
from tests.llm.conftest import make_chats, make_documents, make_items
from tests.oracle import compare, connect

DOCUMENTS = make_documents()
TEXTS = [(doc, text) for doc, text, *_ in DOCUMENTS]


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def same(found, expected):
    assert found == sorted(map(tuple, expected), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty_tables, name):
    found = QUERIES[name](spark, empty_tables).collect()
    assert [r["conv_id"] for r in found] == ([-1] if name.startswith("op2_") else [])


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, data, name):
    assert compare(QUERIES[name](spark, data), connect(data), SQL[name]) is None


def test_host_rules(spark, tables):
    found = QUERIES["op1_host_rules"](spark, tables)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same(rows(found, *names), [(doc, *brute.rules(text)) for doc, text in TEXTS])
    assert not found.filter("base_failed and kept").count()


def test_chat_masks(spark, tables):
    said = "</s>[INST] ok [/INST]"
    chats = [*make_chats(), (-1, 0, "user", said), (-1, 1, "assistant", said)]
    found = QUERIES["op2_chat_masks"](spark, tables)
    same(rows(found, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"), brute.chats(chats))


def test_suffix_arrays(spark, tables):
    found = QUERIES["op3_suffix_arrays"](spark, tables)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = brute.contamination(TEXTS, make_items())
    assert sum(r[-1] for r in expected) > 5
    same(rows(found, *names), expected)


def test_token_counts(spark, tables):
    own = byte_bpe.codec()
    for r in QUERIES["op4_token_counts"](spark, tables).collect():
        whole = [r[f"{x}_tokens"] for x in ("lang", "source", "text", "separator")]
        assert sum(whole) == r["n_tokens"] >= 1
    expected = [(d, len(own.encoding.encode_ordinary("\n".join(x or "" for x in (lang, source, text)))), len((text or "").split("\n")))
                for d, text, lang, source, _ in DOCUMENTS]
    same(rows(QUERIES["op4_token_counts"](spark, tables), "doc_id", "n_tokens", "n_sections"), expected)


def test_quality_classifier(spark, tables):
    found = QUERIES["op5_quality_classifier"](spark, tables).collect()
    assert sorted(map(repr, (r["doc_id"] for r in found))) == sorted(map(repr, (d for d, _ in TEXTS)))
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_substring_dedup(spark, tables):
    found = QUERIES["op6_substring_dedup"](spark, tables)
    same(rows(found, "doc_id", "n_words", "n_removed", "kept_sha256"), brute.repeats(TEXTS))


def test_secret_scan(spark, tables):
    found = QUERIES["op7_secret_scan"](spark, tables)
    expected = [(doc, *brute.secrets(text)) for doc, text in TEXTS]
    assert sum(sum(r[1:4]) for r in expected) >= 6
    same(rows(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), expected)
    for r in found.collect():
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert [kinds.count(k) for k in ("assign", "access", "hex")] == [r["n_assign"], r["n_access"], r["n_hex"]]


def test_simhash(spark, tables):
    found = QUERIES["op8_simhash_dedup"](spark, tables)
    same(rows(found, "doc_id", "fingerprint", "component_id"), brute.classes(TEXTS))


def test_line_dedup(spark, tables):
    found = QUERIES["op9_line_dedup"](spark, tables)
    expected = brute.lines(TEXTS)
    assert sum(r[2] for r in expected) > 5
    same(rows(found, "doc_id", "n_lines", "n_dropped", "kept_sha256"), expected)


def test_byte_bpe(spark, tables):
    own, expected = byte_bpe.codec().encoding, []
    for doc, text in TEXTS:
        ids = own.encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((doc, len(ids), digest, brute.sha(text or "")))
    found = QUERIES["op10_byte_bpe"](spark, tables)
    same(rows(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), expected)


def test_minhash_bayes(spark, tables):
    found = QUERIES["op11_minhash_bayes"](spark, tables)
    # a row without an id is kept if no row of an id has its class
    expected = [(doc, n, component, doc == component) for doc, n, component, _ in brute.similar(TEXTS)]
    assert sum(not r[3] for r in expected) > 15
    same(rows(found, "doc_id", "n_shingles", "component_id", "kept"), expected)


def test_phrase_mining(spark, tables):
    found = QUERIES["op12_phrase_mining"](spark, tables)
    expected = brute.phrases([(lang, text) for _, text, lang, *_ in DOCUMENTS])
    assert expected
    same(rows(found, "lang", "rank", "phrase", "a", "l", "r", "n", "score"), expected)


def test_prefix_trie(spark, tables):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    same(rows(QUERIES["op13_prefix_trie"](spark, tables), *names), brute.trie(make_chats()))
