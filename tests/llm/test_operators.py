"""Inner parts of the operators: cases that small tables do not reach."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairwise.llm import (
    arrow_text,
    byte_bpe,
    chat_masks,
    components,
    host_rules,
    line_dedup,
    minhash_bayes,
    packed_hashes,
    phrase_mining,
    prefix_trie,
    quality_classifier,
    secret_scan,
    simhash_dedup,
    substring_dedup,
    suffix_arrays,
    token_counts,
)
from tests.llm import brute

ALPHABET = "ab  \n\n\t'slrvemtd 12!?é日😀\u0085 \x1c"
texts = st.text(st.sampled_from(ALPHABET), max_size=80)
quick = settings(max_examples=300, deadline=None)


# ---- texts as arrays -------------------------------------------------------------------------------


@quick
@given(st.lists(st.one_of(st.none(), texts), max_size=8))
def test_words_of_a_batch(rows):
    column = pa.array(["padding", *rows], pa.string()).slice(1)
    split = arrow_text.split_words(column, arrow_text.UNCHANGED)
    words = split.vocabulary.take(pa.array(split.codes)).to_pylist()
    found = [[w.decode() for w in words[a:b]] for a, b in zip(split.first, split.first[1:], strict=False)]
    assert found == [brute.WORD.findall(r or "") for r in rows]


# ---- byte-level BPE --------------------------------------------------------------------------------


@quick
@given(texts, st.integers(1, 9))
def test_tree_gives_the_tokens_of_the_whole(text, leaf):
    codec = byte_bpe.codec()
    ids = codec.encode(text, leaf)
    assert ids.tolist() == codec.encoding.encode_ordinary(text)
    assert codec.decode(ids, leaf) == text.encode()


def test_white_space_of_all_planes_settles_as_the_pattern_has_it():
    codec = byte_bpe.codec()
    odd = [c for c in range(0x110000) if chr(c).isspace() or c in (0x1C, 0x200B, 0x180E, 0xFEFF)]
    for c in odd:
        text = f"a{chr(c)}b{chr(c)}{chr(c)} c"
        for leaf in (1, 2, 3):
            assert codec.encode(text, leaf).tolist() == codec.encoding.encode_ordinary(text)


def test_long_text_without_a_settled_place():
    codec = byte_bpe.codec()
    text = "x" * 9000 + "1" * 9000
    assert codec.encode(text, 100).tolist() == codec.encoding.encode_ordinary(text)


# ---- token counts ----------------------------------------------------------------------------------


@quick
@given(st.lists(texts, min_size=1, max_size=4))
def test_counts_follow_the_rule(values):
    total, fields, separators, crossing, sections = token_counts.count_tokens(
        values, "\n", token_counts.VOCABULARY, token_counts.PATTERN
    )
    own, text = byte_bpe.codec(), "\n".join(values)
    bounds, at = [], 0
    for k, value in enumerate(values[:-1]):
        bounds += [(at, at + len(value), k), (at + len(value), at + len(value) + 1, "separator")]
        at += len(value) + 1
    lines = values[-1].split("\n")
    for k, line in enumerate(lines):
        end = at + len(line) + (k < len(lines) - 1)
        bounds.append((at, end, ("line", k)))
        at = end
    want, byte, crosses = {}, 0, 0
    starts = [len(c.encode()) for c in text]
    place = [0, *np.cumsum(starts).tolist()]
    for token in own.encoding.encode_ordinary(text):
        size = len(own.tokens[token])
        first = max(i for i, p in enumerate(place[:-1]) if p <= byte)
        last = max(i for i, p in enumerate(place[:-1]) if p <= byte + size - 1)
        byte += size
        shares = [(min(b, last + 1) - max(a, first), name) for a, b, name in bounds]
        crosses += sum(s > 0 for s, _ in shares) > 1
        name = max(shares, key=lambda s: s[0])[1]  # the first of the largest
        want[name] = want.get(name, 0) + 1
    assert (total, crossing) == (sum(want.values()), crosses)
    assert fields[:-1] == [want.get(k, 0) for k in range(len(values) - 1)]
    assert separators == want.get("separator", 0)
    assert sections == [want.get(("line", k), 0) for k in range(len(lines))] and fields[-1] == sum(sections)


# ---- chat masks ------------------------------------------------------------------------------------

said = st.lists(st.sampled_from([*chat_masks.CONTROLS, "\\", "<", "<s", "[", "INST]", "|>", "a", " b", "\n", "é", "😀"]), max_size=8)


@quick
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>"]), said.map("".join)), min_size=1, max_size=5))
def test_chats_are_read_back(turns):
    text, ids, tokens, chars = chat_masks.format_conversation(turns, ("assistant",), chat_masks.TOKENIZER)
    assert chat_masks.parse(text) == turns
    assert [chat_masks.unescape(text[a:b]) for a, b in chars] == [t for r, t in turns if r == "assistant" and t]
    for control in (chat_masks.TURN, chat_masks.BODY, chat_masks.END):
        assert text.count(control) == len(turns)
    for control in ("</s>", "[INST]", "[/INST]", "<s>"):
        assert control not in text
    own = chat_masks.tokenizer(chat_masks.TOKENIZER)
    numbers = np.frombuffer(ids, "<u4").tolist()
    assert own.decode(numbers, skip_special_tokens=False) == text
    learned = "".join(own.decode(numbers[a:b], skip_special_tokens=False) for a, b in tokens)
    assert chat_masks.unescape(learned) == "".join(t for r, t in turns if r == "assistant")


# ---- suffix arrays ---------------------------------------------------------------------------------


@quick
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_suffixes_are_sorted(values, depth):
    sequence = np.array([*values, *[0] * 80])
    starts = np.arange(len(values))
    order = suffix_arrays.suffix_array(sequence, starts, depth)
    keys = [tuple(sequence[i : i + depth]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(starts)


def test_many_words_in_the_sort_key():
    rng = np.random.default_rng(1)
    sequence = np.concatenate((rng.integers(1, 1 << 20, 500), rng.integers(1, 3, 500), np.zeros(80, int)))
    order = suffix_arrays.suffix_array(sequence, np.arange(1000), 40)
    keys = [tuple(sequence[i : i + 40]) for i in order]
    assert keys == sorted(keys)


def test_blocks_of_test_items_give_the_same(spark, documents):
    rows, docs = documents
    items = [(k, rows[k][1]) for k in range(0, 60, 7)] + [(5, "w1 w2"), (None, rows[40][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    key = F.struct("doc_id", "text", "n_words", "hits", "items", "matches").cast("string").alias("k")
    one = suffix_arrays.find_contamination(docs, benchmark).select(key).collect()
    more = suffix_arrays.find_contamination(docs, benchmark, block_bytes=600).select(key).collect()
    assert sorted(one) == sorted(more) and len(one) == len(rows)


def maximal_matches(text, item, window):
    """(word, n_words, item_word) of every maximal run of equal words that holds a window of the item."""
    word = brute.re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    a, b = (word.findall(t.translate(brute.LOWER)) for t in (text, item))
    least = min(window, len(b))
    out = []
    for p in range(len(a)):
        for i in range(len(b)):
            if p and i and a[p - 1] == b[i - 1]:
                continue
            n = 0
            while p + n < len(a) and i + n < len(b) and a[p + n] == b[i + n]:
                n += 1
            if n >= least > 0:
                out.append((p, n, i))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_all_maximal_matches_against_plain_loops(spark, block_bytes):
    rng = np.random.default_rng(11)

    def text(n, words):
        return " ".join(f"w{k}" for k in rng.integers(0, words, n))

    items = [(k, text(int(n), 3 + k % 4)) for k, n in enumerate(rng.integers(0, 70, 12))] + [(50, ""), (51, "w1 w2")]
    docs = [(k, text(40, 5) + " Q " + items[k % 12][1][3:] + " " + text(30, 4)) for k in range(20)]
    docs += [docs[0], (100, ""), (101, None), (None, docs[3][1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(2)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = suffix_arrays.find_contamination(frame, benchmark, window=6, block_bytes=block_bytes, places=True).collect()
    assert len(rows) == len(docs)
    for row in rows:
        found = {}
        for name, item in items:
            if at := maximal_matches(row.text or "", item, 6):
                found[name] = at
        got = {}
        for m in row.places:
            got.setdefault(m["item_id"], []).append((m["word"], m["n_words"], m["item_word"]))
        assert {k: sorted(v) for k, v in got.items()} == found and row["items"] == sorted(found)
        best = {k: (min(p for p, n, _ in v if n == max(n for _, n, _ in v)), max(n for _, n, _ in v)) for k, v in found.items()}
        assert {m["item_id"]: (m["word"], m["n_words"]) for m in row.matches} == best
        covered = {w for v in found.values() for p, n, _ in v for w in range(p, p + n)}
        assert {w for a, b in zip(row.hits[::2], row.hits[1::2], strict=True) for w in range(a, b)} == covered
        word = brute.re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        assert row.n_words == len(word.findall((row.text or "").translate(brute.LOWER)))


def test_a_column_named_places_stays(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id bigint, text string, places string")
    benchmark = spark.createDataFrame([(7, "a b")], "item_id bigint, text string")
    row = suffix_arrays.find_contamination(docs, benchmark).first()
    assert row["places"] == "x" and row["items"] == [7]


def test_longest_matches_and_places(spark):
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, "x " + " ".join(words[5:30]) + " y " + " ".join(words[40:52]))], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    row = suffix_arrays.find_contamination(docs, benchmark).first()
    assert row.hits == [1, 26, 27, 39] and row["items"] == [7]
    assert [tuple(m) for m in row.matches] == [(7, 1, 25)]


# ---- quality classifier ----------------------------------------------------------------------------


def test_context_sums_do_not_depend_on_the_batches():
    index = quality_classifier.index_vectors()
    rows = ["a b c d!! e", None, "", "b a b", "!!! x"]
    whole, parts = (np.zeros((quality_classifier.BUCKETS, quality_classifier.SIZE), np.int64) for _ in range(2))
    quality_classifier.add_contexts(whole, *quality_classifier.tokens(pa.array(rows)), index)
    for row in rows:
        quality_classifier.add_contexts(parts, *quality_classifier.tokens(pa.array([row], pa.string())), index)
    assert (whole == parts).all()
    own, _ = quality_classifier.tokens(pa.array(["b a b"]))
    alone = np.zeros_like(whole)
    quality_classifier.add_contexts(alone, own, np.array([0, 3]), index)
    assert (alone[own[1]] == 2 * index[own[0]]).all() and (alone[own[0]] == 2 * index[own[1]].astype(int) + 2 * index[own[0]]).all()


def test_held_out_accuracy(spark):
    """Held-out labels, beyond what a constant reaches."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(docs, labels)
    scored = quality_classifier.score(docs, model).join(labels, "doc_id").filter(quality_classifier.held_out())
    rows = scored.select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    accuracy = np.mean([(r.score >= 0.7) == r.quality for r in rows])
    assert auc > 0.99 and accuracy > 0.99
    assert np.mean([g >= 0.7 for g in good]) > 0.99


def test_labels_of_the_held_out_fold_change_nothing(spark, documents):
    _, docs = documents
    plain = [(k, int(k < 30)) for k in range(70)]
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q) for k, q in plain]
    scores = []
    for labels in (plain, turned):
        frame = spark.createDataFrame(labels, "doc_id bigint, quality int")
        model = quality_classifier.train(docs, frame)
        scores.append(sorted(r.score for r in quality_classifier.score(docs, model).collect()))
    assert scores[0] == scores[1]


@pytest.mark.parametrize("labels", [[], [(k, 1) for k in range(20)]])
def test_nothing_to_learn(spark, documents, labels):
    _, docs = documents
    model = quality_classifier.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    (score,) = {r.score for r in quality_classifier.score(docs, model).select("score").collect()}
    assert 0 < score < 1 and (score > 0.9) == bool(labels)


# ---- substring dedup -------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [2000, 1 << 20])
def test_blocks_and_buckets_change_nothing(spark, documents, size):
    rows, docs = documents
    found = substring_dedup.remove_repeats(docs, block_bytes=size, bucket_bytes=size).collect()
    digests = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), brute.sha(r.kept_text)) for r in found]
    assert sorted(digests, key=repr) == sorted(brute.repeats([r[:2] for r in rows]), key=repr)


def test_a_hash_order_survives_packing():
    values = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64))
    assert (packed_hashes.unpacked(packed_hashes.packed(values)) == values).all()
    assert (packed_hashes.unpacked(packed_hashes.packed(values[:1])) == values[:1]).all()


# ---- secret scan -----------------------------------------------------------------------------------


@quick
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "AKIA", "ſecret", "secret", ":", "=", " ", '"', "'", "abcdef", "0123456789", "Z9Z9Z9Z9", "é", "."]), max_size=12).map("".join))
def test_base_spans(text):
    scan = secret_scan.Scan(pa.array(["other", text, None]))
    found = scan.base[1]
    digest = brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))
    counts = [sum(k == kind for k, *_ in found) for kind in secret_scan.KINDS[:3]]
    assert (*counts, digest) == brute.secrets(text)


def test_random_strings_are_told_from_identifiers(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    noise = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(200)]
    words = ["getUserName", "internationalization", "process_next_message", "configurationManager", "the", "values", "version2", "2024", "HTTP"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(40)) + (f" token={noise[k]}" if k < 100 else f" é {noise[k]} end")) for k in range(200)]
    found = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for r in found:
        text = rows[r.doc_id][1]
        kinds = {s.kind: text[s.start : s.end] for s in r.spans}
        assert kinds == ({"assign": f"token={noise[r.doc_id]}"} if r.doc_id < 100 else {"random": noise[r.doc_id]})


# ---- simhash ---------------------------------------------------------------------------------------


def connected(prints):
    left, groups = set(prints), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            todo += near
        groups.append(group)
    return {min(map(simhash_dedup._signed, g)): {simhash_dedup._signed(x) for x in g} for g in groups}


@pytest.mark.parametrize("bucket", [8, 2048])
def test_links_of_dense_and_sparse_fingerprints(spark, monkeypatch, bucket):
    """Small buckets force the index through all its levels."""
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(200)} | {0, 7, 15, 2**64 - 1}
    for _ in range(3):
        centre = rng.getrandbits(64)
        weak = rng.sample(range(64), 11)
        prints |= {centre ^ sum(1 << b for b in rng.sample(weak, rng.randrange(7))) for _ in range(60)}
    for _ in range(40):
        chain = rng.getrandbits(64)
        for _ in range(5):
            prints.add(chain)
            chain ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])))
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    frame = spark.createDataFrame([(simhash_dedup._signed(x),) for x in prints], "fp bigint")
    links = simhash_dedup.links(frame)
    for a, b in links.collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    roots = components.components(links).collect()
    found = {}
    for x in map(simhash_dedup._signed, prints):
        found.setdefault(x, {x})
    for r in roots:
        found[r.root].add(r.node)
        found.pop(r.node)
    assert found == connected(prints)


def test_components_of_long_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (7, 3)]
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in found} == {**{k: 0 for k in range(1, 201)}, **{1000 + k: 1000 for k in range(1, 300)}}


# ---- line dedup ------------------------------------------------------------------------------------


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_a_line_of_all_documents_spans_partitions(spark, partitions):
    line, other = "the same long line in each and every document", "another long line that only few documents hold"
    rows = [(k, f"{line}\nown line {k}\n{line}" + f"\n{other}" * (k % 40 == 0)) for k in range(160)]
    rows += [(None, line), (None, line + "x"), (159, line), (3, line)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = [(r.doc_id, r.n_lines, r.n_dropped, brute.sha(r.text)) for r in line_dedup.dedup_lines(docs).collect()]
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert sorted(found, key=repr) == sorted(brute.lines(rows), key=repr)


# ---- host rules ------------------------------------------------------------------------------------


def test_rates_are_shrunk_towards_the_hosts(spark):
    good, bad = "alpha beta gamma " + " ".join(f"word{k}" for k in range(60)), "too short"
    rows = [(k, good if k % 10 else bad, "large") for k in range(200)] + [(900, bad, "single"), (901, good, None)]
    rows += [(1000 + k, bad, "rotten") for k in range(50)] + [(1100, good, "rotten")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.host: r for r in host_rules.host_rules(frame).groupBy("host").agg(F.first("rate_short").alias("rate"), F.count_if("kept").alias("kept")).collect()}
    assert found["large"].rate == pytest.approx(0.1, abs=0.02) and found["large"].kept == 180
    assert found["rotten"].rate > 0.9 and found["rotten"].kept == 0  # the one good document goes with its host
    assert found["large"].rate < found["single"].rate < found["rotten"].rate
    assert found[None].kept == 1


def test_each_rule_has_its_own_prior_and_verdict(spark):
    """A host of symbols and one of repetition among thirty ordinary ones; a small host is not condemned for two texts."""
    good = " ".join(f"word{k}" for k in range(60))
    symbols, repeats = f"{good} " + "# " * 20, "ab cd ef " * 30
    rows = [(k, symbols if k % 20 == 0 else good, f"host{k % 30}") for k in range(900)]
    rows += [(2000 + k, symbols if k < 90 else good, "marks") for k in range(100)]
    rows += [(3000 + k, repeats if k < 95 else good, "spam") for k in range(100)]
    rows += [(4000, symbols, "small"), (4001, good, "small"), (4002, symbols, "small")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    hosts = {r.host: r for r in host_rules.host_rates(host_rules.with_failures(host_rules.base_counts(frame))).collect()}
    assert {h for h, r in hosts.items() if r.host_rejected} == {"marks", "spam"}
    assert hosts["marks"].rejects_symbols and not hosts["marks"].rejects_repeats and hosts["spam"].rejects_repeats
    assert (hosts["marks"].docs_symbols, hosts["marks"].n_bad, hosts["spam"].docs_repeats) == (90, 90, 95)
    assert hosts["small"].rate_symbols < 2 / 3
    kept = {r.source for r in host_rules.host_rules(frame).filter("kept").join(frame, "doc_id").select("source").distinct().collect()}
    assert "marks" not in kept and "spam" not in kept and {"small", "host0"} <= kept


def test_equal_rows_are_spread_over_blocks(spark):
    """A text that stands in most rows fills many blocks, and no block is larger than others."""
    text = " ".join(f"w{k}" for k in range(60))
    frame = spark.range(0, 20_000, 1, 4).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    sizes = []
    for batch in frame.mapInArrow(substring_dedup._packer(50_000), substring_dedup._BLOCK).collect():
        sizes.append(substring_dedup._read(bytes(batch.body)).num_rows)
    assert sum(sizes) == 20_000 and len(sizes) >= 80 and max(sizes) < 400
    found = substring_dedup.remove_repeats(frame, block_bytes=50_000).groupBy("kept_text").count().collect()
    assert [tuple(r) for r in found] == [("", 20_000)]


# ---- MinHash with Bayesian verification ------------------------------------------------------------


def test_posterior_bound_is_the_beta_tail():
    """P(similarity >= 0.8 | m of n) by numeric integration of the posterior."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    for k, least in enumerate(minhash_bayes.least_matches(1e-6)):
        n = (k + 1) * minhash_bayes.BATCH
        tail = []
        for m in (least - 1, least):
            density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            tail.append(density[grid >= 0.8].sum() / density.sum())
        assert tail[0] < 1e-6 <= tail[1]


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(3)
    both = rng.integers(0, 1 << 63, 900, np.uint64)
    one, other = np.unique(both[:850]), np.unique(both[50:])
    agreeing = (minhash_bayes.signature(one) == minhash_bayes.signature(other)).mean()
    assert abs(agreeing - 800 / 900) < 0.12
    assert (minhash_bayes.signature(one) == minhash_bayes.signature(one[::-1])).all()


def _families(rng):
    """Texts of 60 words in families whose members share most, some or few of their shingles with each other."""
    out = []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(60)]
        for k in range(14):
            words = list(base)
            for at in rng.sample(range(60), k % 4):
                words[at] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("chunk", "crowd", "few"), [(3, 1000, 0), (5, 4, 1000), (4096, 1 << 17, 2)])
def test_classes_do_not_depend_on_the_sizes(spark, monkeypatch, chunk, crowd, few):
    for name, value in (("CHUNK", chunk), ("CROWD", crowd), ("FEW", few)):
        monkeypatch.setattr(minhash_bayes, name, value)
    docs = list(enumerate(_families(random.Random(9))))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    found = minhash_bayes.near_duplicates(frame).collect()
    want = sorted(brute.similar(docs))
    assert 10 < len({c for _, _, c, _ in want}) < 70
    assert sorted(map(tuple, found)) == want


def test_a_crowd_of_unlike_candidates_is_settled(spark):
    """Half of each text is boilerplate: buckets hold many pairs under the threshold, and some over it."""
    rng = random.Random(2)
    shared = " ".join(f"b{k}" for k in range(70))
    docs = [(k, f"{shared} {' '.join(f'o{rng.randrange(10**6)}' for _ in range(14 + k % 5))}") for k in range(60)]
    docs += [(100 + k, text + " end") for k, (_, text) in enumerate(docs[:20])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert sorted(map(tuple, minhash_bayes.near_duplicates(frame).collect())) == sorted(brute.similar(docs))


# ---- phrases ---------------------------------------------------------------------------------------


def _mined(spark, docs, **sizes):
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    return sorted(map(tuple, phrase_mining.collocations(frame, min_count=3, top=30, **sizes).collect()), key=repr)


PHRASE_TEXTS = [
    (random.Random(k).choice(["en", "fr", None]), " ".join(random.Random(k).choices("the of a. new york; City\tx é , \x0c".split(" "), k=60)))
    for k in range(40)
]


def test_phrases_do_not_depend_on_blocks_and_buckets(spark):
    want = sorted(brute.phrases(PHRASE_TEXTS, min_count=3, top=30), key=repr)
    assert len(want) > 40
    for sizes in ({}, {"block_bytes": 50, "bucket_bytes": 20}):
        assert _mined(spark, PHRASE_TEXTS, **sizes) == want


def test_phrases_of_equal_hashes_are_told_apart(monkeypatch):
    """Hashes cut to six bits collide all the time; the counts by text stay exact."""

    class Weak(phrase_mining.Polynomial):
        def of(self, begin, size, seed):
            return super().of(begin, size, seed) & np.uint64(63)

    monkeypatch.setattr(phrase_mining, "Polynomial", Weak)
    body = b"a b a b c a b\nc a b d a b"
    phrases = phrase_mining.Phrases(body, "en")
    distinct, _ = phrases.distinct((1, 2, 3))
    counts = {}
    for _, _, texts, f in phrases.frequent(distinct, (1, 2, 3)):
        for text, n in zip(texts.to_pylist(), f.tolist(), strict=True):
            counts[text] = counts.get(text, 0) + n
    want = {}
    for piece in body.decode().split("\n"):
        words = piece.split(" ")
        for s in (1, 2, 3):
            for i in range(len(words) - s + 1):
                want[" ".join(words[i : i + s])] = want.get(" ".join(words[i : i + s]), 0) + 1
    assert counts == want


def test_a_long_text_is_cut_between_pieces():
    body = b"one two\nthree\n" * 50 + b"x" * 100 + b"\nend"
    parts = list(phrase_mining._cut(body, 40))
    assert b"".join(parts) == body and len(parts) > 15
    assert all(p.endswith(b"\n") for p in parts[:-1])


def test_scores_past_64_bits_are_exact(spark):
    big = 30_000_000_000_000_001
    counted = [("en", 0, "", 3 * big), ("en", 1, "a", big), ("en", 1, "b", big - 7), ("en", 2, "a b", big - 11)]
    frame = spark.createDataFrame(counted, "lang string, size int, phrase string, f bigint")
    found = phrase_mining.score_phrases(frame).first()
    assert found["score"] == 1000 * (big - 11) * 3 * big // (big * (big - 7))


# ---- prefix trie -----------------------------------------------------------------------------------


def _talks(n, seed):
    """Turns of conversations with many shared beginnings, copies, and very unlike depths."""
    rng = random.Random(seed)
    for conv in range(n):
        turns = [rng.choice("ab") * rng.randrange(1, 3) for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 12]))]
        yield from ((conv, k, "user", text) for k, text in enumerate(turns))


@pytest.mark.parametrize("partition_bytes", [300, 2000, 1 << 20])
def test_trie_over_many_partitions_and_rounds(spark, partition_bytes):
    chats = list(_talks(300, 4)) + [(900 + k, 0, "user", "hot") for k in range(120)]
    frame = spark.createDataFrame(chats, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    found = prefix_trie.trie(frame, partition_bytes=partition_bytes)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute.trie(chats), key=repr)


@quick
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=5), min_size=1, max_size=12), st.integers(1, 6))
def test_forests_of_parts_contract_to_the_whole(talks, parts):
    """Any cut of the sorted paths into partitions gives the nodes of one forest over all."""
    paths = sorted((b"".join(c.encode() * prefix_trie.WIDTH for c in talk), k) for k, talk in enumerate(talks))

    def lengths(path):
        return b"".join((1 + path[k]).to_bytes(8, "little") for k in range(0, len(path), prefix_trie.WIDTH))

    def forest(items, whole):
        own = [p for p, _ in items]
        return own, prefix_trie.Forest(own, [lengths(p) for p in own], [a for _, a in items], whole)

    def told(own, made):
        return {(own[c][: d * prefix_trie.WIDTH], *rest[:-1]) for c, d, *rest in made.nodes}

    items = [(p, {len(p) // prefix_trie.WIDTH: [1, k, 0, 0, 0]}) for p, k in paths]
    own, made = forest([(p, {d: list(x) for d, x in a.items()}) for p, a in items], True)
    want, found, spines = told(own, made), set(), []
    for part in np.array_split(np.arange(len(items)), parts):
        if len(part):
            own, made = forest([items[i] for i in part], False)
            found |= told(own, made)
            spines += [(own[at], adds) for at, adds in made.spines.items()]
    own, made = forest(sorted(spines, key=lambda x: x[0]), True)
    assert found | told(own, made) == want and not found & told(own, made)
