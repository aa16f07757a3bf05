import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from tagloom.llm import common, repeats, substring_dedup, suffix_array_dedup
from tagloom.llm.induced import suffix_order
from tagloom.llm.repeats import Windows, repeated_windows
from tagloom.llm.subtrees import subtree
from tests.llm.common import ODD, frame


def by_words(docs, width):
    words = {d: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        off = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                off |= set(range(i, i + width))
        out[d] = len(w), len(off), b" ".join(x for i, x in enumerate(w) if i not in off).decode()
    return out


def by_bytes(docs, width):
    first, out = {}, {}
    docs = sorted((d, (t or "").encode()) for d, t in docs)
    for d, b in docs:
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], (d, i))
    for d, b in docs:
        off = set()
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] != (d, i):
                off |= set(range(i, i + width))
        spans = sum(i - 1 not in off for i in off)
        out[d] = len(b), len(off), spans, bytes(x for i, x in enumerate(b) if i not in off)
    return out


def corpus(seed, n=60):
    """Texts with shared passages, copies and edits, of few distinct words."""
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[random.choice(vocabulary) for _ in range(random.randint(8, 60))] for _ in range(6)]
    out = []
    for d in range(n):
        words = []
        for _ in range(random.randint(0, 6)):
            words += random.choice(passages) if random.random() < 0.6 else [random.choice(vocabulary) for _ in range(random.randint(1, 30))]
        if out and random.random() < 0.3:
            words = (random.choice(out)[1] or "").split()
            if words and random.random() < 0.5:
                words[random.randrange(len(words))] = "edit"
        out.append((d * 7 % n, random.choice([" ", "\n", "  "]).join(words)))
    return out


def test_words_equal_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        expected = by_words(docs, 10)
        for r in substring_dedup.substring_dedup(frame(spark, docs), 10).collect():
            assert (r.n_words, r.n_removed, r.kept) == expected[r.doc_id]


def test_bytes_equal_brute_force(spark):
    for seed in (3, 4):
        docs = corpus(seed)
        expected = by_bytes(docs, 24)
        for r in suffix_array_dedup.suffix_array_dedup(frame(spark, docs), 24).collect():
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == expected[r.doc_id]


def test_large_groups_are_dealt_out_and_give_the_same(spark):
    """A passage in many documents, each with its own surroundings, with groups so small that they are split."""
    random.seed(5)
    passage = [f"p{i}" for i in range(14)]
    docs = [(d, " ".join([f"a{random.random()}" for _ in range(6)] + passage + [f"b{random.random()}" for _ in range(6)])) for d in range(80)]
    expected = by_words(docs, 10)
    texts = frame(spark, docs).selectExpr("doc_id", "doc_id as key", "text")
    spec = Windows(width=10, gram=3, words=True, within=False, group_limit=7)
    found = repeated_windows(texts, spec, substring_dedup._resolve(10)).collect()
    for r in found:
        off = set()
        for g in r.gone:
            off |= set(range(g.start, g.start + g.windows + 9))
        assert len(off) == expected[r.doc_id][1]
    expected = by_bytes(docs, 24)
    spec = Windows(width=24, gram=8, words=False, within=True, group_limit=7)
    for r in repeated_windows(texts, spec, suffix_array_dedup._resolve(24)).collect():
        off = set()
        for g in r.gone:
            off |= set(range(g.start, g.start + g.windows + 23))
        assert len(off) == expected[r.doc_id][1]


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(60))
    docs = [*ODD, (9, long), (10, "x " + long), (None, long)]
    words = substring_dedup.substring_dedup(frame(spark, docs)).collect()
    assert len(words) == len(docs)
    assert {r.doc_id: r.n_removed for r in words if r.doc_id in (9, 10)} == {9: 60, 10: 60}  # a null id comes before all others
    assert all(r.n_removed == 0 for r in words if r.doc_id is None or r.doc_id < 8)
    found = suffix_array_dedup.suffix_array_dedup(frame(spark, docs)).collect()
    assert len(found) == len(docs)
    by_id = {r.doc_id: r for r in found}
    assert by_id[7].n_bytes == 70_000 and by_id[7].n_removed == 69_999 and by_id[7].n_spans == 1 and bytes(by_id[7].kept) == b"x"
    assert by_id[5].n_removed == 0


def test_ids_with_several_texts_and_repeated_rows(spark):
    docs = corpus(7)
    by_hash = {t: r.h for t, r in zip([t for _, t in docs], spark.createDataFrame([(t,) for _, t in docs], "t string").selectExpr("xxhash64(t) h").collect(), strict=True)}
    rows = [(d // 4 if d % 5 else None, t) for d, t in docs]
    places = {x: i for i, x in enumerate(sorted({(d is not None, d or 0, by_hash[t], t) for d, t in rows}))}
    numbered = [(places[(d is not None, d or 0, by_hash[t], t)], d, t) for d, t in rows]
    words, whole = by_words({(p, t) for p, _, t in numbered}, 10), by_bytes({(p, t) for p, _, t in numbered}, 24)
    again = [*rows, *rows[:9]]
    found = substring_dedup.substring_dedup(frame(spark, again), 10).collect()
    place = {(d, t): p for p, d, t in numbered}
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in found) == sorted((d is not None, d or 0, *words[place[d, t]]) for d, t in again)
    found = suffix_array_dedup.suffix_array_dedup(frame(spark, again), 24).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == sorted((d is not None, d or 0, *whole[place[d, t]]) for d, t in again)


def test_empty_tables(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0
    assert suffix_array_dedup.suffix_array_dedup(frame(spark, [])).count() == 0


def test_digest_of_query(spark, tmp_path):
    docs = corpus(6)
    frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    expected = by_words(docs, 50)
    for r in substring_dedup.query(spark, str(tmp_path)).collect():
        assert r.kept_sha256 == hashlib.sha256(expected[r.doc_id][2].encode()).hexdigest()


def test_suffix_order_spills_and_recurses():
    rng = np.random.default_rng(1)
    for it in range(400):
        n, letters = int(rng.integers(1, 60)), int(rng.integers(1, 5))
        text = np.append(rng.integers(1, letters + 1, n), 0)
        if it % 3 == 0:
            text = np.append(np.tile(rng.integers(1, letters + 1, max(1, n // 6)), 5), 0)
        order, shared = suffix_order(text, 200, budget=[5, 1 << 20][it % 2], short=[2, 1 << 20][it // 2 % 2])
        whole = text.tolist()
        assert order.tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])
        for a, b, k in zip(order[:-1].tolist(), order[1:].tolist(), shared[1:].tolist(), strict=True):
            assert whole[a : a + k] == whole[b : b + k] and (max(a, b) + k == len(whole) or whole[a + k] != whole[b + k])


def test_subtree_nodes_are_equal_windows():
    rng = np.random.default_rng(2)
    for _ in range(60):
        tokens = rng.integers(0, 3, 80).astype(np.uint64)
        depth = int(rng.integers(1, 12))
        starts = np.arange(80 - depth + 1)
        tree = subtree(tokens, starts, 80 - starts, depth)
        node = dict(zip(tree.leaves.tolist(), tree.nodes(depth).tolist(), strict=True))
        for a in starts:
            for b in starts:
                assert (node[a] == node[b]) == (tokens[a : a + depth] == tokens[b : b + depth]).all()
        for first, last, deep in tree.maximal_repeats(2):
            runs = {tuple(tokens[i : i + deep]) for i in tree.leaves[first : last + 1]}
            assert len(runs) == 1


def turned(n):
    """A sequence whose polynomial hashes modulo 2**64 equal those of its complement."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits[:n]), "".join("ba"[b] for b in bits[:n])


def test_words_that_collide_under_polynomials_are_different(spark):
    one, two = turned(1024)
    same = " ".join(f"t{i}" for i in range(49))
    found = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(frame(spark, [(1, f"{same} {one}"), (2, f"{same} {two}"), (3, f"{same} {one}")])).collect()}
    assert found == {1: 0, 2: 0, 3: 50}
    docs = [(1, one + one), (2, two + two), (3, two + two)]
    expected = by_bytes(docs, 100)
    for r in suffix_array_dedup.suffix_array_dedup(frame(spark, docs)).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == expected[r.doc_id]


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    from tagloom.llm import repeats
    from tagloom.llm.common import BYTE_VALUES

    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    spec = Windows(width=24, gram=8, words=False, within=True)
    whole = repeats.segments(BYTE_VALUES[data], np.array([0, 5000]), spec)
    monkeypatch.setattr(repeats, "PIECE", 700)
    cut = repeats.segments(BYTE_VALUES[data], np.array([0, 5000]), spec)
    anchors = [np.repeat(x["prefix"], x["run"] & ((1 << spec.count_bits) - 1)) for x in (whole, cut)]
    assert len(anchors[0]) == 5000 - 23 and (anchors[0] == anchors[1]).all()  # each window has the anchor that it has in the whole text


def test_words_hashed_in_pieces_have_the_values_of_the_whole(monkeypatch):
    rng = np.random.default_rng(4)
    words = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in [*rng.integers(1, 12, 400), 90, 1500, 3, 2000]]
    data = np.frombuffer(b"  ".join([b"", *words, b""]), np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
    whole = common.RangeHash(common.BYTE_VALUES[data]).of(starts, ends)
    for size in (1, 64, 1000, 1 << 18):
        monkeypatch.setattr(common, "CHUNK_BYTES", size)
        assert (common.word_values(data, starts, ends) == whole).all()
    assert len(common.word_values(data, starts[:0], ends[:0])) == 0


def test_a_shard_is_compared_in_little_memory():
    """2.6 MB of words in 3000 segments of 10 prefixes, as one task compares them; with the hash tables of all words at once it took 44 bytes for each byte of text."""
    rng = np.random.default_rng(5)
    vocabulary = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in rng.integers(4, 16, 500)]
    base = rng.integers(0, 500, (300, 84))
    contents = []
    for i in range(3000):
        of = base[i // 10].copy()
        of[-1 - i % 10] = i % 500
        contents.append(b" ".join(vocabulary[j] for j in of))
    n = len(contents)
    columns = {"prefix": np.arange(n) // 300, "salt": np.zeros(n, int), "key": np.arange(n), "start": np.zeros(n, int), "windows": np.full(n, 35), "content": contents}
    shard = pa.RecordBatch.from_pydict({k: pa.array(v, repeats._REQUEST_SCHEMA.field(k).type) for k, v in columns.items()}, schema=repeats._REQUEST_SCHEMA)
    spec = Windows(width=50, gram=16, words=True, within=False)
    tracemalloc.start()
    try:
        found = [x for b in repeats._resolved(spec, substring_dedup._resolve(50))(iter([shard])) for x in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    first, gone = {}, set()
    for key, content in enumerate(contents):
        words = content.split()
        for i in range(35):
            if first.setdefault(tuple(words[i : i + 50]), key) < key:
                gone.add((key, i))
    assert {(x["key"], i) for x in found for i in range(x["start"], x["start"] + x["windows"])} == gone
    assert peak < 28 * sum(map(len, contents)), peak / sum(map(len, contents))
