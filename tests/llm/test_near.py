import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tagloom.llm import common, near_duplicates, simhash_dedup
from tagloom.llm.components import components
from tests.llm.common import ODD, frame


def fingerprint(text, size=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(keys, linked):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_components(spark):
    random.seed(3)
    for n, m in ((50, 40), (200, 1000)):
        edges = [(random.randrange(n) * 7 - 100, random.randrange(n) * 7 - 100) for _ in range(m)] + [(i * 7 + 5000, i * 7 + 5007) for i in range(60)]
        expected = groups({x for e in edges for x in e}, edges)
        found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert all(found.get(k, k) == v for k, v in expected.items())


def test_links_find_all_pairs_also_in_crowds(spark):
    random.seed(4)
    values = {random.getrandbits(64) for _ in range(40)}
    for base in list(values)[:20]:
        for _ in range(random.randrange(1, 50)):
            x = base
            for _ in range(random.randrange(1, 4)):
                x ^= 1 << random.randrange(64)
            values.add(x)
    values = sorted(values)
    signed = [(i, x - 2**64 if x >= 2**63 else x) for i, x in enumerate(values)]
    near = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    expected = groups(range(len(values)), near)
    found = {r.node: r.component for r in components(simhash_dedup.links(spark.createDataFrame(signed, "node long, fingerprint long"))).collect()}
    assert all(found.get(k, k) == v for k, v in expected.items())


def test_fingerprints_and_classes_of_odd_rows(spark):
    rows = [*ODD, (20, "A b C d"), (21, "a B c D"), (22, "one two")]
    found = simhash_dedup.simhash_components(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    texts = sorted((i if i is not None else -(2**63), t or "") for i, t in rows)
    assert sorted((r.key, r.fingerprint % 2**64) for r in found) == sorted((k, fingerprint(t)) for k, t in texts)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[20].component == by_id[21].component == 20
    assert by_id[1].component == by_id[2].component == by_id[3].component  # no words: zero, linked like any other
    assert simhash_dedup.simhash_components(frame(spark, [])).count() == 0


def test_near_duplicates_of_planted_copies(spark):
    random.seed(6)
    word = lambda: f"w{random.randrange(5000)}"
    rows, family = [], {}
    for d in range(0, 400, 4):
        words = [word() for _ in range(random.randint(120, 400))]
        rows.append((d, " ".join(words)))
        family[d] = d
        if d % 12 == 0:
            rows.append((d + 1, " ".join(words)))
            edited = list(words)
            for _ in range(len(words) // 120):
                edited[random.randrange(len(words))] = word()
            rows.append((d + 2, " ".join(edited)))
            family[d + 1] = family[d + 2] = d
    found = {r.key: r.component for r in near_duplicates.near_duplicate_components(frame(spark, rows)).collect()}
    assert found == family
    kept = near_duplicates.one_of_each(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(0, 400, 4))
    assert kept.columns == frame(spark, rows).columns


def test_near_duplicates_of_odd_rows(spark):
    found = {r.key: r.component for r in near_duplicates.near_duplicate_components(frame(spark, ODD)).collect()}
    assert found[4] == found[5] == 4 and found[7] == 7
    assert near_duplicates.near_duplicate_components(frame(spark, [])).count() == 0


def similar_pairs(rows, similarity=0.8, size=5):
    """Pairs of keys by brute force over the sets of shingles."""
    sets = {}
    for k, t in rows:
        words = t.split()
        sets[k] = {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} or {t}
    keys = sorted(sets)
    return [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity]


def test_near_duplicates_of_short_texts_by_brute_force(spark):
    random.seed(8)
    word = lambda: f"w{random.randrange(90_000)}"
    rows = []
    for _ in range(150):
        words = [word() for _ in range(random.randint(9, 30))]
        rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join([*words, word()] if random.random() < 0.5 else [*words[:-1], word()])))  # similarities from 0.67 to 0.96
    expected = groups(range(len(rows)), similar_pairs(rows))
    found = {r.key: r.component for r in near_duplicates.near_duplicate_components(frame(spark, rows)).collect()}
    wrong = sum(found[k] != expected[k] and expected[k] == k for k in found)
    assert not wrong  # no pair below 0.8 is linked


def test_near_duplicates_find_every_pair_also_in_a_family_with_a_template(spark):
    random.seed(10)
    word = lambda: f"w{random.randrange(90_000)}"
    rows = []
    for _ in range(150):
        words = [word() for _ in range(random.randint(9, 30))]
        rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join([*words, word()])))
    expected = groups(range(len(rows)), similar_pairs(rows))
    template = [word() for _ in range(90)]
    for _ in range(2500):  # similarity of two members: about 0.75, of two that belong together: about 0.85
        own = [word() for _ in range(13)]
        rows.append((len(rows), " ".join(template + own)))
        expected[len(rows) - 1] = len(rows) - 1
        if random.random() < 0.1:
            rows.append((len(rows), " ".join(template[:-6] + [word()] * 2 + template[-4:] + own)))
            expected[len(rows) - 1] = len(rows) - 2
    some = rows[300:560]
    assert groups([k for k, _ in some], similar_pairs(some)) == {k: expected[k] for k, _ in some}
    found = {r.key: r.component for r in near_duplicates.near_duplicate_components(frame(spark, rows)).collect()}
    assert found == expected


def test_clashing_and_missing_ids_keep_one_copy_of_each_text(spark):
    random.seed(12)
    x, y, z = (" ".join(f"w{random.randrange(5000)}" for _ in range(60)) for _ in range(3))
    rows = [(3, x), (5, x), (5, y), (7, y + " more"), (None, z), (None, z), (8, z), (9, None), (None, y)]
    kept = near_duplicates.one_of_each(spark, frame(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(3, x), (0, z), (9, ""), (0, y)])


def test_tables_that_are_too_large_to_be_sent_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(common, "SENT_ROWS", 0)
    test_near_duplicates_of_planted_copies(spark)
    test_clashing_and_missing_ids_keep_one_copy_of_each_text(spark)


def test_parity_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(5)
    for n, m, shared in ((0, 0, 0), (0, 3, 0), (40, 44, 38), (120, 900, 100), (130, 126, 126), (9000, 8800, 8000), (70_000, 70_100, 69_000)):
        values = np.unique(rng.integers(0, 2**63, n + m, dtype=np.int64).view(np.uint64))
        x, y = values[:n], values[n - shared : n - shared + m]
        a, b = near_duplicates.parity_sketch(x), near_duplicates.parity_sketch(y)
        apart = len(np.setxor1d(x, y))
        assert near_duplicates.differing(a, b) == near_duplicates.differing(b, a) <= apart
        assert near_duplicates.differing(a, a) == 0


def test_no_pair_of_documents_is_missed(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    lowered = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    rows = [(r.doc_id, " ".join(re.findall(r"[^\x20\x09-\x0D]+", lowered(r.text)))) for r in docs.collect()]
    expected = groups([k for k, _ in rows], similar_pairs(rows))
    kept = {r.doc_id for r in near_duplicates.one_of_each(spark, docs, None).collect()}
    assert len(set(expected.values())) < len(rows) and kept == set(expected.values())


def flipped(rng, fingerprint, flips):
    """The fingerprint's bytes with so many bits of each segment flipped."""
    bits = np.unpackbits(np.frombuffer(fingerprint, np.uint8))
    for t, n in enumerate(flips):
        bits[t * near_duplicates.SEGMENT + rng.choice(near_duplicates.SEGMENT, n, replace=False)] ^= 1
    return np.packbits(bits).tobytes()


def test_fingerprints_within_31_bits_meet_in_a_ball_although_no_segment_is_equal(spark):
    rng = np.random.default_rng(13)
    rows, expected = [], set()
    for i in range(300):
        flips = np.full(near_duplicates.TABLES, 2)
        flips[i % near_duplicates.TABLES] = 1  # one table only has them in a ball, none has them in one segment
        x = rng.bytes(near_duplicates.BITS // 8)
        rows += [(2 * i, x), (2 * i + 1, flipped(rng, x, flips))]
        expected.add((2 * i, 2 * i + 1))
    nodes = spark.createDataFrame([(x, bytes(64), 100, k) for k, x in rows], "fingerprint binary, sketch binary, n int, node long").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = {(r.a, r.b) for r in near_duplicates.proposed(nodes).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == expected


def sorted_entries(fingerprints):
    batch = pa.RecordBatch.from_arrays([pa.array(fingerprints, pa.binary()), pa.array(range(len(fingerprints)), pa.int64())], names=["fingerprint", "node"])
    table = pa.Table.from_batches(near_duplicates._entries(iter([batch])))
    return table.sort_by([(c, "ascending") for c in ("number", *near_duplicates._PARTS, "node")]).combine_chunks()


def in_balls(table, rows, crowd=near_duplicates.NEIGHBOURS + 1):
    return {(a, b) for out in near_duplicates._balls(crowd)(iter(table.to_batches(rows))) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}


@pytest.mark.parametrize("rows", [1, 7, 400, 10**6])
def test_balls_by_brute_force_wherever_batches_end(rows):
    rng = np.random.default_rng(14)
    bases = [rng.bytes(near_duplicates.BITS // 8) for _ in range(8)]
    fingerprints = [flipped(rng, bases[i % 8], rng.integers(0, 4, near_duplicates.TABLES)) for i in range(40)]
    bits = np.array([np.unpackbits(np.frombuffer(x, np.uint8)) for x in fingerprints])
    segments = bits[:, : near_duplicates.TABLES * near_duplicates.SEGMENT].reshape(len(bits), near_duplicates.TABLES, -1)
    carried = np.concatenate([bits, bits[:, : near_duplicates.CARRIED]], axis=1)
    expected = set()
    for a in range(len(bits)):
        for b in range(a + 1, len(bits)):
            for t in range(near_duplicates.TABLES):
                own = carried[[a, b], t * near_duplicates.SEGMENT :][:, : near_duplicates.CARRIED]
                if (segments[a, t] != segments[b, t]).sum() <= 1 and (own[0] != own[1]).sum() <= near_duplicates.LIKELY:
                    expected.add((a, b))
    assert len(expected) > 50 and in_balls(sorted_entries(fingerprints), rows, 40) == expected


def test_crowded_segments_give_bounded_pairs():
    rng = np.random.default_rng(15)
    base = rng.bytes(near_duplicates.BITS // 8)
    beside = flipped(rng, base, [1] * near_duplicates.TABLES)
    tail = lambda x: x[:42] + rng.bytes(6)  # noqa: E731 - the bits behind the last segment
    found = in_balls(sorted_entries([tail(base) for _ in range(1000)] + [tail(beside) for _ in range(1000)] + [tail(flipped(rng, base, [0] + [2] * 15))]), 10_000)
    assert len(found) <= 2001 * near_duplicates.TABLES * near_duplicates.NEIGHBOURS + 1000
    linked = groups(range(2001), found)
    assert set(linked.values()) == {0}  # crowds hang together, and so do two in each other's ball


def test_pairs_that_near_copies_give_grow_no_faster_than_their_group(spark, monkeypatch):
    random.seed(16)
    word = lambda: f"w{random.randrange(90_000)}"
    base = [word() for _ in range(200)]
    rows = []
    for k in range(600):
        words = list(base)
        for _ in range(random.randint(1, 3)):
            words[random.randrange(len(words))] = word()
        rows.append((k, " ".join(words)))
    given, plausible = [], near_duplicates.plausible

    def counted(pairs, *args):
        pairs = common.checkpointed(pairs)
        given.append(pairs.count())
        return plausible(pairs, *args)

    monkeypatch.setattr(near_duplicates, "plausible", counted)
    for n in (300, 600):
        given.clear()
        found = {r.key: r.component for r in near_duplicates.near_duplicate_components(frame(spark, rows[:n])).collect()}
        assert found == groups(range(n), similar_pairs(rows[:n]))
        assert sum(given) <= near_duplicates.TABLES * n, given


def test_balls_leave_out_pairs_of_one_component_only(spark):
    rng = np.random.default_rng(17)
    bases = [rng.bytes(near_duplicates.BITS // 8) for _ in range(6)]
    rows = [(k, flipped(rng, bases[k % 6], rng.integers(0, 3, near_duplicates.TABLES))) for k in range(60)]
    nodes = spark.createDataFrame([(x, bytes(64), 100, k) for k, x in rows], "fingerprint binary, sketch binary, n int, node long").coalesce(1)
    component = {k: k % 6 + 6 * (k % 4 // 2) for k, _ in rows}
    grouped = spark.createDataFrame([(k, c) for k, c in component.items() if k != c], "node long, component long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        every, some = ({(r.a, r.b) for r in near_duplicates.proposed(nodes, grouped=g).collect()} for g in (None, grouped))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    apart = {(a, b) for a, b in every if component[a] != component[b]}
    assert some == apart and len(every) > len(apart) > 20
