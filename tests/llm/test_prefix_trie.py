import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tagloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv long, depth long, base long, chars long, one string, part int, idx string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "o", 5, "i") for r in rows], SCHEMA)


def print_of(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", print_of(role or "", text or ""), text or ""))
    said = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(said.get(base, [])[:h] + said[c][h:])
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
            if d:
                children[rebuilt[c][: d - 1]].add(rebuilt[c][:d])
    saved, leaves = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        saved[node] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        leaves[node] += not children[node]
        if node:
            saved[node[:-1]] += saved[node]
            leaves[node[:-1]] += leaves[node]
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in own if len(rebuilt[c]) == len(node))
        out.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(messages):
    return sorted(map(tuple, prefix_trie.trie(messages).collect()), key=repr)


def some(seed, convs, most=9, words="ab"):
    random.seed(seed)
    return [(c, t if random.random() < 0.9 else None, random.choice(["user", "assistant", None]), random.choice([*words, None, ""])) for c in convs for t in range(random.randint(1, most))]


@pytest.mark.parametrize("block", [4096, 6])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    ids = [*range(0, 12), *range(100, 109), *range(205, 212), -3, -100, -101, -250, 10**12, 10**12 + 1]
    rows = some(block, ids, 9 if block > 6 else 20) + [(0, 3, "user", "a")] * 2 + [(None, 1, "user", "nobody's")]
    # turnless: no base, and no turns of its own are left
    lone = next(c for c in range(5001, 5099) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows += [(lone, 0, "user", "gone")]
    got = found(frame(spark, rows))
    assert got == brute(rows)
    assert (lone, hashlib.sha256(str(lone).encode()).hexdigest()) not in {(r[0], r[7]) for r in got} and got


def test_one_conversation_holds_most_and_many_are_equal(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [(200, t, "user", f"turn {t % 7}") for t in range(300)] + [(201, t, "user", f"turn {t % 7}") for t in range(250)]
    rows += [(c, t, "user", "the same") for c in range(1000, 1400) for t in range(3)]
    assert found(frame(spark, rows)) == brute(rows)


def test_long_texts_ties_and_nothing(spark):
    rows = [(1, 0, "user", "x" * 100_000), (1, 0, "user", "x" * 100_000), (2, 0, "", "é😀"), (2, 0, None, None), (100, 0, "1", "2:x"), (101, 0, "12", ":x")]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(None, 0, "user", "x")])) == []


def test_sql_gives_the_same(spark):
    messages = frame(spark, some(5, [*range(0, 9), *range(301, 310), -5]))
    db = duckdb.connect()
    db.register("conversations", messages.select("conv_id", "turn", "role", "text").toArrow())
    names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert found(messages) == sorted(db.sql(f"SELECT {names} FROM ({prefix_trie.ORACLE})").fetchall(), key=repr)
