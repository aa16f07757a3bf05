import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from tagloom.llm import merkle_manifest
from tests.llm.common import ODD, frame


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """The top, and the siblings of each node level by level."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, place in enumerate(at):
            run = place // 3 * 3
            paths[i].append((level[run:place], level[place + 1 : run + 3]))
            at[i] = place // 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], h(*map(field, r)), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, own = {}, {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        tops[s], own[s] = climb([x[1] for x in groups[s]])
    root, beyond = climb([tops[s] for s in order])
    out = []
    for s, above in zip(order, beyond, strict=True):
        for (doc_id, leaf, r), path in zip(groups[s], own[s], strict=True):
            steps = path + above
            hit = doc_id is not None and r[4] is not None and merkle_manifest.tampered_with(doc_id)
            held = h(*map(field, (*r[:4], r[4].replace("\n", "")))) if hit else leaf
            for left, right in steps:
                held = h(*left, held, *right)
            out.append((doc_id, leaf, tops[s], root, h(*[x for left, right in steps for x in left + right]), held, held == root))
    return sorted(out, key=repr)


def found(docs):
    return sorted(map(tuple, merkle_manifest.manifest(docs).drop("source").collect()), key=repr)


def values(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]


@pytest.mark.parametrize("counts", [[1], [2], [3], [4], [9, 1], [10, 28, 3, 1, 1]])
def test_shapes_equal_brute_force(spark, counts):
    random.seed(sum(counts))
    rows = [(random.randrange(10**6), random.choice(["a\nb", "\n", "plain", "é\n😀", ""]), "en", f"s{k}") for k, n in enumerate(counts) for _ in range(n)]
    docs = frame(spark, rows)
    got = found(docs)
    assert got == brute(values(docs))
    assert all(r[6] for r in got if r[1] in {x[1] for x in got} and r[5] == r[3])


def test_odd_rows_sources_and_one_hot_source(spark):
    rows = [(i, t, None if i and i % 3 else "de", [None, "", "ü", "z", "￿", "😀"][k % 6]) for k, (i, t) in enumerate(ODD)]
    rows += [(100 + i, f"line\n{i}", "en", "hot") for i in range(400)] + [(7, "same", "en", "hot")] * 3 + [(None, "x\n", "en", "hot")] * 2 + [(8, "one", "en", "hot"), (8, "other", "en", "hot")]
    docs = frame(spark, rows)
    assert found(docs) == brute(values(docs))


def test_tampering_shows(spark):
    ids = [i for i in range(200) if merkle_manifest.tampered_with(i)]
    docs = frame(spark, [(i, "a\nb" if i % 2 else "ab", "en", "s") for i in range(200)])
    got = {r.doc_id: r.verified for r in merkle_manifest.manifest(docs).collect()}
    assert {i for i, ok in got.items() if not ok} == {i for i in ids if i % 2} and 0 < len(ids) < 200


def test_empty_table(spark):
    assert merkle_manifest.manifest(frame(spark, [])).count() == 0


def test_sql_gives_the_same_on_odd_rows(spark):
    docs = frame(spark, [(*r, "en", None if k % 2 else f"s{k % 3}") for k, r in enumerate(ODD)])
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    names = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert found(docs) == sorted(db.sql(f"SELECT {names} FROM ({merkle_manifest.ORACLE})").fetchall(), key=repr)
