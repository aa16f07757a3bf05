import base64
import hashlib
import random
from collections import Counter

import numpy as np
import tiktoken

import corpus_pipeline
from tagloom.llm import byte_bpe, mixing
from tests.llm.test_repeats import by_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(folder, spark):
    """Clean documents, exact and near copies, documents with one passage of 60 words, toxic documents, and odd rows."""
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghij", k=random.randint(3, 9)))
    passage = [word() for _ in range(60)]
    rows, labels, kind = [], [], {}

    def add(name, words):
        kind[len(rows)] = name
        rows.append((len(rows), words if words is None else " ".join(words), "en", f"s{len(rows) % 4}", 0))

    for _ in range(240):
        add("clean", [word() for _ in range(random.randint(100, 200))])
    for i in range(0, 60, 6):
        add("copy", rows[i][1].split())
        edited = rows[i + 1][1].split()
        edited[40] = word()
        add("near", edited)
    for _ in range(12):
        add("passage", [word() for _ in range(80)] + passage + [word() for _ in range(80)])
    for _ in range(60):
        words = [word() for _ in range(120)]
        for at in (10, 50, 90):
            words[at] = random.choice(["zzbad", "yyvile", "xxnasty"])
        add("toxic", words)
    add("odd", None)
    add("odd", [])
    rows = [(i, t, a, b, len(t or "")) for i, t, a, b, _ in rows]
    labels = [(i, 1, int(kind[i] == "toxic")) for i, *_ in rows if i % 3]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, kind


def test_stages_against_plain_statements(spark, tmp_path):
    rows, kind = tables(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = lambda name: sorted(r.doc_id for r in seen[name])
    assert ids("toxicity") == [i for i, *_ in rows if kind[i] != "toxic"]
    odd = [i for i in kind if kind[i] == "odd"]
    assert ids("near_dedup") == [i for i, *_ in rows if kind[i] in ("clean", "passage")] + odd[:1]
    plain = by_words([(r.doc_id, r.text) for r in seen["near_dedup"]], 50)
    before = {r.doc_id: r.text for r in seen["near_dedup"]}
    for r in seen["substring_dedup"]:
        words, removed, kept = plain[r.doc_id]
        assert r.text == (kept if removed else before[r.doc_id]) and r.n_chars == (len(r.text) if r.text is not None else None)
    assert sum(plain[i][1] >= 60 for i in plain) == 11  # all but the first with the passage
    copies = {r.doc_id: r.copies for r in mixing.mixture(spark.read.parquet(f"{tmp_path}/substring_dedup")).collect()}
    assert Counter(ids("mixing")) == Counter({d: n for d, n in copies.items() if n})
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.default_path(), "rb"))}
    import public_tokenizers

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for r in seen["mixing"]:
        tokens = reference.encode_ordinary(r.text)
        expected[r.doc_id, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in seen["byte_bpe"]) == expected
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, seen["byte_bpe"]))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows, _ = tables(tmp_path, spark)
    names = ["kept_key", "kept_mark", "mixed_key", "mixed_copies", "mixed_copy", "changed_key", "changed_mark", "changed_text", "near_duplicates", "mixing", "substring_dedup", "place", "change", "key", "copies"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", *[f"concat('{n} ', doc_id) as {n}" for n in names])
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = out.collect()
        assert len(found) > 200 and all(r[n] == f"{n} {r.doc_id}" for r in found for n in names)
