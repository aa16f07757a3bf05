import itertools
import random

import numpy as np
import pytest

from tagloom.llm import language_id, toxicity
from tests.llm.common import ODD, frame


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(100):
        lengths = rng.integers(0, 7, 4)
        scores, switch = rng.normal(size=(lengths.sum(), 3)) * 3, float(rng.random() * 4)
        found, at = language_id.viterbi(scores, lengths, switch), 0
        for n in lengths:
            value = lambda path, a=at: sum(scores[a + i, c] for i, c in enumerate(path)) - switch * sum(x != y for x, y in itertools.pairwise(path))
            if n:
                assert abs(value(found[at : at + n]) - max(map(value, itertools.product(range(3), repeat=int(n))))) < 1e-9
            at += n


def sentences(seed, n):
    random.seed(seed)
    parts = {"aa": ["ba", "ko", "mi", "ru"], "bb": ["schn", "urg", "elt", "ich"], "gr": ["λο", "γος", "και", "μα"]}
    words = lambda lang: " ".join("".join(random.choices(parts[lang], k=random.randint(1, 3))) for _ in range(random.randint(5, 40)))
    return [(i, words(lang := random.choice(list(parts))), lang, "s") for i in range(n)], words


def test_languages_of_held_out_and_mixed_texts(spark):
    rows, words = sentences(1, 200)
    model = language_id.train(frame(spark, rows[:120]))
    assert model.langs == ["aa", "bb", "gr"]
    found = {r.doc_id: r for r in language_id.predict(frame(spark, rows[120:]), model).collect()}
    assert sum(found[i].lang_pred == lang for i, _, lang, _ in rows[120:]) >= 78
    one, two, three = words("aa"), words("gr"), words("bb")
    spans = language_id.label_spans(frame(spark, [(1, f"{one}. {two}, {three}"), (2, None)]), model).orderBy("start").collect()
    assert [s.lang for s in spans] == ["aa", "gr", "bb"]
    assert spans[1].start == len(one) + 2 and spans[1].end == len(one) + 2 + len(two)


def test_odd_texts_and_no_training(spark):
    rows, _ = sentences(2, 30)
    for model in (language_id.train(frame(spark, rows)), language_id.train(frame(spark, []))):
        found = language_id.predict(frame(spark, ODD), model).collect()
        assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
        assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (1, 2, 3))
    assert language_id.predict(frame(spark, []), model).count() == 0


def test_training_bound_samples_rows(spark):
    rows, _ = sentences(3, 200)
    small = language_id.train(frame(spark, rows), limit=60)
    assert small.langs and not np.array_equal(small.scores, language_id.train(frame(spark, rows)).scores)


def toxic_rows(seed, n):
    random.seed(seed)
    rows, labels = [], []
    for i in range(n):
        toxic, poor = random.random() < 0.2, random.random() < 0.2
        words = [f"w{random.randrange(300)}" for _ in range(random.randint(20, 60))]
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
        if toxic:
            for _ in range(3):
                words.insert(random.randrange(len(words)), random.choice(["awful", "badword", "nastyness"]))
        if poor:
            words += ["buynow"] * 5
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if poor else 1, int(toxic)))
    return rows, labels


def test_chain_finds_toxic_rows_and_leaves_others(spark):
    rows, labels = toxic_rows(1, 600)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, marks)
    assert [len(m.earlier) for m in chain.models] == [0, 1, 2]
    found = {r.doc_id: r.toxic for r in toxicity.predict(docs, chain).collect()}
    assert all((found[i] >= 0.5) == bool(t) for i, _, t in labels)
    again = toxicity.train(docs.repartition(3), marks.repartition(2))
    assert all(np.array_equal(a.weights, b.weights) for a, b in zip(chain.models, again.models, strict=True))


def test_odd_rows_and_labels(spark, tmp_path):
    rows, labels = toxic_rows(2, 120)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(frame(spark, [*rows, *ODD]), marks)
    found = toxicity.predict(frame(spark, ODD), chain).collect()
    assert len(found) == len(ODD) and all(0 <= r.toxic <= 1 for r in found)
    none = toxicity.train(frame(spark, rows), marks.limit(0))
    assert all(r.toxic == 0.5 for r in toxicity.predict(frame(spark, rows[:5]), none).collect())
    assert toxicity.predict(frame(spark, []), chain).count() == 0
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows)
    kept = toxicity.sound(spark, docs, str(tmp_path))
    assert kept.schema == docs.schema
    toxic = {i for i, _, t in labels if t}
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - toxic


def test_nothing_is_rejected_where_nothing_was_learned(spark, tmp_path):
    rows, labels = toxic_rows(3, 20)
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i + 1000, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.sound(spark, docs, str(tmp_path)).count() == len(rows)
    assert not any(r.rejected for r in toxicity.query(spark, str(tmp_path)).collect())


def test_a_repeated_text_is_learned_once(spark):
    rows, _ = sentences(4, 60)
    often = [(1000 + i, *rows[0][1:]) for i in range(200)]
    one, many = (language_id.train(frame(spark, x)) for x in (rows, rows + often))
    assert one.langs == many.langs and np.array_equal(one.scores, many.scores)
    sampled = [language_id.train(frame(spark, x), limit=20).scores for x in (rows, rows + often)]
    assert np.array_equal(*sampled)


def test_rows_of_a_hot_id_are_bounded(spark, monkeypatch):
    rows, labels = toxic_rows(5, 300)
    hot = [(7, f"{rows[7][1]} more{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}") for i in range(3000)] + [rows[9]] * 2000
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fitted = []
    whole = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda *a: fitted.append(len(a[-1])) or whole(*a))
    toxicity.train(frame(spark, rows + hot), marks, limit=400)
    assert 300 < fitted[0] < 500
    plain = toxicity.train(frame(spark, rows), marks)
    often = toxicity.train(frame(spark, rows + [rows[9]] * 2000), marks)
    assert all(np.array_equal(a.weights, b.weights) for a, b in zip(plain.models, often.models, strict=True))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def plain_fit(x, y):
    """Gradient steps with momentum on whole matrices: features first, then earlier probabilities, then the bias."""
    n, k = x.shape
    w = np.zeros(k + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    x1, ridge = np.column_stack([x, np.ones(n)]), np.append(np.full(k, toxicity.RIDGE / n), 0.0)
    m = v = np.zeros(k + 1)
    for t in range(1, toxicity.ROUNDS + 1):
        slope = x1.T @ ((sigmoid(x1 @ w) - y) / n) + ridge * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def test_chain_equals_a_plain_statement(spark, monkeypatch):
    rows, labels = toxic_rows(6, 200)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    whole = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda *a: seen.append(a) or whole(*a))
    chain = toxicity.train(docs, marks)
    names, chosen, fold, text, feature, count, y = seen[0]
    n = len(y)
    assert n == 200 and y.sum(0).min() > 5
    dense = np.zeros((n, int(feature.max()) + 1))
    np.add.at(dense, (text, feature), count)
    dense = np.log1p(dense)
    before, models = np.zeros((n, 0)), []
    for k in range(len(names)):
        of = lambda f, rows_: np.column_stack([dense[:, chosen[k][f]], before])[rows_]  # noqa: B023, E731
        models.append(plain_fit(of(toxicity.FOLDS, slice(None)), y[:, k]))
        unseen = np.zeros(n)
        for f in range(toxicity.FOLDS):
            w = plain_fit(of(f, fold != f), y[fold != f, k])
            unseen[fold == f] = sigmoid(np.column_stack([of(f, fold == f), np.ones((fold == f).sum())]) @ w)
        before = np.column_stack([before, unseen])
    for model, w in zip(chain.models, models, strict=True):
        assert np.allclose(np.concatenate([model.weights, model.earlier, [model.bias]]), w, atol=1e-6)
    assert any(abs(m.earlier).max(initial=0) > 0.1 for m in chain.models)


def test_too_many_languages_are_an_error(spark):
    rows = [(i, f"word{i} here", f"l{i}") for i in range(12)]
    assert len(language_id.train(frame(spark, rows), most=12).langs) == 12
    with pytest.raises(ValueError, match="languages"):
        language_id.train(frame(spark, rows), most=11)
