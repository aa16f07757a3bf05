"""Toxicity by a chain of classifiers.

Categories are predicted one after the other by linear models; each model also sees the probabilities of the categories before it. For training
those come from models that haven't seen the row (out of fold), so that a later model doesn't trust them more than they deserve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.byte_bpe import LETTER, _classes
from tagloom.llm.common import U64, RangeHash, chunks, documents, in_arrow, mix, text_bytes

#: In the order of the chain: name and SQL over labels. Junk is seldom toxic by its wording alone, so it comes first.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_and_sound": "toxic = 1 and quality = 1"}
REJECTED_BY, THRESHOLD = "toxic", 0.5

DIMENSIONS = 1 << 18
#: Hashed features: the word itself and its first four, five and six letters (compounds begin alike).
PREFIXES = (4, 5, 6)
#: The chain is fitted to so many labelled rows at most, about (by the hash of the id), with so many features for each category.
TRAINING_ROWS, FEATURES = 12_000, 512
FOLDS, ROUNDS, RIDGE = 3, 200, 1e-3
PIECE_BYTES = 1 << 19


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and prefix in lower-cased UTF-8 texts that begin at offsets, repeats included."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    place = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    letter = _classes()[points] == LETTER if len(points) else np.zeros(0, bool)
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    cut = place[(place > 0) & (place < len(points))]
    first[cut], last[cut - 1] = letter[cut], letter[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(place, start, "right") - 1
    hashed = RangeHash(mix(points.astype(U64) + U64(11)))
    texts, found = [text], [hashed.of(start, end)]
    for n in PREFIXES:
        long = end - start >= n
        texts.append(text[long])
        found.append(mix(hashed.of(start[long], start[long] + n) + U64(n)))
    return np.concatenate(texts), (np.concatenate(found) % U64(DIMENSIONS)).astype(np.int64)


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count), each pair once, sorted."""
    text, feature = features_of(data, offsets)
    pair, count = np.unique(text * DIMENSIONS + feature, return_counts=True)
    text, feature = np.divmod(pair, DIMENSIONS)
    return text, feature, count


@dataclass
class Linear:
    """Logistic regression on log(1 + count) of chosen features, and on the probabilities before it in the chain."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def columns(self, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which features are the model's, and their places."""
        place = np.searchsorted(self.features, feature)
        hit = place < len(self.features)
        hit[hit] = self.features[place[hit]] == feature[hit]
        return hit, place[hit]

    def scores(self, rows: int, text: np.ndarray, feature: np.ndarray, count: np.ndarray, before: np.ndarray) -> np.ndarray:
        hit, column = self.columns(feature)
        total = np.bincount(text[hit], self.weights[column] * np.log1p(count[hit]), rows)
        return 1 / (1 + np.exp(-np.clip(total + before @ self.earlier + self.bias, -40, 40)))


def telling(rows: int, positive: int, yes: np.ndarray, every: np.ndarray) -> np.ndarray:
    """The features whose shares among positive and other rows differ most, in standard errors; yes, every: rows by feature."""
    negative = rows - positive
    if not positive or not negative:
        return np.zeros(0, np.int64)
    share = every / rows
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / positive + 1 / negative))
    z = np.where(every >= 3, np.abs(yes / positive - (every - yes) / negative) / error, 0)
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    return chosen[z[chosen] > 3]


def fit(features: np.ndarray, rows: int, text: np.ndarray, feature: np.ndarray, count: np.ndarray, before: np.ndarray, label: np.ndarray) -> Linear:
    """Adam on the mean log loss with a small ridge; nothing in it is random."""
    model = Linear(features, np.zeros(len(features)), np.zeros(before.shape[1]), 0.0)
    hit, column = model.columns(feature)
    owner, value = text[hit], np.log1p(count[hit])
    k, most = len(features), max(1, rows)
    w = np.zeros(k + before.shape[1])
    shift = np.log((label.sum() + 0.5) / (rows - label.sum() + 0.5))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, ROUNDS + 1):
        total = np.bincount(owner, w[:k][column] * value, rows) + before @ w[k:] + shift
        off = (1 / (1 + np.exp(-np.clip(total, -40, 40))) - label) / most
        slope = np.concatenate([np.bincount(column, off[owner] * value, k), before.T @ off]) + RIDGE / most * w
        slope = np.append(slope, off.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, shift = w - move[:-1], shift - move[-1]
    return Linear(features, w[:k], w[k:], float(shift))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear] = field(default_factory=list)
    fitted: bool = True  # False: nothing is known, so nothing is rejected

    def probabilities(self, rows: int, text: np.ndarray, feature: np.ndarray, count: np.ndarray) -> np.ndarray:
        """rows x categories."""
        out = np.zeros((rows, 0))
        for model in self.models:
            out = np.column_stack([out, model.scores(rows, text, feature, count, out)])
        return out


def fit_chain(names: list[str], chosen: list[list[np.ndarray]], fold: np.ndarray, text: np.ndarray, feature: np.ndarray, count: np.ndarray, labels: np.ndarray) -> Chain:
    """labels: rows x categories. chosen: for each category the features for each left-out fold, and for all rows.

    Each category's model is fitted to all rows, on the out-of-fold probabilities of the earlier categories.
    """
    rows = len(labels)
    before, chain = np.zeros((rows, 0)), Chain(names)
    for k in range(len(names)):
        chain.models.append(fit(chosen[k][FOLDS], rows, text, feature, count, before, labels[:, k]))
        unseen = np.zeros(rows)
        for f in range(FOLDS):
            out = fold == f
            into, where = ~out[text], np.cumsum(~out) - 1
            model = fit(chosen[k][f], int((~out).sum()), where[text[into]], feature[into], count[into], before[~out], labels[~out, k])
            mine, where = out[text], np.cumsum(out) - 1
            unseen[out] = model.scores(int(out.sum()), where[text[mine]], feature[mine], count[mine], before[out])
        before = np.column_stack([before, unseen])
    return chain


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch with the bags of their lower-cased texts; a null text is empty."""
    for i, j in chunks(text_bytes(batch.column("text"))[1], PIECE_BYTES):
        part = batch.slice(i, j - i)
        data, offsets = text_bytes(pc.utf8_lower(part.column("text")))
        yield part, *bags(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows have a feature, by fold and set of labels (as bits)."""
    for batch in batches:
        for part, text, feature, _ in _pieces(batch):
            group = part.column("fold").to_numpy() * 256 + part.column("label_bits").to_numpy()
            pair, n = np.unique(group[text] * DIMENSIONS + feature, return_counts=True)
            group, feature = np.divmod(pair, DIMENSIONS)
            yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(n)], names=["set", "feature", "n"])


def _bags_of(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = Linear(features, features, features[:0], 0.0)
        for batch in batches:
            for part, text, feature, count in _pieces(batch):
                hit, column = chosen.columns(feature)
                text, count = text[hit], count[hit]
                cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
                out = [np.stack([column[a:b], count[a:b]]).astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("fold"), part.column("label_bits"), pa.array(out, pa.binary())], names=["fold", "label_bits", "bag"])

    return run


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, categories: dict[str, str] = CATEGORIES) -> Chain:
    """The chain for docs (doc_id, text) and labels (doc_id, and what the SQL of up to eight categories names). Rows without id are left out; a null label counts as no.

    It is fitted on the driver to the chosen features of about `limit` rows at most: of labels and of what they bring, rows are sampled by hash if they are more. A row that is repeated, with its id and text, counts
    once; a null text is empty. Texts of any length are read whole. Other columns of both are ignored. Without labelled rows every probability is 0.5 and nothing is rejected.
    """
    k = len(categories)
    bits = sum((F.max(F.coalesce(F.expr(sql).cast("int"), F.lit(0))) * (1 << i) for i, sql in enumerate(categories.values())), F.lit(0))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(bits.cast("int").alias("label_bits"))
    total = marks.count()
    if total > limit:
        marks = marks.where(F.pmod(F.xxhash64("label_id", F.lit("sample")), F.lit(1_000_003)) < F.lit(int(1_000_003 * limit / total)))
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").withColumn("mark", F.xxhash64("text"))
    joined = texts.join(F.broadcast(marks), "label_id")  # `limit` short rows
    given = joined.select("label_id", "mark").distinct().count()
    if given > limit:  # ids that are repeated bring several texts
        joined = joined.where(F.pmod(F.xxhash64("label_id", "mark", F.lit("rows")), F.lit(1_000_003)) < F.lit(int(1_000_003 * limit / given)))
    rows = joined.groupBy("label_id", "mark", "label_bits").agg(F.min("text").alias("text")).select(F.pmod(F.xxhash64("label_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), "label_bits", "text")
    sizes = {(r.fold, r.label_bits): r.n for r in rows.groupBy("fold", "label_bits").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Chain(list(categories), [Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(i), 0.0) for i in range(k)], fitted=False)
    shares = in_arrow(rows, _shares, "set int, feature int, n long").groupBy("set", "feature").agg(F.sum("n").alias("n")).toArrow()
    group, feature, n = (shares.column(c).to_numpy() for c in ("set", "feature", "n"))
    chosen = []
    for i in range(k):
        own = []
        for out in range(FOLDS + 1):
            used, positive = group // 256 != out, (group % 256) >> i & 1 == 1
            counted = {x: c for x, c in sizes.items() if x[0] != out}
            every = np.bincount(feature[used], n[used], DIMENSIONS)
            yes = np.bincount(feature[used & positive], n[used & positive], DIMENSIONS)
            own.append(telling(sum(counted.values()), sum(c for x, c in counted.items() if x[1] >> i & 1), yes, every))
        chosen.append(own)
    every = np.unique(np.concatenate([x for own in chosen for x in own]))
    found = in_arrow(rows, _bags_of(every), "fold int, label_bits int, bag binary").orderBy("bag", "fold", "label_bits").toArrow()  # in an order that doesn't depend on how the rows lay
    raw = [np.frombuffer(x, "<i4").reshape(2, -1) for x in found.column("bag").to_pylist()]
    text = np.repeat(np.arange(len(raw)), [x.shape[1] for x in raw])
    column, count = np.concatenate(raw, axis=1).astype(np.int64)
    label_bits = found.column("label_bits").to_numpy()
    labels_of = (label_bits[:, None] >> np.arange(k) & 1).astype(np.float64)
    return fit_chain(list(categories), chosen, found.column("fold").to_numpy(), text, every[column], count, labels_of)


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and the probability of each category (double, named after it) for each row of docs; a null text is empty.

    Repeated rows and ids each have their row, a null doc_id stays null; texts of any length are read whole. Other columns are ignored; an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)  # categories x FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = held.value
        for batch in batches:
            for part, text, feature, count in _pieces(batch):
                p = chain.probabilities(part.num_rows, text, feature, count)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c) for c in p.T]], names=["doc_id", *chain.names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(rows, run, "doc_id long, " + ", ".join(f"{n} double" for n in chain.names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_<category> and rejected for every document; see train and predict for odd rows."""
    docs = documents(spark, sf_dir)
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    p = predict(docs, chain)
    return p.select("doc_id", *[F.col(n).alias(f"p_{n}") for n in CATEGORIES], (F.lit(chain.fitted) & (F.col(REJECTED_BY) >= THRESHOLD)).alias("rejected"))


def sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs that the chain doesn't reject, with all their columns; a null or empty text is only rejected if the chain rejects one without words. An empty table stays empty."""
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not chain.fitted:
        return docs
    held = spark.sparkContext.broadcast(chain)
    column = list(chain.names).index(REJECTED_BY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = held.value
        for batch in batches:
            for part, *found in _pieces(batch):
                yield part.filter(pa.array(chain.probabilities(part.num_rows, *found)[:, column] < THRESHOLD))

    return in_arrow(docs, run, docs.schema)
