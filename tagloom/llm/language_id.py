"""Language identification of mixed texts: candidates by script, scores by word, spans by Viterbi.

The model is a table of log probabilities of hashed character 3-grams and whole words for each language, and the share of each
language's letters in each script. A word is scored under the languages whose texts use its script; then the best sequence of languages over
the words is found, where each switch costs `SWITCH`. A text's language is the one with the most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.byte_bpe import LETTER, _classes
from tagloom.llm.common import U64, RangeHash, chunks, documents, in_arrow, mix, text_bytes

# Where ranges of code points of one script begin (0: none or other; 1: Latin).
SCRIPT_STARTS = np.array([
    0x0, 0x41, 0x2B0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xA80, 0xB00, 0xB80, 0xC00, 0xC80, 0xD00, 0xD80, 0xE00, 0xE80, 0x1000, 0x10A0,
    0x1100, 0x1200, 0x1780, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB50, 0xFE00, 0x20000, 0x32000,
])
SCRIPT_NUMBERS = np.array([
    0, 1, 0, 2, 3, 4, 5, 6, 0, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20,
    21, 22, 23, 1, 2, 0, 24, 24, 0, 25, 0, 21, 0, 25, 6, 0, 25, 0,
])
SCRIPTS = 26

TABLE = 1 << 16
GRAM = 3
SWITCH = 12.0
SMOOTHING = 0.5
#: A language is a candidate for a script that holds at least this share of its letters.
LEAST_SHARE = 0.01
#: The model is learned from so many labelled documents, about; all of them if there are fewer.
TRAINING_DOCUMENTS = 20_000
#: Languages at most; each takes 256 KiB of the model.
LANGUAGES = 400
PIECE_BYTES = 3 << 20
UNKNOWN = "und"


@dataclass
class Words:
    """The words of some texts that hold letters: text, start, end (in code points of all texts), letters and script; bags of features with the word that each feature belongs to."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    features: np.ndarray
    owner: np.ndarray
    kind: np.ndarray  # number of the distinct word of each word; features are those of distinct words


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """data: UTF-8 bytes of lower-cased texts that begin at offsets."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    place = np.append(0, np.cumsum(lead))[offsets]
    letter = _classes()[points] == LETTER if len(points) else np.zeros(0, bool)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    cut = place[(place > 0) & (place < len(points))]
    first[cut] = letter[cut]
    last[cut - 1] = letter[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(place, start, "right") - 1
    script = SCRIPT_NUMBERS[np.searchsorted(SCRIPT_STARTS, points[start], "right") - 1] if len(start) else np.zeros(0, np.int64)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(text, start, end, none, script, none, none, none)
    whole = RangeHash(mix(points.astype(U64) + U64(7))).of(start, end) + (end - start).astype(U64)
    _, sample, kind = np.unique(whole, return_index=True, return_inverse=True)
    # distinct words laid out one after the other with an edge mark on both sides
    lengths = (end - start)[sample]
    begin = np.cumsum(lengths + 2) - (lengths + 2)
    laid = np.full(int((lengths + 2).sum()), 1, U64)
    inside = np.repeat(begin + 1, lengths) + (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    laid[inside] = points[np.repeat(start[sample], lengths) + inside - np.repeat(begin + 1, lengths)].astype(U64) + U64(7)
    grams = RangeHash(mix(laid)).each(GRAM)
    owner = np.repeat(np.arange(len(sample)), lengths + 2)[: len(grams)]
    fits = np.arange(len(grams)) + GRAM <= (begin + lengths + 2)[owner]
    features = np.concatenate([(grams[fits] >> U64(48)).astype(np.int64), (mix(whole[sample]) >> U64(48)).astype(np.int64)])
    return Words(text, start, end, end - start, script, features, np.concatenate([owner[fits], np.arange(len(sample))]), kind)


def _pieces(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(batch.column("text"))
    for i, j in chunks(offsets, size):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of features by language; numbers from TABLE on are scripts."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for i, j, data, offsets in _pieces(batch, PIECE_BYTES):
            w = words_of(data, offsets)
            names, lang = np.unique(langs[i:j].astype(str), return_inverse=True)
            for k, name in enumerate(names):
                own = lang[w.text] == k
                often = np.bincount(w.kind[own], minlength=int(w.kind.max(initial=-1)) + 1)
                counts = np.bincount(w.features, often[w.owner], TABLE)
                scripts = np.bincount(w.script[own], w.letters[own], SCRIPTS)
                found = np.flatnonzero(counts), np.flatnonzero(scripts)
                number = np.concatenate([found[0], TABLE + found[1]])
                n = np.concatenate([counts[found[0]], scripts[found[1]]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(n), pa.string()), pa.array(number.astype(np.int32)), pa.array(n)], names=["lang", "number", "n"])


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # TABLE x languages, log probabilities
    candidates: np.ndarray  # SCRIPTS x languages


def train(docs: DataFrame, limit: int = TRAINING_DOCUMENTS, most: int = LANGUAGES) -> Model:
    """From docs (text, lang) with both not null; about `limit` distinct (text, lang) by the hash of their text, or all: a repeated text counts once.

    More than `most` languages are an error, so the counts that reach the driver, and the model that every task gets, are bounded by that times the table's size.
    """
    labelled = docs.where("text is not null and lang is not null").select(F.lower("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    total = labelled.select(F.xxhash64("text").alias("mark"), "lang").distinct().count()
    if total > limit:
        labelled = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.lit(int(1_000_003 * limit / total)))
    if labelled.select("lang").distinct().limit(most + 1).count() > most:
        raise ValueError(f"there are more than {most} languages; is this a column of languages?")
    counts = in_arrow(labelled.distinct(), _counted, "lang string, number int, n long").groupBy("lang", "number").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    index = {x: i for i, x in enumerate(langs)}
    table = np.zeros((TABLE + SCRIPTS, len(langs)))
    table[counts.column("number").to_numpy(), [index[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    grams, scripts = table[:TABLE] + SMOOTHING, table[TABLE:]
    share = scripts / np.maximum(scripts.sum(0), 1)
    return Model(langs, np.log(grams / grams.sum(0)).astype(np.float32), share >= LEAST_SHARE)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; scores: words x languages of texts one after the other. Texts of similar length go side by side."""
    out = np.zeros(len(scores), np.int16)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    classes = np.ceil(np.log2(np.maximum(lengths[order], 1)) * 2).astype(int)
    for group in np.split(order, np.flatnonzero(np.diff(classes)) + 1):
        group = group[lengths[group] > 0][::-1]
        if not len(group):
            continue
        n = lengths[group]
        alive = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")  # texts with that many words
        best = scores[starts[group]].astype(np.float64)
        stays = np.ones((n[0], len(group), scores.shape[1]), bool)
        tops = np.zeros((n[0], len(group)), np.int16)
        ends = np.zeros(len(group), np.int16)
        for t in range(1, n[0]):
            k = alive[t]
            if k < alive[t - 1]:
                ends[k : alive[t - 1]] = best[k:].argmax(1)
                best = best[:k]
            top = best.argmax(1)
            moved = best[np.arange(k), top] - switch
            stay = best >= moved[:, None]
            stays[t, :k], tops[t, :k] = stay, top
            best = np.where(stay, best, moved[:, None]) + scores[starts[group[:k]] + t]
        ends[: len(best)] = best.argmax(1)
        now = ends.copy()
        for t in range(n[0] - 1, -1, -1):
            k = alive[t]
            out[starts[group[:k]] + t] = now[:k]
            if t:
                now[:k] = np.where(stays[t, np.arange(k), now[:k]], now[:k], tops[t, :k])
    return out


def _labelled(model: Model, w: Words, n_texts: int, switch: float) -> np.ndarray:
    """The language number of each word."""
    kinds = int(w.kind.max(initial=-1)) + 1
    by_kind = np.zeros((kinds, len(model.langs)))
    order = np.argsort(w.owner, kind="stable")
    cuts = np.searchsorted(w.owner[order], np.arange(kinds))
    if kinds:
        by_kind = np.add.reduceat(model.scores[w.features[order]], cuts, axis=0)
    scores = by_kind[w.kind]
    fit = model.candidates[w.script]
    scores = np.where(fit | ~fit.any(1)[:, None], scores - scores.max(1, keepdims=True), -1e4) if len(scores) else scores
    return viterbi(scores, np.bincount(w.text, minlength=n_texts), switch)


def _broadcast(spark: SparkSession, model: Model):
    return spark.sparkContext.broadcast(model)  # LANGUAGES x 64 Ki numbers at most


def label_spans(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, start, end (code points), lang of each stretch of words in one language. Texts that are null or have no letters give no rows."""
    held = _broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for i, j, data, offsets in _pieces(batch, PIECE_BYTES):
                w = words_of(data, offsets)
                if not len(w.text) or not model.langs:
                    continue
                lang = _labelled(model, w, j - i, switch)
                new = np.append(True, (w.text[1:] != w.text[:-1]) | (lang[1:] != lang[:-1]))
                at = np.flatnonzero(new)
                until = np.append(at[1:], len(lang)) - 1
                base = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets[:-1]][w.text[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(batch.column("doc_id"))[i:j][w.text[at]]), pa.array(w.start[at] - base), pa.array(w.end[until] - base), pa.array([model.langs[k] for k in lang[at]])],
                    names=["doc_id", "start", "end", "lang"],
                )

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return in_arrow(rows, run, "doc_id long, start long, end long, lang string")


def predict(docs: DataFrame, model: Model, switch: float = SWITCH, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters that lie in spans of that language) for each row of docs, and the columns in keep.

    A text that is null or has no letters, or any text if the model knows no language: `und` and 0. Equal shares: the first language by name.
    """
    held = _broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for i, j, data, offsets in _pieces(batch, PIECE_BYTES):
                w = words_of(data, offsets)
                many = max(1, len(model.langs))
                letters = np.zeros((j - i, many))
                if len(w.text) and model.langs:
                    lang = _labelled(model, w, j - i, switch)
                    letters = np.bincount(w.text * many + lang, w.letters, (j - i) * many).reshape(-1, many)
                total, top = letters.sum(1), letters.argmax(1)
                names = [model.langs[k] if n else UNKNOWN for k, n in zip(top.tolist(), total.tolist(), strict=True)]
                score = letters[np.arange(j - i), top] / np.maximum(total, 1)
                part = batch.slice(i, j - i)
                columns = [part.column(c) for c in ("doc_id", *keep)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score)], names=["doc_id", *keep, "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    kept = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return in_arrow(rows, run, f"doc_id long, {kept}lang_pred string, score double")


def _remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(_remainder() != 1))
    marked = docs.withColumn("held_out", F.coalesce(_remainder() == 1, F.lit(False)))
    return predict(marked, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")
