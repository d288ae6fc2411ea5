"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of characters of each lower-cased word's
letters, with the word's edges marked, hashed to ``1 << feature_bits``
columns. A feature's value is its relative frequency in the text times its
inverse document frequency. Document frequencies and the classes cover all
learning rows. Weights are fitted by follow-the-regularised-leader (FTRL
proximal) with an L1 and an L2 penalty on a bounded sample, about
``sample_per_class`` rows of each class chosen by a hash of the id; a further
part of that sample, not used for weights, sets the softmax temperature by
minimum log loss.

The model (at most ``1 << feature_bits`` rows times the number of classes, and
only non-zero weights are kept) is broadcast. Because a value is linear in the
word counts, a batch's distinct words are scored once each and summed by text;
whole texts are read, and no text is shuffled to be classified.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows with a null lang or null text teach nothing; without any learning row
every text is ``und``; with one class that class gets score 1; a null doc_id
counts as the text '' when rows are held out; repeated rows are predicted
each; an empty table gives an empty result; other columns pass through
``classify`` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesflow.llm._common import as_text, code_points, indexed, mix64, plain_names, ragged, slices, word_blocks

UNDETERMINED = "und"


@dataclass(frozen=True)
class Options:
    """``sample_per_class`` bounds the rows that weights and temperature are fitted on."""

    feature_bits: int = 16
    orders: tuple[int, ...] = (1, 2, 3)
    sample_per_class: int = 1500
    calibration_share: float = 0.25
    passes: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    scale: float = 20.0  # of the values, so that steps are of ordinary size


@dataclass(frozen=True)
class Model:
    """Classes, weights times idf per feature and class, bias per class, temperature."""

    classes: list[str]
    options: Options = field(default_factory=Options)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0


# ---------------------------------------------------------------------------
# Features
# ---------------------------------------------------------------------------

def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def word_features(words: list[str], options: Options) -> tuple[np.ndarray, np.ndarray]:
    """Feature columns of all words on end, and each word's number of them (0 for a word without a letter)."""
    words = list(map(letters, words))
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, starts = code_points(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # Each word in the code array is followed by one blank, its end mark; its start mark is the blank before.
    codes = np.r_[np.uint32(32), codes].astype(np.uint64)
    pieces, counts = [], []
    for order in options.orders:
        first = starts + (1 if order == 1 else 0)  # single characters leave the marks out
        n = np.where(lengths > 0, np.maximum(lengths + (0 if order == 1 else 3 - order), 0), 0)
        at = ragged(first, n)
        h = np.full(len(at), order, np.uint64)
        for k in range(order):
            h = h * np.uint64(0x100000001B3) + codes[at + k]
        pieces.append((mix64(h) >> np.uint64(64 - options.feature_bits)).astype(np.int64))
        counts.append(n)
    word_of = np.concatenate([np.repeat(np.arange(len(words)), n) for n in counts])
    order = np.argsort(word_of, kind="stable")
    return np.concatenate(pieces)[order], np.sum(counts, axis=0)


# Distinct words whose features are held at once.
WORDS_AT_ONCE = 1 << 15


def _in_parts(words: list[str], options: Options) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First word, feature columns and number of them per word, for parts of ``words``."""
    for start in range(0, len(words), WORDS_AT_ONCE):
        yield start, *word_features(words[start:start + WORDS_AT_ONCE], options)


def _text_words(texts: list[str]) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Blocks of (text index, number of words, words) that together hold all texts."""
    at, sizes, words = [], [], []
    for i, text in enumerate(texts):
        for block in word_blocks(text.lower()):
            if block:
                at.append(i)
                sizes.append(len(block))
                words += block
            if len(words) > 1 << 20:
                yield at, sizes, words
                at, sizes, words = [], [], []
    if words:
        yield at, sizes, words


def text_features(text: str, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature columns of a text and their relative frequencies."""
    total = np.zeros(1 << options.feature_bits)
    for _, _, words in _text_words([text]):
        distinct, at = indexed(words)
        columns, counts = word_features(distinct, options)
        times = np.bincount(at, minlength=len(distinct))
        total += np.bincount(columns, np.repeat(times, counts), minlength=len(total))
    used = np.flatnonzero(total)
    return used, total[used] / max(1.0, total.sum())


# ---------------------------------------------------------------------------
# Learning
# ---------------------------------------------------------------------------

def _frequencies(options: Options):
    """(column, texts that have it); column -1: all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << options.feature_bits, np.int64)
        mark = np.zeros(len(found), bool)
        texts = 0
        for part in slices(batches, "text"):
            texts += part.num_rows
            last = -1
            for at, sizes, words in _text_words(as_text(part.column("text"))):
                distinct, ids = indexed(words)
                parts = [(c.astype(np.int32), n) for _, c, n in _in_parts(distinct, options)]
                columns, counts = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
                starts = np.cumsum(counts) - counts
                ends = np.cumsum(sizes)
                for i, a, e in zip(at, (ends - sizes).tolist(), ends.tolist()):
                    if i != last:
                        used = np.flatnonzero(mark)
                        found[used] += 1
                        mark[used] = False
                        last = i
                    own = np.unique(ids[a:e])
                    mark[columns[ragged(starts[own], counts[own])]] = True
            found[mark] += 1
            mark[:] = False
        used = np.flatnonzero(found)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used].astype(np.int32)),
                                              pa.array(np.r_[texts, found[used]])], ["column", "n"])
    return run


def ftrl(samples: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (class, columns, values) rows, in the order given."""
    size = 1 << options.feature_bits
    z, n = np.zeros((size, n_classes)), np.zeros((size, n_classes))
    bias, bias_n = np.zeros(n_classes), np.zeros(n_classes)

    def weights(z, n):
        shrunk = np.sign(z) * options.l1 - z
        return np.where(np.abs(z) <= options.l1, 0.0,
                        shrunk / ((options.beta + np.sqrt(n)) / options.alpha + options.l2))

    for _ in range(options.passes):
        for label, at, values in samples:
            w = weights(z[at], n[at])
            error = _softmax((values @ w + bias)[None, :])[0]
            error[label] -= 1.0
            grad = values[:, None] * error
            grown = n[at] + grad * grad
            z[at] += grad - (np.sqrt(grown) - np.sqrt(n[at])) / options.alpha * w
            n[at] = grown
            bias_n += error * error
            bias -= options.alpha * error / (options.beta + np.sqrt(bias_n))
    return weights(z, n), bias


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The softmax temperature of least log loss, by golden-section search over its logarithm."""
    def loss(t: float) -> float:
        p = _softmax(logits / math.exp(t))[np.arange(len(labels)), labels]
        return -float(np.log(np.maximum(p, 1e-12)).mean())

    lo, hi, golden = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def _fit(classes: list[str], idf: np.ndarray, options: Options):
    """One task over the bounded sample: non-zero weights (times idf) as rows; class -1: bias; -2: temperature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(h, lang, text) for b in batches for h, lang, text in
                zip(b.column("h").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist())]
        rows.sort()
        samples = []
        for _, lang, text in rows:
            at, share = text_features(text, options)
            if len(at):
                samples.append((classes.index(lang), at, share * idf[at] * options.scale))
        every = max(2, round(1 / options.calibration_share))
        held = samples[::every]
        learn = [s for i, s in enumerate(samples) if i % every] or samples
        w, bias = ftrl(learn, len(classes), options)
        logits = np.array([v @ w[at] + bias for _, at, v in held]).reshape(-1, len(classes))
        heat = temperature(logits, np.array([s[0] for s in held])) if len(held) and len(classes) > 1 else 1.0
        column, label = np.nonzero(w)
        values = w[column, label] * idf[column] * options.scale
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[label, np.full(len(bias), -1), -2].astype(np.int32)),
             pa.array(np.r_[column, np.arange(len(bias)), 0].astype(np.int32)),
             pa.array(np.r_[values, bias, heat])], ["label", "column", "value"])
    return run


def learn(rows: DataFrame, options: Options = Options()) -> Model:
    """A model from rows (doc_id, text, lang); rows with a null text or lang are left out."""
    rows = rows.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    classes = sorted(counts)
    if not classes:
        return Model([], options)
    totals = (rows.select("text").mapInArrow(_frequencies(options), "column int, n long")
              .groupBy("column").agg(F.sum("n").alias("n")).collect())  # a row per feature column at most
    found = np.zeros(1 << options.feature_bits)
    texts = 0
    for r in totals:
        if r["column"] < 0:
            texts = r["n"]
        else:
            found[r["column"]] = r["n"]
    idf = np.log((1 + texts) / (1 + found)) + 1
    h = F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("text"))
    share = F.create_map(*[F.lit(x) for c in classes for x in (c, min(1.0, options.sample_per_class / counts[c]))])
    sample = rows.withColumn("h", h).filter((F.col("h") / F.lit(2.0 ** 64) + F.lit(0.5)) < share[F.col("lang")])
    got = (sample.select("h", "lang", "text").repartition(1)
           .mapInArrow(_fit(classes, idf, options), "label int, column int, value double").toPandas())
    weights = np.zeros((1 << options.feature_bits, len(classes)))
    w = got[got.label >= 0]
    weights[w.column.to_numpy(), w.label.to_numpy()] = w.value
    bias = got[got.label == -1].sort_values("column").value.to_numpy()
    return Model(classes, options, weights, bias, float(got[got.label == -2].value.iloc[0]))


# ---------------------------------------------------------------------------
# Prediction
# ---------------------------------------------------------------------------

def predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Class and calibrated score of each text."""
    labels, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.classes:
        return labels, scores
    k = len(model.classes)
    sums = np.zeros((len(texts), k + 1))
    for at, sizes, words in _text_words(texts):
        distinct, ids = indexed(words)
        each = np.zeros((len(distinct), k + 1))
        for start, columns, counts in _in_parts(distinct, model.options):
            some = np.flatnonzero(counts)
            if len(some):
                each[start + some, :k] = np.add.reduceat(model.weights[columns], (np.cumsum(counts) - counts)[some], axis=0)
            each[start:start + len(counts), k] = counts
        np.add.at(sums, at, np.add.reduceat(each[ids], np.cumsum(sizes) - sizes, axis=0))
    known = np.flatnonzero(sums[:, k])
    p = _softmax((sums[known, :k] / sums[known, k:] + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    for i, b in zip(known.tolist(), best.tolist()):
        labels[i] = model.classes[b]
    scores[known] = np.clip(p[np.arange(len(best)), best], 0.0, 1.0)
    return labels, scores


def classify(docs: DataFrame, model: Model, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``label`` and ``score`` appended (choose names that ``docs`` lacks)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields),
                       f"`{label}` string", f"`{score}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            labels, scores = predict(as_text(part.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels, pa.string()), pa.array(scores)],
                                             [*part.schema.names, label, score])
    return docs.mapInArrow(run, kinds)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def learned_from(docs: DataFrame, options: Options = Options()) -> Model:
    """The model of the rows of ``docs`` that aren't held out."""
    return learn(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))), options)


def language_report(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    rows = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return classify(rows, learned_from(docs, options)).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, options: Options = Options()) -> DataFrame:
    """The rows of ``docs`` with a language: not ``und``, and a score of ``min_score`` or more."""
    plain, names = plain_names(docs)
    named = classify(plain, learned_from(docs, options), "lang_pred", "lang_score")
    return (named.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= min_score))
            .drop("lang_pred", "lang_score").toDF(*names))
