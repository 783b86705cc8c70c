"""Toxicity by non-negative positive-unlabelled learning: a numpy classifier from confirmed toxic texts and unlabelled ones.

A text's features are the hashes of its distinct words and of their beginnings of 3 to 6 bytes. Those that set the
confirmed texts apart from the unlabelled ones are kept, and a logistic model over them is trained on the risk
prior * R+(P) + max(0, R-(U) - prior * R-(P)): unlabelled texts stand for the negatives after what the toxic ones among
them (the class prior) add is taken out, and where that falls below zero the step goes the other way, so the model
can't fit unlabelled texts as negatives. The prior is the toxic share of the labelled rows that may be learned from.

The sample is bounded: at most SAMPLE_TOXIC confirmed and SAMPLE_OTHER unlabelled texts, spread by a hash of the
doc_id; the driver gets their features' hashes. Every text is scored as a whole, in one pass without a shuffle.

Defined results: a text without words (null, empty) has the score of the model's constant; without confirmed texts to
learn from every score is 0. Repeated labels of a document count as toxic if one of them is; a null label is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.llm.common import drop, renamed, stored
from metaquarry.llm.words import mixed, raw_texts, steps, word_spans

BITS = 22
SAMPLE_TOXIC, SAMPLE_OTHER = 3000, 6000
KEPT = 3000
#: A kept feature is at least so many deviations above chance, and by the prior at least so toxic.
SURPRISE, TELLING = 5.0, 0.8
BEGINNINGS = (3, 4, 5, 6)
ROUNDS, RATE, DECAY = 300, 0.3, 1e-4
TOXIC_FROM = 0.3

_APART = np.ones(256, dtype=bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def features(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of their beginnings (BITS bits), a row for each word; and how many words come up to each text's end."""
    spans = word_spans(raw, ends, _APART)
    columns = [spans.hashes()] + [spans.hashes(k) for k in BEGINNINGS]
    tags = np.arange(len(columns), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return np.stack([(mixed(c ^ t) >> np.uint64(64 - BITS)).astype(np.int64) for c, t in zip(columns, tags)], axis=1), spans.upto


@dataclass
class Model:
    places: np.ndarray  # of the kept features, ascending
    weights: np.ndarray
    constant: float


def _text_counts(texts: list[np.ndarray]) -> np.ndarray:
    """In how many texts each feature is."""
    out = np.zeros(1 << BITS, np.int32)
    for x in texts:
        out[x] += 1
    return out


def train(toxic: list[np.ndarray], other: list[np.ndarray], prior: float) -> Model:
    """toxic, other: distinct features of each confirmed and each unlabelled text."""
    if not toxic or not other:
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    p, u = _text_counts(toxic), _text_counts(other)
    some = np.flatnonzero(p >= 3)  # of a sample's many features few are that common among the confirmed
    a, b = (p[some] + 0.5) / (len(toxic) + 1), (u[some] + 0.5) / (len(other) + 1)
    apart = (a - b) / np.sqrt(a * (1 - a) / len(toxic) + b * (1 - b) / len(other))
    surprise = (p[some] - len(toxic) * b) / np.sqrt(len(toxic) * b)  # against as many as chance gives
    telling = (surprise > SURPRISE) & (prior * a >= TELLING * b) & (apart > 0)  # of the texts with it, about so many are toxic
    places = np.sort(some[telling][np.argsort(-apart[telling], kind="stable")[:KEPT]])
    if not len(places):
        return Model(places, np.zeros(0), float(np.log(prior / (1 - prior))))
    slot = np.full(1 << BITS, -1, np.int32)
    slot[places] = np.arange(len(places))

    def matrix(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own = [x[x >= 0] for x in (slot[t] for t in texts)]
        return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)

    (pr, pc), (ur, uc) = matrix(toxic), matrix(other)
    w, c = np.zeros(len(places)), float(np.log(prior / (1 - prior)))
    moved_w, moved_c = np.full(len(places), 1e-8), 1e-8
    for _ in range(ROUNDS):
        fp = c + np.bincount(pr, w[pc], minlength=len(toxic))
        fu = c + np.bincount(ur, w[uc], minlength=len(other))
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp, gu = prior * (sp - 1) / len(toxic), np.zeros(len(other))
        if negative >= 0:
            gp, gu = gp - prior * sp / len(toxic), su / len(other)
        else:  # only the negative part, upwards
            gp, gu = prior * sp / len(toxic), -su / len(other)
        g = np.bincount(pc, gp[pr], minlength=len(places)) + np.bincount(uc, gu[ur], minlength=len(places)) + DECAY * w
        gc = gp.sum() + gu.sum()
        moved_w += g * g
        moved_c += gc * gc
        w -= RATE * g / np.sqrt(moved_w)
        c -= RATE * gc / np.sqrt(moved_c)
    return Model(places, w, c)


def _distinct(docs: DataFrame) -> DataFrame:
    """kind, and the distinct features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = raw_texts(batch.column(1))
            out: list[bytes] = []
            for _, _, some, own in steps(raw, ends):
                hashes, upto = features(some, own)
                first = 0
                for last in upto.tolist():
                    out.append(np.unique(hashes[first:last]).astype("<u4").tobytes())
                    first = last
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["kind", "features"])

    return docs.select("kind", "text").mapInArrow(run, "kind int, features binary")


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Model:
    """may_learn: which documents may be learned from, over doc_id."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where(may_learn)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(may_learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    r = known.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") > 0).alias("toxic")).first()
    n = docs.count()
    if not r["toxic"] or not n:
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    prior = min(0.9, r["toxic"] / r["n"])
    some = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    positive = known.where((F.col("toxic") > 0) & (some < 1_000_000 * min(1.0, SAMPLE_TOXIC / r["toxic"]))).select(F.col("doc_id").alias("of"))
    other = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < 1_000_000 * min(1.0, SAMPLE_OTHER / n)
    rows = docs.join(F.broadcast(positive), F.col("doc_id") == F.col("of"), "left")  # the sample's ids, about SAMPLE_TOXIC
    kinds = F.filter(F.array(F.when(F.col("of").isNotNull(), 1), F.when(other, 0)), lambda x: x.isNotNull())
    rows = rows.where(F.col("of").isNotNull() | other).select("text", F.explode(kinds).alias("kind"))
    parts: dict[int, list[np.ndarray]] = {0: [], 1: []}
    sampled, at = stored(_distinct(rows).repartition(16), "features")  # made in parallel, read a part at a time
    for x in sampled.toLocalIterator():
        parts[x["kind"]].append(np.frombuffer(bytes(x["features"]), "<u4"))
    drop(docs.sparkSession, at)
    return train(parts[1], parts[0], prior)


def scored(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with the score of each whole text."""
    into = renamed(docs.columns, into)
    shared = docs.sparkSession.sparkContext.broadcast((model.places, model.weights, model.constant))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights, constant = shared.value
        slot = np.full(1 << BITS, -1, np.int32)
        slot[places] = np.arange(len(places))
        for batch in batches:
            raw, ends = raw_texts(batch.column(where))
            total = np.full(batch.num_rows, constant)
            for at, end, some, own in steps(raw, ends) if len(places) else ():
                hashes, upto = features(some, own)
                found = slot[hashes]
                word, column = np.nonzero(found >= 0)
                text = np.searchsorted(upto, word, side="right")
                pairs = np.unique(text * len(places) + found[word, column])
                total[at:end] += np.bincount(pairs // len(places), weights[pairs % len(places)], minlength=end - at)
            score = 1 / (1 + np.exp(-np.clip(total, -700, 700))) if np.isfinite(constant) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(into)).schema)
