"""Multilingual mixture inference: each document's language proportions by expectation-maximisation.

A language is a trigram model: how likely each character of a word follows the two before it. A word's likelihood
under a language is the product over its characters. A document is a mixture of languages with unknown proportions,
which EM finds from its words' likelihoods; the set of languages is the one with the greatest likelihood less half
the logarithm of the number of words for each language. Where no second language would raise the likelihood at all
(its mean ratio to the best one is at most 1), one is enough and EM needn't run.

The models are learned from a sample of labelled rows, at most SAMPLE a language, spread by a hash of the doc_id. Every
text is predicted as a whole.

Defined results: a text that is null, empty or without letters is `und` with score 0, and so is every text if no
labelled row could be learned from. Equal likelihoods go to the language that sorts first. Case doesn't count.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaquarry.llm.common import renamed

SAMPLE = 2000
BITS = 18
SMOOTH = 0.5
ROUNDS = 25
UNKNOWN = "und"
#: Characters that one step looks at together, unless a single text has more.
STEP = 1_000_000


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the doc_id as text leaves `rest`; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        flags = np.zeros(sys.maxunicode + 1, dtype=bool)
        flags[[c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]] = True
        _LETTERS.append(flags)
    return _LETTERS[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each trigram and of its first two characters, for all words of the texts in turn; where each word begins; and how many words come up to each text's end."""
    raw = " ".join([(t or "").lower() for t in texts]) + " "
    c = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[np.minimum(c, sys.maxunicode)]
    c = np.where(letter, c, np.uint32(32))
    before = np.concatenate([[np.uint32(32)], c[:-1]]).astype(np.uint32)
    two = before * np.uint32(0x9E3779B1)
    second = np.concatenate([[np.uint32(32)], before[:-1]]).astype(np.uint32)
    two = (two ^ (second * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    two ^= two >> np.uint32(15)
    three = (two ^ (c * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    three ^= three >> np.uint32(13)
    was = np.concatenate([[False], letter[:-1]])
    kept = letter | was  # each letter, and the end of each word
    begin = np.flatnonzero((letter & ~was)[kept])
    lengths = np.cumsum([len((t or "").lower()) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    starts = np.flatnonzero(letter & ~was)
    mask = np.uint32((1 << BITS) - 1)
    return (three[kept] & mask).astype(np.int64), (two[kept] & mask).astype(np.int64), begin, np.searchsorted(starts, lengths)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # trigram by language: logarithm of the likelihood


def steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= STEP):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def learn(docs: DataFrame, may_learn: Column, sample: int = SAMPLE) -> Model:
    """Trigram models from the rows with a language that may_learn allows; the driver gets counts, at most 2^BITS a language."""
    rows = docs.where(may_learn & F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not found:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    share = F.create_map(*[x for k, n in found.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                for at, end in steps(own):
                    three, two, _, _ = grams(own[at:end])
                    if len(three):
                        keys, first, n = np.unique(three, return_index=True, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(two[first]), pa.array(n.astype(np.int64))], names=["lang", "three", "two", "n"])

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, three long, two long, n long").groupBy("lang", "three").agg(F.min("two").alias("two"), F.sum("n").alias("n"))
    got = counted.toPandas()
    languages = sorted(set(got["lang"]))
    table = np.zeros((1 << BITS, len(languages)), np.float64)
    three, two, n = (got[k].to_numpy(np.int64) for k in ("three", "two", "n"))
    code = got["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(np.int64)
    per_two = np.zeros_like(table)
    np.add.at(per_two, (two, code), n)
    np.add.at(table, (three, code), n)
    prefix_of = np.zeros(1 << BITS, np.int64)
    prefix_of[three] = two
    known = np.zeros(1 << BITS, bool)
    known[three] = True
    base = 1 / 40
    out = np.log((table + SMOOTH * base) / (per_two[prefix_of] + SMOOTH))
    out[~known] = np.log(base)  # says nothing for or against a language
    return Model(languages, out.astype(np.float32))


def mixture(words: np.ndarray) -> tuple[np.ndarray, float]:
    """words: log-likelihoods by word and language. The proportions of the best set of languages, and its penalised log-likelihood."""
    n, k = words.shape
    top = words.max(axis=1, keepdims=True)
    p = np.exp((words - top).astype(np.float64))
    p = np.maximum(p, 1e-12)
    base = float(top.sum())
    singles = np.log(p).sum(axis=0)
    best = int(singles.argmax())
    price = 0.5 * np.log(max(n, 2))
    alone = np.zeros(k)
    alone[best] = 1.0
    if k == 1 or ((p / p[:, best : best + 1]).mean(axis=0) <= 1 + 1e-9).all():
        return alone, base + float(singles[best]) - price
    used = np.ones(k, bool)
    share = np.full(k, 1.0 / k)
    found: tuple[float, np.ndarray] = (base + float(singles[best]) - price, alone)
    while used.sum() > 1:
        own = p[:, used]
        q = share[used] / share[used].sum()
        for _ in range(ROUNDS):
            mixed = own @ q
            after = q * ((1.0 / mixed) @ own) / n
            done = np.abs(after - q).max() < 1e-4
            q = after
            if done:
                break
        score = base + float(np.log(own @ q).sum()) - price * int(used.sum())
        share = np.zeros(k)
        share[used] = q
        if score > found[0]:
            found = (score, share.copy())
        least = int(np.where(used, share, 2.0).argmin())
        used[least] = False
        share = np.where(used, np.maximum(share, 1e-3), 0.0)
    return found[1], found[0]


def predicted(docs: DataFrame, model: Model, into: tuple[str, str, str] = ("lang_pred", "score", "mixture")) -> DataFrame:
    """docs with the predicted language, its proportion of the words, and the proportions of all languages found in the text."""
    names = [renamed(docs.columns, x) for x in into]
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table = shared.value
        for batch in batches:
            texts = batch.column(where).to_pylist()
            lang, score, parts = [], [], []
            for at, end in steps(texts):
                three, _, begin, upto = grams(texts[at:end])
                words = np.add.reduceat(table[three], begin, axis=0) if len(begin) and languages else np.zeros((0, 1), np.float32)
                first = 0
                for last in upto.tolist():
                    if last == first or not languages:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        parts.append([])
                    else:
                        share, _ = mixture(words[first:last])
                        k = int(share.argmax())
                        lang.append(languages[k])
                        score.append(min(1.0, float(share[k])))
                        parts.append([(languages[i], float(share[i])) for i in np.flatnonzero(share > 0)])
                    first = last
            more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(parts, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    schema = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(None).cast("map<string,double>").alias(names[2])).schema
    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and mixture (as JSON) of every document; learned from the rows that aren't held out."""
    apart = held_out(F.col("doc_id"), 3, 1)
    model = learn(docs, ~apart)
    rows = predicted(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", F.to_json("mixture").alias("mixture"))


def with_language(docs: DataFrame) -> DataFrame:
    """docs without those in which no language is found. Its columns alone."""
    names = ("lang_pred_", "score_", "mixture_")
    added = [renamed(docs.columns, x) for x in names]
    rows = predicted(docs.withColumn("text", F.col("text").cast("string")), learn(docs, ~held_out(F.col("doc_id"), 3, 1)), names)
    return rows.where(F.col(added[0]) != UNKNOWN).drop(*added)
