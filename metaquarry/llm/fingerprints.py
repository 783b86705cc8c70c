"""Document fingerprints: one-permutation MinHash with optimal densification, stored as packed low-order bits.

Every shingle is hashed once; the top bits of its hash are its bin and the smallest hash in each bin stays. An empty
bin takes the value of a bin that isn't: each bin has its own random order of all bins and copies the first one in it
that has a value, so the choice is uniform and the same in every document. BITS low-order bits of each bin's hash are
kept. Two different hashes agree in them once in 2^BITS, so a share m of equal bins means a likeness of
(m - c) / (1 - c) with c = 2^-BITS.

Defined results: a text without words (null, empty or blank) has the fingerprint of all zero bits led by "e:" instead
of "f:", is wholly like another such text and unlike all others. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaquarry.llm.common import cuts, looked_up, range_of, renamed
from metaquarry.llm.words import mixed, text_shingles

BINS, BITS = 512, 4
#: Rows in a range of doc_ids, on average, and the most ranges, which bounds what the driver holds.
RANGE_ROWS, MAX_RANGES = 1500, 20_000
#: Up to so many bins with values, a donor is looked for among them; above, in each bin's own order.
FEW = 96

_ORDERS = np.argsort(np.random.default_rng(20240229).random((BINS, BINS)), axis=1).astype(np.int16)
_RANKS = np.argsort(_ORDERS, axis=1).astype(np.int16)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_SALTS = mixed(np.arange(BINS, dtype=np.uint64))
EMPTY = "e:"


def bins(shingles: np.ndarray) -> np.ndarray | None:
    """The low-order bits in each bin (BINS small integers) of ascending distinct hashes; None without any."""
    if not len(shingles):
        return None
    place = (shingles >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    full = place[first]
    donor = np.arange(BINS)
    if len(full) < BINS:
        has = np.zeros(BINS, bool)
        has[full] = True
        lack = np.flatnonzero(~has)
        if len(full) <= FEW:
            donor[lack] = full[_RANKS[np.ix_(lack, full)].argmin(axis=1)]
        else:
            left, k = lack, 0
            while len(left):
                at = _ORDERS[left, k]
                ok = has[at]
                donor[left[ok]] = at[ok]
                left, k = left[~ok], k + 1
    hashes = np.zeros(BINS, np.uint64)
    hashes[full] = shingles[first]
    return (mixed(hashes[donor] ^ _SALTS) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(values: np.ndarray | None) -> str:
    """BITS bits of each bin, as text."""
    if values is None:
        return EMPTY + base64.b64encode(bytes(BINS * BITS // 8)).decode()
    bits = np.unpackbits(values[:, None], axis=1, count=BITS, bitorder="little")
    return "f:" + base64.b64encode(np.packbits(bits, bitorder="little").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray | None:
    if fingerprint.startswith(EMPTY):
        return None
    bits = np.unpackbits(np.frombuffer(base64.b64decode(fingerprint[2:]), np.uint8), bitorder="little").reshape(BINS, BITS)
    return (bits << np.arange(BITS, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The Jaccard similarity that two fingerprints tell, with the chance agreement of low-order bits taken out."""
    if a is None or b is None:
        return float(a is b)
    c = 2.0**-BITS
    return min(1.0, max(0.0, (float(np.count_nonzero(a == b)) / BINS - c) / (1 - c)))


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with its fingerprint as a further column, in one pass and without a shuffle. Where docs has a column of that name, underscores go before it."""
    into = renamed(docs.columns, into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([packed(bins(s)) for s in text_shingles(b.column(text))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, into])

    return docs.mapInArrow(run, docs.withColumn(into, F.lit("")).schema)


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def beside_next(docs: DataFrame) -> DataFrame:
    """Each document in ascending doc_id beside the next: fingerprints of its text and of its edited text, and their likeness.

    doc_ids are cut into ranges; the first document of each range also goes to the range before it (and the very
    first to the last), so every range is worked through in order by itself, a batch at a time. Rows of equal doc_id
    follow each other by text; those without doc_id come first, and the last document's next is the least doc_id there is."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = cuts(docs, "doc_id", RANGE_ROWS, MAX_RANGES)
    ranges = docs.select("doc_id", range_of(F.col("doc_id"), at).alias("part"))
    firsts = ranges.groupBy("part").agg(F.min("doc_id").alias("doc_id")).collect()  # at most MAX_RANGES rows
    used = sorted((r["part"], r["doc_id"]) for r in firsts)
    back = [(doc, used[k - 1][0]) for k, (_, doc) in enumerate(used)]
    extra = docs.sparkSession.createDataFrame(back, "doc_id long, goes int")
    rows = looked_up(docs, F.broadcast(extra), ["doc_id"], "left")
    both = F.array(F.struct(range_of(F.col("doc_id"), at).alias("part"), F.lit(False).alias("copy")), F.struct(F.col("goes").alias("part"), F.lit(True).alias("copy")))
    rows = rows.select("doc_id", "text", F.explode(F.filter(both, lambda x: x["part"].isNotNull())).alias("to")).select("doc_id", "text", "to.part", "to.copy")
    parts = max(1, len(used) // 2)
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "copy", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next is still to come: doc_id, text, part, its bins
        names = [f[0] for f in _OUT]
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            own = [bins(s) for s in text_shingles(b.column(1))]
            done = []
            for doc, text, part, copy, mine in zip(*columns, own):
                if held is not None and held[2] == part:
                    done.append((held, text, mine))
                held = None if copy else (doc, text, part, mine)
            changed = [_edited(h[1], following) for h, following, _ in done]
            raw = [x.encode() for x in changed]
            theirs = [bins(s) for s in text_shingles(pa.array(changed, pa.large_string()))]
            out = [
                [h[0] for h, _, _ in done],
                [len(h[1]) for h, _, _ in done],
                [hashlib.sha256(x).hexdigest() for x in raw],
                [packed(h[3]) for h, _, _ in done],
                [packed(x) for x in theirs],
                [likeness(h[3], x) for (h, _, _), x in zip(done, theirs)],
                [likeness(h[3], n) for h, _, n in done],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(out, _OUT)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_OUT = [
    ("doc_id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]
