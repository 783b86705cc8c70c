"""Best-fit packing by sums of squares: documents' token sequences into sequences of a fixed length.

Each document is tokenized once; longer ones are cut from their end into whole sequences, so that only the first
piece may be shorter. Whole pieces are sequences of their own. The others are dealt out evenly to groups, and each
group is packed by itself: a piece of length a goes where the sum over gaps g of N(g)^2 becomes smallest, N(g) being
the open sequences of the group with g places left. A group holds GROUP_ROWS pieces on average, whatever the input,
so no task grows with it, and what stays open at a group's end is a few sequences among tens of thousands.

Defined results: a null text is empty and so is one piece with the end id alone; repeated rows and equal doc_ids are
packed each by itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaquarry.llm.common import stored
from metaquarry.llm.encode import encoder

SEQUENCE = 1024
GROUP_ROWS = 60_000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def piece_lengths(n: int, most: int) -> list[int]:
    """n tokens in pieces of `most`; the first takes the remainder."""
    head = n % most
    return ([head] if head else []) + [most] * (n // most)


def sum_of_squares(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length (1 to most), in the order given: the number of its sequence and its offset there.

    Placing a into gap g changes the sum of N^2 by 2 N(g-a) - 2 N(g) + 2, into a new sequence by 2 N(most-a) + 1; gap 0
    doesn't count. Ties go to the smallest gap, so to the best fit, and a new sequence opens only if it is better."""
    n = np.zeros(most + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(most + 1)]
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i, a in enumerate(lengths.tolist()):
        cost = n[: most + 1 - a] - n[a:]  # of gap a, a + 1, ...: what it becomes, less what it was
        cost[0] = -n[a]
        cost[n[a:] == 0] = np.iinfo(np.int64).max
        best = int(cost.argmin())
        new = 2 * int(n[most - a]) + 1 if a < most else 0
        change = 2 * int(cost[best]) + (2 if best else 1)
        if n[best + a] and change <= new:
            gap = best + a
            n[gap] -= 1
            b = stacks[gap].pop()
        else:
            gap, b, made = most, made, made + 1
        bins[i], offsets[i] = b, most - gap
        if left := gap - a:
            n[left] += 1
            stacks[left].append(b)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """Every document's pieces: place in the document, length, checksum and, if wanted, the ids (little-endian 32-bit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer, "byte"), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                ids += end
                at = 0
                for k, size in enumerate(piece_lengths(len(ids) // 4, most)):
                    own = ids[4 * at : 4 * (at + size)]
                    for column, x in zip(out, (doc, k, at, size, zlib.crc32(own), own if keep_ids else None)):
                        column.append(x)
                    at += size
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:n], kinds)], names=names[:n])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def pack(items: DataFrame, most: int = SEQUENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """items: a stored table with doc_id, piece, start, length, ids_crc32. Adds sequence_id and offset."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    n = items.count()
    groups = max(1, -(-n // group_rows))
    dealt = items.select(*names, F.monotonically_increasing_id().alias("row")).withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("row", "ascending")])
        lengths = t["length"].to_numpy()
        bins, offsets = sum_of_squares(lengths, most)
        base = t["g"][0].as_py() << 36
        return pa.table([*[t[c] for c in names[:3]], t["length"].cast(pa.int64()), t["ids_crc32"], pa.array(bins + base), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    return dealt.groupBy("g").applyInArrow(solve, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, end_id: int, most: int = SEQUENCE) -> DataFrame:
    items, _ = stored(pieces(docs, tokenizer, end_id, most), "pieces")
    return pack(items, most)


def sequences(docs: DataFrame, tokenizer: str, end_id: int, most: int = SEQUENCE) -> DataFrame:
    """The packed sequences themselves: sequence_id, its documents in order, and its ids as little-endian 32-bit integers."""
    items, _ = stored(pieces(docs, tokenizer, end_id, most, keep_ids=True), "pieces")
    key = ["doc_id", "piece", "ids_crc32"]
    once = items.dropDuplicates(key).select(*key, "ids")  # equal rows have equal ids
    part = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    whole = pack(items, most).alias("p").join(once.alias("o"), F.expr("p.doc_id <=> o.doc_id AND p.piece = o.piece AND p.ids_crc32 = o.ids_crc32")).select("p.*", "o.ids")
    return (
        whole.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(part)).alias("parts"))  # at most `most` parts
        .select(
            "sequence_id",
            F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["start"].alias("start"), p["length"].alias("length"))).alias("documents"),
            F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        )
    )
