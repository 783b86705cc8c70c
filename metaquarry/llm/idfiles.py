"""Files of token ids: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Format. A folder holds `ranks`, one row per used id with its rank (0 for the commonest over all documents), and
`blocks`, Parquet rows in ascending doc_id. A block has doc_ids, counts (ids of each document), and the ranks of all
its ids in turn: two control bits each (bytes less one; four ids to a control byte, lowest bits first) in `control`,
and the bytes themselves, little-endian, in `data`. part, start and n_ids tell a block's place: it begins `start` ids
after the beginning of its part, and parts follow each other by number.

Reading looks the control bytes up in a table of 256 rows, sums the lengths to find every id's bytes, and maps ranks
back to ids, all by numpy, a block at a time.

Defined results: null texts are empty and have the end id alone; null doc_ids come first; documents of equal doc_id
are ordered by their ids' checksum; an empty table makes an empty file set; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaquarry.llm.common import drop, new_path, stored
from metaquarry.llm.encode import encoder

#: Ids in a part, on average, and the most parts, which bounds what is numbered in one place.
PART_IDS, MAX_PARTS = 4_000_000, 20_000
#: Ids in a block, unless one document has more.
BLOCK_IDS = 250_000
BLOCKS = "part int, start long, n_ids long, doc_ids array<long>, counts array<long>, control binary, data binary"

_LENGTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3).astype(np.uint8) + 1
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype="<u4")


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    r = np.ascontiguousarray(ranks, dtype="<u4")
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    four = np.zeros(-(-len(r) // 4) * 4, dtype=np.uint8)
    four[: len(r)] = extra
    control = (four.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    kind = "<u2" if extra.max(initial=0) <= 1 else "<u4"
    own = r.astype(kind).view(np.uint8).reshape(len(r), 2 if kind == "<u2" else 4)
    return control.tobytes(), own[np.arange(own.shape[1]) <= extra[:, None]].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """n integers again. Every one is read as four bytes and cut to its own length by a mask."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(size, dtype=np.int64)
    at = end - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype("<u4")
    for k in (1, 2, 3):
        longer = size > k
        if not longer.any():
            break
        out[longer] |= raw[at[longer] + k].astype("<u4") << (8 * k)
    return out & _MASK[size]


def tokenized(docs: DataFrame, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """doc_id, n and the ids of each whole text with the end id, as little-endian integers of two bytes where the vocabulary allows, else four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer, kind), np.array([end_id], dtype="<u4").tobytes()
        small = len(coder.edge) <= 1 << 16 and end_id < 1 << 16
        for batch in batches:
            ids = [x + end for x in coder.encode(batch.column(1).to_pylist())]
            n = [len(x) // 4 for x in ids]
            if small:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, ids binary")


def _array(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def _runs_of_ids(counts: list[int], ids: list[bytes]) -> Iterator[np.ndarray]:
    """All documents' ids, those of many short documents together."""
    held, size = [], 0
    for n, x in zip(counts, ids):
        held.append(_array(x, n))
        size += n
        if size >= BLOCK_IDS:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def frequencies(tokens: DataFrame) -> DataFrame:
    """id, n: how often each id occurs, counted in every partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids in _runs_of_ids(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.bincount(ids)
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return tokens.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, tokenizer: str, kind: str, end_id: int, to: str) -> None:
    """Writes the files under the folder `to`, which driver and executors share."""
    spark = docs.sparkSession
    tokens, at = stored(tokenized(docs, tokenizer, kind, end_id), "tokens")
    counts = frequencies(tokens).collect()  # at most one row per id of the vocabulary
    by_rank = [r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))]
    spark.createDataFrame(list(enumerate(by_rank)), "rank long, id long").coalesce(1).write.parquet(f"{to}/ranks")
    rank = np.zeros(max(by_rank, default=0) + 1, dtype="<u4")
    rank[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(rank)
    parts = max(1, min(MAX_PARTS, sum(r["n"] for r in counts) // PART_IDS))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, rank = TaskContext.get().partitionId(), 0, shared.value
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            control, data = pack_ranks(rank[np.concatenate([x for _, x in held])])
            row = {"part": part, "start": start, "n_ids": size, "doc_ids": [d for d, _ in held], "counts": [len(x) for _, x in held], "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for batch in batches:
            for doc, n, ids in zip(*(c.to_pylist() for c in batch.columns[:3])):
                if held and size + n > BLOCK_IDS:
                    yield block()
                    held, start, size = [], start + size, 0
                held.append((doc, _array(ids, n)))
                size += n
        if held:
            yield block()

    ordered = tokens.withColumn("c", F.crc32("ids")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "c", "n")
    ordered.mapInArrow(code, BLOCKS).write.parquet(f"{to}/blocks")
    drop(spark, at)
    shared.unpersist()


_SCHEMA = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, and ids (little-endian 32-bit) or, as a digest, their ids_crc32."""
    inverse = [r["id"] for r in spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").collect()]  # the vocabulary at most
    shared = spark.sparkContext.broadcast(np.array(inverse, dtype="<u4"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # at most MAX_PARTS rows
    kinds = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                ids = shared.value[unpack_ranks(b["control"], b["data"], b["n_ids"])]
                ends = np.cumsum(b["counts"])
                own = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), b["counts"])]
                columns = [[b["part"]] * len(own), b["doc_ids"], b["start"] + ends - b["counts"], b["counts"], [zlib.crc32(x) for x in own] if digest else own]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    rows = blocks.mapInArrow(decode, "part int, doc_id long, at long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))
    joined = rows.join(F.broadcast(parts), rows["part"] == parts["p"])
    return joined.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32" if digest else "ids")


def round_trip(docs: DataFrame, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """Writes all documents' ids to new files in the shared folder and gives what is read from them."""
    to = new_path(docs.sparkSession, "ids")
    write_ids(docs, tokenizer, kind, end_id, to)
    return read_ids(docs.sparkSession, to, digest=True)
