"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when their sets of five-word shingles are at least 75 % alike. Every set is put into one order of
all shingles: by their estimated frequency over all documents (a table of 2^20 counters), then by hash, so common
passages come last. A set of s keeps a prefix of s - ceil(0.75 s) + l shingles. l grows from 1 to 8 while the longer
prefix is expected to save more verification than it costs. Two sets that link share at least a = ceil(3 (s + t) / 7)
shingles, and hence, with prefixes of s - p and t - q left out, at least a - max(s - p, t - q) of their prefixes'
shingles: the longer the prefixes, the more. Pairs that do are verified on their whole sets.

Equal sets are one node (named by a 64-bit hash of the set). Copies that differ would make all pairs of their group,
so nodes are joined in three turns. First, each node of a prefix shingle meets only the HUBS least nodes that have it;
what is verified there gives components. Then those outside a shingle's commonest component meet the INSIDE nodes of it that have least to themselves. At
last components that share as many prefix shingles as two of their nodes would have to are compared node by node, in
blocks. No link between components is lost, and a group of m near copies costs about m pairs. Whatever is counted or reduced is summed up before its shuffle.

Defined results: a text without words (null, empty, blank) has no shingles and no links; its component is its own
doc_id. Equal sets link. Rows of equal doc_id are linked by their sets like others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from metaquarry.llm.common import drop, looked_up, renamed, stored
from metaquarry.llm.graphs import components
from metaquarry.llm.words import mixed, text_shingles

COUNTERS = 1 << 20
SLICE = 1 << 15
LONGEST = 8
#: What verifying a candidate costs, in looked-up shingles.
VERIFY = 16
#: Nodes of a shingle that all others meet in the first turn. Near copies that are 75 % alike by half still find one.
HUBS = 8
#: Of the hubs that a node meets, so many are verified: those with the most shared shingles.
TRIED = 8
#: Nodes of a shingle's commonest component that those outside it meet in the second turn.
INSIDE = 32
#: Nodes of one side of a block in which two components meet, on average.
BLOCK = 256
#: Bits of the filter that tells which sets are needed: so many for each node, and at most so many, which bounds it.
FILTER_BITS, FILTER_MOST = 16, 1 << 27
LINK = "100 * same >= 75 * (s_a + s_b - same)"


def named(shingles: np.ndarray) -> int:
    """A set's 64-bit name, signed as Spark's long."""
    powers = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    return int(mixed(np.array([(mixed(shingles + powers)).sum(dtype=np.uint64) + np.uint64(len(shingles))]))[0].astype(np.int64))


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def scanned(docs: DataFrame) -> DataFrame:
    """One pass: doc_id, s and fp of every document, and in rows with a slice the partition's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, held, n = np.zeros(COUNTERS, np.int64), set(), [], 0
        names = ["doc_id", "s", "fp", "slice", "counts"]
        for batch in batches:
            s, fp = [], []
            for x in text_shingles(batch.column(1)):
                s.append(len(x))
                fp.append(named(x) if len(x) else None)
                if len(x) and fp[-1] not in seen:
                    seen.add(fp[-1])
                    held.append((x & np.uint64(COUNTERS - 1)).astype(np.int64))
                    n += len(x)
                    if n > COUNTERS:
                        counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
                        held, n = [], 0
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.int64()), pa.array(fp, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names=names)
        if held:
            counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
        small = np.minimum(counts, 0xFFFF).astype("<u2").reshape(-1, SLICE)
        k = len(small) if seen else 0
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64())] * 3 + [pa.array(range(k), pa.int32()), pa.array([x.tobytes() for x in small[:k]], pa.binary())], names=names)

    return _text(docs).mapInArrow(run, "doc_id long, s long, fp long, slice int, counts binary")


def summed(slices: DataFrame) -> np.ndarray:
    """The counters over all partitions: one task per slice adds rows as they come; the driver gets COUNTERS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, "<u2").astype("<u4")
                total[k] = total[k] + own if k in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros((COUNTERS // SLICE, SLICE), dtype="<u4")
    for r in slices.select("slice", "counts").repartition("slice").mapInArrow(run, "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], "<u4")
    return out.reshape(-1)


def prefix(shingles: np.ndarray, counts: np.ndarray, base: int) -> tuple[int, np.ndarray]:
    """l, and the set's first s - ceil(0.75 s) + l shingles in the common order."""
    n = counts[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]
    order = np.argsort(n, kind="stable")  # equal counts stay in the order of their hashes
    s = len(shingles)
    need = (3 * s + 3) // 4
    most = min(LONGEST, need)
    others = np.cumsum(np.maximum(n[order[: s - need + most]].astype(np.int64) - base, 0))
    ls = np.arange(1, most + 1)
    meets = others[s - need + ls - 1]
    cost = meets + (s - need + ls) + VERIFY * meets / ls
    l = int(ls[cost.argmin()])  # noqa: E741
    return l, shingles[order[: s - need + l]]


def postings(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """token, fp, s, l, left (shingles of the prefix from this one on): a row for each shingle of each distinct set's prefix (again in each partition that has the set)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 0xFFFF).astype(np.uint16))
    base = int(np.median(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, order = set(), shared.value
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for x in text_shingles(batch.column(0)):
                if len(x) and (fp := named(x)) not in seen:
                    seen.add(fp)
                    l, first = prefix(x, order, base)  # noqa: E741
                    for column, v in zip(rows, (fp, len(x), l, first.view(np.int64))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.list_(pa.int64()))], names=["fp", "s", "l", "tokens"])

    return _text(docs).select("text").mapInArrow(run, "fp long, s int, l int, tokens array<long>").select("fp", "s", "l", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token")).select("token", "fp", "s", "l", (F.col("n") - F.col("at")).alias("left"))


def filter_of(nodes: DataFrame, n: int) -> np.ndarray:
    """Bits (a power of two of them) that are set for every fp of nodes."""
    bits = min(FILTER_MOST, 1 << max(16, (n * FILTER_BITS - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in filter_places(fp, bits):
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(bits // 8, np.uint8)
    tasks = min(16, 1 + n // 100_000)
    for r in nodes.select("fp").coalesce(tasks).mapInArrow(run, "bits binary").toLocalIterator():  # 16 of them at most
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def filter_places(fp: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mixed(fp.view(np.uint64))
    return [((h >> np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in (0, 21)]


def sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """fp, shingles (ascending array) of the nodes: computed again from the texts, and sent on only if the filter has it."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(nodes, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, has = set(), shared.value
        for batch in batches:
            found: list[np.ndarray] = []
            for x in text_shingles(batch.column(0)):
                found.append(x)
            fps = np.array([named(x) if len(x) else 0 for x in found], dtype=np.int64)
            ok = np.array([len(x) > 0 for x in found], dtype=bool)
            for at in filter_places(fps, 8 * len(has)):
                ok &= (has[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            out = []
            for i in np.flatnonzero(ok):
                if (fp := int(fps[i])) not in seen:
                    seen.add(fp)
                    out.append((fp, found[i].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["fp", "shingles"])

    found = _text(docs).select("text").mapInArrow(run, "fp long, shingles array<long>")
    return found.join(nodes.select(F.col("fp").alias("wanted")), F.expr("fp = wanted"), "left_semi").dropDuplicates(["fp"])


def verified(docs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, str]:
    """Those of the pairs (a, s_a, b, s_b; a stored table) whose whole sets link."""
    spark = docs.sparkSession
    nodes, at = stored(pairs.select(F.col("a").alias("fp")).distinct().unionByName(pairs.select(F.col("b").alias("fp")).distinct()).distinct(), "nodes")
    sets, sets_at = stored(sets_of(docs, nodes, nodes.count()), "sets")
    x = sets.select(F.col("fp").alias("fa"), F.col("shingles").alias("xs"))
    y = sets.select(F.col("fp").alias("fb"), F.col("shingles").alias("ys"))
    both = pairs.join(x, F.expr("a = fa")).join(y, F.expr("b = fb")).withColumn("same", F.size(F.array_intersect("xs", "ys")))
    out = stored(both.where(LINK).select("a", "b"), "linked")
    drop(spark, at, sets_at)
    return out


def candidates(pairs: DataFrame) -> DataFrame:
    """From rows of shared prefix shingles (a, s_a, l_a, b, s_b, l_b): the pairs that share as many as a link asks for."""
    asked = "(3 * (s_a + s_b) + 6) div 7 - greatest((3 * s_a + 3) div 4 - l_a, (3 * s_b + 3) div 4 - l_b)"
    return pairs.groupBy("a", "s_a", "l_a", "b", "s_b", "l_b").agg(F.count("*").alias("n")).where(f"n >= {asked}").select("a", "s_a", "b", "s_b", "n")


def alike_sizes(a: str, b: str) -> str:
    return f"4 * {a} >= 3 * {b} AND 4 * {b} >= 3 * {a}"


def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """Rows of shared shingles as one side of a join: the node as `name`, other columns with it as a suffix."""
    return rows.select(F.col("fp").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("token", "s", "l", *more)])


def best_met(pairs: DataFrame, most: int) -> DataFrame:
    """Of the pairs of each a, those with the most shared shingles."""
    order = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    return pairs.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).drop("turn", "n")


def with_component(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with c, the component of the node fp; a node without links is its own."""
    return looked_up(rows, groups.withColumnRenamed("node", "fp"), ["fp"], "left").withColumn("c", F.coalesce("component", "fp")).drop("component")


def with_main(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows of shingles with nodes of several components: c, the node's component, and main, the commonest of the shingle."""
    rows = with_component(rows.select("token", "fp", "s", "l", "left"), groups)
    sizes = rows.groupBy("token", "c").agg(F.count("*").alias("n"))
    main = sizes.groupBy("token").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    return looked_up(rows, main, ["token"])


ASKED = "(3 * (low_a + low_b) + 6) div 7 - greatest((3 * high_a + 3) div 4 - l_a, (3 * high_b + 3) div 4 - l_b)"


def near_components(rows: DataFrame) -> tuple[DataFrame, str]:
    """a, b: components of which two nodes may link. rows: token, s, l, c and left (the node's prefix from this shingle on).

    The first shingle that two linking nodes' prefixes share has as many of them from there on, in either prefix, as they
    must share; common shingles come last, so few of their rows meet at all. What two nodes share, their components share,
    so of those that meet, components with fewer common prefix shingles than any two nodes would need are apart. A
    shingle's rows are first reduced to one for each component."""
    spark = rows.sparkSession
    per, at = stored(rows.groupBy("token", "c").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.min("l").alias("l"), F.max("left").alias("left")), "shingles")
    x, y = (per.select(F.col("c").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("token", "low", "high", "l", "left")]) for n in ("a", "b"))
    met = x.join(y, F.expr(f"token_a = token_b AND a < b AND 4 * high_a >= 3 * low_b AND 4 * high_b >= 3 * low_a AND least(left_a, left_b) >= {ASKED}"))
    counts = per.groupBy("c").agg(F.count("*").alias("n"))
    met = looked_up(looked_up(met.select("a", "b").distinct(), counts.select(F.col("c").alias("a"), F.col("n").alias("n_a")), ["a"]), counts.select(F.col("c").alias("b"), F.col("n").alias("n_b")), ["b"])
    fewer = F.col("n_a") <= F.col("n_b")
    met, met_at = stored(met.select(F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("many")), "met")
    shared = met.join(x, F.expr("few = a")).join(y, F.expr("many = b AND token_a = token_b"))
    total = shared.groupBy("a", "b").agg(F.count("*").alias("n"), *[F.min(f"{c}_{n}").alias(f"{c}_{n}") for c in ("low", "l") for n in ("a", "b")], *[F.max(f"high_{n}").alias(f"high_{n}") for n in ("a", "b")])
    out = stored(total.where(f"n >= {ASKED}").select("a", "b"), "near")
    drop(spark, at, met_at)
    return out


def verified_between(docs: DataFrame, near: DataFrame, nodes: DataFrame) -> tuple[DataFrame, str]:
    """Links between the nodes (fp, s, c) of near components (a, b). Pairs of lone nodes are verified one by one; others
    in blocks: every node of the smaller component against the nodes of the larger one, one link for each block."""
    spark = docs.sparkSession
    sizes = nodes.groupBy("c").agg(F.count("*").alias("n"), F.min("s").alias("s"))
    both = looked_up(looked_up(near, sizes.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a")), ["a"]), sizes.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b")), ["b"])
    both, both_at = stored(both, "near")
    lone = both.where("n_a = 1 AND n_b = 1")  # a lone node names its component
    small = F.col("n_a") < F.col("n_b")
    other = both.where("n_a > 1 OR n_b > 1").select(F.when(small, F.col("a")).otherwise(F.col("b")).alias("c"), F.when(small, F.col("b")).otherwise(F.col("a")).alias("home"))
    visits = other.join(nodes, "c").select("home", "fp").distinct()
    wanted = other.select(F.col("home").alias("c")).distinct().join(nodes, "c").select("fp").unionByName(visits.select("fp")).unionByName(lone.select(F.col("a").alias("fp"))).unionByName(lone.select(F.col("b").alias("fp"))).distinct()
    wanted, wanted_at = stored(wanted, "wanted")
    sets, sets_at = stored(sets_of(docs, wanted, wanted.count()), "sets")
    x = sets.select(F.col("fp").alias("fa"), F.col("shingles").alias("xs"))
    y = sets.select(F.col("fp").alias("fb"), F.col("shingles").alias("ys"))
    one_by_one = lone.join(x, F.expr("a = fa")).join(y, F.expr("b = fb")).withColumn("same", F.size(F.array_intersect("xs", "ys"))).where(LINK).select("a", "b")

    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    visited = visits.groupBy("home").agg(F.count("*").alias("visitors"))
    grid = looked_up(visited, sizes.select(F.col("c").alias("home"), F.col("n").alias("members")), ["home"]).select("home", blocks("members").alias("rows"), blocks("visitors").alias("columns"))
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = looked_up(nodes.select(F.col("c").alias("home"), "fp"), grid, ["home"]).withColumn("row", part("rows")).withColumn("column", every("columns"))
    visitors = looked_up(visits, grid, ["home"]).withColumn("column", part("columns")).withColumn("row", every("rows"))
    with_set = lambda df: looked_up(df.select("home", "row", "column", "fp"), sets, ["fp"])

    def meet(home: pa.Table, guests: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if home.num_rows and guests.num_rows:
            column = home["shingles"].combine_chunks()
            all_of, ends = column.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
            sizes, names = np.diff(ends, prepend=0), home["fp"].to_numpy()
            for fp, own in zip(guests["fp_"].to_pylist(), guests["shingles_"].combine_chunks()):
                own = np.sort(own.values.to_numpy())
                at = np.searchsorted(own, all_of)
                found = np.concatenate([[0], np.cumsum(own[np.minimum(at, len(own) - 1)] == all_of)])
                same = found[ends] - found[ends - sizes]
                linked = np.flatnonzero(100 * same >= 75 * (sizes + len(own) - same))
                if len(linked):
                    out.append((fp, int(names[linked[0]])))
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    key = ["home", "row", "column"]
    guests = with_set(visitors).select(*[F.col(c).alias(f"{c}_") for c in (*key, "fp", "shingles")])
    in_blocks = with_set(members).groupBy(*key).cogroup(guests.groupBy(*[f"{c}_" for c in key])).applyInArrow(meet, "a long, b long")
    out = stored(one_by_one.unionByName(in_blocks), "linked")
    drop(spark, both_at, wanted_at, sets_at)
    return out


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    scan, _ = stored(scanned(docs), "scan")
    slim = scan.where("slice IS NULL").select("doc_id", "s", "fp")
    counts = summed(scan.where("slice IS NOT NULL"))

    by_token = Window.partitionBy("token")
    rows = postings(docs, counts).withColumn("place", F.dense_rank().over(by_token.orderBy("fp"))).withColumn("low", F.min("fp").over(by_token)).withColumn("high", F.max("fp").over(by_token))
    rows, rows_at = stored(rows.where("low <> high").dropDuplicates(["token", "fp"]).select("token", "fp", "s", "l", "left", "place"), "postings")

    # first turn: with the hubs of each shingle, as far as their shingles alone make a link likely
    hubs = side(rows.where(F.col("place") <= HUBS), "b", "place")
    met = side(rows, "a", "place").join(hubs, F.expr(f"token_a = token_b AND place_a > place_b AND {alike_sizes('s_a', 's_b')}"))
    pairs, at = stored(best_met(candidates(met), TRIED), "pairs")
    links, links_at = verified(docs, pairs)
    groups, groups_at = stored(components(links), "groups")
    drop(spark, at)

    # second turn: those outside a shingle's commonest component with hubs inside
    mixed_rows, mixed_at = stored(with_main(rows, groups), "mixed")
    typical = rows.groupBy("fp").agg((F.max(F.expr("s - (3 * s + 3) div 4 + l")) - F.count("*")).alias("own"))  # prefix shingles that nobody else has
    order = Window.partitionBy("token").orderBy("own", "fp")
    inside = looked_up(mixed_rows.where("c = main"), typical, ["fp"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= INSIDE)
    crowded = inside.where(F.col("place") == HUBS).select("token")
    outside = mixed_rows.where("c <> main").join(crowded, "token", "left_semi")
    met = side(outside, "a").join(side(inside, "b"), F.expr(f"token_a = token_b AND {alike_sizes('s_a', 's_b')}"))
    pairs, at = stored(best_met(candidates(met), INSIDE), "pairs")
    more, more_at = verified(docs, pairs)
    links, next_at = stored(links.unionByName(more), "links")
    drop(spark, at, links_at, more_at, mixed_at, groups_at)
    links_at = next_at
    groups, groups_at = stored(components(links), "groups")

    # third turn: components that share enough shingles, node by node
    near, near_at = near_components(with_main(rows, groups).drop("main"))
    nodes, nodes_at = stored(with_component(rows.select("fp", "s").distinct(), groups), "nodes")
    more, more_at = verified_between(docs, near, nodes)
    drop(spark, rows_at, near_at, nodes_at)
    final, _ = stored(components(links.unionByName(more)), "groups")
    drop(spark, links_at, more_at, groups_at)

    own = looked_up(slim, final.withColumnRenamed("node", "fp"), ["fp"], "left").withColumn("c", F.coalesce("component", "fp"))
    own, _ = stored(own.select("doc_id", "s", "c"), "members")
    least_id = own.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    out = looked_up(own.where("c IS NOT NULL"), least_id, ["c"]).select("doc_id", F.col("s").alias("n_shingles"), "component_id")
    return out.unionByName(own.where("c IS NULL").select("doc_id", F.col("s").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those linked to a smaller doc_id, and without rows that repeat a doc_id with its text. Its columns alone.

    Rows without a doc_id, and rows of one doc_id, are told apart by their texts alone: near copies among them all stay."""
    key, same, turn = (renamed(docs.columns, x) for x in ("gone_", "same_", "turn_"))
    gone = joined(docs).where("component_id < doc_id").select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left_anti")
    again = Window.partitionBy("doc_id", same).orderBy(same)
    return kept.withColumn(same, F.xxhash64("text")).withColumn(turn, F.row_number().over(again)).where(F.col(turn) == 1).drop(same, turn)


def oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
 g AS (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, chr(10))] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(10)))) END) AS g FROM w WHERE len(w) > 0),
 h AS (SELECT DISTINCT doc_id, g FROM g),
 s AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * same >= 75 * (a.n + b.n - same)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) m ON m.x = d.doc_id
"""
