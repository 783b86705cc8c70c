"""Every operator against brute force, an exact round trip or held-out accuracy, on texts of all awkward kinds."""

import collections
import hashlib
import heapq
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from metaquarry.llm import fingerprints, graphs, idfiles, langid, linededup, mixing, neardup, neighbours, packing, queries, sharding, toxicity
from metaquarry.llm.encode import Encoder
from metaquarry.llm.words import text_shingles
from tests.llm.conftest import SCHEMA, words

WORD = regex.compile(rb"[^\x20\x09-\x0D]+")
TOKENIZERS = {"word": public_tokenizers.path("word_bpe_49k.json"), "byte": public_tokenizers.path("byte_bpe_50k.json")}


def shingles(text):
    w = WORD.findall(bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def roots(items, links):
    up = {i: i for i in items}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in items}


# words and ids


def test_shingle_hashes_are_sets(corpus):
    texts = [r[1] for r in corpus]
    for text, found in zip(texts, text_shingles(pa.array(texts, pa.string()))):
        assert len(found) == len(shingles(text)) and (np.diff(found.view(np.uint64)) > 0).all()
    by = {}
    for text, found in zip(texts, text_shingles(pa.array(texts, pa.large_string()))):
        assert by.setdefault(tuple(found), shingles(text)) == shingles(text)


@pytest.mark.parametrize("kind", ["word", "byte"])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" ab.,'\n\tÀé1 \x1c<|endoftext|>", max_size=60)), max_size=5))
def test_encoder_is_the_library(kind, texts):
    own = _encoder(kind)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert own.encode(texts) == [own.plain(t) for t in texts]


_KEPT = {}


def _encoder(kind):
    if kind not in _KEPT:
        _KEPT[kind] = Encoder(TOKENIZERS[kind], kind)
    return _KEPT[kind]


def test_encoder_forgets_and_remembers(corpus, monkeypatch):
    monkeypatch.setattr("metaquarry.llm.encode.REMEMBERED", 50)
    monkeypatch.setattr("metaquarry.llm.encode.STEP", 500)
    own = Encoder(TOKENIZERS["byte"], "byte")
    texts = [r[1] for r in corpus]
    for _ in range(2):
        assert own.encode(texts) == [own.plain(t or "") for t in texts]


def test_encoder_lets_a_steps_own_words_go(corpus, monkeypatch):
    monkeypatch.setattr("metaquarry.llm.encode.REMEMBERED", 50)
    own = Encoder(TOKENIZERS["word"], "word")
    texts = [r[1] for r in corpus]
    for _ in range(3):  # words that are remembered, and others beside them
        assert own.encode(texts) == [own.plain(t or "") for t in texts]
        assert own.known.fresh == {}
    assert own.known


def test_encoder_remembers_short_words_at_once():
    own = Encoder(TOKENIZERS["word"], "word")
    assert own.encode(["short words, unfamiliarlylong ones"]) == [own.plain("short words, unfamiliarlylong ones")]
    assert set(own.known) == {"short", "words,", "ones"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_variable_length_code(numbers):
    control, data = idfiles.pack_ranks(np.array(numbers, dtype="<u4"))
    assert idfiles.unpack_ranks(control, data, len(numbers)).tolist() == numbers and len(control) == -(-len(numbers) // 4)


def test_ranks_of_two_bytes_at_most():
    ranks = np.array([0, 255, 256, 65535, 7])
    control, data = idfiles.pack_ranks(ranks)
    assert data == bytes([0, 255, 0, 1, 255, 255, 7]) and idfiles.unpack_ranks(control, data, 5).tolist() == ranks.tolist()


def test_ids_are_counted_over_documents_of_either_width(monkeypatch):
    monkeypatch.setattr(idfiles, "BLOCK_IDS", 4)
    rows = [np.array(x, dtype=k) for x, k in (([1, 2], "<u2"), ([3], "<u4"), ([70000, 1], "<u4"), ([], "<u2"), ([5], "<u2"))]
    found = list(idfiles._runs_of_ids([len(x) for x in rows], [x.tobytes() for x in rows]))
    assert [x.tolist() for x in found] == [[1, 2, 3, 70000, 1], [5]]


def test_id_files(spark, docs, corpus, none, monkeypatch):
    monkeypatch.setattr(idfiles, "PART_IDS", 3000)
    monkeypatch.setattr(idfiles, "BLOCK_IDS", 500)
    library = Tokenizer.from_file(TOKENIZERS["word"])
    encoded = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in corpus]
    found = idfiles.round_trip(docs, TOKENIZERS["word"], "word", 1).collect()
    assert len(found) == len(corpus)
    want = collections.Counter((i, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in encoded)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at
        at += r.n_tokens
    assert idfiles.round_trip(none, TOKENIZERS["word"], "word", 1).count() == 0


# packing


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_sum_of_squares_packs(lengths):
    bins, offsets = packing.sum_of_squares(np.array(lengths, dtype=np.int64), 20)
    used = collections.defaultdict(list)
    for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths):
        used[b].append((o, n))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 20
    slow = []  # by the rule as it is written
    for n in lengths:
        options = []
        for i, gap in enumerate(slow):
            if gap >= n:
                options.append((_squares(slow[:i] + [gap - n] + slow[i + 1 :]), 0, gap, i))
        options.append((_squares(slow + [20 - n]), 1, 0, -1))
        _, _, gap, i = min(options)
        if i >= 0:
            slow[i] = gap - n
        else:
            slow.append(20 - n)
    assert sorted(20 - sum(n for _, n in p) for p in used.values()) == sorted(slow)


def _squares(gaps):
    return sum(n * n for g, n in collections.Counter(gaps).items() if g)


def test_packed(spark, docs, corpus, none, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 40)
    found = packing.packed(docs, TOKENIZERS["byte"], 2).collect()
    library = Tokenizer.from_file(TOKENIZERS["byte"])
    want = collections.Counter()
    for i, t, *_ in corpus:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, n in enumerate(packing.piece_lengths(len(ids), 1024)):
            want[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes())] += 1
            at += n
        assert at == len(ids)
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    held = collections.defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        assert sum(n for _, n in parts) <= 1024 and [o for o, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts))][:-1]
    whole = packing.sequences(docs.limit(30), TOKENIZERS["byte"], 2).collect()
    assert all(len(r.ids) == 4 * sum(d.length for d in r.documents) for r in whole)
    assert packing.packed(none, TOKENIZERS["byte"], 2).count() == 0


# sharding


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 300)), max_size=8, unique_by=lambda x: x[0]), st.integers(1, 7))
def test_schedule_is_greedy(sizes, shards):
    heap = [(0, k) for k in range(shards)]
    for size, n in sorted(sizes, reverse=True):
        for _ in range(n):
            x, k = heapq.heappop(heap)
            heapq.heappush(heap, (x + size, k))
    plan = sharding.schedule(sizes, shards)
    assert all(sum(plan[s]) == n for s, n in sizes)
    assert sorted(sum(s * plan[s][k] for s, _ in sizes) for k in range(shards)) == sorted(x for x, _ in heap)


@pytest.mark.parametrize("at_once", [7, 1000])
def test_plans_of_portions_are_the_plan_of_all(spark, monkeypatch, at_once):
    monkeypatch.setattr(sharding, "AT_ONCE", at_once)
    rng = random.Random(4)
    sizes = [(n, rng.randint(1, 60)) for n in rng.sample(range(1, 5000), 60)]
    plan, _ = sharding.planned(spark, spark.createDataFrame(sizes, "total long, n long"), 5)
    found = {r["of"]: [b - a for a, b in zip([0, *r.ends], r.ends)] for r in plan.collect()}
    assert found == {size: [n for n in took if n] for size, took in sharding.schedule(sizes, 5).items()}


def test_cells_that_cannot_reach_the_bound_are_left_out():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (8, 6)) * 10.0
    x = np.concatenate([c + rng.integers(-200, 200, (50, 6)) for c in centres])
    near, far = neighbours.to_pivots(x, centres)
    length = np.sqrt((x**2).sum(axis=1))
    wide = {c: (far[near == c].max(), length[near == c].max()) for c in range(8)}
    first = [(c, far[i], length[i]) for c in range(8) for i in np.flatnonzero(near == c)[np.argsort(far[near == c])][:6]]
    blocks = [(c, 0, far[near == c].max(), -np.inf) for c in range(8)]
    bound, may = neighbours.reached(blocks, centres, centres, wide, first, 5)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    for c in range(8):
        for q in np.flatnonzero(near == c):
            best = np.argsort(-scores[q])[:5]
            assert scores[q, best[-1]] >= bound[c] and may[c, near[best]].all()
    assert may.mean() < 0.5


def test_shards(docs, corpus, none):
    found = sharding.shard(docs, 5).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in found) == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    text = {i: t or "" for i, t, *_ in corpus}
    by_text, by_shard = collections.defaultdict(set), collections.defaultdict(list)
    for r in found:
        by_text[text[r.doc_id]].add(r.shard)
        by_shard[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    groups = collections.Counter()
    for _, t, *_ in corpus:
        groups[t or ""] += len((t or "").encode()) + 16
    heap = [(0, k) for k in range(5)]
    for n in sorted(groups.values(), reverse=True):
        x, k = heapq.heappop(heap)
        heapq.heappush(heap, (x + n, k))
    loads = collections.Counter()
    for r in found:
        loads[r.shard] += r.size
    assert sorted(loads.values()) == sorted(x for x, _ in heap)
    assert sharding.shard(none, 5).count() == 0


# fingerprints


def test_fingerprints_beside_next(docs, corpus, none, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 20)
    found = fingerprints.beside_next(docs).collect()
    rows = sorted(((i, t or "") for i, t, *_ in corpus))
    want = collections.Counter()
    near = collections.defaultdict(list)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
        near[i].append([len(a & b) / len(a | b) if a | b else 1.0 for a, b in ((shingles(t), shingles(edited)), (shingles(t), shingles(following)))])
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == want
    off = [abs(x - y) for r in found if len(near[r.doc_id]) == 1 for x, y in zip((r.near_edited, r.near_next), near[r.doc_id][0])]
    assert np.mean(off) < 0.03 and max(off) < 0.25
    text = {i: t for i, t in rows}
    by = collections.defaultdict(set)
    for r in found:
        by[text[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values())
    assert all(np.array_equal(fingerprints.unpacked(fingerprints.packed(x)), x) for x in [np.arange(fingerprints.BINS, dtype=np.uint8) % 16])
    assert fingerprints.beside_next(none).count() == 0


def test_fingerprint_beside_a_column_of_that_name(docs):
    both = fingerprints.fingerprints(docs.withColumn("Fingerprint", F.lit("own")))
    assert both.columns[-2:] == ["Fingerprint", "_fingerprint"] and both.where("Fingerprint <> 'own' OR _fingerprint IS NULL").count() < docs.count()


def test_fingerprint_column(wide, docs):
    a = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(wide).select("doc_id", "fingerprint").collect()}
    b = {r.doc_id: r.fingerprint for r in fingerprints.beside_next(docs).collect()}
    assert a == b


# neighbours


def test_neighbours(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 0, 0.5, 1]) + rng.random() / 50 for _ in range(6)]) for i in range(1, 400)]
    rows += [(1000 + i, rows[10][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, []), (2005, [3.0]), (2006, [2.0**40] * 6), (2050, [2.0**41] * 6), (2100, [-(2.0**41)] * 6), (50, rows[49][1])]
    for name, value in (("BLOCK", 3), ("SHARE", 60), ("SAMPLE", 40), ("PER_PIVOT", 30)):
        monkeypatch.setattr(neighbours, name, value)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(9)).withColumn("v", F.lit("x")).withColumn("salt", F.lit(0))
    found = {}
    for r in neighbours.top_k(df, "vec_id", "embedding", F.col("id") % 50 == 0, 5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[i] = [int(np.floor(256 * x)) for x in v]
    want = {}
    for q in good:
        if q % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q))[:5]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    want = {q: [(k, i, min(x, 2**63 - 1)) for k, i, x in rows_] for q, rows_ in want.items()}
    assert {q: sorted(x) for q, x in found.items() if q in want} == want
    assert neighbours.top_k(df.limit(0), "vec_id", "embedding", F.col("id") % 50 == 0, 5).count() == 0
    assert neighbours.top_k(df.where("vec_id = 100"), "vec_id", "embedding", F.col("id") % 50 == 0, 5).count() == 0


# languages


def test_languages(spark, docs, wide, corpus, none):
    found = langid.identified(docs).collect()
    assert len(found) == len(corpus)
    lang = {i: x for i, _, x, *_ in corpus}
    text = {i: t for i, t, *_ in corpus}
    lettered = [r for r in found if any(c.isalpha() for c in text[r.doc_id] or "")]
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {i for i, t, *_ in corpus if not any(c.isalpha() for c in t or "")}
    held = [r for r in lettered if r.held_out and lang[r.doc_id] and len(text[r.doc_id]) > 60]
    assert len(held) > 20 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    kept = langid.with_language(wide)
    assert kept.columns == wide.columns and kept.count() == len(lettered)
    assert langid.identified(none).count() == 0 and langid.with_language(none).count() == 0
    assert {r.lang_pred for r in langid.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_letters_of_all_planes():
    flags = langid._letters()
    assert flags[0x32000] and all(flags[c] == chr(c).isalpha() for c in range(0x31F00, 0x32500))


def test_mixture_finds_proportions():
    rng = np.random.default_rng(1)
    a = np.log(np.array([[0.8, 0.1, 0.1]])) + rng.normal(0, 0.3, (70, 3))
    b = np.log(np.array([[0.1, 0.8, 0.1]])) + rng.normal(0, 0.3, (30, 3))
    both = np.concatenate([a, b]).astype(np.float32)
    share, score = langid.mixture(both)
    assert share[2] == 0 and 0.55 < share[0] < 0.9 and abs(share.sum() - 1) < 1e-6
    price, best = 0.5 * np.log(100), (-np.inf, None)
    p = np.exp(both.astype(float))
    for k in np.linspace(0, 1, 101):  # by trying all pairs of proportions
        for j in np.linspace(0, 1 - k, 101):
            q = np.array([k, j, max(0, 1 - k - j)])
            with np.errstate(divide="ignore"):
                best = max(best, (np.log(p @ q).sum() - price * (q > 1e-9).sum(), tuple(q)))
    assert abs(score - best[0]) < 0.05 and np.abs(np.array(best[1]) - share).max() < 0.03
    alone, _ = langid.mixture(a.astype(np.float32) + np.array([2, 0, 0], np.float32))
    assert alone.tolist() == [1, 0, 0]


# toxicity


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        w, bad = words(rng, rng.randint(5, 80)), i % 8 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zworst", "zvile", "zworster"]))
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, int(bad)))
    rows += [(9000, None), (9001, ""), (9002, "zvile"), (0, rows[0][1])]
    labels += [(9000, None), (None, 1), (3, 1), (3, 0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    apart = langid.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.learn(docs, marks, ~apart)
    found = toxicity.scored(docs.withColumn("Score", F.lit(1)), model)
    score = {r.doc_id: r._score for r in found.withColumnRenamed(found.columns[-1], "_score").collect()}
    assert len(score) == len(rows) - 1
    held = [i for i, _ in rows if i < 1500 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(score[i] >= 0.3) == (i % 8 == 0) for i in held]) > 0.98
    assert score[9002] > 0.3 > score[9000] == score[9001]
    nothing = toxicity.learn(docs, marks.limit(0), ~apart)
    assert {r.score for r in toxicity.scored(docs, nothing).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_risk_does_not_go_below_zero():
    """Where unlabelled texts are nearly all toxic, weights stay bounded and toxic texts stay above others."""
    toxic = [np.array([1, 2, 3 + i % 5]) for i in range(40)]
    other = [np.array([1, 2, 3 + i % 5]) for i in range(30)] + [np.array([50 + i]) for i in range(270)]
    m = toxicity.train(toxic, other, 0.1)
    w = dict(zip(m.places.tolist(), m.weights.tolist()))
    assert {1, 2} <= set(w) and m.constant + w[1] + w[2] > 0 > m.constant and max(abs(x) for x in w.values()) < 20


# mixing


def test_mixing_follows_its_sql(spark, docs, none):
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    for percent, epochs in ((80, 2), (30, 1), (150, 3), (1000, 2)):
        found = mixing.mix(docs, F.expr(queries.MIX_DOMAIN), queries.MIX_WEIGHTS, percent, epochs)
        sql = mixing.oracle(queries.MIX_DOMAIN, queries.MIX_WEIGHTS, percent, epochs, mixing.SEED)
        columns = ["doc_id", "domain", "lang", "source", "n_tokens", "epoch", "leaf_budget"]
        want = con.sql(sql).df()[columns].astype(object)
        got = [tuple(r) for r in found.select(*columns).collect()]
        assert sorted(map(str, got)) == sorted(str(tuple(None if x != x else x for x in r)) for r in want.itertuples(index=False))
    assert mixing.mix(none, F.expr(queries.MIX_DOMAIN), queries.MIX_WEIGHTS).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 200)), min_size=1, max_size=6), st.integers(0, 400))
def test_shares_fill_to_one_level(spark, children, budget):
    rows = [(0, f"c{i}", w, cap, min(budget, sum(c for _, c in children))) for i, (w, cap) in enumerate(children)]
    df = spark.createDataFrame(rows, "parent int, name string, weight long, cap long, budget long")
    got = {r.name: r.given for r in mixing.share_out(df, ["parent"], "name").collect()}
    budget = rows[0][4]
    level, left, open_ = 0.0, float(budget), {r[1]: (r[2], r[3]) for r in rows if r[2] > 0}
    want = {r[1]: 0.0 for r in rows}
    while open_ and left > 1e-9:
        step = left / sum(w for w, _ in open_.values())
        full = {k for k, (w, cap) in open_.items() if cap <= (level + step) * w + 1e-9}
        if not full:
            for k, (w, _) in open_.items():
                want[k] = (level + step) * w
            break
        for k in full:
            want[k] = open_[k][1]
            del open_[k]
        left = budget - sum(want[k] for k in want if k not in open_)
        level = 0.0
    assert all(abs(got[k] - want[k]) <= 1 for k in want)
    assert sum(got.values()) == min(budget, sum(cap for w, cap in children if w > 0))


def test_kept_documents(wide, docs):
    kept = mixing.kept(wide, F.expr(queries.MIX_DOMAIN), queries.MIX_WEIGHTS)
    assert kept.columns == wide.columns
    times = collections.Counter(r.doc_id for r in kept.collect())
    assert max(times.values()) <= 2 * mixing.MAX_EPOCHS and set(times) <= {r.doc_id for r in docs.collect()}


# lines


def _levenshtein(a, b):
    """Edit distance by bit vectors, a column of the table at a time."""
    if not a:
        return len(b)
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    at = collections.defaultdict(int)
    for i, x in enumerate(a):
        at[x] |= 1 << i
    more, less = full, 0
    for y in b:
        same = at[y] if y in at else 0
        across = (((same & more) + more) ^ more) | same
        up, down = less | (full & ~(across | more)), more & across
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        more, less = down | (full & ~(same | less | up)), up & (same | less)
    return distance


def _bag(a, b):
    """No more than twice the edits between two lines."""
    x, y = collections.Counter(a), collections.Counter(b)
    return (x - y).total() + (y - x).total()


def test_line_dedup(docs, wide, corpus, none, monkeypatch):
    monkeypatch.setattr(linededup, "CROWD", 3)  # so that hubs and components have work
    found = {r.doc_id: (r.n_lines, r.n_kept, r.removed) for r in linededup.line_counts(docs).collect()}
    apart = regex.compile(r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lines, first = collections.defaultdict(dict), {}
    for i, t, *_ in sorted(set(corpus), key=lambda r: r[0]):
        for pos, raw in enumerate((t or "").split("\n")):
            if n := apart.sub(" ", raw.lower()).strip(" "):
                lines[i][pos] = n
                first.setdefault(n, (i, pos))
    names = list(first)
    links = []
    for i, j in itertools.combinations(range(len(names)), 2):
        a, b = names[i], names[j]
        edits = int(max(len(a), len(b)) * (1 - linededup.ALIKE) + 1e-9)
        if abs(len(a) - len(b)) <= edits and _bag(a, b) <= 2 * edits and _levenshtein(a, b) <= edits:
            links.append((i, j))
    assert len(links) > 20
    top = roots(range(len(names)), links)
    stays = {}
    for i, n in enumerate(names):
        stays[top[i]] = min(stays.get(top[i], first[n]), first[n])
    at = {n: stays[top[i]] for i, n in enumerate(names)}
    want = {}
    for i, *_ in corpus:
        gone = sorted(pos for pos, n in lines[i].items() if at[n] != (i, pos))
        want[i] = (len(lines[i]), len(lines[i]) - len(gone), gone)
    assert found == want
    kept = linededup.deduplicated(wide)
    assert kept.columns == wide.columns
    text = {i: t for i, t, *_ in corpus}
    for r in kept.collect():
        gone = set(want[r.doc_id][2])
        assert r.text == (text[r.doc_id] if not gone else "\n".join(x for k, x in enumerate(text[r.doc_id].split("\n")) if k not in gone))
    assert {r.doc_id for r in kept.collect()} == {i for i, (n, left, _) in want.items() if left or not n}
    assert linededup.line_counts(none).count() == 0 and linededup.deduplicated(none).count() == 0


def test_line_dedup_finds_lines_by_edit_similarity_alone(spark):
    rng = random.Random(11)
    lines = []
    for n in (2, 4, 6, 8, 12, 18, 25, 40, 60):
        for _ in range(2):
            line = " ".join(words(rng, n))
            at = rng.randrange(len(line))
            w = line.split(" ")
            w[rng.randrange(n)] = "x" * max(1, len(line) // 20)
            lines += [line, line[:at] + "q" + line[at + 1 :], " ".join(w)]
    lines = sorted(set(lines))
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if abs(len(lines[a]) - len(lines[b])) <= 0.15 * max(len(lines[a]), len(lines[b])) and _levenshtein(lines[a], lines[b]) <= int(max(len(lines[a]), len(lines[b])) * (1 - linededup.ALIKE) + 1e-9)]
    top = roots(range(len(lines)), links)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    stays = {r.doc_id for r in linededup.deduplicated(docs).collect()}
    missed = stays - set(top.values())
    assert set(top.values()) <= stays and len(missed) <= 1 and all(len(lines[i]) > linededup.EXACT for i in missed)
    assert len(set(top.values())) < len(lines) - 20


def test_likeness_is_edit_similarity(spark):
    rng = random.Random(3)
    rows = []
    for i in range(80):
        a = words(rng, rng.choice([2, 25, 450]))
        b = list(a)
        for _ in range(rng.randrange(1 + len(b) // 4)):
            at = rng.randrange(len(b))
            b[at : at + rng.choice([0, 1, 1, 2])] = words(rng, rng.choice([0, 1, 1]))
        rows.append((2 * i, 2 * i + 1, " ".join(a), " ".join(b)))
    found = {r.a: r.alike for r in linededup.likeness(spark.createDataFrame(rows, "a long, b long, la string, lb string")).collect()}
    assert found == {i: _levenshtein(a, b) <= int(max(len(a), len(b)) * (1 - linededup.ALIKE) + 1e-9) for i, _, a, b in rows}
    assert 20 < sum(found.values()) < 80


def test_unlikely_pairs_are_compared_at_once(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        a = words(rng, rng.choice([3, 45, 160]))
        b = [w + "x" if rng.random() < (i % 6) / 5 else w for w in a]  # about 0 to 17 % of the characters, so both sides of the limit
        rows.append((2 * i, 2 * i + 1, " ".join(a), " ".join(b)))
    pairs = spark.createDataFrame([*rows, (500, 501, "\u00e4" * 300, "\u00e4" * 299), (502, 503, "a b " * 80 + "c", "a b " * 40 + "c")], "a long, b long, la string, lb string")
    unlikely = linededup.likeness(pairs, likely=False)
    assert sorted(map(tuple, unlikely.collect())) == sorted(map(tuple, linededup.likeness(pairs).collect()))
    found = {r.a: r.alike for r in unlikely.collect()}
    assert {i: found[i] for i, *_ in rows} == {i: _levenshtein(a, b) <= int(max(len(a), len(b)) * (1 - linededup.ALIKE) + 1e-9) for i, _, a, b in rows}
    assert found[500] and not found[502] and 5 < sum(found.values()) < len(found)
    plan = unlikely._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan.lower() and "split" not in plan


def test_parts_are_never_closer_than_the_lines(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        a = "".join(rng.choice("abc é😀" if i % 3 else "ab") for _ in range(rng.randint(600, 900)))
        b = list(a)
        for _ in range(rng.choice([0, 1, 8, 40])):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "yz"])
        if i % 4 == 1:  # a block that is gone, or comes twice
            at = rng.randrange(400)
            b[at : at + 70] = [] if i % 8 == 1 else b[at : at + 70] * 2
        if i % 10 == 9:
            rng.shuffle(b)
        rows.append((i, 0, a, "".join(b)))
    pairs = spark.createDataFrame(rows, "a long, b long, la string, lb string").withColumn("edits", F.expr("CAST(floor(greatest(length(la), length(lb)) * 0.15) AS int)"))
    found = pairs.select("la", "lb", "edits", F.expr(linededup.in_parts("la", "lb", "edits")).alias("n")).collect()
    exact = [_levenshtein(r.la, r.lb) for r in found]
    assert all(r.n >= d for r, d in zip(found, exact) if r.n <= r.edits)
    assert all(r.n > r.edits for r, d in zip(found, exact) if d > r.edits)
    settled = [r.n <= r.edits for r, d in zip(found, exact) if d <= r.edits]
    assert len(settled) > 40 and sum(settled) > 0.8 * len(settled)


def test_letter_counts_leave_no_line_alike_out(spark):
    """near_counts is what plain counts say, and true for every pair within the edits allowed."""
    r = random.Random(8)
    pairs = []
    for i in range(400):
        a = "".join(r.choice("eeeaiontsrldcump hé") for _ in range(r.choice([3, 30, 120, 900])))
        b = list(a)
        for _ in range(r.randrange(len(a) // 3 + 1)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = r.choice(["", "e", "z", "a"])
        pairs.append((a, "".join(b) if i % 4 else "e" * r.choice([2, 140, 500])))
    rows = spark.createDataFrame(pairs, "x string, y string")
    sides = [F.expr(e).alias(n) for n, e in (("size_a", "length(x)"), ("size_b", "length(y)"))]
    counts = [c.alias(f"s{j}_{n}") for n, col in (("a", "x"), ("b", "y")) for j, c in enumerate(linededup.counts_of(col))]
    edits = F.levenshtein("x", "y")
    for row in rows.select("x", "y", *sides, *counts, edits.alias("d")).select("*", F.expr(linededup.near_counts("a", "b")).alias("near"), F.expr(linededup.most("a", "b")).alias("most")).collect():
        few = lambda t, c: min(t.count(c), 127)
        apart = [few(row.x, c) - few(row.y, c) for c in linededup.LETTERS]
        assert row.near == (max(sum(d for d in apart if d > 0), -sum(d for d in apart if d < 0)) <= row.most)
        assert row.near or row.d > row.most


def test_grams_leave_no_line_alike_out(spark):
    """near_grams is true for every pair within the edits allowed and for longer lines, and false for most that share letters alone."""
    r = random.Random(9)
    pairs = []
    for i in range(600):
        a = "".join(r.choice("eaiontsrld hé😀") for _ in range(r.choice([1, 2, 5, 30, 60, 99, 104])))
        b = list(a)
        for _ in range(r.randrange(len(a) // 6 + 2)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = r.choice(["", "e", "z", "😀"])
        if i % 3 == 0:
            r.shuffle(b)
        pairs.append((a, "".join(b)))
    rows = spark.createDataFrame(pairs, "x string, y string")
    sides = [F.expr(e).alias(n) for n, e in (("size_a", "length(x)"), ("size_b", "length(y)"))]
    rows = rows.select("x", "y", *sides, F.levenshtein("x", "y").alias("d"))
    rows = rows.select("*", *[linededup.grams_of(c, f"size_{n}").alias(f"g_{n}") for n, c in (("a", "x"), ("b", "y"))])
    found = rows.select("*", F.expr(linededup.near_grams("a", "b")).alias("near"), F.expr(linededup.most("a", "b")).alias("most")).collect()
    assert all(x.near for x in found if x.d <= x.most or max(x.size_a, x.size_b) > linededup.FINE)
    shuffled = [x for i, x in enumerate(found) if i % 3 == 0 and 30 <= x.size_a <= 99 and x.size_b <= 99 and x.d > x.most]
    assert len(shuffled) > 50 and sum(x.near for x in shuffled) < 0.2 * len(shuffled)


def test_line_dedup_recall(spark):
    """Of lines of each length with one character, one character of 20, or one word of 10 replaced, nine of ten at least are found."""
    rng = random.Random(8)
    made = []
    for edit, n in itertools.product(("character", "characters", "word"), (2, 5, 9, 14, 20, 40, 90, 250)):
        for _ in range(20):
            line = " ".join(words(rng, n))
            other = list(line)
            if edit == "word":
                w = line.split(" ")
                for at in rng.sample(range(n), max(1, n // 10)):
                    w[at] = "x" * len(w[at])
                other = list(" ".join(w))
            else:
                for at in rng.sample(range(len(line)), 1 if edit == "character" else max(1, len(line) // 20)):
                    other[at] = "q"
            made.append(((edit, n), line, "".join(other)))
    alike = [(n, a, b) for n, a, b in made if _levenshtein(a, b) <= int(max(len(a), len(b)) * (1 - linededup.ALIKE) + 1e-9)]
    docs = spark.createDataFrame([(2 * i + k, t) for i, (_, *both) in enumerate(alike) for k, t in enumerate(both)], "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in linededup.decided(docs).collect()}
    total, found = collections.Counter(n for n, *_ in alike), collections.Counter(n for i, (n, *_) in enumerate(alike) if classes[2 * i] == classes[2 * i + 1])
    assert len(total) >= 18
    assert all(found[n] >= 0.9 * total[n] - 1 for n in total), {n: (found[n], total[n]) for n in total}
    assert sum(found.values()) >= 0.93 * sum(total.values())


def test_runs_of_short_words_are_no_key_alone(spark):
    """Lines that share no more than two short words don't meet; a run is found where it stands."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeinorst", k=7))
    lines = [" ".join([word(), word(), word(), "of", "the", word(), word(), word()]) for _ in range(60)]
    rows = linededup.runs(spark.createDataFrame([(i, len(x), x) for i, x in enumerate(lines)], "k long, size int, line string")).collect()
    assert {r.k for r in rows} == set(range(len(lines)))
    assert max(collections.Counter(r.key for r in rows).values()) == 1
    assert all(r["at"] == 0 or lines[r.k][r["at"] - 1] == " " for r in rows)


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    rows = [(7, "alpha one\nbravo two"), (7, "charlie three\nalpha one"), (None, "delta four\necho five"), (None, "foxtrot six\ndelta four"), (None, "golf seven"), (8, "golf seven")]
    kept = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "delta four\necho five"), (0, "foxtrot six"), (0, "golf seven"), (7, "alpha one\nbravo two"), (7, "charlie three")]


# near duplicates


def test_near_duplicates(docs, wide, corpus, none, monkeypatch):
    sets = {i: shingles(t) for i, t, *_ in corpus}
    ids = sorted(sets)
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = roots(ids, links)
    for hubs, tried, inside, block in ((8, 8, 32, 256), (1, 1, 1, 3), (2, 1, 3, 1)):
        for name, value in (("HUBS", hubs), ("TRIED", tried), ("INSIDE", inside), ("BLOCK", block)):
            monkeypatch.setattr(neardup, name, value)
        found = neardup.joined(docs).collect()
        assert len(found) == len(corpus)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(sets[i]), top[i]) for i in ids}
    assert len(set(top.values())) < len(ids) - 60
    kept = neardup.one_of_each(wide)
    assert kept.columns == wide.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(top.values()))
    assert neardup.joined(none).count() == 0 and neardup.one_of_each(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.integers(0, 60), st.integers(0, 2**32))
def test_linked_sets_share_enough_of_their_prefixes(n, m, shared, seed):
    rng = np.random.default_rng(seed)
    shared = min(shared, n, m)
    pool = rng.choice(2**62, n + m, replace=False).astype(np.uint64)
    a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:shared], pool[n : n + m - shared]]))
    if 100 * shared < 75 * (n + m - shared):
        return
    counts = rng.integers(0, 9, neardup.COUNTERS).astype(np.uint16)
    (la, pa_), (lb, pb) = (neardup.prefix(x, counts, int(rng.integers(0, 9))) for x in (a, b))
    asked = (3 * (n + m) + 6) // 7 - max((3 * n + 3) // 4 - la, (3 * m + 3) // 4 - lb)
    assert len(np.intersect1d(pa_, pb)) >= max(1, asked)


def test_components(spark):
    rng = random.Random(4)
    for links in ([], [(i, i + 1) for i in range(150)], [(0, i) for i in range(1, 300)], [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]):
        df = spark.createDataFrame(links, "a long, b long")
        found = {r.node: r.component for r in graphs.components(df).collect()}
        nodes = {x for link in links if link[0] != link[1] for x in link}
        assert found == {n: t for n, t in roots(nodes, [x for x in links if x[0] != x[1]]).items()}


# the pipeline


def test_pipeline_stages(spark, docs, corpus, tmp_path):
    kept, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(at := str(tmp_path / name.replace(" ", "_")))
        kept = spark.read.parquet(at)
        sizes.append(kept.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing to target weights", "best-fit packing"]
    assert len(corpus) > sizes[0] >= sizes[1] >= sizes[2] and sizes[4] >= sizes[3] > 0
    assert kept.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_of_nothing(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and SCHEMA.startswith("doc_id")
