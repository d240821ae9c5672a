"""Neighbours, near copies and the n-gram model against brute force."""

import collections
import itertools
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import scratch
from millrace.llm import chosen_path, neighbours, ngram_model, secrets
from millrace.llm.arrays import coded, words_of
from millrace.llm.elias_fano import Monotone, Trie, quantised

from .conftest import document

VECTOR = "vec_id long, embedding array<float>, label int"


def test_rotation_keeps_lengths_and_products():
    rows = np.random.default_rng(0).normal(size=(50, 24))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    turn = neighbours.turned(rows, 3, 0)
    assert turn.shape == (50, 32) and np.allclose(turn @ turn.T, unit @ unit.T)
    near = neighbours.axes(rows, 3, 2)
    assert (near.argmax(axis=1) == neighbours.bucket(rows, 3, 2)).all()


def exact(rows, k=5):
    """(query, rank, id, score) by going through all pairs."""
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.float32(v).astype(float))
    out = {}
    for q in [i for i in good if i % 50 == 0]:
        found = []
        for i, vectors in good.items():
            if i == q:
                continue
            pairs = [float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
                     for a in good[q] for b in vectors if len(a) == len(b)]
            if pairs:
                found.append((-max(pairs), i))
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def test_neighbours(stored):
    random = np.random.default_rng(4)
    rows = [(i, random.normal(size=16).tolist(), 0) for i in range(1500)]
    same = random.normal(size=16).tolist()
    rows += [(2000 + i, same, 1) for i in range(400)]  # a hot bucket of ties
    rows += [(5000, None, 0), (5050, [], 0), (5100, [0.0] * 16, 0), (5150, [float("nan")] * 16, 0), (5200, [1.0, None] * 8, 0)]
    rows += [(5250, [float("inf")] + [0.0] * 15, 0), (None, same, 0), (5300, [1.0, 2.0], 0), (5301, [2.0, 1.0], 0), (7, rows[7][1], 0)]
    vectors = stored(rows, VECTOR).withColumn("table", F.lit("clash")).withColumn("bucket", F.lit(0)).withColumn("id", F.lit(0))
    got = neighbours.neighbours(vectors, F.col("id") % 50 == 0).toPandas()
    truth = exact(rows)
    assert set(got["query_id"]) == {q for q in truth if truth[q]}
    hit = total = 0
    for q, wanted in truth.items():
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(wanted) + 1))
        assert mine["score"].is_monotonic_decreasing and q not in set(mine["vec_id"])
        total += len(wanted)
        hit += len({i for i, _ in wanted} & set(mine["vec_id"]))
        for i, s in wanted:
            if i in set(mine["vec_id"]):
                assert abs(mine[mine["vec_id"] == i]["score"].iloc[0] - s) < 1e-12
    assert hit / total >= 0.9
    tied = got[got["query_id"] == 2000].sort_values("rank")
    assert tied["vec_id"].tolist() == [2001, 2002, 2003, 2004, 2005] and tied["score"].nunique() == 1
    assert got[got["query_id"] == 5300]["vec_id"].tolist() == [5301]


def test_blocks_and_fallback_are_exact(stored):
    random = np.random.default_rng(5)
    rows = [(i, random.normal(size=6).tolist(), 0) for i in range(300)]
    data = neighbours.usable(stored(rows, VECTOR))
    one = data.select(F.lit(neighbours.ALL).alias("table"), F.size("vector").cast("long").alias("bucket"), "id", "vector")
    found = neighbours.ranked(neighbours.met(one.where("id % 50 = 0"), one, 32, 5), 5).collect()
    truth = exact(rows)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found} == {(q, k + 1, i) for q, w in truth.items() for k, (i, _) in enumerate(w)}


def test_an_id_on_many_rows_takes_one_place(stored):
    random = np.random.default_rng(6)
    rows = [(i, random.normal(size=16).tolist(), 0) for i in range(60)]
    for q in (0, 50):  # an id on more than k rows beside each query
        rows += [(1000 + q, (np.array(rows[q][1]) + random.normal(size=16) / 50).tolist(), 0) for _ in range(20)]
        rows += [(2000 + q, rows[q][1], 0)] * 9
    one = np.array([v for _, v, _ in rows]), np.array([i for i, _, _ in rows])
    for q in (0, 50):
        _, near_ids, scores = neighbours.best(one[0][q : q + 1], one[1][q : q + 1], *one, 5)
        assert len(set(near_ids.tolist())) == 5 and near_ids.tolist()[:2] == [2000 + q, 1000 + q]
        assert near_ids.tolist() == [i for i, _ in exact([(i, v, 0) for i, v in zip(one[1].tolist(), one[0].tolist())])[q]]
    truth = exact(rows)
    got = neighbours.neighbours(stored(rows, VECTOR), F.col("id") % 50 == 0, recall=1.0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(q, n + 1, i) for q, w in truth.items() for n, (i, _) in enumerate(w)}


def test_what_the_fit_collects_hangs_on_no_id(stored, monkeypatch):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=8).tolist()) for i in range(400)] + [(401, random.normal(size=8).tolist()) for _ in range(200)]
    rows += [(402, rows[0][1])] * 200
    table = stored(rows, "vec_id long, embedding array<double>")
    most, own = [], neighbours.bucket

    def watched(matrix, *rest):
        most.append(len(matrix))
        return own(matrix, *rest)

    monkeypatch.setattr(neighbours, "bucket", watched)
    used = neighbours.usable(table)
    neighbours.fitted_probes(used.where("id % 5 = 0"), used, 4, 1, 0.9, 5)
    assert max(most) <= neighbours.SAMPLE * 5


def test_hot_buckets_meet_in_blocks_and_parts(stored):
    random = np.random.default_rng(4)
    rows = [(i, random.normal(size=4).tolist()) for i in range(150)] + [(1000, random.normal(size=4).tolist()) for _ in range(60)]
    used = neighbours.usable(stored(rows, "vec_id long, embedding array<double>"))
    one = used.select(F.lit(-1).alias("table"), F.lit(4).cast("long").alias("bucket"), "id", "vector")
    asked = one.where("id % 2 = 0")
    whole, cut = (neighbours.ranked(neighbours.met(asked, one, size, 5), 5).toPandas() for size in (10_000, 16))
    order = ["query_id", "rank"]
    assert whole.sort_values(order).values.tolist() == cut.sort_values(order).values.tolist() and len(whole) == 5 * 76


def test_ties_are_scored_in_bounded_memory():
    same, ids = np.ones((4000, 32)), np.arange(4000)
    tracemalloc.start()
    q, near_ids, scores = neighbours.best(same[:500], ids[:500], same, ids, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6  # all 2 million tied pairs at once are 512 MB for one side
    assert len(np.unique(scores)) == 1 and (np.bincount(q) == 5).all()
    assert near_ids.reshape(-1, 5).tolist() == [[i for i in range(6) if i != n][:5] for n in range(500)]


def test_few_or_no_vectors(stored):
    ask = F.col("id") % 50 == 0
    assert neighbours.neighbours(stored([], VECTOR, parts=1), ask).count() == 0
    assert neighbours.neighbours(stored([(0, [1.0, 2.0], 0)], VECTOR, parts=1), ask).count() == 0
    few = neighbours.neighbours(stored([(0, [1.0, 2.0], 0), (1, [2.0, 4.0], 0), (2, [2.0, -1.0], 0)], VECTOR, parts=1), ask)
    assert [(r["rank"], r["vec_id"]) for r in few.orderBy("rank").collect()] == [(1, 1), (2, 2)]


def shingles(text):
    w = [v for v in re.split("[ \t\n\r\f\v]+", (text or "").lower()) if v]
    return frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, min(1, len(w)))))


def linked(rows, least=0.8):
    """(class, copy, other sets, other documents) of each row, by going through all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    groups = collections.defaultdict(list)
    for k, s in enumerate(sets):
        groups[s if s else k].append(k)
    keys = [g for g in groups if not isinstance(g, int)]
    links = {g: [h for h in keys if h != g and len(g & h) >= least * len(g | h) - 1e-9] for g in keys}
    ids = lambda g: [rows[k][0] for k in groups[g] if rows[k][0] is not None]
    out = [None] * len(rows)
    for k, s in enumerate(sets):
        if not s:
            out[k] = (rows[k][0], rows[k][0], rows[k][0], 0, 0)
            continue
        seen, front = {s}, [s]
        while front:
            front = [h for g in front for h in links[g] if h not in seen]
            seen |= set(front)
        names = [i for g in seen for i in ids(g)]
        out[k] = (
            rows[k][0], min(names, default=None), min(ids(s), default=None), len(links[s]),
            sum(len(groups[h]) for h in links[s]) + len(groups[s]) - 1,
        )
    return sorted(out, key=str)


def shown(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "class_id", "copy_id", "n_texts", "n_links").collect()), key=str)


def near(text, changes, random):
    words = text.split()
    for at in random.choice(len(words), changes, replace=False):
        words[at] = f"new{random.integers(1_000_000)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(prose, odd_rows):
    """Exact copies, chains of near copies, a passage that many share, a dense group, pairs about the threshold."""
    random = np.random.default_rng(11)
    rows = list(odd_rows)
    for g in range(12):
        text = prose(120)
        rows += [document(1000 + 20 * g + c, near(text, c % 4, random)) for c in range(8)]
        rows += [document(1000 + 20 * g + 10 + c, text.upper() if c else text + "  \n") for c in range(3)]
    passage = prose(60)
    rows += [document(3000 + i, passage + " " + prose(60)) for i in range(150)]
    dense = prose(200)
    rows += [document(4000 + i, near(dense, 2, random)) for i in range(160)]
    rows += [document(5000 + i, prose(int(random.integers(1, 80)))) for i in range(100)]
    return rows


def test_near_copies_like_all_pairs(stored, copies):
    docs = stored(copies).withColumn("row", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("bucket", F.lit(2))
    wanted = linked(copies)
    assert shown(chosen_path.similar_classes(docs)) == wanted
    # small leaves and blocks: large and alike buckets, groups of several blocks
    small = chosen_path.BLOCK_SETS
    try:
        chosen_path.BLOCK_SETS = 40
        assert shown(chosen_path.similar_classes(docs, leaf=16)) == wanted
    finally:
        chosen_path.BLOCK_SETS = small
    kept = chosen_path.one_of_each(docs)
    assert kept.columns == docs.columns
    by_class = {}
    for i, c, _, _, n in wanted:
        if n:
            by_class[c] = i if i is not None and (by_class.get(c) is None or i < by_class[c]) else by_class.get(c)
    alone = [i for i, _, _, _, n in wanted if not n]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [*by_class.values(), *alone]))


def test_one_of_each_keeps_classes_of_one_id_apart(stored, prose):
    random = np.random.default_rng(12)
    a, b, c, d, e = (prose(100) for _ in range(5))
    rows = [document(None, a), document(None, near(a, 1, random)), document(None, b), document(None, b)]  # two classes without ids
    rows += [document(7, c), document(8, c), document(7, d), document(9, near(d, 1, random)), document(None, e)]  # one id in two
    docs = stored(rows)
    assert shown(chosen_path.similar_classes(docs)) == linked(rows)
    kept = [r["text"].split() for r in chosen_path.one_of_each(docs).collect()]
    near_to = lambda words, text: len(set(words) & set(text.split())) > 60
    assert sorted("".join(n for n, t in zip("abcde", (a, b, c, d, e)) if near_to(w, t)) for w in kept) == list("abcde")


def test_numbers_do_not_hang_on_splits(spark, stored, prose, monkeypatch):
    """As with executors that come or go, each write is followed by scans that are split in another way."""
    random = np.random.default_rng(13)
    texts = [prose(60) for _ in range(40)]
    rows = [document(i, t + f" password = hunter{i}secret") for i, t in enumerate(texts)]
    rows += [document(100 + i, near(t, 1, random)) for i, t in enumerate(texts)]
    docs = stored(rows)
    bag = lambda frame: sorted(map(str, frame.collect()))
    ask = ngram_model.is_held_out(F.col("doc_id"))
    hidden, rated = bag(secrets.masked(docs)), bag(ngram_model.scores(docs, ask).select("doc_id", "n_known", F.round("base_score", 6)))
    name, sizes = "spark.sql.files.maxPartitionBytes", itertools.cycle(["1k", "128m"])
    before, real = spark.conf.get(name), scratch.written

    def turning(df, label):
        out = real(df, label)
        spark.conf.set(name, next(sizes))
        return out

    for module in (scratch, chosen_path, secrets, ngram_model):
        monkeypatch.setattr(module, "written", turning)
    try:
        assert shown(chosen_path.similar_classes(docs)) == linked(rows)
        assert bag(secrets.masked(docs)) == hidden
        assert bag(ngram_model.scores(docs, ask).select("doc_id", "n_known", F.round("base_score", 6))) == rated
    finally:
        spark.conf.set(name, before)


def test_near_copies_of_nothing(stored):
    assert chosen_path.similar_classes(stored([], parts=1)).count() == 0
    assert chosen_path.one_of_each(stored([], parts=1)).count() == 0
    only = stored([document(1, None), document(1, None), document(2, "a b c d e f g")], parts=1)
    assert shown(chosen_path.similar_classes(only)) == [(1, 1, 1, 0, 0), (1, 1, 1, 0, 0), (2, 2, 2, 0, 0)]
    assert chosen_path.one_of_each(only).count() == 3


def test_runs_reach_the_recall():
    assert abs(chosen_path.survival() - 0.9375) < 1e-6
    assert chosen_path.runs_for(chosen_path.RECALL) == 5 and chosen_path.recall_of(5) > 0.99996
    # runs choose from one sample of tokens: the average over the number of shared ones, drawn here
    shared = np.random.default_rng(5).binomial(chosen_path.WIDTH, 0.8, 200_000) / chosen_path.WIDTH
    chance = {s: (1 - chosen_path.survival(s)) ** 3 for s in np.unique(shared)}
    assert abs(np.mean([chance[s] for s in shared]) / (1 - chosen_path.recall_of(3)) - 1) < 0.1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 45), max_size=80), st.lists(st.integers(0, 1 << 45), max_size=20))
def test_monotone(values, asked):
    values = np.sort(np.array(values, np.int64))
    both = np.array(asked + values.tolist() + (values + 1).tolist(), np.int64)
    sequence = Monotone.of(values)
    assert (sequence.at(np.arange(len(values))) == values.astype(np.uint64)).all()
    assert (sequence.successor(both) == np.searchsorted(values, both)).all()


def test_trie_finds_what_it_holds(tmp_path):
    random = np.random.default_rng(3)
    contexts = np.unique(random.integers(0, 1 << 40, 2000))
    sizes = random.integers(1, 9, len(contexts))
    words = np.concatenate([np.sort(random.choice(1000, s, replace=False)) for s in sizes])
    logs, weights = np.round(-random.random(len(words)), 2), np.round(-random.random(len(contexts)), 2)
    (tmp_path / "t").write_bytes(Trie.build(contexts, sizes, words, logs, weights))
    trie = Trie.over(np.memmap(tmp_path / "t", np.uint8, "r"))
    own = np.repeat(contexts, sizes)
    there, log, weight = trie.find(own, words)
    assert there.all() and np.abs(log - logs).max() <= 1 / 256 and np.abs(weight - np.repeat(weights, sizes)).max() <= 1 / 256
    held = set(zip(own.tolist(), words.tolist()))
    asked = random.integers(-1, 1000, len(own))
    there, _, _ = trie.find(own, asked)
    assert there.tolist() == [(c, w) in held for c, w in zip(own.tolist(), asked.tolist())]
    there, _, weight = trie.find(contexts + 1, np.zeros(len(contexts), np.int64))
    assert np.isnan(weight).tolist() == [c + 1 not in set(contexts.tolist()) for c in contexts.tolist()]


def test_codebook():
    codes, book = quantised(np.arange(10_000) / 1000)
    assert np.abs(book[codes] - np.arange(10_000) / 1000).max() < 0.03
    codes, book = quantised(np.array([1.0, 5.0, 1.0]))
    assert book[codes].tolist() == [1.0, 5.0, 1.0]
    codes, book = quantised(np.array([-2.5, -2.5]))
    assert book[codes].tolist() == [-2.5, -2.5]


def model_by_hand(rows, exact_counts):
    """Interpolated discounted pairs, without tables, shards or codebooks."""
    texts = [((t or "").encode().lower().split() + ["</s>"], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t, *_ in rows]
    one, two = collections.Counter(), collections.Counter()
    for w, held in texts:
        if not held:
            one.update(w)
            two.update(zip(["</s>", *w], w))
    total, kinds = sum(one.values()), len(one)
    cut = ngram_model.discounts(np.array(list(two.values()) or [0]))
    after = collections.defaultdict(list)
    for (v, _), n in two.items():
        after[v].append(n)
    out = []
    for (w, held), (i, *_) in zip(texts, rows):
        base = score = 0.0
        for v, x in zip(["</s>", *w], w):
            p = (one[x] + 1) / (total + kinds + 1)
            base += math.log10(p)
            if one[v]:
                d = sum(cut[min(n, 3) - 1] for n in after[v])
                n = two[(v, x)]
                p = ((n - cut[min(n, 3) - 1]) if n else 0) / one[v] + d / one[v] * p
            score += math.log10(p)
        out.append((i, held, len(w), sum(x in one for x in w), total, base, score))
    return out


def test_scores_like_a_model_by_hand(stored, prose, odd_rows):
    rows = [r for r in odd_rows if r[0] != 5] + [document(100 + i, prose(30 + i % 50)) for i in range(300)]
    docs = stored(rows).withColumn("chunk", F.lit("clash")).withColumn("score", F.lit("x"))
    got = ngram_model.scores(docs, ngram_model.is_held_out(F.col("doc_id"))).collect()
    wanted = model_by_hand(rows, True)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(got) == len(wanted)
    for g, w in zip(sorted(got, key=key), sorted(wanted, key=key)):
        assert tuple(g)[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
        # probabilities are bytes into codebooks; the rest of the model is the same
        assert abs(g[6] - w[6]) <= 0.02 * w[2], (g, w)


def test_probabilities_sum_to_one():
    random = np.random.default_rng(0)
    count = np.array([400, 90, 30, 9, 5, 3, 2, 2, 1, 1])
    steps = np.unique(count)[::-1]
    share = np.array([(count[p :: ngram_model.PARTS] + 1).sum() for p in range(ngram_model.PARTS)], float)
    share[0] += 1
    known = ngram_model.Counts(
        np.array([int((count > s).sum()) for s in steps]), steps, int(count.sum()), len(count), 1,
        share / (count.sum() + len(count) + 1), 1,
    )
    assert known.of(np.arange(10)).tolist() == count.tolist()
    tokens = random.integers(0, 10, int(count[0]))  # successors of word 0, which is a heavy context
    key = known.context(np.zeros(len(tokens), np.int64), tokens)
    pairs, times = np.unique(np.stack([key, tokens]), axis=1, return_counts=True)
    trie = Trie.over(np.frombuffer(ngram_model.trie_of(pairs[0], pairs[1], times, known), np.uint8))
    words = np.arange(-1, 10)
    there, log, weight = trie.find(known.context(np.zeros(11, np.int64), words), words)
    p = np.where(there, 10**log, 10 ** (weight + np.log10(known.unigram(words))))
    assert abs(p.sum() - 1) < 0.02


def test_cuts_and_shards_change_no_score(stored, prose, monkeypatch):
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 == 2]
    taught = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 != 2]
    # "always" is heavy and has one successor in training, others in held-out texts
    rows = [document(i, "always next " + prose(20)) for i in taught[:300]]
    rows += [document(i, f"always {prose(1)}") for i in held[:60]]
    docs = stored(rows)
    wanted = {w[0]: w for w in model_by_hand(rows, True)}
    for tokens in (2_000_000, 1500, 400):
        monkeypatch.setattr(ngram_model, "SHARD_TOKENS", tokens)
        for g in ngram_model.scores(docs, ngram_model.is_held_out(F.col("doc_id"))).collect():
            # codebooks round by a 256th of their range
            assert abs(g["score"] - wanted[g["doc_id"]][6]) <= 0.02 * g["n_tokens"], (tokens, g)


def test_no_training_text_and_empty_table(stored):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    docs = stored([document(i, "one two") for i in held])
    ask = ngram_model.is_held_out(F.col("doc_id"))
    got = ngram_model.scores(docs, ask).collect()
    assert [(r["n_known"], r["train_tokens"], r["score"]) for r in got] == [(0, 0, 0.0)] * 3
    assert ngram_model.scores(stored([], parts=1), ask).count() == 0


def test_packed_arrays_come_back_and_high_bytes_cost_little():
    random = np.random.default_rng(7)
    arrays = [random.integers(0, top, 5000) for top in (200, 60_000, 1 << 20, 1 << 31, (1 << 32) - 1, 1 << 62)]
    arrays += [np.zeros(0, np.int64), random.normal(size=300), np.array([2**64 - 1], np.uint64), np.arange(40)[::2]]
    blob = ngram_model.packed(*arrays)
    for narrow in (2, 4):
        for a, b in zip(arrays, ngram_model.unpacked(np.frombuffer(blob, np.uint8), narrow), strict=True):
            assert (b == (a.astype(np.int64) if a.dtype.kind == "u" else a)).all() and (b.dtype.kind == "f" or b.dtype in (np.int32, np.int64))
    assert [b.dtype == np.int32 for b in ngram_model.unpacked(blob)][:4] == [True, True, False, False]
    ids = random.integers(0, 1 << 17, 200_000)  # two bytes that vary, one that hardly does, one that never does
    plain = zstandard.ZstdCompressor(level=1).compress(ids.astype("<u4").tobytes())
    assert len(ngram_model.packed(ids)) < 0.9 * len(plain)


def test_rises_come_back():
    random = np.random.default_rng(8)
    sizes = random.integers(1, 6, 300)
    first = np.cumsum(sizes) - sizes
    values = np.concatenate([np.sort(random.integers(0, 1 << 40, n)) for n in sizes])
    steps = ngram_model.rises(values, first)
    assert (steps >= 0).all() and (ngram_model.risen(steps, sizes) == values).all()
    none = np.zeros(0, np.int64)
    assert len(ngram_model.risen(ngram_model.rises(none, none), none)) == 0


def test_words_of_a_chunk_are_coded_a_few_texts_at_a_time(prose, monkeypatch):
    texts = [None, "", "One one \t TWO", "É é"] + [prose(6000) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    words, offsets = words_of(pa.array([t or "" for t in texts]), pc.ascii_lower)
    codes, distinct = coded(words)
    seen = []
    monkeypatch.setattr(ngram_model, "words_of", lambda some, lower: seen.append(some.nbytes) or words_of(some, lower))
    got, listed, sizes = ngram_model.coded_words(batch)
    assert (got == codes).all() and listed.equals(distinct) and (sizes == np.diff(offsets)).all()
    assert batch.nbytes > 9 << 20 and max(seen) < 5 << 20


def test_texts_are_removed_once_the_shards_hold_them(spark, stored, prose, tmp_path, monkeypatch):
    """Texts are files that tasks read by their path (they are not shuffled); only tries are left when the scores are read."""
    docs = stored([document(i, prose(40)) for i in range(60)])
    made = []
    monkeypatch.setattr(ngram_model, "new_path", lambda _, label: made.append(f"{tmp_path}/{label}") or made[-1])
    got = ngram_model.scores(docs, ngram_model.is_held_out(F.col("doc_id"))).collect()
    assert len(got) == 60 and sorted(p.rsplit("/")[-1] for p in made) == ["texts", "tries"]
    assert [p.name for p in tmp_path.iterdir()] == ["tries"]
