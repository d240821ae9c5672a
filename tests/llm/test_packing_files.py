"""Token ids, packing and token files against plain encoding."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import packing, seekable
from millrace.llm.tokens import Encoder, vocabulary_path


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary_path())


def plain(encoder, text):
    return encoder.model.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t \x1cab'sé1.!<|>漢", max_size=30), min_size=1, max_size=6))
def test_encoder_like_library(encoder, texts):
    ids, offsets = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [plain(encoder, t) for t in texts]


def test_special_strings_are_text(encoder):
    ids, _ = encoder.encode(pa.array(["<|endoftext|>"]))
    assert 50256 not in ids.tolist()


def one_by_one(lengths, capacity, weights, measure):
    """Best fit for one piece after the other."""
    whole = np.array(capacity.filled(), float)
    bins, used = [], []
    for length in sorted(lengths, reverse=True):
        ask = np.array([length, 1, length**2])
        best = None
        for k, left in enumerate(bins):
            if (left >= ask).all():
                score = (
                    -(np.array(weights) * ((left - ask) / whole) ** 2).sum()
                    if measure == "norm"
                    else (np.array(weights) * (ask / whole) * (left / whole)).sum()
                )
                if best is None or score > best[0] + 1e-15:
                    best = (score, k)
        if best is None:
            bins.append(np.array(capacity.filled()))
            used.append([])
            best = (0, len(bins) - 1)
        bins[best[1]] = bins[best[1]] - ask
        used[best[1]].append(length)
    return sorted(map(tuple, used))


def planned(lengths, capacity, weights, measure):
    counts = {n: lengths.count(n) for n in set(lengths)}
    held = {}
    for length, _, many, to, at in packing.plan(counts, capacity, weights, measure).tolist():
        for k in range(many):
            held.setdefault(to + k, []).append((at, length))
    for parts in held.values():
        parts.sort()
        assert [at for at, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
    return sorted(tuple(n for _, n in parts) for parts in held.values())


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.integers(1, 30), max_size=60),
    st.sampled_from([packing.Capacity(32), packing.Capacity(32, 3), packing.Capacity(32, None, 950), packing.Capacity(40, 4, 1000)]),
    st.sampled_from(["norm", "dot"]),
)
def test_plan_is_best_fit(lengths, capacity, measure):
    weights = (1.0, 0.02, 0.02)
    got = planned(lengths, capacity, weights, measure)
    tokens, documents, attention = capacity.filled()
    for parts in got:
        assert sum(parts) <= tokens and len(parts) <= documents and sum(n * n for n in parts) <= attention
    assert sorted(n for parts in got for n in parts) == sorted(lengths)
    if measure == "norm":
        assert len(got) == len(one_by_one(lengths, capacity, weights, measure))


def test_plan_grows_with_lengths_not_with_pieces():
    small = packing.plan({n: 3 for n in range(1, 300)}, packing.Capacity(1024), (1, 0.02, 0.02), "norm")
    large = packing.plan({n: 3_000_000_000 for n in range(1, 300)}, packing.Capacity(1024), (1, 0.02, 0.02), "norm")
    assert len(large) < 20 * len(small)
    assert (large[:, 2].sum()) == 299 * 3_000_000_000


def test_piece_too_long_is_refused():
    with pytest.raises(ValueError):
        packing.plan({40: 1}, packing.Capacity(64, None, 1000), (1, 1, 1), "norm")


def test_pack_whole_documents(spark, stored, encoder, odd_rows, prose):
    rows = odd_rows + [(100 + i, prose(int(n)), "en", "s", 0) for i, n in enumerate(np.random.default_rng(3).integers(1, 900, 120))]
    docs = stored(rows).withColumn("sequence_id", F.lit("clash")).withColumn("_part", F.lit(1))
    got = packing.pack(docs, keep_ids=True).cache()
    pieces = got.toPandas()
    truth = sorted(((i is None, i or 0), plain(encoder, t) + [2]) for i, t, *_ in rows)
    own = {}
    for r in pieces.itertuples():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids) <= 1024
        assert r.piece == 0 or r.length == 1024
    assert pieces["length"].sum() == sum(len(ids) for _, ids in truth)
    for r in pieces.itertuples():
        own.setdefault(None if r.doc_id != r.doc_id else int(r.doc_id), []).append((r.start, tuple(r.ids)))
    for i, ids in own.items():
        wanted = sorted((a, tuple(w[a : b])) for _, w in [(k, v) for k, v in truth if k == (i is None, i or 0)]
                        for a, b in cuts(len(w)))
        assert sorted(ids) == wanted
    placed = pieces.sort_values(["sequence_id", "offset"])
    before = placed.groupby("sequence_id")["length"].cumsum() - placed["length"]
    assert (before == placed["offset"]).all() and placed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert pieces["sequence_id"].nunique() <= 1.02 * -(-pieces["length"].sum() // 1024) + 1
    whole = packing.sequences(got).toPandas()
    assert (whole["ids"].map(len) == whole["length"]).all() and whole["length"].sum() == pieces["length"].sum()


def cuts(n, longest=1024):
    head = n % longest or longest
    edges = [0, *range(head, n, longest), n]
    return list(zip(edges, edges[1:]))


def test_capacities_hold_on_rows(stored, prose):
    docs = stored([(i, prose(1 + i % 40), "en", "s", 0) for i in range(200)])
    got = packing.pack(docs, packing.Capacity(256, 4, 20_000)).toPandas()
    by = got.groupby("sequence_id")["length"]
    assert by.sum().max() <= 256 and by.count().max() <= 4 and by.agg(lambda x: (x * x).sum()).max() <= 20_000


def test_empty_table(stored):
    docs = stored([], parts=1)
    assert packing.pack(docs).count() == 0
    assert seekable.token_files_digest(docs.sparkSession, docs).count() == 0


def test_files_round_trip(spark, stored, encoder, odd_rows, prose, monkeypatch):
    rows = odd_rows + [(100 + i, prose(50 + i), "en", "s", 0) for i in range(80)]
    docs = stored(rows).withColumn("start", F.lit("clash"))
    manifest = seekable.write_token_files(docs)
    got = seekable.read_token_files(manifest).toPandas().sort_values("start")
    assert (got["start"] == got["n_tokens"].cumsum() - got["n_tokens"]).all()
    named = got["doc_id"].dropna()
    assert (named.diff().dropna() >= 0).all() and got["doc_id"].isna().iloc[0]
    wanted = sorted((i is None, i or 0, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))
                    for i, t, *_ in rows for p in [plain(encoder, t) + [2]])
    seen = sorted((r.doc_id != r.doc_id, 0 if r.doc_id != r.doc_id else int(r.doc_id), r.n_tokens, r.ids_crc32) for r in got.itertuples())
    assert seen == wanted
    some = {r["doc_id"]: r["ids"] for r in seekable.read_documents(manifest, [101, 120, 99999]).collect()}
    assert some == {i: plain(encoder, t) + [2] for i, t, *_ in rows if i in (101, 120)}


def test_only_asked_frames_are_read(tmp_path):
    from pyarrow import fs

    local = fs.LocalFileSystem()
    path = str(tmp_path / "f.zst")
    writer = seekable.Writer(local.open_output_stream(path, compression=None), 2)
    documents = [np.arange(n) % 50_000 for n in (5, 0, seekable.FRAME_IDS + 7, 100)]
    for i, ids in enumerate(documents):
        writer.add(i, ids)
    writer.close()
    reader = seekable.Reader(local.open_input_file(path))
    assert [reader.ids(k).tolist() for k in range(4)] == [d.tolist() for d in documents]
    assert len(reader.table) == 5
    data = bytearray(open(path, "rb").read())
    data[int(reader.offsets[3]) - 9] ^= 1  # in the second frame of document 2
    open(path, "wb").write(data)
    reader = seekable.Reader(local.open_input_file(path))
    assert reader.ids(3).tolist() == documents[3].tolist()
    with pytest.raises(Exception):
        reader.ids(2)


def test_any_zstandard_reader_reads_the_file(tmp_path):
    import zstandard
    from pyarrow import fs

    path = str(tmp_path / "f.zst")
    writer = seekable.Writer(fs.LocalFileSystem().open_output_stream(path, compression=None), 4)
    for i in range(3):
        writer.add(i, np.arange(i, i + 4))
    writer.close()
    with open(path, "rb") as file:
        plain_bytes = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert np.frombuffer(plain_bytes, "<u4").tolist() == [0, 1, 2, 3, 1, 2, 3, 4, 2, 3, 4, 5]
