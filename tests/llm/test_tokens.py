import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from lexlake.llm import packing, token_binary, token_counts
from lexlake.llm.tokens import COMMON_CHARS, Encoder, as_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n_tokens string, block long"
TEXTS = ["", None, "one two  three\n\n x", "<|endoftext|>a<|endoftext|>", "ünï ¼ ٣ 中文 \x1c  a", "same", "same", "word " * 40_000, " don't we'll\t\tgo "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", "clash", 7), (3, "again", "clash", 7)]
    return spark.createDataFrame(rows, DOCS)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ours():
    return Encoder(open(PATH, "rb").read(), as_bytes, b"".join)


COMMON = [c for r in (range(32, 592), range(0x391, 0x3CF), range(0x410, 0x450), range(0x2010, 0x2028), (9, 10, 13, 0x20AC)) for c in map(chr, r) if __import__("re").match(f"[{COMMON_CHARS}]", c)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40), st.text(alphabet=COMMON, max_size=60), st.text(alphabet=" \n\tab1'.s", max_size=60)))
def test_encoder_equals_library(ours, library, text):
    assert ours.plain and ours(text) == as_bytes(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["\n" * 1_000_000 + "a", " " * 1_000_000, "x" * 300_000, "ab 12 " * 60_000, "word\n\n" * 50_000 + " " * 500, ""])
def test_long_and_empty_texts(ours, library, text):
    want = as_bytes(library.encode(text, add_special_tokens=False).ids)
    assert ours(text) == want and ours(text, {"word": b"?"} if "word" not in text else {}) == want
    assert max(map(len, ours.known), default=0) <= 200


def test_other_files_go_to_their_library():
    e = Encoder(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read(), list, lambda x: sum(x, []))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert not e.plain and e("Some Words here") == t.encode("Some Words here", add_special_tokens=False).ids


@pytest.mark.parametrize("space", ["\n", " "])
def test_long_white_space_through_spark(spark, library, space):
    text = space * 1_000_000 + "a"
    rows = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    n = len(ids_of(library, text))
    assert {r.doc_id: r.n_tokens for r in token_binary.token_binary(rows, PATH).collect()} == {1: n + 1, 2: 1}
    assert sum(r.length for r in packing.pack_documents(rows, PATH).collect()) == n + 2
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows, PATH).collect()} == {1: n, 2: 0}


def test_counts(spark, docs, library):
    rows = token_counts.count_tokens(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((str(i), len((t or "").encode()), n := len(ids_of(library, t)), n > 1024) for i, t, *_ in docs.collect())
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_counts_by_pieces(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {(i, len((t or "").encode())): len(model.encode(t or "")) for i, t, *_ in docs.collect()}


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    ids = np.random.default_rng(1).integers(0, 50_257, 1_000, np.uint32)
    for x in (ids, np.zeros(3, np.uint32), np.array([2**32 - 1, 0], np.uint32)):
        assert (token_binary.from_planes(token_binary.to_planes(x, kind), len(x), kind) == x).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_binary_round_trip(spark, docs, library, kind):
    rows = token_binary.token_binary(docs, PATH, kind=kind, block=64, file_tokens=500).collect()
    start, want = 0, []
    for i, _, t in sorted(((r.doc_id, r.h, r.t) for r in docs.withColumn("t", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("t")).collect()), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])):
        ids = np.array([*ids_of(library, t), 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert token_binary.token_binary(docs.limit(0), PATH).collect() == []


def test_cut_file_is_refused(tmp_path):
    f = token_binary.PlaneFile(f"file://{tmp_path}/a.bps", 8, "bit")
    f.add(1, np.arange(20, dtype=np.uint32))
    f.close()
    data = (tmp_path / "a.bps").read_bytes()
    (tmp_path / "b.bps").write_bytes(data[:-3])
    with pytest.raises((ValueError, OSError)):
        list(token_binary.documents_of(f"file://{tmp_path}/b.bps"))
    assert json.dumps([len(p) for _, _, p in token_binary.documents_of(f"file://{tmp_path}/a.bps")])


def test_packing(spark, docs, library):
    rows = packing.pack_documents(docs, PATH, with_ids=True).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(library, t)) + 1 for _, t, *_ in docs.collect())
    by = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    pieces = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 7)
    assert pieces[0][2] < 2048 and all(p[2] == 2048 for p in pieces[1:]) and all(a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_local_search_keeps_items_and_never_adds_bins(sizes):
    plain = packing.Bins(sizes, 40)
    plain.best_fit()
    packed = packing.pack_sizes(sizes, 40)
    assert sorted(i for b in packed for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 40 for b in packed)
    assert -(-sum(sizes) // 40) <= len(packed) <= len(plain.items)


def optimum(sizes, capacity):
    """The fewest bins, by trying all ways."""
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[k]}:
            at = rooms.index(room)
            go(k + 1, rooms[:at] + [room - sizes[k]] + rooms[at + 1 :])
        go(k + 1, rooms + [capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_close_to_the_optimum(sizes):
    assert optimum(sizes, 20) <= len(packing.pack_sizes(sizes, 20)) <= optimum(sizes, 20) + 1


def test_fill_of_a_hard_shard():
    """Lengths for which best fit alone leaves more than a bin in a hundred too many."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(300, 1_100, 3_000).tolist()
    plain = packing.Bins(sizes, 2048)
    plain.best_fit()
    packed = packing.pack_sizes(sizes, 2048)
    assert len(packed) <= len(plain.items) and len(packed) <= 1.02 * -(-sum(sizes) // 2048)


def test_local_search_empties_bins():
    # best fit leaves 3 bins of (6, 3), (5, 4), (2); an exchange makes two full ones
    assert len(packing.pack_sizes([6, 5, 4, 3, 2], 10)) == 2
