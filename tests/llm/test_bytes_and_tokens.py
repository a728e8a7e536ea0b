import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusweave.llm import byte_bpe, bytehash, bytepairs, token_counts, token_files
from corpusweave.llm.byte_bpe import decode_bytes, encode_bytes
from corpusweave.llm.token_counts import count_tokens
from corpusweave.llm.token_files import read_token_files, write_token_files

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", " ", "\n\n  \t", "a", "don't we'll I'M", "x" * 3000, " " * 5000 + "end", "é" * 40, "日本語 text　and\xa0more",
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "tab\tand\r\nlines  \n  ", "\x1c\x1d", "123 456,789", "🙂🙃 🙂", "՘  x",
]
SCHEMA = "doc_id bigint, text string, ids string, place int, _text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def encoding():
    ranks = bytepairs.read_ranks(open(RANKS, "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(ODD)]
    long = " ".join(f"word{i}" for i in range(4000))
    rows += [(None, "no id", "x", 1, "y"), (90, None, None, None, None), (91, "twice", "x", 1, "y"), (91, "twice", "x", 1, "y"), (92, long, "x", 1, "y"), (92, long, "x", 1, "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _sha(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_rank_file_reader():
    line = base64.b64encode(b"ab") + b" 7\n"
    assert bytepairs.read_ranks(line + b"\n") == {b"ab": 7}


def test_merge_takes_lowest_rank_then_leftmost():
    ranks = {("a", "a"): (0, "aa"), ("aa", "a"): (1, "aaa")}
    assert bytepairs.merge(list("aaa"), lambda x, y: ranks.get((x, y))) == (["aaa"], 2)
    assert bytepairs.merge([], lambda x, y: None) == ([], 0)
    assert bytepairs.merge(["a"], lambda x, y: None) == (["a"], 0)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counts_equal_the_library(text):
    library, counts = test_counts_equal_the_library.tools
    assert counts.text(text) == len(library.encode(text, add_special_tokens=False).ids)


test_counts_equal_the_library.tools = (Tokenizer.from_file(JSON), token_counts.UnitCounts(open(JSON, encoding="utf-8").read()))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab '\n\t\xa0é1.sl　日")), max_size=80), st.integers(4, 12), st.integers(0, 3))
def test_stitching_equals_one_pass(text, advance, overlap):
    places = range(max(1, -(-len(text) // advance)))
    chunks = [text[i * advance : i * advance + advance + overlap] for i in places]
    bounds = [byte_bpe.boundaries(c, i == len(places) - 1) for i, c in enumerate(chunks)]
    whole, sure = byte_bpe.stitch(chunks, bounds, advance)
    assert whole == text
    assert sure.tolist() == byte_bpe.boundaries(text, True).tolist()


def test_short_and_heap_merges_agree():
    ranks = bytepairs.read_ranks(open(RANKS, "rb").read())

    def join(a, b):
        rank = ranks.get(a + b)
        return None if rank is None else (rank, a + b)

    for piece in ("therheneed", "ciónmenteía", "aaaaaaaaaaaaab", "....!!!!", "日本語"):
        raw = piece.encode()
        heap = [ranks[s] for s in bytepairs.merge([raw[i : i + 1] for i in range(len(raw))], join)[0]]
        assert bytepairs.merge_short(raw, ranks) == heap


def test_token_counts_of_odd_texts(odd_docs, library):
    rows = count_tokens(odd_docs, JSON).collect()
    assert len(rows) == odd_docs.count()
    texts = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    want = sorted((d or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in texts)
    assert sorted({(r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows}) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)


@pytest.mark.parametrize("chunk,overlap", [(16_384, 1_024), (64, 8), (50, 0)])
def test_encoding_of_odd_texts(odd_docs, encoding, chunk, overlap):
    rows = encode_bytes(odd_docs, RANKS, digest=True, chunk=chunk, overlap=overlap).collect()
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    want = []
    for r in odd_docs.collect():
        ids = encoding.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"] or -1, len(ids), _sha(ids), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_decoding_round_trip(odd_docs):
    coded = encode_bytes(odd_docs.where("doc_id < 20"), RANKS)
    back = {r.doc_id: bytes(r.decoded) for r in decode_bytes(coded, RANKS).collect()}
    assert back == {i: t.encode() for i, t in enumerate(ODD)}


def test_value_codes_round_trip():
    values = np.array([0, 255, 256, 65_535, 65_536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        control, data = token_files.pack_values(values[:n])
        assert len(control) == -(-n // 4)
        assert token_files.unpack_values(control, data, n).tolist() == values[:n].tolist()


@pytest.mark.parametrize("block", [1 << 19, 50])
def test_token_files_of_odd_texts(spark, odd_docs, library, tmp_path, block):
    path = str(tmp_path / "files")
    write_token_files(odd_docs, path, JSON, block_tokens=block)
    rows = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids) and len(rows) == odd_docs.count()
    texts = {-1 if r["doc_id"] is None else r["doc_id"]: r["text"] for r in odd_docs.collect()}
    start = 0
    for doc, row in zip(ids, rows, strict=True):
        want = library.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        assert (row.start, row.n_tokens) == (start, len(want))
        assert zlib.crc32(bytes(row.ids)) == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    counts = spark.read.parquet(f"{path}/vocabulary").orderBy("rank").toPandas()
    assert counts["count"].is_monotonic_decreasing and counts["count"].sum() == start


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert count_tokens(none, JSON).count() == 0
    assert encode_bytes(none, RANKS).count() == 0
    write_token_files(none, str(tmp_path / "none"), JSON)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_span_hashes_do_not_depend_on_the_place():
    data = np.frombuffer(b"xxhello--hello", np.uint8)
    sums = bytehash.prefix_sums(data)
    a, b = bytehash.span_hashes(sums, np.array([2, 9]), np.array([7, 14]))
    assert a == b
    values = np.random.default_rng(3).integers(0, 50, 40).astype(np.uint64)
    for width in (1, 3, 40, 41):
        want = [values[i : i + width].min() for i in range(len(values) - width + 1)]
        assert bytehash.sliding_min(values, width).tolist() == want


def test_text_bytes_of_slices_and_nulls():
    column = pa.array(["ab", None, "", "é"]).slice(1)
    data, offsets = bytehash.text_bytes(column)
    assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 0, 2]
    assert list(bytehash.slices(np.array([0, 5, 6, 20]), 6)) == [(0, 2), (2, 3)]


def test_units_are_encoded_together(library):
    """New words take one call of the library for many of them, and get the ids they have by themselves."""
    coder = token_files.UnitIds(open(JSON, encoding="utf-8").read())
    strings, inner = [], coder.library

    class Counted:
        def encode_batch_fast(self, texts, **options):
            strings.extend(texts)
            return inner.encode_batch_fast(texts, **options)

    coder.library = Counted()
    words = [f" w{i}é日x{i * i}" for i in range(1_000)] + [" don't", " ''s", " \x1c", " ", "\n", "first", " " + "long" * 40, " 🙂s", "  "]
    found = coder.encode_units(words)
    assert len(strings) <= 1_000 // token_files.JOINT_UNITS + 10
    ids = {w: inner.encode(w, add_special_tokens=False).ids for w in words}
    assert {w: np.frombuffer(x, coder.kind).tolist() for w, x in found.items()} == ids
    coder.sizes = np.ones_like(coder.sizes)  # ends that do not meet: each unit by itself
    assert {w: np.frombuffer(x, coder.kind).tolist() for w, x in coder.encode_units(words).items()} == ids
