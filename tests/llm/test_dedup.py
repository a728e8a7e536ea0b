import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusweave.llm import simhash, suffix_arrays
from corpusweave.llm.simhash import components, drop_near_duplicates, near_edges, simhash_groups, spanning_links
from corpusweave.llm.suffix_dedup import cover, drop_repeats, remove_repeats

SCHEMA = "doc_id bigint, text string, _id string, fp int, spans string, _row string"


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    base = words(1, 400)
    near = base[:200] + ["changed"] + base[201:]
    passage = " ".join(words(2, 150))
    rows = [
        (1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, " ".join(base)), (6, " ".join(base).upper()), (7, " ".join(near)),
        (8, " ".join(words(3, 60)) + " " + passage + " " + " ".join(words(4, 60))), (9, passage + " é end"), (10, passage + " è end"),
        (11, "ab" * 2000), (12, "x" * 399), (13, " ".join(words(5, 8000))), (14, " ".join(base)), (14, " ".join(base)),
        (None, "no id here"), (None, "no id here"), (None, "another without id"), (15, passage[:401] + "!"),
    ]
    return spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], SCHEMA).repartition(4)


def brute_print(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    own = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not own:
        return 0
    spans = [" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints, radius):
    roots = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and roots[i] != roots[j]:
                low, high = sorted((roots[i], roots[j]))
                roots = [low if r == high else r for r in roots]
    return roots


def test_groups_of_odd_texts(odd_docs):
    rows = simhash_groups(odd_docs).collect()
    source = odd_docs.collect()
    assert sorted((r.doc_id or -1, r.fingerprint) for r in rows) == sorted((r["doc_id"] or -1, f"{brute_print(r['text']):016x}") for r in source)
    prints = [brute_print(r["text"]) for r in source]
    roots = brute_roots(prints, 4)
    least = {}
    for r, root in zip(source, roots, strict=True):
        if r["doc_id"] is not None:
            least[root] = min(least.get(root, 1 << 60), r["doc_id"])
    want = sorted((r["doc_id"] or -1, least.get(root) or -1) for r, root in zip(source, roots, strict=True))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == want


def test_one_document_of_each_group_stays(odd_docs):
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    source = odd_docs.collect()
    groups = len(set(brute_roots([brute_print(r["text"]) for r in source], 4)))
    rows = kept.collect()
    assert len(rows) == groups
    assert {1, 5, 4} <= {r["doc_id"] for r in rows} and not {2, 3, 6, 14} & {r["doc_id"] for r in rows}


def test_different_texts_under_one_id_all_stay(spark):
    own = [" ".join(words(seed, 80)) for seed in (21, 22, 23)]
    rows = [(1, own[0]), (1, own[1]), (1, own[1]), (2, own[2]), (2, own[0])]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(map(tuple, kept)) == sorted([rows[0], rows[1], rows[3]])


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_split_shards_lose_no_link(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 62, 12, dtype=np.int64)
    prints = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) ^ (1 << int(z)) for b in base for x, y, z in rng.integers(0, 60, (25, 3))}
    frame = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    ordered = sorted(prints)
    want = brute_roots(ordered, radius)
    for size in (7, 16_384):
        found = {r.node: r.root for r in components(near_edges(frame, radius, size)).collect()}
        assert [ordered.index(found.get(p, p)) for p in ordered] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1023), min_size=1, max_size=60, unique=True), st.integers(0, 5))
def test_trees_find_all_links(values, radius):
    prints = np.array(sorted(values), np.uint64)
    buckets = np.zeros(len(prints), np.int64)
    a, b = simhash.Forest(prints, buckets).links(np.arange(len(prints)), radius)
    want = {(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    rows, roots = spanning_links(prints, buckets, radius)
    own = dict(zip(rows.tolist(), roots.tolist(), strict=True))
    assert [own.get(i, i) for i in range(len(prints))] == brute_roots([int(p) for p in prints], radius)


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(path + hub, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 200)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120), st.integers(1, 60))
def test_suffix_arrays_against_sorting(values, depth):
    data, raw = np.array(values, np.int64), bytes(v + 1 for v in values)
    order = suffix_arrays.suffix_array(data, depth)
    assert [raw[i : i + depth] for i in order] == sorted(raw[i : i + depth] for i in range(len(raw)))
    shared = suffix_arrays.common_prefixes(data, order, depth)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :][:depth], raw[order[k] :][:depth]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    queries = [list(q) for q in ([0, 1], [1, 1], [2, 0], [2, 2])]
    full = suffix_arrays.suffix_array(data, max(depth, 2))
    found = suffix_arrays.find(data, full, np.array(queries)) if len(data) else []
    for q, hit in zip(queries, found, strict=False):
        assert hit == (bytes(v + 1 for v in q) in raw)


def brute_removed(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        covered = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        yield np.cumsum(covered)[:-1] > 0


def results(texts, length):
    for text, gone in zip(texts, brute_removed(texts, length), strict=True):
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        yield len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("settings_", [{}, {"shard_bytes": 4_000}, {"split_contexts": 1}, {"length": 60, "anchor": 20, "split_contexts": 3, "shard_bytes": 2_000}])
def test_repeats_of_odd_texts(odd_docs, settings_):
    rows = remove_repeats(odd_docs, digest=True, **settings_).collect()
    source = odd_docs.collect()
    want = results([(r["text"] or "").encode() for r in source], settings_.get("length", 400))
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert got == sorted((r["doc_id"] or -1, *w) for r, w in zip(source, want, strict=True))


def test_kept_bytes_are_given_as_text(odd_docs):
    rows = remove_repeats(odd_docs).collect()
    assert all(r.text == bytes(r.kept).decode(errors="ignore") for r in rows) and any(r.n_removed for r in rows)


def kept_words(texts, length):
    """The words of each text that no repeated run of ``length`` words covers."""
    own = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in own for i in range(len(w) - length + 1))
    for w in own:
        gone = {i + k for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for k in range(length)}
        yield [x for i, x in enumerate(w) if i not in gone]


@pytest.mark.parametrize("settings_", [{}, {"words": 7, "split_contexts": 2, "shard_bytes": 2_000}])
def test_passages_are_cut_out_of_whole_rows(odd_docs, settings_):
    rows = drop_repeats(odd_docs, **settings_)
    assert rows.columns == odd_docs.columns
    source = odd_docs.collect()
    want = [(r["doc_id"] or -1, k) for r, k in zip(source, kept_words([r["text"] for r in source], settings_.get("words", 50)), strict=True)]
    got = rows.collect()
    assert sorted((r["doc_id"] or -1, (r["text"] or "").split()) for r in got) == sorted(want)
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[1] is None and texts[2] == "" and texts[12] == "x" * 399
    assert texts[13] == next(r["text"] for r in source if r["doc_id"] == 13)


def test_short_words_and_other_spaces_make_passages_too(spark):
    shared = [f"{a}{b}" for a in "abcdefg" for b in "uvwxyz"] + list("stopwhen")  # 50 words and more, under 200 bytes
    rows = [(1, "one two " + " ".join(shared) + " end"), (2, "\n".join(shared) + "\tlast words"), (3, " ".join(shared[:49])), (4, "all of its own")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert len(shared) >= 50 > 49 and {r.doc_id: r.text for r in drop_repeats(frame).collect()} == {1: "one two end", 2: "last words", 3: rows[2][1], 4: rows[3][1]}


def test_no_passage_of_another_document_is_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    source = docs.collect()
    want = dict(zip([r.doc_id for r in source], kept_words([r.text for r in source], 50), strict=True))
    assert sum(len(k) < len((r.text or "").split()) for r, k in zip(source, want.values(), strict=True)) > 5
    assert {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in drop_repeats(docs).collect()} == want


@pytest.mark.parametrize("settings_", [{}, {"passage_words": 7, "split_contexts": 2, "shard_bytes": 2_000}])
def test_repeated_passages_under_400_bytes_are_counted_and_stay(spark, odd_docs, settings_):
    settings_ = {"passage_words": 50, **settings_}
    short = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz1")  # 56 words, 167 bytes
    planted = spark.createDataFrame([(20, "its own start " + short), (21, short.replace(" ", "\n") + " another end")], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text").union(planted)
    source = docs.collect()
    texts = [r["text"] or "" for r in source]
    kept = kept_words(texts, settings_["passage_words"])
    repeated = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) - len(k) for t, k in zip(texts, kept, strict=True)]
    got = remove_repeats(docs, digest=True, **settings_).collect()
    want = results([t.encode() for t in texts], 400)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in got) == sorted(
        (r["doc_id"] or -1, *w, n) for r, w, n in zip(source, want, repeated, strict=True)
    )
    assert {r.doc_id: (r.n_removed, r.n_passage_words) for r in got if r.doc_id in (20, 21)} == {20: (0, 56), 21: (0, 56)}


def test_cover_joins_touching_ranges():
    assert cover([{"first": 5, "end": 9}, {"first": 0, "end": 5}, {"first": 12, "end": 13}]) == [(0, 9), (12, 13)]
    assert cover([]) == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash_groups(none).count() == 0
    assert drop_near_duplicates(none).count() == 0
    assert remove_repeats(none).count() == 0
    assert drop_repeats(none).count() == 0
