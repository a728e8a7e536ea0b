import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from corpusweave.llm import queries
from corpusweave.llm.conversation_trie import prefix_trie
from corpusweave.llm.euler_tour import rank_list, subtree_sums, tour_arcs
from corpusweave.llm.language_id import UNKNOWN, WIDTHS, ByteNetwork, detect_language, fit_languages, in_windows
from corpusweave.llm.periodic_runs import find_runs, periodic_runs, word_codes

WORD = r"[^\x20\x09-\x0D]+"


def trie_by_hand(rows, splice=False):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), tie, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, mine in turns.items():
        if splice:
            h = zlib.crc32(str(c).encode()) % 4
            mine = turns.get(c - c % 20, [])[:h] + mine[h:]
        for d in range(len(mine) + 1):
            members[tuple(mine[:d])].append(c)
        ends[tuple(mine)].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(WORD, path[-1][1])) if path else 0
        below = [sums[c] for c in children[path]]
        leaves = sum(b[0] for b in below) if below else 1
        sums[path] = (leaves, sum(b[1] for b in below) + (len(members[path]) - 1) * words)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *sums[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def as_rows(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    rows = [(c, i, "user", rng.choice(["hi there", "yes no", "", "a b c"])) for c in range(70) for i in range(rng.randint(1, 5))]
    rows += [(1000, i, "bot", f"turn {i} of many") for i in range(120)]  # most rows are one conversation's
    rows += [(1001, i, "bot", f"turn {i} of many") for i in range(40)]
    rows += [(200 + c, 0, "user", f"first {c}") for c in range(40)]  # the root has very many children
    rows += [(300, None, None, "later known"), (300, 0, "user", None), (300, None, "user", "x"), (300, 1, None, None)]
    rows += [(301, 5, "user", "same"), (301, 5, "user", "same"), (302, 5, "user", "same"), (303, 1, "ab", "c"), (304, 1, "a", "bc")]
    rows += [(None, 0, "user", "nobody's"), (305, 0, "user", "w " * 30_000)]
    return rows


@pytest.mark.parametrize("splice", [False, True])
def test_trie_equals_hand_made_one(spark, talks, splice):
    frame = spark.createDataFrame([(*r, 1, "k") for r in talks], "conv_id long, turn long, role string, text string, depth int, id string").repartition(5)
    conv = F.col("conv")
    how = {"base": conv - conv % 20, "skip": F.crc32(conv.cast("string")) % 4} if splice else {}
    assert as_rows(prefix_trie(frame, few=120, split=8, **how)) == trie_by_hand(talks, splice)


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(frame).collect() == []


def test_list_ranking_and_subtree_sums(spark):
    rng = np.random.default_rng(3)
    order = rng.permutation(500)
    arcs = [(int(a), int(order[i - 1]) if i else None, int(order[i + 1]) if i < 499 else None) for i, a in enumerate(order)]
    table = spark.createDataFrame(arcs, "id long, pred long, succ long").repartition(3)
    assert {r["id"]: r["pos"] for r in rank_list(table, few=10).collect()} == {int(a): i for i, a in enumerate(order)}
    parents = [None] + [int(rng.integers(0, max(1, i // 3))) for i in range(1, 300)]
    total = np.arange(300) * 7 % 11
    for i in range(299, 0, -1):
        total[parents[i]] += total[i]
    counts = np.bincount([p for p in parents if p is not None], minlength=300)
    nodes = spark.createDataFrame([(i, p, int(counts[i]), i * 7 % 11) for i, p in enumerate(parents)], "id long, parent long, n_children long, v long")
    for few, split, block in ((120, 3, 7), (1_000, 1_000, 1_000)):
        assert {r["id"]: r["v"] for r in subtree_sums(nodes, ["v"], few, split, block).collect()} == dict(enumerate(total.tolist()))
    both = tour_arcs(nodes, 3).collect()
    assert sorted(r["id"] for r in both) == list(range(600)) and sum(r["succ"] is None for r in both) == 1


def runs_by_hand(words, least=6):
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 4 * q):
                piece = words[i : j + q]
                if not any(piece[p:] == piece[:-p] for p in range(1, q)):
                    found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(11)
    texts = [[rng.choice("ab") for _ in range(rng.randint(0, 90))] for _ in range(150)]
    for _ in range(120):
        alphabet = "abcdefgh"[: rng.randint(1, 8)]
        unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.4:  # a period that itself holds highly periodic parts
            unit += [rng.choice(alphabet)] * rng.randint(5, 60)
        middle = (unit * rng.randint(2, 7))[: rng.randint(1, 500)]
        sides = [[rng.choice(alphabet) for _ in range(rng.randint(0, 40))] for _ in range(2)]
        texts.append(sides[0] + middle + sides[1])
    word = ["a"]
    for _ in range(8):
        word = word + word + ["b"] + word[: len(word) // 2]
    texts += [word[:1500], ["x"] * 700, list("ab" * 300 + "c" + "ab" * 300) * 4]
    words = pa.array([" ".join(t) for t in texts])
    _, codes, offsets = word_codes(words)
    found = find_runs(codes, offsets)
    for i, text in enumerate(texts):
        assert [tuple(r) for r in found[found[:, 0] == i][:, 1:].tolist()] == runs_by_hand(text), i


def described(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), [tuple(r) for r in runs], kept


def test_runs_of_odd_texts(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a a a a a"), (5, " a a a a a a\x0b"), (6, "é\xa0x y\x1fz " * 9), (6, "é\xa0x y\x1fz " * 9),
        (None, "one two " * 5), (7, " ".join(f"w{i % 977}" for i in range(30_000))), (8, "a b a b a b a b a b c d d d d d d d d a b a b a b a b"),
    ]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, runs string, start int").repartition(3)
    got = sorted((r["doc_id"] or 0, r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(frame).collect())
    want = []
    for doc, text in rows:
        words = re.findall(WORD, text or "")
        runs = runs_by_hand(words) if len(words) < 1_000 else [(0, 30_000, 977)]
        want.append((doc or 0, *described(words, runs)))
    assert str(got) == str(sorted(want, key=str)) or got == sorted(want)
    assert periodic_runs(frame.limit(0)).collect() == []


def test_runs_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    for row in docs.select("doc_id", "text").collect():
        words = re.findall(WORD, row["text"] or "")
        h = zlib.crc32(str(row["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        if n > 700:
            continue  # the search by hand is quadratic
        count, start, length, period, milli, runs, kept = described(words, runs_by_hand(words))
        own = got[row["doc_id"]]
        assert (own["n_runs"], own["start"], own["length"], own["period"], own["exponent_milli"]) == (count, start, length, period, milli)
        assert own["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert own["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_network_gradients():
    rng = np.random.default_rng(1)
    network = ByteNetwork.fresh(["a", "b", "c"])
    network.params = [p.astype(np.float64) for p in network.params]
    windows, labels, weights = rng.integers(0, 256, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.array([1.0, 2, 1, 1, 3])

    def loss():
        odds = network.softmax(network.pooled(windows, network.tables())[0])
        return -(weights * np.log(odds[np.arange(5), labels])).sum() / weights.sum()

    for p, g in zip(network.params, network.gradients(windows, labels, weights), strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            p[at] += 1e-6
            up = loss()
            p[at] -= 2e-6
            assert (up - loss()) / 2e-6 == pytest.approx(g[at], abs=2e-4)
            p[at] += 1e-6


def test_windows_cover_whole_texts():
    texts = [b"", b"abc", bytes(range(256)) * 2, b"x" * 257]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    windows, row, filled = in_windows(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, text in enumerate(texts):
        assert b"".join(w[:n].tobytes() for w, n, r in zip(windows, filled, row, strict=True) if r == i) == text
    assert max(WIDTHS) < windows.shape[1]


@pytest.fixture(scope="module")
def network(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return fit_languages(docs.where(~queries.held_out()))


def test_languages_of_unseen_texts(spark, network):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(queries.held_out())
    rows = detect_language(docs, network, ["doc_id", "lang"]).collect()
    assert len(rows) == docs.count() > 300
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_texts(spark, network):
    german = "Der die und nicht mit einer für über das ist schön und möglich. "
    rows = [(1, None), (2, ""), (3, " \n 123 !?"), (4, german), (None, german), (4, german), (5, german * 9_000), (6, "ж"), (7, "x")]
    frame = spark.createDataFrame([(*r, "b", 0.5) for r in rows], "doc_id long, text string, lang_pred2 string, score2 double").repartition(3)
    got = sorted(((r["doc_id"] or 0), r["lang_pred"], r["score"]) for r in detect_language(frame, network, ["doc_id", "lang_pred2"]).collect())
    assert [g[1:] for g in got if g[0] in (1, 2, 3)] == [(UNKNOWN, 0.0)] * 3
    assert {g[1] for g in got if g[0] in (0, 4, 5)} == {"de"} and len(got) == 9
    assert all(g[1] in network.languages and 0 < g[2] <= 1 for g in got if g[0] in (6, 7))
    assert detect_language(frame.limit(0), network, ["doc_id"]).collect() == []


def test_languages_without_labels(spark):
    frame = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    rows = detect_language(frame, fit_languages(frame), ["doc_id"]).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [(UNKNOWN, 0.0)]
