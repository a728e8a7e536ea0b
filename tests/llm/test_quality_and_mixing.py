import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusweave.llm.bytehash import text_bytes
from corpusweave.llm.mixing import MOST, mix_sources, repeat_to_weights, source_targets
from corpusweave.llm.quality_classifier import FtrlModel, fit_quality, hashed_ngrams, held_out, score_quality
from corpusweave.llm.quality_rules import BUCKETS, PRIOR, THRESHOLD, quality_rules

SMALL = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, text string, source string, n_words string, _words int, size string, k int"
LONG = " ".join(f"w{i % 97}" for i in range(20_000))
ODD = [
    (1, None, "a"), (2, "", None), (3, " \n\n ", "b"), (4, "one", "a"), (5, "a a a a a", "b"), (6, "x y z\nx y z\n\nx y z", "a"),
    (7, "tags <b> & #1 $ % | *", "c"), (8, "é à\xa0ü\x1fz", "c"), (9, LONG, "a"), (10, " ".join(f"u{i}" for i in range(60)), None),
    (None, "no id", "b"), (11, "same text twice", "b"), (11, "same text twice", "b"),
]


@pytest.fixture(scope="module")
def odd_docs(spark):
    return spark.createDataFrame([(*r, "n", 1, "s", 2) for r in ODD], SCHEMA).repartition(3)


def base_of(text):
    text = text or ""
    own = re.findall(WORD, text)
    windows = Counter(zip(own, own[1:], own[2:], strict=False))
    covered = {i + k for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def grams_of(text):
    codes = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in re.findall(WORD, text or "")]
    return [c % BUCKETS for c in codes] + [(a * 31 + b * 17 + 7) % BUCKETS for a, b in zip(codes, codes[1:], strict=False)]


@pytest.mark.parametrize("trusted", [[10, 9], [], [999]])
def test_quality_rules_of_odd_texts(spark, odd_docs, trusted):
    ids = spark.createDataFrame([(t,) for t in [*trusted, *trusted, None]], "doc_id bigint")
    rows = quality_rules(odd_docs, ids).collect()
    raw, target = Counter(), Counter()
    for doc, text, _ in ODD:
        raw.update(grams_of(text))
        if doc in trusted:
            target.update(grams_of(text))
    n_raw, n_target = sum(raw.values()) + BUCKETS, sum(target.values())

    def ratio(g):
        p = (raw[g] + 1) / n_raw
        return round((math.log((target[g] + PRIOR * p) / (n_target + PRIOR)) - math.log(p)) * 1e6)

    want = []
    for doc, text, source in ODD:
        base, grams = base_of(text), grams_of(text)
        score = sum(map(ratio, grams))
        want.append((doc or -1, *base, len(grams), score, not base[5] and score >= len(grams) * round(THRESHOLD * 1e6), source or ""))
    got = [
        (r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_grams, r.score_sum, r.kept, r.source or "")
        for r in rows
    ]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:8] == b[:8] and a[9:] == b[9:] and abs(a[8] - b[8]) <= b[7] // 1000  # a half may round either way
    assert "_words" in rows[0].asDict() and rows[0]["_words"] == 1


def test_quality_rules_part_junk_from_prose(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules(docs, labels.where("quality = 1").select("doc_id")).where("n_words >= 50").join(labels, "doc_id").collect()
    clean, junk = [r.kept for r in rows if r.quality and not r.base_failed], [r.kept for r in rows if not r.quality]
    assert all(clean) and np.mean(junk) < 0.3


def test_a_filter_on_kept_is_not_moved_below_the_arrays(spark, odd_docs):
    plan = quality_rules(odd_docs, odd_docs.select("doc_id")).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 4


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    size = np.array([sizes[n] for n in names], float)
    weight = np.array([(5, 2, 1)[i % 3] for i in range(len(names))], float)
    full = np.zeros(len(names), bool)
    while True:
        target = np.where(full, 3 * size, 0.0)
        if not full.all():
            target[~full] = (size.sum() - target.sum()) * weight[~full] / weight[~full].sum()
        now = full | (target > 3 * size)
        if (now == full).all():
            return dict(zip(names, target, strict=True))
        full = now


def test_mix_of_odd_texts(odd_docs):
    rows = mix_sources(odd_docs).collect()
    assert len(rows) == len(ODD)
    sizes = defaultdict(int)
    for _, text, source in ODD:
        sizes[source] += len(re.findall(WORD, text or ""))
    want = sorted((d or -1, len(re.findall(WORD, t or "")), sizes[s]) for d, t, s in ODD)
    assert sorted((r.doc_id or -1, r["size"], r.source_size) for r in rows) == want
    targets = brute_targets(sizes)
    by_id = {d: s for d, _, s in ODD}
    for r in rows:
        assert r.target == pytest.approx(targets[by_id[r.doc_id]])
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= MOST


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 0, None: 7}, {"x": 3, "y": 3, "z": 0, "w": 500}])
def test_targets_against_resharing(spark, sizes):
    rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size bigint")).collect()
    assert {r.source: r.target for r in rows} == pytest.approx(brute_targets(sizes))


def test_mix_meets_its_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    first, again = (sorted(mix_sources(d).collect()) for d in (docs, docs.repartition(7)))
    assert first == again
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, target = Counter(), {}
    for r in first:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())


def test_rates_are_tilted_exponentially(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), "a" if i % 3 else "b") for i in range(3000)]
    mixed = mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    share = mixed.where("target <> source_size").groupBy("source_size", "size").agg({"copies": "avg"}).toPandas()
    for _, part in share.groupby("source_size"):
        mean = part.sort_values("size")["avg(copies)"].to_numpy()
        assert abs(mean[-10:].mean() - mean[:10].mean()) > 0.05  # rates move with the size, in one direction


def test_rows_are_repeated_as_taken(spark, odd_docs):
    copies = Counter()
    for r in mix_sources(odd_docs).collect():
        copies[r.doc_id] += r.copies
    rows = repeat_to_weights(odd_docs)
    assert rows.columns == odd_docs.columns
    assert Counter(r.doc_id for r in rows.collect()) == +copies


def test_hashed_ngrams_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["The cat, the dog", "", "###$ x", "The cat, the dog"]
    data, offsets = text_bytes(pa.array(texts))
    row, bucket, weight = hashed_ngrams(data, offsets, 18)
    parts = [(sorted(bucket[row == i]), round(float((weight[row == i] ** 2).sum()), 9)) for i in range(4)]
    assert parts[0] == parts[3] and parts[1][0] == [] and parts[0][1] == 1.0
    alone, offsets = text_bytes(pa.array(texts[2:3]))
    assert sorted(hashed_ngrams(alone, offsets, 18)[1]) == parts[2][0]


def test_ftrl_learns_a_separable_rule_and_l1_keeps_zeros():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        label = int(rng.integers(0, 2))
        at = np.unique(np.r_[rng.integers(0, 100, 3) + 100 * label, rng.integers(200, 300, 9)])
        rows.append((at, np.ones(len(at)) / math.sqrt(len(at)), label))
    model = FtrlModel.fit(rows, 10)
    right = [(model.score(np.zeros(len(a), int), a, x, 1)[0] >= 0.5) == bool(y) for a, x, y in rows]
    assert np.mean(right) > 0.95 and (model.weights[300:1000] == 0).all()


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    split = labels.withColumn("out", held_out()).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in split)
    model = fit_quality(docs, labels.where(~held_out()), "quality")
    turned = labels.selectExpr("doc_id", "cast(if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as int) as quality")
    assert np.array_equal(model.weights, fit_quality(docs.repartition(5), turned.where(~held_out()), "quality").weights)
    scored = score_quality(docs, model, ["doc_id"]).join(labels, "doc_id").where(held_out()).toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.9


def test_scores_of_odd_texts(spark, odd_docs):
    labels = spark.createDataFrame([(9, 1), (5, 0), (5, 0), (6, 1), (6, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    model = fit_quality(odd_docs, labels, "quality")
    rows = score_quality(odd_docs, model, ["doc_id", "size"]).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    none = fit_quality(odd_docs, labels.where("false"), "quality")
    assert {r.score for r in score_quality(odd_docs, none, ["doc_id"]).collect()} == {0.5}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert quality_rules(none, labels).count() == 0
    assert mix_sources(none).count() == 0
    assert repeat_to_weights(none).count() == 0
    assert score_quality(none, fit_quality(none, labels, "quality"), ["doc_id"]).count() == 0
