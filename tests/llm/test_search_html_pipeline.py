import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusweave.llm import html_extract
from corpusweave.llm.html_extract import extract_text, main_text
from corpusweave.llm.queries import ORACLES, QUERIES
from corpusweave.llm.vector_search import best, exact_top_k

SMALL = "/root/testdata/sf0.001"
STOP = frozenset("the of and to in is a".split())


def brute(vectors, queries, top):
    rows = []
    width = max((len(v) for _, v in vectors), default=0)
    whole = [(i, np.array([int(np.floor(1024 * float(x))) for x in v] + [0] * (width - len(v)), object)) for i, v in vectors]
    for q in sorted(set(queries)):
        own = next(v for i, v in whole if i == q)
        scored = sorted((-int(own @ v), i) for i, v in whole if i != q)[:top]
        rows += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"rows": 20, "queries": 2, "step": 3}, {"top": 3, "rows": 7}])
def test_search_against_brute_force(spark, limits):
    rng = np.random.default_rng(5)
    values = [(i, rng.normal(size=10).astype(np.float32).tolist()) for i in range(90)]
    values += [(i, values[0][1]) for i in range(200, 215)]  # ties
    values += [(300, [1.0, 2.0]), (400, [])]
    bad = [(500, None), (600, [1.0, None]), (700, [float("nan")] * 10), (800, [float("inf")] * 10), (None, [1.0] * 10)]
    frame = spark.createDataFrame([(*v, "x", 1) for v in values + bad], "vec_id bigint, embedding array<float>, block string, q int").repartition(4)
    rows = exact_top_k(frame, F.col("vec_id") % 20 == 0, **limits).collect()
    queries = [i for i, _ in values if i % 20 == 0]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows) == brute(values, queries, limits.get("top", 10))


def test_search_with_few_or_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert exact_top_k(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], schema)
    assert exact_top_k(one, F.col("vec_id") == 0).count() == 0
    assert exact_top_k(one, F.col("vec_id") == 7).count() == 0


def test_pruning_keeps_all_best():
    rng = np.random.default_rng(2)
    columns = rng.integers(-500, 500, (24, 300))
    columns[:, 50:80] = columns[:, :1]
    query = rng.integers(-500, 500, 24)
    squares = np.add.reduceat(columns.astype(float) ** 2, np.arange(0, 24, 8), axis=0)
    rest = np.sqrt(np.concatenate([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, 300))]))
    at, score = best(query, columns, rest, 8, 10, np.zeros(300, bool))
    want = query @ columns
    floor = np.sort(want)[-10]
    assert sorted(at.tolist()) == np.flatnonzero(want >= floor).tolist() and (score == want[at]).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head>
<body class="page comments-open"><header>Site name</header><nav><ul><li><a href="/">Home</a><li><a href="/b">More</a></ul></nav>
<div class="cookie-notice">The use of cookies is a thing that is in the law of the land and to be told to all of the readers here.</div>
<article><header><h1>A &amp; B &lt;i&gt;</h1></header><p>First   paragraph&nbsp;of
the text<br>goes on.<p>Short.<div class="ad">Buy now</div><form><input value="x">Mail me</form>
<p>Last <b>bold <i>words</b>.</p><!-- <p>hidden</p> --><section id="comments"><p>Nice!</p></section></article>
<aside>Side</aside><footer>&copy; all</footer></body></html>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE, STOP) == "A & B <i>\nFirst paragraph of the text goes on.\nShort.\nLast bold words."


def test_blocks_without_an_article_element():
    text = "The rest of the text is in a long block, and the words of it go to the end of the page. " * 4
    page = f"<body><div class='menu'>Start</div><p><a href='/x'>All the links of the site are in here, to be read</a></p><h2>Head</h2><p>{text}</p><p>Ok.</p><ul><li><a href='/'>Back</a></ul></body>"
    assert main_text(page, STOP) == f"Head\n{text.strip()}\nOk."


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<p>a", "</p></div>", "<article>", "<!-- open", "<script>x", "a < b & c", "&#0;&#xD800;&bogus;", "<p>" * 3000 + "deep"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(main_text(page, STOP), str)


def test_short_blocks_take_the_label_of_the_nearest():
    blocks = [html_extract.Block(t, 0, None, o) for t, o in (("x" * 300, False), ("near", False), ("mid", False), ("mid2", False), ("out", True))]
    html_extract.classify(blocks, STOP)
    assert [b.good for b in blocks] == [True, True, True, False, False]


TALK = "The words of a reader go on and on, as it is in the nature of the thing, and to the end of the line. " * 3


def test_names_are_evidence_only():
    para = "<p>" + "It is the rest of the text, and a part of the whole that is told in the words of the land. " * 3 + "</p>"
    own = " ".join(para[3:-4].split())
    keeps = [f"<div class='social-history'>{para}</div>", f"<section id='related-work'>{para}</section>", f"<div class='widget'>{para * 3}</div>"]
    for part in keeps:
        assert main_text(f"<article><h1>T</h1><p>{TALK}</p>{part}</article>", STOP).count(own) == part.count(para)
    for name in ("cookie-notice", "ad", "adBanner", "sidebar-left", "related-posts", "newsletter_signup"):
        assert main_text(f"<article><p>{TALK * 3}</p><div class='{name}'>{para}</div></article>", STOP) == (TALK * 3).strip()


@pytest.mark.parametrize("page", [
    "<div><p>{t}</p><article class='comment'><p>{c}</p></article></div>", "<article><p>{t}</p><article class='comment'><p>{c}</p></article></article>",
    "<article><p>{t}</p><ol class='comment-list'><li>{c}</li></ol></article>", "<p>{t}</p><div id='disqus_thread'><p>{c}</p></div>", "<main><p>{t}</p><section class='user-comments'><p>{c}</p></section></main>",
])
def test_reader_comments_go(page):
    text = "All of the text is in the page, to be read as it is. " * 6
    assert main_text(page.format(t=text, c=TALK), STOP) == text.strip()


def test_density_alone_decides_without_names():
    long = "The first of the two is in the text, and the second is to be of a kind that is in the page as well. "
    dense = "It is in the nature of the words to be a part of the whole and of the text."
    names = "Berlin Paris Madrid Lisbon Vienna Prague Warsaw Zagreb Athens Dublin Oslo Bergen"
    links = "<a href='/1'>One of the pages that is to be read in the end</a> and <a href='/2'>one of the others that is in the list</a>"
    page = f"<div>{names}</div><div>{links}</div><div>{long * 3}</div><div>Short one</div><div>{dense}</div><div>{links}</div><div>End of it</div>"
    # the list of names has no stop words and stands next to links; the last short block as well
    assert main_text(page, STOP).split("\n") == [(long * 3).strip(), "Short one", dense]


def test_an_article_that_holds_little_is_not_the_page():
    text = "The rest of the text is in a long block, and the words of it go to the end of the page. " * 9
    assert main_text(f"<article><p>Teaser of the day</p></article><div><p>{text}</p></div>", STOP).endswith(text.strip())


def test_unclosed_elements_take_linear_time():
    import time

    def seconds(n):
        start = time.perf_counter()
        for page in ("<b>" * n + "</i>" * n, "<b>" * n + "<div></div>" * n, "<li><ul>" + "<b>" * n + "<li></li>" * n, "<p>" * n + "</div>" * n):
            html_extract.read_blocks(page)
        return time.perf_counter() - start

    seconds(2_000)
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.05)


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (3, "w", "<p>only</p>", "t"), (3, "w", "<p>only</p>", "t")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract_text(frame, ["page_id", "url"]).collect()
    assert sorted((r.page_id or -1, r.n_chars) for r in got) == sorted([(1, len(main_text(PAGE, STOP))), (2, 0), (-1, 0), (3, 4), (3, 4)])
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_text(frame.where("false"), ["page_id"]).count() == 0


def test_registered_queries_keep_all_rows(spark):
    assert len(QUERIES) == 13 and set(ORACLES) <= set(QUERIES)
    counts = {t: spark.read.parquet(f"{SMALL}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, query in QUERIES.items():
        if not name.startswith(("op2_", "op11_")):
            assert query(spark, SMALL).count() == counts["pages" if name.startswith("op6_") else "documents"], name


def test_pipeline_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rules = QUERIES["op1_quality_rules"](spark, SMALL).where("kept").select("doc_id")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = docs
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, seen, SMALL)
        if place < 4:
            assert found.columns == docs.columns
        rows = found.collect()
        if place == 0:
            assert {r.doc_id for r in rows} == {r.doc_id for r in rules.collect()}
        if place == 1:
            assert len({r.doc_id for r in rows}) == len(rows) <= seen.count()
        if place == 2:
            assert {r.doc_id for r in rows} == {r.doc_id for r in seen.collect()} and all(r.n_chars == len(r.text) for r in rows)
        seen = spark.createDataFrame(rows, found.schema)
    assert seen.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted(whole.collect()) == sorted(seen.collect())


def test_pipeline_stages_take_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    clean = next(r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars > 900").collect())
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, clean, "en", None, 1), (3, clean, "en", "a", 1), (3, clean, "en", "a", 1), (4, "x " * 30_000, "en", "b", 1)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, frame, SMALL).columns == frame.columns
            stage(spark, frame, SMALL).collect()
        assert corpus_pipeline.STAGES[4][1](spark, frame, SMALL).count() == frame.count()
