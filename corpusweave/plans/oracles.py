"""The SQL that checks each query, in DuckDB's dialect."""

from __future__ import annotations

from corpusweave.functions.stopwords import ENGLISH
from corpusweave.functions.text import PUNCTUATION, WHITESPACE

NON_SPACE = WHITESPACE.replace("[", "[^")


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _r(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


PUNCT = _quoted(PUNCTUATION)
STOP = ", ".join(_quoted(word) for word in ENGLISH)


def _blank(text: str) -> str:
    return f"CASE WHEN {text} IS NULL OR regexp_full_match({text}, '{WHITESPACE}*') THEN '' ELSE {text} END"


def _split(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WHITESPACE}+'), lambda w: w <> '')"


def _collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WHITESPACE}+', ' ', 'g'))"


def _no_stop(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: w NOT IN ({STOP}))"


TOKENS = _split(f"translate(lower({_blank('text')}), {PUNCT}, '')")
STANDARD = f"array_to_string({_no_stop(TOKENS)}, ' ')"
TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def _text(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS clean_text FROM documents"


def _positions(tokens: str) -> str:
    return (
        f"SELECT doc_id, (unnest(range(len(t))))::INTEGER AS pos, unnest(t) AS token "
        f"FROM (SELECT doc_id, {tokens} AS t FROM documents)"
    )


def _gram_list(n: int) -> str:
    return (
        f"list_transform(range(greatest(len(t) - {n - 1}, 0)), "
        f"lambda i: array_to_string(t[i + 1 : i + {n}], ' '))"
    )


def _tf(source: str, low: int = 1, high: int = 1) -> str:
    """CTEs tf, dfs and n over ``source`` (doc_id, text)."""
    grams = "list_concat(" + ", ".join(_gram_list(n) for n in range(low, high + 1)) + ")"
    if (low, high) == (1, 1):
        grams = "t"
    return f"""
    corpus AS ({source}),
    toks AS (SELECT doc_id, {TERMS} AS t FROM corpus),
    tf AS (SELECT doc_id, term, count(*) AS tf
           FROM (SELECT doc_id, unnest({grams}) AS term FROM toks) GROUP BY doc_id, term),
    dfs AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM tf GROUP BY term),
    n AS (SELECT count(*) AS n FROM corpus)"""


def _vocab(min_df: int = 2, max_df: float = 0.95, limit: int | None = 50_000) -> str:
    cut = f"ORDER BY total_tf DESC, term LIMIT {limit}" if limit else ""
    return f"""
    bounded AS (SELECT * FROM dfs WHERE df >= {min_df} AND df <= {max_df} * (SELECT n FROM n)),
    limited AS (SELECT * FROM bounded {cut}),
    vocab AS (SELECT *, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_index,
                     ln((1.0 + (SELECT n FROM n)) / (1.0 + df)) + 1.0 AS idf FROM limited)"""


WEIGHTS = """
    raw AS (SELECT doc_id, term, tf * idf AS raw FROM tf JOIN vocab USING (term)),
    w AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""

PLAIN = "SELECT doc_id, text FROM documents"
CLEAN = f"SELECT doc_id, {STANDARD} AS text FROM documents"

VECTORS = """
    pts AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label AS cluster FROM embeddings),
    cells AS (SELECT doc_id, cluster, unnest(range(len(v)))::INTEGER AS idx, unnest(v) AS value FROM pts),
    means AS (SELECT cluster, idx, avg(value) AS value FROM cells GROUP BY cluster, idx),
    centers AS (SELECT cluster, list(value ORDER BY idx) AS c FROM means GROUP BY cluster)"""

NEAREST = """
    gaps AS (SELECT doc_id, cluster, list_distance(v, c) AS distance FROM pts JOIN centers USING (cluster)),
    picked AS (SELECT cluster, doc_id, distance FROM gaps
               QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY distance, doc_id) = 1)"""

SILHOUETTE = """
    digests AS (SELECT doc_id, md5('42:' || doc_id) AS d FROM pts),
    chosen AS (SELECT doc_id FROM digests ORDER BY d, doc_id LIMIT 5000),
    sampled AS (SELECT * FROM pts SEMI JOIN chosen USING (doc_id)),
    sizes AS (SELECT cluster, count(*) AS n FROM sampled GROUP BY cluster),
    sums AS (SELECT a.doc_id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.v, b.v)) AS s
             FROM sampled a, sampled b GROUP BY ALL),
    ab AS (SELECT doc_id, own, max(CASE WHEN own = other THEN n END) AS size,
                  max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a,
                  min(CASE WHEN own <> other THEN s / n END) AS b
           FROM sums JOIN sizes ON sizes.cluster = other GROUP BY doc_id, own),
    sil AS (SELECT CASE WHEN count(DISTINCT own) BETWEEN 2 AND count(*) - 1 THEN
                avg(CASE WHEN size = 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END)
            END AS silhouette_score FROM ab)"""

SILHOUETTE_SQUARED = """
    sizes AS (SELECT cluster, count(*) AS n FROM pts GROUP BY cluster),
    sums AS (SELECT a.doc_id, a.cluster AS own, b.cluster AS other,
                    sum(list_distance(a.v, b.v) * list_distance(a.v, b.v)) AS s
             FROM pts a, pts b GROUP BY ALL),
    ab AS (SELECT doc_id, own, max(CASE WHEN own = other THEN s / (n - 1) END) AS a,
                  min(CASE WHEN own <> other THEN s / n END) AS b
           FROM sums JOIN sizes ON sizes.cluster = other GROUP BY doc_id, own)"""

DAVIES_BOULDIN = """
    own AS (SELECT cluster, avg(list_distance(v, c)) AS s FROM pts JOIN centers USING (cluster) GROUP BY cluster),
    ratios AS (SELECT a.cluster, max((a.s + b.s) / list_distance(ca.c, cb.c)) AS worst
               FROM own a JOIN own b ON a.cluster <> b.cluster
               JOIN centers ca ON ca.cluster = a.cluster JOIN centers cb ON cb.cluster = b.cluster
               GROUP BY a.cluster),
    dbi AS (SELECT avg(worst) AS davies_bouldin_index FROM ratios)"""

METRICS = f"""WITH {VECTORS}, {SILHOUETTE}, {DAVIES_BOULDIN},
    counts AS (SELECT cluster, count(*) AS size FROM pts GROUP BY cluster)
    SELECT (SELECT count(*) FROM counts WHERE cluster <> -1) AS n_clusters_found,
           (SELECT sum(size)::BIGINT FROM counts) AS n_samples,
           {_r('(SELECT silhouette_score FROM sil)')} AS silhouette_score,
           {_r('(SELECT davies_bouldin_index FROM dbi)')} AS davies_bouldin_index,
           (SELECT string_agg(cluster || ':' || size, ' ' ORDER BY cluster) FROM counts) AS cluster_sizes"""

LABELLED = f"""
    docs AS (SELECT doc_id, {STANDARD} AS text, source AS name, coalesce(try_cast(substring(source, 4) AS INTEGER), -1) AS cluster FROM documents),
    kept AS (SELECT * FROM pts SEMI JOIN docs USING (doc_id))"""

LABELLED_VECTORS = VECTORS.replace(
    "pts AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label AS cluster FROM embeddings)",
    """pts AS (SELECT doc_id, [length(t), len(string_split(t, ' ')), length(t) - length(replace(t, 'e', ''))]::DOUBLE[] AS v,
        coalesce(try_cast(substring(source, 4) AS INTEGER), -1) AS cluster FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
)


def _keywords(by: str, labels: str) -> str:
    """CTE best (label, rank, term, mean_weight) from w and ``labels`` (doc_id, label)."""
    return f"""
    totals AS (SELECT {by}, term, sum(weight) AS total FROM w JOIN {labels} USING (doc_id) GROUP BY {by}, term),
    label_sizes AS (SELECT {by}, count(*) AS size FROM {labels} GROUP BY {by}),
    scored AS (SELECT {by}, term, total / size AS mean_weight, round(ln(total), 9) AS level
               FROM totals JOIN label_sizes USING ({by}) WHERE total > 0),
    best AS (SELECT {by}, term, mean_weight,
                    row_number() OVER (PARTITION BY {by} ORDER BY level DESC, term)::INTEGER AS rank
             FROM scored QUALIFY rank <= 15)"""



def _closest(shown: str) -> str:
    """What is shown for each source, by measures of the text, and for each label, by all embeddings."""
    return f"""SELECT 'text' AS kind, * FROM (WITH {LABELLED_VECTORS}, {LABELLED}, {NEAREST}
            SELECT cluster, doc_id, {shown} FROM picked JOIN docs USING (doc_id, cluster))
        UNION ALL SELECT 'embedding' AS kind, * FROM (WITH {VECTORS}, {LABELLED}, {NEAREST}
            SELECT picked.cluster, doc_id, {shown} FROM picked LEFT JOIN docs USING (doc_id))"""


INTERPRET = f"""WITH {LABELLED_VECTORS}, {LABELLED}, {NEAREST},
    {_tf('SELECT doc_id, text FROM docs')}, {_vocab()}, {WEIGHTS}, {_keywords('cluster', 'docs')},
    lists AS (SELECT cluster, string_agg(term, ' ' ORDER BY rank) AS top_keywords FROM best GROUP BY cluster)
    SELECT cluster AS cluster_id, size, doc_id AS closest_sample_index,
           substring(text, 1, 500) AS closest_sample_text, name AS closest_sample_name, top_keywords
    FROM label_sizes JOIN picked USING (cluster) JOIN docs USING (doc_id, cluster)
    LEFT JOIN lists USING (cluster)"""

SPARSE_VARIANCE = f"""WITH {_tf(PLAIN)}, {_vocab()}, {WEIGHTS},
    cols AS (SELECT term, sum(weight) AS s, sum(weight * weight) AS q FROM w GROUP BY term)
    SELECT {_r('sum(q / (SELECT n FROM n) - (s / (SELECT n FROM n)) * (s / (SELECT n FROM n)))')} AS total_variance FROM cols"""

# A diagonal mixture read off the labels, and each row's share in every component.
MIXTURE = f"""{VECTORS},
    k AS (SELECT cluster, count(*) AS m FROM pts GROUP BY cluster),
    total AS (SELECT count(*) AS n FROM pts),
    par AS (SELECT cluster, idx, avg(value) AS mu, greatest(avg(value * value) - avg(value) * avg(value), 0) + 1e-6 AS var
            FROM cells GROUP BY cluster, idx),
    logp AS (SELECT x.doc_id, p.cluster,
                    sum(-0.5 * ((x.value - mu) * (x.value - mu) / var + ln(var) + ln(2 * pi()))) AS lp
             FROM cells x JOIN par p USING (idx) GROUP BY x.doc_id, p.cluster),
    joint AS (SELECT doc_id, cluster, lp + ln(m / (SELECT n FROM total)) AS lp FROM logp JOIN k USING (cluster)),
    topped AS (SELECT *, max(lp) OVER (PARTITION BY doc_id) AS top FROM joint),
    shares AS (SELECT doc_id, cluster, exp(lp - top) / sum(exp(lp - top)) OVER (PARTITION BY doc_id) AS r
               FROM topped)"""

EM_STEP = f"""WITH {MIXTURE},
    mass AS (SELECT cluster, sum(r) AS m FROM shares GROUP BY cluster)
    SELECT s.cluster AS component, x.idx, {_r('any_value(mass.m) / (SELECT n FROM total)')} AS weight,
           {_r('sum(r * x.value) / any_value(mass.m)')} AS mean
    FROM shares s JOIN cells x USING (doc_id) JOIN mass ON mass.cluster = s.cluster
    GROUP BY s.cluster, x.idx"""

MIXTURE_BIC = f"""WITH {MIXTURE},
    likelihood AS (SELECT doc_id, max(top) + ln(sum(exp(lp - top))) AS ll FROM topped GROUP BY doc_id),
    parameters AS (SELECT 2 * count(*) + (SELECT count(*) FROM k) - 1 AS p FROM par)
    SELECT round(-2 * sum(ll) + any_value(p) * ln(count(*)), 3) AS bic FROM likelihood, parameters"""

KNN = """
    pairs AS (SELECT a.doc_id AS src, b.doc_id AS dst, list_distance(a.v, b.v) AS distance
              FROM pts a JOIN pts b ON a.doc_id <> b.doc_id),
    knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst)::INTEGER AS rank
            FROM pairs QUALIFY rank <= 14)"""

# Sigma by 64 halvings for every row at once, then the floor, the strengths and the two directions.
FUZZY = f"""WITH RECURSIVE {VECTORS}, {KNN},
    lists AS (SELECT src, list(distance ORDER BY rank) AS d, list(dst ORDER BY rank) AS t FROM knn GROUP BY src),
    near AS (SELECT *, coalesce(list_min(list_filter(d, lambda x: x > 0)), 0.0) AS rho FROM lists),
    search AS (
        SELECT src, d, rho, 0 AS step, 0.0::DOUBLE AS lo, 'infinity'::DOUBLE AS hi, 1.0::DOUBLE AS mid FROM near
        UNION ALL
        SELECT src, d, rho, step + 1, lo2, hi2, CASE WHEN isinf(hi2) THEN mid * 2 ELSE (lo2 + hi2) / 2 END
        FROM (SELECT src, d, rho, step, mid, CASE WHEN wide THEN lo ELSE mid END AS lo2,
                     CASE WHEN wide THEN mid ELSE hi END AS hi2
              FROM (SELECT *, list_sum(list_transform(d, lambda x: exp(-greatest(x - rho, 0) / mid))) > log2(15) AS wide
                    FROM search WHERE step < 64))),
    sigmas AS (SELECT src, greatest(mid, 1e-3 * list_sum(d) / (len(d) + 1)) AS sigma FROM search WHERE step = 64),
    directed AS (SELECT knn.src, dst, exp(-greatest(distance - rho, 0) / sigma) AS w
                 FROM knn JOIN near USING (src) JOIN sigmas USING (src)),
    both_ways AS (SELECT src, dst, w AS a, 0.0::DOUBLE AS b FROM directed UNION ALL SELECT dst, src, 0.0::DOUBLE, w FROM directed)
    SELECT src, dst, {_r('max(a) + max(b) - max(a) * max(b)')} AS weight FROM both_ways GROUP BY src, dst"""

TEXT_MEASURES = """SELECT doc_id, unnest([0, 1, 2]) AS idx,
    unnest([length(t), length(t) - length(replace(t, ' ', '')) + 1, length(t) - length(replace(t, 'e', ''))])::DOUBLE AS value
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
CENTER_CELLS = f"WITH {VECTORS} SELECT cluster, idx, {_r('value')} AS value FROM means"
CLUSTER_SIZES = "SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY label"
SAVED_LABELS = "SELECT vec_id AS doc_id, label AS cluster FROM embeddings"

ORACLES: dict[str, str] = {
    "load_corpus": "SELECT doc_id, coalesce(text, '') AS text, source AS name FROM documents",
    "load_corpus_csv": "SELECT doc_id, coalesce(text, '') AS text, source AS name FROM documents",
    "load_corpus_without_key": """SELECT source, count(*) AS n_docs, count(*) AS n_ids,
        sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY source""",
    "write_labels": SAVED_LABELS,
    "write_metrics": METRICS,
    "write_interpretations": INTERPRET,
    "save_model": "SELECT count(*) AS n_rows, count(*) AS n_equal FROM embeddings",
    "stage_cache": _text(STANDARD),
    "blank_to_empty": f"SELECT conv_id, turn, {_blank('text')} AS clean_text FROM conversations",
    "lowercase": _text("lower(text)"),
    "strip_punct": _text(f"translate(text, {PUNCT}, '')"),
    "collapse_ws": _text(_collapse("text")),
    "tokenize_ws": _positions(_split("text")),
    "lemmatize": f"""WITH toks AS ({_positions(TOKENS)}),
        words AS (SELECT DISTINCT token FROM toks),
        lemmas AS (SELECT a.token AS form, b.token AS lemma FROM words a JOIN words b ON a.token = b.token || 's')
        SELECT doc_id, pos, coalesce(lemma, token) AS token FROM toks LEFT JOIN lemmas ON form = token""",
    "lemmatize_small": _text(
        f"""array_to_string(list_transform({TOKENS}, lambda w: CASE WHEN w IN ('is', 'was', 'are') THEN 'be'
        WHEN w = 'les' THEN 'le' WHEN w = 'der' THEN 'die' ELSE w END), ' ')"""
    ),
    "remove_stopwords": _text(STANDARD),
    "truncate_tokens": _text(f"array_to_string(({TOKENS})[1:50], ' ')"),
    "join_tokens": _text(f"array_to_string({TOKENS}, ' ')"),
    "standard_preprocess": _text(STANDARD),
    "light_preprocess": _text(
        "array_to_string((" + _split(_collapse(f"translate(lower(coalesce(text, '')), {PUNCT}, '')")) + ")[1:50], ' ')"
    ),
    "light_preprocess_whole": _text(_collapse(f"translate(lower(coalesce(text, '')), {PUNCT}, '')")),
    "has_urls": """SELECT 'documents' AS name, bool_or(coalesce(regexp_matches(text, 'https?://'), false)) AS has_urls
        FROM documents UNION ALL
        SELECT 'pages', bool_or(coalesce(regexp_matches(html, 'https?://'), false)) FROM pages""",
    "remove_urls": f"""SELECT page_id, regexp_replace(concat_ws(' ', url, html), 'https?://{NON_SPACE}+', '', 'g')
        AS clean_text FROM pages""",
    "corpus_profile": f"""SELECT count(*) AS n_docs, count(*) FILTER (clean <> '') AS n_nonempty,
        min(length(text)) AS min_chars, max(length(text)) AS max_chars, {_r('avg(length(text))')} AS avg_chars
        FROM (SELECT text, {STANDARD} AS clean FROM documents)""",
    "tfidf_tokens": _positions(TERMS),
    "ngrams": f"""SELECT doc_id, unnest(list_concat({_gram_list(1)}, {_gram_list(2)}, {_gram_list(3)})) AS gram
        FROM (SELECT doc_id, {TERMS} AS t FROM documents)""",
    "term_frequency": f"WITH {_tf(PLAIN)} SELECT doc_id, term, tf FROM tf",
    "document_frequency": f"WITH {_tf(PLAIN)} SELECT term, df, total_tf FROM dfs",
    "vocab_df_bounds": f"WITH {_tf(PLAIN)}, {_vocab()} SELECT term, df, total_tf FROM bounded",
    "vocab_max_features": f"WITH {_tf(PLAIN)}, {_vocab(limit=1_000)} SELECT term, df, total_tf FROM limited",
    "feature_names": f"WITH {_tf(PLAIN)}, {_vocab()} SELECT term_index, term FROM vocab",
    "feature_names_unbounded": f"""WITH {_tf(PLAIN)}
        SELECT (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_index, term FROM dfs""",
    "idf": f"""WITH {_tf(PLAIN)}, {_vocab()} SELECT term,
        {_r('ln((1.0 + (SELECT n FROM n)) / (1.0 + df)) + 1.0')} AS idf FROM bounded""",
    "tfidf": f"""WITH {_tf(PLAIN)}, {_vocab()}, {WEIGHTS}
        SELECT doc_id, term, {_r('coalesce(weight, 0.0)')} AS weight FROM corpus LEFT JOIN w USING (doc_id)""",
    "tfidf_unbounded": f"""WITH {_tf(PLAIN)}, {_vocab(limit=None)}, {WEIGHTS}
        SELECT doc_id, term, {_r('weight')} AS weight FROM w""",
    "tfidf_bigrams": f"""WITH {_tf(CLEAN, 1, 2)}, {_vocab()}, {WEIGHTS}
        SELECT doc_id, term, {_r('weight')} AS weight FROM w""",
    "tfidf_vectors": f"""WITH {_tf(PLAIN)}, {_vocab()}, {WEIGHTS}
        SELECT doc_id, (SELECT count(*) FROM vocab) AS n_terms, count(term) AS non_zeros,
               {_r('coalesce(sum(weight), 0.0)')} AS weight_sum
        FROM corpus LEFT JOIN w USING (doc_id) GROUP BY doc_id""",
    "tfidf_shape": f"""WITH {_tf(PLAIN)}, {_vocab()}, {WEIGHTS} SELECT (SELECT n FROM n) AS n_docs,
        (SELECT count(*) FROM vocab) AS n_terms, (SELECT count(*) FROM w) AS non_zeros""",
    "tfidf_transform": f"""WITH {_tf(PLAIN)}, {_vocab()},
        new_tf AS (SELECT doc_id, term, count(*) AS tf FROM
            (SELECT item_id AS doc_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY doc_id, term),
        raw AS (SELECT doc_id, term, tf * idf AS raw FROM new_tf JOIN vocab USING (term))
        SELECT doc_id, term, {_r('raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id))')} AS weight FROM raw""",
    "dense_encode": TEXT_MEASURES,
    "dense_encode_whole": TEXT_MEASURES,
    "dense_encode_hashing": """SELECT doc_id, 64 AS width, CASE WHEN regexp_matches(coalesce(text, ''), '[^\\s]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
        FROM documents""",
    "precomputed_embeddings": f"""SELECT doc_id, source, idx, {_r('value')} AS value FROM
        (SELECT doc_id, source, unnest(range(len(embedding)))::INTEGER AS idx, unnest(embedding::DOUBLE[]) AS value
         FROM documents JOIN embeddings ON doc_id = vec_id)
        UNION ALL SELECT doc_id, source, -1, NULL FROM documents ANTI JOIN embeddings ON doc_id = vec_id""",
    "glove_docs": f"""WITH {_tf(PLAIN)},
        means AS (SELECT doc_id, sum(tf * sqrt(length(term))) / sum(tf) AS a, sum(tf * ln(df + 1.0)) / sum(tf) AS b,
                         sum(tf * ln(total_tf / df + 1.0)) / sum(tf) AS c FROM tf JOIN dfs USING (term) GROUP BY doc_id)
        SELECT doc_id, unnest([0, 1, 2]) AS idx,
               round(unnest([coalesce(a, 0.0), coalesce(b, 0.0), coalesce(c, 0.0)]), 6) + 0.0 AS value
        FROM corpus LEFT JOIN means USING (doc_id)""",
    "covariance": f"""WITH {VECTORS} SELECT a.idx AS i, b.idx AS j, {_r('covar_samp(a.value, b.value)')} AS cov
        FROM cells a JOIN cells b ON a.doc_id = b.doc_id AND a.idx <= b.idx GROUP BY a.idx, b.idx""",
    "sparse_total_variance": SPARSE_VARIANCE,
    "knn_graph_hashed": f"WITH {VECTORS}, {KNN} SELECT count(*) AS n_edges, true AS recall_reached FROM knn",
    "knn_graph": f"WITH {VECTORS}, {KNN} SELECT src, dst, {_r('distance')} AS distance, rank FROM knn",
    "fuzzy_graph": FUZZY,
    "to_dense": f"""WITH {_tf(PLAIN)}, {_vocab(limit=50)}, {WEIGHTS}
        SELECT doc_id, term_index, {_r('coalesce(weight, 0.0)')} AS weight
        FROM corpus CROSS JOIN vocab LEFT JOIN w USING (doc_id, term)""",
    "kmeans_predict": f"""WITH {VECTORS} SELECT doc_id, own AS cluster, cluster AS nearest FROM (
        SELECT doc_id, pts.cluster AS own, centers.cluster,
               row_number() OVER (PARTITION BY doc_id ORDER BY list_distance(v, c), centers.cluster) AS rank
        FROM pts CROSS JOIN centers) WHERE rank = 1""",
    "kmeans_centers": CENTER_CELLS,
    "kmeans_inertia": f"""WITH {VECTORS} SELECT {_r('sum(list_distance(v, c) * list_distance(v, c))')} AS inertia
        FROM pts JOIN centers USING (cluster)""",
    "agglomerative_labels": SAVED_LABELS,
    "gmm_em_step": EM_STEP,
    "gmm_predict": f"""WITH {MIXTURE} SELECT doc_id, cluster FROM shares
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r DESC, cluster) = 1""",
    "gmm_predict_proba": f"WITH {MIXTURE} SELECT doc_id, cluster AS component, {_r('r')} AS probability FROM shares",
    "gmm_bic": MIXTURE_BIC,
    "n_clusters_found": "SELECT count(DISTINCT label) FILTER (label <> -1) AS n_clusters_found FROM embeddings",
    "n_samples": "SELECT count(*) AS n_samples FROM embeddings",
    "silhouette": f"WITH {VECTORS}, {SILHOUETTE} SELECT {_r('silhouette_score')} AS silhouette_score FROM sil",
    "silhouette_fast": f"""WITH {VECTORS}, {SILHOUETTE_SQUARED}
        SELECT {_r('avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette_squared FROM ab""",
    "sample_n": """SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 300""",
    "davies_bouldin": f"""WITH {VECTORS}, {DAVIES_BOULDIN}
        SELECT {_r('davies_bouldin_index')} AS davies_bouldin_index FROM dbi""",
    "cluster_sizes": CLUSTER_SIZES,
    "evaluate": METRICS,
    "centroids": CENTER_CELLS,
    "closest_to_centroid": f"""WITH {VECTORS}, {NEAREST}
        SELECT cluster, doc_id, {_r('distance')} AS distance FROM picked""",
    "closest_text": _closest("substring(text, 1, 500) AS closest_sample_text"),
    "closest_name": _closest("name AS closest_sample_name"),
    "top_keywords": f"""WITH {_tf(CLEAN)}, {_vocab()}, {WEIGHTS}, {_keywords('source', 'documents')}
        SELECT source, rank, term, {_r('mean_weight')} AS mean_weight FROM best""",
    "cluster_size": "SELECT source, count(*) AS size FROM documents GROUP BY source",
    "interpret": INTERPRET,
    "cluster_term_weights": f"""WITH words AS (SELECT source, unnest({_no_stop(TOKENS)}) AS term FROM documents),
        counts AS (SELECT source, term, count(*) AS count FROM words GROUP BY source, term),
        kept AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY source ORDER BY count DESC, term) <= 100)
        SELECT source, term, count, {_r('count / max(count) OVER (PARTITION BY source)')} AS weight FROM kept""",
    "size_histogram": "SELECT label::VARCHAR AS label, count(*) AS count FROM embeddings GROUP BY embeddings.label",
    "size_share": """SELECT label::VARCHAR AS label, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent
        FROM embeddings GROUP BY embeddings.label""",
}
