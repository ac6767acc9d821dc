"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, backoff, cap_filters, centroids, edit_counts, mixing, packing, phrase_prints, quality, simhash, substrings, toxicity, url_blocks
from millrace.llm.common import documents, tokenizer_path
from millrace.llm.registry import query
from millrace.sources.tables import table


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query(
    "op4_substrings",
    r"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    windows AS (
        SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS words
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50)
    ),
    repeated AS (
        SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY words) AS source FROM windows)
        WHERE source < doc_id
    ),
    gone AS (SELECT DISTINCT doc_id, s + unnest(range(50)) AS p FROM repeated),
    lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
        sha256(coalesce(array_to_string(
            list_transform(list_filter(range(1, len(w) + 1), lambda p: ps IS NULL OR NOT list_contains(ps, p)),
                lambda p: w[p]), ' '), '')) AS kept_sha256
    FROM words LEFT JOIN lost USING (doc_id)
    """,
)
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(documents(spark, sf_dir))


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


@query(
    "op3_mixing",
    r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
            ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS place
        FROM documents
    ),
    by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM by_source),
    weighed AS (SELECT *, [5, 2, 1][number % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM numbered),
    levels AS (
        SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
            (sum(source_size) OVER () * 1.5::DOUBLE
                - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER ()
                - coalesce(sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
        FROM weighed
    ),
    filled AS (
        SELECT *, coalesce(least(cap, max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight), cap) AS target,
            ceil(least(greatest(1.0, floor(total / 1048576)), greatest(1.0, source_size / 256::DOUBLE)))::BIGINT AS block
        FROM levels
    ),
    quotas AS (
        SELECT *, ceil(source_size / block::DOUBLE)::BIGINT AS blocks,
            least(floor(target / block + 0.5)::BIGINT, ceil(source_size / block::DOUBLE)::BIGINT * 2) AS quota
        FROM filled
    ),
    goals AS (
        SELECT *, (sum(quota) OVER ())::BIGINT AS slots,
            coalesce(sum(quota) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low
        FROM quotas
    ),
    slots AS (
        SELECT k, (k + 1) * 2654435769 % 4294967296 AS point
        FROM (SELECT unnest(range((SELECT max(slots) + max(slots) // 16 + 64 FROM goals))) AS k)
    ),
    ranked AS (
        SELECT number, quota, blocks, row_number() OVER (PARTITION BY number ORDER BY k) - 1 AS r
        FROM slots ASOF JOIN (SELECT *, low * 4294967296 // slots AS edge FROM goals WHERE quota > 0) g ON point >= edge
    ),
    times AS (SELECT number, r % blocks AS blk, count(*) AS times FROM ranked WHERE r < quota GROUP BY ALL),
    placed AS (
        SELECT s.*, g.number, g.source_size, g.target, g.block,
            coalesce(sum(size) OVER (PARTITION BY g.number ORDER BY place, doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
        FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
    ),
    parts AS (SELECT *, unnest(range(first // block, (first + size - 1) // block + 1)) AS blk FROM placed WHERE size > 0),
    taken AS (
        SELECT doc_id, sum((least(first + size, (blk + 1) * block) - greatest(first, blk * block)) * coalesce(times, 0)) AS taken
        FROM parts LEFT JOIN times USING (number, blk) GROUP BY doc_id
    )
    SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (doc_id)
    """,
)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).drop("passes", "tie")


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


# The SQL knows the spellings; the pages hold no canonical link or refresh, which tests cover.
@query(
    "op7_url_blocks",
    r"""
    WITH rules(rule_host, rule_path, rule_verdict) AS (
        VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    ),
    split AS (
        SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host,
            regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
        FROM pages
    ),
    fits AS (
        SELECT page_id, rule_host || rule_path AS rule, rule_verdict FROM split, rules
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) = 1
    ),
    spelled AS (
        SELECT split.*, rule, rule_verdict,
            regexp_replace(CASE WHEN regexp_matches(host, '^(www|m)\.[^.]+\.') THEN regexp_replace(host, '^(www|m)\.', '') ELSE host END, '^$', '')
                || regexp_replace(path, '(/index)?(\.html?)?/*$', '') AS spelling
        FROM split LEFT JOIN fits USING (page_id)
    ),
    classes AS (
        SELECT spelling, bool_or(rule_verdict = 'block') AND NOT bool_or(rule_verdict = 'allow') AS blocked
        FROM spelled WHERE rule_verdict IS NOT NULL AND url LIKE '%://%' GROUP BY spelling
    )
    SELECT page_id, host, path, rule,
        coalesce(rule_verdict, CASE WHEN blocked AND url LIKE '%://%' THEN 'block' END, 'allow') AS verdict
    FROM spelled LEFT JOIN classes USING (spelling)
    """,
)
def op7_url_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_blocks.judged(table(spark, sf_dir, "pages"), url_blocks.rule_table(spark, URL_RULES))


@query("op8_phrase_prints")
def op8_phrase_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_prints.fingerprinted(documents(spark, sf_dir))


@query(
    "op10_cap_filters",
    """
    WITH RECURSIVE good AS (
        SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    pairs AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE list_cosine_similarity(a.v, b.v) >= 0.9
    ),
    reach(vec_id, other) AS (
        SELECT vec_id, vec_id FROM embeddings
        UNION
        SELECT reach.vec_id, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a
    ),
    roots AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
    counts AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM roots LEFT JOIN counts USING (vec_id)
    """,
)
def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    "op5_backoff",
    r"""
    WITH words AS (
        SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS p
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
    ),
    pairs AS (
        SELECT doc_id, p, lag(w) OVER (PARTITION BY doc_id ORDER BY p) AS v, w FROM words
    ),
    ones AS (SELECT w, count(*) AS n FROM words GROUP BY w),
    own_ones AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY ALL),
    twos AS (SELECT v, w, count(*) AS n FROM pairs WHERE v IS NOT NULL GROUP BY ALL),
    own_twos AS (SELECT doc_id, v, w, count(*) AS n FROM pairs WHERE v IS NOT NULL GROUP BY ALL),
    own AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
    counted AS (
        SELECT p.doc_id, p.v IS NOT NULL AS second, a.n - oa.n AS c_w, b.n - ob.n AS c_v, t.n - ot.n AS c_vw,
            greatest((SELECT count(*) FROM words) - own.n, 1)::DOUBLE AS rest
        FROM pairs p JOIN own USING (doc_id) JOIN ones a ON a.w = p.w JOIN own_ones oa ON oa.doc_id = p.doc_id AND oa.w = p.w
        LEFT JOIN ones b ON b.w = p.v LEFT JOIN own_ones ob ON ob.doc_id = p.doc_id AND ob.w = p.v
        LEFT JOIN twos t ON t.v = p.v AND t.w = p.w
        LEFT JOIN own_twos ot ON ot.doc_id = p.doc_id AND ot.v = p.v AND ot.w = p.w
    ),
    scores AS (
        SELECT doc_id, second AND c_vw = 0 AS backed, c_w = 0 AS unseen,
            CASE WHEN second AND c_vw > 0 THEN ln(c_vw / c_v::DOUBLE)
                ELSE (CASE WHEN second THEN ln(0.4::DOUBLE) ELSE 0 END) + CASE WHEN c_w > 0 THEN ln(c_w / rest) ELSE ln(0.4::DOUBLE / rest) END
            END AS s
        FROM counted
    )
    SELECT doc_id, coalesce(count(s), 0) AS n_words, coalesce(sum(backed::INT), 0)::BIGINT AS n_backed_off,
        coalesce(sum(unseen::INT), 0)::BIGINT AS n_unseen, round(coalesce(sum(s), 0), 3) AS log_score, round(avg(s), 6) AS mean_log_score
    FROM documents LEFT JOIN scores USING (doc_id) GROUP BY doc_id
    """,
)
def op5_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff.scored(documents(spark, sf_dir))
    return scores.withColumns({"log_score": F.round("log_score", 3), "mean_log_score": F.round("mean_log_score", 6)})


# The query above is bound to pairs by its SQL; this one looks at three words.
@query("op5_backoff_triples")
def op5_backoff_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scored(documents(spark, sf_dir), order=3)


@query("op6_edit_counts")
def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.edited_counts(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    coders = alignment.Coders(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return alignment.aligned(documents(spark, sf_dir), coders)


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


_CENTROID_ROUND = """
    near{n} AS MATERIALIZED (
        SELECT vec_id, v, c, d FROM (
            SELECT g.vec_id, g.v, e.c, list_sum(list_transform(list_zip(g.v, e.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
            FROM good g, centre{n} e)
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1
    ),"""
_CENTROID_MOVE = """
    sum{n} AS (
        SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM near{n}) GROUP BY c, i
    ),
    mean{n} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM sum{n} GROUP BY c),
    centre{m} AS MATERIALIZED (SELECT c, coalesce(mean{n}.v, centre{n}.v) AS v FROM centre{n} LEFT JOIN mean{n} USING (c)),"""


@query(
    "op11_centroids",
    """
    WITH good AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    centre0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM good QUALIFY c < 40
    ),"""
    + "".join(_CENTROID_ROUND.format(n=n) + _CENTROID_MOVE.format(n=n, m=n + 1) for n in range(5))
    + _CENTROID_ROUND.format(n=5).rstrip(",")
    + """
    SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
        (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(e.v, ',')) AS centroid_sha256
    FROM near5 JOIN centre5 e USING (c)
    """,
)
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))
