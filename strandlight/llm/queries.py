"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlight.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlight.llm.tokenstore import store_documents

    return store_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2)


def op9_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlight.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), stable=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlight.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlight.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlight.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlight.llm.media import media_digests, store_media

    return media_digests(store_media(table(spark, sf_dir, "documents")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlight.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlight.llm.secret_scan import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlight.llm.embedding_dedup import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op3_embedding_dedup": op3_embedding_dedup,
    "op6_url_filter": op6_url_filter,
    "op8_secret_scan": op8_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op4_quality": op4_quality,
    "op7_simhash": op7_simhash,
    "op10_media": op10_media,
    "op1_best_fit_packing": op1_best_fit_packing,
    "op5_token_store": op5_token_store,
    "op9_bpe_words": op9_bpe_words,
}

OP3_SQL = """
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (
  SELECT r, label, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) AS e FROM w
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
s AS (SELECT r AS n, r AS m FROM w UNION SELECT s.n, p.b FROM s JOIN p ON p.a = s.m),
c AS (SELECT n AS r, min(w.vec_id) AS component_id FROM s JOIN w ON w.r = s.m GROUP BY 1),
k AS (SELECT a AS r, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM w JOIN c USING (r) LEFT JOIN k USING (r)"""


def _spans_sql(kind: int, pattern: str) -> str:
    """Spans (start, finish, kind, value) of a pattern: lengths between matches and of matches, added up."""
    return f"""SELECT doc_id, o, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': CAST(list_sum(b[1:i]) + coalesce(list_sum(z[1:i - 1]), 0) AS BIGINT), 'k': {kind}, 'z': z[i], 'v': m[i]}})) AS x
FROM (SELECT doc_id, o, m, list_transform(m, lambda y: length(y)) AS z, list_transform(string_split_regex(t, '{pattern}'), lambda y: length(y)) AS b FROM (SELECT doc_id, o, t, regexp_extract_all(t, '{pattern}') AS m FROM d))"""


_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = "(" + _KEYWORDS + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS o, coalesce(text, '') AS t FROM documents),
a AS ({_spans_sql(0, _ASSIGN)}), c AS ({_spans_sql(1, 'AKIA[A-Z0-9]+')}), h AS ({_spans_sql(2, '[0-9a-f]+')}), g AS ({_spans_sql(3, '[A-Za-z0-9+/_=-]{20,}')}),
base AS (
  SELECT doc_id, o, x.s AS s, x.s + x.z AS e, 0 AS k, regexp_extract(x.v, '{_ASSIGN}', 2) AS v FROM a WHERE length(regexp_extract(x.v, '{_ASSIGN}', 2)) >= 6
  UNION ALL SELECT doc_id, o, x.s, x.s + x.z, 1, x.v FROM c WHERE x.z >= 20 UNION ALL SELECT doc_id, o, x.s, x.s + x.z, 2, x.v FROM h WHERE x.z >= 24),
more AS (SELECT doc_id, o, x.s AS s, x.s + x.z AS e, 3 AS k, x.v AS v FROM g WHERE regexp_matches(x.v, '[a-z]') AND regexp_matches(x.v, '[A-Z]') AND regexp_matches(x.v, '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = g.doc_id AND base.s < g.x.s + g.x.z AND g.x.s < base.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
n AS (SELECT v, count(DISTINCT t) AS repos FROM every JOIN d USING (doc_id) GROUP BY v HAVING count(DISTINCT every.o) <= 1),
live AS (SELECT every.*, repos FROM every JOIN n USING (v)),
shown AS (SELECT * FROM base UNION ALL SELECT * EXCLUDE (repos) FROM live WHERE k = 3),
names AS (SELECT doc_id, string_agg(['assign', 'access', 'hex', 'live'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM shown GROUP BY 1),
digest AS (SELECT doc_id, string_agg(['assign', 'access', 'hex'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, count_if(k = 0) AS n0, count_if(k = 1) AS n1, count_if(k = 2) AS n2 FROM base GROUP BY 1),
alive AS (SELECT doc_id, count(*) AS n, max(repos) AS repos FROM live GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(digest.spans, '')) AS base_sha256, coalesce(names.spans, '') AS spans, coalesce(alive.n, 0) AS n_live, coalesce(alive.repos, 0) AS n_repositories
FROM d LEFT JOIN digest USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN alive USING (doc_id)"""

ORACLES: dict[str, str] = {"op3_embedding_dedup": OP3_SQL, "op8_secret_scan": OP8_SQL}
