"""The queries of this package, their SQL where SQL can express them, over tables in a folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunked_bpe, collocations, exact_dedup, lattice, line_dedup, mixing, ngram_join, pieces, quality, quotes, url_filter, va_means, warc

#: Vocabularies of public tokenizers, not part of this repository.
PIECES = os.environ.get("TRIBUNE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
WORD_BPE = os.environ.get("TRIBUNE_WORD_BPE", "/opt/tokenizers/word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, pieces.read_model(PIECES), check=True)
    return encoded.select("doc_id", "ids", "n_tokens", "round_trip")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("group_id").alias("class_id"), "n_links", "kept")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda k: ws[k:k + 4])) AS shingle FROM w WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE shared.n >= 0.8 * (p.n + q.n - shared.n) - 1e-9),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links, doc_id = class_id AS kept FROM w JOIN least ON least.x = doc_id LEFT JOIN counted ON counted.x = doc_id
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.judge(pages, url_filter.RULES).select("page_id", "host", "path", "rule", "verdict")


#: The rules for all pages, and the method for tables without links between hosts, as those given are: scores are then the marks' own. Links are tested
#: against a plain version in tests/llm.
OP3_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{url_filter._UPPER}', '{url_filter._LOWER}') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, '/' || substr(rule, strpos(rule, '/') + 1) AS rule_path
      FROM (VALUES {", ".join(f"('{rule}', '{verdict}')" for rule, verdict in url_filter.RULES)}) AS t(rule, verdict)),
h AS (
  SELECT host, coalesce(bool_or(verdict = 'allow'), false) AS trusted, coalesce(bool_or(verdict = 'block' AND rule_path = '/'), false) AS blocked
  FROM (SELECT DISTINCT host FROM p WHERE host <> '') LEFT JOIN r ON ends_with('.' || host, '.' || rule_host) GROUP BY host),
n AS (SELECT count(*) AS hosts, greatest(count(*) FILTER (trusted), 1) AS n_trusted, greatest(count(*) FILTER (blocked), 1) AS n_blocked FROM h),
m AS (SELECT host, CASE WHEN blocked AND NOT (trusted AND 1 / n_trusted >= 1 / n_blocked) AND hosts / n_blocked >= {url_filter.THRESHOLD} THEN 'block' ELSE 'allow' END AS own FROM h, n),
f AS (SELECT page_id, rule, verdict FROM p JOIN r ON ends_with('.' || host, '.' || rule_host) AND starts_with(path, rule_path)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, own, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id) LEFT JOIN m USING (host)
"""


def op4_embedding_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(
        "vec_id", "n_links", F.col("group_id").alias("component_id"), "kept"
    )


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE x = e.vec_id) AS n_links,
       (SELECT min(y) FROM reach WHERE x = e.vec_id) AS component_id,
       (SELECT min(y) FROM reach WHERE x = e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""


def op5_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: For conversations in which nobody quotes, as those given are: every turn replies to the one before. Quotations are tested against recursion.
OP5_SQL = """
SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_turn, false AS quotes,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position
FROM conversations
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    weights = quality.train(docs, table(spark, sf_dir, "labels"), learnable=~held)
    return quality.score(docs, weights).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, folder = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(archives, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), mixing.TARGETS)


#: For rates up to mixing.MOST_RATE, beyond which they are split (tested against a plain version in tests/llm).
OP10_SQL = f"""
WITH targets AS (SELECT * FROM (VALUES {", ".join(f"('{source}', {share!r}::DOUBLE)" for source, share in mixing.TARGETS.items())}) AS t(source, given)),
sizes AS (
  SELECT d.source, sum(CASE WHEN n_chars > 0 THEN n_chars ELSE length(coalesce(text, '')) END)::DOUBLE AS size, any_value(given) AS given
  FROM documents d LEFT JOIN targets t ON t.source = d.source GROUP BY d.source),
totals AS (
  SELECT sum(size) AS total, sum(CASE WHEN given IS NULL THEN size END) AS others, coalesce(sum(given), 0) AS told,
         greatest(0, 1 - (SELECT sum(given) FROM targets)) AS rest
  FROM sizes WHERE size > 0),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN coalesce(given, rest * size / others) / (told + CASE WHEN others > 0 THEN rest ELSE 0 END) * total / size ELSE 0 END AS rate
  FROM sizes, totals),
terms AS (
  SELECT source, k, sum(exp(-rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) END - lgamma(k + 1)))
         OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM rates, generate_series(0, (SELECT ceil(max(rate) + 12 * sqrt(max(rate)) + 20)::BIGINT FROM rates)) AS g(k) WHERE rate > 0),
placed AS (
  SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{mixing.SEED}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents),
counted AS (
  SELECT p.doc_id, p.text, p.lang, p.source, p.n_chars,
         (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM p.source AND t.cdf < p.u) AS n
  FROM placed p)
SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, n))::INTEGER AS replica FROM counted WHERE n > 0
"""

def op11_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunked_bpe.encode(docs, chunked_bpe.read_model(WORD_BPE), digests=True)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP12_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{url_filter._UPPER}', '{url_filter._LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
sized AS (SELECT lang, ws, unnest(range(1, {collocations.LONGEST + 1})) AS size FROM w),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM sized),
f AS (SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM grams GROUP BY lang, size, phrase HAVING count(*) >= {collocations.SUPPORT}),
cuts AS (SELECT lang, phrase, size, f AS a, ws, unnest(range(1, size)) AS k FROM f WHERE size >= 2),
scores AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, c.k, (2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, f, unnest(list_transform(range(1, size - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS phrase
  FROM (SELECT lang, size, f, ws, unnest(range(2, size)) AS n FROM f WHERE size >= 3)),
covered AS (SELECT lang, phrase, max(f) AS most FROM inner_ GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score::BIGINT AS score
FROM best b JOIN totals USING (lang) LEFT JOIN covered c ON c.lang = b.lang AND c.phrase = b.phrase
WHERE most IS NULL OR 100::HUGEINT * most < {collocations.COVERED}::HUGEINT * a
QUALIFY rank <= {collocations.TOP}
"""


def op13_va_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_means.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _op13_sql(k: int = va_means.CENTROIDS, rounds: int = va_means.ROUNDS, dimensions: int = va_means.DIMENSIONS, scale: int = va_means.SCALE) -> str:
    """Each round as two common table expressions: assignments, and centroids as one row per centroid."""
    own = lambda r: f"""a{r} AS (
  SELECT v.vec_id, v.x, arg_min(c.k, (list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.k)) AS k,
         min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d
  FROM v, c{r} c GROUP BY v.vec_id, v.x)"""  # noqa: E731
    mean = lambda r: f"""m{r} AS (
  SELECT k, list(x ORDER BY i) AS x FROM (
    SELECT k, i, floor_div(sum(x), count(*)) AS x FROM (SELECT k, unnest(x) AS x, unnest(range(1, {dimensions + 1})) AS i FROM a{r}) GROUP BY k, i) GROUP BY k),
c{r + 1} AS (SELECT c{r}.k, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (k))"""  # noqa: E731
    steps = ",\n".join(f"{own(r)},\n{mean(r)}" for r in range(rounds))
    text = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x FROM v ORDER BY k LIMIT {k}),
{steps},
{own(rounds)}
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (k)
"""
    return text.replace("floor_div(sum(x), count(*))", "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT")


OP13_SQL = _op13_sql()

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_url_filter": op3_url_filter,
    "op4_embedding_lattice": op4_embedding_lattice,
    "op5_chat_quotes": op5_chat_quotes,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_fuzzy_lines": op7_fuzzy_lines,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc": op9_warc,
    "op10_poisson_mixing": op10_poisson_mixing,
    "op11_chunked_bpe": op11_chunked_bpe,
    "op12_collocations": op12_collocations,
    "op13_va_means": op13_va_means,
}
ORACLES = {
    "op2_ngram_jaccard": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op4_embedding_lattice": OP4_SQL,
    "op5_chat_quotes": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op9_warc": OP9_SQL,
    "op10_poisson_mixing": OP10_SQL,
    "op12_collocations": OP12_SQL,
    "op13_va_means": OP13_SQL,
}
