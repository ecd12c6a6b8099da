"""The subpackage's queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, line_dedup, near_dup, quality, repeats, secrets, token_counts, top_k, url_filter
from .common import table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_line_dedup, op3_secrets, op4_near_dup, op5_repeats, op6_quality, op7_token_counts, op8_decontamination, op9_url_filter, op10_top_k)}


def _rules(host: str, path: str, what: str) -> str:
    """CASE over the rules, the longest first."""
    out = "CASE"
    for act, h, p in sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), r)):
        out += f" WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND starts_with({path}, '{p}') THEN '{h + p if what == 'rule' else act}'"
    return out + " END"


_LOWER = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"
_SECOND = "|".join(url_filter.SECOND)
_STRENGTH = "coalesce(greatest(1.0, least(1000.0, sum(n * prior * (1 - prior)) / greatest(1e-6, sum(n * (bad / n - prior) * (bad / n - prior))) - 1)), 1.0)"
_SHRUNK = "(prior * s + bad) / (s + n) AS mean, s + n AS w"

URL_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
t AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM u),
l AS (SELECT *, regexp_extract(site, '([^.]+\\.[^.]+)$', 1) AS last2 FROM t),
x AS (SELECT *, CASE WHEN regexp_matches(last2, '^({_SECOND})\\.[a-z][a-z]$') THEN last2 ELSE regexp_extract(site, '([^.]*)$', 1) END AS suffix FROM l),
d0 AS (SELECT *, CASE WHEN last2 = suffix THEN regexp_extract(site, '([^.]+\\.[^.]+\\.[^.]+)$', 1) ELSE last2 END AS dom FROM x),
urls AS (SELECT page_id, host, path, site, suffix, CASE WHEN dom = '' THEN site ELSE dom END AS domain FROM d0),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 OR toxic = 0 THEN 0 END) AS bad FROM labels GROUP BY doc_id),
seen AS (SELECT DISTINCT page_id, site, domain, suffix FROM urls WHERE site <> ''),
h AS (SELECT site, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM seen JOIN marks ON page_id = doc_id WHERE bad IS NOT NULL GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
f AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
fp AS (SELECT *, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM f) AS prior FROM f),
fm AS (SELECT *, {_SHRUNK} FROM fp, (SELECT {_STRENGTH} AS s FROM fp)),
dp AS (SELECT d.*, fm.mean AS prior FROM d JOIN fm USING (suffix)),
dm AS (SELECT *, {_SHRUNK} FROM dp, (SELECT {_STRENGTH} AS s FROM dp)),
hp AS (SELECT h.*, dm.mean AS prior FROM h JOIN dm ON h.domain = dm.domain AND h.suffix = dm.suffix),
hm AS (SELECT *, {_SHRUNK} FROM hp, (SELECT {_STRENGTH} AS s FROM hp)),
low AS (SELECT 1 AS k, site AS name, mean - {url_filter.Z} * sqrt(mean * (1 - mean) / (w + 1)) >= {url_filter.BOUND} AS b FROM hm
  UNION ALL SELECT 2, domain, mean - {url_filter.Z} * sqrt(mean * (1 - mean) / (w + 1)) >= {url_filter.BOUND} FROM dm
  UNION ALL SELECT 3, suffix, mean - {url_filter.Z} * sqrt(mean * (1 - mean) / (w + 1)) >= {url_filter.BOUND} FROM fm)
SELECT page_id, host, path, {_rules("host", "path", "rule")} AS rule,
  coalesce({_rules("host", "path", "verdict")}, CASE WHEN site <> '' AND coalesce(a.b, c.b, e.b) THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN low a ON a.k = 1 AND a.name = site LEFT JOIN low c ON c.k = 2 AND c.name = domain LEFT JOIN low e ON e.k = 3 AND e.name = suffix"""

TOP_K_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.n <> q.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') END AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM d, lens)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

LINES_SQL = """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, line, trim(raw, ' ' || chr(9) || chr(13)) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos,
  len(regexp_extract_all(trim(raw, ' ' || chr(9) || chr(13)), '\\S+')) AS nw FROM l WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''),
w AS (SELECT doc_id, pos, line AS a, lead(line, 2) OVER o AS b, x || chr(10) || lead(x) OVER o || chr(10) || lead(x, 2) OVER o AS k FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
  UNION ALL SELECT doc_id, pos, line, line, '1' || chr(10) || x FROM s WHERE nw >= 50
  UNION ALL SELECT doc_id, pos, line, b, k FROM (SELECT *, nw + lead(nw) OVER o AS two, lead(line) OVER o AS b, '2' || chr(10) || x || chr(10) || lead(x) OVER o AS k FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE two >= 50),
g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM w WHERE k IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS line FROM g WHERE n > 1),
m AS (SELECT l.doc_id, l.line, l.raw, gone.line IS NOT NULL AS cut, lag(gone.line IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.line) AS was FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line = l.line),
r AS (SELECT doc_id, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) AS BIGINT) AS n_removed, CAST(sum(CASE WHEN cut AND NOT coalesce(was, FALSE) THEN 1 ELSE 0 END) AS BIGINT) AS n_runs,
  coalesce(string_agg(CASE WHEN NOT cut THEN raw END, chr(10) ORDER BY line), '') AS kept, count(*) AS n_lines FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN 0 ELSE r.n_lines END AS n_lines, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_runs, 0) AS n_runs, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINES_SQL, "op8_decontamination": DECONTAMINATION_SQL, "op9_url_filter": URL_SQL, "op10_top_k": TOP_K_SQL}
