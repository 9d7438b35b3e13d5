"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import html_text, langid, licenses, mixing, neighbours, packing, secrets, simhash, sketch, warc
from ledgerloom.llm.common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.digests(warc.read_archives(spark, path))


def repository(docs: DataFrame) -> DataFrame:
    """documents as files of repositories: a source is one, of directories of 1,000 and in them of 10 documents; the
    first document of each is its directory's licence file."""
    upper, lower = F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 10) % 100
    place = F.when(F.col("doc_id") % 1000 == 0, F.concat(upper.cast("string"), F.lit("/LICENSE"))).when(F.col("doc_id") % 10 == 0, F.concat_ws("/", upper, lower, F.lit("LICENSE"))).otherwise(F.concat_ws("/", upper, lower, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), place).alias("path"), "text")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(repository(table(spark, sf_dir, "documents")), ["doc_id"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), doc_weight=mixing.length_weight(F.col("size")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_html": op4_html,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_language": op7_language,
    "op8_neighbours": op8_neighbours,
    "op9_secrets": op9_secrets,
    "op10_fingerprints": op10_fingerprints,
}

_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept
  FROM pages
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM kept THEN NULL ELSE kept END AS refers_to
FROM p
"""

#: Documents in order of rank while they fit, in rounds from one that is passed over to the next; then the smallest one
#: left, if it misses the target by less than the gap.
_MIXING_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
v AS (SELECT *, CAST(length(bin(size)) AS DOUBLE) AS weight FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
      FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN cap <= level * weight THEN cap ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target FROM l),
k AS (SELECT source, weight, CAST(sum(size) AS BIGINT) AS words FROM v GROUP BY source, weight),
e AS (SELECT k.*, source_size, target, (target - 2.0::DOUBLE * coalesce(sum(words) OVER heavier, 0)) / nullif(sum(k.weight * words) OVER lighter, 0) AS level
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
      WINDOW heavier AS (PARTITION BY k.source ORDER BY k.weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lighter AS (PARTITION BY k.source ORDER BY k.weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, CASE WHEN level * weight >= 2 THEN 2.0::DOUBLE ELSE coalesce(max(CASE WHEN level * weight < 2 THEN level END) OVER (PARTITION BY source) * weight, 2.0::DOUBLE) END AS times FROM e),
g AS (SELECT *, CAST(floor(times) AS BIGINT) AS sure, times - floor(times) AS p FROM f),
n AS (SELECT source, CAST(round(any_value(target) - sum(sure * words)) AS BIGINT) AS need FROM g GROUP BY source),
u AS (SELECT v.*, source_size, target, sure, p,
             (CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM v JOIN g ON v.source IS NOT DISTINCT FROM g.source AND v.weight = g.weight),
r AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS rank FROM u),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size) AS place FROM r),
walk(source, lo, cap, hi, rest) AS (
  SELECT source, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), need FROM n
  UNION ALL
  SELECT source, lo, cap, coalesce(min(place) FILTER (upto > cap), CAST(4e18 AS BIGINT)), CAST(cap - coalesce(max(upto) FILTER (upto <= cap), 0) AS BIGINT)
  FROM (SELECT c.source, walk.hi AS lo, walk.rest AS cap, place, sum(size) OVER (PARTITION BY c.source ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto
        FROM walk JOIN c ON c.source IS NOT DISTINCT FROM walk.source AND place > walk.hi AND size <= walk.rest AND rank IS NOT NULL) GROUP BY source, lo, cap),
x AS (SELECT c.*, EXISTS (SELECT 1 FROM walk WHERE walk.source IS NOT DISTINCT FROM c.source AND place > lo AND place < hi AND size <= cap AND rank IS NOT NULL) AS extra FROM c),
gap AS (SELECT source, min(rest) AS gap FROM walk GROUP BY source),
last AS (SELECT x.source, arg_min(place, struct_pack(a := size, b := place)) AS place FROM x JOIN gap ON x.source IS NOT DISTINCT FROM gap.source
         WHERE NOT extra AND rank IS NOT NULL AND gap > 0 AND size < 2 * gap GROUP BY x.source)
SELECT x.doc_id, x.size, x.source_size, x.target, CAST(x.size * (sure + CASE WHEN extra OR last.place IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x LEFT JOIN last ON x.source IS NOT DISTINCT FROM last.source AND x.place = last.place
"""

def licences_sql() -> str:
    """The licence scan in full, without bounds or prefilters; the templates' terms are stated as rows."""
    wanted = licenses.template_terms(licenses.TEMPLATES)
    rows = ", ".join(f"({i}, '{name}', '{t}', {n})" for i, (name, c) in enumerate(wanted) for t, n in sorted(c.items()))
    is_file = "regexp_matches(path, '(?i)(^|/)(licen[sc]e|copying|unlicense)([.-][^/]*)?$')"
    runs = lambda pattern: f"regexp_split_to_array(array_to_string(list_transform(cut, lambda x: CASE WHEN regexp_matches(x, '{pattern}') THEN x ELSE '' END), chr(10)), '\\n\\n+')"
    return f"""
WITH template(v, name, term, n) AS (VALUES {rows}),
files AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'none') || '/' || CASE
    WHEN doc_id % 1000 = 0 THEN (doc_id // 1000) || '/LICENSE'
    WHEN doc_id % 10 = 0 THEN (doc_id // 1000) || '/' || (doc_id // 10 % 100) || '/LICENSE'
    ELSE (doc_id // 1000) || '/' || (doc_id // 10 % 100) || '/' || doc_id || '.txt' END AS path FROM documents),
cuts AS (SELECT *, string_split(text, chr(10)) AS cut FROM files),
spans AS (SELECT *, list_concat(cut, {runs(licenses.WORDY)}) AS span, {runs(licenses.COMMENT)} AS comments FROM cuts),
cutted AS (SELECT doc_id, unnest(list_distinct(list_concat(span, comments, flatten(list_transform(span, lambda x: regexp_split_to_array(x, '[.!?;][ \\t\\n\\r]+'))), CASE WHEN {is_file} THEN [text] ELSE [] END))) AS line FROM spans),
blocks AS (SELECT doc_id, line, row_number() OVER () AS b FROM cutted),
lines AS (SELECT unnest(cut) AS line FROM cuts),
line_words AS (SELECT unnest(list_distinct(regexp_split_to_array(translate(line, '{licenses.UPPER}', '{licenses.LOWER}'), '[^a-z0-9]+'))) AS w FROM lines),
df AS (SELECT w, count(*) AS df FROM line_words GROUP BY w),
words AS (SELECT doc_id, b, unnest(regexp_split_to_array(translate(line, '{licenses.UPPER}', '{licenses.LOWER}'), '[^a-z0-9]+')) AS w FROM blocks),
tf AS (SELECT doc_id, b, w, count(*) AS tf FROM words WHERE w <> '' GROUP BY ALL),
total AS (SELECT count(*) AS lines FROM lines),
idf AS (SELECT term, ln((1 + lines) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM template) CROSS JOIN total LEFT JOIN df ON w = term),
weighed AS (SELECT tf.*, coalesce(idf, ln(1 + lines) + 1) AS idf FROM tf CROSS JOIN total LEFT JOIN idf ON w = term),
norm AS (SELECT b, sqrt(sum((tf * idf) ** 2)) AS norm FROM weighed GROUP BY b),
whole AS (SELECT v, sqrt(sum((n * idf) ** 2)) AS whole FROM template JOIN idf USING (term) GROUP BY v),
dot AS (SELECT doc_id, b, v, name, sum(tf * n * idf ** 2) AS dot FROM weighed JOIN template ON w = term GROUP BY doc_id, b, v, name),
score AS (SELECT doc_id, v, name, round(dot / (norm * whole), {licenses.DECIMALS}) AS score FROM dot JOIN norm USING (b) JOIN whole USING (v)),
own AS (SELECT doc_id, arg_min(name, struct_pack(s := -score, v := v)) AS own_license, max(score) AS own_score FROM score WHERE score >= 0.6 GROUP BY doc_id),
mine AS (SELECT files.doc_id, path, own_license, own_score, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files LEFT JOIN own USING (doc_id)),
given AS (SELECT dir, min(struct_pack(s := -own_score, p := path, n := own_license)) AS best FROM mine WHERE own_license IS NOT NULL AND {is_file} GROUP BY dir),
up AS (SELECT doc_id, k AS distance, array_to_string(string_split(dir, '/')[1 : len(string_split(dir, '/')) - k], '/') AS above
    FROM (SELECT doc_id, dir, unnest(range(len(string_split(dir, '/')) + 1)) AS k FROM mine WHERE own_license IS NULL)),
near AS (SELECT doc_id, min(struct_pack(d := distance, p := best.p, n := best.n)) AS near FROM up JOIN given ON above = given.dir GROUP BY doc_id)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, near.n) AS license,
       CASE WHEN own_license IS NOT NULL THEN path ELSE near.p END AS license_path,
       CAST(CASE WHEN own_license IS NOT NULL THEN 0 ELSE near.d END AS BIGINT) AS distance
FROM mine LEFT JOIN near USING (doc_id)
"""


#: Matches and what lies between them give the positions. SQL can't check the checksums of the kinds that the method adds;
#: spans are right for tables without such tokens, as the test tables are.
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS_SQL = r"""
WITH p(kind, n, least) AS (VALUES ('assign', 0, 6), ('access', 1, 20), ('hex', 2, 24)),
d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
m AS (
  SELECT doc_id, r, kind, n, least, regexp_extract_all(t, '{assign}') AS whole,
         regexp_extract_all(t, '{assign}', 2) AS part, regexp_split_to_array(t, '{assign}') AS between
  FROM d JOIN p ON kind = 'assign'
  UNION ALL SELECT doc_id, r, kind, n, least, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM d JOIN p ON kind = 'access'
  UNION ALL SELECT doc_id, r, kind, n, least, regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_split_to_array(t, '[0-9a-f]{24,}') FROM d JOIN p ON kind = 'hex'),
i AS (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM m),
s AS (SELECT r, kind, n, CAST(length(array_to_string(between[1:k], '')) + length(array_to_string(whole[1:k - 1], '')) AS BIGINT) AS a, length(whole[k]) AS size FROM i WHERE length(part[k]) >= least),
j AS (SELECT r, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex, string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, n) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (r)
""".replace("{assign}", _ASSIGN)

SQL: dict[str, str] = {"op1_warc": _WARC_SQL, "op2_licenses": licences_sql(), "op5_mixing": _MIXING_SQL, "op9_secrets": _SECRETS_SQL}
