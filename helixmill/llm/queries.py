"""Registered queries of this subpackage, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from helixmill.llm.common import table

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_winnowing_decontamination(spark, sf_dir):
    from helixmill.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = rf"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM b)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


def op9_bitmask_language_id(spark, sf_dir):
    from helixmill.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_bottom_k_near_dedup(spark, sf_dir):
    from helixmill.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
       ELSE list_transform(range(0, len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM both_ JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
s AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, s.y FROM reach JOIN s ON s.x = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""


def op7_harmonic_packing(spark, sf_dir):
    from helixmill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op8_boosted_pii(spark, sf_dir):
    from helixmill.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op6_brown_lm(spark, sf_dir):
    from helixmill.llm.brown_lm import score

    return score(table(spark, sf_dir, "documents"))


def op3_sharded_warc(spark, sf_dir):
    from helixmill.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


#: A hex digit's bits, then each 5 bits as a letter of the base-32 alphabet.
OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, lower(sha1(b)) AS hex FROM p),
d AS (SELECT page_id, n, array_to_string(list_transform(range(0, 40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * CAST(instr('0123456789abcdef', substr(hex, CAST(i + 1 AS INTEGER), 1)) - 1 AS INTEGER) + 1, 4)), '') AS bits FROM h),
e AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
        + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INTEGER), 1) AS INTEGER)
        + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INTEGER), 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INTEGER), 1) AS INTEGER)
        + CAST(substr(bits, CAST(5 * i + 5 AS INTEGER), 1) AS INTEGER), 1)), '') AS digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM e)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def op2_html_rendering(spark, sf_dir):
    from helixmill.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op5_collision_counting_ann(spark, sf_dir):
    from helixmill.llm.ann import search_every_50th

    return search_every_50th(table(spark, sf_dir, "embeddings"))


def op4_minhash_license_scan(spark, sf_dir):
    from helixmill.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql():
    sql = {k[2:].split("_")[0]: v for k, v in globals().items() if k.startswith("OP") and k.endswith("_SQL")}
    return {k: sql[n] for k in queries() if (n := k[2:].split("_")[0]) in sql}
