"""One query per operator over the whole test tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ballast.llm.archive import page_records
from ballast.llm.conversations import conversation_prefixes
from ballast.llm.decontamination import document_contamination
from ballast.llm.exact_duplicates import document_copies
from ballast.llm.fill_in_middle import document_rewrites
from ballast.llm.language import document_languages
from ballast.llm.licenses import document_licenses
from ballast.llm.near_duplicates import document_duplicates
from ballast.llm.nearest import nearest_embeddings
from ballast.llm.packing import pack_documents
from ballast.llm.personal_data import document_personal_data
from ballast.llm.quality import document_quality
from ballast.llm.style_tree import main_text
from ballast.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return document_personal_data(table(spark, folder, "documents"))


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return document_licenses(table(spark, folder, "documents"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return page_records(table(spark, folder, "pages"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return document_languages(table(spark, folder, "documents"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return document_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return document_duplicates(table(spark, folder, "documents"))


def op9_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_embeddings(table(spark, folder, "embeddings"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return document_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return document_rewrites(table(spark, folder, "documents"))


def op12_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return document_copies(table(spark, folder, "documents"))


def op13_conversation_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_prefixes(table(spark, folder, "conversations"))


def queries() -> dict[str, Query]:
    found = (
        op1_personal_data, op2_licenses, op3_warc, op4_language_id, op5_packing,
        op6_decontamination, op7_main_text, op8_near_duplicates, op9_nearest, op10_quality,
        op11_fill_in_middle, op12_exact_duplicates, op13_conversation_prefixes,
    )
    return {f.__name__: f for f in found}


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM r),
k AS (SELECT *, payload_bytes >= 100 AND least IS NOT NULL AND page_id IS DISTINCT FROM least AS again FROM m)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN least END AS refers_to
FROM k
"""

CONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, n, i, item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
      FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r),
bt AS (SELECT q, item_id, n, s, unnest(range(s, s + n)) AS ipos, unnest(w[s:s + n - 1]) AS term
       FROM (SELECT q, item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
             FROM (SELECT row_number() OVER () AS q, item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dp AS (SELECT r, pos, term FROM (SELECT r, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM bt)),
tf AS (SELECT term, count(*) AS tf FROM dp GROUP BY term),
wt AS (SELECT *, row_number() OVER (PARTITION BY q, s ORDER BY tf NULLS LAST, ipos) AS k, count(tf) OVER (PARTITION BY q, s) AS there
       FROM bt LEFT JOIN tf USING (term)),
wo AS (SELECT *, CASE WHEN n < 10 THEN n ELSE 9 END AS need FROM wt WHERE tf IS NOT NULL AND there >= 2 AND there >= CASE WHEN n < 10 THEN n ELSE 9 END),
pr AS (SELECT x.q, x.s, x.ipos AS p1, x.term AS t1, y.ipos AS p2, y.term AS t2 FROM wo x JOIN wo y ON x.q = y.q AND x.s = y.s AND x.k < y.k AND y.k <= x.n - x.need + 2),
ca AS (SELECT DISTINCT q, s, x.r, x.pos - p1 AS d1 FROM pr JOIN dp x ON x.term = t1 JOIN dp y ON y.term = t2 AND y.r = x.r
       WHERE abs((x.pos - p1) - (y.pos - p2)) <= 5),
ne AS (SELECT ca.r, item_id FROM ca JOIN wo ON wo.q = ca.q AND wo.s = ca.s
       JOIN dp ON dp.r = ca.r AND dp.term = wo.term AND abs(dp.pos - wo.ipos - d1) <= 5
       GROUP BY ca.r, ca.q, ca.s, d1, item_id, need HAVING count(DISTINCT wo.ipos) >= need),
m AS (SELECT r, count(*) AS n_near FROM (SELECT DISTINCT r, item_id FROM ne) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r) LEFT JOIN m USING (r)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM w),
g AS (SELECT list_sort(s) AS s, min(r) AS k FROM s WHERE len(s) > 0 GROUP BY 1),
e AS (SELECT k, len(s) AS n, unnest(s) AS x FROM g),
p AS (
  SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.x = b.x AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT k, k FROM g),
reach(a, b) AS (SELECT a, b FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
m AS (SELECT g.k, s.r, s.doc_id, len(s.s) AS n FROM s JOIN g ON list_sort(s.s) = g.s),
f AS (SELECT reach.a AS k, min(m.doc_id) AS component_id FROM reach JOIN m ON reach.b = m.k GROUP BY 1)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles, component_id, m.doc_id IS NOT DISTINCT FROM component_id AS kept FROM m JOIN f USING (k)
UNION ALL
SELECT doc_id, 0, doc_id, true FROM s WHERE len(s) = 0
"""


FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
n AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

EXACT_DUPLICATES = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""

CONVERSATION_PREFIXES = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST,
                       sha256(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text)) AS turns FROM t GROUP BY 1),
h AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS base, CAST(xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))) AS BIGINT) % 6 AS h FROM o),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN o b ON b.conv_id = h.base),
p AS (
  SELECT conv_id, len(turns) AS n, d, turns[1:d] AS key, turns[1:d - 1] AS up, d = len(turns) AS ends
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
g AS (
  SELECT key, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends,
         (count(*) - 1) * coalesce(length(key[-1].text), 0) AS own FROM p GROUP BY key, d),
c AS (SELECT up AS key, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
a AS (SELECT key[1:i] AS key, own, key IN (SELECT key FROM c) AS inner_node FROM (SELECT key, own, unnest(range(0, d + 1)) AS i FROM g)),
s AS (SELECT key, sum(own) AS saved_tokens, count(*) FILTER (NOT inner_node) AS n_leaves FROM a GROUP BY 1)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, CASE WHEN g.d > 0 THEN u.conv_id END AS parent_conv_id, CAST(g.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN s ON s.key = g.key LEFT JOIN c ON c.key = g.key LEFT JOIN g u ON u.key = g.up AND u.d = g.d - 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": WARC,
        "op6_decontamination": CONTAMINATION,
        "op8_near_duplicates": NEAR_DUPLICATES,
        "op11_fill_in_middle": FILL_IN_MIDDLE,
        "op12_exact_duplicates": EXACT_DUPLICATES,
        "op13_conversation_prefixes": CONVERSATION_PREFIXES,
    }
