"""The queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from . import audit, decontaminate, exact_dedup, jaccard_join, language, near_dedup, packing, pii, quality, secrets, sharding, substrings, vector_codes
from .common import read


def op1_secrets(spark, sf_dir):
    return secrets.op1_secrets(read(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing.op2_packing(read(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii.op3_pii(read(spark, sf_dir, "documents"))


def op4_language(spark, sf_dir):
    return language.op4_language(read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark, sf_dir):
    return substrings.op5_suffix_dedup(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(read(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.op7_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.op8_decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_sharding(spark, sf_dir):
    return sharding.shard(read(spark, sf_dir, "documents"))


def op10_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"), near_dedup.Settings(words=3, percent=85, bands=28, rows=6))


def op11_audit(spark, sf_dir):
    return audit.op11_audit(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.op12_vector_codes(read(spark, sf_dir, "embeddings"))


def op13_jaccard_join(spark, sf_dir):
    return jaccard_join.op13_jaccard_join(read(spark, sf_dir, "documents"))


_ALL = (op1_secrets, op2_packing, op3_pii, op4_language, op5_suffix_dedup, op6_exact_dedup, op7_quality, op8_decontaminate, op9_sharding, op10_near_dedup, op11_audit, op12_vector_codes, op13_jaccard_join)
QUERIES = {f.__name__: f for f in _ALL}
_ROUND = """c{k} AS MATERIALIZED (SELECT part, e, dim, coalesce((s - ((s % m + m) % m)) // m, x) AS x FROM {before} LEFT JOIN (SELECT part, e, dim, sum(x) AS s, count(*) AS m FROM p JOIN (
SELECT r, part, min(struct_pack(d := d, e := e)).e AS e FROM (SELECT r, part, e, sum((p.x - c.x) * (p.x - c.x)) AS d FROM p JOIN {before} c USING (part, dim) GROUP BY r, part, e) GROUP BY r, part) USING (r, part) GROUP BY part, e, dim) USING (part, e, dim)),"""
SQL: dict[str, str] = {
    "op6_exact_dedup": """WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT t, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op8_decontaminate": """WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, least(10, len(w)) AS n, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0), q AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS phrase FROM p),
o AS (SELECT doc_id, n, i, w[i:i + n - 1] AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q))),
h AS (SELECT doc_id, item_id, o.n, i FROM o JOIN q ON o.phrase = q.phrase AND o.n = q.n), x AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)""",
    "op9_sharding": """WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), b AS (SELECT doc_id, len(h) // 2 + 1 AS size, list_transform(range(0, len(h), 2), lambda i: CAST('0x' || h[i + 1:i + 2] AS BIGINT)) AS b FROM h),
r AS (SELECT doc_id, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4096 AS INTEGER) AS virtual_slot FROM b, t),
s AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS k FROM (SELECT virtual_slot, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM r GROUP BY virtual_slot)),
m AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS INTEGER) AS virtual_slot, CAST(NULL AS INTEGER) AS shard, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS loads, CAST(0 AS BIGINT) AS n UNION ALL
SELECT s.k, s.virtual_slot, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER), list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + s.bytes ELSE x END), s.n FROM m JOIN s ON s.k = m.k + 1),
p AS (SELECT virtual_slot, shard, sum(n) OVER (PARTITION BY shard ORDER BY virtual_slot) - n AS before FROM m WHERE k > 0)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(before + row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, virtual_slot, 1 AS map_version FROM r JOIN p USING (virtual_slot)""",
    "op10_near_dedup": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS g FROM w), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id, doc_id AS v FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.v = e.a), m AS (SELECT doc_id, min(v) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON m.doc_id = n.doc_id""",
    "op11_audit": """WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY lang, source, term),
k AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING sum(docs) >= 10), v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d), c AS MATERIALIZED (SELECT g.lang, g.source, k.term, CAST(coalesce(t.n, 0) AS HUGEINT) AS n, k.n AS n_lang FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS MATERIALIZED (SELECT c.lang, c.source, c.term, c.n, CAST(1 + 1000000000 * (c.n + 2) // (s.n + 2 * v.v) AS BIGINT) AS p, CAST(1 + 1000000000 * (c.n_lang + 2) // (v.n + 2 * v.v) AS BIGINT) AS q FROM c JOIN s USING (lang, source) JOIN v ON v.lang = c.lang),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM r) WHERE part = 'pair' OR k <= 10""",
    "op12_vector_codes": f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, i // w AS part, i % w AS dim, v[i + 1] AS x FROM (SELECT r, v, len(v) // 8 AS w, unnest(range(len(v))) AS i FROM v)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS e, dim, x FROM p WHERE r <= 16),
{chr(10).join(_ROUND.format(k=k, before=f"c{k - 1}") for k in range(1, 7))}
a AS (SELECT r, part, min(struct_pack(d := d, e := e)) AS m FROM (SELECT r, part, e, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM p JOIN c6 c USING (part, dim) GROUP BY r, part, e) GROUP BY r, part),
o AS (SELECT r, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, dim)) FROM c6) AS codebooks_sha256 FROM v JOIN o USING (r)""",
    "op13_jaccard_join": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS g FROM w), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id, doc_id AS v FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.v = e.a), m AS (SELECT doc_id, min(v) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM m LEFT JOIN n ON m.doc_id = n.doc_id""",
}
