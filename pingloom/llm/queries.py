"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pingloom.llm import ann, fingerprints, merkle, metric, mixing, neardup, packing, pii, quality, secrets, trie, urls, warc
from pingloom.session import pin_session, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(lambda table: pin_session(spark).read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            SQL[name] = sql
        return build

    return register


_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, true AS intact
FROM f
"""


@query("op1_warc_chain", _WARC)
def op1(read):
    pages = read("pages")
    return warc.report(pages, f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}")


@query("op2_paragraph_iblt")
def op2(read):
    return fingerprints.report(read("documents"))


_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS i FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN t tx ON x = tx.doc_id JOIN t ty ON y = ty.doc_id WHERE i::DOUBLE / (tx.total + ty.total - i) >= 0.8
      UNION ALL SELECT m, doc_id FROM w, (SELECT min(doc_id) AS m FROM w WHERE len(ws) = 0) WHERE len(ws) = 0 AND doc_id > m),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, least(doc_id, coalesce(first, doc_id)) AS group_id, doc_id <= coalesce(first, doc_id) AS kept
FROM documents LEFT JOIN (SELECT a, min(b) AS first FROM r GROUP BY a) ON a = doc_id
"""


@query("op3_bagminhash_near_duplicates", _NEAR)
def op3(read):
    return neardup.report(read("documents"))


@query("op4_raked_mix")
def op4(read):
    return mixing.report(read("documents"))


# The rules are stated as a table here, not taken from the operator.
_URLS = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (
  SELECT page_id, url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS n FROM pages),
parts AS (
  SELECT page_id, url, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n),
shaped AS (
  SELECT n, CASE
    WHEN regexp_matches(url, '[?&]utm_source=feed([&#]|$)') THEN '~[?&]utm_source=feed(?:[&#]|$)'
    WHEN regexp_matches(url, '[?&](sid|sessionid|phpsessid)=[0-9A-Za-z]{8,}') THEN '~[?&](?:sid|sessionid|phpsessid)=[0-9A-Za-z]{8,}'
    WHEN regexp_matches(url, '/cart/(add|remove)[/?]') THEN '~/cart/(?:add|remove)[/?]'
    WHEN regexp_matches(url, '/wp-login\.php') THEN '~/wp-login\.php'
    WHEN regexp_matches(url, '[?&]replytocom=[0-9]+') THEN '~[?&]replytocom=[0-9]+' END AS pattern FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN pattern END AS pattern, coalesce(verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM parts LEFT JOIN ruled USING (n) LEFT JOIN shaped USING (n)
"""


@query("op5_url_filter", _URLS)
def op5(read):
    return urls.report(read("pages"))


@query("op6_secret_scan")
def op6(read):
    return secrets.report(read("documents"))


@query("op7_cross_polytope_ann")
def op7(read):
    return ann.report(read("embeddings"))


@query("op8_best_fit_packing")
def op8(read):
    return packing.pack(read("documents"), "text", ["doc_id"])


@query("op9_pii_weak_supervision")
def op9(read):
    return pii.report(read("documents"))


@query("op10_subword_quality")
def op10(read):
    return quality.report(read("documents"), read("labels"))


# crc32 of a number's decimal digits, bit by bit
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({x}::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v // 2, CASE WHEN v % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))))"""
_VALUE = "coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(x=c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS rid, {_LEAF.format(text='text')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC.format(x='doc_id')} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text='text')} END AS claim FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM d),
t AS (SELECT source, 0 AS level, pos AS idx, leaf AS hash, size AS n FROM p
      UNION ALL SELECT source, level + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY source, level, idx // 3, n),
o AS (SELECT source, hash, row_number() OVER (ORDER BY source IS NOT NULL, encode(coalesce(source, ''))) - 1 AS pos, count(*) OVER () AS size FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos AS idx, hash, size AS n FROM o
      UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, idx // 3, n),
heights AS (SELECT source, max(level) AS h FROM t GROUP BY source),
s AS (
  SELECT a.source, a.level, a.idx, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM t a JOIN t b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
  UNION ALL
  SELECT o.source, h + a.level, a.idx, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx < a.idx), ''), coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '')
  FROM o JOIN heights ON heights.source IS NOT DISTINCT FROM o.source JOIN u a ON a.idx = o.pos // (3 ** a.level)::BIGINT AND a.n > 1 JOIN u b ON a.level = b.level AND a.idx // 3 = b.idx // 3 GROUP BY ALL),
w AS (
  SELECT rid, p.source, 0 AS level, pos AS idx, '' AS proof, claim AS node FROM p
  UNION ALL
  SELECT rid, w.source, w.level + 1, CASE WHEN w.level + 1 = h THEN o.pos WHEN w.level + 1 > h THEN s.idx // 3 ELSE w.idx // 3 END, proof || l || r, sha256(l || node || r)
  FROM w JOIN heights ON heights.source IS NOT DISTINCT FROM w.source JOIN o ON o.source IS NOT DISTINCT FROM w.source JOIN s ON s.source IS NOT DISTINCT FROM w.source AND s.level = w.level AND s.idx = CASE WHEN w.level >= h THEN o.pos // (3 ** (w.level - h))::BIGINT ELSE w.idx END)
SELECT doc_id, leaf, o.hash AS subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level DESC) AS k FROM w) x JOIN d USING (rid) JOIN o ON o.source IS NOT DISTINCT FROM d.source, (SELECT hash AS root FROM u WHERE n = 1) WHERE k = 1
"""


@query("op11_merkle_manifest", _MERKLE)
def op11(read):
    return merkle.report(read("documents"))


_TRIE = f"""
WITH t AS (
  SELECT conv_id, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key, length(coalesce(text, '')) AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM t),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS donor, ({_CRC.format(x='conv_id')} % 6)::BIGINT AS h FROM o GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(d.n, 0)) AS taken FROM c LEFT JOIN c d ON d.conv_id = c.donor),
i AS (
  SELECT k.conv_id, o.pos AS depth, key, size FROM k JOIN o ON o.conv_id = donor AND o.pos <= taken
  UNION ALL SELECT k.conv_id, o.pos - h + taken, key, size FROM k JOIN o ON o.conv_id = k.conv_id AND o.pos > h),
r AS (
  SELECT conv_id, depth, size, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, depth = max(depth) OVER (PARTITION BY conv_id) AS final FROM i
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM i) FROM k),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (final), '') AS ends FROM r GROUP BY depth, path),
p AS (SELECT a.*, b.conv_id AS parent_conv_id FROM n a LEFT JOIN n b ON b.depth = a.depth - 1 AND b.path = a.path[:32 * (a.depth - 1)]),
kids AS (SELECT path[:32 * (depth - 1)] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN kids USING (path)),
up AS (SELECT path[:32 * d] AS path, n_children, (n_convs - 1) * size AS saved FROM f, unnest(range(0, depth + 1)) u(d)),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY path)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM f JOIN sums USING (path)
"""


@query("op12_conversation_trie", _TRIE)
def op12(read):
    return trie.report(read("conversations"))


_LINKS = """
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: x::DOUBLE) AS e,
         embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine FROM embeddings),
l AS (SELECT a.n AS x, b.n AS y, b.vec_id FROM v a JOIN v b ON a.n <> b.n AND a.fine AND b.fine AND len(a.e) = len(b.e) WHERE CASE WHEN a.fine AND b.fine AND len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.95),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, count(*) AS n_links FROM l GROUP BY x),
m AS (SELECT x, min(vec_id) AS least FROM r JOIN v ON v.n = y GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept
FROM v LEFT JOIN c ON c.x = n LEFT JOIN m ON m.x = n
"""


@query("op13_metric_range_join", _LINKS)
def op13(read):
    return metric.report(read("embeddings"))
