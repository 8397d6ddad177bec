"""DuckDB SQL of corpus queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op11_merkle_manifest"] = """
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, text,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(octet_length(encode(CAST(doc_id AS VARCHAR))), ':', doc_id) END,
           CASE WHEN source IS NULL THEN '-' ELSE concat(octet_length(encode(source)), ':', source) END,
           CASE WHEN lang IS NULL THEN '-' ELSE concat(octet_length(encode(lang)), ':', lang) END,
           CASE WHEN n_chars IS NULL THEN '-' ELSE concat(octet_length(encode(CAST(n_chars AS VARCHAR))), ':', n_chars) END) AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(octet_length(encode(text)), ':', text) END)) AS leaf,
    sha256(concat(head, CASE WHEN text IS NULL THEN '-' WHEN crc % 3 = 0 THEN concat(octet_length(encode(lowered)), ':', lowered)
                             ELSE concat(octet_length(encode(text)), ':', text) END)) AS changed FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
tree(lang, lvl, idx, h, n) AS (
  SELECT lang, 0, idx, leaf, count(*) OVER (PARTITION BY lang) FROM placed
  UNION ALL
  SELECT lang, lvl + 1, up, h, count(*) OVER (PARTITION BY lang) FROM (
    SELECT lang, lvl, idx // 8 AS up, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM tree WHERE n > 1 GROUP BY lang, lvl, idx // 8)),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM tree WHERE n = 1),
upper_tree(lvl, idx, h, n) AS (
  SELECT 0, place, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT lvl + 1, up, h, count(*) OVER () FROM (
    SELECT lvl, idx // 8 AS up, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM upper_tree WHERE n > 1 GROUP BY lvl, idx // 8)),
nodes AS (
  SELECT t.lang, t.lvl, t.idx, t.h, t.n, 0 AS tier FROM tree t
  UNION ALL SELECT s.lang, u.lvl, u.idx, u.h, u.n, 1 FROM upper_tree u, subroots s),
sides AS (
  SELECT lang, tier, lvl, idx, n, coalesce(string_agg(h, '' ORDER BY o) FILTER (o < idx), '') AS l, coalesce(string_agg(h, '' ORDER BY o) FILTER (o > idx), '') AS r FROM (
    SELECT a.lang, a.tier, a.lvl, a.idx, a.n, b.idx AS o, b.h FROM nodes a JOIN nodes b
    ON a.lang IS NOT DISTINCT FROM b.lang AND a.tier = b.tier AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1) GROUP BY ALL),
fold(doc_id, lang, leaf, step, tier, lvl, idx, h, proof) AS (
  SELECT doc_id, lang, leaf, 0, 0, 0, idx, changed, '' FROM placed
  UNION ALL
  SELECT f.doc_id, f.lang, f.leaf, f.step + 1,
    CASE WHEN s.l IS NULL THEN 1 ELSE f.tier END, CASE WHEN s.l IS NULL THEN 0 ELSE f.lvl + 1 END,
    CASE WHEN s.l IS NULL THEN u.place ELSE f.idx // 8 END,
    CASE WHEN s.l IS NULL THEN f.h ELSE sha256(concat(s.l, f.h, s.r)) END, concat(f.proof, s.l, s.r)
  FROM fold f JOIN subroots u ON f.lang IS NOT DISTINCT FROM u.lang
  LEFT JOIN sides s ON f.lang IS NOT DISTINCT FROM s.lang AND f.tier = s.tier AND f.lvl = s.lvl AND f.idx = s.idx
  WHERE s.l IS NOT NULL OR f.tier = 0),
folded AS (SELECT doc_id, lang, leaf, h, proof, row_number() OVER (PARTITION BY doc_id, lang, leaf ORDER BY step DESC) AS last FROM fold)
SELECT f.doc_id, f.leaf, s.subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM folded f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang, upper_tree t WHERE f.last = 1 AND t.n = 1
"""
ORACLES["op12_suffix_dedup"] = """WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 100)) AS w FROM (SELECT doc_id, x, unnest(range(n - 49)) AS i FROM docs WHERE n >= 50)),
firsts AS (SELECT w, min(doc_id) AS d FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE doc_id > d),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
  SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hits)) GROUP BY doc_id, run),
gaps AS (SELECT d.doc_id, string_agg(substr(x, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS kept FROM docs d JOIN (
    SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
    UNION ALL SELECT d.doc_id, coalesce(max(r.b), 0), any_value(d.n) FROM docs d LEFT JOIN runs r ON d.doc_id = r.doc_id GROUP BY d.doc_id) g ON d.doc_id = g.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(r.removed, 0) AS BIGINT) AS n_removed, coalesce(r.spans, 0) AS n_spans, sha256(unhex(g.kept)) AS kept_sha256
FROM docs d LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id) r ON d.doc_id = r.doc_id JOIN gaps g ON d.doc_id = g.doc_id"""


def _vector_codes(rounds: int = 6) -> str:
    """Rounds of assignment and floored means, one after another."""
    steps = ["""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS place, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT place, vec_id, label, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM kept, range(8) r(p)),
book0 AS (SELECT p, place - 1 AS e, x AS c FROM parts WHERE place <= 16)"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS (
  SELECT place, p, min((d, e)) AS best FROM (
    SELECT a.place, a.p, b.e, list_sum(list_transform(list_zip(a.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts a JOIN book{r} b ON a.p = b.p) GROUP BY place, p)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
      SELECT a.p, best[2] AS e, i, sum(a.x[i]) AS s, count(*) AS n FROM near{r} k JOIN parts a ON k.place = a.place AND k.p = a.p, range(1, 65) g(i)
      WHERE i <= len(a.x) GROUP BY a.p, best[2], i) GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)""")
    return ",\n".join(steps) + f""",
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}),
coded AS (SELECT place, string_agg(lower(printf('%02x', CAST(best[2] AS INT))), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near{rounds} GROUP BY place)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
FROM coded c JOIN kept k ON c.place = k.place, digest d"""


ORACLES["op13_vector_codes"] = _vector_codes()
