"""DuckDB statements of the operators that SQL can express."""

OP4 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

OP7 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
il AS (SELECT item_id, w, least(10, len(w)) AS m FROM iw WHERE len(w) > 0),
pat AS (
  SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS s
  FROM il, unnest(range(1, len(w) - m + 2)) AS u(k)),
lens AS (SELECT DISTINCT m FROM pat),
win AS (
  SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS s
  FROM dw, lens, unnest(range(1, len(w) - m + 2)) AS u(k)),
hit AS (SELECT win.doc_id, win.m, win.k, pat.item_id FROM win JOIN pat USING (m, s)),
marked AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, m, k FROM hit), unnest(range(k, k + m)) AS u(p)
  GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN marked USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

def checksums() -> str:
    """CTEs up to ``crc``: a lookup list of CRC-32, and doc_id with the checksum of its digits."""
    steps = ["crc0 AS (SELECT i, i::UBIGINT AS c FROM range(256) AS r(i))"] + [
        f"crc{k} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}::UBIGINT) ELSE c >> 1 END AS c "
        f"FROM crc{k - 1})" for k in range(1, 9)]
    return ",\n".join([*steps, "looked AS (SELECT list(c ORDER BY i) AS tab FROM crc8)", """
crc AS MATERIALIZED (
  SELECT doc_id, xor(list_reduce(
    list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT),
    lambda c, b: xor(tab[(xor(c, b) & 255)::BIGINT + 1], c >> 8), 4294967295::UBIGINT), 4294967295) AS h
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), looked)"""])


def tree(name: str, first: str, levels: int) -> str:
    """CTEs of the levels above ``first`` (tree, k, n, d), each node with its siblings left and right."""
    out = []
    for level in range(levels + 1):
        nodes = first if not level else (
            f"SELECT tree, k // 16 AS k, (n + 15) // 16 AS n, "
            f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY k)) ELSE any_value(d) END AS d "
            f"FROM {name}{level - 1} GROUP BY tree, k // 16, n")
        frame = "PARTITION BY tree, k // 16 ORDER BY k ROWS BETWEEN"
        out.append(
            f"{name}{level} AS MATERIALIZED (SELECT *, "
            f"coalesce(string_agg(d, '') OVER ({frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(d, '') OVER ({frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM ({nodes}))")
    return ",\n".join(out)


def climb(name: str, source: str, levels: int, key: str, at: str, out: str) -> str:
    """CTE ``out``: ``source`` with its node folded and its siblings listed up to the root."""
    parts, last = [], source
    for level in range(levels):
        now = f"{out}_{level}" if level < levels - 1 else out
        parts.append(
            f"{now} AS (SELECT s.* EXCLUDE (x, path), "
            f"CASE WHEN v.n > 1 THEN sha256(v.l || s.x || v.r) ELSE s.x END AS x, s.path || v.l || v.r AS path "
            f"FROM {last} s JOIN {name}{level} v ON v.tree = {key} AND v.k = {at} // {16 ** level})")
        last = now
    return ",\n".join(parts)


# Fixed numbers of levels: a million documents a source, and 4096 sources.
DEEP, TOP = 5, 3


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = f"""
WITH {checksums()},
named AS (
  SELECT *, sha256({_HEAD} || {_field('text')}) AS leaf, sha256({_HEAD} || {_field(_SMALL)}) AS other,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid FROM documents),
leaves AS MATERIALIZED (
  SELECT n.doc_id, leaf, sid, row_number() OVER (PARTITION BY sid ORDER BY n.doc_id NULLS FIRST, leaf) - 1 AS k,
    count(*) OVER (PARTITION BY sid) AS n, CASE WHEN h % 5 = 0 THEN other ELSE leaf END AS x, '' AS path
  FROM named n LEFT JOIN crc ON crc.doc_id = n.doc_id),
{tree("low", "SELECT sid AS tree, k, n, leaf AS d FROM leaves", DEEP)},
subs AS (SELECT tree AS sid, d AS subroot, count(*) OVER () AS n FROM low{DEEP}),
{tree("top", "SELECT 0 AS tree, sid AS k, n, subroot AS d FROM subs", TOP)},
{climb("low", "leaves", DEEP, "s.sid", "s.k", "below")},
{climb("top", "below", TOP, "0", "s.sid", "above")}
SELECT doc_id, leaf, subroot, (SELECT d FROM top{TOP}) AS root, sha256(path) AS proof_sha256, x AS folded_root,
  x = (SELECT d FROM top{TOP}) AS verified
FROM above JOIN subs USING (sid)
"""

# Lags come from repeated stretches of six words; each lag's diagonal is then compared in full.
OP12 = f"""
WITH {checksums()},
split AS (
  SELECT d.doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, h, h // 10 AS g
  FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id),
chosen AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM split),
t AS MATERIALIZED (
  SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[
    CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END::BIGINT + 1]) END AS w FROM chosen),
words AS MATERIALIZED (SELECT doc_id, i, w[i + 1] AS x FROM t, unnest(range(len(w))) AS u(i)),
grams AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM t, unnest(range(len(w) - 5)) AS u(i) WHERE len(w) >= 12),
lags AS (SELECT DISTINCT doc_id, b.i - a.i AS q FROM grams a JOIN grams b USING (doc_id, s) WHERE b.i > a.i),
equal AS (
  SELECT l.doc_id, q, a.i, a.i - row_number() OVER (PARTITION BY l.doc_id, q ORDER BY a.i) AS stretch
  FROM lags l JOIN words a ON a.doc_id = l.doc_id JOIN words b ON b.doc_id = l.doc_id AND b.i = a.i + q AND b.x = a.x),
runs AS MATERIALIZED (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM equal GROUP BY doc_id, q, stretch
  HAVING count(*) + q >= greatest(12, 2 * q)),
found AS MATERIALIZED (
  SELECT * FROM runs r WHERE NOT EXISTS (
    SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.n >= r.s + r.n)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM found),
kept AS (
  SELECT doc_id, sha256(string_agg(x, ' ' ORDER BY i)) AS digest FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = w.doc_id AND gone.i = w.i) GROUP BY 1),
listed AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q)) AS digest,
    arg_min(row(s, n, q), row(-n, s, q)) AS best FROM found GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
  1000 * best[2] // best[3] AS exponent_milli, coalesce(listed.digest, sha256('')) AS runs_sha256,
  coalesce(kept.digest, sha256('')) AS collapsed_sha256
FROM t LEFT JOIN listed ON listed.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id
"""

STATEMENTS: dict[str, str] = {
    "op4_exact_dedup": OP4,
    "op7_decontaminate": OP7,
    "op12_periodic_runs": OP12,
    "op13_merkle": OP13,
}
