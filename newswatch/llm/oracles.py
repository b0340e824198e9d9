"""SQL of the registered training-data queries that plain SQL can express, over the driver's tables as views."""

from __future__ import annotations

# Unsigned crc32 of a decimal number: per character eight steps (-1) after it is mixed in.
CRC = """xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST({x} AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", n_chars, "text"])) + ")"


def _tree(name: str, base: str) -> str:
    """Nodes (g, lvl, idx, h, n) over the leaves of `base` (g, idx, h)."""
    return f"""{name} AS (
    SELECT g, 0 AS lvl, idx, h, count(*) OVER (PARTITION BY g) AS n FROM {base}
    UNION ALL
    SELECT g, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, lvl, idx // 2, n)"""


def _steps(leaves: str, tree: str) -> str:
    """Siblings (g, idx, lvl, step) of every leaf: R or L for their side, then the digest, if any."""
    return f"""SELECT a.g, a.idx, t.lvl, CASE WHEN (a.idx >> t.lvl) % 2 = 0 THEN 'R' ELSE 'L' END || coalesce(s.h, '') AS step
    FROM {leaves} a JOIN (SELECT DISTINCT g, lvl FROM {tree} WHERE n > 1) t ON a.g IS NOT DISTINCT FROM t.g
    LEFT JOIN {tree} s ON s.g IS NOT DISTINCT FROM a.g AND s.lvl = t.lvl AND s.idx = xor(a.idx >> t.lvl, 1)"""


MERKLE = f"""
WITH RECURSIVE base AS (
    SELECT doc_id, lang AS g, {_leaf("n_chars")} AS h,
        CASE WHEN {CRC.format(x="doc_id")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS claimed
    FROM documents),
leaves AS (SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS BIGINT) AS idx FROM base),
{_tree("tree", "leaves")},
subroots AS (SELECT g AS lang, 0 AS g, h, CAST(row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS BIGINT) AS idx FROM tree WHERE n = 1),
{_tree("top", "subroots")},
steps AS ({_steps("leaves", "tree")}),
upper AS ({_steps("subroots", "top")}),
own AS (SELECT g, idx, list(step ORDER BY lvl) AS path FROM steps GROUP BY g, idx),
above AS (SELECT s.lang, any_value(s.h) AS subroot, list(u.step ORDER BY u.lvl) FILTER (WHERE u.step IS NOT NULL) AS path
    FROM subroots s LEFT JOIN upper u ON u.idx = s.idx GROUP BY s.lang),
whole AS (SELECT l.doc_id, l.h AS leaf, l.claimed, a.subroot, (SELECT h FROM top WHERE n = 1) AS root,
        coalesce(o.path, CAST([] AS VARCHAR[])) || coalesce(a.path, CAST([] AS VARCHAR[])) AS path
    FROM leaves l LEFT JOIN own o ON o.g IS NOT DISTINCT FROM l.g AND o.idx = l.idx
    JOIN above a ON a.lang IS NOT DISTINCT FROM l.g),
folded AS (SELECT *, list_reduce([claimed] || path,
    lambda c, s: CASE WHEN s[1] = 'R' THEN sha256(c || s[2:]) ELSE sha256(s[2:] || c) END) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256,
    folded_root, folded_root = root AS verified
FROM folded"""

WARC = """
WITH payloads AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, row_number() OVER same AS place, first_value(page_id) OVER same AS kept FROM payloads
    WINDOW same AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND place > 1 THEN kept END AS refers_to,
    CAST(NULL AS VARCHAR) AS problem  -- every archive is whole
FROM firsts"""

ORACLES = {"op4_warc": WARC, "op12_merkle_manifest": MERKLE}
