"""SQL for the corpus queries that SQL can express, in the dialect of the checking engine.

The others have none: hashes, checksums and compressors that the engine lacks (4, 7, 9), models and tokenizers (3, 5, 10), a
search that may miss neighbours (2) and a program over all bucket bounds (8). Those are tested against brute force.
"""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING_DEDUP = f"""WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words FROM documents
),
starts AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM w WHERE len(words) >= 20),
seen AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS key FROM starts),
again AS (SELECT doc_id, i FROM seen QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM again),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS p FROM w),
left_over AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept
    FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)"""

NEAR_DEDUP = f"""WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS words
    FROM documents
),
shingle AS (
    SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS s FROM (
        SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) AS i FROM w WHERE len(words) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
),
link AS (
    SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
    WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
),
two_way AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reached.a, two_way.b FROM reached JOIN two_way ON two_way.a = reached.b
),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM component LEFT JOIN size USING (doc_id)"""

CHECKSUM = """4294967295 - list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _levels(name: str, leaves: str) -> str:
    """CTE name(g, k, i, n, h): the nodes of every level over leaves (g, i, n, h)."""
    return f"""{name} AS (
    SELECT g, 0 AS k, i, n, h FROM {leaves}
    UNION ALL
    SELECT g, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1
    GROUP BY g, k, i // 2, n
)"""


def _walk(name: str, start: str, nodes: str) -> str:
    """CTE name(r, g, k, i, n, proof, fold): each row's way up, with the proof so far and the digest folded so far."""
    return f"""{name} AS (
    SELECT r, g, 0 AS k, i, n, proof, fold FROM {start}
    UNION ALL
    SELECT r, u.g, u.k + 1, u.i // 2, (u.n + 1) // 2, proof || coalesce(s.h, ''),
        CASE WHEN s.h IS NULL THEN sha256(fold) WHEN u.i % 2 = 0 THEN sha256(fold || s.h) ELSE sha256(s.h || fold) END
    FROM {name} u LEFT JOIN {nodes} s ON s.g = u.g AND s.k = u.k AND s.i = xor(u.i, 1) WHERE u.n > 1
)"""


MERKLE = f"""WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id, lang, {_leaf('n_chars')} AS leaf,
        CASE WHEN ({CHECKSUM}) % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS now
    FROM documents
),
l AS (
    SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, leaf AS h,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
    FROM d
),
{_levels('node', 'l')},
sub AS (SELECT 0 AS g, g AS i, count(*) OVER () AS n, h FROM node WHERE n = 1),
{_levels('over', 'sub')},
start AS (SELECT r, g, i, n, '' AS proof, now AS fold FROM l),
{_walk('inner_walk', 'start', 'node')},
between AS (SELECT r, 0 AS g, w.g AS i, s.n, proof, fold FROM inner_walk w JOIN sub s ON s.i = w.g WHERE w.n = 1),
{_walk('outer_walk', 'between', 'over')}
SELECT doc_id, leaf, s.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
    fold = top.h AS verified, l.i AS position,
    CAST(w.k + (SELECT max(k) FROM node WHERE node.g = l.g) AS INT) AS proof_levels
FROM l JOIN sub s ON s.i = l.g JOIN over top ON top.n = 1 JOIN outer_walk w ON w.r = l.r AND w.n = 1"""


def statements() -> dict[str, str]:
    return {"op1_substring_dedup": SUBSTRING_DEDUP, "op6_minhash_near_dedup": NEAR_DEDUP, "op12_merkle_manifest": MERKLE}
