"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from strandgraph.llm import spotsigs


def _prints(text: str) -> str:
    """The fingerprint of a text as one SQL expression."""
    anchors = ", ".join(f"'{word}'" for word in spotsigs.ANCHORS)
    words = f"regexp_split_to_array(lower({text}), '[^\\p{{L}}]+')"
    marked = f"list_transform({words}, lambda w: CASE WHEN w IN ({anchors}) THEN w || '+' WHEN w = '' THEN '' ELSE w || ' ' END)"
    tokens = f"string_split(rtrim(array_to_string({marked}, ''), ' '), ' ')"
    last = "regexp_extract(t[i + 1], '[^+]*$')"
    spots = (
        f"list_filter(list_transform(range(1, len(t)), lambda i: CASE WHEN contains(t[i], '+') AND {last} <> '' "
        f"THEN left(md5(t[i] || ' ' || {last}), 8) END), lambda s: s IS NOT NULL)"
    )
    return (
        f"(SELECT CASE WHEN len(s) > 0 THEN array_to_string(list_sort(list_distinct(s)), '') ELSE left(md5(array_to_string(t, ' ')), 8) END "
        f"FROM (SELECT t, {spots} AS s FROM (SELECT {tokens} AS t)))"
    )


def _likeness(a: str, b: str) -> str:
    cut = lambda f: f"list_transform(range(0, length({f}) // 8), lambda i: substr({f}, i * 8 + 1, 8))"
    shared = f"len(list_intersect({cut(a)}, {cut(b)}))"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE {shared}::DOUBLE / ((length({a}) + length({b})) // 8 - {shared}) END"


OP2 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
paired AS (
  SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS after FROM docs
),
edited AS (SELECT *, left(text, n - n // 4) || left(after, n // 4) AS edited FROM paired),
prints AS (
  SELECT doc_id, n, edited, {_prints("text")} AS fingerprint, {_prints("edited")} AS edited_fingerprint, {_prints("after")} AS next_fingerprint FROM edited
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  {_likeness("fingerprint", "edited_fingerprint")} AS near_edited, {_likeness("fingerprint", "next_fingerprint")} AS near_next
FROM prints
"""

OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
r AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM q)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM r
"""


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP11 = f"""
WITH labelled AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
counted AS (
  SELECT *, {_WORDS.format("text")} AS words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
    min(doc_id) OVER (PARTITION BY text) AS first FROM docs
),
flagged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * list_unique(words) < 50 * len(words))::INT + 4 * (100 * capitals > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(first < doc_id, false)::INT AS mask
  FROM counted LEFT JOIN labelled USING (doc_id)
),
masks AS (SELECT part, mask, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic FROM flagged GROUP BY ALL),
f AS (SELECT k, substr('ABCDE', k + 1, 1) AS letter FROM range(5) AS r(k)),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks, a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
),
steps AS (
  SELECT filter_order, step::INT AS step, (1 << ks[step])::INT AS own, list_sum(list_transform(ks[1:step - 1], lambda k: (1 << k)::INT)) AS earlier
  FROM orders, range(1, 6) AS r(step)
),
told AS (
  SELECT part, filter_order, step, n, good, toxic, mask, own, mask & own > 0 AS fails, mask & coalesce(earlier, 0)::INT > 0 AS gone FROM masks, steps
)
SELECT part, filter_order, step,
  sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  (sum(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM told GROUP BY part, filter_order, step, own
"""

OP12 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
),
named AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS name, s FROM sets),
nodes AS (SELECT name, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS smallest FROM named WHERE n > 0 GROUP BY name),
pieces AS (SELECT name, n, unnest(s) AS piece FROM nodes),
links AS (
  SELECT a.name AS a, b.name AS b FROM pieces a JOIN pieces b ON a.piece = b.piece AND a.name <> b.name
  GROUP BY a.name, b.name, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach AS (SELECT name, smallest FROM nodes UNION SELECT l.b, r.smallest FROM reach r JOIN links l ON l.a = r.name),
least AS (SELECT name, min(smallest) AS component_id FROM reach GROUP BY name)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM named LEFT JOIN least ON named.name = least.name AND n > 0
"""

#: Levels of a tree in the oracle: three to this power leaves at most.
_LEVELS = 12


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}))::VARCHAR || ':' || {name}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([_field(f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars")] + [_field(text)]) + ")"


def _folded(fold: str, k: str) -> str:
    """The parent of ``fold`` at place k of the run (d0, d1, d2)."""
    at = [f"CASE WHEN {k} = {i} THEN {fold} ELSE coalesce(d{i}, '') END" for i in range(3)]
    return "sha256(" + " || ".join(at) + ")"


def _siblings(k: str) -> str:
    return " || ".join(f"CASE WHEN {k} = {i} THEN '' ELSE coalesce(d{i}, '') END" for i in range(3))


def _tree(name: str, group: str) -> str:
    """CTEs name_l0 .. with the nodes of each level, and name_r0 .. with their runs, from name_l0 (group, i, d)."""
    out = []
    for level in range(_LEVELS):
        runs = " ".join(f", max(CASE WHEN i % 3 = {k} THEN d END) AS d{k}" for k in range(3))
        out.append(f"{name}_r{level} AS (SELECT {group}, i // 3 AS run, sum(count(*)) OVER (PARTITION BY {group}) AS n {runs} FROM {name}_l{level} GROUP BY {group}, i // 3)")
        out.append(
            f"{name}_l{level + 1} AS (SELECT {group}, run AS i, CASE WHEN n > 1 THEN sha256(d0 || coalesce(d1, '') || coalesce(d2, '')) ELSE d0 END AS d FROM {name}_r{level})"
        )
    return ",\n".join(out)


def _climb(source: str, tree: str, group: str) -> tuple[str, str]:
    """CTEs that carry proof and fold up a tree from ``source`` (..., i, proof, fold), and the last one's name."""
    out, before = [], source
    for level in range(_LEVELS):
        name, k = f"{tree}_c{level}", "(i % 3)"
        out.append(
            f"{name} AS (SELECT s.* REPLACE (s.i // 3 AS i, CASE WHEN n > 1 THEN proof || {_siblings(k)} ELSE proof END AS proof, "
            f"CASE WHEN n > 1 THEN {_folded('fold', k)} ELSE fold END AS fold) FROM {before} s JOIN {tree}_r{level} r ON r.{group} = s.{group} AND r.run = s.i // 3)"
        )
        before = name
    return ",\n".join(out), before


_UP, _AT_SUB = _climb("docs", "sub", "g")
_TOP, _AT_ROOT = _climb("entered", "top", "t")

#: Whether 2 divides the CRC-32 of the decimal doc_id: a step per byte, then one per bit.
_EVEN = """(
  list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii((doc_id::VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END
  ) % 2 = 1
)"""

OP13 = f"""
WITH base AS (
  SELECT *, {_leaf("text")} AS leaf, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {_EVEN} AS even FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i,
    CASE WHEN even THEN {_leaf("replace(text, chr(10), '')")} ELSE leaf END AS fold FROM base
),
sub_l0 AS (SELECT g, i, leaf AS d FROM placed),
{_tree("sub", "g")},
top_l0 AS (SELECT 0 AS t, g AS i, d FROM sub_l{_LEVELS}),
{_tree("top", "t")},
docs AS (SELECT doc_id, leaf, g, i, '' AS proof, fold FROM placed),
{_UP},
entered AS (SELECT c.doc_id, c.leaf, s.d AS subroot, 0 AS t, c.g AS i, c.proof, c.fold FROM {_AT_SUB} c JOIN sub_l{_LEVELS} s ON s.g = c.g),
{_TOP}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified
FROM {_AT_ROOT} c, top_l{_LEVELS} top
"""
