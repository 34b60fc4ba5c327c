"""The same results in DuckDB's SQL, where it can express them: plain, over whole tables, for small ones."""

from __future__ import annotations

HARD_NEGATIVES = """
WITH r AS (
  SELECT vec_id AS k, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT k AS anchor_id, l AS al, v AS av FROM r WHERE k % 100 = 0),
s AS (SELECT anchor_id, al, k, l, CAST(list_inner_product(av, v) AS BIGINT) AS s FROM a JOIN r ON a.anchor_id <> r.k AND len(av) = len(v)),
p AS (SELECT anchor_id, k AS positive_id, s AS positive_score FROM s WHERE l = al QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, k) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, k AS negative_id, positive_score, s AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND l <> al AND 100 * s BETWEEN 80 * positive_score AND 100 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY s DESC, k)
QUALIFY row_number() OVER best <= 5
"""

#: Levels that are written out: sources of up to 16**5 rows, and up to 16**3 sources.
_DEEP, _WIDE = 5, 3
#: The unsigned CRC-32 of a decimal number's text, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda r, b: list_reduce(list_concat([xor(r, b)], [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _field(name: str) -> str:
    return f"coalesce(CAST(strlen(CAST({name} AS VARCHAR)) AS VARCHAR) || ':' || CAST({name} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _levels(name: str, first: str, deep: int) -> str:
    """Tables name0 (g, pos, h, n: nodes of the group), name1, …; a group of one node is carried up as it is."""
    out = [f"{name}0 AS ({first})"]
    for i in range(deep):
        out.append(f"{name}{i + 1} AS (SELECT g, pos // 16 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, (any_value(n) + 15) // 16 AS n FROM {name}{i} GROUP BY g, pos // 16)")
    return ",\n".join(out)


def _sides(name: str, deep: int) -> str:
    """Tables name_s0, …: each node's siblings left and right of it in its run; both null where the group has no more nodes."""
    run = "PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN"
    return ",\n".join(
        f"{name}_s{i} AS (SELECT g, pos, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}{i})"
        for i in range(deep)
    )


def _folded(name: str, deep: int, start: str, at: str, group: str) -> str:
    """Tables name_f0, …: the claim and the siblings so far, taken up level by level."""
    out = [f"{name}_f0 AS ({start})"]
    for i in range(deep):
        out.append(
            f"{name}_f{i + 1} AS (SELECT f.* EXCLUDE (now, proof), CASE WHEN n = 1 THEN now ELSE sha256(a || now || b) END AS now, CASE WHEN n = 1 THEN proof ELSE proof || a || b END AS proof FROM {name}_f{i} f JOIN {name}_s{i} s ON s.g IS NOT DISTINCT FROM f.{group} AND s.pos = f.{at} // {16**i})"
        )
    return ",\n".join(out)


MERKLE = f"""
WITH leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS claim
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
{_levels("d", "SELECT source AS g, pos, leaf AS h, n FROM placed", _DEEP)},
{_levels("u", f"SELECT 0 AS g, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n, g AS source FROM d{_DEEP}", _WIDE)},
{_sides("d", _DEEP)},
{_sides("u", _WIDE)},
{_folded("d", _DEEP, "SELECT doc_id, source, leaf, pos, claim AS now, '' AS proof FROM placed", "pos", "source")},
{_folded("u", _WIDE, f"SELECT x.*, u0.pos AS at, 0 AS one, u0.h AS subroot FROM d_f{_DEEP} x JOIN u0 ON u0.source IS NOT DISTINCT FROM x.source", "at", "one")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified
FROM u_f{_WIDE}, (SELECT h AS root FROM u{_WIDE})
"""
