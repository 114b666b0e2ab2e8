"""The same queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .codes import ENTRIES, PARTS, ROUNDS, SCALE


def _codes() -> str:
    """Lloyd rounds over all entries, one pair of expressions a round."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda v: NOT coalesce(isfinite(v), FALSE))) = 0)""",
        f"""parts AS MATERIALIZED (
            SELECT vec_id, label, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] AS y
            FROM kept CROSS JOIN range({PARTS}) AS r(p))""",
        f"""book0 AS MATERIALIZED (
            SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, y AS c
            FROM parts QUALIFY e < {ENTRIES})""",
    ]
    for n in range(ROUNDS + 1):
        steps.append(
            f"""given{n} AS MATERIALIZED (
            SELECT vec_id, any_value(label) AS label, p, any_value(y) AS y, min({{'d': d, 'e': e}}) AS best
            FROM (SELECT vec_id, label, parts.p, y, e,
                         (list_inner_product(y, y) - 2 * list_inner_product(y, c)
                          + list_inner_product(c, c))::BIGINT AS d
                  FROM parts JOIN book{n} b ON b.p = parts.p) pairs
            GROUP BY vec_id, p)"""
        )
        if n < ROUNDS:
            steps.append(
                f"""book{n + 1} AS MATERIALIZED (
            SELECT b.p, b.e, coalesce(m.c, b.c) AS c
            FROM book{n} b LEFT JOIN (
                SELECT p, e, list(v ORDER BY i) AS c
                FROM (SELECT p, best.e AS e, i, floor(sum(y[i + 1]) / count(*)) AS v
                      FROM given{n} CROSS JOIN range(len(y)) AS r(i) GROUP BY ALL) sums
                GROUP BY p, e) m
            ON m.p = b.p AND m.e = b.e)"""
            )
    return f"""WITH {', '.join(steps)},
        coded AS (
            SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
                   sum(best.d)::BIGINT AS error
            FROM given{ROUNDS} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: v::BIGINT), ','), ','
                                         ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
        FROM coded"""


SQL: dict[str, str] = {"op11_codes": _codes()}
