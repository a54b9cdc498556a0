"""Matrices in SQL: means of products, inverses by elimination, squared distances. Matrices are lists of rows."""

from __future__ import annotations


def products(rows: str, by: str, d: int, divisor: str) -> str:
    """by, n, m: the products of z's elements summed over a group's rows, divided. rows: a table of (by, z)."""
    cells = f"SELECT {by}, i, j, count(*) AS n, sum(z[i] * z[j]) AS x FROM {rows}, range(1, {d + 1}) a(i), range(1, {d + 1}) b(j) GROUP BY ALL"
    lines = f"SELECT {by}, i, any_value(n) AS n, list(x / ({divisor}) ORDER BY j) AS line FROM ({cells}) GROUP BY {by}, i, n"
    return f"(SELECT {by}, any_value(n) AS n, list(line ORDER BY i) AS m FROM ({lines}) GROUP BY {by})"


def eliminated(name: str, matrices: str, by: str, d: int) -> str:
    """A recursive CTE and `<name>_inverse` (by, p): inverses of positive definite matrices by elimination. matrices: (by, m)."""
    start = f"SELECT {by}, 0::BIGINT AS k, list_transform(m, lambda line, i: list_concat(line, list_transform(range(1, {d + 1}), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END))) AS m FROM {matrices}"
    step = f"SELECT {by}, k, list_transform(m, lambda line, i: CASE WHEN i = k THEN p ELSE list_transform(line, lambda x, j: x - line[k] * p[j]) END) AS m FROM (SELECT {by}, k + 1 AS k, m, list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1]) AS p FROM {name} WHERE k < {d})"
    return f"{name} AS ({start} UNION ALL {step}),\n{name}_inverse AS (SELECT {by}, list_transform(m, lambda line: line[{d + 1}:{2 * d}]) AS p FROM {name} WHERE k = {d})"


def squared(z: str, p: str, d: int) -> str:
    """z' p z."""
    return f"list_sum(list_transform(range(1, {d + 1}), lambda i: {z}[i] * list_sum(list_transform(range(1, {d + 1}), lambda j: {p}[i][j] * {z}[j]))))"


def ridged(matrices: str, by: str, d: int, ridge: str) -> str:
    """A ridge on the diagonal; `ridge` may use the matrix m."""
    return f"(SELECT {by}, list_transform(m, lambda line, i: list_transform(line, lambda x, j: CASE WHEN i = j THEN x + r ELSE x END)) AS m FROM (SELECT *, {ridge} AS r FROM {matrices}))"
