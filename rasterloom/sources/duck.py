"""The derived images of ``rasters`` in DuckDB's SQL, for comparison."""

from __future__ import annotations

_SAMPLE = "CASE WHEN e.vec_id IS NULL THEN 0 ELSE CAST(greatest(0, least(255, round_even(128 + 255 * CAST(e.embedding[t.pos + 1] AS DOUBLE), 0))) AS INT) END"

R1 = f"""SELECT i.image_id, CAST(t.place // 4 * 8 + t.pos // 8 AS INT) AS y, CAST(t.place % 4 * 8 + t.pos % 8 AS INT) AS x, 32 AS h, 32 AS w, {_SAMPLE} AS g
    FROM (SELECT DISTINCT CAST(vec_id // 16 AS BIGINT) AS image_id FROM embeddings) i CROSS JOIN (SELECT a.i AS place, b.i AS pos FROM range(16) a(i) CROSS JOIN range(64) b(i)) t
    LEFT JOIN embeddings e ON e.vec_id = i.image_id * 16 + t.place"""

R2 = f"""SELECT image_id, y, x, 32 AS h, 32 AS w, max(CASE WHEN ch = 0 THEN v END) AS b, max(CASE WHEN ch = 1 THEN v END) AS g, max(CASE WHEN ch = 2 THEN v END) AS r FROM (
    SELECT i.image_id, t.place // 16 AS ch, CAST((t.place % 16) // 4 * 8 + t.pos // 8 AS INT) AS y, CAST((t.place % 16) % 4 * 8 + t.pos % 8 AS INT) AS x, {_SAMPLE} AS v
    FROM (SELECT DISTINCT CAST(vec_id // 48 AS BIGINT) AS image_id FROM embeddings) i CROSS JOIN (SELECT a.i AS place, b.i AS pos FROM range(48) a(i) CROSS JOIN range(64) b(i)) t
    LEFT JOIN embeddings e ON e.vec_id = i.image_id * 48 + t.place) GROUP BY image_id, y, x"""

R3 = """SELECT CAST(i.i AS BIGINT) AS image_id, CAST(yy.v AS INT) AS y, CAST(xx.v AS INT) AS x, 64 AS h, 64 AS w, coalesce(c.q * 5, 0) AS b, coalesce(c.d * 25, 0) AS g, coalesce(c.s * 8, 0) AS r
    FROM range(1, 8) i(i) CROSS JOIN range(64) yy(v) CROSS JOIN range(64) xx(v) LEFT JOIN (
    SELECT l_linenumber AS image_id, l_orderkey % 64 AS y, l_partkey % 64 AS x, max(CAST(trunc(l_quantity) AS INT)) AS q, max(CAST(round(l_discount * 100) AS INT)) AS d, max(CAST(day(l_shipdate) AS INT)) AS s
    FROM lineitem GROUP BY ALL) c ON c.image_id = i.i AND c.y = yy.v AND c.x = xx.v"""


def synthetic(width: int, height: int, image_id: int = 0) -> str:
    """An image of R4 in DuckDB's SQL."""
    n, r = width * height, min(width, height) // 8
    disc = f"(x - {width // 3}) * (x - {width // 3}) + (y - {height // 3}) * (y - {height // 3}) <= {r * r}"
    rect = f"x >= {width // 2} AND x <= {width // 2 + width // 5} AND y >= {height // 2} AND y <= {height // 2 + height // 5}"
    u, v = f"(CAST(x AS DOUBLE) / {max(width - 1, 1)})", f"(CAST(y AS DOUBLE) / {max(height - 1, 1)})"

    def plane(e: str, of_disc: int) -> str:
        return f"CASE WHEN {rect} THEN 40 WHEN {disc} THEN {of_disc} ELSE CAST(trunc(greatest(0e0, least(255e0, {e} + grain))) AS INT) END"

    return f"""SELECT image_id, y, x, {height} AS h, {width} AS w, {plane(f'180 * {u} + 30', 200)} AS b, {plane(f'150 * {v} + 40', 150)} AS g, {plane(f'160 * (1 - {u}) * {v} + 30', 100)} AS r
        FROM (SELECT CAST(i // {n} AS BIGINT) AS image_id, CAST(i % {n} // {width} AS INT) AS y, CAST(i % {width} AS INT) AS x, CAST(i * 7919 % 13 AS INT) - 6 AS grain FROM range({n * image_id}, {n * (image_id + 1)}) t(i))"""
