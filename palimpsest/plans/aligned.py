"""SQL for aligned edit scripts, for the oracles.

Expects ``lists (pair_id, s, g)``: the two token lists of each pair. Ends in
``script (pair_id, step, action)`` with the gap and the place as ``step``. Needs
``WITH RECURSIVE``.
"""

ALIGNED_SQL = """
sized AS (SELECT *, len(s) AS n, len(g) AS m, least(len(s), len(g)) AS k FROM lists),
headed AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, k + 1), lambda i: s[i] = g[i]), false), 0) - 1, k) AS h FROM sized),
tailed AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, k - h + 1), lambda i: s[n + 1 - i] = g[m + 1 - i]), false), 0) - 1, k - h) AS t FROM headed),
inner_lists AS (SELECT pair_id, h, s[h + 1:n - t] AS x, g[h + 1:m - t] AS y FROM tailed WHERE h < n OR h < m),
dp AS (
  SELECT pair_id, 0::BIGINT AS i, list_transform(range(0, len(y) + 1), lambda z: 0::BIGINT) AS cells, x, y FROM inner_lists
  UNION ALL
  SELECT pair_id, i + 1, list_reduce(range(1, len(y) + 1),
    lambda acc, j: list_append(acc, CASE WHEN x[i + 1] = y[j] THEN cells[j] + 1 ELSE greatest(acc[len(acc)], cells[j + 1]) END),
    [0::BIGINT]) AS cells, x, y
  FROM dp WHERE i < len(x)
),
lengths AS MATERIALIZED (SELECT pair_id, i, cells FROM dp),
back AS (
  SELECT pair_id, len(x)::BIGINT AS i, len(y)::BIGINT AS j, 'end' AS kind FROM inner_lists
  UNION ALL
  SELECT pair_id, CASE WHEN kind = 'insert' THEN i ELSE i - 1 END, CASE WHEN kind = 'delete' THEN j ELSE j - 1 END, kind FROM (
    SELECT b.pair_id, b.i, b.j, CASE WHEN d.cells[b.j] = d.cells[b.j + 1] THEN 'insert'
      WHEN p.cells[b.j + 1] = d.cells[b.j + 1] THEN 'delete' ELSE 'pair' END AS kind
    FROM back b JOIN lengths d ON d.pair_id = b.pair_id AND d.i = b.i JOIN lengths p ON p.pair_id = b.pair_id AND p.i = b.i - 1
    WHERE b.i > 0 AND b.j > 0)
),
common AS MATERIALIZED (SELECT pair_id, i, j FROM back WHERE kind = 'pair'),
x_places AS (SELECT pair_id, unnest(x) AS token, unnest(range(len(x))) AS p FROM inner_lists),
y_places AS (SELECT pair_id, unnest(y) AS token, unnest(range(len(y))) AS q FROM inner_lists),
x_gaps AS (SELECT v.*, c.i IS NOT NULL AS same, count(c.i) OVER (PARTITION BY v.pair_id ORDER BY p) AS gap FROM x_places v LEFT JOIN common c ON c.pair_id = v.pair_id AND c.i = p),
y_gaps AS (SELECT v.*, c.j IS NOT NULL AS same, count(c.j) OVER (PARTITION BY v.pair_id ORDER BY q) AS gap FROM y_places v LEFT JOIN common c ON c.pair_id = v.pair_id AND c.j = q),
gone AS (SELECT *, row_number() OVER (PARTITION BY pair_id, token ORDER BY p) AS nth FROM x_gaps WHERE NOT same),
fresh AS (SELECT *, row_number() OVER (PARTITION BY pair_id, token ORDER BY q) AS nth FROM y_gaps WHERE NOT same),
gone_left AS (SELECT *, row_number() OVER (PARTITION BY pair_id, gap ORDER BY p) AS r FROM gone a ANTI JOIN fresh b USING (pair_id, token, nth)),
fresh_left AS (SELECT *, row_number() OVER (PARTITION BY pair_id, gap ORDER BY q) AS r FROM fresh a ANTI JOIN gone b USING (pair_id, token, nth)),
edits AS (
  SELECT pair_id, gap, q AS place, 'move-tree' AS action FROM fresh a SEMI JOIN gone b USING (pair_id, token, nth)
  UNION ALL SELECT pair_id, f.gap, q, CASE WHEN l.p IS NULL THEN 'insert-node' ELSE 'update-node' END FROM fresh_left f LEFT JOIN gone_left l USING (pair_id, gap, r)
  UNION ALL SELECT pair_id, gap, 1000000000 + p, 'delete-node' FROM gone_left a ANTI JOIN fresh_left b USING (pair_id, gap, r)
),
script AS (SELECT pair_id, gap * 10000000000 + place AS step, action FROM edits)"""
