"""The isolation forest as SQL: every tree grown and walked by one recursion over levels."""

from __future__ import annotations

from ..operators.forest import ForestSettings

_SET = ForestSettings()


def _path(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 2 * (ln({n}::DOUBLE - 1) + 0.5772156649015329::DOUBLE) - 2 * ({n}::DOUBLE - 1) / {n} END"


def _draw(what: str, at: str) -> str:
    return f"CAST('0x' || substr(md5('{_SET.seed}:' || t || ':{what}:' || {at}), 1, 12) AS BIGINT)"


def forest_sql(train: str, rows: str, dims: list[str], contamination: float = _SET.contamination) -> str:
    """CTEs over the relations ``train`` and ``rows``, which have the columns ``dims``: ``fscores`` (dims and score, each combination once),
    ``fcut`` (cut: the threshold) and ``fmedians`` (m_ and the column: upper medians of training).

    Samples and the rows to be scored go down the trees side by side; a node's bounds and size are those of its samples.
    """
    ds = ", ".join(dims)
    bounds = ", ".join(f"min({d}) FILTER (s) OVER w AS lo_{d}, max({d}) FILTER (s) OVER w AS hi_{d}" for d in dims)
    spread = ", ".join(f"{{'lo': lo_{d}, 'hi': hi_{d}, 'x': {d}}}" for d in dims)
    doubles = ", ".join(f"CAST({d} AS DOUBLE) AS {d}" for d in dims)
    return f"""
fpool AS MATERIALIZED (SELECT {doubles}, row_number() OVER (ORDER BY h, {ds}) - 1 AS place FROM (SELECT {ds}, md5(concat_ws(',', {ds}, '{_SET.seed}')) AS h FROM {train}) ORDER BY place LIMIT {_SET.samples * 8}),
fsize AS MATERIALIZED (SELECT least({_SET.samples}, count(*)) AS n, ceil(log2(greatest(2, least({_SET.samples}, count(*))))) AS deepest FROM fpool),
ftrees AS (SELECT unnest(range({_SET.trees})) AS t),
fpicked AS (SELECT * FROM (SELECT t, {ds}, row_number() OVER (PARTITION BY t ORDER BY {_draw("row", "place")}, place) AS r FROM fpool, ftrees) WHERE r <= (SELECT n FROM fsize)),
fwalk AS (
  SELECT t, 1::BIGINT AS node, 0 AS depth, true AS s, {ds}, NULL::DOUBLE AS path FROM fpicked UNION ALL
  SELECT t, 1::BIGINT, 0, false, {ds}, NULL::DOUBLE FROM ftrees, (SELECT {doubles} FROM {train} UNION SELECT {doubles} FROM {rows})),
fgrown AS (
  SELECT * FROM fwalk UNION ALL
  SELECT t, CASE WHEN e.x < e.lo + (e.hi - e.lo) * (({_draw("cut", "node")} + 0.5::DOUBLE) / 281474976710656::DOUBLE) THEN 2 * node ELSE 2 * node + 1 END, depth + 1, s, {ds}, CASE WHEN e IS NULL THEN depth + {_path("size")} END
  FROM (SELECT *, CASE WHEN depth < (SELECT deepest FROM fsize) AND len(spread) > 0 THEN spread[{_draw("feature", "node")} % len(spread) + 1] END AS e
        FROM (SELECT *, list_filter([{spread}], lambda z: coalesce(z.lo < z.hi, false)) AS spread FROM (SELECT *, count(*) FILTER (s) OVER w AS size, {bounds} FROM fgrown WHERE path IS NULL WINDOW w AS (PARTITION BY t, node))))),
fscores AS MATERIALIZED (SELECT {ds}, round(0.5 - pow(2.0::DOUBLE, -(sum(path) / {_SET.trees}) / (SELECT CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE {_path("n")} END FROM fsize)), 9) AS score FROM fgrown WHERE NOT s AND path IS NOT NULL GROUP BY {ds}),
fcut AS MATERIALIZED (SELECT (list(score ORDER BY score))[CAST(greatest(0, floor(count(*) * {contamination}::DOUBLE) - 1) AS BIGINT) + 1] AS cut FROM {train} JOIN fscores USING ({ds})),
fmedians AS MATERIALIZED (SELECT {", ".join(f"(list({d}::DOUBLE ORDER BY {d}))[count(*) // 2 + 1] AS m_{d}" for d in dims)} FROM {train})"""


def strange_sql(rows: str, dims: list[str], keys: list[str], clearly: float) -> str:
    """CTE ``fstrange`` over ``rows`` and the CTEs of ``forest_sql``: keys, dimension, direction, ratio, score and severity of the windows below the threshold."""
    at = ", ".join(keys)
    each = ", ".join(f"{{'d': '{d}', 'o': {i}, 'r': CASE WHEN m_{d} <> 0 THEN abs(({d} - m_{d}) / m_{d}) WHEN {d} > 0 THEN {d}::DOUBLE ELSE 0 END, 'high': CASE WHEN m_{d} > 0 THEN {d} >= m_{d} ELSE {d} > 0 END}}" for i, d in enumerate(dims))
    return f"""
fbelow AS (SELECT {at}, score, cut, unnest([{each}]) AS v FROM {rows} JOIN fscores USING ({", ".join(dims)}), fcut, fmedians WHERE score < cut),
fstrange AS MATERIALIZED (SELECT {at}, v.d AS dimension, CASE WHEN v.high THEN 'high' ELSE 'low' END AS direction, round(v.r + 1e-9::DOUBLE, 2) AS ratio, round(score, 4) AS score,
  CASE WHEN NOT v.high THEN 'INFO' WHEN score < cut - {clearly}::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM (SELECT *, row_number() OVER (PARTITION BY {at} ORDER BY v.r DESC, v.o) AS k FROM fbelow) WHERE k = 1)"""
