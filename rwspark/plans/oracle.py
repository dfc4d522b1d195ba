"""Common table expressions of the SQL for DuckDB."""

PAIRS = """pairs AS (SELECT conv_id * 1048576 + turn AS id, conv_id, turn, text AS source, next_text AS target
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

TOKENS = PAIRS + r""",
tokens AS (SELECT * FROM (SELECT id, s, t, len(s)::INT AS n, len(t)::INT AS m
  FROM (SELECT id, regexp_extract_all(source, '\S+') AS s, regexp_extract_all(target, '\S+') AS t FROM pairs)) WHERE n BETWEEN 1 AND 80 AND m > 0)"""


def whole(sql: str) -> str:
    """SQL over ``TOKENS`` for pairs of any length."""
    return sql.replace("n BETWEEN 1 AND 80", "n > 0")


def hashed(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT::DOUBLE / 4294967296e0)"


CELLS = TOKENS + f""",
cells AS (SELECT id, n, m, i::INT AS i, j::INT AS j, (1e0 - i::DOUBLE / n) * (0.2e0 + 0.8e0 * {hashed("id || '|' || i || '|' || j")}) AS d
  FROM tokens, LATERAL (SELECT unnest(range(1, n + 1)) AS i), LATERAL (SELECT unnest(range(0, m)) AS j))"""


def commits(tau: str, cells: str = "cells", by: str = "", prefix: str = "", d: str = "d", fires: str | None = None) -> str:
    """CTEs <prefix>fire, <prefix>mono and <prefix>trace."""
    fires = fires or f"NOT isnan({d}) AND {d} < {tau}"
    keys = f"id, {by}n, m, j"
    return f""",
{prefix}fire AS (SELECT {keys}, coalesce(min(i) FILTER ({fires}), n) AS raw, count(*) FILTER ({fires}) > 0 AS fired FROM {cells} GROUP BY {keys}),
{prefix}mono AS (SELECT *, max(raw) OVER (PARTITION BY id{', ' + by.rstrip(', ') if by else ''} ORDER BY j ROWS UNBOUNDED PRECEDING) AS commit FROM {prefix}fire),
{prefix}trace AS (SELECT * EXCLUDE (new), (sum(new) OVER (PARTITION BY id{', ' + by.rstrip(', ') if by else ''} ORDER BY j ROWS UNBOUNDED PRECEDING))::BIGINT AS chunk
  FROM (SELECT *, CASE WHEN commit = lag(commit) OVER (PARTITION BY id{', ' + by.rstrip(', ') if by else ''} ORDER BY j) THEN 0 ELSE 1 END AS new FROM {prefix}mono))"""


def pearson(x: str, y: str, same: str) -> str:
    return f"""CASE WHEN count(*) >= 2 AND NOT {same} THEN (sum({x} * {y}) - sum({x}) * sum({y}) / count(*))
      / sqrt((sum({x} * {x}) - sum({x}) * sum({x}) / count(*)) * (sum({y} * {y}) - sum({y}) * sum({y}) / count(*))) END"""


def summaries(trace: str = "trace", by: str = "", name: str = "sums") -> str:
    x, y = "(commit::DOUBLE / n)", "((j + 1)::DOUBLE / m)"
    return f""",
{name} AS (SELECT id, {by}n, m, max(chunk) AS chunks, sum(commit)::BIGINT AS sum_commit, count(*) FILTER (commit < n) AS early, count(*) FILTER (fired) AS fired,
  {pearson(x, y, "min(commit) = max(commit)")} AS pearson FROM {trace} GROUP BY id, {by}n, m)"""


def sweep(taus: list[float]) -> str:
    values = ", ".join(f"({k}, {t}e0)" for k, t in enumerate(taus))
    return CELLS + f", taus(rung, tau) AS (VALUES {values}), tcells AS (SELECT * FROM cells, taus)" + commits("tau", "tcells", "rung, tau, ") + summaries(by="rung, tau, ")


def rounded(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})"
