"""SQL building blocks for the statements that describe each query's result."""

from __future__ import annotations

BARS = """ticks AS (
  SELECT l_returnflag AS series_id, l_shipdate AS ts, l_extendedprice AS price, l_quantity AS qty,
         row_number() OVER (PARTITION BY l_returnflag, date_trunc('day', l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k,
         count(*) OVER (PARTITION BY l_returnflag, date_trunc('day', l_shipdate)) AS n
  FROM lineitem),
bars AS (
  SELECT series_id, date_trunc('day', ts)::TIMESTAMP AS ts,
         max(CASE WHEN k = 1 THEN price END) AS open, max(price) AS high, min(price) AS low,
         max(CASE WHEN k = n THEN price END) AS close, sum(qty) AS volume
  FROM ticks GROUP BY 1, 2)"""

S = "PARTITION BY series_id ORDER BY ts"


def frame(rows: int, keys: str = "series_id") -> str:
    return f"(PARTITION BY {keys} ORDER BY ts ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def running(keys: str = "series_id") -> str:
    return f"(PARTITION BY {keys} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def gated(agg: str, column: str, rows: int) -> str:
    return f"CASE WHEN count({column}) OVER {frame(rows)} = {rows} THEN {agg}({column}) OVER {frame(rows)} END"


def z(column: str, rows: int) -> str:
    return f"CASE WHEN count({column}) OVER {frame(rows)} = {rows} AND stddev_samp({column}) OVER {frame(rows)} > 0 THEN ({column} - avg({column}) OVER {frame(rows)}) / stddev_samp({column}) OVER {frame(rows)} END"


def slope(column: str, rows: int) -> str:
    return f"CASE WHEN count({column}) OVER {frame(rows)} = {rows} THEN regr_slope({column}, bar_no) OVER {frame(rows)} END"


NUMBERED = BARS + f""",
numbered AS (SELECT *, row_number() OVER ({S}) AS bar_no, count(*) OVER (PARTITION BY series_id) AS n_bars FROM bars),
tr AS (SELECT *, lag(close) OVER ({S}) AS pc, lag(high) OVER ({S}) AS ph, lag(low) OVER ({S}) AS pl FROM numbered),
trs AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM tr)"""

RETURNS = BARS + f""",
rets AS (SELECT series_id, ts, close, coalesce(ln(close / lag(close) OVER ({S})), 0) AS ret FROM bars)"""

#: Log-returns damped to a hundredth: the tick data's bars jump by whole multiples.
DAMPED = RETURNS + f""",
damped AS (SELECT series_id, ts, close, ret / 100 AS ret FROM rets),
curve AS (SELECT *, 100000 * product(1 + ret) OVER {running()} AS equity FROM damped)"""

TREND = DAMPED + f""",
above AS (SELECT *, CASE WHEN count(close) OVER {frame(200)} = 200 AND close > avg(close) OVER {frame(200)} THEN 1.0 ELSE 0.0 END AS a FROM damped),
trend AS (SELECT *, coalesce(lag(a) OVER ({S}), 0.0) AS weight FROM above),
moved AS (SELECT *, coalesce(lag(weight) OVER ({S}), 0.0) * ret AS gross, abs(weight - coalesce(lag(weight) OVER ({S}), 0.0)) * 0.0005 AS slippage FROM trend),
path AS (SELECT *, (1 + gross) * (1 - slippage) - 1 AS net FROM moved),
eq AS (SELECT *, 100000 * product(1 + net) OVER {running()} AS equity FROM path)"""


def with_(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
