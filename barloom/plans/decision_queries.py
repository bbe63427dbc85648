"""Queries of decisions, model versions, stress, benchmarks and alerts, with their SQL.

Account states that the tables lack follow from a rule on the order's key; the
rule is one text that both Spark and the stated SQL evaluate.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.windows import ordered
from barloom.operators import decisions as dec
from barloom.operators import performance as perf
from barloom.operators import regimes as reg
from barloom.operators import risk
from barloom.plans import model_queries as mq
from barloom.plans.report_queries import _INFO, _LATCH, _POSTURE, _STATES, CAPITAL, SHARPE, curve, damped, replay_sql, state_table, states, trend_path
from barloom.plans.sql import BARS, DAMPED, S, TREND, frame, with_
from barloom.plans.sql import running as sql_running
from barloom.sources import bars as src

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- vetoes and orders ------------------------------------------------------

SIGNAL = {
    "order_id": "o_orderkey",
    "account": "o_custkey",
    "side": "CASE WHEN o_orderkey % 17 = 0 THEN 'sell' ELSE 'buy' END",
    "price": "o_totalprice / 1000",
    "stop": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice / 1000 * (0.86e0 + 0.03e0 * (o_custkey % 6)) END",
    "locked": "o_orderkey % 101 = 0",
    "severity": "CASE WHEN o_custkey % 19 = 0 THEN 2 WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END",
    "tradable": "o_orderkey % 29 <> 0",
    "bid": "o_totalprice / 1000 * 0.999e0",
    "ask": "o_totalprice / 1000 * (CASE WHEN o_orderkey % 31 = 0 THEN 1.01e0 ELSE 1.001e0 END)",
    "is_duplicate": "o_orderkey % 37 = 0",
    "trades_before": "o_orderkey % 24",
    "is_held": "o_orderkey % 3 = 0",
    "open_positions": "o_custkey % 7",
    "probability": "0.4e0 + 0.05e0 * (o_orderkey % 11)",
    "flicker": "o_orderkey % 6",
    "leverage": "0.5e0 + 0.25e0 * (o_orderkey % 5)",
    "target": "0.05e0 * (o_orderkey % 5)",
    "equity": "50000e0 + 1000e0 * (o_custkey % 50)",
    "gross": "1000e0 * (o_orderkey % 120)",
    "buying_power": "500e0 * (o_orderkey % 13)",
    "max_correlation": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 0.5e0 + 0.05e0 * (o_orderkey % 9) END",
    "sector_gross": "CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE 800e0 * (o_custkey % 30) END",
    "take_profit": "CAST(NULL AS DOUBLE)",
}

_RULES = """,
forced AS (SELECT *, least(leverage, 1.25e0) AS asked, probability < 0.55 OR severity > 0 OR open_positions >= 3 OR flicker > 4 AS must FROM s),
lev AS (SELECT *, CASE WHEN must THEN least(asked, 1.0e0) ELSE asked END AS lev, price - stop AS dist FROM forced),
n1 AS (SELECT *, floor(least(CASE WHEN dist <> 0 THEN 0.01e0 * equity / dist END, least(greatest(target, 0.0e0), 0.15e0) * (CASE WHEN severity = 1 THEN 0.5e0 ELSE 1.0e0 END) * equity / price)) AS sized FROM lev),
n2 AS (SELECT *, least(sized, CASE WHEN dist <> 0 THEN floor(0.02e0 * equity / (3.0e0 * dist)) END) AS gapped FROM n1),
n3 AS (SELECT *, (gross + gapped * price * lev) / equity > 1.25e0 + 1e-9 AS over FROM n2),
n4 AS (SELECT *, CASE WHEN over THEN greatest(floor((1.25e0 * equity - gross) / (price * lev)), 0) ELSE gapped END AS fitted, coalesce(max_correlation > 0.70e0, false) AS near FROM n3),
n5 AS (SELECT *, CASE WHEN near THEN floor(fitted * 0.5e0) ELSE fitted END AS final FROM n4),
verdict AS (SELECT *, CASE WHEN locked OR severity = 2 THEN 'halted' WHEN side <> 'buy' THEN 'long only' WHEN stop IS NULL THEN 'no stop' WHEN dist <= 0 THEN 'stop distance'
 WHEN NOT tradable THEN 'not tradable' WHEN (ask - bid) / ((ask + bid) / 2) > 0.005e0 THEN 'spread' WHEN is_duplicate THEN 'duplicate' WHEN trades_before >= 20 THEN 'daily limit'
 WHEN NOT is_held AND open_positions >= 5 THEN 'concurrency' WHEN sized <= 0 THEN 'sizing' WHEN gapped * price < 100 THEN 'least notional'
 WHEN over AND (fitted <= 0 OR fitted * price < 100) THEN 'exposure' WHEN buying_power <> 0 AND fitted * price * lev > buying_power THEN 'buying power'
 WHEN max_correlation > 0.85e0 THEN 'correlation' WHEN near AND final * price < 100 THEN 'least notional' WHEN (sector_gross + final * price) / equity > 0.30e0 THEN 'sector' END AS reason FROM n5),
out AS (SELECT *, CASE WHEN reason IS NULL THEN CAST(final AS BIGINT) ELSE 0 END AS shares, CASE WHEN reason IS NULL THEN array_to_string(list_filter([CASE WHEN must AND asked > 1 THEN 'leverage' END, CASE WHEN gapped < sized THEN 'gap' END, CASE WHEN over THEN 'exposure' END, CASE WHEN near THEN 'correlation' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS modifications FROM verdict)"""
_VETO = "s AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in SIGNAL.items()) + " FROM orders)" + _RULES


def decided(spark, sf):
    orders = src.read_table(spark, sf, "orders").selectExpr(*[f"{e} AS {c}" for c, e in SIGNAL.items()])
    return dec.veto_cascade(orders)


@query("e5_validate_signals", with_(_VETO, "SELECT order_id, reason, shares, round(lev, 6) AS leverage, modifications FROM out"))
def e5(spark, sf):
    return six(decided(spark, sf), "leverage").select("order_id", "reason", "shares", "leverage", "modifications")


#: What a signal and its quote bring along, and the state of its account, by a rule on their keys.
OWN = {"stop": "CASE WHEN order_id % 23 = 0 THEN NULL ELSE price * (0.86e0 + 0.02e0 * (order_id % 7)) END", **{c: SIGNAL[c].replace("o_orderkey", "order_id").replace("o_totalprice / 1000", "price") for c in ("side", "tradable", "bid", "ask", "probability", "flicker", "leverage", "target")}}
STANDING = {"equity": "300000e0 + 10 * c_acctbal", "buying_power": "20 * c_acctbal", "severity": SIGNAL["severity"].replace("o_custkey", "c_custkey"), "locked": "c_custkey % 101 = 0"}
SECTOR = "CASE WHEN CAST(substring(p_brand, 7) AS INT) % 6 <> 0 THEN CAST(substring(p_brand, 7) AS INT) % 6 END"

_ACCOUNTS = f"""px AS (SELECT p_brand AS series_id, lineitem.*, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON p_partkey = l_partkey),
mo AS (SELECT series_id, date_trunc('month', l_shipdate) AS ts, price, row_number() OVER (PARTITION BY series_id, date_trunc('month', l_shipdate) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS k FROM px),
mr AS (SELECT series_id, ts, price, ln(price / lag(price) OVER ({S})) AS ret, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS r FROM mo WHERE k = 1),
cr AS (SELECT a.series_id, b.series_id AS other, corr(a.ret, b.ret) AS c FROM mr a JOIN mr b ON a.ts = b.ts AND a.series_id <> b.series_id WHERE a.r <= 60 AND b.r <= 60 AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30),
sectors AS (SELECT DISTINCT p_brand AS series_id, {SECTOR} AS sector FROM part),
q AS (SELECT o_custkey AS account, series_id, sum(l_quantity) AS qty FROM px JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_linenumber = 1 GROUP BY 1, 2),
held AS (SELECT account, q.series_id, sector, qty * price AS mv FROM q JOIN mr ON mr.series_id = q.series_id AND r = 1 LEFT JOIN sectors ON sectors.series_id = q.series_id WHERE qty * price <> 0),
book AS (SELECT account, sum(abs(mv)) AS gross, count(*) AS n FROM held GROUP BY 1),
sec AS (SELECT account, sector, sum(abs(mv)) AS sg FROM held WHERE sector IS NOT NULL GROUP BY 1, 2),
od AS (SELECT * FROM (SELECT o_orderkey AS order_id, o_custkey AS account, o_orderstatus, o_orderdate AS ts, series_id, price, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_partkey DESC, l_linenumber DESC, l_quantity DESC) AS k FROM px JOIN orders ON o_orderkey = l_orderkey) WHERE k = 1),
own AS (SELECT *, {", ".join(f"{e} AS {c}" for c, e in OWN.items())} FROM od),
sent AS (SELECT order_id, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY account, series_id, side ORDER BY ts, order_id)) < 2592000, false) AS is_duplicate, row_number() OVER (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts, order_id) - 1 AS trades_before FROM own),
s AS (SELECT own.* EXCLUDE (k), is_duplicate, trades_before, {", ".join(f"{e} AS {c}" for c, e in STANDING.items())}, coalesce(gross, 0) AS gross, coalesce(n, 0) AS open_positions, h.mv IS NOT NULL AS is_held,
  CASE WHEN sectors.sector IS NOT NULL THEN coalesce(sg, 0) END AS sector_gross, (SELECT max(c) FROM held o JOIN cr ON cr.other = o.series_id WHERE o.account = own.account AND cr.series_id = own.series_id) AS max_correlation
  FROM own JOIN sent ON sent.order_id = own.order_id JOIN customer ON c_custkey = own.account LEFT JOIN book ON book.account = own.account LEFT JOIN held h ON h.account = own.account AND h.series_id = own.series_id
  LEFT JOIN sectors ON sectors.series_id = own.series_id LEFT JOIN sec ON sec.account = own.account AND sec.sector = sectors.sector WHERE o_orderstatus = 'O')"""


def account_signals(spark, sf):
    """Signals of open orders on their largest line's brand, with the state of their
    account joined from positions, all orders, sectors and monthly returns of brands."""
    lines = src.read_table(spark, sf, "lineitem").withColumn("price", F.try_divide("l_extendedprice", "l_quantity"))
    parts = src.read_table(spark, sf, "part")
    px = lines.join(parts.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("series_id")).hint("shuffle_hash"), "l_partkey")
    seq = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    months = px.groupBy("series_id", F.date_trunc("month", "l_shipdate").alias("ts")).agg(F.max_by("price", seq).alias("price"))
    returns = months.withColumn("ret", F.log(F.col("price") / F.lag("price").over(ordered())))
    marks = months.groupBy("series_id").agg(F.max_by("price", "ts").alias("close"))

    orders = src.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account"), "o_orderstatus", F.col("o_orderdate").alias("ts"))
    first = px.where("l_linenumber = 1").withColumnRenamed("l_orderkey", "order_id").join(orders.where("o_orderstatus = 'F'").hint("shuffle_hash"), "order_id")
    bought = first.groupBy("account", "series_id").agg(F.sum("l_quantity").alias("qty"), F.avg("price").alias("avg_price"))
    positions = risk.mark_to_market(bought, marks)

    main = px.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max_by(F.struct("series_id", "price"), F.struct("l_extendedprice", "l_partkey", "l_linenumber", "l_quantity")).alias("m"))
    sent = orders.join(main.hint("shuffle_hash"), "order_id").select("order_id", "account", "o_orderstatus", "ts", "m.*")
    sent = sent.selectExpr("*", *[f"{e} AS {c}" for c, e in OWN.items()])
    accounts = src.read_table(spark, sf, "customer").selectExpr("c_custkey AS account", *[f"{e} AS {c}" for c, e in STANDING.items()])
    sectors = parts.selectExpr("p_brand AS series_id", f"{SECTOR} AS sector").distinct()
    return dec.with_account_state(sent.where("o_orderstatus = 'O'"), accounts, positions, sent, sectors, returns, 2592000)


@query(
    "e5_account_cascade",
    with_(
        _ACCOUNTS + _RULES,
        "SELECT order_id, series_id, round(gross / equity, 6) AS gross_share, open_positions, is_held, is_duplicate, trades_before, round(sector_gross / equity, 6) AS sector_share, round(max_correlation, 6) AS max_correlation, reason, shares, round(lev, 6) AS leverage, modifications FROM out",
    ),
)
def e5_joined(spark, sf):
    df = dec.veto_cascade(account_signals(spark, sf)).withColumns({"gross_share": F.col("gross") / F.col("equity"), "sector_share": F.col("sector_gross") / F.col("equity")})
    return six(df, "leverage", "max_correlation", "gross_share", "sector_share").select("order_id", "series_id", "gross_share", "open_positions", "is_held", "is_duplicate", "trades_before", "sector_share", "max_correlation", "reason", "shares", "leverage", "modifications")


@query("a13_order_intents", with_(_VETO, "SELECT order_id, shares, round(price + 2 * (price - stop), 2) AS take_profit, round(stop, 2) AS stop_price, round(price * 1.001e0, 2) AS limit_price FROM out WHERE shares > 0"))
def a13(spark, sf):
    return dec.order_intents(decided(spark, sf)).select("order_id", "shares", "take_profit", "stop_price", "limit_price")


@query("a14_remaining_qty", "WITH f AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) SELECT o_orderkey AS order_id, greatest(40.0e0 - floor(coalesce(q, 0)), 0) AS remaining, 40 - floor(coalesce(q, 0)) <= 0 AS is_filled FROM orders LEFT JOIN f ON k = o_orderkey")
def a14(spark, sf):
    orders = src.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.lit(40.0).alias("requested"))
    fills = src.read_table(spark, sf, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("qty"))
    return dec.remaining_qty(orders, fills).select("order_id", "remaining", "is_filled")


@query("a12_risk_usage", with_(DAMPED + f", u AS (SELECT series_id, ts, (1 - equity / max(equity) OVER {sql_running()}) / 0.10e0 AS ratio FROM curve)", "SELECT series_id, ts, round(ratio, 6) AS ratio, CASE WHEN ratio < 0.5 THEN 'ok' WHEN ratio < 1 THEN 'warn' ELSE 'breach' END AS band FROM u"))
def a12(spark, sf):
    ratio, band = risk.usage_band(-F.col("drawdown"), F.lit(0.10))
    return perf.with_drawdown(curve(spark, sf)).select("series_id", "ts", F.round(ratio, 6).alias("ratio"), band.alias("band"))


@query("a10_latest_state", with_(_STATES, "SELECT series_id, max(ts) AS ts, arg_max(state_id, ts) AS state_id, arg_max(consecutive_bars, ts) AS consecutive_bars, round(arg_max(close, ts), 6) AS close FROM runs GROUP BY 1"))
def a10(spark, sf):
    last = reg.with_runs(states(spark, sf)).groupBy("series_id").agg(F.max("ts").alias("ts"), *[F.max_by(c, "ts").alias(c) for c in ("state_id", "consecutive_bars", "close")])
    return six(last, "close")


@query("a11_decision_log", with_(_STATES + ", r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS k FROM states)", "SELECT series_id, ts, state_id, round(close, 4) AS close FROM r WHERE k <= 20"))
def a11(spark, sf):
    lines = states(spark, sf).select("series_id", "ts", F.to_json(F.struct("state_id", "close")).alias("line"))
    read = src.latest_bars(lines, 20).select("series_id", "ts", F.from_json("line", "state_id int, close double").alias("v"))
    return read.select("series_id", "ts", "v.state_id", F.round("v.close", 4).alias("close"))


# --- model versions and drift -----------------------------------------------

_MODELS = mq.BLOCKS
versions = mq.versions


@query("c15_model_asof", with_(_MODELS, "SELECT d.series_id, d.ts, v.version FROM damped d ASOF LEFT JOIN v ON d.series_id = v.series_id AND d.ts >= v.ts"))
def c15(spark, sf):
    return reg.model_asof(damped(spark, sf), versions(spark, sf)).select("series_id", "ts", "version")


@query("c16_stale_models", "WITH m AS (SELECT o_custkey AS k, max(o_orderdate) AS t FROM orders GROUP BY 1) SELECT c_custkey AS series_id, round((epoch(TIMESTAMP '1998-12-31') - epoch(t)) / 86400, 6) AS age_days FROM customer LEFT JOIN m ON k = c_custkey WHERE t IS NULL OR (epoch(TIMESTAMP '1998-12-31') - epoch(t)) / 86400 > 30")
def c16(spark, sf):
    models = src.read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("series_id")).agg(F.max("o_orderdate").alias("trained_at"))
    names = src.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("series_id"))
    return six(reg.stale_models(names, models, F.lit("1998-12-31").cast("timestamp"), 30), "age_days").select("series_id", "age_days")


_PROB = "[1.0e0, 1.0e0 + abs(ret) * 100, 2.0e0]"


@query("c19_entropy_c20_drift", with_(DAMPED + f", p AS (SELECT series_id, ts, {_PROB} AS raw FROM damped), q AS (SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS pr FROM p), e AS (SELECT series_id, ts, -list_sum(list_transform(pr, lambda x: x * ln(x))) / ln(3) AS entropy FROM q)", "SELECT series_id, ts, round(entropy, 6) AS entropy, entropy > 0.8 AS drifted FROM e"))
def c19(spark, sf):
    raw = F.array(F.lit(1.0), 1.0 + F.abs("ret") * 100, F.lit(2.0))
    df = damped(spark, sf).withColumn("entropy", reg.posterior_entropy(raw)).withColumn("drifted", reg.drift_flag(F.lit(0.0), F.col("entropy")))
    return six(df, "entropy").select("series_id", "ts", "entropy", "drifted")


@query("c22_calm", with_(_INFO + ", r AS (SELECT series_id, state_id, (row_number() OVER (PARTITION BY series_id ORDER BY ev, state_id) - 1) / greatest(count(*) OVER (PARTITION BY series_id) - 1, 1) AS vr FROM info)", "SELECT s.series_id, s.ts, coalesce(vr, 1.0) < 0.67 AS calm FROM states s LEFT JOIN r ON r.series_id = s.series_id AND r.state_id = s.state_id"))
def c22(spark, sf):
    return reg.calm(states(spark, sf), reg.vol_rank(state_table(spark, sf))).select("series_id", "ts", "calm")


# --- allocation -------------------------------------------------------------


@query(
    "d6_target_weights",
    "WITH r AS (SELECT o_custkey AS account, o_orderkey AS series_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders), t AS (SELECT * FROM r WHERE k <= 5) SELECT account, series_id, round(least(0.6e0 / count(*) OVER (PARTITION BY account), 0.15e0), 6) AS weight FROM t",
)
def d6(spark, sf):
    names = src.read_table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("series_id"), (-F.col("o_totalprice")).alias("priority"), F.lit(0.6).alias("budget"))
    return six(risk.target_weights(names, ["account"]), "weight").select("account", "series_id", "weight")


@query(
    "d7_rebalance_orders",
    """WITH t AS (SELECT o_custkey AS k, 0.01e0 * (count(*) % 60) AS target FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), h AS (SELECT o_custkey AS k, 0.01e0 * (count(*) % 50) AS held FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
j AS (SELECT coalesce(t.k, h.k) AS account, coalesce(target, 0) AS target, coalesce(held, 0) AS held, t.k IS NOT NULL AS known FROM t FULL JOIN h ON t.k = h.k)
SELECT account, CASE WHEN target > held THEN 'buy' ELSE 'sell' END AS side, CAST(floor(abs(target - held) * 100000 / 50) AS BIGINT) AS shares FROM j WHERE known AND (target = 0 AND held > 0 OR abs(target - held) >= 0.02e0) AND floor(abs(target - held) * 100000 / 50) > 0""",
)
def d7(spark, sf):
    orders = src.read_table(spark, sf, "orders").withColumnRenamed("o_custkey", "account")
    of = lambda df, n: df.groupBy("account").agg((0.01 * (F.count("*") % n)).alias("weight"))
    target = of(orders.where("o_orderstatus = 'F'"), 60).withColumns({"price": F.lit(50.0), "equity": F.lit(100000.0)})
    return risk.rebalance_orders(target, of(orders.where("o_orderstatus <> 'F'"), 50), ["account"], 0.02).select("account", "side", "shares")


@query("d10_trailing_stop", with_(_STATES, f"SELECT series_id, ts, round(max(close * 0.9e0) OVER (PARTITION BY series_id, isl ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS trailing_stop FROM islands"))
def d10(spark, sf):
    df = states(spark, sf).withColumn("_new", F.when(F.lag("state_id").over(ordered()).eqNullSafe(F.col("state_id")), 0).otherwise(1))
    df = df.withColumn("segment", F.sum("_new").over(ordered().rowsBetween(Window.unboundedPreceding, 0))).withColumn("stop", F.col("close") * 0.9)
    return six(risk.trailing_stop(df), "trailing_stop").select("series_id", "ts", "trailing_stop")


@query("h7_holding_bars", with_(TREND + f", g AS (SELECT series_id, ts, weight, sum(CASE WHEN weight > 0 AND coalesce(lag_w, 0) <= 0 THEN 1 ELSE 0 END) OVER {sql_running()} AS seg FROM (SELECT *, lag(weight) OVER ({S}) AS lag_w FROM trend))", "SELECT series_id, ts, CAST(CASE WHEN weight > 0 THEN row_number() OVER (PARTITION BY series_id, seg ORDER BY ts) - 1 ELSE 0 END AS BIGINT) AS holding_bars FROM g"))
def h7(spark, sf):
    held = perf.trend_weights(damped(spark, sf)).withColumn("held", F.col("weight"))
    return risk.holding_bars(held).select("series_id", "ts", F.col("holding_bars").cast("long").alias("holding_bars"))


@query("h3_h4_exposure", "WITH p AS (SELECT l_suppkey AS account, l_partkey AS k, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS q, min(l_extendedprice) AS a FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey AS k, max(l_extendedprice) AS c FROM lineitem GROUP BY 1) SELECT account, round(sum(abs(q * c)), 2) AS gross, round(sum(q * c), 2) AS net, round(sum((c - a) * q), 2) AS unrealized FROM p JOIN m ON p.k = m.k GROUP BY 1")
def h3(spark, sf):
    rows = src.read_table(spark, sf, "lineitem")
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    held = rows.groupBy(F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("series_id")).agg(F.sum(qty).alias("qty"), F.min("l_extendedprice").alias("avg_price"))  # whole cents: exact sums
    prices = rows.groupBy(F.col("l_partkey").alias("series_id")).agg(F.max("l_extendedprice").alias("close"))
    out = risk.exposure_snapshot(risk.mark_to_market(held, prices))
    return out.select("account", *[F.round(c, 2).alias(c) for c in ("gross", "net", "unrealized")])


# --- stress, benchmarks, alerts ---------------------------------------------

SHOCKS = tuple((k, 40 + 70 * k, -0.02 * (1 + k % 5)) for k in range(1, 11))
_SHOCKED = DAMPED + f""",
o AS (SELECT series_id, ts, ret, row_number() OVER ({S}) - 1 AS i FROM damped), sc(k, a, m) AS (VALUES {', '.join(f'({k}, {a}, {m:.2f}e0)' for k, a, m in SHOCKS)}),
sh AS (SELECT k AS scenario_id, series_id, ts, CASE WHEN i = a THEN (1 + ret) * (1 + m) - 1 ELSE ret END AS ret FROM o CROSS JOIN sc),
cv AS (SELECT *, 100000 * product(1 + ret) OVER {sql_running('scenario_id, series_id')} AS equity FROM sh),
pk AS (SELECT *, max(equity) OVER {sql_running('scenario_id, series_id')} AS pk, product(1 + ret) OVER {frame(5, 'scenario_id, series_id')} - 1 AS r5 FROM cv),
sv AS (SELECT *, equity / pk - 1 AS dd, greatest(CASE WHEN ret <= -0.03 THEN 2 WHEN ret <= -0.02 THEN 1 ELSE 0 END, CASE WHEN r5 <= -0.07 THEN 2 WHEN r5 <= -0.05 THEN 1 ELSE 0 END, CASE WHEN (pk - equity) / pk >= 0.10 THEN 2 ELSE 0 END) AS severity FROM pk)"""
PATH = ("scenario_id", "series_id")


def shocked(spark, sf):
    points = F.array(*[F.struct(F.lit(k).alias("scenario_id"), F.lit(a).alias("at"), F.lit(m).alias("shock")) for k, a, m in SHOCKS])
    df = damped(spark, sf).withColumn("_i", F.row_number().over(ordered()) - 1).withColumn("_s", F.explode(points)).select("series_id", "ts", "ret", "_i", "_s.*")
    df = df.withColumn("ret", F.when(F.col("_i") == F.col("at"), (1 + F.col("ret")) * (1 + F.col("shock")) - 1).otherwise(F.col("ret")))
    return risk.drawdown_posture(perf.buy_hold(df, CAPITAL, PATH), PATH)


@query("f13_stress_report", with_(_SHOCKED + ", p AS (SELECT series_id, scenario_id, min(dd) AS loss, max(severity) AS worst FROM sv GROUP BY 1, 2)", "SELECT series_id, count(*) AS paths, round(avg(loss), 6) AS mean_max_loss, round(min(loss), 6) AS worst_max_loss, round(avg(CASE WHEN worst > 0 THEN 1.0 ELSE 0.0 END), 6) AS fired_rate, round(avg(CASE WHEN loss <= -0.25 THEN 1.0 ELSE 0.0 END), 6) AS blow_up_rate FROM p GROUP BY 1"))
def f13(spark, sf):
    return six(dec.stress_report(shocked(spark, sf), ["scenario_id"], ["series_id"]), "mean_max_loss", "worst_max_loss", "fired_rate", "blow_up_rate")


@query("f14_breaker_bars", with_(_SHOCKED, "SELECT scenario_id, series_id, min(ts) AS first_ts, round(arg_min(equity, ts), 2) AS equity, arg_min(severity, ts) AS severity, count(*) AS bars FROM sv WHERE severity > 0 GROUP BY 1, 2"))
def f14(spark, sf):
    return dec.breaker_bars(shocked(spark, sf), PATH).withColumn("equity", F.round("equity", 2))


GRID = [*((f, 0) for f in (0.0, 0.25, 0.5, 1.0)), *((f, k) for k in (3, 5, 10) for f in (0.0, 0.25))]


def swept(spark, sf):
    """Replays of the whole grid: each (series, point) is one group of one fold."""
    df = damped(spark, sf).withColumns({"target": F.when(F.col("ret") > 0, 0.95).otherwise(0.6), "natr": F.abs("ret"), "calm": F.abs(F.col("ret")) < 0.01})
    out = risk.replay_allocation(dec.with_parameters(df, GRID), CAPITAL, keys=("series_id", "point"))
    before = F.coalesce(F.lag("equity").over(ordered(("series_id", "point"))), F.lit(CAPITAL))
    return out.withColumn("net", F.col("equity") / before - 1)


@query(
    "f15_parameter_sweep",
    with_(
        replay_sql(", ".join(f"({i}, {f}e0, {k})" for i, (f, k) in enumerate(GRID)))
        + f""",
nets AS (SELECT series_id, point, ts, equity, equity / coalesce(lag(equity) OVER (PARTITION BY series_id, point ORDER BY ts), {CAPITAL}) - 1 AS ret, equity / max(equity) OVER {sql_running('series_id, point')} - 1 AS dd FROM replayed),
scores AS (SELECT series_id, point, arg_max(equity, ts) / {CAPITAL} - 1 AS total_return, {SHARPE} AS sharpe, min(dd) AS max_drawdown FROM nets GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY sharpe DESC, point) AS r FROM scores)""",
        "SELECT series_id, point, round(total_return, 6) AS total_return, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown FROM best WHERE r = 1",
        True,
    ),
)
def f15(spark, sf):
    scores = dec.path_summary(swept(spark, sf), "net", CAPITAL, ("series_id", "point"))
    return six(dec.best_point(scores), "total_return", "sharpe", "max_drawdown")


@query("f6_trailing_return", with_(TREND, f"SELECT series_id, ts, round(product(1 + gross) OVER {frame(5)} - 1, 6) AS trailing_return FROM eq"))
def f6(spark, sf):
    five = F.product(1 + F.col("gross")).over(ordered().rowsBetween(-4, 0)) - 1
    return trend_path(spark, sf).select("series_id", "ts", F.round(five, 6).alias("trailing_return"))


_DRAW = "((seed * 7919 + bar_no * 104729 + seed * bar_no * 31) % 1009) % 4"
_RANDOM = DAMPED + f""",
o AS (SELECT series_id, ts, ret, row_number() OVER ({S}) AS bar_no FROM damped), w AS (SELECT *, (['0.0', '0.6', '0.95', '1.1875'])[{_DRAW} + 1]::DOUBLE AS weight FROM o CROSS JOIN (SELECT unnest(range(1, 101)) AS seed)),
b AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY series_id, seed ORDER BY ts), 0.0) AS before FROM w), n AS (SELECT *, (1 + before * ret) * (1 - abs(weight - before) * 0.0005e0) - 1 AS net FROM b),
each AS (SELECT series_id, seed, product(1 + net) - 1 AS tr, CASE WHEN stddev_pop(net) > 0 THEN avg(net) / stddev_pop(net) * sqrt(252.0) ELSE 0 END AS sh FROM n GROUP BY 1, 2)"""


@query("g14_random_allocation", with_(_RANDOM, "SELECT series_id, count(*) AS seeds, round(avg(tr), 6) AS mean_return, round(stddev_pop(tr), 6) AS std_return, round(avg(sh), 6) AS mean_sharpe, round(stddev_pop(sh), 6) AS std_sharpe FROM each GROUP BY 1"))
def g14(spark, sf):
    out = dec.random_allocation(dec.random_paths(damped(spark, sf), 100, F.expr(_DRAW), capital=CAPITAL), CAPITAL)
    return six(out, "mean_return", "std_return", "mean_sharpe", "std_sharpe")


_TABLE = TREND + f""",
paths AS (SELECT 'trend' AS strategy, series_id, ts, net AS ret, equity FROM eq UNION ALL SELECT 'buy_hold', series_id, ts, ret, equity FROM curve),
dd AS (SELECT *, equity / max(equity) OVER {sql_running('strategy, series_id')} - 1 AS dd FROM paths),
steps AS (SELECT strategy, series_id, ts, equity, dd, equity / lag(equity) OVER (PARTITION BY strategy, series_id ORDER BY ts) - 1 AS ret FROM dd),
summary AS (SELECT strategy, series_id, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return, pow(arg_max(equity, ts) / arg_min(equity, ts), 252.0 / count(*)) - 1 AS cagr, {SHARPE} AS sharpe, min(dd) AS max_drawdown FROM steps GROUP BY 1, 2)"""


def summaries(spark, sf):
    return perf.benchmark_metrics(trend_path(spark, sf)), perf.benchmark_metrics(curve(spark, sf))


@query("g15_benchmark_table", with_(_TABLE, "SELECT strategy, series_id, round(total_return, 6) AS total_return, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown FROM summary"))
def g15(spark, sf):
    trend, hold = summaries(spark, sf)
    both = trend.withColumn("strategy", F.lit("trend")).unionByName(hold.withColumn("strategy", F.lit("buy_hold")))
    return six(both, "total_return", "sharpe", "max_drawdown").select("strategy", "series_id", "total_return", "sharpe", "max_drawdown")


@query("g18_f16_beats", with_(_TABLE, "SELECT a.series_id, a.total_return > b.total_return AS beats_raw, a.sharpe > b.sharpe AND a.max_drawdown > b.max_drawdown AS beats_risk_adjusted FROM summary a JOIN summary b ON a.series_id = b.series_id AND a.strategy = 'trend' AND b.strategy = 'buy_hold'"))
def g18(spark, sf):
    trend, hold = summaries(spark, sf)
    return perf.beats(trend, hold, ["series_id"]).select("series_id", "beats_raw", "beats_risk_adjusted")


_CHANGES = _STATES + f", cb AS (SELECT *, row_number() OVER ({S}) AS n, last_value(CASE WHEN consecutive_bars >= 3 THEN state_id END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef0 FROM runs), fl AS (SELECT series_id, ts, sum(c) OVER {frame(19)} > 4 AS hot FROM flags), "


# --- portfolios -------------------------------------------------------------

_CAPS = (0.15, 0.25, 0.35)


@query(
    "f9_replay_portfolio",
    with_(
        TREND
        + f""",
c(cap) AS (VALUES {", ".join(f"({x}e0)" for x in _CAPS)}),
b AS (SELECT ts, CAST(weight AS DOUBLE) AS budget FROM trend WHERE series_id = 'N'),
n AS (SELECT cap, t.series_id, t.ts, ret, coalesce(budget, 0) AS budget, row_number() OVER (PARTITION BY cap, t.ts ORDER BY t.series_id) AS k, count(*) OVER (PARTITION BY cap, t.ts) AS names FROM trend t LEFT JOIN b ON b.ts = t.ts CROSS JOIN c),
w AS (SELECT *, CASE WHEN budget > 0 AND k <= 2 THEN least(budget / least(names, 2), cap) ELSE 0 END AS weight FROM n),
l AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY cap, series_id ORDER BY ts), 0) AS prior FROM w),
g AS (SELECT cap, ts, (1 + sum(prior * ret)) * (1 - 0.0005e0 * sum(abs(weight - prior))) - 1 AS net FROM l GROUP BY 1, 2)""",
        "SELECT cap, ts, round(net, 6) AS net, round(100000 * product(1 + net) OVER (PARTITION BY cap ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS equity FROM g",
    ),
)
def f9(spark, sf):
    weights = perf.trend_weights(damped(spark, sf))
    budget = weights.where("series_id = 'N'").select("ts", F.col("weight").cast("double").alias("budget"))
    names = weights.select("series_id", "ts", "ret", F.col("series_id").alias("priority")).join(budget.hint("shuffle_hash"), "ts", "left")
    names = names.withColumn("cap", F.explode(F.array(*[F.lit(x) for x in _CAPS])))
    return risk.replay_portfolio(names, CAPITAL, most=2, keys=("cap",)).select("cap", "ts", F.round("net", 6).alias("net"), F.round("equity", 2).alias("equity"))


@query(
    "j1_alert_candidates",
    with_(
        _CHANGES + _LATCH[len(DAMPED) + 2 :],
        """SELECT series_id, ts, 'regime_change' AS kind, 'info' AS level FROM cb WHERE consecutive_bars >= 3 AND n >= 2 AND (bef0 IS NULL OR bef0 <> state_id)
UNION ALL SELECT series_id, ts, 'posture_change', CASE WHEN sev = 2 THEN 'critical' ELSE 'warning' END FROM d5 WHERE sev <> bef UNION ALL SELECT series_id, ts, 'flicker', 'warning' FROM fl WHERE hot""",
    ),
)
def j1(spark, sf):
    runs = states(spark, sf)
    changes = reg.confirmed_changes(reg.with_runs(runs), "state_id").where("changed")
    events = risk.breaker_events(risk.latched_breaker(curve(spark, sf)))
    return dec.alerts(changes, events, reg.with_flicker(runs).where("is_flickering"))
