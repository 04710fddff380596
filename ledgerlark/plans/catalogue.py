"""Registered queries over the driver tables and the SQL that each must agree with.

Portfolio tables are not among them, so each query is an analogy: parts are
what is held, line items are lots, part types are sectors, events are quotes and
bars, months of orders are a portfolio's history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.functions.formats import dollars, grouped, iso_day, month_day, signed_percent
from ledgerlark.functions.semantics import cents, if_set, or_else, ratio, round_half_up, text_or_else, try_number
from ledgerlark.operators import carry, matching, optimising, positions, ranking, rebalancing, series, valuation, wide_tables
from ledgerlark.operators.allocation import allocation, concentration, largest
from ledgerlark.plans.shared import new_path, written
from ledgerlark.plans.tables import read_table
from ledgerlark.sources import envelopes, landed, readers
from ledgerlark.sources.readers import only_symbols, symbols

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def _text(column: str):
    """A date as text, which all engines show alike."""
    return F.col(column).cast("string").alias(column)


# Holdings: a row for each part that was sold, with its cost per piece, the price of its latest lots (missing for some, 0 for others) and pieces.
_HOLDINGS_SQL = """
    raw AS (SELECT p_partkey AS input_pos, p_name AS ticker, p_type AS sector, p_retailprice AS entry_price,
              CASE WHEN p_partkey % 7 = 3 THEN NULL WHEN p_partkey % 11 = 5 THEN 0.0::DOUBLE ELSE (c // 20) / 100.0::DOUBLE END AS current_price, shares
            FROM (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS shares, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c FROM lineitem GROUP BY 1) JOIN part ON l_partkey = p_partkey),
    v AS (SELECT *, CASE WHEN current_price <> 0 THEN current_price * shares END AS val, CASE WHEN current_price <> 0 THEN (current_price - entry_price) / entry_price * 100 END AS d FROM raw),
    holdings AS (SELECT * EXCLUDE (val, d), floor(entry_price * shares * 100 + 0.5) / 100.0::DOUBLE AS initial_investment,
              CASE WHEN val <> 0 THEN floor(val * 100 + 0.5) / 100.0::DOUBLE END AS current_investment, CASE WHEN d <> 0 THEN floor(d * 100 + 0.5) / 100.0::DOUBLE END AS delta FROM v)
"""


def _holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("shares"), F.max(cents(F.col("l_extendedprice"))).alias("c"))
    parts = read_table(spark, sf_dir, "part")
    price = F.when(F.col("p_partkey") % 7 == 3, None).when(F.col("p_partkey") % 11 == 5, 0.0).otherwise(F.expr("c div 20") / F.lit(100.0))
    raw = lots.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("input_pos"), F.col("p_name").alias("ticker"), F.col("p_type").alias("sector"), F.col("p_retailprice").alias("entry_price"), price.alias("current_price"), "shares"
    )
    return positions.derived(raw)


# Quotes: the latest event of each user, whose number is a part's.
_QUOTES_SQL = """
    ranked AS (SELECT user_id, value AS price, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS previous_close, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events),
    quotes AS (SELECT user_id AS input_pos, price, CASE WHEN user_id % 5 = 0 THEN 0.0::DOUBLE ELSE previous_close END AS previous_close FROM ranked WHERE rn = 1)
"""


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a limit by rank, which Spark applies in each task before rows are shuffled
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts")))
    last = read_table(spark, sf_dir, "events").select("user_id", "ts", "value").withColumn("rank", rank).filter("rank <= 2")
    found = last.groupBy("user_id").agg(F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("price"), F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("previous_close"))
    return found.select(F.col("user_id").alias("input_pos"), "price", F.when(F.col("user_id") % 5 == 0, 0.0).otherwise(F.col("previous_close")).alias("previous_close"))


# History: cents of orders by month.
_MONTHS_SQL = """
    months AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1)
"""


def _months(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), *by).agg(F.sum(cents(F.col("o_totalprice"))).alias("cents"))


_SEGMENT_MONTHS_SQL = """
    seg AS (SELECT c_mktsegment AS segment, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    ends AS (SELECT segment, arg_min(cents, month) AS inception, arg_max(cents, month) AS current FROM seg GROUP BY 1),
    rets AS (SELECT segment, inception, current, (current - inception) / CAST(inception AS DOUBLE) * 100 AS ret FROM ends)
"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    orders = read_table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    by_month = orders.groupBy("segment", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.sum(cents(F.col("o_totalprice"))).alias("cents"))
    ends = by_month.groupBy("segment").agg(F.min_by("cents", "month").alias("inception"), F.max_by("cents", "month").alias("current"))
    return ends.withColumn("ret", ratio(F.col("current") - F.col("inception"), F.col("inception")) * 100)


def _lot_value(spark: SparkSession, sf_dir: str, group: str) -> DataFrame:
    lots = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(cents(F.col("l_extendedprice"))).alias("cents"))
    return allocation(lots.join(read_table(spark, sf_dir, "part").select("p_partkey", group), F.col("l_partkey") == F.col("p_partkey")), group, "cents")


@query("""
    WITH a AS (SELECT p_type, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT p_type, value, round(CAST(value AS DOUBLE) / (sum(value) OVER ())::DOUBLE * 100, 6) AS share_pct, round(CAST(value AS DOUBLE) / max(value) OVER (), 6) AS to_largest FROM a
""")
def sector_allocation(spark, sf_dir):
    return _lot_value(spark, sf_dir, "p_type").select("p_type", "value", F.round("share_pct", 6).alias("share_pct"), F.round("to_largest", 6).alias("to_largest"))


@query("""
    WITH a AS (SELECT p_brand, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    t AS (SELECT *, sum(value) OVER () AS whole FROM a ORDER BY value DESC, p_brand LIMIT 5)
    SELECT round(CAST(sum(value) AS DOUBLE) / any_value(whole)::DOUBLE * 100, 6) AS concentration_pct, count(*) AS n_groups FROM t
""")
def concentration_top5(spark, sf_dir):
    return concentration(_lot_value(spark, sf_dir, "p_brand"), "p_brand").select(F.round("concentration_pct", 6).alias("concentration_pct"), "n_groups")


@query(f"WITH {_HOLDINGS_SQL} SELECT input_pos, ticker, sector, entry_price, current_price, shares, initial_investment, current_investment, delta FROM holdings")
def position_pnl(spark, sf_dir):
    return _holdings(spark, sf_dir)


_TOTALS_SQL = """
    c AS (SELECT *, CAST(round(initial_investment * 100) AS BIGINT) AS cost, CAST(round(current_investment * 100) AS BIGINT) AS val, current_price IS NOT NULL AND current_investment IS NOT NULL AS priced FROM holdings),
    s AS (SELECT CAST(coalesce(sum(cost), 0) AS BIGINT) AS total_initial, CAST(coalesce(sum(cost) FILTER (priced), 0) AS BIGINT) AS priced_initial, CAST(coalesce(sum(val) FILTER (priced), 0) AS BIGINT) AS priced_current,
             CAST(coalesce(sum(cost) FILTER (current_price IS NULL), 0) AS BIGINT) AS unpriced_initial, count(*) AS n_holdings, count(*) FILTER (priced) AS n_priced, count(*) FILTER (current_price IS NULL) AS n_unpriced FROM c)
"""


@query(f"""
    WITH {_HOLDINGS_SQL}, {_TOTALS_SQL}
    SELECT s.*, priced_current + unpriced_initial AS estimated_current, round((priced_current + unpriced_initial - total_initial)::DOUBLE / total_initial * 100, 6) AS estimated_return,
      round((priced_current - priced_initial)::DOUBLE / priced_initial * 100, 6) AS priced_return,
      (SELECT string_agg(input_pos, ',' ORDER BY coalesce(delta, 0) DESC, input_pos) FROM (SELECT * FROM holdings ORDER BY coalesce(delta, 0) DESC, input_pos LIMIT 5)) AS gainers,
      (SELECT string_agg(input_pos, ',' ORDER BY coalesce(delta, 0), input_pos DESC) FROM (SELECT * FROM holdings ORDER BY coalesce(delta, 0), input_pos DESC LIMIT 5)) AS losers
    FROM s
""")
def portfolio_metrics(spark, sf_dir):
    # written once: sums and both lists read it, and lots are scanned and summed once
    held = written(_holdings(spark, sf_dir).select("input_pos", "current_price", "initial_investment", "current_investment", "delta"), "holdings")
    listed = lambda rows, sign, name: rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((sign * F.coalesce("delta", F.lit(0.0))).alias("d"), (-sign * F.col("input_pos")).alias("p")))), lambda x: F.abs(x["p"]).cast("string")), ",").alias(name))
    gainers = listed(ranking.top(held, "delta", 5, "input_pos"), -1, "gainers")
    losers = listed(ranking.bottom(held, "delta", 5, "input_pos"), 1, "losers")
    sums = positions.totals(held).withColumns({c: F.round(c, 6) for c in ("estimated_return", "priced_return")})
    return sums.crossJoin(F.broadcast(gainers)).crossJoin(F.broadcast(losers))


@query(f"WITH {_HOLDINGS_SQL}, {_TOTALS_SQL} SELECT n_holdings - n_priced - n_unpriced AS n_gap, total_initial - priced_initial - unpriced_initial AS gap FROM s")
def zero_price_gap(spark, sf_dir):
    return positions.totals(_holdings(spark, sf_dir)).select((F.col("n_holdings") - F.col("n_priced") - F.col("n_unpriced")).alias("n_gap"), (F.col("total_initial") - F.col("priced_initial") - F.col("unpriced_initial")).alias("gap"))


@query("""
    WITH t AS (SELECT o_totalprice - 200000 AS ret FROM orders)
    SELECT count(*) FILTER (ret > 0) AS winners, count(*) AS total, round(count(*) FILTER (ret > 0)::DOUBLE / count(*) * 100, 6) AS rate_pct FROM t
""")
def win_rate(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").withColumn("ret", F.col("o_totalprice") - 200000)
    part = lambda s: orders.filter(F.col("o_orderstatus") == s).select("o_orderkey", "ret")
    return positions.win_rate(part("O"), part("F"), part("P")).withColumn("rate_pct", F.round("rate_pct", 6))


_DAYS_SQL = "days AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1)"


def _days(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.sum(cents(F.col("value"))).alias("cents"))


@query(f"WITH {_DAYS_SQL}, d AS (SELECT CASE row_number() OVER (ORDER BY day) WHEN 1 THEN NULL WHEN 2 THEN cents ELSE cents - lag(cents) OVER (ORDER BY day) END AS x FROM days) SELECT count(*) FILTER (x > 0) AS green, count(*) FILTER (x <= 0) AS red FROM d")
def sign_split_counts(spark, sf_dir):
    changes = series.period_changes(_days(spark, sf_dir).withColumn("of", F.lit(0)), ["of"], "day", ["cents"])
    return positions.sign_counts(changes, "cents_change")


_RET_SQL = "r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice - 200000 END AS ret FROM orders)"


def _order_returns(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice") - 200000).alias("ret"))


@query(f"WITH {_RET_SQL} SELECT * FROM r ORDER BY coalesce(ret, 0) DESC, o_orderkey LIMIT 5")
def top_gainers(spark, sf_dir):
    return ranking.top(_order_returns(spark, sf_dir), "ret", 5, "o_orderkey")


@query(f"WITH {_RET_SQL} SELECT * FROM r ORDER BY coalesce(ret, 0), o_orderkey DESC LIMIT 5")
def top_losers(spark, sf_dir):
    return ranking.bottom(_order_returns(spark, sf_dir), "ret", 5, "o_orderkey")


@query(f"WITH {_RET_SQL}, b AS (SELECT * FROM r ORDER BY coalesce(ret, 0), o_orderkey DESC LIMIT 5) SELECT * FROM b WHERE coalesce(ret, 0) < 10 ORDER BY coalesce(ret, 0), o_orderkey DESC LIMIT 3")
def laggards_filtered(spark, sf_dir):
    return ranking.laggards(_order_returns(spark, sf_dir), "ret", 10, "o_orderkey")


_SORTED = {"sort_price_asc": (ranking.SortState("entry_price", 0), "entry_price ASC, input_pos"), "sort_delta_desc": (ranking.SortState("delta", 1), "coalesce(nullif(delta, 0), -999) DESC, input_pos"), "sort_value_asc": (ranking.SortState("current_investment", 0), "coalesce(current_investment, 0) ASC, input_pos"), "sort_name": (ranking.SortState("delta", 2), "ticker ASC, input_pos"), "sort_unknown_key": (ranking.SortState("none", 1), "input_pos")}
_SORTED_POSITIONS = {"sort_positions_shares_desc": (ranking.SortState("shares", 1), "shares DESC, input_pos"), "sort_positions_invested_asc": (ranking.SortState("initial_investment", 0), "initial_investment ASC, input_pos"), "sort_positions_ticker_desc": (ranking.SortState("ticker", 1), "ticker DESC, input_pos"), "sort_positions_return_asc": (ranking.SortState("return_pct", 0), "delta ASC NULLS FIRST, input_pos")}


def _sorted_query(state, keys):
    def run(spark, sf_dir):
        held = _holdings(spark, sf_dir).withColumn("return_pct", F.col("delta"))
        return ranking.globally_numbered(held, ranking.order_of(state, keys)).select("sector", "rank", "input_pos", "ticker")

    return run


for _keys, _sorts in ((ranking.HOLDING_KEYS, _SORTED), (ranking.POSITION_KEYS, _SORTED_POSITIONS)):
    for _name, (_state, _order) in _sorts.items():
        query(f"WITH {_HOLDINGS_SQL} SELECT sector, row_number() OVER (ORDER BY {_order}) AS rank, input_pos, ticker FROM holdings", _name)(_sorted_query(_state, _keys))


@query(f"""
    WITH {_HOLDINGS_SQL}, {_QUOTES_SQL},
    s AS (SELECT CASE WHEN count(price) > 0 THEN CAST(sum(shares * coalesce(CAST(round(price * 100) AS BIGINT), 0)) AS BIGINT) END AS stock FROM holdings LEFT JOIN quotes USING (input_pos))
    SELECT stock AS stock_value, CASE WHEN stock <> 0 THEN stock + 82076 + 8280 ELSE 10000000 END AS live_value FROM s
""")
def live_value(spark, sf_dir):
    stock = valuation.stock_value(_holdings(spark, sf_dir).select("input_pos", "shares"), _quotes(spark, sf_dir), "input_pos")
    return stock.withColumn("live_value", valuation.total_value(F.col("stock_value"), F.lit(82076), F.lit(8280), F.lit(10000000)).cast("bigint"))


@query(f"""
    WITH {_HOLDINGS_SQL}, {_QUOTES_SQL},
    c AS (SELECT CAST(coalesce(sum(CASE WHEN previous_close <> 0 THEN shares * (CAST(round(price * 100) AS BIGINT) - CAST(round(previous_close * 100) AS BIGINT)) END), 0) AS BIGINT) AS change FROM holdings JOIN quotes USING (input_pos))
    SELECT change, round(change::DOUBLE / (1000000000 - change) * 100, 6) AS change_pct FROM c
""")
def daily_change(spark, sf_dir):
    moved = valuation.daily_change(_holdings(spark, sf_dir).select("input_pos", "shares"), _quotes(spark, sf_dir), "input_pos")
    return moved.withColumn("change_pct", F.round(valuation.change_pct(F.col("change"), F.lit(1000000000)), 6))


@query("""
    SELECT c_custkey, coalesce(nullif(n_name, ''), '-') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey
""")
def dimension_default(spark, sf_dir):
    nations = read_table(spark, sf_dir, "nation").filter("n_regionkey <> 2").withColumnRenamed("n_nationkey", "c_nationkey")
    return valuation.with_dimension(read_table(spark, sf_dir, "customer"), nations, "c_nationkey", "n_name", "-").select("c_custkey", "n_name")


@query("""
    WITH t AS (SELECT 'W1' AS week, CAST(l_shipdate AS DATE) AS exec_date, l_partkey AS ticker, 'BUY' AS action, l_quantity AS shares FROM lineitem WHERE l_shipdate < DATE '1997-01-01'
      UNION ALL SELECT 'W2', CAST(l_shipdate AS DATE), l_partkey, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END, l_quantity FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01'
      UNION ALL SELECT 'W3', CAST(l_shipdate AS DATE), l_partkey, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END, l_quantity FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' OR l_shipdate IS NULL),
    p AS (SELECT CAST(o_orderdate AS DATE) AS exec_date, o_custkey AS ticker, max(o_totalprice) AS price FROM orders GROUP BY 1, 2)
    SELECT week, CAST(exec_date AS VARCHAR) AS exec_date, ticker, action, shares, price FROM t LEFT JOIN p USING (exec_date, ticker)
""")
def trade_history(spark, sf_dir):
    lots = read_table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("time"), F.col("l_shipdate").cast("date").alias("exec_date"), F.col("l_partkey").alias("ticker"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("action"), F.col("l_quantity").alias("shares"), F.lit(0).alias("at"))
    # every lot is in one of the parts: one scan, in which each part is a condition
    trades = matching.labelled_history(lots, ("W1", "BUY", F.col("time") < "1997-01-01"), ("W2", None, F.col("time") < "1998-01-01"), ("W3", None, F.lit(True)))
    prices = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("exec_date"), F.col("o_custkey").alias("ticker")).agg(F.max("o_totalprice").alias("price"))
    return matching.with_prices(trades, prices).select("week", _text("exec_date"), "ticker", "action", "shares", "price")


@query(f"""
    WITH {_MONTHS_SQL}, u AS (SELECT month, cents FROM months UNION ALL SELECT DATE '2030-01-01', CAST(sum(cents) AS BIGINT) FROM months)
    SELECT CAST(month AS VARCHAR) AS month, cents, lead(month) OVER (ORDER BY month) IS NULL AS is_last FROM u
""")
def append_current_row(spark, sf_dir):
    months = _months(spark, sf_dir)
    now = months.agg(F.lit("2030-01-01").cast("date").alias("month"), F.sum("cents").alias("cents"))
    return series.flag_last(series.append_current(months, now).withColumn("of", F.lit(0)), ["of"], "month").select(_text("month"), "cents", "is_last")


def _bars_sql(order: str) -> str:
    return f"""
    WITH m AS (SELECT t.event_id AS trade_id, t.user_id, t.ts AS at, b.event_id AS bar_seq, b.ts AS bar_ts, b.value AS open, abs(epoch_us(t.ts) - epoch_us(b.ts)) AS away
               FROM events t JOIN events b ON t.user_id = b.user_id AND t.event_type = 'purchase' AND b.event_type <> 'purchase' AND abs(epoch_us(t.ts) - epoch_us(b.ts)) < 86400000000)
    SELECT trade_id, user_id, bar_seq, open FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY {order}) AS rn FROM m) WHERE rn = 1
    """


def _bars_query(mode):
    def run(spark, sf_dir):
        events = read_table(spark, sf_dir, "events")
        trades = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("trade_id"), "user_id", F.col("ts").alias("at"))
        bars = events.filter("event_type <> 'purchase'").select(F.col("event_id").alias("bar_seq"), "user_id", F.col("ts").alias("bar_ts"), F.col("value").alias("open"))
        return matching.match_bars(trades, bars, "user_id", mode).select("trade_id", "user_id", "bar_seq", "open")

    return run


query(_bars_sql("bar_seq"), "exec_price_first")(_bars_query(matching.FIRST))
query(_bars_sql("away, bar_ts, bar_seq"), "exec_price_nearest")(_bars_query(matching.NEAREST))


@query("""
    WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2),
    c AS (SELECT event_type, day, CAST(sum(cents) OVER w AS BIGINT) AS cumulative, row_number() OVER w AS n FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day))
    SELECT event_type, CAST(day AS VARCHAR) AS day, cumulative, cumulative_change
    FROM (SELECT *, CASE n WHEN 2 THEN cumulative ELSE cumulative - lag(cumulative) OVER (PARTITION BY event_type ORDER BY day) END AS cumulative_change FROM c) WHERE n > 1
""")
def period_changes(spark, sf_dir):
    days = read_table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.sum(cents(F.col("value"))).alias("cents"))
    running = days.select("event_type", "day", F.sum("cents").over(Window.partitionBy("event_type").orderBy("day")).alias("cumulative"))
    return series.period_changes(running, ["event_type"], "day", ["cumulative"]).select("event_type", _text("day"), "cumulative", "cumulative_change")


@query("""
    WITH m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1, 2)
    SELECT series, CAST(month AS VARCHAR) AS month, round(cents::DOUBLE / first_value(cents) OVER (PARTITION BY series ORDER BY month) - 1, 6) AS since_first FROM m
""")
def ratio_to_first(spark, sf_dir):
    months = _months(spark, sf_dir, "o_orderpriority").withColumnRenamed("o_orderpriority", "series")
    return series.to_first(months, ["series"], "month", "cents", "since_first").select("series", _text("month"), F.round("since_first", 6).alias("since_first"))


@query("""
    WITH m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS place FROM m)
    SELECT series, place, n, coalesce(n_name, concat('W', place + 1)) AS label FROM o LEFT JOIN nation ON place = n_nationkey
""")
def ordinal_label_join(spark, sf_dir):
    months = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    placed = series.ordinals(months, ["series"], "month", "place").withColumn("place", F.col("place").cast("bigint"))
    labels = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("place"), "n_name")
    return placed.join(labels, "place", "left").select("series", "place", "n", F.coalesce("n_name", F.concat(F.lit("W"), (F.col("place") + 1).cast("string"))).alias("label"))


def _against_market(spark, sf_dir):
    """Segments with the market's return, a conditional maximum over the segments (a row each)."""
    market = F.max(F.when(F.col("segment") == "MACHINERY", F.col("ret"))).over(Window.partitionBy(F.lit(0)))
    return _segments(spark, sf_dir).withColumn("market", market)


@query(f"""
    WITH {_SEGMENT_MONTHS_SQL}, x AS (SELECT *, (SELECT ret FROM rets WHERE segment = 'MACHINERY') AS market, 0.0425::DOUBLE * (9 / 52::DOUBLE) AS free FROM rets)
    SELECT segment, round(free + 1.85 * (market - free), 4) AS expected, round(ret - (free + 1.85 * (market - free)), 4) AS alpha, round(ret - market, 4) AS excess FROM x
""")
def capm_alpha(spark, sf_dir):
    figures = series.alpha(F.col("ret"), F.col("market"), 1.85)
    return _against_market(spark, sf_dir).select("segment", *[F.round(c, 4).alias(n) for n, c in figures.items()])


@query(f"""
    WITH {_SEGMENT_MONTHS_SQL}, w AS (SELECT 0.03557::DOUBLE / 52 + 0.27 * 0.045::DOUBLE / 52 AS expected)
    SELECT segment, round(expected, 8) AS weekly, round(expected * 52 * 100, 6) AS annual_pct, round(ret / 100 - expected, 6) AS period_alpha FROM rets, w
""")
def capm_expected(spark, sf_dir):
    weekly = series.weekly_expectation(0.03557, 0.27)
    return _segments(spark, sf_dir).select("segment", F.round(F.lit(weekly), 8).alias("weekly"), F.round(series.annualised_pct(F.lit(weekly)), 6).alias("annual_pct"), F.round(F.col("ret") / 100 - weekly, 6).alias("period_alpha"))


@query(f"WITH {_SEGMENT_MONTHS_SQL} SELECT segment, inception, current, round(ret, 6) AS ret, round(ret - (SELECT ret FROM rets WHERE segment = 'MACHINERY'), 6) AS excess FROM rets")
def benchmark_excess(spark, sf_dir):
    return _against_market(spark, sf_dir).select("segment", "inception", "current", F.round("ret", 6).alias("ret"), F.round(F.col("ret") - F.col("market"), 6).alias("excess"))


@query("""
    WITH e AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'injection' WHEN 'F' THEN 'proceeds' ELSE 'purchase' END AS kind, CAST(round(o_totalprice * 100) AS BIGINT) * CASE o_orderstatus WHEN 'P' THEN -1 ELSE 1 END AS cents FROM orders)
    SELECT kind, CAST(sum(cents) AS BIGINT) AS amount, count(*) AS n FROM e GROUP BY 1
""")
def cash_ledger(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "O", "injection").when(F.col("o_orderstatus") == "F", "proceeds").otherwise("purchase")
    events = read_table(spark, sf_dir, "orders").select(kind.alias("kind"), (cents(F.col("o_totalprice")) * F.when(F.col("o_orderstatus") == "P", -1).otherwise(1)).alias("cents"))
    return series.ledger(events, "kind", "cents")


# Cash accounts: a customer's closed orders are proceeds, all others purchases; of a day, proceeds come first.
_ACCOUNTS_SQL = """
    moves AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderstatus <> 'F', o_orderkey) AS n FROM orders),
    kept(o_custkey, n, available, injected) AS (SELECT o_custkey, 0, 0::BIGINT, 0::BIGINT FROM moves WHERE n = 1
      UNION ALL SELECT m.o_custkey, m.n, greatest(k.available + m.amount, 0), k.injected + greatest(-(k.available + m.amount), 0) FROM kept k JOIN moves m ON m.o_custkey = k.o_custkey AND m.n = k.n + 1),
    accounts AS (SELECT o_custkey, CAST(max(n) AS BIGINT) AS n, arg_max(injected, n) AS injected, arg_max(available, n) AS available FROM kept GROUP BY 1)
"""


def _accounts(spark, sf_dir):
    amount = cents(F.col("o_totalprice")) * F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)
    moves = read_table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("time"), (F.col("o_orderstatus") != "F").alias("buys"), "o_orderkey", amount.alias("amount"))
    rows = carry.cash_accounts(moves, ["o_custkey"], F.year("time"), ["time", "buys", "o_orderkey"], "amount")
    return rows.groupBy("o_custkey").agg(F.max("number").alias("n"), F.sum("injection").alias("injected"), F.max_by("available", "number").alias("available"))


@query(f"WITH RECURSIVE {_ACCOUNTS_SQL} SELECT * FROM accounts")
def residual_cash(spark, sf_dir):
    return _accounts(spark, sf_dir)


_TICKS_SQL = "t AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def _ticks(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", "event_type", "ts", cents(F.col("value")).alias("cents"))


@query(f"""
    WITH {_TICKS_SQL}
    SELECT event_id, event_type, row_number() OVER w AS number, cents - lag(cents) OVER w AS change, round(cents::DOUBLE / nullif(first_value(cents) OVER w, 0) - 1, 6) AS since_first,
      CAST(sum(cents) OVER w AS BIGINT) AS running, max(cents) OVER w AS peak FROM t WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def tick_series(spark, sf_dir):
    rows = carry.along(_ticks(spark, sf_dir), ["event_type"], F.to_date("ts"), ["ts", "event_id"], "cents")
    return rows.select("event_id", "event_type", "number", (F.col("cents") - F.col("previous")).alias("change"), F.round(ratio(F.col("cents"), F.col("first")) - 1, 6).alias("since_first"), "running", "peak")


@query(f"""
    WITH {_TICKS_SQL}, p AS (SELECT event_type, cents, max(cents) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM t)
    SELECT event_type, round(min(cents::DOUBLE / nullif(peak, 0) - 1), 6) AS max_drawdown FROM p GROUP BY 1
""")
def tick_drawdown(spark, sf_dir):
    return carry.deepest_fall(_ticks(spark, sf_dir), ["event_type"], F.to_date("ts"), ["ts", "event_id"], "cents").select("event_type", F.round("max_drawdown", 6).alias("max_drawdown"))


@query("SELECT user_id, event_id, value, event_type = 'view' AS is_open FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1")
def latest_snapshot(spark, sf_dir):
    return valuation.latest(read_table(spark, sf_dir, "events"), "user_id", "ts", ["event_id", "value", "event_type"]).select("user_id", "event_id", "value", (F.col("event_type") == "view").alias("is_open"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS key, arg_max(value, event_id) AS price FROM events GROUP BY 1, 2")
def price_map_json(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    nested = envelopes.nested_prices(events, "day", "event_type", "event_id", F.col("value"))
    read = nested.select("day", F.from_json(F.to_json("prices"), "map<string,double>").alias("prices"))
    return read.select(_text("day"), F.explode("prices").alias("key", "price"))


@query("""
    WITH b AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[' || props || ', ' || props || ']' WHEN 1 THEN props END AS body FROM events)
    SELECT event_id, CASE WHEN json_type(body) = 'ARRAY' THEN json_array_length(body)::BIGINT WHEN body IS NOT NULL THEN 1 END AS n,
      CASE WHEN json_type(body) = 'ARRAY' THEN CAST(json_extract(body, '$[0].k') AS BIGINT) + CAST(json_extract(body, '$[1].k') AS BIGINT) ELSE CAST(json_extract(body, '$.k') AS BIGINT) END AS total FROM b
""")
def one_or_list(spark, sf_dir):
    at = F.col("event_id") % 3
    body = F.when(at == 0, F.concat(F.lit("["), "props", F.lit(", "), "props", F.lit("]"))).when(at == 1, F.col("props"))
    items = envelopes.one_or_many(body, "struct<k:bigint>")
    rows = read_table(spark, sf_dir, "events").select("event_id", items.alias("items"))
    return rows.select("event_id", F.when(F.col("items").isNotNull(), F.size("items")).cast("bigint").alias("n"), F.aggregate("items", F.lit(0).cast("bigint"), lambda n, x: n + x["k"]).alias("total"))


@query("SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS exec_date, event_type AS ticker FROM events")
def exploded_executions(spark, sf_dir):
    plans = read_table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("exec_date")).agg(F.collect_set("event_type").alias("tickers"))
    return matching.exploded(plans).select(_text("exec_date"), "ticker")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#2', 'Brand#17')")
def symbol_filter(spark, sf_dir):
    return only_symbols(read_table(spark, sf_dir, "part"), "p_brand", symbols("", "Brand#2,Brand#17")).select("p_partkey", "p_brand")


@query("""
    SELECT event_id AS bar_seq, event_type AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(epoch_us(ts) AS BIGINT) AS at, value AS open, CAST(NULL AS VARCHAR) AS error
    FROM events WHERE event_type IN ('view', 'purchase') AND ts >= (SELECT CAST(min(ts) AS DATE) + 2 FROM events) AND ts < (SELECT CAST(min(ts) AS DATE) + 12 FROM events)
""")
def landed_bars(spark, sf_dir):
    """Bars as a collector would land them, one folder for each symbol's day, asked for by symbols and days."""
    path = new_path(spark, "bars")
    day = F.to_date("ts")
    events = read_table(spark, sf_dir, "events")
    begin = events.agg(F.min(day)).first()[0]
    rows = events.select(F.col("event_type").alias("symbol"), day.alias("day"), F.col("event_id").alias("bar_seq"), F.col("ts").cast("timestamp").alias("bar_ts"), F.col("value").alias("open"))
    rows.repartition("symbol", "day").write.partitionBy("symbol", "day").parquet(path)
    asked = only_symbols(landed.table(spark, "bars", path, push=True), "symbol", symbols("", "view,purchase")).filter((F.col("day") >= F.date_add(F.lit(begin), 2)) & (F.col("day") < F.date_add(F.lit(begin), 12)))
    return asked.select("bar_seq", "symbol", _text("day"), F.unix_micros("bar_ts").alias("at"), "open", "error")


# A document whose fields differ from row to row: one in three has a list, one in five a nested object, one in seven a text where others have a number.
_DRIFT_SQL = """
    docs AS (SELECT event_id, concat('{"id": ', event_id, ', "props": ', props, CASE WHEN event_id % 3 = 0 THEN concat(', "tags": ["t', user_id % 4, '", "', event_type, '"]') ELSE '' END,
      CASE WHEN event_id % 5 = 0 THEN concat(', "risk": {"score": ', user_id, '}') ELSE '' END, ', "size": ', CASE WHEN event_id % 7 = 0 THEN '"large"' ELSE CAST(user_id % 9 AS VARCHAR) END, '}') AS doc FROM events)
"""


def _drifting(spark, sf_dir):
    at, user = F.col("event_id"), F.col("user_id")
    tags = F.when(at % 3 == 0, F.concat(F.lit(', "tags": ["t'), (user % 4).cast("string"), F.lit('", "'), "event_type", F.lit('"]'))).otherwise("")
    risk = F.when(at % 5 == 0, F.concat(F.lit(', "risk": {"score": '), user.cast("string"), F.lit("}"))).otherwise("")
    size = F.when(at % 7 == 0, '"large"').otherwise((user % 9).cast("string"))
    return read_table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"id": '), at.cast("string"), F.lit(', "props": '), "props", tags, risk, F.lit(', "size": '), size, F.lit("}")).alias("doc"))


@query(f"""
    WITH {_DRIFT_SQL}
    SELECT event_id, CAST(json_extract(doc, '$.props.k') AS BIGINT) AS k, json_extract_string(doc, '$.risk.score') AS risk, try_cast(json_extract_string(doc, '$.size') AS BIGINT) AS size,
      CAST(coalesce(json_array_length(doc, '$.tags'), 0) AS BIGINT) AS n_tags, CASE WHEN event_id % 3 = 0 THEN 'ARRAY<STRING>' ELSE '' END || '|' || CASE WHEN event_id % 5 = 0 THEN 'OBJECT<score: BIGINT>' ELSE '' END || '|' || CASE WHEN event_id % 7 = 0 THEN 'STRING' ELSE 'BIGINT' END AS shape FROM docs
""")
def drifting_documents(spark, sf_dir):
    docs = readers.drifting(_drifting(spark, sf_dir), "doc", {"k": ("$.props.k", "bigint"), "risk": ("$.risk.score", "string"), "size": ("$.size", "bigint")})
    kind = lambda path: F.coalesce(F.schema_of_variant(F.variant_get("document", path, "variant")), F.lit(""))
    n_tags = F.coalesce(F.size(F.try_variant_get("document", "$.tags", "array<variant>")), F.lit(0)).cast("bigint")
    return docs.select("event_id", "k", "risk", "size", n_tags.alias("n_tags"), F.concat(kind("$.tags"), F.lit("|"), kind("$.risk"), F.lit("|"), kind("$.size")).alias("shape"))


@query(f"""
    WITH {_DRIFT_SQL}, f AS (SELECT event_id, unnest(json_keys(doc)) AS field FROM docs)
    SELECT field, count(*) AS n, min(event_id) AS first_seen FROM f GROUP BY 1
""")
def document_fields(spark, sf_dir):
    docs = readers.drifting(_drifting(spark, sf_dir), "doc", {})
    return readers.document_fields(docs, "document").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_seen"))


@query("""
    WITH d AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderpriority AS name, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1, 2)
    SELECT day, name, cents FROM (SELECT DISTINCT day FROM d) CROSS JOIN (SELECT DISTINCT name FROM d) LEFT JOIN d USING (day, name)
""")
def wide_days(spark, sf_dir):
    """Days by priority as a wide table whose columns are found in the data, and back; cells without orders are null."""
    day = F.col("o_orderdate").cast("date").cast("string").alias("day")
    days = read_table(spark, sf_dir, "orders").groupBy(day, F.col("o_orderpriority").alias("name")).agg(F.sum(cents(F.col("o_totalprice"))).alias("cents"))
    return wide_tables.long(wide_tables.wide(days, ["day"], "name", "cents"), ["day"], "name", "cents")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT o_orderkey, concat(strftime(o_orderdate, '%b %-d'), ' - ', strftime(o_orderdate + INTERVAL 7 DAY, '%b %-d')) AS dates FROM orders")
def date_labels(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.concat(month_day(day), F.lit(" - "), month_day(F.date_add(day, 7))).alias("dates"))


_DAILY_SQL = """
    d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2),
    r AS (SELECT event_type, day, v / lag(v) OVER (PARTITION BY event_type ORDER BY day) - 1 AS ret FROM d),
    k AS (SELECT r.*, m.ret AS market FROM r JOIN (SELECT day, ret FROM r WHERE event_type = 'view') m USING (day) WHERE r.ret IS NOT NULL)
"""


@query(f"""
    WITH {_DAILY_SQL}
    SELECT event_type, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS volatility, round(regr_slope(ret, market), 5) AS beta,
      round((avg(ret) - 0.0007) / stddev_samp(ret), 5) AS sharpe, round(avg(ret) - (0.0007 + regr_slope(ret, market) * (avg(market) - 0.0007)), 5) + 0.0 AS alpha,
      round(corr(ret, market), 5) AS correlation, round(stddev_samp(ret - market), 6) AS tracking_error, round(avg(ret - market) / nullif(stddev_samp(ret - market), 0), 5) AS information_ratio, round(quantile_cont(ret, 0.05), 6) AS var_95 FROM k GROUP BY 1
""")
def risk_metrics(spark, sf_dir):
    days = read_table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("v"))
    rets = days.withColumn("ret", ratio(F.col("v"), F.lag("v").over(Window.partitionBy("event_type").orderBy("day"))) - 1).filter("ret is not null")
    market = rets.filter("event_type = 'view'").select("day", F.col("ret").alias("market"))
    figures = series.risk(rets.join(market, "day"), ["event_type"], "ret", "market", 0.0007)
    return figures.select("event_type", *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("mean", 6), ("volatility", 6), ("beta", 5), ("sharpe", 5), ("alpha", 5), ("correlation", 5), ("tracking_error", 6), ("information_ratio", 5), ("var_95", 6))])


# Returns of five assets (kinds of events) in each of four portfolios (of users), by day; each Monday looks back over two weeks.
_LOOK_BACK_SQL = """
    v AS (SELECT user_id % 4 AS portfolio, event_type AS asset, CAST(ts AS DATE) AS day, avg(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY 1, 2, 3),
    r AS (SELECT portfolio, asset, day, v / lag(v) OVER (PARTITION BY portfolio, asset ORDER BY day) - 1 AS ret FROM v),
    b AS (SELECT portfolio, asset, day, ret, CAST(date_trunc('week', day) AS DATE) + 7 * k AS week FROM r, (SELECT unnest([1, 2]) AS k) WHERE ret IS NOT NULL)
"""


def _look_back(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("portfolio"), F.col("event_type").alias("asset"), F.to_date("ts").alias("day"), cents(F.col("value")).alias("cents"))
    values = events.groupBy("portfolio", "asset", "day").agg(F.avg("cents").alias("v"))
    rets = values.withColumn("ret", ratio(F.col("v"), F.lag("v").over(Window.partitionBy("portfolio", "asset").orderBy("day"))) - 1).filter("ret is not null")
    return rets.withColumn("week", F.explode(optimising.looking_back(F.col("day"), 2)))


@query(f"""
    WITH {_LOOK_BACK_SQL}
    SELECT x.portfolio, CAST(x.week AS VARCHAR) AS week, x.asset AS a, y.asset AS b, count(*) AS n, round(avg(x.ret), 6) AS mean_a, round(avg(y.ret), 6) AS mean_b, round(covar_samp(x.ret, y.ret), 6) + 0.0 AS covariance
    FROM b x JOIN b y ON x.portfolio = y.portfolio AND x.week = y.week AND x.day = y.day AND x.asset <= y.asset GROUP BY 1, 2, 3, 4
""")
def return_moments(spark, sf_dir):
    found = optimising.moments(_look_back(spark, sf_dir), ["portfolio", "week"], "day", "asset", "ret")
    return found.select("portfolio", _text("week"), "a", "b", "n", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean_a", "mean_b", "covariance")])


@query()
def capped_weights(spark, sf_dir):
    """No SQL: a solver; the tests hold it against brute force."""
    found = optimising.moments(_look_back(spark, sf_dir), ["portfolio", "week"], "day", "asset", "ret")
    return optimising.capped_weights(found, ["portfolio", "week"], tilt=0.1, most=0.35, least=0.02).select("portfolio", _text("week"), "asset", F.round("weight", 4).alias("weight"))


@query("""
    WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders)
    SELECT o_orderkey, place, coalesce(n_name, concat('W', place + 1)) AS label FROM o LEFT JOIN nation ON place = n_nationkey
""")
def order_labels(spark, sf_dir):
    """Ordinals among all orders, and the labels that belong to them."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    placed = ranking.globally_numbered(orders, [F.col("o_orderdate"), F.col("o_orderkey")], "place", first=0)
    labels = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("place"), "n_name")
    return placed.join(labels, "place", "left").select("o_orderkey", "place", F.coalesce("n_name", F.concat(F.lit("W"), (F.col("place") + 1).cast("string"))).alias("label"))


_QUOTE_FIELDS = ("price", "change", "change_percent", "previous_close", "open", "high", "low")


@query(f"""
    SELECT event_id, event_type AS symbol, {", ".join(f"coalesce(CASE WHEN event_id % {k + 3} <> 0 THEN value * {k + 1} END, 0) AS {c}" for k, c in enumerate(_QUOTE_FIELDS))},
      CAST(coalesce(CASE WHEN event_id % 5 <> 0 THEN event_id * 100 END, 0) AS BIGINT) AS volume, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END, 'CLOSED') AS market_state,
      coalesce(CASE WHEN event_id % 7 <> 0 THEN concat('n', user_id) END, event_type) AS name, CAST(epoch_us(ts) AS BIGINT) AS last_update
    FROM events WHERE event_type <> 'error'
""")
def quote_normalise(spark, sf_dir):
    at = F.col("event_id")
    raw = read_table(spark, sf_dir, "events").select(
        at.alias("seq"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("symbol"),
        *[F.when(at % (k + 3) != 0, F.col("value") * (k + 1)).alias(c) for k, c in enumerate(_QUOTE_FIELDS)], F.when(at % 5 != 0, at * 100).alias("volume"),
        F.when(at % 4 != 0, F.col("event_type")).alias("market_state"), F.when(at % 7 != 0, F.concat(F.lit("n"), F.col("user_id").cast("string"))).alias("name"), F.col("ts").alias("last_update"),
    )
    return valuation.normalised_quotes(raw).withColumn("last_update", F.unix_micros(F.col("last_update").cast("timestamp"))).withColumnRenamed("seq", "event_id")


@query("SELECT s_name AS ticker, s_acctbal AS ret, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place, s_nationkey FROM supplier")
def chart_projection(spark, sf_dir):
    rows = read_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("ticker"), F.col("s_acctbal").alias("ret"), "s_nationkey", "s_suppkey")
    return ranking.globally_numbered(rows, [F.desc("ret"), F.col("s_suppkey")], "place").drop("s_suppkey")


@query(f"""
    WITH {_HOLDINGS_SQL}, {_QUOTES_SQL}
    SELECT input_pos, shares, coalesce(price, 0) AS price, CAST(shares * coalesce(CAST(round(price * 100) AS BIGINT), 0) AS BIGINT) AS value, coalesce(previous_close, 0) AS change, 0.25::DOUBLE * 100 AS weight_pct FROM holdings LEFT JOIN quotes USING (input_pos)
""")
def live_position_rows(spark, sf_dir):
    held = _holdings(spark, sf_dir).select("input_pos", "shares").withColumn("weight", F.lit(0.25))
    return valuation.live_rows(held, _quotes(spark, sf_dir).withColumnRenamed("previous_close", "change"), "input_pos")


@query(f"""
    WITH RECURSIVE {_MONTHS_SQL}, {_HOLDINGS_SQL}, {_TOTALS_SQL}, {_ACCOUNTS_SQL},
    dogs AS (SELECT arg_min(cents, month) AS initial, arg_max(cents, month) AS final, (SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) FROM orders WHERE o_orderstatus = 'P') AS dividends FROM months),
    plays AS (SELECT CAST(sum(injected) AS BIGINT) AS injected, CAST(sum(available) AS BIGINT) AS available, (SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) FROM orders WHERE o_orderstatus = 'O') AS open_value FROM accounts)
    SELECT 'dividends' AS portfolio, initial, final + dividends AS current, round((final - initial)::DOUBLE / initial * 100, 6) AS return_pct FROM dogs
    UNION ALL SELECT 'reinvested', injected, open_value + available, round((open_value + available - injected)::DOUBLE / injected * 100, 6) FROM plays
    UNION ALL SELECT 'estimated', total_initial, priced_current + unpriced_initial, round((priced_current + unpriced_initial - total_initial)::DOUBLE / total_initial * 100, 6) FROM s
""")
def home_stats(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    worth = lambda status, name: orders.filter(F.col("o_orderstatus") == status).agg(F.sum(cents(F.col("o_totalprice"))).alias(name))
    ends = _months(spark, sf_dir).agg(F.min_by("cents", "month").alias("first"), F.max_by("cents", "month").alias("last"))
    dividends = ends.crossJoin(F.broadcast(worth("P", "dividends"))).select(*valuation.with_dividends(F.col("first"), F.col("last"), F.col("dividends")))
    cash = _accounts(spark, sf_dir).agg(F.sum("injected").alias("injected"), F.sum("available").alias("available"))
    reinvested = cash.crossJoin(F.broadcast(worth("O", "open"))).select(*valuation.reinvested(F.col("injected"), F.col("open"), F.col("available")))
    estimated = positions.totals(_holdings(spark, sf_dir)).select(*valuation.estimated(F.col("total_initial"), F.col("estimated_current"), F.col("estimated_return")))
    return dividends.unionByName(reinvested).unionByName(estimated).withColumn("return_pct", F.round("return_pct", 6))


@query(f"""
    WITH {_MONTHS_SQL}, c AS (SELECT *, lag(cents) OVER (ORDER BY month) AS base FROM months)
    SELECT CAST(month AS VARCHAR) AS month, cents - 1000000000 AS return_abs, round((cents - 1000000000)::DOUBLE / 1000000000 * 100, 6) AS return_pct, round(coalesce((cents - base)::DOUBLE / base * 100, 0), 6) AS week_to_date FROM c
""")
def valuation_returns(spark, sf_dir):
    months = _months(spark, sf_dir).withColumn("of", F.lit(0)).withColumn("base", F.lag("cents").over(Window.partitionBy("of").orderBy("month")))
    figures = valuation.returns_on(F.col("cents"), F.lit(1000000000))
    return months.select(_text("month"), figures["return_abs"].cast("bigint").alias("return_abs"), F.round(figures["return_pct"], 6).alias("return_pct"), F.round(valuation.week_to_date(F.col("cents"), F.col("base")), 6).alias("week_to_date"))


@query("SELECT o_orderkey, o_totalprice - 200000 >= 0 AS up, o_totalprice > 250000 AS beats, o_orderstatus = 'O' AS is_open, false AS is_current FROM orders")
def flag_enrichment(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") - 200000 >= 0).alias("up"), (F.col("o_totalprice") > 250000).alias("beats"), (F.col("o_orderstatus") == "O").alias("is_open"), F.lit(False).alias("is_current"))


@query("SELECT vec_id, CAST(embedding[2] AS DOUBLE) AS second, CAST(embedding[3] AS DOUBLE) AS third, len(embedding[2:]) AS n_rest, CAST(list_reverse(embedding)[1] AS DOUBLE) AS last FROM embeddings")
def nth_element(spark, sf_dir):
    v = F.col("embedding")
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.try_element_at(v, F.lit(2)).cast("double").alias("second"), F.try_element_at(v, F.lit(3)).cast("double").alias("third"), F.size(F.slice(v, 2, F.size(v))).cast("bigint").alias("n_rest"), F.try_element_at(F.reverse(v), F.lit(1)).cast("double").alias("last"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS n_up, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2)), 6) AS doubled FROM embeddings")
def array_higher_order(spark, sf_dir):
    v = F.col("embedding")
    doubled = F.aggregate(F.transform(v, lambda x: x.cast("double") * 2), F.lit(0.0), lambda n, x: n + x)
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.filter(v, lambda x: x > 0)).cast("bigint").alias("n_up"), F.round(doubled, 6).alias("doubled"))


@query("SELECT vec_id, place, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS place, unnest(embedding) AS x FROM embeddings)")
def unnest_positions(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "x")).select("vec_id", F.col("place").cast("bigint").alias("place"), F.col("x").cast("double").alias("x"))


@query("WITH f AS (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1) SELECT c_custkey, s_name FROM customer JOIN f ON c_nationkey = s_nationkey")
def point_lookup(spark, sf_dir):
    first = read_table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min_by("s_name", "s_suppkey").alias("s_name"))
    return read_table(spark, sf_dir, "customer").join(first, "c_nationkey").select("c_custkey", "s_name")


@query("""
    WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS price FROM events GROUP BY 1, 2)
    SELECT user_id, count(*) AS n FROM l WHERE price > 90 GROUP BY 1
""")
def map_guard(spark, sf_dir):
    """Prices above 90 by kind; users whose map is empty then are left out."""
    maps = envelopes.nested_prices(read_table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", F.col("value"))
    high = maps.withColumn("prices", F.map_filter("prices", lambda _, price: price > 90))
    return high.withColumn("n", F.size(F.map_keys("prices")).cast("bigint")).filter("n > 0").select("user_id", "n")


@query("""
    WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(replace(p_name, 'a', 'á'), 'e', 'É') WHEN 1 THEN upper(p_name) ELSE p_name END AS name FROM part)
    SELECT p_partkey, name, row_number() OVER (ORDER BY name COLLATE en, p_partkey) AS place FROM n
""")
def collated_sort(spark, sf_dir):
    at, name = F.col("p_partkey") % 3, F.col("p_name")
    accents = F.replace(F.replace(name, F.lit("a"), F.lit("á")), F.lit("e"), F.lit("É"))
    parts = read_table(spark, sf_dir, "part").select("p_partkey", F.when(at == 0, accents).when(at == 1, F.upper(name)).otherwise(name).alias("name"))
    return ranking.globally_numbered(parts, [F.collate(F.col("name"), "UNICODE"), F.col("p_partkey")], "place")


@query("SELECT event_id, abs(value - 20) AS away, floor(value * 10 + 0.5) / 10.0::DOUBLE AS rounded, try_cast(event_type AS DOUBLE) AS no_number, value * 9 / 52 AS part, CASE WHEN value <> 0 THEN value * 100 END AS pct FROM events")
def scalar_math(spark, sf_dir):
    v = F.col("value")
    return read_table(spark, sf_dir, "events").select("event_id", F.abs(v - 20).alias("away"), round_half_up(v, 1).alias("rounded"), try_number(F.col("event_type")).alias("no_number"), (v * 9 / 52).alias("part"), if_set(v, v * 100).alias("pct"))


@query("SELECT p_partkey, upper(p_name) AS upper_name, concat(p_brand, '/', p_type) AS label, split_part(p_name, ' ', 1) AS first_word, CASE WHEN p_size >= 25 THEN '+' ELSE '' END || p_size AS signed, coalesce(nullif(p_type, ''), '-') AS kind FROM part")
def scalar_string(spark, sf_dir):
    size = F.col("p_size")
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("upper_name"), F.concat("p_brand", F.lit("/"), "p_type").alias("label"), F.split("p_name", " ")[0].alias("first_word"), F.concat(F.when(size >= 25, "+").otherwise(""), size.cast("string")).alias("signed"), text_or_else(F.col("p_type"), "-").alias("kind")
    )


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(CAST(o_orderdate AS DATE) - 1 AS VARCHAR) AS before, CAST(CAST(o_orderdate AS DATE) + 2 AS VARCHAR) AS after, CAST(epoch_ms(o_orderdate) AS BIGINT) AS millis FROM orders")
def scalar_date(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", day.cast("string").alias("day"), F.date_sub(day, 1).cast("string").alias("before"), F.date_add(day, 2).cast("string").alias("after"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("millis"))


@query("""
    WITH x AS (SELECT o_orderkey, o_totalprice - 200000 AS x FROM orders)
    SELECT o_orderkey, CASE WHEN x < 0 THEN '-$' ELSE '$' END || format('{:,.2f}', abs(x)) AS two, '$' || CASE WHEN x < 0 THEN '-' ELSE '' END || format('{:,.2f}', abs(x)) AS sign_after,
      CASE WHEN x < 0 THEN '-$' ELSE '$' END || rtrim(rtrim(format('{:,.3f}', abs(x)), '0'), '.') AS short, format('{:,}', CAST(o_orderkey * 1000 AS BIGINT)) AS grouped,
      CASE WHEN x >= 0 THEN '+' ELSE '' END || format('{:.2f}', x) || '%' AS percent FROM x
""")
def money_labels(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") - 200000).alias("x"))
    x = F.col("x")
    return rows.select("o_orderkey", dollars(x, 2, 2).alias("two"), dollars(x, 2, 2, sign_first=False).alias("sign_after"), dollars(x).alias("short"), grouped(F.col("o_orderkey") * 1000).alias("grouped"), signed_percent(x).alias("percent"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(epoch_ms(o_orderdate) + 30600000 AS BIGINT) AS millis FROM orders")
def iso_instants(spark, sf_dir):
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:30:00.000Z"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", iso_day(iso).cast("string").alias("day"), F.unix_millis(F.to_timestamp(iso)).alias("millis"))


_METRICS = {"quantity": (lambda: F.sum(F.col("l_quantity").cast("bigint")), "CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT)"), "value": (lambda: F.sum(cents(F.col("l_extendedprice"))), "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT)"), "lots": (lambda: F.count(F.lit(1)), "count(*)")}


def _metric_query(make):
    return lambda spark, sf_dir: read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(make().alias("metric"))


for _name, (_make, _sql) in _METRICS.items():
    query(f"SELECT l_returnflag, {_sql} AS metric FROM lineitem GROUP BY 1", f"metric_switch_{_name}")(_metric_query(_make))


@query("""
    WITH a AS (SELECT p_brand, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT p_brand, value FROM a ORDER BY value DESC, p_brand LIMIT 5
""")
def largest_groups(spark, sf_dir):
    return largest(_lot_value(spark, sf_dir, "p_brand"), "p_brand", 5).select("p_brand", "value")


@query("""
    WITH m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1, 2)
    SELECT series, round(min(cents::DOUBLE / peak - 1), 6) AS max_drawdown FROM (SELECT *, max(cents) OVER (PARTITION BY series ORDER BY month) AS peak FROM m) GROUP BY 1
""")
def max_drawdown(spark, sf_dir):
    months = _months(spark, sf_dir, "o_orderpriority").withColumnRenamed("o_orderpriority", "series")
    return series.drawdown(months, ["series"], "month", "cents").select("series", F.round("max_drawdown", 6).alias("max_drawdown"))


_YEAR_SHARES = "SELECT l_partkey AS ticker, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS shares FROM lineitem WHERE year(l_shipdate) = {} GROUP BY 1"


@query(f"""
    WITH a AS ({_YEAR_SHARES.format(1996)}), b AS ({_YEAR_SHARES.format(1997)}),
    d AS (SELECT ticker, coalesce(b.shares, 0) - coalesce(a.shares, 0) AS change FROM a FULL JOIN b USING (ticker))
    SELECT ticker, CASE WHEN change > 0 THEN 'BUY' ELSE 'SELL' END AS action, abs(change) AS shares FROM d WHERE change <> 0
""")
def trades_between_years(spark, sf_dir):
    lots = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ticker"), F.col("l_quantity").cast("bigint").alias("shares"), F.col("l_shipdate").alias("time"))
    both = lots.filter((F.col("time") >= "1996-01-01") & (F.col("time") < "1998-01-01"))  # a range that reaches the scan
    return rebalancing.trades_of(both, F.col("time") < "1997-01-01")


@query("""
    WITH s AS (SELECT p_partkey, p_retailprice, p_size / (sum(p_size) OVER ())::DOUBLE AS weight FROM part)
    SELECT p_partkey AS ticker, CAST(floor(weight * 1000000000.0::DOUBLE / p_retailprice) AS BIGINT) AS shares FROM s
""")
def sized_positions(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part")
    whole = parts.agg(F.sum("p_size").alias("whole"))
    weights = parts.crossJoin(F.broadcast(whole)).select(F.col("p_partkey").alias("ticker"), ratio(F.col("p_size"), F.col("whole")).alias("weight"))
    prices = parts.select(F.col("p_partkey").alias("ticker"), F.col("p_retailprice").alias("exec_price"))
    return rebalancing.sized(weights, prices, 1e9).select("ticker", "shares")
