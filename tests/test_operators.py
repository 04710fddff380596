"""Golden values, null rules, ties, tolerance and stream tests on small tables of the tests' own."""

import datetime as dt
import json
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import formats, semantics
from ledgerlark.operators import carry, matching, positions, ranking, series, valuation
from ledgerlark.operators.allocation import allocation, concentration
from ledgerlark.sources import envelopes, readers, schemas
from ledgerlark.streaming import snapshots


def one(spark, **exprs):
    return spark.range(1).select(*[e.alias(n) for n, e in exprs.items()]).first()


@pytest.mark.parametrize("x, want", [(None, -1.0), (0.0, -1.0), (float("nan"), -1.0), (2.5, 2.5)])
def test_falsy_numbers(spark, x, want):
    assert one(spark, y=semantics.or_else(F.lit(x).cast("double"), -1.0)).y == want


def test_texts_ratio_and_rounding(spark):
    r = one(
        spark, a=semantics.text_or_else(F.lit(""), "-"), b=semantics.text_or_else(F.lit(None).cast("string"), "-"), c=semantics.ratio(F.lit(1), F.lit(0)),
        d=semantics.round_half_up(F.lit(1.005)), e=semantics.round_half_up(F.lit(-2.5), 0), f=semantics.try_number(F.lit("x")), g=semantics.if_set(F.lit(0.0), F.lit(1)),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("-", "-", None, 1.0, -2.0, None, None)


def test_formats(spark):
    r = one(spark, a=formats.signed_percent(F.lit(1.5)), b=formats.month_day(F.lit(dt.date(2025, 8, 26))), c=formats.fixed(F.lit(None).cast("double"), 2), d=formats.clock(F.lit("2026-01-02 15:04:05").cast("timestamp")), e=formats.iso_day(F.lit("2026-01-02T23:59:59.999Z")))
    assert (r.a, r.b, r.c, r.d, r.e) == ("+1.50%", "Aug 26", None, "3:04:05 PM", dt.date(2026, 1, 2))


def test_money(spark):
    x = F.lit(-1234.5)
    r = one(spark, a=formats.dollars(x, 2, 2), b=formats.dollars(x, 2, 2, sign_first=False), c=formats.dollars(F.lit(1234.0), 0, 0), d=formats.dollars(x), e=formats.grouped(F.lit(1234567)), f=formats.grouped(F.lit(0.1), 2), g=formats.grouped(F.lit(2.0), 1), h=formats.dollars(F.lit(None).cast("double")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == ("-$1,234.50", "$-1,234.50", "$1,234", "-$1,234.5", "1,234,567", "0.10", "2.0", None)


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_fixed_decimals_are_exact(spark, digits):
    rng = np.random.default_rng(digits)
    values = [0.125, 1.005, 2.5, -2.5, 0.5, -0.001, 0.0, 999.9995, 0.9999, 1e-9, 5e-324, 123456789.125, 2.0**52 + 0.5, float("nan"), None, *(rng.normal(0, 1000, 300)), *(rng.integers(-4000, 4000, 300) / 16), *(rng.random(200) ** 9)]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    exact = lambda v: None if v is None or v != v else str(Decimal(v).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))
    assert [r.y for r in df.select(formats.fixed(F.col("x"), digits).alias("y")).collect()] == [exact(v) for v in values]


def holdings(spark):
    rows = [(0, "A", 10.0, 12.0, 3, "X", "t"), (1, "B", 10.0, None, 2, "X", "t"), (2, "C", 10.0, 0.0, 1, "Y", "t"), (3, "D", 10.0, 10.0, 1, "Y", "t"), (4, "E", 384.37, 425.32, 4, "Y", "mRNA"), (5, "F", 41.22, 45.61, 35, "Z", "Memory")]
    return positions.derived(spark.createDataFrame(rows, schemas.HOLDINGS_RAW))


def test_derived_positions(spark):
    got = {r.ticker: (r.initial_investment, r.current_investment, r.delta) for r in holdings(spark).collect()}
    assert got["A"] == (30.0, 36.0, 20.0)
    assert got["B"] == (20.0, None, None)
    assert got["C"] == (10.0, None, None)
    assert got["D"] == (10.0, 10.0, None)  # an unchanged price has a null return
    assert got["E"][2] == got["F"][2] == 10.65


def test_zero_price_is_in_neither_set(spark):
    t = positions.totals(holdings(spark)).first()
    assert (t.n_holdings, t.n_priced, t.n_unpriced) == (6, 4, 1)
    assert t.total_initial - t.priced_initial - t.unpriced_initial == 1000


def test_totals_of_nothing(spark):
    t = positions.totals(holdings(spark).limit(0)).first()
    assert t.total_initial == 0 and t.estimated_return is None


def test_sorts(spark):
    h = holdings(spark)
    order = lambda state: [r.ticker for r in ranking.sorted_by(h, state, ranking.HOLDING_KEYS).collect()]
    assert order(ranking.SortState("delta", ranking.DESCENDING)) == ["A", "E", "F", "B", "C", "D"]
    assert order(ranking.SortState("delta", ranking.ASCENDING)) == ["B", "C", "D", "E", "F", "A"]
    assert order(ranking.SortState("nothing")) == ["A", "B", "C", "D", "E", "F"]
    assert [r.ticker for r in ranking.sorted_by(h, ranking.SortState("shares", ranking.DESCENDING), ranking.POSITION_KEYS).collect()] == ["F", "E", "A", "B", "C", "D"]
    assert order(ranking.SortState("theme"))[:2] == ["F", "E"]  # by a locale: Memory before mRNA
    s = ranking.SortState("x")
    assert s.clicked("x").cycle == 1 and s.clicked("x").clicked("x").cycle == 2 and s.clicked("x").clicked("x").clicked("x").cycle == 0 and s.clicked("y") == ranking.SortState("y")
    assert [r.ticker for r in ranking.top(h, "delta", 3, "input_pos").collect()] == ["A", "E", "F"]
    assert [r.ticker for r in ranking.bottom(h, "delta", 5, "input_pos").collect()] == ["D", "C", "B", "F", "E"]
    assert [r.ticker for r in ranking.laggards(h, "delta", 10, "input_pos").collect()] == ["D", "C", "B"]
    assert ranking.first_match(h, F.col("sector") == "Y", "input_pos").first().ticker == "C"


def test_allocation(spark):
    a = allocation(holdings(spark).withColumn("v", semantics.cents(F.col("initial_investment"))), "sector", "v")
    got = {r.sector: r for r in a.collect()}
    assert abs(sum(r.share_pct for r in got.values()) - 100) < 1e-9 and max(r.to_largest for r in got.values()) == 1
    assert abs(concentration(a, "sector", 5).first().concentration_pct - 100) < 1e-9


def test_wins_and_signs(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (3.0,)], "ret double")
    r = positions.win_rate(df, df.withColumn("exit", F.lit(1))).first()
    assert (r.winners, r.total, r.rate_pct) == (4, 8, 50.0)
    assert tuple(positions.sign_counts(df, "ret").first()) == (2, 2)


def test_valuation(spark):
    pos = spark.createDataFrame([("A", 10, 0.5), ("B", 5, 0.5)], "ticker string, shares bigint, weight double")
    quotes = spark.createDataFrame([("A", 2.0, 1.5, 0.5), ("C", 9.0, 8.0, 1.0)], "ticker string, price double, previous_close double, change double")
    assert valuation.stock_value(pos, quotes, "ticker").first().stock_value == 2000
    assert valuation.stock_value(pos, quotes.limit(0), "ticker").first().stock_value is None
    assert valuation.daily_change(pos, quotes, "ticker").first().change == 500
    assert valuation.daily_change(pos, quotes.withColumn("previous_close", F.lit(0.0)), "ticker").first().change == 0
    rows = {r.ticker: r for r in valuation.live_rows(pos, quotes, "ticker").collect()}
    assert rows["B"].value == 0 and rows["B"].price == 0 and rows["A"].weight_pct == 50
    r = one(spark, a=valuation.total_value(F.lit(0), F.lit(1), F.lit(1), F.lit(99)), b=valuation.change_pct(F.lit(1), F.lit(0)), c=valuation.week_to_date(F.lit(None).cast("double"), F.lit(1.0)), d=valuation.open_for_trade(F.lit("REGULAR")))
    assert (r.a, r.b, r.c, r.d) == (99, None, 0.0, True)


def test_quotes_are_normalised(spark):
    rows = [(0, "A", None, None, None, None, None, None, None, None, None, None, None), (1, "", 1.0, *[None] * 10), (2, None, 1.0, *[None] * 10)]
    got = valuation.normalised_quotes(spark.createDataFrame(rows, schemas.QUOTES)).collect()
    assert len(got) == 1 and (got[0].price, got[0].volume, got[0].market_state, got[0]["name"]) == (0.0, 0, "CLOSED", "A")


@pytest.mark.parametrize("mode, want", [("first", {1: 10, 2: 12}), ("nearest", {1: 11, 2: 12})])
def test_bars_in_time(spark, mode, want):
    t = lambda s: dt.datetime.fromisoformat(s)
    trades = spark.createDataFrame([(1, "A", t("2026-01-02 00:00:00")), (2, "B", t("2026-01-02 00:00:00")), (3, "C", t("2026-01-02 00:00:00"))], "trade_id bigint, k string, at timestamp")
    bars = spark.createDataFrame(
        [(10, "A", t("2026-01-01 14:30:00"), 1.0), (11, "A", t("2026-01-02 01:00:00"), 2.0), (12, "B", t("2026-01-02 23:59:59"), 3.0), (13, "B", t("2026-01-01 00:00:00"), 4.0), (14, "C", t("2026-01-03 00:00:00"), 5.0)],
        "bar_seq bigint, k string, bar_ts timestamp, open double",
    )  # a bar exactly a day away does not count
    assert {r.trade_id: r.bar_seq for r in matching.match_bars(trades, bars, "k", mode).collect()} == want


@pytest.mark.parametrize("mode", ["first", "nearest"])
def test_bars_of_a_hot_key(spark, mode):
    """Against all pairs: ties in time, ends of the tolerance, times before 1970, rows without key or time."""
    rng = np.random.default_rng(3)
    start = dt.datetime(1969, 12, 31)
    at = lambda n: [start + dt.timedelta(seconds=int(x)) for x in rng.integers(0, 40 * 3600, n)]
    bars = [(int(s), k, t, float(s)) for s, k, t in zip(rng.permutation(600), rng.choice(["A", "B"], 600, p=[0.9, 0.1]).tolist(), at(600), strict=True)]
    trades = [(i, k, t) for i, (k, t) in enumerate(zip(rng.choice(["A", "B", "C"], 300).tolist(), at(300), strict=True))]
    trades += [(1000 + i, "A", t + dt.timedelta(seconds=d)) for i, (_, _, t, _) in enumerate(bars[:30]) for d in (0, 3600, -3600)][:90]
    hour = dt.timedelta(hours=1)
    want = {}
    for i, k, t in trades:
        near = [(abs(x - t), x, s) for s, y, x, _ in bars if y == k and abs(x - t) < hour]
        if near:
            want.setdefault((i, t), min(near, key=lambda b: b[2])[2] if mode == "first" else min(near)[2])
    trades += [(5000, None, start), (5001, "A", None)]
    frames = spark.createDataFrame(trades, "trade_id bigint, k string, at timestamp"), spark.createDataFrame([*bars, (9000, None, start, 0.0), (9001, "A", None, 0.0)], "bar_seq bigint, k string, bar_ts timestamp, open double")
    for cells in (1, 64):
        matching.CELLS = cells
        got = {(r.trade_id, r["at"]): r.bar_seq for r in matching.match_bars(*frames, "k", mode, "1 hour").collect()}
        assert got == want
    assert matching.match_bars(frames[0].limit(0), frames[1], "k", mode).count() == 0 and matching.match_bars(frames[0], frames[1].limit(0), "k", mode).count() == 0


@pytest.mark.parametrize("mode", ["first", "nearest"])
def test_bars_of_a_hot_key_take_linear_work(spark, mode):
    """100,000 bars and as many trades of one key in one day: no operator of the plan makes more rows than a few of each."""
    bars = spark.range(100_000).selectExpr("id AS bar_seq", "'A' AS k", "timestamp_micros(1700000000000000 + id * 7 % 86400 * 1000000) AS bar_ts", "1D AS open")
    trades = spark.range(100_000).selectExpr("id AS trade_id", "'A' AS k", "timestamp_micros(1700000000000000 + id * 11 % 86400 * 1000000) AS at")
    found = matching.match_bars(trades, bars, "k", mode)
    found.collect()
    rows = []

    def walk(node):
        metrics = node.metrics()
        if metrics.contains("numOutputRows"):
            rows.append(metrics.apply("numOutputRows").value())
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(node.plan())

    walk(found._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 700_000


def test_numbers_among_all_rows(spark):
    rows = spark.range(1000).selectExpr("id", "hash(id) % 50 AS k").repartition(7)
    got = ranking.globally_numbered(rows, [F.desc("k"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [(-r.k, r.id) for r in got] == sorted((-r.k, r.id) for r in got)
    assert ranking.globally_numbered(rows.limit(0), [F.col("id")]).count() == 0


def test_carried_series(spark):
    """Against a walk over each series, with blocks of one row, of several, and without rows."""
    rng = np.random.default_rng(1)
    rows = [(s, int(t), i, None if v == 7 else int(v)) for i, (s, t, v) in enumerate(zip(rng.choice(["a", "b", None], 400, p=[0.8, 0.1, 0.1]).tolist(), rng.integers(0, 300, 400), rng.integers(-20, 40, 400), strict=True))]
    df = spark.createDataFrame(rows, "s string, t bigint, i bigint, v bigint")
    for width in (1, 30, 1000):
        got = {r.i: r for r in carry.along(df, ["s"], F.floor(F.col("t") / width), ["t", "i"], "v").collect()}
        assert len(got) == len(rows)
        for name in ("a", "b", None):
            seen, running, low, previous = [], 0, 0, None
            for n, (_, _, i, v) in enumerate(sorted((r for r in rows if r[0] == name), key=lambda r: r[1:3]), 1):
                low_before = low
                running += v or 0
                low = min(low, running)
                seen.append(v)
                peak = max((x for x in seen if x is not None), default=None)
                r = got[i]
                assert (r.number, r["first"], r.previous, r.peak, r.running, r.low, r.low_before) == (n, seen[0], previous, peak, running, low, low_before)
                previous = v


def test_residual_cash(spark):
    """The published account: 3,911 are left, and 101,415 have come in."""
    days = ["2025-08-27", "2025-10-03", "2025-11-25", "2025-12-06", "2025-12-10", "2026-01-08", "2026-01-08"]
    moves = list(enumerate(zip(days, [-53_613, -7_672, -38_175, 22_997, -24_952, 21_367, -17_456], strict=True)))
    df = spark.createDataFrame([(i, d, a) for i, (d, a) in moves], "i bigint, day string, amount bigint")
    for block in (F.substring("day", 1, 7), F.lit("all"), F.col("day")):
        got = sorted(carry.cash_accounts(df.withColumn("of", F.lit(1)), ["of"], block, ["day", "i"], "amount").collect(), key=lambda r: r.number)
        assert [r.injection for r in got] == [53_613, 7_672, 38_175, 0, 1_955, 0, 0] and sum(r.injection for r in got) == 101_415
        assert [r.available for r in got] == [0, 0, 0, 22_997, 0, 21_367, 3_911]


@pytest.mark.parametrize("few", [1, 50, 1000])
def test_exact_quantiles_by_histograms(spark, monkeypatch, few):
    monkeypatch.setattr(series, "SORTED", few)
    monkeypatch.setattr(series, "CLASSES", 512)
    rng = np.random.default_rng(2)
    groups = {"even": rng.random(500), "wide": np.exp(rng.normal(0, 60, 400)), "ties": rng.integers(-1, 2, 300) * 1.0, "one": np.array([4.0]), None: np.array([-1.0, 1e308, -1e308])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    for q in (0.05, 0.5, 1.0):
        got = {r.g: r["quantile"] for r in series.quantile(df, ["g"], "x", q).collect()}
        assert set(got) == set(groups)
        for g, v in groups.items():
            at, own = q * (len(v) - 1), sorted(v)
            a, b = own[int(np.floor(at))], own[int(np.ceil(at))]
            assert got[g] == pytest.approx(a + (b - a) * (at - np.floor(at)), rel=1e-12)


def test_home_rules_differ(spark):
    df = spark.range(1)
    figures = lambda columns: tuple(df.select(*columns).first())
    n = lambda x: F.lit(x)
    assert figures(valuation.with_dividends(n(8_500_000), n(8_890_000), n(391_100))) == ("dividends", 8_500_000, 9_281_100, pytest.approx(4.588235))
    assert figures(valuation.reinvested(n(101_415), n(120_161), n(3_911))) == ("reinvested", 101_415, 124_072, pytest.approx(22.340876))
    assert figures(valuation.estimated(n(10), n(12), n(20.0))) == ("estimated", 10, 12, 20.0)


def test_lots_are_scanned_once(spark, sf_dir, monkeypatch):
    from ledgerlark.plans import catalogue

    scans = []
    monkeypatch.setattr(catalogue, "written", lambda df, name: scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan")) or df.cache())
    catalogue.QUERIES["portfolio_metrics"](spark, sf_dir)
    assert scans == [2]  # lineitem and part
    for name in ("capm_alpha", "benchmark_excess"):
        assert catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2


def test_history_of_trades(spark):
    schema = "exec_date date, ticker string, action string, shares bigint, at bigint"
    rows = spark.createDataFrame([(dt.date(2026, 1, 2), "A", "SELL", 1, 0)], schema)
    prices = spark.createDataFrame([(dt.date(2026, 1, 2), "A", 5.0)], "exec_date date, ticker string, price double")
    got = matching.with_prices(matching.trade_history(("W1", "BUY", rows), ("W2", None, rows.withColumn("ticker", F.lit("B")))), prices).orderBy("part").collect()
    assert [(r.week, r.action, r.price) for r in got] == [("W1", "BUY", 5.0), ("W2", "SELL", None)]
    plan = spark.createDataFrame([(dt.date(2026, 1, 2), ["A", "B"])], schemas.EXECUTIONS)
    assert matching.exploded(plan).count() == 2


def test_series(spark):
    values = [0, 2.5, 5.8, 9.2, 7.5, 10.8, 13.5, 16.2, 18.5]
    df = spark.createDataFrame([("p", dt.date(2025, 11, 24) + dt.timedelta(7 * i), float(v)) for i, v in enumerate(values)], "of string, date date, cum double")
    got = [round(r.cum_change, 6) for r in series.period_changes(df, ["of"], "date", ["cum"]).orderBy("date").collect()]
    assert got == [2.5, 3.3, 3.4, -1.7, 3.3, 2.7, 2.7, 2.3] and abs(sum(got) - 18.5) < 1e-9
    based = series.period_changes(df.withColumn("cum", F.col("cum") + 1), ["of"], "date", ["cum"]).orderBy("date").collect()
    assert [round(r.cum_change, 6) for r in based][:2] == [3.5, 3.3]  # the first period is its own value, whatever the base
    assert [r.is_last for r in series.flag_last(df, ["of"], "date").orderBy("date").collect()] == [False] * 8 + [True]
    assert series.to_first(df.filter("cum > 0"), ["of"], "date", "cum", "x").orderBy("date").first().x == 0
    level = spark.createDataFrame([("p", i, v) for i, v in enumerate([100.0, 120.0, 90.0, 130.0])], "of string, i int, v double")
    assert series.drawdown(level, ["of"], "i", "v").first().max_drawdown == -0.25
    assert one(spark, x=series.geometric_change(F.lit(0.21), F.lit(0.1))).x == pytest.approx(0.1)


@pytest.mark.parametrize("market, alpha, expected, excess", [(2.5910745, 16.474898, 4.787236, 18.671060), (3.1055372, 15.523142, 5.738992, 18.156597)])
def test_alpha(spark, market, alpha, expected, excess):
    r = one(spark, **series.alpha(F.lit(21.262134), F.lit(market), 1.85))
    assert (r.alpha, r.expected, r.excess) == pytest.approx((alpha, expected, excess), abs=2e-6)


def test_alpha_in_one_unit(spark):
    assert one(spark, **series.alpha(F.lit(21.262134), F.lit(2.5910745), 1.85, rate_in_percent=True)).alpha == pytest.approx(17.0939, abs=1e-4)


def test_weekly_expectation(spark):
    w = series.weekly_expectation(0.03557, 0.27)
    assert w == pytest.approx(0.000917692, abs=1e-9) and one(spark, x=series.annualised_pct(F.lit(w))).x == pytest.approx(4.772)


def test_risk(spark):
    df = spark.createDataFrame([("p", 0.0262, 0.0232), ("p", 0.0192, -0.0029)], "of string, ret double, market double")
    r = series.risk(df, ["of"], "ret", "market", 0.03557 / 52).first()
    assert (r.mean, r.volatility, r.beta, r.sharpe) == pytest.approx((0.0227, 0.00495, 0.268, 4.448), abs=2e-3)
    rng = np.random.default_rng(1)
    a, b = rng.normal(0.01, 0.02, (2, 50))
    r = series.risk(spark.createDataFrame([("p", float(x), float(y)) for x, y in zip(a, b, strict=True)], "of string, ret double, market double"), ["of"], "ret", "market", 0.0).first()
    error = np.std(a - b, ddof=1)
    assert (r.correlation, r.tracking_error, r.information_ratio, r.var_95) == pytest.approx((np.corrcoef(a, b)[0, 1], error, np.mean(a - b) / error, np.quantile(a, 0.05)))


def test_ledger(spark):
    rows = [("injection", None, "", 53613), ("injection", None, "", 7672), ("injection", None, "", 38175), ("injection", None, "", 1955), ("proceeds", None, "", 22997), ("proceeds", None, "", 21367)]
    got = {r.kind: r.amount for r in series.ledger(spark.createDataFrame(rows, schemas.CASH_EVENTS), "kind", "amount").collect()}
    assert got == {"injection": 101415, "proceeds": 44364}
    assert one(spark, **valuation.returns_on(F.lit(124072), F.lit(101415))).return_pct == pytest.approx(22.340877, abs=1e-6)


def test_portfolio_document(spark, tmp_path):
    doc = {
        "initialCapital": 100000,
        "weeks": [
            {"label": "Week 1", "execDate": "2026-01-02", "weights": {"HD": 0.26, "KO": 0.04}, "positions": [{"ticker": "HD", "shares": 76, "execPrice": 342.7}, {"ticker": "KO", "shares": 51, "execPrice": 68.92}]},
            {"label": "Week 2", "execDate": "2026-01-12", "weights": {"HD": 0.27}, "positions": [{"ticker": "HD", "shares": 75}], "trades": [{"ticker": "HD", "action": "SELL", "shares": 1}]},
            {"label": "Week 3", "execDate": "2026-01-20", "status": "active", "plannedTrades": [{"ticker": "HD", "action": "BUY", "shares": 9, "estimatedPrice": 379.55}]},
        ],
    }
    (tmp_path / "p.json").write_text(json.dumps(doc))
    d = readers.portfolio_document(spark, str(tmp_path / "p.json"))
    assert [(r.week, r.status) for r in readers.week_table(d).orderBy("week").collect()] == [(1, None), (2, None), (3, "active")]
    assert readers.week_items(d, "positions").count() == 3 and readers.week_items(d, "trades").first().week == 2 and readers.week_items(d, "plannedTrades").first().estimatedPrice == 379.55
    assert readers.week_weights(d).count() == 3


def test_request_parameters(spark):
    assert readers.symbols(None, "A,B") == ["A", "B"] and readers.symbols("", "A") == ["A"] and readers.symbols(" x,,y", "A") == [" x", "", "y"]
    bars = spark.createDataFrame([(i, "A", dt.datetime(2026, 1, d), 1.0) for i, d in enumerate(range(1, 8))], schemas.BARS)
    assert readers.between_days(bars.withColumn("day", F.to_date("bar_ts")), "day", "2026-01-04").count() == 4


def test_remote_client_is_landed(spark, tmp_path):
    asked = []
    got = readers.land(lambda wanted: asked.append(wanted) or [{"seq": 1, "symbol": "A", "price": 2.0}], spark, ["A", "B"], str(tmp_path / "q"))
    assert asked == [["A", "B"]] and got.first().price == 2.0


def test_envelopes(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (2, "A", 2.0), (3, "B", 3.0)], "seq bigint, k string, v double")
    body = envelopes.quote_envelope(envelopes.price_map(df, "k", "seq", F.col("v")), "2026-01-02T00:00:00Z", "live", "REGULAR").first()
    assert json.loads(body.body) == {"prices": {"A": 2.0, "B": 3.0}, "timestamp": "2026-01-02T00:00:00Z", "source": "live", "marketState": "REGULAR", "isOpen": True} and body.status == 200
    many = spark.createDataFrame([('{"a": 1}',), (' [{"a": 1}, {"a": 2}]',), ("[]",), ("7",), (None,)], "body string")
    assert [r.x and [y.a for y in r.x] for r in many.select(envelopes.one_or_many(F.col("body"), "struct<a:int>").alias("x")).collect()] == [[1], [1, 2], [], None, None]
    bad = envelopes.error_envelope(df, "no answer").first()
    assert json.loads(bad.body) == {"prices": {}, "error": "no answer"} and bad.status == 502


def test_snapshot_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    row = lambda n, s, p: (n, s, p, *[None] * 10)

    def arrive(*rows):
        spark.createDataFrame(list(rows), schemas.QUOTES).write.mode("append").json(src)
        q = snapshots.keep_latest(spark, src, schemas.QUOTES, out, ck, "symbol", "seq")
        q.awaitTermination(120)
        return {r.symbol: r.price for r in snapshots.snapshot(spark, out, schemas.QUOTES).collect()}

    assert arrive(row(1, "A", 1.0), row(2, "B", 2.0)) == {"A": 1.0, "B": 2.0}
    assert arrive(row(3, "A", 3.0)) == {"A": 3.0, "B": 2.0}
    assert arrive(row(4, None, 9.0)) == {"A": 3.0, "B": 2.0}  # a bad batch keeps the snapshot
    for n in range(5, 8):
        assert arrive(row(n, "C", float(n)))["C"] == n
    buckets = [p.name for p in (tmp_path / "out").glob("version=*/rows/bucket=*")]
    assert max(map(buckets.count, buckets)) <= 3 and len(set(buckets)) == 3  # only what a batch touches is written, and older versions are removed
    assert len(list((tmp_path / "out" / "_manifests").glob("*.json"))) == 2
    with pytest.raises(ValueError):
        snapshots.trigger(5)
    assert snapshots.trigger() == {"processingTime": "900 seconds"}


QUOTE = "symbol string, seq bigint, price double"


def stream(spark, tmp_path, lines, checkpoint="ck", **options):
    """Lines arrive in a file of their own, and a stream with that checkpoint runs over what it has not seen."""
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / f"{len(list(folder.iterdir())):03d}.json").write_text("\n".join(lines) + "\n" if lines else "")
    q = snapshots.keep_latest(spark, str(folder), QUOTE, str(tmp_path / "out"), str(tmp_path / checkpoint), "symbol", "seq", **options)
    q.awaitTermination(120)
    assert q.exception() is None
    now = snapshots.snapshot(spark, str(tmp_path / "out"), QUOTE)
    return sorted((r.symbol, r.price) for r in now.collect()) if now else None


def quote(symbol, seq, price):
    return json.dumps({"symbol": symbol, "seq": seq, "price": price})


def test_snapshot_after_a_new_checkpoint_and_other_buckets(spark, tmp_path):
    assert stream(spark, tmp_path, [quote("A", 1, 1.0), quote("B", 1, 5.0)]) == [("A", 1.0), ("B", 5.0)]
    assert stream(spark, tmp_path, [quote("A", 2, 2.0)]) == [("A", 2.0), ("B", 5.0)]
    assert stream(spark, tmp_path, [quote("A", 3, 3.0)], "other") == [("A", 3.0), ("B", 5.0)]  # all lines again, from batch 0 on
    assert stream(spark, tmp_path, [quote("C", 1, 7.0)], "other", buckets=7) == [("A", 3.0), ("B", 5.0), ("C", 7.0)]
    assert stream(spark, tmp_path, [quote("A", 4, 9.0)], "other", buckets=7) == [("A", 9.0), ("B", 5.0), ("C", 7.0)]
    assert stream(spark, tmp_path, [quote("A", 5, 9.5)], "other", buckets=64) == [("A", 9.5), ("B", 5.0), ("C", 7.0)]
    names = [p.name for p in (tmp_path / "out").glob("version=*")]
    assert len(names) <= 4


def test_every_line_is_merged_or_in_quarantine_once(spark, tmp_path):
    from ledgerlark.streaming import manifests

    out = str(tmp_path / "out")
    state = lambda: (lambda m: (m.merged, m.quarantined))(manifests.last(spark, out))
    held = lambda: sorted((r.value, r.reason) for r in snapshots.quarantined(spark, out).collect())
    assert stream(spark, tmp_path, ["no json", quote(None, 1, 1.0)]) is None and state() == (0, 2)
    assert stream(spark, tmp_path, [quote("A", 1, 1.0), '{"symbol": "B", "seq": "x"}', "", "  "]) == [("A", 1.0)] and state() == (1, 3)
    complete = snapshots.has_all("symbol", "price", ["A", "B"])
    assert stream(spark, tmp_path, [quote("A", 2, 2.0), "{"], accept=complete) == [("A", 1.0)] and state() == (1, 5)
    reasons = [r for _, r in held()]
    assert sorted(reasons) == ["keyless", "malformed", "malformed", "malformed", "refused"]
    assert stream(spark, tmp_path, [quote("A", 3, 3.0), quote("B", 3, 4.0)], accept=complete) == [("A", 3.0), ("B", 4.0)] and state() == (3, 5)

    # a batch that runs again after its version was written changes nothing
    before = manifests.last(spark, out)
    owner, number = next(iter(before.owners.items()))
    for file in [*(tmp_path / "ck" / "commits").glob(str(number)), *(tmp_path / "ck" / "commits").glob(f".{number}.crc")]:
        file.unlink()
    assert stream(spark, tmp_path, []) == [("A", 3.0), ("B", 4.0)]
    assert state() == (3, 5) and manifests.last(spark, out).owners[owner] >= number

    # what can be mended is merged, once; the rest stays
    mend = lambda lines: lines.withColumn("value", F.regexp_replace("value", '"seq": "x"', '"seq": 9, "price": 8.5'))
    snapshots.replay(spark, out, QUOTE, "symbol", "seq", mend)
    assert sorted((r.symbol, r.price) for r in snapshots.snapshot(spark, out, QUOTE).collect()) == [("A", 3.0), ("B", 8.5)] and state() == (5, 3)
    assert sorted(r for _, r in held()) == ["keyless", "malformed", "malformed"]
    snapshots.replay(spark, out, QUOTE, "symbol", "seq")
    assert state() == (5, 3) and len(held()) == 3

    # two writers of one version
    later = manifests.last(spark, out)
    manifests.commit(spark, out, later.following("x", 0, 0))
    with pytest.raises(RuntimeError):
        manifests.commit(spark, out, later.following("y", 0, 0))
    assert state() == (5, 3)


def quoting(symbol, day):
    """A client that fails for one symbol."""
    if symbol == "BAD":
        raise OSError("no such symbol")
    return [{"price": float(day.day), "seq": 1, "market_state": "REGULAR"}]


def test_landed_source(spark, tmp_path):
    from ledgerlark.sources import landed

    root = tmp_path / "quotes"
    for symbol in ("A", "B", "C D"):
        for day in (1, 2, 3):
            folder = root / f"symbol={symbol.replace(' ', '%20')}" / f"day=2026-01-{day:02d}"
            folder.mkdir(parents=True)
            (folder / "x.json").write_text("" if symbol == "A" and day == 3 else "no json" if symbol == "B" and day == 2 else json.dumps({"seq": day, "price": day + 0.5, "unknown": [1]}) + "\n")
    read = landed.table(spark, "quotes", f"file://{root}", push=True)
    plain = landed.table(spark, "quotes", str(root))
    every = {(r.symbol, r.day.day): r for r in read.collect()}
    assert sorted(every) == [("A", 1), ("A", 2), ("B", 1), ("B", 2), ("B", 3), ("C D", 1), ("C D", 2), ("C D", 3)]
    assert every["C D", 2].price == 2.5 and every["C D", 2].error is None and every["C D", 2].market_state is None
    assert every["B", 2].error and every["B", 2].price is None and every["B", 2].file.endswith("x.json")

    asked = read.filter("symbol IN ('A', 'B') AND day >= '2026-01-02' AND price > 0")
    assert sorted((r.symbol, r.day.day) for r in asked.collect()) == [("A", 2), ("B", 3)]
    # which files are opened: those of the partitions that pushed filters leave
    reader = landed.PushedReader(read.schema, {"path": str(root)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan

    left = list(reader.pushFilters([In(("symbol",), ("A", "B")), GreaterThanOrEqual(("day",), dt.date(2026, 1, 2)), GreaterThan(("price",), 0.0)]))
    assert left == [GreaterThan(("price",), 0.0)]
    opened = [f for p in reader.partitions() for f in p.files]
    assert opened == [f"{root}/symbol={s}/day=2026-01-{d:02d}/x.json" for s, d in (("A", 2), ("A", 3), ("B", 2), ("B", 3))]
    assert asked.rdd.getNumPartitions() == 4  # the filters have reached the source
    assert read.count() == 8  # and leave no trace in the table
    assert plain.filter("symbol = 'A'").union(plain.filter("symbol = 'B'")).count() == 5
    some = landed.table(spark, "quotes", str(root), symbols=["B", "C D"], first="2026-01-02", last="2026-01-02")
    assert sorted(r.symbol for r in some.collect()) == ["B", "C D"] and some.rdd.getNumPartitions() == 2
    assert not list(reader.pushFilters([EqualTo(("symbol",), "A"), LessThan(("day",), dt.date(2026, 1, 3))])) and len(reader.partitions()) == 1

    # a client is asked in tasks, for what the filters name
    client = landed.table(spark, "quotes", client=f"{__name__}:quoting", push=True)
    got = client.filter("symbol IN ('A', 'BAD') AND day BETWEEN '2026-01-05' AND '2026-01-06'").collect()
    assert sorted((r.symbol, r.day.day, r.price, r.error) for r in got if r.symbol == "A") == [("A", 5, 5.0, None), ("A", 6, 6.0, None)]
    assert [r.error for r in got if r.symbol == "BAD"] == ["OSError: no such symbol"] * 2
    with pytest.raises(Exception, match="names its symbols"):
        client.collect()


def test_landed_stream(spark, tmp_path):
    from ledgerlark.sources import landed

    landed.register(spark)
    root = tmp_path / "bars"

    def arrive(symbol, seq):
        folder = root / f"symbol={symbol}" / "day=2026-01-01"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{seq}.json").write_text(json.dumps({"bar_seq": seq, "open": 1.0}) + "\n")

    def run():
        stream = spark.readStream.format("landed").option("kind", "bars").load(str(root)).select("symbol", "bar_seq")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    arrive("A", 1), arrive("B", 2)
    assert run() == [("A", 1), ("B", 2)]
    arrive("A", 3)
    assert run() == [("A", 1), ("A", 3), ("B", 2)] == run()


def test_wide_tables(spark):
    from ledgerlark.operators import wide_tables

    rows = spark.createDataFrame([("2026-01", "x.y", 1), ("2026-01", "b", 2), ("2026-02", "b", 3), ("2026-03", None, 4), ("2026-01", "b", 1)], "month string, name string, v bigint")
    wide = wide_tables.wide(rows, ["month"], "name", "v")
    assert wide.columns == ["month", "b", "x.y"] and sorted(tuple(r) for r in wide.collect()) == [("2026-01", 2, 1), ("2026-02", 3, None), ("2026-03", None, None)]
    back = wide_tables.long(wide, ["month"], "name", "v", keep_null=False)
    assert sorted(tuple(r) for r in back.collect()) == [("2026-01", "b", 2), ("2026-01", "x.y", 1), ("2026-02", "b", 3)] and wide_tables.long(wide, ["month"], "name", "v").count() == 6
    both = wide_tables.combined([wide, spark.createDataFrame([("2026-04", 9)], "month string, q bigint")])
    assert both.columns == ["month", "b", "x.y", "q"] and both.filter("q = 9 AND b IS NULL").count() == 1
    assert wide_tables.long(wide_tables.wide(rows.limit(0), ["month"], "name", "v"), ["month"], "name", "v").count() == 0
    with pytest.raises(ValueError):
        wide_tables.names_of(rows, "name", 1)
    with pytest.raises(ValueError):
        wide_tables.wide(rows.withColumn("name", F.lit("month")), ["month"], "name", "v")


def test_drifting_documents(spark):
    docs = spark.createDataFrame([(1, '{"a": 1, "b": {"c": [1, 2]}}'), (2, '{"a": "x", "new": null}'), (3, "no json"), (4, None), (5, "[1]")], "id bigint, doc string")
    read = readers.drifting(docs, "doc", {"a": ("$.a", "bigint"), "second": ("$.b.c[1]", "bigint")})
    assert {r.id: (r.a, r.second) for r in read.collect()} == {1: (1, 2), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}
    fields = readers.document_fields(read.select("id", "document"), "document")
    assert sorted((r.id, r.field) for r in fields.collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "new")]


def test_capped_weights_of_three_assets(spark):
    """Against all weights on a fine grid, and what they must keep."""
    from ledgerlark.operators import optimising

    rng = np.random.default_rng(4)
    rows = [(g, d, a, float(x)) for g in (1, 2, 3) for d in range(20) for a, x in zip("abc", rng.normal([0.01, 0.0, -0.01], [0.02 * g, 0.01, 0.015]) + rng.normal(0, 0.01), strict=True)]
    df = spark.createDataFrame([*rows, (4, 0, "a", 0.1), (4, 1, "a", 0.2), (4, 0, "b", 0.1), (5, 0, "a", 0.3), (5, 1, None, 0.3), (6, 0, "a", None)], "g int, d int, asset string, r double")
    found = optimising.moments(df, ["g"], "d", "asset", "r")
    by_pair = {(r.g, r.a, r.b): r for r in found.collect()}
    for g in (1, 2, 3):
        own = np.array([[x for h, _, a, x in rows if h == g and a == k] for k in "abc"])
        assert all(by_pair[g, a, b].covariance == pytest.approx(np.cov(own)["abc".index(a), "abc".index(b)]) for a, b in ("aa", "ab", "bc", "cc"))
        for tilt, most in ((0.0, 1.0), (0.02, 0.5), (5.0, 0.6)):
            got = {r.asset: r.weight for r in optimising.capped_weights(found, ["g"], tilt, most).filter(f"g = {g}").collect()}
            w = np.array([got[k] for k in "abc"])
            cost = lambda w: (np.einsum("...i,ij,...j", w, np.cov(own), w) / 2 - tilt * w @ own.mean(axis=1))  # noqa: E731, B023
            grid = np.array([(x, y, 1 - x - y) for x in np.linspace(0, most, 301) for y in np.linspace(0, most, 301) if -1e-12 <= 1 - x - y <= most + 1e-12])
            assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= most + 1e-9 and cost(w) <= cost(grid).min() + 1e-12
    few = {(r.g, r.asset): r.weight for r in optimising.capped_weights(found, ["g"], 0.0, 0.3, least=0.05).collect()}
    assert few[4, "a"] == pytest.approx(1.0) and not [k for k in few if k[0] in (5, 6)]  # one asset; none with a covariance
    assert all(w == 0 or w >= 0.05 for w in few.values())


def test_a_map_has_a_bound(spark):
    rows = spark.range(20).selectExpr("concat('k', id % 5) AS key", "id", "id * 1.5 AS v")
    assert envelopes.price_map(rows, "key", "id", F.col("v"), most=5).first().prices == {f"k{i}": (15 + i) * 1.5 for i in range(5)}
    with pytest.raises(Exception, match="more than 4 keys"):
        envelopes.price_map(rows, "key", "id", F.col("v"), most=4).collect()


def test_written_once(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(2)
    for _ in range(2):
        assert snapshots.written_once(spark, str(tmp_path / "t"), make).count() == 2
    assert made == [1]
    assert snapshots.written_once(spark, str(tmp_path / "u"), lambda: spark.range(0)).count() == 0
    assert snapshots.written_once(spark, str(tmp_path / "u"), make).count() == 2
    prices = lambda *rows: spark.createDataFrame(list(rows), "k string, v double")
    both = snapshots.has_all("k", "v", ["A", "B"])
    assert snapshots.written_once(spark, str(tmp_path / "w"), lambda: prices(("A", 1.0), ("B", None)), both).count() == 2
    assert snapshots.written_once(spark, str(tmp_path / "w"), lambda: prices(("A", 1.0), ("B", 2.0)), both).filter("v = 2").count() == 1


def test_one_symbol_that_fails_leaves_the_others(spark, tmp_path):
    def fetch(wanted):
        if wanted == ["B"]:
            raise OSError("no answer")
        return [{"symbol": s, "price": 1.0} for s in wanted]

    got = readers.land(readers.each_alone(fetch, "symbol"), spark, ["A", "B", "C"], str(tmp_path / "q"))
    assert {r.symbol: r.price for r in got.collect()} == {"A": 1.0, "B": None, "C": 1.0}


def test_bars_are_pruned_by_time(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    bars = spark.createDataFrame([(i, "A", t(i), 1.0) for i in range(1, 12)], schemas.BARS)
    span = spark.createDataFrame([(t(5), t(6))], "a timestamp, b timestamp")
    assert sorted(r.bar_seq for r in readers.between_times(bars, "bar_ts", span, "a", "b", "1 DAY").collect()) == [4, 5, 6, 7]
    assert readers.between_times(bars, "bar_ts", span.limit(0).selectExpr("min(a) a", "max(b) b"), "a", "b", "1 DAY").count() == 0


def test_bounds_reach_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    span = events.filter("event_type = 'purchase'").selectExpr("min(ts) a", "max(ts) b")
    plan = readers.between_times(events, "ts", span, "a", "b", "1 DAY")._jdf.queryExecution().toString()
    assert "scalar-subquery" in plan.split("PushedFilters")[0] and "Join" not in plan


def test_rebalancing(spark):
    from ledgerlark.operators import rebalancing

    weights = spark.createDataFrame([("HD", 0.2630), ("UNH", 0.0594), ("KO", 0.0356), ("JNJ", 0.2623), ("AMGN", 0.3055), ("VZ", 0.0742), ("X", 0.1)], "ticker string, weight double")
    prices = spark.createDataFrame([("HD", 342.70), ("UNH", 335.45), ("KO", 68.92), ("JNJ", 205.87), ("AMGN", 324.92), ("VZ", 39.74)], "ticker string, exec_price double")
    first = rebalancing.sized(weights, prices, 100_000)
    shares = lambda df: {r.ticker: r.shares for r in df.collect()}
    assert shares(first) == {"HD": 76, "UNH": 17, "KO": 51, "JNJ": 127, "AMGN": 94, "VZ": 186, "X": None}
    second = spark.createDataFrame([("HD", 75), ("UNH", 22), ("KO", 120), ("JNJ", 123), ("AMGN", 79), ("VZ", 120)], "ticker string, shares bigint")
    held = first.filter("shares is not null")
    trades = rebalancing.trades_between(held, second)
    assert {(r.ticker, r.action, r.shares) for r in trades.collect()} == {("HD", "SELL", 1), ("UNH", "BUY", 5), ("KO", "BUY", 69), ("JNJ", "SELL", 4), ("AMGN", "SELL", 15), ("VZ", "SELL", 66)}
    assert shares(rebalancing.after_trades(held, trades)) == shares(second)
    assert shares(rebalancing.after_trades(held, rebalancing.trades_between(held, held.limit(0)))) == {}
