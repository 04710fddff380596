"""Schemas of all inputs, in Spark's DDL. None is ever inferred."""

HOLDINGS_RAW = "input_pos bigint, ticker string, entry_price double, current_price double, shares bigint, sector string, theme string"
POSITIONS = (
    "input_pos bigint, ticker string, name string, sector string, rec_date date, rating string, entry_price double, current_price double, shares bigint, "
    "initial_investment double, current_investment double, profit_loss double, return_pct double, exit_date date, exit_price double"
)
CASH_EVENTS = "kind string, date date, label string, amount bigint"
BENCHMARKS = "portfolio string, symbol string, name string, inception double, current double"
BATCHES = "kind string, date date, label string, tickers array<string>"
RETURNS = "date date, ret double"
UNIVERSE = "ticker string, name string, sector string"
EXECUTIONS = "exec_date date, tickers array<string>"
BARS = "bar_seq bigint, ticker string, bar_ts timestamp, open double"
QUOTES = (
    "seq bigint, symbol string, price double, change double, change_percent double, previous_close double, open double, high double, low double, volume bigint, "
    "market_state string, name string, last_update timestamp"
)
METRICS = "series string, total_return double, mean_weekly_return double, weekly_volatility double, sharpe_ratio double, beta double, alpha double"
#: A portfolio document: fields that only some weeks have are null in the others.
PORTFOLIO = (
    "initialCapital double, riskFreeRate double, lookbackWeeks int, maxWeight double, minPosition double, "
    "weeks array<struct<label:string,calcDate:string,execDate:string,periodEnd:string,status:string,weights:map<string,double>,"
    "positions:array<struct<ticker:string,shares:bigint,execPrice:double,endPrice:double,costBasis:double>>,"
    "trades:array<struct<ticker:string,action:string,shares:bigint,price:double,value:double>>,"
    "dividends:array<struct<date:string,ticker:string,shares:bigint,perShare:double,amount:double>>,"
    "targetPositions:array<struct<ticker:string,shares:bigint,targetWeight:double>>,"
    "plannedTrades:array<struct<ticker:string,action:string,shares:bigint,estimatedPrice:double>>,"
    "portfolioValue:struct<start:double,end:double,stockValue:double,cash:double,dividends:double>,weeklyReturn:double>>, "
    "summary struct<totalReturn:double,priceReturn:double,dividendReturn:double,totalDividends:double,finalValue:double>"
)
