"""Registry of queries, and the SQL of the adapter views in ``sources.driver``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import r
from ..sources.driver import CELL, SUPPLIER

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def out(df: DataFrame, keys: str, digits: int = 6, **values: Column | str) -> DataFrame:
    """Keys as they are, values as rounded doubles: the compared form of a result."""
    return df.select(*keys.split(), *[r(v if isinstance(v, Column) else F.col(v), digits).alias(k) for k, v in values.items()])


def cols(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n},{digits})+0.0 AS {n}" for n in names)


def rnd(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE),{digits})+0.0 AS {name}"


def win(n: int) -> str:
    return f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


W = "w AS (PARTITION BY symbol ORDER BY date)"
U = "u AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def windows(*ns: int) -> str:
    return "WINDOW " + ", ".join([W, U, *[win(n) for n in ns]])


def gated(agg: str, c: str, n: int, need: int | None = None) -> str:
    return f"CASE WHEN count({c}) OVER w{n} >= {need or n} THEN {agg} OVER w{n} END"


def zscore(c: str, n: int = 252) -> str:
    """SQL of the rolling z-score of a plain column."""
    mean, std = gated(f"avg({c})", c, n, n // 2), gated(f"stddev_samp({c})", c, n, n // 2)
    return f"({c}-({mean}))/(({std})+1e-9)"


def symbol_sql(kind: str) -> str:
    return "l_returnflag||l_linestatus" if kind == CELL else "'S'||CAST(l_suppkey AS VARCHAR)"


def prices_sql(kind: str = SUPPLIER) -> str:
    return f"""cell AS (SELECT {symbol_sql(kind)} AS symbol, CAST(l_shipdate AS DATE) AS date,
    ln(sum(l_extendedprice)/sum(l_quantity)) AS x, sum(l_quantity) AS volume FROM lineitem GROUP BY 1,2),
shock AS (SELECT *, 0.01*(x-avg(x) OVER (PARTITION BY symbol))/nullif(stddev_samp(x) OVER (PARTITION BY symbol),0) AS s FROM cell),
prices AS (SELECT symbol, date, volume, round(100*exp(sum(s) OVER
    (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),4) AS close FROM shock)"""


def predictions_sql(kind: str = SUPPLIER) -> str:
    return prices_sql(kind) + """,
predictions AS (SELECT * FROM (SELECT 'mom' AS strategy, symbol, date,
    round(0.2*ln(close/lag(close,20) OVER w),8) AS pred, round(ln(lead(close,20) OVER w/close),8) AS actual,
    (date_diff('day', DATE '1995-01-01', date)//63)%4=0 AS is_oof
    FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE pred IS NOT NULL AND actual IS NOT NULL)"""


POSITIONS_SQL = """positions AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE)+1 AS report_date, o_orderstatus AS market,
    CAST(count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT','2-HIGH')) AS DOUBLE) AS spec_long,
    CAST(count(*) FILTER (WHERE o_orderpriority='3-MEDIUM') AS DOUBLE) AS spec_short,
    CAST(count(*) FILTER (WHERE o_orderpriority='4-NOT SPECIFIED') AS DOUBLE) AS comm_long,
    CAST(count(*) FILTER (WHERE o_orderpriority='5-LOW') AS DOUBLE) AS comm_short, CAST(count(*) AS DOUBLE) AS open_int
    FROM orders GROUP BY 1,2)"""

MACRO_SQL = """macro AS (SELECT 'order_value' AS series, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice),2)/count(*) AS value
    FROM orders GROUP BY 2)"""

INTEREST_SQL = """interest AS (SELECT o_orderpriority AS keyword, CAST(date_trunc('week', o_orderdate) AS DATE) AS date,
    CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1,2)"""

HEADLINES_SQL = """headlines AS (SELECT source AS category, text AS title,
    DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date, doc_id AS url FROM documents)"""

# Business days with their running index from Monday 1970-01-05, counted rather than computed.
BDAYS_SQL = """bdays AS (SELECT d AS date, row_number() OVER (ORDER BY d)-1 AS idx FROM (
    SELECT CAST(unnest(generate_series(TIMESTAMP '1970-01-05', TIMESTAMP '2010-12-31', INTERVAL 1 DAY)) AS DATE) AS d)
    WHERE isodow(d)<6)"""


def bday_shift_sql(date: str, n: int) -> str:
    """Scalar subquery: the business day n after a date (weekends count as the Friday before)."""
    return f"(SELECT b2.date FROM bdays b2 WHERE b2.idx=(SELECT max(b1.idx) FROM bdays b1 WHERE b1.date<={date})+{n})"


# Confidence, size and position of predictions; needs the CTE of predictions.
def signals_sql(source: str = "predictions", min_signal: str = "0.008", mode: str = "'cash_long'", max_pos: str = "1.0", keys: str = "strategy, symbol") -> str:
    return f"""ranked AS (SELECT *, (rank() OVER (PARTITION BY {keys} ORDER BY abs(pred))
    + (count(*) OVER (PARTITION BY {keys}, abs(pred)) - 1)/2.0) / count(*) OVER (PARTITION BY {keys}) AS conf_pct FROM {source}),
directed AS (SELECT *, CASE WHEN abs(pred)<{min_signal} THEN 0 ELSE CAST(sign(pred) AS INTEGER) END AS raw_direction FROM ranked),
moded AS (SELECT *, CASE WHEN {mode} IN ('long_only','cash_long','cash_bonds') AND raw_direction<0 THEN 0 ELSE raw_direction END AS direction FROM directed),
sized AS (SELECT *, CASE WHEN direction=0 THEN 0.0 WHEN conf_pct<0.25 THEN 0.25 WHEN conf_pct<0.5 THEN 0.5 WHEN conf_pct<0.75 THEN 0.75 ELSE 1.0 END AS size_frac FROM moded),
signals AS (SELECT *, CAST(direction*size_frac*{max_pos} AS DOUBLE) AS position FROM sized)"""


def ledger_sql(source: str = "signals", keys: str = "strategy, symbol", hold: int = 20, cost: str = "0.0015", mode: str = "'cash_long'") -> str:
    return f"""stepped AS (SELECT *, position-coalesce(lag(position) OVER (PARTITION BY {keys} ORDER BY date),0) AS pos_change,
    CASE WHEN {mode}='cash_bonds' AND position=0 THEN ln(1.04)/252 ELSE position*actual/{hold} END AS ret_gross FROM {source}),
netted AS (SELECT *, ln(greatest(exp(ret_gross)-abs(pos_change)*{cost},1e-12)) AS ret_net FROM stepped),
ledger AS (SELECT *, exp(sum(ret_net) OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)+ln(100000.0)) AS capital FROM netted)"""


def perf_sql(keys: str = "strategy, symbol") -> str:
    return f"""peaked AS (SELECT *, capital/greatest(100000.0, max(capital) OVER (PARTITION BY {keys} ORDER BY date
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))-1 AS drawdown FROM ledger),
perf AS (SELECT {keys}, (arg_max(capital,date)/100000-1)*100 AS total_return_pct,
    (exp(ln(arg_max(capital,date)/100000)/greatest(date_diff('day',min(date),max(date))/365.25,0.01))-1)*100 AS annual_return_pct,
    stddev_pop(ret_gross)*sqrt(252)*100 AS volatility_pct,
    avg(ret_gross)/(stddev_pop(ret_gross)+1e-9)*sqrt(252) AS sharpe,
    least(min(drawdown),0)*100 AS max_drawdown_pct,
    avg(CASE WHEN position>0 THEN 1.0 ELSE 0.0 END)*100 AS long_days_pct,
    avg(CASE WHEN position<0 THEN 1.0 ELSE 0.0 END)*100 AS short_days_pct,
    avg(CASE WHEN position=0 THEN 1.0 ELSE 0.0 END)*100 AS flat_days_pct,
    coalesce(count(*) FILTER (WHERE position<>0 AND ret_gross>0)*100.0/nullif(count(*) FILTER (WHERE position<>0),0),0) AS win_rate_pct,
    coalesce(avg(ret_gross) FILTER (WHERE position<>0 AND ret_gross>0),0)*100 AS avg_win_pct,
    coalesce(avg(ret_gross) FILTER (WHERE position<>0 AND ret_gross<=0),0)*100 AS avg_loss_pct,
    coalesce(sum(ret_gross) FILTER (WHERE position<>0 AND ret_gross>0),0)/(abs(coalesce(sum(ret_gross) FILTER (WHERE position<>0 AND ret_gross<=0),0))+1e-9) AS profit_factor,
    count(*) FILTER (WHERE abs(pos_change)>1e-6) AS n_trades, count(*) AS total_days FROM peaked GROUP BY {keys})"""


PERF_COLUMNS = (
    "total_return_pct", "annual_return_pct", "volatility_pct", "sharpe", "max_drawdown_pct", "long_days_pct",
    "short_days_pct", "flat_days_pct", "win_rate_pct", "avg_win_pct", "avg_loss_pct",
)
