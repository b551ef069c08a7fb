"""Registered queries of sources and applications, with SQL where it can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .apps import workers
from .apps.backtest import build_messages, exchange_code, run_backtest
from .apps.factor import EXACT, analyze_factors
from .apps.optimize import analyze_sensitivity, optimize_backtest
from .queries import NUDGE, SECTION_SQL, SPAN, _rounded, node, section_panel
from .query import execute_query
from .sources.panel import CoreTable, append_dimension, latest, write_result
from .sources.shared import shared_folder
from .sources.store import SnapshotTable

# The source's dates are a feature of panel_source; all else takes every day.
PANEL_SPAN = {"start_date": "2024-01-03", "end_date": "2024-01-28", "codes": []}
_r = lambda e, n: f"round(({e})::double + {NUDGE}, 6) + 0.0 as {n}"
_in_span = "time >= timestamp '2024-01-03' and time < timestamp '2024-01-29'"


def _shape(df: DataFrame, *numbers: str) -> DataFrame:
    return df.select(*[_rounded(F.col(c)).alias(c) if c in numbers else F.col(c) for c in df.columns])


def panel_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows to the dense panel, with all three ways of filling."""
    p = section_panel(spark, sf_dir)
    wide = p.select("time", "code", F.when(F.col("v") % 4 != 0, F.col("c")).alias("close"), F.when(F.col("v") % 3 == 0, F.col("x")).alias("roe_ttm"), F.when(F.col("v") % 5 == 0, F.col("y")).alias("weight_A"), F.when(F.col("v") % 6 == 0, F.lit(1.0)).alias("is_st"))
    long = wide.unpivot(["time", "code"], ["close", "roe_ttm", "weight_A", "is_st"], "factor", "value").where("value is not null")
    out = execute_query(PANEL_SPAN | {"lookback": "2D", "factors": ["close", "roe_ttm", "weight_A", "is_st", "absent"]}, long).data
    return _shape(out, "close", "roe_ttm", "weight_A", "is_st", "absent")


PANEL_SQL = f"""with {SECTION_SQL},
w as (select time, code, case when v % 4 <> 0 then c end as close, case when v % 3 = 0 then x end as roe_ttm, case when v % 5 = 0 then y end as weight_a, case when v % 6 = 0 then 1.0 end as is_st from panel where time >= timestamp '2024-01-01' and time < timestamp '2024-01-29'),
days as (select distinct time from w where close is not null),
codes as (select distinct code from w where close is not null),
keys as (select time, code, true as sel from days, codes union all select time, code, false from w where close is not null or roe_ttm is not null or weight_a is not null or is_st is not null),
line as (select time, code, bool_or(sel) as sel from keys group by time, code),
f as (select line.time, line.code, sel, close, roe_ttm, coalesce(is_st, 0.0) as is_st, case when count(weight_a) over (partition by line.time) > 0 then coalesce(weight_a, 0.0) end as weight_a from line left join w using (time, code)),
g as (select time, code, sel, close, is_st, last_value(roe_ttm ignore nulls) over u as roe_ttm, last_value(weight_a ignore nulls) over u as weight_a from f window u as (partition by code order by time rows between unbounded preceding and current row))
select time, code, {_r('close', 'close')}, {_r('roe_ttm', 'roe_ttm')}, {_r('weight_a', '"weight_A"')}, {_r('is_st', 'is_st')}, null::double as absent from g where sel and {_in_span}"""

FACTORS = {
    "dataset_query": SPAN
    | {
        "derivatives": {
            "size": node("DIRECT", "unary.get", {"col": "v"}),
            "f": node("DIRECT", "unary.get", {"col": "x"}),
            "f_group": node("CS", "unary.qcut", {"col": "x"}, {"q": 3}),
            "ret": node("DIRECT", "unary.get", {"col": "y"}),
        },
    },
    "factor_columns": ["f"],
    "return_columns": ["ret"],
    "return_specs": {"ret": {"kind": "simple", "periods": 1}},
    "n_groups": 3,
    "preprocess": False,
    "market_value_column": "size",
}


def factor_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(analyze_factors(FACTORS, panel=section_panel(spark, sf_dir)).information_coefficient, "f_ret_ic", "f_ret_rank_ic")


def factor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"f_ret_group{g}" for g in range(3)]
    return _shape(analyze_factors(FACTORS, panel=section_panel(spark, sf_dir)).group_returns, *names)


def factor_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With preprocessing: the residual on size and industry, its group, beside the group returns' inputs."""
    panel = section_panel(spark, sf_dir).withColumnsRenamed({"v": "circ_mv", "x": "f", "y": "ret"})
    industries = panel.select("code", F.concat(F.lit("i"), F.col("code").cast("long") % 7).alias("industry")).distinct()
    request = {"dataset_query": SPAN | {"factors": ["f"]}, "factor_columns": ["f"], "return_columns": ["ret"], "return_specs": {"ret": {"kind": "simple", "periods": 1}}}
    return _shape(analyze_factors(request, panel=panel, industries=industries).processed, "f", "f_group", "ret", "circ_mv")


ANALYSIS_SQL = f"""with {SECTION_SQL},
d as (select time, code, x as f, y as ret, v as mv, 'i' || (code::bigint % 7) as industry from panel),
a as (select *, case when mv is not null then f end as y0, case when f is not null then ln(greatest(mv, 1)) end as x0 from d),
b as (select *, quantile_cont(y0, 0.5) over (partition by time) as m from a),
c as (select *, 3 * quantile_cont(abs(y0 - m), 0.5) over (partition by time) as far from b),
e as (select *, case when far = 0 then y0 when y0 is not null then greatest(m - far, least(m + far, y0)) end as y1 from c),
z as (select *, (y1 - avg(y1) over t) / nullif(stddev_pop(y1) over t, 0) as y2, (x0 - avg(x0) over t) / nullif(stddev_pop(x0) over t, 0) as x2 from e window t as (partition by time)),
h as (select *, case when x2 is not null then y2 end as y3, case when y2 is not null then x2 end as x3 from z),
i as (select *, y3 - avg(y3) over s as yd, x3 - avg(x3) over s as xd, count(y3) over t as n, len(list_distinct(list(industry) filter (y3 is not null) over t)) as sectors from h window s as (partition by time, industry), t as (partition by time)),
j as (select *, case when n > sectors then yd - coalesce(sum(xd * yd) over t / nullif(sum(xd * xd) over t, 0), 0) * xd end as rest from i window t as (partition by time)),
k as (select *, case when stddev_pop(rest) over t > {EXACT} then (rest - avg(rest) over t) / stddev_pop(rest) over t end as pure from j window t as (partition by time))
select time, code, industry, {_r('pure', 'f')}, {_r('case when pure is not null then least(floor((row_number() over (partition by time order by round(pure, 9) nulls last, code) - 1) * 5 / count(pure) over (partition by time)), 4) end', 'f_group')}, {_r('ret', 'ret')}, {_r('mv', 'circ_mv')} from k"""

_AVERAGE_RANK = "case when f is not null and ret is not null then (rank() over (partition by time, f is null or ret is null order by {c}) + rank() over (partition by time, f is null or ret is null order by {c} desc) * -1 + count(*) over (partition by time, f is null or ret is null) + 1) / 2.0 end"
IC_SQL = f"""with {SECTION_SQL}, d as (select time, x as f, y as ret from panel), k as (select *, {_AVERAGE_RANK.format(c='f')} as rf, {_AVERAGE_RANK.format(c='ret')} as rr from d)
select time, {_r('corr(f, ret)', 'f_ret_ic')}, {_r('corr(rf, rr)', 'f_ret_rank_ic')} from k group by time"""
GROUPS_SQL = f"""with {SECTION_SQL}, d as (select time, y as ret, v, case when x is not null then floor((rank() over (partition by time, x is null order by x) - 1) * 3 / count(x) over (partition by time)) end as g from panel)
select time, {", ".join(_r(f"case when sum(v) filter (g = {g}) > 0 then sum(v * ret) filter (g = {g}) / sum(v) filter (g = {g}) end", f"f_ret_group{g}") for g in range(3))} from d group by time"""


def market_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = section_panel(spark, sf_dir)
    return p.select("time", F.concat("code", F.when(F.col("code").cast("long") % 2 == 0, ".SZ").otherwise(".SH")).alias("code"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), (F.col("c") - 0.5).alias("pre_close"), F.lit(None).cast("double").alias("up_limit"), F.when(F.col("v") % 2 == 0, F.col("l") - 1).alias("down_limit"), F.col("v").alias("adj_factor"))


def backtest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = build_messages(market_panel(spark, sf_dir).withColumn("code", exchange_code(F.col("code"))), "hfq", 0.01371)
    m = m.withColumns({"bid": F.get("bidPrice", F.lit(0)), "offer": F.get("offerPrice", F.lit(0))})
    return _shape(m.select("symbol", "symbolSource", "timestamp", "lastPrice", "upLimitPrice", "downLimitPrice", "prevClosePrice", "bid", "offer", "totalBidQty"), "lastPrice", "upLimitPrice", "downLimitPrice", "prevClosePrice", "bid", "offer")


MESSAGES_SQL = f"""with {SECTION_SQL},
d as (select time, code || case when code::bigint % 2 = 0 then '.XSHE' else '.XSHG' end as symbol, o * v as o, c * v as c, greatest(h, round((c - 0.5) * 1.1, 3)) * v as up, coalesce(case when v % 2 = 0 then l - 1 end, least(l, round((c - 0.5) * 0.9, 3))) * v as down, (c - 0.5) * v as pre from panel),
m as (select symbol, time + interval '9 hours 30 minutes' as timestamp, o as last, up, down, pre from d union all select symbol, time + interval '15 hours', c, up, down, pre from d)
select symbol, right(symbol, 4) as "symbolSource", timestamp, {_r('last', '"lastPrice"')}, {_r('up', '"upLimitPrice"')}, {_r('down', '"downLimitPrice"')}, {_r('pre', '"prevClosePrice"')}, {_r('round(last * (1 - 0.01371 / 2), 3)', 'bid')}, {_r('round(last * (1 + 0.01371 / 2), 3)', 'offer')}, 1000000000::bigint as "totalBidQty" from m where symbol is not null"""

_IDLE = {n: f"def {n}({', '.join(['context', 'message', 'indicator'][:k])}):\n    return None" for n, k in (("initialize", 1), ("beforeTrading", 1), ("onBar", 3), ("onOrder", 2), ("onTrade", 2), ("afterTrading", 1), ("finalize", 1))}
_TREND = """def onSnapshot(context, message, indicator):
    if context.now.hour != 9:
        return
    last = context.last(False)
    rising = set(last["code"][(last["r"] > context.get_param("least")).fillna(False)])
    for symbol in sorted(message["symbol"]):
        if symbol in rising:
            context.order_target_value(symbol, 2000.0, "in")
        elif context.position(symbol):
            context.order_target(symbol, 0, "out")"""


def _backtest_request(codes: list[str]) -> dict:
    d = {"r": node("TS", "unary.pct_change", {"col": "close"}, {"periods": 1})}
    return {"dataset_query": SPAN | {"codes": codes, "factors": ["close"], "derivatives": d}, "codes_query": SPAN | {"factors": ["close"]}, "callbacks": _IDLE | {"onSnapshot": _TREND}, "config": {"cash": 1000000, "commission": 0.0005}, "params": {"least": 0.0}}


def _small_limits(panel: DataFrame) -> DataFrame:
    return panel.withColumn("up_limit", F.col("high") + 1)


def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily portfolios of a trend strategy over all codes."""
    r = run_backtest(_backtest_request([]), panel=_small_limits(market_panel(spark, sf_dir)))
    return _shape(r.daily_portfolios, "cash", "totalMarketValue", "netValue", "ratio", "totalFee")


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [{"params": {"least": v}, "commission": 0.0005} for v in (-0.5, 0.0, 0.5)]
    return analyze_sensitivity(_backtest_request([]) | {"analysis_type": "sensitivity", "cases": cases}, panel=_small_limits(market_panel(spark, sf_dir)))


def optimization(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = {"parameter_space": {"least": [-0.5, 0.0, 0.5]}, "algorithms": ["halton", "hill_climb"], "start_date": "2024-01-15", "end_date": "2024-01-28", "lookback_period": "1W", "holding_period": "1W", "evaluation_budget": 2}
    return optimize_backtest(_backtest_request([]) | more, panel=_small_limits(market_panel(spark, sf_dir)))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by customer and quarter, in the role of report items."""
    end = F.last_day(F.date_add(F.add_months(F.trunc("o_orderdate", "quarter"), 3), -1))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.col("o_custkey").cast("string").alias("ts_code"), F.date_format(end, "yyyyMMdd").alias("end_date")).agg(F.round(F.sum("o_totalprice"), 2).alias("rev")).withColumn("f_ann_date", F.col("end_date"))


def financial_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = workers.flows(workers.with_quarter(_reports(spark, sf_dir)), ["rev"]).select("ts_code", "end_date", "end_type", "rev_1", "rev_2", "rev_3", "rev_4", "rev_ttm")
    return _shape(out, "rev_1", "rev_2", "rev_3", "rev_4", "rev_ttm")


FLOWS_SQL = f"""with q as (select o_custkey::varchar as ts_code, date_trunc('quarter', o_orderdate) as t, round(sum(o_totalprice), 2) as rev from orders group by 1, 2),
d as (select ts_code, strftime(last_day(t + interval 2 month), '%Y%m%d') as end_date, quarter(t) as end_type, year(t) as y, rev from q)
select d.ts_code, d.end_date, d.end_type::int as end_type, {", ".join(_r(f"case when d.end_type = {k} then d.rev end", f"rev_{k}") for k in (1, 2, 3, 4))}, {_r('case when d.end_type = 4 then d.rev else d.rev + a.rev - s.rev end', 'rev_ttm')}
from d left join d a on a.ts_code = d.ts_code and a.y = d.y - 1 and a.end_type = 4 left join d s on s.ts_code = d.ts_code and s.y = d.y - 1 and s.end_type = d.end_type"""


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins: one row per key, the one with the largest sequence."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    long = o.select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("time"), F.col("o_custkey").cast("string").alias("code"), F.col("o_orderpriority").alias("factor"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("sequence"))
    return _shape(latest(long), "value")


LATEST_SQL = f"select date_trunc('month', o_orderdate)::timestamp as time, o_custkey::varchar as code, o_orderpriority as factor, {_r('o_totalprice', 'value')} from orders qualify row_number() over (partition by date_trunc('month', o_orderdate), o_custkey, o_orderpriority order by o_orderkey desc) = 1"


def melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider rows to long rows: unpivot, and one row of equal keys."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    raw = li.select(F.col("l_partkey").cast("string").alias("ts_code"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("trade_date"), F.col("l_quantity").alias("qty"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("price"))
    return _shape(workers.to_long(raw, ["qty", "price"]), "value")


MELTED_SQL = f"with r as (select l_partkey::varchar as code, date_trunc('month', l_shipdate)::timestamp as time, l_quantity as qty, case when l_discount > 0 then l_extendedprice end as price from lineitem), m as (select time, code, 'qty' as factor, qty as value from r union all select time, code, 'price', price from r) select time, code, factor, {_r('max(value)', 'value')} from m where value is not null group by time, code, factor"

def snapshot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as long rows in four sequences, out of order, compacted in between; the table's latest version."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = [F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time"), F.col("user_id").cast("string").alias("code"), F.col("event_type").alias("factor")]
    rows = events.groupBy(*key, (F.col("event_id") % 4).alias("part")).agg(F.max("value").alias("value"))
    table = SnapshotTable(spark, f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}")
    for sequence in (0, 2, 1, 3):
        table.append(rows.where(F.col("part") == sequence), sequence)
        if sequence == 1:
            table.compact()
    return _shape(table.read(), "value")


SNAPSHOT_SQL = f"""with r as (select date_trunc('day', ts)::timestamp as time, user_id::varchar as code, event_type as factor, event_id % 4 as part, max(value) as value from events group by all)
select time, code, factor, {_r('arg_max(value, part)', 'value')} from r group by time, code, factor"""


def core_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to the long table in three sequences, out of order, read back and written as a result."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time"), F.col("user_id").cast("string").alias("code"), F.col("event_type").alias("factor"), (F.col("event_id") % 3).alias("part")).agg(F.max("value").alias("value"))
    folder = f"{shared_folder(spark)}/core-{uuid.uuid4().hex}"
    table = CoreTable(spark, f"{folder}/table")
    for sequence in (2, 0, 1):
        table.append(rows.where(F.col("part") == sequence), sequence)
    write_result(_shape(table.read(), "value"), f"{folder}/result")
    return spark.read.parquet(f"{folder}/result")


CORE_SQL = f"""with r as (select date_trunc('day', ts)::timestamp as time, user_id::varchar as code, event_type as factor, event_id % 3 as part, max(value) as value from events group by all)
select time, code, factor, {_r('arg_max(value, part)', 'value')} from r group by time, code, factor"""


def codes_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the codes that a query of their own names: those of two exchanges that were high once."""
    panel = section_panel(spark, sf_dir)
    panel = panel.select("time", F.concat("code", F.get(F.array(F.lit(".SH"), F.lit(".SZ"), F.lit(".XX")), (F.col("code").cast("long") % 3).cast("int"))).alias("code"), "c")
    high = SPAN | {"factors": ["c"], "derivatives": {"high": node("DIRECT", "binary.gt", {"left": "c", "right": 120.0})}, "filters": ["high"]}
    mean = SPAN | {"factors": ["c"], "derivatives": {"mean": node("TS", "unary.rolling_mean", {"col": "c"}, {"window": 3, "min_periods": 1})}}
    return _shape(execute_query(mean, panel=panel, codes_query=high).data, "c", "mean")


CODES_SQL = f"""with {SECTION_SQL}, p as (select time, code || ['.SH', '.SZ', '.XX'][(code::bigint % 3 + 1)::int] as code, c from panel)
select time, code, {_r('c', 'c')}, {_r('avg(c) over (partition by code order by time rows between 2 preceding and current row)', 'mean')} from p where code in (select code from p where c > 120.0) and not ends_with(code, '.XX')"""


def first_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that were news when they came: announced with delays that let later periods overtake earlier ones."""
    late = F.date_add(F.to_date("end_date", "yyyyMMdd"), (F.conv(F.substring(F.md5(F.concat("ts_code", "end_date")), 1, 4), 16, 10).cast("int") % 7 * 40).cast("int"))
    reports = _reports(spark, sf_dir).withColumn("f_ann_date", F.date_format(late, "yyyyMMdd"))
    return _shape(workers.first_reports(reports), "rev").select("ts_code", "end_date", "f_ann_date", "rev")


NEWS_SQL = f"""with q as (select o_custkey::varchar as ts_code, date_trunc('quarter', o_orderdate) as t, round(sum(o_totalprice), 2) as rev from orders group by 1, 2),
d as (select ts_code, last_day(t + interval 2 month) as e, strftime(last_day(t + interval 2 month), '%Y%m%d') as end_date, rev from q),
a as (select ts_code, end_date, strftime(e + (('0x' || substr(md5(ts_code || end_date), 1, 4))::int % 7 * 40)::int, '%Y%m%d') as f_ann_date, rev from d),
n as (select *, max(end_date) over (partition by ts_code order by f_ann_date, end_date rows between unbounded preceding and 1 preceding) as before from a)
select ts_code, end_date, f_ann_date, {_r('rev', 'rev')} from n where before is null or end_date > before qualify row_number() over (partition by ts_code, f_ann_date order by end_date desc) = 1"""


def dimension_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of a dimension: of equal keys in a batch the last by all columns stays."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice", "o_orderpriority", (F.col("o_orderkey") % 2).alias("batch"))
    path = f"{shared_folder(spark)}/dimension-{uuid.uuid4().hex}"
    for batch in (0, 1):
        append_dimension(orders.where(F.col("batch") == batch), path, ["o_custkey", "y"], ["o_custkey", "o_totalprice"])
    return _shape(spark.read.parquet(path), "o_totalprice")


DIMENSION_SQL = f"""select o_custkey, year(o_orderdate)::int as y, {_r('o_totalprice', 'o_totalprice')}, o_orderpriority, o_orderkey % 2 as batch from orders qualify row_number() over (partition by o_custkey, year(o_orderdate), o_orderkey % 2 order by o_totalprice desc, o_orderpriority desc) = 1"""


QUERIES = {
    "panel_source": panel_source,
    "factor_ic": factor_ic,
    "factor_groups": factor_groups,
    "factor_analysis": factor_analysis,
    "backtest_messages": backtest_messages,
    "backtest": backtest,
    "sensitivity": sensitivity,
    "optimization": optimization,
    "financial_flows": financial_flows,
    "latest_rows": latest_rows,
    "melted": melted,
    "snapshot_table": snapshot_table,
    "core_table": core_table,
    "codes_subquery": codes_subquery,
    "first_reports": first_reports,
    "dimension_rows": dimension_rows,
}
SQL = {"panel_source": PANEL_SQL, "factor_ic": IC_SQL, "factor_groups": GROUPS_SQL, "factor_analysis": ANALYSIS_SQL, "backtest_messages": MESSAGES_SQL, "financial_flows": FLOWS_SQL, "latest_rows": LATEST_SQL, "melted": MELTED_SQL, "snapshot_table": SNAPSHOT_SQL, "core_table": CORE_SQL, "codes_subquery": CODES_SQL, "first_reports": NEWS_SQL, "dimension_rows": DIMENSION_SQL}
