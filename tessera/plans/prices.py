"""Price series: lineitems as prices of a brand at a supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.functions.numbers import acre_to_hectare, exact_sum, half_up, hectogram_to_kilogram, percent, quintal_to_tonne
from tessera.operators import market
from tessera.plans.registry import query
from tessera.session import table

ORDER = ["price_date", "modal", "l_orderkey", "l_linenumber"]
PRICES = """prices as (
  select p_brand commodity, s_name market, n_name state, cast(l_shipdate as date) price_date, l_extendedprice / l_quantity modal,
         l_extendedprice / l_quantity * (1 - l_discount) low, l_extendedprice / l_quantity * (1 + l_tax) high, l_orderkey, l_linenumber
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey)"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Facts joined with their dimensions; Spark broadcasts what is small enough by its statistics."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("commodity"))
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("market"), "s_nationkey")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("state"))
    modal = F.col("l_extendedprice") / F.col("l_quantity")
    items = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("price_date"), modal.alias("modal"), (modal * (1 - F.col("l_discount"))).alias("low"), (modal * (1 + F.col("l_tax"))).alias("high"))
    joined = items.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier.join(F.broadcast(nation), "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("commodity", "market", "state", "price_date", "modal", "low", "high", "l_orderkey", "l_linenumber")


@query("price_trend", f"""with {PRICES}
select commodity, market, count(*) n_days, floor((cast(sum(cast(floor(modal * 10000 + 0.5) as hugeint)) as double) / 10000) / count(*) * 100 + 0.5) / 100 avg_modal,
  floor(min(low) * 100 + 0.5) / 100 min_price, floor(max(high) * 100 + 0.5) / 100 max_price, floor((max(high) - min(low)) * 100 + 0.5) / 100 price_range,
  floor(arg_max(modal, (price_date, modal, l_orderkey, l_linenumber)) * 100 + 0.5) / 100 latest_modal, max(price_date) latest_date
from prices group by all""")
def price_trend(spark, d):
    return market.price_trend(prices(spark, d), ["commodity", "market"], "modal", "low", "high", ORDER)


STATS = """select {k}, count(*) n, floor(arg_max(modal, (price_date, modal, l_orderkey, l_linenumber)) * 100 + 0.5) / 100 latest,
  floor((cast(sum(cast(floor(modal * 10000 + 0.5) as hugeint)) as double) / 10000) / count(*) * 100 + 0.5) / 100 mean, floor(min(modal) * 100 + 0.5) / 100 "min", floor(max(modal) * 100 + 0.5) / 100 "max",
  floor((max(modal) - min(modal)) / ((cast(sum(cast(floor(modal * 10000 + 0.5) as hugeint)) as double) / 10000) / count(*)) * 100.0 * 10 + 0.5) / 10 spread_pct,
  floor(sqrt(greatest((cast(sum(cast(floor(modal * modal * 10000 + 0.5) as hugeint)) as double) / 10000) / count(*) - power((cast(sum(cast(floor(modal * 10000 + 0.5) as hugeint)) as double) / 10000) / count(*), 2), 0)) / ((cast(sum(cast(floor(modal * 10000 + 0.5) as hugeint)) as double) / 10000) / count(*)) * 100.0 * 10 + 0.5) / 10 volatility_pct,
  case when count(*) < 2 then 'flat' when arg_max(modal, (price_date, modal, l_orderkey, l_linenumber)) / arg_min(modal, (price_date, modal, l_orderkey, l_linenumber)) - 1 > 0.01 then 'rising'
       when arg_max(modal, (price_date, modal, l_orderkey, l_linenumber)) / arg_min(modal, (price_date, modal, l_orderkey, l_linenumber)) - 1 < -0.01 then 'falling' else 'flat' end trend,
  max(price_date) latest_date from prices"""


@query("price_stats", f"with {PRICES} {STATS.format(k='commodity, market')} group by commodity, market")
def price_stats(spark, d):
    return market.price_stats(prices(spark, d), ["commodity", "market"], "modal", ORDER)


@query("robust_price_stats", f"""with {PRICES}, m as (select commodity, market, median(modal) med, count(*) n from prices where modal > 0 group by all having count(*) >= 3)
select commodity, market, n, floor(med * 100 + 0.5) / 100 median, floor(median(abs(modal - med)) * 100 + 0.5) / 100 mad from prices join m using (commodity, market) where modal > 0 group by commodity, market, n, med""")
def robust_price_stats(spark, d):
    out = market.robust_stats(prices(spark, d), ["commodity", "market"], "modal")
    return out.select("commodity", "market", "n", half_up(F.col("median"), 2).alias("median"), half_up(F.col("mad"), 2).alias("mad"))


@query("price_outliers", f"""with {PRICES}, m as (select state, commodity, median(modal) med, count(*) n from prices where modal > 0 group by all having count(*) >= 3),
s as (select state, commodity, med, median(abs(modal - med)) mad from prices join m using (state, commodity) where modal > 0 group by state, commodity, med)
select state, commodity, market, l_orderkey, l_linenumber, floor(modal * 100 + 0.5) / 100 modal from prices join s using (state, commodity) where mad > 0 and abs(modal - med) / mad > 1.9""")
def price_outliers(spark, d):
    p = prices(spark, d)
    keys = ["state", "commodity"]
    return market.outliers(p, market.robust_stats(p, keys, "modal"), keys, "modal", 1.9).select(*keys, "market", "l_orderkey", "l_linenumber", half_up(F.col("modal"), 2).alias("modal"))


@query("latest_price_per_market", f"""with {PRICES} select commodity, market, price_date, floor(modal * 100 + 0.5) / 100 modal from prices
qualify row_number() over (partition by commodity, market order by price_date desc, modal desc, l_orderkey desc, l_linenumber desc) = 1""")
def latest_price_per_market(spark, d):
    out = market.latest_per_key(prices(spark, d), ["commodity", "market"], [F.desc(c) for c in ORDER])
    return out.select("commodity", "market", "price_date", half_up(F.col("modal"), 2).alias("modal"))


@query("day_over_day", """with t as (select o_orderstatus status, cast(o_orderdate as date) as d, cast(sum(cast(o_totalprice as decimal(28,2))) as double) total from orders group by all)
select status, d, total, lag(total) over w prev_price, floor((total - lag(total) over w) / nullif(lag(total) over w, 0) * 100.0 * 10 + 0.5) / 10 change_pct from t window w as (partition by status order by d)""")
def day_over_day(spark, d):
    daily = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("d")).agg(exact_sum(F.col("o_totalprice"), 2).cast("double").alias("total"))
    return market.day_over_day(daily, ["status"], [F.col("d")], "total")


@query("support_price_labels", """with p as (select p_partkey, p_retailprice price, avg(cast(p_retailprice as decimal(18,2))) over (partition by p_brand) f from part),
q as (select p_partkey, floor((price - f) / nullif(f, 0) * 100.0 * 10 + 0.5) / 10 floor_pct from p)
select p_partkey, floor_pct, case when floor_pct > 0.5 then 'above' when floor_pct < -0.5 then 'below' when floor_pct is null then 'unknown' else 'at' end floor_label from q""")
def support_price_labels(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("price"))
    means = parts.groupBy("p_brand").agg((exact_sum(F.col("price"), 2).cast("double") / F.count("*")).alias("f"))
    return market.against_floor(parts.join(means, "p_brand"), "price", "f").select("p_partkey", "floor_pct", "floor_label")


@query("market_advisory", f"""with {PRICES}, s as ({STATS.format(k='commodity, market')} where lower(commodity) = 'brand#12' group by commodity, market)
select *, case when month(latest_date) in (10, 11, 12) then 'harvest' when month(latest_date) in (8, 9) then 'lean' else 'transition' end season_signal from s""")
def market_advisory(spark, d):
    """The stats of one commodity at every market, with the season's signal for a harvest from October to December."""
    own = market.of_commodity(prices(spark, d), "brand#12", ["commodity"])
    stats = market.price_stats(own, ["commodity", "market"], "modal", ORDER)
    return market.with_signal(stats, F.month("latest_date"), dates.months(F.lit(10), F.lit(12)))


@query("list_markets", f"with {PRICES} select market, state, count(distinct commodity) commodities, count(*) n from prices group by all")
def list_markets(spark, d):
    return prices(spark, d).groupBy("market", "state").agg(F.countDistinct("commodity").alias("commodities"), F.count("*").alias("n"))


@query("district_view", f"""with {PRICES}, p as (select *, state = 'no such state' hit from prices), f as (select * from p where hit or not (select coalesce(bool_or(hit), false) from p)),
l as (select * from f qualify row_number() over (partition by state, commodity order by price_date desc, modal desc, l_orderkey desc, l_linenumber desc) = 1)
select state, commodity, market, price_date, floor(modal * 100 + 0.5) / 100 modal, floor((modal - low) / nullif(low, 0) * 100.0 * 10 + 0.5) / 10 over_low_pct from l""")
def district_view(spark, d):
    """The latest price of each commodity by state; a filter that nothing meets is let go."""
    pool = market.soft_filter(prices(spark, d), F.col("state") == "no such state")
    last = market.latest_per_key(pool, ["state", "commodity"], [F.desc(c) for c in ORDER])
    return last.select("state", "commodity", "market", "price_date", half_up(F.col("modal"), 2).alias("modal"), percent(F.col("modal"), F.col("low")).alias("over_low_pct"))


@query("guarded_ratio", """select l_returnflag, year(l_shipdate) y, case when sum(cast(l_quantity as decimal(28,2))) > 0 then floor(cast(sum(cast(l_extendedprice as decimal(28,2))) as double) / cast(sum(cast(l_quantity as decimal(28,2))) as double) * 10000 + 0.5) / 10000 end per_unit from lineitem group by all""")
def guarded_ratio(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("y")).agg(exact_sum(F.col("l_extendedprice"), 2).cast("double").alias("a"), exact_sum(F.col("l_quantity"), 2).cast("double").alias("b"))
    return t.select("l_returnflag", "y", F.when(F.col("b") > 0, half_up(F.col("a") / F.col("b"), 4)).alias("per_unit"))


@query("production_pivot", """select c_mktsegment segment, year(o_orderdate) y, cast(sum(case when o_orderstatus = 'F' then cast(o_totalprice as decimal(28,2)) end) as double) f, cast(sum(case when o_orderstatus = 'O' then cast(o_totalprice as decimal(28,2)) end) as double) o,
cast(sum(case when o_orderstatus = 'P' then cast(o_totalprice as decimal(28,2)) end) as double) p from orders join customer on c_custkey = o_custkey group by all""")
def production_pivot(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    o = table(spark, d, "orders").join(c, "o_custkey")
    out = o.groupBy("segment", F.year("o_orderdate").alias("y")).pivot("o_orderstatus", ["F", "O", "P"]).agg(exact_sum(F.col("o_totalprice"), 2).cast("double"))
    return out.select("segment", "y", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("unit_conversions", """select p_partkey, floor(p_retailprice * 10.0 * 100 + 0.5) / 100 per_tonne, floor(p_size / 10.0 * 1000 + 0.5) / 1000 kg_ha, floor(p_size / 2.471053814671653::double * 10000 + 0.5) / 10000 hectares from part""")
def unit_conversions(spark, d):
    return table(spark, d, "part").select("p_partkey", quintal_to_tonne(F.col("p_retailprice")).alias("per_tonne"), hectogram_to_kilogram(F.col("p_size").cast("double")).alias("kg_ha"), acre_to_hectare(F.col("p_size").cast("double")).alias("hectares"))


@query("months_under_way", """with w as (select l_orderkey, l_linenumber, l_partkey, month(o_orderdate) s, month(l_shipdate) e from lineitem join orders on o_orderkey = l_orderkey)
select s, e, m, count(*) n from (select s, e, unnest(list_transform(range(0, (e - s + 12) % 12 + 1), lambda i: (s - 1 + i) % 12 + 1)) m from w) group by all""")
def months_under_way(spark, d):
    """Months from order to shipment, past December if need be. Pairs are counted first: 144 at most are expanded."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.month("o_orderdate").alias("s"))
    pairs = table(spark, d, "lineitem").join(o, "l_orderkey").groupBy("s", F.month("l_shipdate").alias("e")).agg(F.count("*").alias("n"))
    return pairs.select("s", "e", F.explode(dates.months(F.col("s"), F.col("e"))).alias("m"), "n").select("s", "e", F.col("m").cast("long").alias("m"), "n")


@query("season_signals", """select o_orderkey, case when month(o_orderdate) in (12, 1, 2) then 'harvest' when month(o_orderdate) in (10, 11) then 'lean' else 'transition' end signal,
case when month(o_orderdate) in (6, 7) then 'on' when month(o_orderdate) in (4, 5, 8, 9) then 'near' else 'off' end risk from orders""")
def season_signals(spark, d):
    m = F.month("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", dates.harvest_signal(m, dates.months(F.lit(12), F.lit(2))).alias("signal"), dates.sow_risk(m, F.array(F.lit(6), F.lit(7))).alias("risk"))


@query("partition_counts", """select 'dt=' || strftime(o_orderdate, '%Y-%m-%d') dt, count(*) n from orders group by all""")
def partition_counts(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").groupBy(F.concat(F.lit("dt="), F.when(day.rlike(r"^\d{4}-\d\d-\d\d"), day).otherwise("unknown")).alias("dt")).agg(F.count("*").alias("n"))


@query("requirement_plan", """with r as (select p_partkey id, p_size + 0.0 n, p_size * 0.5 p, p_size * 0.25 k from part),
u as (select id, form, v from r unpivot (v for form in (n, p, k)))
select id, upper(form) form, t timing, floor(v * s * 100 + 0.5) / 100 kg from u cross join (values ('basal', 0.5::double), ('vegetative', 0.3::double), ('reproductive', 0.2::double)) x(t, s)""")
def requirement_plan(spark, d):
    """Needs of three forms per row, made long, and dealt over timings."""
    from tessera.operators import advisory

    p = table(spark, d, "part")
    s = F.col("p_size").cast("double")
    wide = p.select(F.col("p_partkey").alias("id"), s.alias("N"), (s * 0.5).alias("P"), (s * 0.25).alias("K"))
    long = wide.unpivot(["id"], ["N", "P", "K"], "form", "v").withColumns({"a": F.lit(0.5), "b": F.lit(0.3), "c": F.lit(0.2)})
    return advisory.by_timing(long, ["id", "form"], "v", {"basal": "a", "vegetative": "b", "reproductive": "c"})


@query("nutrient_doses", """select p_partkey, floor(p_size * 0.5 / 0.46 * 10 + 0.5) / 10 dap, floor(greatest(p_size - 0.18 * (p_size * 0.5 / 0.46), 0) / 0.46 * 10 + 0.5) / 10 urea, floor(p_size * 0.25 / 0.6 * 10 + 0.5) / 10 mop
from (select p_partkey, p_size::double p_size from part)""".replace("0.46", "0.46::double").replace("0.5 /", "0.5::double /").replace("0.18", "0.18::double").replace("0.6 ", "0.6::double ").replace("0.25", "0.25::double"))
def nutrient_doses(spark, d):
    from tessera.operators import advisory

    s = F.col("p_size").cast("double")
    need = table(spark, d, "part").select("p_partkey", s.alias("n"), (s * 0.5).alias("p"), (s * 0.25).alias("k"))
    return advisory.doses(need, "n", "p", "k").select("p_partkey", "dap", "urea", "mop")


@query("calendar_windows", """with c as (select n_nationkey k, n_nationkey % 12 + 1 s, (n_nationkey + 2) % 12 + 1 e, 'sowing' st from nation union all select n_nationkey, (n_nationkey + 5) % 12 + 1, (n_nationkey + 6) % 12 + 1, 'harvest' from nation),
x as (select k, st, unnest(list_transform(range(0, (e - s + 12) % 12 + 1), lambda i: (s - 1 + i) % 12 + 1)) m from c)
select k, count(distinct m) duration, list(distinct (m - 6 + 12) % 12) filter (st = 'sowing') is not null has_sow, string_agg(distinct case when st = 'harvest' then lpad(m::varchar, 2, '0') end, ',' order by case when st = 'harvest' then lpad(m::varchar, 2, '0') end) harvest from x group by k""")
def calendar_windows(spark, d):
    from tessera.operators import advisory

    k = F.col("n_nationkey")
    n = table(spark, d, "nation")
    one = n.select(k.alias("k"), (k % 12 + 1).alias("s"), ((k + 2) % 12 + 1).alias("e"), F.lit("sowing").alias("st"))
    two = n.select(k.alias("k"), ((k + 5) % 12 + 1).alias("s"), ((k + 6) % 12 + 1).alias("e"), F.lit("harvest").alias("st"))
    out = advisory.windows(one.union(two), ["k"], "s", "e", "st")
    return out.select("k", "duration", (F.size("sow") > 0).alias("has_sow"), F.concat_ws(",", F.array_sort(F.transform("harvest", lambda m: F.lpad(m.cast("string"), 2, "0")))).alias("harvest"))
