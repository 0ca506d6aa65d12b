"""Deduplication, rules, contracts, resolution, joins, gaps and upserts, bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.functions import text as T
from tessera.functions.numbers import exact_sum, half_up
from tessera.operators import contracts, dedupe, gaps, market, percentiles, quality, resolve
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import tables
from tessera.sources.shared import if_small


@query("dedupe_three_way", """with r as (select l_orderkey k, l_linenumber l, l_partkey p, l_suppkey s, l_partkey || '/' || l_suppkey h from lineitem),
x as (select *, row_number() over w n, first_value(h) over w f from r window w as (partition by k, l order by p, s rows between unbounded preceding and unbounded following))
select k, case when n = 1 then 'unique' when h = f then 'duplicate' else 'conflict' end kind, count(*) n from x group by all""")
def dedupe_three_way(spark, d):
    """Line items by (order, line): the first is unique, the others repeat it or are at odds with it."""
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    r = r.withColumn("h", F.concat_ws("/", "p", "s"))
    return dedupe.split_three(r, ["k", "l"], "h", ["p", "s"]).groupBy("k", "kind").agg(F.count("*").alias("n"))


@query("key_conflicts", """select l_orderkey, l_linenumber, count(*) n_rows, count(distinct l_partkey || '/' || l_suppkey) n_contents from lineitem group by all having n_contents > 1""")
def key_conflicts(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("/", "l_partkey", "l_suppkey").alias("h"))
    return dedupe.key_conflicts(r, ["l_orderkey", "l_linenumber"], "h")


@query("repeated_texts", """select sha256(text) h, count(*) n, min(doc_id) first_id from documents group by all having count(*) > 1""")
def repeated_texts(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return t.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("first_order_per_customer", """select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1""")
def first_order_per_customer(spark, d):
    return dedupe.first_per_key(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("vendor_quorum", """select l_partkey, count(distinct l_suppkey) vendors, count(distinct l_returnflag) contents, count(distinct l_suppkey) >= 2 and count(distinct l_returnflag) = 1 agreed from lineitem group by all""")
def vendor_quorum(spark, d):
    return dedupe.quorum(table(spark, d, "lineitem"), ["l_partkey"], "l_suppkey", "l_returnflag", 2)


def _judged(spark, d):
    """Line items under rules for required fields, order of prices, ranges and dates."""
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("low"), F.col("l_extendedprice").alias("modal"), (F.col("l_extendedprice") * (1 - F.col("l_tax"))).alias("high"))
    return quality.judge(r, [
        quality.required("l_returnflag"),
        quality.price_triangle("low", "modal", "high"),
        quality.within("DQ-RANGE-QTY", "WARN", "l_quantity", 2, 49),
        quality.not_future("day", F.col("day"), F.lit("2001-06-30").cast("date")),
        quality.Rule("DQ-RETURNED", "BLOCK", "l_returnflag", (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09), "returned at a discount", None, "reject"),
    ])


JUDGED = """j as (select *, coalesce(trim(l_returnflag) = '' or l_returnflag is null, false) b1, (l_extendedprice * (1 - l_discount) <= 0 or l_extendedprice <= 0 or l_extendedprice * (1 - l_tax) <= 0) or l_extendedprice * (1 - l_discount) > l_extendedprice or l_extendedprice > l_extendedprice * (1 - l_tax) or l_extendedprice * (1 - l_discount) > l_extendedprice * (1 - l_tax) b2,
 l_quantity < 2 or l_quantity > 49 w1, cast(l_shipdate as date) > date '2001-07-01' b3, l_returnflag = 'R' and l_discount > 0.09::double r1 from lineitem),
k as (select *, case when r1 then 'REJECT' when b1 or b2 or b3 then 'QUARANTINE' else 'PASS' end status from j)"""


@query("row_quality", f"with {JUDGED} select l_returnflag, status, count(*) n from k group by all")
def row_quality(spark, d):
    return _judged(spark, d).groupBy("l_returnflag", "status").agg(F.count("*").alias("n"))


@query("rule_counts", f"""with {JUDGED}, u as (select 'DQ-SCHEMA-CONFORM' rule_id, 'BLOCK' severity, count_if(b1)::bigint n from k union all select 'DQ-PRICE-TRIANGLE', 'BLOCK', count_if(b2)::bigint from k union all select 'DQ-RANGE-QTY', 'WARN', count_if(w1)::bigint from k
union all select 'DQ-DATE-NOT-FUTURE', 'BLOCK', count_if(b3)::bigint from k union all select 'DQ-RETURNED', 'BLOCK', count_if(r1)::bigint from k) select * from u where n > 0""")
def rule_counts(spark, d):
    return quality.rule_counts(_judged(spark, d))


@query("scorecard", f"""with {JUDGED}, s as (select count(*) n_rows, count_if(status = 'PASS')::bigint passed, count_if(status = 'QUARANTINE')::bigint quarantined, count_if(status = 'REJECT')::bigint rejected, sum(b1::int + b2::int + b3::int + r1::int)::bigint block_count, count_if(w1 and status = 'PASS')::bigint warned from k)
select *, floor(warned / n_rows * 10000 + 0.5) / 10000 warn_rate, block_count = 0 and floor(warned / n_rows * 10000 + 0.5) / 10000 <= 0.02 promoted from s""")
def scorecard(spark, d):
    return quality.gate(quality.scorecard(_judged(spark, d)))


@query("key_rule", """with r as (select l_orderkey o, l_linenumber l, l_partkey || '/' || l_suppkey h from lineitem), w as (select *, min(h) over (partition by o, l) <> max(h) over (partition by o, l) b from r)
select case when b then 'QUARANTINE' else 'PASS' end status, count(*) n from w group by all""")
def key_rule(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("/", "l_partkey", "l_suppkey").alias("h"))
    return quality.unique_key(quality.judge(r, []), ["l_orderkey", "l_linenumber"], "h").groupBy("status").agg(F.count("*").alias("n"))


@query("contract_problems", """select o_orderkey, array_to_string(list_filter([case when o_orderstatus not in ('F', 'O') then 'o_orderstatus: not allowed' end, case when o_totalprice > 400000 then 'o_totalprice: above 400000' end, case when o_orderpriority is null or trim(o_orderpriority) = '' then 'o_orderpriority: required' end], lambda x: x is not null), '; ') problems
from orders where not (o_orderstatus in ('F', 'O') and o_totalprice <= 400000 and o_orderpriority is not null)""")
def contract_problems(spark, d):
    c = contracts.Contract("orders", (contracts.Field("o_orderstatus", one_of=("F", "O")), contracts.Field("o_totalprice", "float", high=400000), contracts.Field("o_orderpriority", required=True)))
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("; ", c.problems()).alias("problems")).where("problems <> ''")


@query("contract_drift", """with d(field, type, filterable) as (values ('o_orderkey', 'bigint', true), ('o_custkey', 'keyword', true), ('o_clerk', 'text', false), ('o_orderstatus', 'text', true), ('o_totalprice', 'double', true)),
f as (select column_name field, data_type type, ordinal_position <= 3 filterable from information_schema.columns where table_name = 'orders'), n as (select unnest(['VARCHAR', 'DOUBLE', 'BIGINT', 'TIMESTAMP']) t, unnest(['str', 'float', 'int', 'datetime']) m),
x as (select d.field, case when d.type in ('keyword', 'text') then 'str' when d.type = 'double' then 'float' when d.type = 'bigint' then 'int' end type, filterable from d), y as (select field, coalesce(m, type) type, filterable from f left join n on t = type)
select coalesce(x.field, y.field) field, case when x.field is null then 'added' when y.field is null then 'removed' when x.type <> y.type then 'type_changed' when x.filterable and not y.filterable then 'no_longer_filterable' end change from x full outer join y on x.field = y.field where change is not null""")
def contract_drift(spark, d):
    """A declared contract against the table's own schema, of which the first three columns can be filtered by."""
    declared = spark.createDataFrame([("o_orderkey", "bigint", True), ("o_custkey", "keyword", True), ("o_clerk", "text", False), ("o_orderstatus", "text", True), ("o_totalprice", "double", True)], "field string, type string, filterable boolean")
    fields = table(spark, d, "orders").schema.fields
    found = spark.createDataFrame([(f.name, f.dataType.simpleString(), i < 3) for i, f in enumerate(fields)], "field string, type string, filterable boolean")
    return contracts.drift(declared, found)


@query("volume_verdicts", """with c as (select event_type, cast(ts as date) d, count(*) n from events group by all), h as (select event_type, list(n order by n) a, arg_max(n, d) last from c group by all),
m as (select event_type, last, len(a) k, a[(len(a) // 2) + 1] mid, list_sort(list_transform(a, lambda x: abs(x - a[(len(a) // 2) + 1]))) dev from h)
select event_type, last, case when k < 5 then 'ok' when abs(last - mid) > 6 * case when dev[(k // 2) + 1] = 0 then 1 else dev[(k // 2) + 1] end then 'BLOCK' else 'ok' end verdict from m""")
def volume_verdicts(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    runs = daily.groupBy("event_type").agg(F.collect_list("n").alias("history"), F.max_by("n", "d").alias("last"))
    return runs.select("event_type", "last", quality.volume_verdict(F.col("last"), F.col("history")).alias("verdict"))


@query("freshness_scores", """select o_orderkey, case when o_orderdate is null then 0.5 when a < 0 then 0.9 when a <= 365 then 0.95 when a <= 1095 then 0.8 when a <= 3650 then 0.6 else 0.4 end::double score from (select *, date '2000-01-01' - cast(o_orderdate as date) a from orders)""")
def freshness_scores(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.freshness(F.to_date("o_orderdate"), F.lit("2000-01-01").cast("date")).alias("score"))


#: By segment: who says so, and under which licence.
SAYS = {"AUTOMOBILE": ("government", "GODL-India"), "BUILDING": ("Peer-reviewed research", "CC-BY 4.0"), "FURNITURE": ("blog", "open"), "HOUSEHOLD": ("someone", None), "MACHINERY": ("Farmer anecdote", "All-Rights-Reserved")}
AUTHORITY_SQL = " ".join(f"when c_mktsegment = '{k}' then {v}" for k, v in {"AUTOMOBILE": 1.0, "BUILDING": 0.95, "FURNITURE": 0.5, "HOUSEHOLD": 0.35, "MACHINERY": 0.35}.items())
LICENCE_SQL = " ".join(f"when c_mktsegment = '{k}' then {v}" for k, v in {"AUTOMOBILE": 1.0, "BUILDING": 0.9, "FURNITURE": 0.8, "HOUSEHOLD": 0.3, "MACHINERY": 0.1}.items())


@query("quality_scores", f"""with r as (select *, date '2026-01-01' - cast(c_custkey * 3 as int) published from customer), a as (select *, date '2026-01-01' - published age from r)
select c_custkey, floor((0.30 * case {AUTHORITY_SQL} else 0.35 end + 0.15 * case when age < 0 then 0.9 when age <= 365 then 0.95 when age <= 1095 then 0.8 when age <= 3650 then 0.6 else 0.4 end + 0.15 * (1 + case when c_mktsegment <> 'HOUSEHOLD' then 1 else 0 end + 1) / 3
+ 0.10 * case when c_nationkey > 4 then 1 else 0 end + 0.10 * case when c_acctbal > 0 then 1 else 0 end + 0.10 * 1 + 0.05 * case when c_acctbal > 5000 then 1 else 0 end + 0.05 * case {LICENCE_SQL} else 0.3 end)::double * 10000 + 0.5) / 10000 score from a""")
def quality_scores(spark, d):
    said = lambda n: F.create_map(*[F.lit(x) for k, v in SAYS.items() for x in (k, v[n] or "")])[F.col("c_mktsegment")]
    licence = F.nullif(said(1), F.lit(""))
    day = F.date_sub(F.lit("2026-01-01").cast("date"), (F.col("c_custkey") * 3).cast("int"))
    signals = quality.quality_signals(
        authority=said(0), published=day, today=F.lit("2026-01-01").cast("date"), required=[F.col("c_name"), licence, day], location=[F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")), F.lit("")],
        crop=[F.when(F.col("c_acctbal") > 0, F.lit("x"))], evidence=[F.col("c_name")], verified=F.col("c_acctbal") > 5000, licence=licence,
    )
    return table(spark, d, "customer").select("c_custkey", quality.quality_score(signals).alias("score"))


@query("resolved_nations", """with s as (select c_custkey, c_custkey % 4 kind, n_nationkey, case c_custkey % 4 when 0 then ' ' || lower(n_name) || ' ' when 1 then 'alias ' || n_nationkey when 2 then 'the land of ' || n_name || ' (old)' else 'nowhere' end x from customer join nation on n_nationkey = c_nationkey),
k as (select trim(regexp_replace(lower(n_name), '[^a-z0-9_]+', ' ', 'g')) k, n_name target, 1 p, n_nationkey o from nation union all select 'alias ' || n_nationkey, n_name, 2, 100 + n_nationkey from nation),
m as (select distinct x, trim(regexp_replace(lower(x), '[^a-z0-9_]+', ' ', 'g')) m from s), e as (select m, target, 'exact' as match, p, o from m join k on k = m), f as (select * from e union all select m, target, 'part', p + 100, o from m join k on contains(m, k) or contains(k, m) where m not in (select m from e)),
b as (select m, target, match from f qualify row_number() over (partition by m order by p, o, target) = 1) select c_custkey, target, match from s join m using (x) left join b using (m)""")
def resolved_nations(spark, d):
    """Mentions as they stand, by alias, as a part of a longer text, and unknown ones."""
    n = table(spark, d, "nation")
    lookup = n.select("n_name", "n_nationkey").select(F.col("n_name").alias("key"), F.col("n_name").alias("target"), F.lit(1).alias("priority"), F.col("n_nationkey").alias("ord"))
    lookup = lookup.union(n.select(F.concat(F.lit("Alias "), "n_nationkey"), "n_name", F.lit(2), F.col("n_nationkey") + 100))
    rows = table(spark, d, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    kind = F.col("c_custkey") % 4
    said = F.when(kind == 0, F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).when(kind == 1, F.concat(F.lit("alias "), "c_nationkey")).when(kind == 2, F.concat(F.lit("the land of "), "n_name", F.lit(" (old)"))).otherwise("nowhere")
    return resolve.resolve(rows.withColumn("said", said), "said", lookup).select("c_custkey", "target", "match")


@query("part_mentions", """with w as (values ('almond'), ('antique'), ('blue'), ('steel'), ('copper'), ('green')), t as (select col0 t from w)
select p_partkey, t target from part, t where list_contains(string_split_regex(lower(p_name), '[^a-z0-9_]+'), t)""")
def part_mentions(spark, d):
    names = spark.createDataFrame([(w, w) for w in ("almond", "antique", "blue", "steel", "copper", "green")], "name string, target string")
    return resolve.mentions(table(spark, d, "part"), "p_partkey", "p_name", names)


@query("calendar_overlay", """with b as (select n_nationkey k, n_nationkey % 12 + 1 m from nation), s as (select n_nationkey k, 6 m from nation where n_regionkey = 1), t as (select n_nationkey k, 9 m from nation where n_nationkey % 5 = 0)
select k, coalesce((select m from t where t.k = b.k), (select m from s where s.k = b.k), m) as month_start from b""")
def calendar_overlay(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    base = n.select(k.alias("k"), (k % 12 + 1).alias("month_start"), F.lit(0).alias("ord"))
    state = n.where("n_regionkey = 1").select(k.alias("k"), F.lit(6).alias("month_start"), F.lit(1).alias("ord"), F.lit("state").alias("level"))
    district = n.where("n_nationkey % 5 = 0").select(k.alias("k"), F.lit(9).alias("month_start"), F.lit(2).alias("ord"), F.lit("district").alias("level"))
    return resolve.overlay(base, state.unionByName(district), ["k"]).select("k", "month_start")


@query("balance_bands", """select s_suppkey, 'balance' parameter, case when s_acctbal <= 1000 then 'low' when s_acctbal >= 6000 then 'high' else 'medium' end status from supplier""")
def balance_bands(spark, d):
    bands = spark.createDataFrame([("balance", 1000.0, 6000.0), ("size", 10.0, 40.0)], "parameter string, low_max double, high_min double")
    values = table(spark, d, "supplier").select("s_suppkey", F.lit("balance").alias("parameter"), F.col("s_acctbal").alias("v"))
    return resolve.banded(values, bands, "parameter", "v").select("s_suppkey", "parameter", "status")


@query("threshold_alerts", """select p_partkey, 'size' metric, a alert from part, (values ('>=', 45, 'large'), ('<', 3, 'small')) r(op, t, a) where case when op = '>=' then p_size >= t else p_size <= t end
union all select p_partkey, 'price', 'dear' from part where p_retailprice >= 1800""")
def threshold_alerts(spark, d):
    rules = spark.createDataFrame([("size", ">=", 45.0, "large"), ("size", "<", 3.0, "small"), ("price", ">=", 1800.0, "dear")], "metric string, op string, threshold double, alert string")
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return resolve.alerts(p.unpivot(["p_partkey"], ["size", "price"], "metric", "v"), rules, "metric", "v").select("p_partkey", "metric", "alert")


@query("need_status", """select s_suppkey, case when n_nationkey > 20 then 'unknown' when s_acctbal < 0.5 * (n_nationkey * 500) then 'deficit' when s_acctbal > 1.5 * (n_nationkey * 500) then 'excess' else 'adequate' end status from supplier join nation on n_nationkey = s_nationkey""")
def need_status(spark, d):
    need = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.when(F.col("n_nationkey") <= 20, F.col("n_nationkey") * 500.0).alias("need"))
    return table(spark, d, "supplier").join(need, "s_nationkey").select("s_suppkey", resolve.need_status(F.col("s_acctbal"), F.col("need")).alias("status"))


@query("customers_without_urgent_orders", """select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')""")
def customers_without_urgent_orders(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return gaps.uncovered(table(spark, d, "customer").select("c_custkey"), "c_custkey", urgent, "o_custkey")


@query("topics_without_documents", """with t as (select unnest(['almond', 'de:web', 'en:src0', 'fr:src1', 'es:src99']) topic) select topic from t where not exists (select 1 from (select [lang || ':' || source, lang] topics from documents) x where list_contains(topics, topic))""")
def topics_without_documents(spark, d):
    """Topics in no row's array of topics: the arrays are exploded, so membership is an equi-join."""
    topics = spark.createDataFrame([(t,) for t in ("almond", "de:web", "en:src0", "fr:src1", "es:src99")], "topic string")
    have = table(spark, d, "documents").select(F.explode(F.array(F.concat_ws(":", "lang", "source"), F.col("lang"))).alias("topic")).distinct()
    return gaps.uncovered(topics, "topic", have, "topic")


@query("customers_with_large_orders", """select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)""")
def customers_with_large_orders(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("correlated_counts", """select n_name, (select count(*) from customer where c_nationkey = n_nationkey) customers, (select count(*) from supplier where s_nationkey = n_nationkey) suppliers from nation""")
def correlated_counts(spark, d):
    n = table(spark, d, "nation")
    for t, k, out in (("customer", "c_nationkey", "customers"), ("supplier", "s_nationkey", "suppliers")):
        n = n.join(table(spark, d, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count("*").alias(out)), "n_nationkey", "left").withColumn(out, F.coalesce(out, F.lit(0)))
    return n.select("n_name", "customers", "suppliers")


@query("like_counts", """with w as (select distinct unnest(string_split(lower(p_name), ' ')) w from part) select w, (select count(*) from part p where lower(p.p_name) like '%' || w || '%') n from w""")
def like_counts(spark, d):
    """For each word that names have, how many names it is a part of: distinct words meet distinct names, and counts come back by equality."""
    p = table(spark, d, "part").select(F.lower("p_name").alias("name"))
    names = p.groupBy("name").agg(F.count("*").alias("c"))
    words = p.select(F.explode(F.split("name", " ")).alias("w")).distinct()
    return names.join(if_small(words), F.contains("name", "w")).groupBy("w").agg(F.sum("c").alias("n"))


@query("broken_references", """select 'lineitem.part' ref, count(*) n from lineitem where l_partkey not in (select p_partkey from part) union all select 'orders.customer', count(*) from orders where o_custkey not in (select c_custkey from customer)
union all select 'lineitem.order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'supplier.nation', count(*) from supplier where s_nationkey not in (select n_nationkey from nation)""")
def broken_references(spark, d):
    out = None
    for child, column, parent, key, name in (("lineitem", "l_partkey", "part", "p_partkey", "lineitem.part"), ("orders", "o_custkey", "customer", "c_custkey", "orders.customer"), ("lineitem", "l_orderkey", "orders", "o_orderkey", "lineitem.order"), ("supplier", "s_nationkey", "nation", "n_nationkey", "supplier.nation")):
        one = resolve.broken_references(table(spark, d, child).select(column), column, table(spark, d, parent), key).agg(F.lit(name).alias("ref"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("nation_labels", """select c_custkey, n_name as nation_label from customer join nation on n_nationkey = c_nationkey""")
def nation_labels(spark, d):
    return resolve.labelled(table(spark, d, "customer"), "c_nationkey", table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", "nation_label").select("c_custkey", "nation_label")


@query("order_coverage", """select count(*) wanted, count_if(c_custkey in (select o_custkey from orders))::bigint covered, floor(count_if(c_custkey in (select o_custkey from orders)) / count(*) * 1000 + 0.5) / 1000 ratio from customer""")
def order_coverage(spark, d):
    return gaps.coverage(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey")


@query("unmet_demand", """select lower(trim(props)) mention, count(*) n, array_to_string(list_sort(list(distinct event_type)), ',') sources, case when count(*) >= 60 then 'high' else 'medium' end severity from events where trim(props) <> '' group by mention order by n desc, mention limit 50""")
def unmet_demand(spark, d):
    return gaps.demand(table(spark, d, "events"), F.col("props"), F.col("event_type"), 60).withColumn("sources", F.concat_ws(",", "sources"))


@query("domain_coverage", """select domain, n, target, n < target as short from (select 'orders' domain, (select count(*) from orders) + (select count(*) from lineitem) n, 100000 target union all select 'text', (select count(*) from documents) + (select count(*) from pages), 1000 union all select 'talk', (select count(*) from conversations), 10000)""")
def domain_coverage(spark, d):
    counts = None
    for domain, name in (("orders", "orders"), ("orders", "lineitem"), ("text", "documents"), ("text", "pages"), ("talk", "conversations")):
        one = table(spark, d, name).agg(F.lit(domain).alias("domain"), F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    targets = spark.createDataFrame([("orders", 100000), ("text", 1000), ("talk", 10000)], "domain string, target int")
    return counts.groupBy("domain").agg(F.sum("n").alias("n")).join(if_small(targets), "domain").withColumn("short", F.col("n") < F.col("target"))


GAPS = """g as (select 'GAP-' || upper(left(sha256('NO_ORDERS:customer:' || c_custkey), 12)) gap_id, 'NO_ORDERS' kind, 'customer' dimension, c_custkey::varchar as key, 'medium' severity, 0::bigint demand from customer where c_custkey not in (select o_custkey from orders)
union all select 'GAP-' || upper(left(sha256('FEW_SUPPLIERS:nation:' || n_name), 12)), 'FEW_SUPPLIERS', 'nation', n_name, case when n = 0 then 'critical' else 'high' end, n from (select n_name, count(s_suppkey) n from nation left join supplier on s_nationkey = n_nationkey group by n_name) where n < 3)"""


def _gaps(spark, d):
    a = gaps.uncovered(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders"), "o_custkey")
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    b = table(spark, d, "nation").join(s, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n")).where("n < 3")
    none = gaps.as_gaps(a, "NO_ORDERS", "customer", F.col("c_custkey"), F.lit("medium"), F.lit(0))
    return none.unionByName(gaps.as_gaps(b, "FEW_SUPPLIERS", "nation", F.col("n_name"), F.when(F.col("n") == 0, "critical").otherwise("high"), F.col("n")))


@query("detected_gaps", f"with {GAPS} select * from g")
def detected_gaps(spark, d):
    return gaps.in_order(_gaps(spark, d))


@query("gap_register", f"""with {GAPS}, old as (select gap_id, severity, demand, 'closed' status, '2000-01-01' first_seen, '2000-01-01' last_seen from g where kind = 'FEW_SUPPLIERS' union all select 'GAP-GONE', 'low', 1, 'open', '2000-01-01', '2000-01-01')
select coalesce(g.gap_id, old.gap_id) gap_id, coalesce(g.severity, old.severity) severity, coalesce(g.demand, old.demand) demand, coalesce(status, 'open') status, coalesce(first_seen, '2001-01-01') first_seen, case when g.gap_id is not null then '2001-01-01' else last_seen end last_seen,
case when old.gap_id is null then 'added' when g.gap_id is not null then 'refreshed' else 'kept' end change from g full outer join old on g.gap_id = old.gap_id""")
def gap_register(spark, d):
    g = _gaps(spark, d)
    old = g.where("kind = 'FEW_SUPPLIERS'").select("gap_id", "severity", "demand", F.lit("closed").alias("status"), F.lit("2000-01-01").alias("first_seen"), F.lit("2000-01-01").alias("last_seen"))
    gone = spark.createDataFrame([("GAP-GONE", "low", 1, "open", "2000-01-01", "2000-01-01")], "gap_id string, severity string, demand long, status string, first_seen string, last_seen string")
    return gaps.refresh(old.unionByName(gone), g, F.lit("2001-01-01"))


@query("upserted_orders", """select o_orderkey, o_totalprice::double price, 'old' src from orders where o_orderkey % 3 <> 0 union all select o_orderkey, floor(o_totalprice * 2 * 100 + 0.5) / 100, 'new' from orders where o_orderkey % 3 = 0""")
def upserted_orders(spark, d):
    o = table(spark, d, "orders")
    old = o.select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit("old").alias("src"))
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", half_up(F.col("o_totalprice") * 2, 2).alias("price"), F.lit("new").alias("src"))
    return tables.upsert(old, new, ["o_orderkey"])


@query("unseen_artifacts", """select distinct sha256(text) h from documents where lang = 'en' and sha256(text) not in (select sha256(text) from documents where lang <> 'en')""")
def unseen_artifacts(spark, d):
    t = table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("h"))
    return tables.unseen(t.where("lang = 'en'").select("h"), t.where("lang <> 'en'").select("h"), "h")


@query("watermarks", """with t as (select event_type, max(cast(ts as date)::varchar) seen, case when event_type <> 'click' then '2024-01-05' end old from events group by event_type) select event_type, greatest(seen, old) mark, old is null or seen > old advanced from t""")
def watermarks(spark, d):
    e = table(spark, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    marks = spark.createDataFrame([(t, "2024-01-05") for t in ("error", "purchase", "signup", "view")], "event_type string, mark string")
    return tables.advance(marks, e, ["event_type"], "day")


@query("rows_past_marks", """select event_type, count(*) n from events where event_type = 'click' or cast(ts as date)::varchar > '2024-01-10' group by all""")
def rows_past_marks(spark, d):
    e = table(spark, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    marks = spark.createDataFrame([(t, "2024-01-10") for t in ("error", "purchase", "signup", "view")], "event_type string, mark string")
    return tables.past_marks(e, marks, ["event_type"], "day").groupBy("event_type").agg(F.count("*").alias("n"))


@query("table_metrics", " union all ".join(f"select '{t}' as tbl, count(*) n from {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")))
def table_metrics(spark, d):
    out = None
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        one = table(spark, d, t).agg(F.lit(t).alias("tbl"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("set_difference", """select c_nationkey k, 'customers only' side from customer except select s_nationkey, 'customers only' from supplier union all (select distinct n_nationkey, 'both' from nation where n_nationkey in (select c_nationkey from customer) and n_nationkey in (select s_nationkey from supplier))""")
def set_difference(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.distinct().exceptAll(s.distinct()).withColumn("side", F.lit("customers only")).unionByName(c.intersect(s).withColumn("side", F.lit("both")))


@query("revenue_by_nation", """select n_name, floor(cast(sum(cast(o_totalprice as decimal(28,2))) as double) * 100 + 0.5) / 100 revenue, count(distinct c_custkey) customers from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by all""")
def revenue_by_nation(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    return table(spark, d, "orders").join(c, "o_custkey").groupBy("n_name").agg(half_up(exact_sum(F.col("o_totalprice"), 2).cast("double"), 2).alias("revenue"), F.countDistinct("o_custkey").alias("customers"))


@query("latency_percentiles", """with r as (select event_type, list(value order by value) a from events group by all) select event_type, a[least(len(a), (len(a) // 2) + 1)] p50, a[least(len(a), cast(floor(len(a) * 0.95) as int) + 1)] p95 from r""")
def latency_percentiles(spark, d):
    """Percentiles by index over each type's values; a histogram says where they lie, so no task holds all values of a type."""
    return percentiles.percentiles(table(spark, d, "events").select("event_type", "value"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("latest_event_per_user", """select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def latest_event_per_user(spark, d):
    return market.latest_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")
