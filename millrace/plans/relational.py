"""Scans, filters, joins, aggregates, set operations and top-k over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sentinel_to_null
from ..operators import added, frontier, range_join
from .registry import registrar

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


@query("select l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem where l_quantity between 10 and 20 and l_returnflag in ('A', 'R') and l_shipdate < timestamp '1996-01-01'")
def scan_filter_project(t):
    rows = t.lineitem.filter(F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "R") & (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")))
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("select event_id, nullif(event_type, 'click') as event_type, try_cast(props as double) as number, case when value is null or value = 0 then null else round(1 / value, 6) end as inverse from events")
def null_sentinel_clean(t):
    return t.events.select("event_id", sentinel_to_null(F.col("event_type"), "click").alias("event_type"), F.col("props").try_cast("double").alias("number"), F.round(F.try_divide(F.lit(1.0), F.col("value")), 6).alias("inverse"))


@query("select case when value < 10 then 'low' when value < 100 then 'mid' else 'high' end as bucket, event_type like '%e%' as has_e, count(*) as n from events group by all")
def case_bucket(t):
    bucket = F.when(F.col("value") < 10, "low").when(F.col("value") < 100, "mid").otherwise("high")
    return t.events.groupBy(bucket.alias("bucket"), F.col("event_type").like("%e%").alias("has_e")).agg(F.count("*").alias("n"))


@query("select distinct c_mktsegment, n_name from customer join nation on c_nationkey = n_nationkey")
def distinct_segments(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name").distinct()


@query("select r_name, n_name, p_brand, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey group by all")
def join_inner_star(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("r_name", "n_name", "p_brand").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query("select d.doc_id, source, quality, coalesce(toxic, -1) as toxic from documents d left join labels l on d.doc_id = l.doc_id")
def join_left_labels(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").select("doc_id", "source", "quality", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("with c as (select c_nationkey as k, count(*) as customers from customer where c_acctbal > 5000 group by 1), s as (select s_nationkey as k, count(*) as suppliers from supplier where s_acctbal > 0 group by 1) select k, customers, suppliers from c full join s using (k)")
def join_full_nation(t):
    c = t.customer.filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = t.supplier.filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "k", "full")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def join_semi(t):
    return t.customer.join(t.orders.filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def join_anti(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("select r_name, s.seg, count(c_custkey) as n from region cross join (select distinct c_mktsegment as seg from customer) s left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey and c_mktsegment = s.seg group by all")
def join_cross_grid(t):
    grid = t.region.crossJoin(t.customer.select(F.col("c_mktsegment").alias("seg")).distinct())  # two dimensions of fixed size
    have = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_mktsegment").agg(F.count("*").alias("m"))
    return grid.join(have, (F.col("r_regionkey") == F.col("n_regionkey")) & (F.col("seg") == F.col("c_mktsegment")), "left").select("r_name", "seg", F.coalesce("m", F.lit(0)).alias("n"))


@query("with l as (select quality, count(*) as n from documents d left join labels using (doc_id) group by 1), r as (select quality, count(distinct source) as sources from documents d left join labels using (doc_id) group by 1) select l.quality, n, sources from l join r on l.quality is not distinct from r.quality")
def join_null_safe(t):
    d = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    a, b = d.groupBy("quality").agg(F.count("*").alias("n")), d.groupBy(F.col("quality").alias("q")).agg(F.count_distinct("source").alias("sources"))
    return a.join(b, F.col("quality").eqNullSafe(F.col("q"))).select("quality", "n", "sources")


@query("with w as (select event_id as w_id, user_id as r_user_id, epoch(ts)::double as s, epoch(ts)::double + 3600 as e from events where event_type = 'purchase') select w_id, event_id from w join events on user_id = r_user_id and epoch(ts)::double >= s and epoch(ts)::double < e")
def join_range_bucketed(t):
    ev = t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    w = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("w_id"), F.col("user_id").alias("r_user_id"), F.col("at").alias("s"), (F.col("at") + 3600).alias("e"))
    return range_join(ev.select("event_id", "user_id", "at"), w, "at", "s", "e", 3600, ["user_id"]).select("w_id", "event_id")


@query("select l_returnflag, l_linestatus, sum(l_quantity) as qty, round(sum(l_extendedprice), 2) as price, round(avg(l_discount), 6) as disc, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship, count(*) as n, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) as weighted from lineitem group by all")
def agg_basic(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 6).alias("disc"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 6).alias("weighted"))


@query("select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as done, count(*) filter (where o_totalprice > 150000) as large, coalesce(round(sum(o_totalprice) filter (where o_orderstatus = 'O'), 2), 0) as open_value from orders group by all")
def agg_filtered(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 150000).alias("large"), F.coalesce(F.round(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), 2), F.lit(0.0)).alias("open_value"))


@query("select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, sum(distinct l_linenumber)::bigint as lines from lineitem group by all")
def agg_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.sum_distinct(F.col("l_linenumber").cast("long")).alias("lines"))


@query("select p_brand, arg_max(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) as dearest, arg_min(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) as cheapest from part group by all")
def agg_argmax(t):
    rank = F.struct("p_retailprice", "p_partkey")
    return t.part.groupBy("p_brand").agg(F.max_by("p_partkey", rank).alias("dearest"), F.min_by("p_partkey", rank).alias("cheapest"))


@query("select p_brand, round(quantile_cont(p_retailprice, 0.25), 4) as q1, round(median(p_retailprice), 4) as mid, round(quantile_cont(p_retailprice, 0.9), 4) as p90, round(stddev_samp(p_retailprice), 4) as sd, round(var_pop(p_size), 4) as v, round(kurtosis_pop(p_size), 4) as kurt from part group by all")
def agg_percentile(t):
    return t.part.groupBy("p_brand").agg(*[F.round(F.percentile("p_retailprice", F.lit(q)), 4).alias(n) for q, n in ((0.25, "q1"), (0.5, "mid"), (0.9, "p90"))], F.round(F.stddev("p_retailprice"), 4).alias("sd"), F.round(F.var_pop("p_size"), 4).alias("v"), F.round(F.kurtosis("p_size"), 4).alias("kurt"))


def _orders_by_place(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))


_PLACE = "from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"


@query(f"select n_regionkey, n_name, grouping_id(n_regionkey, n_name)::bigint as level, count(*) as n, round(sum(o_totalprice), 2) as value {_PLACE} group by rollup (n_regionkey, n_name)")
def agg_rollup(t):
    return _orders_by_place(t).rollup("n_regionkey", "n_name").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("value"))


@query(f"select n_regionkey, c_mktsegment, o_orderstatus, count(*) as n {_PLACE} group by cube (n_regionkey, c_mktsegment, o_orderstatus)")
def agg_cube(t):
    return _orders_by_place(t).cube("n_regionkey", "c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))


@query(f"select n_name, c_mktsegment, o_orderpriority, count(*) as n {_PLACE} group by grouping sets ((n_name), (c_mktsegment, o_orderpriority), ())")
def agg_grouping_sets(t):
    sets = [[F.col("n_name")], [F.col("c_mktsegment"), F.col("o_orderpriority")], []]
    return _orders_by_place(t).groupingSets(sets, "n_name", "c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))


@query()
def agg_approx_distinct(t):
    return t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("users_hll"))


@query()
def agg_sketch_quantile(t):
    return t.events.groupBy("event_type").agg(F.percentile_approx("value", [0.1, 0.5, 0.99], 10000).alias("quantiles"))


@query("select o_orderpriority, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as statuses, mode(o_orderstatus order by o_orderstatus) is not null as has_mode from orders group by all")
def agg_collect(t):
    return t.orders.groupBy("o_orderpriority").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.mode("o_orderstatus").isNotNull().alias("has_mode"))


@query("select case when n_chars < 0 then 0 when n_chars >= 20000 then 21 else floor(n_chars / 1000.0)::int + 1 end as bucket, count(*) as n from documents group by all")
def histogram_chars(t):
    return t.documents.groupBy(F.width_bucket(F.col("n_chars").cast("double"), F.lit(0.0), F.lit(20000.0), F.lit(20)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("select c_nationkey as k from customer where c_acctbal < 0 intersect select s_nationkey from supplier")
def set_intersect(t):
    return t.customer.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("select l_suppkey as k, l_linenumber as n from lineitem except all select s_suppkey, 1 from supplier")
def set_except(t):
    return t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("n")).exceptAll(t.supplier.select("s_suppkey", F.lit(1)))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 25 offset 5")
def topk_global(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset(5).limit(25)


@query("select o_custkey, o_orderkey, rk::int as rk from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rk from orders) where rk <= 3")
def topk_per_group(t):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return t.orders.withColumn("rk", F.row_number().over(w)).filter("rk <= 3").select("o_custkey", "o_orderkey", "rk")


@query("select p_partkey, p_size, p_retailprice from part a where not exists (select 1 from part b where (b.p_size < a.p_size and b.p_retailprice >= a.p_retailprice) or (b.p_size = a.p_size and b.p_retailprice > a.p_retailprice)) qualify row_number() over (partition by p_size, p_retailprice order by p_partkey) = 1")
def pareto_frontier(t):
    one = t.part.groupBy("p_size", "p_retailprice").agg(F.min("p_partkey").alias("p_partkey"))
    return frontier(one, "p_size", "p_retailprice", 5).select("p_partkey", "p_size", "p_retailprice")


@query("with e as (select event_id, user_id, case when event_type <> 'error' then value end as value, props from events), p as (select event_id, user_id, value, nullif(json_extract(props, '$.k')::int % 17, 0) as cost from e) select event_id, cost, value from p a where cost is not null and value is not null and not exists (select 1 from p b where (b.cost < a.cost and b.value >= a.value) or (b.cost = a.cost and b.value > a.value))")
def pareto_unknown(t):
    """A frontier of rows of which some have no cost and others no gain; rows equal in both stay together."""
    value = F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    cost = F.nullif(F.get_json_object("props", "$.k").cast("int") % 17, F.lit(0)).alias("cost")
    return frontier(t.events.select("event_id", cost, value), "cost", "value", 8)


@query("select n_name, s.c_custkey, s.c_acctbal from nation, lateral (select c_custkey, c_acctbal from customer where c_nationkey = n_nationkey order by c_acctbal desc, c_custkey limit 2) s")
def join_lateral_top(t):
    best = t.customer.filter(F.col("c_nationkey") == F.col("n_nationkey").outer()).orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(2).select("c_custkey", "c_acctbal")
    return t.nation.lateralJoin(best).select("n_name", "c_custkey", "c_acctbal")


@query("select p_partkey, p_name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45 and l_returnflag = 'R')")
def join_anti_parts(t):
    returned = t.lineitem.filter("l_quantity > 45 and l_returnflag = 'R'")
    return t.part.join(returned, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@query("select event_id, try_cast(case when event_type = 'error' then 'N/A' when event_type = 'view' then value::varchar || 'e1' else value::varchar end as double) as number from events")
def safe_cast_mixed(t):
    """Numbers among text that is none: such text gives null, exponents are read."""
    text = F.when(F.col("event_type") == "error", "N/A").when(F.col("event_type") == "view", F.concat(F.col("value").cast("string"), F.lit("e1"))).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", text.try_cast("double").alias("number"))


@query("select l_suppkey, l_linenumber as most_common from (select l_suppkey, l_linenumber, row_number() over (partition by l_suppkey order by n desc, l_linenumber) as rk from (select l_suppkey, l_linenumber, count(*) as n from lineitem group by all)) where rk = 1")
def agg_mode(t):
    """The most common value of each group, the least of several."""
    by = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    return by.groupBy("l_suppkey").agg(F.max_by("l_linenumber", F.struct("n", -F.col("l_linenumber"))).alias("most_common"))


@query("with a as (select l_partkey, l_suppkey, sum(l_quantity) as qty from lineitem group by all), b as (select l_partkey as p, l_suppkey as s, sum(l_quantity) as back from lineitem where l_returnflag = 'R' group by all) select l_partkey, l_suppkey, qty, coalesce(back, 0) as back from a left join b on l_partkey = p and l_suppkey = s")
def join_composite(t):
    keys = ["l_partkey", "l_suppkey"]
    a = t.lineitem.groupBy(*keys).agg(F.sum("l_quantity").alias("qty"))
    b = t.lineitem.filter("l_returnflag = 'R'").groupBy(*keys).agg(F.sum("l_quantity").alias("back"))
    return a.join(b, keys, "left").select(*keys, "qty", F.coalesce("back", F.lit(0.0)).alias("back"))


@query("with x as (select s_suppkey as k, s_name as name, s_acctbal as balance from supplier union all select c_custkey + (select max(s_suppkey) + 1 from supplier), c_name, c_acctbal from customer) select k, name, balance, case when k in (select s_suppkey from supplier) then 'kept' else 'new' end as state from x")
def union_by_name(t):
    """A table and further rows whose columns come in another order; each row's state against the original."""
    first = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    after = t.supplier.agg(F.max("s_suppkey") + 1).scalar()
    more = t.customer.select(F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"), (F.col("c_custkey") + after).alias("k"))
    return added(first, first.unionByName(more), "k").select("k", "name", "balance", "state")


@query("select event_type, true as hll_near, true as theta_near, true as median_near from events group by event_type")
def sketch_bounds(t):
    """Sketches by type and day, merged by type, against exact answers: each must lie within its bound.

    HyperLogLog and theta: 5 % of the distinct users; KLL: the median's rank within 2 %.
    """
    day = F.to_date("ts")
    sketches = t.events.groupBy("event_type", day.alias("day")).agg(F.hll_sketch_agg("user_id", 12).alias("hll"), F.theta_sketch_agg("user_id").alias("theta"), F.kll_sketch_agg_double("value").alias("kll"))
    merged = sketches.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("hll"), F.theta_sketch_estimate(F.theta_union_agg("theta")).alias("theta"), F.kll_merge_agg_double("kll").alias("kll"))
    merged = merged.select("event_type", "hll", "theta", F.kll_sketch_get_quantile_double("kll", F.lit(0.5)).alias("median"))
    counted = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    rows = t.events.join(merged.select(F.col("event_type").alias("e"), "median"), F.col("event_type") == F.col("e"))
    ranks = rows.groupBy(F.col("e")).agg((F.count_if(F.col("value") < F.col("median")) / F.count("*")).alias("below"), (F.count_if(F.col("value") <= F.col("median")) / F.count("*")).alias("upto"))
    out = merged.join(counted, "event_type").join(ranks, F.col("event_type") == F.col("e"))

    def near(x: str):
        return F.abs(F.col(x) - F.col("users")) <= 0.05 * F.col("users")

    return out.select("event_type", near("hll").alias("hll_near"), near("theta").alias("theta_near"), ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_near"))
