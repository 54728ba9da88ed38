"""Windows over events and orders, regressions, and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import streaming
from ..functions import experiment_name, experiment_parts, flops_ratio, power_law_loss, run_time
from ..operators import asof_join, interpolated, least_squares, nearest_join, power_law, ranked, running_max, sessions, tile, z_scores
from ..operators import fits
from ..streaming import stateful
from .registry import registrar

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


def _seconds(c="ts"):
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("select event_id, rank() over w as r, dense_rank() over w as d, row_number() over (partition by event_type order by value desc, event_id) as n, round(percent_rank() over w, 6) as p, round(cume_dist() over w, 6) as c, ntile(4) over (partition by event_type order by value desc, event_id) as q from events window w as (partition by event_type order by value desc)")
def win_rank(t):
    r = ranked(t.events.select("event_id", "event_type", "value"), "event_type", "value", "event_id")
    before = F.coalesce(F.try_divide(F.col("rank") - 1, F.col("total") - 1), F.lit(0.0))
    return r.select("event_id", F.col("rank").alias("r"), F.col("dense").alias("d"), F.col("number").alias("n"), F.round(before, 6).alias("p"), F.round(F.col("cume") / F.col("total"), 6).alias("c"), tile(F.col("number"), F.col("total"), 4).alias("q"))


@query("select event_id, round(value - lag(value) over w, 6) as diff, lead(event_id) over w as next_id, first_value(event_id) over w as first_id, nth_value(event_id, 2) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following) as second_id from events window w as (partition by user_id order by ts, event_id)")
def win_lag_diff(t):
    w = _by_user()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.events.select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("diff"), F.lead("event_id").over(w).alias("next_id"), F.first("event_id").over(w).alias("first_id"), F.nth_value("event_id", 2).over(whole).alias("second_id"))


@query("select o_orderkey, max(o_totalprice) over w as best, o_totalprice = max(o_totalprice) over w as is_record from orders window w as (partition by o_orderpriority order by o_orderdate, o_orderkey rows between unbounded preceding and current row)")
def win_running_min_frontier(t):
    best = running_max(t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice"), "o_orderpriority", "o_orderdate", "o_totalprice", "best", "o_orderkey")
    return best.select("o_orderkey", "best", (F.col("o_totalprice") == F.col("best")).alias("is_record"))


@query("select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 3 preceding and 3 following), 6) as smooth, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as running from events")
def win_moving_avg(t):
    w = _by_user()
    return t.events.select("event_id", F.round(F.avg("value").over(w.rowsBetween(-3, 3)), 6).alias("smooth"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


@query("select event_id, count(*) over (partition by user_id order by epoch(date_trunc('second', ts))::bigint range between 86400 preceding and current row) as day_n from events")
def win_range_frame(t):
    w = Window.partitionBy("user_id").orderBy(_seconds()).rangeBetween(-86400, 0)
    return t.events.select("event_id", F.count("*").over(w).alias("day_n"))


@query("select event_id, round((value - avg(value) over w) / nullif(stddev_samp(value) over w, 0), 4) as z from events window w as (partition by event_type)")
def win_zscore(t):
    return z_scores(t.events.select("event_id", "event_type", "value"), "event_type", "value", "z").select("event_id", F.round("z", 4).alias("z"))


@query("with a as (select *, epoch(date_trunc('second', ts))::bigint as s from events), b as (select *, case when s - lag(s) over (partition by user_id order by s, event_id) <= 7200 then 0 else 1 end as new from a), c as (select *, sum(new) over (partition by user_id order by s, event_id rows unbounded preceding) as session from b) select user_id, session::bigint as session, count(*) as n, max(s) - min(s) as seconds from c group by user_id, session")
def sessionize(t):
    found = sessions(t.events.withColumn("s", _seconds()), "user_id", F.col("s"), 7200, "event_id")
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("s") - F.min("s")).alias("seconds"))


@query("select e.event_id, (select p.value from events p where p.user_id = e.user_id and p.event_type = 'view' and p.ts <= e.ts order by p.ts desc, p.event_id desc limit 1) as seen from events e where event_type = 'purchase'")
def asof_latest(t):
    views = t.events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("v"))
    return asof_join(t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "v", "seen").select("event_id", "seen")


@query("with a as (select event_id, user_id, epoch(date_trunc('second', ts))::bigint as s, case when event_type = 'click' then null else value end as y from events), b as (select *, last_value(case when y is not null then s end ignore nulls) over p as s0, last_value(y ignore nulls) over p as y0, first_value(case when y is not null then s end ignore nulls) over f as s1, first_value(y ignore nulls) over f as y1 from a window p as (partition by user_id order by s, event_id rows between unbounded preceding and current row), f as (partition by user_id order by s, event_id rows between current row and unbounded following)) select event_id, round(coalesce(y, case when s1 = s0 then null else y0 + (y1 - y0) * ((s - s0)::double / (s1 - s0)) end), 4) as filled from b")
def interpolate_linear(t):
    df = t.events.select("event_id", "user_id", _seconds().alias("s"), F.when(F.col("event_type") != "click", F.col("value")).alias("y"))
    return interpolated(df, "user_id", "s", "y", "event_id").select("event_id", F.round("y_filled", 4).alias("filled"))


@query("select round(corr(l_quantity, l_extendedprice), 6) as qp, round(corr(l_quantity, l_discount), 6) as qd, round(corr(l_extendedprice, l_tax), 6) as pt, round(covar_pop(l_quantity, l_tax), 6) as cov, round(covar_samp(l_discount, l_tax), 6) as cov_s from lineitem")
def corr_matrix(t):
    return t.lineitem.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("qp"), F.round(F.corr("l_quantity", "l_discount"), 6).alias("qd"), F.round(F.corr("l_extendedprice", "l_tax"), 6).alias("pt"), F.round(F.covar_pop("l_quantity", "l_tax"), 6).alias("cov"), F.round(F.covar_samp("l_discount", "l_tax"), 6).alias("cov_s"))


@query("select l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) as slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) as icept, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 6) as r2 from lineitem where l_quantity > 0 and l_extendedprice > 0 group by all")
def regr_loglog(t):
    y, x = F.ln("l_extendedprice"), F.ln("l_quantity")
    return t.lineitem.filter("l_quantity > 0 and l_extendedprice > 0").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("icept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("with x as (select ln(l_extendedprice) as y, ln(l_quantity) as a, ln(1 + l_tax) as b from lineitem where l_quantity > 0 and l_extendedprice > 0), s as (select covar_pop(a, a) as aa, covar_pop(b, b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as by_ from x) select 'a' as term, round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 5) as coef from s union all select 'b', round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 5) from s")
def elasticity_multi(t):
    df = t.lineitem.filter("l_quantity > 0 and l_extendedprice > 0").select(F.ln("l_extendedprice").alias("y"), F.ln("l_quantity").alias("a"), F.ln(1 + F.col("l_tax")).alias("b"))
    fit = least_squares(df, "y", ["a", "b"])
    return t.spark.createDataFrame([(k, round(fit[k], 5)) for k in ("a", "b")], "term string, coef double")


@query()
def powerlaw_grid_fit(t):
    """Fits a power law planted on the parts' sizes and prices: the known exponents must come back."""
    n, d = F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    df = t.part.filter("p_size > 0 and p_retailprice > 0").select(n.alias("n"), d.alias("d"), (1.69 + 0.4 * F.pow(n, F.lit(-0.34)) + 1.2 * F.pow(d, F.lit(-0.28))).alias("loss"))
    fit = power_law(df, "n", "d", "loss", [round(0.2 + 0.02 * i, 2) for i in range(13)])
    return t.spark.createDataFrame([(fit["alpha"], fit["beta"], round(fit["e"], 3), fit["at_edge"])], "alpha double, beta double, e double, at_edge boolean")


@query("select l_orderkey, l_linenumber, round(r, 9) as ratio, coalesce(abs(r - 1) < 0.01, false) as consistent from (select *, case when l_quantity * l_tax = 0 then null else l_extendedprice * 6e15 / (6e18 * (l_quantity * l_tax)) end as r from lineitem)")
def flops_consistency(t):
    r = flops_ratio(F.col("l_extendedprice") * 6e15, F.col("l_quantity"), F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(r, 9).alias("ratio"), F.coalesce(F.abs(r - 1) < 0.01, F.lit(False)).alias("consistent"))


_STREAM = "select {w} as start, event_type, count(*) as n, round(sum(value), 4) as total from events {x} group by all"


@query(_STREAM.format(w="time_bucket(interval '6 hours', ts, timestamp '2000-01-01')", x=""))
def stream_tumbling(t):
    return streaming.drained(streaming.windowed(streaming.stream_of(t.spark, t.sf_dir, "events"), "6 hours"), "update", "start", "event_type")


@query(_STREAM.format(w="time_bucket(interval '6 hours', ts, timestamp '2000-01-01') - to_hours(6 * k)", x=", (select unnest([0, 1, 2, 3]) as k)"))
def stream_sliding(t):
    return streaming.drained(streaming.windowed(streaming.stream_of(t.spark, t.sf_dir, "events"), "24 hours", "6 hours"), "update", "start", "event_type")


@query("with b as (select *, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)), c as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from b) select user_id, min(ts) as start, max(ts) + interval '30 minutes' as \"end\", count(*) as n from c group by user_id, k")
def stream_session(t):
    return streaming.drained(streaming.user_sessions(streaming.stream_of(t.spark, t.sf_dir, "events"), "30 minutes"), "complete")


@query("select distinct event_id from events")
def stream_dedup(t):
    stream = streaming.stream_of(t.spark, t.sf_dir, "events")
    twice = stream.union(stream).select("event_id", "ts")
    return streaming.drained(streaming.without_repeats(twice, "event_id"), "append").select("event_id")


@query("select e.event_id, (select arg_min(p.value, struct_pack(a := abs(epoch_us(p.ts) - epoch_us(e.ts)), b := p.ts)) from events p where p.user_id = e.user_id and p.event_type = 'view') as nearest from events e where event_type = 'purchase'")
def nearest_view(t):
    """The value of the view nearest in time to each purchase of its user."""
    e = t.events.select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    views = e.filter("event_type = 'view'").groupBy("user_id", "at").agg(F.min_by("value", "event_id").alias("v"))
    return nearest_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "at"), views, ["user_id"], "at", "v", "nearest").select("event_id", "nearest")


@query("with g as (select o_custkey, o_totalprice / lag(o_totalprice) over (partition by o_custkey order by o_totalprice, o_orderkey) as ratio from orders where o_totalprice > 0) select o_custkey, count(ratio) as steps, round(exp(avg(ln(ratio))), 6) as mean_ratio, round(max(ratio), 6) as widest from g group by o_custkey")
def grid_ratio(t):
    """How near to geometric a rising grid is: the mean and the greatest ratio of neighbours."""
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    g = t.orders.filter("o_totalprice > 0").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("ratio", F.col("o_totalprice") / before)
    return g.groupBy("o_custkey").agg(F.count("ratio").alias("steps"), F.round(F.exp(F.avg(F.ln("ratio"))), 6).alias("mean_ratio"), F.round(F.max("ratio"), 6).alias("widest"))


@query("select l_returnflag, count(*) as models, count(*) filter (where l_discount > 0) as known, round(avg(ln(l_discount)) filter (where l_discount > 0), 6) as mean_log from lineitem group by all")
def known_tokens(t):
    """Rows whose count of tokens is zero mean unknown: they are counted, and left out before the logarithm."""
    known = F.col("l_discount") > 0
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("models"), F.count_if(known).alias("known"), F.round(F.avg(F.when(known, F.ln(F.nullif(F.col("l_discount"), F.lit(0.0))))), 6).alias("mean_log"))


@query("select p_partkey, case when p_size > 0 and p_retailprice > 0 then round(1.69 + 0.354 * p_size::double ** -0.34 + 1.237 * (p_retailprice / 100) ** -0.28, 6) end as loss from part")
def power_law_values(t):
    return t.part.select("p_partkey", F.round(power_law_loss(F.col("p_size").cast("double"), F.col("p_retailprice") / 100), 6).alias("loss"))


_NAMED = "printf('N%.2f_D%04d_Q%.1f', l_tax, l_linenumber, l_quantity)"


@query(f"select name, regexp_extract(name, 'N([0-9.]+)_', 1)::double as n, regexp_extract(name, 'D([0-9.]+)_', 1)::double as d, regexp_extract(name, 'Q([0-9.]+)', 1)::double as q, count(*) as rows from (select {_NAMED} as name from lineitem) group by name")
def experiment_ids(t):
    named = t.lineitem.groupBy(experiment_name(F.col("l_tax"), F.col("l_linenumber"), F.col("l_quantity")).alias("name")).agg(F.count("*").alias("rows"))
    return named.select("name", experiment_parts(F.col("name")).alias("p"), "rows").select("name", "p.*", "rows")


@query("select o_orderkey, day as day, year(day)::int as y, quarter(day)::int as quarter, month(day)::int as m, isodow(day)::int as weekday, date_diff('day', date '1995-01-01', day)::int as since, last_day(day) as month_end from (select o_orderkey, try_cast(case when o_orderstatus = 'P' then 'unknown' else strftime(o_orderdate, '%Y-%m-%d') end as date) as day from orders)")
def date_parts(t):
    """Dates come as text, some of it no date: parse, take parts and differences."""
    text = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    d = t.orders.select("o_orderkey", F.try_to_date(text, "yyyy-MM-dd").alias("day"))
    return d.select("o_orderkey", "day", F.year("day").alias("y"), F.quarter("day").alias("quarter"), F.month("day").alias("m"), (F.weekday("day") + 1).alias("weekday"), F.date_diff("day", F.lit("1995-01-01").cast("date")).alias("since"), F.last_day("day").alias("month_end"))


@query("select event_id, case when event_type <> 'error' then ts end as at from events")
def run_stamps(t):
    """Times of runs in the two forms of file and split names; other text gives null."""
    forms = [F.date_format(F.col("ts"), f"yyyy{a}MM{a}dd'T'HH{a}mm{a}ss.SSSSSS") for a in "-_"]
    stamp = F.when(F.col("event_type") == "error", "latest").when(F.col("event_type") == "view", forms[0]).otherwise(forms[1])
    return t.events.select("event_id", run_time(stamp).alias("at"))


@query("select event_id, e.user_id, c_name, c_mktsegment from events e left join customer on c_custkey = e.user_id and c_acctbal > 0 where event_type = 'purchase'")
def stream_static_join(t):
    events = streaming.stream_of(t.spark, t.sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "user_id")
    people = t.customer.filter("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    return streaming.drained(streaming.with_static(events, people, "user_id", "c_custkey"), "append").select("event_id", "user_id", "c_name", "c_mktsegment")


@query("select a.user_id, a.event_id as first_id, b.event_id as then_id from events a join events b on a.user_id = b.user_id and b.ts >= a.ts and b.ts <= a.ts + interval 3 hours where a.event_type = 'view' and b.event_type = 'purchase'")
def stream_stream_join(t):
    """Purchases up to three hours after a view of the same user, from two streams."""
    views, bought = (streaming.stream_of(t.spark, t.sf_dir, "events").filter(F.col("event_type") == k).select("event_id", "user_id", "ts") for k in ("view", "purchase"))
    return streaming.drained(streaming.follow_ups(views, bought, "user_id", 3 * 3600), "append").select("user_id", "first_id", "then_id")


@query("select user_id, count(*) as n, round(sum(value), 4) as total, max(value) as most from events group by user_id")
def stream_user_totals(t):
    """Totals by user in state of our own, given out in update mode."""
    rows = streaming.drained(streaming.totals(streaming.stream_of(t.spark, t.sf_dir, "events"), "user_id", "value"), "update", "user_id")
    return rows.select("user_id", "n", F.round("total", 4).alias("total"), "most")


def _timed(t):
    return t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_type").alias("kind"))


_HALF = "2024-01-16"


@query("with b as (select *, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)), c as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from b) select user_id, min(ts) as start, max(ts) as last, count(*) as n, round(sum(value), 4) as total, count(distinct event_type)::int as kinds from c group by user_id, k having (epoch_us(max(ts)) + 1800000000 + 999) // 1000 <= (select epoch_us(max(ts)) // 1000 - 3600000 from events)")
def stream_closed_sessions(t):
    """Sessions that the watermark has passed, from state with timers; that of open ones is all that stays."""
    rows, half = _timed(t), F.col("ts") < F.lit(_HALF).cast("timestamp")
    with stateful.rocks_state(t.spark):
        closed, _ = stateful.in_runs([rows.filter(half), rows.filter(~half)], lambda e: stateful.expiring_sessions(e, "user_id", 1800))
    times = [F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("start", "last")]
    return closed.select("user_id", *times, "n", F.round("total", 4).alias("total"), "kinds")


@query(f"with e as (select epoch_us(ts) as u, ts < timestamp '{_HALF}' as early from events), w as (select max(u) filter (where early) // 1000 - 3600000 as w1, max(u) // 1000 - 3600000 as w2 from e) select 0 as run, count(*) filter (where early) as input_rows, 0 as late_rows from e union all select 1, count(*) filter (where not early), count(*) filter (where not early and u <= w1 * 1000) from e, w union all select 2, count(*), count(*) filter (where u <= w2 * 1000) from e, w")
def stream_late_rows(t):
    """What each of three runs dropped as late: the first half of the time, the second, and all of it again."""
    rows, half = _timed(t), F.col("ts") < F.lit(_HALF).cast("timestamp")
    with stateful.rocks_state(t.spark):
        _, progress = stateful.in_runs([rows.filter(half), rows.filter(~half), rows], lambda e: stateful.expiring_sessions(e, "user_id", 1800))
    return progress.select("run", "input_rows", "late_rows")


_LAW = fits.Law(1.5, 0.5, 0.4, 1.0, 0.2)
_ROWS = "with d as (select p_size::double as n, p_retailprice / 100 as d, 1.69 + 0.4 * p_size ** -0.34 + 1.2 * (p_retailprice / 100) ** -0.28 + (p_partkey % 11 - 5) / 1000 as loss from part where p_size > 0 and p_retailprice > 0), s as (select [1.0::double, n ** -0.4, -0.5 * n ** -0.4 * ln(n), d ** -0.2, -1.0 * d ** -0.2 * ln(d)] as s, loss - (1.5 + 0.5 * n ** -0.4 + 1.0 * d ** -0.2) as r from d), w as (select *, case when abs(r) > 0.2 then 0.2 / abs(r) else 1.0 end as w from s)"


def _noisy(t):
    n, d = F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    loss = 1.69 + 0.4 * F.pow(n, F.lit(-0.34)) + 1.2 * F.pow(d, F.lit(-0.28)) + (F.col("p_partkey") % 11 - 5) / 1000
    return t.part.filter("p_size > 0 and p_retailprice > 0").select(n.alias("n"), d.alias("d"), loss.alias("loss"))


@query(f"{_ROWS} select ['e', 'a', 'alpha', 'b', 'beta'][i] as term, round(sum(w * s[i] * r), 3) as slope_residual, " + ", ".join(f"round(sum(w * s[i] * s[{j}]), 3) as with_{t}" for j, t in enumerate(fits.TERMS, 1)) + " from w, range(1, 6) x(i) group by i")
def powerlaw_step(t):
    """The sums of one robust step of the fit: a row for each parameter."""
    sums = fits.step_sums(_noisy(t), "n", "d", "loss", _LAW, 0.2)
    pairs = {(a, b): f"{a}_{b}" if i <= j else f"{b}_{a}" for i, a in enumerate(fits.TERMS) for j, b in enumerate(fits.TERMS)}
    rows = [F.struct(F.lit(a).alias("term"), F.round(f"r_{a}", 3).alias("slope_residual"), *[F.round(pairs[a, b], 3).alias(f"with_{b}") for b in fits.TERMS]) for a in fits.TERMS]
    return sums.select(F.inline(F.array(*rows)))
