"""Every registered query of the signal operators, each beside the SQL that states its result.

Both sides round doubles alike, cast integers to the same width and name every column. SIG is the signal view
of `events` (see plans.views); queries on it say so by `sig`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelark.functions import scalar
from wavelark.model import Region
from wavelark.operators import blocks, correlation, graph, intervals, layout, segments, signal, spectral, statistics
from wavelark.plans import views
from wavelark.sources import files

#: The signal view in SQL.
SIG = """
with ev as (select cast(user_id % 3 as int) as subject, event_type as channel, cast(floor((epoch_us(ts) / 1000000.0 - 1704067200) / 21600) as int) as t_idx, value from events),
sig as (select g.subject, g.channel, g.t_idx, g.t_idx * 6.0::double as time, round(coalesce(e.v, 0), 4) as value
  from (select subject, channel, cast(unnest(range(lo, hi + 1)) as int) as t_idx from (select distinct subject, channel from ev), (select min(t_idx) as lo, max(t_idx) as hi from ev)) g
  left join (select subject, channel, t_idx, sum(value) as v from ev group by all) e using (subject, channel, t_idx))
"""
TRENDS = (
    SIG
    + """, chg as (select *, value - lag(value) over (partition by subject, channel order by t_idx) as d from sig),
flg as (select *, coalesce({sign}, false) as f, row_number() over (partition by subject, channel order by t_idx) as rn from chg),
isl as (select *, rn - row_number() over (partition by subject, channel, f order by t_idx) as g from flg),
trends as (select subject, channel, min(time) as start_sec, max(time) as end_sec, arg_max(value, t_idx) - arg_min(value, t_idx) as height from isl where f group by subject, channel, g having max(time) - min(time) >= 6.0)
"""
)
RISING = TRENDS.format(sign="d > 0")
MASK = RISING + ", mask as (select s.subject, s.channel, s.t_idx, s.time, cast(max(case when t.start_sec is not null then 1 else 0 end) as int) as active from sig s left join trends t on s.subject = t.subject and s.channel = t.channel and s.time between t.start_sec and t.end_sec group by all)\n"
DENSITY = (
    MASK
    + """, fr as (select *, max(active) over w as a, count(*) over w as n, row_number() over (partition by subject, channel order by t_idx) - 1 as pos, last_value(time) over w as e from mask window w as (partition by subject, channel order by t_idx rows between current row and 3 following)),
density as (select subject, cast(pos as int) as win, (time + e) / 2 as time, cast(sum(a) as bigint) as ch_count from fr where n = 4 group by subject, pos, time, e)
"""
)
HIGH = (
    DENSITY
    + """, dr as (select *, row_number() over (partition by subject order by win) - row_number() over (partition by subject, ch_count > 2 order by win) as g from density),
dp as (select *, row_number() over (partition by subject, g order by ch_count desc, time) as r from dr where ch_count > 2),
high as (select subject, min(time) as start_sec, max(time) as end_sec, max(case when r = 1 then time end) as highest_time, max(ch_count) as highest_value from dp group by subject, g)
"""
)
PARTS = HIGH + ", parts as (select h.subject, h.start_sec, m.channel, max(m.active) as active from high h join mask m on h.subject = m.subject and m.time between h.start_sec and h.end_sec group by all)\n"
STATUS = PARTS + ", status as (select subject || '/' || cast(cast(start_sec as int) as varchar) as segment, channel, cast(active as int) as active from parts)\n"
NULL = STATUS + ", dr2 as (select p.perm, s.segment, s.channel, sum(s.active) over (partition by p.perm, s.segment) as k, row_number() over (partition by p.perm, s.segment order by md5('42:' || p.perm || ':' || s.segment || ':' || s.channel), s.channel) as r from status s, (select unnest(range(1000)) as perm) p),\nnul as (select cast(perm as int) as perm, channel, cast(sum(case when r <= k then 1 else 0 end) as bigint) as count from dr2 group by perm, channel)\n"
PVAL = NULL + ", rl as (select channel, cast(sum(active) as bigint) as real_count, sum(active) * 100.0 / count(*) as real_percent from status group by channel),\npv as (select rl.channel, real_count, real_percent, (sum(case when count >= real_count then 1 else 0 end) + 1) / (count(*) + 1) as p_value from rl join nul using (channel) group by all)\n"
BH = PVAL + ", rk as (select *, row_number() over (order by p_value, channel) as rank, count(*) over () as m from pv),\nbh as (select channel, real_count, real_percent, p_value, least(min(p_value * m / rank) over (order by rank desc rows unbounded preceding), 1.0) as p_value_corrected from rk)\n"
PAIR = SIG + ", pr as (select a.subject || '/' || a.channel as a, b.subject || '/' || b.channel as b, a.t_idx, a.time, a.value as x, b.value as y from sig a join sig b on a.t_idx = b.t_idx and a.subject || '/' || a.channel < b.subject || '/' || b.channel)\n"
SLIDE = PAIR + ", sl as (select a, b, t_idx, time, count(*) over w as n, row_number() over (partition by a, b order by t_idx) - 1 as pos, lead(time, 5) over (partition by a, b order by t_idx) as mid, covar_pop(x, y) over w / nullif(stddev_pop(x) over w * stddev_pop(y) over w, 0) as r from pr window w as (partition by a, b order by t_idx rows between current row and 9 following)),\nsw as (select a, b, t_idx, mid as time, r from sl where n = 10 and pos % 2 = 0)\n"
MATRIX = SIG + ", hf as (select a.subject, a.channel as a, b.channel as b, covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) as r from sig a join sig b on a.subject = b.subject and a.t_idx = b.t_idx and a.channel < b.channel group by all),\nmx as (select subject, a as ch_a, b as ch_b, r from hf union all select subject, b, a, r from hf union all select distinct subject, channel, channel, 0.0 from sig)\n"
STRONG = MATRIX + ", th as (select subject, quantile_cont(r, 0.75) as threshold from mx where r > 0 group by subject), st as (select mx.*, threshold from mx join th using (subject) where r > 0 and r >= threshold)\n"
SESS = """with ev as (select user_id % 3 as subject, event_type as v, epoch_us(ts) / 1000000.0 as t from events),
fr as (select *, case when t - lag(t) over w < 600 and lag(v) over w = v then 0 else 1 end as f from ev window w as (partition by subject order by t, v)),
ss as (select *, sum(f) over (partition by subject order by t, v rows unbounded preceding) as s from fr),
sessions as (select cast(subject as int) as subject, min(t) as start, max(t) as "end", any_value(v) as trigger_value from ss group by subject, s having max(t) - min(t) >= 60)
"""
IBC = SIG + ", ms as (select subject, t_idx, time, avg(value) as value from sig group by all), pp as (select a.subject as a, b.subject as b, a.t_idx, a.time, a.value as x, b.value as y from ms a join ms b on a.t_idx = b.t_idx and a.subject < b.subject),\nsl as (select a, b, t_idx, count(*) over w as n, row_number() over (partition by a, b order by t_idx) - 1 as pos, covar_pop(x, y) over w / nullif(stddev_pop(x) over w * stddev_pop(y) over w, 0) as r from pp window w as (partition by a, b order by t_idx rows between current row and 9 following)),\nibc as (select t_idx, case when count(r) = count(*) then avg(r) end as r from sl where n = 10 and pos % 2 = 0 group by t_idx),\nseries as (select cast(t_idx as double) as time, avg(value) as value from sig group by t_idx),\nonsets as (select cast(dense_rank() over (order by event_type) - 1 as int) as event, case event_type when 'view' then 'on' when 'click' then 'ing' else 'off' end as label, onset from (select event_type, (epoch_us(ts) / 1000000.0 - 1704067200) / 21600 as onset, row_number() over (partition by event_type order by ts, event_id) as k, count(*) over (partition by event_type) as n from events) where k = n // 2 + 1),\nej as (select o.event, o.label, s.time - o.onset as off, s.value, count(*) over (partition by o.event) as n from series s join onsets o on s.time >= o.onset - 6 and s.time < o.onset + 6),\nep as (select * from ej where n = 12),\npp2 as (select event, label, avg(case when off >= -5 and off < 0 then value end) as pre_mean, avg(case when off >= 0 and off < 5 then value end) as post_mean from ep group by all),\nuni as (select perm, event, lo + cast(('0x' || substr(md5('42:' || perm || ':' || event), 1, 8))::bigint as double) / 4294967296.0 * (hi - lo) as onset from (select unnest(range(100000)) as perm) p, (select unnest(range(3)) as event) e, (select min(time) + 6 as lo, max(time) - 6 as hi from series)),\non2 as (select perm, event, count(*) as n, avg(case when time < onset then value end) as a, avg(case when time >= onset then value end) as b from series join uni on time >= onset - 6 and time < onset + 6 group by all having count(*) = 12),\nonull as (select cast(perm as int) as perm, avg(b) - avg(a) as diff from on2 group by perm having count(*) = 3)\n"


_series = lambda: F.concat(F.col("subject").cast("string"), F.lit("/"), F.col("channel"))
r6 = lambda c: F.round(c, 6)
Plan = Callable[[SparkSession, str], DataFrame]
_all: dict[str, tuple[Plan, str | None]] = {}


def _query(name: str, plan: Plan, sql: str | None = None) -> None:
    _all[name] = (plan, sql)


def _on_signal(name: str, plan: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    _query(name, lambda spark, d: plan(views.signal_grid(spark, d)), sql)


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


SAMPLE = "subject, channel, t_idx, time, value"
_on_signal("signal_grid", lambda s: s, SIG + f"select {SAMPLE} from sig")
_on_signal("crop_half_open", lambda s: signal.crop(s, Region(start_sec=60, end_sec=120)), SIG + "select * from sig where time >= 60 and time < 120")
_on_signal("crop_closed", lambda s: signal.crop(s, Region(start_sec=60, end_sec=120), closed=True), SIG + "select * from sig where time between 60 and 120")
_on_signal("crop_rebase", lambda s: signal.rebase(signal.crop(s, Region(start_sec=61, length_sec=60), closed=True), 3.5), SIG + "select subject, channel, t_idx, time - min(time) over (partition by subject) + 3.5 as time, value from sig where time between 61 and 121")
_on_signal("padded_roi", lambda s: signal.padded(s, Region(start_sec=12, end_sec=60), 30), SIG + "select *, time between 12 and 60 as inside from sig where time between greatest(12 - 30, 0) and 90")
_on_signal("pick_channels", lambda s: signal.pick(s, [0, 2], ["click", "purchase", "view"]), SIG + "select * from sig where channel in ('click', 'purchase', 'view') and subject in (0, 2)")
_query("first_last_trigger", lambda spark, d: views.events(spark, d).groupBy("event_type").agg(F.min("epoch").alias("first"), F.max("epoch").alias("last")), "select event_type, min(epoch_us(ts) / 1000000.0) as first, max(epoch_us(ts) / 1000000.0) as last from events group by event_type")
_query("row_slice", lambda spark, d: signal.row_slice(_table("events")(spark, d).select("event_type", "event_id", "value"), ["event_id"], 5, 25, ("event_type",)), "select event_type, event_id, value, row from (select event_type, event_id, value, row_number() over (partition by event_type order by event_id) - 1 as row from events) where row between 5 and 24")


def _known(s: DataFrame) -> DataFrame:
    """Channels by number, so that wide columns have fixed names."""
    return s.join(_places_of(s, "channel"), "channel").withColumn("channel", F.col("_name")).drop("_name")


def _places_of(s: DataFrame, column: str) -> DataFrame:
    """(column, _name): a channel's place by name. Only the distinct names are ordered."""
    return s.select(column).distinct().withColumn("_name", F.concat(F.lit("ch"), F.row_number().over(Window.orderBy(column)).cast("string")))


def _names(df: DataFrame, column: str = "channel") -> list[str]:
    """The wide columns' names: one for each channel that there is."""
    return [f"ch{k + 1}" for k in range(df.select(column).distinct().count())]


def _wide(s: DataFrame) -> DataFrame:
    return signal.to_wide(s, _names(s))


def _long(wide: DataFrame) -> DataFrame:
    return signal.to_long(wide, [c for c in wide.columns if c not in ("subject", "time")])


#: The driver's events have five kinds; the SQL names their columns.
WIDE = ["ch1", "ch2", "ch3", "ch4", "ch5"]
KNOWN = SIG + ", kn as (select subject, 'ch' || dense_rank() over (order by channel) as channel, t_idx, time, value from sig)\n"
_on_signal("pivot_wide", lambda s: _wide(_known(s)), KNOWN + "select subject, " + ", ".join(f"max(case when channel = '{c}' then value end) as {c}" for c in WIDE) + ", time from kn group by subject, time")
_on_signal("unpivot_long", lambda s: _long(_wide(_known(s))), KNOWN + "select subject, time, channel, value from kn")
_on_signal("align_min_length", lambda s: signal.align(s.where((F.col("subject") != 1) | (F.col("t_idx") < 77))), SIG + "select subject, channel, t_idx, time, value from sig where t_idx < 77")
_on_signal("synth_time", lambda s: signal.synthetic_time(s, 11, 1.5).withColumn("time", r6("time")), SIG + "select subject, channel, t_idx, round(1.5 + t_idx / 11, 6) as time, value from sig")
_on_signal("unit_scale", lambda s: signal.scale(s, 5.56).withColumn("value", r6("value")), SIG + "select subject, channel, t_idx, time, round(value * 5.56, 6) as value from sig")
_on_signal("zscore", lambda s: signal.z_score(s).withColumn("value", r6("value")), SIG + "select subject, channel, t_idx, time, round((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 6) as value from sig window w as (partition by subject, channel)")
_on_signal("robust_minmax", lambda s: signal.robust_range(s, 0.1, 15).withColumn("value", r6("value")), SIG + "select subject, channel, t_idx, time, round(case when a = b then 7.55 else 0.1 + (least(greatest(value, a), b) - a) / nullif(b - a, 0) * 14.9 end, 6) as value from sig join (select subject, channel, quantile_cont(value, 0.02) as a, quantile_cont(value, 0.98) as b from sig group by all) using (subject, channel)")
_on_signal("db_transform", lambda s: s.withColumn("value", r6(scalar.decibel(F.col("value")))), SIG + "select subject, channel, t_idx, time, round(10 * log10(value + 1e-10), 6) as value from sig")
_on_signal("threshold_mask", lambda s: s.withColumn("value", scalar.at_least(F.col("value"), 50)), SIG + "select subject, channel, t_idx, time, case when value >= 50 then value end as value from sig")
_on_signal("clip_floor", lambda s: s.withColumn("value", F.round(scalar.clip_low(F.col("value") - 40), 4)), SIG + "select subject, channel, t_idx, time, round(case when value - 40 < 0 then 0 else value - 40 end, 4) as value from sig")
_on_signal("moving_mean", lambda s: signal.smooth(s, 25).withColumn("value", F.round("value", 8)), SIG + "select subject, channel, t_idx, time, round(avg(value) over (partition by subject, channel order by t_idx rows between 12 preceding and 12 following), 8) as value from sig")
_on_signal("sr_estimate", lambda s: signal.sampling_rate(s).withColumn("sr", r6("sr")), SIG + "select subject, channel, round(1 / median(dt), 6) as sr from (select *, time - lag(time) over (partition by subject, channel order by t_idx) as dt from sig) group by subject, channel")
_on_signal("export_labels", signal.export_labels, SIG + "select time as TIME, value as VALUE, subject || '-ch' || lpad(cast(dense_rank() over (partition by subject order by channel) as varchar), 2, '0') as LABEL from sig")
_on_signal("global_pair_corr", lambda s: correlation.global_pairs(s, _series()).withColumn("r", r6("r")), PAIR + "select a, b, round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 6) as r from pr group by a, b")
_on_signal("global_mean_corr", lambda s: correlation.global_mean(s, _series()).withColumn("score", r6("score")), PAIR + "select round(avg(r), 6) as score from (select coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0) as r from pr group by a, b)")
_on_signal("sliding_pair_corr", lambda s: correlation.sliding_pairs(s, _series(), 10, 2).withColumn("r", r6("r")), SLIDE + "select a, b, t_idx, time, round(r, 6) as r from sw")
_on_signal("sliding_mean_corr", lambda s: correlation.sliding_mean(s, _series(), 10, 2).withColumn("score", r6("score")), SLIDE + "select t_idx, time, round(avg(coalesce(r, 0)), 6) as score from sw group by t_idx, time")
_on_signal("interbrain_corr", lambda s: correlation.between_subjects(s, 10, 2, 1 / 6).select(r6("time_sec").alias("time_sec"), r6("correlation").alias("correlation")), IBC + "select round(t_idx / 2 * 12 + 30.0, 6) as time_sec, round(case when r < 0 then 0 else r end, 6) as correlation from ibc")
_on_signal("conn_matrix", lambda s: correlation.matrix(s).withColumn("r", r6("r")), MATRIX + "select subject, ch_a, ch_b, round(r, 6) as r from mx")


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    """A stretch for each kind of event, from its first event to its middle one, in hours; they overlap."""
    e = views.events(spark, d).select(F.col("event_type").alias("annotation"), ((F.col("epoch") - views.ORIGIN) / 3600).alias("at"), "event_id")
    w = Window.partitionBy("annotation")
    placed = e.withColumns({"k": F.row_number().over(w.orderBy("at", "event_id")), "n": F.count("*").over(w)})
    return placed.where(F.col("k") <= F.floor(F.col("n") / 2) + 1).groupBy("annotation").agg(F.min("at").alias("start"), F.max("at").alias("end"))


ANNOTATED = SIG + ", ann as (select event_type as annotation, min(tm) as lo, max(tm) as hi from (select event_type, (epoch_us(ts) / 1000000.0 - 1704067200) / 3600 as tm, row_number() over (partition by event_type order by ts, event_id) as k, count(*) over (partition by event_type) as n from events) where k <= n // 2 + 1 group by event_type)\n"
_query(
    "conn_matrix_by_annotation",
    lambda spark, d: correlation.matrix(correlation.by_annotation(views.signal_grid(spark, d), _annotations(spark, d)), ("annotation", "subject")).withColumn("r", r6("r")),
    ANNOTATED + ", an as (select s.*, a.annotation from sig s join ann a on s.time between a.lo and a.hi),\nhf as (select a.annotation, a.subject, a.channel as a, b.channel as b, covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) as r from an a join an b on a.annotation = b.annotation and a.subject = b.subject and a.t_idx = b.t_idx and a.channel < b.channel group by all)\nselect annotation, subject, a as ch_a, b as ch_b, round(r, 6) as r from hf union all select annotation, subject, b, a, round(r, 6) from hf union all select distinct annotation, subject, channel, channel, 0.0 from an",
)
_on_signal("pos_quantile_threshold", lambda s: correlation.strong_edges(correlation.matrix(s)).select("subject", r6("threshold").alias("threshold")).distinct(), STRONG + "select subject, round(threshold, 6) as threshold from th")
_on_signal("threshold_graph", lambda s: correlation.strong_edges(correlation.matrix(s)).select("subject", "ch_a", "ch_b", r6("r").alias("r")), STRONG + "select subject, ch_a, ch_b, round(r, 6) as r from st")
_FIXED = lambda s: s.select("subject", "channel").distinct().withColumn("community", F.length("channel") % 3)
_on_signal("stable_community_ids", lambda s: graph.stable_ids(_FIXED(s), min_size=2), SIG + ", p as (select distinct subject, channel, length(channel) % 3 as c from sig), q as (select *, min(channel) over (partition by subject, c) as f, count(*) over (partition by subject, c) as n from p), d as (select *, dense_rank() over (partition by subject order by f) as id from q) select subject, channel, cast(case when n < 2 then 0 else id end as int) as community from d")
_on_signal("modularity", lambda s: graph.modularity(correlation.strong_edges(correlation.matrix(s)), _FIXED(s)).withColumn("modularity", r6("modularity")), STRONG + ", p as (select distinct subject, channel, length(channel) % 3 as c from sig), e as (select st.subject, r, a.c as ca, b.c as cb from st join p a on st.subject = a.subject and ch_a = a.channel join p b on st.subject = b.subject and ch_b = b.channel), k as (select subject, sum(k * k) as k2 from (select subject, ca, sum(r) as k from e group by all) group by subject) select e.subject, round(sum(case when ca = cb then r else 0 end) / sum(r) - any_value(k2) / (sum(r) * sum(r)), 6) as modularity from e join k using (subject) group by e.subject")
_on_signal("trends_inc", lambda s: segments.with_intervals(segments.trends(s, min_duration=6)).withColumn("height", F.round("height", 4)), RISING + "select subject, channel, start_sec, end_sec, round(height, 4) as height, (start_sec + end_sec) / 2 as center_sec, end_sec - start_sec as length_sec from trends")
_on_signal("trends_dec", lambda s: segments.with_intervals(segments.trends(s, rising=False, min_duration=6)).withColumn("height", F.round("height", 4)), TRENDS.format(sign="d < 0") + "select subject, channel, start_sec, end_sec, round(height, 4) as height, (start_sec + end_sec) / 2 as center_sec, end_sec - start_sec as length_sec from trends")
_on_signal("trend_viewport", lambda s: segments.viewport(segments.trends(s, min_duration=6), 100, 300).select("subject", "channel", "start_sec", "end_sec"), RISING + "select subject, channel, start_sec, end_sec from trends where (start_sec + end_sec) / 2 between 100 and 300")
_on_signal("trend_mask", lambda s: views.trend_plan(s)["mask"], MASK + "select subject, channel, t_idx, time, active from mask")
_on_signal("density", lambda s: views.trend_plan(s)["density"], DENSITY + "select * from density")
_on_signal("high_density", lambda s: views.trend_plan(s)["segments"], HIGH + "select * from high")
_on_signal("high_density_min_peak", lambda s: segments.threshold_segments(views.trend_plan(s)["density"], 2, 4), HIGH + "select * from high where highest_value >= 4")
_on_signal("participation", lambda s: views.trend_plan(s)["participation"], PARTS + "select * from parts")


def _status(s: DataFrame) -> DataFrame:
    name = F.concat_ws("/", F.col("subject").cast("string"), F.col("start_sec").cast("int").cast("string"))
    return views.trend_plan(s)["participation"].select(name.alias("segment"), "channel", "active")


_on_signal("participation_pct", lambda s: statistics.participation_count(_status(s)).withColumn("real_percent", r6("real_percent")), PVAL + "select channel, real_count, round(real_percent, 6) as real_percent from rl")
_on_signal("perm_null", lambda s: statistics.participation_null(_status(s), 1000), NULL + "select * from nul")
_on_signal("perm_pvalues", lambda s: statistics.p_values(statistics.participation_count(_status(s)), statistics.participation_null(_status(s), 1000)).select("channel", r6("p_value").alias("p_value")), PVAL + "select channel, round(p_value, 6) as p_value from pv")
_on_signal("peak_perm_test", lambda s: statistics.participation_test(_status(s), 1000).select("channel", "real_count", r6("real_percent").alias("real_percent"), r6("p_value").alias("p_value"), r6("p_value_corrected").alias("p_value_corrected"), "significant"), BH + "select channel, real_count, round(real_percent, 6) as real_percent, round(p_value, 6) as p_value, round(p_value_corrected, 6) as p_value_corrected, p_value_corrected < 0.05 as significant from bh")
_query(
    "bh_fdr",
    lambda spark, d: statistics.benjamini_hochberg(views.events(spark, d).groupBy("user_id").agg((F.sum((F.col("value") > 90).cast("int")) + 1).alias("k"), (F.count("*") + 1).alias("n")).select("user_id", (F.col("k") / F.col("n")).alias("p_value")), tie=("user_id",)).select("user_id", r6("p_value").alias("p_value"), r6("p_value_corrected").alias("q"), scalar.stars(F.col("p_value_corrected")).alias("mark")),
    "with p as (select user_id, (sum(case when value > 90 then 1 else 0 end) + 1) / (count(*) + 1) as p from events group by user_id), r as (select *, row_number() over (order by p, user_id) as rank, count(*) over () as m from p), q as (select user_id, p, least(min(p * m / rank) over (order by rank desc rows unbounded preceding), 1.0) as q from r) select user_id, round(p, 6) as p_value, round(q, 6) as q, case when q < 0.01 then '**' when q < 0.05 then '*' else '' end as mark from q",
)


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).select((F.col("user_id") % 3).cast("int").alias("subject"), "event_type", "epoch")
    return segments.sessions(e, ("subject",), "epoch", "event_type", 600, 60)


_query("trigger_envelope", _sessions, SESS + 'select subject, start, "end", trigger_value from sessions')
_query("trigger_json", lambda spark, d: segments.session_json(_sessions(spark, d).withColumns({c: F.floor(F.col(c) * 1000) / 1000 for c in ("start", "end")})), SESS + """, ms as (select floor(start * 1000) / 1000 as start, floor("end" * 1000) / 1000 as "end", trigger_value from sessions) select '{"Start":"' || printf('%.3f', start) || '","End":"' || printf('%.3f', "end") || '","Duration":"' || printf('%.3f', "end" - start) || '","Trigger Value":"' || trigger_value || '"}' as json from ms""")


def _mean_series(s: DataFrame) -> DataFrame:
    return s.groupBy(F.col("t_idx").cast("double").alias("time")).agg(F.avg("value").alias("value"))


def _onsets(spark: SparkSession, d: str) -> DataFrame:
    """An onset for each kind of event: the moment of its middle event, in bins."""
    e = views.events(spark, d).select("event_type", ((F.col("epoch") - views.ORIGIN) / views.BIN).alias("onset"), "event_id")
    w = Window.partitionBy("event_type")
    middle = e.withColumns({"k": F.row_number().over(w.orderBy("onset", "event_id")), "n": F.count("*").over(w)}).where(F.col("k") == F.floor(F.col("n") / 2) + 1)
    label = F.when(F.col("event_type") == "view", "on").when(F.col("event_type") == "click", "ing").otherwise("off")
    number = middle.select("event_type").distinct().withColumn("event", F.row_number().over(Window.orderBy("event_type")) - 1)  # a row a kind
    return middle.join(number, "event_type").select("event", label.alias("label"), "onset")


def _epochs(spark: SparkSession, d: str) -> DataFrame:
    return segments.epochs(_mean_series(views.signal_grid(spark, d)), _onsets(spark, d), 6, 6, 12)


_query("event_epochs", lambda spark, d: _epochs(spark, d).select("event", "label", "offset", r6("value").alias("value")), IBC + 'select event, label, off as "offset", round(value, 6) as value from ep')
_query("pre_post_means", lambda spark, d: segments.pre_post(_epochs(spark, d), 5, 5).select("event", "label", r6("pre_mean").alias("pre_mean"), r6("post_mean").alias("post_mean")), IBC + "select event, label, round(pre_mean, 6) as pre_mean, round(post_mean, 6) as post_mean from pp2")
_query("paired_t", lambda spark, d: statistics.paired_t(segments.pre_post(_epochs(spark, d), 5, 5), F.col("post_mean"), F.col("pre_mean")).select("n", r6("mean_diff").alias("mean_diff"), r6("t").alias("t")), IBC + "select count(*) as n, round(avg(post_mean - pre_mean), 6) as mean_diff, round(avg(post_mean - pre_mean) / (stddev_samp(post_mean - pre_mean) / sqrt(count(*))), 6) as t from pp2")
_on_signal("wilcoxon_w", lambda s: statistics.wilcoxon(s.join(s.select("subject", "channel", (F.col("t_idx") - 1).alias("t_idx"), F.col("value").alias("post")), ["subject", "channel", "t_idx"]), F.col("post"), F.col("value"), ("subject", "channel")).select("subject", "channel", "n", "w"), SIG + ", d as (select a.subject, a.channel, b.value - a.value as d from sig a join sig b on a.subject = b.subject and a.channel = b.channel and b.t_idx = a.t_idx + 1 where b.value <> a.value), r as (select subject, channel, d, rank() over (partition by subject, channel order by abs(d)) + (count(*) over (partition by subject, channel, abs(d)) - 1) / 2 as r from d) select subject, channel, count(*) as n, least(coalesce(sum(case when d > 0 then r end), 0), coalesce(sum(case when d < 0 then r end), 0)) as w from r group by subject, channel")
_on_signal("onset_perm", lambda s: statistics.onset_null(_mean_series(s), 3, 6, 6, 12, 100_000).withColumn("diff", r6("diff")), IBC + "select perm, round(diff, 6) as diff from onull")
_on_signal("onset_perm_summary", lambda s: statistics.two_sided(statistics.onset_null(_mean_series(s), 3, 6, 6, 12, 100_000), 5.0).select("n_valid", r6("null_mean").alias("null_mean"), r6("null_std").alias("null_std"), r6("p_value").alias("p_value")), IBC + "select count(*) as n_valid, round(avg(diff), 6) as null_mean, round(stddev_pop(diff), 6) as null_std, round((sum(case when abs(diff) >= 5 then 1 else 0 end) + 1) / (count(*) + 1), 6) as p_value from onull")
_query("null_histogram", lambda spark, d: statistics.histogram(_table("events")(spark, d), "value"), "select cast(least(floor((value - lo) / (hi - lo) * 30), 29) as int) as bin, count(*) as n from events, (select min(value) as lo, max(value) as hi from events) group by 1")
_on_signal("dft_bins", lambda s: spectral.dft_power(s, [1, 2, 3, 4], 120).withColumn("power", F.round("power", 2)), SIG + "select subject, channel, k, round(pow(sum(value * cos(2 * pi() * k * t_idx / 120)), 2) + pow(sum(value * sin(2 * pi() * k * t_idx / 120)), 2), 2) as power from sig, (select cast(unnest(range(1, 5)) as int) as k) group by subject, channel, k")
_on_signal("optical_density", lambda s: spectral.optical_density(s.withColumn("value", F.col("value") + 1)).withColumn("value", r6("value")), SIG + "select subject, channel, t_idx, time, round(-ln((value + 1) / avg(value + 1) over (partition by subject, channel)), 6) as value from sig")
_on_signal("sci_corr", lambda s: spectral.coupling(_two(s), 240).withColumn("sci", r6("sci")), SIG + ", tw as (select a.subject, a.channel, a.time, a.value as x, b.value as y from sig a join sig b on a.channel = b.channel and a.t_idx = b.t_idx and a.subject = b.subject - 1), c as (select subject, channel, cast(floor(time / 240) as int) as win, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) as sci from tw group by all) select subject, channel, win, round(sci, 6) as sci, sci < 0.8 as bad from c")
_on_signal("resample_mean", lambda s: spectral.resample_mean(s, 1 / 24).withColumns({"value": r6("value"), "time": F.round("time", 6)}), SIG + "select subject, channel, cast(floor(time / 24) as int) as t_idx, round(floor(time / 24) * 24.0, 6) as time, round(avg(value), 6) as value from sig group by subject, channel, floor(time / 24)")


def _two(s: DataFrame) -> DataFrame:
    """A channel's two wavelengths, played by a subject and the one after it."""
    other = s.select((F.col("subject") - 1).alias("subject"), "channel", "t_idx", F.col("value").alias("y"))
    return s.select("subject", "channel", "t_idx", "time", F.col("value").alias("x")).join(other, ["subject", "channel", "t_idx"])


# Louvain on the strong edges. A subject has five channels, so SQL can try every assignment of labels and take the best modularity.
LOUVAIN = STRONG + """, nd as (select subject, list(distinct ch_a order by ch_a) as names from st group by subject),
w as (select subject, list_position(names, ch_a) as a, list_position(names, ch_b) as b, r from st join nd using (subject)),
lab as (select subject, names, code, list_transform(range(len(names)), lambda i: (code // cast(pow(len(names), i) as bigint)) % len(names)) as lb from (select subject, names, unnest(range(cast(pow(len(names), len(names)) as bigint))) as code from nd)),
ins as (select l.subject, l.code, sum(case when lb[a] = lb[b] then r else 0 end) / sum(r) as inside, sum(r) as m2 from lab l join w on l.subject = w.subject group by all),
deg as (select l.subject, l.code, lb[a] as c, sum(r) as k from lab l join w on l.subject = w.subject group by all),
mo as (select i.subject, i.code, any_value(inside) - sum(k * k) / any_value(m2 * m2) as q from ins i join deg d on i.subject = d.subject and i.code = d.code group by all),
best as (select subject, arg_max(code, q) as code from mo group by subject),
com as (select subject, unnest(names) as channel, unnest(lb) as c from lab join best using (subject, code)),
fst as (select subject, channel, min(channel) over (partition by subject, c) as f from com)
select subject, channel, cast(dense_rank() over (partition by subject order by f) as int) as community from fst"""
_on_signal("louvain", lambda s: views.connectivity_plan(s)["communities"], LOUVAIN)

#: A Hamming-windowed sinc of `taps` taps, and the signal with mirrored ends under it.
FIR = """, tp as (select n, (({high} - {low}) * (0.54 + 0.46 * cos(2 * pi() * n / ({taps} - 1)))) as h from (select unnest(range(-{half}, {half} + 1)) as n)),
ct as (select subject, channel, count(*) as n from {src} group by all),
fir as (select s.subject, s.channel, s.t_idx, s.time, sum(h * x.{col}) as y from {src} s join ct using (subject, channel) cross join tp join {src} x on x.subject = s.subject and x.channel = s.channel and x.t_idx = case when s.t_idx + tp.n < 0 then -(s.t_idx + tp.n) when s.t_idx + tp.n > ct.n - 1 then 2 * (ct.n - 1) - s.t_idx - tp.n else s.t_idx + tp.n end group by all)
"""
_cut = lambda f, rate=1.0: f"(case when n = 0 then {2 * f / rate!r} else sin(pi() * {2 * f / rate!r} * n) / (pi() * n) end)"
_fir = lambda low, high, taps, src="sig", col="value": FIR.format(low=_cut(low), high=_cut(high), taps=taps, half=taps // 2, src=src, col=col)
_on_signal(
    "beer_lambert",
    lambda s: spectral.beer_lambert(_two(s).unpivot(["subject", "channel", "t_idx", "time"], ["x", "y"], "wavelength", "value"), {"x": (1.5, 3.8), "y": (2.5, 1.8)}, 3.0, 6.0).select("subject", "channel", "t_idx", "time", r6("hbo").alias("hbo"), r6("hbr").alias("hbr")),
    SIG + "select a.subject, a.channel, a.t_idx, a.time, round((1.8 * a.value - 3.8 * b.value) / ((1.5 * 1.8 - 3.8 * 2.5) * 18), 6) as hbo, round((1.5 * b.value - 2.5 * a.value) / ((1.5 * 1.8 - 3.8 * 2.5) * 18), 6) as hbr from sig a join sig b on a.channel = b.channel and a.t_idx = b.t_idx and a.subject = b.subject - 1",
)
_on_signal("band_pass", lambda s: spectral.band_pass(s, 1.0, 0.05, 0.3, 31).withColumn("value", F.round("value", 5)), SIG + _fir(0.05, 0.3, 31) + "select subject, channel, t_idx, time, round(y, 5) as value from fir")
TWO = SIG + ", tw as (select a.subject, a.channel, a.t_idx, a.time, a.value as x, b.value as y from sig a join sig b on a.channel = b.channel and a.t_idx = b.t_idx and a.subject = b.subject - 1)\n"
_on_signal(
    "sci_band_pass",
    lambda s: spectral.coupling(_two(s), 240, band=(0.05, 0.3), taps=31).withColumn("sci", F.round("sci", 5)),
    TWO + _fir(0.05, 0.3, 31, "tw", "x") + _fir(0.05, 0.3, 31, "tw", "y").replace("tp as", "tp2 as").replace("ct as", "ct2 as").replace("fir as", "fir2 as").replace(" join ct using", " join ct2 as ct using").replace("cross join tp ", "cross join tp2 as tp ")
    + ", c as (select a.subject, a.channel, cast(floor(a.time / 240) as int) as win, covar_pop(a.y, b.y) / nullif(stddev_pop(a.y) * stddev_pop(b.y), 0) as sci from fir a join fir2 b on a.subject = b.subject and a.channel = b.channel and a.t_idx = b.t_idx group by all) select subject, channel, win, round(sci, 5) as sci, sci < 0.8 as bad from c",
)
SPEC = """, fr as (select subject, channel, f.i, s.t_idx - f.i * 4 as j, value - avg(value) over (partition by subject, channel, f.i) as v from sig s join (select unnest(range(0, (select count(distinct t_idx) - 40 from sig) // 4 + 1)) as i) f on s.t_idx between f.i * 4 and f.i * 4 + 39),
tw as (select unnest(range(40)) as j, 0.125 as e),
wd as (select j, case when least(j / 40.0::double, 1 - j / 40.0::double) < e then 0.5 * (1 - cos(2 * pi() * least(j / 40.0::double, 1 - j / 40.0::double) / 0.25)) else 1.0 end as w from tw),
sp as (select subject, channel, i, k, (pow(sum(v * w * cos(2 * pi() * k * j / 512)), 2) + pow(sum(v * w * sin(2 * pi() * k * j / 512)), 2)) * 2 / (select sum(w * w) from wd) as p from fr join wd using (j), (select unnest(range(11, 231)) as k) group by all),
mn as (select subject, i, k, avg(p) as p from sp group by all)
select subject, i * 4 + 20.0::double + (select min(time) from sig) as time, arg_max(k, p) / 512.0::double as freq from mn group by subject, i"""
_on_signal("spectrogram_peak", lambda s: spectral.peak_frequency(spectral.spectrogram(s, 1.0, 40, 4, 512, (0.02, 0.45)), s.groupBy("subject").agg(F.min("time").alias("start"))), SIG + SPEC)


def _repair_sql(rounds: int, head: str = SIG, src: str = "sig") -> str:
    """The robust rounds one after the other; a series whose mean has settled keeps its weights."""
    out = head + f", d0 as (select subject, channel, t_idx, value - lag(value) over (partition by subject, channel order by t_idx) as d from {src}), r0 as (select subject, channel, t_idx, d, 1.0::double as w, 1e300::double as mu, false as done from d0 where d is not null)\n"
    for k in range(1, rounds + 1):
        out += f""", a{k} as materialized (select *, case when done then mu else sum(w * d) over s / greatest(sum(w) over s, 1e-300) end as nu from r{k - 1} window s as (partition by subject, channel)),
b{k} as materialized (select *, 1.4826 * median(abs(d - nu)) over (partition by subject, channel) as sg from a{k}),
r{k} as materialized (select subject, channel, t_idx, d, case when done or sg = 0 or abs(nu - mu) <= 1e-12 * greatest(1.0, abs(nu)) then w when abs(d - nu) / (sg * 4.685) < 1 then pow(1 - pow(abs(d - nu) / (sg * 4.685), 2), 2) else 0.0 end as w, nu as mu, done or sg = 0 or abs(nu - mu) <= 1e-12 * greatest(1.0, abs(nu)) as done from b{k})
"""
    return out + f", y as (select s.subject, s.channel, s.t_idx, s.time, s.value, coalesce(sum(w * (d - mu)) over (partition by s.subject, s.channel order by s.t_idx), 0) as y from {src} s left join r{rounds} r on s.subject = r.subject and s.channel = r.channel and s.t_idx = r.t_idx)"


_on_signal("motion_repair", lambda s: spectral.repair_motion(s).withColumn("value", F.round("value", 4)), _repair_sql(50) + " select subject, channel, t_idx, time, round(y - avg(y) over w + avg(value) over w, 4) as value from y window w as (partition by subject, channel)")
# Five of the seven epochs are complete: four degrees of freedom have a closed form, and five pairs 32 sign patterns.
P_VALUES = IBC + ", ds as (select post_mean - pre_mean as d from pp2), st as (select count(*) as n, avg(d) as mean_diff, avg(d) / (stddev_samp(d) / sqrt(count(*))) as t from ds), th as (select *, atan(abs(t) / 2) as a from st)\n"
_query(
    "test_p_values",
    lambda spark, d: statistics.paired_t(segments.pre_post(_epochs(spark, d), 5, 5), F.col("post_mean"), F.col("pre_mean")).withColumn("p", statistics.t_p_value("t", "n")).select("n", *(r6(c).alias(c) for c in ("mean_diff", "t", "p"))),
    P_VALUES + "select n, round(mean_diff, 6) as mean_diff, round(t, 6) as t, round(case when n = 5 then 1 - sin(a) * (1 + pow(cos(a), 2) / 2) end, 6) as p from th",
)
_query(
    "wilcoxon_p",
    lambda spark, d: statistics.wilcoxon(segments.pre_post(_epochs(spark, d), 5, 5), F.col("post_mean"), F.col("pre_mean")).withColumn("p", statistics.wilcoxon_p_value("w", "n", "ties", "ranks")).select("n", "w", r6("p").alias("p")),
    P_VALUES + ", rk as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2 as r from ds where d <> 0), w as (select count(*) as n, least(coalesce(sum(case when d > 0 then r end), 0), coalesce(sum(case when d < 0 then r end), 0)) as w from rk), pat as (select m, (select sum(case when (m // cast(pow(2, r - 1) as bigint)) % 2 = 1 then r else 0 end) from (select unnest(range(1, 6)) as r)) as v from (select unnest(range(32)) as m)) select n, w, round(least(1.0, 2 * (select count(*) from pat where v <= floor(w)) / 32.0), 6) as p from w where n = 5",
)
_query(
    "label_ranked_events",
    lambda spark, d: segments.ranked_events(_table("events")(spark, d).select("user_id", F.col("event_type").alias("label"), F.col("event_id").alias("start")), ["view", "click", "purchase"], ("user_id",)).withColumn("place", F.col("place").cast("long")),
    "select *, row_number() over (partition by user_id order by label_rank nulls last, start) - 1 as place from (select user_id, event_type as label, event_id as start, cast(case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 end as int) as label_rank from events)",
)
_on_signal("density_table", lambda s: segments.density_table(views.trend_plan(s)["density"]), DENSITY + "select *, cast(null as double) as height_mean, cast(null as double) as height_std from density")
_on_signal("first_of_selection", lambda s: segments.trends(segments.first_of(s, s.where("value > 0").select("subject", "channel").distinct()), min_duration=6).withColumn("height", F.round("height", 4)), RISING + "select subject, channel, start_sec, end_sec, round(height, 4) as height from trends where subject || '/' || channel = (select min(subject || '/' || channel) from sig where value > 0)")
_on_signal("uniform_filter", lambda s: signal.smooth(s, 25, reflect=True).withColumn("value", F.round("value", 6)), SIG + ", ct as (select subject, channel, count(*) as n from sig group by all), un as (select s.subject, s.channel, s.t_idx, s.time, avg(x.value) as v from sig s join ct using (subject, channel) cross join (select unnest(range(-12, 13)) as k) o join sig x on x.subject = s.subject and x.channel = s.channel and x.t_idx = case when s.t_idx + k < 0 then -(s.t_idx + k) - 1 when s.t_idx + k >= n then 2 * n - 1 - s.t_idx - k else s.t_idx + k end group by all) select subject, channel, t_idx, time, round(v, 6) as value from un")
_on_signal("trend_ticks", lambda s: segments.trends(s, min_duration=6).select("subject", "channel", "start_sec", F.array_join(scalar.integer_ticks(F.col("start_sec") * 3 + 0.5, F.col("end_sec") * 9 + 0.25).cast("array<string>"), ",").alias("ticks")), RISING + ", tk as (select subject, channel, start_sec, cast(floor(start_sec * 3 + 0.5) as int) as lo, cast(ceil(end_sec * 9 + 0.25) as int) as hi from trends), sp as (select *, (hi - lo) // 4 as raw from tk), sq as (select *, cast(case when raw <= 1 then 1 when raw <= 2 then 2 when raw <= 5 then 5 when raw <= 10 then 10 else round_even(raw / 10, 0) * 10 end as int) as step from sp) select subject, channel, start_sec, array_to_string(list_transform(range(0, cast(ceil((hi - lo) / step) as int) + 1), lambda k: lo + k * step), ',') as ticks from sq")


_on_signal(
    "trend_map",
    lambda s: views.trend_map(s, Region(start_sec=100, end_sec=600)).withColumn("size", r6("size")),
    RISING + ", vw as (select *, (start_sec + end_sec) / 2 as center_sec from trends where (start_sec + end_sec) / 2 between 100 and 600), q as (select subject, quantile_cont(height, 0.02) as a, quantile_cont(height, 0.98) as b from vw group by subject), rw as (select subject, channel, cast(dense_rank() over (partition by subject order by channel) - 1 as int) as row from (select distinct subject, channel from sig)) select vw.subject, vw.channel, row, start_sec, end_sec, center_sec, round(case when a = b then 7.55 else 0.1 + (least(greatest(height, a), b) - a) / nullif(b - a, 0) * 14.9 end, 6) as size from vw join q using (subject) join rw on vw.subject = rw.subject and vw.channel = rw.channel",
)
_query("epoch_map", lambda spark, d: views.epoch_map(_epochs(spark, d), ["on", "ing", "off"]).select(F.col("row").cast("int").alias("row"), "event", "label", "offset", r6("value").alias("value")), IBC + """, evm as (select event, cast(row_number() over (order by case label when 'on' then 0 when 'ing' then 1 else 2 end, event) - 1 as int) as row from (select distinct event, label from ep)) select row, ep.event, label, off as "offset", round(value, 6) as value from ep join evm on ep.event = evm.event""")
_on_signal("waveform_grid", lambda s: views.waveform_grid(s, 2).select("subject", "channel", "row", F.col("col").cast("int").alias("col"), "t_idx", "time", r6("value").alias("value")), SIG + ", q as (select subject, channel, quantile_cont(value, 0.02) as a, quantile_cont(value, 0.98) as b from sig group by all), pl as (select subject, channel, dense_rank() over (partition by subject order by channel) - 1 as p from (select distinct subject, channel from sig)) select s.subject, s.channel, cast(p // 2 as int) as row, cast(p % 2 as int) as col, t_idx, time, round(case when a = b then 0.5 else (least(greatest(value, a), b) - a) / nullif(b - a, 0) end, 6) as value from sig s join q on s.subject = q.subject and s.channel = q.channel join pl on s.subject = pl.subject and s.channel = pl.channel")


_query("must_match_lookup", lambda spark, d: signal.must_match(_table("nation")(spark, d), _table("region")(spark, d).withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_name", "r_name"), "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
_query("label_rgb", lambda spark, d: _table("nation")(spark, d).select("n_name", *(F.round(c, 6).alias(n) for n, c in zip("rgb", scalar.md5_rgb(F.col("n_name")), strict=True)), scalar.md5_mod(F.col("n_name"), 20).alias("colour")), "select n_name, " + ", ".join(f"round(('0x' || substr(md5(n_name), {2 * k + 1}, 2))::bigint / 255.0::double, 6) as {n}" for k, n in enumerate("rgb")) + ", cast(list_reduce(list_prepend(0::bigint, list_transform(range(1, 33), lambda i: ('0x' || substr(md5(n_name), i, 1))::bigint)), lambda a, x: (a * 16 + x) % 20) as int) as colour from nation")
_query("event_head_tail", lambda spark, d: signal.head_tail(_table("events")(spark, d).select("event_type", "event_id"), "event_id", 5, ("event_type",)), "select event_type, event_id, count from (select event_type, event_id, count(*) over (partition by event_type) as count, row_number() over (partition by event_type order by event_id) as a, row_number() over (partition by event_type order by event_id desc) as b from events) where a <= 5 or b <= 5")
_on_signal("interval_membership_union", lambda s: s.withColumn("inside", scalar.in_any(F.col("time"), [(10, 40), (30, 66), (500, 510)])), SIG + "select *, time between 10 and 40 or time between 30 and 66 or time between 500 and 510 as inside from sig")
_on_signal("mask_wide", lambda s: _wide(_known(views.trend_plan(s)["mask"]).withColumnRenamed("active", "value")), MASK + ", kn as (select *, 'ch' || dense_rank() over (order by channel) as c from mask) select subject, time, " + ", ".join(f"max(case when c = '{c}' then active end) as {c}" for c in WIDE) + " from kn group by subject, time")
_on_signal("conn_wide", lambda s: _wide_matrix(s), MATRIX + ", k as (select subject, 'ch' || dense_rank() over (order by ch_a) as a, 'ch' || dense_rank() over (order by ch_b) as b, r from mx) select subject, a, " + ", ".join(f"round(max(case when b = '{c}' then r end), 6) as {c}" for c in WIDE) + " from k group by subject, a")


# The layout operators on the driver's tables: segments of customers as channels, nations as regions, suppliers as sensors.
def _shares(spark: SparkSession, d: str) -> DataFrame:
    c = _table("customer")(spark, d).groupBy(F.col("c_mktsegment").alias("channel"), F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    pct = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("channel"))
    return signal.must_match(c, _table("nation")(spark, d).select("n_nationkey", F.col("n_name").alias("region")), "n_nationkey").select("channel", "region", pct.alias("pct"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    n = _table("nation")(spark, d)
    return n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("channel"), (F.col("n_nationkey") * 7 % 25).cast("double").alias("x"), (F.length("n_name") + F.col("n_regionkey")).cast("double").alias("y"))


SHARES = "with c as (select c_mktsegment as channel, n_name as region, count(*) as n from customer join nation on c_nationkey = n_nationkey group by all), atlas as (select channel, region, n * 100.0 / sum(n) over (partition by channel) as pct from c)"
PLACES = "with s as (select n_nationkey as pos, n_name as channel, cast(n_nationkey * 7 % 25 as double) as x, cast(length(n_name) + n_regionkey as double) as y from nation)"
_query("topk_regions_of_segments", lambda spark, d: layout.top_regions(_shares(spark, d), 3, 100).select("channel", "region", r6("pct").alias("pct"), "place"), SHARES + " select channel, region, round(pct, 6) as pct, cast(place as int) as place from (select *, row_number() over (partition by channel order by pct desc, region) as place from atlas) where place <= 3 and pct >= 1")
_query("region_colours_of_segments", lambda spark, d: layout.region_colours(_shares(spark, d)), SHARES + " select region, cast((dense_rank() over (order by region) - 1) % 20 as int) as colour from (select distinct region from atlas)")
_query("first_part_by_name", lambda spark, d: layout.first_by_name(_table("part")(spark, d).select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("channel")), scalar.text_name(F.col("channel"))).select("pos", "channel", "phys"), r"select pos, channel, phys from (select p_partkey as pos, p_name as channel, regexp_extract(p_name, '^\s*(\S+)', 1) as phys, row_number() over (partition by regexp_extract(p_name, '^\s*(\S+)', 1) order by p_partkey) as n from part) where n = 1")
_query("normalized_nations", lambda spark, d: layout.normalize_positions(_places(spark, d), 0.05, 0.03).select("pos", r6("x").alias("x"), r6("y").alias("y")), PLACES + ", n as (select pos, 0.01 + (x - min(x) over ()) / (max(x) over () - min(x) over ()) * 0.98 as x, 0.05 + (y - min(y) over ()) / (max(y) over () - min(y) over ()) * 0.85 as y from s), p as (select pos, least(greatest(x * 0.9 + 0.05, 0.05), 0.95) as x, least(greatest(y * 0.94 + 0.03, 0.03), 0.97) as y from n) select pos, round(max(x) over () + min(x) over () - x, 6) as x, round(max(y) over () + min(y) over () - y, 6) as y from p")
_query("ordered_nations", lambda spark, d: layout.y_axis_order(_places(spark, d)).select("channel", "side", "y_order"), PLACES + ", m as (select *, x - (select median(x) from s) as o from s), t as (select *, case when abs(o) < 1e-6 then 'midline' when o < 0 then 'right' else 'left' end as side from m) select channel, side, cast(row_number() over (order by case side when 'left' then 0 when 'midline' then 1 else 2 end, case side when 'left' then y when 'midline' then x else -y end, case side when 'midline' then 0 else -x end, channel) - 1 as int) as y_order from t")
_query("scaled_sizes", lambda spark, d: _table("part")(spark, d).select("p_partkey", scalar.unit_scale((F.lit(0.1) + F.col("p_size") / 600) * F.when(F.col("p_partkey") % 3 == 0, 1.0).when(F.col("p_partkey") % 3 == 1, 100.0).otherwise(1000.0)).alias("scale")), "select p_partkey, case p_partkey % 3 when 0 then 1.0::double when 1 then 0.01::double else 0.001::double end as scale from part")
_query(
    "remap_idx_coalesce",
    lambda spark, d: files.metadata_with_index(_table("nation")(spark, d).select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("channel_name"), F.length("n_name").alias("x")), _table("customer")(spark, d).groupBy("c_nationkey").agg(F.count("*").alias("n")).where("n % 2 = 0").join(_table("nation")(spark, d), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("channel_name"), F.col("n").alias("channel_idx"))).select("channel_name", "x", "channel_idx"),
    "select n_name as channel_name, length(n_name) as x, cast(coalesce(case when n % 2 = 0 then n end, n_nationkey + 1) as int) as channel_idx from nation left join (select c_nationkey, count(*) as n from customer group by c_nationkey) on c_nationkey = n_nationkey",
)
def _atlas_lines(spark: SparkSession, d: str) -> DataFrame:
    """Nations as an atlas file: the first one of each region opens a block."""
    first = F.col("n_nationkey") == F.min("n_nationkey").over(Window.partitionBy("n_regionkey"))
    head = F.when(first, F.format_string("CH%d (S%d-D1)", "n_regionkey", "n_regionkey")).otherwise("")
    return _table("nation")(spark, d).select((F.col("n_regionkey") * 1000 + F.col("n_nationkey")).alias("line"), head.alias("head"), F.when(F.length("n_name") > 5, F.col("n_name")).otherwise("").alias("region"), (F.col("n_nationkey") * 1.5).cast("string").alias("pct"))


_query("filled_nation_blocks", lambda spark, d: files.atlas_blocks(_atlas_lines(spark, d)), "select 'S' || n_regionkey || '_D1' as channel, n_name as region, n_nationkey * 1.5::double as pct from nation where length(n_name) > 5")


def _wide_matrix(s: DataFrame) -> DataFrame:
    m = correlation.matrix(s)
    side = lambda c, name: _places_of(m, "ch_a").select(F.col("ch_a").alias(c), F.col("_name").alias(name))
    named = m.join(side("ch_a", "time"), "ch_a").join(side("ch_b", "channel"), "ch_b")
    return signal.to_wide(named.select("subject", "time", "channel", r6("r").alias("value")), _names(m, "ch_a")).withColumnRenamed("time", "a")


# Sets of intervals: each event of value v opens v minutes from its moment on.
def _spans(spark: SparkSession, d: str) -> DataFrame:
    return views.events(spark, d).select("event_type", F.col("epoch").alias("start"), (F.col("epoch") + F.col("value") * 60).alias("end"))


SPANS = """with sp as (select event_type, epoch_us(ts) / 1000000.0 as a, epoch_us(ts) / 1000000.0 + value * 60 as b from events),
bf as (select *, max(b) over (partition by event_type order by a, b rows between unbounded preceding and 1 preceding) as far from sp),
rn as (select *, sum(case when far is null or a > far then 1 else 0 end) over (partition by event_type order by a, b rows unbounded preceding) as run from bf),
un as (select event_type, min(a) as start, max(b) as "end", count(*) as n from rn group by event_type, run)
"""
_query("interval_union", lambda spark, d: intervals.union(_spans(spark, d), ("event_type",)), SPANS + 'select event_type, start, "end", n from un')
_query(
    "interval_overlap",
    lambda spark, d: intervals.intersection(_spans(spark, d), 2, ("event_type",)),
    # Where two are open: the union of what each has in common with those that began before it.
    SPANS + """, ov as (select event_type, a, least(b, far) as b from bf where far >= a),
of as (select *, max(b) over (partition by event_type order by a, b rows between unbounded preceding and 1 preceding) as far from ov),
og as (select *, sum(case when far is null or a > far then 1 else 0 end) over (partition by event_type order by a, b rows unbounded preceding) as run from of)
select event_type, min(a) as start, max(b) as "end" from og group by event_type, run""",
)
_query(
    "intervals_open",
    lambda spark, d: intervals.inside(views.signal_grid(spark, d).withColumn("at", F.col("time") * 3600 + views.ORIGIN), _spans(spark, d).withColumnRenamed("event_type", "channel"), ("channel",), "at").select("subject", "channel", "t_idx", "n_open"),
    SIG + "select subject, channel, t_idx, (select count(*) from events e where e.event_type = sig.channel and epoch_us(e.ts) / 1000000.0 <= time * 3600 + 1704067200 and time * 3600 + 1704067200 <= epoch_us(e.ts) / 1000000.0 + e.value * 60) as n_open from sig",
)
# Runs that overlap and hold one another: every sample above 60 opens a run of value / 8 hours.
_on_signal(
    "mask_overlapping",
    lambda s: segments.mask(s, s.where("value > 60").select("subject", "channel", F.col("time").alias("start_sec"), (F.col("time") + F.col("value") / 8).alias("end_sec"))),
    SIG + "select s.subject, s.channel, s.t_idx, s.time, cast(max(case when r.time is not null then 1 else 0 end) as int) as active from sig s left join sig r on r.subject = s.subject and r.channel = s.channel and r.value > 60 and s.time between r.time and r.time + r.value / 8 group by all",
)
_on_signal(
    "filter_bands",
    lambda s: spectral.filter_bands(s, 1.0, [(0.05, 0.3, 0.02, 0.1), (0.1, 0.4, 0.1, 0.1)]).withColumn("value", F.round("value", 5)),
    SIG + _fir(0.04, 0.35, 165) + _fir(0.05, 0.45, 33).replace("tp as", "tp2 as").replace("ct as", "ct2 as").replace("fir as", "fir2 as").replace(" join ct using", " join ct2 as ct using").replace("cross join tp ", "cross join tp2 as tp ")
    + "select subject, channel, t_idx, time, round(y, 5) as value, 0 as band from fir union all select subject, channel, t_idx, time, round(y, 5), 1 from fir2",
)


def _recursion(rate: float, cutoff: float) -> str:
    """The low-pass as a recursion over samples, forwards (fw) and then backwards (lp), each begun from the state of a constant series."""
    b, a = blocks.butterworth(3, 2 * cutoff / rate)
    still = blocks.Recursive(b, a).still
    b, a, still = ([float(x) for x in c] for c in (b, a, still))
    one = lambda name, src, col, order: f""", {name}_in as (select subject, channel, {col} as x, row_number() over (partition by subject, channel order by t_idx {order}) as k, t_idx from {src}),
{name} as (select i.subject, i.channel, i.t_idx, i.k, {b[0]!r} * i.x + {still[0]!r} * i.x as y, {b[1]!r} * i.x - {a[1]!r} * ({b[0]!r} * i.x + {still[0]!r} * i.x) + {still[1]!r} * i.x as z1, {b[2]!r} * i.x - {a[2]!r} * ({b[0]!r} * i.x + {still[0]!r} * i.x) + {still[2]!r} * i.x as z2, {b[3]!r} * i.x - {a[3]!r} * ({b[0]!r} * i.x + {still[0]!r} * i.x) as z3 from {name}_in i where k = 1
union all select i.subject, i.channel, i.t_idx, i.k, {b[0]!r} * i.x + z1, {b[1]!r} * i.x - {a[1]!r} * ({b[0]!r} * i.x + z1) + z2, {b[2]!r} * i.x - {a[2]!r} * ({b[0]!r} * i.x + z1) + z3, {b[3]!r} * i.x - {a[3]!r} * ({b[0]!r} * i.x + z1) from {name} p join {name}_in i on i.subject = p.subject and i.channel = p.channel and i.k = p.k + 1)
"""  # noqa: E731
    return SIG.replace("with ev", "with recursive ev", 1) + one("fw", "sig", "value", "") + one("lp", "fw", "y", "desc")


_on_signal("low_pass", lambda s: blocks.low_pass(s, 11.0).select("subject", "channel", "t_idx", F.round("low", 5).alias("low")), _recursion(11.0, 0.5) + "select subject, channel, t_idx, round(y, 5) as low from lp")
_on_signal(
    "motion_repair_split",
    lambda s: spectral.repair_motion(s, rate=11.0).withColumn("value", F.round("value", 3)),
    _repair_sql(50, _recursion(11.0, 0.5) + ", low as (select s.subject, s.channel, s.t_idx, s.time, lp.y as value from sig s join lp on s.subject = lp.subject and s.channel = lp.channel and s.t_idx = lp.t_idx)", "low")
    + ", fx as (select subject, channel, t_idx, time, y - avg(y) over w + avg(value) over w - value as moved from y window w as (partition by subject, channel)) select s.subject, s.channel, s.t_idx, s.time, round(s.value + moved, 3) as value from sig s join fx using (subject, channel, t_idx)",
)
# Whole numbers with many ties: customers of each nation, modulo 4, around 1; a region has five nations, so SQL tries 32 sign patterns.
_query(
    "wilcoxon_ties",
    lambda spark, d: statistics.wilcoxon(_table("nation")(spark, d).join(_table("customer")(spark, d).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")), "n_nationkey"), (F.col("n") % 4).cast("double"), F.lit(1.0), ("n_regionkey",)).withColumn("p", statistics.wilcoxon_p_value("w", "n", "ties", "ranks")).select("n_regionkey", "n", "w", r6("p").alias("p")),
    """with ds as (select n_regionkey, n_nationkey, c % 4 - 1 as d from nation join (select c_nationkey, count(*) as c from customer group by c_nationkey) on c_nationkey = n_nationkey where c % 4 <> 1),
rk as (select *, rank() over (partition by n_regionkey order by abs(d)) + (count(*) over (partition by n_regionkey, abs(d)) - 1) / 2 as r, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as k from ds),
st as (select n_regionkey, count(*) as n, least(coalesce(sum(case when d > 0 then r end), 0), coalesce(sum(case when d < 0 then r end), 0)) as w from rk group by n_regionkey),
pt as (select n_regionkey, m, sum(case when (m // cast(pow(2, k) as bigint)) % 2 = 1 then r else 0 end) as v from rk, (select unnest(range(32)) as m) group by n_regionkey, m)
select st.n_regionkey, n, cast(w as double) as w, round(least(1.0, 2 * sum(case when v <= w then 1 else 0 end) / 32.0), 6) as p from st join pt using (n_regionkey) group by all""",
)
_on_signal(
    "trend_table",
    lambda s: segments.trend_table(segments.trends(s, min_duration=6), s).withColumn("height", F.round("height", 4)),
    RISING + ", nm as (select subject, channel, cast(dense_rank() over (partition by subject order by channel) as int) as ch_idx from (select distinct subject, channel from sig)) select t.subject, ch_idx, start_sec, end_sec, (start_sec + end_sec) / 2 as center_sec, end_sec - start_sec as length_sec, round(height, 4) as height from trends t join nm on t.subject = nm.subject and t.channel = nm.channel",
)
_on_signal(
    "coupling_table",
    lambda s: spectral.coupling_table(spectral.coupling(_two(s), 240), [0, 1, 2], 240.0, 5.0).select("subject", "channel", *(f(f"{k}_{t}").alias(f"{k}_{t}") for k, f in (("score", r6), ("over", F.col)) for t in (5, 245, 485))),
    SIG + ", tw as (select a.subject, a.channel, a.time, a.value as x, b.value as y from sig a join sig b on a.channel = b.channel and a.t_idx = b.t_idx and a.subject = b.subject - 1), c as (select subject, channel, cast(floor(time / 240) as int) as win, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) as sci from tw group by all) select subject, channel, "
    + ", ".join(f"round(max(case when win = {k} then sci end), 6) as score_{k * 240 + 5}, max(case when win = {k} then sci end) > 0.8 as over_{k * 240 + 5}" for k in range(3))
    + " from c group by subject, channel",
)
_query(
    "rates_in_view",
    lambda spark, d: views.rates_in_view(views.events(spark, d).select((F.col("user_id") % 3).cast("int").alias("subject"), ((F.col("epoch") - views.ORIGIN) / 3600).alias("time"), (1 + F.col("value") / 150).alias("freq")), Region(start_sec=100, end_sec=400)).select("subject", F.round("time", 4).alias("time"), r6("freq").alias("freq"), "drawn"),
    "with r as (select cast(user_id % 3 as int) as subject, (epoch_us(ts) / 1000000.0 - 1704067200) / 3600 as time, 1 + value / 150 as freq from events) select subject, round(time, 4) as time, round(freq, 6) as freq, freq between 1.0 and 1.5 as drawn from r where time between 100 and 400",
)


def queries() -> dict[str, Plan]:
    return {name: plan for name, (plan, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all.items() if sql}
