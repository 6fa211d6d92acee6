"""Series and array queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import series as S
from ..operators import similarity as C
from .common import SAMPLES, SERIES, rounded, series, table, traces

KEY, ORDER = ["user_id"], ["i"]


def derivative(spark, sf_dir):
    return S.derivative(series(spark, sf_dir), KEY, ORDER, "v", 0.5).select("event_id", rounded("derivative").alias("derivative"))


def rolling_mean(spark, sf_dir):
    return S.rolling_mean(series(spark, sf_dir), KEY, ORDER, "v", 5).select("event_id", rounded("rolling_mean").alias("rolling_mean"))


def rolling_median(spark, sf_dir):
    return S.rolling_median(series(spark, sf_dir), KEY, ORDER, "v", 4).select("event_id", rounded("rolling_median").alias("rolling_median"))


def zscore(spark, sf_dir):
    return S.zscore(series(spark, sf_dir), KEY, "v").select("event_id", rounded("zscore").alias("zscore"), "error")


def minmax(spark, sf_dir):
    return S.minmax(series(spark, sf_dir), KEY, "v").select("event_id", rounded("minmax").alias("minmax"), "error")


def robust(spark, sf_dir):
    return S.robust(series(spark, sf_dir), KEY, "v").select("event_id", rounded("robust").alias("robust"), "error")


def gap_fill(spark, sf_dir):
    gaps = series(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("v")))
    return S.gap_fill(gaps, KEY, ORDER, "v").select("event_id", rounded("filled").alias("filled"))


def run_lengths(spark, sf_dir):
    return S.run_lengths(series(spark, sf_dir), KEY, ORDER, "event_type", "i").select("user_id", "event_type", "run", "rows", "top", "bottom")


def smooth_labels(spark, sf_dir):
    return S.smooth_labels(series(spark, sf_dir), KEY, ORDER, "event_type", 5).select("event_id", "smoothed")


def smooth_labels_in_stretches(spark, sf_dir):
    kept = series(spark, sf_dir).filter(F.col("event_id") % 7 != 0)
    parts = S.consecutive(kept, KEY, "i")
    return S.smooth_labels(parts, [*KEY, "stretch"], ORDER, "event_type", 3, noise="view").select("event_id", "stretch", "smoothed")


def boxcar(spark, sf_dir):
    return S.boxcar(series(spark, sf_dir), KEY, ORDER, "v", 7).select("event_id", rounded("boxcar").alias("boxcar"))


def histogram(spark, sf_dir):
    return S.histogram(series(spark, sf_dir), KEY, "v", 8).select("user_id", "bin", "n_values")


def station_path(spark, sf_dir):
    s = series(spark, sf_dir).withColumns({"length": (F.col("i") + 1) * 10.0, "dip": F.col("v") % 90, "azimuth": F.col("v") % 360})
    return S.station_path(s, KEY, ORDER, "length", "dip", "azimuth").select("event_id", *(rounded(c, 4).alias(c) for c in "xyz"))


def path_length(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("x", F.col("event_id") % 101)
    return S.path_length(s, KEY, ORDER, "x", "v").select("user_id", rounded("length", 4).alias("length"))


def position_means(spark, sf_dir):
    return S.position_means(traces(spark, sf_dir), ["label"], "a").select("label", "position", rounded("mean").alias("mean"), "n_arrays")


def _curves(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.select("user_id", "event_type", "event_id", (F.dayofmonth("ts") + F.lit(0.1)).alias("d"), "v")


def align_curves(spark, sf_dir):
    return S.align(_curves(spark, sf_dir), ["click", "view"], KEY, "d", "event_type", "v", "event_id", 3)


def complete_depths(spark, sf_dir):
    return S.complete_depths(_curves(spark, sf_dir), KEY, "d", "event_type", ["click", "view", "purchase"]).select("user_id", rounded("d").alias("d"))


def same_grid(spark, sf_dir):
    s = series(spark, sf_dir).select("user_id", "event_id", "i", "n")
    curves = s.withColumns({"curve": F.col("i") % 2, "d": F.floor(F.col("i") / 2) * 0.5 + F.when((F.col("user_id") % 3 == 0) & (F.col("i") == F.col("n") - 1), 0.25).otherwise(0.0)})
    return S.same_grid(curves, KEY, "curve", "d")


def array_statistics(spark, sf_dir):
    a = F.col("a")
    return traces(spark, sf_dir).select(
        "vec_id", rounded(A.mean(a)).alias("mean"), rounded(F.array_max(a)).alias("max"), A.argmax(a).cast("long").alias("at_max"), rounded(A.std(a)).alias("std"),
        rounded(A.moment(a, 2)).alias("var"), rounded(A.skewness(a), 5).alias("skew"), rounded(A.kurtosis(a), 5).alias("kurt"), rounded(A.total(a), 5).alias("sum"), rounded(A.trapezoid(a), 5).alias("area"),
    )


def array_shape(spark, sf_dir):
    a = F.col("a")
    return traces(spark, sf_dir).select(
        "vec_id", rounded(A.teager(a)).alias("teager"), rounded(A.steepness(a)).alias("steepness"), A.count_peaks(a).cast("long").alias("peaks"),
        rounded(A.entropy(A.histogram(a, 10)), 5).alias("shannon"), rounded(A.permutation_entropy(a), 5).alias("permutation"),
    )


def array_resample(spark, sf_dir):
    return traces(spark, sf_dir).select("vec_id", F.posexplode(A.resample(F.col("a"), 20)).alias("k", "x")).select("vec_id", "k", rounded("x").alias("x"))


def array_block_means(spark, sf_dir):
    return traces(spark, sf_dir).select("vec_id", F.posexplode(A.block_means(F.col("a"), 10)).alias("k", "x")).select("vec_id", "k", rounded("x").alias("x"))


def array_histogram(spark, sf_dir):
    return traces(spark, sf_dir).select("vec_id", F.posexplode(A.histogram(F.col("a"), 6)).alias("bin", "n_values")).select("vec_id", "bin", F.col("n_values").cast("long").alias("n_values"))


def array_ranks(spark, sf_dir):
    return traces(spark, sf_dir).select("vec_id", F.posexplode(A.ranks(F.transform("a", lambda x: F.round(x, 1)))).alias("i", "rank"))


def array_extrema(spark, sf_dir):
    return traces(spark, sf_dir).select("vec_id", F.posexplode(A.extrema(F.col("a"))).alias("i", "mark"))


def array_savgol(spark, sf_dir):
    return traces(spark, sf_dir).select("vec_id", F.posexplode(A.savgol(F.col("a"), 5, 2)).alias("i", "x")).select("vec_id", "i", rounded("x").alias("x"))


def depth_slice(spark, sf_dir):
    """One sample of all traces, and samples of an interval in long form."""
    return traces(spark, sf_dir).select("vec_id", rounded(F.try_element_at("a", F.lit(13))).alias("amplitude"))


def trace_similarity(spark, sf_dir):
    """Median cosine and Pearson similarity of each test trace (the stated set whose id is divisible by 20) to all other traces."""
    t = traces(spark, sf_dir)
    return C.median_similarities(t.filter("vec_id % 20 = 0"), t, "vec_id", "a").select(F.col("id").alias("vec_id"), rounded("cosine").alias("cosine"), rounded("pearson").alias("pearson"))


def previous_trace_correlation(spark, sf_dir):
    """Correlation of each trace with the one before it of its label; the first has none."""
    from pyspark.sql import Window as W

    t = traces(spark, sf_dir).withColumn("b", F.lag("a").over(W.partitionBy("label").orderBy("vec_id")))
    return t.select("vec_id", rounded(A.pearson(F.col("a"), F.col("b"))).alias("k_r"))


def label_windows(spark, sf_dir):
    """Places within reach of a marked place, cut at the ends."""
    o = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(A.label_window(F.col("n_nationkey"), 3, F.lit(25))).alias("place"))
    return o.select("n_nationkey", F.col("place").cast("long").alias("place"))


def sliding_windows(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(A.windows(F.col("n_nationkey") + 5, 8, 3)).alias("start"))
    return n.select("n_nationkey", F.col("start").cast("long").alias("start"))


_S = f"with {SERIES}"
_P = f"with {SAMPLES}"

QUERIES = {
    "series_derivative": (derivative, f"""{_S}, w as (select *, lag(v) over k as a, lead(v) over k as b from s window k as (partition by user_id order by i))
        select event_id, round(case when a is null and b is null then null when a is null then (b - v) / 0.5 when b is null then (v - a) / 0.5 else (b - a) / 1.0 end, 6) as derivative from w"""),
    "series_rolling_mean": (rolling_mean, f"""{_S} select a.event_id, round(avg(b.v), 6) as rolling_mean from s a join s b on a.user_id = b.user_id and a.n >= 5
        and b.i >= greatest(0, least(a.n, greatest(0, a.i - 2) + 5) - 5) and b.i < greatest(0, least(a.n, greatest(0, a.i - 2) + 5) - 5) + 5 group by a.event_id"""),
    "series_rolling_median": (rolling_median, f"""{_S} select a.event_id, round(quantile_cont(b.v, 0.5), 6) as rolling_median from s a join s b on a.user_id = b.user_id
        and b.i >= greatest(0, least(a.n, greatest(0, a.i - 2) + 4) - 4) and b.i < greatest(0, least(a.n, greatest(0, a.i - 2) + 4) - 4) + 4 group by a.event_id"""),
    "series_zscore": (zscore, f"""{_S}, g as (select user_id, avg(v) as m, stddev_pop(v) as d from s group by 1)
        select event_id, round(case when d > 0 then (v - m) / d end, 6) as zscore, case when d = 0 then 'zero_std' end as error from s join g using (user_id)"""),
    "series_minmax": (minmax, f"""{_S}, g as (select user_id, min(v) as a, max(v) as b from s group by 1)
        select event_id, round(case when b > a then (v - a) / (b - a) end, 6) as minmax, case when a = b then 'zero_range' end as error from s join g using (user_id)"""),
    "series_robust": (robust, f"""{_S}, g as (select user_id, quantile_cont(v, 0.25) as a, quantile_cont(v, 0.5) as m, quantile_cont(v, 0.75) as b from s group by 1)
        select event_id, round(case when b > a then (v - m) / (b - a) end, 6) as robust, case when a = b then 'zero_iqr' end as error from s join g using (user_id)"""),
    "series_gap_fill": (gap_fill, f"""{_S}, k as (select user_id, i, v from s where event_id % 3 <> 0), c as (select user_id, count(*) as c from k group by 1),
        b as (select s.event_id, s.user_id, s.i, max(k.i) filter (where k.i <= s.i) as i0, min(k.i) filter (where k.i >= s.i) as i1 from s left join k using (user_id) group by 1, 2, 3)
        select b.event_id, round(case when i0 = i1 then x.v when c < 2 or c is null then null when i0 is null then y.v when i1 is null then x.v else x.v + (y.v - x.v) * (b.i - i0) / (i1 - i0) end, 6) as filled
        from b left join c using (user_id) left join k x on x.user_id = b.user_id and x.i = i0 left join k y on y.user_id = b.user_id and y.i = i1"""),
    "series_run_lengths": (run_lengths, f"""{_S}, a as (select *, case when i = 0 then 0 when event_type is distinct from lag(event_type) over (partition by user_id order by i) then 1 else 0 end as nw from s),
        r as (select *, sum(nw) over (partition by user_id order by i) as run from a), g as (select user_id, run, any_value(event_type) as event_type, count(*) as rows, min(i) as top, max(i) as last from r group by 1, 2)
        select user_id, event_type, cast(run as bigint) as run, rows, top, coalesce(lead(top) over (partition by user_id order by run), last) as bottom from g"""),
    "series_smooth_labels": (smooth_labels, f"""{_S}, j as (select a.event_id, b.event_type, count(*) as c, min(b.i) as f from s a join s b on a.user_id = b.user_id and b.i between a.i - 2 and a.i + 2 group by 1, 2)
        select event_id, arg_max(event_type, c * 1000000 - f) as smoothed from j group by 1"""),
    "series_smooth_labels_in_stretches": (smooth_labels_in_stretches, f"""{_S}, e as (select *, i - row_number() over (partition by user_id order by i) as stretch from s where event_id % 7 <> 0),
        j as (select a.event_id, b.event_type, count(*) as c, min(b.i) as f from e a join e b on a.user_id = b.user_id and a.stretch = b.stretch and b.i between a.i - 1 and a.i + 1 and b.event_type <> 'view' group by 1, 2),
        m as (select event_id, arg_max(event_type, c * 1000000 - f) as w from j group by 1)
        select event_id, stretch, case when event_type = 'view' then event_type else coalesce(w, event_type) end as smoothed from e left join m using (event_id)"""),
    "series_boxcar": (boxcar, f"""{_S} select a.event_id, round(avg(b.v), 6) as boxcar from s a join s b on a.user_id = b.user_id and b.i between a.i and a.i + 6 where a.i + 7 <= a.n group by 1"""),
    "series_histogram": (histogram, f"""{_S}, g as (select user_id, min(v) as a, max(v) as b from s group by 1)
        select user_id, cast(case when b > a then least(floor((v - a) * 8 / (b - a)), 7) else 0 end as int) as bin, count(*) as n_values from s join g using (user_id) group by 1, 2"""),
    "series_station_path": (station_path, f"""{_S}, l as (select event_id, user_id, i, 10.0 as leg, radians(180 - v % 90) as t, radians(v % 360) as u from s)
        select event_id, round(sum(leg * sin(t) * sin(u)) over k, 4) as x, round(sum(leg * sin(t) * cos(u)) over k, 4) as y, round(sum(leg * cos(t)) over k, 4) as z from l window k as (partition by user_id order by i)"""),
    "series_path_length": (path_length, f"""{_S}, l as (select user_id, sqrt(power(event_id % 101 - lag(event_id % 101) over k, 2) + power(v - lag(v) over k, 2)) as leg from s window k as (partition by user_id order by i))
        select user_id, round(coalesce(sum(leg), 0), 4) as length from l group by 1"""),
    "series_position_means": (position_means, f"""{_P} select label, cast(i as int) as position, round(avg(x), 6) as mean, count(*) as n_arrays from p group by 1, 2"""),
    "series_align_curves": (align_curves, f"""{_S}, c as (select user_id, round_even(day(ts) + 0.1::double, 3) as depth, event_type, arg_min(v, event_id) as v from s where event_type in ('click', 'view') group by 1, 2, 3)
        select user_id, depth, max(v) filter (where event_type = 'click') as click, max(v) filter (where event_type = 'view') as view from c group by 1, 2 having count(*) = 2"""),
    "series_complete_depths": (complete_depths, f"""{_S} select user_id, round(day(ts) + 0.1::double, 6) as d from s where event_type in ('click', 'view', 'purchase') group by 1, 2 having count(distinct event_type) = 3"""),
    "series_same_grid": (same_grid, f"""{_S}, c as (select user_id, i % 2 as curve, list(floor(i / 2) * 0.5 + case when user_id % 3 = 0 and i = n - 1 then 0.25 else 0 end order by i) as d from s group by 1, 2)
        select user_id, count(*) as curves, count(distinct d) = 1 as compatible from c group by 1"""),
    "array_statistics": (array_statistics, f"""{_P}, g as (select vec_id, avg(x) as m, max(x) as mx, var_pop(x) as vr, sum(x) as sm, first(x order by i) + last(x order by i) as e from p group by 1)
        select vec_id, round(any_value(m), 6) as mean, round(any_value(mx), 6) as max, min(i) filter (where x = mx) as at_max, round(sqrt(any_value(vr)), 6) as std, round(any_value(vr), 6) as var,
        round(avg(power(x - m, 3)) / power(any_value(vr), 1.5), 5) as skew, round(avg(power(x - m, 4)) / power(any_value(vr), 2) - 3, 5) as kurt, round(any_value(sm), 5) as sum, round(any_value(sm) - any_value(e) / 2, 5) as area from p join g using (vec_id) group by 1"""),
    "array_shape": (array_shape, f"""{_P}, w as (select *, lag(x) over k as a, lead(x) over k as b, lead(x, 2) over k as c from p window k as (partition by vec_id order by i)),
        d as (select vec_id, i - 1 as i, abs(x - a) as d from w where a is not null), m as (select a.vec_id, a.i, max(b.d) as d from d a join d b on a.vec_id = b.vec_id and b.i between a.i and a.i + 4 where a.i < 58 group by 1, 2),
        h as (select vec_id, least(floor((x - lo) * 10 / (hi - lo)), 9) as bin, count(*) / 64.0::double as q from p join (select vec_id, min(x) as lo, max(x) as hi from p group by 1) using (vec_id) group by 1, 2),
        o as (select vec_id, (x <= b)::int * 4 + (b <= c)::int * 2 + (x <= c)::int as pat, count(*) / 62.0::double as q from w where c is not null group by 1, 2)
        select vec_id, round(avg(x * x - a * b) filter (where a is not null and b is not null), 6) as teager, round((select avg(d) from m where m.vec_id = w.vec_id), 6) as steepness, count(*) filter (where x > a and x > b) as peaks,
        round((select -sum(q * log2(q)) from h where h.vec_id = w.vec_id), 5) as shannon, round((select -sum(q * log2(q)) from o where o.vec_id = w.vec_id), 5) as permutation from w group by vec_id"""),
    "array_resample": (array_resample, f"""{_P}, k as (select vec_id, a, unnest(range(0, 20)) as k from t), f as (select *, k * 63 / 19.0::double as q from k)
        select vec_id, cast(k as int) as k, round(a[floor(q)::int + 1] + (a[least(floor(q)::int + 1, 63) + 1] - a[floor(q)::int + 1]) * (q - floor(q)), 6) as x from f"""),
    "array_block_means": (array_block_means, f"""{_P} select vec_id, cast(i // 6 as int) as k, round(avg(x), 6) as x from p where i < 60 group by 1, 2"""),
    "array_histogram": (array_histogram, f"""{_P}, g as (select vec_id, min(x) as lo, max(x) as hi from p group by 1), h as (select vec_id, cast(least(floor((x - lo) * 6 / (hi - lo)), 5) as int) as bin, count(*) as c from p join g using (vec_id) group by 1, 2)
        select vec_id, cast(b as int) as bin, coalesce(c, 0) as n_values from (select vec_id, unnest(range(0, 6)) as b from t) left join h using (vec_id) where h.bin = b or h.bin is null union all select vec_id, cast(b as int), 0 from (select vec_id, unnest(range(0, 6)) as b from t) q where exists (select 1 from h where h.vec_id = q.vec_id) and not exists (select 1 from h where h.vec_id = q.vec_id and h.bin = q.b)"""),
    "array_ranks": (array_ranks, f"""{_P}, r as (select vec_id, i, round(x, 1) as x from p) select vec_id, cast(i as int) as i, rank() over (partition by vec_id order by x) + (count(*) over (partition by vec_id, x) - 1) / 2.0::double as rank from r"""),
    "array_extrema": (array_extrema, f"""{_P}, w as (select *, lag(x) over k as a, lead(x) over k as b from p window k as (partition by vec_id order by i))
        select vec_id, cast(i as int) as i, case when x > a and x > b then 0.0 when x < a and x < b then 256.0 else 128.0 end::double as mark from w"""),
    "array_savgol": (array_savgol, f"""{_P}, q as (select vec_id, i, a, x, n, least(greatest(i - 2, 0), n - 5) as s from p join (select vec_id, a from t) using (vec_id)), w as (select *, a[s + 1] as a1, a[s + 2] as a2, a[s + 3] as a3, a[s + 4] as a4, a[s + 5] as a5 from q)
        select vec_id, cast(i as int) as i, round(case i - s when 0 then 31 * a1 + 9 * a2 - 3 * a3 - 5 * a4 + 3 * a5 when 1 then 9 * a1 + 13 * a2 + 12 * a3 + 6 * a4 - 5 * a5 when 2 then -3 * a1 + 12 * a2 + 17 * a3 + 12 * a4 - 3 * a5 when 3 then -5 * a1 + 6 * a2 + 12 * a3 + 13 * a4 + 9 * a5 else 3 * a1 - 5 * a2 - 3 * a3 + 9 * a4 + 31 * a5 end / 35, 6) as x from w"""),
    "array_depth_slice": (depth_slice, f"""{_P} select vec_id, round(a[13], 6) as amplitude from t"""),
    "array_similarity": (trace_similarity, f"""{_P}, q as (select u.vec_id, b.vec_id as o, list_cosine_similarity(u.a, b.a) as c from t u, t b where u.vec_id % 20 = 0 and b.vec_id <> u.vec_id),
        r as (select u.vec_id, w.vec_id as o, corr(u.x, w.x) as r from p u join p w on u.i = w.i and w.vec_id <> u.vec_id where u.vec_id % 20 = 0 group by 1, 2)
        select vec_id, round(quantile_cont(c, 0.5), 6) as cosine, round(quantile_cont(r, 0.5), 6) as pearson from q join r using (vec_id, o) group by 1"""),
    "array_previous_correlation": (previous_trace_correlation, f"""{_P}, b as (select vec_id, lag(vec_id) over (partition by label order by vec_id) as o from t)
        select b.vec_id, round(corr(u.x, w.x), 6) as k_r from b join p u on u.vec_id = b.vec_id left join p w on w.vec_id = b.o and w.i = u.i group by 1"""),
    "array_label_windows": (label_windows, """select n_nationkey, unnest(range(greatest(n_nationkey - 3, 0), least(n_nationkey + 3, 25))) as place from nation"""),
    "array_sliding_windows": (sliding_windows, """select distinct n_nationkey, start from (select n_nationkey, unnest(list_append(range(0, n_nationkey - 2, 3), n_nationkey - 3)) as start from nation where n_nationkey >= 3)"""),
}
