"""Signal queries; tests compare all of them with NumPy too."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import signal as G
from .common import SAMPLES, rounded, table, traces


#: Frequencies in MHz keep the digits that are compared short.
UNITS = {"spectrum": {"interval": 8e-3}, "frequency": {"rate": 15.0}}


def _family(name):
    def query(spark, sf_dir):
        made = G.FAMILIES[name](traces(spark, sf_dir), "vec_id", "a", **UNITS.get(name, {}))
        return made.select(F.col("id").alias("vec_id"), *(rounded(c, 5).alias(c) for c in made.columns[1:]))

    return query


def attributes(spark, sf_dir):
    made = G.instantaneous(traces(spark, sf_dir), "vec_id", "a")
    return made.select(F.col("id").alias("vec_id"), F.posexplode(F.arrays_zip("At", "Vt", "Pht", "Wt")).alias("i", "z")).select("vec_id", "i", "z.*")


def rank_cepstrum(spark, sf_dir):
    return G.rank_cepstrum(traces(spark, sf_dir), "vec_id", "a").select(F.col("id").alias("vec_id"), F.posexplode("CRL").alias("i", "rank"))


def slice_features(spark, sf_dir):
    """Attributes of a slice between a top and a bottom sample of each trace."""
    t = traces(spark, sf_dir).withColumns({"top": (F.col("vec_id") % 10).cast("int"), "bottom": (40 + F.col("vec_id") % 20).cast("int")})
    s = t.withColumn("s", F.expr("slice(a, top + 1, bottom - top)"))
    a_top, a_bottom = F.get("a", F.col("top")), F.get("a", F.col("bottom"))
    s_ = F.col("s")
    return s.select(
        "vec_id", (F.col("top") * 8.0).alias("T_top"), (F.col("bottom") * 8.0).alias("T_bottom"), ((F.col("bottom") - F.col("top")) * 8.0).alias("dT"), rounded(a_top).alias("A_top"), rounded(a_bottom).alias("A_bottom"),
        rounded(a_bottom - a_top).alias("dA"), rounded(A.total(s_)).alias("A_sum"), rounded(A.mean(s_)).alias("A_mean"), rounded(F.array_max(s_)).alias("A_max"), ((A.argmax(s_) + F.col("top")) * 8.0).alias("A_T_max"),
        rounded(A.std(s_)).alias("std"), rounded(A.moment(s_, 2)).alias("k_var"), rounded(A.skewness(s_), 5).alias("skew"), rounded(A.kurtosis(s_), 5).alias("kurt"),
    )


def _marks(spark, sf_dir):
    """Windows about labelled places, which may lie past the last trace."""
    at = (F.col("doc_id") * 3).cast("int")
    return table(spark, sf_dir, "labels").select("doc_id", "toxic", F.explode(A.label_window(at, 2, at + 2)).alias("place"))


def label_matrix(spark, sf_dir):
    """Labelled places joined to their traces by position: class, typed keys and requested samples; places without a trace are reported apart."""
    t = traces(spark, sf_dir)
    marks = _marks(spark, sf_dir).filter("place % 7 <> 0")
    return marks.join(t, F.col("place") == F.col("vec_id")).select("doc_id", F.col("place").cast("long").alias("place"), "toxic", *(rounded(F.get("a", F.lit(i))).alias(f"s_{i}") for i in (0, 5, 63)))


def label_misses(spark, sf_dir):
    t = traces(spark, sf_dir).select("vec_id")
    marks = _marks(spark, sf_dir).filter("place % 7 <> 0")
    return marks.join(t, F.col("place") == F.col("vec_id"), "left_anti").groupBy("doc_id").agg(F.count("*").alias("missing"))


def _pair(spark, sf_dir):
    t = traces(spark, sf_dir)
    noisy = F.transform("a", lambda x, i: x + F.sin(i + F.col("vec_id")) * 0.1)
    return t.select("vec_id", "a", noisy.alias("b"))


def paired_metrics(spark, sf_dir):
    """Errors of a noisy copy of each trace: mean absolute, root mean square, signal to noise (dB), correlation, error where the signal is strong."""
    from ..operators.clutter import paired_metrics as metrics

    return metrics(_pair(spark, sf_dir), "vec_id", "b", "a").select("vec_id", *(rounded(c, 5).alias(c) for c in ("mae", "rmse", "snr_db", "psnr_db", "correlation", "strong_error")))


def overlays(spark, sf_dir):
    from ..operators import clutter as C

    a, b = F.transform("a", lambda x: x * 20 + 128), F.transform("b", lambda x: x * 60 + 128)
    p = _pair(spark, sf_dir).select("vec_id", a.alias("clean"), b.alias("noise"))
    made = p.select("vec_id", F.posexplode(F.arrays_zip(C.additive(F.col("clean"), F.col("noise")).alias("plus"), C.dominant(F.col("clean"), F.col("noise")).alias("most"), C.soft(F.col("clean"), F.col("noise")).alias("soft"))).alias("i", "z"))
    return made.select("vec_id", "i", *(rounded(f"z.{c}", 5).alias(c) for c in ("plus", "most", "soft")))


_P = f"with {SAMPLES}"

_R = lambda *cs: ", ".join(f"round({c}, 5) as {c}" for c in cs)
#: re, im, power p and size s of the 64 frequencies of each trace.
_Z = f"""{_P}, z as (select vec_id, k, sum(x * cos(2 * pi() * k * i / 64)) as re, -sum(x * sin(2 * pi() * k * i / 64)) as im from p, (select unnest(range(0, 64)) as k) group by 1, 2), w as (select *, re * re + im * im as p, sqrt(re * re + im * im) as s from z)"""
_Y = f"""{_Z}, y as (select p.vec_id, i, any_value(x) as x, sum((re * sin(2 * pi() * k * i / 64) + im * cos(2 * pi() * k * i / 64)) / 32) as y from p join z on z.vec_id = p.vec_id and k between 1 and 31 group by 1, 2)"""

FAMILY_SQL = {
    "spectrum": f"""{_Z}, s as (select * from w where k <= 32), tp as (select vec_id, arg_max(k, s) as peak, max(s) as top from s where k > 0 group by 1),
        e as (select vec_id, sum(s) / 64 as Sn, sum(s * k) / sum(s) / (64 * 8e-3::double) as wmf, any_value(peak) as peak, coalesce(max(k) filter (where s < 0.7 * top and k <= peak), 0) as l, coalesce(min(k) filter (where s < 0.7 * top and k >= peak), 32) as r from s join tp using (vec_id) group by 1)
        select vec_id, round(Sn, 5) as Sn, round(wmf, 5) as wmf, round(peak / nullif(r - l, 0)::double, 5) as Qf, round(Sn / wmf, 5) as Sn_wmf from e""",
    "frequency": f"""{_Z}, s as (select vec_id, k, p, k * 15 / 64.0::double as f from w where k < 32), tt as (select vec_id, sum(p) as total, max(p) filter (where k > 0) as top from s group by 1), o as (select vec_id, f, row_number() over (partition by vec_id order by p desc, k desc) as r from s),
        d as (select vec_id, max(f) filter (where r = 2) as d1, max(f) filter (where r = 3) as d2, max(f) filter (where r = 4) as d3 from o group by 1),
        m as (select vec_id, sum(p * f) / any_value(total) as central, max(f) filter (where p > 0.5 * top) - min(f) filter (where p > 0.5 * top) as bandwidth, sum(p) filter (where k >= 16) / sum(p) filter (where k < 16) as high_low, regr_slope(log10(p), log10(f)) filter (where k > 0) as slope,
          -sum(p / total * ln(p / total)) as entropy, sum(p * f * f) / any_value(total) as m2, sum(p * f * f * f) / any_value(total) as m3 from s join tt using (vec_id) group by 1)
        select vec_id, {_R('central', 'bandwidth', 'high_low')}, round(central, 5) as centroid, {_R('slope', 'entropy')}, round(d1, 5) as dominant_1, round(d2, 5) as dominant_2, round(d3, 5) as dominant_3, round(central, 5) as moment_1, round(m2, 5) as moment_2, round(m3, 5) as moment_3 from m join d using (vec_id)""",
    "envelope": f"""{_Y}, e as (select vec_id, i, sqrt(x * x + y * y) as e from y), g as (select vec_id, avg(e) as m, var_pop(e) as v, max(e) as top from e group by 1)
        select vec_id, round(sum(e) - sum(e) filter (where i in (0, 63)) / 2, 5) as area, round(any_value(top), 5) as max, min(i) filter (where e = top)::double as time_to_max, round(any_value(m), 5) as mean, round(sqrt(any_value(v)), 5) as std, round(avg(power(e - m, 3)) / power(any_value(v), 1.5), 5) as skew,
        round(avg(power(e - m, 4)) / power(any_value(v), 2) - 3, 5) as kurt, round(any_value(top) / any_value(m), 5) as max_to_mean, round(sum(e * e) filter (where i < 21), 5) as energy_1, round(sum(e * e) filter (where i between 21 and 41), 5) as energy_2, round(sum(e * e) filter (where i between 42 and 62), 5) as energy_3 from e join g using (vec_id) group by 1""",
    "acf": f"""{_P}, c as (select a.vec_id, b.i - a.i as k, sum(a.x * b.x) as c from p a join p b on a.vec_id = b.vec_id and b.i >= a.i group by 1, 2), l as (select *, lag(c) over o as u, lead(c) over o as v, first_value(c) over o as c0 from c window o as (partition by vec_id order by k))
        select vec_id, min(k) filter (where c < u and (v is null or c <= v))::double as first_minimum, round(max(c) filter (where k = 10), 5) as at_10, round(sum(c * (k - 4.5)) filter (where k < 10) / 82.5, 5) as decay, round(sum(c) - sum(c) filter (where k in (0, 63)) / 2, 5) as integral,
        coalesce(min(k) filter (where c <= 0.5 * c0), 63)::double as width, round(max(c) filter (where k = 10) / max(c) filter (where k = 20), 5) as ratio from l group by 1""",
    "entropy": f"""{_Z}, sc as (select unnest(range(1, 11)) as sc), c as (select vec_id, sc, i // sc as j, avg(x) as x from p, sc where i < 64 // sc * sc group by 1, 2, 3), lh as (select vec_id, sc, min(x) as lo, max(x) as hi, count(*) as n from c group by 1, 2),
        h as (select vec_id, sc, least(floor((x - lo) * 50 / (hi - lo)), 49) as bin, count(*) / any_value(n)::double as q from c join lh using (vec_id, sc) group by 1, 2, 3), sh as (select vec_id, {', '.join(f'-sum(q * log2(q)) filter (where sc = {k}) as shannon_{k}' for k in range(1, 11))} from h group by 1),
        b as (select *, lead(x) over o as x1, lead(x, 2) over o as x2 from p window o as (partition by vec_id order by i)), o as (select vec_id, (x <= x1)::int * 4 + (x1 <= x2)::int * 2 + (x <= x2)::int as pat, count(*) / 62.0::double as q from b where x2 is not null group by 1, 2), pe as (select vec_id, -sum(q * log2(q)) as permutation from o group by 1),
        r as (select vec_id, 0.2 * stddev_pop(x) as r from p group by 1), n as (select u.vec_id, u.i, count(*) as two, count(*) filter (where abs(u.x2 - v.x2) <= r) as three from b u join b v on u.vec_id = v.vec_id and v.x1 is not null join r on r.vec_id = u.vec_id where u.x1 is not null and abs(u.x - v.x) <= r and abs(u.x1 - v.x1) <= r group by 1, 2),
        a as (select vec_id, avg(ln(two / 63.0::double)) as f2, avg(ln(three / 62.0::double)) filter (where i < 62) as f3, sum(two - 1) filter (where i < 62) as p2, sum(three - 1) filter (where i < 62) as p3 from n group by 1),
        tt as (select vec_id, sum(p) as t from w group by 1), fe as (select vec_id, -sum(p / t * log2(p / t + 1e-12)) as fourier, exp(sum(p / t * ln(p / t + 1e-12))) as hirschman from w join tt using (vec_id) group by 1)
        select vec_id, {_R(*(f'shannon_{k}' for k in range(1, 11)), 'permutation')}, round(abs(f3 - f2), 5) as approximate, round(case when p2 > 0 and p3 > 0 then -ln(p3 / p2) end, 5) as sample, {_R('fourier', 'hirschman')} from sh join pe using (vec_id) join a using (vec_id) join fe using (vec_id)""",
    "recurrence": f"""{_P}, b as (select *, lead(x) over o as x1, lead(x, 2) over o as x2 from p window o as (partition by vec_id order by i)), d as (select u.vec_id, u.i, v.i as j, sqrt((u.x - v.x) * (u.x - v.x) + (u.x1 - v.x1) * (u.x1 - v.x1) + (u.x2 - v.x2) * (u.x2 - v.x2)) as d from b u join b v using (vec_id) where u.x2 is not null and v.x2 is not null),
        q as (select vec_id, quantile_cont(d, 0.1) as q from d group by 1), c as (select vec_id, count(*) filter (where d < q)::double as near, count(*) filter (where d < q and j = i + 1)::double as on_ from d join q using (vec_id) group by 1)
        select vec_id, round(near / 3844, 5) as rate, round(on_ / greatest(near, 1), 5) as determinism, round(on_ / 61, 5) as diagonal from c""",
    "morphology": f"""{_P}, m as (select vec_id, max(x) as m from p group by 1), o as (select vec_id, i, x > 0.5 * m as v from p join m using (vec_id)), l as (select *, lag(v, 1, false) over k as a, lead(v, 1, false) over k as b from o window k as (partition by vec_id order by i))
        select vec_id, round(count(*) filter (where a and v and b) / nullif(count(*) filter (where v), 0)::double, 5) as erosion, round(count(*) filter (where a or v or b) / nullif(count(*) filter (where v), 0)::double, 5) as dilation from l group by 1""",
    "fractal": f"""{_P}, pw as (select unnest([2, 4, 8, 16, 32]) as w), cs as (select vec_id, i, sum(x) over (partition by vec_id order by i) as s from p), ms as (select a.vec_id, w, a.s - coalesce(b.s, 0) as b from cs a join pw on a.i >= w - 1 left join cs b on b.vec_id = a.vec_id and b.i = a.i - w), la as (select vec_id, avg(l) as lacunarity from (select vec_id, w, var_pop(b) / (avg(b) * avg(b)) as l from ms group by 1, 2) group by 1),
        hb as (select vec_id, w, i // w as blk, i, x, avg(x) over (partition by vec_id, w, i // w) as m from p, pw where w in (8, 16, 32)), hw as (select *, sum(x - m) over (partition by vec_id, w, blk order by i) as c from hb), hr as (select vec_id, w, blk, (max(c) - min(c)) / stddev_pop(x) as r from hw group by 1, 2, 3), hu as (select vec_id, regr_slope(ln(r), ln(w)) as hurst from (select vec_id, w, avg(r) as r from hr group by 1, 2) group by 1),
        tm as (select vec_id, avg(x) as m from p group by 1), wk as (select vec_id, i, sum(x - m) over (partition by vec_id order by i) as y from p join tm using (vec_id)) , fl as (select distinct floor(power(10, 1 + (log10(32) - 1) * k / 19.0::double) + 1e-9)::bigint as w from (select unnest(range(0, 20)) as k)),
        bk as (select vec_id, w, i // w as blk, y, i % w as t from wk, fl where i < 64 // w * w), sq as (select vec_id, w, blk, greatest(var_pop(y) - power(covar_pop(y, t), 2) / var_pop(t), 1e-300) as s from bk group by 1, 2, 3), qs as (select k, -5 + 10 * k / 19.0::double as q from (select unnest(range(0, 20)) as k)),
        fq as (select vec_id, w, k, q, power(avg(power(s, q / 2)), 1 / q) as f from sq, qs group by 1, 2, 3, 4), hq as (select vec_id, k, q, regr_slope(ln(f), ln(w)) * q - 1 as tau from fq group by 1, 2, 3), al as (select vec_id, k, q, tau, (lead(tau) over (partition by vec_id order by k) - tau) / (10 / 19.0::double) as a from hq),
        sp as (select vec_id, k, a, q * a - tau as f from al where a is not null), ex as (select vec_id, max(a) - min(a) as w_, arg_max(a, f) as top, arg_min(a, k) as a0, arg_max(a, k) as a1, max(f) as mf, avg(a) as ma, avg(f) as f_, stddev_pop(a) as sa, stddev_pop(f) as sf from sp group by 1)
        select vec_id, {_R('lacunarity', 'hurst')}, round(w_, 5) as mf_width, round(top, 5) as mf_position, round((top - a0) / nullif(a1 - top, 0), 5) as mf_asymmetry, round(mf, 5) as mf_height, round(ma, 5) as mf_mean_alpha, round(f_, 5) as mf_mean_f, round(sa, 5) as mf_std_alpha, round(sf, 5) as mf_std_f from la join hu using (vec_id) join ex using (vec_id)""",
}

QUERIES = {f"signal_{name}": (_family(name), FAMILY_SQL.get(name)) for name in G.FAMILIES} | {
    "signal_attributes": (attributes, f"""{_Y}, th as (select *, atan2(y, x) as t from y), d as (select *, lead(t) over (partition by vec_id order by i) - t as d from th)
        select vec_id, cast(i as int) as i, round(sqrt(x * x + y * y), 2) as At, round(y, 2) as Vt, round(t, 2) as Pht, round(d, 2) as Wt from d"""),
    "signal_rank_cepstrum": (rank_cepstrum, f"""{_P}, k as (select unnest(range(0, 64)) as k), c as (select vec_id, k, sum(x * cos(pi() * (i + 0.5) * k / 64)) * case when k = 0 then sqrt(1 / 64.0::double) else sqrt(2 / 64.0::double) end as c from p, k group by 1, 2),
        r as (select vec_id, k, ln(rank() over (partition by vec_id order by c) + (count(*) over (partition by vec_id, c) - 1) / 2.0::double) as r from c), b as (select vec_id, i, sum(r * cos(pi() * (i + 0.5) * r.k / 64) * case when r.k = 0 then sqrt(1 / 64.0::double) else sqrt(2 / 64.0::double) end) as b from r, (select k as i from k) group by 1, 2)
        select vec_id, cast(i as int) as i, rank() over (partition by vec_id order by b) + (count(*) over (partition by vec_id, b) - 1) / 2.0::double as rank from b"""),
    "slice_features": (slice_features, f"""{_P}, s as (select *, vec_id % 10 as top, 40 + vec_id % 20 as bottom from p), w as (select * from s where i >= top and i < bottom), g as (select vec_id, avg(x) as m, var_pop(x) as v, max(x) as mx from w group by 1)
        select w.vec_id, any_value(top) * 8.0::double as T_top, any_value(bottom) * 8.0::double as T_bottom, any_value(bottom - top) * 8.0::double as dT, round(any_value(a[top + 1]), 6) as A_top, round(any_value(a[bottom + 1]), 6) as A_bottom, round(any_value(a[bottom + 1] - a[top + 1]), 6) as dA,
        round(sum(x), 6) as A_sum, round(avg(x), 6) as A_mean, round(max(x), 6) as A_max, min(i) filter (where x = mx) * 8.0::double as A_T_max, round(sqrt(any_value(v)), 6) as std, round(any_value(v), 6) as k_var, round(avg(power(x - m, 3)) / power(any_value(v), 1.5), 5) as skew, round(avg(power(x - m, 4)) / power(any_value(v), 2) - 3, 5) as kurt
        from w join g using (vec_id) join (select vec_id, a from t) using (vec_id) group by 1"""),
    "label_matrix": (label_matrix, f"""{_P}, m as (select doc_id, toxic, unnest(range(greatest(doc_id * 3 - 2, 0), doc_id * 3 + 2)) as place from labels) select doc_id, place, toxic, round(a[1], 6) as s_0, round(a[6], 6) as s_5, round(a[64], 6) as s_63 from m join t on place = vec_id where place % 7 <> 0"""),
    "label_misses": (label_misses, f"""{_P}, m as (select doc_id, unnest(range(greatest(doc_id * 3 - 2, 0), doc_id * 3 + 2)) as place from labels) select doc_id, count(*) as missing from m where place % 7 <> 0 and place not in (select vec_id from t) group by 1"""),
    "paired_metrics": (paired_metrics, f"""{_P}, n as (select vec_id, i, x, x + sin(i + vec_id) * 0.1 as y from p), q as (select vec_id, quantile_cont(abs(x), 0.75) as q from n group by 1)
        select vec_id, round(avg(abs(y - x)), 5) as mae, round(sqrt(avg(power(y - x, 2))), 5) as rmse, round(10 * log10(avg(x * x) / avg(power(y - x, 2))), 5) as snr_db, round(20 * log10(256 / sqrt(avg(power(y - x, 2)))), 5) as psnr_db, round(corr(x, y), 5) as correlation, round(avg(abs(y - x)) filter (where abs(x) >= q), 5) as strong_error from n join q using (vec_id) group by 1"""),
    "overlays": (overlays, f"""{_P}, n as (select vec_id, i, x * 20 + 128 as c, (x + sin(i + vec_id) * 0.1) * 60 + 128 as n from p), w as (select *, 1 / (1 + exp(-(abs(n - 128) - abs(c - 128)) / 12)) as s from n)
        select vec_id, cast(i as int) as i, round(least(greatest(c + n - 128, 0), 256), 5) as plus, round(case when abs(n - 128) > abs(c - 128) then n else c end, 5) as most, round(least(greatest(c * (1 - s) + n * s, 0), 256), 5) as soft from w"""),
}
