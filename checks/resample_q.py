"""Resampling, multiplicity, rank tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from replistat.functions.labels import stars
from replistat.operators import ranktests as rt, resample as rs
from replistat.plans.growth import region_test

from . import views as v
from .registry import query
from .views import r

_UNITS = "WITH u AS (SELECT cond, unit, median(value) AS x, row_number() OVER (PARTITION BY cond ORDER BY unit) - 1 AS i FROM v_unit_value GROUP BY cond, unit)"
_EXACT = _UNITS + """, s AS (SELECT m FROM range(1024) t(m) WHERE bit_count(m) = 5), tg AS (SELECT DISTINCT cond FROM u WHERE cond <> 'AFRICA'),
  pool AS (SELECT tg.cond, u.x, CASE WHEN u.cond = 'AFRICA' THEN u.i ELSE u.i + 5 END AS k FROM tg JOIN u ON u.cond = tg.cond OR u.cond = 'AFRICA'),
  dd AS (SELECT cond, m, abs(median(x) FILTER (WHERE (m >> k) & 1 = 0) - median(x) FILTER (WHERE (m >> k) & 1 = 1)) AS diff FROM pool, s GROUP BY cond, m),
  o AS (SELECT cond, diff AS obs FROM dd WHERE m = 31),
  p AS (SELECT cond, obs, avg(CAST(diff >= obs - 1e-12 AS INT)) AS p0, avg(CAST(diff >= top - 1e-12 AS INT)) AS f
    FROM (SELECT dd.*, o.obs, max(diff) OVER (PARTITION BY dd.cond) AS top FROM dd JOIN o ON o.cond = dd.cond) GROUP BY cond, obs),
  w AS (SELECT *, greatest(p0, f) AS p_raw, row_number() OVER (ORDER BY greatest(p0, f)) AS rk, count(*) OVER () AS m FROM p),
  h AS (SELECT *, least(1.0, max((m - rk + 1) * p_raw) OVER (ORDER BY p_raw, rk ROWS UNBOUNDED PRECEDING)) AS p_adj FROM w)"""


@query("region_growth_test", _EXACT + """ SELECT cond, round(obs, 4) AS obs_diff, round(p_raw, 6) AS p_raw, round(f, 6) AS min_p, round(p_adj, 6) AS p_adj,
  CASE WHEN p_adj < 0.0001 THEN '****' WHEN p_adj < 0.001 THEN '***' WHEN p_adj < 0.01 THEN '**' WHEN p_adj < 0.05 THEN '*' ELSE 'ns' END AS significance FROM h""", "v_unit_value")
def region_growth_test(spark, d):
    t = region_test(v.unit_values(spark, d), "cond", "unit", "value", "AFRICA")
    return t.select("cond", r("obs_diff", 4).alias("obs_diff"), r("p_raw").alias("p_raw"), r("min_p").alias("min_p"), r("p_adj").alias("p_adj"), "significance")


@query("unit_summary_a1", "SELECT cond, unit, round(median(value), 4) AS unit_value, count(value) AS n_obs, round(avg(value), 4) AS unit_mean FROM v_unit_value GROUP BY cond, unit", "v_unit_value")
def unit_summary(spark, d):
    u = v.unit_values(spark, d)
    a, b = rs.unit_summary(u, ["cond", "unit"], "value"), rs.unit_summary(u, ["cond", "unit"], "value", F.avg)
    return a.join(b.select("cond", "unit", F.col("unit_value").alias("m")), ["cond", "unit"]).select(
        "cond", "unit", r("unit_value", 4).alias("unit_value"), "n_obs", r("m", 4).alias("unit_mean"))


_H = "CAST(('0x' || substr(md5(concat_ws('|', {})), 1, 8)) AS BIGINT)"
_U = "(CAST(('0x' || substr(md5(concat_ws('|', {})), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0"
_BINOMIAL = ("sqrt(n * p * (1 - p))", "0", "n", "lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(l / (l + r)) + (n - k) * ln(r / (l + r))")
_HYPER = ("sqrt(n * p * (1 - p) * greatest((l + r - n) / greatest(l + r - 1, 1), 0))", "greatest(n - r, 0)", "least(n, l)",
          "lgamma(l + 1) - lgamma(k + 1) - lgamma(l - k + 1) + lgamma(r + 1) - lgamma(n - k + 1) - lgamma(r - n + k + 1) - lgamma(l + r + 1) + lgamma(n + 1) + lgamma(l + r - n + 1)")

#: Levels of the tree that the SQL walks down: positions below 2 ** LEVELS in a group, as many as any table will have.
#: Nothing is drawn on levels above a group's own size, so all numbers from its size on give the same draws.
LEVELS = 28


def _quantile(s, law):
    """Distribution functions q{s} of the kinds of draws in a{s}, and f{s}: the draws that went left (x)."""
    sd, low, high, log_p = law
    return f"""b{s} AS (SELECT *, n * p - 8 * {sd} - 8 AS lo, n * p + 8 * {sd} + 8 AS hi FROM (SELECT DISTINCT n, l, r, l / (l + r) AS p FROM a{s} WHERE n > 0 AND l > 0 AND r > 0)),
  q{s} AS MATERIALIZED (SELECT n, l, r, k, sum(exp({log_p})) OVER (PARTITION BY n, l, r ORDER BY k) AS c FROM (
    SELECT n, l, r, unnest(range(CAST(greatest(floor(lo), {low}) AS BIGINT), CAST(least(ceil(hi), {high}) AS BIGINT) + 1)) AS k FROM b{s})),
  f{s} AS MATERIALIZED (SELECT a.*, CASE WHEN a.r = 0 THEN a.n WHEN a.l = 0 THEN 0 ELSE coalesce(q.k, a.n) END AS x FROM a{s} a ASOF LEFT JOIN q{s} q ON a.n = q.n AND a.l = q.l AND a.r = q.r AND a.u <= q.c)"""


def _bootstrap(unit, n_boot, levels=16):
    """Interval of the median from counts split level by level down the positions of the values."""
    u = _U.format("'42', st.cond, CAST(rep AS VARCHAR), st.unit, CAST({s} AS VARCHAR), CAST(st.node AS VARCHAR)")
    parts = [f"""o AS MATERIALIZED (SELECT cond, {unit} AS unit, value, row_number() OVER (PARTITION BY cond ORDER BY value, {unit}) - 1 AS pos FROM v_unit_value WHERE value IS NOT NULL),
  c AS (SELECT cond, unit, count(*) AS n, row_number() OVER (PARTITION BY cond ORDER BY unit) - 1 AS ci FROM o GROUP BY 1, 2), k AS (SELECT cond, count(*) AS k FROM c GROUP BY 1),
  sl AS (SELECT k.cond, rep, {_H.format("'42', k.cond, CAST(rep AS VARCHAR), CAST(slot AS VARCHAR)")} % k AS ci FROM k, range({n_boot}) t(rep), range(100) q(slot) WHERE slot < k),
  s{levels} AS MATERIALIZED (SELECT sl.cond, rep, unit, 0::BIGINT AS node, sum(n)::BIGINT AS n FROM sl JOIN c ON c.cond = sl.cond AND c.ci = sl.ci GROUP BY 1, 2, 3),
  m AS (SELECT cond, rep, sum(n)::BIGINT AS m FROM s{levels} GROUP BY 1, 2),
  t{levels} AS MATERIALIZED (SELECT cond, rep, t, 0::BIGINT AS node, (m - 1 + t) // 2 AS k FROM m, range(2) q(t))"""]
    for s in range(levels - 1, -1, -1):
        parts.append(f"""w{s} AS (SELECT cond, unit, pos >> {s + 1} AS node, count(*) FILTER ((pos >> {s}) & 1 = 0) AS l, count(*) FILTER ((pos >> {s}) & 1 = 1) AS r FROM o GROUP BY 1, 2, 3),
  a{s} AS MATERIALIZED (SELECT st.*, l, r, {u.format(s=s)} AS u FROM s{s + 1} st JOIN w{s} w ON w.cond = st.cond AND w.unit = st.unit AND w.node = st.node), {_quantile(s, _BINOMIAL)},
  g{s} AS (SELECT cond, rep, node, sum(x)::BIGINT AS x FROM f{s} GROUP BY 1, 2, 3),
  t{s} AS MATERIALIZED (SELECT t.cond, t.rep, t, t.node * 2 + CAST(k >= x AS INT) AS node, k - CASE WHEN k >= x THEN x ELSE 0 END AS k FROM t{s + 1} t JOIN g{s} g ON g.cond = t.cond AND g.rep = t.rep AND g.node = t.node),
  s{s} AS MATERIALIZED (SELECT h.* FROM (SELECT cond, rep, unit, node * 2 AS node, x AS n FROM f{s} UNION ALL SELECT cond, rep, unit, node * 2 + 1, n - x FROM f{s}) h SEMI JOIN t{s} t ON t.cond = h.cond AND t.rep = h.rep AND t.node = h.node WHERE h.n > 0)""")
    return "WITH " + ",\n  ".join(parts) + """, e AS (SELECT t0.cond, rep, avg(value) AS t FROM t0 JOIN o ON o.cond = t0.cond AND o.pos = t0.node GROUP BY 1, 2)
  SELECT cond, round(quantile_cont(t, 0.025), 6) AS ci_low, round(quantile_cont(t, 0.975), 6) AS ci_high, count(*) AS n_boot FROM e GROUP BY cond"""


@query("cluster_bootstrap_r1", _bootstrap("unit", 2000, LEVELS), "v_unit_value")
def cluster_bootstrap(spark, d):
    b = rs.bootstrap_interval(v.unit_values(spark, d), ["cond"], "unit", "value")
    return b.select("cond", r("ci_low", 6).alias("ci_low"), r("ci_high", 6).alias("ci_high"), "n_boot")


@query("median_bootstrap_r2", _bootstrap("'all'", 2000, LEVELS), "v_unit_value")
def median_bootstrap(spark, d):
    b = rs.bootstrap_interval(v.unit_values(spark, d), ["cond"], None, "value")
    return b.select("cond", r("ci_low", 6).alias("ci_low"), r("ci_high", 6).alias("ci_high"), "n_boot")


@query("exact_permutation_r3", _EXACT + " SELECT cond, round(obs, 4) AS obs_diff, round(p_raw, 6) AS p_raw, round(f, 6) AS min_p, 5::BIGINT AS n_ref, 5::BIGINT AS n_treat, 'exact' AS method FROM h", "v_unit_value")
def exact_permutation(spark, d):
    t = rs.permutation_test(v.unit_values(spark, d), "cond", "unit", "value", "AFRICA")
    return t.select("cond", r("obs_diff", 4).alias("obs_diff"), r("p_raw").alias("p_raw"), r("min_p").alias("min_p"), "n_ref", "n_treat", "method")


@query("sampled_permutation_r4", _UNITS + """, tg AS (SELECT DISTINCT cond AS t FROM u WHERE cond <> 'AFRICA'), pool AS (SELECT t, u.cond, u.unit, x FROM tg JOIN u ON u.cond = t OR u.cond = 'AFRICA'),
  o AS (SELECT t, abs(median(x) FILTER (WHERE cond = t) - median(x) FILTER (WHERE cond <> t)) AS obs FROM pool GROUP BY t),
  sh AS (SELECT t, rep, x, row_number() OVER (PARTITION BY t, rep ORDER BY md5(concat_ws('|', '42', CAST(rep AS VARCHAR), cond, unit))) AS pos FROM pool, range(1000) q(rep)),
  dd AS (SELECT t, rep, abs(median(x) FILTER (WHERE pos > 5) - median(x) FILTER (WHERE pos <= 5)) AS diff FROM sh GROUP BY t, rep)
  SELECT o.t AS cond, round(greatest((count(*) FILTER (WHERE diff >= obs - 1e-12) + 1) / 1001.0, 2.0 / 252), 6) AS p_raw, round(2.0 / 252, 6) AS min_p, 'monte_carlo' AS method FROM dd JOIN o ON o.t = dd.t GROUP BY o.t""", "v_unit_value")
def sampled_permutation(spark, d):
    t = rs.permutation_test(v.unit_values(spark, d), "cond", "unit", "value", "AFRICA", n_perm=1000, exact_limit=10)
    return t.select("cond", r("p_raw").alias("p_raw"), r("min_p").alias("min_p"), "method")


def _relabelled(n_perm, levels):
    """p-values from relabelled medians, each found by splitting the group's share level by level down the pooled positions."""
    u = _U.format("'42', cond, CAST(rep AS VARCHAR), CAST({s} AS VARCHAR), CAST(node AS VARCHAR)")
    parts = [f"""o AS MATERIALIZED (SELECT r_name AS cond, o_totalprice AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  tg AS (SELECT cond, count(*) AS nt FROM o WHERE cond <> 'AFRICA' GROUP BY 1), pool AS (SELECT cond, x FROM o WHERE cond <> 'AFRICA' UNION ALL SELECT tg.cond, x FROM tg, o WHERE o.cond = 'AFRICA'),
  pl AS MATERIALIZED (SELECT cond, x, row_number() OVER (PARTITION BY cond ORDER BY x) - 1 AS pos FROM pool),
  ob AS (SELECT tg.cond, abs((SELECT median(x) FROM o WHERE o.cond = tg.cond) - (SELECT median(x) FROM o WHERE o.cond = 'AFRICA')) AS obs FROM tg),
  t{levels} AS MATERIALIZED (SELECT cond, size, rep, i, 0::BIGINT AS node, nt AS n, (CASE WHEN i < 2 THEN nt ELSE size - nt END - 1 + i % 2) // 2 AS k
    FROM tg JOIN (SELECT cond, count(*) AS size FROM pool GROUP BY 1) USING (cond), range({n_perm}) t(rep), range(4) q(i))"""]
    for s in range(levels - 1, -1, -1):
        left = f"greatest(least(size - (node << {s + 1}), {1 << s}), 0)"
        parts.append(f"""a{s} AS MATERIALIZED (SELECT *, {left} AS l, greatest(least(size - (node << {s + 1}) - {1 << s}, {1 << s}), 0) AS r, {u.format(s=s)} AS u FROM t{s + 1}), {_quantile(s, _HYPER)},
  t{s} AS MATERIALIZED (SELECT cond, size, rep, i, node * 2 + CAST(k >= y AS INT) AS node, CASE WHEN k >= y THEN n - x ELSE x END AS n, CASE WHEN k >= y THEN k - y ELSE k END AS k
    FROM (SELECT *, CASE WHEN i < 2 THEN x ELSE l - x END AS y FROM f{s}))""")
    return "WITH " + ",\n  ".join(parts) + f""", d AS (SELECT t0.cond, rep, abs(avg(x) FILTER (i < 2) - avg(x) FILTER (i >= 2)) AS d FROM t0 JOIN pl ON pl.cond = t0.cond AND pl.pos = t0.node GROUP BY 1, 2)
  SELECT ob.cond, round(any_value(obs), 4) AS obs_diff, round((count(*) FILTER (d >= obs - 1e-12) + 1) / {n_perm + 1}.0, 6) AS p_raw FROM d JOIN ob ON ob.cond = d.cond GROUP BY ob.cond"""


@query("observation_permutation_r5", _relabelled(10000, LEVELS))
def observation_permutation(spark, d):
    o = v.located_orders(spark, d).select(F.col("r_name").alias("cond"), F.col("o_totalprice").alias("value"))
    t = rs.observation_test(o, "cond", "value", "AFRICA")
    return t.select("cond", r("obs_diff", 4).alias("obs_diff"), r("p_raw").alias("p_raw"))


_P = "SELECT o_orderkey, o_orderpriority AS family, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 600000.0 * o_totalprice / 600000.0 END AS p FROM orders"


def p_table(spark, d):
    x = F.col("o_totalprice")
    return v.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("family"),
                                              F.when(F.col("o_orderstatus") != "P", x / 600000.0 * x / 600000.0).alias("p"))


@query("holm_r6", f"""WITH p AS ({_P}), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS rk, count(*) OVER (PARTITION BY family) AS m FROM p WHERE p IS NOT NULL)
  SELECT o_orderkey, round(least(1.0, max((m - rk + 1) * p) OVER (PARTITION BY family ORDER BY p, rk ROWS UNBOUNDED PRECEDING)), 9) AS p_adj FROM k UNION ALL SELECT o_orderkey, NULL FROM p WHERE p IS NULL""")
def holm(spark, d):
    return rs.adjust_pvalues(p_table(spark, d), ["family"], "p").select("o_orderkey", r("p_adj", 9).alias("p_adj"))


@query("benjamini_hochberg_r7", f"""WITH p AS ({_P}), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS rk, count(*) OVER (PARTITION BY family) AS m FROM p WHERE p IS NOT NULL)
  SELECT o_orderkey, round(least(1.0, min(m / rk * p) OVER (PARTITION BY family ORDER BY p DESC, rk DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_adj FROM k UNION ALL SELECT o_orderkey, NULL FROM p WHERE p IS NULL""")
def benjamini_hochberg(spark, d):
    return rs.adjust_pvalues(p_table(spark, d), ["family"], "p", "bh").select("o_orderkey", r("p_adj", 9).alias("p_adj"))


@query("running_extremes_w2", "SELECT o_orderkey, max(o_totalprice) OVER w AS top, min(o_totalprice) OVER w AS low FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def running_extremes(spark, d):
    from replistat.operators.scan import running
    x = F.col("o_totalprice")
    return running(v.table(spark, d, "orders"), ["o_orderpriority"], ["o_orderkey"], {"top": ("max", x), "low": ("min", x)}).select("o_orderkey", "top", "low")


@query("signed_rank_r8", """WITH d AS (SELECT cond, centroid_y - perimeter_px * 2 AS df FROM v_object), z AS (SELECT cond, df, abs(df) AS a FROM d WHERE df <> 0),
  k AS (SELECT cond, a, count(*) AS t, count(*) FILTER (WHERE df > 0) AS np, count(*) FILTER (WHERE df < 0) AS nm FROM z GROUP BY 1, 2),
  e AS (SELECT *, sum(t) OVER (PARTITION BY cond ORDER BY a ROWS UNBOUNDED PRECEDING) - (t - 1) / 2.0 AS rk FROM k)
  SELECT e.cond, any_value(n) AS n_pairs, CAST(sum(t) AS BIGINT) AS n_nonzero, CAST(sum(rk * np) AS DOUBLE) AS w_plus, CAST(sum(rk * nm) AS DOUBLE) AS w_minus,
    CAST(sum(CAST(t * t * t - t AS DOUBLE)) AS DOUBLE) AS tie_term FROM e JOIN (SELECT cond, count(*) AS n FROM d GROUP BY 1) c ON c.cond = e.cond GROUP BY e.cond""", "v_object")
def signed_rank(spark, d):
    o = v.objects(spark, d).withColumn("b", F.col("perimeter_px") * 2)
    return rt.signed_rank_sums(o, ["cond"], "b", "centroid_y").select("cond", "n_pairs", "n_nonzero", "w_plus", "w_minus", "tie_term")


@query("signed_rank_p_r8")
def signed_rank_p(spark, d):
    o = v.objects(spark, d).withColumn("b", F.col("perimeter_px") * 2)
    return rt.signed_rank_test(o, ["cond", "pair_key"], "b", "centroid_y").select("cond", "pair_key", r("p_value", 9).alias("p_value"))


@query("rank_sum_r9", """WITH t AS (SELECT DISTINCT cond AS g FROM v_object WHERE cond <> 'AFRICA'), k AS (SELECT g, centroid_y AS x, count(*) FILTER (WHERE cond = g) AS nt, count(*) FILTER (WHERE cond <> g) AS nc
    FROM t JOIN v_object ON cond = g OR cond = 'AFRICA' GROUP BY 1, 2), e AS (SELECT *, sum(nt + nc) OVER (PARTITION BY g ORDER BY x ROWS UNBOUNDED PRECEDING) - (nt + nc - 1) / 2.0 AS rk FROM k)
  SELECT g AS cond, CAST(sum(nt) AS BIGINT) AS n_group, CAST(sum(nc) AS BIGINT) AS n_control, CAST(sum(rk * nt) - sum(nt) * (sum(nt) + 1) / 2.0 AS DOUBLE) AS u_group FROM e GROUP BY g""", "v_object")
def rank_sum(spark, d):
    return rt.rank_sums(v.objects(spark, d), "cond", "centroid_y", "AFRICA").select("cond", "n_group", "n_control", "u_group")


@query("rank_sum_p_r9")
def rank_sum_p(spark, d):
    t = rt.rank_sum_test(v.unit_values(spark, d), "cond", "value", "AFRICA")
    return t.select("cond", r("p_value", 9).alias("p_value"), stars("p_value", 3, "ns").alias("stars"))


@query("count_agreement_a26", """WITH j AS (SELECT a.n_nuclei AS man, b.n_nuclei AS aut FROM v_field a JOIN v_field b USING (image_id) WHERE a.run = 'click' AND b.run = 'view'),
  k AS (SELECT man, aut, rank() OVER (ORDER BY man) + (count(*) OVER (PARTITION BY man) - 1) / 2.0 AS rm, rank() OVER (ORDER BY aut) + (count(*) OVER (PARTITION BY aut) - 1) / 2.0 AS ra FROM j)
  SELECT count(*) AS n, round(avg(abs(aut - man) / man), 6) AS bias, round(corr(rm, ra), 6) AS rho FROM k""", "v_field")
def count_agreement(spark, d):
    f = v.fields(spark, d)
    a = f.filter("run = 'click'").select("image_id", F.col("n_nuclei").alias("man"))
    b = f.filter("run = 'view'").select("image_id", F.col("n_nuclei").alias("aut"))
    t = rt.count_agreement(a.join(b, "image_id"), "man", "aut")
    return t.select("n", r("mean_abs_relative_bias").alias("bias"), r("spearman_rho").alias("rho"))


@query("custom_statistic_u1", "SELECT cond, unit, round(stddev_samp(value) / avg(value), 6) AS cv, count(*) AS n FROM v_unit_value GROUP BY 1, 2", "v_unit_value")
def custom_statistic(spark, d):
    u = rs.unit_summary(v.unit_values(spark, d), ["cond", "unit"], "value", lambda c: F.stddev_samp(c) / F.avg(c))
    return u.select("cond", "unit", r("unit_value").alias("cv"), F.col("n_obs").alias("n"))


@query("bootstrap_mean_u1", f"""WITH o AS (SELECT cond, unit, value, row_number() OVER (PARTITION BY cond, unit ORDER BY value) - 1 AS xi FROM v_unit_value),
  c AS (SELECT cond, unit, count(*) AS n, row_number() OVER (PARTITION BY cond ORDER BY unit) - 1 AS ci FROM o GROUP BY 1, 2), k AS (SELECT cond, count(*) AS k FROM c GROUP BY 1),
  s AS (SELECT k.cond, rep, slot, {_H.format("'42', k.cond, CAST(rep AS VARCHAR), CAST(slot AS VARCHAR)")} % k AS ci FROM k, range(2000) t(rep), range(100) q(slot) WHERE slot < k),
  dr AS (SELECT s.cond, rep, s.unit, {_H.format("'42', s.cond, CAST(rep AS VARCHAR), CAST(slot AS VARCHAR), CAST(oo AS VARCHAR)")} % s.n AS xi
    FROM (SELECT s.cond, rep, slot, unit, n, unnest(range(n)) AS oo FROM s JOIN c ON c.cond = s.cond AND c.ci = s.ci) s),
  e AS (SELECT dr.cond, rep, avg(value) AS t FROM dr JOIN o ON o.cond = dr.cond AND o.unit = dr.unit AND o.xi = dr.xi GROUP BY 1, 2)
  SELECT cond, round(quantile_cont(t, 0.025), 4) AS ci_low, round(quantile_cont(t, 0.975), 4) AS ci_high, count(*) AS n_boot FROM e GROUP BY cond""", "v_unit_value")
def bootstrap_mean(spark, d):
    """A caller's statistic, the mean, which needs every drawn value."""
    b = rs.bootstrap_interval(v.unit_values(spark, d), ["cond"], "unit", "value", stat=F.avg)
    return b.select("cond", r("ci_low", 4).alias("ci_low"), r("ci_high", 4).alias("ci_high"), "n_boot")
