"""Shared SQL of the oracles: the scoring chain and the lift kernel."""

from __future__ import annotations

from tidemark.model import NOW, SNAPSHOTS_SQL


def _percentile(v: str, p: str) -> str:
    return f"""CASE WHEN {v} IS NULL OR coalesce({p}n, 0) < 8 THEN NULL WHEN {v} <= 0 THEN 0
  WHEN {v} <= {p}50 THEN 0.5 * {v} / nullif({p}50, 0) WHEN {v} <= {p}75 THEN 0.5 + 0.25 * ({v} - {p}50) / nullif({p}75 - {p}50, 0)
  WHEN {v} <= {p}90 THEN 0.75 + 0.15 * ({v} - {p}75) / nullif({p}90 - {p}75, 0) WHEN {v} <= {p}99 THEN 0.9 + 0.09 * ({v} - {p}90) / nullif({p}99 - {p}90, 0)
  ELSE 0.99 + 0.01 * (1 - 1 / (1 + ln(1 + {v} / greatest({p}99, 1)))) END"""


def _quantiles(v: str, p: str) -> str:
    return f"count({v}) AS {p}n, " + ", ".join(f"quantile_cont({v}, 0.{q}) AS {p}{q if q > 9 else q * 10}" for q in (5, 75, 9, 99))


SCORED_SQL = f"""{SNAPSHOTS_SQL}, placed AS (
  SELECT *, (ts - {NOW}) / 3600.0 AS h, row_number() OVER (PARTITION BY id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM snap
), slopes AS (
  SELECT id, any_value(source) AS source, any_value(author) AS author, count(*) AS observations, min(ts) AS first_ts, max(ts) AS last_ts, max_by(views, ts) AS value, max_by(likes, ts) AS last_likes,
    CASE WHEN count(*) >= 2 THEN regr_slope(views, h) FILTER (i >= n - 5) END AS velocity,
    regr_slope(views, h) FILTER (i <= n // 2) AS v1, regr_slope(views, h) FILTER (i >= n // 2) AS v2 FROM placed GROUP BY id
), shapes AS (
  SELECT *, CASE WHEN observations >= 3 THEN (v2 + 1) / (greatest(v1, 0) + 1) END AS acceleration,
    CASE WHEN value > 0 THEN last_likes / value END AS engagement FROM slopes
), base AS (
  SELECT source, {_quantiles('value', 'v')}, {_quantiles('velocity', 's')} FROM shapes GROUP BY source
), creator AS (
  SELECT a.id, median(b.value) AS mid FROM shapes a JOIN shapes b ON a.author = b.author AND a.id <> b.id GROUP BY a.id HAVING count(*) >= 3
), signal AS (
  SELECT x.*, greatest(0, ({NOW} - first_ts) / 3600.0) AS age, 1 + x.author % 4 AS cross_source,
    {_percentile('x.value', 'v')} AS popularity,
    CASE WHEN velocity IS NULL THEN NULL ELSE coalesce({_percentile('velocity', 's')}, CASE WHEN velocity > 0 THEN least(1, ln(1 + velocity) / ln(1 + 2 * coalesce(s50, greatest(velocity, 1)))) ELSE 0 END) END AS nv,
    CASE WHEN acceleration > 0 THEN greatest(0, least(1, log2(acceleration) / 3)) END AS na,
    CASE WHEN mid IS NOT NULL AND x.value / greatest(mid, 1) > 0 THEN greatest(0, least(1, log10(x.value / greatest(mid, 1)) / 2)) WHEN mid IS NOT NULL THEN 0 END AS nc
  FROM shapes x LEFT JOIN base USING (source) LEFT JOIN creator c ON c.id = x.id
), parts AS (
  SELECT *, coalesce(nc, greatest(0, least(1, (popularity - 0.5) * 2))) AS nn, greatest(0, least(1, engagement / 0.05)) AS ne,
    greatest(0, least(1, (cross_source - 1) / 3)) AS nx, pow(0.5, age / 8) AS nf FROM signal
), weighed AS (
  SELECT *, CASE WHEN nv IS NULL THEN 0 ELSE 0.3 END + CASE WHEN na IS NULL THEN 0 ELSE 0.3 END + CASE WHEN nn IS NULL THEN 0 ELSE 0.15 END
    + CASE WHEN engagement IS NULL THEN 0 ELSE 0.1 END + 0.1 + 0.05 AS w,
    0.3 * coalesce(nv, 0) + 0.3 * coalesce(na, 0) + 0.15 * coalesce(nn, 0) + CASE WHEN engagement IS NULL THEN 0 ELSE 0.1 * ne END + 0.1 * nx + 0.05 * nf AS s FROM parts
), rated AS (
  SELECT *, CAST(w AS DOUBLE) AS coverage, least(100, greatest(0, 100 * s / w * CASE WHEN age > 72 THEN 0.35 ELSE 1 END * (0.55 + 0.45 * w))) AS score FROM weighed
), scored AS (
  SELECT id, source, author, observations, first_ts, last_ts, value, velocity, acceleration, engagement, popularity, age, coverage, score,
    least(1, greatest(0, (0.3 * least(1, observations / 6) + 0.2 * CASE WHEN observations >= 2 THEN least(1, ({NOW} - first_ts) / 3600.0 / 6) ELSE 0 END
      + 0.2 * greatest(0, least(1, 1 - ({NOW} - last_ts) / 3600.0 / 6)) + 0.15 * coverage + 0.15 * nx) * 0.9 + 0.05)) AS confidence,
    CASE WHEN age > 72 AND score < 40 THEN 'DEAD'
      WHEN observations < 2 OR velocity IS NULL THEN CASE WHEN popularity >= 0.95 THEN 'HOT' ELSE 'NEW' END
      WHEN velocity <= 0 OR coalesce(acceleration < 0.6, false) THEN CASE WHEN velocity = 0 THEN CASE WHEN popularity >= 0.9 THEN 'PEAK' ELSE 'NEW' END
        WHEN score < 15 THEN 'DEAD' WHEN score >= 45 THEN 'PEAK' ELSE 'DECLINING' END
      WHEN na >= 0.35 AND (popularity IS NULL OR popularity < 0.8) AND score >= 45 THEN 'EMERGING'
      WHEN score >= 78 AND popularity >= 0.9 THEN 'VIRAL' WHEN score >= 62 AND popularity >= 0.7 THEN 'HOT' WHEN score >= 40 THEN 'RISING' ELSE 'NEW' END AS state
  FROM rated)"""


def lift_sql(keys: list[str], complement: bool = False, whole: bool = False, name: str = "b", final: bool = True) -> str:
    """The lift kernel over ``rows`` (keys, v, sc); ``whole`` (v) is the baseline's rows."""
    k = ", ".join(keys)
    source = "whole" if complement or whole else "rows"
    if complement:
        base, half, keep = "(bs - s) / (bn - n)", "1.96 * sqrt(own / n + (CASE WHEN ov > 1e-12 THEN ov END) / (bn - n))", "WHERE bn - n >= 25"
    else:
        base, half, keep = "bm", "1.96 * sqrt(own / n)", ""
    p = "least(1.0, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))"
    out = f"""g AS (SELECT {k}, count(*) AS n, avg(v) AS m, CASE WHEN count(*) >= 2 AND var_samp(v) > 1e-12 THEN var_samp(v) END AS own, sum(v) AS s, sum(v * v) AS ss, median(sc) AS mid FROM rows GROUP BY {k}),
a AS (SELECT count(*) AS bn, avg(v) AS bm, sum(v) AS bs, sum(v * v) AS bss FROM {source}),
e AS (SELECT *, {base} AS base FROM g, a {keep}),
f AS (SELECT *, (bss - ss - (bn - n) * base * base) / nullif(bn - n - 1, 0) AS ov FROM e),
h AS (SELECT *, {half} AS half FROM f),
y AS (SELECT *, CASE WHEN half > 0 THEN abs(m - base) * 1.96 / half END AS z FROM h),
yt AS (SELECT *, 1 / (1 + 0.2316419 * z) AS t FROM y),
{name} AS (SELECT {k}, n, floor(m * 1000 + 0.5) / 10 AS percentile, floor((m - base) * 1000 + 0.5) / 10 AS lift, CASE WHEN half IS NULL THEN 100 ELSE floor(half * 1000 + 0.5) / 10 END AS margin,
  coalesce(n >= 25 AND abs(m - base) > half, false) AS significant, CASE WHEN z IS NULL OR z = 0 THEN 1 ELSE {p} END AS p, n < 25 AS thin, floor(mid * 10 + 0.5) / 10 AS median_score FROM yt)"""
    return out + (f" SELECT {k}, n, percentile, lift, margin, significant, round(p, 6) AS p, thin, median_score FROM {name}" if final else "")
