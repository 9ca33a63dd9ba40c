"""The same results in DuckDB SQL, written from the definitions of the operators."""

from __future__ import annotations

OBS = """obs AS (
  SELECT CAST(l_partkey % 180 - 90 AS DOUBLE) AS lat,
         CAST(l_suppkey % 360 - 180 AS DOUBLE) AS lon,
         CAST((l_linenumber - 1) * 5 AS DOUBLE) AS depth,
         CAST(month(l_shipdate) AS INTEGER) AS time,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         l_returnflag AS flag, l_linestatus AS status, l_linenumber AS line
  FROM lineitem)"""

CELLS = OBS + """, cells AS (
  SELECT lat, lon, depth, time, avg(quantity) AS quantity, avg(price) AS price
  FROM obs GROUP BY lat, lon, depth, time)"""

ENV = """env AS (
  SELECT lat, lon, depth, time, avg(discount) AS temperature, avg(tax) AS nitrate
  FROM obs WHERE tax > 0.02 GROUP BY lat, lon, depth, time)"""

COMMUNITY = """long AS (
  SELECT CAST(user_id % 180 - 90 AS DOUBLE) AS lat,
         CAST(user_id // 180 - 180 AS DOUBLE) AS lon,
         CAST(day(ts) AS INTEGER) AS time, event_type AS target, round(sum(value), 2) AS value
  FROM events GROUP BY 1, 2, 3, 4)"""

TARGETS = ["click", "error", "purchase", "signup", "view"]

WIDE = COMMUNITY + """, wide AS (
  SELECT lat, lon, time, """ + ", ".join(
    f"max(value) FILTER (target = '{t}') AS {t}" for t in TARGETS
) + """
  FROM long GROUP BY lat, lon, time)"""

TRAITS = """traits AS (
  SELECT event_type AS target, max(value) AS poc, min(value) + 1.0 AS pic
  FROM events GROUP BY event_type)"""

PREDICTIONS = OBS + """, ens AS (
  SELECT lat, lon, time, flag AS target, max(price) AS ul FROM obs GROUP BY lat, lon, time, flag)"""

MEASURED = """measured AS (
  SELECT o_orderkey AS id, o_totalprice AS value,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * (0.05 + (o_custkey % 10) / 100.0::DOUBLE) END AS sd,
         o_orderpriority AS region, nullif(o_orderstatus, 'F') AS method,
         nullif(CAST(o_custkey % 100 AS DOUBLE), 7.0::DOUBLE) AS cells, o_orderdate AS date
  FROM orders)"""

SCORED = """scored AS (
  SELECT doc_id, quality, toxic, (n_chars % 997) / 997.0::DOUBLE AS score
  FROM labels JOIN documents USING (doc_id))"""

VECTORS = """vectors AS (
  SELECT vec_id AS id, CAST(label AS DOUBLE) AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""

PROFILE = """profile AS (
  SELECT CAST(l_partkey % 180 - 90 AS DOUBLE) AS lat, CAST(l_partkey // 180 - 180 AS DOUBLE) AS lon,
         CAST(l_linenumber * 30 AS DOUBLE) AS depth,
         CASE WHEN avg(l_quantity) <= 40 THEN avg(l_quantity) END AS v
  FROM lineitem GROUP BY 1, 2, 3)"""

COARSE = OBS + """, coarse AS (
  SELECT floor((lat + 90) / 2) * 2 - 90 AS lat, floor((lon + 180) / 2) * 2 - 180 AS lon, time,
         avg(quantity) AS v
  FROM obs GROUP BY 1, 2, 3)"""

# Volume of a 1 degree x 1 degree x 5 m cell.
VOLUME = (
    "power(6371000.0::DOUBLE, 2) * (sin(radians(lat) + radians(0.5)) - sin(radians(lat) - radians(0.5)))"
    " * radians(1.0) * 5.0::DOUBLE"
)
ZONAL = (
    "power(6371000.0::DOUBLE, 2) * (sin(radians(lat) + radians(0.5)) - sin(radians(lat) - radians(0.5)))"
    " * 2 * pi() * 5.0::DOUBLE"
)
DAYS = "[31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]::DOUBLE[]"
LEVELS = "levels AS (SELECT CAST(unnest(generate_series(0, 200, 5)) AS DOUBLE) AS level)"

OVERLAP = COARSE + """, src_lat AS (
  SELECT s, greatest(s - 1, -90) AS lo, least(s + 1, 90) AS hi
  FROM (SELECT CAST(unnest(generate_series(-90, 88, 2)) AS DOUBLE) AS s)),
dst_lat AS (
  SELECT t, greatest(t - 0.5, -90) AS lo, least(t + 0.5, 90) AS hi
  FROM (SELECT CAST(unnest(generate_series(-90, 89, 1)) AS DOUBLE) AS t)),
lat_w AS (
  SELECT s, t, sin(radians(least(a.hi, b.hi))) - sin(radians(greatest(a.lo, b.lo))) AS w,
         sin(radians(b.hi)) - sin(radians(b.lo)) AS cell
  FROM src_lat a JOIN dst_lat b ON a.lo < b.hi AND b.lo < a.hi),
src_lon AS (
  SELECT s, s + turn - 1 AS lo, s + turn + 1 AS hi
  FROM (SELECT CAST(unnest(generate_series(-180, 178, 2)) AS DOUBLE) AS s),
       (SELECT CAST(unnest([-360, 0, 360]) AS DOUBLE) AS turn)),
dst_lon AS (SELECT CAST(unnest(generate_series(-180, 179, 1)) AS DOUBLE) AS t),
lon_w AS (
  SELECT s, t, radians(least(hi, t + 0.5)) - radians(greatest(lo, t - 0.5)) AS w, radians(1.0) AS cell
  FROM src_lon JOIN dst_lon ON lo < t + 0.5 AND t - 0.5 < hi),
lat_c AS (SELECT *, sum(w) OVER (PARTITION BY t) AS covered FROM lat_w),
lon_c AS (SELECT *, sum(w) OVER (PARTITION BY t) AS covered FROM lon_w),
spread AS (
  SELECT a.t AS lat, b.t AS lon, time, sum(a.w * b.w * v) AS wv,
         sum(CASE WHEN v IS NOT NULL THEN a.w * b.w END) AS valid, max(a.cell * b.cell) AS cell,
         max(a.covered * b.covered) AS covered
  FROM coarse JOIN lat_c a ON coarse.lat = a.s JOIN lon_c b ON coarse.lon = b.s
  GROUP BY 1, 2, 3)"""

DISTANCE = "list_distance(q.x, b.x)"
CITYBLOCK = "list_sum(list_transform(list_zip(q.x, b.x), lambda z: abs(z[1] - z[2])))"

KNN = VECTORS + f""", pairs AS (
  SELECT q.id AS id, b.y AS y, {DISTANCE} AS d,
         row_number() OVER (PARTITION BY q.id ORDER BY {DISTANCE}, b.id) AS r
  FROM vectors q, vectors b WHERE q.y >= 7 AND b.y < 7),
near AS (SELECT * FROM pairs WHERE r <= 5)"""


def _key(*parts) -> str:
    """60 bits of the digest of salts and keys, as functions/hashing.py defines them."""
    text = ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 15) AS BIGINT)"


def _uniform(*parts) -> str:
    return f"((({_key(*parts)}) >> 8) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"


def _index(n: str, *parts) -> str:
    return f"least(CAST(floor({_uniform(*parts)} * {n}) AS BIGINT), {n} - 1)"


def _normal(seed, i, key: str) -> str:
    turn = f"6.283185307179586::DOUBLE * ({_uniform(seed, i, 2, key)})"
    return f"sqrt(-2.0::DOUBLE * ln({_uniform(seed, i, 1, key)})) * cos({turn})"


def _bags(table: str, ident: str, columns: str, bags: int, share: float, seed: int) -> str:
    return f"""WITH n AS (SELECT count(*) AS n, CAST(floor(count(*) * {share}::DOUBLE) AS BIGINT) AS m FROM {table}),
b AS (SELECT CAST(unnest(range({bags})) AS INTEGER) AS bag),
d AS (SELECT bag, n, unnest(range(m)) AS draw FROM b, n),
w AS (SELECT bag, {_index("n", seed, "bag", "draw")} AS idx, count(*) AS weight FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY {ident}) - 1 AS idx FROM {table})
SELECT {columns}, bag, weight FROM r JOIN w USING (idx)"""


def _fold(k: int) -> str:
    """Stratified fold of the j-th row (from 0) of a class filling positions [o, o + n):
    position p belongs to fold p mod k, and the class fills its folds in order."""
    filled = [
        " + ".join(
            f"(CAST(floor((o + n - 1 - {i}) / {k}.0) AS BIGINT) - CAST(floor((o - 1 - {i}) / {k}.0) AS BIGINT))"
            for i in range(f + 1)
        )
        for f in range(k - 1)
    ]
    steps = " + ".join(f"CASE WHEN j >= {a} THEN 1 ELSE 0 END" for a in filled)
    return f"CAST({steps} AS INTEGER)"


def _applicability(train: str, quartiles: tuple[float, float], cap: bool) -> str:
    low, high = quartiles
    cut = f"quantile_cont(di, {high}) + 1.5 * (quantile_cont(di, {high}) - quantile_cont(di, {low}))"
    if cap:
        cut = f"greatest({cut}, max(di))"
    return "WITH " + VECTORS + f""", w AS (
  SELECT id, y, list_transform(x, lambda v, i: v * i / 2080.0::DOUBLE) AS x FROM vectors),
train AS (SELECT * FROM w WHERE {train}), test AS (SELECT * FROM w WHERE y >= 7),
tt AS (SELECT q.id AS id, b.id AS other, {DISTANCE} AS d FROM train q, train b),
mean AS (SELECT avg(d) AS m FROM tt WHERE d > 0),
di AS (SELECT id, min(d) / (SELECT m FROM mean) AS di FROM tt WHERE id <> other GROUP BY id),
cut AS (SELECT {cut} AS cut FROM di),
qt AS (SELECT q.id AS id, {DISTANCE} AS d FROM test q, train b),
r AS (SELECT (SELECT cut FROM cut) * avg(d) AS r FROM qt)
SELECT id, CAST(min(d) / (SELECT m FROM mean) >= (SELECT cut FROM cut) AS INTEGER) AS aoa,
       round(min(d) / (SELECT m FROM mean), 6) AS di,
       CAST(count(*) FILTER (d < (SELECT r FROM r)) AS BIGINT) AS lpd,
       round((SELECT cut FROM cut), 6) AS cutpoint
FROM qt GROUP BY id"""


def _vote(value: str) -> str:
    return "WITH " + OBS + f""", e AS (
  SELECT flag AS model, status AS target, avg(discount) AS mae FROM obs GROUP BY 1, 2),
weights AS (SELECT model, target, (1 / mae) / sum(1 / mae) OVER (PARTITION BY target) AS weight FROM e),
votes AS (
  SELECT lat, lon, flag AS model, status AS target, {value} AS v FROM obs GROUP BY 1, 2, 3, 4),
voted AS (
  SELECT target, lat, lon, sum(v * weight) / sum(weight) AS v
  FROM votes JOIN weights USING (model, target) GROUP BY 1, 2, 3)
"""


def _resample(values: str) -> str:
    return f"""round(list_avg({values}), 6) AS mean, round(list_stddev_samp({values}), 6) AS stdev,
       round(list_aggregate({values}, 'quantile_cont', 0.025), 6) AS "prctile_2.5",
       round(list_aggregate({values}, 'quantile_cont', 0.975), 6) AS "prctile_97.5" """


ALL = "[" + ", ".join(TARGETS) + "]"
SUM = " + ".join(f"coalesce({t}, 0)" for t in TARGETS)

INTERP = "WITH " + PROFILE + ", " + LEVELS + """, seg AS (
  SELECT *, lag(depth) OVER w AS d0, lag(v) OVER w AS v0, lead(depth) OVER w AS d2, lead(v) OVER w AS v2
  FROM profile WINDOW w AS (PARTITION BY lat, lon ORDER BY depth))
SELECT lat, lon, level AS depth,
       round(CASE WHEN d0 IS NULL THEN CASE WHEN d2 IS NULL OR v2 IS NOT NULL THEN v END
                  ELSE v0 + (v - v0) / (seg.depth - d0) * (level - d0) END, 6) AS quantity
FROM seg JOIN levels ON (d0 IS NULL AND level = seg.depth) OR (level > d0 AND level <= seg.depth)"""

SQL: dict[str, str] = {
    # volumetric integration
    "monthly_total": "WITH " + CELLS + f"""
SELECT time, 'quantity' AS variable, round(sum(quantity * {VOLUME}) * 1e-12, 4) AS total
FROM cells GROUP BY time""",
    "integrate_all_targets": "WITH " + CELLS + f""", s AS (
  SELECT sum(quantity * {VOLUME}) AS quantity, sum(price * {VOLUME}) AS price FROM cells)
SELECT 'quantity' AS variable, round(quantity * 1e-15, 4) AS total FROM s
UNION ALL SELECT 'price', round(price * 1e-15, 4) FROM s""",
    "integrate_rate": "WITH " + CELLS + f"""
SELECT 'quantity' AS variable,
       round(sum(quantity * {VOLUME} * ({DAYS})[time]) * 12.01 * 1e-15, 4) AS total FROM cells""",
    "integrate_rate_monthly": "WITH " + CELLS + f"""
SELECT time, 'quantity' AS variable,
       round(sum(quantity * {VOLUME} * ({DAYS})[time]) * 1e3 * 1e-17, 4) AS total
FROM cells GROUP BY time""",
    "integrate_upper_depth": "WITH " + CELLS + f"""
SELECT 'quantity' AS variable, round(sum(quantity * {VOLUME}) * 1e-13, 4) AS total
FROM cells WHERE depth BETWEEN 0 AND 15""",
    "integrate_zonal": "WITH " + OBS + f""", z AS (
  SELECT lat, depth, avg(quantity) AS quantity FROM obs GROUP BY lat, depth)
SELECT 'quantity' AS variable, round(sum(quantity * {ZONAL}) * 1e-15, 4) AS total FROM z""",
    "integrate_mean_over_time": "WITH " + CELLS + f"""
SELECT 'quantity' AS variable,
       round(sum(quantity * {VOLUME}) * 1e-13 / count(DISTINCT time), 4) AS total FROM cells""",
    "cell_volume": "WITH " + CELLS + f"""
SELECT lat, lon, depth, time, round({VOLUME} * 1e-9, 4) AS volume FROM cells""",
    # scans and reshaping
    "fields_of_statistic": "WITH " + PREDICTIONS + """
SELECT * FROM (
  SELECT lat, lon, time, max(ul) FILTER (target = 'A') AS A, max(ul) FILTER (target = 'N') AS N,
         max(ul) FILTER (target = 'R') AS R FROM ens GROUP BY lat, lon, time)
WHERE A IS NOT NULL AND N IS NOT NULL AND R IS NOT NULL""",
    "field_write_and_read": "WITH " + CELLS + """
SELECT lat, lon, depth, time, round(quantity, 6) AS quantity FROM cells""",
    "csv_round_trip": "WITH " + CELLS + """
SELECT lat, lon, depth, time, round(quantity, 6) AS quantity, round(price, 6) AS price FROM cells""",
    "to_wide": "WITH " + WIDE + " SELECT * FROM wide",
    "to_wide_complete": "WITH " + WIDE + " SELECT * FROM wide WHERE "
    + " AND ".join(f"{t} IS NOT NULL" for t in TARGETS),
    "to_long": "WITH " + WIDE + " "
    + " UNION ALL ".join(
        f"SELECT lat, lon, time, '{t}' AS target, {t} AS value FROM wide" for t in TARGETS
    ),
    "distinct_targets": "SELECT DISTINCT event_type AS target FROM events ORDER BY 1",
    # projections and filters
    "select_predictors": "WITH " + OBS + " SELECT lat, lon, depth, time, quantity, discount FROM obs",
    "join_obs_env": "WITH " + CELLS + ", " + ENV + """
SELECT lat, lon, depth, time, round(quantity, 6) AS quantity,
       round(temperature, 6) AS temperature, round(nitrate, 6) AS nitrate
FROM cells LEFT JOIN env USING (lat, lon, depth, time)""",
    "drop_missing_subset": "WITH " + CELLS + ", " + ENV + """
SELECT lat, lon, depth, time, round(quantity, 6) AS quantity,
       round(temperature, 6) AS temperature, round(nitrate, 6) AS nitrate
FROM cells JOIN env USING (lat, lon, depth, time) WHERE temperature IS NOT NULL""",
    "drop_missing_any": "WITH " + MEASURED + """
SELECT id, region, method, cells FROM measured
WHERE value IS NOT NULL AND sd IS NOT NULL AND region IS NOT NULL AND method IS NOT NULL
  AND cells IS NOT NULL AND date IS NOT NULL""",
    "exclude_methods": "WITH " + MEASURED + """
SELECT id, method, value FROM measured WHERE method IS NULL OR method NOT IN ('P')""",
    "drop_ratio_above": "WITH " + MEASURED + """
SELECT id, value, cells FROM measured
WHERE NOT (cells IS NOT NULL AND CASE WHEN cells = 0 THEN value > 0 ELSE value / cells > 3500 END)""",
    "upper_bound": "SELECT o_orderkey AS id, o_totalprice AS value FROM orders WHERE o_totalprice <= 250000",
    "presence_rows": "WITH " + OBS + " SELECT lat, lon, depth, time, discount FROM obs WHERE discount <> 0",
    "presence_label": "WITH " + MEASURED + """
SELECT id, CASE WHEN cells IS NULL THEN NULL WHEN cells = 0 THEN 0 ELSE 1 END AS present FROM measured""",
    "depth_subset": "WITH " + OBS + """
SELECT lat, lon, depth, time, price FROM obs WHERE depth >= 0 AND depth <= 15""",
    "renamed_coordinates": """SELECT l_partkey AS lat, l_suppkey AS lon, l_linenumber AS depth, l_quantity
FROM lineitem""",
    "colour_index": "WITH " + OBS + ", " + ENV + """
SELECT lat, lon, depth, time, round(temperature - nitrate, 6) AS index FROM env""",
    "mask_incomplete": "WITH " + MEASURED + """, m AS (
  SELECT *, value IS NOT NULL AND sd IS NOT NULL AND cells IS NOT NULL AS ok FROM measured)
SELECT id, CASE WHEN ok THEN value END AS value, round(CASE WHEN ok THEN sd END, 4) AS sd,
       CASE WHEN ok THEN cells END AS cells FROM m""",
    "sentinel_to_null": "WITH " + OBS + """
SELECT lat, lon, depth, time, nullif(discount, 0.0::DOUBLE) AS discount, nullif(flag, 'N') AS flag FROM obs""",
    "fill_missing": "WITH " + MEASURED + """
SELECT id, coalesce(cells, 0.0::DOUBLE) AS cells, coalesce(method, 'none') AS method FROM measured""",
    "replicate_depth": "WITH " + OBS + ", " + LEVELS + """, s AS (
  SELECT lat, time, avg(quantity) AS quantity FROM obs GROUP BY lat, time)
SELECT lat, time, round(quantity, 6) AS quantity, level AS depth FROM s, levels""",
    "species_names": """SELECT p_partkey,
  CASE WHEN len(words) <= 1 THEN p_name
       ELSE upper(words[1][1]) || '. ' || array_to_string(words[2:], ' ') END AS short,
  replace(p_name, ' ', '_') AS target
FROM (SELECT *, string_split(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), ' ') AS words FROM part)""",
    "months_of_dates": """SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month_from_days
FROM orders""",
    "log_transforms": "WITH " + MEASURED + """
SELECT id, round(ln(1 + value), 6) AS log, round(log10(value + 1), 6) AS log10, round(value, 3) AS back
FROM measured""",
    # joins
    "join_env_complete": "WITH " + CELLS + ", " + ENV + """
SELECT lat, lon, depth, time, round(quantity, 6) AS quantity, round(price, 6) AS price,
       round(temperature, 6) AS temperature, round(nitrate, 6) AS nitrate, 'X' AS FID
FROM cells JOIN env USING (lat, lon, depth, time) WHERE NOT nitrate > 0.05""",
    "align_environment": "WITH " + OBS + ", " + ENV + """, late AS (
  SELECT lat, lon, depth, time, avg(price) AS price FROM obs WHERE tax > 0.03
  GROUP BY lat, lon, depth, time)
SELECT lat, lon, depth, time, round(temperature, 6) AS temperature, round(nitrate, 6) AS nitrate,
       round(price, 6) AS price
FROM env JOIN late USING (lat, lon, depth, time)""",
    "residuals": "WITH " + OBS + ", " + ENV + """
SELECT lat, lon, depth, time, discount, round(temperature, 6) AS discount_mod,
       round(discount - temperature, 6) AS discount_resid
FROM obs LEFT JOIN env USING (lat, lon, depth, time)""",
    "group_statistic": "WITH " + MEASURED + """
SELECT id, value, method, round(avg(value) OVER (PARTITION BY method), 4) AS mean_value FROM measured""",
    "trait_join": "WITH " + COMMUNITY + ", " + TRAITS + """
SELECT lat, lon, time, target, round(value * pic, 4) AS value FROM long JOIN traits USING (target)""",
    # aggregations
    "grid_mean": "WITH " + CELLS + """
SELECT lat, lon, depth, time, round(quantity, 6) AS quantity, round(price, 6) AS price FROM cells""",
    "impute_sd": "WITH " + MEASURED + """, r AS (
  SELECT region, avg(sd / value) AS cv FROM measured GROUP BY region)
SELECT id, value, round(coalesce(sd, value * coalesce(cv, (SELECT avg(sd / value) FROM measured))), 4) AS sd,
       region
FROM measured JOIN r USING (region)""",
    "standard_error": "WITH " + MEASURED + """
SELECT id, round(sd, 4) AS sd, round(sd / sqrt(3), 4) AS se FROM measured""",
    "seasonal_gaps": "WITH " + OBS + """, c AS (
  SELECT lat, lon, time, avg(quantity) AS v FROM obs GROUP BY lat, lon, time),
s AS (SELECT lat, lon, least(0.1 * max(v), min(v)) AS fill FROM c GROUP BY lat, lon),
m AS (SELECT CAST(unnest(generate_series(1, 12)) AS INTEGER) AS time)
SELECT s.lat, s.lon, m.time, round(coalesce(c.v, s.fill), 6) AS quantity
FROM s CROSS JOIN m LEFT JOIN c ON c.lat = s.lat AND c.lon = s.lon AND c.time = m.time""",
    "count_valid": "WITH " + MEASURED + """
SELECT region, count(sd) AS sd_valid, count(*) FILTER (sd <> 0) AS sd_nonzero,
       count(cells) AS cells_valid, count(*) FILTER (cells <> 0) AS cells_nonzero
FROM measured GROUP BY region""",
    "mean_over_depth_and_time": "WITH " + CELLS + """
SELECT lat, lon, round(avg(quantity), 6) AS quantity FROM cells GROUP BY lat, lon""",
    "field_sum": "WITH " + WIDE + " SELECT "
    + ", ".join(f"round(sum({t}), 2) AS {t}" for t in TARGETS) + " FROM wide",
    "performance_summary": "WITH " + OBS + """, f AS (
  SELECT flag AS model, status AS target, line, avg(discount) AS r2, avg(tax) AS mae, avg(quantity) AS rmse
  FROM obs GROUP BY 1, 2, 3),
cell AS (
  SELECT status AS target, avg(price) AS p FROM obs GROUP BY status, lat, lon, depth, time),
m AS (SELECT target, avg(p) AS mean FROM cell GROUP BY target)
SELECT model, target, round(avg(r2), 8) AS R2, round(avg(rmse), 8) AS RMSE, round(avg(mae), 8) AS MAE,
       round(avg(rmse) / any_value(mean), 8) AS rRMSE, round(avg(mae) / any_value(mean), 8) AS rMAE
FROM f JOIN m USING (target) GROUP BY model, target""",
    "regression_metrics": "WITH " + OBS + """, e AS (
  SELECT line, quantity AS y, (0.05 - discount) * 100 AS e FROM obs),
m AS (SELECT line, avg(y) AS mean FROM e GROUP BY line)
SELECT line, round(1 - sum(e * e) / sum((y - mean) * (y - mean)), 6) AS R2, round(avg(abs(e)), 6) AS MAE,
       round(sqrt(avg(e * e)), 6) AS RMSE, round(avg(abs(e)) / any_value(mean), 6) AS rMAE,
       round(sqrt(avg(e * e)) / any_value(mean), 6) AS rRMSE
FROM e JOIN m USING (line) GROUP BY line""",
    "balanced_accuracy": "WITH " + SCORED + """, r AS (
  SELECT toxic, quality, avg(CASE WHEN CAST(score > 0.5 AS INTEGER) = quality THEN 1.0 ELSE 0.0 END) AS recall
  FROM scored GROUP BY toxic, quality)
SELECT toxic, round(avg(recall), 8) AS balanced_accuracy FROM r GROUP BY toxic""",
    # community metrics
    "carbon_by_trait": "WITH " + WIDE + ", " + TRAITS + " SELECT lat, lon, time, "
    + ", ".join(
        f"round({t} * (SELECT poc FROM traits WHERE target = '{t}'), 4) AS {t}" for t in TARGETS
    ) + " FROM wide",
    "group_sums": "WITH " + WIDE + """
SELECT *, round(CASE WHEN click IS NULL AND view IS NULL THEN NULL
                     ELSE coalesce(click, 0) + coalesce(view, 0) END, 2) AS browse,
       round(CASE WHEN purchase IS NULL AND signup IS NULL THEN NULL
                  ELSE coalesce(purchase, 0) + coalesce(signup, 0) END, 2) AS act
FROM wide""",
    "row_total": "WITH " + WIDE + f"""
SELECT *, round({SUM}, 6) AS total,
       CASE WHEN {SUM} = 0 THEN '-inf'::DOUBLE ELSE round(ln({SUM}), 6) END AS total_log
FROM wide""",
    "weighted_trait_mean": "WITH " + WIDE + ", " + TRAITS + """
SELECT lat, lon, time, """ + ", ".join(f"coalesce({t}, 0) AS {t}" for t in TARGETS) + ", round(("
    + " + ".join(
        f"coalesce({t}, 0) * (SELECT pic FROM traits WHERE target = '{t}')" for t in TARGETS
    ) + f") / nullif({SUM}, 0), 6) AS \"cwm pg pic\" FROM wide",
    "shannon_diversity": "WITH " + WIDE + """, h AS (
  SELECT *, CASE WHEN """ + SUM + " > 0 THEN -("
    + " + ".join(
        f"CASE WHEN coalesce({t}, 0) > 0 THEN {t} / ({SUM}) * ln({t} / ({SUM})) ELSE 0 END"
        for t in TARGETS
    ) + """) END AS h FROM wide)
SELECT * EXCLUDE (h), round(h, 6) AS shannon, round(h / ln(2), 6) AS shannon_base_2 FROM h""",
    "resample_statistics": "WITH " + WIDE + f"""
SELECT *, {_resample(ALL)} FROM wide""",
    "resample_statistics_long": "WITH " + COMMUNITY + """
SELECT lat, lon, time, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev,
       round(quantile_cont(value, 0.025), 6) AS "prctile_2.5",
       round(quantile_cont(value, 0.975), 6) AS "prctile_97.5"
FROM long GROUP BY lat, lon, time""",
    "row_quantile": "WITH " + COMMUNITY + """
SELECT lat, lon, time, round(quantile_cont(value, 0.4), 4) AS q FROM long GROUP BY lat, lon, time""",
    "weighted_row_quantile": "WITH " + WIDE + ", pairs AS ("
    + " UNION ALL ".join(
        f"SELECT lat, lon, time, coalesce({t}, 0) AS v, {2 ** i} AS w FROM wide"
        for i, t in enumerate(TARGETS)
    ) + """), cum AS (
  SELECT *, sum(w) OVER (PARTITION BY lat, lon, time ORDER BY v, w) AS c FROM pairs)
SELECT lat, lon, time, min(v) AS q FROM cum WHERE c / 31.0 >= 0.3 GROUP BY lat, lon, time""",
    # binning, interpolation, regridding
    "coordinate_bins": """WITH raw AS (
  SELECT l_extendedprice % 180 - 90 AS x, l_extendedprice % 360 - 180 AS y,
         floor(l_extendedprice) % 206 AS z FROM lineitem)
SELECT CASE WHEN ceil(x + 90) BETWEEN 1 AND 180 THEN ceil(x + 90) - 91 END AS lat,
       CASE WHEN ceil(y + 180) BETWEEN 1 AND 360 THEN ceil(y + 180) - 181 END AS lon,
       CASE WHEN ceil(z / 5) BETWEEN 1 AND 41 THEN (ceil(z / 5) - 1) * 5 END AS depth,
       count(*) AS n
FROM raw GROUP BY 1, 2, 3""",
    "interpolate_depth": INTERP,
    "regrid_conservative": "WITH " + OVERLAP + """
SELECT lat, lon, time, round(CASE WHEN 1 - valid / cell <= 0.75 + 1e-6 THEN wv / valid END, 6) AS quantity
FROM spread""",
    "regrid_conservative_strict": "WITH " + OVERLAP + """
SELECT lat, lon, time, round(CASE WHEN valid >= covered * (1 - 1e-6) THEN wv / cell END, 6) AS quantity
FROM spread""",
    "regrid_bilinear": "WITH " + COARSE + """,
dst_lat AS (SELECT CAST(unnest(generate_series(-90, 89, 1)) AS DOUBLE) AS t),
dst_lon AS (SELECT CAST(unnest(generate_series(-180, 179, 1)) AS DOUBLE) AS t),
near AS (
  SELECT a.t AS lat, b.t AS lon, time, v,
         (1 - abs(a.t - c.lat) / 2)
         * (1 - least(abs(b.t - c.lon), 360 - abs(b.t - c.lon)) / 2) AS w
  FROM coarse c JOIN dst_lat a ON abs(a.t - c.lat) < 2
       JOIN dst_lon b ON least(abs(b.t - c.lon), 360 - abs(b.t - c.lon)) < 2)
SELECT lat, lon, time, round(CASE WHEN sum(w) >= 1 - 1e-6 THEN sum(w * v) END, 6) AS quantity
FROM near GROUP BY lat, lon, time""",
    "dense_grid": "WITH " + CELLS + """
SELECT a.lat, l.lon, b.depth, d.time, round(c.price, 6) AS price
FROM (SELECT DISTINCT lat FROM cells) a CROSS JOIN (SELECT DISTINCT lon FROM cells) l
CROSS JOIN (SELECT DISTINCT depth FROM cells) b CROSS JOIN (SELECT DISTINCT time FROM cells) d
LEFT JOIN cells c ON c.lat = a.lat AND c.lon = l.lon AND c.depth = b.depth AND c.time = d.time""",
    # folds and resampling
    "plain_folds": """SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold
FROM orders""",
    "zero_stratified_folds": "WITH " + SCORED + """, c AS (
  SELECT doc_id, CAST(quality AS DOUBLE) AS y, CAST(quality <> 0 AS INTEGER) AS cls FROM scored),
s AS (SELECT cls, count(*) AS n, min(doc_id) AS first FROM c GROUP BY cls),
o AS (SELECT cls, n, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM s),
j AS (SELECT doc_id, y, n, o, row_number() OVER (PARTITION BY cls ORDER BY doc_id) - 1 AS j
      FROM c JOIN o USING (cls))
SELECT doc_id, y, """ + _fold(5) + " AS fold FROM j",
    "zero_stratified_folds_by_target": "WITH " + MEASURED + """, c AS (
  SELECT id, coalesce(cells, 0.0::DOUBLE) AS y, region AS target,
         CAST(coalesce(cells, 0) <> 0 AS INTEGER) AS cls FROM measured),
s AS (SELECT target, cls, count(*) AS n, min(id) AS first FROM c GROUP BY target, cls),
o AS (SELECT target, cls, n, coalesce(sum(n) OVER (PARTITION BY target ORDER BY first
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM s),
j AS (SELECT id, y, target, n, o, row_number() OVER (PARTITION BY target, cls ORDER BY id) - 1 AS j
      FROM c JOIN o USING (target, cls))
SELECT id, y, target, """ + _fold(4) + " AS fold FROM j",
    "folds_with_null_group": "WITH " + MEASURED + """
SELECT id, method, CAST(ntile(5) OVER (PARTITION BY method ORDER BY id) - 1 AS INTEGER) AS fold FROM measured""",
    "zero_stratified_folds_with_null_group": "WITH " + MEASURED + """, c AS (
  SELECT id, coalesce(cells, 0.0::DOUBLE) AS y, method, coalesce(method, '-') AS g,
         CAST(coalesce(cells, 0) <> 0 AS INTEGER) AS cls FROM measured),
s AS (SELECT g, cls, count(*) AS n, min(id) AS first FROM c GROUP BY g, cls),
o AS (SELECT g, cls, n, coalesce(sum(n) OVER (PARTITION BY g ORDER BY first
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM s),
j AS (SELECT id, y, method, n, o, row_number() OVER (PARTITION BY g, cls ORDER BY id) - 1 AS j
      FROM c JOIN o USING (g, cls))
SELECT id, y, method, """ + _fold(4) + " AS fold FROM j",
    "shuffled_order": f"SELECT o_orderkey, {_key(1, 'o_orderkey')} AS \"order\" FROM orders",
    "shuffled_folds": f"""SELECT o_orderkey,
       CAST(ntile(7) OVER (ORDER BY {_key(1, 'o_orderkey')}, o_orderkey) - 1 AS INTEGER) AS fold FROM orders""",
    "upsampled_absences": "WITH " + SCORED + f""",
a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM scored WHERE quality = 0),
n AS (SELECT count(*) FILTER (quality <> 0) * 10 AS m, count(*) FILTER (quality = 0) AS n FROM scored),
d AS (SELECT n, unnest(range(m)) AS draw FROM n),
w AS (SELECT {_index("n", 1, "draw")} AS idx FROM d)
SELECT doc_id, 1.0::DOUBLE AS y, count(*) AS n FROM scored WHERE quality <> 0 GROUP BY doc_id
UNION ALL SELECT doc_id, 0.0::DOUBLE, count(*) FROM a JOIN w USING (idx) GROUP BY doc_id""",
    "upsampled_fold_sizes": "WITH " + SCORED + """, c AS (
  SELECT doc_id, 1.0::DOUBLE - quality AS y, CAST(quality = 0 AS INTEGER) AS cls FROM scored),
s AS (SELECT cls, count(*) AS n, min(doc_id) AS first FROM c GROUP BY cls),
o AS (SELECT cls, n, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM s),
j AS (SELECT doc_id, y, cls, n, o, row_number() OVER (PARTITION BY cls ORDER BY doc_id) - 1 AS j
      FROM c JOIN o USING (cls)),
f AS (SELECT doc_id, y, cls, """ + _fold(3) + """ AS fold FROM j),
p AS (SELECT split, doc_id, y, cls FROM f, (SELECT CAST(unnest(range(3)) AS INTEGER) AS split) WHERE fold <> split),
t AS (SELECT *, row_number() OVER (PARTITION BY split, cls ORDER BY doc_id) - 1 AS idx FROM p),
n AS (SELECT split, count(*) FILTER (cls = 0) AS m, count(*) FILTER (cls = 1) AS n FROM p GROUP BY split),
d AS (SELECT split, n, unnest(range(m)) AS draw FROM n),
w AS (SELECT split, """ + _index("n", 2, "split", "draw") + """ AS idx, count(*) AS weight FROM d GROUP BY ALL)
SELECT split, doc_id, y, 1::BIGINT AS weight FROM t WHERE cls = 0
UNION ALL SELECT split, doc_id, y, weight FROM t JOIN w USING (split, idx) WHERE cls = 1""",
    "resampled_targets": "WITH " + MEASURED + """, e AS (
  SELECT id, value, sd / sqrt(3) AS se FROM measured WHERE sd IS NOT NULL)
SELECT id, round(value, 4) AS value, round(se, 4) AS se, """ + ", ".join(
        f"round(greatest(0.0, value + se * {_normal(42, i, 'id')}), 4) AS sample_{i}" for i in range(1, 6)
    ) + " FROM e",
    "resampled_targets_long": "WITH " + MEASURED + f""", e AS (
  SELECT id, value, sd / sqrt(3) AS se FROM measured WHERE sd IS NOT NULL)
SELECT 'sample_' || i AS target, count(*) AS n,
       round(avg(greatest(0.0, value + se * {_normal(42, "i", "id")})), 2) AS mean
FROM e, (SELECT unnest(generate_series(1, 50)) AS i) GROUP BY i""",
    "pseudo_absences": "WITH " + CELLS + ", " + ENV + f""", z AS (
  SELECT lat, lon, depth, time, row_number() OVER (
    ORDER BY {_key(42, "lat", "lon", "depth", "time")}, lat, lon, depth, time) - 1 AS idx
  FROM env WHERE temperature <= 0.05)
SELECT lat, lon, depth, time, round(quantity, 6) AS quantity FROM cells
UNION ALL SELECT lat, lon, depth, time, 0.0 FROM z WHERE idx < (SELECT count(*) // 10 FROM cells)""",
    "bag_sizes": _bags("orders", "o_orderkey", "o_orderkey", 4, 0.2, 1),
    "bootstrap_bags": _bags(
        "(SELECT vec_id AS id, CAST(label AS DOUBLE) AS y FROM embeddings)", "id", "id, y", 3, 0.5, 1
    ),
    # feature preparation, weights, thresholds
    "standardised_features": "WITH " + MEASURED + """
SELECT id, round((value - (SELECT avg(value) FROM measured)) / (SELECT stddev_pop(value) FROM measured), 6) AS value,
       round((sd - (SELECT avg(sd) FROM measured)) / (SELECT stddev_pop(sd) FROM measured), 6) AS sd
FROM measured""",
    "one_hot_regions": "WITH " + MEASURED + """, r AS (
  SELECT region, row_number() OVER (ORDER BY region) AS i FROM (SELECT DISTINCT region FROM measured))
SELECT id, round((value - (SELECT avg(value) FROM measured)) / (SELECT stddev_pop(value) FROM measured), 6) AS x0,
       """ + ", ".join(f"CAST(i = {i} AS DOUBLE) AS x{i}" for i in range(1, 6)) + """
FROM measured JOIN r USING (region)""",
    "inverse_error_weights": "WITH " + OBS + """, e AS (
  SELECT flag AS model, status AS target, avg(discount) AS mae FROM obs GROUP BY 1, 2)
SELECT model, target, round(mae, 8) AS mae,
       round((1 / mae) / sum(1 / mae) OVER (PARTITION BY target), 8) AS weight FROM e""",
    "voted_mean": _vote("avg(price)") + """
SELECT target, lat, lon, round(v, 4) AS prediction FROM voted""",
    "voted_class": _vote("avg(price) / 110000") + """
SELECT target, lat, lon, round(v, 9) AS proba, CAST(v > 0.5 AS INTEGER) AS class FROM voted""",
    "youden_threshold": "WITH " + SCORED + """, c AS (
  SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n
  FROM scored GROUP BY score),
r AS (SELECT score, sum(p) OVER (ORDER BY score DESC) / (SELECT sum(p) FROM c)
             - sum(n) OVER (ORDER BY score DESC) / (SELECT sum(n) FROM c) AS gain FROM c)
SELECT round(score, 8) AS threshold, round(gain, 8) AS gain FROM r ORDER BY gain DESC, score DESC LIMIT 1""",
    "roc_curve": "WITH " + SCORED + """, c AS (
  SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n
  FROM scored GROUP BY score)
SELECT round(score, 8) AS threshold,
       round(sum(p) OVER (ORDER BY score DESC) / (SELECT sum(p) FROM c), 8) AS tpr,
       round(sum(n) OVER (ORDER BY score DESC) / (SELECT sum(n) FROM c), 8) AS fpr FROM c""",
    "member_loss_weights": "WITH " + OBS + """, l AS (
  SELECT 0 AS member, avg(abs(tax - price / 100000)) AS loss FROM obs
  UNION ALL SELECT 1, avg(abs(discount - price / 100000)) FROM obs
  UNION ALL SELECT 2, avg(abs(quantity / 100 - price / 100000)) FROM obs)
SELECT member, round((1 / loss) / sum(1 / loss) OVER (), 8) AS weight FROM l""",
    "member_class_weights": "WITH " + SCORED + """, m AS (
  SELECT 0 AS member, quality, CAST(score > 0.3 AS INTEGER) AS p FROM scored
  UNION ALL SELECT 1, quality, CAST(score > 0.6 AS INTEGER) FROM scored),
r AS (SELECT member, quality, avg(CASE WHEN p = quality THEN 1.0 ELSE 0.0 END) AS recall FROM m GROUP BY 1, 2),
l AS (SELECT member, 1 - avg(recall) AS loss FROM r GROUP BY member)
SELECT member, round((1 / loss) / sum(1 / loss) OVER (), 8) AS weight FROM l""",
    "two_phase_interval": "WITH " + OBS + """, b AS (
  SELECT lat, lon, depth, time, min(discount) AS cl, max(discount) AS cu, min(price) AS rl, max(price) AS ru
  FROM obs GROUP BY lat, lon, depth, time)
SELECT lat, lon, depth, time, CASE WHEN cl < 0.045 THEN 0 ELSE rl END AS ci95_LL,
       CASE WHEN cu < 0.045 THEN 0 ELSE ru END AS ci95_UL FROM b""",
    "cut_rules": """WITH di AS (SELECT o_totalprice / 1000 AS di FROM orders),
q AS (
  SELECT quantile_cont(di, 0.0025) AS a, quantile_cont(di, 0.0075) AS b, quantile_cont(di, 0.25) AS c,
         quantile_cont(di, 0.75) AS d, median(di) AS m, quantile_cont(di, 0.9) AS p, max(di) AS top FROM di)
SELECT 'tukey' AS rule, 'as_coded' AS scale, round(b + 1.5 * (b - a), 6) AS cut FROM q
UNION ALL SELECT 'tukey', 'standard', round(d + 1.5 * (d - c), 6) FROM q
UNION ALL SELECT 'mad', 'standard', round(m + 3 * (SELECT median(abs(di - (SELECT m FROM q))) FROM di), 6) FROM q
UNION ALL SELECT '0.9', 'standard', round(p, 6) FROM q
UNION ALL SELECT 'tukey', 'capped', round(greatest(b + 1.5 * (b - a), top), 6) FROM q""",
    # nearest neighbours and applicability
    "nearest_neighbours": "WITH " + VECTORS + f""", r AS (
  SELECT q.id AS id, b.id AS neighbour, {DISTANCE} AS d,
         row_number() OVER (PARTITION BY q.id ORDER BY {DISTANCE}, b.id) AS rank
  FROM vectors q, vectors b WHERE q.id <> b.id)
SELECT id, CAST(rank AS INTEGER) AS rank, neighbour, round(d, 6) AS distance FROM r WHERE rank <= 3""",
    "nearest_neighbours_cityblock": "WITH " + VECTORS + f""", r AS (
  SELECT q.id AS id, b.id AS neighbour, {CITYBLOCK} AS d,
         row_number() OVER (PARTITION BY q.id ORDER BY {CITYBLOCK}, b.id) AS rank
  FROM vectors q, vectors b WHERE q.y >= 7 AND b.y < 7)
SELECT id, CAST(rank AS INTEGER) AS rank, neighbour, round(d, 6) AS distance FROM r WHERE rank <= 2""",
    "knn_regression": "WITH " + KNN + " SELECT id, round(avg(y), 6) AS p FROM near GROUP BY id",
    "knn_regression_by_distance": "WITH " + KNN + """
SELECT id, round(CASE WHEN min(d) = 0 THEN avg(y) FILTER (d = 0) ELSE sum(y / d) / sum(1 / d) END, 6) AS p
FROM near GROUP BY id""",
    "knn_classification": "WITH " + KNN + """
SELECT id, CAST(avg(CAST(y <> 0 AS INTEGER)) > 0.5 AS DOUBLE) AS p,
       round(avg(CAST(y <> 0 AS INTEGER)), 6) AS p_proba FROM near GROUP BY id""",
    "applicability": _applicability("y < 7", (0.0025, 0.0075), cap=True),
    "applicability_standard_cut": _applicability("y < 7 AND y > 0", (0.25, 0.75), cap=False),
    "applicability_by_fold": "WITH " + VECTORS + f""", w AS (
  SELECT id, y, list_transform(x, lambda v, i: v * i / 2080.0::DOUBLE) AS x FROM vectors),
train AS (SELECT *, ntile(4) OVER (ORDER BY id) AS fold FROM w WHERE y < 7),
tt AS (SELECT q.id AS id, {DISTANCE} AS d FROM train q, train b WHERE q.fold <> b.fold),
mean AS (SELECT avg(d) AS m FROM tt),
di AS (SELECT id, min(d) / (SELECT m FROM mean) AS di FROM tt GROUP BY id),
cut AS (SELECT greatest(quantile_cont(di, 0.0075)
               + 1.5 * (quantile_cont(di, 0.0075) - quantile_cont(di, 0.0025)), max(di)) AS cut FROM di),
t AS (SELECT q.id AS id, min({DISTANCE}) / (SELECT m FROM mean) AS di
      FROM w q, train b WHERE q.y >= 7 GROUP BY q.id)
SELECT id, CAST(di >= (SELECT cut FROM cut) AS INTEGER) AS aoa, round(di, 6) AS di,
       round((SELECT cut FROM cut), 6) AS cutpoint FROM t""",
}
SQL["fields_from_stored_predictions"] = SQL["fields_of_statistic"]
SQL["monthly_files"] = SQL["field_write_and_read"]
COSINE = "1 - list_cosine_similarity(q.x, b.x)"
CANBERRA = """list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.x[i] = b.x[i] THEN 0.0::DOUBLE
    ELSE abs(q.x[i] - b.x[i]) / (abs(q.x[i]) + abs(b.x[i])) END))"""
for _name, _distance in (("cosine", COSINE), ("canberra", CANBERRA)):
    SQL[f"nearest_neighbours_{_name}"] = SQL["nearest_neighbours_cityblock"].replace(CITYBLOCK, _distance)
    SQL[f"nearest_neighbours_{_name}_boxed"] = SQL[f"nearest_neighbours_{_name}"]
SQL["nearest_neighbours_boxed"] = SQL["nearest_neighbours"]
SQL["knn_regression_boxed"] = SQL["knn_regression"]
SQL["applicability_boxed"] = SQL["applicability"]


# --- model runs with a closed form -------------------------------------------------------

GROUPED = """grouped AS (
  SELECT o_orderkey AS id, CAST(o_custkey % 9 IN (0, 1, 3) AS DOUBLE) AS x, CAST(o_custkey % 5 < 2 AS DOUBLE) AS z,
         CASE WHEN o_custkey % 3 = 0 THEN 0.0::DOUBLE ELSE o_totalprice / 1000.0::DOUBLE END AS y
  FROM orders)"""

SHARES = "WITH " + GROUPED + """, s AS (
  SELECT id, x, y, avg(CAST(y <> 0 AS DOUBLE)) OVER (PARTITION BY x) AS s FROM grouped)
"""

HELD_OUT = "WITH " + GROUPED + """, f AS (SELECT *, CAST(ntile(3) OVER (ORDER BY id) - 1 AS INTEGER) AS fold FROM grouped),
k AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS fold),
m AS (SELECT k.fold, x, avg(y) AS p FROM f JOIN k ON f.fold <> k.fold GROUP BY k.fold, x),
a AS (SELECT k.fold, avg(y) AS p FROM f JOIN k ON f.fold <> k.fold GROUP BY k.fold)
"""

SQL |= {
    "forest_group_means": "WITH " + GROUPED + """
SELECT id, round(avg(y) OVER (PARTITION BY x), 6) AS p FROM grouped""",
    "forest_group_shares": SHARES + "SELECT id, CAST(s > 0.5 AS DOUBLE) AS p, round(s, 6) AS p_proba FROM s",
    "boosted_group_shares": SHARES + """
SELECT id, CAST(s > 0.5 AS DOUBLE) AS p, round(1 / (1 + exp(-2 * (2 * s - 1))), 6) AS p_proba FROM s""",
    "cross_validated_group_means": HELD_OUT + """
SELECT fold, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS R2, round(avg(abs(y - p)), 6) AS MAE,
       round(sqrt(avg((y - p) * (y - p))), 6) AS RMSE
FROM f JOIN m USING (fold, x) GROUP BY fold""",
    "out_of_fold_group_means": HELD_OUT + """
SELECT id, fold, round(p, 6) AS ci95_LL, round(p, 6) AS ci95_UL FROM f JOIN m USING (fold, x)""",
    "boosted_members_agree": "SELECT count(*) AS n, count(*) AS same_0, count(*) AS same_1 FROM embeddings",
    "bag_draw_sums": """SELECT CAST(b.bag AS INTEGER) AS bag, CAST(floor(count(*) * 0.5) AS BIGINT) AS draws, count(*) AS n_rows
FROM orders, (SELECT unnest(range(8)) AS bag) b GROUP BY b.bag""",
    "predicted_two_phases": SHARES + """, p AS (SELECT avg(y) AS p FROM s WHERE s >= 0.6),
g AS (SELECT DISTINCT CAST(id % 180 AS DOUBLE) AS lat, x, s FROM s), m AS (SELECT unnest(['rf', 'other', 'ens']) AS model),
parts AS (SELECT unnest(['zir', 'clf', 'reg']) AS part)
SELECT lat, model, part, CASE WHEN part = 'zir' THEN round(CASE WHEN s > 0.5 THEN p ELSE 0 END, 6) END AS mean,
       CASE WHEN part = 'reg' THEN round(p, 6) ELSE 0.0::DOUBLE END AS ci95_LL,
       CASE WHEN part = 'reg' THEN round(p, 6) ELSE 0.0::DOUBLE END AS ci95_UL FROM g, p, m, parts""",
    "grid_search_group_means": HELD_OUT + """, e AS (
  SELECT 0 AS max_depth, fold, avg(abs(y - p)) AS mae FROM f JOIN a USING (fold) GROUP BY fold
  UNION ALL SELECT 1, fold, avg(abs(y - p)) FROM f JOIN m USING (fold, x) GROUP BY fold)
SELECT max_depth, round(-avg(mae), 6) AS score FROM e GROUP BY max_depth""",
    "two_phase_group_means": SHARES + """, c AS (SELECT avg(y) AS p FROM s WHERE s >= 0.6)
SELECT id, round(CASE WHEN s > 0.5 THEN p ELSE 0 END, 6) AS mean, round(CASE WHEN s > 0.6 THEN p ELSE 0 END, 6) AS ci95_LL,
       round(CASE WHEN s > 0.6 THEN p ELSE 0 END, 6) AS ci95_UL FROM s, c""",
    "voting_group_means": "WITH " + GROUPED + """, m AS (
  SELECT id, avg(y) OVER (PARTITION BY x) AS a, avg(y) OVER (PARTITION BY z) AS b FROM grouped)
SELECT id, round(0.75 * a + 0.25 * b, 6) AS mean, round(least(a, b) + 0.025 * abs(a - b), 6) AS ci95_LL,
       round(least(a, b) + 0.975 * abs(a - b), 6) AS ci95_UL FROM m""",
    "permutation_importance_of_groups": "WITH " + GROUPED + f""", m AS (SELECT x, avg(y) AS p FROM grouped GROUP BY x),
b AS (SELECT x, row_number() OVER (ORDER BY id) - 1 AS idx FROM grouped),
r AS (SELECT y, i, row_number() OVER (PARTITION BY i ORDER BY {_key(1, "id", "i")}, id) - 1 AS idx
      FROM grouped, (SELECT unnest(range(10)) AS i)),
q AS (SELECT i, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2
      FROM r JOIN b USING (idx) JOIN m USING (x) GROUP BY i),
o AS (SELECT 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM grouped JOIN m USING (x))
SELECT 'x' AS feature, round((SELECT r2 FROM o) - avg(r2), 6) AS importance, 1.0::DOUBLE AS weight FROM q""",
    "members_agree_with_predictions": """
SELECT count(*) AS n, count(*) AS same_0, count(*) AS same_1, count(*) AS same_2, count(*) AS same_3 FROM embeddings""",
    "predicted_targets": "WITH " + GROUPED + """, m AS (SELECT x, avg(y) AS p FROM grouped GROUP BY x),
g AS (SELECT DISTINCT CAST(id % 180 AS DOUBLE) AS lat, x FROM grouped),
t AS (SELECT lat, 'y' AS target, p FROM g JOIN m USING (x) UNION ALL SELECT lat, 'half', p / 2 FROM g JOIN m USING (x))
SELECT lat, target, 'rf' AS model, round(p, 6) AS mean, round(p, 6) AS ci95_LL, round(p, 6) AS ci95_UL FROM t""",
    "raw_observations": "WITH " + OBS + """
SELECT lat AS "Latitude", lon AS "Longitude", depth AS "Depth", time AS "Month", quantity AS "Value", flag AS "Flag" FROM obs""",
    "written_traits": "WITH " + TRAITS + """SELECT target AS "Target", poc AS "pg poc", pic AS "pg pic" FROM traits""",
    "tuned_parameters": """SELECT o_orderstatus AS target, 'False' AS reg_log, CAST(count(*) % 30 AS VARCHAR) AS reg_max_depth,
       '7' AS reg_n_estimators FROM orders GROUP BY o_orderstatus""",
}
SQL["boosted_group_means"] = SQL["saved_model"] = SQL["forest_group_means"]
SQL["written_report"] = SQL["inverse_error_weights"]
SQL["written_applicability"] = SQL["applicability"]
SQL["rewritten_predictions"] = SQL["fields_of_statistic"]
