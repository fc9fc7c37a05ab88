"""DuckDB oracle SQL for the correctness gate.

Each registered query has an equivalent SQL text here that DuckDB runs on the
same parquet tables (pre-registered as views).  The ``transactions`` mapping is
a CTE with exactly the expressions of ``stockroom.sources.tables.transactions``.
Column names equal the Spark outputs one to one.
"""

from __future__ import annotations

LINE_KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount"


def tx_cte(sku: str = "brand", name: str = "transactions") -> str:
    sku_expr = "p.p_brand" if sku == "brand" else "CAST(l.l_partkey AS VARCHAR)"
    return f"""{name} AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date,
         o.o_custkey AS customer_id,
         {sku_expr} AS sku,
         r.r_name AS region,
         CASE WHEN substr(o.o_orderpriority, 1, 1) IN ('1', '2') THEN 'App'
              WHEN substr(o.o_orderpriority, 1, 1) IN ('3', '4') THEN 'Web'
              ELSE 'Store' END AS channel,
         CAST(l.l_quantity AS INTEGER) AS quantity,
         CAST(p.p_retailprice AS DECIMAL(10,2)) AS unit_price,
         CAST(l.l_discount AS DECIMAL(4,2)) AS discount_pct,
         CASE WHEN CAST(l.l_discount AS DECIMAL(4,2)) >= 0.08 THEN 1 ELSE 0 END AS promotion_flag,
         CAST((l.l_orderkey * 7 + l.l_linenumber * 13) % 500 AS INTEGER) AS inventory_on_hand,
         CAST(0.6 AS DECIMAL(2,1)) + 5 * CAST(l.l_tax AS DECIMAL(4,2)) AS weather_index,
         CAST(CAST(l.l_quantity AS INTEGER) * CAST(p.p_retailprice AS DECIMAL(10,2))
              * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS revenue,
         CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS churned,
         l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


def with_tx(body: str, sku: str = "brand") -> str:
    """``WITH transactions AS (...) <body>``; ``body`` may start with more CTEs
    (", x AS (...)") or with SELECT."""

    body = body.strip()
    if body.startswith(","):
        return f"WITH {tx_cte(sku)}{body}"
    return f"WITH {tx_cte(sku)}\n{body}"


def std_exact_sql(n: str, s: str, ss: str) -> str:
    big = "DECIMAL(38,0)"
    return (
        f"sqrt(CASE WHEN {n} > 1 THEN CAST(CAST({n} AS {big}) * CAST({ss} AS {big}) - CAST({s} AS {big}) * CAST({s} AS {big}) AS DOUBLE)"
        f" / CAST(CAST({n} AS {big}) * CAST({n} - 1 AS {big}) AS DOUBLE) ELSE 0.0 END)"
    )


def sku_summary_sql(src: str = "transactions") -> str:
    return f"""sku_summary AS (
  SELECT sku, annual_revenue, rows_ AS rows, annual_demand, current_inventory,
         CAST(annual_demand AS DOUBLE) / CAST(rows_ AS DOUBLE) AS avg_demand,
         {std_exact_sql('rows_', 'annual_demand', 'sum_sq')} AS demand_std
  FROM (SELECT sku, coalesce(sum(revenue), 0) AS annual_revenue, count(quantity) AS rows_,
               coalesce(sum(CAST(quantity AS BIGINT)), 0) AS annual_demand,
               sum(CAST(quantity AS BIGINT) * CAST(quantity AS BIGINT)) AS sum_sq,
               arg_max(inventory_on_hand, CASE WHEN inventory_on_hand IS NOT NULL THEN row(date, {LINE_KEY_SQL}) END) AS current_inventory
        FROM {src} WHERE sku IS NOT NULL GROUP BY sku)
), classified AS (
  SELECT *, coalesce(CASE WHEN avg_demand = 0 THEN NULL ELSE demand_std / avg_demand END, 0.0) AS cv,
         CAST(sum(annual_revenue) OVER (ORDER BY annual_revenue DESC, sku ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
           / CAST(sum(annual_revenue) OVER () AS DOUBLE) AS cum_share,
         CAST(row_number() OVER (ORDER BY annual_revenue DESC, sku) AS INTEGER) AS revenue_rank
  FROM sku_summary
), abcxyz AS (
  SELECT *, CASE WHEN least(cum_share, 1.0) <= 0.8 THEN 'A' WHEN least(cum_share, 1.0) <= 0.95 THEN 'B' ELSE 'C' END AS abc_class,
            CASE WHEN cv <= 0.5 THEN 'X' WHEN cv <= 1.0 THEN 'Y' ELSE 'Z' END AS xyz_class
  FROM classified
)"""


def inventory_sql(lead: float = 7, ordering_cost: float = 150.0, holding_cost: float = 8.0) -> str:
    lead = float(lead)
    return f""", {sku_summary_sql()}, rec AS (
  SELECT *, 1.65 * demand_std * sqrt({max(lead, 1e-6)!r}) AS safety_stock,
         sqrt(2.0 * CAST(annual_demand AS DOUBLE) * {float(ordering_cost)!r} / {max(float(holding_cost), 1e-6)!r}) AS eoq
  FROM abcxyz
), rec2 AS (
  SELECT *, avg_demand * {lead!r} + safety_stock AS reorder_point FROM rec
)
SELECT sku, abc_class, xyz_class, reorder_point,
       CASE WHEN current_inventory <= reorder_point THEN eoq ELSE 0.0 END AS recommended_order_qty,
       safety_stock, current_inventory,
       CASE WHEN current_inventory <= reorder_point THEN 'Reorder now' ELSE 'Inventory healthy' END AS recommendation
FROM rec2"""


def mean_sql(c: str) -> str:
    return f"CAST(sum({c}) AS DOUBLE) / CAST(count({c}) AS DOUBLE)"


def daily_sql(src: str = "transactions") -> str:
    return f"""daily AS (
  SELECT date, sku, region, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS quantity, coalesce(sum(revenue), 0) AS revenue,
         {mean_sql('unit_price')} AS avg_price, max(promotion_flag) AS promotion_flag,
         {mean_sql('weather_index')} AS weather_index
  FROM {src} WHERE date IS NOT NULL AND sku IS NOT NULL AND region IS NOT NULL
  GROUP BY date, sku, region
)"""


HOLIDAY_MD = (126, 815, 1002)


def holiday_sql(d: str = "date") -> str:
    return f"CASE WHEN month({d}) * 100 + day({d}) IN {HOLIDAY_MD} THEN 1 ELSE 0 END"


def ts_features_select(src: str = "daily") -> str:
    parts = []
    for n in (7, 14, 30):
        frame = f"(PARTITION BY sku, region ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"CAST(sum(quantity) OVER {frame} AS DOUBLE) / CAST(count(*) OVER {frame} AS DOUBLE) AS rolling_qty_{n}")
        parts.append(f"CAST(sum(revenue) OVER {frame} AS DOUBLE) / CAST(count(*) OVER {frame} AS DOUBLE) AS rolling_revenue_{n}")
    for n in (1, 7, 14):
        parts.append(f"coalesce(CAST(lag(quantity, {n}) OVER (PARTITION BY sku, region ORDER BY date) AS DOUBLE), 0.0) AS lag_qty_{n}")
        parts.append(f"coalesce(CAST(lag(revenue, {n}) OVER (PARTITION BY sku, region ORDER BY date) AS DOUBLE), 0.0) AS lag_revenue_{n}")
    cols = ",\n       ".join(parts)
    return f"""SELECT date, sku, region, quantity, CAST(revenue AS DOUBLE) AS revenue, avg_price, promotion_flag, weather_index,
       {cols},
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(week(date) AS INTEGER) AS week_of_year,
       CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
       CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
       {holiday_sql()} AS is_holiday
FROM {src}"""


def ts_features_cte() -> str:
    return f"{daily_sql()}, ts_features AS ({ts_features_select()})"


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
CHANNELS = ["App", "Store", "Web"]


def customer_rollup_sql(src: str = "transactions", name: str = "cust") -> str:
    order = f"row(sku, date, {LINE_KEY_SQL})"
    return f"""{name} AS (
  SELECT customer_id, max(date) AS last_purchase, min(date) AS first_purchase, count(date) AS frequency,
         coalesce(sum(revenue), 0) AS monetary_exact, {mean_sql('revenue')} AS avg_order_value,
         {mean_sql('discount_pct')} AS avg_discount, max(churned) AS churn_label,
         arg_max(region, {order}) AS region, arg_max(channel, {order}) AS preferred_channel
  FROM {src} WHERE customer_id IS NOT NULL GROUP BY customer_id
)"""


def quartile_sql(order: str) -> str:
    return f"CAST(ceil(CAST(4.0 AS DOUBLE) * row_number() OVER (ORDER BY {order}) / count(*) OVER ()) AS INTEGER)"


def customer_features_cte(src: str = "transactions", name: str = "customer_features", prefix: str = "") -> str:
    dummies = ",\n       ".join(
        [f"CASE WHEN region = '{v}' THEN 1 ELSE 0 END AS \"region_{v}\"" for v in REGIONS]
        + [f"CASE WHEN preferred_channel = '{v}' THEN 1 ELSE 0 END AS \"preferred_channel_{v}\"" for v in CHANNELS]
    )
    p = prefix
    return f"""{customer_rollup_sql(src, p + 'cust')},
{p}cust2 AS (
  SELECT c.*, CAST(s.snap - c.last_purchase AS INTEGER) AS recency, CAST(s.snap - c.first_purchase AS INTEGER) AS tenure_days
  FROM {p}cust c, (SELECT max(last_purchase) + 1 AS snap FROM {p}cust) s
), {p}cust3 AS (
  SELECT *, {quartile_sql('recency DESC, customer_id')} + {quartile_sql('frequency, customer_id')}
            + {quartile_sql('monetary_exact, customer_id')} AS rfm_score
  FROM {p}cust2
), {name} AS (
SELECT customer_id, frequency, CAST(monetary_exact AS DOUBLE) AS monetary, avg_order_value, avg_discount,
       CAST(churn_label AS INTEGER) AS churn_label, recency, rfm_score, tenure_days,
       CAST(frequency AS DOUBLE) / CAST(greatest(tenure_days, 1) AS DOUBLE) AS purchase_velocity,
       CAST(monetary_exact AS DOUBLE) / CAST(greatest(frequency, 1) AS DOUBLE) AS monetary_per_visit,
       {dummies}
FROM {p}cust3)"""


def psi_ctes(pairs: str, ref: str, cur: str, bins: int = 10, p: str = "psi_") -> str:
    """CTEs ending in ``{p}value(psi)``: PSI of ``cur`` against ``ref`` over table ``pairs``."""

    return f"""{p}rq AS (SELECT CAST({ref} AS DOUBLE) AS v, row_number() OVER (ORDER BY CAST({ref} AS DOUBLE)) - 1 AS i, count(*) OVER () AS n
           FROM {pairs} WHERE {ref} IS NOT NULL AND NOT isnan(CAST({ref} AS DOUBLE))),
{p}pos AS (SELECT k, q * (n - 1) AS pp, floor(q * (n - 1)) AS lo, ceil(q * (n - 1)) AS hi
            FROM (SELECT k, k / {bins} AS q FROM range({bins + 1}) t(k)), (SELECT max(n) AS n FROM {p}rq)),
{p}bp AS (SELECT DISTINCT CASE WHEN lo = hi THEN a.v ELSE a.v + (b.v - a.v) * (pp - lo) END AS b
           FROM {p}pos JOIN {p}rq a ON a.i = {p}pos.lo JOIN {p}rq b ON b.i = {p}pos.hi),
{p}bpr AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS j FROM {p}bp),
{p}lim AS (SELECT min(b) AS lo, max(b) AS hi, count(*) AS nb FROM {p}bpr),
{p}x AS (SELECT 'r' AS side, CAST({ref} AS DOUBLE) AS v FROM {pairs} UNION ALL SELECT 'c' AS side, CAST({cur} AS DOUBLE) AS v FROM {pairs}),
{p}binned AS (SELECT side, least((SELECT count(*) FROM {p}bpr WHERE b <= v) - 1, (SELECT nb FROM {p}lim) - 2) AS bin
              FROM {p}x WHERE v >= (SELECT lo FROM {p}lim) AND v <= (SELECT hi FROM {p}lim)),
{p}hist AS (SELECT j AS bin,
                   (SELECT count(*) FROM {p}binned WHERE bin = j AND side = 'r') AS rc,
                   (SELECT count(*) FROM {p}binned WHERE bin = j AND side = 'c') AS cc
            FROM {p}bpr WHERE j < (SELECT nb FROM {p}lim) - 1),
{p}pct AS (SELECT CASE WHEN rc = 0 THEN 1e-6 ELSE CAST(rc AS DOUBLE) / CAST(sum(rc) OVER () AS DOUBLE) END AS rp,
                  CASE WHEN cc = 0 THEN 1e-6 ELSE CAST(cc AS DOUBLE) / CAST(sum(cc) OVER () AS DOUBLE) END AS cp FROM {p}hist),
{p}value AS (SELECT CASE WHEN (SELECT nb FROM {p}lim) <= 2 THEN 0.0 ELSE round(coalesce(sum((cp - rp) * ln(cp / rp)), 0.0), 10) END AS psi,
                    CAST(greatest((SELECT nb FROM {p}lim) - 1, 0) AS INTEGER) AS bins_used FROM {p}pct)"""


def median_date_cte(src: str = "transactions", name: str = "cut") -> str:
    return f"""{name}_c AS (SELECT date, count(*) AS n FROM {src} WHERE date IS NOT NULL GROUP BY date),
{name} AS (SELECT min(date) AS cutoff FROM (
    SELECT date, sum(n) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(n) OVER () AS total FROM {name}_c)
  WHERE cum > floor(total / 2))"""


def observed_drift_sql() -> str:
    return f""", {median_date_cte()},
pairs AS (SELECT customer_id, CAST(sum(CASE WHEN date <= cutoff THEN revenue END) AS DOUBLE) AS ref_monetary,
                 CAST(sum(CASE WHEN date > cutoff THEN revenue END) AS DOUBLE) AS cur_monetary
          FROM transactions, cut WHERE customer_id IS NOT NULL GROUP BY customer_id
          HAVING count(*) FILTER (WHERE date <= cutoff) > 0 AND count(*) FILTER (WHERE date > cutoff) > 0),
{psi_ctes('pairs', 'ref_monetary', 'cur_monetary')}
SELECT (SELECT cutoff FROM cut) AS cutoff, (SELECT count(*) FROM pairs) AS common_customers, psi,
       'Observed drift from prior vs recent customer windows split at ' || strftime((SELECT cutoff FROM cut), '%Y-%m-%d') AS message
FROM psi_value"""


def elasticity_sql(src: str = "ts_features") -> str:
    return f"regr_slope(ln(1 + CAST(quantity AS DOUBLE)), ln(greatest(CAST(avg_price AS DOUBLE), 0.01)))"


GRID_SQL = "(SELECT CAST(i AS INTEGER) AS grid_index, 0.85 + 0.05 * i AS factor FROM range(8) t(i))"


def what_if_sql() -> str:
    return f""", {ts_features_cte()},
el AS (SELECT round({elasticity_sql()}, 6) AS e FROM ts_features),
base AS (SELECT sku, avg(CAST(avg_price AS DOUBLE)) AS base_price, avg(CAST(quantity AS DOUBLE)) AS baseline_demand
         FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY region DESC, date DESC) AS rn FROM ts_features) WHERE rn <= 7 GROUP BY sku),
grid AS (SELECT b.*, g.grid_index, g.factor, b.base_price * g.factor AS candidate_price, el.e AS price_elasticity
         FROM base b, {GRID_SQL} g, el),
sim AS (SELECT *, greatest(baseline_demand * (1.0 + price_elasticity * ((candidate_price - base_price) / greatest(base_price, 0.01))), 0.0) AS expected_demand FROM grid),
sim2 AS (SELECT *, expected_demand * candidate_price AS expected_revenue FROM sim)"""


def naive_forecast_ctes(horizon: int = 30, season: int = 14) -> str:
    return f"""recent AS (SELECT sku, region, date, CAST(quantity AS DOUBLE) AS q,
                   row_number() OVER (PARTITION BY sku, region ORDER BY date DESC) AS rn FROM daily),
r14 AS (SELECT *, count(*) OVER (PARTITION BY sku, region) AS m, max(date) OVER (PARTITION BY sku, region) AS last_date
        FROM recent WHERE rn <= {season}),
r14p AS (SELECT *, m - rn AS pos FROM r14),
keys_ AS (SELECT DISTINCT sku, region, last_date, m FROM r14p),
fut AS (SELECT k.sku, k.region, k.last_date + CAST(st.step AS INTEGER) AS date, r.q AS daily_forecast
        FROM keys_ k CROSS JOIN (SELECT s AS step FROM range(1, {horizon + 1}) t(s)) st
        JOIN r14p r ON r.sku = k.sku AND r.region = k.region AND r.pos = (st.step - 1) % k.m),
forecast AS (SELECT *, sum(daily_forecast) OVER (PARTITION BY sku, region ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS weekly_forecast,
                   sum(daily_forecast) OVER (PARTITION BY sku, region ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS monthly_forecast
             FROM fut)"""


def asof_requests_sql() -> str:
    return """req AS (SELECT l.l_orderkey, l.l_linenumber, o.o_custkey AS customer_id, l.l_shipdate AS ts
          FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
cust_day AS (SELECT o_custkey AS customer_id, o_orderdate AS event_timestamp, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS spend,
                    count(*) AS orders FROM orders GROUP BY o_custkey, o_orderdate)"""


def monitoring_ctes() -> str:
    return f""", {median_date_cte()},
pairs AS (SELECT customer_id, CAST(sum(CASE WHEN date <= cutoff THEN revenue END) AS DOUBLE) AS ref_monetary,
                 CAST(sum(CASE WHEN date > cutoff THEN revenue END) AS DOUBLE) AS cur_monetary
          FROM transactions, cut WHERE customer_id IS NOT NULL GROUP BY customer_id
          HAVING count(*) FILTER (WHERE date <= cutoff) > 0 AND count(*) FILTER (WHERE date > cutoff) > 0),
{psi_ctes('pairs', 'ref_monetary', 'cur_monetary')},
{daily_sql()},
ms AS (SELECT sku, region, CAST(quantity AS DOUBLE) AS y,
              coalesce(lag(CAST(quantity AS DOUBLE)) OVER (PARTITION BY sku, region ORDER BY date), CAST(quantity AS DOUBLE)) AS bl,
              row_number() OVER (PARTITION BY sku, region ORDER BY date DESC) AS rn FROM daily),
mp AS (SELECT sku, region, avg(abs(y - bl) / greatest(abs(y), 2.220446049250313e-16)) * 100 AS mape FROM ms WHERE rn <= 14 GROUP BY sku, region),
mm AS (SELECT round(avg(mape), 10) AS mape FROM mp),
pm AS (SELECT psi, mape FROM psi_value, mm)"""


def _swept(table: str, confounders: list[str], where: str) -> str:
    """CTEs that take the mean and one confounder after another out of the rest (Gram-Schmidt);
    sums run over rows of ``where``, the coefficients hold for all rows.  Ends in ``{table}_last(p, q)``."""

    keep = [*confounders, "p", "q"]
    means = ", ".join(f"{c} - avg({c}) FILTER (WHERE {where}) OVER () AS {c}" for c in keep)
    ctes = [f"{table}_0 AS (SELECT fold, {means} FROM design)"]
    for n, x in enumerate(confounders):
        keep = keep[1:]
        sums = ", ".join(f"{c} - {x} * coalesce(sum({c} * {x}) FILTER (WHERE {where}) OVER () / nullif(sum({x} * {x}) FILTER (WHERE {where}) OVER (), 0), 0) AS {c}" for c in keep)
        ctes.append(f"{table}_{n + 1} AS (SELECT fold, {sums} FROM {table}_{n})")
    ctes.append(f"{table}_last AS (SELECT fold, p, q FROM {table}_{len(confounders)})")
    return ", ".join(ctes)


def causal_effect_sql(confounders: list[str], folds: int | None) -> str:
    """M20 (``folds`` None) or M19: level effect of avg_price on quantity and the elasticity at the means."""

    fold = "0" if folds is None else f"CAST(('0x' || substr(md5(CAST(date AS VARCHAR) || '|' || sku || '|' || region || '|42'), 1, 8)) AS BIGINT) % {folds}"
    columns = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in confounders)
    parts = ["design AS (SELECT " + fold + f" AS fold, {columns}, avg_price AS p, CAST(quantity AS DOUBLE) AS q FROM ts_features)"]
    if folds is None:
        parts.append(_swept("all", confounders, "true"))
        parts.append("residuals AS (SELECT p, q FROM all_last)")
    else:
        parts += [_swept(f"fit{k}", confounders, f"fold != {k}") for k in range(folds)]
        parts.append("residuals AS (" + " UNION ALL ".join(f"SELECT p, q FROM fit{k}_last WHERE fold = {k}" for k in range(folds)) + ")")
    return ", " + ", ".join(parts) + """, means AS (SELECT avg(p) AS mp, avg(q) AS mq FROM design), effect AS (SELECT regr_slope(q, p) AS b FROM residuals)
SELECT round(b, 6) AS level_effect, round(mp, 6) AS mean_price, round(mq, 6) AS mean_quantity, round(b * mp / mq, 6) AS price_elasticity FROM effect, means"""


def drift_report_sql(numeric: list[str], categorical: list[str]) -> str:
    """M26 rows (column, kind, statistic, value, drifted) of the two halves of the history."""

    ctes, selects = [], []
    for c in numeric:
        ctes.append(f"""pairs_{c} AS (SELECT CASE WHEN date <= cutoff THEN CAST({c} AS DOUBLE) END AS r, CASE WHEN date > cutoff THEN CAST({c} AS DOUBLE) END AS c FROM transactions, cut),
{psi_ctes(f'pairs_{c}', 'r', 'c', p=f'{c}_')},
{c}_n AS (SELECT count(r) AS nr, count(c) AS nc FROM pairs_{c}),
{c}_w AS (SELECT v, sum(r * nc) - sum(c * nr) AS w FROM (SELECT r AS v, 1 AS r, 0 AS c FROM pairs_{c} WHERE r IS NOT NULL UNION ALL SELECT c AS v, 0 AS r, 1 AS c FROM pairs_{c} WHERE c IS NOT NULL), {c}_n GROUP BY v),
{c}_ks AS (SELECT CAST(max(abs(d)) AS DOUBLE) AS d FROM (SELECT sum(w) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d FROM {c}_w))""")
        selects.append(f"""SELECT '{c}' AS "column", 'numeric' AS kind, 'psi' AS statistic, psi AS value, psi > 0.2 AS drifted FROM {c}_value""")
        selects.append(f"""SELECT '{c}' AS "column", 'numeric' AS kind, 'ks' AS statistic, round(d / (CAST(nr AS DOUBLE) * CAST(nc AS DOUBLE)), 10) AS value, d / (CAST(nr AS DOUBLE) * CAST(nc AS DOUBLE)) > 0.1 AS drifted FROM {c}_ks, {c}_n""")
    for c in categorical:
        ctes.append(f"""{c}_s AS (SELECT {c} AS k, CAST(count(*) FILTER (WHERE date <= cutoff) AS DOUBLE) AS r, CAST(count(*) FILTER (WHERE date > cutoff) AS DOUBLE) AS c FROM transactions, cut WHERE {c} IS NOT NULL GROUP BY {c}),
{c}_p AS (SELECT r / sum(r) OVER () AS p, c / sum(c) OVER () AS q FROM {c}_s),
{c}_js AS (SELECT sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0.0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0.0 END) AS d FROM {c}_p)""")
        selects.append(f"""SELECT '{c}' AS "column", 'categorical' AS kind, 'jensen_shannon' AS statistic, round(d, 10) AS value, d > 0.1 AS drifted FROM {c}_js""")
    return f", {median_date_cte()}, " + ", ".join(ctes) + "\n" + " UNION ALL ".join(selects)


FEATURE_COLUMNS = ["frequency", "monetary", "avg_order_value", "avg_discount", "recency", "rfm_score", "tenure_days", "purchase_velocity", "monetary_per_visit"]


def standardized_ctes() -> str:
    """``standardized(customer_id, z)``: every feature of ``customer_features``, the dummies too, as one list."""

    columns = FEATURE_COLUMNS + [f"region_{v}" for v in REGIONS] + [f"preferred_channel_{v}" for v in CHANNELS]
    values = ", ".join(f'CAST("{c}" AS DOUBLE)' for c in columns)
    return f"""z_cells AS (SELECT customer_id, unnest([{values}]) AS x, unnest(range({len(columns)})) AS j FROM customer_features),
z_scale AS (SELECT j, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1.0 END AS s FROM z_cells GROUP BY j),
standardized AS (SELECT customer_id, list((x - m) / s ORDER BY c.j) AS z FROM z_cells c JOIN z_scale k ON c.j = k.j GROUP BY customer_id)"""


def density_segments_sql(radii, min_samples: int) -> str:
    """Rows (eps, customer_id, segment_id) of DBSCAN over all pairs of customers."""

    ctes, selects = [], []
    for n, eps in enumerate(radii):
        ctes.append(f"""near{n} AS (SELECT a, b FROM distances WHERE d <= {eps}),
core{n} AS (SELECT a AS id FROM near{n} GROUP BY a HAVING count(*) >= {min_samples}),
reach{n} AS (SELECT id, id AS root FROM core{n} UNION
  SELECT e.b AS id, r.root FROM reach{n} r JOIN near{n} e ON e.a = r.id JOIN core{n} c ON c.id = e.b WHERE e.b > r.root),
label{n} AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM (SELECT id, min(root) AS root FROM reach{n} GROUP BY id)),
border{n} AS (SELECT e.a AS id, min(l.label) AS label FROM near{n} e JOIN label{n} l ON l.id = e.b GROUP BY e.a)""")
        selects.append(f"""SELECT CAST({eps} AS DOUBLE) AS eps, s.customer_id, CAST(coalesce(l.label, b.label, -1) AS INTEGER) AS segment_id
FROM standardized s LEFT JOIN label{n} l ON l.id = s.customer_id LEFT JOIN border{n} b ON b.id = s.customer_id""")
    return f"""distances AS (SELECT a.customer_id AS a, b.customer_id AS b, list_distance(a.z, b.z) AS d FROM standardized a, standardized b WHERE list_distance(a.z, b.z) <= {max(radii)}),
{", ".join(ctes)}
{" UNION ALL ".join(selects)}"""
