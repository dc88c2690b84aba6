"""Selections, joins, aggregates, windows, paging, sets and subqueries in SQL that Catalyst plans."""

from __future__ import annotations

from ..registry import exact_sum
from ..registry import sql_query as q

# --- projections, filters, predicates ---
q("project_computed", "SELECT order_id, line_no, quantity * price AS gross, round(quantity * price * (1 - discount), 4) AS net, upper(flag) AS flag FROM item")
q("distinct_multi", "SELECT DISTINCT region, tier FROM cust")
q("boolean_filter", "SELECT product_id, CAST(min_stock > 25 AS BOOLEAN) AS is_large FROM prod WHERE CAST(CASE WHEN min_stock > 10 THEN 1 ELSE 0 END AS BOOLEAN)")
q("in_list", "SELECT customer_id, full_name FROM cust WHERE region IN ('ASIA', 'EUROPE', 'AFRICA') AND tier IN ('A', 'B') AND segment NOT IN ('MACHINERY', 'BUILDING')")
q("tuple_in", "SELECT customer_id, full_name FROM cust WHERE (region, tier) IN (SELECT region, max(tier) FROM cust GROUP BY region)")
q("between_range", "SELECT order_id, order_date, amount FROM ord WHERE order_date BETWEEN TIMESTAMP '1996-06-01 00:00:00' AND TIMESTAMP '1996-09-30 00:00:00' AND amount BETWEEN 10000 AND 100000")
q("like_contains", "SELECT product_id, product_name FROM prod WHERE product_name LIKE '%blue%' AND kind NOT LIKE '%ECON%'")
q("like_charclass", "SELECT product_id, category FROM prod WHERE category RLIKE '^Brand#[1-3]'", "SELECT product_id, category FROM prod WHERE regexp_matches(category, '^Brand#[1-3]')")
q("null_filter", """SELECT c.customer_id, o.order_id IS NULL AS no_order, o.order_id IS NOT NULL AS has_order FROM cust c LEFT JOIN ord o ON c.customer_id = o.customer_id AND o.status = 'P'
  WHERE (o.order_id IS NULL OR o.amount IS NOT NULL) AND NOT coalesce(o.status = CAST(NULL AS VARCHAR(1)), false)""")
q("case_simple", "SELECT order_id, status, CASE status WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' WHEN 'P' THEN 'cancelled' ELSE 'unknown' END AS label FROM ord")
q("case_searched", "SELECT product_id, unit_price, CASE WHEN unit_price < 1000 THEN 'low' WHEN unit_price < 1400 THEN 'mid' WHEN unit_price < 1800 THEN 'high' ELSE 'top' END AS price_level FROM prod")
q("case_in_agg", "SELECT region, round(sum(CASE WHEN tier = 'A' THEN credit_limit ELSE 0 END), 2) AS limit_a, round(sum(CASE WHEN tier = 'B' THEN credit_limit ELSE 0 END), 2) AS limit_b, CAST(sum(CASE WHEN tier = 'C' THEN 1 ELSE 0 END) AS BIGINT) AS n_c FROM cust GROUP BY region")
q("iif_choose", "SELECT order_id, if(amount > 100000, 'large', 'small') AS size_label, elt(quarter(order_date), 'Q1', 'Q2', 'Q3', 'Q4') AS q_label FROM ord",
  "SELECT order_id, CASE WHEN amount > 100000 THEN 'large' ELSE 'small' END AS size_label, ['Q1', 'Q2', 'Q3', 'Q4'][quarter(order_date)] AS q_label FROM ord")
q("collate_ci", "SELECT segment, CAST(count(*) AS BIGINT) AS n FROM cust WHERE segment COLLATE UTF8_LCASE = 'building' OR segment COLLATE UNICODE_CI_AI = 'máchinery' GROUP BY segment",
  "SELECT segment, CAST(count(*) AS BIGINT) AS n FROM cust WHERE lower(segment) = 'building' OR lower(strip_accents(segment)) = lower(strip_accents('máchinery')) GROUP BY segment")
q("implicit_cast", "SELECT order_id, CAST(order_id AS STRING) = concat('', order_id) AS same_text, CAST(amount AS DECIMAL(15, 2)) AS exact_amount, CAST('1996-01-01' AS DATE) <= CAST(order_date AS DATE) AS late FROM ord",
  "SELECT order_id, CAST(order_id AS VARCHAR) = concat('', order_id) AS same_text, CAST(amount AS DECIMAL(15, 2)) AS exact_amount, CAST('1996-01-01' AS DATE) <= CAST(order_date AS DATE) AS late FROM ord")
q("catchall_param", "SELECT product_id, category FROM prod WHERE (CAST(NULL AS STRING) IS NULL OR kind = CAST(NULL AS STRING)) AND ('Brand#11' IS NULL OR category = 'Brand#11')",
  "SELECT product_id, category FROM prod WHERE (CAST(NULL AS VARCHAR) IS NULL OR kind = CAST(NULL AS VARCHAR)) AND ('Brand#11' IS NULL OR category = 'Brand#11')")
q("partition_stats", "SELECT part_no, CAST(count(*) AS BIGINT) AS n_rows, min(order_date) AS first_date, max(order_date) AS last_date FROM (SELECT *, CASE WHEN order_date < TIMESTAMP '1996-01-01 00:00:00' THEN 1 WHEN order_date < TIMESTAMP '1998-01-01 00:00:00' THEN 2 WHEN order_date < TIMESTAMP '2000-01-01 00:00:00' THEN 3 ELSE 4 END AS part_no FROM ord) p GROUP BY part_no")

# versions of each customer's last order, valid until the next one
HISTORY = "SELECT customer_id, order_id, amount, order_date AS valid_from, coalesce(lead(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id), TIMESTAMP '9999-12-31 00:00:00') AS valid_to FROM ord"
q("temporal_as_of", f"WITH h AS ({HISTORY}) SELECT customer_id, order_id, amount FROM h WHERE valid_from <= TIMESTAMP '1998-06-15 00:00:00' AND valid_to > TIMESTAMP '1998-06-15 00:00:00'")
q("temporal_between", f"WITH h AS ({HISTORY}) SELECT customer_id, order_id FROM h WHERE valid_from <= TIMESTAMP '1998-12-31 00:00:00' AND valid_to > TIMESTAMP '1998-01-01 00:00:00'")
q("temporal_contained", f"WITH h AS ({HISTORY}) SELECT customer_id, order_id FROM h WHERE valid_from >= TIMESTAMP '1997-01-01 00:00:00' AND valid_to <= TIMESTAMP '1999-01-01 00:00:00'")

# --- joins ---
q("join_inner", "SELECT o.order_id, c.full_name, c.region, o.status, o.amount FROM ord o JOIN cust c ON o.customer_id = c.customer_id WHERE o.order_date >= TIMESTAMP '1997-06-01 00:00:00'")
q("join_four_way", "SELECT o.order_id, i.line_no, c.full_name, p.product_name, i.quantity, i.price FROM ord o JOIN cust c ON o.customer_id = c.customer_id JOIN item i ON o.order_id = i.order_id JOIN prod p ON i.product_id = p.product_id WHERE o.order_date >= TIMESTAMP '1999-10-01 00:00:00'")
q("join_left_on_filter", "SELECT c.customer_id, c.region, CAST(count(o.order_id) AS BIGINT) AS order_count, round(coalesce(sum(o.amount), 0), 2) AS total_spent FROM cust c LEFT JOIN ord o ON c.customer_id = o.customer_id AND o.status NOT IN ('P') GROUP BY c.customer_id, c.region")
q("join_right", "SELECT p.product_id, p.category, coalesce(sum(i.quantity), 0) AS total_ordered FROM item i RIGHT JOIN prod p ON i.product_id = p.product_id GROUP BY p.product_id, p.category")
q("join_full", "SELECT coalesce(n.n_nationkey, s.n) AS nation_key, n.n_name, s.suppliers FROM nation n FULL JOIN (SELECT s_nationkey AS n, CAST(count(*) AS BIGINT) AS suppliers FROM supplier GROUP BY s_nationkey) s ON n.n_nationkey = s.n")
q("join_cross", "SELECT r.r_name, t.tier, CAST(count(c.customer_id) AS BIGINT) AS n FROM region r CROSS JOIN (SELECT 'A' AS tier UNION ALL SELECT 'B' UNION ALL SELECT 'C' UNION ALL SELECT 'D') t LEFT JOIN cust c ON c.region = r.r_name AND c.tier = t.tier GROUP BY r.r_name, t.tier")
q("join_natural", "SELECT customer_id, full_name, n_orders FROM cust NATURAL JOIN (SELECT o_custkey AS customer_id, CAST(count(*) AS BIGINT) AS n_orders FROM orders GROUP BY o_custkey) x")
q("semi_exists", "SELECT customer_id, full_name, region FROM cust c WHERE EXISTS (SELECT 1 FROM ord o WHERE o.customer_id = c.customer_id AND o.amount > 150000)")
q("anti_not_exists", "SELECT customer_id, full_name FROM cust c WHERE NOT EXISTS (SELECT 1 FROM ord o WHERE o.customer_id = c.customer_id AND o.status = 'P' AND o.amount > 100000)")
q("anti_nested", "SELECT product_id, product_name FROM prod p WHERE NOT EXISTS (SELECT 1 FROM item i JOIN ord o ON i.order_id = o.order_id WHERE i.product_id = p.product_id AND o.status NOT IN ('P') AND o.amount > 450000)")
q("anti_not_in", "SELECT customer_id FROM cust WHERE customer_id NOT IN (SELECT customer_id FROM ord WHERE amount > 100000)")
q("apply_topn", "SELECT customer_id, order_id, amount, CAST(nth AS BIGINT) AS nth FROM (SELECT customer_id, order_id, amount, row_number() OVER (PARTITION BY customer_id ORDER BY amount DESC, order_id) AS nth FROM ord) x WHERE nth <= 3",
  "SELECT c.c_custkey AS customer_id, t.order_id, t.amount, t.nth FROM customer c, LATERAL (SELECT o_orderkey AS order_id, o_totalprice AS amount, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY amount DESC, order_id LIMIT 3) t")
q("apply_outer_agg", "SELECT c.customer_id, coalesce(a.n, 0) AS order_count, a.last_date FROM cust c LEFT JOIN (SELECT customer_id, CAST(count(*) AS BIGINT) AS n, max(order_date) AS last_date FROM ord GROUP BY customer_id) a ON a.customer_id = c.customer_id",
  "SELECT c.c_custkey AS customer_id, coalesce(a.n, 0) AS order_count, a.last_date FROM customer c LEFT JOIN LATERAL (SELECT CAST(count(*) AS BIGINT) AS n, max(o_orderdate) AS last_date FROM orders o WHERE o.o_custkey = c.c_custkey) a ON true")
q("apply_chain", "SELECT o.order_id, a.band, b.discounted FROM ord o, LATERAL (SELECT CASE WHEN o.amount > 100000 THEN 'H' ELSE 'L' END AS band) a, LATERAL (SELECT round(CASE WHEN a.band = 'H' THEN o.amount * 0.9 ELSE o.amount END, 3) AS discounted) b")

# --- aggregates ---
q("agg_basic", "SELECT region, tier, CAST(count(*) AS BIGINT) AS n, round(avg(credit_limit), 6) AS avg_limit, round(sum(credit_limit), 2) AS total_limit, min(credit_limit) AS lo, max(credit_limit) AS hi FROM cust GROUP BY region, tier")
q("agg_count_distinct", "SELECT CAST(count(DISTINCT customer_id) AS BIGINT) AS customers, CAST(count(DISTINCT status) AS BIGINT) AS statuses, CAST(count(DISTINCT priority) AS BIGINT) AS priorities FROM ord")
q("having_sum", "SELECT customer_id, round(sum(amount), 2) AS total_spent FROM ord WHERE status NOT IN ('P') GROUP BY customer_id HAVING sum(amount) > 1000000")
q("having_count", "SELECT customer_id, CAST(count(order_id) AS BIGINT) AS order_count FROM ord GROUP BY customer_id HAVING count(order_id) >= 5")
q("rollup", "SELECT coalesce(c.region, 'total') AS region, coalesce(p.category, 'subtotal') AS category, round(sum(i.quantity * i.price), 2) AS sales FROM ord o JOIN cust c ON o.customer_id = c.customer_id JOIN item i ON o.order_id = i.order_id JOIN prod p ON i.product_id = p.product_id WHERE o.status NOT IN ('P') GROUP BY ROLLUP (c.region, p.category)")
q("cube", "SELECT region, tier, CAST(count(*) AS BIGINT) AS n, round(sum(credit_limit), 2) AS total FROM cust GROUP BY CUBE (region, tier)")
q("grouping_sets", "SELECT region, tier, CAST(grouping(region) AS BIGINT) AS g_region, CAST(grouping(tier) AS BIGINT) AS g_tier, CAST(count(*) AS BIGINT) AS n FROM cust GROUP BY GROUPING SETS ((region, tier), (region), (tier), ())")
q("monthly_sales", "SELECT date_format(order_date, 'yyyy-MM') AS month, CAST(count(*) AS BIGINT) AS orders, round(sum(amount), 2) AS sales FROM ord GROUP BY date_format(order_date, 'yyyy-MM')",
  "SELECT strftime(order_date, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS orders, round(sum(amount), 2) AS sales FROM ord GROUP BY 1")
q("string_agg_ordered", "SELECT region, listagg(nation, ', ') WITHIN GROUP (ORDER BY nation) AS nations FROM (SELECT DISTINCT region, nation FROM cust) x GROUP BY region", "SELECT region, string_agg(nation, ', ' ORDER BY nation) AS nations FROM (SELECT DISTINCT region, nation FROM cust) x GROUP BY region")
q("percentile_cont_over", "SELECT DISTINCT category, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY unit_price) OVER (PARTITION BY category), 6) AS median_price, percentile_disc(0.9) WITHIN GROUP (ORDER BY unit_price) OVER (PARTITION BY category) AS p90 FROM prod",
  "SELECT DISTINCT category, round(quantile_cont(unit_price, 0.5) OVER (PARTITION BY category), 6) AS median_price, quantile_disc(unit_price, 0.9) OVER (PARTITION BY category) AS p90 FROM prod")
q("pivot_count", "SELECT * FROM (SELECT priority, status, order_id FROM ord) PIVOT (count(order_id) FOR status IN ('F' AS f, 'O' AS o, 'P' AS p))",
  "SELECT priority, CAST(count(*) FILTER (status = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (status = 'O') AS BIGINT) AS o, CAST(count(*) FILTER (status = 'P') AS BIGINT) AS p FROM ord GROUP BY priority")
q("pivot_sum", "SELECT region, round(a, 2) AS a, round(b, 2) AS b, round(c, 2) AS c FROM (SELECT region, tier, credit_limit FROM cust) PIVOT (sum(credit_limit) FOR tier IN ('A' AS a, 'B' AS b, 'C' AS c))",
  "SELECT region, round(sum(credit_limit) FILTER (tier = 'A'), 2) AS a, round(sum(credit_limit) FILTER (tier = 'B'), 2) AS b, round(sum(credit_limit) FILTER (tier = 'C'), 2) AS c FROM cust GROUP BY region")
q("unpivot", "SELECT l_orderkey, l_linenumber, measure, value FROM (SELECT l_orderkey, l_linenumber, l_discount, nullif(l_tax, 0.0) AS l_tax FROM lineitem) UNPIVOT (value FOR measure IN (l_discount AS discount, l_tax AS tax))",
  "SELECT l_orderkey, l_linenumber, 'discount' AS measure, l_discount AS value FROM lineitem WHERE l_discount IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, 'tax', nullif(l_tax, 0.0) FROM lineitem WHERE nullif(l_tax, 0.0) IS NOT NULL")
q("agg_nested", "SELECT region, tier, round(avg(total_spent), 6) AS avg_spent FROM (SELECT c.customer_id, c.region, c.tier, coalesce(sum(o.amount), 0) AS total_spent FROM cust c JOIN ord o ON c.customer_id = o.customer_id WHERE o.status NOT IN ('P') GROUP BY c.customer_id, c.region, c.tier) s GROUP BY region, tier")

# --- windows ---
# rows whose sums are equal are ranked by the next key, not by how each sum was rounded
q("win_row_number", f"SELECT customer_id, round(total_spent, 2) AS total_spent, CAST(row_number() OVER (PARTITION BY region ORDER BY total_spent DESC, customer_id) AS BIGINT) AS rank_no FROM (SELECT c.customer_id, c.region, {exact_sum('o.amount')} AS total_spent FROM cust c JOIN ord o ON c.customer_id = o.customer_id GROUP BY c.customer_id, c.region) s",
  "SELECT customer_id, round(total_spent, 2) AS total_spent, CAST(row_number() OVER (PARTITION BY region ORDER BY total_spent DESC, customer_id) AS BIGINT) AS rank_no FROM (SELECT c.customer_id, c.region, sum(o.amount) AS total_spent FROM cust c JOIN ord o ON c.customer_id = o.customer_id GROUP BY c.customer_id, c.region) s")
q("win_rank_dense", "SELECT product_id, category, CAST(rank() OVER (PARTITION BY category ORDER BY min_stock DESC) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY category ORDER BY min_stock DESC) AS BIGINT) AS drk FROM prod")
q("win_ntile", "SELECT product_id, CAST(ntile(4) OVER (PARTITION BY category ORDER BY unit_price DESC, product_id) AS BIGINT) AS quartile FROM prod")
q("win_lag_lead", "SELECT order_id, lag(amount, 1, 0D) OVER w AS prev_amount, lead(amount, 1, 0D) OVER w AS next_amount, round(amount - lag(amount, 1, 0D) OVER w, 2) AS change FROM ord WHERE status NOT IN ('P') WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)",
  "SELECT order_id, lag(amount, 1, 0.0::DOUBLE) OVER w AS prev_amount, lead(amount, 1, 0.0::DOUBLE) OVER w AS next_amount, round(amount - lag(amount, 1, 0.0::DOUBLE) OVER w, 2) AS change FROM ord WHERE status NOT IN ('P') WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)")
q("win_running_total", "SELECT order_id, round(sum(amount) OVER (PARTITION BY customer_id ORDER BY order_date, order_id), 2) AS running_total, round(avg(amount) OVER (PARTITION BY customer_id), 6) AS customer_avg, CAST(count(*) OVER (PARTITION BY customer_id) AS BIGINT) AS n FROM ord WHERE status NOT IN ('P')")
q("win_first_last", "SELECT customer_id, region, first_value(full_name) OVER (PARTITION BY region ORDER BY credit_limit DESC, customer_id) AS top_customer, last_value(full_name) OVER (PARTITION BY region ORDER BY credit_limit DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS bottom_customer FROM cust")
q("win_moving_rows", "SELECT order_id, round(avg(amount) OVER (PARTITION BY customer_id ORDER BY order_date, order_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS avg7, round(sum(amount) OVER (PARTITION BY customer_id ORDER BY order_date, order_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 2) AS sum5 FROM ord")
q("win_range_interval", "SELECT order_id, round(sum(amount) OVER (PARTITION BY customer_id ORDER BY order_date RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW), 2) AS sum30 FROM ord")
q("win_cume_percent", "SELECT product_id, round(cume_dist() OVER (PARTITION BY category ORDER BY unit_price), 9) AS cume, round(percent_rank() OVER (PARTITION BY category ORDER BY unit_price), 9) AS pct FROM prod")

# --- order, limits, paging ---
q("order_by_multi", "SELECT customer_id, region, credit_limit FROM cust ORDER BY region, credit_limit DESC, customer_id")
q("top_n", "SELECT order_id, amount FROM ord ORDER BY amount DESC, order_id LIMIT 10")
q("top_with_ties", "SELECT product_id, min_stock FROM (SELECT product_id, min_stock, rank() OVER (ORDER BY min_stock DESC) AS rk FROM prod) x WHERE rk <= 5")
q("offset_fetch", "SELECT order_id, order_date, status FROM ord WHERE status NOT IN ('P') ORDER BY order_date DESC, order_id LIMIT 10 OFFSET 20")

# --- set operations ---
q("union_all", "SELECT product_name AS name, 'product' AS source FROM prod WHERE category = 'Brand#11' UNION ALL SELECT full_name, 'customer' FROM cust WHERE region = 'ASIA'")
q("union_distinct", "SELECT region AS location, 'tier A' AS label FROM cust WHERE tier = 'A' UNION SELECT region, 'large order' FROM cust c JOIN ord o ON c.customer_id = o.customer_id WHERE o.amount > 200000")
q("intersect", "SELECT customer_id FROM cust WHERE tier IN ('A', 'B') INTERSECT SELECT customer_id FROM ord WHERE amount > 50000")
q("except", "SELECT customer_id FROM cust EXCEPT SELECT customer_id FROM ord WHERE status = 'F'")

# --- subqueries, common table expressions ---
q("scalar_subquery", "SELECT order_id, amount, round((SELECT avg(amount) FROM ord WHERE status NOT IN ('P')), 6) AS avg_amount, round(amount - (SELECT avg(amount) FROM ord WHERE status NOT IN ('P')), 6) AS diff FROM ord WHERE order_date >= TIMESTAMP '1997-06-01 00:00:00'")
q("correlated_count", "SELECT product_id, unit_price, (SELECT CAST(count(*) AS BIGINT) FROM item i JOIN ord o ON i.order_id = o.order_id WHERE i.product_id = p.product_id AND o.status NOT IN ('P')) AS order_count FROM prod p")
q("cte_simple", "WITH spending AS (SELECT c.customer_id, c.region, coalesce(sum(o.amount), 0) AS total_spent FROM cust c LEFT JOIN ord o ON c.customer_id = o.customer_id AND o.status NOT IN ('P') GROUP BY c.customer_id, c.region) SELECT customer_id, region, round(total_spent, 2) AS total_spent FROM spending WHERE total_spent > 500000")
q("cte_chain", """WITH stats AS (SELECT product_id, sum(quantity) AS sold, sum(quantity * price) AS revenue FROM item GROUP BY product_id),
 joined AS (SELECT p.product_id, p.category, p.min_stock, coalesce(s.sold, 0) AS sold, round(coalesce(s.revenue, 0), 2) AS revenue FROM prod p LEFT JOIN stats s ON p.product_id = s.product_id)
 SELECT *, CASE WHEN min_stock < 5 AND sold > 0 THEN 'short' WHEN sold = 0 THEN 'slow' ELSE 'normal' END AS sales_status FROM joined""")
q("recursive_numbers", "WITH RECURSIVE n AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM n WHERE i < 60) SELECT CAST(i AS BIGINT) AS i, CAST(i * i AS BIGINT) AS sq FROM n")
q("recursive_dates", "WITH RECURSIVE d AS (SELECT DATE '1998-01-01' AS day UNION ALL SELECT CAST(day + INTERVAL '1' DAY AS DATE) FROM d WHERE day < DATE '1998-01-31') SELECT d.day, CAST(count(o.order_id) AS BIGINT) AS orders FROM d LEFT JOIN ord o ON CAST(o.order_date AS DATE) = d.day GROUP BY d.day")
q("recursive_path", """WITH RECURSIVE path AS (SELECT n_nationkey AS id, n_name AS trail, 1 AS depth FROM nation WHERE n_nationkey % 5 = 0
 UNION ALL SELECT n.n_nationkey, concat(p.trail, ' > ', n.n_name), p.depth + 1 FROM path p JOIN nation n ON n.n_nationkey = p.id + 1 WHERE p.depth < 4) SELECT id, trail, depth FROM path""")
q("recursive_multi_anchor", "WITH RECURSIVE w AS (SELECT CAST(0 AS BIGINT) AS id, 'even' AS kind UNION ALL SELECT CAST(1 AS BIGINT), 'odd' UNION ALL SELECT id + 2, kind FROM w WHERE id < 40) SELECT id, kind FROM w",
  "WITH RECURSIVE w AS ((SELECT CAST(0 AS BIGINT) AS id, 'even' AS kind UNION ALL SELECT CAST(1 AS BIGINT), 'odd') UNION ALL SELECT id + 2, kind FROM w WHERE id < 40) SELECT id, kind FROM w")
