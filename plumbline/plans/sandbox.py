"""The sandbox's migration cases over the business model: what both databases must answer alike."""

from __future__ import annotations

from ..registry import sql_query as q
from .reports import STOCK

q("sandbox_schema_tables", "SELECT 'customer' AS table_name, count(*) >= 0 AS present FROM customer UNION ALL SELECT 'part', count(*) >= 0 FROM part UNION ALL SELECT 'orders', count(*) >= 0 FROM orders UNION ALL SELECT 'lineitem', count(*) >= 0 FROM lineitem")
q("sandbox_schema_row_counts", "SELECT 'customer' AS t, CAST(count(*) AS BIGINT) AS n FROM customer UNION ALL SELECT 'part', CAST(count(*) AS BIGINT) FROM part UNION ALL SELECT 'orders', CAST(count(*) AS BIGINT) FROM orders UNION ALL SELECT 'lineitem', CAST(count(*) AS BIGINT) FROM lineitem")
q("sandbox_all_customers", "SELECT customer_id, full_name, segment, region FROM cust")
q("sandbox_all_products", "SELECT product_id, product_name, unit_price, min_stock > 0 AS is_active FROM prod")
q("sandbox_all_orders", "SELECT order_id, customer_id, status, amount FROM ord")
q("sandbox_with_null", "SELECT customer_id, nullif(segment, 'BUILDING') AS contact FROM cust WHERE nullif(segment, 'BUILDING') IS NULL")
q("sandbox_null_notes", "SELECT order_id, nullif(priority, '5-LOW') AS notes FROM ord WHERE nullif(priority, '5-LOW') IS NULL")
q("sandbox_boolean_filter", "SELECT product_id FROM prod WHERE (min_stock > 20) = true")
q("sandbox_string_filter", "SELECT product_id, product_name FROM prod WHERE product_name LIKE '%ring%'")
q("sandbox_count_by_status", "SELECT status, CAST(count(*) AS BIGINT) AS n FROM ord GROUP BY status")
q("sandbox_sum_order_totals", "SELECT customer_id, round(sum(amount), 2) AS total_spent FROM ord WHERE status = 'F' GROUP BY customer_id")
q("sandbox_order_by_customer", "SELECT c.full_name, CAST(count(o.order_id) AS BIGINT) AS n FROM cust c JOIN ord o ON o.customer_id = c.customer_id GROUP BY c.full_name ORDER BY n DESC, c.full_name")
q("sandbox_join_orders_items", "SELECT o.order_id, o.amount, round(sum(i.quantity * i.price), 2) AS calc_total FROM ord o JOIN item i ON i.order_id = o.order_id GROUP BY o.order_id, o.amount")
q("sandbox_join_customer_orders", "SELECT c.customer_id, c.full_name, o.order_id FROM cust c LEFT JOIN ord o ON o.customer_id = c.customer_id AND o.status = 'P'")
q("sandbox_three_way_join", "SELECT o.order_id, i.line_no, p.product_name, i.quantity FROM ord o JOIN item i ON i.order_id = o.order_id JOIN prod p ON p.product_id = i.product_id WHERE o.status = 'F'")
q("sandbox_inventory_all", f"SELECT product_id, warehouse, quantity, min_quantity FROM ({STOCK}) s")
q("sandbox_low_stock", f"SELECT product_id, quantity, min_quantity FROM ({STOCK}) s WHERE quantity < min_quantity ORDER BY product_id")
q("sandbox_datetime_default", "SELECT order_id, CAST(order_date AS DATE) AS created_on FROM ord WHERE order_date IS NOT NULL")
q("sandbox_expensive_products", "SELECT product_id, unit_price FROM prod WHERE unit_price > 950")
q("sandbox_pagination", "SELECT order_id, customer_id FROM ord ORDER BY order_id LIMIT 10 OFFSET 10")
q("sandbox_bf_customer_create", "SELECT m.n + 1 AS customer_id, 'New customer' AS full_name FROM (SELECT max(customer_id) AS n FROM cust) m")
q("sandbox_bf_product_create", "SELECT m.n + 1 AS product_id, 'New product' AS product_name, 19.5D AS unit_price FROM (SELECT max(product_id) AS n FROM prod) m", "SELECT m.n + 1 AS product_id, 'New product' AS product_name, 19.5::DOUBLE AS unit_price FROM (SELECT max(p_partkey) AS n FROM part) m")
q("sandbox_bf_order_create", "SELECT o.order_id, c.full_name, CAST(count(*) AS BIGINT) AS lines, round(sum(i.quantity * i.price), 2) AS subtotal, o.amount AS total_amount FROM ord o JOIN cust c ON c.customer_id = o.customer_id JOIN item i ON i.order_id = o.order_id GROUP BY o.order_id, c.full_name, o.amount")
q("sandbox_bf_order_update", "SELECT order_id, status AS old_status, CASE status WHEN 'O' THEN 'F' ELSE status END AS new_status FROM ord")
q("sandbox_bf_inventory_query", f"SELECT warehouse, sum(quantity) AS quantity, CAST(sum(CASE WHEN quantity < min_quantity THEN 1 ELSE 0 END) AS BIGINT) AS low FROM ({STOCK}) s GROUP BY warehouse")
q("sandbox_bf_customer_orders", "SELECT c.customer_id, CAST(count(o.order_id) AS BIGINT) AS orders, round(coalesce(sum(o.amount), 0), 2) AS total_spent FROM cust c LEFT JOIN ord o ON o.customer_id = c.customer_id GROUP BY c.customer_id")
