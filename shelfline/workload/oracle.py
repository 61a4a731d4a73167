"""The SQL each named query is checked against, over the same tables.

Shared sub-queries are kept by name and put in front of a query as common table expressions when it mentions them.
"""

from __future__ import annotations

import re

SHARED = {
    "order_place": """
        SELECT n_nationkey, CASE r_name WHEN 'AFRICA' THEN 'Cologne' WHEN 'AMERICA' THEN 'Berlin' WHEN 'ASIA' THEN 'Munich'
            WHEN 'EUROPE' THEN 'Hamburg' WHEN 'MIDDLE EAST' THEN 'Online' END AS location
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "stock_place": """
        SELECT n_nationkey, CASE location WHEN 'Berlin' THEN 'Metzingen' ELSE location END AS location FROM order_place""",
    "r_products": """
        SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS product_id, p_name AS name,
            split_part(p_name, ' ', 2) AS material, p_retailprice AS base_price, split_part(p_name, ' ', 1) AS color,
            p_brand AS brand, p_type AS category
        FROM part""",
    "r_orders": """
        SELECT 'O' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS order_id,
            'U' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS user_id, location,
            CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority = '1-URGENT' END AS promo_flag,
            CASE WHEN o_orderpriority = '1-URGENT' THEN
                CASE o_orderkey % 4 WHEN 0 THEN 'WELCOME10' WHEN 1 THEN 'BUNDLE5' WHEN 2 THEN 'FREESHIP' ELSE 'SOCIAL5' END
            END AS promo_code,
            o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS event_time, CAST(o_orderdate AS DATE) AS order_date
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN order_place ON c_nationkey = n_nationkey""",
    "r_lines": """
        SELECT 'O' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS order_id,
            'P' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS product_id, CAST(l_quantity AS INTEGER) AS amount,
            l_linenumber, l_suppkey, l_quantity, l_extendedprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "r_inventory": """
        SELECT 'P' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS product_id, location,
            ['XS', 'S', 'M', 'L', 'XL', 'XXL', 'XXXL'][l_linenumber] AS size,
            CAST(sum(CAST(l_quantity AS INTEGER)) % 21 AS INTEGER) AS amount
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN stock_place ON s_nationkey = n_nationkey
        GROUP BY 1, 2, 3""",
    "k_items": """
        SELECT * FROM r_lines
        QUALIFY row_number() OVER (
            PARTITION BY order_id, product_id ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice) = 1""",
    "sales": """
        SELECT order_id, i.product_id, CAST(amount AS DOUBLE) AS qty, base_price AS unit_price,
            amount * base_price AS line_value, category, brand, name
        FROM k_items i LEFT JOIN r_products p ON i.product_id = p.product_id""",
    "summary": """
        SELECT o.order_id, user_id, order_date, location AS store_id, promo_flag, promo_code, basket_size, basket_qty,
            basket_value, o.event_time, o.o_orderkey
        FROM r_orders o LEFT JOIN (
            SELECT order_id, count(DISTINCT product_id) AS basket_size, sum(qty) AS basket_qty,
                sum(line_value) AS basket_value
            FROM sales GROUP BY order_id) t ON o.order_id = t.order_id""",
    "stores": """
        SELECT DISTINCT location AS store_id, CASE location WHEN 'Cologne' THEN 'NRW' WHEN 'Munich' THEN 'Bavaria'
            WHEN 'Metzingen' THEN 'Baden-Württemberg' ELSE location END AS region,
            CASE WHEN location = 'Online' THEN 'online' ELSE 'offline' END AS channel
        FROM r_orders""",
    "all_baskets": "SELECT DISTINCT order_id, product_id FROM k_items",
    "stored": "SELECT s.*, region, channel FROM summary s LEFT JOIN stores t ON s.store_id = t.store_id",
    "star": """
        SELECT s.*, o.order_date, o.store_id, region, channel
        FROM sales s LEFT JOIN summary o ON s.order_id = o.order_id LEFT JOIN stores t ON o.store_id = t.store_id""",
    "purchases": """
        SELECT 'E' || event_id AS order_id, ts AS event_time, value AS total_price,
            CASE WHEN k < 8 THEN 'P' ELSE '' END AS promo_code, CASE WHEN k % 2 = 0 THEN 'C' || k END AS combination_id
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
        WHERE event_type = 'purchase'""",
    "recent": "SELECT * FROM purchases WHERE event_time >= (SELECT max(event_time) FROM purchases) - INTERVAL 7 DAY",
    "ids": """
        SELECT order_id, string_agg(product_id, ',' ORDER BY product_id) AS product_ids, count(*) AS n_items,
            sha256(string_agg(product_id, '|' ORDER BY product_id)) AS h
        FROM k_items GROUP BY order_id""",
    "order_combos": """
        SELECT order_id, product_ids, n_items,
            h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS combination_id
        FROM ids""",
    "priced": """
        SELECT order_id, promo_code, subtotal, round_even(off, 2) AS discount,
            round_even(CASE WHEN off > subtotal THEN 0 ELSE subtotal - off END, 2) AS total_price
        FROM (SELECT *, CASE WHEN subtotal IS NULL THEN NULL WHEN promo_code = 'WELCOME10' THEN 0.10 * subtotal
                WHEN promo_code = 'BUNDLE5' AND subtotal >= 50 THEN 5.0 ELSE 0.0 END AS off
            FROM (SELECT order_id, promo_code, round_even(basket_value, 2) AS subtotal FROM summary))""",
    "sold_orders": """
        SELECT 'sale' AS event_type, s.event_time, s.order_id,
            CASE WHEN s.o_orderkey % 3 <> 0 THEN combination_id END AS combination_id, user_id AS "user",
            s.o_orderkey % 2 = 0 AS is_community_created, s.promo_code,
            coalesce(discount, 0.0) AS discount, coalesce(total_price, 0.0) AS total_price, n_items, product_ids
        FROM summary s JOIN priced p ON s.order_id = p.order_id LEFT JOIN order_combos c ON s.order_id = c.order_id""",
    "combos": "SELECT * FROM sold_orders WHERE combination_id IS NOT NULL",
    "combo_items": """
        SELECT combination_id, i.product_id, i.l_linenumber, i.order_id
        FROM combos c JOIN k_items i ON c.order_id = i.order_id""",
    "combo_products": "SELECT DISTINCT combination_id, product_id FROM combo_items",
    "sold_recent": """
        SELECT * FROM sold_orders WHERE event_time >= (SELECT max(event_time) FROM r_orders) - INTERVAL 30 DAY""",
    "combo_pairs": """
        SELECT a.combination_id, a.product_id AS product_a, b.product_id AS product_b
        FROM combo_products a JOIN combo_products b
            ON a.combination_id = b.combination_id AND a.product_id < b.product_id""",
    "top_pairs": """
        SELECT product_a || ' × ' || product_b AS pair_key, product_a, product_b, count(*) AS pair_count
        FROM combo_pairs WHERE combination_id IN (SELECT combination_id FROM sold_recent)
        GROUP BY product_a, product_b ORDER BY pair_count DESC, product_a, product_b LIMIT 20""",
    "titles": """
        SELECT CASE WHEN p_type = 'ECONOMY' THEN 1 WHEN p_type = 'STANDARD' THEN 2 WHEN p_type = 'SMALL' THEN 3
                ELSE 4 END AS category_no,
            CASE WHEN p_type = 'ECONOMY' THEN 'jackets' WHEN p_type = 'STANDARD' THEN 'shoes'
                WHEN p_type = 'SMALL' THEN 'tshirts' ELSE 'trousers' END AS category, p_partkey AS title_no,
            p_name || CASE p_partkey % 7 WHEN 0 THEN ' by Boss' WHEN 1 THEN ' by Hugo' ELSE '' END AS title,
            split_part(p_name, ' ', 2) AS material, p_retailprice AS price,
            [split_part(p_name, ' ', 1), 'black', 'white'][1:p_size % 3 + 1] AS colors
        FROM part""",
    "branded": """
        SELECT *, CASE WHEN title LIKE '% by Boss' THEN 'BOSS' WHEN title LIKE '% by Hugo' THEN 'HUGO'
            WHEN CAST('0x' || md5(title)[1:8] AS BIGINT) % 100 < 60 THEN 'BOSS' ELSE 'HUGO' END AS brand
        FROM titles""",
}


def with_shared(body: str) -> str:
    """The body with the shared sub-queries it needs, in the order they are listed above."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in words & set(SHARED) - needed:
            needed.add(name)
            pending.append(SHARED[name])
    parts = ",\n".join(f"{name} AS ({SHARED[name]})" for name in SHARED if name in needed)
    return f"WITH {parts}\n{body}" if parts else body


REFRESHED = "'2024-01-01 00:00:00' AS refreshed_at"


def affinity_sql(name: str, baskets: str, min_pairs: int = 2) -> str:
    """Common table expressions that give the affinity over `baskets` as `name`, by a plain self-join."""
    return f"""
        {name}_b AS ({baskets}),
        {name}_total AS (SELECT count(DISTINCT order_id) AS n FROM {name}_b),
        {name}_cnt AS (SELECT product_id, count(*) AS c FROM {name}_b GROUP BY product_id),
        {name}_pairs AS (
            SELECT x.product_id AS lhs_item_id, y.product_id AS rhs_item_id, count(*) AS pair_cnt
            FROM {name}_b x JOIN {name}_b y ON x.order_id = y.order_id AND x.product_id <> y.product_id
            GROUP BY 1, 2 HAVING count(*) >= {min_pairs}),
        {name} AS (
            SELECT lhs_item_id, rhs_item_id, pair_cnt, l.c AS lhs_cnt, r.c AS rhs_cnt, l.c / n AS support_lhs,
                r.c / n AS support_rhs, pair_cnt / n AS support_pair, pair_cnt / l.c AS confidence_lhs_to_rhs,
                CAST(pair_cnt * n AS DOUBLE) / CAST(l.c * r.c AS DOUBLE) AS lift
            FROM {name}_pairs JOIN {name}_cnt l ON lhs_item_id = l.product_id
                JOIN {name}_cnt r ON rhs_item_id = r.product_id, {name}_total)"""


AFFINITY_COLUMNS = f"""
    SELECT lhs_item_id, rhs_item_id, pair_cnt, lhs_cnt, rhs_cnt, round(support_lhs, 6) AS support_lhs,
        round(support_rhs, 6) AS support_rhs, round(support_pair, 6) AS support_pair,
        round(confidence_lhs_to_rhs, 6) AS confidence_lhs_to_rhs, round(lift, 6) AS lift, {REFRESHED}
    FROM aff"""


def ranked(k: int, table: str = "aff") -> str:
    return f"""QUALIFY row_number() OVER (PARTITION BY {table}.lhs_item_id ORDER BY {table}.lift DESC,
        {table}.confidence_lhs_to_rhs DESC, {table}.pair_cnt DESC, {table}.rhs_item_id) <= {k}"""


def _with_affinity(tail: str, *ctes: str) -> str:
    """`tail` after the shared sub-queries and the given expressions."""
    text = ",".join(ctes) + tail
    head = with_shared(text)[: -len(text)].rstrip()
    return f"{head},{text}" if head else f"WITH {text}"


def _affinity(baskets: str, tail: str, min_pairs: int = 2) -> str:
    return _with_affinity(tail, affinity_sql("aff", baskets, min_pairs))


def _filtered(condition: str) -> str:
    return f"SELECT b0.* FROM all_baskets b0 JOIN summary s ON b0.order_id = s.order_id WHERE {condition}"


ALL = "SELECT order_id, product_id FROM all_baskets"
PROMOTED = _filtered("promo_flag")

_TEXTS = {
    # bronze
    "bronze_products": """
        SELECT 'P' || lpad(CAST(n AS VARCHAR), 8, '0') AS product_id, name, material, base_price, color, brand, category
        FROM (SELECT row_number() OVER (ORDER BY category_no, title_no, color_no) AS n, title AS name, material,
                price AS base_price, colors[color_no] AS color, brand, category
            FROM (SELECT *, unnest(range(1, len(colors) + 1)) AS color_no FROM branded))""",
    "bronze_orders": "SELECT order_id, user_id, location, promo_flag, promo_code FROM r_orders",
    "bronze_order_items": """
        SELECT order_id, l.product_id, amount, color FROM r_lines l LEFT JOIN r_products p ON l.product_id = p.product_id""",
    "bronze_inventory": "SELECT * FROM r_inventory",
    "inventory_preview": "SELECT * FROM r_inventory ORDER BY product_id, location, size LIMIT 1000",
    "inventory_grid": """
        SELECT g.product_id, category, g.location, g.size, CAST(coalesce(i.amount, 0) AS BIGINT) AS amount
        FROM (SELECT product_id, category, location, unnest(CASE category WHEN 'ECONOMY' THEN ['XS', 'S', 'M']
                    WHEN 'STANDARD' THEN ['S', 'M', 'L', 'XL'] WHEN 'SMALL' THEN ['XS', 'S'] WHEN 'MEDIUM' THEN ['M', 'L']
                    WHEN 'LARGE' THEN ['L', 'XL', 'XXL'] WHEN 'PROMO' THEN ['M'] END) AS size
            FROM r_products, (VALUES ('Cologne'), ('Metzingen'), ('Munich'), ('Hamburg'), ('Online')) AS places(location)) g
        LEFT JOIN r_inventory i ON g.product_id = i.product_id AND g.location = i.location AND g.size = i.size""",
    "brand_from_title": "SELECT title_no, title, brand FROM branded",
    "catalog_flat": """
        SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS product_id, p_name AS name, p_brand AS brand,
            round(p_retailprice, 2) AS price, round(orig, 2) AS original_price,
            CAST(round_even((1 - p_retailprice / orig) * 100, 0) AS DOUBLE) AS discount,
            split_part(p_name, ' ', 1) AS color, 'P' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.jpg' AS image,
            'S,' || p_size AS sizes, lower(p_type) AS category_id, p_type[1:1] || lower(p_type[2:]) AS category_name
        FROM (SELECT *, CASE WHEN p_size % 2 = 0 AND p_size > 0 THEN p_retailprice + 10 * p_size END AS orig FROM part)""",
    "combination_id": "SELECT order_id, combination_id FROM order_combos",
    "price_orders": """
        SELECT order_id, promo_code, round(subtotal, 2) AS subtotal, round(discount, 2) AS discount,
            round(total_price, 2) AS total_price
        FROM priced""",
    "event_envelopes": """
        SELECT event_type, strftime(event_time, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS event_time, order_id, combination_id,
            "user", is_community_created, promo_code, round(discount, 2) AS discount,
            round(total_price, 2) AS total_price, CAST(coalesce(n_items, 0) AS INTEGER) AS n_items, product_ids
        FROM sold_orders""",
    # silver
    "dedup_order_items": "SELECT order_id, product_id, amount, l_linenumber FROM k_items",
    "dim_product": """
        SELECT product_id, name AS product_name, category, brand, true AS is_active, CAST(NULL AS VARCHAR) AS effective_ts
        FROM r_products""",
    "dim_store": "SELECT * FROM stores",
    "dim_date": """
        SELECT date, CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, CAST(year(date) AS INTEGER) AS year,
            CAST(quarter(date) AS INTEGER) AS quarter, CAST(month(date) AS INTEGER) AS month,
            CAST(day(date) AS INTEGER) AS day, strftime(date, '%a') AS day_of_week
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)""",
    "fact_sales_item": """
        SELECT order_id, product_id, round(qty, 2) AS qty, round(unit_price, 2) AS unit_price,
            round(line_value, 2) AS line_value, category, brand
        FROM sales""",
    "fact_basket_product": "SELECT * FROM all_baskets",
    "fact_basket_summary": """
        SELECT order_id, user_id, order_date, store_id, promo_flag, promo_code,
            CAST(basket_size AS DOUBLE) AS basket_size,
            round(basket_qty, 2) AS basket_qty, round(basket_value, 2) AS basket_value
        FROM summary""",
    "fact_product_counts": "SELECT product_id, count(DISTINCT order_id) AS basket_cnt FROM k_items GROUP BY product_id",
    "kx_total_baskets": "SELECT count(DISTINCT order_id) AS n FROM k_items",
    # key figures
    "aov_overall": "SELECT round(avg(basket_value), 6) AS aov FROM summary",
    "aov_by_region_channel": """
        SELECT region, channel, count(DISTINCT order_id) AS orders, round(sum(basket_value), 2) AS revenue,
            round(avg(basket_value), 6) AS aov
        FROM stored GROUP BY region, channel""",
    "aov_by_brand": """
        SELECT brand, round(avg(v), 6) AS aov_brand
        FROM (SELECT order_id, brand, sum(line_value) AS v FROM sales GROUP BY order_id, brand) GROUP BY brand""",
    "top_products_by_category": """
        SELECT *, CAST(row_number() OVER (
            PARTITION BY category ORDER BY revenue DESC, qty_sold DESC, product_name, product_id) AS INTEGER)
            AS rank_in_category
        FROM (SELECT product_id, name AS product_name, category, brand, round(sum(qty), 2) AS qty_sold,
                round(sum(line_value), 2) AS revenue
            FROM sales GROUP BY 1, 2, 3, 4)
        QUALIFY rank_in_category <= 10""",
    "regional_split": """
        SELECT region, channel, brand, count(DISTINCT order_id) AS orders, round(sum(qty), 2) AS qty,
            round(sum(line_value), 2) AS revenue
        FROM star GROUP BY region, channel, brand""",
    "promo_share_orders": """
        SELECT round(count(*) FILTER (WHERE promo_flag) / count(DISTINCT order_id), 6) AS promo_share_orders FROM stored""",
    "promo_share_users": """
        SELECT round(sum(ever) / count(*), 6) AS promo_share_users
        FROM (SELECT user_id, max(CASE WHEN promo_flag THEN 1 ELSE 0 END) AS ever FROM stored GROUP BY user_id)""",
    "promo_share_by_channel": """
        SELECT channel, count(*) FILTER (WHERE promo_flag) AS orders_with_promo, count(DISTINCT order_id) AS orders_total,
            round(count(*) FILTER (WHERE promo_flag) / count(DISTINCT order_id), 6) AS promo_share_orders
        FROM stored GROUP BY channel""",
    # measures and report
    "measure_totals": """
        SELECT round(revenue, 2) AS revenue, round(units_sold, 6) AS units_sold, orders, round(revenue / orders, 6) AS aov,
            round(promoted / orders, 6) AS promo_orders, round(promo_u / users, 6) AS promo_users
        FROM (SELECT sum(line_value) AS revenue, sum(qty) AS units_sold FROM sales),
            (SELECT count(DISTINCT order_id) AS orders, count(DISTINCT order_id) FILTER (WHERE promo_flag) AS promoted,
                count(DISTINCT coalesce(user_id, '')) FILTER (WHERE promo_flag) AS promo_u,
                count(DISTINCT coalesce(user_id, '')) AS users
            FROM summary)""",
    "measure_aov_by_date": """
        SELECT o.order_date AS date, round(any_value(r.revenue) / count(DISTINCT order_id), 6) AS aov
        FROM summary o LEFT JOIN (SELECT order_date, CAST(sum(CAST(line_value AS DECIMAL(28, 6))) AS DOUBLE) AS revenue
                FROM star GROUP BY 1) r
            ON o.order_date = r.order_date
        GROUP BY o.order_date""",
    "measures_by_store": """
        SELECT o.store_id, CAST(o.y AS INTEGER) AS year, round(revenue, 2) AS revenue, orders,
            round(revenue / orders, 6) AS aov, round(promoted / orders, 6) AS promo_orders,
            round(promo_u / users, 6) AS promo_users
        FROM (SELECT store_id, year(order_date) AS y, count(DISTINCT order_id) AS orders,
                count(DISTINCT order_id) FILTER (WHERE promo_flag) AS promoted,
                count(DISTINCT coalesce(user_id, '')) FILTER (WHERE promo_flag) AS promo_u,
                count(DISTINCT coalesce(user_id, '')) AS users
            FROM summary GROUP BY 1, 2) o
        LEFT JOIN (SELECT store_id, year(order_date) AS y, sum(line_value) AS revenue FROM star GROUP BY 1, 2) r
            ON o.store_id = r.store_id AND o.y = r.y""",
    "star_revenue_by_month_channel": """
        SELECT CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month, s.channel, category,
            round(sum(line_value), 2) AS revenue, round(sum(qty), 2) AS units_sold, any_value(orders) AS orders
        FROM star s JOIN (SELECT year(order_date) AS y, month(order_date) AS m, channel, count(DISTINCT order_id) AS orders
            FROM stored WHERE region IN ('NRW', 'Online', 'Berlin') GROUP BY 1, 2, 3) o
            ON year(order_date) = y AND month(order_date) = m AND s.channel = o.channel
        WHERE region IN ('NRW', 'Online', 'Berlin') GROUP BY 1, 2, 3, 4""",
    "revenue_by_region_channel": """
        SELECT region, channel, round(sum(line_value), 2) AS revenue FROM star GROUP BY region, channel""",
    "revenue_by_category": "SELECT category, round(sum(line_value), 2) AS revenue FROM sales GROUP BY category",
    "report_revenue_by_date_category": """
        SELECT order_date AS date, category, round(sum(line_value), 2) AS revenue
        FROM star WHERE order_date IS NOT NULL GROUP BY 1, 2""",
    "report_units": """
        SELECT order_date AS date, brand, category, round(sum(qty), 2) AS units_sold
        FROM star WHERE order_date IS NOT NULL GROUP BY 1, 2, 3""",
    "report_revenue_by_brand": """
        SELECT brand, round(sum(line_value), 2) AS revenue FROM sales WHERE category IN ('ECONOMY', 'SMALL') GROUP BY brand""",
    "report_units_total": """
        SELECT round(sum(qty), 2) AS units_sold FROM sales WHERE brand IN ('Brand#1', 'Brand#2')""",
    "orders_in_month": """
        SELECT count(*) AS orders FROM summary WHERE month(order_date) = 12 AND basket_size > 3""",
    # lookups
    "resolve_product": """
        SELECT product_id, name FROM r_products WHERE contains(lower(name), 'red w')
        ORDER BY lower(name) = 'red w' DESC, product_id LIMIT 5""",
    "stock_by_name_location": """
        SELECT p.product_id, CAST(coalesce(sum(amount), 0) AS BIGINT) AS total_stock
        FROM r_products p LEFT JOIN r_inventory i ON p.product_id = i.product_id AND i.location = 'Cologne'
        WHERE lower(name) = 'red widget' GROUP BY p.product_id""",
    "stock_by_size": """
        SELECT i.product_id, size, CAST(sum(amount) AS BIGINT) AS amount
        FROM r_inventory i JOIN r_products p ON p.product_id = i.product_id
        WHERE location = 'Metzingen' AND name = 'blue bolt' GROUP BY 1, 2""",
    "stock_by_material": """
        SELECT size, CAST(sum(amount) AS BIGINT) AS amount
        FROM r_inventory i JOIN r_products p ON p.product_id = i.product_id
        WHERE location = 'Cologne' AND category = 'ECONOMY' AND material = 'gear' GROUP BY size""",
    "product_attributes": "SELECT product_id, name, color, material FROM r_products WHERE name = 'hot gear'",
    # live figures
    "live_items_sold": """
        SELECT CAST(coalesce(sum(amount), 0) AS BIGINT) AS items_sold
        FROM k_items i JOIN r_orders o ON i.order_id = o.order_id
        WHERE event_time >= (SELECT max(event_time) FROM r_orders) - INTERVAL 30 DAY""",
    "live_revenue": "SELECT round(coalesce(sum(total_price), 0), 2) AS revenue FROM recent",
    "live_orders_per_bin": """
        SELECT strftime(date_trunc('hour', event_time), '%Y-%m-%d %H:%M:%S') AS event_time, count(*) AS orders
        FROM recent GROUP BY 1""",
    "live_aov": """
        SELECT strftime(date_trunc('hour', event_time), '%Y-%m-%d %H:%M:%S') AS event_time,
            round(sum(total_price) / count(*), 6) AS aov
        FROM recent GROUP BY 1""",
    "live_promo_usage": """
        SELECT strftime(date_trunc('hour', event_time), '%Y-%m-%d %H:%M:%S') AS event_time,
            round(100.0 * count(*) FILTER (WHERE promo_code <> '') / count(*), 6) AS promo_usage_pct
        FROM recent GROUP BY 1""",
    "live_combo_rate": """
        SELECT strftime(date_trunc('hour', event_time), '%Y-%m-%d %H:%M:%S') AS event_time, count(*) AS total_orders,
            count(combination_id) AS combo_orders, round(100.0 * count(combination_id) / count(*), 6) AS combo_order_pct
        FROM recent GROUP BY 1""",
    "combo_sets": """
        SELECT combination_id, string_agg(product_id, ',' ORDER BY product_id) AS products
        FROM combo_products GROUP BY combination_id""",
    "combo_array_pairs": """
        SELECT product_a AS item_a, product_b AS item_b, count(*) AS pair_cnt FROM combo_pairs GROUP BY 1, 2""",
    "sold_pairs_top20": "SELECT product_a, product_b, pair_count FROM top_pairs",
    "sold_pair_top1": """
        SELECT pair_key, product_a, product_b, pair_count
        FROM top_pairs ORDER BY pair_count DESC, product_a, product_b LIMIT 1""",
    "pair_top3_distinct": """
        SELECT pair_key, product_a, product_b, pair_count AS combo_count
        FROM top_pairs ORDER BY pair_count DESC, product_a, product_b LIMIT 3""",
    "pair_cumulative_series": """
        SELECT strftime(bin, '%Y-%m-%d %H:%M:%S') AS event_time, pair_key,
            CAST(sum(v) OVER (PARTITION BY pair_key ORDER BY bin) AS BIGINT) AS cum
        FROM (SELECT b.bin, t.pair_key, count(DISTINCT s.combination_id) AS v
            FROM (SELECT * FROM top_pairs ORDER BY pair_count DESC, product_a, product_b LIMIT 3) t
            CROSS JOIN (SELECT unnest(range(now_ - INTERVAL 30 DAY, now_, INTERVAL 1 DAY)) AS bin
                FROM (SELECT max(event_time) AS now_ FROM r_orders)) b
            LEFT JOIN (SELECT p.product_a, p.product_b, r.combination_id, r.event_time
                FROM combo_pairs p JOIN sold_recent r ON p.combination_id = r.combination_id) s
                ON s.product_a = t.product_a AND s.product_b = t.product_b
                AND s.event_time >= b.bin AND s.event_time < b.bin + INTERVAL 1 DAY
            GROUP BY b.bin, t.pair_key)""",
    "retention_prune": """
        SELECT order_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, promo_code, combination_id,
            round(total_price, 2) AS total_price
        FROM purchases WHERE event_time >= (SELECT max(event_time) FROM purchases) - INTERVAL 1 DAY""",
    # streams
    "stream_sales": """
        SELECT i.product_id, color, ['XS', 'S', 'M', 'L', 'XL', 'XXL', 'XXXL'][l_linenumber] AS size,
            CAST(amount AS BIGINT) AS quantity, round(base_price, 2) AS price, order_id,
            row_number() OVER (PARTITION BY order_id ORDER BY i.product_id) - 1 AS item_index
        FROM k_items i JOIN r_products p ON i.product_id = p.product_id""",
    "stream_sales_orders": """
        SELECT event_type, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, order_id, combination_id, "user",
            is_community_created, promo_code, round(discount, 2) AS discount, round(total_price, 2) AS total_price,
            product_ids AS items
        FROM sold_orders""",
    "stream_combinations": """
        SELECT 'combination_created' AS event_type, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time,
            combination_id, "user" AS user_id, is_community_created AS community_created,
            CAST(n_items AS INTEGER) AS items
        FROM combos""",
    "stream_combination_items": """
        SELECT c.product_id, name, brand, category, round(base_price, 2) AS price, color,
            ['XS', 'S', 'M', 'L', 'XL', 'XXL', 'XXXL'][l_linenumber] AS size, combination_id,
            row_number() OVER (PARTITION BY order_id ORDER BY c.product_id) - 1 AS "ArrayIndex_items"
        FROM combo_items c JOIN r_products p ON c.product_id = p.product_id""",
    "stream_drift": """
        SELECT event_type, CASE WHEN is_community_created THEN strftime(event_time, '%Y-%m-%d %H:%M:%S')
                ELSE '2024-01-01 00:00:00' END AS event_time, order_id, combination_id, "user",
            CASE WHEN is_community_created THEN promo_code END AS promo_code,
            CASE WHEN is_community_created THEN round(total_price, 2) END AS total_price,
            CAST(coalesce(n_items, 0) AS INTEGER) AS n_items
        FROM sold_orders""",
    "stream_rejects": """
        SELECT 'landed' AS reason, count(*) AS messages FROM sold_orders
        UNION ALL
        SELECT reason, count(*) AS messages
        FROM (SELECT unnest(['no JSON', 'no known field', 'unreadable time', 'total_price does not fit',
                'items[].quantity does not fit']) AS reason FROM sold_orders
            WHERE NOT is_community_created)
        GROUP BY 1""",
    "stream_kpis_tumbling": """
        SELECT strftime(date_trunc('hour', event_time), '%Y-%m-%d %H:%M:%S') AS event_time, count(*) AS orders,
            round(sum(total_price), 6) AS revenue, round(sum(total_price) / count(*), 6) AS aov,
            round(100.0 * count(*) FILTER (WHERE promo_code <> '') / count(*), 6) AS promo_usage_pct,
            count(combination_id) AS combo_orders, round(100.0 * count(combination_id) / count(*), 6) AS combo_order_pct
        FROM purchases GROUP BY 1""",
    "stream_kpis_sliding": """
        SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
            strftime(w + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS orders,
            round(sum(total_price), 2) AS revenue
        FROM (SELECT total_price,
                unnest(range(date_trunc('hour', event_time) - INTERVAL 5 HOUR,
                    date_trunc('hour', event_time) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS w
            FROM purchases)
        GROUP BY w""",
}

_TEXTS["stream_cards_sliding"] = """
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
        strftime(w + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS orders,
        round(sum(total_price), 2) AS revenue, CAST(sum(units) AS BIGINT) AS items_sold
    FROM (SELECT total_price, coalesce(u.units, 0) AS units,
            unnest(range(date_trunc('day', event_time) - INTERVAL 29 DAY,
                date_trunc('day', event_time) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS w
        FROM sold_orders o LEFT JOIN (SELECT order_id, sum(amount) AS units FROM k_items GROUP BY order_id) u
            ON o.order_id = u.order_id)
    GROUP BY w"""

_TEXTS["catalog_split"] = _TEXTS["catalog_flat"]
_TEXTS["stream_kpis_folded"] = _TEXTS["stream_kpis_tumbling"]
_TEXTS["stream_retained"] = """
    SELECT order_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, round(total_price, 2) AS total_price,
        CAST(coalesce(units, 0) AS BIGINT) AS units
    FROM sold_orders LEFT JOIN (SELECT order_id AS o, sum(amount) AS units FROM k_items GROUP BY order_id) ON o = order_id
    WHERE CAST(event_time AS DATE) >= CAST((SELECT max(event_time) FROM sold_orders) - INTERVAL 30 DAY AS DATE)"""
_TEXTS["dashboard"] = """
    SELECT 'totals' AS visual, CAST(NULL AS DATE) AS date, CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS channel,
        CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS VARCHAR) AS category, round(sum(line_value), 2) AS revenue,
        CAST(any_value(n) AS DOUBLE) AS orders, round(sum(line_value) / any_value(n), 6) AS aov
    FROM sales, (SELECT count(*) AS n FROM summary)
    UNION ALL
    SELECT 'aov_by_date', o.order_date, NULL, NULL, NULL, NULL, round(revenue, 2), orders, round(revenue / orders, 6)
    FROM (SELECT order_date, count(*) AS orders FROM summary GROUP BY 1) o
        LEFT JOIN (SELECT order_date, CAST(sum(CAST(line_value AS DECIMAL(28, 6))) AS DOUBLE) AS revenue FROM star GROUP BY 1) r
            ON o.order_date = r.order_date
    UNION ALL
    SELECT 'revenue_by_region_channel', NULL, region, channel, NULL, NULL, round(sum(line_value), 2), NULL, NULL
    FROM star GROUP BY region, channel
    UNION ALL
    SELECT 'revenue_by_brand', NULL, NULL, NULL, brand, NULL, round(sum(line_value), 2), NULL, NULL FROM sales GROUP BY brand
    UNION ALL
    SELECT 'revenue_by_category', NULL, NULL, NULL, NULL, category, round(sum(line_value), 2), NULL, NULL
    FROM sales GROUP BY category"""
_TEXTS["pair_distinct_estimates"] = "SELECT pair_key, pair_count AS combinations FROM top_pairs"
_TEXTS["pair_running_totals"] = """
    SELECT * FROM (WITH top3 AS (SELECT * FROM top_pairs ORDER BY pair_count DESC, product_a, product_b LIMIT 3),
    sold3 AS (SELECT t.pair_key, r.combination_id, r.event_time FROM top3 t
        JOIN combo_pairs p ON p.product_a = t.product_a AND p.product_b = t.product_b
        JOIN sold_recent r ON p.combination_id = r.combination_id),
    bins AS (SELECT unnest(range(now_ - INTERVAL 30 DAY, now_ + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS bin
        FROM (SELECT max(event_time) AS now_ FROM r_orders))
    SELECT strftime(bin, '%Y-%m-%d %H:%M:%S') AS event_time, pair_key,
        CAST(sum(v) OVER (PARTITION BY pair_key ORDER BY bin) AS BIGINT) AS cum
    FROM (SELECT b.bin, t.pair_key, count(DISTINCT s.combination_id) AS v FROM top3 t CROSS JOIN bins b
        LEFT JOIN sold3 s ON s.pair_key = t.pair_key AND s.event_time >= b.bin AND s.event_time < b.bin + INTERVAL 1 DAY
        WHERE b.bin + INTERVAL 1 DAY <= (SELECT max(event_time) FROM sold3)
        GROUP BY b.bin, t.pair_key))"""
_TEXTS["job_sales_top_products"] = _TEXTS["top_products_by_category"]
ORACLE_SQL = {name: with_shared(text) for name, text in _TEXTS.items()}

_NAMED_TAIL = f"""
    SELECT lhs_item_id, pl.name AS lhs_name, rhs_item_id, pr.name AS rhs_name, pair_cnt,
        round(support_pair, 6) AS support_pair, round(confidence_lhs_to_rhs, 6) AS confidence_lhs_to_rhs,
        round(lift, 6) AS lift, {REFRESHED}
    FROM (SELECT * FROM aff {ranked(10)}) t
        JOIN r_products pl ON lhs_item_id = pl.product_id JOIN r_products pr ON rhs_item_id = pr.product_id"""

_RECOMMEND_TAIL = f"""
    SELECT lhs_item_id, rhs_item_id, name AS rhs_name, round(lift, 6) AS lift,
        round(confidence_lhs_to_rhs, 6) AS confidence, pair_cnt
    FROM (SELECT * FROM promo {ranked(10, "promo")}
        UNION ALL
        SELECT * FROM (SELECT * FROM aff WHERE lhs_item_id NOT IN (SELECT lhs_item_id FROM promo)) rest {ranked(10, "rest")})
    JOIN r_products ON rhs_item_id = product_id"""

ORACLE_SQL.update(
    {
        "product_affinity": _affinity(ALL, AFFINITY_COLUMNS),
        "affinity_topk": _affinity(ALL, f"{AFFINITY_COLUMNS} {ranked(3)}"),
        "affinity_topk_named": _affinity(ALL, _NAMED_TAIL),
        "job_gold_affinity_topk": _affinity(ALL, _NAMED_TAIL),
        "affinity_date_range": _affinity(
            _filtered("order_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"), AFFINITY_COLUMNS),
        "affinity_stores": _affinity(_filtered("store_id IN ('Cologne', 'Online')"), AFFINITY_COLUMNS),
        "affinity_promo_only": _affinity(PROMOTED, AFFINITY_COLUMNS),
        "affinity_non_promo": _affinity(_filtered("NOT coalesce(promo_flag, false)"), AFFINITY_COLUMNS),
        "affinity_empty": _affinity(_filtered("store_id = 'Nowhere'"), AFFINITY_COLUMNS),
        "affinity_brands": _affinity(
            "SELECT DISTINCT order_id, brand AS product_id FROM sales", AFFINITY_COLUMNS, 5),
        "recommend": _with_affinity(_RECOMMEND_TAIL, affinity_sql("promo", PROMOTED), affinity_sql("aff", ALL)),
    }
)

_VIEWS = {name: name for name in ("dim_product", "dim_store", "dim_date", "fact_sales_item", "fact_basket_summary")} | {
    "sales_aov_overall": "aov_overall", "sales_aov_by_region_channel": "aov_by_region_channel", "sales_aov_by_brand": "aov_by_brand",
    "sales_top_products_by_category": "top_products_by_category", "sales_regional_split": "regional_split",
    "sales_promo_share_orders": "promo_share_orders", "sales_promo_share_users": "promo_share_users",
    "sales_promo_share_by_channel": "promo_share_by_channel", "product_affinity_topk_named": "job_gold_affinity_topk",
}
ORACLE_SQL["job_model_views"] = " UNION ALL ".join(
    f"SELECT '{view}' AS \"view\", count(*) AS n_rows FROM ({ORACLE_SQL[name]})" for view, name in _VIEWS.items()
)
