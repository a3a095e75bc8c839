"""SQL that recomputes every registered query from the same Parquet tables.

Written independently of the library: plain joins, ordered aggregates and windows over whole
tables. Each check is one WITH query that uses the views it needs.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

DEFAULT_PLACES = 7
# Means over 2^k rows often end in 5 right after the last place. Rounding there would hang on the
# last bit of a sum, so the threshold is moved off the middle by this share of a place.
NUDGE = 0.033
# Sums of money have few decimals, so rounding to those makes them equal in any summation order.
PLACES = {
    "statistic": 6, "t": 6, "expected_bad_reviews": 6, "excess_bad_reviews": 6,
    "business_priority_score": 6,
    "gmv": 2, "total_price": 2, "seller_price": 2, "peak_gmv": 2, "last_gmv": 2,
    "gmv_ma3": 4, "aov": 4, "payment_value": 4,
    "total_freight": 4, "seller_freight": 4, "freight": 4,
    "current": 4, "base": 4, "delta": 4,
}
Z = 1.959963984540054


def rounding(name: str) -> tuple[int, float]:
    """Places of a column and what to add before rounding."""
    places = PLACES.get(name, DEFAULT_PLACES)
    return places, NUDGE * 10.0**-places


_exact = False


@contextmanager
def exact():
    """Columns keep all digits within: for checks that calculate on."""
    global _exact
    before, _exact = _exact, True
    try:
        yield
    finally:
        _exact = before


def num(expression: str, name: str) -> str:
    """A double column, rounded as in the query."""
    places, nudge = rounding(name)
    if _exact:
        return f"CAST({expression} AS DOUBLE) AS {name}"
    return f"round(CAST({expression} AS DOUBLE) + {nudge!r}, {places}) AS {name}"


def nums(**columns: str) -> str:
    return ", ".join(num(expression, name) for name, expression in columns.items())


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def days(start: str, end: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / 86400e6)"


def wilson(hits: str, n: str) -> tuple[str, str]:
    p, t = f"(({hits}) * 1e0 / ({n}))", f"(({n}) * 1e0)"
    mid = f"({p} + {Z**2 / 2} / {t})"
    half = f"({Z} * sqrt({p} * (1 - {p}) / {t} + {Z**2 / 4} / ({t} * {t})))"
    scale = f"(1 + {Z**2} / {t})"
    return (
        f"CASE WHEN ({n}) > 0 THEN ({mid} - {half}) / {scale} END",
        f"CASE WHEN ({n}) > 0 THEN ({mid} + {half}) / {scale} END",
    )


LATE = """(o_orderkey * 37) % 167 + (o_orderkey * 53) % 601 + 24 * (o_custkey % 5) + 54
          > 24 * (14 + o_orderkey % 11)"""
CARRIER = "o_orderdate + INTERVAL 1 HOUR * (30 + (o_orderkey * 37) % 167)"
TRANSIT = "INTERVAL 1 HOUR * (24 + (o_orderkey * 53) % 601 + 24 * (o_custkey % 5))"

# View name -> SQL. Views refer to each other; a check takes along what it reaches.
VIEWS: dict[str, str] = {
    "r_orders": f"""
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               CASE WHEN o_orderstatus = 'F' THEN 'delivered'
                    WHEN o_orderkey % 9 = 4 THEN 'canceled'
                    WHEN o_orderstatus = 'O' THEN 'delivered' ELSE 'shipped' END AS order_status,
               o_orderdate AS bought,
               CASE WHEN o_orderkey % 101 <> 0
                    THEN o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 30) END AS approved,
               CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN NULL
                    ELSE {CARRIER} END AS carrier,
               CASE WHEN o_orderstatus = 'P' THEN NULL
                    ELSE {CARRIER} + {TRANSIT} END AS delivered,
               o_orderdate + INTERVAL 1 DAY * (14 + o_orderkey % 11) AS estimated
        FROM orders""",
    "r_items": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
               l_extendedprice AS price, l_extendedprice * abs(l_tax) * 8 AS freight,
               o_orderdate + INTERVAL 1 DAY * (2 + l_suppkey % 7) AS limit_date,
               CASE WHEN p_partkey IS NULL OR p_partkey % 23 = 0 THEN 'missing_product_category'
                    WHEN p_type = 'SMALL' THEN 'missing_translation'
                    ELSE lower(p_type) END AS category
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
             LEFT JOIN part ON l_partkey = p_partkey""",
    "r_sellers": """
        SELECT s_suppkey AS seller_id, n_name AS seller_state, r_name AS seller_city
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
             LEFT JOIN region ON n_regionkey = r_regionkey""",
    "r_payments": """
        SELECT o_orderkey AS order_id,
               CASE o_orderkey % 4 WHEN 0 THEN 'boleto' WHEN 3 THEN 'debit_card'
                    ELSE 'credit_card' END AS payment_type,
               CAST(1 + o_orderkey % 10 AS INTEGER) AS installments,
               o_totalprice * (CASE WHEN o_orderkey % 5 = 0 THEN 0.4e0 ELSE 1e0 END) AS paid
        FROM orders WHERE o_orderkey % 211 <> 0
        UNION ALL
        SELECT o_orderkey, 'voucher', 1, o_totalprice * 0.6e0
        FROM orders WHERE o_orderkey % 211 <> 0 AND o_orderkey % 5 = 0""",
    "r_reviews": f"""
        SELECT o_orderkey AS order_id,
               CAST(greatest(1, least(5, 5 - (o_orderkey * 31) % 3 -
                   CASE WHEN o_orderstatus = 'P' THEN 1 WHEN {LATE} THEN 2 ELSE 0 END
               )) AS INTEGER) AS score
        FROM orders WHERE o_orderkey % 20 <> 0
        UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 25 = 1""",
    "i_totals": """
        SELECT order_id, count(*) AS items, count(DISTINCT product_id) AS products,
               count(DISTINCT seller_id) AS sellers, count(DISTINCT category) AS categories,
               CAST(sum(CAST(price AS DECIMAL(18,4))) AS DOUBLE) AS price,
               CAST(sum(CAST(freight AS DECIMAL(18,4))) AS DOUBLE) AS freight,
               max(limit_date) AS limit_date
        FROM r_items GROUP BY order_id""",
    "i_category": """
        SELECT order_id, first(category ORDER BY worth DESC, category) AS category FROM (
            SELECT order_id, category, sum(CAST(price AS DECIMAL(18,4))) AS worth
            FROM r_items GROUP BY ALL) GROUP BY order_id""",
    "i_seller": """
        SELECT order_id, first(seller_id ORDER BY worth DESC, seller_id) AS seller_id FROM (
            SELECT order_id, seller_id, sum(CAST(price AS DECIMAL(18,4))) AS worth
            FROM r_items GROUP BY ALL) GROUP BY order_id""",
    "items_agg": """
        SELECT order_id, items, products, sellers, categories, price, freight, limit_date,
               category, s.seller_id, seller_state,
               CASE WHEN categories > 1 THEN 1 ELSE 0 END AS mixed
        FROM i_totals JOIN i_category USING (order_id) JOIN i_seller s USING (order_id)
             LEFT JOIN r_sellers r ON r.seller_id = s.seller_id""",
    "pay_agg": """
        SELECT order_id, sum(paid) AS paid, sum(n) AS payments, max(installments) AS installments,
               first(payment_type ORDER BY worth DESC, payment_type) AS payment_type
        FROM (SELECT order_id, payment_type, sum(paid) AS paid, count(*) AS n,
                     max(installments) AS installments,
                     sum(CAST(round(paid, 4) AS DECIMAL(18,4))) AS worth
              FROM r_payments GROUP BY order_id, payment_type) GROUP BY order_id""",
    "rev_agg": """
        SELECT order_id, avg(score) AS score, min(score) AS low, count(*) AS reviews,
               CAST(bool_or(score <= 2) AS INTEGER) AS bad
        FROM r_reviews GROUP BY order_id""",
    "om": f"""
        SELECT o.order_id, o.customer_id, c.c_custkey AS customer_unique_id, order_status,
               bought AS order_purchase_timestamp, approved AS order_approved_at,
               carrier AS order_delivered_carrier_date, delivered AS order_delivered_customer_date,
               estimated AS order_estimated_delivery_date,
               strftime(bought, '%Y-%m') AS order_year_month,
               c_mktsegment AS customer_city, n_name AS customer_state,
               i.seller_id AS main_seller_id, i.seller_state,
               coalesce(category, 'no_order_items') AS product_category_name,
               coalesce(mixed, 0) AS is_mixed_category,
               coalesce(items, 0) AS order_item_count, coalesce(products, 0) AS distinct_products,
               coalesce(sellers, 0) AS distinct_sellers,
               coalesce(categories, 0) AS distinct_categories,
               coalesce(price, 0) AS total_price, coalesce(freight, 0) AS total_freight,
               coalesce(paid, 0) AS payment_value,
               CAST(coalesce(payments, 0) AS BIGINT) AS payment_count,
               coalesce(installments, 0) AS max_installments,
               coalesce(payment_type, 'unknown') AS main_payment_type,
               score AS review_score, low AS min_review_score,
               coalesce(reviews, 0) AS review_count,
               CASE WHEN reviews > 0 THEN 1 ELSE 0 END AS has_review, bad AS is_bad_review,
               CASE WHEN delivered IS NULL THEN 0 ELSE 1 END AS is_delivered,
               CASE WHEN order_status = 'canceled' THEN 1 ELSE 0 END AS is_cancelled,
               {days('bought', 'delivered')} AS delivery_time_days,
               {days('bought', 'estimated')} AS estimated_delivery_time_days,
               {days('estimated', 'delivered')} AS delay_days,
               CAST(delivered > estimated AS INTEGER) AS is_delayed,
               CASE WHEN price > 0 THEN freight / price END AS freight_share,
               {days('bought', 'approved')} AS approval_time_days,
               {days('approved', 'carrier')} AS handover_time_days,
               {days('carrier', 'delivered')} AS transit_time_days,
               CAST(carrier > limit_date AS INTEGER) AS is_late_handover,
               {days('limit_date', 'carrier')} AS seller_overrun_days,
               {days('carrier', 'delivered')} - {days('limit_date', 'estimated')}
                   AS transit_overrun_days
        FROM r_orders o LEFT JOIN customer c ON o.customer_id = c_custkey
             LEFT JOIN nation ON c_nationkey = n_nationkey
             LEFT JOIN items_agg i ON o.order_id = i.order_id
             LEFT JOIN pay_agg p ON o.order_id = p.order_id
             LEFT JOIN rev_agg r ON o.order_id = r.order_id""",
    "os": """
        SELECT t.order_id, t.seller_id, s.seller_state, s.seller_city,
               t.category AS product_category_name, t.items AS seller_item_count,
               t.price AS seller_price, t.freight AS seller_freight, o.distinct_sellers,
               CASE WHEN o.distinct_sellers = 1 THEN 1 ELSE 0 END AS is_single_seller_order,
               o.order_year_month, o.order_purchase_timestamp, o.customer_state, o.is_delivered,
               o.is_cancelled, o.is_delayed, o.delivery_time_days, o.handover_time_days,
               o.transit_time_days, o.review_score, o.is_bad_review, o.has_review,
               CAST(o.order_delivered_carrier_date > t.limit_date AS INTEGER) AS is_late_handover
        FROM (SELECT order_id, seller_id, CAST(sum(items) AS BIGINT) AS items,
                     sum(price) AS price, sum(freight) AS freight, max(limit_date) AS limit_date,
                     first(category ORDER BY worth DESC, category) AS category
              FROM (SELECT order_id, seller_id, category, count(*) AS items, sum(price) AS price,
                           sum(freight) AS freight, max(limit_date) AS limit_date,
                           sum(CAST(price AS DECIMAL(18,4))) AS worth
                    FROM r_items GROUP BY order_id, seller_id, category)
              GROUP BY order_id, seller_id) t
             LEFT JOIN r_sellers s USING (seller_id) LEFT JOIN om o ON o.order_id = t.order_id""",
    "sm": """
        SELECT seller_id, max(seller_state) AS seller_state, max(seller_city) AS seller_city,
               max(top) AS top_category, count(DISTINCT order_id) AS orders,
               CAST(sum(seller_item_count) AS BIGINT) AS items,
               count(DISTINCT product_category_name) AS distinct_categories,
               sum(seller_price) AS gmv, sum(seller_freight) AS freight,
               CAST(sum(is_single_seller_order) AS BIGINT) AS single_seller_orders,
               avg(is_delivered) AS delivered_rate, avg(is_delayed) AS delay_rate,
               avg(is_bad_review) AS bad_review_rate, avg(review_score) AS avg_review_score,
               avg(has_review) AS review_coverage, avg(delivery_time_days) AS avg_delivery_time_days,
               avg(handover_time_days) AS avg_handover_time_days,
               avg(transit_time_days) AS avg_transit_time_days,
               avg(is_late_handover) AS late_handover_rate
        FROM os JOIN (
            SELECT seller_id, first(category ORDER BY worth DESC, category) AS top FROM (
                SELECT seller_id, product_category_name AS category,
                       sum(CAST(seller_price AS DECIMAL(18,4))) AS worth
                FROM os GROUP BY ALL) GROUP BY seller_id) USING (seller_id)
        GROUP BY seller_id""",
    # order value as exact money: means that are rounded for display must not hang on the last bit
    "paid": "SELECT *, CAST(CAST(total_price AS DECIMAL(18,4)) AS DECIMAL(28,4)) AS money FROM om",
    # prepared tables: unknown groups named
    "po": """
        SELECT * REPLACE (coalesce(customer_state, 'unknown') AS customer_state,
                          coalesce(seller_state, 'unknown') AS seller_state),
               CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS order_month
        FROM om""",
    "ps": """
        SELECT * REPLACE (coalesce(customer_state, 'unknown') AS customer_state,
                          coalesce(seller_state, 'unknown') AS seller_state)
        FROM os""",
    "rated": "SELECT * FROM po WHERE review_score IS NOT NULL",
    "came": "SELECT * FROM po WHERE is_delivered = 1",
    "buckets": """
        SELECT *, CASE WHEN delay_days <= 0 THEN 0 WHEN delay_days <= 3 THEN 1
                       WHEN delay_days <= 7 THEN 2 WHEN delay_days <= 14 THEN 3
                       WHEN delay_days > 14 THEN 4 END AS bucket_id
        FROM om""",
    "sold_multi": """
        SELECT * FROM os WHERE is_bad_review IS NOT NULL""",
    "sold_single": """
        SELECT * FROM os WHERE is_bad_review IS NOT NULL AND is_single_seller_order = 1""",
    "states": """
        SELECT customer_state, count(*) AS orders, sum(total_price) AS gmv,
               avg(is_delayed) AS delay_rate, avg(delivery_time_days) AS avg_delivery_time_days,
               avg(is_bad_review) AS bad_review_rate
        FROM came GROUP BY customer_state""",
    "rated_categories": """
        SELECT product_category_name, count(*) AS orders, sum(total_price) AS gmv,
               avg(review_score) AS avg_review_score, avg(is_bad_review) AS bad_review_rate,
               count(*) * avg(is_bad_review) AS bad_reviews,
               (SELECT avg(is_bad_review) FROM rated) AS global_bad_review_rate
        FROM rated GROUP BY product_category_name""",
    "rated_states": """
        SELECT customer_state, count(*) AS orders, avg(is_delayed) AS delay_rate,
               avg(review_score) AS avg_review_score, sum(total_price) AS gmv
        FROM came WHERE review_score IS NOT NULL GROUP BY customer_state""",
    "lanes": """
        SELECT seller_state, customer_state, count(*) AS orders, avg(is_delayed) AS delay_rate,
               avg(delivery_time_days) AS avg_delivery_time_days,
               avg(is_bad_review) AS bad_review_rate
        FROM came GROUP BY seller_state, customer_state""",
    "cut": """
        SELECT * FROM po
        WHERE product_category_name IN ('economy', 'large')
          AND customer_state IN ('NATION_1', 'NATION_2', 'NATION_3')
          AND seller_state IN ('NATION_9', 'NATION_11', 'NATION_15', 'NATION_20')
          AND main_payment_type IN ('credit_card', 'boleto')
          AND CAST(order_purchase_timestamp AS DATE) BETWEEN DATE '1996-03-05' AND DATE '2000-09-20'
        """,
    "cut_sellers": """
        SELECT * FROM ps
        WHERE product_category_name IN ('economy', 'large')
          AND customer_state IN ('NATION_1', 'NATION_2', 'NATION_3')
          AND seller_state IN ('NATION_9', 'NATION_11', 'NATION_15', 'NATION_20')
          AND CAST(order_purchase_timestamp AS DATE) BETWEEN DATE '1996-03-05' AND DATE '2000-09-20'
        """,
    "pairs": """
        SELECT freight_share AS x, review_score AS y FROM om
        WHERE freight_share IS NOT NULL AND review_score IS NOT NULL""",
}


def with_views(sql: str) -> str:
    """The query with a WITH clause of the views it reaches, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    clauses = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    return f"WITH {clauses}\n" + (", " + body[5:] if body.startswith("WITH ") else body)


def segment(column: str) -> str:
    measured = nums(
        gmv="sum(total_price)", aov="avg(total_price)", avg_review_score="avg(review_score)",
        bad_review_rate="avg(is_bad_review)", delay_rate="avg(is_delayed)",
        avg_delivery_time_days="avg(delivery_time_days)", avg_freight_share="avg(freight_share)",
    )
    return f"""SELECT {column}, count(*) AS orders, {measured}
               FROM om GROUP BY {column} HAVING count(*) >= 30"""


def kpi_columns(table: str, name=num) -> str:
    def of(expression: str) -> str:
        return f"coalesce({expression}, 0)"

    came = "FILTER (WHERE is_delivered = 1)"
    repeat = f"""(SELECT avg(CASE WHEN n > 1 THEN 1e0 ELSE 0 END) FROM
                  (SELECT count(*) AS n FROM {table} GROUP BY customer_unique_id))"""
    values = {
        "orders": "count(*)", "gmv": "sum(total_price)", "aov": "avg(total_price)",
        "avg_review_score": "avg(review_score)", "bad_review_rate": "avg(is_bad_review)",
        "delay_rate": f"avg(is_delayed) {came}",
        "avg_delivery_time_days": f"avg(delivery_time_days) {came}",
        "cancel_rate": "avg(is_cancelled)", "repeat_purchase_rate": repeat,
    }
    return ", ".join(name(of(expression), column) for column, expression in values.items())


KINDS = {
    "orders": "number", "gmv": "money", "aov": "number", "avg_review_score": "number",
    "bad_review_rate": "pct", "delay_rate": "pct", "avg_delivery_time_days": "number",
    "cancel_rate": "pct", "repeat_purchase_rate": "pct",
}


def kpi_delta() -> str:
    def plain(expression: str, name: str) -> str:
        return f"CAST({expression} AS DOUBLE) AS {name}"

    lines = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, '{kind}' AS kind, {nums(current=f's.{m}', base=f'w.{m}')}, "
        f"{num(f's.{m} - w.{m}', 'delta')} FROM s, w"
        for m, kind in KINDS.items()
    )
    return f"""WITH s AS (SELECT {kpi_columns('cut', plain)} FROM cut),
               w AS (SELECT {kpi_columns('po', plain)} FROM po) {lines}"""


def delay_buckets() -> str:
    low, high = wilson("sum(is_bad_review)", "count(is_bad_review)")
    return f"""
        SELECT l.bucket_id, delay_bucket, coalesce(orders, 0) AS orders,
               coalesce(reviewed_orders, 0) AS reviewed_orders, bad_review_rate,
               bad_review_rate_ci_low, bad_review_rate_ci_high, avg_review_score
        FROM (VALUES (0, 'Нет задержки'), (1, '1-3 дня'), (2, '4-7 дней'), (3, '8-14 дней'),
                     (4, '14+ дней')) l(bucket_id, delay_bucket)
        LEFT JOIN (
            SELECT bucket_id, count(*) AS orders, count(is_bad_review) AS reviewed_orders,
                   {nums(bad_review_rate="avg(is_bad_review)", bad_review_rate_ci_low=low,
                         bad_review_rate_ci_high=high, avg_review_score="avg(review_score)")}
            FROM buckets WHERE is_delivered = 1 AND bucket_id IS NOT NULL
            GROUP BY bucket_id) b USING (bucket_id)"""


def delay_stages() -> str:
    return f"""
        SELECT stage_id, CASE stage_id WHEN 0 THEN 'Поздняя передача продавцом'
                   WHEN 1 THEN 'Долгая транспортировка' WHEN 2 THEN 'Оба этапа'
                   ELSE 'Другое' END AS delay_stage,
               count(*) AS delayed_orders,
               {nums(share_of_delayed="count(*) / sum(count(*)) OVER ()",
                     avg_delay_days="avg(delay_days)", bad_review_rate="avg(is_bad_review)",
                     avg_review_score="avg(review_score) FILTER (WHERE is_bad_review IS NOT NULL)")}
        FROM (SELECT *, CASE WHEN seller_overrun_days > 0 AND transit_overrun_days > 0 THEN 2
                             WHEN seller_overrun_days > 0 THEN 0
                             WHEN transit_overrun_days > 0 THEN 1 ELSE 3 END AS stage_id
              FROM om WHERE is_delayed = 1 AND seller_overrun_days IS NOT NULL
                        AND transit_overrun_days IS NOT NULL)
        GROUP BY stage_id"""


def freight_bins() -> str:
    return f"""
        SELECT l.bin_id, freight_share_bin, coalesce(orders, 0) AS orders, avg_review_score,
               bad_review_rate, delay_rate, aov
        FROM (VALUES (0, '0-5%'), (1, '5-10%'), (2, '10-20%'), (3, '20-35%'), (4, '35-50%'),
                     (5, '50%+')) l(bin_id, freight_share_bin)
        LEFT JOIN (
            SELECT CASE WHEN freight_share <= 0.05 THEN 0 WHEN freight_share <= 0.1 THEN 1
                        WHEN freight_share <= 0.2 THEN 2 WHEN freight_share <= 0.35 THEN 3
                        WHEN freight_share <= 0.5 THEN 4 ELSE 5 END AS bin_id,
                   count(*) AS orders,
                   {nums(avg_review_score="avg(review_score)",
                         bad_review_rate="avg(is_bad_review)", delay_rate="avg(is_delayed)",
                         aov="avg(total_price)")}
            FROM om WHERE freight_share > -0.001 GROUP BY 1) b USING (bin_id)"""


def freight_quantile_bins() -> str:
    short = "round({0}, CAST(2 - floor(log10({0})) AS INTEGER))"
    lower = "CASE WHEN bin_id = 0 OR lo = 0 THEN 0 ELSE " + short.format("lo") + " END"
    return f"""
        WITH d AS (SELECT * FROM om
                   WHERE review_score IS NOT NULL AND freight_share >= 0),
        kept AS (SELECT * FROM d WHERE freight_share <= (
            SELECT quantile_cont(freight_share, 0.98) FROM d)),
        e AS (SELECT list_sort(list_distinct(quantile_cont(
            freight_share, [0, 1/6e0, 2/6e0, 3/6e0, 4/6e0, 5/6e0, 1]))) AS edges FROM kept),
        b AS (SELECT kept.*, greatest(len(list_filter(edges, lambda v: v < freight_share)), 1) - 1
                     AS bin_id, edges FROM kept, e),
        g AS (SELECT CAST(bin_id AS INTEGER) AS bin_id, any_value(edges[bin_id + 1]) AS lo,
                     any_value(edges[bin_id + 2]) AS hi, avg(review_score) AS s,
                     avg(is_bad_review) AS r, count(*) AS orders FROM b GROUP BY bin_id)
        SELECT bin_id, format('{{:.0f}}–{{:.0f}}%', ({lower}) * 100e0, {short.format('hi')} * 100e0)
                   AS bin_label,
               {nums(lower_edge="lo", upper_edge="hi", avg_review_score="s", bad_review_rate="r")},
               orders
        FROM g"""


def monthly_ma3() -> str:
    last3 = "OVER (ORDER BY order_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    return f"""
        SELECT order_month, orders,
               {nums(gmv="gmv", aov="aov", avg_review_score="s", bad_review_rate="b",
                     delay_rate="d", orders_ma3=f"avg(orders) {last3}",
                     gmv_ma3=f"avg(gmv) {last3}")}
        FROM (SELECT order_month, count(*) AS orders, sum(total_price) AS gmv,
                     avg(total_price) AS aov, avg(review_score) AS s, avg(is_bad_review) AS b,
                     avg(is_delayed) AS d FROM po GROUP BY order_month)"""


def monthly_peak_last() -> str:
    return f"""
        WITH m AS (SELECT order_month, count(*) AS orders, sum(total_price) AS gmv
                   FROM po GROUP BY order_month)
        SELECT first(order_month ORDER BY orders DESC, order_month) AS peak_orders_month,
               max(orders) AS peak_orders,
               first(order_month ORDER BY gmv DESC, order_month) AS peak_gmv_month,
               {num("max(gmv)", "peak_gmv")}, max(order_month) AS last_month,
               first(orders ORDER BY order_month DESC) AS last_orders,
               {num("first(gmv ORDER BY order_month DESC)", "last_gmv")} FROM m"""


def category_priority() -> str:
    return f"""
        SELECT product_category_name, orders,
               {nums(gmv="gmv", aov="aov", avg_review_score="s", bad_review_rate="b",
                     delay_rate="d", avg_delivery_time_days="t", bad_reviews="orders * b",
                     expected_bad_reviews="orders * base",
                     excess_bad_reviews="orders * b - orders * base",
                     business_priority_score="greatest(orders * b - orders * base, 0) * ln(1 + gmv)"
                     )}
        FROM (SELECT product_category_name, count(*) AS orders, sum(total_price) AS gmv,
                     avg(total_price) AS aov, avg(review_score) AS s, avg(is_bad_review) AS b,
                     avg(is_delayed) AS d, avg(delivery_time_days) AS t,
                     (SELECT avg(is_bad_review) FROM po) AS base
              FROM po GROUP BY product_category_name HAVING count(*) >= 50)"""


def exactly(check) -> str:
    with exact():
        return check()


def category_priority_chart() -> str:
    names = ("gmv aov avg_review_score bad_review_rate delay_rate avg_delivery_time_days "
             "bad_reviews expected_bad_reviews excess_bad_reviews business_priority_score "
             "overall_bad_review_rate median_orders").split()
    return f"""
        SELECT product_category_name, orders, {nums(**{name: name for name in names})},
               CAST(bad_review_rate > overall_bad_review_rate AS INTEGER) AS is_above_overall,
               CAST(place <= 3 AS INTEGER) AS is_named
        FROM (SELECT *, (SELECT avg(is_bad_review) FROM po) AS overall_bad_review_rate,
                     median(orders) OVER () AS median_orders,
                     row_number() OVER (ORDER BY business_priority_score DESC,
                                        product_category_name) AS place
              FROM ({exactly(category_priority)}))"""


def result_category_posthoc() -> str:
    names = "rate rate_ci_low rate_ci_high overall_rate rate_diff statistic".split()
    short = ", ".join(f"round_even({name}, 4) AS {name}" for name in names)
    with exact():
        tests = posthoc("product_category_name", "is_bad_review", "")
    tested = with_p(tests, "1", f"product_category_name, orders, direction, {', '.join(names)}")
    return f"""
        SELECT product_category_name, orders, direction, significant, {short}
        FROM ({tested})"""


def row_counts() -> str:
    sources = {
        "raw_customers": "customer", "raw_sellers": "supplier", "raw_products": "part",
        "raw_category_translation": "(SELECT DISTINCT p_type FROM part WHERE p_type <> 'SMALL')",
        "raw_order_items": "(SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
        "raw_orders": "orders", "raw_order_payments": "(SELECT * FROM r_payments)",
        "raw_order_reviews": "(SELECT * FROM r_reviews)",
    }
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", count(*) AS rows FROM {source}"""
        for name, source in sources.items()
    )


def seller_metrics(table: str, min_orders: int) -> str:
    return f"""
        SELECT seller_id, count(DISTINCT order_id) AS orders, max(seller_state) AS seller_state,
               {nums(gmv="sum(seller_price)", delay_rate="avg(is_delayed)",
                     late_handover_rate="avg(is_late_handover)",
                     bad_review_rate="avg(is_bad_review)", avg_review_score="avg(review_score)",
                     avg_handover_time_days="avg(handover_time_days)",
                     avg_transit_time_days="avg(transit_time_days)")}
        FROM {table} GROUP BY seller_id HAVING count(DISTINCT order_id) >= {min_orders}"""


def seller_vs_category(rows: str, min_orders: int) -> str:
    low, high = wilson("bad", "orders")
    return f"""
        SELECT p.product_category_name, seller_id,
               count(*) OVER (PARTITION BY p.product_category_name) AS n_sellers_in_category,
               orders,
               {nums(bad_review_rate="rate", bad_review_rate_ci_low=low,
                     bad_review_rate_ci_high=high, category_bad_review_rate="c.base",
                     bad_review_rate_diff="rate - c.base", delay_rate="d", late_handover_rate="h",
                     avg_review_score="s", avg_handover_time_days="ht",
                     avg_transit_time_days="tt")}
        FROM (SELECT product_category_name, seller_id, count(DISTINCT order_id) AS orders,
                     sum(is_bad_review) AS bad, avg(is_bad_review) AS rate, avg(is_delayed) AS d,
                     avg(is_late_handover) AS h, avg(review_score) AS s,
                     avg(handover_time_days) AS ht, avg(transit_time_days) AS tt
              FROM {rows} GROUP BY product_category_name, seller_id
              HAVING count(DISTINCT order_id) >= {min_orders}) p
             JOIN (SELECT product_category_name, avg(is_bad_review) AS base
                   FROM {rows} GROUP BY product_category_name) c USING (product_category_name)
        QUALIFY count(*) OVER (PARTITION BY p.product_category_name) >= 3"""


def top_category_sellers(top: int) -> str:
    return f"""
        SELECT product_category_name, seller_id, orders, rate, d, s FROM (
            SELECT *, dense_rank() OVER (ORDER BY volume DESC, product_category_name) AS place
            FROM (SELECT *, sum(orders) OVER (PARTITION BY product_category_name) AS volume
                  FROM (SELECT product_category_name, seller_id, count(*) AS orders,
                               avg(is_bad_review) AS rate, avg(is_delayed) AS d,
                               avg(review_score) AS s
                        FROM ps WHERE is_bad_review IS NOT NULL
                        GROUP BY product_category_name, seller_id HAVING count(*) >= 30)
                  QUALIFY count(*) OVER (PARTITION BY product_category_name) >= 3))
        WHERE place <= {top}"""


def top_states(by: str) -> str:
    return f"""
        SELECT customer_state, orders,
               {nums(delay_rate="delay_rate", avg_delivery_time_days="avg_delivery_time_days",
                     bad_review_rate="bad_review_rate")},
               CAST({by} >= (SELECT avg({'is_delayed' if by == 'delay_rate' else
                                        'delivery_time_days'}) FROM came) AS INTEGER)
                   AS is_above_global
        FROM (SELECT *, max(orders) OVER () AS most FROM states)
        WHERE orders >= 300 OR most < 300
        ORDER BY states_by DESC NULLS LAST, customer_state LIMIT 15""".replace("states_by", by)


def priority_categories(min_orders: int, top: int) -> str:
    return f"""
        WITH c AS (SELECT *, orders >= {min_orders} AND bad_review_rate >= global_bad_review_rate
                          AS chosen FROM rated_categories)
        SELECT product_category_name, orders,
               {nums(gmv="gmv", avg_review_score="avg_review_score",
                     bad_review_rate="bad_review_rate", bad_reviews="bad_reviews",
                     global_bad_review_rate="global_bad_review_rate")}
        FROM c WHERE chosen OR NOT (SELECT bool_or(chosen) FROM c)
        ORDER BY c.bad_reviews DESC, product_category_name LIMIT {top}"""


def category_impact() -> str:
    return f"""
        WITH c AS (SELECT *, max(orders) OVER () AS most FROM rated_categories)
        SELECT product_category_name, orders,
               {nums(gmv="gmv", bad_review_rate="bad_review_rate", bad_reviews="bad_reviews",
                     global_bad_review_rate="global_bad_review_rate",
                     median_orders="median(orders) OVER ()",
                     relative_gmv="gmv / max(gmv) OVER ()")},
               CAST(bad_review_rate >= global_bad_review_rate AS INTEGER) AS is_above_global,
               CASE WHEN row_number() OVER (
                   ORDER BY c.bad_reviews DESC, product_category_name) <= 3
                   THEN 1 ELSE 0 END AS is_named
        FROM c WHERE orders >= 300 OR most < 300"""


def state_experience() -> str:
    return f"""
        SELECT customer_state, orders,
               {nums(delay_rate="delay_rate", avg_review_score="avg_review_score", gmv="gmv",
                     relative_orders="orders / max(orders) OVER ()")},
               CAST(delay_rate >= d AND avg_review_score <= s AS INTEGER) AS is_worse_on_both,
               CASE WHEN row_number() OVER (ORDER BY orders DESC, customer_state) <= 12
                    THEN 1 ELSE 0 END AS is_named
        FROM (SELECT *, max(orders) OVER () AS most FROM rated_states),
             (SELECT avg(is_delayed) AS d, avg(review_score) AS s FROM came
              WHERE review_score IS NOT NULL)
        WHERE orders >= 300 OR most < 300"""


def groups(columns: str) -> str:
    return f"""is_delayed AS group_id,
        CASE is_delayed WHEN 1 THEN 'С задержкой' ELSE 'Без задержки' END AS delay_group, {columns}"""


def stage_decomposition(table: str) -> str:
    return f"""
        SELECT late AS group_id,
               CASE late WHEN 1 THEN 'С задержкой' ELSE 'Без задержки' END AS delay_group,
               {nums(handover="avg(handover_time_days)", transit="avg(transit_time_days)")},
               count(DISTINCT order_id) AS orders
        FROM (SELECT *, CASE WHEN is_delayed = 1 THEN 1 ELSE 0 END AS late
              FROM {table} WHERE is_delivered = 1) GROUP BY late"""


def cells_chi_square(groups_sql: str, columns: str) -> str:
    """Chi-square over explicit cells: observed against expected, corrected at one degree."""
    return f"""
        WITH g AS ({groups_sql}),
        t AS (SELECT sum(n) * 1e0 AS total, sum(hits) * 1e0 AS bad, count(*) AS k FROM g),
        c AS (SELECT hits * 1e0 AS o, n * bad / total AS e, k FROM g, t
              UNION ALL SELECT n - hits, n * (total - bad) / total, k FROM g, t),
        x AS (SELECT sum(power(abs(o - e) - CASE WHEN k = 2 THEN least(0.5, abs(o - e)) ELSE 0 END,
                               2) / e) AS chi2 FROM c)
        SELECT {columns} FROM x, t"""


def two_groups(group: str) -> str:
    def of(which: int, what: int) -> str:
        bounds = wilson(
            f"(SELECT hits FROM g WHERE side = {which})", f"(SELECT n FROM g WHERE side = {which})"
        )
        if what == 0:
            return f"(SELECT hits / n FROM g WHERE side = {which})"
        return bounds[what - 1]

    columns = big("total", "n_observations") + ", " + nums(
        statistic="chi2", dof="1", effect_size="sqrt(chi2 / total)",
        **{
            f"{name}_{which}": of(which, what)
            for which in (1, 0)
            for what, name in enumerate(("rate", "ci_low", "ci_high"))
        },
    )
    counts = f"""SELECT {group} AS side, count(*) AS n, sum(is_bad_review) AS hits FROM om
                 WHERE {group} IS NOT NULL AND is_bad_review IS NOT NULL GROUP BY {group}"""
    return cells_chi_square(counts, columns)


def many_groups(group: str, outcome: str) -> str:
    columns = f"t.k AS n_groups, {big('total', 'n_observations')}, " + nums(
        statistic="chi2", dof="t.k - 1", effect_size="sqrt(chi2 / total)"
    )
    return cells_chi_square(
        f"""SELECT {group}, count(*) AS n, sum({outcome}) AS hits FROM om
            WHERE {outcome} IS NOT NULL AND {group} IS NOT NULL
            GROUP BY {group} HAVING count(*) >= 30""",
        columns,
    )


def rank_sum() -> str:
    def mean_bounds(i: int) -> dict[str, str]:
        half = f"{Z} * sd{i} / sqrt(n{i})"
        return {f"mean_{i}": f"m{i}", f"ci_low_{i}": f"m{i} - {half}",
                f"ci_high_{i}": f"m{i} + {half}"}

    return f"""
        WITH s AS (SELECT review_score AS v, is_delayed AS late FROM om
                   WHERE is_delayed IS NOT NULL AND review_score IS NOT NULL),
        r AS (SELECT v, late, rank() OVER (ORDER BY v)
                     + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS r FROM s),
        a AS (SELECT count(*) FILTER (WHERE late = 1) AS n1,
                     count(*) FILTER (WHERE late = 0) AS n2,
                     sum(r) FILTER (WHERE late = 1) AS ranks,
                     avg(v) FILTER (WHERE late = 1) AS m1, avg(v) FILTER (WHERE late = 0) AS m2,
                     stddev_samp(v) FILTER (WHERE late = 1) AS sd1,
                     stddev_samp(v) FILTER (WHERE late = 0) AS sd2 FROM r),
        ties AS (SELECT sum(power(c, 3) - c) AS tie
                 FROM (SELECT count(*) * 1e0 AS c FROM s GROUP BY v)),
        u AS (SELECT *, ranks - n1 * (n1 + 1) / 2e0 AS u, n1 + n2 AS n FROM a, ties)
        SELECT n1, n2, n AS n_observations,
               {nums(statistic="u",
                     z='''greatest(greatest(u, n1 * n2 - u) - n1 * n2 / 2e0 - 0.5, 0)
                          / sqrt(n1 * n2 / 12e0 * (n + 1 - tie / (n * (n - 1e0))))''',
                     effect_size="1 - 2 * u / (n1 * n2)", **mean_bounds(1), **mean_bounds(2))}
        FROM u"""


def rank_sum_slices(by: str) -> str:
    """The test in each slice; its exact law by listing every choice of n1 among n places."""
    normal = tail("normal", "z", "")
    known = " AND ".join(f"{name} IS NOT NULL" for name in by.split(", "))
    return f"""
        WITH s AS (SELECT {by}, review_score AS v, is_delayed AS late FROM om
                   WHERE is_delayed IS NOT NULL AND review_score IS NOT NULL AND {known}),
        r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY v)
                        + (count(*) OVER (PARTITION BY {by}, v) - 1) / 2e0 AS r,
                     count(*) OVER (PARTITION BY {by}, v) AS c FROM s),
        a AS (SELECT {by}, count(*) FILTER (WHERE late = 1) AS n1,
                     count(*) FILTER (WHERE late = 0) AS n2, count(*) AS n,
                     sum(r) FILTER (WHERE late = 1) AS ranks,
                     avg(v) FILTER (WHERE late = 1) AS m1, avg(v) FILTER (WHERE late = 0) AS m2,
                     sum(c * c - 1e0) AS tie FROM r GROUP BY {by}),
        u AS (SELECT *, ranks - n1 * (n1 + 1) / 2e0 AS u, tie = 0 AND least(n1, n2) <= 8 AS exact
              FROM a WHERE n1 > 0 AND n2 > 0),
        z AS (SELECT *, coalesce(greatest(greatest(u, n1 * n2 - u) - n1 * n2 / 2e0 - 0.5, 0)
                  / nullif(sqrt(n1 * n2 / 12e0 * (n + 1 - tie / (n * (n - 1e0)))), 0), 0) AS z
              FROM u),
        masks AS (SELECT m, bit_count(m) AS ones, list_sum(list_transform(range(12), lambda i:
                         ((m >> i) & 1) * (i + 1))) AS places FROM range(4096) t(m)),
        law AS (SELECT n, n1, places - n1 * (n1 + 1) // 2 AS value
                FROM (SELECT DISTINCT n, n1 FROM z WHERE exact) k
                     JOIN masks ON ones = n1 AND m < power(2, n)),
        p AS (SELECT {by}, 2e0 * count(*) FILTER (WHERE value >= greatest(u, n1 * n2 - u))
                           / count(*) AS p FROM z JOIN law USING (n, n1) WHERE exact GROUP BY {by})
        SELECT {by}, n1, n2, n AS n_observations, exact AS is_exact,
               {nums(mean_1="m1", mean_2="m2", statistic="u", z="z",
                     effect_size="1 - 2 * u / (n1 * n2)",
                     p_value=f"CASE WHEN exact THEN least(p, 1) ELSE {normal} END")}
        FROM z LEFT JOIN p USING ({by})"""


def spearman() -> str:
    def rank(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0"

    return f"""
        WITH r AS (SELECT {rank('x')} AS rx, {rank('y')} AS ry FROM pairs),
        c AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM r)
        SELECT n AS n_observations,
               {nums(rho="rho", ci_low=f"tanh(atanh(rho) - {Z} / sqrt(n - 3))",
                     ci_high=f"tanh(atanh(rho) + {Z} / sqrt(n - 3))",
                     t="rho * sqrt((n - 2) / ((1 + rho) * (1 - rho)))", dof="n - 2")}
        FROM c"""


def trend() -> str:
    def rank(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0"

    return f"""
        WITH d AS (SELECT bucket_id * 1e0 AS s, is_bad_review * 1e0 AS bad FROM buckets
                   WHERE is_delivered = 1 AND bucket_id IS NOT NULL AND is_bad_review IS NOT NULL),
        p AS (SELECT avg(bad) AS p, count(*) AS n, avg(s) AS mean_s FROM d),
        z AS (SELECT sum(s * (bad - p)) / sqrt(any_value(p * (1 - p)) * sum(power(s - mean_s, 2)))
                     AS z FROM d, p),
        r AS (SELECT corr({'rs'}, {'rb'}) AS rho FROM (
              SELECT {rank('s')} AS rs, {rank('bad')} AS rb FROM d))
        SELECT n AS n_observations,
               {nums(z="z", rate_first="(SELECT avg(bad) FROM d WHERE s = 0)",
                     rate_last="(SELECT avg(bad) FROM d WHERE s = 4)", rho="rho")}
        FROM p, z, r"""


def posthoc(group: str, outcome: str, extra: str) -> str:
    low, high = wilson("hits", "n")
    expected = {
        "hits": "n * bad / total", "n - hits": "n * (total - bad) / total",
        "bad - hits": "(total - n) * bad / total",
        "total - n - bad + hits": "(total - n) * (total - bad) / total",
    }
    chi2 = " + ".join(
        f"power(abs(({o}) - {e}) - least(0.5, abs(({o}) - {e})), 2) / ({e})"
        for o, e in expected.items()
    )
    return f"""
        WITH g AS (SELECT {group}, count(*) * 1e0 AS n, sum({outcome}) * 1e0 AS hits FROM om
                   WHERE {outcome} IS NOT NULL {extra} GROUP BY {group}),
        t AS (SELECT sum(n) AS total, sum(hits) AS bad FROM g)
        SELECT {group}, {big('n', 'orders')},
               {nums(rate="hits / n", rate_ci_low=low, rate_ci_high=high,
                     overall_rate="bad / total", rate_diff="hits / n - bad / total",
                     statistic=chi2)},
               CASE WHEN hits / n > bad / total THEN 'выше среднего' ELSE 'ниже среднего' END
                   AS direction
        FROM g, t WHERE {group} IS NOT NULL AND n >= 100"""


def heterogeneity(rows: str, min_orders: int) -> str:
    return f"""
        WITH g AS (SELECT product_category_name AS c, seller_id, count(*) * 1e0 AS n,
                          sum(is_bad_review) * 1e0 AS hits FROM {rows}
                   GROUP BY product_category_name, seller_id HAVING count(*) >= {min_orders}),
        t AS (SELECT c, sum(n) AS total, sum(hits) AS bad, count(*) AS k, min(hits / n) AS lo,
                     max(hits / n) AS hi FROM g GROUP BY c),
        x AS (SELECT c, total, bad, k, lo, hi,
                     sum(power(hits - n * bad / total, 2) / (n * bad / total)
                         + power(n - hits - n * (total - bad) / total, 2)
                           / (n * (total - bad) / total)) AS chi2
              FROM g JOIN t USING (c) WHERE k >= 3 AND bad > 0 AND bad < total GROUP BY ALL),
        v AS (SELECT *, sqrt(chi2 / total) AS v FROM x)
        SELECT c AS product_category_name, k AS n_sellers, {big('total', 'n_observations')},
               {nums(category_bad_review_rate="bad / total", min_seller_bad_review_rate="lo",
                     max_seller_bad_review_rate="hi", statistic="chi2", effect_size="v",
                     dof="k - 1")},
               'Cramér''s V' AS effect_size_name,
               CASE WHEN v < 0.1 THEN 'незначимый' WHEN v < 0.3 THEN 'слабый'
                    WHEN v < 0.5 THEN 'умеренный' ELSE 'сильный' END AS effect_magnitude
        FROM v"""


def integral(density: str, start: str, width: str, steps: int = 4000) -> str:
    """Simpson's rule for a density, written over @, on [start, start + width]."""
    at = density.replace("@", f"(({start}) + i * ({width}) / {steps}e0)")
    return f"""(({width}) / {3 * steps}e0 * list_sum(list_transform(range({steps + 1}), lambda i:
        (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({at}))))"""


def tail(kind: str, statistic: str, dof: str) -> str:
    """p-value by integrating the density of chi, of Student's t or of the normal."""
    if kind == "chi":
        start = f"sqrt({statistic})"
        log = f"""(1 - ({dof}) / 2e0) * ln(2e0) + (({dof}) - 1) * ln(greatest(@, 1e-300))
                  - @ * @ / 2 - lgamma(({dof}) / 2e0)"""
        return integral(f"exp({log})", start,
                        f"greatest(sqrt({dof}) + 12 - {start}, 12)")
    if kind == "t":
        log = f"""lgamma((({dof}) + 1) / 2e0) - lgamma(({dof}) / 2e0) - ln(({dof}) * pi()) / 2
                  - (({dof}) + 1) / 2e0 * ln(1 + @ * @ / ({dof}))"""
        return "2 * " + integral(f"exp({log})", f"abs({statistic})", "20")
    return "2 * " + integral("exp(-@ * @ / 2) / sqrt(2 * pi())", f"abs({statistic})", "12")


def adjusted(tests: str, columns: str) -> str:
    """Benjamini-Hochberg over rows with p: the smallest scaled p among those at least as large."""
    return f"""
        WITH tests AS ({tests}),
        ranked AS (SELECT *, p * count(p) OVER () / row_number() OVER (ORDER BY p) AS scaled
                   FROM tests),
        done AS (SELECT *, least(1, min(scaled) OVER (ORDER BY p DESC
                     RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj FROM ranked)
        SELECT {columns} FROM done"""


def p_columns() -> str:
    return f"{nums(p_value='p', p_value_adjusted='p_adj')}, p_adj < 0.05 AS significant"


def with_p(tests: str, dof: str, columns: str) -> str:
    return adjusted(f"SELECT *, {tail('chi', 'statistic', dof)} AS p FROM ({tests})",
                    f"{columns}, {p_columns()}")


def magnitude(effect: str) -> str:
    return f"""CASE WHEN abs({effect}) < 0.1 THEN 'незначимый' WHEN abs({effect}) < 0.3 THEN 'слабый'
                    WHEN abs({effect}) < 0.5 THEN 'умеренный' ELSE 'сильный' END"""


def posthoc_with_p(group: str, outcome: str, extra: str) -> str:
    with exact():
        tests = posthoc(group, outcome, extra)
    names = "rate rate_ci_low rate_ci_high overall_rate rate_diff statistic".split()
    return with_p(tests, "1", f"{group}, orders, direction, " + nums(**{c: c for c in names}))


def heterogeneity_with_p(rows: str, min_orders: int) -> str:
    with exact():
        tests = heterogeneity(rows, min_orders)
    names = ("category_bad_review_rate min_seller_bad_review_rate max_seller_bad_review_rate "
             "statistic effect_size dof").split()
    return with_p(tests, "dof", "product_category_name, n_sellers, n_observations, "
                  "effect_size_name, effect_magnitude, " + nums(**{c: c for c in names}))


def hypothesis_table(rows: str, min_orders: int, population: str) -> str:
    """All hypotheses from the single checks, with p by integration."""
    with exact():
        late, handover = two_groups("is_delayed"), two_groups("is_late_handover")
        category = many_groups("product_category_name", "is_bad_review")
        state = many_groups("customer_state", "is_delayed")
        scores, freight, months = rank_sum(), spearman(), trend()
        sellers = heterogeneity(rows, min_orders)
    chi = ("chi-square test of independence", "Cramér''s V")
    pair = ("rate_1", "ci_low_1", "ci_high_1", "rate_0", "ci_low_0", "ci_high_0")
    many = ("n_groups", "NULL", "NULL", "30", "NULL", "NULL")
    focal = f"""SELECT product_category_name, n_sellers, n_observations, {", ".join(
        f"round({c}, 6) AS {c}" for c in ("category_bad_review_rate", "min_seller_bad_review_rate",
        "max_seller_bad_review_rate", "statistic", "effect_size"))},
        round({tail("chi", "statistic", "dof")}, 6) AS known_p
        FROM ({sellers}) ORDER BY n_observations DESC, product_category_name LIMIT 1"""
    # statement, scope, metrics, test and effect names, values, statistic, effect, p, source
    rows = [
        ("H1: доля плохих отзывов зависит от факта задержки доставки",
         "'доставленные заказы с отзывом'", "bad_review_rate_delayed",
         "bad_review_rate_not_delayed", *chi, pair, "statistic", "effect_size",
         tail("chi", "statistic", "1"), late),
        ("H2: оценки заказов с задержкой отличаются от оценок заказов без задержки",
         "'доставленные заказы с отзывом'", "mean_review_delayed", "mean_review_not_delayed",
         "Mann-Whitney U test", "rank-biserial correlation",
         ("mean_1", "ci_low_1", "ci_high_1", "mean_2", "ci_low_2", "ci_high_2"),
         "statistic", "effect_size", tail("normal", "z", ""), scores),
        ("H3: доля доставки в стоимости заказа связана с оценкой",
         "'заказы с отзывом и известной долей доставки'", "spearman_rho", "n_observations",
         "Spearman correlation", "Spearman rho",
         ("rho", "ci_low", "ci_high", "n_observations", "NULL", "NULL"), "rho", "rho",
         tail("t", "t", "dof"), freight),
        ("H4: категории товаров различаются по доле плохих отзывов",
         "'заказы с отзывом, категории с >= 30 заказами'", "n_categories",
         "min_orders_per_category", *chi, many, "statistic", "effect_size",
         tail("chi", "statistic", "dof"), category),
        ("H5: регионы покупателей различаются по доле задержанных доставок",
         "'доставленные заказы, регионы с >= 30 заказами'", "n_states", "min_orders_per_state",
         *chi, many, "statistic", "effect_size", tail("chi", "statistic", "dof"), state),
        ("H7: поздняя передача перевозчику (зона продавца) связана с плохим отзывом",
         "'заказы с отзывом и известным фактом просрочки отгрузки'",
         "bad_review_rate_late_handover", "bad_review_rate_on_time_handover", *chi, pair,
         "statistic", "effect_size", tail("chi", "statistic", "1"), handover),
        ("H8: вероятность плохого отзыва растёт с длительностью задержки",
         "'доставленные заказы с отзывом, по корзинам длительности задержки'",
         "bad_review_rate_no_delay", "bad_review_rate_14plus", "Cochran-Armitage trend test",
         "Spearman rho (корзина vs плохой отзыв)",
         ("rate_first", "NULL", "NULL", "rate_last", "NULL", "NULL"), "z", "rho",
         tail("normal", "z", ""), months),
        ("H6: внутри категории продавцы различаются по доле плохих отзывов",
         f"'{population} с отзывом, фокусная категория ' || product_category_name "
         f"|| ' (>= {min_orders} заказов на продавца)'", "n_sellers", "category_bad_review_rate", *chi,
         ("n_sellers", "NULL", "NULL", "category_bad_review_rate", "min_seller_bad_review_rate",
          "max_seller_bad_review_rate"), "statistic", "effect_size", "known_p", focal),
    ]
    ends = ("value_1", "ci_low_1", "ci_high_1", "value_2", "ci_low_2", "ci_high_2")
    parts = []
    for statement, scope, one, two, test, effect_name, values, stat, effect, p, source in rows:
        numbers = ", ".join(f"CAST({v} AS DOUBLE) AS {e}" for v, e in zip(values, ends))
        parts.append(f"""
            SELECT '{statement}' AS hypothesis, '{test}' AS test, {scope} AS scope,
                   '{one}' AS metric_1, '{two}' AS metric_2, {numbers},
                   CAST(n_observations AS BIGINT) AS n_observations,
                   CAST({stat} AS DOUBLE) AS statistic, '{effect_name}' AS effect_size_name,
                   CAST({effect} AS DOUBLE) AS effect_size, {p} AS p FROM ({source})""")
    doubles = ", ".join(num(c, c) for c in (*ends, "statistic", "effect_size"))
    return adjusted(" UNION ALL ".join(parts), f"""
        hypothesis, test, scope, metric_1, metric_2, n_observations, effect_size_name, {doubles},
        {magnitude('effect_size')} AS effect_magnitude, {p_columns()},
        'После поправки BH: статистически ' || CASE WHEN p_adj < 0.05 THEN '' ELSE 'не' END
            || 'значимо (p_adj=' || format('{{:.4g}}', p_adj) || '); эффект '
            || {magnitude('effect_size')} || ' (' || effect_size_name || '='
            || format('{{:.3g}}', effect_size) || ')' AS interpretation""")


def slice_values() -> str:
    fields = ("product_category_name", "customer_state", "seller_state", "main_payment_type")
    return " UNION ALL ".join(
        f"SELECT DISTINCT '{name}' AS field, {name} AS value FROM po" for name in fields
    )


def lane_square() -> str:
    measured = nums(
        delay_rate="delay_rate", avg_delivery_time_days="coalesce(avg_delivery_time_days, 0)"
    )
    return f"""WITH axis AS (SELECT seller_state AS state FROM lanes
                             UNION SELECT customer_state FROM lanes)
               SELECT a.state AS seller_state, b.state AS customer_state,
                      coalesce(orders, 0) AS orders, {measured}
               FROM axis a CROSS JOIN axis b LEFT JOIN lanes
                    ON a.state = lanes.seller_state AND b.state = lanes.customer_state"""


ROUNDED_MART = {
    "om": "total_price total_freight payment_value review_score delivery_time_days "
    "estimated_delivery_time_days delay_days freight_share approval_time_days handover_time_days "
    "transit_time_days seller_overrun_days transit_overrun_days",
    "os": "seller_price seller_freight delivery_time_days handover_time_days transit_time_days "
    "review_score",
    "sm": "gmv freight delivered_rate delay_rate bad_review_rate avg_review_score review_coverage "
    "avg_delivery_time_days avg_handover_time_days avg_transit_time_days late_handover_rate",
}


def mart(name: str) -> str:
    columns = ", ".join(num(column, column) for column in ROUNDED_MART[name].split())
    return f"SELECT * REPLACE ({columns}) FROM {name}"


def seller_ranking() -> str:
    measured = nums(**{c: c for c in (
        "gmv delay_rate late_handover_rate bad_review_rate avg_review_score review_coverage "
        "avg_delivery_time_days avg_handover_time_days avg_transit_time_days").split()})
    return f"""SELECT seller_id, seller_state, top_category, orders, items, single_seller_orders,
                      distinct_categories, {measured} FROM sm WHERE orders >= 30"""


# Result table -> its check and the doubles it holds, which are rounded half to even when written.
_SEGMENT = ("gmv aov avg_review_score bad_review_rate delay_rate avg_delivery_time_days "
            "avg_freight_share")
_POSTHOC = "rate rate_ci_low rate_ci_high overall_rate rate_diff statistic"
_P = "p_value p_value_adjusted"


def saved_results() -> dict[str, str]:
    with exact():
        checks = queries_sql()
        compared = seller_vs_category("sold_single", 30)
        tested = heterogeneity_with_p("sold_single", 30)
        table = hypothesis_table("sold_single", 30, "single-seller заказы")

    def written(sql: str, names: str, places: int = 4, drop: str = "", **other: int) -> str:
        short = ", ".join(
            f"round_even(round({name}, 10), {other.get(name, places)}) AS {name}"
            for name in names.split()
        )
        left_out = f"EXCLUDE ({drop})" if drop else ""
        return f"SELECT * {left_out} REPLACE ({short}) FROM ({sql})"

    def posthoc_written(sql: str) -> str:
        return written(written(sql, _POSTHOC), _P, 6)

    return {
        "metrics_summary": written(checks["summary_metrics"], (
            f"{_SEGMENT} review_coverage avg_delay_days cancelled_rate repeat_purchase_rate")),
        "category_metrics": written(checks["segment_category"], _SEGMENT),
        "customer_state_metrics": written(checks["segment_customer_state"], _SEGMENT),
        "seller_state_metrics": written(checks["segment_seller_state"], _SEGMENT),
        "monthly_metrics": written(
            checks["monthly_metrics"], _SEGMENT.replace(" avg_freight_share", "")),
        "delay_bucket_metrics": written(checks["delay_buckets"], (
            "bad_review_rate bad_review_rate_ci_low bad_review_rate_ci_high avg_review_score"),
            drop="bucket_id"),
        "delay_stage_breakdown": written(checks["delay_stages"], (
            "share_of_delayed avg_delay_days bad_review_rate avg_review_score"),
            drop="stage_id", avg_delay_days=2),
        "seller_metrics": written(checks["seller_ranking"], (
            "gmv delay_rate late_handover_rate bad_review_rate avg_review_score review_coverage "
            "avg_delivery_time_days avg_handover_time_days avg_transit_time_days")),
        "seller_category_comparison": written(compared, (
            "bad_review_rate bad_review_rate_ci_low bad_review_rate_ci_high "
            "category_bad_review_rate bad_review_rate_diff delay_rate late_handover_rate "
            "avg_review_score avg_handover_time_days avg_transit_time_days")),
        "category_posthoc": posthoc_written(checks["posthoc_category"]),
        "state_posthoc": posthoc_written(checks["posthoc_state"]),
        "seller_within_category_tests": written(tested, (
            "category_bad_review_rate min_seller_bad_review_rate max_seller_bad_review_rate "
            f"statistic effect_size {_P}"), 6, drop="dof"),
        "hypothesis_tests": written(table, (
            "value_1 ci_low_1 ci_high_1 value_2 ci_low_2 ci_high_2 statistic effect_size "
            f"{_P}"), 6),
    }


def queries_sql() -> dict[str, str]:
    score_share = num("count(*) / sum(count(*)) OVER ()", "share")
    return {
        "order_items_agg": f"""
            SELECT order_id, items AS order_item_count, products AS distinct_products,
                   sellers AS distinct_sellers, categories AS distinct_categories,
                   {nums(total_price="price", total_freight="freight")},
                   limit_date AS max_shipping_limit_date, category AS product_category_name,
                   seller_id AS main_seller_id, seller_state, mixed AS is_mixed_category
            FROM items_agg""",
        "payments_agg": f"""
            SELECT order_id, {num("paid", "payment_value")}, {big("payments", "payment_count")},
                   installments AS max_installments, payment_type AS main_payment_type
            FROM pay_agg""",
        "reviews_agg": f"""
            SELECT order_id, {num("score", "review_score")}, low AS min_review_score,
                   reviews AS review_count, bad AS is_bad_review FROM rev_agg""",
        "orders_mart": mart("om"),
        "order_seller": mart("os"),
        "seller_mart": mart("sm"),
        "summary_metrics": f"""
            SELECT count(*) AS total_orders, {big("sum(is_delivered)", "delivered_orders")},
                   {big("sum(is_cancelled)", "cancelled_orders")},
                   {big("count(*) FILTER (WHERE review_count > 0)", "reviewed_orders")},
                   {nums(review_coverage="avg(has_review)", gmv="sum(total_price)",
                         aov="avg(total_price)", avg_review_score="avg(review_score)",
                         bad_review_rate="avg(is_bad_review)",
                         delay_rate="avg(is_delayed) FILTER (WHERE is_delivered = 1)",
                         avg_delivery_time_days="avg(delivery_time_days)",
                         avg_delay_days="avg(delay_days)", cancelled_rate="avg(is_cancelled)",
                         avg_freight_share="avg(freight_share)",
                         repeat_purchase_rate='''(SELECT avg(CASE WHEN n > 1 THEN 1e0 ELSE 0 END)
                             FROM (SELECT count(*) AS n FROM om GROUP BY customer_unique_id))''')}
            FROM om""",
        "monthly_metrics": f"""
            SELECT order_year_month, count(*) AS orders,
                   {nums(gmv="sum(total_price)", aov="avg(total_price)",
                         avg_review_score="avg(review_score)",
                         bad_review_rate="avg(is_bad_review)", delay_rate="avg(is_delayed)",
                         avg_delivery_time_days="avg(delivery_time_days)")}
            FROM om GROUP BY order_year_month""",
        "segment_category": segment("product_category_name"),
        "segment_customer_state": segment("customer_state"),
        "segment_seller_state": segment("seller_state"),
        "payment_metrics": f"""
            SELECT main_payment_type, count(*) AS orders,
                   {nums(gmv="sum(total_price)", aov="avg(total_price)",
                         avg_review_score="avg(review_score)",
                         bad_review_rate="avg(is_bad_review)")}
            FROM po GROUP BY main_payment_type""",
        "state_metrics": f"""
            SELECT customer_state, count(*) AS orders,
                   {nums(gmv="sum(total_price)", avg_review_score="avg(review_score)",
                         bad_review_rate="avg(is_bad_review)", delay_rate="avg(is_delayed)",
                         avg_delivery_time_days="avg(delivery_time_days)",
                         avg_delay_days="avg(delay_days)")}
            FROM came GROUP BY customer_state HAVING count(*) >= 50""",
        "category_priority": category_priority(),
        "top_category_risk": category_priority()
        + " ORDER BY business_priority_score DESC, product_category_name LIMIT 5",
        "delay_buckets": delay_buckets(),
        "delay_stages": delay_stages(),
        "freight_bins": freight_bins(),
        "freight_quantile_bins": freight_quantile_bins(),
        "monthly_ma3": monthly_ma3(),
        "monthly_peak_last": monthly_peak_last(),
        "seller_ranking": seller_ranking(),
        "seller_metrics": seller_metrics("ps", 30),
        "seller_vs_category": seller_vs_category("sold_multi", 30),
        "seller_vs_category_single": seller_vs_category("sold_single", 3),
        "seller_top_categories": f"""
            SELECT product_category_name, seller_id, orders,
                   {nums(bad_review_rate="rate", delay_rate="d", avg_review_score="s")}
            FROM ({top_category_sellers(3)})""",
        "seller_category_spread": f"""
            SELECT product_category_name,
                   {nums(q1="quantile_cont(rate, 0.25)", median="quantile_cont(rate, 0.5)",
                         q3="quantile_cont(rate, 0.75)", lowest="min(rate)",
                         highest="max(rate)")}, count(*) AS sellers
            FROM ({top_category_sellers(6)}) GROUP BY product_category_name""",
        "prepared_orders": """
            SELECT order_id, product_category_name, customer_state, seller_state,
                   main_payment_type, order_month,
                   CASE is_bad_review WHEN 1 THEN 'Плохой отзыв' WHEN 0 THEN 'Не плохой отзыв'
                        ELSE 'Без отзыва' END AS bad_review_label,
                   is_bad_review AS bad_review_flag,
                   CASE is_delayed WHEN 1 THEN 'С задержкой' WHEN 0 THEN 'Без задержки'
                        ELSE 'Не доставлено' END AS delay_group,
                   CASE is_delivered WHEN 1 THEN 'Доставлен' ELSE 'Не доставлен' END
                       AS delivered_group
            FROM po""",
        "score_distribution": """
            SELECT s.review_score, coalesce(orders, 0) AS orders, coalesce(share, 0) AS share
            FROM (VALUES (1), (2), (3), (4), (5)) s(review_score) LEFT JOIN (
                SELECT CAST(trunc(review_score) AS INTEGER) AS review_score, count(*) AS orders,
                       SHARE FROM rated GROUP BY 1) d USING (review_score)""".replace(
            "SHARE", score_share),
        "score_distribution_observed": f"""
            SELECT CAST(trunc(review_score) AS INTEGER) AS review_score, count(*) AS orders,
                   {score_share} FROM rated GROUP BY 1""",
        "delay_groups": "SELECT " + groups(
            nums(avg_review_score="avg(review_score)", bad_review_rate="avg(is_bad_review)")
            + ", count(*) AS orders"
        ) + " FROM rated WHERE is_delayed IS NOT NULL GROUP BY is_delayed",
        "delay_group_profile": "SELECT " + groups(
            nums(avg_review_score="avg(review_score)", bad_review_rate="avg(is_bad_review)",
                 avg_delivery_time_days="avg(delivery_time_days)") + ", count(*) AS orders"
        ) + " FROM po WHERE is_delayed IS NOT NULL GROUP BY is_delayed",
        "delay_group_gap": f"""
            SELECT {nums(score_gap="l.s - o.s", bad_review_lift="l.b / o.b - 1")}
            FROM (SELECT avg(review_score) AS s, avg(is_bad_review) AS b
                  FROM rated WHERE is_delayed = 1) l,
                 (SELECT avg(review_score) AS s, avg(is_bad_review) AS b
                  FROM rated WHERE is_delayed = 0) o""",
        "priority_categories": priority_categories(300, 15),
        "priority_categories_fallback": priority_categories(10**12, 4),
        "state_top_delay": top_states("delay_rate"),
        "state_top_time": top_states("avg_delivery_time_days"),
        "category_impact": category_impact(),
        "state_experience": state_experience(),
        "lane_matrix": f"""
            SELECT seller_state, customer_state, orders,
                   {nums(delay_rate="delay_rate", avg_delivery_time_days="avg_delivery_time_days",
                         bad_review_rate="bad_review_rate")}
            FROM lanes WHERE orders >= 30""",
        "lane_states": """
            SELECT seller_state AS state FROM lanes WHERE orders >= 30
            UNION SELECT customer_state FROM lanes WHERE orders >= 30""",
        "lane_square": lane_square(),
        "stage_decomposition": stage_decomposition("po"),
        "stage_decomposition_sellers": stage_decomposition("ps"),
        "kpi_summary": f"SELECT {kpi_columns('po')} FROM po",
        "kpi_slice": f"SELECT {kpi_columns('cut')} FROM cut",
        "kpi_delta": kpi_delta(),
        "slice_sellers": seller_metrics("cut_sellers", 5),
        "slice_values": slice_values(),
        "slice_period": """
            SELECT CAST(min(order_purchase_timestamp) AS DATE) AS min_date,
                   CAST(max(order_purchase_timestamp) AS DATE) AS max_date FROM po""",
        "slice_preview": f"""
            SELECT order_id, order_purchase_timestamp, order_status, product_category_name,
                   customer_state, seller_state, main_payment_type, is_bad_review, is_delayed,
                   {nums(**{c: c for c in (
                       "total_price total_freight freight_share review_score delivery_time_days "
                       "delay_days").split()})}
            FROM po ORDER BY order_id LIMIT 10000""",
        "adhoc_overall": """
            SELECT count(*) AS total_orders, CAST(round(sum(money), 2) AS DOUBLE) AS gmv,
                   round(CAST(sum(money) / count(*) AS DOUBLE), 2) AS aov, round(avg(review_score), 3)
                   AS avg_review_score, round(avg(is_bad_review), 3) AS bad_review_rate,
                   round(avg(is_delayed), 3) AS delay_rate,
                   round(avg(delivery_time_days), 2) AS avg_delivery_time_days,
                   round(avg(is_cancelled), 3) AS cancelled_rate FROM paid""",
        "adhoc_months": """
            SELECT order_year_month, count(*) AS orders, CAST(round(sum(money), 2) AS DOUBLE) AS gmv,
                   round(CAST(sum(money) / count(*) AS DOUBLE), 2) AS aov, round(avg(review_score), 3)
                   AS avg_review_score, round(avg(is_bad_review), 3) AS bad_review_rate,
                   round(avg(is_delayed), 3) AS delay_rate FROM paid GROUP BY order_year_month""",
        "adhoc_categories": """
            SELECT product_category_name, count(*) AS orders, CAST(round(sum(money), 2) AS DOUBLE) AS gmv,
                   round(avg(review_score), 3) AS avg_review_score,
                   round(avg(is_bad_review), 3) AS bad_review_rate,
                   round(avg(is_delayed), 3) AS delay_rate
            FROM paid GROUP BY product_category_name HAVING count(*) >= 100
            ORDER BY 5 DESC, 2 DESC, 1 LIMIT 20""",
        "adhoc_states": """
            SELECT customer_state, count(*) AS orders, round(avg(is_delayed), 3) AS delay_rate,
                   round(avg(delivery_time_days), 2) AS avg_delivery_time_days,
                   round(avg(review_score), 3) AS avg_review_score
            FROM om WHERE customer_state IS NOT NULL GROUP BY customer_state
            HAVING count(*) >= 100""",
        "adhoc_sellers": """
            SELECT seller_id, seller_state, top_category, orders, round(delay_rate, 3)
                   AS delay_rate, round(late_handover_rate, 3) AS late_handover_rate,
                   round(bad_review_rate, 3) AS bad_review_rate,
                   round(avg_review_score, 3) AS avg_review_score
            FROM sm WHERE orders >= 30 ORDER BY 7 DESC, 4 DESC, 1 LIMIT 20""",
        "adhoc_seller_categories": """
            SELECT product_category_name, seller_id, count(DISTINCT order_id) AS orders,
                   round(avg(is_bad_review), 3) AS bad_review_rate,
                   round(avg(is_delayed), 3) AS delay_rate,
                   round(avg(is_late_handover), 3) AS late_handover_rate
            FROM os WHERE is_single_seller_order = 1
            GROUP BY product_category_name, seller_id HAVING count(DISTINCT order_id) >= 3""",
        "adhoc_stages": """
            SELECT is_delayed, count(*) AS orders, round(avg(handover_time_days), 2)
                   AS avg_handover_days, round(avg(transit_time_days), 2) AS avg_transit_days,
                   round(avg(delivery_time_days), 2) AS avg_total_days
            FROM om WHERE is_delivered = 1 GROUP BY is_delayed""",
        "chi2_delay_bad": two_groups("is_delayed"),
        "chi2_handover": two_groups("is_late_handover"),
        "chi2_category": many_groups("product_category_name", "is_bad_review"),
        "chi2_state": many_groups("customer_state", "is_delayed"),
        "mwu_delay_score": rank_sum(),
        "mwu_delay_score_slices": rank_sum_slices("customer_state, order_year_month"),
        "spearman_freight_score": spearman(),
        "trend_delay_bad": trend(),
        "posthoc_category": posthoc_with_p("product_category_name", "is_bad_review", ""),
        "posthoc_state": posthoc_with_p("customer_state", "is_delayed", "AND is_delivered = 1"),
        "seller_heterogeneity": heterogeneity_with_p("sold_multi", 30),
        "seller_heterogeneity_single": heterogeneity_with_p("sold_single", 3),
        "hypothesis_table": hypothesis_table("sold_multi", 30, "заказы"),
        "hypothesis_table_single": hypothesis_table("sold_single", 3, "single-seller заказы"),
        "result_category_posthoc": result_category_posthoc(),
        "result_delay_stages": """
            SELECT delay_stage, delayed_orders, round_even(share_of_delayed, 4) AS share_of_delayed,
                   round_even(avg_delay_days, 2) AS avg_delay_days,
                   round_even(bad_review_rate, 4) AS bad_review_rate,
                   round_even(avg_review_score, 4) AS avg_review_score
            FROM (SELECT * FROM (""" + exactly(delay_stages) + "))",
        "category_priority_chart": category_priority_chart(),
        "source_row_counts": row_counts(),
        "csv_row_counts": row_counts(),
        "source_duplicate_keys": " UNION ALL ".join(
            f"""SELECT '{table}' AS "table", CAST({key} AS VARCHAR) AS key, count(*) AS rows
                FROM {source} GROUP BY {key} HAVING count(*) > 1"""
            for table, key, source in (
                ("raw_customers", "c_custkey", "customer"), ("raw_orders", "o_orderkey", "orders"),
                ("raw_products", "p_partkey", "part"), ("raw_sellers", "s_suppkey", "supplier"),
            )
        ),
        "slice_export": """
            SELECT CAST(order_id AS VARCHAR) AS order_id, order_status,
                   round(total_price, 2) AS total_price, review_score FROM cut""",
    }


def checks() -> dict[str, str]:
    saved = {f"saved_{name}": sql for name, sql in saved_results().items()}
    return {name: with_views(sql) for name, sql in (queries_sql() | saved).items()}
