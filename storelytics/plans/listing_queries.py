"""Registered listing and lookup queries and the SQL that checks them."""

from datetime import date

from pyspark.sql import functions as F

from storelytics.operators import customers as C
from storelytics.operators import orders as O
from storelytics.operators import requests as Q
from storelytics.operators.reports import order_total
from storelytics.plans.report_queries import with_tables

WINDOW = (date(1996, 1, 1), date(1998, 12, 31))
LISTING = dict(status="Shipped", start=WINDOW[0], end=WINDOW[1], limit=200, offset=20)


def _order_listing(t, **kw):
    return O.order_listing(
        t.orders, t.order_items, t.products, t.item_requests, t.users, t.addresses, t.order_status, **kw
    )


def _user_orders(t, **kw):
    return O.user_orders(t.orders, t.order_items, t.products, t.item_requests, t.addresses, t.order_status, **kw)


SIGNED_UP = "SELECT DISTINCT user_id FROM {events} WHERE event_type = 'signup'"
# One probe per order: its customer's e-mail in capitals or phone, or a value nobody has.
USER_PROBES = """
    SELECT o_orderkey AS probe_id, CASE WHEN o_orderkey % 2 = 0 THEN 'email' ELSE 'phone' END AS login_type,
           CASE WHEN o_orderkey % 10 = 0 THEN 'nobody' WHEN o_orderkey % 2 = 0
                THEN 'CUSTOMER#' || lpad(CAST(o_custkey AS STRING), 9, '0') || '@example.com'
                ELSE '555' || CAST(o_custkey AS STRING) END AS value
    FROM {orders}"""
SOCIAL_PROBES = """
    SELECT o_orderkey AS probe_id, 's' || CAST(o_custkey AS STRING) AS social_id,
           CASE WHEN o_orderkey % 3 = 0 THEN 'google' ELSE 'apple' END AS social_type
    FROM {orders}"""


def _order_envelope(t):
    day = F.to_date("created_at").cast("string").alias("day")
    images = F.from_json("order_images", "array<string>").alias("order_images")
    rows = _order_listing(t, **LISTING).select("order_id", "part", "user_name", "status", images, day)
    total = order_total(t.orders, t.order_status, "Shipped", *WINDOW).select(F.col("total_amount").cast("string"))
    order = [F.desc("day"), F.asc("order_id"), F.asc("part")]
    return O.envelope(rows, total, "orders", order, "Orders retrieved successfully", limit=200)


QUERIES = {
    "l01_order_listing": lambda t: _order_listing(t, **LISTING),
    "l02_user_orders": lambda t: _user_orders(t),
    "l02_user_orders_in_parts": lambda t: _user_orders(t, array_rows=3),
    "l03_order_header": lambda t: O.order_header(t.orders, t.order_status),
    "l04_order_item_details": lambda t: O.order_item_details(
        t.order_items, t.products, t.item_requests, t.request_masters, t.item_approvals
    ),
    "l05_order_history": lambda t: O.order_history(t.order_history, t.orders, t.users),
    "l06_request_list": lambda t: Q.request_list(t.request_masters, t.requests, t.users, t.addresses),
    "l06_request_list_status": lambda t: Q.request_list(
        t.request_masters, t.requests, t.users, t.addresses, status="Rejected"
    ),
    "l07_request_detail": lambda t: Q.request_detail(
        t.request_masters, t.requests, t.approvals, t.users, t.addresses, status="Approved"
    ),
    "l08_customer_request_list": lambda t: Q.customer_request_list(t.request_masters, t.requests, t.addresses),
    "l08_customer_request_list_of_some": lambda t: Q.customer_request_list(
        t.request_masters, t.requests, t.addresses, ids=t.sql(SIGNED_UP)
    ),
    "l09_customer_request_detail": lambda t: Q.customer_request_detail(
        t.request_masters, t.requests, t.approvals, t.users, t.addresses, user_ids=t.sql(SIGNED_UP)
    ),
    "l10_customer_count": lambda t: C.customer_count(t.users, "R#0000001"),
    "l11_customers_ranked": lambda t: C.customers_ranked(t.users, t.orders, "R#0000", limit=50, offset=10),
    "l12_customer_stats": lambda t: C.customer_stats(t.users, t.orders),
    "l13_recent_orders": lambda t: O.recent_orders(t.orders, t.order_items),
    "l13_recent_orders_of_some": lambda t: O.recent_orders(t.orders, t.order_items, ids=t.sql(SIGNED_UP)),
    "l14_active_addresses": lambda t: C.addresses_of(t.addresses),
    "l14_all_addresses": lambda t: C.addresses_of(t.addresses, active_only=False),
    "l15_user_lookup": lambda t: C.lookup_users(t.users, t.sql(USER_PROBES)),
    "l16_social_lookup": lambda t: C.lookup_social(t.users, t.social_users, t.sql(SOCIAL_PROBES)),
    "l17_user_public": lambda t: C.user_public(t.users),
    "l17_user_profile": lambda t: C.user_profile(t.users),
    "l18_product_listing": lambda t: C.product_listing(t.products, "PROMO", "brand#1", limit=50, offset=10),
    "l18_product_count": lambda t: C.product_count(t.products, "PROMO", "brand#1"),
    "l19_user_orders_by_status": lambda t: _user_orders(t, statuses=["Pending", "Delivered"]),
    "l20_order_envelope": _order_envelope,
}

IMAGES = """images AS (
    SELECT i.order_id, CAST(to_json(list(CASE WHEN i.is_custom_product THEN q.image ELSE p.image END
           ORDER BY i.order_item_id, CASE WHEN i.is_custom_product THEN q.image ELSE p.image END NULLS FIRST)) AS VARCHAR)
           AS order_images
    FROM t_order_items i LEFT JOIN t_products p ON i.product_id = p.product_id
    LEFT JOIN t_item_requests q ON i.product_request_id = q.request_id GROUP BY i.order_id)"""
ADDRESS = "a.address_line, a.city, a.state, a.zip_code, a.country"
CHARGES = "o.subtotal, o.service_charge, o.delivery_charge, o.total"
ORDER_TABLES = "orders order_items products item_requests users addresses order_status"


def _orders_with_images(select: str, where: str = "", tail: str = "") -> str:
    sql = with_tables(
        ORDER_TABLES,
        f"""SELECT {select}, 0 AS part, coalesce(g.order_images, '[]') AS order_images
        FROM t_orders o LEFT JOIN t_order_status s ON o.order_status_id = s.order_status_id
        LEFT JOIN t_users u ON o.user_id = u.user_id LEFT JOIN t_addresses a ON o.address_id = a.address_id
        LEFT JOIN images g ON o.order_id = g.order_id
        WHERE NOT o.delete_status {where} {tail}""",
    )
    return sql.replace("\nSELECT", ",\n" + IMAGES + "\nSELECT", 1)


LISTING_WHERE = (
    "AND s.status_name = 'Shipped' AND o.created_at >= DATE '1996-01-01' AND o.created_at <= DATE '1998-12-31'"
)
LISTING_TAIL = "ORDER BY o.created_at DESC, o.order_id LIMIT 200 OFFSET 20"
USER_ORDER_COLUMNS = (
    f"o.user_id, o.order_id, o.address_id, {ADDRESS}, {CHARGES}, o.scheduled_time, o.status, "
    "s.status_name AS order_status, o.created_at"
)

REQUEST_IMAGES = """images AS (
    SELECT request_master_id, CAST(to_json(list(image ORDER BY request_id)) AS VARCHAR) AS product_images
    FROM t_requests WHERE NOT delete_status GROUP BY 1)"""
NESTED = """options AS (
    SELECT request_id, list({'approved_size': approved_size, 'approved_color': approved_color,
        'approved_price': CAST(approved_price AS VARCHAR), 'approval_id': approval_id}
        ORDER BY approval_id, approved_size, approved_color, approved_price) AS approvals
    FROM t_approvals GROUP BY 1),
nested AS (
    SELECT r.request_master_id, CAST(to_json(list({'request_id': r.request_id, 'product_name': r.product_name,
        'description': r.description, 'requested_size': r.requested_size, 'requested_color': r.requested_color,
        'status': r.status, 'request_status_id': r.request_status_id, 'image': r.image,
        'approvals': o.approvals} ORDER BY r.request_id)) AS VARCHAR) AS product_requests
    FROM t_requests r LEFT JOIN options o ON r.request_id = o.request_id
    WHERE NOT r.delete_status GROUP BY 1)"""


def _masters(cte: str, select: str, where: str) -> str:
    joined = "images" if cte is REQUEST_IMAGES else "nested"
    tables = "request_masters requests users addresses" + ("" if cte is REQUEST_IMAGES else " approvals")
    sql = with_tables(
        tables,
        f"""SELECT m.request_master_id, 0 AS part, m.status AS master_status, m.delivery_date, {ADDRESS}, {select}
        FROM t_request_masters m LEFT JOIN t_users u ON m.user_id = u.user_id
        LEFT JOIN t_addresses a ON m.address_id = a.address_id
        LEFT JOIN {joined} g ON m.request_master_id = g.request_master_id
        WHERE NOT m.delete_status {where}""",
    )
    return sql.replace("\nSELECT", ",\n" + cte + "\nSELECT", 1)


def _has(status: str) -> str:
    return f"""AND EXISTS (SELECT 1 FROM t_requests x WHERE x.request_master_id = m.request_master_id
        AND x.status = '{status}')"""


_LIST = "coalesce(g.product_images, '[]') AS product_images"
_WHO = "u.name AS customer_name, u.email AS customer_email, a.address_id"
_DETAIL = (
    "m.user_id, m.created_at AS master_created_at, u.name AS customer_name, u.email AS customer_email, m.address_id, "
    "coalesce(g.product_requests, '[]') AS product_requests"
)
_SEARCH = "(lower(name) LIKE '%{0}%' OR lower(email) LIKE '%{0}%' OR lower(phone) LIKE '%{0}%')"
_SPEND = """SELECT u.*, count(DISTINCT o.order_id) AS total_orders, {0} AS total_spent
    FROM t_users u LEFT JOIN t_orders o ON u.user_id = o.user_id {1} GROUP BY ALL"""
_LISTED = "NOT delete_status AND category = 'PROMO' AND (lower(name) LIKE '%brand#1%' OR lower(description) LIKE '%brand#1%')"
_PUBLIC = "u.user_id, u.name, u.email, u.phone, u.role, u.size_preferences"

ORACLE = {
    "l01_order_listing": _orders_with_images(
        f"o.order_id, o.user_id, u.name AS user_name, o.address_id, {ADDRESS}, {CHARGES}, o.status, "
        "s.status_name AS order_status, o.scheduled_time, o.created_at",
        LISTING_WHERE,
        LISTING_TAIL,
    ),
    "l02_user_orders": _orders_with_images(USER_ORDER_COLUMNS),
    "l02_user_orders_in_parts": with_tables(
        ORDER_TABLES,
        f"""SELECT {USER_ORDER_COLUMNS}, CAST(coalesce(g.part, 0) AS INTEGER) AS part, coalesce(g.order_images, '[]') AS order_images
        FROM t_orders o LEFT JOIN t_order_status s ON o.order_status_id = s.order_status_id
        LEFT JOIN t_addresses a ON o.address_id = a.address_id
        LEFT JOIN (SELECT order_id, part, CAST(to_json(list(image ORDER BY order_item_id, image NULLS FIRST)) AS VARCHAR) AS order_images
            FROM (SELECT *, (row_number() OVER (PARTITION BY order_id ORDER BY order_item_id, image NULLS FIRST) - 1) // 3 AS part FROM (
                SELECT i.order_id, i.order_item_id, CASE WHEN i.is_custom_product THEN q.image ELSE p.image END AS image
                FROM t_order_items i LEFT JOIN t_products p ON i.product_id = p.product_id
                LEFT JOIN t_item_requests q ON i.product_request_id = q.request_id))
            GROUP BY order_id, part) g ON o.order_id = g.order_id
        WHERE NOT o.delete_status""",
    ),
    "l03_order_header": with_tables(
        "orders order_status",
        f"""SELECT o.order_id, o.user_id, o.address_id, {CHARGES}, o.status, s.status_name AS order_status,
        o.scheduled_time, o.created_at FROM t_orders o
        LEFT JOIN t_order_status s ON o.order_status_id = s.order_status_id WHERE NOT o.delete_status""",
    ),
    "l04_order_item_details": with_tables(
        "order_items products item_requests request_masters item_approvals",
        """SELECT i.order_id, i.order_item_id, i.product_id, CAST(i.is_custom_product AS INTEGER) AS is_custom_product,
        i.product_request_id, i.quantity, i.price, CAST(i.quantity * i.price AS DECIMAL(20,2)) AS item_subtotal,
        CASE WHEN i.is_custom_product THEN CAST(to_json({'request_id': q.request_id, 'user_id': m.user_id,
            'product_name': q.product_name, 'description': q.description, 'requested_size': q.requested_size,
            'requested_color': q.requested_color, 'status': m.status, 'image': q.image, 'approval_id': a.approval_id,
            'approved_by': a.approved_by, 'approved_size': a.approved_size, 'approved_color': a.approved_color,
            'approved_price': CAST(a.approved_price AS VARCHAR)}) AS VARCHAR)
        ELSE CAST(to_json({'product_id': p.product_id, 'name': p.name, 'category': p.category,
            'price': CAST(p.price AS VARCHAR)}) AS VARCHAR) END AS product_details
        FROM t_order_items i
        LEFT JOIN t_item_requests q ON i.product_request_id = q.request_id AND i.is_custom_product
        LEFT JOIN t_request_masters m ON q.request_master_id = m.request_master_id
        LEFT JOIN t_item_approvals a ON i.approval_id = a.approval_id
        LEFT JOIN t_products p ON i.product_id = p.product_id AND NOT i.is_custom_product
        WHERE NOT i.delete_status""",
    ),
    "l05_order_history": with_tables(
        "order_history orders users",
        """SELECT h.history_id, h.order_id, h.status, h.order_status_id, h.updated_at, o.user_id, o.scheduled_time,
        u.name AS customer_name FROM t_order_history h JOIN t_orders o ON h.order_id = o.order_id
        LEFT JOIN t_users u ON o.user_id = u.user_id""",
    ),
    "l06_request_list": _masters(REQUEST_IMAGES, f"{_WHO}, {_LIST}", ""),
    "l06_request_list_status": _masters(REQUEST_IMAGES, f"{_WHO}, {_LIST}", _has("Rejected")),
    "l07_request_detail": _masters(NESTED, _DETAIL, _has("Approved")),
    "l08_customer_request_list": _masters(
        REQUEST_IMAGES,
        f"m.user_id, m.created_at AS master_created_at, {_LIST}",
        "AND m.request_master_id IN (SELECT request_master_id FROM t_requests)",
    ),
    "l08_customer_request_list_of_some": _masters(
        REQUEST_IMAGES,
        f"m.user_id, m.created_at AS master_created_at, {_LIST}",
        "AND m.request_master_id IN (SELECT request_master_id FROM t_requests) "
        "AND m.user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')",
    ),
    "l09_customer_request_detail": _masters(
        NESTED, _DETAIL, "AND m.user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')"
    ),
    "l10_customer_count": with_tables(
        "users",
        f"""SELECT count(DISTINCT user_id) AS total FROM t_users WHERE role = 'customer'
        AND {_SEARCH.format('r#0000001')}""",
    ),
    "l11_customers_ranked": with_tables(
        "users orders",
        _SPEND.format(
            "CAST(coalesce(sum(o.total), 0) AS DECIMAL(28,2))",
            f"WHERE u.role = 'customer' AND {_SEARCH.format('r#0000')}",
        )
        + " ORDER BY total_spent DESC, u.user_id LIMIT 50 OFFSET 10",
    ),
    "l12_customer_stats": with_tables("users orders", _SPEND.format("CAST(sum(o.total) AS DECIMAL(28,2))", "")),
    "l13_recent_orders": with_tables(
        "orders order_items",
        """SELECT o.* EXCLUDE (rank), coalesce(c.item_count, 0) AS item_count FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, order_id) AS rank FROM t_orders) o
        LEFT JOIN (SELECT order_id, count(order_item_id) AS item_count FROM t_order_items GROUP BY 1) c
        ON o.order_id = c.order_id WHERE o.rank <= 10""",
    ),
    "l13_recent_orders_of_some": with_tables(
        "orders order_items",
        """SELECT o.* EXCLUDE (rank), coalesce(c.item_count, 0) AS item_count FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, order_id) AS rank FROM t_orders
        WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')) o
        LEFT JOIN (SELECT order_id, count(order_item_id) AS item_count FROM t_order_items GROUP BY 1) c
        ON o.order_id = c.order_id WHERE o.rank <= 10""",
    ),
    "l14_active_addresses": with_tables("addresses", "SELECT * FROM t_addresses WHERE NOT delete_status"),
    "l14_all_addresses": with_tables("addresses", "SELECT * FROM t_addresses"),
    "l15_user_lookup": with_tables(
        "users",
        f"""SELECT p.probe_id, u.user_id, u.email, u.phone, u.role FROM ({USER_PROBES.format(orders='orders')}) p
        JOIN t_users u ON p.login_type = 'email' AND u.email = lower(p.value)
        UNION ALL SELECT p.probe_id, u.user_id, u.email, u.phone, u.role FROM ({USER_PROBES.format(orders='orders')}) p
        JOIN t_users u ON p.login_type = 'phone' AND u.phone = lower(p.value)""",
    ),
    "l16_social_lookup": with_tables(
        "users social_users",
        f"""SELECT p.probe_id, {_PUBLIC} FROM ({SOCIAL_PROBES.format(orders='orders')}) p
        JOIN t_social_users s ON p.social_id = s.social_id AND p.social_type = s.social_type
        JOIN t_users u ON s.user_id = u.user_id""",
    ),
    "l17_user_public": with_tables("users", f"SELECT {_PUBLIC} FROM t_users u"),
    "l17_user_profile": with_tables("users", "SELECT * FROM t_users"),
    "l18_product_listing": with_tables(
        "products", f"SELECT * FROM t_products WHERE {_LISTED} ORDER BY product_id LIMIT 50 OFFSET 10"
    ),
    "l18_product_count": with_tables("products", f"SELECT count(*) AS total FROM t_products WHERE {_LISTED}"),
    "l19_user_orders_by_status": _orders_with_images(
        USER_ORDER_COLUMNS, "AND s.status_name IN ('Pending', 'Delivered')"
    ),
    "l20_order_envelope": with_tables(
        ORDER_TABLES,
        f"""SELECT CAST(to_json({{'success': true, 'message': 'Orders retrieved successfully', 'data':
        {{'orders': (SELECT list({{'order_id': order_id, 'part': 0, 'user_name': user_name, 'status': status,
        'order_images': order_images, 'day': day}} ORDER BY day DESC, order_id) FROM (
            SELECT o.order_id, u.name AS user_name, o.status, CAST(coalesce(g.order_images, '[]') AS JSON) AS order_images,
            CAST(CAST(o.created_at AS DATE) AS VARCHAR) AS day
            FROM t_orders o LEFT JOIN t_order_status s ON o.order_status_id = s.order_status_id
            LEFT JOIN t_users u ON o.user_id = u.user_id LEFT JOIN images g ON o.order_id = g.order_id
            WHERE NOT o.delete_status {LISTING_WHERE} {LISTING_TAIL})),
        'total': (SELECT CAST(sum(o.total) AS VARCHAR) FROM t_orders o
            LEFT JOIN t_order_status s ON o.order_status_id = s.order_status_id
            WHERE NOT o.delete_status {LISTING_WHERE})}}}}) AS VARCHAR) AS response""",
    ).replace("\nSELECT", ",\n" + IMAGES + "\nSELECT", 1),
}
