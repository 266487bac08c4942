"""Registered table-change queries and the SQL that checks them."""

from datetime import datetime

from pyspark.sql import functions as F

from storelytics.functions.ids import dense_ids, highest
from storelytics.operators import accounts as A
from storelytics.operators import decisions as D
from storelytics.operators import intake as I
from storelytics.operators import outbox as B
from storelytics.operators import upserts as U
from storelytics.operators.orders import with_subtotal
from storelytics.operators.quality import unchecked, violations
from storelytics.plans.report_queries import with_tables
from storelytics.schemas import request_status
from storelytics.session import cut
from storelytics.sources.documents import order_batch, request_batch

NOW = datetime(2024, 2, 1, 12, 0)


def _intake(t):
    return I.ingest_orders(order_batch(t.orders, t.new_items), NOW)


def _items(t):
    rows = _intake(t)["items"]
    return rows.select(
        "order_id", F.col("part").cast("int").alias("part"), "pos", F.col("is_custom_product").cast("int").alias("is_custom_product"),
        "product_id", "product_request_id", "approval_id", "quantity", "price", "subtotal",
    )


def _odd_orders(t):
    """The same batch with numbers quoted in some documents and others that are no JSON array."""
    batch = order_batch(t.orders, t.new_items)
    quoted = F.regexp_replace("items", r':([0-9.]+)([,}])', ':"$1"$2')
    odd = F.when(F.col("order_id") % 50 == 3, "oops").when(F.col("order_id") % 50 == 4, '{"a": 1}').when(F.col("order_id") % 7 == 2, quoted)
    return I.ingest_orders(batch.withColumn("items", odd.otherwise(F.col("items"))), NOW)


def _odd_requests(t):
    batch = request_batch(t.request_masters, t.requests)
    odd = F.when(F.col("request_master_id") % 20 == 3, "[{").otherwise(F.col("requests"))
    return I.unread_requests(batch.withColumn("requests", odd))


def _passed(t):
    """Gated items. They are read by several jobs, so they are written out first, as an intake would."""
    return I.gate_items(cut(_intake(t)["items"]), t.requests, t.gate_approvals)


def _created(t):
    return I.create_orders(order_batch(t.orders, t.new_items), t.requests, t.request_masters, t.gate_approvals, NOW)


def _with_identity(t):
    """Users with the identity each came by."""
    return t.users.join(t.social_users.select("user_id", "social_id", "social_type"), "user_id", "left")


def _numbered(t):
    items = _intake(t)["items"]
    return I.number_items(items, highest(t.orders, "order_id")).select("order_item_id", "order_id", "pos", "quantity")


def _judged(t):
    return D.judge_decisions(t.requests, t.decisions)


def _status(t):
    return D.update_status(t.orders, t.status_changes, t.order_status)


ORDER_STATE = ["order_id", "status", "order_status_id", "updated_at", "delete_status"]


def _cancel(t):
    return D.cancel_orders(t.orders, t.cancels)["orders"].select(*ORDER_STATE)


def _social(t):
    return A.resolve_social(t.users, t.social_users, t.social_signups, NOW)


def _outbox_counts(t):
    results = t.decision_rows.select("request_master_id", (F.length("product_name") > 0).alias("notification_sent"))
    return B.outbox_counts(results)


def _audit(t):
    return violations(
        {
            "users": t.audit_users, "orders": t.audit_orders, "requests": t.audit_requests, "addresses": t.addresses,
            "order_history": t.order_history, "order_status": t.order_status, "request_status": request_status(t.spark),
        }
    )


def _full_audit(t):
    """Every rule, and a row for each rule that could not be checked."""
    tables = {
        "users": t.audit_users, "orders": t.audit_orders, "requests": t.audit_requests, "addresses": t.audit_addresses,
        "order_history": t.audit_history, "order_status": t.order_status, "request_status": request_status(t.spark),
        "order_items": t.audit_items, "products": t.audit_products, "social_users": t.audit_links,
        "request_masters": t.audit_masters, "approvals": t.audit_approvals, "datalog": t.audit_log,
    }
    found = violations(tables)
    rows = [("unchecked " + rule, place, None, 0) for rule, place in unchecked(tables)]
    return found.unionByName(t.spark.createDataFrame(rows, found.schema)) if rows else found


USER_STATE = ["user_id", "name", "email", "role", "size_preferences", "created_at", "delete_status"]

QUERIES = {
    "m01_ingest_items": _items,
    "m01_numbered_items": _numbered,
    "m01_odd_items": lambda t: _odd_orders(t)["items"].select(
        "order_id", "pos", F.col("is_custom_product").cast("int").alias("is_custom_product"), "product_id",
        "product_request_id", "approval_id", "quantity", "price",
    ),
    "m01_rejects": lambda t: _odd_orders(t)["rejects"].select("order_id", "items", "reason"),
    "m06_rejects": lambda t: _odd_requests(t).select("request_master_id", "requests", "reason"),
    "m02_blocked_products": lambda t: _passed(t)[1],
    "m02_passed_items": lambda t: _passed(t)[0].select(
        "order_id", "pos", F.col("is_custom_product").cast("int").alias("is_custom_product"), "product_id",
        "product_request_id", "quantity", "price",
    ),
    "m03_completed_requests": lambda t: _created(t)["requests"],
    "m03_completed_masters": lambda t: _created(t)["masters"],
    "m04_order_audit": lambda t: _created(t)["datalog"],
    "m05_order_schedule": lambda t: _created(t)["orders"].select(
        "order_id", "status", "order_status_id", "total", "created_at", "scheduled_time"
    ),
    "m06_ingest_requests": lambda t: I.ingest_requests(
        request_batch(t.request_masters, t.requests), request_status(t.spark), NOW
    )[1],
    "m06_ingest_masters": lambda t: I.ingest_requests(
        request_batch(t.request_masters, t.requests), request_status(t.spark), NOW
    )[0],
    "m07_apply_decisions": lambda t: D.decided_requests(t.requests, _judged(t)),
    "m07_decision_approvals": lambda t: D.replaced_approvals(t.approvals, _judged(t)).select(
        "approval_id", "request_id", "approved_by", "approved_size", "approved_color", "approved_price"
    ),
    "m07_decision_rejects": lambda t: D.rejected_decisions(_judged(t)),
    "m08_decision_rollup": lambda t: D.decision_rollup(t.decision_rows),
    "m09_update_status": lambda t: _status(t)["orders"].select(*ORDER_STATE),
    "m09_status_history": lambda t: _status(t)["history"],
    "m09_status_rejects": lambda t: _status(t)["rejects"],
    "m10_cancel_orders": _cancel,
    "m11_apply_addresses": lambda t: U.apply_addresses(t.addresses, t.address_changes)[0],
    "m11_address_counts": lambda t: U.apply_addresses(t.addresses, t.address_changes)[1],
    "m12_insert_users": lambda t: A.insert_users(t.users, t.new_users, NOW)[0].select(*USER_STATE),
    "m12_user_rejects": lambda t: A.insert_users(t.users, t.new_users, NOW)[1],
    "m12_claimed_users": lambda t: A.insert_users(_with_identity(t), t.claimed_users, NOW)[0].select(*USER_STATE, "social_id", "social_type"),
    "m12_claimed_rejects": lambda t: A.insert_users(_with_identity(t), t.claimed_users, NOW)[1],
    "m13_resolve_social": lambda t: _social(t)["resolved"],
    "m13_social_rejects": lambda t: _social(t)["rejects"],
    "m13_social_users": lambda t: _social(t)["users"].select(*USER_STATE),
    "m13_social_links": lambda t: _social(t)["links"].select("social_id", "social_type", "user_id"),
    "m14_profile_updates": lambda t: A.update_profiles(t.users, t.profile_changes)[0].select(
        *USER_STATE, "last_name", "phone", "updated_at"
    ),
    "m14_profile_conflicts": lambda t: A.update_profiles(t.users, t.profile_changes)[1],
    "m14_claimed_profiles": lambda t: A.update_profiles(t.users, t.claimed_profiles)[0].select(
        *USER_STATE, "last_name", "phone", "updated_at"
    ),
    "m14_claimed_conflicts": lambda t: A.update_profiles(t.users, t.claimed_profiles)[1],
    "m15_patch_column": lambda t: U.patch(t.users, t.size_changes, "user_id", ["size_preferences"], ["change_id"]),
    "m16_reschedule": lambda t: U.reschedule(t.orders, t.delivery_changes).select(*ORDER_STATE, "scheduled_time"),
    "m16_reschedule_by_admin": lambda t: U.reschedule(t.orders, t.delivery_changes, owner_checked=False).select(
        *ORDER_STATE, "scheduled_time"
    ),
    "m17_upsert": lambda t: U.upsert(
        t.tokens, t.token_changes, ["user_id"], ["token"], ["change_id"], {"is_used": F.lit(False)}
    ),
    "m18_apply_products": lambda t: U.apply_products(t.products, t.product_changes),
    "m19_outbox": lambda t: B.status_outbox(t.status_changes),
    "m19_request_outbox": lambda t: B.request_outbox(t.decision_rows),
    "m19_outbox_counts": _outbox_counts,
    "m20_dense_ids": lambda t: dense_ids(
        t.orders.select("order_id", "user_id", "created_at"), "row_id", ["created_at", "order_id"], highest(t.orders, "order_id")
    ),
    "m21_violations": _audit,
    "m21_full_audit": _full_audit,
    "m22_item_subtotal": lambda t: with_subtotal(t.order_items),
}

STAMP = "TIMESTAMP '2024-02-01 12:00:00'"
POSITIONED = """items AS (SELECT *, CAST(row_number() OVER (PARTITION BY order_id ORDER BY line, product_id,
    product_request_id, price, quantity, approval_id NULLS FIRST, is_custom_product) - 1 AS INTEGER) AS pos FROM t_new_items)"""
PASSED = (
    POSITIONED
    + """,
passed AS (SELECT * FROM items WHERE is_custom_product = 0 OR product_request_id IN (SELECT request_id FROM t_gate_approvals))"""
)


def _over(names: str, ctes: str, body: str) -> str:
    return with_tables(names, body).replace("\n" + body, ",\n" + ctes + "\n" + body, 1)


CHECKED = """checked AS (SELECT d.*, CASE WHEN d.options = '[]' THEN 'Approval options are required for approval'
    WHEN r.request_id IS NULL THEN 'Request ID not found.' WHEN d.action NOT IN ('approve', 'reject')
    THEN 'Invalid action. Please specify "approve" or "reject".' END AS reason
    FROM t_decisions d LEFT JOIN t_requests r ON d.request_id = r.request_id),
latest AS (SELECT * FROM checked WHERE reason IS NULL
    QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY decision_id DESC) = 1),
chosen AS (SELECT * FROM checked WHERE reason IS NULL AND action = 'approve'
    QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY decision_id DESC) = 1)"""
CHANGED = """valid AS (SELECT c.*, s.order_status_id FROM t_status_changes c JOIN t_order_status s ON c.status = s.status_name),
latest AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY "at" DESC, change_id DESC) = 1)"""
JUDGED = """judged AS (SELECT n.*, n.email IS NULL OR (
    lower(n.email) NOT IN (SELECT lower(email) FROM t_users WHERE email IS NOT NULL)
    AND row_number() OVER (PARTITION BY lower(n.email) ORDER BY signup_id) = 1) AS free FROM t_new_users n)"""
SOCIAL = """linked AS (SELECT g.*, l.user_id AS link_user FROM t_social_signups g
    LEFT JOIN t_social_users l ON g.social_id = l.social_id AND g.social_type = l.social_type
    WHERE g.social_id IS NOT NULL AND g.social_type IS NOT NULL),
deciding AS (SELECT k.*, (SELECT min(u.user_id) FROM t_users u WHERE u.email = lower(k.email)) AS mail_user FROM linked k
    WHERE link_user IS NULL QUALIFY row_number() OVER (PARTITION BY social_id, social_type ORDER BY signup_id) = 1),
strangers AS (SELECT *, CASE WHEN email IS NULL THEN signup_id ELSE
    first_value(signup_id) OVER (PARTITION BY lower(email) ORDER BY signup_id) END AS creator FROM deciding WHERE mail_user IS NULL),
created AS (SELECT *, (SELECT max(user_id) FROM t_users) + row_number() OVER (ORDER BY signup_id) AS new_user
    FROM strangers WHERE creator = signup_id),
decided AS (SELECT d.social_id, d.social_type, coalesce(d.mail_user, c.new_user) AS user_id, c.new_user IS NOT NULL AS is_new
    FROM deciding d LEFT JOIN strangers s ON d.signup_id = s.signup_id LEFT JOIN created c ON s.creator = c.signup_id),
resolved AS (SELECT k.signup_id, k.social_id, k.social_type, coalesce(k.link_user, d.user_id) AS user_id,
    CASE WHEN k.link_user IS NOT NULL THEN 'link' WHEN d.is_new THEN 'new' ELSE 'email' END AS found_by
    FROM linked k LEFT JOIN decided d ON k.social_id = d.social_id AND k.social_type = d.social_type)"""
PROFILES = """checked AS (SELECT c.*, CASE
    WHEN EXISTS (SELECT 1 FROM t_users u WHERE u.email = lower(c.email) AND u.user_id <> c.user_id AND NOT u.delete_status)
    THEN 'Email already exists'
    WHEN EXISTS (SELECT 1 FROM t_users u WHERE u.phone = c.phone AND u.user_id <> c.user_id AND NOT u.delete_status)
    THEN 'Phone number already exists' END AS fault FROM t_profile_changes c),
mailed AS (SELECT *, CASE WHEN fault IS NULL AND email IS NOT NULL AND user_id <> first_value(user_id) OVER (PARTITION BY fault IS NULL,
    lower(email) ORDER BY change_id) THEN 'Email already exists' ELSE fault END AS fault2 FROM checked),
judged AS (SELECT * EXCLUDE (fault, fault2), CASE WHEN fault2 IS NULL AND phone IS NOT NULL AND user_id <> first_value(user_id) OVER (
    PARTITION BY fault2 IS NULL, lower(phone) ORDER BY change_id) THEN 'Phone number already exists' ELSE fault2 END AS reason FROM mailed)"""
_MAIL_KEY = "lower(strip_accents({0}))"
# The sign-ups one after the other: what is taken so far goes along from row to row.
CLAIMED_USERS = f"""had AS (SELECT u.*, s.social_id, s.social_type FROM t_users u LEFT JOIN t_social_users s USING (user_id)),
queued AS (SELECT n.*, row_number() OVER (ORDER BY signup_id) AS i, {_MAIL_KEY.format("n.email")} AS mail, n.social_type || '/' || n.social_id AS identity,
    EXISTS (SELECT 1 FROM had u WHERE {_MAIL_KEY.format("u.email")} = {_MAIL_KEY.format("n.email")}) AS mail_had,
    EXISTS (SELECT 1 FROM had u WHERE u.social_type || '/' || u.social_id = n.social_type || '/' || n.social_id) AS identity_had FROM t_claimed_users n),
walk AS (WITH RECURSIVE w(i, mails, identities, reason) AS (
    SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], NULL::VARCHAR UNION ALL
    SELECT i, CASE WHEN reason IS NULL THEN list_append(mails, mail) ELSE mails END,
        CASE WHEN reason IS NULL THEN list_append(identities, identity) ELSE identities END, reason
    FROM (SELECT q.i, q.mail, q.identity, w.mails, w.identities, CASE WHEN mail_had OR list_contains(mails, mail) THEN 'Email already exists'
        WHEN identity_had OR list_contains(identities, identity) THEN 'Social account already exists' END AS reason
        FROM w JOIN queued q ON q.i = w.i + 1)) SELECT i, reason FROM w),
judged AS (SELECT q.*, reason FROM queued q JOIN walk USING (i))"""
# The profile changes one after the other; what a change takes is kept with its user.
CLAIMED_PROFILES = f"""queued AS (SELECT c.*, row_number() OVER (ORDER BY change_id) AS i, {_MAIL_KEY.format("c.email")} AS mail,
    EXISTS (SELECT 1 FROM t_users u WHERE {_MAIL_KEY.format("u.email")} = {_MAIL_KEY.format("c.email")} AND u.user_id <> c.user_id AND NOT u.delete_status) AS mail_had,
    EXISTS (SELECT 1 FROM t_users u WHERE u.phone = c.phone AND u.user_id <> c.user_id AND NOT u.delete_status) AS phone_had,
    EXISTS (SELECT 1 FROM t_users u WHERE u.user_id = c.user_id AND NOT u.delete_status) AS live FROM t_claimed_profiles c),
walk AS (WITH RECURSIVE w(i, mails, phones, reason) AS (
    SELECT 0::BIGINT, MAP([]::VARCHAR[], []::BIGINT[]), MAP([]::VARCHAR[], []::BIGINT[]), NULL::VARCHAR UNION ALL
    SELECT i, CASE WHEN reason IS NULL AND live AND mail IS NOT NULL THEN map_concat(mails, MAP([mail], [user_id])) ELSE mails END,
        CASE WHEN reason IS NULL AND live AND phone IS NOT NULL THEN map_concat(phones, MAP([phone], [user_id])) ELSE phones END, reason
    FROM (SELECT q.*, w.mails, w.phones, CASE WHEN mail_had OR coalesce(mails[mail] <> user_id, FALSE) THEN 'Email already exists'
        WHEN phone_had OR coalesce(phones[phone] <> user_id, FALSE) THEN 'Phone number already exists' END AS reason
        FROM w JOIN queued q ON q.i = w.i + 1)) SELECT i, reason FROM w),
judged AS (SELECT q.*, reason FROM queued q JOIN walk USING (i)),
settled AS (SELECT * FROM judged WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY change_id DESC) = 1)"""
_ORDER_STATE = "o.order_id, {0} AS status, {1} AS order_status_id, {2} AS updated_at, o.delete_status"
_ISO = "strftime(\"at\", '%Y-%m-%dT%H:%M:%S.%gZ')"


def _changed(alias: str, status: str, code: str, at: str) -> str:
    def pick(value, column):
        return f"CASE WHEN {alias}.order_id IS NOT NULL AND NOT o.delete_status THEN {value} ELSE o.{column} END"

    return _ORDER_STATE.format(pick(status, "status"), pick(code, "order_status_id"), pick(at, "updated_at"))


_REFUSED = """SELECT request_master_id FROM t_decision_rows
            WHERE request_id IS NULL OR status IS NULL OR status NOT IN ('Approved', 'Rejected')"""



def _audit_sql() -> str:
    """The audit's rules as the tables' definition states them, and the two rules no table at hand can be held to."""
    t = {
        "users": "t_audit_users", "orders": "t_audit_orders", "requests": "t_audit_requests", "addresses": "t_audit_addresses",
        "order_history": "t_audit_history", "order_items": "t_audit_items", "products": "t_audit_products", "datalog": "t_audit_log",
        "social_users": "t_audit_links", "request_masters": "t_audit_masters", "approvals": "t_audit_approvals", "order_status": "t_order_status",
    }
    out = []
    foreign = """addresses.user_id users.user_id, datalog.order_id orders.order_id, order_history.order_id orders.order_id,
        order_history.order_status_id order_status.order_status_id, order_items.order_id orders.order_id,
        order_items.product_id products.product_id, order_items.product_request_id requests.request_id, orders.user_id users.user_id,
        orders.address_id addresses.address_id, orders.order_status_id order_status.order_status_id, social_users.user_id users.user_id"""
    for pair in foreign.split(","):
        (child, column), (parent, key) = (x.split(".") for x in pair.split())
        out.append(f"""SELECT 'foreign key' AS rule, '{child}.{column}' AS place, CAST({column} AS VARCHAR) AS value, count(*) AS n_rows
            FROM {t[child]} WHERE {column} NOT IN (SELECT {key} FROM {t[parent]} WHERE {key} IS NOT NULL) GROUP BY {column}""")
    for child in ("request_masters", "requests"):
        out.append(f"""SELECT 'foreign key', '{child}.request_status_id', CAST(request_status_id AS VARCHAR), count(*) FROM {t[child]}
            WHERE request_status_id NOT IN (1, 2, 3, 4) GROUP BY request_status_id""")
    unique = """addresses.address_id approvals.approval_id datalog.log_id order_history.history_id order_items.order_item_id orders.order_id
        products.product_id request_masters.request_master_id requests.request_id social_users.id users.user_id users.email"""
    for place in unique.split():
        table, column = place.split(".")
        value = f"lower(CAST({column} AS VARCHAR))"
        out.append(f"""SELECT 'unique', '{place}', {value}, count(*) FROM {t[table]} WHERE {column} IS NOT NULL
            GROUP BY {value} HAVING count(*) > 1""")
    out.append("""SELECT 'unique', 'social_users.social_id+social_type', lower(social_id) || '|' || lower(social_type), count(*) FROM t_audit_links
        WHERE social_id IS NOT NULL AND social_type IS NOT NULL GROUP BY lower(social_id), lower(social_type) HAVING count(*) > 1""")
    states = "'Pending', 'Approved', 'Rejected', 'Completed'"
    for place, allowed in (("request_masters.status", states), ("requests.status", states), ("users.role", "'customer', 'admin'")):
        table, column = place.split(".")
        out.append(f"SELECT 'domain', '{place}', {column}, count(*) FROM {t[table]} WHERE {column} NOT IN ({allowed}) GROUP BY {column}")
    filled = """addresses.city approvals.request_id datalog.order_id order_items.quantity orders.address_id products.name products.stock
        request_masters.user_id requests.product_name social_users.social_id"""
    for place in filled.split():
        table, column = place.split(".")
        out.append(f"SELECT 'not null', '{place}', NULL, count(*) FROM {t[table]} WHERE {column} IS NULL HAVING count(*) > 0")
    out.append("SELECT 'unchecked unique', 'users.social_id+social_type', NULL, CAST(0 AS BIGINT)")
    return " UNION ALL ".join(out)


ORACLE = {
    "m01_ingest_items": _over(
        "new_items",
        POSITIONED,
        """SELECT order_id, 0 AS part, pos, is_custom_product,
        CASE WHEN is_custom_product = 0 THEN product_id END AS product_id,
        CASE WHEN is_custom_product = 1 THEN product_request_id END AS product_request_id, approval_id, quantity, price,
        CAST(quantity * price AS DECIMAL(20,2)) AS subtotal FROM items""",
    ),
    "m01_numbered_items": _over(
        "new_items orders",
        POSITIONED,
        """SELECT (SELECT max(order_id) FROM t_orders) + row_number() OVER (ORDER BY order_id, pos DESC) AS order_item_id,
        order_id, pos, quantity FROM items""",
    ),
    "m01_odd_items": _over(
        "new_items",
        POSITIONED,
        """SELECT order_id, pos, is_custom_product, CASE WHEN is_custom_product = 0 THEN product_id END AS product_id,
        CASE WHEN is_custom_product = 1 THEN product_request_id END AS product_request_id, approval_id, quantity, price
        FROM items WHERE order_id % 50 NOT IN (3, 4)""",
    ),
    "m01_rejects": with_tables(
        "orders",
        """SELECT order_id, CASE order_id % 50 WHEN 3 THEN 'oops' ELSE '{"a": 1}' END AS items,
        'Items are not a JSON array' AS reason FROM t_orders WHERE order_id % 50 IN (3, 4)""",
    ),
    "m06_rejects": with_tables(
        "request_masters",
        """SELECT request_master_id, '[{' AS requests, 'Items are not a JSON array' AS reason FROM t_request_masters
        WHERE request_master_id % 20 = 3""",
    ),
    "m02_blocked_products": _over(
        "new_items requests gate_approvals",
        POSITIONED,
        """SELECT i.order_id, 0 AS part,
        string_agg(coalesce(r.product_name, CAST(i.product_request_id AS VARCHAR)), ', ' ORDER BY i.pos DESC) AS blocked_products
        FROM items i LEFT JOIN t_requests r ON i.product_request_id = r.request_id
        WHERE i.is_custom_product = 1 AND i.product_request_id NOT IN (SELECT request_id FROM t_gate_approvals)
        GROUP BY i.order_id""",
    ),
    "m02_passed_items": _over(
        "new_items gate_approvals",
        PASSED,
        """SELECT order_id, pos, is_custom_product, CASE WHEN is_custom_product = 0 THEN product_id END AS product_id,
        CASE WHEN is_custom_product = 1 THEN product_request_id END AS product_request_id, quantity, price FROM passed""",
    ),
    "m03_completed_requests": _over(
        "new_items requests gate_approvals",
        PASSED,
        f"""SELECT r.* REPLACE (CASE WHEN d.id IS NOT NULL THEN 'Completed' ELSE r.status END AS status,
        CASE WHEN d.id IS NOT NULL THEN {STAMP} ELSE r.updated_at END AS updated_at) FROM t_requests r LEFT JOIN
        (SELECT DISTINCT product_request_id AS id FROM passed WHERE is_custom_product = 1) d ON r.request_id = d.id""",
    ),
    "m03_completed_masters": _over(
        "new_items requests request_masters gate_approvals",
        PASSED,
        f"""SELECT m.* REPLACE (CASE WHEN d.id IS NOT NULL THEN 'Completed' ELSE m.status END AS status,
        CASE WHEN d.id IS NOT NULL THEN {STAMP} ELSE m.updated_at END AS updated_at) FROM t_request_masters m LEFT JOIN
        (SELECT DISTINCT r.request_master_id AS id FROM passed p JOIN t_requests r ON p.product_request_id = r.request_id
         WHERE p.is_custom_product = 1) d ON m.request_master_id = d.id""",
    ),
    "m04_order_audit": _over(
        "orders new_items requests gate_approvals",
        PASSED,
        f"""SELECT o.order_id, 0 AS part, coalesce(u.masters, '') AS affected_request_masters,
        coalesce(u.requests, '') AS approved_requests, {STAMP} AS created_at FROM t_orders o LEFT JOIN
        (SELECT p.order_id, string_agg(CAST(r.request_master_id AS VARCHAR), ',' ORDER BY p.pos DESC) AS masters,
         string_agg(CAST(p.product_request_id AS VARCHAR), ',' ORDER BY p.pos DESC) AS requests
         FROM passed p LEFT JOIN t_requests r ON p.product_request_id = r.request_id
         WHERE p.is_custom_product = 1 GROUP BY 1) u ON o.order_id = u.order_id""",
    ),
    "m05_order_schedule": _over(
        "orders new_items requests request_masters gate_approvals",
        PASSED,
        f"""SELECT o.order_id, 'Pending' AS status, 1 AS order_status_id, o.total, {STAMP} AS created_at,
        m.delivery_date AS scheduled_time FROM t_orders o
        LEFT JOIN (SELECT order_id, product_request_id FROM passed WHERE is_custom_product = 1
            QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY pos) = 1) f ON o.order_id = f.order_id
        LEFT JOIN t_requests r ON f.product_request_id = r.request_id
        LEFT JOIN t_request_masters m ON r.request_master_id = m.request_master_id""",
    ),
    "m06_ingest_requests": with_tables(
        "requests request_masters",
        f"""SELECT r.request_master_id, 0 AS part,
        CAST(row_number() OVER (PARTITION BY r.request_master_id ORDER BY request_id) - 1 AS INTEGER) AS pos,
        product_name, description, requested_size, requested_color, image, 'Pending' AS status, 1 AS request_status_id,
        FALSE AS delete_status, {STAMP} AS created_at, {STAMP} AS updated_at
        FROM t_requests r JOIN t_request_masters m ON r.request_master_id = m.request_master_id""",
    ),
    "m06_ingest_masters": with_tables(
        "request_masters",
        f"""SELECT request_master_id, user_id, address_id, delivery_date, 'Pending' AS status, 1 AS request_status_id,
        FALSE AS delete_status, {STAMP} AS created_at, {STAMP} AS updated_at FROM t_request_masters""",
    ),
    "m07_apply_decisions": _over(
        "requests decisions",
        CHECKED,
        """SELECT r.* REPLACE (CASE l.action WHEN 'approve' THEN 'Approved' WHEN 'reject' THEN 'Rejected' ELSE r.status END AS status,
        CASE l.action WHEN 'approve' THEN 2 WHEN 'reject' THEN 3 ELSE r.request_status_id END AS request_status_id,
        coalesce(l.at, r.updated_at) AS updated_at) FROM t_requests r LEFT JOIN latest l ON r.request_id = l.request_id""",
    ),
    "m07_decision_approvals": _over(
        "requests decisions approvals",
        CHECKED,
        """SELECT approval_id, request_id, approved_by, approved_size, approved_color, approved_price FROM t_approvals
        WHERE request_id NOT IN (SELECT request_id FROM chosen)
        UNION ALL SELECT (SELECT max(approval_id) FROM t_approvals) + row_number() OVER (ORDER BY decision_id, place DESC),
        request_id, admin_id, options -> place ->> 'size', options -> place ->> 'color',
        CAST(options -> place ->> 'price' AS DECIMAL(12,2))
        FROM chosen, (VALUES (0), (1)) v(place)""",
    ),
    "m07_decision_rejects": _over(
        "requests decisions", CHECKED, "SELECT decision_id, request_id, action, reason FROM checked WHERE reason IS NOT NULL"
    ),
    "m08_decision_rollup": with_tables(
        "decision_rows",
        """SELECT request_master_id, n AS total_requests, CASE WHEN bad = 0 THEN n ELSE 0 END AS processed_requests,
        CASE WHEN bad = 0 THEN yes ELSE 0 END AS approved_count, CASE WHEN bad = 0 THEN no ELSE 0 END AS rejected_count,
        CASE WHEN bad = 0 THEN 'SUCCESS' ELSE 'INVALID' END AS status FROM (
        SELECT request_master_id, count(*) AS n, count(*) FILTER (WHERE request_id IS NULL OR status = 'hold') AS bad,
        count(*) FILTER (WHERE status = 'Approved') AS yes, count(*) FILTER (WHERE status = 'Rejected') AS no
        FROM t_decision_rows GROUP BY 1)""",
    ),
    "m09_update_status": _over(
        "orders status_changes order_status",
        CHANGED,
        f"""SELECT {_changed('l', 'l.status', 'l.order_status_id', 'l.at')}
        FROM t_orders o LEFT JOIN latest l ON o.order_id = l.order_id""",
    ),
    "m09_status_history": _over(
        "status_changes order_status",
        CHANGED,
        "SELECT change_id, order_id, status, order_status_id, updated_by, \"at\" AS updated_at FROM valid",
    ),
    "m09_status_rejects": with_tables(
        "status_changes",
        """SELECT change_id, order_id, status, 'Invalid status provided' AS reason FROM t_status_changes
        WHERE status = 'Lost'""",
    ),
    "m10_cancel_orders": with_tables(
        "orders cancels",
        f"""SELECT {_changed('l', "'Canceled'", '5', 'l.at')}
        FROM t_orders o LEFT JOIN t_cancels l ON o.order_id = l.order_id""",
    ),
    "m11_apply_addresses": with_tables(
        "addresses address_changes",
        """SELECT a.address_id, a.user_id, coalesce(u.address_line, a.address_line) AS address_line,
        coalesce(u.city, a.city) AS city, coalesce(u.state, a.state) AS state, coalesce(u.zip_code, a.zip_code) AS zip_code,
        coalesce(u.country, a.country) AS country, a.delete_status OR d.change_id IS NOT NULL AS delete_status
        FROM t_addresses a
        LEFT JOIN t_address_changes u ON u.kind = 'update' AND a.address_id = u.address_id AND a.user_id = u.user_id
        LEFT JOIN t_address_changes d ON d.kind = 'delete' AND a.address_id = d.address_id AND a.user_id = d.user_id
        UNION ALL SELECT (SELECT max(address_id) FROM t_addresses) + row_number() OVER (ORDER BY change_id), user_id,
        address_line, city, state, zip_code, country, FALSE FROM t_address_changes WHERE kind = 'insert'""",
    ),
    "m11_address_counts": with_tables(
        "addresses address_changes",
        """SELECT kind, count(*) AS changes, count(a.address_id) AS matched FROM t_address_changes c
        LEFT JOIN t_addresses a ON a.address_id = c.address_id AND a.user_id = c.user_id WHERE kind <> 'insert' GROUP BY 1""",
    ),
    "m12_insert_users": _over(
        "users new_users",
        JUDGED,
        f"""SELECT user_id, name, email, role, size_preferences, created_at, delete_status FROM t_users UNION ALL
        SELECT (SELECT max(user_id) FROM t_users) + row_number() OVER (ORDER BY signup_id), name, email, role,
        size_preferences, {STAMP}, FALSE FROM judged WHERE free""",
    ),
    "m12_user_rejects": _over(
        "users new_users", JUDGED, "SELECT signup_id, email, 'Email already exists' AS reason FROM judged WHERE NOT free"
    ),
    "m12_claimed_users": _over(
        "users social_users claimed_users",
        CLAIMED_USERS,
        f"""SELECT user_id, name, email, role, size_preferences, created_at, delete_status, social_id, social_type FROM had UNION ALL
        SELECT (SELECT max(user_id) FROM t_users) + row_number() OVER (ORDER BY signup_id), name, email, role,
        size_preferences, {STAMP}, FALSE, social_id, social_type FROM judged WHERE reason IS NULL""",
    ),
    "m12_claimed_rejects": _over(
        "users social_users claimed_users", CLAIMED_USERS, "SELECT signup_id, email, reason FROM judged WHERE reason IS NOT NULL"
    ),
    "m13_resolve_social": _over("users social_users social_signups", SOCIAL, "SELECT * FROM resolved"),
    "m13_social_rejects": with_tables(
        "social_signups",
        """SELECT signup_id, social_id, social_type, 'Social identity is missing' AS reason FROM t_social_signups
        WHERE social_id IS NULL OR social_type IS NULL""",
    ),
    "m13_social_users": _over(
        "users social_users social_signups",
        SOCIAL,
        f"""SELECT user_id, name, email, role, size_preferences, created_at, delete_status FROM t_users UNION ALL
        SELECT new_user, name, email, 'customer', size_preferences, {STAMP}, FALSE FROM created""",
    ),
    "m13_social_links": _over(
        "users social_users social_signups",
        SOCIAL,
        """SELECT social_id, social_type, user_id FROM t_social_users UNION
        SELECT social_id, social_type, user_id FROM resolved""",
    ),
    "m14_profile_updates": _over(
        "users profile_changes",
        PROFILES,
        """SELECT u.user_id, coalesce(j.name, u.name) AS name, coalesce(j.email, u.email) AS email, u.role,
        coalesce(j.size_preferences, u.size_preferences) AS size_preferences, u.created_at, u.delete_status,
        coalesce(j.last_name, u.last_name) AS last_name, coalesce(j.phone, u.phone) AS phone,
        coalesce(j.at, u.updated_at) AS updated_at
        FROM t_users u LEFT JOIN judged j ON u.user_id = j.user_id AND j.reason IS NULL""",
    ),
    "m14_profile_conflicts": _over(
        "users profile_changes", PROFILES, "SELECT change_id, user_id, reason FROM judged WHERE reason IS NOT NULL"
    ),
    "m14_claimed_profiles": _over(
        "users claimed_profiles",
        CLAIMED_PROFILES,
        """SELECT u.user_id, CASE WHEN j.i IS NULL THEN u.name ELSE j.name END AS name, CASE WHEN j.i IS NULL THEN u.email ELSE j.email END AS email,
        u.role, CASE WHEN j.i IS NULL THEN u.size_preferences ELSE j.size_preferences END AS size_preferences, u.created_at, u.delete_status,
        CASE WHEN j.i IS NULL THEN u.last_name ELSE j.last_name END AS last_name, CASE WHEN j.i IS NULL THEN u.phone ELSE j.phone END AS phone,
        CASE WHEN j.i IS NULL THEN u.updated_at ELSE j."at" END AS updated_at FROM t_users u LEFT JOIN settled j ON u.user_id = j.user_id""",
    ),
    "m14_claimed_conflicts": _over(
        "users claimed_profiles", CLAIMED_PROFILES, "SELECT change_id, user_id, reason FROM judged WHERE reason IS NOT NULL"
    ),
    "m15_patch_column": with_tables(
        "users size_changes",
        """SELECT u.* REPLACE (CASE WHEN c.user_id IS NOT NULL THEN c.size_preferences ELSE u.size_preferences END
        AS size_preferences) FROM t_users u LEFT JOIN (SELECT * FROM t_size_changes
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY change_id DESC) = 1) c ON u.user_id = c.user_id""",
    ),
    "m16_reschedule": with_tables(
        "orders delivery_changes",
        """SELECT o.order_id, o.status, o.order_status_id, coalesce(d.at, o.updated_at) AS updated_at, o.delete_status,
        coalesce(d.delivery_time, o.scheduled_time) AS scheduled_time FROM t_orders o
        LEFT JOIN t_delivery_changes d ON o.order_id = d.order_id AND o.user_id = d.user_id""",
    ),
    "m16_reschedule_by_admin": with_tables(
        "orders delivery_changes",
        """SELECT o.order_id, o.status, o.order_status_id, d."at" AS updated_at, o.delete_status,
        d.delivery_time AS scheduled_time FROM t_orders o JOIN t_delivery_changes d ON o.order_id = d.order_id""",
    ),
    "m17_upsert": with_tables(
        "tokens token_changes",
        """SELECT coalesce(t.user_id, c.user_id) AS user_id, coalesce(c.token, t.token) AS token,
        CASE WHEN c.user_id IS NOT NULL THEN FALSE ELSE t.is_used END AS is_used FROM t_tokens t FULL OUTER JOIN
        (SELECT * FROM t_token_changes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY change_id DESC) = 1) c
        ON t.user_id = c.user_id""",
    ),
    "m18_apply_products": with_tables(
        "products product_changes",
        """SELECT p.product_id, coalesce(u.name, p.name) AS name, coalesce(u.description, p.description) AS description,
        p.image, coalesce(u.price, p.price) AS price, coalesce(u.stock, p.stock) AS stock,
        coalesce(u.category, p.category) AS category, p.delete_status OR d.product_id IS NOT NULL AS delete_status
        FROM t_products p LEFT JOIN t_product_changes u ON u.kind = 'update' AND p.product_id = u.product_id
        LEFT JOIN t_product_changes d ON d.kind = 'delete' AND p.product_id = d.product_id
        UNION ALL SELECT (SELECT max(product_id) FROM t_products) + row_number() OVER (ORDER BY change_id), name,
        description, NULL, price, stock, category, FALSE FROM t_product_changes WHERE kind = 'add'""",
    ),
    "m19_outbox": with_tables(
        "status_changes",
        f"""SELECT 'order-' || change_id AS notification_id, 'userId_' || customer_id AS topic, 'Order ' || status AS title,
        description AS body, CAST(to_json({{'type': 'order', 'order_id': CAST(order_id AS VARCHAR), 'timestamp': {_ISO}}})
        AS VARCHAR) AS data FROM t_status_changes""",
    ),
    "m19_request_outbox": with_tables(
        "decision_rows",
        f"""SELECT id AS notification_id, 'userId_' || user_id AS topic, 'Your Product Request #' || request_master_id
        || ' has been ' || word || '.' AS title, body, CAST(to_json({{'request_id': CAST(request_master_id AS VARCHAR),
        'customer_email': customer_email, 'customer_name': '', 'product_name': product_name,
        'admin_remarks': admin_remarks, 'type': 'product_request', 'timestamp': {_ISO}}}) AS VARCHAR) AS data FROM (
        SELECT concat_ws('-', 'rejected', request_master_id, request_id) AS id, request_master_id, user_id, customer_email,
            product_name, coalesce(admin_remarks, '') AS admin_remarks, "at", 'rejected' AS word,
            CASE WHEN product_name <> '' THEN product_name ELSE coalesce(admin_remarks, 'NA') END AS body
        FROM t_decision_rows WHERE status = 'Rejected' AND request_master_id NOT IN ({_REFUSED})
        UNION ALL SELECT 'approved-' || request_master_id, request_master_id, max(user_id), max(customer_email), '', '',
            max("at"), 'approved', '' FROM t_decision_rows WHERE request_master_id NOT IN ({_REFUSED})
            GROUP BY request_master_id HAVING count(*) FILTER (WHERE status = 'Rejected') = 0)""",
    ),
    "m19_outbox_counts": with_tables(
        "decision_rows",
        """SELECT request_master_id, count(*) FILTER (WHERE product_name <> '') AS total_sent,
        count(*) FILTER (WHERE product_name = '') AS total_failed FROM t_decision_rows GROUP BY 1""",
    ),
    "m20_dense_ids": with_tables(
        "orders",
        """SELECT order_id, user_id, created_at, (SELECT max(order_id) FROM t_orders) +
        row_number() OVER (ORDER BY created_at, order_id) AS row_id FROM t_orders""",
    ),
    "m21_violations": with_tables(
        "audit_users audit_orders audit_requests addresses order_history",
        """SELECT 'foreign key' AS rule, 'orders.user_id' AS place, CAST(user_id AS VARCHAR) AS value, count(*) AS n_rows
        FROM t_audit_orders WHERE user_id NOT IN (SELECT user_id FROM t_audit_users) GROUP BY ALL
        UNION ALL SELECT 'foreign key', 'order_history.order_id', CAST(order_id AS VARCHAR), count(*)
        FROM t_order_history WHERE order_id NOT IN (SELECT order_id FROM t_audit_orders) GROUP BY ALL
        UNION ALL SELECT 'foreign key', 'requests.request_status_id', CAST(request_status_id AS VARCHAR), count(*)
        FROM t_audit_requests WHERE request_status_id NOT IN (1, 2, 3, 4) GROUP BY ALL
        UNION ALL SELECT 'unique', 'users.email', lower(email), count(*)
        FROM t_audit_users WHERE email IS NOT NULL GROUP BY lower(email) HAVING count(*) > 1
        UNION ALL SELECT 'domain', 'users.role', role, count(*) FROM t_audit_users
        WHERE role NOT IN ('customer', 'admin') GROUP BY ALL
        UNION ALL SELECT 'domain', 'requests.status', status, count(*) FROM t_audit_requests
        WHERE status NOT IN ('Pending', 'Approved', 'Rejected', 'Completed') GROUP BY ALL
        UNION ALL SELECT 'not null', 'orders.address_id', NULL, count(*) FROM t_audit_orders WHERE address_id IS NULL
        HAVING count(*) > 0
        UNION ALL SELECT 'not null', 'requests.product_name', NULL, count(*) FROM t_audit_requests
        WHERE product_name IS NULL HAVING count(*) > 0""",
    ),
    "m21_full_audit": with_tables(
        "audit_users audit_orders audit_requests audit_items audit_products audit_links audit_masters audit_approvals audit_log "
        "audit_history audit_addresses order_status",
        _audit_sql(),
    ),
    "m22_item_subtotal": with_tables(
        "order_items", "SELECT *, CAST(quantity * price AS DECIMAL(20,2)) AS subtotal FROM t_order_items"
    ),
}
