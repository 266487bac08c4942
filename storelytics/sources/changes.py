"""Batches of changes derived from the driver's tables, in the SQL both engines share."""

CHANGES: dict[str, str] = {
    # Lines of new orders: every third line asks for a request nobody made.
    "new_items": """
        SELECT l_orderkey AS order_id, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_custom_product,
               l_partkey AS product_id,
               CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey + 10000000 ELSE l_orderkey END AS product_request_id,
               CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
               CASE WHEN l_linestatus = 'O' THEN l_suppkey END AS approval_id, l_linenumber AS line
        FROM {lineitem}""",
    # Only some requests have an approval; the other rows approve requests that do not exist.
    "gate_approvals": """
        SELECT CASE WHEN l_returnflag = 'A' THEN l_orderkey ELSE l_orderkey + 20000000 END AS request_id
        FROM {lineitem}""",
    "decisions": """
        SELECT o_orderkey AS decision_id,
               CASE WHEN o_orderkey % 100 = 0 THEN o_orderkey + 10000000
                    WHEN o_orderkey % 40 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS request_id,
               o_custkey AS admin_id,
               CASE o_orderstatus WHEN 'F' THEN 'reject' WHEN 'O' THEN 'approve' ELSE
                    CASE WHEN o_orderkey % 2 = 0 THEN 'approve' ELSE 'hold' END END AS action,
               CASE WHEN o_orderkey % 30 = 7 THEN '[]' ELSE
                    '[{{"size":"S","color":"red","price":' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)
                    || '}},{{"size":"M","color":"blue","price":10.5}}]' END AS options,
               o_orderdate AS at
        FROM {orders}""",
    "decision_rows": """
        SELECT o_custkey AS request_master_id, o_custkey AS user_id,
               CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderkey END AS request_id,
               CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'Rejected'
                    WHEN o_orderkey % 97 = 0 THEN 'hold' ELSE 'Approved' END AS status,
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS product_name,
               CASE WHEN o_orderkey % 6 = 0 THEN 'too dear' END AS admin_remarks,
               'c' || CAST(o_custkey AS STRING) || '@example.com' AS customer_email,
               CAST(NULL AS STRING) AS customer_name, o_orderdate AS at
        FROM {orders}""",
    "cancels": """
        SELECT event_id AS change_id, event_id * 2 AS order_id, CAST(2 AS BIGINT) AS updated_by, ts AS at
        FROM {events}""",
    "address_changes": """
        SELECT c_custkey AS change_id,
               CASE c_custkey % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'delete' ELSE 'insert' END AS kind,
               c_custkey AS address_id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 1 ELSE c_custkey END AS user_id,
               c_name || ' Road' AS address_line, 'Newtown' AS city, 'NT' AS state, '99' AS zip_code, 'EUROPE' AS country
        FROM {customer}""",
    "delivery_changes": """
        SELECT o_orderkey AS change_id, o_orderkey AS order_id,
               CASE WHEN o_orderkey % 6 = 0 THEN o_custkey + 1 ELSE o_custkey END AS user_id,
               '2024-03-01 10:00:00' AS delivery_time, TIMESTAMP '2024-02-01 12:00:00' AS at
        FROM {orders}""",
    # A third of the e-mails exist already, a third is new, a third repeats inside the batch.
    "new_users": """
        SELECT o_orderkey AS signup_id, 'User ' || CAST(o_orderkey AS STRING) AS name,
               CASE WHEN o_orderkey % 50 = 0 THEN NULL
                    WHEN o_orderkey % 3 = 0 THEN 'CUSTOMER#' || lpad(CAST(o_custkey AS STRING), 9, '0') || '@example.com'
                    WHEN o_orderkey % 3 = 1 THEN 'new' || CAST(o_orderkey AS STRING) || '@example.com'
                    ELSE 'Same' || CAST(o_custkey AS STRING) || '@example.com' END AS email,
               '556' || CAST(o_orderkey AS STRING) AS phone, 'customer' AS role, 'S1' AS size_preferences
        FROM {orders}""",
    "social_signups": """
        SELECT o_orderkey AS signup_id, 'google' AS social_type, 'Social ' || CAST(o_orderkey AS STRING) AS name,
               CASE WHEN o_orderkey % 61 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 's' || CAST(o_custkey AS STRING)
                    ELSE 't' || CAST((o_custkey * 7 + o_orderkey % 2) % 997 AS STRING) END AS social_id,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL
                    WHEN o_orderkey % 5 = 0 THEN 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') || '@example.com'
                    ELSE 'fresh' || CAST(o_custkey % 300 AS STRING) || '@example.com' END AS email,
               'S2' AS size_preferences
        FROM {orders}""",
    # Some customers ask for the e-mail or the phone of the next one, and some for the same new ones.
    "profile_changes": """
        SELECT c_custkey AS change_id, c_custkey AS user_id, 'N ' || c_name AS name, 'Last' AS last_name,
               CASE WHEN c_custkey % 16 = 5 THEN 'Shared' || CAST(c_custkey % 80 AS STRING) || '@example.com' ELSE
                   'Customer#' || lpad(CAST(CASE WHEN c_custkey % 9 = 0 THEN c_custkey + 1 ELSE c_custkey END AS STRING), 9, '0')
                   || '@example.com' END AS email,
               CASE WHEN c_custkey % 16 = 7 THEN '557' || CAST(c_custkey % 48 AS STRING) ELSE '555' || CAST(CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1 ELSE c_custkey END AS STRING) END AS phone,
               'XL' AS size_preferences, TIMESTAMP '2024-02-01 12:00:00' AS at
        FROM {customer}""",
    # Profile changes and sign-ups that claim two values each, few values for many, in several spellings.
    "claimed_profiles": """
        SELECT c_custkey AS change_id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 ELSE c_custkey END AS user_id,
               'N ' || c_name AS name, 'Last' AS last_name,
               CASE c_custkey % 3 WHEN 0 THEN 'Zoë' WHEN 1 THEN 'ZOE' ELSE 'zoé' END || CAST(c_custkey * 7 % 53 AS STRING) || '@example.com' AS email,
               CASE WHEN c_custkey % 4 <> 0 THEN '558' || CAST(c_custkey * 11 % 41 AS STRING) END AS phone,
               'XL' AS size_preferences, TIMESTAMP '2024-02-01 12:00:00' AS at
        FROM {customer} WHERE c_custkey % 2 = 1 OR c_custkey % 5 = 0""",
    "claimed_users": """
        SELECT c_custkey AS signup_id, 'User ' || CAST(c_custkey AS STRING) AS name,
               CASE c_custkey % 3 WHEN 0 THEN 'Zoë' WHEN 1 THEN 'ZOE' ELSE 'zoé' END || CAST(c_custkey * 13 % 61 AS STRING) || '@example.com' AS email,
               'customer' AS role, 'S1' AS size_preferences, 's' || CAST(c_custkey * 17 % 47 + 3 AS STRING) AS social_id, 'apple' AS social_type
        FROM {customer}""",
    "size_changes": """
        SELECT o_orderkey AS change_id, o_custkey AS user_id,
               CASE WHEN o_orderkey % 5 <> 0 THEN 'P' || CAST(o_orderkey AS STRING) END AS size_preferences
        FROM {orders}""",
    # One-time values per user for the keyed upsert; changes reach past the highest user.
    "tokens": """
        SELECT c_custkey AS user_id, 'c' || CAST(c_nationkey AS STRING) AS token, c_custkey % 2 = 0 AS is_used
        FROM {customer}""",
    "token_changes": """
        SELECT o_orderkey AS change_id, o_custkey * 2 AS user_id, 'n' || CAST(o_orderkey AS STRING) AS token
        FROM {orders}""",
    "product_changes": """
        SELECT p_partkey AS change_id, CASE p_partkey % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'delete' ELSE 'add' END AS kind,
               CASE WHEN p_partkey % 3 <> 2 THEN p_partkey * 2 END AS product_id, 'new ' || p_name AS name,
               p_brand || '!' AS description, CAST(p_retailprice + 1 AS DECIMAL(12,2)) AS price, p_size + 1 AS stock,
               p_type AS category
        FROM {part}""",
    # Tables with broken rules of every kind, for the audit.
    "audit_items": """
        SELECT l_orderkey * 8 + l_linenumber AS order_item_id, CASE WHEN l_orderkey % 400 = 9 THEN -l_orderkey ELSE l_orderkey END AS order_id,
               CASE WHEN l_partkey % 300 = 1 THEN l_partkey + 9000000 ELSE l_partkey END AS product_id,
               CASE WHEN l_linenumber = 1 THEN l_orderkey WHEN l_linenumber = 2 AND l_orderkey % 90 = 4 THEN -1 END AS product_request_id,
               CASE WHEN l_orderkey % 77 <> 0 THEN CAST(l_quantity AS INT) END AS quantity, l_extendedprice AS price
        FROM {lineitem}""",
    "audit_products": """
        SELECT CASE WHEN p_partkey % 500 = 3 THEN p_partkey + 1 ELSE p_partkey END AS product_id,
               CASE WHEN p_partkey % 97 <> 0 THEN p_name END AS name, p_retailprice AS price,
               CASE WHEN p_partkey % 89 <> 0 THEN p_size END AS stock
        FROM {part}""",
    "audit_links": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 45 = 0 THEN -5 ELSE c_custkey END AS user_id, 'google' AS social_type,
               CASE WHEN c_custkey % 40 = 0 THEN 'Twice' WHEN c_custkey % 33 <> 0 THEN 's' || CAST(c_custkey AS STRING) END AS social_id
        FROM {customer}""",
    "audit_masters": """
        SELECT c_custkey AS request_master_id, CASE WHEN c_custkey % 55 <> 0 THEN c_custkey END AS user_id,
               CASE WHEN c_custkey % 70 = 0 THEN 9 ELSE 1 END AS request_status_id,
               CASE WHEN c_custkey % 60 = 0 THEN 'Odd' ELSE 'Pending' END AS status
        FROM {customer}""",
    "audit_approvals": """
        SELECT l_orderkey AS approval_id, CASE WHEN l_orderkey % 333 <> 0 THEN l_orderkey END AS request_id,
               CAST(1 AS BIGINT) AS approved_by, l_extendedprice AS approved_price
        FROM {lineitem} WHERE l_linenumber = 1""",
    "audit_log": """
        SELECT CASE WHEN event_id % 200 = 1 THEN event_id + 1 ELSE event_id END AS log_id,
               CASE WHEN event_id % 50 = 0 THEN -1 WHEN event_id % 51 <> 0 THEN user_id END AS order_id
        FROM {events}""",
    "audit_history": """
        SELECT event_id AS history_id, user_id AS order_id, CASE WHEN event_id % 66 = 0 THEN 12 ELSE 1 END AS order_status_id
        FROM {events}""",
    "audit_addresses": """
        SELECT c_custkey AS address_id, CASE WHEN c_custkey % 65 = 0 THEN -2 ELSE c_custkey END AS user_id, c_name AS address_line,
               CASE WHEN c_custkey % 75 <> 0 THEN 'Town' END AS city, 'EUROPE' AS country
        FROM {customer}""",
    # Tables with one kind of broken rule each, for the first audit.
    "audit_users": """
        SELECT c_custkey AS user_id, c_name AS name,
               CASE WHEN c_custkey % 50 = 0 THEN CASE WHEN c_custkey % 100 = 0 THEN 'TWICE@example.com' ELSE 'twice@example.com' END
                    WHEN c_custkey % 7 <> 0 THEN lower(c_name) END AS email,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'guest' ELSE 'customer' END AS role
        FROM {customer}""",
    "audit_orders": """
        SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 500 = 7 THEN -1 ELSE o_custkey END AS user_id,
               CASE WHEN o_orderkey % 300 = 5 THEN NULL ELSE o_custkey END AS address_id, 1 AS order_status_id,
               o_totalprice AS subtotal, o_totalprice AS total
        FROM {orders}""",
    "audit_requests": """
        SELECT o_orderkey AS request_id, o_custkey AS request_master_id,
               CASE WHEN o_orderkey % 70 = 1 THEN NULL ELSE o_orderpriority END AS product_name,
               CASE WHEN o_orderkey % 90 = 2 THEN 9 ELSE 1 END AS request_status_id,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'Lost' ELSE 'Pending' END AS status
        FROM {orders}""",
}
