import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from storelytics.operators import accounts as A
from storelytics.operators import customers as C
from storelytics.operators import decisions as D
from storelytics.operators import intake as I
from storelytics.operators import outbox as B
from storelytics.operators import upserts as U
from storelytics.operators.quality import violations
from storelytics.schemas import order_status, request_status
from storelytics.session import cut

NOW = datetime(2024, 2, 1, 12, 0)


@pytest.fixture
def batch(frame):
    items = (
        '[{"is_custom_product":1,"product_request_id":1,"quantity":2,"price":1.5},'
        '{"is_custom_product":1,"product_request_id":2,"quantity":1,"price":"2.50","approval_id":null},'
        '{"is_custom_product":1,"product_request_id":99,"quantity":1,"price":3},'
        '{"is_custom_product":0,"product_id":8,"product_request_id":5,"quantity":4,"price":0.25}]'
    )
    head = "order_id long,part int,user_id long,address_id long,subtotal decimal(12,2),service_charge decimal(12,2),delivery_charge decimal(12,2),total decimal(12,2),items string"
    return frame(
        head, (1, 0, 1, 1, "1.00", "0.00", "0.00", "1.00", items),
        (2, 0, 1, 1, "1.00", "0.00", "0.00", "1.00", '[{"is_custom_product":1,"product_request_id":1,"quantity":1,"price":1}]'),
        (3, 0, 1, 1, "1.00", "0.00", "0.00", "1.00", "not json"),
    )


@pytest.fixture
def asked(frame):
    requests = frame(
        "request_id long,request_master_id long,product_name string,status string,request_status_id int,updated_at timestamp_ntz",
        (1, 10, "one", "Pending", 1, None), (2, 20, "two", "Approved", 2, None),
    )
    masters = frame(
        "request_master_id long,status string,request_status_id int,updated_at timestamp_ntz,delivery_date string",
        (10, "Pending", 1, None, "2024-03-01"), (20, "Pending", 1, None, "2024-03-02"),
    )
    return requests, masters, frame("approval_id long,request_id long", (5, 2), (6, 2))


def test_intake(batch):
    new = I.ingest_orders(batch, NOW)
    assert [r.order_id for r in new["orders"].orderBy("order_id").collect()] == [1, 2, 3]
    rows = new["items"].orderBy("order_id", "pos").collect()
    assert [(r.order_id, r.pos, r.product_id, r.product_request_id, str(r.subtotal)) for r in rows] == [
        (1, 0, None, 1, "3.00"), (1, 1, None, 2, "2.50"), (1, 2, None, 99, "3.00"), (1, 3, 8, None, "1.00"), (2, 0, None, 1, "1.00"),
    ]
    assert new["history"].count() == 3


def test_gate_and_what_follows(batch, asked):
    requests, masters, approvals = asked
    new = I.ingest_orders(batch, NOW)
    passed, blocked = I.gate_items(new["items"], requests, approvals)
    assert sorted((r.order_id, r.pos) for r in passed.collect()) == [(1, 1), (1, 3)]
    # from the last item to the first; an unknown request shows its id and hides nothing
    assert {r.order_id: r.blocked_products for r in blocked.collect()} == {1: "99, one", 2: "one"}
    done, done_masters = I.complete_requests(requests, masters, passed, NOW)
    assert {r.request_id: (r.status, r.request_status_id) for r in done.collect()} == {1: ("Pending", 1), 2: ("Completed", 2)}
    assert {r.request_master_id: r.status for r in done_masters.collect()} == {10: "Pending", 20: "Completed"}
    log = {r.order_id: (r.affected_request_masters, r.approved_requests) for r in I.order_audit(new["orders"], passed, requests, NOW).collect()}
    assert log == {1: ("20", "2"), 2: ("", ""), 3: ("", "")}  # an order whose items are all blocked is still there
    dated = I.schedule_from_request(new["orders"], passed, requests, masters)
    assert {r.order_id: r.scheduled_time for r in dated.collect()} == {1: "2024-03-02", 2: None, 3: None}


def test_gate_loses_no_item(tables):
    from storelytics.sources.documents import order_batch

    items = I.ingest_orders(order_batch(tables.orders, tables.new_items), NOW)["items"]
    assert items.count() == tables.new_items.count()
    passed, blocked = I.gate_items(items, tables.requests, tables.gate_approvals)
    stopped = blocked.agg(F.sum(F.size(F.split("blocked_products", ", ")))).first()[0]
    assert passed.count() + stopped == items.count()


def test_request_intake(frame, spark):
    batch = frame(
        "request_master_id long,part int,user_id long,address_id long,delivery_date string,requests string",
        (1, 0, 1, 1, "d", '[{"product_name":"a","image":null},{"product_name":"b","requested_size":"M"}]'),
    )
    masters, requests = I.ingest_requests(batch, request_status(spark), NOW)
    assert masters.first().request_status_id == 1
    assert [(r.pos, r.product_name, r.requested_size, r.status) for r in requests.orderBy("pos").collect()] == [
        (0, "a", None, "Pending"), (1, "b", "M", "Pending")]


def test_decisions(frame):
    requests = frame(
        "request_id long,status string,request_status_id int,updated_at timestamp_ntz",
        (1, "Pending", 1, None), (2, "Pending", 1, None), (3, "Pending", 1, None),
    )
    approvals = frame(
        "approval_id long,request_id long,approved_by long,approved_size string,approved_color string,approved_price decimal(12,2)",
        (10, 1, 1, "S", "red", "1.00"), (11, 2, 1, "S", "red", "1.00"),
    )
    two = '[{"size":"M","color":"blue","price":2},{"size":"L","color":"blue","price":"3.5"}]'
    decisions = frame(
        "decision_id long,request_id long,admin_id long,action string,options string,at timestamp_ntz",
        (1, 1, 9, "approve", two, "2024-01-01"), (2, 1, 9, "reject", two, "2024-01-02"), (3, 2, 9, "hold", two, None),
        (4, 77, 9, "approve", two, None), (5, 3, 9, "approve", "[]", None), (6, 3, 9, None, two, None),
    )
    out = D.apply_decisions(requests, approvals, decisions)
    assert {r.request_id: (r.status, r.request_status_id) for r in out["requests"].collect()} == {
        1: ("Rejected", 3), 2: ("Pending", 1), 3: ("Pending", 1)}
    options = sorted((r.approval_id, r.request_id, r.approved_size, str(r.approved_price)) for r in out["approvals"].collect())
    # ids follow the array from its last entry to its first; the options of request 2 stay
    assert options == [(11, 2, "S", "1.00"), (12, 1, "L", "3.50"), (13, 1, "M", "2.00")]
    assert sorted(r.decision_id for r in out["rejects"].collect()) == [3, 4, 5, 6]


def test_status_changes(frame, spark):
    orders = frame(
        "order_id long,status string,order_status_id int,updated_at timestamp_ntz,delete_status boolean",
        (1, "Pending", 1, None, False), (2, "Pending", 1, None, True), (3, "Pending", 1, None, None),
    )
    changes = frame(
        "change_id long,order_id long,status string,updated_by long,at timestamp_ntz",
        (1, 1, "Shipped", 1, "2024-01-02"), (2, 1, "Processed", 1, "2024-01-01"), (3, 1, "Lost", 1, "2024-01-03"),
        (4, 2, "Shipped", 1, "2024-01-01"), (5, 3, "Shipped", 1, "2024-01-01"), (6, 9, "delivered", 1, "2024-01-01"),
    )
    out = D.update_status(orders, changes, order_status(spark))
    assert {r.order_id: r.status for r in out["orders"].collect()} == {1: "Shipped", 2: "Pending", 3: "Pending"}
    assert sorted(r.change_id for r in out["history"].collect()) == [1, 2, 4, 5, 6]
    assert [(r.change_id, r.reason) for r in out["rejects"].collect()] == [(3, "Invalid status provided")]
    again = D.update_status(out["orders"], changes, order_status(spark))["orders"]
    assert sorted(again.collect()) == sorted(out["orders"].collect())
    canceled = D.cancel_orders(orders, changes.drop("status"))
    assert {r.order_id: r.order_status_id for r in canceled["orders"].collect()} == {1: 5, 2: 1, 3: 1}
    assert canceled["history"].count() == 6


def test_rollup_refuses_a_master_with_a_bad_row(frame):
    rows = frame("request_master_id long,request_id long,status string", (1, 1, "Approved"), (1, 2, "Rejected"), (2, 3, "Approved"), (2, 4, "hold"), (3, None, "Approved"), (4, 5, None))
    got = {r.request_master_id: tuple(r)[1:] for r in D.decision_rollup(rows).collect()}
    assert got == {1: (2, 2, 1, 1, "SUCCESS"), 2: (2, 0, 0, 0, "INVALID"), 3: (1, 0, 0, 0, "INVALID"), 4: (1, 0, 0, 0, "INVALID")}


def test_users_keep_emails_unique(frame):
    users = frame("user_id long,email string,delete_status boolean,created_at timestamp_ntz", (5, "a@x", False, None))
    new = frame("signup_id long,email string", (1, "A@X"), (2, "b@x"), (3, "B@x"), (4, None), (5, None))
    out, rejects = A.insert_users(users, new, NOW)
    assert sorted((r.user_id, r.email) for r in out.na.fill("-").collect()) == [(5, "a@x"), (6, "b@x"), (7, "-"), (8, "-")]
    assert sorted(r.signup_id for r in rejects.collect()) == [1, 3]


def sequential(users, links, signups):
    """The sign-ups handled one by one."""
    users, links, found = dict(users), dict(links), {}
    for number, identity, email in sorted(signups):
        user = links.get(identity)
        if user is None and email is not None:
            user = min((u for u, e in users.items() if e and e.lower() == email.lower()), default=None)
        if user is None:
            user = max(users) + 1
            users[user] = email
        links[identity] = user
        found[number] = user
    return found, len(users), links


def test_social_sign_ups_equal_one_by_one(frame):
    users = [(1, "a@x"), (2, None)]
    links = [("s1", 2)]
    emails = [None, "a@x", "A@X", "b@x", "c@x", "d@x"]
    signups = [(i, f"s{(i * 7) % 9}", emails[(i * 5) % 6]) for i in range(1, 40)]
    out = A.resolve_social(
        frame("user_id long,email string,created_at timestamp_ntz,delete_status boolean", *[(u, e, None, False) for u, e in users]),
        frame("social_id string,social_type string,user_id long", *[(s, "g", u) for s, u in links]),
        frame("signup_id long,social_id string,social_type string,email string,name string,size_preferences string", *[(n, s, "g", e, "n", None) for n, s, e in signups]),
        NOW,
    )
    found, count, all_links = sequential(users, links, signups)
    assert {r.signup_id: r.user_id for r in out["resolved"].collect()} == found
    assert out["users"].count() == count
    assert {r.social_id: r.user_id for r in out["links"].collect()} == all_links


def test_profile_conflicts(frame):
    users = frame(
        "user_id long,name string,last_name string,email string,phone string,size_preferences string,updated_at timestamp_ntz,delete_status boolean",
        *[(i, "n", None, f"{i}@x", str(i), None, None, i == 4) for i in (1, 2, 3, 4)],
    )
    changes = frame(
        "change_id long,user_id long,name string,last_name string,email string,phone string,size_preferences string,at timestamp_ntz",
        (1, 1, "new", None, "2@X", "3", None, None), (2, 2, "new", None, "2@x", "3", None, None),
        (3, 3, "new", None, "4@x", "4", None, "2024-01-01"),
    )
    out, conflicts = A.update_profiles(users, changes)
    assert {r.change_id: r.reason for r in conflicts.collect()} == {1: "Email already exists", 2: "Phone number already exists"}
    assert {r.user_id: (r.name, r.email) for r in out.collect()}[3] == ("new", "4@x")  # a deleted user holds nothing


def test_patch_and_upsert(frame):
    users = frame("user_id long,size_preferences string,name string", (1, "S", "a"), (2, "S", "b"))
    changes = frame("change_id long,user_id long,size_preferences string", (1, 1, "M"), (2, 1, None), (3, 9, "L"))
    got = {r.user_id: r.size_preferences for r in U.patch(users, changes, "user_id", ["size_preferences"], ["change_id"]).collect()}
    assert got == {1: None, 2: "S"}
    merged = U.upsert(users, changes, ["user_id"], ["size_preferences"], ["change_id"], {"name": F.lit("reset")}).collect()
    assert {tuple(r) for r in merged} == {(1, None, "reset"), (2, "S", "b"), (9, "L", "reset")}


def test_addresses_check_their_owner(frame):
    fields = "address_line string,city string,state string,zip_code string,country string"
    addresses = frame(f"address_id long,user_id long,{fields},delete_status boolean", (1, 1, "a", "c", None, None, "n", False), (2, 2, "b", "c", None, None, "n", False))
    changes = frame(
        f"change_id long,kind string,address_id long,user_id long,{fields}",
        (1, "update", 1, 1, "new", "c", None, None, "n"), (2, "delete", 1, 1, *[None] * 5), (3, "delete", 2, 1, *[None] * 5),
        (4, "insert", None, 3, "in", "c", None, None, "n"), (5, "update", 2, 7, "bad", "c", None, None, "n"),
    )
    out, counts = U.apply_addresses(addresses, changes)
    assert sorted((r.address_id, r.user_id, r.address_line, r.delete_status) for r in out.collect()) == [
        (1, 1, "new", True), (2, 2, "b", False), (3, 3, "in", False)]
    assert {r.kind: (r.changes, r.matched) for r in counts.collect()} == {"update": (2, 1), "delete": (2, 1)}


def test_reschedule(frame):
    orders = frame("order_id long,user_id long,scheduled_time string,updated_at timestamp_ntz", (1, 1, None, None), (2, 2, None, None))
    changes = frame("change_id long,order_id long,user_id long,delivery_time string,at timestamp_ntz", (1, 1, 1, "t", None), (2, 2, 1, "t", None))
    assert {r.order_id: r.scheduled_time for r in U.reschedule(orders, changes).collect()} == {1: "t", 2: None}
    assert {r.order_id: r.scheduled_time for r in U.reschedule(orders, changes, owner_checked=False).collect()} == {1: "t", 2: "t"}


def test_request_notifications(frame):
    rows = frame(
        "request_master_id long,user_id long,request_id long,status string,product_name string,admin_remarks string,customer_email string,customer_name string,at timestamp_ntz",
        (1, 7, 1, "Rejected", "", "no", None, None, "2024-01-01"), (1, 7, 2, "Approved", "cup", None, None, None, "2024-01-01"),
        (1, 7, 3, "Rejected", None, "", None, None, "2024-01-01"), (2, 8, 4, "Approved", "pot", None, "e", "n", "2024-01-01"),
    )
    got = Counter((r.topic, r.title, r.body) for r in B.request_outbox(rows).collect())
    assert got == Counter([
        ("userId_7", "Your Product Request #1 has been rejected.", "no"),
        ("userId_7", "Your Product Request #1 has been rejected.", "NA"),
        ("userId_8", "Your Product Request #2 has been approved.", ""),
    ])


def test_audit_finds_each_kind(frame, spark):
    tables = {
        "users": frame("user_id long,email string,role string,social_id string,social_type string", (1, "a@x", "customer", "s", "g"), (2, "A@X", "guest", "s", "g"), (3, None, None, "s", None)),
        "orders": frame("order_id long,user_id long,address_id long,subtotal int,total int", (1, 1, None, 1, 1), (2, 9, 1, 1, 1), (3, 9, 1, 1, 1)),
        "order_status": order_status(spark),
    }
    got = {(r.rule, r.place, r.value, r.n_rows) for r in violations(tables).collect()}
    assert got == {
        ("foreign key", "orders.user_id", "9", 2), ("unique", "users.email", "a@x", 2), ("unique", "users.social_id+social_type", "s|g", 2),
        ("domain", "users.role", "guest", 1), ("not null", "orders.address_id", None, 1),
    }


def test_one_batch_cannot_double_an_email_or_phone(frame):
    users = frame(
        "user_id long,name string,last_name string,email string,phone string,size_preferences string,updated_at timestamp_ntz,delete_status boolean",
        *[(i, "n", None, f"{i}@x", str(i), None, None, False) for i in (1, 2, 3)],
    )
    changes = frame(
        "change_id long,user_id long,name string,last_name string,email string,phone string,size_preferences string,at timestamp_ntz",
        (1, 1, "a", None, "new@x", None, None, None), (2, 2, "b", None, "NEW@x", None, None, None), (3, 1, "c", None, "new@x", "77", None, None),
        (4, 3, "d", None, None, "77", None, None),
    )
    out, conflicts = A.update_profiles(users, changes)
    assert {r.change_id: r.reason for r in conflicts.collect()} == {2: "Email already exists", 4: "Phone number already exists"}
    emails = [r.email for r in out.collect()]
    assert len(set(emails)) == 3 and "new@x" in emails


def test_sign_ups_without_identity_are_rejected(frame):
    out = A.resolve_social(
        frame("user_id long,email string,created_at timestamp_ntz,delete_status boolean", (1, "a@x", None, False)),
        frame("social_id string,social_type string,user_id long", ("s", "g", 1)),
        frame("signup_id long,social_id string,social_type string,email string,name string,size_preferences string",
              (1, None, "g", "p@x", "n", None), (2, "z", None, "q@x", "n", None), (3, "y", "g", "a@x", "n", None)),
        NOW,
    )
    assert {r.signup_id for r in out["rejects"].collect()} == {1, 2}
    assert [(r.signup_id, r.user_id) for r in out["resolved"].collect()] == [(3, 1)] and out["users"].count() == 1
    assert out["links"].filter("social_id is null or social_type is null or user_id is null").count() == 0


def test_users_keep_social_identities_unique(frame):
    users = frame("user_id long,email string,social_id string,social_type string,delete_status boolean,created_at timestamp_ntz", (5, "a@x", "s", "g", False, None))
    new = frame("signup_id long,email string,social_id string,social_type string",
                (1, "b@x", "s", "g"), (2, "c@x", "t", "g"), (3, "d@x", "t", "g"), (4, "e@x", None, "g"), (5, "f@x", None, "g"), (6, "a@x", "u", "g"), (7, "h@x", "u", "g"))
    out, rejects = A.insert_users(users, new, NOW)
    assert {r.signup_id: r.reason.split()[0] for r in rejects.collect()} == {1: "Social", 3: "Social", 6: "Email"}
    assert sorted(r.email for r in out.collect()) == ["a@x", "c@x", "e@x", "f@x", "h@x"]


def test_refused_masters_get_no_messages(frame):
    rows = frame(
        "request_master_id long,user_id long,request_id long,status string,product_name string,admin_remarks string,customer_email string,customer_name string,at timestamp_ntz",
        (1, 1, 1, "Rejected", "x", None, None, None, None), (1, 1, None, "Approved", "y", None, None, None, None),
        (2, 2, 3, "Approved", "z", None, None, None, None), (3, 3, 4, "hold", "z", None, None, None, None), (4, 4, 5, "Rejected", "w", None, None, None, None),
    )
    assert {r.notification_id for r in B.request_outbox(rows).collect()} == {"approved-2", "rejected-4-5"}


def test_intake_reads_quoted_numbers_and_reports_what_it_cannot_read(frame):
    batch = frame(
        "order_id long,part int,user_id long,address_id long,subtotal decimal(12,2),service_charge decimal(12,2),delivery_charge decimal(12,2),total decimal(12,2),items string",
        *[(i, p, 1, 1, None, None, None, None, t) for i, p, t in (
            (1, 0, '[{"product_id":"7","quantity":"2","price":"3.50"},{"product_id":8,"quantity":2.6,"price":1}]'), (2, 0, "oops"),
            (3, 0, '[{"product_id":1}]'), (3, 1, '{"product_id":1}'), (4, 0, None), (5, 0, "[]"))],
    )
    new = I.ingest_orders(batch, NOW)
    got = [(r.order_id, r.pos, r.product_id, r.quantity, str(r.price)) for r in new["items"].collect()]
    assert sorted(got, key=str) == [(1, 0, 7, 2, "3.50"), (1, 1, 8, 3, "1.00"), (3, 0, 1, None, "None")]
    assert sorted((r.order_id, r.part) for r in new["rejects"].collect()) == [(2, 0), (3, 1)]
    assert sorted(r.order_id for r in new["orders"].collect()) == [1, 2, 3, 4, 5]


def fold(text):
    import unicodedata

    return text and "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@pytest.mark.parametrize("seed", range(4))
def test_profile_changes_equal_one_by_one(frame, seed):
    """Random batches of clashing e-mails and phones; several changes of a user, deleted and unknown users among them."""
    rng = random.Random(seed)
    mails, phones = ["a@x", "Á@x", "b@x", "c@x", "ç@X", "d@x", "e@x", None], ["1", "2", "3", "4", None]
    users = [(u, f"{u}@own", f"9{u}", u % 7 == 0) for u in range(1, 15)] + [(20, "d@x", "4", False)]
    changes = [(c, rng.randint(1, 16), rng.choice(mails), rng.choice(phones)) for c in range(60)]
    holders = [(fold(m), p, u) for u, m, p, gone in users if not gone]
    live, won, reasons = {u for u, _, _, gone in users if not gone}, [], {}
    for c, u, mail, phone in changes:
        taken = holders + won
        if mail is not None and any(m == fold(mail) and o != u for m, _, o in taken):
            reasons[c] = "Email already exists"
        elif phone is not None and any(p == phone and o != u for _, p, o in taken):
            reasons[c] = "Phone number already exists"
        elif u in live:
            won.append((fold(mail), phone, u))
    table = frame(
        "user_id long,name string,last_name string,email string,phone string,size_preferences string,updated_at timestamp_ntz,delete_status boolean",
        *[(u, "n", None, m, p, None, None, gone) for u, m, p, gone in users],
    )
    batch = frame(
        "change_id long,user_id long,name string,last_name string,email string,phone string,size_preferences string,at timestamp_ntz",
        *[(c, u, f"c{c}", None, m, p, None, None) for c, u, m, p in changes],
    )
    out, conflicts = A.update_profiles(table, batch)
    assert {r.change_id: r.reason for r in conflicts.collect()} == reasons
    last = {u: f"c{c}" for c, u, _, _ in changes if c not in reasons}
    assert {r.user_id: r.name for r in out.collect()} == {u: last.get(u, "n") for u, *_ in users}


@pytest.mark.parametrize("seed", range(4))
def test_sign_ups_equal_one_by_one(frame, seed):
    rng = random.Random(seed)
    mails, ids = ["a@x", "Á@x", "b@x", "c@x", "d@x", None], ["s", "t", "Ť", "u", "v", None]
    users = [(1, "b@x", "u", "g"), (2, None, None, "g")]
    new = [(i, rng.choice(mails) or f"{i}@y", rng.choice(ids), rng.choice(["g", "g", None])) for i in range(50)]
    held_mail, held_id, reasons = {"b@x"}, {("u", "g")}, {}
    for i, mail, social, kind in new:
        identity = (fold(social), kind) if social and kind else None
        if fold(mail) in held_mail:
            reasons[i] = "Email already exists"
        elif identity in held_id:
            reasons[i] = "Social account already exists"
        else:
            held_mail.add(fold(mail))
            held_id |= {identity} - {None}
    table = frame("user_id long,email string,social_id string,social_type string,delete_status boolean,created_at timestamp_ntz", *[(*u, False, None) for u in users])
    out, rejects = A.insert_users(table, frame("signup_id long,email string,social_id string,social_type string", *new), NOW)
    assert {r.signup_id: r.reason for r in rejects.collect()} == reasons
    assert sorted(r.user_id for r in out.collect()) == list(range(1, 3 + len(new) - len(reasons)))


def test_a_value_wanted_by_all_takes_few_rounds(frame, monkeypatch):
    from storelytics.functions import claims

    rounds = []
    monkeypatch.setattr(claims, "cut", lambda df: rounds.append(1) or cut(df))
    rows = frame("at long,who long,v string,w string", *[(i, i, "hot", str(i)) for i in range(500)], *[(i, i, f"own{i}", str(i)) for i in range(500, 900)])
    found = claims.owners(rows, "at", "who", ["v", "w"])
    assert found["v"].count() == 401 and len(rounds) <= 5


def test_accents_do_not_tell_users_apart(frame):
    users = frame("user_id long,email string,phone string,role string", (1, "É@x", "1", "customer"), (2, "b@x", "2", "admin"))
    found = C.lookup_users(users, frame("probe_id long,login_type string,value string", (1, "email", "é@X"), (2, "email", "e@x"), (3, "email", "c@x")))
    assert sorted(r.probe_id for r in found.collect()) == [1, 2]


def test_audit_reads_each_table_once_and_groups_once(tables, spark):
    audited = {
        "users": tables.audit_users, "orders": tables.audit_orders, "order_items": tables.audit_items, "products": tables.audit_products,
        "order_history": tables.audit_history, "addresses": tables.audit_addresses,
    }

    def count(df, what):
        return df._jdf.queryExecution().executedPlan().toString().count(what)

    own = [sum(count(t, what) for t in audited.values()) for what in ("FileScan", "Exchange hashpartitioning")]
    found = violations(audited)
    assert [count(found, "FileScan"), count(found, "Exchange hashpartitioning")] == [own[0], own[1] + 1]


def test_audit_keys_apart(frame):
    """Keys of several columns do not run together; a repeated parent is no orphan's fault; empty tables and null keys are no rows."""
    made = {
        "users": frame("user_id bigint, email string, role string, social_id string, social_type string",
                       (1, "A@x", "admin", "a|b", "c"), (1, "a@X", None, "a", "b|c"), (2, None, "Admin", "a", None), (None, None, "admin", "a", None)),
        "orders": frame("order_id bigint, user_id int, address_id bigint", (7, 1, 5), (8, 3, None), (9, 3, 5), (9, None, 5)),
        "addresses": frame("address_id bigint, user_id bigint"),
    }
    got = {tuple(r) for r in violations(made).collect()}
    assert got == {
        ("unique", "users.user_id", "1", 2), ("unique", "users.email", "a@x", 2), ("domain", "users.role", "Admin", 1),
        ("not null", "users.user_id", None, 1), ("foreign key", "orders.user_id", "3", 2), ("foreign key", "orders.address_id", "5", 3),
        ("unique", "orders.order_id", "9", 2), ("not null", "orders.user_id", None, 1), ("not null", "orders.address_id", None, 1),
    }
