"""Constraint audit: what a database would refuse, found by one aggregate over tagged key values.

Every table is read once. A row gives one (check, slot, key) entry for each rule it takes part in: in a parent key's check the parent
is slot 0 and every child column that refers to it a further slot; a unique key is a check with slot 0 only; a value outside its domain
and an empty required column are entries of slot 1, written only where they occur. One aggregate counts the slots of each key
of each check: slot 0 above one is a repeated key, another slot without slot 0 is a violation by all its rows.

Violations are reported per rule and value with their number of rows, so a value that breaks a rule in a third
of all rows is one line of output, counted before the shuffle. Keys are compared as text, unique keys without case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (child table, column, parent table, parent key).
FOREIGN_KEYS = [
    ("addresses", "user_id", "users", "user_id"),
    ("datalog", "order_id", "orders", "order_id"),
    ("order_history", "order_id", "orders", "order_id"),
    ("order_history", "order_status_id", "order_status", "order_status_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "product_request_id", "requests", "request_id"),
    ("orders", "user_id", "users", "user_id"),
    ("orders", "address_id", "addresses", "address_id"),
    ("orders", "order_status_id", "order_status", "order_status_id"),
    ("request_masters", "request_status_id", "request_status", "request_status_id"),
    ("requests", "request_status_id", "request_status", "request_status_id"),
    ("social_users", "user_id", "users", "user_id"),
]
# Fixed values: (table, columns that together are unique); the single keys come first.
UNIQUE_KEYS = [
    ("addresses", ["address_id"]),
    ("approvals", ["approval_id"]),
    ("datalog", ["log_id"]),
    ("order_history", ["history_id"]),
    ("order_items", ["order_item_id"]),
    ("order_status", ["order_status_id"]),
    ("orders", ["order_id"]),
    ("products", ["product_id"]),
    ("request_masters", ["request_master_id"]),
    ("request_status", ["request_status_id"]),
    ("requests", ["request_id"]),
    ("social_users", ["id"]),
    ("users", ["user_id"]),
    ("order_status", ["status_name"]),
    ("request_status", ["status_name"]),
    ("social_users", ["social_id", "social_type"]),
    ("users", ["email"]),
    ("users", ["social_id", "social_type"]),
]
# Fixed values: (table, column, allowed values).
DOMAINS = [
    ("request_masters", "status", ["Pending", "Approved", "Rejected", "Completed"]),
    ("requests", "status", ["Pending", "Approved", "Rejected", "Completed"]),
    ("users", "role", ["customer", "admin"]),
]
# Fixed values: (table, columns that must be filled).
REQUIRED = [
    ("addresses", ["address_id", "user_id", "address_line", "city", "country"]),
    ("approvals", ["approval_id", "request_id", "approved_by", "approved_price"]),
    ("datalog", ["log_id", "order_id"]),
    ("order_history", ["history_id", "order_id"]),
    ("order_items", ["order_item_id", "order_id", "quantity", "price"]),
    ("order_status", ["order_status_id", "status_name"]),
    ("orders", ["order_id", "user_id", "address_id", "subtotal", "total"]),
    ("products", ["product_id", "name", "price", "stock"]),
    ("request_masters", ["request_master_id", "user_id", "request_status_id"]),
    ("request_status", ["request_status_id", "status_name"]),
    ("requests", ["request_id", "request_master_id", "product_name", "request_status_id"]),
    ("social_users", ["id", "user_id", "social_id", "social_type"]),
    ("users", ["user_id"]),
]


def _has(tables: dict[str, DataFrame], name: str, *columns: str) -> bool:
    return name in tables and all(c in tables[name].columns for c in columns)


def unchecked(tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(rule, place) of the rules that ``violations`` cannot check, since a table or column is not at hand."""
    rules = [("foreign key", f"{c}.{k}", (c, k), (p, q)) for c, k, p, q in FOREIGN_KEYS]
    rules += [("unique", f"{t}.{'+'.join(cols)}", (t, *cols)) for t, cols in UNIQUE_KEYS]
    rules += [("domain", f"{t}.{c}", (t, c)) for t, c, _ in DOMAINS]
    rules += [("not null", f"{t}.{c}", (t, c)) for t, cols in REQUIRED for c in cols]
    return [(rule, place) for rule, place, *needs in rules if not all(_has(tables, *n) for n in needs)]


class _Checks:
    """Checks by number, and the entries that each table's rows give."""

    def __init__(self):
        self.names: list[list[tuple[str, str] | None]] = []  # per check and slot: rule and place, None where a slot breaks none
        self.entries: dict[str, list[Column]] = {}

    def check(self) -> int:
        self.names.append([None])
        return len(self.names) - 1

    def slot(self, check: int, rule: str, place: str) -> int:
        self.names[check].append((rule, place))
        return len(self.names[check]) - 1

    def add(self, table: str, when: Column, check: int, slot: int, *key: Column):
        key = [k.cast("string") for k in key]
        value = F.concat_ws("|", *key) if len(key) > 1 else key[0] if key else F.lit(None).cast("string")
        # Where a key has several parts, their lengths tell them apart.
        cuts = F.concat_ws(",", *[F.length(k).cast("string") for k in key[:-1]]) if len(key) > 1 else F.lit("")
        self.entries.setdefault(table, []).append([F.when(when, F.lit(check)), F.lit(slot), value, cuts])

    def counted(self, tables: dict[str, DataFrame]) -> DataFrame:
        """(check, value, cuts, slots): rows per slot, for every key of every check."""
        rows = [
            tables[t].select(F.stack(F.lit(len(entries)), *[c for e in entries for c in e]).alias("check", "slot", "value", "cuts"))
            for t, entries in self.entries.items()
        ]
        slots = max(len(n) for n in self.names)
        counts = [F.count_if(F.col("slot") == k).alias(f"n{k}") for k in range(slots)]
        summed = reduce(DataFrame.unionByName, rows).filter("check IS NOT NULL").groupBy("check", "value", "cuts").agg(*counts)
        return summed.select("check", "value", F.array(*[f"n{k}" for k in range(slots)]).alias("slots"))

    def named(self) -> Column:
        """The names as an array of slots per check."""
        slots = max(len(n) for n in self.names)
        padded = [[*n, *[None] * (slots - len(n))] for n in self.names]
        return F.array(*[
            F.array(*[F.struct(F.lit(n and n[0]).cast("string").alias("rule"), F.lit(n and n[1]).cast("string").alias("place")) for n in row])
            for row in padded
        ])


def _checks(tables: dict[str, DataFrame]) -> _Checks:
    checks = _Checks()
    parents: dict[tuple[str, str], int] = {}
    for child, column, parent, key in FOREIGN_KEYS:
        if _has(tables, child, column) and _has(tables, parent, key):
            if (parent, key) not in parents:
                parents[parent, key] = checks.check()
                checks.add(parent, F.col(key).isNotNull(), parents[parent, key], 0, F.col(key))
            number = parents[parent, key]
            checks.add(child, F.col(column).isNotNull(), number, checks.slot(number, "foreign key", f"{child}.{column}"), F.col(column))
    for table, columns in UNIQUE_KEYS:
        if _has(tables, table, *columns):
            place = f"{table}.{'+'.join(columns)}"
            number = parents.get((table, columns[0])) if len(columns) == 1 else None
            # A parent's own key is counted in its check already; text may differ by case there, so it is counted apart.
            if number is None or dict(tables[table].dtypes)[columns[0]] == "string":
                number = checks.check()
                filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
                checks.add(table, filled, number, 0, *[F.lower(F.col(c).cast("string")) for c in columns])
            checks.names[number][0] = ("unique", place)
    for table, column, allowed in DOMAINS:
        if _has(tables, table, column):
            number = checks.check()
            checks.add(table, ~F.col(column).isin(allowed), number, checks.slot(number, "domain", f"{table}.{column}"), F.col(column))
    for table, columns in REQUIRED:
        for column in columns:
            if _has(tables, table, column):
                number = checks.check()
                checks.add(table, F.col(column).isNull(), number, checks.slot(number, "not null", f"{table}.{column}"))
    return checks


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, place, value, n_rows) over every rule whose tables and columns are at hand; ``unchecked`` names the others."""
    checks = _checks(tables)
    broken = F.filter(
        F.transform(F.col("slots"), lambda n, k: F.struct(n.alias("n"), k.alias("slot"), F.col("slots")[0].alias("own"))),
        lambda s: F.when(s["slot"] == 0, s["n"] > 1).otherwise((s["n"] > 0) & (s["own"] == 0)),
    )
    found = checks.counted(tables).select("check", "value", F.explode(broken).alias("s"))
    name = F.get(F.get(checks.named(), F.col("check")), F.col("s.slot"))
    return found.select(name.alias("name"), "value", F.col("s.n").alias("n_rows")).select(
        "name.rule", "name.place", "value", "n_rows"
    ).filter("rule IS NOT NULL")
