"""Adding and changing user accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelytics.functions.claims import blind, held_before, matched, owners
from storelytics.functions.ids import dense_ids, highest
from storelytics.functions.latest import first_per_key, last_per_key
from storelytics.functions.predicates import moment
from storelytics.operators.upserts import overlay, upsert
from storelytics.session import cut


def insert_users(users: DataFrame, new: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Add users (signup_id, email and other columns); an e-mail or social identity already taken goes to the rejects.

    Sign-ups count as if handled one by one: a refused one takes nothing, so a later one may have its e-mail or identity. Users
    without e-mail, or without social_id or social_type, never collide there. Case and accents do not tell e-mails or identities apart.
    """
    identity = ["social_id", "social_type"]
    values = {"_email": blind("email")}
    if set(identity) <= set(users.columns) & set(new.columns):
        both = F.col("social_id").isNotNull() & F.col("social_type").isNotNull()
        # The kind comes first and its length with it, so no two identities read the same.
        pair = F.concat_ws(":", F.length("social_type").cast("string"), "social_type", "social_id")
        values["_identity"] = blind(F.when(both, pair))
    judged = new.withColumns(values)
    for v, key in values.items():
        known = users.select(key.alias(v)).filter(F.col(v).isNotNull()).groupBy(v).agg(F.lit(True).alias(f"_taken{v}"))
        judged = matched(judged, known, v)
    judged = cut(judged)
    free = [F.col(f"_taken{v}").isNull() for v in values]
    claimed = owners(judged.filter(reduce(lambda a, b: a & b, free)), "signup_id", "signup_id", list(values))
    judged = held_before(judged, claimed, "signup_id", "signup_id")
    reason = F.when(F.col("_taken_email").isNotNull() | F.col("_held__email"), "Email already exists")
    if "_identity" in values:
        reason = reason.when(F.col("_taken_identity").isNotNull() | F.col("_held__identity"), "Social account already exists")
    judged = judged.withColumn("_reason", reason)
    rejects = judged.filter("_reason IS NOT NULL").select("signup_id", "email", F.col("_reason").alias("reason"))
    accepted = judged.filter("_reason IS NULL").select(*new.columns)
    numbered = dense_ids(accepted, "user_id", ["signup_id"], highest(users, "user_id"))
    fresh = numbered.withColumn("created_at", moment(now)).withColumn("delete_status", F.lit(False))
    return users.unionByName(fresh.drop("signup_id"), allowMissingColumns=True), rejects


def resolve_social(users, links, signups, now) -> dict[str, DataFrame]:
    """Resolve social sign-ups (signup_id, social_id, social_type, email, name, size_preferences) to users.

    An existing link wins, then an existing e-mail, then a new customer. Sign-ups count as if handled one
    by one: the first of each unlinked identity decides for the later ones, and the first of each new e-mail
    creates the user that later ones find. Sign-ups without social_id or social_type go to ``rejects``.
    """
    identity = ["social_id", "social_type"]
    nameless = F.col("social_id").isNull() | F.col("social_type").isNull()
    rejects = signups.filter(nameless).select("signup_id", *identity, F.lit("Social identity is missing").alias("reason"))
    signups = signups.filter(~nameless)
    live = links.join(users.select("user_id"), "user_id", "left_semi").select(*identity, F.col("user_id").alias("_linked"))
    probed = signups.join(live, identity, "left")
    # What each new identity comes to feeds three results and is numbered on the way, so it is written once.
    deciders = first_per_key(probed.filter(F.col("_linked").isNull()).drop("_linked"), identity, ["signup_id"])
    by_email = users.filter(F.col("email").isNotNull()).groupBy(blind("email").alias("_email")).agg(F.min("user_id").alias("_owner"))
    deciders = cut(matched(deciders.withColumn("_email", blind("email")), by_email, "_email"))
    # Sign-ups without e-mail share no key, so each stands for itself.
    stranger = blind(F.coalesce(F.concat(F.lit("e:"), F.col("email")), F.concat(F.lit("s:"), F.col("signup_id").cast("string"))))
    strangers = deciders.filter(F.col("_owner").isNull()).withColumn("_key", stranger)
    creators = first_per_key(strangers.select("_key", "signup_id", "email", "name", "size_preferences"), ["_key"], ["signup_id"])
    numbered = dense_ids(creators, "user_id", ["signup_id"], highest(users, "user_id"))
    created = numbered.select("_key", F.col("user_id").alias("_created"))
    decided = (
        matched(deciders.withColumn("_key", stranger), created, "_key")
        .select(*identity, F.coalesce("_owner", "_created").alias("_decided"), F.col("_created").isNotNull().alias("_is_new"))
    )
    resolved = probed.join(decided, identity, "left").select(
        "signup_id", *identity, F.coalesce("_linked", "_decided").alias("user_id"),
        F.when(F.col("_linked").isNotNull(), "link").when(F.col("_is_new"), "new").otherwise("email").alias("found_by"),
    )
    new_users = numbered.select(
        "user_id", "name", "email", F.lit("customer").alias("role"), "size_preferences",
        moment(now).alias("created_at"), F.lit(False).alias("delete_status"),
    )
    return {
        "resolved": resolved,
        "users": users.unionByName(new_users, allowMissingColumns=True),
        "rejects": rejects,
        "links": upsert(links, resolved.select(*identity, "signup_id", "user_id"), identity, ["user_id"], ["signup_id"]),
    }


def _holders(users: DataFrame, column: str) -> DataFrame:
    """Per value, the lowest and highest user holding it: enough to tell whether somebody else does."""
    live = users.filter(~F.col("delete_status") & F.col(column).isNotNull())
    return live.groupBy(blind(column).alias(f"_{column}")).agg(
        F.min("user_id").alias(f"_low_{column}"), F.max("user_id").alias(f"_high_{column}")
    )


def update_profiles(users: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Update profiles unless the e-mail or phone belongs to another undeleted user; returns users and conflicts.

    ``changes``: change_id, user_id, name, last_name, email, phone, size_preferences, at. Changes count as if handled one by one in
    order of change_id: an accepted change takes its e-mail and phone for its user, a refused one takes nothing. What
    users had before the batch stays theirs until its end. Deleted and unknown users hold nothing. Case and accents do not count.
    """
    columns = ["name", "last_name", "email", "phone", "size_preferences"]
    judged = changes.join(users.filter(~F.col("delete_status")).select("user_id", F.lit(True).alias("_live")), "user_id", "left")
    for column in ("email", "phone"):
        judged = matched(judged.withColumn(f"_{column}", blind(column)), _holders(users, column), f"_{column}")
    me = F.col("user_id")
    elsewhere = {c: F.coalesce((F.col(f"_low_{c}") != me) | (F.col(f"_high_{c}") != me), F.lit(False)) for c in ("email", "phone")}
    judged = cut(judged.withColumns({f"_elsewhere_{c}": e for c, e in elsewhere.items()}))
    claims = judged.filter("_live AND NOT _elsewhere_email AND NOT _elsewhere_phone")
    judged = held_before(judged, owners(claims, "change_id", "user_id", ["_email", "_phone"]), "change_id", "user_id")
    reason = F.when(F.col("_elsewhere_email") | F.col("_held__email"), "Email already exists").when(
        F.col("_elsewhere_phone") | F.col("_held__phone"), "Phone number already exists"
    )
    judged = judged.withColumn("reason", reason)
    accepted = judged.filter(F.col("reason").isNull()).select("user_id", "change_id", "at", *columns)
    last = last_per_key(accepted, ["user_id"], ["change_id"])
    new = {**{c: F.col(f"patch.{c}") for c in columns}, "updated_at": F.col("patch.at")}
    conflicts = judged.filter(F.col("reason").isNotNull()).select("change_id", "user_id", "reason")
    return overlay(users, last, ["user_id"], new), conflicts
