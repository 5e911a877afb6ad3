"""Users and their criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.criteria import criteria_list_parse, criteria_salary_units, criteria_tri_bool
from postloom.operators.ingest import numbered
from postloom.operators.lifecycle import random_token, stable_token
from postloom.operators.scoring import latest_criteria
from postloom.session import written

DEFAULT_BASE_URL = "http://localhost:8000"


def f_by_token(users: DataFrame, token: str) -> DataFrame:
    return users.where(F.col("access_token") == token).limit(1)


def j_user_criteria(users: DataFrame, criteria: DataFrame) -> DataFrame:
    """Every user with the latest criteria row; users without one drop out."""
    wanted = latest_criteria(criteria).withColumnRenamed("id", "criteria_id")
    return users.join(wanted, users["id"] == wanted["user_id"]).drop("id")


def parse_form(forms: DataFrame) -> DataFrame:
    """Criteria columns from the text of a settings form."""
    return forms.withColumns({
        "keywords": criteria_list_parse(F.col("keywords")),
        "locations": criteria_list_parse(F.col("locations")),
        "min_salary": criteria_salary_units(F.col("min_salary")),
        "max_salary": criteria_salary_units(F.col("max_salary")),
        "remote_preference": criteria_tri_bool(F.col("remote_preference")),
    })


def criteria_upsert(criteria: DataFrame, forms: DataFrame, as_of) -> DataFrame:
    """The criteria table after the newest form of each user is applied.

    A form overwrites all five fields of the user's latest row, with null where
    it was left blank; older rows stay as they are.  A user without a row gets
    one, numbered on in order of user ids and stamped ``as_of``.
    """
    fields = ["keywords", "locations", "min_salary", "max_salary", "remote_preference"]
    newest = written(parse_form(latest_criteria(forms)).select("user_id", F.struct(*fields).alias("_new")), "forms")
    hits = latest_criteria(criteria).select("id", "user_id").join(newest, "user_id").select("id", "_new")
    changed = F.col("_new").isNotNull()
    at = {n: F.lit(as_of).cast(criteria.schema[n].dataType) for n in ("created_at", "updated_at")}
    stored = criteria.join(hits, "id", "left").withColumns({
        **{f: F.when(changed, F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields},
        "updated_at": F.when(changed, at["updated_at"]).otherwise(F.col("updated_at")),
    })
    top = criteria.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    first = numbered(newest.join(criteria.select("user_id"), "user_id", "left_anti"), "user_id", int(top) + 1)
    added = first.select("id", "user_id", "_new.*").withColumns(at)
    return stored.select(*criteria.columns).unionByName(added.select(*criteria.columns))


def user_add(users: DataFrame, wanted: DataFrame, base_url: str = DEFAULT_BASE_URL,
             salt: str | None = None, order: str | None = None) -> DataFrame:
    """New users among ``wanted`` (name, email): ids, tokens and dashboard addresses.

    An email already stored is not added again.  Of several equal emails in one
    batch the name smallest by the column ``order`` counts, without one the
    alphabetically smallest.  The rows are written, so a drawn token stays the
    same however often they are read.  ``users_with_criteria`` adds the empty
    criteria rows that go with new users.
    """
    name = F.min("name") if order is None else F.min_by("name", order)
    fresh = wanted.groupBy("email").agg(name.alias("name")).join(
        users.select("email"), "email", "left_anti")
    top = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    rows = numbered(fresh, "email", int(top) + 1)
    token = random_token() if salt is None else stable_token(F.col("id"), salt)
    rows = written(rows.withColumn("access_token", token), "users-added")
    return rows.select(
        "id", "name", "email", "access_token",
        F.concat(F.lit(base_url + "/u/"), F.col("access_token")).alias("url"),
    )


def users_with_criteria(
    users: DataFrame, criteria: DataFrame, wanted: DataFrame, as_of, base_url: str = DEFAULT_BASE_URL,
    salt: str | None = None, order: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new users as by ``user_add``, an empty criteria row for each, numbered on in order of their ids)."""
    added = user_add(users, wanted, base_url, salt, order)
    top = criteria.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    return added, numbered(empty_criteria(added, as_of), "user_id", int(top) + 1)


def empty_criteria(added: DataFrame, as_of) -> DataFrame:
    at = F.lit(as_of).cast("timestamp_ntz")
    return added.select(
        F.col("id").alias("user_id"), F.lit(None).cast("array<string>").alias("keywords"),
        F.lit(None).cast("array<string>").alias("locations"), F.lit(None).cast("bigint").alias("min_salary"),
        F.lit(None).cast("bigint").alias("max_salary"), F.lit(None).cast("boolean").alias("remote_preference"),
        at.alias("created_at"), at.alias("updated_at"),
    )
