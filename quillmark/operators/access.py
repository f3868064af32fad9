"""Scope resolution, role ladders, project lists and searches under access rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ["viewer", "editor", "admin", "owner"]
PERMISSIONS = ["read", "write", "admin"]


def role_rank(c: Column) -> Column:
    """1 for viewer to 4 for owner, 0 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), c), F.lit(0)).cast("long")


def can_manage(role: Column, user: Column) -> Column:
    """Admins and owners manage what isn't personal; anyone what they own; editors what they created in their workspace."""
    return ((role_rank(role) >= 3) & (F.col("scope_type") != "personal")) | ((F.col("scope_type") == "personal") & (F.col("owner_user_id") == user)) | ((role_rank(role) >= 2) & (F.col("scope_type") == "workspace") & (F.col("created_by_user_id") == user))


def member_workspace(memberships: DataFrame, user: str, requested: str | None = None, default: str | None = None) -> DataFrame:
    """The active membership that counts: of the requested workspace, else of the default, else the earliest joined."""
    own = memberships.filter((F.col("user_id") == user) & (F.col("status") == "active"))
    own = own.filter(F.col("workspace_id") == requested) if requested else own
    first = F.when(F.col("workspace_id") == F.lit(default), 0).otherwise(1)
    return own.orderBy(first, "joined_at", "workspace_id").limit(1)


def first_of_each(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The value of each key's first row in the order: an aggregate, no sort."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def lists_of(rows: DataFrame, key: str, value: str, most: int = 8) -> DataFrame:
    """Sorted different values of each key, at most `most`."""
    return rows.groupBy(key).agg(F.slice(F.sort_array(F.collect_set(value)), 1, most).alias(f"{value}_list"))


def open_or_granted(projects: DataFrame, grants: DataFrame, user: str, key: str = "project_id") -> DataFrame:
    """Projects open to the workspace, owned by the user, or granted to them."""
    own = grants.filter(F.col("user_id") == user).select(F.col(key).alias("_g")).distinct()
    joined = projects.join(own, projects[key] == F.col("_g"), "left")
    return joined.filter((F.col("access_scope") == "workspace") | (F.col("owner_user_id") == user) | F.col("_g").isNotNull()).drop("_g")


def search(rows: DataFrame, query: str, columns: list[str], name: str, order: list[Column | str], k: int) -> DataFrame:
    """Rows that contain the query in one of the columns, whatever its case (% and _ stay wildcards); exact names first."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.ilike(F.col(c), F.lit(f"%{query}%"))
    return rows.filter(hit).orderBy(F.when(F.lower(name) == query.lower(), 0).otherwise(1), *order).limit(k)


def page(rows: DataFrame, order: list[str], limit: int, offset: int, most: int = 200) -> DataFrame:
    """A page in a total order; limits and offsets outside their bounds are moved into them."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(most, limit)))


def members(memberships: DataFrame) -> DataFrame:
    """Members of each workspace, the highest role first."""
    return memberships.withColumn("nth", F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.desc(role_rank(F.col("role"))), "user_id")))


def open_tokens(rows: DataFrame, now: Column) -> DataFrame:
    """Invitations or handovers that are neither accepted nor revoked nor expired."""
    return rows.filter(F.col("accepted_at").isNull() & F.col("revoked_at").isNull() & (F.col("expires_at") > now))
