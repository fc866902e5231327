"""Catalogue tables: lists with their sources and users, who sees what, and unique names.

Joins name no strategy. The catalogue sides are usually small and Catalyst
broadcasts them by their measured size; where they are not, the join sorts and
adaptive execution splits skewed keys.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import OperationError
from tablewright.operators.result import quoted

ADMIN_ROLES = ("owner", "admin")
OWNER_ROLES = ("owner",)


def list_datasets(datasets: DataFrame, sources: DataFrame, source_id: str = "source_id", id_: str = "id") -> DataFrame:
    """Datasets with their source; order by ``created_at`` descending to list the newest first."""
    renamed = sources.select(*[F.col(quoted(c)).alias(f"source_{c}" if c != id_ else source_id) for c in sources.columns])
    return datasets.join(renamed, source_id)


def dataset_detail(datasets: DataFrame, sources: DataFrame, dataset_id) -> DataFrame:
    """One dataset with its source; the filter reaches both scans."""
    return list_datasets(datasets.filter(F.col("id") == F.lit(dataset_id)), sources)


def grants_with_users(grants: DataFrame, users: DataFrame) -> DataFrame:
    """Grants with the e-mail of who got them."""
    return grants.join(users.select(F.col("id").alias("user_id"), "email"), "user_id")


def members_by_email(memberships: DataFrame, users: DataFrame, tenant) -> DataFrame:
    """Members of one tenant, by e-mail."""
    mine = memberships.filter(F.col("tenant_id") == F.lit(tenant))
    return grants_with_users(mine, users).orderBy("email", "user_id")


def _has_role(memberships: DataFrame, tenant, user, roles: tuple[str, ...]) -> Column:
    """Whether the user holds one of the roles in the tenant: one yes or no for the whole query."""
    mine = (F.col("tenant_id") == F.lit(tenant)) & (F.col("user_id") == F.lit(user)) & F.col("role").isin(*roles)
    return memberships.filter(mine).exists()


def _is_granted(grants: DataFrame, user, grant_key: str, row_key: str) -> Column:
    """Whether the row at hand was granted to the user."""
    granted = (F.col("user_id") == F.lit(user)) & (F.col(grant_key) == F.col(row_key).outer())
    return grants.select("user_id", grant_key).filter(granted).exists()


def visible_rows(datasets: DataFrame, grants: DataFrame, memberships: DataFrame, tenant, user) -> DataFrame:
    """Datasets of the tenant that are shared with all, the user's own, granted to the user, or all for an owner.

    ``datasets(id, tenant_id, created_by, visibility)``,
    ``grants(dataset_id, user_id)``, ``memberships(tenant_id, user_id, role)``.
    """
    shared = F.col("visibility") == "shared_workspace"
    own = F.col("created_by") == F.lit(user)
    granted = (F.col("visibility") == "shared_specific") & _is_granted(grants, user, "dataset_id", "id")
    owner = _has_role(memberships, tenant, user, OWNER_ROLES)
    return datasets.filter(F.col("tenant_id") == F.lit(tenant)).filter(shared | own | granted | owner)


def private_rows(rows: DataFrame, memberships: DataFrame, tenant, user) -> DataFrame:
    """Rows of the tenant the user made, or all for an owner; ``rows(tenant_id, created_by)``."""
    own = F.col("created_by") == F.lit(user)
    owner = _has_role(memberships, tenant, user, OWNER_ROLES)
    return rows.filter(F.col("tenant_id") == F.lit(tenant)).filter(own | owner)


def inherited_rows(children: DataFrame, visible_parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent is visible."""
    parents = visible_parents.select(F.col(quoted(parent_key)).alias(child_key))
    return children.join(parents, child_key, "left_semi")


def tiered_rows(items: DataFrame, grants: DataFrame, memberships: DataFrame, tenant, user) -> DataFrame:
    """Items by access level: admins see all, members what is open to all or granted to them.

    ``items(id, tenant_id, member_access)``, ``grants(item_id, user_id)``.
    Someone who is no member of the tenant sees nothing.
    """
    admin = _has_role(memberships, tenant, user, ADMIN_ROLES)
    member = _has_role(memberships, tenant, user, ("owner", "admin", "member"))
    open_ = F.col("member_access") == "all_members"
    granted = (F.col("member_access") == "specific_members") & _is_granted(grants, user, "item_id", "id")
    return items.filter(F.col("tenant_id") == F.lit(tenant)).filter(admin | (member & (open_ | granted)))


def log_rows(log: DataFrame, tenant, user) -> DataFrame:
    """Log lines of the tenant, or about the user."""
    return log.filter((F.col("tenant_id") == F.lit(tenant)) | (F.col("user_id") == F.lit(user)))


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once; keys with a null never clash."""
    keys = [quoted(c) for c in columns]
    known = df.select(*keys)
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def assert_unique(df: DataFrame, columns: list[str]) -> None:
    """Raise if a key occurs twice, naming one such key."""
    clash = unique_violations(df, columns).first()
    if clash is not None:
        raise OperationError(f"({', '.join(columns)}) is not unique: {tuple(clash)[:-1]} occurs {clash['rows']} times")
