"""Catalogue joins and visibility: customers act as datasets and users, orders as grants, nations as tenants."""

from pyspark.sql import functions as F

from suite.base import Query, table
from tablewright.operators import catalog

_TENANT, _USER = 7, 4

_VISIBILITY = "CASE WHEN {0} % 3 = 0 THEN 'private' WHEN {0} % 3 = 1 THEN 'shared_workspace' ELSE 'shared_specific' END"
_ACCESS = "CASE WHEN {0} % 3 = 0 THEN 'admins_only' WHEN {0} % 3 = 1 THEN 'all_members' ELSE 'specific_members' END"
_ROLE = "CASE WHEN {0} % 11 = 0 THEN 'owner' WHEN {0} % 11 = 1 THEN 'admin' ELSE 'member' END"


def _datasets(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("tenant_id"),
        (F.col("c_custkey") % 10).alias("created_by"),
        F.expr(_VISIBILITY.format("c_custkey")).alias("visibility"),
        F.expr(_ACCESS.format("c_custkey")).alias("member_access"),
        F.col("c_name").alias("name"),
    )


def _grants(spark, sf, key="dataset_id"):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias(key), (F.col("o_orderkey") % 10).alias("user_id"), F.col("o_orderkey").alias("grant_no")
    )


def _memberships(spark, sf):
    """Every supplier is a membership of user ``key % 10`` in its nation."""
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("tenant_id"), (key % 10).alias("user_id"), F.expr(_ROLE.format("s_suppkey")).alias("role")
    )


_D = f"""(SELECT c_custkey AS id, c_nationkey AS tenant_id, c_custkey % 10 AS created_by,
  {_VISIBILITY.format('c_custkey')} AS visibility, {_ACCESS.format('c_custkey')} AS member_access FROM customer)"""
_G = "(SELECT o_custkey AS dataset_id, o_orderkey % 10 AS user_id FROM orders)"
_M = f"(SELECT s_nationkey AS tenant_id, s_suppkey % 10 AS user_id, {_ROLE.format('s_suppkey')} AS role FROM supplier)"


def _role(*roles):
    names = ", ".join(f"'{r}'" for r in roles)
    return f"EXISTS (SELECT 1 FROM {_M} m WHERE m.tenant_id = {_TENANT} AND m.user_id = {_USER} AND m.role IN ({names}))"


_GRANTED = f"EXISTS (SELECT 1 FROM {_G} g WHERE g.user_id = {_USER} AND g.dataset_id = d.id)"
_VISIBLE = f"""SELECT d.id, d.visibility, d.created_by FROM {_D} d WHERE d.tenant_id = {_TENANT} AND (
  d.visibility = 'shared_workspace' OR d.created_by = {_USER} OR (d.visibility = 'shared_specific' AND {_GRANTED})
  OR {_role('owner')})"""


def _visible(spark, sf):
    return catalog.visible_rows(_datasets(spark, sf), _grants(spark, sf), _memberships(spark, sf), _TENANT, _USER)


def catalog_join(spark, sf):
    """Orders as datasets of the customers they come from."""
    datasets = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("kind")
    )
    sources = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind")
    )
    return catalog.list_datasets(datasets, sources)


def dataset_detail(spark, sf):
    datasets = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("kind")
    )
    sources = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return catalog.dataset_detail(datasets, sources, 42)


def grants_join(spark, sf):
    grants = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("dataset_id"), F.col("o_custkey").alias("user_id")
    )
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))
    return catalog.grants_with_users(grants, users)


def members_by_email(spark, sf):
    members = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role")
    )
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))
    return catalog.members_by_email(members, users, _TENANT).select("user_id", "email", "role")


def private_rows(spark, sf):
    rows = catalog.private_rows(_datasets(spark, sf), _memberships(spark, sf), _TENANT, _USER)
    return rows.select("id", "created_by")


def inherited_rows(spark, sf):
    runs = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("dataset_id"), "o_orderstatus")
    return catalog.inherited_rows(runs, _visible(spark, sf), "dataset_id")


def tiered_rows(spark, sf):
    items = catalog.tiered_rows(
        _datasets(spark, sf), _grants(spark, sf, "item_id"), _memberships(spark, sf), _TENANT, _USER
    )
    return items.select("id", "member_access")


def log_rows(spark, sf):
    log = table(spark, sf, "events").select(
        "event_id", "event_type", "user_id", (F.col("event_id") % 25).alias("tenant_id")
    )
    return catalog.log_rows(log, _TENANT, _USER)


QUERIES = [
    Query(
        "catalog_join",
        catalog_join,
        """SELECT o_orderkey AS id, o_custkey AS source_id, o_orderstatus AS kind, c_name AS source_name,
  c_mktsegment AS source_kind FROM orders JOIN customer ON c_custkey = o_custkey""",
    ),
    Query(
        "dataset_detail",
        dataset_detail,
        """SELECT o_orderkey AS id, o_custkey AS source_id, o_orderstatus AS kind, c_name AS source_name
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 42""",
    ),
    Query(
        "grants_join",
        grants_join,
        """SELECT o_orderkey AS dataset_id, o_custkey AS user_id, c_name AS email
FROM orders JOIN customer ON c_custkey = o_custkey""",
    ),
    Query(
        "members_by_email",
        members_by_email,
        f"SELECT c_custkey AS user_id, c_name AS email, c_mktsegment AS role FROM customer WHERE c_nationkey = {_TENANT}",
    ),
    Query("visible_rows", lambda spark, sf: _visible(spark, sf).select("id", "visibility", "created_by"), _VISIBLE),
    Query(
        "private_rows",
        private_rows,
        f"""SELECT d.id, d.created_by FROM {_D} d WHERE d.tenant_id = {_TENANT}
  AND (d.created_by = {_USER} OR {_role('owner')})""",
    ),
    Query(
        "inherited_visibility",
        inherited_rows,
        f"""SELECT o_orderkey, o_custkey AS dataset_id, o_orderstatus FROM orders
WHERE o_custkey IN (SELECT id FROM ({_VISIBLE}) v)""",
    ),
    Query(
        "tiered_access",
        tiered_rows,
        f"""SELECT d.id, d.member_access FROM {_D} d WHERE d.tenant_id = {_TENANT} AND ({_role('owner', 'admin')}
  OR ({_role('owner', 'admin', 'member')} AND (d.member_access = 'all_members'
      OR (d.member_access = 'specific_members' AND {_GRANTED}))))""",
    ),
    Query(
        "log_rows",
        log_rows,
        f"""SELECT event_id, event_type, user_id, event_id % 25 AS tenant_id FROM events
WHERE event_id % 25 = {_TENANT} OR user_id = {_USER}""",
    ),
    Query(
        "unique_violations",
        lambda spark, sf: catalog.unique_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]),
        "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    ),
]
