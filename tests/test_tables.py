"""Catalogue, conversation and event tables."""

import pytest
from pyspark.sql import functions as F

from tablewright.errors import OperationError
from tablewright.operators import catalog
from tablewright.operators import events as ev


@pytest.fixture(scope="module")
def world(spark):
    datasets = spark.createDataFrame(
        [
            (1, "t1", "ann", "private", "admins_only"),
            (2, "t1", "ann", "shared_workspace", "all_members"),
            (3, "t1", "ann", "shared_specific", "specific_members"),
            (4, "t1", "bob", "private", "admins_only"),
            (5, "t2", "eve", "shared_workspace", "all_members"),
        ],
        "id int, tenant_id string, created_by string, visibility string, member_access string",
    )
    grants = spark.createDataFrame([(3, "bob"), (3, "bob"), (1, "bob"), (5, "cal")], "dataset_id int, user_id string")
    members = spark.createDataFrame(
        [("t1", "own", "owner"), ("t1", "adm", "admin"), ("t1", "ann", "member"), ("t1", "bob", "member"), ("t1", "cal", "member"), ("t2", "own", "member")],
        "tenant_id string, user_id string, role string",
    )
    return datasets, grants, members


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    "tenant, user, seen",
    [("t1", "own", [1, 2, 3, 4]), ("t1", "ann", [1, 2, 3]), ("t1", "bob", [2, 3, 4]), ("t1", "cal", [2]), ("t2", "own", [5])],
)
def test_visible_rows(world, tenant, user, seen):
    assert ids(catalog.visible_rows(*world, tenant, user)) == seen


def test_private_and_inherited(spark, world):
    datasets, grants, members = world
    assert ids(catalog.private_rows(datasets, members, "t1", "bob")) == [4]
    assert ids(catalog.private_rows(datasets, members, "t1", "own")) == [1, 2, 3, 4]
    runs = spark.createDataFrame([(10, 1), (11, 3), (12, 3)], "run int, dataset_id int")
    seen = catalog.inherited_rows(runs, catalog.visible_rows(*world, "t1", "bob"), "dataset_id")
    assert sorted(r["run"] for r in seen.collect()) == [11, 12]


@pytest.mark.parametrize(
    "user, seen", [("own", [1, 2, 3, 4]), ("adm", [1, 2, 3, 4]), ("bob", [2, 3]), ("cal", [2]), ("stranger", [])]
)
def test_tiered_rows(world, user, seen):
    datasets, grants, members = world
    items = grants.withColumnRenamed("dataset_id", "item_id")
    assert ids(catalog.tiered_rows(datasets, items, members, "t1", user)) == seen


def test_lists(spark, world):
    datasets = world[0].withColumn("source_id", F.lit(7))
    sources = spark.createDataFrame([(7, "files", "csv")], "id int, name string, kind string")
    listed = catalog.list_datasets(datasets, sources)
    assert listed.count() == 5 and {"source_name", "source_kind"} <= set(listed.columns)
    assert catalog.dataset_detail(datasets, sources, 3).first()["source_name"] == "files"
    users = spark.createDataFrame([("ann", "z@x"), ("bob", "a@x")], "id string, email string")
    members = world[2].filter(F.col("user_id").isin("ann", "bob"))
    assert [r["email"] for r in catalog.members_by_email(members, users, "t1").collect()] == ["a@x", "z@x"]


def test_unique(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None)], "t int, name string")
    assert [tuple(r) for r in catalog.unique_violations(df, ["t", "name"]).collect()] == [(1, "a", 2)]
    with pytest.raises(OperationError, match="occurs 2 times"):
        catalog.assert_unique(df, ["t", "name"])
    catalog.assert_unique(df.filter("t = 2"), ["t", "name"])


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(
        [
            ("c1", 1, "system", "brief", None, None),
            ("c1", 2, "user", "  first\n question " + "x" * 90, None, None),
            ("c1", 3, "assistant", 'sure\nSUGGESTIONS:["a"]', '{"tool_calls":[{"name":"dedupe","id":"u1"}]}', '{"prompt":5,"completion":2}'),
            ("c1", 4, "system", "{result}", '{"tool_use_id":"u1"}', None),
            ("c1", 5, "user", "more", None, None),
            ("c2", 1, "assistant", "hi", "no json", '{"prompt":1}'),
        ],
        "conv string, turn int, role string, text string, payload string, usage string",
    ).repartition(3)


def test_transcript_and_history(messages):
    told = ev.transcript(messages, "conv", "turn").collect()
    assert [(r["conv"], r["turn"]) for r in told] == [("c1", 2), ("c1", 3), ("c1", 5), ("c2", 1)]
    got = ev.history(messages, "conv", "turn", payload="payload").collect()
    assert [(r["turn"], r["role"], r["tool_use_id"]) for r in got] == [
        (2, "user", None),
        (3, "assistant", None),
        (4, "tool", "u1"),
        (5, "user", None),
        (1, "assistant", None),
    ]
    assert got[1]["tool_calls"] == '[{"id":"u1","name":"dedupe"}]' and got[4]["tool_calls"] is None
    assert [r["role"] for r in ev.history(messages, "conv", "turn").collect()] == ["user", "assistant", "user", "assistant"]


def test_titles_tools_usage_suggestions(messages):
    assert [tuple(r) for r in ev.titles(messages, "conv", "turn").collect()] == [("c1", "first question " + "x" * 65)]
    assert {r["turn"]: r["executed_tools"] for r in ev.executed_tools(messages, "payload").filter("conv = 'c1'").collect()}[3] == ["dedupe"]
    assert {r["conv"]: r["total_tokens"] for r in ev.token_usage(messages, "conv", "usage").collect()} == {"c1": 7, "c2": 1}
    split = ev.split_suggestions(messages).filter("turn = 3").first()
    assert (split["text"], split["suggestions"]) == ("sure", ["a"])


def test_unique_slugs(spark):
    df = spark.createDataFrame([(1, "Acme"), (2, "acmé"), (3, "!!"), (4, "Other")], "id int, name string")
    got = {r["id"]: r["slug"] for r in ev.unique_slugs(df, "id", "name").collect()}
    assert got[1] == "acme" and got[4] == "other"
    assert got[2] == "acme--2" and got[3] == "row--3"
    assert len(set(got.values())) == 4


def test_unique_slugs_of_equal_names(spark):
    same = spark.range(500_000).selectExpr("id", "'Same name' AS name")
    near = spark.createDataFrame([(-1, "same name 1"), (-2, "row"), (-3, "")], "id long, name string")
    slugs = ev.unique_slugs(same.union(near), "id", "name")
    assert slugs.select("slug").distinct().count() == 500_003
    texts = spark.createDataFrame([("7", "a"), ("07", "a"), ("x", "a"), ("X", "a")], "id string, name string")
    assert ev.unique_slugs(texts, "id", "name").select("slug").distinct().count() == 4


def test_rate_windows_and_active_rows(spark):
    df = spark.sql(
        "SELECT 'u' AS who, timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, CAST(id AS int) * 10) AS at FROM range(8)"
    )
    got = ev.over_limit(df, "who", "at", 5, "1 hour").collect()
    assert [(str(r["window_start"]), r["events"]) for r in got] == [("2024-01-01 10:00:00", 6)]
    assert ev.over_limit(df, "who", "at", 6, "1 hour").count() == 0
    assert ev.RATE_LIMITS["login"] == (20, "1 minute")
    sessions = spark.sql(
        "SELECT * FROM VALUES (1, NULL, timestamp_ntz'2024-02-01'), (2, timestamp_ntz'2024-01-01', timestamp_ntz'2024-02-01'), "
        "(3, NULL, timestamp_ntz'2024-01-01') AS t(id, revoked_at, expires_at)"
    )
    now = F.lit("2024-01-15").cast("timestamp_ntz")
    assert ids(ev.active_rows(sessions, now)) == [1]


def test_audit_append_and_log_rows(spark, tmp_path):
    path = str(tmp_path / "audit")
    line = [("login", "u1", "t1", "::1", "agent", '{"a":1}'), ("login", "u2", None, None, None, None)]
    df = spark.createDataFrame(line, "event_type string, user_id string, tenant_id string, ip string, user_agent string, metadata string")
    df = df.withColumn("at", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
    ev.append_audit(df, path)
    ev.append_audit(df.limit(1), path)
    log = spark.read.parquet(path)
    assert log.count() == 3
    assert [r["events"] for r in ev.audit_summary(log, "event_type", "at").collect()] == [3]
    assert catalog.log_rows(log, "t1", "nobody").count() == 2 and catalog.log_rows(log, "t9", "u2").count() == 1
