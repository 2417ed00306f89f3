import pytest
from pyspark.errors import PySparkException

from tidemark.operators import views as V


@pytest.fixture(scope="module")
def t(spark):
    rows = {
        "users": ("id long, name string", [(1, "Ada"), (2, "Ben")]),
        "workspaces": ("id long, name string", [(1, "W1"), (2, "W2"), (3, "W3")]),
        "workspace_members": ("workspace_id long, user_id long, role string", [(2, 1, "OWNER"), (1, 1, "MEMBER"), (3, 2, "OWNER"), (1, 2, "MEMBER")]),
        "projects": ("id long, workspace_id long, name string", [(1, 1, "P1"), (2, 2, "P2"), (3, 3, "P3")]),
        "tasks": (
            "id long, project_id long, title string, description string, status string, priority string, assignee_user_id long, updated_at long",
            [(1, 1, "Alpha", None, "TODO", "LOW", 1, 10), (2, 1, "beta", None, "DONE", "HIGH", None, 20), (3, 2, "Gamma", None, "TODO", "LOW", 1, 20), (4, 3, "delta", None, "TODO", "LOW", 1, 30)],
        ),
        "task_due_dates": ("task_id long, due_date string", [(1, "2026-01-02"), (2, "2026-01-01"), (4, "2026-01-01")]),
        "task_activity": ("id long, task_id long, workspace_id long, created_at long", [(1, 9, 1, 5), (2, 9, 1, 5), (3, 9, 1, 4), (4, 1, 1, 4)]),
        "notifications": (
            "id long, recipient_user_id long, workspace_id long, project_id long, task_id long, created_at long, is_read boolean, dismissed_at long",
            [(1, 1, 1, 1, 1, 5, False, None), (2, 1, 3, 3, 4, 6, False, None), (3, 1, 1, 1, 99, 7, True, None), (4, 1, None, None, None, 8, False, None), (5, 1, 1, 1, 1, 9, False, 3), (6, 2, 1, 1, 1, 9, False, None), (7, 1, 2, 1, 1, 9, False, None)],
        ),
        "notes": ("id long, task_id long", [(1, 1), (2, 2)]),
    }
    return {n: spark.createDataFrame(r, s) for n, (s, r) in rows.items()}


def ids(df):
    return [r.id for r in df.collect()]


def test_task_lists(t):
    assert ids(V.tasks_of_project(t, 1, sort="title")) == [1, 2]
    assert ids(V.tasks_of_project(t, 1, query=" BET ")) == [2]
    df, total = V.assigned_tasks(t, 1)
    assert ids(df) == [3, 1] and total == 2 and df.first().workspace_name == "W2" and df.first().assignee_name == "Ada"
    assert ids(V.page(V.accessible_tasks(t, 1), "due_desc", 9, 0, 100)) == [1, 2, 3]
    assert ids(V.page(V.accessible_tasks(t, 1), "due_asc", 9, 1, 100)) == [1, 3]
    assert ids(V.accessible_tasks(t, 1, due_before="2026-01-01")) == [2]
    assert ids(V.accessible_tasks(t, 1, workspace=3)) == []
    with pytest.raises(ValueError):
        V.task_order("x")
    with pytest.raises(ValueError):
        V.page(t["tasks"], "id", 0, 0, 100)


def test_dashboard(t):
    r = V.dashboard(t, 1, "2026-01-02").first().asDict()
    assert r == {"workspace_count": 2, "project_count": 2, "task_count": 3, "assigned_to_me": 2, "overdue_count": 0, "upcoming_count": 1, "completed_count": 1, "status_done": 1, "status_in_progress": 0, "status_todo": 2, "priority_high": 1, "priority_low": 2, "priority_medium": 0}
    assert V.dashboard(t, 1, "2026-01-02", workspace=3).first().task_count == 0


def test_activity_and_notifications(t):
    assert ids(V.activity(t, 9)) == [2, 1, 3]
    got = V.notifications(t, 1).collect()
    assert [r.id for r in got] == [4, 3, 1] and got[1].task_id is None and got[1].project_id is None
    assert V.unread_count(t, 1) == 2
    assert V.all_read(t, 1).where("not is_read").count() == 2


def test_memberships_and_ids(t):
    assert ids(V.workspaces_of(t, 1)) == [1, 2]
    assert [r.user_id for r in V.members(t, 1).collect()] == [1, 2]
    assert V.next_id((t["tasks"], "id"), (t["task_activity"], "task_id")) == 10
    assert V.next_id((t["tasks"].limit(0), "id")) == 1


def test_changes_and_cascades(spark, t):
    with pytest.raises(PySparkException, match="more than one due date of task 1"):
        V.with_due_dates(t | {"task_due_dates": t["task_due_dates"].unionByName(t["task_due_dates"].limit(1))}).collect()
    before = V.with_due_dates(t)
    after = before.withColumns({"status": V.F.when(V.F.col("id") == 1, "DONE").when(V.F.col("id") == 2, "TODO").otherwise(V.F.col("status")), "due_date": V.F.lit(None).cast("string")})
    got = sorted((r.task_id, r.event_type, r.old, r.new) for r in V.task_changes(before, after).collect())
    assert got == [(1, "DUE_DATE_CHANGED", "2026-01-02", None), (1, "TASK_COMPLETED", "TODO", "DONE"), (2, "DUE_DATE_CHANGED", "2026-01-01", None), (2, "TASK_REOPENED", "DONE", "TODO"), (4, "DUE_DATE_CHANGED", "2026-01-01", None)]
    x = V.without_task(t, 1, now=77)
    assert ids(x["tasks"].orderBy("id")) == [2, 3, 4] and ids(x["notes"]) == [2]
    assert [tuple(r) for r in x["task_activity"].where("id > 4").collect()] == [(5, 1, 1, 77)]
    assert V.without_task(t, 99)["task_activity"].count() == 4
    x = V.without_member(t, 1, 1, actor=2, now=78)
    assert [tuple(r) for r in x["task_activity"].where("id > 4").collect()] == [(5, 1, 1, 78)]
    assert [(r.id, r.recipient_user_id, r.workspace_id, r.task_id, r.created_at, r.is_read) for r in x["notifications"].where("id > 7").collect()] == [(8, 1, None, None, 78, False)]
    assert V.without_member(t, 1, 1, actor=1)["notifications"].count() == 7
    kinds = spark.createDataFrame([], "id long, task_id long, project_id long, workspace_id long, actor_user_id long, event_type string, details string, created_at long")
    told = V.without_member(t | {"task_activity": kinds}, 2, 1, now=5)["task_activity"].collect()
    assert [tuple(r) for r in told] == [(1, 3, 2, 2, 1, "ASSIGNEE_CHANGED", '{"field":"assignee_user_id","from":1,"reason":"membership_removed","to":null}', 5)]
    assert [(r.id, r.assignee_user_id) for r in x["tasks"].orderBy("id").collect()] == [(1, None), (2, None), (3, 1), (4, 1)]
    assert V.without_workspace(t, 1)["notifications"].count() == 3
    assert [tuple(r) for r in V.project_progress(t).orderBy("project_id").select("total", "done", "percent").collect()] == [(2, 1, 50), (1, 0, 0), (1, 0, 0)]
