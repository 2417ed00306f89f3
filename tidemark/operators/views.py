"""Ready-made queries of a task tracker, each one DataFrame plan.

Tables by name: users, workspaces, workspace_members, projects, tasks, task_due_dates,
task_activity, notifications. All results are limited to the workspaces that a user is member of.
Titles are matched and sorted in lower case, which differs from full case folding for a few
letters such as the German sharp s.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]
# The domains of two columns.
STATUSES, PRIORITIES = ("DONE", "IN_PROGRESS", "TODO"), ("HIGH", "LOW", "MEDIUM")
EVENTS = {"title": "TITLE_CHANGED", "description": "DESCRIPTION_CHANGED", "priority": "PRIORITY_CHANGED", "assignee_user_id": "ASSIGNEE_CHANGED", "due_date": "DUE_DATE_CHANGED"}


def with_due_dates(t: Tables) -> DataFrame:
    """Tasks with their due date, if any; fails when it is read if a task has more than one."""
    twice = F.raise_error(F.concat(F.lit("more than one due date of task "), F.col("task_id").cast("string"))).cast("string")
    due = t["task_due_dates"].groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.min("due_date").alias("due_date"))
    due = due.select(F.col("task_id").alias("id"), F.when(F.col("n") > 1, twice).otherwise(F.col("due_date")).alias("due_date"))
    return t["tasks"].join(due, "id", "left")


def memberships(t: Tables, user: int) -> DataFrame:
    return t["workspace_members"].where(F.col("user_id") == user).select("workspace_id").distinct()


def workspaces_of(t: Tables, user: int) -> DataFrame:
    own = memberships(t, user).withColumnRenamed("workspace_id", "id")
    return t["workspaces"].join(own, "id", "left_semi").orderBy("id")


def members(t: Tables, workspace: int) -> DataFrame:
    return t["workspace_members"].where(F.col("workspace_id") == workspace).orderBy("user_id", "role")


def task_filter(query: str | None = None, status: str | None = None, priority: str | None = None, due_before: str | None = None, due_after: str | None = None) -> Column:
    """Rows without a due date meet no bound on it; bounds are inclusive ISO dates."""
    out = F.lit(True)
    if query and (needle := query.strip().lower()):
        out &= F.contains(F.lower("title"), F.lit(needle))
    for name, value in (("status", status), ("priority", priority)):
        if value is not None:
            out &= F.col(name) == value
    if due_before is not None:
        out &= F.col("due_date") <= due_before
    if due_after is not None:
        out &= F.col("due_date") >= due_after
    return out


def task_order(sort: str) -> list[Column]:
    orders = {
        "id": [F.asc("id")],
        "updated_desc": [F.desc("updated_at"), F.desc("id")],
        "due_asc": [F.asc_nulls_last("due_date"), F.asc("id")],
        "due_desc": [F.desc_nulls_last("due_date"), F.desc("id")],
        "title": [F.lower("title").asc(), F.asc("id")],
    }
    if sort not in orders:
        raise ValueError(f"sort is one of {', '.join(orders)}")
    return orders[sort]


def page(df: DataFrame, sort: str, limit: int, offset: int, most: int) -> DataFrame:
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit is from 1 to {most}, offset at least 0")
    return df.orderBy(*task_order(sort)).offset(offset).limit(limit)


def tasks_of_project(t: Tables, project: int, sort: str = "id", limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    return page(with_due_dates(t).where(F.col("project_id") == project).where(task_filter(**filters)), sort, limit, offset, 200)


def accessible_tasks(t: Tables, user: int, assignee: int | None = None, workspace: int | None = None, project: int | None = None, **filters) -> DataFrame:
    """Tasks in the user's workspaces with the names around them; unsorted, so that it can be counted."""
    projects = t["projects"].join(memberships(t, user), "workspace_id", "left_semi")
    if workspace is not None:
        projects = projects.where(F.col("workspace_id") == workspace)
    if project is not None:
        projects = projects.where(F.col("id") == project)
    projects = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), "workspace_id")
    spaces = t["workspaces"].select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name"))
    people = t["users"].select(F.col("id").alias("assignee_user_id"), F.col("name").alias("assignee_name"))
    tasks = with_due_dates(t)
    if assignee is not None:
        tasks = tasks.where(F.col("assignee_user_id") == assignee)
    tasks = tasks.where(task_filter(**filters)).join(projects, "project_id").join(spaces, "workspace_id")
    return tasks.join(people, "assignee_user_id", "left")


def assigned_tasks(t: Tables, user: int, sort: str = "updated_desc", limit: int = 50, offset: int = 0, **where) -> tuple[DataFrame, int]:
    found = accessible_tasks(t, user, assignee=user, **where)
    return page(found, sort, limit, offset, 100), found.count()


def dashboard(t: Tables, user: int, today: str, workspace: int | None = None) -> DataFrame:
    """One row of counts, one pass over the tasks; values of a domain that don't occur count zero."""
    own = memberships(t, user)
    if workspace is not None:
        own = own.where(F.col("workspace_id") == workspace)
    projects = t["projects"].join(own, "workspace_id", "left_semi").select(F.col("id").alias("project_id"))
    tasks = with_due_dates(t).join(projects, "project_id", "left_semi")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    open_ = F.col("due_date").isNotNull() & (F.col("status") != "DONE")
    counts = tasks.agg(
        F.count(F.lit(1)).alias("task_count"),
        n(F.col("assignee_user_id") == user).alias("assigned_to_me"),
        n(open_ & (F.col("due_date") < today)).alias("overdue_count"),
        n(open_ & (F.col("due_date") >= today)).alias("upcoming_count"),
        n(F.col("status") == "DONE").alias("completed_count"),
        *(n(F.col("status") == s).alias(f"status_{s.lower()}") for s in STATUSES),
        *(n(F.col("priority") == p).alias(f"priority_{p.lower()}") for p in PRIORITIES),
    )
    spaces = own.agg(F.count(F.lit(1)).alias("workspace_count"))
    return spaces.crossJoin(projects.agg(F.count(F.lit(1)).alias("project_count"))).crossJoin(counts)  # one row each


def activity(t: Tables, task: int) -> DataFrame:
    """Newest first; the rows of deleted tasks are still there."""
    return t["task_activity"].where(F.col("task_id") == task).orderBy(F.desc("created_at"), F.desc("id"))


def notifications(t: Tables, user: int, unread: bool = False) -> DataFrame:
    """Not dismissed and still visible, newest first; of a deleted task the links are blank."""
    own = t["notifications"].where((F.col("recipient_user_id") == user) & F.col("dismissed_at").isNull())
    if unread:
        own = own.where(~F.col("is_read"))
    mine = memberships(t, user).select("workspace_id", F.lit(True).alias("member"))
    homes = t["tasks"].select(F.col("id").alias("task_id"), F.col("project_id").alias("home")).join(t["projects"].select(F.col("id").alias("home"), F.col("workspace_id").alias("home_workspace")), "home", "left")
    out = own.join(mine, "workspace_id", "left").join(homes, "task_id", "left")
    lives = F.col("home").isNotNull()
    out = out.where(F.col("workspace_id").isNull() | F.coalesce("member", F.lit(False)))
    out = out.where(~lives | F.col("task_id").isNull() | F.col("home_workspace").eqNullSafe(F.col("workspace_id")) & F.col("workspace_id").isNotNull())
    gone = F.col("task_id").isNotNull() & ~lives
    blank = {c: F.when(~gone, F.col(c)) for c in ("project_id", "task_id")}
    return out.withColumns(blank).select(*t["notifications"].columns).orderBy(F.desc("created_at"), F.desc("id"))


def unread_count(t: Tables, user: int) -> int:
    return notifications(t, user, unread=True).count()


def all_read(t: Tables, user: int) -> DataFrame:
    """The notifications table after a user has read theirs."""
    own = (F.col("recipient_user_id") == user) & F.col("dismissed_at").isNull()
    return t["notifications"].withColumn("is_read", F.col("is_read") | own)


def next_id(*tables: tuple[DataFrame, str]) -> int:
    """One more than the largest id in any of the columns."""
    tops = [df.agg(F.max(c)).first()[0] or 0 for df, c in tables]
    return max(tops) + 1


def task_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """A typed event for each field that differs, by task: task_id, event_type, field, old, new."""
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, F.col("a.id") == F.col("b.id"))
    was, is_ = F.col("a.status"), F.col("b.status")
    kind = F.when((was != "DONE") & (is_ == "DONE"), "TASK_COMPLETED").when((was == "DONE") & (is_ != "DONE"), "TASK_REOPENED").otherwise("STATUS_CHANGED")
    kinds = {f: F.lit(e) for f, e in EVENTS.items()} | {"status": kind}
    fields = [f for f in ("title", "description", "status", "priority", "assignee_user_id", "due_date") if f in before.columns]
    events = F.array(*(F.struct(kinds[f].alias("event_type"), F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("old"), F.col(f"b.{f}").cast("string").alias("new")) for f in fields))
    out = both.select(F.col("a.id").alias("task_id"), F.explode(events).alias("e")).select("task_id", "e.*")
    return out.where(~F.col("old").eqNullSafe(F.col("new")))


def _with_rows(table: DataFrame, rows: DataFrame, now: int | None) -> DataFrame:
    """A table with rows put in, numbered on from its largest id in the order of their tasks; columns that they lack are null.

    The numbers come from one task, which gets the rows of one statement only.
    """
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    at = F.unix_millis(F.current_timestamp()) if now is None else F.lit(now)
    rows = rows.withColumns({"n": F.row_number().over(Window.orderBy("task_id")), "created_at": at}).crossJoin(top)  # one row
    rows = rows.withColumn("id", F.col("top") + F.col("n"))
    cells = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema]
    return table.unionByName(rows.select(*cells))


def without_task(t: Tables, task: int, actor: int | None = None, now: int | None = None) -> dict[str, DataFrame]:
    """The tables after a task was deleted with its notes and due date; its activity stays and tells of it.

    Without an actor it is the one who made the task.
    """
    out = {"tasks": t["tasks"].where(F.col("id") != task), "task_due_dates": t["task_due_dates"].where(F.col("task_id") != task)}
    if "notes" in t:
        out["notes"] = t["notes"].where(F.col("task_id") != task)
    homes = t["projects"].select(F.col("id").alias("project_id"), "workspace_id")
    maker = F.col("created_by_user_id") if actor is None and "created_by_user_id" in t["tasks"].columns else F.lit(actor).cast("long")
    gone = t["tasks"].where(F.col("id") == task).join(homes, "project_id")
    told = gone.select(F.col("id").alias("task_id"), "project_id", "workspace_id", maker.alias("actor_user_id"), F.lit("TASK_DELETED").alias("event_type"))
    return {**t, **out, "task_activity": _with_rows(t["task_activity"], told, now)}


def without_workspace(t: Tables, workspace: int) -> dict[str, DataFrame]:
    """The tables after an empty workspace was deleted."""
    own = {"workspaces": "id", "workspace_members": "workspace_id", "task_activity": "workspace_id", "notifications": "workspace_id"}
    return {**t, **{n: t[n].where(~F.col(c).eqNullSafe(F.lit(workspace))) for n, c in own.items() if n in t}}


def without_member(t: Tables, workspace: int, user: int, actor: int | None = None, now: int | None = None) -> dict[str, DataFrame]:
    """The tables after a user left a workspace; their tasks there have no assignee, the activity tells of each.

    Without an actor it is the owner. Someone whom another removed gets a notification.
    """
    projects = t["projects"].where(F.col("workspace_id") == workspace).select(F.col("id").alias("project_id"), F.lit(True).alias("inside"))
    tasks = t["tasks"].join(projects, "project_id", "left")
    freed = F.coalesce(F.coalesce("inside", F.lit(False)) & (F.col("assignee_user_id") == user), F.lit(False))
    left = tasks.withColumn("assignee_user_id", F.when(~freed, F.col("assignee_user_id"))).select(*t["tasks"].columns)
    here = F.col("workspace_id") == workspace
    rest = t["workspace_members"].where(~(here & (F.col("user_id") == user)))
    details = json.dumps({"field": "assignee_user_id", "from": user, "to": None, "reason": "membership_removed"}, sort_keys=True, separators=(",", ":"))
    told = tasks.where(freed).select(F.col("id").alias("task_id"), "project_id", F.lit(workspace).alias("workspace_id"), F.lit("ASSIGNEE_CHANGED").alias("event_type"), F.lit(details).alias("details"))
    if actor is None:
        owner = t["workspace_members"].where(here & (F.col("role") == "OWNER")).agg(F.min("user_id").alias("actor_user_id"))
        told = told.crossJoin(owner)  # one row
    else:
        told = told.withColumn("actor_user_id", F.lit(actor))
    out = {"tasks": left, "workspace_members": rest, "task_activity": _with_rows(t["task_activity"], told, now)}
    if actor != user and "notifications" in t:
        cells = {"recipient_user_id": F.lit(user), "event_type": F.lit("WORKSPACE_REMOVED"), "summary": F.lit("Your access to a workspace was removed."), "task_id": F.lit(None).cast("long"), "is_read": F.lit(False)}
        one = t["workspace_members"].where(here & (F.col("user_id") == user)).limit(1).select(*(c.alias(n) for n, c in cells.items()))
        out["notifications"] = _with_rows(t["notifications"], one, now)
    return {**t, **out}


def project_progress(t: Tables) -> DataFrame:
    """Per project: tasks, tasks done, rounded percentage, and tasks by status."""
    done = F.sum((F.col("status") == "DONE").cast("long"))
    per = t["tasks"].groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), done.alias("done"), *(F.sum((F.col("status") == s).cast("long")).alias(s.lower() + "_tasks") for s in STATUSES))
    return per.withColumn("percent", F.round(100.0 * F.col("done") / F.col("total")).cast("long"))
