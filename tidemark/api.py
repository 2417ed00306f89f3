"""Results in the shape of JSON."""

from __future__ import annotations

from dataclasses import asdict

from .session import Engine, QueryResult


def run_profiled(engine: Engine, sql: str) -> dict:
    out = engine.execute_profiled(sql)
    if not isinstance(out.result, QueryResult):
        return {"kind": "command", "affected_rows": out.result.affected_rows, "profile": None}
    columns = [{"name": c.name, "type": c.type.value, "nullable": c.nullable} for c in out.result.columns]
    rows = [list(r) for r in out.result.rows]
    return {"kind": "query", "columns": columns, "rows": rows, "row_count": len(rows), "profile": asdict(out.profile) if out.profile else None}
