import operator
import random
import threading

import pytest

from tidemark import errors as E
from tidemark.api import run_profiled
from tidemark.session import CommandResult, Engine
from tidemark.types import Column, DataType, Schema

BIG, FLT, BOOL, STR = DataType.BIGINT, DataType.FLOAT, DataType.BOOLEAN, DataType.VARCHAR


def make(engine, name, columns, rows):
    """columns: name, type, and ? for nullable."""
    cols = []
    for c in columns.split(", "):
        n, t = c.rstrip("?").split(" ")
        cols.append(Column(n, DataType(t), c.endswith("?"), 40 if t == "VARCHAR" else None))
    engine.create_table(name, Schema(tuple(cols))).insert_many(rows)


SITES = ["north", "south", "Quay", "", "o'hill", None]


def random_rows(rng, n):
    """Readings of gauges, some repeated, many values missing."""
    some = lambda v, p=0.2: None if rng.random() < p else v
    return [(k, rng.choice(SITES), some(rng.randint(-4, 4)), some(rng.choice([-1.5, 0.0, 0.25, 3.0])), some(rng.random() < 0.5), rng.choice([2**40, -(2**40), 7])) for k in range(n)]


GAUGES = ["serial", "site", "reading", "depth", "wet", "stamp"]
READINGS = random_rows(random.Random(81), 36)
BASINS = [("north", 3, "upper"), ("Quay", -4, None), ("Quay", 0, "lower"), ("", None, "lower"), ("delta", 3, "upper"), (None, 2, "upper")]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    with Engine(spark, str(tmp_path_factory.mktemp("db"))) as e:
        make(e, "gauges", "serial INTEGER, site VARCHAR?, reading INTEGER?, depth FLOAT?, wet BOOLEAN?, stamp BIGINT", READINGS)
        make(e, "basins", "code VARCHAR?, area INTEGER?, part VARCHAR?", BASINS)
        make(e, "heights", "h BIGINT?, k INTEGER", [(2**62, 1), (2**62, 2), (-(2**62), 3), (None, 4)])
        yield e


# A model of the dialect: predicates are functions of a row as a dict; a comparison with None is false.

OPS = {"=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def literal(v):
    return {True: "TRUE", False: "FALSE"}[v] if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def random_predicate(rng, columns, depth=0):
    """columns: name -> values to compare with. (text, function)"""
    kind = rng.random()
    if depth < 3 and kind < 0.45:
        word, join = rng.choice([("AND", all), ("OR", any)])
        parts = [random_predicate(rng, columns, depth + 1) for _ in range(2)]
        return f" {word} ".join(f"({t})" for t, _ in parts), lambda r, p=parts, j=join: j([f(r) for _, f in p])
    if depth < 3 and kind < 0.6:
        text, f = random_predicate(rng, columns, depth + 1)
        return f"NOT ({text})", lambda r, f=f: not f(r)
    name = rng.choice(sorted(columns))
    if kind < 0.75:
        no = rng.random() < 0.5
        return f"{name} IS {'NOT ' if no else ''}NULL", lambda r, n=name, no=no: (r[n] is not None) == no
    op, value = rng.choice(sorted(OPS)), rng.choice(columns[name])
    if isinstance(value, bool):
        op = rng.choice(["=", "!="])
    return f"{name} {op} {literal(value)}", lambda r, n=name, o=OPS[op], v=value: r[n] is not None and o(r[n], v)


COMPARED = {"serial": [5, 17, 30], "site": ["north", "", "o'hill", "Quay"], "reading": [-2, 0, 3], "depth": [0.25, -1.5, 9.0], "wet": [True, False], "stamp": [7, 2**40]}


@pytest.mark.parametrize("seed", range(24))
def test_selects_follow_a_model(engine, seed):
    rng = random.Random(seed)
    rows = [dict(zip(GAUGES, r, strict=True)) for r in READINGS]
    shown = rng.sample(GAUGES, rng.randint(1, 5))
    sql = f"SELECT {', '.join(n.upper() if rng.random() < 0.2 else n for n in shown)} FROM gauges"
    if rng.random() < 0.8:
        text, f = random_predicate(rng, COMPARED)
        sql, rows = f"{sql} WHERE {text}", [r for r in rows if f(r)]
    if rng.random() < 0.7:
        keys = [(n, rng.random() < 0.5) for n in rng.sample(GAUGES, rng.randint(1, 3))] + [("serial", False)]
        keys = list({n: (n, d) for n, d in reversed(keys)}.values())[::-1]
        sql += " ORDER BY " + ", ".join(f"{n} DESC" if d else rng.choice([n, f"{n} ASC"]) for n, d in keys)
        for name, down in reversed(keys):
            rows = stable(rows, name, down)
    if rng.random() < 0.6:
        n, skip = rng.choice([0, 1, 5, 100]), rng.choice([0, 0, 3, 50])
        sql, rows = f"{sql} LIMIT {n}" + (f" OFFSET {skip}" if skip else ""), rows[skip : skip + n]
    assert list(engine.execute(sql + rng.choice(["", ";"])).rows) == [tuple(r[n] for n in shown) for r in rows], sql


def model_aggregate(function, values):
    known = [v for v in values if v is not None]
    if function == "COUNT":
        return len(known)
    if not known:
        return None
    return {"SUM": sum, "MIN": min, "MAX": max, "AVG": lambda v: sum(v) / len(v)}[function](known)


AGGREGATES = [("COUNT", "site"), ("COUNT", "depth"), ("SUM", "reading"), ("SUM", "depth"), ("AVG", "reading"), ("AVG", "depth"), ("MIN", "site"), ("MAX", "wet"), ("MIN", "wet"), ("MAX", "stamp"), ("SUM", "stamp"), ("MIN", "depth")]


@pytest.mark.parametrize("seed", range(14))
def test_aggregates_follow_a_model(engine, seed):
    rng = random.Random(100 + seed)
    rows = [dict(zip(GAUGES, r, strict=True)) for r in READINGS]
    text, f = random_predicate(rng, COMPARED)
    rows = [r for r in rows if f(r)]
    keys = rng.sample(["site", "reading", "depth", "wet"], rng.choice([0, 1, 1, 2]))
    made = rng.sample(AGGREGATES, rng.randint(1, 4))
    # keys and aggregates may be mixed
    items = [("key", k) for k in keys] + [("agg", m) for m in made] + [("star", None)]
    rng.shuffle(items)
    label = {"key": lambda x: x, "agg": lambda x: f"{x[0]}({x[1]})", "star": lambda _: "COUNT(*)"}
    sql = f"SELECT {', '.join(label[k](x) for k, x in items)} FROM gauges WHERE {text}"
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    if keys:
        sql += f" GROUP BY {', '.join(keys)}"
    else:
        groups = groups or {(): []}
    value = {"key": lambda x, g: g[0][x], "agg": lambda x, g: model_aggregate(x[0], [r[x[1]] for r in g]), "star": lambda _, g: len(g)}
    want = [tuple(value[k](x, g) for k, x in items) for g in groups.values()]
    got = engine.execute(sql)
    assert list(got.rows) == want, sql  # groups come in the order of their first rows
    assert got.names == tuple({"key": lambda x: x, "agg": lambda x: f"{x[0].lower()}_{x[1]}", "star": lambda _: "count_star"}[k](x) for k, x in items)


@pytest.mark.parametrize("seed", range(10))
def test_joins_follow_a_model(engine, seed):
    rng = random.Random(200 + seed)
    both = [dict(zip(GAUGES, g, strict=True)) | {"code": b[0], "area": b[1], "part": b[2], "at": (i, j)} for i, g in enumerate(READINGS) for j, b in enumerate(BASINS)]
    left, right = rng.choice([("site", "code"), ("reading", "area")])
    on = [f"gauges.{left}", f"basins.{right}"]
    rng.shuffle(on)
    rows = [r for r in both if r[left] is not None and r[left] == r[right]]
    text, f = random_predicate(rng, COMPARED | {"area": [3, 0], "part": ["upper", "lower"]})
    rows = [r for r in rows if f(r)]
    shown = rng.sample([*GAUGES, "code", "area", "part"], 3)
    sql = f"SELECT {', '.join(shown)} FROM gauges {rng.choice(['JOIN', 'INNER JOIN'])} basins ON {' = '.join(on)} WHERE {text}"
    if rng.random() < 0.5:
        key, down = rng.choice(["part", "depth", "area"]), rng.random() < 0.5
        sql, rows = f"{sql} ORDER BY {key}{' DESC' if down else ''} LIMIT 9", stable(rows, key, down)[:9]
    assert list(engine.execute(sql).rows) == [tuple(r[n] for n in shown) for r in rows], sql


def stable(rows, name, down):
    """Sorted by one column; rows of equal values stay as they were."""
    known = sorted({r[name] for r in rows if r[name] is not None}, reverse=down)
    order = [None, *known] if down else [*known, None]
    return [r for v in order for r in rows if (r[name] is None) == (v is None) and r[name] == v]


def test_exact_sums_and_grouped_joins(engine):
    run = lambda sql: engine.execute(sql)
    assert run("SELECT SUM(h), AVG(h), COUNT(h) FROM heights").rows == ((2**62, float(2**62) / 3, 3),)
    with pytest.raises(E.ExecutionError):
        run("SELECT SUM(h) FROM heights WHERE h > 0 AND k < 3")
    assert run("SELECT basins.part, COUNT(*), MAX(basins.area) FROM gauges JOIN basins ON gauges.site = basins.code GROUP BY basins.part ORDER BY count_star DESC LIMIT 1").names == ("part", "count_star", "max_basins_area")
    assert run("SELECT k FROM heights WHERE k < 3000000000 AND NOT h > 5 OR h = 1").rows == ((3,), (4,))


def test_names_types_and_nullability(engine):
    r = engine.execute("SELECT COUNT(*), SUM(reading), AVG(reading), MIN(site), MAX(wet) FROM gauges")
    assert [(c.name, c.type, c.nullable, c.max_length) for c in r.columns] == [("count_star", BIG, False, None), ("sum_reading", BIG, True, None), ("avg_reading", FLT, True, None), ("min_site", STR, True, 40), ("max_wet", BOOL, True, None)]
    assert engine.frame("SELECT site FROM gauges").columns == ["site"]


@pytest.mark.parametrize(
    "sql, error",
    [
        ("SELECT nope FROM gauges", E.ColumnNotFoundError),
        ("SELECT site FROM lakes", E.TableNotFoundError),
        ("SELECT site, SITE FROM gauges", E.DuplicateColumnError),
        ("SELECT gauges.site FROM gauges", E.SQLBindingError),
        ("SELECT site FROM gauges WHERE gauges.wet = TRUE", E.SQLBindingError),
        ("SELECT site FROM gauges WHERE reading = '4'", E.TypeMismatchError),
        ("SELECT site FROM gauges WHERE serial = 4.0", E.TypeMismatchError),
        ("SELECT site FROM gauges WHERE wet = TRUE OR (depth > 1.0 AND site < 0)", E.TypeMismatchError),
        ("SELECT site FROM gauges ORDER BY wet, WET DESC", E.DuplicateColumnError),
        ("SELECT * FROM gauges JOIN basins ON gauges.site = basins.code", E.SQLBindingError),
        ("SELECT area FROM basins JOIN Basins ON basins.area = basins.area", E.SQLBindingError),
        ("SELECT area FROM gauges JOIN basins ON gauges.depth = basins.area", E.TypeMismatchError),
        ("SELECT area FROM gauges JOIN basins ON gauges.site = gauges.site", ValueError),
        ("SELECT area FROM gauges JOIN basins ON gauges.site = lakes.code", E.ColumnNotFoundError),
        ("SELECT AVG(site) FROM gauges", E.TypeMismatchError),
        ("SELECT MAX(depth), MAX(DEPTH) FROM gauges", E.DuplicateColumnError),
        ("SELECT * FROM gauges GROUP BY wet", E.SQLBindingError),
        ("SELECT wet FROM gauges GROUP BY wet", E.SQLBindingError),
        ("SELECT site, COUNT(*) FROM gauges GROUP BY wet", E.SQLBindingError),
        ("SELECT COUNT(*) FROM gauges GROUP BY wet, Wet", E.SQLBindingError),
        ("SELECT COUNT(*) FROM gauges ORDER BY count_star", E.SQLBindingError),
        ("SELECT COUNT(*) FROM gauges GROUP BY wet ORDER BY wet", E.ColumnNotFoundError),
        ("SELECT part, COUNT(*) FROM gauges JOIN basins ON gauges.site = basins.code GROUP BY basins.part", E.SQLBindingError),
        ("UPDATE gauges SET wet = 'yes' WHERE serial = -1", E.TypeMismatchError),
        ("UPDATE gauges SET stamp = NULL", E.NullConstraintError),
        ("UPDATE gauges SET wet = TRUE, WET = FALSE", E.SQLBindingError),
        ("UPDATE gauges SET gauges.wet = TRUE", E.SQLBindingError),
        ("UPDATE gauges SET serial = -2147483649", E.ValueOutOfRangeError),
        ("DELETE FROM gauges WHERE nope IS NULL", E.ColumnNotFoundError),
        ("INSERT INTO basins VALUES ('x', 1)", E.TupleArityError),
        ("INSERT INTO gauges VALUES (1, 'x', 1, 1, TRUE, 1)", E.TypeMismatchError),
        ("CREATE TABLE Gauges (x INTEGER)", E.TableAlreadyExistsError),
        ("CREATE TABLE _hidden (x INTEGER)", E.ReservedNameError),
        ("CREATE TABLE twice (x INTEGER, X FLOAT)", E.DuplicateColumnError),
        ("CREATE TABLE broad (x VARCHAR(4081))", E.InvalidColumnError),
        ("DROP TABLE lakes", E.TableNotFoundError),
    ],
)
def test_errors(engine, sql, error):
    with pytest.raises(error):
        engine.execute(sql)


def test_updates_and_deletes(spark, tmp_path):
    with Engine(spark, str(tmp_path)) as e:
        make(e, "boats", "hull INTEGER, rig VARCHAR?, afloat BOOLEAN, port VARCHAR?", [(11, "sloop", True, "Quay"), (12, None, False, "Quay"), (13, "ketch", True, None), (14, "yawl", False, "north")])
        run = lambda sql: e.execute(sql)
        before = e.frame("SELECT hull, rig FROM boats")
        assert run("UPDATE boats SET rig = 'none' WHERE hull > 99") == CommandResult(0)
        assert run("UPDATE boats SET afloat = TRUE, port = NULL WHERE NOT rig = 'ketch'") == CommandResult(3)  # null isn't 'ketch'
        assert list(run("SELECT * FROM boats").rows) == [(11, "sloop", True, None), (12, None, True, None), (13, "ketch", True, None), (14, "yawl", True, None)]
        assert sorted(before.collect(), key=lambda r: r.hull) == [(11, "sloop"), (12, None), (13, "ketch"), (14, "yawl")]  # the snapshot that it began with
        assert run("INSERT INTO boats VALUES (15, NULL, FALSE, 'south')") == CommandResult(1)
        assert run("DELETE FROM boats WHERE port IS NULL AND rig >= 'sloop'") == CommandResult(2)
        assert [r[0] for r in run("SELECT hull FROM boats").rows] == [12, 13, 15]
        assert run("UPDATE boats SET rig = 'raft'") == CommandResult(3) and run("DELETE FROM boats") == CommandResult(3)
        assert run("SELECT * FROM boats").rows == () and run("DELETE FROM boats WHERE hull = 12") == CommandResult(0)
        run("CREATE TABLE logs (day INTEGER, entry VARCHAR(3500), remark VARCHAR(3500))")
        run(f"INSERT INTO logs VALUES (1, '{'w' * 2200}', 'calm')")
        with pytest.raises(E.TupleSizeError):
            run(f"UPDATE logs SET remark = '{'gale' * 600}'")
        assert run("SELECT remark FROM logs").rows == (("calm",),)
        assert run("DROP TABLE logs") == CommandResult(0) and not e.has_table("logs")


def test_profiles(spark, tmp_path):
    with Engine(spark, str(tmp_path)) as e:
        make(e, "buoys", "tag INTEGER, colour VARCHAR, chain INTEGER", [(k, ["red", "red", "green"][k % 3], 10 * k) for k in range(9)])
        e.create_index("by_colour", "buoys", "colour")
        profile = lambda sql: e.execute_profiled(sql).profile
        p = profile("SELECT tag FROM buoys WHERE chain >= 30")
        assert (p.access_path, p.index_name, p.condition, p.metrics.tuples_examined) == ("TableScan", None, None, 9)
        p = profile("SELECT tag FROM buoys WHERE chain = 30 AND colour = 'green'")
        assert (p.access_path, p.index_name, p.condition.operator, p.condition.literal) == ("IndexScan", "by_colour", "=", "green")
        assert (p.metrics.rids_selected, p.metrics.rows_fetched) == (3, 3)
        assert profile("SELECT tag FROM buoys WHERE chain > 20 LIMIT 2").metrics.tuples_examined == 5
        assert profile("SELECT COUNT(*) FROM buoys WHERE colour = 'red'").metrics.rids_selected == 6
        assert profile("SELECT tag FROM buoys WHERE colour = 'red' OR tag = 2").access_path == "TableScan"
        assert profile("SELECT tag FROM buoys WHERE colour <> 'red'").access_path == "TableScan"
        assert run_profiled(e, "INSERT INTO buoys VALUES (9, 'black', 1)") == {"kind": "command", "affected_rows": 1, "profile": None}
        out = run_profiled(e, "SELECT tag FROM buoys ORDER BY tag DESC LIMIT 1")
        assert out["rows"] == [[9]] and out["columns"] == [{"name": "tag", "type": "INTEGER", "nullable": False}] and out["profile"]["table_name"] == "buoys"
        with pytest.raises(E.UnsupportedIndexTypeError):
            make(e, "drift", "x FLOAT", [(1.0,)])
            e.create_index("by_x", "drift", "x")
        with pytest.raises(E.IndexAlreadyExistsError):
            e.create_index("BY_Colour", "buoys", "tag")


def test_bulk_loads_are_checked_and_files_stay_many(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.sources import catalog

    monkeypatch.setattr(catalog, "SMALL", 8000)  # bytes
    with Engine(spark, str(tmp_path)) as e:
        make(e, "depths", "k INTEGER, label VARCHAR", [])
        t = e.get_table("depths")
        for bad in (["cast(null as int) k", "'a' label"], ["cast(id as int) k", "repeat('x', 41) label"]):
            with pytest.raises(E.EngineError):
                t.append(spark.range(5).selectExpr(*bad))
            assert t.count() == 0
        t.append(spark.range(4000).repartition(6).select(F.col("id").cast("int").alias("k"), F.lit("ok").alias("label")))
        first = set(t.entry["dirs"])
        for i in range(70):
            t.insert((5000 + i, "more"))
        assert first <= set(t.entry["dirs"]) and len(t.entry["dirs"]) <= 65 and t.count() == 4070  # only small folders were merged
        assert [r[0] for _, r in t.scan()[-70:]] == list(range(5000, 5070))


def test_rows_by_ordinal_and_reopening(spark, tmp_path):
    from tidemark.operators.changes import delete_row, update_row

    path = str(tmp_path / "db")
    with Engine(spark, path) as e:
        make(e, "t", "id INTEGER, v VARCHAR?", [(1, "a"), (2, None)])
        t = e.get_table("T")
        assert t.insert((3, "c")) == 2 and t.count() == 3 and t.get(1) == (2, None)
        update_row(t, 1, (2, "b"))
        delete_row(t, 0)
        with pytest.raises(E.RowNotFoundError):
            t.get(0)
        with pytest.raises(E.DatabaseInUseError):
            Engine(spark, path)
        e.execute("CREATE TABLE gone (id INTEGER)")
        e.execute("DROP TABLE gone")
        assert e.catalog.vacuum() >= 2
    with pytest.raises(E.StorageClosedError):
        e.execute("SELECT * FROM t")
    with Engine(spark, path) as e:
        assert e.list_tables() == ("t",) and e.get_table("t").scan() == [(1, (2, "b")), (2, (3, "c"))]
        assert e.get_table("t").insert((4, None)) == 3
        e.execute("CREATE TABLE later (id INTEGER)")
        assert e.get_table("later").id > 2
        busy = Engine.__new__(Engine)
        busy.__dict__.update(e.__dict__, wait_s=0.05, _lock=threading.RLock())
        held = threading.Thread(target=busy._lock.acquire)
        held.start()
        held.join()
        with pytest.raises(E.DatabaseBusyError):
            busy.execute("SELECT * FROM t")
    (tmp_path / "db" / "catalog.json").write_text("{}")
    with pytest.raises(E.CatalogCorruptionError):
        Engine(spark, path)


def test_statements_follow_a_model(spark, tmp_path):
    rng = random.Random(19)
    with Engine(spark, str(tmp_path)) as e:
        make(e, "m", "id INTEGER, tag VARCHAR?", [])
        model = {}
        for k in range(24):
            what, i = rng.choice("iiud"), rng.randrange(8)
            if what == "i":
                model[k] = (i, tag := rng.choice(["same", "", "é'x"]))
                e.execute(f"INSERT INTO m VALUES ({i}, '{tag.replace(chr(39), chr(39) * 2)}')")
            elif what == "u":
                hit = [r for r, v in model.items() if v[0] >= i]
                assert e.execute(f"UPDATE m SET tag = NULL WHERE id >= {i}").affected_rows == len(hit)
                model |= {r: (model[r][0], None) for r in hit}
            else:
                hit = [r for r, v in model.items() if not v[1] == "same" and v[0] == i]
                assert e.execute(f"DELETE FROM m WHERE NOT tag = 'same' AND id = {i}").affected_rows == len(hit)
                model = {r: v for r, v in model.items() if r not in hit}
        assert list(e.execute("SELECT * FROM m").rows) == list(model.values())


def test_streams(spark, tmp_path):
    from tidemark.streaming import StreamTable, stream

    spark.range(10).selectExpr("cast(id as int) id", "id % 2 = 0 even").write.parquet(str(tmp_path / "in"))
    t = StreamTable(spark, "s", str(tmp_path / "in"))
    q = stream(t, "SELECT even, COUNT(*), SUM(id) FROM s WHERE id > 2 GROUP BY even").writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("streamed").collect())) == [(False, 4, 24), (True, 3, 18)]
    with pytest.raises(E.SQLBindingError):
        stream(t, "SELECT id FROM s ORDER BY id")


def test_built_queries_equal_their_text(engine):
    from tidemark.fluent import col, table

    t = lambda n: table(engine, n)
    rows = lambda sql: engine.execute(sql).rows
    assert t("gauges").where((col("reading") < 0) | (col("wet") == True) & col("site").is_null()).select("serial").rows() == rows("SELECT serial FROM gauges WHERE reading < 0 OR wet = TRUE AND site IS NULL")  # noqa: E712
    assert t("gauges").where(~(col("site") == "Quay")).where(col("serial") >= 9).order_by("-stamp").select("serial", "stamp").limit(3, 1).rows() == rows("SELECT serial, stamp FROM gauges WHERE NOT site = 'Quay' AND serial >= 9 ORDER BY stamp DESC LIMIT 3 OFFSET 1")
    assert t("gauges").where(lambda c: c("serial") % 7 == 0).select("serial").rows() == tuple((k,) for k in range(0, len(READINGS), 7))
    assert t("gauges").where(lambda c: c("site") == "Quay").rows() == rows("SELECT * FROM gauges WHERE site = 'Quay'")
    joined = t("gauges").join("basins", "gauges.site", "basins.code").where(lambda c: c("basins.area") > 0)
    assert joined.select("serial", "area").rows() == rows("SELECT serial, area FROM gauges JOIN basins ON gauges.site = basins.code WHERE area > 0")
    made = joined.group_by("basins.part").select("basins.part").agg(count="*", sum=["area"]).order_by("-sum_area").rows()
    assert made == rows("SELECT basins.part, COUNT(*), SUM(area) FROM gauges JOIN basins ON gauges.site = basins.code WHERE area > 0 GROUP BY basins.part ORDER BY sum_area DESC")
    with pytest.raises(E.TypeMismatchError):
        t("gauges").where(col("serial") == "1").frame()


def test_index_searches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, rng.randint(-9, 9), rng.choice(SITES)) for k in range(60)]
    with Engine(spark, str(tmp_path)) as e:
        make(e, "tides", "k INTEGER, height INTEGER, site VARCHAR?", rows)
        e.create_index("by_height", "tides", "height")
        e.create_index("by_site", "tides", "site")
        t = e.get_table("tides")
        assert t.search("by_site", "Quay") == [k for k, _, s in rows if s == "Quay"]
        assert t.scan_range("by_site") == [k for k, _, s in rows if s is not None]
        for low, high, closed_low, closed_high in ((-3, 3, True, True), (-3, 3, False, False), (None, 0, True, False), (4, None, False, True), (5, -5, True, True)):
            inside = lambda h: (low is None or (h >= low if closed_low else h > low)) and (high is None or (h <= high if closed_high else h < high))  # noqa: B023, E731
            assert t.scan_range("by_height", low, high, closed_low, closed_high) == [k for k, h, _ in rows if inside(h)]
        with pytest.raises(E.IndexNotFoundError):
            t.search("by_moon", 1)
