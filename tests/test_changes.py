"""Changes of stored tables: manifests, locks, files, constraints, statements, batches, databases."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from lakeloom import migrate as M
from lakeloom.model import CapabilityError, DefinitionError, EngineError, Entity, created_at, field
from lakeloom.operators.query import Query
from lakeloom.rawsql import sql
from lakeloom.relations import belongs_to_many, has_many, has_one_through
from lakeloom.repo import PivotRepo, Repo
from lakeloom.scopes import Timestamps
from lakeloom.sources.constraints import ConstraintViolated
from lakeloom.sources.session import JdbcParts, Session
from lakeloom.sources.store import Store


class Plain(Entity, table="plain"):
    id = field("bigint", pk=True)
    name = field("string")
    n = field("int")


class Child(Entity, table="child"):
    id = field("bigint", pk=True)
    plain_id = field("bigint")


class Tag(Entity, table="tag"):
    id = field("bigint", pk=True)


class Link(Entity, table="plain_tag"):
    plain_id = field("bigint", pk=True)
    tag_id = field("bigint", pk=True)
    by = field("string", nullable=True)


class NewLink(Entity, creates=Link):
    by = field("string", nullable=True)


@pytest.fixture
def s(spark, tmp_path):
    found = Session(spark, store=Store(spark, str(tmp_path / "store"), wait=0.2))
    found.store.write("plain", spark.createDataFrame([(k, "abc"[k % 3], 10 * k) for k in range(1, 13)], Plain.meta.schema).repartition(4, "id"))
    found.store.write("other", spark.createDataFrame([(1, 1)], "id long, n int"))
    return found


def rows(s, table="plain"):
    return sorted(tuple(r) for r in s.store.read(table).collect())


# manifests and locks


def test_a_crash_between_tables_publishes_none(s, monkeypatch):
    before = rows(s), rows(s, "other")
    real = Store._place

    def broken(self, text, *parts):
        if parts[0] == "_manifests":
            raise OSError("the machine is gone")
        real(self, text, *parts)

    monkeypatch.setattr(Store, "_place", broken)
    with pytest.raises(OSError):
        with s.transact():
            s.store.write("other", s.spark.createDataFrame([(2, 2)], "id long, n int"))
            Query(s, Plain).delete()
    monkeypatch.undo()
    assert (rows(s), rows(s, "other")) == before
    with s.transact():
        s.store.write("other", s.spark.createDataFrame([(2, 2)], "id long, n int"))
        Query(s, Plain).delete()
    assert rows(s) == [] and rows(s, "other") == [(2, 2)]


def test_readers_always_find_the_tables(s):
    """Another session reads all the time while tables change together."""
    reader, seen, stop, failed = Store(s.spark, s.store.root), set(), threading.Event(), []

    def read():
        while not stop.is_set():
            try:
                manifest = reader._manifest()
                seen.add((manifest["plain"], manifest["other"]))
            except Exception as failure:
                failed.append(failure)

    thread = threading.Thread(target=read)
    thread.start()
    written = [tuple(s.store._manifest()[t] for t in ("plain", "other"))]
    for k in range(6):
        with s.transact():
            s.store.write("other", s.spark.createDataFrame([(k, k)], "id long, n int"))
            s.store.append("plain", s.spark.createDataFrame([(100 + k, "z", k)], Plain.meta.schema))
        written.append(tuple(s.store._manifest()[t] for t in ("plain", "other")))
    stop.set()
    thread.join()
    assert not failed and seen <= set(written) and len(rows(s)) == 18


def test_single_changes_hold_the_lock(s):
    other = Session(s.spark, store=Store(s.spark, s.store.root, wait=0.2))
    with s.transact():
        for change in (lambda: Query(other, Plain).delete(), lambda: other.store.write("x", s.spark.range(1)), lambda: Repo(other, Plain).truncate()):
            with pytest.raises(EngineError, match="another writer"):
                change()
    assert Query(other, Plain).where(lambda c: c.id == 1).delete() == 1


def test_changes_of_several_writers_all_count(s):
    """Each writer waits for the lock and then reads what the others have written."""
    def add(k):
        own = Session(s.spark, store=Store(s.spark, s.store.root, wait=120))
        Query(own, Plain).where(lambda c: c.id == 1).increment("n", k)

    threads = [threading.Thread(target=add, args=(k,)) for k in (1, 10, 100, 1000)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert rows(s)[0] == (1, "b", 1121)


def test_one_of_many_takes_the_lock(s):
    """All at once, many times: the lock has one holder, whose token it keeps."""
    for _ in range(25):
        stores, held = [Store(s.spark, s.store.root, wait=0) for _ in range(8)], []
        start = threading.Barrier(len(stores))

        def take(store):
            start.wait()
            try:
                store._acquire()
                held.append(store)
            except EngineError:
                pass

        threads = [threading.Thread(target=take, args=(x,)) for x in stores]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(held) == 1 and held[0]._read_text("_LOCK") == held[0]._token
        held[0]._release()


def test_locks_of_dead_writers_are_taken_and_lost_locks_publish_nothing(s):
    dead = Store(s.spark, s.store.root)
    dead._acquire()
    with pytest.raises(EngineError):
        s.store.drop("other")
    late = Store(s.spark, s.store.root, wait=1, stale_after=0.3)
    time.sleep(0.4)
    dead.renew()
    with pytest.raises(EngineError):
        Store(s.spark, s.store.root, wait=0, stale_after=60).drop("other")
    time.sleep(0.4)
    with late.transaction():
        dead._staged = {}
        with pytest.raises(EngineError, match="lost"):
            dead._publish({"other": None})
        dead._release()
        late.drop("other")
    assert late.tables() == ["plain"]


def test_other_failures_of_the_lock_are_told(s, monkeypatch):
    monkeypatch.setattr(Store, "_take", lambda self, token: self.spark._jvm.java.lang.Integer.parseInt("x"))
    with pytest.raises(Exception, match="For input string"):
        s.store.drop("other")


# files


def test_only_files_with_changed_rows_are_rewritten(s):
    before = set(s.store.read("plain").inputFiles())
    assert len(before) >= 3 and Query(s, Plain).where(lambda c: c.id == 5).update(name="x") == 1
    after = set(s.store.read("plain").inputFiles())
    assert len(before - after) == 1 and len(after) == len(before)
    assert Query(s, Plain).where(lambda c: c.id == 99).update(name="x") == 0 and set(s.store.read("plain").inputFiles()) == after
    Repo(s, Plain).upsert(Plain(id=5, name="y", n=1))
    assert len(after - set(s.store.read("plain").inputFiles())) == 1
    s.store.append("plain", s.spark.createDataFrame([(50, "q", 1)], Plain.meta.schema))
    assert len(rows(s)) == 13 and [r for r in rows(s) if r[0] in (5, 50)] == [(5, "y", 1), (50, "q", 1)]
    assert s.store.clean("plain") > 0 and len(rows(s)) == 13


def test_adopted_tables_are_copied_on_write(s, tmp_path):
    at = str(tmp_path / "raw files.parquet")
    s.spark.range(20).select("id", F.lit("a").alias("name"), F.col("id").cast("int").alias("n")).repartition(4).write.parquet(at)
    s.store.adopt("plain", at)
    assert Query(s, Plain).where(lambda c: c.id == 3).delete() == 1 and Query(s, Plain).count() == 19
    assert s.spark.read.parquet(at).count() == 20 and s.store.clean("plain") >= 0 and Query(s, Plain).count() == 19


def test_empty_tables(s):
    s.store.write("plain", s.spark.createDataFrame([], Plain.meta.schema))
    assert Query(s, Plain).update(n=1) == 0 and Query(s, Plain).delete() == 0
    Repo(s, Plain).upsert_all([Plain(id=1, name="a", n=1)])
    Repo(s, Plain).upsert_all([])
    assert rows(s) == [(1, "a", 1)] and Repo(s, Plain).update_all([]) == 0 and Repo(s, Plain).insert_on_conflict([], ["id"]) == 0


# constraints


def made(s):
    M.create_table(
        "made", M.id_column(), M.column("name", "string").unique(), M.column("n", "int").default(7).check("n > 0"),
        M.column("twice", "int").nullable().generated_always_as("n * 2"), M.column("other_id", "bigint").nullable().references("other"), comment="of things",
    )(s)


def test_writes_keep_to_the_schema(s):
    made(s)
    assert s.store.comment("made") == "of things"
    s.execute("INSERT INTO made (id, name) VALUES (1, 'a')")
    assert rows(s, "made") == [(1, "a", 7, 14, None)]
    for bad in ("(2, NULL, 1, NULL)", "(2, 'b', -1, NULL)", "(2, 'a', 1, NULL)", "(1, 'b', 1, NULL)", "(2, 'b', 1, 99)"):
        with pytest.raises(ConstraintViolated):
            s.execute(f"INSERT INTO made (id, name, n, other_id) VALUES {bad}")
    s.execute("INSERT INTO made (id, name, n, other_id) VALUES (2, 'b', 3, 1)")
    for bad in ("n = 0", "name = NULL", "name = 'a'", "other_id = 5"):
        with pytest.raises(ConstraintViolated):
            s.execute(f"UPDATE made SET {bad} WHERE id = 2")
    assert s.execute("UPDATE made SET n = 9 WHERE id = 2").count == 1
    assert rows(s, "made") == [(1, "a", 7, 14, None), (2, "b", 9, 18, 1)]


def test_foreign_keys_are_checked_when_added(s):
    s.store.write("child", s.spark.createDataFrame([(1, 1), (2, 77)], Child.meta.schema))
    with pytest.raises(M.MigrationError):
        M.alter_table("child", M.add_foreign_key("fk", "plain_id", "plain"))(s)
    Query(s, Child).where(lambda c: c.plain_id == 77).delete()
    M.alter_table("child", M.add_foreign_key("fk", "plain_id", "plain"))(s)
    with pytest.raises(ConstraintViolated):
        Repo(s, Child).raw_insert_all([Child(id=9, plain_id=55)])


def test_enum_columns_take_their_values_only(s):
    M.create_enum_type("mood", "glad", "sad")(s)
    M.create_table("felt", M.id_column(), M.column("mood", "string").enum("mood"))(s)
    s.execute("INSERT INTO felt VALUES (1, 'glad')")
    with pytest.raises(ConstraintViolated):
        s.execute("INSERT INTO felt VALUES (2, 'angry')")
    M.add_enum_value("mood", "angry")(s)
    s.execute("INSERT INTO felt VALUES (2, 'angry')")
    M.rename_enum_value("mood", "sad", "blue")(s)
    assert M.enum_values(s, "mood") == ["glad", "blue", "angry"]
    M.drop_enum_type("mood")(s)
    with pytest.raises(M.MigrationError):
        M.add_enum_value("mood", "x")(s)


def test_pretend_shows_the_statements(s):
    runner = M.Migrator(s, [M.Migration("1", "x", [M.create_table("t", M.id_column(), M.column("a", "int").default(1)), M.alter_table("t", M.add_column(M.column("b", "int").nullable())), M.drop_table("t")])])
    assert runner.pretend_statements() == ["create table t (id bigint not null, a int not null default 1)", "alter table t: add column b int", "drop table t"]


# statements, batches, frames


def test_statements(s):
    got = s.execute("UPDATE plain SET n = n + :by, name = concat(name, '; WHERE') WHERE id IN (1, 2) RETURNING id, n * 2 AS m", by=5)
    assert got.count == 2 and sorted(tuple(r) for r in got.rows) == [(1, 30), (2, 50)]
    assert rows(s)[:2] == [(1, "b; WHERE", 15), (2, "c; WHERE", 25)]
    got = s.execute(sql("DELETE FROM plain AS p WHERE p.n > :least RETURNING p.id", least=100))
    assert got.count == 2 and sorted(r[0] for r in got.rows) == [11, 12] and len(rows(s)) == 10
    got = s.execute("INSERT INTO plain (id, name) SELECT id + 100, upper(name) FROM VALUES (1, 'x'), (2, 'y') AS v(id, name) RETURNING id")
    assert got.count == 2 and sorted(r[0] for r in got.rows) == [101, 102] and (101, "X", None) in rows(s)
    s.views("other")
    assert s.execute("DELETE FROM plain WHERE id IN (SELECT id FROM other)").count == 1
    assert s.execute("DELETE FROM plain WHERE n IS NULL AND id = 5").rows is None
    for bad in ("", "SELECT 1", "UPDATE plain SET missing = 1", "UPDATE plain", "INSERT INTO plain (id) VALUES (1, 2)", "INSERT INTO plain", "DELETE plain"):
        with pytest.raises(DefinitionError):
            s.execute(bad)
    with pytest.raises(CapabilityError):
        Session(s.spark, {}).execute("DELETE FROM plain")


def test_returning(s):
    got = Query(s, Plain).where(lambda c: c.id < 3).update_returning(n=5)
    assert sorted((r.id, r.n) for r in got) == [(1, 5), (2, 5)]
    assert sorted(r.id for r in Query(s, Plain).where(lambda c: c.n == 5).delete_returning()) == [1, 2] and len(rows(s)) == 10


def test_batch_update(s):
    q = Query(s, Plain).where(lambda c: c.id != 4)
    got = q.batch_update([{"id": 3, "name": "x"}, {"id": 4, "name": "y"}, {"id": 99, "name": "z"}], ["id"])
    assert got.counts == [1, 0, 0] and got.total == 1
    got = Query(s, Plain).batch_update([{"name": "a", "n": 1000}, {"name": "b", "n": 2000}], ["name"], {"n": "old.n + new.n"})
    assert got.counts == [3, 4] and (6, "a", 1060) in rows(s) and (3, "x", 30) in rows(s)
    assert q.batch_update([], ["id"]).counts == []


def test_data_frames_are_inserted_without_the_driver(s):
    class Timed(Entity, table="timed"):
        id = field("bigint", pk=True)
        name = field("string", default="none")
        made = created_at()

    s.store.write("timed", s.spark.createDataFrame([], Timed.meta.schema))
    repo = Repo(s, Timed, [Timestamps(Timed, lambda: F.expr("TIMESTAMP '2025-01-01'"))])
    repo.insert_frame(s.spark.range(1000).repartition(4).select(F.col("id").cast("string").alias("name")))
    repo.insert_frame(s.spark.range(5).select((F.col("id") + 5_000_000_000_000).alias("id")))
    found = s.store.read("timed")
    assert found.count() == 1005 and found.select("id").distinct().count() == 1005 and found.where("made IS NULL").isEmpty()
    assert found.where("name = 'none'").count() == 5
    with pytest.raises(DefinitionError):
        repo.insert_frame(s.spark.range(1).withColumn("what", F.lit(1)))
    plain = Repo(s, Plain)
    new = s.spark.createDataFrame([(1, "new", 1), (70, "new", 2)], Plain.meta.schema)
    assert plain.upsert_frame(new) == 1 and {(1, "new", 1), (70, "new", 2)} <= set(rows(s)) and len(rows(s)) == 13


def test_pivots_by_creator(s):
    s.store.write("plain_tag", s.spark.createDataFrame([(1, 1, "x"), (1, 2, None)], Link.meta.schema))
    links = PivotRepo(s, belongs_to_many(Plain, Tag).with_pivot(Link, NewLink))
    links.attach(2, [7], NewLink(by="me"))
    links.attach_all(3, {7: NewLink(by="a"), 8: NewLink(by="b")})
    assert links.update_pivot(1, 2, NewLink(by="late")) == 1 and links.update_pivot(1, 9, by="never") == 0
    found = links.sync(1, [2, 5], NewLink(by="sync"))
    assert (found.attached, found.detached, found.unchanged) == ([5], [1], [2])
    assert rows(s, "plain_tag") == [(1, 2, "late"), (1, 5, "sync"), (2, 7, "me"), (3, 7, "a"), (3, 8, "b")]
    with pytest.raises(DefinitionError):
        PivotRepo(s, belongs_to_many(Plain, Tag)).attach(1, [1], NewLink(by="x"))


# limits come before counts and lists


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_limits_come_first(s):
    s.store.write("child", s.spark.createDataFrame([(k, k % 5) for k in range(40)], Child.meta.schema))
    children = has_many(Plain, Child, "plain_id")
    q = Query(s, Plain).order_by(lambda c: c.n, descending=True)
    whole = {r.id: n for r, n in q.with_count(children).run()}
    few = q.offset(7).limit(4).with_count(children).run()
    assert [r.id for r, _ in few] == [5, 4, 3, 2] and all(n == whole[r.id] for r, n in few) and [n for _, n in few] == [0, 8, 8, 8]
    got = q.offset(7).limit(4).with_related(children, lambda c: c.id < 20).with_related(children).run()
    assert [(r.id, [c.id for c in a], len(b)) for r, a, b in got] == [(5, [], 0), (4, [4, 9, 14, 19], 8), (3, [3, 8, 13, 18], 8), (2, [2, 7, 12, 17], 8)]
    assert q.limit(0).with_count(children).run() == [] and q.limit(0).with_related(children).run() == []
    text = plan(q.limit(4).with_count(children).df())
    assert text.index("Aggregate") < text.index("GlobalLimit")  # the limit lies below the count
    eager = q.with_related(children)
    assert list(eager.parts()) == ["plain", "related_0"] and len(eager.statements()) == 3


def test_has_one_through(s):
    class Mechanic(Entity, table="mechanic"):
        id = field("bigint", pk=True)

    class Car(Entity, table="car"):
        id = field("bigint", pk=True)
        mechanic_id = field("bigint")

    class Owner(Entity, table="owner"):
        id = field("bigint", pk=True)
        car_id = field("bigint")
        name = field("string")

    t = Session(s.spark, {
        "mechanic": s.spark.createDataFrame([(1,), (2,), (3,)], "id long"), "car": s.spark.createDataFrame([(10, 1), (20, 2)], "id long, mechanic_id long"),
        "owner": s.spark.createDataFrame([(5, 10, "Ann")], "id long, car_id long, name string"),
    })
    rel = has_one_through(Mechanic, Car, Owner, "mechanic_id", "car_id")
    q = Query(t, Mechanic).order_by(lambda c: c.id)
    assert [(m.id, [o.name for o in found]) for m, found in q.with_related(rel).run()] == [(1, ["Ann"]), (2, []), (3, [])]
    assert [m.id for m in q.where_has(rel).run()] == [1] and [m.id for m in q.doesnt_have(rel).run()] == [2, 3]
    assert [n for _, n in q.with_count(rel).run()] == [1, 0, 0]


def test_or_after_a_join_is_an_alternative_to_the_root(s):
    s.store.write("child", s.spark.createDataFrame([(k, k % 5) for k in range(40)], Child.meta.schema))
    children = has_many(Plain, Child, "plain_id")
    root = Query(s, Plain).where(lambda c: c.id == 1).or_where(lambda c: c.id == 2)
    found = root.join(children).where(lambda j: j.of(Child).id < 10).or_where(lambda j: j.of(Child).id == 13).run()
    assert sorted((p.id, c.id) for p, c in found) == [(1, 1), (1, 6), (2, 2), (2, 7), (3, 13)]
    semi = Query(s, Plain).where_has(children, lambda c: c.id == 3).join(children).or_where(lambda j: j.of(Child).id == 4)
    assert sorted((p.id, c.id) for p, c in semi.run()) == [(3, k) for k in range(3, 40, 5)] + [(4, 4)]


# databases


def test_databases_are_read_in_parts_and_written(s):
    url, how = "jdbc:derby:memory:lakeloom;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    db = Session.jdbc(s.spark, url, how, parts={"PLAIN": JdbcParts("ID", 0, 100, 4)}, fetch_size=50)

    class Row(Entity, table="PLAIN"):
        id = field("bigint", pk=True, name="ID")
        name = field("string", name="NAME")

    db.save("PLAIN", s.spark.range(100).select(F.col("id").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME")).repartition(3), mode="overwrite", connections=2)
    db.save("PLAIN", s.spark.createDataFrame([(500, "late")], "ID long, NAME string"))
    q = Query(db, Row)
    assert q.count() == 101 and q.df().rdd.getNumPartitions() == 4
    assert [r.name for r in q.where(lambda c: c.id > 98).order_by(lambda c: c.id).run()] == ["n99", "late"]
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,98)]" in q.where(lambda c: c.id > 98).df()._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(EngineError):
        s.save("x", s.spark.range(1))
    assert [tuple(r) for r in db.native('SELECT "ID" FROM PLAIN WHERE "ID" > :least ORDER BY "ID"', limit=2, offset=1, least=90).collect()] == [(92,), (93,)]
    with pytest.raises(CapabilityError, match="Derby has no row locks"):
        q.lock_for_update()
    with pytest.raises(EngineError):
        s.native("SELECT 1")


def test_dialects():
    from lakeloom.sources.dialects import DIALECTS, dialect_of

    assert dialect_of("jdbc:postgresql://h/db").window(5, 10) == " LIMIT 5 OFFSET 10" and dialect_of("jdbc:oracle:thin:@h").window(5, None) == " OFFSET 0 ROWS FETCH NEXT 5 ROWS ONLY"
    assert DIALECTS["mysql"].window(None, 3) == f" LIMIT {(1 << 63) - 1} OFFSET 3" and DIALECTS["postgresql"].window(None, 3) == " OFFSET 3" and DIALECTS["h2"].window(None, None) == ""
    assert DIALECTS["mysql"].identifier("a`b") == "`a``b`" and DIALECTS["sqlite"].identifier("a") == '"a"'
    with pytest.raises(CapabilityError):
        dialect_of("jdbc:unknown:x")
    with pytest.raises(CapabilityError):
        DIALECTS["clickhouse"].require("row_locks")


def test_scopes_stack_from_base_to_subclass(s):
    from lakeloom.scopes import Where

    seen = lambda key: Where(key, lambda c: c.id > 0)

    class Base(Repo):
        injected = (seen("first"), lambda meta: Where("of " + meta.table, lambda c: c.n < 100))

    class Mixin:
        final = (seen("last"),)

    class Own(Mixin, Base):
        injected = (seen("second"),)
        final = (seen("very last"),)

    repo = Own(s, Plain, [Where("given", lambda c: c.id > 2)])
    assert [x.key for x in repo.scopes] == ["first", "of plain", "second", "given", "last", "very last"]
    assert repo.count() == 7 and repo.query_without("given").count() == 9


def test_rows_are_saved_from_the_executors(s, tmp_path):
    q, at = Query(s, Plain).where(lambda c: c.id < 7), str(tmp_path / "out")
    q.save(at, "json", partition_by=("name",))
    assert s.spark.read.json(at).count() == 6 and len(q.statements()) == 1 and "Filter" in q.statements()[0]
    with pytest.raises(Exception, match="exist"):
        q.save(at, "json")


def test_debug_shows_the_tables_of_a_query(s, capsys):
    s.store.write("child", s.spark.createDataFrame([(1, 1)], Child.meta.schema))
    q = Query(s, Plain).where_has(has_many(Plain, Child, "plain_id"))
    assert q.tables() == ["plain", "child"] and q.debug(2) is q
    out = capsys.readouterr().out
    assert "Physical Plan" in out and "plain_id" in out and "only showing top 2 rows" in out


def test_compacting_keeps_the_rows(s):
    for k in range(3):
        s.store.append("plain", s.spark.createDataFrame([(100 + k, "z", k)], Plain.meta.schema))
    before = rows(s)
    s.store.compact("plain")
    assert rows(s) == before and len(s.store.read("plain").inputFiles()) == 1


def test_changes_by_record(s):
    q = Query(s, Plain)
    two = q.where(lambda c: c.id == 2).first()
    assert q.update_record(two.copy(name="x", n=1)) == 1 and (2, "x", 1) in rows(s)
    assert q.where(lambda c: c.n > 50).update_record(two) == 0  # not among the selected rows
    assert q.update_partial(two, two.copy(n=7)) == 1 and (2, "x", 7) in rows(s) and q.update_partial(two, two.copy()) == 0
    q.upsert_by_pk(Plain(id=2, name="y", n=2))
    q.upsert_by_pk(Plain(id=200, name="z", n=3))
    assert {(2, "y", 2), (200, "z", 3)} <= set(rows(s)) and len(rows(s)) == 13
    assert q.delete_record(two) == 1 and len(rows(s)) == 12
    with pytest.raises(DefinitionError):
        q.update_partial(two, two.copy(id=3))
    q.truncate()
    assert rows(s) == []


def test_deletes_by_many_ids(s):
    s.store.append("plain", s.spark.range(1000, 4000).select("id", F.lit("m").alias("name"), F.lit(1).alias("n")))
    assert Repo(s, Plain).delete_all_by_id(range(2, 3002, 2)) == 1007 and Query(s, Plain).count() == 2005
    assert Query(s, Plain).where(lambda c: c.id % 2 == 0).count() == 499 and Repo(s, Plain).delete_all_by_id([1, 3]) == 2
