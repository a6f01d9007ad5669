"""Versioned tables, transactions, repositories, hooks, observers, pivots and migrations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeloom import migrate as M
from lakeloom.model import DefinitionError, EngineError, Entity, NotFound, created_at, deleted_at, field, updated_at
from lakeloom.operators.query import Query
from lakeloom.relations import belongs_to_many
from lakeloom.repo import Observer, PivotRepo, Repo
from lakeloom.scopes import SoftDeletes, Timestamps
from lakeloom.sources.session import Session
from lakeloom.sources.store import Store


class Item(Entity, table="item"):
    id = field("bigint", pk=True)
    name = field("string")
    amount = field("int", default=0)
    made = created_at()
    changed = updated_at()
    gone = deleted_at()


class NewItem(Entity, creates=Item):
    name = field("string")
    amount = field("int", default=0)


class Plain(Entity, table="plain"):
    id = field("bigint", pk=True)
    name = field("string")
    n = field("int")


def now():
    return F.expr("TIMESTAMP '2025-01-01'")


@pytest.fixture
def s(spark, tmp_path):
    found = Session(spark, store=Store(spark, str(tmp_path)))
    found.store.write("item", spark.createDataFrame([], Item.meta.schema))
    found.store.write("plain", spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], Plain.meta.schema))
    return found


@pytest.fixture
def items(s):
    repo = Repo(s, Item, [SoftDeletes(Item, now), Timestamps(Item, now)])
    repo.raw_insert_all([NewItem(name=n) for n in "abcd"])
    return repo


def names(q):
    return sorted(r.name for r in q.run())


def test_query_changes(s):
    q = Query(s, Plain)
    assert q.where(lambda c: c.n > 15).update(name="x") == 2 and names(q) == ["a", "x", "x"]
    assert q.where(lambda c: c.id == 1).increment("n") == 1 and q.where(lambda c: c.id == 1).decrement("n", 5) == 1
    assert q.where(lambda c: c.id == 1).first().n == 6
    assert q.where(lambda c: c.id == 2).or_where(lambda c: c.id == 3).update_expr({"n": "n * 2"}) == 2
    assert sorted(r.n for r in q.run()) == [6, 40, 60]
    assert q.where(lambda c: c.id == 99).delete() == 0 and q.where(lambda c: c.n > 50).delete() == 1 and q.count() == 2
    with pytest.raises(DefinitionError):
        q.touch()


def test_null_conditions_change_nothing(s, spark):
    s.store.write("plain", spark.createDataFrame([(1, None, 1), (2, "b", 2)], Plain.meta.schema))
    assert Query(s, Plain).where(lambda c: c.name == "b").delete() == 1
    assert Query(s, Plain).where(lambda c: c.name != "q").update(n=5) == 0 and Query(s, Plain).count() == 1


def test_transactions_and_versions(s):
    with s.transact():
        Query(s, Plain).where(lambda c: c.id == 1).delete()
        assert Query(s, Plain).count() == 2
    with pytest.raises(RuntimeError):
        with s.transact():
            Query(s, Plain).delete()
            raise RuntimeError
    assert Query(s, Plain).count() == 2
    with s.transact(), pytest.raises(Exception):  # another writer is kept out
        with Store(s.spark, s.store.root).transaction():
            pass
    assert s.store.tables() == ["item", "plain"] and s.store.clean("plain") > 0 and Query(s, Plain).count() == 2
    s.store.rename("plain", "other")
    assert s.store.tables() == ["item", "other"]
    with pytest.raises(EngineError):
        s.store.read("plain")


def test_generated_keys_defaults_and_hooks(items):
    found = items.find_all()
    assert sorted(r.id for r in found) == [1, 2, 3, 4]
    assert all(r.made == r.changed == dt.datetime(2025, 1, 1) and r.amount == 0 and r.gone is None for r in found)


def test_find_save_and_tracking(items):
    a = items.find(1)
    assert items.find(99) is None and items.exists(2) and not items.exists(99) and items.count() == 4
    with pytest.raises(NotFound):
        items.find_or_fail(99)
    assert sorted(r.id for r in items.find_all_by_id([1, 3, 77])) == [1, 3] and items.find_all_by_id([]) == []
    assert not items.is_dirty(a)
    a.name = "A"
    assert items.changes(a) == {"name": "A"} and items.original(a).name == "a"
    items.save(a)
    assert items.refresh(a).name == "A"
    new = items.save(NewItem(name="e"))
    assert new.id == 5
    assert items.update_all([items.find(2).copy(name="B"), Item(id=99, name="none", made=None, changed=None)]) == 1
    assert names(items.query()) == ["A", "B", "c", "d", "e"]
    with pytest.raises(DefinitionError):
        items.update_partial(a, items.find(2))


def test_soft_deletes(items):
    a = items.find(1)
    assert items.delete(a) == 1 and items.find(1) is None and names(items.with_trashed()) == list("abcd") and names(items.only_trashed()) == ["a"]
    trashed = items.with_trashed().where(lambda c: c.id == 1).first()
    assert items.is_trashed(trashed) and items.restore(trashed) == 1 and items.count() == 4
    assert items.force_delete(a) == 1 and names(items.with_trashed()) == list("bcd")
    assert items.delete_by_id(2) == 1 and items.delete_all_by_id([3, 4]) == 2 and items.count() == 0 and items.with_trashed().count() == 3
    items.truncate()
    assert items.with_trashed().count() == 0


def test_observers(s, items):
    seen = []

    class Note(Observer):
        def __getattribute__(self, name):
            if name.startswith("_"):
                return object.__getattribute__(self, name)
            return lambda record: seen.append(name)

    class No(Observer):
        def creating(self, record):
            raise ValueError("no")

    repo = Repo(s, Item, items.scopes, [Note()])
    made = repo.create(NewItem(name="x"))
    repo.delete(made)
    repo.restore(made)
    repo.force_delete(made)
    repo.raw_insert(NewItem(name="y"))
    assert seen == ["creating", "created", "deleting", "trashed", "deleted", "restoring", "restored", "force_deleting", "force_deleted"]
    with pytest.raises(ValueError):
        Repo(s, Item, items.scopes, [No()]).create(NewItem(name="never"))
    assert "never" not in names(items.query())


def test_upserts(s):
    repo = Repo(s, Plain)
    repo.upsert(Plain(id=2, name="B", n=21))
    repo.upsert_all([Plain(id=3, name="C", n=31), Plain(id=9, name="z", n=90)])
    assert {(r.id, r.name, r.n) for r in repo.find_all()} == {(1, "a", 10), (2, "B", 21), (3, "C", 31), (9, "z", 90)}

    class NewPlain(Entity, creates=Plain):
        name = field("string")
        n = field("int")

    assert repo.insert_on_conflict([NewPlain(name="a", n=1), NewPlain(name="q", n=2)], ["name"], ignore=True) == 1
    assert repo.insert_on_conflict([NewPlain(name="a", n=1), NewPlain(name="r", n=3)], ["name"], {"n": F.col("old.n") + F.col("new.n")}) == 1
    assert {(r.name, r.n) for r in repo.query().run()} == {("a", 11), ("B", 21), ("C", 31), ("z", 90), ("q", 2), ("r", 3)}
    assert repo.first_or_create(lambda c: c.name == "a", NewPlain(name="a", n=0)).n == 11
    assert repo.update_or_create(lambda c: c.name == "a", NewPlain(name="a", n=5)).n == 5
    assert repo.update_or_create(lambda c: c.name == "new", NewPlain(name="new", n=7)).n == 7


def test_pivots(s, spark):
    class Tag(Entity, table="tag"):
        id = field("bigint", pk=True)

    s.store.write("plain_tag", spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "plain_id long, tag_id long"))
    links = PivotRepo(s, belongs_to_many(Plain, Tag))
    links.attach(3, [7, 8])
    assert links.detach(3, [8]) == 1
    found = links.sync(1, [2, 5])
    assert (found.attached, found.detached, found.unchanged) == ([5], [1], [2])
    assert sorted(tuple(r) for r in s.store.read("plain_tag").collect()) == [(1, 2), (1, 5), (2, 1), (3, 7)]
    assert links.detach_all(1) == 2


def test_migrations(s):
    first = M.Migration("1", "users", [M.create_table("users", M.id_column(), M.column("name", "string"), M.timestamps(), M.soft_delete())], [M.drop_table("users")])
    second = M.Migration("2", "age", [M.alter_table("users", M.add_column(M.column("age", "int").default(7)), M.rename_column("name", "full_name"), M.column_comment("age", "years"), M.add_index("i", "age"))], [M.alter_table("users", M.drop_column("age"), M.rename_column("full_name", "name"))])
    runner = M.Migrator(s, [second, first])
    assert [m.key for m in runner.pretend()] == ["1_users", "2_age"] and runner.migrate() == ["1_users", "2_age"] and runner.migrate() == []
    assert s.store.read("users").columns == ["id", "full_name", "created_at", "updated_at", "deleted_at", "age"]
    assert s.store.schema("users")["age"].metadata == {"default": "7", "comment": "years"} and not s.store.schema("users")["id"].nullable
    assert runner.rollback_steps(1) == ["2_age"] and runner.status() == [("1_users", 1), ("2_age", None)]
    assert runner.migrate(in_one=False) == ["2_age"] and runner.rollback() == ["2_age"] and runner.reset() == ["1_users"] and not s.store.exists("users")
    broken = M.Migrator(s, [M.Migration("3", "x", [M.create_table("half", M.id_column()), M.drop_table("missing")])])
    with pytest.raises(M.MigrationError):
        broken.migrate()
    assert not s.store.exists("half")
    with pytest.raises(M.MigrationError):
        M.Migrator(s, [first, first])


def test_alterations_check_the_rows(s):
    M.alter_table("plain", M.set_not_null("name"), M.add_unique("u", "id"), M.add_primary_key("id"), M.add_check("c", "n > 0"), M.alter_column_type("n", "bigint"), M.set_default("n", 1), M.drop_default("n"))(s)
    assert s.store.schema("plain")["n"].dataType.simpleString() == "bigint"
    M.alter_table("plain", M.drop_constraint("u"), M.drop_not_null("name"), M.drop_column("nothing", if_exists=True))(s)
    for bad in (M.add_check("d", "n > 15"), M.add_column(M.column("q", "int")), M.drop_column("nothing"), M.drop_constraint("nothing"), M.add_column(M.column("n", "int"))):
        with pytest.raises(M.MigrationError):
            M.alter_table("plain", bad)(s)


def test_verification(s, spark):
    class Wrong(Entity, table="plain"):
        id = field("bigint", pk=True)
        name = field("int")
        missing = field("int")

    class Nowhere(Entity, table="nowhere"):
        id = field("int", pk=True)

    found = M.verify(s, Wrong, Nowhere)
    assert [(i.kind, i.column) for i in found if not i.warning] == [("type_mismatch", "name"), ("column_missing", "missing"), ("table_missing", "")]
    assert "extra column" in M.report(found) and M.report([]) == "all tables match"


def test_active_records(items):
    from lakeloom.active import Active
    from lakeloom.relations import has_one

    a = Active(items, items.find(1))
    assert a.is_clean and not a.is_dirty and a.same_as(items.find(1)) and not a.same_as(items.find(2)) and not a.same_as(None)
    a.record.name = "changed"
    assert a.is_dirty and a.changes == {"name": "changed"} and a.original.name == "a"
    assert a.save().refresh().record.name == "changed"
    assert a.load_one(has_one(Item, Plain, "id")).name == "a" and a.load(has_one(Item, Plain, "n")) == []
    assert a.touch() == 1 and a.delete() == 1
    a.record = items.with_trashed().where(lambda c: c.id == 1).first()
    assert a.trashed and a.restore() == 1 and a.force_delete() == 1
    assert Active(items, NewItem(name="n")).create().record.id == 5
