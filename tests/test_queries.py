"""The builder on small tables: conditions, relationships, loading, pages and errors."""

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import aggregates as agg
from lakeloom.model import CapabilityError, DefinitionError, Entity, NotFound, created_at, deleted_at, enum_type, field, snake_case, updated_at
from lakeloom.operators.query import Query, lazy_load
from lakeloom.rawsql import Fragment, TableInfo, bound, identifier, sql
from lakeloom.relations import belongs_to, belongs_to_many, has_many, has_many_through, has_one
from lakeloom.scopes import Where
from lakeloom.sources.session import QueryFailed, Session, SqlLogger


class User(Entity, table="qb_user"):
    id = field("bigint", pk=True)
    first_name = field("string", nullable=True)
    age = field("int")


class Author(Entity, names=snake_case):
    id = field("bigint", pk=True)
    name = field("string")
    country_id = field("bigint", nullable=True)


class Book(Entity, names=snake_case):
    id = field("bigint", pk=True)
    author_id = field("bigint", nullable=True)
    title = field("string")


class Review(Entity, names=snake_case):
    id = field("bigint", pk=True)
    book_id = field("bigint")
    score = field("int")


class Country(Entity, names=snake_case):
    id = field("bigint", pk=True)
    name = field("string")


class Student(Entity, names=snake_case):
    id = field("bigint", pk=True)
    name = field("string")


class Course(Entity, names=snake_case):
    id = field("bigint", pk=True)
    name = field("string")


class Taken(Entity, table="student_course"):
    student_id = field("bigint", pk=True)
    course_id = field("bigint", pk=True)
    grade = field("int", nullable=True)


BOOKS = has_many(Author, Book, "author_id")
AUTHOR = belongs_to(Book, Author, "author_id")
COUNTRY = belongs_to(Author, Country, "country_id")
AUTHORS = has_many(Country, Author, "country_id")
REVIEWS = has_many(Book, Review, "book_id")
FIRST_REVIEW = has_one(Book, Review, "book_id")
COURSES = belongs_to_many(Student, Course)
COUNTRY_BOOKS = has_many_through(Country, Author, Book, "country_id", "author_id")


@pytest.fixture(scope="module")
def s(spark):
    make = spark.createDataFrame
    return Session(spark, {
        "qb_user": make([(1, "Alice", 25), (2, "Bob", 30), (3, "Charlie", 17), (4, None, 22)], User.meta.schema),
        "author": make([(1, "Tolkien", 1), (2, "Asimov", 2), (3, "Herbert", 2), (4, "Rowling", None)], Author.meta.schema),
        "book": make([(1, 1, "The Hobbit"), (2, 1, "LotR"), (3, 2, "Foundation"), (4, 2, "I, Robot"), (5, 3, "Dune"), (6, None, "Anonymous")], Book.meta.schema),
        "review": make([(1, 1, 5), (2, 2, 3), (3, 3, 4), (4, 5, 5)], Review.meta.schema),
        "country": make([(1, "UK"), (2, "US"), (3, "France")], Country.meta.schema),
        "student": make([(1, "Ann"), (2, "Ben"), (3, "Cat")], Student.meta.schema),
        "course": make([(1, "Art"), (2, "Bio")], Course.meta.schema),
        "student_course": make([(1, 1, 5), (1, 2, None), (2, 1, 3), (2, 1, 4), (3, 9, 1)], Taken.meta.schema),
    })


def ids(records):
    return [r.id for r in records]


def test_conditions(s):
    q = Query(s, User).order_by(lambda c: c.id)
    assert ids(q.where(lambda c: c.age > 18).where(lambda c: c.age < 30).run()) == [1, 4]
    assert ids(q.where(lambda c: (c.age > 20) & (c.age < 26)).or_where(lambda c: c.first_name == "Bob").run()) == [1, 2, 4]
    assert ids(q.where(lambda c: c.first_name == F.lit(None)).run()) == [] and ids(q.where(lambda c: c.first_name.isNull()).run()) == [4]
    assert ids(q.where(lambda c: ~c.age.isin([])).run()) == [1, 2, 3, 4] and ids(q.where(lambda c: c.age.isin([])).run()) == []
    assert ids(q.where(lambda c: c["first_name"].ilike("a%")).run()) == [1]


def test_aggregates_look_at_conditions_only(s):
    q = Query(s, User).limit(1)
    assert q.count() == 4 and q.count(lambda c: c.first_name) == 3 and q.exists()
    assert (q.sum(lambda c: c.age), q.min(lambda c: c.age), q.max(lambda c: c.age), q.avg(lambda c: c.age)) == (94, 17, 30, 23.5)
    none = q.where(lambda c: c.age > 99)
    assert none.count() == 0 and none.sum(lambda c: c.age) is None and none.avg(lambda c: c.age) is None and not none.exists()


def test_order_extent_and_first(s):
    by_age = Query(s, User).order_by(lambda c: c.age)
    assert [u.age for u in by_age.run()] == [17, 22, 25, 30]
    assert [u.age for u in by_age.offset(1).limit(2).run()] == [u.age for u in by_age.limit(2).offset(1).run()] == [22, 25]
    names = Query(s, User).order_by(lambda c: c.first_name, nulls="last")
    assert ids(names.run()) == [1, 2, 3, 4] and ids(Query(s, User).order_by(lambda c: c.first_name).run())[0] == 4
    assert by_age.first().id == 3 and by_age.limit(0).run() == []
    with pytest.raises(DefinitionError):
        by_age.limit(-1)
    with pytest.raises(NotFound, match="qb_user"):
        by_age.where(lambda c: c.age > 99).first_or_fail()
    with pytest.raises(CapabilityError):
        by_age.lock_for_update()


def test_projection(s):
    made = Query(s, Book).where(lambda c: c.author_id.isNotNull()).select(lambda c: {"author": c.author_id, "n": agg.count()}).group_by(lambda c: c.author_id)
    assert [tuple(r) for r in made.order_by("n", descending=True).order_by("author").run()] == [(1, 2), (2, 2), (3, 1)]
    assert [tuple(r) for r in made.having(lambda c: agg.count() > 1).or_having(lambda c: c.author_id == 3).order_by("author").run()] == [(1, 2), (2, 2), (3, 1)]
    assert made.order_by(lambda c: agg.greatest(c.title), descending=True).first()["author"] == 1
    assert Query(s, Book).select(lambda c: {"n": agg.count(), "d": agg.count_distinct(c.author_id)}).first() == (6, 3)
    with pytest.raises(DefinitionError):
        Query(s, Book).select(lambda c: [c.title])
    with pytest.raises(DefinitionError):
        Query(s, Book).where(lambda c: c.nothing == 1).df()


def test_joins(s):
    q = Query(s, Book).order_by(lambda c: c.id).join(AUTHOR)
    assert [(b.title, a.name) for b, a in q.offset(2).limit(2).run()] == [("Foundation", "Asimov"), ("I, Robot", "Asimov")]
    assert q.count() == 5 and q.where(lambda j: j.of(Author).name == "Tolkien").count() == 2
    left = Query(s, Book).order_by(lambda c: c.id).left_join(AUTHOR).left_join(COUNTRY)
    assert [(b.id, a and a.name, c and c.name) for b, a, c in left.run()][-2:] == [(5, "Herbert", "US"), (6, None, None)]
    assert Query(s, Review).join(belongs_to(Review, Book, "book_id")).join(AUTHOR).join(COUNTRY).count() == 4
    assert Query(s, Author).right_join(COUNTRY).run()[-1][0] is None or Query(s, Author).right_join(COUNTRY).count() == 4
    assert Query(s, Student).cross_join(Course).count() == 6
    with pytest.raises(DefinitionError):
        Query(s, Review).join(AUTHOR)
    with pytest.raises(DefinitionError):
        q.of(Country)


def test_existence_and_counts(s):
    q = Query(s, Author).order_by(lambda c: c.id)
    names = lambda q: [a.name for a in q.run()]
    assert names(q.where_has(BOOKS)) == ["Tolkien", "Asimov", "Herbert"] and names(q.doesnt_have(BOOKS)) == ["Rowling"]
    assert names(q.where_has(BOOKS, lambda b: b.where_has(REVIEWS, lambda r: r.score >= 5))) == ["Tolkien", "Herbert"]
    assert names(q.where_has(BOOKS, lambda b: b.where_has(REVIEWS, lambda r: r.score >= 4) | (b.title == "none"))) == ["Tolkien", "Asimov", "Herbert"]
    assert names(q.where(lambda c: c.name == "Rowling").or_where_has(BOOKS, lambda b: b.title == "Dune")) == ["Herbert", "Rowling"]
    assert names(q.where(lambda c: c.name == "Tolkien").or_doesnt_have(BOOKS)) == ["Tolkien", "Rowling"]
    assert names(q.has(BOOKS, lambda n: n >= 2)) == ["Tolkien", "Asimov"] and names(q.has(BOOKS, lambda n: n == 0)) == ["Rowling"]
    assert names(q.has(BOOKS, lambda n: n < 1, lambda b: b.title.like("%Robot"))) == ["Tolkien", "Herbert", "Rowling"]
    assert names(q.where(lambda c: c.id == 4).or_where(lambda c: c.has(BOOKS, lambda n: n > 1))) == ["Tolkien", "Asimov", "Rowling"]
    assert [(a.name, n) for a, n in q.with_count(BOOKS).run()] == [("Tolkien", 2), ("Asimov", 2), ("Herbert", 1), ("Rowling", 0)]
    pivots = Query(s, Student).order_by(lambda c: c.id)
    assert [n for _, n in pivots.with_count(COURSES).run()] == [2, 2, 1]  # pivot rows as they are, the dangling one too
    assert [n for _, n in pivots.with_count(COURSES, lambda c: c.name == "Art").run()] == [1, 2, 0]
    assert ids(pivots.where_has(COURSES).run()) == [1, 2, 3] and ids(pivots.where_has(COURSES, lambda c: c.id > 0).run()) == [1, 2]
    assert ids(Query(s, Country).where_has(COUNTRY_BOOKS).order_by(lambda c: c.id).run()) == [1, 2]


def test_eager_and_lazy_loading(s):
    q = Query(s, Author).order_by(lambda c: c.id)
    assert [len(b) for _, b in q.with_related(BOOKS).run()] == [2, 2, 1, 0]
    assert [[x.title for x in b] for _, b in q.limit(2).with_related(BOOKS, lambda b: b.title.like("%o%")).run()] == [["The Hobbit", "LotR"], ["Foundation", "I, Robot"]]
    assert [(len(b), c[0].name if c else None) for _, b, c in q.with_related(BOOKS).with_related(COUNTRY).run()] == [(2, "UK"), (2, "US"), (1, "US"), (0, None)]
    assert [len(b) for _, b in Query(s, Country).order_by(lambda c: c.id).with_related(COUNTRY_BOOKS).run()] == [2, 3, 0]
    assert [len(r) for _, r in q.with_related(BOOKS.via(REVIEWS)).run()] == [2, 1, 1, 0]
    students = Query(s, Student).order_by(lambda c: c.id)
    assert [[c.name for c in cs] for _, cs in students.with_related(COURSES).run()] == [["Art", "Bio"], ["Art", "Art"], []]
    graded = COURSES.with_pivot(Taken)
    assert [[(c.name, p.grade) for c, p in cs] for _, cs in students.with_related_and_pivot(graded, pivot=lambda p: p.grade.isNotNull()).run()] == [[("Art", 5)], [("Art", 3), ("Art", 4)], []]
    assert q.with_related(BOOKS).first()[0].name == "Tolkien"
    tolkien, rowling = q.first(), q.where(lambda c: c.name == "Rowling").first()
    assert len(lazy_load(s, tolkien, BOOKS)) == 2 and lazy_load(s, rowling, COUNTRY) == []
    with pytest.raises(DefinitionError):
        q.with_related_and_pivot(COURSES)


def test_scopes(spark, s):
    own = Session(spark, s._tables)
    own.register(Book, Where("short", lambda c: F.length(c.title) < 9))
    q = Query(own, Author, scoped=True).order_by(lambda c: c.id)
    assert [n for _, n in q.with_count(BOOKS).run()] == [1, 1, 1, 0]
    assert [len(b) for _, b in q.with_related(BOOKS).run()] == [1, 1, 1, 0]
    assert [a.name for a in q.where_has(BOOKS, lambda b: b.title.like("F%")).run()] == []
    assert q.left_join(BOOKS).count() == 4 and q.join(BOOKS).count() == 3
    assert [n for _, n in Query(own, Author).order_by(lambda c: c.id).with_count(BOOKS).run()] == [2, 2, 1, 0]
    adult = Where("adult", lambda c: c.age >= 18, lambda c: c.age)
    kept = Query(s, User, [adult], scoped=True).where(lambda c: c.first_name == "Bob").or_where(lambda c: c.id == 3)
    assert ids(kept.run()) == [2]
    loose = Query(s, User, [adult], scoped=True, scopes_escape=True).or_where(lambda c: c.id == 3)
    assert [u.age for u in loose.run()] == [17, 22, 25, 30]


def test_pages(s):
    q = Query(s, User).order_by(lambda c: c.id)
    page = q.paginate(2, 3)
    assert ids(page.items) == [4] and (page.total, page.total_pages, page.has_next, page.has_prev) == (4, 2, False, True)
    with pytest.raises(DefinitionError):
        q.paginate(0, 3)
    keys = Query(s, User).keyset_paginate(2).desc(lambda c: c.first_name).asc(lambda c: c.id)
    one = keys.run()
    two = keys.after(*one.next_key).run()
    assert ids(one.items + two.items) == [3, 2, 1, 4] and one.has_more and not two.has_more and two.next_key is None and two.prev_key == ("Alice", 1)
    up = Query(s, User).keyset_paginate(1).asc(lambda c: c.first_name).asc(lambda c: c.id)
    seen, key = [], None
    while True:
        page = up.after(*key).run() if key else up.run()
        seen += ids(page.items)
        key = page.next_key
        if not page.has_more:
            break
    assert seen == [4, 1, 2, 3]
    assert [ids(c) for c in q.chunk(3)] == [[1, 2, 3], [4]] and [ids(c) for c in q.limit(2).chunk(2)] == [[1, 2]]
    with pytest.raises(ValueError):
        q.chunk(0)
    assert ids(q.iterate()) == [1, 2, 3, 4]


def test_definitions():
    assert snake_case("LastLoginAt") == "last_login_at" and snake_case("HTTPServer") == "http_server"
    assert Author.meta.table == "author" and Taken.meta.keys == ["student_id", "course_id"]
    color = enum_type("Red", "Green")
    assert color.decode("Red") == "Red"
    with pytest.raises(ValueError):
        color.decode("Blue")
    with pytest.raises(DefinitionError):
        type("Two", (Entity,), {"id": field("int"), "a": updated_at(), "b": updated_at()}, table="two")
    with pytest.raises(DefinitionError):
        type("Bad", (Entity,), {"id": field("int"), "d": deleted_at("string")}, table="bad")
    with pytest.raises(DefinitionError):
        type("Bad", (Entity,), {"id": field("int"), "d": deleted_at(nullable=False)}, table="bad")

    class Item(Entity, table="item"):
        id = field("bigint", pk=True)
        name = field("string")
        made = created_at()

    class NewItem(Entity, creates=Item):
        name = field("string")

    assert NewItem.meta.table == "item" and NewItem(name="x") == NewItem(name="x") != NewItem(name="y")
    for fields in ({"id": field("bigint"), "name": field("string")}, {"name": field("int")}, {"other": field("string")}, {"made": created_at()}):
        with pytest.raises(DefinitionError):
            type("Wrong", (Entity,), fields, creates=Item)
    with pytest.raises(TypeError):
        Item(id=1)
    with pytest.raises(DefinitionError):
        BOOKS.via(BOOKS)


def test_raw_sql(spark, s):
    s.views("qb_user")
    inner = sql("age > :least", least=20)
    assert [r["id"] for r in s.sql("SELECT id FROM qb_user WHERE :test AND first_name <> ':x' ORDER BY id", test=inner).collect()] == [1, 2]
    assert s.sql(Fragment("SELECT :v AS v", {"v": "o'b\\'; --"})).first()[0] == "o'b\\'; --"
    u = TableInfo(User.meta).alias("u")
    assert s.sql("SELECT :all FROM :t WHERE :id = 3", all=u.all, t=u.table, id=u.id).first()["first_name"] == "Charlie"
    assert TableInfo(User.meta).insert_columns.text == "(`first_name`, `age`)"
    assert spark.range(1).select(F.expr(bound("concat(:a, ':b')", {"a": "q'\\"}))).first()[0] == "q'\\:b"
    with pytest.raises(DefinitionError):
        identifier("a; drop")
    with pytest.raises(DefinitionError):
        s.sql("SELECT :missing")
    assert "|" not in sql("SELECT 1\n  |FROM x").strip_margin().text


def test_logging(spark):
    said = []
    own = Session(spark, {"qb_user": spark.createDataFrame([(1, "A", 1)], User.meta.schema)}, logger=SqlLogger(said.append))
    Query(own, User).run()
    assert "query on qb_user took" in said[0]
    with pytest.raises(QueryFailed):
        own.sql("SELECT nothing FROM nowhere")
    assert said[-1].startswith("failed")
    slow = []
    Query(Session(spark, own._tables, logger=SqlLogger(slow.append, slow_after=60)), User).run()
    assert slow == []
