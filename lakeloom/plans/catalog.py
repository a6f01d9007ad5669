"""Named queries over the test tables, each with the DuckDB SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import migrate as M
from ..active import Active
from ..functions import aggregates as agg
from ..functions.aggregates import ordered
from ..migrate import issues_df
from ..model import NotFound
from ..operators.eager import EagerQuery
from ..operators.query import Query
from ..rawsql import TableInfo, sql
from ..relations import belongs_to_many
from ..repo import Observer, PivotRepo, Repo
from ..scopes import SoftDeletes, Timestamps, Where
from ..sources.session import Session
from .tables import (
    CUSTOMER, CUSTOMERS, EVENTS, ITEM_ORDER, ITEM_PART, ITEM_SUPPLIER, ITEMS, LABEL, LINKS, NATION, NATIONS, ORDER_PARTS, ORDERS,
    PART_LINKS, PART_SUPPLIERS, REGION, REGION_CUSTOMERS, REGION_CUSTOMERS_VIA, REGION_SUPPLIER, REGION_SUPPLIERS_VIA, SUPPLIERS, TRASHABLE,
    Customer, Document, LineItem, Nation, NewNation, NewPartLink, NewTimedNation, Order, OrderStatus, Part, PartLink, Region, Supplier, TimedNation,
    TrashableOrder, Vector, session_over, stored_session,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    """Registers a function of a session under its name."""
    def put(make: Callable[[Session], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(session_over(spark, sf_dir))
        if oracle:
            ORACLES[make.__name__] = oracle
        return make

    return put


def _frame(s: Session, entity, records) -> DataFrame:
    """Records as rows, to be compared."""
    meta = entity.meta
    return s.spark.createDataFrame([tuple(meta.values(r)[c] for c in meta.columns) for r in records], meta.schema)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by the balance of their wealthy customers: scope, join, group, having, top-k."""
    s = session_over(spark, sf_dir)
    wealthy = Query(s, Customer, [Where("wealthy", lambda c: c.c_acctbal > 1000)], scoped=True).join(NATION)
    made = wealthy.select(lambda j: {"nation": j.of(Nation).n_name, "n_customers": agg.count(), "balance": F.round(agg.total(j.of(Customer).c_acctbal), 2)})
    return made.group_by(lambda j: j.of(Nation).n_name).having(lambda j: agg.count() > 1).order_by("balance", descending=True).order_by("nation").limit(10).df()


# scans and lookups


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_projected(s):
    return Query(s, Nation).df()


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def scoped_scan(s):
    scopes = [Where("rich", lambda c: c.c_acctbal > 5000), Where("segment", lambda c: c.c_mktsegment == "BUILDING", lambda c: ordered(c.c_custkey))]
    return Query(s, Customer, scopes, scoped=True).df()


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 5000")
def query_without_scope(s):
    scopes = [Where("rich", lambda c: c.c_acctbal > 5000), Where("segment", lambda c: c.c_mktsegment == "BUILDING")]
    return Repo(s, Customer, scopes).query_without("segment").df()


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 42")
def find_by_id(s):
    return _frame(s, Customer, [Repo(s, Customer).find(42)])


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey IN (1, 7, 13, 99999999)")
def find_all_by_id(s):
    return Repo(s, Customer).rows_by_ids([1, 7, 13, 99999999])


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey < 3000 AND c_custkey % 2 = 0 AND c_custkey > 0")
def find_all_by_many_ids(s):
    return Repo(s, Customer).rows_by_ids(range(2, 3000, 2))


# conditions

_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_P = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"
_C = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


@query(f"SELECT {_O} FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def filter_and(s):
    return Query(s, Order).where(lambda c: c.o_orderstatus == "O").where(lambda c: c.o_totalprice > 100000).df()


@query(f"SELECT {_O} FROM orders WHERE ((o_orderstatus = 'O' AND o_totalprice > 200000) OR o_orderpriority = '1-URGENT') AND o_totalprice < 300000")
def filter_or(s):
    q = Query(s, Order).where(lambda c: c.o_orderstatus == "O").where(lambda c: c.o_totalprice > 200000)
    return q.or_where(lambda c: c.o_orderpriority == "1-URGENT").where(lambda c: c.o_totalprice < 300000).df()


@query(f"SELECT {_O} FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice < 50000 OR o_orderpriority = '5-LOW')")
def filter_grouped(s):
    return Query(s, Order).where(lambda c: (c.o_orderstatus == "F") & ((c.o_totalprice < 50000) | (c.o_orderpriority == "5-LOW"))).df()


@query(f"SELECT {_P} FROM part WHERE p_size >= 10 AND p_size <= 30 AND p_size <> 20 AND p_retailprice > 950 AND p_retailprice < 1500")
def cmp_value(s):
    return Query(s, Part).where(lambda c: (c.p_size >= 10) & (c.p_size <= 30) & (c.p_size != 20) & (c.p_retailprice > 950) & (c.p_retailprice < 1500)).df()


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount < l_tax AND l_partkey <> l_suppkey")
def cmp_column(s):
    q = Query(s, LineItem).where(lambda c: c.l_discount < c.l_tax).where(lambda c: c.l_partkey != c.l_suppkey)
    return q.select(lambda c: {"l_orderkey": c.l_orderkey, "l_linenumber": c.l_linenumber, "l_discount": c.l_discount, "l_tax": c.l_tax}).df()


@query("SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'F') IS NULL")
def is_null(s):
    return Query(s, Order).where(lambda c: F.nullif(c.o_orderstatus, F.lit("F")).isNull()).select(lambda c: {"o_orderkey": c.o_orderkey}).df()


@query("SELECT o_orderkey FROM trashable WHERE deleted_at IS NOT NULL".replace("trashable", "(SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at FROM orders) t"))
def is_not_null(s):
    return Query(s, TrashableOrder).where(lambda c: c.deleted_at.isNotNull()).select(lambda c: {"o_orderkey": c.o_orderkey}).df()


@query(f"SELECT {_O} FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_list(s):
    return Query(s, Order).where(lambda c: c.o_orderpriority.isin("1-URGENT", "2-HIGH")).df()


@query(f"SELECT {_O} FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def not_in_list(s):
    return Query(s, Order).where(lambda c: ~c.o_orderpriority.isin("1-URGENT", "2-HIGH")).df()


@query(f"SELECT {_C} FROM customer WHERE 1 = 0")
def in_empty(s):
    return Query(s, Customer).where(lambda c: c.c_custkey.isin([])).df()


@query(f"SELECT {_C} FROM customer WHERE 1 = 1")
def not_in_empty(s):
    return Query(s, Customer).where(lambda c: ~c.c_custkey.isin([])).df()


@query(f"SELECT {_P} FROM part WHERE p_retailprice BETWEEN 920 AND 960.5")
def between(s):
    return Query(s, Part).where(lambda c: c.p_retailprice.between(920, 960.5)).df()


@query(f"SELECT {_P} FROM part WHERE p_type LIKE '%BRASS%' OR p_brand LIKE 'Brand#1_'")
def like(s):
    return Query(s, Part).where(lambda c: c.p_type.like("%BRASS%") | c.p_brand.like("Brand#1_")).df()


@query(f"SELECT {_P} FROM part WHERE p_brand NOT LIKE 'Brand#1%'")
def not_like(s):
    return Query(s, Part).where(lambda c: ~c.p_brand.like("Brand#1%")).df()


@query(f"SELECT {_P} FROM part WHERE p_brand ILIKE 'brand#2%'")
def ilike(s):
    return Query(s, Part).where(lambda c: c.p_brand.ilike("brand#2%")).df()


@query(f"SELECT {_C} FROM customer WHERE length(c_name) % 2 = 0 AND c_acctbal > 2500.5")
def raw_predicate(s):
    return Query(s, Customer).where(agg.raw("length(c_name) % :two = 0 AND c_acctbal > :least", two=2, least=2500.5)).df()


# projections


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'P'")
def project_columns(s):
    return Query(s, Order).where(lambda c: c.o_orderstatus == "P").select(lambda c: {"id": c.o_orderkey, "price": c.o_totalprice}).df()


@query("SELECT c_custkey, upper(c_mktsegment) AS segment, length(c_name) AS name_length FROM customer")
def raw_expr(s):
    return Query(s, Customer).select(lambda c: {"c_custkey": c.c_custkey, "segment": agg.raw("upper(c_mktsegment)"), "name_length": agg.raw("cast(length(c_name) as bigint)")}).df()


@query("SELECT DISTINCT n_nationkey, n_name, n_regionkey FROM nation")
def distinct_rows(s):
    return Query(s, Nation).distinct().df()


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_projection(s):
    return Query(s, Customer).select(lambda c: {"c_mktsegment": c.c_mktsegment, "c_nationkey": c.c_nationkey}).distinct().df()


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(s):
    from .tables import Event

    return Query(s, Event).select(lambda c: {"event_id": c.event_id, "k": F.get_json_object(c.props, "$.k").cast("bigint")}).df()


@query("SELECT vec_id, len(embedding) AS dims, label FROM embeddings WHERE embedding[1] > 0 AND label = 1")
def array_field(s):
    q = Query(s, Vector).where(lambda c: F.get(c.embedding, F.lit(0)) > 0).where(lambda c: c.label == 1)
    return q.select(lambda c: {"vec_id": c.vec_id, "dims": F.size(c.embedding).cast("bigint"), "label": c.label}).df()


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'widget') AND NOT list_contains(string_split(p_name, ' '), 'red')")
def array_contains_tag(s):
    has = lambda c, tag: F.array_contains(F.split(c.p_name, " "), tag)
    q = Query(s, Part).where(lambda c: has(c, "widget")).where(lambda c: ~has(c, "red"))
    return q.select(lambda c: {"p_partkey": c.p_partkey, "p_name": c.p_name}).df()


# aggregates


@query("SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'O'")
def agg_count(s):
    return Query(s, Order).where(lambda c: c.o_orderstatus == "O").count_df()


@query("SELECT count(NULLIF(o_orderstatus, 'F')) AS count FROM orders")
def agg_count_col(s):
    return Query(s, Order).count_df(lambda c: F.nullif(c.o_orderstatus, F.lit("F")))


@query("SELECT round(sum(o_totalprice), 2) AS total, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders WHERE o_totalprice > 1000")
def agg_sum(s):
    return Query(s, Order).where(lambda c: c.o_totalprice > 1000).aggregate(total=lambda c: F.round(F.sum(c.o_totalprice), 2), keys=lambda c: F.sum(c.o_custkey))


@query("SELECT round(avg(o_totalprice), 2) AS mean FROM orders")
def agg_avg(s):
    return Query(s, Order).aggregate(mean=lambda c: F.round(agg.average(c.o_totalprice), 2))


@query("SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first_day FROM orders")
def agg_min_max(s):
    return Query(s, Order).aggregate(lo=lambda c: agg.least(c.o_totalprice), hi=lambda c: agg.greatest(c.o_totalprice), first_day=lambda c: agg.least(c.o_orderdate))


@query("SELECT CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS total, 0::BIGINT AS n")
def agg_empty(s):
    return Query(s, Order).where(lambda c: c.o_totalprice < 0).aggregate(lo=lambda c: F.min(c.o_totalprice), total=lambda c: F.sum(c.o_totalprice), n=lambda c: F.count("*"))


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000) AS found, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS missing")
def exists_flag(s):
    found = [Query(s, Order).where(lambda c, n=n, up=up: c.o_totalprice > n if up else c.o_totalprice < n).exists() for n, up in ((100000, True), (0, False))]
    return s.spark.createDataFrame([tuple(found)], "found boolean, missing boolean")


@query("SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_custkey) AS lo, max(o_custkey) AS hi, count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def agg_scalars(s):
    q, price = Query(s, Order).where(lambda c: c.o_orderstatus == "O"), lambda c: c.o_totalprice
    row = (round(q.sum(price), 2), round(q.avg(price), 4), q.min(lambda c: c.o_custkey), q.max(lambda c: c.o_custkey), q.count())
    return s.spark.createDataFrame([row], "total double, mean double, lo bigint, hi bigint, n bigint")


@query("SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS segments, round(sum(c_acctbal), 2) AS balance FROM customer")
def agg_projection(s):
    return Query(s, Customer).select(lambda c: {"n": agg.count(), "segments": agg.count_distinct(c.c_mktsegment), "balance": F.round(agg.total(c.c_acctbal), 2)}).df()


def _orders_by_status(s, **more):
    return Query(s, Order).select(lambda c: {"o_orderstatus": c.o_orderstatus} | {k: f(c) for k, f in more.items()}).group_by(lambda c: c.o_orderstatus)


@query("SELECT o_orderstatus, count(*) AS n, count(NULLIF(o_orderpriority, '5-LOW')) AS not_low FROM orders GROUP BY o_orderstatus")
def group_count(s):
    return _orders_by_status(s, n=lambda c: agg.count(), not_low=lambda c: agg.count(F.nullif(c.o_orderpriority, F.lit("5-LOW")))).df()


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def group_count_distinct(s):
    return _orders_by_status(s, customers=lambda c: agg.count_distinct(c.o_custkey)).df()


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY o_orderstatus")
def group_sum_avg(s):
    return _orders_by_status(s, total=lambda c: F.round(agg.total(c.o_totalprice), 2), mean=lambda c: F.round(agg.average(c.o_totalprice), 2)).df()


@query("SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus")
def group_min_max(s):
    return _orders_by_status(s, lo=lambda c: agg.least(c.o_totalprice), hi=lambda c: agg.greatest(c.o_totalprice)).df()


@query("SELECT o_orderstatus, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_multi(s):
    return _orders_by_status(s, priority=lambda c: c.o_orderpriority, n=lambda c: agg.count()).group_by(lambda c: c.o_orderpriority).df()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 200000")
def having(s):
    q = Query(s, Order).select(lambda c: {"o_custkey": c.o_custkey, "n": agg.count()}).group_by(lambda c: c.o_custkey)
    return q.having(lambda c: agg.count() > 12).having(lambda c: agg.greatest(c.o_totalprice) > 200000).df()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 OR min(o_totalprice) > 200000")
def or_having(s):
    q = Query(s, Order).select(lambda c: {"o_custkey": c.o_custkey, "n": agg.count()}).group_by(lambda c: c.o_custkey)
    return q.having(lambda c: agg.count() > 15).or_having(lambda c: agg.least(c.o_totalprice) > 200000).df()


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10")
def group_topk(s):
    q = Query(s, Order).select(lambda c: {"o_custkey": c.o_custkey, "total": F.round(agg.total(c.o_totalprice), 2)}).group_by(lambda c: c.o_custkey)
    return q.order_by(lambda c: agg.total(c.o_totalprice), descending=True).order_by("o_custkey").limit(10).df()


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(s):
    q = Query(s, LineItem).where(lambda c: c.l_shipdate <= F.expr("TIMESTAMP_NTZ '1998-09-02'"))
    made = q.select(lambda c: {"l_returnflag": c.l_returnflag, "l_linestatus": c.l_linestatus, "qty": F.round(agg.total(c.l_quantity), 2), "revenue": F.round(agg.total(c.l_extendedprice * (1 - c.l_discount)), 2), "n": agg.count()})
    return made.group_by(lambda c: c.l_returnflag, lambda c: c.l_linestatus).df()


# joins


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner(s):
    return Query(s, Customer).join(NATION).select(lambda j: {"c_custkey": j.of(Customer).c_custkey, "n_name": j.of(Nation).n_name}).df()


@query("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def join_left(s):
    return Query(s, Order).left_join(ITEMS).select(lambda j: {"o_orderkey": j.of(Order).o_orderkey, "l_linenumber": j.of(LineItem).l_linenumber}).df()


@query("SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0")
def join_left_scoped(s):
    return Query(s, Nation, scoped=True).left_join(SUPPLIERS).select(lambda j: {"n_name": j.of(Nation).n_name, "s_suppkey": j.of(Supplier).s_suppkey}).df()


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_chain3(s):
    q = Query(s, Order).join(CUSTOMER).join(NATION).join(REGION)
    return q.select(lambda j: {"o_orderkey": j.of(Order).o_orderkey, "c_name": j.of(Customer).c_name, "n_name": j.of(Nation).n_name, "r_name": j.of(Region).r_name}).df()


@query("SELECT p_brand, s_nationkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_brand, s_nationkey")
def join_star(s):
    q = Query(s, LineItem).join(ITEM_PART).join(ITEM_SUPPLIER)
    made = q.select(lambda j: {"p_brand": j.of(Part).p_brand, "s_nationkey": j.of(Supplier).s_nationkey, "n": agg.count()})
    return made.group_by(lambda j: j.of(Part).p_brand, lambda j: j.of(Supplier).s_nationkey).df()


@query("SELECT o_orderkey, c_name, l_linenumber FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def join_mixed(s):
    q = Query(s, Order).where(lambda c: c.o_orderstatus == "P").join(CUSTOMER).left_join(ITEMS)
    return q.select(lambda j: {"o_orderkey": j.of(Order).o_orderkey, "c_name": j.of(Customer).c_name, "l_linenumber": j.of(LineItem).l_linenumber}).df()


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (c_acctbal > 9000 AND n_regionkey = 1) OR c_acctbal < -900")
def join_where(s):
    q = Query(s, Customer).join(NATION).where(lambda j: j.of(Customer).c_acctbal > 9000).where(lambda j: j.of(Nation).n_regionkey == 1)
    return q.or_where(lambda j: j.of(Customer).c_acctbal < -900).select(lambda j: {"c_custkey": j.of(Customer).c_custkey, "n_name": j.of(Nation).n_name}).df()


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE ((c_acctbal > 9000 OR c_mktsegment = 'BUILDING') AND n_regionkey = 1) OR n_name = 'NATION_3'")
def join_or_root(s):
    root = Query(s, Customer).where(lambda c: c.c_acctbal > 9000).or_where(lambda c: c.c_mktsegment == "BUILDING")
    q = root.join(NATION).where(lambda j: j.of(Nation).n_regionkey == 1).or_where(lambda j: j.of(Nation).n_name == "NATION_3")
    return q.select(lambda j: {"c_custkey": j.of(Customer).c_custkey, "n_name": j.of(Nation).n_name}).df()


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE (o_totalprice > 200000 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)) OR c_acctbal > 9900")
def join_or_root_exists(s):
    root = Query(s, Order).where(lambda c: c.o_totalprice > 200000).where_has(ITEMS, lambda i: i.l_quantity >= 49)
    return root.join(CUSTOMER).or_where(lambda j: j.of(Customer).c_acctbal > 9900).select(lambda j: {"o_orderkey": j.of(Order).o_orderkey, "c_name": j.of(Customer).c_name}).df()


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 5")
def join_order_limit(s):
    q = Query(s, Order).join(CUSTOMER).order_by(lambda j: j.of(Order).o_totalprice, descending=True).order_by(lambda j: j.of(Order).o_orderkey).offset(5).limit(7)
    return q.df().select("t0.o_orderkey", "t1.c_name")


@query("SELECT count(*) AS count FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 25")
def join_count(s):
    return Query(s, Order).join(ITEMS).where(lambda j: j.of(LineItem).l_quantity > 25).count_df()


@query("SELECT DISTINCT o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_project(s):
    return Query(s, Order).join(CUSTOMER).select(lambda j: {"o_orderpriority": j.of(Order).o_orderpriority, "c_mktsegment": j.of(Customer).c_mktsegment}).distinct().df()


@query("SELECT n_name, count(*) AS n, round(avg(c_acctbal), 2) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 55 ORDER BY n DESC, n_name LIMIT 8")
def join_group_having(s):
    made = Query(s, Customer).join(NATION).select(lambda j: {"n_name": j.of(Nation).n_name, "n": agg.count(), "mean": F.round(agg.average(j.of(Customer).c_acctbal), 2)})
    return made.group_by(lambda j: j.of(Nation).n_name).having(lambda j: agg.count() > 55).order_by("n", descending=True).order_by("n_name").limit(8).df()


@query("SELECT l_linenumber, o_orderkey FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey")
def join_right(s):
    return Query(s, LineItem).right_join(ITEM_ORDER).select(lambda j: {"l_linenumber": j.of(LineItem).l_linenumber, "o_orderkey": j.of(Order).o_orderkey}).df()


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(s):
    return Query(s, Region).cross_join(Nation).select(lambda j: {"r_name": j.of(Region).r_name, "n_name": j.of(Nation).n_name}).df()


# existence and counts


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def where_has(s):
    return Query(s, Order).where_has(ITEMS).select(lambda c: {"o_orderkey": c.o_orderkey}).df()


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 8000) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def where_has_cond(s):
    q = Query(s, Order).where_has(CUSTOMER, lambda c: c.c_acctbal > 8000).where_has(ITEMS, lambda c: c.l_quantity >= 49)
    return q.select(lambda c: {"o_orderkey": c.o_orderkey}).df()


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def where_has_pivot(s):
    return Query(s, Part).where_has(PART_SUPPLIERS).select(lambda c: {"p_partkey": c.p_partkey}).df()


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 9500)")
def where_has_pivot_cond(s):
    return Query(s, Part).where_has(PART_SUPPLIERS, lambda c: c.s_acctbal > 9500).select(lambda c: {"p_partkey": c.p_partkey}).df()


@query("SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900))")
def where_has_nested(s):
    return Query(s, Region).where_has(NATIONS, lambda n: n.where_has(CUSTOMERS, lambda c: c.c_acctbal > 9900)).select(lambda c: {"r_name": c.r_name}).df()


@query("""SELECT c_custkey FROM customer WHERE c_acctbal < -800 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
          AND (o_totalprice > 400000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50)))""")
def where_has_nested_or(s):
    q = Query(s, Customer).where(lambda c: c.c_acctbal < -800)
    q = q.or_where_has(ORDERS, lambda o: (o.o_totalprice > 400000) | o.where_has(ITEMS, lambda i: i.l_quantity >= 50))
    return q.select(lambda c: {"c_custkey": c.c_custkey}).df()


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def doesnt_have(s):
    return Query(s, Order).doesnt_have(ITEMS).select(lambda c: {"o_orderkey": c.o_orderkey}).df()


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def doesnt_have_one(s):
    return Query(s, Document).doesnt_have(LABEL).select(lambda c: {"doc_id": c.doc_id}).df()


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size > 10)")
def doesnt_have_pivot(s):
    return Query(s, Order).doesnt_have(ORDER_PARTS, lambda p: p.p_size > 10).select(lambda c: {"o_orderkey": c.o_orderkey}).df()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.1)")
def or_where_has(s):
    return Query(s, Order).where(lambda c: c.o_totalprice > 300000).or_where_has(ITEMS, lambda i: i.l_discount >= 0.1).select(lambda c: {"o_orderkey": c.o_orderkey}).df()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def or_doesnt_have(s):
    return Query(s, Order).where(lambda c: c.o_totalprice > 300000).or_doesnt_have(ITEMS).select(lambda c: {"o_orderkey": c.o_orderkey}).df()


@query(f"SELECT {_C}, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def with_count(s):
    return Query(s, Customer).with_count(ORDERS, name="n_orders").df()


@query(f"SELECT {_C}, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) AS n_orders FROM customer")
def with_count_cond(s):
    return Query(s, Customer).with_count(ORDERS, lambda o: o.o_totalprice > 250000, name="n_orders").df()


@query(f"SELECT {_C}, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) AS n_orders FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 10")
def with_count_top(s):
    q = Query(s, Customer).order_by(lambda c: c.c_acctbal, descending=True).order_by(lambda c: c.c_custkey).offset(10).limit(50)
    return q.with_count(ORDERS, lambda o: o.o_totalprice > 250000, name="n_orders").df()


@query("SELECT p_partkey, (SELECT count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 5000) AS n FROM part")
def with_count_pivot(s):
    return Query(s, Part).with_count(PART_SUPPLIERS, lambda c: c.s_acctbal > 5000, name="n").df().select("p_partkey", "n")


@query("SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 12")
def has_count(s):
    return Query(s, Customer).has(ORDERS, lambda n: n >= 12).select(lambda c: {"c_custkey": c.c_custkey}).df()


@query("SELECT p_partkey FROM part WHERE (SELECT count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 9000) < 2")
def has_count_cond(s):
    return Query(s, Part).has(PART_SUPPLIERS, lambda n: n < 2, lambda c: c.s_acctbal > 9000).select(lambda c: {"p_partkey": c.p_partkey}).df()


@query("SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM events WHERE user_id = c_custkey) = 0")
def has_count_zero(s):
    return Query(s, Customer).has(EVENTS, lambda n: n == 0).select(lambda c: {"c_custkey": c.c_custkey}).df()


@query("SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) <= 5 AND (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) <> 3 AND (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 1")
def has_count_others(s):
    return Query(s, Customer).has(ORDERS, lambda n: n <= 5).has(ORDERS, lambda n: n != 3).has(ORDERS, lambda n: n > 1).select(lambda c: {"c_custkey": c.c_custkey}).df()


@query("SELECT r_name, (SELECT count(*) FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_regionkey = r_regionkey AND c_acctbal > 5000) AS n FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE n_regionkey = r_regionkey AND s_acctbal > 5000)")
def composed_exists_and_count(s):
    q = Query(s, Region).where_has(REGION_SUPPLIERS_VIA, lambda c: c.s_acctbal > 5000)
    return q.with_count(REGION_CUSTOMERS_VIA, lambda c: c.c_acctbal > 5000, name="n").df().select("r_name", "n")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9500 OR (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 18")
def has_count_or(s):
    return Query(s, Customer).where(lambda c: c.c_acctbal > 9500).or_where(lambda c: c.has(ORDERS, lambda n: n >= 18)).select(lambda c: {"c_custkey": c.c_custkey}).df()


@query("SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_regionkey = r_regionkey AND c_acctbal > 9990)")
def where_has_through(s):
    return Query(s, Region).where_has(REGION_CUSTOMERS, lambda c: c.c_acctbal > 9990).select(lambda c: {"r_name": c.r_name}).df()


# scopes


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F' AND o_totalprice > 350000)")
def scope_transitive_exists(s):
    return Query(s, Customer, scoped=True).where_has(TRASHABLE, lambda o: o.o_totalprice > 350000).select(lambda c: {"c_custkey": c.c_custkey}).df()


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F') AS n FROM customer")
def scope_transitive_count(s):
    return Query(s, Customer, scoped=True).with_count(TRASHABLE, name="n").df().select("c_custkey", "n")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'F'")
def scope_transitive_join(s):
    return Query(s, Customer, scoped=True).left_join(TRASHABLE).select(lambda j: {"c_custkey": j.of(Customer).c_custkey, "o_orderkey": j.of(TrashableOrder).o_orderkey}).df()


@query("SELECT o_orderkey FROM orders")
def with_trashed(s):
    return Repo(s, TrashableOrder, [SoftDeletes(TrashableOrder)]).with_trashed().select(lambda c: {"o_orderkey": c.o_orderkey}).df()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def only_trashed(s):
    return Repo(s, TrashableOrder, [SoftDeletes(TrashableOrder)]).only_trashed().select(lambda c: {"o_orderkey": c.o_orderkey}).df()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND (o_totalprice > 300000 OR o_custkey < 10)")
def scope_holds_under_or(s):
    q = Repo(s, TrashableOrder, [SoftDeletes(TrashableOrder)]).query().where(lambda c: c.o_totalprice > 300000)
    return q.or_where(lambda c: c.o_custkey < 10).select(lambda c: {"o_orderkey": c.o_orderkey}).df()


# eager and lazy loading; lists become counts and sums, which compare alike everywhere


def _sizes(q: EagerQuery, key: str, *lists: tuple[str, str]) -> DataFrame:
    rows = q.df()
    total = lambda k, c: F.aggregate(F.col(f"related_{k}"), F.lit(0).cast("bigint"), lambda a, x: a + x[c].cast("bigint"))
    return rows.select(key, *[x for k, (name, c) in enumerate(lists) for x in (F.size(f"related_{k}").cast("bigint").alias(f"n_{name}"), total(k, c).alias(f"sum_{name}"))])


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS sum_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def eager_has_many(s):
    return _sizes(Query(s, Customer).with_related(ORDERS), "c_custkey", ("orders", "o_orderkey"))


@query("SELECT p_partkey, count(s_suppkey) AS n_suppliers, CAST(coalesce(sum(s_suppkey), 0) AS BIGINT) AS sum_suppliers FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_partkey")
def eager_pivot(s):
    return _sizes(Query(s, Part).with_related(PART_SUPPLIERS), "p_partkey", ("suppliers", "s_suppkey"))


@query("SELECT r_regionkey, count(c_custkey) AS n_customers, CAST(coalesce(sum(c_custkey), 0) AS BIGINT) AS sum_customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey")
def eager_through(s):
    return _sizes(Query(s, Region).with_related(REGION_CUSTOMERS), "r_regionkey", ("customers", "c_custkey"))


@query("SELECT r_regionkey, count(s_suppkey) AS n_suppliers, CAST(coalesce(sum(s_suppkey), 0) AS BIGINT) AS sum_suppliers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_regionkey")
def eager_via(s):
    return _sizes(Query(s, Region).with_related(REGION_SUPPLIERS_VIA), "r_regionkey", ("suppliers", "s_suppkey"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS sum_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def eager_cond(s):
    return _sizes(Query(s, Customer).with_related(ORDERS, lambda o: o.o_orderstatus == "O"), "c_custkey", ("orders", "o_orderkey"))


def _items(q: EagerQuery, key: str, *columns: str, at: str = "related_0", of: str = "") -> DataFrame:
    """A row for each related record, with what it holds."""
    item = F.explode(at).alias("item")
    return q.df().select(key, item).select(key, *[F.col(f"item.{of}{c}").alias(c) for c in columns])


@query("SELECT c_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100) JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O'")
def eager_top_rows(s):
    q = Query(s, Customer).order_by(lambda c: c.c_acctbal, descending=True).order_by(lambda c: c.c_custkey).limit(100)
    return _items(q.with_related(ORDERS, lambda o: o.o_orderstatus == "O"), "c_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query("SELECT c_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM customer JOIN orders ON o_custkey = c_custkey")
def eager_has_many_rows(s):
    return _items(Query(s, Customer).with_related(ORDERS), "c_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query("SELECT p_partkey, s_suppkey, s_name, s_acctbal FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def eager_pivot_rows(s):
    return _items(Query(s, Part).with_related(PART_SUPPLIERS), "p_partkey", "s_suppkey", "s_name", "s_acctbal")


@query("SELECT p_partkey, s_name, l_orderkey, l_linenumber, l_quantity FROM part JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 40 JOIN supplier ON l_suppkey = s_suppkey")
def eager_with_pivot_rows(s):
    rows = Query(s, Part).with_related_and_pivot(LINKS, pivot=lambda v: v.l_quantity > 40).df().select("p_partkey", F.explode("related_0").alias("i"))
    return rows.select("p_partkey", "i.target.s_name", "i.pivot.l_orderkey", "i.pivot.l_linenumber", "i.pivot.l_quantity")


@query("SELECT r_regionkey, c_custkey, c_name, c_mktsegment FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def eager_through_rows(s):
    return _items(Query(s, Region).with_related(REGION_CUSTOMERS), "r_regionkey", "c_custkey", "c_name", "c_mktsegment")


@query("SELECT r_regionkey, s_suppkey, s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey <= 5")
def eager_has_one_through(s):
    return _items(Query(s, Region).with_related(REGION_SUPPLIER, lambda c: c.s_suppkey <= 5), "r_regionkey", "s_suppkey", "s_name")


@query("SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE n_regionkey = r_regionkey AND s_suppkey <= 2)")
def where_has_one_through(s):
    return Query(s, Region).where_has(REGION_SUPPLIER, lambda c: c.s_suppkey <= 2).select(lambda c: {"r_name": c.r_name}).df()


@query("SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def eager_belongs_to_rows(s):
    return _items(Query(s, Order).with_related(CUSTOMER), "o_orderkey", "c_custkey", "c_name")


@query("SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)")
def eager_has_one_rows(s):
    return _items(Query(s, Document).with_related(LABEL), "doc_id", "quality", "toxic")


@query("SELECT n_nationkey, s_suppkey, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def eager_chain_rows(s):
    return _items(Query(s, Nation).with_related(CUSTOMERS).with_related(SUPPLIERS), "n_nationkey", "s_suppkey", "s_name", at="related_1")


@query("SELECT r_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region ORDER BY r_name LIMIT 1")
def eager_first(s):
    record, nations = Query(s, Region).order_by(lambda c: c.r_name).with_related(NATIONS).first()
    return s.spark.createDataFrame([(record.r_regionkey, len(nations))], "r_regionkey int, n bigint")


@query("""SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, (SELECT CAST(coalesce(sum(c_custkey), 0) AS BIGINT) FROM customer WHERE c_nationkey = n_nationkey) AS sum_customers,
          (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers, (SELECT CAST(coalesce(sum(s_suppkey), 0) AS BIGINT) FROM supplier WHERE s_nationkey = n_nationkey) AS sum_suppliers FROM nation""")
def eager_chain(s):
    return _sizes(Query(s, Nation).with_related(CUSTOMERS).with_related(SUPPLIERS), "n_nationkey", ("customers", "c_custkey"), ("suppliers", "s_suppkey"))


@query("SELECT p_partkey, count(l_orderkey) AS n, CAST(coalesce(sum(l_orderkey + s_suppkey), 0) AS BIGINT) AS both_keys FROM part LEFT JOIN (lineitem JOIN supplier ON l_suppkey = s_suppkey) ON l_partkey = p_partkey AND l_quantity > 40 GROUP BY p_partkey")
def eager_with_pivot(s):
    rows = Query(s, Part).with_related_and_pivot(LINKS, pivot=lambda v: v.l_quantity > 40).df()
    both = F.aggregate("related_0", F.lit(0).cast("bigint"), lambda a, x: a + x["pivot"]["l_orderkey"] + x["target"]["s_suppkey"])
    return rows.select("p_partkey", F.size("related_0").cast("bigint").alias("n"), both.alias("both_keys"))


@query(f"SELECT {_O} FROM orders WHERE o_custkey = 7")
def lazy_load(s):
    return _frame(s, Order, Active(Repo(s, Customer), Repo(s, Customer).find(7)).load(ORDERS))


@query(f"SELECT {_C} FROM customer WHERE c_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 5)")
def lazy_load_one(s):
    return _frame(s, Customer, [Active(Repo(s, Order), Repo(s, Order).find(5)).load_one(CUSTOMER)])


# order, extent, pages


@query("SELECT o_orderkey, NULLIF(o_orderpriority, '5-LOW') AS priority FROM orders ORDER BY priority DESC NULLS FIRST, o_orderkey LIMIT 40")
def order_nulls(s):
    q = Query(s, Order).select(lambda c: {"o_orderkey": c.o_orderkey, "priority": F.nullif(c.o_orderpriority, F.lit("5-LOW"))})
    return q.order_by("priority", descending=True, nulls="first").order_by("o_orderkey").limit(40).df()


@query(f"SELECT {_O} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def order_limit_offset(s):
    return Query(s, Order).limit(25).offset(50).order_by(lambda c: c.o_totalprice, descending=True).order_by(lambda c: c.o_orderkey).df()


@query(f"SELECT {_O} FROM orders ORDER BY length(o_orderpriority) DESC, o_orderkey LIMIT 5")
def order_raw(s):
    return Query(s, Order).order_by_raw("length(o_orderpriority) DESC").order_by_raw("o_orderkey").limit(5).df()


@query(f"SELECT {_O} FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_row(s):
    return _frame(s, Order, [Query(s, Order).order_by(lambda c: c.o_orderdate).order_by(lambda c: c.o_orderkey).first_or_fail()])


@query(f"SELECT {_C} FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def paginate_offset(s):
    return _frame(s, Customer, Query(s, Customer).order_by(lambda c: c.c_custkey).paginate(3, 20).items)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, true AS has_next, true AS has_prev FROM customer")
def paginate_totals(s):
    page = Query(s, Customer).order_by(lambda c: c.c_custkey).paginate(3, 20)
    return s.spark.createDataFrame([(page.total, page.total_pages, page.has_next, page.has_prev)], "total bigint, pages bigint, has_next boolean, has_prev boolean")


@query("SELECT n_nationkey, n_name, n_regionkey, (row_number() OVER (ORDER BY n_nationkey) - 1) // 7 AS chunk FROM nation")
def chunks(s):
    found = [(r.n_nationkey, r.n_name, r.n_regionkey, k) for k, part in enumerate(Query(s, Nation).order_by(lambda c: c.n_nationkey).chunk(7)) for r in part]
    return s.spark.createDataFrame(found, "n_nationkey int, n_name string, n_regionkey int, chunk bigint")


@query(f"SELECT {_C} FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 20")
def paginate_keyset(s):
    return Query(s, Customer).keyset_paginate(20).asc(lambda c: c.c_custkey).after(100).df()


@query(f"SELECT {_O} FROM orders WHERE o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND (o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 5))) ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 30")
def paginate_keyset_mixed(s):
    page = Query(s, Order).keyset_paginate(30).asc(lambda c: c.o_orderpriority).desc(lambda c: c.o_totalprice).asc(lambda c: c.o_orderkey)
    return page.after("2-HIGH", 200000.0, 5).df()


# row changes through the API: the table as it is afterwards


def _nations(s):
    return stored_session(s, "nation")


def _rows(s, entity):
    return s.table(entity.meta)


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'CHANGED' ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_where(s):
    t = _nations(s)
    Query(t, Nation).where(lambda c: c.n_regionkey == 1).update(n_name="CHANGED")
    return _rows(t, Nation)


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def update_expr(s):
    t = stored_session(s, "customer")
    Query(t, Customer).where(lambda c: c.c_mktsegment == "BUILDING").update_expr({"c_acctbal": "c_acctbal * 2"})
    return _rows(t, Customer)


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 10 THEN n_regionkey + 3 ELSE n_regionkey END AS n_regionkey FROM nation")
def increment(s):
    t = _nations(s)
    Query(t, Nation).where(lambda c: c.n_nationkey < 10).increment("n_regionkey", 3)
    return _rows(t, Nation)


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 10 OR n_regionkey = 4 THEN n_regionkey - 2 ELSE n_regionkey END AS n_regionkey FROM nation")
def decrement(s):
    t = _nations(s)
    Query(t, Nation).where(lambda c: c.n_nationkey < 10).or_where(lambda c: c.n_regionkey == 4).decrement("n_regionkey", 2)
    return _rows(t, Nation)


@query("SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status FROM orders WHERE NOT coalesce(NULLIF(o_orderstatus, 'P') = 'F', false)")
def delete_where(s):
    status = Query(s, Order).select(lambda c: {"o_orderkey": c.o_orderkey, "status": F.nullif(c.o_orderstatus, F.lit("P"))}).df()
    t = stored_session(s, order_status=status)
    Query(t, OrderStatus).where(lambda c: c.status == "F").delete()
    return _rows(t, OrderStatus)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE NOT (c_acctbal < 5000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000))")
def delete_where_missing(s):
    t = stored_session(s, "customer", "orders")
    Query(t, Customer).where(lambda c: c.c_acctbal < 5000).doesnt_have(ORDERS, lambda o: o.o_totalprice > 300000).delete()
    return _rows(t, Customer)


@query("SELECT * FROM nation WHERE n_nationkey NOT IN (3, 4) UNION ALL SELECT 3, 'THREE', 0 UNION ALL SELECT 4, 'FOUR', 1 UNION ALL SELECT 99, 'NEW', 2")
def upsert_by_pk(s):
    t = _nations(s)
    Repo(t, Nation).upsert_all([Nation(n_nationkey=k, n_name=n, n_regionkey=r) for k, n, r in ((3, "THREE", 0), (4, "FOUR", 1), (99, "NEW", 2))])
    return _rows(t, Nation)


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey <= 500 THEN 1.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer UNION ALL SELECT 10000000 + c_custkey, c_name, c_nationkey, 1.5, c_mktsegment FROM customer WHERE c_custkey <= 20")
def upsert_frame(s):
    t = stored_session(s, "customer")
    known, new = _rows(t, Customer).where("c_custkey <= 500"), _rows(t, Customer).where("c_custkey <= 20").withColumn("c_custkey", F.col("c_custkey") + 10000000)
    Repo(t, Customer).upsert_frame(known.unionByName(new).withColumn("c_acctbal", F.lit(1.5)))
    return _rows(t, Customer)


@query("SELECT * FROM nation WHERE n_nationkey NOT IN (1, 2, 3)")
def delete_by_ids(s):
    t = _nations(s)
    Repo(t, Nation).delete_all_by_id([1, 2, 3])
    return _rows(t, Nation)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE NOT (c_custkey BETWEEN 2 AND 2999 AND c_custkey % 2 = 0)")
def delete_by_many_ids(s):
    t = stored_session(s, "customer")
    Repo(t, Customer).delete_all_by_id(range(2, 3000, 2))
    return _rows(t, Customer)


@query("SELECT * FROM nation WHERE n_nationkey <> 7")
def delete_record(s):
    t = _nations(s)
    repo = Repo(t, Nation)
    repo.delete(repo.find_or_fail(7))
    return _rows(t, Nation)


@query("SELECT * FROM nation WHERE 1 = 0")
def truncate(s):
    t = _nations(s)
    Repo(t, Nation).truncate()
    return _rows(t, Nation)


@query("SELECT * FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + 1, 'A', 0 UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + 2, 'B', 1")
def insert_append(s):
    t = _nations(s)
    Repo(t, Nation).raw_insert_all([NewNation(n_name="A", n_regionkey=0), NewNation(n_name="B", n_regionkey=1)])
    return _rows(t, Nation)


@query("SELECT * FROM customer UNION ALL SELECT c_custkey + 50000000, 'copy', c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 9000")
def insert_frame(s):
    t = stored_session(s, "customer")
    Repo(t, Customer).insert_frame(_rows(t, Customer).where("c_acctbal > 9000").withColumn("c_custkey", F.col("c_custkey") + 50000000).withColumn("c_name", F.lit("copy")))
    return _rows(t, Customer)


@query("SELECT * FROM nation UNION ALL SELECT 77, 'NEW', 2")
def insert_ignore(s):
    t = _nations(s)
    Repo(t, Nation).insert_on_conflict([Nation(n_nationkey=5, n_name="IGNORED", n_regionkey=0), Nation(n_nationkey=77, n_name="NEW", n_regionkey=2)], ["n_nationkey"], ignore=True)
    return _rows(t, Nation)


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 5 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 77, 'NEW', 2")
def upsert_conflict(s):
    t = _nations(s)
    new = [Nation(n_nationkey=5, n_name="KEPT", n_regionkey=10), Nation(n_nationkey=77, n_name="NEW", n_regionkey=2)]
    Repo(t, Nation).insert_on_conflict(new, ["n_nationkey"], {"n_regionkey": F.col("old.n_regionkey") + F.col("new.n_regionkey")})
    return _rows(t, Nation)


@query("SELECT * FROM nation UNION ALL SELECT 70, 'X', 0 UNION ALL SELECT 71, 'Y', 0")
def insert_all_ignoring(s):
    t = _nations(s)
    new = [Nation(n_nationkey=k, n_name=n, n_regionkey=0) for k, n in ((1, "A"), (70, "X"), (71, "Y"), (2, "B"))]
    Repo(t, Nation).insert_on_conflict(new, ["n_nationkey"], ignore=True)
    return _rows(t, Nation)


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 2) THEN 'ALL' || n_nationkey WHEN n_nationkey = 3 THEN 'PART' WHEN n_nationkey = 4 THEN 'SAVED' ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_records(s):
    t = _nations(s)
    repo = Repo(t, Nation)
    repo.update_all([r.copy(n_name=f"ALL{r.n_nationkey}") for r in repo.find_all_by_id([1, 2])])
    three, four = repo.find(3), repo.find(4)
    repo.update_partial(three, three.copy(n_name="PART"))
    four.n_name = "SAVED"
    repo.save(four)
    return _rows(t, Nation)


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'one' WHEN n_nationkey = 2 THEN 'two' ELSE n_name END AS n_name, CASE WHEN n_nationkey IN (1, 2) THEN n_regionkey + n_nationkey ELSE n_regionkey END AS n_regionkey FROM nation")
def batch_update(s):
    t = _nations(s)
    sets = [{"n_nationkey": 1, "n_name": "one", "n_regionkey": 1}, {"n_nationkey": 2, "n_name": "two", "n_regionkey": 2}, {"n_nationkey": 999, "n_name": "none", "n_regionkey": 0}]
    Query(t, Nation).batch_update(sets, ["n_nationkey"], {"n_name": "new.n_name", "n_regionkey": "old.n_regionkey + new.n_regionkey"})
    return _rows(t, Nation)


@query("SELECT n_nationkey, n_name || '!' AS n_name FROM nation WHERE n_regionkey = 2")
def update_returning(s):
    t = _nations(s)
    got = t.execute("UPDATE nation SET n_name = concat(n_name, :mark) WHERE n_regionkey = :r RETURNING n_nationkey, n_name", mark="!", r=2)
    return s.spark.createDataFrame(got.rows, "n_nationkey int, n_name string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT n_nationkey + 100, upper(n_name), n_regionkey FROM nation WHERE n_regionkey IN (0, 1)")
def raw_statements(s):
    t = _nations(s)
    t.views("nation")
    t.execute("INSERT INTO nation SELECT n_nationkey + 100, upper(n_name), n_regionkey FROM nation WHERE n_regionkey IN (:a, :b)", a=0, b=1)
    t.execute("DELETE FROM nation AS n WHERE n.n_regionkey = :gone", gone=3)
    return _rows(t, Nation)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + 1, 'MADE', 1")
def first_or_create(s):
    t = _nations(s)
    repo = Repo(t, Nation)
    for name in ("MADE", "MADE"):
        repo.first_or_create(lambda c, name=name: c.n_name == name, NewNation(n_name=name, n_regionkey=1))
    return _rows(t, Nation)


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 6 THEN 44 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + 1, 'MADE', 2")
def update_or_create(s):
    t = _nations(s)
    repo = Repo(t, Nation)
    repo.update_or_create(lambda c: c.n_nationkey == 6, NewNation(n_name=repo.find(6).n_name, n_regionkey=44))
    repo.update_or_create(lambda c: c.n_name == "MADE", NewNation(n_name="MADE", n_regionkey=2))
    return _rows(t, Nation)


def _timed(s):
    old = s.frame("nation").select("n_nationkey", "n_name", *[F.expr("TIMESTAMP_NTZ '2000-01-01'").alias(c) for c in ("made", "changed")])
    return stored_session(s, timed_nation=old)


@query("SELECT n_nationkey, n_nationkey < 5 AS touched FROM nation")
def touch(s):
    t = _timed(s)
    Query(t, TimedNation).where(lambda c: c.n_nationkey < 5).touch()
    return _rows(t, TimedNation).select("n_nationkey", (F.col("changed") > F.expr("TIMESTAMP_NTZ '2020-01-01'")).alias("touched"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'B' ELSE n_name END AS n_name, TIMESTAMP '2000-01-01' AS made, CASE WHEN n_nationkey = 2 THEN TIMESTAMP '2030-01-01' ELSE TIMESTAMP '2000-01-01' END AS changed FROM nation
          UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + 1, 'NEW', TIMESTAMP '2030-01-01', TIMESTAMP '2030-01-01'""")
def timestamps(s):
    t = _timed(s)
    repo = Repo(t, TimedNation, [Timestamps(TimedNation, lambda: F.expr("TIMESTAMP_NTZ '2030-01-01'"))])
    repo.create(NewTimedNation(n_name="NEW"))
    repo.update(repo.find(2).copy(n_name="B"))
    return _rows(t, TimedNation)


def _trashable(s):
    t = stored_session(s, trashable_orders=s.table(TrashableOrder.meta))
    return t, Repo(t, TrashableOrder, [SoftDeletes(TrashableOrder, lambda: F.expr("TIMESTAMP_NTZ '2030-01-01'"))])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_custkey < 20 THEN TIMESTAMP '2030-01-01' END AS deleted_at FROM orders")
def soft_delete(s):
    t, repo = _trashable(s)
    repo.delete_all_by_id([r["o_orderkey"] for r in repo.query().where(lambda c: c.o_custkey < 20).df().select("o_orderkey").collect()])
    return _rows(t, TrashableOrder)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F')")
def restore(s):
    _, repo = _trashable(s)
    repo.restore(repo.only_trashed().order_by(lambda c: c.o_orderkey).first())
    return repo.query().select(lambda c: {"o_orderkey": c.o_orderkey}).df()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F')")
def force_delete(s):
    _, repo = _trashable(s)
    repo.force_delete(repo.only_trashed().order_by(lambda c: c.o_orderkey).first())
    return repo.with_trashed().select(lambda c: {"o_orderkey": c.o_orderkey}).df()


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE NOT (l_partkey = 1 AND l_suppkey IN (1, 2, 3, 4, 5))")
def pivot_detach(s):
    t = stored_session(s, "lineitem")
    PivotRepo(t, PART_SUPPLIERS).detach(1, [1, 2, 3, 4, 5])
    return t.frame("lineitem").select("l_partkey", "l_suppkey")


@query("""WITH have AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey = 1), want AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10])::BIGINT AS l_suppkey)
          SELECT l_partkey, l_suppkey FROM lineitem WHERE l_partkey <> 1 OR l_suppkey IN (SELECT l_suppkey FROM want)
          UNION ALL SELECT 1::BIGINT, l_suppkey FROM want WHERE l_suppkey NOT IN (SELECT l_suppkey FROM have)""")
def pivot_sync(s):
    t = stored_session(s, "lineitem")
    PivotRepo(t, PART_SUPPLIERS).sync(1, range(1, 11))
    return t.frame("lineitem").select("l_partkey", "l_suppkey")


@query("""WITH have AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey = 1), want AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10])::BIGINT AS l_suppkey)
          SELECT coalesce(have.l_suppkey, want.l_suppkey) AS l_suppkey, CASE WHEN have.l_suppkey IS NULL THEN 'attached' WHEN want.l_suppkey IS NULL THEN 'detached' ELSE 'unchanged' END AS state
          FROM have FULL JOIN want ON have.l_suppkey = want.l_suppkey""")
def pivot_sync_diff(s):
    found = PivotRepo(stored_session(s, "lineitem"), PART_SUPPLIERS).sync(1, range(1, 11))
    return s.spark.createDataFrame([(k, state) for state in ("attached", "detached", "unchanged") for k in getattr(found, state)], "l_suppkey bigint, state string")


@query("""SELECT DISTINCT l_partkey, l_suppkey, CASE WHEN l_partkey = 2 THEN 'late' END AS note FROM lineitem WHERE l_partkey < 50
          UNION ALL SELECT 1::BIGINT, 9000001::BIGINT, 'made' UNION ALL SELECT 1::BIGINT, 9000002::BIGINT, 'made'""")
def pivot_attach_with_creator(s):
    t = stored_session(s, part_link=s.frame("lineitem").where("l_partkey < 50").select("l_partkey", "l_suppkey").distinct().withColumn("note", F.lit(None).cast("string")))
    links = PivotRepo(t, PART_LINKS)
    links.attach(1, [9000001, 9000002], NewPartLink(note="made"))
    for r in t.frame("part_link").where("l_partkey = 2").select("l_suppkey").collect():
        links.update_pivot(2, r["l_suppkey"], NewPartLink(note="late"))
    return _rows(t, PartLink)


# transactions, migrations, hooks, tracking


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'kept' ELSE n_name END AS n_name, n_regionkey FROM nation")
def transactions(s):
    t = _nations(s)
    with t.transact():
        Query(t, Nation).where(lambda c: c.n_nationkey == 1).update(n_name="kept")
    try:
        with t.transact():
            Query(t, Nation).delete()
            raise NotFound("the block fails")
    except NotFound:
        pass  # nothing of the second block is published
    return _rows(t, Nation)


def _migrations():
    return [
        M.Migration("1", "nations", [M.create_table("place", M.column("id", "int").primary_key(), M.column("name", "string"), M.column("region", "int"), M.column("far", "boolean").nullable().generated_always_as("region > 2"))]),
        M.Migration("2", "more", [
            M.raw("INSERT INTO place (id, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation"),
            M.alter_table("place", M.rename_column("name", "title"), M.add_column(M.column("note", "string").default("none")), M.alter_column_type("id", "bigint")),
        ], [M.alter_table("place", M.drop_column("note"), M.rename_column("title", "name"))]),
    ]


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title, n_regionkey AS region, n_regionkey > 2 AS far, 'none' AS note FROM nation")
def migrations(s):
    t = _nations(s)
    t.views("nation")
    M.Migrator(t, _migrations()).migrate()
    return t.store.read("place")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_regionkey AS region, n_regionkey > 2 AS far FROM nation")
def migration_rollback(s):
    t = _nations(s)
    t.views("nation")
    runner = M.Migrator(t, _migrations())
    runner.migrate(in_one=False)
    runner.rollback_steps(1)
    return t.store.read("place")


@query("SELECT * FROM (VALUES (0, 'creating', 'NEW'), (1, 'created', 'NEW'), (2, 'updating', 'CHANGED'), (3, 'updated', 'CHANGED'), (4, 'deleting', 'CHANGED'), (5, 'deleted', 'CHANGED')) v(step, event, name)")
def observers(s):
    seen = []

    class Note(Observer):
        def __getattribute__(self, name):
            return (lambda record: seen.append((len(seen), name, record.n_name))) if not name.startswith("_") else object.__getattribute__(self, name)

    t = _nations(s)
    repo = Repo(t, Nation, observers=[Note()])
    made = repo.create(NewNation(n_name="NEW", n_regionkey=0))
    made = made.copy(n_name="CHANGED")
    repo.update(made)
    repo.delete(made)
    return s.spark.createDataFrame(seen, "step int, event string, name string")


@query("SELECT 'n_name' AS changed, n_name AS before, 'other' AS after, n_name AS refreshed FROM nation WHERE n_nationkey = 3")
def change_tracking(s):
    t = _nations(s)
    repo = Repo(t, Nation)
    record = repo.find_or_fail(3)
    record.n_name = "other"
    changes = repo.changes(record)
    return s.spark.createDataFrame([(k, repo.original(record).n_name, v, repo.refresh(record).n_name) for k, v in changes.items()], "changed string, before string, after string, refreshed string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 3")
def iterate_rows(s):
    return _frame(s, Nation, list(Query(s, Nation).where(lambda c: c.n_regionkey < 3).iterate()))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2 AND n_name <> 'NATION_9'")
def scopes_stacked(s):
    class Base(Repo):
        injected = (Where("region", lambda c: c.n_regionkey == 1),)
        final = (lambda meta: Where(f"named in {meta.table}", lambda c: c.n_name != "NATION_9"),)

    return Base(s, Nation, [Where("late", lambda c: c.n_nationkey > 2)]).query().df()


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey <= 20 GROUP BY l_partkey, l_suppkey")
def belongs_to_many_by_convention(s):
    links = s.frame("lineitem").where("l_partkey <= 20").select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"))
    t = Session(s.spark, {"part": s.frame("part"), "supplier": s.frame("supplier"), "part_supplier": links})
    found = Query(t, Part).with_related(belongs_to_many(Part, Supplier)).df().select(F.col("p_partkey").alias("l_partkey"), F.explode("related_0").alias("i"))
    return found.groupBy("l_partkey", F.col("i.s_suppkey").alias("l_suppkey")).count().withColumnRenamed("count", "n")


# raw SQL, verification


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000.5 AND o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
def raw_sql_params(s):
    s.views("orders")
    test = sql("o_totalprice > :least AND array_contains(:priorities, o_orderpriority)", least=300000.5, priorities=["1-URGENT", "3-MEDIUM"])
    return s.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :status AND :test", status="O", test=test)


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 WHERE c.c_acctbal > 9000")
def raw_sql_join(s):
    s.views("customer", "orders")
    c, o = TableInfo(Customer.meta).alias("c"), TableInfo(Order.meta).alias("o")
    return s.sql(
        "SELECT :ck, :ok FROM :c LEFT JOIN :o ON :fk = :ck AND :price > :least WHERE :bal > :rich",
        ck=c.c_custkey, ok=o.o_orderkey, c=c.table, o=o.table, fk=o.o_custkey, price=o.o_totalprice, bal=c.c_acctbal, least=300000, rich=9000,
    )


@query("SELECT 'extra_column' AS kind, 'documents' AS table_name, 'text' AS column_name, '' AS detail, true AS warning")
def verify_schema(s):
    return issues_df(s, Region, Nation, Customer, Supplier, Part, Order, LineItem, Document)
