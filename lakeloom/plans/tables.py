"""Entities and relationships of the test tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Entity, created_at, deleted_at, field, updated_at
from ..relations import belongs_to, belongs_to_many, has_many, has_many_through, has_one, has_one_through
from ..scopes import SoftDeletes, Where
from ..sources.session import Session
from ..sources.store import Store


class Region(Entity, table="region"):
    r_regionkey = field("int", pk=True)
    r_name = field("string")


class Nation(Entity, table="nation"):
    n_nationkey = field("int", pk=True)
    n_name = field("string")
    n_regionkey = field("int")


class NewNation(Entity, creates=Nation):
    n_name = field("string")
    n_regionkey = field("int")


class TimedNation(Entity, table="timed_nation"):
    n_nationkey = field("int", pk=True)
    n_name = field("string")
    made = created_at("local_timestamp", nullable=True)
    changed = updated_at("local_timestamp", nullable=True)


class NewTimedNation(Entity, creates=TimedNation):
    n_name = field("string")


class OrderStatus(Entity, table="order_status"):
    o_orderkey = field("bigint", pk=True)
    status = field("string", nullable=True)


class PartLink(Entity, table="part_link"):
    l_partkey = field("bigint", pk=True)
    l_suppkey = field("bigint", pk=True)
    note = field("string", nullable=True)


class NewPartLink(Entity, creates=PartLink):
    note = field("string", nullable=True)


class Customer(Entity, table="customer"):
    c_custkey = field("bigint", pk=True)
    c_name = field("string")
    c_nationkey = field("int")
    c_acctbal = field("double")
    c_mktsegment = field("string")


class Supplier(Entity, table="supplier"):
    s_suppkey = field("bigint", pk=True)
    s_name = field("string")
    s_nationkey = field("int")
    s_acctbal = field("double")


class Part(Entity, table="part"):
    p_partkey = field("bigint", pk=True)
    p_name = field("string")
    p_brand = field("string")
    p_type = field("string")
    p_size = field("int")
    p_retailprice = field("double")


class Order(Entity, table="orders"):
    o_orderkey = field("bigint", pk=True)
    o_custkey = field("bigint")
    o_orderstatus = field("string")
    o_totalprice = field("double")
    o_orderdate = field("local_timestamp")
    o_orderpriority = field("string")


class TrashableOrder(Entity, table="trashable_orders"):
    o_orderkey = field("bigint", pk=True)
    o_custkey = field("bigint")
    o_orderstatus = field("string")
    o_totalprice = field("double")
    deleted_at = deleted_at("local_timestamp")


class LineItem(Entity, table="lineitem"):
    l_orderkey = field("bigint", pk=True)
    l_linenumber = field("int", pk=True)
    l_partkey = field("bigint")
    l_suppkey = field("bigint")
    l_quantity = field("double")
    l_extendedprice = field("double")
    l_discount = field("double")
    l_tax = field("double")
    l_returnflag = field("string")
    l_linestatus = field("string")
    l_shipdate = field("local_timestamp")


class Event(Entity, table="events"):
    event_id = field("bigint", pk=True)
    ts = field("local_timestamp")
    user_id = field("bigint")
    event_type = field("string")
    value = field("double")
    props = field("json")


class Document(Entity, table="documents"):
    doc_id = field("bigint", pk=True)
    lang = field("string")
    source = field("string")
    n_chars = field("bigint")


class Vector(Entity, table="embeddings"):
    vec_id = field("bigint", pk=True)
    embedding = field("array<float>")
    label = field("int")


class Label(Entity, table="labels"):
    doc_id = field("bigint", pk=True)
    quality = field("int")
    toxic = field("int")


NATIONS = has_many(Region, Nation, "n_regionkey")
REGION = belongs_to(Nation, Region, "n_regionkey")
CUSTOMERS = has_many(Nation, Customer, "c_nationkey")
SUPPLIERS = has_many(Nation, Supplier, "s_nationkey")
NATION = belongs_to(Customer, Nation, "c_nationkey")
SUPPLIER_NATION = belongs_to(Supplier, Nation, "s_nationkey")
ORDERS = has_many(Customer, Order, "o_custkey")
CUSTOMER = belongs_to(Order, Customer, "o_custkey")
ITEMS = has_many(Order, LineItem, "l_orderkey")
ITEM_ORDER = belongs_to(LineItem, Order, "l_orderkey")
ITEM_PART = belongs_to(LineItem, Part, "l_partkey")
ITEM_SUPPLIER = belongs_to(LineItem, Supplier, "l_suppkey")
PART_SUPPLIERS = belongs_to_many(Part, Supplier, "lineitem", "l_partkey", "l_suppkey")
ORDER_PARTS = belongs_to_many(Order, Part, "lineitem", "l_orderkey", "l_partkey")
REGION_CUSTOMERS = has_many_through(Region, Nation, Customer, "n_regionkey", "c_nationkey")
REGION_SUPPLIERS_VIA = NATIONS.via(SUPPLIERS)
EVENTS = has_many(Customer, Event, "user_id")
LABEL = has_one(Document, Label, "doc_id")
TRASHABLE = has_many(Customer, TrashableOrder, "o_custkey")
LINKS = PART_SUPPLIERS.with_pivot(LineItem)


REGION_SUPPLIER = has_one_through(Region, Nation, Supplier, "n_regionkey", "s_nationkey")
REGION_CUSTOMERS_VIA = NATIONS.via(CUSTOMERS)
PART_LINKS = belongs_to_many(Part, Supplier, "part_link", "l_partkey", "l_suppkey").with_pivot(PartLink, NewPartLink)


def session_over(spark: SparkSession, sf_dir: str) -> Session:
    """The test tables; ``trashable_orders`` are orders whose finished ones count as deleted."""
    def frame(name: str):
        if name == "trashable_orders":
            orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
            return orders.withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    found = Session(spark, frame)
    found.register(TrashableOrder, SoftDeletes(TrashableOrder))
    found.register(Supplier, Where("solvent", lambda c: c.s_acctbal > 0))
    found.folder = sf_dir
    return found


def stored_session(over: Session, *names: str, **frames: DataFrame) -> Session:
    """A session whose tables can be changed: ``names`` are the test tables, taken over without a copy
    (changes rewrite the files that they touch, the test data stay), ``frames`` are written."""
    spark = over.spark
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="lakeloom-")
    store = Store(spark, f"{shared.rstrip('/')}/lakeloom-store-{uuid.uuid4().hex}")
    atexit.register(_destroy, store)
    with store.transaction():
        for name in names:
            store.adopt(name, f"{over.folder}/{name}.parquet")
        for name, rows in frames.items():
            store.write(name, rows)
    found = Session(spark, store=store)
    found.scopes = dict(over.scopes)
    return found


def _destroy(store: Store) -> None:
    try:
        store.destroy()
    except Exception:  # the session has ended already: the folder goes with the shared one
        return
