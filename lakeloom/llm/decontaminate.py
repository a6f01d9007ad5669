"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

A document is compared with each benchmark item in windows as long as the item, over five-word
shingles. A window at a similarity of 0.8 or more has at least 80 % of its shingles among those of
the item, and moving it right to its first such shingle (its anchor), at most to the end of the
document, loses none of them; so only windows that start at a known shingle, or end with the document,
and hold enough known ones are fingerprinted, and no window that could qualify is lost. A document that
is shorter than the item is one window itself.

Window and item fingerprints (64-bit SimHash over shingle counts) meet in a multi-index: eight blocks
of eight bits, in which both sides are listed under every value within one bit, so that all pairs
within ``RADIUS`` = 23 bits share a block (24 differences are the least that can put three into each
block). At a similarity of 0.8 a pair differs in 9.7 bits on average, and about one in 100,000 in more
than 23. A key of the index holds the anchor as well: an item that has not the window's anchor is met
from another anchor if it is met at all, so windows meet only items that share text with them, however
many items there are. Pairs within the radius are then verified by the exact weighted similarity:
common shingles over all shingles, each weighted by its count.

Defined results. Items and texts with under five words have no shingles and match nothing. Null
texts are empty. Repeated rows are found alike; items that repeat an item_id are each compared, and one
with a null item_id contaminates without being listed. An empty benchmark clears every document. Columns
besides doc_id, item_id and text are carried along or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, shingle_hashes, stored, words_of

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, WIDTH = 8, 8
#: Bits by which a window and an item may miss each other in a block.
NEAR = 2
RADIUS = (NEAR + 1) * BLOCKS - 1
#: Item shingles and the items' index are broadcast up to this number of rows (16 and 40 bytes each),
#: beyond it joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _shingles(text: Column) -> Column:
    return shingle_hashes(words_of(ascii_lower(F.coalesce(text, F.lit("")))), SHINGLE)


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes, repeats included: a bit is set if over half have it."""
    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
        return F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda x, b: x.bitwiseOR(bit(b)))


def numbered(hashes: Column) -> Column:
    """An array of hashes in which repeats differ: each hash goes together with its rank among equals,
    so that the common part of two arrays is that of their sets."""
    def ranks(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i) != F.get(s, i - 1), F.lit(True)))

        def spread(at: Column) -> Column:
            return F.flatten(
                F.transform(at, lambda p, j: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(at, j + 1), F.size(s)) - p - 1), lambda k: F.xxhash64(F.get(s, p), k)))
            )

        return let(firsts, spread)

    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(let(F.array_sort(hashes), ranks))


def similarity(a: Column, b: Column) -> Column:
    """Exact weighted similarity of two numbered arrays: sum of least over sum of greatest counts."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, size, shingles, numbered, fp) of the items that have shingles; ``item`` is a hash of
    what they say."""
    found = benchmark.select("item_id", _shingles(F.col("text")).alias("shingles")).where(F.size("shingles") > 0)
    s = F.col("shingles")
    return found.select("item_id", F.xxhash64(s).alias("item"), F.size(s).alias("size"), s, numbered(s).alias("numbered"), simhash(s).alias("fp"))


def _needed(size: Column) -> Column:
    return F.ceil(size * SIMILARITY - 1e-9).cast("int")


def candidate_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, version, size, start, anchor, shingles): the windows that could qualify, with the shingle
    at which the search for them began."""
    known = stored(items.select(F.explode("shingles").alias("h"), "size").distinct())
    by_hash = known.groupBy("h").agg(F.collect_set("size").alias("sizes"))
    by_hash = F.broadcast(by_hash) if known.count() <= BROADCAST_ROWS else by_hash
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select("doc_id", F.xxhash64(text).alias("version"), F.posexplode(_shingles(text)).alias("pos", "h"))
    hits = placed.join(by_hash, "h").select("doc_id", "version", F.explode("sizes").alias("size"), "pos")
    places = hits.groupBy("doc_id", "version", "size").agg(F.array_sort(F.collect_set("pos")).alias("places"))

    def starts(at: Column) -> Column:
        return F.filter(at, lambda p, j: F.coalesce(F.get(at, j + _needed(F.col("size")) - 1) - p < F.col("size"), F.lit(False)))

    begun = places.select("doc_id", "version", "size", let(F.col("places"), starts).alias("starts")).where(F.size("starts") > 0)
    begun = begun.groupBy("doc_id", "version").agg(F.collect_list(F.struct("size", "starts")).alias("runs"))
    begun = stored(begun.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), "runs"))
    chosen = docs.select("doc_id", "text", F.xxhash64(text).alias("version"))
    chosen = chosen.join(begun, chosen["doc_id"].eqNullSafe(F.col("_doc")) & (chosen["version"] == F.col("_version")))

    # windows are cut one after another, from shingles that are made once a text
    places_of = F.flatten(F.transform("runs", lambda r: F.transform(r["starts"], lambda p: F.struct(r["size"].alias("size"), p.alias("place")))))
    cut = chosen.select("doc_id", "version", _shingles(F.col("text")).alias("all"), places_of.alias("w")).select("doc_id", "version", "all", F.explode("w").alias("w"))
    # a window too near the end moves left to the last full one (or to 0)
    start = F.greatest(F.least(F.col("w.place"), F.size("all") - F.col("w.size")), F.lit(0))
    cut = cut.select("doc_id", "version", "w.size", start.alias("start"), F.get("all", F.col("w.place")).alias("anchor"), "all")
    return cut.select("doc_id", "version", "size", "start", "anchor", F.slice("all", F.col("start") + 1, F.col("size")).alias("shingles"))


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, k * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def multi_index(rows: DataFrame) -> DataFrame:
    """``rows`` with (size, fp, anchors) listed under each key of the index: an anchor, a block and each
    of its values within a bit. Rows within ``RADIUS`` bits that share an anchor share a key."""
    near = [0, *[1 << b for b in range(WIDTH)]]
    entries = F.array(*[F.struct(F.lit(k).alias("block"), _block(F.col("fp"), k).bitwiseXOR(F.lit(m)).alias("value")) for k in range(BLOCKS) for m in near])
    listed = rows.select("*", F.explode("anchors").alias("_anchor")).drop("anchors").select("*", F.explode(entries).alias("_entry"))
    key = F.xxhash64("size", "_anchor", "_entry.block", "_entry.value")
    return listed.withColumn("key", key).drop("_anchor", "_entry")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, version, item_id, similarity): the best verified window of each pair."""
    named = stored(item_table(benchmark))
    items = stored(named.drop("item_id").dropDuplicates(["item"]))  # items that say the same are one
    # equal windows of different documents are fingerprinted and compared once
    windows = stored(candidate_windows(docs, items).withColumn("content", F.xxhash64("shingles")))
    distinct = windows.groupBy("size", "content").agg(F.first("shingles").alias("shingles"), F.collect_set("anchor").alias("anchors"))
    distinct = stored(distinct.select("size", "content", "anchors", numbered(F.col("shingles")).alias("numbered"), simhash(F.col("shingles")).alias("fp")))
    listed = multi_index(items.select("item", "size", "fp", F.array_distinct("shingles").alias("anchors")))
    listed = listed.select("key", "item", F.col("size").alias("item_size"), F.col("fp").alias("item_fp"))
    # explode multiplies rows behind the planner's back, so the way of joining is chosen from the count
    rows = (items.agg(F.sum(F.size(F.array_distinct("shingles")))).first()[0] or 0) * BLOCKS * (1 + WIDTH)
    near = multi_index(distinct.select("size", "content", "fp", "anchors"))
    near = near.join(F.broadcast(listed), "key") if rows <= BROADCAST_ROWS else near.hint("merge").join(listed, "key")
    near = near.where((F.col("size") == F.col("item_size")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS))
    pairs = near.select("size", "content", "item").distinct()
    scored = pairs.join(distinct, ["size", "content"]).join(items.select("item", F.col("numbered").alias("item_numbered")), "item")
    scored = scored.withColumn("similarity", similarity(F.col("numbered"), F.col("item_numbered"))).where(F.col("similarity") >= SIMILARITY)
    found = windows.select("doc_id", "version", "size", "content").distinct().join(scored.select("size", "content", "item", "similarity"), ["size", "content"])
    found = found.join(named.select("item", "item_id"), "item")
    return found.groupBy("doc_id", "version", "item_id").agg(F.max("similarity").alias("similarity"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: the items found in it and the best similarity (0 if none)."""
    found = matches(docs, benchmark).groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity")
    )
    found = found.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), "items", "similarity")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("version"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(F.col("_doc")) & (rows["version"] == F.col("_version")), "left")
    return joined.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("item_ids"),
        F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no item was found, with their own columns."""
    gone = matches(docs, benchmark).select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version")).distinct()
    version = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_doc"]) & (version == gone["_version"]), "left_anti")
