"""SimHash near-duplicates by pigeonring filtering, and their connected components.

Fingerprints (64 bits over three-word shingles) are computed in Arrow batches by numpy. Two of
them link at a Hamming distance of at most 2.

Candidates. The 64 bits form a ring of five segments. Two differing bits leave three clean segments
on the ring, so a chain of two consecutive clean segments exists: its first prefix (budget 2/5) and
its second (4/5) both allow zero differences. The chain is the join key. From there the chain must
go on within its proportional budgets (at most 1 difference over three and over four segments), and
only what survives gets the full distance check. Copies are collapsed to one fingerprint first.

Buckets. A chain key that more than ``PAIRS_UP_TO`` distinct fingerprints share is not paired.
There each fingerprint meets the points within one bit of it (in the other three segments):
fingerprints within two bits share such a point, all that share a point are within two bits, and at
most 65 can share it. This exact route makes rows in proportion to the bucket, never its square.

Components come from alternating large-star and small-star steps over checkpointed edges; only two
numbers a step reach the driver.

Defined results. Null, empty and blank texts have fingerprint zero and link like any other. Rows
that repeat a doc_id each keep their own row. A component of null doc_ids only has a null id. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import masked, shipped, stored, unmasked

RADIUS = 2
SHINGLE_WORDS = 3
#: (first bit, width) of the segments on the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS_UP_TO = 48
_BLOCK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """SimHash of a text as a signed 64-bit number. Bytes are enough: A-Z, white space and UTF-8
    do not overlap, and ``bytes.split`` splits at the same six characters."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), max(1, len(words) - size + 1)
    for at in range(0, total, _BLOCK):
        part = words[at : at + _BLOCK + size - 1]
        shingles = map(b" ".join, zip(*[part[k:] for k in range(size)], strict=False)) if len(words) >= size else [b" ".join(words)]
        hashes = np.array([digest(s, 42) for s in shingles], dtype="<u8")
        # bit counts by byte columns keep the sums in small integers until the end
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    value = int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])
    return value - (1 << 64) if value >> 63 else value


def _version(text: Column) -> Column:
    """Tells rows that repeat a doc_id with another text apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fp) of each row."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "version": frame["version"], "fp": [fingerprint(t) for t in frame["text"]]})

    rows = masked(shipped(docs).select("doc_id", _version(F.col("text")).alias("version"), "text"), "doc_id")
    found = rows.mapInPandas(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, version bigint, fp bigint")
    return unmasked(found, "doc_id", docs.schema["doc_id"].dataType)


def _segment(fp: Column, k: int) -> Column:
    start, width = SEGMENTS[k % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def chains(fps: DataFrame) -> DataFrame:
    """(ring, key, fp): the two segments from each place of the ring."""
    n = len(SEGMENTS)
    keys = [F.struct(F.lit(k).alias("ring"), F.shiftleft(_segment(F.col("fp"), k), 13).bitwiseOR(_segment(F.col("fp"), k + 1)).alias("key")) for k in range(n)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("c")).select("c.ring", "c.key", "fp")


def _within_budgets(a: Column, b: Column, ring: Column) -> Column:
    """The chain from ``ring`` stays within floor(length * radius / segments) differences."""
    n, holds = len(SEGMENTS), F.lit(False)
    for k in range(n):
        spent, fits = F.lit(0), F.lit(True)
        for length in range(1, n + 1):
            spent = spent + F.bit_count(_segment(a.bitwiseXOR(b), k + length - 1))
            if length > 2:
                fits = fits & (spent <= length * RADIUS // n)
        holds = holds | ((ring == k) & fits)
    return holds


def near_edges(fps: DataFrame) -> DataFrame:
    """(u, v), u < v, over distinct fingerprints: edges that connect the same fingerprints as all
    pairs within the radius do. Small buckets give their pairs, large ones stars."""
    keyed = chains(fps)
    sizes = keyed.groupBy("ring", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = keyed.join(sizes, ["ring", "key"])
    small, large = sized.where(F.col("n") <= PAIRS_UP_TO).drop("n"), sized.where(F.col("n") > PAIRS_UP_TO)
    a, b = small.withColumnRenamed("fp", "u"), small.withColumnRenamed("fp", "v")
    pairs = a.join(b, ["ring", "key"]).where(F.col("u") < F.col("v"))
    pairs = pairs.where((F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS) & _within_budgets(F.col("u"), F.col("v"), F.col("ring")))
    # bits outside the two segments of the chain
    own = [sum(((1 << w) - 1) << s for s, w in (SEGMENTS[k], SEGMENTS[(k + 1) % len(SEGMENTS)])) for k in range(len(SEGMENTS))]
    others = F.create_map(*[x for k, mask in enumerate(own) for x in (F.lit(k), F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64) if not mask >> b & 1]))])
    points = large.select("ring", "fp", F.explode(F.transform(others[F.col("ring")], lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    stars = points.groupBy("ring", "point").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    spokes = stars.select(F.array_min("near").alias("u"), F.explode("near").alias("v")).where(F.col("u") < F.col("v"))
    return pairs.select("u", "v").unionByName(spokes).distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable; only nodes with an edge are listed."""
    edges = stored(edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").distinct()
        down = large.select(F.col("v").alias("big"), F.col("u").alias("low"))
        least = down.groupBy("big").agg(F.min("low").alias("m"))
        joined = down.join(least, "big")
        small = joined.select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(joined.select(F.col("m").alias("u"), F.col("big").alias("v")))
        edges = stored(small.where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fp, component_id) of each row: component_id is the smallest doc_id reachable."""
    rows = stored(fingerprints(docs))
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(near_edges(classes.select("fp")))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = stored(rooted.join(least, "root").select("fp", "component_id"))
    return rows.join(ids, "fp").select("doc_id", "version", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without the members of a component other than its smallest doc_id. Rows with one doc_id
    and text are one document: they stay or go together; another text under that doc_id is judged on
    its own. Rows without a doc_id have no place in an order: they stay."""
    found = near_duplicates(docs).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone"), F.col("version").alias("_version")).distinct()
    return docs.join(found, (docs["doc_id"] == found["_gone"]) & (_version(docs["text"]) == found["_version"]), "left_anti")
