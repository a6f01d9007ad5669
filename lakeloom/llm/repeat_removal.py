"""Removal of repeated byte strings by a sparse, range-partitioned suffix order.

Every string of ``LENGTH`` bytes holds one anchor: the start of the least ``GRAM``-byte hash in it
(the leftmost of equals). Equal strings have equal anchors at equal offsets, so only the suffixes at
anchors, about one byte in 77, need to be ordered. The strings that share one anchor form a run,
and the bytes of a run a segment.

1. Anchors whose gram occurs once in the corpus are dropped. Equal segments are counted: all strings
   of a segment that occurs twice repeat, without further comparison. So groups of copies, of any
   size, shrink to one representative each.
2. Where one gram has several distinct segments, a representative of each is cut out of its text.
   The suffixes that start at their anchors are range-partitioned by leading tokens, with splitters
   that Spark samples; the bucket count follows the bytes. Each bucket sorts its suffixes by
   multikey quicksort (8-byte tokens, equal parts go on to the next token). A repeated string holds the
   gram at the same place, so among the suffixes that start equally far before one gram the sort goes
   on token by token, and neighbours that agree over ``LENGTH`` bytes are repeats: bytes are compared,
   not hashes.
3. A run of suffixes with one gram stays in one bucket, unless it has more than ``HOT_KINDS`` distinct
   segments: then what follows the gram splits it over several buckets, and the strings of its parts
   are compared across the boundaries in one more exchange, by 128-bit fingerprint.

Nothing is capped; a hot key costs a row a task or is split by what follows it.

Defined results. Null or empty text: no bytes, nothing removed. Texts under ``LENGTH`` bytes hold no
such string. Rows that repeat a doc_id and text repeat each other. Columns besides doc_id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, masked, shipped, stored, unmasked

LENGTH = 200
GRAM = 48
#: Bytes hashed at a time, and bytes of segments to a bucket.
BLOCK = 1 << 17
BUCKET_BYTES = 6 << 20
#: A gram with more distinct segments than this is dealt to several buckets.
HOT_KINDS = 20_000
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base & _MASK, np.uint64)]), dtype=np.uint64)


class Rolling:
    """Polynomial hashes of all strings of one length, mod 2^64, over mixed byte codes."""

    def __init__(self, salt: int, room: int = BLOCK + LENGTH):
        self.codes = _mix(_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(salt)))
        self.base = (_BASE * (2 * salt + 1)) & _MASK | 1
        self.up, self.down = _powers(self.base, room + 1), _powers(pow(self.base, -1, 1 << 64), room + 1)

    def __call__(self, data: np.ndarray, length: int) -> np.ndarray:
        if len(data) >= len(self.up):
            self.__init_room(len(data))
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.codes[data] * self.up[: len(data)], out=sums[1:])
        return _mix((sums[length:] - sums[:-length]) * self.down[: len(data) - length + 1])

    def __init_room(self, n: int) -> None:
        self.up, self.down = _powers(self.base, n + 1), _powers(pow(self.base, -1, 1 << 64), n + 1)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive keys, by block prefixes and suffixes."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.uint64(_MASK))
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: bytes, rolling: Rolling) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(gram hash, anchor - first start, first start, last start) of the runs of strings that share
    an anchor. A block's end may cut a run in two; both parts stay correct."""
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole) - LENGTH + 1, BLOCK):
        part = whole[at : at + BLOCK + LENGTH - 1]
        grams = rolling(part, GRAM)
        least = _sliding_least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(least) - 1]])
        place = (least[first] & _PLACE).astype(np.int64)
        yield grams[place].view(np.int64), place - first, first + at, last + at


def anchors(docs: DataFrame) -> DataFrame:
    """(gram, seg, doc_id, version, off, lo, hi): a row for each run; seg identifies the bytes of the
    run's segment and the anchor's place in it."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        rolling, digest = Rolling(1), xxhash.xxh3_64_intdigest
        for frame in frames:
            parts, size = [], 0
            for doc_id, version, text in zip(frame["doc_id"], frame["version"], frame["text"], strict=True):
                data = (text or "").encode()
                if len(data) < LENGTH:
                    continue
                for gram, off, lo, hi in runs(data, rolling):
                    seg = np.array([digest(data[a : b + LENGTH], o) for a, b, o in zip(lo.tolist(), hi.tolist(), off.tolist(), strict=True)], np.uint64)
                    parts.append((gram, seg.view(np.int64), doc_id, version, off, lo, hi))
                    size += len(gram)
                if size > 200_000:
                    yield _rows(parts)
                    parts, size = [], 0
            if parts:
                yield _rows(parts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _versioned(shipped(docs)).mapInPandas(batches, f"gram bigint, seg bigint, doc_id {kind}, version int, off int, lo int, hi int")


def _versioned(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.hash(text).alias("version"), text.alias("text"))


def _rows(parts: list) -> pd.DataFrame:
    sizes = [len(p[0]) for p in parts]
    cat = lambda k: np.concatenate([p[k] for p in parts])
    ids = pd.Series([p[2] for p in parts]).repeat(sizes).reset_index(drop=True)
    return pd.DataFrame({"gram": cat(0), "seg": cat(1), "doc_id": ids, "version": np.repeat([p[3] for p in parts], sizes), "off": cat(4), "lo": cat(5), "hi": cat(6)})


def cut_segments(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(gram, n, kinds, doc_id, version, off, lo, hi, body, suffix, lead) for each representative in
    ``chosen``; lead holds the leading tokens by which it is dealt."""
    runs_of = chosen.groupBy(F.col("doc_id").alias("_doc"), F.col("version").alias("_version")).agg(
        F.collect_list(F.struct("gram", "n", "kinds", "off", "lo", "hi")).alias("runs")
    )
    texts = _versioned(docs)
    # repeated rows have the same runs: one of them is enough
    joined = texts.join(runs_of, texts["doc_id"].eqNullSafe(F.col("_doc")) & (texts["version"] == F.col("_version")))
    cut = joined.select("doc_id", "version", F.encode("text", "UTF-8").alias("data"), F.explode("runs").alias("r"))
    body = F.expr(f"substring(data, r.lo + 1, r.hi - r.lo + {LENGTH})")
    found = cut.select("doc_id", "version", "r.*", body.alias("body")).dropDuplicates(["doc_id", "version", "lo"])
    found = found.withColumn("suffix", F.expr("substring(body, off + 1)"))
    return found.withColumn("lead", F.when(F.col("kinds") > HOT_KINDS, F.col("suffix")).otherwise(F.expr(f"substring(suffix, 1, {GRAM})")))


def refined(order: np.ndarray, part: np.ndarray, depths: int, token: Callable[[np.ndarray, int], np.ndarray]) -> None:
    """Multikey quicksort in place, all open parts of a level at once: rows are sorted by their next
    token within their part, and only parts of equals go deeper. ``part`` holds for each place of the
    order the first place of its part; in the end rows of one part agree in all tokens."""
    active = _open(part, np.arange(len(order)))
    for depth in range(depths):
        if not len(active):
            return
        rows, own = order[active], part[active]
        key = token(rows, depth)
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sizes = np.diff(np.append(heads, len(active)))
        mixed = np.logical_or.reduceat(key != np.repeat(key[heads], sizes), heads)
        if not mixed.any():
            continue  # equals in every part: nothing moves
        some = np.flatnonzero(np.repeat(mixed, sizes))
        by = np.lexsort((key[some], own[some]))
        places, key, own = active[some], key[some][by], own[some]
        order[places] = rows[some][by]
        starts = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        part[places] = places[np.maximum.accumulate(np.where(starts, np.arange(len(places)), 0))]
        active = _open(part, active)


def _open(part: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places whose part has several rows."""
    own = part[places]
    twin = np.concatenate([own[1:] == own[:-1], [False]]) if len(own) else np.zeros(0, bool)
    return places[twin | np.concatenate([[False], twin[:-1]])] if len(own) else places


def multikey_order(bodies: list[bytes]) -> np.ndarray:
    """Order of byte strings by multikey quicksort over 8-byte tokens, then by length."""
    n = len(bodies)
    sizes = np.array([len(b) for b in bodies], np.uint64)
    begins = np.cumsum(sizes) - sizes
    tokens = tokens_of(np.frombuffer(b"".join(bodies), np.uint8))
    deep = -(-int(sizes.max()) // 8) if n else 0

    def token(rows: np.ndarray, depth: int) -> np.ndarray:
        if depth == deep:
            return sizes[rows]
        left = np.clip(sizes[rows].astype(np.int64) - 8 * depth, 0, 8)
        at = np.minimum(begins[rows].astype(np.int64) + 8 * depth, len(tokens) - 1)
        # what lies behind the end of a string reads as zero bytes
        return tokens[at] & _AHEAD[left]

    order, part = np.arange(n), np.zeros(n, np.int64)
    refined(order, part, deep + 1, token)
    return order


#: Masks that leave the first k bytes of a token.
_AHEAD = np.array([0] + [_MASK ^ ((1 << (64 - 8 * k)) - 1) for k in range(1, 9)], np.uint64)


def tokens_of(data: np.ndarray) -> np.ndarray:
    """The 8-byte token that starts at each byte, as a number that sorts like its bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


class Bucket:
    """One bucket of segments in suffix order, with the strings of all of them."""

    def __init__(self, frame: pd.DataFrame, hot: int):
        order = multikey_order(frame["suffix"].tolist())
        self.frame = frame = frame.iloc[order].reset_index(drop=True)
        grams = frame["gram"].to_numpy()
        self.outer = ((grams == grams[0]) | (grams == grams[-1])) & (frame["kinds"].to_numpy() > hot)
        sizes = np.array([len(b) for b in frame["body"]])
        counts = sizes - LENGTH + 1
        self.owner = np.repeat(np.arange(len(frame)), counts)
        self.shift = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.start = frame["lo"].to_numpy()[self.owner] + self.shift
        self.at = np.repeat(np.cumsum(sizes) - sizes, counts) + self.shift
        self.data = np.frombuffer(b"".join(frame["body"]), np.uint8)

    def repeated(self) -> np.ndarray:
        """Strings that another segment of the bucket holds too: those that agree with a neighbour over
        ``LENGTH`` bytes in the order of the suffixes that start as far before the same gram."""
        kinds = np.unique(self.frame["gram"].to_numpy(), return_inverse=True)[1]
        ahead = self.frame["off"].to_numpy()[self.owner] - self.shift
        lead = kinds[self.owner] * LENGTH + ahead
        order = np.argsort(lead, kind="stable")
        lead = lead[order]
        starts = np.concatenate([[True], lead[1:] != lead[:-1]])
        part = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
        tokens = tokens_of(self.data)
        refined(order, part, LENGTH // 8, lambda rows, depth: tokens[self.at[rows] + 8 * depth])
        flags = np.zeros(len(order), bool)
        flags[order[_open(part, np.arange(len(order)))]] = True
        return flags

    def fingerprints(self, some: np.ndarray, one: Rolling, two: Rolling) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each of some strings, for the comparison with other buckets."""
        used = np.unique(self.owner[some])
        bodies = [self.frame["body"].iloc[k] for k in used]
        begins = np.zeros(len(self.frame), np.int64)
        begins[used] = np.cumsum([0] + [len(b) for b in bodies])[:-1]
        at = begins[self.owner[some]] + self.shift[some]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        first, second = (np.concatenate(list(_pieces(data, r)))[at] for r in (one, two))
        return first, second


def _pieces(data: np.ndarray, rolling: Rolling) -> Iterator[np.ndarray]:
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        yield rolling(data[at : at + BLOCK + LENGTH - 1], LENGTH)


def compare_buckets(segments: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, version, lo, stop, f1, f2, n): repeated spans with null f1, and the distinct strings of
    the runs at bucket boundaries with their fingerprints; n over 1 says that a span has them."""
    hot = HOT_KINDS

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        bucket = Bucket(pd.concat(parts, ignore_index=True), hot)
        frame, owner, start = bucket.frame, bucket.owner, bucket.start
        twin, outer = bucket.repeated(), bucket.outer[owner]
        single = frame["n"].to_numpy()[owner] == 1
        inner = np.flatnonzero(twin & single)
        if len(inner):
            new = np.concatenate([[True], (owner[inner][1:] != owner[inner][:-1]) | (start[inner][1:] != start[inner][:-1] + 1)])
            first, last = inner[new], inner[np.concatenate([new[1:], [True]])]
            yield _spans(frame, owner[first], start[first], start[last] + LENGTH)
        # what the bucket itself repeats is settled: one of each stands for it at the boundary
        edge = np.flatnonzero(outer)
        if not len(edge):
            return
        f1, f2 = bucket.fingerprints(edge, Rolling(2), Rolling(3))
        one = np.unique(np.stack([f1, f2]), axis=1, return_index=True)[1]
        edge, f1, f2 = edge[one], f1[one].view(np.int64), f2[one].view(np.int64)
        for at in range(0, len(edge), 200_000):
            some = slice(at, at + 200_000)
            k = edge[some]
            yield _spans(frame, owner[k], start[k], start[k] + LENGTH, f1[some], f2[some], twin[k])

    dealt = shipped(segments).repartitionByRange(buckets, "lead")
    kind = segments.schema["doc_id"].dataType.simpleString()
    return dealt.mapInPandas(batches, f"doc_id {kind}, version int, lo int, stop int, f1 bigint, f2 bigint, n bigint")


def _spans(frame: pd.DataFrame, owner: np.ndarray, lo: np.ndarray, stop: np.ndarray, f1=None, f2=None, settled=False) -> pd.DataFrame:
    own = frame[["doc_id", "version", "n"]].iloc[owner].reset_index(drop=True)
    return pd.DataFrame({"doc_id": own["doc_id"], "version": own["version"], "lo": lo, "stop": stop, "f1": f1, "f2": f2, "n": own["n"] + settled})


def repeated_spans(docs: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables of (doc_id, version, lo, stop): byte spans whose union is every repeated string."""
    spark = docs.sparkSession
    found = scratch.keep(anchors(docs))
    # stored first: a join whose sides have shuffles of their own is split where a key is hot
    often = scratch.keep(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    live = scratch.keep(found.join(often, "gram", "left_semi"))
    scratch.drop(found, often)
    segs = scratch.keep(live.groupBy("gram", "seg").agg(F.count("*").alias("n"), F.first(F.struct("doc_id", "version", "off", "lo", "hi")).alias("rep")))
    copied = segs.where("n > 1").select("gram", "seg")
    whole = scratch.keep(live.join(copied, ["gram", "seg"], "left_semi").select("doc_id", "version", "lo", (F.col("hi") + LENGTH).alias("stop")))
    scratch.drop(live)
    several = scratch.keep(segs.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    segments = scratch.keep(cut_segments(docs, segs.join(several, "gram").select("gram", "n", "kinds", "rep.*")))
    scratch.drop(segs, several)
    size = segments.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    compared = scratch.keep(compare_buckets(segments, buckets))
    scratch.drop(segments)
    inner = compared.where("f1 IS NULL").select("doc_id", "version", "lo", "stop")
    edge = compared.where("f1 IS NOT NULL")
    twice = edge.groupBy("f1", "f2").agg(F.count("*").alias("c")).where("c > 1").select("f1", "f2")
    across = edge.where("n = 1").join(twice, ["f1", "f2"], "left_semi").select("doc_id", "version", "lo", "stop")
    return [whole, inner, across]


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of a set of (lo, stop)."""
    out: list[list[int]] = []
    for lo, stop in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([lo, stop])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the remaining bytes."""
    own, docs = docs.schema["doc_id"].dataType, masked(docs.select("doc_id", "text"), "doc_id")
    scratch = Scratch()
    tables = repeated_spans(docs, scratch)
    spans = stored(
        reduce(DataFrame.unionByName, tables)
        .groupBy(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"))
        .agg(F.collect_list("lo").alias("lo"), F.collect_list("stop").alias("stop"))
    )
    scratch.clear()
    texts = _versioned(docs)
    joined = texts.join(spans, texts["doc_id"].eqNullSafe(F.col("_doc")) & (texts["version"] == F.col("_version")), "left")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, lo, stop in zip(frame["text"], frame["lo"], frame["stop"], strict=True):
                data = text.encode()
                gone = merged(zip(lo, stop, strict=True)) if lo is not None else []
                edges = [0, *[x for span in gone for x in span], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(gone), kept))
            found = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            yield found.assign(doc_id=frame["doc_id"].to_numpy())[["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = shipped(joined).select("doc_id", "text", "lo", "stop").mapInPandas(batches, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return unmasked(found, "doc_id", own)
