"""Line deduplication across documents, in DataFrame operations only.

Lines become 128-bit hashes, stored once: texts are split a single time. The hashes are
range-partitioned (by ranges of equal width, as hashes are uniform), sorted by document and position inside each partition, and one streaming pass tells
the first document of each hash from the later ones. A frequent-items sketch over all lines finds the
hashes that would weigh on a partition (at most ``HOT_PER_PART`` a partition); only these are dealt
further by a salt drawn from the document, and only their heads, one document a salt, are compared
once more, by an aggregate with a row a task. The sketch decides where rows go, never which stay, so
no other line is shuffled twice. What comes back is a compressed bitmap of kept lines per document (64
lines a word, words without a dropped line left out), never text.

Defined results. Null or empty text: one empty line, kept. Lines with a key under ``min_chars``
code points are always kept. Rows that repeat a doc_id count as the same document, and a null
doc_id sorts before all others. Empty tables give empty results; columns besides doc_id and text
are carried along untouched, also where they have the names of the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, stored

#: A hot hash is dealt to this many salts, or to as many as there are partitions.
SALTS = 64
#: Hashes for each partition that may count as hot, and hashes that the sketch tracks for each of them.
HOT_PER_PART, TRACKED = 4, 8
MIN_CHARS = 10
_TRIM = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """What two lines must share to be the same: edge white space and A-Z case do not matter."""
    return ascii_lower(F.btrim(line, F.lit(_TRIM)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, version, pos, h1, h2) of each line long enough to count; ``version`` tells rows
    that repeat a doc_id with another text apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("version"), F.posexplode(F.transform(_lines(text), line_key)).alias("pos", "key"))
    rows = rows.where(F.char_length("key") >= min_chars)
    return rows.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


def hot_lines(lines: DataFrame, parts: int) -> DataFrame:
    """(h1, hot) of the hashes with more rows than a fraction of an even partition."""
    most = min(HOT_PER_PART * parts, 100_000)
    found = lines.agg(F.expr(f"approx_top_k(h1, {most}, {TRACKED * most})").alias("top"), F.count("*").alias("n"))
    found = found.select(F.explode("top").alias("t"), "n").where(F.col("t.count") * F.lit(most) > F.col("n"))
    return found.select(F.col("t.item").alias("h1"), F.lit(True).alias("hot"))


def part_of(hash_: Column, salt: Column, parts: int) -> Column:
    """The range of a hash among ``parts`` of equal width: hashes are uniform, so the splitters need no
    sample. Salts of a hot hash go to the ranges next to its own."""
    place = F.shiftrightunsigned(hash_.bitwiseXOR(F.lit(-(1 << 63))), 33)
    return F.pmod(F.shiftright(place * F.lit(parts).cast("long"), 31) + salt, F.lit(parts)).cast("int")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, version, pos) of each line whose key a smaller doc_id holds too."""
    rank = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(hashed_lines(docs, min_chars))
    rows = rows.join(F.broadcast(stored(hot_lines(rows, parts))), "h1", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(max(SALTS, parts)))).otherwise(0).cast("int")
    rows = rows.withColumn("salt", salt).withColumn("part", part_of(F.col("h1"), F.col("salt"), parts))
    ranged = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "h1", "h2", "salt", "doc_id", "pos")
    running = Window.partitionBy("part", "h1", "h2", "salt").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = ranged.withColumn("head", F.first(rank).over(running)).withColumn("own", rank)
    # what needs no second look goes on at once: later lines, and of the hot ones the heads of salts
    seen = stored(seen.where(F.col("hot") | (F.col("own") > F.col("head"))).select("doc_id", "version", "pos", "hot", "h1", "h2", "own", "head"))
    later = seen.where(F.col("own") > F.col("head")).select("doc_id", "version", "pos")
    heads = seen.where(F.col("hot") & (F.col("own") == F.col("head")))
    least = heads.groupBy("h1", "h2").agg(F.min("own").alias("least"))  # at most the hot hashes
    beaten = heads.join(F.broadcast(least), ["h1", "h2"]).where(F.col("own") > F.col("least")).select("doc_id", "version", "pos")
    return later.unionByName(beaten)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, version, bitmap) for documents that lose lines: ``bitmap`` is an array of
    (word, bits); bit b of word w says that line 64 * w + b stays. All lines of other words stay."""
    words = (
        dropped_lines(docs, min_chars)
        .groupBy("doc_id", "version", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.expr("~bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    )
    return words.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def _gone(bitmap: Column) -> Column:
    """Positions that a bitmap does not keep."""
    return F.flatten(
        F.transform(
            bitmap,
            lambda x: F.filter(
                F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.getbit(x["bits"], b) == 0, x["word"] * 64 + b)),
                lambda p: p.isNotNull(),
            ),
        )
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, and as the last two columns the numbers of
    lines before and of dropped ones, named ``counts`` (after underscores where ``docs`` has columns of
    these names). The bitmaps, not the lines, travel to the documents."""
    total, fewer = (_unused(name, docs.columns) for name in counts)
    doc, version, kept = (_unused(name, docs.columns) for name in ("_doc", "_version", "_bitmap"))
    marks = keep_bitmaps(docs, min_chars).toDF(doc, version, kept)
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(marks[doc]) & (own == marks[version]), "left")
    text, bitmap = docs["text"], marks[kept]
    return joined.select(
        *[F.when(bitmap.isNull(), text).otherwise(_rebuilt(text, bitmap)).alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.size(_lines(text)).cast("long").alias(total),
        F.coalesce(F.aggregate(bitmap, F.lit(0), lambda n, x: n + 64 - F.bit_count(x["bits"])), F.lit(0)).cast("long").alias(fewer),
    )


def _unused(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def _rebuilt(text: Column, bitmap: Column) -> Column:
    """The text without the marked lines; the split happens once."""

    def join(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), _gone(bitmap))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return let(_lines(text), join)
