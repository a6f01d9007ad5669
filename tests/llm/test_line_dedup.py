import hashlib

from lakeloom.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(LOWER)


def brute(rows):
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                rank = (doc is not None, doc or 0)
                first[key(line)] = min(first.get(key(line), rank), rank)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (doc is not None, doc or 0)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def result(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(1) for c in ("h1", "salt", "word", "_doc", "bitmap", "n_chars")})
    return [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in line_dedup.dedup_lines(df).collect()]


def same(a, b):
    order = lambda rows: sorted(rows, key=str)
    assert order(a) == order(b)


COMMON = "A line that everyone has\n"
ROWS = [
    (3, COMMON + "own line number three\n"), (1, "  a LINE that everyone has \t\nshort\n\nshort"), (2, None), (7, ""),
    (5, COMMON * 3 + "Ünïcode Line Änd more"), (6, "ünïcode line änd more\nÜNÏCODE LINE ÄND MORE"), (8, "\n\n\n"), (9, COMMON.strip()),
    (4, "\n".join(f"filler line {i}" for i in range(200)) + "\n" + COMMON), (10, "\n".join(f"filler line {i}" for i in range(0, 200, 3))),
]


def test_agrees_with_brute_force(spark):
    same(result(spark, ROWS), brute(ROWS))


def test_hot_line_over_all_salts(spark):
    rows = [(i, f"{COMMON}document {i} says this") for i in range(300)]
    same(result(spark, rows), brute(rows))


def test_repeated_rows_and_null_ids(spark):
    rows = [*ROWS[:3], *ROWS[:3], (3, COMMON + "another text of three"), (None, COMMON), (None, COMMON + "and one line more")]
    same(result(spark, rows), brute(rows))


def test_extra_columns_and_empty_table(spark):
    same(result(spark, ROWS, extra=True), brute(ROWS))
    assert result(spark, []) == []


def test_columns_named_like_the_counts_stay(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("doc_id as n_lines", "doc_id", "text", "7 as N_DROPPED", "1 as _version")
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "_n_lines", "_n_dropped"]
    same([(r["doc_id"], r["_n_lines"], r["_n_dropped"], r["text"] or "") for r in got.collect()], brute(ROWS))
    assert all(r["n_lines"] == r["doc_id"] and r["N_DROPPED"] == 7 for r in got.collect())


def test_bitmaps_name_lines_that_stay_and_no_text(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    marks = {r["doc_id"]: r["bitmap"] for r in line_dedup.keep_bitmaps(df).collect()}
    assert set(marks) == {d for d, _, n, _ in brute(ROWS) if n}
    assert [(w["word"], w["bits"]) for w in marks[3]] == [(0, ~1)]


def test_only_hot_lines_are_salted(spark):
    rows = [(i, f"{COMMON}document {i} says this\nand document {i} says that\nline of group {i % 40} here") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = line_dedup.hashed_lines(df)
    hot = line_dedup.hot_lines(hashed, 8).collect()
    common = hashed.groupBy("h1").count().orderBy("count", ascending=False).first()
    assert common["count"] == 400 and common["h1"] in {r["h1"] for r in hot} and len(hot) <= 8 * line_dedup.HOT_PER_PART
    same(result(spark, rows), brute(rows))


def test_ranges_of_hashes_are_ordered_and_even(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.xxhash64("id").alias("h")).union(spark.createDataFrame([(-(1 << 63),), ((1 << 63) - 1,), (0,), (-1,)], "h long"))
    found = rows.select("h", line_dedup.part_of(F.col("h"), F.lit(0), 7).alias("p")).orderBy("h").collect()
    assert [r["p"] for r in found] == sorted(r["p"] for r in found) and (found[0]["p"], found[-1]["p"]) == (0, 6)
    sizes = [sum(r["p"] == k for r in found) for k in range(7)]
    assert min(sizes) > 2600 and max(sizes) < 3100


def test_one_shuffle_of_lines(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = line_dedup.dropped_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_very_long_texts(spark):
    lines = [f"line {k % 30_000} of a long text" for k in range(70_000)]
    rows = [(2, "\n".join(lines)), (1, "\n".join(lines[::500])), (3, "x" * 3_000_000), (4, "y\nX" + "x" * 2_999_999)]
    same(result(spark, rows), brute(rows))


def test_query_digest(spark, sf):
    from lakeloom.llm.queries import op4_line_dedup

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)}
    assert {tuple(r) for r in op4_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()} == want
