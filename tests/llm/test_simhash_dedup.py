import random

import pytest
import xxhash
from pyspark.sql import functions as F

from lakeloom.llm import simhash_dedup as S


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids_fps):
    parent = list(range(len(ids_fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids_fps)):
        for j in range(i):
            if (ids_fps[i][1] ^ ids_fps[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(ids_fps):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(ids_fps)}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    texts = [None, "", "  \t", "One", "one TWO", "É a\x0bb\x0cc", "a b c " * 50, " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(700))]
    assert [S.fingerprint(t) & (1 << 64) - 1 for t in texts] == [brute_fp(t) for t in texts]


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b c", 42)


@pytest.mark.parametrize("up_to", [48, 2])
def test_edges_connect_all_near_fingerprints(spark, monkeypatch, up_to):
    """With ``up_to`` 2 nearly every bucket goes the way of the large ones."""
    monkeypatch.setattr(S, "PAIRS_UP_TO", up_to)
    rng = random.Random(up_to)
    values = {rng.getrandbits(64) for _ in range(20)}
    for v in list(values)[:8]:
        at = v
        for _ in range(12):  # chains of near fingerprints
            at ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(at)
        values.update(v ^ (1 << b) for b in range(0, 64, 5))
    rows = list(enumerate(sorted(values)))
    fps = spark.createDataFrame([(signed(v),) for _, v in rows], "fp long")
    found = S.components(S.near_edges(fps)).collect()
    by_fp = {signed(v): d for d, v in rows}
    root = {by_fp[r["node"]]: r["root"] for r in found}
    group = {}
    for d, v in rows:
        group.setdefault(root.get(d, signed(v)), []).append(d)
    got = {d: min(g) for g in group.values() for d in g}
    assert got == brute_components(rows)


def test_documents_end_to_end(spark):
    rng = random.Random(5)
    base = " ".join(rng.choice(["sun", "moon", "star", "sky", "sea", "tree"]) + str(rng.randrange(50)) for _ in range(400))
    rows = [(9, base), (4, base), (6, base.upper()), (5, base + " end"), (1, "something else entirely here"), (2, None), (3, ""), (8, " \t"), (7, base.replace("sun1", "sun2"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(0)).withColumn("root", F.lit("x"))
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(df).collect()}
    assert got == brute_components([(d, brute_fp(t)) for d, t in rows])
    assert got[2] == got[3] == got[8] == 2 and got[9] == got[6] == 4
    kept = {r["doc_id"] for r in S.keep_one(df).collect()}
    assert kept == {d for d, c in got.items() if d == c}


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [r["component_id"] for r in S.near_duplicates(df).collect()] == [1, 1, 1]
    assert S.keep_one(df).count() == 3
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_another_text_of_a_doc_id_is_judged_on_its_own(spark):
    rows = [(1, "one two three four"), (5, "one two three four"), (5, "a text that nobody else has"), (5, "a text that nobody else has")]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in kept) == sorted([rows[0], rows[2], rows[3]])


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(150_000))  # several blocks
    assert S.fingerprint(long) & (1 << 64) - 1 == brute_fp(long)
    df = spark.createDataFrame([(2, long), (1, long.upper())], "doc_id long, text string").withColumns({c: F.lit(3) for c in ("version", "node", "rep", "u", "v", "_gone", "_version", "component_id")})
    assert [r["component_id"] for r in S.near_duplicates(df).collect()] == [1, 1]
    kept = S.keep_one(df)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1]
