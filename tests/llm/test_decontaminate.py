import random
from collections import Counter

from pyspark.sql import functions as F

from lakeloom.llm import decontaminate as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = [w for w in (text or "").translate(LOWER).split() if w]
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def best(text, item):
    """Greatest weighted similarity of an item-sized window, over all windows."""
    have, want = shingles(text), shingles(item)
    found = 0.0
    if not want:
        return found
    for at in range(max(0, len(have) - len(want) + 1)):
        window = Counter(have[at : at + len(want)])
        common = sum((window & Counter(want)).values())
        found = max(found, common / (2 * len(want) - common))
    return found


def sentence(rng, n):
    return " ".join(rng.choice(["ka", "lo", "mi", "ne", "pu"]) + rng.choice(["ra", "ti", "su", "vo"]) + str(rng.randrange(9)) for _ in range(n))


def fixture():
    rng = random.Random(7)
    items = [(k, sentence(rng, n)) for k, n in enumerate((15, 20, 24, 31, 40, 55, 60, 80))] + [(90, "too short here"), (91, None), (92, "again and again " * 9)]
    docs = [(k, sentence(rng, rng.randint(5, 200))) for k in range(25)]
    docs += [(100 + k, f"{sentence(rng, 17)}\n{item.upper()} {sentence(rng, 11)}") for k, item in items if item]
    for k, item in items[3:8]:
        words = item.split()
        words[len(words) // 2] = "edited"
        docs.append((200 + k, f"{sentence(rng, 5)} {' '.join(words)} {sentence(rng, 50)}"))
        docs.append((300 + k, f"{sentence(rng, 5)} {' '.join(words[: len(words) // 2])} {sentence(rng, 50)}"))
    return docs + [(400, None), (401, ""), (402, items[2][1]), (402, items[2][1])], items


def found(spark, docs, items, extra=False):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    if extra:
        d, b = d.withColumns({c: F.lit(1) for c in ("size", "fp", "item_id", "version")}), b.withColumns({c: F.lit(1) for c in ("doc_id", "size")})
    return D.contamination(d, b).collect()


def test_agrees_with_all_windows(spark):
    docs, items = fixture()
    rows = found(spark, docs, items, extra=True)
    assert len(rows) == len(docs)
    want = {d: sorted(k for k, i in items if best(t, i) >= 0.8) for d, t in docs}
    assert {r["doc_id"]: [int(x) for x in r["item_ids"].split(",") if x] for r in rows} == want
    assert any(len(v) for d, v in want.items() if 200 <= d < 300) and not any(v for d, v in want.items() if 300 <= d < 400)
    exact = {d: max([best(t, i) for k, i in items if k in want[d]], default=0.0) for d, t in docs}
    assert all(abs(r["similarity"] - exact[r["doc_id"]]) < 1e-6 for r in rows)


def test_clean_documents_stay(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    kept = {r["doc_id"] for r in D.without_leaks(d, b).collect()}
    assert kept == {k for k, t in docs if not any(best(t, i) >= 0.8 for _, i in items)}


def test_empty_tables(spark):
    docs, items = fixture()
    assert found(spark, [], items) == []
    assert not any(r["contaminated"] for r in found(spark, docs[:5], []))


def test_multi_index_meets_every_fingerprint_within_radius(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    rows = [(0, 9, base, [5, 6])]
    for k in range(1, 300):
        bits = rng.sample(range(63), rng.randint(0, 30))
        rows.append((k, 9, base ^ sum(1 << b for b in bits), [rng.choice((4, 5))]))
    df = spark.createDataFrame(rows, "item_id long, size int, fp long, anchors array<long>")
    probe = D.multi_index(df.where("item_id = 0")).select("key")
    met = {r["item_id"] for r in D.multi_index(df).join(probe, "key", "left_semi").collect()}
    near = {k for k, _, fp, _ in rows if (fp ^ base).bit_count() <= D.RADIUS}
    assert {k for k, _, _, anchors in rows if k in near and set(anchors) & {5, 6}} <= met
    assert not {k for k, _, _, anchors in rows if anchors == [4]} & met


def test_simhash_and_similarity(spark):
    a, b = [3, 3, 5, -1], [3, 5, 5, 7]
    row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(D.simhash(F.col("a")), D.similarity(D.numbered(F.col("a")), D.numbered(F.col("b")))).first()
    mask = (1 << 64) - 1
    assert row[0] & mask == sum(1 << k for k in range(64) if 2 * sum((x & mask) >> k & 1 for x in a) > 4)
    assert abs(row[1] - 2 / 6) < 1e-9


def test_similarity_counts_repeats(spark):
    rng = random.Random(8)
    pairs = [([rng.randrange(6) for _ in range(rng.randint(0, 30))], [rng.randrange(6) for _ in range(rng.randint(1, 30))]) for _ in range(60)]
    rows = spark.createDataFrame(pairs, "a array<long>, b array<long>").select("a", "b", D.similarity(D.numbered(F.col("a")), D.numbered(F.col("b"))).alias("s")).collect()
    for r in rows:
        common = sum((Counter(r["a"]) & Counter(r["b"])).values())
        assert abs(r["s"] - common / (len(r["a"]) + len(r["b"]) - common)) < 1e-12


def test_recall_of_random_edits_near_the_threshold(spark):
    """Edits at every position, at the start, inside and at the end of documents: the query finds what a
    comparison with all windows finds."""
    rng = random.Random(21)
    items = [(k, sentence(rng, rng.randint(40, 130))) for k in range(40)]
    docs = []
    for n in range(700):
        words = items[n % len(items)][1].split()
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 2)] = ["edited"] * rng.randint(0, 2)
        if rng.random() < 0.3:
            words = words[rng.randint(0, 4) : len(words) - rng.randint(0, 4)]
        before, after = (sentence(rng, rng.choice((0, 0, 6, 30))) for _ in range(2))
        docs.append((n, f"{before} {' '.join(words)} {after}"))
    got = {r["doc_id"]: r for r in found(spark, docs, items)}
    near = 0
    for d, text in docs:
        item = items[d % len(items)][1]
        exact = best(text, item)
        near += 0.8 <= exact <= 0.84
        if exact >= 0.8:
            assert str(items[d % len(items)][0]) in got[d]["item_ids"].split(",") and abs(got[d]["similarity"] - exact) < 1e-6
        elif len(shingles(text)) >= len(shingles(item)):
            assert not got[d]["contaminated"]
    assert near >= 40


def test_null_and_repeated_items(spark):
    rng = random.Random(6)
    one, two, three = (sentence(rng, 30) for _ in range(3))
    docs = [(1, one), (2, two), (3, three), (None, one), (5, f"{one} {two}")]
    got = found(spark, docs, [(None, one), (7, two), (7, three), (7, two), (8, two)])
    assert sorted((str(r["doc_id"]), r["contaminated"], r["n_items"], r["item_ids"]) for r in got) == [
        ("1", True, 0, ""), ("2", True, 2, "7,8"), ("3", True, 1, "7"), ("5", True, 2, "7,8"), ("None", True, 0, ""),
    ]


def test_very_long_items_and_texts(spark):
    rng = random.Random(5)
    item = sentence(rng, 2_500)
    docs = [(1, f"{sentence(rng, 9)} {item} {sentence(rng, 70_000)}"), (2, sentence(rng, 90_000)), (3, "again " * 4_000)]
    assert {r["doc_id"]: r["item_ids"] for r in found(spark, docs, [(7, item), (8, "again " * 2_500)])} == {1: "7", 2: "", 3: "8"}


def test_leaks_at_the_end_of_documents_and_as_whole_documents(spark):
    rng = random.Random(11)
    items = [(k, sentence(rng, n)) for k, n in enumerate((40, 60, 80, 120))]
    docs = []
    for k, item in items:
        words = item.split()
        first = ["edited", *words[1:]]
        cut = {1: words[2:], 2: first, 3: words[:-2], 4: words[1:-1]}
        docs += [(10 * how + k, f"{sentence(rng, 30)} {' '.join(w)}") for how, w in cut.items()]
        docs += [(100 + 10 * how + k, " ".join(w)) for how, w in cut.items()]

    def expected(text, item):
        have, want = Counter(shingles(text)), Counter(shingles(item))
        common = sum((have & want).values())
        whole = common / (have.total() + want.total() - common) if have.total() < want.total() else 0.0
        return max(best(text, item), whole)

    rows = {r["doc_id"]: r for r in found(spark, docs, items)}
    want = {d: sorted(k for k, i in items if expected(t, i) >= 0.8) for d, t in docs}
    assert all(want[d] for d in want)
    assert {d: [int(x) for x in r["item_ids"].split(",") if x] for d, r in rows.items()} == want
    assert all(abs(rows[d]["similarity"] - max(expected(t, i) for _, i in items)) < 1e-6 for d, t in docs)
