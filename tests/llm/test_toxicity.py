import random

from pyspark.sql import functions as F

from lakeloom.llm import toxicity as X


def test_folding():
    assert X.folded_words("1D10T ѕсum tra​sh, Été_x ###") == ["idiot", "scum", "trash", "été", "x"]
    assert X.folded_words(None) == X.folded_words("12 --") [2:] == []


def test_matcher_words_beginnings_and_exceptions():
    m = X.Matcher({" scum ": 2.0, " mor": 1.0, " moron ": 3.0}, [" scum bag "])
    assert m.hits("scum scummy morose moron".split()) == {0: 2.0, 12: 1.0, 19: 3.0}
    assert m.hits("the scum bag".split()) == {}
    assert m.hits("scum bag scum".split()) == {9: 2.0}
    assert X.Matcher({}).hits(["a"]) == {} and m.hits([]) == {}


def brute(lexicon, exceptions, words):
    text, found = f" {' '.join(words)} ", {}
    for entry, weight in lexicon.items():
        for at in range(len(text)):
            if text.startswith(entry, at):
                found[at] = max(weight, found.get(at, 0.0))
    free = [(at, at + len(p) - 1) for p in exceptions for at in range(len(text)) if text.startswith(p, at)]
    return {at: w for at, w in found.items() if not any(a <= at < b for a, b in free)}


def test_matcher_against_brute_force():
    for seed in range(200):
        rng = random.Random(seed)
        some = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(12)]
        lexicon = {rng.choice([f" {w} ", f" {w}"]): rng.random() for w in rng.sample(some, 5)}
        phrases = sorted({f" {' '.join(rng.choices(some, k=rng.randint(1, 3)))} " for _ in range(6)} - lexicon.keys())
        words = rng.choices(some, k=rng.randint(0, 40))
        assert X.Matcher(lexicon, phrases).hits(words) == (brute(lexicon, phrases, words) if words else {})


def test_long_texts_take_linear_time():
    m = X.Matcher({" bad ": 1.0}, [" bad day "])
    hits = m.hits("bad day bad luck".split() * 100_000)
    assert len(hits) == 100_000


def test_length_normalises():
    m = X.Matcher({" bad ": 2.0})
    short, long = m.features("bad"), m.features("bad" + " fine" * 500)
    assert short[1] == long[1] and short[2] > long[2] > 0 and m.features(None) == (0.0, 0.0, 0.0)


def test_learns_lexicon_exceptions_and_ignores_held_out(spark):
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = f"plain words number {i} " + ("you vile thing" if toxic else "a vile smell of cheese" if i % 7 == 0 else "fine day")
        docs.append((i, text if not (toxic and i % 10 == 0) else text.replace("vile", "v1le")))
        labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("toxic", F.lit(5)).withColumn("fold", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = X.fit_rows(d, lab)
    assert rows.where(X.held_out(F.col("doc_id"))).count() == 0 and X.fit_rows(d, lab, bound=40).count() == 40
    model = X.fit(d, lab)
    got = {r["doc_id"]: r["score"] for r in X.score_toxicity(d, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert all(got[i] >= 0.7 for i in got if i % 5 == 0) and all(got[i] < 0.7 for i in got if i % 5)


def test_defined_edge_cases(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x"), (5, "9 9")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    model = X.fit(d, lab)
    assert [r["score"] for r in X.score_toxicity(d, model).collect()] == [0.0] * 5
    assert X.score_toxicity(d.limit(0), model).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    docs = [(i, "you vile thing" if i % 2 else "a fine day") for i in range(120)]
    d = spark.createDataFrame(docs + docs[:5], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("toxic", "fold", "score", "held_out", "entry", "n")})
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = X.score_toxicity(d, X.fit(d, lab.drop("text"))).collect()
    assert len(got) == 125 and len({(r["doc_id"], r["score"]) for r in got}) == 120


def test_held_out_accuracy(spark):
    from lakeloom.llm.queries import op6_toxicity

    sf = "/root/testdata/sf0.1"
    found = op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic = found[found["toxic"] == 1]
    assert (found["predicted"] == found["toxic"]).mean() > 0.97 and toxic["predicted"].mean() > 0.9
    assert found[found["toxic"] == 0]["predicted"].mean() < 0.01
