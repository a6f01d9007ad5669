import random
import re

from pyspark.sql import functions as F

from lakeloom.llm import license_scan as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = []
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


FILL = "some words of no meaning at all "
TEXTS = [
    None, "", "...", "MIT License", "mit-license, the MIT\nLICENSE; mit licenses", "general public general public license", "général public license Apache license",
    FILL * 9 + "Licensed under the Apache License, Version 2.0." + FILL, "Released under the MIT License.\n" * 3, "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "apache apache license license", FILL * 400 + "mit license", "public license general", "1mit license2 mit license",
    "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
]


def rows(spark, texts, **extra):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({k: F.lit(v) for k, v in extra.items()})
    return {r["doc_id"]: r for r in L.scan_licenses(df).collect()}


def test_base_agrees_with_brute_force(spark):
    got = rows(spark, TEXTS, h=1, gram="x", votes=2)
    assert {k: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for k, r in got.items()} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_notices_add_labels(spark):
    got = rows(spark, TEXTS)
    assert got[7]["labels"] == "apache,apache-2.0" and got[8]["labels"] == "mit,mit-notice" and got[9]["labels"] == "gpl,gpl-3.0"
    assert got[10]["labels"] == "cc-by-nc-4.0" and got[10]["base_labels"] == "" and got[10]["score"] == 1.0
    assert got[15]["labels"] == "mit-text"  # one word more moves the rest to the next diagonal
    assert got[0]["score"] == 0.0 and got[0]["labels"] == ""
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got.values())


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "mit license")], "doc_id long, text string")
    assert [r["n_base"] for r in L.scan_licenses(df).collect()] == [1, 1, 1]
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_repeated_and_scattered_grams_are_not_a_notice(spark):
    repeated = "changes in version 1.0, version 1.0, version 1.0, version 1.0 today"
    # every gram of the notice in one chain of diagonals, its ends 40 words apart
    scattered = "boost software license " + "software license " * 20 + "version 1.0"
    stutter = "Boost Software License - Version version 1.0"
    words = L.template_words(list(L.NOTICES)[1])
    spread = " ".join([*words[:9], "a", "b", "c", *words[9:19], "d", "e", "f", *words[19:]])
    got = rows(spark, [repeated, scattered, stutter, spread, "Boost Software License - Version 1.0 " * 3])
    assert [got[k]["labels"] for k in range(5)] == ["", "", "bsl-1.0", "mit-text", "bsl-1.0"]
    assert got[0]["score"] == 0.4 and got[1]["score"] == 0.8 and got[2]["score"] == got[4]["score"] == 1.0


def spanned(text):
    """Labels and score by comparing every place of a document with every template."""
    words = L.template_words(text or "")
    labels, score = set(), 0.0
    for k, (wording, label) in enumerate([*L.PHRASES.items(), *L.NOTICES.items()]):
        known = L.template_words(wording)
        grams = len(known) - 1
        matches = [(p, t) for p in range(len(words) - 1) for t in range(grams) if words[p : p + 2] == known[t : t + 2]]
        if k < len(L.PHRASES):
            if any(words[p : p + len(known)] == known for p in range(len(words))):
                labels.add(label)
                score = 1.0
            continue
        stretch = grams + L.SLACK * (int(grams * (1 - L.COVERED) + 1e-9) + 1)
        chains = []
        for p, t in sorted(matches, key=lambda m: m[0] - m[1]):
            if not chains or (p - t) - chains[-1][-1][2] > L.SLACK:
                chains.append([])
            chains[-1].append((p, t, p - t))
        for chain in chains:
            most = max(len({t for p, t, _ in chain if at <= p < at + stretch}) for at, _, _ in chain) / grams
            score = max(score, most)
            if most >= L.COVERED:
                labels.add(label)
    return ",".join(sorted(labels)), round(score, 6)


def test_labels_and_score_agree_with_brute_force(spark):
    rng = random.Random(3)
    texts = ["public license " * 5, *TEXTS]
    for _ in range(160):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = re.split(r"\s+", rng.choice([*L.PHRASES, *L.NOTICES]))
            if rng.random() < 0.4:
                words = words[rng.randint(0, len(words) // 2) : len(words) - rng.randint(0, len(words) // 2)]
            for _ in range(rng.choice((0, 0, 1, 3, 6))):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randint(0, 2)] = rng.choices(["odd", "license", "the", "software"], k=rng.randint(0, 3))
            parts.append(" ".join(words * rng.choice((1, 1, 1, 3))))
        texts.append((" " + FILL * rng.randint(0, 2)).join(parts))
    got = rows(spark, texts)
    assert {k: (r["labels"], r["score"]) for k, r in got.items()} == {k: spanned(t) for k, t in enumerate(texts)}
    assert got[0]["labels"] == "" and got[0]["score"] < L.COVERED


def test_very_long_and_repetitive_texts(spark):
    mit = next(k for k, v in L.NOTICES.items() if v == "mit-full")
    got = rows(spark, [FILL * 60_000 + mit, "the software and this software " * 8_000, f"{mit} {FILL}" * 100])
    assert [got[k]["labels"] for k in range(3)] == ["mit-full,mit-text", "", "mit-full,mit-text"]
