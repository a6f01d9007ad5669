import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lakeloom.llm import repeat_removal as R


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, seg string")
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in R.remove_repeats(df).collect())


def check(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    want = sorted((str(d), *x) for d, x in zip(ids, brute(texts), strict=True))
    assert result(spark, [(d, t, "x") for d, t in zip(ids, texts, strict=True)]) == want


def words(rng, n):
    return " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) + rng.choice("éüß123") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    shared = words(rng, 90)
    out = [words(rng, rng.randint(1, 400)) for _ in range(30)]
    out += [words(rng, 20) + shared[rng.randint(0, 60) :] + words(rng, 30) for _ in range(12)]
    out += [out[0], out[0], out[5][:150], out[5] + words(rng, 9), None, "", "x", "z" * 900, "y" * 199, "ab" * 300, "q" * 200, "q" * 200]
    near = list(out[7])
    near[len(near) // 2] = "#"
    out.append("".join(near))
    return out


def test_agrees_with_brute_force(spark, texts):
    check(spark, texts)


def test_many_small_buckets(spark, texts, monkeypatch):
    """Runs are cut by many bucket boundaries and have to meet across them."""
    monkeypatch.setattr(R, "BUCKET_BYTES", 600)
    monkeypatch.setattr(R, "HOT_KINDS", 1)
    check(spark, texts)


def test_blocks_cut_runs(texts, spark, monkeypatch):
    rng = random.Random(8)
    base = words(rng, 900)
    monkeypatch.setattr(R, "BLOCK", 512)
    rolling = R.Rolling(1)
    data = (base + base[100:700]).encode()
    spans = [(int(lo), int(hi)) for _, _, los, his in R.runs(data, rolling) for lo, hi in zip(los, his)]
    assert [s for a, b in spans for s in range(a, b + 1)] == list(range(len(data) - 199))


def test_common_line_in_many_contexts(spark):
    rng = random.Random(4)
    line = words(rng, 45)
    check(spark, [words(rng, 40) + line + words(rng, 40) for _ in range(60)])


def test_hot_gram_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(R, "HOT_KINDS", 5)
    rng = random.Random(14)
    line, ends = words(rng, 45), [words(rng, 40) for _ in range(4)]
    check(spark, [words(rng, 40) + line + rng.choice(ends)[: rng.randint(20, 200)] + words(rng, 40) for _ in range(50)])


def test_repeated_rows_and_ids(spark, texts):
    check(spark, [texts[1], texts[1], texts[2], texts[3]], ids=[1, 1, 2, 2])
    check(spark, [texts[1], texts[1]], ids=[None, 4])
    assert result(spark, []) == []


def test_multikey_order_is_byte_order():
    rng = random.Random(2)
    bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [b"", b"a", b"a\0", b"a\0\0"]
    order = R.multikey_order(bodies)
    assert [bodies[i] for i in order] == sorted(bodies)


def test_neighbours_in_suffix_order_tell_the_repeats():
    rng = random.Random(9)
    rolling, shared = R.Rolling(1), words(rng, 80)
    bodies = [(words(rng, 50) + shared[rng.randint(0, 40) :] + words(rng, 50)).encode() for _ in range(25)]
    rows = []
    for k, body in enumerate(bodies):
        for gram, off, lo, hi in R.runs(body, rolling):
            rows += [(k, int(g), int(o), int(a), body[a : b + R.LENGTH]) for g, o, a, b in zip(gram, off, lo, hi)]
    often = Counter(r[1] for r in rows)
    rows = [r for r in rows if often[r[1]] > 1]
    frame = R.pd.DataFrame(rows, columns=["doc_id", "gram", "off", "lo", "body"]).assign(kinds=2, n=1)
    frame["suffix"] = [b[o:] for b, o in zip(frame["body"], frame["off"])]
    bucket = R.Bucket(frame, 10)
    suffixes = [bytes(x) for x in bucket.frame["suffix"]]
    assert suffixes == sorted(suffixes)
    strings = [bytes(bucket.data[a : a + R.LENGTH]) for a in bucket.at]
    seen = Counter(strings)
    assert bucket.repeated().tolist() == [seen[x] > 1 for x in strings] and max(seen.values()) > 1


def test_very_long_texts(spark):
    rng = random.Random(10)
    long = words(rng, 60_000)
    check(spark, [long, words(rng, 500) + long[200_000:230_000], "x" * 300_000])


def test_clashing_columns(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    more = df.withColumns({c: F.lit(1) for c in ("version", "gram", "seg", "lo", "stop", "n", "kinds", "body", "suffix", "kept", "_doc")})
    digest = lambda d: sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in R.remove_repeats(d).collect())
    assert digest(df) == digest(more)


def test_equal_strings_have_equal_anchors():
    rng = random.Random(6)
    body = words(rng, 200).encode()
    rolling = R.Rolling(1)

    def anchors(data):
        found = {}
        for gram, off, lo, hi in R.runs(data, rolling):
            for g, o, a, b in zip(gram, off, lo, hi):
                found.update({int(s): (int(g), int(a + o - s)) for s in range(a, b + 1)})
        return found

    alone, inside = anchors(body), anchors(b"p" * 333 + body + b"s" * 77)
    assert all(inside[s + 333] == x for s, x in alone.items())
    assert np.unique(rolling.codes).size == 256
