import random

import pytest

from lakeloom.llm import piece_codec as P


@pytest.fixture(scope="module")
def codec():
    return P.Codec()


def whole(v, text):
    """Viterbi over the whole text at once."""
    best = [(0.0, 0, None)] + [None] * len(text)
    for at in range(len(text)):
        edges = [(at + n, *v.pieces[text[at : at + n]]) for n in range(1, v.longest + 1) if at + n <= len(text) and text[at : at + n] in v.pieces]
        if not any(stop == at + 1 for stop, _, _ in edges):
            edges.append((at + 1, None, v.unknown))
        for stop, i, worth in edges:
            if best[stop] is None or best[at][0] + worth > best[stop][0]:
                best[stop] = (best[at][0] + worth, at, i)
    out, at = [], len(text)
    while at:
        _, start, i = best[at]
        out += [i] if i is not None else v.spelled(text[start])[::-1]
        at = start
    return out[::-1]


TEXTS = [
    "a", " ", "  two  blanks ", "the end.\nThe start\t\r\n", "Ünïcödé, 漢字かな 🙂🙂 ▁literal▁ ", "x" * 300, "▁", "мир и война", "a\u0000b", "internationalization " * 30,
    "nospacesatallinthisverylongtokenthatgoesonandonandon" * 5,
]


def test_round_trip(codec):
    for text in TEXTS:
        assert codec.decode(codec.encode(text)) == text
    assert codec.encode(None) == codec.encode("") == [] and codec.decode([]) == ""


def test_equals_one_search_over_the_whole_text(codec):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abcdefgh  \n.éж漢") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    for text in texts:
        if P.BLANK not in text:
            assert codec.encode(text) == whole(codec.v, P.BLANK + text.replace(" ", P.BLANK))


def test_streaming_in_blocks_commits_early_and_holds_a_window(codec):
    rng = random.Random(4)
    text = P.BLANK + P.BLANK.join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12))) for _ in range(2000))
    search, out, early = P.StreamingViterbi(codec.v), [], 0
    at = 0
    while at < len(text):
        n = rng.randint(1, 50)
        out += search.feed(text[at : at + n])
        at += n
        early = max(early, len(out))
    assert early > 0.9 * len(whole(codec.v, text))
    assert out + search.feed("", last=True) == whole(codec.v, text)
    assert search.widest <= 4 * codec.v.longest


def test_window_of_paths_that_disagree(codec):
    """Pieces of two letters divide a run of one letter in two ways that never meet: such a run is held
    until it ends. Where paths meet the window stays bounded."""
    for text, bounded in (("o" * 5000, False), ("=" * 4000 + "-" * 4000, False), ("的" * 3000, True), ("international" * 300, True), ("\u0301" * 900, True)):
        search, out = P.StreamingViterbi(codec.v), []
        for char in P.BLANK + text:
            out += search.feed(char)
        assert out + search.feed("", last=True) == whole(codec.v, P.BLANK + text)
        assert search.widest <= 4 * codec.v.longest or not bounded, (text[:3], search.widest)


def test_memo_turns_over(codec, monkeypatch):
    monkeypatch.setattr(P, "MEMO", 40)
    small = P.Codec()
    text = "one two three four five one two six seven one " + "long" * 50
    assert small.encode(text) == codec.encode(text) and small.decode(small.encode(text)) == text
    assert sum(map(len, small.memo)) <= max(40, 201)


def test_ranks_become_log_probabilities():
    ranks = [-float(k) for k in range(1000)]
    worth = P.log_probabilities(ranks)
    assert abs(sum(2.718281828459045**w for w in worth) - 1) < 1e-9 and worth == sorted(worth, reverse=True)
    unigram = [-2.5, -2.75, -3.1, -9.0]
    assert P.log_probabilities(unigram) == unigram and P.log_probabilities([]) == []


def test_close_to_merging(spark, sf):
    """The ids are not those of merging; how far they are apart is in the README."""
    import sentencepiece

    library, codec = sentencepiece.SentencePieceProcessor(model_file=P.MODEL), P.Codec()
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r["text"]][:300]
    own, theirs = sum(len(codec.encode(t)) for t in texts), sum(len(library.encode(t)) for t in texts)
    assert abs(own / theirs - 1) < 0.03
    assert all(library.decode(codec.encode(t)) == t for t in texts if P.BLANK not in t)


def test_very_long_texts(spark):
    rows = [(1, "word " * 400_000), (2, "x" * 600_000), (3, "漢字" * 100_000)]
    got = P.decode_ids(P.encode_texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(rows)


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "n_pieces", "ids_sha256", "batch")})
    assert {r["doc_id"]: r["text"] for r in P.decode_ids(P.encode_texts(df)).collect()} == {1: "some text", 2: ""}


def test_data_frames(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (51, ""), (1, " "), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.decode_ids(P.encode_texts(df)).collect()
    assert sorted(((str(r["doc_id"]), r["text"]) for r in got)) == sorted((str(d), t or "") for d, t in rows)
    assert P.encode_texts(df.limit(0)).count() == 0
