import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_chain_and_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes), name
        assert kept.count() <= docs.count()
        docs = kept.cache()
    assert 0 < docs.count() < before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()


def test_run_is_the_composition(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    ids = {r["doc_id"] for r in found.select("doc_id").collect()}
    from lakeloom.llm import quality_rules

    good = quality_rules.keep_good(spark.read.parquet(f"{sf}/documents.parquet"))
    assert ids <= {r["doc_id"] for r in good.select("doc_id").collect()}
    assert found.where(F.size("ids") > 0).count() > 0


def test_five_stages_each_with_an_operator():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding",
    ]


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_run_agrees_with_plain_python(spark, sf):
    """Every stage by brute force, each on what its predecessor kept."""
    from lakeloom.llm import piece_codec
    import test_decontaminate as leaks
    import test_line_dedup as line_test
    import test_piece_codec as pieces
    import test_quality_rules as quality
    import test_simhash_dedup as copies

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    kept = quality.verdicts([(r["text"], r["lang"], r["source"]) for r in rows])
    docs = [(r["doc_id"], r["text"]) for r, (good, _) in zip(rows, kept) if good]
    docs = [(d, text) for d, _, _, text in line_test.brute(docs)]
    groups = copies.brute_components([(d, copies.brute_fp(t)) for d, t in docs])
    docs = [(d, t) for d, t in docs if groups[d] == d]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaked(text):
        have = leaks.shingles(text)
        for item in items:
            want = set(leaks.shingles(item))
            # a window needs four fifths of the item's shingles
            if want and sum(x in want for x in have) >= 0.8 * len(want):
                whole = leaks.Counter(have) & leaks.Counter(leaks.shingles(item))
                short = whole.total() / (len(have) + len(leaks.shingles(item)) - whole.total()) if len(have) < len(leaks.shingles(item)) else 0.0
                if max(leaks.best(text, item), short) >= 0.8:
                    return True
        return False

    docs = [(d, t) for d, t in docs if not leaked(t)]
    codec = piece_codec.Codec()
    want = {d: pieces.whole(codec.v, piece_codec.BLANK + t.replace(" ", piece_codec.BLANK)) if t else [] for d, t in docs if piece_codec.BLANK not in t}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {d for d, _ in docs} and 0 < len(want) < len(rows)
    assert all(got[d] == ids for d, ids in want.items())
