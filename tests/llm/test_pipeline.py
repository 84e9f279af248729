"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, FOLDER).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0] and kept[1] < kept[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(corpus_pipeline.run(spark, FOLDER).collect()) == len(pieces)


def run_stages(spark, tmp_path, docs, folder):
    """What every stage returns, each on what the one before kept."""
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_nulls_repeated_rows_and_long_texts(spark, tmp_path):
    real = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40).collect()]
    long = " ".join(f"word{k % 977}x{k % 13}" for k in range(60_000)) + "."
    rows = [*real, *real[:5], (None, None, None, None, None), (900, "", "en", "s", 0), (900, long, "en", "s", len(long)),
            (901, " ", None, None, None)]
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    docs = spark.createDataFrame(rows, schema)
    good, once, apart, masked, pieces = run_stages(spark, tmp_path, docs, FOLDER)
    blank = str.maketrans("", "", " \t\n\x0b\x0c\r")
    texts = [(r["text"] or "").translate(blank) for r in good.collect()]
    assert sorted((r["text"] or "").translate(blank) for r in once.collect()) == sorted(set(texts))
    assert masked.count() == apart.count() <= once.count()
    places = pieces.collect()
    assert {r["doc_id"] for r in places} == {r["doc_id"] for r in masked.select("doc_id").collect()}
    assert all(len(r["ids"]) == r["length"] <= 1024 for r in places)


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for k, result in enumerate(run_stages(spark, tmp_path, docs, FOLDER)):
        assert result.count() == 0, k
