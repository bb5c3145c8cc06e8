import corpus_pipeline as C
from deploom.llm import bwt, pii, simhash, toxicity


def test_stages_against_their_operators(spark, docs, tmp_path):
    """Each stage on its predecessor's output, and run() as a whole."""
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(own).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i == 14)) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash", "suffix_array", "pii", "packing"] and C.ORACLE_SQL is None
    got = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in C.STAGES:
        before, got = got, stage(spark, got, str(tmp_path))
        got.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert got.columns == own
        if name == "toxicity":
            assert got.count() == toxicity.score(before, labels).where("predicted = 0").count()
        elif name == "simhash":
            assert got.count() == simhash.similar_documents(before).select("component_id").distinct().count()
        elif name == "suffix_array":
            left = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in bwt.digest(before).collect()}
            assert all(len((r["text"] or "").encode()) <= left[r["doc_id"]] for r in got.collect()) and got.count() == before.count()
        elif name == "pii":
            assert not any(pii.base_spans(r["text"] or "") for r in got.collect()) and got.count() == before.count()
    whole = C.run(spark, str(tmp_path))
    key = lambda df: sorted(map(str, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(whole) == key(got)
