"""Every operator and stage on tables whose own columns bear awkward names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from deploom.llm import bwt, packing, pii, simhash, toxicity

AWKWARD = ["a.b", "b`c", "__key", "key", "own_key", "spans", "__found", "__spans", "__id", "__text", "__null", "rest", "shard", "fp", "node", "component", "open", "sequence_id", "Text2", "row"]


@pytest.fixture(scope="module")
def awkward(spark, docs):
    out = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for k, name in enumerate(AWKWARD):
        out = out.withColumn(name, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return out.cache()


def labels(spark):
    return spark.createDataFrame([(i, int(i == 14)) for i in range(40)], "doc_id long, toxic int")


OPERATORS = {
    "toxicity": lambda spark, df: toxicity.clean(df, labels(spark)),
    "simhash": lambda spark, df: simhash.representatives(df),
    "similar": lambda spark, df: simhash.representatives(df, simhash.SIMILAR),
    "suffix_array": lambda spark, df: bwt.remove_repeats(df),
    "pii": lambda spark, df: pii.sanitise(df),
    "stage simhash": lambda spark, df: C.drop_near_duplicates(spark, df, ""),
    "stage suffix_array": lambda spark, df: C.drop_repeated_passages(spark, df, ""),
    "stage pii": lambda spark, df: C.sanitise_personal_data(spark, df, ""),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_own_columns_pass_untouched(spark, awkward, name):
    got = OPERATORS[name](spark, awkward)
    assert got.columns == awkward.columns
    rows = got.collect()
    assert rows and len(rows) <= awkward.count()
    for r in rows:
        own = "none" if r["doc_id"] is None else str(r["doc_id"])
        assert [r[c] for c in AWKWARD] == [f"{k}:{own}" for k in range(len(AWKWARD))]


def test_operators_with_rows_of_their_own(spark, awkward):
    import public_tokenizers as P

    n = awkward.count()
    assert packing.pack_documents(awkward, P.path("word_bpe_49k.json")).select("doc_id").count() >= n
    assert toxicity.score(awkward, labels(spark)).count() == n and simhash.near_duplicates(awkward).count() == n
    assert bwt.digest(awkward).count() == n and pii.find(awkward).count() == n
