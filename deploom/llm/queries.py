"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license import oracle as license_oracle
from .merkle import oracle as manifest_oracle


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pfor import token_file

    return token_file(spark, table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_token_blocks, op8_best_fit)}

ORACLES: dict[str, str] = {}


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_fst import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES |= {f.__name__: f for f in (op3_bpe_round_trip, op5_simhash)}


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import scan

    return scan(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op10_license_rules,)}
ORACLES |= {"op10_license_rules": license_oracle()}


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find

    return digest(find(table(spark, sf_dir, "documents")))


QUERIES |= {f.__name__: f for f in (op6_disclosure,)}


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES |= {f.__name__: f for f in (op2_toxicity,)}


def op4_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pq import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_products

    return top_products(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


QUERIES |= {f.__name__: f for f in (op4_product_quantisation, op9_norm_buckets)}

_VALID = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

ORACLES |= {
    "op4_product_quantisation": f"""with recursive v as (select row_number() over () as u, vec_id, embedding::double[] as e, {_VALID} and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok from embeddings),
n as (select u, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v where ok),
l as (select a.u as a, b.u as b, b.vec_id as other from n a, n b where a.u <> b.u and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach as (select a, other, b from l union select r.a, l.other, l.b from reach r join l on l.a = r.b),
small as (select a, min(other) as low from reach group by 1), cnt as (select a, count(*) as n_links from l group by 1)
select vec_id, coalesce(n_links, 0)::bigint as n_links, least(vec_id, low) as component_id, vec_id is not distinct from least(vec_id, low) as kept
from v left join small on small.a = v.u left join cnt on cnt.a = v.u""",
    "op9_norm_buckets": f"""with v as (select row_number() over () as u, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings where {_VALID} and vec_id is not null),
s as (select q.u, q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by u order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""",
}


def op7_shard_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bwt import digest

    return digest(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op7_shard_bwt,)}


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .align import align

    return align(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op13_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quartiles import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op11_merkle_manifest, op12_token_alignment, op13_quartile_digest)}
ORACLES |= {"op11_merkle_manifest": manifest_oracle()}
