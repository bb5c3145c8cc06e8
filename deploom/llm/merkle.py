"""Merkle manifest of a table: a tree per language, proofs and folds, with the upper tree broadcast.

Leaves stand in order of doc_id.  Blocks of ``ARITY ** DEPTH`` consecutive leaves are reduced where
they are; the block roots are the leaves of the same kind of tree, and are reduced in the same way
until at most ``TOP`` nodes are left in all.  The driver builds the tree over those, up to the
languages' roots and over them to the root, and broadcasts the rest of the proof of each of its
leaves.  Executors then go down again: a block's tasks rebuild its levels, put each row's siblings
before the rest that its block was given, and fold the row.

A digest is lowercase hex text throughout, 64 bytes.
"""

from __future__ import annotations

import functools
import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, shuffle_partitions, written

ARITY = 8
#: Levels that one block takes together: 4,096 leaves, some 600 kB.
DEPTH = 4
#: Most nodes of the tree that the driver builds; more are reduced by executors first.
TOP = 4096

DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*parts: Column) -> Column:
    """H of fields: each ``-`` if null, else its length in bytes, a colon and the value."""
    shown = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*shown), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and the tampered row's leaf (null: not tampered); texts are read here and nowhere else."""
    rows = docs.select(*[F.col(c).cast("long" if c == "doc_id" else "string").alias(c) for c in FIELDS])
    named = [F.col(c).cast("string") for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(chosen, digest_of(*named[:-1], lower_ascii(F.col("text"))))
    return rows.select("doc_id", "lang", digest_of(*named).alias("leaf"), changed.alias("tampered"))


def numbered(nodes: DataFrame) -> DataFrame:
    """Leaves with ``pos``, their place in their language by doc_id (nulls first) and leaf, and ``size``, its leaves.

    Rows are dealt by ranges of (lang, doc_id, leaf), so a language of any size is spread; rows that
    agree in all three are the same leaf and may change places.
    """
    salted = nodes.withColumn("salt", F.rand(11))
    dealt = salted.repartitionByRange(shuffle_partitions(nodes.sparkSession), "lang", "doc_id", "leaf", "salt").sortWithinPartitions("lang", "doc_id", "leaf")
    placed = written(dealt.select(*nodes.columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "leaves")
    runs = placed.groupBy("lang", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    whole = Window.partitionBy("lang")
    runs = runs.select(F.col("lang").alias("run_lang"), F.col("part").alias("run_part"), (F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"), "first", F.sum("n").over(whole).alias("size"))
    joined = placed.join(runs, F.col("lang").eqNullSafe(F.col("run_lang")) & (F.col("part") == F.col("run_part")))
    return joined.select(*nodes.columns, (F.coalesce("before", F.lit(0)) + F.col("place") - F.col("first")).alias("pos"), "size")


def parents(level: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(b"".join(level[i : i + ARITY])).hexdigest().encode() for i in range(0, len(level), ARITY)]


def levels(nodes: list[bytes], most: int | None = None) -> list[list[bytes]]:
    """The levels above ``nodes``, themselves first, until one node or ``most`` steps."""
    out = [nodes]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        out.append(parents(out[-1]))
    return out


def steps(size: int) -> int:
    """Levels above ``size`` leaves."""
    n = 0
    while size > 1:
        size, n = -(-size // ARITY), n + 1
    return n


# A proof is bytes: for each level the node's place in its run, the number of its siblings, and their digests.
def proofs(tree: list[list[bytes]], rest: list[bytes]) -> list[bytes]:
    """The proof of each node of tree[0]; ``rest`` holds those of the nodes of the last level."""
    for level in reversed(tree[:-1]):
        out = []
        for i in range(0, len(level), ARITY):
            run, above = level[i : i + ARITY], rest[i // ARITY]
            for k in range(len(run)):
                out.append(bytes((k, len(run) - 1)) + b"".join(run[:k]) + b"".join(run[k + 1 :]) + above)
        rest = out
    return rest


def unpack(proof: bytes) -> list[tuple[bytes, bytes]]:
    """A proof as (digests to the left, digests to the right) of each level."""
    out, at = [], 0
    while at < len(proof):
        place, others = proof[at], proof[at + 1]
        middle, end = at + 2 + DIGEST * place, at + 2 + DIGEST * others
        out.append((proof[at + 2 : middle], proof[middle:end]))
        at = end
    return out


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its siblings give."""
    for left, right in path:
        node = hashlib.sha256(left + node + right).hexdigest().encode()
    return node


def siblings_hash(path: list[tuple[bytes, bytes]]) -> str:
    return hashlib.sha256(b"".join(x for pair in path for x in pair)).hexdigest()


def _split(digests: bytes) -> list[bytes]:
    return [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]


def blocks(nodes: DataFrame, name: str, depth: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per (lang, block): ``digests`` of its nodes in order, ``root``, the nodes in its language's level (``size``), and arrays of the ``extra`` columns."""
    held = F.array_sort(F.collect_list(F.struct("pos", "leaf", *extra)))
    rows = nodes.groupBy("lang", F.floor(F.col("pos") / ARITY**depth).cast("long").alias("block")).agg(held.alias("held"), F.first("size").alias("size"))
    rows = rows.select("lang", "block", "size", F.array_join("held.leaf", "").alias("digests"), *[F.col(f"held.{c}").alias(c) for c in extra])
    ship(nodes.sparkSession)

    @F.pandas_udf("string")
    def root_of(digests: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([levels(_split(d.encode()), min(depth, steps(n)))[-1][0].decode() for d, n in zip(digests, size)], dtype=object)

    return written(rows.withColumn("root", root_of("digests", "size")), name)


def _roots(level: DataFrame, depth: int) -> DataFrame:
    """A level's block roots as the nodes of the level above."""
    return level.select("lang", F.col("block").alias("pos"), F.col("root").alias("leaf"), F.ceil(F.col("size") / ARITY**depth).cast("long").alias("size"))


def driver_tree(nodes: list[tuple[str | None, int, str]]) -> tuple[bytes | None, dict]:
    """(lang, place, digest) of every node left -> root, and for each (lang, place) its language's root and the rest of its proof."""
    langs: dict = {}
    for lang, place, digest in nodes:
        langs.setdefault(lang, []).append((place, digest.encode()))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([d for _, d in sorted(langs[x])]) for x in order}
    upper = levels([trees[x][-1][0] for x in order]) if order else [[None]]
    above = proofs(upper, [b""]) if order else []
    out = {}
    for x, over in zip(order, above):
        for place, proof in enumerate(proofs(trees[x], [over])):
            out[x, place] = trees[x][-1][0].decode(), proof
    return upper[-1][0], out


ROWS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
RESTS = "lang string, block long, subroot string, rest binary"


def manifest(docs: DataFrame, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Null fields enter a leaf as ``-``.  Null doc_ids stand first in their language and are never
    tampered with; equal doc_ids stand by their leaves, so repeated rows are leaves side by side with
    one digest and proofs of their own.  A null language is a language, the first.  One leaf alone is
    its language's root, one language's root the root.  An empty table gives no rows.  Columns other
    than ``FIELDS`` are not read.
    """
    base = blocks(numbered(leaves(docs)), "merkle0", depth, ("doc_id", "tampered"))
    stack, count = [base], base.count()
    while count > top:
        nodes = _roots(stack[-1], depth)
        if nodes.where("size > 1").isEmpty():
            rests, root = _many_languages(nodes, depth, top)
            break
        stack.append(blocks(nodes, f"merkle{len(stack)}", depth))
        count = stack[-1].count()
    else:
        rests, root = _top(stack[-1])
    rests = _descend(stack, rests, depth)
    rows = _with_rest(base.select("size", "digests", "doc_id", "tampered", "lang", "block"), rests)
    rows = rows.select("size", "digests", "doc_id", "tampered", "subroot", "rest")
    return rows.mapInArrow(functools.partial(_fold_rows, root, depth), ROWS)


def _top(level: DataFrame) -> tuple[DataFrame, bytes | None]:
    """The driver's tree over a level's roots, TOP at most: the rest of each one's proof, to be broadcast, and the root."""
    root, tails = driver_tree([tuple(r) for r in level.select("lang", "block", "root").collect()])
    return F.broadcast(level.sparkSession.createDataFrame([(*k, *v) for k, v in tails.items()], RESTS)), root


def _many_languages(nodes: DataFrame, depth: int, top: int) -> tuple[DataFrame, bytes | None]:
    """More languages than the driver's tree may have leaves: their roots are the leaves of one more tree of the same kind."""
    from ..plans.numbering import in_order

    ranked = written(in_order(nodes.select("lang", "leaf"), ["lang"], "pos").withColumn("pos", F.col("pos") - 1), "languages")
    level = ranked.select(F.lit("").alias("lang"), "pos", "leaf", F.lit(ranked.count()).cast("long").alias("size"))
    stack = [blocks(level, "languages0", depth)]
    while stack[-1].count() > top:
        stack.append(blocks(_roots(stack[-1], depth), f"languages{len(stack)}", depth))
    rests, root = _top(stack[-1])
    # the rests of that tree's own leaves
    rests = _descend([None, *stack], rests, depth)
    own = ranked.select(F.col("lang").alias("own"), F.col("leaf").alias("own_root"), "pos")
    found = own.join(rests, own["pos"] == rests["block"])
    return found.select(F.col("own").alias("lang"), F.lit(0).cast("long").alias("block"), F.col("own_root").alias("subroot"), "rest"), root


def _descend(stack: list, rests: DataFrame, depth: int) -> DataFrame:
    """Rests of the proofs of the lowest blocks from those of the highest: each level's blocks hand theirs down."""
    for over in reversed(stack[1:]):
        rests = _with_rest(over.select("lang", "block", "size", "digests"), rests).mapInArrow(functools.partial(_hand_down, depth), RESTS)
    return rests


def _hand_down(depth: int, batches):
    import pyarrow as pa

    for b in batches:
        for lang, block, size, digests, subroot, rest in zip(*(b.column(i).to_pylist() for i in range(6))):
            nodes, first = _split(digests.encode()), block * ARITY**depth
            got = proofs(levels(nodes, min(depth, steps(size))), [rest])
            n = len(nodes)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * n, pa.string()), "block": pa.array(range(first, first + n), pa.int64()), "subroot": pa.array([subroot] * n, pa.string()), "rest": pa.array(got, pa.binary())})


def _with_rest(rows: DataFrame, rests: DataFrame) -> DataFrame:
    r = rests.select(F.col("lang").alias("rest_lang"), F.col("block").alias("rest_block"), "subroot", "rest")
    return rows.join(r, rows["lang"].eqNullSafe(r["rest_lang"]) & (rows["block"] == r["rest_block"])).select(*rows.columns, "subroot", "rest")


def _fold_rows(root: bytes | None, depth: int, batches):
    import pyarrow as pa

    for b in batches:
        for k in range(b.num_rows):
            size, digests, ids, tampered, subroot, rest = (b.column(i)[k].as_py() for i in range(6))
            tree = levels(_split(digests.encode()), min(depth, steps(size)))
            shown, folded = [], []
            for leaf, other, proof in zip(tree[0], tampered, proofs(tree, [rest])):
                path = unpack(proof)
                shown.append(siblings_hash(path))
                folded.append(fold(other.encode() if other else leaf, path))
            n = len(ids)
            out = {"doc_id": pa.array(ids, pa.int64()), "leaf": [x.decode() for x in tree[0]], "subroot": [subroot] * n, "root": [root.decode()] * n, "proof_sha256": shown, "folded_root": [x.decode() for x in folded], "verified": [x == root for x in folded]}
            yield pa.RecordBatch.from_pydict(out)


def oracle() -> str:
    """The same in DuckDB: trees level by level, proofs by going up from every leaf."""
    shown = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in FIELDS)
    changed = shown.replace("text::varchar", "low")
    crc = "list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"
    return f"""with recursive d as (select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, doc_id is not null and (4294967295 - {crc}) % 3 = 0 as chosen from documents),
l as (select doc_id, lang, sha256({shown}) as leaf, case when chosen then sha256({changed}) end as tampered from d),
n as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as size, dense_rank() over (order by lang nulls first) - 1 as tree from l),
up as (select tree, 0 as level, pos, size, leaf as digest from n
 union all select tree, level + 1, pos // {ARITY}, (size + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' order by pos)) from up where size > 1 group by tree, level, pos // {ARITY}, size),
subroots as (select tree, digest as subroot from up where size = 1),
over_ as (select 0 as level, tree as pos, (select count(*) from subroots) as size, subroot as digest from subroots
 union all select level + 1, pos // {ARITY}, (size + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' order by pos)) from over_ where size > 1 group by level, pos // {ARITY}, size),
runs as (select tree, level, pos // {ARITY} as run, list(digest order by pos) as held from up where size > 1 group by all union all select -1, level, pos // {ARITY}, list(digest order by pos) from over_ where size > 1 group by all),
way as (select tree as own, pos as spot, tree, 0 as level, pos, size, coalesce(tampered, leaf) as node, '' as proof from n
 union all select own, spot, case when w.size = 1 then -1 else w.tree end, case when w.size = 1 then 0 else w.level + 1 end, case when w.size = 1 then w.own else w.pos // {ARITY} end,
  case when w.size = 1 then (select count(*) from subroots) else (w.size + {ARITY - 1}) // {ARITY} end,
  case when w.size = 1 then node else sha256(array_to_string(r.held[:w.pos % {ARITY}] || [node] || r.held[w.pos % {ARITY} + 2:], '')) end,
  case when w.size = 1 then proof else proof || array_to_string(r.held[:w.pos % {ARITY}] || r.held[w.pos % {ARITY} + 2:], '') end
 from way w left join runs r on r.tree = w.tree and r.level = w.level and r.run = w.pos // {ARITY} where w.tree >= 0 or w.size > 1)
select n.doc_id, n.leaf, s.subroot, o.digest as root, sha256(w.proof) as proof_sha256, w.node as folded_root, w.node = o.digest as verified
from n join subroots s using (tree) join way w on w.own = n.tree and w.spot = n.pos and w.tree = -1 and w.size = 1, (select digest from over_ where size = 1) o"""
