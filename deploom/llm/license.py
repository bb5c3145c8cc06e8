"""Licence scan by ordered signature rules, in built-in column functions only.

Words are normalised to one blank on each side, so that a pattern spelled with its blanks matches
whole words and neighbouring matches share nothing.  A keyword prefilter decides whether a document
is looked at again, and which rules it is held against.  Detections are word intervals; one that lies
inside another of a better tier, or of its own tier and longer, is suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import rules

#: Phrases whose places are counted as they stand, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(pattern: str) -> str:
    """A pattern over single-spaced words, for text in which every word has a blank on each side."""
    return " " + pattern.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?") + " "


def keywords() -> list[str]:
    """The prefilter: every rule's keyword, but for those that contain another."""
    every = sorted({r[3] for r in rules()} | {p.split(" ")[0] for p, _ in BASE}, key=lambda k: (len(k), k))
    kept: list[str] = []
    for k in every:
        if not any(x in k for x in kept):
            kept.append(k)
    return kept


def _blanks(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


#: Numbers that one fold collects: a fold copies what it has collected at every step.
HELD = 256


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: inside a lambda an expression is worked out at every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(numbers: Column, zero: int, combine) -> Column:
    """For each of an array of numbers, all before it combined; in blocks, so that time grows with their number."""
    start = F.lit(zero).cast("bigint")

    def running(items: Column, first: Column) -> Column:
        state = F.struct(first.alias("at"), F.expr("cast(array() as array<bigint>)").alias("got"))
        return F.aggregate(items, state, lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["got"], F.array(a["at"])).alias("got")), lambda a: a["got"])

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, start, combine))
        return _let(running(totals, start), lambda firsts: F.flatten(F.transform(blocks, lambda b, i: running(b, F.get(firsts, i)))))

    cut = lambda items: F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / HELD).cast("int")), lambda b: F.slice(items, b * HELD + 1, HELD))
    return _let(numbers, lambda items: F.when(F.size(items) > 0, _let(cut(items), over)).otherwise(F.expr("cast(array() as array<bigint>)")))


def _places(words: Column, pattern: Column) -> Column:
    """Word intervals (s, e inclusive) of a pattern's matches, by the blanks before and inside each."""
    half = lambda c: (_blanks(c) / 2).cast("bigint")

    def sizes(found: Column) -> Column:
        pairs = F.filter(F.arrays_zip(F.split(words, pattern).alias("gap"), found.alias("found")), lambda x: x["found"].isNotNull())
        return F.transform(pairs, lambda x: F.struct(half(x["gap"]).alias("gap"), half(x["found"]).alias("found")))

    def placed(n: Column) -> Column:
        before = _before(F.transform(n, lambda x: x["gap"] + x["found"]), 0, lambda a, b: a + b)
        return F.transform(F.arrays_zip(n.alias("n"), before.alias("before")), lambda x: F.struct((x["before"] + x["n"]["gap"]).alias("s"), (x["before"] + x["n"]["gap"] + x["n"]["found"] - 1).alias("e")))

    none = F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")
    # most patterns that are tried have no match: the text is not split for them
    return _let(F.regexp_extract_all(words, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, _let(sizes(found), placed)).otherwise(none))


def _kept(hits: Column, tiers: int) -> Column:
    """Hits that lie in no other one of a better tier, nor of their own tier that is longer or an earlier rule's.

    In order of their starts, longer ones first, what may hold a hit stands before it: it is held if
    the farthest end of its own and better tiers so far is not before its own.
    """
    order = F.array_sort(F.transform(hits, lambda h: F.struct(h["s"].alias("s"), (-h["e"]).alias("back"), h["tier"].alias("tier"), h["id"].alias("id"), h["label"].alias("label"))))

    def free(rows: Column) -> Column:
        far = [_before(F.transform(rows, lambda h: F.when(h["tier"] <= t, -h["back"]).otherwise(F.lit(-1).cast("bigint"))), -1, lambda a, b: F.greatest(a, b)).alias(f"far{t}") for t in range(tiers)]  # noqa: B023
        held = lambda x: F.coalesce(*[F.when(x["h"]["tier"] == t, x[f"far{t}"] >= -x["h"]["back"]) for t in range(tiers)])
        left = F.filter(F.arrays_zip(rows.alias("h"), *far), lambda x: ~held(x))
        return F.transform(left, lambda x: F.struct(x["h"]["tier"].alias("tier"), x["h"]["id"].alias("id"), x["h"]["s"].alias("s"), (-x["h"]["back"]).alias("e"), x["h"]["label"].alias("label")))

    return _let(order, free)


_HIT = "struct<tier:int,id:int,s:bigint,e:bigint,label:string>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the share of words inside kept detections, each word once (no words: 0).  Null texts count
    as empty; repeated rows give a row each; null doc_ids stay null; an empty table gives no rows;
    other columns are not read.  The plan is one narrow stage; a text's time grows with its length
    and its hits, but for sorting these.
    """
    numbered = rules()
    table = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(tier).alias("tier"), F.lit(keyword).alias("keyword"), F.lit(spaced(pattern)).alias("pattern")) for i, label, tier, keyword, pattern in numbered])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.trim(F.regexp_replace(text, SEPARATORS, " ")).alias("words"))
    df = df.withColumn("n_words", F.when(F.col("words") == "", 0).otherwise(_blanks(F.col("words")) + 1).cast("long"))
    df = df.withColumn("low", F.lower("words"))
    gate = F.lit(False)
    for k in keywords():
        gate = gate | F.contains(F.col("low"), F.lit(k))
    words = F.concat(F.lit(" "), F.replace(F.translate("words", _UPPER, _SMALL), F.lit(" "), F.lit("  ")), F.lit(" "))
    df = df.select("doc_id", "n_words", F.when(gate, words).alias("words"))
    base = F.filter(F.array(*[F.struct(F.lit(label).alias("label"), _places(F.col("words"), F.lit(spaced(p))).alias("at")) for p, label in BASE]), lambda x: F.size(x["at"]) > 0)
    hits = F.flatten(F.transform(F.filter(table, lambda r: F.contains(F.col("words"), r["keyword"])), lambda r: F.transform(_places(F.col("words"), r["pattern"]), lambda p: F.struct(r["tier"].alias("tier"), r["id"].alias("id"), p["s"].alias("s"), p["e"].alias("e"), r["label"].alias("label")))))
    some = F.col("words").isNotNull()
    df = df.select("doc_id", "n_words", F.when(some, base).alias("base"), F.when(some, hits).alias("hits"))

    kept = _kept(F.col("hits"), max(tier for _, _, tier, _, _ in numbered) + 1)
    df = df.select("doc_id", "n_words", "base", F.when(F.size("hits") > 0, kept).alias("kept"))
    starts = F.flatten(F.transform("base", lambda x: F.transform(x["at"], lambda p: p["s"])))
    df = df.select("doc_id", "n_words", "base", "kept", starts.alias("starts"))
    labels = F.transform("base", lambda x: x["label"])
    none = F.expr("cast(array() as array<string>)")
    spans = F.array_sort(F.transform(F.coalesce("kept", F.expr(f"cast(array() as array<{_HIT}>)")), lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e"))))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(spans, start, lambda a, h: F.struct(F.greatest(a["end"], h["e"] + 1).alias("end"), (a["n"] + F.greatest(F.lit(0).cast("long"), h["e"] + 1 - F.greatest(a["end"], h["s"]))).alias("n")), lambda a: a["n"])
    return df.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.coalesce(F.array_join(F.array_sort(labels), ","), F.lit("")).alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce(labels, none), F.coalesce(F.transform("kept", lambda h: h["label"]), none)))), ",").alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(0.0).alias("score"),
    )


def oracle() -> str:
    """The same scan as DuckDB SQL over ``documents``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {q(label)}, {tier}, {q(keyword)}, {q(spaced(p))})" for i, label, tier, keyword, p in rules())
    base = ", ".join(f"({q(label)}, {q(spaced(p))})" for p, label in BASE)
    places = """select {key}, doc_id, n, s, s + len(list_filter(string_split(m, ' '), lambda x: x <> '')) - 1 as e from (
  select {key}, doc_id, m, i as n, coalesce(list_sum(list_transform(list_concat(gaps[1:i], found[1:i - 1]), lambda x: (len(x) - len(replace(x, ' ', ''))) // 2)), 0)::bigint as s
  from (select {key}, doc_id, found, gaps, unnest(found) as m, unnest(range(1, len(found) + 1)) as i from (
    select {key}, doc_id, regexp_extract_all(words, pattern) as found, regexp_split_to_array(words, pattern) as gaps from {source})))"""
    return f"""with rules(id, label, tier, keyword, pattern) as (values {values}), base(label, pattern) as (values {base}),
docs as (select row_number() over () as u, doc_id, trim(regexp_replace(coalesce(text, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') as w from documents),
norm as (select u as doc_id, doc_id as shown, case when w = '' then 0 else len(w) - len(replace(w, ' ', '')) + 1 end::bigint as n_words,
  ' ' || replace(translate(w, '{_UPPER}', '{_SMALL}'), ' ', '  ') || ' ' as words from docs),
base_hits as ({places.format(key="label", source="norm, base")}),
hits as ({places.format(key="id, tier, label", source="(select * from norm, rules where contains(words, keyword)) t")}),
kept as (select * from hits h where not exists (select 1 from hits g where g.doc_id = h.doc_id and g.s <= h.s and g.e >= h.e
  and (g.tier < h.tier or (g.tier = h.tier and (g.e - g.s > h.e - h.s or (g.s = h.s and g.e = h.e and g.id < h.id)))))),
b as (select doc_id, count(*) as n_base, min(s) as first_word, max(s) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base_hits group by 1),
k as (select doc_id, count(distinct p) as covered from (select doc_id, unnest(range(s, e + 1)) as p from kept) group by 1),
l as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from base_hits union select doc_id, label from kept) group by 1)
select shown as doc_id, n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when n_words > 0 then coalesce(covered, 0)::double / n_words else 0.0::double end as score
from norm left join b using (doc_id) left join k using (doc_id) left join l using (doc_id)"""
