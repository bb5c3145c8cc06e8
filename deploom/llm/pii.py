"""Personal data: patterns, and terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers.  Beyond them,
corpus co-occurrence estimates how strongly a term reveals that a protected entity is next to it:

    disclosure(t) = log2( P(entity in context | t in document) / P(entity in document) )

with both probabilities counted over all documents.  In the context of an entity, a term with
disclosure of at least ``GENERALISE`` bits is generalised (to what kind of term it is: a number, a
name, a word) and one of at least ``REMOVE`` bits is removed, if it stood beside entities in
``SUPPORT`` documents and mostly stands beside them (``SHARE``).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches, quoted, row_key, ship, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that form its context.
CONTEXT = 5
SUPPORT = 3
SHARE = 0.5
GENERALISE = 2.0
REMOVE = 4.0
#: Terms that a task counts before it passes partial counts on.
TASK_TERMS = 500_000
#: What stands in the place of a span in sanitised text.
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "remove": ""}
#: What a generalised term becomes: the first that its spelling matches.
GENERAL = ((r"^\p{N}", "[NUMBER]"), (r"^\p{Lu}", "[NAME]"), ("", "[WORD]"))

_DIGIT = re.compile("[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
_EDGES = ".,;:!?\"'()[]{}|*%&#$<>=/\\-_+@"


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping addresses, found from each @: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and not _NOT_LOCAL.match(text[begin - 1]):
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base spans, by start and then by kind."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _terms(token: str) -> str:
    return token.strip(_EDGES).lower()


def contexts(text: str, spans) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words within ``CONTEXT`` words of an entity, entities themselves left out; each place once."""
    if not spans:
        return []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    inside, k = [False] * len(words), 0
    marks = [0] * (len(words) + 1)
    ends = 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        while k < len(words) and words[k][1] <= s:
            k += 1
        last = k
        while last < len(words) and words[last][0] < e:
            inside[last] = True
            last += 1
        marks[max(0, k - CONTEXT)] += 1
        ends = min(len(words), last + CONTEXT)
        marks[ends] -= 1
    out, depth = [], 0
    for i, (s, e) in enumerate(words):
        depth += marks[i]
        if depth and not inside[i]:
            raw = text[s:e]
            body = raw.strip(_EDGES)
            if len(body) > 1:
                at = s + raw.index(body)
                out.append((body.lower(), at, at + len(body)))
    return out


def _show(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCANNED = "doc_id long, key binary, row long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<kind:string,s:long,e:long>>, context array<struct<term:string,s:long,e:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and contexts of every document, as a written table.

    ``row`` numbers its rows; ``key`` stands for doc_id and text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(), row_key(docs).alias("key"), F.monotonically_increasing_id().alias("row"))

    def run(b):
        out = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base", "context")}
        for text in b.column(1).to_pylist():
            spans = base_spans(text)
            count = Counter(k for k, _, _ in spans)
            for k in KINDS:
                out["n_" + k].append(count[k])
            out["base"].append([{"kind": k, "s": s, "e": e} for k, s, e in spans])
            out["context"].append([{"term": t, "s": s, "e": e} for t, s, e in contexts(text, spans)])
        return {"doc_id": b.column(0), "key": b.column(2), "row": b.column(3), **out}

    return written(map_batches(rows, run, SCANNED), "pii")


def disclosing_terms(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """term, action: the terms beyond the thresholds, from counts over all documents.

    Documents that hold a term are counted in each task first; only terms that stand in some
    context go on to the sums.
    """
    ship(docs.sparkSession)
    beside = scanned.where(F.size("context") > 0).select(F.explode(F.array_distinct(F.transform("context", lambda c: c["term"]))).alias("term")).groupBy("term").agg(F.count("*").alias("beside")).where(F.col("beside") >= SUPPORT)
    beside = written(beside, "beside")

    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"term": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                held.update({_terms(t) for t in set(text.split())})
            if len(held) > TASK_TERMS:
                yield flush()
        if held:
            yield flush()

    held = docs.select(text_or_empty()).mapInArrow(run, "term string, n long")
    held = held.join(beside.select("term"), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("held"))
    size = scanned.agg(F.count("*").alias("docs"), F.count(F.when(F.size("base") > 0, 1)).alias("with_entity")).first()
    prior = max(1, size["with_entity"]) / max(1, size["docs"])
    share = F.col("beside") / F.col("held")
    bits = F.log2(share / F.lit(prior))
    found = beside.join(held, "term").where((share >= SHARE) & (bits >= GENERALISE))
    return found.select("term", F.when(bits >= REMOVE, "remove").otherwise("general").alias("action"))


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, key, counts, base (spans) and every span found (``all_spans``), sorted.

    Null texts count as empty; an empty table gives no rows; repeated rows give a row each and count
    as documents each; null doc_ids stay null; other columns are not read.
    """
    scanned = scan(docs)
    terms = disclosing_terms(docs, scanned)
    places = scanned.where(F.size("context") > 0).select("row", F.explode("context").alias("c")).select("row", F.col("c.term").alias("term"), F.col("c.s").alias("s"), F.col("c.e").alias("e"))
    extra = places.join(terms, "term").groupBy("row").agg(F.collect_set(F.struct(F.col("action").alias("kind"), "s", "e")).alias("extra"))
    df = scanned.join(extra, "row", "left")
    none = F.expr("cast(array() as array<struct<kind:string,s:bigint,e:bigint>>)")
    rank = F.create_map(*[x for i, k in enumerate((*KINDS, "general", "remove")) for x in (F.lit(k), F.lit(i))])
    spans = F.concat("base", F.coalesce("extra", none))
    ordered = F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), rank[x["kind"]].alias("r"), x["e"].alias("e"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return df.withColumn("all_spans", ordered).drop("extra", "context", "row")


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns; in ``text`` every span is replaced (``PLACEHOLDER``, ``GENERAL``).

    Of overlapping spans the first one's replacement stands for all they cover.  Null texts stay null;
    repeated rows are changed alike; an empty table gives no rows; other columns pass as they are,
    whatever their names.
    """
    names = docs.columns
    key, own, spans = fresh(docs, "key", "own_key", "spans")
    found = find(docs).where(F.size("all_spans") > 0).select(F.col("key").alias(own), F.col("all_spans").alias(spans)).dropDuplicates([own])
    joined = docs.withColumn(key, row_key(docs)).join(found, F.col(key) == F.col(own), "left")
    pieces = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["e"] <= a["at"], a).otherwise(F.struct(x["e"].alias("at"), F.concat(a["out"], _part(a["at"], x["s"]), F.when(x["s"] >= a["at"], _placeholder(x)).otherwise("")).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    changed = F.when(F.col(spans).isNull(), F.col("text")).otherwise(pieces).alias("text")
    return joined.select(*[changed if c == "text" else quoted(c) for c in names])


def _part(begin: Column, end: Column) -> Column:
    return F.substring(F.col("text"), (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))


def _placeholder(x: Column) -> Column:
    out = F.lit("")
    for k, v in PLACEHOLDER.items():
        out = F.when(x["kind"] == k, v).otherwise(out)
    general = F.lit(None).cast("string")
    for pattern, word in reversed(GENERAL):
        general = F.when(F.rlike(_part(x["s"], x["e"]), F.lit(pattern)), word).otherwise(general)
    return F.when(x["kind"] == "general", general).otherwise(out)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("all_spans")).alias("spans"))


def base_digest(text: str | None) -> str:
    return hashlib.sha256(_show(base_spans(text or "")).encode()).hexdigest()
