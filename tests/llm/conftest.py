import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, bucket int, sequence_id long, words string, shard int, start string, score string, __x int"


def texts():
    """Null, empty, tiny, spaced, long, repeated and near-repeated texts in several scripts."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgio") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + "."
    passage = say(40)
    base = say(120)
    out = [None, "", " ", "a", "  two  spaces \n\n x ", "tab\tand nbsp 　", "don't stop, we'll see 123 4567!", "hé über ß \U0001f600 İI", "<|endoftext|> hidden <|startoftext|>", "x" * 5000]
    out += [base, base, base.replace(words[3], "zzz"), base + " more", passage, say(30) + passage + say(20), "pre " + passage, say(6000)]
    out += ["mail a.b@c.de or x@y now 10.0.0.1 and 999.1.1.1 card 4111 1111 1111 1111 tel +1 (555) 123-4567", "All Rights Reserved. Licensed under CC BY-NC 4.0 cc by cc by", "GNU General Public License, version 3 or any later version; The MIT License"]
    return out + [say(rnd.randint(3, 60)) for _ in range(20)]


@pytest.fixture(scope="session")
def docs(spark):
    t = texts()
    rows = [(i, x, "en", "s", 1, "k", 1, 2, 3, "w", 4, "s", "c", 5) for i, x in enumerate(t)]
    rows += [rows[10], rows[1], (None, "no id " + t[14], None, None, None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 12)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def unique(docs):
    return docs.where("doc_id is not null").dropDuplicates(["doc_id"]).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
