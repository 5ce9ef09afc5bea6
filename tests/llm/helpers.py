"""Small tables with what the operators must stand: nulls, empty and very long texts, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp0 long, size long, row_mark long, copies int, shard int, h long, keep_id long, before long, node long"
WORDS = "ba do ki lu ma ne po ra si tu ve wo xa ye zi".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None, 0.5, 1, 2, 3, 4, 5, 6, 7, 8, 9)


def odd(spark, extra=()):
    """Documents of every odd kind, and extra rows (doc_id, text)."""
    rng = random.Random(5)
    long_text = words(rng, 60_000)
    rows = [row(1, None), row(2, ""), row(3, " \n\t"), row(4, long_text, None, None), row(5, "same text of a few words"), row(6, "same text of a few words"), row(6, "same text of a few words"), row(None, "no id at all", None, "b"), row(8, "Ünïcödé ß 漢字 \U0001f600"), row(9, "1234 !!")]
    rows += [row(*x) for x in extra]
    return spark.createDataFrame(rows, SCHEMA), rows


def none(spark):
    return spark.createDataFrame([], SCHEMA)
