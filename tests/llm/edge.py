"""Small tables with nulls, empty and very long texts, ties, repeated rows and columns whose names clash with those of results."""

import random

WORDS = "the of and a to in ist und der que la de è été mañana straße 東京 🙂 x".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def documents(spark, seed=0, n=60, partitions=5):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice((1, 3, 30, 200, 900))), "en", f"src{rng.randrange(4)}", 0, "a", "b") for i in range(n)]
    long, base = prose(rng, 40_000), prose(rng, 300)
    rows += [(1000, None, None, None, None, None, None), (1001, "", "en", "src0", 0, "", ""), (1002, " \n\t ", "en", "src0", 0, "", ""), (None, "no id here at all", "en", None, 0, "", ""), (1003, long, "en", "src1", 0, "", "")]
    rows += [(1004 + k, base, "en", "src2", 0, "", "") for k in range(12)] + [(1100, base + " one more word", "en", "src2", 0, "", "")] + [(1200, "twice the same row", "en", "src3", 0, "", "")] * 3
    rng.shuffle(rows)
    shape = "doc_id long, text string, lang string, source string, n_chars long, score string, slot string"
    return spark.createDataFrame(rows, shape).repartition(partitions)


def empty(spark, df):
    return spark.createDataFrame([], df.schema)


def plain(df):
    return [r.asDict() for r in df.collect()]
