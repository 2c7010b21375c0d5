"""Small documents with everything that real ones have: nulls, empty and long texts, copies, repeated rows."""

import random

from cinderspark.llm.common import named

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPAN = 40


def texts(seed: int = 4) -> list[tuple]:
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ther", "un", "é", "sa", "ndo", "ри", "qu"]

    def words(n: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))

    passage, base = words(25), words(60)
    near = base.split()
    near[3] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, words(30) + "\n" + passage), (5, passage + " " + words(8)), (6, ""), (7, None),
        (8, "  \t\n "), (9, "one two"), (10, "ONE TWO"), (11, words(3000)), (12, "a" * 500), (13, "12 34 !!"), (14, words(80)), (14, words(80)),
        (15, "x"), (16, "x"), (None, base), (None, None), (17, words(5).upper() + "  \n\n tail <|endoftext|> %%%& $$$"),
    ]
    rows.append(rows[0])
    rows += [(100 + k, words(rng.randint(1, 120))) for k in range(30)]
    sources = ["b", "a", None, "é", "a\tb"]
    langs = ["en", "fr", None]
    return [(i, t, langs[k % 3], sources[k % 5], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(texts() if rows is None else rows, SCHEMA)


def with_clashes(df):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    extra = [
        "ids", "piece", "length", "size", "kept", "removed", "score", "lang_pred", "class", "key", "_text", "_key", "_rest", "_id", "_copies", "_lang",
        "source_size", "target", "taken", "component_id", "group", "a.b", "n", "quota", "label_", "data", "rank",
    ]
    return df.select("*", *[F.lit(7).alias(c) for c in extra if c not in df.columns])


def rows_of(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*[named(c) for c in columns]).collect()), key=repr)
