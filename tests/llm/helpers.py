"""Small fixtures: tables with nulls, empty and long texts, ties, repeats, and clashing columns."""

import random

#: Columns named like things the operators make inside, or like their results.
CLASH = "_id string, _text string, _mark string, part string, key string, kept string, score string, component string"
CLASH_VALUES = ("x",) * 8


def clashing(spark, rows, schema):
    """``rows`` under ``schema`` with extra columns whose names clash."""
    return spark.createDataFrame([(*r, *CLASH_VALUES) for r in rows], f"{schema}, {CLASH}")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = [f"{'bcdfglmnprst'[i % 12]}{'aeiou'[i % 5]}{'lmnrst'[i % 6]}{i:x}" for i in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
