"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""
from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def awkward_docs(spark, more=()):
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    texts = {
        0: base, 1: base, 2: " ".join(near), 3: "", 4: None, 5: " \t\n", 6: "One", 7: "one", 8: "Two words", 9: "É é x",
        10: words(5000, 2), 11: words(5000, 2), 12: "same same same same same same", 13: "a b c d", 14: "tab\tand\x0bnew\nlines here",
        15: words(40, 3) + " " + words(40, 4), 16: words(40, 5) + " " + words(40, 4), None: base,
    }
    rows = [(k, t, "en" if (k or 0) % 2 else None, f"s{(k or 0) % 3}" if k != 4 else None, len(t or "")) for k, t in texts.items()]
    rows += [rows[0], rows[0], *more]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same rows with extra columns whose names operators are tempted to use themselves."""
    from pyspark.sql import functions as F

    for name in ("fp", "key", "shard", "slot", "row", "data", "_bucket", "rank", "bucket", "kept", "score", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
