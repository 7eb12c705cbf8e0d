import random

from pyspark.sql import functions as F

LETTERS = "abcdefghij"


def words(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(4)
    base = words(rng, 60)
    rows = [
        (1, base, "en", "s1", 10),
        (2, base, "en", "s2", 10),
        (2, base, "en", "s2", 10),
        (3, "", None, None, None),
        (4, None, "en", "s1", 0),
        (5, " \n\t ", "de", "s3", 4),
        (6, base.replace(" ", "\n"), "en", "s1", 10),
        (7, base + " tail", "fr", "s2", 11),
        (8, words(rng, 30_000), "en", "s1", 9),
        (9, "x" * 200_000, "en", "s3", 9),
        (10, "Ünï çødé 漢字 😀 \x00 \x0b z", "en", "s1", 9),
        (None, "no id here", None, "s2", None),
        (None, None, None, None, None),
        (-5, "negative id " + base, "en", "s1", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = "fp key norm digest rank row part score component_id keep_id __id cell copies word class turn idx".split()
    return df.withColumns({c: F.lit(f"clash {c}") for c in clash})


def no_docs(spark):
    return odd_docs(spark).limit(0)
