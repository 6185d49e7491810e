"""Odd documents: null and empty texts, null and repeated ids, repeated rows, long texts, columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = "the an er ou st ing ed tion ha re on ti es en ée ß or".split()


def words(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def odd_texts(seed=5, n=60):
    rng = random.Random(seed)
    passage = words(rng, 90)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(n)]
    texts[3] = texts[2]
    texts[4] = texts[2] + " x"
    texts[5] = words(rng, 30) + "\n" + passage + "\n" + words(rng, 20)
    texts[6] = words(rng, 10) + " " + passage
    texts[7] = passage + passage
    texts[8] = "a" * 900
    texts[9] = words(rng, 6000)
    texts[10] = texts[9].replace("ing", "ed", 3)
    texts[11], texts[12], texts[13], texts[14] = None, "", "   \n\n ", "日本語 Ünïcödé 🙂 <|endoftext|> it's  two  spaces\t\ttabs"
    return texts


@pytest.fixture(scope="session")
def odd(spark):
    """(rows of (doc_id, text), DataFrame with clashing extra columns)."""
    texts = odd_texts()
    rows = [(i * 7 % 61 if i != 20 else None, x) for i, x in enumerate(texts)]
    rows += [rows[2], rows[30], rows[30], (rows[15][0], texts[16])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = "part nth key own at run fp score start length fingerprint anchor file words hit items toxic quality level".split()
    return rows, df.select(*[F.lit("x").alias(c) for c in clash], "doc_id", "text").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "text string, doc_id long, part string")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def rows_of():
    return collected
