"""Scores of the classifiers against plain loops over one text at a time, odd and very long texts included."""

import math
import random

from revlens.llm import features, gam, toxicity
from tests.llm.conftest import words
from tests.llm.test_filters import labelled


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def logit(p):
    p = max(1e-4, min(1 - 1e-4, p))
    return math.log(p / (1 - p))


def texts_with_long_ones(docs, odd):
    rng = random.Random(1)
    long = words(rng, 30_000)
    return [*(r["text"] for r in docs.select("text").limit(40).collect()), *(x for _, x in odd[0]), long, "x" * 500_000, "- " * 100_000]


def scalar_chain(chain, text):
    own, out = features.word_hashes(text or ""), []
    for model in chain.models:
        weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
        total = model.base + sum(weight.get(w, 0.0) for w in own)
        more = [*features.numbers(text or ""), *map(logit, out)]
        for x, middle, scale, other in zip(more, model.middle.tolist(), model.scale.tolist(), model.other.tolist(), strict=True):
            total += max(-4.0, min(4.0, (x - middle) / scale)) * other
        out.append(sigmoid(total))
    return out


def test_op6_scores(spark, odd):
    _, docs, labels = labelled(spark)
    chain = toxicity.fit(docs, toxicity.label_columns(labels), bound=250)
    assert len(chain.models) == 2 and len(chain.models[1].other) == len(features.NAMES) + 1 and any(chain.models[1].other)
    texts = texts_with_long_ones(docs, odd)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in toxicity.toxicity(df, chain).collect():
        low, toxic = scalar_chain(chain, texts[r["doc_id"]])
        assert abs(r["p_low_quality"] - low) < 1e-9 and abs(r["p_toxic"] - toxic) < 1e-9 and r["toxic"] == (toxic >= 0.5)


def entry(cuts, x):
    return sum(c <= x for c in cuts.tolist())


def scalar_sum(model, text):
    own = [entry(cuts, x) for cuts, x in zip(model.cuts, features.numbers(text or ""), strict=True)]
    total = model.base + sum(float(table[b]) for table, b in zip(model.tables, own, strict=True))
    return sigmoid(total + sum(float(table[own[i]][own[j]]) for (i, j), table in zip(model.pairs, model.pair_tables, strict=True)))


def test_op7_scores(spark, odd):
    _, docs, labels = labelled(spark)
    model = gam.fit(docs, labels)
    assert model.pairs
    texts = texts_with_long_ones(docs, odd)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in gam.quality(df, model).collect():
        want = scalar_sum(model, texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == gam.held_out(r["doc_id"])
