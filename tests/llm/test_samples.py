"""Samples of labelled documents."""

from revlens.llm import features


def test_repeated_ids_leave_the_sample_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(40)] + [(2, "b"), (3, None), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    found = {(r["doc_id"], r["toxic"]): r["text"] for r in features.sampled(docs, labels, ["toxic"], 50).collect()}
    assert features.sampled(docs, labels, ["toxic"], 50).count() == 3 and set(found) == {(1, 1), (2, 0), (3, 1)}
    assert found[2, 0] == "b" and found[3, 1] is None
    assert {r["text"] for n in (1, 7) for r in features.sampled(docs.repartition(n), labels, ["toxic"], 50).where("doc_id = 1").collect()} == {found[1, 1]}
