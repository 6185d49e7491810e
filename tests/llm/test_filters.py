"""op3, op6, op7, op9 and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import chat, decontamination, features, gam, queries, toxicity


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(rows, items):
    windows = {}
    for name, text in items:
        own = split(text)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add(str(name))
    out = []
    for doc_id, text in rows:
        own, hit, found = split(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if names := windows.get(tuple(own[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def items(odd):
    texts = [x for _, x in odd[0] if x and len(x.split()) > 40]
    cut = [" ".join(re.findall(r"\w+", x)[5:25]).upper() for x in texts[:4]]
    return [(100, cut[0]), (9, cut[0] + " tail"), (10, cut[1]), (10, cut[2]), (11, "日本語"), (12, None), (13, ""), (14, "?!"), (15, "a b c d e f g h i j k l"), (16, "an st"), (17, cut[3])]


def test_op9_contamination(odd, items, spark, rows_of):
    rows, df = odd
    table = spark.createDataFrame(items, "item_id long, text string")
    wanted = sorted(brute_contamination(rows, items), key=repr)
    assert any(x[5] for x in wanted) and not all(x[5] for x in wanted)
    for block in (1 << 20, 60):  # with the second, documents pass through several blocks
        assert rows_of(decontamination.contamination(df, table, block=block)) == wanted
        kept = decontamination.without_contaminated(df, table, block=block)
        assert kept.columns == df.columns
        assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(map(repr, (r for r in df.select("doc_id", "text").collect() if not brute_contamination([r], items)[0][5])))


def test_no_items_and_no_documents(odd, items, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontamination.contamination(odd[1], none).collect()} == {0}
    assert decontamination.without_contaminated(odd[1], none).count() == len(odd[0])
    assert decontamination.contamination(empty, spark.createDataFrame(items, none.schema)).collect() == []


def labelled(spark, n=400):
    """Documents in which two words make a text toxic and symbols make it junk."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        own = ["".join(rng.choices(["an", "er", "ou", "ti", "st"], k=3)) for _ in range(rng.randint(5, 60))]
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            own.insert(rng.randrange(len(own)), rng.choice(["badword", "worseword"]))
        if junk:
            own = [w + "%%%" for w in own]
        rows.append((i, " ".join(own), int(not junk), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return rows, df.select("doc_id", "text", F.lit("x").alias("words")), df.select("doc_id", "quality", "toxic")


def test_op6_chain(spark, odd, empty):
    rows, docs, labels = labelled(spark)
    train = labels.where("doc_id < 300").unionByName(spark.createDataFrame([(None, 1, 1), (1, None, 0), (9999, 0, 1)], labels.schema))
    chain = toxicity.fit(docs, toxicity.label_columns(train))
    assert len(chain.models[1].middle) == len(features.NAMES) + 1  # the later model sees the earlier one's probability
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, chain).collect()}
    right = [(found[i]["toxic"], round(1 - found[i]["p_low_quality"])) == (toxic, quality) for i, _, quality, toxic in rows if i >= 300]
    assert np.mean(right) > 0.95
    kept = toxicity.without_toxic(docs, chain)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["toxic"]}
    assert toxicity.toxicity(odd[1], chain).count() == len(odd[0])
    assert toxicity.toxicity(empty, chain).collect() == []
    for few in (labels.where("doc_id < 0"), labels.where("toxic = 0 and quality = 1")):  # no rows, one class
        assert {r["toxic"] for r in toxicity.toxicity(docs, toxicity.fit(docs, toxicity.label_columns(few))).collect()} == {0}


def test_chain_is_bounded_and_repeatable(spark):
    _, docs, labels = labelled(spark)
    sample = features.sampled(docs, labels, ["toxic"], 50)
    assert sample.count() == 50
    one, two = (toxicity.fit(docs.repartition(n), toxicity.label_columns(labels), bound=200) for n in (1, 5))
    assert all(np.array_equal(a.weights, b.weights) for a, b in zip(one.models, two.models, strict=True))


def test_op7_additive(spark, odd, empty):
    rows, docs, labels = labelled(spark)
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 0).otherwise(F.col("quality")))
    found = {r["doc_id"]: r for r in gam.quality(docs, gam.fit(docs, wrong)).collect()}  # held-out labels play no part
    for i, _, _, _ in rows:
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= found[i]["score"] <= 1 and found[i]["predicted"] == (found[i]["score"] >= 0.5)
    assert np.mean([found[i]["predicted"] == q for i, _, q, _ in rows if found[i]["held_out"]]) > 0.95
    model = gam.fit(docs, labels)
    assert gam.quality(odd[1], model).count() == len(odd[0])
    assert gam.quality(empty, model).collect() == []
    assert {round(r["score"], 6) for r in gam.quality(docs, gam.fit(docs, labels.where("doc_id < 0"))).collect()} == {0.5}


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    label = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    alone, paired = gam.Additive.fit(x, label, pairs=0), gam.Additive.fit(x, label)
    assert np.mean((alone.score(x) > 0.5) == label) < 0.7 < 0.95 < np.mean((paired.score(x) > 0.5) == label)
    assert (1, 0) in paired.pairs
    values, weight = np.array([1.0, 1, -3, -3, 5, 5]), np.full(6, 100.0)
    assert len(set(gam.tree(values, weight, 3))) == 3 and len(set(gam.tree(values, weight, 1))) == 1


CALLS = "conv_id long, call_id string, seq long, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, call_id string, seq long, content string"
SCHEMAS = [("add", "a", "integer", True), ("add", "b", "number", False), ("say", "text", "string", True), ("say", "how", "object", False)]


def chat_rows(spark, calls, results=()):
    frames = spark.createDataFrame(list(calls), CALLS), spark.createDataFrame(list(results), RESULTS)
    return {(r["conv_id"], r["call_id"], r["seq"]): r for r in chat.formatted(*frames, spark.createDataFrame(SCHEMAS, "name string, field string, kind string, required boolean")).collect()}


def test_op3_links_and_checks(spark):
    calls = [
        (1, "x", 0, "add", '{"b": 2.5, "a": 1}', []),
        (1, "y", 1, "add", '{"a": 1.5, "c": {"z":1,"k":[2,{"q":null,"p":true}]}}', ["x", "gone"]),
        (1, "z", 2, "say", '["no"]', ["y"]),
        (2, "x", 0, "say", '{"text": "a\\u00e9\\n\\"", "how": {"b":1,"a":2}}', None),
        (2, "w", 1, "none", "{}", []),
        (2, "v", 2, "say", "not json", []),
        (2, "v", 3, "say", None, []),
        (2, None, 4, "say", "{}", []),
    ]
    results = [(1, "x", 5, "late"), (1, "x", 4, "first"), (1, "q", 6, "lost"), (2, "v", 7, None), (3, "x", 1, "r")]
    found = chat_rows(spark, calls, results)
    assert len(found) == len(calls) + 2
    assert found[1, "x", 0]["json"] == '{"arguments":{"a":1,"b":2.5},"call_id":"x","conv_id":1,"name":"add","result":"first"}'
    assert (found[1, "x", 0]["status"], found[1, "x", 0]["n_results"], found[1, "x", 0]["problems"]) == ("linked", 2, "")
    assert found[1, "y", 1]["problems"] == "kind of a; unknown c"
    assert '"arguments":{"a":1.5,"c":{"k":[2,{"p":true,"q":null}],"z":1}}' in found[1, "y", 1]["json"]
    assert found[1, "z", 2]["problems"] == "no JSON object" and found[1, "z", 2]["status"] == "unanswered"
    assert found[2, "x", 0]["problems"] == "" and '"arguments":{"how":{"a":2,"b":1},"text":"aé\\n\\""}' in found[2, "x", 0]["json"]
    assert found[2, "w", 1]["problems"] == "unknown tool"
    assert '"arguments":"not json"' in found[2, "v", 2]["json"] and found[2, "v", 2]["status"] == "linked" and found[2, "v", 3]["n_results"] == 1
    assert found[2, None, 4]["problems"] == "missing text"
    assert found[1, "q", 6]["status"] == "orphan" and found[3, "x", 1]["json"].endswith('"result":"r"}')
    assert {r["level"] for k, r in found.items() if r["status"] != "orphan"} == {0}


def test_op3_order(spark):
    rng = random.Random(6)
    calls, edges = [], {}
    for conv in range(12):
        n = rng.randint(2, 9)
        place = rng.sample(range(n), n)
        for i in range(n):
            needs = [f"c{j}" for j in range(i) if rng.random() < 0.3]
            edges[conv, f"c{i}"] = needs
            calls.append((conv, f"c{i}", place[i], "add", '{"a":1}', needs))
    calls += [(50, "a", 0, "add", "{}", ["b"]), (50, "b", 1, "add", "{}", ["a"]), (50, "c", 2, "add", "{}", ["b"]), (50, "d", 3, "add", "{}", []), (51, "s", 0, "add", "{}", ["s"])]
    found = {k[:2]: r for k, r in chat_rows(spark, calls).items()}
    assert len(found) == len(calls)
    for (conv, call), needs in edges.items():
        for need in needs:
            before, after = found[conv, need], found[conv, call]
            assert (before["level"], before["seq"]) < (after["level"], after["seq"])
    assert [found[50, x]["level"] for x in "abcd"] == [None, None, None, 0] and found[51, "s"]["level"] is None


def test_op3_long_chains(spark, monkeypatch):
    """One need each: a chain of 300 backward needs takes some ten rounds, not 300; circles and what is behind them have no level."""
    calls = [(1, f"c{i}", i, "add", "{}", [f"c{i + 1}"]) for i in range(300)] + [(1, "c300", 300, "add", "{}", [])]
    calls += [(2, f"c{i}", i, "add", "{}", [f"c{(i + 1) % 40}"]) for i in range(40)] + [(2, "x", 50, "add", "{}", ["c3"]), (2, "y", 51, "add", "{}", ["x"]), (2, "z", 52, "add", "{}", ["gone"])]
    calls += [(3, "a", 0, "add", "{}", ["c"]), (3, "b", 1, "add", "{}", ["a"]), (3, "c", 2, "add", "{}", [])]
    stored = []
    monkeypatch.setattr(chat, "written", lambda df, label, plain=chat.written: (stored.append(label), plain(df, label))[1])
    found = {k[:2]: r["level"] for k, r in chat_rows(spark, calls).items()}
    assert [found[1, f"c{i}"] for i in range(301)] == [300 - i for i in range(301)]
    assert {found[2, f"c{i}"] for i in range(40)} == {None} and (found[2, "x"], found[2, "y"], found[2, "z"]) == (None, None, 0)
    assert [found[3, x] for x in "abc"] == [1, 1, 0] and len(stored) < 30


def test_op3_turns(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 1, "assistant", None), (2, 0, "system", None), (3, 5, "assistant", "x"), (None, 0, "user", "n"), (4, 0, "other", "")]
    rows += [(9, t, "user", f"t{t}") for t in range(0, 400, 2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as level", "1 as name", "2 as seq", "3 as needs")
    tools = spark.createDataFrame(chat.TOOLS, "name string, field string, kind string, required boolean")
    found = {(r["conv_id"], r["call_id"]): r for r in chat.formatted(*chat.turn_calls(turns), tools).collect()}
    assert {k: (r["status"], r["n_results"]) for k, r in found.items() if k[0] != 9} == {(1, "c0"): ("linked", 2), (2, "c0"): ("unanswered", 0), (3, "c4"): ("orphan", 1), (None, "c0"): ("unanswered", 0)}
    kind = {t: zlib.crc32(f"9:{t}".encode()) % 12 for t in range(0, 400, 2)}
    problems = {3: "missing prompt", 4: "kind of turn", 5: "unknown note", 6: "unknown tool"}
    assert {t: found[9, f"c{t}"]["problems"] for t in kind} == {t: problems.get(k, "") for t, k in kind.items()}
    need = {t: None if k < 2 else t + {7: 2, 8: 4, 9: 0}.get(k, -2) for t, k in kind.items()}
    for t in kind:
        at, level, seen = t, 0, set()
        while need.get(at) in kind and at not in seen:
            seen.add(at)
            level, at = level + (need[at] >= at), need[at]
        assert found[9, f"c{t}"]["level"] == (None if at in seen else level)
    assert {r["level"] for k, r in found.items() if k[0] == 9} > {0, 1, None}
    assert chat.formatted(*chat.turn_calls(turns.where("false")), tools).collect() == []


def test_registered(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(queries.ENTRIES) <= set(entry.queries())


def test_pipeline(spark, tmp_path):
    """Each stage against brute force over what the one before has kept."""
    import corpus_pipeline
    from tests.llm.conftest import odd_texts
    from tests.llm.test_duplicates import brute_groups, brute_print, brute_repeats

    rows, docs, labels = labelled(spark)
    rng = random.Random(9)
    texts = odd_texts()
    more = [(1000 + i, x) for i, x in enumerate(texts)]
    item = " ".join(rng.choices(["zulu", "yank", "xray", "whisk", "vault"], k=14))
    more.append((2000, "some words before " + item.upper() + " and after"))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_array", "decontamination", "packing"]
    stages = [docs0 := spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, stages[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        stages.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.columns == docs0.columns for s in stages[1:-1])
    clean, single, cut, fit, packed = ([tuple(r) for r in s.orderBy(s.columns[0]).collect()] for s in stages[1:])
    assert {r[0] for r in clean} >= {r[0] for r in rows if not r[3]} and len({r[0] for r in clean} & {r[0] for r in rows if r[3]}) < 8
    groups = brute_groups([brute_print(r[1] or "") for r in clean])
    assert [r[0] for r in single] == [r[0] for i, r in enumerate(clean) if groups[i] == i]
    masks = brute_repeats([(r[1] or "").encode() for r in single], 200, False)
    assert [len((r[1] or "").encode()) == int((~m).sum()) or not (r[1] or "").isascii() for r, m in zip(cut, masks, strict=True)] == [True] * len(cut)
    assert [r[0] for r in fit] == [r[0] for r in cut if not brute_contamination([r[:2]], [(1, item)])[0][5]]
    assert {r[0] for r in packed} == {r[0] for r in fit} and 2000 not in {r[0] for r in packed}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, whole.drop("sequence_id", "offset").collect())) == sorted(map(repr, stages[-1].drop("sequence_id", "offset").collect()))
    assert Counter(r["sequence_id"] for r in whole.collect()).total() == len(packed)
