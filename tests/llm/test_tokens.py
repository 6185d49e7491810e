"""op1, op4, op5 against the tokenizers library."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from revlens.llm import bpe, packing, records, tokens  # noqa: E402

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
HARD = ["", " ", "  ", "a  b", "a \n b", "\n\n", "tail ", " head", "it's we'll I'D", "x<|endoftext|>y <|startoftext|>", "\x1f\x1f a", "a\tb\r\nc", "ÀÉ ÑÜ ß ſ İ Ω", "é café", "3.14 2,000", "...!?", "日本 語", "  x", "🙂🙂", "ThThTh" * 50]


def library(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("kind, path", [(tokens.SpacedWords, BYTE), (tokens.LowerWords, WORD)])
def test_words_give_the_ids_of_the_library(kind, path):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choices(["a", "The", " ", "\n", ".", "é", "'s", "12", "\t", "<|endoftext|>", "ß!"], k=rng.randint(1, 40))) for _ in range(400)]
    with open(path, encoding="utf-8") as file:
        found = kind(file.read(), "I")
    assert [np.frombuffer(found.text_ids(x), "<u4").tolist() for x in texts] == library(path, texts)


def test_plain_words_are_kept_once():
    with open(WORD, encoding="utf-8") as file:
        found = tokens.LowerWords(file.read(), "I")
    texts = ["the The THE, the.", "Élan élan élan! it's"]
    got = found.ids(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library(WORD, texts)
    assert {"the", "élan"} <= set(found)
    assert set(found.parts) <= {",", ".", "!"}


def spaced_words(path=BYTE, definition=None):
    if definition is None:
        with open(path, encoding="utf-8") as file:
            definition = file.read()
    return tokens.SpacedWords(definition, "H")


def found_ids(found, texts):
    return [np.frombuffer(x, "<u2").tolist() for x in found.ids(pa.array(texts))]


def test_new_spaced_words_go_to_the_model_together():
    found, alone = spaced_words(), []
    found.merged = lambda text, own=found.merged: alone.append(text) or own(text)
    found.library = lambda text, own=found.library: alone.append(text) or own(text)
    texts = ["the The, the.", "Élan élan! naïve### the$_", "", "it's <|endoftext|> 12"]
    assert found_ids(found, texts) == library(BYTE, texts)
    assert set(alone) == {"", "!", "###", "$_", " 12", " <|endoftext|>", ",", ".", "it's"}
    assert set(found.parts) == {"!", "###", "$_", ",", "."}
    assert {" The", "Élan", " naïve", " naïve###"} <= set(found)


def test_spaced_words_that_are_forgotten_come_back(monkeypatch):
    for name, value in (("KEPT", 60), ("BLOCK", 16), ("TOGETHER", 3)):
        monkeypatch.setattr(tokens, name, value)
    rng = random.Random(5)
    some = ["".join(rng.choices("abtheßé", k=rng.randint(1, 6))) + rng.choice(["", "", ".", "?!", "--", "'s", "7"]) for _ in range(150)]
    texts = [" ".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(60)]
    found = spaced_words()
    for a in range(0, len(texts), 7):
        assert found_ids(found, texts[a : a + 7]) == library(BYTE, texts[a : a + 7])
        assert max(len(found), len(found.old)) <= 60
    assert found.old


def test_arrow_finds_the_white_space_that_python_finds():
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    texts = [f"a{x}{y}b" for x in spaces for y in spaces] + [f"a{x}b" for x in [*spaces, "\u200b", "\ufeff"]]
    assert spaced_words().alone(pa.array(texts)) == [i for i, x in enumerate(texts) if tokens.SPACES.search(x)]


@pytest.mark.parametrize("vocabulary, special", [("ab", None), ("ab", "##"), ("ab", "ab#"), ("", None)])
def test_tokenizers_that_lack_letters_or_take_marks_as_special(vocabulary, special):
    from tokenizers import AddedToken, models, pre_tokenizers

    known = [*vocabulary, *(["ab", tokens.LETTERS[32], "#"] if vocabulary else [])]
    made = Tokenizer(models.BPE({x: i for i, x in enumerate(known)}, [("a", "b")] if vocabulary else []))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    if special:
        made.add_special_tokens([AddedToken(special, normalized=False)])
    texts = ["ab cab abc", "ab## a#, é", " b xx# ab###", "ab", "xyz"]
    wanted = [made.encode(x, add_special_tokens=False).ids for x in texts]
    assert found_ids(spaced_words(definition=made.to_str()), texts) == wanted


def anonymous():
    with open("/proc/self/smaps_rollup") as file:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", file.read())[1]) / 1024


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory cannot be read here")
def test_a_portion_gives_back_what_the_one_before_took():
    portions = tokens.portions(pa.record_batch({"text": ["x" * 20, "y" * 20]}), 0, 16)
    next(portions)
    taken = [np.ones(12_500) for _ in range(1000)]  # 100 KB each: the C library keeps them when they are freed
    last = np.ones(12_500)  # and cannot cut them off, as this one lies behind them
    del taken
    before = anonymous()
    next(portions)
    assert anonymous() < before - 50
    assert len(last) == 12_500


def test_merging_counts_as_the_library():
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choices("abt eTh.\n é'", k=rng.randint(1, 60))) for _ in range(400)]
    with open(BYTE, encoding="utf-8") as file:
        counts = bpe.Counts(file.read())
    assert [counts.text(x) for x in texts] == [len(x) for x in library(BYTE, texts)]


def brute_best_fit(lengths, capacity):
    left = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(left) if room >= length]
        if fitting:
            left[min(fitting, key=left.__getitem__)] -= length
        else:
            left.append(capacity - length)
    return sorted(left)


def test_best_fit_equals_packing_one_by_one():
    rng = random.Random(3)
    for _ in range(100):
        capacity = rng.choice([1, 5, 10, 37, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        ranks, places, filled = set(), set(), Counter()
        for length, rank, many, first, at in packing.best_fit(Counter(lengths), capacity):
            for i in range(many):
                ranks.add((length, rank + i))
                filled[first + i] += length
                own = {(first + i, x) for x in range(at, at + length)}
                assert not own & places
                places |= own
        assert len(ranks) == len(lengths)
        assert sorted(capacity - x for x in filled.values()) == brute_best_fit(lengths, capacity)
        assert all((s, x) in places for s, n in filled.items() for x in range(n))


def test_op1_pieces(odd, rows_of):
    rows, df = odd
    found = packing.pack(packing.pieces(df, WORD, 64), 64)
    wanted = []
    for (doc_id, _), ids in zip(rows, library(WORD, [x or "" for _, x in rows]), strict=True):
        ids = [*ids, 0]
        wanted += [(doc_id, k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert rows_of(found.select("doc_id", "piece", "start", "length", "ids_crc32")) == sorted(wanted, key=repr)
    own = found.select("sequence_id", "offset", "length").collect()
    by = {}
    for r in own:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) == len(brute_best_fit([r["length"] for r in own], 64))


def test_sequences_hold_the_ids(odd):
    made = packing.pieces(odd[1], WORD, 64, with_ids=True)
    total = sum(len(r["ids"]) for r in packing.sequences(packing.pack(made, 64)).collect())
    assert total == sum(r["length"] for r in made.collect())


def test_op4_counts(odd, rows_of):
    rows, df = odd
    wanted = [(i, len((x or "").encode()), len(ids), len(ids) > 100) for (i, x), ids in zip(rows, library(BYTE, [x or "" for _, x in rows]), strict=True)]
    assert rows_of(bpe.token_counts(df, BYTE, 100)) == sorted(wanted, key=repr)


def test_op5_files(odd, tmp_path):
    rows, df = odd
    files = records.write(df, BYTE, folder=str(tmp_path / "out"), parts=3)
    found = sorted(records.read(files, with_ids=True).collect(), key=lambda r: r["nth"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for k, (row, (doc_id, _), ids) in enumerate(zip(found, order, library(BYTE, [x or "" for _, x in order]), strict=True)):
        ids = [*ids, 0]
        assert (row["nth"], row["doc_id"], row["start"], row["n_tokens"], row["ids"]) == (k, doc_id, start, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    shuffled = records.read_shuffled(files, seed=4, parts=2).collect()
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in shuffled) == sorted((repr(r["doc_id"]), r["ids"]) for r in found)
    path = records.file_paths(files)[0]
    data = bytearray(open(path, "rb").read())
    data[30] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(records.unframed(memoryview(bytes(data))))


def test_empty_tables(empty):
    assert packing.pack(packing.pieces(empty, WORD)).collect() == []
    assert bpe.token_counts(empty, BYTE).collect() == []
    assert records.read(records.write(empty, BYTE)).collect() == []


def test_record_folders_with_and_without_a_scheme(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    want = None
    for folder in (str(tmp_path / "a"), f"file:{tmp_path}/b", f"file://{tmp_path}/c"):
        files = records.write(df, BYTE, folder=folder, parts=2)
        assert files.first()["folder"] == "file:" + str(tmp_path / folder[-1])
        found = sorted(map(tuple, records.read(files).drop("file").collect()))
        assert found == (want or found) and len(found) == 2 and all(os.path.exists(x) for x in records.file_paths(files))
        want = found
