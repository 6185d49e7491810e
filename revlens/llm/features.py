"""Numbers that describe a text, for the classifiers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import rows

NAMES = (
    "log_words", "word_length", "distinct_words", "top_word", "doubled_words", "log_lines", "repeated_lines", "line_length",
    "upper", "digits", "spaces", "stops", "marks", "symbols", "bars", "non_ascii", "entropy", "symbol_words",
)

_CLASS = np.zeros(256, "int64")
for _name, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \n\t\r", b".,;:", b"!?", b"#$%&*@^~=+<>\\/_", b"|{}[]", bytes(range(128, 256))), start=1):
    _CLASS[list(_chars)] = _name
_SYMBOLS = tuple("#$%&*@^~=+<>\\/_|!")


def numbers(text: str) -> list[float]:
    """Shares lie in 0..1; an empty text has zeros."""
    words, lines = text.split(), text.split("\n")
    n, counts = max(1, len(words)), Counter(words)
    raw = text.encode()
    size = max(1, len(raw))
    by_byte = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    kinds = np.bincount(_CLASS, weights=by_byte, minlength=9) / size
    share = by_byte[by_byte > 0] / size
    return [
        math.log1p(len(words)),
        len(text) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        math.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        math.log1p(len(text) / len(lines)),
        *kinds[1:9].tolist(),
        float(-(share * np.log2(share)).sum()),
        sum(times for word, times in counts.items() if word.endswith(_SYMBOLS)) / n,
    ]


#: Hash space of words and word beginnings.
SPACE = 1 << 22


def word_hashes(text: str) -> set[int]:
    """The text's words, in lower case and without marks around them, and their first four and five characters, as numbers."""
    words = {w.strip(".,;:!?\"'()") for w in set(text.lower().split())}
    longer = [w for w in words if len(w) > 4]
    found = words | {w[:4] + "\0" for w in longer} | {w[:5] + "\0" for w in longer}
    return {xxhash.xxh32_intdigest(w) % SPACE for w in found}


def sampled(docs: DataFrame, labels: DataFrame, names: list[str], bound: int) -> DataFrame:
    """At most ``bound`` labelled documents, those whose ids hash lowest: doc_id, text, and a label (0 or 1) for each name.

    Labels of an id that occurs more than once: the largest counts. Null ids and labels are left out. Of an id's
    documents the text with the lowest hash is taken, so that the rows are as bounded as the ids.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(n).cast("int").alias(n) for n in names]).dropna()
    one = known.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    found = rows.id_text(docs).join(F.broadcast(one), "doc_id")  # ``bound`` rows of numbers
    return found.groupBy("doc_id", *names).agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("own")).select("doc_id", "own.text", *names)


def described(sample: DataFrame, names: list[str], with_words: bool) -> dict[str, np.ndarray | list]:
    """Numbers, labels and word numbers of a bounded sample, brought to the driver in the order of ids."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            texts = rows.texts(batch.column(1))
            words = [sorted(word_hashes(x)) if with_words else [] for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([numbers(x) for x in texts], pa.list_(pa.float64())), pa.array(words, pa.list_(pa.int32())), *batch.columns[2:]], ["doc_id", "numbers", "words", *names])

    kinds = "doc_id long, numbers array<double>, words array<int>" + "".join(f", {n} int" for n in names)
    table = rows.mapped(sample.select("doc_id", "text", *names), made, kinds).toArrow()
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable") if table.num_rows else np.zeros(0, "int64")
    words = table.column("words").combine_chunks()
    offsets, flat = (words.offsets.to_numpy(), words.values.to_numpy()) if table.num_rows else (np.zeros(1, "int64"), np.zeros(0, "int32"))
    return {
        "doc_id": table.column("doc_id").to_numpy()[order],
        "numbers": np.array([x.as_py() for x in table.column("numbers")], "float64").reshape(-1, len(NAMES))[order],
        "words": [flat[offsets[i] : offsets[i + 1]] for i in order],
        **{n: table.column(n).to_numpy()[order].astype("float64") for n in names},
    }
