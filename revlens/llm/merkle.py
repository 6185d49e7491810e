"""Document fingerprints: a Merkle tree of blocks, paragraphs and sections.

A paragraph is a line; it is cut into blocks of at most ``BLOCK`` characters at sentence ends or spaces, so an
edit changes the blocks of one sentence. A section ends with a blank line or with a paragraph whose hash says
so, so an edit does not move the sections behind it. The root is equal only for equal texts; where roots differ,
equal sections are paired first, then paragraphs in the rest, then blocks, and what is left is what was edited.

Written form: root in 32 hex digits, then sections ``/8digits``, in each paragraphs ``:8digits``, in each blocks
``.8digits``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import rows

BLOCK = 40
_BLOCKS = re.compile(rf"[^.!?\n]{{0,{BLOCK}}}[.!?]+\s*|[^.!?\n]{{1,{BLOCK}}}(?:\s|$)|[^.!?\n]{{1,{BLOCK}}}|\n")

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _paragraph(line: str) -> tuple[bytes, tuple[str, list[str]]]:
    leaves = [xxhash.xxh3_128_digest(x) for x in _BLOCKS.findall(line)]
    digest = _digest(b"".join(leaves))
    return digest, (digest[:4].hex(), [x[:4].hex() for x in leaves])


@dataclass
class Tree:
    root: str
    sections: list[tuple[str, list[tuple[str, list[str]]]]]

    @classmethod
    def of(cls, text: str, known: dict[str, tuple] | None = None) -> Tree:
        """``known`` keeps paragraphs, for texts that share lines."""
        known = {} if known is None else known
        sections, paragraphs, above, inside = [], [], [], []

        def close() -> None:
            if paragraphs:
                digest = _digest(b"".join(inside))
                above.append(digest)
                sections.append((digest[:4].hex(), paragraphs.copy()))
                paragraphs.clear()
                inside.clear()

        for line in text.splitlines(keepends=True) if "\n" in text else ([text] if text else []):
            if line not in known:
                known[line] = _paragraph(line)
            digest, paragraph = known[line]
            paragraphs.append(paragraph)
            inside.append(digest)
            if digest[4] % 4 == 0 or not line.strip():
                close()
        close()
        return cls(_digest(b"".join(above)).hex(), sections)

    @classmethod
    def read(cls, written: str) -> Tree:
        root, *sections = written.split("/")
        split = ([p.split(".") for p in s.split(":")[1:]] for s in sections)
        return cls(root, [(s.partition(":")[0], [(p[0], p[1:]) for p in own]) for s, own in zip(sections, split, strict=True)])

    def __str__(self) -> str:
        own = ("/" + s + "".join(":" + p + "".join("." + b for b in blocks) for p, blocks in paragraphs) for s, paragraphs in self.sections)
        return self.root + "".join(own)

    def blocks(self) -> int:
        return sum(len(blocks) for _, paragraphs in self.sections for _, blocks in paragraphs)


def _unpaired(a: list[tuple[str, list]], b: list[tuple[str, list]]) -> tuple[list, list]:
    """Branches of either side that have no equal one on the other."""
    both = Counter(x[0] for x in a) & Counter(x[0] for x in b)
    rest = []
    for side in (a, b):
        left = both.copy()
        own = []
        for branch in side:
            if left[branch[0]] > 0:
                left[branch[0]] -= 1
            else:
                own.append(branch)
        rest.append(own)
    return rest[0], rest[1]


def differing(a: Tree, b: Tree) -> tuple[list[str], list[str]]:
    """Blocks of either text that the other lacks, found below the branches that differ."""
    if a.root == b.root:
        return [], []
    sections = _unpaired(a.sections, b.sections)
    paragraphs = _unpaired(*([p for _, own in side for p in own] for side in sections))
    left, right = (Counter(x for _, own in side for x in own) for side in paragraphs)
    return list((left - right).elements()), list((right - left).elements())


def likeness(a: Tree, b: Tree) -> float:
    """Share of the blocks of both texts that are in both: 1 for equal texts, 0 for none in common."""
    if a.root == b.root:
        return 1.0
    left, right = differing(a, b)
    return 1 - (len(left) + len(right)) / max(1, a.blocks() + b.blocks())


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (doc_id, text, guard) dealt by ranges of doc_id, each range followed by the first row of the next one.

    The last range is followed by the first row of all. Sorted, each row's successor is the row after it.
    """
    spark = docs.sparkSession
    dealt, firsts = rows.in_order(docs, parts)
    full = [p for p, first in enumerate(firsts) if first]
    guards = [(firsts[q][0], p) for p, q in zip(full, [*full[1:], *full[:1]], strict=True)]  # a row for each part
    small = spark.createDataFrame(guards, "first_id long, before int")
    placed = dealt.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    own, copy = F.struct(F.col("part").alias("part"), F.lit(False).alias("guard")), F.struct(F.col("before").alias("part"), F.lit(True).alias("guard"))
    both = placed.select("doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("at"))
    dealt = both.select("doc_id", "text", "at.part", "at.guard")
    return rows.dealt_by_part(dealt, parts).sortWithinPartitions("part", "guard", "doc_id", "text").select("doc_id", "text", "guard")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each document: its tree, the tree of its edited text, and their likeness (see ``SCHEMA``).

    Edited: the last half of the characters gives way to as many from the start of the next document, by
    doc_id and then text; after the last comes the first. Null texts are empty; null ids come first; repeated
    rows follow each other. A lone document is its own next one.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in rows.slices(batches):
            out = []
            for doc_id, text, guard in zip(batch.column(0).to_pylist(), rows.texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if last is None and guard:
                    break
                known: dict[str, tuple] = {}
                tree = Tree.of(text, known)
                if last is not None:
                    out.append(_row(*last, text, tree, known))
                last = None if guard else (doc_id, text, tree, known)
            if out:
                yield rows.batch({f.name: [r[i] for r in out] for i, f in enumerate(SCHEMA)}, SCHEMA)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapped(with_next(rows.id_text(docs), parts or rows.partitions(docs.sparkSession)), made, kinds)


def _row(doc_id: int | None, text: str, tree: Tree, known: dict, following: str, next_tree: Tree, more: dict) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    other = tree if edited == text else Tree.of(edited, {**known, **more})
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(tree), str(other), likeness(tree, other), likeness(tree, next_tree)
