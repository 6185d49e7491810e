"""Token counts by byte-pair merging, without token ids.

A word starts as its bytes in a linked list; a heap holds the adjacent pairs that can merge, lowest rank first
and leftmost among equals. Each merge joins two symbols, so the count is the bytes minus the merges.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from revlens.llm import rows, tokens

LIMIT = 512

#: Fixed value: how byte-level tokenizers of this kind split text before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


class Merges:
    """The merge table of a byte-level tokenizer file: pair of symbols -> (rank, joined symbol)."""

    def __init__(self, definition: str):
        file = json.loads(definition)
        vocab = file["model"]["vocab"]
        self.bytes = [vocab[tokens.LETTERS[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        special = [t["content"] for t in file["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def count(self, word: bytes) -> int:
        pairs, symbol = self.pairs, [self.bytes[b] for b in word]
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*found, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (found := pairs.get((symbol[i], symbol[i + 1])))]
        heap = [(rank, i, left, right, joined) for rank, joined, i, left, right in heap]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has merged meanwhile
            merges += 1
            symbol[i], symbol[j] = joined, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get((joined, symbol[k])):
                    heapq.heappush(heap, (found[0], i, joined, symbol[k], found[1]))
            h = before[i]
            if h >= 0 and (found := pairs.get((symbol[h], joined))):
                heapq.heappush(heap, (found[0], h, symbol[h], joined, found[1]))
        return n - merges


class Counts(dict):
    """Word -> number of tokens, for words that end where the pattern always splits."""

    def __init__(self, definition: str):
        super().__init__()
        self.merges, self.split, self.parts = Merges(definition), regex.compile(PATTERN), {}

    def part(self, text: str) -> int:
        found = self.parts.get(text)
        if found is None:
            if len(self.parts) >= tokens.KEPT:
                self.parts.clear()
            found = self.parts[text] = self.merges.count(text.encode())
        return found

    def __missing__(self, word: str) -> int:
        if len(self) >= tokens.KEPT:
            self.clear()
        if plain := tokens.PLAIN.fullmatch(word):
            found = self.part(plain[1] + plain[2]) + (self.part(plain[3]) if plain[3] else 0)
        else:
            found = self.whole(word)
        self[word] = found
        return found

    def whole(self, text: str) -> int:
        """Any text: special tokens count one each, what lies between is split by the pattern."""
        special = self.merges.special
        pieces = special.split(text) if special else [text]
        return sum(1 if i % 2 else sum(map(self.part, self.split.findall(piece))) for i, piece in enumerate(pieces))

    def text(self, text: str) -> int:
        if tokens.SPACES.search(text):
            return self.whole(text)
        return sum(map(self.__getitem__, tokens.spaced(text)))


_KEPT: dict[int, Counts] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_tokens, over_limit.

    Null text is empty and has no token. Repeated rows and null ids give a row each. Only doc_id and text are read.
    """
    definition = tokens.vocabulary(docs.sparkSession, tokenizer)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(definition.value)
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = Counts(definition.value)
        counts = _KEPT[key]
        for batch in rows.slices(batches):
            texts = rows.texts(batch.column(1))
            n = [counts.text(x) for x in texts]
            sizes = [len(x) if x.isascii() else len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=COUNTS)

    return rows.mapped(rows.id_text(docs), counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
