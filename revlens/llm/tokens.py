"""Token ids of whole texts by a public tokenizer file, each distinct word encoded once for each worker.

White space never joins a token with what lies before it, so a text falls into words that are encoded
alone; a word that was seen before is a dictionary look-up. Arrow parts the texts of a batch into words and
numbers the different ones, so that each is looked up once for a batch, and strings their ids together. Words
that are new are encoded by the library many at a time: its model gets them as one text.
"""

from __future__ import annotations

import ctypes
import os
import re
from array import array
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Words a worker keeps before it starts anew; the ones it had stay until the next time, and come back when met.
KEPT = 300_000
ENDS = ".,;:!?"
MARK = "\x1f"
SPACES = re.compile(r"\s\s|\x1f")
#: The same for Arrow, whose white space is ASCII's alone.
_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ARROW_SPACES = rf"{_SPACE}{_SPACE}|\x{{1f}}"
#: Letters whose lower case and composed form are themselves, with what may follow a word.
PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: Letters, then ASCII marks but the apostrophe: byte-level tokenizers part such a word there and nowhere else.
MARKED = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: What can lie inside of such a word.
INSIDE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]*[!-&(-/:-@\[-`{-~]*")
NEVER = re.compile("(?!)")
#: Words looked up at a time, and encoded as one text.
BLOCK, TOGETHER = 1 << 16, 64


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The text of a tokenizer file, some MB."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write each byte as one printable character: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()


def lettered(text: str) -> str:
    if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
        return LETTERS[32] + text[1:] if text[0] == " " else text
    return text.encode().decode("latin-1").translate(LETTERS)


class Words(dict):
    """Word -> its ids as bytes. ``text_ids`` gives those of a text."""

    def __init__(self, definition: str, code: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.model, self.code, self.parts, self.old, self.old_parts = self.tokenizer.model, code, {}, {}, {}

    def library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, text: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(lettered(text))]).tobytes()

    def part(self, text: str) -> bytes:
        """Ids of what the tokenizer's pattern keeps together."""
        found = self.parts.get(text)
        if found is None:
            found = self.old_parts.get(text)
            if found is None:
                found = self.merged(text)
            if len(self.parts) >= KEPT:
                self.old_parts, self.parts = self.parts, {}
            self.parts[text] = found
        return found

    def made(self, word: str) -> bytes:
        raise NotImplementedError

    def text_ids(self, text: str) -> bytes:
        raise NotImplementedError

    def parted(self, texts: pa.Array) -> pa.ListArray:
        """Texts as lists of words."""
        raise NotImplementedError

    def alone(self, texts: pa.Array) -> list[int]:
        """Places of the texts that are not parted into words."""
        return []

    def looked(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words."""
        return [self[w] for w in words]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """``text_ids`` of each text, empty for a null."""
        whole = pc.fill_null(texts, "")
        alone = self.alone(whole)
        if alone:
            mask = np.ones(len(whole), bool)
            mask[alone] = False
            own = {i: self.text_ids(whole[i].as_py()) for i in alone}
            rest = iter(self._strung(whole.filter(pa.array(mask))))
            return [own[i] if i in own else next(rest) for i in range(len(whole))]
        return self._strung(whole)

    def _strung(self, texts: pa.Array) -> list[bytes]:
        parts = self.parted(texts)
        words = parts.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each
        ids = pa.array(self.looked(different), pa.large_binary()).take(words.indices)
        _, offsets, data = ids.buffers()
        places = np.frombuffer(offsets, "<i8")[parts.offsets.to_numpy() - parts.offsets[0].as_py()] if len(ids) else np.zeros(len(texts) + 1, int)
        data = data.to_pybytes() if data is not None else b""
        return [data[a:b] for a, b in pairwise(places.tolist())]

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.made(word)
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class LowerWords(Words):
    """Tokenizers that lower-case and drop white space (word_bpe)."""

    def made(self, word: str) -> bytes:
        bare = word.rstrip(ENDS)
        ends = word[len(bare) :]
        if not (bare.isascii() and bare.isalpha()):
            plain = PLAIN.fullmatch(word)
            if not plain:
                return self.library(word)
            bare = plain[2]
        low = bare.lower()
        own = self.merged(low) if low == word else self[low]  # a word of its own, so that it is kept once
        return own + self.part(ends) if ends else own

    def text_ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def parted(self, texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


class SpacedWords(Words):
    """Byte-level tokenizers that keep a space with the word after it (byte_bpe)."""

    def __init__(self, definition: str, code: str):
        super().__init__(definition, code)
        from tokenizers import Tokenizer, pre_tokenizers

        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(LETTERS[10])
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, "i4")
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = NEVER if any(map(INSIDE.fullmatch, special)) else MARKED

    def __missing__(self, word: str) -> bytes:
        return self.looked([word])[0]

    def looked(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), BLOCK):
            some = words[at : at + BLOCK]
            found = list(map(self.get, some))
            if new := [w for w, ids in zip(some, found, strict=True) if ids is None]:
                made = self.learned(new)
                found = [made[w] if ids is None else ids for w, ids in zip(some, found, strict=True)]
            out += found
        return out

    def learned(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new words, and of those among them without the marks behind them; all are kept."""
        made, new, marked = {}, {}, []
        for word in words:
            ids = self.old.get(word)
            if ids is not None:
                made[word] = ids
            elif not (plain := self.plain.fullmatch(word)):
                made[word] = self.library(word)
            elif plain[2]:
                marked.append((word, *plain.groups()))
            else:
                new[word] = None
        for _, bare, _ in marked:
            if bare not in made and bare not in self:
                if bare in self.old:
                    made[bare] = self.old[bare]
                else:
                    new[bare] = None
        made.update(zip(new, self.together(list(new)), strict=True))
        for word, bare, marks in marked:
            made[word] = (made[bare] if bare in made else self[bare]) + self.part(marks)
        if len(self) + len(made) > KEPT:
            self.old = dict(self)
            self.clear()
        self.update(made)
        return made

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of words the pattern keeps whole. The model gets many as one text; as a token is as long as its letters,
        their sizes tell where the next word's begin."""
        if not words:
            return []
        letters = lettered("\n".join(words)).split(LETTERS[10])
        texts = [LETTERS[10].join(letters[a : a + TOGETHER]) for a in range(0, len(letters), TOGETHER)]
        encoded = self.bare.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in encoded), self.code)
        ends = np.cumsum(list(map(len, letters)))
        reached = np.cumsum(self.sizes[ids])
        if not np.isin(ends, reached).all():  # a vocabulary that lacks letters leaves these out
            return list(map(self.merged, words))
        cuts, data = np.searchsorted(reached, ends, side="right"), ids.tobytes()
        return [data[a:b] for a, b in pairwise([0, *(cuts * ids.itemsize).tolist()])]

    def text_ids(self, text: str) -> bytes:
        if SPACES.search(text):  # runs of white space are split by rules of their own
            return self.library(text)
        return b"".join(self.looked(spaced(text)))

    def alone(self, texts: pa.Array) -> list[int]:
        return pc.indices_nonzero(pc.match_substring_regex(texts, ARROW_SPACES)).to_pylist()

    def parted(self, texts: pa.Array) -> pa.ListArray:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
        return pc.split_pattern(marked, MARK)


def spaced(text: str) -> list[str]:
    """Words with the space before them, and line breaks alone, of a text without runs of white space."""
    return text.replace(" ", MARK + " ").replace("\n", f"{MARK}\n{MARK}").split(MARK)


def portions(batch: pa.RecordBatch, column: int, size: int = 1 << 21):
    """Slices of a batch with some MB of text each; what one has taken goes back before the next."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    part = np.cumsum(sizes, dtype="i8") // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in pairwise(cuts):
        if b > a:
            yield batch.slice(a, b - a)
            give_back()


def give_back() -> None:
    """Return to the machine what Arrow and the C library keep of memory that is free; a worker's size is what it holds."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


#: glibc's; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_KEPT: dict[tuple, Words] = {}


def forget() -> None:
    """Give back the memory of the worker's dictionaries, for tasks that need none."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def words(kind: type[Words], vocabulary: Broadcast, code: str) -> Words:
    """The worker's dictionary, kept from task to task."""
    definition = vocabulary.value
    key = (kind, code, hash(definition))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = kind(definition, code)
    return _KEPT[key]
