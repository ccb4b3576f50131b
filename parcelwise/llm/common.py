"""Helpers shared by the text operators: Arrow batches, words, cached chunk encoding."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: Text handled at once inside a batch, in characters; bounds a worker's memory.
BLOCK_CHARS = 8_000_000
#: Entries a worker's cache may hold before it is emptied; only speed depends on it.
CACHE_ENTRIES = 500_000


def blocks(
    batches: Iterator[pa.RecordBatch], block_chars: int = BLOCK_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts; null texts become empty."""
    for batch in batches:
        column, start, size, texts = batch.column("text"), 0, 0, []
        for i in range(batch.num_rows):
            texts.append(column[i].as_py() or "")
            size += len(texts[-1])
            if size >= block_chars:
                yield batch.slice(start, len(texts)), texts
                start, size, texts = i + 1, 0, []
        if texts:
            yield batch.slice(start, len(texts)), texts


def map_texts(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Run `fn(texts, others) -> {column: values}` over blocks of `df`, which has a
    column text. `others` holds the other columns, which the result keeps in front."""
    kept = [c for c in df.columns if c != "text"]
    types = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "text")
    full = ", ".join(x for x in (types, schema) if x)

    def run(batches):
        for part, texts in blocks(batches):
            others = {c: part.column(c) for c in kept}
            made = fn(texts, others)
            yield pa.RecordBatch.from_pydict(others | {k: _array(v) for k, v in made.items()})

    return df.mapInArrow(run, full)


def _array(values):
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)


def words_of(text: str) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


_CUTS = re.compile(r"(?<=\S)(?= )|(?= \S)")
#: White space besides the space and the line break.
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_OTHER = re.compile(rf"[{_RARE}\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _simple(text: str) -> bool:
    """All white space is single spaces and single line breaks."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in _RARE) if text.isascii() else not _OTHER.search(text)


def cut(text: str) -> list[tuple[str, list[str]]]:
    """The lines of a text: what stands before a line's first cut, and the chunks behind
    each cut without the space that each begins with.

    Cuts stand before spaces where no pre-token of the byte-level patterns reaches
    across, so chunks can be encoded one by one: a pre-token takes white space in
    front of it only, and of a longer run only the last space. A line break between two
    other characters is a pre-token of its own. A text with longer runs of white space
    is left as one line and cut outside of them.
    """
    if not _simple(text):
        head, *rest = _CUTS.split(text)
        return [(head, [x[1:] for x in rest])]
    lines = [x.split(" ") for x in text.split("\n")]
    return [(x[0], x[1:]) for x in lines]


_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


class _Known(dict):
    """Ids of chunks, found when first asked for."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.find = find

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = ids = self.find(chunk)
        return ids


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each distinct chunk once.

    A chunk of Latin letters and punctuation behind them is two pre-tokens at most, which
    go to the library's model at once. Other new chunks are encoded as texts.
    """

    PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.entries = entries
        self.line = np.array(self._ids("\n"), "<u4").tobytes()
        self.model = self.tokenizer.model
        # Without a line break white space is dropped: a chunk's ids are the same with a space in front.
        self.heads = _Known(lambda x: self._find("" if self.line else " ", x))
        self.tails = _Known(lambda x: self._find(" ", x))
        self.tails[""] = self._find(" ", "")
        self.marks: dict[str, bytes] = {"": b""}
        # The byte-level alphabet: printable bytes stand for themselves, others follow 255.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in own]
        self.alphabet = {x: 256 + i for i, x in enumerate(rest)}
        self.space = chr(self.alphabet[32])

    def _word(self, before: str, letters: str) -> bytes:
        word = letters if self.line else letters.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        if before and self.line:
            word = self.space + word
        ids = [t.id for t in self.model.tokenize(word)]
        return (_PACK[len(ids)] if len(ids) < len(_PACK) else struct.Struct(f"<{len(ids)}I").pack)(*ids)

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = np.array(self._ids(marks), "<u4").tobytes()
        return self.marks[marks]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _find(self, before: str, chunk: str) -> bytes:
        """The ids of `before + chunk`."""
        if simple := self.PLAIN.fullmatch(chunk):
            return self._word(before, simple[1]) + self._marks(simple[2])
        return np.array(self._ids(before + chunk), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.heads) + len(self.tails) > self.entries:
            for known in (self.heads, self.tails, self.marks):
                known.clear()
            self.heads[""] = self.marks[""] = b""
        head_of, get = self.heads.__getitem__, self.tails.__getitem__
        return [self.line.join([head_of(h) + b"".join(map(get, rest)) for h, rest in cut(x)]) for x in texts]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
