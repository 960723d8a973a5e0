"""Word grams as numpy columns, and their sums over a corpus.

Words are numbered where they are met (``Names``, ``Coded``), a gram is a row of word
numbers, and a blob holds some grams with the words they use, so that no
numbering has to be agreed on between tasks: whoever reads blobs numbers
their words anew.  Which part of the corpus-wide table a gram belongs to is
decided by a hash of its words alone (``deal``), and the whole gram counts,
so a word or pair that fills a third of a corpus is spread over all parts.
"""

from __future__ import annotations

import struct

import numpy as np

#: The number of the end mark; number 1 is the empty string between two blanks, which is no word.
END, BLANK = 0, 1
#: Bytes of text split or coded at a time.
CHUNK = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


class Names(dict):
    """Numbers of words in the order they are met."""

    def __init__(self):
        super().__init__({b"\n": END, b"": BLANK})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def number(text: bytes, names: Names) -> list[np.ndarray]:
    """Numbers of the words and end marks of ``text``, where only blanks part words and line feeds are end marks."""
    out, at = [], 0
    while at < len(text):
        to = min(len(text), at + CHUNK)
        if to < len(text):
            cut = max(text.rfind(b" ", at, to), text.rfind(b"\n", at, to))
            if cut < 0:  # a word longer than a chunk
                found = [x for x in (text.find(b" ", to), text.find(b"\n", to)) if x >= 0]
                cut = min(found) if found else len(text) - 1
            to = cut + 1
        tokens = text[at:to].replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(names.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        out.append(ids[ids != BLANK])
        at = to
    return out


class Coded:
    """Texts as numbers of their words in the order they are met, a chunk of text at a time by Arrow; the end mark is ``END``."""

    def __init__(self):
        self.texts, self.size, self.ids, self.words = [], 0, [], []

    def add(self, text: bytes) -> None:
        """Text that ends in an end mark, where only blanks part words and line feeds are end marks."""
        self.texts.append(text)
        self.size += len(text)
        if self.size >= CHUNK:
            self._code()

    def _code(self) -> None:
        text, at = b"".join(self.texts), 0
        self.texts, self.size = [], 0
        while at < len(text):
            to = len(text)
            if to - at > CHUNK:
                cut = max(text.rfind(b" ", at, at + CHUNK), text.rfind(b"\n", at, at + CHUNK))
                if cut < 0:  # a word longer than a chunk
                    cut = min(x for x in (text.find(b" ", at), text.find(b"\n", at)) if x >= 0)
                to = cut + 1
            self._chunk(np.frombuffer(text, dtype=np.uint8, count=to - at, offset=at))
            at = to

    def _chunk(self, text: np.ndarray) -> None:
        import pyarrow as pa

        mark = (text == 0x20) | (text == 0x0A)
        at = np.flatnonzero(mark)
        # Before each mark a word, unless it has no bytes; a line feed is a token itself.
        size = np.diff(at, prepend=-1) - 1
        word, end = size > 0, text[at] == 0x0A
        offsets = np.concatenate([[0], np.cumsum(size[word])]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(text[~mark])]).dictionary_encode()
        place = np.cumsum(word.astype(np.int64) + end) - 1 - end
        ids = np.full(int(word.sum() + end.sum()), END, dtype=np.int32)
        ids[place[word]] = words.indices.to_numpy() + 1
        self.ids.append(ids)
        self.words.append(words.dictionary)

    def done(self) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of all tokens, and the words by number; the end mark is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        self._code()
        met = pa.concat_arrays([pa.array([b""], pa.binary()), *self.words]).dictionary_encode()
        of = met.indices.to_numpy()
        starts = np.cumsum([1] + [len(w) for w in self.words])
        ids = [np.concatenate([of[:1], of[i:j]])[x] for x, i, j in zip(self.ids, starts, starts[1:])]
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(met.dictionary)], met.dictionary), b"\n")[0].as_py()
        return np.concatenate([np.zeros(0, dtype=np.int32), *ids]), text.split(b"\n")


def pack(words: list[bytes], *columns: np.ndarray) -> bytes:
    """Words (without line feeds) and whole-number columns of any lengths, pressed."""
    import zstandard

    text = b"\n".join(words)
    head, body = [struct.pack("<III", len(words), len(text), len(columns))], [text]
    for c in columns:
        lo, hi = (int(c.min()), int(c.max())) if len(c) else (0, 0)
        width = 8 if lo < 0 or hi >= 1 << 32 else 4 if hi >= 1 << 16 else 2 if hi >= 1 << 8 else 1
        head.append(struct.pack("<BI", width, len(c)))
        # Byte planes: the high bytes of small numbers press to nothing.
        body.append(c.astype(f"<{'i' if width == 8 else 'u'}{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return zstandard.ZstdCompressor(level=3, write_content_size=True).compress(b"".join(head + body))


def unpack(blob: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n_words, n_text, n_columns = struct.unpack_from("<III", raw)
    at = 12
    shapes = []
    for _ in range(n_columns):
        shapes.append(struct.unpack_from("<BI", raw, at))
        at += 5
    words = raw[at : at + n_text].split(b"\n") if n_words else []
    at += n_text
    columns = []
    for width, n in shapes:
        planes = np.frombuffer(raw, dtype=np.uint8, count=width * n, offset=at).reshape(width, n)
        columns.append(np.ascontiguousarray(planes.T).view(f"<{'i' if width == 8 else 'u'}{width}").reshape(-1).astype(np.int64))
        at += width * n
    return words, columns


def ascending(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
    """The order of the rows of some columns, first column first, and the rows as single numbers in that order; nothing if they don't fit."""
    n = len(columns[0])
    widths = [int(c.max()).bit_length() if n else 0 for c in columns]
    if sum(widths) > 63:
        return None
    key = columns[0].astype(np.int64)
    for c, width in zip(columns[1:], widths[1:]):
        key <<= width
        key |= c
    places = n.bit_length()
    if sum(widths) + places > 63:
        order = np.argsort(key)
        return order, key[order]
    # Sorted with their places in the low bits: numpy sorts numbers several times as fast as it sorts places by number.
    key <<= places
    key |= np.arange(n)
    key.sort()
    return key & ((1 << places) - 1), key >> places


class Distinct:
    """The distinct rows of some columns, in ascending order."""

    def __init__(self, columns: list[np.ndarray]):
        n = len(columns[0])
        found = ascending(columns)
        if found is not None:
            self.order, key = found
            new = key[1:] != key[:-1]
        else:
            self.order = np.lexsort(columns[::-1])
            new = np.zeros(max(n - 1, 0), dtype=bool)
            for c in columns:
                c = c[self.order]
                new |= c[1:] != c[:-1]
        self.starts = np.concatenate([np.zeros(min(n, 1), dtype=np.int64), np.flatnonzero(new) + 1])
        first = self.order[self.starts]
        self.columns = [c[first].astype(np.int64) for c in columns]

    def __len__(self) -> int:
        return len(self.starts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each distinct row the sum of its rows' values."""
        return np.add.reduceat(values[self.order], self.starts) if len(self.starts) else np.zeros(0, dtype=values.dtype)

    def inverse(self) -> np.ndarray:
        """For each row the place of its distinct row."""
        out = np.empty(len(self.order), dtype=np.int64)
        sizes = np.diff(np.append(self.starts, len(self.order)))
        out[self.order] = np.repeat(np.arange(len(self.starts)), sizes)
        return out


def hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


class Dealt:
    """Grams by the part of the corpus-wide table that holds them.

    Columns number words: within a task, with the hash of each word in
    ``word_hashes``, or corpus-wide, where the numbers themselves are hashed.
    """

    def __init__(self, columns: list[np.ndarray], word_hashes: np.ndarray | None, parts: int):
        h = np.full(len(columns[0]), len(columns), dtype=np.uint64)
        for c in columns:
            h = h * _MIX[0] + (c.astype(np.uint64) if word_hashes is None else word_hashes[c])
            h ^= h >> np.uint64(29)
            h *= _MIX[1]
            h ^= h >> np.uint64(32)
        part = (h % np.uint64(parts)).astype(np.int64)
        # Grams come in ascending order of numbers within the task; corpus-wide numbers are put in order here, to press well.
        found = ascending([part, columns[0]]) if word_hashes is None else None
        self.order = found[0] if found else np.argsort(part, kind="stable") if word_hashes is not None else np.lexsort((columns[0], part))
        self.columns = columns
        self.bounds = np.searchsorted(part[self.order], np.arange(parts + 1))

    def blobs(self, words: list[bytes] | None, *values: np.ndarray):
        """(part, blob of its grams, with their words if these are given, and their values) of every part that has some."""
        for p in range(len(self.bounds) - 1):
            rows = self.order[self.bounds[p] : self.bounds[p + 1]]
            if not len(rows):
                continue
            columns, used = [c[rows] for c in self.columns], []
            if words is not None:
                used, local = np.unique(np.concatenate(columns), return_inverse=True)
                columns, used = np.split(local.reshape(-1), len(columns)), [words[k] for k in used.tolist()]
            yield p, pack(used, *columns, *[v[rows] for v in values])

    def placed(self, answers: list[np.ndarray], dtype=np.int64) -> np.ndarray:
        """Answers of the parts, in ascending order of the part, put back to the grams' own order."""
        out = np.empty(len(self.order), dtype=dtype)
        out[self.order] = np.concatenate(answers) if answers else np.zeros(0, dtype=dtype)
        return out


def merge(blobs: list[bytes], keys: int) -> tuple[Names, list[np.ndarray], list[int]]:
    """Columns of all blobs, their first ``keys`` columns in one numbering, and the rows of each blob.

    The end mark's word is the line feed, which no blob can hold: it travels as the empty string.
    """
    names, found = Names(), []
    for blob in blobs:
        words, columns = unpack(blob)
        ids = np.fromiter((names[w] if w else END for w in words), dtype=np.int64, count=len(words))
        found.append([ids[c] for c in columns[:keys]] + columns[keys:])
    columns = [np.concatenate(c) for c in zip(*found)]
    return names, columns, [len(f[0]) for f in found]


def spelled(names: Names) -> list[bytes]:
    """Words by number; the end mark and the blank are empty."""
    words = list(names)
    words[END] = b""
    return words
