"""Token ids of whole texts, with the ids of frequent pieces remembered.

A byte-pair vocabulary splits a text into words before it merges bytes, and
no word reaches over the cut between a word and the single space or line
break that follows it.  So a text is cut there, each distinct piece is
encoded once, and the ids are joined.  A text with any other white space (runs
of spaces, a space at an end, tabs), or with the text of a special token,
which the library reads as that token, is encoded whole.  A vocabulary of
lower-case words gets A-Z lower-cased first, as it does itself.

Pieces not met before are encoded many at a time: words of letters alone in
one string, whose ids are parted by the tokens that begin or end a word, and a
word with one punctuation mark behind it from the ids of both.  What is
remembered is bounded in bytes: of two generations the older one goes when the
younger is full, so frequent pieces stay.  A piece met once in a batch of texts
is not remembered: such pieces are most of all, and would drive others out.
"""

from __future__ import annotations

import os

import numpy as np

#: Bytes that a generation of remembered pieces may hold, by the sizes of Python objects.
REMEMBERED = 32 << 20
_PUNCTUATION = frozenset(".,;:!?")
#: A dict entry, a string and a bytes object without their characters.
_ENTRY = 190


def _plain(text: str) -> bool:
    """White space only as single spaces and line breaks between words."""
    return not (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text
    ) and text.replace("\n", "").isprintable()


class Encoder:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    ``keeps_spaces``: the vocabulary writes a word's leading space into its
    first id; else white space carries no id and words end with a mark.
    """

    def __init__(self, path: str, keeps_spaces: bool, remembered: int = REMEMBERED):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.keeps_spaces, self.limit = keeps_spaces, remembered
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        vocabulary = self.model.get_vocab()
        mark = "Ġ" if keeps_spaces else json.loads(self.model.to_str())["model"].get("end_of_word_suffix") or ""
        #: Ids that begin (with the space) or end (with the mark) a word.
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if mark:
            self.edge[[k for t, k in vocabulary.items() if (t.startswith(mark) if keeps_spaces else t.endswith(mark))]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def _remember(self, piece: str, ids: bytes) -> None:
        self.young[piece] = ids
        self.size += _ENTRY + len(piece) + len(ids)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def _any(self, pieces: list[str]) -> list[bytes]:
        """One call for many pieces: each is a word of its own, which its ids name."""
        out = []
        for k in range(0, len(pieces), 20_000):
            part = pieces[k : k + 20_000]
            e = self.model.encode(part, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(e.ids, dtype="<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array(e.word_ids, dtype=np.int64), np.arange(len(part) + 1))).tolist()
            out += [raw[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def _letters(self, pieces: list[str]) -> list[bytes]:
        """Words of letters: one word of the vocabulary's splitting each, so as many edges as pieces."""
        out = []
        for k in range(0, len(pieces), 20_000):
            part = pieces[k : k + 20_000]
            ids = np.array(self.model.encode_batch_fast([("" if self.keeps_spaces else " ").join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.edge[ids])
            if len(at) != len(part):  # a letter whose lower case holds a mark
                out += self._any(part)
                continue
            cuts = (4 * (np.append(at, len(ids)) if self.keeps_spaces else np.append(0, at + 1))).tolist()
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def _learn(self, pieces: list[str], often: list[bool]) -> list[bytes]:
        """Ids of pieces that the younger generation lacks; those of the older one and those met ``often`` are remembered in it."""
        found = list(map(self.old.get, pieces))
        new = [p for p, x in zip(pieces, found) if x is None]
        # A mark stands apart from a letter before it, if the letter's lower case ends with a letter.
        marked = [p for p in new if len(p) > 1 and p[-1] in _PUNCTUATION and p[-2].lower()[-1].isalpha()]
        need = set(new).difference(marked)
        need.update([p[:-1] for p in marked])
        need.update({p[-1] for p in marked})
        fresh = {w: x for w in need if (x := self.young.get(w)) is not None} if marked else {}
        need.difference_update(fresh)
        first, edges = 1 if self.keeps_spaces else 0, bool(self.edge.any())
        letters, other = [], []
        for w in need:
            (letters if edges and w[first:].isalpha() and (not first or w[0] == " ") else other).append(w)
        fresh.update(zip(letters, self._letters(letters)))
        fresh.update(zip(other, self._any(other)))
        for p in marked:
            fresh[p] = fresh[p[:-1]] + fresh[p[-1]]
        out = [fresh[p] if x is None else x for p, x in zip(pieces, found)]
        for p, ids, x, keep in zip(pieces, out, found, often):
            if keep or x is not None:
                self._remember(p, ids)
        return out

    def _pieces(self, texts: list[str]):
        """Pieces of plain texts in one Arrow array, and where each text's begin."""
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pa.array(texts, type=pa.large_string())
        if self.keeps_spaces:
            rows = pc.replace_substring(pc.replace_substring(rows, "\n", "\0\n\0"), " ", "\0 ")
        else:
            rows = pc.replace_substring(rows, "\n", " ")
        cut = pc.split_pattern(rows, "\0" if self.keeps_spaces else " ")
        return cut.flatten(), cut.offsets.to_numpy()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        out, plain, odd = [b""] * len(texts), [], []
        for k, t in enumerate(texts):
            if t:
                # Bytes are lower-cased in A-Z alone.
                low = t if self.keeps_spaces else t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                (plain if _plain(t) and not any(s in low for s in self.special) else odd).append((k, low))
        for (k, _), ids in zip(odd, self._encode([texts[k] for k, _ in odd])):
            out[k] = ids
        if not plain:
            return out
        import pyarrow as pa

        words, bounds = self._pieces([t for _, t in plain])
        coded = words.dictionary_encode()
        pieces, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        known = list(map(self.young.get, pieces))
        gaps = [k for k, x in enumerate(known) if x is None]
        again = np.bincount(at, minlength=len(pieces)) > 1
        asked = [k for k in gaps if pieces[k]]
        for k in gaps:
            known[k] = b""
        for k, x in zip(asked, self._learn([pieces[k] for k in asked], again[asked].tolist())):
            known[k] = x
        coded = pa.array(known, type=pa.large_binary()).take(coded.indices)
        raw = coded.buffers()[2].to_pybytes() if len(coded) else b""
        cuts = np.frombuffer(coded.buffers()[1], dtype=np.int64)[bounds].tolist()
        for (k, _), i, j in zip(plain, cuts, cuts[1:]):
            out[k] = raw[i:j]
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_spaces: bool) -> Encoder:
    """The worker's encoder; one of another vocabulary goes."""
    if (path, keeps_spaces) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, keeps_spaces] = Encoder(path, keeps_spaces)
    return _ENCODERS[path, keeps_spaces]


def forget() -> None:
    """Drop the worker's encoder: other operators call this where their tasks begin, since Spark hands workers on."""
    _ENCODERS.clear()
