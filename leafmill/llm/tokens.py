"""Token ids of whole texts, each distinct unit of a batch encoded once.

Both vocabularies cut a text at white space before they merge, so the ids of a text are those of its units in a row. A
unit is a run without white space with the one space before it, or a line feed between two. The units of a batch are
found and numbered by Arrow; those that are frequent a worker keeps with their ids, the others go to the tokenizer; the
ids of the texts are then gathered. Texts with other white space than single spaces and line feeds between words go to
the tokenizer whole.

Most new units are a run of Latin letters, with marks after it or without. Letters are one piece for the vocabulary's
own cutting, and so are the marks; the letters of many units go to the tokenizer's model in one call, past its
normalizer and pattern, which would leave them as they are.
"""

from __future__ import annotations

import json
import re
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import WhitespaceSplit

#: The characters with the Unicode property White_Space beyond ASCII, in UTF-8.
_OTHER_WHITE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_ODD = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\v", b"\f", b"\r")
_TO_SPACE = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))
#: Marks that don't join with letters: those of ASCII but for the apostrophe, which begins contractions.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte-level vocabularies show a byte as a character: itself if printable in Latin-1, else from U+0100 on in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_SPACE, _FEED = SHOWN[32], SHOWN[10]
_here: dict[tuple, WordTokenizer] = {}


class WordTokenizer:
    """drops_space: the vocabulary ignores white space and case, and marks the ends of words.

    special_text: strings of special tokens in a text are text too; without it they become their ids, as is the
    library's default.
    """

    def __init__(self, path: str, drops_space: bool, units: int = 250_000, special_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_text
        self.special = [] if special_text else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_space, self.units = drops_space, units
        #: Units met twice in a batch, and others met of late (up to twice as many), of some ten bytes each.
        self.ids: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        suffix = {"end_of_word_suffix": model["end_of_word_suffix"]} if model.get("end_of_word_suffix") else {}
        self.letters = Tokenizer(BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **suffix))  # words come once
        self.letters.pre_tokenizer = WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        #: Tokens that end (or, with spaces, begin) a unit of letters; the one of a line feed.
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.endswith("</w>") if drops_space else t.startswith(_SPACE))]] = True
        self.feed = vocab.get(_FEED)

    @classmethod
    def of(cls, path: str, drops_space: bool, special_text: bool = False) -> WordTokenizer:
        """One for each worker process."""
        key = (path, drops_space, special_text)
        if key not in _here:
            _here[key] = cls(path, drops_space, special_text=special_text)
        return _here[key]

    @staticmethod
    def drop() -> None:
        """Those of this worker, if it now has tasks of another kind."""
        _here.clear()

    def forget(self) -> None:
        """At the end of a task: the worker may live on for tasks of another kind."""
        for kept in (self.ids, self.recent, self.marks, _here):
            kept.clear()

    def _cut(self, text: bytes) -> bytes | None:
        """Units separated by spaces; None if the text isn't regular. Where spaces count, a unit that doesn't follow one
        has a line feed before it."""
        if not text.isascii() and _OTHER_WHITE.search(text):
            return None
        if self.drops_space:
            return text.translate(_TO_SPACE)
        if text[:1] in (b" ", b"\n") or text[-1:] in (b" ", b"\n") or any(x in text for x in _ODD):
            return None
        return b"\n" + text.replace(b"\n", b" \n\n \n")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _letters(self, words: list[str], spaced: bool, each: int = 100) -> list[bytes]:
        """Words of Latin letters, after a space if spaced."""
        if not words:
            return []
        if self.drops_space:
            words = [w.lower() for w in words]
        words = [w if w.isascii() else w.encode().decode("latin-1").translate(SHOWN) for w in words]
        glue = f" {_SPACE}" if spaced else " " if self.drops_space else f" {_FEED} "
        lines = [glue.join(["", *words[i : i + each]] if spaced else [*words[i : i + each], ""]) for i in range(0, len(words), each)]
        ids = np.fromiter(chain.from_iterable([e.ids for e in self.letters.encode_batch_fast(lines, add_special_tokens=False)]), "<u4")
        data = ids.tobytes()
        if spaced:
            bounds = [*(4 * np.flatnonzero(self.edge[ids])).tolist(), len(data)]
            out = [data[a:b] for a, b in pairwise(bounds)]
        elif self.drops_space:
            bounds = [0, *(4 * np.flatnonzero(self.edge[ids]) + 4).tolist()]
            out = [data[a:b] for a, b in pairwise(bounds)]
        else:
            bounds = [-4, *(4 * np.flatnonzero(ids == self.feed)).tolist()]
            out = [data[a + 4 : b] for a, b in pairwise(bounds)]
        if len(out) != len(words):
            raise ValueError("the vocabulary does not cut words as expected")
        return out

    def learn(self, units: list[str]) -> list[bytes]:
        """The ids of units, those of letters by their parts. A unit is what follows a space; after a line feed, what follows that."""
        out: list[bytes] = [b""] * len(units)
        groups: dict[bool, tuple[list[int], list[str]]] = {False: ([], []), True: ([], [])}
        other: list[int] = []
        tails: list[tuple[int, str]] = []
        spaced = not self.drops_space
        for i, u in enumerate(units):
            first = u[:1] == "\n"
            text = u[1:] if first else u
            word = text.rstrip(_MARKS)
            # Latin letters, without the one that is two characters in lower case
            if word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word)):
                at, words = groups[spaced and not first]
                at.append(i)
                words.append(word)
                if len(word) < len(text):
                    tails.append((i, text[len(word) :]))
            else:
                other.append(i)
        for after, (at, words) in groups.items():
            for i, ids in zip(at, self._letters(words, after), strict=True):
                out[i] = ids
        new = list({m for _, m in tails} - self.marks.keys())
        if len(self.marks) > 10_000:
            self.marks.clear()
            new = list({m for _, m in tails})
        self.marks.update(zip(new, self._whole(new), strict=True))
        for i, m in tails:
            out[i] += self.marks[m]
        plain = [u[1:] if u[:1] == "\n" else f" {u}" if spaced else u for u in (units[i] for i in other)]
        for i, ids in zip(other, self._whole(plain), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self._cut(x) for x in texts]
        regular = [x for x in cut if x is not None]
        odd = iter(self._whole([x.decode() for x, c in zip(texts, cut, strict=True) if c is None]))
        if not regular:
            return list(odd)
        big = b" ".join(regular) + b" "
        ends = np.flatnonzero(np.frombuffer(big, np.uint8) == 32) + 1
        places = np.concatenate([[0], ends]).astype(np.int32)
        numbered = pa.StringArray.from_buffers(len(ends), pa.py_buffer(places), pa.py_buffer(big)).dictionary_encode()
        codes = numbered.indices.to_numpy()
        units = numbered.dictionary.buffers()[2].to_pybytes().decode().split(" ")[:-1]
        ids = list(map(self.ids.get, units))
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            if len(self.recent) > 2 * self.units:
                self.recent.clear()
            rare, new = new, []
            for i in rare:
                ids[i] = x = self.recent.get(units[i])
                if x is None:
                    new.append(i)
            for i, x in zip(new, self.learn([units[i] for i in new]), strict=True):
                ids[i] = self.recent[units[i]] = x
            if len(self.ids) > self.units:
                self.ids.clear()
            often = np.bincount(codes, minlength=len(units)) > 1
            self.ids.update([(units[i], ids[i]) for i in rare if often[i]])
        size = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        start = np.cumsum(size, dtype=np.int32) - size
        each = size[codes]
        upto = np.cumsum(each, dtype=np.int64)
        data = flat[np.arange(int(upto[-1]), dtype=np.int32) + np.repeat(start[codes] - (upto - each).astype(np.int32), each)].tobytes()
        last = 4 * upto[np.searchsorted(ends, np.cumsum([len(x) + 1 for x in regular])) if len(regular) else []]
        bounds = [0, *last.tolist()]
        made = iter([data[a:b] for a, b in pairwise(bounds)])
        return [next(odd) if c is None else next(made) for c in cut]
