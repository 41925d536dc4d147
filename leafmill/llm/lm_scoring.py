"""Language-model scores by online logistic context mixing.

A text is coded byte by byte, then an end, each symbol as the bits of its path in a binary tree (Huffman's, of the
corpus's counts of symbols after the byte before). Three predictors give each bit's probability from hashed contexts:
the two, three and five bytes before. How often a bit was 0 and 1 is counted over all training documents, for each context and node of the
tree apart. For each document a mixer, gated by the bit's depth in the tree, adds the predictors' logits with weights
that follow the errors made so far, and a second stage refines the sum by what came true at like sums. Both learn as
the document goes, after each stretch of 64 bytes, however long it is, so that the probability of a bit depends on
what is before it alone, and the bits' sum is the code length of the text. The weights start from a step of Newton's
method on the bits of all training documents: each home adds up gradient and curvature over its distinct symbols in
context, as often as its training documents have them.

The texts of a batch are scored side by side, all bits of a stretch at once. What is gathered from the corpus grows
with it: each home (see homes.py) sends its distinct words, and its distinct symbols in context, with their counts, in as
many buckets of hashes as there are homes. Each bucket is added up by itself, and tells each home the counts of the
words and the logits of the paths that it has sent. A word or context that every document has costs a home one key.
The blobs of keys are homes times buckets in number, like the blocks of any shuffle of as many parts.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import U64, SpanHash, byte_texts, fold, mix, open_folder, put_file, runs, shared_folder, word_hashes
from leafmill.llm.homes import read_home, settle, text_slices
from leafmill.llm.tables import saved

FOLDS, HELD_OUT = 7, 2
HOME_BYTES = 12 << 20
HOMES_A_TASK = 4
END = 256
#: Bytes of context of each predictor.
ORDERS = (2, 3, 5)
PREDICTORS = len(ORDERS)
#: A key is the context's hash, its predictor's number, the byte before (NONE: none) and the symbol's place in its tree.
HASH_BITS, ORDER_BITS, RANK_BITS = 43, 2, 9
KEY_BITS = HASH_BITS + ORDER_BITS + 2 * RANK_BITS
NONE, SYMBOLS = 256, 257
#: An odd number; its multiples spread the keys of one context, modulo 2^64.
SPIN = U64(0x9E3779B97F4A7C15)
#: Logits are kept in steps of 1/10, the mixer's sum is looked up in steps of 1/64 up to +-LIMIT.
STEP, FINE, LIMIT = 10.0, 64, 12
GATES = 8
#: Symbols between two updates of a text's weights and refinement.
STRIDE = 64
#: Texts, and bytes of them, that are scored side by side.
SIDE_TEXTS, SIDE_BYTES = 256, 2 << 20
#: Bits whose evidence is added up at once.
EVIDENCE_BITS = 1 << 17
#: Where the step to the first weights begins, and how far it may lead.
START, START_RANGE = 0.45, (-1.0, 2.0)
#: LAG: how many bits the refinement's first guess counts for.
RATE, LAG, BUCKETS = 0.004, 16, 24
HOMES = "home long, learned long, pairs array<int>, counts array<long>"
ANSWERS = "home long, bucket long, words long, known long, data binary"
_HOMES = pa.schema([("home", pa.int64()), ("learned", pa.int64()), ("pairs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
_ANSWERS = pa.schema([("home", pa.int64()), ("bucket", pa.int64()), ("words", pa.int64()), ("known", pa.int64()), ("data", pa.binary())])
#: Head of a blob: two numbers of entries and the size of the first part.
_HEAD, _HEAD_SIZE = "<QQQ", 24


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n times, for each."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each symbol the (node, bit) of its path; counts of zero count as one in 65,536."""
    floor = max(1, int(counts.sum()) >> 16)
    serial = count()
    heap = [(max(c, floor), next(serial), s) for s, c in enumerate(counts.tolist())]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        node = SYMBOLS + len(children)
        children[node] = (x, y)
        heapq.heappush(heap, (a + b, next(serial), node))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(SYMBOLS)]
    todo = [(heap[0][2], [])]
    while todo:
        node, path = todo.pop()
        if node < SYMBOLS:
            paths[node] = path
        else:
            todo += [(child, [*path, (node, bit)]) for bit, child in enumerate(children[node])]
    return paths


class Tree:
    """Paths of the symbols after each byte before. A cell is byte before * SYMBOLS + symbol; counts has one for each."""

    def __init__(self, counts: np.ndarray):
        every = [path for row in counts.reshape(SYMBOLS, SYMBOLS) for path in huffman(row)]
        self.lens = np.array([len(x) for x in every], np.uint8)
        #: Node and bit of each cell at each depth.
        self.inner = np.zeros((int(self.lens.max()), len(every)), np.int16)
        self.bits = np.zeros(self.inner.shape, np.uint8)
        for j in range(len(self.inner)):
            at = np.flatnonzero(self.lens > j)
            self.inner[j, at], self.bits[j, at] = np.array([every[i][j] for i in at.tolist()]).T
        #: The symbols from left to right, so that those below a node are neighbours, and the place of each.
        left = [int.from_bytes(np.packbits(np.pad(self.bits[: n, i], (0, 64 - n))).tobytes(), "big") for i, n in enumerate(self.lens.tolist())]
        self.leaves = np.argsort(np.array(left, np.uint64).reshape(SYMBOLS, SYMBOLS), axis=1).astype(np.uint16).reshape(-1)
        self.rank = np.argsort(self.leaves.reshape(SYMBOLS, SYMBOLS), axis=1).astype(np.uint16).reshape(-1)
        #: Gate and bit (the last) of all paths in a row, and where each cell's begin.
        self.path = np.cumsum(self.lens, dtype=np.int64) - self.lens
        cells, depth = np.repeat(np.arange(len(every)), self.lens), spread(np.zeros(len(every), np.int64), self.lens.astype(np.int64))
        self.marks = (np.minimum(depth, GATES - 1) << 1 | self.bits[depth, cells]).astype(np.uint8)


def cell_counts(texts: list[bytes]) -> np.ndarray:
    """How often each symbol, the end included, comes after each byte."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
    before = np.insert(raw.astype(np.int32), ends, NONE) if len(texts) else raw.astype(np.int32)
    symbol = np.insert(raw.astype(np.int32), ends, END) if len(texts) else before
    return np.bincount(np.concatenate([[NONE], before[:-1]]) * SYMBOLS + symbol, minlength=SYMBOLS * SYMBOLS) if len(before) else np.zeros(SYMBOLS * SYMBOLS, np.int64)


class Contexts:
    """Symbols in context: the longest one, the byte before first, RANK_BITS for each; and where they are in the trees."""

    def __init__(self, context: np.ndarray, cell: np.ndarray):
        self.context, self.cell = context, cell

    @classmethod
    def of_seen(cls, seen: np.ndarray) -> Contexts:
        """Of longest contexts with their symbols, as seen_symbols gives them."""
        context = seen >> U64(RANK_BITS)
        before = (context >> U64(RANK_BITS * (ORDERS[-1] - 1))).astype(np.int64) - 1
        before[before < 0] = NONE
        return cls(context, before * SYMBOLS + (seen & U64((1 << RANK_BITS) - 1)).astype(np.int64))

    def keys(self, tree: Tree) -> list[np.ndarray]:
        return [context_keys(tree, self.context >> U64(RANK_BITS * (ORDERS[-1] - order)), self.cell, k) for k, order in enumerate(ORDERS)]

    def seen(self) -> np.ndarray:
        return self.context << U64(RANK_BITS) | (self.cell % SYMBOLS).astype(np.uint64)


class Symbols(Contexts):
    """The symbols of some texts in a row."""

    def __init__(self, texts: list[bytes]):
        # as many places of nothing as the longest context before each text, one of which takes the end of the one before
        room = ORDERS[-1]
        sizes = np.array([len(x) for x in texts], np.int64)
        first = np.cumsum(sizes + room) - sizes
        raw = np.frombuffer(b"".join([bytes(room) + x for x in texts]) + b"\0", np.uint8)
        nothing = (np.repeat(first, room).reshape(-1, room) - np.arange(1, room + 1)).reshape(-1)
        value = raw.astype(np.uint64)
        value += U64(1)
        value[nothing] = 0
        value[-1] = 0
        symbol = raw.astype(np.int16)
        symbol[first + sizes] = END
        kept = np.ones(len(raw), bool)
        kept[nothing] = False
        kept[first + sizes] = True
        places = np.flatnonzero(kept)
        #: Of each text the number of symbols and the first of them in `cell`.
        self.size = sizes + 1
        self.start = np.cumsum(self.size) - self.size
        before = np.empty(len(raw), np.int32)
        before[0], before[1:] = NONE, value[:-1].astype(np.int32) - 1
        before[before < 0] = NONE
        total = np.zeros_like(value)
        for b in range(1, room + 1):
            total[b:] |= value[:-b] << U64(RANK_BITS * (room - b))
        super().__init__(total.take(places), before.take(places) * SYMBOLS + symbol.take(places))


def context_keys(tree: Tree, context: np.ndarray, cell: np.ndarray, k: int) -> np.ndarray:
    """Keys of predictor k: a hash of the context, then what tells the paths of one context apart."""
    with np.errstate(over="ignore"):
        hashed = mix(context * U64(SpanHash.base) + U64((k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> U64(64 - HASH_BITS)
    low = (cell // SYMBOLS).astype(np.uint64) << U64(RANK_BITS) | tree.rank.take(cell)
    return hashed << U64(ORDER_BITS + 2 * RANK_BITS) | (low | U64(k << 2 * RANK_BITS))


class Places:
    """Where something begins, by key. Only keys that it has may be looked for."""

    def __init__(self, keys: np.ndarray, first: np.ndarray):
        spun = keys * SPIN
        order = np.argsort(spun)
        self.keys, self.first = spun[order], first[order]
        # about one key begins with each number of so many bits
        self.shift = U64(64 - max(1, len(keys).bit_length()))
        self.table = np.searchsorted(self.keys, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        key = key * SPIN
        at = self.table.take((key >> self.shift).view(np.int64))
        left = np.flatnonzero(self.keys.take(at) != key)
        still, now = key.take(left), at.take(left)
        while len(left):
            now += 1
            off = self.keys.take(now) != still
            at[left] = now
            left, still, now = left[off], still[off], now[off]
        return self.first.take(at)


class Known:
    """Logits of symbols in context: sorted keys, and the logits of each one's path in a row.

    seen: longest contexts with their symbols of the texts that are to be scored, sorted; without, they are sought in
    the texts of each call.
    """

    def __init__(self, tree: Tree, keys: np.ndarray, flat: np.ndarray, seen: np.ndarray | None = None):
        self.tree, self.flat = tree, flat
        lens = path_lens(tree, keys)
        first = (np.cumsum(lens) - lens).astype(np.int32)
        of = [np.flatnonzero(keys >> U64(2 * RANK_BITS) & U64((1 << ORDER_BITS) - 1) == k) for k in range(PREDICTORS)]
        self.by_order = [Places(keys[mine], first[mine]) for mine in of]
        self.paths = None if seen is None else Paths(self, Contexts.of_seen(seen))

    def places(self, s: Contexts) -> list[np.ndarray]:
        """For each predictor and symbol, where the logits of its path begin."""
        return [find(key) for key, find in zip(s.keys(self.tree), self.by_order, strict=True)]


class Paths:
    """The paths of distinct symbols in their longest context: four bytes a bit, the predictors' logits and its mark.

    A text has its symbols many times, so they are looked up here at once, not for each predictor.
    """

    def __init__(self, known: Known, s: Contexts):
        tree, self.lens = known.tree, known.tree.lens.take(s.cell).astype(np.int64)
        four = np.empty((int(self.lens.sum()), 4), np.int8)
        for k, place in enumerate(known.places(s)):
            four[:, k] = known.flat.take(spread(place, self.lens))
        four[:, 3] = tree.marks.take(spread(tree.path.take(s.cell), self.lens))
        self.flat = four.view(np.int32).reshape(-1)
        self.of = s

    @cached_property
    def places(self) -> Places:
        """Sorted when first asked for: the first weights need the paths alone."""
        return Places(self.of.seen(), (np.cumsum(self.lens) - self.lens).astype(np.int32))


class Mixer:
    """start: (GATES, PREDICTORS) weights that each text begins with."""

    def __init__(self, tree: Tree, known: Known, start: np.ndarray | None = None):
        self.start = np.full((GATES, PREDICTORS), START, np.float32) if start is None else start
        self.tree, self.known = tree, known
        x = np.arange(-LIMIT * FINE, LIMIT * FINE + 1) / FINE
        self.chance = (1 / (1 + np.exp(-x))).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log2 of the probability of each text and its end."""
        out = np.zeros(len(texts))
        for part in side_by_side(texts):
            out[part] = self.mixed([texts[i] for i in part])[0]
        return out

    def mixed(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores; for each gate, predictor and text the last weights; for each gate and text the bits they have seen.

        Texts of the last two are in descending order of length.
        """
        s, tree = Symbols(texts), self.tree
        paths = self.known.paths or Paths(self.known, Contexts.of_seen(np.unique(s.seen())))
        looked, path_len = paths.places(s.seen()), tree.lens.take(s.cell)
        order = np.argsort(-s.size, kind="stable")
        size, start = s.size[order], s.start[order]
        total = np.zeros(len(texts))
        weights = np.repeat(self.start.T.astype(np.float32)[:, None], len(texts), axis=1)  # predictor, text, gate
        heard = np.zeros((len(texts), GATES), np.int64)
        middle = ((np.arange(BUCKETS) + 0.5) / BUCKETS).astype(np.float32)
        refined = np.tile(middle, (len(texts), 1))
        a = 0
        while len(size) and a < size[0]:
            live = int(np.searchsorted(-size, -a, "left"))  # texts longer than a
            n = np.minimum(size[:live] - a, STRIDE)
            at = spread(start[:live] + a, n)
            lens = path_len.take(at).astype(np.int64)  # indices of 64 bits are taken as they are
            ends = np.cumsum(lens)
            where = np.repeat(looked.take(at) - (ends - lens), lens)
            where += np.arange(ends[-1])
            four = paths.flat.take(where).view(np.int8).reshape(-1, 4)
            mark = four[:, 3].copy()
            bit = mark & 1
            last = ends[np.cumsum(n) - 1]  # of each text's bits
            owner = np.repeat(np.arange(live), np.diff(last, prepend=0))
            gate = owner * GATES + (mark >> 1)
            given = four.T[:PREDICTORS].astype(np.float32, order="C")
            mixed = given[0] * weights[0].reshape(-1).take(gate)
            for k in range(1, PREDICTORS):
                mixed += given[k] * weights[k].reshape(-1).take(gate)
            mixed *= FINE / STEP
            mixed += LIMIT * FINE + 0.5
            np.clip(mixed, 0, 2 * LIMIT * FINE, out=mixed)
            fine = mixed.astype(np.int64)
            chance = self.chance.take(fine)
            cell = owner * BUCKETS + (chance * BUCKETS).astype(np.int64)
            final = np.float32(0.75) * chance + np.float32(0.25) * refined.reshape(-1).take(cell)
            told = np.log2(np.abs(final - (bit ^ 1)))
            total[:live] += np.add.reduceat(told, np.concatenate([[0], last[:-1]]))
            miss = bit - chance
            bits = np.bincount(gate, minlength=live * GATES).reshape(live, GATES)
            pace = np.minimum(RATE, 0.5 / np.maximum(bits, 1)) / STEP
            for k, g in enumerate(given):
                weights[k, :live] += (pace * np.bincount(gate, miss * g, live * GATES).reshape(live, GATES)).astype(np.float32)
            heard[:live] += bits
            seen = np.bincount(cell << 1 | bit, minlength=2 * live * BUCKETS).reshape(live, BUCKETS, 2)
            both = seen.sum(axis=2)
            refined[:live] += ((seen[:, :, 1] - both * refined[:live]) / (both + LAG)).astype(np.float32)
            a += STRIDE
        out = np.zeros(len(texts))
        out[order] = total
        return out, weights.transpose(2, 0, 1), heard.T


def side_by_side(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Numbers of texts of like length, SIDE_TEXTS and SIDE_BYTES at most but for a longer text."""
    sizes = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(sizes, kind="stable")
    start = total = 0
    for i, n in enumerate(sizes[order].tolist()):
        if i > start and (total + n > SIDE_BYTES or i - start == SIDE_TEXTS):
            yield order[start:i]
            start, total = i, 0
        total += n
    if len(order) > start:
        yield order[start:]


def added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sum of n of each."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    cut = runs(key)[:-1] if len(key) else np.zeros(0, np.int64)
    return key[cut], np.add.reduceat(n, cut) if len(cut) else n


def counted(key: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, of 63 bits, sorted, and how often each comes where learn is set."""
    marked = key << U64(1) | learn
    marked.sort()
    cut = runs(marked >> U64(1))
    sums = np.concatenate([[0], np.cumsum(marked & U64(1), dtype=np.int64)])
    return marked[cut[:-1]] >> U64(1), np.diff(sums[cut])


def seen_symbols(texts: list[bytes], learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest contexts of texts with their symbols, sorted, and how often each comes where texts are learned from."""
    s = Symbols(texts)
    return counted(s.seen(), np.repeat(learn, s.size).astype(np.uint64))


def symbol_keys(tree: Tree, seen: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all predictors, sorted, and their counts: shorter contexts are the beginnings of the longest ones."""
    keys, counts = [], []
    for k, order in reversed(list(enumerate(ORDERS))):
        shorter = U64(RANK_BITS * (ORDERS[-1] - order))
        symbol = seen & U64((1 << RANK_BITS) - 1)
        cut, sums = added(seen >> U64(RANK_BITS) >> shorter << U64(RANK_BITS) | symbol, n)
        context, symbol = cut >> U64(RANK_BITS), (cut & U64((1 << RANK_BITS) - 1)).astype(np.int64)
        before = (context >> U64(RANK_BITS * (order - 1))).astype(np.int64) - 1
        before[before < 0] = NONE
        keys.append(context_keys(tree, context, before * SYMBOLS + symbol, k))
        counts.append(sums)
    return added(np.concatenate(keys), np.concatenate(counts))


def symbol_counts(tree: Tree, texts: list[bytes], learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of texts, and how often each comes in those that are learned from."""
    return symbol_keys(tree, *seen_symbols(texts, learn))


def word_keys(words: list[bytes]) -> np.ndarray:
    """63 bits of each word's hash."""
    return word_hashes(words)[0] >> U64(1)


def numbered_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words, A-Z lower-cased; the number of each word of the texts in a row; how many each text has."""
    split = [x.lower().split() for x in texts]
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(w, len(number)) for x in split for w in x], np.int64)
    return list(number), which, np.array([len(x) for x in split], np.int64)


def word_counts(texts: list[bytes], learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the distinct words, A-Z lower-cased, and how often each comes in texts that are learned from."""
    words, which, sizes = numbered_words(texts)
    return added(word_keys(words), np.bincount(which, np.repeat(learn, sizes), len(words)).astype(np.int64))


def path_lens(tree: Tree, keys: np.ndarray) -> np.ndarray:
    return tree.lens.take(_cells(tree, keys)).astype(np.int64)


def _cells(tree: Tree, keys: np.ndarray) -> np.ndarray:
    low = (keys & U64((1 << 2 * RANK_BITS) - 1)).astype(np.int64)
    row = (low >> RANK_BITS) * SYMBOLS
    return row + tree.leaves.take(row + (low & ((1 << RANK_BITS) - 1)))


def node_logits(tree: Tree, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The logits, in steps of 1/STEP, of the nodes on the path of each key's symbol, in a row. keys are sorted."""
    cells, context = _cells(tree, keys), keys >> U64(RANK_BITS)
    lens = tree.lens.take(cells).astype(np.int64)
    first = np.cumsum(lens) - lens
    out = np.zeros(int(lens.sum()), np.int8)
    for j in range(len(tree.inner)):
        at = np.flatnonzero(lens > j)
        if not len(at):
            break
        of, inner, count_of = context[at], tree.inner[j].take(cells[at]), n[at]
        cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (inner[1:] != inner[:-1])]))
        one, both = np.add.reduceat(count_of * tree.bits[j].take(cells[at]), cut), np.add.reduceat(count_of, cut)
        logit = np.clip(np.rint(np.log((one + 0.4) / (both - one + 0.4)) * STEP), -127, 127).astype(np.int8)
        out[first[at] + j] = np.repeat(logit, np.diff(np.append(cut, len(at))))
    return out


def _packed(*columns: np.ndarray) -> bytes:
    """64-bit numbers, a plane of equal bytes of all after the other."""
    return pa.compress(np.ascontiguousarray(np.concatenate(columns).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, columns: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, n * columns * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.uint64).reshape(columns, n)


def _bounds(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket of sorted keys of so many bits begins, and the end. Keys of one context are in one bucket."""
    low = bits - 32
    first = np.array([-(-(b << 32) // buckets) << low for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, first), [len(keys)]])


def _sent(words: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Sorted keys and their counts, of words and contexts."""
    parts = [_packed(np.diff(key, prepend=U64(0)), n.astype(np.uint64)) for key, n in (words, contexts)]
    return struct.pack(_HEAD, len(words[0]), len(contexts[0]), len(parts[0])) + b"".join(parts)


def _received(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    n_words, n_contexts, cut = struct.unpack_from(_HEAD, data)
    out = []
    for raw, n in ((data[_HEAD_SIZE : _HEAD_SIZE + cut], n_words), (data[_HEAD_SIZE + cut :], n_contexts)):
        key, counts = _unpacked(raw, n, 2)
        out.append((np.cumsum(key, dtype=np.uint64), counts.astype(np.int64)))
    return out


def home_counts(tree: Tree, rows: pa.Table, trained: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and counts of a home's words, of its symbols in context, and of those in the longest context."""
    words, seen = [], []
    for piece in text_slices(rows):
        texts, learn = byte_texts(piece["text"]), np.array(piece[trained].to_pylist(), bool)
        words.append(word_counts(texts, learn))
        seen.append(seen_symbols(texts, learn))
    words, seen = (added(*(np.concatenate(x) for x in zip(*parts, strict=True))) for parts in (words, seen))
    return [words, symbol_keys(tree, *seen), seen]


def _answers(homes: DataFrame, folder: str, tree: Tree, trained: str, buckets: int) -> DataFrame:
    """For each home and bucket, what the home asked: counts of words, and logits of symbols in context.

    A row of no home (-1) for each bucket has the sum of the counts of its words and how many have one. A bucket holds
    as much as a home, however many there are.
    """

    def row(home: int, bucket: int, words: int, known: int, data: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((home, bucket, words, known, data), _ANSWERS, strict=True)], schema=_ANSWERS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home in batch["home"].to_pylist():
                (word, n_word), (key, n), (seen, n_seen) = home_counts(tree, read_home(folder, home), trained)
                fs, root = open_folder(folder)
                put_file(fs, f"{root}/{home}.seen", struct.pack("<Q", len(seen)) + _packed(np.diff(seen, prepend=U64(0)), n_seen.astype(np.uint64)))
                put_file(fs, f"{root}/{home}.keys", b"".join([struct.pack(_HEAD, len(word), len(key), 0), _packed(np.diff(np.concatenate([word, key]), prepend=U64(0)))]))
                of_words, of_keys = _bounds(word, buckets, 63).tolist(), _bounds(key, buckets, KEY_BITS).tolist()
                for b in range(buckets):
                    x, y, lo, hi = of_words[b], of_words[b + 1], of_keys[b], of_keys[b + 1]
                    if x < y or lo < hi:
                        yield row(home, b, y - x, 0, _sent((word[x:y], n_word[x:y]), (key[lo:hi], n[lo:hi])))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by bucket, a bucket at a time."""
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            word, n_word = added(*(np.concatenate([x[1][0][i] for x in held]) for i in (0, 1)))
            every, n = added(*(np.concatenate([x[1][1][i] for x in held]) for i in (0, 1)))
            flat, lens = node_logits(tree, every, n), path_lens(tree, every)
            first = np.cumsum(lens) - lens
            yield row(-1, now, int(n_word.sum()), int((n_word > 0).sum()), None)
            for home, ((mine, _), (key, _)) in held:
                at = np.searchsorted(every, key)
                counts, told = _packed(n_word[np.searchsorted(word, mine)].astype(np.uint64)), flat.take(spread(first[at], lens[at])).tobytes()
                yield row(home, now, len(mine), len(told), struct.pack(_HEAD, len(mine), len(told), len(counts)) + counts + pa.compress(told, codec="zstd", asbytes=True))

        for batch in batches:
            for home, bucket, data in zip(*(batch[x].to_pylist() for x in ("home", "bucket", "data")), strict=True):
                if bucket != now:
                    if held:
                        yield from out()
                    now, held = bucket, []
                held.append((home, _received(data)))
        if held:
            yield from out()

    sent = homes.select("home").repartition(max(1, -(-buckets // HOMES_A_TASK)), "home").mapInArrow(task, ANSWERS)
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(summed, ANSWERS)


def _learned(group: pa.Table, tree: Tree, folder: str, home: int) -> tuple[np.ndarray, np.ndarray, Known, np.ndarray]:
    """Sorted keys and counts of a home's words, and its logits, from its rows of _answers; and how often its training
    documents have each of its paths."""
    fs, root = open_folder(folder)
    with fs.open_input_stream(f"{root}/{home}.keys") as src:
        data = src.read()
    n_words, n_keys, _ = struct.unpack_from(_HEAD, data)
    keys = np.cumsum(_unpacked(data[_HEAD_SIZE:], n_words + n_keys, 1)[0], dtype=np.uint64)
    word, key = keys[:n_words], keys[n_words:]
    counts, told = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
    for data in group.sort_by("bucket")["data"].to_pylist():  # buckets are stretches of the sorted keys
        n, size, cut = struct.unpack_from(_HEAD, data)
        counts.append(_unpacked(data[_HEAD_SIZE : _HEAD_SIZE + cut], n, 1)[0].astype(np.int64))
        told.append(np.frombuffer(pa.decompress(data[_HEAD_SIZE + cut :], size, codec="zstd", asbytes=True), np.int8))
    with fs.open_input_stream(f"{root}/{home}.seen") as src:
        data = src.read()
    seen, times = _unpacked(data[8:], struct.unpack_from("<Q", data)[0], 2)
    return word, np.concatenate(counts), Known(tree, key, np.concatenate(told), np.cumsum(seen, dtype=np.uint64)), times.astype(np.int64)


def evidence(paths: Paths, times: np.ndarray) -> np.ndarray:
    """(GATES, PREDICTORS, 1 + PREDICTORS): the gradient and the curvature of the likelihood of the bits of all paths, each
    so many times, where all weights are START."""
    out = np.zeros((GATES, PREDICTORS, 1 + PREDICTORS))
    every = np.repeat(times, paths.lens)
    # the chance follows from the sum of the logits, a whole number of steps
    most = PREDICTORS * 127
    table = 1 / (1 + np.exp(-np.clip(START / STEP * np.arange(-most, most + 1), -LIMIT, LIMIT)))
    for first in range(0, len(every), EVIDENCE_BITS):
        at = first + np.flatnonzero(every[first : first + EVIDENCE_BITS])
        n, (*steps, mark) = every.take(at), paths.flat.take(at).view(np.int8).reshape(-1, 4).T.astype(np.int64)
        x, gate = [k / STEP for k in steps], mark >> 1
        chance = table.take(sum(steps) + most)
        miss, curve = n * ((mark & 1) - chance), n * chance * (1 - chance)
        for i in range(PREDICTORS):
            out[:, i, 0] += np.bincount(gate, miss * x[i], GATES)
            for j in range(i + 1):
                out[:, i, 1 + j] += np.bincount(gate, curve * x[i] * x[j], GATES)
                out[:, j, 1 + i] = out[:, i, 1 + j]
    return out


def first_weights(told: np.ndarray) -> np.ndarray:
    """(GATES, PREDICTORS): one step of Newton's method from START, where evidence tells of any bits."""
    out = np.full((GATES, PREDICTORS), START)
    for g, (gradient, curve) in enumerate(zip(told[:, :, 0], told[:, :, 1:], strict=True)):
        if np.trace(curve) > 0:
            out[g] += np.linalg.solve(curve + 1e-3 * np.trace(curve) * np.eye(PREDICTORS), gradient)
    return np.clip(out, *START_RANGE).astype(np.float32)


def _start(answers: DataFrame, folder: str, tree: Tree) -> np.ndarray:
    """(GATES, PREDICTORS): the first weights, from the training documents of all homes."""

    def learn(group: pa.Table) -> pa.Table:
        known, times = _learned(group, tree, folder, group["home"][0].as_py())[2:]
        told = evidence(known.paths, times).reshape(-1)
        return pa.table({"at": pa.array(np.arange(len(told)), pa.int32()), "x": pa.array(told)})

    # decimals: sums that no order of the rows changes
    rows = answers.filter("home >= 0").groupBy("home").applyInArrow(learn, "at int, x double").groupBy("at").agg(F.sum(F.col("x").cast("decimal(28,6)")).cast("double").alias("x")).collect()
    told = np.zeros(GATES * PREDICTORS * (1 + PREDICTORS))
    for r in rows:  # one for each place
        told[r["at"]] = r["x"]
    return first_weights(told.reshape(GATES, PREDICTORS, -1))


def lm_scores(docs: DataFrame, spark: SparkSession, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of docs.

    score: log10 of the model's probability of the whole text. Null texts are empty: they have the end alone, and null
    bits_per_byte. Repeated rows are learned from and returned as often as they come; a null doc_id stays null and
    counts to fold 0. Empty tables give no rows; columns besides doc_id and text are not read. Without training
    documents all counts are zero. docs must have the same partitions when it is computed again, as a scan of files has;
    save what has not.
    """
    folder = shared_folder(spark, "lm")
    trained = "trained"

    def measure(home: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        learned, cells = 0, np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for piece in text_slices(rows):
            texts = [x for x, t in zip(byte_texts(piece["text"]), piece[trained].to_pylist(), strict=True) if t]
            learned += len(texts)
            cells += cell_counts(texts)
        pairs = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array([home]), pa.array([learned]), pa.array([pairs.astype(np.int32)], pa.list_(pa.int32())), pa.array([cells[pairs]], pa.list_(pa.int64()))], schema=_HOMES)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = texts.withColumn(trained, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(0)) != held_out)
    homes = saved(settle(marked, folder, measure, HOMES, HOME_BYTES), spark, f"{folder}/homes")
    total = homes.agg(F.count("*").alias("n"), F.sum("learned").alias("learned")).first()
    buckets, ends = max(1, total["n"]), int(total["learned"] or 0)
    pairs = homes.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("cell")).agg(F.sum("x.counts").alias("n"))
    cells = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for r in pairs.collect():  # SYMBOLS * SYMBOLS rows at most
        cells[r["cell"]] = r["n"]
    tree = Tree(cells)
    answers = saved(_answers(homes, folder, tree, trained, buckets), spark, f"{folder}/answers")
    sums = answers.filter("home = -1").agg(F.sum("words").alias("n"), F.sum("known").alias("v")).first()
    n_train, vocabulary = int(sums["n"] or 0) + ends, int(sums["v"] or 0) + (ends > 0)
    start = _start(answers, folder, tree)
    floor = np.log10(n_train + vocabulary + 1)
    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def finish(group: pa.Table) -> pa.Table:
        home = group["home"][0].as_py()
        rows = read_home(folder, home)
        words, n, known_paths, _ = _learned(group.filter(pc.is_valid(group["data"])), tree, folder, home)
        mixer, out = Mixer(tree, known_paths, start), []
        for piece in text_slices(rows):
            texts = byte_texts(piece["text"])
            distinct, which, sizes = numbered_words(texts)
            c = n[np.searchsorted(words, word_keys(distinct))][which]
            tokens = sizes + 1
            first = np.concatenate([[0], np.cumsum(tokens - 1)])
            known, logs = (np.concatenate([[0], np.cumsum(x)]) for x in (c > 0, np.log10(c + 1.0)))
            base = logs[first[1:]] - logs[first[:-1]] + np.log10(ends + 1.0) - tokens * floor
            out.append([piece["doc_id"].combine_chunks(), pa.array([fold(d, folds) == held_out for d in piece["doc_id"].to_pylist()]), pa.array(tokens), pa.array(known[first[1:]] - known[first[:-1]] + (ends > 0)), pa.array(np.full(len(texts), n_train, np.int64)), pa.array(base)])
        every = byte_texts(rows["text"])
        number = {x: i for i, x in enumerate(dict.fromkeys(every))}  # copies are scored once
        bits = mixer.scores(list(number))[[number[x] for x in every]]
        size = np.array([len(x) for x in every], np.float64)
        per = np.divide(-bits, size, out=np.zeros(len(every)), where=size > 0)
        made = pa.Table.from_batches([pa.RecordBatch.from_arrays(x, names=result.names[:6]) for x in out])
        return made.append_column("score", pa.array(bits * np.log10(2.0))).append_column("bits_per_byte", pa.array(per, mask=size == 0)).cast(result)

    asked = homes.select("home", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("data")).unionByName(answers.filter("home >= 0").select("home", "bucket", "data"))
    return asked.groupBy("home").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark)
