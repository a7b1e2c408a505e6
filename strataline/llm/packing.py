"""Best-fit packing of documents into fixed-length token sequences, with a swap-based local search.

Tokenizing happens where the text is; only (doc_id, piece, start, length, crc) rows move. Pieces are
dealt by a hash into groups of a bounded number of pieces, and each group is packed on its own: a coarse best-fit
start, then exchanges between underfull bins (move one item, swap one for one, two for one, one for two) that
raise the sum of squared fills, until bins empty. The search ends at the lower bound or when no bin has anything
to give; no try, pair or partner is left out. A group leaves at most a few bins underfull, so the loss against
packing everything at once is a few sequences per GROUP_PIECES pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import pieces_of, prepare, quoted, text_buffers, text_of, written

CAPACITY = 1024
END_OF_TEXT = 2
GROUP_PIECES = 40_000
#: Text bytes that are tokenized at once.
SLICE_BYTES = 1 << 20

#: The pre-tokenizer's pattern of byte-level BPE: a fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteLevelTokenizer:
    """The ids of a byte-level BPE tokenizer file, as little-endian 32-bit bytes.

    The file's vocabulary is run by a merge engine that needs a third of the time of the library that
    wrote it; an id is a merge's rank there, so both give the same ids. Texts with four-byte characters
    (Unicode versions may class the newest differently) or with a special token's string go through the
    writing library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the file writes bytes as printable characters: those that print stand for themselves, the rest follow 255
        prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(prints)]
        byte = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(byte[c] for c in token): n for token, n in vocabulary.items() if token not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str, plain: bool = False) -> bytes:
        if not text:
            return b""
        if not plain and max(text) > "\uffff" or any(s in text for s in self.special):
            return self.whole(text)
        return self.fast(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        encode = ByteLevelTokenizer(tokenizer)
        for batch in batches:
            for part in pieces_of(batch, SLICE_BYTES):
                out = [[], [], [], [], []]
                body, offsets = text_buffers(part.column("text"))
                wide = np.concatenate([[0], np.cumsum(body >= 0xF0)])  # bytes that begin a four-byte character
                plain = (wide[offsets[1:]] == wide[offsets[:-1]]).tolist()
                for doc, text, usual in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), plain, strict=True):
                    ids = encode(text, usual) + end
                    n = len(ids) // 4
                    at, first = 0, n % capacity or capacity
                    for k in range(-(-n // capacity)):
                        size = first if k == 0 else capacity
                        for column, x in zip(out, (doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                            column.append(x)
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text_of(quoted(text_col)).alias("text")).mapInArrow(run, schema)


class _Side:
    """What listed bins could take for one kind of return: for each gap, the sizes that a bin of that gap can give back.

    A bin of gap g takes t tokens for y given back if y < t <= y + g. The bits t that any listed bin of gap g
    takes stand at the leaves of a binary tree over gaps, so that all partners of a donor are asked at once.
    """

    def __init__(self, capacity: int):
        self.holders: dict[tuple[int, int], set[int]] = defaultdict(set)  # listed bins by (gap, size given back)
        self.sizes: dict[int, int] = defaultdict(int)  # by gap: bit y is set when holders has (gap, y)
        self.exact: dict[int, set[int]] = defaultdict(set)  # by y + g: the gaps g with (g, y)
        self.exacts = 0
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.stale: set[int] = set()

    def add(self, b: int, g: int, sizes: int) -> None:
        for y in _bits(sizes):
            held = self.holders[g, y]
            if not held:
                self.sizes[g] |= 1 << y
                self.exact[y + g].add(g)
                self.exacts |= 1 << (y + g)
                self.stale.add(g)
            held.add(b)

    def drop(self, b: int, g: int, sizes: int) -> None:
        for y in _bits(sizes):
            held = self.holders[g, y]
            held.discard(b)
            if not held:
                del self.holders[g, y]
                self.sizes[g] &= ~(1 << y)
                self.stale.add(g)
                there = self.exact[y + g]
                there.discard(g)
                if not there:
                    self.exacts &= ~(1 << (y + g))

    def filled(self, gives: int) -> tuple[int, int, int] | None:
        """(t, g, y) of an exchange of one of ``gives`` that fills a bin."""
        if not (found := gives & self.exacts):
            return None
        t = found.bit_length() - 1
        g = max(self.exact[t])
        return t, g, t - g

    def taken(self, gives: int, most: int) -> tuple[int, int, int] | None:
        """(t, g, y) of an exchange of one of ``gives`` with a bin of the smallest gap that can take any, up to ``most``."""
        for g in self.stale:
            at = g + self.leaves
            self.tree[at] = _smeared(self.sizes[g], g)
            while at > 1:
                at >>= 1
                self.tree[at] = self.tree[2 * at] | self.tree[2 * at + 1]
        self.stale.clear()
        if not self.tree[1] & gives:
            return None
        at = 1
        while at < self.leaves:  # the leftmost leaf with a common bit
            at = 2 * at if self.tree[2 * at] & gives else 2 * at + 1
        g = at - self.leaves
        if g > most:
            return None
        t = (self.tree[at] & gives).bit_length() - 1
        low = max(0, t - g)
        able = (self.sizes[g] & ((1 << t) - 1)) >> low
        return t, g, low + (able & -able).bit_length() - 1


class _Bins:
    """Bins of one capacity; the underfull ones are listed by gap and by what they could take."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[dict[int, list[int]]] = []  # by bin: item numbers by size
        self.gap: list[int] = []
        self.by_gap: dict[int, set[int]] = defaultdict(set)
        self.gaps = 0  # bit g is set when a bin with gap g is listed
        self.single, self.pair = _Side(capacity), _Side(capacity)  # for nothing or one item given back, and for two

    def new(self) -> int:
        self.items.append({})
        self.gap.append(self.capacity)
        return len(self.items) - 1

    def place(self, b: int) -> None:
        if g := self.gap[b]:
            self.by_gap[g].add(b)
            self.gaps |= 1 << g

    def lift(self, b: int) -> None:
        if g := self.gap[b]:
            self.by_gap[g].discard(b)
            if not self.by_gap[g]:
                self.gaps &= ~(1 << g)

    def list_bin(self, b: int) -> None:
        if self.gap[b]:
            self.place(b)
            ones, twos = self.gives(b)
            self.single.add(b, self.gap[b], ones | 1)
            self.pair.add(b, self.gap[b], twos)

    def unlist(self, b: int) -> None:
        if self.gap[b]:
            self.lift(b)
            ones, twos = self.gives(b)
            self.single.drop(b, self.gap[b], ones | 1)
            self.pair.drop(b, self.gap[b], twos)

    def put(self, b: int, size: int, item: int) -> None:
        self.items[b].setdefault(size, []).append(item)
        self.gap[b] -= size

    def take(self, b: int, total: int, pair: bool) -> list[tuple[int, int]]:
        """Takes one item of ``total`` tokens out, or two that add up to it: (size, item) of each."""
        mine = self.items[b]
        sizes = () if not total else (total,) if not pair else next((s, total - s) for s in mine if total - s in mine and (total != 2 * s or len(mine[s]) > 1))
        out = []
        for s in sizes:
            out.append((s, mine[s].pop()))
            if not mine[s]:
                del mine[s]
        self.gap[b] += total
        return out

    def gives(self, b: int) -> tuple[int, int]:
        """Bit t is set when the bin can give t tokens in one item, and in two."""
        mine = self.items[b]
        ones, twos = sum(1 << s for s in mine), 0
        for s, items in mine.items():
            twos |= (ones if len(items) > 1 else ones & ~(1 << s)) << s
        return ones, twos


def _bits(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def _smeared(mask: int, most: int) -> int:
    """The union of ``mask`` shifted up by 1 to ``most``."""
    out, reach = mask << 1, 1
    while reach < most:
        step = min(reach, most - reach)
        out |= out << step
        reach += step
    return out


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """A bin number for each item of 1..capacity, in as few bins as found.

    The start is best fit, larger powers of two first and otherwise in the given order. Then local search packs: the emptiest underfull bin
    gives items to fuller ones by a move or an exchange of one for one, two for one or one for two, each of
    which raises the sum of squared fills, until it is empty or has nothing to give. A bin that was tried in vain
    is tried again as soon as another has changed so that it could take something of it. When no bin has anything
    to give, small items that are shut up in full bins are moved out where that empties their bin, and the search
    goes on. It ends when the bins reach the lower bound ceil(total / capacity), or when no bin can be emptied
    so either. Equal input gives equal output; ties between bins of equal gaps and sizes go to any one of them.
    """
    bins = _Bins(capacity)
    size = sizes.tolist()
    for item in np.argsort(-np.ceil(np.log2(np.maximum(sizes, 1))), kind="stable").tolist():
        s = size[item]
        up = bins.gaps >> s if s < capacity else 0
        b = next(iter(bins.by_gap[s + (up & -up).bit_length() - 1])) if up else bins.new()
        bins.lift(b)
        bins.put(b, s, item)
        bins.place(b)
    bound = -(-int(sizes.sum()) // capacity)
    while _search(bins, bound) > bound and _scattered(bins, bound):
        pass
    out = np.zeros(len(sizes), np.int64)
    for k, b in enumerate(x for x in bins.items if x):
        for held in b.values():
            out[held] = k
    return out


def _scattered(bins: _Bins, bound: int) -> int:
    """Empties bins, those of the smallest items first, by moves of all their items into gaps of others; how many."""
    used, before = sum(map(bool, bins.items)), 0
    order = sorted((max(x), b) for b, x in enumerate(bins.items) if x)
    for top, b in order:
        if used - before <= bound or top >= bins.gaps.bit_length():
            break
        bins.lift(b)
        moved: list[tuple[int, int, int]] = []
        for s, item in sorted(((s, item) for s, held in bins.items[b].items() for item in held), reverse=True):
            if not (up := bins.gaps >> s):
                break
            partner = next(iter(bins.by_gap[s + (up & -up).bit_length() - 1]))
            moved.append((partner, s, item))
            _shift(bins, partner, s, item)
        else:
            bins.items[b], bins.gap[b] = {}, bins.capacity
            before += 1
            continue
        for partner, s, item in reversed(moved):  # one doesn't fit: all go back
            _shift(bins, partner, -s, item)
        bins.place(b)
    return before


def _shift(bins: _Bins, b: int, size: int, item: int) -> None:
    bins.lift(b)
    if size > 0:
        bins.put(b, size, item)
    else:
        bins.items[b][-size].remove(item)
        if not bins.items[b][-size]:
            del bins.items[b][-size]
        bins.gap[b] -= size
    bins.place(b)


def _search(bins: _Bins, bound: int) -> int:
    """Exchanges until none is left or the bins are as few as ``bound``; their number."""
    bins.single, bins.pair = _Side(bins.capacity), _Side(bins.capacity)
    for b, items in enumerate(bins.items):
        if items:
            bins.list_bin(b)
    used = sum(map(bool, bins.items))
    tried: dict[int, tuple[int, int]] = {}  # what bins that were tried in vain could give
    while used > bound:
        donor = _emptiest(bins, tried)
        if donor < 0:
            break
        bins.unlist(donor)
        changed = set()
        while bins.items[donor] and (partner := _exchange(bins, donor)) >= 0:
            changed.add(partner)
        used -= not bins.items[donor]
        for b in changed:
            tried.pop(b, None)
        for b in changed | {donor} if changed else ():
            if bins.items[b] and (g := bins.gap[b]):
                ones, twos = bins.gives(b)
                single, pair = _smeared(ones | 1, g), _smeared(twos, g)
                for d in [d for d, (one, two) in tried.items() if (one | two) & single or one & pair]:
                    del tried[d]
        if bins.items[donor]:
            bins.list_bin(donor)
            tried[donor] = bins.gives(donor)
    return used


def _emptiest(bins: _Bins, tried) -> int:
    left = bins.gaps
    while left:
        g = left.bit_length() - 1
        for b in bins.by_gap[g]:
            if b not in tried:
                return b
        left &= ~(1 << g)
    return -1


def _exchange(bins: _Bins, donor: int) -> int:
    """One step that raises the sum of squared fills: the partner, or -1.

    A partner that is filled may be any; others are no emptier than the donor, so that they end up fuller.
    """
    most = bins.gap[donor]
    ones, twos = bins.gives(donor)
    found, side = bins.single.filled(ones | twos), bins.single
    if not found:
        found, side = bins.pair.filled(ones), bins.pair
    if not found:
        found, side = bins.single.taken(ones | twos, most), bins.single
    if not found:
        found, side = bins.pair.taken(ones, most), bins.pair
    if not found:
        return -1
    total, g, back = found
    partner = next(iter(side.holders[g, back]))
    bins.unlist(partner)
    returned = bins.take(partner, back, side is bins.pair)
    for s, item in bins.take(donor, total, not ones >> total & 1):
        bins.put(partner, s, item)
    for s, item in returned:
        bins.put(donor, s, item)
    bins.list_bin(partner)
    return partner


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_OF_TEXT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its tokens and ``end_id``, so a null or empty text is one token. Longer documents are
    cut from the end into pieces of ``capacity``; the first piece may be shorter. Rows repeated with one
    id are packed as often as they occur; a null id stays null. Only the two named columns are read.
    Which of several pieces of one length lies in a sequence doesn't matter, and is left open. An empty table gives no rows. Sequence
    numbers are the group's number times 2**32 plus the bin's, so they never clash.
    """
    prepare(docs.sparkSession)
    pieces = written(tokenized_pieces(docs, id_col, text_col, tokenizer or tokenizer_path(), capacity, end_id), "packing-pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    # a full piece is a sequence of its own; the hash takes the piece's content so that repeated or null ids spread
    dealt = pieces.withColumn("__bp_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(groups)))

    def place(part):
        import pyarrow as pa
        import pyarrow.compute as pc

        part = part.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        size = part.column("length").to_numpy()
        bins = pack(size, capacity)
        order = np.lexsort((np.arange(len(bins)), bins))
        ends = np.cumsum(size[order])
        begin = ends - size[order]
        new = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offset = np.empty(len(bins), np.int64)
        offset[order] = begin - np.maximum.accumulate(np.where(new, begin, 0))
        group = pc.cast(part.column("__bp_group"), pa.int64()).to_numpy()
        return part.drop_columns(["__bp_group"]).append_column("sequence_id", pa.array(group * (1 << 32) + bins)).append_column("offset", pa.array(offset))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("__bp_group").applyInArrow(place, schema)
