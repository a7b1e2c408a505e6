"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding follows the agenda algorithm: all adjacent pairs that form a piece are kept in a heap by score
and place, the best is merged, and the pairs that the merge creates join the agenda. With dropout each
candidate taken from the agenda is skipped when a keyed hash of (seed, document, the word's place in the
document, place in the word, piece) falls below the rate. A skip holds until a merge at its side makes a
new candidate. So every occurrence of a word is drawn anew, and yet equal (seed, document, text) give equal
ids. Short words are processed many at a time, one merge of each per round. Every segmentation is built from
the text's own characters, so decoding is lossless whatever was skipped.

What is tabled for a word is its agenda without skips: the merges in order and the ids. An occurrence none of
whose merges is skipped has those ids; all others go through the agenda under their own key.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.llm.common import joined, kept_columns, mix64, pieces_of, prepare, quoted, text_of

MARK = "▁"  # stands for a space in pieces: a fixed value of the format
DROPOUT, SEED = 0.1, 20_240
#: Words of up to so many characters are segmented together, by class; longer ones alone.
CLASSES = (3, 6, 9, 12, 16, 24)
#: Slots of the table of merges, each pair of pieces having two places, and how often a pair may move another.
TABLE, MOVES = 1 << 18, 500
_SPREAD = 0x9E3779B97F4A7C15
_NONE = np.int16((1 << 15) - 1)
#: Words whose agendas a worker holds; beyond that its table starts anew.
CACHE_WORDS = 1_000_000
#: Text that is encoded at once: words of one length are segmented together, so more of them are cheaper.
SLICE_BYTES = 4 << 20
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCodec:
    """Encoder and decoder over the pieces, scores and byte pieces of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        if n >= 1 << 15:
            raise ValueError("tables of merges take up to 32767 pieces")
        byte_ids = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(n) if m.is_byte(i)}
        if len(byte_ids) < 256:
            raise ValueError("the model has no byte pieces, so it cannot encode every text losslessly")
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.piece = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in byte_ids.items()}
        self.pieces = [self.piece.get(i, b"") for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces reach over words: words cannot be encoded one by one")
        self.packed = [_packed([i]) for i in range(n)]
        self.characters: dict[str, bytes] = {}
        self._forget()

        # every pair of pieces that forms a piece, by the 30 bits of both
        pairs = {(self.ids[p[:k]] << 15 | self.ids[p[k:]]): i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.unknown = n
        self.rank = np.full(n + 1, _NONE, np.int16)
        for r, i in enumerate(sorted(plain, key=lambda i: -m.get_score(i))):
            self.rank[i] = r
        self.by_rank = np.full(int(_NONE) + 1, n, np.int16)
        self.by_rank[self.rank[plain]] = plain
        self.letter = np.full(0x110000, self.unknown, np.int16)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.letter[ord(p)] = i
        self.table_key, self.table_id = _two_place_table(pairs, n)

    def _forget(self) -> None:
        self.number: dict[str, int] = {}  # words in the table
        self.clean: list[bytes] = []  # each one's ids without skips
        self.begins = np.zeros(1, np.int64)  # and its merges: places and pieces from begins[i] to begins[i + 1]
        self.merge_place, self.merge_piece = np.zeros(0, np.int8), np.zeros(0, np.int16)
        self.long: set[int] = set()  # words that are segmented alone

    def _character(self, c: str) -> bytes:
        """The byte pieces of a character outside the vocabulary."""
        if (found := self.characters.get(c)) is None:
            found = self.characters[c] = _packed(self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))
        return found

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two pieces form, or the unknown id."""
        key = (a.astype(np.int32) << 15) | b
        out = np.full(key.shape, self.unknown, np.int16)
        for at in _places(key):
            hit = self.table_key[at] == key
            out[hit] = self.table_id[at[hit]]
        return out

    def _segment_class(self, words: list[str], keys: np.ndarray, width: int, bar: int, trace: list | None = None) -> list[bytes]:
        """Agendas of many words at once: in each round every word merges its best candidate that is not skipped.

        Words lie in columns. A candidate is a number, rank times 32 plus place, so that the smallest of a column
        is the word's best. A merge leaves its piece at the left part's place; ``after`` and ``before`` name the
        neighbours that are left. ``trace`` gets (words, places, pieces) of each round's merges.
        """
        n = len(words)
        points = np.zeros((n, width), np.uint32)
        size = np.array([len(w) for w in words])
        points[np.arange(width) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = np.ascontiguousarray(self.letter[points].T)
        place = np.arange(width)[:, None]
        alive = place < size
        after = np.repeat(place + 1, n, 1)
        before = after - 2
        none = int(_NONE) << 5

        def candidates(a, b, at, key, inside):
            both = self.merged(a, b)
            rank = (self.rank[both].astype(np.int32) << 5) | at.astype(np.int32)
            if bar:
                inside = inside & ~skipped(key, at, both, bar)
            return np.where(inside, rank, none)

        agenda = np.full((width, n), none, np.int32)
        agenda[:-1] = candidates(ids[:-1], ids[1:], place[:-1], keys, alive[1:])
        flat_ids, flat_after, flat_before, flat_alive, flat_agenda = (x.reshape(-1) for x in (ids, after, before, alive, agenda))
        rows = np.arange(n)
        while True:
            best = agenda[:, rows].min(0)
            open_ = best < none
            rows, best = rows[open_], best[open_]
            if not len(rows):
                break
            at, piece = (best & 31).astype(np.int64), self.by_rank[best >> 5]
            key, here = keys[rows], at * n + rows
            gone = flat_after[here] * n + rows
            right, left = flat_after[gone], flat_before[here]
            flat_ids[here], flat_after[here] = piece, right
            flat_alive[gone], flat_agenda[gone] = False, none
            if trace is not None:
                trace.append((rows, at.astype(np.int8), piece))
            more = right < size[rows]
            there = np.where(more, right, 0) * n + rows
            flat_before[there[more]] = at[more]
            flat_agenda[here] = candidates(piece, flat_ids[there], at, key, more)
            more = np.flatnonzero(left >= 0)
            there = left[more] * n + rows[more]
            flat_agenda[there] = candidates(flat_ids[there], piece[more], left[more], key[more], True)
        alive, done = alive.T, ids.T
        raw, counts = done[alive].astype("<u4").tobytes(), alive.sum(1).tolist()
        out, start = [], 0
        for k in counts:
            out.append(raw[start : start + 4 * k])
            start += 4 * k
        for i in np.flatnonzero(((done == self.unknown) & alive).any(1)).tolist():  # characters outside the vocabulary become their bytes
            word, left = words[i], np.flatnonzero(alive[i])
            out[i] = b"".join([self.packed[p] if p != self.unknown else self._character(word[at]) for p, at in zip(done[i, left].tolist(), left.tolist(), strict=True)])
        return out

    def _segment_long(self, word: str, key: int, bar: int) -> bytes:
        """The same agenda as a heap, for one word of any length."""
        part: list[str] = list(word)
        n = len(part)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, str]] = []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(both := part[a] + part[b])) is not None:
                heapq.heappush(agenda, (int(self.rank[i]), a, b, both))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if not part[a] or not part[b] or right[a] != b or part[a] + part[b] != both:
                continue  # one side has merged meanwhile
            if bar and skipped(np.array([key], np.uint64), np.array([a]), np.array([self.ids[both]]), bar)[0]:
                continue
            part[a], part[b] = both, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            propose(left[a], a)
            propose(a, right[a])
        return _packed(x for p in part if p for x in ((self.ids[p],) if p in self.ids else (self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))))

    def segment_words(self, words: list[str], keys: np.ndarray, rate: float = 0.0) -> list[bytes]:
        """The ids of each word under its key, as little-endian 32-bit bytes."""
        bar = int(rate * (1 << 32))
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words])
        low = 0
        for width in CLASSES:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            if len(rows):
                for i, ids in zip(rows.tolist(), self._segment_class([words[i] for i in rows], keys[rows], width, bar), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(size > low).tolist():
            out[i] = self._segment_long(words[i], int(keys[i]), bar)
        return out

    def _learn(self, words: list[str]) -> None:
        """Puts words, none of which is there yet, in the table."""
        ids: list[bytes] = [b""] * len(words)
        owners, places, pieces = [], [], []
        size = np.array([len(w) for w in words])
        low = 0
        for width in CLASSES:
            rows, trace = np.flatnonzero((size > low) & (size <= width)), []
            low = width
            if len(rows):
                for i, found in zip(rows.tolist(), self._segment_class([words[i] for i in rows], np.zeros(len(rows), np.uint64), width, 0, trace), strict=True):
                    ids[i] = found
                for column, part in zip((owners, places, pieces), zip(*((rows[r], at, piece) for r, at, piece in trace), strict=True) if trace else ((), (), ()), strict=True):
                    column.extend(part)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        first = len(self.clean)
        self.long.update(first + i for i in np.flatnonzero(size > low).tolist())
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        self.clean += ids
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(np.bincount(owner, minlength=len(words)))])
        if owners:
            self.merge_place = np.concatenate([self.merge_place, np.concatenate(places)[order]])
            self.merge_piece = np.concatenate([self.merge_piece, np.concatenate(pieces)[order]])

    def _with_skips(self, words: np.ndarray, keys: np.ndarray, bar: int) -> np.ndarray:
        """Which occurrences (numbers of words and their keys) skip a merge of the agenda without skips."""
        merges = self.begins[words + 1] - self.begins[words]
        ends = np.cumsum(merges)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[words] - ends + merges, merges)
        hit = skipped(np.repeat(keys, merges), self.merge_place[at], self.merge_piece[at], bar)
        count = np.concatenate([[0], np.cumsum(hit)])
        return count[ends] > count[ends - merges]

    def encode_batch(self, texts: list[str], rate: float = 0.0, seed: int = SEED, documents: list[int] | None = None) -> list[bytes]:
        """The ids of texts, as little-endian 32-bit bytes. A space is put before each, as the format does; the mark's own character becomes bytes."""
        documents = documents if documents is not None else [0] * len(texts)
        mark = _packed(self.byte_ids[b] for b in MARK.encode())
        words: list[str] = []
        plan = []  # per text: the numbers of words in each of its parts between marks
        for t in texts:
            plan.append([])
            for k, chunk in enumerate(t.split(MARK) if t else ()):
                found = _WORD.findall((MARK if k == 0 else "") + chunk.replace(" ", MARK))
                words += found
                plan[-1].append(len(found))
        found = list(map(self.number.get, words))
        if None in found:
            new = dict.fromkeys(w for w, k in zip(words, found, strict=True) if k is None)
            if len(self.clean) + len(new) > CACHE_WORDS:
                self._forget()
                new = dict.fromkeys(words)
            self._learn(list(new))
            found = list(map(self.number.__getitem__, words))
        number = np.array(found, np.int64)
        out = list(map(self.clean.__getitem__, found))
        bar = int(rate * (1 << 32))
        sizes = np.array([sum(p) for p in plan], np.int64)
        if bar:
            of_text = np.repeat(np.array([document_key(seed, d) for d in documents], np.uint64), sizes)
            place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keys = mix64(of_text + place.astype(np.uint64) * np.uint64(_SPREAD))
            again = self._with_skips(number, keys, bar)
        else:
            keys, again = np.zeros(len(words), np.uint64), np.zeros(len(words), bool)
        if self.long:
            again |= np.isin(number, np.fromiter(self.long, np.int64))
        rows = np.flatnonzero(again)
        for i, ids in zip(rows.tolist(), self.segment_words([words[i] for i in rows.tolist()], keys[rows], rate), strict=True):
            out[i] = ids
        result, at = [], 0
        for parts in plan:
            joined = []
            for n in parts:
                joined.append(b"".join(out[at : at + n]))
                at += n
            result.append(mark.join(joined))
        return result

    def encode(self, text: str, rate: float = 0.0, seed: int = SEED, document: int = 0) -> list[int]:
        return np.frombuffer(self.encode_batch([text], rate, seed, [document])[0], "<u4").tolist()

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes in order, without the space that encoding put first."""
        data = b"".join(map(self.pieces.__getitem__, np.asarray(ids, np.int64).tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of pairs of pieces in a table."""
    x = key.astype(np.uint32)
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(14), ((x ^ (x >> np.uint32(13))) * np.uint32(0x85EBCA6B)) >> np.uint32(14)


def _two_place_table(pairs: dict[int, int], unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and pieces by slot; a pair lies in one of its two places, having moved others to theirs if need be."""
    keys = np.fromiter(pairs, np.int64, len(pairs))
    one, two = (dict(zip(pairs, p.tolist(), strict=True)) for p in _places(keys))
    slot: dict[int, int] = {}
    for key in pairs:
        at = one[key]
        for _ in range(MOVES):
            if at not in slot:
                slot[at] = key
                break
            key, slot[at] = slot[at], key
            at = two[key] if at == one[key] else one[key]
        else:
            raise ValueError("the table of merges is too full")
    table_key, table_id = np.full(TABLE, -1, np.int32), np.full(TABLE, unknown, np.int16)
    for at, key in slot.items():
        table_key[at], table_id[at] = key, pairs[key]
    return table_key, table_id


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> PieceCodec:
    """The codec of a model file, built once in each worker."""
    return PieceCodec(path)


def _packed(ids) -> bytes:
    return np.fromiter(ids, "<u4").tobytes()


def skipped(key: np.ndarray, place: np.ndarray, piece: np.ndarray, bar: int) -> np.ndarray:
    """Whether a word's candidate for ``piece`` at ``place`` is skipped: a keyed hash below the bar."""
    x = key + place.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + piece.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (mix64(x) >> np.uint64(32)) < np.uint64(bar)


def document_key(seed: int, document: int) -> int:
    return int(mix64(np.array([(seed * _SPREAD + document * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)], np.uint64))[0])


def _mapped(docs: DataFrame, text: Column, key: Column, name: str, kind: T.DataType, work) -> DataFrame:
    names = kept_columns(docs, {name})
    flat = [f"c{i}" for i in range(len(names))]
    given = docs.select(*[F.col(quoted(c)).alias(f) for c, f in zip(names, flat, strict=True)], text.alias("text"), key.alias("key"))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in given.schema if f.name not in ("text", "key")], T.StructField(name, kind)])
    return given.mapInArrow(lambda batches: work(batches, flat), schema).toDF(*names, name)


def encode_documents(docs: DataFrame, model: str | None = None, rate: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ids (array<int>). A null or empty text has no ids; a null id counts as 0.

    With rate=0 the ids are those of the format's own encoder. Equal (seed, id, text) give equal ids on any
    cluster, so repeated rows have equal ids; of candidates with equal scores the leftmost is taken first. An
    empty table gives no rows. An input column ``ids`` is replaced. Whole texts are encoded. No shuffle.
    """
    prepare(docs.sparkSession)
    path = model or model_path()

    def work(batches, flat):
        import pyarrow as pa

        codec = codec_of(path)
        for batch in joined(batches, SLICE_BYTES):
            for part in pieces_of(batch, SLICE_BYTES):
                ids = [np.frombuffer(x, "<i4") for x in codec.encode_batch(part.column("text").to_pylist(), rate, seed, part.column("key").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(f) for f in flat), pa.array(ids, pa.list_(pa.int32()))], [*flat, "ids"])

    return _mapped(docs, text_of(quoted(text_col)), F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(0)), "ids", T.ArrayType(T.IntegerType()), work)


def decode_documents(rows: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``rows`` with decoded (string). Null or empty ids give an empty text. An input column ``decoded`` is replaced."""
    prepare(rows.sparkSession)
    path = model or model_path()

    def work(batches, flat):
        import pyarrow as pa

        codec = codec_of(path)
        for batch in batches:
            out = [codec.decode(x) if x else "" for x in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in flat), pa.array(out, pa.string())], [*flat, "decoded"])

    return _mapped(rows, F.lit("").alias("text"), F.col(quoted(ids_col)).cast("array<int>"), "decoded", T.StringType(), work)


def round_trip(docs: DataFrame, model: str | None = None, rate: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256 and lossless of each document, encoded and decoded in one pass.

    Nulls, empty texts, ties, repeated rows and empty tables are as in encode_documents; other columns are not read.
    """
    prepare(docs.sparkSession)
    path = model or model_path()

    def work(batches):
        import pyarrow as pa

        codec = codec_of(path)
        for batch in joined(batches, SLICE_BYTES):
            for part in pieces_of(batch, SLICE_BYTES):
                out = [[], [], [], []]
                texts, docs_ = part.column("text").to_pylist(), [d or 0 for d in part.column("id").to_pylist()]
                for text, ids in zip(texts, codec.encode_batch(texts, rate, seed, docs_), strict=True):
                    back = codec.decode(np.frombuffer(ids, "<u4"))
                    for column, x in zip(out, (len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == text), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "lossless"])

    given = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text_of(quoted(text_col)).alias("text"))
    return given.mapInArrow(work, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean")
