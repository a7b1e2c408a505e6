"""N-gram Jaccard self-join by parity sketches.

A document's set holds the 64-bit hashes of its distinct word n-grams. Its parity sketch has ``m``
segments; every n-gram is XOR-ed into the segment that its hash chooses. Shared n-grams cancel in the
XOR of two sketches, so sketches differ in at most as many places as the sets do: their distance is a
lower bound of the symmetric difference.

Pairs with Jaccard >= t differ in at most d = (1 - t)/(1 + t) * (size + size') n-grams. Differing n-grams
touch at most d of the m segments, so at least s - d of a set's s non-empty segments agree between the
two (pigeonhole). Segments are ordered by one global order, coldest first (the smallest count-min
estimate among the segment's n-grams, then the segment's value), and each set keeps its first d + 1
segments; two sets that agree in s - d segments then share a kept one. Sets with s <= d keep all segments
and one common mark. No link can be missed, and passages that many documents share stay out of the index
wherever the theorem allows.

``m`` depends on a size band (lo <= size < 2 lo). A set joins its own band, and the band below if it can
be the larger partner there (size <= 1.25 lo' for the upper end lo' of that band).

Segments shared by several sets make candidates. Candidates are verified in blocks: each set goes to the
cluster of the smallest set it shares a segment with, clusters are cut into blocks of at most
BLOCK_SETS sets, and blocks that share a segment are compared as a whole with one sparse product of their
n-gram incidence. So a group of g similar sets costs (g / BLOCK_SETS)^2 small tasks; its pairs are never
rows. A verified block pair returns each set's number of links and a spanning star of its links, and
connected components follow from those stars.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm import common
from strataline.llm.common import connected_components, looked_up, maybe_broadcast, mix64, pieces_of, prepare, quoted, text_buffers, text_of, written

NGRAM = 5
#: Similarity in hundredths, compared in whole numbers: 100 * intersection >= SIMILAR * union.
SIMILAR = 80
BLOCK_SETS = 192
#: Segments that at least so many documents may hold are grouped in two steps, by parts.
HOT_BUCKET, PARTS = 100_000, 64
#: Names of sets that are tried until no two sets share one.
SALTS = 8
#: Slots of the count-min sketch that orders segments; its size does not depend on the data.
HEAT_SLOTS = 1 << 20
SLICE_BYTES = 1 << 20
#: Bits of the dense parity sketch that rejects pairs before sets are intersected.
DENSE_BITS = 512
#: Bytes of a row that says which pair of blocks wants a text, and passes over the texts at most: in each, the wanted rows are small enough to be broadcast.
WANTED_BYTES, PASSES = 48, 64
#: Columns of one n-gram incidence product.
PRODUCT_COLUMNS = 4096

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd factors by a word's place in its n-gram (up to 64 words); those of whole short texts follow.
_PLACES = mix64(np.arange(1000, 1128, dtype=np.uint64)) | np.uint64(1)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


@functools.lru_cache(maxsize=1)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _power_table(1 << max(16, (n - 1).bit_length()))


def ngram_sets(body: np.ndarray, offsets: np.ndarray, n: int = NGRAM):
    """The sorted distinct n-gram hashes of each text, from UTF-8 bytes and offsets.

    A-Z are lower-cased, words are runs of bytes other than space and 0x09-0x0D. A text of fewer than n
    words has its whole word sequence as its only n-gram, a text without words has none.
    """
    docs = len(offsets) - 1
    if not len(body):
        return [np.zeros(0, np.uint64)] * docs
    inside = ~_SPACES[body]
    full = np.diff(offsets) > 0
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    before[offsets[:-1][full]] = False  # words end where texts end
    after[offsets[1:][full] - 1] = False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    # a word's hash: sum of byte codes times powers of an odd base, taken from prefix sums and scaled to the word's start
    power, inverse = _powers(len(body) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[_LOWER[body]] * power[: len(body)], dtype=np.uint64)])
    words = mix64((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(np.uint64))
    at = np.searchsorted(start, offsets)
    count = np.diff(at)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        grams += words[j : j + len(grams)] * _PLACES[j]
    grams = mix64(grams)
    out = []
    for k in range(docs):
        c, a = count[k], at[k]
        if c >= n:
            s = np.sort(grams[a : a + c - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif c:
            out.append(mix64(np.array([(words[a : a + c] * _PLACES[64 : 64 + c]).sum() + np.uint64(c)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray, salt: int = 0) -> int:
    """A 64-bit name of a set. Equal sets have equal names; whether different ones do is found out by a second name."""
    return int(np.bitwise_xor.reduce(mix64(s + np.uint64(0x51ED270B + (salt << 32)))).view(np.int64)) if len(s) else 0


def most_different(size: int, other: int, similar: int = SIMILAR) -> int:
    """The largest symmetric difference of two linked sets of these sizes."""
    return (size + other) * (100 - similar) // (100 + similar)


def band_of(size: int) -> int:
    return size.bit_length() - 1


def segment_keys(s: np.ndarray, heat: np.ndarray, similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """The kept segment values of a set in the bands that it joins, as 64-bit keys, and how many documents may hold each."""
    size = len(s)
    out, warm = [], []
    own = band_of(size)
    for band in (own, own - 1):
        low = 1 << max(band, 0)
        if band < own and (band < 0 or similar * size > 100 * (2 * low - 1)):
            continue  # no set of the band below is large enough for a link
        top = min(2 * low - 1, size) if band < own else size
        d = most_different(size, size * 100 // similar if band == own else top, similar)
        m = np.uint64(low + (low >> 2) + 4)
        segment = (s >> np.uint64(17)) % m
        order = np.argsort(segment, kind="stable")
        segment, inner = segment[order], s[order]
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        value = np.bitwise_xor.reduceat(mix64(inner ^ np.uint64(band)), starts)
        value = mix64(value + segment[starts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band))
        warmth = np.minimum.reduceat(heat[(inner & np.uint64(len(heat) - 1)).astype(np.int64)], starts)
        if len(starts) > d:
            kept = np.lexsort((value, warmth))[: d + 1]
            value, warmth = value[kept], warmth[kept]
        else:
            value = np.append(value, mix64(np.array([band + (1 << 40)], np.uint64)))
            warmth = np.append(warmth, HOT_BUCKET)
        out.append(value)
        warm.append(warmth)
    return np.concatenate(out), np.concatenate(warm)


def links_of_block(sets: list[np.ndarray], split: int, similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets: all pairs if split is 0, else those between sets[:split] and sets[split:]."""
    k = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    a, b = np.triu_indices(k, 1) if split == 0 else (x.ravel() for x in np.meshgrid(np.arange(split), np.arange(split, k), indexing="ij"))
    bound = (size[a] + size[b]) * (100 - similar) // (100 + similar)
    ok = np.abs(size[a] - size[b]) <= bound
    a, b, bound = a[ok], b[ok], bound[ok]
    if not len(a):
        return a, b
    if k > 2:  # parity sketches: their Hamming distance never exceeds the symmetric difference
        bits = np.stack([np.bincount(((s >> np.uint64(40)) % np.uint64(DENSE_BITS)).astype(np.int64), minlength=DENSE_BITS) & 1 for s in sets]).astype(np.float32)
        both = bits @ bits.T
        ones = np.diag(both)
        ok = (ones[a] + ones[b] - 2 * both[a, b]) <= bound
        a, b = a[ok], b[ok]
        if not len(a):
            return a, b
    live = np.unique(np.concatenate([a, b]))
    where = np.full(k, -1)
    where[live] = np.arange(len(live))
    values = np.concatenate([sets[i] for i in live])
    owner = np.repeat(np.arange(len(live)), size[live])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    gram = np.cumsum(new) - 1
    shared = np.bincount(gram)[gram] > 1
    gram, owner = gram[shared], owner[shared]
    common = np.zeros((len(live), len(live)), np.float32)
    if len(gram):
        gram = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
        cuts = np.searchsorted(gram, np.arange(0, gram[-1] + PRODUCT_COLUMNS, PRODUCT_COLUMNS))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = np.zeros((len(live), min(PRODUCT_COLUMNS, gram[hi - 1] - gram[lo] + 1)), np.float32)
            part[owner[lo:hi], gram[lo:hi] - gram[lo]] = 1
            common += part @ part.T
    inter = common[where[a], where[b]].astype(np.int64)
    ok = 100 * inter >= similar * (size[a] + size[b] - inter)
    return a[ok], b[ok]


def _heat(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents' n-grams fall in each of HEAT_SLOTS slots; the driver gets HEAT_SLOTS numbers, whatever the corpus."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(HEAT_SLOTS, np.int64)
        for batch in batches:
            for part in pieces_of(batch, SLICE_BYTES):
                sets = [s for s in ngram_sets(*text_buffers(part.column("text")), n) if len(s)]
                if sets:
                    total += np.bincount((np.concatenate(sets) & np.uint64(HEAT_SLOTS - 1)).astype(np.int64), minlength=HEAT_SLOTS)
        used = np.flatnonzero(total)
        for lo in range(0, len(used), 1 << 16):
            slot = used[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], ["slot", "n"])

    got = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    heat = np.zeros(HEAT_SLOTS, np.int64)
    heat[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return np.minimum(heat, (1 << 31) - 1).astype(np.int32)


def _sets_table(docs: DataFrame, n: int, salt: int) -> DataFrame:
    """(doc, sid, again, size) of every document; again is a second name of its set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces_of(batch, SLICE_BYTES):
                sets = ngram_sets(*text_buffers(part.column("text")), n)
                ids, again = ([set_id(s, k) for s in sets] for k in (salt, salt + SALTS))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(ids, pa.int64()), pa.array(again, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc", "sid", "again", "size"])

    return docs.mapInArrow(run, "doc long, sid long, again long, size long")


def _named_sets(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """The sets of all documents, one row a set with its smallest document, and the salt under which no two sets share a name."""
    for salt in range(SALTS):
        sets = written(_sets_table(docs, n, salt), "jaccard-sets")
        named = sets.where("size > 0").groupBy("sid").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.max("size").alias("size"), (F.min("again") != F.max("again")).alias("clash"))
        named = written(named, "jaccard-names")
        if not named.where("clash").limit(1).count():
            return sets.drop("again"), named.drop("clash"), salt
    raise RuntimeError("different sets kept sharing names")


def _keys(docs: DataFrame, n: int, heat, similar: int, salt: int) -> DataFrame:
    """(key, sid, hot): the kept segments of every non-empty set. A key that isn't hot has fewer than HOT_BUCKET rows."""

    def run(batches):
        import pyarrow as pa

        warm = heat.value
        for batch in batches:
            for part in pieces_of(batch, SLICE_BYTES):
                sets = [s for s in ngram_sets(*text_buffers(part.column("text")), n) if len(s)]
                if sets:
                    keys, warmth = zip(*(segment_keys(s, warm, similar) for s in sets), strict=True)
                    owner = np.repeat(np.array([set_id(s, salt) for s in sets], np.int64), [len(k) for k in keys])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(owner), pa.array(np.concatenate(warmth) >= HOT_BUCKET)], ["key", "sid", "hot"])

    return docs.select("text").mapInArrow(run, "key long, sid long, hot boolean")


def _members(docs: DataFrame, n: int, heat, similar: int, salt: int) -> DataFrame:
    """(key, sid, low): the rows of _keys whose key belongs to several sets; low is the smallest of them."""
    # texts are read once: hot keys are cut into parts, whose smallest sets are compared afterwards
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("sid"), F.lit(PARTS))).otherwise(0)
    same = Window.partitionBy("key", part)  # bounded: see hot
    found = _keys(docs, n, heat, similar, salt).select("key", "sid", "hot", F.min("sid").over(same).alias("low"), F.max("sid").over(same).alias("high"))
    found = written(found.where("hot OR low <> high").distinct(), "jaccard-members")
    hot = found.where("hot")
    bucket = hot.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("key", "low")
    return found.where("NOT hot").select("key", "sid", "low").unionByName(hot.select("key", "sid").join(bucket, "key"))


def _verified(pairs: DataFrame, n: int, similar: int, salt: int) -> DataFrame:
    """Links within each block pair. Rows of a pair are adjacent; a pair has at most 2 * BLOCK_SETS rows."""

    def run(batches):
        import pyarrow as pa

        def emit(rows):
            seen: dict[tuple[int, int], tuple] = {}  # a document that is repeated counts once
            for r in rows:
                seen.setdefault((r[1], r[3]), r)
            side = [seen[k] for k in sorted(seen)]
            sets = [r[6] for r in side]
            split = sum(r[1] == 0 for r in side)
            a, b = links_of_block(sets, 0 if split == len(side) else split, similar)
            if not len(a):
                return []
            copies = np.array([r[5] for r in side], np.int64)
            links = np.zeros(len(side), np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = list(range(len(side)))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            return [(side[i][4], side[find(i)][4], int(links[i])) for i in np.flatnonzero(links).tolist()]

        held, last, out = [], None, []
        for batch in batches:
            for part in pieces_of(batch, SLICE_BYTES):
                sets = ngram_sets(*text_buffers(part.column("text")), n)
                for row in zip(*(part.column(c).to_pylist() for c in ("one", "side", "two", "sid", "doc", "copies")), sets, strict=True):
                    if set_id(row[6], salt) != row[3]:
                        continue  # another text under the same id
                    if (row[0], row[2]) != last:
                        out += emit(held)
                        held, last = [], (row[0], row[2])
                    held.append(row)
                if len(out) > 2000:
                    yield _links(pa, out)
                    out = []
        out += emit(held)
        if out:
            yield _links(pa, out)

    return pairs.mapInArrow(run, "a long, b long, links long")


def _links(pa, out):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "links"])


def passes_for(rows: int) -> int:
    """In how many passes over the texts ``rows`` wanted rows are verified."""
    return max(1, min(PASSES, -(-rows * WANTED_BYTES // max(1, common.BROADCAST_BYTES))))


def _links_by_pass(docs: DataFrame, wanted: DataFrame, n: int, similar: int, salt: int) -> DataFrame:
    """The verified links of all block pairs, some pairs at a time.

    Texts are picked by a broadcast of the rows that want them, so those of other documents are never shuffled, and the texts
    that one pass has dealt out are gone when the next begins. A pair's rows are all in one pass.
    """
    spark, rows, out = docs.sparkSession, wanted.count(), []
    passes = passes_for(rows)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(passes):
        some = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("one", "two"), F.lit(passes)) == k)
        # texts move, not their n-grams: they are a fraction of the size
        dealt = docs.join(maybe_broadcast(some, rows // passes, WANTED_BYTES), "doc").repartition(tasks, "one", "two").sortWithinPartitions("one", "two", "side")
        out.append(written(_verified(dealt, n, similar, salt), "jaccard-links"))
    return functools.reduce(DataFrame.unionByName, out)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, similar: int = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links.

    n_links counts the other rows within the similarity, equal ones included. Texts without words are
    empty and linked with nothing; a null text is empty. A row with a null id has near links only through an
    equal text that has an id, else its component is null. Rows repeated with one id are counted apart and
    share their component. An empty table gives no rows. Only the two named columns are read.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), text_of(quoted(text_col)).alias("text"))
    sets, named, salt = _named_sets(docs, n)
    heat = spark.sparkContext.broadcast(_heat(docs, n))
    member = _members(docs, n, heat, similar, salt)

    home = member.groupBy("sid").agg(F.min("low").alias("home"))
    blocks = home.groupBy("home").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK_SETS * F.lit(1.25)).cast("long"))
    place = written(home.join(blocks, "home").select("sid", F.when(F.col("n") <= BLOCK_SETS, F.xxhash64("home")).otherwise(F.xxhash64("home", F.pmod(F.xxhash64("sid"), "parts"))).alias("block")), "jaccard-blocks")

    spread = member.select("key", "sid").join(place, "sid").select("key", "block").distinct()
    mixed = spread.groupBy("key").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x <> y").select("key")
    spread = spread.join(mixed, "key", "left_semi")
    cross = spread.alias("p").join(spread.alias("q"), F.expr("p.key = q.key AND p.block < q.block")).select(F.col("p.block").alias("one"), F.col("q.block").alias("two")).distinct()
    own = place.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select(F.col("block").alias("one"), F.col("block").alias("two"))
    pairs = written(own.unionByName(cross), "jaccard-pairs")

    ends = pairs.select("one", "two", F.lit(0).alias("side"), F.col("one").alias("block")).unionByName(pairs.where("one <> two").select("one", "two", F.lit(1).alias("side"), F.col("two").alias("block")))
    wanted = written(place.join(named, "sid").join(ends, "block").select("one", "two", "side", "sid", "doc", "copies"), "jaccard-wanted")
    links = _links_by_pass(docs, wanted, n, similar, salt)

    labels = connected_components(links.select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    classes = named.join(counts, F.col("a") == F.col("doc"), "left").join(labels, F.col("node") == F.col("doc"), "left")
    classes = classes.where("copies > 1 OR links IS NOT NULL").select("sid", F.coalesce("label", "doc").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    classes = written(classes, "jaccard-classes")
    return looked_up(sets, classes, "sid", 32).select(
        F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc")).alias("component_id"), F.when(F.col("size") > 0, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links")
    )
