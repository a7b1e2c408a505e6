"""Language identification by language-bitmask n-gram filters.

The model is a bit-sliced Bloom filter: a table of SLOTS language masks, each of as many 64-bit words as
the languages need (bit l mod 64 of word l div 64 belongs to language l). An n-gram is added for a language by setting the language's bit in the masks of its HASHES
slots; a look-up ANDs those masks and returns every language that holds the n-gram at once. A text's
popcount for a language is the number of its n-grams whose mask has the language's bit. Each language's
false-positive rate is known from its share of set bits, f = fill ** HASHES, and corrects the popcount c of
n n-grams to (c - f n) / (1 - f). The largest corrected popcount decides.

A language holds the n-grams that are typical of it: those that are in at least TYPICAL of its sampled
texts and make up a larger share of its n-grams than of all languages' together.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.llm.common import kept_columns, mix64, pieces_of, prepare, quoted, text_of

NGRAMS = (2, 3, 4)
SLOTS, HASHES = 1 << 18, 3
#: Texts that the model is learned from, per language: the only bound; a text is taken whole.
SAMPLE_PER_LANGUAGE = 400
TYPICAL = 0.02
#: Characters whose n-grams the learner holds at once.
LEARN_CHARS = 200_000
SLICE_BYTES = 256 << 10
UNDETERMINED = "und"


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower-case form (where that is one code point)."""
    points = 0x110000
    letter = np.fromiter((chr(i).isalpha() for i in range(points)), bool, points)
    lower = np.arange(points, dtype=np.uint32)
    for i in np.flatnonzero(letter):
        small = chr(i).lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return letter, lower


_TABLES: list = []


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter n-grams of all texts in order, and the number of n-grams of each text.

    Everything that is no letter counts as one space between words; n-grams do not reach over two words
    but see the space on either side.
    """
    if not _TABLES:
        _TABLES.extend(_letters())
    letter, lower = _TABLES
    joined = " ".join(["", *texts, ""])
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner_end = np.cumsum(sizes + 1)  # joined[1 : owner_end[0]] is the first text
    c = np.where(c < len(letter), c, 0)
    is_letter = letter[c]
    keep = is_letter | np.concatenate([[True], is_letter[:-1]])  # one space after each word, and one before each text
    keep[owner_end] = True
    code = np.where(is_letter, lower[c], 0x20)[keep].astype(np.uint64)
    at = np.searchsorted(np.flatnonzero(keep), np.concatenate([[0], owner_end]))
    out, owner = [], []
    word = code != 0x20
    for n in NGRAMS:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        value = np.full(m, n, np.uint64)
        for j in range(n):
            value = value * np.uint64(0x100000001B3) + code[j : j + m]
        inner = np.ones(m, bool)
        for j in range(1, n - 1):
            inner &= word[j : j + m]  # a space only at either end
        if n == 2:
            inner &= word[:m] | word[1 : 1 + m]
        found = np.flatnonzero(inner)
        out.append(mix64(value[found]))
        owner.append(np.searchsorted(at, found, "right") - 1)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.minimum(np.concatenate(owner), len(texts) - 1)


@dataclass
class LanguageModel:
    languages: list[str]
    masks: np.ndarray  # uint64 [mask word, slot]
    false_positive: np.ndarray  # per language

    @staticmethod
    def slots(grams: np.ndarray) -> list[np.ndarray]:
        step = (grams >> np.uint64(32)) | np.uint64(1)
        return [((grams + np.uint64(j) * step) % np.uint64(SLOTS)).astype(np.int64) for j in range(HASHES)]

    @classmethod
    def learn(cls, texts: list[str], languages: list[str]) -> LanguageModel:
        names = sorted(set(languages))
        masks = np.zeros((-(-len(names) // 64), SLOTS), np.uint64)
        if not names:
            return cls([], masks, np.zeros(0))
        by = [[t for t, x in zip(texts, languages, strict=True) if x == name] for name in names]
        kept, shares = [], []  # of each language: its n-grams, what share of its n-grams each is, and of its texts
        for mine in by:
            values, count, rows = _counted(mine)
            kept.append((values, count / max(1, count.sum()), rows / len(mine)))
            shares.append(values)
        values, code = np.unique(np.concatenate(shares), return_inverse=True)
        mean = np.bincount(code, weights=np.concatenate([share for _, share, _ in kept]), minlength=len(values)) / len(names)
        fill = np.zeros(len(names))
        for k, (grams, share, rows) in enumerate(kept):
            typical = grams[(rows >= TYPICAL) & (share > mean[np.searchsorted(values, grams)])] if len(names) > 1 else grams
            bit = np.uint64(1 << (k % 64))
            for slot in cls.slots(typical):
                masks[k // 64, slot] |= bit
            fill[k] = (masks[k // 64] & bit != 0).mean()
        return cls(names, masks, fill**HASHES)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, coverage) per text: the winner's share of all corrected popcounts, and of the n-grams."""
        if not self.languages or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        grams, owner = ngrams(texts)
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        slots, hits = self.slots(grams), np.zeros((len(self.languages), len(texts)))
        for word, masks in enumerate(self.masks):
            held = functools.reduce(np.bitwise_and, [masks[slot] for slot in slots])
            for k in range(64 * word, min(len(self.languages), 64 * word + 64)):
                hits[k] = np.bincount(owner, weights=((held >> np.uint64(k % 64)) & np.uint64(1)).astype(float), minlength=len(texts))
        right = np.maximum(0.0, (hits - self.false_positive[:, None] * n) / (1 - self.false_positive[:, None]))
        best = right.argmax(0)
        top, total = right[best, np.arange(len(texts))], right.sum(0)
        score = np.where(total > 0, top / np.maximum(total, 1e-12), 0.0)
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, n > 0, strict=True)], np.where(n > 0, score, 0.0), np.where(n > 0, np.minimum(1.0, top / np.maximum(n, 1)), 0.0)


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of texts, how often each occurs and in how many texts; slices bound the memory."""
    found = []
    sizes = np.cumsum([len(t) for t in texts]) // LEARN_CHARS
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
        grams, owner = ngrams([texts[i] for i in part])
        values, code = np.unique(grams, return_inverse=True)
        pairs = np.unique(code.astype(np.int64) * len(part) + owner)
        found.append((values, np.bincount(code, minlength=len(values)), np.bincount(pairs // len(part), minlength=len(values))))
    values, code = np.unique(np.concatenate([v for v, _, _ in found]), return_inverse=True)
    return values, *(np.bincount(code, weights=np.concatenate([f[j] for f in found]), minlength=len(values)) for j in (1, 2))


def learn_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """A model of every language in ``lang_col`` from at most ``per_language`` distinct texts of each.

    The texts are those with the smallest hashes of their content, so repeated rows and ties change nothing;
    rows without text or language are left out. An empty table gives a model without languages, by which
    everything is undetermined.
    """
    rows = labelled.select(F.col(quoted(text_col)).cast("string").alias("text"), F.col(quoted(lang_col)).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    # one row a language: about how many different texts it has
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    if not counts:
        return LanguageModel.learn([], [])
    bars = labelled.sparkSession.createDataFrame([(x, int(min(1.0, 2 * per_language / n) * (1 << 30))) for x, n in counts.items()], "lang string, bar long")
    # about twice as many texts as needed pass the bar; copies are dropped where they lie
    drawn = rows.join(F.broadcast(bars), "lang").where("draw < bar").groupBy("lang", "draw", "text").count()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    got = drawn.withColumn("at", first).where(F.col("at") <= per_language).select("text", "lang", "draw").toPandas().sort_values(["lang", "draw", "text"])
    return LanguageModel.learn(got["text"].tolist(), got["lang"].tolist())


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and coverage (double); input columns of these names are replaced.

    Texts that are null, empty or hold no letter are ``und`` with score 0. Of equal counts the alphabetically
    first language wins. Repeated rows are judged alike; an empty table gives no rows. Whole texts are read.
    No shuffle; the size of the broadcast model is SLOTS masks, whatever the corpus.
    """
    spark = prepare(docs.sparkSession)
    names = kept_columns(docs, {"lang_pred", "score", "coverage"})
    shared = spark.sparkContext.broadcast(model)
    flat = [f"c{i}" for i in range(len(names))]
    given = docs.select(*[F.col(quoted(c)).alias(f) for c, f in zip(names, flat, strict=True)], text_of(quoted(text_col)).alias("text"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in given.schema if f.name != "text"] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("coverage", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        predict = shared.value.predict
        for batch in batches:
            for part in pieces_of(batch, SLICE_BYTES):
                lang, score, coverage = predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(f) for f in flat), pa.array(lang, pa.string()), pa.array(score), pa.array(coverage)], [*flat, "lang_pred", "score", "coverage"])

    return given.mapInArrow(run, schema).toDF(*names, "lang_pred", "score", "coverage")
