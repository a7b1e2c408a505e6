"""Toxic spans by a linear-chain conditional random field.

Tokens have two states, clean and toxic. Token labels for training come from document labels: words
(or first bytes of words) that are in more toxic documents than chance allows, by a test of the counts within
each language and over all of them, are the seeds, and a seed in a toxic document is a toxic token. The field
has hashed features of the word, its first and last bytes, and of both neighbours, plus transition and start
weights; training maximises the likelihood of the labels of whole documents, every token of which counts.

Scoring is exact forward-backward over each whole document: a step of a two-state chain is a fractional
linear map of the ratio of its two forward weights, so blocks of steps are composed as 2 x 2 matrices,
chained over blocks, and then expanded again, all in vectors over blocks. A document's score is a
logistic function of the sum of its tokens' squared marginals (the expected number of toxic tokens, each
weighed by its own probability) and the largest marginal; runs of tokens with marginals of one half or more are
the offending spans.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.llm.common import kept_columns, mix64, pieces_of, prepare, quoted, text_buffers, text_of

#: Labelled rows that a model is fitted on, for each label: the only bound; texts are taken whole.
SAMPLE_PER_LABEL = 500
WEIGHTS = 1 << 18
#: A seed is in at least SEED_ROWS toxic documents; of all words that are, FALSE_SEEDS at most are expected to pass by chance.
SEED_ROWS, FALSE_SEEDS = 6, 0.01
#: Steps at least, rounds over all documents at least, and tokens in a step.
STEPS, ROUNDS, BATCH_TOKENS = 80, 10, 40_000
RATE, DECAY = 0.3, 1e-4
BLOCK = 64
SLICE_BYTES = 512 << 10
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = mix64(np.arange(7001, 7257, dtype=np.uint64))
_BASE = 0x2545F4914F6CDD1D


@dataclass
class Tokens:
    """The words of many texts: byte ranges, owners, a 64-bit hash and hashes of the first and last bytes."""

    start: np.ndarray
    stop: np.ndarray
    owner: np.ndarray
    word: np.ndarray
    head: np.ndarray
    stem: np.ndarray
    tail: np.ndarray

    @classmethod
    def of(cls, body: np.ndarray, offsets: np.ndarray) -> Tokens:
        inside = _WORD[body]
        full = np.diff(offsets) > 0
        before, after = np.concatenate([[False], inside])[: len(body)], np.concatenate([inside[1:], [False]])[: len(body)]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        size = len(body) + 1
        power, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[_LOWER[body]] * power[:-1], dtype=np.uint64)])

        def hashed(a, b, kind):
            return mix64((prefix[b] - prefix[a]) * inverse[a] + np.uint64(kind))

        owner = np.searchsorted(offsets, start, "right") - 1
        return cls(start, stop, owner, hashed(start, stop, 1), hashed(start, np.minimum(stop, start + 4), 2), hashed(start, np.minimum(stop, start + 6), 6), hashed(np.maximum(start, stop - 4), stop, 3))

    def features(self) -> np.ndarray:
        """Weight numbers of each token: word, first 4 and 6 bytes, last 4, the word before and the word after (0 at ends)."""
        out = np.empty((len(self.word), 6), np.int32)
        same = self.owner[1:] == self.owner[:-1]
        left, right = np.zeros_like(self.word), np.zeros_like(self.word)
        left[1:][same] = mix64(self.word[:-1][same] + np.uint64(4))
        right[:-1][same] = mix64(self.word[1:][same] + np.uint64(5))
        for k, column in enumerate((self.word, self.head, self.stem, self.tail, left, right)):
            out[:, k] = column % np.uint64(WEIGHTS)
        return out

    @classmethod
    def of_slices(cls, body: np.ndarray, offsets: np.ndarray, size: int = 256 << 10) -> Tokens:
        """The same tokens, taken from about ``size`` bytes at a time: less memory beside the result."""
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(offsets // size)) + 1, [len(offsets) - 1]]))
        parts = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = cls.of(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            part.start, part.stop, part.owner = part.start + offsets[lo], part.stop + offsets[lo], part.owner + lo
            parts.append(part)
        return cls(*(np.concatenate([getattr(p, f.name) for p in parts]) if parts else np.zeros(0, np.int64) for f in fields(cls)))


def _chain(step: tuple[np.ndarray, ...]) -> np.ndarray:
    """Ratios x_t = (a_t + b_t x_(t-1)) / (c_t + d_t x_(t-1)) for all t, with x_(-1) = 1; exact, by blocks."""
    n = len(step[0])
    if not n:
        return np.zeros(0)
    blocks = -(-n // BLOCK)
    a, b, c, d = (np.concatenate([x, np.full(blocks * BLOCK - n, fill)]).reshape(blocks, BLOCK) for x, fill in zip(step, (0.0, 1.0, 1.0, 0.0), strict=True))
    # composition of a block's maps: x -> (A + B x) / (C + D x)
    A, B, C, D = np.zeros(blocks), np.ones(blocks), np.ones(blocks), np.zeros(blocks)
    for t in range(BLOCK):
        at, bt, ct, dt = a[:, t], b[:, t], c[:, t], d[:, t]
        A, B, C, D = at * C + bt * A, at * D + bt * B, ct * C + dt * A, ct * D + dt * B
        scale = 1 / np.maximum(np.maximum(A, B), np.maximum(C, D))
        A, B, C, D = A * scale, B * scale, C * scale, D * scale
    x, enters = 1.0, np.empty(blocks)
    for k, (ak, bk, ck, dk) in enumerate(zip(A.tolist(), B.tolist(), C.tolist(), D.tolist(), strict=True)):
        enters[k] = x
        x = (ak + bk * x) / (ck + dk * x)
    out, x = np.empty((blocks, BLOCK)), enters
    for t in range(BLOCK):
        x = (a[:, t] + b[:, t] * x) / (c[:, t] + d[:, t] * x)
        out[:, t] = x
    return out.ravel()[:n]


@dataclass
class ToxicityModel:
    weights: np.ndarray
    transition: np.ndarray  # log weights [from, to]
    begin: float  # log weight of a toxic first token
    scale: np.ndarray  # of the document score: bias, log expected toxic tokens, largest marginal

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """The probability of the toxic state for every token, over whole documents."""
        if not len(tokens.word):
            return np.zeros(0)
        first = np.concatenate([[True], tokens.owner[1:] != tokens.owner[:-1]])
        ahead, back, _ = self.forward_backward(_summed(self.weights, tokens.features()), first)
        odds = ahead * back
        return odds / (1 + odds)

    def forward_backward(self, energy: np.ndarray, first: np.ndarray):
        """Ratios of the toxic to the clean weight of each token, from the left with it and from the right without it, and its own."""
        e = np.exp(np.clip(energy, -30, 30))
        m = np.exp(self.transition)
        last = np.concatenate([first[1:], [True]])
        ahead = _chain((np.where(first, e * np.exp(self.begin), e * m[0, 1]), np.where(first, 0.0, e * m[1, 1]), np.where(first, 1.0, m[0, 0]), np.where(first, 0.0, m[1, 0])))
        # backward ratio at t from that at t + 1, read from the end: x -> (m10 + m11 e x) / (m00 + m01 e x)
        later = np.concatenate([e[1:], [1.0]])
        back = _chain(tuple(v[::-1] for v in (np.where(last, 1.0, m[1, 0]), np.where(last, 0.0, m[1, 1] * later), np.where(last, 1.0, m[0, 0]), np.where(last, 0.0, m[0, 1] * later))))[::-1]
        return ahead, back, e

    def scores(self, tokens: Tokens, documents: int, p: np.ndarray | None = None) -> np.ndarray:
        p = self.marginals(tokens) if p is None else p
        x = _document_features(p, tokens.owner, documents)
        return 1 / (1 + np.exp(-np.clip(x @ self.scale, -30, 30)))


def _summed(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The sum of each token's weights, without a table of all of them."""
    return functools.reduce(np.add, [weights[column] for column in features.T])


def _document_features(p: np.ndarray, owner: np.ndarray, documents: int) -> np.ndarray:
    mass = np.bincount(owner, weights=p * p, minlength=documents)
    top = np.zeros(documents)
    np.maximum.at(top, owner, p)
    return np.stack([np.ones(documents), np.log1p(mass), top], 1)


def _exponent(trials: np.ndarray, bad: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """-log of Hoeffding's bound on the chance of ``bad`` or more among ``trials`` draws of which ``expected`` are due."""
    p, q = np.minimum(bad / trials, 1), np.clip(expected / trials, 1e-12, 1 - 1e-12)
    apart = p * np.log(np.maximum(p, 1e-12) / q) + (1 - p) * np.log(np.maximum(1 - p, 1e-12) / (1 - q))
    return np.where(p > q, trials * apart, 0.0)


def _seeds(tokens: Tokens, toxic: np.ndarray, languages: list[str] | None = None) -> np.ndarray:
    """Whether each token has a word, or first four or six bytes, that mark toxic documents.

    Given how many documents of a language hold a word, the labels' chance decides how many of them are
    toxic. The bound on that chance is taken in each language, so that one with few toxic rows is measured
    against its own clean rows, and over all languages with the counts due in each. Equal texts count once.
    """
    marked = np.zeros(len(tokens.word), bool)
    groups, group = np.unique(np.array(languages if languages is not None else [""] * len(toxic), object).astype(str), return_inverse=True)
    content = np.zeros(len(toxic), np.uint64)
    np.add.at(content, tokens.owner, mix64(tokens.word))
    first = np.zeros(len(toxic), bool)
    first[np.unique(np.stack([content, toxic.astype(np.uint64)]), axis=1, return_index=True)[1]] = True
    for kind in (tokens.word, tokens.stem, tokens.head):
        values, code = np.unique(kind, return_inverse=True)
        rest = ~marked  # a shorter form is judged by the words that no longer form explains
        pairs = np.unique(code[rest].astype(np.int64) * len(toxic) + tokens.owner[rest])
        word, doc = pairs // len(toxic), pairs % len(toxic)
        word, doc = word[first[doc]], doc[first[doc]]
        bad_all, due_all, found = np.zeros(len(values)), np.zeros(len(values)), np.zeros(len(values), bool)
        for g in range(len(groups)):
            inside = first & (group == g)
            rows, trials = inside.sum(), (inside & toxic).sum()
            bad = np.bincount(word[(inside & toxic)[doc]], minlength=len(values))
            due = np.bincount(word[inside[doc]], minlength=len(values)) * (trials / max(1, rows))
            bad_all, due_all = bad_all + bad, due_all + due
            if trials:
                found |= _unlikely(trials, bad, due, 3 * (len(groups) + 1))
        marked |= (found | _unlikely((first & toxic).sum(), bad_all, due_all, 3 * (len(groups) + 1)))[code]
    return marked


def _unlikely(trials: int, bad: np.ndarray, due: np.ndarray, families: int) -> np.ndarray:
    """Words in SEED_ROWS toxic documents or more whose count is above chance, whatever the number of words tried."""
    tried = bad >= SEED_ROWS
    return tried & (_exponent(trials, bad, due) >= np.log(max(1, tried.sum()) * families / FALSE_SEEDS))


def fit_toxicity(body: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, languages: list[str] | None = None) -> ToxicityModel:
    """A model from labelled texts, of one language if none are named. Without both labels it scores everything by the share of toxic rows."""
    tokens = Tokens.of_slices(body, offsets)
    model = ToxicityModel(np.zeros(WEIGHTS), np.zeros((2, 2)), 0.0, np.zeros(3))
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    if not toxic.any() or toxic.all() or not len(tokens.word):
        model.begin, model.scale = -8.0, np.array([np.log(share / (1 - share)), 0.0, 0.0])
        return model
    label = _seeds(tokens, toxic, languages) & toxic[tokens.owner]
    features, first = tokens.features(), np.concatenate([[True], tokens.owner[1:] != tokens.owner[:-1]])
    # the score is fitted on marginals of documents that their field has not seen
    p, fold = np.zeros(len(label)), np.arange(len(toxic)) % 2
    for k in (0, 1):
        half, other = fold[tokens.owner] != k, fold[tokens.owner] == k
        part = ToxicityModel(np.zeros(WEIGHTS), np.zeros((2, 2)), 0.0, np.zeros(3))
        if half.any() and other.any():
            _maximise(part, features[half], label[half], first[half])
            ahead, back, _ = part.forward_backward(_summed(part.weights, features[other]), first[other])
            p[other] = ahead * back / (1 + ahead * back)
    _maximise(model, features, label, first)
    x = _document_features(p, tokens.owner, len(toxic))
    scale = np.array([-2.0, 1.0, 1.0])

    def loss(w):
        z = x @ w
        return float(np.logaddexp(0, np.where(toxic, -z, z)).sum() + 0.025 * (w * w).sum())

    for _ in range(200):  # logistic regression by Newton steps with backtracking; evidence never counts against
        p = 1 / (1 + np.exp(-np.clip(x @ scale, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        move, step, new = np.linalg.solve(hessian, x.T @ (toxic - p) - 0.05 * scale), 1.0, scale
        while step > 1e-6:
            new = scale + step * move
            new[1:] = np.maximum(new[1:], 0)
            if loss(new) < loss(scale):
                break
            step /= 2
        if step <= 1e-6 or np.abs(new - scale).max() < 1e-6:
            break
        scale = new
    model.scale = scale
    return model


def _maximise(model: ToxicityModel, features: np.ndarray, y: np.ndarray, first: np.ndarray) -> None:
    """Adaptive-step gradient ascent of the conditional likelihood of whole documents' labels; ``first`` begins documents.

    A step takes a batch of whole documents of about BATCH_TOKENS tokens; every document is in one batch of each round.
    """
    document = np.cumsum(first) - 1
    parts = max(1, len(y) // BATCH_TOKENS)
    batches = []
    for k in range(min(parts, document[-1] + 1)):
        rows = np.flatnonzero(document % parts == k)
        inner = ~first[rows][1:]
        y0, y1 = y[rows][:-1][inner], y[rows][1:][inner]
        seen = np.array([[(~y0 & ~y1).sum(), (~y0 & y1).sum()], [(y0 & ~y1).sum(), (y0 & y1).sum()]], float)
        batches.append((np.asfortranarray(features[rows]), y[rows], first[rows], inner, seen))
    params = [model.weights, model.transition, np.array([model.begin])]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for k in range(1, max(STEPS, ROUNDS * len(batches)) + 1):
        batch = batches[k % len(batches)]
        for param, grad, (one, two) in zip(params, _gradients(model, *batch), moment, strict=True):
            grad = grad / batch[2].sum() - DECAY * param
            one += 0.1 * (grad - one)
            two += 0.01 * (grad * grad - two)
            param += RATE * (one / (1 - 0.9**k)) / (np.sqrt(two / (1 - 0.99**k)) + 1e-4)
        model.begin = float(params[2][0])


def _gradients(model: ToxicityModel, features: np.ndarray, y: np.ndarray, first: np.ndarray, inner: np.ndarray, seen: np.ndarray):
    """The log likelihood's gradients by weights, transitions and the start: seen less expected counts."""
    ahead, back, e = model.forward_backward(_summed(model.weights, features), first)
    odds = ahead * back
    error = y - odds / (1 + odds)
    # pair marginals between neighbours
    m = np.exp(model.transition)
    z, r = (e[1:] * back[1:])[inner], ahead[:-1][inner]
    pair = np.stack([np.full_like(z, m[0, 0]), m[0, 1] * z, r * m[1, 0], r * m[1, 1] * z])
    pair /= pair.sum(0)
    by_weight = functools.reduce(np.add, [np.bincount(column, weights=error, minlength=WEIGHTS) for column in features.T])
    return by_weight, seen - pair.sum(1).reshape(2, 2), np.array([error[first].sum()])


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLE_PER_LABEL, lang_col: str = "lang") -> ToxicityModel:
    """A model from about ``per_label`` labelled rows of each label; null labels and rows without a document are left out.

    Languages are those of ``lang_col`` if ``docs`` has it; where it is null they are predicted from the sample's other rows.
    """
    import pyarrow as pa

    got, counts = labelled_sample(docs, labels, id_col, text_col, label_col, per_label, lang_col if lang_col in docs.columns else None)
    body, offsets = text_buffers(pa.array(got["text"].tolist(), pa.string()))
    toxic = got["label"].to_numpy() == 1
    model = fit_toxicity(body, offsets, toxic, _languages(got) if "lang" in got else None)
    if toxic.any() and not toxic.all():  # the sample's label shares are corrected to those of all labelled rows
        model.scale[0] += np.log(counts[1] / counts[0]) - np.log(toxic.sum() / (~toxic).sum())
    return model


def _languages(sample) -> list[str]:
    """The sample's languages; missing ones by a model of the others."""
    from strataline.llm.language_id import LanguageModel

    names = sample["lang"].tolist()
    missing = sample["lang"].isna().to_numpy()
    if missing.any():
        known = sample[~missing]
        predicted = iter(LanguageModel.learn(known["text"].tolist(), known["lang"].tolist()).predict(sample["text"][missing].tolist())[0])
        names = [next(predicted) if gone else name for name, gone in zip(names, missing, strict=True)]
    return names


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, lang_col: str | None = None):
    """(text, label), with lang if a column is named for it, of a bounded sample as pandas, and the numbers of all rows by label.

    For each of the labels 0 and 1 about ``per_label`` ids of ``labels`` are drawn by a hash of their id, and
    of these ``per_label`` at most with their texts; only drawn ids are broadcast to the documents. Rows
    repeated with one id and label count once, as do repeated texts of one id.
    """
    rows = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").distinct()
    rows = rows.withColumn("draw", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    wanted = F.lit(False)
    for label, count in counts.items():
        wanted |= (F.col("label") == label) & (F.col("draw") < int(min(1.0, 1.2 * per_label / count) * (1 << 30)))
    lang = [] if lang_col is None else [F.col(quoted(lang_col)).cast("string").alias("lang")]
    texts = docs.select(F.col(quoted(id_col)).alias("id"), text_of(quoted(text_col)).alias("text"), *lang)
    drawn = texts.join(F.broadcast(rows.where(wanted)), "id").dropDuplicates(["id", "label", "text"])
    at = F.row_number().over(Window.partitionBy("label").orderBy("draw", "id", "text"))
    got = drawn.withColumn("at", at).where(F.col("at") <= per_label).drop("id", "at").toPandas()
    return got.sort_values(["draw", "label", "text"]).reset_index(drop=True), counts


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("probability", T.DoubleType())]))


def tag_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score (double), predicted (1 if score >= 0.5) and spans (code-point ranges and their largest marginal).

    A null, empty or wordless text has no spans and the score of a document without toxic tokens. Neighbouring
    toxic tokens are one span. Repeated rows are scored alike; an empty table gives no rows. Input columns named
    like the three results are replaced. Whole texts are read. No shuffle; the broadcast model has a fixed size.
    """
    spark = prepare(docs.sparkSession)
    results = ("score", "predicted", "spans")
    names = kept_columns(docs, set(results))
    shared = spark.sparkContext.broadcast(model)
    flat = [f"c{i}" for i in range(len(names))]
    given = docs.select(*[F.col(quoted(c)).alias(f) for c, f in zip(names, flat, strict=True)], text_of(quoted(text_col)).alias("text"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in given.schema if f.name != "text"] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", SPANS)])

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())]))
        for batch in batches:
            for part in pieces_of(batch, SLICE_BYTES):
                body, offsets = text_buffers(part.column("text"))
                tokens = Tokens.of(body, offsets)
                p = shared.value.marginals(tokens)
                score = shared.value.scores(tokens, part.num_rows, p)
                spans = spans_of(tokens, p, body, offsets)
                yield pa.RecordBatch.from_arrays([*(part.column(f) for f in flat), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)], [*flat, *results])

    return given.mapInArrow(run, schema).toDF(*names, *results)


def spans_of(tokens: Tokens, p: np.ndarray, body: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """Runs of neighbouring tokens with marginals of one half or more, per document, in code points."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(offsets) - 1)]
    hot = np.flatnonzero(p >= 0.5)
    if not len(hot):
        return out
    begins = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])  # code points before each byte
    new = np.concatenate([[True], (hot[1:] != hot[:-1] + 1) | (tokens.owner[hot[1:]] != tokens.owner[hot[:-1]])])
    top = np.maximum.reduceat(p[hot], np.flatnonzero(new))
    ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hot) - 1]])
    for a, b, x in zip(hot[new].tolist(), hot[ends].tolist(), top.tolist(), strict=True):
        doc = int(tokens.owner[a])
        base = begins[offsets[doc]]
        out[doc].append((int(begins[tokens.start[a]] - base), int(begins[tokens.stop[b]] - base), x))
    return out
