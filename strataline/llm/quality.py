"""Document quality by a byte-level convolutional network in numpy.

FILTERS filters of WIDTH bytes slide over the whole text. A filter is a table of one number per place and
byte value, so a convolution is WIDTH table look-ups and additions. Texts are covered by overlapping
chunks of SPAN blocks of BLOCK positions, each chunk beginning STRIDE blocks after the one before. Every
filter is max-pooled over a chunk; HIDDEN units combine the pooled filters of a chunk; each unit is
max-pooled over the document's chunks, and a logistic unit turns these into one probability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.llm.common import kept_columns, pieces_of, prepare, quoted, text_buffers, text_of
from strataline.llm.toxicity import labelled_sample

#: Labelled rows that a model is fitted on, for each label: the only bound; texts are taken whole.
SAMPLE_PER_LABEL = 900
WIDTH, FILTERS, HIDDEN = 6, 16, 16
BLOCK, SPAN, STRIDE = 64, 4, 3
EPOCHS, BATCH_BYTES, RATE = 14, 120_000, 0.01
SLICE_BYTES = 512 << 10
THRESHOLD = 0.3


class ByteNetwork:
    """Parameters: conv (WIDTH, 256, FILTERS), lift (FILTERS + 1, HIDDEN), top (HIDDEN + 1)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.conv = r.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.lift = r.normal(0, 0.3, (FILTERS + 1, HIDDEN)).astype(np.float32)
        self.top = r.normal(0, 0.3, HIDDEN + 1).astype(np.float32)
        self.prior = 0.0  # log odds added for label shares that differ between sample and table

    @staticmethod
    def layout(body: np.ndarray, offsets: np.ndarray):
        """Bytes padded with zeros to whole blocks, first blocks of each chunk, and each chunk's document.

        A document has one block at least and WIDTH - 1 zeros after its last byte.
        """
        sizes = np.diff(offsets)
        blocks = -(-(sizes + WIDTH - 1) // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        padded = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
        padded[np.arange(len(body)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], sizes)] = body
        chunks = np.maximum(1, -(-(blocks - SPAN) // STRIDE) + 1)
        owner = np.repeat(np.arange(len(sizes)), chunks)
        place = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(chunks)[:-1]]), chunks)
        begin = first[owner] + place * STRIDE
        return padded, begin, np.minimum(begin + SPAN, first[owner + 1]), owner

    def _convolve(self, padded: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Responses at every position; ``tails`` are those behind a text whose windows would reach the next one and see zeros instead."""
        n = len(padded) - WIDTH
        out = self.conv[0].take(padded[:n], 0)
        for j in range(1, WIDTH):
            out += self.conv[j].take(padded[j : j + n], 0)
        out[tails] = self.conv[:, 0].sum(0)
        return out

    def forward(self, body: np.ndarray, offsets: np.ndarray, trace: bool = False):
        padded, begin, end, owner = self.layout(body, offsets)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        ends = end[np.append(starts[1:], len(owner)) - 1] * BLOCK
        tails = (ends[:, None] - np.arange(1, WIDTH)).ravel()
        c = self._convolve(padded, tails).reshape(-1, BLOCK, FILTERS)
        block = c.max(1)
        idx = np.minimum(begin[:, None] + np.arange(SPAN), end[:, None] - 1)
        best = block[idx].argmax(1)  # the block of the chunk's largest response, per filter
        pooled = np.maximum(np.take_along_axis(block[idx], best[:, None, :], 1)[:, 0], 0)
        x = np.concatenate([pooled, np.ones((len(pooled), 1), np.float32)], 1)
        hidden = np.tanh(x @ self.lift)
        top = np.maximum.reduceat(hidden, starts, 0)
        z = top @ self.top[:-1] + self.top[-1]
        if not trace:
            return z
        return z, (padded, tails, c, idx, best, pooled, x, hidden, starts, owner, top)

    def scores(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.forward(body, offsets).astype(float) + self.prior, -30, 30)))

    def gradients(self, body: np.ndarray, offsets: np.ndarray, y: np.ndarray):
        z, (padded, tails, c, idx, best, pooled, x, hidden, starts, owner, top) = self.forward(body, offsets, True)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = ((p - y) / len(y)).astype(np.float32)
        g_top = np.concatenate([top.T @ dz, [dz.sum()]])
        d_top = dz[:, None] * self.top[:-1]
        # the gradient goes to the first chunk that has the document's maximum
        d_hidden = np.zeros_like(hidden)
        hit = hidden == np.repeat(top, np.diff(np.append(starts, len(owner))), 0)
        for h in range(HIDDEN):
            at = np.flatnonzero(hit[:, h])
            _, one = np.unique(owner[at], return_index=True)
            d_hidden[at[one], h] = d_top[:, h]
        d_pre = d_hidden * (1 - hidden**2)
        g_lift = x.T @ d_pre
        d_pool = (d_pre @ self.lift[:-1].T) * (pooled > 0)
        chunk, filt = np.nonzero(d_pool)
        block = idx[chunk, best[chunk, filt]]
        place = block * BLOCK + c[block, :, filt].argmax(1)
        g_conv = np.zeros_like(self.conv)
        behind = np.isin(place, tails)
        for j in range(WIDTH):
            np.add.at(g_conv[j], (np.where(behind, 0, padded[place + j]), filt), d_pool[chunk, filt])
        return [g_conv, g_lift, g_top]

    def fit(self, body: np.ndarray, offsets: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> ByteNetwork:
        """Adam on batches of BATCH_BYTES bytes at most; both labels weigh alike if the sample has them alike."""
        if not len(y) or y.min() == y.max():
            self.lift[:], self.top[:] = 0, 0
            self.prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
            return self
        params = [self.conv, self.lift, self.top]
        one, two = ([np.zeros_like(p) for p in params] for _ in range(2))
        r, step = np.random.default_rng(seed), 0
        sizes = np.diff(offsets)
        batch = int(np.clip(sizes.sum() // 24, 1, BATCH_BYTES))  # two dozen steps an epoch on small samples
        for epoch in range(epochs):
            order = r.permutation(len(y))
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[order]) // batch)) + 1
            for rows in np.split(order, cuts):
                if not len(rows):
                    continue
                part = np.concatenate([body[offsets[i] : offsets[i + 1]] for i in rows])
                ends = np.concatenate([[0], np.cumsum(sizes[rows])])
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for p, g, a, b in zip(params, self.gradients(part, ends, y[rows]), one, two, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)
        return self


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> ByteNetwork:
    """A network from about ``per_label`` labelled rows of each label; null labels and rows without a document are left out.

    The sample's label shares are corrected to those of all labelled rows.
    """
    import pyarrow as pa

    got, counts = labelled_sample(docs, labels, id_col, text_col, label_col, per_label)
    body, offsets = text_buffers(pa.array(got["text"].tolist(), pa.string()))
    y = got["label"].to_numpy().astype(np.float32)
    network = ByteNetwork().fit(body, offsets, y)
    if len(y) and y.min() != y.max():
        network.prior = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return network


def score_quality(docs: DataFrame, network: ByteNetwork, text_col: str = "text") -> DataFrame:
    """``docs`` with score (double, the probability of label 1) and predicted (1 if score >= THRESHOLD).

    Null texts count as empty, which are scored as a chunk of zeros. A score of THRESHOLD itself is predicted 1.
    Repeated rows are scored alike; an empty table gives no rows. Input columns named like the results are replaced. Whole texts are read. No shuffle; the broadcast network has a fixed size.
    """
    spark = prepare(docs.sparkSession)
    names = kept_columns(docs, {"score", "predicted"})
    shared = spark.sparkContext.broadcast(network)
    flat = [f"c{i}" for i in range(len(names))]
    given = docs.select(*[F.col(quoted(c)).alias(f) for c, f in zip(names, flat, strict=True)], text_of(quoted(text_col)).alias("text"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in given.schema if f.name != "text"] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces_of(batch, SLICE_BYTES):
                score = shared.value.scores(*text_buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(f) for f in flat), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*flat, "score", "predicted"])

    return given.mapInArrow(run, schema).toDF(*names, "score", "predicted")
