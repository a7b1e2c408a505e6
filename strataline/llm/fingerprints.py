"""Document fingerprints from closed syncmers, with built-in functions only.

A text is its words between K - 1 marks for its start and as many for its end; its k-mers are the runs of K
of these. A k-mer is chosen when the smallest hash among its inner runs of S words is that of its first or
its last inner run. The choice depends on the k-mer alone (it is free of context), so an edit moves no other
anchor, and every K - S consecutive k-mers hold one. The fingerprint is the set of the hashes of all chosen
k-mers, whatever their number; the likeness of two fingerprints is the Jaccard index of these sets. Anchors
keep their positions, so that texts can also be laid beside each other (``aligned``): of the anchors that
both hold, those at the most common distance of positions show how far one passage is shifted in the other.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import kept_columns, prepare, quoted, text_of

K, S = 5, 2
#: Rows in one run of neighbouring ids, about, and the most runs there are.
RUN_ROWS, RUNS = 1500, 100_000
#: What stands before and after the words of a text: no word, as words hold no spaces.
START, END = " <", " >"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column, k: int = K) -> Column:
    """The words of a text between k - 1 marks on either side; nothing for a text without words."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    marks = lambda x: F.array(*[F.lit(x)] * (k - 1))
    return _let(words, lambda w: F.when(F.size(w) > 0, F.concat(marks(START), w, marks(END))).otherwise(w))


def _run_hash(h: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(h, at + j) for j in range(n)])


def _positions(h: Column, k: int, s: int) -> Column:
    """Zero-based places of the closed syncmers in an array of token hashes of at least k entries."""
    inner = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: _run_hash(h, i, s))
    last = k - s

    def closed(m: Column, i: Column) -> Column:
        edges = F.least(F.get(m, i), F.get(m, i + last))
        return edges <= F.least(*[F.get(m, i + j) for j in range(1, last)]) if last > 2 else edges <= F.get(m, i + 1) if last == 2 else F.lit(True)

    return _let(inner, lambda m: F.filter(F.sequence(F.lit(0), F.size(h) - k), lambda i: closed(m, i)))


def syncmer_anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<position, hash>> of a text's closed syncmers in order; a position counts words from 0 and is negative for k-mers that begin with marks.

    A text in which no k-mer is chosen, as one of white space only, has one anchor at position -k that stands
    for the whole text; an empty or null text has none.
    """
    whole = F.when(F.length(text) > 0, F.array(F.struct(F.lit(-k).alias("position"), F.hash(text).alias("hash")))).otherwise(F.array().cast("array<struct<position:int,hash:int>>"))
    hashes = F.transform(tokens(text, k), lambda w: F.xxhash64(w))

    def anchors(h: Column) -> Column:
        found = F.transform(_positions(h, k, s), lambda i: F.struct((i - (k - 1)).alias("position"), F.hash(*[F.get(h, i + j) for j in range(k)]).alias("hash")))
        return F.when(F.size(h) >= k, found).otherwise(F.array().cast("array<struct<position:int,hash:int>>"))

    return _let(_let(hashes, anchors), lambda a: F.when(F.size(a) > 0, a).otherwise(whole))


def anchor_set(anchors: Column) -> Column:
    """The distinct hashes of anchors, ascending: array<int>."""
    return F.sort_array(F.array_distinct(F.transform(anchors, lambda a: a["hash"])))


def as_string(hashes: Column) -> Column:
    return F.concat_ws("", F.transform(hashes, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard index of two sets of hashes, 0 to 1; two empty ones are alike, an empty and another not."""
    both = _let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both).cast("double")


def placed(anchors: Column) -> Column:
    """Anchors as numbers, position times 2**32 plus hash: array<long>, which sets of anchors are compared by."""
    return F.transform(anchors, lambda a: F.shiftleft(a["position"].cast("long"), 32) + a["hash"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def in_place(a: Column, b: Column) -> Column:
    """The share of the placed anchors of ``a`` that ``b`` has too, at the same position: 1 for a common beginning, 0 without anchors."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).otherwise(F.lit(0.0)).cast("double")


def aligned(pairs: DataFrame, a_col: str = "a", b_col: str = "b") -> DataFrame:
    """``pairs`` with shift and matched: how far most anchors of ``a`` that ``b`` also has are moved in it, and how many are moved so.

    The named columns are texts. Anchors are matched by hash; of one that occurs repeatedly in a text the first
    counts, and of equally common shifts the smallest. Without a match shift is null and matched 0; null texts
    count as empty. Everything happens within a row by sorting: no shuffle.
    """
    side = lambda c, k: F.sort_array(F.transform(syncmer_anchors(text_of(quoted(c))), lambda x: F.struct(x["hash"].alias("hash"), F.lit(k).alias("side"), x["position"].alias("position"))))
    firsts = lambda x: _let(x, lambda t: F.filter(t, lambda y, i: (i == 0) | (F.get(t, i - 1)["hash"] != y["hash"])))
    both = F.sort_array(F.concat(firsts(side(a_col, 0)), firsts(side(b_col, 1))))
    met = _let(both, lambda t: F.transform(F.filter(F.transform(t, lambda y, i: F.struct(y.alias("x"), F.get(t, i - 1).alias("w"))), lambda z: (z["x"]["side"] == 1) & (z["w"]["side"] == 0) & (z["w"]["hash"] == z["x"]["hash"])), lambda z: z["x"]["position"] - z["w"]["position"]))

    def votes(d: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda i: (i == 0) | (F.get(d, i - 1) != F.get(d, i)))
        return _let(begins, lambda t: F.transform(t, lambda i, j: F.struct((i - F.coalesce(F.get(t, j + 1), F.size(d))).alias("n"), F.get(d, i).alias("shift"))))

    best = F.array_min(_let(F.sort_array(met), lambda d: F.when(F.size(d) > 0, votes(d))))
    kept = [F.col(quoted(c)) for c in kept_columns(pairs, {"shift", "matched"})]
    return pairs.withColumn("__al_best", best).select(*kept, F.col("__al_best.shift").alias("shift"), F.coalesce(-F.col("__al_best.n"), F.lit(0)).alias("matched"))


def fingerprint_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns fingerprint (string) and anchors (array<struct<position, hash>>).

    Nulls count as empty texts, which have an empty fingerprint. Equal texts, as in repeated rows, have equal
    fingerprints. Of equal inner hashes at both edges and within, the edge counts. An empty table gives no rows.
    Input columns of these names are replaced. No shuffle.
    """
    anchors = syncmer_anchors(text_of(quoted(text_col)))
    rows = docs.select(*[F.col(quoted(c)) for c in kept_columns(docs, {"fingerprint", "anchors"})], anchors.alias("anchors"))
    return rows.withColumn("fingerprint", as_string(anchor_set(F.col("anchors"))))


def _runs(rows: DataFrame, runs: int) -> list[int]:
    """The ids at which runs of neighbouring ids begin, but for the first: sampled quantiles, so that runs are even for any ids."""
    if runs < 2:
        return []
    found = rows.where("id IS NOT NULL").agg(F.percentile_approx("id", [k / runs for k in range(1, runs)], 3 * runs)).first()[0]
    return sorted(set(found or []))


def with_next(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (id long, ...) with next_<name> of the row that follows in descending id; the first follows the last.

    Rows are dealt to runs of neighbouring ids by one shuffle. A run's first row is also put at the end
    of the run before it, so that no row looks beyond its run. Runs hold about equally many rows, but for rows
    repeated with one id, which the window spills. Null ids come last; equal ids are ordered by the named columns.
    """
    runs = max(1, min(RUNS, rows.count() // RUN_ROWS))
    begins = _runs(rows, runs)  # at most RUNS numbers
    found = F.lit(0) if not begins else _run_of(F.col("id"), begins)
    rows = rows.withColumn("__fp_key", F.coalesce("id", F.lit(-(1 << 63)))).withColumn("__fp_in", F.when(F.col("id").isNull(), -1).otherwise(found))
    # at most RUNS + 1 rows: the first id of each run, and the run that it closes
    heads = rows.groupBy("__fp_in").agg(F.max("__fp_key").alias("__fp_key"))
    order = Window.orderBy(F.col("__fp_in").desc())
    heads = heads.select("__fp_key", F.coalesce(F.lag("__fp_in").over(order), F.min("__fp_in").over(Window.partitionBy())).alias("__fp_closes"))
    rows = rows.join(F.broadcast(heads), "__fp_key", "left")
    closing = F.when(F.col("__fp_closes").isNull(), F.array("__fp_in")).otherwise(F.array("__fp_in", "__fp_closes"))
    placed = rows.select("*", F.posexplode(closing).alias("__fp_copy", "__fp_run")).drop("__fp_closes", "__fp_in")
    step = Window.partitionBy("__fp_run").orderBy("__fp_copy", F.col("__fp_key").desc(), *names)
    return placed.select("*", *[F.lead(n).over(step).alias(f"next_{n}") for n in names]).where("__fp_copy = 0").drop("__fp_copy", "__fp_run", "__fp_key")


def _run_of(id_: Column, begins: list[int]) -> Column:
    """How many of the sorted ``begins`` are not above the id: a binary search in a constant array."""
    steps, reach = F.lit(0), 1
    table = F.split(F.lit(",".join(map(str, begins))), ",").cast("array<bigint>")  # folded into one constant
    while reach * 2 <= len(begins):
        reach *= 2
    while reach:
        steps = _let(steps, functools.partial(lambda n, at: at + F.when(F.coalesce(F.get(table, at + n - 1) <= id_, F.lit(False)), n).otherwise(0), reach))
        reach //= 2
    return steps


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next document's, in descending id. in_place is the share of the document's anchors that stand at the
    same positions in the edited text. A table of one document is its own next. A null text is empty, null ids
    come last, rows repeated with one id follow each other by text. An empty table gives no rows; other columns
    of the input are not read.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text_of(quoted(text_col)).alias("text"))
    hashes = lambda x: F.sort_array(F.array_distinct(F.transform(x, lambda y: F.shiftright(F.shiftleft(y, 32), 32).cast("int"))))
    rows = with_next(base.withColumn("anchors", placed(syncmer_anchors(F.col("text")))), ["text", "anchors"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(length(text) - floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "anchors", "next_anchors", edited.alias("edited"))
    rows = rows.select("id", "n_chars", "anchors", hashes(F.col("anchors")).alias("mark"), hashes(F.col("next_anchors")).alias("next_mark"), F.sha2("edited", 256).alias("edited_sha256"), placed(syncmer_anchors(F.col("edited"))).alias("edited_anchors"))
    rows = rows.withColumn("edited_mark", hashes(F.col("edited_anchors")))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_string(F.col("mark")).alias("fingerprint"), as_string(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"), likeness(F.col("mark"), F.col("next_mark")).alias("near_next"), in_place(F.col("anchors"), F.col("edited_anchors")).alias("in_place"),
    )
