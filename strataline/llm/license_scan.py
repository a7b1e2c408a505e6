"""Licence scans with built-in functions: sparse TF-IDF cosine to templates, and inheritance along paths.

Segments are compared with licence templates: the whole text of a licence file (by its name) with whole
templates; every line that holds an anchor term (a header), and windows, with the templates' first OPENING
words. A window is cut for each anchor word of a text and each template with an equal anchor as its first: as
many words before and after it as the opening has, across line ends, compared with that opening. So neither
words beside a header nor line ends within it dilute its score. Term weights are (1 + ln tf) * idf, with idf
from the document counts over the whole texts of the corpus, for the templates' terms and for all others in
segments. A file's own licence is the best template at or above THRESHOLD; how far it leads the next licence
is told beside it. Files without one inherit from the licence files of the nearest ancestor directory: every
directory is joined with each of its ancestors, so the prefix search is an equi-join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import kept_columns, looked_up, maybe_broadcast, prepare, quoted, text_of, written
from strataline.llm.license_templates import TEMPLATES

THRESHOLD = 0.5
#: Words of a template that lines and windows are compared with.
OPENING = 100
#: A header line holds one of these; every template does.
ANCHORS = r"(?i)licen[cs]|copyright|permission|redistribut|public domain|all rights reserved"
LICENCE_FILE = r"(?i)^(un)?licen[cs]e|^copying|^copyright|^notice"
_WORDS = r"[^a-z0-9]+"
#: The same anchors in words: the last ones span several.
_ANCHOR_WORDS = ("licen[cs]", "copyright", "permission", "redistribut")
_ANCHOR_RUNS = (("public", "domain"), ("all", "rights", "reserved"))
_WINDOWED = r"(?i)licen[cs]|copyright|permission|redistribut|public[^a-z0-9]+domain|all[^a-z0-9]+rights[^a-z0-9]+reserved"


def _words_of(text: str) -> list[str]:
    return [w for w in re.split(_WORDS, text.lower()) if w]


def _openings(templates) -> list[tuple[int, str, bool, list[str]]]:
    """(template, licence, whole, words): the opening of every template, and the whole of those that are longer."""
    out = []
    for name, text in templates:
        words = _words_of(text)
        out.append((len(out), name, False, words[:OPENING]))
        if len(words) > OPENING:
            out.append((len(out), name, True, words))
    return out


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORDS), lambda w: w != "")


def directory_of(path: Column) -> Column:
    """Everything before the last slash; '.' without one."""
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def _document_counts(docs: DataFrame, segments: DataFrame, templates) -> DataFrame:
    """(term, df) over the whole texts of all documents, for every term of a template or a segment.

    Only those terms are counted, so the shuffled counts are as many as they are in each task.
    """
    rows = docs.sparkSession.createDataFrame([(words,) for *_, words in _openings(templates)], "words array<string>")
    wanted = rows.select(F.explode("words").alias("term")).unionByName(segments.select(F.explode("words").alias("term"))).distinct()
    wanted = written(wanted, "license-terms")
    words = docs.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    seen = words.join(maybe_broadcast(wanted, wanted.count(), 64), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return written(wanted.join(seen, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df")), "license-counts")


def _weights(spark, idf: DataFrame, templates) -> DataFrame:
    """(template, license, whole, size, term, weight) with unit norms; size counts the words compared."""
    rows = spark.createDataFrame(_openings(templates), "template int, license string, whole boolean, words array<string>")
    rows = rows.select("template", "license", "whole", F.size("words").alias("size"), F.explode("words").alias("term")).groupBy("template", "license", "whole", "size", "term").count()
    weighted = idf.join(F.broadcast(rows), "term").withColumn("w", (1 + F.log("count")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))
    return weighted.select("template", "license", "whole", "size", "term", (F.col("w") / norm).alias("weight"))


def _idf(total: int, df: Column) -> Column:
    return F.log(F.lit(1.0 + total) / (1 + df)) + 1


def _places(templates) -> list[tuple[int, int, int, int]]:
    """(kind of anchor, template, words before the anchor, words of the opening) of the first anchor in every opening."""
    out = []
    for t, _, whole, words in _openings(templates):
        kinds = [(i, k) for i, w in enumerate(words) for k, stem in enumerate(_ANCHOR_WORDS) if re.search(stem, w)]
        kinds += [(i, len(_ANCHOR_WORDS) + k) for i in range(len(words)) for k, run in enumerate(_ANCHOR_RUNS) if tuple(words[i : i + len(run)]) == run]
        if kinds and not whole:
            i, kind = min(kinds)
            out.append((kind, t, i, len(words)))
    return out


def _windows(base: DataFrame, templates) -> DataFrame:
    """(fid, line, template, words) of every window; line is that of its first word."""
    places = _places(templates)
    if not places:
        return base.limit(0).select("fid", F.lit(0).alias("line"), F.lit(0).alias("template"), _terms(F.col("text")).alias("words"))
    reach = max(n for *_, n in places)
    token = F.flatten(F.transform(F.split("text", "\n"), lambda line, i: F.transform(_terms(line), lambda w: F.struct((i + 1).alias("line"), w.alias("w")))))

    def kind(t, w, i):
        is_run = [F.lit(True) for _ in _ANCHOR_RUNS]
        for k, run in enumerate(_ANCHOR_RUNS):
            for j, part in enumerate(run):
                is_run[k] &= F.coalesce(F.get(t, i + j)["w"] == part, F.lit(False))
        found = F.when(w.rlike(_ANCHOR_WORDS[0]), 0)
        for k, stem in enumerate(_ANCHOR_WORDS[1:], 1):
            found = found.when(w.rlike(stem), k)
        for k, hit in enumerate(is_run, len(_ANCHOR_WORDS)):
            found = found.when(hit, k)
        return found

    # the words near an anchor are cut out before rows are made, so a long text is not repeated for each
    def around(t):
        anchors = F.filter(F.transform(t, lambda x, i: F.struct(kind(t, x["w"], i).alias("kind"), i.alias("at"))), lambda x: x["kind"].isNotNull())
        first = lambda x: F.greatest(F.lit(0), x["at"] - reach)
        return F.transform(anchors, lambda x: F.struct(x["kind"].alias("kind"), (x["at"] - first(x)).alias("at"), F.slice(t, first(x) + 1, F.lit(2 * reach)).alias("t")))

    # an array of one, so that the words are a bound variable: a column would be split again for every word
    near = base.where(F.col("text").rlike(_WINDOWED)).select("fid", F.explode(F.flatten(F.transform(F.array(token), around))).alias("x")).select("fid", "x.*")
    table = F.broadcast(base.sparkSession.createDataFrame(places, "kind int, template int, before int, n int"))
    low, high = F.greatest(F.lit(0), F.col("at") - F.col("before")), F.least(F.size("t"), F.col("at") - F.col("before") + F.col("n"))
    cut = near.join(table, "kind").select("fid", "template", F.slice("t", low + 1, high - low).alias("t"))
    return cut.select("fid", F.col("t")[0]["line"].alias("line"), "template", F.col("t.w").alias("words"))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` with license, license_score, license_line (of a header; 0 for a whole licence file), license_from and license_lead.

    license_lead is how far the file's own licence is ahead of the next one at or above the threshold, null if
    there is none; license_from is ``own``, ``directory`` (inherited) or null when no licence was found; an inherited
    row's score is that of the licence file. Of equal scores the longer template, then the alphabetically first, and the first line win; the best score, then the alphabetically first licence between licence files of one directory. A null path lies in '.', a null or
    empty text has no licence of its own. Input columns named like the results are replaced; repeated
    rows have equal results. An empty table gives no rows.
    """
    spark = prepare(files.sparkSession)
    results = {"license", "license_score", "license_line", "license_from", "license_lead"}
    names = kept_columns(files, results)
    path = F.coalesce(F.col(quoted(path_col)).cast("string"), F.lit(""))
    base = files.select(F.struct(*[F.col(quoted(c)).alias(c) for c in names]).alias("__ls_row"), path.alias("path"), text_of(quoted(text_col)).alias("text"))
    is_file = F.substring_index(F.col("path"), "/", -1).rlike(LICENCE_FILE)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda line, i: F.struct((i + 1).alias("line"), line.alias("body"))), lambda x: x["body"].rlike(ANCHORS))
    whole = F.when(is_file, F.array(F.struct(F.lit(0).alias("line"), F.col("text").alias("body")))).otherwise(F.array().cast("array<struct<line:int,body:string>>"))
    # files and segments are named by 128 bits of their content: equal ones are compared once
    base = base.withColumn("fid", F.md5(F.concat("path", F.lit("\n"), "text")))
    texts = base.select("fid", "path", "text", is_file.alias("is_file")).where(F.col("text").rlike(_WINDOWED) | F.col("is_file"))
    texts = written(texts, "license-candidates")
    segment = texts.select("fid", F.explode(F.concat(whole, lines)).alias("s")).select("fid", "s.line", F.lit(None).cast("int").alias("template"), _terms(F.col("s.body")).alias("words"))
    segment = segment.unionByName(_windows(texts, templates)).withColumn("sid", F.md5(F.concat_ws(" ", F.coalesce(F.col("template").cast("string"), F.when(F.col("line") == 0, "whole").otherwise("line")), "words")))
    segment = written(segment, "license-occurrences")
    distinct = segment.groupBy("sid").agg(F.first("template").alias("template"), (F.first("line") == 0).alias("whole"), F.first("words").alias("words"))
    distinct = written(distinct, "license-texts")
    counts = _document_counts(base, distinct, templates)
    idf = counts.select("term", _idf(base.count(), F.col("df")).alias("idf"))
    weights = F.broadcast(written(_weights(spark, idf, templates), "license-templates"))  # as many rows as the templates have terms
    of_lines = distinct.where("template IS NULL").select("sid", "whole", F.explode("words").alias("term")).groupBy("sid", "whole", "term").agg(F.count("*").alias("n")).select("sid", F.lit(None).cast("int").alias("only"), F.col("whole").alias("file"), "term", "n")
    counted = F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("term"), F.size(F.filter("words", lambda v: v == w)).cast("long").alias("n")))
    of_windows = distinct.where("template IS NOT NULL").select("sid", F.col("template").alias("only"), F.lit(False).alias("file"), F.inline(counted))
    terms = of_lines.unionByName(of_windows).withColumn("tf", 1 + F.log("n"))
    terms = terms.join(maybe_broadcast(idf, counts.count(), 64), "term").select("sid", "only", "file", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = terms.groupBy("sid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(weights, "term").where("only = template OR only IS NULL AND (file OR NOT whole)").groupBy("sid", "template", "license", "size").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "sid").withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold)
    best = written(scored.select("sid", "size", "license", "score"), "license-segments")

    # each file's best segment, and the best of another licence
    table = maybe_broadcast(best, best.count(), 100)
    found = segment.select("fid", "line", "sid").join(table, "sid")
    of_file = found.groupBy("fid", "license").agg(F.min(F.struct((-F.col("score")).alias("minus"), (-F.col("size")).alias("size"), "line")).alias("b"))  # at most one row a licence
    ranked = F.sort_array(F.collect_list(F.struct("b.minus", "b.size", "license", "b.line")))
    own = of_file.groupBy("fid").agg(ranked.alias("r")).select("fid", (-F.col("r")[0]["minus"]).alias("own_score"), F.col("r")[0]["license"].alias("own"), F.col("r")[0]["line"].alias("own_line"), F.round(F.get("r", F.lit(1))["minus"] - F.col("r")[0]["minus"], 9).alias("own_lead"))
    own = written(own, "license-own")
    judged = looked_up(base.select("__ls_row", "path", "fid"), own, "fid", 128).withColumn("dir", directory_of(F.col("path")))

    sources = judged.where(F.col("own").isNotNull() & F.substring_index(F.col("path"), "/", -1).rlike(LICENCE_FILE)).groupBy("dir").agg(F.min(F.struct(-F.col("own_score"), "own")).alias("b"))
    sources = sources.select(F.col("dir").alias("ancestor"), (-F.col("b.col1")).alias("dir_score"), F.col("b.own").alias("dir_license"))
    folders = base.select(directory_of(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    ancestors = F.when(F.col("dir") == ".", F.array(F.lit("."))).otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), F.array(F.lit("."))))
    depth = folders.select("dir", F.explode(ancestors).alias("ancestor")).withColumn("depth", F.when(F.col("ancestor") == ".", 0).otherwise(F.size(F.split("ancestor", "/"))))
    inherited = depth.join(sources, "ancestor").groupBy("dir").agg(F.max_by(F.struct("dir_license", "dir_score"), "depth").alias("i"))
    inherited = written(inherited.select("dir", "i.dir_license", "i.dir_score"), "license-directories")
    joined = looked_up(judged, inherited, "dir", 160)
    return joined.select(
        "__ls_row.*", F.coalesce("own", "dir_license").alias("license"), F.coalesce("own_score", "dir_score").alias("license_score"), F.col("own_line").alias("license_line"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "directory").alias("license_from"), F.col("own_lead").alias("license_lead"),
    )
