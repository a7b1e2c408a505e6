"""Adapters from the supplied order tables to commits, history rows and dependency diffs.

Orders play commits, a customer's market segment plays the author, and the distinct parts of an order's
lines play the files of the commit. Each adapter has a twin in DuckDB SQL (COMMITS_SQL and the rest) for
the correctness checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import columns as C

TYPES = {"1-URGENT": "fix", "2-HIGH": "feat", "3-MEDIUM": "refactor", "4-NOT SPECIFIED": "chore", "5-LOW": "docs"}
#: Orders with these remainders of their key by 60 are reverts of the order seven before: by sha, by prefix, by subject.
REVERT_EVERY, REVERT_BACK, BY_SHA, BY_PREFIX, BY_SUBJECT = 60, 7, 0, 20, 40
FALLBACK_AUTHOR = "unknown"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha_of(key: Column) -> Column:
    return F.substring(F.sha2(key.cast("string"), 256), 1, 40)


def path_of(brand: Column, kind: Column, key: Column) -> Column:
    return F.concat(F.lit("src/"), F.translate(F.lower(brand), "# ", "__"), F.lit("/"), F.translate(F.lower(kind), "# ", "__"), F.lit("/part_"), key.cast("string"), F.lit(".ts"))


def _subject(kind: Column, status: Column, key: Column) -> Column:
    return F.concat(kind, F.lit("("), F.lower(status), F.lit("): order "), key.cast("string"))


def _of_part(key: Column, part: tuple[int, int] | None) -> Column:
    return F.lit(True) if part is None else F.pmod(F.xxhash64(key.cast("long")), F.lit(part[1])) == part[0]


def commits(spark: SparkSession, sf_dir: str, part: tuple[int, int] | None = None) -> DataFrame:
    """Flat commits: sha, author, email, ts, subject, body, commit_type, scope, seq; those of part i of n, if one is named."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col("o_orderpriority")], F.lit("chore"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", kind.alias("kind"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    authors = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("author"))
    m, mine = F.col("o_orderkey") % REVERT_EVERY, _of_part(F.col("o_orderkey"), part)
    reverted = orders.select((F.col("o_orderkey") + REVERT_BACK).alias("o_orderkey"), _subject(F.col("kind"), F.col("o_orderstatus"), F.col("o_orderkey")).alias("old")).where(m.isin(BY_SHA, BY_PREFIX, BY_SUBJECT) & mine)
    orders = orders.where(mine)
    reverts = m.isin(BY_SHA, BY_PREFIX, BY_SUBJECT) & F.col("old").isNotNull()
    back = sha_of(F.col("o_orderkey") - REVERT_BACK)
    body = F.when(reverts & (m == BY_SHA), F.concat(F.lit("This reverts commit "), back, F.lit("."))).when(reverts & (m == BY_PREFIX), F.concat(F.lit("This reverts commit "), F.substring(back, 1, 10), F.lit("."))).otherwise("")
    subject = F.when(reverts & (m == BY_SUBJECT), F.concat(F.lit('Revert "'), F.col("old"), F.lit('"'))).when(reverts, F.concat(F.lit("Revert order "), F.col("o_orderkey"))).otherwise(_subject(F.col("kind"), F.col("o_orderstatus"), F.col("o_orderkey")))
    joined = orders.join(reverted, "o_orderkey", "left").join(authors, "o_custkey", "left")
    out = joined.select(sha_of(F.col("o_orderkey")).alias("sha"), F.coalesce("author", F.lit(FALLBACK_AUTHOR)).alias("author"), "ts", subject.alias("subject"), body.alias("body"), F.col("o_orderkey").cast("long").alias("seq"))
    return out.select("*", F.concat(F.lower("author"), F.lit("@example.com")).alias("email"), C.commit_type("subject").alias("commit_type"), C.commit_scope("subject").alias("scope"))


def changes(spark: SparkSession, sf_dir: str, part: tuple[int, int] | None = None) -> DataFrame:
    """Distinct (sha, seq, file_path) with additions, deletions and the file's place in its commit, dealt out by sha before that is computed and texts are made."""
    sha = sha_of(F.col("l_orderkey"))
    changed = _changed(spark, sf_dir, part).repartition(sha)
    return changed.select(sha.alias("sha"), "file_path", F.col("additions").cast("int").alias("additions"), F.col("deletions").cast("int").alias("deletions"), (F.col("line") * 1_000_000 + F.col("l_partkey")).cast("long").alias("place"))


def _changed(spark: SparkSession, sf_dir: str, part: tuple[int, int] | None) -> DataFrame:
    """The distinct parts of each order with their paths. Lines are shuffled by part only, which serves the groups and the join."""
    lines = read(spark, sf_dir, "lineitem").where(_of_part(F.col("l_orderkey"), part)).select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber").repartition("l_partkey")
    lines = lines.groupBy("l_orderkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("additions"), F.min("l_linenumber").alias("line"), F.count("*").alias("deletions"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), path_of(F.col("p_brand"), F.col("p_type"), F.col("p_partkey")).alias("file_path"))
    return lines.join(parts, "l_partkey")


def raw_commits(spark: SparkSession, sf_dir: str, part: tuple[int, int] | None = None) -> DataFrame:
    """Commits as a log reader gives them: nested files in their order, and no inline diffs; those of part i of n, if one is named."""
    files = changes(spark, sf_dir, part).groupBy("sha").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "file_path", "additions", "deletions"))), lambda x: F.struct(x["file_path"].alias("path"), x["additions"].alias("additions"), x["deletions"].alias("deletions"), F.lit("M").alias("status"))).alias("files"))
    base = commits(spark, sf_dir, part).join(files, "sha", "left")
    # every 97th commit is a merge, every 89th is a bot's
    parents = F.when(F.col("seq") % 97 == 0, F.array("sha", F.lit("p2"))).otherwise(F.array("sha"))
    author = F.when(F.col("seq") % 89 == 0, F.lit("Dependabot[bot]")).otherwise(F.col("author"))
    empty = F.array().cast("array<struct<path:string,additions:int,deletions:int,status:string>>")
    return base.select("sha", author.alias("author"), "email", C.iso(F.col("ts")).alias("date"), "subject", "body", parents.alias("parents"), F.when(F.col("seq") % 10 == 0, F.lit("HEAD -> main, origin/main")).otherwise(F.lit("")).alias("refs"), F.coalesce("files", empty).alias("files"), F.lit(None).cast("map<string,string>").alias("diffs"), "seq")


def history(spark: SparkSession, sf_dir: str, part: tuple[int, int] | None = None, buckets: int | None = None) -> DataFrame:
    """Summaries and file diffs in the columns that detectors read; those of part i of n of the commits, and dealt out by sha, if so told.

    Lines meet their commit by its number, which is shorter than its sha; a commit's rows are made where its lines are.
    """
    sha = sha_of(F.col("l_orderkey"))
    changed = _changed(spark, sf_dir, part).select("l_orderkey", "l_partkey", "line", "file_path")
    changed = (changed.repartition(sha) if buckets is None else changed.repartition(buckets, sha)).select(sha.alias("sha"), "file_path", (F.col("line") * 1_000_000 + F.col("l_partkey")).cast("long").alias("pos"))
    files = changed.groupBy("sha").agg(F.collect_list(F.struct("file_path", "pos")).alias("files"))
    base = commits(spark, sf_dir, part)
    base = (base if buckets is None else base.repartition(buckets, "sha")).join(files, "sha", "left")
    base = base.withColumn("n", F.when(F.col("files").isNull(), 0).otherwise(F.size("files")))
    s = F.lower("subject")
    cls = F.when(s.rlike("^(feat|refactor|revert|perf)") | (F.col("n") > 10), "decision").when((s.startswith("fix") & (F.col("n") <= 3)) | (F.col("n") == 0), "routine").otherwise("unknown")

    def row(kind: str, path: Column, files_changed: Column, pos: Column, body: Column) -> Column:
        return F.struct(body.alias("body"), F.lit(kind).alias("chunk_type"), path.alias("file_path"), F.lit("").alias("text"), files_changed.alias("files_changed"), pos.alias("pos"))

    summary = row("commit_summary", F.lit(""), F.col("n"), F.lit(0).cast("long"), F.col("body"))
    diffs = F.transform(F.coalesce("files", F.array().cast("array<struct<file_path:string,pos:bigint>>")), lambda f: row("file_diff", f["file_path"], F.lit(1), f["pos"], F.lit("")))
    out = base.select("sha", "author", "ts", "seq", "subject", "commit_type", cls.alias("decision_class"), F.explode(F.concat(F.array(summary), diffs)).alias("r"))
    return out.select("sha", "author", "ts", "seq", "subject", "commit_type", "decision_class", "r.*")


def dependency_history(spark: SparkSession, sf_dir: str, part: tuple[int, int] | None = None) -> DataFrame:
    """One package.json diff per order: its parts with return flag A are added lines, those with R removed ones."""
    base = commits(spark, sf_dir, part).select("sha", "author", "ts", "seq", "subject", "commit_type")
    sign = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-")
    lines = read(spark, sf_dir, "lineitem").where(_of_part(F.col("l_orderkey"), part)).where(sign.isNotNull()).select("l_orderkey", "l_partkey", "l_returnflag").repartition("l_orderkey")
    line = F.concat(sign, F.lit('  "dep_'), F.col("l_partkey").cast("string"), F.lit('": "1.0.0"'))
    text = lines.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text")).select(F.col("l_orderkey").cast("long").alias("seq"), "text")
    return text.join(base, "seq").select("sha", "text", "author", "ts", "seq", "subject", "commit_type", F.lit("").alias("body"), F.lit("file_diff").alias("chunk_type"), F.lit("package.json").alias("file_path"), F.lit(1).alias("files_changed"), F.lit(0).cast("long").alias("pos"), F.lit("unknown").alias("decision_class"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files ``<source>/doc_<id>.<extension>`` with their language; null texts are empty.

    Without a source or an id a file has no path. The kind is an element by the id's remainder, as in SQL: from the end for ids below 0,
    none at place 0.
    """
    at = (F.col("doc_id") % 4 + 1).cast("int")
    kind = lambda *values: F.when(at != 0, F.element_at(F.array(*map(F.lit, values)), at))
    path = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), kind("ts", "py", "rb", "tsx"))
    return read(spark, sf_dir, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"), kind("typescript", "python", "ruby", "tsx").alias("language"))


# The same adapters in DuckDB SQL.
COMMITS_SQL = f"""
kinds AS (
    SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderdate AS ts,
           CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items())} ELSE 'chore' END AS kind FROM orders),
named AS (SELECT *, kind || '(' || lower(o_orderstatus) || '): order ' || k AS plain FROM kinds),
commits AS (
    SELECT *, regexp_extract(subject, '{C.CONVENTIONAL}', 1) AS commit_type, regexp_extract(subject, '{C.CONVENTIONAL}', 3) AS scope, lower(author) || '@example.com' AS email
    FROM (SELECT left(sha256(a.k::VARCHAR), 40) AS sha, coalesce(c_mktsegment, 'unknown') AS author, a.ts,
          CASE WHEN b.k IS NOT NULL AND a.k % 60 = 40 THEN 'Revert "' || b.plain || '"' WHEN b.k IS NOT NULL AND a.k % 60 IN (0, 20) THEN 'Revert order ' || a.k ELSE a.plain END AS subject,
          CASE WHEN b.k IS NOT NULL AND a.k % 60 = 0 THEN 'This reverts commit ' || left(sha256(b.k::VARCHAR), 40) || '.'
               WHEN b.k IS NOT NULL AND a.k % 60 = 20 THEN 'This reverts commit ' || left(sha256(b.k::VARCHAR), 10) || '.' ELSE '' END AS body, a.k AS seq
          FROM named a LEFT JOIN named b ON b.k = a.k - 7 LEFT JOIN customer ON c_custkey = a.o_custkey)),
changes AS (
    SELECT left(sha256(l_orderkey::VARCHAR), 40) AS sha, 'src/' || translate(lower(p_brand), '# ', '__') || '/' || translate(lower(p_type), '# ', '__') || '/part_' || p_partkey || '.ts' AS file_path,
           additions, deletions, line * 1000000 + p_partkey AS pos
    FROM (SELECT l_orderkey, l_partkey, sum(l_quantity::BIGINT)::INT AS additions, count(*)::INT AS deletions, min(l_linenumber) AS line FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = l_partkey),
summaries AS (
    SELECT c.*, coalesce(n, 0) AS files_changed,
           CASE WHEN regexp_matches(lower(subject), '^(feat|refactor|revert|perf)') OR coalesce(n, 0) > 10 THEN 'decision'
                WHEN (starts_with(lower(subject), 'fix') AND coalesce(n, 0) <= 3) OR coalesce(n, 0) = 0 THEN 'routine' ELSE 'unknown' END AS decision_class
    FROM commits c LEFT JOIN (SELECT sha, count(*) AS n FROM changes GROUP BY sha) USING (sha)),
diffs AS (
    SELECT s.sha, s.author, s.ts, s.seq, s.subject, s.commit_type, s.decision_class, file_path, pos, additions, deletions,
           regexp_replace(file_path, '/[^/]*$', '') AS dir FROM changes JOIN summaries s USING (sha)),
clock AS (SELECT max(ts) AS as_of FROM summaries)
"""
