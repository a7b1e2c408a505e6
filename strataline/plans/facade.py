"""The engine's verbs over one store: index, search, analyse, assess, explain."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators import embed as E
from strataline.operators import history as H
from strataline.operators import profiles as P
from strataline.operators import vector as V
from strataline.operators.chunkers.code import chunk_files
from strataline.operators.signals import pipeline as S
from strataline.plans import assess as A
from strataline.schema import EngineConfig
from strataline.sources import files as SF
from strataline.sources import gitlog as G
from strataline.sources import store as ST

RECENT_DAYS, RECENT_COMMITS = 30, 250


@dataclass
class Engine:
    """All verbs return DataFrames; nothing but rendered results is collected."""

    spark: SparkSession
    repo: str
    config: EngineConfig = field(default_factory=EngineConfig)

    def __post_init__(self):
        self.store = ST.Store(self.spark, self.config.store_uri or os.path.join(self.repo, ".strataline"))
        self.embedder = E.create_embedder(self.config)

    # --- code

    def _chunked(self, files: DataFrame) -> DataFrame:
        manifests = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "package.json").text(self.repo, wholetext=True)
        manifests = manifests.select(F.regexp_replace("_metadata.file_path", "^.*?" + self.repo.rstrip("/").lstrip("/") + "/", "").alias("path"), F.col("value").alias("content"))
        return E.with_vectors(chunk_files(SF.package_names(files, manifests), self.config.chunk_max_tokens), "content", self.embedder, "")

    def _done(self, name: str, **state) -> None:
        self.store.save_state(name, {"indexed_at": dt.datetime.now(dt.UTC).isoformat(), "commit": G.head_sha(self.repo), **state})

    def index_code(self) -> None:
        self.store.insert("chunks", self._chunked(SF.discover(self.spark, self.repo, self.config)), overwrite=True)
        self._done("code")

    def index_code_incremental(self) -> None:
        """Re-chunks what changed since the last index; without a usable state everything."""
        state = self.store.load_state("code")
        try:
            changed = G.changed_paths(self.spark, self.repo, state["commit"]) if state and state.get("commit") else None
        except subprocess.CalledProcessError:  # git doesn't know the commit any more: history was rewritten
            changed = None
        if changed is None:
            return self.index_code()
        changed = changed.where(SF.wanted(F.col("path"), self.config)).select(F.col("path").alias("file_path"))
        old = ST.without(self.store.read("chunks", vectors=True), changed, "file_path")
        now = SF.discover(self.spark, self.repo, self.config).join(changed.select(F.col("file_path").alias("path")), "path", "left_semi")
        self.store.insert("chunks", old.unionByName(self._chunked(now).select(*old.columns)), overwrite=True)
        self._done("code")

    def index_code_recent(self) -> None:
        named = self.spark.createDataFrame([(p,) for p in set(G.git(self.repo, "log", f"--since={RECENT_DAYS} days ago", "--name-only", "--format=").splitlines()) if p], "path string")
        self.store.insert("chunks", self._chunked(SF.discover(self.spark, self.repo, self.config).join(named, "path", "left_semi")), overwrite=True)
        self._done("code")

    # --- history

    def _history(self, since: str | None = None, days: int | None = None, limit: int = 0) -> DataFrame:
        raw = H.kept_commits(G.commits(self.spark, self.repo, None, since, days, self.config.git), self.config.git)
        raw = raw.orderBy(F.desc("seq")).limit(limit) if limit else raw
        return E.with_vectors(H.enrich(H.chunk_commits(raw, self.config.git), self.config.git), "text", self.embedder)

    def index_history(self) -> None:
        self.store.insert("git_history", self._history(), overwrite=True)
        self._done("history")

    def index_history_incremental(self) -> None:
        """Appends what last..HEAD brought; rows that are there already are left out. Without a usable state everything is indexed."""
        state = self.store.load_state("history")
        try:
            new = self._history(since=state["commit"]) if state and state.get("commit") else None
        except subprocess.CalledProcessError:  # git doesn't know the commit any more: history was rewritten
            new = None
        if new is None:
            return self.index_history()
        self.store.append_new("git_history", new)
        self._done("history")

    def index_history_recent(self) -> None:
        self.store.insert("git_history", self._history(days=RECENT_DAYS, limit=RECENT_COMMITS), overwrite=True)
        self._done("history")

    # --- analysis

    def _as_of(self) -> Column:
        return F.lit(dt.datetime.now(dt.UTC).replace(tzinfo=None)).cast("timestamp")

    def _analysed_history(self) -> DataFrame:
        """The stored history; if max_analyze_chunks is set, its newest so many rows, with a warning that there are more."""
        rows, most = self.store.read("git_history"), self.config.max_analyze_chunks
        if not most:
            return rows
        if rows.limit(most + 1).count() > most:
            warnings.warn(f"analysis truncated to {most} chunks; results may be incomplete", stacklevel=3)
        return rows.orderBy(F.desc("seq"), "id").limit(most)

    def analyze(self) -> None:
        rows, as_of = self._analysed_history(), self._as_of()
        found = S.detect(rows, as_of, self.config.signals)
        self.store.insert("signals", E.with_vectors(found, "summary", self.embedder), overwrite=True)
        self.store.upsert_profiles(P.file_profiles(rows, self.store.read("signals")), overwrite=True)
        self._done("analysis")

    def analyze_incremental(self) -> None:
        """Recomputes churn and ownership over all rows; profiles use these and all stored signals."""
        rows, as_of = self._analysed_history(), self._as_of()
        found = S.detect(rows, as_of, self.config.signals, S.INCREMENTAL)
        self.store.replace_signals(list(S.INCREMENTAL_TYPES), E.with_vectors(found, "summary", self.embedder))
        self.store.upsert_profiles(P.file_profiles(rows, self.store.read("signals")))
        self._done("analysis")

    def setup(self, recent: bool = False) -> None:
        (self.index_code_recent if recent else self.index_code)()
        (self.index_history_recent if recent else self.index_history)()
        self.analyze()

    # --- queries

    def search(self, text: str, limit: int | None = None, prefix: str | None = None) -> DataFrame:
        return V.search_code(self.store.read("chunks", vectors=True), E.embed_query(self.embedder, text, ""), limit or self.config.search_limit, prefix)

    def search_history(self, text: str, limit: int | None = None, sort: str = "relevance", unique_commits: bool = False, **conditions) -> DataFrame:
        rows = self.store.read("git_history", vectors=True)
        return V.search_history(rows, E.embed_query(self.embedder, text), limit or self.config.search_limit, V.history_filter(**conditions), unique_commits, sort)

    def search_signals(self, text: str, limit: int = 10) -> DataFrame:
        return V.top_k(self.store.read("signals", vectors=True), E.embed_query(self.embedder, text), limit)

    def explain(self, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return A.explain(self.store.read("chunks", vectors=True), self.store.read("git_history", vectors=True), E.embed_query(self.embedder, text, ""), E.embed_query(self.embedder, text))

    def file_history(self, path: str, text: str, limit: int = 10) -> DataFrame:
        return A.file_history(self.store.read("git_history", vectors=True), path, E.embed_query(self.embedder, text), limit)

    def file_profile(self, path: str) -> DataFrame:
        return ST.profile_of(self.store.read("file_profiles"), path)

    def assess(self, files: list[str], change_type: str | None = None, query: str | None = None) -> A.Assessment:
        asked = self.spark.createDataFrame([(f.strip(),) for f in files if f.strip()], "path string")
        found = self.search_signals(query) if query and self.store.exists("signals") else None
        return A.assess(self.store.read("file_profiles"), self.store.read("signals"), asked, self._as_of(), change_type, found)

    def stats(self) -> DataFrame:
        return ST.code_stats(self.store.read("chunks"))

    def signal_counts(self) -> DataFrame:
        return ST.signal_type_counts(self.store.read("signals"))

    def history_stats(self) -> DataFrame:
        return ST.history_stats(self.store.read("git_history"))


# --- rendering: small results as text


def render_code(rows, query: str) -> str:
    if not rows:
        return f'No results found for "{query}"'
    out = [f'Found {len(rows)} results for "{query}"', ""]
    for i, r in enumerate(rows, 1):
        notes = ", ".join([r["chunk_type"], *(["exported"] if r["exported"] else []), *([r["framework_role"]] if r["framework_role"] else [])])
        lines = r["content"].split("\n")
        preview = next((x for x in lines if x.strip() and not x.startswith(("// file:", "# file:", "import "))), lines[0])
        out += [f"{i}. [{r['score']:.2f}] {r['file_path']} -> {r['name']} ({notes})", f"   Lines {r['line_start']}-{r['line_end']}", f"   Preview: {preview[:100]}{'...' if len(preview) > 100 else ''}", ""]
    return "\n".join(out)


def render_history(rows, query: str, sort: str = "relevance") -> str:
    if not rows:
        return f'No results found for "{query}"'
    out = [f'Found {len(rows)} results for "{query}"', *(["  (sorted by date, newest first)"] if sort == "date" else []), ""]
    for i, r in enumerate(rows, 1):
        out += [f"{i}. [{r['score']:.2f}] {r['sha'][:7]} {(r['date'] or '')[:10]} {r['author']}", f"   {r['subject']}", f"   Files: {r['files_changed']} changed (+{r['additions']}/-{r['deletions']})", "   ---"]
    return "\n".join(out)


def render_explain(code, per_file, history, query: str) -> str:
    if not code and not history:
        return f'No results found for "{query}"'
    out = [f'Code matches for "{query}":', ""] if code else ["No code index found; index the code for combined results."]
    for i, r in enumerate(code, 1):
        out.append(f"{i}. [{r['score']:.2f}] {r['file_path']}:{r['line_start']}-{r['line_end']} - {r['name']} ({r['chunk_type']})")
        out += [f"     - {h['sha'][:7]} {(h['date'] or '')[:10]} {h['author']}: {h['subject']}" for h in per_file if h["hit_id"] == r["id"]]
    return "\n".join([*out, "", render_history(history, query)])


def render_assessment(found, profiles, owners) -> str:
    out = [f"{len(found)} warning{'s' if len(found) != 1 else ''} detected", ""] if found else ["No warnings detected for these files."]
    for w in found:
        out.append(f"{w['severity'].upper()} [{w['category']}] {w['message']}")
        out += [f"  Evidence: {', '.join(s[:7] for s in w['evidence'])}"] if w["evidence"] else []
        out += [f"  Triggered by: {', '.join(w['signal_ids'])}"] if w["signal_ids"] else []
    out += ["", "Owners:", *(f"  {o['author']} ({o['percentage']}%, last: {o['last_change']:%Y-%m-%d})" for o in owners)] if owners else []
    out += ["", "File profiles:", *(f"  {p['path']}: stability={p['stability_score']}/100, risk={p['risk_score']}/100, changes={p['total_changes']}, freq={p['change_frequency']}" for p in profiles)] if profiles else []
    return "\n".join(out)


__all__ = ["Engine", "render_assessment", "render_code", "render_explain", "render_history"]
