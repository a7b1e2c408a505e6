"""Command line over the engine's verbs."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict, replace

from strataline.plans import facade as FC
from strataline.schema import EngineConfig, default_config_json, load_config

CONFIG_NAME = ".strataline.json"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataline")
    p.add_argument("--repo", default=None)
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *flags: str, **positional):
        q = sub.add_parser(name)
        for k, v in positional.items():
            q.add_argument(k, **v)
        for f in flags:
            q.add_argument(f"--{f}", **({"action": "store_true"} if f in ("full", "recent", "unique-commits", "verbose") else {"type": int} if f in ("limit", "max-commits") else {}))
        return q

    verb("index", "full", "recent", "provider", "model", "verbose")
    verb("git-index", "full", "recent", "provider", "model", "max-commits", "verbose")
    verb("query", "limit", "filter", "format", text={})
    verb("git-search", "after", "before", "author", "file", "type", "decision-class", "sort", "unique-commits", "limit", "format", text={})
    verb("explain", "format", text={})
    verb("analyze", "full", "verbose")
    verb("assess", "files", "change-type", "query", "format")
    verb("setup", "provider", "model", "max-commits", "recent", "verbose")
    for name in ("stats", "git-stats", "init"):
        verb(name, "format")
    return p


def configured(config: EngineConfig, a: argparse.Namespace) -> EngineConfig:
    """The configuration with what the command line says over it."""
    if getattr(a, "provider", None):
        config = replace(config, embedding_provider=a.provider)
    if getattr(a, "model", None):
        config = replace(config, embedding_model=a.model)
    if getattr(a, "max_commits", None) is not None:
        config = replace(config, git=replace(config.git, max_commits=a.max_commits))
    return config


def repo_of(flag: str | None) -> str:
    found = flag or os.environ.get("STRATALINE_REPO") or os.getcwd()
    if not os.path.isdir(found):
        sys.exit(f"not a directory: {found}")
    return os.path.abspath(found)


def main(argv: list[str] | None = None, spark=None) -> str:
    """Runs one verb and prints and returns its text."""
    a = parser().parse_args(argv)
    repo = repo_of(a.repo)
    if a.verb == "init":
        path = os.path.join(repo, CONFIG_NAME)
        if os.path.exists(path):
            return _say(f"{path} exists")
        with open(path, "w", encoding="utf-8") as f:
            f.write(default_config_json())
        return _say(f"wrote {path}")
    config = configured(load_config(os.path.join(repo, CONFIG_NAME)), a)
    if getattr(a, "verbose", False):
        print("Effective config:\n" + json.dumps(asdict(config) | {"embedding_api_key": None}, indent=2), file=sys.stderr)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("strataline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e = FC.Engine(spark, repo, config)
    return _say(_run(e, a))


def _say(text: str) -> str:
    print(text)
    return text


def _json(df) -> str:
    return "[" + ",".join(df.toJSON().collect()) + "]"


def _run(e: FC.Engine, a) -> str:
    as_json = getattr(a, "format", None) == "json"
    if a.verb == "index":
        (e.index_code if a.full else e.index_code_recent if a.recent else e.index_code_incremental)()
    elif a.verb == "git-index":
        (e.index_history if a.full else e.index_history_recent if a.recent else e.index_history_incremental)()
    elif a.verb == "analyze":
        (e.analyze if a.full else e.analyze_incremental)()
    elif a.verb == "setup":
        e.setup(a.recent)
    elif a.verb == "query":
        df = e.search(a.text, a.limit, a.filter)
        return _json(df) if as_json else FC.render_code(df.collect(), a.text)
    elif a.verb == "git-search":
        df = e.search_history(a.text, a.limit, a.sort or "relevance", a.unique_commits, after=a.after, before=a.before, author=a.author, file=a.file, commit_type=a.type, decision_class=a.decision_class)
        return _json(df) if as_json else FC.render_history(df.collect(), a.text, a.sort or "relevance")
    elif a.verb == "explain":
        parts = e.explain(a.text)
        return "{" + ",".join(f'"{n}":{_json(df)}' for n, df in zip(("code", "file_history", "history"), parts, strict=True)) + "}" if as_json else FC.render_explain(*(df.collect() for df in parts), a.text)
    elif a.verb == "assess":
        r = e.assess((a.files or "").split(","), a.change_type, a.query)
        if as_json:
            return "{" + ",".join(f'"{n}":{_json(getattr(r, n))}' for n in ("warnings", "file_profiles", "signals", "owners")) + "}"
        return FC.render_assessment(r.warnings.collect(), r.file_profiles.collect(), r.owners.collect())
    elif a.verb in ("stats", "git-stats"):
        df = e.stats() if a.verb == "stats" else e.history_stats()
        return _json(df) if as_json else "\n".join(f"{k}: {v}" for k, v in df.first().asDict().items())
    return "\n".join(["done", *(_told(e, a.verb) if getattr(a, "verbose", False) else [])])


def _told(e: FC.Engine, verb: str) -> list[str]:
    """What the store holds after a verb."""
    out = []
    if verb in ("index", "setup"):
        out += [f"{k}: {v}" for k, v in e.stats().first().asDict().items()]
    if verb in ("git-index", "setup"):
        out += [f"{k}: {v}" for k, v in e.history_stats().first().asDict().items()]
    if verb in ("analyze", "setup"):
        out += [f"{r['type']}: {r['n']}" for r in e.signal_counts().collect()]
    return out


if __name__ == "__main__":
    main()
