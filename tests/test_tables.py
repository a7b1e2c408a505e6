import json
import os
import subprocess

import pytest
from builders import DAY, NOW, commits, diff, history, summary
from pyspark.sql import functions as F

from strataline.cli import main
from strataline.operators import embed as E
from strataline.operators import vector as V
from strataline.operators.chunkers import code as K
from strataline.plans import assess as A
from strataline.plans import facade as FC
from strataline.schema import EngineConfig
from strataline.sources import files as SF
from strataline.sources import store as ST
from strataline.streaming import ingest as I


def signals(spark, rows):
    return spark.createDataFrame(rows, "id string, type string, directory_scope string")


@pytest.fixture
def store(spark, tmp_path):
    return ST.Store(spark, str(tmp_path / "store"))


def test_store_round_trip_and_mutation(spark, store):
    assert store.read("signals").count() == 0 and not store.exists("signals")
    store.insert("signals", signals(spark, [("1", "ownership", "src"), ("2", "churn_hotspot", "."), ("3", "revert_pair", "lib")]))
    store.insert("signals", signals(spark, [("4", "ownership", "lib")]))
    assert store.read("signals").count() == 4 and "vector" not in store.read("signals").columns
    store.replace_signals(["ownership", "churn_hotspot"], signals(spark, [("5", "ownership", "src")]))
    assert sorted(r["id"] for r in store.read("signals").collect()) == ["3", "5"]
    store.replace_signals(["ownership"], signals(spark, []))
    assert [r["id"] for r in store.read("signals").collect()] == ["3"]
    store.drop("signals")
    assert not store.exists("signals")


def test_directory_lookup_sees_repository_signals(spark):
    df = signals(spark, [("1", "a", "src"), ("2", "b", "."), ("3", "c", "lib")])
    assert sorted(r["id"] for r in ST.signals_in_directory(df, "src").collect()) == ["1", "2"]
    assert ST.signals_in_directory(df, ".").count() == 3 and ST.signals_of_type(df, "c").count() == 1


def test_history_deletes_and_idempotent_appends(spark, store):
    rows = history(spark, [summary("a", id="1"), diff("a", "x.ts", id="2"), diff("b", "y.ts", id="3")])
    store.insert("git_history", rows)
    store.append_new("git_history", rows)
    assert store.read("git_history").count() == 3
    store.delete_by_sha("b")
    store.delete_by_file_path("x.ts", "git_history")
    assert [r["id"] for r in store.read("git_history").collect()] == ["1"]
    s = ST.history_stats(store.read("git_history")).first()
    assert (s["total_rows"], s["commits"], s["first_ts"]) == (1, 1, NOW)
    assert ST.history_stats(rows.limit(0)).first()["first_ts"] is None


def test_profiles_are_upserted_by_path(spark, store):
    make = lambda *p: spark.createDataFrame(list(p), "path string, risk_score int")
    store.upsert_profiles(make(("a", 1), ("b", 2)))
    store.upsert_profiles(make(("b", 3), ("src/c", 4)))
    assert {r["path"]: r["risk_score"] for r in store.read("file_profiles").collect()} == {"a": 1, "b": 3, "src/c": 4}
    got = store.read("file_profiles")
    assert ST.profile_of(got, "b").count() == 1 and ST.profiles_under(got, "src").count() == 1 and ST.profiles_under(got, "sr").count() == 0


def test_state(store):
    assert store.load_state("x") is None
    store.save_state("x", {"commit": "abc"})
    assert store.load_state("x") == {"commit": "abc"}


def vectors(spark):
    rows = [("a", "s1", "f", [1.0, 0.0], 1), ("b", "s1", "f", [0.9, 0.1], 3), ("c", "s2", "g", [0.0, 1.0], 2), ("z", "s3", "g", [0.0, 0.0], 4)]
    return spark.createDataFrame(rows, "id string, sha string, file_path string, vector array<float>, t long").withColumn("ts", F.timestamp_seconds("t")).withColumn("chunk_type", F.lit("file_diff"))


def test_vector_search(spark):
    rows = vectors(spark)
    assert [(r["id"], round(r["score"], 3)) for r in V.top_k(rows, [1.0, 0.0], 5).collect()] == [("a", 1.0), ("b", 0.994), ("c", 0.0)]
    assert [r["id"] for r in V.search_history(rows, [1.0, 0.0], 2, unique_commits=True).collect()] == ["a", "c"]
    assert [r["id"] for r in V.search_history(rows, [1.0, 0.0], 2, unique_commits=True, dedup_after_limit=True).collect()] == ["a"]
    assert [r["id"] for r in V.search_history(rows, [1.0, 0.0], 3, sort="date").collect()] == ["b", "c", "a"]
    assert [r["id"] for r in V.search_history(rows, [1.0, 0.0], 3, V.history_filter(file="g", after="1970-01-01T00:00:01Z")).collect()] == ["c"]
    plan = V.top_k(rows, [1.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    code, per_file, hits = A.explain(rows, rows, [1.0, 0.0], [1.0, 0.0], 1, 1)
    assert [r["id"] for r in code.collect()] == ["a"] and [r["id"] for r in per_file.collect()] == ["a"] and hits.count() == 1


class Flaky:
    name, dimension, batch_size, char_budget, prefixed = "flaky", 2, 4, 100, True

    def __init__(self):
        self.calls = []

    def embed(self, texts):
        self.calls.append(list(texts))
        if len(texts) > 1 and any("bad" in t for t in texts) or any(len(t) > 4000 for t in texts):
            raise ValueError
        return [[float(len(t)), 1.0] for t in texts]


def test_embedding_batches_split_and_shorten():
    e = Flaky()
    got = E.embed_texts(e, ["a", "bad", "c", "d" * 9000])
    assert [v[0] for v in got] == [18.0, 20.0, 18.0, 4000.0]
    assert list(E.batches(["x" * 60, "y" * 60, "z"], 4, 100)) == [["x" * 60], ["y" * 60, "z"]]

    class Dead(Flaky):
        def embed(self, texts):
            raise OSError

    assert E.embed_texts(Dead(), ["x"]) == [[0.0, 0.0]]
    with pytest.raises(ValueError):
        E.create_embedder(EngineConfig(embedding_provider="none"))
    v = E.HashingEmbedder(16).embed(["one two", "one two", ""])
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-5 and any(v[2])


def pad(text, n=60):
    return text + "\n" * n


def test_typescript_chunks():
    p = K.TypeScriptPlugin()
    code = pad("import a from 'a'\nexport function login(u) {\n  return { u }\n}\n\nconst add = (a, b) => {\n  return a + b\n}\nconst N = 3;\nexport interface User {\n  id: string\n}\ntype Id = string | number\nexport class Big extends Base {\n  m() { return '}' }\n}\nfunction useThing() {}\nexport const Card = () => <div>{1}</div>\n// function no() {}\n")
    got = [(c.name, c.chunk_type, c.line_start, c.line_end, c.exported) for c in p.chunks("src/a.tsx", code)]
    assert got == [("login", "function", 2, 4, True), ("add", "function", 6, 8, False), ("User", "interface", 10, 12, True), ("Id", "type", 13, 13, False), ("Big", "class", 14, 16, True), ("useThing", "hook", 17, 17, False), ("Card", "component", 18, 18, True)]
    assert [c.name for c in p.chunks("app/api/x/route.ts", pad("export async function GET(r) {\n}\nfunction helper() {}\nexport const POST = h\n"))] == ["GET", "POST"]
    (page,) = p.chunks("app/(shop)/cart/page.tsx", pad("export default function P() {}"))
    assert (page.name, page.chunk_type, page.role) == ("/cart", "component", "page")
    assert p.chunks("next.config.js", "x")[0].chunk_type == "config" and p.chunks("a.ts", pad("let a = 1"))[0].chunk_type == "other"


def test_python_and_ruby_chunks():
    code = pad("import os\nfrom a import b\ndef f():\n    return 1\n\n@dec\nclass C:\n    def m(self):\n        pass\n\nclass D:\n    pass\n")
    assert [(c.name, c.chunk_type, c.line_start, c.line_end) for c in K.PythonPlugin().chunks("a.py", code)] == [("f", "function", 3, 4), ("C", "decorator", 6, 9), ("D", "class", 11, 12)]
    assert K.PythonPlugin().chunks("a.py", pad("def broken(:"))[0].chunk_type == "other" and K.PythonPlugin().chunks("a.py", "x = 1")[0].chunk_type == "other"
    ruby = pad("require 'a'\nclass User < Base\n  def name\n    if x\n      1\n    end\n  end\n  scope :a, -> do\n    b\n  end\nend\n\ndef self.top\n  1\nend\nmodule M\nend\n")
    assert [(c.name, c.chunk_type, c.line_start, c.line_end) for c in K.RubyPlugin().chunks("a.rb", ruby)] == [("User", "class", 2, 11), ("top", "function", 13, 15), ("M", "class", 16, 17)]
    text = K.chunk_text(K.PythonPlugin(), "a.py", code, "x" * 100, 20)
    assert text.startswith("# file: a.py\nimport os\nfrom a import b\n\n") and text.endswith("# ... truncated") and len(text) == 80 + len("\n# ... truncated")


def test_chunk_operator_and_discovery(spark):
    files = spark.createDataFrame([("src/a.ts", "let x"), ("src/a.test.ts", "t"), ("node_modules/x/y.ts", "n"), ("lib/b.py", "p = 1"), ("lib/test_b.py", "p"), ("readme.md", "#"), ("big.ts", "\n" * 3000), ("c.ts", None)], "path string, content string")
    kept = SF.select_files(files)
    assert sorted(r["path"] for r in kept.collect()) == ["lib/b.py", "src/a.ts"]
    named = SF.package_names(kept, spark.createDataFrame([("package.json", '{"name": "root-pkg"}'), ("src/package.json", '{"version": 1}')], "path string, content string"))
    got = {r["file_path"]: (r["package_name"], r["language"]) for r in K.chunk_files(named).collect()}
    assert got == {"src/a.ts": ("unknown", "typescript"), "lib/b.py": ("root", "python")}
    assert K.chunk_files(files).where("file_path = 'c.ts'").count() == 0
    r = K.default_registry()
    assert r.is_test_file("a/__tests__/b.ts") and not r.is_test_file("a/b.ts") and r.plugin_for("x") is None


def test_stream_is_idempotent(spark, store, tmp_path):
    folder = tmp_path / "in"
    commits(spark, [{"files": ["src/a.ts"]}, {"files": ["b.ts"], "subject": "fix: b"}]).write.json(str(folder))
    for k in range(2):
        I.ingest_stream(I.commit_stream(spark, str(folder)), store, str(tmp_path / f"check{k}")).awaitTermination()
    assert store.read("git_history").count() == 4
    assert I.activity(commits(spark, [{}, {}])).first()["commits"] == 2


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a, **k: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, env=os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null"} | k)
    run("init", "-q", "-b", "main")
    (root / "src").mkdir()
    for i, subject in enumerate(["feat: add login", "fix: login typo", "fix: login again", "docs: readme"]):
        (root / "src" / "login.ts").write_text("\n".join(f"line {k} {i}" for k in range(5)))
        (root / f"f{i}.py").write_text(f"def f{i}():\n    return {i}\n")
        run("add", "-A")
        when = (NOW + i * DAY).isoformat()
        run("-c", "user.name=Ann", "-c", "user.email=ann@x", "commit", "-q", "-m", subject, GIT_AUTHOR_DATE=when, GIT_COMMITTER_DATE=when)
    return root


def test_engine_end_to_end(spark, repo, capsys):
    e = FC.Engine(spark, str(repo), EngineConfig(embedding_dimension=32))
    e.setup()
    assert e.stats().first()["files"] == 5
    s = e.history_stats().first()
    assert (s["commits"], s["total_rows"]) == (4, 12)
    kinds = {r["type"] for r in e.store.read("signals").collect()}
    assert "fix_chain" in kinds and "ownership" in kinds
    assert e.file_profile("src/login.ts").first()["total_changes"] == 4
    r = e.assess(["src/login.ts"], "refactor", "login")
    assert r.file_profiles.count() == 1 and r.owners.first()["author"] == "Ann" and r.warnings.count() >= 1 and r.signals.count() >= 1
    assert e.search_history("login typo", unique_commits=True).first()["sha"]
    with open(repo / "f0.py", "w", encoding="utf-8") as f:
        f.write("def changed():\n    return 9\n")
    before = e.store.read("chunks").count()
    e.index_code_incremental()
    assert e.store.read("chunks").count() == before and e.store.read("chunks").where("content LIKE '%changed%'").count() == 1
    e.index_history_incremental()
    assert e.history_stats().first()["total_rows"] == 12
    e.analyze_incremental()
    assert "fix_chain" in {r["type"] for r in e.store.read("signals").collect()}
    out = main(["--repo", str(repo), "assess", "--files", "src/login.ts"], spark)
    assert "Owners:" in out and "src/login.ts" in out
    assert json.loads(main(["--repo", str(repo), "git-stats", "--format", "json"], spark))[0]["commits"] == 4
    capsys.readouterr()


def call(server, number, method, **params):
    return server.answer({"jsonrpc": "2.0", "id": number, "method": method, "params": params})


def test_tool_server(spark, repo):
    import io

    from strataline import mcp as M

    FC.Engine(spark, str(repo)).setup()
    server = M.Server(lambda: spark)
    ask = lambda name, **a: json.loads(call(server, 1, "tools/call", name=name, arguments=a | {"repo": str(repo)})["result"]["content"][0]["text"])
    assert call(server, 0, "initialize", protocolVersion="2025-03-26")["result"]["protocolVersion"] == "2025-03-26"
    assert server.answer({"jsonrpc": "2.0", "method": "notifications/initialized"}) is None and call(server, 5, "ping")["result"] == {}
    tools = call(server, 2, "tools/list")["result"]["tools"]
    assert [t["name"] for t in tools] == list(M.TOOLS) and len(tools) == 5 and all(t["inputSchema"]["type"] == "object" for t in tools)
    r = ask("strataline_assess", files=["src/login.ts"], change_type="refactor", query="login")
    assert set(r) == {"warnings", "file_profiles", "signals", "owners"} and r["owners"][0]["author"] == "Ann"
    r = ask("strataline_search", query="login", limit=2, filter="src/")
    assert r["query"] == "login" and [x["file_path"] for x in r["results"]] == ["src/login.ts"]
    r = ask("strataline_git_search", query="typo", type="fix", unique_commits=True, sort="date", after="2020-01-01T00:00:00Z", limit=1)
    assert len(r["results"]) == 1 and r["results"][0]["commit_type"] == "fix"
    r = ask("strataline_explain", query="login")
    assert set(r) == {"query", "code", "file_history", "history"} and r["code"]
    assert ask("strataline_file_profile", path="src/login.ts")["total_changes"] == 4 and "error" in ask("strataline_file_profile", path="no")
    for method, params, code in (("tools/call", {"name": "nope"}, -32602), ("tools/call", {"name": "strataline_search", "arguments": {}}, -32602), ("tools/call", {"name": "strataline_git_search", "arguments": {"query": "x", "sort": "up"}}, -32602), ("what", {}, -32601)):
        assert call(server, 9, method, **params)["error"]["code"] == code
    out = io.StringIO()
    M.serve(server, ['{"jsonrpc": "2.0", "id": 3, "method": "ping"}\n', "\n", "no json\n", "[1]\n"], out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert replies[0] == {"jsonrpc": "2.0", "id": 3, "result": {}} and replies[1]["error"]["code"] == -32700 and replies[2][0]["error"]["code"] == -32600
    assert call(server, 4, "tools/call", name="strataline_search", arguments={"query": "x", "repo": str(repo / "nowhere"), "limit": 1})["result"]


def test_tool_server_over_pipes():
    import sys

    lines = [{"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}]
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "strataline.mcp"], input="".join(json.dumps(x) + "\n" for x in lines), capture_output=True, text=True, cwd=root, timeout=120, check=True)
    first, second = map(json.loads, done.stdout.splitlines())
    assert first["result"]["serverInfo"]["name"] == "strataline" and len(second["result"]["tools"]) == 5


def test_command_line_flags(spark, repo, capsys):
    from strataline.cli import configured, parser

    c = configured(EngineConfig(), parser().parse_args(["git-index", "--provider", "openai", "--model", "m", "--max-commits", "0", "--full"]))
    assert (c.embedding_provider, c.embedding_model, c.git.max_commits) == ("openai", "m", 0)
    out = main(["--repo", str(repo), "git-index", "--full", "--max-commits", "2", "--verbose"], spark)
    assert "commits: 2" in out and '"max_commits": 2' in capsys.readouterr().err
    assert main(["--repo", str(repo), "setup", "--provider", "hashing", "--max-commits", "3", "--verbose"], spark).startswith("done\n")
    newest = FC.Engine(spark, str(repo)).store.read("git_history").where("chunk_type = 'commit_summary'")
    assert {r["subject"] for r in newest.collect()} == {"docs: readme", "fix: login again", "fix: login typo"}


def test_signals_as_records_and_back(spark):
    from strataline.schema import SIGNAL

    rows = [("1", "churn_hotspot", "s", "info", 0.5, "src", ["a", "b"], NOW, NOW + DAY, "f", None, "routine", '{"file": "f", "sigma": 2.5, "dominant_decision_class": "routine"}'), ("2", "ownership", "t", "info", 0.5, ".", [], NOW, NOW, None, None, None, "{}")]
    df = spark.createDataFrame(rows, SIGNAL)
    back = {r["id"]: r for r in ST.records_as_signals(ST.signals_as_records(df)).collect()}
    assert back["1"]["contributing_shas"] == ["a", "b"] and back["1"]["start"] == NOW and back["1"]["end"] == NOW + DAY and back["1"]["file"] == "f" and back["1"]["dominant_decision_class"] == "routine"
    assert back["2"]["contributing_shas"] == [] and back["2"]["file"] is None


def test_old_snapshots_stay_for_their_readers(spark, store):
    make = lambda n: signals(spark, [(str(n), "ownership", "src")])
    store.insert("signals", make(0), overwrite=True)
    old = store.read("signals")
    for n in (1, 2):
        store.insert("signals", make(n), overwrite=True)
    assert [r["id"] for r in old.collect()] == ["0"] and [r["id"] for r in store.read("signals").collect()] == ["2"]
    for n in range(3, 7):
        store.insert("signals", make(n), overwrite=True)
    assert len([p for p in os.listdir(f"{store.uri}/signals") if p.startswith("snapshot")]) == ST.KEPT + 1


def test_rendering():
    assert FC.render_code([], "q") == 'No results found for "q"' and FC.render_history([], "q") == 'No results found for "q"'
    assert FC.render_assessment([], [], []) == "No warnings detected for these files."


TYPESCRIPT = '''import x from "y"
export function a(u: {x: number}): {y: string} { const r = /[{(]/; return `${u}}` }
export default class extends X { m() { return '}' } }
export default class Named<T extends {a: 1}> extends Y<T> implements Z { }
class P {} class Q {}
const f = async <T,>(x: T): Promise<T> => { return x }, g = 3
const h = useCallback(() => { return 1 })
export type U = | { a: 1 }
  | { b: 2 }
type V = Map<string, (x: number) => void>;
interface I extends J<K> { a: string }
function over(a: string): void;
function over(a: any) { if (a / 2 > 1 / 3) { } }
const {d, e} = require("x"); let k = (a, b) => a / b; function* gen() {}
export const Card = () => <div className="a">Don't {x ? <b/> : null} it's</div>
export const z = function () { return 1 }
export async function last() {
}
// function no() {}
/* class no {} */
abstract class Abs { abstract x(): void; }
enum E { A }
'''

RUBY = '''require 'a'
module M
  TEXT = <<~SQL
    if x
      class Foo
    def bar
  SQL
  class A < B
    def x?; y if z; end
    def e = 3
    def w
      while a do
        b unless c
      end
      v = if a then 1 else 2 end
      x = %w[if do end]
      "end #{if a then 1 end}"
      foo(/end if/) do |q| q.class end
      h = { if: 1, :end => 2, class: 3 }
      obj.end; self.class
      loop { begin; rescue; end }
      case x when 1 then 2 end
    end
  end
end
def top(a, b = 3) = a + b
def self.go(x)
  return if x
  [1].each do |i| puts i end
end
class << self
  def q; end
end
class Z; end; class Y; def a; end; end
=begin
class No
=end
'''


def test_typescript_tokens():
    got = [(c.name, c.chunk_type, c.line_start, c.line_end, c.exported) for c in K.TypeScriptPlugin().chunks("src/a.tsx", pad(TYPESCRIPT))]
    assert got == [
        ("a", "function", 2, 2, True), ("Named", "class", 4, 4, True), ("P", "class", 5, 5, False), ("Q", "class", 5, 5, False), ("f", "function", 6, 6, False), ("U", "type", 8, 9, True), ("V", "type", 10, 10, False), ("I", "interface", 11, 11, False),
        ("over", "function", 13, 13, False), ("k", "function", 14, 14, False), ("gen", "function", 14, 14, False), ("Card", "component", 15, 15, True), ("z", "function", 16, 16, True), ("last", "function", 17, 18, True), ("Abs", "class", 21, 21, False),
    ]
    (only,) = (c for c in K.TypeScriptPlugin().chunks("src/a.tsx", pad(TYPESCRIPT)) if c.name == "Named")
    assert only.code.startswith("class Named") and only.code.endswith("{ }")


def test_ruby_tokens():
    got = [(c.name, c.chunk_type, c.line_start, c.line_end) for c in K.RubyPlugin().chunks("a.rb", pad(RUBY))]
    assert got == [("M", "class", 2, 25), ("top", "function", 26, 26), ("go", "function", 27, 30), ("Z", "class", 34, 34), ("Y", "class", 34, 34)]


def test_cuts_of_chunks():
    p, big = K.TypeScriptPlugin(), "class Big {" + " x() {}\n" * 400 + "}"
    (c,) = p.chunks("a.ts", big)
    note = "\n// ... truncated"
    assert K.chunk_text(p, "a.ts", big, c.code, 8000, c) == "// file: a.ts\n" + big + note  # large classes carry the note
    (w,) = p.chunks("a.ts", "let x = 1\n" * 400)
    assert w.whole and K.chunk_text(p, "a.ts", w.code, w.code, 10, w) == "// file: a.ts\n" + w.code
    short = K.chunk_text(p, "a.ts", big, c.code, 100, c)
    assert short.endswith(note) and len(short) == 400 + len(note)


@pytest.mark.parametrize("text", ["`", "/", "'", "${", "}`", "<<~A", "%w(", "def", "class", "=begin", "const x =", "export default", "function (", "({[", ")}]", "/[/", "\\", "a\n`${`${", "module\n", "end end", "?", "%"])
def test_scanners_take_any_text(text):
    for content in (text, pad(text), pad(text * 30), pad("x " + text + " y\n" + text)):
        for plugin, path in ((K.TypeScriptPlugin(), "a.ts"), (K.RubyPlugin(), "a.rb"), (K.PythonPlugin(), "a.py")):
            assert plugin.chunks(path, content)
