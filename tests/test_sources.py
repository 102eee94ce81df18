import json

import pytest

from fragmill import cli
from fragmill.project import Project, build
from fragmill.sources import files, store, traces
from fragmill.streaming import incremental

JAVA = '''package a;
/** Keeps users. @since 1 */
@Service("users")
public class UserStore extends Base implements Closeable {
  private final Cache cache = new Cache();
  @GetMapping("/user/42") public User getUser(long id) { check(id); return cache.lookup(id); }
  UserStore() { super(); }
  static class Inner { void close() { this.flush(); } abstract void flush(); }
}
enum Color { RED, GREEN }
public @interface Marker { String value(); }
'''
PYTHON = '''
class Store(Base):
    """Keeps things."""
    @cached
    def get(self, key):
        "Looks up."
        return self.load(key)
    def load(self, key): return read(key)
def read(key): return key
'''


def test_java_declarations():
    found = {(d["container"], d["name"]): d for d in files.Java().scan(JAVA)}
    assert {(c, n): d["kind"] for (c, n), d in found.items()} == {("", "UserStore"): "class", ("UserStore", "cache"): "field", ("UserStore", "getUser"): "method", ("UserStore", "UserStore"): "constructor", ("UserStore", "Inner"): "class", ("UserStore.Inner", "close"): "method", ("UserStore.Inner", "flush"): "method", ("", "Color"): "enum", ("", "Marker"): "annotation_type", ("Marker", "value"): "method"}
    store_ = found["", "UserStore"]
    assert store_["supertypes"] == ["Base", "Closeable"] and store_["doc"] == "Keeps users. @since 1"
    assert store_["annotations"] == [{"name": "Service", "args": '"users"'}] and store_["modifiers"] == ["public"]
    get = found["UserStore", "getUser"]
    assert get["annotations"][0]["name"] == "GetMapping"
    assert get["calls"] == [{"name": "check", "receiver": None}, {"name": "lookup", "receiver": "cache"}]
    assert found["UserStore.Inner", "close"]["calls"] == [{"name": "flush", "receiver": "this"}]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    (root / "src").mkdir()
    (root / "src" / "store.py").write_text(PYTHON)
    (root / "src" / "broken.py").write_text("def (:")
    (root / "src" / "UserStore.java").write_text(JAVA)
    (root / "src" / "many.py").write_text("\n".join(f"def plain_{k}_name(): pass" for k in range(30)).replace("plain_", "plainword"))
    path = str(root / ".fragmill")
    return root, path, build(spark, path, [(str(root), "python"), (str(root), "java")])


def test_build_and_search(spark, index):
    _, path, meta = index
    assert meta["failed_files"] == 1 and meta["languages"] == ["java", "python"]
    project = Project(spark, path)
    symbols = {r.name: r for r in project.context.symbols.collect()}
    assert sorted(r.symbol_id for r in symbols.values()) == sorted({r.symbol_id for r in symbols.values()})
    edges = {(r.src, r.dst, r.kind, r.provenance) for r in project.context.edge_table.collect()}
    assert (symbols["get"].symbol_id, symbols["load"].symbol_id, "calls", "typed_receiver") in edges
    assert (symbols["load"].symbol_id, symbols["read"].symbol_id, "calls", "name_match") in edges
    assert (symbols["Store"].symbol_id, symbols["get"].symbol_id, "contains", "derived_container") in edges
    hit = project.search("how does lookup getUser?", limit=3)
    assert hit.route == "lexical"
    assert "getUser" in {r.name for r in project.search("the user mapping", limit=5).hits.collect()}
    assert project.describe()["kinds"]["class"] == 3
    meta = {(r.key, r.target): r.score for r in project.context.expansion.where("reason = 'meta'").collect()}
    assert meta["@RequestMapping", "@GetMapping"] == 1.0 and meta["@Component", "@SpringBootApplication"] == 0.8


def test_index_needs_its_mark(spark, index, tmp_path):
    root, path, _ = index
    assert cli.find_index(str(root / "src")) == path
    assert cli.main(["nonsense"]) == 2
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path))
    (tmp_path / "meta.json").write_text(json.dumps({"format_version": 99}))
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path))


def test_a_language_of_ones_own(spark):
    class Toy(files.Language):
        name, globs = "toy", ("*.toy",)

        def scan(self, source):
            return [{"name": w, "kind": "class"} for w in source.split()]

    try:
        files.register(Toy())
        with pytest.raises(ValueError):
            files.register(Toy())
        got = files.declarations(spark.createDataFrame([("a.toy", "x y"), ("b.toy", None)], "file string, text string"), "toy")
        assert sorted(r.name for r in got.collect()) == ["x", "y"]
        assert files.language_of("a/b.toy").name == "toy" and files.language_of("a.zzz") is None
    finally:
        files.LANGUAGES.pop("toy", None)


def test_traces(spark, tmp_path):
    turns = [{"role": "user", "content": "find it"}, {"role": "assistant", "content": json.dumps([{"type": "text", "text": "a"}, {"type": "text", "text": "b"}])}, {"role": "tool", "content": "out", "name": "rg"}]
    good = {"repo": "r", "language": "Java", "instance_id": "i", "trajectory_id": "t", "base_commit": "c", "trajectory": turns}
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps(good), json.dumps({**good, "language": "Go"}), "{broken"]))
    got = traces.read_traces(spark, str(tmp_path / "t.jsonl")).orderBy("turn").collect()
    assert [(r.turn, r.role, r.tool, r.text) for r in got] == [(0, "user", None, "find it"), (1, "assistant", None, "a\nb"), (2, "tool", "rg", "out")]


def test_trace_errors_have_lines(spark, tmp_path):
    good = {"repo": "r", "language": "java", "instance_id": "i", "trajectory_id": "t", "trajectory": [{"role": "user", "content": "x"}]}
    lines = [json.dumps(good), "", "{broken", "[1]", json.dumps({**good, "language": "Go"}), json.dumps({**good, "repo": " "}), json.dumps({**good, "trajectory": []}), json.dumps(good)]
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    try:
        got = [(r.line, r.error) for r in traces.trace_errors(spark, str(path)).orderBy("line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(3, "invalid JSON"), (4, "no JSON object"), (5, "no Java trace: Go"), (6, "missing repo"), (7, "no trajectory")]
    with pytest.raises(ValueError, match="line 3: invalid JSON"):
        traces.read_traces(spark, str(path), strict=True)
    path.write_text(json.dumps(good))
    assert traces.read_traces(spark, str(path), strict=True).count() == 1


def test_corpus_grows(spark, tmp_path):
    from fragmill.sources import corpus

    rows = spark.createDataFrame([(1, ["a", "b"])], "symbol_id long, words array<string>")
    for _ in range(2):
        corpus.append(rows, str(tmp_path / "c"))
    assert corpus.size(spark, str(tmp_path / "c")) == 2
    assert corpus.read(spark, str(tmp_path / "c")).first().words == ["a", "b"]


def test_receivers_by_scope_and_field(spark, tmp_path):
    from fragmill.project import build

    source = """class Foo { void hit() { } } class Other { void hit() { } } class Bar { void go() { } }
class A { private Foo foo; void run(Bar b) { Other o = new Other(); b.go(); o.hit(); foo.hit(); this.foo.hit(); nobody.lost(); } }"""
    declared = files.declarations(spark.createDataFrame([("A.java", source)], "file string, text string"), "java")
    meta = build(spark, str(tmp_path / "index"), declared)
    parts, _ = store.load(spark, str(tmp_path / "index"))
    names = {r.symbol_id: f"{r.container}.{r.name}" for r in parts["symbols"].collect()}
    edges = {(names[r.src], names[r.dst], r.provenance) for r in parts["edges"].where("kind = 'calls'").collect()}
    assert edges == {("A.run", "Bar.go", "typed_receiver"), ("A.run", "Other.hit", "typed_receiver"), ("A.run", "Foo.hit", "typed_receiver")}
    assert meta["built"]["typed"] == 3 and meta["built"]["unresolved"] == 1 and meta["built"]["calls"] == 3 and meta["built"]["contains"] == 5


def test_streaming_postings_equal_batch(spark, tmp_path):
    from fragmill.operators import index as I

    rows = [(k, f"getUser{k}", "some words here", "Owner") for k in range(20)]
    symbols = spark.createDataFrame(rows, "symbol_id long, name string, doc string, container string")
    for part in (0, 1):
        symbols.where(f"symbol_id % 2 = {part}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(symbols.schema).parquet(str(tmp_path / "in"))
        incremental.start(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = incremental.postings(spark, str(tmp_path / "out"))
    want = I.postings(I.declaration_terms(symbols))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
