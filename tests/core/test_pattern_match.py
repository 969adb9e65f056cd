from callweave.operators import graph, pattern_match
from callweave.sources import files


def test_patterns_of_paths(spark):
    rows = [
        ("lib", "import", None, "lib", True), ("other", "import", None, "lib/sub", False), ("lib.a", "prop", "lib", "a", False), ("lib.b", "prop", "lib", "b", False), ("lib.a()", "call", "lib.a", None, False),
        ("lib()", "call", "lib", None, False), ("lib().a", "prop", "lib()", "a", False), ("lib().a()", "call", "lib().a", None, False), ("fn", "function", None, None, False), ("fn.a", "prop", "fn", "a", False),
    ]
    paths = spark.createDataFrame(rows, "ap string, kind string, on string, name string, default boolean")
    args = spark.createDataFrame([("lib.a()", 0, "x"), ("lib.a()", 1, "y"), ("lib().a()", 1, "z")], "ap string, pos int, arg string")
    ask = lambda *texts: {(r.pattern, r.ap) for r in pattern_match.matches(paths, args, texts).collect()}
    of = lambda text: {a for _, a in ask(text)}
    assert of("import lib/**/*") == {"other"}
    assert of("import lib{,/sub}") == {"lib", "other"}
    assert of("importD lib*") == {"lib"}
    assert of("read <lib>.{a,b}") == {"lib.a", "lib.b"}
    assert of("readO <lib>.{a,b}") == {"lib.b"}
    assert of("call <lib>.a") == {"lib.a()"}
    assert of("call {<lib>,<lib>()}.a") == {"lib.a()", "lib().a()"}
    assert of("call {<lib>,<lib>()}.a [2,2]") == {"lib.a()", "lib().a()"}
    assert of("call {<lib>,<lib>()}.a [0,9] [3,9]") == set()
    assert of("call <lib> [0,0]") == {"lib()"}
    assert ask("call <lib>", "read <lib>.b") == {("call <lib>", "lib()"), ("read <lib>.b", "lib.b")}
    assert ask() == set()


def test_used_files_and_loads(spark):
    m = spark.createDataFrame([("fs",), ("./a/../b.js",), ("/x/y.js",), ("/x/y.js",)], "module string")
    assert {r.file for r in graph.module_files(m, "/w").collect()} == {"/w/b.js", "/x/y.js"}
    loads = spark.createDataFrame([("f", "a", False), ("f", "b", True), ("g", "c", False), ("f", "a", True)], "fn string, module string, stored boolean")
    assert [r.module for r in graph.loaded_for_effect(loads, spark.createDataFrame([("f",)], "node string")).collect()] == ["a"]


def test_used_modules(spark):
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    homes = frame([("f", "m1"), ("g", "m2"), ("m1", "m1"), ("m2", "m2")], "node string, main string")
    usage = frame([("f", "p"), ("m1", "q"), ("g", "r"), ("f", "u")], "fn string, ap string")
    paths = frame([("p", "import", "/a.js"), ("q", "import", "/b.js"), ("r", "import", "/c.js"), ("u", "unknown", "")], "ap string, root string, root_file string")
    assert {r.module for r in graph.used_modules(frame([("f",)], "node string"), homes, usage, paths).collect()} == {"/a.js", "/b.js"}


def test_listing_inputs_and_tables(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"p": ["{RES}/a {RES}", "plain"], "q": []}')
    got = files.benchmark_inputs(spark, str(tmp_path / "in.json"), "/res").orderBy("ord").collect()
    assert [tuple(r) for r in got] == [("p", 0, "/res/p/a {RES}"), ("p", 1, "plain")]
    listing = spark.createDataFrame([(p,) for p in ("/z.js", "/a/b.js", "/a/c/d.js", "/LICENSE", "/a/x.txt", "/a/skip.js")], "path string")
    assert [r.path for r in files.scanned(listing, [".js", ".es"], ["skip.js"]).orderBy("ord").collect()] == ["/a/c/d.js", "/a/b.js", "/LICENSE", "/z.js"]
    table = files.latex_table(spark.createDataFrame([("b_c", 2), ("a%", 10)], "name string, n int"))
    assert table == "\\begin{tabular}{|c|c|}\n\\hline\na\\% & 10 \\\\ \\hline\nb\\_c & 2 \\\\ \\hline\n\\end{tabular}"
