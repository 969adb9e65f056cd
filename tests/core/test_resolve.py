import posixpath
import random

from callweave.operators import resolve

NODE = ("", ".js", ".json", ".node")
INDEX = ("/index.js", "/index.json", "/index.node")


def brute(file, spec, files, mains):
    """A file's import as a run time looks for it, one path after the other."""
    if not spec:
        return "MODULE_NOT_FOUND"
    if spec in ("fs", "node:fs", "fs/promises"):
        return "BUILT_IN"
    folder = posixpath.dirname(file)

    def load(x):
        tries = [] if x.endswith("/") else [x + e for e in NODE]
        x = x.rstrip("/")
        if main := mains.get(x):
            tries += [posixpath.normpath(posixpath.join(x, main)) + e for e in NODE + INDEX]
        return next((t for t in tries + [x + e for e in INDEX] if t in files), None)

    if spec.startswith(("/", "./", "../")) or spec in (".", ".."):
        return load(posixpath.normpath(posixpath.join(folder, spec))) or "MODULE_NOT_FOUND"
    while True:
        if posixpath.basename(folder) != "node_modules" and (hit := load(posixpath.join(folder, "node_modules", spec))):
            return hit
        if folder == "/":
            return "MODULE_NOT_FOUND"
        folder = posixpath.dirname(folder)


def test_resolution_against_one_path_after_the_other(spark):
    rng = random.Random(5)
    names = ["a", "b", "@s/p", "lib", "x.js"]
    tops = ["", "/app", "/app/src", "/app/node_modules/a", "/app/node_modules/a/node_modules/b", "/app/src/node_modules/lib", "/node_modules/b"]
    files = {f"{rng.choice(tops)}{rng.choice(['', '/node_modules'])}/{rng.choice(names)}{rng.choice(NODE + INDEX + ('/lib/m.js', '/lib/index.json'))}" for _ in range(150)}
    mains = {f"{rng.choice(tops)}/node_modules/{n}": rng.choice(["lib/m", "./lib", "index", "../b", "gone", ""]) for n in names for _ in range(3)}
    specs = ["a", "b", "@s/p", "lib", "lib/lib/m", "x", "./a", "../b", "./lib", ".", "..", "/app/src/a", "fs", "node:fs", "fs/promises", "gone", "", None, "x.js"]
    asks = [(f"{t}/{n}", s) for t in tops for n in ("main.js", "node_modules/q.js") for s in specs]
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    got = resolve.resolved(frame(asks, "file string, spec string"), frame([(f,) for f in files], "path string"), frame(sorted(mains.items()), "folder string, main string"))
    got = {(r.file, r.spec): r.target for r in got.collect()}
    want = {(f, s): brute(f, s, files, mains) for f, s in asks}
    assert got == want
    assert len(set(want.values())) > 15


def test_empty(spark):
    frame = lambda kinds: spark.createDataFrame([], kinds)
    asks = spark.createDataFrame([("/a.js", "./b")], "file string, spec string")
    assert resolve.resolved(asks, frame("path string"), frame("folder string, main string")).first().target == "MODULE_NOT_FOUND"
    assert resolve.resolved(asks.limit(0), frame("path string"), frame("folder string, main string")).collect() == []
