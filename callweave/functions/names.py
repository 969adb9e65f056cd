"""Names of packages, modules, paths and globals as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions.text import module_of

# Names that stand for something built in, and those of them that stand for another one.
GLOBALS = """Promise JSON console Symbol global globalThis Array Error TypeError RangeError System Map WeakMap Set RegExp Reflect Dict Object
Function Number String Boolean navigator window Date FormData DataView Buffer ArrayBuffer require exports isNaN isFinite parseFloat parseInt Math
encodeURI encodeURIComponent decodeURI decodeURIComponent eval escape unescape EvalError ReferenceError SyntaxError URIError Uint8Array util stream
child_process setInterval setImmediate queueMicrotask process Polyglot Int8Array Uint8ClampedArray Int16Array Uint16Array Int32Array Uint32Array
Float32Array Float64Array BigInt64Array BigUint64Array BigInt WeakSet Proxy SharedArrayBuffer Atomics Intl Collator NumberFormat DateTimeFormat
PluralRules ListFormat RelativeTimeFormat Segmenter DisplayNames Locale Java""".split()
ALIASES = {"globalThis": "global", "window": "global", "parseInt": "parseFloat"}
#: Modules that the run time itself brings.
BUILTIN_MODULES = """assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2
https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder timers tls trace_events tty url util v8
vm wasi worker_threads zlib""".split()

BUILT_IN = "BUILT_IN"


def builtin_global(name: Column) -> Column:
    """The built-in import that a global name stands for, or null."""
    own = F.when(name.isin(GLOBALS), name)
    for alias, of in ALIASES.items():
        own = F.when(name == alias, of).otherwise(own)
    return own


def is_builtin_module(name: Column) -> Column:
    """Whether a load needs no file: a module of the run time, also a part of one or with node: before it, or a name that begins with nodejs. Null is none."""
    bare = F.regexp_replace(name, "^node:", "")
    return F.coalesce(F.split_part(bare, F.lit("/"), F.lit(1)).isin(BUILTIN_MODULES) | name.startswith("nodejs"), F.lit(False))


def package(text: Column) -> Column:
    """name@version, where the name may begin with @, as (name, version). Without a second @ both are cut as they stand: the version is all after the first."""
    at = F.when(text.startswith("@"), F.locate("@", text, 2)).otherwise(F.locate("@", text))
    return F.when(text.isNotNull(), F.struct(F.left(text, F.greatest(at - 1, F.lit(0))).alias("name"), F.substring(text, at + 1, F.length(text)).alias("version")))


def package_string(name: Column, version: Column) -> Column:
    return F.concat(name, F.lit("@"), version)


def packed_name(name: Column) -> Column:
    """The name of a package's archive: the first / is a hyphen, the first @ goes."""
    first = lambda text, mark, to: F.when(text.contains(mark), F.concat(F.substring_index(text, mark, 1), F.lit(to), F.substring(text, F.locate(mark, text) + 1, F.length(text)))).otherwise(text)
    return first(first(name, "/", "-"), "@", "")


def module_or_main(path: Column, main: Column) -> Column:
    """The package folder of a path, or the main module where it is in none."""
    return F.when(path.contains("node_modules"), module_of(path)).otherwise(main)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def dirname(path: Column) -> Column:
    """All before the last name: . where there is nothing, / at the root."""
    cut = F.regexp_extract(path, "^(.*?)/+[^/]*/*$", 1)
    return F.when(cut != "", cut).when(path.startswith("/"), "/").otherwise(".")


def normalized(path: Column) -> Column:
    """A path without empty names, . and, where a name stands before it, `..`; a null stays one."""
    step = lambda done, name: (
        F.when(name.isin("", "."), done)
        .when((name == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(F.concat(F.array(F.lit("..")), done), -1), F.lit("..")) != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
        .when((name == "..") & path.startswith("/"), done)
        .otherwise(F.concat(done, F.array(name)))
    )
    names = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    out = F.concat(F.when(path.startswith("/"), "/").otherwise(""), names, F.when(path.endswith("/") & (names != ""), "/").otherwise(""))
    return F.when(path.isNotNull(), F.when(out == "", ".").when(out == "/", "/").otherwise(out))


def resolved(folder: Column, path: Column) -> Column:
    """A path as seen from a folder: absolute ones stay; without a / at the end."""
    whole = normalized(F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path)))
    return F.when(whole == "/", whole).otherwise(F.regexp_replace(whole, "/$", ""))


def relative(folder: Column, path: Column) -> Column:
    """The way from one absolute folder to an absolute path."""
    parts = lambda p: F.filter(F.split(normalized(p), "/"), lambda x: x != "")
    a, b = parts(folder), parts(path)
    same = F.transform(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda n: F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))
    n = F.size(F.filter(same, lambda x: x)) - 1
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - n), F.slice(b, n + 1, F.size(b))), "/")


def dynamic_edge(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit("->"), target)


def value_type(json: Column) -> Column:
    """The type that a script gives a JSON value; lists and null are objects, no value is undefined."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)
    return F.when(json.isNull() | v.isNull(), "undefined").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.rlike("^(OBJECT|ARRAY|VOID)"), "object").otherwise("number")
