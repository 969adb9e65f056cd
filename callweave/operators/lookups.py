"""Joins of reads with writes, emits with listeners, calls with callbacks; prefixes and suffixes meet as equal keys, never in nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.functions.names import BUILT_IN

#: Built-in methods that call an argument, and its position; -1 for every argument.
BUILTIN_CALLBACKS = [("forEach", 0), ("filter", 0), ("map", 0), ("reduce", 0), ("some", 0), ("every", 0), ("catch", 0), ("then", 0), ("sort", 0), ("find", 0), ("readFile", 1), ("replace", 1), ("call", -1)]


#: Ids with at most so many keys are told apart by the set of these; members of a set go in blocks of about so many.
SET, BLOCK = 1_000, 1_024


def sets_of(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (id, key...) -> (set, key...), the different sets of keys that ids have, and (set, ids), who has them, in blocks."""
    d = rows.repartition("id").distinct().withColumn("n", F.count("*").over(W.partitionBy("id")))
    name = lambda c: F.unhex(F.sha2(F.to_json(F.struct(c)), 256)).alias("set")
    few = d.where(F.col("n") <= SET).groupBy("id").agg(F.array_sort(F.collect_set(F.struct(*key))).alias("keys")).select("id", name(F.col("keys")), "keys")
    many = d.where(F.col("n") > SET).select("id", name(F.col("id")), *key)
    sets = few.groupBy("set").agg(F.any_value("keys").alias("keys")).select("set", F.explode("keys").alias("k")).select("set", "k.*").union(many.select("set", *key))
    who = few.select("set", "id").union(many.select("set", "id").distinct())
    size = who.groupBy("set").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")
    return sets, who.join(size, "set").groupBy("set", block).agg(F.collect_list(F.struct("id")).alias("ids")).select("set", "ids")


def met(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(a, b), once each: the ids of left (id, key...) and of right (id, key...) that have a key in common.

    Ids with equal sets of keys have equal partners, so that sets meet and not ids; each pair of sets gives all pairs of their members,
    blocks of which are dealt over all tasks. What is shuffled grows with the input and the pairs of sets, not with the pairs of ids.
    """
    keys = lambda d: d.select(key).distinct()
    own, who = sets_of(left.join(keys(right), key, "left_semi").select("id", *key), key)
    other, whom = sets_of(right.join(keys(left), key, "left_semi").select("id", *key), key)
    pairs = own.withColumnRenamed("set", "one").join(other.withColumnRenamed("set", "two"), key).select("one", "two").distinct()
    blocks = pairs.join(who.toDF("one", "a"), "one").join(whom.toDF("two", "b"), "two").select("a", "b")
    dealt = blocks.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def fields(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """reads (read, module, prop) with the values `ap` written to the same property in the same module."""
    out = met(reads.withColumnRenamed("read", "id"), writes.withColumnRenamed("ap", "id"), ["module", "prop"])
    return out.toDF("read", "ap")


def scoped(writes: DataFrame, scope: DataFrame) -> DataFrame:
    """writes (module, prop, ap) as seen from each module whose scope (module, member) has the writer."""
    seen = writes.select(F.struct("prop", "ap").alias("id"), F.col("module").alias("member"))
    return met(scope.withColumnRenamed("module", "id"), seen, ["member"]).select(F.col("a").alias("module"), "b.*")


def starts(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(text)), lambda i: F.substring(text, F.lit(1), i))


def ends(text: Column) -> Column:
    n = F.length(text)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, n - i + 1, i))


def own_key(kind: Column, text: Column) -> Column:
    return F.concat(F.upper(F.substring(kind, 1, 1)), F.lit(":"), text)


def covered_keys(kind: Column, text: Column) -> Column:
    """Keys of all the literals, prefixes and suffixes that a literal, a prefix or a suffix may be an instance of."""
    tag = lambda t, of: F.transform(of, lambda x: F.concat(F.lit(t), x))
    none = F.array().cast("array<string>")
    return F.concat(F.when(kind != "suffix", tag("P:", starts(text))).otherwise(none), F.when(kind != "prefix", tag("S:", ends(text))).otherwise(none), F.when(kind == "literal", F.array(F.concat(F.lit("L:"), text))).otherwise(none))


def wild_fields(reads: DataFrame, patterns: DataFrame) -> DataFrame:
    """reads (read, prop) with the values written to properties known by prefix or suffix only: patterns (kind, text, ap)."""
    keys = reads.select("read", F.explode(covered_keys(F.lit("literal"), F.col("prop"))).alias("key"))
    return keys.join(patterns.select(own_key(F.col("kind"), F.col("text")).alias("key"), "ap"), "key").select("read", "ap").distinct()


def read_by_pattern(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """reads (read, kind, text) of properties known by prefix or suffix only, with the values written to exact names: writes (prop, ap). Properties written by pattern are not asked."""
    keys = writes.select("ap", F.explode(covered_keys(F.lit("literal"), F.col("prop"))).alias("key"))
    return keys.join(reads.where("kind <> 'literal'").select("read", own_key(F.col("kind"), F.col("text")).alias("key")), "key").select("read", "ap").distinct()


def listeners(emits: DataFrame, on: DataFrame) -> DataFrame:
    """(emit, callback): emits (emit, kind, text) and listeners on (kind, text, callback) whose event names can be equal; kind literal, prefix or suffix. A prefix and a suffix never match."""
    key = own_key(F.col("kind"), F.col("text")).alias("key")
    keys = F.explode(covered_keys(F.col("kind"), F.col("text"))).alias("key")
    one = emits.select("emit", keys).join(on.select(key, "callback"), "key")
    two = emits.select("emit", key).join(on.select(keys, "callback"), "key")
    return one.select("emit", "callback").union(two.select("emit", "callback")).distinct()


def builtin_callbacks(calls: DataFrame) -> DataFrame:
    """calls (edge, prop, pos, ap): the arguments that a built-in method itself calls."""
    known = F.broadcast(calls.sparkSession.createDataFrame(BUILTIN_CALLBACKS, "prop string, at int"))  # 13 rows
    return calls.join(known, "prop").where("at = pos OR at = -1").select("edge", "ap").distinct()


def constructed(calls: DataFrame, constructor: str = "Promise") -> DataFrame:
    """calls (edge, module, name, pos, ap) of built-in modules, module BUILT_IN, by name: the first argument of a constructor that calls it at once."""
    return calls.where((F.col("module") == BUILT_IN) & (F.col("name") == constructor) & (F.col("pos") == 0)).select("edge", "ap").distinct()


def usages(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """(package, key, usage): for each export of a package, keys (package, key, file, line, column), every path that its code calls, calls (package, file, path, is_require) but for loads, and where the export is, if in a file that is not that of the calls."""
    paths = calls.where(~F.col("is_require")).select("package", F.col("path").alias("usage")).distinct()
    own = calls.select("package", F.col("file").alias("code")).distinct()
    foreign = keys.join(own, "package").where("file <> code").select("package", "key", F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string")).alias("usage"))
    return keys.select("package", "key").distinct().join(paths, "package").unionByName(foreign).distinct()


def usage_summary(usage: DataFrame) -> DataFrame:
    """(key, usages): what usage (key, usage) has of each key, in order, as a JSON list."""
    return usage.groupBy("key").agg(F.to_json(F.array_sort(F.collect_set("usage"))).alias("usages"))


def exports(calls: DataFrame, exported: DataFrame) -> DataFrame:
    """calls (call, file, path, fallback) with the function exported (file, path, fn) there, or else the fallback."""
    return calls.join(exported, ["file", "path"], "left").select("call", F.coalesce("fn", "fallback").alias("callee")).distinct()


def args_string(args: Column) -> Column:
    """Sets joined by ', ', positions by ';'."""
    return F.array_join(F.transform(args, lambda x: F.array_join(x, ", ")), ";")
