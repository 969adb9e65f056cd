"""Personal data by weak supervision, with built-in functions only.

Exact patterns give the base spans. More spans are candidates: long keys, other long numbers, spelled-out addresses. Regex,
gazetteer and context labelers vote on every span; expectation-maximisation over the votes' patterns estimates how reliable
each labeler is, for each kind; the resulting probabilities train a naive Bayes classifier of the spans' features, which
decides on the candidates. Base spans stay whatever it says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.session import table, written

#: The patterns' matches are those of the plain forms named beside them. Possessive repeats and the look behind (or the end of
#: the match before) only keep long runs from being tried again from each of their places.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+",
    "number": r"(?<![0-9.])[0-9](?:[\x20./-]?[0-9]){8,18}+(?![0-9])",
    "handle": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(][Aa][Tt][\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(][Dd][Oo][Tt][\])])\x20?[A-Za-z0-9-]++)++",
}
#: One of what a text must hold before its pattern is tried at all.
NEEDS = {"email": ("@",), "phone": ("+",), "handle": ("[", "(")}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
CONTEXT = 24
ROUNDS = 20
ACCEPT = 0.5

#: Cue words before a span, words that speak against it, top-level domains, leading digits of card issuers.
CUES = "mail|email|mailto|contact|kontakt|correo|courriel|tel|telefon|telefono|telephone|phone|mobile|call|fon|card|carte|karte|tarjeta|visa|konto|account|iban|host|server|token|secret|password|passwort|passwd|api|apikey|key|ssn|passport"
AGAINST = "version|isbn|issn|doi|page|seite|figure|table|order|invoice|build|release|commit|sha|sha1|sha256|md5|hash"
DOMAINS = "com|net|org|edu|gov|info|io|de|fr|es|it|eu|uk|ch|at"
ISSUERS = "[3-6]"


def word(one_of: str) -> str:
    """A pattern for one of the words, whole: monkey is no key."""
    return f"(?<![a-z])({one_of})(?![a-z])"


def hits(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    if kind not in NEEDS:
        return found
    needed = [F.contains(text, F.lit(x)) for x in NEEDS[kind]]
    return F.when(F.greatest(*needed) if len(needed) > 1 else needed[0], found).otherwise(F.array().cast("array<string>"))


def placed(kind: str) -> str:
    """SQL: matches of a kind with start and end in code points, from the text cut at the matches and the matches h_<kind>."""
    pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    k = KINDS.index(kind)
    return f"""
    CASE WHEN size(h_{kind}) = 0 THEN CAST(array() AS array<struct<start:int,k:int,end:int,m:string>>) ELSE
    aggregate(zip_with(slice(split(text, '{pattern}', -1), 1, size(h_{kind})), h_{kind}, (g, m) -> named_struct('g', g, 'm', m)),
      CAST((0, array()) AS struct<at:int,out:array<struct<start:int,k:int,end:int,m:string>>>),
      (s, x) -> named_struct('at', s.at + char_length(x.g) + char_length(x.m), 'out', concat(s.out, array(named_struct(
        'start', s.at + char_length(x.g), 'k', {k}, 'end', s.at + char_length(x.g) + char_length(x.m), 'm', x.m)))),
      s -> s.out) END"""


DIGITS = "regexp_replace(m, '[^0-9]', '')"
LUHN = f"""(aggregate(transform(sequence(1, length({DIGITS})), i -> CASE WHEN i % 2 = 1 THEN int(substr({DIGITS}, -i, 1))
  ELSE 2 * int(substr({DIGITS}, -i, 1)) - CASE WHEN int(substr({DIGITS}, -i, 1)) > 4 THEN 9 ELSE 0 END END), 0, (a, b) -> a + b) % 10 = 0)"""
VALID = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(concat('0', substr(ltrim('0', p), 1, 3))) <= 255)",
    "card": f"(CASE WHEN length({DIGITS}) BETWEEN 12 AND 19 THEN {LUHN} ELSE false END)",
    "phone": f"length({DIGITS}) BETWEEN 9 AND 15",
    "secret": "m RLIKE '[0-9]' AND m RLIKE '[A-Za-z]'",
    "number": "true",
    "handle": "true",
}


def keep(kind: str) -> str:
    test = VALID[kind].replace("(m,", "(x.m,").replace("m RLIKE", "x.m RLIKE")
    return f"filter(s_{kind}, x -> {test})"


def spans(rows: DataFrame) -> DataFrame:
    """rows (text, ...) -> with base and extra: arrays of (start, k, end, m) in order; extra ones overlap no base span and no other extra one before them in KINDS."""
    kinds = list(PATTERNS)
    d = rows.select("*", *[hits(F.col("text"), k).alias(f"h_{k}") for k in kinds])
    d = d.select(*rows.columns, *[F.expr(placed(k)).alias(f"s_{k}") for k in kinds])
    d = d.select(*rows.columns, *[F.expr(keep(k)).alias(f"s_{k}") for k in kinds])
    d = d.withColumn("base", F.array_sort(F.concat(*[F.col(f"s_{k}") for k in BASE])))
    free = lambda k, of: F.expr(f"filter(s_{k}, x -> NOT exists({of}, b -> b.start < x.end AND x.start < b.end))")
    d = d.withColumn("extra", F.array().cast("array<struct<start:int,k:int,end:int,m:string>>"))
    for k in kinds:
        if k not in BASE:
            d = d.withColumn("extra", F.concat("extra", free(k, "concat(base, extra)")))
    return d.select(*rows.columns, "base", "extra")


def seen(name: str) -> str:
    """SQL: an array of spans with the votes v (0 no, 1 yes, 2 none) and the features f of each."""
    left = f"lower(substr(text, greatest(x.start - {CONTEXT}, 0) + 1, least(x.start, {CONTEXT})))"
    right = "substr(text, x.end + 1, 1)"
    near = "substr(text, greatest(x.start, 1), least(x.start, 1))"
    digits = "length(regexp_replace(x.m, '[^0-9]', ''))"
    votes = [
        # regex: the exact forms, and how long keys and numbers look that are drawn at random
        f"CASE WHEN x.k < {len(BASE)} THEN 1 WHEN x.k = 4 THEN int(x.m RLIKE '^([0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}}|[A-Za-z]{{2,4}}[_-][A-Za-z0-9_-]+)$') WHEN x.k = 5 THEN int(x.m RLIKE '^([0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}|[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}})$') ELSE 1 END",
        # gazetteers: known domains, issuers, private networks
        f"CASE WHEN x.k IN (0, 6) THEN CASE WHEN lower(x.m) RLIKE '(?<![a-z0-9-])({DOMAINS})$' THEN 1 ELSE 0 END WHEN x.k IN (2, 5) THEN CASE WHEN x.m RLIKE '^{ISSUERS}' THEN 1 ELSE 0 END WHEN x.k = 1 THEN CASE WHEN x.m RLIKE '^(0|127|255)[.]' THEN 0 ELSE 1 END ELSE 2 END",
        # context: cue words before the span, words against it, and assignment
        f"CASE WHEN {left} RLIKE '{word(CUES)}' THEN 1 ELSE 2 END",
        f"CASE WHEN {left} RLIKE '{word(AGAINST)}' THEN 0 ELSE 2 END",
        f"CASE WHEN {left} RLIKE '[=:] ?\"?$' THEN 1 WHEN {left} RLIKE '[#/._-]$' THEN 0 ELSE 2 END",
    ]
    features = [
        f"CASE WHEN length(x.m) < 12 THEN 0 WHEN length(x.m) < 20 THEN 1 WHEN length(x.m) < 33 THEN 2 ELSE 3 END",
        f"CASE WHEN {digits} = 0 THEN 0 WHEN 4 * {digits} < length(x.m) THEN 1 WHEN 4 * {digits} < 3 * length(x.m) THEN 2 ELSE 3 END",
        "CASE WHEN x.m RLIKE '[A-Z]' AND x.m RLIKE '[a-z]' THEN 2 WHEN x.m RLIKE '[A-Z]' THEN 1 ELSE 0 END",
        f"CASE WHEN {near} = '' THEN 0 WHEN {near} RLIKE '[ \\\\n\\\\t]' THEN 1 WHEN {near} RLIKE '[(<\"=:]' THEN 2 ELSE 3 END",
        f"CASE WHEN {right} = '' THEN 0 WHEN {right} RLIKE '[ \\\\n\\\\t]' THEN 1 WHEN {right} RLIKE '[)>\".,;]' THEN 2 ELSE 3 END",
        f"int({left} RLIKE '{word(CUES)}')",
    ]
    return f"transform({name}, x -> named_struct('x', x, 'v', array({', '.join(f'int({v})' for v in votes)}), 'f', array({', '.join(f'int({f})' for f in features)})))"


N_VOTES, N_FEATURES, F_VALUES = 5, 6, 4


def reliabilities(patterns: str = "p") -> str:
    """SQL: (prior, t) from an array of (c count, v votes), by ROUNDS rounds of expectation and maximisation.

    t[6 l + 3 y + v] is the probability that labeler l votes v on a span of class y. Rounds begin at the majority of votes.
    """
    first = "(1D + size(filter(x.v, a -> a = 1))) / (2D + size(filter(x.v, a -> a < 2)))"
    side = lambda y: f"aggregate(sequence(0, {N_VOTES - 1}), {'s.prior' if y else '1D - s.prior'}, (a, l) -> a * s.t[6 * l + {3 * y} + x.v[l]])"
    later = f"{side(1)} / ({side(0)} + {side(1)})"
    total = "aggregate(w, 0D, (a, x) -> a + x.c)"
    mass = "aggregate(w, 0D, (a, x) -> a + x.c * CASE WHEN k % 6 < 3 THEN 1D - x.q ELSE x.q END)"
    voted = "aggregate(w, 0D, (a, x) -> a + CASE WHEN x.v[int(k DIV 6)] = k % 3 THEN x.c * CASE WHEN k % 6 < 3 THEN 1D - x.q ELSE x.q END ELSE 0D END)"
    fit = f"named_struct('prior', (1D + aggregate(w, 0D, (a, x) -> a + x.c * x.q)) / (2D + {total}), 't', transform(sequence(0, {6 * N_VOTES - 1}), k -> (0.1D + {voted}) / (0.3D + {mass})))"
    weigh = lambda q: f"transform({patterns}, x -> named_struct('c', x.c, 'v', x.v, 'q', {q}))"
    let = lambda value: f"transform(array({value}), w -> {fit})[0]"
    return f"aggregate(sequence(1, {ROUNDS}), {let(weigh(first))}, (s, i) -> {let(weigh(later))})"


def belief(s: str, v: str) -> str:
    """SQL: the probability that a span with votes v is personal data."""
    side = lambda y: f"aggregate(sequence(0, {N_VOTES - 1}), {f'{s}.prior' if y else f'1D - {s}.prior'}, (a, l) -> a * {s}.t[6 * l + {3 * y} + {v}[l]])"
    return f"{side(1)} / ({side(0)} + {side(1)})"


def train(marked: DataFrame) -> DataFrame:
    """marked: rows with `seen`, an array of spans with votes and features -> (k, prior, reliability, odds, base_odds), one row a kind.

    The corpus goes into one count for each kind, vote pattern and feature pattern: 3^5 * 4^6 cells a kind at the most, however
    large it is. reliability is t of reliabilities(); odds[4 j + a] is the log of how much likelier value a of feature j is
    among personal data than elsewhere.
    """
    cells = written(marked.select(F.explode("seen").alias("s")).groupBy(F.col("s.x.k").alias("k"), F.col("s.v").alias("v"), F.col("s.f").alias("f")).agg(F.count("*").cast("double").alias("c")))
    votes = cells.groupBy("k", "v").agg(F.sum("c").alias("c")).groupBy("k").agg(F.expr("array_sort(collect_list(named_struct('c', c, 'v', v)))").alias("p"))
    model = votes.select("k", F.expr(reliabilities()).alias("m"))
    soft = cells.join(model, "k").select("k", "f", "c", F.expr(belief("m", "v")).alias("q"), "m")
    each = soft.select("k", F.posexplode("f").alias("j", "a"), "c", "q")
    counts = each.groupBy("k", "j", "a").agg(F.sum(F.col("c") * F.col("q")).alias("yes"), F.sum(F.col("c") * (1 - F.col("q"))).alias("no"))
    sums = counts.where("j = 0").groupBy("k").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    odds = counts.join(sums, "k").select("k", "j", "a", F.expr(f"ln((yes + 0.1D) / (all_yes + {0.1 * F_VALUES}D)) - ln((no + 0.1D) / (all_no + {0.1 * F_VALUES}D))").alias("odds"))
    table_ = odds.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct((F.col("j") * F_VALUES + F.col("a")).alias("key"), "odds"))).alias("odds"))
    base = sums.select("k", F.expr("ln((all_yes + 0.1D) / (all_no + 0.1D))").alias("base_odds"))
    return model.join(table_, "k").join(base, "k").select("k", F.col("m.prior").alias("prior"), F.col("m.t").alias("reliability"), "odds", "base_odds")


def text_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def joined(name: str) -> Column:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({name}, x -> concat(array({kinds})[x.k], ':', x.start, ':', x.end)), ',')")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row for each row of docs.

    Spans are kind:start:end in code points from 0, end exclusive, by start, then kind. A null text counts as empty: no
    spans, the digest of the empty string. Null ids and repeated rows stay; extra columns are not read; an empty table gives
    an empty one. The corpus is read twice: once for the classifier's counts, once for the spans. Nothing else is shuffled.
    """
    found = spans(text_of(docs, id_col, text_col))
    model = train(found.select(F.expr(seen("concat(base, extra)")).alias("seen")))
    odds = written(model.select("k", "odds", "base_odds")).select(F.map_from_entries(F.collect_list(F.struct("k", F.struct("odds", "base_odds")))).alias("odds")).scalar()
    score = f"aggregate(sequence(0, {N_FEATURES - 1}), odds[y.x.k].base_odds, (a, j) -> a + coalesce(odds[y.x.k].odds[{F_VALUES} * j + y.f[j]], 0D))"
    limit = f"ln({ACCEPT}D / {1 - ACCEPT}D)"
    d = found.withColumn("looked", F.expr(seen("extra"))).withColumn("odds", F.when(F.size("extra") > 0, odds))
    d = d.withColumn("added", F.expr(f"CASE WHEN size(extra) = 0 THEN extra ELSE transform(filter(looked, y -> {score} > {limit}), y -> y.x) END"))
    number = [F.expr(f"CAST(size(filter(base, x -> x.k = {k})) AS BIGINT)").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return d.select("doc_id", *number, F.sha2(joined("base"), 256).alias("base_sha256"), joined("array_sort(concat(base, added))").alias("spans"), F.size("added").cast("long").alias("n_added"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
