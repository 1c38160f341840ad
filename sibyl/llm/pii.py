r"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame operations alone.

Base spans are regular-expression matches with a test for each kind. They seed the method: words left and right of
seeds are lexical patterns, and patterns and identifiers form a graph. The confidence of a pattern for a kind is
the score of the identifiers beside it against all occurrences of its word in the corpus; an identifier that is
not a seed scores the noisy-or of its patterns. Scores go round until a round finds no new identifier: those found
in one round bring patterns in the next. Identifiers over the threshold are spans wherever they stand, if nothing of the base
overlaps them there.

Candidates are what looks like an identifier without being a seed: groups of seven digits or more, addresses
without a dot or with a written (at), and colon-separated hexadecimal groups.

Defined results: a null text counts as empty and has no spans; rows that repeat have the same spans each; an empty
table gives no rows; columns other than id and text are not read. Positions are code points, ends exclusive.

The patterns below are the plain ones of the contract with possessive repeats and guards in front; they match the
same and take linear time: a run of the first class is tried at its start only (or where the last match ended).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before a pattern is tried on it.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Candidates by type, and the kinds that a type may turn out to be.
CANDIDATES = {
    "digits": r"(?<![0-9A-Za-z.@_%+-])[(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+(?![0-9A-Za-z@_])",
    "address": rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "groups": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){3,7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
}
_CANDIDATE_HINTS = {"digits": r"[0-9](?:[\x20()./-]{0,2}[0-9]){6}", "address": r"@|[\[(](?:at|AT)[\])]", "groups": r"[0-9A-Fa-f]:[0-9A-Fa-f]++:"}
COMPATIBLE = {"digits": ("card", "phone"), "address": ("email",), "groups": ("ip",)}
#: A pattern needs this confidence and so many different identifiers; an identifier this score.
PATTERN_CONFIDENCE, PATTERN_SUPPORT, IDENTIFIER_SCORE, SMOOTHING = 0.5, 3, 0.6, 2
_SPACE = r"[\x20\x09-\x0D]"
_FOLD = 256  # matches that a fold appends to one array before it begins the next


def _last_word(gap: str) -> str:
    """SQL of the last word of a text. The reversed text is looked at from its start, so the time is linear."""
    return f"reverse({_first_word(f'reverse({gap})')})"


def _first_word(gap: str) -> str:
    return rf"regexp_extract({gap}, '^[\\x20\\x09-\\x0D]*+([^\\x20\\x09-\\x0D]++)', 1)"


def _matches(text: str, pattern: str, hint: str) -> Column:
    """Array of (s, e, m, l, r): bounds, the match, and the words left and right of it, empty at the ends of a text and beside another
    match. One fold over matches and the gaps between them, in arrays of at most _FOLD that are joined at the end."""
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    empty = "cast(array() as array<struct<s:int,e:int,m:string,l:string,r:string>>)"
    begin = "a.p + length(x.g[i - 1])"
    part = f"""
        aggregate(sequence(j * {_FOLD} + 1, least(size(x.m), (j + 1) * {_FOLD})), named_struct('p', b.p, 'o', {empty}),
            (a, i) -> named_struct('p', {begin} + length(x.m[i - 1]), 'o', array_append(a.o, named_struct(
                's', {begin}, 'e', {begin} + length(x.m[i - 1]), 'm', x.m[i - 1], 'l', lower({_last_word("x.g[i - 1]")}), 'r', lower({_first_word("x.g[i]")})))))"""
    fold = f"""
        aggregate(sequence(0, cast((size(x.m) - 1) div {_FOLD} as int)), named_struct('p', 0, 'o', array({empty})),
            (b, j) -> element_at(transform(array({part}), y -> named_struct('p', y.p, 'o', array_append(b.o, y.o))), 1), b -> flatten(b.o))"""
    body = f"element_at(transform(array(named_struct('m', regexp_extract_all({text}, {quoted}, 0), 'g', split({text}, {quoted}, -1))), x -> if(size(x.m) = 0, {empty}, {fold})), 1)"
    return F.when(F.col(text).rlike(hint), F.expr(body)).otherwise(F.expr(empty))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0)


def _passes(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        size = lambda p: F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int")).otherwise(F.lit(256))
        return F.forall(F.split(m, r"\."), lambda p: size(F.regexp_replace(p, "^0+", "")) <= 255)
    if kind == "card":
        return n.between(16, 19) & luhn(_digits(m))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, h, base, candidates): h tells texts of one id apart; base has the passing spans of all kinds in order, candidates those that
    overlap none. No shuffle."""
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = text.select("id", F.xxhash64("t").alias("h"), *(_matches("t", p, _HINTS[k]).alias(k) for k, p in PATTERNS.items()), *(_matches("t", p, _CANDIDATE_HINTS[k]).alias(f"c_{k}") for k, p in CANDIDATES.items()))

    def of(kind: str, name: str, test) -> Column:
        kept = F.filter(F.col(name), lambda x: test(kind, x["m"]))
        return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["l"], x["r"]))

    base = F.concat(*(of(k, k, _passes) for k in KINDS))
    maybe = F.concat(*(of(k, f"c_{k}", lambda *_: F.lit(True)) for k in CANDIDATES))
    out = found.select("id", "h", base.alias("base"), maybe.alias("maybe"))
    free = F.filter("maybe", lambda c: ~F.exists("base", lambda b: (c["s"] < b["e"]) & (b["s"] < c["e"])))
    return out.select("id", "h", "base", free.alias("candidates"))


def _identifier(kind: Column, m: Column) -> Column:
    """Different writings of one identifier are one node."""
    return F.when(kind.isin("card", "phone", "digits"), _digits(m)).otherwise(F.lower(m))


def pattern_graph(found: DataFrame) -> DataFrame:
    """Rows (side, word, identifier, kind, seed, n): edges of the graph with their number of occurrences."""
    one = lambda column, seed: found.select(F.explode(column).alias("x"), F.lit(seed).alias("seed"))
    rows = one("base", True).unionByName(one("candidates", False))
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("x.l").alias("word")), F.struct(F.lit("right").alias("side"), F.col("x.r").alias("word")))).alias("y")
    rows = rows.select(F.col("x.kind").alias("kind"), _identifier(F.col("x.kind"), F.col("x.m")).alias("identifier"), "seed", sides)
    return rows.where("y.word <> ''").groupBy("y.side", "y.word", "identifier", "kind", "seed").agg(F.count("*").alias("n"))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word, occurrences) over the whole corpus, summed before the shuffle."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), _SPACE + "+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("occurrences"))


def discover(edges: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Rows (identifier, type, kind, score) of candidates over the threshold. Rounds over the graph go on until one finds no new identifier;
    what was found stays found, with its best score, so they end."""
    seeds = edges.where("seed").select("identifier", "kind").distinct().withColumn("score", F.lit(1.0))
    words = edges.select("side", "word").distinct().join(occurrences, "word", "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
    known = stored(edges.join(words, ["side", "word"]).select("side", "word", "occurrences", "identifier", F.col("kind").alias("type"), "seed", "n"), "known")
    allowed = F.create_map(*(x for t, kinds in COMPATIBLE.items() for x in (F.lit(t), F.array(*map(F.lit, kinds)))))
    scores, gained, size = seeds, None, -1
    while True:
        of_pattern = known.join(scores, "identifier").groupBy("side", "word", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count("*").alias("support"), F.sum("n").alias("n"), F.max("occurrences").alias("occurrences"))
        confident = of_pattern.withColumn("confidence", F.col("mass") / (F.greatest("occurrences", "n") + SMOOTHING))
        confident = confident.where((F.col("confidence") >= PATTERN_CONFIDENCE) & (F.col("support") >= PATTERN_SUPPORT)).select("side", "word", "kind", "confidence")
        reached = known.where("not seed").join(confident, ["side", "word"]).where(F.array_contains(F.element_at(allowed, F.col("type")), F.col("kind")))
        score = 1 - F.exp(F.sum(F.ln(1 - F.least(F.col("confidence"), F.lit(0.999)))))
        found = reached.select("identifier", "type", "kind", "side", "word", "confidence").distinct().groupBy("identifier", "type", "kind").agg(score.alias("score")).where(F.col("score") >= IDENTIFIER_SCORE)
        if gained is not None:
            found = found.unionByName(gained).groupBy("identifier", "type", "kind").agg(F.max("score").alias("score"))
        gained = stored(found, "identifiers")
        now = gained.count()
        if now == size or not now:
            return gained
        size = now
        scores = seeds.unionByName(gained.groupBy("identifier", "kind").agg(F.max("score").alias("score")))


_SPANS = "array<struct<kind:string,s:int,e:int,m:string>>"


def _row_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, h, base, added) for every row of docs."""
    found = stored(spans(docs, id_col, text_col), "spans")
    edges = stored(pattern_graph(found), "graph")
    words = edges.select("word").distinct()
    # an inner join, as a semi join would be moved below the counting and shuffle every word of the corpus
    occurrences = stored(word_counts(docs, text_col).join(words, "word"), "words")
    best = discover(edges, occurrences).groupBy("identifier", "type").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    hits = found.where(F.size("candidates") > 0).select("id", "h", F.explode("candidates").alias("x"))
    hits = hits.select("id", "h", "x", F.col("x.kind").alias("type"), _identifier(F.col("x.kind"), F.col("x.m")).alias("identifier")).join(best, ["identifier", "type"])
    # of candidates of different types that overlap, the one that starts first (then the longer) stays
    span = F.struct("kind", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.m").alias("m"))
    added = hits.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct(F.col("x.s").alias("s"), (-F.col("x.e")).alias("to"), span.alias("x")))).alias("a"))
    added = added.withColumn("a", F.expr(f"aggregate(a, cast(array() as {_SPANS}), (o, y) -> if(size(o) > 0 and try_element_at(o, -1).e > y.x.s, o, array_append(o, y.x)))"))
    plain = F.transform("f.base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    joined = found.alias("f").join(added.alias("a"), F.col("f.h").eqNullSafe(F.col("a.h")) & F.col("f.id").eqNullSafe(F.col("a.id")), "left")
    return joined.select("f.id", "f.h", plain.alias("base"), F.coalesce("a.a", F.expr(f"cast(array() as {_SPANS})")).alias("added"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, base, added): arrays of (kind, s, e, m), base in the order of KINDS and then of s."""
    return _row_spans(docs, id_col, text_col).select(F.col("id").alias(id_col), "base", "added")


def listed(spans_: Column) -> Column:
    """kind:start:end, by kind as in KINDS, then start, comma-joined."""

    def of(kind: str) -> Column:
        own = F.transform(F.filter(spans_, lambda x: x["kind"] == kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        return F.transform(F.array_sort(own), lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))

    return F.array_join(F.concat(*map(of, KINDS)), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; other columns stay, rows that repeat too."""
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))).alias("spans")
    held = _row_spans(docs, id_col, text_col).where("size(base) + size(added) > 0").select("id", "h", every)
    held = held.groupBy("id", "h").agg(F.first("spans").alias("spans"))  # rows that repeat have equal spans
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("t"))
    joined = rows.alias("d").join(held.alias("f"), F.col("d.h").eqNullSafe(F.col("f.h")) & F.col("d.id").eqNullSafe(F.col("f.id")), "left").select("row", "t", "spans")
    cut = F.expr("""
        if(spans is null, t, aggregate(spans, named_struct('p', 0, 'o', array('')),
            (a, x) -> if(x.e <= a.p, a, named_struct('p', x.e, 'o', if(x.s < a.p, a.o, array_append(a.o, concat(substring(t, a.p + 1, x.s - a.p), '[', upper(x.kind), ']'))))),
            a -> concat(array_join(a.o, ''), substring(t, a.p + 1))))""")
    return joined.select(F.col("row").withField(f"`{text_col}`", cut).alias("row")).select("row.*")
