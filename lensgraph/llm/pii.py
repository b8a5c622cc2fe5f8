"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the matches of four fixed patterns (e-mail addresses, IP addresses, card numbers that pass Luhn's test, phone
numbers) and, as a fifth kind, the value beside a word such as "token" or "password" and a sign of equality. What looks
like an identifier but is no seed is a candidate: an at sign or a spelt-out one, a chain of digits that may be masked or
spaced, a long run of letters and digits. Every occurrence of a seed or candidate has contexts: one, two or three words
before it, one or two after it, and the words on both sides, with digits as 0. A context with a kind is a lexical
pattern. Over the graph of patterns and instances (distinct strings) confidence goes back and forth:

    confidence(pattern, kind)  = c / (c + other + misfits + UNSEEN * unseen + 1)
    confidence(instance, kind) = 1 - product over its distinct occurrences of (1 - its best trusted pattern's confidence)

c sums the confidence of the pattern's instances in that kind, other that in other kinds; misfits counts candidates
whose form fits no kind, unseen those that fit one and are not sure. A seed has confidence 1. A pattern is trusted from
TRUSTED on with SUPPORT sure instances. A candidate whose form fits the kind becomes sure from SURE on and then supports
further patterns, until a round finds no more. Sure candidates are found spans wherever they stand.

Positions are code points, ends exclusive. The base patterns use possessive quantifiers and look-behind, so that they
find what the plain patterns find, in linear time; sums over the matches of a text go in blocks of STEP.

Edge cases: null and empty texts have no spans; repeated rows are found one by one; a table without candidates keeps
just the seeds; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensgraph.shared import Rounds, written

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Per kind: when to look, and the pattern. The first four find what their plain forms find, leftmost and greedy.
PATTERNS = {
    "email": ("contains(_t, '@')", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("_digits", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("_digits", r"[0-9](?:[ -]?+[0-9])++"),
    "phone": ("contains(_t, '+')", r"\+[0-9][ ().0-9-]+[0-9]"),
    "secret": ("_named", r"""(?<![A-Za-z0-9+/_-])(?<=(?i:token|secret|passwd|password|key)["']?\s{0,3}[=:]\s{0,3}["']?)[A-Za-z0-9+/_-]{16,}+"""),
}
_GROUP = r"(?:[0-9]{1,7}+|[Xx*]{2,7}+)(?![0-9Xx*])"
#: When to look, and the pattern: at signs in a word and spelt out, letters with digits, digits and masks in groups,
#: digits in one run. Where they overlap, the leftmost counts, then the first listed.
CANDIDATES = (
    ("contains(_t, '@')", r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D]++"),
    ("contains(_t, ' dot ') OR contains(_t, 'dot ]') OR contains(_t, 'dot]') OR contains(_t, 'dot)') OR contains(_t, 'at]') OR contains(_t, 'at)')", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: at | ?[\[({<] ?at ?[\])}>] ?)[A-Za-z0-9-]++(?:(?: dot | ?[\[({<] ?dot ?[\])}>] ?|\.)[A-Za-z0-9-]++)++"),
    ("_digits", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+"),
    ("_digits", rf"(?<![0-9A-Za-z*])[(]?+{_GROUP}(?:[)]?+[ .-]{{1,2}}+[(]?+{_GROUP})++"),
    ("_digits", r"(?<![0-9A-Za-z*])[0-9]{7,}+(?![A-Za-z])"),
)
#: Code points beside a match in which its contexts are sought.
REACH = 60
TRUSTED, SUPPORT, SURE, UNSEEN = 0.5, 5, 0.8, 0.25
#: Matches in one block of a running sum.
STEP = 128
SPAN = "struct<kind:string,start:long,end:long,text:string,before:string,after:string>"


def _luhn(digits: str) -> str:
    d = f"int(substr({digits}, length({digits}) - i, 1))"
    doubled = f"(2 * {d}) div 10 + (2 * {d}) % 10"
    return f"aggregate(sequence(0, length({digits}) - 1), 0L, (s, i) -> s + CASE WHEN i % 2 = 1 THEN {doubled} ELSE {d} END) % 10 = 0"


def _valid(kind: str, text: str) -> str:
    digits = f"regexp_replace({text}, '[^0-9]', '')"
    if kind == "ip":
        return f"{text} rlike '^(0*(25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[0-9]{{1,2}})([.]|$)){{4}}$'"
    if kind == "card":
        return f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {_luhn(digits)} ELSE false END"
    if kind == "secret":
        return f"{text} rlike '[0-9]' AND {text} rlike '[A-Za-z]'"
    if kind == "":  # digits, or a mask in their place
        return f"{text} rlike '[@A-WYZa-wyz]' OR ({text} rlike '[0-9]' AND length(regexp_replace({text}, '[^0-9Xx*]', '')) >= 7)"
    return f"length({digits}) BETWEEN 8 AND 15" if kind == "phone" else "true"


def let(name: str, value: str, body: str) -> str:
    """SQL of `body` in which `name` stands for `value`, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(values: str, op: str, zero: str = "0L") -> str:
    """SQL of op (sum as '+', or a function of two numbers) over all earlier elements of an array of bigint, per element.

    Blocks of STEP are folded, then their totals: no array grows by one element at a time beyond a block.
    """
    both = lambda x, y: f"{x} + {y}" if op == "+" else f"{op}({x}, {y})"
    fold = lambda over, of: f"aggregate({over}, named_struct('at', {zero}, 'out', cast(array() AS array<bigint>)), (s, x) -> named_struct('at', {both('s.at', of)}, 'out', concat(s.out, array(s.at))))"
    blocks = f"transform(sequence(0, (size(v) - 1) div {STEP}), b -> {fold(f'slice(v, b * {STEP} + 1, {STEP})', 'x')})"
    spread = f"flatten(transform(k, (z, i) -> transform(z.out, o -> {both('o', 'element_at(c, i + 1)')})))"
    whole = let("k", blocks, let("c", f"({fold('k', 'x.at')}).out", spread))
    return let("v", values, f"CASE WHEN size(v) = 0 THEN cast(array() AS array<bigint>) ELSE {whole} END")


def spans_of(kind: str, guard: str, pattern: str) -> str:
    """SQL of the valid matches of a pattern in column _t, as an array of SPAN."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    before, after = f"right(element_at(z.c, i + 1), {REACH})", f"left(element_at(z.c, i + 2), {REACH})"
    one = f"named_struct('kind', '{kind}', 'start', f + length(element_at(z.c, i + 1)), 'end', f + length(element_at(z.c, i + 1)) + length(m), 'text', m, 'before', {before}, 'after', {after})"
    made = f"transform(arrays_zip(z.m, {running('transform(z.m, (m, i) -> cast(length(element_at(z.c, i + 1)) + length(m) AS bigint))', '+')}), (y, i) -> {let('m', 'y.m', let('f', 'y.`1`', one))})"
    parts = f"named_struct('c', split(_t, '{p}', -1), 'm', regexp_extract_all(_t, '{p}', 0))"
    return f"CASE WHEN {guard} THEN filter(flatten(transform(filter(array({parts}), z -> size(z.m) > 0), z -> {made})), x -> {_valid(kind, 'x.text')}) ELSE cast(array() AS array<{SPAN}>) END"


def clear_of(spans: str, seeds: str) -> str:
    """SQL of those elements of the arrays in `spans` (one for each of CANDIDATES) that touch none of `seeds` and none before them."""
    entry = lambda rank: f"x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'span', x)"
    ordered = f"array_sort(concat(transform({seeds}, {entry('0L')}), flatten(transform({spans}, (c, i) -> transform(c, {entry('cast(i + 1 AS bigint)')})))))"
    upto = running("transform(q, x -> x.end)", "greatest")
    after = f"reverse({running('reverse(transform(q, x -> CASE WHEN x.rank = 0 THEN x.start ELSE 9223372036854775807L END))', 'least', '9223372036854775807L')})"
    kept = f"filter(transform(arrays_zip(q, {upto}, {after}), y -> named_struct('x', y.q, 'upto', y.`1`, 'next', y.`2`)), y -> y.x.rank > 0 AND y.upto <= y.x.start AND y.next >= y.x.end)"
    return let("q", ordered, f"transform({kept}, y -> y.x.span)")


def seeds(docs: DataFrame, keep: list[str]) -> DataFrame:
    """_keep (a struct of `keep`), then _seed (the seeds' spans, by kind and start) and _other (candidates that touch none of them)."""
    text = F.coalesce("text", F.lit("")).alias("_t")
    named = F.expr(r"""contains(_t, '=') OR contains(_t, ':')""") & F.col("_t").rlike(r"""(?i)(?:token|secret|passwd|password|key)["']?\s{0,3}[=:]""")
    rows = docs.select(F.struct(*keep).alias("_keep"), text).withColumn("_digits", F.col("_t").rlike("[0-9]")).withColumn("_named", F.col("_digits") & named)
    sure = f"concat({', '.join(spans_of(k, guard, p) for k, (guard, p) in PATTERNS.items())})"
    others = f"array({', '.join(spans_of('', guard, p) for guard, p in CANDIDATES)})"
    clear = let("o", others, f"CASE WHEN aggregate(o, 0, (n, c) -> n + size(c)) = 0 THEN element_at(o, 1) ELSE {clear_of('o', 's')} END")
    # a generator of one row: what follows, filters too, then reads its columns and does not compute them again
    return rows.select("_keep", F.expr(f"inline(array({let('s', sure, f'named_struct({chr(39)}_seed{chr(39)}, s, {chr(39)}_other{chr(39)}, {clear})')}))"))


def fitting(text: Column) -> Column:
    """The kinds whose form a string has."""
    spelt = text.rlike(r"(?i) at |[\[({<] ?at ?[\])}>]")
    digits = F.length(F.regexp_replace(text, "[^0-9Xx*]", ""))
    letters = text.rlike("[A-WYZa-wyz]")
    dotted = text.rlike("^[0-9]+([.][0-9]+){3,}$")
    one = lambda kind, when: F.when(when, F.array(F.lit(kind))).otherwise(F.array().cast("array<string>"))
    email = F.contains(text, F.lit("@")) | spelt
    plain = ~email & ~letters & ~dotted
    return F.concat(one("email", email), one("ip", dotted), one("card", plain & digits.between(12, 19)), one("phone", plain & digits.between(7, 15)), one("secret", ~email & letters & (F.length(text) >= 16) & ~F.contains(text, F.lit(" "))))


def contexts() -> Column:
    """The contexts of a row with before and after, as strings that name their side."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[0-9]", "0"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    b, a = words(F.col("before")), words(F.col("after"))
    last = lambda n: F.when(F.size(b) >= n, F.concat(F.lit(f"before{n} "), F.array_join(F.slice(b, -n, n), " ")))
    first = lambda n: F.when(F.size(a) >= n, F.concat(F.lit(f"after{n} "), F.array_join(F.slice(a, 1, n), " ")))
    both = F.when((F.size(b) > 0) & (F.size(a) > 0), F.concat(F.lit("both "), F.element_at(b, -1), F.lit(" | "), F.element_at(a, 1)))
    return F.array_compact(F.array(last(1), last(2), last(3), first(1), first(2), both))


def bootstrap(hits: DataFrame) -> DataFrame:
    """(text, kind, confidence) of the sure candidates. hits: kind ('' for candidates), text, before, after."""
    seen = hits.select("kind", "text", contexts().alias("ps")).withColumn("place", F.xxhash64("ps")).distinct()
    edges = written(seen.select("kind", "text", "place", F.explode("ps").alias("p")).withColumn("fits", F.when(F.col("kind") == "", fitting(F.col("text")))), "edges")
    known = edges.filter("kind <> ''").select("text", "kind").distinct()
    # strings that are a seed somewhere are no candidates
    open_ = written(edges.filter("kind = ''").join(known.select("text").distinct(), "text", "left_anti").select("text", "place", "p", "fits"), "open")
    graph = written(edges.select("p", "text").distinct(), "graph")
    sizes = graph.groupBy("p").agg(F.count("*").alias("n"))
    misfits = open_.filter("size(fits) = 0").select("p", "text").distinct().groupBy("p").agg(F.count("*").alias("misfits"))
    sizes = written(sizes.join(misfits, "p", "left").select("p", "n", F.coalesce("misfits", F.lit(0)).alias("misfits")), "sizes")
    seeds_, rounds = written(known.withColumn("confidence", F.lit(1.0)), "seeds"), Rounds(hits.sparkSession, "sure")
    sure = rounds.written(seeds_.limit(0))
    while True:
        held = graph.join(seeds_.unionByName(sure), "text")
        support = held.groupBy("p", "kind").agg(F.sum("confidence").alias("c"), F.count(F.when(F.col("confidence") >= SURE, 1)).alias("k"))
        total = held.groupBy("p").agg(F.sum("confidence").alias("all"), F.count_distinct("text").alias("known"))
        rated = support.filter(F.col("k") >= SUPPORT).join(total, "p").join(sizes, "p")
        unseen = F.col("n") - F.col("misfits") - F.col("known")
        trust = F.col("c") / (F.col("all") + F.col("misfits") + UNSEEN * unseen + 1)
        trusted = rated.select("p", "kind", F.least(trust, F.lit(0.999)).alias("trust")).filter(F.col("trust") >= TRUSTED)
        near = open_.join(trusted, "p").filter(F.expr("array_contains(fits, kind)")).groupBy("text", "kind", "place").agg(F.max("trust").alias("trust"))
        rated = near.groupBy("text", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("confidence")).filter(F.col("confidence") >= SURE)
        best = rated.groupBy("text").agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", "kind")).alias("b")).select("text", "b.kind", "b.confidence")
        new = written(best.join(sure.select("text"), "text", "left_anti"), "new")
        if not new.limit(1).count():
            return sure
        sure = rounds.written(sure.unionByName(new))


def hits_of(found: DataFrame) -> DataFrame:
    """kind, text, before, after of all seeds and candidates."""
    return found.select(F.explode(F.concat("_seed", "_other")).alias("s")).select("s.kind", "s.text", "s.before", "s.after")


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """_keep (a struct of `keep`), then base and spans: arrays of SPAN by kind as listed and start; base has the matches of
    the four fixed patterns, spans all."""
    rows = seeds(docs, keep)
    held = F.size("_seed") + F.size("_other")
    wide = "text" in keep
    found = written((rows.filter(held > 0) if wide else rows).withColumn("_row", F.monotonically_increasing_id()), "found")
    sure = bootstrap(hits_of(found)).select("text", F.col("kind").alias("k"))
    hits = found.filter("size(_other) > 0").select("_row", F.explode("_other").alias("s")).withColumn("text", F.col("s.text"))
    more = hits.join(sure, "text").select("_row", F.expr(f"cast(named_struct('kind', k, 'start', s.start, 'end', s.end, 'text', s.text, 'before', s.before, 'after', s.after) AS {SPAN})").alias("s"))
    more = more.groupBy("_row").agg(F.collect_list("s").alias("_more"))  # the spans of one text
    out = found.filter("size(_other) > 0").join(more, "_row", "left").unionByName(found.filter("size(_other) = 0").withColumn("_more", F.lit(None).cast(f"array<{SPAN}>")))
    ranked = "flatten(array(" + ", ".join(f"filter(x.all, y -> y.kind = '{k}')" for k in ALL_KINDS) + "))"
    by_start = "array_sort(transform(concat(_seed, _more), y -> named_struct('start', y.start, 'y', y)))"
    spans = f"CASE WHEN _more IS NULL THEN _seed ELSE {let('x', f'named_struct({chr(39)}all{chr(39)}, transform({by_start}, y -> y.y))', ranked)} END"
    base = "filter(_seed, x -> x.kind <> 'secret')"
    out = out.select("_keep", F.expr(base).alias("base"), F.expr(spans).alias("spans"))
    if not wide:
        return out
    # most rows have neither seeds nor candidates; their texts are read again rather than written
    return out.unionByName(rows.filter(held == 0).select("_keep", F.col("_seed").alias("base"), F.col("_seed").alias("spans")))


def held_back(docs: DataFrame, share: float) -> DataFrame:
    """How well patterns find seeds that they are not shown: per kind, hidden strings, found ones, and those given another kind."""
    found = written(seeds(docs, []).select("_seed", "_other"), "found")
    hidden = (F.col("kind") != "") & (F.pmod(F.xxhash64("text"), F.lit(10_000)) < int(share * 10_000))
    hits = hits_of(found).withColumn("true", F.col("kind"))
    sure = bootstrap(hits.withColumn("kind", F.when(hidden, "").otherwise(F.col("kind"))).select("kind", "text", "before", "after"))
    strings = hits.filter(hidden).select("true", "text").distinct()
    got = strings.join(sure.select("text", F.col("kind").alias("got")), "text", "left")
    return got.groupBy(F.col("true").alias("kind")).agg(F.count("*").alias("hidden"), F.count(F.when(F.col("got") == F.col("true"), 1)).alias("found"), F.count(F.when(F.col("got") != F.col("true"), 1)).alias("mistaken"))


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def redact(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with each span of the text replaced by its kind in capitals and square brackets.

    Spans that touch are one, with the kind of the first. A text is taken in pieces of 1024 code points, so that cutting
    it is linear in its length and its spans.
    """
    found = find(docs, docs.columns)
    ordered = "array_sort(transform(spans, x -> named_struct('start', x.start, 'back', -x.end, 'end', x.end, 'kind', x.kind)))"
    part = lambda a, b: f"CASE WHEN {b} <= {a} THEN '' ELSE array_join(transform(sequence({a} div 1024, ({b} - 1) div 1024), j -> substring(element_at(t, cast(j + 1 AS int)), cast(greatest({a} - j * 1024, 0L) + 1 AS int), cast(least({b} - j * 1024, 1024L) - greatest({a} - j * 1024, 0L) AS int))), '') END"
    pieces = f"transform(arrays_zip(q, {running('transform(q, x -> x.end)', 'greatest')}), y -> {let('u', 'y.`1`', f'CASE WHEN y.q.start < u THEN {chr(39)}{chr(39)} ELSE concat({part("u", "y.q.start")}, {chr(39)}[{chr(39)}, upper(y.q.kind), {chr(39)}]{chr(39)}) END')})"
    tail = let("u", "array_max(transform(q, x -> x.end))", part("u", "cast(length(_keep.text) AS bigint)"))
    fold = let("q", ordered, let("t", "regexp_extract_all(_keep.text, '(?s).{1,1024}', 0)", f"concat(array_join({pieces}, ''), {tail})"))
    text = F.expr(f"CASE WHEN _keep.text IS NULL OR size(spans) = 0 THEN _keep.text ELSE {fold} END")
    return found.select(*[(text if c == "text" else F.col("_keep").getField(c)).alias(c) for c in docs.columns])


def op5(docs: DataFrame) -> DataFrame:
    """Spans of all documents; n_secret and n_spans count those of all kinds together with the found ones."""
    found = find(docs, ["doc_id"])
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    more = [F.expr("cast(size(filter(spans, x -> x.kind = 'secret')) AS long)").alias("n_secret"), F.expr("cast(size(spans) AS long)").alias("n_spans")]
    return found.select("_keep.doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), *more)
