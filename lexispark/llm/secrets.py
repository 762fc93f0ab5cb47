"""Secret scan with a randomness test battery (DataFrame operations only).

Base spans are three fixed patterns. The method adds spans of kind ``random``:
runs of 20 or more token characters that overlap no base span, whose encoding
is inferred (hexadecimal, base32, base36, base62, base64; ``=`` ends a run as
its padding and is a separator elsewhere), and that pass

* chi-squared uniformity over the encoding's alphabet,
* a runs test on changes of character class,
* a test of the lag-1 serial correlation of the alphabet's indices,

none of which may reject randomness at REJECT standard deviations. A token is a
discovery if all three together reject ordinary text as well. Its null
hypothesis has three parts: symbols coincide as often as letters of English do,
the class of neighbours changes at most as often as in identifiers, and
neighbours correlate by SERIAL at least. Each statistic's normal score under
its part is taken as independent of the others' and grows with the length; the
joined p-value is that of their sum over the root of three (Stouffer), from a
continued fraction, so tails have full relative precision. P-values, weighted
by length, are cut by the Benjamini-Hochberg rule over all tokens of the
corpus: they are counted in bins of their logarithm, so the cut needs no sort of
the tokens, and one number goes back into the scan.

A run that mixes + or / with - or _ has no encoding. Its pieces between + and /
and its pieces between - and _ are looked at instead; of a found piece in
another the longer is dropped if the shorter is three quarters of it at least,
otherwise the shorter.

A text is read once. What matches is one row a match; places are sums over a
text's matches before it, and overlaps are told by the greatest end before and
the least start after a token, so work grows with matches and not with their
square, and a text with very many is sorted on disk like any window.

Defined results: a null text is empty and has no spans; rows are independent
but for the corpus cut, so repeated rows get equal results; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The base patterns and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the battery looks at.
_PAD = r"(?:=++(?![A-Za-z0-9+/_-]))?+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+" + _PAD
#: Pieces of tokens without an encoding.
SLASHED = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+" + _PAD
DASHED = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}+" + _PAD
#: What is matched, by kind: the three base patterns, tokens, and the two sorts of pieces.
PATTERNS = (ASSIGN, "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}+", TOKEN, SLASHED, DASHED)
_TOKEN, _PIECES = 3, (4, 5)
#: Rate of false discoveries among added spans.
FALSE_RATE = 0.01
#: Standard deviations at which a test rejects randomness.
REJECT = 3.3
#: Ordinary text: chance that two letters of English are equal, that the class of neighbours changes, least correlation.
TEXT_COINCIDENCE, TEXT_CHANGE, SERIAL = 0.066, 0.25, 0.5
#: Levels of the continued fraction of the normal tail; bins of the p-values.
LEVELS, _BINS = 24, 4_000

#: Encodings in the order in which they are tried: pattern, alphabet.
ENCODINGS = (
    (r"^[0-9]+$", ""),
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    (r"^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)

_FOUND = "array<struct<i:int,gap:int,found:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern in order, each with the length of what lies between it and the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("found")))  # a gap more than matches
    placed = F.transform(F.filter(pairs, lambda x: x["found"].isNotNull()), lambda x, i: F.struct(i.alias("i"), x["gap"].alias("gap"), x["found"].alias("found")))
    return F.when(F.rlike(text, F.lit(pattern)), placed).cast(_FOUND)


def normal_below(z: Column) -> Column:
    """The normal distribution function; below -2 by the continued fraction of its tail, so small values are exact too."""
    x = F.abs(z)
    tail = x
    for i in range(LEVELS, 0, -1):
        tail = x + F.lit(float(i)) / tail
    density = F.exp(-z * z / 2) / 2.5066282746310002
    # Between -2 and 2: a rational approximation whose error is below 7.5e-8.
    t = 1 / (1 + 0.2316419 * x)
    near = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.when(x > 2, density / tail).otherwise(near)
    return F.when(z > 0, 1 - upper).otherwise(upper)


def with_tests(tokens: DataFrame, token: str = "found") -> DataFrame:
    """Adds passes, whether no test rejects randomness, and p, the weighted p-value against ordinary text (null without an encoding)."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    df = tokens.withColumn("__body", F.regexp_replace(token, "=+$", ""))
    df = df.withColumn("__alphabet", F.coalesce(*[F.when(F.col("__body").rlike(p), F.lit(a)) for p, a in ENCODINGS], F.lit("")))
    body, alphabet = F.col("__body"), F.col("__alphabet")
    n, k = F.length(body).cast("double"), F.length(alphabet).cast("double")
    usable = (k > 0) & (n >= 20)
    # Symbols of the alphabet only: their counts, and the places of the token's own in it.
    counts = F.transform(F.split(alphabet, ""), lambda c: F.when(c == "", 0.0).otherwise((F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double")))
    places = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.call_function("instr", alphabet, c).cast("double") - (k + 1) / 2)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[^A-Za-z]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    share = lambda p: F.regexp_count(alphabet, F.lit(p)) / k
    same = share("[a-z]") * share("[a-z]") + share("[A-Z]") * share("[A-Z]") + share("[^A-Za-z]") * share("[^A-Za-z]")
    df = df.withColumns(
        {
            "__squares": F.when(usable, total(F.transform(counts, lambda c: c * c))),
            "__changes": sum((F.regexp_count(classes, F.lit(p)) for p in ("aA", "Aa", "a0", "0a", "A0", "0A")), F.lit(0)).cast("double"),
            "__change": F.when(usable, 1 - same),
            "__places": F.when(usable, places),
        }
    )
    p = F.col("__places")
    products = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: a * b)
    df = df.withColumn("__r", F.when(usable, total(products) / ((k * k - 1) / 12) / (n - 1)))
    chi = F.col("__squares") * k / n - n
    z_uniform = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    change = F.col("__change")
    z_runs = F.when(change > 0, (F.col("__changes") - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))).otherwise(0.0)
    z_serial = F.col("__r") * F.sqrt(n - 1)
    shift = F.greatest((n - 1) * (k * F.greatest(F.lit(TEXT_COINCIDENCE), 2 / k) - 1), F.lit(0.0))
    against = (
        ((chi - (k - 1) - shift) / F.sqrt(2 * (k - 1) + 4 * shift))
        - (F.col("__changes") - (n - 1) * TEXT_CHANGE) / F.sqrt((n - 1) * TEXT_CHANGE * (1 - TEXT_CHANGE))
        + (F.abs(F.col("__r")) - SERIAL) * F.sqrt(n - 1)
    ) / F.sqrt(F.lit(3.0))
    passes = usable & (z_uniform <= REJECT) & (F.abs(z_runs) <= REJECT) & (F.abs(z_serial) <= REJECT)
    df = df.withColumn("passes", F.coalesce(passes, F.lit(False))).withColumn("__z", F.when(usable, against))
    return df.withColumn("p", F.when(F.col("__z").isNotNull(), normal_below(F.col("__z")) / weight(n))).drop("__body", "__alphabet", "__squares", "__changes", "__change", "__places", "__r", "__z")


def weight(n: Column) -> Column:
    """Weight of a token in the false-discovery cut: long tokens, whose tests have power, get more."""
    return F.least(F.greatest(n / 32, F.lit(0.5)), F.lit(2.0))


def scanned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row) of every row, and (row, kind, start, end, found) of everything that matches in its text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    found = docs.select(docs["doc_id"], F.monotonically_increasing_id().alias("row"), *[_matches(text, p).alias(f"m{k}") for k, p in enumerate(PATTERNS)])
    whole = written(found, "secret-matches")
    kinds = [f"m{k}" for k in range(len(PATTERNS))]
    some = whole.where(" OR ".join(f"{m} IS NOT NULL" for m in kinds)).select("row", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(m).alias("ms")) for k, m in enumerate(kinds)])).alias("x"))
    long = some.where("x.ms IS NOT NULL").select("row", "x.kind", F.explode("x.ms").alias("m")).select("row", "kind", "m.i", "m.gap", "m.found")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("found")
    placed = long.withColumn("end", F.sum((F.col("gap") + size).cast("long")).over(before)).select("row", "kind", (F.col("end") - size).alias("start"), "end", "found")
    group = F.length(F.regexp_extract("found", ASSIGN, 2))
    fits = F.when(F.col("kind") == 0, group >= LEAST["assign"]).when(F.col("kind") == 1, size >= LEAST["access"]).when(F.col("kind") == 2, size >= LEAST["hex"]).otherwise(True)
    return whole.select("doc_id", "row"), written(placed.where(fits), "secret-places")


def tested(places: DataFrame) -> DataFrame:
    """(row, start, end, piece, passes, p) of the tokens that overlap no base span; mixed tokens by their pieces."""
    mixed = (F.col("kind") == _TOKEN) & F.rlike("found", F.lit("[+/]")) & F.rlike("found", F.lit("[_-]"))
    marked = places.where(F.col("kind").isin(0, 1, 2, _TOKEN, *_PIECES)).withColumn("mixed", mixed).withColumn("base", F.col("kind") < _TOKEN)
    # By start, what reaches over others first: the farthest ends so far, and the next base span's start.
    order = Window.partitionBy("row").orderBy("start", F.desc("base"), F.desc("mixed"), F.desc("end"), "kind")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    seen = marked.withColumns(
        {
            "base_end": F.max(F.when(F.col("base"), F.col("end"))).over(upto),
            "next_base": F.expr("lead(if(base, start, null), 1) IGNORE NULLS OVER (PARTITION BY row ORDER BY start, base DESC, mixed DESC, end DESC, kind)"),
            "mixed_end": F.max(F.when(F.col("mixed"), F.col("end"))).over(upto),
        }
    )
    piece = F.col("kind").isin(*_PIECES)
    free = (F.coalesce("base_end", F.lit(0)) <= F.col("start")) & (F.coalesce("next_base", F.col("end")) >= F.col("end"))
    wanted = F.when(F.col("kind") == _TOKEN, ~F.col("mixed")).when(piece, F.coalesce(F.col("end") <= F.col("mixed_end"), F.lit(False))).otherwise(False)
    tokens = seen.where(free & wanted).select("row", "start", "end", piece.alias("piece"), "found").distinct()
    return written(with_tests(tokens).drop("found"), "secret-tests")


def _bin(p: Column) -> Column:
    """Bin of a p-value: hundredths of its decimal exponent, larger for smaller values."""
    return F.least(F.lit(_BINS), F.greatest(F.lit(0), F.floor(-F.log10(F.greatest(p, F.lit(1e-40))) * 100))).cast("int")


def discovery_bin(tests: DataFrame, rate: float = FALSE_RATE) -> int:
    """The Benjamini-Hochberg cut over all tokens of the corpus, as a bin; past the last bin if nothing is found."""
    rows = tests.where("p IS NOT NULL").groupBy(_bin(F.col("p")).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # 4,001 rows at most
    counts = {r["bin"]: r["n"] for r in rows}
    total, upto, cut = sum(counts.values()), 0, _BINS + 1
    for b in sorted(counts, reverse=True):
        upto += counts[b]
        if 10 ** (-b / 100) <= rate * upto / total:
            cut = b
    return cut


def discovered(tests: DataFrame, cut: int) -> DataFrame:
    """(row, start, end) of the tokens found; of pieces in one another the better ones.

    Pieces between + and / and pieces between - and _ of one token are runs of
    two kinds, each without overlaps, so a piece lies in one other at most or
    holds others that follow each other.
    """
    found = tests.where(F.col("passes") & (_bin(F.col("p")) >= cut))
    order = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.struct("end", "start")).over(order)
    pieces = found.where("piece").withColumn("outer", before)
    size, outer = F.col("end") - F.col("start"), F.col("outer.end") - F.col("outer.start")
    inside = F.coalesce((F.col("outer.end") >= F.col("end")) & (outer > size), F.lit(False))
    pieces = pieces.withColumn("inside", inside).withColumn("large", inside & (4 * size >= 3 * outer))
    worse = pieces.where("large").select("row", F.col("outer.start").alias("start"), F.col("outer.end").alias("end")).distinct()
    kept = pieces.where("NOT inside OR large").select("row", "start", "end").join(worse, ["row", "start", "end"], "left_anti")
    return found.where("NOT piece").select("row", "start", "end").unionByName(kept)


def scan(docs: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    rows, places = scanned(docs)
    tests = tested(places)
    added = discovered(tests, discovery_bin(tests, rate)).select("row", F.lit(_TOKEN).alias("kind"), "start", "end")
    spans = places.where(F.col("kind") < _TOKEN).select("row", "kind", "start", "end").unionByName(added)
    names = F.array(*map(F.lit, KINDS))
    line = F.concat_ws(":", F.element_at(names, F.col("kind") + 1), F.col("start").cast("string"), F.col("end").cast("string"))
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n{kind}")
    own = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", line.alias("line")))).alias("s"), count(0), count(1), count(2))
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["line"]), ",")
    told = own.select("row", "n0", "n1", "n2", joined(F.filter("s", lambda x: x["kind"] < _TOKEN)).alias("base"), joined(F.col("s")).alias("spans"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.join(told, "row", "left").select(
        "doc_id", number("n0").alias("n_assign"), number("n1").alias("n_access"), number("n2").alias("n_hex"),
        F.sha2(F.encode(F.coalesce("base", F.lit("")), "utf-8"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
