"""Secret scans: fixed patterns, and a battery of randomness tests for what no pattern names.

Candidates are long runs of characters that encodings use. For each, the smallest encoding that holds all its
characters is inferred and three tests ask whether it may be uniform over that alphabet: chi-squared on symbol
counts, runs above and below the middle symbol, and serial correlation. Candidates that they reject are structured.

What passes may still be an ordinary identifier that is too short to tell. So the claim that a candidate is ordinary
is tested too: its likelihood as uniform symbols over that as an identifier, made of letters as frequent as in
English and of changes between kinds of characters, exceeds 2^c with a probability of at most 2^-c if it is one. These
p-values, which fall with the length, are corrected by Benjamini and Hochberg within each class of encoding and length
over the whole corpus, so that of what is reported at most a stated share is expected to be ordinary. The step-up
rule works on a histogram of p-values, which is bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquiver.llm._store import Store

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The kinds in their order. A run of 16 or more after AKIA, or of 24 or more hex digits, is a whole match of the
#: unbounded pattern that is long enough; for "assign" a short match still uses up its text, so it is filtered after.
KINDS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "random": r"[A-Za-z0-9+/_-]{20,}"}
ASSIGN_LEAST = 6

#: Encodings by size of alphabet: name, pattern of the whole candidate, alphabet. The first that matches holds.
#: Runs of letters alone or digits alone are words and numbers, not encodings.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("none", r"^([A-Za-z]+|[0-9]+|[^A-Za-z]+)$", ""),
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("upper_hex", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("lower36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("upper36", r"^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
#: Expected share of ordinary strings among those reported, and the p-value of the battery below which a candidate is not
#: uniform: random strings are lost as often.
FDR, NOT_UNIFORM = 0.05, 0.001
#: How often letters occur in English text, in per cent, from a to z (fixed values).
LETTERS = (8.17, 1.49, 2.78, 4.25, 12.70, 2.23, 2.02, 6.09, 6.97, 0.15, 0.77, 4.03, 2.41, 6.75, 7.51, 1.93, 0.10, 5.99, 6.33, 9.06, 2.76, 0.98, 2.36, 0.15, 1.97, 0.07)
#: Kinds of characters: lower-case letters, capitals, digits, signs. How often an identifier starts with each, and what
#: follows each of them.
KIND = "ludp"
STARTS = (0.50, 0.30, 0.15, 0.05)
FOLLOWS = ((0.86, 0.05, 0.03, 0.06), (0.45, 0.45, 0.04, 0.06), (0.05, 0.05, 0.75, 0.15), (0.55, 0.20, 0.20, 0.05))
SIGNS = "+/-_"
#: Bins of the p-values' histogram for each factor of ten, and the last bin.
BINS_PER_TEN, LAST_BIN = 50, 1000


def normal_tail(z: Column) -> Column:
    """P(N > z) for z >= 0, by a rational approximation good to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    z = F.least(z, F.lit(30.0))
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def _upper(z: Column) -> Column:
    return F.when(z >= 0, normal_tail(z)).otherwise(1 - normal_tail(-z))


def _total(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x).cast("double"))


def randomness(candidates: DataFrame, column: str) -> DataFrame:
    """Adds encoding (null: none), n and p, the combined p-value under uniform symbols."""
    c = F.col(column)
    encoding = alphabet = F.lit(None).cast("string")
    for name, pattern, symbols in reversed(ENCODINGS):
        encoding = F.when(c.rlike(pattern), F.lit(name) if symbols else F.lit(None)).otherwise(encoding)
        alphabet = F.when(c.rlike(pattern), F.lit(symbols)).otherwise(alphabet)
    df = candidates.withColumn("encoding", encoding).withColumn("alphabet", alphabet).withColumn("n", F.length(c))
    symbols = F.filter(F.split(c, ""), lambda s: s != "")
    place = F.transform(symbols, lambda s: (F.call_function("instr", F.col("alphabet"), s) - 1).cast("double"))
    df = df.withColumn("x", F.when(F.col("encoding").isNotNull(), place))
    k = F.length("alphabet").cast("double")
    n = F.col("n").cast("double")
    squares = _total(F.transform(F.array_distinct("x"), lambda s: F.size(F.filter("x", lambda y: y == s))), lambda m: m * m)
    df = df.withColumn("k", k).withColumn("chi2", k / n * squares - n).withColumn("mean", _total(F.col("x")) / n)
    free = F.col("k") - 1
    z1 = (F.cbrt(F.greatest(F.col("chi2"), F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    high = F.transform("x", lambda s: s >= F.col("k") / 2)
    ones = _total(high, lambda s: s.cast("int"))
    pairs = F.sequence(F.lit(1), F.col("n") - 1)
    changes = F.size(F.filter(pairs, lambda i: F.get(F.col("high"), i) != F.get(F.col("high"), i - 1)))
    df = df.withColumn("high", high).withColumn("ones", ones).withColumn("changes", changes)
    expected = 2 * F.col("ones") * (n - F.col("ones")) / n + 1
    spread = F.sqrt((expected - 1) * (expected - 2) / (n - 1))
    z2 = F.when((F.col("ones") > 0) & (F.col("ones") < n) & (spread > 0), F.abs(F.col("changes") + 1 - expected) / spread).otherwise(30.0)
    product = _total(F.transform(pairs, lambda i: (F.get(F.col("x"), i) - F.col("mean")) * (F.get(F.col("x"), i - 1) - F.col("mean"))))
    variance = _total(F.col("x"), lambda s: (s - F.col("mean")) * (s - F.col("mean")))
    z3 = F.when(variance > 0, F.abs(product / variance + 1 / n) * F.sqrt(n)).otherwise(30.0)
    # Bonferroni over the three tests, of which one is one-sided
    p = F.least(F.lit(1.0), 3 * F.least(_upper(z1), 2 * normal_tail(z2), 2 * normal_tail(z3)))
    return df.withColumn("p", F.when(F.col("encoding").isNotNull(), F.greatest(p, F.lit(1e-20)))).drop(
        "alphabet", "x", "k", "chi2", "mean", "high", "ones", "changes")


def _costs(table: dict[str, float]) -> Column:
    """Bits by string, for probabilities."""
    return F.create_map(*(F.lit(x) for k, p in table.items() for x in (k, -math.log2(p))))


def ordinary(tested: DataFrame, column: str) -> DataFrame:
    """Adds p0: a bound on the probability that an ordinary identifier looks as random as this one."""
    c = F.col(column)
    share = sum(LETTERS)
    symbols = {chr(97 + i): f / share for i, f in enumerate(LETTERS)} | {d: 1 / len(DIGITS) for d in DIGITS} | {x: 1 / len(SIGNS) for x in SIGNS}
    steps = {a + b: FOLLOWS[i][j] for i, a in enumerate(KIND) for j, b in enumerate(KIND)} | dict(zip(KIND, STARTS))
    kinds = F.translate(c, LOWER + UPPER + DIGITS + SIGNS, "".join(k * len(x) for k, x in zip(KIND, (LOWER, UPPER, DIGITS, SIGNS))))
    df = tested.withColumn("kinds", kinds)
    moves = F.concat(F.array(F.substring("kinds", 1, 1)), F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.col("kinds").substr(i, F.lit(2))))
    letters = F.filter(F.split(F.lower(c), ""), lambda x: x != "")
    size = F.element_at(F.create_map(*(F.lit(x) for name, _, symbols_ in ENCODINGS if symbols_ for x in (name, math.log2(len(symbols_))))), F.col("encoding"))
    bits = _total(moves, lambda m: F.element_at(_costs(steps), m)) + _total(letters, lambda x: F.element_at(_costs(symbols), x)) - F.col("n") * size
    return df.withColumn("p0", F.greatest(F.lit(1e-20), F.pow(F.lit(2.0), -F.greatest(bits, F.lit(0.0))))).drop("kinds")


def rejection_levels(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """(encoding, length_class, level): that a candidate is ordinary is rejected if its histogram bin is ``level`` or higher.

    This is the step-up rule with each p-value taken as the largest of its bin; classes where none is rejected have no row."""
    per_class = Window.partitionBy("encoding", "length_class")
    counts = tested.groupBy("encoding", "length_class", "bin").count()
    so_far = F.sum("count").over(per_class.orderBy(F.desc("bin")))
    edge = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_TEN)  # the largest p-value of the bin
    return (counts.withColumn("rejected", so_far).withColumn("all", F.sum("count").over(per_class))
            .filter(edge <= fdr * F.col("rejected") / F.col("all"))
            .groupBy("encoding", "length_class").agg(F.min("bin").alias("level")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, spans array<struct<start, kind_order, kind, end>>) by start, then kind.

    Spans count code points of the whole text, ends exclusive. ``assign``, ``access`` and ``hex`` are all matches
    of the fixed patterns; ``random`` are candidates that may be uniform and are not ordinary, unless a fixed pattern's
    span overlaps them. Letters alone, digits alone, strings without letters and strings with signs of both base64 alphabets
    are not candidates. A very long text is scanned whole. A null or empty text has no spans. Repeated rows and null ids are rows like others. An empty table gives
    an empty result. Other columns are not read.
    """
    store = Store(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    all_ = rows.select("id", "row", "text", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in KINDS.items()))
    # The text between matches gives their places: what split returns has one part more than there are matches.
    all_ = all_.select("id", "row", *(
        F.when(F.size(f"m_{k}") > 0, F.arrays_zip(
            f"m_{k}", F.slice(F.transform(F.split("text", p, -1), F.length), F.lit(1), F.size(f"m_{k}"))).cast("array<struct<m:string,gap:int>>")).alias(k)
        for k, p in KINDS.items()))
    found = store.put(all_)
    parts = [found.filter(F.col(k).isNotNull()).select("row", F.lit(i).alias("kind_order"), F.lit(k).alias("kind"), F.posexplode(k).alias("at", "s"))
             for i, k in enumerate(KINDS)]
    matches = parts[0]
    for p in parts[1:]:
        matches = matches.unionByName(p)
    before = Window.partitionBy("row", "kind").orderBy("at")
    matches = matches.select("row", "kind_order", "kind", "at", "s.m", "s.gap")
    size = F.length("m")
    spans = matches.withColumn("end", F.sum(F.col("gap") + size).over(before)).withColumn("start", F.col("end") - size)
    fixed = (F.col("kind") != "random") & ((F.col("kind") != "assign") | (F.length(F.regexp_extract("m", ASSIGN, 2)) >= ASSIGN_LEAST))
    spans = store.put(spans.select("row", "start", "kind_order", "kind", "end", "m").filter(fixed | (F.col("kind") == "random")))
    base = spans.filter(F.col("kind") != "random")
    # Each table is written before it is filtered: a filter pushed below would compute its column again and again.
    battery = store.put(randomness(spans.filter(F.col("kind") == "random"), "m"))
    bounded = store.put(ordinary(battery.filter(F.col("p") >= NOT_UNIFORM), "m"))
    tested = store.put(bounded.withColumn("length_class", F.floor(2 * F.log2("n")).cast("int"))
                       .withColumn("bin", F.least(F.lit(LAST_BIN), F.floor(-F.log10("p0") * BINS_PER_TEN)).cast("int")))
    levels = F.broadcast(rejection_levels(tested))  # a row per encoding and length class at most
    random = tested.join(levels, ["encoding", "length_class"]).filter(F.col("bin") >= F.col("level"))
    clash = base.select(F.col("row").alias("b_row"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    random = random.join(clash, (F.col("row") == F.col("b_row")) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")), "left_anti")
    keep = ["row", "start", "kind_order", "kind", "end"]
    per_row = base.select(keep).unionByName(random.select(keep)).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind_order", "kind", "end"))).alias("spans"))
    return found.select("id", "row").join(per_row, "row", "left").select(
        F.col("id").alias(id_col), F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind_order:int,kind:string,end:bigint>>")).alias("spans"))
