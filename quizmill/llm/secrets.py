"""Secret scans in SQL functions alone: fixed patterns, and a battery of randomness tests under false-discovery control."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm.common import body, staged

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Fewest characters of an assigned value, an access key and a hexadecimal run.
VALUE, KEY, DIGITS = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

#: Tokens that the battery looks at.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"
#: Encodings in the order in which they are tried: name, pattern, letters of the alphabet, and its upper half.
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 16, "89abcdefABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", 32, "QRSTUVWXYZ234567"),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", 36, "ijklmnopqrstuvwxyzIJKLMNOPQRSTUVWXYZ"),
    ("base62", r"^[0-9A-Za-z]+$", 62, "VWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[0-9A-Za-z+/_-]+=*$", 64, "ghijklmnopqrstuvwxyz0123456789+/_-"),
)
#: Shares of natural tokens that are capitals, digits and signs; lower bounds of the length classes; the false-discovery
#: rate; the 0.999 quantile of the chi-square law with 3 degrees, beyond which a token is not random.
CAPITAL, DIGIT, SIGN = 0.15, 0.05, 0.05
LENGTHS, RATE, NOT_RANDOM = (20, 24, 28, 32, 40, 48, 64, 96, 128), 0.01, 16.27
MOST_BITS = 400


def _count(text: Column, part: str, width: int = 1) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / width


#: A run of at least DIGITS is the same as a longest run that passes.
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX.replace("+", f"{{{DIGITS},}}"), TOKEN), strict=True))


def found_spans(docs: DataFrame) -> DataFrame:
    """One row per match (doc_id, text_key, kind, start, end, token), failing base matches left out. Places are code points;
    a match stands behind all earlier matches and the pieces between them, summed along its document."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(body(), F.lit(p), F.lit(0)).alias("matches")) for k, p in PATTERNS.items()])
    some = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text", F.explode(F.filter(kinds, lambda x: F.size(x["matches"]) > 0)).alias("m"))
    pieces = reduce(lambda other, kp: F.when(F.col("m.kind") == kp[0], F.split("text", kp[1], -1)).otherwise(other), PATTERNS.items(), F.lit(None))
    rows = some.select("doc_id", "text_key", "m.kind", F.posexplode(F.arrays_zip(F.col("m.matches").alias("token"), pieces.alias("piece"))).alias("i", "x"))
    rows = rows.select("doc_id", "text_key", "kind", "i", "x.token", F.length("x.piece").alias("gap")).filter("token IS NOT NULL").dropDuplicates(["doc_id", "text_key", "kind", "i"])
    along = Window.partitionBy("doc_id", "text_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("token")).over(along)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("token"))
    value = F.length(F.regexp_extract("token", ASSIGN, 2)) >= VALUE
    passes = F.when(F.col("kind") == "assign", value).when(F.col("kind") == "access", F.length("token") >= KEY).otherwise(F.lit(True))
    return placed.filter(passes).select("doc_id", "text_key", "kind", "start", "end", "token")


def _natural_bits(tokens: DataFrame) -> Column:
    """For each character of ALPHABET (by its code) the bits that natural tokens spend on it: letters as often as in all
    tokens of small letters alone (no secret of 20 characters is likely to be one), the other classes by their shares."""
    plain = tokens.filter(F.col("token").rlike("^[a-z]+$")).select(F.explode(F.split("token", "")).alias("c")).filter("c <> ''")
    seen = {r.c: r.n for r in plain.groupBy("c").agg(F.count("*").alias("n")).collect()}
    total = sum(seen.values()) + 26

    def share(c: str) -> float:
        letter = (seen.get(c.lower(), 0) + 1) / total
        if c.isdigit():
            return DIGIT / 10
        return CAPITAL * letter if c.isupper() else (1 - CAPITAL - DIGIT - SIGN) * letter if c.islower() else SIGN / 4

    return F.array(*[-F.log2(F.lit(share(chr(i)))) if chr(i) in ALPHABET else F.lit(0.0) for i in range(128)])


def tested(tokens: DataFrame) -> DataFrame:
    """tokens (token) with encoding, length class and `odd`: the squared normal scores of three tests of uniform randomness,
    added up. They are chi-squared of the alphabet (its cube root is about normal; only excess counts), runs above and below
    the middle of the alphabet, and lag-one serial correlation."""
    core = tokens.withColumn("core", F.regexp_replace("token", "=+$", ""))
    choose = lambda pick: reduce(lambda other, e: F.when(F.col("core").rlike(e[1]), F.lit(e[pick])).otherwise(other), reversed(ENCODINGS), F.lit(None))
    rows = core.withColumn("encoding", choose(0)).withColumn("k", choose(2).cast("double")).withColumn("n", F.length("core").cast("double"))
    halves = reduce(lambda other, e: F.when(F.col("encoding") == e[0], F.translate("core", ALPHABET, "".join("1" if c in e[3] else "0" for c in ALPHABET))).otherwise(other), ENCODINGS, F.lit(""))
    rows = rows.withColumn("half", halves).withColumn("chars", F.filter(F.split("core", ""), lambda c: c != ""))
    rows = rows.withColumn("codes", F.transform("chars", lambda c: F.instr(F.lit(ALPHABET), c).cast("double")))
    squares = F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda a, c: a + F.pow(F.length("core") - F.length(F.replace(F.col("core"), c, F.lit(""))), F.lit(2.0)))
    free = F.col("k") - 1
    chi = F.pow(F.greatest(F.lit(0.0), squares * F.col("k") / F.col("n") - F.col("n")) / free, F.lit(1 / 3))
    chi_score = F.greatest(F.lit(0.0), (chi - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
    high = _count(F.col("half"), "1")
    low = F.col("n") - high
    runs = 1 + _count(F.col("half"), "01", 2) + _count(F.col("half"), "10", 2)
    both = 2 * high * low
    run_score = F.coalesce(F.try_divide(runs - both / F.col("n") - 1, F.sqrt(F.try_divide(both * (both - F.col("n")), F.col("n") * F.col("n") * (F.col("n") - 1)))), F.lit(9.0))
    mean = F.aggregate("codes", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    rows = rows.withColumn("chi", chi_score).withColumn("run", run_score).withColumn("codes", F.transform("codes", lambda x: x - mean))
    pairs = F.zip_with(F.expr("slice(codes, 1, size(codes) - 1)"), F.expr("slice(codes, 2, size(codes) - 1)"), lambda x, y: x * y)
    total = F.aggregate("codes", F.lit(0.0), lambda a, x: a + x * x)
    serial = F.coalesce(F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x), total) * F.sqrt("n"), F.lit(9.0))
    band = reduce(lambda other, b: F.when(F.col("n") >= b, F.lit(b)).otherwise(other), LENGTHS, F.lit(0))
    return rows.withColumn("odd", F.col("chi") ** 2 + F.col("run") ** 2 + serial**2).withColumn("band", band)


def random_tokens(spans: DataFrame) -> DataFrame:
    """The spans whose tokens the battery takes for random: not odd among random tokens, and unlike natural text so far
    that, within their length class, at most RATE of such finds are expected to be natural (Benjamini and Hochberg's rule,
    on whole bits: the least b whose 2 ** -b is within RATE times the share of the class with b bits or more). Bits are
    the log2 likelihood ratio of a uniform draw from the inferred alphabet to natural text, so by Markov's inequality
    2 ** -bits is a valid p-value against natural text."""
    bits = _natural_bits(spans)
    rows = tested(spans).filter("encoding IS NOT NULL AND NOT core RLIKE '^[0-9]+$'")
    ratio = F.aggregate("chars", F.lit(0.0), lambda a, c: a + F.element_at(bits, F.ascii(c) + 1)) - F.col("n") * F.log2("k")
    rows = staged(rows.withColumn("bits", F.least(F.lit(float(MOST_BITS)), F.greatest(F.lit(0.0), ratio))).select("doc_id", "text_key", "kind", "start", "end", "band", "bits", "odd"))
    levels = rows.groupBy("band", F.floor("bits").alias("b")).agg(F.count("*").alias("n"))
    above = Window.partitionBy("band").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumn("reached", F.sum("n").over(above)).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
    cut = levels.filter(F.pow(F.lit(2.0), -F.col("b")) <= RATE * F.col("reached") / F.col("all")).groupBy("band").agg(F.min("b").alias("cut"))
    return rows.join(cut, "band").filter((F.col("bits") >= F.col("cut")) & (F.col("odd") <= NOT_RANDOM)).select("doc_id", "text_key", "kind", "start", "end")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text) with `spans`, an array of (start, order, kind, end) sorted: code points, end
    exclusive, order as in KINDS. Base kinds are found by their fixed patterns, leftmost and not overlapping within a
    kind; `random` spans are tokens that the battery finds, wherever they stand. Null and empty texts have no spans; rows
    that repeat have the same. An empty table gives no rows."""
    found = staged(found_spans(docs))
    base = found.filter("kind <> 'random'").select("doc_id", "text_key", "kind", "start", "end")
    rest = random_tokens(found.filter("kind = 'random'"))
    rank = reduce(lambda other, k: F.when(F.col("kind") == k[1], F.lit(k[0])).otherwise(other), enumerate(KINDS), F.lit(9))
    spans = base.union(rest).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("order"), "kind", "end"))).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key")).alias("d")
    joined = rows.join(spans.alias("s"), F.expr("d.doc_id <=> s.doc_id AND d.text_key = s.text_key"), "left")
    return joined.select("d.doc_id", F.coalesce("s.spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of each base kind, the digest of the base spans, and all spans as text."""
    some = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(some(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scanned.select("doc_id", *counts, F.sha2(told(some(*KINDS[:3])), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
