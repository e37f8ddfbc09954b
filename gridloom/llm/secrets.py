"""Secret scans, in DataFrame and SQL functions only.

Base spans: assignments of long values to telling names, access key ids and long hex runs, as regular expressions give
them.  The entropy method adds spans: candidate strings are the long runs of token characters with both letters and
digits; for each character class (hex digits, base64 characters) a window slides over them and its Shannon entropy is kept by
incremental counts (a character's term changes as it enters and leaves; a window with a character of another class has no entropy).
A candidate whose best window reaches its class's threshold is a secret, unless the allow-list suppresses it
(UUIDs, placeholders, alphabets in order).  The allow-list touches no base span.

Positions are code points, ends exclusive.  Defined cases: a null text is empty; no spans make empty strings;
matches that fail a length test are dropped and still take up their text; extra columns are ignored; each row gives one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (kind, pattern, condition on the match h)
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    ("assign", ASSIGN, lambda h: F.length(F.regexp_extract(h, ASSIGN, 1)) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda h: F.length(h) >= 18),
    ("hex", r"[0-9a-f]{16,}", lambda h: F.lit(True)),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: (characters, window, least entropy in bits)
CLASSES = [("0123456789abcdef", 16, 2.9), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.75)]
ALLOW = [
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|your[_-]|x{6}|test[_-]?key|dummy",
    r"(?i)abcdefghij|0123456789|1234567890|qwertyuiop",
]
_SPAN = "array<struct<start:long,kind:int,end:long>>"


def _entropy(chars, symbols: str, width: int):
    """The largest entropy of a window over an array of characters, -1 without a full window of the class."""
    def term(c):
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    size = len(symbols)
    lookup = F.lit(symbols)

    def let(x, f):
        return F.element_at(F.transform(F.array(x), f), 1)

    def place(i):
        return F.call_function("locate", F.element_at(chars, i), lookup)

    # The counts are a string, a character for each symbol, of which a step changes two at most.
    def count(counts, at):
        return F.ascii(F.substr(counts, at, F.lit(1))) - 48

    def put(counts, at, n):
        return F.overlay(counts, F.char(n + 48), at, F.lit(1))

    def step(a, i):
        came = place(i)
        went = F.when(i > width, place(F.greatest(i - width, F.lit(1)))).otherwise(F.lit(0))

        def left(x):
            # The character that leaves is taken out, then the new one comes in.
            old = count(a["counts"], x["went"])
            return F.struct(x["came"].alias("came"), F.when(x["went"] > 0, put(a["counts"], x["went"], old - 1)).otherwise(a["counts"]).alias("counts"),
                F.when(x["went"] > 0, a["sum"] - term(old) + term(old - 1)).otherwise(a["sum"]).alias("sum"), (a["n"] - F.when(x["went"] > 0, 1).otherwise(0)).alias("n"))

        def entered(x):
            now, n = count(x["counts"], x["came"]), x["n"] + F.when(x["came"] > 0, 1).otherwise(0)
            total = F.when(x["came"] > 0, x["sum"] - term(now) + term(now + 1)).otherwise(x["sum"])
            best = F.greatest(a["best"], F.when(n == width, F.log2(F.lit(float(width))) - total / width).otherwise(F.lit(-1.0)))
            return F.struct(F.when(x["came"] > 0, put(x["counts"], x["came"], now + 1)).otherwise(x["counts"]).alias("counts"), total.alias("sum"), n.alias("n"), best.alias("best"))

        return let(let(F.struct(came.alias("came"), went.alias("went")), left), entered)

    start = F.struct(F.repeat(F.lit("0"), F.lit(size)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(-1.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda a: a["best"])


def _suspicious(h):
    """Candidates with letters and digits, not allowed, and a window of high entropy in some class."""
    plain = F.lit(True)
    for pattern in ALLOW:
        plain = plain & ~h.rlike(pattern)
    best = F.lit(False)
    for symbols, width, least in CLASSES:
        best = best | (_entropy(F.split(h, ""), symbols, width) >= least)
    return F.when(h.rlike("[0-9]") & h.rlike("[A-Za-z]") & plain, best).otherwise(F.lit(False))


RUN = 256  # matches whose places are found one after the other: lists grow by copying


def _with_spans(df: DataFrame, name: str, kind: int, pattern: str, accept) -> DataFrame:
    """Adds a column of the accepted matches' spans: what lies between matches gives their places, run by run of matches."""
    df = df.withColumn("__hits", F.when(F.col("text").rlike(pattern), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("__gaps", F.when(F.col("__hits").isNotNull(), F.split("text", pattern, -1)))
    n, runs = F.size("__hits"), F.sequence(F.lit(0), F.floor((F.size("__hits") - 1) / RUN).cast("int"))

    def of(r):
        return F.sequence(r * RUN + 1, F.least((r + 1) * RUN, n))

    def length(i):
        return (F.length(F.element_at(F.col("__gaps"), i)) + F.length(F.element_at(F.col("__hits"), i))).cast("long")

    def begins(a, r):
        size = F.aggregate(of(r), F.lit(0).cast("long"), lambda x, i: x + length(i))
        return F.struct((a["at"] + size).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))

    def step(a, i):
        h = F.element_at(F.col("__hits"), i)
        start = a["at"] + F.length(F.element_at(F.col("__gaps"), i))
        end = start + F.length(h)
        span = F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(accept(h), F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    df = df.withColumn("__begins", F.when(n > 0, F.aggregate(runs, zero, begins, lambda a: a["out"])))

    def spans(r):
        start = F.struct(F.element_at(F.col("__begins"), r + 1).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(of(r), start, step, lambda a: a["out"])

    found = F.when(n > 0, F.flatten(F.transform(runs, spans))).otherwise(F.array().cast(_SPAN))
    return df.withColumn(name, found).drop("__hits", "__gaps", "__begins")


def _joined(spans, kinds: list[str]):
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans by kind (assign, access, hex, entropy: arrays of start, kind, end) for every row."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for i, (kind, pattern, accept) in enumerate([*BASE, ("entropy", CANDIDATE, _suspicious)]):
        df = _with_spans(df, kind, i, pattern, accept)
    return df.drop("text")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, as text, for every row."""
    kinds = [k for k, _, _ in BASE]
    df = scan(docs).withColumn("__base", F.concat(*kinds))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in kinds]
    return df.select("doc_id", *counts, F.sha2(_joined(F.col("__base"), kinds), 256).alias("base_sha256"), _joined(F.concat("__base", "entropy"), [*kinds, "entropy"]).alias("spans"))
