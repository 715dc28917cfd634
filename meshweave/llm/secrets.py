"""Secret scans: assignment, access-key and hexadecimal patterns, and a randomness test battery for other tokens.

A token's encoding is inferred from its characters. Three tests ask whether it could be drawn at random from that
alphabet: chi-squared uniformity, runs above and below the alphabet's middle, and serial correlation; Fisher's method
combines them. What passes must also be unlike ordinary text: a bound on the chance that text of its length has a mixture
of character classes at least as strange (by enumeration of all mixtures of that length) goes through Benjamini and Hochberg's control of false discoveries over all tokens of the document. DataFrame functions only.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Names, barrier

#: The three base patterns and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Tokens that the battery looks at, and the least number of characters from which its tests say anything.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
#: Encodings by pattern, first match first, with the alphabet in order.
ENCODINGS = [
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("upper36", r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower36", r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]
#: Classes of ordinary text's characters and their shares: lower case, upper case, digits, others.
TEXT_SHARES = [0.90, 0.06, 0.03, 0.01]
#: A token is random where the battery's combined p is at least this; and no text at this rate of false discoveries.
LEAST_P, FALSE_RATE = 0.01, 0.001
#: Longest token whose mixtures are enumerated; Sanov's factor (n + 1)^3 serves for longer ones, which are strange enough.
MOST_EXACT = 128


def matches(text: Column, pattern: str, kind: str, group: int | None = None, least: int = 0) -> Column:
    """Leftmost non-overlapping matches with their places: an array of (start, kind, end, text), in code points.

    The text split at the matches gives the gaps, whose lengths and the matches' own lead from place to place.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m"))), inner, lambda x, i: F.struct(x["g"].alias("g"), x["m"].alias("m"), F.length(i).alias("i")))
    return F.when(text.rlike(pattern), _placed(zipped, kind, least)).otherwise(F.array().cast(FOUND))


SPANS = "array<struct<start:int,kind:int,end:int>>"
#: The same with the text that was found.
FOUND = "array<struct<start:int,kind:int,end:int,text:string>>"
#: Matches in a run: places are summed up in each run, then over the runs, as growing one array would take the square of the matches.
RUN = 128


def _placed(zipped: Column, kind: str, least: int) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        length = F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (begin + length).alias("end"), x["m"].alias("text"))
        out = F.when(x["m"].isNotNull() & (x["i"] >= least), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((begin + length).alias("at"), out.alias("out"))

    def joined_runs(runs: Column) -> Column:
        starts = F.aggregate(
            runs,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        moved = lambda run, at: F.transform(run["out"], lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end"), s["text"].alias("text")))
        return F.flatten(F.zip_with(runs, starts, moved))

    def runs_of(x: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda k: F.slice(x, k * RUN + 1, RUN))
        return F.transform(cut, lambda run: F.aggregate(run, start, step))

    # arrays of one, so that what is used twice is computed once
    return F.flatten(F.transform(F.array(zipped), lambda x: F.flatten(F.transform(F.array(runs_of(x)), joined_runs))))


def _bare(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"])).cast(SPANS)


def _before(points: Column, marks: Column, inclusive: bool) -> Column:
    """For each of ascending marks, how many points lie before it (or on it, if inclusive)."""
    rows = F.concat(
        F.transform(points, lambda p: F.struct(p.alias("v"), F.lit(int(not inclusive)).alias("o"), F.lit(-1).alias("k"))),
        F.transform(marks, lambda m, k: F.struct(m.alias("v"), F.lit(int(inclusive)).alias("o"), k.alias("k"))),
    )
    # the k-th mark has k marks before it
    placed = F.transform(F.sort_array(rows), lambda x, i: F.struct(x["k"].alias("k"), (i - x["k"]).alias("n")))
    return F.transform(F.filter(placed, lambda x: x["k"] >= 0), lambda x: x["n"])


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by a rational approximation good to 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series, F.lit(1e-300))


@functools.cache
def tail_factors() -> list[float]:
    """For each length n up to MOST_EXACT the least c so that text diverges by d or more with chance c exp(-d) at most.

    The divergence is that of the classes' counts from TEXT_SHARES; every mixture of n characters is enumerated.
    """
    log_factorial = np.r_[0.0, np.cumsum(np.log(np.arange(1, MOST_EXACT + 1)))]
    factors = [1.0]
    for n in range(1, MOST_EXACT + 1):
        # the classes' counts are the gaps between three bars
        i, j = np.triu_indices(n + 1)
        rest = n - j
        last = np.concatenate([np.arange(r + 1) for r in rest])
        a, b = np.repeat(i, rest + 1), np.repeat(j - i, rest + 1)
        counts = [a, b, last, n - a - b - last]
        logs = np.log(np.maximum(np.arange(n + 1), 1) / n)
        divergence = sum(c * (logs[c] - math.log(share)) for c, share in zip(counts, TEXT_SHARES, strict=True))
        chance = np.exp(log_factorial[n] + sum(c * math.log(share) - log_factorial[c] for c, share in zip(counts, TEXT_SHARES, strict=True)))
        order = np.argsort(-divergence)
        factors.append(float(np.max(np.cumsum(chance[order]) * np.exp(divergence[order]))))
    return factors


def battery(token: Column) -> Column:
    """Struct (p, text_p, tail) of a token: combined p under randomness, Sanov's and the enumerated bound of its chance as text."""
    bare = F.regexp_replace(token, "=+$", "")
    code = F.coalesce(*[F.when(token.rlike(p), F.lit(i)) for i, (_, p, _) in enumerate(ENCODINGS)], F.lit(len(ENCODINGS) - 1))
    alphabet = F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), code + 1)
    canonical = F.when(code == 0, F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))
    chars = F.split(canonical, "")
    values = F.transform(chars, lambda c: F.instr(alphabet, c) - 1)
    n, k = F.size(chars).cast("double"), F.length(alphabet).cast("double")
    packed = F.array(F.struct(values.alias("v"), n.alias("n"), k.alias("k"), bare.alias("bare")))
    return F.element_at(F.transform(packed, _tests), 1)


def _tests(x: Column) -> Column:
    v, n, k = x["v"], x["n"], x["k"]
    zero = F.lit(0.0)
    # chi-squared uniformity over the alphabet, by its normal approximation (upper tail: uneven use)
    squares = F.aggregate(F.array_distinct(v), zero, lambda s, a: s + F.pow(F.size(F.filter(v, lambda b: b == a)), F.lit(2.0)))
    chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1))
    p_chi = F.when(chi > 0, 2 * _normal_tail(chi)).otherwise(1.0)
    # runs above and below the middle of the alphabet
    high = F.transform(v, lambda a: F.when(a >= k / 2, 1.0).otherwise(0.0))
    n1 = F.aggregate(high, zero, lambda s, a: s + a)
    n2 = n - n1
    runs = 1 + F.aggregate(F.zip_with(F.slice(high, 2, F.size(high)), high, lambda a, b: F.when(b.isNull() | a.isNull() | (a == b), 0.0).otherwise(1.0)), zero, lambda s, a: s + a)
    mean = 2 * n1 * n2 / n + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    p_runs = F.when((n1 == 0) | (n2 == 0), F.pow(F.lit(0.5), n - 1)).otherwise(F.least(F.lit(1.0), 2 * _normal_tail(F.abs(runs - mean) / spread)))
    # lag-1 serial correlation around the alphabet's own mean and variance
    middle, variance = (k - 1) / 2, (k * k - 1) / 12
    products = F.zip_with(F.slice(v, 2, F.size(v)), v, lambda a, b: F.coalesce((a - middle) * (b - middle), zero))
    serial = F.aggregate(products, zero, lambda s, a: s + a) / (variance * F.sqrt(n - 1))
    p_serial = F.least(F.lit(1.0), 2 * _normal_tail(F.abs(serial)))
    # Fisher: -2 sum(ln p) is chi-squared of 6 degrees; its tail has a closed form
    half = -(F.ln(F.greatest(p_chi, F.lit(1e-300))) + F.ln(F.greatest(p_runs, F.lit(1e-300))) + F.ln(F.greatest(p_serial, F.lit(1e-300))))
    p = F.exp(-half) * (1 + half + half * half / 2)
    # Sanov's bound for the mixture of character classes under ordinary text
    bare = x["bare"]
    counts = [F.regexp_count(bare, F.lit(c)).cast("double") for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]
    divergence = sum((F.when(c > 0, c * F.ln(c / n / share)).otherwise(0.0) for c, share in zip(counts, TEXT_SHARES, strict=True)), F.lit(0.0))
    text_p = F.least(F.lit(1.0), F.pow(n + 1, F.lit(len(TEXT_SHARES) - 1.0)) * F.exp(-divergence))
    factor = F.coalesce(F.get(F.array(*[F.lit(c) for c in tail_factors()]), n.cast("int")), F.pow(n + 1, F.lit(len(TEXT_SHARES) - 1.0)))
    tail = F.least(F.lit(1.0), factor * F.exp(-divergence))
    return F.struct(p.alias("p"), text_p.alias("text_p"), tail.alias("tail"))


def _random_spans(df: DataFrame, n: Names) -> DataFrame:
    """Add n.added: spans of tokens that the battery finds random and no text. Needs n.body and n.base."""
    df = barrier(df, **{n.tokens: matches(F.col(n.body), TOKEN, "random")})
    # each token with its tests; those within or across a base span are part of it
    begun = _before(F.transform(n.base, lambda b: b["start"]), F.transform(n.tokens, lambda t: t["end"]), False)
    ended = _before(F.transform(n.base, lambda b: b["end"]), F.transform(n.tokens, lambda t: t["start"]), True)
    df = barrier(df, **{n.met: F.when((F.size(n.base) > 0) & (F.size(n.tokens) > 0), F.zip_with(begun, ended, lambda b, e: b - e))})
    apart = F.filter(n.tokens, lambda t, i: F.coalesce(F.get(n.met, i), F.lit(0)) == 0)
    tested = F.transform(apart, lambda t: F.struct(t.alias("span"), battery(t["text"]).alias("test")))
    df = barrier(df, **{n.tested: tested})
    df = barrier(df, **{n.ranked: F.array_sort(F.transform(n.tested, lambda t: t["test"]["tail"]))})
    # Benjamini and Hochberg: the largest p that is at most its rank's share of the rate
    passing = F.filter(n.ranked, lambda p, i: p * F.size(n.ranked) <= FALSE_RATE * (i + 1))
    df = barrier(df, **{n.limit: F.array_max(passing)})
    chosen = F.filter(n.tested, lambda t: (t["test"]["p"] >= LEAST_P) & (t["test"]["tail"] <= F.coalesce(F.col(n.limit), F.lit(-1.0))))
    return df.withColumn(n.added, _bare(F.transform(chosen, lambda t: t["span"])))


def count_of(spans: str, kind: str) -> Column:
    """The number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, text: str = "text", base: str = "base", every: str = "all") -> DataFrame:
    """Find the secrets of every whole text: the input's columns and two arrays of (start, kind, end).

    `base` holds the spans of the three patterns, `every` those and the battery's, in order of start, then kind. Null
    texts count as empty and have none; repeated rows are scanned each; an empty table gives an empty table; the input
    may have columns of any names (those named as the two arrays are replaced).
    """
    n = Names(docs)
    df = docs.drop(base, every).select("*", F.coalesce(F.col(text), F.lit("")).alias(n.body))
    body = F.col(n.body)
    patterns = F.concat(matches(body, ASSIGN, "assign", 2, ASSIGN_LEAST), matches(body, ACCESS, "access"), matches(body, HEX, "hex"))
    df = _random_spans(barrier(df, **{n.base: F.sort_array(_bare(patterns))}), n)
    return n.drop_from(barrier(df, **{base: F.col(n.base), every: F.sort_array(F.concat(n.base, n.added))}))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with every secret replaced by a mark; their other columns as they are. Null texts stay null."""
    n = Names(docs, "_r")
    found = scan(docs, text, n.base, n.every)
    body = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    masked = F.aggregate(n.every, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body))))
    new = F.when(F.size(n.every) > 0, masked).otherwise(body)
    return found.withColumn(text, new).select(docs.columns)
