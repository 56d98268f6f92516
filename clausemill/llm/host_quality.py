"""Quality rules per text, and verdicts per host from the shrunk failure rates of its texts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.session import cut_lineage

WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: The rules that are aggregated by host, each with a rate and a prior of its own.
RULES = ("short", "repeated", "symbols", "dup_lines")
#: A host whose shrunk rate of texts that fail one of the rules is above this fails with all its texts.
MAX_HOST_RATE = 0.5
#: Weight of the prior, in texts, where no host has two texts to fit it from.
DEFAULT_STRENGTH = 10.0
#: The prior weighs as much as one text at least, also where hosts spread as wide as they can.
LEAST_WEIGHT = 1.0


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD_CHARACTER))
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def worded_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD_CHARACTER))).cast("long")


def repeated_window_words(found: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur at least twice in ``found``, an array of words.

    A window's place is packed into the low bits of its 64-bit hash, as many as the text's length needs; after one sort
    of plain numbers equal windows are neighbours, whatever the number of repeats. Neighbours whose other bits are equal
    are compared by their words; where these differ (at a million words once in some twenty texts) the windows of
    the text are sorted by their words instead.
    """

    def hashes(w):
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
        )

    def packed(h, bits):
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return bound(
            low, lambda m: F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long"))))
        )

    def places(w, p, bits):
        def same(x, y):
            return F.coalesce(F.call_function("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0, F.lit(False))

        def differ(x, y):
            a, b = x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int")
            return functools.reduce(lambda one, two: one | two, [F.get(w, a + k) != F.get(w, b + k) for k in range(width)])

        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        mixed = F.exists(F.sequence(F.lit(1), F.size(p) - 1), lambda j: same(F.get(p, j), F.get(p, j - 1)) & differ(F.get(p, j), F.get(p, j - 1)))
        repeated = F.filter(p, lambda x, j: (j > 0) & same(x, F.get(p, j - 1)) | same(x, F.get(p, j + 1)))
        return F.when(mixed, by_words(w)).otherwise(F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(low))))

    def by_words(w):
        names = [f"w{k}" for k in range(width)]

        def repeated(rows):
            def same(x, y):
                return F.coalesce(functools.reduce(lambda one, two: one & two, [x[n] == y[n] for n in names]), F.lit(False))

            return F.filter(rows, lambda x, j: (j > 0) & same(x, F.get(rows, j - 1)) | same(x, F.get(rows, j + 1)))

        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - width), lambda i: F.struct(*[F.get(w, i + k).alias(n) for k, n in enumerate(names)], i.cast("long").alias("at"))
        )
        return bound(F.sort_array(windows), lambda rows: F.sort_array(F.transform(repeated(rows), lambda x: x["at"])))

    def covered(at):
        gaps = F.transform(at, lambda x, j: F.when(j == 0, F.lit(width)).otherwise(F.least(F.lit(width).cast("long"), x - F.get(at, j - 1))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    def count(w, h):
        bits = F.ceil(F.log2(F.size(h).cast("double") + 1)).cast("int")
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            bound(bits, lambda b: bound(packed(h, b), lambda p: bound(places(w, p, b), covered)))
        )

    return bound(
        found, lambda w: F.when(F.size(w) <= width, F.lit(0).cast("long")).otherwise(bound(hashes(w), lambda h: count(w, h)))
    )


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``key``, ``host``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines`` per row.

    A null or blank text has no words, symbols or lines. Rows are measured one by one, repeated rows each for itself.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias(key),
        F.col(host).alias("host"),
        F.length(F.regexp_replace(body, WORD_GAP, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(F.col(text)).alias("n_dup_lines"),
        worded_lines(F.col(text)).alias("n_lines"),
        bound(
            words(F.col(text)),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words")),
        ).alias("counts"),
    ).select(
        key, "host", "counts.n_words", "word_chars", "n_symbols", "n_dup_lines", "counts.n_repeat_words", "n_lines"
    )


def with_rules(measured: DataFrame) -> DataFrame:
    """Adds a flag for each of the ``RULES`` and ``base_failed``: too few words, or too many of them in repeated windows."""
    flags = {
        "short": F.col("n_words") < MIN_WORDS,
        "repeated": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
    }
    return measured.withColumns(flags).withColumn("base_failed", F.col("short") | F.col("repeated"))


def host_rates(judged: DataFrame, flag: str = "base_failed", strength: float = DEFAULT_STRENGTH) -> DataFrame:
    """``host``, ``n``, ``failed`` and ``rate``: the share of texts with ``flag``, shrunk by a beta prior fitted to all hosts.

    With ``x`` failed of the ``n`` texts of a host, the prior's mean is the share of all texts that fail. Its weight follows from
    the moments of the beta-binomial distribution: what the rates of the hosts, weighted by their texts, spread more than
    texts that fail by chance alone would. Hosts that spread no more have the mean as their rate. Where no host has two
    texts the spread tells nothing and the weight is ``strength`` texts. Five sums are all that reaches the
    driver. Texts without a host (null) count as the host ``''``.
    """
    hosts = judged.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("failed"))
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("texts"), F.sum("failed").alias("failed"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("spread"),
    ).first()
    mean, weight = prior(sums["hosts"] or 0, sums["texts"] or 0, sums["failed"] or 0, sums["squares"] or 0.0, sums["spread"] or 0.0, strength)
    if weight is None:
        return hosts.withColumn("rate", F.lit(mean))
    return hosts.withColumn("rate", (F.col("failed") + mean * weight) / (F.col("n") + weight))


def prior(hosts: int, texts: int, failed: int, squares: float, spread: float, strength: float) -> tuple[float, float | None]:
    """Mean and weight of the beta prior; no weight where the hosts are alike, so that all have the mean.

    ``squares`` is the sum of ``n * n``, ``spread`` that of ``x * x / n`` over the hosts.
    """
    mean = failed / texts if texts else 0.0
    chance = mean * (1 - mean)
    several = texts - squares / texts - (hosts - 1) if texts else 0.0
    if chance <= 0:
        return mean, None
    if several <= 1e-9 * texts:
        return mean, strength
    alike = (spread - texts * mean * mean - chance * (hosts - 1)) / (chance * several)
    if alike <= 1e-12:
        return mean, None
    return mean, max(LEAST_WEIGHT, 1 / alike - 1)


def host_verdicts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """The measures of every row with its flags, ``base_failed``, the host's rate of each rule, the highest as ``host_rate``,
    and ``kept``.

    ``kept`` is false where the row itself fails or one of its host's shrunk rates is above ``max_rate``. The measures are
    written once to the shared checkpoint folder (a few numbers per row), so texts are read once; hosts are counted
    with map-side sums, so a host with a third of all rows costs no more than another. An empty table gives no rows.
    """
    judged = cut_lineage(with_rules(measures(docs, key, text, host)))
    out = judged.withColumn("host", F.coalesce("host", F.lit("")))
    for rule in RULES:
        out = out.join(host_rates(judged, rule).select("host", F.col("rate").alias(f"rate_{rule}")), "host")
    highest = F.greatest(*[F.col(f"rate_{rule}") for rule in RULES])
    return out.withColumn("host_rate", highest).withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))
