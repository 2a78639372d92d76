"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  Its failure is one bit of
``rule_bits`` and its measurement is a column beside it.  A policy is a
versioned mask over those bits: applying one, or asking what a policy without
some rule would have kept, is integer arithmetic on the ledger and never
touches the texts again.

Only built-in functions are used; there is no shuffle in the ledger itself.
Words are ``[^\\x20\\x09-\\x0D]+``.  Defined cases: a null or blank text has no
words, all counts 0 and fails ``too_few_words``; repeated rows give repeated
ledger rows; null ids pass through; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD_SPLIT

WINDOW = 8

# rule name -> failure, over the measurement columns; the place is the bit
RULES: dict[str, str] = {
    "too_few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

# policy version -> rules that reject
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("too_few_words", "repeated_words"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def mask_of(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _words_covered(s: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; ``s`` holds the
    (hash, position) pairs of all windows in hash order."""
    same = lambda k, x: F.try_element_at(s, k)["h"] == x["h"]
    twice = F.filter(s, lambda x, k: F.coalesce(same(k + 2, x), F.lit(False))
                     | F.when(k > 0, same(F.greatest(k, F.lit(1)), x)).otherwise(False))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts, zero,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_lines, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    bare = F.btrim(F.col("t"), F.lit(SPACES))
    d = d.select(
        "doc_id",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_SPLIT)).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    windows = F.when(
        F.size("w") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.select(
        "doc_id", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("h"))
    # only documents in which some window comes twice sort their windows
    pairs = F.when(
        F.size("h") > F.size(F.array_distinct("h")),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.withColumn("s", pairs)
    out = F.struct(
        "doc_id", "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("s").isNull(), F.lit(0).cast("long")).otherwise(_words_covered(F.col("s"))).alias("n_repeat_words"))
    # one row in, one row out: a filter on a measurement stays above this and does not copy the expressions into itself
    return d.select(F.inline(F.array(out)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``rule_bits``: bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for name, failure in RULES.items():
        bits = bits + F.when(F.expr(failure), F.lit(BIT[name])).otherwise(F.lit(0))
    return measure(docs, id_col, text_col).withColumn("rule_bits", bits)


def apply_policy(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``base_failed`` (either rule of the first policy) and ``kept`` under
    the given policy; a document that fails the base is never kept."""
    base = F.col("rule_bits").bitwiseAND(F.lit(mask_of("v1"))) != 0
    own = F.col("rule_bits").bitwiseAND(F.lit(mask_of(policy))) != 0
    return led.withColumns({"base_failed": base, "kept": ~base & ~own, "policy": F.lit(policy)})


def ablation(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents failing it, documents that only it
    rejects, and documents kept without it.  The ledger is first summed by
    its bit patterns (at most 2^rules rows), so the rules then cost nothing."""
    mask = mask_of(policy)
    by_bits = led.groupBy(F.col("rule_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in POLICIES[policy]]))
    r = by_bits.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return r.groupBy("rule").agg(
        hit(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        hit(F.col("bits") == F.col("bit")).alias("n_only"),
        hit(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"))


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the same columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    led = apply_policy(ledger(docs.select(row.alias("row"), F.col("text")), "row"), policy)
    return led.filter("kept").select("doc_id.*")
