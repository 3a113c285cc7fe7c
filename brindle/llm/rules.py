"""Quality rules as a ledger of bits (native).

Each document is measured once. ``rule_ledger`` stores, beside the measurements, one long whose bit k is
set where rule k fails. A policy is a named, versioned set of rules, that is, a mask: applying one, or
counting what each rule does in it, reads the ledger and never the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import NOT_SPACE, SPACE, let, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_ellipsis_lines")


@dataclass(frozen=True)
class Rule:
    """``fails`` gets the measurements by name and returns a boolean that is never null."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule]) -> int:
        at = {r.name: k for k, r in enumerate(rules)}
        return sum(1 << at[name] for name in set(self.rules))


#: A rule's bit is its place here: append only.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
    Rule("many_symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 7 * m["n_lines"]),
    Rule("few_letters", lambda m: 10 * m["n_letters"] < 3 * m["word_chars"]),
    Rule("ellipsis_lines", lambda m: 10 * m["n_ellipsis_lines"] > 3 * m["n_lines"]),
)
BASE = Policy("base", 1, ("too_few_words", "repeated_words"))
STRICT = Policy("strict", 1, tuple(r.name for r in RULES))


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included.

    Windows are told apart by hash first, a long each; only those whose hash repeats are then written out and compared.
    """
    window = lambda i: (F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(*window(i)))

    def repeated(s: Column) -> Column:
        """Places (``i``) whose ``t`` equals a neighbour's in sorted order."""
        same = lambda x, i: F.get(s, i - 1)["t"].eqNullSafe(x["t"]) | F.get(s, i + 1)["t"].eqNullSafe(x["t"])
        return F.transform(F.filter(s, same), lambda x: x["i"])

    def covered(hs: Column) -> Column:
        """Each repeated window, in order of place, adds the words that the one before it has not covered."""
        by_hash = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("t"), i.alias("i"))))
        written = F.transform(let(by_hash, repeated), lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("t"), i.alias("i")))
        return F.aggregate(
            F.sort_array(let(F.sort_array(written), repeated)),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    none = F.lit(0).cast("long")
    return F.when(F.size(w) < 4, none).otherwise(
        let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), none).otherwise(covered(hs)))
    )


def measured(docs: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys`` and the MEASURES of each row's whole text, as longs; null and empty texts measure 0 throughout.

    Lines are those with a word; ellipsis lines end with three points or the one character for them."""
    t = F.coalesce(F.col(text), F.lit(""))
    of_words = let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    of_lines = let(
        F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE)),
        lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"), F.size(F.filter(x, lambda y: y.endswith("...") | y.endswith("…"))).alias("e")),
    )
    raw = docs.select(
        *keys,
        of_words.alias("_w"),
        of_lines.alias("_l"),
        F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long").alias("n_letters"),
    )
    return raw.select(
        *keys,
        F.col("_w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("_l.n") - F.col("_l.d")).cast("long").alias("n_dup_lines"),
        F.col("_w.r").alias("n_repeat_words"),
        F.col("_l.n").cast("long").alias("n_lines"),
        "n_letters",
        F.col("_l.e").cast("long").alias("n_ellipsis_lines"),
    )


def rule_ledger(docs: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``docs``: ``keys``, MEASURES and ``rule_bits`` (bit k: ``rules[k]`` fails).

    Rows are kept one for one, so repeated and null keys stay. Other columns of ``docs`` are not read.
    """
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    m = measured(docs, text, keys)
    cols = {c: F.col(c) for c in MEASURES}
    bits = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(r.fails(cols), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return m.select(*keys, *MEASURES, bits.alias("rule_bits"))


def failed(policy: Policy, rules: Sequence[Rule] = RULES, bits: str = "rule_bits") -> Column:
    """Whether a ledger row fails a rule of the policy."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) != 0


def apply_policy(ledger: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with ``kept``, ``policy`` and ``policy_version``."""
    return ledger.withColumns(
        {"kept": ~failed(policy, rules), "policy": F.lit(policy.name), "policy_version": F.lit(policy.version)}
    )


def ablation(ledger: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of the policy: rows it fails, rows that only it fails, rows kept with and without it. An empty ledger
    gives no rows.

    Rows with equal bits are counted together first, so what is shuffled is one row per bit pattern and task.
    """
    mask = policy.mask(rules)
    seen = ledger.groupBy(F.col("rule_bits").bitwiseAND(F.lit(mask).cast("long")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(rules) if mask >> k & 1))
    return (
        seen.select("b", "n", F.explode(each).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("b").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(zero)).alias("fails"),
            F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("n")).otherwise(zero)).alias("fails_alone"),
            F.sum(F.when(F.col("b") == 0, F.col("n")).otherwise(zero)).alias("kept"),
            F.sum(F.when((F.col("b") == 0) | (F.col("b") == F.col("r.bit")), F.col("n")).otherwise(zero)).alias("kept_without"),
        )
    )
