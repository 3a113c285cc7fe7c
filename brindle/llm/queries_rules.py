"""Query of the rule ledger, and its SQL."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import stored, table
from brindle.llm.rules import BASE, RULES, STRICT, ablation, apply_policy, failed, rule_ledger


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts are read once, for the ledger; both policies then read the stored ledger alone."""
    ledger = stored(rule_ledger(table(spark, sf_dir, "documents")), "ledger")
    return apply_policy(ledger, STRICT).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed(BASE).alias("base_failed"), "kept", "rule_bits"
    )


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule does in each policy, from one stored ledger."""
    ledger = stored(rule_ledger(table(spark, sf_dir, "documents")), "ledger")
    parts = (ablation(ledger, p).withColumns({"policy": F.lit(p.name), "policy_version": F.lit(p.version)}) for p in (BASE, STRICT))
    return reduce(DataFrame.unionByName, parts)


#: Up to the bits of every document.
LEDGER_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), p AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM p
), rep AS (
  SELECT r, count(DISTINCT i + o) AS n FROM g, (VALUES (0), (1), (2)) v(o) WHERE c >= 2 GROUP BY r
), l AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT x) AS dup, count(*) FILTER (x LIKE '%...' OR x LIKE '%…') AS points
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(l.n, 0) AS n_lines, length(regexp_replace(t, '\P{L}+', '', 'g')) AS n_letters, coalesce(l.points, 0) AS n_points
  FROM d LEFT JOIN rep USING (r) LEFT JOIN l USING (r)
), b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (word_chars < 2 * n_words)::INT + 8 * (word_chars > 15 * n_words)::INT
    + 16 * (10 * n_symbols > 3 * n_words)::INT + 32 * (10 * n_dup_lines > 7 * n_lines)::INT
    + 64 * (10 * n_letters < 3 * word_chars)::INT + 128 * (10 * n_points > 3 * n_lines)::INT AS BIGINT) AS rule_bits
  FROM m
)
"""

SQL = LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (rule_bits & 3) <> 0 AS base_failed, rule_bits = 0 AS kept, rule_bits
FROM b
"""

ABLATION_SQL = LEDGER_SQL + f"""
, r AS (
  SELECT * FROM (VALUES {", ".join(f"('{p.name}', {p.version}, {p.mask(RULES)}, '{r.name}', {1 << k})" for p in (BASE, STRICT) for k, r in enumerate(RULES) if p.mask(RULES) >> k & 1)})
    v(policy, policy_version, mask, rule, bit)
)
SELECT policy, policy_version, rule, count(*) FILTER ((rule_bits & bit) <> 0) AS fails, count(*) FILTER ((rule_bits & mask) = bit) AS fails_alone,
       count(*) FILTER ((rule_bits & mask) = 0) AS kept, count(*) FILTER ((rule_bits & mask) = 0 OR (rule_bits & mask) = bit) AS kept_without
FROM b, r GROUP BY policy, policy_version, rule
"""

QUERIES = {"op4_rule_ledger": op4_rule_ledger, "rule_ablation": rule_ablation}
ORACLES = {"op4_rule_ledger": SQL, "rule_ablation": ABLATION_SQL}
