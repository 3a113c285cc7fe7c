"""Native operators: rule ledger, source mixing, sharding."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brindle.llm.mixing import apportion, copies, mix, targets
from brindle.llm.rules import BASE, RULES, STRICT, Policy, ablation, apply_policy, measured, rule_ledger
from brindle.llm.sharding import lay_out, lookup_table, place

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op2_source_mix", "op4_rule_ledger", "op8_shard_lookup", "shard_lookup_small", "rule_ablation"])
def test_query_equals_sql(name, spark, sf_dir, same):
    same(entry.queries()[name](spark, sf_dir), entry.oracle_sql()[name])


# Rules


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(lines), sum(unicodedata.category(c)[0] == "L" for c in text), sum(x.endswith(("...", "…")) for x in lines)


TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "one", "a b", "a b c", "a a a a", "a b c a b c", "x y z\nx y z\n\nx y z", "é ü 　 w v", "#*$%&|<> a",
    "a b c d a b c e b c d", "line\nline \nline\n", "word " * 3000, "x" * 50_000, "more...\nand so on…\n...\nend", "é 123 Ⅷ ª ǅ 中", "".join(f"w{i} " for i in range(5000)) + "w1 w2 w3", "\U0001F600 \U0001F600 \U0001F600 \U0001F600",
]


def test_measures_against_brute_force(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choices("abc", k=rng.randrange(40))) + rng.choice(["", "\n", "\na b"]) * rng.randrange(4) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: tuple(r)[1:] for r in measured(df).collect()}
    assert all(found[i] == brute(t) for i, t in enumerate(texts))


def test_ledger_keeps_rows_and_ignores_other_columns(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rule_bits": F.lit("x"), "n_words": F.lit(None).cast("int"), "kept": F.lit(1)})
    out = rule_ledger(df).collect()
    assert sorted((r.doc_id or -1, r.n_words) for r in out) == [(-1, 0), (-1, 1), (1, 1), (1, 1)]
    assert rule_ledger(df.limit(0)).count() == 0
    assert all(r.rule_bits & 1 for r in out)


def test_policies_and_ablation(spark):
    texts = ["good words here %d " % i * 3 for i in range(3)] + [" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}###" for i in range(60)), "###"]
    ledger = rule_ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kept = {r.doc_id for r in apply_policy(ledger, STRICT).filter("kept").collect()}
    assert kept == {3}
    assert {r.doc_id for r in apply_policy(ledger, BASE).filter("kept").collect()} == {3, 4}
    symbols = Policy("symbols", 2, ("many_symbols",))
    assert {r.doc_id for r in apply_policy(ledger, symbols).filter("kept").collect()} == {0, 1, 2, 3}
    bits = [r.rule_bits for r in ledger.collect()]
    for r in ablation(ledger, STRICT).collect():
        bit = 1 << [x.name for x in RULES].index(r.rule)
        assert (r.fails, r.fails_alone, r.kept) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), bits.count(0))
        assert r.kept_without == r.kept + r.fails_alone
    assert ablation(ledger.limit(0), STRICT).count() == 0


# Mixing


def quotients(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_apportionment_against_highest_quotients(spark):
    rng = random.Random(2)
    groups = []
    for g in range(40):
        votes = [rng.choice([0.0, 1.0, 3.0, rng.random() * 10, rng.random() * 1000]) for _ in range(rng.randrange(1, 9))]
        groups.append((votes, rng.randrange(0, 60) if sum(votes) else 0))
    rows = [(g, i, v, n, sum(votes), len(votes)) for g, (votes, n) in enumerate(groups) for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, i int, v double, n long, of double, m int").repartition(5)
    found = {(r.g, r.i): r.won for r in apportion(df, ["g"], "i", "v", "of", "m", "n", "won").collect()}
    for g, (votes, n) in enumerate(groups):
        assert [found[g, i] for i in range(len(votes))] == quotients(votes, n)
    votes, n = groups[0][0] + groups[1][0] + [0.0, 5.0, 5.0], 37
    whole = spark.createDataFrame([(i, v, n, sum(votes), 99) for i, v in enumerate(votes)], "i int, v double, n long, of double, m int").repartition(5)
    assert [r.won for r in sorted(apportion(whole, [], "i", "v", "of", "m", "n", "won").collect())] == quotients(votes, n)
    assert apportion(whole.limit(0), [], "i", "v", "of", "m", "n", "won").count() == 0


def test_no_task_gathers_all_sources_or_shards(spark):
    """Many sources: windows are over runs of sorted partitions alone, whose number the partitions bound."""
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('w ', cast(id % 9 as int)) text", "concat('s', id % 1000) source").repartition(6)
    out = mix(docs, shard_docs=2).collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
    want = dealt_anew(sizes)
    assert all(r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9) and r.source_size == sizes[r.source] for r in out)
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 64 * 3 for s, t in want.items())


def dealt_anew(sizes):
    """Targets by giving the excess of capped sources to the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        share = {s: 3 * sizes[s] if s in capped else rest * weight[s] / w for s in names}
        above = {s for s in names if s not in capped and share[s] > 3 * sizes[s]}
        if not above:
            return share
        capped |= above


def test_targets_against_repeated_dealing(spark):
    rng = random.Random(3)
    for _ in range(12):
        sizes = {rng.choice(["a", "b", "é", "Z", "zz", "\U0001F600", "￮", None, "c", "d"]): rng.choice([0, 1, 10, 1000, rng.randrange(10**6)]) for _ in range(8)}
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
        want = dealt_anew(sizes)
        for r in targets(df).collect():
            assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 5, 50, 400]) if i % 50 else None, "en", rng.choice(["hot"] * 8 + ["a", "b", "c", None]), i) for i in range(1500)]
    rows += [(7, "same text", "en", "a", 0)] * 3 + [(None, "no key", "en", None, 0)] * 2
    return spark.createDataFrame(rows, DOCS)


def test_mix_meets_targets_in_many_shards(corpus):
    out = mix(corpus, shard_words=5000, shard_docs=100).collect()
    assert len(out) == 1505 and all(0 <= r.taken <= 3 * r.size for r in out)
    taken, target, n = Counter(), {}, Counter()
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
        n[r.source] += 1
    for s, t in target.items():
        assert abs(taken[s] - t) <= 64 * (1 + n[s] / 100)
    again = mix(corpus.repartition(7), shard_words=5000, shard_docs=100).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_mix_edges(spark, corpus):
    assert mix(corpus.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 0), (2, "", "x", "s", 0)], DOCS)
    assert [(r.size, r.target, r.taken) for r in mix(blank).collect()] == [(0, 0.0, 0)] * 2
    clash = corpus.withColumns({"target": F.lit("x"), "h": F.lit(1), "place": F.lit(2), "size": F.lit(3)})
    assert Counter(map(tuple, mix(clash).collect())) == Counter(map(tuple, mix(corpus).collect()))


def test_copies_are_what_the_mix_takes(corpus):
    out = copies(corpus).collect()
    words = defaultdict(int)
    for r in out:
        words[r.doc_id, r.source] += len(WORD.findall(r.text))
    want = defaultdict(int)
    for r in mix(corpus).collect():
        want[r.doc_id, r.source] += r.taken
    assert dict(words) == {k: v for k, v in want.items() if v}
    assert copies(corpus).columns == corpus.columns and copies(corpus.limit(0)).count() == 0


# Sharding


def claimed(shards, size):
    def h(x):
        return int(hashlib.md5(x.encode()).hexdigest()[:15], 16)

    prefer = [[(h(f"offset:{s}") + k * (h(f"step:{s}") % (size - 1) + 1)) % size for k in range(size)] for s in shards]
    table, turn = [None] * size, 0
    while None in table:
        k = turn % len(shards)
        table[next(x for x in prefer[k] if table[x] is None)] = k
        turn += 1
    return tuple(table)


def test_table_against_brute_force():
    for size, n in ((7, 3), (101, 10), (211, 1), (13, 13)):
        shards = [f"s{k}" for k in range(n)]
        assert lookup_table(shards, size) == claimed(shards, size)


def test_table_is_even_and_stable():
    shards = [f"s{k}" for k in range(20)]
    full, less = lookup_table(shards), lookup_table(shards[:-1])
    counts = Counter(full)
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 19)
    assert moved < 0.1 * len(full)


def test_bad_tables():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 9), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            lookup_table(shards, size)


def test_place(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "doc_id long, slot string").withColumn("shard", F.lit(9))
    out = place(df, "doc_id", ["a", "b"], 101).collect()
    assert len(out) == 3 and len({(r.slot, r.shard) for r in out if r.doc_id == 1}) == 1
    table = lookup_table(["a", "b"], 101)
    assert all(r.shard == "ab"[table[r.slot]] for r in out) and place(df.limit(0), "doc_id", ["a"], 101).count() == 0


def test_whole_rows_are_laid_out_by_shard(spark, tmp_path):
    """Hot, NULL and repeated keys: each row is in its shard's folder once, whole, and a large shard has several files."""
    rng = random.Random(4)
    data = [(7 if k % 2 else None if k % 50 == 0 else k, rng.randbytes(1500).hex(), k) for k in range(4000)]
    df, names = spark.createDataFrame(data, "doc_id long, text string, n long"), ["a", "b", "c"]
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        lay_out(df, "doc_id", names, str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {(r.doc_id, r.text, r.n, r.shard) for r in place(df, "doc_id", names).collect()}
    got = [(r.doc_id, r.text, r.n, r.shard) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(data) and set(got) == want
    hot = next(s for k, _, _, s in want if k == 7)
    assert len(list((tmp_path / "out" / f"shard={hot}").glob("*.parquet"))) > 1
