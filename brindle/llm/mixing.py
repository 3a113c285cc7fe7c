"""Mixing sources to target weights by apportionment of equal blocks of words (native).

1. Targets: each source weighs 5, 2, 1 in turn; together they share all words, and none gets more than
   ``max_repeats`` times its own size.
2. Blocks of ``block_words`` words go to the sources by highest quotients target / (2k + 1) (Sainte-Laguë).
3. A source's blocks go to its shards in the same way, by the shards' words: integer quotas per shard. A
   source has as many shards as its size asks for, so a hot one is spread over many tasks.
4. In each shard, documents follow one another in a seeded order and are cut into blocks; the quota takes
   blocks in that order, going round again up to ``max_repeats`` times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import stored, words
from brindle.operators.sorting import ranked

#: Up to so many sources, the table of sources is broadcast; beyond, Spark joins it as it sees fit.
BROADCAST_SOURCES = 2000


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """Adds ``place``, ``weight``, ``target`` and ``total`` to one row per source (columns source, source_size, n_docs).

    All sources share the total by weight; those whose share exceeds their cap get the cap, and the rest is shared
    anew until no share is above. Each round is one aggregate of the whole table to one row.
    """
    placed = ranked(sources, [], [F.col("source").isNull(), F.col("source")], "place")
    w = F.element_at(F.array(*map(F.lit, weights)), F.expr(f"cast((place - 1) % {len(weights)} as int) + 1")).cast("long")
    t = stored(placed.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_repeats), "placed")
    fill, zero, share = F.col("cap") / F.col("weight"), F.lit(0).cast("long"), None
    while True:
        capped = F.lit(False) if share is None else fill <= F.lit(share)
        caps, shared_by = F.sum(F.when(capped, F.col("cap")).otherwise(zero)), F.sum(F.when(capped, zero).otherwise(F.col("weight")))
        total, caps, shared_by = t.agg(F.sum("source_size"), caps, shared_by).first()
        if not total or not shared_by or share == (total - caps) / shared_by:
            break
        share = (total - caps) / shared_by
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.lit(share) * F.col("weight")) if total else F.lit(0.0)
    return t.select("source", "source_size", "n_docs", "place", "weight", F.lit(total or 0).cast("long").alias("total"), target.alias("target"))


def apportion(votes: DataFrame, group: Sequence[str], order: str, vote: str, of: str, parties: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: the seats of each row by highest quotients ``vote`` / (2k + 1), ties to the lower ``order``.

    Rows of a ``group`` share the values of three columns: ``of``, the sum of their votes, ``parties``, a number of rows
    that is not below theirs, and ``seats``, how many there are to deal. Dealing with a divisor that gives too few seats
    and with one that gives too many brackets each row's seats, so only the last few quotients are ranked: about
    four rows for each input row, however many seats there are, and by many tasks also within a group.
    """
    n, v, half = F.col(seats).cast("double"), F.col(vote).cast("double"), F.col(parties) / 2
    share = F.when(F.col(of) > 0, v / F.col(of)).otherwise(0.0)
    base = votes.withColumn("_lo", F.greatest(F.lit(0), F.floor(share * (n - half) + 0.5) - 1).cast("long"))
    base = stored(base.withColumn("_hi", (F.floor(share * (n + half) + 0.5) + 1).cast("long")), "votes")
    if group:
        dealt = stored(base.groupBy(*(F.col(g).alias(f"_{g}") for g in group)).agg(F.sum("_lo").alias("_dealt")), "dealt")
        open_ = base.join(dealt, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
    else:
        open_ = base.withColumn("_dealt", F.lit(base.agg(F.sum("_lo")).first()[0]).cast("long"))
    open_ = open_.withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).select(*votes.columns, "_lo", "_dealt", "_k")
    by_quotient = ranked(open_, group, [(v / (2 * F.col("_k") + 1)).desc(), F.col(order)], "_rank")
    won = F.sum(F.when((F.col("_rank") <= F.col(seats) - F.col("_dealt")) & (v > 0), 1).otherwise(0))
    return by_quotient.groupBy(*votes.columns, "_lo").agg(won.alias("_won")).select(*votes.columns, (F.col("_lo") + F.col("_won")).cast("long").alias(out))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    max_repeats: int = 3,
    block_words: int = 64,
    shard_words: int = 1 << 20,
    shard_docs: int = 4096,
    seed: int = 42,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, and the columns to ``carry``.

    size: words of the text (null: 0). taken: words the mix takes, repeats counted, at most ``max_repeats``
    times size; 0 for a text without words. Null sources are one source, the last. Repeated rows are documents
    of their own; equal rows may swap what they take. An empty table gives an empty result.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    sized = stored(
        docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), order.alias("h"), *(F.col(c).alias(f"_{c}") for c in carry)), "sized"
    )
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, max_repeats)
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_docs") / shard_docs)).cast("long")
    blocks = F.when(F.col("total") > 0, F.greatest(F.lit(1), F.round(F.col("total") / block_words))).otherwise(0).cast("long")
    sources = stored(sources.withColumn("n_shards", n_shards).withColumn("blocks", blocks), "targets")
    n_sources, all_targets = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    sources = sources.withColumn("parties", F.lit(n_sources)).withColumn("all_targets", F.lit(all_targets))
    sources = stored(apportion(sources, [], "place", "target", "all_targets", "parties", "blocks", "quota"), "sources")
    few = n_sources <= BROADCAST_SOURCES
    of = sources.select(F.col("source").alias("_source"), "place", "n_shards", "source_size", "target", "quota")
    placed = sized.join(F.broadcast(of) if few else of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("shard", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.col("n_shards")))

    shards = placed.groupBy("place", "shard", "quota", "source_size", "n_shards").agg(F.sum("size").alias("words"))
    shards = apportion(shards, ["place"], "shard", "words", "source_size", "n_shards", "quota", "blocks")
    shards = stored(shards, "shards").select(
        F.col("place").alias("_place"), F.col("shard").alias("_shard"), "words", F.least(F.col("blocks") * block_words, F.col("words") * max_repeats).alias("take")
    )
    run = Window.partitionBy("place", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = placed.withColumn("start", F.sum("size").over(run) - F.col("size"))
    got = at.join(shards, (F.col("place") == F.col("_place")) & (F.col("shard") == F.col("_shard")), "left")
    part = F.least(F.greatest(F.expr("take % words") - F.col("start"), F.lit(0)), F.col("size"))
    taken = F.when(F.col("words") > 0, F.expr("take div words") * F.col("size") + part).otherwise(0).cast("long")
    return got.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *(F.col(f"_{c}").alias(c) for c in carry))


def copies(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each time a document is taken whole.

    Where a block ends inside a document, its words up to there follow as one more row, joined by single spaces, with
    ``n_chars`` (where there is such a column) their length. What the mix does not take goes. ``options`` are mix()'s.
    """
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "to-mix")
    taken = mix(rows, text=text, carry=["_row"], **options).where("taken > 0").select(F.col("_row").alias("_of"), "size", "taken")
    whole, part = F.expr("taken div size"), F.expr("cast(taken % size as int)")
    lengths = F.concat(F.array_repeat(F.lit(0), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    each = rows.join(taken.select("_of", F.explode(lengths).alias("_words")), F.col("_row") == F.col("_of"))
    cut = F.when(F.col("_words") > 0, F.array_join(F.slice(words(F.col(text)), F.lit(1), F.col("_words")), " ")).otherwise(F.col(text))
    kept = each.withColumn(text, cut)
    if n_chars in docs.columns:
        length = F.length(text).cast(docs.schema[n_chars].dataType)
        kept = kept.withColumn(n_chars, F.when(F.col("_words") > 0, length).otherwise(F.col(n_chars)))
    return kept.select(*docs.columns)
