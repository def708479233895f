"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free_stem, materialise, read_table, text_of

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_REPEAT = 2
BLOCK_TOKENS = 16
#: Tokens of a shard, in which documents are laid end to end and cut into blocks; bounds what one task sorts.
SHARD_TOKENS = 1 << 18
#: Shards whose quotas are ranked together.
SHARDS_A_GROUP = 1024
SEED = 20_240
#: Primes above any count of blocks in a shard, hence coprime to it: i * prime mod n permutes 0..n-1.
PRIMES = (1_000_000_007, 1_000_000_009, 1_000_000_021, 1_000_000_033, 1_000_000_087, 1_000_000_093, 1_000_000_097, 1_000_000_103)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> the same with ``weight`` and ``target``.

    Weights go to the sources in code point order, null last, and repeat. Targets share ``budget`` times all sizes by
    weight; one that would pass ``max_repeat`` times its source's size stops there, and the excess is shared again.
    Sorted by the level at which each stops, that is a running sum: no loop. One row per source is all that is ranked.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    s = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("stop", F.col("source_size").cast("double") * max_repeat)
        .withColumn("level", F.col("stop") / F.col("weight"))
        .withColumn("budget", F.sum(F.col("source_size").cast("double")).over(everyone) * budget)
        .withColumn("before", F.coalesce(F.sum("stop").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("stopped", F.col("level") * F.col("open_weight") <= F.col("budget") - F.col("before"))
        .withColumn("spent", F.coalesce(F.sum(F.when(F.col("stopped"), F.col("stop"))).over(everyone), F.lit(0.0)))
        .withColumn("rest_weight", F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(everyone))
    )
    target = F.when(F.col("stopped"), F.col("stop")).otherwise((F.col("budget") - F.col("spent")) * F.col("weight") / F.col("rest_weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, within: list[str], names: list[str], votes: str, seats: str) -> DataFrame:
    """Seats by highest quotients votes/1, votes/3, votes/5, ... among the parties of each ``within``.

    ``seats`` is the same in all rows of a ``within``. Returns ``parties`` with ``quota``. The final divisor lies between
    all / (seats + n / 2) and all / (seats - n / 2) for n parties, so only the seats that those two leave open, about
    two a party, are ranked; the others are certain.
    """
    group = Window.partitionBy(*within)
    p = (
        parties.withColumn("_all", F.sum(F.col(votes).cast("double")).over(group))
        .withColumn("_half", F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(group) / 2)
        .withColumn("_low", F.greatest(F.lit(0), F.floor(F.col(votes) * F.greatest(F.col(seats) - F.col("_half"), F.lit(0.0)) / F.greatest("_all", F.lit(1e-300)) + 0.5) - 1).cast("long"))
        .withColumn("_high", F.floor(F.col(votes) * (F.col(seats) + F.col("_half")) / F.greatest("_all", F.lit(1e-300)) + 0.5).cast("long") + 1)
        .withColumn("_sure", F.sum("_low").over(group))
    )
    p = p.withColumn("_seat", F.when(F.col(votes) > 0, F.sequence(F.col("_low"), F.col("_high"))).otherwise(F.array(F.lit(0).cast("long"))))
    open_seats = p.withColumn("_seat", F.explode("_seat"))
    # The row at _low stands for the sure seats and is always there; those after it are ranked.
    quotient = F.when(F.col("_seat") > F.col("_low"), F.col(votes) / (2 * F.col("_seat") - 1))
    rank = Window.partitionBy(*within).orderBy(F.col("_quotient").desc_nulls_last(), *[F.col(n).asc_nulls_last() for n in names], "_seat")
    won = open_seats.withColumn("_quotient", quotient).withColumn("_rank", F.row_number().over(rank))
    won = won.withColumn("_won", (F.col("_quotient").isNotNull() & (F.col("_rank") <= F.col(seats) - F.col("_sure"))).cast("long"))
    keys = [c for c in parties.columns]
    return won.groupBy(*keys).agg((F.max("_low") + F.sum("_won")).alias("quota"))


def fingerprint(text_col: str) -> Column:
    return F.xxhash64(text_of(text_col))


#: Copies of a row that one task numbers.
COPIES = 4096


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``copy``, a number from 0 among rows that are alike in every column.

    Alike rows are counted, and the counts written out again in parts, so that they need not meet in one task.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    parts = counted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {COPIES}"))))
    parts = parts.repartition(*[c for c in rows.columns], "_part")
    last = F.least(F.col("_n"), (F.col("_part") + 1) * COPIES) - 1
    return parts.select(*rows.columns, F.explode(F.sequence(F.col("_part") * COPIES, last)).alias("copy"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Apportion blocks of ``block_tokens`` words to sources, to groups of shards and to shards, then select blocks.

    Each source's documents are dealt by a seeded hash into shards of about ``shard_tokens`` words, however large the
    source, laid end to end in seeded order, and cut into blocks. A shard's quota of blocks gives every block its whole
    rounds and a seeded selection one more. Returns per input row ``id_col, source, size, source_size, target, taken``
    and ``text_hash, shard, first, n_blocks, rounds, extra, prime, shift``: block i of the shard is taken ``rounds + ((i * prime + shift)
    mod n_blocks < extra)`` times, and the document holds its shard's words from ``first`` on.

    A source's taken words differ from its target by half a block for its quota, and by up to a block less one word a
    round for each of its shards, whose last block may be short; of sources smaller than a block, by half their size.

    Null text and text without words have size 0 and are taken 0 times. Null is a source of its own, ordered last; the
    empty string another. A source without words has target 0. Rows are dealt by id, text and, where both are equal, a
    number, so neither a null id nor a repeated row fills a shard, however many rows have it; each is taken like any
    row. A text of any length is one row of a shard, which may so be longer. An empty table gives an empty result. Reruns agree in every row, or for
    repeated rows in the rows as a set.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_of(text_col)).alias("size"), fingerprint(text_col).alias("text_hash"))
    sized = materialise(numbered(sized), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, budget, max_repeat)
    # Targets in blocks: a source of less than a block's words has one block, of its own size.
    blocks = F.col("target") * F.ceil(F.col("source_size") / block_tokens) / F.greatest(F.col("source_size"), F.lit(1))
    targets = targets.withColumn("one", F.lit(1)).withColumn("votes", blocks)
    targets = targets.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy())).cast("long"))
    targets = sainte_lague(targets, ["one"], ["source"], "votes", "seats")
    targets = materialise(targets.select("source", "source_size", "target", F.col("quota").alias("source_quota")), "mix-targets")

    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long")
    t = targets.withColumnRenamed("source", "_source")
    placed = sized.join(t, sized["source"].eqNullSafe(t["_source"])).drop("_source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id", "text_hash", "copy"), n_shards))
    placed = placed.withColumn("shard_group", F.floor(F.col("shard") / SHARDS_A_GROUP))
    shards = placed.groupBy("source", "source_quota", "shard_group", "shard").agg(F.sum("size").alias("shard_size"))
    groups = shards.groupBy("source", "source_quota", "shard_group").agg(F.sum("shard_size").alias("group_size"))
    groups = sainte_lague(groups, ["source", "source_quota"], ["shard_group"], "group_size", "source_quota")
    g = groups.select(F.col("source").alias("_source"), F.col("shard_group").alias("_group"), F.col("quota").alias("group_quota"))
    shards = shards.join(g, shards["source"].eqNullSafe(g["_source"]) & (shards["shard_group"] == g["_group"])).drop("_source", "_group")
    shards = sainte_lague(shards, ["source", "shard_group", "group_quota"], ["shard"], "shard_size", "group_quota")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_tokens)).cast("long")
    key = F.xxhash64(F.lit(seed), F.col("source"), F.col("shard"))
    shards = shards.withColumn("n_blocks", blocks).withColumn("quota", F.least(F.col("quota"), F.col("n_blocks") * max_repeat))
    shards = shards.select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "n_blocks",
        F.floor(F.col("quota") / F.col("n_blocks")).cast("long").alias("rounds"), F.pmod(F.col("quota"), F.col("n_blocks")).alias("extra"),
        F.element_at(F.array(*[F.lit(x).cast("long") for x in PRIMES]), (F.pmod(key, F.lit(len(PRIMES))) + 1).cast("int")).alias("prime"),
        F.pmod(F.shiftright(key, 8), F.col("n_blocks")).alias("shift"),
    )
    shards = materialise(shards, "mix-shards")
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id", "text_hash", "copy"), "id", "size", "text_hash", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("first", F.sum("size").over(line) - F.col("size"))
    laid = laid.join(shards, laid["source"].eqNullSafe(shards["_source"]) & (laid["shard"] == shards["_shard"]))
    b = str(block_tokens)
    taken = F.expr(
        f"""CASE WHEN size = 0 THEN 0L ELSE aggregate(sequence(first DIV {b}, (first + size - 1) DIV {b}), 0L, (acc, i) -> acc +
        (least(first + size, (i + 1) * {b}) - greatest(first, i * {b})) * (rounds + CASE WHEN pmod(i * prime + shift, n_blocks) < extra THEN 1 ELSE 0 END)) END"""
    )
    return laid.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "text_hash", "shard", "first", "n_blocks", "rounds", "extra", "prime", "shift")


def mixed_documents(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, max_repeat: int = MAX_REPEAT, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: a row for each round in which some of a document's blocks are taken, with those blocks' words.

    A round that takes all blocks has the text as it was; otherwise the words keep the white space after them. All
    columns of ``docs`` stay, whatever their names; ``n_chars``, if there, is counted anew. A document of which nothing is
    taken is not there, nor one without words. Rows that repeat an id, a source and a text are all taken as the last of
    them is. Null ids and sources meet each other. An empty table gives an empty mix.
    """
    source_col, m = options.get("source_col", "source"), free_stem(docs.columns, "_mix")
    plan = mix(docs, block_tokens=block_tokens, max_repeat=max_repeat, id_col=id_col, text_col=text_col, **options)
    names = ("first", "n_blocks", "rounds", "extra", "prime", "shift")
    plan = plan.filter("taken > 0").groupBy(F.col(id_col).alias(f"{m}_id"), F.col("source").alias(f"{m}_source"), F.col("text_hash").alias(f"{m}_text")).agg(F.max(F.struct(*names)).alias("last"))
    plan = plan.select(f"{m}_id", f"{m}_source", f"{m}_text", *[F.col(f"last.{c}").alias(f"{m}_{c}") for c in names])
    d = docs.withColumn(f"{m}_hash", fingerprint(text_col))
    j = d.join(plan, d[id_col].eqNullSafe(plan[f"{m}_id"]) & d[source_col].cast("string").eqNullSafe(plan[f"{m}_source"]) & (d[f"{m}_hash"] == plan[f"{m}_text"]))
    j = j.withColumn(f"{m}_round", F.explode(F.sequence(F.lit(1), F.lit(max_repeat))))
    times = f"({m}_rounds + CASE WHEN pmod((({m}_first + i) DIV {block_tokens}) * {m}_prime + {m}_shift, {m}_n_blocks) < {m}_extra THEN 1 ELSE 0 END)"
    whole = (F.col(f"{m}_rounds") >= F.col(f"{m}_round")) | ((F.col(f"{m}_rounds") + 1 == F.col(f"{m}_round")) & (F.col(f"{m}_extra") == F.col(f"{m}_n_blocks")))
    part = F.expr(f"array_join(filter(regexp_extract_all(`{text_col}`, '[^\\\\x20\\\\x09-\\\\x0D]+[\\\\x20\\\\x09-\\\\x0D]*', 0), (w, i) -> {times} >= {m}_round), '')")
    j = j.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(part)).filter(F.length(text_col) > 0)
    if "n_chars" in docs.columns:
        j = j.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return j.select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
