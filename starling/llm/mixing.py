"""Temperature mixing of sources, in DataFrame operations only.

A source with token share p gets weight p**a / sum(p**a). The exponent a is
found by bisection: the largest that reaches a target entropy, raised as far as
a repetition limit asks. Weights times the token budget give each source's
budget, realised as whole epochs over all its blocks and one last epoch over a
permutation of them, cut where the budget ends.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starling.llm.common import measured
from starling.session import cut_lineage

TARGET_ENTROPY = 0.95
MAX_REPEATS = 4.0
# Tokens in a block of documents; larger sources have at most MAX_BLOCKS, larger blocks.
BLOCK_TOKENS = 100_000
MAX_BLOCKS = 100_000
SEED = "mix"
# Halvings of the bracket that one pass over the sources settles.
HALVINGS = 5
PASSES = 8
WORD = r"[^\x20\x09-\x0D]+"


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def source_table(stats: DataFrame) -> DataFrame:
    """``(source, n_tokens, p, n_blocks)`` of the sources that have tokens; a null source is a source of its own."""
    totals = stats.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens")).where(F.col("n_tokens") > 0)
    share = F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy())
    blocks = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.floor(F.col("n_tokens") / BLOCK_TOKENS)))
    return totals.select("source", "n_tokens", share.alias("p"), blocks.cast("long").alias("n_blocks"))


def _section(sources: DataFrame, low: float, high: float) -> list:
    """Entropy and largest weight-to-share ratio at the inner points of a bracket."""
    points = [low + (high - low) * i / 2**HALVINGS for i in range(1, 2**HALVINGS)]
    grid = sources.select("p", F.posexplode(F.array(*(F.lit(a) for a in points))).alias("i", "a"))
    power = F.pow("p", "a")
    sums = grid.groupBy("i", "a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("s"), F.max(power / F.col("p")).alias("r"))
    return sums.select("a", (F.log("z") - F.col("a") * F.col("s") / F.col("z")).alias("entropy"), (F.col("r") / F.col("z")).alias("ratio")).orderBy("i").collect()


def _bisect(sources: DataFrame, left_holds) -> float:
    """Where in 0..1 ``left_holds`` turns from true to false."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        rows = _section(sources, low, high)
        held = [r["a"] for r in rows if left_holds(r)]
        failed = [r["a"] for r in rows if not left_holds(r)]
        low, high = max([low, *held]), min([high, *failed])
    return (low + high) / 2


def exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget_share: float = 1.0) -> float:
    """The mixing exponent, from 0 (uniform) to 1 (proportional), rounded to 6 digits.

    Entropy falls with the exponent and so does the number of times the scarcest
    source is repeated. ``target_entropy`` is a share of the largest possible
    entropy. A repetition limit that even proportional weights exceed gives 1.
    """
    edge = sources.agg(F.count("*").alias("k"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.min("p").alias("p")).first()
    if edge["k"] < 2:
        return 1.0
    ceiling = log(edge["k"])
    target = target_entropy * ceiling
    by_entropy = 1.0 if edge["entropy"] >= target else 0.0 if target >= ceiling else _bisect(sources, lambda r: r["entropy"] >= target)
    if budget_share > max_repeats:
        return 1.0
    spread = budget_share / (edge["p"] * edge["k"])
    by_repeats = 0.0 if spread <= max_repeats else _bisect(sources, lambda r: r["ratio"] * budget_share > max_repeats)
    return round(max(by_entropy, by_repeats), 6)


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget_tokens: int | None = None,
) -> DataFrame:
    """``docs``, a row for each epoch it is drawn in, with ``mix_epoch``, ``mix_block`` and ``mix_rank`` added.

    Tokens are words between ASCII white space. ``mix_rank`` is the place of the
    row's block in the epoch's permutation of its source's blocks. The budget,
    by default all tokens, is never exceeded by a source; what is left of it is
    less than the next document of the block in which it ends. Null and empty
    texts have no tokens and go with their block; a source without any tokens is
    drawn in no epoch. A null source is a source of its own. Rows with equal id
    and token count are drawn together. All columns of ``docs`` are kept but
    those that begin with ``mix_``, which are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    digest = _digest(F.lit(SEED), F.col(id_col))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    stats = cut_lineage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), tokens.alias("n_tokens"), digest.alias("digest"), place.alias("place")))
    sources = cut_lineage(source_table(stats))
    total = sources.agg(F.sum("n_tokens"), F.count("*"), F.sum(F.length("source"))).first()
    all_tokens = total[0] or 0
    budget = all_tokens if budget_tokens is None else budget_tokens
    a = exponent(sources, target_entropy, max_repeats, budget / all_tokens if all_tokens else 1.0)
    raw = F.pow("p", F.lit(a))
    plan = sources.withColumn("weight", F.round(raw / F.sum(raw).over(Window.partitionBy()), 9))
    plan = plan.withColumn("budget", F.floor(F.col("weight") * F.lit(float(budget))).cast("long"))
    plan = cut_lineage(plan.withColumn("epochs", F.floor(F.col("budget") / F.col("n_tokens")).cast("long")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("n_tokens")))
    plan_bytes = 96 * total[1] + 4 * (total[2] or 0)

    small = measured(plan.select(F.col("source").alias("mix_source"), "n_blocks", "epochs", "rest"), plan_bytes)
    placed = stats.join(small, F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("block", F.col("place") % F.col("n_blocks"))
    sizes = placed.groupBy("source", "block", "epochs", "rest").agg(F.sum("n_tokens").alias("tokens"))
    epochs = F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs") + F.when(F.col("rest") > 0, 1).otherwise(0)))
    turns = sizes.where((F.col("epochs") > 0) | (F.col("rest") > 0)).select("*", epochs.alias("epoch"))
    order = Window.partitionBy("source", "epoch").orderBy(_digest(F.lit(SEED), F.col("epoch"), F.col("source"), F.col("block")), "block")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.select("*", F.row_number().over(order).cast("int").alias("rank"), before.alias("before"))
    last = F.col("epoch") > F.col("epochs")
    whole = ~last | (F.col("before") + F.col("tokens") <= F.col("rest"))
    turns = turns.where(whole | (F.col("before") < F.col("rest"))).select("source", "block", "epoch", "rank", (~whole).alias("cut"), (F.col("rest") - F.col("before")).alias("room"))
    turns = cut_lineage(turns)

    cuts = turns.where("cut").select(F.col("source").alias("mix_cut_source"), F.col("block").alias("mix_cut_block"), "room")
    n_cuts = cuts.count()
    split = placed.join(measured(cuts, 96 * n_cuts + 4 * (total[2] or 0)), F.col("source").eqNullSafe(F.col("mix_cut_source")) & (F.col("block") == F.col("mix_cut_block")))
    grouped = split.groupBy("source", "room", "digest", "id", "n_tokens").agg(F.sum("n_tokens").alias("tokens"))
    running = Window.partitionBy("source").orderBy("digest", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    drawn = cut_lineage(grouped.withColumn("upto", F.sum("tokens").over(running)).where(F.col("upto") <= F.col("room")).select(F.col("id").alias("mix_cut_id"), F.col("source").alias("mix_cut_source"), F.col("n_tokens").alias("mix_cut_tokens")))

    draws = turns.groupBy(F.col("source").alias("mix_source"), F.col("block").alias("mix_block")).agg(F.collect_list(F.struct("epoch", "rank", "cut")).alias("mix_turns"))
    draws = draws.join(plan.select(F.col("source").alias("s"), "n_blocks"), F.col("mix_source").eqNullSafe(F.col("s"))).drop("s")
    draws = cut_lineage(draws)
    size = draws.agg(F.sum(96 + 32 * F.size("mix_turns"))).first()[0]
    n_blocks = measured(plan.select(F.col("source").alias("mix_s"), F.col("n_blocks").alias("mix_n")), plan_bytes)
    rows = docs.withColumns({"mix_tokens": tokens, "mix_place": place}).join(n_blocks, F.col(source_col).eqNullSafe(F.col("mix_s")))
    rows = rows.withColumn("mix_at", F.col("mix_place") % F.col("mix_n"))
    rows = rows.join(measured(draws.drop("n_blocks"), size), F.col(source_col).eqNullSafe(F.col("mix_source")) & (F.col("mix_at") == F.col("mix_block")))
    rows = rows.select(*(rows[c] for c in docs.columns), "mix_tokens", "mix_block", F.explode("mix_turns").alias("mix_turn"))
    same = F.col(id_col).eqNullSafe(F.col("mix_cut_id")) & F.col(source_col).eqNullSafe(F.col("mix_cut_source")) & (F.col("mix_tokens") == F.col("mix_cut_tokens"))
    rows = rows.join(measured(drawn, 64 * drawn.count() + 64), same, "left").where(~F.col("mix_turn.cut") | F.col("mix_cut_tokens").isNotNull())
    return rows.select(*(rows[c] for c in docs.columns), F.col("mix_tokens"), F.col("mix_turn.epoch").cast("int").alias("mix_epoch"), F.col("mix_block").cast("int").alias("mix_block"), F.col("mix_turn.rank").alias("mix_rank"))
