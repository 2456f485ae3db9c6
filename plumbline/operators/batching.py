"""Training batches: length-sorted windows of a shuffled epoch, and pieces under a token budget."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import attach, hash_positions, materialise, running_totals, with_scalar

WINDOW_BATCHES = 64
BLOCK_LENGTHS = 16384


def windowed_batches(rows: DataFrame, batch: int, length: str, ids: Sequence[str], seed, windows: int = WINDOW_BATCHES) -> DataFrame:
    """(window, batch, place): shuffled rows cut into windows of 64 batches, sorted by length inside; the last partial batch drops.

    The shuffle position is exact and distributed, and a window holds 64 batches, so no task sorts more than that at once.
    """
    placed = hash_positions(rows, (), ids, seed, "_pos").withColumn("window", F.floor(F.col("_pos") / (windows * batch)))
    inside = Window.partitionBy("window").orderBy(length, "_pos")
    ranked = placed.withColumn("_rank", F.row_number().over(inside) - 1 + F.col("window") * (windows * batch))
    total = rows.agg((F.floor(F.count(F.lit(1)) / batch)).alias("_full"))
    out = with_scalar(ranked, total).withColumn("batch", F.floor(F.col("_rank") / batch)).where(F.col("batch") < F.col("_full"))
    return out.withColumn("place", F.col("_rank") % batch).drop("_pos", "_rank", "_full")


def split_by_tokens(batches: DataFrame, by: Sequence[str], place: str, length: str, max_tokens: int, ids: Sequence[str] = ()) -> DataFrame:
    """Consecutive pieces of each batch whose rows times longest row stay under the budget; an oversized row stands alone.

    A batch is a few dozen rows, folded as one array of places, lengths and ids; other columns are joined to the result by id.
    """
    carry = list(ids)
    packed = batches.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(place).cast("bigint").alias("place"), F.col(length).cast("bigint").alias("len"), *carry))).alias("rows"))
    start = F.struct(F.lit(-1).alias("piece"), F.lit(0).alias("count"), F.lit(0).cast("bigint").alias("longest"), F.array().cast("array<int>").alias("pieces"))

    def step(s, r):
        longest = F.greatest(s["longest"], r["len"])
        fits = (s["count"] > 0) & (longest * (s["count"] + 1) <= max_tokens)
        piece = F.when(fits, s["piece"]).otherwise(s["piece"] + 1)
        return F.struct(piece.alias("piece"), F.when(fits, s["count"] + 1).otherwise(F.lit(1)).alias("count"), F.when(fits, longest).otherwise(r["len"]).alias("longest"),
                        F.concat(s["pieces"], F.array(piece)).alias("pieces"))

    pieces = F.aggregate("rows", start, step)["pieces"]
    each = packed.select(*by, "rows", pieces.alias("pieces")).select(*by, F.explode(F.arrays_zip("rows", "pieces")).alias("z"))
    return each.select(*by, F.col("z.rows.place").alias(place), F.col("z.rows.len").alias(length), *[F.col(f"z.rows.{c}").alias(c) for c in carry], F.col("z.pieces").alias("piece"))


def _fold(block: pd.DataFrame, held: np.ndarray, max_tokens: int) -> Iterator[tuple]:
    """Greedy packing of a block's lengths in ascending order, for several numbers of rows in the open batch at once.

    Per length: capacity of a batch, rows held before, rows that still fit, batches begun, rows held after.
    """
    for length, n in zip(block["len"].tolist(), block["n"].tolist(), strict=True):
        cap = max(max_tokens // max(length, 1), 1)
        opened = np.where(held > 0, np.clip(cap - held, 0, n), 0)
        begun = -(-(n - opened) // cap)
        after = np.where(begun > 0, n - opened - (begun - 1) * cap, held + opened)
        yield cap, held, opened, begun, after
        held = after


def _transfer(block: pd.DataFrame, max_tokens: int) -> pd.DataFrame:
    """What a block makes of each number of rows the batch before it may hold: rows held after it and batches begun in it.

    A batch that holds as many rows as the block's first length allows takes none of its rows, so more need not be told apart.
    """
    block = block.sort_values("len")
    most = 0 if block["block"].iloc[0] == 0 else max(max_tokens // max(int(block["len"].iloc[0]), 1), 1)
    after, total = np.arange(most + 1), np.zeros(most + 1, np.int64)
    for _, _, _, begun, after in _fold(block, np.arange(most + 1), max_tokens):
        total = total + begun
    return pd.DataFrame({"block": [int(block["block"].iloc[0])], "after": [after.tolist()], "begun": [total.tolist()]})


def _chain(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state before every block, from the blocks' transfers alone."""
    held, batch, out = 0, -1, []
    for r in blocks.sort_values("block").itertuples():
        out.append((r.block, held, batch))
        at = min(held, len(r.after) - 1)
        held, batch = int(r.after[at]), batch + int(r.begun[at])
    return pd.DataFrame(out, columns=["block", "held", "batch"])


def _planned(block: pd.DataFrame, max_tokens: int) -> pd.DataFrame:
    block = block.sort_values("len")
    batch, out = int(block["batch"].iloc[0]), []
    for length, (cap, held, opened, begun, _) in zip(block["len"].tolist(), _fold(block, np.array([block["held"].iloc[0]]), max_tokens), strict=True):
        out.append((length, batch, int(opened[0]), cap, int(held[0])))
        batch += int(begun[0])
    return pd.DataFrame(out, columns=["len", "batch", "open", "cap", "before"])


def packing_plan(counts: DataFrame, max_tokens: int, block: int = BLOCK_LENGTHS) -> DataFrame:
    """(len, batch, open, cap, before): how the rows of each length are packed; counts has one row (len, n) per distinct length.

    The greedy state in front of a length is the number of rows in the open batch. Lengths are cut into blocks of `block`
    neighbours; a block turns every state it may meet into the state behind it (few, as its first length bounds a batch), the
    blocks' transfers are chained, and every block is then packed from its own state. A task holds one block; the chain reads
    one row per block.
    """
    ranked = running_totals(counts.withColumn("_one", F.lit(1).cast("bigint")), (), "len", {"_rank": "_one"})
    cut = materialise(ranked.select("len", "n", F.floor((F.col("_rank") - 1) / block).cast("bigint").alias("block")), "lengths")
    moves = cut.groupBy("block").applyInPandas(lambda b: _transfer(b, max_tokens), "block bigint, after array<bigint>, begun array<bigint>")
    states = moves.groupBy(F.lit(0).alias("all")).applyInPandas(_chain, "block bigint, held bigint, batch bigint")
    known = attach(cut, states, ["block"], spread=["len"])
    return known.groupBy("block").applyInPandas(lambda b: _planned(b, max_tokens), "len bigint, batch bigint, open bigint, cap bigint, before bigint")


def token_batches(rows: DataFrame, length: str, ids: Sequence[str], max_tokens: int, block: int = BLOCK_LENGTHS) -> DataFrame:
    """Length-bucketed batches under a padded-size budget: rows in (length, hash) order, packed greedily in one pass.

    Rows of one length are interchangeable, so packing is decided over the table of lengths and counts: a length first fills the
    open batch as far as its rows fit, the others form batches of floor(budget / length) rows, one at least. A row finds its
    batch by its place within its length. Rows without length are left out.
    """
    rows = rows.where(F.col(length).isNotNull())
    counts = rows.groupBy(F.col(length).cast("bigint").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    plan = packing_plan(counts, max_tokens, block).withColumnRenamed("len", length)
    placed = attach(hash_positions(rows, [length], ids, "tokens", "_in").withColumn(length, F.col(length).cast("bigint")), plan, [length], spread=ids)
    inside, late = F.col("_in") < F.col("open"), F.col("_in") - F.col("open")
    out = placed.withColumn("_batch", F.when(inside, F.col("batch")).otherwise(F.col("batch") + 1 + F.floor(late / F.col("cap"))).cast("bigint"))
    out = out.withColumn("place", F.when(inside, F.col("before") + F.col("_in")).otherwise(late % F.col("cap")).cast("bigint"))
    return out.select(*rows.columns, F.col("_batch").alias("batch"), "place")
