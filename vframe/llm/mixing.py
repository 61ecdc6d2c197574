"""Mixing sources to target weights with a splitting tree.

Each source's documents are dealt to blocks by a keyed hash, whole, so that a
block holds ``block_words`` words or so. A source gives its blocks in passes,
each in an order of its own: whole passes and then the first blocks of one
more, up to its target; the last block is cut there. How many blocks each
source gives, its quota, is so exact, and a binary tree deals these quotas to
the output shards, drawing at each node from the multivariate hypergeometric
distribution how many blocks of each source go left. A shard then takes its
own range of each source's permuted blocks: no draw is in two shards and none
is left over. Rows of a shard are ordered by a keyed hash.

Of the block that is cut, documents are taken in the order of their hash up to
the place nearest to the target, and then one more changes sides if that comes
nearer; documents that are equal in hash and text go together.

Defined cases: a null source is a source of its own, last in order; a null or
blank text has size 0 and is never taken; rows with the same id are separate
documents; an empty table gives an empty mix; further columns are kept, save
those named like the operator's own, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vframe.llm.common import Scratch, parts

#: Blocks of all sources together; above it, blocks hold more words than asked for.
MAX_BLOCKS = 1 << 16
#: Rows, of about 100 bytes, that a table of sources or blocks may have to be broadcast.
BROADCAST_ROWS = 200_000
WORD = r"[^\x20\x09-\x0D]+"
OWN = ("size", "source_size", "target", "copies", "taken", "shards", "_key", "_block", "_blocks", "_s", "_b", "_draws", "_cut", "_upto", "_swap")


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def in_order(sources) -> list[str | None]:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, (s or "").encode("utf-32-be")))


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words wanted of each source.

    Sources in code-point order, null last, have the weights in turn. No
    target is above ``cap`` times the source; what that leaves over goes to
    the others by weight until none is above.
    """
    names = in_order(sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    room, open_, found = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if room * weight[s] / total > cap * sizes[s]]
        if not over:
            found |= {s: room * weight[s] / total for s in open_}
            break
        for s in over:
            found[s] = cap * sizes[s]
        room -= sum(found[s] for s in over)
        open_ = [s for s in open_ if s not in found]
    return found


def deal(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard, by the splitting tree: shards x sources."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(low: int, high: int, left: np.ndarray) -> None:
        if high - low == 1:
            out[low] = left
            return
        mid, total = (low + high) // 2, int(left.sum())
        n = total * (mid - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        taken = rng.multivariate_hypergeometric(left, n, method="marginals") if total else left
        split(low, mid, taken)
        split(mid, high, left - taken)

    split(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


@dataclass
class Schedule:
    """What a source gives."""

    passes: list[np.ndarray]  #: the blocks of each pass, in order
    cut: tuple[int, float] | None  #: the last block, if it is cut, and the words to take of it

    @property
    def quota(self) -> int:
        return sum(map(len, self.passes))


def schedule(words: np.ndarray, target: float, seed: Sequence[int]) -> Schedule:
    """Draws blocks that hold so many ``words`` each, pass after pass, up to ``target``."""
    passes, left, cut = [], float(target), None
    while left >= 0.5 and (total := int(words.sum())):
        order = np.random.default_rng([*seed, len(passes)]).permutation(len(words))
        held = np.cumsum(words[order])
        if total <= left:
            passes.append(order)
            left -= total
            continue
        last = int(np.searchsorted(held, left))  # the first block that reaches what is left
        passes.append(order[: last + 1])
        if held[last] > left:
            cut = (int(order[last]), left - float(held[last] - words[order[last]]))
        break
    return Schedule(passes, cut)


def shards_of(schedules: Sequence[Schedule], shards: int, seed: int) -> list[np.ndarray]:
    """The shard of each draw of each source, in the order of its passes."""
    ends = np.cumsum(deal(np.array([s.quota for s in schedules], dtype=np.int64), shards, seed), axis=0)
    return [np.searchsorted(ends[:, k], np.arange(s.quota), side="right") for k, s in enumerate(schedules)]


def _boundary(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a source's block that is cut: the last hash that is taken, and the hash that changes sides."""
    each = rows.groupby("_key", sort=True)["size"].sum()
    key, size, room = each.index.to_numpy(), each.to_numpy(), float(rows["_room"].iloc[0])
    held = np.concatenate(([0], np.cumsum(size)))
    upto = int(np.abs(held - room).argmin())
    miss = room - held[upto]
    other = np.arange(upto, len(key)) if miss > 0 else np.arange(upto)
    off = np.abs(abs(miss) - size[other])
    swap = int(other[off.argmin()]) if len(other) and off.min() < abs(miss) else None
    return pd.DataFrame({"source": rows["source"].iloc[:1], "upto": [key[upto - 1] if upto else None], "swap": [None if swap is None else key[swap]]}).astype({"upto": "Int64", "swap": "Int64"})


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    shards: int = 16,
    block_words: int = 1 << 16,
    seed: int = 17,
    size: str | None = None,
    key: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target,
    copies, taken and shards, the output shard of each copy.

    ``size`` and ``key`` name columns that hold the words of a document and a
    hash that tells documents apart, if they are stored already; without them,
    both come from the text and are written once.

    A document is taken whole, so a source's words miss its target by half a
    document at most. Through the driver go a row for each source and for each
    block, of which there are ``MAX_BLOCKS`` besides one for each source at
    most, whatever the table's size.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    kept = [c for c in docs.columns if c not in OWN]
    words = F.coalesce(F.col(size).cast("bigint"), F.lit(0)) if size else word_count(F.col("text"))
    tie = F.xxhash64(F.lit(seed), *([key] if key else ["doc_id", "text"]))
    rows = docs.select(*(c for c in kept if c != "source"), F.col("source").cast("string").alias("source"), words.alias("size"), tie.alias("_key"))
    sized = rows.select("source", "size", "_key")
    sized = sized if size and key else scratch.table(sized, "sized")

    def small(rows: list[tuple], schema: str) -> DataFrame:
        """A table of the driver's; broadcast if it is as small as mixtures are."""
        df = spark.createDataFrame(rows, schema)
        return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df

    def in_blocks(docs: DataFrame) -> DataFrame:
        of = F.col("source").eqNullSafe(F.col("_s"))
        return docs.join(by, of).withColumn("_block", F.pmod(F.xxhash64("_key", F.lit("block")), F.col("_blocks")).cast("int"))

    sizes = {s: int(n) for s, n in sized.groupBy("source").agg(F.sum("size")).collect()}
    goal = targets(sizes, weights, share, cap)
    each = max(block_words, -(-sum(sizes.values()) // MAX_BLOCKS))
    names = in_order(goal)
    blocks = {s: max(1, -(-sizes[s] // each)) for s in names}
    by = small([(s, sizes[s], float(goal[s]), blocks[s]) for s in names], "_s string, source_size bigint, target double, _blocks bigint")
    held = {s: np.zeros(blocks[s], dtype=np.int64) for s in names}
    for s, b, n in in_blocks(sized).groupBy("source", "_block").agg(F.sum("size")).collect():
        held[s][b] = n
    plans = [schedule(held[s], goal[s], (seed, k)) for k, s in enumerate(names)]
    dealt = shards_of(plans, shards, seed)
    cuts = small([(s, *p.cut) for s, p in zip(names, plans, strict=True) if p.cut], "_c string, _b int, _room double")
    inside = in_blocks(sized).filter("size > 0").join(cuts, F.col("source").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")))
    edge = inside.select("source", "_key", "size", "_room").groupBy("source").applyInPandas(_boundary, "source string, upto bigint, swap bigint")
    edges = {r["source"]: (r["upto"], r["swap"]) for r in edge.collect()}
    table = []
    for s, plan, shard in zip(names, plans, dealt, strict=True):
        draws: dict[int, list[int]] = {}
        order = np.concatenate(plan.passes).tolist() if plan.passes else []
        for b, to in zip(order, shard.tolist(), strict=True):
            draws.setdefault(b, []).append(to)
        last = draws[plan.cut[0]].pop() if plan.cut else None
        for b, to in draws.items():
            cut = plan.cut is not None and b == plan.cut[0]
            table.append((s, b, to, last if cut else None, *(edges.get(s, (None, None)) if cut else (None, None))))
    plan = small(table, "_p string, _b int, _draws array<int>, _cut int, _upto bigint, _swap bigint")
    out = in_blocks(rows).join(plan, F.col("source").eqNullSafe(F.col("_p")) & (F.col("_block") == F.col("_b")), "left")
    upto, swap = F.coalesce(F.col("_key") <= F.col("_upto"), F.lit(False)), F.col("_key").eqNullSafe(F.col("_swap"))
    none = F.array().cast("array<int>")
    shard = F.concat(F.coalesce("_draws", none), F.when(F.col("_cut").isNotNull() & (upto != swap), F.array("_cut")).otherwise(none))
    shard = F.when(F.col("size") > 0, shard).otherwise(none)
    out = out.withColumn("shards", shard).withColumn("copies", F.size("shards"))
    return out.select(*kept, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "shards")


def emit(mixed: DataFrame, seed: int = 17, partitions: int | None = None) -> DataFrame:
    """One row for each copy, with ``copy`` (from 0) and ``shard``; the plan's own columns go.

    A shard's rows are dealt by a hash to as many tasks as it takes, each of
    which orders its own by a hash.
    """
    kept = [c for c in mixed.columns if c not in OWN and c not in ("copy", "shard")]
    rows = mixed.select(*kept, F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64(F.lit(seed + 1), "doc_id", *(["text"] if "text" in kept else []), "copy")
    spread = rows.repartition(partitions or parts(mixed.sparkSession), "shard", F.pmod(order, F.lit(64)))
    return spread.withColumn("_order", order).sortWithinPartitions("shard", "_order").drop("_order")
