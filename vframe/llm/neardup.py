"""MinHash near-duplicates with sequential Bayesian verification.

Signatures of all texts are banded. Documents with the same shingle set are
one class, linked to its least id; only that one goes on. A bucket's documents
are first compared with one of them, its centre, which joins most groups in
one pass of a size linear in the rows; buckets that then still hold several
components are compared in blocks of bounded rows and bytes, leaving out pairs
that are joined already: the largest component's blocks meet only those of the
others.

A comparison reads the signatures a batch at a time. After ``m`` agreements
of ``k`` values, under a uniform prior, the posterior probability that the
similarity reaches the threshold is a binomial tail; a pair is dropped once
it is below the chosen miss probability. Every survivor is verified on the
full shingle sets of the whole texts, within the block where it was found:
a block gives links that join components, never all its pairs.

Defined cases: a null text or one without words has no shingles and links
with nothing; a null id takes no part, has component null and is kept; rows
with the same id are one document for linking and each gives a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vframe.llm.common import Scratch, batch_rows, parts
from vframe.llm.components import components
from vframe.llm.shingles import MinHash, sets
from vframe.llm.streams import matrix, runs

#: At similarity 0.8 a pair shares no band of 32 with 5 values with probability 3e-6.
BANDS, ROWS = 32, 5
BATCH = 16
#: Rows and bytes of an Arrow batch; two sets of a long text may take a megabyte.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Documents of a large bucket that are compared together, and shingles of their sets.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Pairs of signatures that are compared at a time.
PAIRS = 1 << 15
#: Centres that the documents of a bucket are first compared with, by band.
CENTRES = 4


def least_agreements(threshold: float, miss: float, values: int, step: int = BATCH) -> list[int]:
    """For each batch's end, the fewest agreements with which a pair stays.

    With a uniform prior, P(similarity >= t | m of k) = P(Bin(k + 1, t) <= m).
    """
    out = []
    for k in range(step, values + 1, step):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, limits: list[int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the pairs of rows (x of a, y of b) whose signatures may be similar enough."""
    left, same = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for i, least in enumerate(limits):
        part = slice(i * BATCH, (i + 1) * BATCH)
        same = same + (a[x[left], part] == b[y[left], part]).sum(axis=1)
        ok = same >= least
        left, same = left[ok], same[ok]
        if not len(left):
            break
    return left


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MinHash(BANDS, ROWS)
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                n, low, high, signed = [], [], [], []
                for s in sets(b.column(1).cast(pa.binary()).to_pylist(), k):
                    n.append(len(s))
                    signed.append(own.sign(s))
                    both = xxhash.xxh3_128_digest(s.tobytes())
                    low.append(both[:8])
                    high.append(both[8:])
                signed = np.stack(signed)
                buckets = own.buckets(signed)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(n, pa.int64()),
                        pa.array(np.frombuffer(b"".join(low), "<i8")),
                        pa.array(np.frombuffer(b"".join(high), "<i8")),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, buckets.size + 1, BANDS, dtype=np.int32)), pa.array(buckets.ravel())),
                        pa.array([s.tobytes() for s in signed], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_low", "set_high", "buckets", "signature"],
                )

    return run


SIGNED = "doc_id bigint, n_shingles bigint, set_low bigint, set_high bigint, buckets array<bigint>, signature binary"


def _similar_sizes(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9


def _pruned(threshold: float, limits: list[int]):
    """Of rows a, b and their sizes and signatures, the pairs that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.flatnonzero(_similar_sizes(b.column(2).to_numpy(), b.column(3).to_numpy(), threshold))
            if len(at):
                x, y = (matrix(b.column(c), "<u2", BANDS * ROWS) for c in (4, 5))
                at = at[survivors(x, y, limits, at, at)]
            yield b.select([0, 1]).take(pa.array(at))

    return run


CELL = "band int, bucket bigint, i int, j int, block int, doc_id bigint, label bigint, n_shingles bigint, signature binary"
PARTNERS = "band int, bucket bigint, i int, j int, place int, doc_id bigint, label bigint, partners binary"


def _near(label, doc, n, s, block, band: int, cross: bool, threshold: float, limits: list[int]) -> np.ndarray:
    """Which rows of a group may be similar and are not joined yet: a matrix above its diagonal.

    Rows are taken in strips of at most ``PAIRS`` pairs. A pair belongs to the
    first band that the two share.
    """
    size = len(label)
    out, step, place = np.zeros((size, size), dtype=bool), max(1, PAIRS // size), np.arange(size)
    for low in range(0, size, step):
        rows = slice(low, low + step)
        ok = (label[rows, None] != label[None, :]) & (doc[rows, None] != doc[None, :]) & _similar_sizes(n[rows, None], n[None, :], threshold)
        ok &= (block[rows, None] < block[None, :]) if cross else (place[rows, None] < place[None, :])
        x, y = np.nonzero(ok)
        if not len(x):
            continue
        kept = survivors(s, s, limits, x + low, y)
        x, y = x[kept] + low, y[kept]
        first = (s[x].reshape(-1, BANDS, ROWS) == s[y].reshape(-1, BANDS, ROWS)).all(axis=2).argmax(axis=1)
        x, y = x[first == band], y[first == band]
        out[x, y] = True
    return out


def _partners(threshold: float, limits: list[int]):
    """Of rows of CELL, sorted by the first four: those in a pair, which alone
    need their sets, with a bit for each row of the group after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in runs(batches, 4):
            band, i, j, block, doc, label, n = (table.column(c).to_numpy() for c in (0, 2, 3, 4, 5, 6, 7))
            s = matrix(table.column(8), "<u2", BANDS * ROWS)
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                g = slice(low, high)
                if high - low < 2:
                    continue
                near = _near(label[g], doc[g], n[g], s[g], block[g], band[low], i[low] != j[low], threshold, limits)
                kept = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
                if len(kept):
                    bits = np.packbits(near[np.ix_(kept, kept)], axis=1)
                    own = table.slice(low, high - low).take(pa.array(kept)).combine_chunks().to_batches()[0]
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns[:4], pa.array(np.arange(len(kept), dtype=np.int32)), own.column(5), own.column(6), pa.array([b.tobytes() for b in bits], pa.binary())],
                        names=["band", "bucket", "i", "j", "place", "doc_id", "label", "partners"],
                    )

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


class _Common:
    """Counts what one set of a group has in common with each of the others."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        values, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)[np.argsort(self.code, kind="stable")]
        self.end = np.cumsum(np.bincount(self.code, minlength=len(values)))

    def __call__(self, row: int) -> np.ndarray:
        code = self.code[self.start[row] : self.start[row + 1]]
        end = self.end[code]
        n = end - np.where(code > 0, self.end[code - 1], 0)
        at = np.repeat(end - np.cumsum(n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.size))


def _links_within(percent: int):
    """Over rows of PARTNERS and their sets, sorted by the first five: verified links that join two components.

    The most similar partners of a row go first and those that a link has
    joined to it are passed over, so a group gives fewer links than it has rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in runs(batches, 4):
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                group = table.slice(low, high - low)
                doc, root = group.column(5).to_pylist(), group.column(6).to_numpy().copy()
                common = _Common([np.frombuffer(v.as_buffer(), "<u8") for v in group.column(8)])
                found = []
                for a, bits in enumerate(group.column(7)):
                    near = np.flatnonzero(np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=high - low))
                    if not (root[near] != root[a]).any():
                        continue
                    both = common(a)[near]
                    ok = 100 * both >= percent * (common.size[a] + common.size[near] - both)
                    for b in near[ok][np.argsort(-both[ok], kind="stable")].tolist():
                        if root[a] != root[b]:
                            found.append((doc[a], doc[b]))
                            root[root == root[b]] = root[a]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def _shingle_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                found = [s.tobytes() for s in sets(b.column(1).cast(pa.binary()).to_pylist(), k)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["doc_id", "set"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                ok.append(_similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def find_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-6, scratch: Scratch | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    Documents are linked where 100 * intersection >= percent * union of their
    sets of ``shingle`` words.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    with batch_rows(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):
        return _found(docs, shingle, percent, miss, scratch)


def _found(docs: DataFrame, shingle: int, percent: int, miss: float, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    threshold, limits = percent / 100, least_agreements(percent / 100, miss, BANDS * ROWS)
    n_parts = parts(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.table(texts.mapInArrow(_sign(shingle), SIGNED), "signed")
    some = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())

    # equal sets: one class. Aggregates are written before they are joined, so that a hot key's join can be split.
    key = ["set_low", "set_high", "n_shingles"]
    least = some.groupBy(*key).agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    least = scratch.table(least, "classes")
    copies = scratch.table(some.select("doc_id", *key).join(least, key).select(F.col("doc_id").alias("a"), "b").filter("a != b").distinct(), "copies")
    first = some.join(copies, some["doc_id"] == copies["a"], "left_anti")

    # buckets with several documents, and each document against the bucket's centre
    rows = first.select("doc_id", "n_shingles", F.posexplode("buckets").alias("band", "bucket"))
    turn = F.col("band") % CENTRES  # the least id, of which others are mostly copies, or any
    drawn = F.struct(F.when(turn == 0, F.col("doc_id")).otherwise(F.xxhash64(turn, "doc_id")).alias("h"), F.col("doc_id").alias("id"))
    shared = rows.groupBy("band", "bucket").agg(F.min(drawn).alias("centre"), F.max(drawn).alias("last")).filter("centre != last")
    shared = scratch.table(shared.select("band", "bucket", F.col("centre.id").alias("centre")), "shared")
    members = scratch.table(rows.join(shared, ["band", "bucket"]), "members")
    sizes = signed.select("doc_id", "n_shingles", "signature").filter(F.col("doc_id").isNotNull())

    def side(name: str) -> DataFrame:
        return sizes.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("signature").alias(f"s_{name}"))

    # the full sets of all that share a bucket; both sides grow with the corpus, so neither is broadcast
    ids = members.select("doc_id").distinct().hint("merge")
    held = texts.join(ids, "doc_id", "left_semi").mapInArrow(_shingle_sets(shingle), "doc_id bigint, set binary")
    held = scratch.table(held, "sets")

    ends = F.greatest("doc_id", "centre").alias("a"), F.least("doc_id", "centre").alias("b")
    star = members.filter("doc_id != centre").select(*ends).distinct()
    star = star.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    star = scratch.table(star.mapInArrow(_pruned(threshold, limits), "a bigint, b bigint"), "star")
    both = star.hint("merge").join(held.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    both = both.hint("merge").join(held.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    links = scratch.table(both.select("a", "b", "x", "y").mapInArrow(_exact(percent), "a bigint, b bigint"), "star-links")

    # buckets that the centres have not joined: rows of the largest component in blocks of their own, which meet only the others' blocks
    label = scratch.table(components(links, scratch).select(F.col("id").alias("doc_id"), "component"), "joined")
    labelled = members.join(label, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id"))
    labelled = scratch.table(labelled.select("band", "bucket", "doc_id", "n_shingles", "label"), "labelled")
    each = labelled.groupBy("band", "bucket", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    mixed = each.groupBy("band", "bucket").agg(F.max(F.struct("n", "s", "label")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("labels"))

    def blocks(n: Column, s: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")

    mixed = mixed.filter("labels > 1").select(
        "band", "bucket", F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.s")).alias("main_blocks"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("other_blocks")
    )
    open_ = labelled.join(scratch.table(mixed, "open"), ["band", "bucket"]).withColumn("in_main", F.col("label") == F.col("main"))
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("in_main"), F.col("main_blocks")).otherwise(F.col("other_blocks"))).cast("int")
    last = F.col("other_blocks") + F.when(F.col("in_main"), 0).otherwise(F.col("main_blocks")) - 1
    open_ = open_.withColumn("block", own + F.when(F.col("in_main"), F.col("other_blocks")).otherwise(0)).withColumn("last", last)
    open_ = open_.join(sizes.drop("n_shingles"), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    open_ = open_.select("band", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "label", "n_shingles", "signature")
    key = ["band", "bucket", "i", "j"]
    grouped = open_.repartition(n_parts, *key).sortWithinPartitions(*key)
    paired = scratch.table(grouped.mapInArrow(_partners(threshold, limits), PARTNERS), "paired")
    paired = paired.join(held.hint("merge"), "doc_id").select(*paired.columns, "set")
    again = paired.repartition(n_parts, *key).sortWithinPartitions(*key, "place")
    more = scratch.table(again.mapInArrow(_links_within(percent), "a bigint, b bigint"), "rest-links")

    found = scratch.table(components(links.unionAll(more).unionAll(copies), scratch).select(F.col("id").alias("doc_id"), "component"), "components")
    component = F.coalesce("component", "doc_id")
    return signed.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that another of their group stands for."""
    found = find_duplicates(docs, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs["doc_id"].cast("bigint") == found["_gone"], "left_anti")
