"""Packing token sequences by minimum bin slack on the histogram of their lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.running import before, slots
from sheaf.llm.store import workspace, written
from sheaf.llm.tokens import encoder
from sheaf.sources.tables import table

CAPACITY, END = 4096, 1


def fullest(counts: dict[int, int], order: list[int], room: int) -> Counter:
    """The lengths, as often as each is there, whose sum is the largest up to ``room``.

    Bit s of an integer says that the sum s can be made. Each copy of a length shifts the bits by it; the
    first sum that fills the room ends the search. ``order`` has the lengths from long to short, so that of
    equal sums the one of longer parts is found first and short ones are left for later bins.
    """
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in order:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            more = (sums | sums << length) & mask
            if more == sums:
                break
            steps.append((length, sums))
            sums = more
        if sums >> room & 1:
            break
    left, used = sums.bit_length() - 1, Counter()
    for length, earlier in reversed(steps):
        if not earlier >> left & 1:
            used[length] += 1
            left -= length
    return used


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """How to fill bins: (how many bins, the lengths in each, long to short).

    Each bin takes the longest length left and then the fullest combination of the others. A combination is
    used for as many bins as the counts allow, so the work follows the distinct lengths, of which there are at
    most ``capacity``, and not the number of bins.
    """
    counts = {k: v for k, v in histogram.items() if v > 0}
    order = sorted(counts, reverse=True)
    out = []
    while order:
        first = order[0]
        counts[first] -= 1
        used = fullest(counts, order, capacity - first)
        counts[first] += 1
        used[first] += 1
        bins = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= bins * n
        out.append((bins, sorted(used.elements(), reverse=True)))
        order = [k for k in order if counts[k]]
    return out


def placement(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """By (length, rank): which pieces of a length a pattern takes, its first bin, how often it has the length, and where in the bin."""
    taken: Counter = Counter()
    rows, first_bin = [], 0
    for bins, lengths in plan:
        offset = 0
        for length, n in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, taken[length], first_bin, n, offset))
            taken[length] += bins * n
            offset += n * length
        first_bin += bins
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "each", "offset"), columns.T, strict=True))


PIECES = "row long, doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, vocabulary: str, end: int = END, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids with ``end`` after them, cut into pieces of ``capacity`` where it is longer, as a written table.

    ``ids`` are little-endian unsigned 32-bit integers, ``row`` tells rows that repeat an id apart.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            docs, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, last, ids, starts in coder.batches(batch.column(1), end):
                data, rows = ids.astype("<u4").tobytes(), []
                for doc, row, a, b in zip(docs[first:last], keys[first:last], starts.tolist(), starts[1:].tolist(), strict=False):
                    for piece, at in enumerate(range(a, b, capacity)):
                        to = min(at + capacity, b)
                        rows.append((row, doc, piece, at - a, to - at, data[4 * at : 4 * to]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    return written(rows.mapInArrow(encode, PIECES), f"{workspace(docs.sparkSession, 'packing')}/pieces")


KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
NAMES = ["row", "doc_id", "piece", "start", "length", "ids"]


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece its sequence_id and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``cut`` is a table of ``pieces``. Only the histogram of lengths, ``capacity`` rows at most, goes to the
    driver, and a plan bounded by it goes to every task. A piece's rank among those of its length says which
    bin of the plan takes it. Ranks are counted in two levels, so one length may have most of all pieces.
    Null and empty texts have their end id and are packed like others; no documents give no rows.
    """
    spark = cut.sparkSession
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(placement(patterns(histogram, capacity)))
    facts = cut.select("row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    dealt = written(
        facts.withColumn("deal", F.pmod(F.xxhash64("row", "piece"), F.lit(slots(cut))).cast("int")), f"{workspace(spark, 'packing')}/facts"
    )
    ranked = before(dealt, ["length"], "deal", [F.col("doc_id"), F.col("piece"), F.col("row")], F.lit(1), "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        step = int(p["rank"].max(initial=0)) + 1
        keys = p["length"].astype(object) * step + p["rank"].astype(object) if capacity * step >= 1 << 62 else p["length"] * step + p["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            wanted = length.astype(keys.dtype) * step + np.minimum(rank, step - 1)
            at = np.searchsorted(keys, wanted, side="right") - 1
            over = rank - p["rank"][at]
            place_in = over % p["each"][at]
            out = [*batch.columns[:5], pa.array(p["bin"][at] + over // p["each"][at]), pa.array(p["offset"][at] + place_in * length)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(place, schema)


def sequences(cut: DataFrame, places: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian unsigned 32-bit), in the order of their offsets.

    A sequence has at most ``capacity`` ids, so each group is small. Needs ids that no two rows share.
    """
    parts = cut.select("doc_id", "piece", "ids").join(places.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, b: F.concat(a, b))
    return parts.groupBy("sequence_id").agg(ordered.alias("parts")).select("sequence_id", whole.alias("ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places."""
    return packed(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
