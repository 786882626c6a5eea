"""Token ids in a content-addressed store: rolling-hash chunks kept once, document recipes, Merkle manifests."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.rows import matched
from sheaf.llm.running import before
from sheaf.llm.store import workspace, written
from sheaf.llm.tokens import encoder
from sheaf.sources.tables import table

END = 2
WINDOW, LEAST, MASK, MOST = 16, 256, 1023, 4096


@dataclass(frozen=True)
class Store:
    """``chunks``: key, width, ids, and how many recipes' places name it, each chunk once. ``recipes``: doc_id, start, n_tokens, root, digests in ascending doc_id order by part. ``manifest``: documents, tokens and a root over each part's recipes."""

    path: str
    empty: bool = False

    def chunks(self, spark: SparkSession) -> DataFrame:
        if self.empty:
            return spark.createDataFrame([], "key binary, width int, ids binary, uses long")
        return spark.read.parquet(f"{self.path}/objects/kind=chunk").select("key", "width", "ids", "uses")

    def recipes(self, spark: SparkSession) -> DataFrame:
        if self.empty:
            return spark.createDataFrame([], "row binary, doc_id long, n_tokens long, root binary, digests array<binary>, part int, start long")
        return spark.read.parquet(f"{self.path}/recipes")

    def manifest(self, spark: SparkSession) -> DataFrame:
        if self.empty:
            return spark.createDataFrame([], "part int, documents long, tokens long, root string")
        return spark.read.parquet(f"{self.path}/manifest")


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """A random 64-bit number for each id modulo 2^16, from a fixed seed."""
    return np.random.default_rng(20240229).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


def cut_points(ids: np.ndarray, starts: list[int], table64: np.ndarray) -> list[list[int]]:
    """Each document's chunk ends. ``ids``: documents one after the other; ``starts``: where each begins, and the end.

    The rolling hash of the last ``WINDOW`` ids cuts where its low bits are zero, ``LEAST`` to ``MOST`` ids
    after the cut before. No cut comes before a window lies wholly in its document, so equal passages cut alike
    wherever they stand.
    """
    rolled, back = table64[ids & np.uint32(0xFFFF)], 1
    while back < WINDOW:  # sums over windows of twice the length each time
        longer = rolled.copy()
        longer[back:] += rolled[:-back] << np.uint64(back)
        rolled, back = longer, 2 * back
    marks = np.flatnonzero((rolled >> np.uint64(20)) & np.uint64(MASK) == 0) + 1
    out = []
    for a, b in zip(starts, starts[1:], strict=False):
        ends, at = [], a
        i = int(np.searchsorted(marks, a + LEAST))
        while b - at > LEAST:
            i = max(i, int(np.searchsorted(marks, at + LEAST)))
            mark = int(marks[i]) if i < len(marks) else b
            at = min(mark, at + MOST, b)
            if at == b:
                break
            ends.append(at - a)
        out.append([*ends, b - a])
    return out


def merkle(digests: list[bytes]) -> bytes:
    """The root over a list of digests: pairs are hashed level by level, an odd one out moves up as it is."""
    level = [hashlib.blake2b(b"\0" + d, digest_size=16).digest() for d in digests]
    while len(level) > 1:
        level = [
            hashlib.blake2b(
                b"\1" + b"".join(level[i : i + 2]), digest_size=16
            ).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)
        ]
    return level[0] if level else bytes(16)


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


OBJECTS = "kind string, key binary, doc_id long, width int, n_tokens long, root binary, digests array<binary>, ids binary, uses long"
#: A manifest's lowest nodes cover so many tokens, so at most as many documents; each level above covers so many times more.
LEAVES, FAN = 4096, 1024


def sheets(recipes: DataFrame) -> DataFrame:
    """(part, documents, tokens, root): a Merkle tree over each part's recipes, built level by level.

    A leaf is the SHA-256 of a recipe's place, length and root. No two documents start at the same token, so a
    stretch of tokens bounds how many nodes meet in one group, whatever the number of documents.
    """
    total = recipes.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] or 0
    leaf = F.sha2(F.concat_ws("|", F.hex("row"), "doc_id", "start", "n_tokens", F.hex("root")), 256)
    level, span = recipes.select(
        "part", "start", leaf.alias("root"), F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens")
    ), LEAVES
    while True:
        nodes = F.transform(F.sort_array(F.collect_list(F.struct("start", "root"))), lambda x: x["root"])
        over = [F.floor(F.col("start") / span).alias("stretch")] if span < total else []
        level = level.groupBy("part", *over).agg(
            F.sha2(F.array_join(nodes, ""), 256).alias("root"), F.min("start").alias("start"), F.sum("documents").alias("documents"),
            F.sum("tokens").alias("tokens")
        )
        if not over:
            return level.select("part", "documents", "tokens", "root")
        span *= FAN


def stored(docs: DataFrame, vocabulary: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Store:
    """Encode whole texts and write the store. Returns it; ``path`` is a new folder, by default in the workspace.

    Texts are encoded once: one pass makes a recipe for each row and its chunks, and one shuffle brings equal
    chunks together after each task has kept one copy of its own, so a chunk that is in every document is one
    row for each task. Recipes are range-sorted by doc_id, null ids first; rows that repeat an id are documents
    of their own, one after the other. Null and empty texts are documents of the end id alone. An empty table
    makes an empty store.
    """
    spark = docs.sparkSession
    path = path or workspace(spark, "tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table64 = encoder(vocabulary), gear()
        schema = pa.schema(
            [
                ("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("width", pa.int32()), ("n_tokens", pa.int64()),
                ("root", pa.binary()), ("digests", pa.list_(pa.binary())), ("ids", pa.binary()), ("uses", pa.int64())
            ]
        )

        def taken(docs: list[int | None], keys: list[int], ids: np.ndarray, starts: list[int]) -> pa.RecordBatch:
            rows: list[tuple] = []
            seen: dict[bytes, bytes] = {}
            uses: Counter = Counter()
            data, width = ids.tobytes(), coder.width
            for doc, row, start, end, ends in zip(docs, keys, starts, starts[1:], cut_points(ids, starts, table64), strict=False):
                chunks = [data[(start + a) * width : (start + b) * width] for a, b in zip([0, *ends], ends, strict=False)]
                digests = [_digest(c) for c in chunks]
                rows.append(("recipe", row.to_bytes(8, "big"), doc, width, end - start, merkle(digests), digests, None, None))
                seen.update(zip(digests, chunks, strict=True))
                uses.update(digests)
            rows += [("chunk", d, None, width, len(c) // width, None, None, c, uses[d]) for d, c in seen.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            docs, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, last, ids, starts in coder.batches(batch.column(1), end):
                yield taken(docs[first:last], keys[first:last], ids, starts.tolist())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    if rows.isEmpty():
        return Store(path, empty=True)
    objects = rows.mapInArrow(encode, OBJECTS).groupBy("kind", "key")
    firsts = [F.first(c).alias(c) for c in ("doc_id", "width", "n_tokens", "root", "digests", "ids")]
    objects.agg(*firsts, F.sum("uses").alias("uses")).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    recipes = spark.read.parquet(f"{path}/objects/kind=recipe").select(F.col("key").alias("row"), "doc_id", "n_tokens", "root", "digests")
    ranged = recipes.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id())
    ranged.write.option("compression", "zstd").parquet(f"{path}/sorted")
    sums = spark.read.parquet(f"{path}/sorted")
    placed = before(sums, [], "part", [F.col("doc_id"), F.col("row")], F.col("n_tokens"), "start")
    placed.sortWithinPartitions("part", "doc_id", "row").write.option("compression", "zstd").parquet(f"{path}/recipes")
    sheets(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    return Store(path)


@lru_cache(maxsize=1)
def _shifts() -> list[np.ndarray]:
    """For each k, what 2^k zero bytes do to a CRC-32: the images of its 32 bits."""
    one = np.array([0xEDB88320] + [1 << i for i in range(31)], np.uint64)  # fixed value: the reversed CRC-32 polynomial
    double = lambda m: _apply(m, m)
    byte = double(double(double(one)))
    out = [byte]
    for _ in range(47):
        out.append(double(out[-1]))
    return out


def _apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for bit in range(32):
        out ^= np.where((values >> np.uint64(bit)) & np.uint64(1) == 1, matrix[bit], np.uint64(0))
    return out


def crc_joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32s of joined byte strings, from the parts' and the bytes of the second parts."""
    out, shifts = first.astype(np.uint64), _shifts()
    for k in range(int(length.max()).bit_length() if len(length) else 0):
        on = (length >> np.uint64(k)) & np.uint64(1) == 1
        out[on] = _apply(shifts[k], out[on])
    return out ^ second


def crc_of_lists(owner: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of each owner's byte strings joined. ``owner`` counts from 0 and is sorted. Neighbours are joined in pairs, so rounds grow with the logarithm of the longest list."""
    crc, length = crc.astype(np.uint64), length.astype(np.uint64)
    while True:
        counts = np.bincount(owner)
        if counts.max(initial=0) <= 1:
            return crc
        place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        left = np.flatnonzero(place % 2 == 0)
        paired = left[place[left] + 1 < counts[owner[left]]]
        crc[paired] = crc_joined(crc[paired], crc[paired + 1], length[paired + 1])
        length[paired] += length[paired + 1]
        owner, crc, length = owner[left], crc[left], length[left]


def checked(store: Store, spark: SparkSession) -> DataFrame:
    """The store's recipes, once each part's root, documents and tokens are those of the manifest; else this raises."""
    recipes = store.recipes(spark)
    told, seen = store.manifest(spark), sheets(recipes)
    pair = told.select("part", F.struct("documents", "tokens", "root").alias("told")).join(
        seen.select("part", F.struct("documents", "tokens", "root").alias("seen")), "part", "full"
    )
    wrong = pair.where(~F.col("told").eqNullSafe(F.col("seen"))).select("part").limit(10).collect()
    if wrong:
        raise ValueError(f"the recipes of parts {sorted(r['part'] for r in wrong)} are not those of the manifest")
    return recipes


def read_back(store: Store, spark: SparkSession) -> DataFrame:
    """Each document from the store's files: doc_id, start, n_tokens, ids_crc32, chunks, root (hex).

    The manifest is held against the recipes first, so a lost, added or changed one raises. Every chunk is read
    once and checked against its address. Its ids' CRC-32 goes to the recipes that name it, and joining CRCs in
    recipe order gives that of a document's whole id stream. A recipe whose root, length or chunks don't agree
    raises. Recipes of a chunk that very many name never meet in one task.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, widths, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
            ends = np.cumsum([0, *pc.binary_length(ids).to_pylist()])
            whole = memoryview(pc.binary_join(pa.array([ids.to_pylist()], pa.list_(pa.binary())), b"")[0].as_buffer())
            n, crc = [], []
            for key, width, a, b in zip(keys, widths.tolist(), ends.tolist(), ends[1:].tolist(), strict=False):
                if _digest(whole[a:b]) != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                n.append((b - a) // width)
                crc.append(zlib.crc32(np.frombuffer(whole[a:b], f"<u{width}").astype("<u4")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), batch.column(3)],
                names=["digest", "n", "crc", "uses"]
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, root, parts = batch.column(0), batch.column(3).to_pylist(), batch.column(4)
            counts, flat = parts.value_lengths().to_numpy().astype(np.int64), parts.flatten()
            names, n, crc = flat.field("digest").to_pylist(), flat.field("n").to_numpy(), flat.field("crc").to_numpy()
            owner, ends = np.repeat(np.arange(len(doc)), counts), np.cumsum(counts)
            right = np.bincount(owner, np.maximum(n, 0), len(doc)).astype(np.int64) == batch.column(2).to_numpy()
            right &= np.bincount(owner, n < 0, len(doc)) == 0
            for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                if not right[i] or merkle(names[end - count : end]) != root[i]:
                    raise ValueError(f"the recipe of document {doc[i].as_py()} doesn't agree with its chunks")
            whole = crc_of_lists(owner, crc, 4 * n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [doc, batch.column(1), batch.column(2), pa.array(whole), pa.array(counts.astype(np.int32)), pa.array([r.hex() for r in root])],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "chunks", "root"]
            )

    if store.empty:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, chunks int, root string")
    facts = written(
        store.chunks(spark).select("key", "width", "ids", "uses").mapInArrow(check, "digest binary, n long, crc long, uses long"),
        f"{workspace(spark, 'tokens')}/facts"
    )
    recipes = checked(store, spark).select("row", "doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("at", "digest"))
    found = matched(recipes, facts, ["digest"], "uses", "left")
    whole = found.groupBy("row", "doc_id", "start", "n_tokens", "root").agg(
        F.sort_array(
            F.collect_list(F.struct("at", "digest", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc")))
        ).alias("parts")
    )
    return whole.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(
        join, "doc_id long, start long, n_tokens long, ids_crc32 long, chunks int, root string"
    )


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from the store."""
    store = stored(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_back(store, spark)
