"""Near-duplicate groups by SimHash fingerprints and covering locality-sensitive hashing (Pagh, 2016)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sheaf.llm.components import components
from sheaf.llm.rows import matched, small
from sheaf.llm.store import remove, workspace, written
from sheaf.sources.tables import table

BITS, WORDS, RADIUS, SEED = 64, 4, 4, 42
#: Fingerprints of a bucket that one task compares; larger buckets are dealt out as pairs of blocks.
BLOCK = 8192
#: Hashes that are counted at a time.
PART = 1 << 16
#: Bytes of a text that are cut into words at a time, and what ends a word.
STRETCH, BLANK = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")
#: Near copies: words of a shingle; the least Jaccard similarity, as a fraction; parts, and shingles drawn for each.
NEAR_WORDS, NEAR, PARTS, DRAWN = 5, (4, 5), 32, 4
#: Hashes that are drawn from at a time.
STRIP = 2048
#: Fingerprints that the covering tables take at a time, whole parts of them, and so many in a task.
TOGETHER, TASK = 1 << 18, 1 << 14
#: Buckets of parts up to so many texts give pairs; larger ones are searched, so many texts of a block at a time.
FEW, SETS = 16, 512
_RANDOM = np.random.default_rng(SEED)
FLIPS, FACTORS = _RANDOM.integers(
    0, 1 << 63, PARTS * DRAWN, np.uint64
), _RANDOM.integers(0, 1 << 63, PARTS * DRAWN, np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_hashes(text: str, words: int, stretch: int = STRETCH) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, A-Z lower-cased; of all words where there are fewer, none where there are none.

    A long text is taken in stretches, each with the last words of the one before, so of a text only its bytes
    and its hashes are held whole.
    """
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= stretch:
        return _run_hashes(data.lower().split(), words, True)  # on bytes: ASCII letters and ASCII white space only
    out, before, start = [], [], 0
    while start < len(data):
        blank = BLANK.search(data, start + stretch)
        end = blank.start() if blank else len(data)
        found = before + data[start:end].lower().split()
        start = end
        last = start >= len(data)
        out.append(_run_hashes(found, words, last and not out))
        before = found if len(found) < words else found[len(found) - words + 1 :]
    hashes = np.concatenate(out)
    return hashes if len(hashes) or not before else _run_hashes(before, words, True)


def _run_hashes(found: list[bytes], words: int, short: bool) -> np.ndarray:
    """Hashes of the runs of words; fewer words are one run if ``short``."""
    k = min(words, len(found)) if short else words
    if not found or len(found) < k:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    view = memoryview(joined)
    return np.fromiter(
        (xxh64_intdigest(view[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)), np.uint64, len(found) - k + 1
    )


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes have it; no hashes give zero."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), PART):
        octets = hashes[at : at + PART].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def parts(hashes: np.ndarray) -> np.ndarray:
    """``PARTS`` fingerprints, each over ``DRAWN`` of the distinct hashes: those that come first in as many random orders.

    A draw of two sets falls on the same hash with a chance of their Jaccard similarity, wherever they differ.
    """
    least = np.full(PARTS * DRAWN, ~np.uint64(0))
    for at in range(0, len(hashes), STRIP):
        np.minimum(least, ((hashes[None, at : at + STRIP] ^ FLIPS[:, None]) * FACTORS[:, None]).min(axis=1), out=least)
    least ^= least << np.uint64(31)  # the least numbers begin with zeros: mixed, each bit is as good as a coin again
    least *= np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 over the golden ratio
    least ^= least >> np.uint64(32)
    bits = np.unpackbits(least.astype("<u8").view(np.uint8).reshape(PARTS, DRAWN, 8), axis=2, bitorder="little").sum(axis=1)
    return np.packbits(2 * bits > DRAWN, axis=1, bitorder="little").view("<i8").ravel()


def marks(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of all the hashes, then those of ``parts``, as signed 64-bit integers."""
    return np.concatenate([np.array([fingerprint(hashes)], np.uint64).view(np.int64), parts(hashes)])


def fingerprints(docs: DataFrame, features: list[Callable[[str], np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp0, fp1, ...): each row's fingerprint over each kind of features, as signed 64-bit integers. Whole texts; null counts as empty."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[int]] = [[] for _ in features]
            for i in range(len(batch)):
                text = batch.column(1)[i].as_py() or ""
                for column, feature in zip(columns, features, strict=True):
                    column.append(fingerprint(feature(text)))
            fps = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *fps], names=["id", *(f"fp{k}" for k in range(len(fps)))])

    schema = ", ".join(["id long", *(f"fp{k} long" for k in range(len(features)))])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(mark, schema)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` bits or fewer lie wholly outside one of them.

    Bit i has the nonzero vector m(i) of radius + 1 bits, and mask v keeps the bits where m(i) and v have an
    odd product. Up to ``radius`` vectors m(i) span too little to fill the space, so some v is orthogonal to
    all of them: its mask keeps none of their bits.
    """
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that join what is within reach, without all pairs: a search that compares each fingerprint with those not reached yet.

    With ``right``, only links between the two sides count; without it, all among ``left``.
    """
    if right is None:
        rest, out = left, []
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                at = queue.pop()
                near = np.bitwise_count(rest ^ at) <= radius
                if near.any():
                    out += [(int(at), int(x)) for x in rest[near]]
                    queue += rest[near].tolist()
                    rest = rest[~near]
        return out
    sides, out = [left, right], []
    while len(sides[0]) and len(sides[1]):
        queue, sides[0] = [(0, sides[0][0])], sides[0][1:]
        while queue:
            side, at = queue.pop()
            other = sides[1 - side]
            if len(other):
                near = np.bitwise_count(other ^ at) <= radius
                if near.any():
                    out += [(int(at), int(x)) for x in other[near]]
                    queue += [(1 - side, x) for x in other[near].tolist()]
                    sides[1 - side] = other[~near]
    return out


def links(distinct: DataFrame, at: str, radius: int = RADIUS, block: int = BLOCK, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of fingerprints within ``radius`` that connect all that are connected. ``distinct``: a written table of fp.

    ``by``: further columns of ``distinct``, whole numbers; only fingerprints that agree in them link, and pairs have them.

    Each table keys the fingerprints by their masked bits. Buckets of two are compared as they are. Larger ones
    are searched by one task each, up to ``block`` fingerprints; beyond that each fingerprint draws a block of
    its bucket, and every pair of blocks is searched apart, so no bucket is cut short and none meets in one task.
    """
    spark = distinct.sparkSession
    masks = F.array(*[F.struct(F.lit(i).alias("table"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(covering_masks(radius))])
    keyed = distinct.select(*by, "fp", F.explode(masks).alias("m")).select(
        *by, "fp", F.col("m.table").alias("table"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key")
    )
    bucket = [*by, "table", "key"]
    sizes = keyed.groupBy(*bucket).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = written(sizes, f"{at}/buckets")
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = sizes.where("n = 2").where(within).select(*by, "a", "b")
    large = sizes.where("n > 2").select(*bucket, "n", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp", "table"), F.col("blocks")).cast("int")
    many = matched(keyed, large, bucket, "n").withColumn("own", own)
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j")))
    tasks = many.select(*bucket, "fp", "own", F.explode(every).alias("t")).select(*bucket, "fp", "own", "t.i", "t.j")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        fps, own, i, j = group["fp"].to_numpy(
            np.uint64, copy=False
        ) if group["fp"].dtype == np.uint64 else group["fp"].to_numpy().view(np.uint64), group["own"].to_numpy(), group["i"].iloc[0], group["j"].iloc[0]
        found = forest(fps, None, radius) if i == j else forest(fps[own == i], fps[own == j], radius)
        pair = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({**{c: np.full(len(pair), group[c].iloc[0], np.int64) for c in by}, "a": pair[:, 0], "b": pair[:, 1]})

    schema = ", ".join([*(f"{c} long" for c in by), "a long, b long"])
    searched = tasks.groupBy(*bucket, "i", "j").applyInPandas(search, schema)
    return written(pairs.unionByName(searched).distinct(), f"{at}/links")


def grouped(marked: DataFrame, at: str, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for a written table of (id, fp): rows linked at ``radius`` bits or fewer, and the smallest id that each can reach."""
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), f"{at}/distinct")
    roots = components(links(distinct.select("fp"), at, radius), f"{at}/components")
    named = written(
        distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")),
        f"{at}/named"
    )
    names = written(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")), f"{at}/names")
    classes = written(matched(named, names, ["root"], "fps").select("fp", "component_id", "rows"), f"{at}/classes")
    return matched(marked, classes, ["fp"], "rows").drop("rows")


def near_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) over shingles of ``words`` words.

    Rows are first brought together by fingerprint, so copies cost one row; components are those of distinct
    fingerprints. A row without words has fingerprint zero and links like any other. A null id does not name a
    component; a component of null ids alone has a null one. Rows that repeat an id are one in the naming. An
    empty table gives no rows, and columns of other names are ignored.
    """
    at = workspace(docs.sparkSession, "simhash")
    marked = written(fingerprints(docs, [partial(shingle_hashes, words=words)], id_col, text_col), f"{at}/fingerprints")
    return grouped(marked.select("id", F.col("fp0").alias("fp")), at, radius)


def alike(common: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether sets of ``left`` and ``right`` members, ``common`` in both, have the Jaccard similarity ``NEAR`` or more, in whole numbers."""
    return NEAR[1] * common >= NEAR[0] * (left + right - common)


def near_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what ``alike`` connects, without all pairs: a search that compares each set with those not reached yet."""
    sizes = np.array([len(x) for x in sets])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner, starts = np.repeat(np.arange(len(sets)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    rest, out = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        queue = [first] if rest[first] else []
        rest[first] = False
        while queue and rest.any():
            at = queue.pop()
            mark = np.zeros(len(known), bool)
            mark[flat[starts[at] : starts[at + 1]]] = True
            common = np.bincount(owner[mark[flat]], minlength=len(sets))
            found = np.flatnonzero(rest & alike(common, sizes[at], sizes)).tolist()
            out += [(at, x) for x in found]
            rest[found] = False
            queue += found
    return out


def distinct_hashes(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, NEAR_WORDS))


def sketches(docs: DataFrame, row_col: str, id_col: str, text_col: str) -> DataFrame:
    """(id, row, node, n, parts): the row's key, a digest of its text's set of shingles, the set's size and its fingerprints.

    These are that of all shingles, then those of parts; none where there are no shingles. Whole texts; null counts as empty.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, found = [], [], []
            for i in range(len(batch)):
                own = distinct_hashes(batch.column(2)[i].as_py() or "")
                nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sizes.append(len(own))
                found.append(marks(own) if len(own) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["id", "row", "node", "n", "parts"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(row_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sketch, "id long, row long, node binary, n long, parts array<long>")


def near_classes(nodes: DataFrame, at: str, radius: int = RADIUS) -> DataFrame:
    """(part, fp, root, size, texts): fingerprints whose texts are candidates of others. ``nodes``: a written table of (node, part, fp).

    As in ``grouped``, texts are first brought together by fingerprint, and the covering tables then link those of
    a part at ``radius`` bits or fewer. What the links connect is a bucket, ``root``; ``size`` is its number of texts,
    ``texts`` the fingerprint's own. Parts are taken a few at a time, so the tables' files never lie there all at once.
    """
    spark = nodes.sparkSession
    counted = written(nodes.groupBy(F.col("part").cast("long").alias("part"), "fp").agg(F.count("*").alias("texts")), f"{at}/fingerprints")
    of = {r["part"]: r["count"] for r in counted.groupBy("part").count().collect()}
    batches, room = [], 0
    for part in sorted(of):
        if of[part] > room:
            batches.append([])
            room = TOGETHER
        batches[-1].append(part)
        room -= of[part]
    linked = spark.createDataFrame([], "part long, a long, b long")
    for k, batch in enumerate(batches):
        tasks = 1 + sum(of[part] for part in batch) // TASK
        own = counted.where(F.col("part").isin(batch)).select("part", "fp").repartition(tasks, "part", "fp")
        linked = linked.unionByName(links(own, f"{at}/covering{k}", radius, by=("part",)))
        remove(spark, f"{at}/covering{k}/buckets")
        del own
        if len(batches) > 1:
            spark._jvm.System.gc()  # frees the shuffle files of the batch
    ends = [F.struct("part", F.col(c).alias("fp")).alias(c) for c in ("a", "b")]
    roots = components(linked.select(*ends), f"{at}/fingerprint-components")
    roots = written(roots.select("node.part", "node.fp", F.col("root.fp").alias("root")), f"{at}/roots")
    named = counted.join(small(roots), ["part", "fp"], "left").select("part", "fp", F.coalesce("root", "fp").alias("root"), "texts")
    buckets = named.groupBy("part", "root").agg(F.sum("texts").alias("size"), F.count("*").alias("fps")).where("size > 1")
    buckets = written(buckets, f"{at}/buckets")
    return written(matched(named, buckets, ["part", "root"], "fps").select("part", "fp", "root", "size", "texts"), f"{at}/classes")


def near_links(docs: DataFrame, marked: DataFrame, at: str, row_col: str, text_col: str = "text") -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose shingle sets are alike. ``marked``: the written sketches of ``docs``. A set is taken from one row of those that have it.

    Candidates have fingerprints of all shingles, or of one part, that the covering tables link at ``RADIUS`` bits or
    fewer. Pairs of similarity 0.8 draw the same four shingles for a part with a chance of 0.41, so one in 20 million
    has no part of 32 in common. Every candidate's similarity is then taken from the whole sets: pairs of small
    buckets once for each pair, large buckets by tasks of two blocks each.
    """
    spark = docs.sparkSession
    at = f"{at}/search"
    nodes = marked.dropDuplicates(["node"]).select("node", "row", "n", F.posexplode("parts").alias("part", "fp"))
    nodes = written(nodes, f"{at}/parts")
    members = matched(nodes, near_classes(nodes, at), ["part", "fp"], "texts")
    members = written(members.select("node", "row", "n", "part", F.col("root").alias("fp"), "size"), f"{at}/members")
    wanted = written(members.select("node", "row").distinct(), f"{at}/wanted")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                own = distinct_hashes(batch.column(1)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([own.tobytes()], pa.binary())], names=["node", "hashes"])

    texts = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    sets = written(texts.join(small(wanted), "row").select("node", "text").mapInArrow(whole, "node binary, hashes binary"), f"{at}/sets")

    own = members.where(F.col("size") <= FEW).select("part", "fp", F.struct("node", "n").alias("x"))
    listed = own.groupBy("part", "fp").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pairs = listed.select(F.explode("xs").alias("a"), "xs").select("a", F.explode("xs").alias("b")).where("a.node < b.node")
    fitting = pairs.where(F.least("a.n", "b.n") * NEAR[1] >= F.greatest("a.n", "b.n") * NEAR[0])
    fitting = written(fitting.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), f"{at}/pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for i in range(len(batch)):
                x, y = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (2, 3))
                held.append(bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(k), F.col("hashes").alias(f"{k}s")) for k in ("a", "b"))
    verified = fitting.join(right, "b").join(left, "a").select("a", "b", "as", "bs").mapInArrow(verify, "a binary, b binary")

    blocks = F.ceil(F.col("size") / SETS).cast("int")
    many = members.where(F.col("size") > FEW).withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("node", "part"), F.col("blocks")).cast("int")
    )
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("own")) | (F.col("blocks") == 1))
    tasks = many.select("part", "fp", "node", "own", F.explode(other).alias("x")).select(
        "part", "fp", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "node"
    )

    def search(group: pd.DataFrame) -> pd.DataFrame:
        names = group["node"].tolist()
        found = near_forest([np.frombuffer(x, np.uint64) for x in group["hashes"]])
        return pd.DataFrame({"a": [names[a] for a, _ in found], "b": [names[b] for _, b in found]}, dtype=object)

    searched = tasks.join(sets, "node").groupBy("part", "fp", "i", "j").applyInPandas(search, "a binary, b binary")
    return written(verified.unionByName(searched).distinct(), f"{at}/links")


def near_rows(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, component_id, kept_row): ``near_copies`` of a written table whose rows have a key, whole numbers, in ``row_col``.

    ``kept_row`` is the row of the component's smallest id, of several the least; null where no row of it has an id.
    """
    at = workspace(docs.sparkSession, "near")
    marked = written(sketches(docs, row_col, id_col, text_col), f"{at}/sketches")
    linked = components(near_links(docs, marked, at, row_col, text_col), f"{at}/all")
    roots = written(linked.join(marked.groupBy("node").agg(F.count("*").alias("copies")), "node"), f"{at}/roots")
    for done in ("search", "all"):  # sets of hashes take more room than texts
        remove(docs.sparkSession, f"{at}/{done}")
    named = matched(
        marked.select("id", "row", "node"), roots, ["node"], "copies", "left"
    ).select("id", "row", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row"))).alias("least"), F.count("*").alias("rows")
    ).where("rows > 1")
    named = matched(named, written(names, f"{at}/names"), ["root"], "rows", "left")
    return named.select(
        "id", "row", F.when(F.col("id").isNotNull(), F.coalesce("least.id", "id")).alias("component_id"),
        F.when(F.col("rows").isNull(), F.col("row")).otherwise(F.col("least.row")).alias("kept_row")
    )


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): groups of near copies, for dropping all but one of each.

    Texts are linked where the Jaccard similarity of their sets of five-word shingles is 0.8 or more, taken from
    the whole sets, and a group is what links connect. Words are split at ASCII white space, A-Z lower-cased;
    fewer than five words are one shingle. Texts without words link with each other only. A 64-bit fingerprint
    of all shingles differs by 4 to 14 bits at 0.8, so the covering tables search fingerprints of parts too (``near_links``).
    Rows of null ids have a null component.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, f"{workspace(docs.sparkSession, 'near')}/rows")
    return near_rows(rows, "row", "id", "text").select("id", "component_id")


def hex64(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex64(F.col("fp")).alias("fingerprint"), "component_id")
