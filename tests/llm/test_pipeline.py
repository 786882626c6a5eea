"""Each stage of the pipeline, and all of them, against plain Python; and the operators where lists are too long to broadcast."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sheaf.llm import block_search, exact_dedup, registry, rows, simhash, token_store, toxicity, url_filter
from sheaf.llm.components import components
from sheaf.llm.store import workspace, written
from tests.llm.test_llm import brute_components, crc, edited_texts, norm, order
from tests.oracle import assert_same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VILE = ("vile", "nasty", "awful")


def made_rows():
    """Labelled prose with vile words in some, exact and near copies, rows that share an id, rows without one, and texts without words."""
    rng = random.Random(7)
    words = ["w" + "".join(rng.choices("abcdef", k=5)) for _ in range(300)]
    texts = []
    for k in range(150):
        own = rng.choices(words, k=rng.randint(12, 60))
        if k % 5 == 0:
            own[3:3] = rng.sample(VILE, 2)
        texts.append(" ".join(own))
    found = [(k, t) for k, t in enumerate(texts)]
    found += [(200 + k, texts[k].replace(" ", "\n  ")) for k in range(1, 20, 3)]  # equal without white space, longer
    found += [(300 + k, t) for k, t in enumerate(edited_texts(4))]
    found += [(400, None), (401, ""), (402, " \t "), (None, "nobody knows this text at all"), (403, "twice the same id"), (403, "another text of that id"), (404, texts[2]), (404, texts[2])]
    return [(i, t, "en", [None, "b", "a", "c"][(i or 0) % 4], len(t or "")) for i, t in found]


ROWS = made_rows()
LABELS = [(i, 1 - (i % 7 == 0), int(i % 5 == 0)) for i in range(0, 140)] + [(3, 1, 0), (None, 1, 1), (5, None, 1)]


@pytest.fixture(scope="module")
def folder_of(spark, tmp_path_factory):
    def write(rows, labels, name):
        at = tmp_path_factory.mktemp(name)
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        return str(at)

    return write


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def drawn(i):
    h = xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)
    return h - (1 << 64) if h >> 63 else h


def plain_features(text):
    low = text or ""
    words = {w for w in re.findall(r"[^\W\d_]+", low.lower())}
    n = max(1, len(low))
    letters, blank = sum(c.isalpha() for c in low), sum(c.isspace() for c in low)
    capital, digit = sum("A" <= c <= "Z" for c in low), sum(c.isdigit() for c in low)
    return words, [math.log1p(len(low)) / 10, (n - letters - blank - digit) / n, capital / n, digit / n, sum(map(len, words)) / max(1, len(words)) / 10]


def plain_words(sets, y):
    out = []
    for w in sorted(set().union(*sets)):
        a = [sum(1 for s, v in zip(sets, y, strict=True) if v == side and w in s) for side in (0, 1)]
        if sum(a) >= 3:
            b = [y.count(side) - a[side] for side in (0, 1)]
            h = [x + 0.5 for x in (a[1], b[0], a[0], b[1])]
            z = abs(math.log(h[0] * h[1] / (h[2] * h[3]))) / math.sqrt(sum(1 / x for x in h))
            if z >= 2.5:
                out.append((-round(z, 12), w))
    return [w for _, w in sorted(out)[:256]]


def plain_logistic(x, y):
    """Weights by least squares on reweighted rows, with a row for each weight's penalty."""
    x, y, w = np.array(x), np.array(y, float), np.zeros(len(x[0]))
    pull = np.sqrt(np.array([1e-6] + [1.0] * (len(w) - 1)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        v = np.sqrt(p * (1 - p))
        w = np.linalg.lstsq(np.vstack([x * v[:, None], np.diag(pull)]), np.concatenate([v * (x @ w) + (y - p) / v, np.zeros(len(w))]), rcond=None)[0]
    return w


def plain_chain(rows, labels):
    """Probabilities of every row, and whether it is rejected, by the chain of quality and toxicity."""
    known = {}
    for i, q, t in labels:
        if i is not None and q is not None and t is not None:
            old = known.get(i, (0, 0))
            known[i] = (max(old[0], 1 - q), max(old[1], t))
    place = {i: k % 5 for k, i in enumerate(sorted(known, key=lambda i: (drawn(i), i)))}
    train = [(place[i], *plain_features(t), known[i]) for i, t, *_ in rows if i in known]
    everything = [plain_features(t) for _, t, *_ in rows]
    before, later, limit = [[] for _ in train], [[] for _ in rows], 0.0
    line = lambda s, style, earlier, told: [1.0, *style, *earlier, *(float(w in s) for w in told)]
    chance = lambda x, w: 1 / (1 + math.exp(-float(np.dot(x, w))))
    for c in (0, 1):
        y = [k[c] for *_, k in train]
        held = [0.0] * len(train)
        for fold in range(5):
            own = [n for n, t in enumerate(train) if t[0] != fold]
            told = plain_words([train[n][1] for n in own], [y[n] for n in own])
            w = plain_logistic([line(train[n][1], train[n][2], before[n], told) for n in own], [y[n] for n in own])
            for n in set(range(len(train))) - set(own):
                held[n] = chance(line(train[n][1], train[n][2], before[n], told), w)
        told = plain_words([t[1] for t in train], y)
        w = plain_logistic([line(t[1], t[2], b, told) for t, b in zip(train, before, strict=True)], y)
        ranked = sorted(zip(held, y, strict=True), key=lambda x: -x[0])
        scored = []
        for n in range(len(ranked)):
            nxt = ranked[n + 1][0] if n + 1 < len(ranked) else 0.0
            if nxt != ranked[n][0]:
                scored.append((2 * sum(v for _, v in ranked[: n + 1]) / (n + 1 + sum(y)), -n, (ranked[n][0] + nxt) / 2))
        limit = max(scored)[2]
        for b, h in zip(before, held, strict=True):
            b.append(h)
        for n, (s, style) in enumerate(everything):
            later[n].append(chance(line(s, style, later[n], told), w))
    return later, [p[-1] > limit for p in later]


def plain_copies(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), order(r[0]))) for g in groups.values()]


def plain_near(rows):
    """Of each group of rows with an id the one of the smallest id; rows without one stay."""
    keys = list(range(len(rows)))
    root = brute_components(keys, [r[1] for r in rows])
    groups = defaultdict(list)
    for k in keys:
        groups[root[k]].append(rows[k])
    out = []
    for g in groups.values():
        named = [r for r in g if r[0] is not None]
        out += [r for r in g if r[0] is None] + ([min(named, key=lambda r: r[0])] if named else [])
    return out


def plain_size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(rows):
    size = Counter()
    for r in rows:
        size[r[3]] += plain_size(r[1])
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight, free, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set(names), {}
    while free:
        rate = (1.5 * sum(size.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rate > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in over} or {s: weight[s] * rate for s in free}
        free = free - over if over else set()
    return size, target, {s: (-0.5, 0.0, 0.5)[k % 3] for k, s in enumerate(names)}


def plain_mix(rows):
    """(training time, row) of each reading: a source is read in the order of its ids' MD5, over and over, to its target."""
    size, target, ramp = plain_targets(rows)
    out = []
    for s in size:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), r[0] or 0, plain_size(r[1])))
        at = 0
        for _ in range(2):
            for r in own:
                n = plain_size(r[1])
                if n and at < math.floor(target[s]):
                    done, a = at / target[s], ramp[s]
                    out.append((done if a == 0 else (math.sqrt((1 - a) ** 2 + 4 * a * done) - (1 - a)) / (2 * a), r))
                at += n
    return out


def plain_pieces(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            out[r[0], k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])] += 1
    return out


def got_pieces(found):
    return Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)


def assert_packed(found):
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    first_fit = []
    for n in sorted((r["length"] for r in found), reverse=True):
        spot = next((k for k, room in enumerate(first_fit) if room >= n), None)
        if spot is None:
            first_fit.append(4096 - n)
        else:
            first_fit[spot] -= n
    assert len(bins) <= len(first_fit)


def test_toxicity_is_the_plain_chain(spark, folder_of):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({"id": F.lit("x"), "fold": F.lit(1), "words": F.lit("y")})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    chain = toxicity.trained(docs, labels)
    found = {(r["id"], r["n"]): r for r in toxicity.judged(docs, chain).groupBy("id", F.round("toxic", 4), "low_quality", "toxic", "rejected").agg(F.count("*").alias("n")).collect()}
    later, rejected = plain_chain(ROWS, LABELS)
    got = sorted(((order(r["id"]), round(r["low_quality"], 4), round(r["toxic"], 4), r["rejected"]) for r in toxicity.judged(docs, chain).collect()), key=repr)
    want = sorted(((order(r[0]), round(p[0], 4), round(p[1], 4), bad) for r, p, bad in zip(ROWS, later, rejected, strict=True)), key=repr)
    assert found and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and a[3] == b[3] and a[1] == pytest.approx(b[1], abs=2e-4) and a[2] == pytest.approx(b[2], abs=2e-4)
    assert 10 < sum(rejected) < 60
    stage = corpus_pipeline.drop_toxic(spark, docs, folder_of(ROWS, LABELS, "toxic"))
    assert pairs(stage) == Counter((r[0], r[1]) for r, bad in zip(ROWS, rejected, strict=True) if not bad)


def test_copies_are_the_plain_groups(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert pairs(corpus_pipeline.drop_copies(spark, docs, "")) == Counter((r[0], r[1]) for r in plain_copies(ROWS))


def test_near_copies_are_the_plain_groups(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got, want = pairs(corpus_pipeline.drop_near_copies(spark, docs, "")), Counter((r[0], r[1]) for r in plain_near(ROWS))
    assert got == want and sum(want.values()) < len(ROWS) - 15


def test_mix_reads_as_the_plain_mix(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    readings = plain_mix(ROWS)
    found = corpus_pipeline.mix(spark, docs, "")
    assert pairs(found) == Counter((r[0], r[1]) for _, r in readings)
    ordered = [(r["doc_id"], r["text"]) for r in found.collect()]
    times = defaultdict(list)
    for at, r in readings:
        times[r[0], r[1]].append(at)
    seen = Counter()
    at = -1.0
    for key in ordered:
        here = sorted(times[key])[seen[key]]
        seen[key] += 1
        assert here >= at - 1e-9
        at = max(at, here)


def test_pack_holds_every_piece(spark):
    docs = spark.createDataFrame([*ROWS, (900, "alpha beta " * 9000, "en", "a", 0)], SCHEMA)
    found = corpus_pipeline.pack(spark, docs, "").collect()
    assert got_pieces(found) == plain_pieces([*ROWS, (900, "alpha beta " * 9000)])
    assert_packed(found)


def test_run_is_the_plain_stages(spark, folder_of):
    found = corpus_pipeline.run(spark, folder_of(ROWS, LABELS, "run")).collect()
    _, rejected = plain_chain(ROWS, LABELS)
    left = [r for r, bad in zip(ROWS, rejected, strict=True) if not bad]
    left = [r for _, r in plain_mix(plain_near(plain_copies(left)))]
    assert got_pieces(found) == plain_pieces(left)
    assert_packed(found)


def test_stages_take_empty_tables_and_clashing_names(spark, folder_of):
    at = folder_of([], [], "none")
    assert corpus_pipeline.run(spark, at).count() == 0
    extra = ("row", "id", "position", "kept_row", "_hot", "size", "own_id", "sha", "component_id", "again_at")
    docs = spark.createDataFrame(ROWS[:40], SCHEMA).withColumns({c: F.lit(c) for c in extra})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == list(corpus_pipeline.COLUMNS)
    again = exact_dedup.deduplicated(spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(c) for c in ("id", "s", "c", "chars", "sha256")}))
    assert Counter((r["doc_id"], r["text"]) for r in again.collect()) == Counter((r[0], r[1]) for r in plain_copies(ROWS))


@pytest.fixture
def few(monkeypatch):
    """No list is short enough for a broadcast, and every third of the rows makes a key hot."""
    monkeypatch.setattr(rows, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(rows, "HOT", 3)


def test_long_lists_give_the_same_rows(spark, few):
    same = [(1000 + k, "the very same words stand here again") for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in ROWS] + same, "doc_id long, text string")
    everything = [(i, t, "", "", 0) for i, t, *_ in ROWS] + [(i, t, "", "", 0) for i, t in same]
    groups = {tuple(r) for r in exact_dedup.exact_groups(docs).select("id", "keep_id", "group_size", "kept").collect()}
    kept = plain_copies(everything)
    sizes = Counter(norm(r[1]) for r in everything)
    best = {norm(r[1]): r[0] for r in kept}
    assert groups >= {(r[0], best[norm(r[1])], sizes[norm(r[1])], True) for r in kept} and {g[:3] for g in groups} == {(r[0], best[norm(r[1])], sizes[norm(r[1])]) for r in everything}
    assert Counter((r["doc_id"], r["text"]) for r in exact_dedup.deduplicated(docs).collect()) == Counter((r[0], r[1]) for r in kept)
    near = Counter((r["id"], r["component_id"]) for r in simhash.near_copies(docs).collect())
    root = brute_components(list(range(len(everything))), [r[1] for r in everything])
    least = defaultdict(list)
    for r, k in zip(everything, root, strict=True):
        if r[0] is not None:
            least[k].append(r[0])
    assert near == Counter((r[0], min(least[k]) if r[0] is not None else None) for r, k in zip(everything, root, strict=True))


def test_long_lists_of_links_and_chunks(spark, few):
    rng = random.Random(3)
    links = [(0, k) for k in range(1, 80)] + [(100 + k, 101 + k) for k in range(30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    best = {n: n for ab in links for n in ab}
    for _ in best:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), workspace(spark, "links")).collect()}
    assert found == {n: r for n, r in best.items() if n != r}
    fps = [(k, "x y z w " * 3 if k % 3 else f"a{k} b c d e") for k in range(90)]
    marked = {r["id"]: (r["fp"], r["component_id"]) for r in simhash.near_groups(spark.createDataFrame(fps, "doc_id long, text string")).collect()}
    groups = defaultdict(list)
    for i, (fp, _) in marked.items():
        groups[fp].append(i)
    assert all(component <= min(groups[fp]) for fp, component in marked.values())
    docs = spark.createDataFrame([(k, None if k % 2 else f"text number {k} " * 300) for k in range(80)], "doc_id long, text string")
    store = token_store.stored(docs, public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: crc([*(t.encode(f"text number {k} " * 300, add_special_tokens=False).ids if k % 2 == 0 else []), 2]) for k in range(80)}
    assert {r["doc_id"]: r["ids_crc32"] for r in token_store.read_back(store, spark).collect()} == want


def test_a_damaged_store_is_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text number {k} " * (k % 9)) for k in range(200)], "doc_id long, text string").repartition(4)
    store = token_store.stored(docs, public_tokenizers.path("byte_bpe_50k.json"), path=f"{tmp_path}/store")
    assert token_store.read_back(store, spark).count() == 200
    whole = spark.read.parquet(f"{store.path}/recipes")
    assert whole.count() == 200
    spark.createDataFrame(whole.where("doc_id <> 7").collect(), whole.schema).write.parquet(f"{tmp_path}/lost/recipes")
    swapped = whole.withColumn("doc_id", F.when(F.col("doc_id") == 3, 4).when(F.col("doc_id") == 4, 3).otherwise(F.col("doc_id")))
    swapped.write.parquet(f"{tmp_path}/swapped/recipes")
    for name in ("lost", "swapped"):
        spark.read.parquet(f"{store.path}/manifest").write.parquet(f"{tmp_path}/{name}/manifest")
        spark.read.parquet(f"{store.path}/objects").write.partitionBy("kind").parquet(f"{tmp_path}/{name}/objects")
        with pytest.raises(ValueError, match="manifest"):
            token_store.read_back(token_store.Store(f"{tmp_path}/{name}"), spark)


def test_search_by_row_with_long_and_huge_vectors(spark):
    rng = np.random.default_rng(9)
    long = [(k, x.tolist()) for k, x in enumerate(rng.normal(size=(60, 1536)))]
    huge = [(100 + k, (x * 1e160).tolist()) for k, x in enumerate(rng.normal(size=(30, 4)))]
    twice = [(20, long[3][1]), (20, long[4][1])]
    all_rows = long + huge + twice
    df = spark.createDataFrame(all_rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in block_search.search(df, F.col("vec_id") % 20 == 0, nearest=5, query_block=3, row_block=25).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    want = defaultdict(list)
    for q, (i, a) in enumerate(all_rows):
        if i % 20 == 0:
            with np.errstate(over="ignore", invalid="ignore"):
                scored = [(block_search.inner(np.array([a]), np.array([b]))[0], j) for k, (j, b) in enumerate(all_rows) if k != q and len(a) == len(b)]
            nearest = sorted(scored, key=lambda x: (-(x[0] if x[0] == x[0] else -math.inf), x[1]))[:5]
            want[i] += [(n, j) for n, (_, j) in enumerate(nearest, 1)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len(got[20]) == 15


def test_urls_long_repeated_and_of_any_columns(spark):
    long = "http://x.net/" + "a/" * 200_000 + "casino"
    made = [(1, long), (1, long), (2, "http://x.net/free/bonus"), (3, "http://x.net/free/free"), (4, "HTTP://X.NET/CASINO"), (5, "")]
    df = spark.createDataFrame(made, "page_id long, url string").withColumns({c: F.lit("z") for c in ("id", "path", "rule", "verdict", "weight")})
    assert sorted((r["id"], r["verdict"]) for r in url_filter.judged(df).collect()) == [(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "block"), (5, "allow")]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, folder, name):
    assert_same(registry.QUERIES[name](spark, folder), registry.ORACLES[name], folder)


@pytest.mark.parametrize("together", [simhash.TOGETHER, 250])
def test_near_candidates_come_from_the_covering_tables(spark, monkeypatch, together):
    """Alike texts whose fingerprints differ by one to four bits, by more, in the same part and in another; and equal ones of unlike texts."""
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = random.Random(13)
    base = [[f"w{rng.randrange(50000)}" for _ in range(120)] for _ in range(9)]
    texts, marks = [], []
    far = lambda: rng.getrandbits(63)
    flipped = lambda fp, bits: fp ^ sum(1 << b for b in rng.sample(range(63), bits))
    for k, words in enumerate(base[:8]):  # a text and one with a word changed; the k-th pair differs by k bits in part k
        fps = [far() for _ in range(33)]
        edited = [flipped(fp, 20) for fp in fps]
        edited[k] = flipped(fps[k], k)
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
        marks += [fps, edited]
    texts += [" ".join(base[8]), " ".join([*base[8][:-1], "other"]), " ".join(reversed(base[0]))]
    shifted = [far() for _ in range(33)]
    marks += [shifted, [flipped(fp, 20) for fp in shifted[1:] + shifted[:1]], marks[0]]  # alike but unlinked; unlike with equal fingerprints
    marks[-2][5] = shifted[6]  # equal, but of another part
    sets = [simhash.distinct_hashes(t) for t in texts]
    made = [(k, k, bytes([k]) * 16, len(s), m) for k, (s, m) in enumerate(zip(sets, marks, strict=True))]
    at = workspace(spark, "candidates")
    docs = written(spark.createDataFrame(list(enumerate(texts)), "row long, text string"), f"{at}/rows")
    marked = written(spark.createDataFrame(made, "id long, row long, node binary, n long, parts array<long>"), f"{at}/sketches")
    found = {tuple(sorted((r["a"][0], r["b"][0]))) for r in simhash.near_links(docs, marked, at, "row").collect()}
    assert found == {(2 * k, 2 * k + 1) for k in range(5)}
    sketch = {r["id"]: r["parts"] for r in simhash.sketches(docs, "row", "row", "text").collect()}
    assert all(sketch[k][0] % (1 << 64) == simhash.fingerprint(s) and len(sketch[k]) == 33 for k, s in enumerate(sets))
