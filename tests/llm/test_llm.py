import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sheaf.llm import block_search, exact_dedup, jump_shards, mixing, packing, simhash, token_store, tokens, toxicity, url_filter, warc
from sheaf.llm.components import components
from sheaf.llm.store import workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, size int, slot int, part int, row int"
LONG = "alpha beta gamma delta " * 6000
ROWS = [(1, "One two  three four five."), (2, "One two three\tfour five."), (3, None), (4, ""), (5, LONG), (6, LONG + "x"), (None, "six seven"), (8, "six seven"), (8, "six seven"), (9, "été ÀB　c \x1c d"), (10, "   ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 4 else f"s{(i or 0) % 3}", 0, 0, 0, 0, 0, 0) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def order(i):
    return (i is None, i or 0)


def encoded(name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_encode_as_whole_texts(name):
    own, plain = tokens.WordEncoder(public_tokenizers.path(name), cached=700), encoded(name, 7)
    texts = ["", " ", "a  b \n\n c", "it's we'll <|endoftext|> x", "café café İ 　 z", "end. of, all,,", "\x1c\x85q", *(t for _, t in ROWS if t)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|startoftext|>x<|endoftext|", "  <|endoftext|>\n ", "日本語のテキスト" * 40, "QUJD" * 3000]
    texts += ["a\nb\n\nc", "a\n\n\nb", "\n", "\n\n", " a", "a ", "a \n b", "a\n b", "\n\n b", "a\n\n b c", "\t a", "a \tb", "x\u00a0y \u2003z", "Éa. ÀB,, ñ!? ÿ ß µ ª", "don't can't's", "a_b -- ... '", "a\r\nb"]
    texts += ["".join(random.Random(k).choices("ab é\n\t.,'<ñ1 \u00a0", k=60)) for k in range(400)]
    for text in texts:
        assert np.frombuffer(own.encode(text, 7), "<u2").tolist() == plain(text)
    for most in (1, 300, 1 << 20):
        got = [ids[a:b].tolist() for _, _, ids, starts in own.batches(pa.array([*texts, None]), 7, most) for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
        assert got == [plain(text) for text in (*texts, "")]
    assert list(own.batches(pa.array([], pa.string()), 7)) == []
    text = "  a b  c   d. e\n f " * 9
    kept, tokens.PART = tokens.PART, 11
    assert np.frombuffer(own.encode(text, 7), "<u2").tolist() == plain(text)
    tokens.PART = kept


def test_token_store(spark, docs, none):
    store = token_store.stored(docs, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_back(store, spark).collect()))
    plain, at, want = encoded("byte_bpe_50k.json", 2), 0, []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(t)
        want.append((at, i, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    chunks = store.chunks(spark)
    assert chunks.count() == chunks.select("key").distinct().count() < store.recipes(spark).select(F.explode("digests")).count()
    assert store.manifest(spark).agg(F.sum("tokens")).first()[0] == at
    assert token_store.read_back(token_store.stored(none, public_tokenizers.path("byte_bpe_50k.json")), spark).count() == 0
    assert token_store.read_back(token_store.stored(docs.limit(1), public_tokenizers.path("byte_bpe_50k.json")), spark).count() == 1


def test_crc_of_joined_parts():
    a, b = b"some bytes", b"and more of them" * 70
    joined = token_store.crc_joined(np.array([zlib.crc32(a)], np.uint64), np.array([zlib.crc32(b)], np.uint64), np.array([len(b)], np.uint64))
    assert joined[0] == zlib.crc32(a + b)


def test_packing(docs, none):
    rows = packing.packed(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).collect()
    plain = encoded("word_bpe_49k.json", 1)
    want = sorted(((i, k, a, crc(ids[a : a + 4096])) for i, t in ROWS for ids in [plain(t)] for k, a in enumerate(range(0, len(ids), 4096))), key=repr)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in rows), key=repr) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.packed(packing.pieces(none, public_tokenizers.path("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_fullest_is_the_best_sum(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(3, 60, 7)}
    sums = {0}
    for k, n in counts.items():
        sums |= {s + k * j for s in sums for j in range(n + 1)}
    used = packing.fullest(counts, sorted(counts, reverse=True), 97)
    assert sum(used.elements()) == max(s for s in sums if s <= 97) and all(n <= counts[k] for k, n in used.items())


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, none, weak):
    digest = (lambda c: F.unhex(F.hex(F.length(c) % 2))) if weak else exact_dedup.digest128
    rows = exact_dedup.exact_groups(docs, digest=digest).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append((-len(t or ""), order(i), i))
    by = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[2], len(v)) for k, v in groups.items()}
    assert len(rows) == len(ROWS) and sum(r["kept"] for r in rows) == len(groups)
    assert all((r["keep_id"], r["group_size"]) == by[bytes(r["sha256"]).hex()] for r in rows)
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(norm(r["text"]) for r in kept.collect()) == sorted(groups)


def reference_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, docs, none):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(1000, 1400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_shards.jump(F.col("k"), 40).alias("j"))
    assert all(r["j"]["shard"] == reference_jump(r["k"] % 2**64, 40) for r in df.collect())
    rows = jump_shards.sharded(docs).collect()
    assert len(rows) == len(ROWS) and all(r["grown_shard"] in (r["shard"], 40) and r["grown_shard"] == reference_jump((r["id"] or 0) % 2**64, 41) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in ROWS)
    assert jump_shards.sharded(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(ROWS)
    source, taken, size, target = {}, defaultdict(int), defaultdict(int), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None or 0 <= r["position"] < 1)
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight, free, want = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set(names), {}
    while free:
        rate = (1.5 * sum(size.values()) - sum(want.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rate > 2 * size[s]}
        want |= {s: 2.0 * size[s] for s in over} or {s: weight[s] * rate for s in free}
        free = free - over if over else set()
    assert source == {} and all(target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) < 1 for s in names)
    assert mixing.mixed(none).count() == 0
    again = mixing.mixed(docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_near_copies(spark, docs, none):
    words = [f"word{k}" for k in range(200)]
    edited = [*words[:50], "other", *words[51:]]
    rows = [(4, " ".join(words)), (2, " ".join(edited)), (7, " ".join(words).upper()), (9, " ".join(words[::2])), (None, " ".join(words)), (11, None), (12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in simhash.near_copies(df).collect()} == {4: 2, 2: 2, 7: 2, 9: 9, None: None, 11: 11, 12: 11}
    assert simhash.near_copies(none).count() == 0


def shingle_sets(texts, k=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_components(ids, texts):
    """Each text's group by exact five-word Jaccard of 0.8 or more, over all pairs: the least id it connects to."""
    sets, best = shingle_sets(texts), list(ids)
    near = [(i, j) for i in range(len(ids)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if best[i] != best[j]:
                best[i] = best[j] = min(best[i], best[j])
                changed = True
    return best


def edited_texts(groups, size=220):
    """Of each group a text and its edits: tail cut off, words appended, words put in front, one word in many, and ones just below 0.8."""
    rng, out = np.random.default_rng(11), []
    words = lambda n: [f"w{x}" for x in rng.integers(0, 50000, n)]
    for _ in range(groups):
        base = words(size)
        out += [base, base[: int(size * 0.82)], base + words(int(size * 0.21)), words(int(size * 0.22)) + base]
        spread = list(base)
        for at in range(10, size, 60):
            spread[at] = "other"
        out += [spread, base[: int(size * 0.78)] + words(5), [*base[::2], *base[1::2]]]
    return [" ".join(t) for t in out]


def test_near_copies_of_block_edits(spark):
    texts = edited_texts(30)
    ids = [3 * k + 1 for k in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    want = dict(zip(ids, brute_components(ids, texts), strict=True))
    assert sum(k != v for k, v in want.items()) >= 120 and got == want


def test_near_copies_below_the_similarity_stay(spark):
    """Repeated lines, other orders, punctuation alone and edits just below 0.8 are no near copies."""
    line = [f"word{k}" for k in range(12)]
    base = [f"term{k}" for k in range(120)]
    texts = [" ".join(line), " ".join(line * 9), " ".join(reversed(line)), "! !", "... ?", "--", " ".join(base), " ".join(base[:96])]
    texts += [" ".join([*base[:60], "other", *base[61:]]), " ".join([*base[:20], "x", *base[21:50], "y", *base[51:90], "z", *base[91:]])]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert got == dict(zip(ids, brute_components(ids, texts), strict=True))
    assert [got[k] for k in (0, 1, 2, 3, 4, 5, 7)] == [0, 1, 2, 3, 4, 5, 7]


def test_near_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(2)
    base = [rng.choice(10000, 60, replace=False).astype(np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([b[rng.permutation(60)[: 60 - k]], rng.integers(20000, 90000, k).astype(np.uint64)])) for b in base for k in (0, 2, 4, 6, 8, 10)]
    root = list(range(len(sets)))
    for a, b in [*simhash.near_forest(sets), *simhash.near_forest(sets)]:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    want = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
                want = [min(want[i], want[j]) if r in (want[i], want[j]) else r for r in want]
    assert root == want and len(set(want)) < len(sets)


def test_fingerprints_and_groups(spark, docs, none):
    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), seed=42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = simhash.near_groups(docs).collect()
    assert sorted((order(r["id"]), r["fp"] % 2**64) for r in rows) == sorted((order(i), plain(t)) for i, t in ROWS)
    assert {r["component_id"] for r in rows if r["id"] in (3, 4, 10)} == {3}
    assert simhash.near_groups(none).count() == 0


@pytest.mark.parametrize("block", [7, 8192])
def test_links_find_every_component(spark, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(40):
            fps.add(int(b) ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(1, 7)), replace=False)))
    values = sorted(v - 2**64 if v >> 63 else v for v in fps)
    at = workspace(spark, "test")
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(df, at, block=block), f"{at}/c").collect()}
    best = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            m = min(best[b] for b in values if ((a ^ b) % 2**64).bit_count() <= 4)
            if m < best[a]:
                best[a], changed = m, True
    assert all(roots.get(v, v) == best[v] for v in values)


def test_masks_cover():
    masks = simhash.covering_masks(2, 12)
    for a in range(12):
        for b in range(12):
            assert any(m & (1 << a | 1 << b) == 0 for m in masks)


def test_block_search(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[10:200] = v[9]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [None] * 8, 0), (903, [float("nan")] * 8, 0), (904, [float("inf")] * 8, 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in block_search.search(df, F.col("vec_id") % 20 == 0, nearest=7, query_block=4, row_block=60).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    d = v.astype(np.float64)
    for q in range(0, 300, 20):
        score = {}
        for i in set(range(300)) - {q}:
            score[i] = 0.0
            for a, b in zip(d[q].tolist(), d[i].tolist(), strict=True):  # sum() would compensate rounding
                score[i] += a * b
        assert got[q] == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:7]
    few = df.where("vec_id < 3")
    assert block_search.search(few, F.col("vec_id") == 0).count() == 2
    assert block_search.search(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_warc(spark):
    page = "<p>" + "x" * 1200
    rows = [(1, "http://a/1", page), (2, "http://a/2", page), (3, None, "short"), (4, "http://a/4\r\nX: y", "short"), (5, "u", None), (None, "v", page), (7, "w", "é" * 700)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, same int")
    folder = workspace(spark, "warc")
    index = warc.archived(df, folder)
    found = {r["page_id"]: r for r in warc.records(index, folder).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in found.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 7: ("response", None)}
    assert all(found[k]["digest"] == hashlib.sha1((h or "").encode()).hexdigest() for k, _, h in rows)
    assert bytes(found[7]["payload"]) == ("é" * 700).encode() and found[1]["payload"] is None
    assert [r["page_id"] for r in warc.records(index.where("page_id = 3"), folder).collect()] == [3]
    assert warc.archived(df.limit(0), workspace(spark, "warc")).count() == 0


def test_ranges_are_joined():
    rows = [{"offset": o, "length": 10} for o in (0, 10, 30, 30 + 2 * warc.GAP, 30 + 2 * warc.SPAN)]
    assert [len(r) for r in warc.runs(rows)] == [3, 1, 1]


def test_url_filter(spark):
    rows = ["https://WWW.Example.org/es/1?x", "http://a.example.org/en/12", "http://example.org/de/", "http://x.com/fr/a", "http://x.com/de/a", "http://x.net", "http://free-bets.net/", "http://ads-track.net/a", "http://adstrack.net/", None, "no mark casino", "http://x.org", "http://b.net/ads/pads"]
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(rows)], "page_id long, url string, host string")
    got = [tuple(r)[1:5] for r in url_filter.judged(df).orderBy("id").collect()]
    assert got == [
        ("www.example.org", "/es/1", "example.org/es/", "block"),
        ("a.example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/de/", "org/", "allow"),
        ("x.com", "/fr/a", "com/fr/", "allow"),
        ("x.com", "/de/a", "com/de/", "block"),
        ("x.net", "", None, "allow"),
        ("free-bets.net", "/", None, "block"),
        ("ads-track.net", "/a", None, "block"),
        ("adstrack.net", "/", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "block"),
        ("x.org", "", None, "allow"),
        ("b.net", "/ads/pads", None, "allow"),
    ]
    own = url_filter.vocabulary(spark.createDataFrame([(" Pads", 1.0), ("ads", 1.0), ("ads", 0.5), ("", 9.0), (None, 1.0)], "term string, weight double"))
    assert own == {"pads": 1.0, "ads": 1.0}
    assert url_filter.judged(df.where("page_id = 12"), url_filter.UrlRules(weights=own)).first()["verdict"] == "block"
    assert url_filter.judged(df.limit(0)).count() == 0


def test_toxicity_on_held_out_documents(spark):
    rng = np.random.default_rng(1)
    words = ["w" + "".join(rng.choice(list("abcdef"), 5)) for _ in range(400)]
    texts, bad = [], []
    for k in range(600):
        own = list(rng.choice(words, 40))
        if k % 6 == 0:
            own += list(rng.choice(["vile", "nasty", "awful"], 2))
        texts.append(" ".join(own))
        bad.append(k % 6 == 0)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad[:400])] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.trained(docs, labels)
    got = {r["id"]: r["rejected"] for r in toxicity.judged(docs, chain).collect()}
    assert sum(got[i] != bad[i] for i in range(400, 600)) <= 2 and not got[9000] and not got[9001]
    assert toxicity.clean(docs, chain).count() == sum(not v for v in got.values())
    nothing = toxicity.trained(docs, labels.limit(0))
    assert toxicity.clean(docs, nothing).count() == docs.count()


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, folder).cache()
        assert docs.count() > 0, name
        if k < 4:
            assert docs.columns == before.columns
        if k < 3:
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()


def test_stages_tell_rows_of_one_id_apart(spark):
    """Null and repeated ids: an unrelated text of a near copy's id stays, and the mix reads each row by itself."""
    base, other = [f"word{k}" for k in range(150)], [f"term{k}" for k in range(90)]
    near, near2 = [*base[:70], "x", *base[71:]], [*base[:30], "y", *base[31:]]
    rows = [(1, base), (5, near), (5, other), (1, near2), (None, [f"own{k}" for k in range(40)]), (7, []), (8, other[:30] + base[:30])]
    docs = spark.createDataFrame([(i, " ".join(t), "en", f"s{len(t) % 2}", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stayed = corpus_pipeline.drop_near_copies(spark, docs, "")
    got = sorted(((r["doc_id"], r["text"]) for r in stayed.collect()), key=repr)
    assert len(got) == 5 and {(5, " ".join(other)), (None, " ".join(rows[4][1])), (7, ""), (8, " ".join(rows[6][1]))} <= set(got)
    assert sum(i == 1 for i, _ in got) == 1
    by_key = spark.createDataFrame([(k, i, " ".join(t), f"s{len(t) % 2}") for k, (i, t) in enumerate(rows)], "key long, doc_id long, text string, source string")
    readings = {(rows[r["row"]][0], " ".join(rows[r["row"]][1])): (r["position"] is not None) + (r["again_at"] is not None) for r in mixing.mixed(by_key, row_col="key").collect()}
    mixed = defaultdict(int)
    for r in corpus_pipeline.mix(spark, docs, "").collect():
        mixed[r["doc_id"], r["text"]] += 1
    assert any(i is None for i, _ in mixed) and max(mixed.values()) <= 2
    assert dict(mixed) == {k: v for k, v in readings.items() if v}


def test_warc_query_with_revisits(spark, tmp_path):
    """One payload with most rows, copies below the least length, repeated ids, nulls: as the SQL says."""
    long, short = "<p>é</p>" * 200, "<p>é</p>"
    rows = [(k, f"http://h.org/{k}", long) for k in range(300)] + [(k, f"http://h.org/{k}", short) for k in range(300, 320)]
    rows += [(400, "http://h.org/a", long[3:]), (401, None, long[3:]), (402, "http://h.org/b", None), (403, "http://h.org/c", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, warc.op3_warc(spark, str(tmp_path)).collect()), key=str)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        wanted = sorted(db.execute(warc.OP3_SQL).fetchall(), key=str)
    assert got == wanted
    assert sum(r[3] == "revisit" for r in got) == 300
