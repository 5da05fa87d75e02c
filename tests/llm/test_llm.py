"""Each operator against a brute-force version, on a small table of odd rows."""

import collections
import hashlib
import html
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import decontam, jaccard, langid, packing, rules, sharding, simhash, suffix, token_counts, token_files, tokens, wrappers

LONG = " ".join(f"word{i % 977} über" for i in range(6000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seventeen small birds watch from a tall green tree and sing about it"
TEXTS = [
    None, "", " \n\t ", "One two three.", "one TWO three.", PASSAGE, PASSAGE + " again", "x " + PASSAGE, "Heer " * 60, "ab" * 200,
    LONG, LONG, "<|endoftext|> hi <|endoftext|>", "naïve  café\n\nline\nline\n" + PASSAGE, "日本語 のテキスト", "#*$ %& |<>", "\x00 odd \x85 blank s",
]


@pytest.fixture(scope="module")
def docs(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    rows = [(i, t, None if i % 5 == 0 else "en", "extra", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, n_words int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def by_id(df):
    return sorted(map(tuple, df.collect()))


def encoded(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write(docs, str(tmp_path / "a"), path, 2)
    want, at = [], 0
    for i, ids in enumerate(encoded("word_bpe_49k.json")):
        want.append((i, at, len(ids) + 1, crc(ids + [2])))
        at += len(ids) + 1
    assert by_id(token_files.read(spark, str(tmp_path / "a"))) == want
    token_files.write(empty, str(tmp_path / "b"), path, 2)
    assert by_id(token_files.read(spark, str(tmp_path / "b"))) == []


@pytest.mark.parametrize("n", [1, 2, 63, 64, 1000])
def test_elias_fano(n):
    values = np.cumsum(np.random.default_rng(n).integers(0, 90, n))
    coded = token_files.EliasFano.from_bytes(token_files.EliasFano.build(values).to_bytes())
    assert coded.select(np.arange(n)).tolist() == values.tolist()
    assert [int(coded.select(np.array([i]))[0]) for i in range(n)] == values.tolist()
    assert coded.directory.itemsize * len(coded.directory) <= len(coded.high) // 16


def test_token_block():
    ids, ends = np.arange(9, dtype=np.uint32), np.array([1, 1, 6, 9])
    got, coded = token_files.read_block(token_files.pack_block(ids, ends))
    assert [token_files.document(got, coded, i).tolist() for i in range(4)] == [[0], [], [1, 2, 3, 4, 5], [6, 7, 8]]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    """Random texts of odd pieces, through a cache so small that it forgets all the time."""
    library = Tokenizer.from_file(public_tokenizers.path(name))
    enc = tokens.Encoder(public_tokenizers.path(name), max_cached=20)
    rng = np.random.default_rng(5)
    pieces = ["the", "The", "über", "ÿ", "12", "7a", "a1b22", "don't", "'s", "x.", "...", "a\nb", "\n", "a\n", "\nb", "a\n\nb", "a\tb", "<|endoftext|>", "<|", "é", "e\u0301", "日本", "\u00a0", "\x85", "", " ", "#*", "_", "a_b", "ß", "İ", "\x00"]
    for _ in range(60):
        texts = ["".join(rng.choice(pieces) + (" " if rng.random() < 0.7 else "") for _ in range(rng.integers(0, 12))) for _ in range(20)]
        ids, off = enc.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_sharding(docs, empty):
    nodes = sharding.tree(16)

    def draw(key, node, path):
        if not isinstance(node, dict):
            return int(path.rsplit("/", 1)[1])
        if len(node) == 1:
            name = next(iter(node))
        else:
            straws = []
            for i, (name, child) in enumerate(node.items()):
                seed = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42)
                h = xxhash.xxh64_intdigest(f"{path}/{name}", seed) & ((1 << 52) - 1)
                straws.append((np.log((h + 0.5) / (1 << 52)) / sharding._weight(child), -i, name))
            name = max(straws)[2]
        return draw(key, node[name], f"{path}/{name}")

    rows = sharding.assign(docs, nodes).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        raw = (TEXTS[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.shard == draw(r.doc_id, nodes, "")
        assert r.grown_shard in (r.shard, 16)
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.assign(empty, nodes).collect() == []


def test_sharding_spreads_and_takes_null_ids(spark):
    got = sharding.assign(spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")), sharding.tree(16))
    counts = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(counts) == 16 and min(counts) > 1000 and max(counts) < 1500
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert sorted(r.slot for r in sharding.assign(nulls, sharding.tree(16)).collect()) == [0, 1, 2]


def test_token_counts(spark, docs, empty, tmp_path):
    cache, path = str(tmp_path / "cache"), public_tokenizers.path("byte_bpe_50k.json")
    want = [(i, len((t or "").encode()), len(e), len(e) > 512) for i, (t, e) in enumerate(zip(TEXTS, encoded("byte_bpe_50k.json")))]
    assert by_id(token_counts.count(docs, cache, path)) == want
    before = token_counts.open_cache(spark, cache).count()
    assert before == len({t or "" for t in TEXTS})
    assert by_id(token_counts.count(docs, cache, path)) == want
    assert token_counts.open_cache(spark, cache).count() == before
    assert token_counts.count(empty, cache, path).collect() == []


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = [e + [0] for e in encoded("byte_bpe_50k.json")]
    rows = packing.pack(docs, path).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, e in enumerate(ids):
        assert [x for a, n in sorted(pieces[i]) for x in range(a, a + n)] == list(range(len(e)))
    for s in sequences.values():
        assert sum(n for _, n in s) <= 1024
        assert [x for a, n in sorted(s) for x in range(a, a + n)] == list(range(sum(n for _, n in s)))
    assert packing.pack(empty, path).collect() == []


def test_packing_limits():
    """Three binding limits, against a plain loop over all waiting documents."""
    limits = (64, 4, 50)
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 150, 300)
    losses = rng.integers(0, lengths + 1)
    got = list(packing.Packer(*limits).pack(lengths, losses))

    free, sequence, want, waiting = list(limits), 0, [], set(range(300))

    def put(doc, start, length, loss):
        nonlocal free, sequence
        want.append((doc, start, length, sequence, limits[0] - free[0]))
        free = [free[0] - length, free[1] - 1, free[2] - loss]
        if free[0] == 0 or free[1] == 0:
            free, sequence = list(limits), sequence + 1

    while waiting:
        fits = [d for d in waiting if lengths[d] <= free[0] and losses[d] <= free[2]]
        if fits:
            product = lambda d: lengths[d] * free[0] / limits[0] ** 2 + free[1] / limits[1] ** 2 + losses[d] * free[2] / limits[2] ** 2
            doc = max(fits, key=lambda d: (round(product(d), 12), -lengths[d], -losses[d], d))
            waiting.remove(doc)
            put(doc, 0, lengths[doc], losses[doc])
            continue
        doc = max(waiting, key=lambda d: (lengths[d], losses[d], d))
        waiting.remove(doc)
        start = 0
        while start < lengths[doc]:
            bears = [int(k >= lengths[doc] - losses[doc]) for k in range(start, lengths[doc])]
            take = max(k for k in range(len(bears) + 1) if k <= free[0] and sum(bears[:k]) <= free[2])
            if take:
                put(doc, start, take, sum(bears[:take]))
                start += take
            else:
                free, sequence = list(limits), sequence + 1
    assert [tuple(map(int, g)) for g in got] == [tuple(map(int, w)) for w in want]
    assert sum(g[2] for g in got) == lengths.sum() and len({g[3] for g in got}) < 1.6 * max(lengths.sum() / 64, losses.sum() / 50)
    assert list(packing.Packer(*limits).pack(np.zeros(0, np.int64), np.zeros(0, np.int64))) == []


def test_packing_loss_column(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    table = spark.createDataFrame([(None, "a b c d " * 30, 5), (1, "x " * 90, None), (1, None, 99), (1, None, 0)], "doc_id long, text string, n_loss int")
    rows = packing.pack(table.coalesce(1), path, max_tokens=64, max_segments=3, max_loss=16, loss="n_loss").collect()
    assert sum(r.length for r in rows) == sum(len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1 for t in ("a b c d " * 30, "x " * 90, "", ""))
    assert all(r.offset + r.length <= 64 for r in rows)
    assert collections.Counter(r.length for r in rows if r.doc_tokens == 91 or r.doc_tokens == 92).most_common(1)[0][0] == 16


def removed(rows, width=100):
    """(doc_id, bytes, removed, runs, sha256 of the rest) by a dictionary of all windows; rows in order."""
    seen, want = {}, []
    for place, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        for k in range(len(raw) - width + 1):
            seen.setdefault(raw[k : k + width], (place, k))
    for place, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        same = rows.index((i, t))
        for k in range(len(raw) - width + 1):
            if seen[raw[k : k + width]] < (same, k):
                gone[k : k + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return want


def test_suffix(docs, empty):
    found = suffix.find(docs)
    assert by_id(suffix.digest(found)) == removed(list(enumerate(TEXTS)))
    assert suffix.digest(suffix.find(empty)).collect() == []
    assert len(suffix.clean(found).collect()) == len(TEXTS)


@pytest.mark.parametrize("key_rows,sample", [(20_000, 4096), (2, 4096), (1, 0)])
def test_suffix_hot_keys(spark, key_rows, sample):
    """Shared passages in new contexts, near copies, periodic and repeated rows; blocks, keys and sample of any size."""
    rng = np.random.default_rng(8)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    line, passage = noise(60), noise(400)
    texts = [noise(int(rng.integers(0, 90))) + line + noise(int(rng.integers(0, 90))) for _ in range(60)]
    texts += [noise(30) + passage[int(rng.integers(0, 200)) :] + noise(30) for _ in range(40)]
    texts += [passage[:200] + str(k % 7) + passage[200:] for k in range(30)] + ["abc" * 100, "x" + "abc" * 90, "é" * 80, passage, "", "z" * 99]
    rows = list(enumerate(texts)) + [(500, passage + line)] * 40 + [(501, None)] * 3
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int").repartition(4)
    got = suffix.find(table, key_rows=key_rows, sample=max(1, sample), block_bytes=3000)
    assert by_id(suffix.digest(got)) == removed(rows)


def test_suffix_repeated_ids(spark):
    """Rows of one id or of none are documents of their own, in some order: one copy of each passage stays."""
    rng = np.random.default_rng(9)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage = noise(150)
    table = spark.createDataFrame([(i, str(k) * 60 + passage + str(k) * 60) for k, i in enumerate((None, None, 1, 1, 2))], "doc_id long, text string")
    got = suffix.digest(suffix.find(table)).collect()
    assert sorted(r.n_removed for r in got) == [0, 150, 150, 150, 150]
    assert [r.doc_id for r in got if not r.n_removed] == [None]


def test_two_stage_sort():
    rng = np.random.default_rng(3)
    for symbols in (2, 3, 200):
        text = rng.integers(0, symbols, 400).astype(np.uint8)
        text[-1] = 0
        raw = text.tobytes()
        order = suffix.two_stage_sort(text, 400)
        assert sorted(order.tolist()) == list(range(400))
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(400))


def test_rules(spark, docs, empty):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    want = []
    for i, t in enumerate(TEXTS):
        t = t or ""
        w = word.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if word.search(x)]
        want.append((i, len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    got = rules.judge(rules.features(docs), [])
    assert by_id(got.drop("kept")) == want
    assert all(r.kept != r.base_failed for r in got.collect())
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.learn(rules.features(empty), labels) == []


def test_rules_learn(spark):
    good = " ".join(f"plain{i}" for i in range(80))
    bad = " ".join(f"#${i}" for i in range(80))
    rows = [(i, bad if i % 3 == 0 else good, int(i % 3 != 0)) for i in range(120)] + [(None, good, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    feats = rules.features(table)
    learned = rules.learn(feats, table.select("doc_id", "quality"))
    assert learned
    assert all(r.kept == (r.doc_id % 3 != 0) for r in rules.judge(feats, learned).where("doc_id is not null").collect())


def test_rules_learn_a_rare_class(spark):
    # 1 bad row in 25, whose feature is 0 everywhere else: every 12th part of the rows ends at 0.
    good, bad = (" ".join(f"{mark}{i}" for i in range(80)) for mark in ("plain", "pla#n"))
    rows = [(i, bad if i % 25 == 0 else good, int(i % 25 != 0)) for i in range(750)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    feats = rules.features(table)
    learned = rules.learn(feats, table.select("doc_id", "quality"))
    assert all(r.kept == (r.doc_id % 25 != 0) for r in rules.judge(feats, learned).collect())


def test_simhash(docs, empty):
    prints = []
    for t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)))
    label = list(range(len(prints)))
    for _ in prints:
        label = [min(label[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 2) for p in prints]
    assert by_id(simhash.near_duplicates(docs)) == [(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, label))]
    assert simhash.near_duplicates(empty).collect() == []


def test_gray_index():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(9)]))
    index = simhash.GrayIndex(fps)
    index.link()
    near = np.bitwise_count(index.fps[:, None] ^ index.fps[None, :]) <= 2
    label = np.arange(len(fps))
    for _ in range(20):
        label = np.where(near, label[None, :], len(fps)).min(1)
    assert index.root.tolist() == label.tolist()


def test_growing_tree(spark):
    assert sharding.tree(17) == sharding.grow(sharding.tree(16)) and sharding.tree(18) == sharding.grow(sharding.tree(17))
    keys = spark.range(5000).select(*[sharding.shard_of(F.col("id"), sharding.tree(n)).alias(f"s{n}") for n in (16, 17, 20)]).collect()
    assert all(r.s17 in (r.s16, 16) and r.s20 in (r.s17, 17, 18, 19) for r in keys)
    assert {r.s20 for r in keys} == set(range(20))


def test_near_duplicates_stage(spark):
    rng = np.random.default_rng(11)
    words, line = [f"w{i}" for i in range(500)], " a line that stands in every one of these texts"
    texts = [None, "", "One two", "one  TWO", "one two three"]
    for _ in range(25):
        base = rng.choice(words, int(rng.integers(6, 120))).tolist()
        for changes in range(6):
            t = list(base)
            for at in rng.integers(0, len(t), changes):
                t[at] = "other"
            texts.append(" ".join(t) + line)
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))
    for _ in range(8):
        label = [min(label[j] for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)) for a in sets]
    docs = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string").repartition(5)
    assert by_id(corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id")) == [(i,) for i in sorted(set(label))]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").collect() == []


def test_near_duplicates_stage_takes_null_and_repeated_ids(spark):
    rows = [(None, "a unique text"), (None, "another unique text"), (7, "one text"), (7, "one text"), (7, "a second text"), (None, "ONE text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    assert got == [(0, "a unique text"), (0, "another unique text"), (7, "a second text"), (7, "one text")]


def test_stages_take_null_and_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(None, "a text", "s1"), (None, "a text too", "s2"), (7, "b text", "s3"), (7, "c text", "s4"), (7, PASSAGE, "s5"), (None, PASSAGE, "s6"), (8, long, "s7"), (8, long + " end", "s8")]
    docs = spark.createDataFrame([(i, t, None, s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def got(stage):
        return sorted(tuple(r) for r in stage(spark, docs, str(tmp_path)).select(F.coalesce("doc_id", F.lit(0)), "text", "source", "n_chars").collect())

    def want(sources, cut=()):
        return sorted((i or 0, dict(cut).get(s, t), s, len(dict(cut).get(s, t))) for i, t, s in rows if s in sources)

    every = [s for _, _, s in rows]
    assert got(corpus_pipeline.language) == want(every)
    # The passage stays in the row that comes first (null ids do); s8 follows s7 or the other way round, by text.
    left = got(corpus_pipeline.repeated_passages)
    assert [r for r in left if r[0] != 8] == [r for r in want([s for s in every if s != "s5"]) if r[0] != 8]
    assert sum(len(r[1]) for r in left if r[0] == 8) == len(long) + 4
    assert got(corpus_pipeline.benchmark_leaks) == want([s for s in every if s not in ("s5", "s6")])


def test_language(spark):
    texts = {"en": "the house and the tree with this", "de": "das haus und der baum mit dieser", "fr": "la maison et les arbres avec cette"}
    rows = [(i, f"{t} {i}", g) for i, (g, t) in enumerate(list(texts.items()) * 5)] + [(90, None, "en"), (91, "12 !", "en"), (92, "the tree", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.fit(table)
    got = {r.doc_id: r for r in langid.predict(table, profiles).collect()}
    assert all(got[i].lang_pred == (g or "en") for i, _, g in rows if i not in (90, 91))
    assert got[90].lang_pred == got[91].lang_pred == "und" and got[90].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(table.limit(0), profiles).collect() == []
    assert {r.lang_pred for r in langid.predict(table, langid.fit(table.limit(0))).collect()} == {"und"}


def windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()


@pytest.mark.parametrize("block_bytes", [1 << 20, 10])
def test_decontamination(spark, docs, empty, block_bytes):
    items = [(1, PASSAGE), (2, "One two, three"), (3, None), (4, "über"), (10, " ".join(LONG.split()[40:70])), (5, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in enumerate(TEXTS):
        w, _ = windows(t)
        hit, found = set(), set()
        for name, text in items:
            for p in windows(text)[1]:
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit |= set(range(k, k + len(p)))
                        found.add(str(name))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert by_id(decontam.digest(decontam.find(docs, bench, block_bytes))) == want
    assert decontam.digest(decontam.find(empty, bench)).collect() == []
    assert all(r.n_hit == 0 for r in decontam.digest(decontam.find(docs, bench.limit(0))).collect())


def test_decontamination_keeps_rows_of_one_id_apart(spark):
    rows = [(7, PASSAGE), (7, "clean words"), (7, "clean words"), (None, PASSAGE), (None, "more clean words here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, PASSAGE), (2, "not there at all"), (3, "birds watch")], "item_id long, text string")
    got = [sorted(map(str, decontam.digest(decontam.find(docs, bench, size)).collect())) for size in (1 << 20, 10)]
    assert got[0] == got[1] and len(got[1]) == len(rows)


def test_wrappers(spark):
    body = "<html><head><title>x</title><script>var a='</p>';</script></head><body><nav><a>Menu</a></nav>{}<footer>foot</footer></body></html>"
    pages = [
        (1, "http://a.org/1", body.format("<article><h1>T &amp; U</h1><p>One <b>two</b>\n three<p>Four<br>five</article>"), "One"),
        (2, "http://a.org/2", body.format("<article><h1>T</h1><div class='ad'>buy</div><p>x</p><section id=comments><p>no</p></section></article>"), ""),
        (3, "http://b.org/2", body.format("<div><p>plain</p><aside>no</aside></div>"), ""),
        (4, None, None, None),
        (5, "http://a.org/3", "", None),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    found = wrappers.infer(table)
    got = {r.page_id: r.text for r in wrappers.main_text(table, found).collect()}
    assert got == {1: "T & U\nOne two three\nFour five", 2: "T\nx", 3: "plain", 4: "", 5: ""}
    regions = {r.host: json.loads(r.plan)["region"] for r in found.collect()}
    assert regions == {"a.org": [wrappers._key(("html", "body", "article"))], "b.org": [wrappers._key(("html", "body", "div"))]}
    assert wrappers.main_text(table.limit(0), wrappers.infer(table.limit(0))).collect() == []


def test_wrappers_keep_the_main_region(spark):
    pages = {
        1: "<body class='home has-sidebar'><p>one</p></body>",
        2: "<body><div class='content with-sidebar'><p>two</p></div></body>",
        3: "<body><article class='post social'><p>three</p></article></body>",
        4: "<body><div class='article-header'><h1>Title</h1></div><p>four</p></body>",
        5: "<body><p>see <a href='/hidden-gems'>gems</a> and <a href=/p?id=menu>more</a></p><p data-id='menu'>five</p></body>",
        6: "<body><div class='sidebar wrap'><main><p>six</p><div class='comments'>x</div></main></div></body>",
        7: "<body><div class='widget'><p>all of the text</p></div><div class='menu'>go</div></body>",
    }
    table = spark.createDataFrame([(i, f"http://h{i}.org/", p) for i, p in pages.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_text(table, wrappers.infer(table)).collect()}
    assert got == {1: "one", 2: "two", 3: "three", 4: "Title\nfour", 5: "see gems and more\nfive", 6: "six", 7: "all of the text"}


def test_wrappers_drop_the_template_of_a_host(spark):
    html = "<body><div>Welcome to our site</div><article><h1>{0}</h1><p>text of {0}</p><p>Call us today</p></article></body>"
    rows = [(i, f"http://a.org/{i}", html.format(f"page {i}")) for i in range(4)] + [(9, "http://b.org/", html.format("copy")), (10, "http://b.org/2", html.format("copy"))]
    rows += [(20 + i, f"http://c.org/{i}", f"<body><div>Welcome</div><p>part {i}</p></body>") for i in range(3)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_text(table, wrappers.infer(table)).collect()}
    want = {i: f"page {i}\ntext of page {i}" for i in range(4)} | {i: "copy\ntext of copy\nCall us today" for i in (9, 10)}
    assert got == want | {20 + i: f"part {i}" for i in range(3)}


def tree(page):
    return wrappers.scan(page)[1]


def covers(node, page):
    """Whether a wrapper, as the regular expression that it is, matches the tree of a page; by brute force."""

    def item(mark, nodes):
        one = "(?:" + "|".join(expression(n) for n in nodes) + ")"
        return one + {"": "" if len(nodes) == 1 else "+", "?": "?", "+": "+", "*": "*"}[mark]

    def expression(n):
        return f"<{re.escape(n.kind)}>" + "".join(item(m, nodes) for m, nodes in n.items) + f"</{re.escape(n.kind)}>"

    def written(element):
        return f"<{element[0]}>" + "".join(written(x) for x in element[1]) + f"</{element[0]}>"

    def elements(items):
        # Pages of the test are plain: every tag is closed, no text matters.
        stack = [("", [])]
        for m in re.finditer(r"<(/?)([a-z0-9]+)>", items):
            if m[1]:
                done = stack.pop()
                stack[-1][1].append(done)
            else:
                stack.append((m[2], []))
        return stack[0]

    return re.fullmatch(expression(node), written(elements(page))) is not None


def test_wrapper_covers_its_pages():
    """Random pages: the aligned wrapper matches each of them, in any order, and stays small."""
    rng = np.random.default_rng(4)

    def element(depth):
        tag = str(rng.choice(["div", "section", "p", "h2", "ul", "table"]))
        if tag in ("p", "h2") or depth == 0:
            return f"<{tag}>text {rng.integers(0, 9)}</{tag}>"
        return f"<{tag}>" + "".join(element(depth - 1) for _ in range(rng.integers(1, 5))) + f"</{tag}>"

    for _ in range(20):
        pages = ["<body>" + "".join(element(2) for _ in range(rng.integers(1, 6))) + "</body>" for _ in range(12)]
        one = tree(pages[0])
        for p in pages[1:]:
            one = wrappers.align(one, tree(p))
        assert all(covers(one, p) for p in pages)
        parts = [wrappers.Node.load(json.loads(json.dumps(wrappers.align(tree(pages[k]), tree(pages[k + 1])).dump()))) for k in range(0, 12, 2)]
        other = parts[0]
        for p in parts[1:]:
            other = wrappers.align(other, p)
        assert all(covers(other, p) for p in pages)
        assert len(list(wrappers._paths(one))) <= 6 + 36 + 216


def test_wrapper_groups_and_bound():
    both = wrappers.align(tree("<body><p>a</p><p>b</p></body>"), tree("<body><h2>c</h2><p>d</p></body>"))
    assert both.regex() == "<><body>(<h2>#</h2>)?(<p>#</p>)+</body></>"
    assert tree("<body><p>a</p><ul>x</ul><p>b</p></body>").regex() == "<><body>((<p>#</p>)?(<ul>#</ul>)?)+</body></>"
    many = tree("<body>" + "".join(f"<div class='{chr(97 + k // 26)}{chr(97 + k % 26)}x'>text {k}.</div>" for k in range(300)) + "</body>")
    for k in range(50):
        many = wrappers.align(many, tree(f"<body><div class='q{chr(97 + k % 26)}{chr(97 + k // 2)}'>more {k}.</div></body>"))
    assert len(list(wrappers._paths(many))) <= wrappers.KINDS
    how = wrappers.plan(many)
    assert wrappers.extract("<body><div class='never-seen'>Some text here.</div></body>", how) == "Some text here."


def test_wrappers_decide(spark):
    """Class names alone drop nothing, and what a host repeats goes without any."""
    menu = '<div class="xq1">Home Products About</div>'
    text = lambda k: f"<p>Sentence {k} of this page is its own and long enough.</p><p>So is the one with number {k * 7}.</p>"
    pages = {k: ("plain.org", f"<body>{menu}<div class='zz'>{text(k)}</div><div class='yy'>All rights kept</div></body>") for k in range(4)}
    want = {k: f"Sentence {k} of this page is its own and long enough.\nSo is the one with number {k * 7}." for k in range(4)}
    inner = '<div class="social-history">The guilds of the town.</div><p class="notice-of-law">The law of 1848.</p><div class="share-prices">Wheat rose by 3.</div>'
    pages[10] = ("inner.org", f"<body><article>{text(1)}{inner}<div class='share-buttons'>Share this</div></article></body>")
    want[10] = want[1] + "\nThe guilds of the town.\nThe law of 1848.\nWheat rose by 3."
    pages[11] = ("broken.org", "<body><article><p class=\"x>One text.</p><p title='a > b'>Two</p><p>Three < four & five</article>")
    want[11] = "One text.\nTwo\nThree < four & five"
    pages[12] = ("single.org", f"<body>{menu}{text(3)}</body>")
    want[12] = want[3]
    pages[13] = ("long.org", "<body><article>" + text(5) * 3000 + "</article></body>")
    want[13] = "\n".join([want[1].replace("Sentence 1", "Sentence 5").replace("7.", "35.")] * 3000)
    pages[14] = ("deep.org", "<div>" * 5000 + "<p>Down here it is dark.</p>")
    want[14] = "Down here it is dark."
    rows = [(k, f"http://{h}/{k}", p) for k, (h, p) in pages.items()] * 2
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = wrappers.main_text(table, wrappers.infer(table)).collect()
    assert collections.Counter((r.page_id, r.text) for r in got) == collections.Counter(2 * list(want.items()))
    assert all(r.n_chars == len(r.text) for r in got)


def test_html_text_of_the_tables(spark):
    """On the given pages the main text is the article's, by a plain reading of it."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in wrappers.main_text(rows, wrappers.infer(rows)).collect()}
    for r in rows.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(11)
    for size in (1, 3, 40, 3000):
        pool = rng.integers(-(1 << 62), 1 << 62, size * 2)
        for _ in range(20):
            a, b = (np.unique(rng.choice(pool, size)) for _ in range(2))
            both = len(np.intersect1d(a, b))
            assert both <= jaccard.overlap_bound(jaccard.sketch(a), jaccard.sketch(b)) <= min(len(a), len(b)) + size // 4 + 1
    one = np.sort(rng.integers(-(1 << 62), 1 << 62, 400))
    assert jaccard.overlap_bound(jaccard.sketch(one), jaccard.sketch(one)) == 400
