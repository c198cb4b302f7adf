"""The ten operators against brute force, and on odd rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import bpe, common, components, embedding_dedup, language, minhash_dedup, packing, quality, queries, suffix_dedup, token_output, topk, toxicity
from inkveil.llm.sstable import Reader, Writer, id_key

LONG = "the quick brown fox jumps over the lazy dog and runs home again " * 40
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau " + LONG, "x"),
    (2, None, "x"), (3, "", None), (4, " \n\t ", "x"), (5, "word", "y"), (6, LONG + "tail", None), (6, LONG + "tail", None),
    (None, "no id here at all", "x"), (7, "a" * 3000, "x"), (8, "é日本 😀 <|endoftext|> it's  two   blanks\x1c", "x"), (9, LONG + "tail", "z"), (-4, "word", "y"),
]
SCHEMA = "doc_id long, text string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_matches_the_library(spark, docs, empty):
    path, lib = queries.vocabulary("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    rows = docs.withColumn("ids", bpe.encode(F.col("text"), path)).withColumn("back", bpe.decode(F.col("ids"), path)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert r["back"] == lib.decode(want, skip_special_tokens=False)
    assert empty.select(bpe.encode(F.col("text"), path)).count() == 0


def test_bpe_on_all_kinds_of_characters():
    path, lib = queries.vocabulary("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    texts = ["".join(f"{chr(c)}a {chr(c)} {chr(c)}1" for c in range(s, s + 256) if not 0xD800 <= c < 0xE000) for s in range(0, 0x3000, 256)]
    got = bpe.model(path).encode_batch(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_token_shards_round_trip(spark, docs, empty):
    lib = tokenizer("word_bpe_49k.json")
    out = token_output.shard_folder(spark)
    shards = token_output.write_shards(docs, out, queries.vocabulary("word_bpe_49k.json"), end_id=1)
    got = token_output.read_back(spark, out, shards).collect()
    want = sorted(((i is not None, i or 0, t or "") for i, t, _ in ROWS))
    start = 0
    for r, (known, i, t) in zip(sorted(got, key=lambda r: r["start"]), want):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (i if known else None, start, ids)
        start += len(ids)
    table = token_output.ShardSet(out)
    assert token_output.manifest(out) == shards
    assert table.get(5).tolist() == [*lib.encode("word", add_special_tokens=False).ids, 1]
    assert table.get(6, 1) is not None and table.get(6, 2) is None and table.get(10**9) is None
    out2 = token_output.shard_folder(spark)
    assert token_output.read_back(spark, out2, token_output.write_shards(empty, out2, queries.vocabulary("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("context", ["a{}b", "1{}2", "!{}?", "{0}{0}"])
def test_words_are_cut_as_the_library_does(context):
    """Every character of the basic plane and the pictographs beside letters, numbers and others."""
    t = token_output.tokenizer(queries.vocabulary("word_bpe_49k.json"))
    known = [c for c in [*range(0x10000), *range(0x1F300, 0x1F700), 0x107BB, 0x1D400, 0x1D7CE, 0x1E6FF, 0x20000, 0x10FFFF] if not 0xD800 <= c < 0xE000]
    texts = [context.format(chr(c)) for c in known]
    t.cache.forget()
    assert [hex(c) for c, a, b in zip(known, t._library(texts), t.encode_batch(texts)) if a != b] == []
    assert t.encode_batch(["a\U000107bb😀", "\U000190ff\U00015004"]) == t._library(["a\U000107bb😀", "\U000190ff\U00015004"])


def test_many_words_are_one_call_of_the_library(monkeypatch):
    t = token_output.WordTokenizer(queries.vocabulary("word_bpe_49k.json"))
    words = ["abc", "'s", "'", "s", "\u00e9t\u00e9", "\u4e2d\u6587", "\U0001f389\U0001f389", ',"', "1", "</", "w", ">", "\u0301", "\u00df\u01c5", "a" * 300]
    alone = t._library(words)
    monkeypatch.setattr(t, "_library", lambda words: pytest.fail("a call a word"))
    assert t._words(words) == alone


def test_a_repeated_identifier_spans_shards(spark):
    rows = [(7, f"text number {k}") for k in range(400)] + [(k, "x") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = token_output.shard_folder(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards = token_output.write_shards(df, out, queries.vocabulary("word_bpe_49k.json"), end_id=1)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table, lib = token_output.ShardSet(out), tokenizer("word_bpe_49k.json")
    got = sorted(table.get(7, k).tolist() for k in range(400))
    assert got == sorted([*lib.encode(t, add_special_tokens=False).ids, 1] for i, t in rows if i == 7)
    assert table.get(7, 400) is None and table.get(3) is not None and len(shards) > 1


def test_sorted_string_table(tmp_path):
    keys = [id_key(k * 3 - 500, 0) for k in range(1000)]
    with open(tmp_path / "t", "wb") as f:
        w = Writer(f)
        for k in keys:
            w.add(k, k * 40)
        w.close()
    r = Reader(open(tmp_path / "t", "rb"))
    assert [k for k, _ in r] == keys and len(r.keys) > 0
    assert all(r.get(k) == k * 40 for k in keys)
    assert all(r.get(id_key(k * 3 - 499, 0)) is None for k in range(1000))


def naive_repeats(rows, window=suffix_dedup.WINDOW):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if w in seen:
                gone[p : p + window] = True
            seen.add(w)
        out.append((i, len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def repeat_rows():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghé"), 5))
    passages = [" ".join(word() for _ in range(n)) for n in (12, 20, 30, 60, 17)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.integers(3, 40)))]
        for _ in range(rng.integers(0, 4)):
            parts += [passages[rng.integers(len(passages))], " ".join(word() for _ in range(rng.integers(0, 20)))]
        rows.append((i, " ".join(parts)))
    return [*rows, (60, "z" * 400), (61, "ab" * 200), (62, rows[5][1]), (63, None), (64, "")]


@pytest.mark.parametrize("hot", [1000, 6])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK_ROWS", 9)
    rows = repeat_rows()
    got = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got) == naive_repeats(rows)


def test_repeats_on_odd_rows(spark, docs, empty):
    got = suffix_dedup.repeats(docs).collect()
    assert len(got) == len(ROWS)
    assert Counter(r["n_removed"] for r in got if r["doc_id"] == 6)[len(LONG) + 4] >= 1
    assert suffix_dedup.repeats(empty).count() == 0
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and 0 < out.count() < len(ROWS)


@pytest.mark.parametrize("seed", range(4))
def test_windows_are_looked_at_only_where_suffixes_meet(monkeypatch, seed):
    random, calls = np.random.default_rng(seed), []
    mix = suffix_dedup.rolling.mix
    monkeypatch.setattr(suffix_dedup.rolling, "mix", lambda h: calls.append(1) or mix(h))
    contexts = [bytes(random.integers(97, 123, 168, np.uint8)) for _ in range(6)]
    left, low, high = np.full(6, 68), np.full(6, 0), np.full(6, 68)
    found = suffix_dedup.repeated_windows(contexts, left, np.zeros(6, np.int64), low, high)
    assert not len(found[0]) and not calls
    # of two groups; the first shares bytes 20 to 150 among three of its members
    contexts = [contexts[0], *(c[:20] + contexts[0][20:150] + c[150:] for c in contexts[1:3]), contexts[3], contexts[4][:60] + contexts[3][60:], contexts[5]]
    group = np.array([0, 0, 0, 1, 1, 1])
    m, o = suffix_dedup.repeated_windows(contexts, left, group, low, high)
    seen, expected = set(), set()
    for k, c in enumerate(contexts):
        for offset in range(69):
            window = group[k], offset, c[68 - offset : 168 - offset]
            expected |= {(k, offset)} if window in seen else set()
            seen.add(window)
    assert set(zip(m.tolist(), o.tolist())) == expected and len(m) == len(expected) > 60


def test_suffix_order():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab"), rng.integers(1, 30))).encode() for _ in range(300)]
    group = np.sort(rng.integers(0, 7, 300))
    order = suffix_dedup.Suffixes(texts, np.zeros(300, np.int64), group).sort()
    assert [(group[k], texts[k]) for k in order] == sorted((group[k], texts[k]) for k in range(300))


def naive_components(pairs, nodes):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = naive_components(pairs, range(200))
    assert all(got.get(n, n) == want[n] for n in range(200))


def test_minhash_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(6):
        base = [f"w{x}" for x in rng.integers(0, 3000, 120)]
        for k in range(60 if g == 0 else 8):
            w = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 14)):
                w[at] = f"v{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w).title() if k % 2 else " ".join(w)))
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    sets = {i: {tuple(t.lower().split()[k : k + 2]) for k in range(len(t.split()) - 1)} for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = naive_components(pairs, sets)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_minhash_on_odd_rows(docs, empty):
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == -4 and by[9]["component_id"] == 6 and by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_words_that_collide_as_polynomials(spark):
    a = "a"
    while len(a) < 1024:  # a word of Thue and Morse, and its complement
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    x, y = minhash_dedup.shingle_sets([f"x {a} y {b} x", f"x {b} y {a} x"], 2)
    assert not np.intersect1d(x, y).size
    df = spark.createDataFrame([(1, f"x {a} y {b} x"), (2, f"x {b} y {a} x"), (3, a), (4, b), (5, a.upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df, words=2).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_common_shingles():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 500, 200).astype(np.uint64)) for _ in range(9)]
    got = minhash_dedup.common_shingles(sets[:4], sets[4:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


VECTORS = [
    (1, [1.0, 0.0, 0.0, 1.0], 1), (2, [1.0, 0.01, 0.0, 1.0], 1), (3, [1.0, 0.0, 0.0, 1.0], 2), (4, None, 1), (5, [0.0] * 4, 1), (6, [float("nan"), 1.0, 1.0, 1.0], 1),
    (7, [1.0, 0.0, 0.0, 1.0], None), (50, [1.0, 0.0, 0.0, 1.0], 1), (50, [-1.0, 0.0, 0.0, 1.0], 1), (100, [3e38, 3e38, -3e38, 3e38], 1), (150, [1.0, 2.0], 1), (151, [], 1), (None, [1.0, 0.0, 0.0, 1.0], 1), (200, [None, 1.0, 0.0, 1.0], 1),
]


def test_embeddings_on_odd_rows(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(VECTORS)
    by = {r["vec_id"]: r for r in got if r["vec_id"] not in (50, None)}
    assert (by[1]["n_links"], by[1]["component_id"], by[2]["component_id"]) == (2, 1, 1)
    assert all(by[k]["n_links"] == 0 and by[k]["kept"] for k in (3, 4, 5, 6, 7, 100, 150, 151, 200))
    assert embedding_dedup.near_duplicates(df.filter("vec_id < 0")).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((25, 16))
    x = np.vstack([b + 0.12 * rng.standard_normal((k, 16)) for b, k in zip(base, [300, *[6] * 24])]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(1000 + i, x[i].tolist(), i % 2) for i in range(40)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    m = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = (m @ m.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(link, False)
    found = sum(got[r[0]]["n_links"] for r in rows) / link.sum()
    assert 0.97 <= found <= 1.0
    assert all(got[r[0]]["n_links"] <= n for r, n in zip(rows, link.sum(1)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.held_out_recall(df, embedding_dedup.near_duplicates(df)) >= 0.97


def test_visits_equal_a_heap():
    import heapq

    rng = np.random.default_rng(2)
    index = embedding_dedup.MultiIndex(rng.standard_normal((7, 3)), rng.standard_normal((5, 3)))
    x = rng.standard_normal((40, 6))
    a, b = index.halves(x)
    for index.margin in (0.0, 1.5, 100.0):
        for row, cells in enumerate(index.visits(x)):
            heap = [(a[row, i] + b[row, j], i * 5 + j) for i in range(7) for j in range(5)]
            heapq.heapify(heap)
            least, want = heap[0][0], []
            while heap and heap[0][0] <= least + index.margin:
                want.append(heapq.heappop(heap)[1])
            assert cells.tolist() == want


def test_embeddings_beside_a_hot_group(spark):
    rng = np.random.default_rng(3)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)

    def near(b, cosine):
        w = rng.standard_normal(b.shape)
        w = unit(w - (w * b).sum(1, keepdims=True) * b)
        return cosine * b + np.sqrt(1 - cosine**2) * w

    a = unit(rng.standard_normal((1000, 64)))
    pairs = np.vstack([a, near(a, rng.uniform(0.932, 0.95, (1000, 1)))])
    x = np.vstack([pairs, near(np.repeat(unit(rng.standard_normal((1, 64))), 1000, 0), 0.99)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(got[i] >= 1 for i in range(2000)) >= 0.999 * 2000


def test_top_k_on_odd_rows(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=3).collect()
    ok = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v, _ in VECTORS if i is not None and v and None not in v and not np.isnan(v).any()]
    want = Counter()
    for i, q in ok:
        if i % 50 == 0:
            top = sorted((-min(max(sum(a * b for a, b in zip(q, c)), -(1 << 63)), (1 << 63) - 1), j) for j, c in ok if j != i and len(c) == len(q))[:3]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(top))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert topk.top_k(df.filter("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def best_bins(items, cap):
    """An exact solver: every item into every sequence or a new one, with a volume bound."""
    items = sorted(items, reverse=True)
    rest = [sum(items[k:]) for k in range(len(items) + 1)]
    best = [len(items)]

    def go(i, bins):
        if len(bins) + max(0, -(-(rest[i] - sum(bins)) // cap)) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= items[i]:
                k = bins.index(room)
                go(i + 1, [*bins[:k], room - items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, cap - items[i]])

    go(0, [])
    return best[0]


def test_packing_is_optimal_on_small_cases():
    rng = np.random.default_rng(5)
    cases = [([30, 32, 37, 39, 46, 47, 48, 51, 52, 66], 150)]
    for _ in range(400):
        cap = int(rng.choice([60, 100, 150, 1024]))
        low, high = rng.choice([0.03, 0.1, 0.2]) * cap, rng.choice([0.4, 0.5, 0.7]) * cap
        cases.append(([int(x) for x in rng.integers(max(1, int(low)), int(high), rng.integers(1, 17))], cap))
    for items, cap in cases:
        made = packing.pack_counts(dict(Counter(items)), cap)
        used = Counter(x for p, n in made for x in p for _ in range(n))
        assert used == Counter(items) and all(sum(p) <= cap for p, _ in made)
        n = sum(n for _, n in made)
        assert n == packing.lower_bound(dict(Counter(items)), cap) or n == best_bins(items, cap)


def test_fillings_are_all_that_are_undominated():
    counts, room = {9: 1, 7: 2, 5: 1, 4: 2, 2: 1}, 14
    lengths = sorted(counts, reverse=True)
    got = list(packing.fillings(lengths, counts, room, room, packing.Effort(10**6)))
    every = {()}
    for x in lengths:
        every |= {(*f, *[x] * k) for f in every for k in range(1, counts[x] + 1) if sum(f) + x * k <= room}

    def dominated(f):
        for x in lengths:
            if counts[x] > f.count(x):
                for mask in range(1 << len(f)):
                    part = [v for k, v in enumerate(f) if mask >> k & 1]
                    if part != [x] and sum(part) <= x and x - sum(part) <= room - sum(f):
                        return True
        return False

    assert sorted(got) == sorted(f for f in every if not dominated(f))
    assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_packing_rows(spark, docs, empty):
    path, lib = queries.vocabulary("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    got = packing.pack(docs, path, end_id=2, capacity=128, with_ids=True).collect()
    want = Counter((i, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, _ in ROWS)
    by = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(ids) == r["length"] <= 128
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 128
    once = [r for r in got if r["doc_id"] != 6]
    whole = {}
    for r in sorted(once, key=lambda r: r["piece"]):
        assert r["start"] == len(whole.setdefault(r["doc_id"], []))
        assert r["piece"] == 0 or r["length"] == 128
        whole[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert {(i, tuple(x)) for i, x in whole.items()} == {k for k in want if k[0] != 6}
    assert packing.pack(empty, path, end_id=2).count() == 0


def test_classifiers_on_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    good = quality.fit_on_labels(docs, labels, F.lit(True))
    bad = toxicity.fit_on_labels(docs, labels, F.lit(True))
    tongue = language.fit_on_documents(docs.withColumnRenamed("kept", "lang"), F.lit(True))
    rows = docs.select("text", quality.score(F.col("text"), good).alias("q"), toxicity.score(F.col("text"), bad).alias("t"), language.predict(F.col("text"), tongue).alias("p")).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r["q"] <= 1 and 0 <= r["t"] <= 1 and 0 <= r["p"]["score"] <= 1
        assert (r["p"]["lang"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    none = quality.fit_on_labels(empty, labels, F.lit(True)), toxicity.fit_on_labels(empty, labels, F.lit(True)), language.fit_on_documents(empty.withColumnRenamed("kept", "lang"), F.lit(True))
    row = docs.select(quality.score(F.col("text"), none[0]), toxicity.score(F.col("text"), none[1]), language.predict(F.col("text"), none[2]).alias("p")).first()
    assert row[0] == row[1] == 0.5 and row["p"]["lang"] == "und"


def test_code_switched_words():
    rng = np.random.default_rng(8)
    en, fr = ["the", "and", "thing", "with", "worth"], ["le", "queue", "étre", "eaux", "mente"]
    model = language.fit([(k, list(rng.choice(w, 16))) for _ in range(60) for k, w in (("en", en), ("fr", fr))])
    assert [p[0] for p in model.predict(["the thing with the worth", "le queue étre eaux", "123 !?", None, "²", "½ ⅷ", "①", ""])] == ["en", "fr", *["und"] * 6]
    assert language.words_of("a²b x_y1é") == ["a", "b", "x", "y", "é"]
    said, score = model.predict([" ".join(en * 3 + fr)])[0]
    assert said == "en" and 0.6 < score < 0.9


def test_marginals_equal_all_paths():
    import itertools

    rng = np.random.default_rng(4)
    length, k = np.array([4, 3, 1]), 3
    e, start, move = rng.standard_normal((3, 4, k)), rng.standard_normal(k), rng.standard_normal((k, k))
    got, pairs = language.forward_backward(e, length, start, move)
    want, want_pairs = np.zeros_like(got), np.zeros((k, k))
    for c, n in enumerate(length):
        paths = list(itertools.product(range(k), repeat=int(n)))
        p = np.array([np.exp(start[x[0]] + sum(e[c, t, s] for t, s in enumerate(x)) + sum(move[a, b] for a, b in zip(x, x[1:]))) for x in paths])
        p /= p.sum()
        for x, q in zip(paths, p):
            for t, s in enumerate(x):
                want[c, t, s] += q
            for a, b in zip(x, x[1:]):
                want_pairs[a, b] += q
    live = np.arange(4) < length[:, None]
    assert np.allclose(got[live], want[live]) and np.allclose(pairs, want_pairs)
    assert np.allclose(language.marginals(e, length, start, move)[live], want[live])


def test_quality_equals_a_plain_fit(monkeypatch):
    """The same cyclic boosting with plain loops over rows, bins and cuts."""
    monkeypatch.setattr(quality, "ROUNDS", 3)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 2)
    monkeypatch.setattr(quality, "PAIRS", 1)
    monkeypatch.setattr(quality, "BINS", 4)
    rng = np.random.default_rng(0)
    x = rng.random((120, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    w = rng.uniform(0.5, 2, 120)
    model = quality.fit(x, y, w)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 5)[1:-1])) for k in range(3)]
    bins = [[sum(v >= c for c in e) for v in x[:, k]] for k, e in enumerate(edges)]
    share = (w * y).sum() / w.sum()
    f = [np.log(share / (1 - share))] * 120
    tables = [[0.0] * (len(e) + 1) for e in edges]

    def slopes():
        p = [1 / (1 + np.exp(-v)) for v in f]
        return [w[i] * (y[i] - p[i]) for i in range(120)], [w[i] * max(p[i] * (1 - p[i]), 1e-6) for i in range(120)]

    gain = lambda a, b: a * a / (b + quality.RIDGE)

    def tree(g, h):
        cuts = [0, len(g)]
        for _ in range(quality.LEAVES - 1):
            best, where = 1e-9, None
            for a, z in zip(cuts, cuts[1:]):
                for k in range(a + 1, z):
                    if min(sum(h[a:k]), sum(h[k:z])) >= quality.LEAST:
                        d = gain(sum(g[a:k]), sum(h[a:k])) + gain(sum(g[k:z]), sum(h[k:z])) - gain(sum(g[a:z]), sum(h[a:z]))
                        if d > best + 1e-12:
                            best, where = d, k
            if where is None:
                break
            cuts = sorted([*cuts, where])
        return [sum(g[a:z]) / (sum(h[a:z]) + quality.RIDGE) for a, z in zip(cuts, cuts[1:]) for _ in range(a, z)]

    for _ in range(3):
        for k in range(3):
            g, h = slopes()
            step = tree([sum(g[i] for i in range(120) if bins[k][i] == b) for b in range(len(tables[k]))], [sum(h[i] for i in range(120) if bins[k][i] == b) for b in range(len(tables[k]))])
            for b, s in enumerate(step):
                tables[k][b] += quality.RATE * s
            f = [v + quality.RATE * step[bins[k][i]] for i, v in enumerate(f)]

    def corner(i, j, g, h):
        best = (-1.0,)
        for a in range(1, len(tables[i])):
            for b in range(1, len(tables[j])):
                parts = [[r for r in range(120) if (bins[i][r] >= a) == p and (bins[j][r] >= b) == q] for p in (False, True) for q in (False, True)]
                value = sum(gain(sum(g[r] for r in p), sum(h[r] for r in p)) for p in parts) - gain(sum(g), sum(h))
                if value > best[0] + 1e-12:
                    best = (value, parts, [sum(g[r] for r in p) / (sum(h[r] for r in p) + quality.RIDGE) for p in parts])
        return best

    g, h = slopes()
    _, i, j = max((corner(i, j, g, h)[0], i, j) for i in range(3) for j in range(i + 1, 3))
    for _ in range(2):
        _, parts, leaves = corner(i, j, *slopes())
        for p, v in zip(parts, leaves):
            for r in p:
                f[r] += quality.RATE * v
    assert list(model.pairs) == [(i, j)]
    assert np.allclose(model.score(x), [1 / (1 + np.exp(-v)) for v in f], atol=1e-9)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.7


def test_toxicity_equals_a_plain_fit(monkeypatch):
    """The same ratios and steps with plain loops and dictionaries."""
    monkeypatch.setattr(toxicity, "STEPS", 5)
    monkeypatch.setattr(toxicity, "LEAST_DOCS", 2)
    docs = [["vile", "rat"], ["vile", "hat"], ["rat", "hate"], ["good", "day"], ["fine", "hat"], ["good", "cat"], [], ["day"]]
    y, w = np.array([1, 1, 1, 0, 0, 0, 0, 0.0]), np.array([1, 1, 1, 2, 2, 2, 2, 2.0])
    model = toxicity.fit(docs, y, w)
    held = [sorted({f"^{x}$"[k : k + n] for x in d for n in (3, 4, 5) for k in range(len(x) + 3 - n)}) for d in docs]
    names = sorted({g for h in held for g in h})
    p = {g: sum(g in h for h, v in zip(held, y) if v) for g in names}
    q = {g: sum(g in h for h, v in zip(held, y) if not v) for g in names}
    ratio = {g: np.log((p[g] + 0.5) / 4) - np.log((q[g] + 0.5) / 6) for g in names if p[g] + q[g] >= 2}
    weight = w / w.mean()
    share = (weight * y).mean()
    bias, beta = np.log(share / (1 - share)), dict.fromkeys(ratio, 0.0)
    m1, m2 = dict.fromkeys([*ratio, None], 0.0), dict.fromkeys([*ratio, None], 0.0)
    for step in range(1, 6):
        e = [v * (1 / (1 + np.exp(-(bias + sum(beta[g] * ratio[g] for g in h if g in ratio)))) - t) for h, t, v in zip(held, y, weight)]
        grad = {g: sum(x * ratio[g] for x, h in zip(e, held) if g in h) / len(y) + toxicity.PENALTY * beta[g] for g in ratio} | {None: np.mean(e)}
        for g, v in grad.items():
            m1[g], m2[g] = 0.9 * m1[g] + 0.1 * v, 0.999 * m2[g] + 0.001 * v * v
            d = toxicity.RATE * (m1[g] / (1 - 0.9**step)) / (np.sqrt(m2[g] / (1 - 0.999**step)) + 1e-8)
            if g is None:
                bias -= d
            else:
                beta[g] -= d
    effect = {g: beta[g] * ratio[g] for g in ratio if abs(beta[g] * ratio[g]) >= toxicity.LEAST_EFFECT}
    assert effect and set(effect) == set(model.weights) and np.allclose([effect[g] for g in effect], [model.weights[g] for g in effect])
    f = np.array([sum(effect.get(g, 0) for g in h) for h in held])
    low, high = -20.0, 20.0
    for _ in range(60):  # the constant by bisection
        mid = (low + high) / 2
        low, high = (mid, high) if (weight * (1 / (1 + np.exp(-(mid + f))) - y)).sum() < 0 else (low, mid)
    assert np.allclose([model.score(" ".join(d)) for d in docs], 1 / (1 + np.exp(-(low + f))), atol=1e-6)


SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    import pandas as pd

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    marks = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    q = queries.op2_quality(spark, SF).toPandas().merge(marks, on="doc_id")
    x = q[q.held_out]
    assert len(x) == 0 or (x.predicted == x.quality).mean() >= 0.8
    t = queries.op4_toxicity(spark, SF).toPandas().merge(marks, on="doc_id")
    x = t[t.held_out]
    assert len(x) == 0 or (x.predicted == x.toxic).mean() >= 0.8
    p = queries.op10_language(spark, SF).toPandas().merge(docs, on="doc_id")
    assert (p[p.held_out].lang == p[p.held_out].lang_pred).mean() >= 0.9
    assert isinstance(q, pd.DataFrame)


def test_digest_queries(spark):
    lib = tokenizer("byte_bpe_50k.json")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op1_bpe(spark, SF).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_shared_folder_is_the_sessions(spark):
    assert common.fresh_path(spark, "x").startswith(spark.conf.get(common.CHECKPOINT_KEY))
