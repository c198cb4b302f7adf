"""The pipeline's stages on odd rows, and the whole against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkveil.llm import language, packing, quality
from inkveil.llm.bloom import bloom_split
from inkveil.llm.common import id_fold
from inkveil.llm.queries import vocabulary

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, __id string, __k int, rank long, cid string, gone boolean"
EN = "the market opened with a fresh plan and the people of the town came along to see what the day would bring for them all "
FR = "le marché ouvre avec un nouveau plan et les gens de la ville viennent voir ce que la journée apporte à tous les autres "
ODD = [
    (1, EN * 3, "en"), (1, EN * 3, "en"), (1, FR * 3, "fr"), (2, EN * 3 + "again", "en"), (3, None, "en"), (4, "", None), (5, " \n", "fr"), (None, EN, "en"),
    (None, None, None), (6, "²½ 12 !", "en"), (7, FR * 2000, "fr"), (8, "日本語", None), (9, "word", "en"), (10, "word", "en"),
]


def table(spark, rows):
    full = [(i, t, lang, "s", 1, "a", 2, 3, "c", None) for i, t, lang in rows]
    return spark.createDataFrame(full, SHAPE)


def labels(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def test_language_stage(spark, tmp_path):
    docs = table(spark, ODD)
    out = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert ids(out) == Counter({1: 3, 2: 1, None: 1, 7: 1, 8: 1, 9: 1, 10: 1})
    none = table(spark, [(i, t, None) for i, t, _ in ODD])
    assert corpus_pipeline.language_id(spark, none, str(tmp_path)).count() == len(ODD)
    assert corpus_pipeline.language_id(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_quality_stage(spark, tmp_path):
    docs = table(spark, ODD)
    for marks in ([], [(1, 1, 0)], [(None, 1, 0), (2, None, 0)]):
        assert corpus_pipeline.quality_filter(spark, docs, labels(spark, tmp_path, marks)).count() == len(ODD)
    sf = labels(spark, tmp_path, [(100 + k, k % 2, 0) for k in range(200)])
    good = lambda k: f"Line {k} tells of a plain day. The town was calm, and people went home early.\n" * 5
    rows = [(100 + k, good(k) if k % 2 else f"%%{k} ZZ## " * 40, "en") for k in range(200)] + [(400, None, "en"), (None, good(0), "en")]
    out = corpus_pipeline.quality_filter(spark, table(spark, rows), sf)
    got = ids(out)
    assert all((got[100 + k] == 1) == (k % 2 == 1) for k in range(200)) and got[None] == 1 and out.columns == docs.columns
    assert corpus_pipeline.quality_filter(spark, docs.limit(0), sf).count() == 0


def test_near_stage(spark, tmp_path):
    docs = table(spark, ODD)
    out = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    # of the two equal rows of 1 one goes; 2 is near them, 10 equals 9; a null id is in no group; row 7 is a copy of 1's other text
    got = ids(out)
    assert got[1] == 2 and got[2] == 0 and got[9] == 1 and got[10] == 0 and got[None] == 2 and all(got[k] == 1 for k in (3, 4, 5, 6, 8))
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_bloom_filter_misses_no_member(spark):
    rows = spark.range(-3000, 3000).select(F.when(F.col("id") != 0, F.col("id") * 7919).alias("doc_id"))
    perhaps, others = (Counter(r["doc_id"] for r in x.collect()) for x in bloom_split(rows, "doc_id", rows.filter("doc_id > 0"), "doc_id"))
    assert perhaps + others == Counter(r["doc_id"] for r in rows.collect())
    assert not any(i > 0 for i in others if i is not None) and len(perhaps) < 2999 + 60 and others[None] == 1
    assert bloom_split(rows, "doc_id", rows.limit(0), "doc_id")[0].count() == 0


def test_near_stage_leaves_texts_where_they_are(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.bytes(8).hex() for _ in range(2000)), "en") for k in range(200)]
    rows += [(1000 + k, rows[k][1] + " end", "en") for k in range(5)] + [rows[7], (8, "another text of the same number", "en"), (None, rows[9][1], "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/docs.parquet")
    docs = spark.read.parquet(f"{tmp_path}/docs.parquet")
    written = lambda: sum(s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = Counter((r["doc_id"], len(r["text"])) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect())
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == Counter((i, len(t)) for i, t, _ in [*rows[:200], *rows[-2:]])
    assert moved < sum(len(t) for _, t, _ in rows) / 2


def test_repeat_and_pack_stages(spark, tmp_path):
    docs = table(spark, ODD)
    out = corpus_pipeline.repeat_removal(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None) and {3, 4, 5, 6, 8, 9, 10} <= {r["doc_id"] for r in rows}
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for i, _, _ in ODD)
    for stage in (corpus_pipeline.repeat_removal, corpus_pipeline.pack):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def components(pairs, nodes):
    low = {n: n for n in nodes}
    while True:
        new = dict(low)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_the_whole_against_brute_force(spark, sf):
    """Language and quality by the fitted models row by row, then all pairs, all windows and all tokens by plain loops."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).toPandas()
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: r[0])
    tongue = language.fit_on_documents(docs, id_fold(F.col("doc_id"), 5) != 0)
    rows = [(i, t) for i, t in rows if tongue.predict([t])[0][1] >= corpus_pipeline.LANGUAGE_SHARE]
    left = docs.filter(F.col("doc_id").isin([i for i, _ in rows]))
    good = quality.fit_on_labels(left, spark.read.parquet(f"{sf}/labels.parquet"), id_fold(F.col("doc_id"), 4) != 2)
    rows = [(i, t) for i, t in rows if good.score(np.array([quality.features(t)]))[0] >= quality.KEEP]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = components(pairs, sets)
    rows = [(i, t) for i, t in rows if group[i] == i]
    seen, kept = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        text = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
        if not gone.any() or text.strip():
            kept.append((i, text))
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    lib.no_truncation()
    lib.no_padding()
    want, counts = [], Counter()
    for i, t in kept:
        tokens = [*lib.encode(t, add_special_tokens=False).ids, 2]
        first = len(tokens) % 1024 or 1024
        cuts = [0, *range(first, len(tokens) + 1, 1024)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, z - a, zlib.crc32(np.array(tokens[a:z], "<u4").tobytes())))
            counts[z - a] += 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[columns].astype(int).to_numpy().tolist())) == sorted(want)
    assert got["sequence_id"].nunique() == sum(n for _, n in packing.pack_counts(dict(counts)))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.r_[0, np.cumsum(g["length"])[:-1]]).all() and g["length"].sum() <= 1024
