"""Repeated rows, shared ids, nulls, empty tables, very long texts and clashing columns, operator by operator."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.llm import common, decontamination, embedding_dedup, jaccard_join, license_scan, packing, pii, quality, substring_dedup, toxicity

DOCS = "doc_id long, text string"
RNG = random.Random(11)
LONG = " ".join(f"w{RNG.randrange(5000)}" for _ in range(30_000))
WORDS = [f"x{i}" for i in range(40)]
ONE, OTHER = " ".join(WORDS), " ".join(["b", *WORDS[1:30]])
#: Id 1 twice the same, id 2 with two texts, a null id, nulls, empty texts, a very long text and a copy of it.
DATA = [(1, ONE), (1, ONE), (2, "a " + OTHER), (2, OTHER), (None, ONE), (3, None), (4, ""), (5, LONG), (6, LONG + " end"), (7, ONE)]
TEXTS = {1: ONE, 2: "a " + OTHER, 3: None, 4: "", 5: LONG, 6: LONG + " end", 7: ONE}  # least text of each id


def odd(spark, data=DATA, schema=DOCS):
    names = ("id", "of_id", "of_doc", "key", "label", "n", "least", "start", "bucket", "block", "size", "comp", "score", "vector", "first")
    return spark.createDataFrame(data, schema).repartition(3).withColumns({c: F.lit("own") for c in names})


def digest(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


@pytest.mark.parametrize("sizes", [{}, {"block_windows": 5000, "bucket_windows": 700}])
def test_substring_dedup(spark, sizes):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(odd(spark), **sizes).collect()}
    seen, want = set(), {}
    for doc, text in sorted(TEXTS.items()):
        words = (text or "").split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - 19):
            window = hash(tuple(words[i : i + 20]))
            gone[i : i + 20] |= window in seen
            seen.add(window)
        want[doc] = (len(words), int(gone.sum()), digest(w for w, g in zip(words, gone, strict=True) if not g))
    assert got == want and got[1][1] == 0 and got[7][1] == 40 and got[6][1] == 30_000
    assert substring_dedup.remove_repeats(odd(spark, [])).count() == 0


def test_jaccard_join(spark):
    got = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in jaccard_join.near_duplicates(odd(spark)).collect()}
    assert got == {1: (1, 1, True), 7: (1, 1, False), 2: (0, 2, True), 3: (0, 3, True), 4: (0, 4, True), 5: (1, 5, True), 6: (1, 5, False)}


def test_decontamination(spark):
    items = spark.createDataFrame([(1, " ".join(WORDS[5:20])), (1, " ".join(WORDS[25:38])), (1, "b"), (2, ONE), (None, ONE), (3, None), (4, ""), (5, " ".join(LONG.split()[-10:]))], "item_id long, text string").withColumn("need", F.lit("own"))
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontamination.contamination(odd(spark), items).collect()}
    assert got == {1: (40, 40, ["1", "2"]), 7: (40, 40, ["1", "2"]), 2: (31, 30, ["1", "2"]), 3: (0, 0, []), 4: (0, 0, []), 5: (30_000, 10, ["5"]), 6: (30_001, 10, ["5"])}
    assert decontamination.contamination(odd(spark), items.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.contamination(odd(spark, []), items).count() == 0


def test_short_items_in_many_places(spark):
    docs = spark.createDataFrame([(1, "the cat The dog the the"), (2, "a"), (3, None)], DOCS)
    items = spark.createDataFrame([(7, "THE"), (8, "the dog"), (9, "the")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontamination.contamination(docs, items).collect()}
    assert got == {1: (5, ["7", "8", "9"]), 2: (0, []), 3: (0, [])}


def test_packing(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(odd(spark), path).collect()
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append((r.start, len(r.ids) // 4, r.doc_tokens))
    count = {doc: sum(n for _, n, _ in own) for doc, own in whole.items()}
    assert set(whole) == {None, 1, 2, 3, 4, 5, 6, 7} and count[3] == count[4] == 1
    assert count[1] == 2 * count[7] == 2 * count[None] and count[6] == count[5] + 1
    assert packing.pack(odd(spark, []), path).count() == 0


def test_packing_fills_its_windows(spark):
    import public_tokenizers

    rng = random.Random(8)
    data = [(i, " ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(1, 900)))) for i in range(900)]
    rows = packing.pack(spark.createDataFrame(data, DOCS).coalesce(1), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(len(r.ids) // 4 for r in rows) >= 0.98 * 2048 * len({r.sequence_id for r in rows})


def test_personal_data(spark):
    assert pii.personal_data(odd(spark, []), pii.fitted(odd(spark, []))).count() == 0
    net = pii.fitted(odd(spark))  # without any span to learn from
    late = LONG + " write to some.one@example.org now"
    rows = pii.personal_data(odd(spark, [*DATA, (8, late)]), net).collect()
    assert len(rows) == len(DATA) + 1
    for r in rows:
        assert [(s.start, s.finish, s.kind) for s in r.base] == ([(len(LONG) + 10, len(late) - 4, "email")] if r.doc_id == 8 else []) and not r.added
    masked = pii.masked(spark.createDataFrame([(8, late, 1), (3, None, 2), (4, "", None)], f"{DOCS}, n_chars long"), net).collect()
    assert {r.doc_id: (r.n_chars, (r.text or "")[-20:]) for r in masked} == {8: (len(late) - 20 + 7, " write to [EMAIL] now"[-20:]), 3: (None, ""), 4: (0, "")}


def test_classifiers(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (9, 1), (None, 1), (3, None), (4, 7), (5, 1)], "doc_id long, label int")
    texts, marks = quality.training_sample(odd(spark), labels, F.lit(True), "label")
    assert sorted(zip(map(len, texts), marks.tolist(), strict=True)) == sorted([(len(ONE), 1), (len(ONE), 1), (len(OTHER), 0), (len(OTHER) + 2, 0), (len(LONG), 1)])
    for some in (labels.limit(0), labels.where("label = 1")):
        net = quality.train(*quality.training_sample(odd(spark), some, F.lit(True), "label"))
        assert quality.scored(odd(spark), net).where("score > 0.5").count() == len(DATA)
    assert quality.training_sample(odd(spark, []), labels, F.lit(True), "label")[0] == []
    bags, marks = quality.training_sample(odd(spark), labels.limit(0), F.lit(True), "label", sent=toxicity.sent_bags)
    machine = toxicity.train_bags(toxicity.received_bags(bags), marks)
    assert toxicity.scored(odd(spark), machine).where("score < 0.5").count() == len(DATA)
    assert toxicity.scored(odd(spark, []), machine).count() == 0


def test_embeddings(spark):
    unit = lambda i: [float(k == i) for k in range(8)]
    data = [(1, unit(0)), (1, unit(0)), (2, unit(1)), (2, unit(0)), (None, unit(0)), (3, None), (4, unit(1)), (5, [2 * v for v in unit(0)])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(odd(spark, data, "vec_id long, embedding array<double>")).collect()}
    # Of id 2 the least vector, that of the second axis, counts.
    assert got == {1: (1, 1, True), 5: (1, 1, False), 2: (1, 2, True), 4: (1, 2, False), 3: (0, 3, True)}
    assert embedding_dedup.near_duplicates(odd(spark, [], "vec_id long, embedding array<double>")).count() == 0


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT-text"]
    data = [(1, mit), (1, mit), (2, "none"), (2, mit), (None, mit), (3, None), (5, f"{LONG} {mit} {LONG}")]
    got = {(r.doc_id, r.license_id): r.n_found == r.n_runs for r in license_scan.scan(odd(spark, data)).collect()}
    assert got == {(i, "MIT-text"): True for i in (1, 2, 5)}


def test_one_row_an_id(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 9), (1, "a", 9), (2, None, 3), (2, "z", 1), (3, "k", None)], "id long, text string, n long")
    assert sorted(map(tuple, common.one_row_an_id(df, "id").collect())) == [(1, "a", 9), (2, None, 3), (3, "k", None)]
    single = df.where("id = 3")
    assert common.one_row_an_id(single, "id") is single


def test_whole_groups_cut_at_their_ends():
    import pyarrow as pa

    rng = random.Random(2)
    for rows in (1, 3, 10, 1000):
        keys = sorted((rng.randrange(4), rng.randrange(5)) for _ in range(60))
        batches, at = [], 0
        while at < len(keys):
            n = rng.randrange(0, 9)
            batches.append(pa.RecordBatch.from_pydict({"a": pa.array([k[0] for k in keys[at : at + n]], pa.int64()), "b": pa.array([k[1] for k in keys[at : at + n]], pa.int32())}))
            at += n
        got = [list(zip(*t.to_pydict().values(), strict=True)) for t in common.whole_groups(iter(batches), ["a", "b"], rows=rows)]
        assert [k for t in got for k in t] == keys and all(x[-1] != y[0] for x, y in zip(got, got[1:], strict=False))


@pytest.fixture
def small_tables(spark, tmp_path):
    """Tables for the pipeline, with odd rows among its documents."""
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    more = spark.createDataFrame([(None, "no id at all", "en", "web", 12), (10**6, None, "en", None, None), (10**6 + 1, "", None, "web", 0), (10**6 + 2, LONG, "en", "web", len(LONG))], docs.schema)
    docs.unionAll(docs.orderBy("doc_id").limit(5)).unionAll(more).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_pipeline_stages(spark, small_tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    given = docs.where("doc_id IS NULL OR doc_id >= 1000000").withColumn("id", F.lit("own")).withColumn("of_doc", F.lit("own"))
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, given.unionAll(given), small_tables)
        rows = kept.collect()
        assert stage(spark, docs.limit(0), small_tables).count() == 0
        if name == "packing":
            assert sum(r.doc_id == 1000000 for r in rows) == 2 and sum(r.doc_id is None for r in rows) >= 2
            continue
        assert kept.columns == given.columns
        if name != "quality":
            assert len(rows) == 8 and sum(r.doc_id == 1000000 and r.text is None for r in rows) == 2
            assert [r.text for r in rows if r.doc_id == 1000002] == [LONG] * 2


def test_pipeline_leaves_only_its_result(spark, small_tables):
    import corpus_pipeline

    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = jvm.Path(common.shared_dir(spark))
    listed = lambda: {str(f.getPath()) for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)}
    before = listed()
    pieces = corpus_pipeline.run(spark, small_tables)
    assert pieces.count() > 100 and len(listed() - before) == 1
