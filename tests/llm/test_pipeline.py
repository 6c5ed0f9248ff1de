import random

import corpus_pipeline
from test_simhash import brute_similar
from veldspar.llm import decontam, ordinal, secrets


def test_stages(spark, sf, tmp_path):
    """Each stage against its operator's own result, or a plain check, on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-duplicates", "decontamination", "secrets", "sentence-pieces"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "toxicity":
            marks = ("idiot", "moron", "scum", "stupid", "loser", "clown", "trash", "pathetic", "worthless", "disgusting")
            plain = {i for i, t in before.items() if sum(m in t.lower() for m in marks) >= 3}
            assert plain and not plain & {r.doc_id for r in after.collect()}
        elif name == "near-duplicates":
            ids = sorted(before)
            groups = dict(zip(ids, brute_similar([before[i] for i in ids]), strict=True))
            assert {r.doc_id for r in after.collect()} == {ids[min(k for k, i in enumerate(ids) if groups[i] == g)] for g in set(groups.values())}
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(t in r.text for r in after.collect() for t in items)
            assert {i for i, t in before.items() if not any(x[:40] in t for x in items)} <= {r.doc_id for r in after.collect()} | {r.doc_id for r in decontam.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
        elif name == "secrets":
            assert after.count() == docs.count()
            left = secrets.digest(after).filter("n_assign + n_access + n_hex > 0").count()
            assert left == 0
        else:
            assert {r.doc_id for r in after.collect()} == set(before) and after.filter("not round_trip").count() == 0
        if name != "sentence-pieces":
            assert after.columns == columns
        kept[name], docs = after.count(), after
    assert kept["toxicity"] < len(spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert ordinal.Settings().reject_at == 0.6


def test_stages_take_repeated_rows_and_nulls(spark, sf):
    rows = [(1, "a plain text of some words here", "en", "s", 31), (1, "a plain text of some words here", "en", "s", 31), (2, None, None, None, None), (None, "no id at all here", "en", "s", 17)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (True, 0)]
    assert corpus_pipeline.secret_scan(spark, docs, sf).count() == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_near_duplicates_decides_by_row(spark, sf):
    rng = random.Random(6)
    text = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(6)]
    rows = [(None, text[0], "en", "s", 1), (None, text[1], "en", "s", 1), (None, text[1], "en", "s", 1), (None, text[2], "en", "s", 1), (3, text[2], "en", "s", 1)]
    rows += [(5, text[3], "en", "s", 1), (5, text[3], "en", "s", 1), (1, text[4], "en", "s", 1), (7, text[4], "en", "s", 1), (7, text[5], "en", "s", 1), (7, text[5], None, "en", 1)]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    want = sorted([(-1, text[0]), (-1, text[1]), (3, text[2]), (5, text[3]), (1, text[4]), (7, text[5])])
    for some, kept in ((rows, want), ([r for r in rows if r[0] is None], sorted((-1, t) for t in text[:3]))):
        got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(some, schema), sf).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in got) == kept


def test_stages_keep_columns_of_any_name(spark, sf):
    rows = [(1, "a plain text of some words here", "en", "s", 31, "mine", "x", "keep", "p", 1, 2), (2, "password=hunter2hunter2", "en", "s", 23, "mine", "x", "keep", "p", 1, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, _Severity string, _spans string, _p_toxic string, key int, other int"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert {tuple(r)[5:] for r in got.collect()} == {rows[0][5:]}, name
