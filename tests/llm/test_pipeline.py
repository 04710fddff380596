"""The pipeline's stages against brute-force versions of each, on what the stage before kept."""


import corpus_pipeline
from pyspark.sql import functions as F

from ledgerlark.llm import toxicity
from tests.llm.test_operators import TEXTS, brute_components, brute_groups, brute_hits, encoded


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    scores = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = {r.doc_id for r in scores.filter("predicted = 1").collect()}
    assert 0 < len(toxic) < len(kept) / 4
    for name, stage in corpus_pipeline.STAGES:
        ids = sorted(kept)
        texts = [kept[i] for i in ids]
        docs = stage(spark, docs, sf_dir)
        if name == "toxicity":
            want = {i for i in ids if i not in toxic}
        elif name == "exact_dedup":
            want = {i for k, i in enumerate(ids) if brute_groups(texts)[k][0] == k}
        elif name == "near_dedup":
            want = {ids[k] for k, x in brute_components(texts, 5).items() if x[2]}
        elif name == "decontamination":
            want = {ids[k] for k, (n, h, _) in brute_hits(texts, items, 13).items() if not (h and 20 * h >= n)}
        else:
            got = {r.doc_id: r.n_tokens for r in docs.collect()}
            assert got == {i: len(encoded(kept[i])) for i in ids}
            break
        assert docs.columns == columns
        docs = docs.cache()
        kept = {r.doc_id: r.text for r in docs.collect()}
        assert set(kept) == want, name


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100


def test_stages_on_awkward_rows(spark, sf_dir, tmp_path):
    """Nulls, empty and long texts, repeated rows, rows without an id, and further columns with the names that stages use themselves."""
    rows = [*enumerate(TEXTS), (4, TEXTS[4]), (4, TEXTS[4]), (None, "a text without an id"), (None, "one two"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("__of", "__sha", "kept", "score", "predicted", "k0", "k1", "n_hit", "set", "component_id", "toxic", "words"):
        docs = docs.withColumn(name, F.lit(name))
    least = lambda i: -1 if i is None else i
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        if name == "tokens":
            assert sorted((least(r.doc_id), r.n_tokens) for r in got.collect()) == sorted((least(i), len(encoded(t))) for i, t in rows)
            break
        assert got.columns == docs.columns and all(r[c] == c for r in got.collect() for c in docs.columns[2:])
        if name == "exact_dedup":
            rows = [(i, t) for i, t in rows if least(i) == max(least(j) for j, x in rows if (x or "") == (t or ""))]
        elif name == "near_dedup":
            own = sorted({i: t for i, t in rows if i is not None}.items())
            dropped = {own[k][0] for k, x in brute_components([t for _, t in own], 5).items() if not x[2]}
            rows = [(i, t) for i, t in rows if i not in dropped]
        got.write.parquet(path := f"{tmp_path}/{name}")
        docs = spark.read.parquet(path)
        order = lambda x: (least(x[0]), x[1] or "")
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=order) == sorted(rows, key=order), name


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        assert got.count() == 0 and (name == "tokens" or got.columns == docs.columns)
