import corpus_pipeline
from paperloom.llm.common import materialise

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, SF))
        seen[name] = (before, docs)
        if name != "byte_bpe":
            assert docs.columns == columns
            assert docs.join(before, columns, "left_anti").count() == 0
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    civil = {r["doc_id"] for r in seen["toxicity"][1].collect()}
    judged = {r["doc_id"] for r in seen["toxicity"][0].collect()} & set(labels)
    clean = [i for i in judged if not labels[i]["toxic"]]
    assert sum(i in civil for i in clean) >= 0.98 * len(clean)
    texts = [r["text"] for r in seen["near_dedup"][1].collect()]
    assert len(texts) == len(set(texts)) and len({r["text"] for r in seen["near_dedup"][0].collect()}) >= len(texts)
    mixed = seen["mixing"][1].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in mixed) <= 3
    assert seen["byte_bpe"][1].count() == seen["mixing"][1].count()


#: Names that the operators or the stages use for columns of their own.
NAMES = ["s", "mean", "full", "multiplier", "border", "upto", "size", "draw", "place", "cell", "whole", "copies", "copy", "source_size", "target", "rate", "taken", "n_words", "n_symbols", "base_failed", "kept", "stratum",
         "features", "share", "severity", "grade", "toxic", "half", "t", "id", "h", "n", "f", "first", "component_id", "fingerprint", "prefix", "low", "quality", "good"]


def test_stages_give_back_columns_of_any_name_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    odd = spark.createDataFrame([(None, "some words " * 40, None, None, None), (900_001, None, "en", "web", 0), (900_002, "", None, "web", 0), (900_003, "x" * 100_000 + " word" * 20_000, "en", None, 5), (900_003, "twice " * 60, "en", "web", 5)], docs.schema)
    docs = materialise(docs.unionByName(odd).selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(NAMES)]))
    own = [f"{n} = {i}" for i, n in enumerate(NAMES)]
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = materialise(stage(spark, table, SF))
            assert out.columns == docs.columns and out.filter(" and ".join(own)).count() == out.count(), name
            assert out.join(table, docs.columns[:1], "left_anti").filter("doc_id is not null").count() == 0
            assert table is docs or out.count() == 0
        last = corpus_pipeline.STAGES[-1][1](spark, table, SF)
        assert last.count() == table.count() and last.filter(" and ".join(own)).count() == last.count()
