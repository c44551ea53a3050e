import hashlib

import corpus_pipeline
from lakesync.llm import bpe, queries
from lakesync.llm.common import materialise
from lakesync.workspace import fresh_dir
from hard_rows import hard, nothing  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide_by_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = materialise(stage(spark, docs, SMALL), "t")
        assert docs.columns == columns or name == "tokens"
    toxic = {r["doc_id"] for r in queries.all_queries()["op3_toxicity"](spark, SMALL).filter("predicted = 1").collect()}
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    assert ids(seen["quality rules"]) == ids(seen["toxicity"]) - toxic
    assert ids(seen["near duplicates"]) <= ids(seen["quality rules"]) and ids(seen["mixing"]) <= ids(seen["near duplicates"])
    # The tokens decode to the texts of the mix, row by row.
    codec = bpe.Codec(bpe.load_vocabulary(bpe.read_tokenizer(spark)))
    want = sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in seen["tokens"].collect())
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in docs.collect()) == want
    assert all(codec.decode(r["ids"]) for r in docs.limit(20).collect() if r["n_tokens"])


def test_run_on_hard_and_empty_tables(spark, hard, nothing):
    for docs in (hard, nothing):
        path = fresh_dir(spark, "sf")
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        rows = corpus_pipeline.run(spark, path).collect()
        assert {r["doc_id"] for r in rows} <= {1, 2, None} and bool(rows) == (docs is hard)


def test_all_operators_are_registered():
    names = list(queries.all_queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.all_oracles()) <= set(names)


def test_equal_rows_of_one_id_stay_once(spark):
    """Ninety rows, three ids; and columns of names that stages use inside stay as they are."""
    texts = [" ".join(f"{w}{k}" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven")) for k in range(3)]
    names = ("__score", "__host", "__doc", "__removed", "__words", "__copy", "__gone", "__text", "__id", "__row")
    rows = [(k % 3, texts[k % 3], "s", *(f"{n}{k % 3}" for n in names)) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    labels = fresh_dir(spark, "sf")
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{labels}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = materialise(stage(spark, docs, labels), "t")
        assert all(r[n] == f"{n}{r['doc_id']}" for r in docs.collect() for n in names), name
        assert docs.count() == (90 if name in ("toxicity", "quality rules") else 3), name
