"""Registered corpus queries against their SQL, and the pipeline against its stages done plainly."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import corpus_pipeline  # noqa: E402
from compare import database, spark_rows, sql_rows  # noqa: E402

from refillspark.llm import bpe, decontam, pii, queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    columns, rows = spark_rows(queries.QUERIES[name](spark, SF))
    names, expected = sql_rows(database(SF), queries.ORACLE_SQL[name])
    assert columns == names and rows == expected and rows


def first_of_similar(rows):
    """Ids that are the smallest of their group: five-word shingles with a Jaccard similarity of 0.8 or more, all pairs compared."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (x == y or len(x & y) >= 0.8 * len(x | y)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i for i in ids if find(i) == i}


def test_pipeline_keeps_what_every_stage_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    civil = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).where("predicted = 0").collect()}
    rows = docs.where(docs.doc_id.isin(*civil))
    kept = first_of_similar([(r.doc_id, r.text) for r in rows.collect()])
    bad = {r.doc_id for r in decontam.contamination(rows.where(rows.doc_id.isin(*kept)), bench).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept - bad}

    def masked(text):
        out, end = "", 0
        for kind, a, b in pii.all_spans(text, pii.Rules())[1]:
            if a >= end:
                out += text[end:a] + f"<{kind}>"
            end = max(end, b)
        return out + text[end:]

    worker = bpe._Worker(bpe.public_vocabulary("byte_bpe_50k.tiktoken"), bpe.split_pattern())
    want = sorted((i, len(worker.ids(masked(t)))) for i, t in texts.items())
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()) == want
    assert bad and len(kept) < len(civil) < docs.count()


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.schema.names
