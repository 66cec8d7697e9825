"""The pipeline against brute force, stage by stage and as a whole; its registration."""

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm import test_bpe, test_decontaminate, test_simhash
from tests.llm.helpers import DIRECTORY, as_rows, awkward, documents, empty
from wardbook.llm import common, quality
from wardbook.llm.queries import ORACLE, QUERIES


def brute(spark, pairs):
    labels = common.read_table(spark, DIRECTORY, "labels").where(~common.fold(4, 2))
    trees = quality.train(common.read_table(spark, DIRECTORY, "documents"), labels.selectExpr("doc_id", "quality AS label"))
    kept = [(d, t) for d, t in pairs if trees.scores(np.array([quality.statistics(t or "")]))[0] >= 0.7]
    yield kept
    last = {}
    for doc, text in kept:
        last[text] = max(doc, last.get(text, doc))
    kept = [(d, t) for d, t in kept if last[t] == d]
    yield kept
    first = {doc: component for doc, _, component in test_simhash.brute(kept)}
    kept = [(d, t) for d, t in kept if first[d] == d]
    yield kept
    items = pd.read_parquet(f"{DIRECTORY}/benchmark.parquet").values.tolist()
    dirty = {r[0] for r in test_decontaminate.brute(kept, items) if r[-1]}
    kept = [(d, t) for d, t in kept if d not in dirty]
    yield kept
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_padding()
    library.no_truncation()
    yield [test_bpe.expected(library, d, t) for d, t in kept]


def test_stages_and_run(spark):
    pairs = list(documents()[["doc_id", "text"]].itertuples(index=False, name=None))
    docs, before = common.read_table(spark, DIRECTORY, "documents"), len(pairs)
    columns = docs.columns
    for (name, stage), expected in zip(corpus_pipeline.STAGES, brute(spark, pairs), strict=True):
        docs = common.settle(stage(spark, docs, DIRECTORY), "test")
        if name != "bpe":
            assert docs.columns == columns
            assert as_rows(docs.select("doc_id", "text")) == sorted(expected, key=repr), name
            assert len(expected) < before, name
            before = len(expected)
        else:
            assert as_rows(docs) == sorted(expected, key=repr)
    assert as_rows(corpus_pipeline.run(spark, DIRECTORY)) == as_rows(docs)


def test_stages_on_awkward_rows_and_empty_tables(spark):
    for start in (awkward(spark), empty(spark)):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            # The quality stage would reject nearly all of these.
            out = stage(spark, start, DIRECTORY)
            assert out.columns == start.columns and out.schema == start.schema and out.count() <= start.count()
            docs = common.settle(stage(spark, docs, DIRECTORY), "test")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DIRECTORY).count() == docs.count()


def test_registration():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql())
    assert "pipeline" not in contract.oracle_sql()
