"""Every registered query of the core on tables with rows of nulls and repeated rows, and on empty tables."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone import catalog

#: Streams take their time; those whose own code handles rows are run here, beside the tests of their parts.
SKIPPED = {n for n in catalog.QUERIES if n.startswith("stream_")} - {"stream_ohlcv", "stream_pack"}


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    folders = {}
    for what in ("nulls", "empty"):
        folders[what] = tmp_path_factory.mktemp(what)
        for name in os.listdir(sf):
            table = pq.read_table(f"{sf}/{name}")
            table = table.cast(pa.schema([f.with_nullable(True) for f in table.schema]))
            nulls = pa.table({f.name: pa.nulls(2, f.type) for f in table.schema}, schema=table.schema)
            pq.write_table(pa.concat_tables([table, nulls, table.slice(0, 2)]) if what == "nulls" else table.slice(0, 0), folders[what] / name)
    return folders


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SKIPPED))
@pytest.mark.parametrize("what", ["nulls", "empty"])
def test_runs_on_odd_tables(spark, sf, odd, name, what):
    found = catalog.QUERIES[name](spark, str(odd[what]))
    found.write.format("noop").mode("overwrite").save()
    assert found.columns


def test_repeated_and_null_documents_are_not_lost(spark, sf, odd):
    """Queries that give a row for each document give one for each row, null ids and texts included."""
    path, docs = str(odd["nulls"]), spark.read.parquet(f"{odd['nulls']}/documents.parquet").count()
    for name in ("corpus_filter_verdict", "corpus_priority_score", "corpus_keywords_default", "corpus_light_filter", "token_estimate", "dedup_greedy", "dedup_words", "pack_buffered", "pack_ffd", "pack_dynamic", "stream_pack"):
        assert catalog.QUERIES[name](spark, path).count() == docs, name
    verdicts = {r.verdict for r in catalog.QUERIES["corpus_filter_verdict"](spark, path).where("doc_id is null").collect()}
    assert verdicts == {"too_short"}
    kept = catalog.QUERIES["dedup_greedy"](spark, path).where("kept").groupBy("doc_id").count().where("count > 1").count()
    assert kept == 0
