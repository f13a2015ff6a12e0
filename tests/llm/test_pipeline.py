"""The pipeline's stages, each against its operator on the rows it was given."""

import hashlib
import re

from test_text_operators import brute_hits, brute_links

import corpus_pipeline as pipeline
import tabloom.llm.queries as queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        seen.append({r.doc_id for r in docs.collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False)) and seen[-1]
    normal: dict[str, int] = {}
    for key in sorted(seen[0]):
        normal.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[key]), key)
    assert seen[1] == set(normal.values())
    order = sorted(seen[1])
    groups = brute_links([texts[k] for k in order])
    assert seen[2] == {k for i, k in enumerate(order) if groups[i][0] == i}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    order = sorted(seen[2])
    hits = brute_hits([texts[k] for k in order], bench, 10)
    assert seen[3] == {k for k, (_, n, _) in zip(order, hits, strict=True) if not n}
    rows = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    assert set(rows) == seen[-1]
    assert all(r.decoded_sha256 == hashlib.sha256(texts[k].encode()).hexdigest() for k, r in rows.items())


def test_every_operator_is_registered():
    found = {int(name[2:].split("_")[0]) for name in queries.QUERIES}
    assert found == set(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
