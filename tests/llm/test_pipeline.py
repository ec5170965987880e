import re

import corpus_pipeline
from tidemill.llm import bpe, decontam, langid
from tidemill.session import read_table

from .conftest import near_components, pairs
from .test_decontam import brute as hits
from .test_linededup import brute as kept_lines


def test_run_equals_brute_force(spark, sf):
    docs, bench = read_table(spark, sf, "documents"), pairs(read_table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id"))
    model = langid.train(docs)
    rows = pairs(docs)
    _, _, rejected = model.predict([t or "" for _, t in rows])
    rows = [r for r, gone in zip(rows, rejected, strict=True) if not gone]
    rows = [(d, "\n".join(k)) for (d, _), k in kept_lines(rows).items()]
    component = near_components(rows, 5, 80)
    rows = [(d, t) for d, t in rows if component[d][1] == d]
    bad = {r[0] for r in hits(rows, bench) if r[-1]}
    rows = [(d, t) for d, t in rows if d not in bad]
    codec = bpe.Codec(bpe.vocabulary())
    want = {d: codec.encode([t])[0].tolist() for d, t in rows}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages(spark, sf, odd_docs, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).parents[2]
    for p in [*root.joinpath("tidemill").rglob("*.py")]:
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"tidemill\.llm|from \.+llm|import llm", p.read_text()), p
    assert decontam.WINDOW == 13
