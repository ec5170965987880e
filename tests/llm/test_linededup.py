import hashlib

import pytest

from tidemill.llm import linededup

from .conftest import ascii_lower, pairs

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return ascii_lower(line.strip(BLANK))


def brute(rows, least=10, docs=2):
    """{(doc_id, text): kept lines}"""
    where = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                where.setdefault(key(line), set()).add(d)
    return {(d, t): [x for x in (t or "").split("\n") if key(x) not in where or len(where[key(x)]) < docs or min(where[key(x)]) == d] for d, t in rows}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(5, "shared line one\n short\nOnly here, really"), (3, "  SHARED LINE ONE \t\nshort"), (9, "shared line one\nshared line one\nx"), (3, "shared line one\nother text of three"), (7, None), (8, ""), (10, "ÉÉÉÉÉÉÉÉÉÉ\néééééééééé"), (11, "éééééééééé\n\x0bshared line one\r"), (12, "\n\n\n"), (13, "123456789\n1234567890"), (14, "1234567890")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "z") for r in rows], "doc_id long, text string, n_chars long, drop string")


def test_report(lines, odd_docs):
    for docs in (lines, odd_docs):
        want = brute(pairs(docs))
        expect = sorted((d, len((t or "").split("\n")), len((t or "").split("\n")) - len(want[d, t]), hashlib.sha256("\n".join(want[d, t]).encode()).hexdigest()) for d, t in pairs(docs))
        assert sorted(map(tuple, linededup.report(docs).collect())) == expect


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_threshold(lines, n):
    want = sorted((d, len((t or "").split("\n")) - len(kept)) for (d, t), kept in brute(pairs(lines), docs=n).items())
    assert sorted((r["doc_id"], r["n_dropped"]) for r in linededup.report(lines, min_docs=n).collect()) == want


def test_dedup_keeps_columns(lines, no_docs):
    out = linededup.dedup(lines)
    assert out.columns == lines.columns
    want = brute(pairs(lines))
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == sorted((d, "\n".join(k)) for (d, _), k in want.items())
    assert all(r["n_chars"] == len(r["text"]) for r in out.where("text is not null").collect())
    assert linededup.report(no_docs).count() == 0 and linededup.dedup(no_docs).count() == 0
