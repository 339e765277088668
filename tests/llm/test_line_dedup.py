import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import line_dedup as L
from lodestone.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.cases import awkward, empty
from tests.oracle import assert_same, connect


def _brute(rows, min_docs, keep_first):
    where = defaultdict(list)
    for doc, text in rows:
        for pos, line in enumerate((text or "").encode().split(b"\n")):
            if key := L.line_key(line):
                where[key].append((doc, pos))
    gone = set()
    for at in where.values():
        if len({d for d, _ in at}) >= min_docs:
            gone |= set(sorted(at)[1:] if keep_first else at)
    return {doc: "\n".join(x for p, x in enumerate((text or "").split("\n")) if (doc, p) not in gone) for doc, text in rows}


@pytest.mark.parametrize("keep_first", [False, True])
def test_against_brute_force(spark, keep_first):
    draw = random.Random(5)
    rows = [(i, "\n".join(draw.choice(["common", " COMMON\t", f"rare {draw.randint(0, 60)}", "", "some\r", f"own {i}", "often"]) for _ in range(draw.randint(1, 12)))) for i in range(200)]
    found = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), min_docs=4, keep_first=keep_first)
    assert {r["doc_id"]: r["text"] for r in found.collect()} == _brute(rows, 4, keep_first)


def test_query_equals_sql(spark, sf_dir):
    assert_same(QUERIES["op9_line_dedup"](spark, sf_dir).toPandas(), connect(sf_dir).sql(ORACLE_SQL["op9_line_dedup"]).df())


@pytest.mark.parametrize("keep_first", [False, True])
def test_any_cut_into_partitions_and_batches(keep_first):
    """However sorted rows are cut at (line, document) bounds and batched, the same lines are dropped."""
    draw = random.Random(6)
    rows = sorted({(draw.randint(0, 4), 0, draw.randint(0, 30), 0, draw.randint(0, 3)) for _ in range(150)})
    whole = defaultdict(list)
    for r in rows:
        whole[r[0]].append(r)
    expected = {x for at in whole.values() if len({r[2] for r in at}) >= 9 for x in at[1 if keep_first else 0 :]}
    for _ in range(60):
        bounds = [i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3]]
        cuts = sorted(draw.sample(bounds, draw.randint(0, 6)))
        events = []
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            state, at = L.LineStream(9, keep_first, draw.choice([3, 12, 1000])), a
            while at < b:
                n = min(draw.randint(1, 40), b - at)
                events += state.push(np.array(rows[at : at + n], dtype=np.int64))
                at += n
            events += state.close()
        all_events = np.concatenate(events).tolist()
        totals = defaultdict(int)
        for kind, h1, *_, n in all_events:
            totals[h1] += n if kind == L.EDGE else 0
        waiting = [tuple(e[1:6]) for e in all_events if e[0] == L.OPEN]
        first = {h: min(w for w in waiting if w[0] == h) for h, *_ in waiting}
        found = [tuple(e[1:6]) for e in all_events if e[0] == L.DROP] + [w for w in waiting if totals[w[0]] >= 9 and (not keep_first or w != first[w[0]])]
        assert len(found) == len(set(found)) and set(found) == expected


def test_bitmap_round_trip():
    for dropped in ([0], [7, 3], [100_000], list(range(5000))):
        assert L.unpack_bitmap(L.pack_bitmap(dropped)).tolist() == sorted(dropped)
    assert L.unpack_bitmap(None).tolist() == []


def test_awkward_documents(spark):
    found = L.dedup_lines(awkward(spark), min_docs=2).collect()
    assert len(found) == awkward(spark).count()
    assert {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in found} >= {(2, 1, 0), (3, 1, 0), (4, 2, 0), (1, 1, 0)}
    assert L.dedup_lines(empty(spark)).count() == 0
    same = spark.createDataFrame([(i, "x\nsame") for i in range(12)] + [(0, "x\nother")], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in L.dedup_lines(same, min_docs=10).collect()}
    assert kept == {(i, "") for i in range(12)} | {(0, "other")}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_one_document_of_very_many_equal_lines_takes_linear_time_and_bounded_memory():
    """Rows that are held are at most a batch more than the bound, and a million rows take seconds."""
    state, began, rows = L.LineStream(10, False, 1 << 14), time.time(), 1_000_000
    out = []
    for at in range(0, rows, 4096):
        n = min(4096, rows - at)
        out += state.push(np.column_stack([np.ones(n), np.ones(n), np.full(n, 5), np.zeros(n), np.arange(at, at + n)]).astype(np.int64))
        assert state.n_rows <= (1 << 14) + 4096
    out += state.close()
    assert time.time() - began < 20
    kinds = np.concatenate(out)[:, 0]
    assert (kinds == L.OPEN).sum() == rows and (kinds == L.EDGE).sum() == 1


def test_documents_of_very_many_equal_lines(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD", 50)
    rows = [(i, "again\n" * 300 + f"own {i}") for i in range(12)] + [(20 + i, "seldom\n" * 300) for i in range(3)]
    for keep_first in (False, True):
        found = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep_first=keep_first)
        assert {r["doc_id"]: r["text"] for r in found.collect()} == _brute(rows, 10, keep_first)
