"""Runs of fewer lines than three are removed as well if they have over 50 words."""

import hashlib
from collections import defaultdict

import duckdb
import pytest

from ledgerlens.llm import queries
from ledgerlens.llm.lines import removed_lines
from tests.llm import brute
from tests.llm.conftest import plain


def removed(rows, least=3, long=50):
    """By maximal runs: every run that has a copy before it, of whatever length, counts by its lines or its words."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    lines = {row: [x for x in (row[1] or "").split("\n") if brute.words(x)] for row in order}
    first, gone = set(), defaultdict(set)
    for row in order:
        own = lines[row]
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                run = tuple(own[i:j])
                if run in first and (j - i >= least or sum(len(brute.words(x)) for x in run) > long):
                    gone[row].update(range(i, j))
                first.add(run)
    out = []
    for row in rows:
        kept, number = [], 0
        for line in (row[1] or "").split("\n"):
            if not (brute.words(line) and number in gone[row]):
                kept.append(line)
            number += bool(brute.words(line))
        out.append((row[0], number, len(gone[row]), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_single_lines_pairs_and_short_copies(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [
        (1, f"{line('a', 51)}\nown one\n{line('b', 26)}\n\n{line('c', 25)}\nend one"),
        (2, f"start\n{line('a', 51)}"),  # one long line
        (3, f"{line('b', 26)}\n{line('c', 25)}\nown three"),  # two lines that are long together
        (4, line("d", 50)),
        (5, line("d", 50)),  # not over 50 words
        (6, f"{line('e', 60)}\n{line('f', 2)}"),
        (7, f"{line('e', 60)}\n{line('f', 2)}"),  # an exact copy of two lines
        (None, f"x\ny\nz\n{line('a', 51)}\nx\ny\nz\n{line('a', 51)}"),
    ]
    found = removed_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), long=50).collect()
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0, 6: 0, 7: 2, None: 5}
    assert plain(found) == plain(removed(rows))


@pytest.mark.parametrize("least, long", [(3, 50), (5, 12)])
def test_all_runs(spark, edge, edge_pairs, empty, least, long):
    assert plain(removed_lines(spark, edge, least, long).collect()) == plain(removed(edge_pairs, least, long))
    assert removed_lines(spark, empty, least, long).collect() == []


def test_query_equals_sql(spark, small):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    found = queries.queries()["op2_repeated_lines"](spark, small).collect()
    assert plain(found) == plain(c.execute(queries.oracle_sql()["op2_repeated_lines"]).fetchall())
    assert sum(r.n_removed for r in found) > sum(r.n_removed for r in removed_lines(spark, spark.read.parquet(f"{small}/documents.parquet")).collect()) > 0
