"""Queries over whole tables: what lies beyond a prefix or an id counts too."""

import pytest

from lexloom.plans import catalogue


@pytest.fixture
def rows(spark, tmp_path):
    def of(query, **tables):
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return sorted(tuple(r) for r in catalogue.queries()[query](spark, str(tmp_path)).collect())

    return of


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_char_levenshtein(rows):
    turns = ["same start " * 20 + "one end", "same start " * 20 + "another tail of it", "same start " * 30]
    got = rows("char_levenshtein", conversations=([(1, i, t) for i, t in enumerate(turns)], "conv_id long, turn long, text string"))
    assert got == [(1, i, edits(turns[i].strip(), turns[i + 1].strip())) for i in range(2)] and all(r[2] for r in got)


def test_store_coverage(rows):
    got = rows("store_coverage", documents=([(3,), (50,), (7000,)], "doc_id long"), labels=([(3,), (50,)], "doc_id long"))
    assert got == [(7000, tempo) for tempo in (900, 1000, 1100)]


def test_missing_partitions(rows):
    sizes = [(0, 5), (3, 150), (31, 390), (900, 799), (901, None)]
    assert rows("missing_partitions", documents=(sizes, "doc_id long, n_chars long")) == [(2,), (4,), (5,), (6,)]


def test_limit_evaluated_sparse_ids(rows):
    data = [(i * 10, "s", 1) for i in range(400)]
    assert rows("limit_evaluated", documents=(data, "doc_id long, source string, n_chars long")) == [(i * 10, "s", 1) for i in range(300)]
