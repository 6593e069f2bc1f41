"""Every query with SQL, on the smallest tables, against DuckDB."""

import datetime
import os
import random

import duckdb
import pytest

from tessera.plans import all_oracles, all_queries

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = dict(all_queries()), dict(all_oracles())


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float) and x != x:
        return None
    return x.isoformat() if isinstance(x, (datetime.datetime, datetime.date)) else x


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    out = duck.execute(ORACLES[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols)) for r in out.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DIR).count() >= 1


def test_text_similarity_over_whole_texts(spark, tmp_path):
    """Against brute force: pairs alike only after 200 characters, only before them, and among short and empty documents."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(300)]
    long = [rng.sample(words, 80) for _ in range(8)]
    rows = []
    for k, base in enumerate(long):
        other = long[(k + 1) % len(long)]
        rows += [base, base[:60] + other[:20], base[:40] + other[40:], other[:30] + base[30:]]
    rows += [["alpha", "bravo", "delta"], ["alpha", "bravo", "delta", "gamma"], ["Alpha", "bravo"], [], [], ["a", "b"]] * 2
    rows = [(i, " ".join(r), "de" if i % 5 == 0 else "en", f"s{i % 3}", len(" ".join(r))) for i, r in enumerate(rows)]
    rows += [(len(rows), None, "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["a"], r["b"]) for r in QUERIES["j09c_text_similarity"](spark, str(tmp_path)).collect()}
    sets = {d: {x for x in (text or "").lower().split(" ") if len(x) > 3} for d, text, *_ in rows}
    alike = lambda a, b: sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and a[3] != b[3] and alike(a[0], b[0])}
    assert got == want and got
