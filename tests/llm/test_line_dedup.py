"""Line dedup against plain counting, and the filters' and counts' way back."""

import hashlib
import random

import duckdb

from lumenframe.llm.line_dedup import CuckooFilter, LineStore, _pairs, _shard, build_filters, changed, count_lines, dedup_lines, op10_line_dedup, shard_of, update_filters
from lumenframe.llm.queries import ORACLE

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))


def brute(texts, min_docs):
    counts = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    for t in texts:
        rows = (t or "").split("\n")
        left = [x for x in rows if not (key(x) and counts[key(x)] >= min_docs)]
        yield len(rows), len(rows) - len(left), "\n".join(left)


def cases():
    rng = random.Random(3)
    pool = ["", " ", "Common Line", "common line ", "\tcommon LINE\r", "Überall", "überall", "x", "rare one", "é" * 50]
    texts = [None, "", "\n", "\n\n", "x" * 100_000] + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(8))) for _ in range(60)]
    return [(i // 2, t) for i, t in enumerate(texts)]


def test_all_ways(spark):
    rows = cases()
    docs = spark.createDataFrame([(i, t, "k", 1, 2, 3) for i, t in rows], "doc_id long, text string, key string, _n int, _row int, _marks int").repartition(3)
    want = sorted(brute([t for _, t in rows], 5))
    for most in ((1000, 1000), (0, 1000), (0, 0)):
        out = dedup_lines(docs, 5, broadcast_keys=most[0], filter_keys=most[1])
        assert sorted((r["_n_lines"], r["_n_dropped"], r["_text"]) for r in out.collect()) == want
        assert out.columns == ["doc_id", "key", "_n", "_row", "_marks", "_n_lines", "_n_dropped", "_text"]
        assert {tuple(r)[1:5] for r in out.collect()} == {("k", 1, 2, 3)}
    assert dedup_lines(docs.limit(0), 5).count() == 0


def test_query_and_sql(spark, sf_dir):
    got = sorted(map(tuple, op10_line_dedup(spark, sf_dir).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.execute(ORACLE["op10_line_dedup"]).fetchall())
    assert any(r[2] for r in got)


def test_counts_can_be_undone(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    more = spark.createDataFrame([(1000 + i, "Common line\nnew line") for i in range(6)], "doc_id long, text string")
    table = count_lines(docs)
    grown = changed(table, added=more)
    back = changed(grown, removed=more)
    plain = lambda t: sorted((bytes(r.key), r.n_docs) for r in t.collect())
    assert plain(grown) == plain(count_lines(docs.union(more)))
    assert plain(back) == plain(table)
    filters = build_filters(table, 5, 3)
    up = update_filters(filters, table, grown, 5, 3)
    hashed = [bytes(r.key) for r in grown.where("n_docs >= 5").collect()]
    held = {r.shard: CuckooFilter.load(r.cuckoo) for r in up.collect()}
    pairs = _pairs(hashed)
    assert all(held[int(s)].contains(p[None])[0] for s, p in zip(shard_of(pairs, 3), pairs, strict=True))
    down = update_filters(up, grown, back, 5, 3)
    assert sum((CuckooFilter.load(r.cuckoo).table > 0).sum() for r in down.collect()) == table.where("n_docs >= 5").count()


def test_store_grows_and_shrinks(spark):
    """Filters that get full are built anew; after any changes the store drops what a new one would."""
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = [f"line {i}" for i in range(400)]
    more = spark.createDataFrame([(1000 + i, "\n".join(lines)) for i in range(6)], "doc_id long, text string")
    store = LineStore(docs, 5)
    store.change(added=more)
    both = docs.unionByName(more)
    plain = lambda d, s: sorted((r["_n_lines"], r["_n_dropped"], r["_text"]) for r in dedup_lines(d, 5, store=s).collect())
    assert plain(both, store) == plain(both, LineStore(both, 5)) == sorted(brute([r.text for r in both.collect()], 5))
    store.change(removed=more)
    assert plain(docs, store) == sorted(brute([t for _, t in rows], 5))
    assert sum((CuckooFilter.load(r.cuckoo).table > 0).sum() for r in store.filters.collect()) == store.often().count()


def test_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    pairs = _pairs(keys)
    held = CuckooFilter.of(pairs[:2500])
    assert held.contains(pairs[:2500]).all()
    assert held.contains(pairs[2500:]).mean() < 0.01
    for bucket, prints in zip(*(x.tolist() for x in held._first(pairs[:1250])), strict=True):
        assert held.delete(bucket, prints)
    assert held.contains(pairs[1250:2500]).all()
    assert (held.table > 0).sum() == 1250


def test_shard_column(spark):
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(50)]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    assert [r[0] for r in df.select(_shard(7)).collect()] == shard_of(_pairs(keys), 7).tolist()
