"""The automaton against a plain window search."""

import hashlib
import re

from lumenframe.llm.decontaminate import Automaton, decontaminate, find_contamination, item_words, op1_decontaminate


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower() if (text or "").isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(docs, bench, window=13):
    wins = {}
    for item, text in bench:
        w = words(text)
        if w:
            k = min(window, len(w))
            for i in range(len(w) - k + 1):
                wins.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    sizes = sorted({len(k) for k in wins})
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if found := wins.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= found
        yield doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in op1_decontaminate(spark, sf_dir).collect())
    assert got == sorted(brute(docs, bench))
    assert any(r[2] for r in got)


def test_corners_and_blocks(spark):
    long = " ".join(f"w{i}" for i in range(40))
    bench = [(1, long), (2, "Tiny Item"), (3, ""), (4, None), (5, "one"), (1, long), (6, "w3 w4 w5"), (None, "tiny item tail")]
    docs = [(1, None), (2, ""), (3, long.upper()), (4, "x tiny, ITEM! tail"), (5, "one one one"), (6, " ".join(f"w{i}" for i in range(5, 17))), (7, "w2 w3 w4 w5 w6"), (8, "no match here"), (8, "tiny item"), (8, "tiny item"), (9, "Ünï " + " ".join(f"w{i}" for i in range(20, 33)))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, spans int")
    want = sorted(brute(docs, [("null" if i is None else i, t) for i, t in bench]))
    for block in (1 << 20, 64):
        got = sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in find_contamination(d, b, block_bytes=block).collect())
        assert got == want
        kept = decontaminate(d, b, block_bytes=block)
        assert kept.columns == d.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5])
    assert find_contamination(d.limit(0), b).count() == 0
    assert find_contamination(d, b.limit(0)).where("n_hit > 0").count() == 0


def test_automaton_lengths():
    machine = Automaton([("a", item_words("a b c a b d")), ("b", item_words("b c a"))], 3)
    assert machine.stream([b"b", b"c", b"a", b"b", b"x", b"a", b"b"]) == ([(0, 4)], {"a", "b"})
