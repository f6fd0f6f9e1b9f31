"""The scan against the bare patterns on every text, and the guess costs."""

import hashlib
import math
import random
import re
import time

from lumenframe.llm import secrets
from lumenframe.llm.secrets import guess_cost, op9_secret_scan, ranks_of, scan_secrets, spans_of


def base(text):
    out = []
    for kind, pattern, least, group in (
        (0, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
        (1, r"AKIA[A-Z0-9]+", 20, 0),
        (2, r"[0-9a-f]+", 24, 0),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op9_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert sum(r.n_assign + r.n_access + r.n_hex for r in rows)
    for r in rows:
        want = base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_corners(spark):
    texts = [
        None, "", "a" * 23, "a" * 24, "éé PASSWORD = 'abc123x'", "passwd:short secret=tiny token=longenough", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAKIA" + "B7" * 12,
        "paſſword=abcdefgh toKen=abcdefgh", "apikey:=abcdef api_key: \"A/b+c=_.-x\"", "secret  :  password=abcdefg", "f" * 30 + "\n" + "0" * 40, "deadbeef" * 3,
        "\U0001F600 the passphrase is Tr9$kQz!w2Lx and the pwd: qwerty2020", "word " * 30_000 + "token=abcdefghij", "token=" + "x" * 100_000,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "f" * 24), (None, "token=abcdef")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kind string").coalesce(2)
    got = sorted((r.doc_id is None, r.doc_id, [f"{x.kind}:{x.start}:{x.end}" for x in r.spans if x.kind != "guess"]) for r in scan_secrets(df).collect())
    assert got == sorted((i is None, i, base(t)) for i, t in rows)
    kinds = [(t[s:e], k) for t in texts[14:15] for s, k, e in spans_of(t)]
    assert kinds == [("Tr9$kQz!w2Lx", "guess")]
    assert scan_secrets(df.limit(0)).count() == 0


def test_guess_cost():
    assert guess_cost("password") < 1 and guess_cost("P4ssw0rd") < 2
    assert guess_cost("qwertyuiop") < 3 and guess_cost("aaaaaaaaaa") < 3 and guess_cost("abcabcabc") < 5.5
    assert guess_cost("2020-10-11") < 5.5
    assert guess_cost("dragon2019") < guess_cost("dkxvqn7301")
    assert guess_cost("b7db7aa4a5fcc78305") > 15
    assert guess_cost("qwerty2020") < 9 < guess_cost("Tr9$kQz!w2Lx")


def cheapest(value, rank):
    """Every segmentation, with the cost of each piece stated anew."""
    plain = value.lower().translate(secrets.LEET)

    def pieces(a, b):
        x = value[a:b]
        if b - a == 1:
            yield math.log10(10 if x.isdigit() else 26 if x.isalpha() else 33)
        if 3 <= b - a <= secrets.WORD_LETTERS[1]:
            ups = sum(c.isupper() for c in x)
            case = 0 if not ups else 0.3 if ups in (1, len(x)) else 0.3 * ups
            for form, extra in ((x.lower(), 0), (plain[a:b], 0.5)):
                if form in rank:
                    yield math.log10(rank[form] + 1) + extra + case
            if all(secrets._near(p, q) for p, q in zip(x.lower(), x.lower()[1:], strict=False)):
                turns = sum(secrets.PLACE[p][0] != secrets.PLACE[q][0] for p, q in zip(x.lower(), x.lower()[1:], strict=False))
                yield math.log10(len(secrets.PLACE)) + math.log10(len(x)) + turns * math.log10(4)
            for size in range(1, 9):
                if len(x) % size == 0 and len(x) // size > 1 and x[:size] * (len(x) // size) == x:
                    yield sum(math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33) for c in x[:size]) + math.log10(len(x) // size)
        found = secrets.DATE.match(value, a)
        if found and found.end() == b:
            yield math.log10(200) + (0 if b - a == 4 else math.log10(365))

    def best(a):
        return 0.0 if a == len(value) else min(cost + best(b) for b in range(a + 1, len(value) + 1) for cost in pieces(a, b))

    return best(0)


def test_every_segmentation():
    rng = random.Random(8)
    rank = ranks_of(["word", "ordinary", "thing"])
    parts = ["word", "W0rd", "thing", "dragon", "2019", "qwe", "asd", "aa", "abab", "7", "Q", "!", "zx", "x1"]
    for _ in range(250):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))[:11]
        assert abs(guess_cost(value, rank=rank) - cheapest(value, rank)) < 1e-9, value


def test_plain_words_are_no_secrets(spark):
    prose = ["the password is required for authentication", "password: international", "the token is authentication", "a passphrase is recommended and required"]
    texts = prose * 3 + ["international authentication required recommended", "the password is xK9$wq!Lz0Rt"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][x.start : x.end] for x in r.spans if x.kind == "guess"] for r in scan_secrets(df).collect()}
    assert {i: x for i, x in got.items() if x} == {13: ["xK9$wq!Lz0Rt"]}


def test_long_values(spark):
    mixed = "".join(random.Random(1).choices("abcXYZ0189!$@~#%", k=1000))
    texts = [f"pwd: {mixed} end", f"access key = {mixed}", "credential ->" + " " * 30 + mixed, "the password" + "\t" * 20 + "is" + " " * 50 + '"' + mixed + '"', "pwd: " + "a" * 1000, "pwd: " + "qw" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][x.start : x.end] for x in r.spans if x.kind == "guess"] for r in scan_secrets(df).collect()}
    assert got == {0: [mixed], 1: [mixed], 2: [mixed], 3: [mixed], 4: [], 5: []}


def test_cost_under_a_limit():
    rng = random.Random(2)
    pieces = ["password", "P4ss", "dragon", "2019", "2020-10-11", "qwerty", "asdf", "aaaa", "abcabc", "1212", "zx", "7", "Q", "!", "qwqwqw", "11111111"]
    for _ in range(500):
        value = "".join(rng.choice(pieces) * rng.choice((1, 1, 1, 4)) for _ in range(rng.randint(1, 5)))
        whole = guess_cost(value)
        for limit in (3.0, 6.0, 9.0, 15.0):
            cost = guess_cost(value, limit)
            assert abs(cost - whole) < 1e-9 if whole < limit - 1e-9 else cost >= limit - 1e-9
    began = time.process_time()
    for value in ("x" * 50_000, "qw" * 25_000, "asdfghjkl" * 5_000, "ab1" * 20_000, "password" * 10_000):
        guess_cost(value, 9.0)
    assert guess_cost("x" * 50_000, 9.0) < 7
    assert time.process_time() - began < 60


def test_copied_secrets_are_not_learned(spark):
    """A value costs the same in one document as in its copies; words that texts use elsewhere are still learned, letters beyond ASCII beside them."""
    of = lambda texts: [[(x.kind, x.start, x.end) for x in r.spans] for r in scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    text = "é my PassPhrase is qzxjvkwpyd, and"
    once = of([text])
    assert once == [[("guess", 19, 29)]]
    assert of([text] * 50) == once * 50 and of([text * 9, "", None])[0][0] == once[0][0]
    words = spark.createDataFrame([("ü token: florkitude florkitude\nflorkitude",), ("florkitude é",), ("secret = quuxible",), ("pwd: quuxible",), ("passcode -> quuxible",), (None,)], "text string")
    learned = secrets.frequent_words(words)
    assert learned == ["florkitude"] and of(["a florkitude"] * 3 + ["the passphrase is florkitude"])[3] == []
