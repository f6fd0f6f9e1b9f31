"""Secret scans: fixed patterns, and values in credential contexts that are costly to guess.

A value after a credential word is cut into words, dates, repeats, keyboard walks and
brute-force spans; dynamic programming finds the segmentation with the fewest guesses. Values
at or above the limit look made by a machine and become spans of the kind "guess"; cheap ones
(placeholders, dictionary words with a year) are left to the fixed patterns.

The dictionary is the collection's own: its most frequent words by their number in all texts, but
for those that stand in values after credential words only, so that a secret isn't learned from its
copies (`frequent_words`), after a short fixed list of words that passwords are made of. A word's rank is
what it costs, so plain prose after "password is" is cheap.

Texts are screened by fast byte searches first, which let every possible match through.
Defined results: a null or empty text has no spans; each row is scanned by itself, so ties and
repeated rows repeat; positions are code points, ends exclusive; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.ranking import numbered

from .cluster import prepared, released
from .textbatch import ALNUM, LOWER, slices, words

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "guess")

#: Credential words, and what may stand between them and the value.
CONTEXT_WORDS = ("passphrase", "passcode", "password", "passwd", "pwd", "secret", "token", "api key", "api-key", "api_key", "apikey", "access key", "access_key", "private key", "private_key", "credential", "auth_key")
CONTEXT = re.compile(rf"""(?i:{"|".join(map(re.escape, CONTEXT_WORDS))})["']?\s*+(?:(?i:is|was)\s|[:=]|->|=>)\s*+["']?([\x21\x23-\x26\x28-\x7E]{{6,}})""", re.ASCII)
CUES = tuple(sorted({w.encode() for w in CONTEXT_WORDS}))
BASE_CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
GUESS_LOG10 = 9.0

#: Common words of passwords, the most common first.
COMMON = """password qwerty admin welcome login letmein dragon monkey master shadow sunshine princess football baseball
iloveyou superman batman trustno access hello freedom whatever michael jordan hunter ranger buster soccer hockey killer
george andrew charlie thomas daniel jessica pepper ginger joshua maggie summer winter spring autumn flower secret test
guest user root default changeme example sample demo temp pass token key server database backup system network oracle
mysql linux windows google apple amazon github docker company internal office manager support service client public
private account january february march april june july august september october november december monday friday love
star magic happy lucky silver golden orange purple yellow green blue black white tiger eagle""".split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
#: Words that the dictionary learns from the documents: at most so many, each at least so frequent, of so many letters.
DICTIONARY, LEAST_COUNT, WORD_LETTERS = 100_000, 3, (3, 24)
LEET = str.maketrans("4@8(36!1|0$5+72", "aabcegiiiossttz")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (r, i + 0.5 * r) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.](?:0[1-9]|1[0-2])[-/.](?:19|20)?\d\d")


def _near(a: str, b: str) -> bool:
    if a not in PLACE or b not in PLACE or a == b:
        return False
    (r, x), (s, y) = PLACE[a], PLACE[b]
    return abs(r - s) <= 1 and abs(x - y) <= 1


def _alphabet(ch: str) -> float:
    return math.log10(10 if ch.isdigit() else 26 if ch.isalpha() else 33)


def ranks_of(words: list[str]) -> dict[str, int]:
    """Ranks of the fixed words and then of words by falling frequency."""
    out = dict(RANK)
    for w in words:
        out.setdefault(w, len(out) + 1)
    return out


def guess_cost(value: str, limit: float = math.inf, rank: dict[str, int] = RANK) -> float:
    """log10 of the guesses for the cheapest segmentation of the value; from the limit on, a number not below it.

    Costs only add up, so nothing is continued from a prefix at or above the limit, and once no
    prefix under it is left ahead, the whole value is above it. A long repeat or keyboard walk is
    not followed again from a place that an earlier start serves at least as well.
    """
    n, low = len(value), value.lower()
    best = [0.0] + [math.inf] * n
    ahead = 0

    def reach(j: int, cost: float) -> None:
        nonlocal ahead
        best[j] = min(best[j], cost)
        if cost < limit:
            ahead = max(ahead, j)

    plain = low.translate(LEET)
    walk_end, walk_from, turned = 0, 0, [0] * (n + 1)
    repeats: dict[tuple[int, int], tuple[int, int]] = {}
    for i in range(n):
        if i > ahead:
            return max(limit, best[i])
        if i and _near(low[i - 1], low[i]):
            turned[i] = turned[i - 1] + (PLACE[low[i]][0] != PLACE[low[i - 1]][0])
        else:
            turned[i] = turned[i - 1] if i else 0
        here = best[i]
        if here >= limit:
            continue
        reach(i + 1, here + _alphabet(value[i]))
        for j in range(i + 3, min(n, i + WORD_LETTERS[1]) + 1):
            for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.5)):
                if form in rank:
                    ups = sum(c.isupper() for c in value[i:j])
                    reach(j, here + math.log10(rank[form] + 1) + extra + (0 if not ups else 0.3 if ups in (1, j - i) else 0.3 * ups))
        if found := DATE.match(value, i):
            reach(found.end(), here + math.log10(200) + (0 if found.end() - i == 4 else math.log10(365)))
        if i >= walk_end or best[walk_from] + math.log10((i - walk_from + 3) / 3) + math.log10(4) * (turned[i] - turned[walk_from]) > here:
            walk_from, j, turns = i, i + 1, 0
            while j < n and _near(low[j - 1], low[j]):
                turns += PLACE[low[j]][0] != PLACE[low[j - 1]][0]
                j += 1
                if j - i >= 3:
                    cost = here + math.log10(len(PLACE)) + math.log10(j - i) + turns * math.log10(4)
                    if cost >= limit:
                        break
                    reach(j, cost)
            walk_end = j
        for size in range(1, min(8, (n - i) // 2) + 1):
            start, end = repeats.get((size, i % size), (0, 0))
            if i + size <= end and best[start] + math.log10((i - start) // size + 1) <= here:
                continue
            unit, j = value[i : i + size], i + size
            if not value.startswith(unit, j):
                continue
            base = here + sum(map(_alphabet, unit))
            while value.startswith(unit, j):
                j += size
                cost = base + math.log10((j - i) // size)
                if cost >= limit:
                    break
                if j - i >= 3:
                    reach(j, cost)
            repeats[size, i % size] = (i, j)
    return best[n]


def spans_of(text: str, limit: float = GUESS_LOG10, rank: dict[str, int] = RANK) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:)]}>")
        if len(value) >= 6 and guess_cost(value, limit, rank) >= limit:
            out.append((m.start(1), 3, m.start(1) + len(value)))
    return [(s, KINDS[k], e) for s, k, e in sorted(set(out))]


def _long_hex(data: np.ndarray, offsets: np.ndarray, least: int = 24) -> np.ndarray:
    """The texts that may hold a hex run of that many bytes."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:103] = True
    breaks = np.flatnonzero(~table[data])
    gaps = np.diff(np.concatenate(([-1], breaks, [len(data)])))
    ends = np.concatenate((breaks, [len(data)]))[gaps > least]
    starts = ends - gaps[gaps > least] + 1
    first, last = np.searchsorted(offsets, starts, "right") - 1, np.searchsorted(offsets, ends, "left")
    return np.unique(np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])) if len(starts) else np.zeros(0, int)


def _cued(low: bytes, offsets: np.ndarray, cues: list[bytes]) -> set[int]:
    """The texts that hold one of the cues."""
    some, where = set(), offsets.tolist()
    for cue in cues:
        at = low.find(cue)
        while at >= 0:
            text = int(np.searchsorted(offsets, at, "right")) - 1
            some.add(text)
            at = low.find(cue, where[text + 1])
    return some


def _in_values(raw: bytes, low: bytes, offsets: np.ndarray) -> np.ndarray:
    """Which bytes lie in a value after a credential word."""
    inside = np.zeros(len(raw), bool)
    for d in _cued(low, offsets, list(CUES)):
        start = int(offsets[d])
        # one character for each byte; the pattern tells ASCII alone apart
        for m in CONTEXT.finditer(raw[start : int(offsets[d + 1])].decode("latin-1")):
            inside[start + m.start(1) : start + m.end(1)] = True
    return inside


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of ASCII letters, lower-cased, with their number in the batch and how many of them stand outside values of credentials."""
    letters = np.zeros(256, bool)
    letters[97:123] = True
    for batch in batches:
        for _, _, data, offsets in slices(batch):
            raw, data = data.tobytes(), LOWER[data]
            inside = _in_values(raw, data.tobytes(), offsets)
            starts, ends, _ = words(data, offsets, ALNUM)
            plain = np.concatenate(([0], np.cumsum(letters[data])))
            size = ends - starts
            fit = (size >= WORD_LETTERS[0]) & (size <= WORD_LETTERS[1]) & (plain[ends] - plain[starts] == size)
            # words and what lies between them by turns, so that the bytes needn't be copied
            bounds = np.append(np.stack((starts, ends), 1).ravel(), len(data)).astype(np.int64)
            if not fit.any():
                continue
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
            for chosen, counted, sign in ((fit, 1, 1), (fit & inside[starts], 0, -1)):
                if chosen.any():
                    counts = column.take(pa.array(2 * np.flatnonzero(chosen))).value_counts()
                    n = counts.field("counts").to_numpy()
                    yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.large_string()).cast(pa.string()), pa.array(n * counted), pa.array(n * sign)], ["word", "n", "outside"])


def frequent_words(docs: DataFrame, most: int = DICTIONARY, least: int = LEAST_COUNT) -> list[str]:
    """The most frequent words of all texts that stand outside values of credentials too, at most so many, those of equal number in order of their letters."""
    prepared(docs.sparkSession)
    counts = docs.select("text").mapInArrow(released(_count), "word string, n long, outside long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("outside").alias("outside"))
    counts = counts.where((F.col("n") >= least) & (F.col("outside") > 0))
    # places over ranges: a sort with a limit would send so many words from each task
    ranked = numbered(counts.select("word", F.struct((-F.col("n")).alias("n"), "word").alias("order")), "order")
    first = ranked.where(F.col("i") < most).select("i", "word").collect()
    return [r.word for r in sorted(first)]


def _scan(limit: float, dictionary):
    cues = sorted({*BASE_CUES, *CUES})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks_of(dictionary.value)
        for batch in batches:
            for row, end, data, offsets in slices(batch):
                raw, where = data.tobytes(), offsets.tolist()
                low = raw.lower()
                some = {*_long_hex(data, offsets).tolist(), *_cued(low, offsets, cues), *_cued(raw, offsets, [b"AKIA"])}
                found = [spans_of(raw[where[d] : where[d + 1]].decode(), limit, rank) if d in some else [] for d in range(end - row)]
                rows = [[{"kind": k, "start": s, "end": e} for s, k, e in x] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "spans"],
                )

    return run


def scan_secrets(docs: DataFrame, limit: float = GUESS_LOG10, dictionary: list[str] | None = None) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> by start and then kind. dictionary: words by falling frequency, by default those of docs."""
    prepared(docs.sparkSession)
    # at most DICTIONARY words
    dictionary = docs.sparkSession.sparkContext.broadcast(frequent_words(docs) if dictionary is None else dictionary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(_scan(limit, dictionary)), f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"] != "guess")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
