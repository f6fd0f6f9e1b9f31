"""Licence notices in texts: fixed phrases, and short notices with a bounded number of edits.

A text's words (A-Z lower-cased) are laid out with one space after each. A notice of e allowed
edits is split into e + 1 pieces, so that any run of words within e edits of it holds one piece
unchanged. One automaton finds all pieces and all fixed phrases; a piece's place bounds where
the run can start and end, and the regex library's bounded-error matching decides each such run
of whole words and says how many edits it takes.

A run counts if the edit distance in code points between it (its words joined by single
spaces) and the notice is at most the notice's. Of a notice's runs that overlap, the one with
the fewest edits is reported, then the first, then the shortest. The score of a document is 1
if a fixed phrase stands in it, else the best 1 - edits / (code points of the notice), else 0.

Defined results: a null or empty text has no words, no label and score 0; each row is one
document, also where ids repeat; a null id is kept; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import prepared, released
from .textbatch import ALNUM, LOWER, list_array, slices, words

#: Phrases of the contract and their labels. Fixed values.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Short notices as their licences give them (words only), their labels, and the edits allowed. Fixed values.
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 4),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache", 4),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", 4),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 4),
    ("neither the name of the copyright holder nor the names of its contributors may be used", "bsd", 4),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 4),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("boost software license", "boost", 2),
    ("creative commons attribution", "cc-by", 3),
    ("creative commons zero", "cc0", 2),
    ("cc by nc", "cc-by-nc", 0),
    ("cc by sa", "cc-by-sa", 0),
    ("cc by nd", "cc-by-nd", 0),
    ("this is free and unencumbered software released into the public domain", "unlicense", 4),
)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of about one length, with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Search:
    """The automaton over pieces and phrases, and the pattern of each notice."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases, self.notices = phrases, notices
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for i, (phrase, _) in enumerate(phrases):
            found.setdefault(phrase + " ", []).append((True, i, 0))
        for i, (notice, _, edits) in enumerate(notices):
            for offset, piece in pieces(notice, edits):
                found.setdefault(piece, []).append((False, i, offset))
        for key, what in found.items():
            self.automaton.add_word(key, (len(key), what))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={e}}}") for n, _, e in notices]

    def edits(self, notice: int, run: str) -> int | None:
        """The least edits that make the run the notice, or None beyond the bound."""
        text, _, most = self.notices[notice]
        if abs(len(run) - len(text)) > most:
            return None
        if run == text:
            return 0
        match = self.patterns[notice].fullmatch(run)
        return sum(match.fuzzy_counts) if match else None


@lru_cache(4)
def _search(phrases, notices) -> Search:
    return Search(phrases, notices)


def _laid_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with one space after each, and where each word begins (with the end of all)."""
    sizes = ends - starts + 1
    begins = np.concatenate(([0], np.cumsum(sizes)))
    out = data[np.minimum(np.arange(begins[-1]) + np.repeat(starts - begins[:-1], sizes), len(data) - 1)] if len(data) else data
    out[begins[1:] - 1] = 0x20
    return out, begins


def _runs(search: Search, raw: bytes, begins: list[int], lo: int, hi: int, notice: int, at: int, offset: int, size: int, tried: dict) -> None:
    """Tries every run of words lo to hi that may hold the notice with its piece, of size bytes, at a place."""
    text, _, edits = search.notices[notice]
    # an edit takes away one byte of the notice at most, or brings four in
    first = np.searchsorted(begins, at - offset - 4 * edits)
    last = np.searchsorted(begins, at - offset + edits, "right")
    left = len(text) - offset - size
    low, high = at + size + left - edits, at + size + left + 4 * edits
    for s in range(max(lo, int(first)), min(hi, int(last))):
        # words end one byte, the space, before the next begins
        e = max(s + 1, int(np.searchsorted(begins, low + 1)))
        while e <= hi and begins[e] - 1 <= high:
            if (notice, s, e) not in tried:
                tried[notice, s, e] = search.edits(notice, raw[begins[s] : begins[e] - 1].decode())
            e += 1


def _best(tried: dict) -> list[tuple[int, int, int, int]]:
    """notice, first word, end word and edits of the runs to report."""
    out: list[tuple[int, int, int, int]] = []
    for i, s, e, d in sorted(((i, s, e, d) for (i, s, e), d in tried.items() if d is not None), key=lambda x: (x[0], x[3], x[1], x[2])):
        if not any(j == i and s < f and b < e for j, b, f, _ in out):
            out.append((i, s, e, d))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


SPAN = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64())])
FOUND = "n_words long, places array<struct<label: string, word: long>>, spans array<struct<label: string, notice: string, first_word: long, end_word: long, edits: long>>"


def _scan(phrases, notices):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(phrases, notices)
        for batch in batches:
            for row, end, data, offsets in slices(batch):
                data = LOWER[data]
                starts, ends, bounds = words(data, offsets, ALNUM)
                flat, begins = _laid_out(data, starts, ends)
                raw, edges = flat.tobytes(), bounds.tolist()
                places: list[list] = [[] for _ in range(end - row)]
                tried: dict[int, dict] = {}
                # latin-1 gives one character to each byte, so places in the automaton's text are places in raw
                for last, (size, what) in search.automaton.iter(raw.decode("latin-1")):
                    at = last - size + 1
                    word = int(np.searchsorted(begins, at, "right")) - 1
                    doc = int(np.searchsorted(bounds, word, "right")) - 1
                    for fixed, i, offset in what:
                        if not fixed:
                            _runs(search, raw, begins, edges[doc], edges[doc + 1], i, at, offset, size, tried.setdefault(doc, {}))
                        elif begins[word] == at and begins[min(edges[doc + 1], len(begins) - 1)] > last:
                            places[doc].append((search.phrases[i][1], word - edges[doc]))
                spans = [[(search.notices[i][1], search.notices[i][0], s - edges[d], e - edges[d], n) for i, s, e, n in _best(tried.get(d, {}))] for d in range(end - row)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, end - row),
                        pa.array(np.diff(bounds), pa.int64()),
                        list_array(pa.array([{"label": x, "word": w} for p in places for x, w in p], pa.struct([("label", pa.string()), ("word", pa.int64())])), np.array([len(p) for p in places])),
                        list_array(pa.array([dict(zip(SPAN.names, x, strict=True)) for p in spans for x in p], SPAN), np.array([len(p) for p in spans])),
                    ],
                    ["doc_id", "n_words", "places", "spans"],
                )

    return run


def find_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Per document: doc_id, n_words, places (label and first word of every fixed phrase), spans (label, notice, words from first_word to end_word, edits). Nothing is shuffled."""
    prepared(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(_scan(phrases, notices)), f"doc_id {kind}, {FOUND}")


def score() -> Column:
    """1 with a fixed phrase, else the best likeness of a span, else 0."""
    best = F.array_max(F.transform("spans", lambda x: 1 - x["edits"] / F.length(x["notice"])))
    return F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0)))


def _joined(*labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*labels))), ",")


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        _joined(F.col("places.label")).alias("base_labels"),
        _joined(F.col("places.label"), F.col("spans.label")).alias("labels"),
        score().alias("score"),
    )
