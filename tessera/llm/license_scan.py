"""License scans: winnowed fingerprints of templates pick candidates, a banded alignment measures them.

Texts become words of letters and digits in lower case. Of the hashes of all K-word runs, the least in every window of
W is a fingerprint; a shared run of W + K - 1 words has one in common for certain. The templates' fingerprints are an
inverted index (hash to template and place). A document's fingerprints that the index holds name templates and
diagonals; around each diagonal, template and text are aligned in a band of 2 * BAND + 1 diagonals, and the share of
the template's words that are matched is its coverage. Of overlapping matches the one with more matched words stays,
and what it displaces is aligned again beside it, so that notices one after another are all found.

The index is as large as the templates, whatever the documents. Runs with a word that no template has cannot match;
their hash is the greatest of all.

Nulls: a null text has no matches; a null id stays null. Empty tables give an empty result; repeated rows are scanned
each. Other columns of the input are not read. Spans are in code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, W, BAND = 3, 3, 6
LEAST_COVERAGE = 0.8
#: Diagonals that are aligned at a time. Templates have up to 8000 words.
AT_ONCE = 1 << 14

#: Notices of public licenses, short forms and headers.
TEMPLATES = {
    "MIT/short": "Released under the MIT License.",
    "MIT/licensed": "Licensed under the MIT License.",
    "MIT/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0/short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0/short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/short": "This work is licensed under the GNU General Public License, version 2.",
    "GPL/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-3.0/short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0/short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0/short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY/long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        split = [words(t.encode()) for t in templates.values()]
        self.word = {w: i + 1 for i, w in enumerate(sorted({w for s in split for w in s}))}
        self.texts = [np.array([self.word[w] for w in s], np.int64) for s in split]
        self.sizes = np.array([len(x) for x in self.texts], np.int64)
        places: list[tuple[int, int, int]] = []
        for t, ids in enumerate(self.texts):
            h = self.hashes(ids)
            places += [(int(h[p]), t, p) for p in winnowed(h)]
        places.sort()
        self.hash = np.array([x[0] for x in places], np.uint64)
        self.template, self.place = (np.array([x[k] for x in places], np.int64) for k in (1, 2))

    @staticmethod
    def hashes(ids: np.ndarray) -> np.ndarray:
        n = len(ids) - K + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(K):
            part = ids[j : j + n]
            known &= part > 0
            out = (out + part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return np.where(known, out, _NONE)

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Templates and diagonals, each pair once, of the fingerprints found in the index."""
        h = self.hashes(ids)
        if not len(h) or (h == _NONE).all():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = winnowed(h)
        low, high = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        n = high - low
        k = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        found = np.unique(np.stack([self.template[k], np.repeat(at, n) - self.place[k]], axis=1), axis=0)
        return found[:, 0], found[:, 1]

    def align(self, t: int, diagonals: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(matched words of the template, first and end of the text's words that are matched) for each diagonal.

        The most words in order within the band; of these the path nearest to the diagonal, then the shorter span. All
        diagonals go through the template together. A path is one number: words, steps off the diagonal, first, last.
        """
        text, width = self.texts[t], 2 * BAND + 1
        one, step, begin = np.int64(1) << 50, np.int64(1) << 36, np.int64(1) << 18
        low = diagonals - BAND  # places in the text are counted from here
        start = -step * np.abs(np.arange(-BAND, BAND + 1))[None, :] + np.int64(begin - 1)  # no first yet; last counts down
        best = np.repeat(start, len(low), axis=0)
        for i, w in enumerate(text):
            row = best - step  # neither word is matched
            row[:, :-1] = np.maximum(row[:, :-1], best[:, 1:] - step)  # the template's word is passed over
            for o in range(width):
                if o:
                    row[:, o] = np.maximum(row[:, o], row[:, o - 1] - step)  # the text's word is
                j = low + i + o
                hit = (j >= 0) & (j < len(ids))
                hit &= ids[np.where(hit, j, 0)] == w
                old, place = best[hit, o], np.int64(i + o)
                first = (old >> 18) & (begin - 1)
                old = old - (old & (begin - 1)) + (begin - 2 - place) + np.where(first == 0, (place + 1) * begin, 0)
                row[hit, o] = np.maximum(row[hit, o], old + one)
            best = row
        top = best.max(1) if len(low) else np.zeros(0, np.int64)
        n = (top + (one >> 1)) >> 50  # the steps are taken off the words
        return np.stack([n, low + ((top >> 18) & (begin - 1)) - 1, low + begin - 1 - (top & (begin - 1))], axis=1)

    def matches(self, text: bytes, least: float) -> list[tuple[str, int, int, float]]:
        """(license, start, end, coverage), in code points, by start.

        Of overlapping matches the one with more matched words is taken; the candidates left out are aligned once more
        with what has been taken out of the text, until nothing is found.
        """
        ids = np.array([self.word.get(w, 0) for w in words(text)], np.int64)
        template, diagonal = self.candidates(ids)
        taken: list[tuple[int, int, int, float]] = []
        while len(template):
            found = np.zeros((len(template), 3), np.int64)
            for t in np.unique(template):
                every = np.nonzero(template == t)[0]
                for at in range(0, len(every), AT_ONCE):
                    found[every[at : at + AT_ONCE]] = self.align(int(t), diagonal[every[at : at + AT_ONCE]], ids)
            size = self.sizes[template]
            good = found[:, 0] >= np.maximum(1, np.ceil(least * size - 1e-9))
            template, diagonal, found, size = template[good], diagonal[good], found[good], size[good]
            left, before = [], len(taken)
            for k in np.lexsort((found[:, 2], found[:, 1], template, -found[:, 0] / size, -found[:, 0])):
                n, first, end = found[k].tolist()
                if (ids[first:end] < 0).any():
                    left.append(k)
                else:
                    ids[first:end] = -1
                    taken.append((first, end, int(template[k]), n / int(size[k])))
            if len(taken) == before:  # spans across what is taken
                break
            template, diagonal = template[left], diagonal[left]
        if not taken:
            return []
        kept = text.translate(_KEEP)
        spans = np.array([m.span() for m in re.finditer(rb"[^ ]+", kept)], np.int64)
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])  # code points before each byte
        return [(self.names[t], int(points[spans[a, 0]]), int(points[spans[b - 1, 1]]), share) for a, b, t, share in sorted(taken)]


def winnowed(h: np.ndarray) -> np.ndarray:
    """Places of the least hash (the last of equal ones) in every window of W."""
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= W:
        at = np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    else:
        views = np.lib.stride_tricks.sliding_window_view(h, W)[:, ::-1]
        at = np.unique(np.arange(len(views)) + W - 1 - views.argmin(1))
    return at[h[at] != _NONE]


_indexes: dict[int, Index] = {}


def index_of(templates: dict[str, str]) -> Index:
    key = hash(tuple(templates.items()))
    if key not in _indexes:
        _indexes[key] = Index(templates)
    return _indexes[key]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, least: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, matches: array of license, start, end, coverage) of each row."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(templates)
        for b in batches:
            found = [[dict(zip(("license", "start", "end", "coverage"), m, strict=True)) for m in index.matches(t.as_py() or b"", least)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["id", "matches"])

    return base.mapInArrow(scanned, f"id {base.schema['id'].dataType.simpleString()}, matches array<struct<license: string, start: long, end: long, coverage: double>>")
