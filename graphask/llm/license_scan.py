"""Licence notices found by conditional compression.

A block of text that repeats a licence compresses much better when the licence is the
compressor's dictionary. The words around a hint are compressed with each template as
raw dictionary, the templates ranked by the bytes they save, and all that save any are
confirmed by the exact differences in wording, over every place that covers the hint.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphask.llm.textbytes import in_small_batches

#: Words that may differ from a template, as a share of its words; two may in any template of five words or more.
MOST_DIFFERENT = 0.2
LEVEL = 3

# Ways to name a licence, its usual openings, and notices in words of their own.
OPENINGS = (
    "licensed under",
    "this work is licensed under",
    "released under",
    "distributed under the terms of",
    "made available under the terms of",
)
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0"),
    "MIT": ("the MIT License",),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0"),
    "EPL-2.0": ("the Eclipse Public License, version 2.0", "the Eclipse Public License v. 2.0"),
    "BSL-1.0": ("the Boost Software License, Version 1.0",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "ISC": ("the ISC License",),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal",),
}
_FREE_SOFTWARE = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by "
    "the Free Software Foundation; either version {2} of the License, or (at your option) any later version"
)
#: License, notice, and the words that a text must have for this license and no close one.
NOTICES = (
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License.",
        "apache 2.0",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
        "permission software",
    ),
    ("GPL-3.0", _FREE_SOFTWARE.format("program", "General Public License", "3"), "general public 3"),
    ("GPL-2.0", _FREE_SOFTWARE.format("program", "General Public License", "2"), "general public 2"),
    ("LGPL-3.0", _FREE_SOFTWARE.format("library", "Lesser General Public License", "3"), "lesser public 3"),
    ("LGPL-2.1", _FREE_SOFTWARE.format("library", "Lesser General Public License", "2.1"), "lesser public 2.1"),
    ("AGPL-3.0", _FREE_SOFTWARE.format("program", "Affero General Public License", "3"), "affero public 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "redistribution conditions",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted",
        "permission fee",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.",
        "as-is warranty",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright", "waived copyright"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered domain"),
)
#: Words of which every template has one; a notice is looked for around each.
_HINT = re.compile(
    r"licen[cs]ed?\b|\b(?:released|distributed)[\W_]+under\b|under[\W_]+the[\W_]+terms|permission[\W_]+(?:is[\W_]+hereby|to[\W_]+use)"
    r"|\bredistribut|free[\W_]+of[\W_]+charge|public[\W_]+domain|unencumbered|waived|\bcc0\b|\bcc[\W_]+by\b|\bas-is\b|held[\W_]+liable",
    re.IGNORECASE,
)
_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
#: Words of a name that tell nothing.
_PLAIN = frozenset({"a", "the", "version", "v", "international"})
_STRETCH = 2_048


class Match(NamedTuple):
    license: str
    start: int
    end: int
    bytes_saved: int
    words_different: int


class Template(NamedTuple):
    license: str
    words: list[str]
    required: frozenset[str]
    most_different: int
    compressor: zstandard.ZstdCompressor


Word = tuple[str, int, int]


def _words(text: str, offset: int = 0) -> list[Word]:
    return [(m.group().lower(), offset + m.start(), offset + m.end()) for m in _WORD.finditer(text)]


@lru_cache(maxsize=1)
def templates() -> list[Template]:
    """All templates: every opening with every name, and the notices."""
    listed = [
        (license, f"{opening} {name}", frozenset(w for w, _, _ in _words(name)) - _PLAIN)
        for license, names in NAMES.items()
        for name in names
        for opening in OPENINGS
    ]
    listed += [(license, notice, frozenset(required.split())) for license, notice, required in NOTICES]
    made = []
    for license, notice, required in listed:
        words = [w for w, _, _ in _words(notice)]
        most = max(int(MOST_DIFFERENT * len(words)), 2 if len(words) >= 5 else 0)
        raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        made.append(Template(license, words, required, most, zstandard.ZstdCompressor(dict_data=raw, write_content_size=False)))
    return made


def closest(template: list[str], found: list[str], cover: int | None = None) -> tuple[int, int, int]:
    """Fewest words missing plus words added (a replaced word is both) of any run of ``found``, and its start and end.

    With ``cover`` only runs that hold this position count. Of equally good runs the longest,
    which has most words of the template, counts, and of these the first.
    """
    size = len(found)
    # Costs and, below them, where the run starts, as one number.
    unit = size + 1
    last_start = size if cover is None else cover
    row = [min(j, last_start) + unit * max(j - last_start, 0) for j in range(size + 1)]
    for word in template:
        above, row = row, [row[0] + unit]
        for j, other in enumerate(found):
            best = min(above[j + 1], row[j]) + unit
            row.append(min(best, above[j]) if word == other else best)
    first_end = 0 if cover is None else cover + 1
    end = min(range(first_end, size + 1), key=lambda j: (row[j] // unit, row[j] % unit - j, j))
    return row[end] // unit, row[end] % unit, end


def _around(text: str, at: int, floor: int, before: int, after: int) -> tuple[list[Word], int]:
    """Up to ``before`` words from ``floor`` on before the word at ``at``, it and ``after`` more, and its position."""
    width = _STRETCH
    while True:
        lo, hi = max(floor, at - width), min(len(text), at + width)
        words = _words(text[lo:hi], lo)
        # A stretch may cut a word at each end.
        if lo > floor and words:
            words = words[1:]
        if hi < len(text) and words:
            words = words[:-1]
        here = bisect_right(words, at, key=lambda w: w[1]) - 1
        enough_before = lo == floor or here >= before
        enough_after = hi == len(text) or len(words) - here > after
        if enough_before and enough_after:
            break
        width *= 2
    here = max(here, 0)
    begin = max(0, here - before)
    return words[begin : here + after + 1], here - begin


def _best(words: list[Word], here: int, plain: zstandard.ZstdCompressor) -> Match | None:
    """The template that explains most words at ``here``, of all that compress the words around it."""
    present = {w for w, _, _ in words}
    ranked = []
    for template in templates():
        if not template.required <= present:
            continue
        reach = len(template.words) + template.most_different
        begin = max(0, here - reach)
        near = [w for w, _, _ in words[begin : here + reach + 1]]
        body = " ".join(near).encode()
        saved = len(plain.compress(body)) - len(template.compressor.compress(body))
        if saved > 0:
            ranked.append((saved, template, begin, near))
    ranked.sort(key=lambda r: (-r[0], r[1].license, len(r[1].words)))
    best, best_rank = None, (0, 0)
    for saved, template, begin, near in ranked:
        different, lo, hi = closest(template.words, near, here - begin)
        if different > template.most_different:
            continue
        # Without words that are there only to reach the hint.
        different, first, last = closest(template.words, near[lo:hi])
        first, last = lo + first, lo + last
        if not first <= here - begin < last or not template.required <= set(near[first:last]):
            continue
        rank = (len(template.words) + last - first - different) // 2, -different
        if rank > best_rank or best is None:
            best, best_rank = Match(template.license, words[begin + first][1], words[begin + last - 1][2], saved, different), rank
    return best


def scan(text: str | None) -> list[Match]:
    """Notices in a text, in order and without overlap; characters from ``start`` to ``end``."""
    text = text or ""
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    reach = max(len(t.words) + t.most_different for t in templates())
    found: list[Match] = []
    done = 0
    for hint in _HINT.finditer(text):
        if hint.start() < done:
            continue
        words, here = _around(text, hint.start(), done, reach, reach)
        best = _best(words, here, plain) if words else None
        if best:
            found.append(best)
            done = best.end
    return found


_FOUND = T.ArrayType(
    T.StructType([
        T.StructField("license", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("bytes_saved", T.LongType()),
        T.StructField("words_different", T.LongType()),
    ])
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, license, start, end, notice, bytes_saved, words_different``, one row per notice.

    Texts without a hint stay in the JVM; the others are scanned whole in their
    partitions, without a shuffle. ``start`` and ``end`` count characters, ``notice`` is
    the text between. Missing and empty texts have no notices; repeated rows are
    reported as often as they occur; other columns are ignored.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("found", _FOUND)])
    kind = pa.list_(
        pa.struct([
            ("license", pa.string()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("bytes_saved", pa.int64()),
            ("words_different", pa.int64()),
        ])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([[m._asdict() for m in scan(text.as_py())] for text in batch.column("text")], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), found], ["doc_id", "text", "found"])

    hinted = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike("(?i)" + _HINT.pattern))
    each = in_small_batches(hinted).mapInArrow(run, schema).select("doc_id", "text", F.explode("found").alias("m"))
    return each.select(
        "doc_id",
        "m.license",
        "m.start",
        "m.end",
        F.substring("text", F.col("m.start").cast("int") + 1, (F.col("m.end") - F.col("m.start")).cast("int")).alias("notice"),
        "m.bytes_saved",
        "m.words_different",
    )
