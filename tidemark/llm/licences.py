"""Licence scans by conditional compression.

A block that may hold a licence wording (a stretch around words such as "license" or "permission", over line
ends, with comment marks and margins taken off) is compressed by zstandard alone and with each template as raw dictionary.  The bytes a template saves say how
much of its wording the block repeats, so templates are ranked by their saving.  Those that save at least
``LEAST_SAVING`` bytes are confirmed in that order by the exact word differences between the template and
the stretch of the block closest to it: key words of the licence must stand unchanged, and at most a share
of the template's words may differ.  Of the confirmed ones the fewest differences win, and what the block
holds before and behind that stretch is scanned again.

Defined results: null and empty texts hold nothing; a text without any cue word is never compressed; repeated
rows yield their own rows; an empty table gives an empty table; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licence notices and opening words of licence texts; (licence, key words, wording).
TEMPLATES = (
    ("MIT", "mit license", "Released under the MIT License."),
    ("MIT", "permission is hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "apache license version 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache license version 2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "gnu general public license version 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "either version 3 of the license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gnu general public license version 2", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "gnu lesser general public license", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "gnu affero general public license", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "bsd 3 clause license", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "permission to use copy modify", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "cc by 4", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc by sa 4", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "cc by nc 4", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "creative commons attribution 4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "cc0 1", "Released under CC0 1.0."),
    ("Unlicense", "free and unencumbered", "This is free and unencumbered software released into the public domain."),
)
CUES = ("licens", "licenc", "permission", "redistribut", "released under", "public domain", "copyright")
REACH = 600  # characters of wording on both sides of a cue that belong to its block
PIECES = (24, 240)  # words: twice a short and a long template with their differences
LEAST_SAVING = 8
SHORT_WORDS = 12
SHORT_SHARE, LONG_SHARE = 0.6, 0.2
WORDS = re.compile(r"[^\W_]+")
CUE = re.compile("|".join(cue.replace(" ", r"[\W_]+") for cue in CUES))  # words of a cue may stand on two lines
MARGIN = re.compile(r"\n[ \t]*(?:[#*;%!>|/-]+(?=\s))?")
SCHEMA = "licence string, begin long, stop long, differences int, template_words int, saving int, changed string"


@dataclass(frozen=True)
class Template:
    licence: str
    keys: tuple[str, ...]
    words: tuple[str, ...]
    text: bytes

    @property
    def allowed(self) -> int:
        return int(len(self.words) * (SHORT_SHARE if len(self.words) <= SHORT_WORDS else LONG_SHARE))


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def templates(rows: Sequence[tuple[str, str, str]] = TEMPLATES) -> list[Template]:
    return [Template(name, tuple(words_of(keys)), tuple(words_of(text)), text.lower().encode()) for name, keys, text in rows]


def blocks(text: str, spans: Sequence[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of the words at ``spans`` around cues, merged where they touch.

    A run reaches ``REACH`` characters of wording to both sides: line ends, margins and comment marks do not count.
    """
    low = text.lower()
    if len(low) != len(text):  # a few letters change length; positions must be those of the text
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    starts = [b for b, _ in spans]
    wide = [0, *accumulate(e - b + 1 for b, e in spans)]
    begin = end = None
    for at in (m.start() for m in CUE.finditer(low)):
        own = max(0, bisect_right(starts, at) - 1)
        b, e = bisect_left(wide, wide[own] - REACH), min(len(spans), bisect_left(wide, wide[own] + REACH) + 1)
        if end is not None and b <= end:
            end = max(end, e)
            continue
        if end is not None:
            yield begin, end
        begin, end = b, e
    if end is not None:
        yield begin, end


def wording(block: str) -> str:
    """A block on one line, without the margins and comment marks of its lines."""
    return " ".join(MARGIN.sub(" ", block).split())


@lru_cache(maxsize=2)
def _compressors(rows: tuple):
    options = {"level": 9, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    known = templates(rows)
    alone = zstandard.ZstdCompressor(**options)
    with_each = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(t.text, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for t in known]
    return known, alone, with_each


def savings(block: str, rows: tuple = TEMPLATES) -> list[int]:
    """Bytes that each template as raw dictionary saves in compressing the block."""
    _, alone, with_each = _compressors(rows)
    data = block.lower().encode()
    size = len(alone.compress(data))
    return [size - len(c.compress(data)) for c in with_each]


def differences(template: Sequence[str], words: Sequence[str], keys: Sequence[str] = ()) -> tuple[int, int, int, list[str]]:
    """Fewest word edits of the template against a stretch [begin, end) of ``words``, and what they are.

    An edit of a key word counts as more than all other words of the template.
    """
    m = len(template)
    price = [m + 1 if t in keys else 1 for t in template]
    cost = [[sum(price[:k]) for k in range(m + 1)]]
    for w in words:
        last = cost[-1]
        row = [0]
        for k, t in enumerate(template, 1):
            row.append(min(last[k - 1] + (t != w) * price[k - 1], last[k] + 1, row[k - 1] + price[k - 1]))
        cost.append(row)
    end = min(range(len(cost)), key=lambda j: (cost[j][m], j))
    changed, j, k = [], end, m
    while k:
        here = cost[j][k]
        if j and here == cost[j - 1][k - 1] + (template[k - 1] != words[j - 1]) * price[k - 1]:
            if template[k - 1] != words[j - 1]:
                changed.append(f"{template[k - 1]}>{words[j - 1]}")
            j, k = j - 1, k - 1
        elif here == cost[j][k - 1] + price[k - 1]:
            changed.append(f"-{template[k - 1]}")
            k -= 1
        else:
            changed.append(f"+{words[j - 1]}")
            j -= 1
    return cost[end][m], j, end, changed[::-1]


def _holds(words: Sequence[str], keys: Sequence[str]) -> bool:
    """Whether the key words stand in order, at most three other words between neighbours."""
    at = [i for i, w in enumerate(words) if w == keys[0]]
    for key in keys[1:]:
        at = sorted({j for i in at for j in range(i + 1, min(len(words), i + 5)) if words[j] == key})
    return bool(at)


def _worded(template: Template, words: Sequence[str]):
    edits, begin, end, changed = differences(template.words, words, template.keys)
    if edits > template.allowed:
        return None
    reach = words[max(0, begin - 3) : end + 3]
    return (edits, begin, end, changed) if _holds(reach, template.keys) else None


def scan(text: str | None, rows: tuple = TEMPLATES, least_saving: int = LEAST_SAVING) -> list[tuple]:
    """(licence, begin, stop, differences, template_words, saving, changed) of every stretch that holds one."""
    if not text:
        return []
    low = text.lower()
    if not any(cue.split()[0] in low for cue in CUES) or not CUE.search(low):
        return []
    known, out = _compressors(rows)[0], []
    spans = [m.span() for m in WORDS.finditer(text)]
    words = [text[i:j].lower() for i, j in spans]
    pending = list(blocks(text, spans))
    while pending:
        b, e = pending.pop()
        own = words[b:e]
        if not own or not CUE.search(text[spans[b][0] : spans[e - 1][1]].lower()):
            continue
        possible = [k for k, t in enumerate(known) if _holds(own, t.keys)]
        saved = _best_savings(text, spans[b:e], rows) if possible else []
        best = None
        for k in sorted(possible, key=lambda k: (-saved[k], k)):
            if saved[k] < least_saving:
                break
            if found := _worded(known[k], own):
                key = (found[0] / len(known[k].words), -len(known[k].words), k)
                if best is None or key < best[0]:
                    best = (key, k, found)
        if best:
            _, k, (edits, i, j, changed) = best
            out.append((known[k].licence, spans[b + i][0], spans[b + max(i, j - 1)][1], edits, len(known[k].words), saved[k], " ".join(changed)))
            pending += [(b, b + i), (b + max(j, i + 1), e)]
    return sorted(out, key=lambda hit: hit[1])


def _best_savings(text: str, spans: Sequence[tuple[int, int]], rows: tuple) -> list[int]:
    """The most that each template saves in a piece of a block: pieces as long as short and as long templates, overlapping by half."""
    best = [0] * len(rows)
    for size in PIECES:
        for at in range(0, max(1, len(spans) - size // 2), size // 2):
            piece = spans[at : at + size]
            best = list(map(max, best, savings(wording(text[piece[0][0] : piece[-1][1]]), rows)))
    return best


def find_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: Sequence[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, licence, begin, stop, differences, template_words, saving, changed), a row for each notice found."""
    fixed = tuple(rows)
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    kind = pa.list_(pa.struct([(n, kinds[k]) for n, k in map(str.split, SCHEMA.split(", "))]))

    @F.arrow_udf(f"array<struct<{', '.join(':'.join(part.split()) for part in SCHEMA.split(', '))}>>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, hit)) for hit in scan(t.as_py(), fixed)] for t in texts], kind)

    hits = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), found.asNondeterministic()(F.col(f"`{text}`")).alias("hits"))
    return hits.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
