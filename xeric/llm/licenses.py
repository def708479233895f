"""License scan by conditional compression against templates."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of

#: License identifiers and the notices by which each is granted, from the published licenses.
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU General Public License Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU General Public License Version 2, June 1991",
        "the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU Lesser General Public License Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "All-rights-reserved": ("All rights reserved.",),
}
#: Every notice of ten words or more holds one cue more than words of it may differ; between words there may be line ends.
CUES = (
    r"licen[cs]|\ball\W+rights\W+reserved\b|public\W+domain|unencumbered|permission\W+(is\b|to\W+use)|redistribut|creative\W+commons|waived|\bcc0\b"
    r"|extent\W+possible|neighboring\W+rights|source\W+(and\W+binary|code\W+form)|mozilla|without\W+(modification|restriction|limitation|fee\b)|following\W+conditions"
    r"|free\W+(software|of\W+charge)|general\W+public|later\W+version|any\W+person|obtaining\W+a\W+copy|documentation\W+files|hereby\W+granted|(copyright|permission)\W+notice"
    r"|list\W+of\W+conditions|following\W+disclaimer|binary\W+form|prior\W+written|endorse\W+or\W+promote|names\W+of\W+its\W+contributors|above\W+copyright|copyright\W+holders?"
    r"|substantial\W+portions"
)
#: Words that tell licenses of one family apart.
NAMES = frozenset(("lesser", "affero"))
#: Words of a block; longer runs around cues are cut into blocks that overlap by three times the longest notice.
BLOCK_WORDS = 600
#: Largest share of a notice's words that may differ.
MOST_DIFFERENT = 0.1
LEVEL = 9
each_word = re.compile(r"[\w.+-]*\w").finditer
find_words = re.compile(r"[\w.+-]*\w").findall
#: Words that the longest notice may take.
REACH = max(n + int(MOST_DIFFERENT * n) for texts in NOTICES.values() for n in (len(find_words(t)) for t in texts)) + 3


class Templates:
    """Each license's notices as a raw zstandard dictionary, and their words."""

    def __init__(self, notices: dict[str, tuple[str, ...]] = NOTICES) -> None:
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.by_name = {}
        self.words = {n: sorted(([w.lower() for w in find_words(t)] for t in texts), key=len, reverse=True) for n, texts in notices.items()}
        for n, texts in notices.items():
            raw = zstandard.ZstdCompressionDict("\n".join(texts).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.by_name[n] = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False)
        self.aligned = 0

    def ranked(self, block: str) -> list[tuple[str, int]]:
        """All licenses by how many bytes their dictionary takes off the compressed block."""
        data = " ".join(block.lower().split()).encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        saved = [(n, alone - len(c.compress(data))) for n, c in self.by_name.items()]
        return sorted(saved, key=lambda x: (-x[1], x[0]))

    def confirmed(self, block: str, words: list[str]) -> list[tuple[float, int, int, str, int, int, int]]:
        """Places of notices in the block, license by license from the largest reduction down.

        Each is (share of differences, -words, -saved, license, first word, end, differences). A notice isn't aligned
        where it would overlap a place without differences found before: it would lose to it, or to a longer such place
        that holds it. Only where places without differences are chained may that fail; then what was left is aligned.
        """
        index = positions(words)
        exact = bytearray(len(words))
        hits, left = [], []

        def align(name: str, saved: int, notice: list[str], start: int) -> None:
            self.aligned += 1
            n = len(notice)
            found = _aligned(notice, words[start : start + n + 3])
            if found and found[2] <= MOST_DIFFERENT * n:
                hits.append((found[2] / n, -n, -saved, name, start + found[0], start + found[1], found[2]))

        for name, saved in self.ranked(block):
            for notice in self.words[name]:
                n, most = len(notice), int(MOST_DIFFERENT * len(notice))
                for first in index.get((notice[0],), ()):
                    if words[first : first + n] == notice:
                        hits.append((0.0, -n, -saved, name, first, first + n, 0))
                        exact[first : first + n] = b"\1" * n
                for start in _starts(notice, words, index):
                    # With so few differences the notice takes these words in any case.
                    if any(exact[start + 3 + most : start + n - most]):
                        left.append((name, saved, notice, start))
                    else:
                        align(name, saved, notice, start)
        if left and _chained([(h[4], h[5]) for h in hits if not h[6]]):
            for x in left:
                align(*x)
        return hits


def _chained(spans: list[tuple[int, int]]) -> bool:
    """Whether two spans overlap and neither holds the other."""
    inside: list[int] = []
    for first, last in sorted(spans, key=lambda x: (x[0], -x[1])):
        while inside and inside[-1] <= first:
            inside.pop()
        if inside and last > inside[-1]:
            return True
        inside.append(last)
    return False


def _starts(notice: list[str], words: list[str], index: dict[tuple[str, ...], list[int]]):
    """Words at which the notice may begin with differences in a tenth of its words at most."""
    n = len(notice)
    if n < 10:
        return  # one word in ten is less than a word
    anchors: dict[tuple[str, ...], int] = {}
    for k in range(n - 2):
        anchors.setdefault(tuple(notice[k : k + 3]), k)
    shared = sorted((i, k) for t, k in anchors.items() for i in index.get(t, ()))
    at = [i for i, _ in shared]
    most = int(MOST_DIFFERENT * n)
    last_start = -n
    for s in sorted({max(0, i - k) for i, k in shared}):
        # A word that differs breaks three runs at most.
        if s - last_start < 3 or bisect_left(at, s + n + most) - bisect_left(at, s - most) < n - 2 - 3 * most:
            continue
        last_start = s
        yield s


def _tells(notice: list[str], i: int) -> bool:
    """Whether the word is a name of NAMES, terms of Creative Commons or the version after either."""
    before = notice[i - 1] if i else ""
    return notice[i] in NAMES or notice[i].startswith("attribution") or before in ("version", "v") or before.startswith("attribution")


def _aligned(notice: list[str], part: list[str]) -> tuple[int, int, int] | None:
    """First word, end and differing words of the notice in the part; words before and after it don't count.

    None where a word differs that tells the license from others: a name of NAMES or a version.
    """
    ops = [list(o) for o in difflib.SequenceMatcher(None, notice, part, autojunk=False).get_opcodes()]
    ops = [o for i, o in enumerate(ops) if o[0] != "insert" or 0 < i < len(ops) - 1]
    if not ops:
        return None
    if ops[0][0] == "replace":
        ops[0][3] = max(ops[0][3], ops[0][4] - ops[0][2] + ops[0][1])
    if ops[-1][0] == "replace":
        ops[-1][4] = min(ops[-1][4], ops[-1][3] + ops[-1][2] - ops[-1][1])
    for tag, i1, i2, j1, j2 in ops:
        if tag != "equal" and (any(_tells(notice, i) for i in range(i1, i2)) or not NAMES.isdisjoint(part[j1:j2])):
            return None
    return ops[0][3], ops[-1][4], sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in ops if tag != "equal")


def positions(words: list[str]) -> dict[tuple[str, ...], list[int]]:
    """Where each word, and each run of three words, begins."""
    index: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(words)):
        index.setdefault((words[i],), []).append(i)
        index.setdefault(tuple(words[i : i + 3]), []).append(i)
    return index


def blocks(text: str, cue: re.Pattern) -> list[tuple[int, int]]:
    """Spans of candidate blocks: cues and as many words before and after as a notice takes, joined where they meet."""
    cues = [m.span() for m in cue.finditer(text)]
    if not cues:
        return []
    words = [m.span() for m in each_word(text)]
    begins = [a for a, _ in words]
    runs: list[list[int]] = []
    for a, b in cues:
        first, last = bisect_right(begins, a) - 1, bisect_right(begins, b - 1)
        first, last = max(0, first - REACH), min(len(words), last + REACH)
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(last, runs[-1][1])
        else:
            runs.append([first, last])
    out = []
    for first, last in runs:
        while last - first > BLOCK_WORDS:
            out.append((begins[first], words[first + BLOCK_WORDS - 1][1]))
            first += BLOCK_WORDS - 3 * REACH
        out.append((begins[first], words[last - 1][1]))
    return out


_templates: list[Templates] = []


def scan_text(text: str, templates: Templates, cue: re.Pattern) -> tuple[int, list[tuple[str, int, int, int, int]]]:
    """The number of blocks, and (license, begin, end, differing words, words) for each confirmed license."""
    spans = blocks(text, cue)
    hits = set()
    for a, b in spans:
        block = text[a:b]
        tokens = [(m.group().lower(), m.start(), m.end()) for m in each_word(block)]
        words = [t[0] for t in tokens]
        for share, n, saved, name, first, last, wrong in templates.confirmed(block, words):
            hits.add((share, n, saved, name, a + tokens[first][1], a + tokens[last - 1][2], wrong))
    # Of notices that overlap, the one with the fewest differences counts; of those the longest, then the best compressed.
    taken: list[tuple[int, int]] = []
    found = []
    for _, n, _, name, begin, end, wrong in sorted(hits):
        at = bisect_left(taken, (begin, end))
        if (at < len(taken) and taken[at][0] < end) or (at and taken[at - 1][1] > begin):
            continue
        taken.insert(at, (begin, end))
        found.append((name, begin, end, wrong, -n))
    return len(spans), sorted(found, key=lambda x: (x[1], x[0]))


def _scanned(batches):
    import pyarrow as pa

    if not _templates:
        _templates.append(Templates())
    cue = re.compile(CUES, re.IGNORECASE)
    kind = pa.list_(pa.struct([("license", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("n_different", pa.int64()), ("n_words", pa.int64())]))
    for batch in batches:
        n, found = [], []
        for t in batch.column(1).to_pylist():
            k, hits = scan_text(t, _templates[0], cue)
            n.append(k)
            found.append([dict(zip(("license", "begin", "end", "n_different", "n_words"), h, strict=True)) for h in hits])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind)], names=["id", "n_blocks", "licenses"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_blocks, licenses``: each row's license notices as (license, begin, end, n_different, n_words).

    A cue with the words around it that the longest notice may take makes a candidate block. Every block is compressed alone and with each
    license's notices as a raw zstandard dictionary. From the largest reduction down the notices are compared word by word
    and confirmed at each place where at most a tenth of their words differ, none of them a version or a name that tells
    licenses apart; where the licenses before left nothing to
    win, none is aligned. Of places that overlap the one with the smallest share of differences counts, then the longest,
    then the one of the larger reduction.
    Positions count characters of the text.

    Texts without a cue are told apart by a pattern on the JVM's side and have 0 blocks. Null and empty texts too. Each
    row is scanned by itself, whole, with null and repeated ids passed on. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    kind = dict(rows.dtypes)["id"]
    licenses = "array<struct<license: string, begin: bigint, end: bigint, n_different: bigint, n_words: bigint>>"
    # A text without a cue goes along empty.
    slim = rows.select("id", F.when(F.col("body").rlike(f"(?iu){CUES}"), F.col("body")).otherwise("").alias("body"))
    return slim.mapInArrow(_scanned, f"id {kind}, n_blocks long, licenses {licenses}").withColumnRenamed("id", id_col)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read_table(spark, sf_dir, "documents"))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["begin"], x["end"], x["n_different"]))
    return found.select("doc_id", "n_blocks", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))
