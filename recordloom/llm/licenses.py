"""License scans by conditional compression.

Blocks of a document that hold a cue (a line, or a paragraph of several lines, as notices are wrapped) are compressed as
they are and with every template as zstandard raw dictionary, and the saved bytes rank the templates. In this order all of them, with
no cut, are confirmed by exact wording wherever their telling words stand: the template's words are aligned with the block's
so that the fewest differ, and the words that differ are reported; a template holds where few differ and none of
them is a number or a name that tells licenses apart. The stretch that an alignment covers, and not the whole
block, is compressed in the same way, for the saved bytes of the finding. A finding has its template's rank in its block (0: a tag). Tags (SPDX-License-Identifier) are read by their own pattern, each identifier of an
expression by itself. Templates are notices and headers of one paragraph: full license texts are found by their
telling paragraph. "Licence" counts as "license".

Defined cases: a null or empty text has no findings; equal blocks give equal findings wherever they
stand; of stretches within one another, the one with fewer differing words is kept, then the longer template,
then the one with more saved bytes, then the smaller id; start and end of a finding are the characters of its stretch;
repeated rows and null ids are kept; other columns are passed on unless their names clash.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import pieces

# Short notices of public licenses, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "AGPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2",
    "GPL-2.0-only-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-2.0-or-later-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-or-later-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Parts of words without which a line is no candidate; each template holds one. Between their words any white space and marks may stand.
CUES = ("licens", "copyright", "rights reserved", "permission", "public domain", "redistribution", "spdx")
#: Words that no confirmed block may lack, add or change against its template; numbers count among them.
TELLING = frozenset("affero apache boost bsd by by-nc by-nc-nd by-nc-sa by-nd by-sa cc cc0 clause domain eclipse endorse eupl free general gnu hereby lesser mit mozilla public redistribution reserved rights unencumbered".split())
#: Largest share of the template's words that may differ.
TOLERANCE = 0.2
#: Blocks whose findings are kept for the next equal one, and the most characters of such a block.
CACHE_BLOCKS, CACHE_CHARS = 50_000, 4096
_WORD = re.compile(r"[^\s(){}\[\]\"'“”;:,<>]+")
_EDGE = ".!?*#/"
_CUE = re.compile("|".join(r"[\s(){}\[\]\"'“”;:,<>.!?*#/]+".join(map(re.escape, c.split())) for c in CUES))
#: A tag names licenses by their identifiers, several of them in an expression.
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([a-z0-9.+\-]+(?:[ \t]*[()]*[ \t]*(?:or|and|with)[ \t]+[()]*[ \t]*[a-z0-9.+\-]+)*)")
_TAG_ID = re.compile(r"[a-z0-9][a-z0-9.+\-]*")
_TAG_WORDS = "SPDX-License-Identifier: "
_FIRST = frozenset(c.split()[0] for c in CUES)


def words(text: str) -> list[str]:
    return [w for w, _, _ in _placed(_lower(text))]


def _placed(low: str) -> list[tuple[str, int, int]]:
    """Words of a text in lower case with their character ranges; a full stop at the end belongs to the range."""
    out = []
    for m in _WORD.finditer(low):
        if w := m[0].strip(_EDGE):
            out.append((w, m.start() + len(m[0]) - len(m[0].lstrip(_EDGE)), m.end()))
    return out


def _lower(text: str) -> str:
    """Lower case in as many characters; "licence" is spelled "license"."""
    low = text.lower()
    low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("licenc", "licens")


def _tells(word: str) -> bool:
    return word in TELLING or any(c.isdigit() for c in word)


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Candidate blocks as character ranges: each line with a cue, and each paragraph of several lines with a cue.

    A cue over a line's end makes no line a block, but its paragraph; no notice goes over an empty line.
    """
    low = _lower(text)
    if not any(w in low for w in _FIRST):
        return
    lines, paragraphs, line, paragraph = set(), set(), (0, -1), (0, -1)
    for cue in _CUE.finditer(low):
        if "\n" not in cue[0]:
            if cue.end() > line[1]:
                line = _around(text, "\n", *cue.span())
            lines.add(line)
        if cue.end() > paragraph[1]:
            paragraph = _around(text, "\n\n", *cue.span())
        if paragraph != line:
            paragraphs.add(paragraph)
    yield from sorted(lines)
    yield from sorted(paragraphs)


def _around(text: str, edge: str, start: int, end: int) -> tuple[int, int]:
    """The range between the edges around start and end."""
    first, last = text.rfind(edge, 0, start), text.find(edge, end)
    return first + len(edge) if first >= 0 else 0, last if last >= 0 else len(text)


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.words = {k: words(t) for k, t in templates.items()}
        self.needed = {k: frozenset(filter(_tells, w)) for k, w in self.words.items()}
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.primed = {k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for k, t in templates.items()}
        self.tag = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(_TAG_WORDS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        self.seen: OrderedDict[str, list[tuple]] = OrderedDict()

    def saved(self, block: str, names: Iterable[str] | None = None) -> dict[str, int]:
        """Bytes that each template saves as dictionary."""
        data = block.encode()
        alone = len(self.plain.compress(data))
        return {k: alone - len(self.primed[k].compress(data)) for k in names or self.primed}

    def ranked(self, block: str) -> list[str]:
        """All templates, by the bytes that they save as dictionary of the block; none is cut off."""
        saved = self.saved(block)
        return sorted(saved, key=lambda k: (-saved[k], k))

    def stretches(self, name: str, have: list[str]) -> Iterator[tuple[int, int, list[str], list[str]]]:
        """Stretches of words that the template is confirmed in, none over another: first word, end, missing and extra words.

        All telling words must stand in a stretch, so only the surroundings of the rarest one are aligned.
        """
        want, needed = self.words[name], self.needed[name]
        if not want:
            return
        reach = len(want) + int(TOLERANCE * len(want))
        spans = [(0, len(have))]
        if needed:
            at: dict[str, list[int]] = {w: [] for w in needed}
            for i, w in enumerate(have):
                if w in at:
                    at[w].append(i)
            spans = []
            for i in min(at.values(), key=len):
                lo, hi = max(0, i - reach + 1), min(len(have), i + reach)
                if spans and lo <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], hi)
                else:
                    spans.append((lo, hi))
        while spans:
            lo, hi = spans.pop()
            if hi - lo >= len(want) - int(TOLERANCE * len(want)) and needed <= set(have[lo:hi]):
                ends, taken = _alignments(want, have[lo:hi]), []
                for _, _, a, b, missing, extra in ends:
                    if all(b <= x or y <= a for x, y in taken):
                        taken.append((a, b))
                        yield lo + a, lo + b, missing, extra
                # an end between the taken ones may have a stretch of its own there
                edges = [0, *(x for ab in sorted(taken) for x in ab), hi - lo]
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    if taken and any(a < end <= b for _, end, *_ in ends):
                        spans.append((lo + a, lo + b))

    def scan_block(self, block: str) -> list[tuple]:
        """Confirmed (name, start, end, saved bytes, missing words, extra words, rank) by place; of nested stretches only the best."""
        if block in self.seen:
            self.seen.move_to_end(block)
            return self.seen[block]
        low = _lower(block)
        names = [(rank, k) for rank, k in enumerate(self.ranked(block), 1) if all(w in low for w in self.needed[k])]
        placed = _placed(low) if names else []
        have, found = [w for w, _, _ in placed], []
        for rank, k in names:
            for a, b, missing, extra in self.stretches(k, have):
                start, end = placed[a][1], placed[b - 1][2]
                found.append((k, start, end, self.saved(block[start:end], [k])[k], missing, extra, rank))
        for tag in _TAG.finditer(low):
            data = block[tag.start() : tag.end()].encode()
            less = len(self.plain.compress(data)) - len(self.tag.compress(data))
            for m in _TAG_ID.finditer(low, *tag.span(1)):
                if m[0] not in ("or", "and", "with"):
                    found.append((_TAG_WORDS + block[m.start() : m.end()], m.start(), m.end(), less, [], [], 0))
        found.sort(key=lambda x: (len(x[4]) + len(x[5]), -len(self.words.get(x[0], "..")), -x[3], x[0], x[1]))
        kept: list[tuple] = []
        for x in found:  # a wording within a kept one says nothing more
            if not any(y[1] <= x[1] and x[2] <= y[2] for y in kept):
                kept.append(x)
        kept.sort(key=lambda x: (x[1], -x[2], x[0]))
        if len(block) <= CACHE_CHARS:
            self.seen[block] = kept
        if len(self.seen) > CACHE_BLOCKS:
            self.seen.popitem(last=False)
        return kept

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """Number of candidate blocks, and findings; a license as often as it stands, by place."""
        ranges, found, done = list(blocks(text or "")), [], -1
        for start, end in sorted(ranges, key=lambda r: (r[0], -r[1])):
            if end <= done:  # a line of a scanned paragraph
                continue
            done = end
            for name, a, b, saved, missing, extra, rank in self.scan_block(text[start:end]):
                found.append({"license": name, "start": start + a, "end": start + b, "saved": saved, "missing": missing, "extra": extra, "rank": rank})
        return len(ranges), found


def _alignments(want: list[str], have: list[str]) -> list[tuple[int, int, int, int, list[str], list[str]]]:
    """For each end in have with few enough differing words, the best alignment: cost, end, first word, end of the last
    common word, missing and extra words; cheapest first, then leftmost. Words that tell are never missing or extra."""
    most, never = int(TOLERANCE * len(want)), len(want) + 1
    extra_cost = [never if _tells(w) else 1 for w in have]
    rows = [[0] * (len(have) + 1)]
    for i, w in enumerate(want):
        above, missing_cost = rows[-1], never if _tells(w) else 1
        row = [above[0] + missing_cost]
        for j, h in enumerate(have):
            best = above[j + 1] + missing_cost
            if h == w and above[j] <= best:
                best = above[j]
            if i + 1 < len(want) and row[j] + extra_cost[j] < best:
                best = row[j] + extra_cost[j]
            row.append(min(best, never))
        rows.append(row)
    out = []
    for end, cost in enumerate(rows[-1]):
        if cost <= most:
            i, j, missing, extra, first, last = len(want), end, [], [], end, 0
            while i:
                if j and have[j - 1] == want[i - 1] and rows[i][j] == rows[i - 1][j - 1]:
                    i, j = i - 1, j - 1
                    first, last = j, last or j + 1
                elif j and i < len(want) and rows[i][j] == rows[i][j - 1] + extra_cost[j - 1]:
                    j -= 1
                    extra.append(have[j])
                else:
                    i -= 1
                    missing.append(want[i])
            out.append((cost, end, first, last, missing[::-1], extra[::-1]))
    return sorted(out, key=lambda x: x[:2])


FINDINGS = "array<struct<license:string,start:int,end:int,saved:int,missing:array<string>,extra:array<string>,rank:int>>"


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Adds n_candidates and findings to docs, in place of the text."""
    keep = [c for c in docs.columns if c not in (text, "n_candidates", "findings")]
    schema = T.StructType([f for f in docs.schema if f.name in keep] + T.StructType.fromDDL(f"n_candidates int, findings {FINDINGS}").fields)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saved", pa.int32()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string())), ("rank", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates or TEMPLATES)
        for batch in (piece for whole in batches for piece in pieces(whole, text)):
            rows = [scanner.scan(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            yield pa.RecordBatch.from_pydict(columns | {"n_candidates": pa.array([n for n, _ in rows], pa.int32()), "findings": pa.array([f for _, f in rows], kind)})

    return docs.select(*keep, text).mapInArrow(run, schema)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License findings in every whole text of documents: number, distinct names, places, saved bytes, and numbers of differing words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = lambda f: F.concat_ws(",", F.transform("findings", f))
    return scan_licenses(docs).select(
        "doc_id",
        "n_candidates",
        F.size("findings").alias("n_found"),
        F.concat_ws(",", F.array_distinct(F.transform("findings", lambda x: x["license"]))).alias("licenses"),
        part(lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))).alias("spans"),
        part(lambda x: x["saved"].cast("string")).alias("saved_bytes"),
        F.coalesce(F.aggregate("findings", F.lit(0), lambda n, x: n + F.size(x["missing"]) + F.size(x["extra"])), F.lit(0)).alias("n_differing"),
        part(lambda x: x["rank"].cast("string")).alias("ranks"),
    )
