"""License scans by conditional compression.

A candidate block is the text around a hint, with white space and signs between a hint's words folded; its size in words
follows each template's, with slack for inserted ones (a quarter of the template's words and two more). Every block's
words are compressed alone and with every template as zstandard raw dictionary, and all blocks of a text are ranked by the bytes
that the template saves. In that order, and without a cap, a winner is confirmed by exact wording: which of the
template's words miss, in order, how many others stand between them, and whether every number in it stands there.
Templates that save nearly as much (`CLOSE`) on the same hint are told apart by the differences of their wording. A
confirmed notice takes its stretch of the text, and hints inside it are done with.

Null and empty texts have no notice. Rows with a null doc_id are scanned too. Repeated rows are reported once each; an
empty table gives no rows. A text of any length is scanned whole; only the blocks around hints are compressed, and the
work grows with the number of hints. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from cadenza.llm.shared import Taken, returns_memory, slices
from cadenza.llm.wording import lcs_length

#: Well-known notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "reserved": "All rights reserved.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0-text": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
}
#: One of these stands in every template (lower case).
HINTS = (
    "license", "licence", "permission is hereby granted", "permission to use", "permission is granted", "free software", "redistribution and use", "rights reserved", "public domain", "software is provided",
)
_WORD = re.compile(r"[\w.]*\w")
#: The share of the bytes saved within which templates count as equally good until their wording is compared.
CLOSE = 0.1
_SCHEMA = "doc_id long, license string, start long, end long, reduction double, missing_words int, inserted_words int, exact boolean"


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _folded(words: list[str]) -> bytes:
    """Words one space apart: how a notice is wrapped or commented does not change what it compresses to."""
    return " ".join(words).encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class Known:
    """A template, its words, its compressor, where hints stand in it (characters; first and last word), and what follows its last word."""

    name: str
    text: str
    words: list[str]
    zipped: zstandard.ZstdCompressor
    leads: list[int]
    first: int
    last: int
    tail: str


class Scanner:
    def __init__(self, templates: dict[str, str], hints: tuple[str, ...], most_missing: float):
        self.most = most_missing
        self.hint = re.compile("|".join(r"[\W_]+".join(map(re.escape, h.split())) for h in hints))
        self.alone = zstandard.ZstdCompressor(level=3)
        self.known: list[Known] = []
        for name, text in templates.items():
            own = zstandard.ZstdCompressionDict(_folded(_words(text)) + b"\n" + _folded(_words(text)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            spots = [m.span() for m in _WORD.finditer(text)]
            leads = [m.start() for m in self.hint.finditer(text.lower())]
            places = [bisect_right([a for a, _ in spots], at) - 1 for at in leads] or [0]
            self.known.append(Known(name, text, _words(text), zstandard.ZstdCompressor(level=3, dict_data=own), leads, min(places), max(places), text[spots[-1][1] :]))

    def confirmed(self, words: list[str], here: list[str]) -> tuple[int, int, int] | None:
        """(first, end, missing) of the tightest stretch of `here` with most of the words in order, if they suffice."""
        least = len(words) - self.most * len(words)
        if sum((Counter(words) & Counter(here)).values()) < least:
            return None
        most = lcs_length(words, here)
        if most < least:
            return None
        low, high = most, len(here)
        while low < high:  # the shortest beginning with as many
            middle = (low + high) // 2
            low, high = (low, middle) if lcs_length(words, here[:middle]) == most else (middle + 1, high)
        end, low, high = low, 0, low - most
        while low < high:  # its shortest end with as many
            middle = (low + high + 1) // 2
            low, high = (middle, high) if lcs_length(words, here[middle:end]) == most else (low, middle - 1)
        known, span = set(words), here[low:end]

        def stands(number: str) -> bool:
            for at in (k for k, w in enumerate(span) if w == number):
                while at and span[at - 1] not in known and not any(c.isdigit() for c in span[at - 1]):
                    at -= 1
                if not at or span[at - 1] in known:
                    return True  # no other number stands in its place
            return False

        return (low, end, len(words) - most) if all(stands(w) for w in words if any(c.isdigit() for c in w)) else None

    def __call__(self, text: str) -> list[tuple]:
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer; positions must stay
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits = [m.start() for m in self.hint.finditer(low)]
        if not hits:
            return []
        spots = [m.span() for m in _WORD.finditer(low)]
        begins = [a for a, _ in spots]
        said = [low[a:b] for a, b in spots]
        ranked, plain = [], {}
        for hit in hits:
            at = bisect_right(begins, hit) - 1
            for k, known in enumerate(self.known):
                slack = 2 + len(known.words) // 4
                a, b = max(0, at - known.last - slack), min(len(said), at - known.first + len(known.words) + slack)
                block = _folded(said[a:b])
                if (a, b) not in plain:
                    plain[a, b] = len(self.alone.compress(block))
                ranked.append((plain[a, b] - len(known.zipped.compress(block)), hit, k, a, b))
        ranked.sort(key=lambda r: (-r[0], r[1], self.known[r[2]].name))
        by_hit: dict[int, list[tuple]] = {}
        for r in ranked:
            by_hit.setdefault(r[1], []).append(r)

        @cache
        def reading(hit: int, k: int, a: int, b: int) -> tuple | None:
            """(start, end, missing, inserted, exact) of the template's wording in the block, if it is confirmed."""
            known = self.known[k]
            for lead in known.leads:
                if hit >= lead and text.startswith(known.text, hit - lead):
                    return hit - lead, hit - lead + len(known.text), 0, 0, True
            got = self.confirmed(known.words, said[a:b])
            if got is None:
                return None
            start, end = begins[a + got[0]], spots[a + got[1] - 1][1]
            if text.startswith(known.tail, end):
                end += len(known.tail)
            return start, end, got[2], got[1] - got[0] - len(known.words) + got[2], text[start:end] == known.text

        out, taken = [], Taken([])
        for saved, hit, *where in ranked:
            if taken.covers(hit) or (read := reading(hit, *where)) is None:
                continue
            # templates that shorten the block nearly as much are told apart by their wording
            rivals = [(r, got) for r in by_hit[hit] if saved - CLOSE * saved <= r[0] <= saved and (got := reading(hit, *r[2:])) is not None]
            (_, _, k, _, _), read = min(rivals, key=lambda x: (x[1][2] + x[1][3], -x[0][0], self.known[x[0][2]].name))
            start, end, missing, inserted, exact = read
            if taken.add(start, end):
                block = _folded(said[bisect_left(begins, start) : bisect_left(begins, end)])
                reduction = 1 - len(self.known[k].zipped.compress(block)) / len(self.alone.compress(block))
                out.append((self.known[k].name, start, end, reduction, missing, inserted, exact))
        return sorted(out, key=lambda o: o[1])


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, hints: tuple[str, ...] = HINTS, most_missing: float = 0.15) -> DataFrame:
    """doc_id, license, start, end, reduction, missing_words, inserted_words, exact: one row for each notice found."""

    @returns_memory
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scanner(templates, hints, most_missing)
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "").tolist()
            for a, b in slices(texts):
                rows = [(doc, *found) for doc, text in zip(batch["doc_id"].iloc[a:b], texts[a:b]) for found in scan(text)]
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in _SCHEMA.split(", ")])
                yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, _SCHEMA)
