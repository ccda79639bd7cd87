"""License statements in documents, ranked by conditional compression.

A block that speaks of licenses is compressed alone and with each template as a raw dictionary. The
template that saves most is what the block most resembles; the exact differences in wording then decide
whether it states that license.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: License names, wordings that state them, and the words that tell them from others.
TEMPLATES = [
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information.", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "permission hereby granted sublicense"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero general public 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "bsd 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "redistribution source binary forms endorse promote"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "bsd 2"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistribution source binary forms retain reproduce"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "purpose fee granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution sharealike 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa 4.0"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "creative commons attribution noncommercial sharealike 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", "cc by nc nd 4.0"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "creative commons attribution noncommercial noderivatives 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by nd 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. Dedicated to the public domain under CC0 1.0.", "cc0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    ("proprietary", "Copyright. All rights reserved.", "rights reserved"),
]
#: A declaration by identifier, for each license above and those that have no other wording here.
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}", f"spdx {name}") for name in [*dict.fromkeys(t[0] for t in TEMPLATES if t[0] != "proprietary"), "LGPL-2.1", "EPL-2.0", "0BSD"]]
#: Lines that are a license's title and nothing else.
TITLES = {"mit license": "MIT", "apache license version 2.0": "Apache-2.0", "isc license": "ISC", "bsd 2 clause license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "gnu general public license version 3": "GPL-3.0", "gnu general public license version 2": "GPL-2.0", "mozilla public license version 2.0": "MPL-2.0", "the unlicense": "Unlicense"}
#: Words that mark a sentence as speaking of licenses, and those that set one license apart from another.
HINTS = ["licen", "copyright", "permission", "redistribut", "rights reserved", "public domain", "spdx", "creative commons", "cc by", "cc0"]
TELLING = {"mit", "apache", "gnu", "lesser", "affero", "bsd", "mozilla", "nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "cc0", "isc", "endorse", "2", "3", "2.0", "3.0", "4.0", "1.0", "1.1", "2.1"}
#: A winner is confirmed if this share of its words stands in the block in their order, all words that
#: mark it are there, and no word that marks another license is.
COVER = 0.6
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Sentences end at a full stop or the like, or at a blank line; a line that is wrapped goes on.
_SENTENCE = re.compile(r"(?<=[.!?:;])(?<!Identifier:)(?<! v\.)\s+|\n\s*\n|\n(?=SPDX)")
#: What opens a line of a comment in source code.
_COMMENT = re.compile(r"(?m)^[ \t]*(?:#+|//+|/\*+|\*+/?|;+|--+|%+|<!--|\"\"\")[ \t]?")
#: The number of a clause, which does not end a block.
_CLAUSE = re.compile(r"[(\[]?(?:[0-9]{1,2}|[a-z]|[ivx]+)[.)\]:]*|[-*\u2022]", re.I)
#: Identifiers joined by operators: each part is a declaration of its own; what follows WITH is an exception to it.
_EXPRESSION = re.compile(r"SPDX-License-Identifier:\s*([^\n]*?\s(?:OR|AND|WITH)\s[^\n]*)")
#: A sentence that denies a statement states nothing.
_DENIED = re.compile(r"\b(?:not|never|no longer|isn't|aren't|cannot be)\b[^.;]{0,30}\b(?:licen[sc]ed|released|available|distributed|published|covered|dedicated)\b", re.I)
#: Characters before and after a hint that may belong to its statement; longer sentences are cut there.
REACH = 2_000


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def common_words(a: list[str], b: list[str]) -> int:
    """Words of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], left + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@dataclass(frozen=True)
class Verdict:
    license: str | None
    saved: int  # bytes that the best template saves
    missing: tuple[str, ...]  # words of the template that the block lacks
    added: tuple[str, ...]  # words of the block that the template lacks


class Scanner:
    def __init__(self, templates=TEMPLATES, level: int = 3):
        import zstandard

        self.templates = [(name, wording(text), frozenset(wording(mark))) for name, text, mark in templates]
        self.alone = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t, _ in templates]
        self.judge = lru_cache(5_000)(self._judge)

    def _judge(self, block: str) -> Verdict:
        """Winners in the order of what they save; the first whose wording holds is the license."""
        raw = block.encode()
        size = len(self.alone.compress(raw))
        saved = [size - len(c.compress(raw)) for c in self.given]
        words = wording(block)
        have = frozenset(words)
        order = sorted(range(len(saved)), key=lambda i: (-saved[i], i))
        title = TITLES.get(" ".join(words)) or TITLES.get(" ".join(words[1:]) if words[:1] == ["the"] else "")
        if title:  # the wording is the title's, word for word
            return Verdict(title, max(s for s, (name, _, _) in zip(saved, self.templates, strict=True) if name == title), (), ())
        for i in order:
            name, text, marks = self.templates[i]
            if saved[i] <= 0:
                break
            if not marks <= have or (have & TELLING) - set(text) - marks:
                continue
            if common_words(text, words) >= COVER * len(text):
                return Verdict(name, saved[i], tuple(sorted(set(text) - have)), tuple(sorted(have - set(text))))
        best = order[0]
        text = self.templates[best][1]
        return Verdict(None, saved[best], tuple(sorted(set(text) - have)), tuple(sorted(have - set(text))))

    def blocks(self, text: str | None) -> list[list[str]]:
        """Neighbouring sentences that speak of licenses, without comment signs, wrapped lines joined."""
        low = (text or "").lower()
        if not any(h in low for h in HINTS):
            return []
        out: list[list[str]] = [[]]
        for s in _SENTENCE.split(_COMMENT.sub("", text)):
            near = [w for w in self._near(s) if w]
            if near:
                out[-1] += near
            elif out[-1] and s.strip() and not _CLAUSE.fullmatch(s.strip()):
                out.append([])
        return [b for b in out if b]

    def _near(self, sentence: str) -> list[str]:
        """The sentence if it has a hint; of a very long one the parts around its hints."""
        low = sentence.lower()
        if len(low) != len(sentence):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in sentence)
        at = sorted(m.start() for h in HINTS for m in re.finditer(re.escape(h), low))
        if not at or len(sentence) <= 2 * REACH:
            return [" ".join(sentence.split())] if at else []
        spans: list[list[int]] = []
        for k in at:
            if spans and k - REACH <= spans[-1][1] and spans[-1][1] - spans[-1][0] < 4 * REACH:
                spans[-1][1] = k + REACH
            else:
                spans.append([max(0, k - REACH), k + REACH])
        return [" ".join(sentence[x:y].split()) for x, y in spans]

    @staticmethod
    def _parts(sentence: str) -> list[str]:
        """A sentence, or the declarations of the parts of its identifier expression."""
        m = _EXPRESSION.search(sentence)
        if m is None:
            return [sentence]
        names = re.split(r"\s+(?:OR|AND)\s+", re.sub(r"\s+WITH\s+\S+", "", m[1]))
        return [f"SPDX-License-Identifier: {n.strip('() ').split()[0]}" for n in names if n.strip("() ")]

    def verdicts(self, text: str | None) -> list[list[Verdict]]:
        """For each block its statements: that of the block, and those of its sentences that state another license;
        of a block that states none, what its best template saves. Sentences that deny a statement are left out, and the parts of an
        identifier expression are declarations of their own."""
        out = []
        for block in self.blocks(text):
            told = [s for s in block if not _DENIED.search(s)]
            parts = [p for s in told for p in self._parts(s)]
            whole = " ".join(told or block)
            if not told:
                none = self.judge(whole)
                all_ = [Verdict(None, none.saved, none.missing, none.added)]
            else:
                all_ = [*([] if parts != told else [self.judge(whole)]), *(self.judge(s) for s in parts if len(parts) > 1 or parts != told)]
            found = {v.license: v for v in reversed(all_) if v.license}
            out.append(list(found.values())[::-1] or all_[:1])
        return out


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_blocks long, licenses array<string> (distinct, sorted) and findings of each document.

    A finding has the block's license (null if no template is confirmed), the bytes that its best
    template saves, and the words in which the two differ. Whole texts are read; null and empty texts
    have no blocks; repeated rows give repeated rows. A block is neighbouring sentences that speak of licenses;
    it is judged as a whole and by sentence, so it can state several licenses. A sentence that several licenses share states none alone.
    """
    kind = dict(docs.dtypes)[id_col]
    finding = pa.struct([("license", pa.string()), ("saved", pa.int32()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            counts, names, found = [], [], []
            for text in batch.column(text_col).to_pylist():
                blocks = scanner.verdicts(text)
                verdicts = [v for b in blocks for v in b]
                counts.append(len(blocks))
                names.append(sorted({v.license for v in verdicts if v.license}))
                found.append([{"license": v.license, "saved": v.saved, "missing": list(v.missing), "added": list(v.added)} for v in verdicts])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(counts, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(found, pa.list_(finding))], names=[id_col, "n_blocks", "licenses", "findings"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_blocks long, licenses array<string>, findings array<struct<license:string,saved:int,missing:array<string>,added:array<string>>>")
