"""License scans: TF-IDF cosine to templates, then inheritance down the tree.

Passages of a file become sparse TF-IDF vectors; the template with the greatest
cosine of at least ``LEAST``, or ``LEAST_WINDOW`` for windows, names the licence.
Passages are the whole file, each block of lines between blank ones (comment
signs alone are blank), the run of blocks around it, its lines and sentences, and
windows in long lines; each of them only where a cue occurs in it. Inverse document
frequencies are those of the template collection; a term that no template has
weighs as much as the rarest, so foreign words and other versions lower the cosine.
Reserved rights name a file only where nothing else does. A licence of another version
than the passage names is no match; several licences come as one SPDX expression.

A file without a licence of its own takes the one of the licence file in the
nearest directory above it: distinct directories are joined with licensed
directories on each of their ancestor paths, and the deepest one wins.

Null and empty texts have no licence; a null path has no directory. Of licence
files in one directory the best match counts, then the first licence by name; so
do ties between templates. Repeated rows count each for itself, long texts are
scanned whole, other columns are kept by ``scan`` and ``inherit``, and no rows
give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import cut

LEAST, LEAST_WINDOW = 0.55, 0.7
#: Terms in a line; a longer line is looked at in windows, too: from a few terms before a cue, of these lengths.
PASSAGE, BEFORE, LENGTHS = 30, 6, (5, 8, 12, 20, 30)
#: Licensed directories up to which their table is broadcast; it is counted first.
BROADCAST_DIRECTORIES = 100_000
RESERVED = "Proprietary"

# Licences with versions (identifier, name, short names, versions) and without (identifier, names).
VERSIONED = (
    ("Apache-{}", "Apache License", ("Apache",), ("1.0", "1.1", "2.0")),
    ("GPL-{}", "GNU General Public License", ("GPL", "GNU GPL"), ("1.0", "2.0", "3.0")),
    ("LGPL-{}", "GNU Lesser General Public License", ("LGPL", "GNU LGPL"), ("2.1", "3.0")),
    ("AGPL-{}", "GNU Affero General Public License", ("AGPL", "GNU AGPL"), ("3.0",)),
    ("MPL-{}", "Mozilla Public License", ("MPL",), ("1.1", "2.0")),
    ("EPL-{}", "Eclipse Public License", ("EPL",), ("1.0", "2.0")),
    ("EUPL-{}", "European Union Public Licence", ("EUPL",), ("1.1", "1.2")),
    ("CDDL-{}", "Common Development and Distribution License", ("CDDL",), ("1.0", "1.1")),
    ("OFL-{}", "SIL Open Font License", ("OFL",), ("1.1",)),
    ("Artistic-{}", "Artistic License", ("Artistic",), ("1.0", "2.0")),
    ("BSL-{}", "Boost Software License", ("BSL",), ("1.0",)),
    ("PHP-{}", "PHP License", ("PHP",), ("3.0", "3.01")),
    ("PSF-{}", "Python Software Foundation License", ("PSF", "PSFL"), ("2.0",)),
    ("SSPL-{}", "Server Side Public License", ("SSPL",), ("1.0",)),
)
UNVERSIONED = (
    ("MIT", ("MIT License", "MIT")),
    ("BSD-2-Clause", ("2-clause BSD License", "BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause")),
    ("BSD-3-Clause", ("3-clause BSD License", "BSD 3-Clause License", "New BSD License", "BSD License", "BSD-3-Clause")),
    ("ISC", ("ISC License", "ISC")),
    ("Zlib", ("zlib License", "zlib/libpng license")),
    ("Unlicense", ("Unlicense",)),
    ("0BSD", ("Zero-Clause BSD License", "0BSD")),
    ("WTFPL", ("WTFPL", "Do What The Fuck You Want To Public License")),
    ("CC0-1.0", ("CC0 1.0 Universal", "CC0", "Creative Commons Zero v1.0 Universal")),
)
CREATIVE = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
# How licence notices and licence files read.
NOTICES = (
    ("MIT", "Licensed under the MIT license. See LICENSE file in the project root for full license information."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", """MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "You can redistribute it under the terms of the GNU GPL, version 2 only."),
    ("GPL-3.0", "You can redistribute it under the terms of the GNU GPL, version 3 only."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Released under the 3-clause BSD License. Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-2-Clause", """BSD 2-Clause License. Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """BSD 3-Clause License. Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """ISC License. Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    (RESERVED, "All rights reserved."),
    (RESERVED, "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
)
GRANTS = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This program is made available under the terms of")
_CUE = re.compile(
    r"(?i:licen[sc]|copyright|rights reserved|spdx|public domain|permission (?:is hereby|to use)|redistribution and use|creative commons|free software|gplv|-clause|zlib)"
    r"|\b(?:[AL]?GPL|MIT|BSD|ISC|MPL|EPL|EUPL|CDDL|OFL|PSFL?|SSPL|WTFPL|CC[ -]BY|CC0|Apache-|Boost Software)"
)
_BLOCK = re.compile(r"(?:[^\n]*[^\W_][^\n]*(?:\n|\Z))+")
_SENTENCE = re.compile(r"(?<=[.;:!?])\s+(?=[A-Z(])")
_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower().replace("licence", "license"))


def templates() -> Iterator[tuple[str, str]]:
    """(licence, text): the notices, and each licence's names and identifier after each grant."""
    yield from NOTICES
    named: list[tuple[str, list[str], list[str]]] = []
    for pattern, name, short, versions in VERSIONED:
        for v in versions:
            key, forms = pattern.format(v), [v, v.removesuffix(".0")] if v.endswith(".0") else [v]
            names = [f"the {name}, {word} {f}" for f in forms for word in ("version", "v")]
            names += [f"the {name} {lead}{f}" for f in forms for lead in ("", "v")]
            names += [n for s in short for f in forms for n in (f"{s} {f}", f"the {s}, version {f}", f"{s}v{f}", f"{s}-{f}", f"the {s} {f} license")]
            later = [f"{key}-only", f"{key}-or-later"] if "GPL" in key else []
            named.append((key, names, [key, *later]))
    for code, name in CREATIVE:
        for v in ("2.0", "2.5", "3.0", "4.0"):
            kind = "International" if v == "4.0" else "Unported" if v == "3.0" else "Generic"
            names = [f"CC {code} {v}", f"CC-{code}-{v}", f"a Creative Commons {name} {v} {kind} License", f"the Creative Commons {name} {v} License", f"CC {code} {v}. Creative Commons {name} {v} {kind} License"]
            named.append((f"CC-{code}-{v}", names, [f"CC-{code}-{v}"]))
    for key, names in UNVERSIONED:
        named.append((key, [f"the {n}" for n in names], [key]))
    for key, names, identifiers in named:
        for name in names:
            bare = name.removeprefix("the ")
            if len(terms(bare)) > 1:
                yield key, bare
            for grant in GRANTS:
                yield key, f"{grant} {name}."
        for i in identifiers:
            yield key, f"SPDX-License-Identifier: {i}"


_BAGS = [(name, Counter(terms(text))) for name, text in templates()]
_DF = Counter(t for _, bag in _BAGS for t in bag)
_IDF = {t: math.log(1 + len(_BAGS) / n) for t, n in _DF.items()}
_UNKNOWN = max(_IDF.values())


def vector(bag: Counter) -> dict[str, float]:
    """Unit TF-IDF vector of a bag of terms."""
    v = {t: (1 + math.log(n)) * _IDF.get(t, _UNKNOWN) for t, n in bag.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / norm for t, x in v.items()} if norm else {}


_NAMES = [name for name, _ in _BAGS]


def _postings() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each term the templates that have it and its weights in them."""
    found: dict[str, list[tuple[int, float]]] = {}
    for k, (_, bag) in enumerate(_BAGS):
        for t, x in vector(bag).items():
            found.setdefault(t, []).append((k, x))
    return {t: (np.array([k for k, _ in p]), np.array([x for _, x in p])) for t, p in found.items()}


_POSTINGS = _postings()
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)*")
#: A term that ends in a version, or in one and what SPDX puts after it.
_NUMBERED = re.compile(r"(?:[a-z0-9.-]*[a-z]-?)?([0-9]+(?:\.[0-9]+)*)(?:-only|-or-later)?$")
_VERSIONED_KEYS = tuple(pattern.removesuffix("{}") for pattern, *_ in VERSIONED) + tuple(f"CC-{code}-" for code, _ in CREATIVE)
#: Terms after which a number is a version.
_BEFORE_VERSION = {"version", "v", "license"} | {
    w for _, name, short, _ in VERSIONED for n in (name, *short) for w in terms(n)[-1:]
} | {t for code, name in CREATIVE for t in (code.lower(), terms(name)[-1])}


def _short(version: str) -> str:
    return version.removesuffix(".0")


#: The version of each template's licence, '' where it has none.
_VERSION = np.array([next((_short(name[len(p) :]) for p in _VERSIONED_KEYS if name.startswith(p) and _NUMBER.fullmatch(name[len(p) :])), "") for name in _NAMES])


def versions(words: tuple[str, ...]) -> set[str]:
    """Versions that a passage names: numbers after ``version`` or a licence's name, and those joined to a name."""
    out = set()
    for before, word in zip(("", *words), words, strict=False):
        m = _NUMBERED.match(word)
        if m and (not _NUMBER.fullmatch(word) or before in _BEFORE_VERSION):
            out.add(_short(m[1]))
    return out


def passages(text: str) -> Iterator[tuple[list[str], float]]:
    """(terms, least cosine) of the whole text, runs of blocks, blocks, lines and sentences with a cue, and of windows in long lines.

    One term alone says nothing: MIT is a word, too.
    """
    if not _CUE.search(text):
        return
    yield terms(text), LEAST
    run: list[str] = []
    blocks = 0
    for b in _BLOCK.finditer(text):
        if not _CUE.search(text, *b.span()):
            if blocks > 1:
                yield run, LEAST
            run, blocks = [], 0
            continue
        block = terms(b[0])
        run, blocks = run + block if blocks else block, blocks + 1
        yield block, LEAST
        for piece in {*b[0].split("\n"), *_SENTENCE.split(b[0])}:
            if not _CUE.search(piece):
                continue
            words = terms(piece)
            if len(words) < len(block):
                yield words, LEAST
            if len(words) > PASSAGE:
                yield from windows(piece)
    if blocks > 1:
        yield run, LEAST


def windows(line: str) -> Iterator[tuple[list[str], float]]:
    for m in _CUE.finditer(line):
        before = terms(line[max(0, m.start() - 80) : m.start()])[-BEFORE:]
        after = terms(line[m.start() : m.start() + 12 * PASSAGE])[:PASSAGE]
        near = before + after
        for i in range(len(before) + 1):
            for n in LENGTHS:
                yield near[i : i + n], LEAST_WINDOW


def _nearest(words: tuple[str, ...]) -> tuple[tuple[float, str] | None, tuple[float, str] | None]:
    """(cosine, licence) of the best template, apart for those that grant something and reserved rights.

    Where a passage names versions, a licence of another version is no match, however near.
    """
    v = [(*_POSTINGS[t], x) for t, x in vector(Counter(words)).items() if t in _POSTINGS]
    if not v:
        return None, None
    cosine = np.round(np.bincount(np.concatenate([k for k, _, _ in v]), np.concatenate([w * x for _, w, x in v]), len(_NAMES)), 9)
    if named := versions(words):
        cosine[(_VERSION != "") & ~np.isin(_VERSION, list(named))] = 0.0
    out = []
    for group in (_GRANTED, _RESERVED):
        top = cosine[group].max()
        out.append((float(top), min(_NAMES[k] for k in group[cosine[group] == top])))
    return out[0], out[1]


_GRANTED = np.array([k for k, name in enumerate(_NAMES) if name != RESERVED])
_RESERVED = np.array([k for k, name in enumerate(_NAMES) if name == RESERVED])
_nearest_short = lru_cache(1 << 15)(_nearest)


# An SPDX expression of several parts, a choice of two licences in a sentence, and a denial.
_PART = r"\(*[ \t]*[A-Za-z0-9][A-Za-z0-9.+-]*[ \t]*\)*"
_EXPRESSION = re.compile(rf"SPDX-License-Identifier:[ \t]*({_PART}(?:[ \t]*\b(?:AND|OR|WITH)\b[ \t]*{_PART})+)")
_SYMBOL = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_CHOICE = re.compile(
    r"\b(dual[- ])?licen[sc]ed\s+under\s+(?:the\s+terms\s+of\s+)?(either\s+|both\s+)?(?:(?:of\s+)?the\s+|an?\s+)?([^\n;]{2,60}?),?\s+(or|and)\s+(?:the\s+|an?\s+)?([^\n;]{2,60}?)(?:,?\s+at\s+your\s+option)?(?=[,;]|\.(?:\s|\Z)|\s*(?:\n|\Z))",
    re.IGNORECASE,
)
_DENIAL = re.compile(
    r"(?:\b(?:not|never|neither|no\s+longer)\b|n['’]t\b)(?:\s+\w+){0,2}?\s+(?:licen[sc]ed|released|distributed|available|covered|governed)\s+(?:under|by)\b(?:(?!\.\s|\n[ \t]*\n|;|\bbut\b).)*(?:but\b)?",
    re.IGNORECASE | re.DOTALL,
)


@lru_cache(1 << 12)
def _name(text: str) -> tuple[str, float] | None:
    """(licence, cosine) of a licence's bare name or identifier."""
    granted, _ = _nearest(tuple(terms(f"Licensed under the {text}.")))
    tagged, _ = _nearest(tuple(terms(f"SPDX-License-Identifier: {text}")))
    best = max((x for x in (granted, tagged) if x), default=None)
    return (best[1], best[0]) if best and best[0] >= LEAST_WINDOW else None


def _expression(text: str) -> tuple[str, float] | None:
    """An SPDX expression with its parts' names, and the least cosine; None if a part has no name."""
    out, least, exception = [], 1.0, False
    for symbol in _SYMBOL.findall(text):
        if symbol in ("AND", "OR", "WITH", "(", ")") or exception:
            exception = symbol == "WITH"
            out.append(symbol)
            continue
        found = _name(symbol.removesuffix("+"))
        if found is None:
            return None
        out.append(found[0])
        least = min(least, found[1])
    if out.count("(") != out.count(")"):
        out = [x for x in out if x not in "()"]
    return " ".join(out).replace("( ", "(").replace(" )", ")"), least


def _several(text: str) -> tuple[str, float] | None:
    """The first expression of several licences: an SPDX one, or a sentence that offers two."""
    for m in _EXPRESSION.finditer(text):
        if found := _expression(m[1]):
            return found
    for m in _CHOICE.finditer(text):
        one, two = _name(m[3]), _name(m[5])
        if one and two and one[0] != two[0]:
            joint = "AND" if m[4].lower() == "and" and not m[1] and not m[2] else "OR"
            return f"{one[0]} {joint} {two[0]}", min(one[1], two[1])
    return None


# What every cue holds, folded or as it is; looked for first, as a search for literals is faster.
_FOLDED = ("licen", "copyright", "rights reserved", "spdx", "public domain", "permission ", "redistribution and use", "creative commons", "free software", "gplv", "-clause", "zlib")
_EXACT = ("GPL", "MIT", "BSD", "ISC", "MPL", "EPL", "EUPL", "CDDL", "OFL", "PSF", "SSPL", "WTFPL", "CC BY", "CC-BY", "CC0", "Apache-", "Boost Software")


def _cued(text: str) -> bool:
    """Whether a cue occurs in the text."""
    if not any(x in text for x in _EXACT):
        folded = text.casefold()
        if not any(x in folded for x in _FOLDED):
            return False
    return _CUE.search(text) is not None


def classify(text: str | None) -> tuple[str | None, float]:
    """The best licence and its cosine; (None, 0.0) below the threshold.

    Several licences come as one SPDX expression with the least cosine of its parts. An
    SPDX expression of which a part has no template names nothing, and a denial
    (``not licensed under ...``, to the end of its sentence or ``but``) is passed over.
    """
    text = text or ""
    if not _cued(text):
        return None, 0.0
    text = _DENIAL.sub("\n", text)
    if found := _several(text):
        return found[0], round(found[1], 6)
    text = _EXPRESSION.sub("\n", text)
    best: list[tuple[float, str] | None] = [None, None]
    for words, least in passages(text):
        if len(words) < 2:
            continue
        for i, near in enumerate((_nearest_short if len(words) <= PASSAGE else _nearest)(tuple(words))):
            if near and near[0] >= least and (best[i] is None or (-near[0], near[1]) < (-best[i][0], best[i][1])):
                best[i] = near
    found = best[0] or best[1]
    return (found[1], round(found[0], 6)) if found else (None, 0.0)


def scan(files: DataFrame) -> DataFrame:
    """(path, text, others) to (path, others, own_license, own_score)."""
    keep = [c for c in files.columns if c not in ("text", "own_license", "own_score")]
    kinds = dict(files.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                [*keep, "own_license", "own_score"],
            )

    return files.select(*keep, "text").mapInArrow(run, f"{schema}, own_license string, own_score double")


def _directory(path: str):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherit(scanned: DataFrame) -> DataFrame:
    """Add ``license`` and ``inherited_from`` to rows (path, own_license, own_score, is_license_file)."""
    files = scanned.withColumn("_dir", _directory("path"))
    licensed = cut(
        files.where(F.col("is_license_file") & F.col("own_license").isNotNull())
        .groupBy("_dir")
        .agg(F.min_by("own_license", F.struct(-F.col("own_score"), F.col("own_license"))).alias("_license"))
    )
    small = licensed.count() <= BROADCAST_DIRECTORIES
    parts = F.split("_dir", "/")
    above = (
        files.select("_dir").distinct()
        .withColumn("_depth", F.explode(F.sequence(F.size(parts), F.lit(1), F.lit(-1))))
        .withColumn("_above", F.array_join(F.slice(parts, F.lit(1), F.col("_depth")), "/"))
    )
    other = licensed.select(F.col("_dir").alias("_above"), "_license")
    nearest = (
        above.join(F.broadcast(other) if small else other, "_above")
        .groupBy("_dir")
        .agg(F.max_by(F.struct("_license", "_above"), "_depth").alias("_near"))
    )
    return files.join(nearest, "_dir", "left").select(
        *scanned.columns,
        F.coalesce("own_license", "_near._license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("_near._above")).alias("inherited_from"),
    )


def op3_licenses(docs: DataFrame) -> DataFrame:
    """Documents as files source/lang/hundred/doc_id.txt.

    The first document of each source/lang with a licence of its own stands for
    that directory's licence file.
    """
    folder = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")))
    path = F.concat_ws("/", folder, (F.col("doc_id") / 100).cast("long").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = cut(scan(docs.select("doc_id", folder.alias("folder"), path.alias("path"), "text")))
    heads = found.where("own_license is not null").groupBy("folder").agg(F.min("doc_id").alias("head")).withColumnRenamed("folder", "_folder")
    marked = found.join(heads, F.col("folder") == F.col("_folder"), "left").select(
        "doc_id",
        F.when(F.col("doc_id") == F.col("head"), F.concat("folder", F.lit("/LICENSE"))).otherwise(F.col("path")).alias("path"),
        "own_license",
        "own_score",
        F.coalesce(F.col("doc_id") == F.col("head"), F.lit(False)).alias("is_license_file"),
    )
    return inherit(marked)
