"""License scans: Dice coefficient over word bigrams against licence templates.

Words are lower-cased and lose punctuation.  A template of b bigrams can reach a Dice
of t only against passages of t/(2-t)*b to (2-t)/t*b bigrams that hold at least
t/(2-t)*b of its own, so a text's places of template bigrams are counted first: a
template is compared only where a passage of that size holds enough of them.  The templates carry
notices, headers and short texts, with neighbouring members and versions of a family; the
full texts of long licences (GPL, LGPL, AGPL, MPL, Apache, CC) aren't among them.

Scale: one pass over whole texts, no shuffle; templates are a fixed small list.

Edge cases: null and empty texts and texts without words match nothing; a text that
repeats a licence reports its best place; equal scores go to the earlier place; repeated
rows are reported alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import map_frames
from quarrylens.llm.decontaminate import WordHashes, seed_hashes

LEAST_DICE = 0.7
SCHEMA = "doc_id long, license string, dice double, start long, end long"

#: Wordings of licence notices, by SPDX identifier and form.
TEMPLATES = {
    "Apache-2.0:line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0:header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "MIT:line": "Released under the MIT License.",
    "MIT:text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "BSD-3-Clause:text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
        "the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission."
    ),
    "ISC:text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0:header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "MPL-2.0:line": "Licensed under the Mozilla Public License, version 2.0.",
    "MPL-1.1:line": "Licensed under the Mozilla Public License, version 1.1.",
    "MPL-1.1:header": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use "
        "this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ "
        "Software distributed under the License is distributed on an \"AS IS\" basis, WITHOUT WARRANTY OF ANY KIND, either "
        "express or implied. See the License for the specific language governing rights and limitations under the License."
    ),
    "EPL-2.0:header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "EPL-1.0:header": (
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"
    ),
    "Unlicense:text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "0BSD:text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"
    ),
    "Zlib:text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions:"
    ),
    "BSL-1.0:line": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0:line": "Licensed under CC0 1.0.",
    "ISC:line": "Released under the ISC License.",
    "BSD-2-Clause:line": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause:line": "Released under the BSD 3-Clause License.",
}

BSD_2 = TEMPLATES["BSD-3-Clause:text"].partition(" Neither the name")[0]
BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES |= {"BSD-2-Clause:text": BSD_2, "BSD-2-Clause:full": BSD_2 + BSD_END, "BSD-3-Clause:full": TEMPLATES["BSD-3-Clause:text"] + BSD_END}

#: Families whose members differ in a name and a version: each is carried, and the one
#: without a version, so that the nearest wins and not a neighbour.
GNU = {
    "GPL": ("GNU General Public License", ("", "1.0", "2.0", "3.0")),
    "LGPL": ("GNU Lesser General Public License", ("", "2.1", "3.0")),
    "LGPL-2.0": ("GNU Library General Public License", ("",)),
    "AGPL": ("GNU Affero General Public License", ("", "3.0")),
}
for _id, (_name, _versions) in GNU.items():
    for _v in _versions:
        _key, _number = f"{_id}-{_v}" if _v else _id, _v.removesuffix(".0")
        TEMPLATES[f"{_key}:line"] = f"This work is licensed under the {_name}{', version ' + _number if _v else ''}."
        if _v or _id == "LGPL-2.0":
            TEMPLATES[f"{_key}:header"] = (
                f"This program is free software: you can redistribute it and/or modify it under the terms of the {_name} as "
                f"published by the Free Software Foundation, either version {_number or '2'} of the License, or (at your option) any "
                "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
                f"even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {_name} for more details."
            )
for _id, _name in {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}.items():
    for _v, _ported in (("", ""), ("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _key = "-".join(x for x in ("CC", _id, _v) if x)
        TEMPLATES[f"{_key}:line"] = f"Licensed under CC {_id} {_v}".rstrip() + "."
        TEMPLATES[f"{_key}:name"] = " ".join(f"This work is licensed under a Creative Commons {_name} {_v} {_ported} License.".split())


@dataclass
class Templates:
    """Bigrams of all templates, sorted, and which templates hold each."""

    names: list[str]
    bags: list[Counter]
    bigrams: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, texts: dict[str, str]) -> Templates:
        hashes = WordHashes()
        bags = [Counter(seed_hashes(hashes.of(text)[0], 2).tolist()) for text in texts.values()]
        every = np.array(sorted(set().union(*bags)), dtype=np.uint64)
        return cls(list(texts), bags, every, np.array([[int(x) in bag for bag in bags] for x in every], dtype=bool))

    def best(self, words: np.ndarray, least: float) -> Iterator[tuple[str, float, int, int]]:
        """(name, Dice, first word, last word) of each template found in a text."""
        grams = seed_hashes(words, 2)
        if not len(grams) or not len(self.bigrams):
            return
        at = np.minimum(np.searchsorted(self.bigrams, grams), len(self.bigrams) - 1)
        hit = np.flatnonzero(self.bigrams[at] == grams)
        if not len(hit):
            return
        owners = self.owners[at[hit]]
        held = owners.sum(0)
        for i in np.flatnonzero(held > 0):
            name, bag = self.names[i], self.bags[i]
            size = bag.total()
            need, widest = least / (2 - least) * size, (2 - least) / least * size
            if held[i] < need:
                continue
            own = hit[owners[:, i]]
            within = np.searchsorted(own, own + widest, side="left") - np.arange(len(own))
            found = (0.0, 0, 0)
            for k in np.flatnonzero(within >= need):
                seen: Counter = Counter()
                common = 0
                for e in own[k : k + within[k]]:
                    x = int(grams[e])
                    seen[x] += 1
                    common += seen[x] <= bag[x]
                    dice = 2 * common / (size + int(e - own[k]) + 1)
                    if dice > found[0]:
                        found = (dice, int(own[k]), int(e) + 1)
                if found[0] == 1.0:
                    break
            if found[0] >= least:
                yield name, *found

    def ranked(self, words: np.ndarray, least: float) -> list[tuple[str, float, int, int]]:
        """What ``best`` finds, by shared bigrams less those that differ: at equal sizes the
        higher Dice leads, and a whole text leads the shorter one that it contains."""
        sizes = {name: bag.total() for name, bag in zip(self.names, self.bags, strict=True)}
        return sorted(self.best(words, least), key=lambda x: (-(sizes[x[0]] + x[3] - x[2]) * (1.5 * x[1] - 1), -x[1], x[2], x[0]))


def scan(documents: DataFrame, texts: dict[str, str] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """A row for each document and each licence it states; of a licence's forms, and of
    templates that match at one place, the best one.  Offsets in code points."""
    templates = Templates.of(TEMPLATES if texts is None else texts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in frames:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                words, place = hashes.of(text)
                found = templates.ranked(words, least)
                chosen = []
                for x in found:
                    if all(x[3] < y[2] or y[3] < x[2] for y in chosen):
                        chosen.append(x)
                if chosen:
                    spans = [m.span() for m in re.finditer(r"\S+", text)]
                    rows += [(doc_id, name, dice, spans[place[a]][0], spans[place[b]][1]) for name, dice, a, b in chosen]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return map_frames(documents.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)
