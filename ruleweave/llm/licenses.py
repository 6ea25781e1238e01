"""License texts by template-markup matching.

A template is license wording with markup: ``[[ ... ]]`` encloses an optional region and
``<<n>>`` a replaceable one of up to ``n`` words (a name, a year, a number); what stands
between regions is mandatory. A template is compiled into an automaton over words: its
states are places in the wording, mandatory words are arcs, an optional region adds an empty
arc around itself, and a replaceable region a row of arcs for any word with an empty arc
from each to its end. A text matches where the automaton accepts, so mandatory wording has
to be there word for word and in full. Whole licenses, whole notices at the head of a file,
licenses that are only named and tags have labels of their own. All templates run side by side; a run starts only at
the words with which some template can begin.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases (fixed values): label and wording.
BASE = {
    "mit": "mit license",
    "apache": "apache license",
    "gpl": "general public license",
}

#: Templates: label and wordings. The wording is that of the licenses. ``<<n>>``
#: stands for names, numbers of clauses and quoted words, as typographic quotes belong to words.
_AS_IS_MIT = (
    "is provided <<2>> without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and [[non infringement]] [[noninfringement]] "
    "in no event shall the authors [[or copyright holders]] be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software "
    "or the use or other dealings in the software"
)
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met <<1>> redistributions of source code must retain the above "
    "copyright notice this list of conditions and the following disclaimer <<1>> redistributions in binary "
    "form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
    "the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = (
    "<<1>> neither the name of <<12>> nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission"
)
_BSD_DISCLAIMER = (
    "this software is provided by <<12>> <<2>> and any express or implied warranties including but not "
    "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<12>> be liable for any direct indirect incidental special exemplary or consequential "
    "damages including but not limited to procurement of substitute goods or services loss of use data or "
    "profits or business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the use of this "
    "software even if advised of the possibility of such damage"
)
_GNU_HEADER = (
    "is free software you can redistribute it and or modify it under the terms of the gnu {name} "
    "public license as published by the free software foundation either version {version} of the license or "
    "at your option any later version <<6>> is distributed in the hope that it will be useful but without any "
    "warranty without even the implied warranty of merchantability or fitness for a particular purpose see "
    "the gnu {name} public license for more details"
)
TEMPLATES: dict[str, tuple[str, ...]] = {
    # Whole licenses.
    "bsd-2-clause": (f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}",),
    "bsd-3-clause": (f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}",),
    "isc": (
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee "
        "is hereby granted provided that the above copyright notice and this permission notice appear in all "
        "copies the software is provided <<2>> and <<6>> disclaims all warranties with regard to this software "
        "including all implied warranties of merchantability and fitness in no event shall <<6>> be liable for "
        "any special direct indirect or consequential damages or any damages whatsoever resulting from loss of "
        "use data or profits whether in an action of contract negligence or other tortious action arising out "
        "of or in connection with the use or performance of this software",
    ),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files [[the <<1>>]] to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice [[including the next "
        "paragraph]] shall be included in all copies or substantial portions of the software the software "
        + _AS_IS_MIT,
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify "
        "publish use compile sell or distribute this software either in source code form or as a compiled "
        "binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize "
        "copyright laws the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain we make this dedication for the benefit of the public at large and to "
        "the detriment of our heirs and successors we intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law "
        "the software " + _AS_IS_MIT,
    ),
    "zlib": (
        "this software is provided <<2>> without any express or implied warranty in no event will the authors "
        "be held liable for any damages arising from the use of this software permission is granted to anyone "
        "to use this software for any purpose including commercial applications and to alter it and "
        "redistribute it freely subject to the following restrictions <<1>> the origin of this software must "
        "not be misrepresented you must not claim that you wrote the original software if you use this software "
        "in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "<<1>> altered source versions must be plainly marked as such and must not be misrepresented as being "
        "the original software <<1>> this notice may not be removed or altered from any source distribution",
    ),
    # Whole notices at the head of a file.
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 [[the <<1>>]] you may not use this file except in "
        "compliance with the license you may obtain a copy of the license at [[http]] [[https]] [[www]] apache org "
        "licenses license 2 0 [[txt]] unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an <<2>> basis without warranties or conditions of any "
        "kind either express or implied see the license for the specific language governing permissions and "
        "limitations under the license",
    ),
    "gpl-2.0-header": (_GNU_HEADER.format(name="general", version="2"),),
    "gpl-3.0-header": (_GNU_HEADER.format(name="general", version="3"),),
    "lgpl-2.1-header": (_GNU_HEADER.format(name="lesser general", version="2 1"),),
    "lgpl-3.0-header": (_GNU_HEADER.format(name="lesser general", version="3"),),
    "mpl-2.0-header": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
        "was not distributed with this file you can obtain one at [[http]] [[https]] [[www]] mozilla org mpl 2 0",
    ),
    # Licenses that are only named.
    "apache-2.0": ("licensed under the apache license version 2 [[0]]",),
    "bsd-notice": tuple(
        f"{how} under [[the terms of]] the bsd [[<<2>> clause]] license"
        for how in ("licensed", "released", "distributed", "available")
    ),
    "cc-by": (
        "licensed under [[a]] [[the]] [[creative commons]] cc by <<1>> 0",
        "creative commons attribution <<1>> 0 [[international]] license",
    ),
    "cc-by-nc": (
        "licensed under [[a]] [[the]] [[creative commons]] cc by nc <<1>> 0",
        "creative commons attribution noncommercial <<1>> 0 [[international]] license",
    ),
    "cc-by-sa": (
        "licensed under [[a]] [[the]] [[creative commons]] cc by sa <<1>> 0",
        "creative commons attribution sharealike <<1>> 0 [[international]] license",
    ),
    "gpl-2.0": ("gnu general public license [[as published by the free software foundation]] [[either]] version 2",),
    "gpl-3.0": ("gnu general public license [[as published by the free software foundation]] [[either]] version 3",),
    "lgpl": ("gnu lesser general public license",),
    "mit-notice": tuple(
        f"{how} under [[the terms of]] the mit license"
        for how in ("licensed", "released", "distributed", "available")
    ),
    "mpl-2.0": ("subject to the terms of the mozilla public license [[v]] [[version]] 2 0",),
    "rights-reserved": ("copyright [[c]] <<6>> all rights reserved",),
    # Machine-readable tags.
    "spdx-apache-2.0": ("spdx license identifier apache 2 0",),
    "spdx-bsd": ("spdx license identifier bsd <<1>> clause",),
    "spdx-gpl-2.0": ("spdx license identifier gpl 2 0 [[only]] [[or later]]",),
    "spdx-gpl-3.0": ("spdx license identifier gpl 3 0 [[only]] [[or later]]",),
    "spdx-isc": ("spdx license identifier isc",),
    "spdx-lgpl": ("spdx license identifier lgpl <<1>> <<1>> [[only]] [[or later]]",),
    "spdx-mit": ("spdx license identifier mit",),
    "spdx-mpl-2.0": ("spdx license identifier mpl 2 0",),
}

#: Own templates are not accepted right after these words ("not released under ...").
NEGATIONS = frozenset((b"never", b"not"))

#: Everything of ASCII but digits and letters separates words; A-Z are lower-cased first.
_SEPARATORS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
_TABLE = bytes.maketrans(
    _SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B))
)
_MARKUP = re.compile(r"(\[\[|\]\]|<<\d+>>)")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, letters and all characters beyond ASCII."""
    return (text or "").encode().translate(_TABLE).split()


class Automata:
    """All templates as one automaton over words."""

    def __init__(self, base: Mapping[str, str] = BASE, templates: Mapping[str, tuple[str, ...]] = TEMPLATES):
        self.arcs: list[dict[bytes, int]] = []
        self.any: list[int] = []  # the state after any one word, or -1
        self.empty: list[list[int]] = []
        self.accepts: dict[int, tuple[str, bool]] = {}
        starts = []
        for label, wording in base.items():
            starts.append(self._compile(wording, (label, True)))
        for label, wordings in templates.items():
            starts += [self._compile(wording, (label, False)) for wording in wordings]
        self.closed = [self._closure(s) for s in range(len(self.arcs))]
        self.begin: dict[bytes, set[int]] = {}
        for start in starts:
            for state in self.closed[start]:
                if self.any[state] >= 0:
                    raise ValueError("a template must begin with mandatory or optional words")
                for word, to in self.arcs[state].items():
                    self.begin.setdefault(word, set()).add(to)
        self.firsts = frozenset(self.begin)

    def _state(self) -> int:
        self.arcs.append({})
        self.any.append(-1)
        self.empty.append([])
        return len(self.arcs) - 1

    def _compile(self, wording: str, accept: tuple[str, bool]) -> int:
        start = at = self._state()
        opened: list[int] = []
        for part in _MARKUP.split(wording):
            if part == "[[":
                opened.append(at)
                inner = self._state()
                self.empty[at].append(inner)
                at = inner
            elif part == "]]":
                after = self._state()
                self.empty[opened.pop()].append(after)
                self.empty[at].append(after)
                at = after
            elif part.startswith("<<"):
                after = self._state()
                self.empty[at].append(after)
                for _ in range(int(part[2:-2])):
                    step = self._state()
                    self.any[at] = step
                    at = step
                    self.empty[at].append(after)
                at = after
            else:
                for word in words_of(part):
                    step = self._state()
                    self.arcs[at][word] = step
                    at = step
        if opened or at == start:
            raise ValueError(f"a template is empty or its markup is not closed: {wording!r}")
        self.accepts[at] = accept
        return start

    def _closure(self, state: int) -> frozenset[int]:
        reached, todo = {state}, [state]
        while todo:
            for after in self.empty[todo.pop()]:
                if after not in reached:
                    reached.add(after)
                    todo.append(after)
        return frozenset(reached)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, str, bool]]:
        """(start, length, label, base) of every place where a template is accepted.

        Per place and wording the longest match counts; own wordings right after a negation do not.
        """
        found: list[tuple[int, int, str, bool]] = []
        if self.firsts.isdisjoint(words):
            return found
        for at, word in enumerate(words):
            if word not in self.firsts:
                continue
            now: set[int] = set()
            for state in self.begin[word]:
                now |= self.closed[state]
            longest: dict[int, int] = {}
            read = at + 1
            while now:
                for state in now:
                    if state in self.accepts:
                        longest[state] = read - at
                if read == len(words):
                    break
                ahead: set[int] = set()
                for state in now:
                    to = self.arcs[state].get(words[read])
                    if to is not None:
                        ahead |= self.closed[to]
                    if self.any[state] >= 0:
                        ahead |= self.closed[self.any[state]]
                now, read = ahead, read + 1
            denied = at > 0 and words[at - 1] in NEGATIONS
            found += [
                (at, n, *self.accepts[state]) for state, n in longest.items()
                if self.accepts[state][1] or not denied
            ]
        return found


def scanned(text: Column, base: Mapping[str, str] = BASE, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> Column:
    """(n_words, matches) of a text column; a match has start, length, label and base."""
    base, templates = dict(base), dict(templates)
    kind = pa.struct([
        ("n_words", pa.int64()),
        ("matches", pa.list_(pa.struct([
            ("start", pa.int64()), ("length", pa.int64()), ("label", pa.string()), ("base", pa.bool_()),
        ]))),
    ])

    @F.arrow_udf("struct<n_words:bigint,matches:array<struct<start:bigint,length:bigint,label:string,base:boolean>>>")
    def scan(texts: pa.Array) -> pa.Array:
        automata, out = Automata(base, templates), []
        names = ("start", "length", "label", "base")
        for value in texts.to_pylist():
            words = words_of(value)
            found = automata.matches(words)
            out.append({"n_words": len(words), "matches": [dict(zip(names, m, strict=True)) for m in found]})
        return pa.array(out, kind)

    return scan(text)


def scan_documents(
    docs: DataFrame,
    text_col: str = "text",
    base: Mapping[str, str] = BASE,
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
) -> DataFrame:
    """Add ``licenses``: the number of words of each text and every match in it.

    Null text counts as empty: no words, no matches. Places may overlap, also those of one
    template. Rows are read one by one and whole, very long texts too, in time proportional to
    their length; repeated rows give equal results, an empty table an empty one, and a column
    named ``licenses`` is replaced.
    """
    return docs.withColumn("licenses", scanned(F.col(text_col), base, templates))
