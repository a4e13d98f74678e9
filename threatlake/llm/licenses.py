"""Operator 2, license scans: template markup compiled into token automata.

A template is licence wording with two kinds of markup: ``[[ ... ]]`` is an
optional region, ``{{name:a-b}}`` a replaceable region of a to b words.  It is
compiled into a token automaton; a place in a text is accepted when every
mandatory word stands there exactly, in order.  Scanning looks for the
template's leading mandatory words and runs the automaton only from there.

Words are the runs of digits, letters a-z (after lower-casing A-Z) and
non-ASCII characters.  Base phrases are counted at every place.

Results in edge cases: a null text counts as empty (0 words, no labels, score
0); very long texts are scanned whole, in time proportional to their length;
repeated rows give repeated results; an empty table gives an empty result;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence notices and texts as templates (label, markup).
TEMPLATES = [
    ("apache-notice", "licensed under the apache license [[version {{version:1-2}}]]"),
    ("cc-by-notice", "licensed under [[a]] [[the]] cc by [[nc]] [[sa]] [[nd]] {{version:1-2}}"),
    ("cc-by-notice", "licensed under a creative commons attribution [[noncommercial]] [[sharealike]] [[noderivatives]] {{version:1-2}} [[international]] license"),
    ("gpl-notice", "licensed under the [[terms of the]] gnu [[lesser]] [[affero]] general public license [[version {{version:1-2}}]]"),
    ("gpl-notice", "under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation"),
    ("mit-notice", "released under the [[terms of the]] mit license"),
    ("mit-notice", "licensed under the [[terms of the]] mit license"),
    ("reserved-notice", "copyright [[c]] {{holder:1-8}} all rights reserved"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall {{holders:1-12}} be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and {{holder:1-12}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall {{holder:1-12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution "
        "[[[[3]] neither the name of {{holder:1-12}} nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission]] "
        "this software is provided by {{holders:1-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
        "and fitness for a particular purpose are disclaimed in no event shall {{holders:1-12}} be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
        "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "apache-header",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-header",
        "{{this:1-4}} is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation "
        "either version {{version:1-2}} of the license or at your option any later version {{this:1-4}} is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu [[lesser]] [[affero]] general public license for more details",
    ),
    (
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software "
        "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "[[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "[[3]] this notice may not be removed or altered from any source distribution",
    ),
]

_MARK = re.compile(r"\[\[|\]\]|\{\{\w+:\d+-\d+\}\}|[^\s\[\]{}]+")

#: Bytes of a UTF-8 text to words parted by blanks: A-Z lower-cased, other ASCII separators blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def markup(template: str) -> list:
    """The template as nested parts: a word, (low, high) of a replaceable region, or a list for an optional one."""
    stack: list[list] = [[]]
    for mark in _MARK.findall(template):
        if mark == "[[":
            stack.append([])
        elif mark == "]]":
            part = stack.pop()
            stack[-1].append(part)
        elif mark.startswith("{{"):
            low, high = mark[2:-2].split(":")[1].split("-")
            stack[-1].append((int(low), int(high)))
        else:
            stack[-1].append(mark)
    if len(stack) != 1:
        raise ValueError("an optional region is not closed")
    return stack[0]


class Automaton:
    """Token automaton of one template: states in a row, jumps past optional regions."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.words: list[str | None] = []
        self.jumps: dict[int, list[int]] = {}
        self._add(markup(template))
        # the run is tried where the first mandatory words stand, less the replaceable words before them
        first = next((k for k, w in enumerate(self.words) if w is not None and k not in self.jumps), None)
        if first is None or any(w is not None for w in self.words[:first]):
            raise ValueError("a template starts with mandatory wording or a replaceable region")
        lead = []
        for k in range(first, len(self.words)):
            if self.words[k] is None or k in self.jumps:
                break
            lead.append(self.words[k])
        self.lead, self.before = (" " + " ".join(lead) + " ").encode(), first

    def _add(self, parts: list) -> None:
        for part in parts:
            start = len(self.words)
            if isinstance(part, list):
                self._add(part)
                self.jumps.setdefault(start, []).append(len(self.words))
            elif isinstance(part, tuple):
                for k in range(part[1]):
                    at = len(self.words)
                    self.words.append(None)
                    if k >= part[0]:
                        self.jumps.setdefault(at, []).append(start + part[1])
            else:
                self.words.append(part)

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.jumps.get(todo.pop(), ()):
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return seen

    def run(self, words: list[bytes], start: int) -> int:
        """The end of the longest accepted run of words from ``start``; -1 if none is accepted."""
        end, states, at = -1, self._closed({0}), start
        while states:
            if len(self.words) in states:
                end = at
            if at == len(words):
                break
            word = words[at].decode()
            states = self._closed({s + 1 for s in states if s < len(self.words) and self.words[s] in (None, word)})
            at += 1
        return end


def places(stream: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which ``phrase`` stands in a blank-parted ``stream``."""
    found, at, seen, words = [], stream.find(phrase), 0, 0
    while at >= 0:
        words += stream.count(b" ", seen, at)
        seen = at
        found.append(words)
        at = stream.find(phrase, at + 1)
    return found


def scan_text(text: bytes | None, automata: list[Automaton], base: dict[bytes, str]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of one text.

    ``spans`` lists (label, first word, end) of the accepted templates.
    """
    words = (text or b"").translate(_FOLD).split()
    stream = b" " + b" ".join(words) + b" "
    base_found, labels = [], set()
    for phrase, label in base.items():
        at = places(stream, phrase)
        if at:
            base_found += at
            labels.add(label)
    spans = []
    for automaton in automata:
        starts = {max(0, at - back) for at in places(stream, automaton.lead) for back in range(automaton.before + 1)}
        for at in sorted(starts):
            end = automaton.run(words, at)
            if end >= 0:
                spans.append((automaton.label, at, end))
    named = labels | {s[0] for s in spans}
    return (
        len(words),
        len(base_found),
        min(base_found, default=None),
        max(base_found, default=None),
        ",".join(sorted(labels)),
        ",".join(sorted(named)),
        1.0 if spans else 0.5 if labels else 0.0,
        spans,
    )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: long, end_word: long>>"
)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: base counts, labels, score and the accepted templates' spans.

    The score is 1 if a template is accepted, 0.5 if only base phrases stand in the text, else 0.
    """
    listed = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton(*t) for t in listed]
        base = {f" {phrase} ".encode(): label for phrase, label in BASE.items()}
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
        for batch in batches:
            rows = [scan_text(t.as_py(), automata, base) for t in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            spans = pa.array([[{"label": a, "first_word": b, "end_word": c} for a, b, c in r[7]] for r in rows], span)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, spans], names=["doc_id", *names, "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(scan, SCHEMA)
