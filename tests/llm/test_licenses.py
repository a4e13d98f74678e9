import random
import re

from threatlake.llm.licenses import BASE, TEMPLATES, Automaton, markup, scan_licenses
from threatlake.llm.licenses_queries import as_regex


# Public licence texts as they are published.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details."""


def test_published_texts_are_accepted_and_altered_ones_are_not(spark):
    texts = {"mit-text": MIT, "bsd-text": BSD, "isc-text": ISC, "gpl-header": GPL}
    altered = {"mit-text": MIT.replace("ANY CLAIM", "SOME CLAIM"), "bsd-text": BSD.replace("STRICT LIABILITY", "LIABILITY"), "isc-text": ISC.replace("without fee", "without a fee"), "gpl-header": GPL.replace("hope", "belief")}
    rows = spark.createDataFrame([(k, f"some words before {t} and after") for k, t in enumerate([*texts.values(), *altered.values()])], "doc_id long, text string")
    found = {r.doc_id: {s.label for s in r.spans} for r in scan_licenses(rows).collect()}
    for k, label in enumerate(texts):
        assert label in found[k] and label not in found[k + 4]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at = [(i, label) for phrase, label in BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    labels = sorted({x for _, x in at})
    stream = " " + " ".join(words) + " "
    own = {label for label, t in TEMPLATES if re.search(" " + as_regex(markup(t)), stream)}
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(labels), ",".join(sorted({*labels, *own}))


def test_against_regular_expressions(spark):
    rng = random.Random(5)
    pieces = ["Licensed under the Apache License, Version 2.0.", "released UNDER the terms of the MIT license", "CC BY-NC 4.0", "all rights reserved", "Copyright (c) 2020 A. B. Éclair all rights reserved", "licensed under a CC BY 4.0", "cc by cc by",
              "under the GNU General Public License, version 3", "licensed under the GNU Lesser General Public License", "plain words", "ÉTÉ ² x_y", MIT, MIT.replace("KIND", "sort"), BSD, BSD.replace("3. Neither", "Neither"), ISC, GPL, GPL.replace("This program", "The tool")]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(6))) for _ in range(120)] + [None, "", "cc by " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_licenses(rows).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute(texts[r.doc_id])
        assert r.score == (1.0 if r.labels != r.base_labels else 0.5 if r.base_labels else 0.0)


def test_mandatory_words_must_match_exactly():
    a = Automaton("x", "use of {{what:1-2}} is [[hereby]] granted")
    run = lambda t: a.run([w.encode() for w in t.split()], 0)
    assert run("use of this is granted") == 5
    assert run("use of this software is hereby granted now") == 7
    assert run("use of this software tool is granted") == -1
    assert run("use of this is gladly granted") == -1


def test_odd_rows(corpus, nothing):
    assert scan_licenses(corpus).count() == corpus.count()
    assert scan_licenses(nothing).count() == 0
