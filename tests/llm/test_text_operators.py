"""URL rules, page text, licenses, toxicity and search against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleweave.llm import html_text, licenses, topk_search, toxicity, url_rules


def test_url_rules(spark):
    rnd = random.Random(1)
    labels = ["a", "b", "net", "org", "ex-a", ""]
    hosts = [".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4))) for _ in range(80)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c", "/é", "/a\U0010ffff"]
    urls = [
        (i, rnd.choice(["http://", "", "x://A://"]) + rnd.choice(hosts) + rnd.choice(paths) + rnd.choice(["", "?q", "#/a"]))
        for i in range(300)
    ] + [(None, None), (3, "http://"), (3, "http://"), (4, "")]
    rules = [
        (h, p, v)
        for (h, p), v in {(rnd.choice(hosts), rnd.choice(paths)): rnd.choice(["allow", "block"]) for _ in range(80)}.items()
    ]

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [
            (len(h) + len(p), len(h), h + p, v) for h, p, v in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    pages = spark.createDataFrame(urls, "page_id bigint, url string").withColumn("host", F.lit("x")).repartition(3)
    table = spark.createDataFrame(
        [*rules, (None, "/", "block"), ("", "/", "block"), ("a", None, "allow")], "host string, path string, verdict string"
    )
    found = url_rules.judge_urls(pages, table).select("page_id", "url", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, found), key=str) == sorted(((i, u, *judged(u)) for i, u in urls), key=str)
    assert url_rules.judge_urls(pages.limit(0), table).count() == 0
    assert url_rules.judge_urls(pages, table.limit(0)).where("verdict = 'allow'").count() == len(urls)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("<script>x", ""), ("just text", "just text"),
        ("<nav><a href=x>menu</a></nav><article><h1>T</h1><p>One&amp;two &lt;\n x<br>y</article><footer>f", "T\nOne&two < x\ny"),
        ("<body><div class='ad'>buy</div><article><header>h</header><p>One<p>Two<section class=comments>no</section>"
         "<aside>z</aside><form>f</form></article>", "One\nTwo"),
        ("<div id=x><p>Hello world this is long text</p><ul class='menu'><li>a</ul><table><tr><td>one cell<td>two</table>"
         "</div><div class='cookie-notice'><p>bla</p></div>", "Hello world this is long text\none cell\ntwo"),
        ("<article><p>" + "long " * 50_000 + "</p></article>", "long " * 49_999 + "long"),
        ("<article><p>ß</article>", "ß"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        *((f"<body><div class='{name}'><article><h1>T</h1><p>One two three</article></div><div class=ad>buy</div>", "T\nOne two three")
          for name in ("content with-sidebar", "layout no-sidebar", "page-header-fixed", "has_footer", "sidebar", "page banner")),
        *((f"<div class='{name}'><p>A long text without an article</p></div><div class='cookie-notice'>bla</div>",
           "A long text without an article") for name in ("content with-sidebar", "no-sidebar", "has_footer")),
        ("<div class=widget><p>All there is is named so</p></div><footer>f</footer>", ""),
        ("<nav>m</nav><div class='ad'>buy this now</div>", ""),
        ("<nav>m</nav><div class='cookie-notice'>We use cookies on this page</div>", ""),
        ("<article><p>Text of the page</article><div class='related'><article><p>Teaser of another text</article></div>"
         "<article class='sponsored'><p>Buy a thing of great worth now</article>", "Text of the page"),
        ("<div><p>Text of the page without an article</p></div><div class='related-posts'><article>A teaser</article></div>",
         "Text of the page without an article"),
        *((f"<article><p>Text of the page<div class='{name}'><p>Other words</p></div></article>", "Text of the page")
          for name in ("user-comments", "reader-comments", "discussion", "adsbygoogle", "ad-banner-300x250", "advertorial", "Box_Ad")),
        *((f"<article class='{name}'><p>Text of the page</article>", "Text of the page")
          for name in ("post with-comments", "no-ads", "entry has_related", "story-header", "adapted", "commentary")),
        ("<main><p>Text of the page</p></main><aside><article>a</article></aside><div hidden><main>b</main></div>"
         "<div class='comments'><article>c</article></div><nav class=x><main>d</main></nav>", "Text of the page"),
        ("<article><p>Text of the page<div class='site-footer'>f</div><div class='sidebar-left'>s</div></article>",
         "Text of the page"),
    ],
)
def test_noisy_wrappers(html, text):
    assert html_text.main_text(html) == text


def test_smoothing_keeps_the_level():
    assert np.allclose(html_text.smoothed(np.full(9, 3.0)), 3.0)
    assert html_text.smoothed(np.zeros(0)).size == 0


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "<article>a</article>"), (1, None), (None, "<p>b</p>")], "page_id int, html string")
    found = html_text.extract_pages(pages.withColumn("text", F.lit("old"))).collect()
    assert sorted((r.page_id or 0, r.text) for r in found) == [(0, "b"), (1, ""), (1, "a")]
    assert html_text.extract_pages(pages.limit(0)).collect() == []
    long = pages.limit(1).select(F.concat(F.lit("<article>"), F.repeat(F.lit("<p>word</p>"), 200_000)).alias("html"))
    assert html_text.extract_pages(long).first()["text"] == "\n".join(["word"] * 200_000)


def test_license_templates():
    automata = licenses.Automata(
        {"mit": "mit license"}, {"t": ("one [[two [[three]]]] <<2>> four",), "u": ("[[a]] b",)}
    )

    def labels(text):
        return sorted({(start, n, label) for start, n, label, _ in automata.matches(licenses.words_of(text))})

    assert labels("One, two four") == [(0, 3, "t")]
    assert labels("one two three x y four") == [(0, 6, "t")]
    assert labels("one x y z four") == []
    assert labels("one two three four") == [(0, 4, "t")]
    assert labels("a b MIT-License mit license") == [(0, 2, "u"), (1, 1, "u"), (2, 2, "mit"), (4, 2, "mit")]
    assert labels("") == [] and licenses.words_of(None) == []
    for wrong in ("[[a", "", "<<2>> a"):
        with pytest.raises(ValueError):
            licenses.Automata({}, {"t": (wrong,)})


def test_scan_documents(spark):
    texts = ["Released under the MIT License.", None, "", "GNU General Public License, version 3", "mit licenses", "é" * 9]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("licenses", F.lit(1))
    found = {r.text: r.licenses for r in licenses.scan_documents(docs).collect()}
    for text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        places = sum(
            words[i : i + len(p.split())] == p.split() for p in licenses.BASE.values() for i in range(len(words))
        )
        assert found[text].n_words == len(words)
        assert sum(m.base for m in found[text].matches) == places
    assert {m.label for m in found[texts[3]].matches} == {"gpl", "gpl-3.0"}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED “AS IS”, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """ 3. Neither the name of Example Group, Inc. nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
GPL_HEADER = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details."""
APACHE_HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#     http://www.apache.org/licenses/LICENSE-2.0
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
WHOLE = {
    "mit-text": MIT, "bsd-2-clause": BSD_HEAD + BSD_TAIL, "bsd-3-clause": BSD_HEAD + BSD_NAMES + BSD_TAIL, "isc": ISC,
    "gpl-3.0-header": GPL_HEADER, "apache-2.0-header": APACHE_HEADER, "mpl-2.0-header": MPL_HEADER,
    "gpl-2.0-header": GPL_HEADER.replace("version 3", "version 2"),
    "lgpl-3.0-header": GPL_HEADER.replace("General", "Lesser General"),
    "lgpl-2.1-header": GPL_HEADER.replace("General", "Lesser General").replace("version 3", "version 2.1"),
}


@pytest.mark.parametrize("label", WHOLE)
def test_whole_licenses_whole_or_not_at_all(label):
    automata, text = licenses.Automata(), WHOLE[label]
    words = licenses.words_of(text)

    def whole(words):
        return {found for _, _, found, _ in automata.matches(words) if found in WHOLE}

    assert whole(licenses.words_of("Copyright 2020 Some One\n\n" + text + "\nint main() {}")) == {label}
    assert whole(licenses.words_of(text.replace("\n", "\n// "))) == {label}
    assert whole(words[:-1]) == whole(words[3:]) == set()
    for at in range(0, len(words), 7):  # a word more that no replaceable region takes
        assert label not in whole(words[:at] + [b"perhaps"] * 20 + words[at:]) or at == 0
    assert whole(words[: len(words) // 2] + [b"the", b"rest", b"is", b"forbidden"]) == set()


def test_named_licenses_and_tags():
    automata = licenses.Automata()

    def labels(text):
        return {label for _, _, label, base in automata.matches(licenses.words_of(text)) if not base}

    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software, "
                  "to deal in the Software without restriction. THE REST IS FORBIDDEN") == set()
    assert labels("Redistribution and use in source and binary forms are permitted only on Mondays") == set()
    assert labels("not released under the BSD license") == labels("never licensed under the MIT license") == set()
    assert labels("Released under the terms of the BSD 3-clause license.") == {"bsd-notice"}
    assert labels("distributed under the MIT license") == {"mit-notice"}
    assert labels("SPDX-License-Identifier: MIT") == {"spdx-mit"}
    assert labels("// SPDX-License-Identifier: GPL-2.0-or-later") == {"spdx-gpl-2.0"}
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == {"spdx-bsd"}


def test_licenses_of_empty_tables_and_long_texts(spark):
    assert licenses.scan_documents(spark.createDataFrame([], "text string")).collect() == []
    long = "copyright " * 300_000 + MIT
    row = licenses.scan_documents(spark.createDataFrame([(long,)], "text string")).first()
    assert [(m.start, m.label) for m in row.licenses.matches] == [(300_000, "mit-text")]


def edits(a, b):
    """Edit distance with swapped neighbours as one edit."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_levenshtein_automaton():
    rnd = random.Random(1)
    terms = {"".join(rnd.choice("abc") for _ in range(rnd.randint(4, 10))) for _ in range(25)}
    entries = [toxicity.Entry(t, False, 3 + rnd.random()) for t in sorted(terms)]
    lexicon = toxicity.Lexicon(entries)
    for _ in range(1500):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(4, 12)))
        most = 2 if len(word) >= 8 else 1
        near = [
            (edits(e.text, word), -e.lean, e) for e in entries
            if edits(e.text, word) <= min(most, toxicity.budget(len(e.text))) or e.text == word
        ]
        found = lexicon.match(word)
        if near and len(word) <= lexicon.longest:
            best = min(near, key=lambda x: x[:2])
            assert found == (best[2], best[0])
        else:
            assert found is None


def toxic_rows():
    rnd = random.Random(7)
    words = [f"{a}{b}{c}" for a in "kmt" for b in "aeiou" for c in "rlns"]
    bad = ["badword", "wretched"]
    rows = []
    for i in range(400):
        text = [rnd.choice(words) for _ in range(30)]
        toxic = int(i % 4 == 0)
        if toxic:
            text[rnd.randrange(30)] = rnd.choice(bad)
            text[rnd.randrange(30)] = rnd.choice([*bad, "zorg" + rnd.choice(words)])
        rows.append((i, " ".join(text), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (None, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(901, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(toxicity.training_rows(docs.withColumn("score", F.lit(1)), labels))
    assert {e.text for e in model.entries} >= {"badword", "wretched"}
    scored = toxicity.score_documents(docs.withColumn("score", F.lit("old")), model)
    found = {r.doc_id: r.score for r in scored.withColumn("h", toxicity.held_out(F.col("doc_id"))).where("h").collect()}
    truth = {i: y for i, _, y in rows}
    right = sum((found[i] >= 0.7) == bool(truth[i]) for i in found if i in truth)
    assert len(found) > 100 and right / sum(i in truth for i in found) >= 0.95
    extra = spark.createDataFrame([(1, "what a badwrod this is"), (2, None), (3, "x" * 100_000)], "doc_id int, text string")
    score = {r.doc_id: r.score for r in toxicity.score_documents(extra, model).collect()}
    assert score[1] > 0.5 > max(score[2], score[3])


def test_rare_terms_enter_the_lexicon(spark):
    """Five texts with a term are enough, however many toxic texts there are, and however many terms."""
    rare = [f"{a}{b}{c}ozzle" for a in "bdfghjkl" for b in "aeiou" for c in "mnprstvwxzbdfg"]
    rows = [(f"common wretched {i}", 1) for i in range(400)] + [(f"all is well {i}", 0) for i in range(4000)]
    rows += [(" ".join([*rare[at : at + 60], str(at), str(i)]), 1) for at in range(0, len(rare), 60) for i in range(5)]
    table = spark.createDataFrame(rows, "text string, label int")
    model = toxicity.learn(table)
    assert {e.text for e in model.entries} >= {"wretched", *rare} and len(rare) > 500
    texts = spark.createDataFrame([(0, "all is well"), (1, " ".join(rare[:9]))], "doc_id int, text string")
    score = {r.doc_id: r.score for r in toxicity.score_documents(texts, model).collect()}
    assert score[0] < 0.5 < score[1]


def test_misspelled_stems_and_short_terms():
    rnd = random.Random(2)
    stems = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(4, 6))) for _ in range(9)})
    lexicon = toxicity.Lexicon([toxicity.Entry(t, True, 3 + rnd.random()) for t in stems])
    for _ in range(1500):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 12)))
        near = [min(edits(t, word[:n]) for n in range(len(word) + 1)) for t in stems]
        found = lexicon.match(word)
        assert (found is None) == (min(near) > 1)
        assert found is None or found[1] == min(near) == near[stems.index(found[0].text)]

    entries = [toxicity.Entry("scum", False, 9.0), toxicity.Entry("idio", True, 5.0), toxicity.Entry("scuma", False, 4.0)]
    matcher = toxicity.Matcher(entries)
    for word in ("scm", "sucm", "scvm", "idoit", "ldiots"):
        found = dict(zip(toxicity.FEATURES, matcher.features(f"you {word} there"), strict=True))
        assert found["weak_hits"] > 0 and found["hits"] == found["near_hits"] == found["kinds"] == 0
    found = dict(zip(toxicity.FEATURES, matcher.features("scvma"), strict=True))
    assert found["near_hits"] > 0 and found["weak_hits"] == 0

    counts = {("idiot", False): (93, 0), ("idiots", False): (40, 0), ("idio", True): (120, 0), ("idiot", True): (40, 0)}
    chosen = {(e.text, e.stem) for e in toxicity.merged(counts, 300, 2000, 4, 3.0)}
    assert chosen == {("idio", True), ("idiot", False), ("idiots", False)}


def test_quotation_is_not_use():
    matcher = toxicity.Matcher([toxicity.Entry("badword", False, 5.0)])
    used = dict(zip(toxicity.FEATURES, matcher.features("you are a badword today"), strict=True))
    quoted = dict(zip(toxicity.FEATURES, matcher.features('the report says "badword" is a word'), strict=True))
    assert used["hits"] > 0 and used["quoted_hits"] == 0
    assert quoted["hits"] == 0 and quoted["quoted_hits"] > 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.learn(toxicity.training_rows(docs, labels))
    assert toxicity.score_documents(docs, model).first().score < 0.5


def test_top_inner_products(spark):
    rnd = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rnd.integers(-3, 3, 4)]) for i in range(200)] + [
        (500, None), (501, [1.0, float("nan"), 0.0, 0.0]), (502, [1.0, None, 0.0, 0.0]), (503, [1.0]),
        (None, [1.0] * 4), (7, [9.0] * 4), (504, []), (505, [float("inf"), 0.0, 0.0, 0.0]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    found = topk_search.top_inner_products(
        vectors.repartition(5), F.col("vec_id") % 10 == 0, block=16, pivots=5, batch=4, nearest=1
    )
    ids = np.arange(200)
    whole = np.floor(256 * np.array([v for _, v in rows[:200]])).astype(np.int64)
    want = []
    for i in ids[ids % 10 == 0]:
        score = whole @ whole[i]
        best = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        want += [(int(i), n + 1, int(j), int(score[j])) for n, j in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert topk_search.top_inner_products(vectors.limit(0), F.col("vec_id") == 0).count() == 0
    few = topk_search.top_inner_products(vectors.where("vec_id < 3"), F.col("vec_id") == 0)
    assert few.count() == 2
