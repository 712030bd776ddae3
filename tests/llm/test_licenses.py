"""License scan on planted wordings."""

from __future__ import annotations

import random

from waymark.llm import entries, licenses

PROSE = "Thwhing onwh haheble ofone and some more words of no weight. " * 4
MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_is_registered():
    assert "op3_licenses" in entries.QUERIES


def test_planted_licenses(spark):
    rows = [
        (1, f"{PROSE}\nReleased under the MIT License.\n{PROSE}", {"MIT"}),
        (2, "This work is licensed under the GNU General Public License, version 3. Is onhe. Is onhe.", {"GPL-3.0"}),
        (3, f"{PROSE} Licensed under CC BY-NC 4.0. {PROSE}", {"CC-BY-NC-4.0"}),
        (4, "Licensed under the Apache License, Version 2.0.", {"Apache-2.0"}),
        (5, f"{PROSE}\n{MIT}\n{PROSE}", {"MIT"}),
        (6, "Licensed under the Apache License, Version 2.0.\n" + PROSE * 5 + "\nReleased under the MIT Licence.", {"Apache-2.0", "MIT"}),
        (7, "This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0"}),
        (8, "This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        (9, "The driver needs a license and permission of the warden.", set()),
        (10, None, set()),
        (11, "", set()),
        (None, "Licensed under CC BY 4.0.", {"CC-BY-4.0"}),
        (12, "Licensed under the MIT License or the Apache License, Version 2.0.", {"MIT", "Apache-2.0"}),
    ]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    found: dict = {}
    for r in licenses.licenses(docs).collect():
        assert r.saved > 0 and r.n_blocks >= 1
        assert r.n_differences == (0 if r.differences == "" else len(r.differences.split(" ")))
        assert r.license not in found.setdefault(r.doc_id, set())
        found[r.doc_id].add(r.license)
    assert {i: found.get(i, set()) for i, _, _ in rows} == {i: want for i, _, want in rows}


def test_notice_whose_dictionary_saves_nothing():
    found = licenses.winners("Thedeaou for erhaat ha from that ndwh.\nNttion of.\nErou.\nReleased under the MIT License.")
    assert [(x[0], x[3]) for x in found] == [("MIT", ())]


def test_text_of_very_many_lines(spark):
    text = "a b.\n" * 60_000 + "Released under the MIT License.\n" + "c d.\n" * 60_000
    found = licenses.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license, r.n_differences) for r in found] == [(1, "MIT", 0)]


def test_differences_against_plain_edit_distance():
    r = random.Random(3)
    for _ in range(60):
        t, b = r.choices("abc", k=r.randint(1, 6)), r.choices("abcd", k=r.randint(0, 12))

        def cost(x, y):
            row = list(range(len(y) + 1))
            for i, u in enumerate(x, 1):
                row, old = [i], row
                for j, v in enumerate(y, 1):
                    row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (u != v)))
            return row[-1]

        want = min(cost(t, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        start, stop, said = licenses.differences(t, b, len(t))
        assert len(said) == want == cost(t, b[start:stop])


def test_tags_and_names_beyond_the_whole_texts(spark):
    lines = {
        "SPDX-License-Identifier: MIT": {"MIT"}, "// SPDX-License-Identifier: GPL-3.0-or-later": {"GPL-3.0"}, "Licensed under the Eclipse Public License 2.0.": {"EPL-2.0"}, "Licensed under the zlib license.": {"Zlib"},
        "Apache License 2.0": {"Apache-2.0"}, "GPLv3": {"GPL-3.0"}, "released under LGPL v2.1, see there": {"LGPL-2.1"}, "under the SIL Open Font License, Version 1.1": {"OFL-1.1"}, "the licence of the pub is open": set(), "Boost Software License - Version 1.0": {"BSL-1.0"},
    }
    rows = [(i, f"{PROSE}\n{t}\n{PROSE}", "x") for i, t in enumerate(lines)] * 2 + [(99, "licence word " * 40_000 + "SPDX-License-Identifier: Zlib", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    found, n = {}, 0
    for r in licenses.licenses(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
        n += 1
    assert {i: found.get(i, set()) for i in range(len(lines))} == dict(enumerate(lines.values())) and found[99] == {"Zlib"}
    assert n == 2 * sum(map(len, lines.values())) + 1  # repeated rows give rows each
    assert licenses.licenses(docs.limit(0)).collect() == []
    own = (("House-1", "under the {house license one}"), ("House-2", "under the {house license one}"), ("Inn", "{inn license}"))
    mine = licenses.licenses(spark.createDataFrame([(1, "It is under the House License One, as the Inn License says. MIT License")], "doc_id long, text string"), own).collect()
    assert sorted(r.license for r in mine) == ["House-1", "Inn"]


def test_every_template_is_found_in_its_own_wording():
    for name, wording in licenses.TEMPLATES:
        plain = wording.replace("{", "").replace("}", "")
        assert name in {w[0] for w in licenses.winners(plain)}, wording
