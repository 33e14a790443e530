import base64
import glob
import hashlib
import random
import re
import time
from html.parser import HTMLParser

from fieldledger.llm import licences, warc
from tests.llm.conftest import make_docs

MIT = """Copyright (c) 2020 A. Person

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""

BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


CASES = [
    ("Licensed under the Apache License, Version 2.0.\nMore prose.", "Apache-2.0", 0),
    ("Prose. Released under the MIT License.\nThen prose.", "MIT", 0),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only", 0),
    ("Licensed under CC BY-NC 4.0.\nReleased under the MIT License. Licensed under CC BY-NC 4.0.", "MIT,CC-BY-NC-4.0", 0),
    (MIT, "MIT", 0),
    (BSD2, "BSD-2-Clause", 0),
    (BSD2 + ENDORSE, "BSD-3-Clause", 0),
    (BSD2 + "Something between. " + ENDORSE, "BSD-2-Clause", 1),
    (BSD2.split("\n")[1] + "\n" + BSD2.split("\n")[0], "", 2),  # out of order
    ("The licence of MIT is discussed here.", "", 0),
]


def test_rules(spark):
    rows = {r.doc_id: r for r in licences.scan_licences(make_docs(spark, [(i, c[0]) for i, c in enumerate(CASES)])).collect()}
    for i, (text, expected, unmatched) in enumerate(CASES):
        assert (set(rows[i].licences.split(",")), rows[i].unmatched) == (set(expected.split(",")), unmatched), text


def test_odd_documents(tricky, no_docs, tricky_rows):
    rows = licences.scan_licences(tricky).collect()
    assert len(rows) == len(tricky_rows) and all((r.licences, r.statements, r.sequence) == ("", 0, "") for r in rows)
    assert licences.scan_licences(no_docs).count() == 0


WRAPPED_BSD = BSD2.replace("modification, are", "modification,\nare").replace("this list", "this\nlist").replace("following disclaimer in", "following\ndisclaimer in")
BOTH_WAYS = [
    ("Licensed under the MIT License.\n\n" + MIT, {"MIT"}, 2),
    ("Licensed under CC BY 4.0.\n" + WRAPPED_BSD, {"CC-BY-4.0", "BSD-2-Clause"}, 2),
    ("BSD licence\n" + WRAPPED_BSD + "\nReleased under the ISC License\nmore", {"BSD-2-Clause", "ISC"}, 2),
    ("Released under\nCC BY 4.0.", {"CC-BY-4.0"}, 1),
    ("A table\nof words, released under\r\nCC0 1.0\nand more", set(), 0),
    ("A table of words\nReleased under\r\nCC0 1.0\nand more", {"CC0-1.0"}, 1),
    (" * This file is\n * licensed under the\n * MIT License\n *\n * more", {"MIT"}, 1),
    ("# A | B\n" + "\n".join("# " + x for x in MIT.split("\n")), {"MIT"}, 1),
]


def test_statements_by_line_and_wrapped_in_one_text(spark):
    rows = {r.doc_id: r for r in licences.scan_licences(make_docs(spark, [(i, c[0]) for i, c in enumerate(BOTH_WAYS)])).collect()}
    for i, (text, expected, statements) in enumerate(BOTH_WAYS):
        assert (set(filter(None, rows[i].licences.split(","))), rows[i].statements, rows[i].unmatched) == (expected, statements, 0), (text, rows[i])


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the {1} as published by
the Free Software Foundation, either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{1} for more details."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
UNLICENSE = "This is free and unencumbered software released into the public\ndomain.\n\nAnyone is free to copy."
PUBLISHED = [
    (APACHE, "Apache-2.0"), (APACHE.replace("http:", "https:"), "Apache-2.0"), (APACHE.split("\n", 1)[1], "Apache-2.0"),
    (MPL, "MPL-2.0"), (GPL.format(":", "GNU General Public License", "3"), "GPL-3.0-or-later"),
    (GPL.format(";", "GNU General Public License", "2"), "GPL-2.0-or-later"),
    (GPL.format(":", "GNU Affero General Public License", "3"), "AGPL-3.0-or-later"),
    (GPL.format(";", "GNU Lesser General Public License", "2.1").replace("program", "library"), "LGPL-2.1-or-later"),
    (ISC, "ISC"), (UNLICENSE, "Unlicense"), (MIT, "MIT"), (WRAPPED_BSD, "BSD-2-Clause"),
    ("Licensed under the Mozilla Public License, v. 2.0.", "MPL-2.0"),
]


def test_published_headers(spark):
    """Each header as published, on one line a paragraph, and as a comment."""
    one_line = lambda t: "\n\n".join(" ".join(x.split()) for x in t.split("\n\n"))
    forms = [(f(t), name) for t, name in PUBLISHED for f in (str, one_line, lambda t: "\n".join(" * " + x for x in t.split("\n")))]
    rows = {r.doc_id: r for r in licences.scan_licences(make_docs(spark, [(i, c[0]) for i, c in enumerate(forms)])).collect()}
    for i, (text, name) in enumerate(forms):
        assert (rows[i].licences, rows[i].statements, rows[i].unmatched) == (name, 1, 0), (text, rows[i])


def test_own_tables(spark):
    row = licences.scan_licences(
        make_docs(spark, [(1, "First thing. Second thing. First thing.")]),
        {"first thing": "f", "second thing": "s"},
        [("both", ("f", "s")), ("lone", ("f",))],
    ).first()
    assert (row.licences, row.statements, row.unmatched, row.sequence) == ("both,lone", 2, 0, "<f><s><f>")


PAGE = (
    '<!DOCTYPE html><html lang="EN"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>'
    "<body><!-- hidden <p>no</p> --><h1>Head</h1><p>One<br>two <b>three</b> &copy; &#233;</p><div>last</div></body></html>"
)
RESPONSE = "doc_id long, record_id string, target_uri string, warc_date string, http_headers string, payload string, header string"


class Reader(HTMLParser):
    """Words of a page by the standard parser."""

    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.out.append(" " if tag not in ("b", "i", "a", "span", "em") else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.out.append(" " if tag not in ("b", "i", "a", "span", "em") else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def records_of(data: bytes):
    """Records of a WARC file, read by their lengths."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        yield fields, rest[:size]
        data = rest[size + 4 :]


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_file_round_trip(spark, tmp_path):
    headers = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nServer: test: x"
    rows = [
        (1, "<urn:a>", "http://a.example/", "2020-01-01T00:00:00Z", headers, PAGE, "x"),
        (2, "<urn:b>", None, None, None, None, None),
        (3, "<urn:c>", "http://c.example/é", "2021-01-01T00:00:00Z", "", "plain é\r\n\r\nwords" * 2000, "x"),
    ]
    out = warc.build_derivatives(spark.createDataFrame(rows, RESPONSE))
    assert out.count() == 6
    warc.write_warc(out, str(tmp_path / "w"))
    found = [r for f in glob.glob(str(tmp_path / "w" / "part-*")) for r in records_of(open(f, "rb").read())]
    assert len(found) == 6
    for source in rows:
        payload = (source[5] or "").encode()
        own = {f["WARC-Type"]: (f, b) for f, b in found if f["WARC-Refers-To"] == source[1]}
        assert set(own) == {"metadata", "conversion"}
        for f, block in own.values():
            assert f["WARC-Block-Digest"] == sha1(block)
            assert f["WARC-Source-Payload-Digest"] == sha1(payload)
            assert f.get("WARC-Refers-To-Date") == source[3]
        facts = own["metadata"][1].decode()
        assert f"conversion-record: {own['conversion'][0]['WARC-Record-ID']}" in facts
        assert f"source-payload-digest: {sha1(payload)}" in facts
        if source[4]:
            assert "source-header-server: test: x" in facts and "source-status-line: HTTP/1.1 200 OK" in facts
    text = next(b for f, b in found if f["WARC-Type"] == "conversion" and f["WARC-Refers-To"] == "<urn:a>").decode()
    assert text == "A & B\nHead\nOne\ntwo three © é\nlast"


def test_text_has_the_words_of_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for p in pages:
        reader = Reader()
        reader.feed(p.html)
        assert re.findall(r"\w+", warc.plain_text(p.html)) == re.findall(r"\w+", "".join(reader.out))


def test_pages_and_empty(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (5, "", "", "x")], "page_id long, url string, html string, block string")
    out = warc.build_derivatives(warc.page_responses(pages)).collect()
    assert len(out) == 4 and all(r.refers_to.startswith("<urn:uuid:") for r in out)
    assert warc.build_derivatives(warc.page_responses(pages.limit(0))).count() == 0


def test_response_without_id(spark):
    rows = [(1, None, "http://a/", "2020-01-01T00:00:00Z", None, "<p>x</p>", "h"), (2, None, None, None, None, None, "h"),
            (3, None, "http://b/", "2020-01-01T00:00:00Z", None, "<p>x</p>", "h")]
    out = warc.build_derivatives(spark.createDataFrame(rows, RESPONSE)).collect()
    assert len({r.record_id for r in out}) == 6
    assert all(r.refers_to is None and "Refers-To:" not in r.header for r in out)


def brute_hidden(markup):
    return re.sub(r"(?is)<!--.*?-->|<(script|style|template|noscript|head)\b[^>]*>.*?</\1\s*>", " ", markup)


def test_hidden_parts_match_one_expression():
    rng = random.Random(4)
    parts = ["<!--", "-->", "<script>", "<SCRIPT src='x'>", "</script>", "</script >", "<style>", "</style>", "<head>",
             "</head>", "<title>", "</title>", "a", "<p>", " ", "<!", "--", ">", "<header>"]
    for _ in range(3000):
        markup = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert warc.without_hidden(markup) == brute_hidden(markup), markup


def test_markup_that_never_closes_takes_linear_time():
    for piece in ("<script>", "<!--", "<title>", "<a", "<script", "<html ", "</p", "<p>", "<style><head>"):
        started = time.monotonic()
        warc.plain_text(piece * 150_000)
        warc.language_of(piece * 150_000)
        assert time.monotonic() - started < 20
