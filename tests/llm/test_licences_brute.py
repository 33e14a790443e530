"""The licence scan against a plain Python version that reads words one by one, and free wordings."""

import os
import re

from fieldledger.llm import licences
from tests.llm.conftest import make_docs
from tests.llm.test_licences_warc import APACHE, BOTH_WAYS, BSD2, CASES, GPL, MIT, PUBLISHED

ENDORSE = "3. {} may be used to endorse or promote products derived from this software without specific prior written permission.\n"
FREE = [
    (BSD2 + ENDORSE.format("Neither the name of the University nor the names of its contributors"), "BSD-3-Clause"),
    (BSD2 + ENDORSE.format("Neither the name of Google Inc. nor the names of its\ncontributors"), "BSD-3-Clause"),
    (BSD2 + ENDORSE.format("The name of the author").replace("may be", "may not be"), "BSD-3-Clause"),
    (BSD2 + "3. You must send us a card.\n", "LicenseRef-BSD-other"),
    (
        BSD2 + "3. All advertising materials mentioning features or use of this software must display the following"
        " acknowledgement: This product includes software developed by the University of Somewhere.\n"
        + ENDORSE.format("Neither the name of X nor the names of its contributors").replace("3.", "4."),
        "BSD-4-Clause",
    ),
    (BSD2 + "\nTHIS SOFTWARE IS PROVIDED AS IS", "BSD-2-Clause"),
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("// SPDX-License-Identifier: Apache-2.0\nint main;", "Apache-2.0"),
    ("/* SPDX-License-Identifier: (GPL-2.0+ OR MIT) */", "GPL-2.0-or-later,MIT"),
    ("# SPDX-License-Identifier: GPL-2.0\n", "GPL-2.0-only"),
    ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception AND BSD-3-Clause", "Apache-2.0,BSD-3-Clause"),
    ("SPDX-License-Identifier: Something-1.0", ""),
    ("Licensed under Apache 2.0.", "Apache-2.0"),
    ("Licensed under the MIT License (see LICENSE).", "MIT"),
    ("This project is licensed under the MIT license, see LICENSE.", "MIT"),
    ("This project is licensed under the\nMIT license, see LICENSE\nfor more. Licensed under CC BY 4.0.", "CC-BY-4.0,MIT"),
    ("Licensed under the MIT License, see LICENSE\nLicensed under CC BY 4.0\nend", "CC-BY-4.0,MIT"),
    ("Licensed under the\nMIT License.", "MIT"),
    ("All content is available under CC BY-SA 3.0 unless noted.", "CC-BY-SA-3.0"),
    ("This is not licensed under the MIT License.", ""),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT"),
    (
        "Licensed under either of\n\n * Apache License, Version 2.0\n   (LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0)\n"
        " * MIT license\n   (LICENSE-MIT or http://opensource.org/licenses/MIT)\n\nat your option.",
        "Apache-2.0,MIT",
    ),
    ("Dual licensed under the GNU General Public License v2 or the MIT license.", "GPL-2.0-only,MIT"),
    ("Released under the MIT and\n# ISC license.", "ISC,MIT"),
    ("Licensed under the GNU General Public License, version 2 or later.", "GPL-2.0-or-later"),
    ("He was available under the bridge, see the river.", ""),
]


def test_free_wordings(spark):
    rows = {r.doc_id: r for r in licences.scan_licences(make_docs(spark, [(i, c[0]) for i, c in enumerate(FREE)])).collect()}
    wrong = [(t, w, rows[i].licences) for i, (t, w) in enumerate(FREE) if ",".join(sorted(rows[i].licences.split(","))) != w]
    assert not wrong, wrong


KNOWN = licences.known_sentences() | licences.published_sentences()
RULES = licences.published_rules() + licences.licence_rules()


def spdx(body):
    """Names of SPDX lines, set apart, by reading the words of each line."""
    out = []
    for line in body.split("\n"):
        while "spdx-license-identifier:" in line:
            before, _, line = line.partition("spdx-license-identifier:")
            out.append(before + "\n\n")
            while m := re.match(r"[ \t(]*([a-z0-9][a-z0-9.+-]*)", line):
                line = re.sub(r"^[ \t]+with[ \t]+[a-z0-9.-]+", "", line[m.end() :]).lstrip(")")
                out.append(f"spdx {re.sub(r'(gpl-[0-9.]*[0-9])[+]', r'\1-or-later', m[1])}.\n\n")
                if not (joint := re.match(r"[ \t]+(and|or)(?=[ \t(])", line)):
                    break
                line = line[joint.end() :]
        out.append(line + "\n")
    return "".join(out)[:-1]


def name_of(run):
    run = re.sub(licences.BULLET, "", run)
    return KNOWN.get(re.sub(licences.OPENING, "under ", run))


def read(sentence):
    """Identifiers of one sentence, given as its lines of words; the longest run of lines first."""
    lines = [x for x in sentence if re.sub(licences.BULLET, "", x)]
    ids, at = [], 0
    while at < len(lines):
        for k in range(len(lines) - at, 0, -1):
            run = lines[at : at + k]
            name = name_of(" ".join(run))
            cut = " ".join([*run[:-1], re.sub(licences.REMARK, "", run[-1])])
            if name is None and re.sub(licences.OPENING, "under ", re.sub(licences.BULLET, "", cut)).startswith("under "):
                name = name_of(cut)
            if name:
                ids.append(f"<{name}>")
                at += k
                break
        else:
            ids.append("~")
            at += 1
    return ids


def brute(text):
    body = spdx((text or "").lower().replace("|", " ").replace("\r", " "))
    for gate, pattern, form in licences.rewrites():
        if gate in body and not gate.startswith("spdx"):
            body = re.sub(f"(?s){pattern}", lambda m, f=form: re.sub(r"\$(\d)", lambda g: m[int(g[1])] or "", f), body)
    body = re.sub(licences.VERSION_MARK, "v ", body)
    sentences = []
    for paragraph in re.split(licences.PARAGRAPH_END, body):
        for sentence in re.split(licences.SENTENCE_END, paragraph + ". "):
            lines = [" ".join(re.findall("[a-z0-9]+", line)) for line in sentence.split("\n")]
            if lines := [x for x in lines if x]:
                sentences.append(lines)
    if "redistributions in binary form" in " ".join(" ".join(s) for s in sentences):
        for i in range(1, len(sentences)):
            start = " ".join(sentences[i])
            if sentences[i - 1] in (["3"], ["c"]) and not start.startswith(("neither the name of ", "all advertising ")):
                sentences[i] = ["another clause"]
    sequence = re.sub("~+", "~", "".join(x for s in sentences for x in read(s)))
    names, hits, left = [], 0, sequence
    for name, ids in RULES:
        run = "".join(f"<{i}>" for i in ids)
        if run in left:
            hits += left.count(run)
            left = left.replace(run, "|")
            names += [name] * (name not in names)
    return ",".join(names), hits, sequence.count("<"), left.count("<"), sequence if "<" in sequence else ""


def compare(spark, docs):
    rows = licences.scan_licences(docs).join(docs, "doc_id").collect()
    wrong = [
        (r.text[:300], tuple(r)[1:6], brute(r.text))
        for r in rows
        if (r.licences, r.statements, r.known_sentences, r.unmatched, r.sequence) != brute(r.text)
    ]
    assert rows and not wrong, wrong[:3]


def test_brute_force_on_cases(spark):
    texts = [c[0] for c in (*CASES, *BOTH_WAYS, *PUBLISHED, *FREE)]
    texts += [f"{a}\n\n{b}" for a, b in zip(texts, texts[7:])] + [f"{a}\n{b}" for a, b in zip(texts, texts[11:])]
    texts += ["\n".join("// " + x for x in t.split("\n")) for t in (APACHE, MIT, GPL, BSD2)]
    compare(spark, make_docs(spark, list(enumerate(texts))))


def test_brute_force_on_documents(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    compare(spark, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
