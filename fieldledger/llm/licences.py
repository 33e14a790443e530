"""Licence scan by sentence rules.

A text is cut into sentences, each is normalised and mapped to the identifier of a known licence
sentence, and the sequence of identifiers is matched against an ordered list of licence rules.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GPL_NAMES = {
    "GPL": "gnu general public license",
    "LGPL": "gnu lesser general public license",
    "AGPL": "gnu affero general public license",
}
_GPL_VERSIONS = {"GPL": ("1", "2", "3"), "LGPL": ("2 1", "3"), "AGPL": ("3",)}
_CC_KINDS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
_CC_NAMES = {
    "by": "attribution",
    "by sa": "attribution sharealike",
    "by nc": "attribution noncommercial",
    "by nd": "attribution noderivatives",
    "by nc sa": "attribution noncommercial sharealike",
    "by nc nd": "attribution noncommercial noderivatives",
}
#: Short forms "licensed under ..." etc. of licences with one name.
_NAMED = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache license v2 0"),
    "MIT": ("mit license", "mit"),
    "ISC": ("isc license", "isc"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0"),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1 0", "creative commons zero 1 0", "creative commons cc0 1 0 universal public domain dedication"),
    "BSL-1.0": ("boost software license version 1 0",),
    "Zlib": ("zlib license",),
}
#: Words before "under" in a short statement.
VERBS = "licensed|released|distributed|published|available|made available"
#: Openings of a short statement, all read as "under": in the operator, and in the DuckDB statement.
OPENING = (
    "(?m)^(?:(?:this|the|all|our)(?: (?!(?:not|never|no|is|are|was|were) )[a-z0-9]+){0,6} (?:is|are) )?(?:also )?(?:dual )?"
    rf"(?:{VERBS}) under (?:the terms of )?(?:the |a |an )?"
)
LEAD = (
    "(?m)^(?:this [a-z]+ is )?(?:also )?(?:dual )?(?:licensed|released|distributed|published|available|made available)"
    " under (?:the terms of )?(?:the |a |an )?"
)
#: Numbers and letters of lists at the start of a sentence.
BULLET = "(?m)^(?:[0-9]+|[a-z])(?: |$)"
#: Ends of sentences and paragraphs, a version mark that ends none, and the words that the DuckDB statement reads again for.
SENTENCE_END = r"[.;:!?][ \t\r\n]+"
PARAGRAPH_END = r"\n[ \t\r]*\n"
VERSION_MARK = r"\bv\.[ \t\r\n]+(?=[0-9])"
LICENCE_WORDS = "licen[sc]e|permission|redistribution"

#: Full licence sentences, normalised, by identifier.
_SENTENCES = {
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation"
        " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to"
        " permit persons to whom the software is furnished to do so subject to the following conditions"
    ),
    "mit-notice": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of the software"
    ),
    "mit-warranty": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to"
        " the warranties of merchantability fitness for a particular purpose and noninfringement"
    ),
    "mit-liability": (
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability"
        " whether in an action of contract tort or otherwise arising from out of or in connection with the software"
        " or the use or other dealings in the software"
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met"
    ),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer"
    ),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and or other materials provided with the distribution"
    ),
    "bsd-endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission"
    ),
    "bsd-advert": (
        "all advertising materials mentioning features or use of this software must display the following"
        " acknowledgement"
    ),
    "bsd-acknowledge": "this product includes software",
    "bsd-other": "another clause",
    "apache-grant": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-warranty": (
        "unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-warranty": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the"
        " implied warranty of merchantability or fitness for a particular purpose"
    ),
    "mpl-grant": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-grant": "this is free and unencumbered software released into the public domain",
    "rights-reserved": "all rights reserved",
}


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    out = {text: name for name, text in _SENTENCES.items()}
    for name, forms in _NAMED.items():
        for form in forms:
            out[f"under {form}"] = f"named:{name}"
    for kind, title in _GPL_NAMES.items():
        for v in _GPL_VERSIONS[kind]:
            label = f"{kind}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
            short = kind.lower()
            for named in (f"{title} version {v}", f"{title} v {v}", f"{title} v{v}", f"{short} v{v}", f"{short}v{v}"):
                out[f"under {named}"] = f"named:{label}-only"
                for tail in ("or later", "or any later version", "or at your option any later version"):
                    out[f"under {named} {tail}"] = f"named:{label}-or-later"
            out[
                f"this program is free software you can redistribute it and or modify it under the terms of the {title}"
                f" as published by the free software foundation either version {v} of the license or at your option any"
                " later version"
            ] = f"gpl-later:{label}"
    for kind in _CC_KINDS:
        for v in _CC_VERSIONS:
            name = f"named:CC-{kind.upper().replace(' ', '-')}-{v.replace(' ', '.')}"
            out[f"under cc {kind} {v}"] = out[f"under cc {kind} {v} license"] = name
            for tail in ("international license", "license"):
                out[f"under creative commons {_CC_NAMES[kind]} {v} {tail}"] = name
    return out


def licence_rules() -> list[tuple[str, tuple[str, ...]]]:
    """Licence and the run of identifiers that states it; earlier rules take their sentences first."""
    rules = [
        ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
        ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
        ("MIT", ("mit-grant", "mit-notice")),
        ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-acknowledge", "bsd-endorse")),
        ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
        ("LicenseRef-BSD-other", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-acknowledge")),
        ("LicenseRef-BSD-other", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert")),
        ("LicenseRef-BSD-other", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-other")),
        ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
        ("Apache-2.0", ("named:Apache-2.0", "apache-grant", "apache-copy", "apache-warranty", "apache-see")),
        ("Apache-2.0", ("named:Apache-2.0", "apache-grant", "apache-copy")),
        ("ISC", ("isc-grant",)),
        ("MPL-2.0", ("mpl-grant",)),
        ("Unlicense", ("unlicense-grant",)),
    ]
    names = sorted(set(known_sentences().values()))
    for name in names:
        kind, _, label = name.partition(":")
        if kind == "gpl-later":
            rules.append((f"{label}-or-later", (name, "gpl-warranty")))
            rules.append((f"{label}-or-later", (name,)))
    rules += [(name.partition(":")[2], (name,)) for name in names if name.startswith("named:")]
    return rules


def published_sentences() -> dict[str, str]:
    """Further sentences, normalised, as the licences' published headers have them once cut at their marks."""
    out = {
        "under apache license version 2 0 the license": "named:Apache-2.0",
        "http www apache org licenses license 2 0": "apache-url",
        "https www apache org licenses license 2 0": "apache-url",
        "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
    }
    labels = {name.partition(":")[2] for name in known_sentences().values() if name.startswith("named:")}
    for label in labels | {label.removesuffix("-only") for label in labels}:
        name = label if label in labels else f"{label}-only"
        out["spdx " + " ".join(re.findall("[a-z0-9]+", label.lower()))] = f"named:{name}"
    for kind in ("program", "library"):
        out[f"this {kind} is free software"] = "gpl-free"
        out[f"this {kind} is distributed in the hope that it will be useful but without any warranty"] = "gpl-warranty"
    for title_kind, title in _GPL_NAMES.items():
        for v in _GPL_VERSIONS[title_kind]:
            label = f"{title_kind}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
            out[
                f"you can redistribute it and or modify it under the terms of the {title} as published by the free"
                f" software foundation either version {v} of the license or at your option any later version"
            ] = f"gpl-later:{label}"
    return out


def published_rules() -> list[tuple[str, tuple[str, ...]]]:
    """Rules of published headers; they are tried before the others, the longest first."""
    rest = ("apache-warranty", "apache-see")
    rules = [
        ("Apache-2.0", (*name, "apache-grant", "apache-copy", *url, *tail))
        for name in (("named:Apache-2.0",), ())
        for tail in (rest, rest[:1], ())
        for url in (("apache-url",), ())
    ]
    for name in sorted({i for i in known_sentences().values() if i.startswith("gpl-later:")}):
        label = f"{name.partition(':')[2]}-or-later"
        for free in (("gpl-free",), ()):
            for tail in (("gpl-warranty", "gpl-implied"), ("gpl-warranty",), ()):
                rules.append((label, (*free, name, *tail)))
    return rules


#: Blanks, punctuation and comment marks between the words of a wrapped statement.
_W = "[^a-z0-9]++"
#: A list item after the two clauses of a BSD text that is neither of the known further ones.
OTHER_CLAUSE = r"(?m)^[3c][ \n](?!neither the name of |all advertising )[^\n]+$"
#: A remark after a named licence, within the line it stands on.
REMARK = (
    " (?:see|unless|except where|refer to|found in|found at|which|copyright|please|for (?:more |further )?(?:details|information)"
    "|as described|as stated|in the license file|in the copying file|https?)(?: .*)?$"
)
_REMARK_IN_TEXT = f"(?m)^(under [^\n|]*?){REMARK.replace('.', '[^\\n|]')}"


def _wrapped(words: str) -> str:
    return words.replace(" ", _W)


def rewrites() -> list[tuple[str, str, str]]:
    """Gate, pattern and replacement, in order, on the lower-cased text before it is cut: statements
    with a free part become ones without.

    SPDX lines give one statement for each name (AND and OR alike; exceptions after WITH are left out; + is
    "or later"); two licences named in one statement give two; holders in clauses give one fixed holder.
    """
    names = sorted({f for forms in _NAMED.values() for f in forms}, key=lambda f: (-len(f), f))
    gpl = "gnu (?:lesser |affero )?general public license (?:version |v)[^a-z0-9]*[0-9](?: 1)?"
    named = rf"(?:the{_W})?((?:{_wrapped('|'.join([gpl, *names]))})\b)"
    spdx = r"(?:spdx-license-identifier:|(?!^)\G[ \t]+(?:and|or))[ \t(]*([a-z0-9][a-z0-9.+-]*)(?:[ \t]+with[ \t]+[a-z0-9.-]+)?\)*"
    either = rf"(?:either|both)(?:{_W}of)?{_W}{named}[^a-z0-9(]*(?:\([^)]{{0,200}}\))?[^a-z0-9]*(?:(?:or|and){_W})?{named}"
    joint = rf"{named}{_W}(?:or|and){_W}{named}"
    tail = _wrapped("used to endorse or promote products derived from")
    return [
        ("spdx-license-identifier:", r"\b([al]?gpl-[0-9.]*[0-9])\+", "$1-or-later"),
        ("spdx-license-identifier:", spdx, "\n\nspdx $1.\n\n"),
        (" under", rf"\bunder{_W}(?:{_wrapped('the terms of')}{_W})?(?:{either}|{joint})", "under $1$3.\n\nlicensed under $2$4.\n\n"),
        ("endorse", rf"\bneither{_W}(?:(?:the|my){_W})?names?\b.{{0,300}}?\bmay{_W}be{_W}{tail}", _ENDORSE),
        ("endorse", rf"\bthe{_W}names?{_W}of{_W}.{{0,300}}?\bmay{_W}not{_W}be{_W}{tail}", _ENDORSE),
        ("this product includes", rf"{_wrapped('this product includes software developed by')}\b[^.]{{0,300}}\.", "this product includes software."),
    ]


_ENDORSE = _SENTENCES["bsd-endorse"].partition(" this software")[0]
#: Marks of a sequence: an unknown stretch, and a place where a rule has taken its sentences.
GAP, TAKEN = "~", "|"
#: Mark of a line's end within a sentence.
LINE = "|"
#: Words that LEAD can start with.
LEAD_WORDS = (
    "this", "the", "all", "our", "also", "dual", "licensed", "released", "distributed", "published", "available", "made",
)


def rule_text(identifiers: Sequence[str]) -> str:
    return "".join(f"<{i}>" for i in identifiers)


def _where(value: Column, gate: str, change) -> Column:
    """``value``, changed if it contains ``gate``. It is worked out once, where CASE alone would copy its expression."""
    return F.transform(F.array(value), lambda v: F.when(v.contains(gate), change(v)).otherwise(v))[0]


def _look_up(known: dict[str, str]):
    names = ", ".join(f"'{s}'" for s in known)
    ids = ", ".join(f"'{s}', '<{name}>'" for s, name in known.items())
    return lambda s: f"CASE WHEN {s} IN ({names}) THEN element_at(map({ids}), {s}) ELSE '{GAP}' END"


def _sequence(sentences: str, known: dict[str, str]) -> Column:
    """The identifiers of known sentences in order, with one mark for each unknown stretch.

    ``sentences`` is an SQL expression of normalised sentences, one a line, with LINE where a line
    ends within one. A sentence of several lines is read from its first line on: the longest run of
    lines that is known counts, a line that starts none is unknown.
    """
    found = F.expr(
        f"transform(filter(split({sentences}, '\n'), s -> s <> ''),"
        f" s -> CASE WHEN contains(s, '{LINE}') THEN s ELSE {_look_up(known)('s')} END)"
    )
    firsts = "|".join(sorted({s.split(" ")[0] for s in known} | set(LEAD_WORDS)))
    start = rf"^(?:(?:[0-9]+|[a-z]) )?(?:{firsts})(?: |$)"
    # Every known sentence holds its first two words, or "under" after a verb or as its first word, in whatever lines it is:
    # others need no reading by lines.
    openings = {rf"[ {LINE}]".join(s.split(" ")[:2]) for s in known if not s.startswith("under ")}
    openings |= {rf"^(?:(?:[0-9]+|[a-z])[ {LINE}])?under", rf"(?:{VERBS})[ {LINE}]under"}
    opening = rf"\b(?:{'|'.join(sorted(openings))})\b"
    longest = max((len(s.split(" ")) for s in known), default=1) + 12
    table = F.create_map(*(F.lit(x) for s, name in known.items() for x in (s, f"<{name}>"))) if known else None

    def bare(run: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(run, BULLET, ""), OPENING, "under ")

    def of_lines(sentence: Column) -> Column:
        lines = F.filter(F.split(sentence, rf"\{LINE}"), lambda x: bare(x) != "")

        def read(lines: Column) -> Column:
            def best(line, at):
                def tried(k):
                    run = F.array_join(F.slice(lines, at + 1, k), " ")
                    last = F.get(lines, at + k - 1)
                    # The run without the remark at the end of its last line.
                    short = bare(F.concat(F.left(run, F.length(run) - F.length(last)), F.regexp_replace(last, REMARK, "")))
                    short = F.when(short.startswith("under "), short)
                    return F.struct(
                        k.alias("k"),
                        F.coalesce(
                            F.try_element_at(table, bare(run)),
                            F.when(last.rlike(REMARK), F.try_element_at(table, F.coalesce(short, F.lit("")))),
                        ).alias("id"),
                    )

                runs = F.sequence(F.least(F.lit(longest), F.size(lines) - at), F.lit(1), F.lit(-1))
                hits = F.filter(F.transform(runs, tried), lambda x: x["id"].isNotNull())
                return F.when(line.rlike(start), F.get(hits, F.lit(0)))

            def step(state, b):
                inside = state["left"] > 0
                return F.struct(
                    F.when(inside, state["left"] - 1).when(b.isNotNull(), b["k"] - 1).otherwise(0).alias("left"),
                    F.when(inside, state["seq"]).otherwise(F.concat(state["seq"], F.coalesce(b["id"], F.lit(GAP)))).alias("seq"),
                )

            none = F.struct(F.lit(0).alias("left"), F.lit("").alias("seq"))
            return F.aggregate(F.transform(lines, best), none, step, lambda x: x["seq"])

        return F.transform(F.array(lines), read)[0]

    if known:
        found = F.transform(
            found, lambda s: F.when(~s.contains(LINE), s).when(s.rlike(opening), of_lines(s)).otherwise(GAP)
        )
    return F.regexp_replace(F.array_join(found, ""), f"{GAP}+", GAP)


def scan_licences(
    docs: DataFrame,
    known: dict[str, str] | None = None,
    rules: Sequence[tuple[str, Sequence[str]]] | None = None,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per document: key, licences, statements, known_sentences, unmatched, sequence.

    Sentences end at ``.``, ``;``, ``:``, ``!`` or ``?`` before a blank, but not at ``v.`` before a digit; lower
    case, letters and digits only, single blanks. In the sequence ``~`` stands for unknown
    sentences. A rule needs its identifiers side by side; rules are tried in order and take the
    sentences they match. licences: distinct names in rule order, joined by commas, empty if none;
    statements: matches of all rules; unmatched: known sentences that no rule took. A line
    break ends a sentence unless the lines are known as one sentence; empty lines always end it. Null and empty texts have no sentence.
    ``rewrites`` and remarks after a named licence (REMARK, up to the line's end) apply before the look-up. A numbered third clause
    that no rule knows makes a BSD text LicenseRef-BSD-other. One pass, no shuffle.
    """
    known = known_sentences() | published_sentences() if known is None else known
    rules = published_rules() + licence_rules() if rules is None else rules
    rule_list = F.expr(
        "array(" + ", ".join(f"named_struct('name', '{name}', 'run', '{rule_text(ids)}')" for name, ids in rules) + ")"
    )

    def sentences() -> Column:
        body = F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), f"{LINE}\r", "  ")
        for gate, pattern, form in rewrites():
            body = _where(body, gate, lambda b, p=pattern, f=form: F.regexp_replace(b, f"(?s){p}", f))
        body = F.regexp_replace(body, VERSION_MARK, "v ")
        cut = F.regexp_replace(F.regexp_replace(body, PARAGRAPH_END, ". "), SENTENCE_END, "\r")
        plain = F.regexp_replace(F.translate(cut, "\n\r", f"{LINE}\n"), rf"[^a-z0-9\n{LINE}]+", " ")
        joined = F.regexp_replace(plain, rf" ?\{LINE}[ {LINE}]*", LINE)
        marked = F.regexp_replace(joined, rf"[ {LINE}]?\n[ {LINE}]*|^[ {LINE}]+|[ {LINE}]$", "\n")
        clauses = _where(
            marked, "redistributions in binary form", lambda m: F.regexp_replace(m, OTHER_CLAUSE, "another clause")
        )
        lines = F.regexp_replace(clauses, BULLET, "")
        # Sentences of several lines are read by lines, with their openings and remarks.
        opened = rf"{OPENING}(?=[^\n{LINE}]*$)"
        return _where(
            lines, "under ", lambda x: F.regexp_replace(F.regexp_replace(x, opened, "under "), _REMARK_IN_TEXT, "$1")
        )

    def take(state, rule):
        left = F.replace(state["seq"], rule["run"], F.lit(TAKEN))
        hits = (F.length(state["seq"]) - F.length(left)) / (F.length(rule["run"]) - 1)
        return F.struct(
            left.alias("seq"),
            F.when(hits > 0, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"),
            (state["hits"] + hits.cast("long")).alias("hits"),
        )

    def matched(seq: Column) -> Column:
        start = F.struct(
            seq.alias("seq"), F.array().cast("array<string>").alias("names"), F.lit(0).cast("long").alias("hits")
        )
        none = start
        return F.when(seq.contains("<"), F.aggregate(rule_list, start, take)).otherwise(none)

    read = docs.select(key, text)
    lines = read.withColumn("lines", sentences()).withColumn("seq", _sequence("lines", known))
    both = lines.withColumn("m", matched(F.col("seq")))
    best, sequence = F.col("m"), F.col("seq")
    count_ids = lambda s: (F.length(s) - F.length(F.replace(s, F.lit("<"), F.lit("")))).cast("long")
    return both.select(
        key,
        F.array_join(F.array_distinct(best["names"]), ",").alias("licences"),
        best["hits"].alias("statements"),
        count_ids(sequence).alias("known_sentences"),
        count_ids(best["seq"]).alias("unmatched"),
        F.when(sequence.contains("<"), sequence).otherwise("").alias("sequence"),
    )
