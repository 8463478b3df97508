"""Gated license scans against all rules tried on every text: examples of every rule, with names wrapped over lines and hyphened."""

import re
from re import _parser as parser

import pytest

from ledgerline.llm import licenses

from .test_llm import frame, rows

FLAGS = re.IGNORECASE | re.ASCII
BASE = [(re.compile(r"(?<![a-z0-9])" + r"[^a-z0-9]+".join(p.split()) + r"(?![a-z0-9])", FLAGS), label) for p, label in licenses.PHRASES.items()]
PLAIN = [
    "Released under GPL-3.0", "Distributed under the terms of the MPL 2.0", "WTFPL", "Proprietary and confidential", "This program is free software: you can redistribute it",
    "see mozilla.org/MPL/2.0", "eclipse.org/legal/epl-v10", "scripts.sil.org/OFL", "commonsclause.com", "(c) 2020 us", "© 1999", "the GNU General\n  Public License v2",
    "Permission\nis\nhereby granted, free of charge, to any person obtaining a copy", "Redistribution\nand use in source and binary forms", "nothing to see, permit the commission",
]


def example(nodes, k):
    """A text that the expression matches: the k-th branches, white space of kind k."""
    out = ""
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "BRANCH":
            out += example(arg[1][k % len(arg[1])], k)
        elif name == "SUBPATTERN":
            out += example(arg[3], k)
        elif name == "MAX_REPEAT":
            low, high, inner = arg
            out += example(inner, k) * (low if k == 1 else min(max(low, 1), int(high)))
        elif name == "IN":
            kinds = [(None, x[1][0] if str(x[0]) == "RANGE" else x[1]) for x in arg if str(x[0]) in ("LITERAL", "RANGE")]
            out += ["\n", "-", "\t "][k % 3] if any(str(a[1]) == "CATEGORY_SPACE" for a in arg) else "9" if not kinds else chr(kinds[0][1])
        elif name in ("NOT_LITERAL", "ANY"):
            out += "q"
        else:
            assert name == "ASSERT_NOT", name
    return out


def ungated(text):
    found = sorted((pr, m.start() - m.end(), m.start(), m.end(), label, s) for label, p, _, pr, s in licenses.rules() for m in re.finditer(p, text, FLAGS))
    kept = []
    for d in found:
        if all(d[3] <= k[2] or k[3] <= d[2] for k in kept):
            kept.append(d)
    base = {label for p, label in BASE if p.search(text)}
    left = 0.5 if base else 1.0
    for d in kept:
        left *= 1 - d[5]
    return ",".join(sorted(base | {d[4] for d in kept})), 1 - left


def test_every_rule_without_gates(spark):
    every = list(PLAIN)
    for _, p, _, _, _ in licenses.rules():
        for k in range(3):
            x = example(parser.parse(p), k)
            assert re.search(p, x, FLAGS), (p, x)
            every.append(x.title() if k == 2 else x)
    got = {r["doc_id"]: r for r in rows(licenses.scan(frame(spark, every)))}
    for i, x in enumerate(every):
        labels, score = ungated(x)
        assert got[i]["labels"] == labels, x
        assert got[i]["score"] == pytest.approx(score), x
    assert all(got[i]["labels"] for i in range(len(PLAIN) - 1)) and not got[len(PLAIN) - 1]["labels"]


def test_names_of_organisations_and_other_versions_are_no_licenses(spark):
    texts = [
        "The course is provided by MIT and Harvard.", "published by MIT Press in 2020", "distributed by ISC", "We run Apache 2.4.1 on Linux", "We run Apache 2 on Linux", "upgrade to GPL 2.1 rules",
        "provided by the Unicode Consortium", "maintained and published by Ruby developers",
        "released under MIT", "Provided by the MIT license", "distributed under the Apache License, Version 2.0", "Apache 2.0 License", "licensed under Apache 2.0.", "released by us under GPL 2.0.", "covered by the GNU GPL v3",
    ]
    want = ["", "", "", "", "", "", "", "", "mit", "mit", "apache-2.0", "apache-2.0", "apache-2.0", "gpl-2.0", "gpl-3.0"]
    got = {r["doc_id"]: r["labels"] for r in rows(licenses.scan(frame(spark, texts)))}
    assert [got[i] for i in range(len(texts))] == want
