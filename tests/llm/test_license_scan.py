import re

from semtflow.llm.license_scan import TEMPLATES, default_templates, scan_licenses


def tokens(t):
    return re.sub(r"[^\w]+|_", " ", (t or "").lower()).split()


def runs(t):
    w = tokens(t)
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def brute(text, share=0.8):
    s, out = runs(text), set()
    for name, t in TEMPLATES.items():
        tpl = runs(t)
        m = len(tpl)
        step = max(1, m // 8)
        must = {r for r in tpl if any(c.isdigit() for c in "".join(r)) or "gnu" in r}
        if any(len(set(tpl) & set(s[k : k + m + step - 1])) >= share * len(set(tpl)) and must <= set(s[k : k + m + step - 1]) for k in range(0, len(s), step)):
            out.add(name)
    return out


def test_notices(spark):
    mit, apache = TEMPLATES["MIT-text"], TEMPLATES["Apache-2.0-header"]
    texts = [
        "", None, "four words are here", "x " * 50 + TEMPLATES["MIT"] + " y" * 50, mit, "// " + mit.upper().replace(" ", "\n// ", 3), mit.replace("software", "program", 1),
        " ".join(mit.split()[:40]), mit[: len(mit) // 3], " ".join(apache.split()[3:]), apache + " z" * 9 + apache, "Licensed under CC BY-NC 4.0", "licensed under the Apache License, version 2.0!",
        "a " * 3000 + TEMPLATES["GPL-3.0-header"] + " b" * 3000 + TEMPLATES["BSD"], "Released under the BSD License.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {k: set() for k in range(len(texts))}
    for r in scan_licenses(docs, default_templates(spark)).collect():
        got[r._id].add(r.license)
        assert 0.8 <= r.containment <= 1
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_versions_are_told_apart(spark):
    two, three = TEMPLATES["GPL-2.0-header"], TEMPLATES["GPL-3.0-header"]
    texts = [two, three, TEMPLATES["GPL-2.0"], TEMPLATES["GPL-3.0"], TEMPLATES["GPL-3.0"].replace("3", "4"), TEMPLATES["LGPL-2.1-header"], "SPDX-License-Identifier: GPL-2.0", "made available under the terms of the MIT License, see below", TEMPLATES["LGPL-3.0-header"], TEMPLATES["AGPL-3.0-header"]]
    docs = spark.createDataFrame([(k, f"some words ahead {t} and some behind") for k, t in enumerate(texts)], "doc_id long, text string")
    got = {k: set() for k in range(len(texts))}
    for r in scan_licenses(docs, default_templates(spark)).collect():
        got[r._id].add(r.license)
    assert got == {0: {"GPL-2.0-header"}, 1: {"GPL-3.0-header"}, 2: {"GPL-2.0"}, 3: {"GPL-3.0"}, 4: set(), 5: {"LGPL-2.1-header"}, 6: {"GPL-2.0-SPDX"}, 7: {"MIT-terms"}, 8: {"LGPL-3.0-header"}, 9: {"AGPL-3.0-header"}}


def test_awkward_documents(spark, awkward, nothing):
    assert scan_licenses(awkward, default_templates(spark)).collect() == []
    assert scan_licenses(nothing, default_templates(spark)).collect() == []
    assert scan_licenses(awkward, default_templates(spark).limit(0)).collect() == []
