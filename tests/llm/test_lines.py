import re
from collections import defaultdict

from tessera.llm import licences, line_dedup
from tests.llm import cases

NORM = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ")


def brute(docs, least):
    sites, first = defaultdict(set), {}
    for d in docs:
        for line in map(NORM, (d[1] or "").split("\n")):
            sites[line].add(d[3])
            first[line] = min(first.get(line, d[0]), d[0])
    out = []
    for d in docs:
        lines = (d[1] or "").split("\n")
        kept = [x for x in lines if not NORM(x) or len(sites[NORM(x)]) < least or first[NORM(x)] == d[0]]
        out.append((d[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_same_as_brute_force(spark):
    for least in (3, 5):
        rows = line_dedup.dedup(cases.table(spark), min_sites=least).collect()
        assert sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in rows) == brute(cases.documents(), least)
        assert sum(r.n_removed for r in rows) > 0
    assert line_dedup.dedup(cases.empty(spark)).count() == 0


def test_null_and_empty_sites_are_two(spark):
    body = cases.documents()[0][4:]
    docs = [(i, f"one line\nown {i}", "en", site, *body) for i, site in enumerate(["a", None, None])] + [(9, "one line\nown 9", "en", "", *body)]
    for rows in (docs, docs[:3]):
        found = line_dedup.dedup(cases.table(spark, rows), min_sites=3).collect()
        assert sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in found) == brute(rows, 3)
    assert sum(r.n_removed for r in line_dedup.dedup(cases.table(spark, docs), min_sites=3).collect()) == 3


def test_exact_counts_near_the_threshold(spark):
    """With many sites the sketch only estimates; lines about the threshold are counted."""
    rows = [(i * 1000 + s, f"line {i}", "en", f"site{s}") + cases.documents()[0][4:] for i, n in enumerate((199, 200, 201, 205)) for s in range(n)]
    found = line_dedup.lines(cases.table(spark, rows), "doc_id", "text", "source")
    assert line_dedup.boilerplate(found, 200, lg_k=5).count() == 3


def test_licences(spark):
    body = cases.documents()[0][2:]
    docs = [(1, "MIT Licence\n\nCopyright (c) 2020 Some One\n\n" + licences.MIT.upper().replace('"', "“"), *body), (2, "x\nLicensed under the Apache Licence, version 2.0\ny\nCopyright 2001", *body), (3, None, *body), (4, "© 2000 nobody", *body), (4, "© 2000 nobody", *body), (5, "Released under the MIT License.", *body)]
    rows = sorted((r.doc_id, r.text_licence, tuple(r.line_licences)) for r in licences.scan(cases.table(spark, docs), licences.known_digests(spark)).collect())
    assert rows == [(1, "MIT", ()), (2, None, ("Apache-2.0",)), (3, None, ()), (4, None, ()), (4, None, ()), (5, "MIT", ("MIT",))]
    assert licences.scan(cases.empty(spark), licences.known_digests(spark)).count() == 0


def test_whole_licences_headers_and_holders(spark):
    """However a text is wrapped, and whoever holds it."""
    texts = dict(licences.full_texts()[::-1])
    mit, notice = " ".join(licences.MIT.split()), "Permission is hereby granted"
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    docs = {name: texts[name] for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")}
    cases_ = [(k, t) for k, t in docs.items()] + [("Apache-2.0", "Copyright 2024 Some One\n\n" + licences.APACHE_HEADER.format("http")), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2024, Some One\nAll rights reserved.\n\n" + texts["BSD-3-Clause"])]
    cases_ += [("MIT", f"MIT License\n\nCopyright (c) 2024 J. R. Smith\n\n{wrap(mit, n)}") for n in range(6, 30)]
    cases_ += [("MIT", "Copyright (c) 2024 X, Inc. Released under the MIT License."), (None, "Copyright (c) 2024 X."), (None, notice)]
    rows = [(i, t, "en", "s", len(t), 1, 0.5, "x", "y", 9) for i, (_, t) in enumerate(cases_)]
    got = {r.doc_id: r for r in licences.scan(cases.table(spark, rows), licences.known_digests(spark)).collect()}
    assert {i: (cases_[i][0], got[i].text_licence) for i in got if cases_[i][0] != got[i].text_licence} == {}
    assert len(got) == len(cases_) and got[len(cases_) - 3].line_licences == ["MIT"]
