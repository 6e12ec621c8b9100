import os
import random

import pytest

from docquery.llm import license_scan as ls
from docquery.llm.license_texts import BODIES, NAMES, TEMPLATES, UNLIKE

FAMILY = [
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Released under the MIT License.", "mit"),
    ("Our code is released under the MIT License, see below.", "mit"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("You may redistribute it under the terms of the GNU Lesser General Public License, version 2.1", "lgpl"),
]


def triples_likeness(paragraph, family):
    words = ls.words_of(paragraph)
    n, own, sure = len(words) - 2, ls._triples(words), ls.own_triples()[family]

    def alike(template):
        both = len(own & template)
        return max(both / len(template), both / n if n >= 8 else 0) if own & template & sure else 0

    return max(alike(ls._triples(ls.words_of(x))) for x in TEMPLATES[family].strip().split("\n"))


@pytest.mark.parametrize("paragraph, family", FAMILY)
def test_known_families(paragraph, family):
    assert ls.predict(ls.fit(), paragraph)[0] == family


@pytest.mark.parametrize("paragraph", [*UNLIKE.strip().split("\n"), "Licensed under the FooBar License", "", "The public version is free of charge", "She holds a license to drive"])
def test_unknown(paragraph):
    assert ls.predict(ls.fit(), paragraph)[0] == ls.UNKNOWN


def test_scan_equals_scoring_each_paragraph(spark):
    rng = random.Random(2)
    filler = ["thernd", "the", "of", "version", "public", "und", "free", "éau", "3"]
    noise = lambda: " ".join(rng.choices(filler, k=rng.randrange(0, 12)))
    lines = [p for p, _ in FAMILY] + UNLIKE.strip().split("\n") + [x for t in TEMPLATES.values() for x in t.strip().split("\n")]
    texts = ["\n".join(rng.choice([noise(), rng.choice(lines), rng.choice(lines) + " " + noise()]) for _ in range(rng.randrange(0, 7))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(None, "x\nReleased under the MIT License."), (3, None), (4, ""), (5, texts[5]), (6, "w " * 40000 + "\nReleased under the MIT License.")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, licenses string").repartition(3)
    got = ls.scan_licenses(df).collect()
    assert len(got) == len(rows)

    def want(text):
        out = []
        for n, p in enumerate((text or "").split("\n")):
            family, probability = ls.predict(ls.fit(), p)
            if family != ls.UNKNOWN:
                alike = triples_likeness(p, family)
                out.append((n, family, round(probability, 6), round(alike, 6), alike >= 0.6))
        return out

    found = sorted(repr((r.doc_id, [(x.paragraph, x.family, round(x.probability, 6), round(x.likeness, 6), x.confirmed) for x in r.licenses])) for r in got)
    wanted = sorted(repr((i, want(t))) for i, t in rows)
    assert [x for x in found if x not in wanted] == [x for x in wanted if x not in found] == []
    assert sum(len(r.licenses) for r in got) > 60
    assert ls.scan_licenses(df.limit(0)).collect() == []


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,"""


def test_wrapped_texts(spark, tmp_path):
    from docquery.llm.queries import op4_license_scan

    texts = [MIT, BSD, GPL, "thernd\n\n" + MIT + "\n\n" + BSD, "She holds a license\nto drive, free of charge", "\n" * 5000 + "x\nfree", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.families for r in op4_license_scan(spark, str(tmp_path)).collect()}
    assert got == {0: ["mit"], 1: ["bsd"], 2: ["gpl"], 3: ["bsd", "mit"], 4: [], 5: [], 6: []}


def test_held_out_templates():
    """Texts that the model isn't fitted to: what is called a license is one, of
    the right family, in 95 of 100 cases at least."""
    m = ls.fit()
    z, y = ls.held_out_scores(m)
    p = ls._softmax(z * m.temperature)
    best, called = p[:, :-1].argmax(axis=1), p[:, :-1].max(axis=1) >= m.threshold
    assert (best[called] == y[called]).mean() >= 0.95 and called[y == len(TEMPLATES)].mean() <= 0.05
    assert (called & (best == y))[y < len(TEMPLATES)].mean() > 0.85
    assert (m.weights == 0).mean() > 0.6


@pytest.mark.parametrize("line, family", [
    ("of this software and associated documentation files (the \"Software\"), to deal", "mit"), ("MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE", "mit"),
    ("Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants", "apache-2.0"),
    ("it under the terms of the GNU General Public License as published by the Free Software", "gpl"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", "isc"),
    ("Altered source versions must be plainly marked as such, and must not be misrepresented", "zlib"),
    ("He released the album under the MIT press in version 2.0, and it sold well in all shops", None), ("The law allows any person to use the beach free of charge for the whole of the summer", None),
])
def test_lines_of_wrapped_paragraphs(spark, line, family):
    [r] = ls.scan_licenses(spark.createDataFrame([(1, "x\n" + line)], "doc_id long, text string")).collect()
    assert [x.family for x in r.licenses if x.confirmed] == ([family] if family else [])


def confirmed(spark, bodies, model=None):
    """{(body, family): its confirmed lines and passages}."""
    df = spark.createDataFrame([(name, ls.body(name)) for name in bodies], "doc_id string, text string")
    out = {}
    for r in ls.scan_licenses(df, model=model).collect():
        for x in [*r.licenses, *r.passages]:
            if x.confirmed:
                out.setdefault((r.doc_id, x.family), []).append(ls.body(r.doc_id).split("\n")[x.paragraph])
    return out


def test_whole_bodies(spark):
    """Every body is found; of another family only what names it."""
    got = confirmed(spark, BODIES)
    assert {b for b, f in got if f == BODIES[b]} == set(BODIES)
    foreign = {k: lines for k, lines in got.items() if k[1] != BODIES[k[0]]}
    assert set(foreign) == {("GPL-3", "agpl"), ("LGPL-2.1", "gpl")}
    for (_, family), lines in foreign.items():
        assert all(any(name in line.lower() for name in NAMES[family]) for line in lines)


def test_families_held_out_whole(spark):
    """Bodies of families left out of the fit, of the templates and of the
    comparison: nothing is confirmed as something else but a sentence that the
    Artistic License has word for word in common with the BSD licenses."""
    held = ("artistic", "gfdl", "public-domain")
    m = ls.fit(without=held)
    assert not set(held) & set(m.families)
    [(where, lines)] = confirmed(spark, [b for b, f in BODIES.items() if f in held], m).items()
    sentence = "may not be used to endorse or promote products derived from this software without specific prior written permission."
    assert where == ("Artistic", "bsd") and len(lines) == 2 and " ".join(x.strip() for x in lines).endswith(sentence)


def test_registered_query_against_plain_python(spark):
    """All documents of the smallest tables and some license texts."""
    from docquery.llm.queries import op4_license_scan

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    m, cues = ls.fit(), set(ls.fit().cues)
    at, sure = {g: i for i, g in enumerate(m.grams)}, ls.own_triples()
    templates = {f: [ls._triples(ls.words_of(x)) for x in t.strip().split("\n")] for f, t in TEMPLATES.items()}

    def family(words):
        z = sorted(at[g] for g in ls.grams_of(words) if g in at)
        p = ls._softmax((m.weights[z].sum(axis=0) + m.bias)[None] * m.temperature)[0]
        best = int(p[:-1].argmax())
        if p[best] < m.threshold:
            return None, False
        own, f = ls._triples(words), m.families[best]
        n = len(words) - 2
        alike = [max(len(own & t) / len(t), len(own & t) / n if n >= 8 else 0) for t in templates[f] if own & t & sure[f]]
        return f, max(alike, default=0) >= 0.6

    def want(text):
        runs, singles, last = [], [], None
        for i, line in enumerate((text or "").split("\n")):
            words = ls.words_of(line)
            if cues.intersection(words):
                if i - 1 != last:
                    runs.append([])
                runs[-1].append(words)
                singles.append(words)
                last = i
        lines = [x for x in map(family, singles) if x[0]]
        said = {f for f, ok in lines if ok}
        passages = [f for f, ok in (family(sum(r, [])) for r in runs if len(r) > 1) if ok and f not in said]
        return len(lines) + len(passages), sorted(said | set(passages))

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_licenses, r.families) for r in op4_license_scan(spark, data).collect()}
    assert got == {d.doc_id: want(d.text) for d in docs}
    assert sum(bool(f) for _, f in got.values()) > 0
