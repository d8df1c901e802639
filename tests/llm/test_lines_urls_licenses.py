import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from twinfold.llm import licenses, line_dedup, url_filter
from twinfold.llm.queries import QUERIES

BLANK = " \t\n\r\x0b\x0c"


@pytest.fixture(scope="module")
def pages(spark):
    """Lines on 8 to 13 sites, around the bound; short lines everywhere; null sites."""
    rows, doc_id = [], 0
    for n in range(8, 14):
        for s in range(n):
            lines = [f"line that stands on {n} sites", "short one", f"own line of document number {doc_id}", ""]
            rows.append((doc_id, f"s{s}", "\n".join(lines if doc_id % 2 else [f"  {lines[0]}\t", *lines])))
            doc_id += 1
    rows += [(900, None, "line that stands on 9 sites"), (901, None, "line that stands on 13 sites"), (902, "s1", None), (903, "s1", ""), (904, "s1", "\n\n")]
    rows += [(905, "s5", "line that stands on 12 sites\nkept line of this text")] * 2
    return rows


def cleaned(rows):
    sites = defaultdict(set)
    counts = lambda x: re.search(r"[^\x20\x09-\x0D]", x)
    for _, site, text in rows:
        for line in (text or "").split("\n"):
            if counts(line) and site is not None:
                sites[line.strip(BLANK)].add(site)
    gone = {k for k, v in sites.items() if len(v) >= 10}
    out = []
    for i, _, text in rows:
        lines = [] if text is None else text.split("\n")
        left = [x for x in lines if not (counts(x) and x.strip(BLANK) in gone)]
        out.append((i, len(lines), len(lines) - len(left), None if text is None else hashlib.md5("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("way", ["literals", "broadcast", "joins"])
def test_lines_against_brute_force(spark, pages, tables, monkeypatch, way):
    if way != "literals":
        monkeypatch.setattr(line_dedup, "LITERAL_LINES", -1)
    if way == "joins":
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
        monkeypatch.setattr(line_dedup, "BROADCAST_TEXTS", -1)
    sf = tables(documents=spark.createDataFrame(pages, "doc_id long, source string, text string"))
    found = QUERIES["op5_line_dedup"](spark, sf).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text_md5"]) for r in found), key=str) == cleaned(pages)


@pytest.mark.parametrize("way", ["literals", "joins"])
def test_many_lines_in_one_text_take_linear_time(spark, monkeypatch, way):
    import time

    if way == "joins":
        monkeypatch.setattr(line_dedup, "LITERAL_LINES", -1)
    common = "\n".join(f"boilerplate line number {k} of the footer" for k in range(20_000))
    rows = [(s, f"s{s}", f"own line {s}\n{common}\nlast line of {s}") for s in range(10)] + [(99, "s0", "\n".join([common] * 10))]
    began = time.monotonic()
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert left == {s: f"own line {s}\nlast line of {s}" for s in range(10)} | {99: ""}
    assert time.monotonic() - began < 60


def test_line_edges(spark, docs, empty):
    assert line_dedup.dedup(empty).count() == 0
    clash = docs.withColumn("key", F.lit(1)).withColumn("__row", F.lit("x")).withColumn("at", F.lit(0))
    out = line_dedup.dedup(clash)
    assert out.columns == clash.columns and out.count() == docs.count()


def test_rules_of_urls(spark):
    urls = [
        ("https://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12#a", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
        ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        ("http://org", "org", "", None, "allow"),
        ("http://x.net/a/b?c://d", "x.net", "/a/b", None, "allow"),
        ("no scheme/es/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("x\ny://h\n/p", "h\n", "/p", None, "allow"),
    ]
    df = spark.createDataFrame([(k, u[0]) for k, u in enumerate(urls)], "page_id long, url string")
    none = spark.createDataFrame([], "url string, good int")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, none).collect()}
    assert found == {k: u[1:] for k, u in enumerate(urls)}


def test_reputation_shrinks(spark):
    rows = [(f"http://h{k}.site.example.net/", 1) for k in range(40) for _ in range(20)]
    rows += [("http://bad.example.net/", 0)] * 30 + [("http://seldom.example.net/", 0)] + [("http://nolabel.example.net/", None)] * 9
    outcomes = spark.createDataFrame(rows, "url string, good int")
    hosts = {r["host"]: r for r in url_filter.reputations(outcomes.select(url_filter.host_of(F.col("url")).alias("host"), "good")).collect()}
    assert hosts["bad.example.net"]["upper"] < 0.5 < hosts["seldom.example.net"]["upper"] and "nolabel.example.net" not in hosts
    assert hosts["h1.site.example.net"]["mean"] > 0.9
    seen = spark.createDataFrame([("http://bad.example.net/x",), ("http://seldom.example.net/x",), ("http://bad.example.net/x",)], "url string").withColumn("host", F.lit(3)).withColumn("extra", F.lit(4))
    out = url_filter.judge(seen, outcomes)
    assert [r["verdict"] for r in out.orderBy("url").collect()] == ["block", "block", "allow"] and out.columns == ["url", "extra", "host", "path", "rule", "verdict"]
    assert url_filter.judge(seen.limit(0), outcomes).count() == 0


def test_reputation_by_salted_join(spark, monkeypatch):
    outcomes = spark.createDataFrame([("http://bad.example.net/", 0)] * 30 + [(f"http://g{k}.example.net/", 1) for k in range(90)], "url string, good int")
    seen = spark.createDataFrame([(f"http://{h}.example.net/{k}",) for h in ("bad", "g1") for k in range(20)], "url string")
    rows = lambda: sorted(tuple(r) for r in url_filter.judge(seen, outcomes).collect())
    before = rows()
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", -1)
    assert rows() == before and len({r[-1] for r in before}) == 2


def test_domains(spark):
    hosts = ["a.b.example.net", "example.net", "x.example.net", "www.shop.co", "shop.co", "co", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").withColumn("s", url_filter.suffix_of(F.col("h")))
    got = {r["h"]: (r["s"], r["d"]) for r in df.withColumn("d", url_filter.domain_of(F.col("h"), F.col("s"))).collect()}
    assert got["a.b.example.net"] == ("example.net", "b.example.net") and got["example.net"] == ("example.net", "example.net")
    assert got["www.shop.co"] == ("co", "shop.co") and got["co"] == ("co", "co")


def test_licenses_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "# Licensed under the Apache License, Version 2.0."
    files = [
        ("LICENSE", apache),
        ("a/one.py", "code code code\n" * 20),
        ("b/LICENSE", mit),
        ("b/deep/er/two.py", "code"),
        ("b/own.py", apache + "\n" + "code " * 50),
        ("b/other/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("b/other/x.py", "code"),
        ("c/vague.py", "the license of this is somewhere else entirely and nobody knows\n" + "code " * 50),
        ("c/null.py", None),
        (None, mit),
        (None, "code"),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumn("license", F.lit("theirs")).withColumn("__dir", F.lit(1))
    out = licenses.scan(df)
    found = {r["path"]: (r["license"], r["found_in"]) for r in out.filter("path is not null").collect()}
    assert found == {
        "LICENSE": ("Apache-2.0", "LICENSE"), "a/one.py": ("Apache-2.0", ""), "b/LICENSE": ("MIT", "b/LICENSE"), "b/deep/er/two.py": ("MIT", "b"), "b/own.py": ("Apache-2.0", "b/own.py"),
        "b/other/COPYING": ("GPL-3.0", "b/other/COPYING"), "b/other/x.py": ("GPL-3.0", "b/other"), "c/vague.py": ("Apache-2.0", ""), "c/null.py": ("Apache-2.0", ""),
    }
    assert sorted((r["license"] or "") for r in out.filter("path is null").collect()) == ["", "MIT"]
    assert out.columns == ["path", "text", "__dir", "license", "cosine", "found_in"]


def test_cosines_against_brute_force(spark):
    import math

    lines = ["Released under the MIT License", "Released under the MIT License today", "Licensed under CC BY-NC 4.0.", "this has a license", "SPDX-License-Identifier: MIT"]
    texts = [(f"d{k}/f", f"{lines[k % 5]}\nand text of file {k} that is long enough to be none itself") for k in range(12)]
    toks = lambda s: [x for x in re.split(r"[^a-z0-9.+]+", re.sub(r"\.+(?=[^a-z0-9]|$)", "", s.lower())) if x]
    segments = [toks(t.split("\n")[0]) for _, t in texts]
    n, df = len(segments), defaultdict(int)
    for s in segments:
        for x in set(s):
            df[x] += 1
    idf = lambda x: math.log((1 + n) / (1 + df.get(x, 0))) + 1

    def vector(s):
        w = {x: s.count(x) * idf(x) for x in set(s)}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {k: v / norm for k, v in w.items()}

    expected = {}
    for (path, _), s in zip(texts, segments, strict=True):
        a = vector(s)
        best = min((-round(sum(a[x] * b.get(x, 0) for x in a), 9), name) for name, words in licenses.TEMPLATES for b in [vector(toks(words))])
        expected[path] = (best[1], round(-best[0], 6)) if -best[0] >= licenses.LEAST_COSINE else (None, None)
    found = licenses.scan(spark.createDataFrame(texts, "path string, text string")).collect()
    assert {r["path"]: (r["license"], r["cosine"]) for r in found} == expected


def test_inheritance_against_brute_force(spark):
    import random

    r = random.Random(5)
    notices = {"MIT": "Released under the MIT License", "Apache-2.0": "Licensed under the Apache License, Version 2.0", "ISC": dict(licenses.licence_texts())["ISC"], "BSD-3-Clause": dict(licenses.licence_texts())["BSD-3-Clause"]}
    folders = [""] + ["/".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(60)]
    files = {}
    for k in range(150):
        name = r.choice([None, None, None, *notices])
        path = "/".join(x for x in (r.choice(folders), f"LICENSE.{k}" if name else f"f{k}.py") if x)
        files[path] = (name, notices[name] if name else "code of no licence at all")
    held = defaultdict(list)
    for path, (name, _) in files.items():
        if name:
            held[path.rpartition("/")[0]].append(name)

    def inherited(path):
        at = path.rpartition("/")[0]
        while True:
            if at in held:
                return min(set(held[at]), key=lambda x: (-held[at].count(x), x)), at
            if not at:
                return None, None
            at = at.rpartition("/")[0]

    expected = {p: (name, p) if name else inherited(p) for p, (name, _) in files.items()}
    found = licenses.scan(spark.createDataFrame([(p, t) for p, (_, t) in files.items()], "path string, text string")).collect()
    assert {x["path"]: (x["license"], x["found_in"]) for x in found} == expected
    assert len({v[1] for v in expected.values()}) > 10


def test_license_edges(spark, docs, empty):
    with_path = lambda df: df.withColumn("path", F.concat(F.lit("x/"), F.col("doc_id").cast("string")))
    assert licenses.scan(with_path(empty)).count() == 0
    assert licenses.scan(with_path(docs)).filter("license is not null").count() == 0


def test_whole_licence_texts_are_holders(spark):
    texts = dict(licenses.licence_texts())
    mine = texts["MIT"].replace("<year> <copyright holders>", "2019 Some Person and the other authors of this")
    files = [(f"{name}/LICENSE", mine if name == "MIT" else text) for name, text in texts.items()] + [(f"{name}/src/x.py", "code") for name in texts]
    # prose that holds a licence text as a small part has a license of its own at most
    files += [("prose/README", mine + " ".join(f"word{k} of the" for k in range(600))), ("prose/x.py", "code")]
    found = {r["path"]: (r["license"], r["found_in"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert all(found[f"{x}/LICENSE"] == (x, f"{x}/LICENSE") and found[f"{x}/src/x.py"] == (x, x) for x in texts)
    assert found["prose/x.py"] == (None, None)


def test_wrapped_and_surrounded_notices(spark):
    gnu = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\n"
    prose = " ".join(f"word{k}" for k in range(20))
    texts = {
        "mpl": ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n"),
        "gpl2": ("GPL-2.0", gnu.format("", "2")), "gpl3": ("GPL-3.0", gnu.format("", "3")), "lgpl": ("LGPL-3.0", gnu.format("Lesser ", "3")), "agpl": ("AGPL-3.0", gnu.format("Affero ", "3")),
        "one": ("MIT", f"{prose} Released under the MIT License. {prose} {prose}"),
        "cue": ("Unlicense", "# This is free and unencumbered software released into the public\n# domain.\n"),
        "none": (None, f"{prose} the license of the mit is general and public {prose}"),
    }
    files = [(name, text + "code and words " * 60) for name, (_, text) in texts.items()]
    found = {r["path"]: r["license"] for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert found == {name: x for name, (x, _) in texts.items()}


def test_covered_words_are_counted_once(spark):
    spans = [(3, 5), (0, 4), (4, 2), (20, 1), (20, 1)]
    df = spark.createDataFrame([(spans,)], "s array<struct<start:int, words:int>>")
    assert df.select(licenses.covered(F.col("s"))).first()[0] == len({k for a, n in spans for k in range(a, a + n)})


def test_hosts_without_labels_have_a_prior(spark):
    # hosts of a domain are alike, domains differ
    outcomes = [(f"http://h{k}.{d}.example.net/", good) for k in range(8) for d, good in (("bad", 0), ("fine", 1), ("good", 1)) for _ in range(40)]
    outcomes += [(f"http://h{k}.site{k}.com/", 1) for k in range(8) for _ in range(5)] + [("http://h.site.bad/", 0)] * 5
    outcomes = spark.createDataFrame(outcomes, "url string, good int")
    urls = ["http://new.bad.example.net/x", "http://h1.bad.example.net/x", "http://new.good.example.net/x", "http://new.unseen.example.net/x", "http://new.site1.com/x", "http://a.b.unseen/x", "none", None]
    found = {r["url"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), outcomes).collect()}
    assert found == {u: "block" if u and "bad.example" in u else "allow" for u in urls}
    nothing = url_filter.judge(spark.createDataFrame([(urls[0],)], "url string"), outcomes.limit(0)).collect()
    assert nothing[0]["verdict"] == "allow"


def test_short_lines_count_on_demand(spark):
    rows = [(k, f"s{k}", f"All rights reserved.\nMore\n\nown {k}") for k in range(10)] + [(10, "s0", "seldom")]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, source string, text string"), least_words=1)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {k: f"\nown {k}" for k in range(10)} | {10: "seldom"}
