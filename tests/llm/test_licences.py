import hashlib
import re
import subprocess
import sys
import textwrap
import zipfile
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from corvane.llm import licences as L
from corvane.llm import queries
from tests.llm import fixtures as fx


def form(text, whole=False):
    lines = [x for x in (text or "").lower().split("\n") if whole or not re.search(queries._COPYRIGHT_LINE, x)]
    words = re.sub(r"[\W_]+", " ", " ".join(lines)).strip()
    words = f" {words} "
    for old, new in L.SPELLINGS.items():
        words = words.replace(f" {old} ", f" {new} ")
    return words.strip(" ")


def expected(docs):
    known = {hashlib.sha256(form(t).encode()).hexdigest(): i for i, t in reversed(L.KNOWN)}
    sha = lambda t: hashlib.sha256(form(t).encode()).hexdigest()
    out = []
    for r in docs:
        lines = [known[d] for d in map(sha, (r.text or "").split("\n")) if d in known]
        out.append((r.doc_id, hashlib.sha256(form(r.text, True).encode()).hexdigest(), known.get(sha(r.text)), sorted(set(lines)), len(lines)))
    return sorted(out, key=repr)


def variants():
    mit = next(t for i, t in L.KNOWN if i == "MIT")
    changed = mit.replace("Copyright (c) <year> <copyright holders>", "  * Copyright (C) 2019-2024 A. N. Other\n© Someone\nAll rights reserved.")
    changed = changed.replace("sublicense", "sublicence").replace('"Software"', "“Software”").replace("\n\n", "\r\n \r\n").upper()
    texts = [mit, changed, mit + " more", "Some text.\nreleased under the MIT licence\nLICENSED UNDER CC BY-NC 4.0!\nLicensed under CC BY-NC 4.0.", "Copyright 2020 x"]
    return [(100 + i, t, "en", "s", 0) for i, t in enumerate(texts)]


def test_variants_and_awkward_rows(spark):
    docs = fx.awkward_docs(spark, variants())
    for df in (docs, fx.clashing(docs)):
        assert fx.rows(L.scan(df)) == expected(docs.collect())
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    assert got[100].licence == got[101].licence == "MIT" and got[102].licence is None
    assert got[103].notices == ["CC-BY-NC-4.0", "MIT"] and got[103].n_notices == 3
    assert got[104].licence is None and L.scan(docs.limit(0)).collect() == []


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert fx.rows(L.scan(docs)) == expected(docs.collect())


def test_known_texts_differ(spark):
    assert L.known_digests(spark).count() == len(L.KNOWN)
    assert spark.range(1).select(L.digest(F.lit(None).cast("string"))).first()[0] == hashlib.sha256(b"").hexdigest()


def test_whole_texts_and_wordings(spark):
    folder = "/usr/share/common-licenses/"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    texts = [(open(folder + f).read(), i) for f, i in files.items()]
    lines = {
        "This project is licensed under the MIT license.": "MIT", "# SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "Released under the BSD 3-Clause License": "BSD-3-Clause",
        '   Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
    }
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate([t for t, _ in texts] + ["x\n" + x for x in lines])], fx.DOCS)
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    assert [got[k].licence for k in range(len(texts))] == [i for _, i in texts]
    assert [got[len(texts) + k].notices for k in range(len(lines))] == [[i] for i in lines.values()]


def test_text_behind_a_notice(spark):
    mit = L.KNOWN[0][1].replace("<year> <copyright holders>", "2020 A. N. Other, Inc.")
    bare = mit.split("\n\n", 1)[1]
    wrapped = lambda n: "\n".join(textwrap.wrap(bare.split("\n\n", 1)[1], n))
    texts = [" ".join(mit.split()), " ".join(bare.split()), *("Copyright (c) 2020 X\n\n" + wrapped(n) for n in range(40, 121)), bare.replace("Inc.", "Inc. All rights reserved.")]
    texts += ["Copyright 2021 A. Licensed under CC BY-NC 4.0.", "x\n(c) 2019 Foo Ltd. Released under the MIT License."]
    texts += ["Copyright 2020 Jane Doe. Selling is not allowed.\n" + bare, "Copyright licence terms forbid sale.\n" + bare]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], fx.DOCS)
    got = [r for r in L.scan(docs).orderBy("doc_id").collect()]
    assert [r.licence for r in got[:-4]] == ["MIT"] * (len(texts) - 4)
    assert [r.notices for r in got[-4:-2]] == [["CC-BY-NC-4.0"], ["MIT"]]
    assert [r.licence for r in got[-2:]] == [None, None]


def test_marks(spark):
    pattern = L.marks(L.KNOWN)
    assert pattern.count("|") < 20 and all(re.search(pattern, t.lower()) for _, t in L.KNOWN)
    assert L.marks((("X", "Copyright only"),)) == "" and re.search(L.marks((("X", "Organization law"),)), "organisation law")
    docs = spark.createDataFrame([(1, "Copyright only", "en", "s", 0), (2, "x\nthe organisation's law", "en", "s", 0)], fx.DOCS)
    got = {r.doc_id: r for r in L.scan(docs, (("A", "the organization s law"), ("B", "copyright only"))).collect()}
    assert got[2].notices == ["A"] and got[1].notices == ["B"]


def apache():
    return open("/usr/share/common-licenses/Apache-2.0").read()


def variants_of_whole_texts():
    """(text, licence): whole licences as projects ship them."""
    bsd = next(t for i, t in L.KNOWN if i == "BSD-3-Clause" and "copyright holder" in t)
    named = bsd.replace("the copyright holder nor", "Example Systems, Inc. nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "EXAMPLE SYSTEMS AND CONTRIBUTORS")
    named = named.replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "EXAMPLE SYSTEMS")
    assert named.count("xample") + named.count("EXAMPLE") >= 3
    gpl = open("/usr/share/common-licenses/GPL-2").read()
    end = "END OF TERMS AND CONDITIONS"
    out = [(apache(), "Apache-2.0"), (apache().split(end)[0], "Apache-2.0"), (apache().split(end)[0] + end + "\n", "Apache-2.0"), (gpl.split(end)[0] + end, "GPL-2.0-only")]
    out += [(named, "BSD-3-Clause"), (L._read("Unlicense"), "Unlicense"), ("Copyright (c) 2020 A\n\n" + L._read("Zlib"), "Zlib"), (L._read("BSL-1.0").upper(), "BSL-1.0")]
    return out


def test_variants_of_whole_texts(spark):
    bare = next(t for i, t in L.KNOWN if i == "MIT").split("\n\n", 2)[2]
    mit = [f"MIT License\n\n{notice}\n\n{bare}" for notice in ("Copyright (c) 2020 Jane Doe,\n  John Roe", "Copyright (c) 2020 Jane Doe\nand contributors", "Copyright 2020 Foo &\nBar", "(c) 2019 A, B and\n   others\nCopyright 2021 C")]
    more = [f"MIT License\n\n{notice}\n\n{bare}" for notice in ("Copyright (c) 2020 Jane Doe\nSelling is not allowed", "Copyright 2020 X.\nCommercial use needs consent")]
    known = variants_of_whole_texts() + [(t, "MIT") for t in mit] + [(t, None) for t in more]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, (t, _) in enumerate(known)], fx.DOCS)
    got = {r.doc_id: r.licence for r in L.scan(docs).collect()}
    assert [got[k] for k in range(len(known))] == [i for _, i in known]


def test_query_finds_planted_texts(spark, tmp_path):
    """The registered query and its SQL on documents some of which are whole licences."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = variants_of_whole_texts()
    planted = spark.createDataFrame([(10**6 + k, t, "en", "s", len(t)) for k, (t, _) in enumerate(known)], fx.DOCS)
    docs.unionByName(planted).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op9_licence_digests"](spark, str(tmp_path))
    assert {r.doc_id - 10**6: r.licence for r in got.where("licence is not null").collect()} == {k: i for k, (_, i) in enumerate(known)}
    duckdb.sql(f"create or replace temp view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(queries.SQL["op9_licence_digests"])
    assert fx.rows(got.select(*want.columns)) == sorted(want.fetchall(), key=repr)


def test_package_in_an_archive(tmp_path):
    """Licence texts are found in a package that is shipped as a zip file."""
    root = Path(L.__file__).resolve().parents[2]
    with zipfile.ZipFile(tmp_path / "corvane.zip", "w") as z:
        for f in (root / "corvane").rglob("*"):
            if f.is_file() and "__pycache__" not in f.parts:
                z.write(f, f.relative_to(root))
    code = f"import sys; sys.path.insert(0, {str(tmp_path / 'corvane.zip')!r}); from corvane.llm import licences; print(licences.__file__, len(licences.KNOWN))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    assert done.returncode == 0 and "corvane.zip" in done.stdout and done.stdout.split()[-1] == str(len(L.KNOWN)), done.stderr
