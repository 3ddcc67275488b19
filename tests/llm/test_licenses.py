import hashlib
from pathlib import Path

import duckdb

from sparkloom.llm import licenses as L


def rows():
    mit = L.KNOWN["MIT"]
    texts = [
        mit, "Copyright (c) 2024 Somebody\n\n" + mit.upper(), mit.replace("\n", "\n\n  * "), mit + "\nand more", "prose\nLicensed under the Apache Licence -- version 2.0\nmore",
        "Released under the MIT License.", "Released under the MIT License.\nReleased under the MIT License.\n", None, "", "\n \n", "©", "Permission is granted", "É" * 50_000 + "\nLicensed under CC BY-NC 4.0.",
        "Copyright 2020 X. Released under the MIT License.",
    ]
    texts += ["MIT License\n\nCopyright (c) 2021 A\n\n" + mit, "BSD 2-Clause License\n\nCopyright (c) 2020, B\nAll rights reserved.\n\n" + L.KNOWN["BSD-2-Clause"], "ISC License\n" + L.KNOWN["ISC"], L.KNOWN["BSD-3-Clause"]]
    texts += [L.KNOWN["Unlicense"], L.KNOWN["BSD-3-Clause (Regents)"], "A readme of something.\n\n## License\n\nCopyright (c) 2020 B\n\n" + mit + "\n\nMore words.\n" + L.KNOWN["ISC"] + "\n\n" + mit.replace("\n", "\n\n")]
    texts += ["# header\n# " + L.KNOWN["BSD-2-Clause"].replace("\n", "\n# ") + "\nimport os\n" * 300]
    texts += ["before\n" + p.read_text() + "\nafter\nit" for p in (Path("/usr/share/common-licenses") / n for n in ("Apache-2.0", "GPL-2")) if p.exists()]
    texts += [p.read_text() for p in (Path("/usr/share/common-licenses") / n for n in ("Apache-2.0", "GPL-3", "MPL-2.0")) if p.exists()]
    return [(i, t) for i, t in enumerate(texts)] + [(None, mit), (3, "All rights reserved"), (3, "All rights reserved")]


def brute(data):
    table = {d: n for n, d, _ in L.all_known()}
    out, sizes = [], {n for *_, n in L.all_known()}
    for d, t in data:
        lines = L.canonical_lines(t or "")
        at = [0]
        for x in lines:
            at.append(at[-1] + len(x) + 1)
        runs = [("lines", i + 1, " ".join(lines[i:j])) for i in range(len(lines)) for j in range(i + 2, len(lines) + 1) if j - i < len(lines) and at[j] - at[i] - 1 in sizes]
        for scope, unit, body in [*runs, ("document", 0, " ".join([x for x in lines if x not in L.TITLES] or lines)), *(("line", i + 1, x) for i, x in enumerate(lines))]:
            if len(body) not in sizes:
                continue
            digest = hashlib.sha256(body.encode()).hexdigest()
            if digest in table and body:
                out.append((d, scope, unit, table[digest], digest))
    return sorted(out, key=str)


def test_against_plain_python_and_sql(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, license string, unit int")
    got = sorted((tuple(r) for r in L.license_scan(df).collect()), key=str)
    assert got == brute(data)
    assert {(g[0], g[1], g[3]) for g in got} >= {(0, "document", "MIT"), (1, "document", "MIT"), (4, "line", "Apache-2.0 (notice)"), (12, "line", "CC-BY-NC-4.0 (notice)"), (None, "document", "MIT")}
    assert {(g[0], g[1], g[3]) for g in got} >= {(14, "document", "MIT"), (15, "document", "BSD-2-Clause"), (16, "document", "ISC"), (17, "document", "BSD-3-Clause")}
    assert {(g[1], g[2], g[3]) for g in got if g[0] == 20} >= {("lines", 3, "MIT"), ("lines", 7, "ISC"), ("lines", 9, "MIT")} and (21, "lines", 2, "BSD-2-Clause") in {g[:4] for g in got}
    assert {(g[0], g[3]) for g in got if g[1] == "document"} >= {(18, "Unlicense"), (19, "BSD-3-Clause (Regents)")}
    if Path("/usr/share/common-licenses/GPL-3").exists():
        assert {g[3] for g in got if g[1] == "lines"} >= {"Apache-2.0", "GPL-2.0"}
        assert {g[3] for g in got if g[1] == "document"} >= {"Apache-2.0", "GPL-3.0", "MPL-2.0"}
    c = duckdb.connect()
    c.execute("create table documents(doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", data)
    assert sorted(c.execute(L.oracle()).fetchall(), key=str) == got


def test_empty(spark):
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_published_digests_are_those_of_the_published_texts():
    """Of the texts that this machine has: each is known under its name."""
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    for file, name in names.items():
        if (p := Path("/usr/share/common-licenses") / file).exists():
            form = L.whole_form(L.canonical_lines(p.read_text()))
            assert L.PUBLISHED[name] == (len(form), hashlib.sha256(form.encode()).hexdigest()), file
