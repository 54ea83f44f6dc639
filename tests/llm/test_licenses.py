from wordloom.llm import licenses


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, license string")
    return [(r.license, r.n_notices, r.notices) for r in sorted(licenses.scan_licenses(docs).collect(), key=lambda r: r.doc_id)]


def test_entire_texts(spark):
    mit = dict(licenses.LICENSES)["MIT"]
    texts = [
        mit,
        "Copyright (c) 1999, 2003 Some One <a@b.c>\n© 2004 Two\nAll rights reserved.\n\n" + mit.upper(),
        "/* " + licenses.GRANT.replace("\n", "\n * ").replace("sublicense", "sublicence").replace('"', "“") + " */",
        mit + " or so",
        licenses.GRANT.replace("The above copyright notice and", "The above\ncopyright notice and"),  # not a copyright line
        "",
        None,
        "x" * 200_000,
    ]
    assert [x[0] for x in scan(spark, texts)] == ["MIT", "MIT", "MIT", None, "MIT", None, None, None]
    names = [name for name, _ in licenses.LICENSES]
    assert [x[0] for x in scan(spark, [t for _, t in licenses.LICENSES])] == names


def test_notices(spark):
    texts = [
        "a b c.\nReleased under the MIT Licence\nmore\n  RELEASED UNDER THE MIT LICENSE!\nLicensed under CC-BY-NC 4.0",
        "He said: Released under the MIT License. And left.",
        "Licensed under the Apache License, Version 2.0.",
    ]
    assert scan(spark, texts) == [(None, 3, "CC-BY-NC-4.0,MIT"), (None, 0, ""), (None, 1, "Apache-2.0")]


def test_empty_table(spark):
    assert scan(spark, []) == []


def test_planted_in_documents(spark):
    """Entire texts among the documents of a table, in other case, spelling and copyright lines; repeated and null rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    mit, bsd = dict(licenses.LICENSES)["MIT"], dict(licenses.LICENSES)["BSD-3-Clause"]
    planted = [(9001, "Copyright 2011 A. Person\n" + mit.title(), "MIT"), (9002, bsd.replace("copyright holder", "copyright owner"), "BSD-3-Clause"), (9002, bsd, "BSD-3-Clause"), (None, mit, "MIT"), (9003, None, None), (9004, "A story that quotes: " + mit, None)]
    both = docs.unionByName(spark.createDataFrame([(i, t) for i, t, _ in planted], "doc_id bigint, text string"))
    got = licenses.scan_licenses(both).collect()
    assert len(got) == both.count()
    found = sorted((str(r.doc_id), r.license) for r in got if r.license)
    assert found == sorted((str(i), want) for i, _, want in planted if want)
