"""License lines of the corpus and whole license texts."""

import pytest
from pyspark.sql import functions as F

from turnstone.llm import licenses

#: The five license lines of documents.
LINES = {
    "MIT-notice": "Released under the MIT License.", "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0", "GPL-3.0-notice": "GNU General Public License, version 3",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0", "All-rights-reserved-notice": "All rights reserved.",
}


def test_every_license_line_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = licenses.scanned(docs).filter("license is not null").collect()
    for name, line in LINES.items():
        want = {r["doc_id"] for r in docs.filter(F.col("text").contains(line)).collect()}
        assert want and {r["doc_id"] for r in rows if r["license"] == name} >= want, name


@pytest.mark.parametrize("name", ["MIT-text", "Apache-2.0-header", "BSD-2-Clause-text", "BSD-3-Clause-text", "ISC-text"])
def test_whole_texts_are_covered_to_their_end(name):
    text = "Words before it. " + licenses.TEMPLATES[name] + " Words after it."
    found = {f[0]: f for f in licenses.scan(text, *licenses.index_of(licenses.TEMPLATES))}
    assert found[name][1] == 1.0 and text[found[name][2] :].startswith(licenses.TEMPLATES[name][:20]) and text[found[name][3] :].lstrip('."') == " Words after it."


def test_families_are_told_apart():
    index = licenses.index_of(licenses.TEMPLATES)
    for name in ("GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0-notice", "Unlicense"):
        best = max(licenses.scan(licenses.TEMPLATES[name], *index), key=lambda f: f[1])
        assert best[:2] == (name, 1.0)


def test_whole_texts_are_covered_to_their_ends():
    tokens, index = licenses.index_of(licenses.TEMPLATES)
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"):
        text = licenses.TEMPLATES[f"{name}-text"]
        text = text.strip()
        found = licenses.scan(f"Some words before it. {text} Some words after it.", tokens, index)
        assert [(x[0], x[1]) for x in found] == [(f"{name}-text", 1.0)], name
        assert found[0][2] < 25 and found[0][3] > len(text) + 15


def test_drift_beyond_the_band():
    tokens, index = licenses.index_of(licenses.TEMPLATES)
    w = licenses.TEMPLATES["BSD-2-Clause-text"].split()
    text = " ".join([*w[:60], *["extra"] * (licenses.BAND + 4), *w[60:]])
    assert [(x[0], x[1]) for x in licenses.scan(text, tokens, index)] == [("BSD-2-Clause-text", 1.0)]
