"""Every full licence text alone, and at the head of a file."""

from topicvote.llm import license_scan


def test_full_texts_alone_and_at_the_head(spark):
    full = [(name, text) for name, form, text in license_scan.KNOWN if form == "full"]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "BSD-3-Clause", "Unlicense", "MIT"} <= {n for n, _ in full}
    texts = [t for _, t in full] + [f"Copyright (c) 2020 Ann\n\n{t.strip()}\n\nimport os\n" for _, t in full]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    for i, (name, _) in enumerate(full):
        assert rows[i]["license"] == name
        head = rows[len(full) + i]
        assert head["license"] is None and name in head["licenses"].split(",") and head["n_notices"] >= 1
