"""Licences by the digest of a canonical text.

A text is made canonical: small letters, equivalent spellings, no copyright lines, signs to
blanks, single blanks. The digest of the result is looked up among those of known licences, for
the whole text, for every paragraph (blank lines between) and for every line. A licence of several
paragraphs is found inside a text too: where a paragraph is the first of a known licence, as many
paragraphs as that has are looked up together. Full texts are in the folder ``licenses``. Known texts go
through the same function, so punctuation, case, line breaks and years do not matter, while a
text with other words is not that licence.

The known digests are one row for each form of a licence and are broadcast; their number does not
depend on the documents. Texts are read once, what is written of them are digests. Null texts
and units without a letter match nothing.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicvote.llm.common import column
from topicvote.session import materialise

# Licence notices in common use, as (SPDX name, form, text).
KNOWN = (
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "This project is licensed under the MIT License."),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "full",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF '
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
        "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "notice", "Licensed under the BSD 2-Clause License."),
    (
        "ISC",
        "full",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        'copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
        "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)
# Full texts by SPDX name, and titles that some are headed with.
KNOWN += tuple((p.stem, "full", p.read_text()) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt")))
TITLES = (("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"))
TITLES += (("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"))
KNOWN += tuple(
    (name, "full", f"{title}\n\n{text}") for name, title in TITLES for n, form, text in KNOWN if (n, form) == (name, "full")
)
# Spellings that mean the same, as (pattern on small letters, replacement).
SPELLINGS = (
    ("licence", "license"),
    (r"\bv(?:\.|ersion)? ?([0-9])", "version $1"),
    (r"\bhttps?://(?:www\.)?", ""),
    (r"\bsub-license", "sublicense"),
    (r"\bnon-infringement", "noninfringement"),
    (r"©|\(c\)", "copyright"),
)
COPYRIGHT_LINE = r"(?m)^[^a-z0-9©(]*(?:copyright|©|\(c\))[^\n]*(?:[0-9]{4}|all rights reserved)[^\n]*$"
PARAGRAPHS = r"\n[\x20\t\r]*\n"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    for pattern, same in SPELLINGS:
        out = F.regexp_replace(out, pattern, same)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def known_licenses(spark: SparkSession, known=KNOWN) -> DataFrame:
    """digest, license, form; one row for each digest."""
    table = spark.createDataFrame(list(known), "license string, form string, text string")
    rows = table.select(F.xxhash64(canonical(F.col("text"))).alias("digest"), F.struct("license", "form").alias("of"))
    return rows.groupBy("digest").agg(F.min("of").alias("of")).select("digest", "of.*")


def first_paragraphs(spark: SparkSession, known=KNOWN) -> list[tuple[int, int]]:
    """(digest of the first paragraph, number of paragraphs) of known texts with more than one."""
    parts = F.filter(F.split("text", PARAGRAPHS), lambda t: canonical(t) != "")
    table = spark.createDataFrame([(text,) for _, _, text in known], "text string").select(parts.alias("p"))
    found = table.filter(F.size("p") > 1).select(F.xxhash64(canonical(F.col("p")[0])), F.size("p")).distinct()
    return sorted(tuple(r) for r in found.collect())


def units(text: Column, firsts: list[tuple[int, int]] = ()) -> Column:
    """(unit, digest) of the whole text, its paragraphs if it has more than one, its lines, and the
    paragraphs in a row that begin as a known text does (``first_paragraphs``)."""
    digest = lambda t: F.xxhash64(canonical(t))
    part = lambda name, parts: F.transform(
        parts, lambda t: F.struct(F.lit(name).alias("unit"), digest(t).alias("digest"))
    )
    many = lambda parts: F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
    found = [
        part("text", F.array(text)),
        part("paragraph", many(F.split(text, PARAGRAPHS))),
        part("line", many(F.split(text, "\n"))),
    ]
    if firsts:
        rows = F.array(*[F.struct(F.lit(d).cast("long").alias("d"), F.lit(n).alias("n")) for d, n in firsts])
        # a paragraph of signs or a copyright line alone is none
        full = F.filter(many(F.split(text, PARAGRAPHS)), lambda t: canonical(t) != "")
        known = F.array(*[F.lit(d).cast("long") for d in sorted({d for d, _ in firsts})])
        begins = F.exists(full, lambda t: F.array_contains(known, digest(t)))
        runs = F.flatten(
            F.transform(
                full,
                lambda t, i: F.transform(
                    F.filter(rows, lambda r: (r["d"] == digest(t)) & (i + r["n"] <= F.size(full))),
                    lambda r: F.array_join(F.slice(full, i + 1, r["n"]), "\n\n"),
                ),
            )
        )
        found.append(part("run", F.when(begins, runs).otherwise(F.array().cast("array<string>"))))
    return F.concat(*found)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", known=KNOWN) -> DataFrame:
    """doc_id, license (of the whole text, null if it is none), n_notices (units inside that are
    known) and licenses (their distinct names in order, comma-joined) of every row."""
    text = F.coalesce(column(docs, text_column), F.lit(""))
    table = F.broadcast(known_licenses(docs.sparkSession, known))
    firsts = first_paragraphs(docs.sparkSession, known)
    rows = materialise(
        docs.select(
            column(docs, id_column).alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            units(text, firsts).alias("units"),
        ),
        "units",
    )
    found = rows.select("row", F.explode("units").alias("u")).select("row", "u.*").join(table, "digest")
    inner = F.col("unit") != "text"
    by_row = found.groupBy("row").agg(
        F.max(F.when(~inner, F.col("license"))).alias("license"),
        F.count(F.when(inner, 1)).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    return rows.join(by_row, "row", "left").select(
        "doc_id",
        "license",
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
    )
