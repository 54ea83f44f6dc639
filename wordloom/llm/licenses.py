"""License scans: canonical digest lookup. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import table

# Spellings that count as one (SPDX matching guidelines), published license texts and common notices.
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("whilst", "while"),
    ("analogue", "analog"),
    ("fulfilment", "fulfillment"),
    ("noncommercial", "non-commercial"),
    ("sub-license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("https://", "http://"),
    ("&", " and "),
)
GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
LICENSES = (
    ("MIT", GRANT),
    ("MIT", "MIT License\n\n" + GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + GRANT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + ISC_TAIL),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_NAMES + BSD_TAIL),
)
#: Canonical digests of longer published texts: entire, and up to the end of their terms where an appendix follows;
#: OFL-1.1 with its preamble for a font, and without.
LICENSE_DIGESTS = (
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "3842a16357f0cdd1e23bb92ec7360a85dcebc4d690aa011625db0b4c951608b1"),
    ("GFDL-1.3", "af67fd0f1a174a4bcb2f40070ab1d7b5e3519fd4e36fa89113923de9a4638f52"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-1.0", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-2.0", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),
    ("GPL-3.0", "3c39b58d51baf32b2a21a55c429305f51cfd82e53cad05134293933580b4cd84"),
    ("GPL-3.0", "57f71ba95bda9ddb21fcd4d2b6841fdc3ef7fcebd5c12a2fd2ee5f2027869fc6"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
    ("OFL-1.1", "4615ce90e68a37caa849efa2e5beeb913cb450de4039cbf2dfa1a3ed53b83a09"),
    ("OFL-1.1", "95e31f8a9723c2605049fb76e743be71bd9d186ee6ebd18c3951a263cb15efb3"),
)
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

#: A line that only says who holds the copyright: the word or sign, then a sign, a year or a place for one.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©(]*(?:copyright|©|\(c\))[ \t]*(?:\(c\)|©|[0-9]{4}|<|\[|by )[^\n]*$"
RESERVED_LINE = r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
OTHER_MARKS = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Lower case, one spelling, no copyright lines, every run of other characters one blank; line ends stay."""
    text = F.lower(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, ""), RESERVED_LINE, "")
    for other, usual in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(usual))
    return F.regexp_replace(text, OTHER_MARKS, " ")


def whole(lines: Column) -> Column:
    """A canonical text on one line."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_table(spark: SparkSession, known=LICENSES, digests=()) -> DataFrame:
    """(digest, license) of (license, text) pairs and (license, digest) pairs; texts that are alike once canonical count
    once, for the least name."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(text).alias("text")) for name, text in known])).alias("r")
    table_ = spark.range(1).select(rows).select(digest(whole(canonical_lines(F.col("r.text")))).alias("digest"), F.col("r.name").alias("name"))
    if digests:
        table_ = table_.unionByName(spark.createDataFrame(list(digests), "name string, digest string"))
    return table_.groupBy("digest").agg(F.min("name").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, notices=NOTICES) -> DataFrame:
    """One row per row of `docs`: doc_id, canonical_sha256, license (of the entire text, else null), n_notices, notices.

    `known` (digest, license: known_table) is broadcast: it is as long as the list of licenses it was made of and
    doesn't grow with the documents. notices are the licenses, in order and once each, that lines of the text name
    in the words of a known notice; n_notices is the number of such lines. A null text is empty. Nothing is
    shuffled, so repeated rows, null ids, hot sources and long texts are like any others; other columns are ignored.
    """
    known = known_table(docs.sparkSession, LICENSES, LICENSE_DIGESTS) if known is None else known
    lookup = F.create_map(*[x for name, text in notices for x in (digest(whole(canonical_lines(F.lit(text)))), F.lit(name))])
    canon = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    found = canon.select(
        "doc_id",
        digest(whole(F.col("lines"))).alias("canonical_sha256"),
        F.filter(F.transform(F.split("lines", "\n"), lambda line: F.try_element_at(lookup, digest(F.trim(line)))), lambda x: x.isNotNull()).alias("named"),
    )
    joined = found.join(F.broadcast(known), found["canonical_sha256"] == known["digest"], "left")
    return joined.select("doc_id", "canonical_sha256", "license", F.size("named").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("named")), ",").alias("notices"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    text = f"lower(coalesce({text}, ''))"
    for pattern in (COPYRIGHT_LINE, RESERVED_LINE):
        text = f"regexp_replace({text}, {_sql_text(pattern)}, '', 'g')"
    for other, usual in SPELLINGS:
        text = f"replace({text}, {_sql_text(other)}, {_sql_text(usual)})"
    return f"regexp_replace({text}, {_sql_text(OTHER_MARKS)}, ' ', 'g')"


def _sql_pairs(pairs) -> str:
    return ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, text in pairs)


OP10_SQL = f"""
WITH known AS (
  SELECT digest, min(name) AS license FROM (
    SELECT sha256(trim(regexp_replace({_sql_lines("text")}, '[ \\n]+', ' ', 'g'))) AS digest, name FROM (VALUES {_sql_pairs(LICENSES)}) AS v(name, text)
    UNION ALL SELECT digest, name FROM (VALUES {_sql_pairs(LICENSE_DIGESTS)}) AS d(name, digest)
  ) GROUP BY digest
), notice AS (
  SELECT trim(regexp_replace({_sql_lines("text")}, '[ \\n]+', ' ', 'g')) AS line, name FROM (VALUES {_sql_pairs(NOTICES)}) AS v(name, text)
), canon AS (
  SELECT doc_id, {_sql_lines("text")} AS lines FROM documents
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names
  FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM canon) l JOIN notice ON trim(l.line) = notice.line GROUP BY doc_id
), done AS (
  SELECT doc_id, sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'))) AS canonical_sha256 FROM canon
)
SELECT done.doc_id, canonical_sha256, license, coalesce(n, 0) AS n_notices, coalesce(names, '') AS notices
FROM done LEFT JOIN known ON canonical_sha256 = digest LEFT JOIN named ON done.doc_id = named.doc_id
"""
