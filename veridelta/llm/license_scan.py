r"""Licence scans by canonical digest lookup.

A text is brought to a canonical form: lower case, equivalent spellings made one, copyright lines
(with a sign or a year) and "all rights reserved" lines removed, everything that is neither letter nor digit made one
space. The digest of the canonical whole text, and of each canonical line, is joined to the
digests of known licences and licence notices, canonicalised in the same way. Whole texts or whole
lines are compared, never parts of them.

Null and empty texts, and those without a letter or digit, match nothing. Nulls in doc_id stay
null; repeated rows give repeated results; other columns are not read; an empty table gives an
empty table. Ties (two licences with one digest) go to the smallest licence id. DataFrame functions
only. The join's small side is the table of known licences, whose size the caller sets; beyond
``broadcast_rows`` rows it is joined by a shuffle.
"""

from __future__ import annotations

import re
from itertools import product
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short licence texts and notices: public standard wordings.
NOTICES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)

#: Title lines that stand above texts which have none of their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Where a text may begin, without its own title lines, and end, without advice on its use.
STARTS = ("TERMS AND CONDITIONS FOR USE", "CC0 1.0 Universal", "CREATIVE COMMONS CORPORATION IS", "Statement of Purpose", " Copyright (C) ", "1. Definitions")
ENDS = ("END OF TERMS AND CONDITIONS", "APPENDIX: How to apply", "How to Apply These Terms", "Exhibit A - Source Code Form", "EXHIBIT A -Mozilla")
#: Wordings that stand for one another: (licence, standard one, other one).
OTHER = (
    ("ISC", "modify, and/or distribute", "modify, and distribute"),
    ("BSD-2-Clause", "COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS"),
    ("BSD-3-Clause", "COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS"),
    ("BSD-2-Clause", "\n1. ", "\n* "),
    ("BSD-3-Clause", "\n1. ", "\n* "),
    *((f"{n}GPL-{v}", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301", "59 Temple Place, Suite 330, Boston, MA 02111-1307") for n, v in (("", "2.0"), ("L", "2.0"), ("L", "2.1"))),
)


def _forms(name: str, text: str) -> list[str]:
    """The usual forms of one whole text."""
    texts = [text]
    for licence, one, other in OTHER:
        if licence == name:
            if one == "\n1. ":
                texts += [t.replace(one, other).replace("\n2. ", other).replace("\n3. ", other) for t in texts]
            else:
                texts += [re.sub(r"\s+".join(map(re.escape, one.split())), other, t) for t in texts]
    out = []
    for t in texts:
        top = t[:3000]
        starts = [0, *(top.index(m) for m in STARTS if name not in TITLES and m in top)]
        ends = [len(t), *(t.rindex(m) for m in ENDS if m in t), *(t.rindex(m) + len(m) for m in ENDS[:1] if m in t)]
        out += [t[a:b] for a, b in product(starts, ends)]
        out += [f"{title}\n{t}" for title in TITLES.get(name, ())]
    return out


def _known():
    files = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    whole = [(p.stem, p.read_text(encoding="utf-8")) for p in files] + [(n, t) for n, t in NOTICES if len(t) > 500]
    return NOTICES + tuple(dict.fromkeys((n, form) for n, t in whole for form in _forms(n, t)))


#: Known licence texts, in their usual forms, and notices.
KNOWN = _known()

#: Equivalent spellings: pattern -> the one that stays. Words of canonical text, between spaces.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("noncommercial", "non commercial"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("favour", "favor"), ("https", "http"))

# "copyright" begins many lines of wrapped licence texts: only with a sign or year (or the place for
# one) after it is a line a notice.
_YEAR = r"(\b(19|20)(\d\d|yy)\b|\byyyy\b|[\[<{(]year\b)"
_NOTICE = rf"^\s*((copyright\b.*(\(c\)|©|{_YEAR})|©|\(c\)\s*(copyright\b|{_YEAR})).*|all rights reserved\W*)$"


def _canonical_line(line):
    """Canonical form of one line; copyright lines become empty."""
    low = F.lower(line)
    text = F.when(F.regexp_like(low, F.lit(_NOTICE)), F.lit("")).otherwise(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    text = F.concat(F.lit(" "), F.trim(text), F.lit(" "))
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(text)


def _lines(text):
    return F.filter(F.transform(F.split(text, r"\n|\r"), _canonical_line), lambda x: x != "")


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """digest, license."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    whole = F.array_join(_lines(F.col("text")), " ")
    return rows.select("license", whole.alias("t")).where("t <> ''").groupBy(F.sha2("t", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, text_license (of the whole text), line_licenses (of its lines, sorted, joined by
    ','), n_license_lines; one row for each row of docs."""
    known = known_digests(docs.sparkSession) if known is None else known
    if known.limit(broadcast_rows + 1).count() <= broadcast_rows:
        known = F.broadcast(known)
    rows = docs.select("doc_id", _lines(F.col("text")).alias("lines")).withColumn("row", F.monotonically_increasing_id())
    whole = F.sha2(F.array_join("lines", " "), 256)
    # The whole text is entry 0, each line another: one lookup for all of them.
    entries = F.when(F.size("lines") > 0, F.concat(F.array(whole), F.transform("lines", lambda x: F.sha2(x, 256))))
    found = rows.select("row", "doc_id", F.posexplode_outer(entries).alias("at", "digest")).join(known, "digest", "left")
    is_line = (F.col("at") > 0) & F.col("license").isNotNull()
    out = found.groupBy("row", "doc_id").agg(
        F.min(F.when(F.col("at") == 0, F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_line, F.col("license")))), ",").alias("line_licenses"),
        F.count_if(is_line).alias("n_license_lines"),
    )
    return out.drop("row")
