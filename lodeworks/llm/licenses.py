"""Licence scans by canonical digests.

A text, or one of its blocks or lines, is brought to a canonical form: lower case, equivalent spellings made
one, copyright lines left out, punctuation and white space reduced to single spaces. Its SHA-256 is then looked
up among the digests of known licences by a hash join. Nothing is matched in part: a unit is a licence's whole
text or it isn't.

Each line is cut into words once; the forms of blocks and of the whole text are put together from those of their
lines. The known texts are few and fixed (KNOWN, MORE, WHOLE), so their table is broadcast; callers can pass a table
of their own, which is broadcast only up to BROADCAST_ROWS.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from . import shared
from .text import free_name, whole

BROADCAST_ROWS = 100_000

#: Spellings that licence matching treats as equal (the left becomes the right).
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"),
    ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("centre", "center"), ("cancelled", "canceled"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("maximise", "maximize"), ("modelled", "modeled"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("noncommercial", "non commercial"), ("https", "http"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("per cent", "percent"), ("v2", "version 2"), ("v3", "version 3"),
)

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."

#: Fixed values: (licence, class, text), whole licences first, then whole notices.
KNOWN = (
    ("MIT", "permissive", f"MIT License\n{_GRANT}\n{_NOTICE}\n{_AS_IS}"),
    ("MIT", "permissive", f"{_GRANT}\n{_NOTICE}\n{_AS_IS}"),
    ("ISC", "permissive", f"ISC License\n{_ISC}\n{_ISC_AS_IS}"),
    ("ISC", "permissive", f"{_ISC}\n{_ISC_AS_IS}"),
    ("Apache-2.0", "permissive", _APACHE),
    ("GPL-3.0", "copyleft", _GPL),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MIT", "permissive", "This project is licensed under the MIT License."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "Released under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "permissive", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "permissive", "Licensed under the BSD 2-Clause License."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "noderivatives", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "noncommercial", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "public-domain", "Released under CC0 1.0."),
    ("Unlicense", "public-domain", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "proprietary", "All rights reserved."),
)

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_FREE = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."

#: More whole licences and headers, as KNOWN.
MORE = (
    ("BSD-2-Clause", "permissive", f"{_BSD}\n{_BSD_AS_IS}"),
    ("BSD-2-Clause", "permissive", f"BSD 2-Clause License\n{_BSD}\n{_BSD_AS_IS}"),
    ("BSD-3-Clause", "permissive", f"{_BSD}\n{_BSD_NAME}\n{_BSD_AS_IS}"),
    ("BSD-3-Clause", "permissive", f"BSD 3-Clause License\n{_BSD}\n{_BSD_NAME}\n{_BSD_AS_IS}"),
    ("GPL-2.0", "copyleft", _FREE.format("program", ";", "General Public License", ";", "2")),
    ("LGPL-2.1", "copyleft", _FREE.format("library", ";", "Lesser General Public License", ";", "2.1")),
    ("LGPL-3.0", "copyleft", _FREE.format("library", ":", "Lesser General Public License", ",", "3")),
    ("LGPL-3.0", "copyleft", _FREE.format("program", ":", "Lesser General Public License", ",", "3")),
    ("AGPL-3.0", "copyleft", _FREE.format("program", ":", "Affero General Public License", ",", "3")),
)

#: Fixed values: (licence, class, digest of the canonical form of the whole licence as Debian ships it).
WHOLE = (
    ("Apache-2.0", "permissive", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", "permissive", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),  # terms alone
    ("Artistic-1.0-Perl", "permissive", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("BSD-3-Clause", "permissive", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "public-domain", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "copyleft", "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e"),
    ("GFDL-1.3", "copyleft", "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff"),
    ("GPL-1.0", "copyleft", "ecede0ce378cc2fefec4431f4cf508af5338dc8a3e44b5c5a3a7867070db5798"),
    ("GPL-1.0", "copyleft", "6c07dfb5e6ddc39fe93ae803d39b67367c21b50207b645111c04cd08cb283d70"),  # terms alone
    ("GPL-2.0", "copyleft", "c9150a998ddbe45123303bf71d093beee4baf803b1eaea84b34fd41189285f1f"),
    ("GPL-2.0", "copyleft", "f79b9e516923cc213c21d12fd8a51b4067992b2728a442e31fd53d078dd25632"),  # terms alone
    ("GPL-3.0", "copyleft", "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8"),
    ("GPL-3.0", "copyleft", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b"),  # terms alone
    ("LGPL-2.0", "copyleft", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.0", "copyleft", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),  # terms alone
    ("LGPL-2.1", "copyleft", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-2.1", "copyleft", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),  # terms alone
    ("LGPL-3.0", "copyleft", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "copyleft", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "copyleft", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)

#: A line, in lower case, that only says whose the text is; and what belongs to it on the lines below.
COPYRIGHT_LINE = r"[^a-z0-9\n]*(?:(?:copyright|\(c\)|©)[^\n]*[0-9]{4}|copyright[ \t]*(?:\(c\)|©)|©)[^\n]*"
RESERVED = "all rights reserved"

_COPYRIGHT = re.compile(COPYRIGHT_LINE.encode())
_EMPTY_LINE = re.compile(rb"[ \t]*\r?")
_ONE_WORD = {a.encode(): b.encode() for a, b in EQUIVALENT if " " not in a}
_TWO_WORDS = {a.encode(): b.encode() for a, b in EQUIVALENT if " " in a}
_PAIRS = re.compile(rb"(?<![a-z0-9])(?:" + b"|".join(sorted(_TWO_WORDS, reverse=True)) + rb")(?![a-z0-9])")
#: Bytes of text to those of canonical forms: letters in lower case, line ends, and spaces for all else.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b == 10 else 32 for b in range(256))


def _joined(lines: list[bytes]) -> bytes:
    form = b" ".join([x for x in lines if x])
    # A spelling of two words may cross a line end.
    return _PAIRS.sub(lambda m: _TWO_WORDS[m[0]], form) if any(x in form for x in _TWO_WORDS) else form


def forms(text: bytes) -> tuple[bytes, set[bytes]]:
    """The canonical forms of a whole text in UTF-8, and of its blocks (between empty lines) and lines; the empty
    form, and the forms of one line or block that is all of the text, are not among those."""
    same = _ONE_WORD
    lines = []
    for line in text.translate(_PLAIN).split(b"\n"):
        words = line.split()
        if not same.keys().isdisjoint(words):
            words = [same.get(w, w) for w in words]
        lines.append(b" ".join(words))
    raw = text.split(b"\n")
    kept, own = lines, lines
    low = text.lower()
    if b"copyright" in low or b"(c)" in low or b"\xc2\xa9" in low:
        kept, own, after = list(lines), list(lines), False
        for i, line in enumerate(low.split(b"\n")):
            if _COPYRIGHT.match(line):
                kept[i], own[i], after = b"", b"", True
            elif after and lines[i] == RESERVED.encode():
                kept[i] = b""
            else:
                after = False
    parts: set[bytes] = set()
    if len(lines) > 1:
        parts.update(_joined([x]) for x in set(own))
        starts = [i for i in range(1, len(raw) - 1) if not lines[i] and _EMPTY_LINE.fullmatch(raw[i])]
        if starts:
            parts.update(_joined(kept[a + 1 : b]) for a, b in zip([-1, *starts], [*starts, len(kept)], strict=True))
    parts.discard(b"")
    return _joined(kept), parts


def canonical(text: str) -> str:
    """The canonical form of a whole text; empty if nothing is left."""
    return forms(text.encode("utf-8", "surrogatepass"))[0].decode()


def digest_of(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license, class) of KNOWN, MORE and WHOLE; a digest once."""
    rows = {digest_of(text): (name, kind) for name, kind, text in reversed((*KNOWN, *MORE))}
    rows |= {digest: (name, kind) for name, kind, digest in WHOLE}
    return spark.createDataFrame([(d, *v) for d, v in rows.items()], "digest string, license string, class string")


def _digests(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in batches:
            wholes, parts = [], []
            for value in batch.column(text):
                form, more = forms(value.as_buffer().to_pybytes())
                wholes.append(sha(form).digest())
                parts.append([sha(x).digest() for x in more])
            keep = [c for c in batch.schema.names if c != text]
            new = [pa.array(wholes, pa.binary()), pa.array(parts, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, "whole", "parts"])

    return run


#: Classes that forbid commercial use or copying, and that which does so only where no licence grants it.
FORBIDDING, RESERVING = ("noncommercial", "noderivatives"), "proprietary"


def scan(df: DataFrame, text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """df without its text, with whole_license (of all of the text, or null), licenses and classes (sorted,
    distinct, of any unit), and permitted: whether no class found forbids commercial use or copying. A reservation
    of all rights forbids it only where no licence is found.

    A null or empty text has none and is permitted. Repeated rows are scanned alike; columns of df with the names
    of results are replaced, all others stay. An empty df gives no rows.
    """
    spark = df.sparkSession
    df = df.drop("whole_license", "licenses", "classes", "permitted")
    known = known_digests(spark) if known is None else known
    known = known.select(F.unhex("digest").alias("digest"), "license", "class")
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # Other columns travel as one, so that no name of theirs meets ours.
    others = F.struct(*[c for c in df.columns if c != text]) if len(df.columns) > 1 else F.struct(F.lit(0))
    rows = df.select(F.monotonically_increasing_id().alias("row"), others.alias("doc"), whole(text).alias("text"))
    kind = StructType([*rows.drop("text").schema.fields, StructField("whole", BinaryType()), StructField("parts", ArrayType(BinaryType()))])
    base = shared.written(rows.mapInArrow(_digests("text"), kind), "license-units")
    unit = lambda column, is_text: F.struct(F.col(column).alias("digest"), F.lit(is_text).alias("is_text"))
    units = F.concat(F.array(unit("whole", True)), F.transform("parts", lambda x: F.struct(x.alias("digest"), F.lit(False).alias("is_text"))))
    each = base.select("row", F.explode(units).alias("u")).select("row", "u.digest", "u.is_text")
    hits = each.join(F.broadcast(known) if small else known, "digest")
    found = hits.groupBy("row").agg(F.max(F.when(F.col("is_text"), F.col("license"))).alias("whole_license"), F.sort_array(F.collect_set("license")).alias("licenses"), F.sort_array(F.collect_set("class")).alias("classes"))
    out = base.select("row", "doc").join(found, "row", "left")
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("licenses", "classes")}
    forbidden = F.arrays_overlap(lists["classes"], F.array(*map(F.lit, FORBIDDING))) | (F.array_contains(lists["classes"], RESERVING) & (F.size(lists["classes"]) == 1))
    own = [F.col("doc")[c].alias(c) for c in df.columns if c != text]
    return out.select(*own, "whole_license", lists["licenses"].alias("licenses"), lists["classes"].alias("classes"), (~forbidden).alias("permitted"))


def query(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "whole_license", F.concat_ws(",", "licenses").alias("licenses"), F.concat_ws(",", "classes").alias("classes"), "permitted")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_RESERVED = r"(?:\n[^a-z0-9\n]*" + r"[^a-z0-9\n]+".join(RESERVED.split()) + r"[^a-z0-9\n]*$)*"


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), '(?m)^{COPYRIGHT_LINE}${_SQL_RESERVED}', '', 'g')"
    out = f"' ' || regexp_replace({out}, '[^a-z0-9]+', '  ', 'g') || ' '"
    for old, new in EQUIVALENT:
        out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = f"""
WITH raw(license, class, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)}, {_quoted(c)})" for a, b, c in (*KNOWN, *MORE))}),
k AS (SELECT digest, min(license) AS license, min(class) AS class FROM (
      SELECT sha256({_sql_canonical("text")}) AS digest, license, class FROM raw
      UNION ALL SELECT digest, license, class FROM (VALUES {", ".join(f"('{d}', '{a}', '{b}')" for a, b, d in WHOLE)}) AS w(license, class, digest)) GROUP BY digest),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, 'text' AS unit, text AS body FROM d
      UNION ALL SELECT doc_id, 'block', unnest(regexp_split_to_array(text, '\\r?\\n[ \\t]*\\r?\\n\\s*')) FROM d
      UNION ALL SELECT doc_id, 'line', unnest(regexp_split_to_array(text, '\\r?\\n')) FROM d),
f AS (SELECT doc_id, unit, sha256({_sql_canonical("body")}) AS digest FROM u),
h AS (SELECT doc_id, max(CASE WHEN unit = 'text' THEN license END) AS whole_license, list_sort(list(DISTINCT license)) AS ls, list_sort(list(DISTINCT class)) AS cs
      FROM f JOIN k USING (digest) GROUP BY doc_id)
SELECT doc_id, whole_license, coalesce(array_to_string(ls, ','), '') AS licenses, coalesce(array_to_string(cs, ','), '') AS classes,
       NOT coalesce(list_has_any(cs, ['noncommercial', 'noderivatives']) OR cs = ['proprietary'], false) AS permitted
FROM d LEFT JOIN h USING (doc_id)
"""
