"""License scans by canonical digest lookup.

A text is made canonical: ASCII letters in lower case, copyright lines left out, equivalent spellings made one,
and punctuation and white space reduced to single spaces. Its SHA-256 is joined to the digests of known licence
texts and notices. Whole documents are looked up, and so is each of their lines as an entire text of its own,
which is how notices stand in documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm._store import Store
from sparkquiver.llm._text import slices, tidy

#: Words that follow "copyright" or "(c)" within licence texts, so that a line wrapped there is no copyright line (fixed values).
BODY = ("also|and|are|disclaimer|doctrines|holders?|if|including|interests?|laws?|license|licence|like|line|more|notices?|of|on|or|owners?|ownership|patent"
        "|permission|resulting|statement|then|those|treaty|the(?=[^a-z0-9\\n]*(software|library|\\n|$))")
ITEM = "you|under|representations|all(?! rights)|the(?![^\\n]*[0-9]{4})"
#: A line that begins with the word, unless nothing, more letters or a word of the body follows, or with the sign.
COPYRIGHT_LINE = (rf"(^|\n)[^a-z0-9\n]*(copyright(?![a-z]|[^a-z0-9\n]*(\n|$)|[^a-z0-9\n]+({BODY})(?![a-z0-9]))|\(c\)(?![^a-z0-9\n]+({ITEM})(?![a-z0-9]))"
                  r"|©|(?<=<)copyright notice>[^a-z0-9\n]*(?=\n|$))[^\n]*")
PUNCTUATION = "[\\x00-/:-@\\[-`{-\\x7f‘’“”–—©®™]+"
#: Spellings that are equivalent in licence texts, after punctuation has become spaces (fixed values).
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("https", "http"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
)

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS
_ISC_TAIL = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_ONE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_TWO = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Known licence texts and notices by SPDX identifier (fixed values).
KNOWN = (
    ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT", _MIT),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "This project is licensed under the MIT License."), ("MIT", "License: MIT"),
    ("MIT-0", "MIT No Attribution\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _AS_IS),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_TAIL),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_ONE + _BSD_TWO + _BSD_TAIL), ("BSD-2-Clause", _BSD_HEAD + "1. " + _BSD_ONE + "2. " + _BSD_TWO + _BSD_TAIL),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_ONE + _BSD_TWO + _BSD_THREE + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "1. " + _BSD_ONE + "2. " + _BSD_TWO + "3. " + _BSD_THREE + _BSD_TAIL),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."), ("LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."), ("AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
)

#: Titles under which licence texts stand, besides none (fixed values).
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT-0 License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License", "The BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: A line that often follows the copyright line.
RESERVED = "All rights reserved."
#: Known texts of so many code points are whole licences, not notices.
WHOLE = 500

#: SPDX identifier, length and digest of canonical full texts, made from published copies: with and without the notice at
#: the end that says how to apply them, and with the addresses that those copies have (fixed values).
FULL = (
    ("Apache-2.0", 8843, "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),
    ("Apache-2.0", 8855, "d1680110962921dbea774fa14dfc28da11388743b12bc17fe0c77170a67c3a72"),
    ("Apache-2.0", 8871, "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Apache-2.0", 8883, "db01d7bc2aa55ff18671fe237b4562bbd8a2a68239c7b8f45f5617bbd1379bf0"),
    ("Apache-2.0", 9887, "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", 9899, "67e045953182c77acf9892dc3fa8b7556ce97344f311dc27b8f03c0fdc8e23f2"),
    ("BSD-3-Clause", 1381, "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC-BY-SA-4.0", 17456, "4dd2d8faa991a43111f73718974d1a9133ba1453cd76d174da75d163e35fa974"),
    ("CC0-1.0", 6664, "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", 19583, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3-only", 22018, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0-only", 9387, "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0-only", 9415, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0-only", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", 14428, "031ce0347a7bfaa9fea9fb34dc0def0f70d366e9b6aeab50cf9537178d0d9d50"),
    ("GPL-2.0-only", 14455, "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0-only", 14456, "bdf38469899e13b914cf4555a4606ddcc8b2faddcedc662286f649b36212f225"),
    ("GPL-2.0-only", 14456, "c2eea7a9d82a254e540a96d8107801d93d00bcef2742a78b7e8e8d0c0efcbd1c"),
    ("GPL-2.0-only", 14483, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0-only", 14484, "3417af4a4eb07583be14c0185e9a1834057e320931de2c5bf39c217a03fe79a0"),
    ("GPL-2.0-only", 16791, "5cb6370ac80145bff27a54858e51a973da8c42e030e5803cfe2c3953ae0150ac"),
    ("GPL-2.0-only", 17085, "aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75"),
    ("GPL-2.0-only", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0-only", 17119, "42a2063beecb82de51a227e52a22e4acf4fa0d052827262e6bb57835e02e10e9"),
    ("GPL-3.0-only", 30940, "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0-only", 30968, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0-only", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0-only", 33408, "9faf4f9b13ca844eeee37346a77dec74f558096ac2b418782a99c8afe4c772da"),
    ("LGPL-2.0-only", 22249, "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0-only", 22277, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0-only", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0-only", 24139, "0e3c184176a70698802350b8f697a92e908601a66f8f622e8d4c08c9e90e0a8f"),
    ("LGPL-2.1-only", 23337, "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1-only", 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1-only", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22467, "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", 14341, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("OFL-1.1", 3874, "a4915a2dcd67c648b73ad8364858cba28bbfb700e62ca5847e2c30544066e01a"),
)

_LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACED = str.maketrans({c: " " for c in map(chr, range(0x3000)) if re.fullmatch(PUNCTUATION, c)})
_ONE_WORD = {old: new for old, new in SPELLINGS if " " not in old}
_TWO_WORDS = tuple((f" {old} ", f" {new} ") for old, new in SPELLINGS if " " in old)


def _words(text: str) -> list[str]:
    """Canonical words of a text in lower case without copyright lines, but for pairs of words."""
    return [_ONE_WORD.get(w, w) for w in text.translate(_SPACED).split(" ") if w]


def _joined(words: list[str]) -> str:
    t = f" {' '.join(words)} "
    for old, new in _TWO_WORDS:
        if old in t:
            t = t.replace(old, new)
    return t.strip(" ")


def _prepared(text: str) -> str:
    t = text.translate(_LOWERED)
    return re.sub(COPYRIGHT_LINE, "\n", t) if "copyright" in t or "(c)" in t or "©" in t else t


def canonical_text(text: str) -> str:
    """The canonical form of one text."""
    return _joined(_words(_prepared(text)))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digests_of(text: str, longest: int) -> tuple[str, list[str]]:
    """Digest of the whole canonical text, and the distinct ones of its lines and paragraphs of at most ``longest`` code points.

    A paragraph is a run of lines that have words."""
    lines = [_words(line) for line in _prepared(text).split("\n")]
    whole = _joined([w for line in lines for w in line])
    parts, paragraph = [], []
    for line in [*lines, []]:
        if line:
            parts.append(line)
            paragraph.append(line)
        else:
            if len(paragraph) > 1:
                parts.append([w for x in paragraph for w in x])
            paragraph = []
    texts = {_joined(words) for words in parts if sum(map(len, words)) <= longest}
    return _digest(whole), sorted(_digest(t) for t in texts if t and len(t) <= longest)


def titled(known: tuple[tuple[str, str], ...]) -> set[tuple[str, str]]:
    """Licence and canonical text, of whole licences also under each title and after the reservation of rights."""
    out = set()
    for name, text in known:
        body = canonical_text(text)
        out.add((name, body))
        if len(body) >= WHOLE and name in TITLES:
            heads = [canonical_text(t) for t in TITLES[name]]
            body = next((body[len(h) + 1 :] for h in sorted(heads, key=len, reverse=True) if body.startswith(f"{h} ")), body)
            out |= {(name, " ".join(x for x in (h, r, body) if x)) for h in ("", *heads) for r in ("", canonical_text(RESERVED))}
    return out


def known_digests(known: tuple[tuple[str, str], ...] = KNOWN, full: tuple[tuple[str, int, str], ...] = FULL) -> dict[str, str]:
    """Licence by digest."""
    return {digest: name for name, _, digest in full} | {_digest(text): name for name, text in titled(known)}


def find_licenses(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, id_col: str = "doc_id", text_col: str = "text",
                  full: tuple[tuple[str, int, str], ...] = FULL) -> DataFrame:
    """One row per input row: (id, canonical_sha256, text_license, licenses).

    ``canonical_sha256`` is the digest of the whole canonical text, ``text_license`` the licence whose text that is
    (else null), and ``licenses`` the sorted distinct licences of the whole text, of its lines and of its paragraphs, an
    empty array if there are none. A null text counts as empty; an empty text, or one of copyright lines and punctuation alone, is no
    licence. Repeated rows and null ids are rows like others. An empty table gives an empty result. ``known``
    (licence, text) and ``full`` (licence, length, digest) must be lists of bounded size: they are sent with the query. Other columns are not read.
    """
    if len(known) + len(full) > 10_000:
        raise ValueError("more than 10,000 known texts are not sent with a query")
    spark = docs.sparkSession
    store = Store(spark)
    digests = {k: v for k, v in known_digests(known, full).items() if k != _digest("")}
    longest = max((*(len(t) for _, t in titled(known)), *(n for _, n, _ in full)), default=0)  # a longer line is none of them

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            found = [digests_of(t or "", longest) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([w for w, _ in found]), pa.array([d for _, d in found], pa.list_(pa.string()))],
                                             ["row", "id", "whole", "digests"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = store.put(rows.mapInArrow(tidy(scan), f"row long, id {rows.schema['id'].dataType.simpleString()}, whole string, digests array<string>"))
    table = F.broadcast(spark.createDataFrame(sorted(digests.items()), "digest string, license string"))
    every = rows.select("row", F.explode(F.array_union("digests", F.array("whole"))).alias("digest"))
    found = every.join(table, "digest").groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("licenses"))
    own = table.select(F.col("digest").alias("whole"), F.col("license").alias("text_license"))
    return (rows.select("row", "id", "whole").join(F.broadcast(own), "whole", "left").join(found, "row", "left")
            .select(F.col("id").alias(id_col), F.col("whole").alias("canonical_sha256"), "text_license",
                    F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses")))
