"""License scan by conditional compression.

Spark cuts the blocks around words that license texts use out of each document. A block is compressed
with every template as zstandard raw dictionary; the more bytes that saves against no dictionary, the
higher the template ranks. A short notice beside other words can save none, so the ranking only gives
the order: down it a template wins if it stands in the block with few
differences in wording and none within its key phrase; a winner's words are taken before the next is
tried, so that a text inside another one counts once and a block with two licenses gives both.

No row is shuffled: a document's blocks stay with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CUE = r"(?i)licen[cs]|\b[al]?gpl|\beupl|copyright|permission|warrant|redistribut|liab|spdx|public domain|creative commons|\bcc[ -]by|\bcc0"
#: Lines or sentences on both sides of one with a cue that belong to its block.
AROUND = 3
_GAP = "\x1e"
_MIT = """{permission is hereby granted free of charge to any person obtaining a copy of this software} and associated documentation files the software to deal
in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of
contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_BSD = """{redistribution and use in source and binary forms with or without modification are permitted} provided that the following conditions are met
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided
with the distribution"""
_BSD_NAME = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_ISC = """{permission to use copy modify and or distribute this software for any purpose with or without fee} is hereby granted provided that the above
copyright notice and this permission notice appear in all copies"""
_APACHE = """{licensed under the apache license version 2.0} the license you may not use this file except in compliance with the license you may obtain a copy of the license at"""
_FSF = "free software you can redistribute it and or modify it under the terms of the {{gnu {0} as published by the free software foundation either version {1}}} of the license or at your option any later version"
_CC = {"CC-BY-4.0": "", "CC-BY-SA-4.0": "-sa", "CC-BY-NC-4.0": "-nc", "CC-BY-ND-4.0": "-nd", "CC-BY-NC-SA-4.0": "-nc-sa", "CC-BY-NC-ND-4.0": "-nc-nd"}
_CC_NAME = {"": "", "-sa": "sharealike", "-nc": "noncommercial", "-nd": "noderivatives", "-nc-sa": "noncommercial-sharealike", "-nc-nd": "noncommercial-noderivatives"}
_GNU = {"GPL-2.0": ("general public license", "2"), "GPL-3.0": ("general public license", "3"), "LGPL-2.1": ("lesser general public license", "2.1"), "LGPL-3.0": ("lesser general public license", "3"), "AGPL-3.0": ("affero general public license", "3")}
#: Fixed values: (license, wording); what stands in braces must be there word for word.
TEMPLATES = (
    ("MIT", _MIT), ("MIT", "released under the {mit license}"), ("MIT", "licensed under the {mit license}"),
    ("BSD-3-Clause", f"{_BSD} {{neither the name}} {_BSD_NAME[17:]}"), ("BSD-2-Clause", _BSD), ("BSD-3-Clause", "licensed under the {bsd 3-clause license}"), ("BSD-2-Clause", "licensed under the {bsd 2-clause license}"),
    ("ISC", _ISC), ("ISC", "licensed under the {isc license}"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "licensed under the {apache license version 2.0}"), ("Apache-2.0", "{apache license version 2.0 january 2004}"), ("Apache-2.0", "licensed under the {apache license 2.0}"),
    ("MPL-2.0", "subject to the terms of the {mozilla public license v 2.0}"), ("MPL-2.0", "{mozilla public license version 2.0}"),
    *((k, _FSF.format(*v)) for k, v in _GNU.items()),
    *((k, f"this work is licensed under the {{gnu {x} version {y}}}") for k, (x, y) in _GNU.items()),
    *((k, f"licensed under the {{gnu {x} v{y if '.' in y else y + '.0'}}}") for k, (x, y) in _GNU.items()),
    *((k, f"{{gnu {x} version {y} {z}}}") for (k, (x, y)), z in zip(_GNU.items(), ("june 1991", "29 june 2007", "february 1999", "29 june 2007", "19 november 2007"), strict=True)),
    *((k, f"licensed under {{cc by{x} 4.0}}") for k, x in _CC.items()),
    *((k, f"this work is licensed under a {{creative commons attribution{'-' * bool(x) + _CC_NAME[x]} 4.0}} international license") for k, x in _CC.items()),
    ("CC0-1.0", "dedicated to the public domain under {cc0 1.0}"), ("CC0-1.0", "{cc0 1.0 universal}"),
    ("Unlicense", "{this is free and unencumbered software released into the public domain}"),
)
#: SPDX identifiers with the names that notices give them.
NAMES = {
    "MIT": ("mit license",), "MIT-0": ("mit no attribution license",), "ISC": ("isc license",), "Apache-2.0": ("apache license 2.0", "apache license version 2.0", "apache license v2.0", "apache-2.0"), "Apache-1.1": ("apache software license version 1.1",),
    "BSD-2-Clause": ("bsd 2-clause license", "simplified bsd license", "freebsd license"), "BSD-3-Clause": ("bsd 3-clause license", "new bsd license", "modified bsd license"), "BSD-4-Clause": ("bsd 4-clause license",), "0BSD": ("bsd zero clause license", "zero-clause bsd license"),
    "MPL-1.1": ("mozilla public license version 1.1", "mozilla public license 1.1"), "MPL-2.0": ("mozilla public license 2.0", "mozilla public license v2.0"), "EPL-1.0": ("eclipse public license 1.0", "eclipse public license v1.0", "eclipse public license version 1.0"),
    "EPL-2.0": ("eclipse public license 2.0", "eclipse public license v2.0", "eclipse public license version 2.0"), "Zlib": ("zlib license",), "BSL-1.0": ("boost software license 1.0", "boost software license version 1.0"), "Artistic-2.0": ("artistic license 2.0",),
    "WTFPL": ("do what the fuck you want to public license",), "CDDL-1.0": ("common development and distribution license 1.0", "common development and distribution license version 1.0"), "EUPL-1.2": ("european union public license 1.2", "european union public license version 1.2", "eupl-1.2"),
    "MS-PL": ("microsoft public license",), "MS-RL": ("microsoft reciprocal license",), "OFL-1.1": ("sil open font license version 1.1", "sil open font license 1.1"), "PostgreSQL": ("postgresql license",), "PSF-2.0": ("python software foundation license",), "NCSA": ("university of illinois ncsa open source license",),
    "ODbL-1.0": ("open database license", "open data commons open database license"), "AFL-3.0": ("academic free license 3.0",), "OSL-3.0": ("open software license 3.0",), "UPL-1.0": ("universal permissive license 1.0",), "X11": ("x11 license",), "Unlicense": ("the unlicense",),
    "GPL-2.0": ("gplv2", "gpl v2", "gnu gpl version 2", "gpl-2.0"), "GPL-3.0": ("gplv3", "gpl v3", "gnu gpl version 3", "gpl-3.0"), "LGPL-2.1": ("lgplv2.1", "lgpl v2.1", "lgpl-2.1"), "LGPL-3.0": ("lgplv3", "lgpl v3", "lgpl-3.0"), "AGPL-3.0": ("agplv3", "agpl v3", "agpl-3.0"),
    "CC0-1.0": (), "CC-BY-3.0": ("creative commons attribution 3.0", "cc by 3.0"), "CC-BY-SA-3.0": ("creative commons attribution-sharealike 3.0", "cc by-sa 3.0"), **{k: () for k in _CC},
}
# A tag with the identifier, alone or with what newer tags say of later versions, and every name by itself.
TEMPLATES += tuple((k, f"{{spdx-license-identifier {k.lower()}{end}}}") for k in NAMES for end in (("", "-only", "-or-later", "+") if "GPL" in k else ("",)))
TEMPLATES += tuple((k, f"{{{name}}}") for k, names in NAMES.items() for name in names)
# The second license of "under ... or ...".
TEMPLATES += tuple((name, f"{{or {the}{x[1]}}}") for name, w in TEMPLATES if (x := re.fullmatch(r"licensed under (?:the )?\{(.*)\}", w)) for the in ("the ", ""))
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_PIECE = 50_000


def words(text: str) -> list[str]:
    """Lower-cased words without marks; points and hyphens inside stay ("2.0", "by-nc")."""
    return [p for w in _WORD.findall(text.lower()) for p in w.replace("licence", "license").replace("cc-by", "cc by").split(" ")]


@lru_cache(4)
def _templates(table: tuple[tuple[str, str], ...]) -> list[tuple[str, list[str], list[str], zstandard.ZstdCompressor]]:
    """(license, words, key phrases, compressor) of each template; of equal wordings the first."""
    out = []
    for wording, name in {w: n for n, w in reversed(table)}.items():
        plain = " ".join(words(wording.replace("{", " ").replace("}", " ")))
        keys = [" ".join(words(x)) for x in re.findall(r"\{(.*?)\}", wording, re.S)]
        out.append((name, plain.split(" "), keys, _compressor(zstandard.ZstdCompressionDict(plain.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))))
    return out[::-1]


def _compressor(d: zstandard.ZstdCompressionDict | None = None) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


@cache
def _bare() -> zstandard.ZstdCompressor:
    return _compressor()


def differences(template: list[str], block: list[str], most: int) -> tuple[int, int, list[str]] | None:
    """(start, stop, differences) of the place in `block` with the fewest word insertions (+), deletions (-)
    and changes (a>b) from the whole template, the first of equal ones; None if it takes over `most`."""
    m, best = len(template), None
    for lo in range(0, max(1, len(block)), _PIECE):
        part = block[lo : lo + _PIECE + 2 * m + most]
        at = {w: i for i, w in enumerate(dict.fromkeys([*template, *part]))}
        t, b = np.array([at[w] for w in template]), np.array([at[w] for w in part], int)
        steps = np.arange(len(part) + 1, dtype=np.int32)
        cost = np.zeros((m + 1, len(part) + 1), np.int32)
        for i in range(1, m + 1):
            above = cost[i - 1]
            here = above + 1
            here[1:] = np.minimum(here[1:], above[:-1] + (b != t[i - 1]))
            cost[i] = np.minimum.accumulate(here - steps) + steps
        stop = int(np.argmin(cost[m]))
        if cost[m, stop] > (most if best is None else len(best[2]) - 1):
            continue
        i, j, said = m, stop, []
        while i:
            if j and cost[i, j] == cost[i - 1, j - 1] + (template[i - 1] != part[j - 1]):
                if template[i - 1] != part[j - 1]:
                    said.append(f"{template[i - 1]}>{part[j - 1]}")
                i, j = i - 1, j - 1
            elif cost[i, j] == cost[i - 1, j] + 1:
                said.append(f"-{template[i - 1]}")
                i -= 1
            else:
                said.append(f"+{part[j - 1]}")
                j -= 1
        best = lo + j, lo + stop, said[::-1]
    return best


#: Letters of the longest block whose answer is kept for blocks like it: repeated notices are short.
_KEPT = 4096


def winners(block: str, table: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[tuple[str, int, float, tuple[str, ...]], ...]:
    """(license, bytes saved, share saved, differences) of each template that stands in a block."""
    return _known(block, table) if len(block) <= _KEPT else _winners(block, table)


@lru_cache(4096)
def _known(block: str, table: tuple[tuple[str, str], ...]) -> tuple[tuple[str, int, float, tuple[str, ...]], ...]:
    return _winners(block, table)


def _winners(block: str, table: tuple[tuple[str, str], ...]) -> tuple[tuple[str, int, float, tuple[str, ...]], ...]:
    left = words(block)
    plain = " ".join(left).encode()
    alone = len(_bare().compress(plain))
    ranked = sorted(((alone - len(t[3].compress(plain)), -i, t) for i, t in enumerate(_templates(table))), key=lambda x: x[:2], reverse=True)
    out = []
    for saved, _, (name, template, keys, _) in ranked:
        # several times in a block: each place is taken, so that no shorter template meets it again
        first = True
        while all(f" {k} " in f" {' '.join(left)} " for k in keys):
            found = differences(template, left, len(template) // (10 if len(template) >= 20 else 4))
            if found is None:
                break
            x, y, said = found
            place = f" {' '.join(left[x:y])} "
            if not all(f" {k} " in place for k in keys):
                break
            if first:
                out.append((name, saved, saved / alone, tuple(said)))
            left[x:y] = [""] * (y - x)
            first = False
    return tuple(out)


def blocks(text: Column) -> Column:
    """The blocks of a text: runs of lines or sentences of which none is further than AROUND from a cue."""
    cue = F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), _GAP, " "), r"\n+|(?<=[.!?])\s+"), lambda s: F.struct(s.alias("s"), F.rlike(s, F.lit(CUE)).alias("cue")))
    return F.transform(F.array(cue), lambda all_: F.transform(all_, lambda x, i: F.when(F.exists(F.slice(all_, F.greatest(i + 1 - AROUND, F.lit(1)), F.least(i, F.lit(AROUND)) + 1 + AROUND), lambda y: y["cue"]), x["s"]).otherwise(_GAP)))[0]


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, license, saved, reduction, n_blocks, n_differences, differences): a row for each license in each
    row of `docs` (doc_id, text).

    n_blocks counts the blocks that hold the license; the rest is of the one with the fewest differences in
    wording, of those the one that saved most bytes. templates: (license, wording with its key phrases in braces).
    Templates that save equally are tried in their own order; of equal wordings the first counts. Null and empty
    texts hold nothing; repeated rows and null ids are judged each by themselves; other columns are not read; an empty
    table gives an empty one. Texts are read whole: long blocks are compared piece by piece."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, saved long, reduction double, n_blocks long, n_differences long, differences string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, cut in zip(batch.column("doc_id").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                found: dict[str, list] = {}
                for i, block in enumerate(cut):
                    for name, *x in winners(block, templates):
                        found.setdefault(name, []).append((len(x[2]), -x[0], x[1], x[2], i))
                for name, all_ in sorted(found.items()):
                    n, saved, share, said, _ = min(all_)
                    rows.append({"doc_id": doc_id, "license": name, "saved": -saved, "reduction": share, "n_blocks": len({x[4] for x in all_}), "n_differences": n, "differences": " ".join(said)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    some = docs.select("doc_id", "text").filter(F.rlike("text", F.lit(CUE)))
    joined = some.select("doc_id", F.array_join(blocks(F.col("text")), "\n").alias("kept"))
    cut = joined.select("doc_id", F.filter(F.split("kept", f"{_GAP}[{_GAP}\n]*"), lambda x: F.trim(x) != "").alias("blocks"))
    return cut.mapInArrow(run, schema)
