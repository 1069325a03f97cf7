"""License scans by sentence rules, in Spark functions alone.

A text loses its comment leaders (#, //, *, and so on) and indentation; empty lines and stops part it in sentences, which may go over
several lines. They are normalised (lower case, letters and digits only, one space between words) and looked up among known licence
sentences. Where a sentence over several lines isn't known, a known one may be its last lines (up to TAIL of them), or single lines, as titles and headings have no stop. The
identifiers, in order, are then matched against ordered licence rules. A rule is a run of identifiers; a rule that matches takes its
run away, so a later, more general rule doesn't count it again. Sentences that speak of licences and aren't known are reported as unknown.

Texts without any of the cue words have no known sentence; they are passed over by one pattern.

Defined results: null and empty texts have no licences; repeated rows are scanned one by one; a licence that matches in two places
is listed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cues, one of which is in every known sentence.
CUES = "licen[sc]|copyright|warrant|permission|redistribut|rights reserved|public domain|liab|endorse|advertising|either version|mpl|creative commons|cc by|cc0"

#: The GNU licences by the start of their identifiers.
GNU = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "lgpl2": "gnu library general public license", "agpl": "gnu affero general public license"}

#: Identifiers of known licence sentences (from the public licence texts), and the sentences as they read when normalised.
SENTENCES = {
    "apache-ref": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "licensed under the apache 2 0 license", "this project is licensed under the apache license version 2 0"),
    "apache-may": ("you may not use this file except in compliance with the license", "you may not use this work except in compliance with the license"),
    "apache-copy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0", "you may obtain a copy of the license in the license file or at"),
    "apache-asis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache-see": ("see the license for the specific language governing permissions and limitations under the license",),
    "mit-ref": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "mit license", "the mit license", "the mit license mit"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    "mit-asis": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit-liable": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "bsd-ref": ("licensed under the bsd license", "bsd 2 clause license", "bsd 3 clause license"),
    "bsd-redist": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-advert": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "bsd-asis": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"),
    "bsd-liable": ("in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services", "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"),
    "bsd-theory": ("or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",),
    "isc-ref": ("isc license", "licensed under the isc license"),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "0bsd-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "isc-asis": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "isc-liable": ("in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",),
    "gpl3-ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gnu gpl version 3"),
    "gpl2-ref": ("licensed under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2", "licensed under the gnu gpl version 2"),
    "lgpl-ref": ("licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2 1"),
    "agpl-ref": ("licensed under the gnu affero general public license version 3",),
    **{
        f"{i}{v}-later": tuple(f"{start}you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation either version {v.replace('.', ' ')} of the license or at your option any later version" for start in ("", "this program is free software ", "this library is free software "))
        for i, name in GNU.items()
        for v in ("2", "2.1", "3")
    },
    **{f"{i}-terms": tuple(f"{start}you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation" for start in ("", "this program is free software ", "this library is free software ")) for i, name in GNU.items()},
    **{f"either-{v}": (f"either version {v.replace('.', ' ')} of the license or at your option any later version",) for v in ("2", "2.1", "3")},
    **{f"{i}-only-{v}": (f"you can redistribute it and or modify it under the terms of the {name} version {v.replace('.', ' ')} as published by the free software foundation",) for i, name in GNU.items() for v in ("2", "2.1", "3")},
    "gnu-warranty": tuple(f"this {what} is distributed in the hope that it will be useful but without any warranty" for what in ("program", "library", "software", "file")),
    "gnu-fitness": ("without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gnu-see": tuple(f"see the {name} for more details" for name in GNU.values()),
    "gnu-copy": tuple(f"you should have received a copy of the {name} along with this {what}" for name in GNU.values() for what in ("program", "library", "software")),
    "gnu-web": ("if not see http www gnu org licenses", "if not see https www gnu org licenses"),
    "mpl-ref": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"),
    "mpl-copy": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    "epl-ref": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "licensed under the eclipse public license version 2 0"),
    "bsl-grant": ("distributed under the boost software license version 1 0", "boost software license version 1 0 august 17th 2003"),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "zlib-asis": ("this software is provided as is without any express or implied warranty",),
    "cc-by": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "this work is licensed under the creative commons attribution 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "this work is licensed under the creative commons attribution sharealike 4 0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "this work is licensed under the creative commons attribution noncommercial 4 0 international license"),
    "cc-by-nd": ("licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    "cc0": ("licensed under cc0 1 0", "released under cc0 1 0 to the public domain", "this work is dedicated to the public domain", "this work is licensed under cc0 1 0 universal"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "reserved": ("all rights reserved",),
}

#: The start of sentences that vary, with their identifiers.
STARTS = {"copyright": ("copyright c ", "copyright 1", "copyright 2"), "bsd-endorse": ("neither the name of ",), "spdx-mit": ("spdx license identifier mit",), "spdx-apache": ("spdx license identifier apache 2 0",)}

_BSD2, _BSD3 = ("bsd-redist", "bsd-source", "bsd-binary"), ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse")
_BSD4 = ("bsd-redist", "bsd-source", "bsd-binary", "bsd-advert")
#: Ordered rules; a longer run stands before its parts.
RULES = (
    ("MIT", ("mit-ref", "copyright", "mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice")),
    # A copyright line's reservation belongs to the licence that follows it.
    *((name, before + run) for name, run in (("BSD-4-Clause", _BSD4), ("BSD-3-Clause", _BSD3), ("BSD-2-Clause", _BSD2)) for before in (("copyright", "reserved"), ("reserved",), ())),
    ("Apache-2.0", ("apache-ref", "apache-may", "apache-copy", "apache-asis", "apache-see")),
    ("Apache-2.0", ("apache-ref", "apache-may", "apache-copy")),
    ("Apache-2.0", ("apache-ref",)),
    *((f"{kind}-{v if '.' in v else v + '.0'}-or-later", run) for i, kind in (("gpl", "GPL"), ("lgpl", "LGPL"), ("lgpl2", "LGPL"), ("agpl", "AGPL")) for v in ("2", "2.1", "3") for run in ((f"{i}{v}-later",), (f"{i}-terms", f"either-{v}"))),
    *((f"{kind}-{v if '.' in v else v + '.0'}-only", (f"{i}-only-{v}",)) for i, kind in (("gpl", "GPL"), ("lgpl", "LGPL"), ("lgpl2", "LGPL"), ("agpl", "AGPL")) for v in ("2", "2.1", "3")),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("LGPL", ("lgpl-ref",)),
    ("AGPL-3.0", ("agpl-ref",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("ISC", ("isc-ref", "copyright", "isc-grant")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-ref",)),
    ("0BSD", ("0bsd-grant",)),
    ("EPL-2.0", ("epl-ref",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("proprietary", ("copyright", "reserved")),
    ("proprietary", ("reserved",)),
)

#: Identifier of sentences that speak of a licence but aren't known.
UNKNOWN = "unknown"
#: Lines that a known sentence may be the last of, where the sentence as a whole isn't known.
TAIL = 16
#: What a line starts and ends with in comments; a stop that ends no sentence; what ends one.
LEAD, CLOSE = r"\n[\x20\t]*(?:(?://+|#+|/\*+|\*+/?|--+|;+|%+|<!--|>+)[\x20\t]*)*", r"[\x20\t]*(?:\*+/|-->)?[\x20\t]*\n"
INNER, END = r"\b([Vv])\.\x20", r"""[.;:!?]+["'\x29\x5D>]*(?:[\x20\t\n]+|$)|\n\n+"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known licence sentences, in order; unknown for others that speak of a licence."""
    bare = F.regexp_replace(F.regexp_replace(F.concat(F.lit("\n"), text, F.lit("\n")), r"\r\n?", "\n"), LEAD, "\n")
    sentences = F.split(F.regexp_replace(F.regexp_replace(bare, CLOSE, "\n"), INNER, "$1 "), END)
    known = F.create_map(*(F.lit(x) for i, texts in SENTENCES.items() for s in texts for x in (s, i)))

    def started(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for i, starts in STARTS.items():
            for start in starts:
                out = F.when(s.startswith(start), F.lit(i)).otherwise(out)
        return out

    nothing = F.array().cast("array<string>")

    def in_lines(lines: Column) -> Column:
        # The first line from which on the rest is known, among the last TAIL.
        rests = F.transform(F.sequence(F.greatest(F.size(lines) - TAIL + 1, F.lit(1)), F.greatest(F.size(lines), F.lit(1))), lambda i: F.struct(i.alias("i"), known[F.array_join(F.slice(lines, i, F.size(lines)), " ")].alias("id")))
        first = F.get(F.filter(rests, lambda x: x["id"].isNotNull()), F.lit(0))

        def with_first(x: Column) -> Column:
            head = F.transform(F.when(x.isNull(), lines).otherwise(F.slice(lines, F.lit(1), x["i"] - 1)), lambda y: F.coalesce(known[y], started(y)))
            return F.filter(F.concat(head, F.array(x["id"])), lambda y: y.isNotNull())

        return _let(first, with_first)

    def identified(sentence: Column) -> Column:
        def of_whole(whole: Column) -> Column:
            lines = F.filter(F.transform(F.split(sentence, "\n"), _plain), lambda x: x != "")
            found = F.when(sentence.contains("\n"), _let(lines, in_lines)).otherwise(nothing)
            unknown = F.when(whole.rlike(r"\blicen[sc]e") & ~whole.rlike("^https? "), F.lit(UNKNOWN))
            single = F.filter(F.array(F.coalesce(started(whole), unknown)), lambda x: x.isNotNull())
            rest = _let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(single))
            return _let(known[whole], lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(rest))

        return _let(_plain(sentence), of_whole)

    return F.flatten(F.transform(F.filter(sentences, lambda s: s.rlike(f"(?i){CUES}")), identified))


def matched(ids: Column) -> Column:
    """The licences of a list of identifiers, in the order of the rules."""
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in run)).alias("run")) for name, run in RULES))
    start = F.struct(F.concat_ws("", F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">")))).alias("left"), F.array().cast("array<string>").alias("names"))

    def apply(acc: Column, rule: Column) -> Column:
        left = F.replace(acc["left"], rule["run"], F.lit("|"))
        times = ((F.length(acc["left"]) - F.length(left)) / (F.length(rule["run"]) - 1)).cast("int")
        return F.struct(left.alias("left"), F.concat(acc["names"], F.array_repeat(rule["name"], times)).alias("names"))

    return F.aggregate(rules, start, apply)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, sentence_ids, licenses (both arrays), n_unknown (sentences that speak of a licence but aren't known)."""
    text = F.col(text_col).cast("string")
    ids = F.when(text.rlike(f"(?i){CUES}"), sentence_ids(text)).otherwise(F.array().cast("array<string>"))
    staged = docs.select(F.col(id_col).alias("_id"), ids.alias("_ids"))
    found = matched(F.col("_ids"))
    unknown = F.size(F.filter("_ids", lambda i: i == UNKNOWN)).cast("long")
    licenses = F.when(F.size("_ids") > 0, found["names"]).otherwise(F.array().cast("array<string>"))
    return staged.select(F.col("_id").alias(id_col), F.coalesce("_ids", F.array().cast("array<string>")).alias("sentence_ids"), F.coalesce(licenses, F.array().cast("array<string>")).alias("licenses"), F.greatest(unknown, F.lit(0)).alias("n_unknown"))
