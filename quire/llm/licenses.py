"""License scan: ordered signature rules over word-normalised text, in built-in functions only.

Text becomes words joined by single spaces; a rule is a regex over that form: sentences of license texts and notices,
written by hand, and the ways a license is named in prose, for each family of licenses.
A rule is tried only where cheap ``contains`` find a keyword of its form and one
of its name or identifier; they are worked out from the regex, so that every
match holds one. Detections are word intervals. One that lies in another goes; of equal ones the
one of smaller priority, then the earlier rule, stays. Of two left that partly overlap the one of smaller priority
stays, of equal priority the first in the text.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything that is not in a word, before letters are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Fixed values of the base scan: phrase, label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, name as written in prose, identifier as words, whether the identifier alone tells.
FAMILIES = (
    ("mit", r"(?:mit|expat|mit x11)", r"mit", False),
    ("mit-0", r"mit no attribution", r"mit 0", False),
    ("apache-1.1", r"apache(?: software)?(?: license| licence)?(?: version)? 1 1", r"apache (?:software )?(?:licen[cs]e )?(?:version )?1 1", True),
    ("apache-2", r"apache(?: software)?(?: license| licence)?(?: version)? 2(?: 0)?", r"(?:apache 2 0|apache (?:software )?licen[cs]e (?:version )?2(?: 0)?)", True),
    ("apache", r"apache(?: software)?", r"apache", False),
    ("gpl-1", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?1(?: 0)?", r"gpl ?v? ?1(?: 0)?(?: only| or later)?", True),
    ("gpl-2", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)?(?: only)?", r"gpl ?v? ?2(?: 0)?(?: only)?", True),
    ("gpl-2-or-later", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)?(?: or(?: at your option)?(?: any)? later(?: version)?)", r"gpl ?v? ?2(?: 0)? or later", True),
    ("gpl-3", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?(?: only)?", r"gpl ?v? ?3(?: 0)?(?: only)?", True),
    ("gpl-3-or-later", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?(?: or(?: at your option)?(?: any)? later(?: version)?)", r"gpl ?v? ?3(?: 0)? or later", True),
    ("gpl", r"(?:gnu )?(?:general public|gpl)", r"gpl", False),
    ("lgpl-2", r"(?:gnu )?(?:library|lesser) general public license(?: version| v)? ?2(?: 0)?", r"lgpl ?v? ?2(?: 0)?(?: only| or later)?", True),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?2 1", r"lgpl ?v? ?2 1(?: only| or later)?", True),
    ("lgpl-3", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)?", r"lgpl ?v? ?3(?: 0)?(?: only| or later)?", True),
    ("lgpl", r"(?:gnu )?(?:lesser general public|lgpl)", r"lgpl", False),
    ("agpl-3", r"(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?", r"agpl 3 0(?: only| or later)?", False),
    ("agpl", r"agpl(?: v)? ?3?", r"agpl(?: ?v? ?3(?: 0)?)?(?: only| or later)?", True),
    ("gfdl", r"gnu free documentation", r"gfdl(?: 1 [123])?(?: only| or later)?", False),
    ("bsd-2", r"(?:simplified|2 clause|two clause) bsd|freebsd|bsd 2 clause", r"(?:bsd 2 clause|(?:2|two) clause bsd)", True),
    ("bsd-3", r"(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause", r"(?:bsd 3 clause|(?:3|three) clause bsd)", True),
    ("bsd-4", r"(?:original|4 clause|four clause) bsd|bsd 4 clause", r"(?:bsd 4 clause|(?:4|four) clause bsd)", True),
    ("bsd-0", r"(?:zero clause|0 clause) bsd", r"0bsd", True),
    ("bsd", r"(?:berkeley software distribution|bsd)(?: style)?", r"bsd", False),
    ("isc", r"(?:isc|internet systems consortium)", r"isc", False),
    ("mpl-1", r"mozilla public license(?: version| v)? ?1(?: [01])?", r"mpl 1 [01]", False),
    ("mpl-2", r"mozilla public license(?: version| v)? ?2(?: 0)?", r"mpl 2 0", False),
    ("mpl", r"mpl(?: v)? ?[12]?(?: [01])?", r"mpl [12] [01]", True),
    ("epl-1", r"eclipse public license(?: version| v)? ?1(?: 0)?", r"epl 1 0", False),
    ("epl-2", r"eclipse public license(?: version| v)? ?2(?: 0)?", r"epl 2 0", False),
    ("epl", r"epl(?: v)? ?[12]?(?: 0)?", r"epl [12] 0", True),
    ("cddl", r"(?:common development and distribution license )?cddl(?: version)?(?: 1 [01])?", r"cddl 1 [01]", True),
    ("cpl-1", r"common public license(?: version)?(?: 1(?: 0)?)?", r"cpl 1 0", False),
    ("eupl", r"european union public license?c?e?(?: version)?(?: 1 [012])?", r"eupl 1 [012]", False),
    ("artistic-1", r"artistic(?: license)?(?: version)? 1(?: 0)?", r"artistic (?:licen[cs]e )?(?:version )?1 0", True),
    ("artistic-2", r"artistic(?: license)?(?: version)? 2(?: 0)?", r"artistic (?:licen[cs]e )?(?:version )?2 0", True),
    ("artistic", r"(?:the )?perl artistic|the artistic", r"artistic", False),
    ("zlib", r"zlib(?: libpng)?", r"zlib", False),
    ("libpng", r"libpng", r"libpng(?: 2 0)?", False),
    ("boost-1", r"boost software license(?: version)?(?: 1(?: 0)?)?", r"bsl 1 0", False),
    ("unlicense", r"unlicense", r"unlicense", True),
    ("wtfpl", r"wtfpl(?: version)?(?: 2)?", r"wtfpl", True),
    ("cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", r"cc0 1 0", True),
    ("cc-by", r"(?:creative commons attribution|cc by)(?: [1-4] \d)?(?: international| unported| generic)?", r"cc by [1-4] \d", True),
    ("cc-by-sa", r"(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] \d)?(?: international| unported| generic)?", r"cc by sa [1-4] \d", True),
    ("cc-by-nc", r"(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] \d)?(?: international| unported| generic)?", r"cc by nc [1-4] \d", True),
    ("cc-by-nd", r"(?:creative commons attribution no ?deriv(?:ative)?s?(?: works)?|cc by nd)(?: [1-4] \d)?(?: international| unported| generic)?", r"cc by nd [1-4] \d", True),
    ("cc-by-nc-sa", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] \d)?(?: international| unported| generic)?", r"cc by nc sa [1-4] \d", True),
    ("cc-by-nc-nd", r"(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s?|cc by nc nd)(?: [1-4] \d)?(?: international| unported| generic)?", r"cc by nc nd [1-4] \d", True),
    ("cc", r"creative commons", r"creative commons", False),
    ("ofl-1.1", r"sil open font license(?: version)?(?: 1 1)?|open font license", r"ofl 1 1", False),
    ("ms-pl", r"microsoft public", r"ms pl", False),
    ("ms-rl", r"microsoft reciprocal", r"ms rl", False),
    ("python-2", r"python(?: software foundation)?(?: license)?(?: version)?(?: 2(?: 0)?)?", r"python 2 0", False),
    ("php-3", r"php(?: license)?(?: version)?(?: 3(?: [01]+)?)?", r"php 3 01?", False),
    ("ruby", r"ruby", r"ruby", False),
    ("openssl", r"openssl(?: ssleay)?", r"openssl", False),
    ("postgresql", r"postgresql", r"postgresql", False),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa", False),
    ("odbl", r"open (?:data commons open )?database license(?: odbl)?(?: version)?(?: 1 0)?", r"odbl 1 0", False),
    ("odc-by", r"open data commons attribution", r"odc by 1 0", False),
    ("bsl-1.1", r"business source license(?: version)?(?: 1 1)?", r"busl 1 1", False),
    ("sspl-1", r"server side public license(?: version| v)?(?: 1)?", r"sspl 1 0", False),
    ("elastic-2", r"elastic license(?: version)?(?: 2(?: 0)?)?", r"elastic 2 0", False),
    ("json", r"json", r"json", False),
)

#: Sentences of license texts and notices, as words. label, regex, priority, score; what many texts share comes late.
SIGNATURES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1, 0.98),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 2, 0.95),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 4, 0.7),
    ("mit-0", r"mit no attribution copyright", 2, 0.9),
    ("x11", r"except as contained in this notice the name of (?:[^ ]+ ){1,8}shall not be used in advertising or otherwise to promote the sale", 2, 0.95),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 1, 0.98),
    ("bsd-0", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 1, 0.98),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 2, 0.95),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions", 3, 0.9),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", 3, 0.9),
    ("bsd-3", r"neither the names? of (?:[^ ]+ ){1,8}nor the names of (?:its|their|any) contributors may be used to endorse or promote products", 1, 0.95),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1, 0.95),
    ("apache-2", r"you may not use this file except in compliance with the license", 3, 0.85),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 2, 0.9),
    ("apache-2", r"you may obtain a copy of the license at https? www apache org licenses license 2 0", 1, 0.98),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", 2, 0.9),
    ("gpl-2-or-later", r"under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 1, 0.98),
    ("gpl-3-or-later", r"under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 1, 0.98),
    ("gpl-1", r"under the terms of the gnu general public license as published by the free software foundation either version 1(?: of the license)?", 1, 0.98),
    ("gpl-2", r"under the terms of the gnu general public license version 2 as published by the free software foundation", 1, 0.98),
    ("gpl-3", r"under the terms of the gnu general public license version 3 as published by the free software foundation", 1, 0.98),
    ("lgpl-2", r"under the terms of the gnu library general public license as published by the free software foundation either version 2", 1, 0.98),
    ("lgpl-2.1", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1", 1, 0.98),
    ("lgpl-3", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3", 1, 0.98),
    ("agpl-3", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3", 1, 0.98),
    ("gpl", r"see the gnu general public license for more details", 3, 0.85),
    ("lgpl", r"see the gnu (?:lesser|library) general public license for more details", 3, 0.85),
    ("agpl", r"see the gnu affero general public license for more details", 3, 0.85),
    ("gpl", r"you should have received a copy of the gnu general public license", 3, 0.85),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license", 3, 0.85),
    ("agpl", r"you should have received a copy of the gnu affero general public license", 3, 0.85),
    ("gpl-linking-exception", r"as a special exception (?:[^ ]+ ){1,12}permission to link", 2, 0.85),
    ("classpath-exception", r"linking this library statically or dynamically with other modules is making a combined work based on this library", 2, 0.9),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1, 0.98),
    ("mpl-1", r"the contents of this file are subject to the mozilla public license version 1 [01]", 1, 0.98),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0", 1, 0.98),
    ("mpl-2", r"if a copy of the mpl was not distributed with this file you can obtain one at", 2, 0.95),
    ("epl-1", r"made available under the terms of the eclipse public license v ?1 0", 1, 0.98),
    ("epl-2", r"made available under the terms of the eclipse public license (?:v ?)?2 0", 1, 0.98),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", 1, 0.98),
    ("eupl", r"licensed under the eupl(?: version)? 1 [012] or as soon they will be approved", 1, 0.98),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 1, 0.98),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 2, 0.95),
    ("wtfpl", r"do what the fuck you want to public license", 1, 0.98),
    ("wtfpl", r"you just do what the fuck you want to", 2, 0.9),
    ("cc0", r"has waived all copyright and related or neighbou?ring rights", 2, 0.95),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", 1, 0.95),
    ("cc-by", r"this (?:work|article|document) is licensed under (?:a|the) creative commons attribution(?: [1-4] \d)?(?: international| unported| generic)? licen[cs]e", 1, 0.97),
    ("cc-by-sa", r"this (?:work|article|document) is licensed under (?:a|the) creative commons attribution share ?alike(?: [1-4] \d)?(?: international| unported| generic)? licen[cs]e", 1, 0.97),
    ("cc-by-nc", r"this (?:work|article|document) is licensed under (?:a|the) creative commons attribution non ?commercial(?: [1-4] \d)?(?: international| unported| generic)? licen[cs]e", 1, 0.97),
    ("cc-by-nd", r"this (?:work|article|document) is licensed under (?:a|the) creative commons attribution no ?derivatives(?: [1-4] \d)?(?: international| unported| generic)? licen[cs]e", 1, 0.97),
    ("cc-by-nc-sa", r"this (?:work|article|document) is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike(?: [1-4] \d)?(?: international| unported| generic)? licen[cs]e", 1, 0.97),
    ("cc-by-sa", r"text is available under the creative commons attribution share ?alike licen[cs]e", 1, 0.97),
    ("boost-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1, 0.98),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software", 2, 0.9),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1, 0.95),
    ("libpng", r"the png reference library is supplied as is", 1, 0.95),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", 1, 0.98),
    ("artistic-1", r"the intent of this document is to state the conditions under which a package may be copied", 1, 0.95),
    ("artistic-2", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 1, 0.95),
    ("python-2", r"psf is making python available to licensee on an as is basis", 1, 0.95),
    ("php-3", r"this product includes php software freely available from", 1, 0.95),
    ("ruby", r"ruby is copyrighted free software by yukihiro matsumoto", 1, 0.95),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 1, 0.95),
    ("postgresql", r"for any purpose without fee and without a written agreement is hereby granted", 1, 0.9),
    ("ncsa", r"to deal with the software without restriction including without limitation the rights to use copy modify", 2, 0.9),
    ("odbl", r"is made available under the open database license", 1, 0.97),
    ("odc-by", r"is made available under the open data commons attribution license", 1, 0.97),
    ("bsl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 1, 0.98),
    ("sspl-1", r"if you make the functionality of the program or a modified version available to third parties as a service", 1, 0.97),
    ("elastic-2", r"you may not provide the software to third parties as a hosted or managed service", 1, 0.97),
    ("json", r"the software shall be used for good not evil", 1, 0.97),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", 2, 0.85),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", 1, 0.97),
    ("public-domain", r"(?:is|are|been) (?:hereby )?(?:placed|released|dedicated|put) (?:in|into|to) the public domain", 2, 0.9),
    ("proprietary", r"unauthorized (?:copying|use|reproduction|distribution|disclosure) of this (?:file|software|document) (?:via any medium )?is strictly prohibited", 2, 0.9),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential) information of", 3, 0.8),
)

#: id part, regex around the name ({n}) or the identifier ({i}), priority, score. Ordered: what says more comes first.
FORMS = (
    ("spdx", r"spdx license identifier {i}", 1, 1.0),
    ("grant", r"(?:licensed|licenced|released|distributed|redistributed|published|available|provided|covered|dual licensed)(?: [^ ]+){0,3} under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{n})(?: licen[cs]es?)?", 2, 0.95),
    ("terms", r"(?:terms|conditions|provisions) of (?:the )?(?:{n})(?: licen[cs]e)?", 3, 0.85),
    ("url", r"(?:opensource org|spdx org|gnu org|creativecommons org) licen[cs]es (?:{i})", 3, 0.9),
    ("named", r"(?:{n}) licen[cs]e", 4, 0.8),
)
ALONE = ("alone", r"(?:{i}|{n})", 5, 0.6)
#: Families whose names are plain prose too: of these only the identifier, which holds a version, tells alone.
PROSE = frozenset(("apache-1.1", "apache-2", "bsd-2", "bsd-3", "bsd-4", "mpl", "epl", "artistic-1", "artistic-2"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def needed(regex: str) -> list[str]:
    """Strings of which every match of the regex holds at least one; of the choices that with the longest shortest string."""

    def of(tokens) -> list[str] | None:
        found, run = [], ""
        for kind, value in [*tokens, (None, None)]:
            if kind is parser.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append([run])
            before, run, inner = [(parser.LITERAL, ord(c)) for c in run], "", None
            if kind is parser.SUBPATTERN:
                inner = of(value[3])
            elif kind is parser.BRANCH:
                each = [of([*before, *x]) for x in value[1]]  # the parser moves what all begin with before them
                inner = None if None in each else sum(each, [])
            elif kind is parser.MAX_REPEAT and value[0]:
                inner = of(value[2])
            if inner:
                found.append([x for x in dict.fromkeys(inner) if not any(y != x and y in x for y in inner)])
        return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)

    return of(parser.parse(regex)) or [""]


def rules() -> list[dict]:
    """All rules in order, each with its keywords (every match holds one), regex over words, priority and score."""
    whole = lambda regex: "(?<![^ ])" + regex + "(?![^ ])"
    out = [{"id": i, "label": label, "keywords": needed(regex), "regex": whole(regex), "priority": priority, "score": score, "form": "sentence"} for i, (label, regex, priority, score) in enumerate(SIGNATURES)]
    for label, name, ident, tells in FAMILIES:
        for form, around, priority, score in (*FORMS, ALONE)[: 6 if tells else 5]:
            if form == ALONE[0] and label in PROSE:
                around = "{i}"
            told = "|".join(x for mark, x in (("{i}", ident), ("{n}", name)) if mark in around)
            out.append({"id": len(out), "label": label, "keywords": needed(told), "regex": whole(around.replace("{n}", name).replace("{i}", ident)), "priority": priority, "score": score, "form": form})
    return out


RULE_TYPE = "array<struct<id:int,label:string,keywords:array<string>,regex:string,priority:int,score:double>>"
SPAN = "struct<start:int,stop:int,priority:int,id:int,label:string,score:double>"


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def detections(words: Column) -> Column:
    """All places of the rules in ``words``, as word intervals. Rules are tried where a keyword of their form and one of their own stand."""

    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def places(rule: Column) -> Column:
        # the matches between two marks that no word holds; a match begins and ends with a word
        marked = F.regexp_replace(words, rule["regex"], F.lit("\u0001$0\u0002"))

        def spans(text: Column) -> Column:
            each = F.split(text, " ", -1)
            starts = F.array_compact(F.transform(each, lambda w, i: F.when(F.startswith(w, F.lit("\u0001")), i)))
            stops = F.array_compact(F.transform(each, lambda w, i: F.when(F.endswith(w, F.lit("\u0002")), i + 1)))
            pairs = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop"), rule["priority"].alias("priority"), rule["id"].alias("id"), rule["label"].alias("label"), rule["score"].alias("score")))
            return F.when(F.contains(text, F.lit("\u0001")), pairs).otherwise(none)

        return F.flatten(F.transform(F.array(marked), spans))  # bound once

    each = []
    for form, around in (("sentence", ""), *((form, around) for form, around, *_ in (*FORMS, ALONE))):
        listed = F.from_json(F.lit(json.dumps([r for r in rules() if r["form"] == form])), RULE_TYPE)
        found = F.flatten(F.transform(F.filter(listed, lambda r: F.exists(r["keywords"], lambda k: F.contains(words, k))), places))
        # without what stands for name and identifier, which may match nothing here
        may = reduce(or_, (F.contains(words, F.lit(k)) for k in needed(around.replace("{n}", "(?:x)?").replace("{i}", "(?:x)?"))))
        each.append(F.when(may, found).otherwise(none))
    return F.concat(*each)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """License notices of every whole text.

    Returns key, n_words, n_base (places of the base phrases), first_word and
    last_word (smallest and largest start of those, null if none),
    base_labels, labels (base ones and those of kept detections), score (0 to
    1, the best kept one; a base place counts 1) and n_kept. Null text: as empty: no words, no labels,
    score 0. Repeated rows give equal rows, an empty table an empty one, other
    columns are left out. No shuffle, no Python: one pass over the text.
    """
    low = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).select(key, F.translate(F.trim(F.regexp_replace("_t", NOT_WORD, " ")), UPPER, LOWER).alias("_w"))
    low = low.select(key, F.when(F.col("_w") == "", F.lit(0)).otherwise(spaces(F.col("_w")) + 1).cast("long").alias("n_words"), "_w")
    parts = low.select("*", *(F.when(F.contains(F.col("_w"), F.lit(p)), F.split("_w", f"(?<![^ ]){p}(?![^ ])", -1)).alias(f"_p{i}") for i, (p, _) in enumerate(PHRASES)))
    n = [F.when(F.col(f"_p{i}").isNull(), F.lit(0)).otherwise(F.size(F.col(f"_p{i}")) - 1) for i in range(len(PHRASES))]
    first = [F.when(n[i] > 0, spaces(F.element_at(F.col(f"_p{i}"), 1))) for i in range(len(PHRASES))]
    last = [F.when(n[i] > 0, F.col("n_words") - 1 - spaces(F.element_at(F.col(f"_p{i}"), -1)) - p.count(" ")) for i, (p, _) in enumerate(PHRASES)]
    base = F.array_sort(F.array_compact(F.array(*(F.when(n[i] > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)))))
    found = parts.select(
        key, "n_words", sum(n[1:], n[0]).cast("long").alias("n_base"), F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"), base.alias("_base"),
        F.when(F.col("_w").isNotNull(), F.array_sort(F.transform(detections(F.col("_w")), lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("less"), s["priority"].alias("priority"), s["id"].alias("id"), s["label"].alias("label"), s["score"].alias("score"))))).alias("_all"),
    )
    # in this order a detection lies in another exactly if some earlier one ends no sooner; those left overlap in part or not at all
    last = "struct<stop:int,priority:int,label:string,score:double>"
    zero = F.struct(F.lit(-1).alias("stop"), F.expr(f"cast(null as {last})").alias("last"), F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).alias("n"))

    def settled(acc: Column, stop: Column, then: Column) -> Column:
        """The last detection counts, and ``then`` is the last."""
        there = acc["last"].isNotNull()
        labels = F.when(there, F.array_union(acc["labels"], F.array(acc["last"]["label"]))).otherwise(acc["labels"])
        return F.struct(stop.alias("stop"), then.alias("last"), labels.alias("labels"), F.when(there, F.greatest(acc["score"], acc["last"]["score"])).otherwise(acc["score"]).alias("score"), (acc["n"] + there.cast("int")).alias("n"))

    def keep(acc: Column, d: Column) -> Column:
        stop = -d["less"]
        mine = F.struct(stop.alias("stop"), d["priority"].alias("priority"), d["label"].alias("label"), d["score"].alias("score")).cast(last)
        apart = F.coalesce(d["start"] >= acc["last"]["stop"], F.lit(True))
        better = F.when(d["priority"] < acc["last"]["priority"], mine).otherwise(acc["last"])
        instead = F.struct(stop.alias("stop"), better.alias("last"), acc["labels"].alias("labels"), acc["score"].alias("score"), acc["n"].alias("n"))
        return F.when(stop <= acc["stop"], acc).when(apart, settled(acc, stop, mine)).otherwise(instead)

    ended = lambda acc: settled(acc, acc["stop"], F.expr(f"cast(null as {last})"))
    kept = found.withColumn("_kept", F.when(F.size("_all") > 0, F.aggregate("_all", zero, keep, ended)))
    return kept.select(
        key, "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce(F.col("_kept.labels"), F.expr("cast(array() as array<string>)")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("_kept.score"), F.lit(0.0))).alias("score"), F.coalesce(F.col("_kept.n"), F.lit(0)).cast("long").alias("n_kept"),
    )
