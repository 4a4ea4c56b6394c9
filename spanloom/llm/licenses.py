"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes its words, lower-cased and joined by single spaces, so that a signature is
a regular expression over words whatever the punctuation and line breaks were. A rule has
an order (its priority), a label, two keywords and a regular expression; the expression is
run only on texts that hold both keywords, and keywords are looked for only in texts that
hold one of a few words that every signature needs. Rules are grouped by their first
keyword. They come from a list of notices, and from a table of license names and a table
of phrases around a name.

Detections are resolved by priority: in order of the rules, one is kept if no kept one
overlaps it, or in place of the kept ones that it holds if it overlaps no others. So of two
that overlap the one of higher priority stays, but one inside another goes.

Scale: all of it is row-local, without a shuffle; a text costs its length, and a text that
passes the prefilter its length times the rules whose keywords it holds. Only detections of
one run of overlapping ones are held against each other.

Defined cases: a null or empty text has no words and no labels, and score 0. A text that
repeats a phrase counts all its places. Repeated rows, ties and empty tables need nothing.
Only the id and text columns are read.
"""

from __future__ import annotations

import json
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import read

#: Phrases that always give their label, and the label.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, keyword, name. In names, every space is one space of the joined words.
NAMES = (
    ("mit", " mit ", r"(?:mit|mit x11)"),
    ("mit", " expat ", r"expat"),
    ("x11", " x11 ", r"x11"),
    ("mit-0", " mit 0 ", r"mit 0"),
    ("apache-1.1", " apache", r"apache(?: software)?(?: license)?(?: version| v)? ?1 1"),
    ("apache-2", " apache", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("apache", " apache", r"apache(?: software)?"),
    ("gpl-1", " gnu general ", r"gnu general public license(?: version| v)? ?1"),
    ("gpl-2", " gnu general ", r"gnu general public license(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", " gnu general ", r"gnu general public license(?: version| v)? ?3(?: 0)?"),
    ("gpl", " gnu general ", r"gnu general public(?: license)?"),
    ("gpl-2", " gpl", r"(?:gnu )?gpl ?(?:version |v )?v?2(?: 0)?"),
    ("gpl-3", " gpl", r"(?:gnu )?gpl ?(?:version |v )?v?3(?: 0)?"),
    ("lgpl-2.1", " gnu l", r"gnu (?:lesser|library) general public license(?: version| v)? ?2(?: [01])?"),
    ("lgpl-3", " gnu l", r"gnu lesser general public license(?: version| v)? ?3(?: 0)?"),
    ("lgpl", " gnu l", r"gnu (?:lesser|library) general public(?: license)?"),
    ("lgpl-2.1", " lgpl", r"(?:gnu )?lgpl ?(?:version |v )?v?2(?: [01])?"),
    ("lgpl-3", " lgpl", r"(?:gnu )?lgpl ?(?:version |v )?v?3(?: 0)?"),
    ("agpl-3", " affero ", r"gnu affero general public license(?: version| v)? ?3?(?: 0)?"),
    ("agpl-3", " agpl", r"(?:gnu )?agpl ?(?:version |v )?v?3?(?: 0)?"),
    ("gfdl", " gnu free ", r"gnu free documentation(?: license)?(?: version)?(?: 1 [123])?"),
    ("bsd-2-clause", " bsd ", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("bsd-2-clause", " freebsd ", r"freebsd"),
    ("bsd-3-clause", " bsd ", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", " bsd ", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", " bsd ", r"bsd"),
    ("mpl-1.1", " mozilla ", r"mozilla public license(?: version| v)? ?1 1"),
    ("mpl-2", " mozilla ", r"mozilla public license(?: version| v)? ?2(?: 0)?"),
    ("mpl-2", " mpl", r"mpl ?(?:version |v )?v?2(?: 0)?"),
    ("epl-1", " eclipse ", r"eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("epl-2", " eclipse ", r"eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("cddl", " common development ", r"common development and distribution license(?: version)?(?: 1 [01])?"),
    ("eupl", " european union ", r"european union public licen[cs]e(?: version| v)?(?: 1 [0-2])?"),
    ("cc0", " cc0 ", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc0", " creative commons ", r"creative commons zero(?: v?1 0)?"),
    ("cc-by", " cc by ", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", " cc by sa ", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nc", " cc by nc ", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", " cc by nd ", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", " cc by nc sa ", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", " cc by nc nd ", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", " creative commons ", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-sa", " creative commons ", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc", " creative commons ", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nd", " creative commons ", r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international| unported)?"),
    ("unlicense", " unlicense ", r"unlicense"),
    ("wtfpl", " wtfpl ", r"wtfpl"),
    ("isc", " isc ", r"isc"),
    ("zlib", " zlib ", r"zlib(?: libpng)?"),
    ("artistic-2", " artistic ", r"artistic(?: license)? 2(?: 0)?"),
    ("boost-1", " boost ", r"boost software license(?: version)?(?: 1 0)?"),
    ("python-2", " python ", r"python software foundation(?: license)?(?: version)?(?: 2)?"),
    ("postgresql", " postgresql ", r"postgresql"),
    ("ms-pl", " microsoft ", r"microsoft public"),
    ("ofl-1.1", " open font ", r"(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("odbl-1", " open database ", r"open database license(?: version| v)?(?: 1 0)?"),
    ("odc-by-1", " open data commons ", r"open data commons attribution(?: license)?(?: v?1 0)?"),
    ("pddl-1", " public domain dedication ", r"(?:open data commons )?public domain dedication(?: and)? license(?: 1 0)?"),
    ("0bsd", " 0bsd ", r"0bsd"),
    ("0bsd", " zero clause ", r"(?:bsd zero clause|zero clause bsd)"),
    ("bsd-3-clause-clear", " clear bsd ", r"(?:bsd 3 clause )?clear bsd"),
    ("afl-3", " academic free ", r"academic free license(?: version| v)?(?: [123](?: [012])?)?"),
    ("osl-3", " open software ", r"open software license(?: version| v)?(?: [123](?: [01])?)?"),
    ("ecl-2", " educational community ", r"educational community license(?: version| v)?(?: 2(?: 0)?)?"),
    ("ncsa", " ncsa ", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("upl-1", " universal permissive ", r"universal permissive license(?: version| v)?(?: 1(?: 0)?)?"),
    ("cpl-1", " common public license ", r"common public license(?: version| v)?(?: 1(?: 0)?)?"),
    ("ipl-1", " ibm public ", r"ibm public license(?: version| v)?(?: 1(?: 0)?)?"),
    ("apsl-2", " apple public ", r"apple public source license(?: version| v)?(?: [12](?: [0-2])?)?"),
    ("ms-rl", " microsoft reciprocal ", r"microsoft reciprocal"),
    ("qpl-1", " q public ", r"q public license(?: version| v)?(?: 1(?: 0)?)?"),
    ("npl-1.1", " netscape public ", r"netscape public license(?: version| v)?(?: 1(?: [01])?)?"),
    ("php-3", " php license ", r"php license(?: version| v)?(?: 3(?: 01?)?)?"),
    ("zpl-2", " zope public ", r"zope public license(?: version| v)?(?: [12](?: [01])?)?"),
    ("openssl", " openssl ", r"openssl(?: ssleay)?"),
    ("ruby", " ruby ", r"ruby"),
    ("vim", " vim ", r"vim"),
    ("tcl-tk", " tcl ", r"tcl(?: tk)?"),
    ("curl", " curl ", r"curl"),
    ("libpng-2", " libpng ", r"libpng(?: 2(?: 0)?)?"),
    ("icu", " icu ", r"icu"),
    ("unicode-dfs", " unicode ", r"unicode(?: inc| dfs)?(?: 201[56])?"),
    ("ijg", " independent jpeg group ", r"independent jpeg group"),
    ("bittorrent", " bittorrent ", r"bittorrent open source"),
    ("beerware", " beerware ", r"beerware"),
    ("beerware", " beer ware ", r"beer ware"),
    ("json", " json ", r"json"),
    ("w3c", " w3c ", r"w3c(?: software(?: notice)?(?: and)?)?"),
    ("sleepycat", " sleepycat ", r"sleepycat"),
    ("eupl-1.2", " eupl ", r"eupl(?: version| v)?(?: 1 [0-2])?"),
    ("cecill-2.1", " cecill ", r"cecill(?: [abc])?(?: version| v)?(?: [12](?: [01])?)?"),
    ("mulan-2", " mulan", r"mulan(?: psl| permissive software)?(?: version| v)?(?: ?2)?"),
    ("sspl-1", " server side public ", r"server side public license(?: version| v)?(?: 1)?"),
    ("busl-1.1", " business source ", r"business source license(?: version| v)?(?: 1 1)?"),
    ("elastic-2", " elastic", r"elastic(?: license)? ?2(?: 0)?"),
    ("polyform-nc", " polyform ", r"polyform (?:noncommercial|non commercial)(?: 1 0 0)?"),
    ("blueoak-1", " blue oak ", r"blue oak model(?: license)?(?: 1 0 0)?"),
    ("openrail", " openrail ", r"(?:bigscience |creativeml )?openrail(?: m)?"),
    ("llama-community", " llama ", r"llama(?: [23])?(?: [123])? community"),
    ("gemma", " gemma ", r"gemma"),
    ("lppl-1.3", " latex project ", r"latex project public license(?: version| v)?(?: 1 [0-3]c?)?"),
    ("artistic-1", " artistic ", r"artistic(?: license)?(?: 1(?: 0)?)?"),
    ("ogl-uk-3", " open government ", r"open government licen[cs]e(?: version| v)?(?: ?[123](?: 0)?)?"),
    ("cdla-permissive-2", " community data ", r"community data license agreement(?: permissive)?(?: version| v)?(?: 2(?: 0)?)?"),
    ("fair", " fair license ", r"fair license"),
    ("naumen", " naumen ", r"naumen public"),
    ("ofl-1.1", " ofl ", r"(?:sil )?ofl(?: version| v)?(?: 1 1)?"),
)

#: A string that the phrase needs, and phrases around a name, those that say most first.
PHRASES = (
    (" spdx license identifier ", r"spdx license identifier {}(?: only| or later)?"),
    ("ed under ", r"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (" released under ", r"released under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (" distributed under ", r"distributed under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (" under ", r"(?:available|provided|published) under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (" governed by ", r"governed by (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (" subject to ", r"subject to (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (" covered by ", r"covered by (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (" under ", r"under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (" licen", r"{} licen[cs]e"),
    (" licen", r"licen[cs]e {}"),
)

#: label, keyword, signature of notices that name no license.
NOTICES = (
    ("mit", " permission is hereby granted ", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", " permission to use copy modify ", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", " redistribution and use ", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", " to endorse or promote ", r"may be used to endorse or promote products derived from this software"),
    ("zlib", " origin of this software ", r"the origin of this software must not be misrepresented"),
    ("unlicense", " released into the public domain ", r"this is free and unencumbered software released into the public domain"),
    ("gpl", " free software foundation ", r"under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", " free software foundation ", r"under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", " free software foundation ", r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl-2-or-later", " or at your option ", r"either version 2 of the license or at your option any later version"),
    ("gpl-3-or-later", " or at your option ", r"either version 3 of the license or at your option any later version"),
    ("apache-2", " apache org licenses ", r"apache org licenses license 2 0"),
    ("mpl-2", " mozilla org mpl ", r"mozilla org mpl 2 0"),
    ("cc-by", " creativecommons org ", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", " creativecommons org ", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", " creativecommons org ", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc0", " creativecommons org ", r"creativecommons org publicdomain zero 1 0"),
    ("wtfpl", " do what the fuck ", r"do what the fuck you want to public license"),
    ("boost-1", " boost org license ", r"boost org license 1 0 txt"),
    ("public-domain", " public domain ", r"(?:released (?:in)?to|placed in|dedicated to|in) the public domain"),
    ("all-rights-reserved", " all rights reserved ", r"all rights reserved"),
    ("proprietary", " proprietary ", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("mit", " above copyright notice and this permission notice ", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", " mit license ", r"see (?:the )?license(?: txt| md)? (?:file )?for the mit license"),
    ("mit", " opensource org licenses ", r"opensource org licenses mit(?: license)?(?: php)?"),
    ("bsd-2-clause", " opensource org licenses ", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", " opensource org licenses ", r"opensource org licenses bsd 3 clause"),
    ("bsd", " opensource org licenses ", r"opensource org licenses bsd license php"),
    ("isc", " opensource org licenses ", r"opensource org licenses isc(?: license)?"),
    ("apache-2", " opensource org licenses ", r"opensource org licenses apache 2 0"),
    ("bsd", " redistributions of source code ", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", " redistributions in binary form ", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", " neither the name ", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used"),
    ("bsd-4-clause", " advertising materials mentioning ", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", " in compliance with the license ", r"you may not use this file except in compliance with the license you may obtain a copy of the license"),
    ("apache-2", " limitations under the license ", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-1.1", " apache software foundation ", r"this product includes software developed by the apache software foundation"),
    ("gpl", " gnu org licenses ", r"gnu org licenses gpl(?: [23] 0)?(?: html| txt)?"),
    ("lgpl", " gnu org licenses ", r"gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?"),
    ("agpl-3", " gnu org licenses ", r"gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("gfdl", " gnu org licenses ", r"gnu org licenses fdl(?: 1 [123])?(?: html| txt)?"),
    ("gpl", " gnu general public license ", r"you should have received a copy of the gnu general public license"),
    ("lgpl", " gnu lesser general public license ", r"you should have received a copy of the gnu lesser general public license"),
    ("agpl-3", " gnu affero general public license ", r"you should have received a copy of the gnu affero general public license"),
    ("gpl-2-only", " gnu general public license version 2 ", r"the gnu general public license version 2 only"),
    ("gpl-classpath", " classpath ", r"(?:with the )?(?:gnu )?classpath exception"),
    ("mpl-2", " mozilla public ", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", " eclipse org legal ", r"eclipse org legal epl 2 0"),
    ("epl-1", " eclipse org legal ", r"eclipse org legal epl v10(?: html)?"),
    ("cc-by-nd", " creativecommons org ", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", " creativecommons org ", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", " creativecommons org ", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-pdm", " creativecommons org ", r"creativecommons org publicdomain mark 1 0"),
    ("cc0", " waived all copyright ", r"(?:has|have) waived all copyright and related or neighboring rights"),
    ("unlicense", " unlicense org ", r"unlicense org"),
    ("wtfpl", " wtfpl net ", r"wtfpl net"),
    ("zlib", " provided as is without any express ", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", " altered source versions ", r"altered source versions must be plainly marked as such"),
    ("boost-1", " boost software license ", r"distributed under the boost software license version 1 0 see accompanying file"),
    ("ofl-1.1", " scripts sil org ofl ", r"scripts sil org ofl"),
    ("odbl-1", " opendatacommons org ", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1", " opendatacommons org ", r"opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1", " opendatacommons org ", r"opendatacommons org licenses pddl(?: 1 0)?"),
    ("beerware", " buy me a beer ", r"you can buy me a beer in return"),
    ("json", " used for good not evil ", r"the software shall be used for good not evil"),
    ("openssl", " openssl project for use ", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ijg", " independent jpeg ", r"based in part on the work of the independent jpeg group"),
    ("postgresql", " without a written agreement ", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("hpnd", " without fee is hereby granted ", r"distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("sspl-1", " making the program available ", r"making the program available as a service"),
    ("busl-1.1", " change license ", r"change license (?:apache|gpl|mpl)"),
    ("non-commercial", " non commercial ", r"for (?:personal and )?non commercial use only"),
    ("non-commercial", " noncommercial ", r"for (?:personal and )?noncommercial use only"),
    ("research-only", " research purposes only ", r"for (?:academic |academic and )?research purposes only"),
    ("no-redistribution", " may not be reproduced ", r"(?:this|the) (?:[^ ]+ ){1,4}may not be reproduced(?: or distributed)? without(?: prior)?(?: written)? permission"),
)

#: No rule can match a text without one of these.
GATES = (
    "licen", "spdx", " cc by nc ", " under ", " governed by ", " subject to ", " covered by ", "permi", "distribut", "endorse", " origin ", "domain", " option ", " org ", " fuck ", "reserved", "proprietary",
    "copyright", "conditions", "advertising materials ", " classpath ", " wtfpl net ", "warranty", " plainly marked ", " me a beer ", " good not evil ", "this product includes ", " jpeg group ", " without fee ",
    " as a service ", " use only ", " purposes only ", " nor the names of ",
)

_BEFORE, _BEHIND = "(?<= )", "(?= )"


def rules() -> list[tuple[int, str, str, str, str]]:
    """order, label, keyword, second keyword, regular expression."""
    sure = [(label, f" {phrase} ", "", phrase) for phrase, label in BASE]
    notices = [(label, word, "", signature) for label, word, signature in NOTICES]
    named = [(label, word, other, phrase.format(name)) for other, phrase in PHRASES for label, word, name in NAMES]
    return [(i, label, word, other, f"{_BEFORE}{signature}{_BEHIND}") for i, (label, word, other, signature) in enumerate([*sure, *notices, *named])]


def _rule_table() -> Column:
    """The rules by first keyword, as one constant: an array of (word, rules)."""
    groups: dict[str, list[dict]] = {}
    for i, label, word, other, signature in rules():
        groups.setdefault(word, []).append({"ord": i, "label": label, "other": other, "re": signature})
    table = json.dumps([{"word": w, "rules": r} for w, r in groups.items()])
    return F.from_json(F.lit(table), "array<struct<word:string,rules:array<struct<ord:int,label:string,other:string,re:string>>>>")


def joined_words(text: Column) -> Column:
    """The words, each with one space in front, and a space at the end; a space alone if there are none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def places(joined: Column, signature: Column) -> Column:
    """The matches as an array of (start, end), the numbers of their first and last word."""
    gaps = F.transform(F.split(joined, signature, -1), _spaces)
    inside = F.transform(F.regexp_extract_all(joined, signature, F.lit(0)), _spaces)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(inside)), inside, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        first = acc["at"] + p["g"]
        last = first + p["m"]
        return F.struct(last.alias("at"), F.concat(acc["found"], F.array(F.struct(first.alias("start"), last.alias("end")))).alias("found"))

    return F.aggregate(pairs, start, step, lambda acc: acc["found"])


_DETECTION = "struct<start:int,far:int,ord:int,label:string>"


def resolved(detections: Column) -> Column:
    """What stays of an array of (start, far: minus the end, ord, label)."""
    one, many = f"array<{_DETECTION}>", f"struct<far:int,open:array<{_DETECTION}>,done:array<{_DETECTION}>>"
    overlaps = lambda x, d: (x["start"] <= -d["far"]) & (d["start"] <= -x["far"])

    def best(run: Column) -> Column:
        """Of detections that overlap one another, by priority."""

        def step(kept: Column, d: Column) -> Column:
            over = F.filter(kept, lambda x: overlaps(x, d))
            held = F.forall(over, lambda x: (x["start"] >= d["start"]) & (x["far"] >= d["far"]))
            return F.when(held, F.concat(F.filter(kept, lambda x: ~overlaps(x, d)), F.array(d))).otherwise(kept)

        by_rank = F.array_sort(run, lambda x, y: F.coalesce(F.nullif(x["ord"] - y["ord"], F.lit(0)), x["start"] - y["start"]))
        return F.when(F.size(run) < 2, run).otherwise(F.aggregate(by_rank, F.array().cast(one), step))

    def sweep(acc: Column, d: Column) -> Column:
        """Runs of overlapping detections, from the left; far is the end of the one that is open."""
        apart = d["start"] > acc["far"]
        far = F.greatest(acc["far"], -d["far"])
        return F.when(apart, F.struct((-d["far"]).alias("far"), F.array(d).alias("open"), F.concat(acc["done"], best(acc["open"])).alias("done"))).otherwise(
            F.struct(far.alias("far"), F.concat(acc["open"], F.array(d)).alias("open"), acc["done"].alias("done"))
        )

    start = F.struct(F.lit(-1).alias("far"), F.array().cast(one).alias("open"), F.array().cast(one).alias("done")).cast(many)
    return F.aggregate(F.array_sort(detections), start, sweep, lambda acc: F.concat(acc["done"], best(acc["open"])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (array of places with label) and detections (array of what the rules found)."""
    # Through explode the joined words are worked out once, not again in each expression that uses them.
    d = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(joined_words(F.col(text_col)))).alias("joined"))
    d = d.withColumn("n_words", F.greatest(_spaces(F.col("joined")) - 1, F.lit(0)).cast("long"))
    joined = F.col("joined")

    base = []
    none_base = F.array().cast("array<struct<start:int,end:int,label:string>>")
    for phrase, label in BASE:
        at = places(joined, F.lit(f"{_BEFORE}{phrase}{_BEHIND}"))
        found = F.transform(at, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(label).alias("label")))  # noqa: B023
        base.append(F.when(F.contains(joined, F.lit(f" {phrase} ")), found).otherwise(none_base))

    def detections(rule: Column) -> Column:
        return F.transform(places(joined, rule["re"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("far"), rule["ord"].alias("ord"), rule["label"].alias("label")))

    def of_group(group: Column) -> Column:
        return F.flatten(F.transform(F.filter(group["rules"], lambda r: F.contains(joined, r["other"])), detections))

    gate = reduce(lambda a, b: a | b, [F.contains(joined, F.lit(g)) for g in GATES])
    found = F.flatten(F.transform(F.filter(_rule_table(), lambda g: F.contains(joined, g["word"])), of_group))
    none = F.array().cast(f"array<{_DETECTION}>")
    return d.select("doc_id", "n_words", F.concat(*base).alias("base"), F.when(gate, resolved(found)).otherwise(none).alias("detections"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    label = lambda x: x["label"]
    base_labels, labels = (F.array_join(F.array_sort(F.array_distinct(x)), ",") for x in (F.transform("base", label), F.concat(F.transform("base", label), F.transform("detections", label))))
    covered = F.aggregate("detections", F.lit(0), lambda n, x: n - x["far"] - x["start"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).cast("long").alias("last_word"),
        base_labels.alias("base_labels"),
        labels.alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
    )


QUERIES = {"op10_licenses": op10_licenses}
ORACLES: dict[str, str] = {}
