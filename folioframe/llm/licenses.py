"""License scans by ordered signature rules, in DataFrame functions alone.

A text becomes its words, lower-cased in A-Z and joined by single spaces. A rule has a label, a priority, a keyword and a
regular expression. Only rules whose keyword the text contains are run; a detection is a range of words. A detection
that lies inside another is suppressed if the other has a higher priority, or the same priority and more words. The
three base phrases are told apart from the rules: their places are all counted and their labels always stay.

Everything is one projection of a row: nothing is shuffled, and a text with many detections stays with its row. Work is in
proportion to a text: each word carries its number, so a match tells where it stands, and detections are sorted and held
only against those whose range can reach theirs.

Defined results: null counts as empty; a text without detections has n_base 0, null words, empty labels and score 0;
repeated rows are scanned each alone; an empty table gives no rows; other columns pass through unread.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

#: The ASCII characters that are neither letters nor digits.
OTHER = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrase -> label of the base scan.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Each rule's pattern needs one of these; a text without any is not held against the rules at all.
GATE = (
    "licen", " under ", " cc", "commons", "attribution", "rail", "permission", "redistribution", "neither the name", "you may not use", "apache org", "free software", "gnu org", "mozilla org",
    "source code form", "public domain", "all rights reserved", "proprietary", "unauthorized copying", "copyright", "provided as is",
)

#: label | keyword | names as they read once text is words | versions. These are written by hand; the patterns below are made of them.
LICENSES = r"""
mit | mit | mit(?: expat)?,expat |
mit-0 | mit | mit (?:0|no attribution) |
apache | apache | apache(?: software)?(?: foundation)? | 1 0,1 1,2 0,2
gpl | general public | (?:gnu )?general public | 1 0,2 0,3 0,1,2,3
gpl | gpl | (?:gnu )?gpl | v1,v2,v3,1 0,2 0,3 0,1,2,3
lgpl | lgpl | (?:gnu )?lgpl | v2,v3,2 0,2 1,3 0,2,3
lgpl | lesser general | (?:gnu )?lesser general public | 2 1,3 0,2,3
lgpl | library general | (?:gnu )?library general public | 2 0,2
agpl | agpl | (?:gnu )?agpl | v1,v3,1 0,3 0,3
agpl | affero | (?:gnu )?affero general public | 1 0,3 0,1,3
gfdl | free documentation | (?:gnu )?free documentation | 1 1,1 2,1 3
bsd | bsd | (?:(?:new|modified|simplified|revised|original) )?bsd | 0 clause,1 clause,2 clause,3 clause,4 clause
isc | isc | isc |
mpl | mozilla | mozilla public | 1 0,1 1,2 0
mpl | mpl | mpl | 1 0,1 1,2 0
epl | eclipse | eclipse public | 1 0,2 0
edl | eclipse | eclipse distribution | 1 0
cddl | cddl | cddl | 1 0,1 1
cddl | common development | common development and distribution | 1 0,1 1
cpl | common public | common public | 1 0
ipl | ibm public | ibm public | 1 0
artistic | artistic | (?:perl )?artistic | 1 0,2 0
zlib | zlib | zlib(?: libpng)? |
libpng | libpng | libpng | 2 0
boost | boost | boost software | 1 0
bsl | business source | business source | 1 0,1 1
sspl | server side public | server side public | 1 0
elastic | elastic | elastic | 2 0
unlicense | unlicense | unlicense |
wtfpl | wtfpl | wtfpl | 2 0
wtfpl | want to public | do what the (?:fuck|f) you want to public | 2 0
postgresql | postgresql | postgresql |
python | python | python software foundation | 2 0
python | psf | psf | 2 0
php | php | php | 3 0,3 01
ruby | ruby | ruby |
openssl | openssl | openssl |
openldap | openldap | openldap public | 2 8
curl | curl | curl |
x11 | x11 | x11 |
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? |
w3c | w3c | w3c(?: software)?(?: notice and)? |
eupl | eupl | eupl | 1 1,1 2
eupl | european union public | european union public | 1 1,1 2
cecill | cecill | cecill(?: b| c)? | 2 0,2 1
osl | open software | open software | 1 0,2 0,2 1,3 0
afl | academic free | academic free | 1 2,2 0,2 1,3 0
ms-pl | microsoft public | microsoft public |
ms-rl | microsoft reciprocal | microsoft reciprocal |
apsl | apple public | apple public source | 1 0,2 0
ofl | ofl | (?:sil )?ofl | 1 0,1 1
ofl | open font | (?:sil )?open font | 1 0,1 1
odbl | odbl | odbl | 1 0
odbl | open database | open database | 1 0
pddl | public domain dedication | (?:open data commons )?public domain dedication(?: and)? | 1 0
odc-by | open data commons | open data commons attribution | 1 0
cc0 | cc0 | (?:creative commons )?cc0 | 1 0
cc0 | zero | creative commons zero | 1 0
cc-by-nc-nd | cc by nc nd | cc by nc nd | 2 0,2 5,3 0,4 0
cc-by-nc-sa | cc by nc sa | cc by nc sa | 2 0,2 5,3 0,4 0
cc-by-nc | cc by nc | cc by nc | 2 0,2 5,3 0,4 0
cc-by-nd | cc by nd | cc by nd | 2 0,2 5,3 0,4 0
cc-by-sa | cc by sa | cc by sa | 2 0,2 5,3 0,4 0
cc-by | cc by | cc by | 1 0,2 0,2 5,3 0,4 0
cc-by-nc-nd | noncommercial no | (?:creative commons )?attribution noncommercial no ?deriv(?:ative)?s? | 2 0,2 5,3 0,4 0
cc-by-nc-sa | noncommercial share | (?:creative commons )?attribution noncommercial share ?alike | 2 0,2 5,3 0,4 0
cc-by-nc | noncommercial | (?:creative commons )?attribution non ?commercial | 2 0,2 5,3 0,4 0
cc-by-nd | attribution no | (?:creative commons )?attribution no ?deriv(?:ative)?s? | 2 0,2 5,3 0,4 0
cc-by-sa | attribution share | (?:creative commons )?attribution share ?alike | 2 0,2 5,3 0,4 0
cc-by | commons attribution | creative commons attribution | 1 0,2 0,2 5,3 0,4 0
vim | vim | vim |
tcl | tcl | tcl tk |
upl | universal permissive | universal permissive | 1 0
blueoak | blue oak | blue oak model | 1 0 0
mulan | mulan | mulan(?: permissive software)?(?: psl)? | v1,v2
llama | llama | llama(?: 2| 3)?(?: community)? |
openrail | openrail | (?:creativeml )?(?:open )?rail(?: m)?|openrail(?: m)? |
lppl | lppl | (?:latex project public|lppl) | 1 0,1 3c
json | json | json |
beerware | beerware | beerware |
"""

#: label | priority | keyword | pattern, for notices that name no license by its title.
NOTICES = r"""
mit | 60 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
isc | 60 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | 60 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd | 55 | neither the name | neither the name of(?: [^ \x01]+){1,12}? nor the names of its contributors may be used to endorse or promote
apache | 60 | you may not use this file | you may not use this file except in compliance with the license
apache | 65 | apache org | https? www apache org licenses license 2 0
gpl | 60 | free software you can | this program is free software you can redistribute it and or modify it
gpl | 62 | as published by | (?:gnu )?general public license as published by the free software foundation
gpl | 62 | gnu org | https? www gnu org licenses gpl(?: [23] 0)?
lgpl | 62 | gnu org | https? www gnu org licenses lgpl(?: [23] [01])?
agpl | 62 | gnu org | https? www gnu org licenses agpl(?: 3 0)?
mpl | 62 | mozilla org | https? (?:www )?mozilla org mpl 2 0
mpl | 60 | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
unlicense | 60 | released into the public domain | free and unencumbered software released into the public domain
public-domain | 30 | public domain | (?:in|into|to) the public domain
proprietary | 40 | all rights reserved | all rights reserved
proprietary | 50 | proprietary and confidential | proprietary and confidential
proprietary | 50 | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
copyright | 20 | copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
zlib | 60 | provided as is | this software is provided as is without any express or implied warranty in no event
boost | 60 | permission is hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
cc0 | 62 | publicdomain zero | https? creativecommons org publicdomain zero 1 0
cc-by-nc-nd | 62 | licenses by nc nd | https? creativecommons org licenses by nc nd \d \d
cc-by-nc-sa | 62 | licenses by nc sa | https? creativecommons org licenses by nc sa \d \d
cc-by-nc | 61 | licenses by nc | https? creativecommons org licenses by nc \d \d
cc-by-nd | 62 | licenses by nd | https? creativecommons org licenses by nd \d \d
cc-by-sa | 62 | licenses by sa | https? creativecommons org licenses by sa \d \d
cc-by | 61 | licenses by | https? creativecommons org licenses by \d \d
"""


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern): for each named license a versioned title, a title, a grant and a tag."""
    out = []
    for line in LICENSES.strip().splitlines():
        label, keyword, names, versions = (x.strip() for x in line.split("|", 2)[:2] + line.split("|", 2)[2].rsplit("|", 1))
        name = f"(?:{names.replace(',', '|')})"
        title = rf"{name} (?:public )?licen[cs]e"
        versioned = "|".join(sorted(versions.split(","), key=len, reverse=True)) if versions else ""
        grant = r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?"
        if versioned:
            out.append((label, 80, keyword, rf"{grant}{name}(?: (?:public )?licen[cs]e)?(?: version| v)? (?:{versioned})"))
            out.append((label, 70, keyword, rf"{title}(?: version| v)? (?:{versioned})"))
        out.append((label, 75, keyword, rf"{grant}{title}"))
        out.append((label, 50, keyword, title))
        out.append((label, 90, keyword, rf"spdx license identifier {name}(?: (?:{versioned}))?(?: only| or later)?" if versioned else rf"spdx license identifier {name}"))
        if label.startswith("cc"):
            out.append((label, 45, keyword, rf"{name} (?:{versioned})" if versioned else name))
    for line in NOTICES.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        out.append((label, int(priority), keyword, pattern))
    return out


#: Detections of one block of the sorted list.
BLOCK = 32
#: A word's number, behind it in numbered text.
NUMBER = r"\x01\d+"


def numbered_pattern(pattern: str) -> str:
    """The pattern for text in which each word is followed by its number."""
    words = re.split(r" (\??)", pattern)  # what stands between spaces, and whether the space before it may be missing
    return f"(?<= )(?:{''.join(w if k % 2 == 0 else f'(?:{NUMBER} )?' if w else NUMBER + ' ' for k, w in enumerate(words))}){NUMBER}"


def _matches(rows: list[tuple[str, int, str, str]]) -> str:
    """SQL: of each rule its label, priority and matches in `num`; patterns are literals, so a task compiles each once."""
    none = "cast(array() as array<string>)"
    each = [f"named_struct('label', '{label}', 'priority', {priority}, 'found', if(contains(flat, '{keyword}'), regexp_extract_all(num, r'{numbered_pattern(pattern)}', 0), {none}))" for label, priority, keyword, pattern in rows]
    place = r"named_struct('start', int(regexp_extract(m, r'\x01(\d+)', 1)), 'end', int(regexp_extract(m, r'(\d+)$', 1)) + 1, 'priority', r.priority, 'label', r.label)"
    return f"flatten(transform(array({', '.join(each)}), r -> transform(r.found, m -> {place})))"


def _bound(value: str, name: str, body: str) -> str:
    """SQL: body with the value under a name, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _unsuppressed(found: str) -> str:
    """SQL: the detections that no other one suppresses, in order of place.

    Sorted detections are cut into blocks; a block is held against those up to itself that end late enough to reach its first
    start, as what holds a detection starts no later, and no more words before it than the longest detection has.
    """
    inside = "e.start <= d.start and e.end >= d.end and (e.priority > d.priority or e.priority = d.priority and e.end - e.start > d.end - d.start)"
    kept = f"filter(block, d -> not exists(near, e -> {inside}))"
    near = "flatten(filter(blocks, b -> b[size(b) - 1].start >= block[0].start - longest and b[0].start <= block[size(block) - 1].start))"
    each = f"transform(blocks, block -> {_bound(near, 'near', kept)})"
    cut = f"transform(sequence(0, int((size(every) - 1) / {BLOCK})), i -> slice(every, i * {BLOCK} + 1, {BLOCK}))"
    longest = "array_max(transform(every, d -> d.end - d.start))"
    whole = _bound(cut, "blocks", _bound(longest, "longest", f"flatten({each})"))
    return _bound(f"array_sort({found})", "every", f"if(size(every) = 0, every, {whole})")


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    # Every ASCII character that is no word's becomes a space, A-Z become a-z, and a space stands on each side of each word.
    plain = F.translate(F.coalesce(F.col(text_column), F.lit("")), UPPER + OTHER, LOWER + " " * len(OTHER))
    flat = docs.select(F.col(id_column).alias("doc_id"), F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), " {2,}", " ").alias("flat"))
    n_words = F.length("flat") - F.length(F.translate("flat", " ", "")) - 1
    gate = " or ".join(f"contains(flat, '{k}')" for k in GATE)
    number = "concat(' ', array_join(transform(split(trim(flat), ' '), (w, i) -> concat(w, '\\u0001', i)), ' '))"
    base = [(label, 100, phrase, phrase) for phrase, label in BASE.items()]
    both = _bound(number, "num", f"named_struct('base', {_matches(base)}, 'kept', {_unsuppressed(_matches(rules()))})")
    empty = "cast(array() as array<struct<start:int,end:int,priority:int,label:string>>)"
    found = flat.select("doc_id", n_words.cast("long").alias("n_words"), F.expr(f"if({gate}, {both}, named_struct('base', {empty}, 'kept', {empty}))").alias("found"))
    kept = found.select("doc_id", "n_words", F.col("found.base").alias("base"), F.col("found.kept").alias("detections"))
    label = lambda d: d["label"]
    strength = F.coalesce(F.array_max(F.transform(F.concat("base", "detections"), lambda d: d["priority"])), F.lit(0))
    return kept.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.concat("base", "detections"), label))), ",").alias("labels"),
        (strength / F.lit(100.0)).alias("score"),
        "detections",
    )
