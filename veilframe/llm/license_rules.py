"""Signature rules for licence texts, over texts of lower-case words with one space between them.

A rule: label, keyword (the rule can match only where it occurs), pattern, priority (0 is highest), confidence.
Each family below is written by hand: label, keyword, name (a regular expression for how the licence is called),
versions (what may follow the name, by label suffix), identifier words (its registry identifier), and further
hand-written phrases of the licence's own text. Templates turn a family into several ordered rules.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    base: bool = False


#: Phrases that the contract fixes; they are never suppressed.
BASE = [
    Rule("mit", "mit license", "under the mit license", 0, 1.0, True),
    Rule("apache-2", "apache license", "apache license version 2", 0, 1.0, True),
    Rule("cc-by-nc", "cc by nc", "cc by nc", 0, 1.0, True),
]

L = r"licen[cs]es?"
#: (label, keyword, name, {label suffix: version words}, identifiers, phrases of the text itself)
FAMILIES: list[tuple[str, str, str, dict[str, str], list[str], list[str]]] = [
    ("mit", "mit lic", rf"mit {L}", {}, ["mit license"], [rf"mit {L} see license", rf"mit {L} mit", rf"mit {L} copyright c \d{{4}}"]),
    ("mit", "expat lic", rf"expat {L}", {}, [], []),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge", {}, [], ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"]),
    ("mit-0", "mit no attribution", rf"mit no attribution(?: {L})?", {}, [], []),
    ("mit-modern", "mit modern", rf"mit modern variant(?: {L})?", {}, [], []),
    ("x11", "x11 lic", rf"x11 {L}", {}, [], []),
    ("apache", "apache", rf"apache(?: software)?(?: foundation)? {L}", {"-1": "1 0", "-1.1": "1 1", "-2": "2(?: 0)?"}, ["apache 2 0", "apache 1 1"], ["you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org"]),
    ("gpl", "gnu general", rf"gnu general public {L}", {"-1": "1(?: 0)?", "-2": "2(?: 0)?", "-3": "3(?: 0)?"}, [], ["it under the terms of the gnu general public license as published by the free software foundation", "you should have received a copy of the gnu general public license along with"]),
    ("gpl", "gpl", "(?:gnu )?gpl(?: license)?", {"-1": "1(?: 0)?", "-2": "2(?: 0)?", "-3": "3(?: 0)?"}, ["gpl 1 0", "gpl 2 0", "gpl 3 0"], []),
    ("gpl-2", "gplv2", r"gplv2\+?", {}, [], []),
    ("gpl-3", "gplv3", r"gplv3\+?", {}, [], []),
    ("lgpl", "general public", rf"gnu (?:lesser|library) general public {L}", {"-2": "2(?: 0)?", "-2.1": "2 1", "-3": "3(?: 0)?"}, [], ["under the terms of the gnu lesser general public license"]),
    ("lgpl", "gnu library", rf"gnu library general public {L}", {"-2": "2(?: 0)?"}, [], []),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", {"-2": "2(?: 0)?", "-2.1": "2 1", "-3": "3(?: 0)?"}, ["lgpl 2 1", "lgpl 3 0"], []),
    ("agpl", "gnu affero", rf"gnu affero general public {L}", {"-1": "1(?: 0)?", "-3": "3(?: 0)?"}, [], ["remote network interaction use with the gnu general public license"]),
    ("agpl", "agpl", "(?:gnu )?agpl", {"-3": "3(?: 0)?"}, ["agpl 3 0"], []),
    ("gfdl", "gnu free doc", rf"gnu free documentation {L}", {"-1.1": "1 1", "-1.2": "1 2", "-1.3": "1 3"}, ["gfdl 1 3"], ["with no invariant sections no front cover texts and no back cover texts"]),
    ("bsd", "bsd lic", rf"bsd {L}", {}, [], []),
    ("bsd-2", "bsd 2", r"bsd 2 clause", {}, ["bsd 2 clause"], []),
    ("bsd-3", "bsd 3", r"bsd 3 clause", {}, ["bsd 3 clause"], []),
    ("bsd-2", "clause bsd", rf"(?:2|two) clause bsd(?: {L})?", {}, [], []),
    ("bsd-3", "clause bsd", rf"(?:3|three) clause bsd(?: {L})?", {}, [], []),
    ("bsd-4", "clause bsd", rf"(?:4|four) clause bsd(?: {L})?", {}, [], []),
    ("bsd-2", "simplified bsd", rf"simplified bsd(?: {L})?", {}, [], []),
    ("bsd-3", "new bsd", rf"new bsd {L}", {}, [], []),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms", {}, [], ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"]),
    ("isc", "isc lic", rf"isc {L}", {}, [], ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("mpl", "mozilla", rf"mozilla public {L}", {"-1": "1(?: 0)?", "-1.1": "1 1", "-2": "2(?: 0)?"}, [], ["this source code form is subject to the terms of the mozilla public license"]),
    ("mpl", "mpl", "mpl", {"-1.1": "1 1", "-2": "2(?: 0)?"}, ["mpl 2 0"], []),
    ("epl", "eclipse public", rf"eclipse public {L}", {"-1": "1(?: 0)?", "-2": "2(?: 0)?"}, ["epl 2 0"], ["this program and the accompanying materials are made available under the terms of the eclipse public license"]),
    ("edl", "eclipse dist", rf"eclipse distribution {L}", {"-1": "1(?: 0)?"}, [], []),
    ("cddl", "common development", rf"common development and distribution {L}", {"-1": "1(?: 0)?", "-1.1": "1 1"}, ["cddl 1 0"], []),
    ("cpl", "common public lic", rf"common public {L}", {"-1": "1(?: 0)?"}, [], []),
    ("eupl", "european union public", rf"european union public {L}", {"-1.1": "1 1", "-1.2": "1 2"}, [], []),
    ("eupl", "eupl", "eupl", {"-1.1": "1 1", "-1.2": "1 2"}, ["eupl 1 2"], []),
    ("cecill", "cecill", "cecill(?: b| c)?", {"-2": "2(?: 0)?", "-2.1": "2 1"}, ["cecill 2 1"], []),
    ("artistic", "artistic lic", rf"artistic {L}", {"-1": "1(?: 0)?", "-2": "2(?: 0)?"}, ["artistic 2 0"], []),
    ("zlib", "zlib", rf"zlib(?: libpng)? {L}", {}, ["zlib"], ["in no event will the authors be held liable for any damages arising from the use of this software"]),
    ("boost", "boost software", rf"boost software {L}", {"-1": "1(?: 0)?"}, [], []),
    ("boost", "bsl", "bsl", {"-1": "1(?: 0)?"}, ["bsl 1 0"], []),
    ("busl", "business source", rf"business source {L}", {"-1.1": "1 1"}, ["busl 1 1"], []),
    ("sspl", "server side public", rf"server side public {L}", {"-1": "1(?: 0)?"}, ["sspl 1 0"], []),
    ("elastic", "elastic lic", rf"elastic {L}", {"-2": "2(?: 0)?"}, ["elastic 2 0"], []),
    ("unlicense", "unlicense", "(?:the )?unlicense", {}, ["unlicense"], ["this is free and unencumbered software released into the public domain"]),
    ("wtfpl", "wtfpl", "wtfpl", {"-2": "2"}, ["wtfpl"], []),
    ("python", "python software", rf"python software foundation {L}", {"-2": "2(?: 0)?"}, ["python 2 0"], []),
    ("php", "php lic", rf"php {L}", {"-3": "3(?: 0)?", "-3.01": "3 01"}, ["php 3 01"], []),
    ("ruby", "ruby lic", rf"ruby {L}", {}, [], []),
    ("perl", "same terms as perl", "same terms as perl(?: itself)?", {}, [], []),
    ("openssl", "openssl lic", rf"openssl {L}", {}, [], []),
    ("postgresql", "postgresql lic", rf"postgresql {L}", {}, [], []),
    ("ncsa", "ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {L}", {}, ["ncsa"], []),
    ("afl", "academic free", rf"academic free {L}", {"-2.1": "2 1", "-3": "3(?: 0)?"}, ["afl 3 0"], []),
    ("osl", "open software lic", rf"open software {L}", {"-2": "2(?: 0)?", "-3": "3(?: 0)?"}, ["osl 3 0"], []),
    ("ofl", "open font", rf"(?:sil )?open font {L}", {"-1": "1(?: 0)?", "-1.1": "1 1"}, ["ofl 1 1"], []),
    ("odbl", "open database lic", rf"open (?:data commons open )?database {L}", {"-1": "1(?: 0)?"}, ["odbl 1 0"], []),
    ("ogl", "open government", rf"open government {L}", {"-1": "1(?: 0)?", "-2": "2(?: 0)?", "-3": "3(?: 0)?"}, [], []),
    ("ms-pl", "microsoft public", rf"microsoft public {L}", {}, ["ms pl"], []),
    ("ms-rl", "microsoft reciprocal", rf"microsoft reciprocal {L}", {}, ["ms rl"], []),
    ("apsl", "apple public", rf"apple public source {L}", {"-2": "2(?: 0)?"}, ["apsl 2 0"], []),
    ("ipl", "ibm public", rf"ibm public {L}", {"-1": "1(?: 0)?"}, ["ipl 1 0"], []),
    ("qpl", "q public", rf"q public {L}", {"-1": "1(?: 0)?"}, ["qpl 1 0"], []),
    ("sleepycat", "sleepycat", rf"sleepycat {L}", {}, ["sleepycat"], []),
    ("vim", "vim lic", rf"vim {L}", {}, [], []),
    ("upl", "universal permissive", rf"universal permissive {L}", {"-1": "1(?: 0)?"}, ["upl 1 0"], []),
    ("cc0", "cc0", r"cc0", {"-1": "1 0"}, ["cc0 1 0"], ["no rights reserved"]),
    ("cc-by-nc-nd", "by nc nd", r"cc by nc nd", {"-2": "2 [05]", "-3": "3 0", "-4": "4 0"}, ["cc by nc nd 4 0"], []),
    ("cc-by-nc-sa", "by nc sa", r"cc by nc sa", {"-2": "2 [05]", "-3": "3 0", "-4": "4 0"}, ["cc by nc sa 4 0"], []),
    ("cc-by-nc", "by nc", r"cc by nc", {"-2": "2 [05]", "-3": "3 0", "-4": "4 0"}, ["cc by nc 4 0"], []),
    ("cc-by-nd", "by nd", r"cc by nd", {"-2": "2 [05]", "-3": "3 0", "-4": "4 0"}, ["cc by nd 4 0"], []),
    ("cc-by-sa", "by sa", r"cc by sa", {"-2": "2 [05]", "-3": "3 0", "-4": "4 0"}, ["cc by sa 4 0"], []),
    ("cc-by", "cc by", r"cc by", {"-2": "2 [05]", "-3": "3 0", "-4": "4 0"}, ["cc by 4 0"], []),
    ("cc-by-nc-sa", "creative commons", rf"creative commons attribution non ?commercial share ?alike(?: {L})?", {"-3": "3 0", "-4": "4 0"}, [], []),
    ("cc-by-nc-nd", "creative commons", rf"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: {L})?", {"-3": "3 0", "-4": "4 0"}, [], []),
    ("cc-by-nc", "creative commons", rf"creative commons attribution non ?commercial(?: {L})?", {"-3": "3 0", "-4": "4 0"}, [], []),
    ("cc-by-sa", "creative commons", rf"creative commons attribution share ?alike(?: {L})?", {"-3": "3 0", "-4": "4 0"}, [], []),
    ("cc-by", "creative commons", rf"creative commons attribution(?: {L})?", {"-3": "3 0", "-4": "4 0"}, [], []),
    ("cc0", "creative commons", r"creative commons zero", {"-1": "1 0"}, [], []),
    ("creative-commons", "creative commons", rf"creative commons {L}", {}, [], []),
    ("public-domain", "public domain", r"public domain", {}, [], ["dedicated to the public domain", "released into the public domain", "placed in the public domain", "is in the public domain"]),
    ("proprietary", "all rights", r"all rights reserved", {}, [], ["proprietary and confidential all rights reserved"]),
    ("proprietary", "proprietary lic", rf"proprietary {L}", {}, [], []),
    ("no-redistribution", "redistribution is", r"redistribution is (?:strictly )?(?:prohibited|forbidden|not permitted)", {}, [], []),
]

#: Each rule's text holds a word that begins with one of these; a text without any has no detection.
STEMS = ["licen", "unlicense", "apache", "gnu", "gpl", "lgpl", "agpl", "gfdl", "bsd", "mpl", "epl", "eupl", "cddl", "cecill", "mozilla", "cc", "creative", "public", "permission", "redistribution", "copyright", "rights", "spdx", "bsl", "busl", "sspl", "wtfpl", "zlib", "terms", "ncsa", "mit", "event", "remote", "invariant", "source"]
#: Stems that occur in ordinary prose of some language; a rule's keyword with that word says more.
STEMS_WEAK = {"mit": "mit (?:no|modern|lic)", "terms": "terms (?:as perl|of the gnu)", "public": "public (?:domain|license|licence|source)", "event": "event will the authors", "remote": "remote network", "source": "source (?:lic|and binary|code form)", "permission": "permission (?:is hereby|to use copy)"}

GRANT = r"(?:licensed|released|distributed|available|published|provided|covered|governed|issued|offered|shared) (?:under|by|as)(?: the)?(?: terms of(?: the)?)? "


def build() -> list[Rule]:
    """All rules in their order: base phrases, identifiers, grants, texts, names with versions, bare names."""
    out = list(BASE)
    for label, keyword, name, versions, identifiers, phrases in FAMILIES:
        for x in identifiers:
            digits = x.split()
            suffix = next((s for s in sorted(versions, key=len, reverse=True) if s[1:].split(".")[0] in digits), "")
            out.append(Rule(label + suffix, keyword if keyword in x else x, f"spdx license identifier {x}(?: only| or later)?", 0, 1.0))
        for suffix, version in versions.items():
            out.append(Rule(label + suffix, keyword, f"{GRANT}{name}(?: {L})?(?: version| v)? v?{version}", 1, 0.98))
            out.append(Rule(label + suffix, keyword, f"{name}(?: {L})?(?: version| v)? v?{version}(?: or(?: any)? later)?", 2, 0.9))
        out.append(Rule(label, keyword, f"{GRANT}{name}", 1 if not versions else 2, 0.95 if not versions else 0.8))
        for x in phrases:
            out.append(Rule(label, keyword if keyword in x else " ".join(x.split()[:3]).replace("\\", ""), x, 1, 0.97))
        out.append(Rule(label, keyword, name, 3, 0.6))
    return out


RULES = build()
