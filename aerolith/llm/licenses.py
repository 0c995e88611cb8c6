"""License scans by ordered signature rules, in DataFrame operations only.

The text is lower-cased, and its words are runs of digits, a-z and characters above
ASCII. The words are joined with spaces, each word between two of its own, so that
neighbouring matches never share one. Rules are regular expressions over whole words,
each with a keyword that the text must contain before the expression is tried, a
priority (smaller is better) and a confidence. All places of all rules give intervals
of words; an interval is suppressed when an interval of a better detection (smaller
priority, then longer, then smaller rule id) contains it. The labels are those of the
intervals left, with the labels of the base phrases, which always stay.

Everything is computed row by row inside the scan: there is no shuffle, and no other
row is needed. Defined cases: null and empty texts have no words and no labels;
repeated rows and null doc_ids each give their row; a text of any length is scanned
whole; equal intervals of equal priority go to the smaller rule id; an empty table gives
no rows; extra columns aren't read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import lower_ascii

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Families: label, name (a regular expression over words), keyword, versions.
FAMILIES = (
    ("apache", "apache( software)?", "apache", ("1 0", "1 1", "2", "2 0")),
    ("gpl", "(gnu general public|gnu gpl|gpl|general public)", "gpl|general", ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("lgpl", "(gnu (lesser|library) general public|gnu lgpl|lgpl)", "lgpl|lesser|library", ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", "(gnu affero general public|gnu agpl|agpl|affero general public)", "agpl|affero", ("1", "1 0", "3", "3 0")),
    ("fdl", "gnu free documentation", "documentation", ("1 1", "1 2", "1 3")),
    ("mpl", "(mozilla public|mpl)", "mozilla|mpl", ("1 0", "1 1", "2 0")),
    ("epl", "(eclipse public|epl)", "eclipse|epl", ("1 0", "2 0")),
    ("cddl", "(common development and distribution|cddl)", "distribution|cddl", ("1 0", "1 1")),
    ("eupl", "(european union public|eupl)", "european|eupl", ("1 0", "1 1", "1 2")),
    ("cc-by-nc-sa", "(creative commons attribution noncommercial sharealike|cc by nc sa)", "commons|cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "(creative commons attribution noncommercial noderivatives|cc by nc nd)", "commons|cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "(creative commons attribution non ?commercial|cc by nc)", "commons|cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "(creative commons attribution share ?alike|cc by sa)", "commons|cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "(creative commons attribution no ?derivatives|cc by nd)", "commons|cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "(creative commons attribution|cc by)", "commons|cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc0", "(creative commons zero|cc0)", "commons|cc0", ("1 0",)),
    ("bsd-2", "(bsd 2 clause|simplified bsd|freebsd)", "bsd|freebsd", ()),
    ("bsd-3", "(bsd 3 clause|new bsd|modified bsd|revised bsd)", "bsd", ()),
    ("bsd-4", "(bsd 4 clause|original bsd)", "bsd", ()),
    ("bsd", "bsd", "bsd", ()),
    ("mit", "(mit|expat)", "mit|expat", ()),
    ("isc", "isc", "isc", ()),
    ("zlib", "zlib", "zlib", ()),
    ("x11", "x11", "x11", ()),
    ("ncsa", "(ncsa|university of illinois open source)", "ncsa|illinois", ()),
    ("artistic", "artistic", "artistic", ("1 0", "2 0")),
    ("boost", "boost software", "boost", ("1 0",)),
    ("postgresql", "postgresql", "postgresql", ()),
    ("python", "python software foundation", "python", ("2", "2 0")),
    ("php", "php", "php", ("3 0", "3 01")),
    ("openssl", "openssl", "openssl", ()),
    ("ofl", "(sil open font|open font)", "font", ("1 0", "1 1")),
    ("ms-pl", "microsoft public", "microsoft", ()),
    ("ms-rl", "microsoft reciprocal", "microsoft", ()),
    ("ecl", "educational community", "educational", ("1 0", "2 0")),
    ("afl", "academic free", "academic", ("2 0", "2 1", "3 0")),
    ("osl", "open software", "open", ("2 0", "2 1", "3 0")),
    ("lppl", "latex project public", "latex", ("1 0", "1 2", "1 3")),
    ("sspl", "server side public", "server", ("1",)),
    ("busl", "business source", "business", ("1 1",)),
    ("elastic", "elastic", "elastic", ("2 0",)),
    ("odbl", "(open database|open data commons open database)", "database", ("1 0",)),
    ("vim", "vim", "vim", ()),
    ("cecill", "cecill", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("ipl", "ibm public", "ibm", ("1 0",)),
    ("cpl", "common public", "common", ("1 0",)),
    ("qpl", "q public", "q", ("1 0",)),
    ("zpl", "zope public", "zope", ("1 1", "2 0", "2 1")),
    ("upl", "universal permissive", "universal", ("1 0",)),
    ("wtfpl", "(wtfpl|do what the fuck you want to public)", "wtfpl|fuck", ("2",)),
    ("json", "json", "json", ()),
    ("unicode", "unicode", "unicode", ()),
)

#: Signatures written by hand: label, expression, keyword, priority, confidence. Wordings of licenses and notices.
SIGNATURES = (
    # MIT and its kin
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission", 5, 1.0),
    ("mit", "to deal in the software without restriction", "restriction", 8, 0.95),
    ("mit", "rights to use copy modify merge publish distribute sublicense and or sell copies", "sublicense", 8, 0.95),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "notice", 8, 0.9),
    ("mit", "in no event shall the authors or copyright holders be liable", "liable", 9, 0.8),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", "furnished", 4, 1.0),
    ("mit-0", "mit no attribution", "attribution", 6, 0.9),
    ("mit-modern", "mit licen[cs]e modern variant", "modern", 6, 0.9),
    ("x11", "except as contained in this notice the name", "contained", 7, 0.8),
    ("x11", "name of the x consortium", "consortium", 6, 0.9),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission", 5, 1.0),
    ("isc", "with or without fee is hereby granted provided that the above copyright notice", "fee", 8, 0.85),
    ("isc", "the author disclaims all warranties with regard to this software", "disclaims", 9, 0.8),
    ("0bsd", "zero clause bsd", "bsd", 6, 0.95),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose", "documentation", 6, 0.9),
    ("hpnd", "historical permission notice and disclaimer", "historical", 6, 0.95),
    ("ntp", "makes no representations about the suitability", "suitability", 9, 0.7),
    # BSD
    ("bsd", "redistribution and use in source and binary forms", "redistribution", 6, 0.95),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions", 8, 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions", 8, 0.9),
    ("bsd", "this software is provided by the copyright holders and contributors as is", "contributors", 9, 0.8),
    ("bsd", "this software is provided by the (regents|author|authors) (and contributors )?as is", "regents|author|authors", 9, 0.8),
    ("bsd-3", "neither the name of ([^ ]+ ){1,8}nor the names of its contributors", "contributors", 7, 0.95),
    ("bsd-3", "may be used to endorse or promote products derived from this software", "endorse", 8, 0.9),
    ("bsd-4", "all advertising materials mentioning features or use of this software", "advertising", 6, 0.95),
    ("bsd-4", "must display the following acknowledge?ment", "acknowledgement|acknowledgment", 8, 0.85),
    ("bsd-patent", "bsd 2 clause plus patent", "patent", 5, 0.95),
    ("bsd-clear", "clear bsd", "bsd", 6, 0.9),
    ("bsd", "berkeley software distribution", "berkeley", 20, 0.6),
    ("bsd", "the regents of the university of california", "regents", 12, 0.7),
    ("bsd-protection", "bsd protection licen[cs]e", "bsd", 6, 0.9),
    # GNU
    ("gpl", "this program is free software you can redistribute it and or modify it", "redistribute", 6, 0.9),
    ("gpl", "under the terms of the gnu general public licen[cs]e", "gnu", 7, 0.95),
    ("gpl", "as published by the free software foundation", "foundation", 9, 0.8),
    ("gpl", "either version [123] of the licen[cs]e or at your option any later version", "option", 8, 0.9),
    ("gpl", "you should have received a copy of the gnu general public licen[cs]e", "gnu", 8, 0.9),
    ("gpl", "this program is distributed in the hope that it will be useful", "hope", 8, 0.85),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies", "verbatim", 9, 0.8),
    ("gpl", "gnu gpl compatible", "gnu", 25, 0.6),
    ("gpl", "gnu licen[cs]e", "gnu", 35, 0.6),
    ("gpl", "licence publique générale gnu", "gnu", 20, 0.8),
    ("gpl", "licencia pública general de gnu", "gnu", 20, 0.8),
    ("gpl", "allgemeine öffentliche gnu lizenz", "gnu", 20, 0.8),
    ("gpl-linking-exception", "as a special exception the copyright holders ([^ ]+ ){0,8}link", "exception", 7, 0.8),
    ("gpl-classpath-exception", "classpath exception", "classpath", 7, 0.9),
    ("gpl-gcc-exception", "gcc runtime library exception", "gcc", 7, 0.9),
    ("gpl-font-exception", "font exception", "font", 15, 0.6),
    ("gpl-autoconf-exception", "autoconf (configure script )?exception", "autoconf", 7, 0.8),
    ("gpl-bison-exception", "bison (parser )?exception", "bison", 7, 0.8),
    ("gpl-linux-syscall-note", "linux syscall note", "syscall", 6, 0.9),
    ("lgpl", "this library is free software you can redistribute it", "library", 6, 0.95),
    ("lgpl", "under the terms of the gnu (lesser|library) general public licen[cs]e", "lesser|library", 6, 0.95),
    ("lgpl", "you should have received a copy of the gnu (lesser|library) general public licen[cs]e", "lesser|library", 7, 0.9),
    ("agpl", "under the terms of the gnu affero general public licen[cs]e", "affero", 6, 0.95),
    ("agpl", "you should have received a copy of the gnu affero general public licen[cs]e", "affero", 7, 0.9),
    ("fdl", "permission is granted to copy distribute and or modify this document", "permission", 6, 0.95),
    ("fdl", "with no invariant sections no front cover texts and no back cover texts", "invariant", 7, 0.9),
    ("fdl", "gnu fdl", "gnu", 20, 0.8),
    ("gnu-all-permissive", "copying and distribution of this file with or without modification are permitted in any medium", "medium", 6, 0.95),
    ("fsf-unlimited", "the free software foundation gives unlimited permission to copy", "unlimited", 6, 0.95),
    ("copyleft", "copyleft", "copyleft", 60, 0.4),
    # Apache
    ("apache", "licensed under the apache licen[cs]e", "apache", 6, 0.95),
    ("apache", "you may not use this file except in compliance with the licen[cs]e", "compliance", 8, 0.9),
    ("apache", "you may obtain a copy of the licen[cs]e at", "obtain", 12, 0.7),
    ("apache", "unless required by applicable law or agreed to in writing software", "applicable", 9, 0.85),
    ("apache", "www apache org licenses licen[cs]e 2 0", "apache", 6, 0.95),
    ("apache", "licensed to the apache software foundation asf", "asf", 6, 0.95),
    ("apache", "apache software foundation", "apache", 30, 0.6),
    ("llvm-exception", "llvm exceptions?", "llvm", 6, 0.9),
    # Mozilla, Eclipse, Sun, IBM
    ("mpl", "this source code form is subject to the terms of the mozilla public licen[cs]e", "mozilla", 5, 1.0),
    ("mpl", "the contents of this file are subject to the mozilla public licen[cs]e", "mozilla", 5, 0.95),
    ("mpl", "if a copy of the mpl was not distributed with this file", "mpl", 6, 0.95),
    ("mpl-tri", "alternatively the contents of this file may be used under the terms of", "alternatively", 9, 0.7),
    ("npl", "netscape public licen[cs]e", "netscape", 10, 0.95),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse", "eclipse", 5, 1.0),
    ("edl", "eclipse distribution licen[cs]e", "eclipse", 10, 0.9),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "development", 5, 1.0),
    ("sissl", "sun industry standards source licen[cs]e", "sun", 10, 0.95),
    ("spl", "sun public licen[cs]e", "sun", 10, 0.9),
    ("bcl", "binary code licen[cs]e agreement", "binary", 15, 0.8),
    ("otn", "oracle technology network licen[cs]e", "oracle", 10, 0.9),
    ("intel", "intel simplified software licen[cs]e", "intel", 10, 0.9),
    ("nvidia", "nvidia (software )?licen[cs]e", "nvidia", 15, 0.8),
    ("apple", "apple public source licen[cs]e", "apple", 10, 0.95),
    ("apple", "apple sample code licen[cs]e", "apple", 10, 0.8),
    ("apple", "apple mit licen[cs]e", "apple", 10, 0.8),
    ("rpsl", "realnetworks public source licen[cs]e", "realnetworks", 10, 0.95),
    ("nokia", "nokia open source licen[cs]e", "nokia", 10, 0.9),
    ("motosoto", "motosoto open source licen[cs]e", "motosoto", 10, 0.9),
    ("ricoh", "ricoh source code public licen[cs]e", "ricoh", 10, 0.9),
    ("lucent", "lucent public licen[cs]e", "lucent", 10, 0.9),
    ("sgi", "sgi free software licen[cs]e", "sgi", 10, 0.9),
    ("w3c", "w3c software (notice and )?licen[cs]e", "w3c", 10, 0.9),
    ("w3c", "w3c document licen[cs]e", "w3c", 10, 0.9),
    ("oasis", "oasis intellectual property rights policy", "oasis", 20, 0.6),
    ("ietf", "ietf trust legal provisions", "ietf", 15, 0.8),
    # other open licenses
    ("zlib", "this software is provided as is without any express or implied warranty", "warranty", 7, 0.8),
    ("zlib", "the origin of this software must not be misrepresented", "misrepresented", 6, 0.95),
    ("zlib", "altered source versions must be plainly marked as such", "altered", 7, 0.9),
    ("libpng", "libpng licen[cs]e", "libpng", 10, 0.9),
    ("libtiff", "libtiff licen[cs]e", "libtiff", 10, 0.9),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "jpeg", 6, 0.95),
    ("freetype", "freetype (project )?licen[cs]e", "freetype", 10, 0.9),
    ("imagemagick", "imagemagick licen[cs]e", "imagemagick", 10, 0.9),
    ("curl", "curl licen[cs]e", "curl", 15, 0.8),
    ("bzip2", "bzip2 licen[cs]e", "bzip2", 10, 0.9),
    ("info-zip", "info zip licen[cs]e", "zip", 12, 0.8),
    ("icu", "icu licen[cs]e", "icu", 12, 0.8),
    ("boost", "boost software licen[cs]e version 1 0", "boost", 5, 1.0),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy", "organization", 5, 1.0),
    ("artistic", "the clarified artistic licen[cs]e", "clarified", 8, 0.9),
    ("artistic", "under the same terms as perl( itself)?", "perl", 8, 0.9),
    ("python", "psf licen[cs]e( agreement)?", "psf", 10, 0.9),
    ("python", "cnri (python )?open source licen[cs]e", "cnri", 10, 0.9),
    ("ruby", "ruby licen[cs]e", "ruby", 12, 0.8),
    ("tcl", "tcl tk licen[cs]e", "tcl", 10, 0.8),
    ("openldap", "openldap public licen[cs]e", "openldap", 10, 0.95),
    ("openssl", "this product includes software developed by the openssl project", "openssl", 6, 0.95),
    ("openssl", "this product includes cryptographic software written by eric young", "cryptographic", 7, 0.9),
    ("sleepycat", "sleepycat (public )?licen[cs]e", "sleepycat", 10, 0.95),
    ("postgresql", "postgresql licen[cs]e", "postgresql", 10, 0.9),
    ("mulan", "mulan (permissive|public) (software )?licen[cs]e", "mulan", 10, 0.95),
    ("blueoak", "blue oak model licen[cs]e", "oak", 10, 0.95),
    ("parity", "parity public licen[cs]e", "parity", 10, 0.95),
    ("cpal", "common public attribution licen[cs]e", "attribution", 9, 0.95),
    ("rpl", "reciprocal public licen[cs]e", "reciprocal", 10, 0.95),
    ("osl", "licensed under the open software licen[cs]e", "open", 8, 0.95),
    ("watcom", "sybase open watcom public licen[cs]e", "watcom", 8, 0.95),
    ("nasa", "nasa open source agreement", "nasa", 8, 0.95),
    ("ogl", "open government licen[cs]e", "government", 10, 0.95),
    ("ogl", "contains public sector information licensed under", "sector", 10, 0.9),
    ("etalab", "licence ouverte", "ouverte", 15, 0.8),
    ("dl-de", "datenlizenz deutschland", "datenlizenz", 10, 0.95),
    ("eupl", "licensed under the eupl", "eupl", 8, 0.95),
    ("cecill", "licence de logiciel libre cecill", "cecill", 8, 0.95),
    ("cern-ohl", "cern open hardware licen[cs]e", "cern", 8, 0.95),
    ("solderpad", "solderpad hardware licen[cs]e", "solderpad", 8, 0.95),
    ("tapr", "tapr open hardware licen[cs]e", "tapr", 8, 0.95),
    ("beerware", "the beer ?ware licen[cs]e", "beerware|beer", 8, 0.95),
    ("beerware", "you can buy me a beer in return", "beer", 8, 0.95),
    ("wtfpl", "you just do what the fuck you want to", "fuck", 7, 0.95),
    ("jsonlicense", "the software shall be used for good not evil", "evil", 6, 0.95),
    ("hippocratic", "hippocratic licen[cs]e", "hippocratic", 10, 0.9),
    ("anti996", "anti 996 licen[cs]e", "anti", 10, 0.9),
    ("sqlite", "in place of a legal notice here is a blessing", "blessing", 6, 0.95),
    ("ofl", "this font software is licensed under the sil open font licen[cs]e", "font", 5, 1.0),
    ("ofl", "reserved font name", "font", 12, 0.8),
    ("bitstream-vera", "bitstream vera fonts copyright", "bitstream", 8, 0.9),
    ("ubuntu-font", "ubuntu font licen[cs]e", "ubuntu", 8, 0.95),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public licen[cs]e", "latex", 5, 1.0),
    # Creative Commons and public domain
    ("cc", "this work is licensed under a creative commons", "commons", 15, 0.85),
    ("cc", "some rights reserved", "rights", 40, 0.5),
    ("cc", "creativecommons org licenses", "creativecommons", 15, 0.85),
    ("cc-by-sa", "text is available under the creative commons attribution sharealike licen[cs]e", "commons", 6, 0.95),
    ("cc-by", "licence creative commons attribution", "commons", 15, 0.85),
    ("cc-by", "lizenz creative commons namensnennung", "commons", 15, 0.85),
    ("cc-by", "licencia creative commons (reconocimiento|atribución)", "commons", 15, 0.85),
    ("cc0", "to the extent possible under law ([^ ]+ ){0,8}has waived all copyright", "waived", 6, 0.95),
    ("cc0", "creativecommons org publicdomain zero", "creativecommons", 6, 0.95),
    ("cc0", "cc zero", "cc", 20, 0.8),
    ("pdm", "public domain mark", "domain", 20, 0.8),
    ("pddl", "public domain dedication and licen[cs]e", "dedication", 8, 0.95),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 5, 1.0),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "compile", 6, 0.95),
    ("public-domain", "(released into|dedicated to|placed in|in) the public domain", "domain", 50, 0.6),
    ("public-domain", "no copyright is claimed", "claimed", 50, 0.6),
    ("public-domain", "not subject to copyright protection in the united states", "protection", 45, 0.7),
    ("public-domain", "domaine public", "domaine", 55, 0.5),
    ("public-domain", "dominio público", "dominio", 55, 0.5),
    ("public-domain", "gemeinfrei", "gemeinfrei", 55, 0.5),
    ("odc-by", "open data commons attribution licen[cs]e", "commons", 8, 0.95),
    ("odbl", "open database licen[cs]e", "database", 10, 0.95),
    ("cdla", "community data licen[cs]e agreement", "community", 10, 0.95),
    # models and data
    ("rail", "(open ?rail|responsible ai) licen[cs]e", "rail|openrail|responsible", 10, 0.9),
    ("llama", "llama ([0-9] ){0,2}community licen[cs]e( agreement)?", "llama", 10, 0.95),
    ("gemma", "gemma terms of use", "gemma", 10, 0.9),
    ("research-only", "for (non ?commercial )?research purposes only", "research", 40, 0.7),
    ("non-commercial", "for non ?commercial (use|purposes)( only)?", "commercial|noncommercial", 42, 0.7),
    ("non-commercial", "not for commercial use", "commercial", 42, 0.7),
    ("non-commercial", "polyform noncommercial licen[cs]e", "polyform", 10, 0.95),
    ("polyform", "polyform (shield|strict|small business|perimeter|free trial|internal use) licen[cs]e", "polyform", 10, 0.95),
    ("commons-clause", "commons clause licen[cs]e condition", "clause", 8, 0.95),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "licensor", 6, 0.95),
    ("sspl", "server side public licen[cs]e", "server", 8, 0.95),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service", "hosted", 6, 0.95),
    ("confluent", "confluent community licen[cs]e", "confluent", 8, 0.95),
    ("redis", "redis source available licen[cs]e", "redis", 8, 0.95),
    ("fair-source", "fair (source|core) licen[cs]e", "fair", 10, 0.9),
    # proprietary notices, disclaimers
    ("no-warranty", "without warranty of any kind", "warranty", 60, 0.4),
    ("no-warranty", "without even the implied warranty", "implied", 60, 0.4),
    ("no-warranty", "without warranties or conditions of any kind", "conditions", 60, 0.4),
    ("no-warranty", "(merchantability|fitness for a particular purpose)", "merchantability|fitness", 61, 0.4),
    ("no-warranty", "provided as is", "provided", 62, 0.3),
    ("no-liability", "in no event (shall|will) ([^ ]+ ){1,8}be liable", "liable", 61, 0.4),
    ("eula", "end user licen[cs]e agreement", "user", 20, 0.8),
    ("eula", "by (installing|downloading|using) (this|the) software you agree", "agree", 25, 0.7),
    ("eula", "you may not reverse engineer decompile or disassemble", "reverse", 25, 0.7),
    ("trial", "evaluation (copy|licen[cs]e|version)", "evaluation", 45, 0.5),
    ("shareware", "shareware", "shareware", 45, 0.5),
    ("freeware", "freeware", "freeware", 45, 0.5),
    ("proprietary", "(proprietary and confidential|confidential and proprietary)", "proprietary", 55, 0.5),
    ("proprietary", "unauthorized (copying|use|distribution|reproduction)", "unauthorized", 56, 0.5),
    ("proprietary", "strictly prohibited", "prohibited", 58, 0.3),
    ("proprietary", "trade secrets? of", "trade", 56, 0.5),
    ("proprietary", "not to be (copied|reproduced|distributed) without", "reproduced|copied|distributed", 56, 0.5),
    ("proprietary", "no part of this (publication|book|document|work) may be reproduced", "reproduced", 50, 0.7),
    ("proprietary", "nur für den internen gebrauch", "internen", 56, 0.5),
    ("proprietary", "toute reproduction (même partielle )?(est )?interdite", "reproduction", 56, 0.5),
    ("proprietary", "reproduction interdite", "reproduction", 57, 0.5),
    ("proprietary", "prohibida (su|la) reproducción", "prohibida", 56, 0.5),
    ("proprietary", "vervielfältigung (nur mit genehmigung|verboten)", "vervielfältigung", 56, 0.5),
    ("patent", "patent(s)? pending", "pending", 65, 0.3),
    ("patent", "protected by (one or more )?patents?", "protected", 65, 0.3),
    ("trademark", "(is a|are) (registered )?trademarks? of", "trademark|trademarks", 66, 0.3),
    ("dual", "dual licensed under", "dual", 30, 0.6),
    ("dual", "licensed under either of", "either", 30, 0.6),
    ("copyright", "copyright( c)? (19|20)[0-9][0-9]", "copyright", 70, 0.3),
    ("copyright", "copyright( c)? by", "copyright", 71, 0.3),
    ("copyright", "copyrighted (by|material|work)", "copyrighted", 72, 0.3),
    ("copyright", "© (19|20)[0-9][0-9]", "©", 72, 0.3),
    ("reserved", "all rights reserved", "rights", 65, 0.5),
    ("reserved", "tous droits réservés", "droits", 65, 0.5),
    ("reserved", "tous droits de reproduction réservés", "droits", 65, 0.5),
    ("reserved", "alle rechte vorbehalten", "rechte", 65, 0.5),
    ("reserved", "todos los derechos reservados", "derechos", 65, 0.5),
    ("reserved", "reservados todos los derechos", "derechos", 65, 0.5),
    ("reserved", "tutti i diritti riservati", "diritti", 65, 0.5),
    ("reserved", "todos os direitos reservados", "direitos", 65, 0.5),
    ("reserved", "alle rechten voorbehouden", "rechten", 65, 0.5),
    ("reserved", "wszelkie prawa zastrzeżone", "prawa", 65, 0.5),
    ("reserved", "все права защищены", "права", 65, 0.5),
)

#: Families whose name alone may take a version ("gpl 3"); other names need "license" or "version".
COMPACT = ("gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "eupl", "cc-by-nc-sa", "cc-by-nc-nd", "cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by", "cc0")


def doubled(pattern: str) -> str:
    """An expression over words, for text in which each word stands between two spaces of its own."""
    return f" {pattern.replace(' ', '  ').replace('  ?', '(  )?')} "


def _rules() -> list[dict]:
    """A family gives a rule for each version and form, and two for its bare name."""
    rules: list[tuple] = list(SIGNATURES)
    licence = "licen[cs]e"
    for label, name, keyword, versions in FAMILIES:
        rules.append((label, f"(licensed|released|distributed|available) under (the |a )?{name}( {licence})?", keyword, 30, 0.8))
        rules.append((label, f"(the )?{name} {licence}", keyword, 40, 0.7))
        rules.append((label, f"spdx {licence} identifier {name}", keyword, 2, 1.0))
        for version in versions:
            rules.append((label, f"(licensed|released|distributed|available) under (the |a )?{name}( {licence})?( version| v)? v?{version}( or later)?", keyword, 10, 0.95))
            bare = f"( {licence})?( version| v)? v?{version}" if label in COMPACT else f"( {licence}( version| v)? v?{version}| version {version})"
            rules.append((label, f"{name}{bare}( or later| or any later version)?", keyword, 20, 0.9))
    return [{"id": i, "label": r[0], "pattern": doubled(r[1]), "marking": f" ({doubled(r[1])[1:-1]}) ", "keywords": r[2].split("|"), "priority": r[3], "confidence": r[4]} for i, r in enumerate(rules)]


RULES = _rules()
KEYWORDS = sorted({k for r in RULES for k in r["keywords"]})
#: No match of a rule has more words than this.
LONGEST = 128
BLOCK_WORDS, FEW = 512, 128
_MARK = "\x01"  # no word holds it
_RULE_TYPE = "array<struct<id:int,label:string,pattern:string,marking:string,keywords:array<string>,priority:int,confidence:double>>"


def normalised(text: Column) -> Column:
    """The words, joined with single spaces; empty for null."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


def _words(text: Column) -> Column:
    """Words in a piece of spaced text, where each word has two spaces."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("long")


def _places(spaced: Column, rule: Column) -> Column:
    """Intervals of words (s, e) of all matches: their starts are marked in the text, and the marks found among its words."""
    words = F.split(F.regexp_replace(spaced, rule["marking"], F.lit(f" {_MARK}$1 ")), "  ")
    starts = F.transform(F.array(words), lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.contains(F.get(w, i), F.lit(_MARK))))[0]
    spans = F.zip_with(starts, F.regexp_extract_all(spaced, rule["pattern"], F.lit(0)), lambda s, hit: F.struct(s.cast("long").alias("s"), (s + _words(hit)).alias("e")))
    return F.when(F.regexp_like(spaced, rule["pattern"]), spans).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))


def _detections(spaced: Column, hits: Column) -> Column:
    """All places of the rules that have one of the hit keywords."""
    rules = F.from_json(F.lit(json.dumps(RULES)), _RULE_TYPE)
    tried = F.filter(rules, lambda r: F.arrays_overlap(r["keywords"], hits))
    return F.flatten(
        F.transform(
            tried,
            lambda r: F.transform(
                _places(spaced, r),
                lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), r["priority"].alias("priority"), r["id"].alias("id"), r["label"].alias("label"), r["confidence"].alias("confidence")),
            ),
        )
    )


def _better(a: Column, b: Column) -> Column:
    longer, as_long = (a["e"] - a["s"]) > (b["e"] - b["s"]), (a["e"] - a["s"]) == (b["e"] - b["s"])
    return (a["priority"] < b["priority"]) | ((a["priority"] == b["priority"]) & (longer | (as_long & (a["id"] < b["id"]))))


def _unsuppressed(found: Column) -> Column:
    """The intervals that no interval of a better detection contains. Those of a long list are compared block by block of the text."""
    inside = lambda a, b: (a["s"] <= b["s"]) & (a["e"] >= b["e"])
    stays = lambda d, others: ~F.exists(others, lambda other: inside(other, d) & _better(other, d))

    def of_block(b: Column) -> Column:
        first = b * BLOCK_WORDS
        near = F.filter(found, lambda o: (o["s"] >= first - LONGEST) & (o["s"] < first + BLOCK_WORDS))
        return F.transform(F.array(near), lambda o: F.filter(o, lambda d: (d["s"] >= first) & stays(d, o)))[0]

    last = F.array_max(F.transform(found, lambda d: d["s"]))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor(last / BLOCK_WORDS).cast("long"))
    return F.when(F.size(found) <= FEW, F.filter(found, lambda d: stays(d, found))).otherwise(F.flatten(F.transform(blocks, of_block)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections for every row."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("spaced", F.concat(F.lit(" "), F.replace("norm", F.lit(" "), F.lit("  ")), F.lit(" ")))
    norm, spaced = F.col("norm"), F.col("spaced")
    rows = rows.withColumn("hits", F.array_intersect(F.lit(KEYWORDS), F.split("norm", " ")))
    none = F.lit(None).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        inner = f" {phrase.replace(' ', '  ')} "
        length = len(phrase.split(" "))
        hit = spaced.contains(inner)
        counts.append(F.when(hit, F.size(F.split(spaced, inner, -1)) - 1).otherwise(0).cast("long"))
        firsts.append(F.when(hit, _words(F.substring_index(spaced, inner, 1))).otherwise(none))
        lasts.append(F.when(hit, _words(spaced) - _words(F.substring_index(spaced, inner, -1)) - length).otherwise(none))
        labels.append(F.when(hit, F.lit(label)))
    rows = rows.select(
        "doc_id",
        F.when(norm == "", F.lit(0)).otherwise(_words(spaced)).cast("long").alias("n_words"),
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
        F.when(F.size("hits") > 0, _detections(spaced, F.col("hits"))).alias("found"),
    )
    rows = rows.withColumn("detections", F.when(F.size("found") > 0, _unsuppressed(F.col("found"))))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce(F.transform("detections", lambda d: d["label"]), F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        "detections",
    )
