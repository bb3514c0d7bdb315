"""Operator 2: license scan by ordered signature rules.

A text is lower-cased (A-Z), reduced to its words (runs of digits, letters and bytes beyond ASCII) joined by single
blanks, and searched by regular expressions over that form. Each rule has a keyword: only where the text has it does
the expression run. A detection is suppressed if its interval lies within that of a detection of higher priority, or
of equal priority and greater length. The three base phrases are counted in all places and never suppressed.

Defined results: a null or empty text has no words, no labels and score 0; ties between rules go to the earlier rule;
very long texts are scanned whole (every expression is linear in the text); repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table, texts

#: Phrases and labels that the contract of this operator fixes.
BASE = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}

#: Everything that is no word, as blanks; A-Z in lower case.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

FULL, NOTICE, NAME, TAG = 4, 3, 2, 1  # priorities: license text, notice, license name, short tag
CONFIDENCE = {FULL: 0.98, NOTICE: 0.95, NAME: 0.8, TAG: 0.7}
BASE_CONFIDENCE = 0.5

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long>>"


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: bytes
    pattern: str


#: Families with numbered versions: label stem, keyword, pattern of the name, versions.
VERSIONED = [
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", "1 2 3"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e", "2.1 3"),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[cs]e", "2 2.1"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "1 3"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", "1.1 1.2 1.3"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", "1.0 1.1 2.0"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", "1.0 1.1 2.0"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", "1.0 2.0"),
    ("cpl", "common public", r"common public licen[cs]e", "1.0"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", "1.0 1.1"),
    ("eupl", "european union", r"european union public licen[cs]e", "1.0 1.1 1.2"),
    ("osl", "open software", r"open software licen[cs]e", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "academic free", r"academic free licen[cs]e", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic", r"artistic licen[cs]e", "1.0 2.0"),
    ("cecill", "cecill", r"cecill (?:free software )?licen[cs]e", "1.0 1.1 2.0 2.1"),
    ("bsl", "boost", r"boost software licen[cs]e", "1.0"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", "1.0 1.1"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", "1.0"),
    ("busl", "business source", r"business source licen[cs]e", "1.0 1.1"),
    ("sspl", "server side public", r"server side public licen[cs]e", "1"),
    ("elastic", "elastic", r"elastic licen[cs]e", "1.0 2.0"),
    ("lppl", "latex", r"latex project public licen[cs]e", "1.0 1.1 1.2 1.3a 1.3c"),
    ("odbl", "open database", r"open database licen[cs]e", "1.0"),
    ("odc-by", "data commons", r"open data commons attribution licen[cs]e", "1.0"),
    ("ogl-uk", "open government", r"open government licen[cs]e", "1.0 2.0 3.0"),
    ("cdla-permissive", "community data", r"community data licen[cs]e agreement permissive", "1.0 2.0"),
    ("cdla-sharing", "community data", r"community data licen[cs]e agreement sharing", "1.0"),
    ("openldap", "openldap", r"openldap public licen[cs]e", "2.0 2.7 2.8"),
    ("zpl", "zope", r"zope public licen[cs]e", "1.1 2.0 2.1"),
    ("php", "php", r"php licen[cs]e", "3.0 3.01"),
    ("python", "python", r"python (?:software foundation )?licen[cs]e", "2.0"),
    ("mulan-psl", "mulan", r"mulan permissive software licen[cs]e", "1.0 2.0"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", "1.0"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", "1.0"),
    ("qpl", "q public", r"q public licen[cs]e", "1.0"),
    ("apsl", "apple public", r"apple public source licen[cs]e", "1.0 1.1 1.2 2.0"),
    ("cpal", "common public attribution", r"common public attribution licen[cs]e", "1.0"),
    ("rpl", "reciprocal public", r"reciprocal public licen[cs]e", "1.1 1.5"),
    ("spl", "sun public", r"sun public licen[cs]e", "1.0"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[cs]e", "1.0 2.0"),
    ("vim", "vim", r"vim licen[cs]e", "1.0"),
    ("openrail", "openrail", r"(?:creativeml )?openrail m(?: licen[cs]e)?", "1.0"),
]
#: Creative Commons: clause words between "by" and the version, versions, ported or not.
CC_CLAUSES = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

#: Rules that no parameter gives: label, priority, keyword, expression over the words.
WRITTEN = [
    ("mit", FULL, "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", FULL, "as is", r"the software is provided as is without warranty of any kind express or implied"),
    ("isc", FULL, "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd-3-clause", FULL, "endorse or promote", r"neither the names? of (?:\S+ ){1,12}may be used to endorse or promote products"),
    ("bsd-2-clause", FULL, "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice"),
    ("bsd-4-clause", FULL, "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", FULL, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("unlicense", FULL, "public domain", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", FULL, "do what the fuck", r"do what the fuck you want to public licen[cs]e"),
    ("gpl", FULL, "program is free software", r"this program is free software you can redistribute it and or modify it"),
    ("lgpl", FULL, "library is free software", r"this library is free software you can redistribute it and or modify it"),
    ("gpl", FULL, "everyone is permitted", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document"),
    ("apache-2.0", FULL, "apache org licenses", r"(?:http|https) www apache org licenses license 2 0"),
    ("apache-2.0", FULL, "in compliance with the licen", r"you may not use this file except in compliance with the licen[cs]e"),
    ("mpl-2.0", FULL, "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("cc0-1.0", FULL, "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("ofl-1.1", FULL, "font software", r"this font software is licensed under the sil open font licen[cs]e"),
    ("bsl-1.0", FULL, "machine executable", r"solely in the form of machine executable object code generated by a source language processor"),
    ("ncsa", NAME, "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    ("mit", NOTICE, "mit", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e"),
    ("mit", NAME, "mit", r"(?:the )?mit (?:open source )?licen[cs]e"),
    ("mit", TAG, "mit", r"(?:license|spdx license identifier) mit"),
    ("mit", NAME, "expat", r"expat licen[cs]e"),
    ("x11", NAME, "x11", r"x11 licen[cs]e"),
    ("isc", NAME, "isc", r"isc licen[cs]e"),
    ("bsd-0-clause", NAME, "bsd", r"(?:0|zero) clause bsd licen[cs]e"),
    ("bsd-2-clause", NAME, "bsd", r"(?:2|two) clause bsd licen[cs]e"),
    ("bsd-2-clause", NAME, "bsd", r"simplified bsd licen[cs]e"),
    ("bsd-3-clause", NAME, "bsd", r"(?:3|three) clause bsd licen[cs]e"),
    ("bsd-3-clause", NAME, "bsd", r"(?:new|revised|modified) bsd licen[cs]e"),
    ("bsd-4-clause", NAME, "bsd", r"(?:4|four) clause bsd licen[cs]e"),
    ("bsd", NOTICE, "bsd", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:a |the )?bsd licen[cs]e"),
    ("bsd", NAME, "bsd", r"bsd (?:style )?licen[cs]e"),
    ("bsd-2-clause", TAG, "bsd 2", r"bsd 2 clause"),
    ("bsd-3-clause", TAG, "bsd 3", r"bsd 3 clause"),
    ("zlib", NAME, "zlib", r"zlib (?:libpng )?licen[cs]e"),
    ("libpng", NAME, "libpng", r"libpng licen[cs]e"),
    ("unlicense", NAME, "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", TAG, "wtfpl", r"wtfpl"),
    ("postgresql", NAME, "postgresql", r"postgresql licen[cs]e"),
    ("openssl", NAME, "openssl", r"openssl licen[cs]e"),
    ("curl", NAME, "curl", r"curl licen[cs]e"),
    ("ruby", NAME, "ruby", r"ruby licen[cs]e"),
    ("beerware", NAME, "beer", r"beer ?ware licen[cs]e"),
    ("json", NAME, "json", r"json licen[cs]e"),
    ("json", FULL, "good not evil", r"the software shall be used for good not evil"),
    ("hippocratic", NAME, "hippocratic", r"hippocratic licen[cs]e"),
    ("llama-community", NAME, "community licen", r"llama (?:\d )?community licen[cs]e"),
    ("commons-clause", NAME, "commons clause", r"commons clause(?: licen[cs]e condition)?"),
    ("cc0-1.0", NAME, "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", NAME, "creative commons zero", r"creative commons zero(?: v1 0)?(?: universal)?"),
    ("cc-pdm", NAME, "public domain mark", r"(?:creative commons )?public domain mark(?: 1 0)?"),
    ("public-domain", NOTICE, "public domain", r"(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain"),
    ("public-domain", TAG, "public domain", r"public domain"),
    ("gpl", NOTICE, "gnu", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?gnu (?:general public licen[cs]e|gpl)"),
    ("lgpl", TAG, "lgpl", r"(?:gnu )?lgpl"),
    ("agpl", TAG, "agpl", r"(?:gnu )?agpl"),
    ("gpl", TAG, "gpl", r"(?:gnu )?gpl"),
    ("gfdl", TAG, "gfdl", r"(?:gnu )?gfdl"),
    ("mpl", TAG, "mpl", r"mpl(?: \d \d)?"),
    ("cc", NOTICE, "creative commons", r"(?:licensed|released|distributed|available|published) under (?:a |the )?creative commons licen[cs]e"),
    ("cc", NAME, "creative commons", r"creative commons(?: licen[cs]e)?"),
    ("cc-url", FULL, "creativecommons org", r"creativecommons org licenses (?:by|by nc|by nd|by sa|by nc nd|by nc sa) \d \d"),
    ("cc0-1.0", FULL, "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", FULL, "creativecommons org", r"creativecommons org publicdomain mark 1 0"),
    ("spdx", NOTICE, "spdx", r"spdx license identifier \S+(?: \S+)?"),
    ("reserved", NOTICE, "all rights", r"copyright (?:c )?(?:\d{4} )?(?:\S+ ){0,8}all rights reserved"),
    ("reserved", NAME, "rights", r"(?:all|some|no) rights reserved"),
    ("copyright", TAG, "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
    ("proprietary", NOTICE, "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", NOTICE, "prior written", r"without (?:the )?(?:express )?prior written (?:permission|consent)"),
    ("proprietary", NOTICE, "reproduced", r"no part of this (?:\S+ ){1,3}may be reproduced"),
    ("proprietary", NOTICE, "unauthori", r"unauthori[sz]ed (?:copying|redistribution)"),
    ("proprietary", NOTICE, "may not be redistributed", r"may not be redistributed"),
    ("proprietary", NAME, "end user", r"end user licen[cs]e agreement"),
    ("non-commercial", NOTICE, "commercial", r"(?:for )?non ?commercial (?:use|purposes) only"),
    ("research-only", NOTICE, "research", r"for (?:academic |non commercial )?research (?:use|purposes) only"),
    ("fair-use", TAG, "fair use", r"fair use"),
]


#: Clauses and notices by which a license shows itself without its name.
CLAUSES = [
    ("mit", FULL, "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", FULL, "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", FULL, "dealings in the software", r"arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit-0", FULL, "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("mit-advertising", FULL, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("x11", FULL, "x consortium", r"the name of the x consortium shall not be used in advertising"),
    ("isc", FULL, "author disclaims", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("bsd", FULL, "copyright holders and contributors", r"this software is provided by the copyright holders and contributors as is"),
    ("bsd", FULL, "regents", r"this software is provided by the regents and contributors as is"),
    ("bsd-3-clause", FULL, "without specific prior", r"used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause-clear", FULL, "no express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-views", FULL, "views and conclusions", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-1-clause", FULL, "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided"),
    ("zlib", FULL, "plainly marked", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib", FULL, "provided as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost", FULL, "boost", r"distributed under the boost software licen[cs]e version 1 0"),
    ("unlicense", FULL, "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", FULL, "you just do what", r"you just do what the fuck you want to"),
    ("apache-2.0", FULL, "derivative works of", r"reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work"),
    ("apache-2.0", FULL, "as defined by sections", r"license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9"),
    ("apache-2.0", FULL, "without warranties or conditions", r"distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-1.1", FULL, "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl", FULL, "without even the implied", r"but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", FULL, "should have received a copy", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", FULL, "should have received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", FULL, "should have received a copy", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl-2", FULL, "designed to take away", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", FULL, "free copyleft license", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", FULL, "term of copyright", r"all rights granted under this license are granted for the term of copyright on the program"),
    ("agpl-3", FULL, "remote network interaction", r"remote network interaction use with the gnu general public license"),
    ("agpl-3", FULL, "interacting with it remotely", r"prominently offer all users interacting with it remotely through a computer network"),
    ("lgpl-3", FULL, "additional permissions listed below", r"supplemented by the additional permissions listed below"),
    ("gfdl", FULL, "invariant sections", r"with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts"),
    ("gfdl", FULL, "invariant sections", r"with the invariant sections being"),
    ("gpl-classpath-exception", NOTICE, "linking this library", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-gcc-exception", NOTICE, "runtime library exception", r"gcc runtime library exception"),
    ("gpl-bison-exception", NOTICE, "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-font-exception", NOTICE, "font", r"if you create a document which uses this font and embed this font"),
    ("gpl-autoconf-exception", NOTICE, "configuration script generated by autoconf", r"part of a program that contains a configuration script generated by autoconf"),
    ("openssl-exception", NOTICE, "openssl library", r"permission to link the code of portions of this program with the openssl library"),
    ("linux-syscall-note", NOTICE, "linux syscall note", r"linux syscall note"),
    ("llvm-exception", NOTICE, "llvm", r"(?:with )?llvm exceptions?"),
    ("mpl-1.1", FULL, "contents of this file are subject", r"the contents of this file are subject to the mozilla public license"),
    ("mpl-2.0", FULL, "copy of the mpl was not", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-2.0-no-copyleft-exception", NOTICE, "incompatible with secondary licenses", r"incompatible with secondary licenses"),
    ("epl", FULL, "accompanying program is provided", r"the accompanying program is provided under the terms of this eclipse public licen[cs]e"),
    ("epl", FULL, "program and the accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cpl-1.0", FULL, "accompanying program is provided", r"the accompanying program is provided under the terms of this common public licen[cs]e"),
    ("ipl-1.0", NAME, "ibm public", r"ibm public licen[cs]e(?: version 1 0)?"),
    ("cddl", FULL, "contents of this file are subject", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("artistic", FULL, "reasonable copying fee", r"you may charge a reasonable copying fee for any distribution of this package"),
    ("artistic-2.0", FULL, "standard version of the package", r"you may distribute verbatim copies of the source form of the standard version of the package"),
    ("perl", NOTICE, "same terms as perl", r"under the same terms as perl(?: itself)?"),
    ("python-2.0", FULL, "beopen", r"beopen python open source license agreement"),
    ("python-2.0", FULL, "python software foundation", r"this license agreement is between the python software foundation"),
    ("ruby", FULL, "make and give away verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("php", FULL, "php software freely", r"this product includes php software freely available"),
    ("postgresql", FULL, "university of california be liable", r"in no event shall the university of california be liable to any party"),
    ("openssl", FULL, "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", FULL, "eric young", r"this product includes cryptographic software written by eric young"),
    ("curl", FULL, "with or without fee", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("ofl-1.1", FULL, "reserved font name", r"with reserved font name"),
    ("ofl-1.1", FULL, "open font", r"the goals of the open font licen[cs]e"),
    ("ubuntu-font-1.0", NAME, "ubuntu font", r"ubuntu font licen[cs]e(?: version 1 0)?"),
    ("bitstream-vera", FULL, "bitstream", r"the names of gnome the gnome foundation and bitstream inc"),
    ("arphic", NAME, "arphic", r"arphic public licen[cs]e"),
    ("ipa-font", NAME, "ipa font", r"ipa font licen[cs]e"),
    ("unicode", FULL, "unicode data files", r"a copy of the unicode data files and any associated documentation"),
    ("unicode", NAME, "unicode", r"unicode (?:terms of use|license agreement)"),
    ("w3c", FULL, "copying this work", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("ogc", NAME, "ogc", r"ogc software licen[cs]e"),
    ("naist", NAME, "nara institute", r"nara institute of science and technology"),
    ("hpnd", FULL, "historical permission", r"historical permission notice and disclaimer"),
    ("hpnd", FULL, "supporting documentation", r"that both that copyright notice and this permission notice appear in supporting documentation"),
    ("cmu", FULL, "carnegie mellon", r"carnegie mellon (?:university )?disclaims all warranties"),
    ("ntp", FULL, "university of delaware", r"the university of delaware makes no representations about the suitability"),
    ("libtiff", FULL, "sam leffler", r"the names of sam leffler and silicon graphics"),
    ("ijg", FULL, "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", FULL, "freetype", r"portions of this software are copyright (?:c )?(?:\S+ )?the freetype project"),
    ("ftl", NAME, "freetype", r"freetype (?:project )?licen[cs]e"),
    ("imagemagick", NAME, "imagemagick", r"imagemagick licen[cs]e"),
    ("sleepycat", NAME, "sleepycat", r"sleepycat licen[cs]e"),
    ("nasa-1.3", NAME, "nasa open source", r"nasa open source agreement(?: version 1 3)?"),
    ("bsl-1.1", FULL, "change date", r"on the change date or the fourth anniversary of the first publicly available distribution"),
    ("sspl-1", FULL, "service source code", r"you must make the service source code available via network download to everyone at no charge"),
    ("elastic-2.0", FULL, "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("confluent-community", NAME, "confluent", r"confluent community licen[cs]e(?: agreement)?"),
    ("timescale", NAME, "timescale", r"timescale licen[cs]e(?: agreement)?"),
    ("redis-source-available", NAME, "redis source available", r"redis source available licen[cs]e"),
    ("polyform", NAME, "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) licen[cs]e"),
    ("prosperity", NAME, "prosperity", r"prosperity public licen[cs]e"),
    ("parity", NAME, "parity public", r"parity public licen[cs]e"),
    ("blue-oak-1.0.0", NAME, "blue oak", r"blue oak model licen[cs]e"),
    ("0bsd", TAG, "0bsd", r"0bsd"),
    ("bsd-3-clause-nuclear", NOTICE, "nuclear facility", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("cc", FULL, "work as defined below", r"the work as defined below is provided under the terms of this creative commons public licen[cs]e"),
    ("cc-by", FULL, "appropriate credit", r"you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made"),
    ("cc-by-sa", FULL, "same license as the original", r"distribute your contributions under the same license as the original"),
    ("cc-by-nc", FULL, "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", FULL, "modified material", r"you may not distribute the modified material"),
    ("cc0-1.0", FULL, "this deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", NOTICE, "attribution", r"(?:licensed|released|distributed|available|published) under (?:a |the )?(?:creative commons )?attribution licen[cs]e"),
    ("odbl", FULL, "this database", r"this database is made available under the open database licen[cs]e"),
    ("pddl-1.0", NAME, "public domain dedication", r"public domain dedication and licen[cs]e(?: v?1 0)?"),
    ("dl-de-by-2.0", NAME, "datenlizenz", r"datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?"),
    ("dl-de-zero-2.0", NAME, "datenlizenz", r"datenlizenz deutschland zero(?: version)?(?: 2 0)?"),
    ("etalab-2.0", NAME, "licence ouverte", r"licence ouverte(?: open licen[cs]e)?(?: version)?(?: 2 0)?"),
    ("ogl-uk", FULL, "open government", r"contains public sector information licensed under the open government licen[cs]e"),
    ("crown-copyright", NOTICE, "crown copyright", r"crown copyright(?: (?:19|20)\d\d)?"),
    ("us-government-work", NOTICE, "17 u s c", r"(?:not subject to copyright|public domain) (?:\S+ ){0,6}17 u s c"),
    ("gutenberg", FULL, "anyone anywhere", r"this e ?book is for the use of anyone anywhere"),
    ("gutenberg", NAME, "project gutenberg", r"project gutenberg licen[cs]e"),
    ("llama-community", FULL, "built with", r"prominently display built with (?:meta )?llama"),
    ("openrail", FULL, "use based restrictions", r"use based restrictions as referenced in paragraph"),
    ("gemma-terms", NAME, "gemma", r"gemma terms of use"),
    ("trademark", NOTICE, "trademark", r"(?:is|are) (?:a )?(?:registered )?trademarks? of"),
    ("confidential", NOTICE, "confidential", r"(?:strictly|company) confidential"),
    ("confidential", NOTICE, "intended only for", r"(?:this (?:message|email|communication) is )?intended only for the (?:use of the )?(?:addressee|recipient|individual)"),
    ("proprietary", NOTICE, "trade secret", r"trade secrets? (?:of|and confidential)"),
    ("proprietary", NOTICE, "reverse engineer", r"may not (?:\S+ ){0,6}reverse engineer"),
    ("proprietary", NOTICE, "licensed not sold", r"the software is licensed not sold"),
    ("terms", NAME, "terms of", r"(?:subject to|agree to|accept) (?:the |our |these )?terms of (?:use|service)"),
    ("free-use", NOTICE, "freely", r"may be freely (?:copied|distributed|used)(?: and distributed)?"),
    ("with-permission", NOTICE, "with permission", r"(?:used|reprinted|reproduced) with permission"),
    ("patent-grant", NOTICE, "royalty free irrevocable", r"perpetual worldwide non ?exclusive no charge royalty free irrevocable (?:\S+ ){0,6}patent licen[cs]e"),
]


@cache
def rules() -> list[Rule]:
    """All rules, in order."""
    out = [Rule(label, priority, keyword.encode(), pattern) for label, priority, keyword, pattern in (*WRITTEN, *CLAUSES)]
    for stem, keyword, name, versions in VERSIONED:
        for version in versions.split():
            number = " ".join(re.findall(r"\d+|[a-z]+", version.removesuffix(".0"))) + (r"(?: 0)?" if "." not in version or version.endswith(".0") else "")
            says = rf"{name} (?:as published by the (?:\S+ ){{1,4}})?(?:either )?(?:v|version |v |ver )?{number}"
            out.append(Rule(f"{stem}-{version}", NAME, keyword.encode(), says))
            out.append(Rule(f"{stem}-{version}-or-later", NOTICE, keyword.encode(), rf"{says} (?:of the licen[cs]e )?or (?:\S+ )?(?:\S+ )?(?:later|newer)(?: version)?"))
        out.append(Rule(stem, TAG, keyword.encode(), name))
    for tag, clauses in CC_CLAUSES.items():
        words, long = tag.replace("-", " "), clauses.replace("noncommercial", "non ?commercial").replace("sharealike", "share ?alike").replace("noderivatives", "no ?deriv(?:ative)?s?")
        for version in CC_VERSIONS.split():
            number = version.replace(".", " ")
            out.append(Rule(f"cc-{tag}-{version}", NAME, b"cc by", rf"cc {words} {number}"))
            out.append(Rule(f"cc-{tag}-{version}", NAME, b"attribution", rf"(?:creative commons )?{long} (?:licen[cs]e )?{number}(?: (?:unported|international|generic))?(?: licen[cs]e)?"))
        out.append(Rule(f"cc-{tag}", TAG, b"cc by", rf"cc {words}"))
        out.append(Rule(f"cc-{tag}", TAG, b"attribution", rf"creative commons {long}"))
    return out


@cache
def compiled() -> list[tuple[bytes, list[tuple[int, str, int, re.Pattern[bytes]]]]]:
    """Keywords, each with its rules: number, label, priority, expression over words with a blank on either side."""
    by: dict[bytes, list] = {}
    for i, rule in enumerate(rules()):
        by.setdefault(rule.keyword, []).append((i, rule.label, rule.priority, re.compile(rb"(?<= )" + rule.pattern.encode() + rb"(?= )")))
    return list(by.items())


def words_of(text: str) -> bytes:
    """The words of the text, with one blank before, between and after them."""
    return b" " + b" ".join(text.encode("utf-8", "replace").translate(WORDS).split()) + b" "


def detections(words: bytes) -> list[tuple[str, int, int, int]]:
    """Label, priority, first and last byte (exclusive) of what remains after suppression, by place."""
    found = []
    for keyword, own in compiled():
        if keyword in words:
            for i, label, priority, pattern in own:
                found += [(m.start(), -m.end(), -priority, i, label) for m in pattern.finditer(words)]
    # by place, the longer, stronger and earlier first: what contains an interval has come before it
    kept, reach = [], [0] * (FULL + 1)
    for start, end, priority, _, label in sorted(found):
        start, end, priority = start, -end, -priority
        if max(reach[priority:]) < end:
            kept.append((label, priority, start, end))
        reach[priority] = max(reach[priority], end)
    return kept


def scan_text(text: str) -> dict:
    """The result for a text, as the columns after doc_id."""
    words = words_of(text)
    n_words = words.count(b" ") - 1 if len(words) > 2 else 0
    starts, labels, doubt = [], set(), 1.0
    for phrase, label in BASE.items():
        at = words.find(b" " + phrase + b" ")
        while at >= 0:
            starts.append(at)
            labels.add(label)
            at = words.find(b" " + phrase + b" ", at + 1)
    base = sorted(labels)
    found = detections(words)
    strongest: dict[str, int] = {}
    for label, priority, _, _ in found:
        strongest[label] = max(priority, strongest.get(label, 0))
    for label in sorted(labels | set(strongest)):
        doubt *= 1 - (CONFIDENCE[strongest[label]] if label in strongest else BASE_CONFIDENCE)
    blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 32) if starts or found else None
    word = lambda at: int(np.searchsorted(blanks, at))  # noqa: E731  blanks before a byte
    return {
        "n_words": n_words,
        "n_base": len(starts),
        "first_word": word(min(starts)) if starts else None,
        "last_word": word(max(starts)) if starts else None,
        "base_labels": ",".join(base),
        "labels": ",".join(sorted(labels | set(strongest))),
        "score": round(1 - doubt, 9),
        "spans": [{"label": label, "first": word(a) - 1, "last": word(b) - 1} for label, _, a, b in found],
    }


def scan(docs: DataFrame) -> DataFrame:
    """Per document: n_words, base phrases' counts and places, labels, score, and the spans (label, first and last word)
    of what the rules found."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [scan_text(text) for text in batch.column("text").to_pylist()]
            names = [f.strip().split()[0] for f in SCHEMA.split(", ")][1:]
            kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names)], ["doc_id", *names])

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
