"""License scans by ordered signature rules.

Regexes written by hand over lower-cased text: a name and an identifier for each license, and sentences, notices and
addresses of their texts. Names and identifiers stand in the forms that ``rules`` lists (a notice, a classifier, a
field, an SPDX line, the bare name), which makes the rules. Patterns let words part at any white space, so wrapped
texts match as well. A rule runs only on texts that hold one of its keywords, which every text
it matches does once runs of white space are one blank (one Aho-Corasick pass finds all keywords). Identifiers stand in the
expressions of an SPDX line (OR, AND, WITH, brackets) as well. Detections are taken by priority, then length, then start; one whose interval lies
inside that of an accepted detection is suppressed, which a tree of greatest ends answers in logarithmic time, and so is one that
names a family only (gpl) where a version of it (gpl-2.0) is detected within NOTICE code points: both are parts of one notice.
The base phrases are rules as well, never suppressed, and match on words.

Null texts count as empty; whole texts are scanned; repeated rows are scanned each on their own; an empty table
gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
from pyspark.sql import DataFrame

from .common import LOWER_AZ, map_texts

#: The base phrases of the contract and their labels.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

#: ASCII that is neither letter nor digit separates words; all other bytes belong to them.
_TO_WORDS = bytes(32 if b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in LOWER_AZ)

_V = r",?\s+(?:version\s+|v(?:er(?:sion)?)?\.?\s*)?"

#: label, keywords (parted by a bar), pattern of the name, pattern of the identifier.
NAMES = (
    ("mit", "mit|expat", r"mit(?:\s+|/x11\s+)licen[cs]e|expat\s+licen[cs]e", r"mit"),
    ("mit-0", "mit", r"mit\s+no\s+attribution(?:\s+licen[cs]e)?", r"mit-0"),
    ("x11", "x11", r"x11\s+licen[cs]e", r"x11"),
    ("isc", "isc", r"isc\s+licen[cs]e", r"isc"),
    ("0bsd", "bsd", r"(?:zero(?:-|\s+)clause|0(?:-|\s+)clause)\s+bsd(?:\s+licen[cs]e)?", r"0bsd"),
    ("bsd-2-clause", "bsd", rf"(?:simplified|freebsd|2(?:-|\s+)clause|two(?:-|\s+)clause)\s+bsd(?:\s+licen[cs]e)?|bsd\s+2(?:-|\s+)clause", r"bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3(?:-|\s+)clause|three(?:-|\s+)clause)\s+bsd(?:\s+licen[cs]e)?|bsd\s+3(?:-|\s+)clause", r"bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4(?:-|\s+)clause|four(?:-|\s+)clause)\s+bsd(?:\s+licen[cs]e)?", r"bsd-4-clause"),
    ("bsd", "bsd", r"bsd(?:[- ]style)?\s+licen[cs]e", r"bsd"),
    ("apache-1.1", "apache", rf"apache(?:\s+software)?\s+licen[cs]e{_V}1\.1", r"apache-1\.1"),
    ("apache-2.0", "apache", rf"apache(?:\s+software)?\s+licen[cs]e{_V}2(?:\.0)?|apache\s+2\.0", r"apache-2\.0"),
    ("gpl-2.0", "general public", rf"(?<!lesser\s)(?<!affero\s)(?<!library\s)general\s+public\s+licen[cs]e{_V}2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?"),
    ("gpl-3.0", "general public", rf"(?<!lesser\s)(?<!affero\s)general\s+public\s+licen[cs]e{_V}3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?"),
    ("gpl", "general public", r"(?<!lesser\s)(?<!affero\s)(?<!library\s)(?:gnu\s+)?general\s+public\s+licen[cs]e", r"gpl"),
    ("lgpl-2.0", "library general public", rf"library\s+general\s+public\s+licen[cs]e{_V}2(?:\.0)?", r"lgpl-2\.0(?:-only|-or-later|\+)?"),
    ("lgpl-2.1", "lesser general public", rf"lesser\s+general\s+public\s+licen[cs]e{_V}2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?"),
    ("lgpl-3.0", "lesser general public", rf"lesser\s+general\s+public\s+licen[cs]e{_V}3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?"),
    ("lgpl", "general public", r"(?:lesser|library)\s+general\s+public\s+licen[cs]e", r"lgpl"),
    ("agpl-3.0", "affero", rf"affero\s+general\s+public\s+licen[cs]e{_V}3(?:\.0)?", r"agpl-3\.0(?:-only|-or-later|\+)?"),
    ("agpl", "affero", r"affero\s+general\s+public\s+licen[cs]e", r"agpl"),
    ("gfdl", "documentation", r"(?:gnu\s+)?free\s+documentation\s+licen[cs]e", r"gfdl(?:-1\.[123])?"),
    ("mpl-1.1", "mozilla", rf"mozilla\s+public\s+licen[cs]e{_V}1\.1", r"mpl-1\.1"),
    ("mpl-2.0", "mozilla", rf"mozilla\s+public\s+licen[cs]e{_V}2(?:\.0)?", r"mpl-2\.0"),
    ("mpl", "mozilla", r"mozilla\s+public\s+licen[cs]e", r"mpl"),
    ("epl-1.0", "eclipse", rf"eclipse\s+public\s+licen[cs]e{_V}1(?:\.0)?", r"epl-1\.0"),
    ("epl-2.0", "eclipse", rf"eclipse\s+public\s+licen[cs]e{_V}2(?:\.0)?", r"epl-2\.0"),
    ("edl-1.0", "eclipse", r"eclipse\s+distribution\s+licen[cs]e", r"edl-1\.0"),
    ("cddl-1.0", "common development", rf"common\s+development\s+and\s+distribution\s+licen[cs]e", r"cddl-1\.[01]"),
    ("cpl-1.0", "common public", r"common\s+public\s+licen[cs]e", r"cpl-1\.0"),
    ("cpal-1.0", "common public", r"common\s+public\s+attribution\s+licen[cs]e", r"cpal-1\.0"),
    ("artistic-1.0", "artistic", rf"artistic\s+licen[cs]e{_V}1(?:\.0)?", r"artistic-1\.0"),
    ("artistic-2.0", "artistic", rf"artistic\s+licen[cs]e{_V}2(?:\.0)?", r"artistic-2\.0"),
    ("bsl-1.0", "boost", r"boost\s+software\s+licen[cs]e", r"bsl-1\.0"),
    ("busl-1.1", "business source", r"business\s+source\s+licen[cs]e", r"busl-1\.1"),
    ("sspl-1.0", "server side", r"server\s+side\s+public\s+licen[cs]e", r"sspl-1\.0"),
    ("elastic-2.0", "elastic", r"elastic\s+licen[cs]e", r"elastic-2\.0"),
    ("zlib", "zlib", r"zlib(?:/libpng)?\s+licen[cs]e", r"zlib"),
    ("libpng", "libpng", r"(?<!zlib/)libpng\s+licen[cs]e", r"libpng(?:-2\.0)?"),
    ("unlicense", "unlicen", r"the\s+unlicen[cs]e", r"unlicense"),
    ("wtfpl", "want to public", r"do\s+what\s+the\s+\S+\s+you\s+want\s+to\s+public\s+licen[cs]e", r"wtfpl"),
    ("cc0-1.0", "cc0", r"cc0(?:\s+1\.0)?(?:\s+universal)?", r"cc0-1\.0"),
    ("cc-by-nc-nd", "cc", r"cc(?:\s+|-)by(?:\s+|-)nc(?:\s+|-)nd", r"cc-by-nc-nd-[1-4]\.[0-5]"),
    ("cc-by-nc-sa", "cc", r"cc(?:\s+|-)by(?:\s+|-)nc(?:\s+|-)sa", r"cc-by-nc-sa-[1-4]\.[0-5]"),
    ("cc-by-nc", "cc", r"cc(?:\s+|-)by(?:\s+|-)nc(?!(?:\s+|-)(?:nd|sa))", r"cc-by-nc-[1-4]\.[0-5]"),
    ("cc-by-nd", "cc", r"cc(?:\s+|-)by(?:\s+|-)nd", r"cc-by-nd-[1-4]\.[0-5]"),
    ("cc-by-sa", "cc", r"cc(?:\s+|-)by(?:\s+|-)sa", r"cc-by-sa-[1-4]\.[0-5]"),
    ("cc-by", "cc", r"cc(?:\s+|-)by(?:\s+[1-4]\.[0-5])?(?!(?:\s+|-)(?:nc|nd|sa))", r"cc-by-[1-4]\.[0-5]"),
    ("cc", "creative commons", r"creative\s+commons(?:\s+\S+){0,4}?\s+licen[cs]e", r"cc"),
    ("odbl-1.0", "open database", r"open\s+database\s+licen[cs]e", r"odbl-1\.0"),
    ("odc-by-1.0", "open data commons", r"open\s+data\s+commons\s+attribution\s+licen[cs]e", r"odc-by-1\.0"),
    ("pddl-1.0", "public domain dedication", r"public\s+domain\s+dedication\s+and\s+licen[cs]e", r"pddl-1\.0"),
    ("ofl-1.1", "open font", r"(?:sil\s+)?open\s+font\s+licen[cs]e", r"ofl-1\.[01]"),
    ("psf-2.0", "python software", r"python\s+software\s+foundation\s+licen[cs]e", r"psf-2\.0|python-2\.0"),
    ("php-3.01", "php", r"php\s+licen[cs]e", r"php-3\.0(?:1)?"),
    ("ruby", "ruby", r"ruby\s+licen[cs]e", r"ruby"),
    ("perl", "perl", r"same\s+terms\s+as\s+perl(?:\s+itself)?", r"artistic-1\.0-perl"),
    ("postgresql", "postgresql", r"postgresql\s+licen[cs]e", r"postgresql"),
    ("openssl", "openssl", r"openssl\s+licen[cs]e", r"openssl"),
    ("ms-pl", "microsoft public", r"microsoft\s+public\s+licen[cs]e", r"ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft\s+reciprocal\s+licen[cs]e", r"ms-rl"),
    ("eupl-1.2", "european union", r"european\s+union\s+public\s+licen[cs]e", r"eupl-1\.[012]"),
    ("cecill-2.1", "cecill", r"cecill(?:-[bc])?\s+licen[cs]e|licence\s+cecill", r"cecill-(?:2\.[01]|b|c)"),
    ("afl-3.0", "academic free", r"academic\s+free\s+licen[cs]e", r"afl-3\.0"),
    ("osl-3.0", "open software", r"open\s+software\s+licen[cs]e", r"osl-3\.0"),
    ("ncsa", "ncsa", r"(?:university\s+of\s+illinois/)?ncsa(?:\s+open\s+source)?\s+licen[cs]e", r"ncsa"),
    ("upl-1.0", "universal permissive", r"universal\s+permissive\s+licen[cs]e", r"upl-1\.0"),
    ("vim", "vim", r"vim\s+licen[cs]e", r"vim"),
    ("beerware", "beer", r"beer-?ware(?:\s+licen[cs]e)?", r"beerware"),
    ("json", "json", r"json\s+licen[cs]e", r"json"),
    ("curl", "curl", r"curl\s+licen[cs]e", r"curl"),
    ("blueoak-1.0.0", "blue oak", r"blue\s+oak\s+model\s+licen[cs]e", r"blueoak-1\.0\.0"),
    ("qpl-1.0", "q public", r"q\s+public\s+licen[cs]e", r"qpl-1\.0"),
    ("ipl-1.0", "ibm public", r"ibm\s+public\s+licen[cs]e", r"ipl-1\.0"),
    ("ecl-2.0", "educational community", r"educational\s+community\s+licen[cs]e", r"ecl-2\.0"),
    ("apsl-2.0", "apple public", r"apple\s+public\s+source\s+licen[cs]e", r"apsl-2\.0"),
    ("w3c", "w3c", r"w3c(?:\s+software)?(?:\s+notice\s+and)?\s+licen[cs]e", r"w3c"),
    ("openrail", "rail", r"(?:creativeml\s+)?open\s?rail(?:[- ][ms]+)?\s+licen[cs]e", r"openrail(?:-m)?"),
)

#: label, keyword, pattern: sentences of license texts, notices and addresses.
TEXTS = (
    ("mit", "permission is hereby granted", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy\s+of\s+this\s+software"),
    ("mit", "shall be included in all copies", r"the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included\s+in\s+all\s+copies"),
    ("isc", "permission to use, copy", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose"),
    ("bsd", "redistribution and use", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification"),
    ("bsd-3-clause", "endorse or promote", r"neither\s+the\s+names?\s+of\s+(?s:.){1,120}?endorse\s+or\s+promote\s+products"),
    ("bsd-4-clause", "advertising materials", r"all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software"),
    ("apache-2.0", "except in compliance", r"you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+licen[cs]e"),
    ("apache-2.0", "apache.org/licenses", r"https?://www\.apache\.org/licenses/license-2\.0"),
    ("gpl", "free software foundation", r"under\s+the\s+terms\s+of\s+the\s+gnu\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation"),
    ("gpl-2.0", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/gpl-3\.0"),
    ("gpl", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/(?!(?:old-licenses/)?[al]?gpl-)"),
    ("lgpl-2.1", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/agpl-3\.0"),
    ("mit", "opensource.org/licenses", r"https?://(?:www\.)?opensource\.org/licenses/mit"),
    ("isc", "opensource.org/licenses", r"https?://(?:www\.)?opensource\.org/licenses/isc"),
    ("bsd-2-clause", "opensource.org/licenses", r"https?://(?:www\.)?opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "opensource.org/licenses", r"https?://(?:www\.)?opensource\.org/licenses/bsd-3-clause"),
    ("apache-2.0", "opensource.org/licenses", r"https?://(?:www\.)?opensource\.org/licenses/apache-2\.0"),
    ("mpl-2.0", "mozilla.org/mpl", r"https?://(?:www\.)?mozilla\.org/mpl/2\.0"),
    ("mpl-1.1", "mozilla.org/mpl", r"https?://(?:www\.)?mozilla\.org/mpl/(?!2\.0)"),
    ("epl-2.0", "eclipse.org/legal", r"https?://(?:www\.)?eclipse\.org/legal/epl-2\.0"),
    ("epl-1.0", "eclipse.org/legal", r"https?://(?:www\.)?eclipse\.org/legal/epl-v10"),
    ("cc-by", "creativecommons.org", r"https?://creativecommons\.org/licenses/by/[1-4]\.[0-5]"),
    ("cc-by-sa", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-sa/[1-4]\.[0-5]"),
    ("cc-by-nc", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc/[1-4]\.[0-5]"),
    ("cc-by-nd", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nd/[1-4]\.[0-5]"),
    ("cc-by-nc-sa", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc-sa/[1-4]\.[0-5]"),
    ("cc-by-nc-nd", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc-nd/[1-4]\.[0-5]"),
    ("cc0-1.0", "creativecommons.org", r"https?://creativecommons\.org/publicdomain/zero/1\.0"),
    ("unlicense", "released into the public domain", r"free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("unlicense", "unlicense.org", r"https?://unlicense\.org"),
    ("bsl-1.0", "boost.org", r"https?://www\.boost\.org/license_1_0"),
    ("zlib", "without any express or implied", r"this\s+software\s+is\s+provided\s+'?as-is'?,\s+without\s+any\s+express\s+or\s+implied\s+warranty"),
    ("ofl-1.1", "scripts.sil.org", r"https?://scripts\.sil\.org/ofl"),
    ("wtfpl", "wtfpl.net", r"https?://www\.wtfpl\.net"),
    ("public-domain", "public domain", r"(?:placed|dedicated|released)\s+(?:in|into|to)\s+the\s+public\s+domain"),
    ("proprietary", "all rights reserved", r"all\s+rights\s+reserved"),
    ("proprietary", "proprietary and confidential", r"proprietary\s+and\s+confidential"),
    ("mit", "without restriction, including", r"to\s+deal\s+in\s+the\s+software\s+without\s+restriction,\s+including\s+without\s+limitation"),
    ("mit", "the software is provided", r"the\s+software\s+is\s+provided\s+[\"']*as\s+is[\"']*,?\s+without\s+warranty\s+of\s+any\s+kind,\s+express\s+or\s+implied"),
    ("mit", "released under mit", r"released\s+under\s+mit(?!\w)"),
    ("mit", "tldrlegal.com/license", r"https?://(?:www\.)?tldrlegal\.com/license/mit"),
    ("mit", "choosealicense.com", r"https?://choosealicense\.com/licenses/mit"),
    ("mit-0", "aws/mit-0", r"github\.com/aws/mit-0"),
    ("isc", "opensource.org/license/isc", r"https?://opensource\.org/license/isc"),
    ("0bsd", "permission to use, copy", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted\.(?!\s*provided)"),
    ("bsd", "must retain the above copyright", r"redistributions\s+of\s+source\s+code\s+must\s+retain\s+the\s+above\s+copyright\s+notice"),
    ("bsd", "must reproduce the above copyright", r"redistributions\s+in\s+binary\s+form\s+must\s+reproduce\s+the\s+above\s+copyright\s+notice"),
    ("bsd", "use of this source code is governed", r"use\s+of\s+this\s+source\s+code\s+is\s+governed\s+by\s+a\s+bsd"),
    ("bsd-3-clause", "choosealicense.com", r"https?://choosealicense\.com/licenses/bsd-3-clause"),
    ("bsd-2-clause", "choosealicense.com", r"https?://choosealicense\.com/licenses/bsd-2-clause"),
    ("bsd-4-clause", "this product includes software", r"this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+university\s+of\s+california"),
    ("apache-1.1", "this product includes software", r"this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+apache\s+software\s+foundation\s+\(https?://www\.apache\.org/\)"),
    ("apache-2.0", "apache software foundation", r"licensed\s+to\s+the\s+apache\s+software\s+foundation\s+\(asf\)\s+under\s+one"),
    ("apache-2.0", "warranties or conditions of any kind", r"on\s+an\s+[\"']*as\s+is[\"']*\s+basis,\s+without\s+warranties\s+or\s+conditions\s+of\s+any\s+kind"),
    ("apache-2.0", "terms and conditions for use", r"apache\s+license\s+version\s+2\.0,?\s+january\s+2004(?s:.){0,80}terms\s+and\s+conditions\s+for\s+use"),
    ("apache-2.0", "choosealicense.com", r"https?://choosealicense\.com/licenses/apache-2\.0"),
    ("apache-2.0", "apache 2", r"apache\s+2\s+licen[cs]e"),
    ("gpl", "this program is free software", r"this\s+program\s+is\s+free\s+software[;:,]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify"),
    ("gpl", "you should have received a copy", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+general\s+public\s+licen[cs]e"),
    ("gpl", "for software", r"the\s+gnu\s+general\s+public\s+licen[cs]e\s+is\s+a\s+free,\s+copyleft\s+licen[cs]e\s+for\s+software"),
    ("gpl-2.0", "version 2 of the licen", r"gnu\s+general\s+public\s+licen[cs]e(?s:.){1,90}?either\s+version\s+2\s+of\s+the\s+licen[cs]e"),
    ("gpl-3.0", "version 3 of the licen", r"gnu\s+general\s+public\s+licen[cs]e(?s:.){1,90}?either\s+version\s+3\s+of\s+the\s+licen[cs]e"),
    ("gpl-2.0", "gplv2", r"(?<![la])gplv2(?!\w)"),
    ("gpl-3.0", "gplv3", r"(?<![la])gplv3(?!\w)"),
    ("lgpl-2.1", "lgplv2.1", r"lgplv2\.1(?!\w)"),
    ("lgpl-3.0", "lgplv3", r"lgplv3(?!\w)"),
    ("agpl-3.0", "agplv3", r"agplv3(?!\w)"),
    ("lgpl", "this library is free software", r"this\s+library\s+is\s+free\s+software[;:,]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify"),
    ("lgpl", "you should have received a copy", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+(?:lesser|library)\s+general\s+public"),
    ("agpl", "you should have received a copy", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+affero\s+general\s+public"),
    ("agpl-3.0", "remote network interaction", r"remote\s+network\s+interaction;\s+use\s+with\s+the\s+gnu\s+general\s+public"),
    ("gfdl", "invariant sections", r"with\s+no\s+invariant\s+sections,\s+no\s+front-cover\s+texts"),
    ("gfdl", "gnu.org/copyleft", r"https?://www\.gnu\.org/copyleft/fdl"),
    ("gpl", "gnu.org/copyleft", r"https?://www\.gnu\.org/copyleft/gpl"),
    ("lgpl", "gnu.org/copyleft", r"https?://www\.gnu\.org/copyleft/lesser"),
    ("classpath-exception", "as a special exception", r"as\s+a\s+special\s+exception,\s+the\s+copyright\s+holders\s+of\s+this\s+library\s+give\s+you\s+permission\s+to\s+link"),
    ("mpl-2.0", "subject to the terms of the mozilla", r"this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public"),
    ("mpl-1.1", "the contents of this file are subject", r"the\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+mozilla\s+public\s+licen[cs]e"),
    ("mpl-2.0", "incompatible with secondary", r"incompatible\s+with\s+secondary\s+licen[cs]es"),
    ("cddl-1.0", "opensource.org/licenses", r"https?://(?:www\.)?opensource\.org/licenses/cddl"),
    ("cddl-1.0", "usr/src/opensolaris", r"usr/src/opensolaris\.licen[cs]e"),
    ("epl-2.0", "available under the terms of the eclipse", r"made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+licen[cs]e\s+(?:v\.?\s*)?2"),
    ("epl-1.0", "available under the terms of the eclipse", r"made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+licen[cs]e\s+v(?:ersion\s+)?1"),
    ("artistic-2.0", "perlfoundation.org", r"https?://www\.perlfoundation\.org/artistic_license_2_0"),
    ("artistic-1.0", "the intent of this document", r"the\s+intent\s+of\s+this\s+document\s+is\s+to\s+state\s+the\s+conditions\s+under\s+which\s+a\s+package\s+may\s+be\s+copied"),
    ("artistic-2.0", "everyone is permitted to copy", r"everyone\s+is\s+permitted\s+to\s+copy\s+and\s+distribute\s+verbatim\s+copies\s+of\s+this\s+licen[cs]e\s+document,\s+but\s+changing\s+it\s+is\s+not\s+allowed\.(?s:.){0,40}artistic"),
    ("perl", "under the same terms as", r"under\s+the\s+same\s+terms\s+as\s+perl"),
    ("zlib", "the origin of this software", r"the\s+origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented"),
    ("zlib", "altered source versions", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such"),
    ("libpng", "libpng.org", r"https?://www\.libpng\.org/pub/png/src/libpng-license"),
    ("bsl-1.0", "permission is hereby granted", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy"),
    ("unlicense", "anyone is free to copy", r"anyone\s+is\s+free\s+to\s+copy,\s+modify,\s+publish,\s+use,\s+compile,\s+sell"),
    ("wtfpl", "you just do what", r"you\s+just\s+do\s+what\s+the\s+\S+\s+you\s+want\s+to"),
    ("beerware", "you can buy me a beer", r"you\s+can\s+buy\s+me\s+a\s+beer\s+in\s+return"),
    ("ofl-1.1", "open font", r"this\s+font\s+software\s+is\s+licen[cs]ed\s+under\s+the\s+sil\s+open\s+font"),
    ("ofl-1.1", "reserved font name", r"with\s+reserved\s+font\s+names?"),
    ("psf-2.0", "psf licen|python software", r"psf\s+licen[cs]e\s+agreement|python\s+software\s+foundation\s+licen[cs]e\s+version\s+2"),
    ("openssl", "openssl project for use", r"developed\s+by\s+the\s+openssl\s+project\s+for\s+use\s+in\s+the\s+openssl\s+toolkit"),
    ("php-3.01", "php.net/license", r"https?://www\.php\.net/license/3_01"),
    ("php-3.01", "this product includes php", r"this\s+product\s+includes\s+php\s+software"),
    ("postgresql", "in no event shall the university of california", r"in\s+no\s+event\s+shall\s+the\s+university\s+of\s+california\s+be\s+liable"),
    ("curl", "permission to use, copy", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted,\s+provided"),
    ("json", "shall be used for good", r"the\s+software\s+shall\s+be\s+used\s+for\s+good,\s+not\s+evil"),
    ("w3c", "w3.org/consortium/legal", r"https?://www\.w3\.org/consortium/legal/(?:\d+/)?copyright-software"),
    ("ms-pl", "opensource.org/licenses", r"https?://(?:www\.)?opensource\.org/licenses/ms-pl"),
    ("ms-pl", "if you bring a patent claim", r"if\s+you\s+bring\s+a\s+patent\s+claim\s+against\s+any\s+contributor\s+over\s+patents"),
    ("eupl-1.2", "joinup.ec.europa.eu", r"https?://joinup\.ec\.europa\.eu/\S*eupl"),
    ("eupl-1.2", "eupl", r"licen[cs]ed\s+under\s+the\s+eupl"),
    ("cecill-2.1", "cecill.info", r"https?://(?:www\.)?cecill\.info"),
    ("sspl-1.0", "mongodb.com/licensing", r"https?://www\.mongodb\.com/licensing/server-side-public-license"),
    ("busl-1.1", "change date", r"change\s+date:(?s:.){0,120}?change\s+licen[cs]e:"),
    ("busl-1.1", "mariadb.com/bsl11", r"https?://(?:www\.)?mariadb\.com/bsl11"),
    ("elastic-2.0", "elastic.co/licensing", r"https?://www\.elastic\.co/licensing/elastic-license"),
    ("commons-clause", "commons clause", r"commons\s+clause\s+licen[cs]e\s+condition"),
    ("polyform", "polyform", r"polyform\s+(?:noncommercial|small\s+business|strict|shield)\s+licen[cs]e"),
    ("hippocratic", "hippocratic", r"hippocratic\s+licen[cs]e"),
    ("cc-by", "attribution 4.0 international", r"(?<!\w)attribution\s+4\.0\s+international"),
    ("cc-by-sa", "attribution-sharealike", r"attribution-sharealike\s+[1-4]\.[0-5]"),
    ("cc-by-nc", "attribution-noncommercial", r"attribution-noncommercial\s+[1-4]\.[0-5]"),
    ("cc-by-nd", "attribution-noderiv", r"attribution-noderiv(?:ative)?s\s+[1-4]\.[0-5]"),
    ("cc-by-nc-sa", "attribution-noncommercial-sharealike", r"attribution-noncommercial-sharealike\s+[1-4]\.[0-5]"),
    ("cc-by-nc-nd", "attribution-noncommercial-noderiv", r"attribution-noncommercial-noderiv(?:ative)?s\s+[1-4]\.[0-5]"),
    ("cc0-1.0", "no copyright", r"the\s+person\s+who\s+associated\s+a\s+work\s+with\s+this\s+deed(?s:.){0,80}no\s+copyright|waived\s+all\s+copyright(?s:.){0,60}no\s+copyright"),
    ("cc0-1.0", "waived all copyright", r"has\s+waived\s+all\s+copyright\s+and\s+related\s+or\s+neighbou?ring\s+rights"),
    ("odbl-1.0", "opendatacommons.org", r"https?://(?:www\.)?opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "opendatacommons.org", r"https?://(?:www\.)?opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "opendatacommons.org", r"https?://(?:www\.)?opendatacommons\.org/licenses/pddl"),
    ("ogl-uk-3.0", "open government", r"open\s+government\s+licen[cs]e\s+v(?:ersion\s+)?3(?:\.0)?"),
    ("ogl-uk-3.0", "nationalarchives.gov.uk", r"https?://www\.nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("etalab-2.0", "licence ouverte", r"licence\s+ouverte(?:\s*/\s*open\s+licen[cs]e)?"),
    ("openrail", "use-based restrictions", r"use-based\s+restrictions\s+as\s+referenced\s+in\s+paragraph\s+5"),
    ("llama-community", "llama", r"llama\s+\d(?:\.\d)?\s+community\s+licen[cs]e"),
    ("gemma", "gemma terms", r"gemma\s+terms\s+of\s+use"),
    ("public-domain", "no copyright is claimed", r"no\s+copyright\s+is\s+claimed"),
    ("public-domain", "public domain mark", r"public\s+domain\s+mark\s+1\.0"),
    ("proprietary", "trade secret|confidential and", r"confidential\s+and\s+proprietary|trade\s+secrets?\s+of"),
    ("proprietary", "end user licen", r"end\s+user\s+licen[cs]e\s+agreement"),
    ("proprietary", "may not be reproduced", r"may\s+not\s+be\s+reproduced(?:,\s+\w+){0,4}\s+(?:or\s+\w+\s+)?without\s+(?:the\s+)?(?:express\s+|prior\s+)*written\s+(?:permission|consent)"),
)


#: Between an abbreviation and its version, and what may follow that.
_W = r"(?:,?\s+(?:version\s+|v(?:er(?:sion)?)?\.?\s*)?|[- ]?v?\.?)"
_LATER = r"(?:\+|,?\s+(?:\(?or(?:\s+\(at\s+your\s+option\))?|and)\s+(?:any\s+)?(?:later|newer|above)(?:\s+versions?)?\)?|-only|-or-later)?"

#: label, keyword, pattern: abbreviated names, with versions.
SHORT = (
    ("gpl-1.0", "gpl", rf"(?:gnu\s+)?gpl{_W}1(?:\.0)?{_LATER}"),
    ("gpl-2.0", "gpl", rf"(?:gnu\s+)?gpl{_W}2(?:\.0)?{_LATER}"),
    ("gpl-3.0", "gpl", rf"(?:gnu\s+)?gpl{_W}3(?:\.0)?{_LATER}"),
    ("gpl", "gnu gpl|gpl licen|gpl'd|gpled", r"gnu\s+gpl|gpl\s+licen[cs]ed?|gpl'?e?d"),
    ("lgpl-2.0", "lgpl", rf"(?:gnu\s+)?lgpl{_W}2(?:\.0)?{_LATER}"),
    ("lgpl-2.1", "lgpl", rf"(?:gnu\s+)?lgpl{_W}2\.1{_LATER}"),
    ("lgpl-3.0", "lgpl", rf"(?:gnu\s+)?lgpl{_W}3(?:\.0)?{_LATER}"),
    ("lgpl", "gnu lgpl|lgpl licen", r"gnu\s+lgpl|lgpl\s+licen[cs]ed?"),
    ("agpl-3.0", "agpl", rf"(?:gnu\s+)?agpl{_W}3(?:\.0)?{_LATER}"),
    ("agpl", "gnu agpl|agpl licen", r"gnu\s+agpl|agpl\s+licen[cs]ed?"),
    ("gfdl", "gnu fdl|gfdl", rf"(?:gnu\s+fdl|gfdl)(?:{_W}1\.[123])?"),
    ("mpl-1.1", "mpl", rf"mpl{_W}1\.1"),
    ("mpl-2.0", "mpl", rf"mpl{_W}2(?:\.0)?"),
    ("epl-1.0", "epl", rf"epl{_W}1(?:\.0)?"),
    ("epl-2.0", "epl", rf"epl{_W}2(?:\.0)?"),
    ("cddl-1.0", "cddl", rf"cddl{_W}1(?:\.[01])?"),
    ("eupl-1.2", "eupl", rf"eupl{_W}1\.[012]"),
    ("asl-2.0", "asl", rf"asl{_W}2\.0"),
    ("bsd-2-clause", "bsd", r"bsd-2-clause(?:\s+licen[cs]e)?|2-clause[- ]bsd"),
    ("bsd-3-clause", "bsd", r"bsd-3-clause(?:\s+licen[cs]e)?|3-clause[- ]bsd"),
    ("bsd", "bsd", r"bsd\s+licen[cs]ed"),
    ("mit", "mit", r"mit[- ]licen[cs]ed"),
    ("apache-2.0", "apache", rf"apache(?:\s+software)?(?:\s+licen[cs]e)?{_W}2\.0|apache-?2(?!\.?\w)"),
    ("cc-by-nc-nd", "attribution", r"(?:creative\s+commons|cc)\s+attribution[- ]non-?commercial[- ]no[- ]?deriv(?:ative|s|atives)*"),
    ("cc-by-nc-sa", "attribution", r"(?:creative\s+commons|cc)\s+attribution[- ]non-?commercial[- ]share[- ]?alike"),
    ("cc-by-nc", "attribution", r"(?:creative\s+commons|cc)\s+attribution[- ]non-?commercial(?![- ](?:no|share))"),
    ("cc-by-nd", "attribution", r"(?:creative\s+commons|cc)\s+attribution[- ]no[- ]?deriv(?:ative|s|atives)*"),
    ("cc-by-sa", "attribution", r"(?:creative\s+commons|cc)\s+attribution[- ]share[- ]?alike"),
    ("cc-by", "attribution", r"(?:creative\s+commons|cc)\s+attribution(?![- ](?:non|no|share))(?:\s+[1-4]\.[0-5])?"),
    ("cc0-1.0", "creative commons", r"creative\s+commons\s+(?:zero|cc0)"),
)

#: Code points between the parts of one notice, at most.
NOTICE = 400


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    score: float
    opening: str = ""  # how a match begins, where many rules share that; found once for all of them


_CLASSIFIER, _NOTICE, _FIELD = r"licen[cs]e\s*::\s*osi", r"licen[cs]ed\s+under\s", r"(?<!\w)licen[cs]e\"?\s*[:=]"


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between bars outside brackets."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def family(label: str) -> str:
    """What the versions and kinds of a license have in common."""
    return re.split(r"-(?=\d|by\b)", label)[0]


def rules() -> list[Rule]:
    """Every form of every license, the strongest first; equal priorities keep the order of the tables."""
    made = []
    for label, keyword, name, ident in NAMES:
        made += [
            Rule(label, "spdx-license-identifier", rf"spdx-license-identifier:\s*(?:{ident})(?![\w.-])", 90, 1.0),
            Rule(label, keyword, rf"licen[cs]e\s*::\s*osi\s+approved\s*::\s*(?:{name})", 80, 1.0, _CLASSIFIER),
            Rule(label, keyword, rf"licen[cs]ed\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:gnu\s+)?(?:{name})(?!\w)", 70, 0.95, _NOTICE),
            Rule(label, keyword, rf"(?<!\w)(?:{name})(?!\w)", 50, 0.8),
            Rule(label, "licen", rf"(?<!\w)licen[cs]e\"?\s*[:=]\s*[\"']?(?:{ident})(?![\w.-])", 60, 0.9, _FIELD),
        ]
        for one in _alternatives(ident):
            lead = re.match(r"[\w-]*", one)[0]
            if "-" in lead or lead[:1].isdigit():  # others are plain words
                made.append(Rule(label, lead, rf"(?<![\w.-]){one}(?!\.?\w|-\w)", 55, 0.85))
    made += [Rule(label, keyword, rf"(?<![\w-])(?:{pattern})(?!\.?\w)", 58, 0.85) for label, keyword, pattern in SHORT]
    made += [Rule(label, keyword, pattern, 65, 0.9 if label != "proprietary" else 0.5) for label, keyword, pattern in TEXTS]
    return sorted(made, key=lambda r: -r.priority)


_EXPRESSION = re.compile(r"spdx-license-identifier:[ \t]*([(\w][\w.+() \t-]*)")
_PIECE = re.compile(r"[\w.+-]+|[()]")


class Scanner:
    def __init__(self, table: list[Rule]):
        self.rules = [(r, re.compile(r.pattern)) for r in table]
        self.identifiers = [(label, re.compile(ident)) for label, _, _, ident in NAMES]
        self.openings = {o: re.compile(o) for o in {r.opening for r in table} if o}
        by_keyword: dict[str, list[int]] = {}
        for n, r in enumerate(table):
            for k in r.keyword.split("|"):
                by_keyword.setdefault(k, []).append(n)
        self.keywords = ahocorasick.Automaton()
        for k, own in by_keyword.items():
            self.keywords.add_word(k, tuple(own))
        self.keywords.make_automaton()

    def detections(self, lower: str) -> list[tuple[int, int, str, float]]:
        """start, end, label and score of what is not suppressed, by start."""
        due: set[int] = set()
        for _, own in self.keywords.iter(" ".join(lower.split())):
            due.update(own)
        found = []
        opened = {"": True} | {o: p.search(lower) is not None for o, p in self.openings.items()} if due else {}
        for n in sorted(due):
            rule, pattern = self.rules[n]
            if not opened[rule.opening]:
                continue
            found += [(-rule.priority, m.start() - m.end(), m.start(), m.end(), rule.label, rule.score) for m in pattern.finditer(lower)]
        if "spdx-license-identifier" in lower:
            found += self._expressions(lower)
        return _specific(sorted((start, end, label, score) for start, end, label, score in _outermost(found)))

    def _expressions(self, lower: str) -> Iterator[tuple]:
        """Identifiers of SPDX expressions; what follows an expression on its line is left alone."""
        for m in _EXPRESSION.finditer(lower):
            due, after = True, ""  # an identifier is due at first and after each operator
            for piece in _PIECE.finditer(m[1]):
                word = piece[0]
                if word in "()":
                    continue
                if word in ("or", "and", "with"):
                    due, after = True, word
                    continue
                if not due:
                    break
                due = False
                label = word if after == "with" else next((x for x, p in self.identifiers if p.fullmatch(word)), None)
                if label:
                    start, end = m.start(1) + piece.start(), m.start(1) + piece.end()
                    yield -90, start - end, start, end, re.sub(r"-exception-[\d.]+$", "-exception", label), 1.0


def _outermost(found: list[tuple]) -> Iterator[tuple[int, int, str, float]]:
    """Detections in their order, without those inside an earlier one that was kept.

    ``tree`` holds greatest ends of kept detections by start (a Fenwick tree over the starts there are).
    """
    place = {s: n for n, s in enumerate(sorted({f[2] for f in found}), 1)}
    tree = [0] * (len(place) + 1)
    for _, _, start, end, label, score in sorted(found):
        at = place[start]
        while at and tree[at] < end:
            at &= at - 1
        if at:
            continue  # one that starts no later ends no earlier
        at = place[start]
        while at < len(tree):
            tree[at] = max(tree[at], end)
            at += at & -at
        yield start, end, label, score


def _specific(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Detections by start, without those that name a family only beside one of its versions."""
    special: dict[str, list[tuple[int, int]]] = {}
    for start, end, label, _ in found:
        if family(label) != label:
            special.setdefault(family(label), []).append((start, end))
    if not special:
        return found
    reach = {name: list(accumulate((end for _, end in spans), max)) for name, spans in special.items()}

    def part_of_notice(start: int, end: int, label: str) -> bool:
        spans = special.get(label)
        if not spans:
            return False
        at = bisect_right(spans, (end + NOTICE, math.inf))  # those that start before the notice ends
        return at > 0 and reach[label][at - 1] >= start - NOTICE

    return [f for f in found if not part_of_notice(*f[:3])]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules())


def base_places(low: bytes) -> tuple[int, list[tuple[int, str]]]:
    """The number of words of a lower-cased text, and word position and label of every base phrase."""
    spaced = low.translate(_TO_WORDS)
    words = spaced.split()
    places = []
    if b"license" in low:
        joined = b" " + b" ".join(words) + b" "
        for phrase, label in BASE:
            at, last, before = joined.find(b" " + phrase + b" "), 0, 0
            while at >= 0:
                before += joined.count(b" ", last, at)
                places.append((before, label))
                last, at = at, joined.find(b" " + phrase + b" ", at + 1)
    return len(words), sorted(places)


def scan_text(text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    low = text.encode("utf-8", "surrogatepass").translate(LOWER_AZ)
    n, places = base_places(low)
    return n, places, scanner().detections(low.decode("utf-8", "surrogatepass"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and detections: start, end (code points), label, score; base phrases aside, with their word positions."""

    def make():
        def rows(ids, texts):
            got = [scan_text(t) for t in texts]
            return [
                ids,
                [[{"start": s, "end": e, "label": x, "score": p} for s, e, x, p in d] for _, _, d in got],
                [[{"word": w, "label": x} for w, x in b] for _, b, _ in got],
            ]

        return rows

    return map_texts(docs, make, "doc_id long, detections array<struct<start:long,end:long,label:string,score:double>>, base array<struct<word:long,label:string>>")


def license_rows(docs: DataFrame) -> DataFrame:
    """The digest rows of the query. The score is that of the surest detection; a base phrase alone gives 0.8. ``spans`` has label:start:end of detections."""

    def make():
        def rows(ids, texts):
            out = [ids, [], [], [], [], [], [], [], []]
            for t in texts:
                n, base, found = scan_text(t)
                base_labels = {x for _, x in base}
                labels = base_labels | {x for _, _, x, _ in found}
                score = max([0.0, *(p for _, _, _, p in found), *([0.8] if base else [])])
                row = (n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, ",".join(f"{x}:{a}:{b}" for a, b, x, _ in found))
                for column, x in zip(out[1:], row):
                    column.append(x)
            return out

        return rows

    return map_texts(docs, make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
