"""License scans: ordered signature rules behind literals that their matches must contain."""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._text import groups, small, texts_of, word_bounds

#: Phrases and labels of the base scan.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: A word is a run of digits, ASCII letters and all else above \x7F.
NO_WORD = np.ones(256, bool)
NO_WORD[48:58] = NO_WORD[65:91] = NO_WORD[97:123] = False
NO_WORD[128:] = False

#: Rules in order of priority: (label, what it is about, score, patterns over lower-cased text).
#: Written by hand; `~` stands for a run of white space or punctuation.
FAMILIES: list[tuple[str, str, float, list[str]]] = [
    # explicit machine-readable tags come first
    ("spdx-mit", "spdx", 1.0, [r"spdx-license-identifier:\s*mit\b", r"spdx-license-identifier:\s*\(?mit\s+or\b"]),
    ("spdx-apache-2.0", "spdx", 1.0, [r"spdx-license-identifier:\s*apache-2\.0", r"spdx-license-identifier:[^\n]{0,40}\bor\s+apache-2\.0"]),
    ("spdx-gpl-2.0", "spdx", 1.0, [r"spdx-license-identifier:\s*gpl-2\.0(?:-only|-or-later|\+)?"]),
    ("spdx-gpl-3.0", "spdx", 1.0, [r"spdx-license-identifier:\s*gpl-3\.0(?:-only|-or-later|\+)?"]),
    ("spdx-lgpl", "spdx", 1.0, [r"spdx-license-identifier:\s*lgpl-[23]\.[01](?:-only|-or-later|\+)?"]),
    ("spdx-agpl-3.0", "spdx", 1.0, [r"spdx-license-identifier:\s*agpl-3\.0(?:-only|-or-later|\+)?"]),
    ("spdx-bsd", "spdx", 1.0, [r"spdx-license-identifier:\s*bsd-[0-4]-clause", r"spdx-license-identifier:\s*0bsd"]),
    ("spdx-mpl-2.0", "spdx", 1.0, [r"spdx-license-identifier:\s*mpl-[12]\.[01]"]),
    ("spdx-isc", "spdx", 1.0, [r"spdx-license-identifier:\s*isc\b"]),
    ("spdx-cc", "spdx", 1.0, [r"spdx-license-identifier:\s*cc0-1\.0", r"spdx-license-identifier:\s*cc-by(?:-nc)?(?:-sa|-nd)?-[1-4]\.0"]),
    ("spdx-other", "spdx", 0.9, [r"spdx-license-identifier:\s*[a-z0-9.+-]+"]),
    # permissive
    ("mit", "mit", 0.95, [r"under~the~mit~licen[cs]e", r"under~the~terms~of~the~mit~licen[cs]e", r"\bmit~licen[cs]ed?\b", r"licen[cs]ed?~under~(?:the~)?mit\b", r"licen[cs]e:\s*mit\b", r"\bmit/x11~licen[cs]e", r"\bexpat~licen[cs]e~\(?mit\)?", r"released~under~(?:the~)?mit\b", r"distributed~under~(?:the~)?mit\b", r"opensource\.org/licenses/mit"]),
    ("mit", "permission", 0.98, [r"permission~is~hereby~granted,?~free~of~charge,?~to~any~person~obtaining~a~copy"]),
    ("expat", "expat", 0.9, [r"\bexpat~licen[cs]e", r"licen[cs]ed~under~(?:the~)?expat"]),
    ("x11", "x11", 0.9, [r"\bx11~licen[cs]e", r"licen[cs]ed~under~(?:the~)?x11"]),
    ("apache-2.0", "apache", 0.95, [r"apache~licen[cs]e,?~(?:version|v)~?2(?:\.0)?\b", r"apache-2\.0\b", r"\bapache~2\.0~licen[cs]e", r"licen[cs]ed~under~(?:the~)?apache~(?:licen[cs]e~)?(?:version~)?2", r"apache\.org/licenses/license-2\.0", r"\basl~?2\.0\b.{0,40}apache"]),
    ("apache-1.1", "apache", 0.95, [r"apache~(?:software~)?licen[cs]e,?~(?:version|v)~?1\.1", r"apache-1\.1\b", r"apache\.org/licenses/license-1\.1"]),
    ("apache-1.0", "apache", 0.95, [r"apache~(?:software~)?licen[cs]e,?~(?:version|v)~?1\.0", r"apache-1\.0\b"]),
    ("apache", "apache", 0.7, [r"licen[cs]ed~under~(?:the~)?apache~(?:software~)?(?:licen[cs]e|foundation)", r"\bapache~(?:software~)?licen[cs]e\b"]),
    ("bsd-2-clause", "bsd", 0.95, [r"bsd~2~clause", r"\b2~clause~bsd\b", r"two~clause~bsd", r"simplified~bsd~licen[cs]e", r"\bfreebsd~licen[cs]e", r"opensource\.org/licenses/bsd-2-clause"]),
    ("bsd-3-clause", "bsd", 0.95, [r"bsd~3~clause", r"\b3~clause~bsd\b", r"three~clause~bsd", r"(?:new|modified|revised)~bsd~licen[cs]e", r"opensource\.org/licenses/bsd-3-clause"]),
    ("bsd-4-clause", "bsd", 0.95, [r"bsd~4~clause", r"\b4~clause~bsd\b", r"four~clause~bsd", r"original~bsd~licen[cs]e", r"old~style~bsd~licen[cs]e"]),
    ("0bsd", "bsd", 0.95, [r"\b0bsd\b", r"zero~clause~bsd", r"bsd~zero~clause"]),
    ("bsd", "bsd", 0.7, [r"\bbsd~licen[cs]ed?\b", r"licen[cs]ed~under~(?:the~|a~)?bsd\b", r"bsd~style~licen[cs]e", r"terms~of~the~bsd"]),
    ("bsd-3-clause", "redistribution", 0.95, [r"redistribution~and~use~in~source~and~binary~forms,?~with~or~without~modification"]),
    ("isc", "isc", 0.9, [r"\bisc~licen[cs]e", r"licen[cs]ed~under~(?:the~)?isc\b", r"opensource\.org/licenses/isc"]),
    ("isc", "permission", 0.9, [r"permission~to~use,?~copy,?~modify,?~and/?(?:or)?~distribute~this~software~for~any~purpose"]),
    ("zlib", "zlib", 0.9, [r"\bzlib~licen[cs]e", r"zlib/libpng~licen[cs]e", r"licen[cs]ed~under~(?:the~)?zlib"]),
    ("libpng", "libpng", 0.9, [r"\blibpng~licen[cs]e", r"png~reference~library~licen[cs]e.{0,30}libpng"]),
    ("boost-1.0", "boost", 0.95, [r"boost~software~licen[cs]e", r"\bbsl-1\.0\b.{0,40}boost", r"boost\.org/license_1_0"]),
    ("unlicense", "unlicense", 0.95, [r"\bthe~unlicense\b", r"unlicense\.org", r"licen[cs]ed~under~(?:the~)?unlicense"]),
    ("unlicense", "public domain", 0.95, [r"free~and~unencumbered~software~released~into~the~public~domain"]),
    ("wtfpl", "wtfpl", 0.95, [r"\bwtfpl\b"]),
    ("python-2.0", "python", 0.9, [r"python~software~foundation~licen[cs]e", r"\bpsf~licen[cs]e.{0,40}python", r"python~licen[cs]e~2\.0"]),
    ("artistic-2.0", "artistic", 0.95, [r"artistic~licen[cs]e,?~(?:version~|v~)?2(?:\.0)?", r"artistic-2\.0"]),
    ("artistic-1.0", "artistic", 0.9, [r"artistic~licen[cs]e,?~(?:version~|v~)?1(?:\.0)?", r"artistic-1\.0", r"perl~artistic~licen[cs]e"]),
    ("artistic", "artistic", 0.7, [r"\bartistic~licen[cs]e"]),
    ("php-3.01", "php", 0.9, [r"\bphp~licen[cs]e,?~(?:version~|v~)?3\.01", r"php\.net/license/3_01"]),
    ("php", "php", 0.7, [r"\bphp~licen[cs]e"]),
    ("ruby", "ruby", 0.8, [r"\bruby~licen[cs]e", r"same~terms~as~ruby"]),
    ("perl", "perl", 0.8, [r"same~terms~as~perl~itself"]),
    ("ncsa", "illinois", 0.9, [r"university~of~illinois/?~?ncsa~open~source~licen[cs]e"]),
    ("openssl", "openssl", 0.9, [r"\bopenssl~licen[cs]e", r"this~product~includes~software~developed~by~the~openssl~project"]),
    ("postgresql", "postgresql", 0.9, [r"\bpostgresql~licen[cs]e"]),
    ("curl", "curl", 0.8, [r"\bcurl~licen[cs]e"]),
    ("ofl-1.1", "font", 0.95, [r"sil~open~font~licen[cs]e", r"open~font~licen[cs]e,?~(?:version~|v~)?1\.1"]),
    ("upl-1.0", "permissive", 0.9, [r"universal~permissive~licen[cs]e"]),
    ("blueoak-1.0.0", "blue oak", 0.9, [r"blue~oak~model~licen[cs]e"]),
    ("afl-3.0", "academic", 0.9, [r"academic~free~licen[cs]e"]),
    ("ms-pl", "microsoft", 0.9, [r"microsoft~public~licen[cs]e"]),
    ("ms-rl", "microsoft", 0.9, [r"microsoft~reciprocal~licen[cs]e"]),
    ("bsl-1.1", "business source", 0.9, [r"business~source~licen[cs]e,?~(?:version~|v~)?1\.1", r"business~source~licen[cs]e"]),
    ("elastic-2.0", "elastic", 0.9, [r"elastic~licen[cs]e,?~(?:version~|v~)?2(?:\.0)?"]),
    ("sspl-1.0", "server side", 0.9, [r"server~side~public~licen[cs]e"]),
    ("json", "good, not evil", 0.9, [r"shall~be~used~for~good,?~not~evil"]),
    ("beerware", "beer", 0.9, [r"beer~?ware~licen[cs]e"]),
    # copyleft
    ("agpl-3.0", "affero", 0.95, [r"affero~general~public~licen[cs]e,?~(?:version|v)~?3", r"affero~gpl~(?:version|v)?~?3"]),
    ("agpl-3.0", "agpl", 0.95, [r"\bagpl~?v?~?3(?:\.0)?\b", r"\bagplv3\b"]),
    ("agpl", "affero", 0.75, [r"affero~general~public~licen[cs]e"]),
    ("agpl", "agpl", 0.7, [r"\bagpl\b"]),
    ("lgpl-2.1", "lesser", 0.95, [r"lesser~general~public~licen[cs]e,?~(?:version|v)~?2\.1"]),
    ("lgpl-3.0", "lesser", 0.95, [r"lesser~general~public~licen[cs]e,?~(?:version|v)~?3"]),
    ("lgpl-2.0", "library general", 0.95, [r"library~general~public~licen[cs]e,?~(?:version|v)~?2"]),
    ("lgpl-2.1", "lgpl", 0.95, [r"\blgpl~?v?~?2\.1\b", r"\blgplv2\.1\b"]),
    ("lgpl-3.0", "lgpl", 0.95, [r"\blgpl~?v?~?3(?:\.0)?\b", r"\blgplv3\b"]),
    ("lgpl", "lesser", 0.75, [r"lesser~general~public~licen[cs]e"]),
    ("lgpl", "lgpl", 0.7, [r"\blgpl\b"]),
    ("gpl-2.0", "general public", 0.95, [r"general~public~licen[cs]e,?~(?:as~published~by~the~free~software~foundation[;,]?~(?:either~)?)?(?:version|v)~?2\b"]),
    ("gpl-3.0", "general public", 0.95, [r"general~public~licen[cs]e,?~(?:as~published~by~the~free~software~foundation[;,]?~(?:either~)?)?(?:version|v)~?3\b"]),
    ("gpl-2.0", "gpl", 0.95, [r"\bgpl~?v?~?2(?:\.0)?\b", r"\bgplv2\b"]),
    ("gpl-3.0", "gpl", 0.95, [r"\bgpl~?v?~?3(?:\.0)?\b", r"\bgplv3\b"]),
    ("gpl", "general public", 0.75, [r"gnu~general~public~licen[cs]e", r"gnu\.org/licenses/gpl"]),
    ("gpl", "gpl", 0.6, [r"\bgnu~gpl\b", r"licen[cs]ed~under~(?:the~)?gpl\b", r"\bgpl~licen[cs]ed?\b"]),
    ("gfdl", "documentation", 0.95, [r"free~documentation~licen[cs]e", r"\bgfdl\b.{0,40}documentation"]),
    ("mpl-2.0", "mozilla", 0.95, [r"mozilla~public~licen[cs]e,?~(?:version|v)~?2(?:\.0)?", r"mozilla\.org/mpl/2\.0"]),
    ("mpl-1.1", "mozilla", 0.95, [r"mozilla~public~licen[cs]e,?~(?:version|v)~?1\.1", r"mozilla\.org/mpl/mpl-1\.1"]),
    ("mpl", "mozilla", 0.75, [r"mozilla~public~licen[cs]e"]),
    ("mpl-2.0", "mpl", 0.9, [r"\bmpl~?v?~?2(?:\.0)?\b"]),
    ("epl-2.0", "eclipse", 0.95, [r"eclipse~public~licen[cs]e,?~(?:-~)?(?:version|v)~?2(?:\.0)?"]),
    ("epl-1.0", "eclipse", 0.95, [r"eclipse~public~licen[cs]e,?~(?:-~)?(?:version|v)~?1(?:\.0)?"]),
    ("epl", "eclipse", 0.75, [r"eclipse~public~licen[cs]e"]),
    ("cddl-1.0", "development and distribution", 0.9, [r"common~development~and~distribution~licen[cs]e"]),
    ("cpl-1.0", "common public", 0.9, [r"common~public~licen[cs]e"]),
    ("eupl-1.2", "european union public", 0.95, [r"european~union~public~licen[cs]e,?~(?:version~|v~)?1\.2", r"european~union~public~licen[cs]e"]),
    ("osl-3.0", "open software", 0.9, [r"open~software~licen[cs]e"]),
    ("cecill", "cecill", 0.9, [r"\bcecill(?:-[bc])?\b"]),
    ("ipl-1.0", "ibm public", 0.9, [r"ibm~public~licen[cs]e"]),
    ("qpl-1.0", "q public", 0.9, [r"\bq~public~licen[cs]e"]),
    # content
    ("cc0-1.0", "cc0", 0.95, [r"\bcc0\b(?:~1\.0)?", r"publicdomain/zero/1\.0.{0,20}cc0"]),
    ("cc0-1.0", "creativecommons", 0.95, [r"creativecommons\.org/publicdomain/zero"]),
    ("cc-by-nc-nd", "cc", 0.95, [r"\bcc~by~nc~nd\b(?:~[1-4]\.0)?"]),
    ("cc-by-nc-sa", "cc", 0.95, [r"\bcc~by~nc~sa\b(?:~[1-4]\.0)?"]),
    ("cc-by-nc", "cc", 0.95, [r"\bcc~by~nc\b(?:~[1-4]\.0)?"]),
    ("cc-by-nd", "cc", 0.95, [r"\bcc~by~nd\b(?:~[1-4]\.0)?"]),
    ("cc-by-sa", "cc", 0.95, [r"\bcc~by~sa\b(?:~[1-4]\.0)?"]),
    ("cc-by", "cc", 0.9, [r"\bcc~by~[1-4]\.0\b", r"\bcc-by\b", r"licen[cs]ed~under~(?:a~)?cc~by\b"]),
    ("cc-by-nc-nd", "creativecommons", 0.95, [r"creativecommons\.org/licenses/by-nc-nd"]),
    ("cc-by-nc-sa", "creativecommons", 0.95, [r"creativecommons\.org/licenses/by-nc-sa"]),
    ("cc-by-nc", "creativecommons", 0.95, [r"creativecommons\.org/licenses/by-nc\b"]),
    ("cc-by-nd", "creativecommons", 0.95, [r"creativecommons\.org/licenses/by-nd"]),
    ("cc-by-sa", "creativecommons", 0.95, [r"creativecommons\.org/licenses/by-sa"]),
    ("cc-by", "creativecommons", 0.95, [r"creativecommons\.org/licenses/by\b"]),
    ("cc-by-nc-nd", "creative commons", 0.95, [r"creative~commons~attribution~non~?commercial~no~?deriv\w*"]),
    ("cc-by-nc-sa", "creative commons", 0.95, [r"creative~commons~attribution~non~?commercial~share~?alike"]),
    ("cc-by-nc", "creative commons", 0.95, [r"creative~commons~attribution~non~?commercial"]),
    ("cc-by-nd", "creative commons", 0.95, [r"creative~commons~attribution~no~?deriv\w*"]),
    ("cc-by-sa", "creative commons", 0.95, [r"creative~commons~attribution~share~?alike"]),
    ("cc-by", "creative commons", 0.85, [r"creative~commons~attribution~(?:[1-4]\.0~)?(?:international~)?licen[cs]e", r"creative~commons~attribution\b"]),
    ("cc-unknown", "creative commons", 0.6, [r"creative~commons~licen[cs]e", r"under~(?:a~)?creative~commons"]),
    ("odbl-1.0", "open database", 0.9, [r"open~database~licen[cs]e", r"\bodbl\b.{0,40}open~database"]),
    ("odc-by", "open data commons", 0.9, [r"open~data~commons~attribution"]),
    ("ogl-uk-3.0", "open government", 0.9, [r"open~government~licen[cs]e"]),
    ("public-domain", "public domain", 0.8, [r"(?:released|placed|dedicated|put)~(?:in|into|to)~the~public~domain", r"(?:is|are)~in~the~public~domain", r"public~domain~(?:dedication|mark|work)", r"dedicates?~(?:this|the)~work~to~the~public~domain"]),
    # restrictive and generic
    ("proprietary", "proprietary", 0.8, [r"proprietary~and~confidential", r"confidential~and~proprietary", r"proprietary~licen[cs]e", r"proprietary~software"]),
    ("commercial", "commercial", 0.6, [r"commercial~licen[cs]e~(?:is~)?required", r"under~a~commercial~licen[cs]e", r"non~?commercial~use~only", r"for~personal,?~non~?commercial~use"]),
    ("eula", "end user", 0.8, [r"end~user~licen[cs]e~agreement"]),
    ("all-rights-reserved", "all rights reserved", 0.5, [r"all~rights~reserved"]),
    ("no-redistribution", "redistribut", 0.6, [r"(?:may|must)~not~(?:be~)?(?:copied|reproduced|republished)[^.\n]{0,60}redistribut\w+", r"redistribution~(?:is~)?(?:prohibited|forbidden|not~permitted)", r"do~not~redistribute"]),
    ("permission-required", "permission", 0.5, [r"without~(?:the~)?(?:prior~)?(?:express~)?(?:written~)?permission~(?:of|from)", r"used?~(?:by|with)~permission", r"reproduced~with~permission"]),
    ("ai-training-reserved", "training", 0.7, [r"(?:may|must)~not~be~used~(?:for|to)~(?:ai|machine~learning|model)?~?train\w*", r"no~(?:ai|machine~learning)~training"]),
    ("copyright-notice", "copyright", 0.4, [r"copyright~(?:(?:c\)|©)~?)?(?:19|20)\d\d", r"\(c\)~copyright~(?:19|20)\d\d"]),
    ("unspecified-license", "licen", 0.3, [r"see~(?:the~)?licen[cs]e~(?:file|for~details)", r"licen[cs]ed~under~the~terms~of", r"this~licen[cs]e~(?:grants|permits|allows)"]),
]
#: Gaps give nothing back: what follows one starts with a letter or digit, so a long run of white space is read once.
_GAP, _ANY_GAP = r"[^a-z0-9\x80-\xff]++", r"[^a-z0-9\x80-\xff]*+"


def literals(pattern: bytes) -> list[bytes]:
    """Runs of bytes that every match of a pattern contains, longest first."""
    runs: list[bytearray] = [bytearray()]

    def walk(items):
        for op, value in items:
            if op is sre.LITERAL:
                runs[-1].append(value)
            elif op is sre.SUBPATTERN:
                walk(value[3])
            elif op is not sre.AT:  # a place takes no byte
                runs.append(bytearray())
                if op is sre.MAX_REPEAT and value[0] > 0:
                    walk(value[2])
                    runs.append(bytearray())

    walk(sre_parser.parse(pattern))
    return sorted({bytes(r) for r in runs if r}, key=lambda r: (-len(r), r))


class Rules:
    """Compiled rules, grouped by the longest literal that each must find; ``rules`` in order of priority."""

    def __init__(self, families=None, base=BASE_PHRASES):
        self.rules, self.by_literal = [], {}
        for label, _, score, patterns in families if families is not None else FAMILIES:
            for pattern in patterns:
                text = pattern.replace("~?", _ANY_GAP).replace("~", _GAP)
                source = text.encode("latin-1", "ignore") if "©" not in text else text.encode()
                first, *others = literals(source) or [b""]
                self.by_literal.setdefault(first, []).append((len(self.rules), others))
                self.rules.append((label, score, re.compile(source)))
        word = rb"[0-9a-z\x80-\xff]"
        self.base = [(label, phrase.split()[-1].encode(), phrase.split()[0].encode(), re.compile(rb"(?<!" + word + rb")" + rb"[^0-9a-z\x80-\xff]++".join(w.encode() for w in phrase.split()) + rb"(?!" + word + rb")"), len(phrase.split())) for phrase, label in base]

    def detect(self, text: bytes) -> list[tuple[int, int, str, float]]:
        """(start, end, label, score) of what stays, by start: a detection that lies within one of higher priority goes,
        and so does one that lies within a longer one."""
        found = []
        for first, places in self.by_literal.items():
            if first in text:
                found += [(i, *m.span()) for i, others in places if all(x in text for x in others) for m in self.rules[i][2].finditer(text)]
        return suppress([(i, s, e, self.rules[i][0], self.rules[i][1]) for i, s, e in found])

    def base_places(self, text: bytes) -> list[tuple[int, str]]:
        """(byte start, label) of every place where a phrase's words stand one after another; text is lower-cased."""
        found = []
        for label, last, first, pattern, _ in self.base:
            if last in text and first in text:
                at = 0
                while m := pattern.search(text, at):
                    found.append((m.start(), label))
                    at = m.start() + 1
        return sorted(found)


def suppress(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Resolve overlaps: by priority (rule order), drop a span that is contained in a kept one, or that contains a kept
    one of the same label; a general label (`gpl`) also yields to a kept one of its family (`gpl-3.0`) that it crosses. One sweep over sorted starts with a running set of kept spans; spans that only cross stay."""
    kept: list[tuple[int, int, str, float]] = []
    by_start = sorted(set(found), key=lambda x: (x[1], -x[2], x[0]))
    cluster: list = []
    end = -1

    def flush():
        own: list[tuple[int, int, str, float]] = []
        for _, s, e, label, score in sorted(cluster, key=lambda x: (x[0], x[1])):
            if not any((a <= s and e <= b) or (label == other and s <= a and b <= e) or (s < b and a < e and other.startswith(f"{label}-")) for a, b, other, _ in own):
                own.append((s, e, label, score))
        kept.extend(sorted(own))

    for x in by_start:
        if x[1] >= end and cluster:
            flush()
            cluster = []
        cluster.append(x)
        end = max(end, x[2])
    flush()
    return kept


def word_counts(texts: list[bytes]) -> np.ndarray:
    out = []
    for first, last in groups(texts):
        offsets = np.zeros(last - first + 1, np.int64)
        np.cumsum([len(t) for t in texts[first:last]], out=offsets[1:])
        out.append(word_bounds(np.frombuffer(b"".join(texts[first:last]), np.uint8), offsets, NO_WORD)[2])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,score:double>>"


def scan_licenses(docs: DataFrame, ids: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """Labels of the licenses that each document's whole text names.

    Returns one row per input row: the id, n_words, and of the base phrases n_base, first_word, last_word, base_labels;
    labels (the rules' and the base ones), score (of the surest detection, 1 where a base phrase stands, else 0) and
    detections (byte spans after suppression, label, score).

    One pass over the rows without a shuffle. A rule's regexes run only where all literals that they
    need are in the text. Null and empty
    texts have no words and no labels; null ids and repeated rows are rows as any; other columns are ignored.
    """
    rules = rules or Rules()
    kind = dict(docs.select(ids).dtypes)[ids]
    types = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())])))])

    def scan(batches):
        for batch in small(batches):
            texts, rows = texts_of(batch, "text"), []
            counts = word_counts(texts)
            for text_, n in zip(texts, counts.tolist()):
                low = text_.lower()
                base, found = rules.base_places(low), rules.detect(low)
                if base:
                    at = [int(word_counts([low[: s] + b" "])[0]) for s in (base[0][0], base[-1][0])]
                own = {label for _, label in base}
                labels = own | {label for _, _, label, _ in found}
                rows.append({"n_words": n, "n_base": len(base), "first_word": at[0] if base else None, "last_word": at[1] if base else None, "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(labels)), "score": max([1.0 * bool(base), *(x[3] for x in found)]), "detections": [dict(zip(("start", "end", "label", "score"), x)) for x in found]})
            out = pa.RecordBatch.from_pylist(rows, schema=types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=[ids, *types.names])

    return docs.select(ids, docs[text].alias("text")).mapInArrow(scan, f"`{ids}` {kind}, {SCHEMA}")
