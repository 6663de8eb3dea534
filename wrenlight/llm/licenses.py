"""License scans by sentence rules: known sentences get identifiers, rules match their order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SentenceRule:
    """Words that licences use: ``pattern`` may stand anywhere in a normalised sentence."""

    name: str
    pattern: str


@dataclass(frozen=True)
class LicenseRule:
    """``license`` is found where ``sequence`` occurs, in this order and without gap."""

    license: str
    sequence: tuple[str, ...]


# Words of a reference, and words between a licence's name and its version: none that starts
# another name or version. They are counted only because Java's matcher recurses over them.
_UNDER = r"\b(?:released|licensed|distributed|available) under (?:the terms of )?(?:the )?"
_GAP = r"(?: (?!(?:gnu|version|v|v?[0-9.]+|mit|apache|mozilla|bsd)\b)[^ <]+){0,40}?"
_LATER = r"(?: or(?: (?:at|in) (?:your|its) option)?(?: any)? (?:later|newer)\b| or(?: [^ <]+){0,8}? any later version\b)"


def _gnu(name: str, version: str, after: str = "") -> str:
    return rf"(?:{_UNDER})?\b{name}{_GAP} (?:version|v) ?{version}(?![0-9.]){after}"


def _cc(kind: str) -> str:
    return rf"\blicensed under (?:a |the )?(?:cc|creative commons) (?:by|attribution){kind}(?: license)? [0-9.]+(?: international| license)*"


_GPL = r"gnu general public license(?: gpl)?"
_LGPL = r"gnu (?:lesser|library) general public license(?: lgpl)?"

# Words after normalising (lower case, words and digits and dots between
# digits only, one space between words). A version that a sentence names is part of its rule.
# Earlier rules take their words first.
SENTENCES = (
    SentenceRule("ApacheLicWRef2", _UNDER + r"apache license (?:version |v ?)?2(?:\.0)?(?![0-9.])(?: the license)?"),
    SentenceRule("ApacheYouMayNot", r"you may not use this (?:file|work) except in compliance with the license"),
    SentenceRule("ApacheCopyAt", r"you may obtain a copy of the license at\b"),
    SentenceRule("ApacheUrl", r"\bhttps? www apache org licenses license 2\.0"),
    SentenceRule("ApacheUnless", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    SentenceRule("MITLicRef", _UNDER + r"mit license\b(?: mit\b)?"),
    SentenceRule("MITTitle", r"\b(?:the )?mit license(?: mit)?(?= copyright| permission|$)"),
    SentenceRule("MITGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    SentenceRule("MITNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    SentenceRule("AsIs", r"\bth(?:e|is) software is provided\b(?=(?>.*?\bas is\b)(?>.*?\b(?:without|and any)\b).*?\bwarrant(?:y|ies))"),
    SentenceRule("AGPLv3+Ref", _gnu(r"(?:gnu )?affero general public license(?: agpl)?", r"3(?:\.0)?", _GAP + _LATER)),
    SentenceRule("AGPLv3Ref", _gnu(r"(?:gnu )?affero general public license(?: agpl)?", r"3(?:\.0)?")),
    SentenceRule("LGPLv3+Ref", _gnu(_LGPL, r"3(?:\.0)?", _GAP + _LATER)),
    SentenceRule("LGPLv3Ref", _gnu(_LGPL, r"3(?:\.0)?")),
    SentenceRule("LGPLv2.1+Ref", _gnu(_LGPL, r"2\.1", _GAP + _LATER)),
    SentenceRule("LGPLv2.1Ref", _gnu(_LGPL, r"2\.1")),
    SentenceRule("GPLv3+Ref", _gnu(_GPL, r"3(?:\.0)?", _GAP + _LATER)),
    SentenceRule("GPLv3Ref", _gnu(_GPL, r"3(?:\.0)?", r"(?: only\b)?")),
    SentenceRule("GPLv2+Ref", _gnu(_GPL, r"2(?:\.0)?", _GAP + _LATER)),
    SentenceRule("GPLv2Ref", _gnu(_GPL, r"2(?:\.0)?", r"(?: only\b)?")),
    SentenceRule("GPLRef", _UNDER + r"gnu general public license\b(?: gpl\b)?"),
    SentenceRule("CC-BY-NC-SA", _cc(r" (?:nc|non ?commercial) (?:sa|share ?alike)")),
    SentenceRule("CC-BY-NC-ND", _cc(r" (?:nc|non ?commercial) (?:nd|no ?derivatives)")),
    SentenceRule("CC-BY-NC", _cc(r" (?:nc|non ?commercial)")),
    SentenceRule("CC-BY-SA", _cc(r" (?:sa|share ?alike)")),
    SentenceRule("CC-BY", _cc("")),
    SentenceRule("CC0", r"\b(?:cc0|creative commons zero)\b"),
    SentenceRule("BSDPre", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    SentenceRule("BSDSource", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    SentenceRule("BSDBinary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    SentenceRule("BSDEndorse", r"neither the name of .*? may be used to endorse or promote products derived from this software without specific prior written permission"),
    SentenceRule("BSD3Ref", _UNDER + r"(?:bsd 3 clause|3 clause bsd)(?: license)?\b"),
    SentenceRule("BSD2Ref", _UNDER + r"(?:bsd 2 clause|2 clause bsd)(?: license)?\b"),
    SentenceRule("BSDRef", _UNDER + r"bsd license\b"),
    SentenceRule("MPLv2Ref", r"\bsubject to the terms of the mozilla public license v(?:ersion )? ?2\.0"),
    SentenceRule("MPLv2RefLic", r"\blicensed under the mozilla public license v(?:ersion)? ?2\.0"),
    SentenceRule("EPLv2Ref", r"\beclipse public license(?: epl)?(?: version| v)? 2(?:\.0)?(?![0-9.])"),
    SentenceRule("EPLv1Ref", r"\beclipse public license(?: epl)?(?: version| v)? 1(?:\.0)?(?![0-9.])"),
    SentenceRule("ISCGrant", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    SentenceRule("0BSDGrant", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    SentenceRule("ISCRef", _UNDER + r"isc license\b"),
    SentenceRule("Unencumbered", r"this is free and unencumbered software released into the public domain"),
    SentenceRule("UnlicenseUse", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    SentenceRule("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    SentenceRule("ZlibRef", _UNDER + r"zlib license\b"),
    SentenceRule("BSLRef", r"\bboost software license(?: version)? 1\.0(?![0-9.])"),
    SentenceRule("CDDLRef", r"\bcommon development and distribution license(?: cddl)?(?: version| v)? 1\.0(?![0-9.])"),
    SentenceRule("ArtisticRef", r"\bartistic license(?: version)? 2\.0(?![0-9.])"),
    SentenceRule("OFLRef", r"\bsil open font license(?: ofl)?(?: version| v)? 1\.1(?![0-9.])"),
    SentenceRule("MSPLRef", r"\bmicrosoft public license\b(?: ms pl\b)?"),
    SentenceRule("PSFRef", r"\bpython software foundation license(?: version)? 2(?![0-9.])"),
    SentenceRule("AllRights", r"\ball rights reserved\b"),
)

# Rules in order; the first that fits at a place takes its sentences.
RULES = (
    LicenseRule("Apache-2.0", ("ApacheLicWRef2", "ApacheYouMayNot", "ApacheCopyAt", "ApacheUrl", "ApacheUnless")),
    LicenseRule("Apache-2.0", ("ApacheLicWRef2", "ApacheYouMayNot", "ApacheCopyAt", "ApacheUrl")),
    LicenseRule("Apache-2.0", ("ApacheLicWRef2", "ApacheYouMayNot", "ApacheCopyAt", "ApacheUnless")),
    LicenseRule("Apache-2.0", ("ApacheLicWRef2", "ApacheYouMayNot", "ApacheCopyAt")),
    LicenseRule("Apache-2.0", ("ApacheLicWRef2",)),
    LicenseRule("MIT", ("MITTitle", "MITGrant", "MITNotice", "AsIs")),
    LicenseRule("MIT", ("MITGrant", "MITNotice", "AsIs")),
    LicenseRule("MIT", ("MITGrant", "MITNotice")),
    LicenseRule("MIT", ("MITLicRef",)),
    LicenseRule("BSD-3-Clause", ("BSDPre", "BSDSource", "BSDBinary", "BSDEndorse", "AsIs")),
    LicenseRule("BSD-3-Clause", ("BSDPre", "BSDSource", "BSDBinary", "BSDEndorse")),
    LicenseRule("BSD-2-Clause", ("BSDPre", "BSDSource", "BSDBinary", "AsIs")),
    LicenseRule("BSD-2-Clause", ("BSDPre", "BSDSource", "BSDBinary")),
    LicenseRule("BSD-3-Clause", ("BSD3Ref",)),
    LicenseRule("BSD-2-Clause", ("BSD2Ref",)),
    LicenseRule("BSD", ("BSDRef",)),
    LicenseRule("AGPL-3.0-or-later", ("AGPLv3+Ref",)),
    LicenseRule("AGPL-3.0", ("AGPLv3Ref",)),
    LicenseRule("LGPL-3.0-or-later", ("LGPLv3+Ref",)),
    LicenseRule("LGPL-3.0", ("LGPLv3Ref",)),
    LicenseRule("LGPL-2.1-or-later", ("LGPLv2.1+Ref",)),
    LicenseRule("LGPL-2.1", ("LGPLv2.1Ref",)),
    LicenseRule("GPL-3.0-or-later", ("GPLv3+Ref",)),
    LicenseRule("GPL-3.0", ("GPLv3Ref",)),
    LicenseRule("GPL-2.0-or-later", ("GPLv2+Ref",)),
    LicenseRule("GPL-2.0", ("GPLv2Ref",)),
    LicenseRule("GPL", ("GPLRef",)),
    LicenseRule("CC-BY-NC-SA", ("CC-BY-NC-SA",)),
    LicenseRule("CC-BY-NC-ND", ("CC-BY-NC-ND",)),
    LicenseRule("CC-BY-NC", ("CC-BY-NC",)),
    LicenseRule("CC-BY-SA", ("CC-BY-SA",)),
    LicenseRule("CC-BY", ("CC-BY",)),
    LicenseRule("CC0-1.0", ("CC0",)),
    LicenseRule("EPL-2.0", ("EPLv2Ref",)),
    LicenseRule("EPL-1.0", ("EPLv1Ref",)),
    LicenseRule("ISC", ("ISCGrant", "AsIs")),
    LicenseRule("ISC", ("ISCGrant",)),
    LicenseRule("ISC", ("ISCRef",)),
    LicenseRule("0BSD", ("0BSDGrant", "AsIs")),
    LicenseRule("0BSD", ("0BSDGrant",)),
    LicenseRule("Unlicense", ("Unencumbered", "UnlicenseUse")),
    LicenseRule("Unlicense", ("Unencumbered",)),
    LicenseRule("Zlib", ("AsIs", "ZlibGrant")),
    LicenseRule("Zlib", ("ZlibGrant",)),
    LicenseRule("Zlib", ("ZlibRef",)),
    LicenseRule("BSL-1.0", ("BSLRef",)),
    LicenseRule("CDDL-1.0", ("CDDLRef",)),
    LicenseRule("Artistic-2.0", ("ArtisticRef",)),
    LicenseRule("OFL-1.1", ("OFLRef",)),
    LicenseRule("MS-PL", ("MSPLRef",)),
    LicenseRule("PSF-2.0", ("PSFRef",)),
    LicenseRule("MPL-2.0", ("MPLv2Ref",)),
    LicenseRule("MPL-2.0", ("MPLv2RefLic",)),
)

# Fixed value: every sentence above holds one of these words, so that others need no rule.
TELLING = r"licen[sc]e|spdx|permission|warrant|redistribution|rights reserved|\bcc0\b|creative commons|required by applicable law|public domain|anyone is free to"

#: A sentence ends at ``.``, ``!`` or ``?`` before a blank or the end, but not at that of
#: ``v. 2``, and at a line without letters and digits. Other line breaks are wrapping.
SENTENCE_END = r"(?<!\b[vV])[.!?]+(?=\s|$)|\n[^\p{L}\p{N}\n]*(?=\n)"

#: A tag's identifier is this and its expression, which is the licence.
TAGGED = "SPDX:"

#: Comment marks made of letters; others vanish with the punctuation.
MARKS = r"(?im)^[ \t]*(?:dnl|rem)\b"

#: A tag that names licences by an expression: identifiers, a plus sign for later versions, words
#: between them and parentheses. It is a sentence of its own, to the end of its line.
TAG = r"(?i)((?:spdx-license-identifier|^[^\p{L}\p{N}\n]*licen[sc]e)[ \t]*:[ \t]*)"
_IDENTIFIER = r"\(*[A-Za-z][A-Za-z0-9.+-]*[A-Za-z0-9+]\)*"
EXPRESSION = rf"{TAG}({_IDENTIFIER}(?: (?:AND|OR|WITH|and|or|with) {_IDENTIFIER})*)\.?[^\p{{L}}\p{{N}}\n]*$"
TAG_LINE = rf"(?m){TAG}([^\n]*)$"


def joined(text: Column) -> Column:
    """The text with plain line breaks, no comment marks of letters, and identifiers set off."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), MARKS, "")
    return F.regexp_replace(plain, TAG_LINE, "\n\n$1$2\n\n")


def normalised(sentence: Column) -> Column:
    """Lower case; letters, digits and dots inside numbers stay; one space between words."""
    low = F.lower(sentence)
    words = F.regexp_replace(low, r"(?<![0-9])\.|\.(?![0-9])|[^\p{L}\p{N}.]+", " ")
    return F.trim(F.replace(F.regexp_replace(words, r" {2,}", " "), F.lit("licence"), F.lit("license")))


def tagged(sentence: Column) -> Column:
    """The expression of a tag, with a plus sign as ``-or-later``; empty if there is none."""
    found = F.regexp_extract(F.trim(sentence), f"(?m){EXPRESSION}", 2)
    return F.regexp_replace(found, r"\+(?=[) ]|$)", "-or-later")


def sentence_ids(sentence: Column, rules: tuple[SentenceRule, ...] = SENTENCES) -> Column:
    """The rules that a normalised sentence holds, each once, by place; ``?`` if none."""
    marked = sentence
    for rule in rules:
        marked = F.regexp_replace(marked, rule.pattern, f"<{rule.name}>")
    found = F.regexp_extract_all(marked, F.lit("<([^>]+)>"), F.lit(1))
    return F.transform(
        F.array(F.array_distinct(found)),
        lambda names: F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("?"))),
    )[0]


def license_matches(text: Column) -> Column:
    """The identifiers of a text's telling sentences, in order, ``?`` for one without."""
    sentences = F.filter(
        F.split(joined(text), SENTENCE_END), lambda s: F.lower(s).rlike(TELLING)
    )


    def identified(sentence: Column) -> Column:
        by_tag = F.transform(
            F.array(tagged(sentence)),
            lambda tag: F.when(tag != "", F.array(F.concat(F.lit(TAGGED), tag))).otherwise(
                sentence_ids(normalised(sentence))
            ),
        )
        return by_tag[0]

    return F.flatten(F.transform(sentences, identified))


def _pattern(rules: tuple[LicenseRule, ...]) -> str:
    """All rules as one alternation over a sequence written as ``<a><b>``, in their order."""
    import re

    fixed = ["".join(f"<{re.escape(s)}>" for s in rule.sequence) for rule in rules]
    return "|".join([*fixed, f"<{TAGGED}[^>]+>"])


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rules: tuple[LicenseRule, ...] = RULES,
) -> DataFrame:
    """``doc_id, sentence_ids, licenses, unknown`` for every row.

    Wrapped lines are joined, comment marks included, and the text is cut into
    sentences at sentence ends and blank lines. Those with a telling word are
    normalised and get the identifiers of all sentence rules whose words they
    hold, by place, or ``?``; a licence tag's expression is an identifier and a licence by
    itself. The rules are tried in their order at each place
    of the identifier sequence; one that fits takes its sentences.
    ``licenses`` lists the licences found in order of place, repeats included,
    ``unknown`` counts the identifiers, ``?`` included, that no rule took.

    All of it happens inside the row: nothing is shuffled. Null and empty texts
    have empty lists; repeated rows and other columns need no care.
    """
    by_sequence = F.create_map(
        *(
            F.lit(x)
            for sequence, name in _first_of_each(rules).items()
            for x in (sequence, name)
        )
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    empty = F.array().cast("array<string>")
    telling = F.lower("text").rlike(TELLING)
    ids = rows.select(
        "doc_id",
        F.when(telling, license_matches(F.col("text"))).otherwise(empty).alias("sentence_ids"),
    )

    def named(hit: Column) -> Column:
        tag = F.substring(hit, len(TAGGED) + 2, 1 << 20)
        return F.when(hit.startswith("<" + TAGGED), F.replace(tag, F.lit(">"), F.lit(""))).otherwise(
            F.try_element_at(by_sequence, hit)
        )

    line = F.concat(F.lit("<"), F.array_join("sentence_ids", "><"), F.lit(">"))
    found = ids.withColumn("hits", F.regexp_extract_all(line, F.lit(f"({_pattern(rules)})"), F.lit(1)))
    taken = F.aggregate(
        "hits",
        F.lit(0),
        lambda n, hit: n + F.length(hit) - F.length(F.replace(hit, F.lit("<"), F.lit(""))),
    )
    return found.select(
        "doc_id",
        F.coalesce("sentence_ids", empty).alias("sentence_ids"),
        F.coalesce(F.transform("hits", named), empty).alias("licenses"),
        F.coalesce(F.size("sentence_ids") - taken, F.lit(0)).alias("unknown"),
    )


def _first_of_each(rules: tuple[LicenseRule, ...]) -> dict[str, str]:
    names: dict[str, str] = {}
    for rule in rules:
        names.setdefault("".join(f"<{s}>" for s in rule.sequence), rule.license)
    return names
