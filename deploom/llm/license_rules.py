"""Signature rules for licence detection, in order of priority within each tier.

A rule is (label, tier, keyword, pattern).  Patterns run over lower-case words with one space
between them; a document is only held against rules whose keyword it contains.  Tiers: 0 exact
identifiers, 1 full names with versions, 2 names, 3 generic notices.
"""

from __future__ import annotations

VERSION = "(?: version)?(?: v)?"

#: Hand-written signatures: label, tier, keyword, pattern.
WRITTEN = [
    ("apache-2.0", 0, "apache", "spdx license identifier apache 2 0"),
    ("apache-2.0", 1, "apache", "apache license(?: version)? 2 0"),
    ("apache-2.0", 1, "apache", "apache software license(?: version)? 2 0"),
    ("apache-2.0", 1, "apache", "www apache org licenses license 2 0"),
    ("apache-1.1", 1, "apache", "apache (?:software )?license(?: version)? 1 1"),
    ("apache-1.0", 1, "apache", "apache (?:software )?license(?: version)? 1 0"),
    ("apache", 2, "apache", "apache (?:software )?license"),
    ("apache", 2, "apache", "apache licensed"),
    ("apache", 2, "apache", "licensed under apache"),
    ("mit", 0, "mit", "spdx license identifier mit"),
    ("mit", 1, "mit", "(?:the )?mit license"),
    ("mit", 1, "mit", "released under (?:the )?mit(?: license)?"),
    ("mit", 1, "mit", "licensed under (?:the )?mit(?: license)?"),
    ("mit", 1, "mit", "mit licensed"),
    ("mit", 1, "opensource", "opensource org licenses mit(?: license php)?"),
    ("mit", 2, "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 2, "noninfringement", "fitness for a particular purpose and noninfringement"),
    ("mit-0", 1, "attribution", "mit no attribution"),
    ("x11", 1, "x11", "(?:the )?x11 license"),
    ("expat", 1, "expat", "(?:the )?expat license"),
    ("isc", 0, "isc", "spdx license identifier isc"),
    ("isc", 1, "isc", "(?:the )?isc license"),
    ("isc", 2, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd-0-clause", 1, "bsd", "(?:0|zero) clause bsd(?: license)?"),
    ("bsd-1-clause", 1, "bsd", "(?:1|one) clause bsd(?: license)?"),
    ("bsd-2-clause", 1, "bsd", "(?:2|two) clause bsd(?: license)?"),
    ("bsd-2-clause", 1, "bsd", "bsd (?:2|two) clause(?: license)?"),
    ("bsd-2-clause", 1, "bsd", "simplified bsd license"),
    ("bsd-2-clause", 1, "freebsd", "freebsd license"),
    ("bsd-3-clause", 1, "bsd", "(?:3|three) clause bsd(?: license)?"),
    ("bsd-3-clause", 1, "bsd", "bsd (?:3|three) clause(?: license)?"),
    ("bsd-3-clause", 1, "bsd", "(?:new|revised|modified) bsd license"),
    ("bsd-3-clause", 2, "neither", "neither the name of .{0,80}? nor the names of its contributors"),
    ("bsd-4-clause", 1, "bsd", "(?:4|four) clause bsd(?: license)?"),
    ("bsd-4-clause", 1, "bsd", "bsd (?:4|four) clause(?: license)?"),
    ("bsd-4-clause", 1, "bsd", "(?:original|old) bsd license"),
    ("bsd-4-clause", 2, "advertising", "all advertising materials mentioning features or use of this software"),
    ("bsd", 2, "bsd", "bsd (?:style )?license"),
    ("bsd", 2, "berkeley", "berkeley software distribution"),
    ("bsd", 3, "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", 3, "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 3, "redistribution", "redistribution and use in source and binary forms with or without modification"),
    ("gpl", 2, "general", "gnu general public license"),
    ("gpl", 2, "general", "general public license"),
    ("gpl", 3, "gpl", "(?:gnu )?gpl"),
    ("gpl", 3, "gpl", "gpl compatible"),
    ("gpl", 3, "gnu", "www gnu org licenses"),
    ("gpl", 3, "copyleft", "copyleft"),
    ("gpl", 3, "redistribute", "free software you can redistribute it and or modify it"),
    ("gpl", 3, "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", 2, "lesser", "(?:gnu )?lesser general public license"),
    ("lgpl", 2, "library", "(?:gnu )?library general public license"),
    ("lgpl", 3, "lgpl", "(?:gnu )?lgpl"),
    ("agpl", 2, "affero", "(?:gnu )?affero general public license"),
    ("agpl", 3, "agpl", "(?:gnu )?agpl"),
    ("gfdl", 2, "documentation", "(?:gnu )?free documentation license"),
    ("gfdl", 3, "gfdl", "(?:gnu )?gfdl"),
    ("classpath-exception", 1, "classpath", "classpath exception"),
    ("gcc-exception", 1, "runtime", "gcc runtime library exception"),
    ("mpl-1.0", 1, "mozilla", "mozilla public license(?: version)? 1 0"),
    ("mpl-1.1", 1, "mozilla", "mozilla public license(?: version)? 1 1"),
    ("mpl-2.0", 1, "mozilla", "mozilla public license(?: version)?(?: v)? 2 0"),
    ("mpl-2.0", 1, "mozilla", "mozilla org mpl 2 0"),
    ("mpl", 2, "mozilla", "mozilla public license"),
    ("epl-1.0", 1, "eclipse", "eclipse public license(?: version)?(?: v)? 1 0"),
    ("epl-2.0", 1, "eclipse", "eclipse public license(?: version)?(?: v)? 2 0"),
    ("epl", 2, "eclipse", "eclipse public license"),
    ("edl-1.0", 1, "eclipse", "eclipse distribution license(?: version)?(?: v)?(?: 1 0)?"),
    ("cpl-1.0", 1, "common", "common public license(?: version)?(?: 1 0)?"),
    ("ipl-1.0", 1, "ibm", "ibm public license(?: version)?(?: 1 0)?"),
    ("cddl-1.0", 1, "common", "common development and distribution license(?: version)?(?: 1 0)?"),
    ("cddl-1.1", 1, "common", "common development and distribution license(?: version)? 1 1"),
    ("cddl", 2, "cddl", "cddl"),
    ("cpal-1.0", 1, "common", "common public attribution license(?: version)?(?: 1 0)?"),
    ("eupl-1.1", 1, "european", "european union public licen[cs]e(?: version)?(?: v)? 1 1"),
    ("eupl-1.2", 1, "european", "european union public licen[cs]e(?: version)?(?: v)? 1 2"),
    ("eupl", 2, "european", "european union public licen[cs]e"),
    ("eupl", 3, "eupl", "eupl"),
    ("artistic-1.0", 1, "artistic", "artistic license(?: version)? 1 0"),
    ("artistic-2.0", 1, "artistic", "artistic license(?: version)? 2 0"),
    ("artistic", 2, "artistic", "artistic license"),
    ("perl", 2, "perl", "same terms as perl(?: itself)?"),
    ("python-2.0", 1, "python", "python software foundation license(?: version)?(?: 2)?"),
    ("psf", 2, "psf", "psf license"),
    ("php-3.01", 1, "php", "php license(?: version)? 3 01"),
    ("php-3.0", 1, "php", "php license(?: version)? 3 0"),
    ("php", 2, "php", "php license"),
    ("ruby", 2, "ruby", "ruby license"),
    ("zlib", 1, "zlib", "zlib(?: libpng)? license"),
    ("libpng", 1, "libpng", "libpng license"),
    ("zlib", 2, "misrepresented", "the origin of this software must not be misrepresented"),
    ("boost-1.0", 1, "boost", "boost software license(?: version)?(?: 1 0)?"),
    ("boost", 2, "boost", "boost license"),
    ("openssl", 1, "openssl", "openssl license"),
    ("ssleay", 1, "ssleay", "ssleay license"),
    ("unlicense", 1, "unlicense", "(?:the )?unlicense"),
    ("unlicense", 2, "unencumbered", "free and unencumbered software released into the public domain"),
    ("wtfpl", 1, "wtfpl", "wtfpl"),
    ("beerware", 1, "beerware", "beerware(?: license)?"),
    ("postgresql", 1, "postgresql", "postgresql licen[cs]e"),
    ("ncsa", 1, "ncsa", "(?:university of illinois )?ncsa (?:open source )?license"),
    ("ms-pl", 1, "microsoft", "microsoft public license"),
    ("ms-rl", 1, "microsoft", "microsoft reciprocal license"),
    ("afl-2.1", 1, "academic", "academic free license(?: version)?(?: v)? 2 1"),
    ("afl-3.0", 1, "academic", "academic free license(?: version)?(?: v)? 3 0"),
    ("afl", 2, "academic", "academic free license"),
    ("osl-3.0", 1, "open", "open software license(?: version)?(?: v)? 3 0"),
    ("osl", 2, "open", "open software license"),
    ("ofl-1.1", 1, "font", "(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("odbl-1.0", 1, "database", "open (?:data commons open )?database license(?: version)?(?: v)?(?: 1 0)?"),
    ("odc-by-1.0", 1, "commons", "open data commons attribution license(?: version)?(?: v)?(?: 1 0)?"),
    ("pddl-1.0", 1, "public", "public domain dedication and licen[cs]e"),
    ("cdla-permissive", 1, "data", "community data license agreement permissive"),
    ("cdla-sharing", 1, "data", "community data license agreement sharing"),
    ("ogl-uk-1.0", 1, "government", "open government licen[cs]e(?: version)?(?: v)? 1 0"),
    ("ogl-uk-2.0", 1, "government", "open government licen[cs]e(?: version)?(?: v)? 2 0"),
    ("ogl-uk-3.0", 1, "government", "open government licen[cs]e(?: version)?(?: v)? 3 0"),
    ("ogl-uk", 2, "government", "open government licen[cs]e"),
    ("sspl-1.0", 1, "server", "server side public license(?: version)?(?: v)?(?: 1)?"),
    ("busl-1.1", 1, "business", "business source license(?: version)?(?: 1 1)?"),
    ("elastic-2.0", 1, "elastic", "elastic license(?: version)?(?: 2 0)?"),
    ("polyform", 1, "polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use) license(?: 1 0 0)?"),
    ("commons-clause", 1, "clause", "commons clause(?: license condition)?(?: v 1 0)?"),
    ("mulan-psl-2.0", 1, "mulan", "mulan (?:psl|permissive software license)(?: v 2)?"),
    ("qpl-1.0", 1, "public", "q public license(?: version)?(?: 1 0)?"),
    ("npl-1.1", 1, "netscape", "netscape public license(?: version)?(?: 1 [01])?"),
    ("spl-1.0", 1, "sun", "sun public license(?: version)?(?: 1 0)?"),
    ("sissl", 1, "sun", "sun industry standards source license"),
    ("apsl-2.0", 1, "apple", "apple public source license(?: version)?(?: 2 0)?"),
    ("lppl-1.3c", 1, "latex", "latex project public license(?: version)?(?: 1 3c)?"),
    ("vim", 1, "vim", "vim license"),
    ("tcl", 1, "tcl", "tcl(?: tk)? license"),
    ("curl", 1, "curl", "curl license"),
    ("icu", 1, "icu", "icu license"),
    ("unicode", 1, "unicode", "unicode(?: data files and software)? license(?: agreement)?"),
    ("ijg", 1, "jpeg", "independent jpeg group(?: s)?(?: license| software)?"),
    ("freetype", 1, "freetype", "freetype(?: project)? license"),
    ("intel", 1, "intel", "intel (?:open source|simplified software) license"),
    ("w3c", 1, "w3c", "w3c (?:software )?(?:notice and )?(?:document )?license"),
    ("rpl-1.5", 1, "reciprocal", "reciprocal public license(?: 1 5)?"),
    ("watcom-1.0", 1, "watcom", "sybase open watcom public license(?: 1 0)?"),
    ("zpl-2.1", 1, "zope", "zope public license(?: version)?(?: zpl)?(?: 2 [01])?"),
    ("erlpl-1.1", 1, "erlang", "erlang public license(?: version)?(?: 1 1)?"),
    ("hpnd", 1, "historical", "historical permission notice and disclaimer"),
    ("json", 1, "evil", "the software shall be used for good not evil"),
    ("blueoak-1.0.0", 1, "blue", "blue oak model license(?: 1 0 0)?"),
    ("cecill-2.1", 1, "cecill", "cecill(?: b| c)?(?: free software license agreement)?(?: version)?(?: 2 [01])?"),
    ("rail", 1, "rail", "(?:open|bigscience|bigcode) rail(?: m)?(?: license)?"),
    ("llama", 1, "llama", "llama [0-9] (?:[0-9] )?community license(?: agreement)?"),
    ("public-domain", 2, "domain", "(?:in|into|to) the public domain"),
    ("public-domain", 2, "domain", "public domain dedication"),
    ("public-domain", 3, "domain", "public domain mark(?: 1 0)?"),
    ("reserved", 2, "reserved", "all rights reserved"),
    ("reserved", 2, "reserved", "some rights reserved"),
    ("reserved", 2, "vorbehalten", "alle rechte vorbehalten"),
    ("reserved", 2, "réservés", "tous droits réservés"),
    ("reserved", 2, "reservados", "(?:todos los )?derechos reservados"),
    ("reserved", 2, "riservati", "tutti i diritti riservati"),
    ("reserved", 2, "voorbehouden", "alle rechten voorbehouden"),
    ("copyright", 3, "copyright", "copyright (?:c )?[12][0-9]{3}"),
    ("copyright", 3, "copyright", "copyright (?:notice|holders?|owners?)"),
    ("copyright", 3, "copyrighted", "copyrighted (?:material|work|by)"),
    ("proprietary", 2, "proprietary", "proprietary and confidential"),
    ("proprietary", 2, "prohibited", "unauthorized (?:copying|use|distribution|reproduction) .{0,60}?(?:is )?(?:strictly )?prohibited"),
    ("proprietary", 2, "permission", "without (?:the )?(?:prior )?(?:express )?written permission"),
    ("proprietary", 3, "proprietary", "proprietary (?:license|software)"),
    ("non-commercial", 2, "commercial", "for non commercial (?:use|purposes) only"),
    ("non-commercial", 3, "noncommercial", "noncommercial (?:use|purposes)"),
    ("research-only", 2, "research", "for research (?:use|purposes) only"),
    ("eula", 2, "user", "end user licen[cs]e agreement"),
    ("eula", 3, "eula", "eula"),
    ("notice", 3, "license", "licensed under (?:the )?terms of"),
    ("notice", 3, "license", "(?:see|read) (?:the )?license (?:file|for)(?: details)?"),
    ("notice", 3, "license", "subject to the terms of the license"),
    ("notice", 3, "spdx", "spdx license identifier [a-z0-9]+"),
    ("warranty", 3, "warranty", "provided as is without warranty of any kind"),
    ("warranty", 3, "warranties", "without warranties or conditions of any kind"),
]

#: Creative Commons attributes: short form and long form.
CC = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nd": "attribution no ?deriv(?:ative|ative works|s|atives)",
    "by nc": "attribution non ?commercial",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative|ative works|s|atives)",
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: GNU families: label, keyword, long name, known versions.
GNU = (
    ("gpl", "general", "(?:gnu )?general public license", "gpl", ("1", "2", "3")),
    ("lgpl", "lesser", "(?:gnu )?lesser general public license", "lgpl", ("2 1", "3")),
    ("lgpl", "library", "(?:gnu )?library general public license", "lgpl", ("2",)),
    ("agpl", "affero", "(?:gnu )?affero general public license", "agpl", ("1", "3")),
    ("gfdl", "documentation", "(?:gnu )?free documentation license", "gfdl", ("1 1", "1 2", "1 3")),
)


def rules() -> list[tuple[int, str, int, str, str]]:
    """(rule number, label, priority, keyword, pattern); smaller priorities win."""
    out = list(WRITTEN)
    for short, long in CC.items():
        label = "cc-" + short.replace(" ", "-")
        for v in CC_VERSIONS:
            own = f"{label}-{v.replace(' ', '.')}"
            out.append((own, 1, "cc", f"cc {short} {v}"))
            out.append((own, 1, "creative", f"creative commons {long} {v}(?: international| unported| generic)?"))
            out.append((own, 1, "creativecommons", f"creativecommons org licenses {short} {v}"))
        out.append((label, 2, "cc", f"cc {short}"))
        out.append((label, 2, "creative", f"creative commons {long}"))
    out.append(("cc0-1.0", 1, "cc0", "cc0(?: 1 0)?(?: universal)?"))
    out.append(("cc0-1.0", 1, "creative", "creative commons zero(?: v)?(?: 1 0)?"))
    for label, keyword, long, short, versions in GNU:
        for v in versions:
            own = f"{label}-{v.replace(' ', '.')}"
            later = " or (?:at your option )?(?:any )?later(?: version)?"
            out.append((own + "-or-later", 0, keyword, f"{long}{VERSION} {v}(?: 0)?{later}"))
            out.append((own, 1, keyword, f"{long}{VERSION} {v}(?: 0)?"))
            out.append((own + "-or-later", 0, short, f"(?:gnu )?{short}{VERSION} ?{v}(?: 0)?{later}"))
            out.append((own + "-only", 0, short, f"(?:gnu )?{short}{VERSION} ?{v}(?: 0)? only"))
            out.append((own, 1, short, f"(?:gnu )?{short}{VERSION} ?{v}(?: 0)?"))
    return [(i, label, tier, keyword, pattern) for i, (label, tier, keyword, pattern) in enumerate(out)]
