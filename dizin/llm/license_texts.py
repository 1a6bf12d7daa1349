"""Signatures of license texts: wording of their bodies, headers and notices, which need not name the license.

Each was written by hand for its license. Words are as the scan makes them: lower case, single spaces, no punctuation. ``~n~``
stands for up to n characters of other words. Wording that licenses share is told apart by longer signatures of higher priority.
"""

from __future__ import annotations

import re

_PERMISSION = "permission is hereby granted free of charge to any person obtaining a copy of"
_FORMS = "redistribution and use in source and binary forms"
_ISC = "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"
_GNU = "redistribute (?:it|this (?:program|software|library|file)) and or modify (?:it )?under the terms of the gnu"
_EITHER = "(?:as published by the free software foundation )?(?:either )?"
_CC = "creativecommons org licenses"

#: Label, signature, priority.
SIGNATURES = (
    # MIT, X11, MIT-0
    ("mit", f"{_PERMISSION} this software(?: and associated documentation files)?(?: ~2000~the above copyright notice and this permission notice(?: ~40~)?shall be included in all copies or substantial portions of the software)?", 6),
    ("mit", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 6),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 6),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", 6),
    ("mit-0", f"{_PERMISSION} this software ~500~to permit persons to whom the software is furnished to do so the software is provided(?: ~400~arising from out of or in connection with the software or the use or other dealings in the software)?", 8),
    ("x11", f"{_PERMISSION} this software ~2500~except as contained in this notice the name s? ?of ~200~shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", 9),
    ("x11", "except as contained in this notice the name s? ?of ~200~shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", 6),
    # Boost
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 6),
    ("boost-1.0", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor", 6),
    ("boost-1.0", "www boost org license 1 0 txt", 6),
    # Open Font
    ("ofl-1.1", "permission is hereby granted free of charge to any person obtaining a copy of the font software", 6),
    ("ofl-1.1", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", 6),
    ("ofl-1.1", "no modified version of the font software may use the reserved font name", 6),
    ("ofl-1.1", "scripts sil org ofl", 6),
    # BSD
    ("bsd-2-clause", f"{_FORMS}(?: with or without modification)? are permitted provided that", 6),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 5),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 5),
    ("bsd-3-clause", f"{_FORMS} ~1500~(?:neither the names? of|the names? of) ~300~may (?:not )?be used to endorse or promote products derived from this software(?: without specific prior written permission)?", 8),
    ("bsd-3-clause", "neither the names? of ~300~may be used to endorse or promote products derived from this software without specific prior written permission", 6),
    ("bsd-4-clause", f"{_FORMS} ~1500~all advertising materials mentioning features or use of this software must display the following acknowledge?ment(?: ~1000~endorse or promote products derived from this software(?: without specific prior written permission)?)?", 9),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 6),
    ("bsd-3-clause", "use of this source code is governed by a bsd style license that can be found in the license file", 6),
    # ISC, 0BSD
    ("isc", f"{_ISC} provided that the above copyright notice and this permission notice appear in all copies", 6),
    ("0bsd", f"{_ISC} the software is provided", 6),
    # Apache
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at(?: https?)? www apache org licenses license 2 0", 7),
    ("apache-2.0", "www apache org licenses license 2 0", 6),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 6),
    ("apache-2.0", "apache license version 2 0 january 2004", 6),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? (?:copyright|patent) license", 6),
    ("apache-2.0", "you must give any other recipients of the work or derivative works a copy of this license", 6),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements", 6),
    ("apache-1.1", f"{_FORMS} ~1500~the end user documentation included with the redistribution if any must include the following acknowledge?ment(?: ~1500~nor may apache appear in their name)?", 10),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledge?ment", 6),
    ("apache-1.0", f"{_FORMS} ~1500~all advertising materials mentioning features or use of this software must display the following acknowledge?ment this product includes software developed by the apache group(?: ~1500~nor may apache appear in their names?)?", 10),
    ("apache-1.0", "this product includes software developed by the apache group", 7),
    # GNU notices
    ("gpl-1.0", f"{_GNU} general public license {_EITHER}version 1(?: of the license)?", 7),
    ("gpl-2.0", f"{_GNU} general public license {_EITHER}version 2(?: of the license| as published by the free software foundation)?", 7),
    ("gpl-3.0", f"{_GNU} general public license {_EITHER}version 3(?: of the license| as published by the free software foundation)?", 7),
    ("lgpl-2.0", f"{_GNU} (?:library|lesser) general public license {_EITHER}version 2(?: of the license)?(?! 1)", 7),
    ("lgpl-2.1", f"{_GNU} lesser general public license {_EITHER}version 2 1(?: of the license)?", 7),
    ("lgpl-3.0", f"{_GNU} lesser general public license {_EITHER}version 3(?: of the license)?", 7),
    ("agpl-3.0", f"{_GNU} affero general public license {_EITHER}version 3(?: of the license)?", 7),
    ("gfdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 [123]", 7),
    # GNU texts
    ("gpl-1.0", "gnu general public license version 1 february 1989", 6),
    ("gpl-1.0", "the license agreements of most software companies try to keep users at the mercy of those companies", 6),
    ("gpl-2.0", "gnu general public license version 2 june 1991", 6),
    ("gpl-2.0", "this license applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this general public license", 6),
    ("gpl-2.0", "if identifiable sections of that work are not derived from the program and can be reasonably considered independent and separate works", 6),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", 6),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", 6),
    ("gpl-3.0", "some devices are designed to deny users access to install or run modified versions of the software inside them", 6),
    ("lgpl-2.0", "gnu library general public license version 2 june 1991", 6),
    ("lgpl-2.0", "this license the library general public license applies to some specially designated free software foundation software", 6),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", 6),
    ("lgpl-2.1", "this license the lesser general public license applies to some specially designated software packages", 6),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007", 6),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", 6),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", 6),
    ("agpl-3.0", "the gnu affero general public license is a free copyleft license for software and other kinds of works", 6),
    ("agpl-3.0", "your modified version must prominently offer all users interacting with it remotely through a computer network", 6),
    ("gfdl-1.3", "the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom", 6),
    ("gfdl-1.3", "with no invariant sections no front cover texts and no back cover texts", 6),
    # Mozilla, Eclipse, CDDL
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 6),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", 6),
    ("mpl-2.0", "(?:www )?mozilla org mpl 2 0", 6),
    ("mpl-2.0", "this source code form is incompatible with secondary licenses", 6),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 6),
    ("mpl-1.1", "mozilla org mpl mpl 1 1", 6),
    ("epl-1.0", "(?:v|version) 1 0 the accompanying program is provided under the terms of this eclipse public license", 6),
    ("epl-2.0", "(?:v|version) 2 0 the accompanying program is provided under the terms of this eclipse public license", 6),
    ("epl-1.0", "www eclipse org legal epl v10", 6),
    ("epl-2.0", "www eclipse org legal epl(?: v20| 2 0)", 6),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 2 0", 6),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 1 0", 6),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", 6),
    ("cddl-1.0", "when distributing covered code include this cddl header in each file", 6),
    # Creative Commons
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", 6),
    ("cc0-1.0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights", 6),
    ("cc-by-4.0", f"{_CC} by 4 0", 6),
    ("cc-by-3.0", f"{_CC} by 3 0", 6),
    ("cc-by-sa-4.0", f"{_CC} by sa 4 0", 6),
    ("cc-by-sa-3.0", f"{_CC} by sa 3 0", 6),
    ("cc-by-nc-4.0", f"{_CC} by nc 4 0", 6),
    ("cc-by-nc-3.0", f"{_CC} by nc 3 0", 6),
    ("cc-by-nd-4.0", f"{_CC} by nd 4 0", 6),
    ("cc-by-nc-sa-4.0", f"{_CC} by nc sa 4 0", 6),
    ("cc-by-nc-nd-4.0", f"{_CC} by nc nd 4 0", 6),
    # zlib, Unlicense, WTFPL
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 6),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 6),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 6),
    ("unlicense", "this is free and unencumbered software released into the public domain", 6),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", 6),
    ("wtfpl", "do what the fuck you want to public license", 6),
    ("wtfpl", "you just do what the fuck you want to", 6),
    # Artistic, Python, PostgreSQL, OpenSSL
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 6),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied", 6),
    ("python-2.0", "psf is making python available to licensee on an as is basis", 6),
    ("python-2.0", "this license agreement is between the python software foundation psf and the individual or organization licensee", 6),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 6),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 7),
    ("openssl", f"{_FORMS} ~1500~this product includes software developed by the openssl project for use in the openssl toolkit(?: ~1500~products derived from this software may not be called openssl)?", 10),
    # More wording of the above
    ("apache-2.0", "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document", 6),
    ("apache-2.0", "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor", 6),
    ("apache-2.0", "unless you explicitly state otherwise any contribution intentionally submitted for inclusion in the work by you to the licensor shall be under the terms and conditions of this license", 6),
    ("bsd-2-clause", "this software is provided by the copyright holders? and contributors as is and any express or implied warranties", 5),
    ("bsd-3-clause", "this software is provided by the regents and contributors as is and any express or implied warranties", 6),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license", 6),
    ("isc", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", 5),
    ("boost-1.0", "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software", 6),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain", 6),
    ("unlicense", "for more information please refer to https? unlicense org", 6),
    ("cc0-1.0", "to the extent possible under law ~100~waived all copyright and related or neighboring rights to", 6),
    ("wtfpl", "copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 6),
    ("artistic-2.0", "you may distribute your modified version as source either gratis or for a distributor fee", 6),
    ("artistic-1.0", "you may make and give away verbatim copies of the source form of the standard version of this package without restriction", 6),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 6),
    ("libpng-2.0", "the png reference library is supplied as is", 6),
    ("libpng-2.0", "this code is released under the libpng license", 6),
    ("mpl-2.0", "covered software means source code form to which the initial contributor has attached the notice in exhibit a", 6),
    ("mpl-1.1", "larger work means a work which combines covered code or portions thereof with code not governed by the terms of this license", 6),
    ("epl-1.0", "contribution means a in the case of the initial contributor the initial code and documentation distributed under this agreement", 6),
    ("epl-2.0", "contribution means a in the case of the initial contributor the initial content distributed under this agreement", 6),
    ("cddl-1.0", "you can obtain a copy of the license at ~60~opensource org licenses cddl1", 6),
    ("gpl-2.0", "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium", 6),
    ("gpl-3.0", "you may convey verbatim copies of the program s source code as you receive it in any medium", 6),
    ("gpl-3.0", "nothing in this license shall be construed as excluding or limiting any implied license or other defenses to infringement", 6),
    ("lgpl-2.1", "you may copy and distribute verbatim copies of the library s complete source code as you receive it in any medium", 6),
    ("lgpl-3.0", "a combined work is a work produced by combining or linking an application with the library", 6),
    ("agpl-3.0", "remote network interaction use with the gnu general public license", 6),
    ("gfdl-1.3", "a transparent copy of the document means a machine readable copy represented in a format whose specification is available to the general public", 6),
    # Exceptions to the GNU licenses
    ("classpath-exception-2.0", "linking this library statically or dynamically with other modules is making a combined work based on this library", 6),
    ("gcc-exception-3.1", "gcc runtime library exception", 6),
    ("bison-exception-2.2", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 6),
    ("autoconf-exception-3.0", "as a special exception the free software foundation gives unlimited permission to copy distribute and modify the configure scripts", 6),
    ("openssl-exception", "permission to link the code of portions of this program with the openssl library", 6),
    ("font-exception-2.0", "if you create a document which uses this font and embed this font or unaltered portions of this font into the document", 6),
    # Academic and Open Software, Apple, Blue Oak
    ("afl-3.0", "licensed under the academic free license version 3 0", 6),
    ("afl-3.0", "this academic free license the license applies to any original work of authorship", 6),
    ("osl-3.0", "licensed under the open software license version 3 0", 6),
    ("osl-3.0", "this open software license the license applies to any original work of authorship", 6),
    ("apsl-2.0", "original code and or modifications of original code as defined in and that are subject to the apple public source license version 2 0", 6),
    ("blueoak-1.0.0", "this license gives everyone as much permission to work with this software as possible while protecting contributors from liability", 6),
    # CeCILL, common and IBM public, attribution
    ("cecill-2.1", "governed by the cecill license under french law and abiding by the rules of distribution of free software", 6),
    ("cecill-b", "governed by the cecill b license under french law and abiding by the rules of distribution of free software", 6),
    ("cecill-c", "governed by the cecill c license under french law and abiding by the rules of distribution of free software", 6),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license", 6),
    ("ipl-1.0", "the accompanying program is provided under the terms of this ibm public license", 6),
    ("cpal-1.0", "the contents of this file are subject to the common public attribution license version 1 0", 6),
    ("npl-1.1", "the contents of this file are subject to the netscape public license version 1 1", 6),
    ("ecl-2.0", "licensed under the educational community license version 2 0", 6),
    ("efl-2.0", "permission is hereby granted to use copy modify and or distribute this package provided that", 6),
    # Historical permission, font and image libraries
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appears? in all copies", 6),
    ("icu", "provided that the above copyright notice s and this permission notice appear in all copies of the software and that both the above copyright notice s and this permission notice appear in supporting documentation", 6),
    ("ftl", "this license applies to all files distributed in the original freetype (?:archive|project)", 6),
    ("ftl", "portions of this software are copyright ~40~the freetype project", 6),
    ("ijg", "this software is based in part on the work of the independent jpeg group", 6),
    ("info-zip", "for the purposes of this copyright and license info zip is defined as the following set of individuals", 6),
    ("bzip2-1.0.6", "this program bzip2 the associated library libbzip2 and all documentation are copyright", 6),
    # Conditions of their own
    ("json", "the software shall be used for good not evil", 7),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", 6),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 6),
    ("lppl-1.3c", "this work may be distributed and or modified under the conditions of the latex project public license", 6),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license ~300~microsoft public license", 7),
    ("ms-pl", "microsoft public license ms pl", 6),
    ("ms-rl", "microsoft reciprocal license ms rl", 6),
    ("mulanpsl-2.0", "is licensed under mulan psl v2", 6),
    ("mulanpsl-2.0", "you can use this software according to the terms and conditions of the mulan psl v2", 6),
    ("php-3.01", "this product includes php software freely available from", 6),
    ("php-3.01", "subject to version 3 01 of the php license", 6),
    ("qpl-1.0", "may be distributed under the terms of the q public license", 6),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices and associated disclaimers", 6),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code for", 6),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose provided that existing copyright notices are retained in all copies", 6),
    ("upl-1.0", "the universal permissive license upl version 1 0", 6),
    ("vim", "there are no restrictions on distributing unmodified copies of vim", 6),
    ("w3c", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions", 6),
    ("zpl-2.1", "zope public license zpl version 2 1", 6),
    ("python-2.0", "cnri open source license agreement", 6),
    ("python-2.0", "beopen python open source license agreement version 1", 6),
    ("unicode-dfs-2016", "unicode inc license agreement data files and software", 6),
    # Source available, models
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", 6),
    ("commons-clause", "the license does not grant to you the right to sell the software", 6),
    ("commons-clause", "commons clause license condition v1 0", 6),
    ("polyform-noncommercial-1.0.0", "polyform noncommercial license 1 0 0", 6),
    ("polyform-small-business-1.0.0", "polyform small business license 1 0 0", 6),
    ("bsl-1.1", "the change date ~80~the licensed work will be made available under the change license", 6),
    ("openrail", "creativeml open rail m", 6),
    ("openrail", "use based restrictions as referenced in paragraph 5 must be included as an enforceable provision", 6),
    ("llama2", "llama 2 is licensed under the llama 2 community license", 6),
    ("llama2", "llama 2 community license agreement", 5),
    # Creative Commons texts
    ("cc-by-4.0", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license", 7),
    ("cc-by-sa-4.0", "terms and conditions of this creative commons attribution sharealike 4 0 international public license", 7),
    ("cc-by-nc-4.0", "terms and conditions of this creative commons attribution noncommercial 4 0 international public license", 7),
    ("cc-by-nd-4.0", "terms and conditions of this creative commons attribution noderivatives 4 0 international public license", 7),
    ("cc-by-nc-sa-4.0", "terms and conditions of this creative commons attribution noncommercial sharealike 4 0 international public license", 7),
    ("cc-by-nc-nd-4.0", "terms and conditions of this creative commons attribution noncommercial noderivatives 4 0 international public license", 7),
    # Data
    ("cdla-permissive-2.0", "community data license agreement permissive version 2 0", 6),
    ("cdla-sharing-1.0", "community data license agreement sharing version 1 0", 6),
    ("pddl-1.0", "open data commons public domain dedication (?:and|&) licen[cs]e", 6),
    ("pddl-1.0", "opendatacommons org licenses pddl", 6),
    ("odc-by-1.0", "open data commons attribution license", 6),
    ("odc-by-1.0", "opendatacommons org licenses by", 6),
    ("ogl-uk-3.0", "contains public sector information licensed under the open government licence v3 0", 7),
    ("ogl-uk-3.0", "open government licence v3 0", 6),
    # Reserved
    ("proprietary", "no part of this ~60~may be reproduced stored in a retrieval system or transmitted in any form or by any means", 6),
    ("proprietary", "this (?:document|file|material) contains (?:confidential and proprietary|proprietary and confidential) information", 6),
    ("proprietary", "you may not (?:copy modify|modify copy) distribute sell or lease any part of", 6),
    ("proprietary", "this end user license agreement (?:eula )?is a legal agreement between you", 6),
    # Others
    ("eupl-1.2", "licensed under the eupl(?: version)?(?: v)? ?1 [12]", 6),
    ("eupl-1.2", "this european union public licence the eupl applies to the work", 6),
    ("odbl-1.0", "opendatacommons org licenses odbl", 6),
    ("bsl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 6),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service", 6),
    ("proprietary", "unauthorized (?:copying|reproduction|use|distribution)(?: or distribution)? of this (?:file|software|program|document|work)(?: via any medium)? is strictly prohibited", 6),
    ("proprietary", "this software is the confidential and proprietary information of", 6),
    ("public-domain", "(?:has been |is hereby |i hereby )?(?:placed|released|dedicated?|put) (?:in|into|to) the public domain", 6),
)
#: Wording of a license is nearly as sure as its identifier.
CONFIDENCE = 0.99


def pattern(signature: str) -> str:
    return re.sub("~([0-9]+)~", r"(?:.{0,\1}? )??", signature)
