"""Signature rules for license texts. A rule is a label, a priority, a weight, a keyword that must occur, and a regular expression.

All texts are matched in normal form: words in lower case, one space between them and at both ends, so "Apache License, Version 2.0"
reads " apache license version 2 0 ". Every rule comes with a text that it must find; tests check that, and that it does not find the
text any more once its keyword is taken out.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Phrases whose every occurrence is reported, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    keyword: str
    pattern: str
    example: str


# Fixed values. Priority 100: sentences that are a license's own words. Label, keyword, expression, a text that it finds.
SENTENCES = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this (?:software|font)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "substantial", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "noninfringement", r"the software is provided as is without warranty of any kind .{0,80}noninfringement", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING FITNESS AND NONINFRINGEMENT"),
    ("mit-0", "restriction", r"deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so (?!subject)\w+", "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"),
    ("bsd", "endorse", r"neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products"),
    ("bsd", "disclaimer", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "binary", r"redistributions in binary form must reproduce the above copyright notice", "Redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-4-clause", "acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledg?ement", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("apache", "apache", r"you may obtain a copy of the license at https? www apache org licenses license 2 0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "compliance", r"you may not use this file except in compliance with the license", "you may not use this file except in compliance with the License."),
    ("apache", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent)", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("apache", "foundation", r"this product includes software developed (?:at|by) the apache software foundation", "This product includes software developed at The Apache Software Foundation"),
    ("gpl", "redistribute", r"this (?:program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "redistribute", r"this (?:library|program|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "redistribute", r"(?:program|software) you can redistribute it and or modify it under the terms of the gnu affero general public license", "this program: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License"),
    ("lgpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license along with", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public license along with", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("gpl", "everyone", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("agpl", "remotely", r"prominently offer all users interacting with it remotely through a computer network", "prominently offer all users interacting with it remotely through a computer network"),
    ("gpl-exception", "linking", r"as a special exception .{0,120}linking this (?:library|program|code) .{0,80}other (?:modules|libraries|files)", "As a special exception, linking this library statically or dynamically with other modules is"),
    ("gpl-exception", "classpath", r"subject to the classpath exception", "Oracle designates this particular file as subject to the \"Classpath\" exception"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts", "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("mpl", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("mpl-1.1", "npl", r"the contents of this file are subject to the netscape public license .{0,40}the npl", "The contents of this file are subject to the Netscape Public License Version 1.1 (the \"NPL\")"),
    ("mpl-1.1", "initial", r"the initial developer of the original code is", "The Initial Developer of the Original Code is"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("epl", "recipient", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT"),
    ("cddl", "cddl", r"the contents of this file are subject to the terms of the common development and distribution license .{0,60}cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\" or CDDL)"),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "disclaims", r"the author disclaims all warranties with regard to this software", "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", "The origin of this software must not be misrepresented; you must not claim"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", "Altered source versions must be plainly marked as such"),
    ("zlib", "arising", r"in no event will the authors? be held liable for any damages arising from the use of this software", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("libpng", "contributing", r"the contributing authors and group 42 inc disclaim all warranties", "The Contributing Authors and Group 42, Inc. disclaim all warranties"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "detriment", r"to the detriment of our heirs and successors", "to the detriment of our heirs and successors"),
    ("boost", "boost", r"see accompanying file license 1 0 txt or copy at https? www boost org", "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"),
    ("boost", "machine", r"solely in the form of machine executable object code generated by a source language processor", "solely in the form of machine-executable object code generated by a source language processor"),
    ("ofl", "bundled", r"may be bundled redistributed and or sold with any software", "may be bundled, redistributed and/or sold with any software"),
    ("ofl", "font", r"this font software is licensed under the sil open font license", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("artistic", "semblance", r"the copyright holder maintains some semblance of artistic control", "the Copyright Holder maintains some semblance of artistic control"),
    ("artistic", "perl", r"you can redistribute it and or modify it under the same terms as perl itself", "you can redistribute it and/or modify it under the same terms as Perl itself"),
    ("wtfpl", "fuck", r"do what the fuck you want to", "You just DO WHAT THE FUCK YOU WANT TO."),
    ("beerware", "beer", r"you can buy me a beer in return", "you think this stuff is worth it, you can buy me a beer in return"),
    ("postgresql", "postgresql", r"postgresql database management system formerly known as postgres", "PostgreSQL Database Management System (formerly known as Postgres, then as Postgres95)"),
    ("openssl", "toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit"),
    ("ssleay", "eric", r"this product includes cryptographic software written by eric young", "This product includes cryptographic software written by Eric Young (eay@cryptsoft.com)"),
    ("json", "evil", r"the software shall be used for good not evil", "The Software shall be used for Good, not Evil."),
    ("ncsa", "deal", r"deal with the software without restriction", "to deal with the Software without restriction"),
    ("python", "psf", r"psf is making python .{0,20}available to licensee on an as is basis", "PSF is making Python available to Licensee on an \"AS IS\" basis."),
    ("hpnd", "notwithstanding", r"provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.{0,60}notwithstanding", "provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation, notwithstanding"),
    ("curl", "daniel", r"copyright c \d{4} \d{4} daniel stenberg", "Copyright (c) 1996 - 2024, Daniel Stenberg, daniel@haxx.se"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group", "this software is based in part on the work of the Independent JPEG Group"),
    ("freetype", "freetype", r"portions of this software are copyright .{0,40}the freetype project", "Portions of this software are copyright (c) 2007 The FreeType Project"),
    ("unicode", "unicode", r"associated documentation .{0,20}the (?:unicode )?data files or software without restriction.{0,200}unicode|unicode data files and any associated documentation", "a copy of the Unicode data files and any associated documentation"),
    ("w3c", "w3c", r"by obtaining using and or copying this work you .{0,60}w3c", "By obtaining, using and/or copying this work, you (the licensee) agree to the W3C terms"),
    ("sspl", "offering", r"if you make the functionality of the program .{0,40}available to third parties as a service|offering the program as a service", "Offering the Program as a Service."),
    ("elastic", "hosted", r"you may not provide the software to third parties as a hosted or managed service", "You may not provide the software to third parties as a hosted or managed service"),
    ("busl", "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use"),
    ("cc0", "waive", r"permanently irrevocably and unconditionally waives? abandons? and surrenders?|to the greatest extent permitted by .{0,80}waive", "To the greatest extent permitted by, but not in contravention of, applicable law, I waive"),
    ("cc-by", "attribution", r"you must give appropriate credit provide a link to the license and indicate if changes were made .{0,30}attribution|attribution you must give appropriate credit", "Attribution - You must give appropriate credit"),
    ("cc-by-sa", "remix", r"if you remix transform or build upon the material you must distribute your contributions under the same license", "If you remix, transform, or build upon the material, you must distribute your contributions under the same license"),
    ("cc-by-nc", "commercial", r"you may not use the material for commercial purposes", "You may not use the material for commercial purposes."),
    ("cc-by-nd", "modified", r"you may not distribute the modified material", "you may not distribute the modified material."),
    ("odbl", "database", r"this .{1,60}is made available under the open database license", "This dataset is made available under the Open Database License"),
    ("rail", "harmful", r"use restrictions .{0,80}you agree not to use the model .{0,80}harmful", "Use restrictions: You agree not to use the Model or derivatives in any harmful way"),
    ("llama", "meta", r"meta platforms .{0,60}community license|licensed under the llama .{0,20}community license .{0,60}meta", "a copy of this Agreement: Meta Platforms, Inc. Community License"),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "This document is proprietary and confidential."),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) .{0,60}strictly prohibited", "Unauthorized copying of this file, via any medium is strictly prohibited"),
    ("proprietary", "written", r"without (?:the )?(?:prior |express )*written (?:permission|consent) of (?:the )?(?:author|owner|publisher|copyright holder|company)", "may not be reproduced without the prior written permission of the publisher"),
    ("proprietary", "retrieval", r"stored in a retrieval system or transmitted in any form", "No part may be reproduced, stored in a retrieval system, or transmitted in any form"),
    ("proprietary", "trade", r"contains? (?:valuable )?trade secrets", "This software contains trade secrets of its owner"),
    ("eula", "installing", r"by installing (?:or using )?(?:the|this) software you agree", "By installing or using the software, you agree to these terms"),
    ("eula", "reverse", r"you may not reverse engineer decompile or disassemble", "You may not reverse engineer, decompile, or disassemble the software"),
    ("eula", "evaluation", r"for evaluation purposes only", "This version is for evaluation purposes only."),
    ("eula", "sublicensable", r"non exclusive non transferable non sublicensable", "grants you a non-exclusive, non-transferable, non-sublicensable license"),
    ("public-domain", "dedicated", r"dedicate[sd]? .{0,40}to the public domain", "The author has dedicated the work to the public domain."),
    ("public-domain", "domain", r"(?:this (?:work|file|software|text|document) is|placed|released) (?:in|into) the public domain", "This file is in the public domain."),
    ("public-domain", "government", r"work of the (?:united states|u s) government", "As a work of the United States Government, this is not protected"),
]

# Fixed values. Priority 90: identifiers of the software package data exchange.
IDENTIFIERS = [
    ("mit", "mit", r"spdx license identifier mit(?: license)?(?! 0)", "SPDX-License-Identifier: MIT"),
    ("mit-0", "mit", r"spdx license identifier mit 0", "SPDX-License-Identifier: MIT-0"),
    ("apache", "apache", r"spdx license identifier apache (?:1|2) \d", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "bsd", r"spdx license identifier bsd [1234] clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("0bsd", "0bsd", r"spdx license identifier 0bsd", "SPDX-License-Identifier: 0BSD"),
    ("gpl", "gpl", r"spdx license identifier gpl \d 0(?: or later| only)?", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("lgpl", "lgpl", r"spdx license identifier lgpl \d \d(?: or later| only)?", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("agpl", "agpl", r"spdx license identifier agpl \d 0(?: or later| only)?", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("gfdl", "gfdl", r"spdx license identifier gfdl 1 \d(?: \w+)?", "SPDX-License-Identifier: GFDL-1.3"),
    ("mpl", "mpl", r"spdx license identifier mpl [12] \d", "SPDX-License-Identifier: MPL-2.0"),
    ("epl", "epl", r"spdx license identifier epl [12] 0", "SPDX-License-Identifier: EPL-2.0"),
    ("cddl", "cddl", r"spdx license identifier cddl 1 [01]", "SPDX-License-Identifier: CDDL-1.0"),
    ("eupl", "eupl", r"spdx license identifier eupl 1 [012]", "SPDX-License-Identifier: EUPL-1.2"),
    ("isc", "isc", r"spdx license identifier isc", "SPDX-License-Identifier: ISC"),
    ("zlib", "zlib", r"spdx license identifier zlib", "SPDX-License-Identifier: Zlib"),
    ("artistic", "artistic", r"spdx license identifier artistic [12] 0", "SPDX-License-Identifier: Artistic-2.0"),
    ("boost", "bsl", r"spdx license identifier bsl 1 0", "SPDX-License-Identifier: BSL-1.0"),
    ("busl", "busl", r"spdx license identifier busl 1 1", "SPDX-License-Identifier: BUSL-1.1"),
    ("unlicense", "unlicense", r"spdx license identifier unlicense", "SPDX-License-Identifier: Unlicense"),
    ("ofl", "ofl", r"spdx license identifier ofl 1 [01]", "SPDX-License-Identifier: OFL-1.1"),
    ("cc0", "cc0", r"spdx license identifier cc0 1 0", "SPDX-License-Identifier: CC0-1.0"),
    ("cc-by", "by", r"spdx license identifier cc by [1234] \d", "SPDX-License-Identifier: CC-BY-4.0"),
    ("cc-by-sa", "sa", r"spdx license identifier cc by sa [1234] \d", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("cc-by-nc", "nc", r"spdx license identifier cc by nc (?:(?:sa|nd) )?[1234] \d", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("cc-by-nd", "nd", r"spdx license identifier cc by nd [1234] \d", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    ("python", "python", r"spdx license identifier (?:python|psf) 2 0(?: \d)?|spdx license identifier python", "SPDX-License-Identifier: Python-2.0"),
    ("postgresql", "postgresql", r"spdx license identifier postgresql", "SPDX-License-Identifier: PostgreSQL"),
    ("openssl", "openssl", r"spdx license identifier openssl", "SPDX-License-Identifier: OpenSSL"),
    ("curl", "curl", r"spdx license identifier curl", "SPDX-License-Identifier: curl"),
    ("wtfpl", "wtfpl", r"spdx license identifier wtfpl", "SPDX-License-Identifier: WTFPL"),
    ("sspl", "sspl", r"spdx license identifier sspl 1 0", "SPDX-License-Identifier: SSPL-1.0"),
    ("ncsa", "ncsa", r"spdx license identifier ncsa", "SPDX-License-Identifier: NCSA"),
    ("proprietary", "licenseref", r"spdx license identifier licenseref(?: \w+){1,3}", "SPDX-License-Identifier: LicenseRef-Proprietary"),
]

# Fixed values. Priority 80: grants, that is, a work is put under a license by name.
GRANTS = [
    ("apache", "apache", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?apache (?:software )?licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "Licensed under the Apache License, Version 2.0"),
    ("mit", "mit", r"(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the |an )?(?:mit|mit x11|x11) licen[cs]e", "Released under the MIT license"),
    ("mit", "expat", r"(?:licensed|released|distributed) under (?:the terms of )?(?:the )?expat licen[cs]e", "distributed under the Expat License"),
    ("bsd", "bsd", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the |a )?(?:(?:new|modified|simplified|revised|[234] clause) )?bsd(?: style)?(?: [234] clause)? licen[cs]e", "available under the new BSD license"),
    ("gpl", "gpl", r"(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?gpl(?: ?v?[123](?: \d)?)?(?: or (?:any )?later)?", "released under the GNU GPL v3"),
    ("gpl", "general", r"(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?general public licen[cs]e(?: (?:version |v)?[123](?: \d)?)?(?: or (?:any )?later(?: version)?)?", "distributed under the GNU General Public License version 2"),
    ("lgpl", "lgpl", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:gnu )?lgpl(?: ?v?[23](?: \d)?)?(?: or (?:any )?later)?", "licensed under the LGPL"),
    ("lgpl", "lesser", r"(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?lesser general public licen[cs]e(?: (?:version |v)?[23](?: \d)?)?(?: or (?:any )?later(?: version)?)?", "Released under the terms of the GNU Lesser General Public License v3 or later"),
    ("agpl", "affero", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:gnu )?affero general public licen[cs]e(?: (?:version |v)?[13](?: \d)?)?(?: or (?:any )?later(?: version)?)?", "licensed under the GNU Affero General Public License v3"),
    ("agpl", "agpl", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:gnu )?agpl(?: ?v?3(?: 0)?)?", "available under the AGPL v3"),
    ("gfdl", "documentation", r"(?:copy distribute and or modify this document|licensed|available) under (?:the terms of )?(?:the )?gnu free documentation licen[cs]e", "copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("mpl", "mozilla", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?mozilla public licen[cs]e(?: (?:version |v)?[12](?: \d)?)?", "licensed under the Mozilla Public License 2.0"),
    ("epl", "eclipse", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?eclipse (?:public|distribution) licen[cs]e", "distributed under the Eclipse Public License"),
    ("cddl", "common", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?common development and distribution licen[cs]e", "licensed under the Common Development and Distribution License"),
    ("cpl", "cpl", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:ibm )?(?:common public licen[cs]e )?cpl", "released under the Common Public License (CPL)"),
    ("eupl", "eupl", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?eupl", "Licensed under the EUPL"),
    ("isc", "isc", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?isc licen[cs]e", "released under the ISC license"),
    ("zlib", "zlib", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?zlib(?: libpng)? licen[cs]e", "distributed under the zlib license"),
    ("artistic", "artistic", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:perl )?artistic licen[cs]e", "available under the Artistic License"),
    ("boost", "boost", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?boost software licen[cs]e", "Distributed under the Boost Software License, Version 1.0."),
    ("unlicense", "unlicense", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?unlicense", "released under the Unlicense"),
    ("ofl", "ofl", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:sil )?ofl", "released under the SIL OFL"),
    ("cc-by", "attribution", r"(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:a |the )?creative commons attribution(?: [1234] \d)?(?: international| unported| generic)? licen[cs]e", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "sharealike", r"(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:a |the )?creative commons attribution sharealike(?: [1234] \d)?(?: international| unported| generic)? licen[cs]e", "available under the Creative Commons Attribution-ShareAlike License"),
    ("cc-by-nc", "noncommercial", r"(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:a |the )?creative commons attribution noncommercial(?: sharealike| noderivatives)?(?: [1234] \d)?(?: international| unported| generic)? licen[cs]e", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "noderivatives", r"(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:a |the )?creative commons attribution noderivatives(?: [1234] \d)?(?: international| unported| generic)? licen[cs]e", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc", "commons", r"(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:a |the )?creative commons(?: \w+){0,4} licen[cs]e", "published under a Creative Commons license"),
    ("cc0", "cc0", r"(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:creative commons )?cc0", "released under CC0"),
    ("python", "psf", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?psf licen[cs]e", "distributed under the PSF license"),
    ("php", "php", r"(?:this source file is subject to|licensed under|released under) (?:version \d 01? of )?(?:the )?php licen[cs]e", "This source file is subject to version 3.01 of the PHP license"),
    ("ruby", "ruby", r"(?:licensed|released|distributed|available) under (?:the same terms as |the terms of )?(?:the )?ruby(?: s)?(?: licen[cs]e)?", "distributed under the same terms as Ruby"),
    ("sspl", "server", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?server side public licen[cs]e", "licensed under the Server Side Public License"),
    ("elastic", "elastic", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?elastic licen[cs]e", "licensed under the Elastic License 2.0"),
    ("busl", "business", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?business source licen[cs]e", "available under the Business Source License"),
    ("odbl", "odbl", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:open database licen[cs]e )?odbl", "available under the ODbL"),
    ("rail", "openrail", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:\w+ )?openrail(?: m)?", "released under the CreativeML OpenRAIL-M"),
    ("wtfpl", "wtfpl", r"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?wtfpl", "released under the WTFPL"),
    ("dual", "dual", r"dual licensed under (?:the )?(?:\w+ ){1,4}(?:and|or) (?:the )?(?:\w+ ?){1,3}", "dual licensed under the MIT and GPL licenses"),
]

# Fixed values. Priority 70: addresses at which a license lies.
ADDRESSES = [
    ("cc-by", "creativecommons", r"creativecommons org licenses by \d \d", "http://creativecommons.org/licenses/by/4.0/"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa \d \d", "http://creativecommons.org/licenses/by-sa/3.0/"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc \d \d", "https://creativecommons.org/licenses/by-nc/4.0"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc sa \d \d", "https://creativecommons.org/licenses/by-nc-sa/4.0"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc nd \d \d", "https://creativecommons.org/licenses/by-nc-nd/4.0"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd \d \d", "https://creativecommons.org/licenses/by-nd/4.0"),
    ("cc0", "publicdomain", r"creativecommons org publicdomain zero \d \d", "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("public-domain", "publicdomain", r"creativecommons org publicdomain mark \d \d", "https://creativecommons.org/publicdomain/mark/1.0/"),
    ("gpl", "gnu", r"gnu org (?:copyleft|licenses) gpl(?: \d \d)?(?: html| txt)?", "https://www.gnu.org/licenses/gpl-3.0.html"),
    ("gpl", "gnu", r"gnu org licenses(?! \w*gpl| fdl| agpl| lgpl)", "see http://www.gnu.org/licenses/"),
    ("lgpl", "gnu", r"gnu org (?:copyleft|licenses) lgpl(?: \d \d)?(?: html| txt)?", "https://www.gnu.org/licenses/lgpl-2.1.html"),
    ("agpl", "gnu", r"gnu org licenses agpl(?: \d \d)?(?: html| txt)?", "https://www.gnu.org/licenses/agpl-3.0.html"),
    ("gfdl", "gnu", r"gnu org (?:copyleft|licenses) fdl(?: \d \d)?(?: html| txt)?", "https://www.gnu.org/licenses/fdl-1.3.html"),
    ("apache", "apache", r"apache org licenses license 2 0(?: html| txt)?", "https://apache.org/licenses/LICENSE-2.0.txt"),
    ("mit", "opensource", r"opensource org licenses? mit(?: license php)?", "https://opensource.org/licenses/MIT"),
    ("bsd", "opensource", r"opensource org licenses? bsd(?: \d clause| license php)?", "https://opensource.org/licenses/BSD-3-Clause"),
    ("osi", "opensource", r"opensource org licenses?(?! mit| bsd)(?: \w+)?", "https://opensource.org/licenses/category"),
    ("mpl", "mozilla", r"mozilla org mpl(?: 2 0)?", "https://mozilla.org/MPL/2.0/"),
    ("epl", "eclipse", r"eclipse org (?:legal epl|org documents epl)(?: \w+)*?(?= )", "http://www.eclipse.org/legal/epl-v10.html"),
    ("boost", "boost", r"boost org license 1 0 txt", "http://www.boost.org/LICENSE_1_0.txt"),
    ("ofl", "sil", r"scripts sil org ofl", "http://scripts.sil.org/OFL"),
    ("unlicense", "unlicense", r"unlicense org", "please refer to <https://unlicense.org>"),
    ("python", "python", r"python org(?: \w+){0,3} license", "https://docs.python.org/3/license.html"),
    ("php", "php", r"php net license \d 01? txt", "http://www.php.net/license/3_01.txt"),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl", "http://opendatacommons.org/licenses/odbl/1.0/"),
    ("pddl", "opendatacommons", r"opendatacommons org licenses pddl", "http://opendatacommons.org/licenses/pddl/1.0/"),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by", "http://opendatacommons.org/licenses/by/1.0/"),
]

# Fixed values. Priority 60: names that say which license, mostly with a version.
NAMES = [
    ("apache", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?[12](?: \d)?", "the Apache License, Version 2.0"),
    ("apache", "asl", r"asl (?:version |v)?2 0", "under ASL 2.0"),
    ("mit", "mit", r"(?:the |an )?mit (?:x11 )?licen[cs]e", "the MIT License"),
    ("mit", "x11", r"(?:the )?x11 licen[cs]e", "the X11 License"),
    ("bsd", "bsd", r"bsd (?:[234] clause|style|new|modified|simplified) licen[cs]e", "a BSD-style license"),
    ("bsd", "clause", r"[234] clause bsd(?: licen[cs]e)?", "the 3-clause BSD license"),
    ("gpl", "general", r"(?:gnu )?general public licen[cs]e (?:version |v)?[123](?: \d)?(?: only| or (?:any )?later(?: version)?)?", "GNU General Public License, version 3 or later"),
    ("gpl", "gpl", r"(?:gnu )?gpl (?:version |v)?[123](?: \d)?(?: only| or later)?", "GPL version 2 only"),
    ("gpl", "gplv2", r"gplv2(?: or later)?", "GPLv2 or later"),
    ("gpl", "gplv3", r"gplv3(?: or later)?", "GPLv3 or later"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: (?:version |v)?[23](?: \d)?)?", "GNU Lesser General Public License 2.1"),
    ("lgpl", "library", r"(?:gnu )?library general public licen[cs]e(?: (?:version |v)?2(?: \d)?)?", "GNU Library General Public License v2"),
    ("lgpl", "lgplv3", r"lgplv3", "LGPLv3"),
    ("lgpl", "lgplv2", r"lgplv2(?: 1)?", "LGPLv2.1"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e(?: (?:version |v)?[13](?: \d)?)?", "GNU Affero General Public License"),
    ("agpl", "agplv3", r"agplv3", "AGPLv3"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e(?: (?:version |v)?1 \d)?", "GNU Free Documentation License, Version 1.2"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e(?: (?:version |v)?[12](?: \d)?)?", "Mozilla Public License 2.0"),
    ("epl", "eclipse", r"eclipse public licen[cs]e(?: (?:version |v)?[12](?: 0)?)?", "Eclipse Public License v2.0"),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e(?: (?:version |v)?1 0)?", "Eclipse Distribution License v1.0"),
    ("cddl", "distribution", r"common development and distribution licen[cs]e(?: (?:version |v)?1 \d)?", "Common Development and Distribution License"),
    ("cpl", "common", r"common public licen[cs]e(?: (?:version |v)?1 0)?", "Common Public License 1.0"),
    ("ipl", "ibm", r"ibm public licen[cs]e", "IBM Public License"),
    ("eupl", "european", r"european union public licen[cs]e", "European Union Public Licence"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: licen[cs]e)?", "CeCILL-B license"),
    ("isc", "isc", r"isc licen[cs]e", "ISC License"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "zlib/libpng license"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e(?: (?:version |v)?[12](?: 0)?)?", "Artistic License 2.0"),
    ("boost", "boost", r"boost software licen[cs]e(?: (?:version |v)?1 0)?", "Boost Software License"),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e(?: (?:version |v)?1 1)?", "SIL Open Font License"),
    ("python", "python", r"python software foundation licen[cs]e", "Python Software Foundation License"),
    ("php", "php", r"php licen[cs]e(?: (?:version |v)?3(?: 01?)?)?", "PHP License 3.01"),
    ("ruby", "ruby", r"ruby licen[cs]e", "Ruby License"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "PostgreSQL License"),
    ("openssl", "openssl", r"openssl licen[cs]e", "OpenSSL License"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", "NCSA Open Source License"),
    ("afl", "academic", r"academic free licen[cs]e(?: (?:version |v)?[123](?: \d)?)?", "Academic Free License v3.0"),
    ("osl", "open", r"open software licen[cs]e(?: (?:version |v)?[123](?: \d)?)?", "Open Software License 3.0"),
    ("ecl", "educational", r"educational community licen[cs]e", "Educational Community License"),
    ("upl", "universal", r"universal permissive licen[cs]e", "Universal Permissive License"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e(?: ms pl)?", "Microsoft Public License (MS-PL)"),
    ("ms-rl", "reciprocal", r"microsoft reciprocal licen[cs]e(?: ms rl)?", "Microsoft Reciprocal License"),
    ("apple", "apple", r"apple public source licen[cs]e", "Apple Public Source License"),
    ("sun", "sun", r"sun (?:public|industry standards source) licen[cs]e", "Sun Public License"),
    ("qpl", "q", r"q public licen[cs]e", "Q Public License"),
    ("nokia", "nokia", r"nokia open source licen[cs]e", "Nokia Open Source License"),
    ("intel", "intel", r"intel (?:open source|simplified software) licen[cs]e", "Intel Simplified Software License"),
    ("mulan", "mulan", r"mulan (?:permissive software|psl|public) licen[cs]e", "Mulan Permissive Software License"),
    ("vim", "vim", r"vim licen[cs]e", "Vim License"),
    ("beerware", "beerware", r"beerware(?: licen[cs]e)?", "the Beerware license"),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e", "Hippocratic License"),
    ("parity", "parity", r"parity public licen[cs]e", "Parity Public License"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e", "PolyForm Noncommercial License 1.0.0"),
    ("commons-clause", "clause", r"commons clause(?: licen[cs]e condition)?", "Commons Clause License Condition"),
    ("sspl", "server", r"server side public licen[cs]e", "Server Side Public License"),
    ("elastic", "elastic", r"elastic licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "Elastic License v2"),
    ("busl", "business", r"business source licen[cs]e(?: 1 1)?", "Business Source License 1.1"),
    ("confluent", "confluent", r"confluent community licen[cs]e", "Confluent Community License"),
    ("odbl", "database", r"open database licen[cs]e(?: odbl)?", "Open Database License (ODbL)"),
    ("odc-by", "commons", r"open data commons attribution licen[cs]e", "Open Data Commons Attribution License"),
    ("pddl", "dedication", r"public domain dedication and licen[cs]e", "Public Domain Dedication and License"),
    ("cdla", "community", r"community data licen[cs]e agreement(?: permissive| sharing)?", "Community Data License Agreement - Permissive"),
    ("ogl", "government", r"open government licen[cs]e(?: (?:version |v)?[123](?: 0)?)?", "Open Government Licence v3.0"),
    ("ogl-game", "gaming", r"open gaming licen[cs]e", "Open Gaming License"),
    ("cc-by", "attribution", r"creative commons attribution(?: [1234] \d)?(?: international| unported| generic)?(?: public)? licen[cs]e", "Creative Commons Attribution 4.0 International Public License"),
    ("cc-by-sa", "share", r"creative commons attribution share alike(?: [1234] \d)?(?: international| unported| generic)?(?: licen[cs]e)?", "Creative Commons Attribution Share-Alike 3.0"),
    ("cc-by-nc", "non", r"creative commons attribution non commercial(?: [1234] \d)?(?: international| unported| generic)?(?: licen[cs]e)?", "Creative Commons Attribution Non-Commercial 3.0"),
    ("cc-by-nd", "derivatives", r"creative commons attribution no derivatives(?: [1234] \d)?(?: international| unported| generic)?(?: licen[cs]e)?", "Creative Commons Attribution No Derivatives 3.0"),
    ("cc0", "zero", r"creative commons zero(?: (?:version |v)?1 0)?(?: universal)?", "Creative Commons Zero v1.0 Universal"),
    ("rail", "responsible", r"(?:open )?responsible ai licen[cs]e", "Open Responsible AI License"),
    ("llama", "llama", r"llama (?:[234] (?:\d )?)?community licen[cs]e", "Llama 3 Community License"),
    ("gemma", "gemma", r"gemma terms of use", "Gemma Terms of Use"),
]

# Fixed values. Priority 40: short names, and marks of a copyright.
MARKS = [
    ("cc-by-sa", "sa", r"cc by sa(?: [1234] \d)?", "CC BY-SA 4.0"),
    ("cc-by-nc", "nc", r"cc by nc(?: (?:sa|nd))?(?: [1234] \d)?", "CC BY-NC-SA 4.0"),
    ("cc-by-nd", "nd", r"cc by nd(?: [1234] \d)?", "CC BY-ND 4.0"),
    ("cc0", "cc0", r"cc0(?: 1 0)?", "CC0 1.0"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", "the LGPL"),
    ("agpl", "agpl", r"(?:gnu )?agpl", "the AGPL"),
    ("gpl", "gpl", r"(?:gnu )?gpl", "the GPL"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl", "the GFDL"),
    ("wtfpl", "wtfpl", r"wtfpl", "WTFPL"),
    ("unlicense", "unlicense", r"the unlicense", "the Unlicense"),
    ("copyleft", "copyleft", r"copyleft", "copyleft"),
    ("reserved", "rights", r"(?:some|no|all other) rights reserved", "Some rights reserved."),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d", "Copyright (c) 2019"),
    ("public-domain", "cc", r"cc public domain (?:mark|dedication)", "CC Public Domain Mark"),
]

_KINDS = [(100, 0.97, SENTENCES), (90, 0.99, IDENTIFIERS), (80, 0.95, GRANTS), (70, 0.9, ADDRESSES), (60, 0.8, NAMES), (40, 0.5, MARKS)]


def rules() -> list[Rule]:
    """All rules in one fixed order: by priority, then as written."""
    return [Rule(label, priority, weight, keyword, rf"(?<= )(?:{pattern})(?= )", example) for priority, weight, rows in _KINDS for label, keyword, pattern, example in rows]
