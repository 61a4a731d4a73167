"""Signatures of license texts: what their headers, grants and clauses say, one line for each."""

from __future__ import annotations

# Fixed values: (label, pattern over lower-case words, a text it finds, a text close to it that it must not find)
SIGNATURES = [
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"),
    ("afl", "this academic free licen[cs]e the licen[cs]e applies to any (?:original|software) work",
     "This Academic Free License (the \"License\") applies to any original work of authorship", "This free license applies to any original work"),
    ("agpl-3.0", "published by the free software foundation either version 3 of the licen[cs]e or at your option any later version this program is distributed .{0,200}gnu affero general public",
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful. See the GNU Affero General Public License",
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. See the GNU General Public License"),
    ("aladdin", "aladdin free public licen[cs]e version", "Aladdin Free Public License (Version 8)", "Aladdin free public domain version"),
    ("amazon-sl", "amazon software licen[cs]e", "Licensed under the Amazon Software License (the \"License\")", "the Amazon license for software"),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledge?ment this product includes software developed by the apache",
     "The end-user documentation included with the redistribution, if any, must include the following acknowledgment: \"This product includes software developed by the Apache Software Foundation\"",
     "This product includes software developed by the Apache Software Foundation"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis",
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
     "Unless required by applicable law, software is distributed on an as is basis"),
    ("apache-2.0", "subject to the terms and conditions of this licen[cs]e each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except)",
     "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license",
     "Subject to this License, each Contributor grants you a perpetual copyright license"),
    ("apsl", "apple public source licen[cs]e", "subject to the Apple Public Source License Version 2.0", "Apple source code, public since then"),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied",
     "The intent of this document is to state the conditions under which a Package may be copied", "The intent of this document is to state how a package may be copied"),
    ("artistic-2.0", "this licen[cs]e establishes the terms under which a given free software package may be copied",
     "This license establishes the terms under which a given free software Package may be copied", "This license establishes how a given free software package may be sold"),
    ("beerware", "if we meet some ?day and you think this stuff is worth it you can buy me a beer",
     "If we meet some day, and you think this stuff is worth it, you can buy me a beer in return", "If we meet some day, you can buy me a beer"),
    ("bittorrent", "bittorrent open source licen[cs]e", "subject to the BitTorrent Open Source License Version 1.1", "BitTorrent, an open source client"),
    ("blueoak-1.0", "blue oak model licen[cs]e", "Blue Oak Model License Version 1.0.0", "a blue oak, model of a license"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e",
     "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
     "Permission is hereby granted, free of charge, to any person or organization obtaining the software"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided",
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED",
     "Redistributions in binary form must reproduce the above copyright notice in the documentation"),
    ("bsd-3-clause", "neither the names? of .{1,120} nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software",
     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
     "Neither the holder nor its contributors endorse products derived from this software"),
    ("bsd-3-clause-clear", "no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e",
     "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE", "no license to any party's patent rights"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment",
     "All advertising materials mentioning features or use of this software must display the following acknowledgement", "All advertising materials must display the name of this software"),
    ("bsd-protection", "bsd protection licen[cs]e", "BSD Protection License, February 2002", "protection under the BSD license"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work",
     "The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work",
     "The Licensor hereby grants you the right to copy and make production use of the Licensed Work"),
    ("cal-1.0", "cryptographic autonomy licen[cs]e", "The Cryptographic Autonomy License, v. 1.0", "cryptographic autonomy, by license"),
    ("catosl", "computer associates trusted open source licen[cs]e", "Computer Associates Trusted Open Source License Version 1.1", "computer associates, an open source license"),
    ("cc-by", "you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made",
     "You must give appropriate credit, provide a link to the license, and indicate if changes were made", "You must give credit and indicate if changes were made"),
    ("cc-by-nc", "you may not use the material for commercial purposes", "You may not use the material for commercial purposes", "You may use the material for commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material",
     "If you remix, transform, or build upon the material, you may not distribute the modified material", "If you transform the material, you may distribute the modified material"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e",
     "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original",
     "If you build upon the material, distribute your contributions"),
    ("cc0", "to the extent possible under law .{1,120} has waived all copyright and related or neighbou?ring rights",
     "To the extent possible under law, Jane Roe has waived all copyright and related or neighboring rights to this work", "Jane Roe has waived all copyright and related rights"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e",
     "The contents of this file are subject to the terms of the Common Development and Distribution License", "The contents of this file are subject to the terms of common development"),
    ("cecill", "cecill (?:b |c )?(?:free software )?licen[cs]e", "governed by the CeCILL-B license under French law", "CeCILL, a family of licenses"),
    ("clartistic", "clarified artistic licen[cs]e", "The Clarified Artistic License", "an artistic license, clarified"),
    ("cnri-python", "cnri open source licen[cs]e agreement", "CNRI OPEN SOURCE LICENSE AGREEMENT", "CNRI agreement on open source"),
    ("cpal-1.0", "common public attribution licen[cs]e", "Common Public Attribution License Version 1.0 (CPAL)", "common public attribution of the license"),
    ("cpl-1.0", "this common public licen[cs]e agreement any use reproduction or distribution", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS COMMON PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION",
     "this common public license is an agreement"),
    ("cpol-1.02", "code project open licen[cs]e", "The Code Project Open License (CPOL) 1.02", "an open license of the code project"),
    ("cua-opl", "cua office public licen[cs]e", "CUA Office Public License Version 1.0", "CUA office, with a license"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided",
     "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED",
     "Permission to use this software for any purpose with or without fee is granted in all copies"),
    ("d-fsl", "deutsche freie software lizenz", "Deutsche Freie Software Lizenz (D-FSL)", "freie deutsche software, ohne lizenz"),
    ("ecl-2.0", "licensed under the educational community licen[cs]e", "Licensed under the Educational Community License, Version 2.0", "an educational community with a license"),
    ("efl-2.0", "eiffel forum licen[cs]e", "Eiffel Forum License, version 2", "a license of the Eiffel forum"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service",
     "You may not provide the software to third parties as a hosted or managed service", "You may provide the software as a hosted service"),
    ("entessa", "entessa public licen[cs]e", "Entessa Public License Version 1.0", "Entessa, public since"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public licen[cs]e", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")",
     "The accompanying program is provided with Eclipse"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e",
     "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "These materials are made available by Eclipse"),
    ("eudatagrid", "eu datagrid software licen[cs]e", "EU DataGrid Software License", "software of the EU DataGrid"),
    ("eupl", "licensed under the eupl", "Licensed under the EUPL, Version 1.2 or later", "licensed in the EU"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
     "Permission is hereby granted to any person to deal in the software with restrictions"),
    ("fair", "usage of the works is permitted provided that this instrument is retained with the works",
     "Usage of the works is permitted provided that this instrument is retained with the works", "Usage of the works is permitted"),
    ("frameworx", "frameworx open licen[cs]e", "The Frameworx Open License 1.0", "Frameworx, open to license"),
    ("fsfap", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved",
     "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved",
     "Copying of this file is permitted in any medium"),
    ("ftl", "freetype project licen[cs]e", "The FreeType Project LICENSE", "a license for the FreeType font"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e",
     "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "Permission is granted to copy this document"),
    ("gl2ps", "gl2ps licen[cs]e", "GL2PS LICENSE Version 2", "GL2PS is a library"),
    ("gpl-2.0", "either version 2 of the licen[cs]e or at your option any later version this program is distributed in the hope that it will be useful but without any warranty",
     "either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "version 2 of the program, or any later version"),
    ("gpl-3.0", "it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e",
     "modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "version 3 of the program by the foundation"),
    ("gpl-3.0", "the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works",
     "The GNU General Public License is a free, copyleft license for software and other kinds of works", "a copyleft license for software"),
    ("gsoap", "gsoap public licen[cs]e", "gSOAP public license Version 1.3", "gSOAP, with a public API"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose .{0,40}is hereby granted provided that the above copyright notice appears? in all copies",
     "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies",
     "Permission to use this software and its documentation for any purpose"),
    ("ibm-pibs", "this source code has been made available to you by ibm on an as is basis", "This source code has been made available to you by IBM on an AS-IS basis", "This source code has been made by IBM"),
    ("icu", "the above copyright notice s and this permission notice appear in all copies of the software and that both",
     "provided that the above copyright notice(s) and this permission notice appear in all copies of the Software and that both the above", "this notice appears in all copies of the software"),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "this software is based in part on the work of the Independent JPEG Group", "the work of an independent group"),
    ("intel-osl", "intel open source licen[cs]e", "Intel Open Source License", "open source from Intel"),
    ("ipa", "ipa font licen[cs]e agreement", "IPA Font License Agreement v1.0", "an agreement on IPA fonts"),
    ("ipl-1.0", "ibm public licen[cs]e", "IBM Public License Version 1.0", "a public letter from IBM"),
    ("jasper", "jasper licen[cs]e version 2", "JasPer License Version 2.0", "a license for Jasper"),
    ("json", "the software shall be used for good not evil", "The Software shall be used for Good, not Evil.", "The software shall be used for good"),
    ("lal", "free art licen[cs]e", "Free Art License 1.3 (FAL 1.3)", "free art, no license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e",
     "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "This library is free; you can redistribute it"),
    ("libpng", "libpng (?:version .{1,20} )?are copyright .{1,200} distributed according to the same disclaimer and licen[cs]e",
     "libpng version 1.0.7 are Copyright (c) 2000 Glenn Randers-Pehrson, are distributed according to the same disclaimer and license as libpng-1.0.6",
     "libpng is distributed with a license"),
    ("libtiff", "the names of sam leffler and silicon graphics may not be used in any advertising",
     "(ii) the names of Sam Leffler and Silicon Graphics may not be used in any advertising or publicity", "the names of Sam Leffler and others"),
    ("llama-community", "llama (?:2|3|3 1|3 2|4) community licen[cs]e agreement", "LLAMA 2 COMMUNITY LICENSE AGREEMENT", "a community that likes llamas"),
    ("lpl", "lucent public licen[cs]e", "Lucent Public License Version 1.02", "Lucent, a public company"),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public licen[cs]e",
     "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License", "This work may be distributed with LaTeX"),
    ("miros", "provided that the above copyright notice and this list of conditions .{0,80}these terms and the following disclaimer appear in all copies .{0,20}miros",
     "provided that the above copyright notice and this list of conditions, these terms, and the following disclaimer appear in all copies. The MirOS", "provided that the above copyright notice appears"),
    ("mit-0", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is",
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\"",
     "to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit-advertising", "the following acknowledge?ment this product includes software developed by enlightenment", "must include the following acknowledgement: This product includes software developed by Enlightenment", "developed by enlightened people"),
    ("motosoto", "motosoto open source licen[cs]e", "MOTOSOTO OPEN SOURCE LICENSE", "open source of Motosoto"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "The contents of this file are subject to the Mozilla Public License Version 1.1", "The contents of this file are subject to version 1.1"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one", "If a copy of the MPL was not distributed with this file, You can obtain one at", "If a copy was not distributed with this file"),
    ("ms-pl", "this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e",
     "This license governs use of the accompanying software. If you use the software, you accept this license.", "This license governs use of software"),
    ("mulanpsl-2.0", "mulan permissive software licen[cs]e", "Mulan Permissive Software License, Version 2", "permissive software from Mulan"),
    ("multics", "this edition of the multics software materials and documentation is provided and donated", "This edition of the Multics software materials and documentation is provided and donated", "This edition of Multics is old"),
    ("nasa-1.3", "nasa open source agreement", "NASA OPEN SOURCE AGREEMENT VERSION 1.3", "an agreement with NASA"),
    ("naumen", "naumen public licen[cs]e", "NAUMEN Public License", "Naumen, a public firm"),
    ("ncsa", "permission is hereby granted free of charge .{1,120}to deal with the software without restriction", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal with the Software without restriction",
     "Permission is granted to deal with the software"),
    ("nethack", "nethack general public licen[cs]e", "NETHACK GENERAL PUBLIC LICENSE", "NetHack, for the general public"),
    ("nokia", "nokia open source licen[cs]e", "Nokia Open Source License (NOKOS License)", "open source at Nokia"),
    ("nposl-3.0", "non profit open software licen[cs]e", "Non-Profit Open Software License version 3.0", "open software of a non-profit"),
    ("ntp", "this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears? in all copies .{0,120}no representations about the suitability",
     "this software and its documentation for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies. The University of Delaware makes no representations about the suitability",
     "for any purpose with or without fee is hereby granted"),
    ("odbl-1.0", "made available under the open database licen[cs]e", "This DATA(base) is made available under the Open Database License", "made available in an open database"),
    ("ofl-1.1", "this font software is licensed under the sil open font licen[cs]e", "This Font Software is licensed under the SIL Open Font License, Version 1.1", "This font is open"),
    ("ofl-1.1", "the fonts and derivatives however cannot be released under any other type of licen[cs]e", "The fonts and derivatives, however, cannot be released under any other type of license", "The fonts cannot be released"),
    ("ogtsl", "open group test suite licen[cs]e", "The Open Group Test Suite License", "a test suite of the open group"),
    ("ogl-uk", "open government licen[cs]e", "Contains public sector information licensed under the Open Government Licence v3.0", "an open government"),
    ("oldap", "openldap public licen[cs]e", "The OpenLDAP Public License Version 2.8", "OpenLDAP, public server"),
    ("opl-1.0", "open publication licen[cs]e", "distributed only subject to the terms of the Open Publication License, v1.0", "an open publication"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit", "This product uses OpenSSL"),
    ("osl-3.0", "licensed under the open software licen[cs]e", "Licensed under the Open Software License version 3.0", "licensed as open software"),
    ("parity", "parity public licen[cs]e", "The Parity Public License 7.0.0", "parity in public"),
    ("php", "this product includes php software freely available from", "This product includes PHP software, freely available from", "This product includes PHP"),
    ("polyform-nc", "polyform noncommercial licen[cs]e", "PolyForm Noncommercial License 1.0.0", "polyform, commercial license"),
    ("polyform-sb", "polyform small business licen[cs]e", "PolyForm Small Business License 1.0.0", "a small business license"),
    ("postgresql", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages including lost profits",
     "IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS",
     "in no event shall the university be liable"),
    ("psf-2.0", "psf is making python available to licensee on an as is basis", "PSF is making Python available to Licensee on an \"AS IS\" basis", "Python is available as is"),
    ("qpl-1.0", "the q public licen[cs]e", "THE Q PUBLIC LICENSE version 1.0", "a public license, Q"),
    ("rpl-1.5", "reciprocal public licen[cs]e", "Reciprocal Public License 1.5 (RPL1.5)", "reciprocal, public and licensed"),
    ("rpsl-1.0", "realnetworks public source licen[cs]e", "RealNetworks Public Source License Version 1.0", "public source of RealNetworks"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices",
     "You may make and give away verbatim copies of the source form of the software without restriction, provided that you duplicate all of the original copyright notices",
     "You may make verbatim copies of the source"),
    ("sax-pd", "sax2 is free i hereby abandon any property rights to sax 2", "SAX2 is Free! I hereby abandon any property rights to SAX 2.0", "I hereby abandon SAX"),
    ("scea", "scea shared source licen[cs]e", "SCEA Shared Source License Version 1.0", "source shared with SCEA"),
    ("sgi-b", "sgi free software licen[cs]e b", "SGI FREE SOFTWARE LICENSE B (Version 2.0)", "free software of SGI"),
    ("simpl", "simple public licen[cs]e", "Simple Public License (SimPL) 2.0", "a simple license"),
    ("sissl", "sun industry standards source licen[cs]e", "Sun Industry Standards Source License Version 1.1", "industry standards from Sun"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", "Redistributions in any form must be accompanied by information on how to obtain complete source code", "Redistributions must have source code"),
    ("spl-1.0", "sun public licen[cs]e", "subject to the Sun Public License Version 1.0", "public places in the sun"),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available",
     "If you make the functionality of the Program or a modified version available to third parties as a service, you must make the Service Source Code available", "available to third parties as a service"),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and licen[cs]e this software and its documentation for any purpose",
     "The authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose", "The authors grant permission to use this software"),
    ("unicode", "unicode (?:inc )?licen[cs]e agreement data files and software", "UNICODE, INC. LICENSE AGREEMENT - DATA FILES AND SOFTWARE", "data files in Unicode"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "Anyone is free to use this software"),
    ("upl-1.0", "universal permissive licen[cs]e", "The Universal Permissive License (UPL), Version 1.0", "a universal license"),
    ("vim", "vim licen[cs]e", "VIM LICENSE: There are no restrictions on distributing unmodified copies of Vim", "vim, vigour and license"),
    ("vsl-1.0", "vovida software licen[cs]e", "The Vovida Software License, Version 1.0", "software by Vovida"),
    ("w3c", "w3c software (?:and document )?notice and licen[cs]e", "W3C SOFTWARE NOTICE AND LICENSE", "a notice from the W3C"),
    ("watcom-1.0", "sybase open watcom public licen[cs]e", "Sybase Open Watcom Public License version 1.0", "Open Watcom compiler"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "do what you want to in public"),
    ("x11", "except as contained in this notice the names? of .{1,80} shall not be used in advertising or otherwise to promote the sale",
     "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale", "the name shall not be used in advertising"),
    ("xnet", "this agreement shall be governed in all respects by the laws of the state of california", "This agreement shall be governed in all respects by the laws of the State of California", "governed by the laws of California"),
    ("zend-2.0", "this product includes the zend engine", "This product includes the Zend Engine, freely available at", "the Zend engine of this product"),
    ("zimbra", "zimbra public licen[cs]e", "Zimbra Public License, Version 1.4", "a public server of Zimbra"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
     "The origin of this software must not be misrepresented; you must not claim that you wrote the original software", "The origin of this software must not be misrepresented"),
    ("zpl", "zope public licen[cs]e", "Zope Public License (ZPL) Version 2.1", "Zope, a public framework"),
]
