"""Signature rules of licences, over words in lower case joined by single blanks.

A block starts with `label = id`, the id in SPDX spelling as words, and lists rules as `kind regex`. The part in angle
brackets is the rule's keyword: every match contains it, so the regex runs only on texts that do. `(?P<at>...)`, if
present, is the interval of the detection, else the whole match is. Kinds are in KINDS.
"""

from __future__ import annotations

#: kind: (priority, confidence). T licence text, I identifier tag, N grant, C classifier or metadata, U address, M name.
KINDS = {"T": (6, 0.98), "I": (5, 0.99), "N": (4, 0.95), "C": (3, 0.9), "U": (3, 0.9), "M": (1, 0.7)}

RULES = r"""
mit = mit
T <permission is hereby granted free of charge> to any person obtaining a copy of this software and associated documentation files
T the above copyright notice and this <permission notice shall be included> in all copies or substantial portions of the software
T to deal in the software <without restriction including without limitation> the rights to use copy modify merge publish distribute sublicense
N (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of (?:the )?)?<mit license>
N (?:use of this source code is )?governed by an? <mit style license>
N (?:under|with) (?:the )?<mit expat license>
C <osi approved mit> license
U <opensource org licenses mit>(?: license)?(?: php| html)?
U <choosealicense com licenses mit>
U <mit license org>
M (?:the )?<mit license>
M <expat license>
mit-0 = mit 0
N (?:licensed|released) under (?:the )?<mit 0 license>
M <mit no attribution>(?: license)?
apache-2.0 = apache 2 0
T <apache license version 2 0 january 2004>
T <terms and conditions for use reproduction and distribution> 1 definitions
N licensed under the <apache license version 2 0> the license you may not use this file except in compliance with the license
N (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of (?:the )?)?<apache license>(?: version)? 2(?: 0)?
N (?:licensed|released|distributed) under (?:the )?<apache 2>(?: 0)?(?: license)?
N <licensed to the apache software foundation> asf under one or more contributor license agreements
C <osi approved apache> software license
U <apache org licenses license 2 0>(?: txt| html)?
U <opensource org licenses apache 2 0>
M <apache license>(?: version)? 2(?: 0)?
M <apache 2> 0 license
M <asl 2> 0
apache-1.1 = apache 1 1
T <this product includes software developed by the apache software foundation>
N (?:licensed|released|distributed) under (?:the )?<apache software license>(?: version)? 1 1
U <apache org licenses license 1 1>
M <apache software license> version 1 1
apache-1.0 = apache 1 0
T <this product includes software developed by the apache group> for use in the apache http server project
U <apache org licenses license 1 0>
gpl-3.0 = gpl 3 0
T <gnu general public license version 3 29 june 2007>
N (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of (?:the )?)?<gnu general public license>(?: version| v)? ?3(?: 0)?
N (?:licensed|released|distributed) under (?:the )?<gplv3>
C <gnu general public license v3> gplv3
U <gnu org licenses gpl 3 0>(?: txt| html| en html)?
U <opensource org licenses gpl 3 0>
M <gnu general public license>(?: version)? (?:3|v3)(?: 0)?
M <gnu gpl>(?: version)? (?:3|v3)
M <gplv3>
M <gpl version 3>
gpl-3.0-or-later = gpl 3 0 or later
T <gnu general public license as published by the free software foundation> either version 3 of the license or at your option any later version
N <gnu general public license>(?: version)? (?:3|v3)(?: 0)? or(?: at your option)? (?:any )?later
C <gnu general public license v3 or later> gplv3
M <gplv3> or(?: any)? later
gpl-3.0-only = gpl 3 0 only
N <gnu general public license>(?: version)? (?:3|v3)(?: 0)? only
M <gpl 3> only
gpl-2.0 = gpl 2 0
T <gnu general public license version 2 june 1991>
N (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of (?:the )?)?<gnu general public license>(?: version| v)? ?2(?: 0)?
N this program is free software [^.]{0,120}<gnu general public license> version 2 as published by the free software foundation
C <gnu general public license v2> gplv2
U <gnu org licenses old licenses gpl 2 0>(?: txt| html| en html)?
U <opensource org licenses gpl 2 0>
M <gnu general public license>(?: version)? (?:2|v2)(?: 0)?
M <gnu gpl>(?: version)? (?:2|v2)
M <gplv2>
M <gpl version 2>
gpl-2.0-or-later = gpl 2 0 or later
T <gnu general public license as published by the free software foundation> either version 2 of the license or at your option any later version
N <gnu general public license>(?: version)? (?:2|v2)(?: 0)? or(?: at your option)? (?:any )?later
C <gnu general public license v2 or later> gplv2
M <gplv2> or(?: any)? later
gpl-2.0-only = gpl 2 0 only
N <gnu general public license>(?: version)? (?:2|v2)(?: 0)? only
M <gpl 2> only
gpl-1.0 = gpl 1 0
T <gnu general public license version 1 february 1989>
U <gnu org licenses old licenses gpl 1 0>
gpl-with-classpath-exception = gpl 2 0 with classpath exception 2 0
T <linking this library statically or dynamically with other modules> is making a combined work based on this library
N <gnu general public license> version 2 only with classpath exception
M <gpl>(?: v?2(?: 0)?)? (?:with|w)(?: the)? classpath exception
M <classpath exception>
lgpl-3.0 = lgpl 3 0
T <gnu lesser general public license version 3 29 june 2007>
N (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?<gnu lesser general public license>(?: version)? v?3(?: 0)?
C <gnu lesser general public license v3> lgplv3
U <gnu org licenses lgpl 3 0>(?: txt| html| en html)?
M <gnu lesser general public license>(?: version)? v?3(?: 0)?
M <lgplv3>
lgpl-2.1 = lgpl 2 1
T <gnu lesser general public license version 2 1 february 1999>
T <gnu lesser general public license as published by the free software foundation> either version 2 1 of the license or at your option any later version
N (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?<gnu lesser general public license>(?: version)? v?2 1
C <gnu lesser general public license v2> lgplv2
U <gnu org licenses old licenses lgpl 2 1>(?: txt| html| en html)?
U <opensource org licenses lgpl 2 1>
M <gnu lesser general public license>(?: version)? v?2 1
M <lgplv2> 1
lgpl-2.0 = lgpl 2 0
T <gnu library general public license version 2 june 1991>
T <gnu library general public license as published by the free software foundation>
U <gnu org licenses old licenses lgpl 2 0>
M <gnu library general public license>
lgpl = lgpl
C <library or lesser general public license> lgpl
M <gnu lesser general public license>
M <lesser gpl>
M <gnu lgpl>
agpl-3.0 = agpl 3 0
T <gnu affero general public license version 3 19 november 2007>
T <gnu affero general public license as published by the free software foundation> either version 3 of the license
T <remote network interaction use with the gnu general public license>
N (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?<gnu affero general public license>
C <gnu affero general public license v3>
U <gnu org licenses agpl 3 0>(?: txt| html| en html)?
U <opensource org licenses agpl 3 0>
M <gnu affero general public license>(?: version)?(?: v?3(?: 0)?)?
M <affero gpl>
M <agplv3>
gfdl-1.3 = gfdl 1 3
T <gnu free documentation license version 1 3> 3 november 2008
N permission is granted to copy distribute and or modify this document under the terms of the <gnu free documentation license>
U <gnu org licenses fdl 1 3>
M <gnu free documentation license>(?: version 1 3)?
gfdl-1.2 = gfdl 1 2
T <gnu free documentation license version 1 2> november 2002
U <gnu org licenses old licenses fdl 1 2>
M <gnu free documentation license> version 1 2
bsd-3-clause = bsd 3 clause
T <neither the name of>(?: [^ ]+){1,16}? nor the names of (?:its|the) contributors may be used to endorse or promote products derived from this software
N (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?<bsd 3 clause>(?: license)?
N (?:licensed|released|distributed|available) under (?:the )?(?:3 clause|three clause|new|modified|revised) <bsd license>
N use of this source code is governed by a <bsd style license> that can be found in the license file
U <opensource org licenses bsd 3 clause>
M (?:3 clause|three clause|new|modified|revised) <bsd license>
M <bsd 3 clause>(?: license)?
bsd-2-clause = bsd 2 clause
T <redistributions of source code must retain the above copyright notice> this list of conditions and the following disclaimer
T <redistribution and use in source and binary forms with or without modification are permitted> provided that the following conditions are met
N (?:licensed|released|distributed|available) under (?:the )?(?:2 clause|two clause|simplified|freebsd) <bsd license>
N (?:licensed|released|distributed|available) under (?:the )?<bsd 2 clause>(?: license)?
U <opensource org licenses bsd 2 clause>
M (?:2 clause|two clause|simplified) <bsd license>
M <bsd 2 clause>(?: license)?
bsd-4-clause = bsd 4 clause
T <all advertising materials mentioning features or use of this software> must display the following acknowledg(?:e)?ment
M (?:4 clause|four clause|original) <bsd license>
M <bsd 4 clause>(?: license)?
bsd = bsd
N (?:licensed|released|distributed|available|covered) under (?:the |a )?(?:terms of (?:the )?)?<bsd>(?: style)? license
C <osi approved bsd> license
U <opensource org licenses bsd license>(?: php)?
M <bsd license>
M <bsd licensed>
0bsd = 0bsd
M <zero clause bsd>(?: license)?
T <permission to use copy modify and or distribute this software for any purpose> with or without fee is hereby granted the software is provided as is
isc = isc
T <permission to use copy modify and or distribute this software for any purpose> with or without fee is hereby granted provided that the above copyright notice
N (?:licensed|released|distributed|available) under (?:the )?<isc license>
C <osi approved isc> license
U <opensource org licenses isc>
M <isc license>
mpl-2.0 = mpl 2 0
T <this source code form is subject to the terms of the mozilla public license> v 2 0
T <mozilla public license version 2 0> 1 definitions
N (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?<mozilla public license>(?: version)? v?2 0
C <mozilla public license 2 0> mpl 2 0
U <mozilla org mpl 2 0>
U <mozilla org en us mpl 2 0>
M <mozilla public license>(?: version)?(?: v)? ?2 0
M <mplv2>(?: 0)?
mpl-1.1 = mpl 1 1
T <the contents of this file are subject to the mozilla public license> version 1 1
U <mozilla org mpl mpl 1 1>
M <mozilla public license>(?: version)? 1 1
mpl = mpl
M <mozilla public license>
epl-2.0 = epl 2 0
T <this program and the accompanying materials are made available under the terms of the eclipse public license> (?:v |version )?2 0
U <eclipse org legal epl 2 0>
M <eclipse public license>(?: version)?(?: v)? ?2 0
epl-1.0 = epl 1 0
T <eclipse public license v 1 0> the accompanying program is provided under the terms
U <eclipse org legal epl v10>(?: html)?
M <eclipse public license>(?: version)?(?: v)? ?1 0
epl = epl
M <eclipse public license>
cddl-1.0 = cddl 1 0
T <the contents of this file are subject to the terms of the common development and distribution license>
U <opensource org licenses cddl 1 0>
M <common development and distribution license>(?: version 1 0)?
M <cddl>(?: version)? 1 0
cddl-1.1 = cddl 1 1
M <common development and distribution license> version 1 1
M <cddl>(?: version)? 1 1
cc-by-4.0 = cc by 4 0
T <creative commons attribution 4 0 international public license>
N licensed under (?:a |the )?(?:terms of the )?<creative commons attribution> 4 0 international license
N (?:licensed|released|published|available) under (?:a |the )?<cc by 4> 0
U <creativecommons org licenses by 4 0>(?: legalcode)?
M <creative commons attribution> 4 0
M <cc by 4> 0
cc-by-3.0 = cc by 3 0
N licensed under (?:a |the )?<creative commons attribution> 3 0 (?:unported|united states) license
U <creativecommons org licenses by 3 0>
M <creative commons attribution> 3 0
M <cc by 3> 0
cc-by-2.0 = cc by 2 0
U <creativecommons org licenses by 2 0>
M <cc by 2> 0
cc-by-sa-4.0 = cc by sa 4 0
T <creative commons attribution sharealike 4 0 international public license>
N licensed under (?:a |the )?<creative commons attribution share> ?alike 4 0 international license
N licensed under (?:a |the )?<creative commons attribution sharealike> 4 0
U <creativecommons org licenses by sa 4 0>
M <creative commons attribution sharealike> 4 0
M <cc by sa 4> 0
cc-by-sa-3.0 = cc by sa 3 0
N licensed under (?:a |the )?<creative commons attribution sharealike> 3 0 unported license
N text is available under the <creative commons attribution sharealike> license
U <creativecommons org licenses by sa 3 0>
M <creative commons attribution sharealike> 3 0
M <cc by sa 3> 0
cc-by-nc-4.0 = cc by nc 4 0
T <creative commons attribution noncommercial 4 0 international public license>
N licensed under (?:a |the )?<creative commons attribution noncommercial> 4 0 international license
N (?:licensed|released|published|available) under (?:a |the )?<cc by nc 4> 0
U <creativecommons org licenses by nc 4 0>
M <creative commons attribution noncommercial> 4 0
M <cc by nc 4> 0
cc-by-nc-3.0 = cc by nc 3 0
U <creativecommons org licenses by nc 3 0>
M <cc by nc 3> 0
cc-by-nc-sa-4.0 = cc by nc sa 4 0
N licensed under (?:a |the )?<creative commons attribution noncommercial sharealike> 4 0 international license
U <creativecommons org licenses by nc sa 4 0>
M <creative commons attribution noncommercial sharealike> 4 0
M <cc by nc sa 4> 0
cc-by-nc-sa-3.0 = cc by nc sa 3 0
U <creativecommons org licenses by nc sa 3 0>
M <cc by nc sa 3> 0
cc-by-nc-nd-4.0 = cc by nc nd 4 0
N licensed under (?:a |the )?<creative commons attribution noncommercial noderivatives> 4 0 international license
U <creativecommons org licenses by nc nd 4 0>
M <creative commons attribution noncommercial noderiv>(?:ative)?s 4 0
M <cc by nc nd 4> 0
cc-by-nd-4.0 = cc by nd 4 0
U <creativecommons org licenses by nd 4 0>
M <creative commons attribution noderiv>(?:ative)?s 4 0
M <cc by nd 4> 0
cc-by-nc-sa = cc by nc sa
M <cc by nc sa>
M <attribution noncommercial sharealike>
cc-by-nc-nd = cc by nc nd
M <cc by nc nd>
cc-by-nc = cc by nc
M <cc by nc>
M <creative commons attribution noncommercial>
cc-by-sa = cc by sa
M <cc by sa>
M <creative commons attribution sharealike>
M <creative commons attribution share alike>
cc-by-nd = cc by nd
M <cc by nd>
cc0-1.0 = cc0 1 0
T <the person who associated a work with this deed has dedicated the work to the public domain>
T <creative commons legal code cc0 1 0 universal>
N to the extent possible under law(?: [^ ]+){1,24}? has waived all copyright and <related or neighboring rights>
U <creativecommons org publicdomain zero 1 0>
M <cc0>(?: 1 0)?(?: universal)?
M <creative commons zero>(?: v?1 0)?(?: universal)?
unlicense = unlicense
T <this is free and unencumbered software released into the public domain>
U <unlicense org>
M <the unlicense>
public-domain = public domain
N (?:this|the) (?:work|file|code|software|text|document|program)(?: [^ ]+){0,4}? (?:in|into|to) the <public domain>
N (?:released|placed|dedicated|donated) (?:in|into|to) the <public domain>
wtfpl = wtfpl
T <do what the fuck you want to public license>
U <wtfpl net>
M <wtfpl>
zlib = zlib
T <this software is provided as is without any express or implied warranty in no event will the authors be held liable>
T <altered source versions must be plainly marked as such>
U <opensource org licenses zlib>(?: license php)?
M <zlib license>
M <zlib libpng license>
libpng = libpng
T <the png reference library is supplied as is>
M <libpng license>
bsl-1.0 = bsl 1 0
T <boost software license version 1 0 august 17th 2003>
N distributed under the <boost software license>(?: version)? 1 0
U <boost org license 1 0>(?: txt)?
M <boost software license>
artistic-2.0 = artistic 2 0
T <the artistic license 2 0 copyright>
U <opensource org licenses artistic license 2 0>
M <artistic license>(?: version)? 2 0
artistic-1.0 = artistic 1 0
N you may distribute under the terms of either the gnu general public license or the <artistic license>
N <under the same terms as perl itself>
M <artistic license>
ofl-1.1 = ofl 1 1
T <sil open font license version 1 1> 26 february 2007
N this font software is licensed under the <sil open font license> version 1 1
U <scripts sil org ofl>
M <sil open font license>(?: version 1 1)?
postgresql = postgresql
T <in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages>
M <postgresql license>
python-2.0 = python 2 0
T <python software foundation license version 2>
T <this license agreement is between the python software foundation> psf and the individual or organization
C <osi approved python software foundation> license
M <psf license>
M <python software foundation license>
ruby = ruby
N distributes? under the same terms as <ruby>
M <ruby license>
php-3.01 = php 3 01
T <this source file is subject to version 3 01 of the php license>
U <php net license 3 01>(?: txt)?
M <php license>(?: version)? 3 01
openssl = openssl
T <this product includes software developed by the openssl project> for use in the openssl toolkit
M <openssl license>
x11 = x11
T <the x consortium shall not be used in advertising or otherwise to promote>
M <x11 license>
ms-pl = ms pl
T <microsoft public license ms pl> this license governs use of the accompanying software
U <opensource org licenses ms pl>
M <microsoft public license>
ms-rl = ms rl
M <microsoft reciprocal license>
eupl-1.2 = eupl 1 2
N licensed under the <eupl>(?: version)?(?: v)? ?1 2
T <european union public licence v 1 2>
M <european union public licen>[cs]e(?:(?: version)?(?: v)? ?1 2)?
eupl-1.1 = eupl 1 1
M <european union public licen>[cs]e(?: version)?(?: v)? ?1 1
upl-1.0 = upl 1 0
T <the universal permissive license upl version 1 0>
M <universal permissive license>
ncsa = ncsa
T <university of illinois ncsa open source license>
M <ncsa license>
osl-3.0 = osl 3 0
N licensed under the <open software license>(?: version)? 3 0
M <open software license>(?: version)? 3 0
afl-3.0 = afl 3 0
N licensed under the <academic free license> version 3 0
M <academic free license>(?: version)? 3 0
cpl-1.0 = cpl 1 0
M <common public license>(?: version)? 1 0
ipl-1.0 = ipl 1 0
M <ibm public license>(?: version)? 1 0
apsl-2.0 = apsl 2 0
T <this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license>
M <apple public source license>
odbl-1.0 = odbl 1 0
N made available under the <open database license>
U <opendatacommons org licenses odbl>
M <open database license>
odc-by-1.0 = odc by 1 0
N made available under the <open data commons attribution license>
U <opendatacommons org licenses by 1 0>
M <open data commons attribution license>
pddl-1.0 = pddl 1 0
U <opendatacommons org licenses pddl>
M <public domain dedication and license>
ogl-uk-3.0 = ogl uk 3 0
N licensed under the <open government licence> v3 0
U <nationalarchives gov uk doc open government licence>
M <open government licence>(?: v3 0)?
cecill-2.1 = cecill 2 1
N this software is governed by the <cecill> license
M <cecill>(?: free software)? license
bsl-1.1 = busl 1 1
T <business source license 1 1> parameters licensor
M <business source license>(?: 1 1)?
sspl-1.0 = sspl 1 0
T <server side public license version 1> october 16 2018
M <server side public license>
elastic-2.0 = elastic 2 0
T <elastic license 2 0> url
M <elastic license>(?: 2 0)?
commons-clause = commons clause
T <commons clause license condition> v1 0
M <commons clause>
polyform-noncommercial-1.0.0 = polyform noncommercial 1 0 0
M <polyform noncommercial license>
openrail-m = openrail
N licensed under the <bigscience> (?:openrail m|rail license v1 0)
M <creativeml openrail m>
M <openrail>(?: m)? license
llama-community = llama community
M <llama>(?: 2| 3| 3 1)? community license(?: agreement)?
proprietary = proprietary
N <all rights reserved> (?:no part of|unauthori[sz]ed|reproduction|do not)
N this (?:document|file|software|code|work)(?: [^ ]+){0,4}? is <proprietary and confidential>
N <no part of this publication may be reproduced>
N <unauthorized copying of this file> via any medium is strictly prohibited
"""
