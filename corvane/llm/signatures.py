"""The license signatures, written by hand from licenses' names, notices and texts: label | priority | confidence | keyword | words.

Words are lower-case runs of letters and digits; `a|b` is a choice, a trailing `?` a word that may be missing, `*` any one word. Priority 3 is for
notices, identifiers and license texts, 2 for full names, 1 for short or vague mentions. A rule runs on texts that hold its keyword.
"""

SIGNATURES = """
apache-2.0 | 3 | 1.0 | apache | spdx license identifier apache 2 0
apache-2.0 | 3 | 0.95 | apache | licensed under the? apache license version? 2 0
apache-2.0 | 3 | 0.95 | apache | released|distributed|available|published under the? terms? of? the? apache license version? 2 0
apache-2.0 | 3 | 0.95 | apache | www apache org licenses license 2 0
apache-2.0 | 2 | 0.9 | apache | apache license version? v? 2 0?
apache-2.0 | 2 | 0.85 | apache | apache 2 0? license|licence|licensed
apache-2.0 | 3 | 0.9 | perpetual | perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 | 3 | 0.9 | perpetual | perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license
apache-2.0 | 3 | 0.9 | agreed | unless required by applicable law or agreed to in writing software distributed under the license
apache-1.1 | 3 | 1.0 | apache | spdx license identifier apache 1 1
apache-1.1 | 2 | 0.9 | apache | apache software license version? 1 1
apache-1.0 | 3 | 1.0 | apache | spdx license identifier apache 1 0
apache-1.0 | 2 | 0.9 | apache | apache software license version? 1 0
apache-1.1 | 3 | 0.85 | apache | products derived from this software may not be called apache
mit | 3 | 1.0 | mit | spdx license identifier mit
mit | 3 | 0.95 | mit | licensed|released|distributed|available|published|provided under the? terms? of? the? mit license|licence
mit | 3 | 0.95 | opensource | opensource org licenses mit
mit | 2 | 0.9 | mit | the mit license mit
mit | 2 | 0.85 | mit | mit licensed
mit | 2 | 0.8 | mit | mit x11? style? license|licence
mit | 3 | 0.95 | hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | 3 | 0.9 | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 2 | 0.7 | warranty | the software is provided as is without warranty of any kind express or implied
mit-0 | 3 | 1.0 | mit | spdx license identifier mit 0
mit-0 | 2 | 0.9 | mit | mit no attribution license?
x11 | 3 | 1.0 | x11 | spdx license identifier x11
x11 | 2 | 0.85 | x11 | x11 license|licence
expat | 2 | 0.85 | expat | expat license|licence
isc | 3 | 1.0 | isc | spdx license identifier isc
isc | 3 | 0.95 | isc | licensed|released|distributed|available under the? terms? of? the? isc license|licence
isc | 2 | 0.9 | isc | isc license|licence
isc | 3 | 0.95 | permission | permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted
0bsd | 3 | 1.0 | 0bsd | spdx license identifier 0bsd
0bsd | 2 | 0.9 | zero clause | zero clause bsd license?
0bsd | 2 | 0.9 | zero clause | bsd zero clause license
bsd-2-clause | 3 | 1.0 | bsd | spdx license identifier bsd 2 clause
bsd-2-clause | 2 | 0.9 | bsd | bsd 2|two clause license|licence
bsd-2-clause | 2 | 0.9 | clause | 2|two clause bsd license|licence
bsd-2-clause | 2 | 0.85 | bsd | simplified bsd license|licence
bsd-2-clause | 2 | 0.85 | freebsd | freebsd license|licence
bsd-3-clause | 3 | 1.0 | bsd | spdx license identifier bsd 3 clause
bsd-3-clause | 2 | 0.9 | bsd | bsd 3|three clause license|licence
bsd-3-clause | 2 | 0.9 | clause | 3|three clause bsd license|licence
bsd-3-clause | 2 | 0.85 | bsd | new|revised|modified bsd license|licence
bsd-3-clause | 3 | 0.9 | endorse | may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 3 | 1.0 | bsd | spdx license identifier bsd 4 clause
bsd-4-clause | 2 | 0.9 | bsd | bsd 4|four clause license|licence
bsd-4-clause | 2 | 0.85 | bsd | original|old bsd license|licence
bsd-4-clause | 3 | 0.9 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | 3 | 0.9 | redistributions | redistributions of source code must retain the above copyright notice
bsd | 3 | 0.9 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd | 3 | 0.85 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 1 | 0.6 | bsd | bsd style? license|licence|licensed
gpl-1.0 | 3 | 1.0 | gpl | spdx license identifier gpl 1 0 only|or? later?
gpl-1.0 | 2 | 0.9 | general public | gnu general public license version 1
gpl-2.0 | 3 | 1.0 | gpl | spdx license identifier gpl 2 0 only|or? later?
gpl-2.0 | 3 | 0.95 | general public | under the terms of the gnu general public license version 2
gpl-2.0 | 3 | 0.95 | general public | under the terms of the gnu general public license as published by the free software foundation either version 2
gpl-2.0 | 2 | 0.9 | general public | gnu? general public license version|v 2
gpl-2.0 | 2 | 0.8 | gplv2 | gplv2 license|licence|licensed
gpl-2.0 | 3 | 0.9 | 51 franklin | free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa
gpl-3.0 | 3 | 1.0 | gpl | spdx license identifier gpl 3 0 only|or? later?
gpl-3.0 | 3 | 0.95 | general public | under the terms of the gnu general public license version 3
gpl-3.0 | 3 | 0.95 | general public | under the terms of the gnu general public license as published by the free software foundation either version 3
gpl-3.0 | 2 | 0.9 | general public | gnu? general public license version|v 3
gpl-3.0 | 2 | 0.8 | gplv3 | gplv3 license|licence|licensed
gpl | 2 | 0.8 | general public | licensed|released|distributed|available under the? terms? of? the? gnu general public license
gpl | 2 | 0.8 | general public | you should have received a copy of the gnu general public license
gpl | 2 | 0.75 | copyleft | gnu copyleft license|licence
gpl | 1 | 0.6 | gpl | gnu? gpl license|licence|licensed
gpl | 3 | 0.85 | free software | this program is free software you can redistribute it and or modify it under the terms
gpl | 3 | 0.8 | fitness | without even the implied warranty of merchantability or fitness for a particular purpose
lgpl-2.0 | 3 | 1.0 | lgpl | spdx license identifier lgpl 2 0 only|or? later?
lgpl-2.0 | 2 | 0.9 | library general | gnu? library general public license
lgpl-2.1 | 3 | 1.0 | lgpl | spdx license identifier lgpl 2 1 only|or? later?
lgpl-2.1 | 2 | 0.9 | lesser general | gnu? lesser general public license version|v 2 1?
lgpl-3.0 | 3 | 1.0 | lgpl | spdx license identifier lgpl 3 0 only|or? later?
lgpl-3.0 | 2 | 0.9 | lesser general | gnu? lesser general public license version|v 3
lgpl | 2 | 0.8 | lesser general | gnu? lesser general public license
lgpl | 1 | 0.6 | lgpl | gnu? lgpl license|licence|licensed
agpl-3.0 | 3 | 1.0 | agpl | spdx license identifier agpl 3 0 only|or? later?
agpl-3.0 | 2 | 0.9 | affero | gnu? affero general public license version? v? 3?
agpl-3.0 | 1 | 0.6 | agpl | gnu? agpl license|licence|licensed
agpl-1.0 | 2 | 0.9 | affero | affero general public license version 1
gfdl-1.1 | 3 | 1.0 | gfdl | spdx license identifier gfdl 1 1
gfdl-1.2 | 3 | 1.0 | gfdl | spdx license identifier gfdl 1 2
gfdl-1.3 | 3 | 1.0 | gfdl | spdx license identifier gfdl 1 3
gfdl-1.2 | 2 | 0.9 | documentation | gnu free documentation license version 1 2
gfdl-1.3 | 2 | 0.9 | documentation | gnu free documentation license version 1 3
gfdl | 2 | 0.8 | documentation | gnu free documentation license
gfdl | 3 | 0.85 | invariant | with no invariant sections no front cover texts and no back cover texts
mpl-1.0 | 3 | 1.0 | mpl | spdx license identifier mpl 1 0
mpl-1.0 | 2 | 0.9 | mozilla | mozilla public license version? 1 0
mpl-1.1 | 3 | 1.0 | mpl | spdx license identifier mpl 1 1
mpl-1.1 | 2 | 0.9 | mozilla | mozilla public license version? 1 1
mpl-2.0 | 3 | 1.0 | mpl | spdx license identifier mpl 2 0
mpl-2.0 | 3 | 0.95 | mozilla | subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 2 | 0.9 | mozilla | mozilla public license version? v? 2 0
mpl | 2 | 0.75 | mozilla | mozilla public license
epl-1.0 | 3 | 1.0 | epl | spdx license identifier epl 1 0
epl-1.0 | 2 | 0.9 | eclipse | eclipse public license version? v? 1 0
epl-2.0 | 3 | 1.0 | epl | spdx license identifier epl 2 0
epl-2.0 | 2 | 0.9 | eclipse | eclipse public license version? v? 2 0
edl-1.0 | 2 | 0.9 | eclipse | eclipse distribution license version? v? 1 0
cddl-1.0 | 3 | 1.0 | cddl | spdx license identifier cddl 1 0
cddl-1.0 | 2 | 0.9 | common development | common development and distribution license version? 1 0
cddl-1.1 | 2 | 0.9 | common development | common development and distribution license version? 1 1
cddl | 2 | 0.75 | common development | common development and distribution license
cpl-1.0 | 2 | 0.9 | common public | common public license version? v? 1 0
ipl-1.0 | 2 | 0.9 | ibm | ibm public license version? 1 0
eupl-1.1 | 3 | 1.0 | eupl | spdx license identifier eupl 1 1
eupl-1.1 | 2 | 0.9 | european union | european union public licence|license v? version? 1 1
eupl-1.2 | 3 | 1.0 | eupl | spdx license identifier eupl 1 2
eupl-1.2 | 2 | 0.9 | european union | european union public licence|license v? version? 1 2
artistic-1.0 | 3 | 1.0 | artistic | spdx license identifier artistic 1 0
artistic-1.0 | 2 | 0.9 | artistic | artistic license version? 1 0
artistic-2.0 | 3 | 1.0 | artistic | spdx license identifier artistic 2 0
artistic-2.0 | 2 | 0.9 | artistic | artistic license version? 2 0
artistic | 1 | 0.7 | artistic | artistic license
perl | 3 | 0.9 | perl | under the same terms as perl itself license|licence?
zlib | 3 | 1.0 | zlib | spdx license identifier zlib
zlib | 2 | 0.9 | zlib | zlib libpng? license|licence
zlib | 3 | 0.9 | misrepresented | the origin of this software must not be misrepresented
libpng | 2 | 0.9 | png | png reference library license version? 2?
libtiff | 2 | 0.85 | libtiff | libtiff license
ijg | 2 | 0.9 | independent jpeg | independent jpeg group license
bsl-1.0 | 3 | 1.0 | bsl | spdx license identifier bsl 1 0
bsl-1.0 | 2 | 0.9 | boost | boost software license version? 1 0
bsl-1.0 | 3 | 0.95 | boost | distributed under the boost software license
busl-1.1 | 3 | 1.0 | busl | spdx license identifier busl 1 1
busl-1.1 | 2 | 0.9 | business source | business source license version? 1 1
busl-1.1 | 3 | 0.85 | change date | on the change date or the fourth anniversary of the first publicly available distribution
sspl-1.0 | 3 | 1.0 | sspl | spdx license identifier sspl 1 0
sspl-1.0 | 2 | 0.9 | server side | server side public license version? v? 1?
elastic-2.0 | 3 | 1.0 | elastic | spdx license identifier elastic 2 0
elastic-2.0 | 2 | 0.9 | elastic | elastic license version? v? 2 0?
rsal | 2 | 0.9 | redis | redis source available license
commons-clause | 2 | 0.9 | commons clause | commons clause license condition version? v? 1 0
confluent | 2 | 0.9 | confluent | confluent community license agreement? version? 1 0
polyform-noncommercial | 2 | 0.9 | polyform | polyform noncommercial license
polyform-small-business | 2 | 0.9 | polyform | polyform small business license
prosperity | 2 | 0.9 | prosperity | prosperity public license
fsl | 2 | 0.9 | functional source | functional source license
psf-2.0 | 3 | 1.0 | psf | spdx license identifier psf 2 0
psf-2.0 | 2 | 0.9 | python software | python software foundation license agreement? version? 2?
cnri-python | 2 | 0.9 | cnri | cnri open source license agreement
php-3.0 | 2 | 0.9 | php | php license version? 3 0
php-3.01 | 3 | 1.0 | php | spdx license identifier php 3 01
php-3.01 | 2 | 0.9 | php | php license version? 3 01
ruby | 3 | 1.0 | ruby | spdx license identifier ruby
ruby | 2 | 0.85 | ruby | ruby license|licence
openssl | 3 | 1.0 | openssl | spdx license identifier openssl
openssl | 2 | 0.9 | openssl | openssl license|licence
ssleay | 2 | 0.85 | ssleay | original ssleay license
ofl-1.0 | 2 | 0.9 | sil open | sil open font license version? 1 0
ofl-1.1 | 3 | 1.0 | ofl | spdx license identifier ofl 1 1
ofl-1.1 | 2 | 0.9 | sil open | sil open font license version? 1 1
ubuntu-font | 2 | 0.9 | ubuntu | ubuntu font licence|license version? 1 0
bitstream-vera | 2 | 0.9 | bitstream | bitstream vera fonts copyright
odbl-1.0 | 3 | 1.0 | odbl | spdx license identifier odbl 1 0
odbl-1.0 | 2 | 0.9 | open database | open database license|licence
odc-by-1.0 | 2 | 0.9 | open data | open data commons attribution license
pddl-1.0 | 2 | 0.9 | open data | open data commons public domain dedication and license|licence
ogl-uk-3.0 | 2 | 0.9 | open government | open government licence|license v? version? 3 0
ogl | 2 | 0.8 | open government | open government licence|license
etalab-2.0 | 2 | 0.9 | etalab | etalab open? license|licence 2 0
unlicense | 3 | 1.0 | unlicense | spdx license identifier unlicense
unlicense | 2 | 0.85 | unlicense | the unlicense license?
unlicense | 3 | 0.95 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 3 | 1.0 | wtfpl | spdx license identifier wtfpl
wtfpl | 2 | 0.9 | want to | do what the fuck you want to public license
beerware | 2 | 0.9 | beer | the? beer ware license
postgresql | 3 | 1.0 | postgresql | spdx license identifier postgresql
postgresql | 2 | 0.9 | postgresql | postgresql license|licence
ntp | 3 | 0.8 | suitability | makes no representations about the suitability this software for any purpose warranty?
hpnd | 2 | 0.9 | historical | historical permission notice and disclaimer
curl | 2 | 0.85 | curl | curl license
icu | 2 | 0.85 | icu | icu license
unicode-dfs | 2 | 0.9 | unicode | unicode license agreement data files and software
w3c | 2 | 0.9 | w3c | w3c software notice and license
ncsa | 3 | 1.0 | ncsa | spdx license identifier ncsa
ncsa | 2 | 0.9 | illinois | university of illinois ncsa open source license
upl-1.0 | 3 | 1.0 | upl | spdx license identifier upl 1 0
upl-1.0 | 2 | 0.9 | universal permissive | universal permissive license version? v? 1 0
ecl-2.0 | 2 | 0.9 | educational community | educational community license version? 2 0
afl-3.0 | 2 | 0.9 | academic free | academic free license version? v? 3 0
osl-3.0 | 2 | 0.9 | open software | open software license version? v? 3 0
mulan-psl-2.0 | 2 | 0.9 | mulan | mulan permissive software license version? v? 2
ms-pl | 3 | 1.0 | ms pl | spdx license identifier ms pl
ms-pl | 2 | 0.9 | microsoft | microsoft public license
ms-rl | 2 | 0.9 | microsoft | microsoft reciprocal license
ms-lpl | 2 | 0.9 | microsoft | microsoft limited public license
blueoak-1.0 | 2 | 0.9 | blue oak | blue oak model license
cecill-2.1 | 3 | 1.0 | cecill | spdx license identifier cecill 2 1
cecill | 2 | 0.8 | cecill | cecill b|c? free? software? license|licence
qpl-1.0 | 2 | 0.9 | q public | q public license version? 1 0
sleepycat | 2 | 0.9 | sleepycat | sleepycat license
vim | 2 | 0.85 | vim | vim license
tcl | 2 | 0.85 | tcl | tcl tk license
nasa-1.3 | 2 | 0.9 | nasa | nasa open source agreement version? 1 3 license?
intel | 2 | 0.85 | intel | intel open source license
nvidia | 2 | 0.85 | nvidia | nvidia software license agreement
oracle-bcl | 2 | 0.9 | oracle | oracle binary code license agreement
jrl | 2 | 0.85 | java research | java research license
json | 3 | 0.9 | good not evil | the software shall be used for good not evil license?
openrail-m | 2 | 0.9 | rail | open rail m license
openrail-m | 2 | 0.9 | responsible ai | responsible ai license
bigscience-rail | 2 | 0.9 | bigscience | bigscience rail license
llama | 2 | 0.9 | llama | llama 2|3? community license agreement
gemma | 2 | 0.85 | gemma | gemma terms of use license?
cc0-1.0 | 3 | 1.0 | cc0 | spdx license identifier cc0 1 0
cc0-1.0 | 2 | 0.9 | cc0 | cc0 1 0 universal? license?
cc0-1.0 | 2 | 0.9 | creative commons | creative commons zero license?
cc0-1.0 | 3 | 0.95 | publicdomain | creativecommons org publicdomain zero license?
cc-by-2.0 | 3 | 1.0 | cc by | spdx license identifier cc by 2 0
cc-by-2.5 | 3 | 1.0 | cc by | spdx license identifier cc by 2 5
cc-by-3.0 | 3 | 1.0 | cc by | spdx license identifier cc by 3 0
cc-by-4.0 | 3 | 1.0 | cc by | spdx license identifier cc by 4 0
cc-by-2.0 | 2 | 0.9 | creative commons | creative commons attribution 2 0
cc-by-3.0 | 2 | 0.9 | creative commons | creative commons attribution 3 0
cc-by-4.0 | 2 | 0.9 | creative commons | creative commons attribution 4 0
cc-by-4.0 | 2 | 0.85 | cc by | cc by 4 0 license|licence|international
cc-by-3.0 | 2 | 0.85 | cc by | cc by 3 0 license|licence|unported
cc-by-sa-2.0 | 2 | 0.9 | creative commons | creative commons attribution sharealike|share alike? 2 0
cc-by-sa-2.5 | 2 | 0.9 | creative commons | creative commons attribution sharealike|share alike? 2 5
cc-by-sa-3.0 | 3 | 1.0 | cc by | spdx license identifier cc by sa 3 0
cc-by-sa-3.0 | 2 | 0.9 | creative commons | creative commons attribution sharealike|share alike? 3 0
cc-by-sa-3.0 | 2 | 0.85 | cc by | cc by sa 3 0 license|licence|unported
cc-by-sa-4.0 | 3 | 1.0 | cc by | spdx license identifier cc by sa 4 0
cc-by-sa-4.0 | 2 | 0.9 | creative commons | creative commons attribution sharealike|share alike? 4 0
cc-by-sa-4.0 | 2 | 0.85 | cc by | cc by sa 4 0 license|licence|international
cc-by-nc-2.0 | 2 | 0.9 | creative commons | creative commons attribution noncommercial|non commercial? 2 0
cc-by-nc-3.0 | 2 | 0.9 | creative commons | creative commons attribution noncommercial|non commercial? 3 0
cc-by-nc-4.0 | 3 | 1.0 | cc by | spdx license identifier cc by nc 4 0
cc-by-nc-4.0 | 2 | 0.9 | creative commons | creative commons attribution noncommercial|non commercial? 4 0
cc-by-nc-4.0 | 2 | 0.85 | cc by | cc by nc 4 0 license|licence|international
cc-by-nd-3.0 | 2 | 0.9 | creative commons | creative commons attribution noderivs|noderivatives|no derivatives|derivs? 3 0
cc-by-nd-4.0 | 3 | 1.0 | cc by | spdx license identifier cc by nd 4 0
cc-by-nd-4.0 | 2 | 0.9 | creative commons | creative commons attribution noderivs|noderivatives|no derivatives|derivs? 4 0
cc-by-nc-sa-3.0 | 2 | 0.9 | creative commons | creative commons attribution noncommercial|non commercial? sharealike|share alike? 3 0
cc-by-nc-sa-4.0 | 3 | 1.0 | cc by | spdx license identifier cc by nc sa 4 0
cc-by-nc-sa-4.0 | 2 | 0.9 | creative commons | creative commons attribution noncommercial|non commercial? sharealike|share alike? 4 0
cc-by-nc-nd-3.0 | 2 | 0.9 | creative commons | creative commons attribution noncommercial|non commercial? noderivs|noderivatives|no derivatives|derivs? 3 0
cc-by-nc-nd-4.0 | 3 | 1.0 | cc by | spdx license identifier cc by nc nd 4 0
cc-by-nc-nd-4.0 | 2 | 0.9 | creative commons | creative commons attribution noncommercial|non commercial? noderivs|noderivatives|no derivatives|derivs? 4 0
cc | 1 | 0.6 | creative commons | creative commons license|licence
cc | 3 | 0.8 | creativecommons | creativecommons org licenses by
public-domain | 2 | 0.7 | public domain | dedicated|released|placed to|into|in the? public domain
public-domain | 2 | 0.7 | public domain | public domain dedication
public-domain | 1 | 0.5 | public domain | is in the public domain
permission-grant | 2 | 0.8 | licen | hereby grants|granted * a? license|licence
permission-grant | 2 | 0.6 | permission | permission is hereby granted
all-rights-reserved | 1 | 0.5 | rights reserved | all rights reserved
some-rights-reserved | 1 | 0.5 | rights reserved | some rights reserved
copyright-notice | 1 | 0.4 | copyright | copyright c? *
proprietary | 2 | 0.6 | licen | proprietary license|licence
proprietary | 2 | 0.7 | confidential | proprietary and confidential license?
commercial | 2 | 0.6 | licen | commercial license|licence
dual-license | 2 | 0.6 | licen | dual licensed|license under?
dual-license | 2 | 0.6 | licen | licensed under either of
evaluation | 2 | 0.6 | licen | evaluation license|licence agreement?
end-user | 2 | 0.7 | licen | end user license|licence agreement
end-user | 1 | 0.5 | eula | eula license|licence
site-license | 1 | 0.5 | licen | site license|licence
source-available | 2 | 0.6 | source available | source available license|licence
non-commercial | 2 | 0.6 | commercial | for non|no commercial use|purposes only license?
academic-use | 2 | 0.6 | use only | for academic|research use only license?
license-file | 1 | 0.4 | licen | see the? license|licence|licensing file|text|notice for
license-file | 1 | 0.4 | licen | found in the license|licence file
third-party | 1 | 0.4 | third party | third party licenses|license|notices
no-warranty | 1 | 0.4 | warranty | there is no warranty for the program
no-warranty | 1 | 0.4 | warranties | disclaims all warranties
no-liability | 1 | 0.4 | liable | in no event shall the authors or copyright holders be liable
"""


def signatures() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, confidence, keyword, words), in order of precedence."""
    rows = [[x.strip() for x in line.split(" | ")] for line in SIGNATURES.strip().splitlines()]
    return [(label, int(priority), float(confidence), keyword, words) for label, priority, confidence, keyword, words in rows]
