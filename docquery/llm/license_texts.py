"""What licence families say of themselves, and what only sounds
like it. Each line is a paragraph."""

TEMPLATES = {
    "apache-2.0": """
Licensed under the Apache License, Version 2.0.
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
This project is released under the Apache 2.0 license.
SPDX-License-Identifier: Apache-2.0
Apache License Version 2.0, January 2004
you may not use this file except in compliance with the License. You may obtain a copy of the License at
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.
The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.
Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work.
""",
    "mit": """
Released under the MIT License.
This software is released under the MIT License.
Licensed under the MIT license.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.
SPDX-License-Identifier: MIT
The MIT License (MIT)
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT.
""",
    "gpl": """
This work is licensed under the GNU General Public License, version 3.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.
Licensed under the GPL, version 2 or later.
Released under the GNU GPL v3.
SPDX-License-Identifier: GPL-3.0-or-later
You should have received a copy of the GNU General Public License along with this program.
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.
You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA.
The GNU General Public License is a free, copyleft license for software and other kinds of works.
GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
GNU GENERAL PUBLIC LICENSE Version 2, June 1991
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
""",
    "lgpl": """
This library is licensed under the GNU Lesser General Public License, version 2.1.
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.
Licensed under the LGPL, version 3.
SPDX-License-Identifier: LGPL-2.1-or-later
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.
GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007
""",
    "agpl": """
This work is licensed under the GNU Affero General Public License, version 3.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.
Licensed under the AGPL, version 3.
SPDX-License-Identifier: AGPL-3.0-only
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; see the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.
GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007
""",
    "bsd": """
Released under the BSD License.
Licensed under the BSD 3-Clause License.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
SPDX-License-Identifier: BSD-3-Clause
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.
All advertising materials mentioning features or use of this software must display the following acknowledgement.
""",
    "mpl": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
Licensed under the Mozilla Public License, version 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.
SPDX-License-Identifier: MPL-2.0
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0.
Mozilla Public License Version 2.0
""",
    "cc-by": """
Licensed under CC BY 4.0.
This work is licensed under a Creative Commons Attribution 4.0 International License.
This article is distributed under the terms of the Creative Commons Attribution License.
SPDX-License-Identifier: CC-BY-4.0
You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit, provide a link to the license, and indicate if changes were made.
This is an open access article distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited.
Creative Commons Attribution 4.0 International Public License
""",
    "cc-by-sa": """
Licensed under CC BY-SA 4.0.
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
Text is available under the Creative Commons Attribution-ShareAlike License.
SPDX-License-Identifier: CC-BY-SA-4.0
If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.
Creative Commons Attribution-ShareAlike 4.0 International Public License
Content is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.
""",
    "cc-by-nc": """
Licensed under CC BY-NC 4.0.
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
Released under CC BY-NC-SA 4.0.
SPDX-License-Identifier: CC-BY-NC-4.0
You may not use the material for commercial purposes.
Creative Commons Attribution-NonCommercial 4.0 International Public License
This is an open access article under the Creative Commons Attribution-NonCommercial-NoDerivs License, which permits use and distribution in any medium, provided the use is non-commercial.
""",
    "public-domain": """
This is free and unencumbered software released into the public domain.
To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.
This work is dedicated to the public domain.
SPDX-License-Identifier: CC0-1.0
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.
The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.
CC0 1.0 Universal
Licensed under the Unlicense.
SPDX-License-Identifier: Unlicense
For more information, please refer to <http://unlicense.org/>
""",
    "isc": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
Licensed under the ISC License.
SPDX-License-Identifier: ISC
ISC License
""",
    "zlib": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
This notice may not be removed or altered from any source distribution.
SPDX-License-Identifier: Zlib
""",
    "eupl": """
Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL (the "Licence").
You may not use this work except in compliance with the Licence. You may obtain a copy of the Licence at https://joinup.ec.europa.eu/software/page/eupl
Unless required by applicable law or agreed to in writing, software distributed under the Licence is distributed on an "AS IS" basis, without warranties or conditions of any kind, either express or implied.
European Union Public Licence v. 1.2
SPDX-License-Identifier: EUPL-1.2
""",
    "proprietary": """
All rights reserved. Unauthorized copying, distribution or use of this material is prohibited.
No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.
This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.
""",
    "artistic": """
Licensed under the Artistic License 2.0.
You may use this file under the terms of the Artistic License.
This is free software; you can redistribute it and/or modify it under the same terms as Perl itself.
This program is distributed under the terms of the Artistic License.
SPDX-License-Identifier: Artistic-2.0
The Artistic License
The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications.
You may otherwise modify your copy of this Package in any way, provided that you insert a prominent notice in each changed file stating how and when you changed that file.
""",
    "gfdl": """
This document is licensed under the GNU Free Documentation License, version 1.3.
Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.
A copy of the license is included in the section entitled "GNU Free Documentation License".
Text is available under the GFDL.
SPDX-License-Identifier: GFDL-1.3-or-later
GNU Free Documentation License Version 1.3, 3 November 2008
The purpose of this License is to make a manual, textbook, or other functional and useful document "free" in the sense of freedom: to assure everyone the effective freedom to copy and redistribute it, with or without modifying it, either commercially or noncommercially.
""",
    "epl": """
Licensed under the Eclipse Public License, version 2.0.
This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html
This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/
Released under the EPL 1.0.
SPDX-License-Identifier: EPL-2.0
Eclipse Public License - v 2.0
THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.
""",
    "boost": """
Distributed under the Boost Software License, Version 1.0.
Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)
SPDX-License-Identifier: BSL-1.0
Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so
unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
""",
    "postgresql": """
Released under the PostgreSQL License.
Licensed under the PostgreSQL License, a liberal open source license.
SPDX-License-Identifier: PostgreSQL
The PostgreSQL License
Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.
""",
    "ms-pl": """
Licensed under the Microsoft Public License.
This source code is subject to the Microsoft Public License (Ms-PL).
Released under the MS-PL.
SPDX-License-Identifier: MS-PL
Microsoft Public License (MS-PL)
This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software.
""",
    "cddl": """
Licensed under the Common Development and Distribution License, version 1.0.
The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.
Released under the CDDL 1.1.
SPDX-License-Identifier: CDDL-1.0
COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0
When distributing Covered Code, include this CDDL HEADER in each file and include the License file.
""",
    "wtfpl": """
Licensed under the WTFPL, version 2.
SPDX-License-Identifier: WTFPL
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004
You just DO WHAT THE FUCK YOU WANT TO.
""",
    "ofl": """
This Font Software is licensed under the SIL Open Font License, Version 1.1.
Licensed under the SIL Open Font License.
SPDX-License-Identifier: OFL-1.1
SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007
The OFL allows the licensed fonts to be used, studied, modified and redistributed freely as long as they are not sold by themselves.
""",
    "python": """
Licensed under the Python Software Foundation License.
Released under the PSF license, version 2.
SPDX-License-Identifier: Python-2.0
PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2
This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using this software ("Python") in source or binary form and its associated documentation.
""",
    "odbl": """
Licensed under the Open Database License.
This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/.
Any rights in individual contents of the database are licensed under the Database Contents License.
SPDX-License-Identifier: ODbL-1.0
Open Data Commons Open Database License (ODbL) v1.0
""",
    "ncsa": """
Licensed under the University of Illinois/NCSA Open Source License.
This file is distributed under the University of Illinois Open Source License. See LICENSE.TXT for details.
SPDX-License-Identifier: NCSA
University of Illinois/NCSA Open Source License
""",
    "cecill": """
Licensed under the CeCILL license, version 2.1.
This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software.
You can use, modify and/or redistribute the software under the terms of the CeCILL license as circulated by CEA, CNRS and INRIA.
SPDX-License-Identifier: CECILL-2.1
""",
    "osl": """
Licensed under the Open Software License version 3.0.
Licensed under the Academic Free License version 3.0.
This source file is subject to the Open Software License (OSL 3.0) that is bundled with this package.
SPDX-License-Identifier: OSL-3.0
SPDX-License-Identifier: AFL-3.0
""",
}

#: Words, or runs of them, that name a family: three words with one of them speak for it
#: wherever it stands, since it is said of that family (as a text of the GPL
#: speaks of the Affero GPL).
NAMES = {
    "apache-2.0": ("apache",), "mit": ("mit",), "gpl": ("gpl", "gnu general public", "the gnu general"), "lgpl": ("lgpl", "lesser"), "agpl": ("agpl", "affero"), "bsd": ("bsd",), "mpl": ("mpl", "mozilla"),
    "cc-by": ("cc", "commons"), "cc-by-sa": ("sharealike",), "cc-by-nc": ("noncommercial",), "public-domain": ("cc0", "unlicense", "unencumbered"), "isc": ("isc",), "zlib": ("zlib",), "eupl": ("eupl",),
    "artistic": ("artistic", "perl"), "gfdl": ("gfdl",), "epl": ("epl", "eclipse"), "boost": ("boost",), "postgresql": ("postgresql",), "ms-pl": ("ms", "microsoft"),
    "cddl": ("cddl",), "wtfpl": ("wtfpl",), "ofl": ("ofl", "sil"), "python": ("psf", "python"), "odbl": ("odbl",), "ncsa": ("ncsa",), "cecill": ("cecill",), "osl": ("osl", "afl"),
}

#: Whole texts (in license_bodies) by family. What the body of another family
#: says too proves nothing.
BODIES = {
    "Apache-2.0": "apache-2.0", "Artistic": "artistic", "BSD": "bsd", "CC0-1.0": "public-domain", "GFDL-1.3": "gfdl", "GPL-1": "gpl", "GPL-2": "gpl", "GPL-3": "gpl",
    "LGPL-2.1": "lgpl", "LGPL-3": "lgpl", "MPL-1.1": "mpl", "MPL-2.0": "mpl",
}

UNLIKE = """
All rights reserved.
The driver showed a valid license and the police let the car pass.
A fishing license costs twenty dollars in most states.
He was released from prison under strict conditions.
The new version of the film was released in public cinemas.
This work is hard and the terms of the contract are not good.
She works for the general public and the free press.
The software was sold with a copy of the manual.
Permission to land was granted to the pilot by the tower.
The Apache helicopter is used by the army.
Students at MIT study physics and mathematics.
The foundation published a list of conditions for the prize.
Rights of workers are reserved in the law of the country.
The library is open to the public without charge.
The commons is a park in the centre of the city.
You may use the file to sharpen the tool.
International law covers the use of the sea.
The domain of the function is the set of real numbers.
The notice on the door said that the shop is closed.
Version 2 of the program is faster than version 1.
A person may copy the text of the page by hand.
Modification of the engine is permitted if the owner agrees.
The author has written a book on the source of the river.
Licensed under the Example License.
Released under the Example License.
This work is licensed under the Example Public License, version 1.
This software is released under a license of its own.
Licensed under the terms of another license, version 5.
He released the album under the MIT press in version 2.0.
The band released the record under the Apollo label.
The ship was distributed in parts, in the hope that it would be useful to the navy.
A copy of the letter was obtained by a person who dealt in antiques.
The warranty of the car is limited to three years and covers the engine only.
In no event will the match be held before Sunday.
The event was held in the hall, and the organisers were liable for the damages.
The claim arose from the use of the building without permission.
The above list of names is included in all copies of the programme.
The university press published the first edition without any changes.
The committee shall include the following conditions in the notice.
The court granted the holder of the patent damages for loss of profits.
Version 3 of the report was published by the foundation in June.
The public may use the park for any purpose, free of charge.
"""

#: Notices as they are met, none of them a template; the model isn't fitted to them, they calibrate it. Family, then the text.
HELD_OUT = """
apache-2.0|Distributed under the Apache License 2.0, see the file LICENSE.
apache-2.0|The code is available under the Apache License (version 2.0).
apache-2.0|Copyright 2019 The Authors. Licensed under the Apache License, Version 2.0.
apache-2.0|License: Apache 2.0
mit|Distributed under the terms of the MIT license.
mit|This project is MIT licensed; the MIT License is in the file LICENSE.
mit|Copyright (c) 2015 Someone, released under the MIT license
mit|The software is provided as is, without warranty of any kind, express or implied.
gpl|This package is distributed under the terms of the GNU General Public License, version 2 or later.
gpl|It is free software under the GNU GPL version 3.
gpl|you can redistribute it and/or modify it under the terms of the GNU General Public License
gpl|See the GNU General Public License for more details.
lgpl|The library may be used under the GNU Lesser General Public License version 3.
lgpl|Licensed under LGPL 2.1 or later, see COPYING.LESSER
agpl|The server is free software under the GNU Affero General Public License version 3.
agpl|Released under the AGPL, version 3 or any later version.
bsd|Distributed under the 3-clause BSD license.
bsd|This code is released under the BSD 2-Clause License, see LICENSE.
bsd|Redistribution and use in source and binary forms are permitted provided that the above copyright notice is kept.
mpl|The source code is subject to the Mozilla Public License 2.0.
mpl|Licensed under the MPL 2.0, a copy of which is at mozilla.org/MPL/2.0
cc-by|The text is licensed under a Creative Commons Attribution 4.0 license.
cc-by|Published as open access under CC BY 4.0.
cc-by-sa|This page is available under the Creative Commons Attribution-ShareAlike License 4.0.
cc-by-sa|Images are licensed under CC BY-SA 3.0.
cc-by-nc|The data are licensed under Creative Commons Attribution-NonCommercial 4.0.
cc-by-nc|Photos under CC BY-NC 2.0.
public-domain|This file has been released into the public domain by its author.
public-domain|The author waives all copyright under CC0 1.0.
isc|This module is distributed under the ISC license.
isc|Permission to use, copy, modify and distribute this software for any purpose is hereby granted.
zlib|Permission is granted to anyone to use this software for any purpose and to redistribute it freely.
zlib|The origin of this software must not be misrepresented.
eupl|Available under the European Union Public Licence v. 1.2.
eupl|Licensed under the EUPL 1.2 or later.
unknown|Copyright 2020 Some Company. All rights reserved.
proprietary|This document is confidential; copying without written permission of the publisher is prohibited.
unknown|He holds a pilot license and a degree from MIT.
unknown|The new version is released next week in all shops.
unknown|Licensed under the Sample License.
unknown|This work is under review by the public prosecutor.
unknown|The general opinion of the public was divided on the matter.
unknown|A copy of the contract was sent to the authors and the publisher.
unknown|The file was distributed to all members in source and in print.
unknown|The guarantee is void without the receipt.
unknown|They gave permission to use the hall for the concert.
unknown|The Mozilla browser was the first program that he installed.
unknown|Creative writing is taught in the international school.
unknown|All rights and duties are written down in the law.
unknown|The Berkeley campus is larger than the others.
unknown|The terms of the agreement were modified after the meeting.
unknown|A driver must keep the notice in the car.
unknown|The foundation supports free schools in the union.
unknown|You may obtain the book in any library.
unknown|Damages of this kind are not covered by the insurance.
artistic|Released under the Artistic License, see the file Artistic.
artistic|This module may be distributed under the same terms as Perl itself.
gfdl|This manual is published under the GNU Free Documentation License 1.2.
gfdl|Permission to copy this article under the GFDL, version 1.2 or later.
epl|The plug-in is available under the Eclipse Public License 1.0.
epl|Distributed under EPL 2.0
boost|This header is under the Boost Software License 1.0.
boost|Boost Software License, see LICENSE_1_0.txt
postgresql|Available under the PostgreSQL License, see COPYRIGHT.
ms-pl|This sample is licensed under the Microsoft Public License (MS-PL).
cddl|The container is under the Common Development and Distribution License 1.0.
cddl|License: CDDL 1.0
wtfpl|This script is under the WTFPL.
ofl|The fonts are available under the SIL Open Font License 1.1.
ofl|Font licensed under the OFL.
python|Distributed under the Python Software Foundation License version 2.
odbl|The map data are available under the Open Database License.
ncsa|LLVM was released under the University of Illinois/NCSA Open Source License.
cecill|Ce logiciel: governed by the CeCILL license under French law.
osl|The module is subject to the Open Software License (OSL 3.0).
public-domain|The author released it under the Unlicense.
unknown|The eclipse was seen in all of the public parks.
unknown|Boost the engine only when the fonts of the display are lit.
unknown|The database is open to the members of the university of the state.
unknown|The python was released into the woods by its owner.
unknown|An artistic portrait of the general hangs in the library.
unknown|Microsoft opened a public school in the city.
unknown|He studied French law and the rules of free trade.
unknown|Licensed under the Harbour Licence, version 1.0.
unknown|The common development of the two towns was agreed upon.
"""
