"""License texts and notices to look for, by SPDX-like name. Several forms of one license have a mark behind '#'.

Whole texts are the public ones in the folder `licenses`, without their appendices on how to apply them. One-line forms
are made by rule from names and versions. The GNU Affero text is the GNU General one of version 3 under its own name
with its own section 13.
"""

from __future__ import annotations

import re
from pathlib import Path

# --- fixed values: public license notices, names and versions ---
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_NOTICE = """, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software."""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_NOTICES = {
    "Apache-2.0#2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    "MIT#1": "Released under the MIT License.",
    "MIT#2": f"{_MIT_GRANT}{_MIT_NOTICE} {_MIT_DISCLAIMER}",
    "MIT#3": "Released under an MIT license.",
    "MIT#4": "This project is licensed under the MIT License.",
    "MIT-0": f"{_MIT_GRANT}. {_MIT_DISCLAIMER}",
    "BSD-2-Clause": f"{_BSD} {_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}",
    "BSD-4-Clause": f"""{_BSD} All advertising materials mentioning features or use of this software must display the following acknowledgement: This product
includes software developed by the organization. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. {_DISCLAIMER}""",
    "ISC": f"{_ISC_GRANT}{_ISC_NOTICE} {_ISC_DISCLAIMER}",
    "0BSD": f"{_ISC_GRANT}. {_ISC_DISCLAIMER}",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or
altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this
entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or
in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
a source language processor.""",
    "MPL-2.0#1": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-2.0#1": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/""",
    "Unlicense#1": "This is free and unencumbered software released into the public domain.",
    "Unlicense#text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In
jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public
domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "CC0-1.0#1": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is published under CC0 1.0 Universal.",
}
#: SPDX prefix, name and versions of the GNU licenses.
_GNU = [("GPL", "General", "1 2 3"), ("LGPL", "Library General", "2"), ("LGPL", "Lesser General", "2.1 3"), ("AGPL", "Affero General", "3"), ("GFDL", "Free Documentation", "1.1 1.2 1.3")]
#: Abbreviation and name of the Creative Commons licenses.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = """Apache-1.0 Apache-1.1 Apache-2.0 MIT MIT-0 BSD-2-Clause BSD-3-Clause BSD-4-Clause ISC 0BSD GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0
GFDL-1.1 GFDL-1.2 GFDL-1.3 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 BSL-1.0 Zlib Unlicense CC0-1.0 Artistic-1.0 Artistic-2.0 WTFPL""".split()
_AFFERO_13 = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the
Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such
interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no
charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any
work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of
this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General Public License into a single
combined work, and to convey the resulting work. The terms of this License will continue to apply to the part which is the covered work, but the work with which
it is combined will remain governed by version 3 of the GNU General Public License. """
_TEXTS = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Artistic-1.0-Perl": "Artistic"}
#: Words that tell one license from another, and words that turn a grant round; numbers decide too.
NAMES = frozenset(
    """affero agpl apache artistic attribution boost bsd by cc cc0 clause commons creative documentation eclipse epl gfdl gnu gpl isc lesser lgpl library mit mozilla mpl
    nc nd noncommercial noderivatives noderivs sa sharealike unlicense wtfpl zlib""".split()
)
TURNS = frozenset("except non noncommercial not never no unless academic".split())


def _dotted(version: str) -> str:
    return version if "." in version else f"{version}.0"


def _whole(file: str) -> str:
    text = (Path(__file__).parent / "licenses" / f"{file}.txt").read_text(encoding="utf-8", errors="replace")
    return re.split(r"How to Apply These Terms|APPENDIX: How to apply|(?i:exhibit a) -", text)[0]


def templates() -> dict[str, str]:
    """Name to text of every license form."""
    out = dict(_NOTICES)
    for v in ("1.0", "1.1", "2.0"):
        out[f"Apache-{v}#1"] = f"Licensed under the Apache License, Version {v}."
    for short, name, versions in _GNU:
        kind = "License" if short == "GFDL" else "Public License"
        thing = "library" if "L" in short[:1] else "program"
        for v in versions.split():
            full = f"{short}-{_dotted(v)}"
            out[f"{full}#1"] = f"This work is licensed under the GNU {name} {kind}, version {v}."
            out[f"{full}#3"] = f"licensed under the GNU {name} {kind} v{_dotted(v)}"
            if short != "GFDL":
                out[f"{full}#2"] = f"""This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published
by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This {thing} is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU {name} Public License for more details."""
    for short, name in _CC.items():
        for v, where in (("4.0", "International"), ("3.0", "Unported")):
            out[f"CC-{short}-{v}"] = f"Licensed under CC {short} {v}."
            out[f"CC-{short}-{v}#2"] = f"This work is licensed under a Creative Commons {name} {v} {where} License."
            out[f"CC-{short}-{v}#3"] = f"https://creativecommons.org/licenses/{short.lower()}/{v}/"
    for name in [*_SPDX, *(f"CC-{s}-{v}" for s in _CC for v in ("3.0", "4.0"))]:
        out[f"{name}#spdx"] = f"SPDX-License-Identifier: {name}"
    for name, file in _TEXTS.items():
        out[f"{name}#text"] = _whole(file)
    gpl = re.sub(r"13\. Use with the GNU Affero.*?(?=14\. Revised Versions)", "SECTION13 ", out["GPL-3.0#text"], flags=re.S)
    gpl = re.sub(r"(?i)GNU General Public License", "GNU Affero General Public License", gpl).replace("29 June 2007", "19 November 2007")
    out["AGPL-3.0#text"] = gpl.replace("SECTION13 ", _AFFERO_13)
    return out
