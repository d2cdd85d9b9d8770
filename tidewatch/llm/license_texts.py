"""Usual notices of public licenses, and short license texts in overlapping pieces."""

from __future__ import annotations

#: Words of a piece of a longer text; pieces overlap by half.
PIECE = 24

_CC = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike",
       "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_GNU = {"gpl": ("General Public License", "1 2 3"), "lgpl": ("Lesser General Public License", "2.1 3"),
        "lgpl-library": ("Library General Public License", "2"), "agpl": ("Affero General Public License", "1 3"),
        "gfdl": ("Free Documentation License", "1.1 1.2 1.3")}
#: Notices "licensed under the ..." and their short forms.
_NAMED = {
    "apache-1.1": "Apache License, Version 1.1", "apache-2.0": "Apache License, Version 2.0", "mit": "MIT License",
    "bsd": "BSD License", "bsd-2-clause": "BSD 2-Clause License", "bsd-3-clause": "BSD 3-Clause License",
    "simplified bsd": "Simplified BSD License", "new bsd": "New BSD License", "isc": "ISC License",
    "epl-1.0": "Eclipse Public License 1.0", "epl-2.0": "Eclipse Public License 2.0",
    "epl v1.0": "Eclipse Public License v1.0", "epl v2.0": "Eclipse Public License v2.0",
    "mpl-1.1": "Mozilla Public License 1.1", "mpl-2.0": "Mozilla Public License 2.0",
    "mpl v2.0": "Mozilla Public License, v. 2.0", "mpl version 2.0": "Mozilla Public License Version 2.0",
    "cddl-1.0": "Common Development and Distribution License 1.0", "artistic-2.0": "Artistic License 2.0",
    "bsl-1.0": "Boost Software License, Version 1.0", "zlib": "zlib License", "eupl-1.2": "European Union Public Licence 1.2",
    "odbl-1.0": "Open Database License", "odc-by-1.0": "Open Data Commons Attribution License",
    "psf-2.0": "Python Software Foundation License", "ofl-1.1": "SIL Open Font License, Version 1.1",
}
_SPDX = """0BSD AFL-3.0 AGPL-1.0-only AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0
Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC0-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0
CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2
GFDL-1.2-or-later GFDL-1.3-or-later GPL-1.0-only GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only
GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only
LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PSF-2.0 PostgreSQL Ruby Unlicense
UPL-1.0 Vim W3C WTFPL X11 Zlib"""

_RIGHTS = {
    "all rights reserved": "All rights reserved.",
    "some rights reserved": "Some rights reserved.",
    "no reproduction": "No part of this publication may be reproduced, distributed, or transmitted in any form or by any "
                       "means, without the prior written permission of the publisher",
    "no part of this book": "No part of this book may be reproduced in any form without permission in writing from the publisher",
    "not without permission": "may not be reproduced without the express written consent of",
    "may not be published": "This material may not be published, broadcast, rewritten, or redistributed.",
    "public domain": "This work is in the public domain.",
    "released into the public domain": "released into the public domain",
    "cc0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                  "this work",
    "cc0 dedication": "CC0 1.0 Universal Public Domain Dedication",
    "wikipedia": "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mit-style": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "wtfpl": "Do What The Fuck You Want To Public License",
    "mpl-2.0 file": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl materials": "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                     "License",
    "gfdl permission": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
                       "Documentation License",
}

_TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd": """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the
copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
    "apache-2.0": """Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License.""",
    "gpl": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
}


def pieces(text: str, size: int = PIECE) -> dict[int, str]:
    """The text in pieces of ``size`` words by the number of their first word; the last one ends with the text."""
    words = text.split()
    starts = [*range(0, max(1, len(words) - size), size // 2), max(0, len(words) - size)]
    return {k: " ".join(words[k:k + size]) for k in sorted(set(starts))}


def _notices() -> dict[str, str]:
    found = {}
    for short, long in _CC.items():
        for version, kind in _CC_VERSIONS.items():
            name = f"cc-{short.lower()}-{version}"
            found[f"{name} short"] = f"licensed under CC {short} {version}"
            found[f"{name} notice"] = f"licensed under a Creative Commons {long} {version} {kind} License"
            found[f"{name} plain"] = f"Creative Commons {long} {version}"
        found[f"cc-{short.lower()} unversioned"] = f"licensed under a Creative Commons {long} License"
    for short, (long, versions) in _GNU.items():
        for v in versions.split():
            found[f"{short}-{v} notice"] = f"licensed under the GNU {long}, version {v}"
            found[f"{short}-{v} v"] = f"licensed under the GNU {long} v{v}"
            found[f"{short}-{v} v.0"] = f"licensed under the GNU {long} v{v}.0"
            found[f"{short}-{v} terms"] = f"under the terms of the GNU {long} version {v}"
        found[f"{short} unversioned"] = f"under the terms of the GNU {long} as published by the Free Software Foundation"
    for name, long in _NAMED.items():
        found[f"{name} licensed"] = f"licensed under the {long}"
        found[f"{name} released"] = f"released under the {long}"
        found[f"{name} terms"] = f"under the terms of the {long}"
    for name in _SPDX.split():
        found[f"spdx {name}"] = f"SPDX-License-Identifier: {name}"
    for name, text in _TEXTS.items():
        found |= {f"{name} text, word {k}": piece for k, piece in pieces(text).items()}
    return found | _RIGHTS


NOTICES = _notices()
