"""Known licence texts and notices, as (licence id, text)."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

ZERO_BSD = ISC.replace(
    ", provided that the above copyright notice and this permission notice appear in all copies", "")

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""

APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""

MIT_0 = MIT.replace(""", subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.""", ".")

BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

BSD_3 = BSD_2.replace("""THIS SOFTWARE IS PROVIDED BY""", """3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written
permission.

THIS SOFTWARE IS PROVIDED BY""")

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

UNLICENSE_LINK = "For more information, please refer to <https://unlicense.org>"

BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: Licence id, its identifiers besides the id itself, its names in notices.
NAMES = [
    ("MIT", [], ["MIT License", "MIT"]),
    ("MIT-0", [], ["MIT No Attribution License"]),
    ("ISC", [], ["ISC License"]),
    ("0BSD", [], ["BSD Zero Clause License", "Zero-Clause BSD"]),
    ("Zlib", [], ["zlib License"]),
    ("BSD-2-Clause", [], ["BSD 2-Clause License", "Simplified BSD License"]),
    ("BSD-3-Clause", [], ["BSD 3-Clause License", "New BSD License", "Modified BSD License"]),
    ("Apache-2.0", [], ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"]),
    ("MPL-2.0", [], ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"]),
    ("GPL-2.0", ["GPL-2.0-only", "GPL-2.0-or-later"], ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2"]),
    ("GPL-3.0", ["GPL-3.0-only", "GPL-3.0-or-later"], ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3"]),
    ("LGPL-2.1", ["LGPL-2.1-only", "LGPL-2.1-or-later"], ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"]),
    ("LGPL-3.0", ["LGPL-3.0-only", "LGPL-3.0-or-later"], ["GNU Lesser General Public License, version 3", "GNU LGPL v3"]),
    ("AGPL-3.0", ["AGPL-3.0-only", "AGPL-3.0-or-later"], ["GNU Affero General Public License, version 3", "GNU AGPL v3"]),
    ("EPL-1.0", [], ["Eclipse Public License 1.0"]),
    ("EPL-2.0", [], ["Eclipse Public License 2.0"]),
    ("CDDL-1.0", [], ["Common Development and Distribution License 1.0"]),
    ("EUPL-1.2", [], ["European Union Public Licence 1.2"]),
    ("BSL-1.0", [], ["Boost Software License 1.0", "Boost Software License, Version 1.0"]),
    ("Artistic-2.0", [], ["Artistic License 2.0"]),
    ("PostgreSQL", [], ["PostgreSQL License"]),
    ("Unlicense", [], ["Unlicense"]),
    ("WTFPL", [], []),
    ("CC0-1.0", [], ["CC0 1.0", "CC0 1.0 Universal"]),
    ("CC-BY-4.0", [], ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-3.0", [], ["CC BY 3.0"]),
    ("CC-BY-SA-4.0", [], ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC-BY-SA-3.0", [], ["CC BY-SA 3.0"]),
    ("CC-BY-NC-4.0", [], ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC-BY-ND-4.0", [], ["CC BY-ND 4.0"]),
    ("CC-BY-NC-SA-4.0", [], ["CC BY-NC-SA 4.0"]),
    ("CC-BY-NC-ND-4.0", [], ["CC BY-NC-ND 4.0"]),
    ("OFL-1.1", [], ["SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"]),
]

#: Notices made of every name, with and without an article.
NOTICES = [
    "Licensed under {name}.", "Released under {name}.", "Distributed under {name}.", "This work is licensed under {name}.",
    "This project is licensed under {name}.", "This software is licensed under {name}.", "This file is licensed under {name}.",
]


def notices() -> list[tuple[str, str]]:
    """(licence id, notice): identifier lines and sentences, by rule from ``NAMES``."""
    found = [(license, f"SPDX-License-Identifier: {spdx}") for license, other, _ in NAMES for spdx in (license, *other)]
    return found + [
        (license, notice.format(name=article + name))
        for license, _, names in NAMES for name in names for notice in NOTICES for article in ("", "the ")]


KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", ZERO_BSD),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("MIT-0", MIT_0),
    ("MIT-0", "MIT No Attribution\n\n" + MIT_0),
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_3),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE + "\n\n" + UNLICENSE_LINK),
    ("BSL-1.0", BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + BOOST),
    ("MPL-2.0", MPL_HEADER),
    *notices(),
]

#: Equivalent spellings after normalisation of case and punctuation: (words, standard words).
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("https", "http"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
]
