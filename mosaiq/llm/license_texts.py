"""Fixed values, by SPDX identifier: wording of short, widely used licences and notices, headings, digests of long ones."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def _gnu_notice(name: str, version: str, last: str) -> str:
    """The notice that the GNU licences ask for at the top of a file."""
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this program. If not, see {last}.
"""


#: Each licence in the wordings that are in use.
TEXTS = {
    "0BSD": [f"{_ISC_GRANT}.\n\n{_ISC_TAIL}"],
    "AGPL-3.0-or-later": [_gnu_notice("Affero General Public License", "3", "<https://www.gnu.org/licenses/>")],
    "Apache-2.0": [_APACHE_NOTICE],
    "BSD-2-Clause": [f"{_BSD_HEAD}{_BSD_TAIL}"],
    "BSD-3-Clause": [f"{_BSD_HEAD}{third}{_BSD_TAIL}" for third in (_BSD_THIRD, _BSD_THIRD.replace("the copyright holder", "the author"))],
    "BSL-1.0": [_BOOST],
    "GPL-2.0-or-later": [_gnu_notice("General Public License", "2", "<https://www.gnu.org/licenses/>")],
    "GPL-3.0-or-later": [_gnu_notice("General Public License", "3", "<https://www.gnu.org/licenses/>")],
    "ISC": [f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}"],
    "LGPL-3.0-or-later": [_gnu_notice("Lesser General Public License", "3", "<https://www.gnu.org/licenses/>")],
    "MIT": [_MIT_GRANT],
    "MPL-2.0": [_MPL_NOTICE],
    "Unlicense": [_UNLICENSE, _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org/>\n"],
    "Zlib": [_ZLIB],
}
#: Headings that stand over these texts; the empty one for none.
HEADINGS = {
    "0BSD": ("", "BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD License"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("", "BSD License", "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "BSL-1.0": ("", "Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
    "ISC": ("", "ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "Unlicense": ("", "The Unlicense", "Unlicense"),
    "Zlib": ("", "zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}
#: Digests of the canonical forms of long licences: whole, without what follows their terms, and without heading.
DIGESTS = {
    "Apache-2.0": [
        "f213b407df637bc294997de205aecfc82e06a5e4ef6d75893ec348ca26dd13c2",
        "24ba171ebbbd6eca7b8e3ff38b568cbcf55acee49ca31ff39168122f6ddc98fe",
        "d4660dd61c430428a5a8a94b10068fbbbf015ab69577e38e518d54f2a6b291c6",
        "908717af6244fb50b0f7064657a7e447924c13b49c9b65b3806d91d7aebbd089",
        "1443f4193376413d0b8aa043ff4b008b8dd3f55f141f2a669219dae69a0f6bfa",
        "ccb73d7e7b8726491a5f24f8f36dc6cddd2fe09a6e884b299297c0bdf9dcd35d",
    ],
    "Artistic-1.0-Perl": [
        "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49",
        "605e60098b41000a8ac1cb87343cfd8399e2ac1e421e6d7cd712adfc7e27b7bf",
    ],
    "BSD-3-Clause": [
        "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060",
    ],
    "CC0-1.0": [
        "888ab175b43ed137ae3c3f8f32a1f0e1677fe31f7a9f09890c39b11b1934ad6c",
        "2cd02f433dbf075bc3fff84de8189496bef56bc76127b1387c1135a83e6d5638",
    ],
    "GFDL-1.2": [
        "11b443626816c538e555b7fb60eaba9f2a83a9ecb67ad4a1663e07c118b8e550",
        "7b234ba9f183c4a0d932085ef6b6607bb81c74b839e52da338fb370e9fb8cd2f",
    ],
    "GFDL-1.3": [
        "cc84a6c6a2b84e8cde0619ed37d987e1a9b39e53ddcaf34f4735e2138dfe6e4a",
        "be763a51dfa78302969ed84de089aae00c43ad9864dcb776bb5302d4f653b836",
    ],
    "GPL-1.0": [
        "ac910954c3184907f3947de0193b0169b8c69656ff2de7f3330438f6ba4fb746",
        "0460830f1601ab5f615dd93818221b48820590af661686bdf540c70fe3d696a4",
        "e865a0dda2da3969652b87fd53fdbacbc9c971447325f465df48971826e5f97c",
        "8a15d1f8968f92c550ed7ddf8912656ae7ceb86844cb6a8707cb8dfbdba2e261",
        "1f1b158f421025acfb75cdb706aa534ca686183951ec7c2173694b1963504f74",
        "0b0546882fd2c4601d8ffc4fc81d6074e2853fe08470e608fff295b01e1efcce",
    ],
    "GPL-2.0": [
        "2e8e378a3d24393c0f3fd1439ffbe84e750886c09715e622426a6a0e54fa1bee",
        "80edaf5771a2ca5e7df6a5c023beb15391e60cf1bbae81a82600bb184fecef39",
        "724499132592c4e4c95c8d0a0a79e0045822f797839536a7338312694e3341bc",
        "7e4d7730132c9ab892398f5a951a2a2a018508f543b9dc3db11543662144fa6f",
        "d4680d1246cc2a778d285b3a2522ecfda128e6214f2d9c69a5fa664f5a64d280",
        "9332a9cedf02da1c7d2c3159a0c2574767ce0b059cfbd63d68ec13215f39123b",
    ],
    "GPL-3.0": [
        "3695e90f7fe4b461853cec533de5675ab2b6b1fcafcb504d6c64ded76f675d64",
        "8c24ccf35998bd73317aa0801f6e6cbd865514baf55f246a48a8e890d1abc3d1",
        "a7d16b580457c566303df373fd362c5bfbfbc013734bed4e4cf732a569a5598e",
        "fed4241aa4a095db62c00d728f8cb62a59bba59ca924dcaade64b714daf9c536",
        "dd8b210925ce40dbe52f4c7eac2cc703150db11a78acf844b4a93e9db22a2d3c",
        "4ee55f106a4606c43d942d8728947777455ea45e81dc6b06e4a18d43d2db72f1",
    ],
    "LGPL-2.0": [
        "4a1b1cb15d45262f049457ae26945909d0e5af93e2e3fb5de82c9f72ac6bebe2",
        "2894b2cb46a2c83844eec54a57337498c55bc0779fe2dbdd14bc94a567a3c32e",
        "9445838f80c534db1f71155f4c93f1464bf680d2a091792f3f2146f5cefef806",
        "55f6bdd1b14f3fc01a515e60f532189425d111945726f535271adac6cad6dfa6",
        "7a5ff230231196b7b55ae8f9bb04efb855fd1c22e65e759f6125c7b94b4e2ae1",
        "86dfaf3c0145117a786744c9d83431c874956f8c3993421e41cf76d23a79908f",
    ],
    "LGPL-2.1": [
        "f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98",
        "303c35384a2d8ff561e8480f4d8bc87bd79ea2d92d62ba0b24d22e2c1f88f1e3",
        "70a277553f5f0e974016dfc6aed9adda07c554792c5f1f3d75acb63053de3f89",
        "ebb84e714fc2fd2c50451bf6e62904af0d065e1e2755c4e86e9a6d1884929010",
        "ac21c875cd8443510137ced6ef39c16ea093ce195d3efd8cbdac601448227477",
        "3d990939691f7da89997ef1be7d839ef937d280b62ab0b8e2d257d6dd8d8416c",
    ],
    "LGPL-3.0": [
        "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",
        "599e236ddcb69302837061770c9ad5f7b2e9908bdde58f1d38401c54304f7934",
    ],
    "MPL-1.1": [
        "1c85bd9fce28a9b0073be5f8e540b66f8079d1f62092c698ea7369263ac53721",
    ],
    "MPL-2.0": [
        "2dca1486b3652fa5c4043c17f6755fcb372a3ea6a1721c5c6dcf83806278116b",
        "d84e11c7096940bbed9f08b5ee9805bd158eaad9fccaac78f77eea8069d867b4",
    ],
}
