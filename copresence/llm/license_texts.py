"""The public texts of short software licenses, without their copyright lines; titles; digests of the normalised long ones."""

_AS_IS_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AS_IS_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
_AS_IS_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)

LICENSES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS_ISC,
    "BSD-2-Clause": _BSD_HEAD + _BSD_1 + _BSD_2 + _AS_IS_BSD,
    "BSD-3-Clause": _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _AS_IS_BSD,
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. "
    ) + _AS_IS_ISC,
    "MIT": _MIT_GRANT + (
        ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. "
    ) + _AS_IS_MIT,
    "MIT-0": _MIT_GRANT + ". " + _AS_IS_MIT,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}

#: Titles of short licenses, normalised, without a leading article.
TITLES = (
    "0bsd license", "bsd 2 clause license", "bsd 2 clause simplified license", "bsd 3 clause license", "bsd 3 clause new or revised license", "bsd license",
    "bsd zero clause license", "expat license", "isc license", "isc license isc", "mit license", "mit license mit", "mit no attribution", "mit no attribution license",
    "modified bsd license", "new bsd license", "revised bsd license", "simplified bsd license", "x11 license", "zero clause bsd", "zlib libpng license", "zlib license",
)

#: Digests of the normalised public texts of long licenses, appendices included.
DIGESTS = {
    "Apache-2.0": "7aa35209ad8efaa01b7775d942441730c970af45bc8faff8d0ad1f188add867b",
    "Artistic-1.0-Perl": "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "0fc3eba04a0e2ef782dd290d85630c52cafe619f2e9392c944255b881ea4130e",
    "GFDL-1.3": "868fb11397ac2aeed8c74b4b42bbd9644f0469e4e1ec8dc385ee99c80a4c6aa7",
    "GPL-1.0": "c518dbc42d539fb665a0fc2660c1d7117f706ab08da1b9495a0c4424157e97ce",
    "GPL-2.0": "4488ffb4b6add39cb373aba964cc400f5ac17d920039ece76f11400c5b01e5e5",
    "GPL-3.0": "8f22d2ddca4a1c3ee73f1077f59a161b4fd2f7ae080d2abaf4394ff0c9a2120d",
    "LGPL-2.0": "07ea55842178b65d9e7ee1bbf398dda46d3f1ae7036217e299c0d5ef1eab3649",
    "LGPL-2.1": "2edbc90847a6ddf5651b29a800076db76eb12973e92d3076c52492d9a9b06772",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "cbf8a79979c94b47092c8b5f097c9499b7c33e91ab50216a663f180fbe2ecd1e",
    "MPL-2.0": "c6a506eb968bd2cfbb1ea819736390e6ef797bab6d08beb74875c8a0dbc1d917",
}
