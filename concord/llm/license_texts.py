"""Published license texts and notices, with markup: [[...]] may be left out, {{a|b}} is one of these, {{n}} up to n words."""

# The wording of licenses as published by their stewards, without titles and copyright lines; label, kind, markup.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so"""

_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer."""

_BSD_BINARY = """[[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY {{12}} {{"AS IS"|``AS IS''}} AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{12}}
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND {{12}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_GNU_WARRANTY = """{{6}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {{GNU General Public License|GNU Lesser General Public
License|GNU Affero General Public License}} for more details."""

_GNU_OPTION = """of the License, or (at your option) any later version."""

TEMPLATES = (
    ("mit", "text", f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("mit-0", "text", f"{_MIT_GRANT}. {_AS_IS}"),
    ("json", "text", f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software shall be used for Good, not Evil. {_AS_IS}"),
    ("x11", "text", f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS} Except as contained in this notice, the name of {{{{12}}}} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from {{{{12}}}}"),
    ("bsd-1-clause", "text", f"{_BSD_GRANT} {_BSD_AS_IS}"),
    ("bsd-2-clause", "text", f"{_BSD_GRANT} {_BSD_BINARY} {_BSD_AS_IS}"),
    ("bsd-3-clause", "text", f"{_BSD_GRANT} {_BSD_BINARY} [[3.]] Neither the name of {{{{12}}}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS}"),
    ("bsd-4-clause", "text", f"{_BSD_GRANT} {_BSD_BINARY} [[3.]] All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by {{{{16}}}} [[4.]] Neither the name of {{{{12}}}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS}"),
    ("isc", "text", f"Permission to use, copy, modify, and{{{{/or|}}}} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"),
    ("0bsd", "text", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_AS_IS}"),
    ("zlib", "text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
     Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
     [[1.]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
     [[2.]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. [[3.]] This notice may not be removed or altered from any source distribution."""),
    ("bsl-1.0", "text", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
     and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer,
     must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
     THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
     FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("unlicense", "text", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
     In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
     We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
     FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
     [[For more information, please refer to {{6}}]]"""),
    ("wtfpl", "text", """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
     0. You just DO WHAT THE FUCK YOU WANT TO."""),
    ("postgresql", "text", """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.
     IN NO EVENT SHALL {{12}} BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF {{12}} HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
     {{12}} SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND {{12}} HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS."""),
    ("curl", "text", """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
     THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
     DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise
     to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder."""),
    ("ntp", "text", """Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear in supporting documentation,
     and that the name {{12}} not be used in advertising or publicity pertaining to distribution of the software without specific, written prior permission. {{12}} makes no representations about the suitability this software for any purpose. It is provided "as is" without express or implied warranty."""),
    ("ncsa", "text", f"""{_MIT_GRANT}, subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers. Redistributions in binary form must reproduce the above copyright notice,
     this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution. Neither the names of {{{{24}}}} nor the names of its contributors may be used to endorse or promote products derived from this Software without specific prior written permission.
     THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE CONTRIBUTORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
     WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS WITH THE SOFTWARE."""),
    ("fsfap", "text", """Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty."""),
    ("beerware", "text", """wrote this file. As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return"""),
    # Notices: headers that refer to a license's text.
    ("apache-2.0", "notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at {{12}}
     Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache-2.0", "notice", """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the "License");
     you may not use this file except in compliance with the License. You may obtain a copy of the License at {{12}} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
     See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-2.0", "notice", f"This {{{{program|software|file|library}}}} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; {{{{either version 2 of the License, or (at your option) any later version|version 2 of the License|version 2}}}}. {_GNU_WARRANTY}"),
    ("gpl-3.0", "notice", f"is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, {{{{either version 3 of the License, or (at your option) any later version|version 3 of the License|version 3}}}}. {_GNU_WARRANTY}"),
    ("lgpl-2.1", "notice", f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 {_GNU_OPTION} {_GNU_WARRANTY}"),
    ("lgpl-3.0", "notice", f"is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 {_GNU_OPTION} {_GNU_WARRANTY}"),
    ("agpl-3.0", "notice", f"is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 {_GNU_OPTION} {_GNU_WARRANTY}"),
    ("mpl-2.0", "notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {{8}} [[This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0.]]"""),
    ("epl-2.0", "notice", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at {{8}} [[SPDX-License-Identifier: EPL-2.0]]"""),
    ("cddl-1.0", "notice", """The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License."""),
    ("ofl-1.1", "notice", """This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at {{10}}"""),
    ("cc0-1.0", "notice", """To the extent possible under law, {{12}} has waived all copyright and related or neighboring rights to {{12}}"""),
    ("cc-by", "notice", """This work is licensed under {{a|the}} Creative Commons Attribution {{4.0|3.0|2.5|2.0}} {{International|Unported|Generic}} License"""),
    ("cc-by-sa", "notice", """This work is licensed under {{a|the}} Creative Commons {{Attribution-ShareAlike|Attribution-Share Alike}} {{4.0|3.0|2.5|2.0}} {{International|Unported|Generic}} License"""),
    ("cc-by-nc", "notice", """This work is licensed under {{a|the}} Creative Commons {{Attribution-NonCommercial|Attribution-Noncommercial}} {{4.0|3.0|2.5|2.0}} {{International|Unported|Generic}} License"""),
    ("cc-by-nd", "notice", """This work is licensed under {{a|the}} Creative Commons {{Attribution-NoDerivatives|Attribution-NoDerivs|Attribution-No Derivative Works}} {{4.0|3.0|2.5|2.0}} {{International|Unported|Generic}} License"""),
    # Notices: short statements that name a license.
    ("mit", "notice", "{{released|licensed|distributed}} under the [[terms of the]] MIT license"),
    ("apache", "notice", "{{released|licensed|distributed}} under the [[terms of the]] Apache License[[, Version]] {{2.0|2}}"),
    ("gpl", "notice", "{{released|licensed|distributed}} under the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]] [[version]] {{3.0|2.0|3|2}}"),
    ("lgpl", "notice", "GNU {{Lesser|Library}} General Public License"),
    ("agpl", "notice", "GNU Affero General Public License"),
    ("cc-by", "notice", "{{released|licensed|distributed}} under [[a]] [[the]] {{CC|Creative Commons}} {{BY|Attribution}} {{4.0|3.0}}"),
    ("cc-by-nc", "notice", "{{released|licensed|distributed}} under [[a]] [[the]] {{CC|Creative Commons}} {{BY|Attribution}} {{NC|NonCommercial}} {{4.0|3.0}}"),
    ("cc-by-sa", "notice", "{{released|licensed|distributed}} under [[a]] [[the]] {{CC|Creative Commons}} {{BY|Attribution}} {{SA|ShareAlike}} {{4.0|3.0}}"),
    ("cc-by-nd", "notice", "{{released|licensed|distributed}} under [[a]] [[the]] {{CC|Creative Commons}} {{BY|Attribution}} {{ND|NoDerivatives}} {{4.0|3.0}}"),
)
