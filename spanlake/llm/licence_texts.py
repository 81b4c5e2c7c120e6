"""Public licence notices that the licence classifier learns from and compares with."""

from __future__ import annotations

#: How notices name a licence, and its identifiers.
NAMES = {
    "mit": ("MIT License",),
    "apache": ("Apache License, Version 2.0", "Apache License 2.0"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL v3", "GPLv3"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL v3", "LGPLv3"),
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License"),
    "isc": ("ISC License",),
    "mpl": ("Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License"),
    "epl": ("Eclipse Public License 2.0", "Eclipse Public License, version 1.0", "Eclipse Public License"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nd": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-nc-sa": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc-by-nc-nd": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "public-domain": ("CC0 1.0 Universal", "Unlicense"),
    "reserved": (),
}
IDENTIFIERS = {
    "mit": ("MIT",),
    "apache": ("Apache-2.0",),
    "gpl": ("GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0+"),
    "lgpl": ("LGPL-2.1-only", "LGPL-3.0-or-later"),
    "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "bsd": ("BSD-3-Clause", "BSD-2-Clause"),
    "isc": ("ISC",),
    "mpl": ("MPL-2.0",),
    "epl": ("EPL-2.0", "EPL-1.0"),
    "cc-by": ("CC-BY-4.0",),
    "cc-by-sa": ("CC-BY-SA-4.0",),
    "cc-by-nd": ("CC-BY-ND-4.0",),
    "cc-by-nc": ("CC-BY-NC-4.0",),
    "cc-by-nc-sa": ("CC-BY-NC-SA-4.0",),
    "cc-by-nc-nd": ("CC-BY-NC-ND-4.0",),
    "public-domain": ("CC0-1.0", "Unlicense"),
    "reserved": (),
}
FRAMES = ("{}", "Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This project is distributed under the terms of the {}.")
SPDX = "SPDX-License-Identifier: {}"

#: Paragraphs of the licences and of the notices they ask for.
PARAGRAPHS = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "apache": (
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl": (
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.',
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This work has been dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0.",
    ),
    "reserved": (
        "All rights reserved.",
        "Copyright, all rights reserved. No part of this work may be reproduced without permission.",
        "No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ),
}

#: Other licences. The classifier learns its unknown class from the first ones; the second ones only calibrate it.
OTHER_NAMES = (
    ("Artistic License 2.0", "zlib License", "Common Development and Distribution License", "European Union Public Licence, version 1.2", "SIL Open Font License, Version 1.1", "Do What The Fuck You Want To Public License", "Python Software Foundation License", "Open Database License", "commercial license agreement", "license of the author"),
    ("Boost Software License, Version 1.0", "Microsoft Public License", "Academic Free License v3.0", "PostgreSQL License", "Open Software License 3.0", "Business Source License 1.1", "PHP License, version 3.01", "Server Side Public License", "end user license agreement", "license of the publisher"),
)
OTHER_IDENTIFIERS = (("Artistic-2.0", "Zlib", "CDDL-1.0", "EUPL-1.2", "OFL-1.1", "WTFPL"), ("BSL-1.0", "MS-PL", "AFL-3.0", "PostgreSQL", "OSL-3.0", "SSPL-1.0"))
OTHER_PARAGRAPHS = (
    (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
        "The Licensor hereby grants You a worldwide, royalty-free, non-exclusive license for the duration of copyright in the Original Work",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "The fonts and derivatives, however, cannot be released under any other type of license.",
        "See the LICENSE file for license rights and limitations.",
    ),
    (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
        "For the full license terms see the file COPYING.",
    ),
)
#: Sentences without a licence.
PLAIN = (
    "the city council granted permission to use the public garden",
    "a driver must carry a licence at all times",
    "the general said that the work is under way",
    "version two of the story is free of charge for any person",
    "he may not leave the file in the source of the river",
    "the software copies all files to the following library",
    "they part at the common and read the later version",
    "rights and conditions of workers under law",
    "the minister of public works lost his fishing licence in march",
    "all rights of the villagers were heard by the court",
    "the museum keeps a copy of every publication in the archive",
    "she asked the author for permission and a copy of the letter",
)
