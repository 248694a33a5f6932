"""Public license notices, headings and bodies, the default templates of the license scan."""

TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "distributed under the MIT License",
        "under the terms of the MIT License",
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "under the terms of the Apache License, Version 2.0",
        "Released under the Apache 2.0 License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide,
        non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of,
        publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or
        Object form.""",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License v2.0",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version.""",
    ),
    "LGPL-2.1": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "Licensed under the GNU Lesser General Public License v2.1",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public
        License for more details.""",
    ),
    "LGPL-3.0": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Licensed under the GNU Lesser General Public License v3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public
        License for more details.""",
    ),
    "AGPL-3.0": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "Licensed under the GNU Affero General Public License v3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public
        License for more details.""",
    ),
    "GFDL-1.3": (
        """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation
        License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no
        Front-Cover Texts, and no Back-Cover Texts.""",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.""",
        "Released under the ISC License.",
        "Licensed under the ISC License.",
    ),
    "0BSD": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.""",
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software.""",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software.""",
    ),
    "WTFPL": (
        """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it
        is allowed as long as the name is changed.""",
    ),
    "EPL-1.0": (
        """All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse
        Public License v1.0 which accompanies this distribution, and is available at
        http://www.eclipse.org/legal/epl-v10.html""",
    ),
    "EPL-2.0": (
        "Eclipse Public License - v 2.0",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
        which is available at https://www.eclipse.org/legal/epl-2.0/""",
    ),
    "CDDL-1.0": (
        "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",
        """The contents of this file are subject to the terms of the Common Development and Distribution License (the
        "License"). You may not use this file except in compliance with the License.""",
    ),
    "Artistic-2.0": (
        """Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not
        allowed. This license establishes the terms under which a given free software Package may be copied, modified,
        distributed, and/or redistributed.""",
    ),
    "EUPL-1.2": (
        "Licensed under the EUPL, Version 1.2",
        "European Union Public Licence v. 1.2",
    ),
    "MS-PL": (
        "Microsoft Public License (Ms-PL) This license governs use of the accompanying software.",
    ),
    "OFL-1.1": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    ),
    "ODbL-1.0": (
        "made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/",
    ),
    "PostgreSQL": (
        """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and
        without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the
        following two paragraphs appear in all copies.""",
    ),
    "CC0-1.0": (
        "dedicated to the public domain under CC0 1.0",
        "Creative Commons CC0 1.0 Universal Public Domain Dedication",
        """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or
        her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent
        allowed by law.""",
    ),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "Licensed under the Mozilla Public License 2.0",
        "Mozilla Public License Version 2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
        or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-ND-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-3.0": (
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    ),
    "CC-BY-SA-3.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    ),
}
