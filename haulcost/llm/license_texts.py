"""Sentences by which licence families declare themselves.

Fixed values: wordings of the licences and of the usual notices.
"""

TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "Distributed under the MIT license",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "the Apache 2.0 license",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU GPL v3",
        "GNU GPL v2",
        "GNU GPLv3",
        "GNU GPLv2",
        "SPDX-License-Identifier: GPL-3.0",
        "SPDX-License-Identifier: GPL-2.0",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "GNU LGPL v3",
        "GNU LGPL v2.1",
        "SPDX-License-Identifier: LGPL-3.0",
        "SPDX-License-Identifier: LGPL-2.1",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
        "GNU AGPL v3",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "SPDX-License-Identifier: ISC",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Creative Commons Attribution-ShareAlike 4.0 International",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Creative Commons Attribution-NonCommercial 4.0 International",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Proprietary": [
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "This document is confidential and proprietary and may not be copied or disclosed without permission.",
    ],
}

#: Declarations of licences that are in no family above, from which ``unknown`` is learned.
UNLISTED = [
    "Licensed under the European Union Public Licence, version 1.2.",
    "This package is released under the Artistic License 2.0.",
    "Distributed under the terms of the Python Software Foundation License, version 2.",
    "This font software is licensed under the SIL Open Font License, version 1.1.",
    "This work is licensed under the Microsoft Public License.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "This program is released under the Do What The Fuck You Want To Public License, version 2.",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
    "Licensed under the Academic Free License version 3.0.",
    "Released under the PostgreSQL License.",
    "This database is made available under the Open Database License.",
    "This software is governed by the CeCILL license under French law.",
    "Use, modification and distribution are subject to the Open Software License, version 3.0.",
    "Released under the terms of the Ruby License.",
    "This material may be distributed only subject to the terms set forth in the Open Publication License.",
    "This software may be used and distributed under the terms of its own license.",
    "You may use, copy and alter this software freely, provided that this notice is kept in all copies.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications.",
]

#: Sentences about licences that declare none.
ABOUT = [
    "The driver must renew the license before the end of the year.",
    "The license of the restaurant was granted by the city council.",
    "Copyright law protects works of art for many years.",
    "The general public was free to use the library under certain conditions.",
    "Permission to build was granted without restriction.",
    "The software is distributed to all offices of the foundation.",
    "A new version of the program was released in March.",
    "The work of the foundation is free of charge to any person.",
    "He read the terms of the agreement and the following conditions.",
    "You may not use this entrance without written permission.",
    "Public domain stories are read in the village under the apache trees.",
    "The publisher has licensed the rights to this work to another company.",
    "All rights reserved.",
    "Copyright 2019 by the authors. All rights reserved.",
    "He studied at the MIT and drove under the bridge of the city.",
    "The version of the story that was released under the old government was free.",
    "The terms of the contract were open to the public.",
]
