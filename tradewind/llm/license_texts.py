"""Clauses of well-known licences in their public wording, as templates of the license scan.

Fixed values: each clause has the licence's label, its text in lower-case words
without punctuation, and key phrases without which it doesn't count.
"""

from __future__ import annotations

#: Fixed values: (label, text, key phrases).
CLAUSES = (
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal
        in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
        software and to permit persons to whom the software is furnished to do so subject to the following conditions""", ("free of charge", "without restriction")),
    ("mit", """the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software""", ("permission notice",)),
    ("mit", """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a
        particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of
        contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""", ("as is", "authors or copyright holders")),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met""", ("source and binary forms",)),
    ("bsd", """redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer""", ("source code must retain",)),
    ("bsd", """redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution""", ("binary form must reproduce",)),
    ("bsd-3", """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
        prior written permission""", ("endorse or promote",)),
    ("bsd", """this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of
        merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental
        special exemplary or consequential damages""", ("as is", "consequential damages")),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this
        permission notice appear in all copies""", ("with or without fee",)),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this
        software""", ("as is", "held liable")),
    ("zlib", """permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the
        following restrictions""", ("redistribute it freely",)),
    ("zlib", """the origin of this software must not be misrepresented you must not claim that you wrote the original software""", ("must not be misrepresented",)),
    ("apache-2", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license
        at""", ("apache license", "compliance with the license")),
    ("apache-2", """unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions
        of any kind either express or implied see the license for the specific language governing permissions and limitations under the license""", ("as is basis",)),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation""", ("free software", "general public license")),
    ("gpl-2", """either version 2 of the license or at your option any later version""", ("version 2",)),
    ("gpl-3", """either version 3 of the license or at your option any later version""", ("version 3",)),
    ("gpl", """this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular
        purpose see the gnu general public license for more details""", ("hope that it will be useful",)),
    ("lgpl", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software
        foundation""", ("lesser general public",)),
    ("agpl", """you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation""", ("affero general public",)),
    ("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at""", ("mozilla public license",)),
    ("epl-2", """this program and the accompanying materials are made available under the terms of the eclipse public license 2 0""", ("eclipse public license",)),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in
        source code form or as a compiled binary for any purpose commercial or non commercial and by any means""", ("public domain",)),
    ("bsl", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the
        software to use reproduce display distribute execute and transmit the software""", ("person or organization",)),
    ("cc0", """the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law""", ("public domain",)),
    ("cc-by", """you are free to share copy and redistribute the material in any medium or format adapt remix transform and build upon the material for any purpose even
        commercially""", ("remix transform",)),
    ("cc-by", """this work is licensed under a creative commons attribution 4 0 international license""", ("creative commons attribution",)),
    ("cc-by-sa", """this work is licensed under a creative commons attribution sharealike 4 0 international license""", ("attribution sharealike",)),
    ("cc-by-nc", """this work is licensed under a creative commons attribution noncommercial 4 0 international license""", ("attribution noncommercial",)),
    ("wtfpl", """everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed""", ("changing it is allowed",)),
)
