"""License scans by the Dice coefficient over word bigrams (DataFrame functions only).

A document's lines, sentences, paragraphs and its whole text are normalised (lower-cased
words of letters and digits) and compared with license templates. The Dice coefficient
2 * shared / (a + b) of two bigram sets can reach THRESHOLD only if
b * t / (2 - t) <= a <= b * (2 - t) / t, so the size of a unit rules out most templates
before any set is intersected. A unit that reaches it shares at least b * t / (2 - t) of a
template's b bigrams; words chosen so that more than the rest of the bigrams hold one of
them must therefore occur in it, and texts and units without such a word are passed over
without loss. Templates are a fixed list of a few kilobytes, part of the plan; nothing is
shuffled.

Defined results: null and empty texts match nothing; a unit of fewer than two words has
no bigrams; the best template of a unit is the one of the highest coefficient, ties go
to the first id; rows are scanned one by one; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty

THRESHOLD = 0.8
SENTENCE_END = r"[.!?]+\s+"

# The notices that are looked for, by SPDX identifier. Of long licences these are the notices that
# stand in files, of short ones the paragraphs that tell them from others; whole texts are found by their paragraphs.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
    ],
    "Apache-1.1": [
        "The end-user documentation included with the redistribution, if any, must include the following acknowledgment: "
        "This product includes software developed by the Apache Software Foundation (http://www.apache.org/).",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License version 2 as published by the Free Software Foundation.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ],
    "GFDL-1.3": [
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
        "Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no "
        "Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission.",
    ],
    "BSD-4-Clause": [
        "All advertising materials mentioning features or use of this software must display the following "
        "acknowledgement: This product includes software developed by the organization.",
    ],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MIT-0": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so.",
    ],
    "X11": [
        "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise "
        "to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "WTFPL": [
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing "
        "it is allowed as long as the name is changed.",
    ],
    "Zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
        "to whom the Software is furnished to do so, all subject to the following:",
    ],
    "BUSL-1.1": [
        "Use of this software is governed by the Business Source License included in the LICENSE file.",
    ],
    "NCSA": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal with the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "PostgreSQL": [
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, "
        "and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph "
        "and the following two paragraphs appear in all copies.",
    ],
    "Artistic-2.0": [
        "Licensed under the Artistic License 2.0.",
        "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    ],
    "EPL-1.0": [
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "CDDL-1.0": [
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). "
        "You may not use this file except in compliance with the License.",
    ],
    "EUPL-1.2": [
        "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions "
        "of the EUPL (the Licence); You may not use this work except in compliance with the Licence.",
    ],
    "MPL-1.1": [
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this "
        "file except in compliance with the License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "MS-PL": ["This source code is subject to the terms and conditions of the Microsoft Public License (Ms-PL)."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "Python-2.0": [
        "Subject to the terms and conditions of this License Agreement, PSF hereby grants Licensee a nonexclusive, "
        "royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly, prepare derivative "
        "works, distribute, and otherwise use Python alone or in any derivative version.",
    ],
    "OpenSSL": [
        "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit.",
    ],
    "PHP-3.01": [
        "This source file is subject to version 3.01 of the PHP license, that is bundled with this package in the file LICENSE, "
        "and is available through the world-wide-web at the following url:",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-ND-4.0": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-SA-3.0": [
        "Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright to this work.", "Licensed under CC0 1.0 Universal."],
    "ODbL-1.0": ["This database is made available under the Open Database License.", "Licensed under the Open Data Commons Open Database License v1.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}


#: Words too common to tell a notice; they are the last to be chosen as telling words.
COMMON = frozenset(
    "a above all and any are as at be by either do following for free from in is it may no not of on or other person "
    "that the this to under use used with without work you your".split()
)


def bigrams(text: str) -> list[str]:
    words = re.findall(r"[0-9a-z]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def telling_words(notice: str, threshold: float = THRESHOLD) -> list[str]:
    """Words one of which every unit that reaches the threshold must hold: uncommon and long ones first."""
    grams = [set(g.split()) for g in bigrams(notice)]
    spare = len(grams) * (1 - threshold / (2 - threshold))
    chosen: list[str] = []
    for word in sorted(set().union(*grams), key=lambda w: (w in COMMON, -len(w), w)) if grams else []:
        if sum(bool(g & set(chosen)) for g in grams) > spare + 1e-9:
            break
        chosen.append(word)
    return chosen


def gate(templates: dict[str, list[str]], threshold: float) -> str:
    """A pattern that lower-cased texts with a match must hold."""
    words = sorted({w for notices in templates.values() for n in notices for w in telling_words(n, threshold)})
    return rf"(?<![0-9a-z])(?:{'|'.join(words)})(?![0-9a-z])"


def template_array(templates: dict[str, list[str]]) -> Column:
    rows = [(name, bigrams(notice)) for name in sorted(templates) for notice in templates[name]]
    return F.array(*[
        F.struct(F.lit(name).alias("id"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("n"))
        for name, grams in rows if grams
    ])


def unit_bigrams(unit: Column) -> Column:
    words = F.array_remove(F.split(F.lower(unit), "[^0-9a-z]+"), "")
    pairs = lambda w: F.zip_with(
        F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)
    )
    none = F.expr("cast(array() as array<string>)")
    return let(words, lambda w: F.when(F.size(w) < 2, none).otherwise(F.array_distinct(pairs(w))))


def best_match(unit: Column, templates: Column, threshold: float) -> Column:
    """struct<dice, id, unit> of the best template for a unit, null if none reaches the threshold."""
    ratio = threshold / (2 - threshold)

    def against(v: Column) -> Column:
        n = F.size(v["grams"])
        fitting = F.filter(v["templates"], lambda t: (n >= t["n"] * ratio) & (n <= t["n"] / ratio))
        scored = F.transform(fitting, lambda t: F.struct(
            (F.lit(2.0) * F.size(F.array_intersect(t["grams"], v["grams"])) / (t["n"] + n)).alias("dice"), t["id"].alias("id")
        ))
        best = F.aggregate(
            scored, F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("id")),
            lambda s, x: F.when(x["dice"] > s["dice"], x).otherwise(s),
        )
        return let(best, lambda b: F.when(
            b["dice"] >= threshold, F.struct(b["dice"].alias("dice"), b["id"].alias("id"), unit.alias("unit"))
        ))

    return let(F.struct(unit_bigrams(unit).alias("grams"), templates.alias("templates")), against)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id and matches, array<struct<dice, id, unit>>, best first."""
    templates = templates or TEMPLATES
    listed, needed = template_array(templates), gate(templates, threshold)
    text = text_or_empty(F.col("text"))

    def units(t: Column) -> Column:
        pieces = F.concat(F.split(t, "\n"), F.split(t, SENTENCE_END), F.split(t, r"\n\s*\n"), F.array(t))
        return F.filter(F.array_distinct(pieces), lambda u: F.lower(u).rlike(needed))

    def matched(v: Column) -> Column:
        each = F.transform(units(v["text"]), lambda u: best_match(u, v["templates"], threshold))
        return F.reverse(F.array_sort(F.filter(each, lambda m: m.isNotNull())))

    whole = F.struct(text.alias("text"), listed.alias("templates"))
    none = F.expr("cast(array() as array<struct<dice: double, id: string, unit: string>>)")
    found = F.when(F.lower(text).rlike(needed), let(whole, matched)).otherwise(none)
    return docs.select("doc_id", found.alias("matches"))
