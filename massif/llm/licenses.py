"""Licence scans by sentence rules.

A text's sentences are normalised and mapped to the letters of known licence sentences, any other sentence to a dot, which gives
each text one string; licence rules are ordered sequences of letters with at most a few other sentences between them. The
longest rules go first and use up what they match, so that a short rule inside a longer match doesn't count. All of it is
expressions of one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of known licence sentences, in their normalised form (lower case, other characters than a-z and 0-9 one space).
SENTENCES = {
    "C": "you may not use this file except in compliance with the license",
    "D": "you may obtain a copy of the license at",
    "E": "see the license for the specific language governing permissions and limitations under the license",
    "H": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "I": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "L": "this program is free software",
    "M": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "N": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "O": "this program is distributed in the hope that it will be useful but without any warranty",
    "U": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "V": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "W": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "X": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "Y": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "b": "under apache license version 2 0 the license",
    "c": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "d": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "e": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "f": "this is free and unencumbered software released into the public domain",
    "g": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "h": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "i": "this software is provided as is without any express or implied warranty",
    "j": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "k": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
}
# Licences and the names under which a sentence like "released under the terms of the ..." states them, in normalised form.
NAMES = (
    ("Apache-2.0", "apache license version 2 0"), ("Apache-2.0", "apache license 2 0"), ("Apache-2.0", "apache 2 0 license"), ("MIT", "mit license"), ("ISC", "isc license"),
    ("BSD-2-Clause", "bsd 2 clause license"), ("BSD-2-Clause", "simplified bsd license"), ("BSD-3-Clause", "bsd 3 clause license"), ("BSD-3-Clause", "new bsd license"),
    ("BSD-3-Clause", "modified bsd license"), ("GPL-2.0", "gnu general public license version 2"), ("GPL-2.0", "gnu gpl version 2"), ("GPL-2.0", "gpl v2"),
    ("GPL-3.0", "gnu general public license version 3"), ("GPL-3.0", "gnu gpl version 3"), ("GPL-3.0", "gpl v3"), ("LGPL-2.1", "gnu lesser general public license version 2 1"),
    ("LGPL-2.1", "lgpl v2 1"), ("LGPL-3.0", "gnu lesser general public license version 3"), ("LGPL-3.0", "lgpl v3"), ("AGPL-3.0", "gnu affero general public license version 3"),
    ("AGPL-3.0", "agpl v3"), ("MPL-2.0", "mozilla public license version 2 0"), ("MPL-2.0", "mozilla public license v 2 0"), ("MPL-2.0", "mpl 2 0"),
    ("EPL-1.0", "eclipse public license version 1 0"), ("EPL-2.0", "eclipse public license version 2 0"), ("EPL-2.0", "eclipse public license 2 0"),
    ("BSL-1.0", "boost software license version 1 0"), ("CDDL-1.0", "common development and distribution license version 1 0"), ("EUPL-1.2", "european union public licence version 1 2"),
    ("Unlicense", "unlicense"), ("Zlib", "zlib license"), ("WTFPL", "wtfpl"), ("Artistic-2.0", "artistic license 2 0"), ("PostgreSQL", "postgresql license"),
    ("OFL-1.1", "sil open font license version 1 1"), ("CC0-1.0", "cc0 1 0 universal"), ("CC0-1.0", "creative commons zero v1 0 universal license"),
    ("CC-BY-4.0", "cc by 4 0"), ("CC-BY-4.0", "creative commons attribution 4 0 international license"), ("CC-BY-SA-4.0", "cc by sa 4 0"),
    ("CC-BY-SA-4.0", "creative commons attribution sharealike 4 0 international license"), ("CC-BY-NC-4.0", "cc by nc 4 0"),
    ("CC-BY-NC-4.0", "creative commons attribution noncommercial 4 0 international license"), ("CC-BY-ND-4.0", "cc by nd 4 0"),
    ("CC-BY-NC-SA-4.0", "cc by nc sa 4 0"), ("CC-BY-NC-SA-4.0", "creative commons attribution noncommercial sharealike 4 0 international license"),
)
#: What may stand before a licence's name; all of it becomes "under".
OPENING = "^(?:(?:this|the) (?:work|software|project|program|code|source code|source code form|library|file|document|text|package) (?:is|are) )?(?:dual )?(?:licensed|released|distributed|available|made available|provided|published|subject) (?:under|to) (?:the terms of )?(?:the |a |an )?"
#: Letters of the names: the characters from here on.
FIRST = 0x4E00
LETTERS = {s: k for k, s in SENTENCES.items()} | {f"under {name}": chr(FIRST + i) for i, (_, name) in enumerate(NAMES)}
# Licences and their sentences in order.
TEXTS = (
    ("Apache-2.0", "bCDE"), ("Apache-2.0", "CDE"), ("Apache-2.0", "bC"), ("Apache-2.0", "b"), ("MIT", "HI"), ("GPL-3.0", "LMO"), ("GPL-3.0", "LM"), ("GPL-2.0", "LNO"), ("GPL-2.0", "LN"),
    ("LGPL-2.1", "LcO"), ("LGPL-2.1", "Lc"), ("LGPL-3.0", "LdO"), ("LGPL-3.0", "Ld"), ("AGPL-3.0", "LeO"), ("AGPL-3.0", "Le"), ("BSD-3-Clause", "UVWX"), ("BSD-2-Clause", "UVW"),
    ("ISC", "Y"), ("Unlicense", "fg"), ("Unlicense", "f"), ("Zlib", "ih"), ("Zlib", "h"), ("CC0-1.0", "j"), ("EPL-2.0", "k"),
)
#: All rules, the longest first; rules of one length keep their order.
RULES = tuple(sorted([*TEXTS, *[(licence, chr(FIRST + i)) for i, (licence, _) in enumerate(NAMES)]], key=lambda r: -len(r[1])))
#: Other sentences allowed between two of a rule, and what stands for a sentence that a match has used up.
GAP = 2
USED = "_"
#: Every known sentence has one of these, so a text without them has none.
HINT = "(?i)licen|permission|redistribut|warrant|free software|cc.by|gpl|mpl|cc0|wtfpl|you can redistribute|public domain|anyone is free|waived all copyright"


def normal_form(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def rule_pattern(letters: str) -> str:
    return f"[^{USED}]{{0,{GAP}}}".join(letters)


def sentence_string(text: Column) -> Column:
    """One letter or dot for each sentence. Sentences end at . ; : ! ? before white space and at empty lines; one that is not known is taken line by line."""
    table = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    marked = F.regexp_replace(text, "([.;:!?])[ \\t\\r\\n]+|\\n[ \\t\\r]*\\n", "$1\u0001")
    known = lambda s: F.element_at(table, F.regexp_replace(normal_form(s), OPENING, "under "))
    parts = F.flatten(F.transform(F.split(marked, "\u0001"), lambda s: F.when(known(s).isNotNull(), F.array(s)).otherwise(F.split(s, "\n"))))
    parts = F.filter(parts, lambda s: normal_form(s) != "")
    letters = F.array_join(F.transform(parts, lambda s: F.coalesce(known(s), F.lit("."))), "")
    return F.when(text.rlike(HINT), letters).otherwise(F.lit(""))


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with sentence_ids (the string of letters and dots), n_known, licences (distinct, sorted) and n_matches of rules.

    Rules are tried from the longest on, and a match uses its sentences up: a rule counts as often as it matches what longer ones have
    left. Null and empty texts, and texts without any licence word, have an empty string and no licence. Every row stays, repeated
    ones too; columns of df with these four names are replaced, all others stay.
    """
    own = "_scan" + "_" * max(map(len, df.columns))  # a name that no column has
    out = df.withColumn("sentence_ids", sentence_string(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    # only strings with a letter go through the rules
    left = F.regexp_replace("sentence_ids", "^\\.*$", "")

    def taken(state: Column, rule: Column) -> Column:
        n = F.size(F.regexp_extract_all(state["ids"], F.concat(F.lit("("), rule["p"], F.lit(")")), 1))
        here = F.when(n > 0, F.array_union(state["found"], F.array(rule["name"]))).otherwise(state["found"])
        return F.when(state["ids"] == "", state).otherwise(F.struct(F.when(n > 0, F.regexp_replace(state["ids"], rule["p"], F.lit(USED))).otherwise(state["ids"]).alias("ids"), here.alias("found"), (state["n"] + n).alias("n")))

    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(letters)).alias("p")) for name, letters in RULES])
    start = F.struct(left.alias("ids"), F.array().cast("array<string>").alias("found"), F.lit(0).alias("n"))
    out = out.withColumn(own, F.aggregate(rules, start, taken))
    return (
        out.withColumn("n_known", F.length(F.regexp_replace("sentence_ids", "\\.", "")))
        .withColumn("licences", F.array_sort(F.col(own)["found"]))
        .withColumn("n_matches", F.col(own)["n"])
        .drop(own)
    )
