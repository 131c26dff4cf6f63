"""License scans: templates with optional and replaceable regions, compiled into token automata."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .textbytes import ALNUM_LOWER, LOWER, Hashes, Piece, counts, pieces

#: phrase: label
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label: templates. [[...]] may be absent; {n} stands for up to n words of any kind; all else must stand as it is.
_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the
warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the {8} be liable for any
claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
software or the use or other dealings in the software"""
_BSD_END = """this software is provided by {12} as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any direct
indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract
strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of
the possibility of such damage"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the
following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the
following disclaimer in the documentation and or other materials provided with the distribution"""
_FSF = "as published by the free software foundation"
#: Opening words of the Free Software Foundation's licenses; the copyright line has years, a name and sometimes an address.
_FSF_OPENING = """copyright {20} everyone is permitted to copy and distribute verbatim copies of this license document but changing it
is not allowed"""
TEMPLATES = {
    "mit-notice": ["[[this {3} is]] [[released]] [[distributed]] under the [[terms of the]] mit license"],
    "mit-text": [
        f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify
        merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the
        next paragraph]] shall be included in all copies or substantial portions of the software {_WARRANTY}"""
    ],
    "isc-text": [
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies"""
    ],
    "bsd-2-clause": [f"{_BSD} {_BSD_END}"],
    "bsd-3-clause": [
        f"""{_BSD} [[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission {_BSD_END}"""
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "licensed under the terms of the apache license [[version]] 2 0",
        """apache license version 2 0 january 2004 [[http]] [[https]] [[www apache org licenses]] terms and conditions for use reproduction and
        distribution [[1]] definitions {1} shall mean the terms and conditions for use reproduction and distribution as defined by sections
        1 through 9 of this document""",
    ],
    "gpl-2.0": [
        "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2",
        f"under the terms of the gnu general public license {_FSF} [[either]] version 2",
        f"under the terms of the gnu general public license version 2 [[only]] {_FSF}",
        "under the terms of version 2 of the gnu general public license",
        f"""gnu general public license version 2 june 1991 {_FSF_OPENING} preamble the licenses for most software are designed to take away
        your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom""",
    ],
    "gpl-3.0": [
        "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3",
        f"under the terms of the gnu general public license {_FSF} [[either]] version 3",
        f"under the terms of the gnu general public license version 3 [[only]] {_FSF}",
        "under the terms of version 3 of the gnu general public license",
        f"""gnu general public license version 3 29 june 2007 {_FSF_OPENING} preamble the gnu general public license is a free copyleft
        license for software and other kinds of works""",
    ],
    "lgpl": [
        "licensed under the [[terms of the]] gnu lesser general public license",
        f"under the terms of the gnu lesser general public license [[version {{2}}]] [[only]] {_FSF}",
        f"under the terms of the gnu library general public license [[version {{2}}]] [[only]] {_FSF}",
        "under the terms of version {2} of the gnu lesser general public license",
        f"gnu lesser general public license version 2 1 february 1999 {_FSF_OPENING}",
        f"gnu library general public license version 2 june 1991 {_FSF_OPENING}",
        f"""gnu lesser general public license version 3 29 june 2007 {_FSF_OPENING} this version of the gnu lesser general public license
        incorporates the terms and conditions of version 3 of the gnu general public license""",
    ],
    "agpl-3.0": [
        "licensed under the [[terms of the]] gnu affero general public license [[version 3]]",
        f"under the terms of the gnu affero general public license {_FSF} [[either]] version 3",
        f"under the terms of the gnu affero general public license version 3 [[only]] {_FSF}",
        "under the terms of version 3 of the gnu affero general public license",
        f"""gnu affero general public license version 3 19 november 2007 {_FSF_OPENING} preamble the gnu affero general public license is a
        free copyleft license for software and other kinds of works""",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        """mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to
        the creation of or owns covered software""",
    ],
    "cc-by-4.0": ["licensed under [[a]] [[the]] [[creative commons]] cc by 4 0"],
    "cc-by-sa-4.0": ["licensed under [[a]] [[the]] [[creative commons]] cc by sa 4 0"],
    "cc-by-nc-4.0": ["licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0"],
    "all-rights-reserved": ["[[copyright [[c]] {8}]] all rights reserved"],
}

_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


class Automaton:
    """Token automaton of a template. States are bits of an integer, so that all that are open move at once.

    step[t] has the states that token t may lead out of, any those that every token does; a move from state i goes to
    i + 1; skip[i] has what else is open once i is. The last state accepts.
    """

    def __init__(self, template: str, number: dict[str, int]):
        self.step: dict[int, int] = {}
        self.any = 0
        skips: list[tuple[int, int]] = []
        opened: list[int] = []
        self.words: list[str] = []
        state = 0
        for part in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", template):
            if part == "[[":
                opened.append(state)
            elif part == "]]":
                skips.append((opened.pop(), state))
            elif part[0] == "{":
                for _ in range(int(part[1:-1])):
                    self.any |= 1 << state
                    skips.append((state, state + 1))
                    state += 1
            else:
                t = number.setdefault(part, len(number))
                self.step[t] = self.step.get(t, 0) | 1 << state
                if not opened:
                    self.words.append(part)
                state += 1
        self.accept = 1 << state
        self.skip = [1 << i for i in range(state + 1)]
        for i in range(state, -1, -1):
            for a, b in skips:
                if a == i:
                    self.skip[i] |= self.skip[b] if b > i else 0
        self.begin = self.skip[0]
        self.known: dict[int, int] = {}
        #: a text without this mandatory word can't be accepted
        self.anchor = number[max(self.words, key=len)]

    def opened(self, states: int) -> int:
        known = self.known.get(states)
        if known is None:
            known, rest = 0, states
            while rest:
                low = rest & -rest
                known |= self.skip[low.bit_length() - 1]
                rest ^= low
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[states] = known
        return known

    def found(self, tokens: list[int]) -> bool:
        """Whether some run of tokens is one of the template's texts: one pass, in which a run begins at every token."""
        states = self.begin
        for t in tokens:
            states = self.opened((states & (self.step.get(t, 0) | self.any)) << 1) | self.begin
            if states & self.accept:
                return True
        return False


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        number: dict[str, int] = {}
        self.phrases = [(label, [number.setdefault(w, len(number)) for w in phrase.split()]) for phrase, label in PHRASES.items()]
        self.automata = [(label, Automaton(t, number)) for label, ts in templates.items() for t in ts]
        words = list(number)
        blob = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in words])
        keys = Hashes(blob).of(np.concatenate(([0], ends[:-1])), ends)
        by = np.argsort(keys)
        self.keys, self.ids = keys[by], by
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """The number of each word in the automata's vocabulary, or -1."""
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.likely[(h & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        out[at[same]] = self.ids[k[same]]
        return out

    def scan(self, p: Piece) -> list[tuple]:
        low = LOWER[p.buf]
        s, e, row = p.spans(ALNUM_LOWER, low)
        total = counts(row, p.rows)
        begin = np.cumsum(total) - total
        token = self.tokens(Hashes(low).of(s, e))
        rows: list[list] = [[int(n), 0, None, None, set(), set(), 0.0] for n in total]
        for label, phrase in self.phrases:
            at = np.flatnonzero(token[: len(token) - len(phrase) + 1] == phrase[0]) if len(token) >= len(phrase) else np.zeros(0, np.int64)
            for k, t in enumerate(phrase):
                at = at[(token[at + k] == t) & (row[at + k] == row[at])]
            for i in at.tolist():
                r = rows[row[i]]
                w = i - int(begin[row[i]])
                r[1] += 1
                r[2], r[3] = w if r[2] is None else min(r[2], w), w if r[3] is None else max(r[3], w)
                r[4].add(label)
        for label, automaton in self.automata:
            for r in np.unique(row[token == automaton.anchor]).tolist():
                if automaton.found(token[begin[r] : begin[r] + total[r]].tolist()):
                    rows[r][5].add(label)
        join = ",".join
        return [(n, b, f, z, join(sorted(base)), join(sorted(base | more)), 1.0 if more else 0.5 if base else 0.0) for n, b, f, z, base, more, _ in rows]


@lru_cache(1)
def _scanner() -> Scanner:
    return Scanner(TEMPLATES)


@F.arrow_udf(_FOUND)
def _licenses(texts: pa.Array) -> pa.Array:
    rows = [x for p in pieces(texts) for x in _scanner().scan(p)]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    columns = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _FOUND.names)


def licenses(text: str | Column) -> Column:
    """Struct for a text column: n_words, n_base (places of PHRASES), first_word, last_word (their smallest and largest
    start, else null), base_labels, labels (with those of accepted templates; both distinct, sorted, comma-joined),
    score (1: a template is accepted, 0.5: only a phrase stands, else 0). A null text counts as empty."""
    return _licenses(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and licenses() for every row of docs (doc_id, text); repeated rows give a row each, other columns are
    ignored, an empty table gives an empty one."""
    return docs.select("doc_id", licenses("text").alias("m")).select("doc_id", "m.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
