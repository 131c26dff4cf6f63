"""Cases that operators on text once missed."""

from __future__ import annotations

import random
from collections import Counter

from plumbline.llm import op02_licenses, op08_decontaminate


def test_decontamination_finds_parts_in_any_order(spark):
    rng = random.Random(8)
    word = lambda letters="abcdefgh": "".join(rng.choice(letters) for _ in range(5))
    items = [[word() for _ in range(rng.randint(30, 80))] for _ in range(25)]
    items += [[word() for _ in range(54)], ["again"] * 40, ["a", "b"] * 30, [word("ab")[:2] for _ in range(60)]]
    texts = []
    for k, w in enumerate(items * 4):
        cut = [18, len(w) // 2, len(w) // 3, 7][k // len(items)]
        moved = w[cut:] + w[:cut] if k % 3 else w[-cut:] + w[cut:-cut] + w[:cut]
        moved = moved if k % 5 else [*moved[:-1], "changed"]
        texts.append([word() for _ in range(rng.randint(0, 70))] + moved + [word() for _ in range(rng.randint(0, 70))])
    texts += [["again"] * 90, ["a", "b"] * 50 + ["again"] * 36, items[25][18:] + items[25][:18]]
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for d, w in enumerate(texts):
        found, best, windows = set(), 0.0, 0
        for i, item in enumerate(items):
            b = shingles(item)
            for a in range(max(1, len(w) - len(item) + 1)):
                x = shingles(w[a : a + len(item)])
                shared = (x & b).total()
                similarity = shared / (x.total() + b.total() - shared)
                if similarity >= 0.8:
                    found, best, windows = found | {i}, max(best, similarity), windows + 1
        want[d] = (sorted(found), best, windows)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (r["items"], r["similarity"], r["windows"]) for r in op08_decontaminate.contamination(docs, bench).collect()}
    assert got == want and want[len(texts) - 1][0] == [25] and sum(bool(f) for f, _, _ in want.values()) > 40
    few = spark.createDataFrame([(0, "so " + " ".join(items[0][:7]) + " on"), (1, " ".join(items[1][:5]))], "doc_id long, text string")
    assert [r["items"] for r in op08_decontaminate.contamination(few, bench).collect()] == [[], []]
    kept = {r["doc_id"] for r in op08_decontaminate.keep_clean(docs, bench).collect()}
    assert kept == {d for d, (f, _, _) in want.items() if not f}


def test_standard_headers_and_openings_of_licenses(spark):
    header = "This program is free software{}; you can redistribute it and/or modify\n * it under the terms of the {} as published by\n * the Free Software Foundation; either version {} of the License, or\n * (at your option) any later version.\n".format
    street = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA\n"
    verbatim = "Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"
    taken = "The licenses for most software are designed to take away your\nfreedom to share and change it.  By contrast, the GNU General Public\nLicense{} intended to guarantee your freedom to share and change free\nsoftware".format
    fsf = "Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n "
    cases = [
        (header("", "GNU General Public License", 2), "gpl,gpl-2.0"),
        (header(": ", "GNU General Public License", 3), "gpl,gpl-3.0"),
        (header("", "GNU Lesser General Public\n * License", "2.1"), "lgpl"),
        (header("", "GNU Library General Public License", 2), "lgpl"),
        (header(": ", "GNU Affero General Public License", 3), "agpl-3.0"),
        ("it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "gpl,gpl-2.0"),
        ("modify it under the terms of version 2 of the GNU General Public License as published", "gpl,gpl-2.0"),
        ("under the terms of the GNU General Public License as published by someone else, version 3", "gpl"),
        (header("", "GNU Affero General Public License", 1), ""),
        ("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n " + street + verbatim + "\n Preamble\n\n " + taken(" is"), "gpl,gpl-2.0"),
        ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n " + fsf + verbatim + "\n Preamble\n\n The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.", "gpl,gpl-3.0"),
        ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n " + street + verbatim, "lgpl"),
        ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n " + fsf + verbatim + "\n\n  This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by", "gpl,lgpl"),
        ("GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007\n\n " + fsf + verbatim + "\n Preamble\n\n The GNU Affero General Public License is a free, copyleft license for\nsoftware and other kinds of works, specifically", "agpl-3.0"),
        ("Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n 1. Definitions.\n\n \"License\" shall mean the terms and conditions for use, reproduction,\n and distribution as defined by Sections 1 through 9 of this document.", "apache,apache-2.0"),
        ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. \"Contributor\"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.", "mpl-2.0"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in op02_licenses.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
