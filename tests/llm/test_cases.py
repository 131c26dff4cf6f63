"""Corpus operators on clashing columns, repeated rows, long texts and empty tables, and against plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import op01_langid, op02_licenses, op03_warc, op04_simhash, op05_tokens, op06_preferences, op07_mix, op08_decontaminate, op09_quality, op10_lines
from plumbline.llm.textbytes import pieces

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: names that operators might give to columns of their own
CLASHES = ["uid", "removed", "m", "measures", "failed", "limits", "own_lang", "own_source", "kept", "fp", "component", "id", "key", "line", "_m", "_kept", "_removed", "_uid"]


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def documents(spark, rows):
    """rows: doc_id, text, lang, source; with every clashing column."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(20)
    texts = [prose(rng, 80) for _ in range(30)]
    texts += [texts[0], texts[0] + " more", "\n".join([texts[1], "a line that stands here too"]), "\n".join([texts[2], "a line that stands here too"])]
    out = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", None])) for i, t in enumerate(texts)]
    return out + [out[4], out[4], (100, None, None, None), (101, "", "en", "a"), (None, prose(rng, 70), "en", "a"), (None, None, None, None), (102, " \n ", None, "b")]


def test_stages_keep_columns_and_values(spark, sf, rows):
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got, name
        assert all(r[c] == f"own {c}" for r in got for c in CLASHES), name
        assert corpus_pipeline.STAGES and stage(spark, docs.limit(0), sf).count() == 0, name


def test_stage_quality_against_brute_force(spark, sf, rows):
    got = Counter(r["text"] for r in corpus_pipeline.quality(spark, documents(spark, rows), sf).collect())
    judged = op09_quality.quality(documents(spark, rows)).collect()
    assert sum(got.values()) == sum(r["kept"] for r in judged)
    assert None not in got and "" not in got and got[rows[4][1]] in (0, 3)


def test_stage_lines_against_brute_force(spark, sf, rows):
    """Whole lines only: every near copy here is far from 0.8 or well above it."""
    sets, want, seen = {}, Counter(), []
    ordered = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    kept = {}
    for r in ordered:
        lines = (r[1] or "").split("\n")
        stay = []
        for x in lines:
            if not re.search(r"[^\x20\x09-\x0D]", x):
                stay.append(x)
                continue
            s = {x[i : i + 8] for i in range(max(1, len(x) - 7))}
            if not any(len(s & o) >= 0.8 * len(s | o) for o in seen):
                stay.append(x)
            seen.append(s)
        worded = any(re.search(r"[^\x20\x09-\x0D]", x) for x in lines)
        kept[r] = None if worded and not any(re.search(r"[^\x20\x09-\x0D]", x) for x in stay) else (r[1] if stay == lines else "\n".join(stay),)
    for r in rows:
        if kept[r] is not None:
            want[r[0], kept[r][0]] += 1
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.line_dedup(spark, documents(spark, rows), sf).collect())
    assert got == want and not sets


def test_stage_near_dedup_against_brute_force(spark, sf, rows):
    comp = {(r["id"], r["fp"]): r["component"] for r in op04_simhash.near_duplicates(documents(spark, rows)).collect()}
    stay = {i for (i, _), c in comp.items() if i == c}
    got = Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), sf).collect())
    assert got == Counter(r[0] for r in rows if r[0] in stay)
    assert got[4] == 3 and got[100] == 1 and got[101] == 0 and got[30] == 0


def test_stage_decontaminate_against_brute_force(spark, sf, rows):
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = [(200 + i, f"so {t} then", "en", "a") for i, t in enumerate(items[:3])]
    got = Counter(r["doc_id"] for r in corpus_pipeline.decontaminate(spark, documents(spark, rows + dirty), sf).collect())
    assert got == Counter(r[0] for r in rows)


def test_stage_mix_against_the_operator(spark, sf, rows):
    docs = documents(spark, rows)
    got = corpus_pipeline.mix_sources(spark, docs, sf).collect()
    want = op07_mix.mix(op07_mix.sizes(docs)).where("taken > 0").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and got


def test_languages_against_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    net = op01_langid.ByteConvNet(["x", "y", "z"], seed=3).compiled()
    texts = ["plain text of some length " * 3, "É ünï ÇA " * 90, "ab", "A" * 256, "b" * 257, "".join(chr(int(c)) for c in rng.integers(97, 122, 5000))]
    (piece,) = pieces(pa.array(texts))
    label, score = net.predict(piece.buf, piece.offs)
    for i, t in enumerate(texts):
        raw = bytearray(t.encode())
        low = [b + 32 if 65 <= b <= 90 or (0x80 <= b <= 0x9E and b != 0x97 and k and raw[k - 1] == 0xC3) else b for k, b in enumerate(raw)]
        total, size = np.zeros(3), 0
        for a in range(0, len(low), 256):
            part = low[a : a + 256]
            x = part + [0] * (256 - len(part))
            hidden = []
            for f, w in zip(net.filters, op01_langid.WIDTHS, strict=True):
                hidden.append(np.max([np.sum([f[k][x[n + k]] for k in range(w)], 0) for n in range(256 - w + 1)], 0))
            z = np.maximum(np.concatenate(hidden), 0) @ net.dense + net.bias
            p = np.exp(z - z.max())
            total += p / p.sum() * len(part)
            size += len(part)
        assert label[i] == total.argmax() and score[i] == pytest.approx(total.max() / size, abs=1e-4), t[:20]


def test_languages_learn_every_label_and_take_long_texts(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 30), f"l{i % 230}") for i in range(230 * 4)]
    docs = spark.createDataFrame(rows + [(9999, "word " * 300_000, None)], "doc_id long, text string, lang string").withColumn("m", F.lit("own")).withColumn("held_out", F.lit("own"))
    known = docs.where(~op01_langid.held_out("doc_id") & F.col("lang").isNotNull()).select("lang").distinct().count()
    assert len(op01_langid.train(docs).labels) == known > 200
    got = op01_langid.identify(docs)
    assert got.count() == len(rows) + 1 and all(0 <= r["score"] <= 1 for r in got.where("doc_id = 9999").collect())


def matched(template: str, words: list[str]) -> bool:
    """A plain backtracking matcher."""
    parts = re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", template)
    close = {}
    stack = []
    for i, p in enumerate(parts):
        if p == "[[":
            stack.append(i)
        elif p == "]]":
            close[stack.pop()] = i

    def run(i: int, at: int) -> bool:
        while i < len(parts):
            p = parts[i]
            if p == "[[":
                if run(close[i] + 1, at):
                    return True
            elif p == "]]":
                pass
            elif p[0] == "{":
                return any(run(i + 1, at + n) for n in range(int(p[1:-1]) + 1) if at + n <= len(words))
            elif at < len(words) and words[at] == p:
                at += 1
            else:
                return False
            i += 1
        return True

    return any(run(0, at) for at in range(len(words) + 1))


def test_licenses_against_a_plain_matcher(spark):
    rng = random.Random(6)
    short = {k: [t for t in ts if len(t.split()) < 40] for k, ts in op02_licenses.TEMPLATES.items()}
    texts = []
    for _ in range(250):
        t = rng.choice([t for ts in short.values() for t in ts])
        words = re.findall(r"\{\d+\}|[^\s\[\]{}]+", t)
        words = [x for w in words for x in (["some", "one"][: rng.randint(0, 2)] if w[0] == "{" else [w])]
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(words) + 1)
            words[k : k + rng.randint(0, 1)] = rng.choice([[], ["gnu"], ["the"], ["license"]])
        texts.append(f"{prose(rng, 3)} {', '.join(words).title()} {prose(rng, 2)} " * rng.randint(1, 2))
    texts += [None, "", "mit mit license mit license", "cc-by CC by, by cc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("own"))
    for r in op02_licenses.scan(rows).collect():
        w = WORDS.findall(lower(texts[r["doc_id"]] or ""))
        places = [(i, label) for p, label in op02_licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert r["n_base"] == len(places) and r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        more = {k for k, ts in op02_licenses.TEMPLATES.items() if any(matched(t, w) for t in ts)}
        assert r["labels"] == ",".join(sorted({x for _, x in places} | more)), texts[r["doc_id"]]
        assert r["score"] == (1.0 if more else 0.5 if places else 0.0)


def test_licenses_of_a_long_text_take_one_pass(spark):
    import time

    scanner = op02_licenses.Scanner(op02_licenses.TEMPLATES)
    (piece,) = pieces(pa.array(["copyright c " * 100_000 + "reserved"]))
    began = time.time()
    assert scanner.scan(piece)[0][5] == ""
    assert time.time() - began < 20


def test_warc_ignores_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "u", "x" * 1500), (1, "v", "x" * 1500), (2, "w", "x" * 1500), (2, "w", "x" * 1500), (3, "z", "short"), (3, "z", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    pages = pages.withColumns({c: F.lit("own") for c in ("n", "digest", "_top", "_n", "_digest", "own", "rid")})
    got = op03_warc.round_trip(pages).collect()
    assert len(got) == 6
    long = [r for r in got if r["payload_bytes"] == 1500]
    assert Counter(r["type"] for r in long) == {"response": 1, "revisit": 3} and next(r["page_id"] for r in long if r["type"] == "response") == 2
    assert all(r["refers_to"] == 2 for r in long if r["type"] == "revisit") and len({r["payload_digest"] for r in long}) == 1


def test_preferences_ignore_clashing_columns_and_take_long_conversations(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " + "é" * (k % 50)) for k in range(3000)] + [(2, 0, "user", "hi"), (2, 1, "assistant", "x" * 200_000), (3, 0, "user", "no reply")]
    conv = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    conv = conv.withColumns({c: F.lit("own") for c in ("last", "_of", "reply", "chosen", "turns", "t")})
    got = {r["conv_id"]: r for r in op06_preferences.format_pairs(op06_preferences.reply_pairs(conv)).collect()}
    assert got[1]["n_prompt_turns"] == 3000 and not got[1]["paired"]  # its neighbour, 0, isn't there
    assert got[2]["n_prompt_turns"] == 2 and got[2]["prompt"].count("x") == 200_000 and got[3]["n_prompt_turns"] == 1
    for i in (1, 2, 3):
        assert got[i]["chosen"] == got[i]["rejected"] == ""


def test_mix_deals_repeated_rows_apart(spark):
    rows = [(7, "hot", 40)] * 6000 + [(i, "b", 10 + i % 7) for i in range(500)] + [(None, "hot", 3)] * 50
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("deal", F.lit("own"))
    units = op07_mix._told_apart(sized.withColumn("deal", F.xxhash64("doc_id", "size")), 0)
    assert units.count() == len(rows) and units.where("doc_id = 7 and source = 'hot'").select("deal").distinct().count() == 6000
    got = op07_mix.mix(sized).collect()
    assert len(got) == len(rows)
    for s in ("hot", "b"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 40


def window_similarity(text: str, item: str) -> float:
    w, i = WORDS.findall(lower(text)), WORDS.findall(lower(item))
    cut = lambda x: Counter(tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4)))
    c, best = cut(i), 0.0
    for a in range(max(1, len(w) - len(i) + 1)):
        x = cut(w[a : a + len(i)])
        both = (x & c).total()
        best = max(best, both / (x.total() + c.total() - both))
    return best


def test_decontamination_loses_no_similar_window(spark):
    """Items of all sizes, edited until they are just similar or just not, rotated, and with repeated shingles."""
    rng = random.Random(30)
    items = [prose(rng, n) for n in (5, 9, 13, 20, 35, 60, 120, 300)] + ["a b " * 12, "one two three four five six " * 4]
    texts = []
    for k in range(240):
        w = items[k % len(items)].split()
        for _ in range(rng.randint(0, max(1, len(w) // 40))):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [prose(rng, 1)] * rng.randint(0, 1)
        if k % 7 == 0:
            at = len(w) // 3
            w = w[at:] + w[:at]
        texts.append(f"{prose(rng, rng.randint(0, 20))} {' '.join(w)} {prose(rng, rng.randint(0, 20))}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("m", F.lit("own"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit("own"))
    got = {r["doc_id"]: r for r in op08_decontaminate.contamination(docs, bench).collect()}
    found = 0
    for d, t in enumerate(texts):
        best = [window_similarity(t, i) for i in items]
        assert got[d]["items"] == [i for i, s in enumerate(best) if s >= 0.8 - 1e-12], (d, best)
        found += len(got[d]["items"])
        if got[d]["items"]:
            assert got[d]["similarity"] == pytest.approx(max(best))
    assert found > 100


def test_decontamination_of_long_texts_and_repeated_rows(spark):
    rng = random.Random(31)
    item = prose(rng, 50)
    long = prose(rng, 60_000)
    rows = [(1, long + " " + item), (1, long + " " + item), (2, long), (3, (item + " ") * 400), (4, item[:-3] + "x"), (None, item), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (9, item), (None, long[:200]), (8, None)], "item_id long, text string")
    got = op08_decontaminate.contamination(docs, bench).collect()
    assert Counter((r["doc_id"], tuple(r["items"])) for r in got) == Counter([(1, (9,)), (1, (9,)), (2, ()), (3, (9,)), (4, (9,)), (None, (9,)), (None, ())])


def test_fingerprints_and_firm_bits():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
    start, wide = rng.integers(0, 300, 80), rng.integers(1, 90, 80)
    got = op08_decontaminate.fingerprints(h, start, wide)
    for k in range(80):
        part = [int(x) for x in h[start[k] : start[k] + wide[k]]]
        fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > len(part))
        assert int.from_bytes(got[k].tobytes(), "little") == fp


def test_quality_of_small_and_null_groups(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 120), "en", "big") for i in range(400)]
    rows += [(1000, prose(rng, 120), "en", "tiny"), (1001, prose(rng, 120) + " ###" * 60, "en", "tiny"), (1002, prose(rng, 120), None, None), (1003, prose(rng, 120) + " $$" * 80, None, None), (1004, prose(rng, 120), "new", "s")]
    kept = {r["doc_id"]: r["kept"] for r in op09_quality.quality(documents(spark, rows)).collect()}
    assert [kept[i] for i in range(1000, 1005)] == [True, False, True, False, True]
    assert sum(kept[i] for i in range(400)) > 390


def test_line_removal_from_a_long_text(spark):
    lines = [f"line number {i} of a long text" if i % 2 else "the same line again and again" for i in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "the same line again and again\nother words are here")], "doc_id long, text string")
    removed = {r["doc_id"]: len(r["removed"]) for r in op10_lines.dedup_lines(docs).collect()}
    assert removed[1] >= 9_999 and removed[2] >= 1
    out = {r["doc_id"]: r["text"] for r in op10_lines.clean(docs).collect()}
    assert out[1].count("the same line") == 1 and out[2] == "other words are here"


def test_tokens_of_every_code_point_and_of_one_long_word():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("word_bpe_49k.json"))
    library, counter = Tokenizer.from_file(path), op05_tokens.Counter(path)
    step = 37  # every code point in turn, over the runs of the test's seed
    texts = [f"ab{chr(c)}cd {chr(c)}{chr(c)}'{chr(c)}" for c in range(0x80, 0x30000, step) if not 0xD800 <= c < 0xE000]
    texts += [f"ab{chr(c)}cd {chr(c)}" for c in (0x13808, 0x1385C, 0x13988, 0x130, 0x3A3, 0x1E9E, 0x345)]
    rng = random.Random(3)
    texts += ["".join(rng.choice("abeilnorst") for _ in range(n)) for n in (1, 2, 50, 4000)] + ["!" * 900, "é" * 700, "a" * 3000]
    assert counter.count(texts).tolist() == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    counter.merges.count(b"zzzz")
    words = [w.removesuffix("</w>") for w in rng.sample(sorted(library.get_vocab()), 3000)]
    assert counter.count(words).tolist() == [len(e) for e in library.encode_batch(words, add_special_tokens=False)]


def test_transducer_starts_anew_without_a_change(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(op05_tokens, "STATES", 20)
    path = str(public.path("word_bpe_49k.json"))
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdehinorst") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch(words, add_special_tokens=False)]
    assert op05_tokens.Counter(path).count(words).tolist() == want


def test_mix_keeps_large_ids_beside_null_ones(spark):
    big = 9_007_199_254_740_993
    rows = [(big + 2 * i, "s", 3 + i % 5) for i in range(50)] + [(None, "s", 4), (None, "t", 9), (big + 2, "t", 9)]
    got = op07_mix.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(rows)


@pytest.mark.parametrize("ids", [None, 1])
def test_languages_are_learned_where_ids_say_nothing(spark, ids):
    """Rows that share an id, or have none, are drawn one by one."""
    rng = random.Random(2)
    say = {"en": ["the", "house", "and", "with", "water"], "de": ["das", "und", "mit", "wasser", "nicht"]}
    rows = [(ids, " ".join(rng.choice(say[x]) for _ in range(40)) + f" {i}", x) for i in range(400) for x in say]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(r["lang"] for r in op01_langid.identify(docs).collect())
    assert sum(got.values()) == 800 and got.keys() == {"en", "de"}
