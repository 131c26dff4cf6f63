"""Token counts by compiled finite-state transducers; the tokenizers library encodes nothing on the way.

The tokenizer splits a normalised text into words by a regular expression and then merges symbols inside each word.

The expression is compiled into a deterministic transducer over character classes, whose transitions say where words
begin. A text is cut into equal chunks whose maps from entry state to exit state are computed side by side, composed
by a parallel prefix scan, and rerun from their true entry states.

The merges are compiled into a second transducer, over symbols (a byte, or a byte that ends its word). Merging a word
gives the only sequence of tokens in which every two neighbours stay as they are when merged by themselves, and what it
gives for a prefix begins with what it gives for a shorter one. So the last token of a prefix follows from the last
tokens of shorter prefixes, and a state holds, for each suffix of what was read that may still become part of a token,
its place in a trie of the tokens, the last token before it, and how many tokens were emitted since. A transition is
annotated with the number of tokens that it emits, which is below one where tokens become one. There are too many
states to list, so a transition is compiled when a task first takes it; a lexicon keeps the sums of whole words.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textbytes import mix

#: Words that a worker's lexicon and states that its transducer hold before they start anew (about 100 bytes and 1 kB each).
LEXICON, STATES = 400_000, 80_000
#: Characters of a chunk; its map has an entry for each state.
CHUNK = 256
#: Characters handled at once.
PIECE = 1 << 20

# character classes
_SPACE, _NUMBER, _OTHER, _QUOTE, _LETTER = range(5)
_S, _R, _V, _L, _E = range(5, 10)  # letters that end or continue 's 't 'm 'd, 're, 've, 'll
# states: between words, in letters, after a number, in other characters, after a quote that began a word,
# after 'r 'v 'l, after a whole contraction
_GAP, _LETTERS, _DIGIT, _OTHERS, _QUOTED, _QR, _QV, _QL, _ENDING = range(9)
_STATES, _CLASSES = 9, 10
#: a transition's output: a word begins here; a word began at the character before
_HERE, _BEFORE = 1, 2


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and output[class, state] for 's|'t|'re|'ve|'m|'ll|'d|[letters]+|[number]|[others]+"""
    after, out = np.zeros((_CLASSES, _STATES), np.uint8), np.zeros((_CLASSES, _STATES), np.uint8)
    finish = {_QR: _E, _QV: _E, _QL: _L}
    for state in range(_STATES):
        for c in range(_CLASSES):
            # 'r not followed by e is a quote and a word that began at r
            late = _BEFORE if state in finish and finish[state] != c else 0
            now = _LETTERS if late else state
            if state in finish and finish[state] == c:
                to, said = _ENDING, 0
            elif c == _SPACE:
                to, said = _GAP, 0
            elif c == _NUMBER:
                to, said = _DIGIT, _HERE
            elif c in (_OTHER, _QUOTE):
                runs = now in (_OTHERS, _QUOTED)
                to, said = (_OTHERS, 0) if runs else (_QUOTED if c == _QUOTE else _OTHERS, _HERE)
            elif now == _QUOTED and c in (_S, _R, _V, _L):
                to, said = {_S: _ENDING, _R: _QR, _V: _QV, _L: _QL}[c], 0
            else:
                to, said = _LETTERS, 0 if now == _LETTERS else _HERE
            after[c, state], out[c, state] = to, said | late
    return after, out


class Alphabet:
    """What a tokenizer file makes of every code point, asked of the tokenizer itself once, on the driver."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        added = library.get_added_tokens_decoder().values()
        self.special = sorted((t.content for t in added if not t.normalized), key=len, reverse=True)
        kind = np.concatenate([self._asked(library.pre_tokenizer, lo) for lo in range(0, 0x110000, 1 << 14)])
        kind[ord("'")] = _QUOTE
        for letters, c in (("stmd", _S), ("r", _R), ("v", _V), ("l", _L), ("e", _E)):
            kind[[ord(x) for x in letters]] = c
        #: classes as runs: where each begins, and its class
        self.first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        self.kind = kind[self.first]
        odd = np.concatenate([self._odd(library.normalizer, lo) for lo in range(0, 0x110000, 1 << 12)])
        #: runs of code points that Python and the tokenizer don't normalise alike, or may not: where odd and plain ones begin
        self.odd = np.flatnonzero(np.concatenate(([odd[0]], odd[1:] != odd[:-1])))

    @staticmethod
    def _asked(pre, lo: int) -> np.ndarray:
        """Classes from the words of a letter and the code point, twice: one, three if it is a number, or two."""
        cps = [c for c in range(lo, lo + (1 << 14)) if not 0xD800 <= c < 0xE000]
        out = np.full(1 << 14, _OTHER, np.uint8)
        text = "".join(f"b{chr(c)}{chr(c)} " for c in cps)
        spans = np.array([x for _, x in pre.pre_tokenize_str(text)])
        which = spans[:, 0] // 4
        words = np.bincount(which, minlength=len(cps))
        wide = np.zeros(len(cps), np.int64)
        np.maximum.at(wide, which, spans[:, 1] - spans[:, 0])
        found = np.select([(words == 1) & (wide == 3), (words == 1) & (wide == 1), words == 3], [_LETTER, _SPACE, _NUMBER], _OTHER)
        out[np.array(cps, np.int64) - lo] = found
        return out

    @staticmethod
    def _odd(normalizer, lo: int) -> np.ndarray:
        """What the normaliser makes of code points that stand apart, next to what Python does."""
        cps = [c for c in range(max(lo, 0x80), lo + (1 << 12)) if not 0xD800 <= c < 0xE000 and not chr(c).isspace()]
        out = np.zeros(1 << 12, bool)
        got = normalizer.normalize_str(" ".join(map(chr, cps))).split(" ")
        whole = len(got) == len(cps)
        for i, c in enumerate(cps):
            x = chr(c)
            out[c - lo] = not whole or c in (0x130, 0x3A3) or unicodedata.category(x) == "Cn" or got[i] != unicodedata.normalize("NFC", x).lower()
        return out

    def odd_ones(self) -> np.ndarray:
        """Whether each code point is odd."""
        out = np.zeros(0x110001, np.int8)
        out[self.odd] = 1
        return np.cumsum(out[:-1], dtype=np.int64) % 2 == 1

    def classes(self) -> np.ndarray:
        return np.repeat(self.kind, np.diff(np.append(self.first, 0x110000)))


@lru_cache(2)
def alphabet_of(path: str) -> Alphabet:
    return Alphabet(path)


class Merges:
    """The transducer of a file's merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        shown = _shown_bytes()
        #: symbol (a byte, 256 more if it ends its word) to token
        self.base = {i: vocabulary[x + tail] for tail, more in (("", 0), (end, 256)) for x, b in shown.items() for i in [b + more]}
        symbol = {t: i for i, t in self.base.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        spelled: dict[int, tuple[int, ...]] = {t: (i,) for t, i in symbol.items()}
        for pair in model["merges"]:
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            a, b, t = vocabulary[x], vocabulary[y], vocabulary[x + y]
            self.split[t], self.joined[a, b] = (a, b), t
            spelled[t] = spelled[a] + spelled[b]
        # a trie: node << 9 | symbol to node; node to token
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        inner = {0}
        for t, word in spelled.items():
            node = 0
            for i in word:
                inner.add(node)
                node = self.child.setdefault(node << 9 | i, len(self.child) + 1)
            self.token[node] = t
        self.inner = inner
        self.kept: dict[int, bool] = {}
        self._anew()

    def _anew(self) -> None:
        self.states: dict[tuple, int] = {}
        self.open: list[tuple] = []
        self.steps: list[dict[int, tuple[int, int]]] = []
        self._state(((0, -1, 0),))

    def _state(self, held: tuple) -> int:
        n = self.states.setdefault(held, len(self.open))
        if n == len(self.open):
            self.open.append(held)
            self.steps.append({})
        return n

    def stay(self, a: int, b: int) -> bool:
        """Whether merging leaves tokens a and b apart: undoing their merges, latest first, no pair across the border
        was to be merged before what was undone."""
        known = self.kept.get(a << 20 | b)
        if known is None:
            x, y, limit = a, b, 1 << 60
            known = True
            while True:
                if self.joined.get((x, y), limit) < limit:
                    known = False
                    break
                # of equal tokens the left one is made first, so the right one is undone first, and its own merge counts
                if x > y:
                    if x in self.split:
                        limit, x = x, self.split[x][1]
                    elif y in self.split:
                        limit, y = y + 1, self.split[y][0]
                    else:
                        break
                elif y in self.split:
                    limit, y = y + 1, self.split[y][0]
                elif x in self.split:
                    limit, x = x, self.split[x][1]
                else:
                    break
            if len(self.kept) >= LEXICON:
                self.kept.clear()
            self.kept[a << 20 | b] = known
        return known

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The state after a symbol, and the tokens that it emits."""
        alive, emitted, last = [], None, -1
        child, token, inner = self.child, self.token, self.inner
        for node, before, since in self.open[state]:
            to = child.get(node << 9 | symbol)
            if to is None:
                continue
            if emitted is None:
                t = token.get(to)
                if t is not None and (before < 0 or self.stay(before, t)):
                    last, emitted = t, 1 - since
            if to in inner:
                alive.append((to, before, since))
        held = tuple([*((to, before, since + emitted) for to, before, since in alive), (0, last, 0)])
        step = self.steps[state][symbol] = self._state(held), emitted
        return step

    def count(self, word: bytes) -> int:
        """Tokens of a word."""
        if len(self.open) > STATES:
            self._anew()
        state = n = 0
        for b in word[:-1]:
            step = self.steps[state].get(b) or self._compile(state, b)
            state, n = step[0], n + step[1]
            if len(self.open) > 2 * STATES:  # inside one endless word
                held = self.open[state]
                self._anew()
                state = self._state(held)
        b = word[-1] + 256
        return n + (self.steps[state].get(b) or self._compile(state, b))[1]


def _shown_bytes() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it is printable, else the next free one from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    after, out = compile_splitter()
    both = np.stack([after, out])
    return both[0].ravel(), both[1].ravel(), mix(np.arange(1, 0x110001, dtype=np.uint64))


def begins(classes: np.ndarray) -> np.ndarray:
    """Whether a word begins at each character, for a text that ends with a space."""
    after, out, _ = _tables()
    n = len(classes)
    m = -(-n // CHUNK)
    grid = np.zeros(m * CHUNK, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(m, CHUNK).T) * np.uint8(_STATES)
    # every chunk's map, from each entry state
    maps = np.repeat(np.arange(_STATES, dtype=np.uint8)[:, None], m, axis=1)
    for row in grid:
        maps = after[row + maps]
    # prefix[k]: the composition of the maps of chunks 0..k
    prefix, gap = maps, 1
    while gap < m:
        prefix = np.concatenate([prefix[:, :gap], np.take_along_axis(prefix[:, gap:], prefix[:, :-gap], 0)], axis=1)
        gap *= 2
    state = np.concatenate(([_GAP], prefix[_GAP, :-1])).astype(np.uint8)
    said = np.empty((CHUNK, m), np.uint8)
    for k, row in enumerate(grid):
        at = row + state
        said[k] = out[at]
        state = after[at]
    said = said.T.ravel()[:n]
    found = (said & _HERE).astype(bool)
    found[:-1] |= (said[1:] & _BEFORE).astype(bool)
    return found


class Counter:
    """Counts of one tokenizer file in one worker process."""

    def __init__(self, path: str, alphabet: Alphabet | None = None):
        alphabet = alphabet or alphabet_of(path)
        self.path, self.special = path, alphabet.special
        self.classes = alphabet.classes()
        self.odd = alphabet.odd_ones()
        self.merges = Merges(path)
        self.lexicon: dict[int, int] = {}
        self.normalizer = None

    def normal(self, text: str) -> tuple[str, int]:
        """The text as the tokenizer normalises it, special strings cut out, and how many those were. Only a text
        that Python may normalise otherwise goes through the library's normaliser."""
        n = 0
        if any(s in text for s in self.special):
            parts = [text]
            for s in self.special:
                parts = [x for p in parts for x in p.split(s)]
            n = len(parts) - 1
            return "\n".join(self.normal(p)[0] for p in parts), n
        if text.isascii() or (unicodedata.is_normalized("NFC", text) and not self.odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any()):
            return text.lower(), n
        if self.normalizer is None:
            from tokenizers import Tokenizer

            self.normalizer = Tokenizer.from_file(self.path).normalizer
        return self.normalizer.normalize_str(text), n

    def words(self, text: str, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        known = self.lexicon
        emitted = [known.get(k, -1) for k in keys.tolist()]
        new = [i for i, v in enumerate(emitted) if v < 0]
        if new:
            if len(known) + len(new) > LEXICON:
                known.clear()
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            for i, a, b in zip(new, s, e, strict=True):
                emitted[i] = self.merges.count(text[a:b].encode())
            fresh = keys[new].tolist()
            known.update(zip(fresh, (emitted[i] for i in new), strict=True))
        return np.array(emitted, np.int64)[which]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        normal, special = zip(*map(self.normal, texts), strict=True)
        sizes = np.fromiter(map(len, normal), np.int64, len(normal)) + 1
        text = " ".join(normal) + " "
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.classes[cp]
        start = begins(kind)
        space = kind == _SPACE
        s = np.flatnonzero(start)
        total = np.array(special, np.int64)
        if not len(s):
            return total
        stops = np.flatnonzero(start | space)
        e = stops[np.searchsorted(stops, s) + 1]
        sums = np.zeros(len(cp) + 1, np.uint64)
        value = _tables()[2]
        power = _powers(len(cp))
        np.cumsum(value[cp] * power[0, : len(cp)], out=sums[1:])
        h = mix((sums[e] - sums[s]) * power[1, s] + (e - s).astype(np.uint64))
        emitted = np.concatenate(([0], np.cumsum(self.words(text, s, e, h))))
        bounds = np.searchsorted(s, np.concatenate(([0], np.cumsum(sizes))))
        return total + emitted[bounds[1:]] - emitted[bounds[:-1]]


def _powers(n: int) -> np.ndarray:
    from .textbytes import _power_table

    return _power_table(n + 1)


#: A worker's counter, by path.
_counters: dict[str, Counter] = {}


def counter_of(path: str, alphabet: Alphabet) -> Counter:
    """The worker's counter, which its tasks share; a function of the module, so that tasks refer to it and don't copy it."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path, alphabet)
    return _counters[path]


def token_count(text: str | Column, path: str) -> Column:
    """Number of tokens of each text by the tokenizer file at path (which every worker must reach); null counts as empty."""
    alphabet = alphabet_of(path)

    @F.arrow_udf("long")
    def run(batch: pa.Array) -> pa.Array:
        counter = counter_of(path, alphabet)
        out: list[np.ndarray] = []
        for part in _parts(batch):
            out.append(counter.count(part))
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())

    return run(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def _parts(batch: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for x in batch:
        held.append(x.as_py())
        size += len(held[-1])
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def counted(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text); a null text counts as empty,
    repeated rows give a row each, an empty table an empty one. Other columns are ignored."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count("text", path).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
