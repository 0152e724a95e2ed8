"""Sentence units of any document by a hidden-event n-gram model.

The model is an n-gram model over words and punctuation in which a boundary is a token of its own. It is
trained on sentence records (each a sentence, some split badly), then once more after cutting those
records where the first model is sure. In a new text boundary tokens may be inserted at the gaps behind
sentence-ending punctuation and its closing marks. Forward-backward over the inserted tokens gives the posterior of each
gap, and gaps above one half become boundaries. Runs of words between gaps fix the model's history, so a text falls
apart into short chains, and equal chains are computed once.

A stretch without such marks may be one sentence or unpunctuated text. The training units tell how likely a single
unit is as long as the stretch, with a mark behind it or without, in scripts with blanks or without them; where that is
less likely than that somebody left out marks (``UNMARKED``), every gap of the stretch is offered to a second model, trained on
the same units without their end marks, and its posteriors decide.

What the model doesn't decide: a blank line always ends a unit; a closed quotation is never cut inside.

All sentence records train the model (``fitted``): they are tokenised once, by document, and written; words, the ends of
records and n-grams are counted in tasks and added up by Spark, n-grams by hashes of 64 bits. What comes to the driver and
goes to every task are the frequent words and the n-grams that the model keeps, some 30 bytes each; ``trained_model`` is
the same in memory.

Defined results: null, empty and blank texts have no units; offsets are code points, half-open, without
surrounding white space; invisible characters and styled letters are looked through.
"""

import math
import pickle
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed

ORDER = 4
#: Words seen less often count as their shape, as do numbers and capitalised words that are neither abbreviated nor seen in lower case.
SEEN = 8
#: How likely it is beforehand that a stretch of text has sentences without marks between them.
UNMARKED = 0.002
#: Order of the model of text without end marks.
BARE = 3
#: Odds in favour of a boundary, since records that hold several sentences hide some in training.
BIAS = 2.0
#: A gap behind the same word and end mark is taken as cut wherever at least this share of them ends a record.
SURE = 0.75
CACHE = 200_000
EDGE = "<s>"

_ENDS = ".!?。！？।॥؟۔…‽⁇⁈⁉．｡"
_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "《": "》", "(": ")", "（": "）", "‹": "›", "[": "]", "【": "】"}
_CLOSE = "”“»」』》)）›]】\"’'"
_WIDE = r"぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff฀-໿က-႟ក-៿"
_LETTER = rf"(?![{_WIDE}])[^\W\d_]"
_MARKS = "̀-ͯؐ-ًؚ-ٟऀ-ःऺ-ॏॢॣ"
_TOKEN = re.compile(
    rf"[{_WIDE}]|\d+(?:[.,:/\-]\d+)*(?:{_LETTER})*|{_LETTER}{{1,2}}(?:\.{_LETTER}{{1,2}})+(?!\w)"
    rf"|(?:{_LETTER})(?:(?![{_WIDE}])[^\W_]|[{_MARKS}])*(?:['’\-/](?:(?![{_WIDE}])[^\W_]|[{_MARKS}])+)*|[{re.escape(_ENDS)}]+|\S"
)
_BLANK_LINE = re.compile(r"(?:\r\n|\n|\r| )[^\S\n\r]*(?:\r\n|\n|\r| )\s*| ")
_ROMAN = re.compile(r"[IVX]+")
_UNSEEN = re.compile(r"[­᠎​-‏⁠-⁤﻿０-９Ａ-Ｚａ-ｚ\U0001d400-\U0001d7ff]")
_HIDDEN = re.compile(r"[­᠎​-‏⁠-⁤﻿]")


def _shape(w: str) -> str:
    if w.isdigit():
        return f"<{min(len(w), 4)}>"
    if w[0].isdigit():
        return "<n.>" if w.replace(".", "").replace(",", "").isdigit() else "<nx>"
    if 1 < len(w) <= 3 and w[0].isupper() and w[1:].islower():
        return "<Xx3>"
    if len(w) == 1:
        return "<X>" if w.isupper() else "<x>" if w.islower() else "<o>" if w.isalpha() else w
    if w.isupper():
        return "<XX>"
    return "<Xx>" if w[0].isupper() else "<xx>" if w[0].islower() else "<oo>" if w[0].isalpha() else w


class Block:
    """Tokens of a block with their offsets; ``gaps`` are the indexes of tokens behind which a boundary may stand."""

    __slots__ = ("words", "spans", "gaps", "inside")

    def __init__(self, text: str, start: int, end: int):
        words, spans = [], []
        for m in _TOKEN.finditer(text, start, end):
            words.append(m[0])
            spans.append(m.span())
        self.words, self.spans, self.gaps, self.inside = words, spans, [], []
        self._mark()

    def _mark(self) -> None:
        words, n = self.words, len(self.words)
        partner, stack, straight = {}, [], None
        for i, w in enumerate(words):
            if w == '"':
                if straight is None:
                    straight = i
                else:
                    partner[straight], straight = i, None
            elif stack and w == stack[-1][0]:
                partner[stack.pop()[1]] = i
            elif w in _OPEN:
                stack.append((_OPEN[w], i))
        inside, closes = [False] * n, {}
        for a, b in partner.items():
            for k in range(a + 1, b):
                inside[k] = True
            first = a == 0 or words[a - 1][-1] in _ENDS or (words[a - 1] in _CLOSE and a > 1 and words[a - 2][-1] in _ENDS)
            closes[b] = words[b] + ("S" if first else "M")
        out = list(words)
        for b, name in closes.items():
            out[b] = name
        for i, w in enumerate(words):
            if w[0] in _ENDS and w[-1] in _ENDS:
                if inside[i]:
                    out[i] = w + "q"
                j = i
                while j + 1 < n and ((j + 1) in closes or words[j + 1] in "’'" and self.spans[j + 1][0] == self.spans[j][1]):
                    j += 1
                if j + 1 < n and not inside[j] and (j > i or not inside[i]):
                    a, b = self.spans[j][1], self.spans[j + 1][0]
                    following = words[j + 1]
                    if a == b and w[-1] in ".…" and i == j and not (following[0].isupper() and i and (len(words[i - 1]) > 2 or words[i - 1] in _CLOSE or _ROMAN.fullmatch(words[i - 1]))) and not re.match(rf"[{_WIDE}]", following):
                        continue
                    self.gaps.append(j)
        self.words, self.inside = out, inside


class _Memo(dict):
    """What a function says of words, remembered for ``CACHE`` of them."""

    def __init__(self, f: Callable):
        self.f = f

    def __missing__(self, w: str):
        if len(self) > CACHE:
            self.clear()
        got = self[w] = self.f(w)
        return got


@lru_cache(CACHE)
def _hash(w: str) -> int:
    return int.from_bytes(blake2b(w.encode(errors="surrogatepass"), digest_size=8).digest(), "little")


def hashed(gram: tuple, start: int = 1) -> int:
    """64 bits for an n-gram; ``start`` is the hash of what stands before it."""
    for w in gram:
        start = (start * 0x9E3779B97F4A7C15 + _hash(w)) & 0xFFFFFFFFFFFFFFFF
    return start


class Hashed:
    """What is known of n-grams, by their hashes, in sorted arrays."""

    __slots__ = ("keys", "values", "starts", "shift")

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order, bits = np.argsort(keys), max(0, len(keys).bit_length() - 3)
        self.keys, self.shift = array("Q", keys[order].tobytes()), 64 - bits
        self.values = [array("q", v[order].astype(np.int64).tobytes()) for v in values]
        tops = keys[order] >> np.uint64(self.shift) if bits else keys
        self.starts = array("q", np.searchsorted(tops, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64).tobytes())

    def __len__(self) -> int:
        return len(self.keys)

    def get(self, gram: tuple, default=None):
        k = hashed(gram)
        top = k >> self.shift
        end = self.starts[top + 1]
        i = bisect_left(self.keys, k, self.starts[top], end)
        if i == end or self.keys[i] != k:
            return default
        return self.values[0][i] if len(self.values) == 1 else tuple(v[i] for v in self.values)


def _count(counts: Counter, line: list[str], order: int, everywhere: bool) -> None:
    """Counts the n-grams of a document: near boundaries and end marks, or ``everywhere``."""
    if everywhere:
        for k in range(order):
            counts.update(zip(line[1:]) if not k else zip(*(line[i:] for i in range(k + 1))))
        return
    near = [i for i, w in enumerate(line) if w == EDGE or w[0] in _ENDS]
    wanted = sorted({j for i in near for j in range(i, min(i + order, len(line)))} - {0})
    for k in range(order):
        counts.update([tuple(line[j - k : j + 1]) for j in wanted if j >= k])


def _vocabulary(seen: dict[str, int], dotted: dict[str, int]) -> frozenset:
    """Words that stand for themselves, of words with their numbers and how many of them stand before a full stop."""
    name = lambda w, k: w[0].isupper() and len(w) > 3 and seen.get(w.lower(), 0) < SEEN and dotted.get(w, 0) < 0.5 * k
    return frozenset(w for w, k in seen.items() if k >= SEEN and not w[0].isdigit() and not name(w, k))


class Model:
    """Interpolated n-gram counts (Witten-Bell) of the tokens near boundaries and end marks."""

    def __init__(self, order: int = ORDER):
        self.order, self.vocabulary = order, frozenset()
        self.counts: dict[tuple, int] | Hashed = {}
        self.totals: dict[tuple, tuple[int, int]] | Hashed = {}
        self.cache: dict[tuple, tuple] = {}
        self.known: dict[tuple, float] = {}
        self.names = _Memo(self.name)
        #: A model of text without end marks, and from how many tokens on a stretch is taken for such text: (ended by a mark, script without blanks) -> tokens.
        self.bare: Model | None = None
        self.long: dict[tuple[bool, bool], int] = {}

    def name(self, w: str) -> str:
        return w if w in self.vocabulary else _shape(w)

    def line(self, units: list[list[str]]) -> list[str]:
        """The names of a document's units, with boundaries."""
        out = [EDGE]
        for u in units:
            out += [*map(self.names.__getitem__, u), EDGE]
        return out

    @classmethod
    def trained(cls, sequences: list[list[list[str]]], order: int = ORDER, everywhere: bool = False) -> "Model":
        """``sequences``: for each record its units, each a list of tokens. Counts are taken near boundaries and end marks, or ``everywhere``."""
        m = cls(order)
        seen = Counter(w for units in sequences for u in units for w in u)
        dotted = Counter(a for units in sequences for u in units for a, b in zip(u, u[1:]) if b == ".")
        m.vocabulary = _vocabulary(seen, dotted)
        counts: Counter[tuple] = Counter()
        for units in sequences:
            _count(counts, m.line(units), order, everywhere)
        m.counts = {g: c for g, c in counts.items() if len(g) < 3 or c > 1 or EDGE in g[-1:]}
        totals: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
        for g, c in m.counts.items():
            t = totals[g[:-1]]
            t[0] += c
            t[1] += 1
        m.totals = {h: (a, b) for h, (a, b) in totals.items()}
        return m

    def p(self, history: tuple, w: str) -> float:
        key = (*history, w)
        got = self.known.get(key)
        if got is None:
            t = self.totals.get(history)
            lower = self.p(history[1:], w) if history else 1e-6
            got = lower if t is None else (self.counts.get(key, 0) + t[1] * lower) / (t[0] + t[1])
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[key] = got
        return got

    def _chain(self, tokens: tuple, gaps: tuple, bias: float = BIAS) -> tuple:
        """Posteriors of the gaps (indexes of tokens before them) in one chain, by forward-backward over inserted boundaries."""
        h = self.order - 1
        first = gaps[0]
        state = tuple(tokens[max(0, first + 1 - h) : first + 1])
        steps = []
        alive = {state: 1.0}
        marks = set(gaps)
        for j in range(first, len(tokens) - 1):
            into: dict[tuple, list] = defaultdict(list)
            nxt: dict[tuple, float] = defaultdict(float)
            for s, a in alive.items():
                options = [(0, 1.0, s)]
                if j in marks:
                    options.append((1, bias * self.p(s, EDGE), (*s, EDGE)[-h:]))
                for cut, q, t in options:
                    q *= self.p(t, tokens[j + 1])
                    u = (*t, tokens[j + 1])[-h:]
                    nxt[u] += a * q
                    into[u].append((s, q, cut))
            scale = sum(nxt.values()) or 1.0
            alive = {u: a / scale for u, a in nxt.items()}
            steps.append((j, into, scale, alive))
        back = dict.fromkeys(alive, 1.0)
        post = {}
        before = [{state: 1.0}] + [x[3] for x in steps[:-1]]
        for (j, into, scale, _), start in zip(reversed(steps), reversed(before)):
            earlier: dict[tuple, float] = defaultdict(float)
            cut_mass = total = 0.0
            for u, sources in into.items():
                b = back.get(u, 0.0)
                for s, q, cut in sources:
                    x = q * b / scale
                    earlier[s] += x
                    mass = start[s] * x
                    total += mass
                    if cut:
                        cut_mass += mass
            if j in marks:
                post[j] = cut_mass / total if total else 0.0
            back = earlier
        return tuple(post[g] for g in gaps)

    def boundaries(self, block: Block) -> list[int]:
        """Indexes of tokens behind which a unit ends, inside the block."""
        cuts = self._marked(block) if block.gaps else []
        if self.bare is None or len(block.words) < min(self.long.values()):
            return cuts
        found, start = [], 0
        for end in [*(g + 1 for g in cuts), len(block.words)]:
            found += self._unmarked(block, start, end)
            start = end
        return sorted([*cuts, *found])

    def _unmarked(self, block: Block, start: int, end: int) -> list[int]:
        """Boundaries between tokens ``start`` and ``end``, if a single unit is hardly so long."""
        words = [w for w in block.words[start:end] if w[0] not in _ENDS]
        if len(words) < min(self.long.values()) or len(words) < self.long[_kind(block.words[start:end])]:
            return []
        places = [j for j in range(start, end) if block.words[j][0] not in _ENDS]
        gaps = tuple(k for k, j in enumerate(places[:-1]) if not block.inside[j] and places[k + 1] == j + 1)
        if not gaps:
            return []
        names = [self.bare.names[w] for w in words]
        post = self.bare._chain((EDGE, *names, EDGE), tuple(g + 1 for g in gaps), 1.0)
        return [places[g] for g, p in zip(gaps, post) if p > 0.5]

    def _marked(self, block: Block) -> list[int]:
        words, h, out = block.words, self.order - 1, []
        k, gaps, n = 0, block.gaps, len(block.words)
        while k < len(gaps):
            j = k
            while j + 1 < len(gaps) and gaps[j + 1] - gaps[j] <= h:
                j += 1
            lo, hi = max(0, gaps[k] + 1 - h), min(n, gaps[j] + 1 + h)
            before, after = (EDGE,) * (gaps[k] + 1 < h), (EDGE,) * (gaps[j] + 1 + h > n)
            key = ((*before, *map(self.names.__getitem__, words[lo:hi]), *after), tuple(g - lo + len(before) for g in gaps[k : j + 1]))
            post = self.cache.get(key)
            if post is None:
                if len(self.cache) > CACHE:
                    self.cache.clear()
                post = self.cache[key] = self._chain(*key)
            out += [g for g, p in zip(gaps[k : j + 1], post) if p > 0.5]
            k = j + 1
        return out


_WIDE_SIGN = re.compile(rf"[{_WIDE}]")
_is_wide = _Memo(lambda w: _WIDE_SIGN.match(w) is not None)
_is_word = _Memo(lambda w: w[0] not in _ENDS)
_is_bare = _Memo(lambda w: w[0] not in _ENDS and not (w[0] in _CLOSE and w[-1] in "SM"))


def _kind(words: list[str]) -> tuple[bool, bool]:
    """Whether an end mark stands among the last tokens, and whether half the tokens are of a script without blanks."""
    return any(w[0] in _ENDS for w in words[-3:]), 2 * sum(map(_is_wide.__getitem__, words)) >= len(words)


def _long(lengths: dict[tuple[bool, bool], Counter]) -> dict[tuple[bool, bool], int]:
    """From how many words on a unit of each kind is long: the least length that fewer than the share UNMARKED of such units have, or any unit if that is more. ``lengths`` has the number of units of each length."""
    out, most = {}, max((n for c in lengths.values() for n in c), default=0)
    for kind in ((a, b) for a in (False, True) for b in (False, True)):
        of = lengths.get(kind, {})
        total, below = sum(of.values()), 0
        at = min(total - 1, int(total * (1 - UNMARKED)))
        out[kind] = 2 + most
        for n in sorted(of):
            below += of[n]
            if below > at:
                out[kind] = max(2, n + 1)
                break
    return out


def _length(unit: list[str]) -> int:
    return sum(map(_is_word.__getitem__, unit))


def _bared(units: list[list[str]]) -> list[list[str]]:
    return [c for u in units if (c := [*filter(_is_bare.__getitem__, u)])]


def _with_bare(model: Model, sequences: list[list[list[str]]]) -> Model:
    """``model`` with what it needs to know of unpunctuated text."""
    lengths: dict[tuple[bool, bool], Counter] = defaultdict(Counter)
    for u in (u for doc in sequences for u in doc if u):
        lengths[_kind(u)][_length(u)] += 1
    model.long = _long(lengths)
    model.bare = Model.trained([_bared(doc) for doc in sequences], BARE, everywhere=True)
    model.bare.counts = {g: c for g, c in model.bare.counts.items() if len(g) < 2 or c > 1 or EDGE in g}
    return model


def _blocks(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _BLANK_LINE.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def units(model: Model, text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each unit of a text."""
    if not text or not text.strip():
        return []
    places, read = None, text
    if _UNSEEN.search(text):
        places = [i for i, c in enumerate(text) if not _HIDDEN.match(c)]
        read = "".join(n if len(n := unicodedata.normalize("NFKC", text[i])) == 1 and _UNSEEN.match(text[i]) else text[i] for i in places)
        places.append(len(text))
    out = []
    for start, end in _blocks(read):
        block = Block(read, start, end)
        at = start
        for e in [*(block.spans[j][1] for j in model.boundaries(block)), end]:
            piece = read[at:e]
            if s := piece.strip():
                a = at + len(piece) - len(piece.lstrip())
                b = a + len(s)
                out.append((a, b) if places is None else (places[a], places[b - 1] + 1))
            at = e
    return out


def _cut(b: Block, at: list[int]) -> list[list[str]]:
    parts, last = [], 0
    for j in at:
        parts.append(b.words[last : j + 1])
        last = j + 1
    return [*parts, b.words[last:]] if last < len(b.words) else parts


def _ending(b: Block, j: int) -> tuple[str, str]:
    """The token at ``j`` and the one before it."""
    return b.words[j - 1] if j else "", b.words[j]


def _sequence(doc: list[Block], cuts: Callable[[Block], list[int]], never: set[tuple[str, str]]) -> list[list[str]]:
    """Units of a document: its blocks cut, and joined behind what hardly ever ends a record."""
    found: list[list[str]] = []
    torn = False
    for b in doc:
        parts = _cut(b, cuts(b))
        if torn:
            found[-1] = [*found[-1], *parts.pop(0)]
        found += parts
        torn = _ending(b, len(b.words) - 1) in never
    return found


def _sure(sure: set[tuple[str, str]]) -> Callable[[Block], list[int]]:
    return lambda b: [j for j in b.gaps if _ending(b, j) in sure]


def _read(texts: list[str]) -> list[Block]:
    return [b for t in texts if t for s, e in _blocks(t) if (b := Block(t, s, e)).words]


def _count_endings(doc: list[Block], all_: Counter, ends: Counter) -> None:
    for b in doc:
        ends[_ending(b, len(b.words) - 1)] += 1
        for j in {*b.gaps, len(b.words) - 1}:
            all_[_ending(b, j)] += 1


def trained_model(documents: list[list[str]]) -> Model:
    """``documents``: the texts of each document's records, in order. Records are first cut where the word and end mark before a gap mostly end a record, then where the model of that finds boundaries."""
    blocks = [_read(texts) for texts in documents]
    ends: Counter[tuple] = Counter()
    all_: Counter[tuple] = Counter()
    for doc in blocks:
        _count_endings(doc, all_, ends)
    sure = {k for k, n in all_.items() if n >= 4 and ends[k] >= SURE * n}
    never = {k for k, n in all_.items() if n >= 4 and ends[k] <= (1 - SURE) * n}
    model = Model.trained([_sequence(doc, _sure(sure), never) for doc in blocks])
    found = [_sequence(doc, model.boundaries, never) for doc in blocks]
    return _with_bare(Model.trained(found), found)


def _rows(names: list[str], kinds: list[pa.DataType], rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _tokenised(records: DataFrame) -> DataFrame:
    """(blocks) for each document, its records in order, each sentence once: words and gaps of each block, pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[bytes] = []
        for _, doc in groupby(rows, lambda r: r[0]):
            texts: dict[str, str] = {}
            for _, i, text in doc:
                texts.setdefault(i, text)
            out.append(pickle.dumps([(b.words, b.gaps) for b in _read(list(texts.values()))]))
            if len(out) == 1000:
                yield _rows(["blocks"], [pa.binary()], zip(out))
                out = []
        yield _rows(["blocks"], [pa.binary()], zip(out))

    rows = records.where(F.col("text").isNotNull() & F.col("document_id").isNotNull()).select("document_id", "sentence_index", "sentence_id", "text").repartition("document_id")
    return rows.sortWithinPartitions("document_id", "sentence_index", "sentence_id", "text").select("document_id", "sentence_id", "text").mapInArrow(run, "blocks binary")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Block]]:
    for batch in batches:
        for x in batch.column(0).to_pylist():
            doc = []
            for words, gaps in pickle.loads(x):
                b = Block.__new__(Block)
                b.words, b.gaps, b.spans, b.inside = words, gaps, [], []
                doc.append(b)
            yield doc


_WORDS, _ENDINGS = 0, 1


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, a, b, n, m, gaps): words with their number and how many stand before a full stop; the last tokens of gaps and blocks with their number, how many end a block and how many are gaps."""
    seen, dotted, all_, ends, gaps = (Counter() for _ in range(5))

    def rows() -> pa.RecordBatch:
        found = [(_WORDS, w, "", n, dotted[w], 0) for w, n in seen.items()] + [(_ENDINGS, *k, n, ends[k], gaps[k]) for k, n in all_.items()]
        for c in (seen, dotted, all_, ends, gaps):
            c.clear()
        return _rows(["what", "a", "b", "n", "m", "gaps"], [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()], found)

    for doc in _documents(batches):
        _count_endings(doc, all_, ends)
        for b in doc:
            gaps.update([_ending(b, j) for j in b.gaps])
            seen.update(b.words)
            dotted.update([v for v, w in zip(b.words, b.words[1:]) if w == "."])
        if len(seen) + len(all_) > CACHE:
            yield rows()
    yield rows()


_MAIN, _BARE, _LENGTHS = 0, 1, 2


def _gram_counter(order: int, vocabulary: frozenset, bare: frozenset | None, cuts: Callable[[], Callable[[Block], list[int]]], never: set[tuple[str, str]]):
    """(model, key, history, kept, n): numbers of n-grams by the hash of all and of all but the last token; ``kept``: 1 if they stay in the model's totals however rare, 2 if in the bare model's counts. With the ``bare`` vocabulary also those of the bare model, and the lengths of units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        main, plain, cut = Model(order), Model(BARE), cuts()
        main.vocabulary, plain.vocabulary = vocabulary, bare or frozenset()
        counts: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())

        def rows() -> pa.RecordBatch:
            found = []
            for model in (_MAIN, _BARE):
                for g, n in counts[model].items():
                    history = hashed(g[:-1])
                    found.append((model, hashed(g[-1:], history), history, (len(g) < 3 or g[-1] == EDGE) + 2 * (len(g) < 2 or EDGE in g), n))
            found += [(_LENGTHS, 4 * n + 2 * marked + wide, 0, 1, k) for (marked, wide, n), k in counts[_LENGTHS].items()]
            for c in counts:
                c.clear()
            return _rows(["model", "key", "history", "kept", "n"], [pa.int8(), pa.uint64(), pa.uint64(), pa.int8(), pa.int64()], found).cast(pa.schema([("model", pa.int8()), ("key", pa.int64()), ("history", pa.int64()), ("kept", pa.int8()), ("n", pa.int64())]), safe=False)

        for doc in _documents(batches):
            units = _sequence(doc, cut, never)
            _count(counts[_MAIN], main.line(units), order, False)
            if bare is not None:
                _count(counts[_BARE], plain.line(_bared(units)), BARE, True)
                counts[_LENGTHS].update([(*_kind(u), _length(u)) for u in units if u])
            if len(counts[_MAIN]) + len(counts[_BARE]) > CACHE:
                yield rows()
        yield rows()

    return run


def _of_grams(found: pa.Table, which: int, order: int, vocabulary: frozenset) -> Model:
    """The model ``which`` of collected rows (model, key, history, kept, n)."""
    own = found.filter(pa.compute.equal(found["model"], which))
    key, history = (own[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("key", "history"))
    kept, n = own["kept"].to_numpy(), own["n"].to_numpy()
    m = Model(order)
    m.vocabulary = vocabulary
    used = (n > 1) | (kept >= 2) if which == _BARE else np.ones(len(n), dtype=bool)
    m.counts = Hashed(key[used], n[used])
    histories, at, types = np.unique(history, return_inverse=True, return_counts=True)
    totals = np.zeros(len(histories), dtype=np.int64)
    np.add.at(totals, at, n)
    m.totals = Hashed(histories, totals, types)
    return m


def fitted(records: DataFrame) -> Model:
    """``trained_model`` of all sentence records (document_id, sentence_index, sentence_id, text) with a text and a document, each sentence of a document once."""
    blocks = checkpointed(_tokenised(records))
    words = blocks.mapInArrow(_word_counter, "what int, a string, b string, n bigint, m bigint, gaps bigint").groupBy("what", "a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "m", "gaps")))
    ending = F.col("n").cast("double") * SURE <= F.col("m")
    wanted = F.when(F.col("what") == _WORDS, F.col("n") >= SEEN).otherwise((F.col("n") >= 4) & (ending & (F.col("gaps") > 0) | (F.col("m") <= F.col("n") * (1 - SURE))))
    seen: dict[str, int] = {}
    dotted: dict[str, int] = {}
    sure, never = set(), set()
    for what, a, b, n, m in zip(*(c.to_pylist() for c in words.where(wanted).select("what", "a", "b", "n", "m").toArrow().columns), strict=True):
        if what == _WORDS:
            seen[a], dotted[a] = n, m
        else:
            if m >= SURE * n:
                sure.add((a, b))
            if m <= (1 - SURE) * n:
                never.add((a, b))
    vocabulary, bare = _vocabulary(seen, dotted), _vocabulary({w: n for w, n in seen.items() if _is_bare[w]}, {})

    def grams(cuts, bare=None) -> pa.Table:
        rows = blocks.mapInArrow(_gram_counter(ORDER, vocabulary, bare, cuts, never), "model tinyint, key bigint, history bigint, kept tinyint, n bigint")
        return rows.groupBy("model", "key").agg(F.first("history").alias("history"), F.first("kept").alias("kept"), F.sum("n").alias("n")).where("n > 1 OR kept % 2 = 1").toArrow()

    state = _state(_of_grams(grams(lambda: _sure(sure)), _MAIN, ORDER, vocabulary))
    found = grams(lambda: _restored(state).boundaries, bare)
    model = _of_grams(found, _MAIN, ORDER, vocabulary)
    model.bare = _of_grams(found, _BARE, BARE, bare)
    lengths: dict[tuple[bool, bool], Counter] = defaultdict(Counter)
    for x, n in zip(*(found.filter(pa.compute.equal(found["model"], _LENGTHS))[c].to_pylist() for c in ("key", "n")), strict=True):
        lengths[bool(x & 2), bool(x & 1)][x >> 2] += n
    model.long = _long(lengths)
    return model


def _state(model: Model) -> tuple:
    return model.order, model.vocabulary, model.counts, model.totals, model.long, _state(model.bare) if model.bare else None


def _restored(state: tuple) -> Model:
    model = Model(state[0])
    model.vocabulary, model.counts, model.totals, model.long = state[1:5]
    model.bare = _restored(state[5]) if state[5] else None
    return model


def _segmenter(state: tuple, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _restored(state)
        for batch in batches:
            kinds, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            cols: tuple[list, ...] = ([], [], [], [], [])
            for kind, i, text in zip(kinds, ids, texts, strict=True):
                found = units(model, text)
                if len(found) < least:
                    continue
                for no, (a, b) in enumerate(found, 1):
                    for c, v in zip(cols, (kind, i, no, a, b), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["record_kind", "record_id", "sent_no", "start_char", "end_char"])

    return run


def segmented(rows: DataFrame, model: Model, least: int = 1) -> DataFrame:
    """(record_kind, record_id, sent_no, start_char, end_char) of all units of rows (record_kind, record_id, text) that have at least ``least``."""
    state = _state(model)
    return rows.select("record_kind", "record_id", "text").mapInArrow(_segmenter(state, least), "record_kind string, record_id string, sent_no bigint, start_char bigint, end_char bigint")
