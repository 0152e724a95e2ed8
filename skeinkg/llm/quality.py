"""Per-document text statistics, and from them prose, list, table or junk.

Statistics are taken line by line of the visible text, where ``markup`` has read it and in the same task: every
character of a batch is classed by one table lookup, and counts of lines and tokens are sums over those
classes, so a text is passed over a few times by array operations and by patterns only where a count calls for them.
Nothing is shuffled. A line has signs (set off by marks, made of cells, misread, ...), and a document's statistic
for a sign is the share of its visible characters that stand in such lines.

The kind comes from an ordered rule list that is induced from labelled documents by incremental reduced-error
pruning: for each class, rarest first, a rule is grown on two thirds of the labelled documents by information gain,
pruned on the last third, and kept while it is right on more than half of what it covers there. Which statistics
count and where they are cut is learned alone; a class without labelled documents, or none of whose rules survives,
is never assigned. The rules are exported to one SQL CASE and applied by it.

Only the fitting looks at a sample: at most about ``LABELLED`` labelled documents, those with the least hashes of id.

Defined results: null, empty and blank texts give no row; labels that are null, unknown or evenly disputed
are left out of the fitting; without any labels everything is prose.
"""

import re
import sys
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sample import least_hashed
from . import markup

#: Labelled documents that the rules are fitted to, at most.
LABELLED = 20_000
#: Common words that are looked up; more are refused.
MOST_COMMON = 100_000
#: Characters that are classed at a time, about.
CHUNK = 100_000
KINDS = ("list", "table", "junk")

_HAN, _KANA = "\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff", "\u3040-\u30ff\uff66-\uff9d"
_ENDS = re.compile(r"[.!?。！？।؟…‽][\"'”’»›」』）)\]]*$")
_MARKER = re.compile(r"\s*(?:[•‣·▪◦●○■∙*+➤►-]\s*|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)]\s+|No\.?\s*\d+\s*:|[#№]\s?\d+|\d{3,4}\s*[:：]|\[\d+\])")
_INDEX = re.compile(r"[^,;]{2,60},\s*\d{1,4}(?:,\s*\d{1,4}(?:\s?[–-]\s?\d{1,4})?){1,8}")
_HEX = re.compile(r"\s*(?:[0-9a-fA-F]{4,8}[:\s]\s*)?(?:[0-9a-fA-F]{2}\s){4}[0-9a-fA-F]{2}(?:\s[0-9a-fA-F:\s]*)?")
_CRAMPED = re.compile(r"(?i)^[bcdfghjklmnpqrstvwxz]{4,}$|[bcdfghjklmnpqrstvwxz]{5,}|^q[^u]|[jqvwx]{2}|[bcdfghjklmnpqrstvwxz]{2,}[jqx]|[jqx][bcdfghjklmnpqrstvwxz]{2,}")
_BREAK = re.compile(r"[.!?]\s+\S|[。！？]\s*\S")
_BARS, _COMMAS, _GAPS = re.compile(r"\s[|¦›»·]\s"), re.compile("[,;]"), re.compile(" {2,}")
_VALUE = re.compile(r"\s*(?:-?\d+(?:\.\d+)?|[A-Z]-?\d+(?:/\d+)?|n/a|-)?\s*")
_KEYED = re.compile(r"[^:：;]{1,40}:")
_LOOSE_COMMA, _OPEN_END = re.compile(r"[,;]\s"), re.compile(r"[,，、—:：]\s*$")

LETTER, MARK, NUMBER, SPACE, HAN, KANA, ALPHA, LOWER, CAPITAL, CODED, PIERCE, STRAY, PLAIN, LONE, GARBLED = (1 << k for k in range(15))


@lru_cache(1)
def _classes() -> np.ndarray:
    """The classes of every code point as bits."""
    table = np.zeros(sys.maxunicode + 1, np.uint16)
    for cp in range(0x40000):
        k = unicodedata.category(chr(cp))[0]
        table[cp] = {"L": LETTER, "M": MARK, "N": NUMBER}.get(k, 0)
    for chars, bit in (("\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))), SPACE), (";:|'!,", PIERCE), (";:|'!^+=&%@,", STRAY), (",.、،\"'`“”„‘’«»‹›()[]…–—-", PLAIN), ("01lIO", LONE), ("+/", CODED), ("‘’‚‛“”„‟†‡•‣․‥…‰‹›€™ŒœŠšŸŽžƒˆ˜\ufffd", GARBLED)):
        for c in chars:
            table[ord(c)] |= bit
    for lo, hi, bit in ((0x3400, 0x9FFF, HAN), (0xF900, 0xFAFF, HAN), (0x20000, 0x3FFFF, HAN), (0x3040, 0x30FF, KANA), (0xFF66, 0xFF9D, KANA), (65, 90, ALPHA | CAPITAL | CODED), (97, 122, ALPHA | LOWER | CODED), (48, 57, CAPITAL | CODED), (0x80, 0xBF, GARBLED), (0x2018, 0x203A, GARBLED)):
        table[lo : hi + 1] |= bit
    return table


@lru_cache(1)
def _lower() -> np.ndarray:
    """The lower case of every code point that has one of one code point."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint64)
    for cp in range(0x20000):
        if len(x := chr(cp).lower()) == 1:
            table[cp] = ord(x)
    return table


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def hashes(text: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of code points, ignoring case: differences of prefix sums."""
    if len(_powers[0]) <= len(text):
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * len(text), base, np.uint64))), dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_lower()[np.minimum(text, sys.maxunicode)] + np.uint64(1)) * _powers[0][: len(text)], dtype=np.uint64)))
    return (sums[end] - sums[first]) * _powers[1][first]


def word_hashes(words: frozenset[str]) -> np.ndarray:
    """Sorted ``hashes`` of whole words."""
    rows = [np.array([ord(c) for c in w], np.uint32) for w in words if w]
    return np.unique(np.array([hashes(r, np.array([0]), np.array([len(r)]))[0] for r in rows], np.uint64))


@lru_cache(1)
def _word() -> re.Pattern:
    marks, k = [], 0
    table = _classes()
    while k < 0x40000:  # runs of combining marks, which Python doesn't count as parts of words
        j = k
        while j < 0x40000 and table[j] & MARK:
            j += 1
        if j > k:
            marks.append(f"{re.escape(chr(k))}-{re.escape(chr(j - 1))}")
        k = j + 1
    return re.compile(rf"[{_HAN}]|[^\W_{_HAN}{_KANA}]+(?:[{''.join(marks)}]+[^\W_{_HAN}{_KANA}]*)*|[{_KANA}]+|(?:[{''.join(marks)}]+[^\W_{_HAN}{_KANA}]*)+")


class Lines:
    """Counts for each of some lines (none empty or blank); the arrays have one element a line."""

    def __init__(self, lines: list[str], common: np.ndarray = np.array([], np.uint64)):
        sizes = np.array([len(x) + 1 for x in lines], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        text = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _classes()[np.minimum(text, sys.maxunicode)]
        per = lambda mask: np.add.reduceat(mask.astype(np.int32), starts)
        is_ = lambda bits: (c & bits) != 0
        space, alnum = is_(SPACE), is_(LETTER | MARK | NUMBER)
        self.visible, self.size = per(~space), sizes - 1
        self.numbers = per(is_(NUMBER))
        self.symbols = per(~alnum & ~space)
        self.letters = np.maximum(self.visible - self.symbols - self.numbers, 0)
        kind = np.where(is_(HAN), 1, np.where(is_(KANA), 2, np.where(alnum, 3, 0))).astype(np.int8)
        word = kind > 0
        before = np.concatenate(([0], kind[:-1]))
        opens = word & ((kind == 1) | (kind != before))
        self.words, self.word_chars = per(opens), per(word)
        wide = (text >= 0xC2) & (text <= 0xF4)
        garbled = wide[:-1] & (is_(GARBLED)[1:])
        lost = text == 0xFFFD
        lost[1:] &= ~wide[:-1]
        self.misread = per(lost | np.append(garbled, False))
        # tokens are runs without white space; a line ends with white space, so none crosses lines
        line = np.repeat(np.arange(len(lines)), sizes)
        edge = np.diff(np.concatenate(([1], space.astype(np.int8))))
        a, b = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not space[0]:
            a = np.concatenate(([0], a)) if not len(a) or a[0] else a
        self._tokens(c, text, a, b, line[a], len(lines))
        first, end = np.flatnonzero(opens), np.flatnonzero(word & ((kind == 1) | (kind != np.append(kind[1:], 0)))) + 1
        names = hashes(text, first, end)
        order = np.lexsort((names, line[first]))
        there, sorted_ = line[first][order], names[order]
        new = np.ones(len(order), bool)
        new[1:] = (there[1:] != there[:-1]) | (sorted_[1:] != sorted_[:-1])
        self.distinct = np.bincount(there[new], minlength=len(lines))
        at = np.minimum(np.searchsorted(common, names), max(len(common) - 1, 0))
        self.common = np.bincount(line[first][common[at] == names], minlength=len(lines)) if len(common) else np.zeros(len(lines), np.int64)
        coded = np.concatenate(([0], is_(CODED).astype(np.int8)))
        step = np.diff(coded)
        runs, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.coded = np.bincount(line[runs[ends - runs >= 32]], minlength=len(lines)) > 0

    def _tokens(self, c: np.ndarray, text: np.ndarray, a: np.ndarray, b: np.ndarray, line: np.ndarray, lines: int) -> None:
        n = b - a
        count = lambda keep, weights=None: np.bincount(line[keep], None if weights is None else weights[keep], minlength=lines)
        summed = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        within = lambda s: s[b] - s[a]
        is_ = lambda bits: (c & bits) != 0
        alnum, alpha, pierce, stray = is_(LETTER | MARK | NUMBER), is_(ALPHA), is_(PIERCE), is_(STRAY)
        short = (n <= 3) & (within(summed(alnum)) == 0)
        plain = short & (within(summed(is_(PLAIN))) == n)
        self.tokens, self.loose, self.odd_marks = count(n > 0), count(short), count(short & ~plain)
        last = np.zeros(lines, np.int64)
        last[line] = np.arange(len(a))  # the last token of each line
        self.bare = short[last] & (self.tokens > 1) if len(a) else np.zeros(lines, bool)
        # torn tokens: pierced by marks, capitals or digits inside words, lone strokes
        pad = lambda x, k: np.append(x[k:], np.zeros(k, x.dtype))
        at = np.where(~alpha, np.arange(len(c)), len(c) - 1)
        after = np.minimum.accumulate(at[::-1])[::-1]  # the next that is no ASCII letter
        quote = text == ord("'")
        torn = alpha & pad(pierce, 1) & pierce[pad(after, 2)]
        torn |= alpha & pad(pierce & ~quote, 1) & pad(alpha, 2)
        torn |= is_(LOWER) & pad(is_(CAPITAL), 1) & pad(alpha, 2)
        ascii_ = is_(LOWER | CAPITAL)
        broken = within(summed(torn)) > 0
        broken |= pierce[a] & (n > 1) & ascii_[np.minimum(a + 1, len(c) - 1)]
        marks, tail = within(summed(stray)), within(summed(ascii_))
        s = summed(stray)
        broken |= (marks > 0) & (tail <= 2) & (marks + tail == n) & (s[a + marks] - s[a] == marks)
        bar = text == ord("|")
        back = np.maximum.accumulate(np.where(~bar, np.arange(len(c)), 0))
        broken |= bar[b - 1] & (back[b - 1] >= a) & ascii_[back[b - 1]]
        broken |= (n == 1) & is_(LONE)[a]
        self.torn = count(broken, n.astype(np.float64))


def _small(parts: list[str], most: int) -> bool:
    return all(len(p.strip()) <= most and not _BREAK.search(p) for p in parts)


#: Signs of lines. Unreadable ones come first: a line that has one of them is no entry and no row.
UNREADABLE = ("scrawl", "hex", "code", "menu", "cramped", "torn", "misread", "repeated", "loose")
SIGNS = (*UNREADABLE, "entry", "marked", "short", "cell", "item", "row")


def _signs(line: str, kind: str, i: int, x: Lines, ended: bool) -> list[str]:
    """The signs of one line, the ``i``-th of ``x``."""
    n, size, k = int(x.visible[i]), int(x.size[i]), int(x.words[i])
    if kind != "text":
        return ["item", "entry"] if kind == "list_item" else ["row", "cell"] if kind == "row" else []
    out = []
    if x.symbols[i] > 0.6 * n and n > 3:
        out.append("scrawl")
    if size >= 14 and x.numbers[i] + x.letters[i] == n and _HEX.fullmatch(line) or size >= 14 and ":" in line and _HEX.fullmatch(line):
        out.append("hex")
    if size >= 32 and x.numbers[i] and x.coded[i]:
        out.append("code")
    barred = "|" in line or "¦" in line
    if (barred or "›" in line or "»" in line or "·" in line) and not re.search(r"\d", line) and len(parts := _BARS.split(line)) >= 3 and _small(parts, 20):
        out.append("menu")
    if not ended and k >= 3:
        words = _word().findall(line)
        if sum(1 for w in words if len(w) >= 3 and w.isascii() and w.isalpha()) >= 3 and sum(1 for w in words if _CRAMPED.search(w)) > 0.3 * k:
            out.append("cramped")
    if x.tokens[i] >= 5 and x.torn[i] > 0.3 * n:
        out.append("torn")
    if x.misread[i] > 0.15 * n:
        out.append("misread")
    # words of prose grow about as the root of its length or faster, so long prose isn't poor in words
    if k >= 10 and x.distinct[i] <= min(0.2 * k, 5 * k**0.5, 500):
        out.append("repeated")
    t = int(x.tokens[i])
    if t >= 10:
        # in text that ends with a bare mark, that mark is none of the loose ones, and plain marks alone must be more
        if not ended and x.loose[i] > 0.12 * t or ended and x.bare[i] and (x.odd_marks[i] - 1 > 0.12 * t or x.loose[i] - 1 > 0.25 * t):
            out.append("loose")
    if out:
        return out
    index = size <= 300 and "," in line and bool(_INDEX.fullmatch(line))
    if not index:
        cells = "\t" in line or barred and len(re.split(r"[|¦]", line)) >= 3
        if not cells and not ended and size <= 500:
            cells = "  " in line and len(_GAPS.split(line.strip())) >= 2
            if not cells and ("," in line or ";" in line):
                parts = _COMMAS.split(line)
                values = sum(1 for p in parts if _VALUE.fullmatch(p))
                tight = not _LOOSE_COMMA.search(line)
                m = len(parts)
                cells = (m >= 3 and (m - values <= 1 or values == 0 and tight) or m == 2 and values == 1 and tight) and _small(parts, 40)
                cells = cells or ";" in line and values >= m - 1 and bool(_KEYED.match(line)) and _small(parts, 60)
        if cells:
            return ["cell"]
    marked = bool(_MARKER.match(line)) and (not ended or n <= 40)
    short = n <= 70 and not ended and not _OPEN_END.search(line)
    if marked:
        out.append("marked")
    if short:
        out.append("short")
    if index or n <= 70 and (marked or short):
        out.append("entry")
    return out


FEATURES = ("ended_share", "common_share", "letter_share", "symbol_share", "mean_word_length", "line_length", *(f"{s}_share" for s in SIGNS))
_COUNTS = ("word_count", "mean_word_length", "symbol_share", "ended_share", "common_share", "letter_share", "line_length", *(f"{s}_share" for s in SIGNS))
SCHEMA = "id string, word_count bigint, " + ", ".join(f"{c} double" for c in _COUNTS[1:])


def features_of(ids: list, found: list[list[tuple[str, str]]], common: np.ndarray) -> pa.RecordBatch:
    """The statistics of documents given as blocks (kind, text), some at a time. Formulas are counted where they stand in the text."""
    parts, at, size = [], 0, 0
    for k, blocks in enumerate(found):
        size += sum(len(t) for _, t in blocks)
        if size >= CHUNK or k + 1 == len(found):
            parts.append(_features(ids[at : k + 1], found[at : k + 1], common))
            at, size = k + 1, 0
    return pa.Table.from_batches(parts or [_features([], [], common)]).combine_chunks().to_batches()[0] if sum(map(len, parts)) else _features([], [], common)


def _features(ids: list, found: list[list[tuple[str, str]]], common: np.ndarray) -> pa.RecordBatch:
    lines: list[str] = []
    kinds: list[str] = []
    owner: list[int] = []
    for d, blocks in enumerate(found):
        for kind, text in blocks:
            if kind != "formula":
                for line in text.split("\n") if kind == "text" else (text,):
                    if line.strip():
                        lines.append(line)
                        kinds.append(kind)
                        owner.append(d)
    if not lines:
        return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64()), *(pa.array([], pa.float64()) for _ in _COUNTS[1:])], ["id", *_COUNTS])
    x, of = Lines(lines, common), np.array(owner)
    signs = {s: np.zeros(len(lines)) for s in SIGNS}
    ended = np.zeros(len(lines))
    for i, line in enumerate(lines):
        ended[i] = end = bool(_ENDS.search(line[-40:].rstrip()[-12:]))
        for s in _signs(line, kinds[i], i, x, end):
            signs[s][i] = x.visible[i]
    total = lambda v: np.bincount(of, v, minlength=len(found))
    share = lambda a, b: np.divide(a, b, out=np.zeros(len(found)), where=b > 0)
    visible, count, words = total(x.visible), np.bincount(of, minlength=len(found)).astype(float), total(x.words)
    typed = np.array([k == "text" for k in kinds])
    entries = total((signs["entry"] > 0) & typed)
    # fewer than three typed lines make no list
    signs["entry"][typed] *= (entries >= 3)[of[typed]]
    columns = [words.astype(np.int64), share(total(x.word_chars), words), share(total(x.symbols), visible), share(total(ended), count), share(total(x.common), words), share(total(x.letters), visible), share(visible, count), *(share(total(signs[s]), visible) for s in SIGNS)]
    keep = np.flatnonzero(visible > 0)
    return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in keep], pa.string()), *(pa.array(c[keep]) for c in columns)], ["id", *_COUNTS])


def common_set(common_words: DataFrame | None) -> frozenset[str]:
    """The words of the small list (lang, word), lower case."""
    rows = common_words.where("word IS NOT NULL").select("word").distinct().limit(MOST_COMMON + 1).collect() if common_words is not None else []
    if len(rows) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    return frozenset(r["word"].lower() for r in rows)


def document_features(docs: DataFrame, common_words: DataFrame | None = None, **columns: str) -> DataFrame:
    """(id, statistics, shares of visible characters in lines with each sign) of the rows of documents; ``columns`` as in ``markup.read_documents``."""
    common = word_hashes(common_set(common_words))
    return markup.read_documents(docs, lambda ids, _, found: features_of(ids, found, common), SCHEMA, **columns)


# ---------------------------------------------------------------- rules
Rule = list[tuple[str, str, float]]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for f, op, cut in rule:
        held &= x[f] > cut if op == ">" else x[f] <= cut
    return held


def _grown(x: dict[str, np.ndarray], is_kind: np.ndarray) -> Rule:
    """A rule, one test after the other by FOIL's information gain; cuts lie midway between neighbouring values."""
    rule: Rule = []
    while len(rule) < 4:
        held = np.flatnonzero(_covered(rule, x, len(is_kind)))
        y = is_kind[held]
        p0, n0 = int(y.sum()), int((~y).sum())
        if not p0 or not n0:
            break
        before, best, test = np.log2(p0 / (p0 + n0)), 1e-9, None
        for f in FEATURES:
            order = np.argsort(x[f][held], kind="stable")
            v, yes = x[f][held][order], np.cumsum(y[order])
            at = np.flatnonzero(v[:-1] < v[1:])
            if not len(at):
                continue
            p, n = yes[at].astype(float), (at + 1 - yes[at]).astype(float)
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - before), 0.0)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, test = gain[k], (f, op, round(float(v[at[k]] + v[at[k] + 1]) / 2, 6))
        if test is None:
            break
        rule = [*rule, test]
    return rule


def induced_rules(rows: list[dict]) -> list[tuple[str, Rule]]:
    """Ordered (kind, rule) by incremental reduced-error pruning over rows with ``label`` and the features; rows are split by their order, so the result is repeatable. A rule that fails gives up the rows it was grown for, and five failures end a class."""
    x = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    label, third = np.array([r["label"] for r in rows], object), np.arange(len(rows)) % 3 == 0
    sizes, left = Counter(r["label"] for r in rows), np.ones(len(rows), bool)
    rules: list[tuple[str, Rule]] = []
    for kind in sorted(KINDS, key=lambda k: (sizes[k], k)):
        is_kind, given_up, failures = label == kind, np.zeros(len(rows), bool), 0
        while failures < 5:
            grow, prune = np.flatnonzero(left & ~third & ~given_up), np.flatnonzero(left & third)
            rule = _grown({f: v[grow] for f, v in x.items()}, is_kind[grow])
            if not rule:
                break
            held_out = {f: v[prune] for f, v in x.items()}

            def right(r: Rule) -> tuple[int, int]:
                y = is_kind[prune][_covered(r, held_out, len(prune))]
                return int(y.sum()), int((~y).sum())

            def worth(r: Rule) -> float:
                p, n = right(r)
                return ((p - n) / (p + n) if p + n else -1.0) - 0.02 * len(r)

            rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
            p, n = right(rule)
            covered = _covered(rule, x, len(rows))
            if p <= n:
                failures += 1
                given_up |= covered & is_kind
                continue
            rules.append((kind, rule))
            left &= ~covered
    return rules


def rules_as_sql(rules: list[tuple[str, Rule]]) -> str:
    """One CASE over the feature columns."""
    tests = " ".join(f"WHEN {' AND '.join(f'{f} {op} {cut!r}' for f, op, cut in rule)} THEN '{kind}'" for kind, rule in rules)
    return f"CASE {tests} ELSE 'prose' END" if rules else "'prose'"


def clear_labels(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(id, label): the label that most annotators gave to each document, if it is one; about ``most`` documents at most, those with the least hashes of id."""
    known = labels.where(F.col("label").isin(*KINDS, "prose") & F.col("doc_id").isNotNull()).groupBy("doc_id", "label").agg(F.count("*").alias("k"))
    best = known.groupBy("doc_id").agg(F.max_by("label", "k").alias("label"), F.sort_array(F.collect_list("k"), asc=False).alias("ks"))
    clear = best.where("size(ks) = 1 OR ks[0] > ks[1]").select(F.col("doc_id").cast("string").alias("id"), "label")
    return least_hashed(clear, "id", most)


def labelled_features(features: DataFrame, labels: DataFrame) -> list[dict]:
    """The features of ``clear_labels`` with the label, in the order of the ids' hashes. The ids are chosen before features are joined."""
    rows = [r.asDict() for r in features.join(F.broadcast(clear_labels(labels)), "id").withColumn("_h", F.xxhash64("id")).collect()]
    return sorted(rows, key=lambda r: (r["_h"], r["id"], *(r[f] for f in FEATURES)))[:LABELLED]


def document_kinds(features: DataFrame, rules: list[tuple[str, Rule]]) -> DataFrame:
    return features.withColumn("kind", F.expr(rules_as_sql(rules)))
