"""Variant spellings of names, linked to the entities they mean.

Candidates come from MinHash banding over the padded q-grams of every name part (parts are padded one by one, so
their order doesn't matter). Each entity is hashed under several written forms (both scripts, initials,
nicknames, acronyms). Rows and bands are chosen from the collision curve 1-(1-t^r)^b so that pairs at the
threshold collide with the wanted recall. Candidates are verified by Monge-Elkan similarity: a name is
split into its two parts (given and family name, or place and institution) in every way and order, each
part is compared with the entity's, and the lesser mean of best matches in both directions counts. The
links are clustered by star clustering: entities are centres from the start, each text goes to the centre it is most
similar to, and a text as similar to two entities belongs to none. Texts that mean no entity form stars of their own
(``text_stars``): any two are compared that share a key of a word, and similar ones do without exception (``text_keys``); the
text with most links is a centre, what is linked to a centre is its satellite, and so on with what is left.

Spellings of one sound in Han transcriptions are learned from mentions that are linked already.

Texts are made distinct before anything is compared and spread by their hash; bucket joins carry (band, hash) keys of
entity forms, hashed in tasks, on one side, and only that side is broadcast, after its size is checked.

Defined results: null and empty texts, null types and entities without names match nothing; repeated rows
get the same link.
"""

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..functions.sizes import small_or_shuffled
from . import textform

#: Entities that one collected dictionary may hold; beyond it the operator refuses instead of straining the driver.
MOST_ENTITIES = 200_000
#: Most pairs that a round of learning may accept; more are refused.
MOST_LEARNED = 200_000
#: Bucket rows that are broadcast at most; beyond them the buckets are joined by shuffle.
MOST_BUCKETS = 2_000_000
Q, HASHES, THRESHOLD, RECALL = 2, 288, 0.5, 0.99
ACCEPT, MARGIN = 0.8, 0.03
TYPES = ("Person", "Organization")
# Words that names of institutions may drop or add, and a city's suffix or the genitive in Chinese.
LITTLE = {"of", "for", "at", "in", "the", "and", "de", "von", "der"}
HAN_LITTLE = "市的"

_HAN = r"㐀-鿿豈-﫿"
_PART = re.compile(rf"[{_HAN}]+|[^\W\d_{_HAN}]+(?:['’][^\W\d_{_HAN}]+)*\.?")


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose collision curve still reaches ``recall`` at ``threshold``, with no more bands than that needs."""
    for rows in range(8, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return hashes, 1


def _bare(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


def parts_of(text: str) -> list[str]:
    return [p for t in _PART.findall(text) if (p := _bare(t)).rstrip(".") not in LITTLE]


def grams(parts: list[str]) -> list[int]:
    found = set()
    for p in parts:
        padded = f"\x02{p.rstrip('.')}\x03"
        found.update(padded[i : i + Q] for i in range(len(padded) - Q + 1))
    return [zlib.crc32(g.encode()) for g in found]


_A = np.random.default_rng(61).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(16).integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(hashes: list[int]) -> np.ndarray:
    x = (np.array(hashes, dtype=np.uint64)[:, None] ^ _B) * _A
    x ^= x >> np.uint64(29)
    x *= _A[::-1]
    return (x ^ (x >> np.uint64(32))).min(axis=0)


def bucket_keys(text_parts: list[str]) -> list[int]:
    """One 64-bit key for each band."""
    bands, rows = bands_for()
    hashes = grams(text_parts)
    if not hashes:
        return []
    s = signature(hashes)[: bands * rows].reshape(bands, rows)
    return [int.from_bytes(zlib.crc32(b.tobytes(), i).to_bytes(4, "big") + zlib.adler32(b.tobytes(), i).to_bytes(4, "big"), "big", signed=True) for i, b in enumerate(s)]


# ---------------------------------------------------------------- similarity
@lru_cache(200_000)
def distance(a: str, b: str, most: int = 2) -> int:
    """Edits with swaps of neighbours, or ``most`` + 1 if there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def _han(s: str) -> bool:
    return bool(s) and "㐀" <= s[0] <= "鿿"


class Names:
    """What is known of the entities: part pairs, all exact parts, nicknames, sound-alike signs."""

    def __init__(self, entities: list[dict], nicknames: list[tuple[str, str]]):
        #: (segment of a name, segment written for it) of Han transcriptions.
        self.alike: dict[str, set[str]] = {}
        self.memo: dict[tuple[str, str, str], float] = {}
        self.short: dict[str, set[str]] = defaultdict(set)
        for given, short in nicknames:
            self.short[_bare(short)].add(_bare(given))
        places = {_bare(n) for e in entities if e["entity_type"] == "Place" for n in [e["name"], *(e["aliases"] or [])] if n}
        self.entities: dict[str, tuple[str, list[tuple[list[str], list[str]]]]] = {}
        self.taken: set[str] = set()
        self.acronyms: dict[str, set[str]] = defaultdict(set)
        self.givens: dict[str, set[str]] = defaultdict(set)
        self.people: dict[str, set[str]] = defaultdict(set)
        for e in entities:
            if e["entity_type"] not in TYPES or not e["id"]:
                continue
            firsts: list[list[str]] = []
            seconds: list[list[str]] = []
            names = [n for n in dict.fromkeys([e["name"], *(e["aliases"] or [])]) if n]
            for n in names:
                ps = parts_of(n)
                if e["entity_type"] == "Person":
                    if len(ps) >= 2 and "," not in n:
                        firsts.append(ps[:-1])
                        seconds.append(ps[-1:])
                elif split := self._place(ps, places):
                    firsts.append(split[0])
                    seconds.append(split[1])
            firsts, seconds = [list(x) for x in dict.fromkeys(map(tuple, firsts))], [list(x) for x in dict.fromkeys(map(tuple, seconds))]
            if firsts:
                self.entities[e["id"]] = (e["entity_type"], [(firsts, seconds)])
                if e["entity_type"] == "Person":
                    for f in firsts:
                        for s in seconds:
                            self.givens[s[0]].add(f[0])
                            self.people[s[0]].add(e["id"])
                for n in names:
                    words = [w for w in re.findall(r"[^\W\d_]+", _bare(n)) if not any(w == p for f in firsts for p in f)]
                    if e["entity_type"] == "Organization" and len(words) > 1 and not _han(words[0]):
                        self.acronyms[e["id"]] |= {"".join(w[0] for w in words), "".join(w[0] for w in words if w not in LITTLE)}
                self.taken.update(p for s in [*firsts, *seconds] for p in s)

    @staticmethod
    def _place(ps: list[str], places: set[str]) -> tuple[list[str], list[str]] | None:
        for k, p in enumerate(ps):
            if p in places and len(ps) > 1:
                return [p], ps[:k] + ps[k + 1 :]
            if _han(p):
                for n in range(len(p) - 1, 1, -1):
                    if p[:n] in places:
                        return [p[:n]], [p[n:]]
        return None

    def forms(self, i: str) -> list[list[str]]:
        """Ways to write entity ``i`` as parts, for hashing."""
        kind, ((firsts, seconds),) = self.entities[i]
        out, full = [], []
        for f in firsts:
            for s in seconds:
                full.append([*f, *s])
                if _han(f[0]) and _han(s[0]):
                    full.append(["".join([*f, *s])])
                if kind == "Person":
                    out.append([f[0][0], *s])
                    if not _han(f[0]):
                        out += [[n, *s] for n, full in self.short.items() if f[0] in full]
                        out.append([f[0][:3], *s])
                elif len(s) > 1:
                    out += [[x, *f] for x in self.acronyms[i]]
                    out.append([*f, *(w[:4] for w in s)])
                    out.append([*f, *(w[:3] for w in s)])
                else:
                    out.append([f[0], s[0][0] + s[0][-1]])
                    out.append([f[0] + s[0][0] + s[0][-1]])
                    out.append([f[0] + s[0][0] + s[0][-2:]])
                    out.append([f[0] + s[0][:2] + s[0][-1]])
        out += [s for s in seconds] if kind == "Person" else []
        out += full
        for form in full:  # learned spellings of one segment
            for k, p in enumerate(form):
                if _han(p):
                    for n in {p[a:b] for a in range(len(p)) for b in range(a + 1, min(a + 3, len(p)) + 1)} & self.alike.keys():
                        out += [[*form[:k], p.replace(n, w, 1), *form[k + 1 :]] for w in self.alike[n]]
        return out

    # -- parts
    def _cost(self, written: str, name: str) -> float:
        """Edits from a Han name to what is written; segments known to stand for each other cost little."""
        n, m = len(name), len(written)
        row = {(0, 0): 0.0}
        for i in range(n + 1):
            for j in range(m + 1):
                c = row.get((i, j), 99.0)
                if i < n and j < m:
                    x = c + (name[i] != written[j])
                    row[i + 1, j + 1] = min(row.get((i + 1, j + 1), 99.0), x)
                if i < n:
                    row[i + 1, j] = min(row.get((i + 1, j), 99.0), c + 1)
                if j < m:
                    row[i, j + 1] = min(row.get((i, j + 1), 99.0), c + 1)
                for k in (1, 2, 3):
                    for w in self.alike.get(name[i : i + k], ()) if i + k <= n else ():
                        if written.startswith(w, j):
                            at = (i + k, j + len(w))
                            row[at] = min(row.get(at, 99.0), c + 0.02)
        return row[n, m]

    def _word(self, a: str, b: str, role: str) -> float:
        got = self.memo.get((a, b, role))
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = self.memo[a, b, role] = self._compared(a, b, role)
        return got

    def _compared(self, a: str, b: str, role: str) -> float:
        """Similarity of a written word with one word of an entity."""
        dotted, a = a.endswith("."), a.rstrip(".")
        if a == b:
            return 1.0
        if _han(a) != _han(b):
            return 0.0
        if _han(a):
            if len(a) > 1 and abs(len(a) - len(b)) <= 3 and a not in self.taken:
                cost = self._cost(a, b)
                if cost < 0.5:
                    return 0.98 - cost
                if cost < 1.5 and min(len(a), len(b)) >= 3:
                    return 0.86 - 0.1 * (cost - 1)
            if role == "given" and len(a) == 1 and b[0] == a:
                return 0.86
            if role == "institution" and 2 <= len(a) < len(b) and a[0] == b[0] and a[-1] == b[-1] and _within(a, b):
                return 0.9
            return 0.0
        if role == "given":
            if b in self.short.get(a, ()):
                return 0.95
            if len(a) == 1 and b[0] == a:
                return 0.86
            if len(a) >= 3 and len(a) < len(b) and b.startswith(a) and (dotted or len(a) >= 3):
                return 0.9
        if role == "institution" and len(a) >= 2 and len(a) < len(b) and a[0] == b[0] and _within(a, b) and (dotted or len(a) <= 4):
            return 0.92
        if a not in self.taken and min(len(a), len(b)) >= 3:
            d = distance(a, b)
            if d == 1 and (min(len(a), len(b)) >= 4 or a[0] == b[0]):
                return 0.9
            if d == 2 and min(len(a), len(b)) >= 8:
                return 0.81
        return 0.0

    def _monge_elkan(self, a: list[str], b: list[str], role: str) -> float:
        if not a or not b:
            return 0.0
        table = [[self._word(x, y, role) for y in b] for x in a]
        return min(sum(max(r) for r in table) / len(a), sum(max(r[j] for r in table) for j in range(len(b))) / len(b))

    def _first(self, a: list[str], options: list[list[str]], role: str) -> float:
        best = max((self._monge_elkan(a, b, role) for b in options), default=0.0)
        if role == "given" and len(a) == 2 and len(a[1].rstrip(".")) == 1:
            best = max(best, 0.97 * self._first(a[:1], options, role))
        if role == "given" and len(a) == 1 and len(a[0].rstrip(".")) == 1 and not _han(a[0]):
            best = max(best, *(0.86 * (b[0][0] == a[0][0]) for b in options))
        if role == "place" and len(a) == 1 and _han(a[0]) and a[0][-1] in HAN_LITTLE and len(a[0]) > 2:
            best = max(best, 0.98 * self._first([a[0][:-1]], options, role))
        return best

    def _pet(self, a: str, options: list[list[str]]) -> float:
        """An unknown first name with the initial of the given name, or part of it: a pet name, where the family name has one bearer only."""
        known = a in self.taken or a in self.short or _han(a) or len(a) < 3
        return 0.82 * (not known and any(a[0] == b[0][0] or a in b[0] for b in options if not _han(b[0])))

    def _second(self, a: list[str], options: list[list[str]], role: str, i: str = "") -> float:
        best = max((self._monge_elkan(a, b, role) for b in options), default=0.0)
        if role == "institution" and len(a) == 1 and not _han(a[0]):
            best = max(best, 0.9 * (a[0].rstrip(".") in self.acronyms.get(i, ())))
        if role == "institution" and len(a) == 1 and _han(a[0]) and a[0][0] in HAN_LITTLE and len(a[0]) > 2:
            best = max(best, 0.98 * self._second([a[0][1:]], options, role))
        return best

    def similarity(self, parts: tuple[str, ...], i: str) -> float:
        """The best reading of ``parts`` as entity ``i``, 0 if none reaches ``ACCEPT`` in both parts."""
        kind, ((firsts, seconds),) = self.entities[i]
        lone = kind == "Person" and all(len(self.people[s[0]]) == 1 for s in seconds)
        return self._read(list(parts), kind, firsts, seconds, lone, i)

    def likeness(self, a: tuple[str, ...], b: tuple[str, ...], kind: str) -> float:
        """The best reading of one written name as another one, 0 if none reaches ``ACCEPT``; both ways count, and of a name in one part only the whole."""
        if len(a) > 1 and len(b) > 1:
            return max(self._read(list(x), kind, [f], [s], False, "") for x, y in ((a, b), (b, a)) for f, s in ((list(y[:-1]), list(y[-1:])), (list(y[1:]), list(y[:1]))))
        whole = max(self._monge_elkan(list(x), list(y), "family") for x, y in ((a, b), (b, a)))
        return whole if whole >= ACCEPT else 0.0

    def sounds(self) -> dict[str, str]:
        """One sign for all Han signs that learned spellings may turn into each other."""
        of: dict[str, str] = {}

        def find(c: str) -> str:
            while of.setdefault(c, c) != c:
                c = of[c]
            return c

        for name, written in self.alike.items():
            for c in {c for w in written for c in name + w}:
                of[find(c)] = find(name[0])
        return {c: find(c) for c in of}

    def _read(self, ps: list[str], kind: str, firsts: list[list[str]], seconds: list[list[str]], lone: bool, i: str) -> float:
        one, two = ("given", "family") if kind == "Person" else ("place", "institution")
        if kind == "Organization" and len(long := [p for p in ps if len(p.rstrip(".")) > 1]) > 1:
            ps = long
        cuts = [(ps[:k], ps[k:]) for k in range(1, len(ps))]
        if kind == "Organization" and len(ps) > 2:
            cuts += [([p], ps[:k] + ps[k + 1 :]) for k, p in enumerate(ps)]
        if len(ps) == 1 and _han(ps[0]):
            cuts += [([ps[0][:k]], [ps[0][k:]]) for k in range(1, len(ps[0]))]
        best = 0.0
        for left, right in cuts:
            for a, b in ((left, right), (right, left)):
                x = self._first(a, firsts, one)
                if lone and x < ACCEPT and len(a) == 1:
                    x = self._pet(a[0].rstrip("."), firsts)
                if x >= ACCEPT and (y := self._second(b, seconds, two, i)) >= ACCEPT:
                    best = max(best, (x + y) / 2)
        if kind == "Person" and len(ps) == 1:
            p = ps[0].rstrip(".")
            y = self._second([p], seconds, two)
            if y >= 0.84 and len(p) >= (3 if _han(p) else 5):
                best = max(best, 0.95 * y)
        return best if best >= ACCEPT else 0.0


def _dropped(words: set[str]) -> set[str]:
    """``words``, and each of them without one of its letters."""
    return words | {w[:i] + w[i + 1 :] for w in words for i in range(len(w))}


def _runs(s: str) -> str:
    return "".join(c for i, c in enumerate(s) if not i or s[i - 1] != c)


def text_keys(parts: tuple[str, ...], kind: str, sounds: dict[str, str]) -> set[str]:
    """Keys of the words of a text; two texts with a ``likeness`` share one, as a word of the one is ``ACCEPT`` similar, as family name or institution, to one of the other.

    Words an edit apart are equal if each may drop a letter, longer ones two edits apart if each may drop two. Han words are
    compared by runs of one sound (``Names.sounds``), which learned spellings don't change."""
    out = set()
    words = [p.rstrip(".") for p in parts]
    for p, w in zip(parts, words, strict=True):
        if not _han(w):
            near = _dropped({w}) if len(w) >= 3 else {w}
            out |= {"=" + x for x in (_dropped(near) if len(w) >= 8 else near)}
            if kind == "Organization":  # a short form keeps the first letter and others in order
                out |= {f"<{w[0]}{c}" for c in w[1:2]} if p != w or len(w) <= 4 else set()
                out |= {f"<{w[0]}{c}" for c in w[1:]}
            continue
        if kind == "Organization":
            out.add(f"<{w[0]}{w[-1]}")
        while True:
            runs = _runs("".join(sounds.get(c, c) for c in w))
            out |= {"~" + _runs(x) for x in (_dropped({runs}) if len(w) >= 3 else {runs})}
            if kind != "Organization" or w[0] not in HAN_LITTLE or len(w) < 3:
                break
            w = w[1:]
            out.add(f"<{w[0]}{w[-1]}")
    return out


def _changes(name: str, written: str) -> list[tuple[str, str]]:
    """Differing segments, each with its neighbours if one side would be empty."""
    out = []
    for tag, a, b, c, d in SequenceMatcher(None, name, written, False).get_opcodes():
        if tag == "replace" and b - a <= 3 and d - c <= 3:
            out.append((name[a:b], written[c:d]))
        elif tag != "equal":
            return []
    return out


def lessons(names: Names, parts: tuple[str, ...]) -> list[tuple[str, str, str, str]]:
    """What one text could teach: ("han", segment of a family name, segment written, family) where the given name leaves one likely family, and ("nick", given name, unknown first name, family) where the family name is exact."""
    ps = [p.rstrip(".") for p in parts]
    out = []
    known = {w: n for n, ws in names.alike.items() for w in ws if len(w) == 1}
    if len(ps) == 1 and _han(ps[0]):
        cuts = [(ps[0][:k], ps[0][k:]) for k in range(2, len(ps[0]) - 1)]
    elif len(ps) == 2:
        cuts = [(ps[0], ps[1]), (ps[1], ps[0])]
    else:
        return []
    for given, family in cuts:
        if _han(family) and family not in names.taken and 2 <= len(family) <= 8:
            family = "".join(known.get(c, c) for c in family)
            near = []
            for f, gs in names.givens.items():
                if _han(f) and any(g == given or len(given) == 1 and g[0] == given for g in gs):
                    near.append((SequenceMatcher(None, f, family, False).ratio(), f))
            near.sort(reverse=True)
            if near and near[0][0] >= 0.55 and (len(near) < 2 or near[1][0] < near[0][0] - 0.1):
                out += [("han", x, y, near[0][1]) for x, y in _changes(near[0][1], family)]
        elif not _han(given) and len(given) >= 3 and not _han(family) and family in names.givens and given not in names.taken and given not in names.short:
            gs = [g for g in names.givens[family] if not _han(g)]
            if not any(distance(given, g) <= 2 or g.startswith(given) for g in gs):
                out += [("nick", g, given, family) for g in gs]
    return out


def _teacher(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {x for form in batch.column(0).to_pylist() if form for x in lessons(names, tuple(parts_of(form)))}
            yield pa.RecordBatch.from_pydict({c: pa.array([x[k] for x in rows], pa.string()) for k, c in enumerate(("kind", "name", "written", "family"))})

    return run


def taught(names: Names, counted: list[tuple[str, str, str, int]]) -> None:
    """Takes (kind, name, written, families) into ``names``: Han segments seen in two families, first names that four of five families with them (two at least) explain by the same given name."""
    alike: dict[str, set[str]] = defaultdict(set, {k: set(v) for k, v in names.alike.items()})
    nick: dict[str, dict[str, int]] = defaultdict(dict)
    for kind, name, written, families in counted:
        if kind == "han" and families >= 2:
            alike[name].add(written)
        elif kind == "nick":
            nick[written][name] = families
        elif kind == "seen":
            nick[written][""] = families
    names.alike = dict(alike)
    names.memo.clear()
    for written, by in nick.items():
        total = by.pop("", 0) or max(by.values(), default=0)
        for name, n in by.items():
            if n >= 2 and n >= 0.8 * total:
                names.short[written].add(name)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [bucket_keys(parts_of(f)) if f else [] for f in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.list_(pa.int64()))], ["text", "form", "entity_type", "keys"])


def hashed_texts(texts: DataFrame) -> DataFrame:
    """(text, form, entity_type, key): distinct rows (text, form, entity_type) with the key of each band, spread over tasks by the hash of the text."""
    tasks = max(1, min(texts.count() // 250, 10_000))
    spread = texts.select("text", "form", "entity_type").repartition(tasks, F.xxhash64("text"))
    keys = spread.mapInArrow(_hashed, "text string, form string, entity_type string, keys array<bigint>")
    return keys.select("text", "form", "entity_type", F.explode(F.array_distinct("keys")).alias("key"))


def entity_buckets(spark: SparkSession, names: Names) -> DataFrame:
    """(key, entity_id) of all forms of all entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keyed = [(k, i) for i in batch.column(0).to_pylist() for k in {k for f in {tuple(f) for f in names.forms(i)} for k in bucket_keys(list(f))}]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keyed], pa.int64()), pa.array([i for _, i in keyed], pa.string())], ["key", "entity_id"])

    ids = spark.createDataFrame(pa.table({"entity_id": pa.array(list(names.entities), pa.string())}))
    return ids.repartition(max(1, min(len(names.entities) // 50, 1_000)), "entity_id").mapInArrow(run, "key bigint, entity_id string")


def _verifier(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple] = {}
        for batch in batches:
            texts, forms, kinds, ids = (batch.column(i).to_pylist() for i in range(4))
            out: tuple[list, ...] = ([], [], [], [])
            for text, form, kind, i in zip(texts, forms, kinds, ids, strict=True):
                if names.entities[i][0] != kind:
                    continue
                parts = seen.get(form)
                if parts is None:
                    if len(seen) > 50_000:
                        seen.clear()
                    parts = seen[form] = tuple(parts_of(form))
                s = names.similarity(parts, i) if parts else 0.0
                if s:
                    for c, v in zip(out, (text, kind, i, s), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64())], ["text", "entity_type", "entity_id", "similarity"])

    return run


def known_names(entities: DataFrame, nicknames: DataFrame | None = None, forms: DataFrame | None = None) -> Names:
    """``Names`` from the entity table; ``forms`` (form), the distinct texts of persons, teach Han segments and first names that the tables lack. Only accepted pairs leave the executors; more than ``MOST_LEARNED`` are refused."""
    rows = [r.asDict() for r in entities.select("id", "name", "aliases", "entity_type").limit(MOST_ENTITIES + 1).collect()]
    if len(rows) > MOST_ENTITIES:
        raise ValueError(f"more than {MOST_ENTITIES} entities")
    known = nicknames.where("given_name <> '' AND short_name <> ''").select("given_name", "short_name").distinct().limit(MOST_ENTITIES + 1).collect() if nicknames is not None else []
    if len(known) > MOST_ENTITIES:
        raise ValueError(f"more than {MOST_ENTITIES} nicknames")
    short = sorted((r["given_name"], r["short_name"]) for r in known)
    names = Names(rows, short)
    if forms is not None:
        for _ in range(2):  # the second time with what the first has taught
            _learn(names, forms)
    return names


def accepted(seen: DataFrame) -> DataFrame:
    """(kind, name, written, n, total) of distinct rows (kind, name, written, family): Han segments of two families, first names that four of five families with them (two at least) explain by ``name``."""
    pairs = seen.groupBy("kind", "name", "written").agg(F.count("*").alias("n")).where("n >= 2")
    totals = seen.groupBy("kind", "written").agg(F.count_distinct("family").alias("total"))
    return pairs.join(totals, ["kind", "written"]).where((F.col("kind") == "han") | (F.col("n") >= F.lit(0.8) * F.col("total"))).select("kind", "name", "written", "n", "total")


def _learn(names: Names, forms: DataFrame) -> None:
    seen = forms.select("form").mapInArrow(_teacher(names), "kind string, name string, written string, family string").distinct()
    found = accepted(seen).limit(MOST_LEARNED + 1).collect()
    if len(found) > MOST_LEARNED:
        raise ValueError(f"more than {MOST_LEARNED} learned pairs")
    taught(names, [(r["kind"], r["name"], r["written"], r["n"]) for r in found] + [("seen", "", r["written"], r["total"]) for r in found if r["kind"] == "nick"])


def linked_texts(texts: DataFrame, names: Names) -> DataFrame:
    """(text, entity_type, entity_id, similarity) for distinct rows (text, form, entity_type): the star each text belongs to, if it is exactly one."""
    buckets = small_or_shuffled(checkpointed(entity_buckets(texts.sparkSession, names)), MOST_BUCKETS)
    pairs = hashed_texts(texts).join(buckets, "key").select("text", "form", "entity_type", "entity_id").distinct()
    stars = pairs.mapInArrow(_verifier(names), "text string, entity_type string, entity_id string, similarity double")
    best = stars.groupBy("text", "entity_type").agg(F.max(F.struct("similarity", "entity_id")).alias("top"), F.sort_array(F.collect_list("similarity"), asc=False).alias("all"))
    clear = best.where(F.coalesce(F.try_element_at("all", F.lit(2)), F.lit(0.0)) < F.col("top.similarity") - MARGIN)
    return clear.select("text", "entity_type", F.col("top.entity_id").alias("entity_id"), F.col("top.similarity").alias("similarity"))


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, center, similarity) of nodes (id, and weight, which decides between equally many links) and undirected links (a, b, similarity): the node with most links among its undecided neighbours is a centre, its neighbours are satellites, and so on with the undecided; a satellite goes to the most similar of its centres, the lesser id on a tie. Nodes without links are their own centres."""
    both = checkpointed(edges.select("a", "b", "similarity").union(edges.select("b", "a", "similarity")).where("a <> b").groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    weight = F.max("weight") if "weight" in nodes.columns else F.lit(0)
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "weight", F.xxhash64("id").alias("h"), "id")
    open_ = checkpointed(nodes.groupBy("id").agg(weight.alias("weight")).join(both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", rank.alias("rank")))
    centers = open_.select("id").limit(0)
    while not open_.isEmpty():
        ahead = both.join(open_.select(F.col("id").alias("b"), F.col("rank").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.max("other").alias("other"))
        new = checkpointed(open_.join(ahead, "id", "left").where(F.col("other").isNull() | (F.col("rank") > F.col("other"))).select("id"))
        near = both.join(new.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        open_ = checkpointed(open_.join(new, "id", "left_anti").join(near, "id", "left_anti"))
        centers = checkpointed(centers.union(new))
    own = centers.select("id", F.col("id").alias("center"), F.lit(1.0).alias("similarity"))
    reach = both.join(centers.select(F.col("id").alias("b")), "b", "left_semi").join(centers.select(F.col("id").alias("a")), "a", "left_anti")
    best = reach.groupBy(F.col("a").alias("id")).agg(F.max_by("b", F.struct("similarity", F.xxhash64("b"), "b")).alias("center"), F.max("similarity").alias("similarity"))
    return own.unionByName(best)


def _likeness(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, b, kind, names.likeness(tuple(parts_of(x)), tuple(parts_of(y)), kind)) for a, b, kind, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            kept = [r for r in rows if r[3]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], ["a", "b", "entity_type", "similarity"])

    return run


def keyed_texts(texts: DataFrame, names: Names) -> DataFrame:
    """(text, form, entity_type, key): distinct rows (text, form, entity_type) with each of their ``text_keys``."""
    sounds = names.sounds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sorted(text_keys(tuple(parts_of(f)), kind, sounds)) if f else [] for f, kind in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.list_(pa.string()))], ["text", "form", "entity_type", "keys"])

    keys = texts.select("text", "form", "entity_type").mapInArrow(run, "text string, form string, entity_type string, keys array<string>")
    return keys.select("text", "form", "entity_type", F.explode("keys").alias("key"))


def text_stars(texts: DataFrame, names: Names) -> DataFrame:
    """(text, entity_type, center, similarity) for distinct rows (text, form, entity_type, n): stars of texts that name one thing. Any two texts with a key in common are compared; of texts with equally many links the most frequent becomes the centre."""
    keyed = checkpointed(keyed_texts(texts, names))
    other = keyed.select("entity_type", "key", F.col("text").alias("b"), F.col("form").alias("other"))
    pairs = keyed.withColumnRenamed("text", "a").join(other, ["entity_type", "key"]).where("a < b").select("a", "b", "entity_type", "form", "other").distinct()
    links = pairs.mapInArrow(_likeness(names), "a string, b string, entity_type string, similarity double")
    name = lambda c: F.concat("entity_type", F.lit("\x01"), c)
    found = star_clusters(texts.select(name(F.col("text")).alias("id"), F.col("n").alias("weight")), links.select(name(F.col("a")).alias("a"), name(F.col("b")).alias("b"), "similarity"))
    part = lambda c, k: F.split(c, "\x01", 2)[k]
    return found.select(part("id", 1).alias("text"), part("id", 0).alias("entity_type"), part("center", 1).alias("center"), "similarity")


def open_texts(mentions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unlinked mentions of persons and organisations, and their distinct (text, form, entity_type) that look like no name or alias (same consistent form, ignoring case)."""
    open_ = mentions.where(F.col("linked_entity_id").isNull() & F.col("entity_type").isin(*TYPES) & F.col("text").isNotNull()).select("mention_id", "text", "entity_type")
    aliases = entities.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text")).where("text IS NOT NULL")
    every = open_.select("text", "entity_type").unionByName(aliases.withColumn("entity_type", F.lit("alias"))).distinct()
    formed = checkpointed(textform.with_consistent_form(every, "text", "form").withColumn("look", F.lower(F.trim("form"))))
    looks = formed.where("entity_type = 'alias'").select("look").distinct()
    return open_, checkpointed(formed.where("entity_type <> 'alias'").join(small_or_shuffled(looks), "look", "left_anti").select("text", "form", "entity_type"))


def variant_links(mentions: DataFrame, entities: DataFrame, nicknames: DataFrame | None = None, learn: bool = True) -> DataFrame:
    """(mention_id, entity_id) of unlinked mentions of persons and organisations whose text is another spelling of one entity's name.

    A text that looks like a name or alias of an entity (same consistent form, ignoring case) is no variant."""
    open_, texts = open_texts(mentions, entities)
    persons = texts.where("entity_type = 'Person'").select("form").distinct() if learn else None
    links = linked_texts(texts, known_names(entities, nicknames, persons))
    return open_.join(links, ["text", "entity_type"]).select("mention_id", "entity_id").distinct()


def variant_clusters(mentions: DataFrame, entities: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """(text, entity_type, mentions, center, similarity, entity_id) of every distinct text of ``open_texts``: its star's centre, which is the entity it means (then ``entity_id`` is set), or a text that names the same thing."""
    open_, texts = open_texts(mentions, entities)
    names = known_names(entities, nicknames, texts.where("entity_type = 'Person'").select("form").distinct())
    links = checkpointed(linked_texts(texts, names))
    counts = open_.groupBy("text", "entity_type").agg(F.count("*").alias("n"))
    rest = checkpointed(texts.join(links, ["text", "entity_type"], "left_anti").join(counts, ["text", "entity_type"]))
    own = links.select("text", "entity_type", F.col("entity_id").alias("center"), "similarity", "entity_id")
    stars = own.unionByName(text_stars(rest, names).withColumn("entity_id", F.lit(None).cast("string")))
    return stars.join(counts.withColumnRenamed("n", "mentions"), ["text", "entity_type"]).select("text", "entity_type", "mentions", "center", "similarity", "entity_id")
