"""Clauses of responses as feature vectors, many pairs at a time.

Texts of a slice are one array of code points; words, word pairs, names and
character trigrams are found and hashed on that array, so that the cost of a
pair lies in numpy and not in loops over its words.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np

BINS = 1 << 14
TRIGRAMS = 1 << 15
_CLAUSE = re.compile(r"(?:(?<=\n)[^\w\n]*(?:[^\W\d_]{1,12}[ \t]*)?\d{1,2}[.)][ \t]+)?[^\n]+?(?:[.!?…。]+[\"”’)\]*`]*(?=\s)|(?=\n)|$)")
# A label is one word and a colon; a rank is a number, perhaps after a word, and a separator.
_LABEL = re.compile(r"[\W_]*(?:(?P<rank>(?:[^\W\d_]{1,12}\s*)?#?\s*(?P<number>\d{1,2})\s*[:.)](?=\s|\*|$))|[^\W\d_]{2,16}\s*[:：])\s*")
_CITED = re.compile(r"[\W_]*(?:\[[^\]\n]*\][\W_]*)+")
_TAIL = re.compile(r"(?:[*_`\s]*\[[^\]\n]*\])*[*_`\s​﻿]*$")
_STOP = re.compile(r"[.!?。][\"”’)\]*`_}>]*$")
_DOTS = re.compile(r"(?:\.\.\.|…|\s\.\.)[\"”’)\]*`_]*$")
_WORD = re.compile(r"[^\W_]+")
# What stands where an answer should.
PLACEHOLDER = re.compile(r"[\W_]*(?:n/?a|none|null|nil|nan|tbd|empty|blank|no (?:output|answer|response|content)|not (?:provided|available|given|stated)|answer|undefined|pending|unknown)?[\W_]*$", re.I)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_FLAGS = [
    *[f"echo{i}" for i in range(5)], *[f"single{i}" for i in range(4)], *[f"margin{i}" for i in range(7)], *[f"text_margin{i}" for i in range(7)], *[f"fit{i}" for i in range(6)],
    *[f"state{i}" for i in range(24)], "name", "name_word", "text_name", "text_no_name", "rank", "text_rank", "text_no_rank", "label", "first", "last", "only", "short", "long", "stop", "no_stop",
    *[f"end_{x}" for x in ("stop", "dots", "letter", "other", "label")], *[f"rank{i}_{x}" for i in (1, 2, 3) for x in ("empty", "known", "inside", "words", "head", "unknown")],
]
FLAG = {f: 3 * BINS + i for i, f in enumerate(_FLAGS)}
WIDTH = 3 * BINS + len(_FLAGS)


def _word_classes() -> np.ndarray:
    table = np.zeros(65536, np.uint8)
    for i in range(65536):
        c = chr(i)
        table[i] = 2 if c.isalpha() else 1 if c.isalnum() else 0
    return table


_CLASSES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        for i, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of texts joined by line ends: where they stand, their hashes, and trigram ids of the characters."""

    def __init__(self, texts: list[str]):
        if not _CLASSES:
            _CLASSES.append(_word_classes())
        self.text = "\n".join(texts) + "\n"
        self.starts_of_texts = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kind = _CLASSES[0][np.minimum(self.codes, 65535)]

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        change = np.flatnonzero(np.diff(self.kind > 0, prepend=False, append=False))
        return change[::2], change[1::2]

    @property
    def starts(self) -> np.ndarray:
        return self.bounds[0]

    @property
    def ends(self) -> np.ndarray:
        return self.bounds[1]

    @cached_property
    def hashes(self) -> np.ndarray:
        power, inverse = _powers(len(self.codes))
        sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * power[: len(self.codes)], out=sums[1:])
        return _mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    @cached_property
    def trigrams(self) -> np.ndarray:
        if len(self.codes) < 3:
            return np.zeros(0, np.int32)
        letter = self.kind == 2
        letters = np.where(letter, self.codes, np.uint32(32))
        triple = letters[:-2] * np.uint32(0x9E3779B1) + letters[1:-1] * np.uint32(0x85EBCA6B) + letters[2:] * np.uint32(0xC2B2AE35)
        a, b, c = letter[:-2], letter[1:-1], letter[2:]
        return np.where((a & (b | c)) | (b & c), (triple >> np.uint32(17)).astype(np.int32), np.int32(TRIGRAMS))  # the last id is none

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams of each text, from and to."""
        at = np.minimum(self.starts_of_texts, len(self.trigrams))
        return at[:-1], at[1:]

    def pairs(self) -> np.ndarray:
        """Hash of every word with the next one."""
        return _mix(self.hashes[:-1] * np.uint64(3) + self.hashes[1:]) if len(self.hashes) > 1 else np.zeros(0, np.uint64)


def text_hash(text: str) -> int:
    """The hash of the words of ``text``, as ``Words`` gives it to a run of words."""
    h = Words([text]).hashes
    return int(_runs(h, len(h))[0]) if len(h) else 0


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on."""
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = _mix(out * np.uint64(5) + hashes[k : len(hashes) - n + 1 + k])
    return out


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in the sorted array ``known``."""
    if not len(known) or not len(keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys


# Closed-class words that pick the first texts of a language; the profiles are learnt from the texts.
SEEDS = {
    "en": "the of with is was that which from has have been are not after into their on at to an by for",
    "es": "el los las del y una según con es se este esta al su pero sin más son hacia después",
    "pt": "os do da dos das uma não com em foi são ao à na pelo mais depois seu um pela",
    "fr": "le les des et une est du au aux pour avec dans sur par plus après cette ce sont il",
    "de": "der die das und ist eine mit nicht von den dem ein für auf wurde bei im nach zu sich",
    "it": "il gli di che è sono della alla più dopo questa nel dei con per una non anche dal",
    "nl": "het een van en is niet met voor zijn op aan door maar ook wordt bij naar uit deze werd",
    "ru": "и в не на с что по это как из за от для при после или был также его она",
}


class Languages:
    """Character trigram profiles of the languages of a table.

    Closed-class words pick the texts that a profile begins with; every text
    then joins the profile that explains its trigrams best, and the profiles
    are counted anew. A profile is the smoothed log probability of each
    trigram; a language without texts has none.
    """

    def __init__(self, texts: list[str] = (), smooth: float = 0.3, sweeps: int = 2):
        self.smooth = smooth
        self.settle(np.zeros((len(SEEDS), TRIGRAMS)))
        for sweep in range(sweeps if len(texts) else 0):
            self.settle(self.counts(texts, sweep == 0))

    def settle(self, counts: np.ndarray) -> None:
        """Take the profiles from ``counts`` of trigrams by language; languages without any have none."""
        self.present = np.flatnonzero(counts.sum(axis=1))
        c = counts[self.present] + self.smooth
        self.profiles = np.column_stack([np.log(c / c.sum(axis=1, keepdims=True)), np.zeros(len(c))]).astype(np.float32)
        self.kinds = [list(SEEDS)[k] for k in self.present]
        if not len(self.present):
            self.profiles, self.kinds = np.zeros((1, TRIGRAMS + 1), np.float32), ["none"]

    def counts(self, texts: list[str], seeded: bool, times: np.ndarray | None = None) -> np.ndarray:
        """Trigrams by language of ``texts``, each given so many ``times``: those that closed-class words pick, or those that fit the profiles."""
        w = Words(texts)
        n = len(texts)
        s, e = w.spans()
        if seeded:
            votes = self._votes(w, n)
            best = votes.argmax(axis=1)
            top = votes[np.arange(n), best]
            sure = (top >= 4) & (top >= 3 * (np.sort(votes, axis=1)[:, -2]))
            group = np.where(sure, best, -1)
        elif len(self.present):
            logs, size = self.totals(w.trigrams, s, e)
            group = np.where(size >= 30, self.present[logs.argmax(axis=0)], -1)
        else:
            group = np.full(n, -1)
        out = np.zeros((len(SEEDS), TRIGRAMS + 1))
        of = np.repeat(group, e - s)
        weight = None if times is None else np.repeat(np.asarray(times, float), e - s)
        for k in np.unique(group[group >= 0]):
            on = of == k
            out[k] = np.bincount(w.trigrams[on], None if weight is None else weight[on], TRIGRAMS + 1)
        return out[:, :TRIGRAMS]

    @staticmethod
    def _votes(w: Words, n: int) -> np.ndarray:
        """How many closed-class words of each language that no other has stand in each text."""
        own = [(text_hash(x), k) for k, words in enumerate(SEEDS.values()) for x in words.split() if all(x not in other.split() for j, other in enumerate(SEEDS.values()) if j != k)]
        known, kind = np.array([h for h, _ in sorted(own)], np.uint64), np.array([k for _, k in sorted(own)])
        at = np.minimum(np.searchsorted(known, w.hashes), len(known) - 1)
        hit = np.flatnonzero(known[at] == w.hashes)
        of_word = np.searchsorted(w.starts_of_texts, w.starts[hit], side="right") - 1
        return np.bincount(of_word * len(SEEDS) + kind[at[hit]], minlength=n * len(SEEDS)).reshape(n, len(SEEDS))

    def of(self, texts: list[str]) -> np.ndarray:
        """The profile that fits each text best."""
        w = Words([t.lower() for t in texts])
        return self.totals(w.trigrams, *w.spans())[0].argmax(axis=0)

    def totals(self, trigrams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability per language, and count, of the trigrams of each span; spans may be empty."""
        count = np.zeros(len(trigrams) + 1, np.int64)
        np.cumsum(trigrams < TRIGRAMS, out=count[1:])
        out = np.zeros((len(self.profiles), len(starts)))
        there = ends > starts
        if there.any():
            edges = np.column_stack([starts[there], ends[there]]).ravel()
            for k, row in enumerate(self.profiles):
                out[k, there] = np.add.reduceat(np.append(row.astype(float)[trigrams], 0.0), edges)[::2]
        return out, count[ends] - count[starts]


class Names:
    """Names of diseases: as runs of words, as words, and in order for prefixes."""

    def __init__(self, names: Iterable[str], common_words: Iterable[str] = ()):
        self.ordered = sorted({" ".join(_WORD.findall(n.lower())) for n in names} - {""})
        self.all = frozenset(self.ordered)
        self.heads = frozenset(n.split()[-1] for n in self.ordered)
        runs: dict[int, list[int]] = {}
        for n in self.ordered:
            words = Words([n]).hashes
            if len(words) <= 6:
                runs.setdefault(len(words), []).append(int(_runs(words, len(words))[0]))
        self.runs = {k: np.sort(np.array(v, np.uint64)) for k, v in runs.items()}
        words = {w for n in self.ordered for w in n.split() if len(w) > 4} - set(common_words)
        self.words = np.sort(Words([" ".join(sorted(words))]).hashes) if words else np.zeros(0, np.uint64)

    def state(self, value: str) -> str:
        """How the value of a rank line stands to the names: empty, known, a start that ends inside a word, between words or with a word that ends names, or unknown."""
        if not value or value in self.all:
            return "known" if value else "empty"
        at = bisect_left(self.ordered, value)
        if at < len(self.ordered) and self.ordered[at].startswith(value):
            return "inside" if self.ordered[at][len(value)] != " " else "head" if value.split()[-1] in self.heads else "words"
        return "unknown"


@dataclass
class Encoded:
    """Clauses of a slice: their pair, features and what coverage needs."""

    lengths: np.ndarray  # clauses of each pair
    ids: np.ndarray
    sizes: np.ndarray
    start: np.ndarray  # of the clause in its answer
    chars: np.ndarray
    words: np.ndarray
    rank: np.ndarray  # 0 none, 1 a rank line without, 2 with a value
    named: np.ndarray

    @staticmethod
    def joined(parts: list[Encoded]) -> Encoded:
        return Encoded(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Encoded)))

    def head(self, pairs: int) -> Encoded:
        """The first ``pairs``."""
        clauses = int(self.lengths[:pairs].sum())
        ends = {"lengths": pairs, "ids": int(self.sizes[:clauses].sum())}
        return Encoded(*(getattr(self, f.name)[: ends.get(f.name, clauses)] for f in fields(Encoded)))


def _sum(owner: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, x, n)


def _untailed(text: str) -> str:
    """``text`` without citations, marks and blanks at its end."""
    last = text[-1:]
    return _TAIL.sub("", text) if last in "]*_`\u200b\ufeff" or last.isspace() else text


_FORMS: dict[str, tuple[int, int, int, int] | None] = {}


def _form(clause: str) -> tuple[int, int, int, int] | None:
    """Length of the label, rank (0 none), full stop and a rank line without a value; None for citations. Clauses recur, so the last ones are kept."""
    if clause in _FORMS:
        return _FORMS[clause]
    if len(_FORMS) >= 50_000:
        _FORMS.clear()
    form = None
    if not _CITED.fullmatch(clause):
        label = _LABEL.match(clause)
        end = label.end() if label else 0
        rank = (int(label["number"]) or 1) if label and label["rank"] else 0
        stop = clause[-1] in ".!?。" or clause[-1] in "\"”’)]*`_" and _STOP.search(clause, max(0, len(clause) - 6)) is not None
        form = end, rank, int(stop), int(rank > 0 and PLACEHOLDER.match(clause, end) is not None)
    if len(clause) <= 500:
        _FORMS[clause] = form
    return form


def _tail_flags(text: str, rank: int, value: str, names: Names) -> list[int]:
    """Features of how a response ends."""
    if rank:
        return [FLAG[f"rank{min(rank, 3)}_{names.state(value)}"]]
    tail = _untailed(text)
    if _DOTS.search(tail):
        return [FLAG["end_dots"]]
    if _STOP.search(tail):
        return [FLAG["end_stop"]]
    words = _WORD.findall(tail)
    last = words[-1] if words else ""
    kind = "end_letter" if tail[-1:].isalnum() else "end_label" if tail[-1:] in ":：" else "end_other"
    seen = ["w" + last, "b" + " ".join(words[-2:]), "s" + last[-3:]] if kind == "end_letter" else ["o" + tail[-1:]]
    return [FLAG[kind]] + [2 * BINS + zlib.crc32(x.encode("utf-8", "replace")) % BINS for x in seen]


class Keys:
    """A set of hashes; a table of their first bits spares most searches for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        bits = max(len(keys).bit_length() + 3, 8)
        self.shift = np.uint64(64 - bits)
        self.first = np.zeros(1 << bits, bool)
        self.first[self.keys >> self.shift] = True

    def hold(self, keys: np.ndarray) -> np.ndarray:
        out = self.first[keys >> self.shift]
        some = np.flatnonzero(out)
        out[some] = _among(keys[some], self.keys)
        return out


class Queries:
    """Distinct queries: their language, and the words and pairs of words that each holds, to look them up together."""

    def __init__(self, queries: Iterable[str], languages: Languages, size: int = 500):
        self.index: dict[str, int] = {}
        for q in queries:
            self.index.setdefault(q, len(self.index))
        texts, keys, twos, own = list(self.index), [], [], []
        for first in range(0, len(texts), size):
            w = Words([x.lower() for x in texts[first : first + size]])
            of = first + np.searchsorted(w.starts_of_texts, w.starts, side="right") - 1
            keys.append(_mix(w.hashes ^ _salt(of)))
            twos.append(_mix(w.pairs() ^ _salt(of[:-1])))
            own.append(languages.totals(w.trigrams, *w.spans())[0].argmax(axis=0))
        self.words, self.pairs = (Keys(np.concatenate([np.zeros(0, np.uint64), *x])) for x in (keys, twos))
        self.own = np.concatenate([np.zeros(0, int), *own])


def _salt(k: np.ndarray) -> np.ndarray:
    return k.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def encode(queries: list[str], answers: list[str], languages: Languages, names: Names, typical_fit: float, hidden: np.ndarray | None = None, known: Queries | None = None) -> Encoded:
    """Features of the clauses of the pairs; ``hidden`` is a language profile per pair that is not to be used, or -1; ``known`` are queries that hold all of ``queries``."""
    a = Words([x.lower() for x in answers])
    known = Queries(queries, languages) if known is None else known
    q_of = np.array([known.index[q] for q in queries], np.int64)
    text = a.text

    found: list[int] = []
    for m in _CLAUSE.finditer(text):
        if (form := _form(m[0])) is not None:
            found += m.span()
            found += form
    found = np.array(found, np.int64).reshape(-1, 6)
    spans, label_end, rank_no, stops, blank = found[:, :2], found[:, 0] + found[:, 2], found[:, 3], found[:, 4] > 0, found[:, 5] > 0
    w1 = np.searchsorted(a.starts, spans[:, 1])
    keep = w1 > np.searchsorted(a.starts, spans[:, 0])
    spans, label_end, rank_no, stops, blank, w1 = spans[keep], label_end[keep], rank_no[keep], stops[keep], blank[keep], w1[keep]
    w0 = np.searchsorted(a.starts, label_end)
    n, c = w1 - w0, len(spans)
    owner = np.searchsorted(a.starts_of_texts, spans[:, 0], side="right") - 1
    pairs = len(answers)
    lengths = np.bincount(owner, minlength=pairs)

    clause = np.repeat(np.arange(c), n)
    at = np.arange(len(clause)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w0, n)
    inner = np.ones(len(clause), bool)
    inner[np.cumsum(n)[n > 0] - 1] = False  # the last word of a clause begins no pair
    two = a.pairs()
    single = _sum(clause, known.words.hold(_mix(a.hashes[at] ^ _salt(q_of)[owner][clause])), c) / np.maximum(n, 1)
    in_two = at[inner]
    of_two = clause[inner]
    double = _sum(of_two, known.pairs.hold(_mix(two[in_two] ^ _salt(q_of)[owner][of_two])), c) / np.maximum(n - 1, 1)

    s, e = np.minimum(label_end, len(a.trigrams)), np.minimum(np.maximum(spans[:, 1] - 2, label_end), len(a.trigrams))
    fits, tri = languages.totals(a.trigrams, s, e)
    own = known.own[q_of[owner]]
    mine = fits[own, np.arange(c)]
    others = fits.copy()
    others[own, np.arange(c)] = -np.inf
    if hidden is not None and len(fits) > 2:
        off = hidden[owner] >= 0
        others[hidden[owner][off], np.flatnonzero(off)] = -np.inf
    best = others.max(axis=0)
    best = np.where(np.isfinite(best), best, mine - tri)
    margin = best - mine
    plain = rank_no == 0
    text_margin = _sum(owner[plain], margin[plain], pairs)
    fit = np.where(tri > 8, mine / np.maximum(tri, 1) - typical_fit, 0.0)

    named = np.zeros(c, bool)
    for k, runs in names.runs.items():
        if k <= len(a.hashes):
            hit = _among(_runs(a.hashes, k), runs)
            first = np.flatnonzero(hit[at[at < len(hit)]])
            ok = at[first] + k <= w1[clause[first]]
            named[clause[first][ok]] = True
    worded = np.zeros(c, bool)
    worded[clause[_among(a.hashes[at], names.words)]] = True
    rank = np.where(rank_no > 0, np.where((n == 0) | blank, 1, 2), 0)

    first_of = np.cumsum(lengths) - lengths
    index = np.arange(c) - first_of[owner]
    last = index == lengths[owner] - 1
    any_name, any_rank = _sum(owner, named | worded, pairs)[owner] > 0, _sum(owner, rank == 2, pairs)[owner] > 0
    flags = [
        FLAG["echo0"] + np.minimum(4, (double * 5).astype(int)), FLAG["single0"] + np.minimum(3, (single * 4).astype(int)),
        FLAG["margin0"] + np.digitize(margin, [-20, -8, -3, 3, 8, 20]), FLAG["text_margin0"] + np.digitize(text_margin[owner], [-60, -25, -8, 8, 25, 60]),
        FLAG["fit0"] + np.digitize(fit, [-2.5, -1.6, -1.0, -0.6, -0.3]),
        np.where(any_name, FLAG["text_name"], FLAG["text_no_name"]), np.where(any_rank, FLAG["text_rank"], FLAG["text_no_rank"]), np.where(stops, FLAG["stop"], FLAG["no_stop"]),
        FLAG["state0"] + 12 * (double < 0.4) + 6 * any_name + 3 * any_rank + np.digitize(n, [4, 9]),  # what the text holds, for short and long clauses of own words or not
    ]
    some = [(FLAG[f], np.flatnonzero(on)) for f, on in (("name", named), ("name_word", worded), ("rank", rank_no > 0), ("label", (label_end > spans[:, 0]) & plain), ("first", index == 0), ("last", last), ("only", lengths[owner] == 1), ("short", n < 4), ("long", n > 15))]
    tails: list[int] = []
    counts: list[int] = []
    ends = np.flatnonzero(last)
    for from_, label, to, no in zip(spans[ends, 0].tolist(), label_end[ends].tolist(), spans[ends, 1].tolist(), rank_no[ends].tolist()):
        got = _tail_flags(text[from_:to], no, " ".join(_WORD.findall(_untailed(text[label:to]))) if no else "", names)
        tails += got
        counts.append(len(got))
    inside = np.maximum(n - 1, 0)
    sizes = n + inside + len(flags)
    for _, hit in some:
        sizes[hit] += 1
    sizes[ends] += np.array(counts, np.int64)
    ids = np.empty(int(sizes.sum()), np.int32)
    free = np.cumsum(sizes) - sizes  # where the next feature of each clause goes
    for many, of in ((n, a.hashes[at] % np.uint64(BINS)), (inside, two[in_two] % np.uint64(BINS) + np.uint64(BINS))):
        ids[np.arange(len(of)) + np.repeat(free - (np.cumsum(many) - many), many)] = of
        free += many
    for f in flags:
        ids[free] = f
        free += 1
    for f, hit in some:
        ids[free[hit]] = f
        free[hit] += 1
    counts = np.array(counts, np.int64)
    ids[np.arange(len(tails)) + np.repeat(free[ends] - (np.cumsum(counts) - counts), counts)] = tails
    return Encoded(lengths, ids, sizes, spans[:, 0] - a.starts_of_texts[owner], spans[:, 1] - spans[:, 0], np.maximum(n, (spans[:, 1] - label_end) // 10), rank, named | worded)  # scripts without blanks have long words


def best_fits(texts: list[str], languages: Languages) -> np.ndarray:
    """The mean log probability of the trigrams of each of ``texts`` in the language that fits it best; NaN for short texts."""
    w = Words([t.lower() for t in texts])
    logs, size = languages.totals(w.trigrams, *w.spans())
    return np.where(size > 30, logs.max(axis=0) / np.maximum(size, 1), np.nan)
