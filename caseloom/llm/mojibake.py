"""Text that was decoded with a wrong character encoding.

Adjacent character pairs of the whole corpus are counted and scored by their
smoothed mutual information. Around characters outside ASCII, maximum-scoring
segments of improbable pairs are isolated; the inverse of each known wrong
reading is tried inside those segments only, and kept if it makes the pairs
more probable.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import spread, written

_CLUSTER = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+(?=([\x00-\x7f]?))")
_WIDE = re.compile(r"[^\x00-\x7f]+")
_LOST = "�"

# Fixed values: (read as, truly) pairs of encodings that are tried.
UTF8_READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_15", "iso8859_2", "koi8_r", "cp866"]
SINGLE_BYTE = [
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp866", "cp1251"), ("koi8_r", "cp1251"),
    ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"),
    ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "koi8_r"), ("latin-1", "koi8_r"), ("cp1252", "cp1250"), ("cp1252", "cp866"),
]


def _encode(text: str, encoding: str) -> bytes | None:
    """Bytes of ``text``; C1 controls stand for the bytes that cp125x leaves undefined."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) <= 0x9F:
                return None
            out.append(ord(c))
    return bytes(out)


def _undo(text: str, read_as: str, truly: str) -> str | None:
    raw = _encode(text, read_as)
    if raw is None:
        return None
    try:
        return raw.decode(truly)
    except UnicodeDecodeError:
        return None


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of adjacent pairs of one task, as code points."""
    table, pairs = np.zeros(128 * 128, np.int64), Counter()
    for batch in batches:
        text = "\n".join(t for t in batch["text"] if t)
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if len(raw) > 1:
            plain = (raw[:-1] < 128) & (raw[1:] < 128)
            table += np.bincount((raw[:-1].astype(np.uint16) * 128 + raw[1:])[plain], minlength=128 * 128)
        clusters = Counter(m.group() + m.group(1) for m in _CLUSTER.finditer(text))
        for cluster, n in clusters.items():
            for a, b in zip(cluster, cluster[1:]):
                pairs[a, b] += n
    at = np.flatnonzero(table)
    yield pd.DataFrame({"a": at // 128, "b": at % 128, "n": table[at]}).astype("int64")
    if pairs:
        yield pd.DataFrame([(ord(a), ord(b), n) for (a, b), n in pairs.items()], columns=["a", "b", "n"]).astype("int64")


def pair_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(a, b, n)``: how often code point b follows a, over all texts whole."""
    counted = spread(documents.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))).mapInPandas(_count_pairs, "a bigint, b bigint, n bigint")
    return written(counted.groupBy("a", "b").agg(F.sum("n").alias("n")), "char-pairs")


class PairModel:
    """Smoothed pointwise mutual information of adjacent characters.

    The single counts are smoothed by a share of the corpus, so that pairs of
    two rare characters are improbable even where they always come together,
    as garbled pairs do. ``score`` ignores letter case, so capitals are as
    probable as small letters; ``cased`` heeds it.
    """

    def __init__(self, counts: list[tuple[int, int, int]] | np.ndarray, smooth: float = 0.05):
        table = np.asarray(counts, np.int64).reshape(-1, 3)
        small = {int(c): ord(chr(c).lower()) if len(chr(c).lower()) == 1 else int(c) for c in np.unique(table[:, :2])}
        lower = np.array([[small[int(a)], small[int(b)]] for a, b in table[:, :2]], np.int64).reshape(-1, 2)
        self.exact, self.exact_n = self._sums(table[:, 0] << 21 | table[:, 1], table[:, 2])
        self.folded, self.folded_n = self._sums(lower[:, 0] << 21 | lower[:, 1], table[:, 2])
        self.total = max(1, int(table[:, 2].sum()))
        self.first, self.second = Counter(), Counter()
        for (a, b), (low_a, low_b), n in zip(table[:, :2].tolist(), lower.tolist(), table[:, 2].tolist()):
            for x in {a, low_a}:
                self.first[chr(x)] += n
            for x in {b, low_b}:
                self.second[chr(x)] += n
        self.kappa = smooth * self.total
        self.floor = 0.02 * self.total / 1e6
        self.memory: dict[tuple[str, str, bool], float] = {}
        self.plain = np.array([[self.score(chr(a), chr(b)) for b in range(128)] for a in range(128)])

    def improbable(self, share: float) -> float:
        """The score below which the least probable ``share`` of all pairs lies."""
        if not len(self.folded):
            return 0.0
        kinds = np.array([self._pmi(chr(k >> 21), chr(k & 0x1FFFFF), False) for k in self.folded.tolist()])
        order = np.argsort(kinds, kind="stable")
        return float(kinds[order][np.searchsorted(np.cumsum(self.folded_n[order]), share * self.total)])

    @staticmethod
    def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, at = np.unique(keys, return_inverse=True)
        return distinct, np.bincount(at, n, len(distinct)) if len(distinct) else np.zeros(0)

    def _count(self, keys: np.ndarray, n: np.ndarray, a: str, b: str) -> float:
        key = ord(a) << 21 | ord(b)
        at = int(np.searchsorted(keys, key))
        return float(n[at]) if at < len(keys) and keys[at] == key else 0.0

    def _pmi(self, a: str, b: str, cased: bool) -> float:
        got = self.memory.get((a, b, cased))
        if got is None:
            if len(self.memory) > 500_000:
                self.memory.clear()
            n = self._count(self.exact, self.exact_n, a, b) if cased else self._count(self.folded, self.folded_n, a, b)
            got = self.memory[a, b, cased] = math.log((n + self.floor) * self.total / ((self.first[a] + self.kappa) * (self.second[b] + self.kappa)))
        return got

    def score(self, a: str, b: str) -> float:
        a, b = (x if len(x) == 1 else y for x, y in ((a.lower(), a), (b.lower(), b)))
        return self._pmi(a, b, False)

    def cased(self, a: str, b: str) -> float:
        return self._pmi(a, b, True)

    def total_score(self, text: str, cased: bool = False) -> float:
        score = self.cased if cased else self.score
        return sum(map(score, text, text[1:]))

    def improbability(self, text: str, threshold: float) -> np.ndarray:
        """How far the score of each adjacent pair of ``text`` lies below ``threshold``.

        Pairs of ASCII read the same in all the encodings, so they never add
        to a run: above zero they count as zero.
        """
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        narrow = np.minimum(codes, 127).astype(np.uint8)
        out = np.minimum(threshold - self.plain, 0)[narrow[:-1], narrow[1:]]
        wide = codes > 127
        at = np.flatnonzero(wide[:-1] | wide[1:])
        if len(at):
            kinds, of = np.unique(codes[at].astype(np.int64) << 21 | codes[at + 1], return_inverse=True)
            out[at] = threshold - np.array([self.score(chr(k >> 21), chr(k & 0x1FFFFF)) for k in kinds.tolist()])[of]
        return out

    def knows(self, c: str) -> bool:
        return c < "\x80" or self.first[c.lower()] + self.second[c.lower()] > 2e-7 * self.total


def pair_model(counts: DataFrame, most_kinds: int = 4_000_000) -> PairModel:
    """The model of ``pair_counts``, on the driver.

    It holds every kind of pair that occurs, 24 bytes each; kinds are bounded
    by the characters in use and not by the corpus. More than ``most_kinds``
    of them are an error.
    """
    rows = counts.select("a", "b", "n").limit(most_kinds + 1).toArrow()
    if rows.num_rows > most_kinds:
        raise ValueError(f"more than {most_kinds} kinds of character pairs")
    return PairModel(np.column_stack([rows.column(c).to_numpy() for c in ("a", "b", "n")]))


def segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring runs ``[start, end)`` of ``scores``, in one pass over the positive ones."""
    scores = np.asarray(scores, float)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    lowest = 0  # no run before this one begins below the runs to come
    for i in np.flatnonzero(scores > 0).tolist():
        run = (i, i + 1, sums[i], sums[i + 1])
        while True:
            j = len(found) - 1
            while j >= lowest and found[j][2] >= run[2]:
                j -= 1
            if j < lowest or found[j][3] >= run[3]:
                lowest = len(found) if j < lowest else lowest
                found.append(run)
                break
            run = (found[j][0], run[1], found[j][2], run[3])
            del found[j:]
    return [(a, b) for a, b, *_ in found]


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Segments of pairs whose characters touch, as one; ``[start, end)`` of pairs covers the characters start to end."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class Repairer:
    """Finds and undoes wrong readings; results are kept per distinct run.

    The least probable ``improbable`` of all pairs of the corpus add to the
    score of a segment and the others take from it; segments are the only
    places where mappings are tried. A mapping must raise
    the sum of the scores by ``gain_utf8``, or by ``gain_single`` per pair
    where it maps a byte to a byte.
    """

    def __init__(self, model: PairModel, improbable: float = 0.08, loose: float = 0.3, gain_utf8: float = 1.0, gain_single: float = 1.2, memory: int = 200_000):
        self.model, self.improbable, self.gain_utf8, self.gain_single, self.memory = model, model.improbable(improbable), gain_utf8, gain_single, memory
        self.loose = model.improbable(loose)
        self.known: dict[tuple[str, str, str], tuple | None] = {}

    def _best(self, left: str, run: str, right: str, depth: int = 0) -> tuple[float, str, tuple] | None:
        """(gain, restored run, mappings) of the best inverse mapping.

        Bytes that happen to form UTF-8 with characters the corpus knows are
        evidence of their own, so that mapping goes first.
        """
        before = left + run + right
        base, base_cased, best = self.model.total_score(before), None, None
        for read_as, truly in [(e, "utf-8") for e in UTF8_READ_AS] + SINGLE_BYTE:
            out = _undo(run, read_as, truly)
            if out is None or out == run or not out or _LOST in out or any(0x80 <= ord(c) <= 0x9F and depth > 1 for c in out):
                continue
            how = ((read_as, truly),)
            if truly == "utf-8" and depth < 2 and not out.isascii():
                deeper = self._best(left, out, right, depth + 1)
                if deeper and deeper[2][0][1] == "utf-8":
                    out, how = deeper[1], how + deeper[2]
            if not all(self.model.knows(c) for c in out):
                continue
            if truly != "utf-8" and best and best[2][0][1] == "utf-8":
                break
            gain, least = self.model.total_score(left + out + right) - base, self.gain_utf8
            if truly != "utf-8":
                if base_cased is None:
                    base_cased = self.model.total_score(before, True)
                gain, least = min(gain, self.model.total_score(left + out + right, True) - base_cased), self.gain_single * (len(before) - 1)
            if gain >= least and (best is None or (gain, len(how)) > (best[0], len(best[2]))):
                best = (gain, out, how)
        return best

    def run(self, left: str, run: str, right: str) -> tuple[str, tuple] | None:
        """(restored, mappings) of the characters outside ASCII in a segment, with their neighbours, or None."""
        key = (left, run, right)
        if key in self.known:
            return self.known[key]
        found = None
        for c, d in ((0, len(run)), (1, len(run)), (0, len(run) - 1)):  # a segment of pairs takes in one neighbour at either end, which may be sound
            if d > c and (best := self._best((left + run[:c])[-1:], run[c:d], (run[d:] + right)[:1])):
                rank = (best[2][0][1] == "utf-8", best[0])
                if found is None or rank > found[0]:
                    found = (rank, run[:c] + best[1] + run[d:], best[2])
        if len(self.known) > self.memory:
            self.known.clear()
        self.known[key] = found and (found[1], found[2])
        return self.known[key]

    def _by(self, how: tuple, left: str, run: str, right: str) -> str | None:
        """``run`` restored by the mappings ``how``, unless that makes it less probable."""
        slack = 0.0 if how[0][1] == "utf-8" else 0.5 * (len(left + run + right) - 1)  # bytes to bytes, and most of the text was read so
        for c, d in ((0, len(run)), *((c, len(run) - e) for c in range(4) for e in range(4) if 0 < c + e < len(run))):
            out: str | None = run[c:d]
            for step in how:
                out = out and _undo(out, *step)
            if out and all(self.model.knows(x) for x in out):
                a, b = (left + run[:c])[-1:], (run[d:] + right)[:1]
                if self.model.total_score(a + out + b) > self.model.total_score(a + run[c:d] + b) - slack:
                    return run[:c] + out + run[d:]
            if how[0][1] != "utf-8":
                break
        return None

    def _mapped(self, text: str, threshold: float, how: tuple | None) -> tuple[Counter, int, str]:
        """(mappings used, runs in segments, restored text) with segments below ``threshold``."""
        parts, at, used, runs = [], 0, Counter(), 0
        for start, stop in _joined(segments(self.model.improbability(text, threshold))):
            if how:  # a run is followed to its ends
                while start > at and text[start - 1] > "\x7f":
                    start -= 1
                while stop + 1 < len(text) and text[stop + 1] > "\x7f":
                    stop += 1
            for m in _WIDE.finditer(text, max(start, at), stop + 1):
                left, run, right = text[m.start() - 1 : m.start()] if m.start() else "", m.group(), text[m.end() : m.end() + 1]
                own = self._by(how, left, run, right) if how else None
                found = (own, how) if own else self.run(left, run, right)
                runs += not found or found[1][0][1] != "utf-8"
                if found:
                    used[found[1]] += 1
                    parts += [text[at : m.start()], found[0]]
                    at = m.end()
        return used, runs, "".join(parts) + text[at:]

    def text(self, text: str) -> tuple[int, int, str, str] | None:
        """(garbled runs, recoverable, restored text, mappings) or None for sound text.

        In a garbled text the mapping that serves most runs is then tried in
        the wider segments of a looser threshold; a mapping of bytes to bytes
        only if it serves two fifths of all runs that are not UTF-8.
        """
        if text.isascii():
            return None
        lost = _LOST in text
        used, runs, out = self._mapped(text, self.improbable, None)
        if not used and not lost:
            return None
        if used:
            how, n = used.most_common(1)[0]
            if how[0][1] == "utf-8" or n >= 0.4 * runs:
                used, _, out = self._mapped(text, self.loose, how)
        return sum(used.values()) + text.count(_LOST), int(not lost), out, ", ".join(sorted({"+".join(f"{a}>{b}" for a, b in k) for k in used}))


def repair_encoding(documents: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """``(doc_id, recoverable, garbled_runs, mappings[, restored])`` per document with garbled text.

    ``recoverable`` is 0 where replacement characters show that something was
    lost; ``restored`` then holds what can be had. Documents with null, empty
    or sound texts give no row; repeated rows give repeated rows; very long
    texts are treated whole. Other columns are ignored.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(pair_model(pair_counts(documents, text)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(model.value)
        for batch in batches:
            rows = []
            for key, value in zip(batch["doc_id"], batch["text"]):
                if value and (found := repairer.text(value)):
                    rows.append((key, found[1], found[0], found[3], found[2]) if with_text else (key, found[1], found[0], found[3]))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "recoverable", "garbled_runs", "mappings", "restored"][: len(rows[0])])

    kind = documents.schema[id_col].dataType.simpleString()
    schema = "doc_id string, recoverable int, garbled_runs bigint, mappings string" + ", restored string" * with_text
    return spread(documents.where(F.col(text).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("text"))).mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
