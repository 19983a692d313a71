"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, exception phrases, length-normalised scores.

Folding lower-cases, decomposes and strips marks, maps look-alike letters and digits inside words to the letters
they stand for, joins letters spelled apart, and leaves words parted by single spaces. The lexicon starts from
common insults and takes words and word beginnings from labelled rows; entries are chosen so that they cover the
toxic rows (each needs several), not because they merely come from one copied text.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Look-alike letters of other scripts and the Latin letters that they stand for.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g", "ɑ": "a",
}
#: Digits and signs written for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Insults that the lexicon starts from, with a weight of SEED_WEIGHT before rows are counted.
SEEDS = ("idiot", "stupid", "moron", "scum", "trash", "worthless", "disgusting", "pathetic", "loser", "clown")
#: Phrases in which such words are harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "sore loser")
SEED_WEIGHT = 3.0
SAMPLE = 3000  # toxic rows at most that the lexicon is learned from, and twice as many others, chosen by a hash of the id
LEAST_ROWS, LEAST_ODDS, DEMAND, SHORTEST, LONGEST = 2, 20.0, 3, 4, 7
MOST_ENTRIES = 5000  # of the lexicon; they are chosen from the four times as many that most toxic rows hold

_MARKS = {c: None for c in range(0x300, 0x370)} | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None, 0xFEFF: None}
_FOLD = _MARKS | {ord(k): v for k, v in LOOKALIKES.items()}
_SIGNED = re.compile(r"[0-9@$!|]")
_IN_WORD = re.compile(r"(?:(?<=[^\W\d_])[0-9]|[0-9@$!|]+(?=[^\W\d_]))")
_APART = re.compile(r"[^\W_]+")
_SPELLED = re.compile(r"(?:(?<= )[^\W\d_] ){3,}")


def fold(text: str | None) -> str:
    """Folded words parted by single spaces, with a space before the first and after the last."""
    t = (text or "").lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).translate(_FOLD)
    if _SIGNED.search(t):
        t = _IN_WORD.sub(lambda m: "".join(SIGNS.get(c, c) for c in m[0]), t)
    t = " " + " ".join(_APART.findall(t)) + " "
    apart = _SPELLED.findall(t)
    return t + "".join(x.replace(" ", "") + " " for x in apart) if apart else t


@dataclass
class Lexicon:
    """Entries as they stand in folded text (" word " or " begin"), their weights, and the scale of scores."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    scale: tuple[float, float, float]  # of 1, log(1 + hits), log(1 + weight per hundred words)

    def matcher(self):
        """text -> (score, hits, words)."""
        import ahocorasick

        auto = ahocorasick.Automaton()
        for k, w in self.weights.items():
            auto.add_word(k, (len(k), w))
        for k in self.exceptions:
            auto.add_word(f" {k} ", (len(k) + 2, None))
        auto.make_automaton()
        c, h, d = self.scale

        def score(text: str | None, folded: bool = False) -> tuple[float, int, int]:
            t = text if folded else fold(text)
            n = t.count(" ") - 1
            best: dict[int, float] = {}
            free = []
            for end, (size, w) in auto.iter(t):
                start = end - size + 1
                if w is None:
                    free.append((start, end))
                elif w > best.get(start, 0.0):
                    best[start] = w
            for a, b in free:
                for s in [s for s in best if a <= s < b]:
                    del best[s]
            hits, weight = len(best), sum(best.values())
            x = c + h * np.log1p(hits) + d * np.log1p(100.0 * weight / max(n, 1))
            return 1.0 / (1.0 + np.exp(-min(max(x, -30.0), 30.0))), hits, n

        return score


def _grams(folded: str) -> set[str]:
    """Words and word beginnings as entries."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample: labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    Of rows with one id the one whose text has the least hash stands for all, so repeated rows add nothing.
    """
    ids = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.where("crc32(cast(doc_id as string)) % 3 <> 1")
    pick = lambda y, n: ids.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = F.broadcast(pick(1, sample).union(pick(0, 2 * sample)))  # 3 * sample rows at most
    met = docs.select("doc_id", "text").join(chosen, "doc_id")
    return met.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("toxic").alias("toxic"))


def _folded(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            yield pa.RecordBatch.from_arrays([pa.array([fold(t) for t in part.column(0).to_pylist()], pa.string()), part.column(1)], ["text", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seeds: tuple = SEEDS, exceptions: tuple = EXCEPTIONS) -> Lexicon:
    """A lexicon from labelled rows of ``docs(doc_id, text)``; without labels, the seeds with a fixed scale.

    The sample is folded and written once; what follows reads that.
    """
    scratch = Scratch(docs.sparkSession, "lexicon")
    rows = scratch.table(training_rows(docs, labels, sample).select("text", "toxic").mapInArrow(_folded, "text string, toxic int"), "sample")

    def count(batches):
        toxic, other, rows_ = Counter(), Counter(), [0, 0]

        def made():
            keys = list(toxic | other)
            out = pa.RecordBatch.from_pydict({"gram": pa.array(["", *keys], pa.string()), "a": pa.array([rows_[1], *(toxic[k] for k in keys)], pa.int64()), "b": pa.array([rows_[0], *(other[k] for k in keys)], pa.int64())})
            toxic.clear()
            other.clear()
            rows_[:] = [0, 0]
            return out

        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    (toxic if y else other).update(_grams(text))
                    rows_[bool(y)] += 1
                    if len(toxic) + len(other) > 100_000:  # counts of a task are summed up to so many entries
                        yield made()
        yield made()

    counts = scratch.table(rows.mapInArrow(count, "gram string, a long, b long").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "counts")
    totals = counts.where("gram = ''").collect()
    n1, n0 = (totals[0].a, totals[0].b) if totals else (0, 0)
    odds = F.expr(f"((a + 0.5D) / {n1 + 1}) / ((b + 0.5D) / {n0 + 1})")
    wanted = [f" {s} " for s in seeds]
    found = counts.where("gram <> ''").where((F.col("a") >= LEAST_ROWS) & (odds >= LEAST_ODDS) | F.col("gram").isin(wanted)).withColumn("odds", odds)
    found = found.orderBy(F.desc("a"), F.desc("odds"), "gram").limit(4 * MOST_ENTRIES).collect()
    weights = {w: SEED_WEIGHT for w in wanted}
    known = {r.gram: float(np.log(r.odds)) for r in found}
    for w in wanted:
        if w in known:
            weights[w] = max(0.0, SEED_WEIGHT / 2 + known.pop(w) / 2)
    # the fewest entries that cover each toxic row DEMAND times; what the seeds cover needs no more
    index = {g: i for i, g in enumerate([*wanted, *known])}

    def hits(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.column(0).slice(a, 64).to_pylist()
                yield pa.RecordBatch.from_pydict({"hits": pa.array([sorted(index[g] for g in _grams(t) if g in index) for t in part], pa.list_(pa.int64()))})

    held = [set(r.hits) for r in rows.where("toxic = 1").select("text").mapInArrow(hits, "hits array<long>").collect()]  # sample rows at most
    need = [DEMAND - sum(i < len(wanted) for i in h) for h in held]
    names = list(index)
    where: dict[int, list[int]] = {}
    for r, h in enumerate(held):
        for i in h:
            if i >= len(wanted):
                where.setdefault(i, []).append(r)
    # more rows first, then longer entries, then the later in the alphabet; gains only shrink, and are refreshed when their turn comes
    turn = [(-sum(need[r] > 0 for r in rs), -len(names[i]), tuple(-ord(c) for c in names[i]), i) for i, rs in where.items()]
    heapq.heapify(turn)
    while turn and len(weights) < MOST_ENTRIES:
        gain, *rank, i = heapq.heappop(turn)
        now = sum(need[r] > 0 for r in where[i])
        if now < -gain:
            heapq.heappush(turn, (-now, *rank, i))
            continue
        if now < LEAST_ROWS:
            break
        weights[names[i]] = known[names[i]]
        for r in where[i]:
            need[r] -= 1
    lexicon = Lexicon({k: w for k, w in weights.items() if w > 0}, exceptions, (-4.0, 2.0, 1.0))
    if n1 and n0:
        lexicon.scale = _calibrated(rows, lexicon)
    return lexicon


def _calibrated(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression of the label on hits and weight per hundred words, by Newton steps with a small ridge."""

    def run(batches):
        score = Lexicon(lexicon.weights, lexicon.exceptions, (0.0, 0.0, 1.0)).matcher()
        for batch in batches:
            got = [score(t, folded=True) for a in range(0, batch.num_rows, 64) for t in batch.column(0).slice(a, 64).to_pylist()]
            density = [float(np.log(s / (1 - s))) if s < 1 else 30.0 for s, _, _ in got]
            yield pa.RecordBatch.from_pydict({"h": pa.array([float(np.log1p(h)) for _, h, _ in got], pa.float64()), "d": pa.array(density, pa.float64()), "y": batch.column(1).cast(pa.int64())})

    got = rows.select("text", "toxic").mapInArrow(run, "h double, d double, y long").collect()  # three samples at most
    got.sort()
    x = np.array([(1.0, r.h, r.d) for r in got])
    y = np.array([r.y for r in got], float)
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([1e-3, 0.5, 0.5])
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
    # more hits and more weight are never less toxic
    return (float(beta[0]), max(float(beta[1]), 0.05), max(float(beta[2]), 0.05))


def scored(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits) of every row, in their texts alone.

    Null and empty texts have no hits and get the lowest score. A null id is held out. Rows are scored one by one:
    repeated ids and other columns do no harm; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # MOST_ENTRIES entries at most
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches):
        score = shared.value.matcher()
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                got = [score(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([float(s) for s, _, _ in got], pa.float64()), pa.array([h for _, h, _ in got], pa.int64())], ["doc_id", "score", "hits"])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, hits long")
    return out.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")
