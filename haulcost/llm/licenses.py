"""Licence scans: which paragraphs declare which family of licences.

A logistic regression over sparse word n-grams reads every stretch of every paragraph
and gives it a family, ``unknown`` for a licence of no listed family, or none. It is
trained on the families' wordings, on declarations of unlisted licences and on
paragraphs that declare nothing; its probabilities are calibrated on rows that it was
not trained on, among them unlisted licences that it never saw, and the least
probability that counts follows from the same rows. Template comparison then confirms a
prediction: a row of a family needs one of that family's wordings there. A stretch that
surely declares something, and in which no wording is confirmed, is ``unknown``, as is a
wording whose family is not predicted. A paragraph is a run of lines that are not
blank, so that wordings may be wrapped. Each line where declarations start gives a row
for each family, the surest of its declarations; ``paragraph`` is that line's number.

Defined cases: NULL and empty texts, and paragraphs that declare nothing, give no row;
repeated rows give a row each; long paragraphs are read whole; what touches a confirmed
wording within a stretch is explained by it and not unknown; paragraphs of fewer than
four words are only compared with the wordings; an empty table gives no rows. Only
doc_id and text are read.
"""

from __future__ import annotations

import collections
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcost.llm.license_texts import ABOUT, TEMPLATES, UNLISTED
from haulcost.llm.words import take

UNKNOWN = "unknown"
NONE = "none"
#: Documents whose paragraphs serve as background: the first so many by a hash of doc_id.
BACKGROUND_DOCUMENTS = 400
#: Characters of a piece of a background paragraph.
PIECE = 400
#: Words of a stretch and from one stretch to the next.
STRETCH = 48
STEP = 24
#: Share of a wording's word triples that confirms it, and the share that makes a stretch of interest.
CONFIRMED = 0.6
#: Words from a wording's triple to the next, beyond which a first or last one may be chance.
LONE = 6
#: Share of background that may pass the probability threshold.
FALSE_ALARMS = 0.002
#: Least probability of a declaration that no wording confirms, and its least words.
UNCONFIRMED = 0.9
LEAST_WORDS = 4
#: Every so many-th unlisted licence is kept for calibration.
HELD_LICENCES = 4
#: Variants of each wording for training.
VARIANTS = 40

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def license_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def paragraphs(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """Words of each run of lines that are not blank, and the line that each word stands in."""
    found, line_of = [], []
    for line, content in enumerate(text.split("\n")):
        own = license_words(content)
        found += own
        line_of += [line] * len(own)
        if found and not content.strip():
            yield found, line_of
            found, line_of = [], []
    if found:
        yield found, line_of


def triples(words: list[str]) -> set[tuple[str, ...]]:
    width = min(3, len(words))
    return set(zip(*[words[k:] for k in range(width)], strict=False)) if width else set()


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def stretches(words: list[str]) -> list[list[str]]:
    last = max(0, len(words) - STRETCH)
    return [words[i : i + STRETCH] for i in [*range(0, last, STEP), last]]


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    temperature: float
    threshold: float
    wordings: list[tuple[str, set]]

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = [self.vocabulary[g] for g in grams(words) if g in self.vocabulary]
        return softmax((self.weights[at].sum(0) + self.weights[-1]) / self.temperature)

    def occurrences(self, words: list[str]) -> Iterator[tuple[str, float, int, int]]:
        """Family, similarity and place of every confirmed wording, within a stretch's length."""
        hits = collections.defaultdict(list)
        for width in (2, 3):
            for at, t in enumerate(zip(*[words[k:] for k in range(width)], strict=False)):
                for wording in self.known.get(t, ()):
                    hits[wording].append((at, t))
        for wording, own in sorted(hits.items()):
            family, all_triples = self.wordings[wording]
            least = CONFIRMED * len(all_triples)
            group = {}  # triple to its place, in order of places
            for at, t in [*own, (len(words) + STRETCH, None)]:
                first = next(iter(group.values()), at)
                if len(group) >= least and (t in group or at - first > STRETCH - 3):
                    same, start, end = self._tight(group, len(all_triples), least)
                    yield family, same, start, min(end, len(words))
                    group = {}
                group.pop(t, None)
                group = {k: v for k, v in group.items() if at - v <= STRETCH - 3}
                group[t] = at

    @staticmethod
    def _tight(group: dict, of: int, least: float) -> tuple[float, int, int]:
        """Similarity and place without lone triples far from the rest."""
        places = list(group.values())
        while len(places) - 1 >= least and places[1] - places[0] > LONE:
            places.pop(0)
        while len(places) - 1 >= least and places[-1] - places[-2] > LONE:
            places.pop()
        return len(places) / of, places[0], places[-1] + 3

    def verdicts(self, words: list[str]) -> list[tuple[int, str, float, float]]:
        """First word, family, probability and similarity of every declaration."""
        none = self.families.index(NONE)
        sure, rest = [], []
        for family, same, start, end in self.occurrences(words):
            # The wording alone, so that families side by side do not share a probability,
            # and with the words around it.
            around = max(0, min(start - (STRETCH - (end - start)) // 2, len(words) - STRETCH))
            both = [self.probabilities(w) for w in (words[start:end], words[around : around + STRETCH])]
            at = self.families.index(family)
            own = max((float(p[at]) for p in both if int(np.argmax(p)) == at), default=0.0)
            if own >= self.threshold:
                sure.append((start, end, family, own, same))
            else:
                rest.append((start, end, UNKNOWN, max(float(1 - p[none]) for p in both), same))
        # What a family explains is not unknown.
        rest = [r for r in rest if not any(r[0] < s[1] and s[0] < r[1] for s in sure)]
        known, end = sure + rest, 0
        for stretch, telling in self.declared(words):
            if any(stretch[0] < s[1] and s[0] < stretch[1] for s in known):
                continue
            row = (telling, *stretch[1:])
            if stretch[0] < end:  # the same declaration as the last one's
                rest[-1] = max(rest[-1], row, key=lambda r: r[3])
            else:
                rest.append(row)
            end = stretch[1]
        return [(start, *row) for start, _, *row in sorted(sure + rest)]

    def declared(self, words: list[str]) -> Iterator[tuple[tuple, int]]:
        """Stretches that surely declare something: place, ``unknown``, probability, similarity; telling word."""
        if len(words) < LEAST_WORDS:
            return
        found = self._found(words)
        none, last = self.families.index(NONE), max(0, len(words) - STRETCH)
        # No stretch whose grams cannot outweigh this has so high a probability.
        odds = UNCONFIRMED / (1 - UNCONFIRMED) / (len(self.families) - 1)
        needed = self.temperature * np.log(odds) - 1e-9
        margins, low = self.margins, 0
        for start in [*range(0, last, STEP), last]:
            end = start + STRETCH
            while low < len(found) and found[low][0] < start:
                low += 1
            own, at = {}, low
            while at < len(found) and found[at][0] < end:
                place, gram, width = found[at]
                if place + width <= end:
                    own.setdefault(gram, place)
                at += 1
            if not own or margins[-1] + sum(margins[g] for g in own) < needed:
                continue
            p = softmax((self.weights[list(own)].sum(0) + self.weights[-1]) / self.temperature)
            if 1 - p[none] >= max(UNCONFIRMED, self.threshold):
                most = max(margins[g] for g in own)
                telling = min(own[g] for g in own if 2 * margins[g] >= most)
                same = self.similarity(words[start:end])
                yield (start, min(end, len(words)), UNKNOWN, float(1 - p[none]), same), telling

    def _found(self, words: list[str]) -> list[tuple[int, int, int]]:
        """Place, number and words of every gram of the vocabulary, in order of places."""
        vocabulary, out = self.vocabulary, []
        one = [vocabulary.get(w) for w in words]
        for i, gram in enumerate(one):
            if gram is None:
                continue
            out.append((i, gram, 1))
            text = words[i]
            for width in (2, 3):
                if i + width > len(words) or one[i + width - 1] is None:
                    break
                text = f"{text} {words[i + width - 1]}"
                longer = vocabulary.get(text)
                if longer is not None:
                    out.append((i, longer, width))
        return out

    def similarity(self, words: list[str]) -> float:
        """The largest share of a wording's triples that a stretch holds."""
        own = triples(words) | set(zip(words, words[1:], strict=False))
        counts = collections.Counter(w for t in own for w in self.known.get(t, ()))
        return max((n / len(self.wordings[w][1]) for w, n in counts.items()), default=0.0)

    @property
    def margins(self) -> list[float]:
        """By how much each gram can speak for a declaration rather than none."""
        if not hasattr(self, "_margins"):
            none = self.families.index(NONE)
            against = np.delete(self.weights, none, 1) - self.weights[:, [none]]
            self._margins = against.max(1).tolist()
        return self._margins

    def judge(self, words: list[str]) -> tuple[str, float, float] | None:
        """Family, probability and similarity of the surest declaration."""
        found = [row for _, *row in self.verdicts(words)]
        return tuple(max(found, key=lambda r: (r[0] != UNKNOWN, r[1]))) if found else None

    @property
    def known(self) -> dict[tuple, list[int]]:
        """Every triple's wordings."""
        if not hasattr(self, "_known"):
            self._known = collections.defaultdict(list)
            for wording, (_, found) in enumerate(self.wordings):
                for t in found:
                    self._known[t].append(wording)
        return self._known


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _variants(words: list[str], filler: list[str], rng: random.Random) -> Iterator[list[str]]:
    """The wording itself, then with words left out, cut short and among other words."""
    yield words
    for _ in range(VARIANTS - 1):
        kept = [w for w in words if rng.random() > 0.06] or words
        if len(kept) > 14 and rng.random() < 0.4:
            start = rng.randrange(len(kept) - 10)
            kept = kept[start : start + rng.randint(10, len(kept))]
        around = [rng.choice(filler) for _ in range(rng.choice([0, 0, 4, 12, 30]))] if filler else []
        cut = rng.randint(0, len(around))
        yield (around[:cut] + kept + around[cut:])[:STRETCH]


def train(background: list[str], rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Fit on the wordings' variants and unlisted licences against background and talk about licences."""
    rng = random.Random(7)
    families = [*TEMPLATES, UNKNOWN, NONE]
    wordings = [(f, triples(license_words(t))) for f, texts in TEMPLATES.items() for t in texts]
    known = set().union(*[t for _, t in wordings])
    plain = [s for text in background for s in stretches(license_words(text)) if s]
    plain = [s for s in plain if not triples(s) & known]
    filler = [w for s in plain for w in s][:50_000] or license_words(" ".join(ABOUT))
    learned = [t for i, t in enumerate(UNLISTED) if i % HELD_LICENCES]
    unseen = [t for i, t in enumerate(UNLISTED) if not i % HELD_LICENCES]
    # Words of no wording, and none at all, declare nothing, however small the background.
    rows = [(s, NONE) for s in plain] + [([], NONE)] * VARIANTS
    for family, texts in {**TEMPLATES, UNKNOWN: learned, NONE: ABOUT}.items():
        for text in texts:
            rows += [(v, family) for v in _variants(license_words(text), filler, rng)]
    rng.shuffle(rows)
    never = [(v, UNKNOWN) for text in unseen for v in _variants(license_words(text), filler, rng)]
    held = np.array([i % 4 == 3 for i in range(len(rows))] + [True] * len(never))
    rows += never
    ours = [*(t for texts in TEMPLATES.values() for t in texts), *learned, *ABOUT]
    vocabulary = {g: i for i, g in enumerate(sorted(set().union(*[grams(license_words(t)) for t in ours])))}
    features = [[vocabulary[g] for g in grams(words) if g in vocabulary] for words, _ in rows]
    labels = np.array([families.index(f) for _, f in rows])
    weights = np.zeros((len(vocabulary) + 1, len(families)))

    def scores(which: np.ndarray) -> np.ndarray:
        at = [features[i] for i in which]
        row = np.repeat(np.arange(len(which)), [len(x) for x in at])
        total = np.tile(weights[-1], (len(which), 1))
        np.add.at(total, row, weights[np.concatenate([np.array(x, int) for x in at])])
        return total

    fitted = np.flatnonzero(~held)
    flat = np.concatenate([np.array(features[i], int) for i in fitted])
    row = np.repeat(np.arange(len(fitted)), [len(features[i]) for i in fitted])
    # Both kinds of rows weigh the same in total.
    none = families.index(NONE)
    balance = np.ones(len(fitted))
    for kind in (True, False):
        part = (labels[fitted] == none) == kind
        balance[part] /= max(1, part.sum()) * 2
    squares = np.full_like(weights, 1e-8)
    # Rows by gram, each gram's together, so that its gradient is a sum over a run.
    by_gram = np.argsort(flat, kind="stable")
    present, runs = np.unique(flat[by_gram], return_index=True)
    gathered, filled = row[by_gram], np.unique(row, return_index=True)
    for _ in range(rounds):
        z = np.tile(weights[-1], (len(fitted), 1))
        z[filled[0]] += np.add.reduceat(weights[flat], filled[1])
        p = softmax(z)
        p[np.arange(len(fitted)), labels[fitted]] -= 1
        p *= balance[:, None]
        gradient = decay * weights
        gradient[present] += np.add.reduceat(p[gathered], runs)
        gradient[-1] += p.sum(0)
        squares += gradient**2
        weights -= rate * gradient / np.sqrt(squares)
    check = np.flatnonzero(held)
    z, truth = scores(check), labels[check]

    def loss(t: float) -> float:
        return -np.log(softmax(z / t)[np.arange(len(check)), truth] + 1e-12).mean()

    temperature = float(min(np.geomspace(0.2, 5, 41), key=loss))
    p = softmax(z / temperature)
    alarms = np.sort(np.delete(p, none, 1).max(1)[truth == none])
    allowed = int(len(alarms) * FALSE_ALARMS) + 1
    threshold = max(0.5, float(alarms[-allowed])) if len(alarms) >= allowed else 0.5
    return Model(families, vocabulary, weights, temperature, min(threshold, 0.9), wordings)


def background(documents: DataFrame, documents_read: int = BACKGROUND_DOCUMENTS) -> list[str]:
    """Paragraphs of a bounded number of documents, first by a hash of their id."""
    ids = (
        documents.select("doc_id")
        .filter("doc_id is not null")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(documents_read)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    # Pieces of paragraphs, so that the sample is bounded in bytes too.
    runs = rows.select(F.explode(F.split("text", r"\n[^\S\n]*\n")).alias("run"))
    pieces = F.regexp_extract_all("run", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    found = runs.select(F.explode(pieces).alias("p")).filter("trim(p) <> ''")
    return sorted(r.p for r in found.orderBy(F.xxhash64("p"), "p").limit(10 * documents_read).collect())


def scan(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, paragraph, family, probability and similarity; ``paragraph`` is the line where a declaration starts."""
    docs = take(documents, doc_id="doc_id", text="text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text")):
                best = {}
                for found, line_of in paragraphs(text.as_py() or ""):
                    for start, *verdict in own.verdicts(found):
                        key = line_of[start], verdict[0]
                        best[key] = max(best.get(key, verdict), verdict)
                at += [i] * len(best)
                rows += [(line, *best[line, family]) for line, family in sorted(best)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int32())),
                    *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ],
                names=["doc_id", "paragraph", "family", "probability", "similarity"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        judge, f"doc_id {kind}, paragraph int, family string, probability double, similarity double"
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents where a licence is declared, with each family declared."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(documents, train(background(documents)))
