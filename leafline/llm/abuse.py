"""p8: abusive, hateful or sexual passages, by multiple-instance learning from document labels.

A document is a bag of sentences; a sentence of more than ``WINDOW`` words is looked at in windows of that many, each
overlapping the next by half. The chance of a sentence or window is a logistic function of its hashed word 1- to
3-grams; a document's chance is the noisy-or of its windows' chances, the same in training and in scoring, so labels of
whole documents train a scorer that finds the sentences. Disguises are undone before words are counted: compatibility
forms, invisible characters, look-alike letters, accents, digits for letters, letters set apart, stretched letters,
masked letters. A document is offensive if it holds a passage, a window whose own chance reaches ``THRESHOLD``; passages
are returned in the words of the source, with their offsets.

The model is trained on at most ``MAX_LABELLED`` labelled documents (the smallest hashes of all labelled ones). Each
round every partition adds up the gradient of its documents, and the driver, which holds one number a word or word
group seen in ``MIN_DOCS`` of these documents, sums them and takes a step; so its size does not depend on the corpus.
Every document is scored in full. Of an annotator's labels of a document the latest counts; null labels are ignored;
annotators' labels are averaged. Labels that the first ``ROUNDS`` contradict by ``CONTRADICTED`` or more are set aside
for the last ``AGAIN`` rounds, as annotators err.

Null, empty and wordless texts score 0. Without any usable label every score is 0. Rows are scored one by one,
so repeated ids give repeated rows.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.session import materialize, small

MAX_LABELLED, BITS, WINDOW, THRESHOLD, CONTRADICTED = 20_000, 18, 24, 0.25, 0.9
ROUNDS, AGAIN, RATE, DECAY, MIN_DOCS = 30, 10, 0.3, 2e-5, 3
#: Power of the logistic function in a chance: it keeps a long text from adding up the small chances of harmless sentences.
SHARP, START = 3, -1.0

PASSAGES = pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKE = dict(zip("аеорсухіјѕԁһӏквмнтԛԝгАВЕКМНОРСТУХІЈЅαεικνορτυχ", "aeopcyxijsdhlkbmhtqwrABEKMHOPCTYXIJSaeiknoptux"))
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "l": "i"})
_FOLD = {ord(k): v for k, v in LOOKALIKE.items()}
_LOOKS = re.compile(f"[{''.join(LOOKALIKE)}]")
_UNSEEN = re.compile(f"[\xad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff{''.join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.combining(c))}]+")
_APART = re.compile(r"(?<![^\W_])(?:[^\W_][._\-]){2,}[^\W_](?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_] ){2,}[^\W_](?![^\W_])")
#: What texts hold that one of the two can match: quick to look for.
_MAY_APART, _MAY_SPACED = re.compile(r"[._\-][^\W_][._\-]"), re.compile(r" [^\W_] [^\W_](?![^\W_])")
_END = re.compile(r"[.!?…。！？]([\"'»”)]*\s+)|[\r\n]+")
_WORD = re.compile(r"\n|[@$!]?\w+(?:[@$!]\w+|\*+\w*)*")
_RAW = re.compile(r"\S+")
_RUN = re.compile(r"(.)\1+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
BREAK = 0


def undisguise(text: str) -> str:
    """Line feeds stay as they are, and none are added; underscores go."""
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
        if _LOOKS.search(text):
            text = text.translate(_FOLD)
    text = text.lower()
    if _MAY_APART.search(text):
        text = _APART.sub(lambda m: re.sub(r"[._\-]", "", m.group()) if sum(c.isalpha() for c in m.group()) > 2 else m.group(), text)
    if _MAY_SPACED.search(text):
        text = _SPACED.sub(lambda m: m.group().replace(" ", "") if sum(c.isalpha() for c in m.group()) > 2 else m.group(), text)
    return text.replace("_", " ")


class Words(dict):
    """Maps a raw token to the 64-bit id of its canonical form: digits as letters, l as i, runs as one letter."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        if token == "\n":
            return BREAK
        if token.isdigit():
            canon = "0"
        elif "*" in token:
            canon = "*" + token[0]
        else:
            canon = _RUN.sub(r"\1", token.translate(LEET))
        value = 1469598103934665603
        for b in canon.encode("utf-8", "replace"):
            value = ((value ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
        value = value or 1
        self[token] = value
        return value


_WORDS = Words()


def stretches(text: str) -> list[tuple[int, int, int]]:
    """(sentence, start, end) of the sentences of a text; of longer ones than a window, of stretches of half a window.

    No stretch begins or ends between two letters that stand alone, as these may be a word set apart.
    """
    out, at, number = [], 0, 0
    for start, end in [*((m.start(1) if m.group(1) else m.start(), m.end()) for m in _END.finditer(text)), (len(text), len(text))]:
        sentence = text[at:start]
        words = len(sentence.split()) if len(sentence) > 2 * WINDOW else int(bool(sentence) and not sentence.isspace())
        if words > WINDOW:
            spans = [m.span() for m in _RAW.finditer(sentence)]
            alone = [e - s == 1 for s, e in spans]
            first = 0
            while first < len(spans):
                last = first + WINDOW // 2
                while last < len(spans) and alone[last - 1] and alone[last]:
                    last += 1
                last = min(last, len(spans))
                out.append((number, at + spans[first][0], at + spans[last - 1][1]))
                first = last
        elif words:
            out.append((number, at, start))
        number += bool(words)
        at = end
    return out


class Bags(NamedTuple):
    """Features of many documents: ``ids`` with the slot of each; slot 2k is stretch k, slot 2k+1 what runs from k into k+1.

    Windows are (first stretch, whether it goes on into the next one) in order, ``doc`` being the document of each.
    """

    ids: np.ndarray
    slot: np.ndarray
    first: np.ndarray
    two: np.ndarray
    doc: np.ndarray

    def sums(self, value: np.ndarray) -> np.ndarray:
        """Per window, the sum of a value per slot."""
        return value[2 * self.first] + np.where(self.two, value[2 * self.first + 1] + value[2 * self.first + 2], 0)

    def lengths(self) -> np.ndarray:
        return np.maximum(self.sums(np.bincount(self.slot, minlength=2 * self.n_stretches + 1)), 1)

    @property
    def n_stretches(self) -> int:
        return int(self.first.max() + 2) if len(self.first) else 0

    def chances(self, w: np.ndarray, b: float) -> np.ndarray:
        """The chance of each window."""
        return self.logistic(w, b) ** SHARP

    def logistic(self, w: np.ndarray, b: float) -> np.ndarray:
        z = self.sums(np.bincount(self.slot, w[self.ids], 2 * self.n_stretches + 1))
        return _sigmoid(z / np.sqrt(self.lengths()) + b)


def features(texts: list[str | None]) -> tuple[Bags, list[list[tuple[int, int, int]]]]:
    """The bags of the documents and the stretches of each."""
    cuts = [stretches(t) if t else [] for t in texts]
    tokens: list[int] = []
    for text, cut in zip(texts, cuts):
        if cut:
            tokens += [_WORDS[t] for t in _WORD.findall(undisguise("\n".join([text[s:e] for _, s, e in cut])))]
            tokens.append(BREAK)
    h = np.array(tokens, np.uint64)
    word = h != BREAK
    stretch = (np.cumsum(~word) - ~word)[word] if len(h) else np.zeros(0, int)
    h = h[word]
    owner = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
    sentence = np.array([s for c in cuts for s, _, _ in c], int)
    n = len(sentence)
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = (owner[1:] == owner[:-1]) & (sentence[1:] == sentence[:-1])
    comes = np.zeros(n, bool)
    comes[1:] = goes_on[:-1]
    ids, slots = [h], [2 * stretch]
    with np.errstate(over="ignore"):
        two = (h[:-1] * _MULT) ^ (h[1:] + np.uint64(2)) if len(h) else h
        three = (two[:-1] * _MULT) ^ (h[2:] + np.uint64(3)) if len(h) > 2 else h[:0]
        for gram, k in ((two, 1), (three, 2)):
            a, z = stretch[: len(gram)], stretch[k : k + len(gram)]
            ok = (z == a) | ((z == a + 1) & goes_on[np.minimum(a, max(n - 1, 0))]) if n else np.zeros(0, bool)
            ids.append(gram[ok])
            slots.append((a + z)[ok])
        every = ((np.concatenate(ids) * _MULT) >> np.uint64(64 - BITS)).astype(np.int32)
    first = np.flatnonzero(goes_on | ~comes)  # the last stretch of a longer sentence stands in the window before it
    return Bags(every, np.concatenate(slots).astype(np.int32), first.astype(np.int32), goes_on[first], owner[first].astype(np.int32)), cuts


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-7)), n)) if len(p) else np.zeros(n)


def passages(text: str, p: np.ndarray, first: np.ndarray, two: np.ndarray, cut: list[tuple[int, int, int]]) -> list[dict]:
    """The windows whose own chance reaches the threshold, in the words of the source."""
    out = []
    for k in np.flatnonzero(p >= THRESHOLD):
        number, start, _ = cut[first[k]]
        end = cut[first[k] + bool(two[k])][2]
        out.append({"sentence": number, "start": start, "end": end, "score": float(p[k]), "text": text[start:end]})
    return out


def gradient(bags: Bags, y: np.ndarray, weight: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Summed gradient, by weights and bias, of the log loss of the noisy-or over documents."""
    one, length = bags.logistic(w, b), bags.lengths()
    p = one**SHARP
    bad = np.maximum(noisy_or(p, bags.doc, len(y)), 1e-6)
    g = SHARP * p * (1 - one) / np.maximum(1 - p, 1e-7) * (1 - (y / bad)[bags.doc]) * weight[bags.doc]
    per_slot = np.zeros(2 * bags.n_stretches + 1)
    scaled = g / np.sqrt(length)
    np.add.at(per_slot, 2 * bags.first, scaled)
    for k in (1, 2):
        np.add.at(per_slot, 2 * bags.first[bags.two] + k, scaled[bags.two])
    return np.bincount(bags.ids, per_slot[bags.slot], len(w)), float(g.sum())


class Steps:
    """Adam over the weights and, last, the bias."""

    def __init__(self, n: int):
        self.w, self.m, self.v, self.k = np.r_[np.zeros(n), START], np.zeros(n + 1), np.zeros(n + 1), 0

    def take(self, g: np.ndarray) -> None:
        g = g + np.r_[DECAY * self.w[:-1], 0]
        self.k += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.99 * self.v + 0.01 * g * g
        self.w = self.w - RATE * (self.m / (1 - 0.9**self.k)) / (np.sqrt(self.v / (1 - 0.99**self.k)) + 1e-7)


def votes(labels: DataFrame) -> DataFrame:
    """(doc_id, y, n): mean and number of the annotators' latest non-null labels."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("offensive").isNotNull()).select(
        "doc_id", F.coalesce("annotator", F.lit("")).alias("annotator"), F.col("offensive").cast("double").alias("o"), "labelled_at"
    )
    last = rows.groupBy("doc_id", "annotator").agg(F.max(F.struct("labelled_at", "o")).alias("l"))
    return last.groupBy("doc_id").agg(F.avg("l.o").alias("y"), F.count(F.lit(1)).alias("n"))


BLOB = "ids binary, slot binary, first binary, two binary, doc binary, y binary, weight binary"


def _unpacked(batch: pa.RecordBatch):
    kinds = ("<i4", "<i4", "<i4", "?", "<i4", "<f8", "<f8")
    for row in zip(*(c.to_pylist() for c in batch.columns)):
        *bag, y, weight = (np.frombuffer(v, k) for v, k in zip(row, kinds))
        yield Bags(*bag), y, weight


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float] | None:
    """The weights and the bias, learned by summed gradients from a bounded number of labelled documents."""
    sc = documents.sparkSession.sparkContext
    chosen = materialize(votes(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "votes")
    texts = documents.select("doc_id", "text").join(small(chosen), "doc_id")

    def featured(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                bags, _ = features(batch.column("text").to_pylist())
                row = [*bags, batch.column("y").to_numpy(), np.sqrt(batch.column("n").to_numpy()).astype("<f8")]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in row], [c.split()[0] for c in BLOB.split(", ")])

    rows = materialize(texts.select("text", "y", "n").mapInArrow(featured, BLOB), "bags")

    def counted(batches):
        seen, docs = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for bags, y, _ in _unpacked(batch):
                owner = np.zeros(bags.n_stretches + 1, np.int64)
                owner[bags.first], owner[bags.first + bags.two] = bags.doc, bags.doc
                pair = np.unique(bags.ids.astype(np.int64) * len(y) + owner[bags.slot // 2])
                seen += np.bincount(pair // len(y), minlength=1 << BITS)
                docs += len(np.unique(bags.doc))
        if docs:
            at = np.flatnonzero(seen).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([at.tobytes()], pa.binary()), pa.array([seen[at].astype("<i4").tobytes()], pa.binary())], ["docs", "at", "n"])

    seen, docs = np.zeros(1 << BITS, np.int64), 0
    for r in rows.mapInArrow(counted, "docs long, at binary, n binary").collect():  # as many as tasks, of bounded size
        docs += r["docs"]
        seen[np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["n"], "<i4")
    if not docs:
        return None
    active = np.flatnonzero(seen >= min(MIN_DOCS, 1 + docs // 200))
    where = sc.broadcast(active)
    steps = Steps(len(active))

    def spread_out(w: np.ndarray, active: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[active] = w[:-1]
        return out

    def round_of(now, strict):
        def run(batches):
            active = where.value
            w, total, mass = spread_out(now.value, active), np.zeros(len(active) + 1), 0.0
            before = spread_out(strict[0].value, active) if strict else None
            for batch in batches:
                for bags, y, weight in _unpacked(batch):
                    weight = weight * (np.bincount(bags.doc, minlength=len(y)) > 0)
                    if strict:
                        guess = noisy_or(bags.chances(before, strict[0].value[-1]), bags.doc, len(y))
                        weight = weight * (np.abs(guess - y) < CONTRADICTED)
                    g, gb = gradient(bags, y, weight, w, now.value[-1])
                    total += np.r_[g[active], gb]
                    mass += weight.sum()
            yield pa.RecordBatch.from_arrays([pa.array([mass]), pa.array([total.astype("<f8").tobytes()], pa.binary())], ["mass", "g"])

        return run

    strict = ()
    for k in range(ROUNDS + AGAIN):
        if k == ROUNDS:
            strict = (sc.broadcast(steps.w),)
        now = sc.broadcast(steps.w)
        got = rows.mapInArrow(round_of(now, strict), "mass double, g binary").collect()  # a row a task
        mass = sum(r["mass"] for r in got)
        if mass:
            steps.take(sum(np.frombuffer(r["g"], "<f8") for r in got) / mass)
        now.unpersist()
    return spread_out(steps.w, active).astype(np.float32), float(steps.w[-1])


def score_documents(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, source, score, worst, passages): the chance of each document, all windows whose own chance reaches the
    threshold, and the text of the worst of them; both null if there are none. ``start`` and ``end`` of a passage count
    code points of the source text."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, max_labelled))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        learned = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column("text").to_pylist()
                score, worst, located = np.zeros(len(texts)), [None] * len(texts), [None] * len(texts)
                if learned:
                    bags, cuts = features(texts)
                    p = bags.chances(*learned)
                    p[bags.lengths() * (np.bincount(bags.slot, minlength=2 * bags.n_stretches + 1)[2 * bags.first] > 0) == 0] = 0
                    score = noisy_or(p, bags.doc, len(texts))
                    ends = np.searchsorted(bags.doc, np.arange(len(texts) + 1))
                    begins = np.cumsum([0, *(len(c) for c in cuts)])
                    for k in np.unique(bags.doc[p >= THRESHOLD]):
                        mine = slice(ends[k], ends[k + 1])
                        located[k] = passages(texts[k], p[mine], bags.first[mine] - begins[k], bags.two[mine], cuts[k])
                        worst[k] = max(located[k], key=lambda f: f["score"])["text"]
                columns = [batch.column("doc_id"), batch.column("source"), pa.array(score, pa.float64()), pa.array(worst, pa.string()), pa.array(located, PASSAGES)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "score", "worst", "passages"])

    located = "array<struct<sentence: int, start: int, end: int, score: double, text: string>>"
    return documents.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kind}, source string, score double, worst string, passages {located}")


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents that hold a passage."""
    return score_documents(documents, labels).where("passages IS NOT NULL").select("doc_id").distinct()


def source_rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, offensive, share): rates per source, null sources as one."""
    bad = F.count_if(F.col("passages").isNotNull())
    return score_documents(documents, labels).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), bad.alias("offensive")).withColumn(
        "share", F.round(F.col("offensive") / F.col("documents"), 6)
    )
