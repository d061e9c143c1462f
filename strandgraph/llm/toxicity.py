"""Toxicity: a subsequence-string-kernel support vector machine with Nystroem landmarks.

The kernel of two short strings counts their common three-letter subsequences,
each weighted by DECAY to the power of its span, and is normalised; gaps and
inserted characters lower it only a little.  A sentence meets a landmark in its
windows: its words with marks for their start and end, their beginnings, parts
between punctuation, runs of spaced-out letters, and pairs of short tokens; the
largest kernel counts.  These similarities to the landmarks, times the inverse
root of the landmarks' own kernel matrix, are the sentence's Nystroem features.

A linear SVM over them is trained on labelled sentences: those of toxic
documents against those of the others, each document's sentences sharing its
weight.  A logistic unit turns the sum of the positive decisions on a document's
windows (each at most 1) into its score.  Landmarks are words and word
beginnings that a greedy cover of the labelled toxic documents selects (at most
MAX_TOXIC), and the most similar strings of the others (MAX_LANDMARKS in all).

Most words share too little with any landmark.  A table of letter triples
bounds the similarity of a whole batch of unseen words at once; only those that
may reach MIN_SIMILARITY get exact kernels, the rest count as dissimilar to
every landmark.  Kernels are cached per word.

Training uses at most ``PER_CLASS`` documents a class, of each a run of at most
``MAX_CHARS`` characters, outside the held-out fold.

Defined results: a null or empty text has no word and gets the lowest score;
without labelled rows of both classes, or without landmarks, every text does;
empty tables give empty results; only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandgraph.llm.common import map_rows, texts_of
from strandgraph.llm.sample import labelled_texts

DECAY, REACH = 0.7, 4
MIN_SIMILARITY = 0.5
WINDOW = 24
PER_CLASS, MAX_CHARS = (1200, 600), 10_000
MAX_TOXIC, MAX_LANDMARKS = 48, 96
CACHE = 600_000
START, STOP = "^", "$"
DROPPED = re.compile(r"[^\w\s]|_")
#: Three or more tokens of one or two characters in a row: letters spaced out.
SPACED = re.compile(r"(?<!\S)(?:\S{1,2}[^\S\n]+){2,}\S{1,2}(?!\S)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def triples(s: str) -> dict[str, float]:
    """The kernel's features of ``s``: weight of each three-letter subsequence within REACH."""
    out: dict[str, float] = defaultdict(float)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + 1 + REACH)):
            for k in range(j + 1, min(len(s), j + 1 + REACH)):
                out[s[i] + s[j] + s[k]] += DECAY ** (k - i + 1)
    return out


def unit_vector(s: str) -> dict[str, float]:
    f = triples(s)
    norm = sum(v * v for v in f.values()) ** 0.5
    return {t: v / norm for t, v in f.items()} if norm else {}


def similarity(a: dict[str, float], b: dict[str, float]) -> float:
    if len(a) > len(b):
        a, b = b, a
    return sum(v * b[t] for t, v in a.items() if t in b)


def clean(word: str) -> str:
    return DROPPED.sub("", word)


def marked(word: str) -> str:
    return START + word + STOP


def stems(word: str) -> list[str]:
    """What may become a landmark: the marked word and its beginnings."""
    return [marked(word), *(START + word[:k] for k in range(4, min(9, len(word))))]


def windows(word: str) -> list[str]:
    """Overlapping windows that cover a long word."""
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


class ToxicSvm:
    """Landmarks, the decision function over sentences, the cache of word kernels, and the document unit."""

    def __init__(self, landmarks: list[str], n_toxic: int):
        self.landmarks, self.n_toxic = landmarks, n_toxic
        toxic = landmarks[:n_toxic]
        vectors = [unit_vector(x) for x in landmarks]
        k = np.array([[similarity(a, b) for b in vectors] for a in vectors]).reshape(len(landmarks), len(landmarks))
        values, basis = np.linalg.eigh(k + 1e-6 * np.eye(len(landmarks))) if landmarks else (np.zeros(0), np.zeros((0, 0)))
        self.root = basis @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ basis.T
        self.weights, self.shift = np.zeros(len(landmarks)), -1.0
        self.document = np.array([4.0, 0.0, -2.0])
        self.row = {t: i for i, t in enumerate(sorted({t for v in vectors for t in v}))}
        self.table = np.zeros((len(self.row), len(landmarks)))
        for j, v in enumerate(vectors):
            for t, w in v.items():
                self.table[self.row[t], j] = w
        letters = sorted({c for x in toxic for c in x})
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        self.size = len(letters) + 1
        self.bound = np.zeros(self.size**3, dtype=np.float32)
        for v in vectors[:n_toxic]:
            for t, w in v.items():
                at = (self.code[t[0]] * self.size + self.code[t[1]]) * self.size + self.code[t[2]]
                self.bound[at] = max(self.bound[at], w)
        gaps = [(a, b) for a in range(1, REACH + 1) for b in range(1, REACH + 1)]
        self.least = np.array([sum(max(0, n - a - b) * DECAY ** (2 * (a + b + 1)) for a, b in gaps) for n in range(WINDOW + 3)]) ** 0.5
        self.heads = sorted({len(x) - 1 for x in toxic if not x.endswith(STOP)})
        self.starts = {x[1:3] for x in toxic}
        self.span = range(4, max((len(x) for x in toxic), default=3) + 2)
        self.forget()

    def forget(self) -> None:
        """Empty the caches: the words seen, the kernels of those like a toxic landmark, and the decisions on these."""
        self.seen: set[str] = set()
        self.near: dict[str, np.ndarray] = {}
        self.value: dict[str, float] = {}

    def kernels(self, string: str) -> np.ndarray:
        """Similarity of a marked string to every landmark."""
        f = triples(string)
        norm = sum(v * v for v in f.values()) ** 0.5
        rows = [(self.row[t], v) for t, v in f.items() if t in self.row]
        if not rows or not norm:
            return np.zeros(len(self.landmarks))
        at, values = zip(*rows, strict=True)
        return np.array(values) @ self.table[list(at)] / norm

    def may_match(self, strings: list[str]) -> np.ndarray:
        """Whether a string's kernel with some toxic landmark may reach MIN_SIMILARITY.

        A landmark's kernel is at most the sum, over the string's triples, of
        the largest weight that a landmark gives the triple; the string's norm
        is at least that of its triples taken as if no two were equal.
        """
        width = max(map(len, strings), default=0)
        codes = np.zeros((len(strings), width + 2 * REACH), dtype=np.int32)
        code = self.code
        for i, u in enumerate(strings):
            codes[i, : len(u)] = [code.get(c, 0) for c in u]
        total = np.zeros(len(strings), dtype=np.float32)
        for a in range(1, REACH + 1):
            first = (codes[:, :width] * self.size + codes[:, a : a + width]) * self.size
            for b in range(1, REACH + 1):
                total += DECAY ** (a + b + 1) * self.bound[first + codes[:, a + b : a + b + width]].sum(axis=1)
        return total >= MIN_SIMILARITY * self.least[[len(u) for u in strings]]

    def pieces(self, word: str) -> list[str]:
        """The marked strings to compare: the word without punctuation, its beginnings, windows if it is long, parts between punctuation."""
        whole = clean(word)
        out = [marked(whole)] if len(whole) <= WINDOW else windows(whole)
        out += [START + whole[:k] for k in self.heads if k < len(whole)]
        parts = DROPPED.split(word)
        if len(parts) > 1:
            for p in parts:
                if 4 <= len(p) < len(whole):
                    out += [marked(p)] if len(p) <= WINDOW else windows(p)
        return out

    def compare(self, words: set[str]) -> None:
        """Put the kernels of unseen words into the cache."""
        new = [u for u in words if u not in self.seen]
        if not new:
            return
        if len(self.seen) + len(new) > CACHE:
            self.forget()
            new = list(words)
        self.seen.update(new)
        for at in range(0, len(new), 10_000):
            strings, owner = [], []
            for u in new[at : at + 10_000]:
                for p in self.pieces(u):
                    if len(p) >= 5:
                        strings.append(p)
                        owner.append(u)
            for i in np.flatnonzero(self.may_match(strings)) if strings else ():
                k = self.kernels(strings[i])
                if k[: self.n_toxic].max() >= MIN_SIMILARITY:
                    u = owner[i]
                    self.near[u] = np.maximum(self.near[u], k) if u in self.near else k

    def windows(self, sentence: str) -> list[str]:
        """Tokens, joined runs of spaced-out letters, and joined pairs of short tokens that start like a landmark."""
        words = sentence.split()
        starts, span = self.starts, self.span
        pairs = [j for a, b in zip(words, words[1:], strict=False) if len(a) <= 4 and (j := a + b)[:2] in starts and len(j) in span and len(b) <= 5]
        return words + ["".join(m[0].split()) for m in SPACED.finditer(sentence)] + pairs

    def sentences(self, text: str) -> list[list[np.ndarray]]:
        """For each sentence with a window like a toxic landmark, the kernels of its near windows; they were compared before."""
        found = []
        for sentence in SENTENCE.split(text.lower()):
            near = [self.near[w] for w in self.windows(sentence) if w in self.near]
            if near:
                found.append(near)
        return found

    def text_windows(self, text: str) -> list[str]:
        """The windows of a whole text: sentences end at white space, so they matter only to runs of spaced-out letters."""
        low = text.lower() if self.landmarks else ""
        if SPACED.search(low):
            return [w for sentence in SENTENCE.split(low) for w in self.windows(sentence)]
        return self.windows(low)

    def groups(self, texts: list[str]):
        """(text, its windows) in groups whose windows are compared together."""
        group, words, size = [], set(), 0
        for i, text in enumerate(texts):
            mine = self.text_windows(text)
            group.append((text, mine))
            words.update(mine)
            size += len(mine)
            if size > 300_000 or i == len(texts) - 1:
                self.compare(words)
                yield group
                group, words, size = [], set(), 0

    def decisions(self, kernels: list[np.ndarray]) -> np.ndarray:
        return np.array(kernels) @ self.root @ self.weights + self.shift if kernels else np.zeros(0)

    def document_features(self, texts: list[str]) -> np.ndarray:
        """Per text: sum of its windows' positive decisions (each at most 1) up to 3, the same damped, and 1."""
        sums = []
        for group in self.groups(texts):
            new = [w for w in self.near if w not in self.value]
            self.value.update(zip(new, np.clip(self.decisions([self.near[w] for w in new]), 0, 1).tolist(), strict=True))
            value = self.value
            sums += [sum([value[w] for w in mine if w in value]) for _, mine in group]
        h = np.array(sums, dtype=float)
        return np.stack([np.minimum(h, 3) / 3, np.log1p(h), np.ones(len(h))], axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.document_features(texts) @ self.document, -30, 30)))


def cover(docs: list[tuple[Counter, int]]) -> list[str]:
    """The stems that explain the toxic documents and hardly occur in the others.

    A stem speaks for a document once, or only if it occurs twice there, if
    that is what makes it pure.  Each greedy step takes the stem with the
    largest gain; among equals the longest.
    """
    toxic = sum(y for _, y in docs)
    share, least = toxic / max(1, len(docs) - toxic), max(2, toxic // 100)
    in_toxic: dict[tuple[str, int], set[int]] = defaultdict(set)
    in_fine: Counter = Counter()
    for i, (counts, y) in enumerate(docs):
        for stem, n in counts.items():
            for times in range(1, min(n, 2) + 1):
                if y:
                    in_toxic[stem, times].add(i)
                else:
                    in_fine[stem, times] += 1
    pure = {k: v for k, v in in_toxic.items() if len(v) >= least and len(v) >= 15 * share * in_fine[k]}
    left, chosen = {i for i, (_, y) in enumerate(docs) if y}, []
    while len(chosen) < MAX_TOXIC and pure:
        gain = {k: len(v & left) - 5 * share * in_fine[k] for k, v in pure.items()}
        best = max(gain, key=lambda k: (gain[k], len(k[0]), k))
        if gain[best] < least:
            break
        left -= pure[best]
        if best[0] not in chosen:
            chosen.append(best[0])
        pure = {k: v for k, v in pure.items() if k != best and len(v & left) >= least}
    if chosen:
        # A cover stops early where toxic words keep company; whole words as frequent and as pure belong to it too.
        size = sorted(len(in_toxic[c, 1]) for c in chosen)[len(chosen) // 2]
        more = {k[0]: len(v) for k, v in in_toxic.items() if k[1] == 1 and k[0].endswith(STOP) and len(v) >= size / 2 and not in_fine[k]}
        chosen += [x for x in sorted(more, key=lambda x: (-more[x], x)) if x not in chosen][: MAX_TOXIC - len(chosen)]
    return chosen


def fit(sample: list[tuple[str, int]]) -> ToxicSvm:
    """Choose landmarks, train the SVM on labelled sentences, then the document unit."""
    bags = [Counter(c for w in t.lower().split() if 3 <= len(c := clean(w)) <= WINDOW) for t, _ in sample]
    docs = []
    for bag, (_, y) in zip(bags, sample, strict=True):
        counts: Counter = Counter()
        for word, n in bag.items():
            for stem in stems(word):
                counts[stem] += n
        docs.append((counts, y))
    if len({y for _, y in sample}) < 2 or not (chosen := cover(docs)):
        return ToxicSvm([], 0)
    probe = ToxicSvm(chosen, len(chosen))
    fine = Counter()
    for bag, (_, y) in zip(bags, sample, strict=True):
        if not y:
            fine.update(bag.keys())
    names, near = sorted(fine), {}
    for at in range(0, len(names), 10_000):
        part = [(p, w) for w in names[at : at + 10_000] for p in probe.pieces(w)]
        for i in np.flatnonzero(probe.may_match([p for p, _ in part])):
            near[part[i][0]] = float(probe.kernels(part[i][0]).max())
    heads = tuple(x for x in chosen if not x.endswith(STOP))
    common = Counter()
    for w in fine:
        for p in probe.pieces(w):
            if p in near and not p.startswith(heads) and p not in chosen:
                common[p] += fine[w]
    hard = sorted(common, key=lambda p: (-near[p] * np.log1p(common[p]), p))[:3000]
    model = ToxicSvm(chosen + hard[: MAX_LANDMARKS - len(chosen)], len(chosen))
    # Labelled sentences: each document's share its weight; a sentence without any near window is a negative one.
    rows, labels, shares = [np.zeros(len(model.landmarks))], [-1.0], [10.0]
    texts = [t for t, _ in sample]
    found = [[np.max(near, axis=0) for near in model.sentences(text)] for group in model.groups(texts) for text, _ in group]
    toxic = sum(1 for f, (_, y) in zip(found, sample, strict=True) if y and f) or 1
    fine = sum(len(f) for f, (_, y) in zip(found, sample, strict=True) if not y) or 1
    for sentences, (_, y) in zip(found, sample, strict=True):
        rows += sentences
        labels += [1.0 if y else -1.0] * len(sentences)
        shares += [1 / (toxic * max(1, len(sentences))) if y else 1 / fine] * len(sentences)
    shares[0] = 1.0
    model.weights, model.shift = hinge(np.array(rows) @ model.root, np.array(labels), np.array(shares))
    y = np.array([b for _, b in sample], dtype=float)
    f = model.document_features(texts)
    w, ridge = model.document, np.array([0.02, 0.02, 0.001])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        hessian = (f * (p * (1 - p))[:, None]).T @ f + np.diag(ridge)
        w = w - np.linalg.solve(hessian, f.T @ (p - y) + ridge * w)
    model.document = w
    return model


def hinge(x: np.ndarray, s: np.ndarray, weight: np.ndarray, cost: float = 300.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """A linear SVM with weighted squared hinge loss, by Newton steps in the primal."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.append(np.ones(x.shape[1]), 1e-3)
    w, before = np.zeros(x1.shape[1]), None
    for _ in range(rounds):
        active = s * (x1 @ w) < 1
        if before is not None and (active == before).all():
            break
        before = active
        xa, wa = x1[active], cost * weight[active]
        w = np.linalg.solve(np.diag(ridge) + (xa * wa[:, None]).T @ xa, xa.T @ (wa * s[active]))
    return w[:-1], float(w[-1])


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held_out: int = 1, per_class: tuple[int, int] = PER_CLASS, max_chars: int = MAX_CHARS) -> ToxicSvm:
    """A machine fitted on a bounded sample of the rows outside the held-out fold."""
    sample, _ = labelled_texts(docs, labels, label, modulus, held_out, per_class, max_chars)
    return fit(sample)


def score_toxicity(docs: DataFrame, model: ToxicSvm, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and score."""
    model.forget()

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(texts_of(batch)), pa.float64())], [id_col, "score"])

        return step

    narrow = docs.select(id_col, text_col)
    return map_rows(narrow, build, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, score double")


def judge_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
