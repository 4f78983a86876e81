"""Toxicity scores: a lexicon learned from labels, matched with Levenshtein automata, weighed by context.

A lexicon of words and word stems that mark toxic documents is learned from labelled ones. It becomes a trie; every
distinct word of a text runs through the intersection of its Levenshtein automaton (distance ``EDITS``) with the trie,
so misspelled terms (of ``FUZZY_FROM`` letters or more) and misspelled stems (of ``FUZZY_STEM`` or more) are caught as
well. Words near a term that clean labelled documents use are ordinary words, not misspellings, and a term with
``CROWDED`` such neighbours or more, which an unseen ordinary word may well be near, is matched as it is only.

A match adds its strength to the document's abuse: 1 for a term or a stem's word, ``MISSPELLED`` for a misspelling. A
match inside quotation marks, or with a verb of saying within ``WINDOW`` words, is talked about rather than used, and
adds only ``QUOTED`` of that. These shares are parameters, not learned: misspelled and quoted terms are too rare among
labelled documents to learn from. A logistic model, learned, turns a document's abuse into the score.

Only learning uses a sample: at most ``sample`` labelled documents of each label, those with the smallest hashes.
The model weighs each label's rows so that the labels keep their shares among all labelled documents.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.llm._shared import written
from filmloom.llm._text import ALNUM, words

EDITS, FUZZY_FROM, FUZZY_STEM, STEMS, WINDOW = 1, 5, 6, (4, 5, 6), 6
MISSPELLED, QUOTED, CROWDED = 0.8, 0.25, 3
# fixed values: verbs of saying and words for what is said, in English, German, French and Spanish
SAYING = {
    w.encode()
    for w in (
        "said says called calls quote quoted quotes wrote insult insults term slur "
        "sagte sagt nannte nennt zitat zitiert schrieb beleidigung wort "
        "dit disait appelle citation cite écrit insulte terme "
        "dijo dice llamó llama cita citado escribió insulto término"
    ).split()
}
MARKS = ((b"\xe2\x80\x9c", b"\xe2\x80\x9d"), (b"\xe2\x80\x9e", b"\xe2\x80\x9c"), (b"\xc2\xab", b"\xc2\xbb"))
N_FEATURES = 3
MAX_CACHE = 300_000


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds == fold


class Lexicon:
    """Whole words and stems (of words longer than they are), as a trie over characters."""

    def __init__(self, whole: list[str], stems: list[str], ordinary: list[str] | None = None, exact: set[str] | None = None):
        self.whole, self.stems, self.ordinary = set(whole), set(stems), set(ordinary or [])
        self.misspelled, self.quoted = MISSPELLED, QUOTED
        exact = exact or set()
        self.trie: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]  # 1 a term ends here, 2 a stem
        # a word within one edit of a term keeps the term's first half in front or its second half at the end
        self.near: dict[int, tuple[set[int], set[str], set[int], set[str]]] = {}
        # one that begins within one edit of a stem keeps one of the stem's halves, the second at most one place off
        self.stem_fronts: dict[int, set[str]] = {}
        self.stem_backs: dict[tuple[int, int], set[str]] = {}
        for term in whole:
            if len(term) < FUZZY_FROM or term in exact:
                continue
            self._add(term, 1)
            half = len(term) // 2
            for n in range(len(term) - EDITS, len(term) + EDITS + 1):
                fronts, front, backs, back = self.near.setdefault(n, (set(), set(), set(), set()))
                fronts.add(half)
                front.add(term[:half])
                backs.add(len(term) - half)
                back.add(term[half:])
        for stem in stems:
            if len(stem) < FUZZY_STEM or stem in exact:
                continue
            self._add(stem, 2)
            half = len(stem) // 2
            self.stem_fronts.setdefault(half, set()).add(stem[:half])
            for at in range(half - EDITS, half + EDITS + 1):
                self.stem_backs.setdefault((at, len(stem) - half), set()).add(stem[half:])
        self.cache: dict[int, int] = {}

    def _add(self, term: str, mark: int) -> None:
        at = 0
        for c in term:
            if c not in self.trie[at]:
                self.trie[at][c] = len(self.trie)
                self.trie.append({})
                self.ends.append(0)
            at = self.trie[at][c]
        self.ends[at] |= mark

    def fuzzy(self, word: str) -> bool:
        """Whether the word's Levenshtein automaton and the trie accept a common string: both are walked side by side.

        At a stem's end the rest of the word is accepted as it is.
        """
        n, todo, seen = len(word), [(0, 0, 0)], set()
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            node, i, edits = state
            if i == n and self.ends[node] & 1 or i < n and self.ends[node] & 2:
                return True
            kids = self.trie[node]
            if i < n and word[i] in kids:
                todo.append((kids[word[i]], i + 1, edits))
            if edits < EDITS:
                if i < n:
                    todo.append((node, i + 1, edits + 1))
                for child in kids.values():
                    todo.append((child, i, edits + 1))
                    if i < n:
                        todo.append((child, i + 1, edits + 1))
        return False

    def _near(self, word: str) -> bool:
        got = self.near.get(len(word))
        if got is not None:
            fronts, front, backs, back = got
            if any(word[:k] in front for k in fronts) or any(word[-k:] in back for k in backs):
                return True
        return any(word[:k] in own for k, own in self.stem_fronts.items()) or any(word[at : at + k] in own for (at, k), own in self.stem_backs.items())

    def kind(self, word: str) -> int:
        """0 no match, 1 a term, 2 a stem's word, 3 a misspelled term."""
        if word in self.whole:
            return 1
        if any(len(word) > n and word[:n] in self.stems for n in STEMS):
            return 2
        return 3 if word not in self.ordinary and self._near(word) and self.fuzzy(word) else 0

    def features(self, col: pa.Array) -> np.ndarray:
        out = np.zeros((len(col), N_FEATURES))
        for w in words(col, ALNUM):
            rows = w.rows.stop - w.rows.start
            if not len(w.doc):
                continue
            u, where, back = np.unique(w.hash, return_index=True, return_inverse=True)
            blob = w.data.tobytes()
            kinds = np.empty(len(u), np.int64)
            for i, (h, a, b) in enumerate(zip(u.tolist(), w.start[where].tolist(), w.end[where].tolist(), strict=True)):
                k = self.cache.get(h)
                if k is None:
                    if len(self.cache) > MAX_CACHE:
                        self.cache.clear()
                    k = self.cache[h] = self.kind(blob[a:b].decode("utf-8", "replace"))
                kinds[i] = k
            kind = kinds[back]
            abuse = np.zeros(rows)
            for i in np.flatnonzero(kind).tolist():
                d = int(w.doc[i])
                abuse[d] += (self.misspelled if kind[i] == 3 else 1.0) * (self.quoted if self._quoted(w, blob, i, d) else 1.0)
            n = np.maximum(1, np.diff(w.first))
            out[w.rows] = np.stack([np.minimum(1.0, abuse), np.log1p(abuse), np.minimum(1.0, 20 * abuse / n)], axis=1)
        return out

    def _quoted(self, w, blob: bytes, i: int, d: int) -> bool:
        a, z = max(int(w.first[d]), i - WINDOW), min(int(w.first[d + 1]), i + WINDOW + 1)
        if any(blob[w.start[j] : w.end[j]] in SAYING for j in range(a, z)):
            return True
        before, after = blob[w.start[a] : w.start[i]], blob[w.end[i] : w.end[z - 1] + 3]
        return before.count(b'"') % 2 == 1 and b'"' in after or any(q in before and q2 in after for q, q2 in MARKS)


def _candidates(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): labelled documents with each word ("=word") or stem ("stem*")."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for b in batches:
            toxic = b.column("toxic").to_pylist()
            for w in words(b.column("text"), ALNUM, hashed=False):
                blob = w.data.tobytes()
                for d in range(w.rows.stop - w.rows.start):
                    own = {blob[w.start[i] : w.end[i]] for i in range(int(w.first[d]), int(w.first[d + 1]))}
                    mine = set()
                    for x in own:
                        t = x.decode("utf-8", "replace")
                        if 3 <= len(t) <= 24:
                            mine.add("=" + t)
                            mine |= {t[:n] + "*" for n in STEMS if len(t) > n}
                    side = 0 if toxic[w.rows.start + d] else 1
                    for f in mine:
                        got[f][side] += 1
        names = list(got)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([got[x][0] for x in part], pa.int64()), pa.array([got[x][1] for x in part], pa.int64())], ["feature", "toxic", "clean"])

    return sample.select("text", "toxic").mapInArrow(count, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame, share: float = 0.01, odds: float = 25.0, crowded: int = CROWDED) -> Lexicon:
    """Words and stems in at least ``share`` of the toxic documents (three or more), ``odds`` times as likely as in others."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    t, c = n.get(1, 0), n.get(0, 0)
    if not t or not c:
        return Lexicon([], [])
    ratio = ((F.col("toxic") + 0.5) / (t + 1)) / ((F.col("clean") + 0.5) / (c + 1))
    found = written(_candidates(sample), "lexicon-candidates")
    rows = found.where((F.col("toxic") >= max(3, share * t)) & (ratio >= odds)).collect()
    stems: list[str] = []
    for name in sorted((r["feature"][:-1] for r in rows if r["feature"][-1] == "*"), key=lambda s: (len(s), s)):
        if not any(name.startswith(s) for s in stems):
            stems.append(name)
    whole = sorted(r["feature"][1:] for r in rows if r["feature"][0] == "=")
    # a stem of just one learned word is that word, not a family
    families = [s for s in stems if sum(1 for r in rows if r["feature"] == "=" + s) == 0]
    covers = {s: [x for x in whole if x.startswith(s) and len(x) > len(s)] for s in families}
    counts = {r["feature"]: r["toxic"] for r in rows}
    families = [s for s in families if not any(counts["=" + x] >= 0.9 * counts[s + "*"] for x in covers[s])]
    lex = Lexicon(whole, families)

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x[1:] for x in b.column("feature").to_pylist() if lex.kind(x[1:]) == 3], pa.string())], ["word"])

    # words within an edit of the lexicon that clean documents use, no more often in toxic ones than chance has it
    plain = found.where(F.col("feature").startswith("=") & (F.col("clean") > 0) & (ratio < odds)).select("feature").mapInArrow(ordinary, "word string")
    near = sorted(r["word"] for r in plain.collect())
    crowd: Counter[str] = Counter()
    for term in {*whole, *families}:
        one = Lexicon([term] if term in lex.whole else [], [term] if term in lex.stems else [])
        crowd[term] = sum(one.kind(w) == 3 for w in near)
    return Lexicon(whole, families, near, {term for term, n in crowd.items() if n >= crowded})


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 40, weigh: np.ndarray | None = None) -> np.ndarray:
    """Weights, the constant first, by Newton's method; rows count ``weigh`` times, else once."""
    m = np.ones(len(y)) if weigh is None else weigh
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    r = np.full(len(w), ridge)
    r[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (m * (p - y)) + r * w
        h = (z * (m * (p * (1 - p) + 1e-9))[:, None]).T @ z + np.diag(r)
        w = w - np.linalg.solve(h, g)
    return w


class Scorer:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def __call__(self, col: pa.Array) -> np.ndarray:
        x = self.lexicon.features(col)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text", misspelled: float = MISSPELLED, quoted: float = QUOTED, crowded: int = CROWDED) -> Scorer:
    """A scorer from the labelled documents of the training folds; without both labels it scores everything 0.

    Labels that are null or neither 0 nor 1, and rows without an id, are left out; of several labels for an id the
    larger counts, and of rows that share a labelled id each is learned from. Null texts are empty.
    """
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    lab = lab.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    every = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.col("_id"), F.lit(17))
    some = lab.where("toxic = 1").orderBy(order, "_id").limit(sample).union(lab.where("toxic = 0").orderBy(order, "_id").limit(sample))
    some = written(some, "labelled")
    got = written(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(some), "_id").select("text", "toxic"), "labelled-texts")
    lex = learn_lexicon(got, crowded=crowded)
    lex.misspelled, lex.quoted = misspelled, quoted

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = lex.features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    t = got.mapInArrow(rows, "toxic int, x array<double>").toArrow()
    y = t["toxic"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Scorer(lex, np.concatenate([[-30.0], np.zeros(N_FEATURES)]))
    # a label of which only some were taken weighs as all of them; the weights' mean is one, as the ridge is for so many rows
    weigh = np.where(y == 1, every[1] / min(sample, every[1]), every[0] / min(sample, every[0]))
    return Scorer(lex, logistic(np.array(t["x"].combine_chunks().flatten()).reshape(len(y), -1), y, weigh=weigh / weigh.mean()))


def with_scores(docs: DataFrame, scorer: Scorer, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``out_col``, replacing a column of that name.

    Null and empty texts have no matches and the score of such; texts of any length are read whole; equal texts have
    equal scores and repeated rows stay; an empty table gives an empty result; other columns pass through, whatever
    their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    cols = [c for c in docs.columns if c != out_col]
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    name = f"c{cols.index(text_col)}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s(b.column(name)))], [*b.schema.names, "_s"])

    out = own.mapInArrow(score, f"{fields}, _s double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], F.col("_s").alias(out_col))
