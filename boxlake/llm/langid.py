"""Language ID by a linear-chain conditional random field over words.

Every word scores each language by its affixes, character n-grams and lexicon entry; learned transitions tie neighbours, so words of
code-switched text are labelled one by one by forward-backward. A document's language is that with the largest sum of word marginals.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.llm.common import arrow_batches, written

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
MEMO = 100_000
GROUP_CHARS = 400_000
PIECE, OVERLAP = 40, 2


def words_of(text: str) -> list[str]:
    """Runs of letters; a run of more than PIECE letters (a script without spaces, say) in pieces that share OVERLAP letters, so that no letter or trigram is lost."""
    runs = WORD.findall(text.lower())
    if max(map(len, runs), default=0) <= PIECE:
        return runs
    return [run[i : i + PIECE] for run in runs for i in range(0, max(1, len(run) - OVERLAP), PIECE - OVERLAP)]


def features_of(word: str) -> list[str]:
    """Prefixes and suffixes of one to three letters, bigrams and trigrams with word ends, and the word itself."""
    w = f"^{word}$"
    out = ["=" + word, "<" + word[:1], "<" + word[:2], "<" + word[:3], ">" + word[-1:], ">" + word[-2:], ">" + word[-3:]]
    out += [w[i : i + 2] for i in range(len(w) - 1)]
    out += [w[i : i + 3] for i in range(len(w) - 2)]
    return out


class Chain:
    """Weights of a trained field: feature rows by name, their scores by language, and transition scores."""

    def __init__(self, languages: list[str], rows: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.rows, self.weights, self.transitions = languages, rows, weights, transitions
        self.memo: dict[str, int] = {}
        self.emissions: np.ndarray | None = None

    def score(self, words: list[str]) -> np.ndarray:
        """exp of the scores of each word, its largest 1."""
        get = self.rows.get
        ids = [[i for i in map(get, features_of(w)) if i is not None] for w in words]
        scores = np.zeros((len(words), len(self.languages)))
        sizes = np.array(list(map(len, ids)))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            scores[full] = np.add.reduceat(self.weights[np.concatenate([ids[i] for i in full]).astype(np.int64)], starts, axis=0)
        return np.exp(scores - scores.max(axis=1, keepdims=True))

    def emit(self, words: list[str]) -> np.ndarray:
        """score of each word; MEMO distinct words are remembered, and forgotten together when more come."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.memo]
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = list(dict.fromkeys(words))
        if self.emissions is None:
            self.emissions = np.empty((MEMO, len(self.languages)))
        at, table = self.memo, self.emissions
        if len(fresh) > MEMO:
            at, table = {}, np.empty((len(fresh), len(self.languages)))
        for i in range(0, len(fresh), 10_000):
            some = fresh[i : i + 10_000]
            first = len(at)
            table[first : first + len(some)] = self.score(some)
            at.update(zip(some, range(first, first + len(some))))
        return table[np.fromiter(map(at.__getitem__, words), np.int64, len(words))]

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Of each word sequence, the probability of each language at each word."""
        sizes = np.array(list(map(len, texts)))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        out = [np.zeros((0, len(self.languages)))] * len(texts)
        if not len(order):
            return out
        longest = sizes[order[0]]
        active = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), "right")  # sequences that have a word at each step
        base = np.concatenate([[0], np.cumsum(active)[:-1]])
        emit = self.emit([w for i in order for w in texts[i]])
        place = np.concatenate([base[: sizes[i]] + r for r, i in enumerate(order)])  # step by step instead of text by text
        steps = np.empty_like(emit)
        steps[place] = emit
        forward, backward = _passes(steps, base, active, np.exp(self.transitions))
        chance = forward * backward
        chance = (chance / chance.sum(axis=1, keepdims=True))[place]
        for i, part in zip(order, np.split(chance, np.cumsum(sizes[order])[:-1])):
            out[i] = part
        return out


def _passes(steps: np.ndarray, base: np.ndarray, active: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward messages; rows of a step stand together, the longest sequences first."""
    forward, backward = np.empty_like(steps), np.empty_like(steps)
    for t in range(len(base)):
        a, k = base[t], active[t]
        now = steps[a : a + k] if t == 0 else forward[base[t - 1] : base[t - 1] + k] @ move * steps[a : a + k]
        forward[a : a + k] = now / now.sum(axis=1, keepdims=True)
    for t in range(len(base) - 1, -1, -1):
        a, k = base[t], active[t]
        backward[a : a + k] = 1.0
        if t + 1 < len(base):
            b, more = base[t + 1], active[t + 1]
            now = (backward[b : b + more] * steps[b : b + more]) @ move.T
            backward[a : a + more] = now / now.sum(axis=1, keepdims=True)
    return forward, backward


def train(texts: list[tuple[str, str]], max_words: int = 160, max_features: int = 60_000, rounds: int = 18, seed: int = 5) -> Chain | None:
    """A field from (text, language) pairs, by gradient steps on the conditional likelihood (Adagrad, all sequences at once).

    Half of the sequences are whole; the other half alternate between two texts every few words, so that transitions learn
    what a switch is. None without texts.
    """
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    known = [(words_of(text)[:max_words], languages.index(lang)) for text, lang in texts]
    known = [x for x in known if x[0]]
    sequences = [[(w, lang) for w in words[i : i + 40]] for words, lang in known for i in range(0, len(words), 40)]
    for words, lang in known:
        other, other_lang = known[rng.integers(len(known))]
        mixed, turn, at = [], 0, [0, 0]
        while len(mixed) < 40 and at[turn] < len((words, other)[turn]):
            n = int(rng.integers(3, 15))
            mixed += [(w, (lang, other_lang)[turn]) for w in (words, other)[turn][at[turn] : at[turn] + n]]
            at[turn] += n
            turn = 1 - turn
        sequences.append(mixed[:40])
    if not sequences:
        return None
    sequences.sort(key=len, reverse=True)
    counts = Counter(f for s in sequences for w, _ in s for f in features_of(w))
    rows = {f: i for i, (f, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:max_features]) if n > 1}
    words = sorted({w for s in sequences for w, _ in s})
    number = {w: i for i, w in enumerate(words)}
    ids = [[rows[f] for f in features_of(w) if f in rows] for w in words]
    flat, of = np.array([i for x in ids for i in x], np.int64), np.repeat(np.arange(len(words)), list(map(len, ids)))
    n_lang = len(languages)
    active = np.array([sum(len(s) > t for s in sequences) for t in range(len(sequences[0]))])
    base = np.concatenate([[0], np.cumsum(active)[:-1]])
    word_at = np.array([number[s[t][0]] for t in range(len(active)) for s in sequences[: active[t]]])
    lang_at = np.array([s[t][1] for t in range(len(active)) for s in sequences[: active[t]]])
    weights, moves = np.zeros((len(rows), n_lang)), np.zeros((n_lang, n_lang))
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    spread = lambda values, index, size: np.stack([np.bincount(index, values[:, k], size) for k in range(n_lang)], axis=1)
    pairs = [(slice(base[t], base[t] + active[t + 1]), slice(base[t + 1], base[t + 1] + active[t + 1])) for t in range(len(base) - 1)]
    for _ in range(rounds):
        scores = spread(weights[flat], of, len(words))
        steps = np.exp(scores - scores.max(axis=1, keepdims=True))[word_at]
        move = np.exp(moves)
        forward, backward = _passes(steps, base, active, move)
        chance = forward * backward
        chance /= chance.sum(axis=1, keepdims=True)
        expected, observed = np.zeros_like(moves), np.zeros_like(moves)
        for a, b in pairs:
            joint = forward[a][:, :, None] * move * (steps[b] * backward[b])[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            np.add.at(observed, (lang_at[a], lang_at[b]), 1)
        chance[np.arange(len(lang_at)), lang_at] -= 1
        per_word = spread(chance, word_at, len(words))
        slope = spread(per_word[of], flat, len(rows)) / len(sequences) + 1e-5 * weights
        slope_m = (expected - observed) / len(sequences) + 1e-5 * moves
        seen_w += slope**2
        seen_m += slope_m**2
        weights -= 0.3 * slope / np.sqrt(seen_w)
        moves -= 0.3 * slope_m / np.sqrt(seen_m)
    return Chain(languages, rows, weights, moves)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = 100, excerpt: int = 4000) -> list[tuple[str, str]]:
    """(text, lang) of at most ``per_language`` documents of each language, by the hash of doc_id, without the held-out ones (bounds on training only).

    Of a longer text, ``excerpt`` characters from a place that its hash chooses. Rows that repeat a doc_id and language count
    once, by their least excerpt; they are put together on Spark, so the driver gets no more than the sample.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct()
    for by in (["lang", F.pmod("h", F.lit(64))], ["lang"]):  # first within 64 parts of a language, so that no task sorts a whole one
        at = F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
        ids = ids.withColumn("i", at).where(F.col("i") <= per_language).drop("i")
    chosen = ids.select("doc_id", "lang")
    start = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.length("text") - excerpt, F.lit(0)) + 1) + 1
    rows = usable.select("doc_id", "lang", F.substring(F.col("text"), start.cast("int"), F.lit(excerpt)).alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    found = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["lang"]) for r in sorted(found, key=lambda r: (r["lang"], r["doc_id"]))]


def label_texts(texts: list[str | None], chain: Chain | None) -> list[tuple[str, float]]:
    """(language, mean marginal) of each text; a group of about GROUP_CHARS characters at a time, so that memory stays bounded."""
    found: list[tuple[str, float]] = []
    group: list[list[str]] = []
    chars = 0

    def close() -> None:
        for part in chain.marginals(group):
            mean = part.mean(axis=0) if len(part) else None
            found.append((UNKNOWN, 0.0) if mean is None else (chain.languages[int(mean.argmax())], float(min(1.0, mean.max()))))
        group.clear()

    for text in texts:
        if chain is None:
            found.append((UNKNOWN, 0.0))
            continue
        words = words_of(text) if text else []
        group.append(words if any(any(map(str.isalpha, w)) for w in words) else [])
        chars += len(text or "")
        if chars >= GROUP_CHARS:
            close()
            chars = 0
    if chain is not None:
        close()
    return found


def identify(docs: DataFrame) -> DataFrame:
    """A table of doc_id, held_out, lang_pred, score (mean marginal of the language) of every row, trained on the rows that are not held out.

    Null texts and texts without letters are ``und`` with score 0, as is everything if no row has a language. Repeated rows and
    null ids (never held out, never learned from) each keep a row; an empty table gives none; other columns are left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(training_sample(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label_texts(batch.column("text").to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    with arrow_batches(docs.sparkSession):
        return written(docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"))


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """A table of the rows whose text is in a learned language with at least that score; all columns stay as they are.

    Null texts and texts without letters go; repeated rows and null ids are judged by their texts like all others; an empty table
    gives none. Columns pass as Arrow batches, so their types must have an Arrow form.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(training_sample(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label_texts(batch.column("text").to_pylist(), model.value)
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    with arrow_batches(docs.sparkSession):
        return written(docs.mapInArrow(run, docs.schema))
