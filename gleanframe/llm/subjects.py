"""Subject areas of each document (problem 9).

A sentence is the mean of the embeddings of its words and subwords (hashed into a fixed number of
rows); one logistic output per subject, independent of the others, reads that mean. Training runs
in rounds: each partition takes the parameters, goes once over its training rows in mini-batches of
gradient steps, and returns its accumulated change; the changes are synchronised (an embedding row
by the mean over the partitions that touched it, outputs by the mean over all) and the sum is sent
out again. Changes of many partitions are added in a tree. Parameters and changes have a fixed size,
whatever the number of rows.

Labels are weak at first: a labelled text names one subject, but holds remarks that treat none, and
not every word of a subject occurs in one. So after a first fit on the labelled texts all documents,
whole, lend labels to their own sentences, in three further fits:

1. by the rest: a sentence gets the subjects that the other sentences of its document show, so
   that a remark the first fit learned by heart loses its subject;
2. whole: documents that clearly keep to one subject lend it to all their sentences, which brings in
   the subject's other words, while remarks, figures of speech and place names occur with every
   subject and are learned by none;
3. treated: sentences of the same documents keep the subject that the last fit finds in them, if the
   document treats it; remarks and passing mentions count against every subject.

Every document is cut into sentences and words once; the words of a block of documents are written
as flat arrays (each distinct word with its embedding rows, each sentence as a run of words), and
fits and scoring read those. Word vectors are summed once a block or batch, so a sentence costs its
words, not its subwords. Blocks belong to slices; of many sentences a round reads the blocks of
its slices only, and a fit's rounds together read every block. What a document lends is worked out
where its block is read, from the last fit's model, so no labels are stored.

Scoring reads every document: a subject is found where the share of the document's sentences
whose output for it exceeds one half reaches ``SHARE``. A document may have several subjects or
none; null and empty texts have none. Documents are independent rows, so nothing is shuffled.
The labelled texts are a bounded sample, at most ``MOST_LABELLED`` (those of the smallest hashes).
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.session import scratch_path

BUCKETS = 1 << 15
DIM = 16
#: Tasks of the fit on labelled texts alone.
PARTS = 4
RATE = 0.4
#: Sentences of a mini-batch, and of how many of them the rates are scaled for.
BATCH, RATE_BATCH = 256, 32
#: Sentences that a round sees at least, by repeated passes or by several slices.
ROUND_ROWS = 200_000
#: Sentences of a block (of whole documents) and slices that blocks are dealt to.
BLOCK_ROWS, SLICES = 8_192, 20
MOST_LABELLED = 20_000
#: Partitions whose changes are added in one task.
FAN_IN = 32
SHARE = 1 / 6
#: A document keeps to a subject that holds ``CLEAR_SHARE`` of all evidence and at least
#: ``CLEAR_LEAST``; evidence is the sum of scores of at least ``CLEAR_SCORE``.
CLEAR_SCORE, CLEAR_LEAST, CLEAR_SHARE = 0.3, 1.0, 0.7

_TAG = re.compile(r"<[^<>]{1,200}>")
_KEY = re.compile(r'"\w+"\s*:')
_ESCAPED_BREAK = re.compile(r"\\[nr]")
_SPLIT = re.compile(r"(?<=[.!?])[\"”’)\]]*\s+|(?<=[。！？])|[\r\n]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]{2,}(?:['’-][^\W\d_]+)*|[぀-ヿ㐀-鿿]")
_TOKENS = re.compile(r"\n|" + _WORD.pattern)
_MOJIBAKE = re.compile(r"[Â-ô][\u0080-¿‘-›Œ-Ÿˆ˜€]")


# ---- text
def repaired(text: str) -> str:
    """UTF-8 that was read as a one-byte code page, read as UTF-8 again where that works."""
    if _MOJIBAKE.search(text):
        for code in ("cp1252", "latin-1"):
            try:
                return text.encode(code).decode("utf-8")
            except UnicodeError:
                continue
    return text


def sentences(text: str | None) -> list[str]:
    """Sentences and lines that hold a word; markup, entities and record keys are taken off."""
    t = repaired(text or "")
    if "&" in t:
        t = html.unescape(html.unescape(t))
    t = _ESCAPED_BREAK.sub("\n", _KEY.sub("\n", _TAG.sub("\n", t)))
    return [s for s in _SPLIT.split(t) if s and _WORD.search(s)]


@lru_cache(maxsize=200_000)
def _word_rows(word: str) -> tuple[int, ...]:
    if _CJK.search(word):
        grams = [word[i : i + n] for n in (1, 2, 3) for i in range(len(word) - n + 1)]
    else:
        framed = f"<{word}>"
        grams = [f"={word}", *(framed[i : i + 4] for i in range(len(framed) - 3))]
    return tuple(zlib.crc32(g.encode()) % BUCKETS for g in grams)


def features(sentence: str) -> list[int]:
    """Embedding rows of a sentence's words and subwords."""
    return [r for w in _WORD.findall(sentence.lower()) for r in _word_rows(w)]


# ---- packed words
@dataclass
class Words:
    """Sentences as runs of word numbers, and every distinct word as a run of embedding rows."""

    ids: np.ndarray
    sizes: np.ndarray
    rows: np.ndarray
    spans: np.ndarray
    starts: np.ndarray = field(init=False)
    row_starts: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)

    def __post_init__(self):
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.row_starts = np.cumsum(self.spans) - self.spans
        # embedding rows of each sentence
        self.weight = np.add.reduceat(self.spans[self.ids], self.starts).astype(np.float32) if len(self.sizes) else np.zeros(0, np.float32)

    @classmethod
    def of(cls, sentences_: list[str]) -> tuple[Words, np.ndarray]:
        """Words of the sentences that have any, and which those are."""
        found = np.array(_TOKENS.findall("\n".join(sentences_).lower()), object) if sentences_ else np.empty(0, object)
        code, vocab = pd.factorize(found)
        cut = np.flatnonzero(vocab == "\n")
        is_cut = code == cut[0] if len(cut) else np.zeros(len(code), bool)
        sizes = np.bincount(np.cumsum(is_cut)[~is_cut], minlength=len(sentences_))
        ids = code[~is_cut]
        if len(cut):
            ids, vocab = ids - (ids > cut[0]), np.delete(vocab, cut[0])
        rows = [_word_rows(w) for w in vocab.tolist()]
        spans = np.array([len(r) for r in rows], np.int64)
        flat = np.array([x for r in rows for x in r], np.int64)
        has = sizes > 0
        return cls(ids, sizes[has], flat, spans), has

    def taken(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and sizes of some sentences."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        return self.ids[np.arange(sizes.sum()) + np.repeat(self.starts[which] - (ends - sizes), sizes)], sizes


def _run_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0) if len(starts) else np.zeros((0, x.shape[1]), x.dtype)


# ---- model
@dataclass
class Model:
    """Embeddings (rows x ``DIM``), outputs (``DIM`` x subjects) and biases."""

    emb: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, subjects: int, seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        emb = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
        out = (rng.standard_normal((DIM, subjects)) / DIM).astype(np.float32)
        return cls(emb, out, np.full(subjects, -2.0, np.float32))

    def packed_scores(self, w: Words) -> np.ndarray:
        """Probability of each subject per sentence."""
        vectors = _run_sums(self.emb[w.rows], w.row_starts)
        h = _run_sums(vectors[w.ids], w.starts) / w.weight[:, None]
        return 1 / (1 + np.exp(-(h @ self.out + self.bias)))

    def scores(self, feats: list) -> np.ndarray:
        """The same for lists of embedding rows."""
        if not len(feats):
            return np.zeros((0, len(self.bias)), np.float32)
        sizes = np.array([len(f) for f in feats])
        rows = np.concatenate([np.asarray(f, np.int64) for f in feats])
        h = np.add.reduceat(self.emb[rows], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return 1 / (1 + np.exp(-(h @ self.out + self.bias)))


class Trainer:
    """Mini-batch steps with per-parameter rates from a start model; keeps which rows were touched."""

    def __init__(self, start: Model):
        self.base, self.n = start, 0
        self.model = Model(start.emb.copy(), start.out.copy(), start.bias.copy())
        self.touched = np.zeros(BUCKETS, bool)

    def one_pass(self, w: Words, labels: np.ndarray, weights: np.ndarray, seed: int) -> None:
        """One pass over all sentences of ``w``; rates start anew."""
        m = self.model
        g_emb, g_out, g_bias = np.full(BUCKETS, 1e-2, np.float32), np.full_like(m.out, 1e-2), np.full_like(m.bias, 1e-2)
        order = np.random.default_rng(seed).permutation(len(w.sizes))
        small = np.arange(0, BATCH, RATE_BATCH)
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            ids, sizes = w.taken(pick)
            # the batch's distinct words, and its word places in the order of the words
            by_word = np.argsort(ids, kind="stable")
            new = np.ones(len(ids), bool)
            new[1:] = ids[by_word][1:] != ids[by_word][:-1]
            first = np.flatnonzero(new)
            words = ids[by_word[first]]
            place = np.empty(len(ids), np.int64)
            place[by_word] = np.cumsum(new) - 1
            spans = w.spans[words]
            ends = np.cumsum(spans)
            rows = w.rows[np.arange(spans.sum()) + np.repeat(w.row_starts[words] - (ends - spans), spans)]
            vectors = np.add.reduceat(m.emb[rows], ends - spans, axis=0)
            weight = w.weight[pick][:, None]
            h = np.add.reduceat(vectors[place], np.cumsum(sizes) - sizes, axis=0) / weight
            err = ((1 / (1 + np.exp(-(h @ m.out + m.bias)))) - labels[pick]) * weights[pick][:, None]
            d = err @ m.out.T / weight
            # per word, then per embedding row: sums of the gradients and of their squared lengths
            both = np.concatenate([d, (d**2).sum(1, keepdims=True)], axis=1)
            of_word = np.add.reduceat(np.repeat(both, sizes, axis=0)[by_word], first, axis=0)
            by_row = np.argsort(rows, kind="stable")
            start = np.ones(len(rows), bool)
            start[1:] = rows[by_row][1:] != rows[by_row][:-1]
            at = np.flatnonzero(start)
            g = np.add.reduceat(np.repeat(of_word, spans, axis=0)[by_row], at, axis=0)
            hit = rows[by_row[at]]
            g_emb[hit] += g[:, DIM] * RATE_BATCH
            m.emb[hit] -= RATE * g[:, :DIM] / np.sqrt(g_emb[hit])[:, None]
            self.touched[hit] = True
            for s in small[small < len(pick)]:  # outputs take a step per RATE_BATCH sentences
                part = slice(s, s + RATE_BATCH)
                d_out, d_bias = h[part].T @ err[part] / len(err[part]), err[part].mean(0)
                g_out += d_out**2
                g_bias += d_bias**2
                m.out -= RATE * d_out / np.sqrt(g_out)
                m.bias -= RATE * d_bias / np.sqrt(g_bias)

    def change(self) -> pd.DataFrame:
        """One row with the change of all parameters, or none."""
        if not self.n:
            return pd.DataFrame({"n": np.empty(0, np.int64), **{c: [] for c in "abcde"}})
        at = np.flatnonzero(self.touched)
        return _change_row(self.n, at, np.ones(len(at)), self.model.emb[at] - self.base.emb[at], (self.model.out - self.base.out) * self.n, (self.model.bias - self.base.bias) * self.n)


_CHANGE = "n bigint, a binary, b binary, c binary, d binary, e binary"


def _change_row(n: int, at: np.ndarray, times: np.ndarray, emb: np.ndarray, out: np.ndarray, bias: np.ndarray) -> pd.DataFrame:
    parts = [at.astype(np.int32), times.astype(np.float32), emb.astype(np.float32), out.astype(np.float32), bias.astype(np.float32)]
    return pd.DataFrame({"n": [n], **{c: [np.ascontiguousarray(x).tobytes()] for c, x in zip("abcde", parts, strict=True)}})


def _added(rows, subjects: int) -> tuple:
    """Sums of changes: rows, times each embedding row was touched, and the three parameter sums."""
    n, times, emb = 0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, DIM), np.float32)
    out, bias = np.zeros((DIM, subjects), np.float32), np.zeros(subjects, np.float32)
    for r in rows:
        at = np.frombuffer(r["a"], np.int32)
        n += int(r["n"])
        times[at] += np.frombuffer(r["b"], np.float32)
        emb[at] += np.frombuffer(r["c"], np.float32).reshape(-1, DIM)
        out += np.frombuffer(r["d"], np.float32).reshape(DIM, subjects)
        bias += np.frombuffer(r["e"], np.float32)
    return n, times, emb, out, bias


def synchronised(model: Model, changes: DataFrame, tasks: int) -> Model | None:
    """``model`` after the changes of all partitions, added in a tree; ``None`` without changes."""
    subjects = len(model.bias)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [r for b in batches for r in b.to_dict("records")]
        if got:
            n, times, emb, out, bias = _added(got, subjects)
            at = np.flatnonzero(times)
            yield _change_row(n, at, times[at], emb[at], out, bias)

    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        changes = changes.repartition(tasks).mapInPandas(add, _CHANGE)
    n, times, emb, out, bias = _added(changes.collect(), subjects)  # at most FAN_IN rows of fixed size
    if not n:
        return None
    return Model(model.emb + emb / np.maximum(times, 1)[:, None], model.out + out / n, model.bias + bias / n)


# ---- labels
@dataclass
class Labelled:
    """The labelled sentences, small and bounded, sent to every task."""

    words: Words
    text: np.ndarray
    label: np.ndarray

    @classmethod
    def of(cls, samples: DataFrame, subjects: list[str]) -> Labelled:
        rows = samples.where("subject is not null and sample_id is not null").select("sample_id", "subject", "text")
        rows = rows.orderBy(F.xxhash64("sample_id", "text")).limit(MOST_LABELLED).collect()  # the documented bound of the labelled sample
        rows = sorted(rows, key=lambda r: (r["sample_id"], r["subject"], r["text"] or ""))
        parts = [sentences(r["text"]) for r in rows]
        words, has = Words.of([s for p in parts for s in p])
        text = np.repeat(np.arange(len(rows)), [len(p) for p in parts])[has]
        label = np.eye(len(subjects), dtype=np.float32)[[subjects.index(r["subject"]) for r in rows]] if rows else np.zeros((0, len(subjects)), np.float32)
        return cls(words, text, label[text])

    def part(self, of: int, parts: int) -> tuple[Words, np.ndarray]:
        """Every ``parts``-th text, so that the tasks together have each text once."""
        at = np.flatnonzero(self.text % parts == of % parts)
        ids, sizes = self.words.taken(at)
        return Words(ids, sizes, self.words.rows, self.words.spans), self.label[at]


def lent_labels(p: np.ndarray, doc: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    """(sentences, their labels) that documents lend, from their sentences' scores; ``doc`` ascends from 0."""
    k = p.shape[1]
    one = np.eye(k, dtype=np.float32)
    if not len(doc):
        return np.empty(0, np.int64), np.zeros((0, k), np.float32)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    n = np.diff(np.append(starts, len(doc)))
    own = np.repeat(np.arange(len(n)), n)
    seen = np.where(p > CLEAR_SCORE, p, 0)
    whole = np.add.reduceat(seen, starts, axis=0)
    best = p.argmax(1)
    sure = p[np.arange(len(p)), best] > 0.5
    if how == "rest":
        rest = whole[own] - seen
        mass = rest.sum(1)
        at = np.flatnonzero((n[own] > 1) & (mass >= 0.5))
        share = (rest[at] / mass[at, None]).astype(np.float32)
        keeps = sure[at] & (share[np.arange(len(at)), best[at]] >= 0.3)
        return at, np.where(keeps[:, None], one[best[at]], share)
    top = whole.argmax(1)
    most = whole[np.arange(len(n)), top]
    clear = (n > 1) & (most >= CLEAR_LEAST) & (most >= CLEAR_SHARE * whole.sum(1))
    at = np.flatnonzero(clear[own])
    if how == "whole":
        return at, one[top[own[at]]]
    # a second subject that the document treats keeps its sentences, a passing mention does not
    shown = (np.add.reduceat((p > 0.5).astype(np.int64), starts, axis=0) - 1) / np.maximum(1, n - 1)[:, None] >= SHARE
    shown[np.arange(len(n)), top] = True
    keeps = sure[at] & shown[own[at], best[at]]
    return at, one[best[at]] * keeps[:, None]


# ---- documents
_BLOCK = "slice int, doc_ids binary, no_id binary, sentences binary, worded binary, ids binary, sizes binary, rows binary, spans binary"


def packed(docs: DataFrame) -> DataFrame:
    """Documents (``doc_id``, ``text``) as blocks of flat arrays, whole documents each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        slice_ = TaskContext.get().partitionId()
        held: list[tuple] = []

        def block() -> pd.DataFrame:
            words, has = Words.of([s for _, part in held for s in part])
            count = np.array([len(part) for _, part in held], np.int32)
            worded = np.bincount(np.repeat(np.arange(len(held)), count)[has], minlength=len(held))
            ids = [i for i, _ in held]
            cols = {
                "doc_ids": np.array([0 if pd.isna(i) else int(i) for i in ids], np.int64), "no_id": np.array([pd.isna(i) for i in ids], bool),
                "sentences": count, "worded": worded.astype(np.int32), "ids": words.ids.astype(np.int32), "sizes": words.sizes.astype(np.int32),
                "rows": words.rows.astype(np.uint16), "spans": words.spans.astype(np.int32),
            }
            return pd.DataFrame({"slice": [slice_ % SLICES], **{k: [v.tobytes()] for k, v in cols.items()}})

        size = 0
        for b in batches:
            for i, text in zip(b["doc_id"].array, b["text"], strict=True):
                held.append((i, part := sentences(text)))
                size += len(part)
                if size >= BLOCK_ROWS or len(held) >= BLOCK_ROWS:
                    yield block()
                    held, size, slice_ = [], 0, slice_ + 1
        if held:
            yield block()

    rows = docs.select("doc_id", "text")
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < tasks:  # a few large files would leave most tasks idle
        rows = rows.repartition(tasks)
    return rows.mapInPandas(run, _BLOCK)


def _of_block(b) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the document of each sentence with words, ids, which ids are null, and all sentences of each document."""
    words = Words(*[np.frombuffer(b[c], kind).astype(np.int64) for c, kind in (("ids", np.int32), ("sizes", np.int32), ("rows", np.uint16), ("spans", np.int32))])
    worded = np.frombuffer(b["worded"], np.int32)
    return words, np.repeat(np.arange(len(worded)), worded), np.frombuffer(b["doc_ids"], np.int64), np.frombuffer(b["no_id"], bool), np.frombuffer(b["sentences"], np.int32)


def _balance(sums: np.ndarray) -> np.ndarray:
    """Weights by which sentences of rare subjects count more."""
    return np.clip(sums.sum() / len(sums) / np.maximum(sums, 1), 0.5, 8) ** 0.5


def _weighted(labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (labels @ weights + (1 - np.minimum(1, labels.sum(1)))).astype(np.float32)


def first_fit(spark: SparkSession, labelled: Labelled, subjects: int, rounds: int = 8, passes: int = 5, seed: int = 0) -> Model:
    """Synchronised training on the labelled texts alone."""
    model, rows = Model.fresh(subjects, seed), spark.sparkContext.broadcast(labelled)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], sent=sent, r=r) -> Iterator[pd.DataFrame]:
            for b in batches:
                for part in b["id"]:
                    words, labels = rows.value.part(int(part), PARTS)
                    trainer = Trainer(sent.value)
                    for i in range(passes if len(labels) else 0):
                        trainer.one_pass(words, labels, np.ones(len(labels), np.float32), (seed * 1000 + r) * 100 + i)
                    trainer.n = len(labels)
                    yield trainer.change()

        model = synchronised(model, spark.range(0, PARTS, 1, PARTS).mapInPandas(run, _CHANGE), PARTS) or model
        sent.destroy()
    rows.destroy()
    return model


def lending_fit(blocks: DataFrame, labelled: Labelled, lender: Model, how: str, times: int, rounds: int, seed: int) -> Model:
    """Synchronised training on the sentences of all documents with lent labels, and the labelled texts ``times`` times.

    Few sentences are gone over so often in a round that it sees ``ROUND_ROWS``; of many a round
    takes as many slices as that needs or more, so that the rounds together take every block.
    """
    spark, subjects = blocks.sparkSession, len(lender.bias)
    sc = spark.sparkContext
    model, lends, rows = Model.fresh(subjects, seed), sc.broadcast(lender), sc.broadcast(labelled)

    def lent(b) -> tuple[Words, np.ndarray]:
        words, doc, _, no_id, _ = _of_block(b)
        at, labels = lent_labels(lends.value.packed_scores(words), doc, how)
        keep = ~no_id[doc[at]]
        ids, sizes = words.taken(at[keep])
        return Words(ids, sizes, words.rows, words.spans), labels[keep]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, np.zeros(subjects)
        for batch in batches:
            for b in batch.to_dict("records"):
                labels = lent(b)[1]
                n, sums = n + len(labels), sums + labels.sum(0)
        yield pd.DataFrame({"n": [n], "at": [0], "s": [0.0]} if not n else {"n": [n] + [0] * subjects, "at": [-1, *range(subjects)], "s": [0.0, *sums]})

    totals = {r["at"]: r for r in blocks.mapInPandas(count, "n bigint, at int, s double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}  # a row per subject
    sums = np.array([totals[k]["s"] if k in totals else 0.0 for k in range(subjects)]) + times * labelled.label.sum(0)
    n = (totals[-1]["n"] if -1 in totals else 0) + times * len(labelled.text)
    if not n:
        return lender
    weights = _balance(sums)
    slices = max(1, min(rounds, n // ROUND_ROWS))
    passes = max(1, min(30, round(ROUND_ROWS / n)))
    for r in range(rounds):
        read = blocks.where(F.col("slice") % slices == r % slices) if slices > 1 else blocks
        tasks = read.rdd.getNumPartitions()
        sent = sc.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], sent=sent, r=r, tasks=tasks) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            trainer = Trainer(sent.value)
            first, own = (seed * 1000 + r) * 100, TaskContext.get().partitionId()

            def go(words: Words, labels: np.ndarray, repeats: int) -> None:
                for i in range(repeats if len(labels) else 0):
                    trainer.one_pass(words, labels, _weighted(labels, weights), first + i)
                trainer.n += len(labels)

            # the task's share of the labelled texts comes last, so that it isn't forgotten
            some, theirs = rows.value.part(own, tasks)
            for batch in batches:
                for b in batch.to_dict("records"):
                    go(*lent(b), passes)
            go(some, theirs, times * passes)
            yield trainer.change()

        model = synchronised(model, read.mapInPandas(run, _CHANGE), tasks) or model
        sent.destroy()
    lends.destroy()
    rows.destroy()
    return model


#: The lending fits: how labels are lent, how often the labelled texts count, rounds.
LENDING = (("rest", 4, 4), ("whole", 3, 4), ("treated", 1, 5))


def train(spark: SparkSession, samples: DataFrame, blocks: DataFrame) -> tuple[Model, list[str]]:
    """Fit on the labelled texts, then three times with labels lent by all documents (written ``blocks``, see :func:`packed`)."""
    # the subjects are a handful of names
    subjects = sorted(r[0] for r in samples.select("subject").where("subject is not null").distinct().collect())
    labelled = Labelled.of(samples, subjects)
    model = first_fit(spark, labelled, len(subjects))
    for seed, (how, times, rounds) in enumerate(LENDING, start=1):
        model = lending_fit(blocks, labelled, model, how, times, rounds, seed)
    return model, subjects


def written_blocks(docs: DataFrame) -> DataFrame:
    """:func:`packed` documents, written once to the shared folder."""
    spark = docs.sparkSession
    packed(docs).write.parquet(path := scratch_path(spark, "words"))
    return spark.read.schema(_BLOCK).parquet(path)


def subject_shares(blocks: DataFrame, model: Model, subjects: list[str]) -> DataFrame:
    """Of every document of ``blocks``, each subject that any sentence treats: ``doc_id``, ``subject``, ``share``."""
    sent = blocks.sparkSession.sparkContext.broadcast(model)
    names = np.array([*subjects, None], object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.to_dict("records"):
                words, doc, ids, no_id, count = _of_block(b)
                treated = np.zeros((len(ids), len(subjects)))
                if len(doc):
                    np.add.at(treated, doc, sent.value.packed_scores(words) > 0.5)
                share = treated / np.maximum(1, count)[:, None]
                d, k = np.nonzero(share)
                yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids[d].copy(), no_id[d].copy()), "subject": names[k], "share": share[d, k]})

    return blocks.mapInPandas(run, "doc_id bigint, subject string, share double")
