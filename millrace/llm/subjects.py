"""Subject areas of texts: term weighting, truncated SVD and cosine similarity to seed centroids.

Rounds of the same steps, each with the subjects the one before has given:

1. Terms (words and pairs of neighbouring words) are counted by the subject of their texts.  A term weighs the more, the rarer it is
   and the fewer subjects share it; the ``vocabulary`` heaviest make the columns.
2. The weighted matrix of texts and terms is reduced to ``rank`` dimensions by a truncated singular value decomposition: subspace
   iteration, one map over the texts and one sum of a vocabulary x rank matrix each time.
3. Each subject has several centroids, seeded with the terms of the texts that annotators gave it and of its own description, and
   refined: every text goes to the nearest centroid by cosine similarity, and the centroids move to the mean of their texts.

In the end texts are cut into mentions, the unbroken runs of words that have a place in the vocabulary.  A mention is embedded as a text is
and belongs to the subject of the centroid nearest to it by cosine similarity, if that is near enough; a text has the subjects of its
mentions, those of a single one only if no other has more, and then the nearest of them.  A text without mentions near any centroid has
the default subject.

All texts take part in every count, sum and refinement.  What reaches the driver and what is broadcast is bounded by the
parameters: the vocabulary, vocabulary x rank numbers, the centroids, and the sample of labelled texts that seeds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.blocks import NO_ID, Block, Packed, blocks, counted, narrow
from millrace.llm.words import Words
from millrace.operators.lineage import checkpointed

#: Terms of a block of the vocabulary that is summed as one value; partial results summed at a time; texts a task at least.
BLOCK, FAN_IN, TASK_TEXTS = 512, 64, 50_000


@dataclass(frozen=True)
class Settings:
    """``labelled`` is how many labelled texts seed the centroids at most, the first by a hash of their ids."""

    labelled: int = 200_000
    vocabulary: int = 16384
    rank: int = 64
    rounds: int = 4
    power: int = 4
    refine: int = 4
    least: tuple[int, ...] = (2, 3)  # texts that a term must occur in, by round
    pure: tuple[float, ...] = (0.8, 0.6)  # least share of its main subject
    sure: float = 0.9  # words of such a share need no pairs
    near: float = 0.02  # least cosine of a text or mention and a centroid
    clear: float = 0.5  # by what share of it a text's best cosine must lead the second for the text to take part in the next step
    told_apart: float = 0.3  # the same for a mention to count
    mentions: int = 2
    default: str = "software"
    seed: int = 1


@dataclass(frozen=True)
class Model:
    """Terms in order of their ids, with their weights and vectors, and the centroids, one a subject."""

    terms: np.ndarray
    weight: np.ndarray
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where ids stand among the terms, -1 if nowhere; most stand nowhere and fall through a sieve of bits."""
        out = np.full(len(ids), -1, np.int32)
        if len(self.terms):
            sieve = np.zeros(1 << 20, bool)
            sieve[self.terms & ((1 << 20) - 1)] = True
            some = np.flatnonzero(sieve[ids & ((1 << 20) - 1)])
            at = np.minimum(np.searchsorted(self.terms, ids[some]), len(self.terms) - 1)
            hit = self.terms[at] == ids[some]
            out[some[hit]] = at[hit]
        return out


@dataclass
class Matrix(Packed):
    """The rows of the matrix of some texts: number of columns of each, the columns, and how often the text has that term; with the
    annotators' subjects (as in :class:`Block`) and the subject that the text had so far, plus one."""

    told: np.ndarray
    given: np.ndarray
    size: np.ndarray
    col: np.ndarray
    often: np.ndarray

    def values(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and value of each entry; rows have length 1."""
        x = (1 + np.log(self.often.astype(np.float32))) * weight[self.col]
        row = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        norm = np.sqrt(np.bincount(row, x.astype(float) ** 2, len(self.size))).astype(np.float32)
        return row, x / np.maximum(norm[row], 1e-12)

    def members(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, subject): what annotators told, of other texts what was ``found`` (-1: nothing)."""
        text, subject = (self.told >> 8).astype(np.int64), (self.told & 255).astype(np.int64)
        free = np.array(found)
        free[text] = -1
        some = np.flatnonzero(free >= 0)
        return np.concatenate([text, some]), np.concatenate([subject, free[some]])


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-12)


def gather_sums(size: np.ndarray, col: np.ndarray, x: np.ndarray, src: np.ndarray, piece: int = 32, most: int = 1 << 12) -> np.ndarray:
    """Row i of the result is the sum of x * src[col] over the ``size[i]`` entries of row i.

    Rows are cut into pieces of at most ``piece`` entries; pieces of one length are multiplied together.
    """
    size = size.astype(np.int64)
    many = -(-size // piece)
    first = np.r_[0, np.cumsum(many)]
    total = int(first[-1])
    out = np.zeros((len(size), src.shape[1]), np.float32)
    if not total:
        return out
    k = np.arange(total) - np.repeat(first[:-1], many)
    begin = np.repeat(np.r_[0, np.cumsum(size)[:-1]], many) + k * piece
    n = np.minimum(np.repeat(size, many) - k * piece, piece)
    part = np.empty((total, src.shape[1]), np.float32)
    by = np.argsort(n.astype(np.uint16), kind="stable")
    cut = np.r_[0, np.cumsum(np.bincount(n, minlength=piece + 1))]
    for length in range(1, piece + 1):
        step = max(1, most // length)
        for a in range(cut[length], cut[length + 1], step):
            r = by[a : min(cut[length + 1], a + step)]
            at = begin[r][:, None] + np.arange(length)
            part[r] = np.matmul(x[at][:, None, :], src[col[at]])[:, 0]
    has = np.flatnonzero(many)
    out[has] = np.add.reduceat(part, first[:-1][has], axis=0) if total > len(has) else part
    return out


def transposed_sums(m: Matrix, row: np.ndarray, x: np.ndarray, src: np.ndarray, n: int) -> np.ndarray:
    """As :func:`gather_sums`, by column: n sums of x * src[row]."""
    by = np.argsort(m.col, kind="stable")
    return gather_sums(np.bincount(m.col, minlength=n), row[by], x[by], src)


def _nearest(e: np.ndarray, centroids: np.ndarray, near: float, clear: float) -> np.ndarray:
    """The subject whose centroid is nearest by cosine, if it is near enough and leads the second clearly; else -1."""
    cos = _unit(e) @ centroids.T
    if cos.shape[1] == 1:
        return np.where(cos[:, 0] >= near, 0, -1)
    top = np.sort(cos, 1)[:, -2:]
    ok = (top[:, 1] >= near) & (top[:, 1] - np.maximum(top[:, 0], 0) >= clear * top[:, 1])
    return np.where(ok, cos.argmax(1), -1)


def matrix(b: Block, model: Model, given: np.ndarray | None = None) -> Matrix:
    col = model.places(b.ids())[b.term]
    use = col >= 0
    text = np.repeat(np.arange(len(b.doc)), b.terms)[use]
    so_far = np.zeros(len(b.doc), np.uint16) if given is None else (given + 1).astype(np.uint16)
    return Matrix(b.told, so_far, np.bincount(text, minlength=len(b.doc)).astype(np.uint32), narrow(col[use].astype(np.int64)), b.often[use])


def embedded(m: Matrix, model: Model) -> np.ndarray:
    return gather_sums(m.size, m.col, m.values(model.weight)[1], model.vectors)


def subject_of(b: Block, model: Model | None, s: Settings) -> np.ndarray:
    """The subject that ``model`` gives each text, -1 for none."""
    if model is None or not len(model.terms):
        return np.full(len(b.doc), -1)
    return _nearest(embedded(matrix(b, model), model), model.centroids, s.near, s.clear)


def counts(b: Block, found: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the dictionary marked by ``use``, with a subject (term << 8 | subject), and in how many texts of it they are."""
    start = np.r_[0, np.cumsum(b.terms, dtype=np.int64)]
    text, subject = Matrix(b.told, found, b.terms, b.term, b.often).members(found)
    n = b.terms[text].astype(np.int64)
    at = np.repeat(start[text] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
    term, subject = b.term[at], np.repeat(subject, n)
    keep = use[term]
    return counted((term[keep].astype(np.int64) << 8) | subject[keep])


def mentioned(b: Block, model: Model, s: Settings) -> np.ndarray:
    """How many mentions of each text are of each subject.

    A mention is an unbroken run of words that are terms or parts of a pair that is one."""
    n = len(model.centroids)
    out = np.zeros((len(b.doc), n), np.int64)
    word = b.word.astype(np.int64)
    if not len(word):
        return out
    place = model.places(b.ids())
    text = np.repeat(np.arange(len(b.size)), b.size)
    own = place[word]
    inside = text[1:] == text[:-1]
    pair = np.full(len(word) - 1, -1)
    if len(b.left):
        keys, key = (b.left.astype(np.int64) << 24) | b.right, (word[:-1] << 24) | word[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        pair = np.where(inside & (keys[at] == key), place[len(b.words) + at], -1)
    cover = own >= 0
    cover[:-1] |= pair >= 0
    cover[1:] |= pair >= 0
    begins = cover & ~np.r_[False, cover[:-1] & inside]
    run = np.cumsum(begins) - 1
    i, j = np.flatnonzero(own >= 0), np.flatnonzero(pair >= 0)
    of, col = np.concatenate([run[i], run[j]]), np.concatenate([own[i], pair[j]])
    by = np.argsort(of, kind="stable")
    e = gather_sums(np.bincount(of, minlength=int(begins.sum())), col[by], model.weight[col[by]], model.vectors)
    subject = _nearest(e, model.centroids, s.near, s.told_apart)
    use = subject >= 0
    np.add.at(out, (text[begins][use], subject[use]), 1)
    return out


def decide(b: Block, model: Model, s: Settings, default: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, subject, mentions) of all texts of a block."""
    if not len(model.terms):
        return np.arange(len(b.doc)), np.full(len(b.doc), default), np.zeros(len(b.doc), np.int64)
    m = mentioned(b, model, s)
    row, at = np.nonzero(m >= s.mentions)
    weak = np.flatnonzero(m.max(1, initial=0) < s.mentions)
    cos = (_unit(embedded(matrix(b, model), model)) @ model.centroids.T)[weak]
    once = m[weak] > 0
    best = np.where(once.any(1), np.where(once, cos, -2).argmax(1), np.where(cos.max(1, initial=-1) >= s.near, cos.argmax(1), default))
    row, at = np.r_[row, weak], np.r_[at, best]
    return row, at, m[row, at]


# over all texts


def seeds(labels: DataFrame, names: list[str], most: int) -> DataFrame:
    """(doc_id, told): the subjects that annotators gave a text; spaces and case are ignored.  ``most`` texts at most, by a hash of their ids."""
    index = F.array_position(F.array(*[F.lit(n.strip().lower()) for n in names]), F.lower(F.trim("subject"))) - 1
    told = labels.filter(F.col("doc_id").isNotNull()).select("doc_id", index.cast("int").alias("s")).filter("s >= 0").groupBy("doc_id").agg(F.collect_set("s").alias("told"))
    return told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _described(about: list[tuple[str, str | None]], weight: int) -> list[tuple[int, int]]:
    """The words of the subjects' names and descriptions, as (term, count and subject): as if so many texts of it had them."""
    w = Words()
    out = []
    for i, (name, text) in enumerate(about):
        at = w.places(f"{name} {text or ''}")
        out += [(int(t), weight * 256 + i) for t in np.unique(w.ids()[at])]
    return out


def _tally(texts: DataFrame, of: Callable[[Block], tuple[np.ndarray, np.ndarray]], n: int, more: DataFrame | None = None) -> DataFrame:
    """(term, n0, n1, ...): in how many texts of each subject a term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in Block.rows(batches):
            key, k = of(b)
            yield pa.RecordBatch.from_arrays([pa.array(b.ids()[key >> 8], pa.int64()), pa.array((k << 8) | (key & 255), pa.int64())], ["term", "sn"])

    rows = texts.mapInArrow(run, "term long, sn long")
    if more is not None:
        rows = rows.unionByName(more)
    # already added up within blocks: what is shuffled is narrow
    s, k = F.col("sn").bitwiseAND(255), F.shiftright("sn", 8)
    return rows.repartition("term").groupBy("term").agg(*[F.sum(F.when(s == i, k).otherwise(0)).alias(f"n{i}") for i in range(n)])


def _rated(tally: DataFrame, sizes: np.ndarray, least: int, pure: float, most: int) -> dict[str, np.ndarray]:
    """The ``most`` terms of a tally that tell subjects apart best: id, number of texts, weight of purity, rank and share of the main subject."""
    n = len(sizes)
    many = np.maximum(1, sizes).astype(float)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.column_stack([b[f"n{i}"].to_numpy() for i in range(n)]).astype(float)

            def shares(more: float, c: np.ndarray = c) -> np.ndarray:
                rate = (c + more) / many
                return rate / rate.sum(1, keepdims=True)

            def purity(p: np.ndarray) -> np.ndarray:
                entropy = -(p * np.log(np.where(p > 0, p, 1.0))).sum(1) / np.log(max(2, n))
                return (1 - entropy) ** 2

            total, share = c.sum(1), shares(0.0)
            ok = share.max(1, initial=0.0) >= pure
            # in the order of choice, half a text more of every subject: a term of few texts, which may be copies of one, proves little
            cols = [b["term"].to_numpy(), total, purity(share), purity(shares(0.5)) * np.sqrt(total), share.max(1, initial=0.0)]
            yield pa.RecordBatch.from_arrays([pa.array(v[ok]) for v in cols], ["term", "total", "w", "rank", "share"])

    total = sum(F.col(f"n{i}") for i in range(n))
    found = tally.filter(total >= least).mapInArrow(weigh, "term long, total double, w double, rank double, share double")
    t = found.orderBy(F.col("rank").desc(), "term").limit(most).toArrow()
    return {c: t[c].to_numpy() for c in t.column_names}


def _vocabulary(parts: list[dict[str, np.ndarray]], sizes: np.ndarray, most: int) -> Model:
    r = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    best = np.lexsort((r["term"], -r["rank"]))[:most]
    best = best[np.argsort(r["term"][best])]
    weight = r["w"][best] * np.log(max(2, sizes.sum()) / np.maximum(r["total"][best], 1)).clip(0.1)
    return Model(r["term"][best], weight.astype(np.float32))


def _sum_matrices(rows: DataFrame, part: Callable[..., np.ndarray], *told: Any) -> np.ndarray:
    """The sum of one matrix for each task of ``rows``, all of one shape, added up in blocks, ``FAN_IN`` at a time.

    ``part`` makes it of the batches and of ``told``, which is broadcast, and let go afterwards."""
    shared = rows.sparkSession.sparkContext.broadcast(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = part(batches, *shared.value)
        cuts = range(0, max(1, len(m)), BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array([c // BLOCK for c in cuts], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(cuts), pa.int32()), pa.array([m[c : c + BLOCK].astype(np.float32).tobytes() for c in cuts], pa.binary())],
            ["block", "salt", "m"],
        )

    def add(t: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in t["m"]).astype(np.float32)
        return pa.table({"block": t["block"].slice(0, 1), "salt": t["salt"].slice(0, 1), "m": pa.array([s.tobytes()], pa.binary())})

    kind = "block int, salt int, m binary"
    parts, left = rows.mapInArrow(run, kind), rows.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        parts = parts.withColumn("salt", F.floor(F.col("salt") / FAN_IN).cast("int")).groupBy("block", "salt").applyInArrow(add, kind)
    got = sorted(parts.collect(), key=lambda r: r["block"])
    shared.destroy()
    return np.concatenate([np.frombuffer(r["m"], np.float32) for r in got]).astype(float) if got else np.zeros(0)


def _fit(rows: DataFrame, model: Model, prior: np.ndarray, s: Settings) -> tuple[Model, np.ndarray]:
    """Decomposes the matrix and refines the centroids; and how many texts then are of each subject.

    The first sum of the subspace iteration also gives the sum of the texts of each subject.  These sums are added to the leading singular
    vectors: terms that are rare have next to no part in those, and texts made of such terms would have no place.  ``prior`` has a column of
    terms for each subject, which counts as a text of it to begin with."""
    v, k, n = len(model.terms), min(s.rank, len(model.terms)), prior.shape[1]
    q, weight, means = np.linalg.qr(np.random.default_rng(s.seed).standard_normal((v, k)))[0], model.weight, np.zeros((v, 0))
    for step in range(max(1, s.power)):

        def power(batches: Iterator[pa.RecordBatch], q: np.ndarray, first: bool = step == 0) -> np.ndarray:
            y = np.zeros((v, k + n if first else k), np.float32)
            for m in Matrix.rows(batches):
                row, x = m.values(weight)
                e = gather_sums(m.size, m.col, x, q)
                if first:
                    own = np.zeros((len(m.size), n), np.float32)
                    own[m.members(m.given.astype(np.int64) - 1)] = 1
                    e = np.concatenate([e, own], 1)
                y += transposed_sums(m, row, x, e, v)
            return y

        y = _sum_matrices(rows, power, q.astype(np.float32)).reshape(v, -1)  # what goes to the tasks is in single precision
        if step == 0:
            means = y[:, k:] + prior
            means = means / np.maximum(np.linalg.norm(means, axis=0), 1e-12)
        q = np.linalg.qr(y[:, :k])[0]
    vectors = np.linalg.qr(np.concatenate([means, q], 1))[0].astype(np.float32)
    model = Model(model.terms, weight, vectors)
    c, sizes, width = np.zeros((0, vectors.shape[1]), np.float32), np.zeros(n, int), vectors.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(model)
    for _ in range(s.refine + 1):

        def move(batches: Iterator[pa.RecordBatch], c: np.ndarray = c) -> np.ndarray:
            y = np.zeros((n, width + 1))  # sums of the texts of each subject, and their number
            for m in Matrix.rows(batches):
                e = _unit(embedded(m, shared.value))
                text, subject = m.members(_nearest(e, c, s.near, s.clear) if len(c) else m.given.astype(np.int64) - 1)
                by = np.argsort(subject, kind="stable")
                y[:, :width] += gather_sums(np.bincount(subject, minlength=n), text[by], np.ones(len(by), np.float32), e)
                y[:, width] += np.bincount(subject, minlength=n)
            return y

        y = _sum_matrices(rows, move).reshape(n, -1)
        if not len(c):
            y[:, :width] += _unit(prior.T @ vectors)
        c, sizes = _unit(y[:, :width]).astype(np.float32), y[:, width].astype(int)
    shared.destroy()
    return Model(model.terms, weight, vectors, c), np.maximum(sizes, 1)


def assign(spark: SparkSession, documents: DataFrame, subjects: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, subject, mentions): one row for each subject of each text.

    ``subjects`` names and describes the subjects, ``labels`` gives some texts subjects; wrong, missing, repeated and unevenly spelled labels
    do no harm in moderation.  Texts that are null or only white space have no row; any other text has one at least, also one without an
    id.  Texts without a term near any centroid have the default subject.  ``documents`` needs doc_id and text; other columns are ignored.
    """
    s = settings or Settings()
    found = subjects.filter(F.col("subject").isNotNull()).groupBy("subject").agg(F.min("about").alias("about")).limit(257).collect()
    if not 0 < len(found) <= 256:
        raise ValueError("between 1 and 256 subjects are expected")
    about = sorted((r["subject"], r["about"]) for r in found)
    names, n = [a for a, _ in about], len(about)
    default = names.index(s.default) if s.default in names else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.row() for b in blocks(batches))

    told = F.broadcast(seeds(labels, names, s.labelled))
    texts = checkpointed(spark, documents.select("doc_id", "text").join(told, "doc_id", "left").select("doc_id", "text", "told").mapInArrow(pack, Block.schema()))
    total = texts.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, min(texts.rdd.getNumPartitions(), -(-total // TASK_TEXTS)))
    described = _described(about, s.least[0])
    sizes = np.zeros(n, int)
    model: Model | None = None
    for r in range(s.rounds):
        least, pure = s.least[min(r, len(s.least) - 1)], s.pure[min(r, len(s.pure) - 1)]
        if r == 0:  # how many texts are told each subject

            def told_texts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                return sum((np.bincount((b.told & 255).astype(np.int64), minlength=n) for b in Block.rows(batches)), np.zeros(n))

            sizes = _sum_matrices(texts.select("n", "told").coalesce(tasks), told_texts).astype(int)

        so_far = spark.sparkContext.broadcast(model)
        bags = texts.select("n", *[c for c in texts.columns if c not in ("n", "word")])  # all but the order of words

        def of_words(b: Block, m: Any = so_far) -> tuple[np.ndarray, np.ndarray]:
            return counts(b, subject_of(b, m.value, s), np.arange(len(b.words) + len(b.left)) < len(b.words))

        more = spark.createDataFrame(described, "term long, sn long") if r == 0 else None
        words = _rated(_tally(bags, of_words, n, more), sizes, least, pure, s.vocabulary)
        sure = Model(np.sort(words["term"][words["share"] >= s.sure]), np.zeros(0))

        def of_pairs(b: Block, m: Any = so_far, sure: Model = sure) -> tuple[np.ndarray, np.ndarray]:
            known = sure.places(b.words) >= 0
            return counts(b, subject_of(b, m.value, s), np.r_[np.zeros(len(b.words), bool), ~(known[b.left] | known[b.right])])

        pairs = _rated(_tally(bags, of_pairs, n), sizes, least, pure, s.vocabulary)
        fresh = _vocabulary([words, pairs], sizes, s.vocabulary)
        if not len(fresh.terms):
            model = model or fresh  # no more terms to learn from
            break

        def weighted(batches: Iterator[pa.RecordBatch], m: Any = so_far, fresh: Model = fresh) -> Iterator[pa.RecordBatch]:
            return (matrix(b, fresh, subject_of(b, m.value, s)).row() for b in Block.rows(batches))

        # each task gives a whole matrix in every step: not too few texts a task
        rows = checkpointed(spark, bags.mapInArrow(weighted, Matrix.schema())).coalesce(tasks)
        so_far.destroy()
        prior = np.zeros((len(fresh.terms), n))
        if r == 0:
            term, subject = np.array(described, np.int64).reshape(-1, 2).T
            at = fresh.places(term)
            prior[at[at >= 0], subject[at >= 0] & 255] = fresh.weight[at[at >= 0]]
            prior = _unit(prior.T).T
        model, sizes = _fit(rows, fresh, prior, s)

    def run(batches: Iterator[pa.RecordBatch], m: Any = model) -> Iterator[pa.RecordBatch]:
        for b in Block.rows(batches):
            row, at, k = decide(b, m, s, default, n)
            ids = b.doc[row]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array([names[a] for a in at], pa.string()), pa.array(k, pa.int64())], ["doc_id", "subject", "mentions"])

    return texts.mapInArrow(run, "doc_id long, subject string, mentions long")
