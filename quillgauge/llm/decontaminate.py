"""Benchmark decontamination by latent semantic retrieval and longest common subsequences.

Texts are cut into passages of WINDOW words, each half over the next, and weighted by TF-IDF
over hashed words (the square of the inverse document frequency, so that rare words decide); document
frequencies count the half passages of the whole corpus. A randomised
singular value decomposition of the passage matrix, with the power iterations done by Spark
tasks, gives the latent space. It is fitted on the benchmark and on every passage of every document.
The passages' products are scaled as if there were `fit_passages` of them at most, and benchmark rows are
weighted by ITEM_WEIGHT, for the space has to tell the items apart at any size of the corpus; every passage of every document is then projected
and compared by cosine with every benchmark item. Documents' passages start at every FINE-th word;
items shorter than WINDOW are also compared with passages of half that length, for in a whole one the
words around a short item would outweigh it. The items go through in blocks of MAX_ITEMS, so
that what is sent to tasks is bounded; each block has a space of its own, fitted on its items,
with a direction for every RANK_ITEMS of them and RANK at least. Candidates are checked word by word: the longest common subsequence of the
item and the passage's surroundings must cover LCS_SHARE of the item's words, or PARAPHRASE_SHARE
of them if the item's answer, its last words of weight, is there as well, in order.

Nulls and empty texts have no passages. Items without words match nothing. Very long texts are
cut like others, in pieces. Repeated rows are each reported; ties of score go by item id. Empty
tables give empty results. Extra columns do not matter. No pair of documents is ever formed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.llm.common import PARTIALS, partial_rows, slices, summed
from quillgauge.llm.tokens import bucket
from quillgauge.operators.scale import durable

STEP, WINDOW, FINE = 24, 48, 12
BUCKETS = 1 << 15
PAD = BUCKETS
RANK, EXTRA, POWER, RANK_ITEMS = 48, 8, 1, 16
ITEM_WEIGHT = 10.0
FIT_PASSAGES, MAX_ITEMS, GRAM_ROWS = 20_000, 4_096, 512
FIT_STEPS, READ_ROWS, SUM_STEPS, TASK_STEPS, FREQUENT = 1_024, 16, 256, 1 << 18, 64
COSINE = 0.7
LCS_SHARE, PARAPHRASE_SHARE, ANSWER_WORDS = 0.75, 0.55, 6
PIECE = 1_365 * STEP
WORDS = re.compile(r"\w+")
# Symbols beyond ASCII, and a table that makes blanks of those in ASCII.
SYMBOLS, FEW_SYMBOLS = re.compile(r"[^\w\x00-\x7f]"), 16
BLANKED = bytes(c if c > 127 or WORDS.match(chr(c)) else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    """Words in small letters; symbols between them do not count."""
    return WORDS.findall((text or "").lower())


def without_symbols(text: str) -> str:
    """`text` with blanks for its symbols beyond ASCII, of which most texts hold few different ones or none."""
    symbols = SYMBOLS.findall("".join(set(text)))
    if len(symbols) > FEW_SYMBOLS:
        return SYMBOLS.sub(" ", text)
    for symbol in "".join(symbols):
        text = text.replace(symbol, " ")
    return text


def word_codes(texts: list[str | None]) -> list[np.ndarray]:
    """Bucket numbers of the words of each text: those of `words_of`, cut and told apart by Arrow."""
    plain = [low if low.isascii() else without_symbols(low) for low in ((t or "").lower() for t in texts)]
    blanked = [p.encode("utf-8", "surrogatepass").translate(BLANKED) for p in plain]
    lists = pc.ascii_split_whitespace(pa.array(blanked, pa.large_binary()).view(pa.large_string()))
    words = lists.flatten().dictionary_encode()
    known = words.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)
    of = (np.fromiter(map(zlib.crc32, known), np.uint32, len(known)) % BUCKETS).astype(np.int32)
    # Blanks at the ends of a text leave empty words, which are none.
    of[pc.binary_length(words.dictionary).to_numpy() == 0] = PAD
    codes, ends = of[words.indices.to_numpy()], lists.offsets.to_numpy()
    pieces = [codes[one:end] for one, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return [p[p != PAD] for p in pieces]


def passages(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's words, in pieces of whole steps; pieces share what a passage needs."""
    for start in range(0, max(len(codes) - WINDOW + FINE, min(len(codes), 1)), PIECE):
        yield codes[start : start + PIECE + WINDOW - FINE]


def windows(codes: np.ndarray) -> Iterator[np.ndarray]:
    for start in range(0, max(len(codes) - STEP, 1), STEP):
        yield codes[start : start + WINDOW]


# What a step of STEP words is to its passages: the last of its text, the first of two, alone, or the
# first step of the next row, repeated for the passage that both share.
LAST, FIRST, ALONE, SHARED = range(4)
STEPS = "codes BINARY, roles BINARY"


def step_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The steps of all texts, filled up with PAD, and their roles; a row holds FIT_STEPS of them and one more at most."""
    for batch in slices(batches):
        texts = [c for c in word_codes(batch.column("text").to_pylist()) if len(c)]
        sizes = np.array([-(-len(c) // STEP) for c in texts], np.int64)
        steps, ends = np.full((int(sizes.sum()), STEP), PAD, np.uint16), np.cumsum(sizes)
        flat, roles = steps.reshape(-1), np.full(len(steps), FIRST, np.uint8)
        for codes, start in zip(texts, (ends - sizes).tolist(), strict=True):
            flat[start * STEP : start * STEP + len(codes)] = codes
        roles[ends - 1] = np.where(sizes > 1, LAST, ALONE)
        made = []
        for start in range(0, len(steps), FIT_STEPS):
            end = start + FIT_STEPS
            more = end < len(steps) and roles[end - 1] == FIRST
            role = np.append(roles[start:end], np.full(int(more), SHARED, np.uint8))
            made.append((steps[start : end + int(more)].tobytes(), role.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.binary()) for k in (0, 1)], ["codes", "roles"])


def read_steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of steps, some joined to one; each stands for itself, so their roles stay as they are."""
    for batch in slices(batches, READ_ROWS):
        codes, roles = (b"".join(batch.column(c).to_pylist()) for c in ("codes", "roles"))
        yield np.frombuffer(codes, np.uint16).reshape(-1, STEP), np.frombuffer(roles, np.uint8)


def runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different codes of each row as (code, count), and where each row's begin."""
    rows = np.sort(rows, axis=1)
    fresh = np.ones(rows.shape, bool)
    fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
    at = np.flatnonzero(fresh)
    edges = np.append(0, np.cumsum(fresh.sum(1))[:-1]) if len(rows) else np.zeros(0, np.int64)
    return rows.reshape(-1)[at], np.diff(at, append=rows.size), edges


def passage_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of one task's half passages hold each bucket; the last entry is their number."""
    total = np.zeros(BUCKETS + 1, np.int64)
    for steps, roles in read_steps(batches):
        own = steps[roles != SHARED]
        total[:BUCKETS] += np.bincount(runs(own)[0], minlength=BUCKETS + 1)[:BUCKETS]
        total[BUCKETS] += len(own)
    yield from partial_rows(total, TaskContext.get().partitionId())


def add_gram_of_steps(outer: np.ndarray, steps: np.ndarray, roles: np.ndarray, idf: np.ndarray, right: np.ndarray) -> None:
    """Adds A'(A right) for the TF-IDF rows of the passages of some steps; `right` is weighted by `idf`, PAD is 0 in both."""
    sums = np.empty((len(steps), right.shape[1]), right.dtype)
    for start in range(0, len(steps), SUM_STEPS):
        np.take(right, steps[start : start + SUM_STEPS], axis=0).sum(1, out=sums[start : start + SUM_STEPS])
    one, alone = np.flatnonzero(roles == FIRST), np.flatnonzero(roles == ALONE)
    made = np.zeros(sums.shape, sums.dtype)
    for rows, inner in ((np.hstack([steps[one], steps[one + 1]]), sums[one] + sums[one + 1]), (steps[alone], sums[alone])):
        if not len(rows):
            continue
        codes, counts, edges = runs(rows)
        norms = np.add.reduceat((counts * idf[codes]) ** 2, edges)
        inner /= np.maximum(norms, 1e-18).astype(inner.dtype)[:, None]
        if rows.shape[1] == STEP:
            made[alone] += inner
        else:
            made[one] += inner
            made[one + 1] += inner
    flat = steps.reshape(-1)
    order = np.argsort(flat, kind="stable")
    edges = np.flatnonzero(np.diff(flat[order].astype(np.int32), prepend=-1))
    if len(edges) and flat[order[edges[-1]]] == PAD:
        edges, order = edges[:-1], order[: edges[-1]]
    places, often = order // STEP, np.diff(edges, append=len(order))
    # Codes in falling order of their number: the frequent ones are summed one by one, of the
    # others all first places are added, then all second ones, and so on.
    falling = np.argsort(-often, kind="stable")
    edges, often = edges[falling], often[falling]
    part = np.zeros((len(edges), made.shape[1]), made.dtype)
    frequent = int(np.searchsorted(-often, -FREQUENT, side="left"))
    for k in range(frequent):
        part[k] = made[places[edges[k] : edges[k] + often[k]]].sum(0)
    for k in range(FREQUENT):
        end = max(int(np.searchsorted(-often, -k, side="left")), frequent)
        part[frequent:end] += made[places[edges[frequent:end] + k]]
    seen = flat[order[edges]]
    outer[seen] += part * idf[seen, None].astype(part.dtype)


def weighted(groups: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows as (row, bucket, value) triples, each row scaled to length 1."""
    rows, cols, values = [], [], []
    for k, codes in enumerate(groups):
        seen, counts = np.unique(codes, return_counts=True)
        value = counts * idf[seen]
        rows.append(np.full(len(seen), k))
        cols.append(seen)
        values.append(value / max(np.linalg.norm(value), 1e-9))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def gram_times(groups: list[np.ndarray], idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'(A right) for the TF-IDF rows of `groups`, GRAM_ROWS of them at a time."""
    outer = np.zeros(right.shape)
    for start in range(0, len(groups), GRAM_ROWS):
        rows, cols, values = weighted(groups[start : start + GRAM_ROWS], idf)
        if not len(rows):
            continue
        edges = np.flatnonzero(np.diff(rows, prepend=-1))
        inner = np.add.reduceat(right[cols] * values[:, None], edges, axis=0)
        order = np.argsort(cols, kind="stable")
        seen = np.flatnonzero(np.diff(cols[order], prepend=-1))
        place = np.cumsum(np.diff(rows, prepend=rows[0]) != 0)
        outer[cols[order][seen]] += np.add.reduceat(inner[place[order]] * values[order, None], seen, axis=0)
    return outer


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Space:
    """Projection of weighted buckets to the latent space."""

    basis: np.ndarray

    @cached_property
    def filled(self) -> np.ndarray:
        return np.append(self.basis, np.zeros((1, self.basis.shape[1]), self.basis.dtype), axis=0)

    def project(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of the windows of one piece: sums over steps, then over two steps."""
        steps = np.add.reduceat(np.take(self.basis, codes, axis=0), np.arange(0, len(codes), STEP), axis=0)
        return unit(steps[:-1] + steps[1:] if len(steps) > 1 else steps)

    def passages(self, pieces: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Vectors of the passages of WINDOW words, then of half as many, that start at every FINE-th word
        of some pieces; with each its piece and its number there."""
        # Filled up with PAD, whose row is zero, to whole steps and to the steps of one passage at least.
        sizes = np.array([-(-len(p) // FINE) for p in pieces])
        ends = np.cumsum(np.maximum(sizes, WINDOW // FINE))
        starts = np.append(0, ends[:-1])
        filled = np.full((int(ends[-1]), FINE), PAD, np.int32)
        flat = filled.reshape(-1)
        for codes, start in zip(pieces, (starts * FINE).tolist(), strict=True):
            flat[start : start + len(codes)] = codes
        steps = np.empty((len(filled) + 3, self.basis.shape[1]), self.basis.dtype)
        steps[len(filled) :] = 0
        for start in range(0, len(filled), SUM_STEPS):
            np.take(self.filled, filled[start : start + SUM_STEPS], axis=0).sum(1, out=steps[start : min(start + SUM_STEPS, len(filled))])
        half = steps[:-1] + steps[1:]
        for made, lost in ((half[:-2] + half[2:], 3), (half, 1)):
            counts = np.maximum(sizes - lost, 1)
            piece = np.repeat(np.arange(len(pieces)), counts)
            number = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield unit(made[starts[piece] + number]), piece, number


def background(docs: DataFrame) -> tuple[np.ndarray, DataFrame, float]:
    """Weights of the buckets over all texts, the steps of all texts, and their number; the same for all blocks."""
    steps = durable(docs.select("text").mapInArrow(step_rows, STEPS))
    totals = summed(steps.mapInArrow(passage_counts, PARTIALS), (BUCKETS + 1,))
    number = max(float(totals[BUCKETS]), 1.0)
    return np.log((number + 1) / (totals[:BUCKETS].astype(np.float64) + 0.5)).clip(0) ** 2, steps, number


def fit(idf: np.ndarray, steps: DataFrame, number: float, items: list[list[np.ndarray]], fit_passages: int = FIT_PASSAGES) -> Space:
    """Latent space from the windows of a block of items and all passages of the corpus."""
    own, rank = [g for windows_of in items for g in windows_of], max(RANK, len(items) // RANK_ITEMS)
    basis = np.linalg.qr(np.random.default_rng(23).standard_normal((BUCKETS, rank + EXTRA)))[0]
    context = steps.sparkSession.sparkContext
    # A task gives a whole array, so small shares are read together.
    shares = steps.coalesce(max(context.defaultParallelism, int(number) // TASK_STEPS))
    for _ in range(POWER + 1):
        sent = context.broadcast((np.append(idf, 0), np.append(basis * idf[:, None], np.zeros((1, basis.shape[1])), axis=0).astype(np.float32)))

        def times(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            weights, right = sent.value
            total = np.zeros(right.shape)
            for codes, roles in read_steps(batches):
                add_gram_of_steps(total, codes, roles, weights, right)
            yield from partial_rows(total[:BUCKETS], TaskContext.get().partitionId())

        product = summed(shares.mapInArrow(times, PARTIALS), basis.shape).astype(np.float64) * min(1.0, fit_passages / number)
        product += ITEM_WEIGHT * gram_times(own, idf, basis)
        last, basis = basis, np.linalg.qr(product)[0]
    # Right singular vectors from the small problem in the subspace found.
    values, turn = np.linalg.eigh(last.T @ product)
    basis = np.linalg.qr(product)[0] if not np.isfinite(values).all() else last @ turn[:, np.argsort(-values)[:rank]]
    return Space((basis * idf[:, None]).astype(np.float32))


def common_length(item: list[str], words: list[str]) -> int:
    """Length of the longest common subsequence of two lists of words, a bit for each word of `item`."""
    places: dict[str, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    state = full
    for w in words:
        hit = state & places.get(w, 0)
        state = (state + hit | state - hit) & full
    return len(item) - state.bit_count()


@dataclass(frozen=True)
class Items:
    """The benchmark: ids, words, windows' vectors and answers."""

    ids: list[int]
    words: list[list[str]]
    answers: list[list[str]]
    vectors: np.ndarray
    owner: np.ndarray


def in_groups(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Where runs of pieces start and end that hold `most` words together, or one piece."""
    start, total = 0, 0
    for k, length in enumerate(lengths):
        if total + length > most and k > start:
            yield start, k
            start, total = k, 0
        total += length
    if start < len(lengths):
        yield start, len(lengths)


def most_common(item: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> int:
    """No common subsequence is longer: how many words of an item (codes in order, counts) occur among `codes`."""
    kinds, counts = item
    place = np.minimum(np.searchsorted(kinds, codes), len(kinds) - 1)
    return int(np.minimum(np.bincount(place[kinds[place] == codes], minlength=len(kinds)), counts).sum())


def answer_of(words: list[str], weight: np.ndarray) -> list[str]:
    """The item's last words that carry weight, in order: what a paraphrase cannot do without."""
    heavy = [w for w in words if weight[bucket(w, BUCKETS)] > 0]
    return heavy[-ANSWER_WORDS:]


def verdict(item: list[str], answer: list[str], words: list[str]) -> tuple[bool, float, bool]:
    """(leaked, share of the item on the common subsequence, answer found)."""
    share = common_length(item, words) / len(item)
    has_answer = common_length(answer, words) * 3 >= len(answer) * 2
    return share >= LCS_SHARE or share >= PARAPHRASE_SHARE and has_answer, share, has_answer


HITS = "doc_id BIGINT, item_id BIGINT, position INT, cosine DOUBLE, lcs_share DOUBLE, has_answer BOOLEAN"


def search(texts: DataFrame, space: Space, items: Items, cosine: float = COSINE) -> DataFrame:
    """Leaks (HITS): the best place of each item in each document that holds it."""
    sent = texts.sparkSession.sparkContext.broadcast((space, items))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, items = sent.value
        short = np.array([len(items.words[k]) < WINDOW for k in items.owner], bool)
        sides = [(np.ascontiguousarray(items.vectors[of].T), items.owner[of]) for of in (np.ones(len(short), bool), short)]
        kinds_of = [np.unique([bucket(w, BUCKETS) for w in words], return_counts=True) for words in items.words]
        for batch in slices(batches):
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            whole, words = word_codes(texts), {}
            cut = [(doc, k * PIECE, piece) for doc, codes in enumerate(whole) for k, piece in enumerate(passages(codes)) if len(piece)]
            best: dict[tuple[int, int], tuple] = {}
            for one, end in in_groups([len(piece) for *_, piece in cut], PIECE):
                pairs: dict[tuple[int, int, int], float] = {}
                for (vectors, piece, number), (across, owner) in zip(space.passages([p for *_, p in cut[one:end]]), sides, strict=True):
                    likeness = vectors @ across
                    for spot in np.flatnonzero(likeness >= cosine).tolist():
                        row, item = spot // across.shape[1], int(owner[spot % across.shape[1]])
                        key = one + int(piece[row]), int(number[row]), item
                        pairs[key] = max(pairs.get(key, 0.0), float(likeness.flat[spot]))
                for (at, window, item), near in pairs.items():
                    doc, first, _ = cut[at]
                    # The surroundings: an item may start before the passage or end after it.
                    reach, place = len(items.words[item]), first + window * FINE
                    around = slice(max(place - reach, 0), place + WINDOW + reach)
                    if most_common(kinds_of[item], whole[doc][around]) / reach < min(LCS_SHARE, PARAPHRASE_SHARE):
                        continue
                    if doc not in words:
                        words[doc] = words_of(texts[doc])
                    ok, share, answer = verdict(items.words[item], items.answers[item], words[doc][around])
                    row = (share, near, -place, answer)
                    if ok and row > best.get((doc, item), (0.0,)):
                        best[doc, item] = row
            found = [(ids[doc], items.ids[i], -p, c, s, a) for (doc, i), (s, c, p, a) in sorted(best.items())]
            columns = list(zip(*found, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split(" ")[0] for c in HITS.split(", ")])

    return texts.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, HITS)


def leaks(docs: DataFrame, benchmark: DataFrame, fit_passages: int = FIT_PASSAGES, cosine: float = COSINE) -> DataFrame:
    """One row for each document and benchmark item that it holds, whole or paraphrased."""
    rows = benchmark.select(F.col("item_id").cast("bigint"), "text").filter("text IS NOT NULL")
    # The benchmark is read in blocks of MAX_ITEMS items, so what is sent to tasks is bounded.
    ordered = rows.filter("item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator()
    found, block, known = None, [], None

    def finish(block: list, known: tuple | None) -> tuple[DataFrame | None, tuple | None]:
        words, coded = [words_of(t) for _, t in block], word_codes([t for _, t in block])
        kept = [k for k, w in enumerate(words) if w]
        if not kept:
            return None, known
        groups = [[g for codes in passages(coded[k]) for g in windows(codes)] for k in kept]
        known = known or background(docs)
        space = fit(*known, groups, fit_passages)
        vectors = [np.concatenate([space.project(c) for c in passages(coded[k])]) for k in kept]
        weight = np.linalg.norm(space.basis, axis=1)
        heavy = np.where(weight > np.median(weight[weight > 0]) if (weight > 0).any() else weight > 0, weight, 0)
        made = Items(
            [block[k][0] for k in kept], [words[k] for k in kept], [answer_of(words[k], heavy) or words[k][-ANSWER_WORDS:] for k in kept],
            np.concatenate(vectors).astype(np.float32), np.repeat(np.arange(len(kept)), [len(v) for v in vectors]))
        return search(docs, space, made, cosine), known

    for row in ordered:
        block.append((row["item_id"], row["text"]))
        if len(block) == MAX_ITEMS:
            more, known = finish(block, known)
            found, block = (found.union(more) if found is not None and more is not None else more or found), []
    more, known = finish(block, known)
    found = found.union(more) if found is not None and more is not None else more or found
    return found if found is not None else docs.sparkSession.createDataFrame([], HITS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without those that hold a benchmark item."""
    dirty = durable(leaks(docs, benchmark).select("doc_id").distinct())
    return docs.join(dirty, "doc_id", "left_anti").select(*docs.columns)
