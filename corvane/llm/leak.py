"""Problem 8: documents that hold passages of held-out evaluation items.

Latent semantic retrieval over whole texts, in two passes over the corpus, however many items there are:

1. *Range pass.* Every text is cut into blocks of BLOCK words; two neighbouring blocks are a passage. Tasks add up, for
   all passages, the word counts and ``A' (A Omega)`` of the passage-term matrix A, with a random test matrix Omega. The
   sums (terms x RANK) are all that leaves a task. The driver turns them into the right singular vectors of the TF-IDF
   matrix (single-pass Nystroem form of the randomised SVD: with TF-IDF weights W the product is
   ``(W A' A W) (W^-1 Omega) = W (A' A Omega)``, so weights need no pass of their own).
2. *Search pass.* Passages are projected and compared by cosine with all windows of all items (a matrix product). A
   passage is a candidate where the cosine is high, or where it is fair and some of the item's own trigrams stand there
   too. Candidates are verified by the longest common subsequence of the item and the place in the text, by words and by
   IDF weight: much of the item in order is enough (a paraphrase that replaced every third word holds no trigram, but two
   thirds of the words); less is enough where the item's own trigrams are held too, and still less where the item's answer
   stands beside the place.

Terms are the words of the items: other words can't add to a similarity with an item; in passages they count as one
unknown term of full weight. Texts are read whole, every document is scored against every item, and no list of
candidates is capped. The items are the small side by definition (a test set); more than MAX_ITEMS go to the tasks as
several indexes, which the same pass works off one after another.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import tokens
from corvane.session import ship

BLOCK, STEP = 24, 12  # words in a block; distance of an item's windows of 2 * BLOCK words
RANK = 128
MAX_ITEMS = 5000  # items of one index
COSINE, CLOSE = 0.5, 0.68  # least cosine of a candidate passage with and without trigrams of the item
RUNS = 6  # number of the item's own trigrams in a candidate passage of fair cosine (fewer for items that have few)
HELD, HELD_ANSWERED = 0.3, 0.25  # least share of the item's own trigrams that the place holds
COVER, COVER_ANSWERED = 0.4, 0.35  # beside these: least share of the item, by weight and by number of words, in the common subsequence
ALONE, ALONE_ANSWERED = 0.58, 0.5  # the same without regard to trigrams
PART = 0.15  # share of the own trigrams from which a place is reported as a part
COMMON = 3  # sentences that so many items share are instructions


def passages(items: list[tuple[int, str | None]]) -> list[tuple[int, str]]:
    """The items' texts without sentences that COMMON or more items share; empty ones are left out."""
    split = {i: [s for s in re.split(r"(?<=[.!?])\s+", t or "") if s.strip()] for i, t in items}
    seen = Counter(s for ss in split.values() for s in set(ss))
    out = [(i, " ".join(s for s in ss if seen[s] < COMMON)) for i, ss in split.items()]
    return [(i, t) for i, t in out if t.strip()]


def trigrams(h: np.ndarray) -> np.ndarray:
    """Hashes of three words in a row, at the first one's place; two shorter than the words."""
    if len(h) < 3:
        return np.empty(0, dtype=np.uint64)
    a, b, c = h[:-2], h[1:-1], h[2:]
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + (c << np.uint64(7)) + (c >> np.uint64(3)))
    return x * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """What tasks need of the items: terms, windows and answers; after ``fit``, the latent space."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], terms: np.ndarray | None = None, common: np.ndarray | None = None):
        kept = passages([(i, t) for i, t, _ in items]) if terms is None else [(i, t) for i, t, _ in items if t]
        answers = {i: a for i, _, a in items}
        self.ids = [i for i, _ in kept]
        self.answers = [re.sub(r"\W+", " ", (answers[i] or "").lower()).strip() for i in self.ids]
        w = tokens.words_of([t for _, t in kept])
        self.terms = np.unique(w.hash) if terms is None else terms
        self.width = len(self.terms)
        self.lookup: np.ndarray | None = None
        self.sequences = [self.term_ids(w.hash[w.first[k] : w.first[k + 1]]) for k in range(len(self.ids))]
        own = np.bincount(np.concatenate([*self.sequences, np.empty(0, np.int64)]).astype(np.int64), minlength=self.width + 1)[: self.width]
        #: weights of the test matrix: a first guess at IDF, from the items alone
        self.prior = (1 / np.sqrt(np.maximum(own, 1.0))).astype(np.float32)
        # trigrams that fewer than COMMON items have: what makes an item an item
        grams = [np.unique(trigrams(w.hash[w.first[k] : w.first[k + 1]])) for k in range(len(self.ids))]
        every, n = np.unique(np.concatenate([*grams, np.empty(0, np.uint64)]), return_counts=True)
        self.common = every[n >= COMMON] if common is None else common
        grams = [g[~np.isin(g, self.common)] for g in grams]
        self.own = np.array([max(1, len(g)) for g in grams], dtype=np.int64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        flat = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.grams, self.gram_owner = flat[order], owner[order]
        self.marked = np.zeros(1 << 22, dtype=bool)
        self.marked[(flat >> np.uint64(42)).astype(np.int64)] = True

    def parts(self, items: list[tuple[int, str | None, str | None]]) -> list[Index]:
        """The fitted index as one of each MAX_ITEMS items; all share its terms, weights and latent space."""
        if len(self.ids) <= MAX_ITEMS:
            return [self]
        answers = {i: a for i, _, a in items}
        kept = [(i, t, answers[i]) for i, t in passages([(i, t) for i, t, _ in items])]
        out = []
        for a in range(0, len(kept), MAX_ITEMS):
            part = Index(kept[a : a + MAX_ITEMS], self.terms, self.common)
            part.idf, part.unknown, part.project, part.weights = self.idf, self.unknown, self.project, self.weights
            part.make_windows()
            out.append(part)
        return out

    def owned(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place), sorted, of every place where an item's own trigram stands."""
        at = np.flatnonzero(self.marked[(gram >> np.uint64(42)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.grams, gram[at], side=side) for side in ("left", "right"))
        n = hi - lo
        place = np.repeat(at, n)
        item = self.gram_owner[np.repeat(lo, n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)] if len(place) else np.empty(0, np.int64)
        order = np.lexsort((place, item))
        return item[order], place[order]

    def term_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the items' terms; all other words have the id ``width``."""
        if not len(self.terms):
            return np.full(len(hashes), self.width, dtype=np.int64)
        bits = np.uint64(0xFFFF)
        if getattr(self, "lookup", None) is None:  # first term with these low 16 bits; most words are settled by it
            order = np.argsort(self.terms & bits, kind="stable")
            self.order, self.low = order, (self.terms & bits)[order]
            self.lookup = np.searchsorted(self.low, np.arange(1 << 16))
        out = np.full(len(hashes), self.width, dtype=np.int64)
        at = self.lookup[(hashes & bits).astype(np.int64)]
        open_ = np.arange(len(hashes))
        while len(open_):
            at_ = at[open_]
            ok = at_ < len(self.order)
            open_, at_ = open_[ok], at_[ok]
            same = self.low[at_] == (hashes[open_] & bits)
            open_, at_ = open_[same], at_[same]
            hit = self.terms[self.order[at_]] == hashes[open_]
            out[open_[hit]] = self.order[at_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
        return out

    def bound(self, item: int, place: np.ndarray) -> float:
        """Upper bound of the share of the item's weight in a common subsequence: the words that both have."""
        s = self.sequences[item]
        mine, theirs = np.bincount(s, minlength=self.width + 1), np.bincount(place, minlength=self.width + 1)
        return float((np.minimum(mine, theirs)[: self.width] * self.weights[: self.width]).sum() / self.weights[s].sum())

    def omega(self) -> np.ndarray:
        return np.random.default_rng(20).standard_normal((self.width, min(RANK, self.width))).astype(np.float32) * self.prior[:, None]

    def fit(self, counts: np.ndarray, n: int, gram: np.ndarray) -> None:
        """The latent space from the corpus' sums: counts of terms, number of blocks, and A' A Omega."""
        self.idf = np.log((n + 2) / (counts + 1.0)).clip(0.05).astype(np.float32)
        self.unknown = np.float32(np.median(self.idf))
        omega = self.omega().astype(np.float64)
        y = self.idf[:, None] * gram
        shift = 1e-7 * (np.linalg.norm(y) + 1e-12)
        y += shift * omega / self.idf[:, None]
        core = (omega / self.idf[:, None]).T @ y
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        good = values > values.max(initial=0) * 1e-9
        root = y @ (vectors[:, good] / np.sqrt(values[good]))
        u, _, _ = np.linalg.svd(root, full_matrices=False)
        self.project = np.vstack([self.idf[:, None] * u, np.zeros((1, u.shape[1]))]).astype(np.float32)
        self.weights = np.append(self.idf, self.unknown).astype(np.float32)
        self.make_windows()

    def make_windows(self) -> None:
        """The items' windows in the latent space, and the least cosine of each with and without trigrams.

        A window of an item that is shorter than a passage fills only a part of it, so its cosine can't be high.
        """
        vecs, owners, sizes = [], [], []
        for k, s in enumerate(self.sequences):
            for a in range(0, max(1, len(s) - 2 * BLOCK + STEP), STEP):
                v = self.project[s[a : a + 2 * BLOCK]].sum(axis=0)
                vecs.append(v / max(1e-9, float(np.linalg.norm(v))))
                owners.append(k)
                sizes.append(min(len(s), 2 * BLOCK))
        rank = self.project.shape[1]
        self.windows, self.owners = np.array(vecs, dtype=np.float32).reshape(-1, rank), np.array(owners, dtype=np.int64)
        room = np.array(sizes, dtype=np.float32) / (2 * BLOCK)
        self.fair = (COSINE * np.where(room < 0.75, 0.5 * np.sqrt(room), 1)).astype(np.float32)
        self.close = np.where(room < 0.75, 2, CLOSE).astype(np.float32)


def _blocks(ids: np.ndarray, first: np.ndarray, filler: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as rows of BLOCK term ids, padded with ``filler``: (blocks, text of each, first word of each)."""
    n = np.diff(first)
    per = -(-n // BLOCK)
    text = np.repeat(np.arange(len(n)), per)
    place = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = first[:-1][text] + place * BLOCK
    at = start[:, None] + np.arange(BLOCK)
    inside = at < first[1:][text][:, None]
    return np.where(inside, ids[np.minimum(at, max(0, len(ids) - 1))] if len(ids) else filler, filler), text, start


def _pairs(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each block's row plus that of the next block of the same text."""
    out = x.copy()
    same = text[1:] == text[:-1]
    out[:-1][same] += x[1:][same]
    return out


def range_sums(index: Index, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, int, np.ndarray]:
    """(counts of terms, number of blocks, A' A Omega) over texts."""
    omega, width = index.omega(), index.width
    counts, n, gram = np.zeros(width), 0, np.zeros((width, omega.shape[1]))
    padded = np.vstack([omega, np.zeros((1, omega.shape[1]), dtype=np.float32)])
    narrow = width < 4096  # a dense product is faster for few terms, sums over sorted words for many
    slab = max(256, (8 << 20) // (width + 1)) if narrow else 1 << 14
    for batch in batches:
        for _, _, w in tokens.pieces(batch.column(0)):
            blocks, text, _ = _blocks(index.term_ids(w.hash), w.first, width)
            for a in range(0, len(blocks), slab):
                part, owner = blocks[a : a + slab], text[a : a + slab]
                z = padded[part[:, 0]].copy()
                for k in range(1, BLOCK):
                    z += padded[part[:, k]]
                z = _pairs(z, owner)  # A Omega, a row a passage
                back = z.copy()  # a block is in its own passage and in the one before
                same = owner[1:] == owner[:-1]
                back[1:][same] += z[:-1][same]
                n += len(part)
                if not narrow:
                    order = np.argsort(part.ravel(), kind="stable")
                    term = part.ravel()[order]
                    known = np.searchsorted(term, width)
                    order, term = order[:known] // BLOCK, term[:known]
                    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if known else np.empty(0, np.int64)
                    counts[term[first]] += np.diff(np.append(first, known))
                    for lo in range(0, len(first), 1024):  # bounded pieces of the words in order of their terms
                        a_, b_ = first[lo], first[lo + 1024] if lo + 1024 < len(first) else known
                        gram[term[first[lo : lo + 1024]]] += np.add.reduceat(back[order[a_:b_]], first[lo : lo + 1024] - a_, axis=0)
                    continue
                dense = np.zeros((len(part), width + 1), dtype=np.float32)
                np.add.at(dense.ravel(), (np.arange(len(part))[:, None] * (width + 1) + part).ravel(), np.float32(1))
                dense = dense[:, :width]
                counts += dense.sum(axis=0)
                gram += dense.T @ back
    return counts, n, gram


def _subsequence(items: list[np.ndarray], places: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, number of words) of the heaviest common subsequence of each item with its place, all pairs at once."""
    n, wide, longest = len(places), max(len(a) for a in items), max(len(p) for p in places)
    a, grid = np.full((n, wide), -1, dtype=np.int64), np.full((n, longest), -2, dtype=np.int64)
    for k, (x, p) in enumerate(zip(items, places, strict=True)):
        a[k, : len(x)], grid[k, : len(p)] = x, p
    wa = np.where(a >= 0, weights[a], 0).astype(np.float64)
    # weight and number travel in one figure of 52 bits: the weights, in fine steps, decide; the number rides below them
    room = float(1 << wide.bit_length())
    step_ = 2.0 ** (52 - wide.bit_length() - int(np.ceil(max(1.0, wa.sum(axis=1).max()))).bit_length())
    unit = np.round(wa * step_) * room + 1
    best = np.zeros((n, wide + 1))
    for t in range(longest):
        step = np.where(grid[:, t : t + 1] == a, best[:, :-1] + unit, 0)
        np.maximum(best[:, 1:], step, out=best[:, 1:])
        np.maximum.accumulate(best, axis=1, out=best)
    number = np.mod(best[:, -1], room)
    return (best[:, -1] - number) / room / step_, number


def scored(index: Index, array: pa.Array) -> Iterator[tuple[int, int, float, float, float, bool]]:
    """(text, item, cosine, held, share of weight, share of words, answered) of the candidates that reach ``level``."""
    width = index.width
    if not len(index.windows):
        return
    for i, _, w in tokens.pieces(array):
        ids = index.term_ids(w.hash)
        blocks, text, start = _blocks(ids, w.first, width)
        if not len(blocks):
            continue
        x = index.project[blocks[:, 0]].copy()
        for k in range(1, BLOCK):
            x += index.project[blocks[:, k]]
        x = _pairs(x, text)
        x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
        gram = np.zeros(len(ids), dtype=np.uint64)
        gram[: max(0, len(ids) - 2)] = trigrams(w.hash)
        owners, places = index.owned(gram)
        keys = owners * (len(ids) + 1) + places

        def within(item: np.ndarray, lo: np.ndarray, hi: np.ndarray, keys: np.ndarray = keys, n: int = len(ids) + 1) -> np.ndarray:
            """Number of the item's own trigrams that start in words lo..hi-1."""
            return np.searchsorted(keys, item * n + hi) - np.searchsorted(keys, item * n + lo)

        found: dict[tuple[int, int], tuple[float, list[int]]] = {}
        for a in range(0, len(x), 4096):
            cos = x[a : a + 4096] @ index.windows.T
            at, win = np.nonzero(cos >= index.fair)
            if not len(at):
                continue
            item, block = index.owners[win], at + a
            runs = within(item, start[block], start[block] + 2 * BLOCK)
            near = cos[at, win]
            ok = (near >= index.close[win]) | (runs >= np.minimum(RUNS, np.maximum(1, index.own[item] // 4)))
            block, item, value = block[ok], item[ok], near[ok]
            key, pick = np.unique(block * len(index.ids) + item, return_index=True)
            block, item, value = block[pick], item[pick], value[pick]
            good = slice(None)
            for b, m, v in zip(block[good], item[good], value[good], strict=True):
                got = found.get((int(text[b]), int(m)))
                if got:
                    got[1].append(int(b))
                    if v > got[0]:
                        found[int(text[b]), int(m)] = (float(v), got[1])
                else:
                    found[int(text[b]), int(m)] = (float(v), [int(b)])
        work: list[tuple[int, int, float, np.ndarray, int, float]] = []
        for (t, m), (v, bs) in found.items():
            reach = int(1.2 * len(index.sequences[m])) + BLOCK
            last = -1
            for b in sorted(set(bs)):
                if start[b] + 2 * BLOCK <= last:
                    continue
                lo, hi = max(w.first[t], start[b] - reach // 4), min(w.first[t + 1], start[b] + reach)
                last = hi
                held = min(1.0, float(within(np.int64(m), lo, hi)) / index.own[m])
                # the common words, whatever their order, bound the common subsequence
                if held >= PART or index.bound(m, ids[lo:hi]) >= ALONE_ANSWERED:
                    work.append((t, m, v, ids[lo:hi], hi, held))
        for a in range(0, len(work), 512):
            part = work[a : a + 512]
            weight, number = _subsequence([index.sequences[p[1]] for p in part], [p[3] for p in part], index.weights)
            for (t, m, v, _, hi, held), g, c in zip(part, weight, number, strict=True):
                seq = index.sequences[m]
                g, c = float(g / index.weights[seq].sum()), float(c / len(seq))
                if held >= PART or min(g, c) >= ALONE_ANSWERED:
                    tail = w.text(max(int(w.first[t]), hi - 60), min(hi + 12, int(w.first[t + 1])) - 1)
                    said = rf"\b(answer|label|a) {re.escape(index.answers[m])}\b"
                    answered = bool(index.answers[m] and re.search(said, re.sub(r"\W+", " ", tail.lower())))
                    if level(held, g, c, answered):
                        yield i + t, m, v, held, g, c, answered


def level(held: float, weight: float, number: float, answered: bool) -> int:
    """2 where a verified place gives the item away, 1 where it holds a smaller part of it word for word, else 0."""
    cover = min(weight, number)
    if cover >= ALONE or (held >= HELD and cover >= COVER):
        return 2
    if answered and (cover >= ALONE_ANSWERED or (held >= HELD_ANSWERED and cover >= COVER_ANSWERED)):
        return 2
    return 1 if held >= PART and cover >= PART else 0


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, level, cosine, held, cover, answered): documents that hold items, or parts of them.

    One row per document and item, with the best place. level is passage where at least about two fifths of the item stand
    there, also altered or paraphrased, and part where fewer words do, but word for word. ``held`` is the share of the
    item's own trigrams there, ``cover`` the share of its words (by number or IDF weight, whichever is less) in the common
    subsequence. Null or empty texts, null keys and items of instructions only give nothing; repeated documents each give
    their rows; of an item_id that occurs twice one row counts. An empty side gives an empty result. Other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    schema = "doc_id bigint, item_id bigint, level string, cosine double, held double, cover double, answered boolean"
    rows = items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min(F.struct("text", "answer")).alias("r")).orderBy("item_id").select("item_id", "r.text", "r.answer")
    held = [(r[0], r[1], r[2]) for r in rows.collect()]
    index = Index(held)
    if not index.width:
        return spark.createDataFrame([], schema)
    _fit(index, documents)
    return _search(spark, index.parts(held), documents, schema)


def _fit(index: Index, documents: DataFrame) -> None:
    """One pass: each task returns its sums as one row of bytes; they are added pairwise by a two-level group-by."""
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, gram = range_sums(shared.value, batches)
        if n:
            # one row per slice of terms, so that the addition of the slices is spread over tasks
            cut = np.array_split(np.arange(shared.value.width), min(16, shared.value.width))
            rows = [np.hstack([counts[c, None], gram[c]]).astype(np.float32).tobytes() for c in cut]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary()), pa.array([n] * len(rows), pa.int64())], ["part", "sums", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table["sums"][0].as_py()) // 4)
        for b in table["sums"]:
            total += np.frombuffer(b.as_buffer(), dtype=np.float32)
        return pa.table({"part": table["part"].slice(0, 1), "sums": pa.array([total.astype(np.float64).tobytes()], pa.binary()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64())})

    parts = documents.select("text").where(F.length("text") > 0).mapInArrow(sums, "part int, sums binary, n bigint")
    got = {r.part: r for r in parts.groupBy("part").applyInArrow(add, "part int, sums binary, n bigint").collect()}
    wide = min(RANK, index.width) + 1
    if got:
        both = np.vstack([np.frombuffer(got[k].sums).reshape(-1, wide) for k in sorted(got)])
        index.fit(both[:, 0], got[0].n, both[:, 1:])
    else:
        index.fit(np.zeros(index.width), 0, np.zeros((index.width, wide - 1)))
    shared.unpersist()


def _search(spark, parts: list[Index], documents: DataFrame, schema: str) -> DataFrame:
    shared = [spark.sparkContext.broadcast(p) for p in parts]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, best = batch.column(0), {}
            for one in shared:
                ix = one.value
                for t, m, cos, held, weight, number, answered in scored(ix, batch.column(1)):
                    row = (level(held, weight, number, answered), held, min(weight, number), cos, answered)
                    if row > best.get((t, ix.ids[m]), (-1,)):
                        best[t, ix.ids[m]] = row
            if best:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[t].as_py() for t, _ in best], pa.int64()),
                        pa.array([m for _, m in best], pa.int64()),
                        pa.array(["passage" if r[0] == 2 else "part" for r in best.values()]),
                        *(pa.array([r[k] for r in best.values()], pa.float64()) for k in (3, 1, 2)),
                        pa.array([r[4] for r in best.values()], pa.bool_()),
                    ],
                    ["doc_id", "item_id", "level", "cosine", "held", "cover", "answered"],
                )

    rows = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(search, schema)


def leaks_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the document gives the item away, each pair once."""
    return leaks(documents, items).where("level = 'passage'").select("doc_id", "item_id").distinct()
