"""Best-fit packing by bin completion.

Every document becomes its token ids and an end token; only documents of more than ``room`` tokens are cut, into
pieces of ``room`` tokens after a first piece that holds the remainder. Lengths are whole numbers up to ``room``, so
that the problem is the histogram of lengths, whose size doesn't grow with the data. It is solved on the
driver: best fit decreasing gives the first incumbent; if that needs more bins than a lower bound (``least_bins``), the fractional packing
that column generation finds gives whole bins, and bin completion packs the rest: a branch-and-bound of limited discrepancy fills the bin of
the largest length left, with the fillings of least waste for each largest filler or with fewer copies of the first, and prunes by the bound. If
the best is still above the bound, bin completion runs over all lengths too. Equal bins are handled as one pattern with a number of copies.

The two have budgets of steps (``NODES``) and rounds (``ROUNDS``): with up to 1,024 lengths in any number the exact answer is out of reach of any
bounded time, so a packing may stay above the bound. It is then the best of the three found; ``least_bins`` and ``pack`` tell the gap.

Spark then gives each piece its rank among pieces of its length (a running count over hash chunks, so that no task
holds all pieces of one length) and looks up the bin, place and offset of that rank in the table of patterns.

Nulls and edge cases: a null or empty text is a piece with the end token alone; rows with a null doc_id take no
part; repeated rows are packed each. Extra columns are ignored. An empty table gives no rows."""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe_trie import Bpe, vocabulary
from lodestone.llm.shared import Slice, map_slices, partitions, table

ROOM, END, NODES, WIDTH, TURNS, ROUNDS, COLUMNS = 1024, 2, 1_000, 6, 8, 160, 200
Pattern = tuple[int, ...]


def best_fit(lengths: dict[int, int], room: int) -> Counter[Pattern]:
    """Best fit decreasing over a histogram: each piece goes to the fullest open bin that takes it."""
    done: Counter[Pattern] = Counter()
    open_bins: dict[int, Counter[Pattern]] = {}
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            fits = [r for r in open_bins if r >= length]
            if fits:
                r = min(fits)
                pattern, n = next(iter(open_bins[r].items()))
                used, put = min(n, left), 1
                open_bins[r][pattern] -= used
                if not open_bins[r][pattern]:
                    del open_bins[r][pattern]
                if not open_bins[r]:
                    del open_bins[r]
                left -= used
                pattern, r = (*pattern, length), r - length
            else:
                put = min(room // length, left)
                used, left = left // put, left % put
                pattern, r = (length,) * put, room - put * length
            if r:
                open_bins.setdefault(r, Counter())[pattern] += used
            else:
                done[pattern] += used
    for group in open_bins.values():
        done.update(group)
    return done


def copies_of(sums: int, size: int, n: int) -> int:
    """The sums (bit i for i) that up to ``n`` more pieces of a size make."""
    step = 1
    while n > 0:
        sums |= sums << size * min(step, n)
        n, step = n - step, 2 * step
    return sums


def completions(gap: int, lengths: dict[int, int], most: int) -> list[Pattern]:
    """Fillings of a gap, least waste first: for each piece that may be a filling's largest, one of the largest sum. All sums of the pieces
    from each size down are known as bits, so that no filling is missed for want of steps; of fillings of one sum those of larger pieces go first."""
    sizes = sorted((x for x, n in lengths.items() if n and x <= gap), reverse=True)
    sums, below = 1, [1]  # below[-1 - k]: sums of the pieces smaller than sizes[k - 1]
    found = []
    for k in range(len(sizes) - 1, -1, -1):
        size = sizes[k]
        more = copies_of(sums, size, min(lengths[size], gap // size) - 1) & ((1 << gap - size + 1) - 1)
        found.append((gap - size - (more.bit_length() - 1), k))
        sums = copies_of(sums, size, min(lengths[size], gap // size)) & ((1 << gap + 1) - 1)
        below.append(sums)
    below.reverse()  # below[k]: sums of sizes[k:]
    out = []
    for waste, k in sorted(found)[:most]:
        left, chosen = gap - waste - sizes[k], [sizes[k]]
        for j in range(k, len(sizes)):
            n = min(lengths[sizes[j]] - (j == k), left // sizes[j])
            while not below[j + 1] >> left - n * sizes[j] & 1:
                n -= 1
            chosen += [sizes[j]] * n
            left -= n * sizes[j]
        out.append(tuple(chosen))
    return out or [()]


def least_bins(lengths: dict[int, int], room: int) -> int:
    """A lower bound on bins: pieces of over half a bin share none, and what they leave takes only pieces that fit (Martello and Toth's L2)."""
    n = np.zeros(room + 1, np.int64)
    for x, m in lengths.items():
        n[x] = m
    number, weight = np.cumsum(n), np.cumsum(n * np.arange(room + 1))
    half = room // 2
    k = np.arange(1, half + 1)
    alone, wide = number[room] - number[room - k], number[room - k] - number[half]
    rest = weight[half] - weight[k - 1] - (wide * room - (weight[room - k] - weight[half]))
    return max(-(-int(weight[room]) // room), int((alone + wide + np.maximum(0, -(-rest // room))).max(initial=0)))


def _most_worth(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to ``room``: the most that pieces in it are worth, and the place of a size that such a filling holds (-1: none of its own)."""
    value, last = np.zeros(room + 1), np.full(room + 1, -1)
    fit = np.searchsorted(sizes, np.arange(room + 1), "right")
    for r in range(int(sizes[0]), room + 1):
        worth = value[r - sizes[: fit[r]]] + prices[: fit[r]]
        j = int(worth.argmax())
        value[r], last[r] = (worth[j], j) if worth[j] > value[r - 1] else (value[r - 1], -1)
    return value, last


def _filled(sizes: np.ndarray, last: np.ndarray, room: int, first: int) -> np.ndarray:
    """The pattern (pieces of each size) of ``first`` and the pieces of most worth in the room that it leaves."""
    column = np.zeros(len(sizes))
    column[first] = 1
    r = room - int(sizes[first])
    while r > 0:
        j = last[r]
        column[j] += j >= 0
        r -= int(sizes[j]) if j >= 0 else 1
    return column


def relaxed(lengths: dict[int, int], room: int, start: Iterable[Pattern] = (), rounds: int = ROUNDS) -> tuple[Counter[Pattern], int]:
    """The whole bins of a fractional packing, and a lower bound on bins, by column generation (Gilmore and Gomory), which begins with the
    patterns of ``start``: an exact knapsack at the prices of the patterns so far gives, for each size, the best pattern that holds it; those worth more
    than a bin enter. Prices are smoothed towards those of the best bound while that still finds patterns (Wentges, 1997)."""
    sizes = np.array(sorted(lengths))
    need = np.array([lengths[int(x)] for x in sizes], float)
    at = {int(x): i for i, x in enumerate(sizes)}
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    amount, bound, anchor, smooth, steps = inverse @ need, 0.0, None, 0.7, 0

    def enter(pool: np.ndarray) -> None:
        nonlocal inverse, amount, steps
        used = np.zeros(len(pool), bool)  # each enters once, so that steps which change nothing can't go round
        while len(pool):
            worth = np.where(used, 0, pool @ inverse.sum(axis=0))
            k = int(worth.argmax())
            if worth[k] <= 1 + 1e-7:
                return
            used[k] = True
            entering = inverse @ pool[k]
            ratio = np.where(entering > 1e-5, amount / np.where(entering > 1e-5, entering, 1), np.inf)
            step = ratio.min()
            out = int(np.where(ratio <= step + 1e-9, entering, -1).argmax())
            row = inverse[out] / entering[out]
            inverse -= np.outer(entering, row)
            inverse[out] = row
            amount = np.maximum(amount - step * entering, 0)
            amount[out] = step
            basis[:, out] = pool[k]
            steps += 1
            if steps % 500 == 0:  # rounding errors grow with every step
                inverse = np.linalg.inv(basis)
                amount = np.maximum(inverse @ need, 0)

    first = np.zeros((0, len(sizes)))
    if start := list(start):
        first = np.zeros((len(start), len(sizes)))
        for k, pattern in enumerate(start):
            np.add.at(first[k], [at[x] for x in pattern], 1)
    try:
        enter(first)
        for _ in range(rounds):
            prices = np.maximum(inverse.sum(axis=0), 0)
            asked = prices if anchor is None else smooth * anchor + (1 - smooth) * prices
            value, last = _most_worth(sizes, asked, room)
            found = asked @ need / max(value[room], 1)
            if found > bound:
                bound, anchor = found, asked / max(value[room], 1)
            if np.ceil(bound - 1e-6) >= amount.sum():
                break
            best = np.argsort(-(asked + value[room - sizes]), kind="stable")[:COLUMNS]
            columns = np.array([_filled(sizes, last, room, int(f)) for f in best])
            columns = columns[columns @ prices > 1 + 1e-7]
            if len(columns):
                enter(columns)
            elif smooth == 0:
                break
            else:
                smooth = smooth / 2 if smooth > 0.05 else 0.0
    except np.linalg.LinAlgError:  # the basis can't be inverted anew; what it holds is checked against the pieces below
        pass
    whole: Counter[Pattern] = Counter()
    left = need.copy()
    amount = np.where(np.isfinite(amount), amount, 0)
    for k, n in enumerate(np.floor(np.maximum(amount, 0) + 1e-7)):
        used = basis[:, k] > 0
        if (n := int(min(n, (left[used] // basis[used, k]).min()))) > 0:
            left -= n * basis[:, k]
            whole[tuple(int(x) for x, c in zip(sizes[::-1], basis[::-1, k], strict=True) for _ in range(int(c)))] += n
    return whole, int(np.ceil(bound - 1e-6))


def pack(lengths: dict[int, int], room: int = ROOM, nodes: int = NODES) -> Counter[Pattern]:
    """Patterns (lengths in a bin) and the number of bins with each: best fit's, or better ones that the fractional packing or a search of
    ``nodes`` steps finds. All pieces are packed whatever the budgets are. Pieces that leave no room for another one are bins of their own."""
    lengths = {x: n for x, n in lengths.items() if n}
    alone = {x: n for x, n in lengths.items() if x + min(lengths) > room}
    lengths = {x: n for x, n in lengths.items() if x not in alone}
    done: Counter[Pattern] = Counter({(x,): n for x, n in alone.items()})
    bins = lambda packing: sum(packing.values())
    best, least = best_fit(lengths, room), least_bins(lengths, room)
    if bins(best) > least:
        whole, bound = relaxed(lengths, room, best)
        least, left = max(least, bound), Counter(lengths)
        for pattern, n in whole.items():
            for x in pattern:
                left[x] -= n
        rest = {x: n for x, n in left.items() if n}
        best = min(best, whole + searched(rest, room, nodes, least_bins(rest, room)), key=bins)
    if bins(best) > least:
        best = min(best, searched(lengths, room, nodes, least), key=bins)
    return done + best


def searched(lengths: dict[int, int], room: int, nodes: int, least: int) -> Counter[Pattern]:
    """Best fit's packing, or a better one found within ``nodes`` steps."""
    best, budget = best_fit(lengths, room), nodes

    def go(left: dict[int, int], chosen: list[tuple[Pattern, int]], bins: int, turns: int) -> None:
        """``turns``: how often the search may still leave the first choice; it does so near the root first."""
        nonlocal best, budget
        if budget <= 0 or bins + least_bins(left, room) >= sum(best.values()):  # no better packing from here
            return
        if not left:
            best = Counter()
            for pattern, n in chosen:
                best[pattern] += n
            return
        budget -= 1
        largest = max(left)
        others = {x: n - (x == largest) for x, n in left.items()}
        choices = []
        for fill in completions(room - largest, others, WIDTH if turns else 1):
            pattern = (largest, *fill)
            choices.append((pattern, min(left[x] // n for x, n in Counter(pattern).items())))
        pattern, copies = choices[0]
        choices += [(pattern, n) for n in sorted({copies // 2, copies // 4, 1} - {0, copies}, reverse=True)] if turns else []
        for k, (pattern, copies) in [*enumerate(choices)][1:] + [(0, choices[0])]:
            need = Counter(pattern)
            after = {x: m for x, n in left.items() if (m := n - copies * need[x])}
            go(after, [*chosen, (pattern, copies)], bins + copies, turns - (k > 0))
            if sum(best.values()) == least or budget <= 0:
                return

    if sum(best.values()) > least:
        deep = sys.getrecursionlimit()
        sys.setrecursionlimit(deep + 8 * room)  # one level down for each pattern: at most one a length, and one for each turn
        try:
            for turns in range(TURNS):
                go(lengths, [], 0, turns)
        finally:
            sys.setrecursionlimit(deep)
    return best


class LibraryBpe(Bpe):
    """Encodes the words that a worker meets first by the tiktoken library, from the same vocabulary."""

    def __init__(self, text: str):
        super().__init__(text)
        self.library = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={})

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        return [self.library.encode_ordinary(w.decode()) for w in words]


_known: dict[int, LibraryBpe] = {}


def pieces(docs: DataFrame, path: str, room: int = ROOM, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    sent = vocabulary(docs, path)

    def make():
        text = sent.value
        if (key := hash(text)) not in _known:
            _known.clear()
            _known[key] = LibraryBpe(text)
        bpe = _known[key]

        def each(part: Slice) -> pa.RecordBatch:
            ids, offsets = bpe.encode(part)
            n = np.diff(offsets) + 1
            cuts = -(-n // room)
            doc = np.repeat(np.arange(len(part)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            head = (n - 1) % room + 1  # the first piece's length
            start = np.where(piece > 0, head[doc] + (piece - 1) * room, 0)
            length = np.where(piece > 0, room, head[doc])
            with_end = np.insert(ids, offsets[1:], end).astype("<u4").tobytes()
            at = ((offsets[:-1] + np.arange(len(part)))[doc] + start) * 4
            crc = [zlib.crc32(with_end[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part.ids[doc]), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return each

    return map_slices(docs, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, room: int = ROOM) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut`` must be a table that can be read again."""
    spark = cut.sparkSession
    found = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most room rows
    rows, first = [], 0
    seen: Counter[int] = Counter()
    for pattern, copies in pack(found, room).items():
        offset = 0
        for length, n in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, seen[length], seen[length] + copies * n, n, first, offset))
            seen[length] += copies * n
            offset += length * n
        first += copies
    patterns = spark.createDataFrame(rows, "of long, low long, high long, each long, first long, at long")  # bounded by room, not by the data
    ranked = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(16 * partitions(spark))))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("length", "chunk").agg(F.count("*").alias("n")).select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = ranked.withColumn("rank", F.row_number().over(own) - 1).join(counts, ["length", "chunk"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(patterns), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    slot = F.col("rank") - F.col("low")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(slot / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + slot % F.col("each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str, room: int = ROOM, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return place(table(pieces(docs, path, room, end), "pieces"), room)
