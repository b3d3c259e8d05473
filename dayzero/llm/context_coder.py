"""Adaptive context-mixing range coder for token ids, in blocks that are reset and checksummed one by one.

A block begins with its different ids in ascending order, each with how often it is coded by its frequency alone; ids are
then numbered by their place in this list. An id is predicted from the last one seen after the two ids before it (order 2),
after the one before it (order 1), and from the block's own frequencies (order 0). A first decision says whether the best
prediction holds: its probability is a logistic mix of three adaptive ones, by order-2 confidence, order-1 confidence and
recent hits, with weights that learn from each outcome. A second decision asks for the order-1 prediction where it is
another one. What is left is coded by the frequencies in one step. All of it drives one range coder of 64 bits that emits
words of 32.

A block knows nothing of the others, so many are coded side by side: each step codes one id of every block with array
operations, whether it writes or reads. Only whole numbers enter the state, so every machine decodes alike.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 2_048
#: Blocks that are coded side by side.
LANES = 4_096
SLOTS2 = 2_048
#: A slot holds an id's number and, in its lowest bits, how sure the prediction is.
SURE_BITS = 3
CONFIDENT = (1 << SURE_BITS) - 1
#: How sure a prediction is after it was wrong or right.
NEXT_SURE = np.array(
    [max(1, k >> 1) for k in range(CONFIDENT + 1)] + [min(k + 1, CONFIDENT) for k in range(CONFIDENT + 1)], np.uint16
)
#: Chances out of 4096 stay between these.
LOW, HIGH = 24, 4_071
PLAIN, CODED = 0, 1
#: Kind, nibbles of the largest id, checksum of a coded block's bytes, number of ids, checksum of the ids.
HEADER = struct.Struct("<BBHII")
LIST_PARTS = 4
#: Lists that are written or read together.
LISTS = 256
#: Different ids, bytes of their list, and low bits of the gaps in each of its parts.
LIST = struct.Struct("<HH4B")
#: Up to so many nibbles, ids are numbered by a table of all of them.
TABLE_NIBBLES = 5
LEAST, WORD, SCALE = np.uint64(1 << 32), np.uint64(32), np.uint64(20)
WHOLE = np.uint64((1 << 64) - 1)


def _squash_table() -> np.ndarray:
    """Logistic function of -2047..2047, scaled to 1..4095, interpolated between fixed whole values."""
    # Fixed values of the logistic function at steps of 128, times 4096.
    knots = [1, 2, 3, 6, 10, 16, 27, 45, 73, 120, 194, 310, 488, 747, 1101, 1546, 2047, 2549, 2994, 3348, 3607, 3785, 3901,
             3975, 4022, 4050, 4068, 4079, 4085, 4089, 4092, 4093, 4094]
    x = np.arange(-2047, 2048) + 2048
    low, part = x >> 7, x & 127
    knots = np.array([*knots, 4095])
    return np.clip((knots[low] * (128 - part) + knots[low + 1] * part + 64) >> 7, 1, 4095).astype(np.int32)


SQUASH = _squash_table()
#: The inverse: for each probability the least argument that reaches it.
STRETCH = np.clip(np.searchsorted(SQUASH, np.arange(4096)) - 2047, -2047, 2047).astype(np.int32)


class _Writer:
    """Range coders of all lanes. A carry goes into the words that are already out."""

    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, WHOLE)
        # No id takes more than a word: 12 bits for the first decision, 8 for the second, 11 for the frequency.
        self.most = steps + 4
        self.words = np.zeros(lanes * self.most, np.uint32)
        self.used = np.arange(lanes, dtype=np.int64) * self.most

    def _carry(self, lanes: np.ndarray) -> None:
        back = 1
        while len(lanes):
            place = self.used[lanes] - back
            self.words[place] += np.uint32(1)
            lanes, back = lanes[self.words[place] == 0], back + 1

    def decide(self, n: int, chance: np.ndarray, yes: np.ndarray) -> np.ndarray:
        """One decision in each of the first n lanes, with the chance of yes out of 4096."""
        low, width = self.low[:n], self.range[:n]
        edge = (width >> np.uint64(12)) * chance.astype(np.uint64)
        add = np.where(yes, np.uint64(0), edge)
        low += add
        self._carry(np.flatnonzero(low < add))
        width[:] = np.where(yes, edge, width - edge)
        self._flush(None, low, width)
        return yes

    def decide_some(self, lanes: np.ndarray, chance: np.ndarray, yes: np.ndarray) -> np.ndarray:
        width = self.range[lanes]
        edge = (width >> np.uint64(12)) * chance.astype(np.uint64)
        self._narrow(lanes, np.where(yes, np.uint64(0), edge), np.where(yes, edge, width - edge))
        return yes

    def code(self, lanes: np.ndarray, uses: _Uses, numbers: np.ndarray) -> None:
        """Numbers by their places among the uses."""
        unit = (self.range[lanes] >> SCALE) * uses.scale[lanes]
        start, size = uses.ends(lanes, numbers)
        self._narrow(lanes, unit * start, unit * size)

    def _narrow(self, lanes: np.ndarray, add: np.ndarray, width: np.ndarray) -> None:
        low = self.low[lanes] + add
        self._carry(lanes[low < add])
        self._flush(lanes, low, width)
        self.low[lanes], self.range[lanes] = low, width

    def _flush(self, lanes: np.ndarray | None, low: np.ndarray, width: np.ndarray) -> None:
        small = np.flatnonzero(width < LEAST)
        if len(small):
            out, own = small if lanes is None else lanes[small], low[small]
            place = self.used[out]
            self.words[place] = own >> WORD
            self.used[out] = place + 1
            low[small] = own << WORD
            width[small] <<= WORD

    def done(self) -> list[bytes]:
        """The words of each lane, up to the first that tells its range from what is around it."""
        low = self.low + (LEAST - np.uint64(1))
        self._carry(np.flatnonzero(low < self.low))
        self.words[self.used] = low >> WORD
        first = np.arange(len(low)) * self.most
        words = self.words.astype("<u4")
        return [words[a : b + 1].tobytes() for a, b in zip(first.tolist(), self.used.tolist(), strict=True)]


class _Reader:
    """Range decoders of all lanes; beyond their last words they read zeros."""

    def __init__(self, coded: list[bytes]):
        most = max(len(c) // 4 for c in coded) + 4
        words = np.zeros((len(coded), most), np.uint64)
        for i, c in enumerate(coded):
            words[i, : len(c) // 4] = np.frombuffer(c, "<u4", len(c) // 4)
        self.low = words[:, 0] << WORD | words[:, 1]  # the code less the range's start
        self.range = np.full(len(coded), WHOLE)
        self.words = words.reshape(-1)
        self.used = np.arange(len(coded), dtype=np.int64) * most + 2
        self.last = self.used + most - 3  # damaged blocks may ask for more words than there are

    def decide(self, n: int, chance: np.ndarray, yes: None = None) -> np.ndarray:
        low, width = self.low[:n], self.range[:n]
        edge = (width >> np.uint64(12)) * chance.astype(np.uint64)
        yes = low < edge
        low -= np.where(yes, np.uint64(0), edge)
        width[:] = np.where(yes, edge, width - edge)
        self._fill(None, low, width)
        return yes

    def decide_some(self, lanes: np.ndarray, chance: np.ndarray, yes: None = None) -> np.ndarray:
        low, width = self.low[lanes], self.range[lanes]
        edge = (width >> np.uint64(12)) * chance.astype(np.uint64)
        yes = low < edge
        low -= np.where(yes, np.uint64(0), edge)
        width = np.where(yes, edge, width - edge)
        self._fill(lanes, low, width)
        self.low[lanes], self.range[lanes] = low, width
        return yes

    def read(self, lanes: np.ndarray, uses: _Uses) -> np.ndarray:
        """Numbers by their places among the uses."""
        low, width = self.low[lanes], self.range[lanes]
        unit = (width >> SCALE) * uses.scale[lanes]
        got = uses.at(lanes, (low // unit).astype(np.int64))
        start, size = uses.ends(lanes, got)
        low -= unit * start
        width = unit * size
        self._fill(lanes, low, width)
        self.low[lanes], self.range[lanes] = low, width
        return got

    def _fill(self, lanes: np.ndarray | None, low: np.ndarray, width: np.ndarray) -> None:
        small = np.flatnonzero(width < LEAST)
        if len(small):
            out = small if lanes is None else lanes[small]
            place = self.used[out]
            low[small] = low[small] << WORD | self.words[np.minimum(place, self.last[out])]
            self.used[out] = place + 1
            width[small] <<= WORD


class _Uses:
    """How often each lane codes each of its numbers by frequency, and where these uses begin in a row of all of them."""

    def __init__(self, counts: np.ndarray, listed: bool):
        lanes, numbers = counts.shape
        self.width = numbers + 1
        starts = np.zeros((lanes, self.width), np.int64)
        np.cumsum(counts, axis=1, out=starts[:, 1:])
        self.total = starts[:, -1].copy()
        self.scale = ((1 << 20) // np.maximum(self.total, 1)).astype(np.uint64)
        self.starts = starts.astype(np.uint16).reshape(-1)
        if listed:
            self.row = int(self.total.max(initial=0)) + 1
            self.listed = np.zeros((lanes, self.row), np.uint16)
            self.listed[np.arange(self.row) < self.total[:, None]] = np.repeat(
                np.tile(np.arange(numbers, dtype=np.uint16), lanes), counts.reshape(-1)
            )
            self.listed = self.listed.reshape(-1)

    def at(self, lanes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The numbers that the uses at these places are of."""
        return self.listed.take(lanes * self.row + np.minimum(place, self.total[lanes] - 1)).astype(np.int64)

    def ends(self, lanes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the uses of these numbers start, and how many they are."""
        at = lanes * self.width + numbers
        start = self.starts.take(at)
        return start.astype(np.uint64), (self.starts.take(at + 1) - start).astype(np.uint64)


class _Contexts:
    """What was seen after the last one and after the last two numbers of each lane; numbers begin at 1."""

    def __init__(self, lanes: int, numbers: int):
        self.seen1 = np.zeros(lanes * numbers, np.uint16)
        self.seen2 = np.zeros(lanes * SLOTS2, np.uint16)
        self.base1 = np.arange(lanes, dtype=np.int64) * numbers
        self.base2 = np.arange(lanes, dtype=np.int64) * SLOTS2
        self.one, self.mixed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def look(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The slots of the first n lanes."""
        one = self.one[:n]
        self.at1 = self.base1[:n] + one
        at2 = one * 40_503
        at2 += self.mixed[:n]
        at2 >>= 3
        at2 &= SLOTS2 - 1
        at2 += self.base2[:n]
        self.at2 = at2
        return self.seen1.take(self.at1), self.seen2.take(at2)

    def learn(self, n: int, slots: tuple[np.ndarray, np.ndarray], out: np.ndarray) -> None:
        fresh = out.astype(np.uint16) << SURE_BITS
        for seen, at, slot in zip((self.seen1, self.seen2), (self.at1, self.at2), slots, strict=True):
            sure = slot & CONFIDENT
            old = slot - sure
            kept = np.where(sure > 1, old, fresh)
            kept += NEXT_SURE.take(sure + ((old == fresh) * np.uint16(CONFIDENT + 1)))
            seen[at] = kept
        np.multiply(self.one[:n], 30_011, out=self.mixed[:n])
        self.one[:n] = out


class _Guess:
    """The predictions of slots, for any shape of them."""

    def __init__(self, slot1: np.ndarray, slot2: np.ndarray):
        self.sure1, self.sure2 = slot1 & CONFIDENT, slot2 & CONFIDENT
        self.next1, next2 = slot1 >> SURE_BITS, slot2 >> SURE_BITS
        known = self.sure2 > 0
        agree = self.next1 == next2
        self.best = np.where(known, next2, self.next1)
        #: The places of the adaptive chances, and whether there is another prediction to ask for.
        self.place1 = self.sure1 + agree * np.uint16(CONFIDENT + 1)
        self.other = known & (self.sure1 > 0) & ~agree


class _Model:
    """The adaptive chances of all lanes."""

    def __init__(self, lanes: int):
        self.by2 = np.tile(np.array([200, 1200, 2200, 2800, 3200, 3500, 3700, 3800], np.int32), (lanes, 1)).reshape(-1)
        self.by1 = np.tile(np.array([100, 500, 900, 1400, 1800, 2200, 2600, 3000] * 2, np.int32), (lanes, 1)).reshape(-1)
        self.by0 = np.full(lanes * 4, 800, np.int32)
        self.other = np.tile(np.array([100, 400, 600, 800, 1000, 1200, 1400, 1600], np.int32), (lanes, 1)).reshape(-1)
        self.weights = [np.full(lanes, w, np.int32) for w in (30_000, 24_000, 12_000)]
        self.recent = np.zeros(lanes, np.int64)
        self.lane = np.arange(lanes, dtype=np.int64)
        self.lane4, self.lane8, self.lane16 = self.lane * 4, self.lane * 8, self.lane * 16

    def holds(self, n: int, place1: np.ndarray, sure2: np.ndarray, hit: np.ndarray | None, coder) -> np.ndarray:
        """Whether the best prediction holds, in each of the first n lanes."""
        recent = self.recent[:n]
        places = (self.lane8[:n] + sure2, self.lane16[:n] + place1, self.lane4[:n] + recent)
        tables = (self.by2, self.by1, self.by0)
        chances = [t.take(p) for t, p in zip(tables, places, strict=True)]
        votes = [STRETCH.take(c) for c in chances]
        total = self.weights[0][:n] * votes[0]
        total += self.weights[1][:n] * votes[1]
        total += self.weights[2][:n] * votes[2]
        total >>= 16
        np.maximum(total, -2047, out=total)
        np.minimum(total, 2047, out=total)
        total += 2047
        chance = SQUASH.take(total)
        hit = coder.decide(n, chance, hit)
        wrong = hit * np.int32(4095) - chance
        for w, v in zip(self.weights, votes, strict=True):
            v *= wrong
            v >>= 9
            w = w[:n]
            w += v
            np.maximum(w, -200_000, out=w)
            np.minimum(w, 200_000, out=w)
        goal = hit * np.int32(HIGH - LOW) + np.int32(LOW)
        for table, place, own, rate in zip(tables, places, chances, (4, 4, 5), strict=True):
            step = goal - own
            step >>= rate
            own += step
            table[place] = own
        recent <<= 1
        recent &= 3
        recent |= hit
        return hit

    def asked(self, lanes: np.ndarray, sure1: np.ndarray, yes: np.ndarray | None, coder) -> np.ndarray:
        place = self.lane8[lanes] + sure1
        chance = self.other[place]
        yes = coder.decide_some(lanes, chance, yes)
        self.other[place] = chance + ((yes * np.int32(HIGH - LOW) + np.int32(LOW) - chance) >> 5)
        return yes


def nibbles_for(largest: int) -> int:
    return max(4, (int(largest).bit_length() + 3) // 4)


def _at_work(lengths: np.ndarray) -> list[int]:
    """How many lanes are still at work at each step; the longest come first."""
    return np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left").tolist()


def _numbered(block: np.ndarray, nibbles: int, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of a block in ascending order, and the number of each id, from 1 on."""
    ids = np.sort(block)
    new = np.empty(len(ids), bool)
    new[:1] = True
    np.not_equal(ids[1:], ids[:-1], out=new[1:])
    ids = ids[new].astype(np.int64)
    if table is None:
        return ids, np.searchsorted(ids, block) + 1
    table[ids] = np.arange(1, len(ids) + 1, dtype=np.uint16)
    return ids, table.take(block)


def _parts(n: np.ndarray) -> np.ndarray:
    """How many ids lie in each part of lists of n ids."""
    return np.diff(n[:, None] * np.arange(LIST_PARTS + 1) // LIST_PARTS, axis=1)


def _write_lists(ids: list[np.ndarray], uses: np.ndarray) -> list[bytes]:
    """Ids as gaps in a Golomb code by parts, and their uses (of all lists in a row) in Elias' gamma code.

    The high part of each number comes in unary, then the low bits of all.
    """
    n = np.array(list(map(len, ids)))
    after = np.cumsum(n)
    together = np.concatenate(ids)
    gaps = np.diff(together, prepend=-1) - 1
    gaps[after - n] = together[after - n]
    parts = _parts(n).reshape(-1)
    sums, part_ends = np.concatenate([[0], np.cumsum(gaps)]), np.cumsum(parts)
    low = np.frexp(np.maximum((sums[part_ends] - sums[part_ends - parts]) * 0.7 / np.maximum(parts, 1), 1))[1] - 1
    values = np.stack([gaps, uses], axis=1).reshape(-1)
    widths = np.stack([np.repeat(low, parts), np.frexp(uses)[1] - 1], axis=1).reshape(-1)
    high = np.where(np.arange(len(values)) & 1, widths, values >> widths) + 1
    high_ends, low_ends = np.cumsum(high), np.cumsum(widths)
    highs, lows = (np.diff(ends[2 * after - 1], prepend=0) for ends in (high_ends, low_ends))
    sizes = (highs + lows + 7) // 8
    first = (np.cumsum(sizes) - sizes) * 8
    bits = np.zeros(int(sizes.sum()) * 8, np.uint8)
    bits[high_ends - 1 + np.repeat(first - np.cumsum(highs) + highs, 2 * n)] = 1
    place = np.arange(int(low_ends[-1])) - np.repeat(low_ends - widths, widths)
    at = np.arange(int(low_ends[-1])) + np.repeat(first + highs - np.cumsum(lows) + lows, lows)
    bits[at] = np.repeat(values, widths) >> place & 1
    coded, first = np.packbits(bits).tobytes(), (first // 8).tolist()
    heads = zip(n.tolist(), sizes.tolist(), low.reshape(-1, LIST_PARTS).tolist(), first, strict=True)
    return [LIST.pack(m, size, *own) + coded[at : at + size] for m, size, own, at in heads]


def _read_lists(coded: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], list[bytes]]:
    """Ids, uses, and the bytes after them, of each list."""
    heads = np.array([LIST.unpack_from(c) for c in coded])
    n, sizes, low = heads[:, 0], heads[:, 1], heads[:, 2:].reshape(-1)
    stops = (LIST.size + sizes).tolist()
    bits = np.frombuffer(b"".join(c[LIST.size : stop] for c, stop in zip(coded, stops, strict=True)), np.uint8)
    bits = np.unpackbits(bits).view(bool)
    first = (np.cumsum(sizes) - sizes) * 8
    ones = np.flatnonzero(bits)
    after = np.cumsum(n)
    ends = ones[np.arange(2 * after[-1]) + np.repeat(np.searchsorted(ones, first) - 2 * (after - n), 2 * n)] + 1
    starts = np.concatenate([[0], ends[:-1]])
    starts[2 * (after - n)] = first
    high = ends - starts - 1
    widths = np.stack([np.repeat(low, _parts(n).reshape(-1)), high[1::2]], axis=1).reshape(-1)
    low_ends = np.cumsum(widths)
    lows = np.diff(low_ends[2 * after - 1], prepend=0)
    total = int(low_ends[-1])
    place = np.arange(total) - np.repeat(low_ends - widths, widths)
    at = np.arange(total) + np.repeat(ends[2 * after - 1] - np.cumsum(lows) + lows, lows)
    sums = np.concatenate([[0], np.cumsum(bits[at].astype(np.int64) << place)])
    rest = sums[low_ends] - sums[low_ends - widths]
    sums = np.cumsum((high[::2] << widths[::2]) + rest[::2] + 1)
    ids = sums - 1 - np.repeat(np.concatenate([[0], sums[after[:-1] - 1]]), n)
    uses = (np.int64(1) << widths[1::2]) + rest[1::2]
    cuts = after[:-1]
    return np.split(ids, cuts), np.split(uses, cuts), [c[stop:] for c, stop in zip(coded, stops, strict=True)]


def _write_lanes(blocks: list[np.ndarray], nibbles: int) -> list[bytes]:
    """The blocks, the longest first, in coded form without their headers."""
    table = np.zeros(1 << 4 * nibbles, np.uint16) if nibbles <= TABLE_NIBBLES else None
    at_work = _at_work(np.array([len(b) for b in blocks]))
    lanes, steps = len(blocks), len(at_work)
    lists, numbers = [], np.zeros((lanes, steps), np.uint16)
    for lane, block in enumerate(blocks):
        ids, numbers[lane, : len(block)] = _numbered(block, nibbles, table)
        lists.append(ids)
    numbers = np.ascontiguousarray(numbers.T)
    most = max(map(len, lists)) + 1
    # How often numbers are left to their frequencies is known after a first pass that only follows the predictions.
    contexts, counts = _Contexts(lanes, most), np.zeros(lanes * most, np.uint16)
    place1, sure2 = np.zeros((steps, lanes), np.uint8), np.zeros((steps, lanes), np.uint8)
    hit, asked, yes = (np.zeros((steps, lanes), bool) for _ in range(3))
    for step, n in enumerate(at_work):
        out = numbers[step, :n]
        slots = contexts.look(n)
        guess = _Guess(*slots)
        contexts.learn(n, slots, out)
        place1[step, :n], sure2[step, :n] = guess.place1, guess.sure2
        hits = np.equal(guess.best, out, out=hit[step, :n])
        ask = np.greater(guess.other, hits, out=asked[step, :n])
        found = np.equal(guess.next1, out, out=yes[step, :n])
        left = np.flatnonzero(~(hits | ask & found))
        counts[left * most + out[left]] += 1
    counts = counts.reshape(lanes, most)
    uses, model, coder = _Uses(counts, False), _Model(lanes), _Writer(lanes, steps)
    for step, n in enumerate(at_work):
        left = ~model.holds(n, place1[step, :n], sure2[step, :n], hit[step, :n], coder)
        ask = np.flatnonzero(asked[step, :n])
        if len(ask):
            found = ask[model.asked(ask, place1[step][ask] & CONFIDENT, yes[step][ask], coder)]
            left[found] = False
        left = np.flatnonzero(left)
        if len(left):
            coder.code(left, uses, numbers[step][left])
    coded = []
    for first in range(0, lanes, LISTS):
        part = lists[first : first + LISTS]
        used = [counts[first + i, 1 : len(ids) + 1] for i, ids in enumerate(part)]
        coded += _write_lists(part, np.concatenate(used).astype(np.int64))
    return [a + b for a, b in zip(coded, coder.done(), strict=True)]


def _read_lanes(blocks: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    """The ids of blocks, the longest first, from what follows their headers."""
    at_work = _at_work(lengths)
    lanes, steps = len(blocks), len(at_work)
    lists, used, coded = [], [], []
    for first in range(0, lanes, LISTS):
        for out, found in zip((lists, used, coded), _read_lists(blocks[first : first + LISTS]), strict=True):
            out += found
    most = max(map(len, lists)) + 1
    counts = np.zeros((lanes, most), np.int64)
    for lane, own in enumerate(used):
        counts[lane, 1 : len(own) + 1] = own
    if (counts.sum(axis=1) > lengths).any():
        raise ValueError("a block is damaged: it uses more ids than it has, its checksum cannot hold")
    uses, contexts, model = _Uses(counts, True), _Contexts(lanes, most), _Model(lanes)
    coder = _Reader(coded)
    numbers = np.zeros((steps, lanes), np.uint16)
    for step, n in enumerate(at_work):
        slots = contexts.look(n)
        guess = _Guess(*slots)
        hit = model.holds(n, guess.place1, guess.sure2, None, coder)
        out, left = guess.best, ~hit
        asked = np.flatnonzero(guess.other & left)
        if len(asked):
            found = asked[model.asked(asked, guess.sure1[asked], None, coder)]
            out[found] = guess.next1[found]
            left[found] = False
        left = np.flatnonzero(left)
        if len(left):
            out[left] = coder.read(left, uses)
        numbers[step, :n] = out
        contexts.learn(n, slots, out)
    numbers = np.ascontiguousarray(numbers.T)
    return [
        ids.astype(np.uint32).take(numbers[lane, :n].astype(np.int64) - 1, mode="clip")
        for lane, (ids, n) in enumerate(zip(lists, lengths.tolist(), strict=True))
    ]


def write_blocks(blocks: list[np.ndarray], nibbles: int) -> list[bytes]:
    """Each block with its header: kind, nibbles, checksum of the coded form, number of ids, crc32 of the ids.

    The last is of the ids as unsigned 32-bit numbers.
    """
    blocks = [np.ascontiguousarray(b, "<u4") for b in blocks]
    order = sorted((i for i, b in enumerate(blocks) if 0 < len(b) <= BLOCK_IDS), key=lambda i: -len(blocks[i]))
    coded: dict[int, bytes] = {}
    for first in range(0, len(order), LANES):
        part = order[first : first + LANES]
        coded |= zip(part, _write_lanes([blocks[i] for i in part], nibbles), strict=True)
    out = []
    for i, block in enumerate(blocks):
        own = coded.get(i)
        shorter = own is not None and len(own) < block.nbytes
        kind, check = (CODED, zlib.crc32(own) & 0xFFFF) if shorter else (PLAIN, 0)
        head = HEADER.pack(kind, nibbles, check, len(block), zlib.crc32(block))
        out.append(head + (own if shorter else block.tobytes()))
    return out


def read_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ValueError where a checksum does not hold."""
    out: list[np.ndarray | None] = [None] * len(blocks)
    heads = [HEADER.unpack_from(b) for b in blocks]
    coded = []
    for i, (kind, _, check, n, _) in enumerate(heads):
        if kind == PLAIN:
            out[i] = np.frombuffer(blocks[i], "<u4", n, HEADER.size)
        elif zlib.crc32(blocks[i][HEADER.size :]) & 0xFFFF != check:
            raise ValueError(f"block {i} is damaged: its checksum does not hold")
        else:
            coded.append(i)
    coded.sort(key=lambda i: -heads[i][3])
    for first in range(0, len(coded), LANES):
        part = coded[first : first + LANES]
        lanes = _read_lanes([blocks[i][HEADER.size :] for i in part], np.array([heads[i][3] for i in part]))
        for i, ids in zip(part, lanes, strict=True):
            out[i] = ids
    for i, (ids, head) in enumerate(zip(out, heads, strict=True)):
        if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != head[4]:
            raise ValueError(f"block {i} is damaged: its checksum does not hold")
    return out
