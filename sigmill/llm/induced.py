"""Suffix and common-prefix arrays of one shard by external induced sorting.

The order of the starred suffixes (the first of each rising stretch, `stars`)
comes from naming the pieces between them and sorting the string of names the
same way, until all names differ. From there one pass upwards induces the
falling suffixes and one pass downwards the rising ones. Both passes are the
same loop over a priority queue: suffixes leave it by (symbol, arrival), and each
one that leaves may push the suffix one place to its left.

A queue is cut into ranges of symbols. Pushes append to a range's buffer; all
buffers together hold `memory` bytes and then go to a file, a piece for each
range. A range is read back when its turn comes, so a pass holds one range, the
buffers, and a window of suffixes that leave together: as many as surely
precede everything that they push. Strings, names and star positions lie in
mapped files once they outgrow the memory.

At the bottom level a suffix carries how much it has in common with the one
before it, up to a cap: one more than the least value between the two suffixes
that pushed them. The starred suffixes' values come from comparing them, capped.

All files are temporary ones of the task and vanish with it.
"""

from __future__ import annotations

import tempfile

SEPARATOR = 1
_FIRST = 2


class Store:
    """Arrays of a shard: in memory while they are small, else in a mapped temporary file."""

    def __init__(self, memory: int):
        self.memory = memory

    def array(self, n: int, dtype):
        import numpy as np

        if n * np.dtype(dtype).itemsize <= self.memory // 4:
            return np.zeros(n, dtype)
        with tempfile.TemporaryFile() as file:
            return np.memmap(file, dtype, "w+", shape=(n,))


class Buckets:
    """Columns of records by bucket number, in order of arrival; beyond `memory` bytes in a file."""

    def __init__(self, n: int, kinds: tuple, memory: int):
        self.kinds, self.memory = kinds, memory
        self.held: list[list] = [[] for _ in range(n)]
        self.spilled: list[list] = [[] for _ in range(n)]
        self.recent: list = []
        self.n_recent = self.bytes = self.end = 0
        self.file = None

    def push(self, bucket, *columns):
        """Records of several buckets."""
        if len(bucket):
            self.recent.append((bucket, *columns))
            self.n_recent += len(bucket)
            if self.n_recent >= 1 << 16:
                self._deal()

    def append(self, g: int, *columns):
        """Records of one bucket."""
        if len(columns[0]):
            self.held[g].append(columns)
            self._grown(columns)

    def _grown(self, columns):
        self.bytes += sum(c.nbytes for c in columns)
        if self.bytes > self.memory:
            self._spill()

    def _deal(self):
        import numpy as np

        if not self.recent:
            return
        bucket, *columns = (np.concatenate(c) for c in zip(*self.recent, strict=True))
        self.recent, self.n_recent = [], 0
        order = np.argsort(bucket.astype(np.uint16), kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
            self.held[bucket[i]].append([c[i:j] for c in columns])
        self._grown(columns)

    def _spill(self):
        import numpy as np

        self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
        self.file.seek(self.end)
        for g, parts in enumerate(self.held):
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                self.spilled[g].append((self.end, len(columns[0])))
                for c in columns:
                    self.file.write(c.tobytes())
                    self.end += c.nbytes
                self.held[g] = []
        self.bytes = 0

    def pop(self, g: int) -> list:
        import numpy as np

        self._deal()
        parts = []
        for at, n in self.spilled[g]:
            self.file.seek(at)
            parts.append([np.frombuffer(self.file.read(n * np.dtype(k).itemsize), k) for k in self.kinds])
        parts += self.held[g]
        self.bytes -= sum(c.nbytes for part in self.held[g] for c in part)
        self.held[g], self.spilled[g] = [], []
        if not parts:
            return [np.zeros(0, k) for k in self.kinds]
        return [np.concatenate(c) for c in zip(*parts, strict=True)]

    def close(self):
        if self.file:
            self.file.close()


def common(codes, a, b, cap: int):
    """Symbols that the suffixes at a and b have in common, up to cap."""
    import numpy as np

    out = np.full(len(a), cap, np.uint8)
    step = 20
    view = np.lib.stride_tricks.sliding_window_view(codes, step)
    for low in range(0, len(a), 1 << 16):
        todo = np.arange(low, min(low + (1 << 16), len(a)))
        done = 0
        while len(todo) and done < cap:
            differ = view[a[todo] + done] != view[b[todo] + done]
            found = differ.any(axis=1)
            out[todo[found]] = np.minimum(cap, done + differ[found].argmax(axis=1))
            todo = todo[~found]
            done += step
    return out


def stars(codes, n: int, store: Store):
    """Places of rising suffixes after a falling one; the last symbol, smaller than all others, is one."""
    import numpy as np

    found, block, after, rises_after = [], 1 << 20, None, True
    for low in range((n - 1) // block * block, -1, -block):
        part = np.concatenate([codes[low : min(low + block, n)], [] if after is None else [after]]).astype(np.int64)
        way = np.sign(np.diff(part))
        size = min(block, n - low)
        if after is None:
            way = np.concatenate([way, [1]])
        # Equal symbols go the way of the next one that differs.
        at = np.where(way != 0, np.arange(size), size)
        at = np.minimum.accumulate(at[::-1])[::-1]
        rises = np.concatenate([way > 0, [rises_after]])[at]
        both = np.concatenate([rises, [rises_after]])
        found.append(low + 1 + np.flatnonzero(~both[:-1] & both[1:]))
        after, rises_after = part[0], bool(rises[0])
    found = np.concatenate(found[::-1])
    out = store.array(len(found), np.int64)
    out[:] = found
    return out


def _names(codes, n: int, sigma: int, star, store: Store, groups):
    """(names, order, count): each star's name by its piece up to the next star, the stars by name, and the number of names.

    Pieces are compared symbol by symbol; of two that agree on the shorter one's whole length the longer is smaller.
    """
    import numpy as np

    bits = int(sigma).bit_length() + 1
    per, last = 64 // bits, (1 << bits) - 1
    names, order = store.array(len(star), np.int64), store.array(len(star), np.int64)
    buckets = Buckets(len(groups), (np.int64,), store.memory)
    for low in range(0, len(star), 1 << 18):
        at = np.arange(low, min(low + (1 << 18), len(star)))
        buckets.push(np.searchsorted(groups, codes[star[at]], side="right") - 1, at)

    def packed(j, t):
        begin, end = star[j] + t * per, star[np.minimum(j + 1, len(star) - 1)]
        out = np.zeros(len(j), np.uint64)
        for q in range(per):
            symbol = np.where(begin + q <= end, codes[np.minimum(begin + q, n - 1)], last)
            out = (out << np.uint64(bits)) | symbol.astype(np.uint64)
        return out

    done = at = 0
    for g in range(len(groups)):
        (j,) = buckets.pop(g)
        if not len(j):
            continue
        keys = packed(j, 0)
        by = np.argsort(keys, kind="stable")
        j, keys = j[by], keys[by]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank = np.cumsum(new) - 1
        t, size = 1, star[np.minimum(j + 1, len(star) - 1)] - star[j] + 1
        # A piece that ends with its words of symbols still has its end to be compared.
        while (longer := np.flatnonzero((size >= t * per) & (np.bincount(rank)[rank] > 1))).size:
            # The members of a group that go on are its whole group.
            chunk = packed(j[longer], t)
            inner = np.lexsort((chunk, rank[longer]))
            r, chunk, moved = rank[longer][inner], chunk[inner], longer[inner]
            fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (chunk[1:] != chunk[:-1])])
            first = np.concatenate([[True], r[1:] != r[:-1]])
            sub = np.cumsum(fresh) - 1
            sub -= np.maximum.accumulate(np.where(first, sub, 0))
            more = np.zeros(rank[-1] + 2, np.int64)
            np.maximum.at(more, r + 1, sub)
            rank = rank + np.cumsum(more)[rank]
            rank[longer], j[longer] = rank[moved] + sub, j[moved]
            size = star[np.minimum(j + 1, len(star) - 1)] - star[j] + 1
            t += 1
        order[at : at + len(j)] = j
        names[j] = done + rank
        done += int(rank[-1]) + 1
        at += len(j)
    buckets.close()
    return names, order, done


class _Pass:
    """One induction over codes; flip: downwards. Symbols inside are those seen from the pass's end."""

    def __init__(self, codes, sigma: int, groups, flip: bool, store: Store, cap: int | None):
        import numpy as np

        self.codes, self.flip, self.sigma, self.cap, self.memory = codes, flip, sigma, cap, store.memory
        self.groups = np.concatenate([[0], sigma - groups[:0:-1]]) if flip else groups
        kinds = (np.int64, np.int64) + ((np.uint8,) if cap else ())
        self.queue, self.out = Buckets(len(groups), kinds, store.memory), Buckets(len(groups), kinds + (np.bool_,), store.memory)
        if cap:
            self.least, self.seen = np.full(sigma, cap, np.uint8), np.zeros(sigma, bool)
            #: Symbol and place of the suffix that left last, and whether it was a seed.
            self.last = (-1, -1, True)

    def seen_from_end(self, symbols):
        return self.sigma - 1 - symbols if self.flip else symbols

    def run(self, seeds):
        """seeds: for each group, (places, values) in the order in which they leave."""
        import numpy as np

        for g in range(len(self.groups)):
            place, symbol, *value = self.queue.pop(g)
            at, *given = seeds(g)
            key = np.concatenate([2 * symbol, 2 * self.seen_from_end(self.codes[at].astype(np.int64)) + 1])
            place = np.concatenate([place, at])
            value = np.concatenate([value[0], given[0]]) if self.cap else None
            order = np.argsort(key, kind="stable")
            self._range(g, key[order], place[order], value[order] if self.cap else None)
        self.queue.close()
        return self.out

    def _range(self, g, key, place, value):
        import numpy as np

        end = np.iinfo(np.int64).max
        late = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)]
        done, width = 0, 1024
        while done < len(key) or len(late[0]):
            stop = int(np.searchsorted(key, key[min(done + width, len(key)) - 1], side="right")) if done < len(key) else done
            high = key[stop - 1] if stop < len(key) else end
            n_late = int(np.searchsorted(late[0], high, side="right"))
            if n_late:
                k, p = np.concatenate([key[done:stop], late[0][:n_late]]), np.concatenate([place[done:stop], late[1][:n_late]])
                order = np.argsort(k, kind="stable")
                k, p = k[order], p[order]
                v = np.concatenate([value[done:stop], late[2][:n_late]])[order] if self.cap else None
            else:
                k, p, v = key[done:stop], place[done:stop], value[done:stop] if self.cap else None
            left = self.seen_from_end(self.codes[np.maximum(p - 1, 0)].astype(np.int64))
            pushes = (2 * left >= k) & (p > 0)
            safe = (2 * left[pushes]).min(initial=end)
            n = int(np.searchsorted(k, safe, side="right"))
            if n < len(k):
                k, p, left, pushes, v = k[:n], p[:n], left[:n], pushes[:n], v[:n] if self.cap else None
            width = min(width * 2, 1 << 22) if n * 2 > width else max(256, width // 2)
            done += int(np.searchsorted(key[done:stop], safe, side="right"))
            n_late = int(np.searchsorted(late[0][:n_late], safe, side="right"))
            late = [x[n_late:] for x in late]
            values = self._values(k, p, left, pushes, v) if self.cap else None
            own = k % 2 == 0
            extra = (values[0][own],) if self.cap else ()
            self.out.append(g, p[own], k[own] // 2, *extra, ~pushes[own] & (p[own] > 0))
            p, left = p[pushes] - 1, left[pushes]
            group = np.searchsorted(self.groups, left, side="right") - 1
            here = group == g
            if here.any():
                new = [2 * left[here], p[here], values[1][here] if self.cap else np.zeros(0, np.uint8)]
                late = [np.concatenate(x) for x in zip(late, new, strict=True)]
                order = np.argsort(late[0], kind="stable")
                late = [x[order] for x in late[:2]] + [late[2][order] if self.cap else late[2]]
                here = ~here
                group, p, left = group[here], p[here], left[here]
                self.queue.push(group, p, left, *((values[1][here],) if self.cap else ()))
            else:
                self.queue.push(group, p, left, *((values[1],) if self.cap else ()))

    def _values(self, k, p, left, pushes, v):
        """The common-prefix values of the suffixes that leave, and of those that they push."""
        import numpy as np

        symbol, seed = k // 2, k % 2 == 1
        # A symbol's first seed meets the last pushed suffix of that symbol.
        before = np.concatenate([[self.last[0] == symbol[0]], symbol[1:] == symbol[:-1]])
        meet = np.flatnonzero(seed & before & ~np.concatenate([[self.last[2]], seed[:-1]]))
        v = v.copy()
        v[seed & ~before] = 0
        if len(meet):
            earlier = np.where(meet > 0, p[meet - 1], self.last[1])
            v[meet] = common(self.codes, earlier, p[meet], self.cap)
        self.last = int(symbol[-1]), int(p[-1]), bool(seed[-1])

        rows = np.flatnonzero(pushes)
        target = left[rows]
        by = np.argsort(target.astype(np.uint16), kind="stable")
        to, at = target[by], rows[by]
        first = np.concatenate([[True], to[1:] != to[:-1]]) if len(to) else np.zeros(0, bool)
        low = np.concatenate([[0], at[:-1] + 1]) if len(to) else at
        low = np.where(first, 0, low)
        least = _least(v, low, at)
        least[first] = np.minimum(least[first], self.least[to[first]])
        pushed = np.minimum(least.astype(np.int16) + 1, self.cap).astype(np.uint8)
        pushed[first & ~self.seen[to]] = 0
        self.least = np.minimum(self.least, v.min())
        if len(to):
            final = np.concatenate([first[1:], [True]])
            rest = np.concatenate([np.minimum.accumulate(v[::-1])[::-1], [self.cap]]).astype(np.uint8)
            self.least[to[final]] = rest[at[final] + 1]
            self.seen[to[final]] = True
        out = np.empty_like(pushed)
        out[by] = pushed
        return v, out


def _least(values, low, high):
    """Least value between low and high, both inclusive, for each pair."""
    import numpy as np

    size = high - low + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.zeros(len(low), values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        now = np.flatnonzero(level == k)
        if len(now):
            out[now] = np.minimum(table[low[now]], table[high[now] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def _ranges(codes, n: int, sigma: int, wanted: int):
    """First symbols of at most `wanted` ranges that hold about equally many suffixes."""
    import numpy as np

    if sigma <= wanted:
        return np.arange(sigma)
    counts = np.zeros(sigma, np.int64)
    for low in range(0, n, 1 << 20):
        counts += np.bincount(codes[low : min(low + (1 << 20), n)], minlength=sigma)
    before = np.cumsum(counts) - counts
    return np.unique(np.concatenate([[0], np.searchsorted(before, np.arange(1, wanted) * n // wanted)])).clip(max=sigma - 1)


def ordered(codes, n: int, sigma: int, memory: int = 256 << 20, cap: int | None = None, ranges: int | None = None):
    """Places of all suffixes of codes[:n] in order, in parts, each with its values if cap is given.

    codes are followed by at least cap + 20 zeros; codes[n - 1] is 0 and no other symbol is. Values are capped and those of a
    part's first suffix are 0 where the part before ends with another symbol.
    """
    import numpy as np

    store = Store(memory)
    star = stars(codes, n, store)
    groups = _ranges(codes, n, sigma, ranges or (min(1024, max(4, n >> 15)) if sigma > 258 else sigma))
    names, order, count = _names(codes, n, sigma, star, store, groups)
    if count < len(star):
        at = 0
        longer = np.int32 if count < 1 << 31 else np.int64
        inner = store.array(len(star) + 20, longer)
        inner[: len(star)] = names[:]
        for part, _ in ordered(inner, len(star), count, memory, None, ranges):
            order[at : at + len(part)] = part
            at += len(part)
        del inner
    del names
    by_group = np.zeros(len(groups) + 1, np.int64)
    for low in range(0, len(star), 1 << 18):
        found = np.searchsorted(groups, codes[star[low : low + (1 << 18)]], side="right")
        by_group += np.bincount(found, minlength=len(groups) + 1)
    cuts = np.cumsum(by_group)
    held = {"place": -1}

    def starred(g):
        at = star[order[cuts[g] : cuts[g + 1]]]
        if not cap:
            return (at,)
        if not len(at):
            return at, np.zeros(0, np.uint8)
        before = np.concatenate([[held["place"] if held["place"] >= 0 else at[0]], at[:-1]])
        held["place"] = int(at[-1])
        return at, common(codes, before, at, cap)

    falling = _Pass(codes, sigma, groups, False, store, cap).run(starred)
    # What fell and has a rising neighbour on its left starts the way down; the columns are read twice.
    kept = Buckets(len(groups), falling.kinds, memory)
    downwards = _Pass(codes, sigma, groups, True, store, cap)
    back = len(groups) - 1
    held["value"] = 0

    def fallen(g):
        place, symbol, *value, turns = columns = falling.pop(back - g)
        kept.append(back - g, *columns)
        at = np.flatnonzero(turns)[::-1]
        if not cap:
            return (place[at],)
        if not len(at):
            return place[at], np.zeros(0, np.uint8)
        ascending = at[::-1]
        # Least value after the turning suffix before, up to this one; a symbol's first suffix has 0.
        least = np.minimum.reduceat(value[0][: ascending[-1] + 1], np.concatenate([[0], ascending[:-1] + 1]))
        return place[at], np.concatenate([[0], least[::-1][:-1]]).astype(np.uint8)

    rising = downwards.run(fallen)
    for g in range(len(groups)):
        low, low_symbol, *low_value, _ = kept.pop(g)
        high, high_symbol, *high_value, _ = rising.pop(back - g)
        high, high_symbol = high[::-1], sigma - 1 - high_symbol[::-1]
        if g == 0:  # the last symbol has no neighbour to its right
            low, low_symbol, low_value = np.concatenate([[n - 1], low]), np.concatenate([[0], low_symbol]), [np.concatenate([[0], v]).astype(np.uint8) for v in low_value]
        merged = np.argsort(np.concatenate([2 * low_symbol, 2 * high_symbol + 1]), kind="stable")
        place = np.concatenate([low, high])[merged]
        if not cap:
            yield place, None
            continue
        above = np.concatenate([[0], high_value[0][::-1][:-1]])[: len(high)].astype(np.uint8)
        symbol = np.concatenate([low_symbol, high_symbol])[merged]
        value = np.concatenate([low_value[0], above])[merged]
        kind = np.concatenate([np.zeros(len(low), bool), np.ones(len(high), bool)])[merged]
        meet = 1 + np.flatnonzero((symbol[1:] == symbol[:-1]) & kind[1:] & ~kind[:-1])
        value[meet] = common(codes, place[meet - 1], place[meet], cap)
        value[1 + np.flatnonzero(symbol[1:] != symbol[:-1])] = 0
        value[:1] = 0
        yield place, value


def encoded(strings: list[bytes], cap: int, store: Store):
    """(codes, n, sigma) of strings, each followed by `SEPARATOR`, all by a 0."""
    import numpy as np

    n = sum(map(len, strings)) + len(strings) + 1
    codes = store.array(n + cap + 40, np.uint16)
    at = 0
    for s in strings:
        codes[at : at + len(s)] = np.frombuffer(s, np.uint8).astype(np.uint16) + _FIRST
        codes[at + len(s)] = SEPARATOR
        at += len(s) + 1
    return codes, n, 256 + _FIRST
