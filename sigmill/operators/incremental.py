"""Incremental clustering of the reports of one gate (equal hard keys), one report after the other.

A report joins the best cluster that its window, filters and threshold allow,
or opens a candidate; then open clusters that are close enough are merged, the
smaller id staying. A cluster scores by the mean unit vector of its members at
most a window away from the report.

Those members' sums are kept for all open clusters in one matrix: a report adds
its vector, and members that leave the window take theirs away, each once. So a
report costs a product with the open clusters, however many came before. Pairs
of clusters that are close are kept, and only clusters that changed are compared.
Evidence, state and medoid depend on a cluster's last window alone and are
worked out when they are read.
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from dataclasses import dataclass, field

TOLERANCE = 1e-6
#: Subtractions after which a window's sum is added up anew, so that rounding does not gather.
RESUM = 256


@dataclass
class Policy:
    """Parameters of incremental clustering, the window in seconds; single_max scores by the nearest member, not the mean."""

    window: float = 600
    threshold: float = 0.56
    min_sessions: int = 5
    review_sessions: int = 10
    tolerance: float = TOLERANCE
    single_max: bool = False


@dataclass
class Cluster:
    """rest: (report id, session, time, None, similarity) of members too old to be near any report; recent: the others, by time, with their unit vectors."""

    id: object
    policy: Policy
    submission: object = None
    error: object = None
    rest: list = field(default_factory=list)
    recent: deque = field(default_factory=deque)
    slot: int | None = None
    into: Cluster | None = None

    @property
    def members(self) -> list:
        return [*self.rest, *self.recent]

    @property
    def last(self) -> int:
        return self.recent[-1][2]

    @property
    def inside(self) -> list:
        """The members of the evidence window: from the last one back."""
        begin = self.last - round(self.policy.window * 1_000_000)
        return [m for m in self.recent if m[2] >= begin]

    @property
    def first(self) -> int:
        return self.inside[0][2]

    @property
    def raw(self) -> int:
        return len(self.inside)

    @property
    def sessions(self) -> int:
        return len({m[1] for m in self.inside})

    @property
    def status(self) -> str:
        return "SIGNAL_DETECTED" if self.sessions >= self.policy.min_sessions else "CANDIDATE"

    @property
    def representative(self) -> object:
        import numpy as np

        ordered = sorted(self.inside, key=lambda m: m[0])
        units = np.array([m[3] for m in ordered])
        means = units @ units.sum(axis=0) / len(units)
        return ordered[int(np.flatnonzero(means >= means.max() - 1e-12)[0])][0]

    def place(self, member: tuple, keep: int) -> None:
        if not self.recent or member[2] >= self.last:
            self.recent.append(member)
        else:
            ordered = list(self.recent)
            insort(ordered, member, key=lambda m: m[2])
            self.recent = deque(ordered)
        self.age(keep)

    def age(self, keep: int) -> None:
        begin = self.last - keep
        while self.recent[0][2] < begin:
            report_id, session, at, _, similarity = self.recent.popleft()
            self.rest.append((report_id, session, at, None, similarity))


def root(cluster: Cluster) -> Cluster:
    while cluster.into is not None:
        cluster = cluster.into
    return cluster


class IncrementalGate:
    """The clusters of one gate; times are in microseconds.

    Reports come in order of time, or up to `lateness` seconds later than the
    latest one; a late report is scored by the members around its own time.
    """

    def __init__(self, policy: Policy, lateness: float = 0):
        self.policy = policy
        self.window = round(policy.window * 1_000_000)
        self.lateness = round(lateness * 1_000_000)
        self.clusters: dict[object, Cluster] = {}
        self.closed: list[tuple[object, object]] = []
        self.changed: set = set()
        self.latest: int | None = None
        #: (time, cluster, unit vector) of all members at most a window before the latest report, by time.
        self.near: deque = deque()
        self.slots: list[Cluster | None] = []
        self.codes: dict = {None: 0}
        self.sums = None
        #: Slots that hold no cluster.
        self.free: list[int] = []
        #: By slot, the slots of clusters whose means are close and filters alike, with their scores, and the slots changed since.
        self.close: dict[int, dict[int, float]] = {}
        self.stale: set[int] = set()

    # -- windows ------------------------------------------------------------------------------------------------------

    def _grow(self, dimension: int) -> None:
        import numpy as np

        if self.sums is None:
            self.sums, self.sizes, self.filters, self.taken = np.zeros((16, dimension)), np.zeros(16), np.zeros((16, 2), np.int64), np.zeros(16, np.int64)
            self.means, self.slots, self.free = np.zeros((16, dimension)), [None] * 16, list(range(16))
        elif not self.free:
            self.free = list(range(len(self.slots), 2 * len(self.slots)))
            self.sums, self.sizes = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.filters, self.taken = np.concatenate([self.filters, np.zeros_like(self.filters)]), np.concatenate([self.taken, np.zeros_like(self.taken)])
            self.means = np.concatenate([self.means, np.zeros_like(self.means)])
            self.slots += [None] * len(self.slots)

    def _code(self, value) -> int:
        return self.codes.setdefault(value, len(self.codes))

    def _open(self, cluster: Cluster, dimension: int) -> None:
        if cluster.slot is None:
            self._grow(dimension)
            cluster.slot = self.free.pop()
            self.slots[cluster.slot] = cluster
            self.sums[cluster.slot], self.sizes[cluster.slot], self.taken[cluster.slot] = 0, 0, 0
        self.filters[cluster.slot] = self._code(cluster.submission), self._code(cluster.error)
        self.stale.add(cluster.slot)

    def _shut(self, cluster: Cluster) -> None:
        self.stale.add(cluster.slot)
        self.free.append(cluster.slot)
        self.slots[cluster.slot], self.sizes[cluster.slot], cluster.slot = None, 0, None

    def _advance(self, at: int) -> None:
        import numpy as np

        begin = at - self.window
        while self.near and self.near[0][0] < begin:
            _, cluster, unit = self.near.popleft()
            cluster = root(cluster)
            s = cluster.slot
            self.stale.add(s)
            self.sizes[s] -= 1
            self.taken[s] += 1
            if self.sizes[s] == 0:
                self._shut(cluster)
            elif self.taken[s] >= RESUM:
                left = [m[3] for m in cluster.recent if m[2] >= begin]
                self.taken[s] = 0
                # Members that leave at this very moment are taken away one by one below.
                gone = [u for t, c, u in self.near if t < begin and root(c) is cluster] if self.near and self.near[0][0] < begin else []
                self.sums[s] = np.sum([*left, *gone], axis=0)
            else:
                self.sums[s] -= unit

    def _around(self, at: int):
        """(clusters, sums, sizes, filters) of the members at most a window from a late report's time."""
        import numpy as np

        found, sums, sizes, filters = [], [], [], []
        for c in self.clusters.values():
            units = [m[3] for m in c.recent if abs(m[2] - at) <= self.window]
            if units and c.first <= at + self.window and c.last >= at - self.window:
                found.append(c)
                sums.append(np.sum(units, axis=0))
                sizes.append(len(units))
                filters.append((self._code(c.submission), self._code(c.error)))
        return found, np.array(sums), np.array(sizes, float), np.array(filters, np.int64).reshape(-1, 2)

    def _view(self, at: int):
        import numpy as np

        if at < self.latest:
            return self._around(at)
        if self.sums is None:
            return [], None, np.zeros(0), np.zeros((0, 2), np.int64)
        held = np.flatnonzero(self.sizes > 0)
        return [self.slots[s] for s in held.tolist()], self.sums[held], self.sizes[held], self.filters[held]

    @staticmethod
    def _same(filters, wanted):
        return ((filters == 0) | (filters == wanted) | (wanted == 0)).all(axis=-1)

    # -- reports ------------------------------------------------------------------------------------------------------

    def add(self, report_id, session, at: int, vector, submission=None, error=None) -> object:
        import numpy as np

        p = self.policy
        v = np.asarray(vector, float)
        size = float(np.linalg.norm(v))
        unit = v / size if size else v
        if self.latest is None or at >= self.latest:
            self.latest = at
            self._advance(at)
        wanted = np.array([self._code(submission), self._code(error)])
        best = None
        if at >= self.latest and not p.single_max:
            if len(slots := np.flatnonzero(self._matching(wanted))):
                scores = (self.sums @ unit)[slots] / self.sizes[slots]
                top = scores.max()
                if top >= p.threshold - p.tolerance:
                    best = min((self.slots[i] for i in slots[scores == top].tolist()), key=lambda c: c.id)
            clusters = []
        else:
            clusters, sums, sizes, filters = self._view(at)
        if clusters:
            if p.single_max:
                scores = np.array([max(float(m[3] @ unit) for m in c.recent if abs(m[2] - at) <= self.window) for c in clusters])
            else:
                scores = sums @ unit / sizes
            scores = np.where(self._same(filters, wanted), scores, -np.inf)
            top = scores.max()
            if top >= p.threshold - p.tolerance:
                best = min((clusters[i] for i in np.flatnonzero(scores == top)), key=lambda c: c.id)
        if best is None:
            best, similarity = Cluster(report_id, p, submission, error), 1.0
            self.clusters[report_id] = best
        else:
            similarity = float(top)
            best.submission = submission if best.submission is None else best.submission
            best.error = error if best.error is None else best.error
        best.place((report_id, session, at, unit, min(1.0, max(-1.0, similarity))), self.window + self.lateness)
        if at >= self.latest - self.window:
            self._open(best, len(unit))
            self.sums[best.slot] += unit
            self.sizes[best.slot] += 1
            entry = (at, best, unit)
            if self.near and at < self.near[-1][0]:
                ordered = list(self.near)
                insort(ordered, entry, key=lambda e: e[0])
                self.near = deque(ordered)
            else:
                self.near.append(entry)
        self.changed.add(best.id)
        if not p.single_max:
            self._reconcile(at, wanted)
        return root(best).id

    def _matching(self, wanted):
        """Whether a slot holds a cluster whose filters match."""
        import numpy as np

        found = self.sizes > 0 if self.sums is not None else np.zeros(0, bool)
        for i in (0, 1):
            if wanted[i] and len(found):
                found &= (self.filters[:, i] == 0) | (self.filters[:, i] == wanted[i])
        return found

    def _compare(self) -> None:
        """Compares the clusters that changed with the others."""
        import numpy as np

        for s in self.stale:
            for other in self.close.pop(s, ()):
                self.close[other].pop(s)
        changed = [s for s in self.stale if self.sizes[s] > 0]
        self.stale.clear()
        if not changed:
            return
        self.means[changed] = self.sums[changed] / self.sizes[changed, None]
        scores = self.means[changed] @ self.means.T
        i, j = np.nonzero((scores >= self.policy.threshold - 4 * self.policy.tolerance - 1e-9) & (self.sizes > 0))
        mine = np.array(changed)[i]
        kept = (mine != j) & self._same(self.filters[mine], self.filters[j])
        for a, b, score in zip(mine[kept].tolist(), j[kept].tolist(), scores[i[kept], j[kept]].tolist(), strict=True):
            self.close.setdefault(a, {})[b] = score
            self.close.setdefault(b, {})[a] = score

    def _reconcile(self, anchor: int, wanted) -> None:
        p = self.policy
        if anchor < self.latest:
            return self._settle(anchor, wanted)
        while True:
            self._compare()
            match = self._matching(wanted).tolist()
            pairs = sorted(
                (self.slots[a].id, self.slots[b].id, score, a, b)
                for a, others in self.close.items() if match[a]
                for b, score in others.items() if match[b] and self.slots[a].id < self.slots[b].id
            )
            if any(score < p.threshold + 2 * p.tolerance for _, _, score, _, _ in pairs):
                # At the threshold worse pairs tell whether a better one counts as better, so all are compared.
                return self._settle(anchor, wanted)
            if not pairs:
                return None
            best = pairs[0]
            for pair in pairs:
                if pair[2] > best[2] + p.tolerance:
                    best = pair
            self._merge(self.slots[best[3]], self.slots[best[4]])

    def _settle(self, anchor: int, wanted) -> None:
        """As _reconcile, by all pairs of clusters."""
        import numpy as np

        p = self.policy
        clusters, sums, sizes, filters = self._view(anchor)
        kept = np.flatnonzero(self._same(filters, wanted)).tolist()
        kept.sort(key=lambda i: clusters[i].id)
        clusters = [clusters[i] for i in kept]
        sums, sizes, filters = sums[kept], sizes[kept], filters[kept]
        while len(clusters) > 1:
            means = sums / sizes[:, None]
            scores = np.where(self._same(filters[:, None], filters[None]), means @ means.T, -np.inf)
            scores[np.tril_indices(len(clusters))] = -np.inf
            if scores.max() < p.threshold - p.tolerance:
                return
            # Pairs in order of ids: a later one must be better by more than the tolerance.
            flat = scores.ravel()
            at = int(np.argmax(flat > -np.inf))
            while len(more := np.flatnonzero(flat[at + 1 :] > flat[at] + p.tolerance)):
                at += 1 + int(more[0])
            if flat[at] < p.threshold - p.tolerance:
                return
            a, b = divmod(at, len(clusters))
            self._merge(clusters[a], clusters[b])
            sums[a], sizes[a] = sums[a] + sums[b], sizes[a] + sizes[b]
            filters[a] = np.where(filters[a] == 0, filters[b], filters[a])
            clusters.pop(b)
            sums, sizes, filters = (np.delete(x, b, axis=0) for x in (sums, sizes, filters))

    def _merge(self, target: Cluster, source: Cluster) -> None:
        del self.clusters[source.id]
        target.rest += source.rest
        target.recent = deque(sorted([*target.recent, *source.recent], key=lambda m: m[2]))
        target.age(self.window + self.lateness)
        target.submission = source.submission if target.submission is None else target.submission
        target.error = source.error if target.error is None else target.error
        source.into = target
        if source.slot is not None:
            self._open(target, self.sums.shape[1])
            self.sums[target.slot] += self.sums[source.slot]
            self.sizes[target.slot] += self.sizes[source.slot]
            self.taken[target.slot] += self.taken[source.slot]
            self._shut(source)
        elif target.slot is not None:
            self._open(target, self.sums.shape[1])
        self.closed.append((source.id, target.id))
        self.changed.add(target.id)
        self.changed.discard(source.id)

    def passed(self) -> list[Cluster]:
        """Removes and returns the clusters that no report can reach any more."""
        if self.latest is None:
            return []
        gone = [c for c in self.clusters.values() if c.last < self.latest - self.window - self.lateness]
        for c in gone:
            del self.clusters[c.id]
        return gone

    # -- state between batches ----------------------------------------------------------------------------------------

    def restore(self, clusters: list[Cluster], latest: int) -> None:
        """Takes clusters up again that an earlier gate left."""
        self.latest = latest
        entries = []
        for c in clusters:
            c.slot, c.into = None, None
            self.clusters[c.id] = c
            units = [m for m in c.recent if m[2] >= latest - self.window]
            for m in units:
                self._open(c, len(m[3]))
                self.sums[c.slot] += m[3]
                self.sizes[c.slot] += 1
                entries.append((m[2], c, m[3]))
        self.near = deque(sorted(entries, key=lambda e: e[0]))
