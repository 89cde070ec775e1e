"""Plain forms of the sequential clusterings, which rescan every cluster and member; tests compare the operators with them."""

from dataclasses import dataclass, field

from sigmill.operators.incremental import Policy


@dataclass
class Cluster:
    id: object
    submission: object = None
    error: object = None
    status: str = "CANDIDATE"
    first: int = 0
    last: int = 0
    raw: int = 0
    sessions: int = 0
    representative: object = None
    #: (report id, session, time, unit vector, similarity at join)
    members: list = field(default_factory=list)


def _same(a, b) -> bool:
    return a is None or b is None or a == b


class IncrementalGate:
    """The open clusters of one gate (equal hard keys); reports come one after the other, their times in microseconds.

    A report joins the best cluster that its window, filters and threshold allow,
    or opens a candidate; the cluster's evidence, state and medoid follow; then
    open clusters that are close enough are merged, the smaller id staying.
    first and last are the bounds of the evidence window, so a cluster can refuse
    a late report although an old member is near it in time.
    """

    def __init__(self, policy: Policy):
        self.policy = policy
        self.window = round(policy.window * 1_000_000)
        self.clusters: dict[object, Cluster] = {}
        self.closed: list[tuple[object, object]] = []

    def add(self, report_id, session, at: int, vector, submission=None, error=None) -> object:
        import numpy as np

        p = self.policy
        v = np.asarray(vector, float)
        size = float(np.linalg.norm(v))
        unit = v / size if size else v
        best = None
        for c in sorted(self.clusters.values(), key=lambda c: c.id):
            if not (c.first <= at + self.window and c.last >= at - self.window and _same(c.submission, submission) and _same(c.error, error)):
                continue
            near = [m for m in c.members if abs(m[2] - at) <= self.window]
            if not near:
                continue
            scores = np.array([m[3] for m in near]) @ unit
            score = float(scores.max() if p.single_max else scores.mean())
            if best is None or score > best[0]:
                best = (score, c)
        if best is None or best[0] < p.threshold - p.tolerance:
            cluster, similarity = Cluster(report_id, submission, error, first=at, last=at), 1.0
            self.clusters[report_id] = cluster
        else:
            similarity, cluster = best
            cluster.submission = submission if cluster.submission is None else cluster.submission
            cluster.error = error if cluster.error is None else cluster.error
        cluster.members.append((report_id, session, at, unit, min(1.0, max(-1.0, similarity))))
        self.refresh(cluster)
        if not p.single_max:
            self.reconcile(at, submission, error)
        return next((c.id for c in self.clusters.values() if any(m[0] == report_id for m in c.members)), None)

    def refresh(self, c: Cluster) -> None:
        import numpy as np

        p = self.policy
        last = max(m[2] for m in c.members)
        inside = [m for m in c.members if m[2] >= last - self.window]
        c.first, c.last = min(m[2] for m in inside), last
        c.raw, c.sessions = len(inside), len({m[1] for m in inside})
        if c.status == "CANDIDATE" and c.sessions >= p.min_sessions:
            c.status = "SIGNAL_DETECTED"
        elif c.status == "SIGNAL_DETECTED" and c.sessions < p.min_sessions:
            c.status = "CANDIDATE"
        ordered = sorted(inside, key=lambda m: m[0])
        units = np.array([m[3] for m in ordered])
        means = units @ units.sum(axis=0) / len(units)
        c.representative = ordered[int(np.flatnonzero(means >= means.max() - 1e-12)[0])][0]

    def reconcile(self, anchor: int, submission, error) -> None:
        import numpy as np

        p = self.policy
        near = {}
        for c in self.clusters.values():
            if c.status in ("CANDIDATE", "SIGNAL_DETECTED") and c.first <= anchor + self.window and c.last >= anchor - self.window:
                if _same(c.submission, submission) and _same(c.error, error):
                    units = [m[3] for m in c.members if abs(m[2] - anchor) <= self.window]
                    if units:
                        near[c.id] = np.array(units)
        while len(near) > 1:
            best = None
            ids = sorted(near)
            for i, a in enumerate(ids):
                for b in ids[i + 1 :]:
                    left, right = self.clusters[a], self.clusters[b]
                    if _same(left.submission, right.submission) and _same(left.error, right.error):
                        score = float(near[a].mean(axis=0) @ near[b].mean(axis=0))
                        if best is None or score > best[0] + p.tolerance:
                            best = (score, a, b)
            if best is None or best[0] < p.threshold - p.tolerance:
                return
            _, a, b = best
            target, source = self.clusters[a], self.clusters.pop(b)
            target.members += source.members
            target.submission = source.submission if target.submission is None else target.submission
            target.error = source.error if target.error is None else target.error
            near[a] = np.concatenate([near[a], near.pop(b)])
            self.closed.append((b, a))
            self.refresh(target)


def arrival_clusters(sims, order, threshold: float, merging: bool = False) -> list[list[int]]:
    """The evaluator's clustering by arrival: join the first best cluster by mean similarity, else open one; optionally merge."""
    import numpy as np

    clusters: list[list[int]] = []
    for i in order:
        scores = [float(np.mean(sims[i, c])) for c in clusters]
        if scores and max(scores) >= threshold:
            clusters[scores.index(max(scores))].append(i)
        else:
            clusters.append([i])
        while merging:
            found = next(
                ((a, b) for a in range(len(clusters)) for b in range(a + 1, len(clusters)) if float(sims[np.ix_(clusters[a], clusters[b])].mean()) >= threshold),
                None,
            )
            if found is None:
                break
            clusters[found[0]] += clusters.pop(found[1])
    return clusters
