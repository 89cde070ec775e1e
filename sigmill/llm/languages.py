"""Operator 5: language identification by multilingual mixture inference.

Training counts byte trigrams of words for each language over all training
documents (partial counts in tasks, summed by Spark). A document's words are
drawn from a mixture of languages: expectation-maximisation estimates the
proportions from the words' trigram likelihoods, and the set of languages is
the one with the largest likelihood less half a logarithm of the word count
for each language. The prediction is the set's largest proportion; the score is
that language's share when all languages may take part.

Defined cases: a text that is null or has no letter is `und` with score 0; rows
with a null doc_id are never learned from; repeated rows are judged alike;
without any training language every text is `und`. A text over `PIECE` bytes is
read in pieces cut between words, and its words with equal likelihoods are one,
so memory follows its different words, not its length. Up to `MAX_DENSE`
languages the model is a full table; more, as dirty labels bring, are held as
the cells that training saw, with the same results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, utf8

BUCKETS = 1 << 16
SMOOTH = 0.5
ROUNDS = 8
#: Languages up to which the model is a full table of BUCKETS numbers each.
MAX_DENSE = 128
PIECE = 1 << 20
UNDETERMINED = "und"

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(texts: list[bytes]):
    """(trigram buckets, trigrams in each word, words in each text)."""
    import numpy as np

    begins, parts, at = [], [b"  "], 2
    for text in texts:
        begins.append(at)
        parts += [text.translate(_LETTERS), b" "]
        at += len(text) + 1
    a = np.frombuffer(b"".join(parts), np.uint8).copy()
    # Capital Latin-1 letters in UTF-8: C3 80..9E, but for the sign 97.
    capital = (a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] <= 0x9E) & (a[1:] != 0x97)
    a[1:][capital] += 32
    letter = a != 32
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    sizes = np.flatnonzero(letter[:-1] & ~letter[1:]) + 2 - starts
    keep = np.flatnonzero(letter[1:] | letter[:-1]) + 1
    last, middle, first = a[keep].astype(np.uint32), a[keep - 1].astype(np.uint32), a[keep - 2].astype(np.uint32)
    first[middle == 32] = 32
    hashed = ((first << 16 | middle << 8 | last) * np.uint32(2654435761)) >> np.uint32(16)
    words = np.diff(np.searchsorted(starts, [*begins, len(a)]))
    return hashed.astype(np.int64), sizes, words


def pieces(text: bytes) -> list[bytes]:
    """The text in pieces of about PIECE bytes, cut at ASCII bytes that are no letters."""
    out, at = [], 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and _LETTERS[text[end]] != 32:
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _grouped(texts: list[bytes]):
    """Runs of consecutive texts of about PIECE bytes together, as (first, last + 1)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


class Likelihoods:
    """Log-probabilities of trigram buckets in each language: a full table, or the seen cells over each language's least value."""

    def __init__(self, least, cells, dense: bool):
        """least: the log-probability of an unseen bucket in each language; cells: (bucket, language, log-probability) arrays."""
        import numpy as np

        self.least, self.dense = np.asarray(least, np.float32), dense
        bucket, language, value = cells
        order = np.lexsort((language, bucket))
        bucket, self.language = bucket[order], language[order].astype(np.int32)
        self.above = (value[order] - self.least[self.language]).astype(np.float32)
        self.cuts = np.searchsorted(bucket, np.arange(BUCKETS + 1))
        if dense:
            self.table = np.tile(self.least, (BUCKETS, 1))
            self.table[bucket, self.language] = value[order]

    def words(self, hashed, sizes):
        """Scores (words x languages): sums over the words' trigrams."""
        import numpy as np

        begins = np.cumsum(sizes) - sizes
        if self.dense:
            return np.add.reduceat(self.table[hashed], begins, axis=0) if len(sizes) else np.zeros((0, len(self.least)), np.float32)
        out = sizes[:, None] * self.least.astype(np.float64)
        counts = self.cuts[hashed + 1] - self.cuts[hashed]
        at = np.repeat(self.cuts[hashed], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        np.add.at(out, (np.repeat(np.repeat(np.arange(len(sizes)), sizes), counts), self.language[at]), self.above[at])
        return out.astype(np.float32)


def fit(docs: DataFrame, max_dense: int = MAX_DENSE):
    """(languages, (least, cells, dense)) from the training rows of docs: what Likelihoods is made of."""
    import numpy as np

    train = docs.filter(F.col("lang").isNotNull() & (crc_mod("doc_id", 5) != 0)).select("text", "lang")

    def count(batches):
        import numpy as np
        import pyarrow as pa

        def rows(totals):
            for lang, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([*at.tolist(), -1], pa.int32()), pa.array([*total[at].tolist(), 0])], ["lang", "bucket", "n"])

        totals: dict = {}
        for batch in batches:
            texts = utf8(batch, "text")
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            by_lang: dict = {}
            for t, k in zip(texts, langs, strict=True):
                by_lang.setdefault(k, []).extend(pieces(t))
            for lang, cut in by_lang.items():
                if lang not in totals:
                    if len(totals) >= 64:  # of many languages a task holds a few tables at a time
                        yield from rows(totals)
                        totals = {}
                    totals[lang] = np.zeros(BUCKETS, np.int64)
                for i, j in _grouped(cut):
                    totals[lang] += np.bincount(trigrams(cut[i:j])[0], minlength=BUCKETS)
        yield from rows(totals)

    # A row of bucket -1 stands for each language, also for one whose texts have no letter.
    counted = train.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique().tolist())
    place = {x: i for i, x in enumerate(languages)}
    seen = counted[counted["bucket"] >= 0]
    language, bucket, n = seen["lang"].map(place).to_numpy(np.int64), seen["bucket"].to_numpy(np.int64), seen["n"].to_numpy(np.float64)
    total = np.bincount(language, n, len(languages)) + SMOOTH * BUCKETS
    return languages, (np.log(SMOOTH / total), (bucket, language, np.log((n + SMOOTH) / total[language])), len(languages) <= max_dense)


def _mixture(scores, words, allowed, weights=None, rounds: int = ROUNDS):
    """EM proportions and log-likelihood of each text; scores: rows x languages, allowed: texts x languages, weights: words of each row."""
    import numpy as np

    owner = np.repeat(np.arange(len(words)), words)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    weights = np.ones(len(scores), np.float32) if weights is None else weights
    whole = np.add.reduceat(weights, first)[:, None]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds + 1):
        with np.errstate(divide="ignore"):
            joint = scores + np.log(share)[owner].astype(np.float32)
        top = joint.max(axis=1, keepdims=True)
        part = np.exp(joint - top)
        total = part.sum(axis=1, keepdims=True)
        likelihood = np.add.reduceat(weights * (top + np.log(total))[:, 0].astype(np.float64), first)
        used = share
        share = np.add.reduceat(part / total * weights[:, None], first, axis=0) / whole
    return used, likelihood


def infer(scores, words, weights=None):
    """(place of the language, score, size of the language set) for each text; every text has words.

    scores: rows x languages, words: rows of each text, weights: how many equal words a row stands for.
    """
    import numpy as np

    n, k = len(words), scores.shape[1]
    weights = np.ones(len(scores), np.float32) if weights is None else weights
    free, likelihood = _mixture(scores, words, np.ones((n, k)), weights)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    alone = np.add.reduceat(scores.astype(np.float64) * weights[:, None], first, axis=0)
    best = alone.argmax(axis=1)
    price = 0.5 * np.log(np.maximum(np.add.reduceat(weights.astype(np.float64), first), 2))
    value, size = alone.max(axis=1) - price, np.ones(n, np.int64)
    # A set of two or more pays at least two prices and explains no more than all languages together.
    open_ = np.flatnonzero(likelihood - 2 * price > value)
    rank = np.argsort(-free, axis=1, kind="stable")
    for m in range(2, k + 1):
        if not len(open_):
            break
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, rank[open_, :m], 1.0, axis=1)
        rows = np.concatenate([np.arange(first[t], first[t] + words[t]) for t in open_])
        share, found = _mixture(scores[rows], words[open_], allowed, weights[rows])
        better = found - m * price[open_] > value[open_]
        at = open_[better]
        value[at], size[at] = (found - m * price[open_])[better], m
        best[at] = share[better].argmax(axis=1)
        open_ = open_[likelihood[open_] - (m + 1) * price[open_] > value[open_]]
    return best, free[np.arange(n), best], size


def _distinct(scores, weights):
    """Equal rows once, with their weights summed."""
    import numpy as np

    rows, place = np.unique(scores, axis=0, return_inverse=True)
    return rows, np.bincount(place.ravel(), weights, len(rows)).astype(np.float32)


def predict(docs: DataFrame, languages: list[str], model) -> DataFrame:
    """(doc_id, lang_pred, score, n_langs) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, model))
    docs = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, parts = shared.value
        logs = Likelihoods(*parts) if names else None

        def scored(texts):
            hashed, sizes, words = trigrams(texts)
            return logs.words(hashed, sizes), words

        def of_long(text):
            """The different words' scores and how often they stand, piece after piece."""
            held, weights = np.zeros((0, len(names)), np.float32), np.zeros(0, np.float32)
            for piece in pieces(text):
                scores, _ = scored([piece])
                held, weights = _distinct(np.concatenate([held, scores]), np.concatenate([weights, np.ones(len(scores), np.float32)]))
            return held, np.array([len(held)]), weights

        for batch in batches:
            texts = utf8(batch, "text")
            wanted = [i for i, x in enumerate(batch.column(2).to_pylist()) if x and names]
            lang, score, size = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0] * len(texts)
            for i, j in _grouped([texts[w] for w in wanted]):
                group = wanted[i:j]
                found = of_long(texts[group[0]]) if len(group) == 1 and len(texts[group[0]]) > PIECE else scored([texts[w] for w in group])
                for w, b, s, m in zip(group, *(x.tolist() for x in infer(*found)), strict=True):
                    lang[w], score[w], size[w] = names[b], min(1.0, max(0.0, s)), m
            arrays = [batch.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "n_langs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_langs int")
