"""Operator 2: toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its
distinct words (as 32-bit hashes), and the document's probability of being
toxic is the noisy-or of its sentences. Only document labels are given; the
gradient of the document loss reaches every sentence through the noisy-or, and
each step sums the gradients of all partitions. The fitted sentence scores then
locate the offending sentences.

Weights go to the words whose document counts depart from the share of toxic
documents by `MIN_Z` deviations, the others keep weight zero: a rare word of
one toxic document can't explain its label.

The classifier is fitted on about `max_train` labelled documents, chosen by
hashed ids; scoring covers every document and whole texts.

Defined cases: a null or empty text counts as one sentence without words; ids
with several labels are toxic if one label is; a null label is no label; rows
with a null doc_id are scored, never learned from, and count as held out;
repeated rows are scored alike; without any usable label a sentence scores about 0.5^20.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc_mod, utf8

MAX_TRAIN = 16_000
STEPS = 60
RATE = 0.6
#: A weighted word stands in at least so many toxic or so many times as many clean documents, and departs so far.
MIN_DOCUMENTS = 3
MIN_Z = 4.0
MAX_FEATURES = 20_000
PARTITIONS = 6
THRESHOLD = 0.7

#: Sentences end at . ! ? and line ends; other bytes as for words.
_SENTENCE_BYTES = bytes(
    10 if b in b".!?\n\r" else b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_SENTENCE = re.compile(r"[^.!?\n\r]+")


def sentences(text: bytes) -> list[list[bytes]]:
    """The words of each sentence that has any; one empty sentence if none has."""
    found = [s.split() for s in text.translate(_SENTENCE_BYTES).split(b"\n")]
    return [s for s in found if s] or [[]]


def bucket(word: bytes) -> int:
    """Signed 32-bit hash of a word."""
    return (zlib.crc32(word) ^ 0x80000000) - 0x80000000


@dataclass
class Model:
    """Sentence logit: bias plus the weights of its distinct words' buckets."""

    bias: float
    weights: dict[int, float]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def weight(self, word: bytes) -> float:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = self.memo[word] = self.model.weights.get(bucket(word), 0.0)
        return got

    def sentence(self, tokens: list[bytes]) -> float:
        """Logit of one sentence."""
        return self.model.bias + sum(map(self.weight, set(tokens)))

    def document(self, text: bytes) -> float:
        import numpy as np

        logits = np.array([self.sentence(s) for s in sentences(text)])
        return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of about max_train labelled documents whose crc32 remainder by 3 is not 1.

    Where there are more, those whose hashed id lies below the matching share are taken.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & (crc_mod("doc_id", 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = max_train / max(1, usable.count())
    if share < 1:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("text", "toxic")


def _features(batches):
    import pyarrow as pa

    for batch in batches:
        sizes, ids = [], []
        for text in utf8(batch, "text"):
            bags = [sorted({bucket(w) for w in s}) for s in sentences(text)]
            sizes.append([len(b) for b in bags])
            ids.append([i for b in bags for i in b])
        at = batch.schema.get_field_index("toxic")
        yield pa.RecordBatch.from_arrays(
            [batch.column(at).cast(pa.int32()), pa.array(sizes, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32()))],
            ["toxic", "sizes", "ids"],
        )


def bag_gradient(weights, bias, toxic, sizes, ids):
    """(bias gradient, weight gradient) of the summed noisy-or log loss; sizes: one array of sentence sizes per document."""
    import numpy as np

    per_doc = np.array([len(s) for s in sizes])
    flat = np.concatenate(sizes)
    ends = np.cumsum(flat)
    sums = np.concatenate([[0.0], np.cumsum(weights[ids])])
    logits = np.clip(bias + sums[ends] - sums[ends - flat], -40, 40)
    p = 1 / (1 + np.exp(-logits))
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    log_clean = -np.add.reduceat(np.logaddexp(0, logits), first)
    doc_p = np.clip(-np.expm1(log_clean), 1e-9, 1)
    factor = np.where(toxic == 1, -(1 - doc_p) / doc_p, 1.0)
    slope = np.repeat(factor, per_doc) * p
    return slope.sum(), np.bincount(ids, np.repeat(slope, flat), len(weights))


def select(bags: DataFrame, max_features: int = MAX_FEATURES) -> list[int]:
    """The words (hashes) that get a weight: the strongest departures, at most max_features."""
    totals = bags.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    if not 0 < totals.p < totals.n:
        return []
    base = totals.p / totals.n
    words = bags.select("toxic", F.explode(F.array_distinct("ids")).alias("id"))
    counts = words.groupBy("id").agg(F.count("*").alias("n"), F.sum("toxic").alias("p"))
    z = (F.col("p") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
    strong = (z >= MIN_Z) & (F.col("p") >= MIN_DOCUMENTS) | (z <= -MIN_Z) & (F.col("n") >= MIN_DOCUMENTS / base)
    return [r.id for r in counts.filter(strong).orderBy(F.abs(z).desc(), "id").limit(max_features).collect()]


def _narrow(features: list[int]):
    """Keeps the selected words of each bag, as places in `features`."""

    def run(batches):
        import pyarrow as pa

        places = {x: i for i, x in enumerate(features)}
        for batch in batches:
            sizes, ids = [], []
            for size, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, out, at = [], [], 0
                for n in size:
                    found = [places[w] for w in words[at : at + n] if w in places]
                    at += n
                    kept += found
                    out.append(len(found))
                sizes.append(out)
                ids.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32()))],
                ["toxic", "sizes", "ids"],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, steps: int = STEPS) -> Model:
    import numpy as np

    spark = docs.sparkSession
    schema = "toxic int, sizes array<int>, ids array<int>"
    bags = checkpoint(training_rows(docs, labels, max_train).mapInArrow(_features, schema))
    features = select(bags)
    if not features:
        return Model(-20 * float(np.log(2)), {})
    # At most max_train bags of a few words each: few partitions spare the steps their scheduling.
    bags = checkpoint(bags.mapInArrow(_narrow(features), schema).coalesce(PARTITIONS))
    width = len(features)
    weights, bias = np.zeros(width), -6.0
    moment, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        shared = spark.sparkContext.broadcast((weights, bias))

        def gradient(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            w, b = shared.value
            total = np.zeros(len(w) + 2)
            for batch in batches:
                if not batch.num_rows:
                    continue
                size, ids = batch.column(1), batch.column(2)
                cuts = size.offsets.to_numpy()
                flat = size.values.to_numpy()
                sizes = [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                values = ids.values.to_numpy()[ids.offsets[0].as_py() : ids.offsets[-1].as_py()]
                of_bias, of_weights = bag_gradient(w, b, batch.column(0).to_numpy(), sizes, values)
                total += np.concatenate([of_weights, [of_bias, batch.num_rows]])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        # One vector of the features' size from each of the few partitions, in their order, so that reruns agree.
        grad = np.sum([np.frombuffer(row.total) for row in bags.mapInArrow(gradient, "total binary").collect()], axis=0)
        shared.destroy()
        grad = grad[:-1] / grad[-1]
        moment = 0.8 * moment + 0.2 * grad
        square = 0.98 * square + 0.02 * grad**2
        move = RATE * (moment / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.98**step)) + 1e-5)
        weights -= move[:-1]
        bias -= move[-1] / 2
    return Model(float(bias), {x: float(w) for x, w in zip(features, weights, strict=True)})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    docs = docs.select("doc_id", "text")

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            scores = [scorer.document(t) for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the documents that score at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            yield batch.filter(pa.array([scorer.document(t) < threshold for t in utf8(batch, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def locate(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, sentence, score) of each sentence that scores at least the threshold; code points."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    docs = docs.select("doc_id", "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            rows = []
            for i, text in enumerate(utf8(batch, "text")):
                for m in _SENTENCE.finditer(text.decode()):
                    tokens = m.group().encode().translate(_SENTENCE_BYTES).split()
                    p = float(1 / (1 + np.exp(-scorer.sentence(tokens))))
                    if tokens and p >= threshold:
                        rows.append((i, m.start(), m.end(), m.group(), p))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays[0] = batch.column(0).take(arrays[0])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "end", "sentence", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, start long, end long, sentence string, score double")
