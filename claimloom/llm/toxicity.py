"""Toxicity by compression distance: how much shorter windows of a text get when toxic text may be copied from too.

Two zstandard dictionaries are trained on whole windows of labelled texts: one on ordinary documents, one on toxic
ones.  A window is compressed once with the ordinary dictionary and once with both; the bytes saved say how toxic its
wording is.  Windows are written word by word as a ladder of beginnings ("tr tra tras trash"), so that a stem that
only toxic texts have costs several copies of it, whatever ending it has.

A document's score comes from its windows' compressed lengths alone: a logistic fit over the largest, mean and median
saving, the number and share of windows that save at least so many bytes, and the lengths' sums.  The fit sees every
labelled document through dictionaries that it did not teach (cross-fitting in ``FOLDS`` parts), so that what
dictionaries know by heart does not pass for what they generalise; its intercept is that of all labelled documents.

Dictionaries and fit are learned from a bounded sample of the labelled documents, chosen by a hash of their ids; of
each one the whole text teaches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordspans as ws
from .tables import cut_lineage

#: The bound of the sample: documents of each label.
MAX_TOXIC, MAX_ORDINARY = 1000, 3000
#: Parts of the sample; each is measured with dictionaries that the others taught.
FOLDS = 3
# Chosen by cross-validation among the documents to learn from.
WINDOW_WORDS = 16
ORDINARY_BYTES, TOXIC_BYTES = 24576, 4096
BEGINNINGS = range(2, 7)
#: Calibrated thresholds on the bytes a window saves: for numbers of windows and for shares of them.
NUMBERS, SHARES = (0, 2, 4, 6, 8, 10, 14), (-4, -2, 0, 2, 4, 6)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Toxicity:
    """Dictionary contents, and mean, scale and weights of the fit.  Without weights every score is ``prior``."""

    ordinary: bytes
    toxic: bytes
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.0


class _Ladders(dict):
    """Beginnings of words; forgotten when there are too many."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 200_000:
            self.clear()
        plain = word.strip(".,;:!?#")
        ends = range(min(BEGINNINGS[0], len(plain)), min(BEGINNINGS[-1], len(plain)) + 1)
        self[word] = found = " ".join(plain[:i] for i in ends).encode(errors="replace")
        return found


_LADDERS = _Ladders()


def windows(text: str | None) -> list[bytes]:
    """Runs of ``WINDOW_WORDS`` words, lower-cased, as ladders; a text without words is one empty window."""
    words = [_LADDERS[w] for w in _WORD.findall((text or "").lower())]
    return [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)] or [b" "]


@cache
def _compressors(ordinary: bytes, toxic: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    out = []
    for content in (ordinary, toxic + ordinary):
        params = zstandard.ZstdCompressionParameters(compression_level=3, strategy=zstandard.STRATEGY_LAZY2, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(zstandard.ZstdCompressor(dict_data=data, compression_params=params))
    return out[0], out[1]


def lengths(text: str | None, model: Toxicity) -> np.ndarray:
    """(bytes, compressed with the ordinary dictionary, compressed with both) of every window."""
    plain, both = _compressors(model.ordinary, model.toxic)
    return np.array([(len(w), len(plain.compress(w)), len(both.compress(w))) for w in windows(text)], float)


def features(text: str | None, model: Toxicity) -> list[float]:
    size, plain, both = lengths(text, model).T
    saved = np.sort(plain - both)[::-1]
    n = len(saved)
    return [1.0, np.log(n), np.log(size.sum() + 1), saved[0], saved[min(1, n - 1)], saved[min(3, n - 1)], saved.mean(), np.median(saved), saved[: max(1, n // 4)].mean(),
            saved[0] - np.median(saved), saved.std(), *(np.log1p((saved >= t).sum()) for t in NUMBERS), *((saved >= t).mean() for t in SHARES),
            saved.sum() / plain.sum(), np.log(plain.sum() / size.sum()), saved.sum() / np.sqrt(size.sum())]


def score(rows: np.ndarray, model: Toxicity) -> np.ndarray:
    if not model.weights:
        return np.full(len(rows), model.prior)
    return 1 / (1 + np.exp(-np.clip(((rows - model.centre) / model.scale) @ np.array(model.weights), -500, 500)))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(size, samples * max(1, min(50, 100_000 // max(1, total))), k=64 if size == ORDINARY_BYTES else 32, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:] or b" " * 8


def train(toxic: list[str], ordinary: list[str]) -> Toxicity:
    """Dictionaries from the windows of toxic and ordinary texts; copies of a text teach once, and order does not matter."""
    parts = [[w for text in sorted(set(texts)) for w in windows(text)] for texts in (ordinary, toxic)]
    return Toxicity(_dictionary(parts[0], ORDINARY_BYTES), _dictionary(parts[1], TOXIC_BYTES))


def sample_shift(n_toxic: int, n_ordinary: int) -> float:
    """What the sample's caps take off the log odds of the toxic label, given the documents of each label."""
    return float(np.log(max(1, n_toxic / MAX_TOXIC)) - np.log(max(1, n_ordinary / MAX_ORDINARY)))


def fit(model: Toxicity, rows: np.ndarray, toxic: np.ndarray, shift: float = 0.0) -> Toxicity:
    """Logistic weights by Newton steps with a ridge; the share of toxic rows where only one label is there.

    ``shift`` corrects the intercept to the share of toxic documents among all that the rows were sampled from.
    """
    if len(rows) == 0 or toxic.min() == toxic.max():
        return replace(model, prior=float(toxic.mean()) if len(rows) else 0.0)
    centre, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    centre[0], scale[0] = 0, 1
    x, w, ridge = (rows - centre) / scale, np.zeros(rows.shape[1]), np.eye(rows.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - toxic) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    w[0] += shift
    return replace(model, centre=tuple(centre.tolist()), scale=tuple(scale.tolist()), weights=tuple(w.tolist()))


def _train_group(table: pa.Table) -> pa.Table:
    """Dictionaries of one model from the documents that teach it: a part of the bounded sample."""
    groups: dict[bool, list[str]] = {True: [], False: []}
    for toxic, text in zip(table["toxic"].to_pylist(), table["text"].to_pylist()):
        groups[toxic].append(text or "")
    model = train(groups[True], groups[False])
    return pa.table({"model": table["model"].slice(0, 1).combine_chunks(), "ordinary": pa.array([model.ordinary], pa.binary()), "toxic": pa.array([model.toxic], pa.binary())})


def _featured(models: Callable[[], list[Toxicity]], n: int, schema: pa.Schema, scored: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = models()
        for batch in batches:
            for piece in ws.chunks(batch, "_text"):
                rows = np.array([features(t, known[m]) for t, m in zip(piece.column("_text").to_pylist(), piece.column("_model").to_pylist())])
                last = pa.array(score(rows, known[0])) if scored else pa.array(list(rows), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*piece.columns[:n], last], schema=schema)

    return run


def _apply(docs: DataFrame, models: list[Toxicity], carry: list[str], text_col: str, scored: bool, model_col=None) -> DataFrame:
    """``carry`` and the score, or the features by the model that ``model_col`` names."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shared = docs.sparkSession.sparkContext.broadcast(models)
    rows = docs.select(*carry, F.col(text_col).alias("_text"), (F.lit(0) if model_col is None else model_col).alias("_model"))
    out = StructType([*rows.drop("_text", "_model").schema.fields, *StructType.fromDDL("score double" if scored else "features array<double>").fields])
    return rows.mapInArrow(_featured(lambda: shared.value, len(carry), to_arrow_schema(out), scored), out)


def learn_toxicity(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); the caller chooses the rows to learn from.

    Rows without an id or a label teach nothing; of several labels of a document the highest counts.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    pick = known.filter("toxic").orderBy(order).limit(MAX_TOXIC).unionByName(known.filter("NOT toxic").orderBy(order).limit(MAX_ORDINARY))
    labelled = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    fold = (F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string")).cast("binary")) % FOLDS).cast("int")
    sample = cut_lineage(docs.select("doc_id", "text").join(cut_lineage(pick), "doc_id").withColumn("fold", fold))
    # A document teaches the final model (0) and those of the other parts (1 and up).
    taught = sample.withColumn("model", F.explode(F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda m: m != F.col("fold") + 1)))
    found = taught.select("model", "toxic", "text").groupBy("model").applyInArrow(_train_group, "model int, ordinary binary, toxic binary").collect()
    models = [Toxicity(b"", b"")] * (FOLDS + 1)
    for r in found:
        models[r["model"]] = Toxicity(bytes(r["ordinary"]), bytes(r["toxic"]))
    rows = _apply(sample, models, ["doc_id", "toxic"], "text", False, F.col("fold") + 1).orderBy("doc_id", "features").toArrow()
    return fit(models[0], np.array(rows["features"].to_pylist() or np.zeros((0, 1)), float), rows["toxic"].to_numpy().astype(float),
               sample_shift(labelled.get(True, 0), labelled.get(False, 0)))


def score_toxicity(docs: DataFrame, model: Toxicity, *, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` and ``score`` (0 to 1, higher: likelier toxic) of every text; null and empty texts are one empty window.

    If nothing was learned the score is the learned share of toxic documents (0 without any).  Rows keep their
    partitions; repeated rows give repeated rows.
    """
    return _apply(docs, [model], carry, text_col, True)
