"""Language identification with bit-sliced Bloom filters over character n-grams.

One table of cells holds the filters of all languages: bit L of a cell belongs to language L.  Looking up an n-gram
reads a few cells and ANDs them, which gives the set of languages that contain it.  A text's hits are counted per
language (popcounts of the bit slices), the expected false hits of each filter are taken off, and the language with
the most hits left wins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordspans as ws

N = 4
#: An n-gram enters a language's filter from this share of the language's n-grams on.  Shares add up to 1, so a
#: filter holds at most 1 / MIN_SHARE n-grams whatever the corpus: the bound of what is collected and broadcast.
MIN_SHARE = 2e-6
#: ... and from this part of the largest share it has in any language, so that foreign passages teach nothing.
DOMINANCE = 0.2
PROBES = 3
BITS_PER_GRAM = 12
UNKNOWN = "und"

_A = ws.U64(0x9FB21C651E98DF25)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter; the code point of its lower case (itself where that is not one character)."""
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha() and unicodedata.category(char)[0] == "L":
            letter[code] = True
            small = char.lower()
            if len(small) == 1:
                lower[code] = ord(small)
    return letter, lower


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts run together, and n + 1 offsets; bytes that are not UTF-8 become U+FFFD."""
    buf, offs = ws.text_buffers(texts)
    raw = buf.tobytes()
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        parts = [raw[a:b].decode(errors="replace") for a, b in zip(offs, offs[1:])]
        text, at = "".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    else:
        heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        at = heads[offs]
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), at


def grams(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all n-grams, n + 1 offsets per text, has a letter) of lower-case letters with single spaces between words."""
    code, offs = code_points(texts)
    letter, lower = _letters()
    is_letter = letter[code]
    any_letter = np.diff(np.concatenate([[0], np.cumsum(is_letter)])[offs]) > 0
    small = np.where(is_letter, lower[code], np.uint32(0x20))
    # A space before every text, then runs of spaces become one.
    small = np.insert(small, offs[:-1], np.uint32(0x20))
    offs = offs + np.arange(len(offs))
    small = np.append(small, np.uint32(0x20))
    space = small == 0x20
    start = np.zeros(len(small), bool)
    start[offs[:-1]] = True
    keep = ~space
    keep[0] = True
    keep[1:] |= ~space[:-1]
    keep |= start
    at = np.concatenate([[0], np.cumsum(keep)])[offs]
    small = small[keep].astype(np.uint64)
    if len(small) < n:
        return np.zeros(0, ws.U64), np.zeros(len(offs), np.int64), any_letter
    hashed = small[: len(small) - n + 1].copy()
    for k in range(1, n):
        hashed = hashed * _A + small[k : len(small) - n + 1 + k]
    counts = np.maximum(np.diff(at) - n + 1, 0)
    return ws.mix(hashed[ws.ragged_range(at[:-1], counts)]), np.concatenate([[0], np.cumsum(counts)]), any_letter


@dataclass
class Filters:
    """Languages, one table of cells for every 64 of them, and each filter's rate of false hits."""

    languages: list[str]
    tables: list[np.ndarray]
    false_rate: np.ndarray

    def lookup(self, hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The set of languages that contain each n-gram, as a bitmask."""
        top = ws.U64(len(table) - 1)
        step = (hashes >> ws.U64(32)) | ws.U64(1)
        mask = table[hashes & top]
        for k in range(1, PROBES):
            mask &= table[(hashes + ws.U64(k) * step) & top]
        return mask

    def corrected_hits(self, hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Hits of every text (rows) in every language (columns) less the expected false ones."""
        seen = np.diff(offs)
        out = np.zeros((len(seen), len(self.languages)))
        for t, table in enumerate(self.tables):
            mask = self.lookup(hashes, table)
            for bit in range(min(64, len(self.languages) - 64 * t)):
                hit = (mask >> table.dtype.type(bit)) & table.dtype.type(1)
                total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                out[:, 64 * t + bit] = np.diff(total[offs])
        return np.maximum(out - seen[:, None] * self.false_rate, 0) / (1 - self.false_rate)


def build_filters(languages: list[str], gram: np.ndarray, language: np.ndarray) -> Filters:
    """``gram[i]`` belongs to ``languages[language[i]]``."""
    largest = max([1, *np.bincount(language, minlength=len(languages)).tolist()])
    cells = 1 << int(np.ceil(np.log2(max(1024, largest * BITS_PER_GRAM))))
    tables = []
    for low in range(0, max(1, len(languages)), 64):
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= min(64, len(languages) - low))
        table = np.zeros(cells, kind)
        step = (gram >> ws.U64(32)) | ws.U64(1)
        for bit, code in enumerate(range(low, min(low + 64, len(languages)))):
            own = language == code
            for k in range(PROBES):
                table[(gram[own] + ws.U64(k) * step[own]) & ws.U64(cells - 1)] |= kind(1 << bit)
        tables.append(table)
    fill = np.array([np.mean((tables[c // 64] >> tables[c // 64].dtype.type(c % 64)) & tables[c // 64].dtype.type(1)) for c in range(len(languages))])
    return Filters(languages, tables, np.minimum(fill**PROBES, 0.99))


def _count(text: str, label: str, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ws.chunks(batch, text):
                hashes, offs, _ = grams(piece.column(text), n)
                labels = piece.column(label).dictionary_encode()
                of_gram = np.repeat(labels.indices.to_numpy(), np.diff(offs))
                for code, name in enumerate(labels.dictionary.to_pylist()):
                    found, counts = np.unique(hashes[of_gram == code], return_counts=True)
                    yield pa.record_batch([pa.array(found.view(np.int64)), pa.array([name] * len(found), pa.string()), pa.array(counts)], names=["gram", "lang", "n"])

    return run


def learn_filters(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", n: int = N) -> Filters:
    """Filters from all rows with a language: n-grams are counted in Spark, only the frequent ones are collected."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(text_col, F.col(lang_col).alias("_lang"))
    counts = rows.mapInArrow(_count(text_col, "_lang", n), "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    from .tables import cut_lineage

    counts = cut_lineage(counts)
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals)
    if not languages:
        return build_filters([], np.zeros(0, ws.U64), np.zeros(0, np.int64))
    share = F.col("n") / F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(float(totals[k])))]), F.col("lang"))
    found = counts.select("gram", "lang", share.alias("share")).filter(F.col("share") >= MIN_SHARE).toArrow()
    gram = found["gram"].to_numpy().view(np.uint64)
    code = pc.index_in(found["lang"], pa.array(languages)).to_numpy().astype(np.int64)
    part = found["share"].to_numpy()
    order = np.argsort(gram, kind="stable")
    gram, code, part = gram[order], code[order], part[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    most = np.repeat(np.maximum.reduceat(part, first), np.diff(np.append(first, len(gram)))) if len(gram) else part
    own = part >= DOMINANCE * most
    return build_filters(languages, gram[own], code[own])


def _predict(text: str, keep: bool, fit: bool, schema: pa.Schema, filters: Callable[[], Filters], n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters()
        names = np.array([*known.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for piece in ws.chunks(batch, text):
                hashes, offs, any_letter = grams(piece.column(text), n)
                if known.languages:
                    hits = known.corrected_hits(hashes, offs)
                    best = hits.argmax(axis=1)
                    most = hits[np.arange(len(hits)), best]
                    near = most / np.maximum(np.diff(offs), 1)
                    hits[np.arange(len(hits)), best] = 0
                    total = most + hits.max(axis=1)
                    score = np.divide(most, total, out=np.zeros(len(most)), where=total > 0)
                else:
                    best, score, near = np.zeros(len(any_letter), np.int64), np.zeros(len(any_letter)), np.zeros(len(any_letter))
                best = np.where(any_letter & (len(known.languages) > 0), best, len(known.languages))
                score = np.where(any_letter, score, 0.0)
                drop = piece.schema.get_field_index(text)
                columns = [c for i, c in enumerate(piece.columns) if keep or i != drop]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(score), *[pa.array(near)] * fit], schema=schema)

    return run


def identify(docs: DataFrame, filters: Filters, *, carry: list[str], text_col: str = "text", n: int = N, fit: bool = False) -> DataFrame:
    """``carry`` and the text's ``lang_pred`` and ``score`` (best language's hits among the best two languages').

    A null text and one without a letter are ``und`` with score 0, and so is every text if nothing was learned.  A
    text with letters but without a known n-gram (or shorter than one) gets the first language with score 0.
    With ``fit``, ``fit`` is the best language's corrected hits per n-gram of the text (0 without one).
    Repeated rows give repeated rows.  Carried columns may be null; their names must not be lang_pred, score or fit.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shared = docs.sparkSession.sparkContext.broadcast(filters)
    keep = text_col in carry
    text = text_col if keep else "_text"
    rows = docs.select(*carry) if keep else docs.select(*carry, F.col(text_col).alias(text))
    out = StructType([*rows.select(*carry).schema.fields, *StructType.fromDDL("lang_pred string, score double" + ", fit double" * fit).fields])
    return rows.mapInArrow(_predict(text, keep, fit, to_arrow_schema(out), lambda: shared.value, n), out)


def least_fits(labelled: DataFrame, filters: Filters, *, text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """The bound on ``fit`` of every language: half of what all but a hundredth of its own labelled documents reach.

    All rows with a language count that get it as their prediction; one number a language comes back.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("_lang"), text_col)
    own = identify(rows, filters, carry=["_lang"], text_col=text_col, fit=True).filter(F.col("_lang") == F.col("lang_pred"))
    return {r["_lang"]: r["low"] / 2 for r in own.groupBy("_lang").agg(F.percentile_approx("fit", 0.01, 10000).alias("low")).collect()}


def fits_language(bounds: dict[str, float]) -> Column:
    """Does a row of :func:`identify` with ``fit`` have hits, and as many as its language asks for."""
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), F.col("lang_pred")) if bounds else F.lit(0.0)
    return (F.col("lang_pred") != UNKNOWN) & (F.col("fit") > 0) & (F.col("fit") >= F.coalesce(bound, F.lit(0.0)))
