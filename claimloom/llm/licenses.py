"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Texts and templates are words of letters and digits, A-Z lower-cased, in shingles of five words.  Templates are put in
classes by size; in the class of ``step`` shingles (a power of two) windows hold 2 * step shingles and start every
step, so any place of a template lies whole in one of them.  A window that contains 80 % of a template's shingles has
a Jaccard similarity of at least 0.4 / 2.1 with it, as the template has more than step / 2 of them.  Bands of one hash
collide with that probability, so 64 bands miss a place with a probability below 2e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordspans as ws

WIDTH, PERCENT, BANDS = 5, 80, 64
# Notices as their licenses word them.
TEMPLATES: Mapping[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Rights reserved": "All rights reserved.",
}

_SEED = ws.mix(np.arange(1, BANDS + 1, dtype=ws.U64) * ws.U64(0x8EBC6AF09C88C6E3))
_XOR, _ODD = (_SEED >> ws.U64(32)).astype(np.uint32), _SEED.astype(np.uint32) | np.uint32(1)
_OUT = "license string, first int, end int, containment double"


@dataclass(frozen=True)
class _Template:
    name: str
    words: int
    width: int
    shingles: np.ndarray
    step: int
    bands: np.ndarray


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = ws.text_buffers(texts)
    buf = ws.LOWER[buf]
    starts, ends, words = ws.spans(buf, offs, ws.ALNUM_WORDS)
    return ws.word_hashes(buf, starts, ends), words


def _prepare(templates: Mapping[str, str]) -> list[_Template]:
    out = []
    for name, text in templates.items():
        hashed, _ = _words(pa.array([text]))
        if len(hashed):
            width = min(WIDTH, len(hashed))
            own = np.unique(ws.window_hashes(hashed, width))
            step = 1 << (len(own) - 1).bit_length()
            out.append(_Template(name, len(hashed), width, own, step, ((own.astype(np.uint32)[:, None] ^ _XOR) * _ODD).min(axis=0)))
    return out


def _window_minima(shingle: np.ndarray, step: int, band: int) -> np.ndarray:
    """Smallest hash of a band in every window of 2 * step shingles that starts at a multiple of step."""
    value = (shingle.astype(np.uint32) ^ _XOR[band]) * _ODD[band]
    blocks = -(-len(value) // step)
    padded = np.full(blocks * step, np.uint32(0xFFFFFFFF))
    padded[: len(value)] = value
    low = padded.reshape(blocks, step).min(axis=1)
    return np.minimum(low, np.append(low[1:], np.uint32(0xFFFFFFFF)))


def _places(shingle: np.ndarray, words: np.ndarray, width: int, known: list[_Template]) -> Iterator[tuple[_Template, int, int, int, float]]:
    """(template, text, first shingle, last shingle, containment) in the shingles of texts run together."""
    for step in sorted({t.step for t in known if t.width == width}):
        group = [t for t in known if t.width == width and t.step == step]
        found: set[tuple[int, int]] = set()
        for band in range(BANDS):
            keys = np.array([t.bands[band] for t in group])
            minima = _window_minima(shingle, step, band)
            for window in np.flatnonzero(np.isin(minima, keys)).tolist():
                found.update((window, k) for k in np.flatnonzero(keys == minima[window]).tolist())
        for window, k in sorted(found):
            own = shingle[window * step : (window + 2) * step]
            at = window * step + np.flatnonzero(np.isin(own, group[k].shingles))
            texts = np.searchsorted(words, at, side="right") - 1
            for text in np.unique(texts).tolist():  # a window may hold the end of one text and the start of the next
                part = at[texts == text]
                share = len(np.unique(shingle[part])) / len(group[k].shingles)
                if 100 * share >= PERCENT:
                    yield group[k], text, int(part[0]), int(part[-1]), share


def _scan(known: list[_Template], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ws.chunks(batch, "_text"):
                hashed, words = _words(piece.column("_text"))
                best: dict[tuple[int, str], list[list]] = {}
                for width in sorted({t.width for t in known}):
                    # Shingles that run over the end of a text become ones that no template has, each another.
                    shingle = ws.window_hashes(hashed, width)
                    over = np.ones(len(shingle), bool)
                    over[ws.window_starts(words, width)] = False
                    shingle[over] = ws.mix(np.flatnonzero(over).astype(ws.U64) + ws.U64(1 << 40))
                    for t, row, first, last, share in _places(shingle, words, width, known) if len(shingle) else ():
                        spans = best.setdefault((row, t.name), [])
                        span = [first - int(words[row]), last - int(words[row]) + width, share]
                        if spans and span[0] < spans[-1][1]:
                            if share > spans[-1][2]:
                                spans[-1] = span
                        else:
                            spans.append(span)
                rows = [(row, name, *span) for (row, name), spans in best.items() for span in spans]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema) if i > 0)], schema=schema)

    return run


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every place of a license notice: id, ``license``, its [first, end) words and the ``containment``
    (share of the template's shingles there, 0.8 at least).

    A template of fewer than five words is one shingle.  Of overlapping places of one template the best is returned;
    places of different templates may overlap.  Null and empty texts have none; repeated rows repeat theirs.
    Templates are an argument that the caller bounds; they go to the tasks with the code.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = docs.select(id_col, F.col(text_col).alias("_text"))
    out = StructType([rows.schema[id_col], *StructType.fromDDL(_OUT).fields])
    return rows.mapInArrow(_scan(_prepare(templates), to_arrow_schema(out)), out)
