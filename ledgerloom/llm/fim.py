"""Fill-in-middle transformation by displacement scatter.

A text is cut into lines (each with its line end) at two places drawn from a hash of its identifier; prefix, middle and
suffix are put in the order of one of two forms, after markers. Many texts are moved at once, as one byte array:

1. a scan finds the line ends, so the cuts become byte places;
2. every piece has one displacement between its place in the input and in the output. The differences of neighbouring
   pieces' displacements are added where the pieces begin, and their running sum gives every byte its shift;
3. one numpy scatter writes all texts, a second one all markers;
4. the inverse finds the markers in the outputs, gives every byte of the restored texts its shift in the same way and
   gathers them.

Documents stream through ``mapInPandas``: no shuffle, and a task holds about ``STEP_BYTES`` of text at a time, or one text.

Defined results: null or empty text is an empty text of form plain; a text that contains a marker is plain, so markers in
an output are always ours; a null identifier hashes as the empty string; rows with equal identifiers are cut alike;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship_package

#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = len(PREFIX)
STEP_BYTES = 4 << 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"], object)
#: Order in the output of the pieces prefix (0), middle (1) and suffix (2).
ORDER = {PSM: (0, 2, 1), SPM: (2, 0, 1)}


@dataclass(frozen=True)
class Rule:
    """How cuts and forms are drawn: the seed, and shares in per cent of texts transformed and of those of form spm."""

    seed: int = 7
    rate: int = 100
    spm: int = 50

    def draws(self, doc_id: str | None) -> tuple[int, int, int, int]:
        digest = hashlib.sha256(f"{self.seed}:{doc_id or ''}".encode()).hexdigest()
        return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))  # type: ignore[return-value]


def shifts(begin: np.ndarray, displacement: np.ndarray, size: int) -> np.ndarray:
    """The displacement of each of ``size`` bytes, from those of pieces by rising begin; of pieces at one place the last holds."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, begin, np.diff(displacement, prepend=0))
    return np.cumsum(step[:-1])


def layout(bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(output bounds of the texts, output begin of each piece, output place of each piece's marker).

    ``bounds`` holds for each text the places where prefix, middle, suffix begin and where it ends.
    """
    size = np.diff(bounds, axis=1)
    total = size.sum(1) + np.where(form == PLAIN, 0, 3 * MARK)
    out = np.concatenate([[0], np.cumsum(total)])
    begin = np.empty_like(size)
    plain = form == PLAIN
    begin[plain] = bounds[plain, :3] - bounds[plain, :1] + out[:-1][plain, None]
    for kind, order in ORDER.items():
        mine = form == kind
        at = out[:-1][mine].copy()
        for piece in order:
            at += MARK
            begin[mine, piece] = at
            at += size[mine, piece]
    return out, begin, begin - MARK


def cut_places(data: np.ndarray, edge: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of lines, bounds of the pieces) of the texts that lie between the edges."""
    end = np.flatnonzero(data == 10)
    first, last = np.searchsorted(end, edge[:-1]), np.searchsorted(end, edge[1:])
    size = np.diff(edge)
    closed = np.zeros(len(size), bool)
    closed[size > 0] = data[edge[1:][size > 0] - 1] == 10
    lines = last - first + ((size > 0) & ~closed)
    low, high = np.sort(draws[:, :2] % (lines + 1)[:, None], axis=1).T
    bounds = np.empty((len(size), 4), np.int64)
    bounds[:, 0], bounds[:, 3] = edge[:-1], edge[1:]
    for column, cut in ((1, low), (2, high)):
        line_end = first + cut - 1
        inside = (cut > 0) & (line_end < last)
        bounds[:, column] = np.where(cut == 0, edge[:-1], edge[1:])
        bounds[inside, column] = end[line_end[inside]] + 1
    return lines, bounds


def transform_texts(texts: list[bytes], draws: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(lines, form, code points of the prefix, of the middle, output) of each text."""
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    lines, bounds = cut_places(data, edge, draws)
    marked = np.array([PREFIX in t or SUFFIX in t or MIDDLE in t for t in texts], bool)
    plain = (np.diff(edge) == 0) | marked | (draws[:, 2] % 100 >= rule.rate)
    form = np.where(plain, PLAIN, np.where(draws[:, 3] % 100 < rule.spm, SPM, PSM))
    out_edge, begin, mark = layout(bounds, form)
    out = np.empty(out_edge[-1], np.uint8)
    out[np.arange(len(data)) + shifts(bounds[:, :3].ravel(), (begin - bounds[:, :3]).ravel(), len(data))] = data
    moved = form != PLAIN
    for piece, sign in enumerate((PREFIX, MIDDLE, SUFFIX)):
        out[mark[moved, piece, None] + np.arange(MARK)] = np.frombuffer(sign, np.uint8)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[bounds[:, 1:3]] - points[bounds[:, :2]]
    made = out.tobytes()
    return lines, form, chars[:, 0], chars[:, 1], [made[a:b] for a, b in zip(out_edge[:-1].tolist(), out_edge[1:].tolist(), strict=True)]


def restore_texts(outputs: list[bytes], form: np.ndarray) -> list[bytes]:
    """The texts that outputs of the given forms came from."""
    joined = b"".join(outputs)
    data = np.frombuffer(joined, np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(t) for t in outputs], dtype=np.int64)])
    # Where each piece begins and ends in the output; plain texts are all prefix.
    begin, end = np.repeat(edge[:-1, None], 3, axis=1), np.repeat(edge[:-1, None], 3, axis=1)
    end[:, 0] = edge[1:]
    begin[:, 1:], end[:, 1:] = edge[1:, None], edge[1:, None]
    if len(data) >= MARK:
        signs = (data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2])
        place = {k: np.flatnonzero(signs & (data[1:-1] == sign[1])) for k, sign in enumerate((PREFIX, MIDDLE, SUFFIX))}
        for kind, order in ORDER.items():
            mine = np.flatnonzero(form == kind)
            at = {k: place[k][np.searchsorted(place[k], edge[:-1][mine])] for k in range(3)} if len(mine) else {}
            for k, piece in enumerate(order if len(mine) else ()):
                begin[mine, piece] = at[piece] + MARK
                end[mine, piece] = at[order[k + 1]] if k < 2 else edge[1:][mine]
    size = end - begin
    back = np.concatenate([[0], np.cumsum(size.ravel())])
    total = int(back[-1])
    source = np.arange(total) + shifts(back[:-1], begin.ravel() - back[:-1], total)
    texts = data[source].tobytes() if total else b""
    bound = back[::3].tolist()
    return [texts[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]


def _steps(sizes: list[int]) -> Iterator[slice]:
    """Stretches of rows of about ``STEP_BYTES`` in all."""
    low, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > STEP_BYTES:
            yield slice(low, k)
            low, held = k, 0
        held += size + 64
    if sizes:
        yield slice(low, len(sizes))


TRANSFORMED = "doc_id string, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars and middle_chars (null if plain), output."""
    ship_package(docs.sparkSession)
    drawn = rule or Rule()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].tolist()
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            for cut in _steps([len(t) for t in texts]):
                draws = np.array([drawn.draws(i) for i in ids[cut]], np.int64).reshape(-1, 4)
                lines, form, prefix, middle, out = transform_texts(texts[cut], draws, drawn)
                plain = form == PLAIN
                yield pd.DataFrame({
                    "doc_id": ids[cut], "n": lines, "form": FORMS[form],
                    "prefix_chars": pd.array(prefix, "Int64"), "middle_chars": pd.array(middle, "Int64"),
                    "output": [o.decode("utf-8", "surrogatepass") for o in out],
                }).assign(
                    prefix_chars=lambda f, p=plain: f["prefix_chars"].mask(p), middle_chars=lambda f, p=plain: f["middle_chars"].mask(p)
                )

    # Identifiers travel as text: they are hashed as such, and a null among them would turn them into floating-point numbers.
    made = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, TRANSFORMED)
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def restore(transformed: DataFrame) -> DataFrame:
    """The table with one more column ``restored``: the texts rebuilt from ``output`` and ``form``."""
    ship_package(transformed.sparkSession)

    def run(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        number = {name: k for k, name in enumerate(FORMS)}
        for outputs, forms in series:
            coded = [(o or "").encode("utf-8", "surrogatepass") for o in outputs]
            kinds = np.array([number[f] for f in forms], np.int64)
            back: list[str] = []
            for cut in _steps([len(c) for c in coded]):
                back += [t.decode("utf-8", "surrogatepass") for t in restore_texts(coded[cut], kinds[cut])]
            yield pd.Series(back, dtype=object)

    return transformed.withColumn("restored", F.pandas_udf(run, "string")("output", "form"))
