"""Scores of slides against the templates of one unit, as arrays: the formulas of ``matching`` inside a task.

A unit is what one key brings together: its templates come first, in order of family and first id, and are held as arrays;
the slides that ask for them stream past in blocks, and of each block only the k best of each family are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# Score weights and archetype bonus.
STRUCTURE_WEIGHT, STYLE_WEIGHT, SAME_ARCHETYPE = 0.78, 0.22, 0.08
#: Scores of a block, and rows of a batch that is handed on.
BLOCK, BATCH = 120_000, 5_000
#: Pairs of a unit that is scored with others at once, and pairs and rows of what is scored at once.
FEW, MANY, ROWS = 200_000, 400_000, 20_000
#: Style scores by common colours and colours of both, six at most on either side.
STYLES = np.array([[min(1.0, common / max(union, 1)) if union else 1.0 for union in range(16)] for common in range(8)]).ravel()
#: Fills the rows of signatures with fewer template slides than others.
MISSING = np.iinfo(np.int64).min
#: Fields of a match: signature, template slide, and scores in millionths.
MATCH = {"sig": "bigint", "template_slide_id": "bigint", "confidence": "int", "structure": "int", "style": "int"}


def _micro(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e6 + 0.5)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _lists(column: pa.Array, width: int, empty: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Lists of whole numbers as rows of one width, and how long each is."""
    sizes = _numbers(column.value_lengths().fill_null(0)).astype(np.int64)
    out = np.full((len(sizes), max(width, int(sizes.max(initial=0)))), empty, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = _numbers(column.flatten())
    return out, sizes


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


class Slides:
    """Rows of features, archetype and colours."""

    def __init__(self, batch: pa.RecordBatch, features: list[str]):
        self.features = np.stack([_numbers(batch.column(f)) for f in features])
        self.archetype = _numbers(batch.column("archetype"))
        self.colors, self.n_colors = _lists(batch.column("colors"), 1)


class Templates:
    """Rows of templates, by unit, family and first id."""

    def __init__(self, batches: list[pa.RecordBatch], features: list[str]):
        batch = _joined(batches)
        self.slides = Slides(batch, features)
        self.sig, self.families = (_numbers(batch.column(n)) for n in ("sig", "family_id"))
        self.members, _ = _lists(batch.column("members"), 1, MISSING)

    def fields(self, place: np.ndarray, score: np.ndarray, structure: np.ndarray, style: np.ndarray, k: int) -> list[np.ndarray]:
        """The fields of matches: rows of templates' places and their scores, best first; a score of -1 where there are fewer."""
        sig, ids = self.sig[place], self.members[place]
        parts = [_micro(p).astype(np.int64) for p in (structure, style)]
        if ids.shape[2] == 1:
            return [sig, ids[:, :, 0], score, *parts]
        # Copies of a signature share its scores.
        sig, score, *parts = (np.repeat(x, ids.shape[2], axis=1) for x in (sig, score, *parts))
        ids = ids.reshape(len(ids), -1)
        return ordered([sig, ids, np.where(ids == MISSING, -1, score), *parts], k)


class Unit:
    """The templates of a unit of many pairs, with the holders of each colour."""

    def __init__(self, batches: list[pa.RecordBatch], features: list[str], k: int):
        self.templates, self.k = Templates(batches, features), k
        self.slides, families = self.templates.slides, self.templates.families
        starts = np.flatnonzero(np.r_[True, families[1:] != families[:-1]])
        self.families = dict(zip(families[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(families)], strict=True), strict=True))
        own = np.arange(self.slides.colors.shape[1]) < self.slides.n_colors[:, None]
        flat, at = self.slides.colors[own], np.nonzero(own)[0]
        order = np.argsort(flat, kind="stable")
        self.holders = at[order]
        self.palette, first = np.unique(flat[order], return_index=True)
        self.bounds = np.r_[first, len(flat)]

    def common(self, asked: Slides, rows: np.ndarray, low: int, high: int) -> np.ndarray:
        """Numbers of common colours; only the colours of the block's slides are looked up."""
        colors = asked.colors[rows]
        named = np.arange(colors.shape[1]) < asked.n_colors[rows][:, None]
        wanted = np.intersect1d(np.unique(colors[named]), self.palette, assume_unique=True)
        has = np.zeros((len(wanted) + 1, high - low), np.int8)
        for n, place in enumerate(np.searchsorted(self.palette, wanted).tolist()):
            held = self.holders[self.bounds[place]:self.bounds[place + 1]]
            has[n, held[np.searchsorted(held, low):np.searchsorted(held, high)] - low] = 1
        if not len(wanted):
            return np.zeros((len(rows), high - low), np.int8)
        place = np.minimum(np.searchsorted(wanted, colors), len(wanted) - 1)
        place = np.where(named & (wanted[place] == colors), place, len(wanted))
        out = has[place[:, 0]]
        for slot in range(1, int(asked.n_colors[rows].max())):
            out += has[place[:, slot]]
        return out

    def scores(self, asked: Slides, rows: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Confidence in millionths, structure and style of slides against the templates from ``low`` to ``high``."""
        total, spare = None, np.empty((2, len(rows), high - low))
        for own, theirs in zip(asked.features, self.slides.features, strict=True):
            a, b = own[rows][:, None], theirs[low:high]
            if (b == b[0]).all():
                alike = np.maximum(0.0, 1.0 - np.abs(a - b[:1]) / np.maximum(np.maximum(np.abs(a), np.abs(b[:1])), 1.0))
            else:
                alike, scale = spare
                np.abs(np.subtract(a, b, out=alike), out=alike)
                alike /= np.maximum(np.maximum(np.abs(a), 1.0), np.abs(b), out=scale)
                np.maximum(np.subtract(1.0, alike, out=alike), 0.0, out=alike)
            if total is None or total.shape[1] < alike.shape[1]:
                total = alike + (0.0 if total is None else total)
            else:
                total += alike
        total = total / float(len(asked.features))
        kinds = self.slides.archetype[low:high]
        same = asked.archetype[rows][:, None] == (kinds[:1] if (kinds == kinds[0]).all() else kinds)
        structure = np.minimum(1.0, total + np.where(same, SAME_ARCHETYPE, 0.0))
        common = self.common(asked, rows, low, high)
        union = (asked.n_colors[rows].astype(np.int8)[:, None] + self.slides.n_colors[low:high].astype(np.int8)) - common
        style = STYLES.take(common * np.int8(16) + union)
        confidence = STRUCTURE_WEIGHT * structure + STYLE_WEIGHT * style
        return _micro(confidence), np.broadcast_to(structure, style.shape), style

    def best(self, asked: Slides, rows: np.ndarray, low: int, high: int) -> list[np.ndarray]:
        """The fields of the k best matches of each row among the templates from ``low`` to ``high``."""
        confidence, structure, style = self.scores(asked, rows, low, high)
        width = high - low
        # The place makes ties go to the first id; both fit a double exactly.
        rank = confidence * width + np.arange(width - 1, -1, -1.0)
        if width > self.k:
            rank = np.partition(rank, width - self.k, axis=1)[:, width - self.k:]
        rank = -np.sort(-rank, axis=1)
        score, place = np.divmod(rank.astype(np.int64), width)
        place = width - 1 - place
        structure, style = (np.take_along_axis(part, place, axis=1) for part in (structure, style))
        return self.templates.fields(place + low, score, structure, style, self.k)


def ordered(fields: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of each row, by confidence and then template slide."""
    order = np.lexsort((fields[1], -fields[2]))[:, :k]
    return [np.take_along_axis(f, order, axis=1) for f in fields]


def merged(new: list[np.ndarray], held: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of both; signatures that are in both count once, with all their template slides."""
    again = ((held[0][:, :, None] == new[0][:, None, :]) & (new[2][:, None, :] >= 0)).any(axis=2)
    held = [held[0], held[1], np.where(again, -1, held[2]), *held[3:]]
    return ordered([np.concatenate(both, axis=1) for both in zip(new, held, strict=True)], k)


def _wanted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of asking rows with each family they want, and the rows that want all there are and name none."""
    wanted, n_wanted = _lists(batch.column("wanted"), 1)
    return (np.repeat(np.arange(len(wanted)), n_wanted), wanted[np.arange(wanted.shape[1]) < n_wanted[:, None]],
            np.flatnonzero(_numbers(batch.column("wanted").is_null())))


def _held(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    held = batch.column("held")
    return [_lists(pa.ListArray.from_arrays(held.offsets, held.values.field(f)), k)[0][:, :k] for f in MATCH]


def _out(batch: pa.RecordBatch, names: list[str], rows: np.ndarray, families: np.ndarray, fields: list[np.ndarray]) -> pa.RecordBatch:
    there = fields[2] >= 0
    offsets = pa.array(np.r_[0, np.cumsum(there.sum(axis=1))], pa.int32())
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    matches = pa.StructArray.from_arrays([pa.array(f[there], t) for f, t in zip(fields, kinds, strict=True)], [*MATCH])
    carried = batch.select(["source_sig", *names, "archetype", "colors", "level", "turn"]).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*carried.columns, pa.array(families, pa.int64()), pa.ListArray.from_arrays(offsets, matches)],
                                      [*carried.schema.names, "family_id", "matches"])


def answers(unit: Unit, batch: pa.RecordBatch, names: list[str], k: int) -> Iterator[pa.RecordBatch]:
    """Each asking row and wanted family with its best matches so far, block by block."""
    asked, held = Slides(batch, names), _held(batch, k)
    rows, families, free = _wanted(batch)
    rows = np.r_[rows, np.repeat(free, len(unit.families))]
    families = np.r_[families, np.tile(np.fromiter(unit.families, np.int64), len(free))]
    for family in np.unique(families).tolist():
        mine = rows[families == family]
        low, high = unit.families.get(family, (0, 0))
        step = max(1, BLOCK // max(1, high - low))
        for block in (mine[a:a + step] for a in range(0, len(mine), step)):
            own = [h[block] for h in held]
            if high > low:
                fields = unit.best(asked, block, low, high)
                own = merged(fields, own, k) if (own[2] >= 0).any() else fields
            yield _out(batch, names, block, np.full(len(block), family), own)


def _common(left: Slides, a: np.ndarray, right: Slides, b: np.ndarray) -> np.ndarray:
    """Numbers of common colours of pairs of rows."""
    own, theirs = (np.arange(x.colors.shape[1]) < x.n_colors[:, None] for x in (left, right))
    palette = np.intersect1d(left.colors[own], right.colors[theirs])
    if not len(palette):
        return np.zeros(len(a), np.int8)
    out = np.zeros(len(a), np.int8)
    for start in range(0, len(palette), 64):
        part = palette[start:start + 64]
        bits = []
        for x, named in ((left, own), (right, theirs)):
            place = np.minimum(np.searchsorted(part, x.colors), len(part) - 1)
            bits.append(np.bitwise_or.reduce(np.where(named & (part[place] == x.colors), np.uint64(1) << place.astype(np.uint64), np.uint64(0)), axis=1))
        out += np.bitwise_count(bits[0][a] & bits[1][b]).astype(np.int8)
    return out


def answers_of_many(units: list[tuple[list[pa.RecordBatch], pa.RecordBatch]], names: list[str], k: int) -> pa.RecordBatch:
    """As ``answers`` for many units of few pairs: all their pairs are scored and sorted at once.

    Rows that name several families name all that are offered.
    """
    batch = _joined([asks for _, asks in units])
    rows, families, free = _wanted(batch)
    held = _held(batch, k)
    offered = [t for templates, _ in units for t in templates]
    if not offered:
        return _out(batch, names, rows, families, [h[rows] for h in held])
    asked, templates = Slides(batch, names), Templates(offered, names)
    n_templates = np.array([sum(map(len, t)) for t, _ in units])
    n_asks = [len(a) for _, a in units]
    each, first = np.repeat(n_templates, n_asks), np.repeat(np.cumsum(n_templates) - n_templates, n_asks)
    begin = np.cumsum(each) - each
    a = np.repeat(np.arange(len(batch)), each)
    b = np.arange(len(a)) - np.repeat(begin - first, each)
    known, kind = np.unique(templates.families, return_inverse=True)
    only = np.full(len(batch), -1)
    single = np.bincount(rows, minlength=len(batch))[rows] == 1
    only[rows[single]] = np.where(np.isin(families[single], known), np.searchsorted(known, families[single]), len(known))
    fits = (only[a] < 0) | (only[a] == kind[b])
    if not fits.all():
        a, b = a[fits], b[fits]

    total = np.zeros(len(a))
    for own, theirs in zip(asked.features, templates.slides.features, strict=True):
        x, y = (own, theirs[0]) if (theirs == theirs[0]).all() else (own[a], theirs[b])
        alike = np.maximum(0.0, 1.0 - np.abs(x - y) / np.maximum(np.maximum(np.abs(x), np.abs(y)), 1.0))
        total += alike if len(alike) == len(a) and x is not own else alike[a]
    bonus = np.where(asked.archetype[a] == templates.slides.archetype[b], SAME_ARCHETYPE, 0.0)
    structure = np.minimum(1.0, total / float(len(names)) + bonus)
    common = _common(asked, a, templates.slides, b)
    style = STYLES.take(common * np.int64(16) + (asked.n_colors[a] + templates.slides.n_colors[b] - common))
    score = _micro(STRUCTURE_WEIGHT * structure + STYLE_WEIGHT * style).astype(np.int64)

    # Rows with the families they find, then all they want.
    group = a * len(known) + kind[b]
    order = np.lexsort((b, -score, group))
    group = group[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][:len(group)])
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    of_free = np.isin(group[starts] // len(known), free)
    rows = np.r_[rows, group[starts][of_free] // len(known)]
    families = np.r_[families, known[group[starts][of_free] % len(known)]]
    there = np.isin(families, known)
    asking = np.where(there, rows * len(known) + np.searchsorted(known, families), -1)
    by = np.argsort(asking, kind="stable")
    best = rank < k
    at = by[np.searchsorted(asking[by], group[best])]
    place, scores, structures, styles = (np.zeros((len(rows), k), t) for t in (np.int64, np.int64, float, float))
    scores[:] = -1
    for out, values in ((place, b), (scores, score), (structures, structure), (styles, style)):
        out[at, rank[best]] = values[order[best]]
    fields = templates.fields(place, scores, structures, styles, k)
    own = [h[rows] for h in held]
    return _out(batch, names, rows, families, merged(fields, own, k) if (own[2] >= 0).any() else fields)


def answering(names: list[str], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over rows sorted by ``key``, ``part`` and ``asks``: the templates of a unit, then the rows that ask for them."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, templates, unit, few, pairs, size = None, [], None, [], 0, 0
        for batch in batches:
            place = np.stack([_numbers(batch.column(n)).astype(np.int64) for n in ("key", "part", "asks")])
            starts = np.flatnonzero(np.r_[True, (place[:, 1:] != place[:, :-1]).any(axis=0)][:len(batch)])
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)][:len(starts)], strict=True):
                rows = batch.slice(start, end - start)
                if current != (own := (place[0, start], place[1, start])):
                    current, templates, unit = own, [], None
                if not place[2, start]:
                    templates.append(rows)
                    continue
                n = sum(map(len, templates))
                if n * len(rows) > FEW:
                    unit = unit or Unit(templates, names, k)
                    yield from answers(unit, rows, names, k)
                    continue
                few.append((templates, rows))
                pairs, size = pairs + n * len(rows), size + n + len(rows)
                if pairs >= MANY or size >= ROWS:
                    yield answers_of_many(few, names, k)
                    few, pairs, size = [], 0, 0
        if few:
            yield answers_of_many(few, names, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in found(batches):
            out.append(batch)
            size += len(batch)
            if size >= BATCH:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, size = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run
