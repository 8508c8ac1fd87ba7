"""Exact cut rows of global orders without sorting the table.

A quantile needs one row, not an order of all rows. Rows are ordered by a value (NULL is the
smallest) and, where values tie, by a unique text id. The row at a wanted place is found by
counting:

1. one scan gives number, sum and range of every wanted value and of the ids;
2. one scan counts the rows of ``BINS`` equal parts of each range. Prefix sums say which
   part holds the wanted place; its range is the next one, for all wanted rows at once;
3. a range of a single value goes on with the id, six bytes at a time as a number;
4. ranges of at most ``LEAF`` rows are read.

Every scan is combined map-side, so the driver gets at most ``BINS`` rows of counts per
wanted row whatever the size of the table, and there is no shuffle of rows, no range
partitioning and no written copy. A scan cuts a range by ``BINS``, so the number of scans
follows from the digits of the values, not from the number of rows. Labels are then
comparisons with the cut rows (:func:`after`).

The table is read several times: stage it. A *share* is the first row at which the running
sum of the value reaches a part of the total; its values must not be negative.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
LEAF = 2000
CHUNK = 6                                   # bytes of an id in one number
NUMBER = "decimal(38,6)"


@dataclass(frozen=True)
class Tiles:
    """Last rows of the first ``k - 1`` of ``k`` tiles (NTILE) in the order of ``value``."""
    value: str
    k: int
    ascending: bool = True


@dataclass(frozen=True)
class Share:
    """First row at which the running sum of ``value``, greatest first, reaches ``part`` of the total."""
    value: str
    part: Decimal
    ascending: bool = False


@dataclass(frozen=True)
class Cut:
    """A row's value and id, and its place in the order (from 1)."""
    value: Decimal | None
    id: str
    place: int


@dataclass(frozen=True)
class _Goal:
    spec: int
    slot: int
    place: int | None                       # wanted place ...
    weight: Decimal | None                  # ... or running sum


@dataclass(frozen=True)
class _Open:
    """Rows that hold wanted places: those that meet ``fixed`` and whose next number, the value
    (level 0) or a part of the id, lies in a range."""
    spec: int
    fixed: Column | None
    level: int
    goals: tuple[_Goal, ...]
    count: int
    place: int                              # rows and sum before these
    weight: Decimal
    low: Decimal | None                     # None: the range is not known yet
    high: Decimal | None


def tile_ends(n: int, k: int) -> list[int]:
    """Last place of each of the first ``k - 1`` tiles: the first ``n % k`` hold one row more."""
    return [i * (n // k) + min(i, n % k) for i in range(1, k)]


def _id_part(id_col: str, level: int) -> Column:
    part = F.substring(F.col(id_col).cast("binary"), CHUNK * (level - 1) + 1, CHUNK)
    return F.conv(F.rpad(F.hex(part), 2 * CHUNK, "0"), 16, 10).cast(NUMBER)


def _key(specs, id_col: str, o: _Open, parts: int) -> Column:
    if o.level == 0:
        return F.col(specs[o.spec].value).cast(NUMBER)
    if o.level <= parts:
        return _id_part(id_col, o.level)
    return F.octet_length(F.col(id_col)).cast(NUMBER)       # ids that differ in trailing zero bytes


def _rows(specs, id_col: str, o: _Open, parts: int) -> tuple[Column, Column]:
    """The next number of an open range's rows, and the condition of being one of them."""
    key = _key(specs, id_col, o, parts)
    inside = None if o.low is None else key.between(F.lit(o.low), F.lit(o.high))
    both = [c for c in (o.fixed, inside) if c is not None]
    return key, both[0] if len(both) == 1 else both[0] & both[1]


def _counts(df: DataFrame, specs, id_col: str, opens: list[_Open], parts: int) -> dict[int, list]:
    """Per open range its filled bins: (bin, rows, sum, least and greatest number)."""
    hits = []
    for j, o in enumerate(opens):
        key, where = _rows(specs, id_col, o, parts)
        b = F.lit(0)
        if o.low is not None:
            step = (key.cast("double") - float(o.low)) * (BINS / max(float(o.high - o.low), 1e-6))
            b = F.least(F.floor(step).cast("int"), F.lit(BINS - 1))
        weight = F.col(specs[o.spec].value).cast(NUMBER) if isinstance(specs[o.spec], Share) else F.lit(None).cast(NUMBER)
        hits.append(F.when(where, F.struct(F.lit(j).alias("o"), b.alias("b"), key.alias("k"), weight.alias("w"))))
    rows = (df.select(F.explode(F.array(*hits)).alias("h")).filter("h is not null").groupBy("h.o", "h.b")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("h.w").alias("w"), F.min("h.k").alias("low"), F.max("h.k").alias("high"))
            .collect())                                      # at most BINS rows per open range
    out: dict[int, list] = {j: [] for j in range(len(opens))}
    for r in rows:
        out[r["o"]].append((r["b"], r["n"], r["w"] or Decimal(0), r["low"], r["high"]))
    return out


def _narrowed(specs, id_col: str, o: _Open, bins: list, parts: int) -> list[_Open]:
    """The bins of an open range that hold its goals."""
    down = o.level == 0 and not specs[o.spec].ascending
    key = _key(specs, id_col, o, parts)
    found: list[_Open] = []
    waiting = list(o.goals)
    place, weight = o.place, o.weight
    for _, n, w, low, high in sorted(bins, key=lambda r: r[0], reverse=down):
        here = tuple(g for g in waiting if (place + n >= g.place if g.place is not None else weight + w >= g.weight))
        if here and low == high:                             # one number: go on with the next
            if o.level > parts and n > LEAF:
                raise ValueError(f"{id_col} is not unique")
            same = key == F.lit(low)
            found.append(_Open(o.spec, same if o.fixed is None else o.fixed & same, o.level + 1, here, n, place, weight, None, None))
        elif here:
            found.append(_Open(o.spec, o.fixed, o.level, here, n, place, weight, low, high))
        waiting = [g for g in waiting if g not in here]
        place, weight = place + n, weight + w
    return found


def _read(df: DataFrame, specs, id_col: str, leaves: list[_Open], parts: int) -> dict[tuple[int, int], Cut]:
    """Wanted rows of small ranges, whose rows are read (at most ``LEAF`` each)."""
    hits = [F.when(_rows(specs, id_col, o, parts)[1],
                   F.struct(F.lit(j).alias("o"), F.col(specs[o.spec].value).cast(NUMBER).alias("v"), F.col(id_col).alias("id")))
            for j, o in enumerate(leaves)]
    rows: dict[int, list] = {}
    for r in df.select(F.explode(F.array(*hits)).alias("h")).filter("h is not null").select("h.*").collect():
        rows.setdefault(r["o"], []).append((r["v"], r["id"]))
    out = {}
    for j, o in enumerate(leaves):
        sign = 1 if specs[o.spec].ascending else -1
        place, weight = o.place, o.weight
        for v, i in sorted(rows[j], key=lambda r: (sign * (r[0] or 0), r[1].encode())):
            place, weight = place + 1, weight + (v or 0)
            for g in o.goals:
                if (g.spec, g.slot) not in out and (place == g.place if g.place is not None else weight >= g.weight):
                    out[g.spec, g.slot] = Cut(v, i, place)
    return out


def cut_rows(df: DataFrame, id_col: str, specs: list[Tiles | Share]) -> list[list[Cut | None]]:
    """For every spec its cut rows in order (one for a share; None where there is no such
    row). ``id_col`` is a text that is unique and not NULL."""
    first_part = _id_part(id_col, 1)
    facts = [F.count(F.lit(1)), F.max(F.octet_length(id_col)), F.min(first_part), F.max(first_part)]
    for spec in specs:
        v = F.col(spec.value).cast(NUMBER)
        facts += [F.count(v), F.sum(v), F.min(v), F.max(v)]
    n, longest, *ids = df.agg(*[f.alias(f"f{k}") for k, f in enumerate(facts)]).first()
    id_range, ranges = tuple(ids[:2]), [tuple(ids[k:k + 4]) for k in range(2, len(ids), 4)]
    parts = -(-(longest or 0) // CHUNK)
    opens: list[_Open] = []
    out: list[list[Cut | None]] = []
    for s, (spec, (filled, total, low, high)) in enumerate(zip(specs, ranges, strict=True)):
        if isinstance(spec, Share):
            goals = [_Goal(s, 0, None, total * spec.part)] if filled else []
            out.append([None])
        else:
            goals = [_Goal(s, i, p, None) for i, p in enumerate(tile_ends(n, spec.k)) if p]
            out.append([None] * (spec.k - 1))
        nulls = n - filled                                   # NULL is the smallest value
        in_null = tuple(g for g in goals if g.place is not None and (g.place <= nulls if spec.ascending else g.place > filled))
        rest = tuple(g for g in goals if g not in in_null)
        if in_null:
            opens.append(_Open(s, F.col(spec.value).isNull(), 1, in_null, nulls, 0 if spec.ascending else filled, Decimal(0), *id_range))
        if rest:
            opens.append(_Open(s, None, 0, rest, filled, nulls if spec.ascending else 0, Decimal(0), low, high))
    leaves: list[_Open] = []
    while opens:
        opens = [replace(o, low=id_range[0], high=id_range[1]) if o.level == 1 and o.low is None else o for o in opens]
        leaves += [o for o in opens if o.count <= LEAF]
        opens = [o for o in opens if o.count > LEAF]
        if opens:
            bins = _counts(df, specs, id_col, opens, parts)
            opens = [x for j, o in enumerate(opens) for x in _narrowed(specs, id_col, o, bins[j], parts)]
    if leaves:
        for (s, slot), cut in _read(df, specs, id_col, leaves, parts).items():
            out[s][slot] = cut
    return out


def after(value: str, id_col: str, ascending: bool, cut: Cut) -> Column:
    """Does a row come after the cut row? (NULL values first when ascending, last otherwise.)"""
    v, later = F.col(value).cast(NUMBER), F.col(id_col) > F.lit(cut.id)
    if cut.value is None:
        return (v.isNotNull() | later) if ascending else (v.isNull() & later)
    c = F.lit(cut.value).cast(NUMBER)
    if ascending:
        return F.coalesce((v > c) | ((v == c) & later), F.lit(False))
    return F.coalesce((v < c) | ((v == c) & later), F.lit(True))


def tile(value: str, id_col: str, ascending: bool, cuts: list[Cut | None]) -> Column:
    """Number of a row's tile, from the last rows of the tiles before the last."""
    out = F.lit(1).cast("bigint")
    for c in cuts:
        if c is not None:
            out = out + after(value, id_col, ascending, c).cast("bigint")
    return out
