"""Quantities recorded in different units, brought to common units.

A text states its unit itself, or leaves a bare number whose unit the row's note or the row's source states.
For each source and field, the units of the bare numbers in order of time are the hidden states of a Markov chain:
a number's logarithm is the logarithm of an amount about the field's usual level, less that of its unit, and
units seldom switch. A unit that the source states is certain evidence, which fixes the state; where nothing is
stated, Viterbi decoding tells the unit from the jumps of the logarithms and from the states before and after. Texts
and notes that state a unit speak for their own numbers, not for the source, and so are no part of the chain.

A chain is decoded whole, however long: tasks score its parts from every state to every state, one pass over the
parts' scores finds the states between them, and tasks then trace each part between its two states.

All text work is built-in expressions. The decoder runs only if there are numbers without a stated unit, and
only over the sources and fields that have some.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from platewise.stage import written

#: What units are called (lower case, as patterns) and how much they are of the family's base unit
#: (kcal for energy, g for mass).
ENERGY = {"kcal": (r"kcals?|kilocalories|kilocalorie|calories|calorie|cals?", 1.0), "kJ": (r"kj|kilojoules?", 1 / 4.184)}
MASS = {
    "kg": (r"kg|kilograms?|kilogrammes?", 1000.0),
    "g": (r"g|gr|grams?|grammes?", 1.0),
    "mg": (r"mg|milligrams?|milligrammes?", 1e-3),
    "mcg": (r"mcg|ug|µg|μg|micrograms?|microgrammes?", 1e-6),
    "oz": (r"oz|ounces?", 28.349523125),
}
#: Energy words that name a unit in a note; there "calories" may only name the field.
NOTE_ENERGY = {"kcal": (r"kcals?|kilocalories|kilocalorie", 1.0), "kJ": ENERGY["kJ"]}
#: Unicode fractions with their amounts.
FRACTIONS = {"¼": 0.25, "½": 0.5, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875}

#: Chance that the next number of a source is in the same unit as the last.
STAY = 0.98
#: Days of one source and field, low bits of the rows of numbers without a time, and numbers of these, that make a part of a chain. Results
#: don't depend on them.
CHUNK_DAYS, CHUNK_BITS, HELD = 7, 17, 20_000

_GAP = " \u00a0\u2009\u202f"
_WHOLE = rf"\d+(?:[,{_GAP}]\d{{3}}(?!\d))*"
_NUMBER = rf"(?:(\d+)[{_GAP}]+)?(\d+)/(\d+)|(\d+)?[{_GAP}]?([{''.join(FRACTIONS)}])|({_WHOLE})([.,]\d+)?"
_PERCENT = r"\d+(?:[.,]\d+)?\s*%"
_MARK = "\x01"


@dataclass(frozen=True, eq=False)
class Quantity:
    """One measured field: its column, the words that name it in notes, its units and common unit."""

    field: str
    named: str
    units: dict
    note_units: dict
    common: str

    def factor(self, unit: str) -> float:
        """How much of the common unit one of ``unit`` is."""
        return self.units[unit][1] / self.units[self.common][1]


def _any(units: dict) -> str:
    return "|".join(pattern for pattern, _ in units.values())


def _unit_of(word: Column, units: dict) -> Column:
    """The unit that a word (or null) is, else null."""
    found = F.lit(None).cast("string")
    for name, (pattern, _) in units.items():
        found = F.when(word.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    return found


def own_units(text: Column, units: dict) -> Column:
    """The units that ``text`` names, in order; empty if there are none."""
    pattern = rf"(?<!\p{{L}})(?:{_any(units)})(?!\p{{L}})"
    words = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.transform(words, lambda word: _unit_of(word, units))


def number_parts(text: Column) -> Column:
    """The parts of the first number of ``text`` that is no percentage: of a fraction the whole, numerator and
    denominator; of a fraction sign the whole and the sign; else the whole and the decimals. Of another size
    without a number."""
    clean = F.regexp_replace(text, _PERCENT, " ")
    return F.split(F.regexp_replace(clean, rf"^[\s\S]*?(?:{_NUMBER})[\s\S]*$", _MARK.join(f"${k}" for k in range(1, 8))), _MARK)


def amount(parts: Column) -> Column:
    """The number of :func:`number_parts` as a double; null without one.

    "1,024", "1 024" and "1,024,000" are grouped, "0,45" and "0.45" decimal, and "1/4", "1 1/4", "½" and "1½"
    fractions.
    """
    part = lambda i: F.get(parts, F.lit(i - 1))
    double = lambda s: s.try_cast("double")
    zero = lambda s: F.coalesce(double(F.nullif(s, F.lit(""))), F.lit(0.0))
    sign = F.lit(0.0)
    for mark, value in FRACTIONS.items():
        sign = F.when(part(5) == mark, value).otherwise(sign)
    plain = F.concat(F.regexp_replace(part(6), f"[,{_GAP}]", ""), F.replace(part(7), F.lit(","), F.lit(".")))
    number = (
        F.when(part(3) != "", F.when(double(part(3)) > 0, zero(part(1)) + double(part(2)) / double(part(3))))
        .when(part(5) != "", zero(part(4)) + sign)
        .otherwise(double(plain))
    )
    return F.when(F.size(parts) == 7, number)


def note_unit(note: Column, quantity: Quantity) -> Column:
    """The unit that a free-text note states for the field, else null.

    Understood are "<field> ... <unit>" within a clause and "<unit> for <field>".
    """
    words, low = _any(quantity.note_units), F.lower(note)
    unit = rf"(?<!\p{{L}})({words})(?!\p{{L}})"
    after = F.regexp_extract(low, rf"(?:{quantity.named})\b[^.;,]*?{unit}", 1)
    before = F.regexp_extract(low, rf"{unit}\s+for\s[^.;,]*?(?:{quantity.named})\b", 1)
    return F.coalesce(_unit_of(F.nullif(before, F.lit("")), quantity.note_units), _unit_of(F.nullif(after, F.lit("")), quantity.note_units))


def _factor(quantities: list[Quantity]) -> Column:
    """The factor to the common unit, of the columns field and unit."""
    factor = F.lit(None).cast("double")
    for q in quantities:
        for unit in q.units:
            factor = F.when((F.col("field") == q.field) & (F.col("unit") == unit), q.factor(unit)).otherwise(factor)
    return factor


def _scores(logs: np.ndarray, stated: np.ndarray, shifts: np.ndarray, level: float, spread: float) -> tuple[np.ndarray, float, float]:
    """The score of each state for each value, and those of staying in a state and of switching to another."""
    scores = -0.5 * ((logs[:, None] + shifts - level) / spread) ** 2
    fixed = stated >= 0
    scores[fixed] = -np.inf
    scores[fixed, stated[fixed]] = 0.0
    return scores, log(STAY), log((1 - STAY) / max(1, len(shifts) - 1))


def transfers(logs: np.ndarray, stated: np.ndarray, shifts: np.ndarray, level: float, spread: float) -> np.ndarray:
    """The best score of a sequence from each state before it (rows) to each state at its end (columns)."""
    scores, stay, switch = _scores(logs, stated, shifts, level, spread)
    v = np.where(np.eye(len(shifts), dtype=bool), 0.0, -np.inf)
    for own in scores:
        v = np.maximum(v + stay, v.max(axis=1, keepdims=True) + switch) + own
    return v


def boundaries(parts: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states before and at the end of each part on the best path through all, by the parts' :func:`transfers`."""
    v = np.zeros(len(parts[0]))
    back = []
    for part in parts:
        whole = v[:, None] + part
        back.append(whole.argmax(axis=0))
        v = whole.max(axis=0)
        v = v - v.max()
    state, found = int(v.argmax()), []
    for before in reversed(back):
        found.append((int(before[state]), state))
        state = found[-1][0]
    return found[::-1]


def viterbi(
    logs: np.ndarray, stated: np.ndarray, shifts: np.ndarray, level: float, spread: float, before: np.ndarray | None = None, end: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest states of a sequence of log values, and the scores at its end.

    ``stated`` has the fixed state or -1; ``shifts`` the log factor of each state. ``before`` has the scores at the
    end of what went before, ``end`` the last state if that is known.
    """
    count = len(shifts)
    scores, stay, switch = _scores(logs, stated, shifts, level, spread)
    back = np.empty((len(logs), count), np.int64)
    own = np.arange(count)
    v = np.zeros(count) if before is None else before
    for t in range(len(logs)):
        best = int(v.argmax())
        moved = v[best] + switch
        kept = v + stay
        back[t] = np.where(kept >= moved, own, best)
        v = np.maximum(kept, moved) + scores[t]
        v = v - v.max()
    path = np.empty(len(logs), np.int64)
    state = int(v.argmax()) if end is None else end
    for t in range(len(logs) - 1, -1, -1):
        path[t] = state
        state = back[t, state]
    return path, v


_PART = ("source", "field", "chunk", "part")


def _cut(held: int):
    """Rows of sorted chunks with the part of the chunk that they are in, and their place in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            places = []
            for chunk in zip(*(batch.column(n).to_pylist() for n in _PART[:3])):
                last, at = chunk, at + 1 if chunk == last else 0
                places.append(at)
            found = np.array(places, np.int64)
            columns = [pa.array(found // held), pa.array(found % held)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "part", "place"])

    return run


def _by_part(quantities: list[Quantity], schema: pa.Schema, each):
    """``each`` on the key and the other columns of every part of sorted rows; its records come out as ``schema``."""
    names = {q.field: list(q.units) for q in quantities}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if rows:
                units = names[last[1]]
                stated = np.array([units.index(r[2]) if r[2] is not None else -1 for r in rows])
                out = each(last, units, rows, np.array([r[1] for r in rows]), stated)
                rows.clear()
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

        for batch in batches:
            more = [n for n in ("row", "log", "unit", "entry", "exit") if n in batch.schema.names]
            for source, field, chunk, part, *row in zip(*(batch.column(n).to_pylist() for n in (*_PART, *more))):
                if (source, field, chunk, part) != last:
                    yield from done()
                    last = (source, field, chunk, part)
                rows.append(tuple(row))
        yield from done()

    return run


def decoded_units(evidence: DataFrame, quantities: list[Quantity], stated: DataFrame) -> DataFrame:
    """(row, field, unit) for the rows of ``evidence`` without a unit.

    ``evidence`` is a stage of (row, field, source, at, amount, unit), ``row`` unique: the bare numbers without a note, with the
    unit where the source states one. Levels and spreads of the fields come from ``stated`` (field, amount, unit), all amounts with a
    unit; a field that has none is taken to be in its common unit. Amounts of zero or less tell nothing and are taken
    to be in the common unit.
    """
    # Numbers without a time come first, in the order of their rows, which are cut into chunks too.
    timeless = F.lit(-(1 << 60)) + F.shiftright("row", CHUNK_BITS)
    usable = evidence.filter("amount > 0").withColumn("chunk", F.coalesce(F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / (86_400 * CHUNK_DAYS)), timeless))
    # A row per field.
    known = stated.filter("amount > 0 and unit is not null").withColumn("log", F.log(F.col("amount") * _factor(quantities)))
    stats = known.groupBy("field").agg(F.avg("log").alias("level"), F.stddev_pop("log").alias("spread"))
    levels = {r["field"]: (r["level"], max(r["spread"] or 0.0, 0.1)) for r in stats.filter("level is not null").collect()}
    common = {q.field: q.common for q in quantities}
    shifts = {q.field: np.array([log(q.factor(u)) for u in q.units]) for q in quantities}
    chains = [F.col("source").eqNullSafe(F.col("s")), F.col("field") == F.col("f")]
    open_chains = usable.filter("unit is null").filter(F.col("field").isin(list(levels))).select(F.col("source").alias("s"), F.col("field").alias("f")).distinct()
    sequences = usable.join(open_chains, chains, "left_semi").select("source", "field", "chunk", "at", "row", F.log("amount").alias("log"), "unit")
    ordered = sequences.repartition("source", "field", "chunk").sortWithinPartitions("source", "field", "chunk", "at", "row").drop("at")
    source = evidence.schema["source"].dataType.simpleString()
    key = f"source {source}, field string, chunk long, part long"
    cut = ordered.mapInArrow(_cut(HELD), f"source {source}, field string, chunk long, row long, log double, unit string, part long, place long")
    cut = written(cut, "unit-chains")
    sort = lambda df: df.repartition(*_PART).sortWithinPartitions(*_PART, "place")
    part = [(n, to_arrow_type(cut.schema[n].dataType)) for n in _PART]

    def scored(of, _, rows, logs, fixed):
        return [(*of, transfers(logs, fixed, shifts[of[1]], *levels[of[1]]).ravel().tolist())]

    def between(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chunk", "ascending"), ("part", "ascending")])
        count = len(shifts[table.column("field")[0].as_py()])
        found = boundaries([np.array(x).reshape(count, count) for x in table.column("scores").to_pylist()])
        return table.drop_columns("scores").append_column("entry", pa.array([f[0] for f in found])).append_column("exit", pa.array([f[1] for f in found]))

    def traced(of, units, rows, logs, fixed):
        before = np.full(len(units), -np.inf)
        before[rows[0][3]] = 0.0
        path, _ = viterbi(logs, fixed, shifts[of[1]], *levels[of[1]], before, rows[0][4])
        return [(r[0], of[1], units[k]) for r, k in zip(rows, path) if r[2] is None]

    scores = sort(cut).mapInArrow(_by_part(quantities, pa.schema([*part, ("scores", pa.list_(pa.float64()))]), scored), f"{key}, scores array<double>")
    ends = scores.groupBy("source", "field").applyInArrow(between, f"{key}, entry long, exit long").select(*(F.col(n).alias(f"__{n}") for n in _PART), "entry", "exit")
    bounded = cut.join(ends, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in _PART]).drop(*(f"__{n}" for n in _PART))
    schema = pa.schema([("row", pa.int64()), ("field", pa.string()), ("unit", pa.string())])
    found = sort(bounded).mapInArrow(_by_part(quantities, schema, traced), "row long, field string, unit string")
    default = reduce(lambda c, f: F.when(F.col("field") == f, common[f]).otherwise(c), common, F.lit(None).cast("string"))
    rest = evidence.filter("unit is null").filter(~((F.col("amount") > 0) & F.col("field").isin(list(levels))))
    return found.unionByName(rest.select("row", "field", default.alias("unit")))


def in_common_units(rows: DataFrame, quantities: dict[Quantity, str], key: str, note: str, source: str, at: str) -> DataFrame:
    """(key, field, unit, amount): every amount that isn't in its field's common unit, ``amount`` in that unit.

    ``rows`` has the fields as text, a free-text ``note``, the ``source`` and the time ``at`` of each row, and for each
    quantity a column (its value in ``quantities``) with the unit that the source uses for bare numbers. Of several
    units in a text the first counts. Amounts that the text also gives in the common unit, texts without an amount, and
    null and blank texts give no row. Equal rows count once.
    """
    # Two steps, so that no expression of the first is evaluated once for each use.
    parts = [
        F.struct(
            F.lit(q.field).alias("field"),
            number_parts(F.col(q.field)).alias("parts"),
            own_units(F.col(q.field), q.units).alias("own"),
            note_unit(F.col(note), q).alias("noted"),
            F.col(unit).alias("usual"),
            F.lit(q.common).alias("common"),
        )
        for q, unit in quantities.items()
    ]
    texts = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"), F.col(f"`{at}`").alias("at"), F.inline(F.array(*parts))).filter(F.size("parts") == 7)
    read = texts.withColumn("unit", F.when(F.size("own") > 0, F.get("own", F.lit(0))).otherwise(F.coalesce("noted", "usual"))).withColumn("amount", amount(F.col("parts")))
    other = read.filter("amount is not null and not array_contains(own, common)").select("id", "field", "source", "at", "amount", "unit", "common", (F.size("own").eqNullSafe(0) & F.col("noted").isNull()).alias("bare"))
    # A number counts once, and as a bare one if any text of it is.
    other = other.groupBy("id", "field", "source", "at", "amount", "unit", "common").agg(F.bool_or("bare").alias("bare"))
    evidence = written(other.withColumn("row", F.monotonically_increasing_id()), "unit-evidence")
    stated = evidence.filter("unit is not null")
    if not evidence.filter("unit is null").isEmpty():
        known = read.filter("amount is not null and unit is not null").select("id", "field", "source", "at", "amount", "unit").distinct()
        units = decoded_units(evidence.filter("bare"), list(quantities), known)
        stated = stated.unionByName(evidence.filter("unit is null").drop("unit").join(units, ["row", "field"]))
    cases = stated.filter("unit <> common")
    return cases.select(F.col("id").alias(key), "field", "unit", (F.col("amount") * _factor(list(quantities))).alias("amount"))
