"""Checksum and computed fields: values that follow from other fields of the same batch, filled in after the rows exist.

A formula is one row of the dependency table that spec documents carry: the field it fills, the fields it depends on, its
kind and its text, a Spark SQL expression. Fields are nodes of a dependency graph; the graph's topological order makes
levels, and all formulas of a level that read the same records become one ``select`` or one ``groupBy``:

* ``row``: over fields of the same record (also check digits: ``luhn``, ``aba`` or ``mod97`` of the one field depended on);
* ``total``: an aggregate over all records of another type with the same group, joined back (map-side combined, so a file
  that holds a third of all records is no single task);
* ``copy``: an expression over the one record of another type with the same group, joined back.

Defined cases: a group without records of the other type gets an aggregate over nothing (counts 0, sums null, which ``coalesce`` in the
formula may replace); a null result is an empty field; a formula for a field that the spec does not have, a dependency
that no record has, a name used but not listed as a dependency, and a cycle raise ``ValueError`` before anything runs.
Values wider than their field raise when the rows are computed: a cut total would be a wrong total.
"""

from __future__ import annotations

import graphlib
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions import checks, fixed
from tallyframe.functions.sqltext import q
from tallyframe.sources.layouts import Field, Spec

Node = tuple[str, str]


@dataclass(frozen=True)
class Formula:
    """``depends_on`` names fields as ``name`` (same record) or ``TYPE.name``; ``text`` uses the bare names."""

    record_type: str
    field: str
    depends_on: tuple[str, ...]
    kind: str
    text: str

    def inputs(self) -> list[Node]:
        return [(d.rpartition(".")[0] or self.record_type, d.rpartition(".")[2]) for d in self.depends_on]

    def source(self) -> str:
        """The record type whose rows the formula reads."""
        types = {t for t, _ in self.inputs()} or {self.record_type}
        if len(types) > 1:
            raise ValueError(f"{self.record_type}.{self.field} reads records of several types: {sorted(types)}")
        return types.pop()

    def expression(self) -> str:
        if self.kind in CHECK_DIGITS:
            if len(self.depends_on) != 1:
                raise ValueError(f"{self.record_type}.{self.field}: a check digit depends on one field")
            return CHECK_DIGITS[self.kind](f"trim({self.inputs()[0][1]})")
        return self.text


def mod97(text: str) -> str:
    """Two check digits by which the number followed by them leaves 1 when divided by 97."""
    return f"lpad(cast(98 - cast(cast({text} as decimal(36, 0)) * 100 % 97 as int) as string), 2, '0')"


CHECK_DIGITS = {"luhn": checks.luhn_check_digit, "aba": checks.aba_check_digit, "mod97": mod97}
KINDS = {"row", "total", "copy", *CHECK_DIGITS}


def formulas_of(dependencies: DataFrame, totals: Iterable[str] = ("sum", "count", "min", "max", "avg")) -> list[Formula]:
    """Formulas out of a spec's dependency rows (record_type, field, depends_on, kind, formula), one per dependency. The table
    is as long as a spec and comes to the driver to build the plan. Without a kind of ours, a formula that starts with an aggregate is a
    total, one over another record type a copy, any other a row formula."""
    rows = dependencies.where("formula is not null").groupBy("record_type", "field", "formula").agg(F.sort_array(F.collect_set("depends_on")).alias("on"), F.max("kind").alias("kind")).collect()
    out = []
    for r in rows:
        kind = r["kind"]
        if kind not in KINDS:
            elsewhere = any("." in d and not d.startswith(r["record_type"] + ".") for d in r["on"])
            aggregate = re.match(rf"\s*(coalesce\s*\(\s*)?({'|'.join(totals)})\s*\(", r["formula"], re.IGNORECASE)
            kind = "total" if aggregate else "copy" if elsewhere else "row"
        out.append(Formula(r["record_type"], r["field"], tuple(r["on"]), kind, r["formula"]))
    return sorted(out, key=lambda f: (f.record_type, f.field))


def levels(formulas: Sequence[Formula], known: Mapping[str, Iterable[str]]) -> list[list[Formula]]:
    """Formulas in an order in which every one follows those it depends on. ``known``: the fields of each record type."""
    known = {t: set(names) for t, names in known.items()}
    by = {(f.record_type, f.field): f for f in formulas}
    if len(by) < len(formulas):
        raise ValueError("a field has two formulas")
    for node, f in by.items():
        if f.kind not in KINDS:
            raise ValueError(f"unknown kind {f.kind!r} of {node[0]}.{node[1]}")
        for kind, name in [node, *f.inputs()]:
            if name not in known.get(kind, ()):
                raise ValueError(f"{node[0]}.{node[1]} needs {kind}.{name}, which the spec does not have")
        listed = {name for _, name in f.inputs()}
        quoted = re.sub(r"'(?:[^'\\]|\\.)*'", "", f.text)
        if missing := set(re.findall(r"[A-Za-z_]\w*", quoted)) & known[f.source()] - listed:
            raise ValueError(f"{node[0]}.{node[1]} uses {sorted(missing)} without listing them")
    graph = graphlib.TopologicalSorter({node: [n for n in f.inputs() if n in by] for node, f in by.items()})
    try:
        graph.prepare()
    except graphlib.CycleError as cycle:
        raise ValueError("fields depend on each other: " + " -> ".join(".".join(n) for n in cycle.args[1])) from None
    out = []
    while graph.is_active():
        ready = graph.get_ready()
        graph.done(*ready)
        out.append([by[n] for n in sorted(ready)])
    return out


def fitted(text: str, f: Field) -> str:
    """The value as the field's text; too wide a value is an error."""
    value = f"coalesce(cast({text} as string), '')"
    if not f.length:
        return value
    return f"if(length({value}) > {f.length}, raise_error({q(f'{f.record_type}.{f.name} does not fit')}), {fixed.fit(value, f.length, f.justify, f.pad)})"


def filled(records: Mapping[str, DataFrame], spec: Spec, formulas: Sequence[Formula], group: Sequence[str]) -> dict[str, DataFrame]:
    """``records`` (a DataFrame per record type: the ``group`` columns, any others, and the type's fields as text) with every formula's field
    filled. Formulas see numbers as text, as fields hold it."""
    out, fields = dict(records), {(f.record_type, f.name): f for f in spec.fields}
    for level in levels(formulas, {t: [f.name for f in spec.of(t)] for t in records}):
        before = dict(out)
        for kind in sorted({f.record_type for f in level}):
            mine, rows = [f for f in level if f.record_type == kind], out[kind]
            own = [f for f in mine if f.source() == kind and f.kind != "total"]
            rows = rows.withColumns({f.field: F.expr(fitted(f.expression(), fields[kind, f.field])) for f in own})
            for source in sorted({f.source() for f in mine if f not in own}):
                away = [f for f in mine if f not in own and f.source() == source]
                whole = {f.field: f.expression() if f.kind == "total" else f"max({f.expression()})" for f in away}
                sums = before[source].groupBy(*group).agg(*[F.expr(text).alias(f"_new_{name}") for name, text in whole.items()], F.lit(True).alias("_met"))
                none = {name: F.lit(0) for name, text in whole.items() if re.match(r"\s*count\s*\(", text, re.IGNORECASE)}
                joined = rows.join(sums, list(group), "left")
                joined = joined.withColumns({f"_new_{n}": F.when(F.col("_met"), F.col(f"_new_{n}")).otherwise(v) for n, v in none.items()})
                rows = joined.withColumns({n: F.expr(fitted(f"_new_{n}", fields[kind, n])) for n in whole}).drop("_met", *[f"_new_{n}" for n in whole])
            out[kind] = rows
    return out
