"""Rule documents (IDS): parsed on the driver, compiled to column expressions over element views.

Element views have columns ifc_type, predefined_type, name, global_id,
attributes map<string,string>, psets map<string,map<string,struct<value,dataType>>>,
classifications array<struct<system,value>>, materials array<string>, part_of
array<struct<relation,wholeType,wholePredefinedType>>. All specifications are
evaluated in one scan: each facet becomes two expressions, present and matching.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.functions.numbers import NUMBER, plain_number

FACETS = ("entity", "attribute", "classification", "property", "material", "partOf")
INFO = ("title", "copyright", "version", "description", "author", "date", "purpose", "milestone")
BOUNDS = ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive")
#: What a reason calls a subject that the rule does not name (fixed values).
NAMELESS = {"attribute": "(attributo)", "classification": "(classificazione)", "material": "(materiale)"}
REASONS = "array<struct<code:string,facet_type:string,label:string,expected:string,got:string>>"


@dataclass
class Matcher:
    """A simple value, or the constraints of a restriction."""

    simple: str | None = None
    enumeration: list[str] = field(default_factory=list)
    pattern: str | None = None
    bounds: dict[str, float] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)

    def constrains(self) -> bool:
        return self.simple is not None or bool(self.enumeration or self.pattern is not None or self.bounds or self.lengths)

    def upper(self) -> Matcher:
        """Literals in capitals, as class names are compared; patterns stay."""
        return Matcher(self.simple and self.simple.upper(), [x.upper() for x in self.enumeration], self.pattern, self.bounds, self.lengths)

    def describe(self) -> str:
        """The constraint in words (fixed texts): values as they stand, then what limits them."""
        if self.simple is not None:
            return self.simple
        parts = [" | ".join(self.enumeration)] if self.enumeration else []
        parts += [f"pattern: {self.pattern}"] if self.pattern is not None else []
        parts += [f"{k}={self.lengths[k]}" for k in ("length", "minLength", "maxLength") if k in self.lengths]
        sign = {"minInclusive": "≥", "maxInclusive": "≤", "minExclusive": ">", "maxExclusive": "<"}
        return ", ".join(parts + [f"{sign[k]}{_plain(self.bounds[k])}" for k in BOUNDS if k in self.bounds])


def _plain(x: float) -> str:
    """The shortest text of a number, without a fraction where there is none."""
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


@dataclass
class Facet:
    kind: str
    parts: dict[str, Matcher | None]
    relation: str = ""
    cardinality: str = "required"
    instructions: str = ""


@dataclass
class Spec:
    name: str
    applicability: list[Facet]
    requirements: list[Facet]
    attributes: dict[str, str] = field(default_factory=dict)
    occurs: dict[str, str] = field(default_factory=dict)


@dataclass
class Document:
    info: dict[str, str]
    specs: list[Spec]


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _child(node: ET.Element | None, name: str) -> ET.Element | None:
    return next((c for c in node if _local(c) == name), None) if node is not None else None


def _text(node: ET.Element | None) -> str:
    return "".join(node.itertext()).strip() if node is not None else ""


def parse_matcher(node: ET.Element | None) -> Matcher | None:
    """A simpleValue, else a restriction, else nothing. Of several patterns the last counts."""
    if (simple := _child(node, "simpleValue")) is not None:
        return Matcher(simple=_text(simple))
    if (restriction := _child(node, "restriction")) is None:
        return None
    m = Matcher()
    for c in restriction:
        kind, value = _local(c), c.get("value", "")
        if kind == "enumeration":
            m.enumeration.append(value)
        elif kind == "pattern":
            m.pattern = value
        elif kind in BOUNDS:
            m.bounds[kind] = float(value)
        elif kind in ("length", "minLength", "maxLength"):
            m.lengths[kind] = int(value)
    return m


#: Matchers of each facet: part and the child that holds it.
_PARTS = {
    "entity": {"name": "name", "type": "predefinedType"}, "attribute": {"name": "name", "value": "value"}, "classification": {"system": "system", "value": "value"},
    "property": {"set": "propertySet", "name": "baseName", "value": "value"}, "material": {"value": "value"}, "partOf": {},
}


def parse_facet(node: ET.Element) -> Facet:
    kind = _local(node)
    parts = {k: parse_matcher(_child(node, c)) for k, c in _PARTS[kind].items()}
    if kind == "property" and parts["name"] is None:
        parts["name"] = parse_matcher(_child(node, "name"))
    if kind == "partOf":
        whole = _child(node, "entity")
        parts = {"name": parse_matcher(_child(whole, "name")), "type": parse_matcher(_child(whole, "predefinedType"))}
    if kind in ("entity", "partOf"):
        parts["name"] = parts["name"] and parts["name"].upper()
    return Facet(kind, parts, node.get("relation", "").upper(), node.get("cardinality", "required"), node.get("instructions", ""))


def _facets(node: ET.Element | None) -> list[Facet]:
    return [parse_facet(c) for c in node if _local(c) in FACETS] if node is not None else []


def parse_ids(xml: str) -> Document:
    root = ET.fromstring(xml)
    if _local(root) != "ids":
        raise ValueError("the root element is not ids")
    info = _child(root, "info")
    specs = []
    for s in _child(root, "specifications") if _child(root, "specifications") is not None else ():
        if _local(s) == "specification":
            a, r = _child(s, "applicability"), _child(s, "requirements")
            specs.append(Spec(s.get("name", ""), _facets(a), _facets(r), dict(s.attrib), dict(a.attrib) if a is not None else {}))
    return Document({k: _text(_child(info, k)) for k in INFO}, specs)


def _literal(text: str) -> float | None:
    """The number that a literal of a rule is, or None; a comma is no decimal point, and blanks alone are 0."""
    t = text.strip().strip("\ufeff")
    return 0.0 if not t else float(t) if _NUMBER.match(t) else None


_NUMBER = re.compile(NUMBER.replace(r"\z", r"\Z"))


def _compiles(pattern: str) -> bool:
    """Whether the engine that will run a pattern takes it."""
    jvm = SparkSession.active()._jvm
    try:
        jvm.java.util.regex.Pattern.compile(rf"\A(?:{pattern})\z")
    except IllegalArgumentException:
        return False
    return True


def matches(m: Matcher | None, actual: Column) -> Column:
    """Whether a text satisfies a matcher; null counts as ''. Numbers are compared as numbers where both are."""
    if m is None:
        return F.lit(True)
    v = F.coalesce(actual.cast("string"), F.lit(""))
    number = F.when(v != "", plain_number(v))

    def same(texts: list[str]) -> Column:
        """One of the texts, or the same number as one of them; the literals' numbers are known here."""
        numbers = sorted({x for x in map(_literal, texts) if x is not None})
        return v.isin(texts) | (F.coalesce(number.isin(numbers), F.lit(False)) if numbers else F.lit(False))

    if m.simple is not None:
        return same([m.simple]) if m.simple else v == ""
    out = F.lit(True)
    if m.enumeration:
        out = out & same(m.enumeration)
    if m.pattern is not None and _compiles(m.pattern):  # an invalid pattern constrains nothing
        out = out & F.regexp_like(v, F.lit(rf"\A(?:{m.pattern})\z"))
    units = (F.octet_length(F.encode(v, "UTF-16BE")) / 2).cast("int")
    for k, n in m.lengths.items():
        out = out & {"length": units == n, "minLength": units >= n, "maxLength": units <= n}[k]
    for k, x in m.bounds.items():
        test = {"minInclusive": number >= x, "maxInclusive": number <= x, "minExclusive": number > x, "maxExclusive": number < x}[k]
        out = out & F.coalesce(test, F.lit(False))
    return out


def fits(m: Matcher | None, key: Column) -> Column:
    """Whether a key (of an attribute, a set or a property) is meant by a matcher: a simple one is that very key."""
    return key == m.simple if m is not None and m.simple is not None else matches(m, key)


def _free(m: Matcher | None) -> bool:
    return m is None or not m.constrains()


_TEXTS = "cast(array() as array<string>)"


def _cells(f: Facet) -> Column:
    """The values under all keys that an attribute or property facet means, in the order of the keys; one walk over the maps for all that follows."""
    p = f.parts
    if f.kind == "attribute":
        e = F.coalesce(F.map_entries("attributes"), F.expr("cast(array() as array<struct<key:string,value:string>>)"))
        return F.transform(F.filter(e, lambda x: fits(p["name"], x["key"])), lambda x: F.coalesce(x["value"], F.lit("")))
    sets = F.coalesce(F.map_entries("psets"), F.expr("cast(array() as array<struct<key:string,value:map<string,struct<value:string,dataType:string>>>>)"))
    inside = lambda s: F.transform(F.filter(F.coalesce(F.map_entries(s["value"]), F.expr("cast(array() as array<struct<key:string,value:struct<value:string,dataType:string>>>)")), lambda x: fits(p["name"], x["key"])), lambda x: F.coalesce(x["value"]["value"], F.lit("")))
    return F.flatten(F.transform(F.filter(sets, lambda s: fits(p["set"], s["key"])), inside))


def facet_columns(f: Facet, cells: Column | None = None) -> tuple[Column, Column]:
    """(subject present, subject and value match); cells: of an attribute or property facet, if they are there already."""
    p = f.parts
    if f.kind == "entity":
        present = matches(p["name"], F.upper(F.coalesce("ifc_type", F.lit(""))))
        return present, present & (F.lit(True) if _free(p["type"]) else matches(p["type"], F.col("predefined_type")))
    if f.kind in ("attribute", "property"):
        cells = _cells(f) if cells is None else cells
        full = lambda v: v != ""
        return F.size(cells) > 0, F.exists(cells, full if _free(p["value"]) else lambda v: full(v) & matches(p["value"], v))
    if f.kind == "classification":
        e = _classes(p["system"])
        return F.size(e) > 0, F.size(e) > 0 if _free(p["value"]) else F.exists(e, lambda x: matches(p["value"], x["value"]))
    if f.kind == "material":
        e = F.coalesce("materials", F.expr(_TEXTS))
        return F.size(e) > 0, F.size(e) > 0 if _free(p["value"]) else F.exists(e, lambda x: matches(p["value"], x))
    e = F.coalesce("part_of", F.expr("cast(array() as array<struct<relation:string,wholeType:string,wholePredefinedType:string>>)"))
    related = lambda x: (F.upper(x["relation"]) == f.relation) if f.relation else F.lit(True)
    whole = lambda x: matches(p["name"], F.upper(x["wholeType"])) & (F.lit(True) if _free(p["type"]) else matches(p["type"], x["wholePredefinedType"]))
    return F.exists(e, lambda x: F.coalesce(related(x), F.lit(False))), F.exists(e, lambda x: F.coalesce(related(x) & whole(x), F.lit(False)))


def _classes(system: Matcher | None) -> Column:
    e = F.coalesce("classifications", F.expr("cast(array() as array<struct<system:string,value:string>>)"))
    return e if _free(system) else F.filter(e, lambda x: matches(system, x["system"]))


def label(f: Facet) -> str:
    """What a reason says it is about."""
    said = {k: (m.describe() if m else "") for k, m in f.parts.items()}
    named = {"entity": "IFC " + said.get("name", ""), "attribute": said.get("name"), "classification": said.get("system"), "property": f"{said.get('set')}.{said.get('name')}", "partOf": f"partOf {f.relation}".rstrip()}
    return named.get(f.kind) or NAMELESS[f.kind]


def expected(f: Facet) -> str:
    said = {k: (m.describe() if m else "") for k, m in f.parts.items()}
    if f.kind in ("entity", "partOf"):
        return said["name"]
    return said["value"] or (said["system"] if f.kind == "classification" else "")


def got(f: Facet, cells: Column | None = None) -> Column:
    """What a facet's subject has instead, as text: the first value that is not empty."""
    first = lambda a: F.get(a, F.lit(0))
    if f.kind in ("attribute", "property"):
        return F.coalesce(first(F.filter(_cells(f) if cells is None else cells, lambda v: v != "")), F.lit(""))
    pick: dict[str, Callable[[], Column]] = {
        "entity": lambda: F.col("ifc_type"), "classification": lambda: first(_classes(f.parts["system"]))["value"], "material": lambda: F.array_join("materials", ", "), "partOf": lambda: F.lit(""),
    }
    return F.coalesce(pick[f.kind](), F.lit(""))


def reason(f: Facet) -> Column:
    """The reason why a requirement fails, or null."""
    return _reason(f, None) if f.kind not in ("attribute", "property") else F.get(F.transform(F.array(_cells(f)), lambda cells: _reason(f, cells)), F.lit(0))


def _reason(f: Facet, cells: Column | None) -> Column:
    present, match = facet_columns(f, cells)
    code = {"prohibited": F.when(match, "prohibited"), "optional": F.when(present & ~match, "badValue")}.get(f.cardinality, F.when(~present, "missing").when(~match, "badValue"))
    return F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(f.kind).alias("facet_type"), F.lit(label(f)).alias("label"), F.lit(expected(f)).alias("expected"), got(f, cells).alias("got")))


def applicable(spec: Spec) -> Column:
    """All applicability facets match; a specification without any applies to nothing."""
    return reduce(lambda a, b: a & b, [facet_columns(f)[1] for f in spec.applicability]) if spec.applicability else F.lit(False)


def evaluate(views: DataFrame, specs: list[Spec]) -> DataFrame:
    """spec_idx, global_id, passed, reasons of every applicable view, from one scan for all specifications."""
    if not specs:
        return views.select(F.lit(0).alias("spec_idx"), "global_id", F.lit(True).alias("passed"), F.lit(None).cast(REASONS).alias("reasons")).limit(0)
    each = []
    for i, s in enumerate(specs):
        reasons = F.filter(F.array(*map(reason, s.requirements)), lambda r: r.isNotNull()) if s.requirements else F.array()
        each.append(F.when(applicable(s), F.struct(F.lit(i).alias("spec_idx"), reasons.cast(REASONS).alias("reasons"))))
    rows = views.select("global_id", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("r"))
    return rows.select("r.spec_idx", "global_id", (F.size("r.reasons") == 0).alias("passed"), "r.reasons")


def summary(results: DataFrame, specs: list[Spec]) -> DataFrame:
    """spec_idx, name, applicable, passed, failed of every specification."""
    names = results.sparkSession.createDataFrame([(i, s.name) for i, s in enumerate(specs)], "spec_idx int, name string")
    counts = results.groupBy("spec_idx").agg(F.count("*").alias("applicable"), F.count_if("passed").alias("passed"))
    return names.join(counts, "spec_idx", "left").fillna(0, ["applicable", "passed"]).withColumn("failed", F.col("applicable") - F.col("passed"))
