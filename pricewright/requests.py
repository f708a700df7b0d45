"""Requests as query text, in the subset of the query language that clients send.

Operations select ``products`` (filter, limit, offset) and of them fields, ``attributes`` and ``prices`` (filter);
arguments may be variables, selections may hold aliases, fragments and ``__typename``. A text is limited in size and
depth; fields of introspection are refused if the engine says so. A lookup runs as one plan, and only the fields that
are selected are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from pricewright.engine import LATE, Budget, Deadline, Engine
from pricewright.model import AttributeFilter, BudgetSpent, PriceFilter, ProductFilter
from pricewright.plans import query
from pricewright.schema import PRICE_FIELDS

MAX_BYTES, MAX_DEPTH = 10_000, 10
_TOKEN = re.compile(r'[\s,]*(?:#[^\n]*[\s,]*)*(?:(?P<block>"""(?:[^\\]|\\.)*?""")|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>\.\.\.|[!$():=@\[\]{}|&])|(?P<end>\Z))')
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: Product fields by the names that requests use.
_FIELDS = {"productHash": "product_hash", "vendorName": "vendor_name", "service": "service", "productFamily": "product_family", "region": "region", "sku": "sku"}
_PRICE = {"purchaseOption": "purchase_option", "unit": "unit", "description": "description", "description_regex": "description_regex", "startUsageAmount": "start_usage_amount", "endUsageAmount": "end_usage_amount", "termLength": "term_length", "termPurchaseOption": "term_purchase_option", "termOfferingClass": "term_offering_class"}


class RequestError(ValueError):
    pass


@dataclass
class Field:
    name: str
    alias: str
    arguments: dict = field(default_factory=dict)
    selections: list = field(default_factory=list)


@dataclass
class Spread:
    name: str | None  #: of a fragment; None for one written in place
    selections: list = field(default_factory=list)


@dataclass(frozen=True)
class Variable:
    name: str


class Parser:
    def __init__(self, text: str):
        self.items, at = [], 0
        while True:
            m = _TOKEN.match(text, at)
            if not m:
                raise RequestError(f"cannot read the request at {text[at : at + 20]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
            if m.lastgroup == "end":
                break
        self.i = 0

    def peek(self, value: str) -> bool:
        return self.items[self.i][0] in ("op", "name") and self.items[self.i][1] == value

    def next(self, kind: str | None = None, value: str | None = None) -> str:
        got_kind, got = self.items[self.i]
        if kind and got_kind != kind or value is not None and got != value:
            raise RequestError(f"expected {value or kind}, found {got!r}")
        self.i += 1
        return got

    def document(self) -> tuple[list[list], dict[str, list]]:
        """Selections of each operation, and of each fragment."""
        operations, fragments = [], {}
        while self.items[self.i][0] != "end":
            if self.peek("fragment"):
                self.next()
                name = self.next("name")
                self.next("name", "on")
                self.next("name")
                self.directives()
                fragments[name] = self.selection_set()
                continue
            if not self.peek("{"):
                if self.next("name") != "query":
                    raise RequestError("only queries can be run")
                if self.items[self.i][0] == "name":
                    self.next()
                if self.peek("("):
                    while not self.peek(")"):
                        self.next()
                    self.next()
                self.directives()
            operations.append(self.selection_set())
        if not operations:
            raise RequestError("the request holds no query")
        return operations, fragments

    def directives(self) -> None:
        while self.peek("@"):
            self.next()
            self.next("name")
            if self.peek("("):
                self.arguments()

    def selection_set(self) -> list:
        self.next("op", "{")
        out = []
        while not self.peek("}"):
            if self.peek("..."):
                self.next()
                if self.peek("on"):
                    self.next()
                    self.next("name")
                if self.peek("{") or self.peek("@"):
                    self.directives()
                    out.append(Spread(None, self.selection_set()))
                else:
                    out.append(Spread(self.next("name")))
                    self.directives()
                continue
            name = alias = self.next("name")
            if self.peek(":"):
                self.next()
                name = self.next("name")
            arguments = self.arguments() if self.peek("(") else {}
            self.directives()
            out.append(Field(name, alias, arguments, self.selection_set() if self.peek("{") else []))
        self.next()
        return out

    def arguments(self) -> dict:
        self.next("op", "(")
        out = {}
        while not self.peek(")"):
            name = self.next("name")
            self.next("op", ":")
            out[name] = self.value()
        self.next()
        return out

    def value(self):
        kind, got = self.items[self.i]
        self.i += 1
        if kind == "str":
            return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), got[1:-1])
        if kind == "block":
            return got[3:-3].strip("\n")
        if kind == "num":
            return float(got) if re.search("[.eE]", got) else int(got)
        if kind == "name":
            return {"true": True, "false": False, "null": None}.get(got, got)
        if got == "$":
            return Variable(self.next("name"))
        out: list | dict
        if got == "[":
            out = []
            while not self.peek("]"):
                out.append(self.value())
        elif got == "{":
            out = {}
            while not self.peek("}"):
                name = self.next("name")
                self.next("op", ":")
                out[name] = self.value()
        else:
            raise RequestError(f"unexpected {got!r}")
        self.next()
        return out


def flattened(selections: list, fragments: dict[str, list], inside: tuple[str, ...] = ()) -> list[Field]:
    """Fields with fragments in place; a fragment within itself stands for nothing."""
    out = []
    for s in selections:
        if isinstance(s, Field):
            out.append(s)
        elif s.name is None:
            out += flattened(s.selections, fragments, inside)
        elif s.name not in inside and s.name in fragments:
            out += flattened(fragments[s.name], fragments, (*inside, s.name))
    return out


def depth(selections: list, fragments: dict[str, list], inside: tuple[str, ...] = ()) -> int:
    return max((1 + depth(s.selections, fragments, inside) if isinstance(s, Field) else depth(s.selections, fragments, inside) if s.name is None else depth(fragments.get(s.name, []), fragments, (*inside, s.name)) if s.name not in inside else 0 for s in selections), default=0)


def introspects(selections: list, fragments: dict[str, list], inside: tuple[str, ...] = ()) -> bool:
    for s in selections:
        if isinstance(s, Field):
            if s.name in ("__schema", "__type") or introspects(s.selections, fragments, inside):
                return True
        elif s.name is None:
            if introspects(s.selections, fragments, inside):
                return True
        elif s.name not in inside and introspects(fragments.get(s.name, []), fragments, (*inside, s.name)):
            return True
    return False


def _bound(value, variables: dict):
    if isinstance(value, Variable):
        return variables.get(value.name)
    if isinstance(value, list):
        return [_bound(v, variables) for v in value]
    return {k: _bound(v, variables) for k, v in value.items()} if isinstance(value, dict) else value


def product_filter(said: dict, limit: int | None, offset: int | None) -> ProductFilter:
    """Only text counts: other values are as if they had not been given."""
    text = lambda d, k: d.get(k) if isinstance(d.get(k), str) else None
    attributes = tuple(AttributeFilter(text(a, "key") or "", text(a, "value"), text(a, "value_regex")) for a in said.get("attributeFilters") or () if isinstance(a, dict))
    return ProductFilter(text(said, "vendorName"), text(said, "service"), text(said, "productFamily"), text(said, "region"), text(said, "sku"), attributes, limit or 0, offset or 0)


def price_filter(said: dict | None) -> PriceFilter | None:
    return None if said is None else PriceFilter(**{v: said[k] for k, v in _PRICE.items() if isinstance(said.get(k), str)})


def _lookup(engine: Engine, f: Field, fragments: dict, variables: dict, budget: Budget) -> list[dict]:
    arguments = _bound(f.arguments, variables)
    if not isinstance(arguments.get("filter"), dict):
        raise RequestError("products needs a filter")
    wanted = product_filter(arguments["filter"], arguments.get("limit"), arguments.get("offset"))
    query.guard(wanted)
    n = budget.reserve(wanted.limit)
    rows = query.plan_products(engine.store.read(), ProductFilter(**{**wanted.__dict__, "limit": n}))
    columns, fields = [], flattened(f.selections, fragments)
    for i, s in enumerate(fields):
        if s.name in _FIELDS:
            columns.append(F.col(_FIELDS[s.name]).alias(f"_{i}"))
        elif s.name == "attributes":
            columns.append(F.array_sort(F.map_entries("attributes")).alias(f"_{i}"))
        elif s.name == "prices":
            f_ = price_filter(_bound(s.arguments, variables).get("filter"))
            rows = query.filter_prices(rows.withColumn("_all", F.col("prices")), f_).withColumn(f"_p{i}", F.col("prices")).withColumn("prices", F.col("_all")).drop("_all")
            columns.append(F.col(f"_p{i}").alias(f"_{i}"))
        elif s.name != "__typename":
            raise RequestError(f"products have no field {s.name}")
    found = rows.select(*columns).collect() if columns else [()] * rows.count()
    budget.refund(n, len(found))
    out = []
    for row in found:
        shown = {}
        for i, s in enumerate(fields):
            if s.name == "__typename":
                shown[s.alias] = "Product"
                continue
            value = row[f"_{i}"]
            inner = flattened(s.selections, fragments)
            if s.name == "attributes":
                value = [{x.alias: {"key": e["key"], "value": e["value"], "__typename": "Attribute"}[x.name] for x in inner} for e in value or ()]
            elif s.name == "prices":
                value = [{x.alias: "Price" if x.name == "__typename" else p[x.name] for x in inner if x.name in (*PRICE_FIELDS, "__typename")} for p in value or ()]
            shown[s.alias] = value
        out.append(shown)
    return out


def run(engine: Engine, request: dict, budget: Budget | None = None, introspection: bool = True, max_depth: int = MAX_DEPTH) -> dict:
    """``request`` (query, variables) as data and errors; a lookup that fails leaves null and the others stand."""
    text, variables, budget = request.get("query") or "", request.get("variables") or {}, budget or Budget()
    try:
        if len(text.encode()) > MAX_BYTES:
            raise RequestError(f"request of more than {MAX_BYTES} bytes")
        operations, fragments = Parser(text).document()
        if max(depth(o, fragments) for o in operations) > max_depth:
            raise RequestError(f"request deeper than {max_depth}")
        if not introspection and any(introspects(o, fragments) for o in operations):
            raise RequestError("introspection is disabled")
    except (RequestError, IndexError) as e:
        return {"data": None, "errors": [{"message": str(e)}]}
    data, errors = {}, []
    for f in flattened(operations[0], fragments):
        try:
            if f.name == "__typename":
                data[f.alias] = "Query"
            elif f.name != "products":
                raise RequestError(f"no field {f.name}")
            else:
                data[f.alias] = _lookup(engine, f, fragments, variables, budget)
        except (ValueError, BudgetSpent) as e:
            data[f.alias] = None
            errors.append({"message": str(e), "path": [f.alias]})
    return {"data": data} | ({"errors": errors} if errors else {})


def batch(engine: Engine, requests: list[dict], budget: Budget | None = None, seconds: float | None = None, **options) -> list[dict]:
    """Answers in order; all requests share a budget and ``seconds`` (by default those of the engine's settings): those that
    have not been answered by then say so, and the others stand."""
    if len(requests) > engine.settings.batch_requests:
        raise RequestError(f"more than {engine.settings.batch_requests} requests")
    budget, out = budget or engine.budget(), []
    options = {"introspection": engine.settings.introspection, "max_depth": engine.settings.query_depth} | options
    late = {"data": None, "errors": [{"message": LATE}]}
    with Deadline(engine.spark, engine.settings.query_seconds if seconds is None else seconds) as deadline:
        for r in requests:
            try:
                out.append(late if deadline.passed() else run(engine, r, budget, **options))
            except Exception:
                if not deadline.passed():
                    raise
                out.append(late)
    return out
