"""Resource definitions: what a resource costs, as expressions over its attributes, compiled to Spark columns.

A definition (TOML) names mappings, which look prices up, and dimensions, each a quantity times a rate, some under a
condition. Expressions are parsed once on the driver; a table of resources, their attributes as JSON, is then costed
by a plan without Python in it. An attribute has no type of its own: it takes that of what it is used with.

Attributes nested one level down are also found under their joined name (``cluster`` with ``size`` as
``cluster_size``), as are those of a block that stands alone in a list.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.model import AttributeFilter, ProductFilter

MONTHLY_HOURS = 730.0
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>\?\?|\?\.|&&|\|\||[=!<>]=|[-+*/%<>!?:.,;|()\[\]{}=]))""")
_WORDS = {"and": "&&", "or": "||", "not": "!"}
#: Binary operators by how tightly they bind.
_BINDING = {"??": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 5, "<=": 5, ">": 5, ">=": 5, "in": 5, "contains": 5, "matches": 5, "startsWith": 5, "endsWith": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7}


class DefinitionError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DefinitionError(f"cannot read: {text[at : at + 20]!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        out.append(("op", _WORDS[value]) if kind == "name" and value in _WORDS else (kind, value))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    """Precedence climbing; yields nested tuples."""

    def __init__(self, text: str):
        self.t, self.i = tokens(text), 0

    def next(self) -> tuple[str, str]:
        self.i += 1
        return self.t[self.i - 1]

    def at(self, *values: str) -> bool:
        return self.t[self.i][0] in ("op", "name") and self.t[self.i][1] in values

    def take(self, value: str) -> None:
        kind, got = self.next()
        if got != value or kind == "str":
            raise DefinitionError(f"expected {value!r}, found {got!r}")

    def whole(self) -> tuple:
        tree = self.sequence()
        if self.t[self.i][0] != "end":
            raise DefinitionError(f"unexpected {self.t[self.i][1]!r}")
        return tree

    def sequence(self) -> tuple:
        if not self.at("let"):
            return self.choice()
        self.next()
        name = self.next()[1]
        self.take("=")
        value = self.choice()
        self.take(";")
        return ("let", name, value, self.sequence())

    def choice(self) -> tuple:
        test = self.piped()
        if not self.at("?"):
            return test
        self.next()
        yes = self.choice()
        self.take(":")
        return ("if", test, yes, self.choice())

    def piped(self) -> tuple:
        left = self.binary(1)
        while self.at("|"):
            self.next()
            call = self.postfix()
            if call[0] != "call":
                raise DefinitionError("a pipe goes into a call")
            left = ("call", call[1], [left, *call[2]])
        return left

    def binary(self, least: int) -> tuple:
        left = self.unary()
        while True:
            kind, op = self.t[self.i]
            negated = kind == "op" and op == "!" and self.t[self.i + 1] == ("name", "in")
            op = "in" if negated else op
            if kind not in ("op", "name") or _BINDING.get(op, 0) < least:
                return left
            self.i += 1 + negated
            right = self.binary(_BINDING[op] + 1)
            left = ("not", ("op", op, left, right)) if negated else ("op", op, left, right)

    def unary(self) -> tuple:
        if self.at("!"):
            self.next()
            return ("not", self.unary())
        if self.at("-"):
            self.next()
            return ("op", "-", ("num", 0.0), self.unary())
        return self.postfix()

    def listed(self, end: str) -> list:
        out = []
        while not self.at(end):
            out.append(self.sequence())
            if not self.at(end):
                self.take(",")
        self.take(end)
        return out

    def postfix(self) -> tuple:
        tree = self.primary()
        while self.at(".", "?.", "["):
            if self.next()[1] == "[":
                key = self.sequence()
                self.take("]")
                tree = ("index", tree, key)
            else:
                tree = ("member", tree, self.next()[1])
        return tree

    def primary(self) -> tuple:
        kind, value = self.next()
        if kind == "num":
            return ("num", float(value))
        if kind == "str":
            return ("str", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "op" and value == "(":
            tree = self.sequence()
            self.take(")")
            return tree
        if kind == "op" and value == "[":
            return ("list", self.listed("]"))
        if kind == "op" and value == "{":
            pairs = []
            while not self.at("}"):
                key = self.next()[1].strip("\"'")
                self.take(":")
                pairs.append((key, self.sequence()))
                if not self.at("}"):
                    self.take(",")
            self.take("}")
            return ("map", pairs)
        if kind == "name":
            if value in ("true", "false"):
                return ("bool", value == "true")
            if value in ("nil", "null"):
                return ("nil",)
            if self.at("("):
                self.next()
                return ("call", value, self.listed(")"))
            return ("name", value)
        raise DefinitionError(f"unexpected {value!r}")


@dataclass(frozen=True)
class Typed:
    """A column and what it holds: num, str, bool, list (JSON texts), or json (any, as JSON text)."""

    column: Column
    kind: str

    def as_(self, kind: str) -> Column:
        c = self.column
        if kind == self.kind or self.kind == "nil":
            return c
        if self.kind == "json":
            if kind == "num":
                return c.try_cast("double")
            if kind == "bool":
                return F.when(c == "true", True).when(c == "false", False)
            return F.from_json(c, "array<string>") if kind == "list" else c
        if kind in ("str", "json"):
            return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string")) if self.kind == "num" else F.to_json(c) if self.kind == "list" else c.cast("string")
        if kind == "num":
            return c.try_cast("double") if self.kind == "str" else c.cast("double")
        return c.try_cast("boolean") if kind == "bool" else F.array(c)


_NATIVE = {bool: "bool", float: "num", int: "num", str: "str"}


class Compiler:
    """Trees to columns. ``attributes`` is a JSON text, ``prices`` a map from mapping to unit price."""

    def __init__(self, attributes: Column, prices: Column):
        self.attributes, self.prices = attributes, prices

    def attribute(self, name: str) -> Column:
        paths = [f"$.{name}"]
        parts = name.split("_")
        for i in range(1, len(parts)):
            a, b = "_".join(parts[:i]), "_".join(parts[i:])
            paths += [f"$.{a}.{b}", f"$.{a}[0].{b}"]
        return F.coalesce(*(F.get_json_object(self.attributes, p) for p in paths))

    def build(self, tree: tuple, names: dict[str, Typed] | None = None) -> Typed:
        names = names or {}
        return getattr(self, f"_{tree[0]}")(tree, names)

    def _num(self, tree, names) -> Typed:
        return Typed(F.lit(tree[1]), "num")

    def _str(self, tree, names) -> Typed:
        return Typed(F.lit(tree[1]), "str")

    def _bool(self, tree, names) -> Typed:
        return Typed(F.lit(tree[1]), "bool")

    def _nil(self, tree, names) -> Typed:
        return Typed(F.lit(None), "nil")

    def _name(self, tree, names) -> Typed:
        return names.get(tree[1]) or Typed(self.attribute(tree[1]), "json")

    def _let(self, tree, names) -> Typed:
        return self.build(tree[3], names | {tree[1]: self.build(tree[2], names)})

    def _not(self, tree, names) -> Typed:
        return Typed(~F.coalesce(self.build(tree[1], names).as_("bool"), F.lit(False)), "bool")

    def _if(self, tree, names) -> Typed:
        test, yes, no = (self.build(t, names) for t in tree[1:])
        kind = self.common(yes, no)
        return Typed(F.when(F.coalesce(test.as_("bool"), F.lit(False)), yes.as_(kind)).otherwise(no.as_(kind)), kind)

    def _list(self, tree, names) -> Typed:
        items = [self.build(t, names) for t in tree[1]]
        return Typed(F.array(*(x.as_("str") for x in items)), "list")

    def _map(self, tree, names) -> Typed:
        values = [(k, self.build(v, names)) for k, v in tree[1]]
        kind = reduce(lambda a, v: self.common(Typed(F.lit(None), a), v), (v for _, v in values), "nil")
        return Typed(F.create_map(*(c for k, v in values for c in (F.lit(k), v.as_(kind)))), f"map:{kind}")

    def _member(self, tree, names) -> Typed:
        base = self.build(tree[1], names)
        return Typed(F.get_json_object(base.as_("json"), f"$.{tree[2]}"), "json")

    def _index(self, tree, names) -> Typed:
        base, key = self.build(tree[1], names), self.build(tree[2], names)
        if base.kind.startswith("map:"):
            return Typed(F.try_element_at(base.column, key.as_("str")), base.kind[4:])
        if key.kind == "str":
            return Typed(F.get_json_object(base.as_("json"), F.concat(F.lit("$."), key.column)), "json")
        return Typed(F.get(base.as_("list"), key.as_("num").cast("int")), "json")

    @staticmethod
    def common(a: Typed, b: Typed) -> str:
        """The type that two values are used with."""
        if a.kind == "nil" or a.kind == "json":
            return b.kind if b.kind != "nil" else a.kind
        return a.kind if b.kind in ("nil", "json", a.kind) else "str"

    def _op(self, tree, names) -> Typed:
        op, a, b = tree[1], self.build(tree[2], names), self.build(tree[3], names)
        if op in ("&&", "||"):
            x, y = (F.coalesce(v.as_("bool"), F.lit(False)) for v in (a, b))
            return Typed(x & y if op == "&&" else x | y, "bool")
        if op == "??":
            kind = self.common(a, b)
            return Typed(F.coalesce(a.as_(kind), b.as_(kind)), kind)
        if op in ("==", "!="):
            kind = self.common(a, b)
            same = a.as_(kind).eqNullSafe(b.as_(kind))
            return Typed(same if op == "==" else ~same, "bool")
        if op == "in":
            return Typed(F.coalesce(F.array_contains(b.as_("list"), a.as_("str")), F.lit(False)), "bool")
        if op in ("contains", "matches", "startsWith", "endsWith"):
            x, y = a.as_("str"), b.as_("str")
            test = {"contains": F.contains, "matches": F.rlike, "startsWith": F.startswith, "endsWith": F.endswith}[op](x, y)
            return Typed(F.coalesce(test, F.lit(False)), "bool")
        if op == "+" and "str" in (a.kind, b.kind):
            return Typed(F.concat(a.as_("str"), b.as_("str")), "str")
        if op in ("<", "<=", ">", ">=") and self.common(a, b) == "str":
            x, y = a.as_("str"), b.as_("str")
        else:
            x, y = a.as_("num"), b.as_("num")
        compared = {"<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}
        if op in compared:
            return Typed(F.coalesce(compared[op](), F.lit(False)), "bool")
        return Typed({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.try_mod(x, y)}[op](), "num")

    def _call(self, tree, names) -> Typed:
        name, args = tree[1], tree[2]
        if name == "price":
            return Typed(F.try_element_at(self.prices, F.lit(args[0][1])), "num")
        if name == "monthly_hours":
            return Typed(F.lit(MONTHLY_HOURS), "num")
        if name == "pick":
            return self._if(("if", *args), names)
        if name == "default":
            return self._op(("op", "??", *args), names)
        values = [self.build(a, names) for a in args]
        x = values[0]
        text = x.as_("str")
        if name == "count_blocks":  # a block alone, not in a list, is one
            one = F.when(x.as_("json").isNull(), 0).when(F.trim(x.as_("json")).startswith("["), F.size(x.as_("list"))).otherwise(1)
            return Typed(one.cast("double"), "num")
        if name == "sum_field":
            each = lambda e: F.coalesce(F.get_json_object(e, f"$.{args[1][1]}").try_cast("double"), F.lit(0.0))
            return Typed(F.coalesce(F.aggregate(x.as_("list"), F.lit(0.0), lambda a, e: a + each(e)), F.lit(0.0)), "num")
        if name == "split":
            return Typed(F.split(text, F.concat(F.lit("\\Q"), values[1].as_("str"), F.lit("\\E"))), "list")
        if name == "last":
            return Typed(F.try_element_at(x.as_("list"), F.lit(-1)), "json")
        if name == "len":
            return Typed((F.size(x.as_("list")) if x.kind == "list" else F.when(text.startswith("["), F.size(F.from_json(text, "array<string>"))).otherwise(F.length(text))).cast("double"), "num")
        if name == "type":
            looks = F.when(text.isNull(), "nil").when(text.startswith("["), "array").when(text.startswith("{"), "map").when(text.isin("true", "false"), "bool").when(text.try_cast("double").isNotNull(), "float").otherwise("string")
            return Typed(looks if x.kind == "json" else F.lit({"num": "float", "str": "string", "list": "array"}.get(x.kind, x.kind)), "str")
        if name == "replace":
            return Typed(F.replace(text, values[1].as_("str"), values[2].as_("str")), "str")
        if name in ("strip_prefix", "trimPrefix"):
            cut = values[1].as_("str")
            return Typed(F.when(F.startswith(text, cut), F.substr(text, F.length(cut) + 1)).otherwise(text), "str")
        if name == "trimSuffix":
            cut = values[1].as_("str")
            return Typed(F.when(F.endswith(text, cut), F.substr(text, F.lit(1), F.length(text) - F.length(cut))).otherwise(text), "str")
        simple = {"float": lambda: (x.as_("num"), "num"), "string": lambda: (text, "str"), "upper": lambda: (F.upper(text), "str"), "lower": lambda: (F.lower(text), "str"), "toJSON": lambda: (x.as_("json"), "str")}
        if name not in simple:
            raise DefinitionError(f"unknown function {name}")
        return Typed(*simple[name]())


@dataclass(frozen=True)
class Mapping:
    name: str
    service: str
    product_family: str
    filters: tuple[tuple[str, str | None, str | None], ...]  #: key, constant, expression
    region: str | None = None
    purchase_option: str | None = None

    def product_filter(self, vendor: str, values: dict[str, str | None], region: str | None) -> ProductFilter:
        """The lookup for a resource whose filter expressions came to ``values``; a null asks for nothing."""
        wanted = tuple(AttributeFilter(k, c if c is not None else values.get(k)) for k, c, _ in self.filters if c is not None or values.get(k) is not None)
        return ProductFilter(vendor, self.service, self.product_family or None, self.region if self.region is not None else region, attribute_filters=wanted)


@dataclass(frozen=True)
class Dimension:
    id: str
    label: str
    unit: str
    quantity: str
    rate: str
    when: str | None = None


@dataclass(frozen=True)
class Definition:
    kind: str
    display_name: str
    provider: str
    mappings: tuple[Mapping, ...]
    dimensions: tuple[Dimension, ...]
    fixture: dict = field(default_factory=dict)


def parse(toml: str) -> Definition:
    """A definition; its expressions are read here, so that a wrong one is found at once."""
    said = tomllib.loads(toml)
    text = lambda v: v if isinstance(v, str) else str(v)
    mappings = tuple(Mapping(n, m["service"], m.get("product_family", ""), tuple((f["key"], f.get("const"), f.get("expr")) for f in m.get("attribute_filters", ())), m.get("region"), m.get("purchase_option")) for n, m in said.get("mappings", {}).items())
    dimensions = tuple(Dimension(d["id"], d.get("label", ""), d.get("unit", ""), text(d["quantity"]), text(d["rate"]), d.get("when")) for d in said.get("dimensions", ()))
    for m in mappings:
        for _, _, e in m.filters:
            if e is not None:
                Parser(e).whole()
    for d in dimensions:
        for e in (d.quantity, d.rate, d.when):
            if e is not None:
                Parser(e).whole()
    return Definition(said["kind"], said.get("display_name", said["kind"]), said["provider"], mappings, dimensions, said.get("fixture", {}))


def free_kinds(toml: str) -> dict[str, str]:
    """Kinds that cost nothing, and why."""
    return dict(tomllib.loads(toml).get("kinds", {}))


def filter_values(resources: DataFrame, mapping: Mapping, attributes: str = "attributes") -> DataFrame:
    """``resources`` with ``filters``, a map from attribute to the value that the mapping looks up."""
    c = Compiler(F.col(attributes), F.lit(None).cast("map<string,double>"))
    pairs = [(k, F.lit(v) if v is not None else c.build(Parser(e).whole()).as_("str")) for k, v, e in mapping.filters]
    made = F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))) if pairs else F.create_map().cast("map<string,string>")
    return resources.withColumn("filters", made)


def lines(resources: DataFrame, definition: Definition, attributes: str = "attributes", prices: str = "prices") -> DataFrame:
    """``resources`` (attributes as JSON, prices by mapping) with ``lines``: id, unit, quantity, rate, cost of each
    dimension whose condition holds. A quantity or rate that comes to nothing counts as 0."""
    c = Compiler(F.col(attributes), F.col(prices))
    number = lambda e: F.coalesce(c.build(Parser(e).whole()).as_("num").cast("double"), F.lit(0.0))
    made = []
    for d in definition.dimensions:
        held = F.lit(True) if d.when is None else F.coalesce(c.build(Parser(d.when).whole()).as_("bool"), F.lit(False))
        quantity, rate = number(d.quantity), number(d.rate)
        made.append(F.when(held, F.struct(F.lit(d.id).alias("id"), F.lit(d.unit).alias("unit"), quantity.alias("quantity"), rate.alias("rate"), (quantity * rate).alias("cost"))))
    empty = F.array().cast("array<struct<id:string,unit:string,quantity:double,rate:double,cost:double>>")
    return resources.withColumn("lines", F.array_compact(F.array(*made)) if made else empty)


def monthly_cost(resources: DataFrame, definition: Definition, attributes: str = "attributes", prices: str = "prices") -> DataFrame:
    """``lines`` and their sum, ``monthly_cost``."""
    return lines(resources, definition, attributes, prices).withColumn("monthly_cost", F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["cost"]))


def fixture_holds(cost: float, fixture: dict) -> bool:
    """Whether a cost is what the definition's fixture expects, within its tolerance (a share of it), or exactly."""
    want = float(fixture["expected_monthly_cost"])
    return cost == want if fixture.get("exact") else abs(cost - want) <= float(fixture.get("tolerance", 0)) * max(abs(want), 1e-9) + 1e-9
