"""Allow-rules written as text, compiled to one boolean column.

The language is a small part of Rego: a package, a default for ``allow``, and any number of
``allow`` rules, of which one must hold. A rule is a block of conditions, all of which must
hold, one a line or set apart by ``;``::

    package policy
    default allow := false

    allow if {
        input.role == "admin"
        input.risk < 0.5
    }
    allow { input.kind == "read"; not input.blocked }

A condition compares a path of ``input`` with a literal or another path (==, !=, <, <=, >, >=),
tests ``path in ["a", "b"]``, or is a path by itself, which holds if the value is the boolean
true. ``not`` negates a condition. The context is read as VARIANT, so values keep their JSON
types: values of different types are unequal and have no order, only numbers and strings have
one, and numbers are compared as doubles unless both are whole. A comparison with a missing
value does not hold, whatever it asks; a JSON null is a value, equal to the literal ``null``.
Under ``not`` a condition that does not hold does. Anything else is refused when the text is
loaded, and whatever cannot be evaluated on a row is denied.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.operators.guards import error, reject

#: Fixed value: the reason for a denial.
DENIED = "Rego policy denied the action"

_PATH = re.compile(r"input((?:\.[A-Za-z_]\w*|\[\"[^\"\]]*\"\])+)$")
_RULE = re.compile(r"allow\s*(?:(?::?=)\s*true\s*)?(?:if\s*)?\{([^{}]*)\}|allow\s+if\s+([^\n{}]+)")
_COMPARE = re.compile(r"(.+?)\s*(==|!=|<=|>=|<|>)\s*(.+)$", re.S)


class PolicyError(ValueError):
    """The text is not a policy of this language."""


def _strip(text: str) -> str:
    """The text without comments; a # inside a string is none."""
    return re.sub(r'("(?:\\.|[^"\\])*")|#[^\n]*', lambda m: m[1] or "", text)


_NUMBER = r"^(BIGINT|DOUBLE|DECIMAL)"


class _Term:
    """A literal, or a path of the context: its JSON type and its value as each type."""

    def __init__(self, term: str, context: Column):
        term = term.strip()
        self.literal, self.kind = None, None
        if m := _PATH.match(term):
            path = "$" + "".join(f'["{a or b}"]' for a, b in re.findall(r'\.([A-Za-z_]\w*)|\["([^"\]]*)"\]', m[1]))
            self._read = lambda kind: F.try_variant_get(context, path, kind)
            self._type = F.schema_of_variant(self._read("variant"))
            return
        try:
            self.literal = json.loads(term)
        except ValueError:
            raise PolicyError(f"neither a path of input nor a literal: {term}") from None
        kinds = {bool: "bool", int: "number", float: "number", str: "string", type(None): "null"}
        if type(self.literal) not in kinds:
            raise PolicyError(f"not a plain literal: {term}")
        self.kind = kinds[type(self.literal)]

    def given(self) -> Column:
        return F.lit(True) if self.kind else self._type.isNotNull()

    def is_a(self, kind: str) -> Column:
        if self.kind:
            return F.lit(self.kind == kind)
        return self._type.rlike(_NUMBER) if kind == "number" else self._type == {"bool": "BOOLEAN", "string": "STRING", "null": "VOID"}[kind]

    def as_a(self, kind: str) -> Column:
        """The value as a double, string or boolean; meant where ``is_a`` holds."""
        if self.kind:
            return F.lit(self.literal).cast("double") if kind == "number" else F.lit(self.literal)
        return self._read({"number": "double", "bool": "boolean", "string": "string"}[kind])

    def whole(self) -> Column:
        """The value as a long, if it is a whole number; else null."""
        if self.kind:
            fits = isinstance(self.literal, int) and -(2**63) <= self.literal < 2**63
            return F.lit(self.literal if fits else None).cast("long")
        return F.when(self._type == "BIGINT", self._read("long"))

    def text(self) -> Column:
        return F.lit(json.dumps(self.literal)) if self.kind else F.to_json(self._read("variant"))


_TESTS = {"==": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _both(a: _Term, b: _Term, kind: str, test: Callable) -> Column:
    """Whether both terms are of a kind and the test holds of their values."""
    met = test(a.as_a(kind), b.as_a(kind)) if kind != "number" else F.coalesce(test(a.whole(), b.whole()), test(a.as_a(kind), b.as_a(kind)))
    return a.is_a(kind) & b.is_a(kind) & met


def _compare(a: _Term, op: str, b: _Term) -> Column:
    fixed = [t.kind for t in (a, b) if t.kind]
    known = [k for k in ("number", "string", "bool") if not fixed or k in fixed]
    if op not in ("==", "!="):
        if "bool" in fixed or "null" in fixed:
            raise PolicyError("only numbers and strings have an order")
        return reduce(or_, (F.coalesce(_both(a, b, k, _TESTS[op]), F.lit(False)) for k in known if k != "bool"))
    same = [F.coalesce(_both(a, b, k, _TESTS["=="]), F.lit(False)) for k in known]
    same.append(a.is_a("null") & b.is_a("null"))
    if not fixed:  # objects and lists: equal if written alike
        same.append(~reduce(or_, (a.is_a(k) | b.is_a(k) for k in ("number", "string", "bool", "null"))) & (a.text() == b.text()))
    equal = F.coalesce(reduce(or_, same), F.lit(False))
    return a.given() & b.given() & (equal if op == "==" else ~equal)


def _condition(text: str, context: Column) -> Column:
    text = text.strip()
    if text.startswith("not "):
        return ~F.coalesce(_condition(text[4:], context), F.lit(False))
    if m := re.match(r"(.+?)\s+in\s+(\[.*\])$", text, re.S):
        try:
            items = [json.dumps(x) for x in json.loads(m[2])]
        except ValueError:
            raise PolicyError(f"not a list of literals: {m[2]}") from None
        left = _Term(m[1], context)
        return reduce(or_, (F.coalesce(_compare(left, "==", _Term(x, context)), F.lit(False)) for x in items), F.lit(False))
    if (m := _COMPARE.match(text)) and not _PATH.match(text):
        return _compare(_Term(m[1], context), m[2], _Term(m[3], context))
    term = _Term(text, context)
    if term.kind not in (None, "bool"):
        raise PolicyError(f"not a condition: {text}")
    return term.is_a("bool") & term.as_a("bool")


def _parsed(context: Column | str) -> Column:
    return F.try_parse_json(F.col(context) if isinstance(context, str) else context)


def compile_policy(text: str, context: Column | str) -> Column:
    """The text's ``allow`` over a JSON context column: true or false, never null. PolicyError if it cannot be read."""
    context = _parsed(context)
    body = _strip(text)
    rest = re.sub(r"^\s*(package\s+[\w.]+|import\s+[\w.]+)\s*$", "", body, flags=re.M)
    default = False
    if m := re.search(r"^\s*default\s+allow\s*:?=\s*(true|false)\s*$", rest, flags=re.M):
        default = m[1] == "true"
        rest = rest[: m.start()] + rest[m.end() :]
    rules = []
    for m in _RULE.finditer(rest):
        conditions = [c for c in re.split(r'[\n;](?=(?:[^"]*"[^"]*")*[^"]*$)', m[1] if m[1] is not None else m[2]) if c.strip()]
        if not conditions:
            raise PolicyError("a rule without conditions")
        rules.append(reduce(and_, (F.coalesce(_condition(c, context), F.lit(False)) for c in conditions)))
    if left := _RULE.sub("", rest).strip():
        raise PolicyError(f"cannot be read: {left[:80]}")
    return reduce(or_, rules, F.lit(default))


def text_policy(text: str, context: Column | str) -> Column:
    """A policy for ``guards.policy_chain``: null where the text allows, a rejection where it does not, an error where the context is no JSON."""
    return F.when(_parsed(context).isNull(), error("context is not JSON")).when(~compile_policy(text, context), reject(DENIED))
