"""Arithmetic expression trees over named numbers, compiled to a column.

Nodes are built with the functions below or parsed from text. In strict mode (the default) a division by zero, the
logarithm of a number that isn't positive, the root of a negative number and a missing variable are errors; in safe mode
the first three give null. Truth is a number over 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """``op`` with its arguments; ``const`` and ``var`` carry a value instead."""

    op: str
    args: tuple = ()
    value: float | str | None = None

    def _two(self, op: str, other, swap: bool = False) -> Node:
        other = node(other)
        return Node(op, (other, self) if swap else (self, other))

    def __add__(self, other):
        return self._two("add", other)

    def __radd__(self, other):
        return self._two("add", other, True)

    def __sub__(self, other):
        return self._two("sub", other)

    def __rsub__(self, other):
        return self._two("sub", other, True)

    def __mul__(self, other):
        return self._two("mul", other)

    def __rmul__(self, other):
        return self._two("mul", other, True)

    def __truediv__(self, other):
        return self._two("div", other)

    def __rtruediv__(self, other):
        return self._two("div", other, True)

    def __pow__(self, other):
        return self._two("pow", other)

    def __neg__(self):
        return Node("neg", (self,))

    def __str__(self) -> str:
        return to_string(self)


def const(value: float) -> Node:
    return Node("const", value=float(value))


def var(name: str) -> Node:
    return Node("var", value=name)


def node(x) -> Node:
    return x if isinstance(x, Node) else const(x)


def call(name: str, *args) -> Node:
    return Node(name.lower(), tuple(map(node, args)))


def _guard(bad: Column, result: Column, message: str, safe: bool) -> Column:
    return F.when(bad, F.lit(None).cast("double") if safe else F.raise_error(F.lit(message)).cast("double")).otherwise(result)


def _sum(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


_PLAIN = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "abs": F.abs}
#: Names of calls and how many arguments they take; None: that many or more.
ARITY = {
    "add": (2, 2), "sub": (2, 2), "mul": (2, 2), "div": (2, 2), "pow": (2, 2), "neg": (1, 1), "abs": (1, 1), "round": (1, 1), "floor": (1, 1), "ceil": (1, 1),
    "sqrt": (1, 1), "exp": (1, 1), "ln": (1, 1), "log": (1, 1), "log10": (1, 1), "max": (2, None), "min": (2, None), "avg": (1, None), "mean": (1, None), "sum": (1, None),
    "clamp": (3, 3), "lerp": (3, 3), "if": (3, 3), **{name: (0, 1) for name in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh")},
}


def column(tree: Node, safe: bool = False) -> Column:
    """The column that computes the tree; variables are column names."""
    if tree.op == "const":
        return F.lit(float(tree.value))
    if tree.op == "var":
        return F.col(tree.value).cast("double")
    if tree.op not in ARITY:
        raise ValueError(f"unknown function {tree.op}")
    least, most = ARITY[tree.op]
    if len(tree.args) < least or most is not None and len(tree.args) > most:
        raise ValueError(f"{tree.op} takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} arguments, not {len(tree.args)}")
    a = [column(x, safe) for x in tree.args]
    match tree.op:
        case "add":
            return a[0] + a[1]
        case "sub":
            return a[0] - a[1]
        case "mul":
            return a[0] * a[1]
        case "div":
            return _guard(a[1] == 0, F.try_divide(a[0], a[1]), "division by zero", safe)
        case "pow":
            return F.pow(a[0], a[1])
        case "neg":
            return -a[0]
        case "round":
            return F.round(a[0])
        case "floor":
            return F.floor(a[0]).cast("double")
        case "ceil":
            return F.ceil(a[0]).cast("double")
        case "sqrt":
            return _guard(a[0] < 0, F.sqrt(a[0]), "square root of a negative number", safe)
        case "ln" | "log":
            return _guard(a[0] <= 0, F.ln(a[0]), "logarithm of a number that isn't positive", safe)
        case "log10":
            return _guard(a[0] <= 0, F.log10(a[0]), "logarithm of a number that isn't positive", safe)
        case "max":
            return F.greatest(*a)
        case "min":
            return F.least(*a)
        case "avg" | "mean":
            return _sum(a) / len(a)
        case "sum":
            return _sum(a)
        case "clamp":
            return F.least(F.greatest(a[0], a[1]), a[2])
        case "lerp":  # the second argument is the position
            return a[0] + (a[2] - a[0]) * a[1]
        case "if":
            return F.when(a[0] > 0, a[1]).otherwise(a[2])
    return _PLAIN[tree.op](a[0]) if a else F.lit(0.0)


def is_constant(tree: Node) -> bool:
    return tree.op != "var" and all(map(is_constant, tree.args))


def complexity(tree: Node) -> int:
    """Number of nodes."""
    return 1 + sum(map(complexity, tree.args))


def variables(tree: Node) -> set[str]:
    return ({tree.value} if tree.op == "var" else set()).union(*map(variables, tree.args))


def folded(tree: Node) -> Node:
    """Sums, differences, products and quotients of constants are computed; the rest is left to Catalyst."""
    args = tuple(map(folded, tree.args))
    values = [x.value for x in args if x.op == "const"]
    if len(values) == len(args) == 2 and not (tree.op == "div" and values[1] == 0):
        compute = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: x / y}.get(tree.op)
        if compute:
            return const(compute(*values))
    return Node(tree.op, args, tree.value)


_SIGNS = {"add": "+", "sub": "-", "mul": "*", "div": "/", "pow": "^"}


def to_string(tree: Node) -> str:
    if tree.op == "const":
        return f"{tree.value:g}"
    if tree.op == "var":
        return str(tree.value)
    if tree.op in _SIGNS:
        return f"({to_string(tree.args[0])} {_SIGNS[tree.op]} {to_string(tree.args[1])})"
    if tree.op == "neg":
        return f"-{to_string(tree.args[0])}"
    return f"{tree.op}({', '.join(map(to_string, tree.args))})"


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(.))")


def parse(text: str) -> Node:
    """Numbers, names, calls, ``+ - * / ^``, parentheses and ``c ? a : b``."""
    tokens = [m.groups() for m in _TOKEN.finditer(text.strip())]
    at = 0

    def peek() -> str | None:
        return tokens[at][2] if at < len(tokens) else None

    def take(sign: str) -> bool:
        nonlocal at
        if peek() == sign:
            at += 1
            return True
        return False

    def expect(sign: str) -> None:
        if not take(sign):
            raise ValueError(f"{sign} expected in {text!r}")

    def choice() -> Node:
        test = additive()
        if take("?"):
            yes = choice()
            expect(":")
            return Node("if", (test, yes, choice()))
        return test

    def additive() -> Node:
        left = multiplied()
        while peek() in ("+", "-"):
            left = (left + multiplied()) if take("+") else (expect("-"), left - multiplied())[1]
        return left

    def multiplied() -> Node:
        left = signed()
        while peek() in ("*", "/"):
            left = (left * signed()) if take("*") else (expect("/"), left / signed())[1]
        return left

    def signed() -> Node:
        if take("-"):
            return -signed()
        take("+")
        base = primary()
        return base ** signed() if take("^") else base

    def primary() -> Node:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"{text!r} ends too early")
        number, name, _ = tokens[at]
        if number:
            at += 1
            return const(float(number))
        if name:
            at += 1
            if not take("("):
                return var(name)
            args = []
            if not take(")"):
                args.append(choice())
                while take(","):
                    args.append(choice())
                expect(")")
            return call(name, *args)
        expect("(")
        inner = choice()
        expect(")")
        return inner

    tree = choice()
    if at < len(tokens):
        raise ValueError(f"unexpected {tokens[at]} in {text!r}")
    return tree
