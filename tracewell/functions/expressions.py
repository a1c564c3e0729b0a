"""Expression values: unsigned 64-bit arithmetic, postfix evaluation, parsing, text forms.

An expression is an array of postfix tokens (tok, op, ival, name): ``Const`` pushes
``ival``, ``Var`` pushes the value of ``name`` (0 if the environment lacks it), and
``Op`` joins the two topmost values. Values are bit patterns in a BIGINT and stand for
unsigned numbers; arithmetic wraps at 2^64.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "struct<tok:string,op:string,ival:bigint,name:string>"
#: C precedence, loosest first.
_LEVELS = [("Or", "||"), ("And", "&&"), ("BitOr", "|"), ("BitXor", "^"), ("BitAnd", "&"), ("Eq", "=="), ("Ne", "!="), ("Le", "<="), ("Ge", ">="), ("Lt", "<"), ("Gt", ">"), ("Shl", "<<"), ("Shr", ">>"), ("Add", "+"), ("Sub", "-"), ("Mul", "*"), ("Div", "/"), ("Mod", "%")]
_RANK = {"||": 0, "&&": 1, "|": 2, "^": 3, "&": 4, "==": 5, "!=": 5, "<=": 6, ">=": 6, "<": 6, ">": 6, "<<": 7, ">>": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
_NAME = {s: n for n, s in _LEVELS}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, where writing it out would repeat it many times."""
    return F.get(F.transform(F.array(value), body), 0)


def u64_less(a: Column, b: Column) -> Column:
    """Unsigned comparison of two bit patterns."""
    low = F.lit(-(1 << 63)).cast("bigint")
    return a.bitwiseXOR(low) < b.bitwiseXOR(low)


def shift_left(a: Column, n: Column) -> Column:
    """a << n, 0 from 64 on (Spark masks shift counts)."""
    return F.when((n >= 64) | (n < 0), F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", a.cast("bigint"), n.cast("int")))


def genmask(high: Column, low: Column) -> Column:
    """Bits low..high set."""
    ones = F.lit(-1).cast("bigint")
    return F.call_function("shiftrightunsigned", ones, (63 - high).cast("int")).bitwiseAND(shift_left(ones, low))


def delay_ns(callee: Column, amount: Column) -> Column:
    """Nanoseconds of a delay call; ssleep counts as milliseconds, as mdelay and msleep do."""
    return F.when(callee.isin("mdelay", "msleep", "ssleep"), amount * 1_000_000).when(callee == "udelay", amount * 1000).when(callee == "ndelay", amount)


def seeded_memory(size: int = 4096) -> Column:
    """The test memory image: byte i is (0x5A + 37 i) mod 256."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i * 37 + 90) % 256)


def read_bytes(memory: Column, offset: Column, n: int, big_endian: bool = False) -> Column:
    """The unsigned value of n bytes at an offset."""
    part = F.slice(memory, offset + 1, n)
    if not big_endian:
        part = F.reverse(part)
    return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)


_LOW = 0xFFFFFFFF


def _big(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _right(a: Column, n: int | Column) -> Column:
    return F.call_function("shiftrightunsigned", a, n if isinstance(n, Column) else F.lit(n))


def _left(a: Column, n: int) -> Column:
    return F.call_function("shiftleft", a, F.lit(n))


def u64_add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64, from sums of the halves."""
    low = a.bitwiseAND(_big(_LOW)) + b.bitwiseAND(_big(_LOW))
    return _left(_right(a, 32) + _right(b, 32) + _right(low, 32), 32).bitwiseOR(low.bitwiseAND(_big(_LOW)))


def u64_sub(a: Column, b: Column) -> Column:
    """a - b modulo 2^64."""
    low = a.bitwiseAND(_big(_LOW)) - b.bitwiseAND(_big(_LOW))
    return _left(_right(a, 32) - _right(b, 32) + F.call_function("shiftright", low, F.lit(32)), 32).bitwiseOR(low.bitwiseAND(_big(_LOW)))


def u64_mul(a: Column, b: Column) -> Column:
    """a * b modulo 2^64, from products of 32 by 16 bits."""
    out = None
    for k in range(4):
        digit = _right(b, 16 * k).bitwiseAND(_big(0xFFFF))
        low, high = a.bitwiseAND(_big(_LOW)) * digit, _right(a, 32) * digit
        part = _left(u64_add(low, _left(high, 32)), 16 * k)
        out = part if out is None else u64_add(out, part)
    return out


def u64_divmod(a: Column, b: Column) -> tuple[Column, Column]:
    """a / b and a % b of unsigned numbers; null where b is 0.

    A divisor of 2^63 or more goes in once or not at all. Else half of a is divided, which
    is never negative, and the quotient doubled and put right by the remainder.
    """
    safe = F.when(b > 0, b)
    half, odd = _right(a, 1), a.bitwiseAND(_big(1))
    q = F.call_function("div", half, safe)
    r = half - q * safe
    over = r >= safe - r - odd
    small = u64_less(a, b)
    quotient = F.when(b < 0, F.when(small, _big(0)).otherwise(_big(1))).otherwise(_left(q, 1).bitwiseOR(F.when(over, _big(1)).otherwise(_big(0))))
    rest = F.when(b < 0, F.when(small, a).otherwise(u64_sub(a, b))).otherwise(F.when(over, r - (safe - r - odd)).otherwise(r + r + odd))
    return F.when(b != 0, quotient), F.when(b != 0, rest)


def shift_right(a: Column, n: Column) -> Column:
    """a >> n with zeros, 0 from 64 on (a count of 2^63 or more is negative here)."""
    return F.when((n >= 64) | (n < 0), _big(0)).otherwise(_right(a, n.cast("int")))


def _flag(c: Column) -> Column:
    return c.cast("bigint")


#: The operators, each of two unsigned numbers.
OPERATORS = {
    "Add": u64_add, "Sub": u64_sub, "Mul": u64_mul, "Div": lambda a, b: u64_divmod(a, b)[0], "Mod": lambda a, b: u64_divmod(a, b)[1],
    "BitAnd": lambda a, b: a.bitwiseAND(b), "BitOr": lambda a, b: a.bitwiseOR(b), "BitXor": lambda a, b: a.bitwiseXOR(b), "Shl": shift_left, "Shr": shift_right,
    "Eq": lambda a, b: _flag(a == b), "Ne": lambda a, b: _flag(a != b), "Lt": lambda a, b: _flag(u64_less(a, b)), "Gt": lambda a, b: _flag(u64_less(b, a)), "Le": lambda a, b: _flag(~u64_less(b, a)), "Ge": lambda a, b: _flag(~u64_less(a, b)),
    "And": lambda a, b: _flag((a != 0) & (b != 0)), "Or": lambda a, b: _flag((a != 0) | (b != 0)),
}


def _bits(x: Column, places: Column) -> Column:
    """The bits ``hi << 8 | lo`` of a value."""
    low = places.bitwiseAND(_big(255))
    return shift_right(shift_left(x, 63 - _right(places, 8)), 63 - _right(places, 8) + low)


def evaluate(tokens: Column, env: Column) -> Column:
    """Value of a postfix expression that differs by row, in an environment map.

    A name that the map lacks is 0; null if an operand is missing or unknown, or a divisor
    is 0. Comparisons give 0 or 1. For an expression that is the same in all rows use
    ``compiled``, which is no fold.
    """

    def apply(op: Column, a: Column, b: Column) -> Column:
        out = F.when(F.lit(False), _big(0))
        for name, f in OPERATORS.items():
            out = out.when(op == name, f(a, b))
        return out

    def step(stack: Column, t: Column) -> Column:
        n = F.size(stack)
        push = F.when(t["tok"] == "Const", t["ival"]).when(t["tok"] == "Var", F.coalesce(F.try_element_at(env, t["name"]), _big(0)))
        top, under = F.get(stack, n - 1), F.get(stack, n - 2)
        joined = F.transform(F.array(F.struct(under.alias("a"), top.alias("b"))), lambda p: apply(t["op"], p["a"], p["b"]))
        keep = lambda k: F.slice(stack, 1, F.greatest(n - k, F.lit(0)))
        return (
            F.when(t["tok"] == "Op", F.concat(keep(2), joined)).when(t["tok"] == "Bits", F.concat(keep(1), F.array(_bits(top, t["ival"]))))
            .when(t["tok"] == "Ite", F.concat(keep(3), F.array(F.when(F.get(stack, n - 3).isNotNull(), F.when(F.get(stack, n - 3) != 0, under).otherwise(top))))).otherwise(F.concat(stack, F.array(push)))
        )

    return F.get(F.aggregate(tokens, F.expr("cast(array() as array<bigint>)"), step), 0)


def compiled(tokens: list[tuple], env: dict[str, Column]) -> Column:
    """The value of one postfix expression, as a plain column expression of its variables; nulls as in ``evaluate``."""
    stack: list[Column] = []
    for tok, op, ival, name in tokens:
        if tok == "Const":
            stack.append(_big(ival))
        elif tok == "Var":
            stack.append(F.coalesce(env[name].cast("bigint"), _big(0)) if name in env else _big(0))
        elif tok == "Op":
            b, a = stack.pop(), stack.pop()
            stack.append(OPERATORS[op](a, b))
        elif tok == "Bits":
            stack.append(_bits(stack.pop(), _big(ival)))
        elif tok == "Ite":
            other, then, guard = stack.pop(), stack.pop(), stack.pop()
            stack.append(F.when(guard.isNotNull(), F.when(guard != 0, then).otherwise(other)))
        else:
            stack.append(F.lit(None).cast("bigint"))
    return stack[0]


def parse(text: str | None) -> list[tuple[str, str | None, int | None, str | None]] | None:
    """Postfix tokens of a C expression of numbers, names and binary operators, with C precedence; null if it is none."""
    if text is None:
        return None
    lexed = re.findall(r"\s*(0[xX][0-9a-fA-F]+|\d+|[A-Za-z_]\w*|\|\||&&|==|!=|<=|>=|<<|>>|[-+*/%&|^<>()])", text)
    if "".join(lexed) != re.sub(r"\s+", "", text):
        return None
    out: list[tuple[str, str | None, int | None, str | None]] = []
    ops: list[str] = []
    operand = True
    for t in lexed:
        if t == "(":
            if not operand:
                return None
            ops.append(t)
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(("Op", _NAME[ops.pop()], None, None))
            if not ops or operand:
                return None
            ops.pop()
        elif t in _RANK:
            if operand:
                return None
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[t]:
                out.append(("Op", _NAME[ops.pop()], None, None))
            ops.append(t)
            operand = True
        else:
            if not operand:
                return None
            value = int(t, 16 if t[:2] in ("0x", "0X") else 8 if re.fullmatch("0[0-7]+", t) else 10) & (1 << 64) - 1 if t[0].isdigit() else 0
            out.append(("Const", None, value - (value >> 63 << 64), None) if t[0].isdigit() else ("Var", None, None, t))
            operand = False
    while ops:
        if ops[-1] == "(":
            return None
        out.append(("Op", _NAME[ops.pop()], None, None))
    return None if operand else out


def vars_in(tokens: Column) -> Column:
    """The distinct names that an expression reads, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(tokens, lambda t: t["tok"] == "Var"), lambda t: t["name"])))


def has_top(tokens: Column) -> Column:
    """Whether an expression has an unknown part."""
    return F.exists(tokens, lambda t: t["tok"] == "Top")


def site_id(*parts: Column) -> Column:
    """path:line:column:offset:name."""
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def c_identifier(name: Column) -> Column:
    """A name with all but letters, digits and underscores replaced; empty, or before a digit, it is led by ``tu_``."""
    c = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(c.rlike("^(?:[0-9]|$)"), F.concat(F.lit("tu_"), c)).otherwise(c)
