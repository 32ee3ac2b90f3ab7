"""Forms to time expressions: names become signals of one trace, closures, macros and virtual signals are inlined."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import functions as F

from sigspark.lang.reader import Symbol
from sigspark.lang.values import Closure, Env, LangError, Macro, Virtual
from sigspark.operators.scopes import resolve
from sigspark.timeexpr import INDEX, TS, Expr, const

if TYPE_CHECKING:
    from sigspark.lang.interp import Interpreter
    from sigspark.session import Trace


class NotCompilable(Exception):
    """The form needs the interpreter."""


class MissingSignal(NotCompilable):
    """The trace has no signal of that name."""


class Compiler:
    """changing: variables that change between the indices at which the forms are asked; None if they can't be told."""

    def __init__(self, run: Interpreter, trace: Trace, changing: frozenset[str] | None = frozenset()):
        self.run, self.trace, self.changing, self.depth = run, trace, changing, 0

    def signal(self, name: str) -> Expr:
        s = self.run.session
        found = resolve(self.trace.names, s.aliases.get(name, name), s.scope, s.group)
        if found is None:
            raise MissingSignal(name)
        return self.trace.signal(found)

    def literal(self, v: Any) -> Expr:
        if isinstance(v, Expr):
            return v
        if isinstance(v, (bool, int, float)) or isinstance(v, str) and not isinstance(v, Symbol):
            return const(v)
        raise NotCompilable(v)

    def compile(self, form: Any, env: Env) -> Expr:
        if isinstance(form, Symbol):
            return self.symbol(form, env)
        if not isinstance(form, list):
            return self.literal(form)
        if not form:
            raise NotCompilable("()")
        head, args = form[0], form[1:]
        if isinstance(head, Symbol):
            frame = env.frame(self.run.session.aliases.get(head, head))
            if frame is not None:
                f = frame.names[self.run.session.aliases.get(head, head)]
                return self.expanded(f, args, env) if type(f) is Macro else self.call(f, args, env)
            if f := getattr(self, "form_" + NAMES.get(head, ""), None):
                return f(args, env)
        raise NotCompilable(form)

    def symbol(self, name: Symbol, env: Env) -> Expr:
        name = Symbol(self.run.session.aliases.get(name, name))
        if (frame := env.frame(name)) is not None:
            v = frame.names[name]
            if name in (self.changing or ()) and not isinstance(v, Expr):
                raise NotCompilable(name)
            return self.compile(v.form, v.env) if isinstance(v, Virtual) else self.literal(v)
        if name in ("INDEX", "index"):
            return INDEX
        if name in ("TS", "ts"):
            return TS
        if v := self.run.session.virtual.get(name):
            return self.compile(v.form, v.env)
        return self.signal(name)

    def call(self, f: Any, args: list, env: Env) -> Expr:
        if not isinstance(f, Closure) or type(f) is not Closure or f.rest is not None or len(f.body) != 1 or len(args) != len(f.params):
            raise NotCompilable("call")
        self.depth += 1
        if self.depth > 50:
            raise NotCompilable("recursion")
        try:
            return self.compile(f.body[0], Env(f.env, {p: self.compile(a, env) for p, a in zip(f.params, args, strict=True)}))
        finally:
            self.depth -= 1

    def expanded(self, m: Macro, args: list, env: Env) -> Expr:
        """A macro's call: expanded once, if every index gives the same form, and that compiled."""
        if self.changing is None or not self._builds(m.body, m.env, {*m.params, *([m.rest] if m.rest is not None else [])}):
            raise NotCompilable("macro")
        self.depth += 1
        if self.depth > 50:
            raise NotCompilable("recursion")
        try:
            return self.compile(self.run.expand(m, args), env)
        except LangError as e:  # left to the interpreter, which raises it where it comes to the call
            raise NotCompilable("macro") from e
        finally:
            self.depth -= 1

    def _builds(self, forms: list, env: Env, own: set[str]) -> bool:
        """Whether the forms only build a value out of variables of their own: nothing is changed, and no signal, cursor or other variable read."""

        def template(f: Any) -> bool:
            if not isinstance(f, list):
                return True
            if len(f) == 2 and isinstance(f[0], Symbol) and f[0] in ("unquote", "unquote-splice"):
                return builds(f[1], own)
            return all(map(template, f))

        def builds(f: Any, own: set[str]) -> bool:
            if isinstance(f, Symbol):
                return f in own and f not in self.run.session.aliases
            if not isinstance(f, list) or not f:
                return True
            head, args = f[0], f[1:]
            if not isinstance(head, Symbol) or head in own or head in self.run.session.aliases or env.frame(head) is not None:
                return False
            if head == "quote":
                return True
            if head == "quasiquote":
                return len(args) == 1 and template(args[0])
            return head in BUILDING and all(builds(x, own) for x in args)

        return all(builds(f, own) for f in forms)

    def constant(self, form: Any, env: Env) -> Any:
        """A form without signals, evaluated now."""
        if self._pure(form, env):
            return self.run.eval(form, env)
        raise NotCompilable(form)

    def _pure(self, form: Any, env: Env) -> bool:
        if isinstance(form, Symbol):
            return (f := env.frame(form)) is not None and not isinstance(f.names[form], (Expr, Virtual)) and form not in (self.changing or ())
        if isinstance(form, list):
            return bool(form) and isinstance(form[0], Symbol) and form[0] in PURE and all(self._pure(x, env) for x in form[1:])
        return True

    # -- forms ---------------------------------------------------------------------------------------------

    def form_get(self, args, env):
        name = args[0]
        if isinstance(name, list) and len(name) == 2 and name[0] == "quote":
            name = name[1]
        elif isinstance(name, Symbol):
            name = v if (f := env.frame(name)) is not None and isinstance(v := f.names[name], str) else name
        elif isinstance(name, list):
            name = self.constant(name, env)
        if not isinstance(name, str):
            raise NotCompilable("get")
        if v := self.run.session.virtual.get(name):
            return self.compile(v.form, v.env)
        return self.signal(name)

    def form_resolve_group(self, args, env):
        name = self.run.session.group + _name(args[0])
        if name not in self.trace.widths:
            raise MissingSignal(name)
        return self.trace.signal(name)

    def form_resolve_scope(self, args, env):
        name = self.run.session.scope + _name(args[0])
        if (f := env.frame(name)) is not None:
            return self.literal(f.names[name])
        if name not in self.trace.widths:
            raise MissingSignal(name)
        return self.trace.signal(name)

    def form_reval(self, args, env):
        k = self.constant(args[1], env)
        if not isinstance(k, int):
            raise NotCompilable("reval")
        e = self.compile(args[0], env)
        if e.timed:
            raise NotCompilable("reval of the time")
        return e.at(k)

    def form_eq(self, args, env):
        first, *rest = [self.compile(a, env) for a in args]
        return _all([_comparable(first, x, first == x) for x in rest])

    def form_neq(self, args, env):
        first, *rest = [self.compile(a, env) for a in args]
        return _all([_comparable(first, x, first != x) for x in rest])

    def _chain(self, args, env, op):
        v = [self.compile(a, env) for a in args]
        if any(x.kind == "str" for x in v):
            raise NotCompilable("order of strings")
        return _all([op(_numeric(a), _numeric(b)) for a, b in zip(v, v[1:], strict=False)])

    def form_gt(self, args, env):
        return self._chain(args, env, lambda a, b: a > b)

    def form_lt(self, args, env):
        return self._chain(args, env, lambda a, b: a < b)

    def form_ge(self, args, env):
        return self._chain(args, env, lambda a, b: a >= b)

    def form_le(self, args, env):
        return self._chain(args, env, lambda a, b: a <= b)

    def form_and(self, args, env):
        return _all([self.compile(a, env) for a in args])

    def form_or(self, args, env):
        out = self.compile(args[0], env).true()
        for a in args[1:]:
            out = out | self.compile(a, env)
        return out

    def form_not(self, args, env):
        return ~self.form_or(args, env)

    def _fold(self, args, env, op):
        v = [_numeric(self.compile(a, env)) for a in args]
        out = v[0]
        for x in v[1:]:
            out = op(out, x)
        return out

    def form_add(self, args, env):
        return self._fold(args, env, lambda a, b: a + b)

    def form_sub(self, args, env):
        if len(args) == 1:
            return const(0) - _numeric(self.compile(args[0], env))
        v = [_numeric(self.compile(a, env)) for a in args]
        if v[0].kind == "int":  # the first one's type decides
            v = [x.map(lambda c: c.cast("long"), "int") if x.kind == "real" else x for x in v]
        out = v[0]
        for x in v[1:]:
            out = out - x
        return out

    def form_mul(self, args, env):
        return self._fold(args, env, lambda a, b: a * b)

    def form_div(self, args, env):
        return self._fold(args, env, lambda a, b: a / b)

    def form_mod(self, args, env):
        return self._fold(args, env, lambda a, b: a % b)

    def _bits(self, args, env, op):
        v = [_numeric(self.compile(a, env)).map(lambda c: c.cast("long"), "int") for a in args]
        out = v[0]
        for x in v[1:]:
            out = out._with(x, op, "int")
        return out

    def form_bor(self, args, env):
        return self._bits(args, env, lambda a, b: a.bitwiseOR(b))

    def form_band(self, args, env):
        return self._bits(args, env, lambda a, b: a.bitwiseAND(b))

    def form_bxor(self, args, env):
        return self._bits(args, env, lambda a, b: a.bitwiseXOR(b))

    def form_abs(self, args, env):
        return _numeric(self.compile(args[0], env)).map(F.abs)

    def form_slice(self, args, env):
        at = [self.constant(a, env) for a in args[1:]]
        x = self.compile(args[0], env)
        if x.kind != "int" or not all(isinstance(i, int) for i in at):
            raise NotCompilable("slice")
        return x.bits(max(at), min(at))

    def form_if(self, args, env):
        c, a = self.compile(args[0], env).true(), self.compile(args[1], env)
        b = self.compile(args[2], env) if len(args) > 2 else None
        if b is None or a.kind != b.kind:
            raise NotCompilable("if")
        pair = a._with(b, lambda x, y: F.struct(x.alias("a"), y.alias("b")), a.kind)
        return c._with(pair, lambda k, p: F.when(k, p["a"]).otherwise(p["b"]), a.kind)


def _name(form: Any) -> str:
    return str(form[1]) if isinstance(form, list) and len(form) == 2 and form[0] == "quote" else str(form)


def _numeric(e: Expr) -> Expr:
    if e.kind == "bool":
        return e.map(lambda c: c.cast("long"), "int")
    if e.kind == "str":
        raise NotCompilable("a string in arithmetic")
    return e


def _comparable(a: Expr, b: Expr, out: Expr) -> Expr:
    if (a.kind == "str") != (b.kind == "str") or (a.kind == "bool") != (b.kind == "bool"):
        raise NotCompilable("comparison of different kinds")
    return out


def _all(v: list[Expr]) -> Expr:
    out = v[0].true()
    for x in v[1:]:
        out = out & x
    return out


NAMES = {"get": "get", "resolve-group": "resolve_group", "resolve-scope": "resolve_scope", "reval": "reval", "rel_eval": "reval", "@": "reval", "=": "eq", "!=": "neq", ">": "gt", "<": "lt", ">=": "ge", "<=": "le", "&&": "and", "and": "and", "||": "or", "or": "or", "!": "not", "not": "not", "+": "add", "-": "sub", "*": "mul", "/": "div", "mod": "mod", "bor": "bor", "band": "band", "bxor": "bxor", "abs": "abs", "slice": "slice", "if": "if"}
PURE = frozenset("+ - * / ** mod abs floor ceil round concat string-append string->symbol symbol->string int->string string->int first second last length max min".split())
BUILDING = PURE | frozenset("do if gensym list rest = != > < >= <= ! not && || and or".split())
