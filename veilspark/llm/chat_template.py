"""A small sandboxed template language, compiled to Python closures.

Statements: text, ``{{ expression }}``, ``{% if %} {% elif %} {% else %}
{% endif %}``, ``{% for name in messages %} {% endfor %}`` (not nested) and
``{% generation %} {% endgeneration %}``, which marks what it writes as text
under the loss mask.  Expressions: strings, integers, ``true``/``false``,
names and fields of the loop variable and of ``loop`` (``index``, ``first``,
``last``), ``==``, ``!=``, ``not``, ``and``, ``or``, ``+`` and filters from a
given table.  There are no calls, no attributes of Python objects and no
other names: a template reaches nothing but its message.

``compile_template`` goes from source to tokens, to a syntax tree, folds
subtrees without names to constants (and drops dead branches, joins adjacent
text), and turns the rest into closures ``f(env, out)``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
LEX = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<int>[0-9]+)|(?P<name>[A-Za-z_][A-Za-z_0-9]*)"
                 r"|(?P<op>==|!=|[+|.()]))", re.S)
STRING_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
LOOP_FIELDS = {"index", "first", "last"}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    name: str
    field: str | None


@dataclass(frozen=True)
class Apply:  # kind: == != not and or + or "|filter"
    kind: str
    args: tuple


@dataclass(frozen=True)
class Write:
    expr: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing -----------------------------------------------------------------

def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = LEX.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text in expression: {source[at:at + 20]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class _Expression:
    def __init__(self, source: str, filters):
        self.tokens, self.at, self.filters = _lex(source), 0, filters

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, *values):
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Apply("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Apply("and", (left, self.negated()))
        return left

    def negated(self):
        if self.take("not"):
            return Apply("not", (self.negated(),))
        left = self.sum()
        if op := self.take("==", "!="):
            return Apply(op, (left, self.sum()))
        return left

    def sum(self):
        left = self.filtered()
        while self.take("+"):
            left = Apply("+", (left, self.filtered()))
        return left

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            tree = Apply("|" + name, (tree,))
        return tree

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: STRING_ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name":
            if value in ("true", "false"):
                return Const(value == "true")
            field = None
            if self.take("."):
                kind, field = self.peek()
                if kind != "name":
                    raise TemplateError("a field name is missing after '.'")
                self.at += 1
            return Field(value, field)
        if value == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("')' is missing")
            return tree
        raise TemplateError("an expression is missing")


def parse(source: str, filters) -> tuple:
    parts = [p for p in TAG.split(source) if p and not p.startswith("{#")]
    at = 0

    def block(ends: tuple[str, ...], in_loop: bool):
        nonlocal at
        nodes = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(Write(_Expression(part[2:-2], filters).whole()))
            elif not part.startswith("{%"):
                nodes.append(Write(Const(part)))
            else:
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(nodes), word, rest
                if word == "if":
                    nodes.append(branch(rest, in_loop))
                elif word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)
                    if not m or in_loop or m[1] == "loop":
                        raise TemplateError(f"loop not allowed: {part}")
                    nodes.append(For(m[1], block(("endfor",), True)[0]))
                elif word == "generation":
                    nodes.append(Generation(block(("endgeneration",), in_loop)[0]))
                else:
                    raise TemplateError(f"unknown tag {part}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), None, None

    def branch(test: str, in_loop: bool):
        tree = _Expression(test, filters).whole()
        then, word, rest = block(("elif", "else", "endif"), in_loop)
        other: tuple = ()
        if word == "elif":
            other = (branch(rest, in_loop),)
        elif word == "else":
            other = block(("endif",), in_loop)[0]
        return If(tree, then, other)

    return block((), False)[0]


# --- constant folding --------------------------------------------------------

def _text(value) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


def _operate(kind: str, args, filters):
    if kind == "==":
        return args[0] == args[1]
    if kind == "!=":
        return args[0] != args[1]
    if kind == "not":
        return not args[0]
    if kind == "+":
        return args[0] + args[1] if all(type(a) is int for a in args) else _text(args[0]) + _text(args[1])
    return filters[kind[1:]](_text(args[0]))


def fold_expression(tree, filters):
    if not isinstance(tree, Apply):
        return tree
    args = tuple(fold_expression(a, filters) for a in tree.args)
    if tree.kind in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (tree.kind == "and") else args[0]
    elif all(isinstance(a, Const) for a in args):
        return Const(_operate(tree.kind, [a.value for a in args], filters))
    return Apply(tree.kind, args)


def fold(nodes: tuple, filters) -> tuple:
    out: list = []

    def add(node) -> None:
        if isinstance(node, Write) and isinstance(node.expr, Const):
            text = _text(node.expr.value)
            if out and isinstance(out[-1], Write) and isinstance(out[-1].expr, Const):
                text = out.pop().expr.value + text
            node = Write(Const(text))
        out.append(node)

    for node in nodes:
        if isinstance(node, Write):
            add(Write(fold_expression(node.expr, filters)))
        elif isinstance(node, If):
            test = fold_expression(node.test, filters)
            if isinstance(test, Const):
                for inner in fold(node.then if test.value else node.other, filters):
                    add(inner)
            else:
                add(If(test, fold(node.then, filters), fold(node.other, filters)))
        elif isinstance(node, For):
            add(For(node.name, fold(node.body, filters)))
        else:
            add(Generation(fold(node.body, filters)))
    return tuple(out)


# --- closures ----------------------------------------------------------------

class Output:
    """Text written so far for one piece, and the loss spans in it."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.loss: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _expression_closure(tree, filters, names):
    if isinstance(tree, Const):
        value = tree.value
        return lambda env: value
    if isinstance(tree, Field):
        name, field = tree.name, tree.field
        if name not in names or field is None or (name == "loop" and field not in LOOP_FIELDS):
            raise TemplateError(f"unknown name {name}.{field}")
        return lambda env: env[name].get(field)
    kind = tree.kind
    args = [_expression_closure(a, filters, names) for a in tree.args]
    if kind == "and":
        return lambda env: args[0](env) and args[1](env)
    if kind == "or":
        return lambda env: args[0](env) or args[1](env)
    return lambda env: _operate(kind, [a(env) for a in args], filters)


def _closure(node, filters, names):
    if isinstance(node, Write):
        if isinstance(node.expr, Const):
            text = node.expr.value
            return lambda env, out: out.write(text)
        value = _expression_closure(node.expr, filters, names)
        return lambda env, out: out.write(_text(value(env)))
    if isinstance(node, If):
        test = _expression_closure(node.test, filters, names)
        then, other = _sequence(node.then, filters, names), _sequence(node.other, filters, names)
        return lambda env, out: (then if test(env) else other)(env, out)
    body = _sequence(node.body, filters, names)

    def generation(env, out):
        start = out.length
        body(env, out)
        out.loss.append((start, out.length))

    return generation


def _sequence(nodes, filters, names):
    steps = [_closure(n, filters, names) for n in nodes]

    def run(env, out):
        for step in steps:
            step(env, out)

    return run


class Template:
    """Renders a stream of messages piece by piece: a loop over the messages
    gives one piece a message, other top-level statements one piece a run."""

    def __init__(self, nodes: tuple, filters):
        self.nodes = nodes
        self.loops = sum(isinstance(n, For) for n in nodes)
        if self.loops > 1 or any(_holds_loop(n) for n in nodes if not isinstance(n, For)):
            raise TemplateError("one loop over the messages, at the top level")
        self.steps = [(n.name, _sequence(n.body, filters, {n.name, "loop"})) if isinstance(n, For)
                      else (None, _closure(n, filters, set())) for n in nodes]

    def stream(self, messages):
        """Yield ``(text, loss spans)``; ``messages`` is read once, one ahead."""
        for name, step in self.steps:
            if name is None:
                out = Output()
                step({}, out)
                yield "".join(out.parts), out.loss
                continue
            index, ahead = 0, next(messages, None)
            while ahead is not None:
                message, ahead = ahead, next(messages, None)
                index += 1
                out = Output()
                step({name: message, "loop": {"index": index, "first": index == 1, "last": ahead is None}}, out)
                yield "".join(out.parts), out.loss


def _holds_loop(node) -> bool:
    if isinstance(node, For):
        return True
    inner = (*node.then, *node.other) if isinstance(node, If) else node.body if isinstance(node, Generation) else ()
    return any(_holds_loop(n) for n in inner)


def compile_template(source: str, filters) -> Template:
    return Template(fold(parse(source, filters), filters), filters)
