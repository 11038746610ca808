"""Chat formatting: a small sandboxed template language compiled to closures.

A template is parsed into a syntax tree, constant parts are folded, and the tree
becomes nested Python closures, once per task.  The language has text, ``{{ value }}``,
``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for x in list %} {% endfor %}`` and
``{% generation %} {% endgeneration %}``, which marks what a model is to learn.  Values
are literals, names, ``a.b`` on given dictionaries, ``+``, ``==``, ``!=``, ``not``, ``and``,
``or`` and the filters escape, trim, upper, lower.  There are no calls, no Python
attributes and no assignments, so a template can read what it is given and no more.

Control strings inside texts are made harmless reversibly: ``escape`` puts a
backslash behind their first character (one more if there already are some), and
``unescape`` takes one away.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import as_batch

#: Strings that steer models or mark turns here.
CONTROL = ("<|turn|>", "<|says|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TEMPLATE = ("<s>{% for m in messages %}<|turn|>{{ m.role | escape }}<|says|>"
            "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
            "{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}</s>")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.S)
_PLAIN = re.compile("|".join(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:]) for c in CONTROL))
_MARKED = re.compile("|".join(re.escape(c[0]) + r"(\\+)" + re.escape(c[1:]) for c in CONTROL))


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: m[0][0] + m[0][2:], text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


# --- syntax ------------------------------------------------------------------

@dataclass
class Node:
    kind: str            # text value if for generation | const name attr filter not and or == != +
    parts: tuple = ()


class TemplateError(ValueError):
    pass


_LEX = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.|+()]))")


class Expression:
    """Recursive descent, one method per level of precedence."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def parse(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def took(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def chain(self, below, *ops: str) -> Node:
        node = below()
        while op := self.took(*ops):
            node = Node(op, (node, below()))
        return node

    def either(self) -> Node:
        return self.chain(self.both, "or")

    def both(self) -> Node:
        return self.chain(self.negated, "and")

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.took("not") else self.chain(self.total, "==", "!=")

    def total(self) -> Node:
        return self.chain(self.filtered, "+")

    def filtered(self) -> Node:
        node = self.atom()
        while self.took("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Node("filter", (name, node))
        return node

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> Node:
        if self.took("("):
            node = self.either()
            if not self.took(")"):
                raise TemplateError("a bracket is not closed")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        kind, value = self.tokens[self.at]
        if kind in ("str", "num"):
            self.at += 1
            return Node("const", (value[1:-1] if kind == "str" else int(value),))
        node = Node("name", (self.word(),))
        while self.took("."):
            node = Node("attr", (node, self.word()))
        return node


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)


def parse(source: str) -> list[Node]:
    """The tree of a template.  Unknown or unclosed tags are errors."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        pieces += [("text", source[at:m.start()]), ("value", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    pieces.append(("text", source[at:]))
    pieces = [p for p in pieces if p != ("text", "")]

    def block(i: int, ends: tuple[str, ...]) -> tuple[list[Node], int]:
        out: list[Node] = []
        while i < len(pieces):
            kind, body = pieces[i]
            word = body.split(None, 1)[0] if kind == "tag" and body else ""
            if kind == "text":
                out.append(Node("text", (body,)))
            elif kind == "value":
                out.append(Node("value", (Expression(body).parse(),)))
            elif word in ends:
                return out, i
            elif word == "if":
                node, i = choice(i, body[2:])
                out.append(node)
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", body, re.S)
                if not m:
                    raise TemplateError(f"cannot read {body!r}")
                inner, i = block(i + 1, ("endfor",))
                out.append(Node("for", (m[1], Expression(m[2]).parse(), inner)))
            elif word == "generation":
                inner, i = block(i + 1, ("endgeneration",))
                out.append(Node("generation", (inner,)))
            else:
                raise TemplateError(f"unknown tag {body!r}")
            i += 1
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, i

    def choice(i: int, condition: str) -> tuple[Node, int]:
        test = Expression(condition).parse()
        then, i = block(i + 1, ("elif", "else", "endif"))
        body = pieces[i][1]
        if body.startswith("elif"):
            node, i = choice(i, body[4:])
            return Node("if", (test, then, [node])), i
        if body.startswith("else"):
            other, i = block(i + 1, ("endif",))
            return Node("if", (test, then, other)), i
        return Node("if", (test, then, [])), i

    return block(0, ())[0]


def folded(nodes: list[Node]) -> list[Node]:
    """Constants computed, decided branches chosen, neighbouring texts joined."""
    out: list[Node] = []
    for n in nodes:
        if n.kind == "value":
            value = constant(n.parts[0])
            new = [Node("text", (shown(value.parts[0]),))] if value.kind == "const" else [Node("value", (value,))]
        elif n.kind == "if":
            test, then, other = constant(n.parts[0]), folded(n.parts[1]), folded(n.parts[2])
            new = (then if test.parts[0] else other) if test.kind == "const" else [Node("if", (test, then, other))]
        elif n.kind == "for":
            new = [Node("for", (n.parts[0], constant(n.parts[1]), folded(n.parts[2])))]
        elif n.kind == "generation":
            new = [Node("generation", (folded(n.parts[0]),))]
        else:
            new = [n]
        for x in new:
            if x.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", (out[-1].parts[0] + x.parts[0],))
            else:
                out.append(x)
    return out


def constant(n: Node) -> Node:
    if n.kind in ("const", "name"):
        return n
    if n.kind == "attr":
        return Node("attr", (constant(n.parts[0]), n.parts[1]))
    if n.kind == "filter":
        n = Node("filter", (n.parts[0], constant(n.parts[1])))
        return Node("const", (evaluator(n)({}),)) if n.parts[1].kind == "const" else n
    n = Node(n.kind, tuple(constant(x) for x in n.parts))
    return Node("const", (evaluator(n)({}),)) if all(x.kind == "const" for x in n.parts) else n


# --- closures ------------------------------------------------------------------

def shown(value) -> str:
    return "" if value is None else str(value)


def evaluator(n: Node) -> Callable[[dict], object]:
    p = n.parts
    if n.kind == "const":
        return lambda env: p[0]
    if n.kind == "name":
        return lambda env: env.get(p[0])
    if n.kind == "attr":
        of, key = evaluator(p[0]), p[1]
        return lambda env: v.get(key) if isinstance(v := of(env), dict) else None
    if n.kind == "filter":
        run, of = FILTERS[p[0]], evaluator(p[1])
        return lambda env: run(shown(of(env)))
    a = evaluator(p[0])
    if n.kind == "not":
        return lambda env: not a(env)
    b = evaluator(p[1])
    return {"and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env), "==": lambda env: a(env) == b(env),
            "!=": lambda env: a(env) != b(env), "+": lambda env: shown(a(env)) + shown(b(env))}[n.kind]


class Output:
    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def sequence(nodes: list[Node]) -> Callable[[dict, Output], None]:
    steps = [renderer(n) for n in nodes]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)
    return run


def renderer(n: Node) -> Callable[[dict, Output], None]:
    p = n.parts
    if n.kind == "text":
        return lambda env, out: out.put(p[0])
    if n.kind == "value":
        value = evaluator(p[0])
        return lambda env, out: out.put(shown(value(env)))
    if n.kind == "if":
        test, then, other = evaluator(p[0]), sequence(p[1]), sequence(p[2])
        return lambda env, out: then(env, out) if test(env) else other(env, out)
    if n.kind == "for":
        name, many, body = p[0], evaluator(p[1]), sequence(p[2])

        def loop(env: dict, out: Output) -> None:
            items = many(env)
            items = items if isinstance(items, list) else []
            for i, item in enumerate(items):
                body({**env, name: item, "loop": {"index0": i, "first": i == 0, "last": i == len(items) - 1}}, out)
        return loop
    inner = sequence(p[0])

    def learned(env: dict, out: Output) -> None:
        start = out.length
        inner(env, out)
        out.spans.append((start, out.length))
    return learned


def compiled(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """variables -> (text, spans in code points that generation blocks have written)."""
    run = sequence(folded(parse(source)))

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(dict(variables), out)
        return "".join(out.parts), out.spans
    return render


# --- on tables ------------------------------------------------------------------

def formatted(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Per conversation: conv_id, formatted, spans (array of start, stop; code points).

    Rows are ordered by turn (NULL first; ties by role and text); NULL roles and
    texts are empty; repeated rows are turns of their own; rows with a NULL conv_id
    are one conversation.  Columns besides conv_id, turn, role, text are not read.
    """
    compiled(template)  # an error shows here, not in a task
    talks = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))).alias("messages"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", span)])

    def run(batches):
        render = compiled(template)
        for batch in batches:
            rows = [(c, *render({"messages": m})) for c, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield as_batch([(c, t, [{"start": a, "stop": b} for a, b in s]) for c, t, s in rows], schema)

    return talks.mapInArrow(run, "conv_id long, formatted string, spans array<struct<start: long, stop: long>>")


def read_back(talks: DataFrame) -> DataFrame:
    """What formatted conversations say, from the text alone: turns (role, text) and learned (texts under the mask)."""
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    schema = pa.schema([("conv_id", pa.int64()), ("turns", turn), ("learned", pa.list_(pa.string())), ("formatted_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            yield as_batch([(c, [{"role": unescape(r), "text": unescape(x)} for r, x in _TURN.findall(t)],
                             [unescape(t[s["start"]:s["stop"]]) for s in spans], len(t))
                            for c, t, spans in zip(*(col.to_pylist() for col in batch.columns))], schema)

    return talks.select("conv_id", "formatted", "spans").mapInArrow(
        run, "conv_id long, turns array<struct<role: string, text: string>>, learned array<string>, formatted_chars long")


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of :func:`read_back`."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
