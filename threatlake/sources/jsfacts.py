"""Facts of JavaScript and TypeScript files: scopes, literals, calls, declarations, references.

A small tokenizer and one pass over the tokens with a stack of brackets; no
syntax tree is built.  Spans are byte offsets.  A file whose brackets or tokens
do not fit gets ``ok`` false and no facts, and is listed by ``rejects``.  Markup
within code (JSX) is read as operators and words.

Spans nest, so one sweep over a file labels every fact with what encloses it:
references with the arguments and initialisers around them, literals and calls
with the declaration they initialise, arguments and initialisers with their first
literal.  ``threatlake.operators.taint`` joins on these labels, never on spans.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import LITERAL_BYTES

JS_EXTENSIONS = ["js", "mjs", "cjs", "jsx", "ts", "mts", "cts", "tsx"]

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<num>\d(?:[\w.]|(?<=[eE])[+-])*)|(?P<id>(?:[#$_A-Za-z\u0080-\uffff\U00010000-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[$\w\u0080-\uffff\U00010000-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"""
    r"""|(?P<punct>=>|\.\.\.|\?\.(?!\d)|[=!]==?|\*\*=?|&&=?|\|\|=?|\?\?=?|<<=?|>>>?=?|[-+*/%&|^<>]=|\+\+|--|[-{}()\[\];,<>+*/%&|^!~?:=.@])""",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
# Fixed values of the language.
KEYWORDS = set(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof let new null of return static super switch this throw true try "
    "typeof undefined var void while with yield async await get set interface type".split()
)
CONTROL = {"if", "for", "while", "switch", "catch", "with"}
_OPERANDS = {"this", "super", "null", "true", "false", "undefined", "of", "async", "get", "set", "type", "static", "let"}
_CONTEXTUAL = {"of", "async", "await", "get", "set", "type", "static", "let", "undefined"}
#: Words after which an expression goes on in the next line, and words whose parentheses hold a condition.
_PREFIXES = {"typeof", "void", "delete", "new", "await", "in", "of", "instanceof", "extends"}
_CONDITIONS = {"if", "while", "for", "with", "switch", "catch"}
_MODIFIERS = {"static", "get", "set", "async", "readonly", "public", "private", "protected", "declare", "abstract", "override", "accessor"}
_OPENERS = {"(": ")", "[": "]", "{": "}"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def _unescaped(body: str) -> str:
    def one(m: re.Match) -> str:
        x = m.group(1)
        if x[0] in "xu" and len(x) > 1:
            return chr(int(x.strip("xu{}"), 16))
        return _ESCAPES.get(x, "" if x == "\n" else x)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|.)", one, body, flags=re.S) if "\\" in body else body


def tokens_of(text: str) -> list[tuple[str, str, int, int]] | None:
    """(kind, text, start, end) of the tokens; template parts become brackets around their expressions; None on doubt."""
    out: list[tuple[str, str, int, int]] = []
    at, depth, templates = 0, 0, []
    # of every open parenthesis or brace: whether an operand has ended when it closes
    ends: list[bool] = []
    closed = False
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else len(text)

    def template(at: int) -> int:
        """Reads template text up to its end or its next expression; -1 if it does not end."""
        start = at
        while at < len(text):
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                out.append(("punct", ")", at, at + 1))
                return at + 1
            elif text.startswith("${", at):
                templates.append(depth)
                return at + 2
            else:
                at += 1
        return -1 if start <= len(text) else at

    while at < len(text):
        c = text[at]
        if c == "`":
            out.append(("tpl", "(", at, at + 1))
            closed = True
            at = template(at + 1)
            if at < 0:
                return None
            continue
        if c == "}" and templates and templates[-1] == depth:
            templates.pop()
            closed = True
            out.append(("punct", ",", at, at + 1))
            at = template(at + 1)
            if at < 0:
                return None
            continue
        if c == "/" and not text.startswith(("//", "/*"), at):
            last = out[-1] if out else ("punct", ";", 0, 0)
            operand = last[0] in ("str", "num") or last[1] == "]" or last[1] in (")", "}") and closed or last[1] in ("++", "--") or last[0] == "id" and (last[1] not in KEYWORDS or last[1] in _OPERANDS)
            found = None if operand else _REGEX.match(text, at)
            if found:
                out.append(("num", "/", at, found.end()))
                at = found.end()
                continue
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        if m.lastgroup != "skip":
            t, before = m.group(), out[-1] if out else ("punct", ";", 0, 0)
            if t == "(":
                # what follows a condition begins a statement
                ends.append(not (before[0] == "id" and before[1] in _CONDITIONS and (len(out) < 2 or out[-2][1] not in (".", "?."))))
            elif t == "{":
                # an object ends an operand, a block does not
                ends.append(before[0] == "punct" and before[1] not in (";", "{", "}", ")", "=>") or before[1] in ("return", "typeof", "default", "in", "of"))
            elif t in (")", "}"):
                closed = ends.pop() if ends else True
            out.append((m.lastgroup, _unescaped(t) if m.lastgroup == "id" else t, at, m.end()))
            depth += (m.group() == "{") - (m.group() == "}")
        at = m.end()
    return None if templates else out


def enclosing(intervals: Sequence[tuple[int, int]], spans: Sequence[tuple[int, int]]) -> list[list[int]]:
    """For every span the numbers of the intervals that hold it whole, outermost first; one sweep with a stack of open intervals."""
    opening = sorted(range(len(intervals)), key=lambda k: (intervals[k][0], -intervals[k][1]))
    found: list[list[int]] = [[] for _ in spans]
    stack: list[int] = []
    at = 0
    for k in sorted(range(len(spans)), key=lambda k: spans[k][0]):
        begin, end = spans[k]
        while at < len(opening) and intervals[opening[at]][0] <= begin:
            while stack and intervals[stack[-1]][1] <= intervals[opening[at]][0]:
                stack.pop()
            stack.append(opening[at])
            at += 1
        while stack and intervals[stack[-1]][1] <= begin:
            stack.pop()
        found[k] = [i for i in stack if intervals[i][1] >= end]
    return found


def _labels(literals: list, calls: list, declarations: list, references: list) -> dict[str, list]:
    """What encloses what: the lists stand in the order of the facts."""
    inits = [(a, b, k) for k, (_, _, a, b, _, _) in enumerate(declarations) if a is not None]
    args = [(a, b, k, j) for k, call in enumerate(calls) for j, (a, b) in enumerate(call[5])]
    begins = [v[1] for v in literals]

    def first_literal(a: int, b: int) -> int | None:
        k = bisect_left(begins, a)
        return k if k < len(literals) and literals[k][2] <= b else None

    init_spans, refs = [x[:2] for x in inits], [r[1:3] for r in references]
    earliest = lambda held: min((inits[i][2] for i in held), key=lambda symbol: declarations[symbol][5], default=None)
    return {
        "literal_of": [earliest(held) for held in enclosing(init_spans, [v[1:3] for v in literals])],
        "call_of": [earliest(held) for held in enclosing(init_spans, [c[2:4] for c in calls])],
        "in_inits": [[inits[i][2] for i in held] for held in enclosing(init_spans, refs)],
        "in_args": [[args[i][2:] for i in held] for held in enclosing([x[:2] for x in args], refs)],
        "arg_literal": [[first_literal(a, b) for a, b in call[5]] for call in calls],
        "init_literal": [None if a is None else first_literal(a, b) for _, _, a, b, _, _ in declarations],
    }


def facts_of(text: str) -> dict | None:
    """The five fact lists of one file with their labels and places, or None."""
    tokens = tokens_of(text)
    if tokens is None:
        return None
    match, stack = {}, []
    for k, (kind, t, _, _) in enumerate(tokens):
        if kind in ("punct", "tpl") and t in _OPENERS:
            stack.append(k)
        elif kind == "punct" and t in (")", "]", "}"):
            if not stack or _OPENERS[tokens[stack[-1]][1]] != t:
                return None
            match[stack[-1]] = k
            match[k] = stack.pop()
    if stack:
        return None
    if text.isascii():
        at = lambda k: k
    else:
        sums = [0]
        for c in text:
            sums.append(sums[-1] + len(c.encode()))
        at = sums.__getitem__
    word = lambda k: tokens[k][1] if 0 <= k < len(tokens) else ""
    is_name = lambda k: 0 <= k < len(tokens) and tokens[k][0] == "id"
    plain = lambda k: is_name(k) and (word(k) not in KEYWORDS or word(k) in _CONTEXTUAL)
    line_between = lambda k: "\n" in text[tokens[k - 1][3] : tokens[k][2]]

    scopes, scope_paths = [(0, None)], [[0]]
    current, closers, params = [0], {}, set()
    literals, calls, declarations, references = [], [], [], []
    starts: dict[int, int] = {}
    context: list[str] = []
    arrow_ends: list[tuple[int, int]] = []
    # where expressions after arrows end, as far as it is known; and the characters at which literals and calls begin
    ends: dict[int, int] = {}
    places: dict[str, list[int]] = {"literals": [], "calls": []}

    def enter(end: int) -> None:
        scopes.append((len(scopes), current[-1]))
        scope_paths.append(scope_paths[current[-1]] + [len(scopes) - 1])
        current.append(len(scopes) - 1)
        closers.setdefault(end, []).append(len(scopes) - 1)

    def leave(scope: int) -> None:
        """Takes the scope from the open ones; it is nearly always the last."""
        for k in range(len(current) - 1, -1, -1):
            if current[k] == scope:
                del current[k]
                return

    def expression_end(k: int) -> int:
        """The last token of the expression that starts at token ``k``; arrows within it end where it does."""
        if k in ends:
            return ends[k]
        arrows: list[int] = []
        end = scan_expression(k, arrows)
        ends.update((a + 1, end) for a in arrows)
        return end

    def scan_expression(k: int, arrows: list[int]) -> int:
        first = k
        if word(k) == "<" and tokens[k][0] == "punct":  # parameters of a generic arrow
            angles = 0
            while k < len(tokens) and (angles > 0 or k == first):
                angles += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(word(k), 0) if tokens[k][0] == "punct" else 0
                k = match[k] + 1 if tokens[k][0] in ("punct", "tpl") and word(k) in _OPENERS else k + 1
                if k < len(tokens) and tokens[k][0] == "punct" and word(k) in (")", "]", "}", ";"):
                    k = first  # no parameters after all
                    break
        while k < len(tokens):
            if word(k) == "=>" and tokens[k][0] == "punct":
                if k + 1 in ends:
                    return ends[k + 1]
                arrows.append(k)
            t = word(k)
            if tokens[k][0] in ("punct", "tpl") and t in _OPENERS:
                k = match[k]
                t = word(k)
            elif tokens[k][0] == "punct" and t in (",", ";", ")", "]", "}") or k > first and t in ("of", "in") and is_name(k) and "for" in (word(k - 4), word(k - 3)):
                return k - 1
            if k + 1 < len(tokens) and line_between(k + 1) and (tokens[k + 1][0] not in ("punct", "tpl") or word(k + 1) in ("++", "--")) and word(k + 1) not in ("in", "instanceof", "of"):
                if (tokens[k][0] != "punct" or t in (")", "]", "}", "++", "--")) and t not in _PREFIXES:
                    return k
            k += 1
        return len(tokens) - 1

    def names_something(k: int) -> bool:
        """Whether an identifier is no reference: a key, a label, a method, a class field or what a catch names."""
        before, after, within = word(k - 1), word(k + 1), context[-1] if context else "block"
        if after == ":" and (within in ("object", "class") and before in ("{", ",") or within in ("block", "function", "arrow") and before in ("", ";", "{", "}", ")") and word(k + 2) != ":"):
            return True
        if within in ("object", "class") and after == "(" and word(match[k + 1] + 1) == "{" and before not in ("=", ":", "new", "=>"):
            return True
        fresh = before in ("{", ";", "}") or before in _MODIFIERS or line_between(k) and (tokens[k - 1][0] != "punct" or before in (")", "]"))
        return within == "class" and fresh and (after in ("=", ";", "}", ":", "?", "!", "(") or k + 1 < len(tokens) and line_between(k + 1))

    for k, (kind, t, begin, end) in enumerate(tokens):
        while arrow_ends and k > arrow_ends[-1][0]:
            leave(arrow_ends.pop()[1])
        span = (at(begin), at(end))
        if kind == "str":
            literals.append((_unescaped(t[1:-1]), *span, current[-1]))
            places["literals"].append(begin)
            starts[k] = k
        elif kind == "num":
            starts[k] = k
        elif kind == "id":
            member = word(k - 1) in (".", "?.") and tokens[k - 1][0] == "punct"
            starts[k] = starts.get(k - 2, k) if member else k
            if t in ("const", "let", "var") and not member and (is_name(k + 1) or word(k + 1) in ("{", "[")):
                j = k + 1
                while True:
                    named = is_name(j)
                    after = j + 1 if named else match[j] + 1
                    if word(after) == ":":  # a type
                        angles = 0
                        while after < len(tokens) and (angles > 0 or word(after) not in ("=", ";", ",", ")", "of", "in")):
                            angles += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(word(after), 0)
                            after = match[after] + 1 if word(after) in _OPENERS else after + 1
                    last = after - 1
                    init = (None, None)
                    if word(after) == "=":
                        last = expression_end(after + 1)
                        init = (at(tokens[after + 1][2]), at(tokens[last][3])) if last > after else init
                    if named:
                        params.add(j)
                        declarations.append((word(j), t, *init, current[-1], j))
                    if word(last + 1) != "," or not (is_name(last + 2) or word(last + 2) in ("{", "[")):
                        break
                    j = last + 2
            elif plain(k) and not member and k not in params and not names_something(k):
                if not (word(k - 1) in ("function", "class") or word(k - 1) == "*" and word(k - 2) == "function" or word(k + 1) == "=>" or t in ("async", "of", "get", "set", "static", "let") and is_name(k + 1)):
                    references.append((t, *span, current[-1], k))
        elif t in _OPENERS:
            close = match[k]
            if t == "{":
                before, opened = word(k - 1), "block"
                if before == "=>":
                    opened = "arrow"
                elif before == ")" and closers.get(("body", k)):
                    opened = "function"
                elif tokens[k - 1][0] == "punct" and k and before in ("(", ",", "=", ":", "[", "?", "!", "&&", "||", "??", "+", "...") or before in ("return", "typeof", "default", "in", "of"):
                    opened = "object"
                elif "class" in (word(k - 2), word(k - 4), word(k - 1)):
                    opened = "class"
                context.append(opened)
                if opened in ("block", "class"):
                    enter(close)
            else:
                context.append(t)
                if t == "(" and kind == "punct":
                    _open_paren(k, close, tokens, word, is_name, context, match, params, enter, closers)
                    if word(k - 1) == "for" or word(k - 1) == "await" and word(k - 2) == "for":
                        enter(-1)
                        arrow_ends.append((match[close + 1] if word(close + 1) == "{" else expression_end(close + 1), current[-1]))
                    callee = k - 2 if word(k - 1) == "?." else k - 1
                    called = is_name(callee) and (word(callee) not in KEYWORDS or word(callee - 1) in (".", "?.") or word(callee) in _CONTEXTUAL) or word(callee) in (")", "]") and callee in starts
                    defined = ("params", k) in closers or is_name(callee) and word(callee - 1) in ("function", "class", "*")
                    if callee >= 0 and called and not defined and word(starts.get(callee, callee) - 1) != "new":
                        chain = _chain(callee, tokens, word, is_name, match)
                        if chain is not None:
                            args, j = [], k + 1
                            while j < close:
                                first = j
                                while j < close and word(j) != ",":
                                    j = match[j] + 1 if tokens[j][0] in ("punct", "tpl") and word(j) in _OPENERS else j + 1
                                if j > first:
                                    args.append((at(tokens[first][2]), at(tokens[j - 1][3])))
                                j += 1
                            calls.append((chain[-1] if chain else word(callee), chain, at(tokens[starts.get(callee, callee)][2]), at(tokens[close][3]), current[-1], args))
                            places["calls"].append(tokens[starts.get(callee, callee)][2])
                    starts[close] = starts.get(callee, callee) if called and not defined else k
                elif t == "[":
                    starts[close] = starts[k - 1] if k - 1 in starts and not line_between(k) else k
        elif t in (")", "]", "}"):
            context.pop()
            for scope in reversed(closers.pop(k, [])):
                leave(scope)
        elif t == "=>":
            if word(k + 1) == "{":
                if not (word(k - 1) == ")" and ("params", match[k - 1]) in closers):
                    enter(match[k + 1])
            elif not (word(k - 1) == ")" and ("params", match[k - 1]) in closers):
                enter(-1)
                arrow_ends.append((expression_end(k + 1), current[-1]))
            else:
                arrow_ends.append((expression_end(k + 1), closers[("params", match[k - 1])][0]))
    breaks = [m.start() for m in re.finditer("\n", text)]
    placed = {name: [(x + 1, bisect_left(breaks, x) + 1) for x in begins] for name, begins in places.items()}
    labels = _labels(literals, calls, declarations, references)
    return {"scopes": scopes, "paths": scope_paths, "literals": literals, "calls": calls, "declarations": declarations, "references": references, "labels": labels, "places": placed}


def _open_paren(k, close, tokens, word, is_name, context, match, params, enter, closers) -> None:
    """Marks a parameter list: its names are no references, and its function's scope begins."""
    following = word(close + 1)
    head = word(k - 1) == "function" or word(k - 2) == "function" or word(k - 2) == "*" and word(k - 3) == "function"
    method = following == "{" and is_name(k - 1) and word(k - 1) not in CONTROL and len(context) > 1 and context[-2] in ("class", "object")
    if word(k - 1) == "catch" and following == "{":
        params.update(j for j in range(k + 1, close) if is_name(j) and word(j + 1) != ":")
    if following != "=>" and not head and not method:
        return
    body = close + 2 if following == "=>" else close + 1
    while head and body < len(tokens) and word(body) not in ("{", ";"):
        body += 1
    j, depth = k + 1, 0
    while j < close:
        if word(j) == "=" and depth == 0:
            while j < close and word(j) != ",":
                j = match[j] + 1 if word(j) in _OPENERS else j + 1
        elif is_name(j):
            params.add(j)
        j += 1
    brace = word(body) == "{"
    enter(match[body] if brace else -1)
    scope = len(closers)
    ids = closers[match[body]] if brace else closers[-1]
    closers[("params", k)] = [ids[-1]]
    if brace:
        closers[("body", body)] = [scope]
    if not brace and following != "=>":
        enter(close)


def _chain(callee, tokens, word, is_name, match) -> list[str] | None:
    """[] for a plain identifier, the member names from the root on, ['computed'] for an index, None for others."""
    if word(callee) == "]":
        return ["computed"]
    if not is_name(callee):
        return None
    names = [word(callee)]
    k = callee
    if word(k - 1) not in (".", "?."):
        return None if word(k) in ("super", "import", "this") else []
    while word(k - 1) in (".", "?."):
        k -= 2
        if not is_name(k) or word(k) in ("this", "super"):
            break
        names.append(word(k))
    return names[::-1]


def literal_entropy(value: str) -> float | None:
    """Shannon entropy of a literal's UTF-8 bytes; None for literals too short to hide anything."""
    data = value.encode("utf-8", "surrogatepass")
    if len(data) < LITERAL_BYTES:
        return None
    return math.log2(len(data)) - sum(n * math.log2(n) for n in Counter(data).values()) / len(data)


_SPAN = "span_start: int, span_end: int, scope_id: int"
#: ``place`` is the fact's character number and ``at_line`` its line; ``assigned_to`` is the declaration it initialises.
_PLACED = f"{_SPAN}, place: int, at_line: int, assigned_to: int"
_SCHEMA = (
    f"path string, ok boolean, scopes array<struct<scope_id: int, parent_id: int, scope_path: array<int>>>, literals array<struct<lit_seq: int, value: string, entropy: double, {_PLACED}>>, "
    f"calls array<struct<call_seq: int, callee: string, callee_chain: array<string>, {_PLACED}, args: array<struct<arg_start: int, arg_end: int, first_lit: int>>>>, "
    "declarations array<struct<symbol_id: int, name: string, kind: string, init_start: int, init_end: int, scope_id: int, node_seq: int, first_lit: int>>, "
    f"references array<struct<ref_seq: int, name: string, {_SPAN}, node_seq: int, in_args: array<struct<call_seq: int, arg_idx: int>>, in_inits: array<int>>>"
)


def _row(path: str, f: dict | None, chars: int | None = None) -> tuple:
    """The file's row in ``_SCHEMA``; of literals' values only the first ``chars`` characters."""
    if f is None:
        return path, False, [], [], [], [], []
    label, place = f["labels"], f["places"]
    placed = lambda a, b, s, at, to: {"span_start": a, "span_end": b, "scope_id": s, "place": at[0], "at_line": at[1], "assigned_to": to}
    return (
        path, True,
        [{"scope_id": i, "parent_id": p, "scope_path": s} for (i, p), s in zip(f["scopes"], f["paths"])],
        [{"lit_seq": i, "value": v[:chars], "entropy": literal_entropy(v), **placed(a, b, s, at, to)} for i, ((v, a, b, s), at, to) in enumerate(zip(f["literals"], place["literals"], label["literal_of"]))],
        [
            {"call_seq": i, "callee": c, "callee_chain": h, **placed(a, b, s, at, to), "args": [{"arg_start": x, "arg_end": y, "first_lit": v} for (x, y), v in zip(g, lits)]}
            for i, ((c, h, a, b, s, g), at, to, lits) in enumerate(zip(f["calls"], place["calls"], label["call_of"], label["arg_literal"]))
        ],
        [{"symbol_id": i, "name": n, "kind": d, "init_start": a, "init_end": b, "scope_id": s, "node_seq": q, "first_lit": v} for i, ((n, d, a, b, s, q), v) in enumerate(zip(f["declarations"], label["init_literal"]))],
        [
            {"ref_seq": i, "name": n, "span_start": a, "span_end": b, "scope_id": s, "node_seq": q, "in_args": [{"call_seq": c, "arg_idx": j} for c, j in inside], "in_inits": inits}
            for i, ((n, a, b, s, q), inside, inits) in enumerate(zip(f["references"], label["in_args"], label["in_inits"]))
        ],
    )


def file_facts(files: DataFrame, chars: int | None = None) -> DataFrame:
    """One row per JavaScript or TypeScript file with its nested facts; others are left out before Python sees them.

    Of literals' values only the first ``chars`` characters are handed on, their entropy is that of the whole.
    """
    wanted = files.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(JS_EXTENSIONS)).select("path", "content")

    def extract(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    f = facts_of(content)
                except (IndexError, KeyError, RecursionError):
                    f = None
                rows.append(_row(path, f, chars))
            yield pd.DataFrame(rows, columns=["path", "ok", "scopes", "literals", "calls", "declarations", "references"])

    return wanted.mapInPandas(extract, _SCHEMA)


def rejects(facts: DataFrame) -> DataFrame:
    """(path, reason) of the files from which no facts could be read; their flows are unknown, not absent."""
    return facts.where("NOT ok").select("path", F.lit("tokens or brackets do not fit JavaScript").alias("reason"))


def fact_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """The fact relations, one row per fact, of the files that could be read."""
    ok = facts.where("ok")
    inline = lambda name: ok.select("path", F.inline(name))
    calls = inline("calls")
    args = calls.select("path", "call_seq", F.posexplode("args").alias("arg_idx", "a")).select("path", "call_seq", "arg_idx", "a.*")
    return {"scopes": inline("scopes"), "literals": inline("literals"), "calls": calls.drop("args"), "args": args, "declarations": inline("declarations"), "references": inline("references")}
