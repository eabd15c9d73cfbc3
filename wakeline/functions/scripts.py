"""A tolerant reader of JavaScript and TypeScript: a tree of tokens, and the facts that statements state.

No compiler is at hand, so nothing is typed or resolved here. Brackets,
templates and JSX elements nest; everything else is a flat run of tokens.
What can't be read for certain gives no fact.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass, field

_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_WORD = re.compile(r"[A-Za-z_$\u0080-￿#@][\w$\u0080-￿]*")
_NUMBER = re.compile(r"\d[\w.]*")
_STRING = re.compile(r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_PUNCT = re.compile(r"=>|\.\.\.|\?\.|\?\?=?|&&=?|\|\|=?|[=!]==?|\*\*=?|[-+*/%&|^<>]=|\+\+|--|.", re.S)
_ANY = re.compile("|".join(f"(?P<{kind}>{p.pattern})" for kind, p in (("string", _STRING), ("word", _WORD), ("number", _NUMBER), ("punct", _PUNCT))), re.S)
_TAG = re.compile(r"<(?=[A-Za-z_$>])(?![A-Za-z_$][\w$]*\s*(?:,|extends\b))")
_TAG_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_BEFORE_VALUE = set("return typeof case in of delete void throw new else do await yield default extends".split())
_ACTION = re.compile(r"^(?:open|close|submit|save|create|delete|redirect|push|replace|review)", re.I)
_CONTROL = re.compile(r"^(?:button|a|input|select|textarea|form|Button|Link|Dialog|Sheet|Popover|DropdownMenu)$")
_RESPONSE = re.compile(r"(?:Response|NextResponse)\.(?:json|redirect)|new Response")
METHODS = set("get post put patch delete head options".split())
FACTORIES = ("createBrowserRouter", "createHashRouter", "createMemoryRouter")


@dataclass(slots=True)
class Token:
    kind: str  # word, number, string, regex, punct, group, template, jsx, text
    text: str
    start: int
    end: int
    kids: list[Token] = field(default_factory=list)
    attrs: list[tuple[str, Token | None]] = field(default_factory=list)

    @property
    def value(self) -> str:
        return re.sub(r"\\(.)", r"\1", self.text[1:-1], flags=re.S) if self.kind == "string" else self.text


class Reader:
    def __init__(self, source: str, jsx: bool = True):
        self.source, self.jsx, self.at = source, jsx, 0

    def run(self, close: str | None = None) -> list[Token]:
        """Tokens up to the closing bracket, or to the end."""
        out: list[Token] = []
        s = self.source
        while self.at < len(s):
            c, begin = s[self.at], self.at
            if (c == "/" or c.isspace()) and (m := _SPACE.match(s, begin)):
                self.at = m.end()
                continue
            if c == close:
                return out
            if c in ")]}":
                self.at += 1
                continue
            if c in _CLOSE:
                self.at += 1
                kids = self.run(_CLOSE[c])
                self.at = min(len(s), self.at + 1)
                out.append(Token("group", c, begin, self.at, kids))
            elif c == "`":
                out.append(self.template())
            elif self.jsx and c == "<" and self.value_next(out) and _TAG.match(s, begin):
                out.append(self.element())
            elif c == "/" and self.value_next(out) and (m := _REGEX.match(s, begin)):
                self.at = m.end()
                out.append(Token("regex", m[0], begin, self.at))
            else:
                m = _ANY.match(s, begin)
                self.at = m.end()
                out.append(Token(m.lastgroup, m[0], begin, self.at))
        return out

    @staticmethod
    def value_next(out: list[Token]) -> bool:
        """Whether a value, rather than an operator, can come next."""
        if not out:
            return True
        last = out[-1]
        return last.kind == "punct" and last.text not in ("++", "--") or last.kind == "word" and last.text in _BEFORE_VALUE or last.kind == "jsx"

    def template(self) -> Token:
        begin, kids = self.at, []
        self.at += 1
        s = self.source
        while self.at < len(s) and s[self.at] != "`":
            if s[self.at] == "\\":
                self.at += 2
            elif s.startswith("${", self.at):
                self.at += 2
                kids += self.run("}")
                self.at += 1
            else:
                self.at += 1
        self.at = min(len(s), self.at + 1)
        return Token("template", s[begin : self.at], begin, self.at, kids)

    def blank(self) -> None:
        if m := _SPACE.match(self.source, self.at):
            self.at = m.end()

    def element(self) -> Token:
        """A JSX element: its name as text, attributes, and children."""
        s, begin = self.source, self.at
        self.at += 1
        m = _TAG_NAME.match(s, self.at)
        node = Token("jsx", m[0] if m else "", begin, begin)
        self.at = m.end() if m else self.at
        while self.at < len(s):
            self.blank()
            if s.startswith("/>", self.at):
                self.at += 2
                node.end = self.at
                node.kind = "jsx"
                return node
            if s.startswith(">", self.at):
                self.at += 1
                break
            if s.startswith("{", self.at):
                self.at += 1
                node.attrs.append(("...", Token("group", "{", self.at, self.at, self.run("}"))))
                self.at += 1
            elif m := re.compile(r"[A-Za-z_$][\w$:.-]*").match(s, self.at):
                self.at = m.end()
                self.blank()
                value = None
                if s.startswith("=", self.at):
                    self.at += 1
                    self.blank()
                    start = self.at
                    if q := re.compile(r"'[^']*'|\"[^\"]*\"").match(s, self.at):
                        self.at = q.end()
                        value = Token("string", q[0], start, self.at)
                    elif s.startswith("{", self.at):
                        self.at += 1
                        kids = self.run("}")
                        self.at += 1
                        value = Token("group", "{", start, self.at, kids)
                    elif s.startswith("<", self.at):
                        value = self.element()
                node.attrs.append((m[0], value))
            else:
                self.at += 1
        while self.at < len(s):
            if s.startswith("</", self.at):
                self.at = s.find(">", self.at) + 1 or len(s)
                break
            if s[self.at] == "<":
                node.kids.append(self.element())
            elif s[self.at] == "{":
                start = self.at
                self.at += 1
                kids = self.run("}")
                self.at += 1
                node.kids.append(Token("group", "{", start, self.at, kids))
            else:
                start = self.at
                while self.at < len(s) and s[self.at] not in "<{":
                    self.at += 1
                node.kids.append(Token("text", s[start : self.at], start, self.at))
        node.end = self.at
        node.attrs.append(("</", None))
        return node


def walk(tokens: list[Token], out: list[tuple[list[Token], int]] | None = None) -> list[tuple[list[Token], int]]:
    """Every run of tokens, outer before inner: the run, and each position in it."""
    out = [] if out is None else out
    for i, t in enumerate(tokens):
        out.append((tokens, i))
        for _, value in t.attrs:
            if value is not None:
                walk([value], out)
        if t.kids:
            walk(t.kids, out)
    return out


def word(t: Token | None, *names: str) -> bool:
    return t is not None and t.kind == "word" and (not names or t.text in names)


def punct(t: Token | None, *marks: str) -> bool:
    return t is not None and t.kind == "punct" and t.text in marks


def group(t: Token | None, mark: str) -> bool:
    return t is not None and t.kind == "group" and t.text == mark


def get(tokens: list[Token], i: int) -> Token | None:
    return tokens[i] if 0 <= i < len(tokens) else None


def arguments(call: Token) -> list[list[Token]]:
    """The call's arguments, each a run of tokens."""
    out: list[list[Token]] = [[]]
    for t in call.kids:
        if punct(t, ","):
            out.append([])
        else:
            out[-1].append(t)
    return [a for a in out if a]


def type_arguments(tokens: list[Token], i: int) -> int:
    """The position behind ``<...>`` that starts at i, or i if that is none."""
    if not punct(get(tokens, i), "<"):
        return i
    depth, j = 0, i
    while j < len(tokens):
        t = tokens[j]
        if punct(t, "<"):
            depth += 1
        elif punct(t, ">"):
            depth -= 1
            if not depth:
                return j + 1
        elif t.kind == "punct" and t.text not in (",", ".", "|", "&", "=>", "?", ":", ";"):
            return i
        j += 1
    return i


def call_at(tokens: list[Token], i: int) -> Token | None:
    """The argument group of a call whose callee's last word is at i."""
    j = i + 1
    if punct(get(tokens, j), "?."):
        j += 1
    t = get(tokens, type_arguments(tokens, j))
    return t if group(t, "(") else None


def chain_before(tokens: list[Token], i: int) -> int:
    """Where the property chain that ends at i begins."""
    while punct(get(tokens, i - 1), ".", "?.") and i >= 2 and tokens[i - 2].kind in ("word", "group"):
        i -= 2
        while tokens[i].kind == "group" and i and (tokens[i - 1].kind == "word" or tokens[i - 1].kind == "group"):
            i -= 1
    return i


@dataclass
class Statement:
    kind: str  # function, class, variable, import, export, default, other
    start: int
    end: int
    names: list[tuple[str, int, int, list[Token]]] = field(default_factory=list)  # name, start, end, value
    exported: bool = False
    default: bool = False
    specifier: str | None = None
    type_only: bool = False
    locals: list[str] = field(default_factory=list)


def _ends_line(source: str, a: Token, b: Token) -> bool:
    """Whether a statement may end between two tokens without a semicolon."""
    if "\n" not in source[a.end : b.start]:
        return False
    if a.kind == "punct" and a.text not in ("++", "--"):
        return False
    return not (b.kind == "punct" and b.text not in ("++", "--") or b.kind in ("template",) or group(b, "(") or group(b, "[") or word(b, "as", "satisfies", "instanceof", "in", "of"))


def statements(source: str, tokens: list[Token]) -> list[Statement]:
    """The top-level statements that state a fact."""
    out: list[Statement] = []
    i = 0
    while i < len(tokens):
        begin = i
        while i < len(tokens) and tokens[i].kind == "word" and tokens[i].text.startswith("@"):
            i = i + 2 if group(get(tokens, i + 1), "(") else i + 1
        st = Statement("other", tokens[min(i, len(tokens) - 1)].start, 0)
        if word(get(tokens, i), "export"):
            st.exported = True
            i += 1
            if word(get(tokens, i), "default"):
                st.default = True
                i += 1
        if word(get(tokens, i), "declare", "abstract") and word(get(tokens, i + 1), "class", "function", "const", "let", "var", "abstract"):
            i += 1
        j = i + 1 if word(get(tokens, i), "async") and word(get(tokens, i + 1), "function") else i
        t = get(tokens, j)
        if word(t, "function"):
            k = j + 2 if punct(get(tokens, j + 1), "*") else j + 1
            st.kind = "function"
            if word(get(tokens, k)):
                st.names.append((tokens[k].text, 0, 0, []))
            while k < len(tokens) and not group(tokens[k], "{") and not punct(tokens[k], ";") and not (k > j + 2 and _ends_line(source, tokens[k - 1], tokens[k])):
                k += 1
            i = k + 1 if k < len(tokens) and (group(tokens[k], "{") or punct(tokens[k], ";")) else k
        elif word(t, "class"):
            st.kind = "class"
            if word(get(tokens, j + 1)) and tokens[j + 1].text not in ("extends", "implements"):
                st.names.append((tokens[j + 1].text, 0, 0, []))
            k = j + 1
            while k < len(tokens) and not group(tokens[k], "{"):
                k += 1
            i = k + 1
        elif word(t, "const", "let", "var") and not st.default and not word(get(tokens, j + 1), "enum"):
            st.kind = "variable"
            i = _declarations(source, tokens, j + 1, st)
        elif word(t, "import") and not group(get(tokens, j + 1), "(") and not punct(get(tokens, j + 1), "."):
            st.kind = "import"
            i = _import(tokens, j + 1, st)
        elif st.exported and not st.default and (group(t, "{") or punct(t, "*") or word(t, "type") and group(get(tokens, j + 1), "{")):
            st.kind = "export"
            listed = t if group(t, "{") else get(tokens, j + 1) if word(t, "type") else None
            k = j + 1
            while k < len(tokens) and not punct(tokens[k], ";") and tokens[k].kind != "string" and not (word(tokens[k], "import", "export", "const", "function", "class")):
                k += 1
            if get(tokens, k) is not None and tokens[k].kind == "string" and word(get(tokens, k - 1), "from"):
                st.specifier = tokens[k].value
                k += 1
            elif listed is not None:
                st.locals = [part[0].text if not word(part[0], "type") or len(part) == 1 else part[1].text for part in arguments(listed) if part[0].kind == "word"]
                k = j + 1
            i = k
        elif st.default:
            st.kind = "default"
            i = _expression_end(source, tokens, j)
            if i == j + 1 and t is not None and t.kind == "word":
                st.locals = [t.text]
        else:
            i = max(j + 1, begin + 1)
        st.end = tokens[min(i, len(tokens)) - 1].end
        if i < len(tokens) and punct(tokens[i], ";"):
            i += 1
            st.end = tokens[i - 1].end
        if st.kind != "other":
            out.append(st)
        i = max(i, begin + 1)
    return out


def _expression_end(source: str, tokens: list[Token], i: int, stop: str = ";") -> int:
    start = i
    while i < len(tokens) and not punct(tokens[i], *stop):
        if i > start and _ends_line(source, tokens[i - 1], tokens[i]):
            break
        i += 1
    return i


def _declarations(source: str, tokens: list[Token], i: int, st: Statement) -> int:
    while i < len(tokens):
        first = tokens[i]
        k = i + 1
        while k < len(tokens) and not punct(tokens[k], "=", ",", ";") and not _ends_line(source, tokens[k - 1], tokens[k]):
            k = type_arguments(tokens, k) if punct(tokens[k], "<") and type_arguments(tokens, k) > k else k + 1
        if punct(get(tokens, k), "="):
            end = _expression_end(source, tokens, k + 1, ",;")
            value = tokens[k + 1 : end]
            if first.kind == "word" and value:
                st.names.append((first.text, first.start, value[-1].end, value))
            k = end
        if not punct(get(tokens, k), ","):
            return k
        i = k + 1
    return i


def _import(tokens: list[Token], i: int, st: Statement) -> int:
    if word(get(tokens, i), "type") and not (punct(get(tokens, i + 1), ",") or word(get(tokens, i + 1), "from") and get(tokens, i + 2) is not None and tokens[i + 2].kind == "string"):
        st.type_only = True
        i += 1
    while i < len(tokens) and tokens[i].kind != "string" and not punct(tokens[i], ";"):
        t = tokens[i]
        if t.kind == "word" and t.text not in ("from", "as") and not word(get(tokens, i - 1), "as"):
            st.locals.append(t.text)
        elif group(t, "{"):
            for part in arguments(t):
                part = part[1:] if word(part[0], "type") and len(part) > 1 and not word(part[1], "as") else part
                st.locals.append(part[-1].text)
        elif punct(t, "*"):
            i += 2  # a namespace binds no name that a fact follows
        i += 1
    if get(tokens, i) is not None and tokens[i].kind == "string":
        st.specifier = tokens[i].value
        i += 1
    return i


def unwrap(value: list[Token]) -> list[Token]:
    """An expression without parentheses around it and type assertions behind it."""
    for k, t in enumerate(value):
        if k and word(t, "as", "satisfies"):
            value = value[:k]
            break
    while len(value) == 1 and group(value[0], "("):
        value = value[0].kids
    return value


def is_function(value: list[Token]) -> bool:
    value = unwrap(value)
    i = 1 if word(get(value, 0), "async") and not punct(get(value, 1), "=>") else 0
    if word(get(value, i), "function"):
        return True
    i = type_arguments(value, i)
    if word(get(value, i)) and punct(get(value, i + 1), "=>"):
        return True
    if not group(get(value, i), "("):
        return False
    if punct(get(value, i + 1), "=>"):
        return True
    return punct(get(value, i + 1), ":") and any(punct(t, "=>") for t in value[i + 2 :])


def is_component(value: list[Token], name: str, exported: bool) -> bool:
    if not name[:1].isascii() or not name[:1].isupper():
        return False
    value = unwrap(value)
    if is_function(value):
        return True
    names = [t for t in value if t.kind == "word"]
    plain = bool(value) and all(t.kind == "word" or punct(t, ".") for t in value) and word(value[0])
    for i, t in enumerate(value):
        if t.kind == "word" and call_at(value, i) is not None and all(x.kind == "word" or punct(x, ".") for x in value[:i]):
            return t.text in ("forwardRef", "memo", "lazy")
    return exported and plain and bool(names) and names[0].text not in ("true", "false", "null", "undefined", "new")


class Script:
    """The facts of one file."""

    def __init__(self, path: str, source: str):
        self.path, self.source = path, source
        self.jsx = not re.search(r"\.(?:ts|mts|cts)$", path)
        self.tokens = Reader(source, self.jsx).run()
        self.runs = walk(self.tokens)
        self.statements = statements(source, self.tokens)
        self.breaks = [m.start() for m in re.finditer("\n", source)]

    def place(self, at: int) -> tuple[int, int]:
        line = bisect.bisect_left(self.breaks, at)
        return line + 1, at - (self.breaks[line - 1] + 1 if line else 0) + 1

    def symbols(self) -> list[tuple]:
        """Key, name, kind, exported, start and end line and column, hash of the text."""
        listed = {n for st in self.statements if st.kind in ("export", "default") and st.specifier is None for n in st.locals}
        jsx_path = bool(re.search(r"\.(?:tsx|jsx)$", self.path))
        out = []
        for st in self.statements:
            for name, start, end, value in st.names:
                exported = st.exported or name in listed
                if st.kind == "function":
                    kind, start, end = "component" if jsx_path and re.match("[A-Z]", name) else "function", st.start, st.end
                elif st.kind == "class":
                    kind, start, end = "class", st.start, st.end
                else:
                    component = is_component(value, name, exported)
                    if not component and not is_function(value):
                        continue
                    kind = "component" if component else "function"
                text = self.source[start:end]
                out.append((f"{self.path}:{kind}:{name}", name, kind, exported, *self.place(start), *self.place(end), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
        return out

    def imports(self) -> list[tuple[str, str]]:
        """Specifier and kind, statements first at each place."""
        found = [(st.start, st.specifier, "type_only" if st.type_only else "static") for st in self.statements if st.kind in ("import", "export") and st.specifier is not None]
        for run, i in self.runs:
            t = run[i]
            if word(t, "import", "require") and group(get(run, i + 1), "(") and not punct(get(run, i - 1), "."):
                args = arguments(run[i + 1])
                if len(args) == 1 and len(args[0]) == 1 and args[0][0].kind == "string":
                    found.append((t.start, args[0][0].value, "dynamic" if t.text == "import" else "require"))
        return [(s, k) for _, s, k in sorted(found, key=lambda f: f[0])]

    def bindings(self) -> list[tuple[str, str]]:
        """Local name and specifier of default and named imports."""
        return [(n, st.specifier) for st in self.statements if st.kind == "import" and st.specifier is not None for n in st.locals]

    def function_names(self) -> list[str]:
        return [n for st in self.statements if st.kind == "function" for n, *_ in st.names]

    def has_default(self) -> bool:
        return any(st.default and st.kind in ("default", "function") for st in self.statements)

    # P10: routes of a router component or of route objects: path, target name or #specifier, None for the file itself

    def routes(self) -> list[tuple[str, str | None, str]]:
        out: list[tuple[str, str | None, str]] = []
        arrays = {n: v[0] for st in self.statements if st.kind == "variable" for n, _, _, v in st.names if len(v) == 1 and group(v[0], "[")}
        self._elements(self.tokens, "", out)
        for run, i in self.runs:
            if word(run[i], *FACTORIES) and not punct(get(run, i - 1), ".") and (call := call_at(run, i)) is not None:
                args = arguments(call)
                first = args[0][0] if args and len(args[0]) == 1 else None
                array = first if group(first, "[") else arrays.get(first.text) if word(first) else None
                if array is not None:
                    self._objects(array, "", out)
        return out

    def _elements(self, tokens: list[Token], parent: str, out: list) -> None:
        for t in tokens:
            inside = parent
            if t.kind == "jsx" and t.text == "Route":
                attrs = {k: v for k, v in reversed(t.attrs)}
                path = attrs["path"].value if attrs.get("path") is not None and attrs["path"].kind == "string" else "" if "index" in attrs else None
                target = self._element_target(attrs)
                if path is not None:
                    inside = f"{parent}/{path}"
                    if target is not None:
                        out.append((inside, target or None, "React Router literal JSX Route registration"))
            else:
                for _, value in t.attrs:
                    if value is not None:
                        self._elements([value], parent, out)
            self._elements(t.kids, inside, out)

    @staticmethod
    def _element_target(attrs: dict) -> str | None:
        value = attrs.get("Component")
        if group(value, "{") and len(value.kids) == 1 and word(value.kids[0]):
            return value.kids[0].text
        value = attrs.get("element")
        return Script._value_target(value.kids) if group(value, "{") else None

    @staticmethod
    def _value_target(value: list[Token]) -> str | None:
        if len(value) != 1:
            return None
        return value[0].text if word(value[0]) or value[0].kind == "jsx" and value[0].text else None

    def _objects(self, array: Token, parent: str, out: list) -> None:
        for item in arguments(array):
            if len(item) != 1 or not group(item[0], "{"):
                continue
            fields: dict[str, list[Token]] = {}
            for part in arguments(item[0]):
                if len(part) > 2 and part[0].kind in ("word", "string") and punct(part[1], ":"):
                    fields.setdefault(part[0].value, part[2:])
            path = fields["path"][0].value if "path" in fields and len(fields["path"]) == 1 and fields["path"][0].kind == "string" else ""
            here = f"{parent}/{path}"
            named = next((k for k in fields if k in ("Component", "element", "lazy")), None)
            target = None
            if named == "lazy":
                value = fields["lazy"]
                at = next((i for i, t in enumerate(value) if word(t, "import")), None)
                call = get(value, at + 1) if at is not None else None
                if group(call, "(") and len(call.kids) == 1 and call.kids[0].kind == "string":
                    target = f"#{call.kids[0].value}"
            elif named is not None:
                target = self._value_target(fields[named])
            if target is not None and path:
                out.append((here, target, "React Router literal route-object registration"))
            if "children" in fields and len(fields["children"]) == 1 and group(fields["children"][0], "["):
                self._objects(fields["children"][0], here, out)

    # P11

    def server_routes(self) -> tuple[list[tuple[str, str]], list[tuple[str, str, str, str | None]]]:
        """Mounts (name, prefix), and routes (receiver, method, path, handler name or None for one in the file)."""
        mounts, routes = [], []
        for run, i in self.runs:
            t = run[i]
            if t.kind != "word" or not punct(get(run, i - 1), ".") or (call := call_at(run, i)) is None:
                continue
            args = arguments(call)
            if len(args) < 2 or len(args[0]) != 1 or args[0][0].kind != "string":
                continue
            path, last = args[0][0].value, args[-1]
            if t.text == "use" and len(args[1]) == 1 and word(args[1][0]):
                mounts.append((args[1][0].text, path))
            elif t.text.lower() in METHODS:
                begin = chain_before(run, i)
                receiver = self.source[run[begin].start : run[i - 2].end]
                if len(last) == 1 and word(last[0]):
                    routes.append((receiver, t.text.upper(), path, last[0].text))
                elif is_function(last):
                    routes.append((receiver, t.text.upper(), path, None))
        return mounts, routes

    # P12

    def procedures(self) -> list[tuple[str, str, str | None, bool]]:
        """Entries of router objects: router name (empty if it has none), dotted key, referenced name, whether it is a procedure."""
        named = {id(v[-1]): n for st in self.statements if st.kind == "variable" for n, _, _, v in st.names if v and group(v[-1], "(")}
        out = []
        for run, i in self.runs:
            if word(run[i], "router") and (call := call_at(run, i)) is not None:
                args = arguments(call)
                if args and len(args[0]) == 1 and group(args[0][0], "{"):
                    self._entries(named.get(id(call), ""), args[0][0], "", out)
        return out

    def _entries(self, name: str, body: Token, prefix: str, out: list) -> None:
        for part in arguments(body):
            if len(part) < 3 or part[0].kind not in ("word", "string") or not punct(part[1], ":"):
                continue
            key = f"{prefix}.{part[0].value}" if prefix else part[0].value
            value = part[2:]
            last = next((i for i, t in enumerate(value) if word(t, "router") and i + 1 < len(value) and group(value[-1], "(")), None)
            inner = arguments(value[-1]) if last is not None else []
            if last is not None and last == len(value) - 2 and inner and len(inner[0]) == 1 and group(inner[0][0], "{"):
                self._entries(name, inner[0][0], key, out)
            elif len(value) == 1 and word(value[0]):
                out.append((name, key, value[0].text, False))
            elif any(punct(get(run, i - 1), ".") and word(run[i], "query", "mutation", "subscription") for run, i in walk(value)):
                out.append((name, key, None, True))

    def operations(self) -> list[tuple[str, int, int]]:
        """Client calls: the operation between the chain's first and last name, with its line and column."""
        out = []
        for run, i in self.runs:
            if word(run[i], "useQuery", "useMutation", "query", "mutate") and punct(get(run, i - 1), ".") and call_at(run, i) is not None:
                begin = chain_before(run, i)
                names = [t.text for t in run[begin : i + 1] if t.kind == "word"]
                if len(names) > 2:
                    out.append((".".join(names[1:-1]), *self.place(run[begin].start)))
        return out

    # P15, P16

    def anchors(self, most: int = 4) -> list[tuple[str, str, int, int, str]]:
        """Behaviour in order: kind, label, first and last line, text; what is found is not searched again."""
        out: list[tuple[str, str, int, int, str]] = []

        def add(kind: str, label: str, start: int, end: int) -> None:
            if len(out) < most and self.source[start:end].strip():
                out.append((kind, label, self.place(start)[0], self.place(end)[0], self.source[start:end]))

        def visit(tokens: list[Token]) -> None:
            i = 0
            while i < len(tokens) and len(out) < most:
                t = tokens[i]
                if t.kind == "jsx" and _CONTROL.match(t.text):
                    text = next((s[:100] for k in t.kids if k.kind == "text" and (s := " ".join(k.text.split()))), None)
                    attrs = dict(reversed(t.attrs))
                    text = text or next((attrs[a].value for a in ("aria-label", "title") if "</" not in attrs and attrs.get(a) is not None and attrs[a].kind == "string"), None)
                    add("interaction", f"Interactive control “{text}”" if text else "Interactive control", t.start, t.end)
                    i += 1
                    continue
                if word(t, "return"):
                    end = _expression_end(self.source, tokens, i + 1)
                    if end > i + 1 and _RESPONSE.search(self.source[t.start : tokens[end - 1].end]):
                        add("api_contract", "API response behavior", t.start, tokens[end - 1].end)
                        i = end
                        continue
                if punct(t, "?", "&&") and i and (t.text == "&&" or any(punct(x, ":") for x in tokens[i + 1 :])):
                    begin = i
                    while begin and not punct(tokens[begin - 1], "=", ",", ";", "=>", "?", ":") and not word(tokens[begin - 1], "return"):
                        begin -= 1
                    end = _expression_end(self.source, tokens, i + 1, ",;")
                    add("state", "Conditional user-visible state", tokens[begin].start, tokens[end - 1].end)
                    i = end
                    continue
                if t.kind == "word" and (call := call_at(tokens, i)) is not None and _ACTION.match(t.text):
                    add("interaction", f"User action {t.text}", tokens[chain_before(tokens, i)].start, call.end)
                for _, value in t.attrs:
                    if value is not None:
                        visit([value])
                visit(t.kids)
                i += 1

        visit(self.tokens)
        return out

    def tests(self, most: int = 2) -> list[tuple[str, int, int, str]]:
        """Titles of tests: title, first and last line, text."""
        out = []
        for run, i in self.runs:
            if word(run[i], "it", "test", "describe") and not punct(get(run, i - 1), ".") and (call := call_at(run, i)) is not None and len(out) < most:
                args = arguments(call)
                if args and len(args[0]) == 1 and args[0][0].kind == "string":
                    out.append((args[0][0].value, self.place(run[i].start)[0], self.place(call.end)[0], self.source[run[i].start : call.end]))
        return out

    def entrypoint(self) -> tuple[int, int, str] | None:
        """The first declaration: first and last line, text."""
        st = next((s for s in self.statements if s.kind in ("function", "class", "variable", "default")), None)
        return None if st is None else (self.place(st.start)[0], self.place(st.end)[0], self.source[st.start : st.end])

    def import_places(self) -> list[tuple[str, int, int, str]]:
        return [(st.specifier, self.place(st.start)[0], self.place(st.end)[0], self.source[st.start : st.end]) for st in self.statements if st.kind == "import" and st.specifier is not None]
