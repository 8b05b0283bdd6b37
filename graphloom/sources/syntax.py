"""Declarations, imports and calls of brace languages and Ruby, from tokens and scopes.

One pass over the tokens keeps a stack of open scopes. The tokens since the last statement
border are the header of what a ``{`` opens, or of a declaration without a body; its words
say whether that is a type, a function, a namespace or a plain block. Calls belong to the
innermost function around them, so calls of a header that turns out to declare something are
forgotten. Comments, strings and regular expressions are stepped over.

Methods carry their receiver in the id, overloads of Java, Kotlin and C# their parameter
types. Broken or cut texts give what was read. A callee's qualifier that is no plain name
is written ``_``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

Node = tuple[str, str, str, int, int]
Edge = tuple[str, str, str]

TOKEN = re.compile(
    r"""(?P<gap>[ \t\r\f\v]+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<nl>\n)
    |(?P<str>\"{3}.*?(?:\"{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)
    |(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>::|=>|->|\?\.|&&|\|\||[^\w\s])""",
    re.X | re.S,
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
CONTROL = frozenset("if for while switch catch return else do try with foreach using lock fixed synchronized when guard match unless elseif until and or not in is new typeof instanceof await throw yield case default sizeof delete super this".split())
TYPE_WORDS = {
    "go": (), "js": ("class",), "ts": ("class", "interface", "enum"), "java": ("class", "interface", "enum", "record", "@interface"), "cs": ("class", "interface", "struct", "enum", "record"), "kt": ("class", "interface", "object"),
    "swift": ("class", "struct", "enum", "protocol", "actor", "extension"), "php": ("class", "interface", "trait", "enum"), "c": ("struct", "union", "enum", "class"),
}
LINES = ("go", "js", "ts", "kt", "swift")  # a line end may end a statement
SIGNED = ("java", "kt", "cs")  # overloads carry their parameter types
OWNED = ("js", "ts", "swift")  # a type contains its methods; elsewhere the module does
OPEN_END = frozenset("( [ { , . = + - * / % & | ^ < ? : => -> ?. :: && || ! ~".split())


@dataclass
class Frame:
    kind: str  # file, type, func, ns, block, group
    id: str = ""
    name: str = ""
    start: int = 1
    head: list[int] = field(default_factory=list)
    calls: list[tuple[str, bool]] = field(default_factory=list)
    depth: int = 0


class Reader:
    def __init__(self, path: str, text: str, lang: str):
        from graphloom.sources.extract import param_signature

        if lang == "php":
            text = re.sub(r"<\?(php)?|\?>", lambda m: " " * len(m[0]), text)
        self.path, self.text, self.lang, self.signature = path, text, lang, param_signature
        self.kinds, self.words, self.at, self.line = [], [], [], []
        self.tokens()
        self.module = f"module:{path}"
        base = path.rsplit("/", 1)[-1]
        self.nodes: list[Node] = [(f"file:{path}", "file", path, 1, text.count("\n") + 1)]
        self.edges: list[Edge] = []
        if lang != "go":
            self.put(self.module, "module", base.rsplit(".", 1)[0] or base, 1, text.count("\n") + 1, f"file:{path}")

    def tokens(self) -> None:
        at, line, start, n = 0, 1, 0, len(self.text)  # start: of the line
        before = ""
        while at < n:
            m = TOKEN.match(self.text, at)
            if not m:
                at += 1
                continue
            if m.lastgroup == "op" and m[0] == "/" and self.lang in ("js", "ts") and (not before or before in OPEN_END or before in ("return", "typeof", "case", ";", "}")) and (r := REGEX.match(self.text, at)):
                m, kind = r, "str"
            elif m.lastgroup == "op" and m[0] == "#" and self.lang in ("c", "php", "cs") and (self.lang == "php" or not self.text[start:at].strip()):
                end = self.text.find("\n", at)  # a directive, or a comment
                m, kind = re.compile(r".*", re.S).match(self.text, at, end if end >= 0 else n), "hash"
            else:
                kind = m.lastgroup
            if kind == "hash":
                if found := re.match(r'#\s*include\s*[<"]([^>"]+)[>"]', m[0]):
                    self.pending_imports = [*getattr(self, "pending_imports", []), (found[1], line)]
            elif kind != "gap":
                self.kinds.append(kind)
                self.words.append(m[0])
                self.at.append(at)
                self.line.append(line)
                before = m[0] if kind != "nl" else before
            if "\n" in m[0]:
                line += m[0].count("\n")
                start = m.end() - len(m[0].rpartition("\n")[2])
            at = max(m.end(), at + 1)

    def put(self, node: str, kind: str, name: str, start: int, end: int, owner: str) -> int:
        self.nodes.append((node, kind, name, start, end))
        self.edges.append((owner, node, "contains"))
        return len(self.nodes) - 1

    def imported(self, spec: str, line: int) -> None:
        node = f"import:{self.path}#{spec}"
        self.nodes.append((node, "import", spec, line, line))
        self.edges.append((self.module, node, "imports"))

    # -- headers ---------------------------------------------------------------------------
    def plain(self, head: list[int]) -> list[int]:
        """Without line ends, annotations and attributes."""
        out, k, w = [], 0, self.words
        head = [i for i in head if self.kinds[i] != "nl"]
        while k < len(head):
            if w[head[k]] == "@" and k + 1 < len(head) and w[head[k + 1]] != "interface":
                k += 2
                while k + 1 < len(head) and w[head[k]] == ".":
                    k += 2
                if k < len(head) and w[head[k]] == "(":
                    k = self.closing(head, k) + 1
            elif w[head[k]] == "[" and not out and self.lang == "cs":
                k = self.closing(head, k) + 1
            elif self.lang == "c" and w[head[k]] == "template" and k + 1 < len(head) and w[head[k + 1]] == "<":
                k, level = k + 2, 1
                while k < len(head) and level:
                    level += (w[head[k]] == "<") - (w[head[k]] == ">")
                    k += 1
            elif self.lang == "c" and w[head[k]] in ("public", "private", "protected") and k + 1 < len(head) and w[head[k + 1]] == ":":
                k += 2
            else:
                out.append(head[k])
                k += 1
        return out

    def closing(self, head: list[int], k: int) -> int:
        level = 0
        while k < len(head):
            level += (self.words[head[k]] in "([") - (self.words[head[k]] in ")]")
            if level == 0:
                return k
            k += 1
        return len(head) - 1

    def named_before(self, head: list[int], k: int) -> int | None:
        """Index in ``head`` of the name before the parenthesis at ``k``; type arguments between are passed."""
        k -= 1
        if k >= 0 and self.words[head[k]] == ">":
            level = 0
            while k >= 0:
                level += (self.words[head[k]] == ">") - (self.words[head[k]] == "<")
                k -= 1
                if level == 0:
                    break
        return k if k >= 0 and self.kinds[head[k]] == "id" else None

    def parameters(self, head: list[int], k: int) -> str:
        end = self.closing(head, k)
        return self.text[self.at[head[k]] + 1 : self.at[head[end]]] if end > k else ""

    def declared(self, frame: Frame, head: list[int], body: bool) -> tuple[str, str, str, str] | None:
        """(kind, name, receiver, parameters) of what a header declares; kind is type, func or ns."""
        lang, w = self.lang, self.words
        head = self.plain(head)
        said = [w[i] for i in head]
        if not said:
            return None
        outer = next((f.name for f in reversed(self.stack) if f.kind == "type"), "")
        inside_type = frame.kind == "type"
        parens = next((k for k, x in enumerate(said) if x == "("), len(said))
        assign = next((k for k, x in enumerate(said) if x == "="), len(said))
        for k, x in enumerate(said):  # types
            if x in TYPE_WORDS[lang] and k < min(parens, assign if lang != "c" else parens) + (lang == "kt") and not (k and said[k - 1] in (".", "::", "enum")):
                if lang == "kt" and "fun" in said[:k]:
                    break
                after = next((i for i in range(k + 1, len(head)) if self.kinds[head[i]] == "id" and said[i] not in ("class", "struct")), None)
                if after is None or (lang == "c" and not body):
                    return ("type", "Companion", "", "") if lang == "kt" and "companion" in said and body else None
                if lang == "c" and "(" in said and said.index("(") > after:
                    break  # a function that gives one
                if lang == "swift" and x == "class" and ("func" in said or "var" in said):
                    break
                return "type", said[after], "", ""
            if x == "(":
                break
        if lang == "go":
            if said[0] == "type" and len(said) > 2 or frame.kind == "group" and frame.name == "type" and len(said) > 1:
                return "type", said[said[0] == "type"], "", ""
            if said[0] == "func" and len(said) > 2 and body:
                if said[1] == "(":
                    end = self.closing(head, 1)
                    receiver = [x for i, x in zip(head[1:end], said[1:end], strict=True) if self.kinds[i] == "id"]
                    kind = re.sub(r"\[.*", "", self.text[self.at[head[2]] : self.at[head[end]]].strip())
                    receiver = re.findall(r"\w+", kind)[-1:] if receiver else []
                    return ("func", said[end + 1], receiver[0] if receiver else "", "") if end + 1 < len(said) else None
                return "func", said[1], "", ""
            return None
        if lang == "ts" and "type" in said[:3] and (k := said.index("type")) + 2 < len(said) and "=" in said and self.kinds[head[k + 1]] == "id" and all(x in ("export", "declare") for x in said[:k]):
            return "type", said[k + 1], "", ""
        if lang in ("cs", "php", "c") and said[0] in ("namespace", "inline") and len(said) > 1 and body:
            name = "".join(x for x in said[1:] if x not in ("namespace",))
            return ("ns", name, "", "") if name else None
        if lang in ("js", "ts"):
            if "function" in said and (k := said.index("function")) < parens:
                name = next((x for i, x in zip(head[k + 1 : parens], said[k + 1 : parens], strict=True) if self.kinds[i] == "id"), "")
                if not name and assign < k and assign >= 1:
                    name = said[assign - 1] if self.kinds[head[assign - 1]] == "id" else ""
                return ("func", name, outer if inside_type else "", "") if name and body else None
            if "=>" in said and assign < len(said):
                name = next((x for i, x in zip(head[:assign], said[:assign], strict=True) if self.kinds[i] == "id" and x not in ("export", "const", "let", "var", "default", "static", "public", "private", "protected", "readonly", "declare", "async")), "")
                arrow = said.index("=>")
                value = said[assign + 1 : arrow]
                if name and (value[:1] in (["("], ["async"], ["<"]) or len(value) == 1) and (inside_type or said[0] in ("export", "const", "let", "var")):
                    return "func", name, outer if inside_type else "", ""
                return None
            if inside_type and body and parens < assign and (k := self.named_before(head, parens)) is not None and said[k] not in CONTROL:
                return "func", said[k], outer, ""
            return None
        if lang in ("kt", "swift"):
            word = {"kt": ("fun", "constructor"), "swift": ("func", "init", "deinit")}[lang]
            start = next((k for k, x in enumerate(said[:6]) if x in word), None)
            if start is None or (said[start] in ("constructor", "init") and not inside_type) or parens >= len(said):
                return None
            if said[start] in ("constructor", "init", "deinit"):
                return "func", said[start], outer, self.parameters(head, parens)
            k = self.named_before(head, parens)
            if k is None or k <= start:
                return None
            own = inside_type or (self.stack[-1].kind == "group")
            return "func", said[k], outer if own else "", self.parameters(head, parens)
        if lang == "php":
            if "function" in said and (k := said.index("function")) < parens and parens < len(said):
                name = said[parens - 1]
                return ("func", name, outer if inside_type else "", "") if name not in ("function", "&") and (body or inside_type) else None
            return None
        # java, cs, c
        if parens >= len(said) or parens > assign or "new" in said[:parens] or (frame.kind not in ("type",) and lang != "c") or frame.kind in ("func", "block"):
            return None
        k = self.named_before(head, parens)
        if k is None or said[k] in CONTROL or (lang == "c" and not body):
            return None
        if not body and k == 0:
            return None  # a bare call, no declaration
        if lang == "c":
            if k >= 2 and said[k - 1] == "::":
                return "func", said[k], said[k - 2], ""
            if k == 0 and not inside_type:
                return None
            return "func", said[k], outer if inside_type else "", ""
        return "func", said[k], outer, self.parameters(head, parens)

    # -- the walk ---------------------------------------------------------------------------
    def flush(self, frame: Frame) -> None:
        """Calls of a finished statement go to the function around it."""
        owner = next((f.id for f in reversed(self.stack) if f.kind == "func"), "")
        self.edges += [(owner, f"symbol:{name}", "calls") for name, _ in frame.calls if owner]
        frame.calls = []

    def add(self, what: tuple[str, str, str, str], start: int, end: int) -> tuple[str, int]:
        kind, name, receiver, params = what
        if kind == "ns":
            node = f"package:{self.path}#{name}"
            return node, self.put(node, "package", name, start, end, self.module)
        if kind == "type":
            node = f"type:{self.path}#{name}"
            return node, self.put(node, "type", name, start, end, self.module)
        tail = self.signature(params) if self.lang in SIGNED else ""
        node = f"method:{self.path}#{receiver}.{name}{tail}" if receiver else f"func:{self.path}#{name}{tail}"
        owner = self.module
        if receiver and self.lang in OWNED:
            owner = f"type:{self.path}#{receiver}"
        elif outer := next((f.id for f in reversed(self.stack) if f.kind == "func"), ""):
            owner = outer
        return node, self.put(node, "method" if receiver else "function", name, start, end, owner)

    def statement(self, frame: Frame) -> None:
        """A header that opens nothing: packages, imports, declarations without a body."""
        head = [i for i in frame.head if self.kinds[i] != "nl"]
        said = [self.words[i] for i in head]
        if said and frame.kind in ("file", "ns", "group", "type", "block", "func"):
            self.imports(frame, head, said)
            bare = self.lang in ("java", "cs", "kt", "swift", "php") or "=>" in said or (self.lang == "ts" and "type" in said[:3]) or self.lang == "go"
            if bare and (what := self.declared(frame, frame.head, False)) and (frame.kind != "func" or "=>" in said):
                start, end = self.line[self.plain(frame.head)[0]], self.line[head[-1]]
                node, _ = self.add(what, start, end)
                if what[0] == "func":
                    own = {self.words[i] for i in head[: said.index("=")]} if "=" in said else set(said)
                    self.edges += [(node, f"symbol:{name}", "calls") for name, _ in frame.calls if name not in own]
                frame.calls = []
        self.flush(frame)
        frame.head = []

    def imports(self, frame: Frame, head: list[int], said: list[str]) -> None:
        first, line = said[0], self.line[head[0]]
        strings = [self.words[i].strip("\"'`") for i in head if self.kinds[i] == "str"]
        if self.lang == "go":
            if first == "package" and len(said) > 1 and frame.kind == "file":
                self.module = f"package:{self.path}#{said[1]}"
                self.put(self.module, "package", said[1], line, line, f"file:{self.path}")
            elif (first == "import" or frame.kind == "group" and frame.name == "import") and strings:
                self.imported(strings[-1], line)
        elif self.lang in ("js", "ts"):
            if first in ("import", "export") and strings and ("from" in said or len(said) <= 3) and first == "import" or first == "export" and "from" in said and strings:
                self.imported(strings[-1], line)
        elif first == "package" and self.lang in ("java", "kt"):
            name = "".join(said[1:])
            self.put(f"package:{self.path}#{name}", "package", name, line, line, self.module)
        elif first == "namespace" and self.lang in ("cs", "php") and len(said) > 1:
            name = "".join(said[1:])
            self.put(f"package:{self.path}#{name}", "package", name, line, line, self.module)
        elif first in ("import", "using", "use") and frame.kind in ("file", "ns") and len(said) > 1 and said[1] != "(" and "=" not in said:
            words = [x for x in said[1:] if x not in ("static", "global", "function", "const", "class", "struct")]
            spec = "".join(words[: words.index("as")] if "as" in words else words)
            if spec and self.lang != "c":
                self.imported(spec.removesuffix(".*") if self.lang == "kt" else spec, line)

    def callee(self, i: int) -> str | None:
        """The dotted name that ends with token ``i``."""
        parts, w = [self.words[i]], self.words
        k = i - 1
        while k >= 1 and w[k] in (".", "::", "->", "?."):
            if self.kinds[k - 1] != "id":
                return f"_.{w[i]}"
            parts.append(w[k - 1])
            k -= 2
        name = ".".join(reversed(parts))
        return None if parts[0] in CONTROL and len(parts) == 1 else name

    def read(self) -> tuple[list[Node], list[Edge]]:
        w, kinds = self.words, self.kinds
        self.stack = [Frame("file")]
        where: list[int] = [-1]  # the node of each frame
        braces: list[bool] = []  # open braces: of a frame, or only of an expression
        for spec, line in getattr(self, "pending_imports", []):
            self.imported(spec, line)
        for i, x in enumerate(w):
            frame = self.stack[-1]
            if kinds[i] == "nl":
                if self.lang in LINES and frame.depth == 0 and frame.head and w[frame.head[-1]] not in OPEN_END:
                    after = next((k for k in range(i + 1, min(i + 40, len(w))) if kinds[k] != "nl"), None)
                    if after is None or w[after] not in (".", "?.", "?", ":", "&&", "||", "=", "{") or (w[after] == "{" and self.lang == "go"):
                        self.statement(frame)
                continue
            if kinds[i] == "op":
                if x == "{":
                    said = [w[k] for k in frame.head[:2]]
                    if said[:1] in (["import"], ["export"]) and len(frame.head) <= 3 and self.lang in ("js", "ts") and not ({"class", "function", "default", "const", "interface", "enum", "type"} & {w[k] for k in frame.head}) or said in (["const"], ["let"], ["var"]):
                        frame.depth += 1
                        frame.head.append(i)
                        braces.append(False)
                        continue
                    what = self.declared(frame, frame.head, True) if frame.depth == 0 else None
                    start = self.line[self.plain(frame.head)[0]] if what else self.line[i]
                    if what:
                        frame.calls = []
                        node, at = self.add(what, start, self.line[i])
                        self.stack.append(Frame(what[0] if what[0] != "ns" else "ns", node if what[0] == "func" else "", what[1], start))
                    else:
                        at = -1
                        if frame.depth == 0:
                            self.flush(frame)
                        self.stack.append(Frame("block"))
                    where.append(at)
                    braces.append(True)
                    if frame.depth == 0 and what:
                        frame.head = []
                    continue
                if x == "}":
                    if braces and not braces.pop():
                        frame.depth = max(0, frame.depth - 1)
                        frame.head.append(i)
                        continue
                    while len(self.stack) > 1 and self.stack[-1].kind == "group":
                        self.statement(self.stack[-1])
                        self.stack.pop()
                        where.pop()
                    frame = self.stack[-1]
                    self.statement(frame)
                    if len(self.stack) > 1:
                        self.stack.pop()
                        at = where.pop()
                        if at >= 0:
                            n = self.nodes[at]
                            self.nodes[at] = (*n[:4], self.line[i])
                        up = self.stack[-1]
                        if up.depth == 0 and not (up.head and self.lang in ("js", "ts") and w[up.head[0]] in ("const", "let", "var", "export", "import", "type", "return")):
                            self.flush(up)
                            up.head = []
                        else:
                            up.head.append(i)
                    continue
                if x == ";" and frame.depth == 0:
                    self.statement(frame)
                    continue
                if x == "(":
                    if self.lang == "go" and len(frame.head) == 1 and w[frame.head[0]] in ("type", "import", "var", "const"):
                        self.stack.append(Frame("group", name=w[frame.head[0]]))
                        where.append(-1)
                        frame.head = []
                        continue
                    k = self.named_before([*range(max(0, i - 40), i)], min(i, 40))
                    if k is not None and (name := self.callee(j := max(0, i - 40) + k)):
                        new = j >= 1 and w[j - 1] == "new"
                        if w[j] == "require" and self.lang in ("js", "ts") and kinds[i + 1 : i + 2] == ["str"]:
                            self.imported(w[i + 1].strip("\"'`"), self.line[i])
                        elif not new or self.lang == "java":
                            frame.calls.append((name, new))
                    frame.depth += 1
                elif x == "[":
                    frame.depth += 1
                elif x in (")", "]"):
                    if x == ")" and frame.kind == "group" and frame.depth == 0:
                        self.statement(frame)
                        self.stack.pop()
                        where.pop()
                        continue
                    frame.depth = max(0, frame.depth - 1)
            frame.head.append(i)
        while self.stack:
            self.statement(self.stack[-1])
            self.stack.pop()
        return self.nodes, self.edges


def reader(lang: str):
    def extract(path: str, text: str) -> tuple[list[Node], list[Edge]]:
        return Reader(path, text.lstrip("\ufeff"), lang).read()

    return extract


# -- Ruby ---------------------------------------------------------------------------------
RUBY_GAP = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|#[^\n{][^\n]*|#$")
RUBY_OPEN = re.compile(r"^\s*(?:if|unless|while|until|case|begin|for)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|unless|case|begin)\b")
RUBY_CALL = re.compile(r"(?<![\w.@:$])((?:[A-Za-z_@]\w*(?:\.|::|&\.))*[a-z_]\w*[?!]?)(?:\s*\(|(?=\.[a-z_]\w*))")
RUBY_COMMAND = re.compile(r"^\s*((?:[A-Za-z_]\w*\.)*[a-z_]\w*[?!]?)[ \t]+(?![=+\-*/<>|&?:.,)\]}]|(?:if|unless|do|and|or|while|until|rescue)\b)\S")
RUBY_WORDS = frozenset("if unless while until case when then else elsif end def class module do begin rescue ensure return yield and or not in self super nil true false puts_ require require_relative load autoload attr_accessor attr_reader attr_writer private public protected include extend raise_ loop_ next break redo retry alias undef defined".split())


def read_ruby(path: str, text: str) -> tuple[list[Node], list[Edge]]:
    base = path.rsplit("/", 1)[-1]
    module, lines = f"module:{path}", text.count("\n") + 1
    nodes: list[Node] = [(f"file:{path}", "file", path, 1, lines), (module, "module", base.rsplit(".", 1)[0] or base, 1, lines)]
    edges: list[Edge] = [(f"file:{path}", module, "contains")]
    stack: list[tuple[str, str, int]] = []  # kind, name or id, node

    def put(node: str, kind: str, name: str, line: int) -> int:
        nodes.append((node, kind, name, line, line))
        edges.append((module, node, "imports" if kind == "import" else "contains"))
        return len(nodes) - 1

    for at, raw in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*(?:require|require_relative|load)\s*\(?\s*[\"']([^\"']+)[\"']", raw):
            put(f"import:{path}#{m[1]}", "import", m[1], at)
            continue
        line = RUBY_GAP.sub(lambda m: '""' if m[0][0] != "#" else "", raw.rstrip("\r"))
        if m := re.match(r"\s*(?:class|module)\s+(?!<<)([A-Z]\w*(?:::\w+)*)", line):
            stack.append(("type", m[1], put(f"type:{path}#{m[1]}", "type", m[1], at)))
        elif re.match(r"\s*class\s*<<", line):
            stack.append(("block", "", -1))
        elif m := re.match(r"\s*(?:private\s+|public\s+|protected\s+)?def\s+(?:self\.|[A-Z]\w*\.)?([A-Za-z_]\w*[?!=]?|[+\-*/<>=!\[\]%&|^~]+)(.*)", line):
            owner = next((n for k, n, _ in reversed(stack) if k == "type"), "")
            node = f"method:{path}#{owner}.{m[1]}" if owner else f"func:{path}#{m[1]}"
            k = put(node, "method" if owner else "function", m[1], at)
            if not re.match(r"\s*(\([^()]*\))?\s*=", m[2]) and not re.search(r"\bend\s*$", line):  # else on one line
                stack.append(("func", node, k))
            line = re.sub(r"^[^;=]*", "", line) if ";" in line or "=" in m[2] else ""
        elif re.match(r"\s*end\b", line):
            if stack:
                _, _, k = stack.pop()
                if k >= 0:
                    nodes[k] = (*nodes[k][:4], at)
            continue
        elif RUBY_OPEN.search(line) and not re.search(r"\bend\s*$", line):
            stack.append(("block", "", -1))
        owner = next((n for k, n, _ in reversed(stack) if k == "func"), "")
        if owner and line:
            found = [m[1] for m in RUBY_CALL.finditer(line)] + ([m[1]] if (m := RUBY_COMMAND.match(line)) else [])
            edges.extend((owner, f"symbol:{name.replace('::', '.').replace('&.', '.')}", "calls") for name in found if name.split(".")[-1] not in RUBY_WORDS)
    return nodes, edges
