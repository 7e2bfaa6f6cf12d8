"""Symbols of TypeScript and JavaScript sources: a tokenizer and bracket matcher over one file at a time.

Supported: exported (for JavaScript, else all top-level) functions, arrow and function constants, classes, interfaces,
aliases, export lists with renames, `module.exports` and `exports.x`, destructured and rest parameters,
documentation comments, hook calls, side effects, behaviours, imports and calls. Types are
normalised textually; types of other files aren't expanded. What isn't recognised gives no row.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.paths import MARKERS

ROW = (
    "name string, type string, category string, path string, description string, signature string, kind string, params array<string>, props array<string>, "
    "properties array<string>, hooks array<string>, side_effects array<string>, behavior array<string>, return_type string, calls array<string>, export_name string, content string, file_hash string, semantic_hash string"
)
IMPORTS = "file string, name string, specifier string"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]
_OPEN, _CLOSE = "([{", ")]}"
_ID = r"[A-Za-z_$][\w$]*"
_KEYWORDS = set("if for while switch catch return function typeof await new super import do else throw delete void in of case yield".split())
_EFFECTS = {
    "network": r"\b(fetch|axios|xhr|ajax)\b\s*[.(]|\bXMLHttpRequest\b|\b\w*[rR]equest\s*\((?<!AnimationFrame\()",
    "timer": r"\b(setTimeout|setInterval|requestAnimationFrame|setImmediate)\s*\(",
    "storage": r"\b(localStorage|sessionStorage|cookie)\b",
}
_BEHAVIOURS = [("performs network request", r"\b\w*(fetch|axios)\w*\s*\("), ("uses timer", r"\bsetTimeout\s*\("), ("tracks scroll position", r"\bgetScroll\w*\s*\(|\bscrollTop\b"), ("computes element offset", r"\bgetOffset\w*\s*\("), ("throttles position updates", r"\bthrottle\w*\s*\("), ("listens to viewport events", r"\baddEventListener\s*\("), ("reads dom layout", r"\bgetBoundingClientRect\b|\bgetComputedStyle\b"), ("supports offset positioning", r"\boffset(Top|Bottom)\b"), ("uses fixed positioning", r"['\"]fixed['\"]"), ("uses local storage", r"\blocalStorage\b")]


def mask(source: str) -> str:
    """The source with comments and the insides of strings blanked, of the same length, so that brackets match."""
    out, i, n = list(source), 0, len(source)
    while i < n:
        two, ch = source[i : i + 2], source[i]
        if two == "//" or two == "/*":
            end = source.find("\n", i) if two == "//" else source.find("*/", i + 2)
            end = n if end < 0 else end + (0 if two == "//" else 2)
            out[i:end] = [c if c == "\n" else " " for c in source[i:end]]
            i = end
        elif ch in "'\"`":
            j = i + 1
            while j < n and source[j] != ch and (ch == "`" or source[j] != "\n"):
                j += 2 if source[j] == "\\" else 1
            out[i + 1 : min(j, n)] = [" "] * (min(j, n) - i - 1)
            i = j + 1
        else:
            i += 1
    return "".join(out)


def closing(code: str, at: int) -> int:
    """Index behind the bracket that closes the one at `at`; the end of the code if none does."""
    depth = 0
    for i in range(at, len(code)):
        if code[i] in _OPEN:
            depth += 1
        elif code[i] in _CLOSE:
            depth -= 1
            if depth == 0:
                return i + 1
    return len(code)


def split_top(code: str, mark: str = ",") -> list[str]:
    """Parts at a mark outside brackets (angle brackets too, but for arrows)."""
    out, depth, last = [], 0, 0
    for i, ch in enumerate(code):
        if ch in _OPEN or ch == "<":
            depth += 1
        elif ch in _CLOSE or ch == ">" and code[i - 1 : i] != "=":
            depth -= 1
        elif ch in mark and depth == 0:
            out.append(code[last:i])
            last = i + 1
    out.append(code[last:])
    return [p.strip() for p in out if p.strip()]


def doc_comment(source: str, at: int) -> dict:
    """Description, return type and parameter types of the block comment in front of `at`."""
    m = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*(?:export\s+)?(?:default\s+)?$", source[:at], re.S)
    if not m:
        return {"description": None, "returns": None, "params": {}}
    lines = [re.sub(r"^\s*\*\s?", "", x).strip() for x in m.group(1).split("\n")]
    text = " ".join(x for x in lines if x and not x.startswith("@"))
    returns = next((r.group(1) for x in lines if (r := re.match(r"@returns?\s*\{([^}]*)\}", x))), None)
    params = {r.group(2): r.group(1) for x in lines if (r := re.match(r"@param\s*\{([^}]*)\}\s*\[?([\w$]+)", x))}
    return {"description": text or None, "returns": returns, "params": params}


def doc_type(raw: str | None) -> str:
    """Type of a documentation comment in the few words of signatures."""
    t = (raw or "").strip().lower()
    if not t:
        return "unknown"
    if "window" in t or "htmlelement" in t or t.startswith("{") or "object" in t:
        return "object"
    if "promise" in t:
        return "promise"
    if "[]" in t or "array" in t:
        return "array"
    return next((k for k in ("string", "number", "boolean", "function") if k in t), "unknown")


def literal_type(expr: str) -> str:
    e = expr.strip()
    if e[:1] in "'\"`":
        return "string"
    if re.match(r"-?\d", e):
        return "number"
    if re.match(r"(true|false)\b", e):
        return "boolean"
    return {"[": "array", "{": "object", "<": "jsx"}.get(e[:1], "unknown")


def placeholder(index: int, rest: bool = False) -> str:
    return ("..." if rest else "") + f"$p{index}"


def destructured(param: str) -> list[str] | None:
    """Sorted field names of a destructured parameter, else None."""
    if not param.startswith("{"):
        return None
    inner = param[1 : closing(param, 0) - 1]
    return sorted(re.match(r"(?:\.\.\.)?[\w$]+", p).group() for p in split_top(inner) if re.match(r"(?:\.\.\.)?[\w$]+", p))


def params_of(raw: str) -> list[str]:
    out: list[str] = []
    for i, p in enumerate(split_top(raw)):
        fields = destructured(p)
        out += fields if fields is not None else [placeholder(i, p.startswith("..."))]
    return out


class File:
    """One source with what its declarations need."""

    def __init__(self, path: str, source: str):
        self.path, self.source, self.code = path, source, mask(source)
        self.js = path.rsplit(".", 1)[-1] in ("js", "jsx")
        self.markup = path.endswith(("tsx", "jsx"))
        self.shapes = {m.group(2): split_top(self._braced(m.end()), ";,\n") for m in re.finditer(rf"\b(interface|type)\s+({_ID})(?:<[^>]*>)?\s*(?:extends[^{{]*)?=?\s*(?=\{{)", self.code)}

    def _braced(self, at: int) -> str:
        return self.code[at + 1 : closing(self.code, at) - 1]

    def declarations(self) -> dict[str, tuple[str, int, int]]:
        """(kind, start, end) of the top-level declarations by name."""
        out, depth, at = {}, 0, 0
        pattern = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(async\s+)?function\s*\*?\s*({_ID})?|class\s+({_ID})?|interface\s+({_ID})|type\s+({_ID})\s*(?:<[^=]*>)?\s*=|(?:const|let|var)\s+({_ID}))")
        while at < len(self.code):
            ch = self.code[at]
            if depth == 0 and (at == 0 or not (self.code[at - 1].isalnum() or self.code[at - 1] in "_$.")):
                m = pattern.match(self.code, at)
                if m and m.end() > at:
                    head = m.group()
                    kind = "function" if "function" in head else "class" if m.group(3) or re.search(r"\bclass\b", head) else "interface" if m.group(4) else "type" if m.group(5) else "variable"
                    name = m.group(2) or m.group(3) or m.group(4) or m.group(5) or m.group(6) or "default"
                    end = self._end(m.end(), kind)
                    out[name] = (kind, at, end)
                    at = end
                    continue
            if ch in _OPEN:
                depth += 1
            elif ch in _CLOSE:
                depth = max(0, depth - 1)
            at += 1
        return out

    def _end(self, at: int, kind: str) -> int:
        i, n = at, len(self.code)
        while i < n:
            ch = self.code[i]
            if ch in _OPEN:
                i = closing(self.code, i)
                if kind in ("class", "interface") and self.code[i - 1] == "}" or kind == "function" and self.code[i - 1] == "}" and not re.match(r"\s*[{>|&\[]", self.code[i:]):
                    return i
                continue
            if ch == ";" or ch == "\n" and kind in ("type", "variable") and re.match(r"\s*(export|const|let|var|function|class|interface|type|module|/\*|$)", self.code[i + 1 :]) and not re.search(r"(=>|[=|&?:,])\s*$", self.code[at:i]):
                return i + 1
            i += 1
        return n

    def exports(self) -> list[tuple[str, str]]:
        """(exported name, declared name), in order."""
        out, known = [], self.declarations()
        for name, (_, start, _) in known.items():
            if self.code.startswith("export", start):
                out.append((name, name))
        for m in re.finditer(r"\bexport\s*\{([^}]*)\}(?!\s*from)", self.code):
            for part in split_top(m.group(1)):
                a, _, b = part.removeprefix("type ").partition(" as ")
                out.append((b.strip() or a.strip(), a.strip()))
        for m in re.finditer(rf"\bexport\s+default\s+({_ID})\s*;?\s*(?:\n|$)", self.code):
            out.append((m.group(1), m.group(1)))
        if self.js:
            for m in re.finditer(r"\bmodule\.exports\s*=\s*", self.code):
                rest = self.code[m.end() :]
                if rest.startswith("{"):
                    for part in split_top(self._braced(m.end())):
                        a, _, b = part.partition(":")
                        out.append((a.strip(), (b or a).strip()))
                elif d := re.match(_ID, rest):
                    out.append((d.group(), d.group()))
            out += [(m.group(1), m.group(2)) for m in re.finditer(rf"\bexports\.({_ID})\s*=\s*({_ID})", self.code)]
            if not out:
                out = [(k, k) for k, v in known.items() if v[0] in ("function", "class", "variable")]
        seen: set[str] = set()
        return [(a, b) for a, b in out if b in known and not (a in seen or seen.add(a))]

    def callable_parts(self, kind: str, start: int, end: int) -> tuple[str, str, str, str, str] | None:
        """(type parameters, parameters, return type, body, masked body) of a function or function constant."""
        code = self.code[start:end]
        if kind == "function":
            m = re.search(r"\bfunction\s*\*?\s*[\w$]*\s*(<[^(]*>)?\s*(?=\()", code)
        else:
            m = re.search(r"=\s*(?:[\w.$]+(?:<[^(]*>)?\(\s*)?(?:async\s+)?(?:function\s*\*?\s*[\w$]*\s*)?(<[^(]*>)?\s*(?=\()", code)
            if not m and (a := re.search(rf"=\s*(?:async\s+)?({_ID})\s*=>", code)):
                at = start + a.end()
                return "", a.group(1), "", self.source[at:end], self.code[at:end]
        if not m:
            return None
        stop = closing(code, m.end())
        raw = code[m.end() + 1 : stop - 1]
        tail = code[stop:]
        if kind == "function":
            r = re.match(r"\s*(?::\s*((?:[^{=]|\{[^{}]*\}(?=\s*[{|&\[]))*?))?\s*(?=\{)", tail)
        else:
            r = re.match(r"\s*(?::\s*([^=]*?(?:=>[^=]*?)?))?\s*=>", tail) or re.match(r"\s*(?::\s*([^{]*))?(?=\{)", tail)
        if not r:
            return None
        at = start + stop + r.end()
        return (m.group(1) or "").strip("<> "), raw, (r.group(1) or "").strip(), self.source[at:end], self.code[at:end]

    def row(self, exported: str, name: str) -> dict | None:
        kind, start, end = self.declarations()[name]
        doc = doc_comment(self.source, start)
        out = dict.fromkeys(COLUMNS)
        out |= {"name": name, "path": self.path, "description": doc["description"], "export_name": exported, "hooks": [], "side_effects": [], "behavior": [], "calls": [], "params": [], "props": [], "properties": []}
        code = self.code[start:end]
        if kind == "interface":
            body = split_top(code[code.index("{") + 1 : closing(code, code.index("{")) - 1], ";,\n")
            out |= {"type": "interface", "kind": "interface", "properties": [p for x in body if (p := field_name(x))], "signature": "interface{" + ";".join(sorted(norm(x) for x in body)) + "}"}
        elif kind == "type":
            value = code.split("=", 1)[1].strip().rstrip(";").strip()
            body = split_top(value[1 : closing(value, 0) - 1], ";,\n") if value.startswith("{") else []
            out |= {"type": "type", "kind": "typeAlias", "properties": [p for x in body if (p := field_name(x))], "signature": "type{" + (";".join(sorted(norm(x) for x in body)) or norm(value)) + "}"}
        elif kind == "class":
            methods = sorted({m.group(1) for m in re.finditer(rf"(?:^|[;}}\n{{])\s*(?:public\s+|static\s+|async\s+)*({_ID})\s*\([^)]*\)[^;{{]*\{{", code[code.index("{") :]) if m.group(1) not in _KEYWORDS | {"constructor"}} if "{" in code else [])
            kind_of = ("component" if name[:1].isupper() else "function") if self.js else "class"
            out |= {"type": kind_of, "kind": "class", "signature": "class{" + ";".join(f"{m}():unknown" for m in methods) + "}"}
        else:
            parts = self.callable_parts(kind, start, end)
            if parts is None:
                return None
            self._callable(out, name, doc, *parts)
        out["category"] = category(self.path, name)
        out["content"] = self.source[start : min(end, start + 4000)]
        out["file_hash"] = hashlib.sha256(self.source.encode()).hexdigest()
        stable = {k: out[k] for k in ("name", "type", "description", "signature")} | {"sideEffects": sorted(out["side_effects"]), "hooks": sorted(out["hooks"])}
        if self.js:
            stable["behavior"] = sorted(out["behavior"])
        out["semantic_hash"] = hashlib.sha256(json.dumps(stable, ensure_ascii=False).encode()).hexdigest()
        return out

    def _callable(self, out: dict, name: str, doc: dict, generics: str, raw: str, returns: str, body: str, code: str) -> None:
        params = split_top(raw)
        out["params"] = params_of(raw)
        out["hooks"] = sorted({m.group(1) for m in re.finditer(r"\b(use[A-Z]\w*)\s*(?:<[^>()]*>)?\(", code)})
        effects = {k for k, p in _EFFECTS.items() if re.search(p, code)}
        if re.search(r"\b(document|window|navigator|location)\.[\w.]+\s*=(?!=)|\b(document|window)\.\w+\s*\(", code) or self.js and re.search(r"\bgetBoundingClientRect\b|\bdocument\b", code):
            effects.add("dom")
        owned = [re.match(r"[\w$]+", p).group() for p in params if re.match(r"[\w$]+", p)]
        if any(re.search(rf"(?<![\w$.]){re.escape(p)}(?:\.[\w$]+|\[[^\]]*\])+\s*(?:=(?!=|>)|\+=|-=|\+\+|--)|(?<![\w$.]){re.escape(p)}(?:\.[\w$]+)*\.(?:push|pop|shift|unshift|splice|sort|reverse)\s*\(", code) for p in owned):
            effects.add("mutation")
        out["side_effects"] = sorted(effects)
        out["calls"] = sorted({m.group(1) for m in re.finditer(rf"(?<![\w$.])({_ID})\s*\(", code) if m.group(1) not in _KEYWORDS})
        markup = self.markup and bool(re.search(r"(?:[(>?:&|,{}]|\breturn)\s*<[A-Za-z>]", code))
        if self.js:
            out["type"] = "hook" if "use" in name.lower() else "component" if self.markup or name[:1].isupper() else "function"
            out["behavior"] = sorted({k for k, p in _BEHAVIOURS if re.search(p, body if "fixed" in p else code, re.I)})
            m = re.search(r"\breturn\s+([^;\n]+)", body) if body.lstrip().startswith("{") else re.match(r"\s*\(?\s*(.+)", body, re.S)
            kind = doc_type(doc["returns"]) if doc["returns"] else literal_type(m.group(1)) if m else "unknown"
            out["return_type"] = kind
            types = [doc_type(doc["params"].get(re.match(r"(?:\.\.\.)?([\w$]*)", p).group(1))) for p in params]
            inside = [("{" + ";".join(destructured(p)) + "}" if destructured(p) is not None else f"{placeholder(i, p.startswith('...'))}:{t}" if "=" not in p else f"{placeholder(i)}=$default") for i, (p, t) in enumerate(zip(params, types))]
            out["signature"] = f"fn({','.join(inside)})=>{kind}"
        else:
            out["type"] = "hook" if re.match(r"use[A-Z0-9_]", name) else "component" if markup else "function"
            names = {g.split()[0]: f"${'T' if len(split_top(generics)) == 1 else 'T' + str(i)}" for i, g in enumerate(split_top(generics))}
            swap = lambda t: re.sub(rf"\b({'|'.join(map(re.escape, names))})\b", lambda m: names[m.group()], norm(t)) if names else norm(t)
            inside = [f"{placeholder(i, p.startswith('...'))}:{swap(split_top(p, ':')[1].split('=')[0]) if len(split_top(p, ':')) > 1 else 'unknown'}" for i, p in enumerate(params)]
            out["return_type"] = norm(returns) or None
            out["signature"] = f"fn{'<' + ','.join(names.values()) + '>' if names else ''}({','.join(inside)})=>{swap(returns) if returns else 'unknown'}"
            if out["type"] == "component":
                shape = re.search(rf":\s*(?:[\w.]+<)?({_ID})", params[0]) if params else None
                fields = [f for f in (field_name(x) for x in self.shapes.get(shape.group(1), [])) if f] if shape else []
                out["props"] = sorted({p for p in [*out["params"], *fields] if p != "props" and not re.match(r"(\.\.\.)?\$p\d", p)})
                out["params"] = []
        out["kind"] = "function"


def norm(text: str) -> str:
    return re.sub(r"\s*([:;,|&<>(){}\[\]=?])\s*", r"\1", re.sub(r"\s+", " ", text.strip()))


def field_name(member: str) -> str | None:
    m = re.match(r"(?:readonly\s+)?['\"]?([\w$-]+)['\"]?\??\s*[:(<]", member.strip())
    return m.group(1) if m else None


def category(path: str, name: str) -> str | None:
    for part in reversed(path.lower().replace("\\", "/").split("/")):
        if part in MARKERS:
            return part
    low = name.lower()
    return "hook" if low.startswith("use") else next((v for k, v in (("fetch", "network"), ("format", "format"), ("validate", "validation")) if k in low), None)


def extract(path: str, source: str) -> list[dict]:
    """Symbol rows of one file, in the order of its exports."""
    file = File(path, source or "")
    return [r for e, n in file.exports() if (r := file.row(e, n))]


def imports(path: str, source: str) -> list[tuple[str, str, str]]:
    """(file, imported name, specifier) of imports and requires."""
    out = []
    for m in re.finditer(r"\bimport\s+(?:type\s+)?([^'\"]*?)\s+from\s*['\"]([^'\"]+)['\"]", source or ""):
        head, where = m.group(1), m.group(2)
        for part in split_top(re.sub(r"[{}]", ",", head)):
            name = part.removeprefix("type ").split(" as ")[0].strip()
            if name and name != "*":
                out.append((path, name, where))
    for m in re.finditer(rf"\b(?:const|let|var)\s+(?:\{{([^}}]*)\}}|({_ID}))\s*=\s*require\(\s*['\"]([^'\"]+)['\"]", source or ""):
        out += [(path, part.split(":")[0].strip(), m.group(3)) for part in split_top(m.group(1) or m.group(2))]
    return out


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of (path, content): one Python pass a file, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, s in zip(b["path"], b["content"]) for r in extract(p, s)], columns=COLUMNS)

    return files.select("path", "content").mapInPandas(run, ROW)


def extract_imports(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, s in zip(b["path"], b["content"]) for r in imports(p, s)], columns=["file", "name", "specifier"])

    return files.select("path", "content").mapInPandas(run, IMPORTS)


def calls_of(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.col("path").alias("file"), F.explode("calls").alias("name"))
