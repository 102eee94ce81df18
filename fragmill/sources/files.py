"""Source files to declarations: scans by language, parsed in Arrow batches; one bad file is a row, not a failure."""

from __future__ import annotations

import ast
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.session import share_package

_CALL = pa.struct([("name", pa.string()), ("receiver", pa.string())])
_NOTE = pa.struct([("name", pa.string()), ("args", pa.string())])
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_FIELDS = [("file", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("span", _SPAN), ("signature", pa.string()), ("container", pa.string()), ("doc", pa.string()), ("modifiers", pa.list_(pa.string())), ("annotations", pa.list_(_NOTE)), ("calls", pa.list_(_CALL)), ("supertypes", pa.list_(pa.string())), ("locals", pa.map_(pa.string(), pa.string())), ("error", pa.string())]
DECLARATIONS = "file string, name string, kind string, span struct<start:int,end:int>, signature string, container string, doc string, modifiers array<string>, annotations array<struct<name:string,args:string>>, calls array<struct<name:string,receiver:string>>, supertypes array<string>, locals map<string,string>, error string"


class Language(ABC):
    """An adapter of one language: which files it reads, and the declarations in one."""

    name: str
    globs: Sequence[str]
    skip: Sequence[str] = ()

    @abstractmethod
    def scan(self, source: str) -> list[dict]:
        """Declarations as dictionaries of the columns above, without file and error."""

    def takes(self, path: str) -> bool:
        return any(fnmatch(path, g) for g in self.globs) and not any(s in path for s in self.skip)


LANGUAGES: dict[str, Language] = {}


def register(language: Language) -> Language:
    if language.name in LANGUAGES:
        raise ValueError(f"language {language.name!r} exists")
    LANGUAGES[language.name] = language
    return language


class Python(Language):
    name, globs, skip = "python", ("*.py",), ("/.venv/", "/node_modules/")

    def scan(self, source: str) -> list[dict]:
        out: list[dict] = []

        def walk(node: ast.AST, container: str) -> None:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                    kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                    calls, scope = [], {}
                    if kind != "class":
                        for a in (*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs):
                            if isinstance(a.annotation, ast.Name):
                                scope[a.arg] = a.annotation.id
                        for c in ast.walk(child):
                            target = c.target if isinstance(c, ast.AnnAssign) else c.targets[0] if isinstance(c, ast.Assign) and len(c.targets) == 1 else None
                            made = c.annotation if isinstance(c, ast.AnnAssign) else c.value.func if target is not None and isinstance(c.value, ast.Call) else None
                            if isinstance(target, ast.Name) and isinstance(made, ast.Name) and made.id[:1].isupper():
                                scope[target.id] = made.id
                        for c in ast.walk(child):
                            if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute)):
                                owner = c.func.value if isinstance(c.func, ast.Attribute) else None
                                calls.append({"name": c.func.attr if owner is not None else c.func.id, "receiver": owner.id if isinstance(owner, ast.Name) else None})
                    notes = [{"name": ast.unparse(d.func if isinstance(d, ast.Call) else d), "args": ", ".join(map(ast.unparse, d.args)) if isinstance(d, ast.Call) else ""} for d in child.decorator_list]
                    signature = child.name + ("" if kind == "class" else f"({ast.unparse(child.args)})")
                    out.append({"name": child.name, "kind": kind, "span": {"start": child.lineno, "end": child.end_lineno}, "signature": signature, "container": container, "doc": ast.get_docstring(child) or "", "modifiers": ["async"] if isinstance(child, ast.AsyncFunctionDef) else [], "annotations": notes, "calls": calls, "locals": scope, "supertypes": [ast.unparse(b) for b in child.bases] if kind == "class" else []})
                    walk(child, f"{container}.{child.name}" if container else child.name)
                else:
                    walk(child, container)

        walk(ast.parse(source), "")
        return out


# Words of the language.
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "volatile", "transient", "strictfp"}
_TYPES = {"class", "interface", "enum", "record", "annotation_type"}
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "new", "super", "this", "synchronized", "try", "throw", "assert"}
_TOKEN = re.compile(r'/\*\*.*?\*/|/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|@?[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*|\d[\w.]*|\S', re.S)


class Java(Language):
    """Declarations by a pass over tokens and braces; no grammar is at hand here."""

    name, globs, skip = "java", ("*.java",), ("/test/", "/target/")

    @staticmethod
    def _doc(text: str) -> str:
        lines = (re.sub(r"^\s*\*+ ?", "", x).strip() for x in text[3:-2].splitlines())
        return " ".join(x for x in lines if x and not x.startswith("@"))

    def scan(self, source: str) -> list[dict]:
        tokens = [(m.group(), source.count("\n", 0, m.start()) + 1) for m in _TOKEN.finditer(source)]
        out: list[dict] = []
        scopes: list[dict | None] = []
        head: list[tuple[str, int]] = []
        doc, depth = "", 0

        def owner() -> str:
            return ".".join(s["name"] for s in scopes if s and s["kind"] in _TYPES)

        def typed(words: list[str], k: int) -> str | None:
            """The type before the name at ``k``, without its parameters."""
            j = k - 1
            if j >= 0 and words[j] == ">":
                level = 1
                while j > 0 and level:
                    j -= 1
                    level += (words[j] == ">") - (words[j] == "<")
                j -= 1
            return words[j].rpartition(".")[2] if j >= 0 and re.fullmatch(r"(?:[\w$]+\.)*[A-Z][\w$]*", words[j]) else None

        def declared(ends_in: str, line: int) -> dict | None:
            nonlocal doc
            words = ["annotation_type" if t == "@interface" else t for t, _ in head]
            notes, k = [], 0
            while k < len(words):
                if words[k].startswith("@") and len(words[k]) > 1:
                    args, j = "", k + 1
                    if j < len(words) and words[j] == "(":
                        level, j = 1, j + 1
                        while j < len(words) and level:
                            level += (words[j] == "(") - (words[j] == ")")
                            args += words[j] + " " if level else ""
                            j += 1
                    notes.append({"name": words[k][1:], "args": args.strip()})
                    del words[k:j]
                else:
                    k += 1
            mods = [w for w in words if w in _MODIFIERS]
            rest = [w for w in words if w not in _MODIFIERS]
            inside = scopes[-1]["kind"] if scopes and scopes[-1] else None
            found = None
            kind = next((w for w in rest if w in _TYPES), None)
            if kind and rest.index(kind) + 1 < len(rest):
                at = rest.index(kind)
                supers = [w for w in rest[at + 2 :] if re.match(r"[A-Z]", w) and w not in ("extends", "implements")]
                found = {"name": rest[at + 1], "kind": kind, "supertypes": supers}
            elif inside in _TYPES and "(" in rest and ends_in in "{;" and "=" not in rest[: rest.index("(")]:
                name = rest[rest.index("(") - 1] if rest.index("(") else ""
                if re.fullmatch(r"[A-Za-z_$][\w$]*", name):
                    found = {"name": name, "kind": "constructor" if name == scopes[-1]["name"] else "method", "supertypes": []}
            elif inside in _TYPES and ends_in == ";" and len(rest) > 1:
                left = rest[: rest.index("=")] if "=" in rest else rest
                if re.fullmatch(r"[A-Za-z_$][\w$]*", left[-1]) and len(left) > 1:
                    found = {"name": left[-1], "kind": "field", "supertypes": []}
            if found:
                found |= {"span": {"start": head[0][1], "end": line}, "signature": " ".join(rest), "container": owner(), "doc": doc, "modifiers": mods, "annotations": notes, "calls": [], "locals": {}}
                if "(" in rest and found["kind"] in ("method", "constructor"):
                    found["locals"] = {rest[k]: kind for k in range(rest.index("(") + 1, len(rest) - 1) if rest[k + 1] in ",)" and (kind := typed(rest, k))}
                out.append(found)
            doc = ""
            return found

        def local(k: int) -> None:
            """Notes the variable that a body declares right before token ``k``."""
            body = next((s for s in reversed(scopes) if s and s["kind"] in ("method", "constructor")), None)
            near = [t for t, _ in tokens[max(0, k - 24) : k]]
            if body and len(near) > 1 and re.fullmatch(r"[a-z_$][\w$]*", near[-1]) and (kind := typed(near, len(near) - 1)):
                body["locals"].setdefault(near[-1], kind)

        for k, (t, line) in enumerate(tokens):
            if t.startswith("/**"):
                doc = self._doc(t)
            elif t.startswith(("/*", "//")):
                continue
            elif t == "{" and depth == 0:
                scopes.append(declared("{", line) if head else None)
                head = []
            elif t == "}" and depth == 0:
                if scopes and (done := scopes.pop()):
                    done["span"]["end"] = line
                head = []
            elif t == ";" and depth == 0:
                local(k)
                if head:
                    declared(";", line)
                head = []
            else:
                depth = max(0, depth + (t == "(") - (t == ")"))
                head.append((t, line))
                if t in "=:":
                    local(k)
                body = next((s for s in reversed(scopes) if s and s["kind"] in ("method", "constructor")), None)
                if body and t == "(" and k and re.fullmatch(r"[\w$.]+", tokens[k - 1][0]) and tokens[k - 1][0] not in _NO_CALL and (k < 2 or tokens[k - 2][0] != "new"):
                    receiver, _, name = tokens[k - 1][0].rpartition(".")
                    body["calls"].append({"name": name, "receiver": receiver or None})
        return out


register(Python())
register(Java())


def language_of(path: str) -> Language | None:
    return next((x for x in LANGUAGES.values() if x.takes(path)), None)


def source_files(spark: SparkSession, root: str, language: str) -> DataFrame:
    """file (relative to the root) and text of every file of a language, read where it lies."""
    own = LANGUAGES[language]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(own.globs) + "}").load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    rows = files.select(path.alias("file"), F.decode("content", "UTF-8").alias("text"))
    for part in own.skip:
        rows = rows.where(~F.contains(F.concat(F.lit("/"), F.col("file")), F.lit(part)))
    return rows


def declarations(files: DataFrame, language: str) -> DataFrame:
    """One row for each declaration of ``files(file, text)``, and one with an error for a file that does not parse."""
    share_package(files.sparkSession)
    own = LANGUAGES[language]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    rows += [{**d, "file": file, "error": None} for d in own.scan(text or "")]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({"file": file, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_FIELDS))

    return files.select("file", "text").mapInArrow(run, DECLARATIONS)
