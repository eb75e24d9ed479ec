"""Symbols and imports of source texts, as table functions and expressions."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Definitions by file ending: (class pattern, function pattern).
TEXTUAL = {
    "py": (r"(?m)^\s*class\s+(\w+)", r"(?m)^\s*(?:async\s+)?def\s+(\w+)"),
    "ts": (r"(?m)\b(?:class|interface)\s+(\w+)", r"(?m)\bfunction\s+(\w+)|(?m)\bconst\s+(\w+)\s*=\s*(?:async\s*)?\("),
    "js": (r"(?m)\bclass\s+(\w+)", r"(?m)\bfunction\s+(\w+)"),
    "go": (r"(?m)^type\s+(\w+)\s+(?:struct|interface)", r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    "java": (r"(?m)\b(?:class|interface|enum)\s+(\w+)", r"(?m)\b(?:public|private|protected|static)\s+[\w<>\[\], ]+\s+(\w+)\s*\("),
    "sh": (r"(?!)", r"(?m)^\s*(?:function\s+)?(\w+)\s*\(\)"),
}


def python_symbols(code: str | None) -> list[tuple[str, str, int, int]]:
    """F-18, F-27: (kind, name, first line, last line) at any depth, in order; none if it does not parse."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function"}
    found = [(kinds[type(n)], n.name, n.lineno, n.end_lineno) for n in ast.walk(tree) if type(n) in kinds]
    return sorted(found, key=lambda x: (x[2], -x[3]))


@F.udtf(returnType=T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
class PythonSymbols:
    """X-5: rows of ``python_symbols``."""

    def eval(self, code: str):
        yield from python_symbols(code)


@F.udtf(returnType=T.StructType([T.StructField("module", T.StringType()), T.StructField("candidate", T.StringType())]))
class ImportTargets:
    """F-28: repository files an absolute import may mean, under each prefix."""

    def eval(self, code: str, prefixes: list):
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError, RecursionError):
            return
        names: list[str] = []
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                names += [a.name for a in n.names]
            elif isinstance(n, ast.ImportFrom) and not n.level and n.module:
                names += [n.module, *(f"{n.module}.{a.name}" for a in n.names)]
        for name in dict.fromkeys(names):
            for p in prefixes or [""]:
                base = f"{p}{name.replace('.', '/')}"
                yield name, f"{base}.py"
                yield name, f"{base}/__init__.py"


def textual_symbols(path: Column, text: Column) -> Column:
    """F-19: (classes, functions) by the file's ending; the file's stem where nothing is found."""
    ext = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    stem = F.array(F.regexp_extract(path, r"([^/]+?)(?:\.\w+)?$", 1))

    def of(i: int) -> Column:
        out = F.array().cast("array<string>")
        for e, patterns in TEXTUAL.items():
            found = F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(patterns[i]), F.lit(1)), lambda x: x.isNotNull() & (x != "")))
            out = F.when(ext == e, found).otherwise(out)
        return out

    classes, functions = of(0), of(1)
    none = (F.size(classes) == 0) & (F.size(functions) == 0)
    return F.struct(classes.alias("classes"), F.when(none, stem).otherwise(functions).alias("functions"))


def index_line(path: Column, classes: Column, functions: Column, most_classes: int = 5, most_functions: int = 8) -> Column:
    """F-20: a file of the symbol index as prompt text."""
    part = lambda name, a, n: F.when(F.size(a) > 0, F.concat(F.lit(f"  {name}: "), F.array_join(F.slice(a, 1, n), ", ")))
    return F.concat_ws("\n", path, part("classes", classes, most_classes), part("functions", functions, most_functions))
