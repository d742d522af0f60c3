"""What needs Python's own parser, sequence matcher or interpreter: Arrow UDFs, one call for all columns of a stage.

Inputs that are null give null, so that a stage sends only the rows that are still in question.
"""

from __future__ import annotations

import ast
import difflib
import os
import resource
import signal
import subprocess
import sys
import tempfile
import warnings

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.shipping import ship

PARTS = "name string, skeleton string, completion string"
_HEADS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _tree(source: str) -> ast.Module | None:
    """None if it does not parse, whatever the reason (depth and NUL bytes too)."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None


def _rows(source: str, node: ast.AST, last: ast.AST | None = None) -> str:
    return "\n".join(source.splitlines()[node.lineno - 1 : (last or node).end_lineno])


def _own_text(source: str) -> str | None:
    """The lines of the first top-level function, without decorators."""
    tree = _tree(source)
    found = next((n for n in tree.body if isinstance(n, _HEADS)), None) if tree else None
    return _rows(source, found) if found else None


def function_text(source: str | None) -> str | None:
    """The first top-level function, if it stands alone."""
    got = (_own_text(source) or "").strip() if source is not None else ""
    return got if got.startswith(("def ", "async def ")) and _tree(got) else None


def split_function(source: str | None) -> tuple[str, str, str] | None:
    """Name, header line with docstring, and the body after it, of the first top-level function."""
    got = _own_text(source) if source is not None else None
    got = got.rstrip() if got else None
    tree = _tree(got) if got else None
    if not tree or not tree.body or not isinstance(fn := tree.body[0], _HEADS):
        return None
    body, skeleton = fn.body, got.splitlines()[0] + "\n"
    if ast.get_docstring(fn, clean=False):
        skeleton += _rows(got, body[0]).rstrip() + "\n"
        body = body[1:]
    completion = _rows(got, body[0], body[-1]).rstrip() if body else ""
    return (fn.name, skeleton, completion + "\n") if completion else None


def parses(source: str | None) -> bool | None:
    return None if source is None else _tree(source) is not None


def similarity(a: str | None, b: str | None) -> float | None:
    """Of the matched blocks, in this order of arguments (the measure is not symmetric)."""
    return None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio()




def passes(script: str | None, seconds: float = 8.0, memory_mb: int = 1024) -> bool | None:
    """Whether the script ends by itself with code 0: an isolated interpreter in an empty folder, its own group, limits.

    The script is untrusted. Limits hold CPU, memory and file size; they are no sandbox against the network.
    """
    if script is None:
        return None

    def limits():
        resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1, int(seconds) + 1))
        resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))
        resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 20, 1 << 20))

    with tempfile.TemporaryDirectory() as at:
        path = os.path.join(at, "script.py")
        with open(path, "w", encoding="utf-8", errors="replace") as f:
            f.write(script)
        p = subprocess.Popen([sys.executable, "-I", path], cwd=at, env={}, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True, preexec_fn=limits)
        try:
            return p.wait(timeout=seconds) == 0
        except subprocess.TimeoutExpired:
            return False
        finally:
            try:
                os.killpg(p.pid, signal.SIGKILL)
            except OSError:
                pass
            p.wait()


def _call(kind: str, f, *cols: Column) -> Column:
    ship(SparkSession.getActiveSession())
    return F.pandas_udf(f, kind)(*cols)


def parse_ok(*sources: Column) -> Column:
    """Array of booleans, one for each source, in one pass."""

    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([[parses(x) for x in row] for row in zip(*cols, strict=True)])

    return _call("array<boolean>", run, *sources)


def first_function(*sources: Column) -> Column:
    """Array of texts, null where there is none."""

    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([[function_text(x) for x in row] for row in zip(*cols, strict=True)])

    return _call("array<string>", run, *sources)


def function_parts(*sources: Column) -> Column:
    """Array of (name, skeleton, completion), null where there is none."""

    def run(*cols: pd.Series) -> pd.Series:
        found = [[split_function(x) for x in row] for row in zip(*cols, strict=True)]
        return pd.Series([[p and dict(zip(("name", "skeleton", "completion"), p, strict=True)) for p in row] for row in found])

    return _call(f"array<struct<{PARTS.replace(' string', ':string')}>>", run, *sources)


def sequence_ratio(a: Column, b: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return _call("double", run, a, b)


def passes_check(script: Column, seconds: float = 8.0) -> Column:
    """Runs untrusted code; callers ask for it, no registered query does but on fixtures of this package."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([passes(x, seconds) for x in s], dtype="object")

    return _call("boolean", run, script)
