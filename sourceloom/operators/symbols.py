"""Symbol extraction: one Arrow stage parses Python files, Spark splits and shapes the result."""

from __future__ import annotations

import ast
import gc
import inspect
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import scalars as S

SYMBOL_SCHEMA = """
    repository_id string, path string, kind string, name string, class_path array<string>,
    start_line int, end_line int, is_async boolean, return_type string, docstring string,
    bases array<string>, decorators array<string>,
    parameters array<struct<name:string,type:string,default:string,kind:string>>,
    module string, imported_name string, alias string, level int, error string
"""
#: Symbols of one kind that leave Python at once.
BATCH_ROWS = 500

_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_ARROW = pa.schema([
    ("repository_id", _TEXT), ("path", _TEXT), ("kind", _TEXT), ("name", _TEXT), ("class_path", _TEXTS),
    ("start_line", pa.int32()), ("end_line", pa.int32()), ("is_async", pa.bool_()), ("return_type", _TEXT),
    ("docstring", _TEXT), ("bases", _TEXTS), ("decorators", _TEXTS),
    ("parameters", pa.list_(pa.struct([("name", _TEXT), ("type", _TEXT), ("default", _TEXT), ("kind", _TEXT)]))),
    ("module", _TEXT), ("imported_name", _TEXT), ("alias", _TEXT), ("level", pa.int32()), ("error", _TEXT)])


#: What each kind of row holds; its other columns are null.
_COLUMNS = {
    "module": ("docstring",),
    "class": ("name", "class_path", "start_line", "end_line", "bases", "decorators", "docstring"),
    "function": ("name", "class_path", "start_line", "end_line", "is_async", "decorators", "parameters", "return_type", "docstring"),
    "import": ("module", "imported_name", "alias", "level", "start_line"),
    "error": ("error",)}
#: Where statements, handlers and cases lie below a node. Expressions hold no statements, so they are never entered.
_BLOCKS = {node: fields for node in (*ast.stmt.__subclasses__(), ast.ExceptHandler, ast.match_case)
           if (fields := tuple(f for f in ("body", "handlers", "orelse", "finalbody", "cases") if f in node._fields))}


def _plain(node) -> str | None:
    """``ast.unparse`` of names, dotted names, simple constants and subscripts of them; None for anything else."""
    kind = type(node)
    if kind is ast.Name:
        return node.id
    if kind is ast.Attribute and type(node.value) in (ast.Name, ast.Attribute):
        owner = _plain(node.value)
        return None if owner is None else f"{owner}.{node.attr}"
    if kind is ast.Constant and node.kind is None and (node.value is None or isinstance(node.value, (str, int))):
        return repr(node.value)
    if kind is ast.Subscript and type(node.value) in (ast.Name, ast.Attribute) and type(node.slice) in (
            ast.Name, ast.Attribute, ast.Constant, ast.Subscript):
        owner, inner = _plain(node.value), _plain(node.slice)
        return None if owner is None or inner is None else f"{owner}[{inner}]"
    return None


def _source(expression) -> str | None:
    if expression is None:
        return None
    plain = _plain(expression)
    return ast.unparse(expression) if plain is None else plain


def _docstring(node) -> str | None:
    """``ast.get_docstring``, without its search for a margin where there is one line."""
    text = ast.get_docstring(node, clean=False)
    if text is None or "\n" in text:
        return text and inspect.cleandoc(text)
    return text.expandtabs().lstrip(" ")


def _parameters(signature: ast.arguments) -> list[tuple]:
    """Name, type, default and kind of the parameters in call order; defaults belong to the last positional ones."""
    positional = [*signature.posonlyargs, *signature.args]
    first_default = len(positional) - len(signature.defaults)
    described = [(arg, signature.defaults[i - first_default] if i >= first_default else None, "positional")
                 for i, arg in enumerate(positional)]
    described += [(signature.vararg, None, "vararg")]
    described += [(arg, default, "keyword_only") for arg, default in zip(signature.kwonlyargs, signature.kw_defaults)]
    described += [(signature.kwarg, None, "kwarg")]
    return [(arg.arg, _source(arg.annotation), _source(default), kind) for arg, default, kind in described if arg is not None]


def _symbols(text: str, path: str) -> Iterator[tuple]:
    """Kind and values, in the order of ``_COLUMNS``, of everything a text holds."""
    tree = ast.parse(text, filename=path, type_comments=True)
    yield "module", (_docstring(tree),)
    pending: list[tuple[list[ast.AST], list[str]]] = [(tree.body, [])]
    while pending:
        nodes, owners = pending.pop()
        for node in nodes:
            kind, inner = type(node), owners
            if kind is ast.ClassDef:
                yield "class", (node.name, owners, node.lineno, node.end_lineno, [_source(b) for b in node.bases],
                                [_source(d) for d in node.decorator_list], _docstring(node))
                inner = [*owners, node.name]
            elif kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
                yield "function", (node.name, owners, node.lineno, node.end_lineno, kind is ast.AsyncFunctionDef,
                                   [_source(d) for d in node.decorator_list], _parameters(node.args), _source(node.returns),
                                   _docstring(node))
            elif kind is ast.Import:
                yield from (("import", (n.name, None, n.asname, 0, node.lineno)) for n in node.names)
            elif kind is ast.ImportFrom:
                yield from (("import", (node.module or "", n.name, n.asname, node.level, node.lineno)) for n in node.names)
            pending.extend((getattr(node, field), inner) for field in _BLOCKS.get(kind, ()))


def _structs(lists: Sequence[list[tuple]], kind: pa.ListType) -> pa.ListArray:
    """Lists of tuples as a column of lists of structs."""
    flat = [one for many in lists for one in many]
    fields = list(kind.value_type)
    columns = zip(*flat) if flat else [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(column, field.type) for column, field in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, lists))], pa.int32()), values)


def _batch(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (repository, path, values) of one kind. Columns that the kind lacks are made null without going through its rows."""
    held = dict(zip(("repository_id", "path", *_COLUMNS[kind]), zip(*((repository, path, *values) for repository, path, values in rows))))
    return pa.RecordBatch.from_arrays(
        [pa.repeat(kind, len(rows)) if field.name == "kind" else
         pa.nulls(len(rows), field.type) if field.name not in held else
         _structs(held[field.name], field.type) if field.name == "parameters" else
         pa.array(held[field.name], field.type) for field in _ARROW], schema=_ARROW)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols of every row with a text. A file that fails yields only its error row; output batches stay small and hold one kind."""
    rows: dict[str, list[tuple]] = {kind: [] for kind in _COLUMNS}
    for batch in batches:
        for repository, path, text in zip(*(batch.column(c).to_pylist() for c in ("repository_id", "path", "text"))):
            if text is None:
                continue
            collecting = gc.isenabled()
            gc.disable()  # syntax trees hold no cycles, and are freed as soon as their file is done
            try:
                found = list(_symbols(text, path))
            except Exception as problem:  # one broken file must never fail the job
                found = [("error", (str(problem) or type(problem).__name__,))]
            finally:
                if collecting:
                    gc.enable()
            for kind, values in found:
                rows[kind].append((repository, path, values))
            for kind in {kind for kind, _ in found}:
                if len(rows[kind]) >= BATCH_ROWS:
                    yield _batch(kind, rows[kind])
                    rows[kind] = []
    for kind, left in rows.items():
        if left:
            yield _batch(kind, left)


def extract_symbols(files: DataFrame) -> DataFrame:
    """Tagged symbol rows of all decoded Python files of ``describe_files`` output.

    Other files go along without their text and are passed over there: a filter on language and text would be moved below
    every projection and shuffle of ``files``, and make each file's text and language several times over.
    """
    text = F.when(F.col("language") == "Python", F.col("text")).alias("text")
    return files.select("repository_id", "path", text).mapInArrow(_parse_batches, SYMBOL_SCHEMA)


def _module() -> Column:
    return S.module_name(F.col("path"))


def _joined() -> Column:
    return F.when(F.size("class_path") > 0, F.array_join("class_path", "."))


def functions_of(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'function'").select(
        "repository_id", F.col("path").alias("file_path"), _module().alias("module"),
        F.try_element_at("class_path", F.lit(-1)).alias("class_name"), "class_path", "name",
        S.qualified_name(_module(), _joined(), F.col("name")).alias("qualified_name"),
        "start_line", "end_line", S.visibility(F.col("name")).alias("visibility"), "is_async",
        "decorators", "parameters", "return_type", "docstring")


def classes_of(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'class'").select(
        "repository_id", F.col("path").alias("file_path"), _module().alias("module"), "name",
        S.qualified_name(_module(), _joined(), F.col("name")).alias("qualified_name"),
        "start_line", "end_line", S.visibility(F.col("name")).alias("visibility"),
        "bases", "decorators", "docstring")


def imports_of(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'import'").select(
        "repository_id", F.col("path").alias("file_path"), "module", "imported_name", "alias", "level",
        F.col("start_line").alias("line_number"))


def modules_of(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'module'").select(
        "repository_id", F.col("path").alias("file_path"), _module().alias("name"),
        S.parent_package(_module()).alias("package"),
        (S.file_name(F.col("path")) == "__init__.py").alias("is_package"), "docstring")


def parameters_of(functions: DataFrame) -> DataFrame:
    """One row per parameter with its position."""
    return functions.select("repository_id", "file_path", "qualified_name",
                            F.posexplode("parameters").alias("position", "p")).select(
        "repository_id", "file_path", "qualified_name", "position", "p.*")


def with_parse_status(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with final parse status: parsed, failed, skipped or not_applicable."""
    outcome = symbols.where("kind in ('module', 'error')").select(
        "repository_id", "path", F.when(F.col("kind") == "module", "parsed").otherwise("failed").alias("_status"),
        F.col("error").alias("_error"))
    joined = files.join(outcome, ["repository_id", "path"], "left")
    return (joined.withColumn("parse_status", F.coalesce("_status", "parse_status"))
            .withColumn("parse_error", F.coalesce("_error", "parse_error")).drop("_status", "_error"))


def parse_warnings(files: DataFrame) -> DataFrame:
    """Warning rows of files that failed to parse or could not be decoded."""
    code = F.when(F.col("parse_status") == "failed", "parse_error").otherwise("file_skipped")
    return files.where("parse_status in ('failed', 'skipped')").select(
        "repository_id", "path", code.alias("code"), F.col("parse_error").alias("message"))
