"""Whole-run plans: source files to entity tables, entity tables to graph, graph to architecture."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V
from sourceloom.operators import architecture as A
from sourceloom.operators import graph_build as G
from sourceloom.operators import rollups as R
from sourceloom.operators import symbols as X
from sourceloom.operators.traverse import request_flows
from sourceloom.session import cut, stored
from sourceloom.sources.tree import collect_warnings, describe_files, scan_source_tree


@dataclass(frozen=True)
class Analysis:
    """Entity tables of one analysis run over any number of repositories.

    Symbols and files are written once each, when a table made of them is first asked for.
    """

    described: DataFrame
    scan_warnings: DataFrame

    @cached_property
    def symbols(self) -> DataFrame:
        return stored(X.extract_symbols(self.described), "symbols", ("kind",))

    @cached_property
    def files(self) -> DataFrame:
        return stored(X.with_parse_status(self.described.drop("text"), self.symbols), "files")

    @cached_property
    def folders(self) -> DataFrame:
        return R.folder_rollup(self.files)

    @cached_property
    def functions(self) -> DataFrame:
        return X.functions_of(self.symbols)

    @cached_property
    def classes(self) -> DataFrame:
        return X.classes_of(self.symbols)

    @cached_property
    def modules(self) -> DataFrame:
        return X.modules_of(self.symbols)

    @cached_property
    def imports(self) -> DataFrame:
        return X.imports_of(self.symbols)

    @cached_property
    def warnings(self) -> DataFrame:
        return collect_warnings(self.scan_warnings, X.parse_warnings(self.files))[0]

    @cached_property
    def warning_counts(self) -> DataFrame:
        return collect_warnings(self.scan_warnings, X.parse_warnings(self.files))[1]

    def languages(self) -> DataFrame:
        return R.language_stats(self.files)

    def metrics(self) -> DataFrame:
        return R.repository_metrics(self.files, self.folders, self.functions, self.classes, self.modules, self.imports)

    def summary(self) -> DataFrame:
        return R.run_summary(self.files, self.scan_warnings)

    def tables(self) -> dict[str, DataFrame]:
        return {"repository_files": self.files, "repository_folders": self.folders,
                "repository_functions": self.functions, "repository_classes": self.classes,
                "repository_modules": self.modules, "repository_imports": self.imports,
                "repository_languages": self.languages(), "repository_metrics": self.metrics()}


def analyze(raw: DataFrame, max_bytes: int = V.MAX_FILE_BYTES, parse_partitions: int | None = None) -> Analysis:
    """Scan, describe, parse and roll up a raw (repository_id, path, content BINARY) table.

    Contents are parsed once and hashed once; the entity tables are filters on what was written. Parsing and describing cost
    far more than moving the files, so ``parse_partitions`` spreads them by path first when the scan alone gives too few
    tasks for the cores at hand.
    """
    found, scan_warnings = scan_source_tree(raw)
    if parse_partitions:
        found = found.repartition(parse_partitions, "repository_id", "path")
    return Analysis(describe_files(found, max_bytes), scan_warnings)


class Graph:
    """Nodes (keyed by repository and entity key) and typed edges of a dependency build.

    Each is a table, or a function that writes it when it is first asked for.
    """

    def __init__(self, nodes: DataFrame | Callable[[], DataFrame], edges: DataFrame | Callable[[], DataFrame]):
        self._nodes, self._edges = nodes, edges

    @cached_property
    def nodes(self) -> DataFrame:
        return self._nodes if isinstance(self._nodes, DataFrame) else self._nodes()

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges if isinstance(self._edges, DataFrame) else self._edges()


def build_graph(run: Analysis, calls: DataFrame | None = None, resolve_relative: bool = False) -> Graph:
    """The dependency graph of every repository of a run. Node ids are repository-qualified keys."""
    qualified = lambda c: F.concat_ws("/", "repository_id", c)

    def entities() -> tuple[DataFrame, ...]:
        return run.files, run.modules, run.classes, run.functions, run.imports

    def nodes() -> DataFrame:
        return stored(G.build_nodes(*entities()), "nodes").withColumn("node_id", qualified("entity_key"))

    def edges() -> DataFrame:
        built = G.build_edges(graph.nodes, *entities(), calls=calls, resolve_relative=resolve_relative, own_nodes=True)
        return stored(built.withColumn("src", qualified("src")).withColumn("dst", qualified("dst")), "edges", ("relationship_type",))

    graph = Graph(nodes, edges)
    return graph


@dataclass(frozen=True)
class Architecture:
    frameworks: DataFrame
    components: DataFrame
    flows: DataFrame
    metrics: DataFrame
    anti_patterns: DataFrame
    health: DataFrame


def infer_architecture(graph: Graph) -> Architecture:
    """Components, flows, metrics, findings and health of every repository of a graph."""
    frameworks = A.detect_frameworks(graph.nodes)
    components = cut(A.detect_components(graph.nodes, frameworks))
    metrics = cut(A.layer_metrics(components, graph.edges))
    findings = cut(A.anti_patterns(components, graph.edges, metrics))
    return Architecture(frameworks, components, request_flows(components, graph.edges), metrics, findings,
                        A.architecture_health(metrics, findings))
