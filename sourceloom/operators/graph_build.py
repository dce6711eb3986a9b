"""Entities to typed property graph: node and edge derivation as joins and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V
from sourceloom.functions import scalars as S
from sourceloom.functions.ranking import distinct_of_repeated, first_of_repeated
from sourceloom.session import small_side, stored_observed

REPO = "repository_id"
EDGE_COLUMNS = (REPO, "src", "dst", "relationship_type", "line")
NODE_COLUMNS = ("entity_type", "name", "label", "file_path", "module", "package", "language",
                "internal", "is_package", "is_async")


def key(kind: str, natural: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(natural) if isinstance(natural, str) else natural)


def module_package() -> Column:
    return F.coalesce("package", S.top_package(F.col("name")))


def _node(table: DataFrame, priority: int, kind: str, entity_key: Column, **values) -> DataFrame:
    empty = {"file_path": "string", "module": "string", "package": "string", "language": "string",
             "internal": "boolean", "is_package": "boolean", "is_async": "boolean"}
    columns = [values[c].alias(c) if c in values else F.lit(None).cast(t).alias(c) for c, t in empty.items()]
    order = values.get("order", F.lit(0))
    return table.select(REPO, entity_key.alias("entity_key"), F.lit(kind).alias("entity_type"),
                        values["name"].alias("name"), values["label"].alias("label"), *columns,
                        F.lit(priority).alias("_priority"), order.cast("long").alias("_order"))


def build_nodes(files: DataFrame, modules: DataFrame, classes: DataFrame, functions: DataFrame,
                imports: DataFrame) -> DataFrame:
    """Nodes of every repository; the first writer of a key wins (kind order, then path, line)."""
    c = F.col
    external = external_packages(imports, modules)
    parts = [
        _node(files.select(REPO).distinct(), 0, "repository", key("repository", REPO), name=c(REPO),
              label=F.lit("Repository")),
        _node(files, 1, "file", key("file", "path"), name=c("name"), label=c("path"), file_path=c("path"),
              language=c("language")),
        _node(modules.select(REPO, module_package().alias("package")).distinct(), 2, "package",
              key("package", "package"), name=c("package"), label=c("package"), package=c("package"),
              internal=F.lit(True)),
        _node(modules, 3, "module", key("module", "name"), name=c("name"), label=c("name"),
              file_path=c("file_path"), module=c("name"), package=module_package(), is_package=c("is_package")),
        _node(classes, 4, "class", key("class", "qualified_name"), name=c("name"), label=c("qualified_name"),
              file_path=c("file_path"), module=c("module"), order=c("start_line")),
        _node(functions, 5, "function", key("function", "qualified_name"), name=c("name"),
              label=c("qualified_name"), file_path=c("file_path"), module=c("module"), is_async=c("is_async"),
              order=c("start_line")),
        _node(external, 6, "package", key("package", "package"), name=c("package"), label=c("package"),
              package=c("package"), internal=F.lit(False)),
    ]
    everything = reduce(DataFrame.unionByName, parts)
    order = F.struct("_priority", F.coalesce("file_path", F.lit("")).alias("p"), "_order")
    return first_of_repeated(everything, [REPO, "entity_key"], order, NODE_COLUMNS)


def external_packages(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Top packages of imports that no module name of the repository starts with.

    A top package has no dot, so "some module starts with it" means it is a leading substring of a
    module's first segment: distinct segments are expanded and matched by equality.
    """
    tops = imports.select(REPO, S.top_package(F.col("module")).alias("package")).distinct()
    heads = modules.select(REPO, F.substring_index("name", ".", 1).alias("head")).distinct()
    taken = heads.select(REPO, F.explode(S.text_prefixes(F.col("head"))).alias("package")).distinct()
    return tops.join(taken, [REPO, "package"], "left_anti")


def _edge(table: DataFrame, src: Column, dst: Column, relationship: str, line: Column | None = None) -> DataFrame:
    return table.select(REPO, src.alias("src"), dst.alias("dst"), F.lit(relationship).alias("relationship_type"),
                        (F.lit(None).cast("int") if line is None else line).alias("line"))


def _link(edges: DataFrame, inverse: str | Column | None) -> DataFrame:
    """``edges`` with the type ``inverse`` of their swapped rows; null where there are none."""
    return edges.withColumn("inverse", F.lit(inverse).cast("string") if inverse is None or isinstance(inverse, str) else inverse)


def both_ways(links: DataFrame) -> DataFrame:
    """Linked edges plus their swapped rows of type ``inverse``."""
    pair = F.array(F.struct("src", "dst", "relationship_type"),
                   F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("inverse").alias("relationship_type")))
    more = [c for c in links.columns if c not in (REPO, "src", "dst", "relationship_type", "inverse")]
    return links.select(REPO, F.explode(pair).alias("e"), *more).where("e.relationship_type is not null").select(REPO, "e.*", *more)


def _containment_links(files: DataFrame, modules: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    c = F.col
    owner = F.when(F.size("class_path") > 0, key("class", F.concat_ws(".", "module", F.array_join("class_path", "."))))
    nested = [
        _edge(modules, key("file", "file_path"), key("module", "name"), "contains"),
        _edge(modules, key("package", module_package()), key("module", "name"), "contains"),
        _edge(classes, key("module", "module"), key("class", "qualified_name"), "contains"),
        _edge(functions, F.coalesce(owner, key("module", "module")), key("function", "qualified_name"), "contains"),
    ]
    in_folder = _link(_edge(files.where(c("folder_path") != ""), key("repository", REPO), key("file", "path"), "contains"), "belongs_to")
    at_root = _link(_edge(files.where((c("folder_path") == "") | c("folder_path").isNull()), key("repository", REPO), key("file", "path"), "contains"), None)
    return _link(reduce(DataFrame.unionByName, nested), "belongs_to").unionByName(in_folder).unionByName(at_root)


def containment_edges(files: DataFrame, modules: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """contains / belongs_to between repository, file, package, module, class and function."""
    return both_ways(_containment_links(files, modules, classes, functions)).select(*EDGE_COLUMNS)


def _by_class_name(mentions: DataFrame, classes: DataFrame) -> DataFrame:
    """Join mentioned simple names to all classes of that name in the repository."""
    targets = classes.select(REPO, F.col("name").alias("mention"), key("class", "qualified_name").alias("dst")).distinct()
    return mentions.where("mention <> ''").distinct().join(targets, [REPO, "mention"]).select(
        REPO, "src", "dst", F.lit(None).cast("int").alias("line"))


def inherits_edges(classes: DataFrame) -> DataFrame:
    mentions = classes.select(REPO, key("class", "qualified_name").alias("src"), F.explode("bases").alias("base"))
    mentions = mentions.select(REPO, "src", F.substring_index(F.substring_index("base", "[", 1), ".", -1).alias("mention"))
    return _by_class_name(mentions, classes).withColumn("relationship_type", F.lit("inherits")).select(*EDGE_COLUMNS)


def _uses_links(functions: DataFrame, classes: DataFrame) -> DataFrame:
    hints = F.array_union(F.array("return_type"), F.transform("parameters", lambda p: p["type"]))
    mentions = (functions.select(REPO, key("function", "qualified_name").alias("src"), F.explode(hints).alias("hint"))
                .where("hint is not null")
                .select(REPO, "src", S.simple_type_name(F.col("hint")).alias("mention")))
    return _link(_by_class_name(mentions, classes).withColumn("relationship_type", F.lit("uses")).select(*EDGE_COLUMNS), "used_by")


def uses_edges(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """uses from return and parameter hints, with the inverse used_by."""
    return both_ways(_uses_links(functions, classes)).select(*EDGE_COLUMNS)


def decorates_edges(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """Decorated symbol to the package named by the head of the decorator (validated later)."""
    marked = (classes.select(REPO, key("class", "qualified_name").alias("src"), F.explode("decorators").alias("d"))
              .unionByName(functions.select(REPO, key("function", "qualified_name").alias("src"),
                                            F.explode("decorators").alias("d"))))
    return _edge(marked, F.col("src"), key("package", F.substring_index("d", ".", 1)), "decorates")


def resolve_imports(imports: DataFrame, modules: DataFrame, resolve_relative: bool = False) -> DataFrame:
    """Imports with the module and file they resolve to (null when external).

    Exact module first, else the longest dotted prefix that is a module. Resolution runs once per
    distinct imported text, then joins back to the import rows. With ``resolve_relative`` the
    import level is applied to the importing file's package before matching.
    """
    # largest texts are found in sorted rows: most keys come once, so they are dealt out first and sorted once, as the joins need them
    named = modules.select(REPO, F.col("name").alias("candidate"), "file_path").repartition(REPO, "candidate")
    files = named.groupBy(REPO, "candidate").agg(F.max("file_path").alias("target_file"))
    imports = imports.withColumn("_text", _absolute_text() if resolve_relative else F.col("module"))
    texts = imports.select(REPO, "_text").where("_text <> ''").distinct()
    expanded = texts.select(REPO, "_text", F.explode(S.dotted_prefixes(F.col("_text"))).alias("candidate"))
    best = (expanded.join(files, [REPO, "candidate"]).repartition(REPO, "_text").groupBy(REPO, "_text").agg(
        F.max_by(F.struct(F.col("candidate").alias("target_module"), "target_file"), F.length("candidate")).alias("_t"))
        .select(REPO, "_text", "_t.*"))
    return imports.join(best, [REPO, "_text"], "left").drop("_text")


def _absolute_text() -> Column:
    folders = F.split(S.folder_path(F.col("file_path")), "/")
    kept = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - F.col("level") + 1, F.lit(0)))
    tail = F.when(F.col("module") != "", F.col("module"))
    relative = F.concat_ws(".", F.nullif(F.array_join(kept, "."), F.lit("")), tail)
    return F.when(F.col("level") > 0, relative).otherwise(F.col("module"))


def _imports_links(imports: DataFrame, modules: DataFrame, resolve_relative: bool) -> DataFrame:
    owner = modules.select(REPO, "file_path", F.col("name").alias("source_module"))
    rows = resolve_imports(imports, modules, resolve_relative).join(owner, [REPO, "file_path"], "left")
    package = key("package", F.substring_index("module", ".", 1))
    resolved = F.col("target_module").isNotNull()
    links = F.array(
        F.struct(key("file", "file_path").alias("src"),
                 F.when(resolved, key("file", "target_file")).otherwise(package).alias("dst")),
        F.struct(key("module", "source_module").alias("src"),
                 F.when(resolved, key("module", "target_module")).otherwise(package).alias("dst")))
    exploded = rows.select(REPO, F.explode(links).alias("l"), F.col("line_number").alias("line")).select(REPO, "l.*", "line")
    known = exploded.where("src is not null and dst is not null").withColumn("relationship_type", F.lit("imports"))
    return _link(known.select(*EDGE_COLUMNS), "imported_by")


def imports_edges(imports: DataFrame, modules: DataFrame, resolve_relative: bool = False) -> DataFrame:
    """imports / imported_by between files and between modules, or to the top package."""
    return both_ways(_imports_links(imports, modules, resolve_relative)).select(*EDGE_COLUMNS)


def _call_links(calls: DataFrame) -> DataFrame:
    line = F.col("line") if "line" in calls.columns else F.lit(None).cast("int")
    return _link(_edge(calls, F.col("src"), F.col("dst"), "calls", line), "called_by")


def call_edges(calls: DataFrame) -> DataFrame:
    """calls / called_by from a supplied table (repository_id, src, dst[, line])."""
    return both_ways(_call_links(calls)).select(*EDGE_COLUMNS)


def inverse_edges(edges: DataFrame) -> DataFrame:
    """Swapped rows for the relationship types that have an inverse."""
    inverse = F.try_element_at(S.literal_map(V.INVERSE_RELATIONSHIPS), F.col("relationship_type"))
    return edges.withColumn("_i", inverse).where("_i is not null").select(
        REPO, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("_i").alias("relationship_type"),
        *[c for c in edges.columns if c not in (REPO, "src", "dst", "relationship_type")])


def _between_nodes(edges: DataFrame, nodes: DataFrame, id_column: str) -> DataFrame:
    known = nodes.select(REPO, F.col(id_column).alias("_id"))
    kept = edges.where(F.col("src") != F.col("dst"))
    for end in ("src", "dst"):
        kept = kept.join(known.withColumnRenamed("_id", end), [REPO, end], "left_semi")
    return kept.select(*edges.columns)


def valid_edges(edges: DataFrame, nodes: DataFrame, id_column: str = "entity_key") -> DataFrame:
    """Supported type, no self loop, both endpoints present in the repository."""
    return _between_nodes(edges.where(F.col("relationship_type").isin(*V.BUILD_RELATIONSHIPS)), nodes, id_column)


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One row per (source, target, type) with its sorted import lines (bounded by one file's lines)."""
    more = [c for c in edges.columns if c not in EDGE_COLUMNS]
    return edges.groupBy(REPO, "src", "dst", "relationship_type", *more).agg(
        F.array_sort(F.collect_set("line")).alias("lines"))


def with_edge_types(edges: DataFrame) -> DataFrame:
    """Endpoint types are the prefix of the entity keys, so no join is needed."""
    return (edges.withColumn("source_type", F.substring_index("src", ":", 1))
            .withColumn("target_type", F.substring_index("dst", ":", 1))
            .withColumn("depth", F.lit(1)).withColumn("weight", F.lit(1.0)))


def _to_known_packages(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``links`` without those to a package that is no node; other ends are taken as they are."""
    packages = nodes.where("entity_type = 'package'").select(REPO, F.col("entity_key").alias("dst")).distinct()
    packages, measured = stored_observed(packages, "packages", rows=F.count(F.lit(1)))
    marked = links.join(small_side(packages.withColumn("_known", F.lit(True)), measured["rows"]), [REPO, "dst"], "left")
    return marked.where(~F.col("dst").startswith("package:") | F.col("_known")).select(*links.columns)


def build_edges(nodes: DataFrame, files: DataFrame, modules: DataFrame, classes: DataFrame, functions: DataFrame,
                imports: DataFrame, calls: DataFrame | None = None, resolve_relative: bool = False, own_nodes: bool = False) -> DataFrame:
    """All typed edges of every repository, validated against ``nodes`` and deduplicated.

    An edge and its inverse are equally valid and equally often repeated, so one of the two goes through the joins. Types
    differ between the parts, so those without lines need no collecting.

    ``own_nodes`` says that ``nodes`` are ``build_nodes`` of the same tables of one run: files, modules, classes, functions and the
    packages of modules are nodes then, and only what texts or calls name is looked up: packages imported or decorating, and ends of calls.
    """
    none = F.array().cast("array<int>")
    contained, named = _containment_links(files, modules, classes, functions), _link(decorates_edges(classes, functions), None)
    matched = _link(inherits_edges(classes), None).unionByName(_uses_links(functions, classes))
    imported = _imports_links(imports, modules, resolve_relative)
    called = [] if calls is None else [_call_links(calls)]
    if own_nodes:
        plain = distinct_of_repeated(contained.unionByName(_to_known_packages(named, nodes)).drop("line"))
        plain = plain.unionByName(matched.drop("line").distinct()).withColumn("lines", none)
        unique = plain.unionByName(dedupe_edges(_to_known_packages(imported, nodes)))
        unique = unique.where(F.col(REPO).isNotNull() & (F.col("src") != F.col("dst")))
        if called:
            unique = unique.unionByName(_between_nodes(dedupe_edges(called[0]), nodes, "entity_key"))
    else:
        bare = contained.unionByName(matched).unionByName(named)
        unique = _between_nodes(bare.drop("line").distinct().withColumn("lines", none).unionByName(
            dedupe_edges(reduce(DataFrame.unionByName, [imported, *called]))), nodes, "entity_key")
    return with_edge_types(both_ways(unique).where(F.col("relationship_type").isin(*V.BUILD_RELATIONSHIPS)))


def flatten_metadata(nodes: DataFrame, metadata: str = "metadata_json") -> DataFrame:
    """Typed columns from the metadata JSON with defaults; missing locations become empty text."""
    parsed = F.from_json(F.coalesce(F.col(metadata), F.lit("{}")),
                         "language string, is_async boolean, is_package boolean, internal boolean")
    return (nodes.withColumn("_m", parsed)
            .withColumn("graph_label", S.entity_label(F.col("entity_type")))
            .withColumn("language", F.coalesce("_m.language", F.lit("")))
            .withColumn("is_async", F.coalesce("_m.is_async", F.lit(False)))
            .withColumn("is_package", F.coalesce("_m.is_package", F.lit(False)))
            .withColumn("internal", F.coalesce("_m.internal", F.lit(True)))
            .withColumns({c: F.coalesce(c, F.lit("")) for c in ("file_path", "module", "package")})
            .drop("_m"))


def flatten_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by entity key instead of node id; edges without both keys drop out."""
    ids = nodes.select("node_id", "entity_key")
    return (edges
            .join(ids.select(F.col("node_id").alias("src"), F.col("entity_key").alias("source_key")), "src")
            .join(ids.select(F.col("node_id").alias("dst"), F.col("entity_key").alias("target_key")), "dst")
            .withColumn("edge_type", S.edge_type(F.col("relationship_type"))))


def filter_graph(nodes: DataFrame, edges: DataFrame, node_filter: Column | None = None,
                 edge_filter: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes passing the filter; edges passing theirs whose both ends were kept."""
    kept = nodes if node_filter is None else nodes.where(node_filter)
    links = edges if edge_filter is None else edges.where(edge_filter)
    ids = kept.select("node_id")
    for end in ("src", "dst"):
        links = links.join(ids.withColumnRenamed("node_id", end), end, "left_semi")
    return kept, links.select(*edges.columns)
