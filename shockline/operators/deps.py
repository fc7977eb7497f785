"""Dependency facts from reference sites.

ref_sites(repo, file, seq, line, scope_symbol, scope_class, scope_parent, kind, name,
receiver_kind, receiver_name, type_names ARRAY<STRING>) and
bindings(repo, file, scope_symbol, seq, var, type); seq is the place in preorder.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edge type by the kind of a site that names types.
TYPE_KINDS = {
    "extends": "extends",
    "implements": "implements",
    "trait_use": "trait_use",
    "property": "property_type",
    "parameter": "parameter_type",
    "return": "return_type",
}


#: Bindings of a variable that one row holds.
HELD = 1024


def as_of_types(sites: DataFrame, bindings: DataFrame) -> DataFrame:
    """As-of join: sites on a variable with the type of its latest typed binding earlier in the same scope.

    A variable's typed bindings are a sorted array that is searched by halving,
    so sites meet it in a hash join: shuffled once, not sorted, and those of one
    hot variable can be split.  A variable of more than HELD bindings has
    several arrays, each with the places it answers for.  Of typed bindings at
    one place the last by name counts.  Code outside of any symbol, with a null
    scope_symbol, is a scope as well; other null keys or places give a null type.
    """
    key = ["repo", "file", "scope_symbol", "var"]
    of_var = Window.partitionBy(*key)
    typed = bindings.where("type IS NOT NULL AND seq IS NOT NULL").select(*key, "seq", "type")
    parts = typed.withColumn("part", F.floor((F.row_number().over(of_var.orderBy("seq", "type")) - 1) / HELD))
    arrays = parts.groupBy(*key, "part").agg(F.sort_array(F.collect_list(F.struct("seq", "type"))).alias("held"))
    start = F.get("held", F.lit(0))["seq"]
    arrays = arrays.select(*(F.col(c).alias(f"b_{c}") for c in key), "held", start.alias("after"), F.lead(start).over(of_var.orderBy("part")).alias("until"))
    own = F.struct(*sites.columns).alias("site")
    of_sites = sites.select(own).select("site", *(F.col(f"site.{c}").alias(c) for c in ("repo", "file", "scope_symbol", "seq")), F.col("site.receiver_name").alias("var"))
    here = [F.col(c).eqNullSafe(F.col(f"b_{c}")) if c == "scope_symbol" else F.col(c) == F.col(f"b_{c}") for c in key]
    here += [F.col("seq") > F.col("after"), F.col("until").isNull() | (F.col("seq") <= F.col("until"))]
    met = of_sites.join(arrays.hint("shuffle_hash"), here, "left")
    return met.select("site.*", _last_before("held", F.col("seq")).alias("receiver_type"))


def _last_before(held: str, seq: Column) -> Column:
    """Type of the last of at most HELD sorted (seq, type) structs before seq, by halving; null where there is none."""
    steps = F.array(*(F.lit(HELD >> k) for k in range(HELD.bit_length())))
    n_before = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(held, n + step - 1)["seq"] < seq, n + step).otherwise(n))
    return F.get(held, n_before - 1)["type"]


def class_name(name: Column, own: Column, parent: Column) -> Column:
    """self and static are the enclosing class, parent its parent; null where there is none."""
    low = F.lower(name)
    return F.when(low.isin("self", "static"), own).when(low == "parent", parent).otherwise(name)


def resolve(sites: DataFrame, bindings: DataFrame, property_types: DataFrame, constructors: DataFrame) -> DataFrame:
    """repo, file, source, target, type, line per resolved site; unresolved ones are dropped.

    property_types(repo, class, prop, type): properties with one named type.
    constructors(repo, file, class): classes whose constructor the file declares.
    Calls on variables pass a window; all other sites are read once, looked up
    in one table of properties and constructors, and turned into their edges.
    """
    own, parent, here = F.col("scope_class"), F.col("scope_parent"), F.col("scope_symbol")
    on_var = (F.col("kind") == "method_call") & (F.col("receiver_kind") == "var")
    edge = lambda source, target, kind: F.struct(source.alias("source"), target.alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"))
    member = lambda of: F.when(of.isNotNull() & F.col("name").isNotNull(), F.concat(of, F.lit("::"), "name"))
    var = as_of_types(sites.where(on_var), bindings)
    calls = var.select("repo", "file", here.alias("source"), member(F.col("receiver_type")).alias("target"), F.lit("method_call").alias("type"), "line")

    class_ = class_name(F.col("receiver_name"), own, parent)
    is_prop, is_new = (F.col("kind") == "method_call") & (F.col("receiver_kind") == "prop"), F.col("kind") == "new"
    key = lambda *parts: F.concat_ws("\x1f", *parts)
    # Sites that look nothing up get keys of their own, so that no key is common to them all.
    wanted = F.when(is_prop, key(F.lit("p"), own, "receiver_name")).when(is_new, key(F.lit("c"), "file", class_)).otherwise(key(F.lit("n"), here, F.col("seq").cast("string")))
    props = property_types.select("repo", key(F.lit("p"), "class", "prop").alias("key"), F.col("type").alias("found"))
    known = props.unionByName(constructors.select("repo", key(F.lit("c"), "file", "class").alias("key"), F.lit("").alias("found")).distinct())
    rest = sites.where(~F.coalesce(on_var, F.lit(False))).withColumn("key", wanted).join(known, ["repo", "key"], "left")

    receiver = F.when(F.col("receiver_kind") == "this", own).when(F.col("receiver_kind") == "new", class_).when(F.col("receiver_kind") == "prop", F.col("found"))
    made = F.when(F.col("found").isNotNull(), F.concat(class_, F.lit("::__construct"))).otherwise(class_)
    kinds = F.create_map(*(F.lit(x) for pair in TYPE_KINDS.items() for x in pair))
    source = F.when(F.col("kind").isin("parameter", "return"), here).otherwise(own)
    parts = F.transform("type_names", lambda t: edge(source, class_name(t, own, parent), kinds[F.col("kind")]))
    promoted = F.transform("type_names", lambda t: edge(own, class_name(t, own, parent), "property_type"))
    is_promoted = (F.col("kind") == "parameter") & (F.col("receiver_kind") == "promoted")
    none = F.array().cast("array<struct<source:string,target:string,type:string>>")
    edges = (
        F.when(F.col("kind") == "method_call", F.array(edge(here, member(receiver), "method_call")))
        .when(F.col("kind") == "static_call", F.array(edge(here, member(class_), "static_call")))
        .when(is_new, F.array(edge(here, made, "constructor_call")))
        .when(is_promoted, F.concat(parts, promoted))
        .when(F.col("kind").isin(*TYPE_KINDS), parts)
        .otherwise(none)
    )
    other = rest.select("repo", "file", "line", F.explode(edges).alias("e")).select("repo", "file", "e.source", "e.target", "e.type", "line")
    return calls.unionByName(other).where("target is not null")


def aggregate(resolved: DataFrame) -> DataFrame:
    """Dependencies: lines sorted and unique, occurrences = number of sites."""
    return resolved.groupBy("repo", "file", "source", "target", "type").agg(F.sort_array(F.collect_set("line")).alias("lines"), F.count("*").cast("int").alias("occurrences"))


def merge(*results: DataFrame) -> DataFrame:
    """Dependencies of several inputs together."""
    rows = results[0]
    for other in results[1:]:
        rows = rows.unionByName(other)
    return rows


def listed_dependencies(rows: DataFrame) -> DataFrame:
    """In (source, target, type, first line) order, for a sink."""
    return rows.orderBy("repo", "source", "target", "type", F.get("lines", F.lit(0)))


def of_changed_files(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    return dependencies.join(files.select("repo", F.col("path").alias("file")), ["repo", "file"], "left_semi")


def duplicate_symbols(symbols: DataFrame) -> DataFrame:
    """Definitions found twice: repo, fqn, n, files."""
    return symbols.groupBy("repo", "fqn").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("file")).alias("files")).where("n > 1")


def without_duplicates(symbols: DataFrame, strict: bool = False) -> DataFrame:
    """Symbols of repositories without duplicate definitions; strict: an error instead."""
    bad = duplicate_symbols(symbols)
    if strict and (first := bad.orderBy("repo", "fqn").head()):
        raise ValueError(f"{first['fqn']} is defined more than once: {', '.join(first['files'])}")
    return symbols.join(bad.select("repo").distinct(), "repo", "left_anti")


def index_counts(files: DataFrame, symbols: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Files, symbols and dependencies per repository."""
    kinds = [("files", files), ("symbols", symbols), ("dependencies", dependencies)]
    each = [df.groupBy("repo").agg(F.count("*").alias("n")).withColumn("what", F.lit(k)) for k, df in kinds]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    return rows.groupBy("repo").agg(*(F.coalesce(F.sum(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).alias(k) for k, _ in kinds))
