"""Labels on symbols: configured ones, and ones from framework rules over call facts.

call_facts(repo, file, containing_symbol, kind, callee_class, name, chain ARRAY<STRING>,
arg_class, arg_method, arg_kind): kind is static, instance, new or func; arg_* is
the class, and the method named with it, of the argument that a call is about.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockline.functions.lineage import cut
from shockline.operators.graph import inherited_marks

#: Full names of the framework's classes and its facades by short name.
FACADES = {
    "DB": "Illuminate\\Support\\Facades\\DB",
    "Auth": "Illuminate\\Support\\Facades\\Auth",
    "Http": "Illuminate\\Support\\Facades\\Http",
    "Event": "Illuminate\\Support\\Facades\\Event",
    "Route": "Illuminate\\Support\\Facades\\Route",
    "Bus": "Illuminate\\Support\\Facades\\Bus",
    "Queue": "Illuminate\\Support\\Facades\\Queue",
}
CONTROLLER = "Illuminate\\Routing\\Controller"
MODEL = "Illuminate\\Database\\Eloquent\\Model"
BUILDERS = ["Illuminate\\Database\\Query\\Builder", "Illuminate\\Database\\Eloquent\\Builder"]
SHOULD_QUEUE = "Illuminate\\Contracts\\Queue\\ShouldQueue"
BUS_DISPATCHABLE = "Illuminate\\Foundation\\Bus\\Dispatchable"
EVENT_DISPATCHABLE = "Illuminate\\Foundation\\Events\\Dispatchable"
HTTP_REQUEST = "Illuminate\\Http\\Request"
GUZZLE_CLIENT = "GuzzleHttp\\Client"
HTTP_CLIENTS = [FACADES["Http"], "Illuminate\\Http\\Client\\PendingRequest", "Illuminate\\Http\\Client\\Factory", GUZZLE_CLIENT]
#: Method names that the rules look for.
READ_METHODS = ["get", "first", "firstOrFail", "firstOr", "find", "findOrFail", "findMany", "findOrNew", "sole", "value", "pluck", "count", "exists", "doesntExist", "avg", "average", "sum", "min", "max", "cursor", "lazy", "paginate", "simplePaginate", "cursorPaginate", "all", "fresh", "refresh", "select", "selectOne"]
WRITE_METHODS = ["create", "insert", "insertGetId", "insertOrIgnore", "insertUsing", "update", "updateOrCreate", "updateOrInsert", "upsert", "delete", "forceDelete", "increment", "decrement", "save", "saveQuietly", "createMany", "deleteMany", "destroy", "truncate", "restore", "push", "firstOrCreate"]
ROUTE_METHODS = ["get", "post", "put", "patch", "delete", "options", "any", "match", "resource", "apiResource", "controller", "action"]
NON_ACTIONS = ["__construct", "__destruct", "middleware", "getMiddleware", "callAction"]
DISPATCH_METHODS = ["dispatch", "dispatchSync", "dispatchAfterResponse", "push", "later", "pushOn", "laterOn"]
EVENT_METHODS = ["dispatch", "dispatchNow", "until"]
AUTH_METHODS = ["attempt", "user", "guard", "check", "guest", "id", "login", "logout", "logoutOtherDevices", "validate", "once", "viaRemember", "hasUser", "authenticate"]
REQUEST_METHODS = ["user", "authenticate"]
HTTP_METHODS = ["get", "post", "put", "patch", "delete", "head", "options", "send", "request", "sendAsync", "requestAsync"]


def combine(*providers: DataFrame) -> DataFrame:
    """Annotations (repo, symbol, type) of several providers; the earlier one wins on (symbol, type)."""
    rows = None
    for rank, provider in enumerate(providers):
        part = provider.select("repo", "symbol", "type", F.lit(rank).alias("provider_rank"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("repo", "symbol", "type").agg(F.min("provider_rank").alias("provider_rank"))


def for_framework(annotations: DataFrame, configuration: DataFrame, framework: str = "laravel") -> DataFrame:
    """Annotations of repositories whose configuration(repo, framework) names the framework."""
    return annotations.join(configuration.where(F.lower("framework") == framework), "repo", "left_semi")


def label_impact(annotations: DataFrame, entries: DataFrame, flows: DataFrame) -> DataFrame:
    """Annotated symbols in the blast radius and on flows, with the context; unique.

    Entries and nodes meet the annotated symbols first; what is left, which is little, is made unique.
    """
    marks = annotations.select("repo", "symbol", "type").distinct()
    blast = entries.select("repo", "change_id", F.col("impacted_symbol").alias("symbol"), F.lit("blast_radius").alias("context"))
    nodes = flows.select("repo", "change_id", F.explode("nodes").alias("n")).select("repo", "change_id", F.col("n.id").alias("symbol"), F.lit("affected_flow").alias("context"))
    return blast.unionByName(nodes).join(marks, ["repo", "symbol"]).select("repo", "symbol", "change_id", "context", "type").distinct()


#: Classes named like a facade, in all repositories, up to which they are broadcast.
FEW_NAMESAKES = 100_000


def namesakes(classes: DataFrame) -> DataFrame:
    """repo, class: the project's own classes, interfaces and traits (repo, class) that are named like a facade; at most as many per repository as there are facades."""
    own = cut(classes.where(F.col("class").isin(*FACADES)).select("repo", "class").distinct())
    return F.broadcast(own) if own.count() <= FEW_NAMESAKES else own


def resolve_facades(facts: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """Facade short names in the columns (callee_class, unless others are named) become full names unless the project defines a class, interface or trait of that name (repo, class)."""
    own = namesakes(classes)
    for column in columns or ("callee_class",):
        full = F.create_map(*(F.lit(x) for pair in FACADES.items() for x in pair))[F.col(column)]
        rows = facts.join(own.select("repo", F.col("class").alias(column), F.lit(True).alias("_own")), ["repo", column], "left")
        name = F.when(full.isNotNull() & F.col("_own").isNull(), full).otherwise(F.col(column))
        facts = rows.withColumn(column, name).select(*facts.columns)
    return facts


#: What is known of a class, as bits: its own or inherited, and, from IS_CLASS on, its own alone.
CONTROLS, RECEIVES, QUEUED, IS_EVENT, IS_CLASS, HANDLES, INVOKABLE = (1 << k for k in range(7))


@dataclass
class Project:
    """symbols, parents(repo, child, parent), interfaces and traits (repo, class, name), calls.

    symbols may have ``is_abstract``; without it no method is abstract.
    ``properties`` (repo, class, mask) says in one row what the rules ask of a class.
    """

    symbols: DataFrame
    parents: DataFrame
    interfaces: DataFrame
    traits: DataFrame
    calls: DataFrame
    properties: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        classes = self.symbols.where("type = 'class'").select("repo", F.col("fqn").alias("class")).distinct()
        named = self.symbols.where("type in ('class', 'interface', 'trait')").select("repo", F.col("fqn").alias("class"))
        self.calls = resolve_facades(self.calls, named, "callee_class", "arg_class")
        abstract = F.coalesce("is_abstract", F.lit(False)) if "is_abstract" in self.symbols.columns else F.lit(False)
        self.methods = self.symbols.where("type = 'method'").select("repo", F.col("parent").alias("class"), F.col("name").alias("method"), F.col("fqn").alias("method_id"), "visibility", abstract.alias("is_abstract"))
        mark = lambda rows, id_, mask: rows.select("repo", id_.alias("id"), (mask if isinstance(mask, Column) else F.lit(mask)).cast("long").alias("mask"))
        base = F.create_map(*(F.lit(x) for name, mask in ((CONTROLLER, CONTROLS), (MODEL, RECEIVES), *((b, RECEIVES) for b in BUILDERS), (SHOULD_QUEUE, QUEUED)) for x in (name, mask)))
        ends = self.parents.select("repo", F.explode(F.array("child", "parent")).alias("class")).unionByName(classes)
        holds = lambda facts, name, mask: mark(facts.where(F.col("name") == name), F.col("class"), mask)
        marks = mark(ends.where(base[F.col("class")].isNotNull()).distinct(), F.col("class"), base[F.col("class")])
        marks = marks.unionByName(holds(self.interfaces, SHOULD_QUEUE, QUEUED)).unionByName(holds(self.traits, BUS_DISPATCHABLE, QUEUED)).unionByName(holds(self.traits, EVENT_DISPATCHABLE, IS_EVENT))
        own = mark(classes, F.col("class"), IS_CLASS)
        for method, mask in (("handle", HANDLES), ("__invoke", INVOKABLE)):
            own = own.unionByName(mark(self.methods.where(F.col("method") == method), F.col("class"), mask))
        every = inherited_marks(self.parents, marks).unionByName(own).where("id is not null")
        self.properties = cut(every.groupBy("repo", F.col("id").alias("class")).agg(F.expr("bit_or(mask)").alias("mask")))


def _is(mask: int) -> Column:
    return F.col("mask").bitwiseAND(F.lit(mask)) == mask


def _member(class_: str, method: str) -> Column:
    return F.concat(F.col(class_), F.lit("::" + method))


def _labelled(rows: DataFrame, type_: str, symbol: Column) -> DataFrame:
    return rows.select("repo", symbol.alias("symbol"), F.lit(type_).alias("type")).where("symbol <> ''")


def _chain(names: list[str]) -> Column:
    return F.arrays_overlap("chain", F.array(*map(F.lit, names)))


def _static(*callees: str) -> Column:
    return (F.col("kind") == "static") & F.col("callee_class").isin(*callees)


@dataclass
class Label:
    """A label that a call gives: where ``when`` holds, ``symbol`` gets the rule's type.

    ``of`` names the column of the class whose properties decide (``and_``, on ``mask``), if any does.
    """

    type: str
    when: Column
    symbol: Column | None = None
    of: str | None = None
    and_: Column | None = None


@dataclass
class Rule:
    """What a rule says of calls, and of a project's classes and methods."""

    calls: Callable[[], list[Label]]
    structure: Callable[[Project], DataFrame] | None = None


def _controller_methods(p: Project) -> DataFrame:
    """Public actions of controllers."""
    action = ~F.col("method").isin(NON_ACTIONS) & (~F.col("method").startswith("__") | (F.col("method") == "__invoke"))
    public = p.methods.where((F.coalesce("visibility", F.lit("public")) == "public") & action & ~F.col("is_abstract"))
    return _labelled(public.join(p.properties.where(_is(CONTROLS | IS_CLASS)), ["repo", "class"], "left_semi"), "api_entrypoint", F.col("method_id"))


def _route_targets() -> list[Label]:
    route = _static(FACADES["Route"]) & F.col("name").isin(ROUTE_METHODS) & F.col("arg_class").isNotNull()
    target = F.when(F.col("arg_method").isNotNull(), F.concat_ws("::", "arg_class", "arg_method")).when(_is(INVOKABLE), _member("arg_class", "__invoke")).otherwise(F.col("arg_class"))
    return [Label("api_entrypoint", route, target, "arg_class", F.lit(True))]


def _database(type_: str, methods: list[str]) -> Callable[[], list[Label]]:
    def labels() -> list[Label]:
        named = F.col("callee_class").isin(FACADES["DB"], MODEL, *BUILDERS)
        return [Label(type_, named & _chain(methods)), Label(type_, ~named & _chain(methods), None, "callee_class", _is(RECEIVES))]

    return labels


def _queued_classes(p: Project) -> DataFrame:
    symbol = F.when(_is(HANDLES), _member("class", "handle")).when(_is(INVOKABLE), _member("class", "__invoke")).otherwise(F.col("class"))
    return _labelled(p.properties.where(_is(QUEUED | IS_CLASS)), "queue", symbol)


def _dispatches() -> list[Label]:
    """What dispatches to queued classes, and these."""
    static = (F.col("kind") == "static") & F.col("name").isin(DISPATCH_METHODS)
    job = (F.col("kind") == "func") & (F.col("name") == "dispatch") & (F.col("arg_kind") == "new")
    return [
        Label("queue", static & F.col("callee_class").isin(FACADES["Bus"], FACADES["Queue"])),
        Label("queue", static, None, "callee_class", _is(QUEUED)),
        Label("queue", static, F.concat_ws("::", "callee_class", "name"), "callee_class", _is(QUEUED)),
        Label("queue", static, _member("callee_class", "handle"), "callee_class", _is(QUEUED | HANDLES)),
        Label("queue", job, None, "arg_class", _is(QUEUED)),
        Label("queue", job, _member("arg_class", "handle"), "arg_class", _is(QUEUED | HANDLES)),
    ]


def _event_classes(p: Project) -> DataFrame:
    return _labelled(p.properties.where(_is(IS_EVENT | IS_CLASS)), "event", F.col("class"))


def _raised() -> list[Label]:
    """What raises events, and listeners."""
    facade = _static(FACADES["Event"])
    target = F.when(F.col("arg_method").isNotNull(), F.concat_ws("::", "arg_class", "arg_method")).when(_is(HANDLES), _member("arg_class", "handle")).otherwise(F.col("arg_class"))
    raised = ((F.col("kind") == "func") & (F.col("name") == "event")) | (facade & F.col("name").isin(*EVENT_METHODS, "listen"))
    return [Label("event", raised), Label("event", facade & (F.col("name") == "listen") & F.col("arg_class").isNotNull(), target, "arg_class", F.lit(True))]


def _authenticated() -> list[Label]:
    func = (F.col("kind") == "func") & (F.col("name") == "auth")
    facade = (F.col("callee_class") == FACADES["Auth"]) & _chain(AUTH_METHODS)
    request = (F.col("callee_class") == HTTP_REQUEST) & _chain(REQUEST_METHODS)
    return [Label("authentication", F.coalesce(func, F.lit(False)) | F.coalesce(facade, F.lit(False)) | F.coalesce(request, F.lit(False)))]


def _integrated() -> list[Label]:
    made = (F.col("kind") == "new") & (F.col("callee_class") == GUZZLE_CLIENT)
    return [Label("external_integration", made | (F.col("callee_class").isin(HTTP_CLIENTS) & _chain(HTTP_METHODS)))]


controllers = Rule(_route_targets, _controller_methods)
database_reads = Rule(_database("database_read", READ_METHODS))
database_writes = Rule(_database("database_write", WRITE_METHODS))
queues = Rule(_dispatches, _queued_classes)
events = Rule(_raised, _event_classes)
authentication = Rule(_authenticated)
integrations = Rule(_integrated)
RULES: list[Rule | Callable[[Project], DataFrame]] = [controllers, database_reads, database_writes, queues, events, authentication, integrations]


def call_labels(project: Project, labels: list[Label]) -> DataFrame:
    """repo, symbol, type from calls: all labels in one scan.

    A call that some label may fit is sent once for each class that decides
    about one, its callee or its argument, and meets that class's properties;
    the rest of the calls, and chains, stay where they are read.  A label
    without such a class goes with the call's first row.
    """
    fits = lambda x: F.coalesce(x, F.lit(False))
    flags = [f"_{k}" for k in range(len(labels))]
    rows = project.calls.select("repo", "containing_symbol", "name", "callee_class", "arg_class", "arg_method", *(fits(x.when).alias(c) for x, c in zip(labels, flags, strict=True)))
    any_of = lambda of: reduce(or_, (F.col(c) for x, c in zip(labels, flags, strict=True) if x.of == of), F.lit(False))
    asked = [F.when(any_of(of), F.lit(of)) for of in ("callee_class", "arg_class")]
    sides = F.array_compact(F.array(*asked))
    sides = F.when(F.size(sides) > 0, sides).when(any_of(None), F.array(F.lit("none")))
    rows = rows.withColumn("side", F.explode(sides)).withColumn("first", F.col("side") != F.when(any_of("callee_class"), F.lit("arg_class")).otherwise(F.lit("-")))
    # Calls that ask nothing get keys of their own, so that none is common to them all.
    class_ = F.when(F.col("side") == "callee_class", F.col("callee_class")).when(F.col("side") == "arg_class", F.col("arg_class"))
    rows = rows.withColumn("class", F.coalesce(class_, F.concat(F.lit("\x00"), "containing_symbol")))
    met = rows.join(project.properties, ["repo", "class"], "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    given = lambda x, c: F.col(c) & (F.col("first") if x.of is None else (F.col("side") == x.of) & x.and_)
    each = F.array(*(F.when(given(x, c), F.struct((F.col("containing_symbol") if x.symbol is None else x.symbol).alias("symbol"), F.lit(x.type).alias("type"))) for x, c in zip(labels, flags, strict=True)))
    return met.select("repo", F.explode(F.array_compact(each)).alias("l")).select("repo", "l.symbol", "l.type").where("symbol <> ''")


def framework_labels(project: Project, rules: list[Rule | Callable[[Project], DataFrame]] | None = None) -> DataFrame:
    """repo, symbol, type from all rules, each once.  A rule of one's own may also be a function of the project."""
    rules = RULES if rules is None else rules
    labels = [label for r in rules if isinstance(r, Rule) for label in r.calls()]
    parts = [call_labels(project, labels)] if labels else []
    parts += [r.structure(project) for r in rules if isinstance(r, Rule) and r.structure] + [r(project) for r in rules if not isinstance(r, Rule)]
    return reduce(DataFrame.unionByName, parts).distinct()
