"""Request flows: client call -> route -> middleware -> functions -> data access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.functions.stages import hold
from sourcegrain.operators import facts as C
from sourcegrain.operators.graph import AUTH_NAME
from sourcegrain.session import stored

# Path parameters, calls that are never traced, most steps before calls stop.
PARAMETER = r"\$\{[^}]+\}|:\w+|\{[^}]+\}|<[^>]+>"
SKIP_CALLS = ["require", "next", "json", "status", "send", "parseInt", "String", "Number", "Error", "fetch", "Boolean",
              "Object", "Array", "JSON", "Promise", "console", "super"]
MAX_STEPS = 7


def segments(path: Column) -> Column:
    """Path segments without query and fragment; parameters become a star."""
    plain = F.substring_index(F.substring_index(path, "?", 1), "#", 1)
    return F.filter(F.split(F.regexp_replace(plain, PARAMETER, "*"), "/"), lambda s: s != "")


def _mask(parts: Column) -> Column:
    """Positions that are wildcards, as a string of 0 and 1."""
    return F.array_join(F.transform(parts, lambda s: F.when(s == "*", "1").otherwise("0")), "")


def _masked(parts: Column, mask: Column) -> Column:
    """Segments with the masked positions blanked out: the equi-join key of a match."""
    return F.array_join(F.transform(parts, lambda s, i: F.when(F.substring(mask, i + 1, F.lit(1)) == "1", "*").otherwise(s)), "/")


def match_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Best route for each call (repo_id, method, target) among (repo_id, path, ordinal, method, route_path).

    A star on either side matches any segment. Instead of comparing every call with every route, each
    call is keyed once per wildcard mask that occurs among the routes of its length, and each route once
    per mask among the calls; equal masked paths meet by an equi-join. Routes are first reduced to one
    row per (key, method), so the join fans out by the number of methods only.
    """
    targets = calls.select("repo_id", "method", "target").distinct()
    targets = hold(targets, parts=segments(F.col("target")))
    # every suffix of a call: the whole path is an exact match, a shorter one a mounted router
    suffix = targets.select("*", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("len")).where("len > 0 OR size(parts) = 0")
    suffix = hold(suffix, tail=F.slice("parts", F.size("parts") - F.col("len") + 1, F.col("len")))
    suffix = suffix.withColumn("call_mask", _mask(F.col("tail"))).withColumn("whole", F.col("len") == F.size("parts"))
    known = hold(routes.select("repo_id", "path", "ordinal", "line", F.col("method").alias("route_method"), "route_path"), rparts=segments(F.col("route_path")))
    known = known.withColumn("len", F.size("rparts")).withColumn("route_mask", _mask(F.col("rparts")))
    route_masks = known.select("repo_id", "len", "route_mask").distinct()
    call_masks = suffix.select("repo_id", "len", "call_mask").distinct()
    left = suffix.join(route_masks, ["repo_id", "len"]).withColumn("key", _masked(F.col("tail"), F.col("route_mask")))
    left = left.withColumn("key", _masked(F.split("key", "/"), F.col("call_mask")))
    right = known.join(call_masks, ["repo_id", "len"]).withColumn("key", _masked(F.col("rparts"), F.col("call_mask")))
    right = right.withColumn("key", _masked(F.split("key", "/"), F.col("route_mask")))
    first = right.groupBy("repo_id", "len", "route_mask", "call_mask", "key", "route_method").agg(
        F.min(F.struct("path", "ordinal", "line", "route_path")).alias("r"))
    hits = left.join(first, ["repo_id", "len", "route_mask", "call_mask", "key"])
    exact = F.col("whole") & ((F.col("route_method") == F.col("method")) | (F.col("route_method") == "ALL"))
    priority = F.when(exact, 0).when(F.col("whole"), 1).otherwise(2)
    hits = hits.where(F.col("whole") | (F.col("len") > 0))
    return hits.groupBy("repo_id", "method", "target").agg(
        F.min_by(F.struct("route_method", "r.*"), F.struct(priority, F.col("r"))).alias("m")).select(
        "repo_id", "method", "target", F.col("m.path").alias("route_file"), F.col("m.line").alias("route_line"), "m.route_method", "m.route_path",
        F.col("m.ordinal").alias("route_ordinal"))


def flow_name(path: Column) -> Column:
    parts = F.slice(F.filter(segments(path), lambda s: ~s.isin("api", "*") & ~s.rlike(r"^v\d+$")), 1, 2)
    words = F.transform(parts, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(F.translate(s, "-_", "  "), 2, 1000))))
    return F.when(F.size(parts) == 0, "Root request").otherwise(F.array_join(words, " · "))


def backend_steps(parsed: DataFrame, database: str = "Database") -> DataFrame:
    """Steps of every route: repo_id, path, route line, step_no, layer, label, step_path, step_line."""
    routes = C.table(parsed, "routes")
    key = ["repo_id", "path", "ordinal"]
    wide = routes.select(*key, "line", "line_end", "method", "route_path", "middlewares", "handler")
    step = lambda no, layer, label, path, line: F.struct(
        no.cast("int").alias("no"), layer.alias("layer"), label.alias("label"), path.alias("step_path"), line.alias("step_line"))
    heads = wide.select(*key, step(F.lit(0), F.lit("Route"), F.concat_ws(" ", "method", "route_path"), F.col("path"), F.col("line")).alias("s"))
    mids = wide.select(*key, "line", F.posexplode("middlewares").alias("i", "mw")).withColumn("name", F.substring_index("mw", ".", -1))
    mids = C.resolve_names(mids, parsed).select(*key, step(
        F.col("i") + 1, F.when(F.col("mw").rlike(AUTH_NAME), "Auth").otherwise("Middleware"), F.concat("mw", F.lit("() middleware")),
        F.coalesce("target.path", "path"), F.coalesce("target.line_start", "line")).alias("s"))
    # the handler's span: a named handler resolves to its symbol, an inline one is the route block
    named = C.resolve_names(wide.where("handler IS NOT NULL").withColumn("name", F.col("handler")), parsed)
    inline = wide.where("handler IS NULL").withColumn("name", F.col("handler")).withColumn("target", F.lit(None).cast(named.schema["target"].dataType))
    spans = named.unionByName(inline).select(*key, F.size("middlewares").alias("n_mid"), "middlewares", F.coalesce("target.path", "path").alias("h_path"),
                                             F.coalesce("target.line_start", "line").alias("h_start"), F.coalesce("target.line_end", "line_end").alias("h_end"))
    files = parsed.select("repo_id", F.col("path").alias("h_path"), "lines", "data_access", "external_calls")
    body = spans.join(files, ["repo_id", "h_path"])
    within = lambda rows: F.filter(rows, lambda r: (r["line"] >= F.col("h_start")) & (r["line"] <= F.col("h_end")))
    body = hold(body, called=C.called_identifiers(tx.join_lines(tx.slice_lines(F.col("lines"), F.col("h_start"), F.col("h_end")))),
                data=F.try_element_at(within(F.col("data_access")), F.lit(1)), ext=F.try_element_at(within(F.col("external_calls")), F.lit(1)))
    calls = body.select(*key, "n_mid", "middlewares", F.col("h_path"), F.posexplode("called").alias("i", "name")).where(
        ~F.col("name").isin(SKIP_CALLS) & ~F.array_contains("middlewares", F.col("name")))
    refs = calls.select(*key, "n_mid", "h_path", "i", "name").withColumnRenamed("path", "route_file").withColumnRenamed("h_path", "path")
    done = C.resolve_names(refs, parsed).where("target IS NOT NULL AND target.kind <> 'class'").select(
        "repo_id", F.col("route_file").alias("path"), "ordinal", "n_mid", "i", "name", "target")
    access = parsed.select("repo_id", F.col("path").alias("t_path"), F.col("data_access").alias("t_data"))
    done = done.withColumn("t_path", F.col("target.path")).join(access, ["repo_id", "t_path"], "left")
    own = F.filter("t_data", lambda a: (a["line"] >= F.col("target.line_start")) & (a["line"] <= F.col("target.line_end")))
    done = hold(done, first_data=F.try_element_at(own, F.lit(1)))
    # steps so far: route, middleware, calls, and one database step once a called function reads data
    w = Window.partitionBy(*key).orderBy("i")
    db_before = F.coalesce(F.max(F.col("first_data").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    done = done.withColumn("_n", F.row_number().over(w)).withColumn("_db", db_before)
    done = done.where(1 + F.col("n_mid") + F.col("_n") - 1 + F.col("_db") < MAX_STEPS)
    layer = F.when(F.col("name").rlike(AUTH_NAME) & F.col("first_data").isNull(), "Auth").when(F.col("first_data").isNotNull(), "Data").otherwise("Service")
    fn = done.select(*key, step(100 + 2 * F.col("i"), layer, F.concat("name", F.lit("()")), F.col("target.path"), F.col("target.line_start")).alias("s"))
    db_label = F.lit(f"{database} query")
    db_call = done.where("first_data IS NOT NULL").groupBy(*key).agg(F.min_by(F.struct("i", "t_path", "first_data"), "i").alias("d"))
    db_steps = db_call.select(*key, step(101 + 2 * F.col("d.i"), F.lit("Database"), db_label, F.col("d.t_path"), F.col("d.first_data.line")).alias("s"))
    db_own = body.where("data IS NOT NULL").join(db_call.select(*key), key, "left_anti").select(
        *key, step(F.lit(100000), F.lit("Database"), db_label, F.col("h_path"), F.col("data.line")).alias("s"))
    ext = body.where("ext IS NOT NULL").select(*key, step(F.lit(100001), F.lit("External"), F.concat(F.lit("Outbound HTTP call ("), "ext.target", F.lit(")")),
                                                          F.col("h_path"), F.col("ext.line")).alias("s"))
    whole = heads
    for part in (mids, fn, db_steps, db_own, ext):
        whole = whole.unionByName(part)
    return whole.select(*key, "s.*")


def request_flows(parsed: DataFrame, database: str = "Database", limit: int | None = 4) -> DataFrame:
    """Flow steps: repo_id, flow_no, name, trigger, resolved, step_no, layer, label, step_path, step_line."""
    calls = C.table(parsed.where(F.size("routes") == 0), "api_calls")
    trigger = F.concat_ws(" ", "method", "target")
    first = calls.groupBy("repo_id", trigger.alias("trigger")).agg(
        F.min_by(F.struct("path", "line", "method", "target", "via", "ordinal"), F.struct("path", "ordinal")).alias("c")).select("repo_id", "trigger", "c.*")
    inside = C.innermost_symbol(first.select("repo_id", "path", "line").distinct(), C.table(parsed, "symbols")).select(
        "repo_id", "path", "line", F.col("name").alias("ui_name"), F.col("line_start").alias("ui_line"))
    first = first.join(inside, ["repo_id", "path", "line"], "left")
    matched = match_routes(first.select("repo_id", "method", "target"), C.table(parsed, "routes"))
    flows = first.join(matched, ["repo_id", "method", "target"], "left").withColumn("resolved", F.col("route_file").isNotNull())
    head = ["repo_id", "trigger", "resolved", "target", F.col("path").alias("from_path"), F.col("ordinal").alias("from_ordinal")]
    ui_label = F.when(F.col("ui_name").isNotNull(), F.concat("ui_name", F.lit("() in the browser"))).otherwise("Browser UI")
    via = F.when(F.col("via").isin("fetch", "axios"), F.col("trigger")).otherwise(F.concat("trigger", F.lit(" via "), "via", F.lit("()")))
    ui = flows.select(*head, F.lit(-2).alias("no"), F.lit("UI").alias("layer"), ui_label.alias("label"), F.col("path").alias("step_path"),
                      F.coalesce("ui_line", "line").alias("step_line"))
    api = flows.select(*head, F.lit(-1).alias("no"), F.lit("API call").alias("layer"), via.alias("label"), F.col("path").alias("step_path"),
                       F.col("line").alias("step_line"))
    steps = stored(backend_steps(parsed, database))  # read by both branches below
    back = flows.where("resolved").select(*head, "route_file", "route_ordinal").join(
        steps.withColumnRenamed("path", "route_file").withColumnRenamed("ordinal", "route_ordinal"), ["repo_id", "route_file", "route_ordinal"]).drop(
        "route_file", "route_ordinal")
    whole = ui.unionByName(api).unionByName(back)
    # a repository without client calls shows its routes
    bare = C.table(parsed, "routes").join(first.select("repo_id").distinct(), "repo_id", "left_anti")
    bare = bare.select("repo_id", F.concat_ws(" ", "method", "route_path").alias("trigger"), F.lit(True).alias("resolved"), F.col("route_path").alias("target"),
                       "path", "ordinal").join(steps, ["repo_id", "path", "ordinal"]).withColumnRenamed("path", "from_path").withColumnRenamed("ordinal", "from_ordinal")
    whole = whole.unionByName(bare)
    if limit is not None:
        sizes = whole.groupBy("repo_id", "trigger", "resolved", "from_path", "from_ordinal").agg(F.count("*").alias("n"))
        w = Window.partitionBy("repo_id").orderBy(F.desc("resolved"), F.desc("n"), "from_path", "from_ordinal")
        top = sizes.withColumn("flow_no", F.row_number().over(w)).where(F.col("flow_no") <= limit)
        whole = whole.join(top.select("repo_id", "trigger", "from_path", "from_ordinal", "flow_no"), ["repo_id", "trigger", "from_path", "from_ordinal"])
    else:
        whole = whole.withColumn("flow_no", F.lit(None).cast("int"))
    step_no = F.row_number().over(Window.partitionBy("repo_id", "trigger", "from_path", "from_ordinal").orderBy("no"))
    return whole.select("repo_id", "flow_no", flow_name(F.col("target")).alias("name"), "trigger", "resolved", step_no.alias("step_no"), "layer", "label",
                        "step_path", "step_line")


def route_table(parsed: DataFrame) -> DataFrame:
    rows = C.table(parsed, "routes")
    return rows.select("repo_id", "method", "route_path", "path", "line", F.array_join("middlewares", ",").alias("middlewares"),
                       F.element_at(F.split("path", "/"), 1).alias("module"))
