"""Code facts per file: symbols, imports, exports, routes, calls, data access, markers.

Every fact list is an array column of the file row, computed from its ``lines`` without a shuffle;
the ``*_table`` functions explode one list into rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcegrain.functions import blocks as B
from sourcegrain.functions import text as tx
from sourcegrain.functions.stages import hold, let

# ---- fixed values: languages and patterns ----
JS_LANGUAGES = ["javascript", "typescript", "vue", "svelte"]
ID = r"[A-Za-z_$][\w$]*"
JS_FUNCTION = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(" + ID + r")\s*[<(]"
JS_VARIABLE = (r"^\s*(?:export\s+)?(?:const|let|var)\s+(" + ID + r")\s*(?::[^=]*)?=\s*(?:async\s+)?"
               r"(function\b|\(|" + ID + r"\s*=>)")
JS_EXPORTS_FN = r"^\s*(?:module\.)?exports\.(" + ID + r")\s*=\s*(?:async\s+)?(function\b|\(|" + ID + r"\s*=>)"
JS_CLASS = r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(" + ID + r")"
JS_METHOD = (r"^\s+(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*\*?(" + ID + r")"
             r"\s*\([^)]*\)\s*(?::\s*[^{=]+)?\{\s*(?://.*)?$")
NOT_METHODS = ["if", "for", "while", "switch", "catch", "function", "return", "with", "else"]
JS_IMPORT_FROM = r"""^\s*import\s+(?:type\s+)?([\w$*{}\s,]+?)\s+from\s+['"]([^'"]+)['"]"""
JS_IMPORT_ONLY = r"""^\s*import\s+['"]([^'"]+)['"]"""
JS_REQUIRE = r"""(?:(?:const|let|var)\s+(\{[^}]*\}|""" + ID + r""")\s*=\s*)?require\(\s*['"]([^'"]+)['"]\s*\)"""
JS_MODULE_EXPORTS = r"module\.exports\s*=\s*\{"
JS_EXPORT_DECL = r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|const|let|var|class)\s+(" + ID + r")"
JS_EXPORT_LIST = r"^\s*export\s*\{([^}]*)\}"
JS_EXPORTS_ASSIGN = r"^\s*(?:module\.)?exports\.(" + ID + r")\s*="
JS_ROUTE = (r"""\b(app|router|server|routes?|""" + ID + r"""(?:Router|App|router|app))\."""
            r"""(get|post|put|patch|delete|all|options|head)\(\s*(['"`])([^'"`]+)\3(.*)$""")
JS_ROUTE_HINT = r"\.(?:get|post|put|patch|delete|all|options|head)\("  # stands in every line that JS_ROUTE fits, and is found without going back
ROUTE_ARGUMENT = r"^([A-Za-z_$][\w$.]*)\s*\)?\s*;?$"
PY_ROUTE = r"""^\s*@(\w+)\.(get|post|put|patch|delete|route|api_route)\(\s*['"]([^'"]+)['"](.*)$"""
PY_METHODS = r"methods\s*=\s*\[([^\]]*)\]"
FETCH = r"""\bfetch\(\s*(['"`])([^'"`]+)\1"""
AXIOS = r"""\baxios\.(get|post|put|patch|delete)\(\s*(['"`])([^'"`]+)\2"""
API_CALL = r"""(?<![\w$.])(""" + ID + r""")\(\s*(['"`])(/(?:api|v\d+)/[^'"`]*)\2(\s*,)?"""
NOT_HELPERS = ["fetch", "require", "import", "get", "post", "put", "patch", "delete"]
METHOD_OPTION = r"""method\s*:\s*['"]([A-Za-z]+)['"]"""
OUTBOUND = (r"\b(fetch|axios(?:\.(?:get|post|put|patch|delete|request))?|requests\.(?:get|post|put|patch|delete|request)|"
            r"httpx\.(?:get|post|put|patch|delete|request)|urllib\.request\.urlopen|https?\.request)\s*\(\s*([^,)]*)")
DATA_CALL = (r"\b(pool|client|db|database|conn|connection|knex|prisma|sequelize|cursor|session|collection|mongoose)\."
             r"(query|execute|executemany|raw|run|all|findOne|findMany|find|insertOne|insertMany|updateOne|updateMany|"
             r"deleteOne|deleteMany|aggregate|collection|select|insert|update|delete|create|save)\s*\(")
SQL_TEXT = (r"""(?i)['"`]\s*(?:SELECT\s.*?\sFROM|INSERT\s+INTO|UPDATE\s+\w+\s+SET|DELETE\s+FROM|CREATE\s+TABLE)\b""")
SQL_METHODS = ["query", "execute", "executemany", "raw", "run", "all"]
DOCUMENT_METHODS = r"^(find|insert|update|delete|aggregate|collection)"
MARKER = (r"(?i)(?://|#|/\*|^\s*\*|<!--).*?\b(DEPRECATED|LEGACY|OBSOLETE|scheduled for removal|old implementation)\b"
          r"|@deprecated")
DOM_USAGE = r"\b(document\.|window\.|localStorage\.|sessionStorage\.)"
PY_DEF = r"^(\s*)(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("
PY_CLASS = r"^(\s*)class\s+([A-Za-z_]\w*)\s*[(:]"
PY_IMPORT = r"^\s*import\s+([\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*)\s*$"
PY_FROM = r"^\s*from\s+(\.*[\w.]*)\s+import\s+\(?([^)#]*)"
GO_FUNC = r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*[\[(]"
CALLED = r"(?<![\w$.])(" + ID + r")\s*\("
# ---- end of fixed values ----

SYMBOL = ("array<struct<line_start:int,neg:int,ord:int,name:string,kind:string,line_end:int,parent:string,"
          "signature:string>>")
IMPORT = "array<struct<line:int,module:string,names:array<string>>>"
ROUTE = ("array<struct<line:int,line_end:int,method:string,path:string,middlewares:array<string>,handler:string,"
         "framework:string>>")
CALL = "array<struct<line:int,method:string,target:string,via:string>>"


def _g(line: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(line, pattern, group)


def _symbol(name, kind, start, end, parent, signature, order) -> Column:
    return let(end, lambda last: F.struct(
        start.cast("int").alias("line_start"), (start - last - 1).cast("int").alias("neg"), order.cast("int").alias("ord"),
        name.alias("name"), kind.alias("kind"), last.cast("int").alias("line_end"), parent.cast("string").alias("parent"),
        tx.strip(signature).alias("signature")))


def _numbered(lines: Column, test: str) -> Column:
    """(line number, line) of the lines that match a cheap pattern."""
    rows = F.transform(lines, lambda s, i: F.struct((i + 1).alias("no"), s.alias("s")))
    return F.filter(rows, lambda r: r["s"].rlike(test))


def _js_heads(lines: Column, br: Column) -> Column:
    none = F.lit(None)

    def head(r: Column) -> Column:
        s, no = r["s"], r["no"]

        def variable(x: Column) -> Column:
            plain = x["shape"].startswith("function")
            is_fn = (x["name"] != "") & (plain | x["shape"].contains("=>") | B.is_arrow(lines, no))
            return F.when(is_fn, _symbol(x["name"], F.lit("function"), no, B.brace_symbol_end(lines, br, no, ~plain), none, s, no))
        named = lambda name, pattern: F.struct(name.alias("name"), _g(s, pattern, 2).alias("shape"))
        assigned = let(_g(s, JS_VARIABLE, 1), lambda var: F.when(var != "", named(var, JS_VARIABLE)).otherwise(named(_g(s, JS_EXPORTS_FN, 1), JS_EXPORTS_FN)))
        function = let(_g(s, JS_FUNCTION, 1), lambda fn: F.when(
            fn != "", _symbol(fn, F.lit("function"), no, B.brace_symbol_end(lines, br, no, F.lit(False)), none, s, no)).otherwise(let(assigned, variable)))
        return let(_g(s, JS_CLASS, 1), lambda cls: F.when(
            cls != "", _symbol(cls, F.lit("class"), no, F.coalesce(B.block_end(br, no), no), none, s, no)).otherwise(function))
    return F.array_compact(F.transform(_numbered(lines, r"^\s*(export|default|async|function|const|let|var|abstract|class|module|exports)\b"), head))


def _js_methods(lines: Column, br: Column, heads: Column) -> Column:
    def methods(c: Column) -> Column:
        inside = F.filter(B.span(c["line_start"] + 1, c["line_end"] - 1), lambda i: F.element_at(lines, i).rlike(JS_METHOD))
        made = F.transform(inside, lambda i: _symbol(
            _g(F.element_at(lines, i), JS_METHOD, 1), F.lit("method"), i, F.coalesce(B.block_end(br, i), i), c["name"],
            F.element_at(lines, i), i + 1000000))
        return F.filter(made, lambda m: ~m["name"].isin(NOT_METHODS))
    return F.flatten(F.transform(F.filter(heads, lambda h: h["kind"] == "class"), methods))


def _py_symbols(lines: Column) -> Column:
    def head(r: Column) -> Column:
        s, no = r["s"], r["no"]

        def named(is_class: Column) -> Column:
            lead = F.when(is_class, _g(s, PY_CLASS, 1)).otherwise(_g(s, PY_DEF, 1))
            name = F.when(is_class, _g(s, PY_CLASS, 2)).otherwise(_g(s, PY_DEF, 2))
            return F.struct(F.length(F.replace(lead, F.lit("\t"), F.lit("    "))).alias("indent"), name.alias("name"), is_class.alias("cls"))
        return let(let(s.rlike(PY_CLASS), named), lambda x: F.struct(
            no.alias("no"), x["indent"].alias("indent"), x["name"].alias("name"), x["cls"].alias("cls"),
            B.indent_block_end(lines, no, x["indent"]).alias("end"), s.alias("s")))
    heads = F.transform(_numbered(lines, f"{PY_CLASS}|{PY_DEF}"), head)

    def placed(h: Column, all_heads: Column) -> Column:
        around = F.filter(all_heads, lambda c: c["cls"] & (c["no"] <= h["no"]) & (c["end"] >= h["no"]) & (h["indent"] > c["indent"]))

        def symbol(parent: Column) -> Column:
            kind = F.when(h["cls"], "class").when(parent.isNotNull(), "method").otherwise("function")
            return _symbol(h["name"], kind, h["no"], h["end"], parent, h["s"], h["no"])
        return let(F.try_element_at(around, F.lit(-1))["name"], symbol)
    return let(heads, lambda hs: F.transform(hs, lambda h: placed(h, hs)))


def _go_symbols(lines: Column, br: Column) -> Column:
    return F.transform(_numbered(lines, GO_FUNC), lambda r: _symbol(
        _g(r["s"], GO_FUNC, 1), F.lit("function"), r["no"], F.coalesce(B.block_end(br, r["no"]), r["no"]), F.lit(None),
        r["s"], r["no"]))


def import_names(clause: Column) -> Column:
    """Local names of an import, require or export clause."""
    def local(part: Column) -> Column:
        token = tx.strip(F.regexp_replace(tx.strip(part), "^type ", ""))
        after = lambda t, mark: F.when(t.contains(mark), tx.strip(F.substring_index(t, mark, -1))).otherwise(t)
        return let(let(token, lambda t: after(t, " as ")), lambda t: after(t, ":"))
    return F.filter(F.transform(F.split(clause, "[{},]"), local), lambda t: t.rlike("^" + ID + "$"))


def _js_imports(lines: Column) -> Column:
    def of_line(r: Column) -> Column:
        s, no = r["s"], r["no"]
        none = F.array().cast("array<string>")
        row = lambda module, names: F.struct(no.alias("line"), module.alias("module"), names.alias("names"))
        module, only = _g(s, JS_IMPORT_FROM, 2), _g(s, JS_IMPORT_ONLY, 1)
        first = (F.when(module != "", row(module, import_names(_g(s, JS_IMPORT_FROM, 1))))
                 .when(only != "", row(only, none)))
        required = F.arrays_zip(F.regexp_extract_all(s, F.lit(JS_REQUIRE), F.lit(1)).alias("c"),
                                F.regexp_extract_all(s, F.lit(JS_REQUIRE), F.lit(2)).alias("m"))
        return F.concat(F.array_compact(F.array(first)), F.transform(
            required, lambda x: row(x["m"], F.when(x["c"] == "", none).otherwise(import_names(x["c"])))))
    return F.flatten(F.transform(_numbered(lines, "import|require"), of_line))


def _js_exports(lines: Column) -> Column:
    def of_line(r: Column) -> Column:
        s, no = r["s"], r["no"]
        block = F.array_join(F.slice(lines, no, 25), " ")
        body = F.substring_index(F.regexp_extract(block, r"^[^{]*\{(.*)$", 1), "}", 1)
        single = F.filter(F.array(_g(s, JS_EXPORT_DECL, 1), _g(s, JS_EXPORTS_ASSIGN, 1)), lambda x: x != "")
        listed = _g(s, JS_EXPORT_LIST, 1)
        none = F.array().cast("array<string>")
        return F.concat(F.when(s.rlike(JS_MODULE_EXPORTS), import_names(body)).otherwise(none), single,
                        F.when(s.rlike(JS_EXPORT_LIST), import_names(listed)).otherwise(none))
    return F.array_distinct(F.flatten(F.transform(_numbered(lines, "export"), of_line)))


def _py_imports(lines: Column) -> Column:
    def of_line(r: Column) -> Column:
        s, no = r["s"], r["no"]
        parts = F.filter(F.transform(F.split(_g(s, PY_FROM, 2), ","), tx.strip), lambda p: (p != "") & (p != "*"))
        names = F.transform(parts, lambda p: tx.strip(F.substring_index(p, " as ", -1)))
        plain = F.transform(F.split(_g(s, PY_IMPORT, 1), ","), lambda p: F.struct(
            no.alias("line"), tx.strip(F.substring_index(tx.strip(p), " as ", 1)).alias("module"),
            F.array().cast("array<string>").alias("names")))
        frm = F.array(F.struct(no.alias("line"), _g(s, PY_FROM, 1).alias("module"), names.alias("names")))
        return F.when(s.rlike(PY_FROM), frm).otherwise(plain)
    return F.flatten(F.transform(_numbered(lines, f"{PY_FROM}|{PY_IMPORT}"), of_line))


def _js_routes(lines: Column, br: Column) -> Column:
    def of_line(r: Column) -> Column:
        s, no = r["s"], r["no"]

        def arguments(rest: Column) -> Column:
            """The names that follow the path, and whether the last one is the handler."""
            args = F.transform(F.split(rest, ","), tx.strip)
            tail = let(args, lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))))

            def names(t: Column) -> Column:
                bad = F.array_position(F.transform(t, lambda a: a.rlike(ROUTE_ARGUMENT)), False).cast("int")
                run = let(bad, lambda b: F.when(b > 0, F.slice(t, F.lit(1), b - 1)).otherwise(t))
                return F.transform(run, lambda a: _g(a, ROUTE_ARGUMENT, 1))
            inline = rest.contains("=>") | rest.contains("function")
            return let(let(tail, names), lambda ids: F.struct(
                ids.alias("ids"), ((F.size(ids) > 0) & ~inline & tx.rstrip(rest).rlike(r"(\)|\);)$")).alias("named")))

        def route(x: Column) -> Column:
            ids, named = x["ids"], x["named"]
            handler = F.when(named, F.try_element_at(ids, F.lit(-1)))
            middle = F.when(named, F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)
            end = F.when(named, no).otherwise(F.coalesce(B.block_end(br, no), no))
            return F.struct(no.alias("line"), end.alias("line_end"), F.upper(_g(s, JS_ROUTE, 2)).alias("method"),
                            _g(s, JS_ROUTE, 4).alias("path"), middle.alias("middlewares"), handler.alias("handler"),
                            F.lit("express").alias("framework"))
        return let(let(_g(s, JS_ROUTE, 5), arguments), route)
    hinted = F.filter(_numbered(lines, JS_ROUTE_HINT), lambda r: r["s"].rlike(JS_ROUTE))
    return F.transform(hinted, of_line)


def _py_routes(lines: Column, symbols: Column) -> Column:
    def of_line(r: Column) -> Column:
        s, no = r["s"], r["no"]
        verb = F.lower(_g(s, PY_ROUTE, 2))
        listed = _g(_g(s, PY_ROUTE, 4), PY_METHODS, 1)
        first = F.regexp_replace(F.substring_index(listed, ",", 1), "^[ '\"]+|[ '\"]+$", "")
        method = F.when(~verb.isin("route", "api_route"), verb).when(
            _g(s, PY_ROUTE, 4).rlike(PY_METHODS), first).otherwise("GET")
        handler = B.first_where(symbols, lambda x: (x["kind"] != "class") & (x["line_start"] > no) & (x["line_start"] <= no + 7))
        return let(handler, lambda h: F.struct(
            no.alias("line"), F.coalesce(h["line_end"], no).alias("line_end"), F.upper(method).alias("method"),
            _g(s, PY_ROUTE, 3).alias("path"), F.array().cast("array<string>").alias("middlewares"),
            h["name"].alias("handler"), F.lit("python").alias("framework")))
    return F.transform(_numbered(lines, PY_ROUTE), of_line)


def _all(s: Column, pattern: str, *groups: int) -> Column:
    """Matches of a pattern as structs g0, g1, ... of the asked groups."""
    return F.arrays_zip(*[F.regexp_extract_all(s, F.lit(pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups)])


def _calls(lines: Column, symbols: Column) -> Column:
    """All literal and outbound HTTP calls of a file in line order; ``api`` marks internal ones."""
    def of_line(r: Column) -> Column:
        s, no = r["s"], r["no"]
        row = lambda method, target, via, api: F.struct(
            no.alias("line"), method.alias("method"), target.alias("target"), via.alias("via"), api.alias("api"))
        option = _g(F.array_join(F.slice(lines, no, 8), " "), METHOD_OPTION, 1)
        fetch_method = let(option, lambda o: F.when(o != "", F.upper(o)).otherwise("GET"))
        fetches = F.transform(_all(s, FETCH, 2), lambda m: row(fetch_method, m["g0"], F.lit("fetch"), m["g0"].startswith("/")))
        axios = F.transform(_all(s, AXIOS, 1, 3), lambda m: row(F.upper(m["g0"]), m["g1"], F.lit("axios"), m["g1"].startswith("/")))

        def helper_method(m: Column) -> Column:
            low = F.lower(m["g0"])
            def stated(helper: Column) -> Column:
                body = F.array_join(tx.slice_lines(lines, helper["line_start"], helper["line_end"]), "\n")
                return F.when(helper.isNotNull(), F.nullif(F.upper(_g(body, METHOD_OPTION, 1)), F.lit("")))
            own = let(B.first_where(symbols, lambda x: x["name"] == m["g0"]), stated)
            return (F.when(low.contains("delete"), "DELETE").when(low.contains("patch"), "PATCH").when(low.contains("post"), "POST")
                    .when(low.contains("put"), "PUT").otherwise(F.coalesce(own, F.when(m["g2"] != "", "POST").otherwise("GET"))))
        helpers = F.transform(F.filter(_all(s, API_CALL, 1, 3, 4), lambda m: ~m["g0"].isin(NOT_HELPERS)),
                              lambda m: row(helper_method(m), m["g1"], m["g0"], F.lit(True)))

        def outside(m: Column) -> Column:
            target = tx.strip(m["g1"])
            bare = F.regexp_replace(target, "^['\"`]+|['\"`]+$", "")
            return ~target.rlike("^['\"`]/") & ~(target.rlike("^['\"`]") & ~bare.startswith("http"))
        outbound = F.transform(F.filter(_all(s, OUTBOUND, 1, 2), outside), lambda m: row(
            F.lit("?"), F.when(tx.strip(m["g1"]) == "", "(dynamic)").otherwise(F.substring(tx.strip(m["g1"]), 1, 120)),
            m["g0"], F.lit(False)))
        return F.concat(fetches, axios, helpers, outbound)
    hinted = F.filter(_numbered(lines, tx.from_any("(farhu.", r"\(\s*['\"`]|fetch|axios|requests\.|httpx\.|urlopen|\.request")),
                      lambda r: ~tx.strip(r["s"]).rlike(r"^(//|#|\*)"))
    return F.flatten(F.transform(hinted, of_line))


def _data_access(lines: Column) -> Column:
    def of_line(r: Column) -> Column:
        s = r["s"]
        method = _g(s, DATA_CALL, 2)
        kind = (F.when(s.rlike(SQL_TEXT) | method.isin(SQL_METHODS), "sql").when(method.rlike(DOCUMENT_METHODS), "document")
                .otherwise("orm"))
        return F.struct(r["no"].alias("line"), kind.alias("kind"), F.substring(tx.strip(s), 1, 160).alias("snippet"))
    hinted = F.filter(F.transform(lines, lambda s, i: F.struct((i + 1).alias("no"), s.alias("s"))),
                      lambda r: r["s"].rlike(tx.from_any("pcdksm", DATA_CALL)) | r["s"].rlike(SQL_TEXT))
    return F.transform(hinted, of_line)


def _markers(lines: Column) -> Column:
    return F.transform(_numbered(lines, tx.from_any(r"/#*<@\s", MARKER)), lambda r: F.struct(
        r["no"].alias("line"), F.substring(tx.strip(r["s"]), 1, 200).alias("text")))


@functools.lru_cache(maxsize=4)
def _columns(application: str) -> dict[str, Column]:
    """Fact expressions by column name. They only name columns, so each application builds them once."""
    source = F.col("kind") == "source"
    js = source & F.col("language").isin(JS_LANGUAGES)
    py = source & (F.col("language") == "python")
    go = source & (F.col("language") == "go")
    lines, br, heads, symbols = F.col("lines"), F.col("_braces"), F.col("_heads"), F.col("symbols")
    empty = F.array()
    own = F.filter("symbols", lambda s: s["parent"].isNull() & ~s["name"].startswith("_"))

    def calls(api: bool) -> Column:
        rows = F.filter("_calls", lambda c: c["api"] == api)
        bare = F.transform(rows, lambda c: F.struct(c["line"].alias("line"), c["method"].alias("method"),
                                                    c["target"].alias("target"), c["via"].alias("via")))
        return F.coalesce(bare, empty.cast(CALL))
    return {
        "_braces": F.when(js | go, B.braces(lines)),
        "_heads": F.when(js, _js_heads(lines, br)),
        "symbols": F.when(js, F.array_sort(F.concat(heads, _js_methods(lines, br, heads)))).when(py, _py_symbols(lines))
        .when(go, _go_symbols(lines, br)).otherwise(empty.cast(SYMBOL)),
        "_calls": F.when(js | py, _calls(lines, symbols)),
        "imports": F.when(js, _js_imports(lines)).when(py, _py_imports(lines)).otherwise(empty.cast(IMPORT)),
        "exports": F.when(js, _js_exports(lines)).when(py, F.transform(own, lambda s: s["name"])).otherwise(
            empty.cast("array<string>")),
        "routes": F.when(js, _js_routes(lines, br)).when(py, _py_routes(lines, symbols)).otherwise(empty.cast(ROUTE)),
        "api_calls": calls(True),
        "external_calls": calls(False),
        "data_access": F.when(source, _data_access(lines)).otherwise(
            empty.cast("array<struct<line:int,kind:string,snippet:string>>")),
        "markers": F.when(source, _markers(lines)).otherwise(empty.cast("array<struct<line:int,text:string>>")),
        "uses_dom": F.when(js, F.exists(lines, lambda s: s.rlike(tx.from_any("dwls", DOM_USAGE)))).otherwise(F.lit(False)),
    }


FACTS = ("symbols", "imports", "exports", "routes", "api_calls", "external_calls", "data_access", "markers", "uses_dom")
_NEEDS_SYMBOLS = {"symbols", "exports", "routes", "api_calls", "external_calls"}


def parse(files: DataFrame, *only: str) -> DataFrame:
    """Add fact arrays to classified files, all or just the named ones; other files get empty arrays.

    A held stage always runs, so stages that the named facts do not need are left out.
    """
    wanted = set(only or FACTS)
    cols = _columns(files.sparkSession.sparkContext.applicationId)
    df = files
    stages = ["_braces", "_heads", "symbols"] if wanted & _NEEDS_SYMBOLS else []
    if wanted & {"api_calls", "external_calls"}:
        stages.append("_calls")
    for stage in stages:  # each is read inside lambdas of the next
        df = hold(df, **{stage: cols[stage]})
    for name in FACTS[1:]:
        if name in wanted:
            df = df.withColumn(name, cols[name])
    return df.drop("_braces", "_heads", "_calls")


def table(parsed: DataFrame, fact: str, *keep: str) -> DataFrame:
    """One fact list as rows, with its place in the file as ``ordinal``."""
    cols = ("repo_id", "path", *keep)
    rows = hold(parsed.select(*cols, fact), **{fact: F.col(fact)}).select(*cols, F.posexplode(fact).alias("ordinal", "f"))
    inner = [c for c in parsed.schema[fact].dataType.elementType.names if c not in ("neg", "ord")]
    return rows.select(*cols, "ordinal", *[F.col(f"f.{c}").alias("route_path" if (fact, c) == ("routes", "path") else c)
                                           for c in inner])


def called_identifiers(text: Column) -> Column:
    """Directly called names in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CALLED), F.lit(1)))


def symbol_at(symbols: Column, line: Column) -> Column:
    """Innermost symbol around a line of the same file; the earlier one of equal length."""
    around = F.filter(symbols, lambda s: (s["line_start"] <= line) & (s["line_end"] >= line))
    best = F.aggregate(around, F.lit(None).cast(SYMBOL[6:-1]), lambda acc, s: F.when(
        acc.isNull() | (s["neg"] > acc["neg"]), s).otherwise(acc))
    return best


def innermost_symbol(points: DataFrame, symbols: DataFrame, bucket: int = 64) -> DataFrame:
    """Join points (repo_id, path, line) to their innermost symbol when both sides are tables.

    Symbol spans are cut into fixed line buckets, so the interval join is an equi-join.
    """
    cut = symbols.withColumn("_b", F.explode(F.sequence(F.floor(F.col("line_start") / bucket).cast("int"),
                                                        F.floor(F.col("line_end") / bucket).cast("int"))))
    cut = cut.select("repo_id", "path", "_b", "name", "line_start", "line_end")
    joined = points.withColumn("_b", F.floor(F.col("line") / bucket).cast("int")).join(cut, ["repo_id", "path", "_b"])
    rank = F.struct(F.col("line_end") - F.col("line_start"), "line_start", "name")
    return (joined.where("line BETWEEN line_start AND line_end").groupBy("repo_id", "path", "line")
            .agg(F.min_by(F.struct("name", "line_start", "line_end"), rank).alias("s")).select("repo_id", "path", "line", "s.*"))


def symbol_index(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per file and name, per repository and name): the first symbol, by path and place in the file."""
    rows = table(parsed, "symbols")
    value = F.struct("path", "line_start", "line_end", "kind")
    own = rows.groupBy("repo_id", "path", "name").agg(F.min_by(value, F.col("ordinal")).alias("own"))
    first = rows.groupBy("repo_id", "name").agg(F.min_by(value, F.struct("path", "ordinal")).alias("first"))
    return own, first


def resolve_names(refs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Resolve (repo_id, path, name) to a symbol: the same file first, else the first of the repository.

    Both lookups are aggregated to one row per key first, so a common name never multiplies rows.
    """
    own, first = symbol_index(parsed)
    out = refs.join(own, ["repo_id", "path", "name"], "left").join(first, ["repo_id", "name"], "left")
    return out.withColumn("target", F.coalesce("own", "first")).drop("own", "first")


