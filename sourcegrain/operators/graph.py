"""Architecture: stack, import graph, modules, capabilities, important files, README."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.functions.stages import hold
from sourcegrain.operators import facts as C
from sourcegrain.sources.external import _DEPENDENCY_GROUPS, _MANIFEST_SCHEMA

# ---- fixed values: package tables, layer order, name patterns ----
JS_PACKAGES = {
    "react": ("frontend", "React"), "react-dom": ("frontend", "React"), "next": ("frontend", "Next.js"),
    "vue": ("frontend", "Vue"), "nuxt": ("frontend", "Nuxt"), "svelte": ("frontend", "Svelte"),
    "@angular/core": ("frontend", "Angular"), "solid-js": ("frontend", "Solid"),
    "express": ("backend", "Express"), "koa": ("backend", "Koa"), "fastify": ("backend", "Fastify"),
    "@nestjs/core": ("backend", "NestJS"), "@hapi/hapi": ("backend", "hapi"), "hono": ("backend", "Hono"),
    "pg": ("database", "PostgreSQL"), "postgres": ("database", "PostgreSQL"), "mysql": ("database", "MySQL"),
    "mysql2": ("database", "MySQL"), "mongodb": ("database", "MongoDB"), "mongoose": ("database", "MongoDB (Mongoose)"),
    "sqlite3": ("database", "SQLite"), "better-sqlite3": ("database", "SQLite"),
    "@prisma/client": ("database", "Prisma ORM"), "sequelize": ("database", "Sequelize ORM"),
    "typeorm": ("database", "TypeORM"), "knex": ("database", "Knex"), "redis": ("cache", "Redis"),
    "ioredis": ("cache", "Redis"), "jsonwebtoken": ("authentication", "JWT (jsonwebtoken)"),
    "passport": ("authentication", "Passport"), "bcrypt": ("authentication", "bcrypt"),
    "bcryptjs": ("authentication", "bcrypt"), "express-session": ("authentication", "Server sessions"),
    "next-auth": ("authentication", "NextAuth"), "jose": ("authentication", "JWT (jose)"),
    "stripe": ("integrations", "Stripe"), "axios": ("integrations", "Axios HTTP client"),
}
PY_PACKAGES = {
    "fastapi": ("backend", "FastAPI"), "flask": ("backend", "Flask"), "django": ("backend", "Django"),
    "starlette": ("backend", "Starlette"), "aiohttp": ("backend", "aiohttp"),
    "sqlalchemy": ("database", "SQLAlchemy"), "psycopg2": ("database", "PostgreSQL"),
    "psycopg": ("database", "PostgreSQL"), "asyncpg": ("database", "PostgreSQL"), "pymongo": ("database", "MongoDB"),
    "motor": ("database", "MongoDB"), "sqlite3": ("database", "SQLite"), "peewee": ("database", "Peewee ORM"),
    "redis": ("cache", "Redis"), "celery": ("infrastructure", "Celery workers"),
    "pyjwt": ("authentication", "JWT (PyJWT)"), "jwt": ("authentication", "JWT"),
    "python-jose": ("authentication", "JWT (python-jose)"), "passlib": ("authentication", "passlib"),
    "bcrypt": ("authentication", "bcrypt"), "stripe": ("integrations", "Stripe"),
    "requests": ("integrations", "requests HTTP client"), "httpx": ("integrations", "httpx HTTP client"),
    "pandas": ("data", "pandas"), "numpy": ("data", "NumPy"), "torch": ("ml", "PyTorch"),
    "tensorflow": ("ml", "TensorFlow"), "scikit-learn": ("ml", "scikit-learn"), "openai": ("ml", "OpenAI SDK"),
}
LAYER_ORDER = ["frontend", "backend", "database", "authentication", "integrations", "cache", "infrastructure", "data", "ml"]
RUNTIMES = {"javascript": "Node.js", "typescript": "Node.js", "python": "Python", "go": "Go"}
RESOLVE_SUFFIXES = ["", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".vue", "/index.js", "/index.ts", "/index.tsx"]
AUTH_NAME = r"(?i)(auth|login|logout|jwt|token|session|password|signin|signup|register|verify)"
CAPABILITY_NAMES = {
    "authentication": AUTH_NAME,
    "payments": r"(?i)(payment|checkout|charge|billing|stripe|invoice|card)",
    "validation": r"(?i)(validat|is[A-Z]?valid|sanitiz|check[A-Z])",
}
SHARED_DIRS = ["utils", "util", "lib", "libs", "shared", "common", "helpers", "helper"]
FRONT_DIRS = ["frontend", "client", "web", "ui", "public", "components", "pages"]
TEST_MODULES = ["tests", "test", "__tests__", "spec"]
DATA_MODULES = ["db", "database", "models", "migrations", "schema"]
PY_MANIFESTS = ["pyproject.toml", "pipfile", "setup.py", "setup.cfg"]
SPECIAL_GROUPS = {"readme": "readme", "manifest": "manifests", "dockerfile": "dockerfiles", "compose": "dockerfiles",
                  "config": "configs", "entrypoint": "entrypoints", "test": "tests"}
SKIP_PARAGRAPH = r"^(#|>|!|\[!|<|\||```|---|===)"
TITLE = r"^\s{0,3}#\s+(.+)$"
# ---- end of fixed values ----


def _lookup(table: dict[str, tuple[str, str]], key: Column) -> Column:
    pairs = [x for k, (layer, value) in table.items()
             for x in (F.lit(k), F.struct(F.lit(layer).alias("layer"), F.lit(value).alias("value")))]
    return F.try_element_at(F.create_map(*pairs), key)


def _in_order(values: list[str], col: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), col)


def manifest_claims(files: DataFrame) -> DataFrame:
    """Stack claims of manifests: repo_id, path, line, layer, value, label."""
    name = F.lower(tx.base_name(F.col("path")))
    found = files.where(F.col("kind") == "manifest").withColumn("_name", name)
    js = found.where("_name = 'package.json'")
    parsed = F.from_json(tx.join_lines(F.col("lines")), _MANIFEST_SCHEMA)
    js = hold(js, _j=parsed)
    names = F.array_distinct(F.flatten(F.array_compact(F.array(*[F.map_keys(f"_j.{g}") for g in _DEPENDENCY_GROUPS],
                                                               F.array().cast("array<string>")))))
    js = js.select("repo_id", "path", "lines", F.explode(names).alias("dep")).withColumn("hit", _lookup(JS_PACKAGES, F.col("dep")))
    quoted = F.concat(F.lit('"'), F.col("dep"), F.lit('"'))
    line = F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(1), F.size("lines")),
                                                lambda i: F.element_at("lines", i).contains(quoted)), F.lit(1)), F.lit(1))
    js = js.where("hit IS NOT NULL").select("repo_id", "path", line.alias("line"), "hit", F.concat(F.lit("dependency "), "dep").alias("label"))
    plain = F.col("_name").startswith("requirements")
    py = (found.where(plain | F.col("_name").isin(PY_MANIFESTS))
          .select("repo_id", "path", plain.alias("plain"), F.posexplode("lines").alias("i", "s"))
          .withColumn("dep", F.lower(F.regexp_extract("s", r"""^\s*["']?([A-Za-z0-9_.\-]+)""", 1)))
          .withColumn("hit", _lookup(PY_PACKAGES, F.col("dep")))
          .where(F.col("hit").isNotNull() & (F.col("plain") | F.col("s").rlike(r"""["'=<>]"""))))
    py = py.select("repo_id", "path", (F.col("i") + 1).alias("line"), "hit", F.concat(F.lit("dependency "), "dep").alias("label"))
    return js.unionByName(py).select("repo_id", "path", "line", "hit.layer", "hit.value", "label")


def package_root(module: Column) -> Column:
    scoped = F.substring_index(module, "/", 2)
    return F.when(module.startswith("@"), scoped).otherwise(F.substring_index(F.substring_index(module, "/", 1), ".", 1))


def import_claims(parsed: DataFrame) -> DataFrame:
    rows = C.table(parsed, "imports", "language").withColumn("root", package_root(F.col("module")))
    hit = F.when(F.col("language") == "python", _lookup(PY_PACKAGES, F.col("root"))).otherwise(_lookup(JS_PACKAGES, F.col("root")))
    return (rows.withColumn("hit", hit).where("hit IS NOT NULL")
            .select("repo_id", "path", "line", "hit.layer", "hit.value", F.concat(F.lit("imports "), "root").alias("label"), "ordinal"))


def detect_stack(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(layers, evidence). Layers: repo_id, layer, value, values; evidence: at most four rows per layer.

    Order of claims: manifests by path, then source files by path and line, then the fallbacks.
    """
    manifests = manifest_claims(parsed).withColumn("stage", F.lit(0)).withColumn("ordinal", F.col("line"))
    imports = import_claims(parsed).withColumn("stage", F.lit(1))
    known = manifests.unionByName(imports)
    layers = known.select("repo_id", "layer").distinct()

    def missing(rows: DataFrame, layer: str) -> DataFrame:
        return rows.join(layers.where(F.col("layer") == layer).select("repo_id"), "repo_id", "left_anti").withColumn("layer", F.lit(layer))

    data = C.table(parsed, "data_access").groupBy("repo_id").agg(F.min_by(F.struct("path", "line", "kind"), F.struct("path", "ordinal")).alias("d"))
    data = data.select("repo_id", "d.path", "d.line", F.when(F.col("d.kind") == "sql", "SQL database").otherwise("Document database").alias("value"),
                       F.lit("data access call").alias("label"))
    dom_line = F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.element_at("lines", i).rlike(
        r"\b(document\.|window\.|localStorage\.)")), F.lit(1)), F.lit(1))
    dom = parsed.where(F.col("uses_dom") & (F.size("routes") == 0)).select(
        "repo_id", "path", dom_line.alias("line"), F.lit("Vanilla JavaScript (browser DOM)").alias("value"), F.lit("DOM API usage").alias("label"))
    routes = C.table(parsed, "routes", "language")
    api = routes.groupBy("repo_id").agg(F.min_by(F.struct("path", "line", "method", "route_path"), F.struct("path", "ordinal")).alias("r"))
    api = api.select("repo_id", "r.path", "r.line", F.lit("HTTP API").alias("value"), F.concat_ws(" ", F.lit("route"), "r.method", "r.route_path").alias("label"))
    claims = known
    for rows, layer in ((data, "database"), (dom, "frontend"), (api, "backend")):
        claims = claims.unionByName(missing(rows, layer).withColumn("stage", F.lit(2)).withColumn("ordinal", F.col("line")))
    order = F.struct("stage", "path", "ordinal")
    values = claims.groupBy("repo_id", "layer", "value").agg(F.min(order).alias("o"))
    rolled = values.groupBy("repo_id", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "value"))), lambda v: v["value"]).alias("values"))
    languages = (routes.select("repo_id", "path", "language").distinct().groupBy("repo_id", "language")
                 .agg(F.count("*").alias("n"), F.min("path").alias("p")))
    top = languages.groupBy("repo_id").agg(F.min_by("language", F.struct(-F.col("n"), F.col("p"))).alias("language"))
    runtime = F.try_element_at(F.create_map(*[F.lit(x) for kv in RUNTIMES.items() for x in kv]), F.col("language"))
    shown = F.array_join(F.slice("values", 1, 3), " · ")
    full = F.when((F.col("layer") == "backend") & F.col("runtime").isNotNull() & ~shown.contains(F.col("runtime")),
                  F.concat(F.col("runtime"), F.lit(" · "), shown)).otherwise(shown)
    out = rolled.join(top.select("repo_id", runtime.alias("runtime")), "repo_id", "left").select(
        "repo_id", "layer", full.alias("value"), "values", _in_order(LAYER_ORDER, F.col("layer")).alias("layer_no"))
    spots = claims.groupBy("repo_id", "layer", "path", "line").agg(F.min_by("label", order).alias("label"), F.min(order).alias("o"))
    w = Window.partitionBy("repo_id", "layer").orderBy("o")
    evidence = spots.withColumn("n", F.row_number().over(w)).where("n <= 4").select("repo_id", "layer", "n", "path", "line", "label")
    return out, evidence


def _normal_parts(path: Column) -> Column:
    def step(acc: Column, part: Column) -> Column:
        return (F.when(part.isin("", "."), acc).when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
                .otherwise(F.array_append(acc, part)))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def import_edges(parsed: DataFrame) -> DataFrame:
    """Distinct edges src -> dst inside a repository; candidates meet files by an equi-join."""
    rows = C.table(parsed, "imports", "language")
    module, base = F.col("module"), tx.dir_parts(F.col("path"))
    joined = F.concat_ws("/", F.array_join(base, "/"), module)
    depth = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    parent = F.array_join(F.slice(base, F.lit(1), F.greatest(F.size(base) - (depth - 1), F.lit(0))), "/")
    rest = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    stem = F.when(depth > 0, F.concat_ws("/", F.nullif(parent, F.lit("")), rest)).otherwise(rest)
    python = F.col("language") == "python"
    rows = rows.where(python | module.startswith("."))
    rows = hold(rows, bare=(depth > 0) & (rest == ""), target=F.when(python, stem).otherwise(F.array_join(_normal_parts(joined), "/")))
    js = F.transform(F.array(*[F.lit(s) for s in RESOLVE_SUFFIXES]), lambda s: F.concat("target", s))
    py = F.when(F.col("bare"), F.array().cast("array<string>")).otherwise(F.array(F.concat("target", F.lit(".py")), F.concat("target", F.lit("/__init__.py"))))
    candidates = F.when(python, py).otherwise(js)
    rows = rows.select("repo_id", F.col("path").alias("src"), "ordinal", F.posexplode(candidates).alias("priority", "dst"))
    known = parsed.select("repo_id", F.col("path").alias("dst"))
    best = rows.join(known, ["repo_id", "dst"]).groupBy("repo_id", "src", "ordinal").agg(F.min_by("dst", "priority").alias("dst"))
    return best.where("dst <> src").select("repo_id", "src", "dst").distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo_id", F.col("dst").alias("path")).agg(F.count("*").alias("imported_by"))


def module_map(parsed: DataFrame) -> DataFrame:
    """Modules by top folder (two levels when one folder holds every source) with role and counts."""
    dirs = tx.dir_parts(F.col("path"))
    top = F.when(F.size(dirs) == 0, "(root)").otherwise(F.element_at(dirs, 1))
    tops = (parsed.where("kind = 'source'").groupBy("repo_id").agg(
        F.when((F.min(top) == F.max(top)), 2).otherwise(1).alias("depth")))
    rows = parsed.join(tops, "repo_id", "left").fillna({"depth": 1}).withColumn("module", F.when(F.size(dirs) == 0, "(root)").otherwise(
        F.array_join(F.slice(dirs, F.lit(1), F.least(F.col("depth"), F.size(dirs))), "/")))
    source = F.col("kind") == "source"
    fns = F.size(F.filter("symbols", lambda s: s["kind"] != "class"))
    rolled = rows.groupBy("repo_id", "module").agg(
        F.count("*").alias("files"), F.sum(fns).alias("functions"), F.sum(F.size("routes")).alias("routes"),
        F.count_if(source).alias("sources"), F.count_if(F.col("uses_dom")).alias("dom"))
    low = F.lower(F.substring_index("module", "/", -1))
    role = (F.when(low.isin(FRONT_DIRS) | ((F.col("sources") > 0) & (F.col("dom") > F.col("sources") / 2)), "Frontend (browser UI)")
            .when(F.col("routes") > 0, "Backend / API").when(low.isin(SHARED_DIRS), "Shared utilities").when(low.isin(TEST_MODULES), "Tests")
            .when(low.isin(DATA_MODULES), "Data layer").when(low.isin("docs", "doc"), "Documentation")
            .when(F.col("module") == "(root)", "Project root (docs & configuration)").otherwise("Application code"))
    return rolled.withColumn("role", role).select("repo_id", "module", "role", "files", "functions", "routes")


def _named(pattern: str) -> Column:
    return (F.exists("symbols", lambda s: s["name"].rlike(pattern)) | F.exists("routes", lambda r: r["path"].rlike(pattern))
            | tx.stem(F.col("path")).rlike(pattern))


def capabilities(parsed: DataFrame) -> DataFrame:
    """repo_id, capability, files, and up to twelve symbols for the named ones."""
    source = parsed.where("kind = 'source'")
    flags = {}
    for name, pattern in CAPABILITY_NAMES.items():
        flags[name] = _named(pattern)
    flags["database"] = F.size("data_access") > 0
    flags["api"] = F.size("routes") > 0
    rows = source.select("repo_id", "path", F.explode(F.array(*[F.when(test, F.lit(n)) for n, test in flags.items()])).alias("capability"))
    return rows.where("capability IS NOT NULL").groupBy("repo_id", "capability").agg(F.count("*").alias("files"))


def capability_symbols(parsed: DataFrame, limit: int = 12) -> DataFrame:
    rows = C.table(parsed, "symbols")
    tagged = rows.select("*", F.explode(F.array(*[F.when(F.col("name").rlike(p), F.lit(n)) for n, p in CAPABILITY_NAMES.items()])).alias("capability"))
    w = Window.partitionBy("repo_id", "capability").orderBy("path", "ordinal")
    return (tagged.where("capability IS NOT NULL").withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
            .select("repo_id", "capability", "n", "name", "path", "line_start"))


def important_files(parsed: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """Files by weighted signals with their reasons, top ``limit`` per repository."""
    mains = (parsed.where(F.lower(tx.base_name(F.col("path"))) == "package.json")
             .select("repo_id", F.struct("path", tx.drop_dot_slash(F.get_json_object(tx.join_lines(F.col("lines")), "$.main")).alias("m")).alias("x"))
             .groupBy("repo_id").agg(F.max("x").alias("x")).select("repo_id", F.col("x.m").alias("main")))
    rows = parsed.join(in_degree(edges), ["repo_id", "path"], "left").join(mains, "repo_id", "left")
    tag = lambda t: F.array_contains("tags", t)
    auth = F.transform(F.filter("symbols", lambda s: s["name"].rlike(AUTH_NAME)), lambda s: s["name"])
    entry = tag("entrypoint") | F.coalesce(F.col("path") == F.col("main"), F.lit(False))
    n_routes, shared = F.size("routes"), F.lower(F.element_at(F.split("path", "/"), 1)).isin(SHARED_DIRS)
    n_in = F.coalesce("imported_by", F.lit(0))
    rows = hold(rows, _auth=auth)
    signals = [
        (tag("readme"), F.lit(6.0), F.lit("Project documentation and intent")),
        (tag("manifest"), F.lit(4.0), F.lit("Declares dependencies and scripts")),
        (entry, F.lit(5.0), F.lit("Application entry point")),
        (n_routes > 0, 2.0 * n_routes, F.format_string("Defines %d API route(s)", n_routes)),
        (F.size("data_access") > 0, F.lit(2.0), F.lit("Talks to the database")),
        (F.size("_auth") > 0, F.lit(2.0), F.concat(F.lit("Authentication logic ("), F.array_join(F.slice("_auth", 1, 3), ", "), F.lit(")"))),
        (n_in > 0, 1.5 * n_in, F.format_string("Imported by %d file(s)", n_in)),
        (shared, F.lit(1.0), F.lit("Shared utilities")),
    ]
    score = 0.2 * F.size("symbols")
    for test, points, _ in signals:
        score = score + F.when(test, points).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(test, reason) for test, _, reason in signals]))
    ranked = rows.select("repo_id", "path", F.round(score, 1).alias("score"), F.array_join(reasons, "; ").alias("reason")).where("reason <> ''")
    w = Window.partitionBy("repo_id").orderBy(F.desc("score"), "path")
    return ranked.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= limit)


def language_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("line_count").alias("lines"))


def special_groups(files: DataFrame) -> DataFrame:
    group = F.try_element_at(F.create_map(*[F.lit(x) for kv in SPECIAL_GROUPS.items() for x in kv]), F.col("tag"))
    return (files.select("repo_id", "path", F.explode("tags").alias("tag")).withColumn("grp", group).where("grp IS NOT NULL")
            .select("repo_id", "grp", "path").distinct())


def readme_intro(files: DataFrame) -> DataFrame:
    """Title and first paragraph of the shallowest README of each repository."""
    depth = F.size(F.split("path", "/"))
    order = F.struct(depth, F.lower("path") != "readme.md", F.col("path"))
    first = files.where(F.array_contains("tags", "readme")).groupBy("repo_id").agg(F.min_by(F.struct("path", "lines"), order).alias("r")).select("repo_id", "r.*")
    start = F.struct(F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("para"), F.lit(0).alias("last"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        s = tx.strip(x["s"])
        has = F.size(acc["para"]) > 0
        is_title = x["s"].rlike(TITLE) & acc["title"].isNull() & ~has
        title = tx.strip(F.regexp_replace(tx.strip(F.regexp_extract(x["s"], TITLE, 1)), "^#+|#+$", ""))
        stop = (s == "") | s.rlike(SKIP_PARAGRAPH)
        state = lambda t, p, n, d: F.struct(t.alias("title"), p.alias("para"), n.alias("last"), d.alias("done"))
        same = state(acc["title"], acc["para"], acc["last"], acc["done"])
        return (F.when(acc["done"], same).when(is_title, state(title, acc["para"], x["no"], F.lit(False)))
                .when(stop, state(acc["title"], acc["para"], acc["last"], has))
                .otherwise(state(acc["title"], F.array_append(acc["para"], s), x["no"], F.lit(False))))
    numbered = F.transform("lines", lambda s, i: F.struct(s.alias("s"), (i + 1).alias("no")))
    first = hold(first, _r=F.aggregate(numbered, start, step))
    text = F.array_join("_r.para", " ")
    cut = F.concat(F.regexp_replace(F.substring(text, 1, 397), r" [^ ]*$", ""), F.lit("…"))
    return first.select("repo_id", "path", F.col("_r.title").alias("title"), F.nullif(F.when(F.length(text) > 400, cut).otherwise(text), F.lit("")).alias("intro"),
                        F.col("_r.last").alias("last_line"))


def summary(parsed: DataFrame, layers: DataFrame, modules: DataFrame) -> DataFrame:
    """One summary sentence per repository from README, stack and counts."""
    intro = readme_intro(parsed).select("repo_id", "intro")
    picked = layers.groupBy("repo_id").agg(*[F.max(F.when(F.col("layer") == name, F.col("value"))).alias(name)
                                             for name in ("frontend", "backend", "database", "authentication")])
    pieces = F.array_compact(F.array(F.concat(F.lit("a "), "frontend", F.lit(" frontend")), F.concat(F.lit("a "), "backend", F.lit(" backend")),
                                     F.concat("database", F.lit(" for persistence")), F.concat("authentication", F.lit(" for authentication"))))
    stack = F.when(F.size(pieces) > 1, F.concat(F.array_join(F.slice(pieces, F.lit(1), F.size(pieces) - 1), ", "), F.lit(" and "),
                                                F.element_at(pieces, -1))).otherwise(F.array_join(pieces, ""))
    counts = parsed.groupBy("repo_id").agg(F.count("*").alias("n"), F.sum(F.size("routes")).alias("r"))
    mods = modules.groupBy("repo_id").agg(F.count("*").alias("m"))
    rows = counts.join(mods, "repo_id").join(picked, "repo_id", "left").join(intro, "repo_id", "left")
    name = F.concat(F.lit("Repository "), "repo_id")
    lead = (F.when(F.col("intro").isNull(), F.concat(name, F.lit(" is a software codebase.")))
            .when(F.lower("intro").contains(F.lower(name)), F.col("intro")).otherwise(F.concat(name, F.lit(": "), "intro")))
    detected = F.when(F.size(pieces) > 0, F.concat(F.lit("Detected "), stack, F.lit(".")))
    tail = F.format_string("It exposes %d API route(s) across %d module(s) and %d indexed file(s).", "r", "m", "n")
    return rows.select("repo_id", F.concat_ws(" ", lead, detected, tail).alias("summary"))
